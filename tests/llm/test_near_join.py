import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lectern.llm.near_join import SignatureTree, Signatures, linked, near_components, needed, signature

from .conftest import EDGES, SCHEMA, rows_of


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(pairs):
    sets = [shingles(t) for _, t, *_ in pairs]
    up = list(range(len(pairs)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    by_id = {}
    for i, (d, *_) in enumerate(pairs):
        if d is None:
            continue
        if d in by_id:
            up[find(i)] = find(by_id[d])
        by_id[d] = i
        for j in range(i):
            if pairs[j][0] is None or not sets[i] or not sets[j]:
                continue
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                up[find(i)] = find(j)
    least = {}
    for i, (d, *_) in enumerate(pairs):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return collections.Counter((d, len(s), None if d is None else least[find(i)]) for i, ((d, *_), s) in enumerate(zip(pairs, sets)))


def corpus(rng, n):
    """Near copies of many grades, chains of them, shared passages, short texts."""
    words = [f"w{k}" for k in range(4000)]
    passage = rng.choices(words, k=60)
    texts = []
    while len(texts) < n:
        base = rng.choices(words, k=rng.choice([3, 5, 6, 9, 12, 40, 150, 400]))
        if rng.random() < 0.3:
            base[len(base) // 2 : len(base) // 2] = passage
        texts.append(base)
        for _ in range(rng.choice([0, 0, 1, 3, 12])):
            base = list(rng.choice(texts[-3:]))
            for _ in range(max(1, int(len(base) * rng.choice([0.004, 0.01, 0.02, 0.03])))):
                k = rng.randrange(len(base))
                base[k : k + rng.choice([0, 1, 1])] = [rng.choice(words)]
            texts.append(base)
    return [" ".join(t) for t in texts]


def copies_of_one(rng, n):
    """Two large groups around one text, each of copies that differ a little, and texts that share half of it."""
    words = [f"v{k}" for k in range(3000)]
    base = rng.choices(words, k=200)
    other = base[:110] + rng.choices(words, k=90)
    out = []
    for k in range(n):
        text = list(base if k % 3 else other)
        for _ in range(rng.choice([1, 1, 2])):
            text[rng.randrange(len(text))] = rng.choice(words)
        out.append(text if k % 9 else base[:100] + rng.choices(words, k=rng.randint(40, 160)))
    return [" ".join(t) for t in out]


def test_against_brute_force(spark):
    rng = random.Random(11)
    pairs = [(1000 - k if k % 2 else 5000 + k, t if k % 5 else t.upper(), "s") for k, t in enumerate(corpus(rng, 350))]
    df = spark.createDataFrame(rows_of(pairs), SCHEMA).repartition(4)
    want = brute(pairs)
    assert len({c for _, _, c in want}) < len(pairs) * 0.8
    assert collections.Counter(map(tuple, near_components(spark, df).collect())) == want


@pytest.mark.parametrize("seed", [21, 22])
def test_small_parts_and_rounds(spark, seed):
    """Parts and hot shingles of five: blocks of many parts, bands, tree against tree, several rounds."""
    rng = random.Random(seed)
    pairs = [(k * 7919 % 10007, t, "s") for k, t in enumerate(corpus(rng, 260) + copies_of_one(rng, 90))]
    df = spark.createDataFrame(rows_of(pairs), SCHEMA).repartition(4)
    assert collections.Counter(map(tuple, near_components(spark, df, part=5, rare=5, first_pairs=1).collect())) == brute(pairs)


def test_edges(spark, edges, none):
    assert collections.Counter(map(tuple, near_components(spark, edges).collect())) == brute(EDGES)
    assert near_components(spark, none).count() == 0


def test_one_id_two_texts(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    pairs = [(5, a, "s"), (5, b, "s"), (3, b, "s"), (9, a, "s"), (7, "c c c", "s"), (None, a, "s")]
    df = spark.createDataFrame(rows_of(pairs), SCHEMA)
    assert collections.Counter(map(tuple, near_components(spark, df).collect())) == brute(pairs)


def test_tree_connects_what_links_connect():
    rng = np.random.default_rng(1)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 1 << 62, rng.integers(5, 400), dtype=np.uint64)
        for _ in range(rng.integers(1, 9)):
            s = base.copy()
            k = rng.integers(0, max(1, len(s) // 6) + 1)
            s[rng.integers(0, len(s), k)] = rng.integers(0, 1 << 62, k, dtype=np.uint64)
            sets.append(np.unique(s))
    tree = SignatureTree(sets)
    tree.join()
    up = list(range(len(sets)))

    def find(i):
        return i if up[i] == i else find(up[i])

    for i in range(len(sets)):
        for j in range(i):
            if linked(sets[i], sets[j]):
                up[find(i)] = find(j)
    groups = lambda f: {frozenset(i for i in range(len(sets)) if f(i) == r) for r in map(f, range(len(sets)))}
    assert groups(find) == groups(tree.find)


def random_sets(rng, groups):
    out = []
    for _ in range(groups):
        base = rng.integers(0, 1 << 62, rng.integers(1, 300), dtype=np.uint64)
        for _ in range(rng.integers(1, 12)):
            s = base.copy()
            k = rng.integers(0, max(1, len(s) // 5) + 1)
            s[rng.integers(0, len(s), k)] = rng.integers(0, 1 << 62, k, dtype=np.uint64)
            out.append(np.unique(s))
    return out


@pytest.mark.parametrize("sides", [1, 2])
def test_trees_name_every_pair_that_links(sides):
    """Tasks of all sizes, of one side and of two: whatever links is named while pairs are unlimited, and the rest is told when they are not."""
    rng = np.random.default_rng(sides)
    rows, want, ids = [], set(), 0
    for task in range(12):
        sets = random_sets(rng, [1, 2, 40, 60][task % 4])
        other = rng.integers(0, 2, len(sets)).astype(bool) if sides == 2 and task % 3 else np.zeros(len(sets), bool)
        mine = list(range(ids, ids + len(sets)))
        ids += len(sets)
        comp = [i - i % 3 for i in mine]
        rows += [(task // 2, task % 2, bool(o), i, len(s), 0, c, signature(s).tobytes()) for o, i, s, c in zip(other, mine, sets, comp)]
        for x in range(len(sets)):
            for y in range(x):
                if comp[x] != comp[y] and (other[x] != other[y] or not other.any()) and linked(sets[x], sets[y]):
                    want.add((mine[y], mine[x]))
    names = ["token", "task", "other", "id", "n", "pos", "comp", "sig"]
    table = pa.table([pa.array(c, pa.binary() if n == "sig" else None) for n, c in zip(names, zip(*rows))], names)
    found = Signatures(table)
    _, a, b, more = found.pairs(1 << 40)
    got = set(zip(a.tolist(), b.tolist()))
    assert want and want <= got and not len(more)
    assert len(got) < 3 * len(want) + 50
    _, a, b, more = found.pairs(1)
    assert len(more) and set(zip(a.tolist(), b.tolist())) < got
    assert needed(4, 5) == 4
