import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from lectern.llm.byte_bpe import Backtracking, decoded, encoded, round_trip
from lectern.llm.packing import linear_grouping, packed, plan_of
from lectern.llm.store import scratch
from lectern.llm.token_count import MergeCounts, token_counts
from lectern.llm.token_files import TokenFile, read_token_files, write_token_files
from lectern.llm.units import LibraryIds

from .conftest import EDGES

VOCABULARY, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")
TRICKY = ["", "a", " ", "  ", "a  b", " \n b", "x\n y", "a \n  b", "don't  'll 's", "\t\ta\t b", "été 日本語 1234 $$ ##", "ß" * 300, "a" * 1000, "<|endoftext|><|endoftext|> a <|endoftext|>", "a\x1c \x1cb", "a　 　b", "क्ष \U00010ffd z"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def ids_of(coder, texts):
    flat, ends = coder.encode(pa.array(texts))
    return [flat[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])]


def test_units_equal_library(library):
    want = [library.encode(t, add_special_tokens=False).ids for t in TRICKY]
    coder = LibraryIds(VOCABULARY)
    for _ in range(2):  # the second time from memory
        assert ids_of(coder, TRICKY) == want
    assert MergeCounts(VOCABULARY).counts(pa.array(TRICKY)).tolist() == [len(w) for w in want]


def test_backtracking_equals_library():
    coder = Backtracking(RANKS, P.PATTERN)
    told = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    rng = np.random.default_rng(3)
    noise = ["".join(rng.choice(list("abeinrst éß"), 60)) for _ in range(300)]
    for texts in (TRICKY, noise):
        got = ids_of(coder, texts)
        assert got == [told.encode_ordinary(t) for t in texts]
        assert [coder.decode(g).decode() for g in got] == texts


WHITE = ["\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x1d", "\x1e", "\x1f", " ", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u2029", "\u202f", "\u205f", "\u3000", "\r\n", "\n\n"]


def white_ends(seed, n=400):
    """Texts that begin and end with each white-space character, in one batch."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcde'st129.,\xe9\u65e5") for _ in range(rng.randint(0, 4)))
    out = ["a b\n", "\nc d", "hello world\n", "\tfoo bar", "One line.\r\n", "\r\nNext"]
    for w in WHITE:
        out += [f"a b{w}", f"{w}c d", f"{w}e{w}", f"x {w}", f"{w} y", w]
    while len(out) < n:
        inner = rng.choice([" ", " ", " ", *WHITE]).join(word() for _ in range(rng.randint(1, 6)))
        out.append(rng.choice(["", *WHITE]) + inner + rng.choice(["", *WHITE]))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_white_space_at_both_ends(library, seed):
    texts = white_ends(seed)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids_of(LibraryIds(VOCABULARY), texts) == want
    assert MergeCounts(VOCABULARY).counts(pa.array(texts)).tolist() == [len(w) for w in want]
    coder = Backtracking(RANKS, P.PATTERN)
    told = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    got = ids_of(coder, texts)
    assert got == [told.encode_ordinary(t) for t in texts]
    assert [coder.decode(g).decode() for g in got] == texts


def test_counts(spark, edges, none, library):
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(edges, VOCABULARY).collect())
    want = collections.Counter()
    for i, t, _ in EDGES:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want[i, len((t or "").encode()), n, n > 512] += 1
    assert got == want
    assert token_counts(none, VOCABULARY).count() == 0


def test_round_trip(spark, edges, none):
    coder = Backtracking(RANKS, P.PATTERN)
    told = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    want = collections.Counter()
    for i, t, _ in EDGES:
        ids = told.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert collections.Counter(map(tuple, round_trip(edges, RANKS, P.PATTERN).collect())) == want
    assert round_trip(none, RANKS, P.PATTERN).count() == 0
    back = decoded(encoded(edges, RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert sorted(bytes(r.data) for r in back.collect()) == sorted((t or "").encode() for _, t, _ in EDGES)


def test_token_files(spark, edges, none, library):
    folder = scratch(spark, "test-files")
    manifest, kind = write_token_files(edges, VOCABULARY, folder, end_id=2, length=64)
    got = sorted(read_token_files(manifest, kind).collect(), key=lambda r: r.start)
    assert [r.doc_id is None for r in got] == [True] + [False] * (len(EDGES) - 1)
    assert [r.doc_id for r in got[1:]] == sorted(i for i, _, _ in EDGES if i is not None)
    want = collections.Counter()
    for i, t, _ in EDGES:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    for row in manifest.collect():
        with TokenFile(row.tokens_path) as file:
            n = -(-row.n_tokens // 64)
            assert sum(file.sequence(i)[1].true_count for i in range(n)) == row.n_tokens
            ids, mask = file.sequence(n - 1)
            batch = file.held((n - 1) // 512)
            assert len(ids) == len(mask) == 64 and not ids.flags.owndata
            assert mask.buffers()[1].address == batch.column(1).flatten().buffers()[1].address  # the batch's own bits
            whole = np.concatenate([file.sequence(i)[0] for i in range(n)])[: row.n_tokens]
            assert np.concatenate(list(file.tokens(0, row.n_tokens))).tolist() == whole.tolist()
            del ids, mask, batch
    empty, kind = write_token_files(none, VOCABULARY, scratch(spark, "test-none"), end_id=2)
    assert read_token_files(empty, kind).count() == 0


def laid_out(rows, size):
    here = collections.defaultdict(list)
    for r in rows:
        here[r.sequence_id].append((r.offset, r.length))
    for v in here.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= size
    return len(here)


def test_packing(spark, edges, none, library):
    rows = packed(spark, edges, VOCABULARY, size=256, end_id=0).collect()
    n = laid_out(rows, 256)
    assert n <= 1.05 * -(-sum(r.length for r in rows) // 256) + 1
    text = dict((i, t) for i, t, _ in EDGES)
    for r in rows:
        ids = [*library.encode(text[r.doc_id] or "", add_special_tokens=False).ids, 0]
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        assert r.length == 256 or r.piece == 0
    assert packed(spark, none, VOCABULARY).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plans_hold_every_document(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(2048, np.maximum(1, rng.lognormal(5.5 + seed / 3, 1.2, 5000).astype(int)))
    counts = collections.Counter(lengths.tolist())
    plan = plan_of(dict(counts), 2048)
    ranks = collections.defaultdict(int)
    held = collections.Counter()
    for inside, many in (c for here in plan.free.values() for c in here):
        assert sum(s * k for s, k in inside) <= 2048
        for s, k in inside:
            held[s] += k * many
    assert held == counts
    for length, rank, *_ in plan.runs():
        assert rank == ranks[length] or rank > 0
    plain = linear_grouping(dict(counts), 2048, 1, large=2)
    assert plan.sequences() <= plain.sequences() * 1.01 + 1
