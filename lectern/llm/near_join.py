"""N-gram Jaccard join by signature trees.

A text is the set of its five-word shingles. Two sets that link (Jaccard at least 0.8) share
one of their first ``n // 5 + 1`` shingles in any one order of all shingles, so candidates meet at shared
prefix shingles; the order puts the shingles of very many documents last, and those seldom matter.
Where candidates meet, a signature tree finds links: a node holds the OR of its
documents' token bitmaps, the least and greatest set size below it and the most tokens that one of its bitmaps hides; a
dual traversal drops a pair of nodes when not even the greatest overlap its bitmaps allow, or no pair of its
sizes, can link, or when all below is one component already.

1. ``sets``: each text's size, digest, signature and prefix. Equal sets become one representative.
2. Blocks: each representative goes to the least representative with which it shares a prefix shingle.
   Blocks are dealt in parts of about ``part`` texts, each with the block's hub, and a tree joins each part.
3. The rest: prefix shingles that still touch two components. Their representatives' signatures meet in trees of about ``part``
   members; a shingle of more is dealt in bands of size and parts of bands, and two parts are joined tree
   against tree. Members of the component that has most of a shingle never meet each other. What the bounds allow is compared in full.
   A task names at most some pairs for each two components; a shingle of which more is left comes again, with its
   components as they are then, and with a larger number, until none is left. So no link between components is lost.
4. Links' components, the least id reachable, by alternating stars.

The plan is the same at every size. Nothing is broadcast but the list of common shingles, of ``COMMON`` numbers at most.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.store import dropped, scratch, small_batches, written

#: Texts in a part of a block, about. A shingle in more than one of so many documents is put last.
PART, RARE = 1000, 1000
#: Shingles that are put last, at most: the most frequent. Any order of shingles gives the same links.
COMMON = 1_000_000
#: Shingles in a part of a block, about (a part has a text at least).
PART_SHINGLES = 2_000_000
#: Bytes of text that are shingled at once.
SLICE = 1 << 22
#: Bits of a signature at most, so that a part's signatures stay small whatever its texts; wider sets hide more.
BITS = 1 << 15
#: Pairs that a task first names for each two components.
FIRST_PAIRS = 4


def needed(a, b):
    """Least overlap at which sets of these sizes link: 100 * i >= 80 * (a + b - i)."""
    return -((-4 * (a + b)) // 9)


def shingles(texts):
    """All five-word shingles of an Arrow array of texts in order, hashed, and what tells the texts apart: ``h, words, edges``.

    ``h[i]`` is the shingle that begins at word ``i``, whatever text its last word is in; text ``k`` has the words from ``edges[k]`` to ``edges[k + 1]``.
    """
    import numpy as np
    import pyarrow.compute as pc
    import xxhash

    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))))
    offsets = split.offsets.to_numpy()
    coded = split.flatten().dictionary_encode()
    told = coded.dictionary.to_pylist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, told), dtype="<u8", count=len(told))
    if "" in told:  # the one word of a text without words
        hashes[told.index("")] = 0
    w = hashes[coded.indices.to_numpy()] if len(told) else np.zeros(0, "<u8")
    h = w[: max(0, len(w) - 4)].copy()
    for k in range(1, 5):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += w[k : len(h) + k]
    return mixed(h), w, offsets - offsets[0]


def shingle_sets(texts):
    """The sorted distinct shingles of each of an Arrow array of texts; those of fewer words are one, those of none none."""
    import numpy as np

    h, w, edges = shingles(texts)
    edges = edges.tolist()
    for a, b in zip(edges, edges[1:]):
        if b - a >= 5:
            yield np.unique(h[a : b - 4])
        elif b - a == 0 or (b - a == 1 and not w[a]):
            yield np.zeros(0, "<u8")
        else:
            one = b - a
            for x in w[a:b].tolist():
                one = (one * 0x9E3779B97F4A7C15 + x) & 0xFFFFFFFFFFFFFFFF
            yield mixed(np.array([one], dtype="<u8"))


def mixed(h):
    import numpy as np

    for shift, by in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    return h ^ (h >> np.uint64(33))


def signature(tokens):
    """Bitmap of a set, of twice as many bits as tokens or more (up to ``BITS``), a power of two; a wider one folds onto a narrower."""
    import numpy as np

    bits = min(BITS, max(64, 1 << (2 * len(tokens) - 1).bit_length()))
    flags = np.zeros(bits, dtype=bool)
    flags[(tokens & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").view("<u8")


class Node:
    __slots__ = ("bits", "hidden", "kids", "items", "least", "most", "one")


class SignatureTree:
    """A tree over sets, and its join with itself: links enough to connect all that links connect."""

    FANOUT = 8

    def __init__(self, sets: list) -> None:
        import numpy as np

        self.sets, self.sizes = sets, [len(s) for s in sets]
        self.up = list(range(len(sets)))
        self.links: list[tuple[int, int]] = []
        sigs = [signature(s) for s in sets]
        words = max(map(len, sigs), default=1)
        order = sorted(range(len(sets)), key=lambda i: (int(sets[i][0]), self.sizes[i], i))
        level = []
        for i in order:  # one width for all: the widest, so a narrower bitmap is made anew
            bits = sigs[i]
            if len(bits) < words:
                flags = np.zeros(words * 64, dtype=bool)
                flags[(sets[i] & np.uint64(words * 64 - 1)).astype(np.int64)] = True
                bits = np.packbits(flags, bitorder="little").view("<u8")
            n = Node()
            n.bits, n.kids, n.items, n.least, n.most, n.one = bits, [], i, self.sizes[i], self.sizes[i], True
            n.hidden = self.sizes[i] - int(np.bitwise_count(bits).sum())
            level.append(n)
        while len(level) > 1:
            above = []
            for k in range(0, len(level), self.FANOUT):
                kids = level[k : k + self.FANOUT]
                n = Node()
                n.bits = np.bitwise_or.reduce([c.bits for c in kids])
                n.kids, n.items, n.one = kids, kids[0].items, False
                n.least, n.most = min(c.least for c in kids), max(c.most for c in kids)
                n.hidden = max(c.hidden for c in kids)
                above.append(n)
            level = above
        self.root = level[0] if level else None

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def joined(self, n: Node) -> bool:
        """Whether all below a node is one component; once true, true for good."""
        if not n.one:
            n.one = all(self.joined(c) for c in n.kids) and len({self.find(c.items) for c in n.kids}) == 1
        return n.one

    def may_link(self, x: Node, y: Node) -> bool:
        import numpy as np

        if 5 * x.most < 4 * y.least or 5 * y.most < 4 * x.least:
            return False
        reach = int(np.bitwise_count(x.bits & y.bits).sum()) + min(x.hidden, y.hidden)
        return min(reach, x.most, y.most) >= needed(x.least, y.least)

    def join(self) -> list[tuple[int, int]]:
        todo = [(self.root, self.root)] if self.root else []
        while todo:
            x, y = todo.pop()
            if x is y:
                if x.kids and not self.joined(x):
                    todo += [(a, b) for i, a in enumerate(x.kids) for b in x.kids[i + 1 :]]
                    todo += [(a, a) for a in x.kids]  # taken first, so that components are made from below
                continue
            if self.joined(x) and self.joined(y) and self.find(x.items) == self.find(y.items):
                continue
            if not self.may_link(x, y):
                continue
            if not x.kids and not y.kids:
                if linked(self.sets[x.items], self.sets[y.items]):
                    self.links.append((x.items, y.items))
                    self.up[self.find(x.items)] = self.find(y.items)
            elif not y.kids or (x.kids and x.most - x.least >= y.most - y.least):
                todo += [(c, y) for c in x.kids]
            else:
                todo += [(x, c) for c in y.kids]
        return self.links


def linked(a, b) -> bool:
    import numpy as np

    return len(np.intersect1d(a, b, assume_unique=True)) >= needed(len(a), len(b))


def common_shingles(src: DataFrame, n_docs: int, rare: int = RARE) -> list[int]:
    """Shingles that stand in the texts more often than once in ``rare`` documents, the ``COMMON`` most frequent of them
    at most, so they may be sent to all.

    A task tells of the shingles that are frequent in its own share: those whose bucket of a table of counts is full
    are counted one by one. What it leaves out only makes the order a little worse.
    """
    import pyarrow as pa

    def run(batches):
        import numpy as np

        from lectern.llm.units import forget, slices

        forget()
        bits = 1 << 20
        for batch in batches:
            for large in slices(batch):
                held = []
                for part in slices(large, 1, SLICE):
                    h, _, edges = shingles(part.column(1))
                    ends = edges[1:]
                    whole = np.ones(len(h), dtype=bool)
                    over = (ends[:, None] - np.arange(1, 5)).ravel()
                    whole[over[(over >= 0) & (over < len(h))]] = False
                    held.append(h[whole])
                h = np.concatenate(held)
                least = max(4, large.num_rows // (4 * rare))
                bucket = (h & np.uint64(bits - 1)).astype(np.int32)
                full = np.bincount(bucket, minlength=bits) >= least
                tokens, n = np.unique(h[full[bucket]], return_counts=True)
                tokens, n = tokens[n >= least], n[n >= least]
                if len(tokens):
                    yield pa.RecordBatch.from_arrays([pa.array(tokens.view("<i8")), pa.array(n)], ["token", "n"])

    sums = src.mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    often = sums.filter(F.col("n") * rare > n_docs).filter("n >= 16").orderBy(F.desc("n"), "token").limit(COMMON)
    return [r["token"] for r in often.select("token").collect()]


def sets_of(src: DataFrame, common: list[int]) -> DataFrame:
    """``id, n, digest, sig, prefix``: what the search needs of each text."""
    import numpy as np
    import pyarrow as pa

    last = np.sort(np.array(common, dtype="<i8").view("<u8"))

    def run(batches):
        import xxhash

        from lectern.llm.units import forget, slices

        forget()
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                rows = []
                for s in shingle_sets(part.column(1)):
                    n = len(s)
                    first = s
                    if n and len(last):
                        at = np.minimum(np.searchsorted(last, s), len(last) - 1)
                        often = last[at] == s
                        first = np.concatenate([s[~often], s[often]])
                    rows.append((n, xxhash.xxh3_128_digest(s.tobytes()), signature(s).tobytes() if n else b"", first[: n // 5 + 1].view("<i8") if n else []))
                n, digest, sig, prefix = zip(*rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))], ["id", "n", "digest", "sig", "prefix"])

    return src.mapInArrow(run, "id bigint, n bigint, digest binary, sig binary, prefix array<bigint>")


def block_links(texts: DataFrame) -> DataFrame:
    """Links within the parts of blocks; ``texts``: ``hub, part, id, text``."""
    import pyarrow as pa

    def run(batches):
        import numpy as np

        from lectern.llm.units import forget, slices

        forget()

        def rows():  # texts become sets as they come
            for batch in batches:
                for some in slices(batch, 3, SLICE):
                    for h, p, i, s in zip(*(some.column(c).to_pylist() for c in range(3)), shingle_sets(some.column(3))):
                        yield (h, p), i, s

        held, key = {}, None

        def done():
            ids = list(held)
            found = SignatureTree([held[i] for i in ids]).join()
            a, b = zip(*found) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array([ids[i] for i in a], pa.int64()), pa.array([ids[i] for i in b], pa.int64())], ["a", "b"])

        for k, i, s in rows():
            if k != key:
                if len(held) > 1:
                    yield done()
                held, key = {}, k
            held[i] = np.ascontiguousarray(s)
        if len(held) > 1:
            yield done()

    dealt = texts.repartition("hub", "part").sortWithinPartitions("hub", "part", "id")
    return dealt.mapInArrow(run, "a bigint, b bigint")


class Signatures:
    """Rows of a task's shingles, ``token, task, other, id, n, pos, comp, sig``, as arrays, and the pairs of them that may link."""

    #: Members below a lowest node of a tree; nodes below a higher one; words of bitmaps compared at once.
    LEAF, FANOUT, WORDS = 32, 8, 1 << 20

    def __init__(self, table) -> None:
        import numpy as np

        column = lambda name: table.column(name).combine_chunks()
        self.token, self.task, self.id, self.n, self.pos, self.comp = (column(c).to_numpy(zero_copy_only=False) for c in ("token", "task", "id", "n", "pos", "comp"))
        self.other = column("other").to_numpy(zero_copy_only=False).astype(bool)
        sig = column("sig")
        edges = np.frombuffer(sig.buffers()[1], "<i4")[sig.offset : sig.offset + len(sig) + 1].astype(np.int64)
        self.words = np.frombuffer(sig.buffers()[2] or b"", "u1", count=edges[-1])[edges[0] :].copy().view("<u8")
        self.at, self.width = (edges[:-1] - edges[0]) // 8, np.diff(edges) // 8

    def bits(self, rows, width: int):
        """The rows' bitmaps at this width; all rows have one width, which is no less."""
        import numpy as np

        own = int(self.width[rows[0]]) if len(rows) else width
        out = self.words[self.at[rows][:, None] + np.arange(own)]
        return out if own == width else np.bitwise_or.reduce(out.reshape(len(rows), own // width, width), axis=1)

    def possible(self, i, j):
        """Of pairs of rows those that components, sizes, places and bitmaps allow to link, with the overlap that they allow beyond the needed."""
        import numpy as np

        n, pos = self.n, self.pos
        ok = (self.comp[i] != self.comp[j]) & (4 * n[i] <= 5 * n[j]) & (4 * n[j] <= 5 * n[i])
        i, j = i[ok], j[ok]
        least = needed(n[i], n[j])
        ok = np.minimum(n[i] - pos[i], n[j] - pos[j]) >= least
        i, j, least = i[ok], j[ok], least[ok]
        spare = np.full(len(i), -1)
        kinds = self.width[i] * 65536 + self.width[j]
        for kind in np.unique(kinds):
            all_of = np.flatnonzero(kinds == kind)
            w = int(min(kind // 65536, kind % 65536))
            step = max(1, self.WORDS // int(max(kind // 65536, kind % 65536)))
            for k in range(0, len(all_of), step):
                some = all_of[k : k + step]
                x, y = self.bits(i[some], w), self.bits(j[some], w)
                hidden = np.minimum(n[i[some]] - np.bitwise_count(x).sum(axis=1, dtype=np.int64), n[j[some]] - np.bitwise_count(y).sum(axis=1, dtype=np.int64))
                spare[some] = np.bitwise_count(x & y).sum(axis=1, dtype=np.int64) + hidden - least[some]
        ok = spare >= 0
        return i[ok], j[ok], spare[ok]

    def tree(self, rows, width: int) -> list[dict]:
        """Levels of a signature tree over rows of one width, from its lowest nodes up; level 0 has the rows' order too."""
        import numpy as np

        bits = self.bits(rows, width)
        first = np.where(bits != 0, np.arange(width) * 64 + np.bitwise_count((bits & (~bits + np.uint64(1))) - np.uint64(1)), 1 << 40).min(axis=1)
        order = np.lexsort((self.n[rows], first))
        rows, bits = rows[order], bits[order]
        n = self.n[rows]
        level = {"bits": bits, "least": n, "most": n, "hidden": n - np.bitwise_count(bits).sum(axis=1, dtype=np.int64), "low": self.comp[rows], "high": self.comp[rows]}
        levels, fan = [], self.LEAF
        while not levels or len(level["least"]) > self.FANOUT:
            at = np.arange(0, len(level["least"]), fan)
            ends = np.append(at[1:], len(level["least"]))
            up = {"kids": (at, ends), "bits": np.bitwise_or.reduceat(level["bits"], at, axis=0)}
            for name, f in (("least", np.minimum), ("most", np.maximum), ("hidden", np.maximum), ("low", np.minimum), ("high", np.maximum)):
                up[name] = f.reduceat(level[name], at)
            levels.append(up)
            level, fan = up, self.FANOUT
        levels[0]["rows"] = rows
        return levels

    def may_link(self, x: dict, y: dict, i, j):
        """Which pairs of nodes may hold a link between components."""
        import numpy as np

        one = (x["low"][i] == x["high"][i]) & (y["low"][j] == y["high"][j]) & (x["low"][i] == y["low"][j])
        ok = ~one & (4 * x["least"][i] <= 5 * y["most"][j]) & (4 * y["least"][j] <= 5 * x["most"][i])
        at = np.flatnonzero(ok)
        step = max(1, self.WORDS // x["bits"].shape[1])
        for k in range(0, len(at), step):
            some = at[k : k + step]
            a, b = i[some], j[some]
            reach = np.bitwise_count(x["bits"][a] & y["bits"][b]).sum(axis=1, dtype=np.int64) + np.minimum(x["hidden"][a], y["hidden"][b])
            ok[some] = np.minimum(reach, np.minimum(x["most"][a], y["most"][b])) >= needed(x["least"][a], y["least"][b])
        return ok

    def dual(self, left: list[dict], right: list[dict]):
        """Dual traversal of two trees, or of one with itself: yields the pairs of rows that may link."""
        import numpy as np

        same, a, b = left is right, len(left) - 1, len(right) - 1
        i, j = (x.ravel() for x in np.meshgrid(np.arange(len(left[a]["least"])), np.arange(len(right[b]["least"])), indexing="ij"))
        if same:
            i, j = i[i <= j], j[i <= j]
        while True:
            ok = self.may_link(left[a], right[b], i, j)
            i, j = i[ok], j[ok]
            if a == b == 0:
                break
            down = a >= b, b >= a
            if down[0]:
                i, j = spread(*left[a]["kids"], i, j)
                a -= 1
            if down[1]:
                j, i = spread(*right[b]["kids"], j, i)
                b -= 1
            if same:
                i, j = i[i <= j], j[i <= j]
        step = max(1, self.WORDS // self.LEAF**2)
        for k in range(0, len(i), step):
            x, y = spread(*left[0]["kids"], i[k : k + step], j[k : k + step])
            y, x = spread(*right[0]["kids"], y, x)
            if same:
                x, y = x[x < y], y[x < y]
            yield self.possible(left[0]["rows"][x], right[0]["rows"][y])

    def within(self, a: int, b: int):
        """The pairs that may link of rows ``a`` to ``b``, one task's: of its own, or with its others if it has some."""
        import numpy as np

        rows, other = np.arange(a, b), self.other[a:b]
        sides = [rows[~other], rows[other]] if other.any() else [rows]
        made: dict = {}

        def tree(side: int, own: int, width: int) -> list[dict] | None:
            if (side, own, width) not in made:
                some = sides[side][self.width[sides[side]] == own]
                made[side, own, width] = self.tree(some, width) if len(some) else None
            return made[side, own, width]

        widths = np.unique(self.width[a:b]).tolist()
        for w in widths:
            for x, y in [(w, w), (w, 2 * w)] + ([(2 * w, w)] if len(sides) == 2 else []):
                left, right = tree(0, x, w), tree(len(sides) - 1, y, w)
                if left and right:
                    yield from self.dual(left, right)

    def small(self, edges):
        """The pairs that may link of all tasks of at most ``LEAF`` rows, each a tree of one node."""
        import numpy as np

        starts, ends = edges[:-1], edges[1:]
        few = ends - starts <= self.LEAF
        end = np.repeat(ends[few], (ends - starts)[few])
        i, j = spread(starts, ends, np.flatnonzero(few), np.flatnonzero(few))
        del j
        i, j = np.repeat(i, end - i - 1), pairs_after(i, end)
        mixed_task = np.bitwise_or.reduceat(self.other, starts) if len(starts) else np.zeros(0, bool)
        task = np.searchsorted(starts, i, side="right") - 1
        ok = ~mixed_task[task] | (self.other[i] != self.other[j])
        yield self.possible(i[ok], j[ok])

    def pairs(self, most: int):
        """``token, a, b`` of what may link, ``most`` pairs for each task and two components; a row without ``a`` and ``b`` says that a token has more."""
        import numpy as np

        new = np.flatnonzero((np.diff(self.token) != 0) | (np.diff(self.task) != 0)) + 1
        edges = np.concatenate([[0], new, [len(self.token)]])
        task = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        found = [*self.small(edges)]
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if b - a > self.LEAF:
                found += self.within(a, b)
        i, j, spare = (np.concatenate(x) for x in zip(*found))
        low, high = np.minimum(self.comp[i], self.comp[j]), np.maximum(self.comp[i], self.comp[j])
        order = np.lexsort((-spare, high, low, task[i]))
        i, j, low, high = i[order], j[order], low[order], high[order]
        if not len(i):
            return i, i, i, i
        head = np.concatenate([[True], (np.diff(task[i]) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)])
        rank = np.arange(len(i)) - np.maximum.accumulate(np.where(head, np.arange(len(i)), 0))
        kept = rank < most
        x, y = self.id[i[kept]], self.id[j[kept]]
        return self.token[i[kept]], np.minimum(x, y), np.maximum(x, y), np.unique(self.token[i[~kept]])


def spread(starts, ends, i, j):
    """Each ``i`` replaced by ``starts[i]`` up to ``ends[i]``, with its ``j``."""
    import numpy as np

    many = ends[i] - starts[i]
    first = np.cumsum(many) - many
    return np.repeat(starts[i] - first, many) + np.arange(many.sum()), np.repeat(j, many)


def pairs_after(i, end):
    """For each ``i`` the numbers after it up to its ``end``."""
    import numpy as np

    many = end - i - 1
    return np.repeat(i + 1 - (np.cumsum(many) - many), many) + np.arange(many.sum())


def dealt(members: DataFrame, part: int) -> DataFrame:
    """``members`` (``token, id, n, pos, comp``) with ``task, other``: which rows of a token meet.

    A token of at most ``part`` members is one task. Others' members fall into groups by size band and by whether they are of the component
    that has most of the token; groups into parts of about ``part``; each two parts that sizes allow to link, and that are not
    both of that component, are a task, the one's rows against the other's.
    """
    spark = members.sparkSession
    # Counts by component are sums, map-side first, whatever the token.
    counts = members.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("c"))
    big = counts.groupBy("token").agg(F.sum("c").alias("c"), F.max_by("comp", F.struct("c", "comp")).alias("most")).filter(F.col("c") > part).select("token", "most")
    big = written(big, scratch(spark, "hot-shingles"))
    plain = lambda df: df.select("token", F.lit(0).cast("bigint").alias("task"), F.lit(False).alias("other"), "id", "n", "pos", "comp")
    if big.isEmpty():
        return plain(members)
    few = members.join(big, "token", "left_anti")
    band = F.floor(F.log("n") / F.log(F.lit(1.25))).cast("int")
    many = members.join(big, "token").withColumn("kind", 2 * band + (F.col("comp") == F.col("most")).cast("int")).drop("most")
    kinds = many.groupBy("token", "kind").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("k"), F.min("n").alias("least"), F.max("n").alias("most"))
    kinds = written(kinds, scratch(spark, "hot-groups"))
    x, y = (kinds.select("token", *[F.col(c).alias(f"{side}_{c}") for c in kinds.columns[1:]]) for side in "xy")
    meets = x.join(y, "token").filter("x_kind <= y_kind and not (x_kind % 2 = 1 and y_kind % 2 = 1) and 4 * x_least <= 5 * y_most and 4 * y_least <= 5 * x_most")
    meets = meets.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("x_k") - 1)))
    meets = meets.withColumn("q", F.explode(F.sequence(F.when(F.col("x_kind") == F.col("y_kind"), F.col("p")).otherwise(0), F.col("y_k") - 1)))
    tasks = written(meets.select("token", "x_kind", "p", "y_kind", "q", F.xxhash64("x_kind", "p", "y_kind", "q").alias("task")), scratch(spark, "hot-tasks"))
    placed = many.join(kinds.select("token", "kind", "k"), ["token", "kind"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    own = placed.join(tasks.select("token", F.col("x_kind").alias("kind"), F.col("p").alias("part"), "task"), ["token", "kind", "part"])
    across = tasks.filter("x_kind != y_kind or p != q")
    other = placed.join(across.select("token", F.col("y_kind").alias("kind"), F.col("q").alias("part"), "task"), ["token", "kind", "part"])
    sides = [df.select("token", "task", F.lit(flag).alias("other"), "id", "n", "pos", "comp") for df, flag in ((own, False), (other, True))]
    return plain(few).union(sides[0]).union(sides[1])


def possible_pairs(members: DataFrame, signatures: DataFrame, most: int, part: int) -> DataFrame:
    """``token, a, b``: pairs of different components that may link; and tokens with more than ``most`` of a task's for two components, without a pair.

    A task holds the signatures of two parts at most, some of small tasks more.
    """
    import pyarrow as pa

    def run(batches):
        held = None

        def told(table):
            token, a, b, more = Signatures(table).pairs(most)
            if len(token) or len(more):
                whole = lambda x: pa.concat_arrays([pa.array(x, pa.int64()), pa.nulls(len(more), pa.int64())])
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(token, pa.int64()), pa.array(more, pa.int64())]), whole(a), whole(b)], ["token", "a", "b"])

        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                some = pa.Table.from_batches([batch.slice(k, 4096)])
                held = some if held is None else pa.concat_tables([held, some])
                keys = [held.column(c).to_numpy() for c in ("token", "task")]
                last = held.num_rows - 1
                new = (keys[0] != keys[0][last]) | (keys[1] != keys[1][last])
                whole = int(new.nonzero()[0][-1]) + 1 if new.any() else 0  # the last task may go on in the next batch
                if whole:
                    yield from told(held.slice(0, whole))
                    held = held.slice(whole)
        if held is not None and held.num_rows:
            yield from told(held)

    rows = dealt(members, part).join(signatures, "id").select("token", "task", "other", "id", "n", "pos", "comp", "sig")
    return rows.repartition("token", "task").sortWithinPartitions("token", "task").mapInArrow(run, "token bigint, a bigint, b bigint")


def confirmed(pairs: DataFrame, texts: DataFrame, path: str) -> DataFrame:
    """The pairs ``a, b`` whose whole sets link, written to ``path``."""
    import pyarrow as pa

    def to_sets(batches):
        from lectern.llm.units import slices

        for batch in batches:
            for part in slices(batch, batch.schema.get_field_index("text"), SLICE):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in shingle_sets(part.column(1))], pa.binary())], ["id", "tokens"])

    def compare(batches):
        import numpy as np

        for batch in batches:
            ok = [linked(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    spark = pairs.sparkSession
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    sets = texts.join(ids.hint("shuffle_hash"), "id", "left_semi").mapInArrow(to_sets, "id bigint, tokens binary")
    sets = written(sets, held := scratch(spark, "compared-sets"))
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("y")), "b")
    out = written(both.select("a", "b", "x", "y").mapInArrow(compare, "a bigint, b bigint"), path)
    dropped(spark, held)
    return out


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """``id, comp`` of every id in ``links`` (``a, b``): the least id reachable, by alternating large and small stars until no edge changes."""
    path = scratch(spark, "edges")
    edges = written(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("u < v").distinct(), path)
    while True:
        both = edges.select("v", "u").union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"))
        large = both.join(least, "v").filter("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).filter("u < v").distinct()
        small = large.groupBy("v").agg(F.min("u").alias("m"))
        stars = large.join(small, "v").select(F.explode(F.array(F.struct(F.col("v").alias("v"), F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e")).select("e.v", "e.u").filter("u < v").distinct()
        then = scratch(spark, "edges")
        stars = written(stars, then)
        if stars.count() == edges.count() and stars.join(edges, ["v", "u"], "left_anti").isEmpty():
            dropped(spark, path)
            return stars.groupBy("v").agg(F.min("u").alias("comp")).withColumnRenamed("v", "id")
        dropped(spark, path)
        edges, path = stars, then


def near_components(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part: int = PART, rare: int = RARE, first_pairs: int = FIRST_PAIRS) -> DataFrame:
    """``id, n_shingles, component_id`` of every row.

    Sets are compared by 64-bit hashes of shingles, equal sets by 128-bit digests. A null or empty text, or one
    without words, has no shingles and links with nothing. A row without an id links with nothing and has no component.
    Rows of one id and different texts share the id's component. Repeated rows stay rows. An empty table gives
    an empty result; columns other than id and text are not read. ``part``, ``rare`` and ``first_pairs`` change how work is dealt, never the result.
    """
    small_batches(spark)
    made: list[str] = []

    def kept(df: DataFrame, label: str) -> DataFrame:
        made.append(scratch(spark, label))
        return written(df, made[-1])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    full = written(sets_of(src, common_shingles(src, src.count(), rare)), whole := scratch(spark, "sets"))
    # Equal sets have equal prefixes, so a representative is made by sums alone, map-side first.
    some = full.filter(F.col("id").isNotNull() & (F.col("n") > 0))
    reps = some.groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("prefix").alias("prefix"))
    reps = written(reps, scratch(spark, "representatives"))
    sets = written(full.select("id", "n", "digest"), scratch(spark, "digests"))
    dropped(spark, whole)
    named = sets.filter(F.col("id").isNotNull() & (F.col("n") > 0))
    # Rows of one representative's id that hold other texts must not stand for it.
    twice = named.groupBy("id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("id")
    texts = src.filter(F.col("id").isNotNull())
    if not twice.isEmpty():
        differing = named.join(twice, "id").groupBy("id").agg(F.countDistinct("digest").alias("k")).filter("k > 1")
        if not differing.isEmpty():
            return _with_row_ids(spark, docs, id_col, text_col, part, rare, first_pairs)
        texts = texts.groupBy("id").agg(F.first("text").alias("text"))

    postings = reps.select("id", "n", F.posexplode("prefix").alias("pos", "token"))
    shared = postings.groupBy("token").agg(F.min("id").alias("hub"), F.max("id").alias("other")).filter("hub < other").select("token", "hub")
    shared = kept(postings.join(shared.hint("shuffle_hash"), "token"), "postings")
    blocks = kept(shared.groupBy("id").agg(F.min("hub").alias("hub"), F.first("n").alias("n")), "blocks")
    # Only blocks of several parts are looked up again; they are few, one in ``part`` texts at most or of very long ones.
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / part, F.sum("n") / PART_SHINGLES)).cast("int")
    wide = kept(blocks.groupBy("hub").agg(parts.alias("parts")).filter("parts > 1"), "wide-blocks")
    members = blocks.filter("id != hub").join(wide, "hub", "left").select("id", "hub", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("id"), F.col("parts"))).otherwise(0).cast("int").alias("part"))
    hubs = blocks.select("hub").distinct().join(wide, "hub", "left").select(F.col("hub").alias("id"), "hub", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    places = kept(members.union(hubs), "places")
    links = [kept(block_links(texts.join(places.hint("shuffle_hash"), "id").select("hub", "part", "id", "text")), "links")]

    found = components(spark, links[0])
    rest, most = shared.select("token", "id", "n", "pos"), first_pairs
    signatures = reps.select("id", "sig")
    while True:
        labelled = kept(rest.join(found.hint("shuffle_hash"), "id", "left").select("token", "id", "n", "pos", F.coalesce("comp", "id").alias("comp")), "labelled")
        torn = labelled.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x < y").select("token")
        torn = kept(labelled.join(torn.hint("shuffle_hash"), "token", "left_semi"), "torn")
        possible = kept(possible_pairs(torn, signatures, most, part), "pairs")
        pairs = possible.filter("a is not null").select("a", "b").distinct()
        if not pairs.isEmpty():
            made.append(scratch(spark, "more-links"))
            links.append(confirmed(pairs, texts, made[-1]))
            found = components(spark, reduce(DataFrame.union, links))
        more = possible.filter("a is null").select("token").distinct()
        if more.isEmpty():
            break
        rest, most = torn.join(more.hint("shuffle_hash"), "token", "left_semi").select("token", "id", "n", "pos"), 16 * most
    found = written(found, scratch(spark, "components"))
    dropped(spark, *made)
    of_sets = reps.join(found.hint("shuffle_hash"), "id", "left").select("digest", F.coalesce("comp", "id").alias("component"))
    out = sets.select("id", "n", F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("digest")).alias("digest")).join(of_sets.hint("shuffle_hash"), "digest", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def _with_row_ids(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, *dealing: int) -> DataFrame:
    """For tables in which one id has several texts: join by row, then give the rows of an id one component."""
    rows = written(docs.select(F.col(id_col).cast("long").alias("own"), F.col(text_col).alias("text")).withColumn("doc_id", F.monotonically_increasing_id()), scratch(spark, "rows"))
    found = near_components(spark, rows, "doc_id", "text", *dealing)
    known = written(found.join(rows.select("doc_id", "own"), "doc_id"), scratch(spark, "row-components"))
    links = known.filter("own is not null").select(F.col("own").alias("a"), (-1 - F.col("component_id")).alias("b"))
    comp = components(spark, links)  # ids of components lie below zero, and so do the least ids: taken back to own ids below
    least = comp.join(known.select(F.col("own").alias("id")).distinct(), "id").groupBy("comp").agg(F.min("id").alias("least"))
    named = comp.join(least, "comp").select("id", "least")
    return known.join(named, known["own"] == named["id"], "left").select(F.col("own").alias(id_col), "n_shingles", F.col("least").alias("component_id"))
