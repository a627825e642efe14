"""Best-fit packing by linear grouping.

Documents are cut into pieces of at most ``size`` tokens. How often each length occurs is all that
the plan needs, and there are at most ``size`` lengths whatever the corpus holds, so the driver plans on
counts: large lengths are put in groups of equal cardinality and rounded up to the largest of
their group; the few rounded sizes make a small configuration problem, solved by column generation;
actual lengths take the places of the rounded ones; the rest and the small lengths go best-fit into what is
left. The plan is a short table of runs (``length``, ranks, sequence, place), and each piece finds its
sequence by its rank among the pieces of its length.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.store import scratch, small_batches, written
from lectern.llm.units import library_ids, slices

#: Groups of large lengths; from this share of a sequence on, a length is large.
GROUPS, LARGE = 48, 0.125


def groups_of(counts: dict[int, int], k: int) -> list[list[tuple[int, int]]]:
    """Lengths, longest first, in ``k`` runs of the same number of documents; a length may lie in two."""
    total = sum(counts.values())
    edges = [total * g // k for g in range(1, k + 1)]
    out, run, seen, g = [], [], 0, 0
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            while g < k - 1 and edges[g] <= seen:
                if run:
                    out.append(run)
                    run = []
                g += 1
            take = min(n, edges[g] - seen)
            run.append((length, take))
            seen += take
            n -= take
    return [*out, run] if run else out


def best_configuration(sizes: list[int], values, size: int) -> tuple[float, list[int]]:
    """The fill of one sequence that is worth most: an unbounded knapsack over the few sizes."""
    import numpy as np

    best, took = np.zeros(size + 1), np.full(size + 1, -1)
    for i, s in enumerate(sizes):
        if values[i] <= 1e-12:
            continue
        for at in range(s, size + 1):
            if (v := best[at - s] + values[i]) > best[at] + 1e-12:
                best[at], took[at] = v, i
    at = int(np.argmax(best))
    value, made = float(best[at]), [0] * len(sizes)
    while at > 0 and took[at] >= 0:
        made[took[at]] += 1
        at -= sizes[took[at]]
    return value, made


def configurations(sizes: list[int], demand: list[int], size: int, rounds: int = 150) -> list[tuple[list[int], int]]:
    """Few-size cutting stock by column generation; whole multiples, rounded down, and their configurations."""
    import numpy as np

    n = len(sizes)
    basis = np.diag([float(size // s) for s in sizes])
    need = np.array(demand, dtype=float)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        value, new = best_configuration(sizes, inverse.sum(axis=0), size)
        if value <= 1 + 1e-7:
            break
        x, d = inverse @ need, inverse @ np.array(new, dtype=float)
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = new
    x = np.linalg.inv(basis) @ need
    return [([int(round(v)) for v in basis[:, j]], max(0, int(x[j] + 1e-6))) for j in range(n)]


class Plan:
    """Classes of alike sequences: what is in one (``length, copies`` in order), how much is free, how many there are."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.free: dict[int, list[list]] = defaultdict(list)

    def add(self, inside: list[tuple[int, int]], many: int) -> None:
        if many:
            self.free[self.size - sum(s * k for s, k in inside)].append([inside, many])

    def best_fit(self, length: int, n: int) -> None:
        """Put ``n`` documents of a length each into the fullest sequence that takes it."""
        room = length
        while n and room <= self.size:
            if not (here := self.free.get(room)):
                room += 1
                continue
            inside, many = here[-1]
            each = min(room // length, n)
            use = min(many, n // each)
            here[-1][1] -= use
            if not here[-1][1]:
                here.pop()
            self.add([*inside, (length, each)], use)
            n -= use * each
        if n:
            each = self.size // length
            self.add([(length, each)], n // each)
            self.add([(length, n % each)], 1 if n % each else 0)

    def runs(self) -> list[tuple[int, int, int, int, int]]:
        """``length, first rank, copies in a sequence, first sequence, place`` of each run of alike sequences."""
        out, ranks, sequence = [], defaultdict(int), 0
        for room in sorted(self.free):
            for inside, many in self.free[room]:
                at = 0
                for length, k in inside:
                    out.append((length, ranks[length], k, sequence, at))
                    ranks[length] += k * many
                    at += length * k
                sequence += many
        return sorted(out)

    def sequences(self) -> int:
        return sum(many for here in self.free.values() for _, many in here)


def linear_grouping(counts: dict[int, int], size: int, groups: int, large: float = LARGE) -> Plan:
    """Plan for so many documents of each length (1 to ``size``)."""
    plan, rest = Plan(size), dict(counts)
    plan.add([(size, 1)], rest.pop(size, 0))
    big = {s: n for s, n in rest.items() if s >= size * large}
    runs = groups_of(big, max(1, min(groups, len(big)))) if big else []
    sizes: dict[int, list[tuple[int, int]]] = {}
    for run in runs:  # a group's size is its largest length; groups of one size are one
        sizes.setdefault(run[0][0], []).extend(run)
    if sizes:
        tops = list(sizes)
        chosen = configurations(tops, [sum(n for _, n in sizes[t]) for t in tops], size)
        pools = [list(reversed(sizes[t])) for t in tops]  # taken from the end: longest first
        for made, many in chosen:
            slots = [i for i, k in enumerate(made) for _ in range(k)]
            while many and slots and all(pools[i] for i in slots):
                want = {i: slots.count(i) for i in slots}
                step = min([many, *(pools[i][-1][1] // k for i, k in want.items())])
                if step:
                    inside = [(pools[i][-1][0], k) for i, k in want.items()]
                    for i, k in want.items():
                        take(pools[i], step * k)
                else:  # a run ends within one sequence: take its places one by one
                    if any(sum(n for _, n in pools[i]) < k for i, k in want.items()):
                        break
                    step, one = 1, defaultdict(int)
                    for i in slots:
                        one[pools[i][-1][0]] += 1
                        take(pools[i], 1)
                    inside = list(one.items())
                plan.add(merged(inside), step)
                many -= step
        for s in big:
            rest.pop(s)
        for pool in pools:
            for s, n in pool:
                rest[s] = rest.get(s, 0) + n
    for s in sorted(rest, reverse=True):
        plan.best_fit(s, rest[s])
    return plan


def take(pool: list[tuple[int, int]], n: int) -> None:
    s, have = pool.pop()
    if have > n:
        pool.append((s, have - n))


def merged(inside: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: dict[int, int] = defaultdict(int)
    for s, k in inside:
        out[s] += k
    return list(out.items())


def plan_of(counts: dict[int, int], size: int) -> Plan:
    """The best of three numbers of groups; all plans come from the counts alone."""
    return min((linear_grouping(counts, size, g) for g in (GROUPS // 4, GROUPS // 2, GROUPS)), key=Plan.sequences)


def pieces_of(docs: DataFrame, vocabulary: str, size: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, piece, start, length, ids_crc32`` and, for the packing, ``task`` and ``rank`` (among the task's pieces of the length)."""
    import pyarrow as pa

    small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    names = [id_col, "piece", "start", "length", "ids_crc32", "task", "rank"]

    def run(batches):
        import zlib

        import numpy as np
        from pyspark import TaskContext

        coder, task, seen = library_ids(vocabulary), TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            for some in slices(batch, 1, 12 << 20):
                rows, (flat, ends) = [], coder.encode(some.column(1))
                edges = ends + np.arange(len(ends))
                flat = np.insert(flat.astype("<u4"), ends[1:], end_id)
                for i, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
                    ids = flat[a:b]
                    first = len(ids) if len(ids) <= size else len(ids) % size or size
                    for piece, at in enumerate([0, *range(first, len(ids), size)]):
                        part = ids[at : at + size] if at else ids[:first]
                        rows.append((i, piece, at, len(part), zlib.crc32(part), task, seen[len(part)]))
                        seen[len(part)] += 1
                if rows:
                    at, *others = zip(*rows)
                    yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(at, pa.int64())), pa.array(others[0], pa.int32()), *(pa.array(c, pa.int64()) for c in others[1:])], names)

    kind = src.schema[0].dataType.simpleString()
    return src.mapInArrow(run, f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, task bigint, rank bigint")


def packed(spark: SparkSession, docs: DataFrame, vocabulary: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, piece, start, length, ids_crc32, sequence_id, offset`` of every piece.

    The driver gets one row for each length (``size`` at most). A null or empty text is the end id
    alone; null ids and repeated rows are packed each; an empty table gives an empty result; other
    columns are not read. Ties go by task and place in it, fixed once the pieces are written.
    """
    import pyarrow as pa

    pieces = written(pieces_of(docs, vocabulary, size, end_id, id_col, text_col), scratch(spark, "pieces"))
    by_task = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_task.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("task", "length", "base")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = plan_of(counts, size).runs()
    places: dict[int, tuple[list, list]] = {}
    for length, rank, k, sequence, at in runs:
        ranks, told = places.setdefault(length, ([], []))
        ranks.append(rank)
        told.append((rank, k, sequence, at))

    def place(batches):
        for batch in batches:
            length, rank = batch.column("length").to_pylist(), batch.column("rank").to_pylist()
            sequences, offsets = [], []
            for s, r in zip(length, rank):
                ranks, told = places[s]
                first, k, sequence, at = told[bisect_right(ranks, r) - 1]
                sequences.append(sequence + (r - first) // k)
                offsets.append(at + (r - first) % k * s)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64())], [*batch.schema.names[:5], "sequence_id", "offset"])

    ranked = pieces.join(bases, ["task", "length"]).select(id_col, "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank"))
    kind = pieces.schema[0].dataType.simpleString()
    return ranked.mapInArrow(place, f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
