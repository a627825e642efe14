"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.store import relieved, small_batches, trimmed

#: Hash space of terms; latent factors.
SPACE, FACTORS = 1 << 20, 8


@dataclass(frozen=True)
class Limits:
    """What bounds the fit, whatever the tables hold; scoring has no bound.

    ``documents`` and ``characters``: labelled documents that the model is fitted on, at most (the first by hash of the id). ``terms``: terms that it
    weighs, at most, those farthest from chance; ``least_z``: a term must be so many standard errors away from its expected share of toxic documents.
    """

    documents: int = 16_000
    characters: int = 120_000_000
    terms: int = 2048
    least_z: float = 5.0


LIMITS = Limits()


def fold(id_column: Column) -> Column:
    """crc32 of the id as text, modulo 4; 2 is held out. A null id counts as empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 4


def terms(word: str) -> list[int]:
    """Hashes of a lower-case word and of its runs of five characters, edges marked."""
    bare = f"^{word.strip('.,;:!?()[]{}"\'`*#%&$<>|')}$"
    if len(bare) < 4:
        return []
    found = {bare, *(bare[i : i + 5] for i in range(len(bare) - 4))}
    return [zlib.crc32(t.encode()) % SPACE for t in found]


def words(text: str) -> set[str]:
    return set(text.lower().split())


@dataclass
class Machine:
    """Logistic factorization machine: bias + sum of weights + pairwise products of factors over the terms present."""

    bias: float
    weights: dict[int, int] = field(default_factory=dict)  # hash of a term -> row
    linear: object = None
    factors: object = None

    def __post_init__(self) -> None:
        self.known: dict[str, tuple[int, ...]] = {}

    def __getstate__(self):
        return {**self.__dict__, "known": {}}

    def rows(self, text: str) -> list[int]:
        known, weights, out = self.known, self.weights, set()
        if len(known) > 200_000:
            known.clear()
        for w in words(text):
            if (hit := known.get(w)) is None:
                hit = tuple(r for t in terms(w) if (r := weights.get(t)) is not None)
                if len(w) <= 80:
                    known[w] = hit
            if hit:
                out.update(hit)
        return sorted(out)

    def score(self, text: str) -> float:
        import math

        z = self.bias
        if rows := self.rows(text) if text and self.weights else []:
            v = self.factors[rows]
            s = v.sum(axis=0)
            z += float(self.linear[rows].sum()) + 0.5 * float((s * s - (v * v).sum(axis=0)).sum())
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def fit(texts: list[str], labels: list[int], limits: Limits = LIMITS, epochs: int = 12, rate: float = 0.03, ridge: float = 1e-4, seed: int = 7) -> Machine:
    """Choose terms by how far their share of toxic documents is from chance, then fit by Adam on logistic loss.

    Without documents of both labels the machine is a constant: the smoothed share of label 1.
    """
    import numpy as np

    n, pos = len(labels), sum(labels)
    share = (pos + 0.5) / (n + 1)
    bias = float(np.log(share / (1 - share)))
    if not pos or pos == n:
        return Machine(bias)
    seen, toxic, memo = np.zeros(SPACE, np.int32), np.zeros(SPACE, np.int32), {}
    for t, y in zip(texts, labels):
        found = []
        for w in words(t):
            if (h := memo.get(w)) is None:
                h = np.array(terms(w), dtype=np.int64)
                if len(memo) < 300_000:
                    memo[w] = h
            found.append(h)
        if found:
            at = np.unique(np.concatenate(found))
            seen[at] += 1
            if y:
                toxic[at] += 1
    memo.clear()
    q = pos / n
    z = (toxic - seen * q) / np.sqrt(np.maximum(seen * q * (1 - q), 1e-9))
    good = np.flatnonzero((seen >= 4) & (np.abs(z) >= limits.least_z))
    good = good[np.argsort(-np.abs(z[good]), kind="stable")][: limits.terms]
    model = Machine(bias, {int(t): i for i, t in enumerate(good)})
    if not len(good):
        return model
    docs = [np.array(model.rows(t), dtype=np.int64) for t in texts]
    model.known.clear()
    y = np.array(labels, dtype=np.float64)
    rng = np.random.default_rng(seed)
    params = [np.zeros(len(good)), rng.normal(0, 0.02, (len(good), FACTORS)), np.array([bias])]
    moments, step = [[np.zeros_like(p), np.zeros_like(p)] for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for k in range(0, n, 256):
            some = order[k : k + 256]
            sizes = np.array([len(docs[i]) for i in some])
            at, doc = np.concatenate([docs[i] for i in some]), np.repeat(np.arange(len(some)), sizes)
            w, v, b = params
            s = np.zeros((len(some), FACTORS))
            np.add.at(s, doc, v[at])
            zed = b[0] + np.bincount(doc, w[at], len(some)) + 0.5 * ((s * s).sum(axis=1) - np.bincount(doc, (v[at] ** 2).sum(axis=1), len(some)))
            err = (1 / (1 + np.exp(-np.clip(zed, -40, 40))) - y[some]) / len(some)
            gw, gv = ridge * w, 10 * ridge * v
            np.add.at(gw, at, err[doc])
            np.add.at(gv, at, err[doc][:, None] * (s[doc] - v[at]))
            step += 1
            for p, m, g in zip(params, moments, (gw, gv, np.array([err.sum()]))):
                m[0] += 0.1 * (g - m[0])
                m[1] += 0.001 * (g * g - m[1])
                p -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    model.linear, model.factors, model.bias = params[0], params[1], float(params[2][0])
    return model


def learned(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", limits: Limits = LIMITS) -> Machine:
    """Fit on at most ``limits.documents`` labelled documents outside the held-out fold, chosen by hash of their ids.

    Labels other than 0 and 1 and null ids are passed over. Only the chosen rows' texts reach the driver,
    one at a time, until ``limits.characters``.
    """
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("id").isNotNull() & (fold(F.col("id")) != 2))
    chosen = usable.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(limits.documents)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")  # at most ``limits.documents`` pairs of numbers
    rows = rows.select(F.xxhash64("id").alias("h"), "text", "y").orderBy("h", "text")
    texts, ys, size = [], [], 0
    for r in rows.toLocalIterator():
        texts.append(r["text"] or "")
        ys.append(r["y"])
        size += len(texts[-1])
        if size > limits.characters:
            break
    model = fit(texts, ys, limits)
    del texts
    trimmed()
    relieved(docs.sparkSession)
    return model


def toxicity_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame, limit: float = 0.3, id_col: str = "doc_id", text_col: str = "text", limits: Limits = LIMITS) -> DataFrame:
    """``id, held_out, score, predicted`` of every row, by its text alone; no shuffle.

    Null and empty texts get the bias's score; null ids and repeated rows are scored each; an empty
    table gives an empty result; without labels of both kinds every score is the same; columns other than id and text are not read.
    """
    import pyarrow as pa

    small_batches(spark)
    model = learned(docs, labels, id_col, text_col, limits=limits)
    src = docs.select(F.col(id_col), fold(F.col(id_col)).alias("fold"), F.col(text_col).alias("text"))

    def run(batches):
        from lectern.llm.units import forget

        forget()
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                scores = [model.score(t or "") for t in part.column(2).to_pylist()]
                held = pa.array([f == 2 for f in part.column(1).to_pylist()], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0), held, pa.array(scores, pa.float64()), pa.array([int(s >= limit) for s in scores], pa.int32())], [id_col, "held_out", "score", "predicted"])
        model.known.clear()  # the worker lives on

    kind = src.schema[0].dataType.simpleString()
    return src.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")


def without_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame, limit: float = 0.3, id_col: str = "doc_id", text_col: str = "text", limits: Limits = LIMITS) -> DataFrame:
    """The rows of ``docs`` that score below ``limit``, all columns as they were; no shuffle.

    Null and empty texts have the bias's score; rows without an id and repeated rows are judged each; an empty table gives an
    empty result; without labels of both kinds all rows have one score and stay or go together.
    """
    import pyarrow as pa

    small_batches(spark)
    model, at = learned(docs, labels, id_col, text_col, limits=limits), docs.columns.index(text_col)

    def run(batches):
        from lectern.llm.units import forget

        forget()
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                yield part.filter(pa.array([model.score(t or "") < limit for t in part.column(at).to_pylist()], pa.bool_()))
        model.known.clear()  # the worker lives on

    return docs.mapInArrow(run, docs.schema)
