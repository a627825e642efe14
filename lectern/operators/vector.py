"""Exact nearest neighbours by L2 distance (W1, W2, W4), all in built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance in double."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, d: s + d))


def knn(rows: DataFrame, query: Column, k: int, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows to one vector; ties by id; rows without a vector are none. Plans as a top-k per task and one merge."""
    return rows.filter(F.col(vector_col).isNotNull()).withColumn("distance", l2(F.col(vector_col), query)).orderBy("distance", id_col).limit(k)


def first_in(rows: DataFrame, by: list[str], order: list[Column | str]) -> DataFrame:
    """One row of each group, the first in order: DISTINCT ON. Map-side first, so a group of any size is cheap to send."""
    kept = [c for c in rows.columns if c not in by]
    best = rows.groupBy(*by).agg(F.min_by(F.struct(*kept), F.struct(*order)).alias("_first"))
    return best.select(*by, "_first.*").select(rows.columns)


def nearest_per_group(rows: DataFrame, query: Column, group: str, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """The nearest row of each group (W2), without a window over whole groups; rows without a vector are none."""
    return first_in(rows.filter(F.col(vector_col).isNotNull()).withColumn("distance", l2(F.col(vector_col), query)), [group], ["distance", id_col])


#: Queries that are sent to all tasks at once, at most; more go in blocks of so many.
BLOCK = 2048


def batch_knn(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """The ``k`` nearest rows for each of a stated set of queries (``query_id, query_vector``), with ``distance`` and ``rank``; ties by id, rows without a vector are none.

    The queries are sent in blocks of ``block`` at most, each against all rows. Distances are taken batch by batch on whole arrays, and a
    batch keeps its ``k`` nearest for each query, so what is shuffled is ``k`` rows a query and batch.
    """
    blocks = -(-queries.count() // block) or 1
    near = []
    for b in range(blocks):
        some = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        near.append(_near(rows, some, k, id_col, vector_col))
    out = reduce(DataFrame.unionByName, near)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", id_col))).filter(F.col("rank") <= k)


def batch_nearest(rows: DataFrame, queries: DataFrame, group: str, id_col: str = "id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """The nearest row of each group for each of a stated set of queries, with ``distance``; as ``batch_knn``, a batch keeping one row a query and group."""
    blocks = -(-queries.count() // block) or 1
    near = [_near(rows, queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b), 1, id_col, vector_col, group) for b in range(blocks)]
    return first_in(reduce(DataFrame.unionByName, near), ["query_id", group], ["distance", id_col])


def _near(rows: DataFrame, queries: DataFrame, k: int, id_col: str, vector_col: str, group: str | None = None) -> DataFrame:
    """Of each batch of rows the ``k`` nearest to each query, or with ``group`` the nearest of each group."""
    import numpy as np
    import pyarrow as pa

    held = queries.select("query_id", "query_vector").filter("query_vector is not null").toArrow()  # one block
    names = held.column("query_id").combine_chunks()
    wanted = np.array(held.column("query_vector").to_pylist(), dtype=float)
    kept = [c for c in rows.columns if c != vector_col]
    src = rows.filter(F.col(vector_col).isNotNull()).select(*kept, vector_col)

    def run(batches):
        for batch in batches:
            if not batch.num_rows or not len(names):
                continue
            order = np.argsort(batch.column(kept.index(id_col)).to_numpy(zero_copy_only=False), kind="stable")
            have = np.array(batch.column(len(kept)).to_pylist(), dtype=float)[order]
            groups = None if group is None else batch.column(kept.index(group)).dictionary_encode().indices.to_numpy(zero_copy_only=False)[order]
            picked, query, told = [], [], []
            for q in range(len(names)):
                d = np.sqrt(((have - wanted[q]) ** 2).sum(axis=1))
                first = np.argsort(d, kind="stable")
                first = first[:k] if groups is None else first[np.sort(np.unique(groups[first], return_index=True)[1])]
                picked.append(order[first])
                told.append(d[first])
                query.append(np.full(len(first), q))
            rows_at = pa.array(np.concatenate(picked))
            columns = [names.take(pa.array(np.concatenate(query))), *(batch.column(c).take(rows_at) for c in range(len(kept))), pa.array(np.concatenate(told))]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", *kept, "distance"])

    fields = [f"`query_id` {queries.schema['query_id'].dataType.simpleString()}", *(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept), "distance double"]
    return src.mapInArrow(run, ", ".join(fields))
