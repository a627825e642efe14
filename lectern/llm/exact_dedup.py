"""Exact duplicates by distributed most-significant-digit radix partitioning.

A text's radix string is its length followed by its bytes. Each round splits every open group by
the next digit (first the length and a few bytes, then ever wider runs of bytes) and drops the digit; a
group is over when it has one row or no bytes are left. Equality is that of the bytes: no digest is compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.store import dropped, scratch, written

#: Bytes of the first digit, the second, and so on; the last width serves for all further rounds.
WIDTHS = (32, 256, 4096, 65_536, 1 << 20, 1 << 24)


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", "")


def exact_groups(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, keep_id, group_size, kept, text_sha256`` of every row.

    Of equal texts the row with the most code points in its original text stays, then that with the
    smallest id (null ids last). Null, empty and all-white texts are equal. Rows repeated in all
    of this share one decision: each is kept if it is alike to the row that stays, but
    only the first by id; as ids are unique, that is one row. An empty table gives an empty result. Other columns are not read.

    A group is counted with map-side sums, and its rows only ever meet in joins that can be
    split, so a group of any size is no task's burden. Rows that are alone leave at the first round; the texts of
    the others are moved once a round, less the bytes already compared.
    """
    text = F.col(text_col)
    order = F.struct((-F.col("points")).alias("p"), F.col("id").isNull().alias("z"), F.col("id").alias("id"))
    first = docs.select(F.col(id_col).alias("id"), F.length(F.coalesce(text, F.lit(""))).alias("points"), normalised(text).alias("plain"))
    first = first.select("id", "points", F.sha2(F.col("plain").cast("binary"), 256).alias("sha"), F.octet_length("plain").alias("gid"), F.col("plain").cast("binary").alias("rest"))
    state, done = first.withColumn("gid", F.col("gid").cast("long")), None
    at = 0
    while True:
        width = WIDTHS[min(at, len(WIDTHS) - 1)]
        digit = F.substring("rest", 1, width)
        keys = state.groupBy("gid", digit.alias("digit")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("best")).filter("n > 1")
        keys = written(keys.select("gid", "digit", "n", F.col("best.id").alias("best"), F.monotonically_increasing_id().alias("next")), used := scratch(spark, "radix-keys"))
        keys = keys.withColumnRenamed("gid", "key_gid").withColumnRenamed("digit", "key_digit")
        joined = state.join(keys.hint("shuffle_hash"), (F.col("gid") == F.col("key_gid")) & (digit == F.col("key_digit")), "left")
        open_ = F.col("next").isNotNull() & (F.octet_length("rest") > width)
        moved = joined.select(
            "id", "points", "sha",
            F.when(open_, F.col("next")).alias("gid"),
            F.when(open_, F.expr(f"substring(rest, {width + 1})")).alias("rest"),
            F.when(F.col("next").isNull(), F.col("id")).otherwise(F.col("best")).alias("keep_id"),
            F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        )
        state = written(moved, scratch(spark, "radix-state"))
        dropped(spark, used)
        over = state.filter(F.col("gid").isNull()).select("id", "keep_id", "group_size", "sha")
        done = over if done is None else done.unionByName(over)
        state = state.filter(F.col("gid").isNotNull()).select("id", "points", "sha", "gid", "rest")
        at += 1
        if state.isEmpty():
            break
    return done.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))
