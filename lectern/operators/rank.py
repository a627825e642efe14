"""Ranks, reciprocal-rank fusion, gates and the greedy token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the search.
FUSION, SCORE_LEAST, SCORE_LEAST_ALONE, DOMAIN_RATIO, CITATIONS = 60, 0.0005, 0.004, 0.175, 8
SEED_POOL, SEED_BEST, SEEDS, BUDGET, GATE = 12, 0.25, 8, 2000, 1.24


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def fused(candidates: DataFrame, query: str = "query_id", seq: str = "seq") -> DataFrame:
    """Add ``rank_distance``, ``rank_score`` and ``fusion`` to ``distance, score`` rows of each query."""
    by = Window.partitionBy(query)
    out = candidates.withColumn("rank_distance", F.row_number().over(by.orderBy("distance", seq)))
    out = out.withColumn("rank_score", F.row_number().over(by.orderBy(F.desc("score"), seq)))
    return out.withColumn("fusion", 1 / (FUSION + F.col("rank_distance")) + 1 / (FUSION + F.col("rank_score")))


def gated(candidates: DataFrame, query: str = "query_id", file: str = "file_id", least: float | Column = SCORE_LEAST) -> DataFrame:
    """Keep the rows of files whose best score reaches the ratio of the query's best, if any row of such a file passes ``least``."""
    of_file = F.greatest(F.max("score").over(Window.partitionBy(query, file)), F.lit(0.0))
    of_query = F.greatest(F.max("score").over(Window.partitionBy(query)), F.lit(0.0))
    out = candidates.withColumn("_file", of_file).withColumn("_all", of_query).withColumn("_near", F.col("_file") >= DOMAIN_RATIO * F.col("_all"))
    opens = F.max((F.col("_near") & (F.col("score") > least)).cast("int")).over(Window.partitionBy(query)) == 1
    return out.withColumn("_open", opens).filter("_open and _near").drop("_file", "_all", "_near", "_open")


def cited(candidates: DataFrame, query: str = "query_id", file: str = "file_id", seq: str = "seq", least: float | Column = SCORE_LEAST, most: int = CITATIONS) -> DataFrame:
    """Fusion over all candidates, gate, then the first rows by fusion."""
    kept = gated(fused(candidates, query, seq), query, file, least)
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("fusion"), "rank_distance", seq))
    return kept.withColumn("place", place).filter(F.col("place") <= most)


def seeds(candidates: DataFrame, query: str = "query_id", seq: str = "seq") -> DataFrame:
    """Seeds of each query from its pool: none unless the best score is over 0.25."""
    best = F.max("score").over(Window.partitionBy(query))
    kept = candidates.withColumn("_best", best).filter((F.col("_best") > SEED_BEST) & (F.col("score") > SCORE_LEAST) & (F.col("score") >= DOMAIN_RATIO * F.col("_best")))
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), seq))
    return kept.drop("_best").withColumn("place", place).filter(F.col("place") <= SEEDS)


def budgeted(rows: DataFrame, group: str, budget: int = BUDGET, least: float = SCORE_LEAST, seq: str = "seq") -> DataFrame:
    """Greedy choice by falling score: stop at the first score not over ``least``, pass over a description already
    taken and one that does not fit (R6). A group is a query's candidates, a few hundred rows."""
    items = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col(seq).alias("q"), "description", "tokens")))
    start = F.struct(F.lit(0).cast("long").alias("spent"), F.lit(False).alias("over"), F.array().cast("array<struct<s:double,q:bigint,description:string,tokens:bigint>>").alias("taken"))

    def step(a, x):
        over = a["over"] | (-x["s"] <= least)
        fits = ~over & ~F.exists(a["taken"], lambda t: t["description"] == x["description"]) & (a["spent"] + x["tokens"] <= budget)
        one = F.array(F.struct(x["s"].cast("double").alias("s"), x["q"].cast("long").alias("q"), x["description"].alias("description"), x["tokens"].cast("long").alias("tokens")))
        return F.struct((a["spent"] + F.when(fits, x["tokens"]).otherwise(0)).cast("long").alias("spent"), over.alias("over"), F.when(fits, F.concat(a["taken"], one)).otherwise(a["taken"]).alias("taken"))

    folded = rows.groupBy(group).agg(F.aggregate(items, start, step)["taken"].alias("taken"))
    return folded.select(group, F.posexplode("taken").alias("place", "t")).select(group, (F.col("place") + 1).alias("place"), F.col("t.q").alias(seq), (-F.col("t.s")).alias("score"), "t.description", "t.tokens")
