"""Quality rules with host verdicts, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.store import scratch, written

#: Fixed value: the characters that part words.
WHITE = " \t\n\x0b\x0c\r"


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed`` of every row; no shuffle.

    Windows of five words are compared by a 64-bit hash of the words' hashes (counts are exact but for collisions in a text's own windows); windows found twice are those
    next to their like in sorted order, and the words in them are counted from the gaps between their
    places, so a text costs n log n however often it repeats itself. Each array is a
    column of its own: used more than once, it is computed once.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), text.alias("text"))
    df = df.withColumn("bare", F.btrim("text", F.lit(WHITE)))
    df = df.select(
        "id", "host",
        F.when(F.col("bare") == "", F.array().cast("array<string>")).otherwise(F.split("bare", "[\\x20\\x09-\\x0D]+")).alias("words"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.when(F.instr("text", "\n") > 0, F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")).alias("lines"),
    )
    df = df.select(
        "id", "host", "n_symbols",
        F.size("words").alias("n"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.coalesce(F.size("lines") - F.size(F.array_distinct("lines")), F.lit(0)).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    window = lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(5)])
    df = df.withColumn("windows", F.when(F.col("n") > 5, F.transform(F.sequence(F.lit(0), F.col("n") - 5), window)))
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    df = df.withColumn("placed", F.when(repeats, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    size = F.size("placed") - 1
    twins = F.zip_with(F.slice("placed", 1, size), F.slice("placed", 2, size), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    df = df.withColumn("starts", F.array_sort(F.array_distinct(F.flatten(F.filter(twins, lambda x: x.isNotNull())))))
    gaps = F.zip_with("starts", F.slice("starts", 2, F.greatest(F.size("starts") - 1, F.lit(0))), lambda a, b: F.least(F.coalesce(b - a, F.lit(5)), F.lit(5)))
    df = df.withColumn("n_repeat_words", F.coalesce(F.aggregate(gaps, F.lit(0), lambda s, x: s + x), F.lit(0)).cast("long"))
    failed = (F.col("n") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n").cast("long"))
    return df.select("id", "host", F.col("n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))


def host_rates(rules: DataFrame) -> DataFrame:
    """``host, n_rows, n_failed, rate`` with the rate shrunk to an empirical beta prior.

    The prior's mean is the share of failures over all rows; its weight comes from how much the hosts'
    rates differ beyond chance (moments, hosts weighted by rows), held between 1 and 10,000 rows.
    """
    hosts = rules.groupBy("host").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    n, x = F.col("n_rows").cast("double"), F.col("n_failed").cast("double")
    sums = hosts.agg(F.sum(n).alias("n"), F.sum(x).alias("x"), F.sum(x * x / n).alias("xx"), F.sum(n * n).alias("nn"), F.count(F.lit(1)).alias("k"))
    mean = F.col("x") / F.col("n")
    spread = F.col("xx") - F.col("x") * mean  # between hosts, weighted
    inner = mean * (1 - mean)
    # Rates within a beta prior of weight w vary by inner / (w + 1); chance adds the rest of (k - 1) * inner.
    rho = (spread - (F.col("k") - 1) * inner) / (inner * (F.col("n") - F.col("nn") / F.col("n") - (F.col("k") - 1)))
    weight = F.when((inner > 0) & (F.col("k") > 1), F.least(F.greatest(1 / F.greatest(rho, F.lit(1e-9)) - 1, F.lit(1.0)), F.lit(10_000.0))).otherwise(F.lit(1.0))
    prior = sums.select(F.lit(1).alias("one"), mean.alias("mean"), F.coalesce(weight, F.lit(1.0)).alias("weight"))
    joined = hosts.withColumn("one", F.lit(1)).join(F.broadcast(prior), "one")  # the prior is one row
    rate = (F.col("n_failed") + F.col("mean") * F.col("weight")) / (F.col("n_rows") + F.col("weight"))
    return joined.select("host", "n_rows", "n_failed", rate.alias("rate"))


def quality_verdicts(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", host_limit: float = 0.5) -> DataFrame:
    """Rules of each row, its host's shrunk failure rate and the verdict: ``kept`` if neither row nor host fails.

    A host fails when its shrunk rate is above ``host_limit``. Null text has no words and so fails; null
    hosts are one host, together with the empty one; repeated rows count each; an empty table
    gives an empty result; further columns are not read. Texts are read once: the
    rules' figures are written, and hosts are summed map-side and joined back by a join that can be split.
    """
    rules = written(measured(docs, id_col, text_col, host_col), scratch(spark, "rules"))
    # Written, its size is known before the join is planned: a small table goes to the rows, a large one meets them in a join that adaptive execution splits.
    rates = written(host_rates(rules).select("host", F.col("rate").alias("host_rate")), scratch(spark, "host-rates"))
    out = rules.join(rates, "host", "left")
    kept = ~F.col("base_failed") & (F.col("host_rate") <= host_limit)
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rate", kept.alias("kept"))
