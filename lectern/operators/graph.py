"""Node and edge relations: degree, weights, traversal, upsert, mention pairing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import entity_valid, enumerates, node_name
from lectern.operators.vector import first_in, l2

#: Characters between two mentions of one relation, at most; seeds and edges of a traversal.
GAP, SEEDS, PER_SEED = 60, 24, 32


def degree(edges: DataFrame, source: str = "source_normalized", target: str = "target_normalized") -> DataFrame:
    """``name, degree``: distinct neighbours over both directions. Pairs are made distinct before they are counted."""
    a = edges.select(F.col(source).alias("name"), F.col(target).alias("other"))
    b = edges.select(F.col(target).alias("name"), F.col(source).alias("other"))
    return a.unionByName(b).distinct().groupBy("name").agg(F.count("other").alias("degree"))


def edge_weight(edges: DataFrame, source: str = "source_normalized", target: str = "target_normalized", description: str = "description") -> DataFrame:
    """``a, b, weight, description``: undirected pairs, how many, and the longest description (the least of equals)."""
    longest = F.min_by(F.col(description), F.struct(-F.length(description), F.col(description)))
    return edges.groupBy(F.least(source, target).alias("a"), F.greatest(source, target).alias("b")).agg(F.count(F.lit(1)).alias("weight"), longest.alias("description"))


def known_edges(edges: DataFrame, nodes: DataFrame, a: str = "a", b: str = "b", name: str = "name") -> DataFrame:
    """Edges with both ends among the nodes."""
    names = nodes.select(F.col(name).alias("_n")).distinct()
    return edges.join(names, F.col(a) == F.col("_n"), "left_semi").join(names, F.col(b) == F.col("_n"), "left_semi")


def longest_per(rows: DataFrame, by: list[str], text: str, id_col: str) -> DataFrame:
    """The row with the longest text of each group, ties by id."""
    return first_in(rows, by, [-F.length(text), F.col(id_col)])


def node_detail(nodes: DataFrame, names: list[str] | DataFrame, files: DataFrame | None = None) -> DataFrame:
    """``name_normalized, name, type, description, id`` of the named nodes, each by its longest description.

    ``names`` are a short list or a table ``name_normalized``; with ``files`` (``file_id``) only their nodes count.
    """
    some = nodes.filter(F.col("name_normalized").isin(names) if names else F.lit(False)) if isinstance(names, list) else nodes.join(names.select("name_normalized"), "name_normalized", "left_semi")
    some = some if files is None else some.join(files.select("file_id"), "file_id", "left_semi")
    return longest_per(some.select("name_normalized", "name", "type", "description", "id"), ["name_normalized"], "description", "id")


def entity_first(mentions: DataFrame) -> DataFrame:
    """The first mention of each name in a chunk (``chunk_id, name, start`` and more), of those that may be entities; adds ``normal``."""
    valid = mentions.filter(entity_valid(F.col("name"))).withColumn("normal", node_name(F.col("name")))
    return first_in(valid, ["chunk_id", "normal"], ["start"])


def upserted(nodes: DataFrame, by: list[str], seq: str = "seq") -> DataFrame:
    """Insert order decides: name and type of the first row, description of the first that has one."""
    order = F.col(seq)
    filled = F.when(F.col("description") != "", order)
    return nodes.groupBy(*by).agg(F.min_by("name", order).alias("name"), F.min_by("type", order).alias("type"), F.coalesce(F.min_by("description", filled), F.lit("")).alias("description"))


def traverse(edges: DataFrame, edge_vectors: DataFrame, query: Column, seed_names: list[str], source: str = "source_normalized", target: str = "target_normalized") -> DataFrame:
    """Edges that touch a seed, one of each directed pair (the nearest), nearest first, 32 a seed."""
    names = seed_names[:SEEDS]
    near = edges.filter(F.col(source).isin(names) | F.col(target).isin(names)).join(edge_vectors.select(F.col("edge_id").alias("id"), "embedding"), "id")
    near = near.withColumn("distance", l2(F.col("embedding"), query)).drop("embedding")
    return first_in(near, [source, target], ["distance", "id"]).orderBy("distance", "id").limit(PER_SEED * max(1, len(names)))


def relation_pairs(mentions: DataFrame, places: bool = False) -> DataFrame:
    """``chunk_id, sentence, source, target`` from ``chunk_id, sentence, start, stop, name, between``; with ``places`` also where both begin, ``source_at, target_at``.

    ``between`` is the text from the mention before. A mention within 60 characters, of which what is between only enumerates,
    goes on with its group; one that something else parts from the group is the target of an edge
    from every member of it. Names alike make no edge; a directed pair is kept once a chunk, first sentence first.
    """
    line = Window.partitionBy("chunk_id", "sentence").orderBy("start")
    gap = F.col("start") - F.lag("stop").over(line)
    near = F.coalesce(gap.between(0, GAP), F.lit(False))
    df = mentions.withColumn("_near", near).withColumn("_list", enumerates(F.col("between")))
    df = df.withColumn("_island", F.sum((~(F.col("_near") & F.col("_list"))).cast("int")).over(line))
    links = df.filter(F.col("_near") & ~F.col("_list")).select("chunk_id", "sentence", (F.col("_island") - 1).alias("_island"), F.col("name").alias("target"), F.col("start").alias("_at"))
    pairs = df.select("chunk_id", "sentence", "_island", F.col("name").alias("source"), F.col("start").alias("_from")).join(links, ["chunk_id", "sentence", "_island"]).filter("source != target")
    first = first_in(pairs, ["chunk_id", "source", "target"], ["sentence", "_from", "_at"])
    return first.select("chunk_id", "sentence", "source", "target", *([F.col("_from").alias("source_at"), F.col("_at").alias("target_at")] if places else []))
