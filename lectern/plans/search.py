"""Ingest of files and hybrid search over a tenant's tables."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.text import anchor_impossible, anchored, entity_valid, node_name, stripped, token_estimate
from lectern.models import Embedder, Reranker, Tagger
from lectern.operators import chunk, graph, rank, records
from lectern.operators.vector import batch_knn, first_in, knn, l2, nearest_per_group
from lectern.sources.store import Store

POOL, NODE_POOL, NODES, SHORTEST = 24, 12, 8, 3
#: The distance of a chunk without a vector: that of opposite unit vectors.
FURTHEST = 2.0


def embedded(rows: DataFrame, text: Column, model: Embedder, mode: str = "document") -> DataFrame:
    """``rows`` with ``embedding``: the model runs once a batch of rows, in the tasks."""
    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series(model.embed(mode, texts.fillna("").tolist()))

    return rows.withColumn("embedding", embed(text))


def scored(rows: DataFrame, prompt: str | dict[int, str], text: Column, model: Reranker) -> DataFrame:
    """``rows`` with ``score``: how well ``text`` answers the prompt, or that of the row's ``query_id``."""
    prompts = prompt if isinstance(prompt, dict) else {0: prompt}

    @F.pandas_udf("double")
    def score(queries: pd.Series, texts: pd.Series) -> pd.Series:
        out = pd.Series(0.0, index=texts.index)
        for q, some in texts.fillna("").groupby(queries):
            out.loc[some.index] = model.score(prompts[q], some.tolist())
        return out

    return rows.withColumn("score", score(F.col("query_id") if isinstance(prompt, dict) else F.lit(0), text))


PIECES = "file_id long, kind string, chunk_id long, chunk string"
MENTIONS = "file_id long, chunk_id long, sentence int, start int, stop int, name string, label string, description string, between string"


def pieces(texts: DataFrame) -> DataFrame:
    """Chunks of whole files (``file_id, name, text``): ``kind`` is citation or relation, or both for a spreadsheet's, which are cut by rows."""
    def run(batches):
        for batch in batches:
            for file_id, name, text in zip(batch["file_id"], batch["name"], batch["text"]):
                plain = chunk.primary_text(unicodedata.normalize("NFKC", text))
                if name.lower().endswith(".xlsx"):
                    made = [("both", i, c) for i, c in enumerate(chunk.table_chunks(name, plain))]
                else:
                    made = [("citation", i, c) for i, c in enumerate(chunk.citation_chunks(plain))]
                    made += [("relation", i, c) for i, c in enumerate(chunk.relation_chunks(plain))] if made else []
                yield pd.DataFrame([(file_id, *m) for m in made], columns=["file_id", "kind", "chunk_id", "chunk"])

    return texts.select("file_id", "name", "text").mapInPandas(run, PIECES)


def mentions_of(chunks: DataFrame, tagger: Tagger) -> DataFrame:
    """Entities of each chunk (``file_id, chunk_id, chunk``), placed in its sentences; ``between`` is the text since the mention before."""
    def run(batches):
        for batch in batches:
            rows = []
            for file_id, chunk_id, text in zip(batch["file_id"], batch["chunk_id"], batch["chunk"]):
                held, last = chunk.sentences(text), {}
                for start, stop, label, _ in tagger.tag(text):
                    k = next((i for i, (_, a, b) in enumerate(held) if a <= start < b), None)
                    if k is not None:
                        rows.append((file_id, chunk_id, k, start, stop, text[start:stop], label, held[k][0], text[last[k] : start] if k in last else None))
                        last[k] = stop
            yield pd.DataFrame(rows, columns=["file_id", "chunk_id", "sentence", "start", "stop", "name", "label", "description", "between"])

    return chunks.select("file_id", "chunk_id", "chunk").mapInPandas(run, MENTIONS)


def ingest(spark: SparkSession, store: Store, tenant: str, name: str, text: str, embedder: Embedder, tagger: Tagger) -> str:
    """Store one text under a name, as ``ingest_files`` does."""
    return ingest_files(spark, store, tenant, spark.createDataFrame([(name, text)], "name string, text string"), embedder, tagger).head()["status"]


def ingest_files(spark: SparkSession, store: Store, tenant: str, files: DataFrame, embedder: Embedder, tagger: Tagger) -> DataFrame:
    """Store texts (``name, text``) of any number: chunks, nodes and edges with their vectors, one plan a table. Gives ``name, status`` of each name.

    A complete file is left alone; one whose chunks lack vectors is stored again. Of texts under one name the least is taken. Files without a
    name, and those without chunks (null and empty texts too), are ``ko`` and not stored. A text's appendix is left out (P15). A spreadsheet's
    Markdown is chunked by rows, for citations and relations alike, and the file is a node (C4). A run that fails leaves nothing behind (Q22).
    """
    work = store.work()

    def kept(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{work}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{work}/{name}")

    named = files.select(F.coalesce("name", F.lit("")).alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    try:
        given = kept(first_in(named, ["name"], ["text"]).withColumn("file_id", store.id_of(tenant, F.col("name"))), "given")
        again = given.join(store.files(tenant), "file_id", "left_semi").select("file_id")
        if not again.isEmpty():
            # Their buckets alone are read.
            lacking = kept(store.of_files("chunks", tenant, again).filter("embedding is null").select("file_id").distinct(), "lacking")
            if not lacking.isEmpty():
                store.drop(tenant, lacking)
        texts = given.filter("name != ''").join(store.files(tenant), "file_id", "left_anti")
        cut = kept(pieces(texts), "pieces")
        new = kept(given.join(cut, "file_id", "left_semi").select("file_id", "name"), "new")
        if not new.isEmpty():
            store.begin(tenant, new)
            try:
                for table, rows in graph_tables(cut, new, kept, embedder, tagger).items():
                    store.append(table, rows.withColumn("tenant", F.lit(tenant)))
            except Exception:
                store.drop(tenant, new)
                raise
            store.mark(tenant, new, "ok")
    finally:
        store.remove(work)
    done = store.files(tenant).select("name", F.lit("ok").alias("_done"))
    return named.select("name").distinct().join(done, "name", "left").select("name", F.coalesce("_done", F.lit("ko")).alias("status"))


def graph_tables(cut: DataFrame, files: DataFrame, kept: Callable[[DataFrame, str], DataFrame], embedder: Embedder, tagger: Tagger) -> dict[str, DataFrame]:
    """The tables of files (``file_id, name``) cut into ``pieces``; the tagger runs once, and ``kept`` holds what several tables are made from."""
    chunks = embedded(cut.filter("kind != 'relation'").select("file_id", F.col("chunk_id").alias("id"), "chunk"), F.col("chunk"), embedder)
    found = mentions_of(cut.filter("kind != 'citation'"), tagger)
    found = found.filter(entity_valid(F.col("name"))).withColumn("name", stripped(F.col("name"))).withColumn("normal", node_name(F.col("name")))
    found = kept(found.withColumn("chunk_id", F.struct("file_id", F.col("chunk_id").alias("place"))), "mentions")
    firsts = graph.entity_first(found.select("chunk_id", "start", "name", "label", "description"))
    ordered = firsts.select("chunk_id.file_id", "normal", "name", F.col("label").alias("type"), "description", (F.col("chunk_id.place") * 1_000_000 + F.col("start")).alias("seq"))
    sheets = files.filter(F.lower("name").endswith(".xlsx")).select("file_id", node_name(F.col("name")).alias("normal"), "name", F.lit("file").alias("type"), F.lit("").alias("description"), F.lit(-1).cast("long").alias("seq"))
    nodes = graph.upserted(ordered.union(sheets), ["file_id", "normal"])
    nodes = kept(nodes.select("file_id", F.xxhash64("normal").alias("id"), "name", F.col("normal").alias("name_normalized"), "type", "description"), "nodes")
    told = F.when(F.col("description") == "", F.col("name")).otherwise(F.concat_ws(": ", "name", "description"))
    pairs = graph.relation_pairs(found.withColumn("name", F.col("normal")), places=True)
    sentences = first_in(found.select("chunk_id", "sentence", "description"), ["chunk_id", "sentence"], ["description"])
    # Unique in its file and in the order of the text, which decides between equals.
    in_text = (F.col("chunk_id.place") * 1_000_000 + F.col("source_at")) * 1_000_000 + F.col("target_at")
    edges = pairs.join(sentences, ["chunk_id", "sentence"]).select("chunk_id.file_id", in_text.alias("id"), "source", "target", "description", F.col("source").alias("source_normalized"), F.col("target").alias("target_normalized"))
    edges = kept(edges, "edges")
    edge_vec = embedded(edges, F.trim("description"), embedder).select("file_id", "id", F.col("id").alias("edge_id"), "embedding")
    return {"chunks": chunks, "nodes": nodes, "node_vec": embedded(nodes, told, embedder), "edges": edges, "edge_vec": edge_vec}


@dataclass
class Found:
    citations: DataFrame
    nodes: DataFrame
    graph: DataFrame


def expanded(prompt: str, entities: list[str]) -> str:
    """The prompt and each entity that it does not name."""
    for e in entities:
        prompt = prompt if e.lower() in prompt.lower() else f"{prompt} {e}"
    return prompt


def search(spark: SparkSession, store: Store, tenant: str, prompt: str, entities: list[str], embedder: Embedder, reranker: Reranker, rows: list[int] | None = None) -> Found:
    """Citations, nodes and edges for a prompt. All three are plans; only the seeds' names (24 at most) come to the driver.

    Nodes and edges are those of the files that are cited, or of the seeds' files if none is (R12, R13, U9). With ``rows``, chunks of the seeds'
    spreadsheets that have one of these rows take the place of the citations, if there are any (R11, U8).
    """
    entities = [unicodedata.normalize("NFKC", e).strip() for e in entities if e.strip()]
    full = expanded(unicodedata.normalize("NFKC", prompt), entities)
    literal = lambda v: F.array(*[F.lit(float(x)) for x in v])
    query = literal(embedder.embed("query", [full])[0])
    files = store.files(tenant).withColumnRenamed("name", "file")
    chunks = store.table("chunks", tenant).select(F.struct("file_id", "id").alias("key"), "file_id", "chunk", "embedding")

    names = seed_names(spark, store, tenant, entities, embedder, reranker)
    seed_files = store.table("nodes", tenant).filter(F.col("name_normalized").isin(names) if names else F.lit(False)).select("file_id").distinct()

    anchors = [*entities, *full.split()]
    near = knn(chunks, query, POOL, "key").filter((F.col("distance") <= rank.GATE) | anchored(F.col("chunk"), anchors) | anchor_impossible(F.col("chunk"), anchors)).withColumn("source", F.lit(1))
    some = near.select("key", "file_id", "chunk", "distance", "source")
    if names:
        some = some.union(nearest_per_group(chunks.join(seed_files, "file_id", "left_semi").select("key", "file_id", "chunk", "embedding"), query, "file_id", "key").withColumn("source", F.lit(2)).select(some.columns))
    terms = [e.lower() for e in entities if len(e) >= SHORTEST]
    if terms:
        hits = chunks.withColumn("distance", F.coalesce(l2(F.col("embedding"), query), F.lit(FURTHEST))).select("key", "file_id", "chunk", "distance", F.explode(F.filter(F.array(*map(F.lit, terms)), lambda t: F.lower("chunk").contains(t))).alias("term"))
        some = some.union(first_in(hits, ["term", "file_id"], ["distance", "key"]).withColumn("source", F.lit(3)).select(some.columns))
    some = first_in(some, ["file_id", "chunk"], ["source", "distance", "key"]).withColumn("query_id", F.lit(0))
    least = rank.SCORE_LEAST if names else F.when(anchored(F.col("chunk"), entities), rank.SCORE_LEAST).otherwise(rank.SCORE_LEAST_ALONE)
    cited = rank.cited(scored(some, full, F.col("chunk"), reranker), seq="key", least=least).select("place", "file_id", "key", "chunk", "distance", "score", "fusion")
    if numbers := list(dict.fromkeys(r for r in rows or [] if isinstance(r, int) and r > 0)):
        sheets = seed_files.join(files, "file_id").filter(F.lower("file").endswith(".xlsx")).select("file_id")
        told = chunks.join(sheets, "file_id", "left_semi").filter(records.holds_row(F.col("chunk"), numbers))
        if not told.isEmpty():
            place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("key"))  # the few chunks that name these rows
            cited = told.select(place.alias("place"), "file_id", "key", "chunk", F.lit(0.0).alias("distance"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("fusion"))
    citations = cited.join(files, "file_id").select("place", "file", "chunk", "distance", "score", "fusion")

    told_files = cited.select("file_id").distinct()
    of_files = told_files.union(seed_files.join(told_files.select(F.col("file_id").alias("_told")).limit(1), F.lit(True), "left_anti"))
    detail = graph.node_detail(store.table("nodes", tenant), names, of_files)
    edges = store.table("edges", tenant)
    degrees = graph.degree(edges)
    told = detail.join(degrees.withColumnRenamed("name", "name_normalized"), "name_normalized", "left").select("name", "type", "description", F.coalesce("degree", F.lit(0)).alias("degree")).orderBy(F.desc("degree"), "name").limit(NODES)

    walked = graph.traverse(edges.join(of_files, "file_id", "left_semi").select(F.struct("id", "file_id").alias("id"), "source_normalized", "target_normalized", "description"), store.table("edge_vec", tenant).select(F.struct("edge_id", "file_id").alias("edge_id"), "embedding"), query, names)
    for end in ("source", "target"):
        walked = walked.join(degrees.select(F.col("name").alias(f"{end}_normalized"), F.col("degree").alias(f"_{end}")), f"{end}_normalized", "left")
    walked = walked.withColumn("rank", F.coalesce("_source", F.lit(0)) + F.coalesce("_target", F.lit(0))).orderBy("distance", F.desc("rank"), "id").limit(POOL)
    weighed = scored(walked, full, F.col("description"), reranker).withColumn("tokens", token_estimate(F.concat_ws(" ", "source_normalized", "target_normalized", "description")))
    weighed = weighed.withColumn("all", F.lit(0)).withColumn("seq", F.row_number().over(Window.partitionBy("all").orderBy(F.desc("score"), F.desc("rank"), "id")).cast("long"))  # POOL rows
    kept = rank.budgeted(weighed, "all").select("place", "seq")
    out = kept.join(weighed, "seq").select("place", F.col("source_normalized").alias("source"), F.col("target_normalized").alias("target"), "description", "score")
    return Found(citations, told, out)


def seed_names(spark: SparkSession, store: Store, tenant: str, entities: list[str], embedder: Embedder, reranker: Reranker) -> list[str]:
    """Names of the seeds: of each entity's nearest nodes those that score, then names that hold an entity, shortest first (R3-R5, U3). One plan for all entities."""
    out: dict[str, None] = {}
    if entities:
        asked = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(embedder.embed("query", entities))], "query_id int, query_vector array<float>")
        pool = batch_knn(store.table("node_vec", tenant).select("id", "name_normalized", "description", "embedding"), asked, NODE_POOL)
        pool = scored(pool.drop("rank").withColumnRenamed("id", "seq"), dict(enumerate(entities)), F.concat_ws(": ", "name_normalized", "description"), reranker)
        out.update(dict.fromkeys(r["name_normalized"] for r in rank.seeds(pool).orderBy("query_id", "place").collect()))
    if terms := [e.lower() for e in entities if len(e) >= SHORTEST]:
        out.update(dict.fromkeys(r[0] for r in records.names_like(store.table("nodes", tenant), terms, graph.SEEDS).collect()))
    return list(out)[: graph.SEEDS]
