"""The engine's operators as queries over the driver's tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.expression import math_expression
from lectern.operators import chunk, graph, layout, rank, records, vector
from lectern.sources import files
from lectern.sources.store import insert_ignore
from lectern.streaming.ingest import window_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0):
    """One vector as a literal of the plan, as a prompt's embedding would be."""
    row = table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").head()
    return F.array(*[F.lit(float(x)) for x in row[0]])


# Vectors


@query("""WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)
SELECT vec_id, label, round(d, 4) AS distance FROM (SELECT vec_id, label, list_distance(embedding::DOUBLE[], q::DOUBLE[]) AS d FROM embeddings, q ORDER BY d, vec_id LIMIT 24)""")
def vec_knn(spark, sf_dir):
    near = vector.knn(table(spark, sf_dir, "embeddings"), query_vector(spark, sf_dir), 24, "vec_id")
    return near.select("vec_id", "label", F.round("distance", 4).alias("distance"))


@query("""WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, label, list_distance(embedding::DOUBLE[], q::DOUBLE[]) AS d FROM embeddings, q)
SELECT label, vec_id, round(d, 4) AS distance FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY d, vec_id) = 1""")
def vec_nearest_per_file(spark, sf_dir):
    near = vector.nearest_per_group(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"), query_vector(spark, sf_dir), "label", "vec_id")
    return near.select("label", "vec_id", F.round("distance", 4).alias("distance"))


def prompts(spark, sf_dir):
    """The stated queries of the searches: every row whose id is divisible by 50, against all rows."""
    return table(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


@query("""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS d FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0)
SELECT query_id, vec_id, round(d, 4) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id)::INT AS rank FROM s QUALIFY rank <= 5""")
def vec_batch_knn(spark, sf_dir):
    near = vector.batch_knn(table(spark, sf_dir, "embeddings"), prompts(spark, sf_dir), 5, "vec_id")
    return near.select("query_id", "vec_id", F.round("distance", 4).alias("distance"), "rank")


@query("""WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)
SELECT vec_id, label FROM (SELECT vec_id, label, list_distance(embedding::DOUBLE[], q::DOUBLE[]) AS d FROM embeddings, q ORDER BY d, vec_id LIMIT 24) WHERE label < 5""")
def vec_limit_then_filter(spark, sf_dir):
    return vector.knn(table(spark, sf_dir, "embeddings"), query_vector(spark, sf_dir), 24, "vec_id").filter("label < 5").select("vec_id", "label")


CITED = """WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS seq, e.label AS file_id, list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS distance, 1 / (1 + exp(-10 * e.embedding[1]::DOUBLE)) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0),
g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, seq) AS n FROM s),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, file_id ORDER BY distance, seq) AS m FROM s),
c AS (SELECT query_id, seq, file_id, distance, score FROM g WHERE n <= 24 AND distance <= 1.24 UNION SELECT query_id, seq, file_id, distance, score FROM f WHERE m = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, seq) AS rd, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seq) AS rs, max(score) OVER (PARTITION BY query_id, file_id) AS bf, max(score) OVER (PARTITION BY query_id) AS ba FROM c),
u AS (SELECT *, 1 / (60.0::DOUBLE + rd) + 1 / (60.0::DOUBLE + rs) AS fusion, max((bf >= 0.175 * ba AND score > 0.0005)::INT) OVER (PARTITION BY query_id) AS op FROM r)"""


def candidates(spark, sf_dir):
    """Chunk candidates of each prompt: the nearest 24 within the gate, and the nearest of each file; first wins."""
    rows = table(spark, sf_dir, "embeddings").withColumn("score", rank.sigmoid(10 * F.get("embedding", F.lit(0)).cast("double")))
    shown = ["query_id", F.col("vec_id").alias("seq"), F.col("label").alias("file_id"), "distance", "score"]
    near = vector.batch_knn(rows, prompts(spark, sf_dir), 24, "vec_id").filter(F.col("distance") <= rank.GATE)
    of_files = vector.batch_nearest(rows, prompts(spark, sf_dir), "label", "vec_id")
    return near.select(*shown).union(of_files.select(*shown)).distinct()


@query(CITED + " SELECT query_id, seq, file_id, round(distance, 4) AS distance, round(score, 4) AS score, round(fusion, 6) AS fusion, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fusion DESC, rd, seq) AS place FROM u WHERE op = 1 AND bf >= 0.175 * ba) WHERE place <= 8")
def citation_search(spark, sf_dir):
    """The flagship: candidates, two ranks, fusion, domain gate, the first eight of each prompt."""
    out = rank.cited(candidates(spark, sf_dir))
    return out.select("query_id", "seq", "file_id", F.round("distance", 4).alias("distance"), F.round("score", 4).alias("score"), F.round("fusion", 6).alias("fusion"), "place")


@query(CITED + " SELECT query_id, seq, rd::INT AS rank_distance, rs::INT AS rank_score, round(fusion, 6) AS fusion FROM u")
def rank_fusion(spark, sf_dir):
    return rank.fused(candidates(spark, sf_dir)).select("query_id", "seq", "rank_distance", "rank_score", F.round("fusion", 6).alias("fusion"))


@query(CITED + " SELECT query_id, seq, file_id FROM u WHERE op = 1 AND bf >= 0.175 * ba")
def domain_gate(spark, sf_dir):
    return rank.gated(candidates(spark, sf_dir)).select("query_id", "seq", "file_id")


@query("""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS seq, 1 / (1 + exp(-10 * e.embedding[1]::DOUBLE)) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), e.vec_id) AS n FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0),
p AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM s WHERE n <= 12)
SELECT query_id, seq, round(score, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seq)::INT AS place FROM p WHERE best > 0.25 AND score > 0.0005 AND score >= 0.175 * best QUALIFY place <= 8""")
def seed_select(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("score", rank.sigmoid(10 * F.get("embedding", F.lit(0)).cast("double")))
    pool = vector.batch_knn(rows, prompts(spark, sf_dir), rank.SEED_POOL, "vec_id").select("query_id", F.col("vec_id").alias("seq"), "score")
    return rank.seeds(pool).select("query_id", "seq", F.round("score", 4).alias("score"), "place")


@query("""WITH RECURSIVE r AS (SELECT label, vec_id, 1 / (1 + exp(-10 * embedding[1]::DOUBLE)) AS score, 'd' || (vec_id % 7)::VARCHAR AS description, (100 + vec_id % 5 * 150)::BIGINT AS tokens FROM embeddings),
n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS n FROM r),
f AS (SELECT label, 0::BIGINT AS n, 0::BIGINT AS spent, []::VARCHAR[] AS taken, NULL::BIGINT AS vec_id, false AS ok FROM (SELECT DISTINCT label FROM r)
 UNION ALL SELECT f.label, x.n, CASE WHEN x.score > 0.0005 AND NOT list_contains(f.taken, x.description) AND f.spent + x.tokens <= 2000 THEN f.spent + x.tokens ELSE f.spent END,
  CASE WHEN x.score > 0.0005 AND NOT list_contains(f.taken, x.description) AND f.spent + x.tokens <= 2000 THEN list_append(f.taken, x.description) ELSE f.taken END, x.vec_id,
  x.score > 0.0005 AND NOT list_contains(f.taken, x.description) AND f.spent + x.tokens <= 2000 FROM f JOIN n x ON x.label = f.label AND x.n = f.n + 1)
SELECT label, vec_id FROM f WHERE ok""")
def budget_fold(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("seq"), rank.sigmoid(10 * F.get("embedding", F.lit(0)).cast("double")).alias("score"), F.concat(F.lit("d"), (F.col("vec_id") % 7).cast("string")).alias("description"), (100 + F.col("vec_id") % 5 * 150).cast("long").alias("tokens"))
    return rank.budgeted(rows, "label").select("label", F.col("seq").alias("vec_id"))


# Graph


def parts_suppliers(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("source_normalized"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("target_normalized"))


@query("""WITH e AS (SELECT 'p' || l_partkey AS a, 's' || l_suppkey AS b FROM lineitem)
SELECT name, count(DISTINCT other) AS degree FROM (SELECT a AS name, b AS other FROM e UNION ALL SELECT b, a FROM e) GROUP BY name""")
def degree(spark, sf_dir):
    return graph.degree(parts_suppliers(spark, sf_dir))


NATIONS = """WITH e AS (SELECT 'n' || c.c_nationkey AS a, 'n' || s.s_nationkey AS b, o.o_orderpriority || ' ' || l.l_shipdate::DATE AS d FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey JOIN supplier s ON l_suppkey = s_suppkey),
w AS (SELECT least(a, b) AS a, greatest(a, b) AS b, count(*) AS weight, min_by(d, (-length(d), d)) AS description FROM e GROUP BY 1, 2)"""


def nation_edges(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select(F.concat(F.lit("n"), F.col("c_nationkey")).alias("source_normalized"), F.concat(F.lit("n"), F.col("s_nationkey")).alias("target_normalized"), F.concat_ws(" ", "o_orderpriority", F.date_format("l_shipdate", "yyyy-MM-dd")).alias("description"))


@query(NATIONS + " SELECT * FROM w")
def edge_weight(spark, sf_dir):
    return graph.edge_weight(nation_edges(spark, sf_dir))


@query(NATIONS + " SELECT * FROM w WHERE a IN (SELECT 'n' || n_nationkey FROM nation WHERE n_regionkey < 2) AND b IN (SELECT 'n' || n_nationkey FROM nation WHERE n_regionkey < 2)")
def graph_edges_known(spark, sf_dir):
    nodes = table(spark, sf_dir, "nation").filter("n_regionkey < 2").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("name"))
    return graph.known_edges(graph.edge_weight(nation_edges(spark, sf_dir)), nodes)


@query("""SELECT n_name AS label, coalesce(r_name, '-') AS file, CASE n_regionkey WHEN 0 THEN 'red' WHEN 1 THEN 'blue' ELSE 'grey' END AS colour FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON n_regionkey = r_regionkey""")
def graph_nodes(spark, sf_dir):
    regions = table(spark, sf_dir, "region").filter("r_regionkey < 3")
    return records.page_nodes(table(spark, sf_dir, "nation"), regions, "n_regionkey", "r_regionkey", "n_name", "r_name")


@query("""SELECT lower(p_brand) AS name_normalized, p_brand AS name, p_type AS type, p_name AS description, p_partkey AS id FROM part JOIN supplier ON p_size = s_suppkey
WHERE lower(p_brand) IN ('brand#1', 'brand#11', 'brand#17') AND s_acctbal > 0 QUALIFY row_number() OVER (PARTITION BY lower(p_brand) ORDER BY length(p_name) DESC, p_partkey) = 1""")
def node_detail(spark, sf_dir):
    """Parts as nodes named by their brand, in files numbered by their size; only files whose supplier has credit count."""
    nodes = table(spark, sf_dir, "part").select(F.lower("p_brand").alias("name_normalized"), F.col("p_brand").alias("name"), F.col("p_type").alias("type"), F.col("p_name").alias("description"), F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("file_id"))
    of = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("file_id"))
    return graph.node_detail(nodes, ["brand#1", "brand#11", "brand#17"], of)


@query("""WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), e AS (SELECT l_orderkey * 8 + l_linenumber AS id, 'p' || l_partkey AS s, 's' || l_suppkey AS t FROM lineitem),
m AS (SELECT count(*) AS n FROM embeddings),
d AS (SELECT id, s, t, list_distance(v.embedding::DOUBLE[], q::DOUBLE[]) AS d FROM e, q, m JOIN embeddings v ON v.vec_id = id % m.n WHERE s IN ('p1', 'p2') OR t IN ('s3'))
SELECT id, s AS source, t AS target, round(d, 4) AS distance FROM (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY s, t ORDER BY d, id) = 1 ORDER BY d, id LIMIT 96)""")
def edge_traverse(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    n = vectors.count()
    edges = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("source_normalized"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("target_normalized"))
    near = edges.filter(F.col("source_normalized").isin("p1", "p2") | F.col("target_normalized").isin("s3"))
    of_edges = near.select(F.col("id").alias("edge_id"), (F.col("id") % n).alias("vec_id")).distinct().join(vectors, "vec_id").select("edge_id", "embedding")
    out = graph.traverse(edges, of_edges, query_vector(spark, sf_dir), ["p1", "p2", "s3"])
    return out.select("id", F.col("source_normalized").alias("source"), F.col("target_normalized").alias("target"), F.round("distance", 4).alias("distance"))


@query("""SELECT user_id, event_type AS name, min_by(value, event_id)::VARCHAR AS type, coalesce(min_by(props, event_id) FILTER (WHERE value > 50), '') AS description FROM events GROUP BY user_id, event_type""")
def node_upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("key"), F.col("event_type").alias("name"), F.col("value").cast("string").alias("type"), F.when(F.col("value") > 50, F.col("props")).otherwise("").alias("description"), F.col("event_id").alias("seq"))
    return graph.upserted(rows, ["user_id", "key"]).drop("key")


@query("""SELECT doc_id, source, length(text) AS n FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) = 1""")
def distinct_on_longest(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").cast("long").alias("n"))
    return vector.first_in(rows, ["source"], [-F.col("n"), F.col("doc_id")])


@query("""SELECT l_suppkey, l_partkey, l_orderkey, l_extendedprice FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_extendedprice, l_orderkey, l_linenumber) = 1) ORDER BY l_extendedprice, l_orderkey, l_linenumber LIMIT 200""")
def distinct_on_pair(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    order = ["l_extendedprice", "l_orderkey", "l_linenumber"]
    return vector.first_in(rows, ["l_suppkey", "l_partkey"], order).orderBy(*order).limit(200).drop("l_linenumber")



@query("""WITH t AS (SELECT conv_id, turn, unnest(range(1, len(string_split(text, ' ')) + 1)) AS i, unnest(string_split(text, ' ')) AS w FROM conversations),
s AS (SELECT *, coalesce(sum(length(w) + 1) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM t),
m AS (SELECT conv_id * 1000 + turn AS chunk_id, i, w, st AS start, st + length(w) AS stop, lower(w) AS name FROM s WHERE regexp_full_match(w, '[A-Z][a-z]+')),
g AS (SELECT *, start - lag(stop) OVER (PARTITION BY chunk_id ORDER BY start) AS gap FROM m),
h AS (SELECT *, sum(CASE WHEN gap = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY chunk_id ORDER BY start) AS island, coalesce(gap BETWEEN 2 AND 60, false) AS link FROM g),
p AS (SELECT a.chunk_id, a.name AS source, b.name AS target FROM h a JOIN h b ON a.chunk_id = b.chunk_id AND b.link AND a.island = b.island - 1 WHERE a.name <> b.name)
SELECT DISTINCT chunk_id, source, target FROM p""")
def relation_pairs(spark, sf_dir):
    """Mentions are capitalised words; only a space between two of them enumerates, other words do not."""
    mentions = capitals(spark, sf_dir).select("chunk_id", F.lit(0).alias("sentence"), "start", "stop", F.lower("name").alias("name"))
    before = F.lag("stop").over(Window.partitionBy("chunk_id").orderBy("start"))
    mentions = mentions.withColumn("between", F.when(F.col("start") - before > 1, "other words").otherwise(" "))
    return graph.relation_pairs(mentions).select("chunk_id", "source", "target")


def capitals(spark, sf_dir):
    """``chunk_id, start, stop, name``: the capitalised words of each turn."""
    words = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"), F.posexplode(F.split("text", " ")).alias("i", "w"))
    line = Window.partitionBy("chunk_id").orderBy("i")
    placed = words.withColumn("start", F.coalesce(F.sum(F.length("w") + 1).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    return placed.filter(F.col("w").rlike("^[A-Z][a-z]+$")).select("chunk_id", "start", (F.col("start") + F.length("w")).alias("stop"), F.col("w").alias("name"))


@query("""WITH t AS (SELECT conv_id, turn, unnest(range(1, len(string_split(text, ' ')) + 1)) AS i, unnest(string_split(text, ' ')) AS w FROM conversations),
s AS (SELECT *, coalesce(sum(length(w) + 1) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM t)
SELECT conv_id * 1000 + turn AS chunk_id, w AS name, lower(w) AS normal, st::INT AS start FROM s WHERE regexp_full_match(w, '[A-Z][a-z]+') AND length(w) >= 3 AND NOT contains(lower(w), 'http')
QUALIFY row_number() OVER (PARTITION BY conv_id, turn, lower(w) ORDER BY st) = 1""")
def entity_first(spark, sf_dir):
    """The first of each name in a turn, of the names that may be entities."""
    return graph.entity_first(capitals(spark, sf_dir).select("chunk_id", "name", "start"))


# Predicates and sets


@query("""SELECT name FROM (SELECT DISTINCT lower(p_name) AS name FROM part WHERE lower(p_name) LIKE '%ring%' OR lower(p_name) LIKE '%bolt%') ORDER BY length(name), name LIMIT 24""")
def name_like_shortest(spark, sf_dir):
    return records.names_like(table(spark, sf_dir, "part").select(F.lower("p_name").alias("name")), ["ring", "bolt"], 24, "name")


@query("""SELECT doc_id FROM documents WHERE contains(lower(text), '100%_') OR contains(lower(text), '%%%')""")
def lexical_contains(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(records.holds_any(F.lower("text"), ["100%_", "%%%"])).select("doc_id")


@query(r"""SELECT doc_id FROM documents WHERE regexp_matches(lower(coalesce(text, '')), '(?:^|[^\p{L}\p{N}\p{M}_])(?:licen|haen|token)')""")
def anchor_filter(spark, sf_dir):
    """Documents that hold an anchor term, or can't hold any."""
    terms = ["licen", "haen", "Token", "ab"]
    return table(spark, sf_dir, "documents").filter(T.anchored(F.col("text"), terms) | T.anchor_impossible(F.col("text"), terms)).select("doc_id")


@query("""WITH t AS (SELECT unnest(['license', 'the and', 'token']) AS term)
SELECT term, source, doc_id FROM t JOIN documents ON contains(lower(text), term) QUALIFY row_number() OVER (PARTITION BY term, source ORDER BY length(text), doc_id) = 1""")
def distinct_on_file_term(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.lower("text").alias("t"), F.length("text").alias("n"))
    terms = F.array(*map(F.lit, ("license", "the and", "token")))
    hits = docs.select("doc_id", "source", "n", F.explode(F.filter(terms, lambda x: F.col("t").contains(x))).alias("term"))
    return vector.first_in(hits, ["term", "source"], ["n", "doc_id"]).select("term", "source", "doc_id")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, 'lineitem - sheet' || chr(10) || 'row ' || l_orderkey || ': A=' || l_partkey || ', B=' || l_suppkey AS chunk FROM lineitem)
SELECT l_orderkey, l_linenumber, chunk FROM r WHERE contains(chunk, chr(10) || 'row 7:') OR contains(chunk, chr(10) || 'row 12:')""")
def row_lookup(spark, sf_dir):
    chunk_text = F.concat(F.lit("lineitem - sheet\nrow "), F.col("l_orderkey").cast("string"), F.lit(": A="), F.col("l_partkey").cast("string"), F.lit(", B="), F.col("l_suppkey").cast("string"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", chunk_text.alias("chunk"))
    return rows.filter(records.holds_row(F.col("chunk"), [7, 12]))


@query("""SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_acctbal >= 0 UNION ALL
SELECT id, min_by(name, event_id) FROM (SELECT user_id AS id, event_type AS name, event_id FROM events) WHERE id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) GROUP BY id""")
def insert_ignore_rows(spark, sf_dir):
    have = table(spark, sf_dir, "customer").filter("c_acctbal >= 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    new = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("name"), F.col("event_id").alias("seq"))
    return insert_ignore(have, new, ["id"], "seq")


@query("""WITH gone AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
SELECT 'orders' AS name, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT * FROM gone) UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT * FROM gone)""")
def delete_cascade(spark, sf_dir):
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    gone = orders.filter("o_orderstatus = 'F'")
    left = [records.without(orders, gone, {"o_orderkey": "o_orderkey"}), records.without(items, gone, {"l_orderkey": "o_orderkey"})]
    return left[0].agg(F.count(F.lit(1)).alias("n")).select(F.lit("orders").alias("name"), "n").unionByName(left[1].agg(F.count(F.lit(1)).alias("n")).select(F.lit("lineitem").alias("name"), "n"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT (c_acctbal < 0) AND c_mktsegment = 'BUILDING'")
def soft_delete_list(spark, sf_dir):
    marked = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").withColumn("is_delete", F.col("c_acctbal") < 0)
    return records.active(marked).select("c_custkey", "c_name")


@query("SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), c_name) AS name FROM customer")
def update_coalesce(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", records.updated(F.col("c_mktsegment"), F.col("c_name"), "BUILDING").alias("name"))


@query("SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def settings_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", records.settings(F.col("props"), "k bigint")["k"].alias("k"))


@query("""WITH u AS (SELECT l_orderkey AS k, l_partkey % 10 AS f, 1 AS src, l_linenumber AS seq FROM lineitem WHERE l_quantity < 5 UNION ALL SELECT l_orderkey, l_partkey % 10, 2, l_linenumber FROM lineitem WHERE l_discount > 0.05)
SELECT k, f, src, seq FROM u QUALIFY row_number() OVER (PARTITION BY k, f ORDER BY src, seq) = 1""")
def candidate_union(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    pick = lambda df, s: df.select(F.col("l_orderkey").alias("k"), (F.col("l_partkey") % 10).alias("f"), F.lit(s).alias("src"), F.col("l_linenumber").alias("seq"))
    return vector.first_in(pick(items.filter("l_quantity < 5"), 1).unionByName(pick(items.filter("l_discount > 0.05"), 2)), ["k", "f"], ["src", "seq"])


@query("SELECT user_id, time_bucket(INTERVAL '15 minutes', ts) AS window_start, count(*) AS n FROM events GROUP BY 1, 2")
def rate_window(spark, sf_dir):
    return window_counts(table(spark, sf_dir, "events"))


# Text


@query(r"""SELECT doc_id, trim(regexp_replace(lower(text), '[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'), ' ') AS name FROM documents""")
def node_normalize(spark, sf_dir):
    """DuckDB has no NFKC; the documents are in it."""
    return table(spark, sf_dir, "documents").select("doc_id", T.node_name(T.nfkc(F.col("text"))).alias("name"))


@query("SELECT doc_id, ((length(text) + 3) // 4)::BIGINT AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+(?:[-_][\p{L}\p{N}_]+)*|[^\p{L}\p{N}_\s]'))::BIGINT AS n FROM documents""")
def word_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.words(F.col("text"))).cast("long").alias("n"))


@query(r"""WITH m AS (SELECT doc_id, regexp_replace(text, '([.?!…])($|[^\p{L}\p{N}])', '\1' || chr(10) || '\2', 'g') AS t FROM documents), n AS (SELECT doc_id, regexp_replace(t, '([.?!…])($|[^\p{L}\p{N}])', '\1' || chr(10) || '\2', 'g') AS t FROM m)
SELECT doc_id, len(list_filter(string_split(t, chr(10)), lambda x: length(trim(x, ' ')) > 0))::BIGINT AS n FROM n""")
def sentence_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.sentence_count(F.col("text")).alias("n"))


@query(r"SELECT page_id, regexp_replace(html, 'https?://[^\s]+', '', 'g') AS html FROM pages")
def url_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.without_urls(F.col("html")).alias("html"))


@query("""SELECT page_id, list_extract(string_split(url, '/'), -1) AS base, starts_with(url, 'http://') AS plain, len(string_split(url, '/'))::INT AS depth, regexp_extract(url, '^(.*)/[^/]*$', 1) AS parent,
regexp_replace(regexp_replace(url, '/+', '/', 'g'), '^/|/$', '', 'g') AS clean, CASE WHEN starts_with(url, regexp_extract(url, '^([^/]*//[^/]*)', 1) || '/') THEN substr(url, length(regexp_extract(url, '^([^/]*//[^/]*)', 1)) + 2) END AS inside FROM pages""")
def path_rules(spark, sf_dir):
    url = F.col("url")
    paths = [T.parent_path(url).alias("parent"), T.clean_path(url).alias("clean"), T.relative_path(url, F.regexp_extract(url, "^([^/]*//[^/]*)", 1)).alias("inside")]
    return table(spark, sf_dir, "pages").select("page_id", T.base_name(url).alias("base"), url.startswith("http://").alias("plain"), F.size(F.split(url, "/")).alias("depth"), *paths)


@query(r"""WITH t AS (SELECT doc_id, CASE WHEN lang = 'en' THEN text || chr(10) || '---' || chr(10) || '  SECONDARY ELEMENT:' || chr(10) || text ELSE text END AS t FROM documents),
c AS (SELECT doc_id, CASE WHEN contains(t, 'SECONDARY ELEMENT:') THEN regexp_extract(t, '(?s)^(.*?)\n[ ]*SECONDARY ELEMENT:', 1) ELSE t END AS t FROM t)
SELECT doc_id, regexp_replace(t, '(\n[ ]*(---)?[ ]*)+$', '') AS main FROM c""".replace("\\\\", "\\"))
def appendix_cut(spark, sf_dir):
    """English documents get a copy of themselves as an appendix, which goes again."""
    text = F.when(F.col("lang") == "en", F.concat("text", F.lit("\n---\n  SECONDARY ELEMENT:\n"), "text")).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", T.primary_text(text).alias("main"))


@query("""SELECT event_id, list_transform(list_filter([event_type, value::VARCHAR, '3.9', ''], lambda x: try_cast(x AS DOUBLE) IS NOT NULL), lambda x: trunc(x::DOUBLE)::BIGINT) AS numbers, json_valid(props) AS valid FROM events""")
def list_coerce(spark, sf_dir):
    items = F.array("event_type", F.col("value").cast("string"), F.lit("3.9"), F.lit(""))
    return table(spark, sf_dir, "events").select("event_id", T.whole_numbers(items).alias("numbers"), T.is_json(F.col("props")).alias("valid"))


@query("SELECT event_id, least(greatest(value, 10.0), 50.0) AS v FROM events")
def arg_coerce(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.clamped(F.col("value").cast("string"), 10, 50).alias("v"))


@query("""SELECT p_partkey, CASE WHEN k < 26 THEN chr((65 + k)::INT) WHEN k < 702 THEN chr((65 + (k - 26) // 26)::INT) || chr((65 + (k - 26) % 26)::INT)
ELSE chr((65 + (k - 702) // 676)::INT) || chr((65 + (k - 702) // 26 % 26)::INT) || chr((65 + (k - 702) % 26)::INT) END AS letters FROM (SELECT p_partkey, p_partkey % 18278 AS k FROM part)""")
def column_letter(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.column_letters(F.col("p_partkey") % 18278).alias("letters"))


@query("""SELECT p_partkey, CASE WHEN p_retailprice = floor(p_retailprice) THEN floor(p_retailprice)::BIGINT::VARCHAR ELSE p_retailprice::VARCHAR END AS t FROM part""")
def cell_text(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.number_text(F.col("p_retailprice")).alias("t"))


@query("""SELECT l_orderkey, l_linenumber, strftime(TIMESTAMP '1899-12-30' + to_days((40000 + l_partkey)::INT), '%Y-%m-%d') AS d FROM lineitem""")
def excel_date(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.excel_date((40000 + F.col("l_partkey")).cast("double")).alias("d"))


@query("SELECT p_partkey, p_size * 3.0::DOUBLE + p_retailprice / 2.0 - p_size AS value FROM part")
def math_expressions(spark, sf_dir):
    s, p = F.col("p_size").cast("string"), F.col("p_retailprice").cast("string")
    return table(spark, sf_dir, "part").select("p_partkey", math_expression(F.concat(s, F.lit(" * 3 + "), p, F.lit(" / 2 - "), s))["value"].alias("value"))


@query("""SELECT p_partkey, CASE WHEN b < 1024 THEN b || ' B' ELSE format('{:.1f}', b / 1024.0) || ' KB' END AS size, CASE WHEN p_partkey % 2 = 0 THEN 'document' ELSE 'image' END AS category FROM (SELECT p_partkey, p_size * 100 AS b FROM part)""")
def file_detail(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    kind = files.file_type(F.when(F.col("p_partkey") % 2 == 0, F.encode(F.lit("%PDF-1.7"), "UTF-8")).otherwise(F.encode(F.lit("none"), "UTF-8")), F.lit("a/b.png"))
    return part.select("p_partkey", T.file_size(F.col("p_size") * 100).alias("size"), kind["category"].alias("category"))


@query("""SELECT l_orderkey, '# ' || l_orderkey || chr(10) || string_agg('| ' || l_partkey || ' | ' || replace(l_returnflag || '|', '|', '\\|') || ' |', chr(10) ORDER BY l_linenumber, l_partkey, l_returnflag) AS md FROM lineitem GROUP BY l_orderkey""".replace("\\\\", "\\"))
def markdown_build(spark, sf_dir):
    row = F.concat(F.lit("| "), F.col("l_partkey").cast("string"), F.lit(" | "), T.cell_escape(F.concat("l_returnflag", F.lit("|"))), F.lit(" |"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", row.alias("row")).alias("r"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["row"]), "\n")
    return rows.groupBy("l_orderkey").agg(body.alias("body")).select("l_orderkey", F.concat(T.heading(F.lit(1)), F.lit(" "), F.col("l_orderkey").cast("string"), F.lit("\n"), F.col("body")).alias("md"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber AS n, 'row ' || l_linenumber || ': A=' || l_partkey || CASE WHEN l_discount > 0 THEN ', B=' || l_suppkey ELSE '' END AS told FROM lineitem),
t AS (SELECT l_orderkey, 'o.xlsx - ' || l_orderkey || chr(10) || string_agg(told, chr(10) ORDER BY n, told) AS chunk FROM r GROUP BY l_orderkey)
SELECT l_orderkey, 0::BIGINT AS seq, chunk, ((length(chunk) + 3) // 4)::BIGINT AS tokens FROM t""")
def table_rows_text(spark, sf_dir):
    """Each order as a sheet of its lines, chunked; no order is long enough for two chunks."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_discount") > 0, F.col("l_suppkey")).alias("supplier"))
    sheets = records.sheet_markdown(rows, ["l_orderkey"], "l_linenumber", ["l_partkey", "supplier"], ["A", "B"], F.col("l_orderkey").cast("string"))
    return chunk.chunked_tables(sheets.withColumn("file", F.lit("o.xlsx")), "l_orderkey", "file")


@query()
def chunk_citation(spark, sf_dir):
    return chunk.chunked(table(spark, sf_dir, "documents"), "citation")


@query()
def chunk_relation(spark, sf_dir):
    return chunk.chunked(table(spark, sf_dir, "documents"), "relation")


# Layout


@query("""SELECT p_brand, CASE WHEN list_sort(list(p_size))[count(*) // 2 + 1] > 0 THEN list_sort(list(p_size))[count(*) // 2 + 1] ELSE 12 END AS size FROM part GROUP BY p_brand""")
def upper_median(spark, sf_dir):
    return layout.upper_median(table(spark, sf_dir, "part"), ["p_brand"], "p_size")


@query("""WITH w AS (SELECT p_brand, p_size, sum(length(p_name)) AS w, min(p_partkey) AS q FROM part GROUP BY 1, 2) SELECT p_brand, min_by(p_size, (-w, q)) AS mode FROM w GROUP BY 1""")
def weighted_mode(spark, sf_dir):
    return layout.weighted_mode(table(spark, sf_dir, "part").withColumn("n", F.length("p_name")), ["p_brand"], "p_size", "n", "p_partkey")


@query("""WITH b AS (SELECT l_suppkey, floor(l_discount / 0.02) AS b, count(*) AS n, min(l_orderkey * 8 + l_linenumber) AS q, avg(l_discount) AS m FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, round(min_by(m, (-n, q)), 6) AS margin FROM b GROUP BY 1""")
def layout_margin(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").withColumn("seq", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    return layout.modal_margin(items, ["l_suppkey"], "l_discount", "seq").withColumn("margin", F.round("margin", 6))


@query("""SELECT l_suppkey, list_sort(list(l_extendedprice))[least(count(*) - 1, floor(count(*) * 0.95)::BIGINT) + 1] AS edge FROM lineitem GROUP BY 1""")
def layout_edge(spark, sf_dir):
    return layout.index_percentile(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice")


ITEMS = """i AS (SELECT l_suppkey AS doc, l_linenumber AS page, l_orderkey * 8 + l_linenumber AS seq, l_discount AS x0, l_discount + l_quantity / 100 AS x1, l_extendedprice / 100000 AS y0, l_extendedprice / 100000 + l_tax AS y1 FROM lineitem WHERE l_returnflag <> 'R')"""


def page_items(spark, sf_dir):
    """Lines as items of a page in shares of it: a supplier's are a document, a line number's a page; returned lines are secondary."""
    price = F.col("l_extendedprice") / 100000
    items = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc"), F.col("l_linenumber").alias("page"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), F.col("l_discount").alias("x0"), (F.col("l_discount") + F.col("l_quantity") / 100).alias("x1"), price.alias("y0"), (price + F.col("l_tax")).alias("y1"), "l_returnflag")
    return items.filter("l_returnflag != 'R'").drop("l_returnflag"), items.filter("l_returnflag = 'R'").select("doc", "page", F.col("x0").alias("at"))


STATS = """b AS (SELECT doc, floor(x0 / 0.02) AS b, count(*) AS n, min(seq) AS q, avg(x0) AS m FROM i GROUP BY 1, 2), m AS (SELECT doc, min_by(m, (-n, q)) AS margin FROM b GROUP BY 1),
e AS (SELECT doc, list_sort(list(x1))[least(count(*) - 1, floor(count(*) * 0.95)::BIGINT) + 1] AS edge FROM i GROUP BY 1)"""


@query("WITH " + ITEMS + ", " + STATS + " SELECT doc, round(any_value(margin), 6) AS margin, round(any_value(edge), 6) AS edge, sum((x1 - x0 >= (edge - margin) * 0.7)::INT) >= count(*) * 0.15 AS single FROM i JOIN m USING (doc) JOIN e USING (doc) GROUP BY doc")
def layout_stats(spark, sf_dir):
    out = layout.flow_statistics(page_items(spark, sf_dir)[0], ["doc"], "seq")
    return out.select("doc", F.round("margin", 6).alias("margin"), F.round("edge", 6).alias("edge"), "single")


@query("""WITH p AS (SELECT p_partkey AS item, CASE p_partkey % 3 WHEN 0 THEN 'figure_title' WHEN 1 THEN 'table' ELSE 'text' END AS label, (p_partkey % 10) / 10.0::DOUBLE AS score, (p_partkey * 37 % 900 - 50)::DOUBLE AS x0, (p_partkey * 53 % 900 - 50)::DOUBLE AS y0, p_size * 15.0::DOUBLE AS w, p_size + 0.5::DOUBLE AS h FROM part),
c AS (SELECT item, label, score, greatest(0, least(x0, 700.0)) AS x0, greatest(0, least(y0, 800.0)) AS y0, greatest(0, least(x0 + w, 700.0)) AS x1, greatest(0, least(y0 + h, 800.0)) AS y1 FROM p WHERE score >= 0.3),
l AS (SELECT *, CASE WHEN label = 'figure_title' AND (score < 0.6 OR x1 - x0 > 350) THEN 'text' ELSE label END AS told FROM c WHERE x1 > x0 AND y1 > y0)
SELECT item, told AS label, CASE WHEN told IN ('figure_title', 'table') THEN 'secondary' ELSE 'main' END AS flow, round_even(x0, 0)::INT || ',' || round_even(y0, 0)::INT || ',' || round_even(x1, 0)::INT || ',' || round_even(y1, 0)::INT AS box FROM l""")
def box_process(spark, sf_dir):
    """Parts as detections: some weak, some off the page, some captions too wide."""
    k = F.col("p_partkey")
    x0, y0 = (k * 37 % 900 - 50).cast("double"), (k * 53 % 900 - 50).cast("double")
    label = F.when(k % 3 == 0, "figure_title").when(k % 3 == 1, "table").otherwise("text")
    raw = table(spark, sf_dir, "part").select(k.alias("item"), label.alias("label"), (k % 10 / 10).alias("score"), x0.alias("x0"), y0.alias("y0"), (x0 + F.col("p_size") * 15.0).alias("x1"), (y0 + F.col("p_size") + 0.5).alias("y1"), F.lit(700).alias("width"), F.lit(800).alias("height"))
    return layout.detections(raw).select("item", "label", layout.flow(F.col("label")).alias("flow"), F.array_join(F.col("box").cast("array<string>"), ",").alias("box"))


BOXES = """b AS (SELECT p_size AS page, p_partkey AS box, (p_partkey % 7)::DOUBLE AS x0, (p_partkey % 5)::DOUBLE AS y0, p_partkey % 7 + 1.0 + p_partkey % 3 AS x1, p_partkey % 5 + 2.0 AS y1 FROM part)"""


@query("WITH " + BOXES + """, p AS (SELECT (l_orderkey % 50 + 1)::INT AS page, l_orderkey * 8 + l_linenumber AS point, l_quantity / 5 AS x, l_discount * 60 AS y FROM lineitem)
SELECT page, point, min_by(box, (-(x1 - x0) * (y1 - y0), box)) AS box FROM p JOIN b USING (page) WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY 1, 2""")
def box_assign(spark, sf_dir):
    k = F.col("p_partkey")
    boxes = table(spark, sf_dir, "part").select(F.col("p_size").alias("page"), k.alias("box"), (k % 7).cast("double").alias("x0"), (k % 5).cast("double").alias("y0"), (k % 7 + 1.0 + k % 3).alias("x1"), (k % 5 + 2.0).alias("y1"))
    points = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50 + 1).cast("int").alias("page"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("point"), (F.col("l_quantity") / 5).alias("x"), (F.col("l_discount") * 60).alias("y"))
    return layout.assigned(points, boxes)


@query("""WITH s AS (SELECT l_suppkey, l_extendedprice AS lo, l_extendedprice + l_quantity AS hi FROM lineitem),
n AS (SELECT *, CASE WHEN lo >= max(hi) OVER w THEN 1 WHEN max(hi) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM s WINDOW w AS (PARTITION BY l_suppkey ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, sum(new) OVER (PARTITION BY l_suppkey ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS band FROM n)
SELECT l_suppkey, min(lo) AS low, max(hi) AS high, count(*) AS n FROM b GROUP BY l_suppkey, band""")
def band_merge(spark, sf_dir):
    spans = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_extendedprice").alias("lo"), (F.col("l_extendedprice") + F.col("l_quantity")).alias("hi"))
    return layout.bands(spans, ["l_suppkey"], "lo", "hi").drop("band")


def sheet(spark, sf_dir):
    """Sparse cells from every row of lineitem."""
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 5).alias("sheet"), F.col("l_orderkey").alias("row"), (F.col("l_partkey") % 12).alias("col")).agg(F.max(F.col("l_partkey").cast("string")).alias("text"))


SHEET = "c AS (SELECT l_suppkey % 5 AS sheet, l_orderkey AS row, l_partkey % 12 AS col, max(l_partkey::VARCHAR) AS text FROM lineitem GROUP BY 1, 2, 3)"


@query("WITH " + SHEET + " SELECT sheet, row, col, CASE WHEN (sheet = 1 AND row BETWEEN 10 AND 90 AND col BETWEEN 2 AND 6) OR (sheet = 2 AND row BETWEEN 0 AND 40 AND col BETWEEN 0 AND 3) THEN '' ELSE text END AS text FROM c")
def pivot_mask(spark, sf_dir):
    """The ranges alone decide which cells are blank."""
    ranges = spark.createDataFrame([(1, 10, 2, 90, 6), (2, 0, 0, 40, 3)], "sheet long, r0 long, c0 long, r1 long, c1 long")
    return layout.masked(sheet(spark, sf_dir), ranges)


@query("WITH " + SHEET + ", r AS (SELECT sheet, row, max(col) AS w, map_from_entries(list((col, text))) AS m FROM c GROUP BY 1, 2) SELECT sheet, row, array_to_string(list_transform(range(0, w + 1), lambda i: coalesce(m[i], '')), ',') AS cells FROM r")
def densify_rows(spark, sf_dir):
    return layout.dense_rows(sheet(spark, sf_dir)).withColumn("cells", F.array_join("cells", ","))


def page_boxes(spark, sf_dir):
    k = F.col("p_partkey")
    x0, y0 = (k * 37 % 700).cast("double"), (k * 53 % 900).cast("double")
    return table(spark, sf_dir, "part").select((k % 40).alias("page"), k.alias("seq"), x0.alias("x0"), y0.alias("y0"), (x0 + 20 + F.col("p_size") * 3).alias("x1"), (y0 + 8 + k % 11).alias("y1"))


@query()
def xy_cut_order(spark, sf_dir):
    return layout.arranged(page_boxes(spark, sf_dir), ["page"], 1000.0, 1000.0).select("page", "seq", "place")


@query()
def box_clean(spark, sf_dir):
    return layout.uncovered(page_boxes(spark, sf_dir), ["page"]).select("page", "seq")


@query()
def span_greedy(spark, sf_dir):
    """Of each user's events as spans of half a minute, the best that do not overlap."""
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    spans = table(spark, sf_dir, "events").select("user_id", at.alias("start"), (at + 30).alias("stop"), F.col("value").cast("double").alias("score"), F.col("event_id").alias("seq"))
    return layout.chosen_spans(spans, ["user_id"])
