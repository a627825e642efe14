import pytest
from pyspark.sql import functions as F

from lectern.models import CapitalTagger, HashingEmbedder
from lectern.plans.search import ingest, ingest_files
from lectern.sources.store import Store

from .test_search import SHEET, TEXTS

FILES = "name string, text string"


def rows(store, table, tenant="t"):
    return sorted(map(str, store.table(table, tenant).collect()))


def test_one_plan_equals_file_by_file(spark, tmp_path):
    """Also a tenant whose name is no plain folder name; null, empty, nameless and repeated files."""
    embedder, given = HashingEmbedder(16), {**TEXTS, "stock.xlsx": SHEET}
    one, many = (Store(spark, f"file://{tmp_path}/{n}", buckets=3) for n in ("one", "many"))
    for name, text in given.items():
        ingest(spark, one, "a/b=c", name, text, embedder, CapitalTagger())
    files = [*given.items(), ("none.md", None), ("empty.md", ""), ("", "some text"), (None, "some text"), ("cakes.md", TEXTS["cakes.md"])]
    got = ingest_files(spark, many, "a/b=c", spark.createDataFrame(files, FILES), embedder, CapitalTagger())
    assert {r.name: r.status for r in got.collect()} == {**dict.fromkeys(given, "ok"), "none.md": "ko", "empty.md": "ko", "": "ko"}
    for table in ("chunks", "nodes", "node_vec", "edges", "edge_vec"):
        assert rows(one, table, "a/b=c") == rows(many, table, "a/b=c") != []
    assert not list(tmp_path.glob("many/_work/*"))
    before = rows(many, "edges", "a/b=c")
    many.delete("a/b=c", "rivers.md")
    assert {r.name for r in many.files("a/b=c").collect()} == {"cakes.md", "stock.xlsx"}
    assert ingest_files(spark, many, "a/b=c", spark.createDataFrame(files, FILES), embedder, CapitalTagger()).filter("status = 'ok'").count() == 3
    assert rows(many, "edges", "a/b=c") == before
    assert many.table("chunks", "other").isEmpty() and ingest_files(spark, many, "other", spark.createDataFrame([], FILES), embedder, CapitalTagger()).isEmpty()


def test_edges_of_files_alike_stay_apart(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    twice = [("a.md", TEXTS["rivers.md"]), ("b.md", TEXTS["rivers.md"])]
    ingest_files(spark, store, "t", spark.createDataFrame(twice, FILES), HashingEmbedder(16), CapitalTagger())
    assert store.table("edges", "t").count() == store.table("edge_vec", "t").select("file_id", "edge_id").distinct().count() == 4


class Failing(HashingEmbedder):
    def embed(self, mode, texts):
        if any(t.startswith("Acme Labs:") for t in texts):
            raise ValueError("no vector")
        return super().embed(mode, texts)


def test_failed_and_broken_runs(spark, tmp_path):
    """A run that fails purges its rows; what one that was killed left goes before its files are stored again. Other files stay."""
    store, embedder = Store(spark, f"file://{tmp_path}/store", buckets=1), HashingEmbedder(16)
    assert ingest(spark, store, "t", "cakes.md", TEXTS["cakes.md"], embedder, CapitalTagger()) == "ok"
    cakes = rows(store, "chunks")
    with pytest.raises(Exception, match="no vector"):
        ingest(spark, store, "t", "rivers.md", TEXTS["rivers.md"], Failing(16), CapitalTagger())
    assert rows(store, "chunks") == cakes and [r.name for r in store.table("files", "t").filter("name = 'rivers.md'").collect()] == []
    # Killed after its chunks: journal and chunks are there, no complete file.
    ids = spark.createDataFrame([("rivers.md",)], "name string").select(store.id_of("t", F.col("name")).alias("file_id"), "name")
    store.begin("t", ids)
    store.append("chunks", ids.selectExpr("'t' tenant", "0L id", "file_id", "'half' chunk", "cast(null as array<float>) embedding"))
    assert store.file_id("t", "rivers.md") == 0
    assert ingest(spark, store, "t", "rivers.md", TEXTS["rivers.md"], embedder, CapitalTagger()) == "ok"
    assert store.table("chunks", "t").filter("chunk = 'half'").isEmpty() and set(cakes) < set(rows(store, "chunks"))


