from lectern.models import CapitalTagger, HashingEmbedder, OverlapReranker
from lectern.plans.search import ingest, search
from lectern.sources.store import Store
from lectern.streaming.ingest import ingest_stream

from .test_search import TEXTS


def test_search_after_a_stream(spark, tmp_path):
    folder, embedder = tmp_path / "in", HashingEmbedder(32)
    folder.mkdir()
    for name, text in TEXTS.items():
        (folder / name).write_text(text)
    store = Store(spark, f"file://{tmp_path}/store")
    ingest_stream(spark, f"file://{folder}", store, "t", f"file://{tmp_path}/check", embedder=embedder, tagger=CapitalTagger()).awaitTermination()
    assert store.table("chunks", "t").filter("embedding IS NULL").isEmpty()
    found = search(spark, store, "t", "who studied the river", ["Maria Rossi"], embedder, OverlapReranker())
    assert found.citations.orderBy("place").first().file == "rivers.md"
    assert ("maria rossi", "acme labs") in {(e.source, e.target) for e in found.graph.collect()}


def test_chunks_without_vectors(spark, tmp_path):
    """They take no place of chunks that have vectors, and their file can be ingested again."""
    embedder, store = HashingEmbedder(32), Store(spark, f"file://{tmp_path}/store")
    ingest(spark, store, "t", "rivers.md", TEXTS["rivers.md"], embedder, CapitalTagger())
    store.put("t", "old.md", {"chunks": spark.createDataFrame([(k, f"old {k}", None) for k in range(30)], "id long, chunk string, embedding array<float>")})
    found = search(spark, store, "t", "who studied the river", [], embedder, OverlapReranker())
    assert [r.file for r in found.citations.collect()] == ["rivers.md"]
    assert ingest(spark, store, "t", "old.md", TEXTS["cakes.md"], embedder, CapitalTagger()) == "ok"
    assert store.table("chunks", "t").filter("embedding IS NULL").isEmpty()
