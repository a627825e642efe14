from lectern.models import CapitalTagger, HashingEmbedder, OverlapReranker
from lectern.plans.search import expanded, ingest, search
from lectern.sources.store import Store

TEXTS = {
    "rivers.md": "The river Po crosses Turin. In spring Maria Rossi and Luca Bianchi studied the Po with Acme Labs. They met in Turin again.",
    "cakes.md": "A cake needs flour, sugar and eggs. Bake it for an hour. Some add lemon.",
}


def test_store_and_search(spark, tmp_path):
    store, embedder = Store(spark, f"file://{tmp_path}/store"), HashingEmbedder(32)
    for name, text in TEXTS.items():
        assert ingest(spark, store, "t", name, text, embedder, CapitalTagger()) == "ok"
    assert ingest(spark, store, "t", "cakes.md", "other", embedder, CapitalTagger()) == "ok"
    assert store.table("chunks", "t").filter("chunk = 'other'").isEmpty()
    found = search(spark, store, "t", "who studied the river", ["Maria Rossi"], embedder, OverlapReranker())
    citations = found.citations.orderBy("place").collect()
    assert citations[0].file == "rivers.md" and [c.place for c in citations] == sorted(c.place for c in citations)
    assert any(n.name == "Maria Rossi" and n.degree > 0 for n in found.nodes.collect())
    edges = {(e.source, e.target) for e in found.graph.collect()}
    assert ("maria rossi", "acme labs") in edges
    assert store.table("nodes", "t").filter("name_normalized = 'po'").isEmpty()  # a name of two letters is no entity (P9)
    store.delete("t", "rivers.md")
    assert search(spark, store, "t", "who studied the river", ["Maria Rossi"], embedder, OverlapReranker()).nodes.count() == 0
    assert search(spark, store, "nobody", "x", [], embedder, OverlapReranker()).citations.count() == 0


def test_expanded():
    assert expanded("about turin", ["Turin", "Po"]) == "about turin Po"


SHEET = "# Stock\n\n| row | A | B |\n| --- | --- | --- |\n" + "\n".join(f"| {k} | Widget Alpha {k} | {k * 3} |" for k in range(2, 60)) + "\n\n---\n\nSECONDARY ELEMENT:\n\nhidden note"


def test_sheets_rows_and_file_limits(spark, tmp_path):
    store, embedder = Store(spark, f"file://{tmp_path}/store"), HashingEmbedder(32)
    assert ingest(spark, store, "t", "stock.xlsx", SHEET, embedder, CapitalTagger()) == "ok"
    assert ingest(spark, store, "t", "rivers.md", TEXTS["rivers.md"], embedder, CapitalTagger()) == "ok"
    assert ingest(spark, store, "t", "none.md", "---\n\nSECONDARY ELEMENT:\nall of it", embedder, CapitalTagger()) == "ko"
    told = [r.chunk for r in store.table("chunks", "t").filter("chunk like 'stock.xlsx - Stock%'").collect()]
    assert len(told) > 1 and not any("hidden" in c for c in told)
    assert store.table("nodes", "t").filter("type = 'file'").head().name == "stock.xlsx"
    found = search(spark, store, "t", "stock of row 7", ["stock.xlsx"], embedder, OverlapReranker(), rows=[7, 0, 7, -1])
    rows = found.citations.collect()
    assert [r.file for r in rows] == ["stock.xlsx"] and "\nrow 7:" in rows[0].chunk and rows[0].distance == 0.0
    names = {n.name for n in found.nodes.collect()}
    assert "stock.xlsx" in names and not names & {"Maria Rossi", "Turin", "Acme Labs"}
    # Rows that no sheet has leave the citations as they are.
    plain = search(spark, store, "t", "who studied the river", ["Maria Rossi"], embedder, OverlapReranker(), rows=[7])
    assert {r.file for r in plain.citations.collect()} == {"rivers.md"}
    assert all(r.source != "widget alpha" for r in plain.graph.collect())
