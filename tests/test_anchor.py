from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.models import HashingEmbedder, OverlapReranker
from lectern.plans.search import search
from lectern.sources.store import Store

CASES = [
    (["ab"], "ab", False, False),
    (["art"], "an artist", True, False),
    (["art"], "smart", False, False),
    (["art"], "\u00e9art", False, False),
    (["a.b?c"], "x a.b?c y", True, False),
    (["a.b?c"], "x aXbc y", False, False),
    (["R&D \\E"], "the r&d \\e lab", True, False),
    (["\u6f22\u5b57"], "plain", False, True),
    (["\u6f22\u5b57"], "\u524d\u6f22\u5b57", True, False),
    (["\u6f22"], "\u6f22", False, False),
    (["\u6f22\u5b57", "art"], "plain", False, False),
    ([], "plain", False, False),
]


def test_anchors(spark):
    for terms, text, held, impossible in CASES:
        row = spark.range(1).select(T.anchored(F.lit(text), terms).alias("a"), T.anchor_impossible(F.lit(text), terms).alias("b")).head()
        assert tuple(row) == (held, impossible), (terms, text)


def test_anchored_chunks_beyond_the_gate(spark, tmp_path):
    embedder, store = HashingEmbedder(32), Store(spark, f"file://{tmp_path}/store")
    far = [-x for x in embedder.embed("query", ["about turin"])[0]]
    texts = ["turin one", "turin two", "turin three", "not a word of it about"]
    store.put("t", "a.md", {"chunks": spark.createDataFrame([(k, t, far) for k, t in enumerate(texts[:3])], "id long, chunk string, embedding array<float>")})
    store.put("t", "b.md", {"chunks": spark.createDataFrame([(0, "nothing here", far)], "id long, chunk string, embedding array<float>")})
    found = search(spark, store, "t", "about turin", ["turin"], embedder, OverlapReranker())
    assert {r.chunk for r in found.citations.collect()} == set(texts[:3])
