"""Parts that have no SQL: chunkers, expressions, pairing, the store, streaming, file types."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.expression import ExpressionError, evaluate, math_expression, number_text
from lectern.operators import chunk, graph, rank
from lectern.sources.files import documents_of, file_type, first_levels, folder_of, listing, whole_texts
from lectern.sources.store import Store
from lectern.streaming.ingest import ingest_stream


def test_sentences():
    assert [s for s, *_ in chunk.sentences("Pi is 3.14. See a.b! Done?\nYes… 好。你")] == ["Pi is 3.14.", "See a.b!", "Done?", "Yes…", "好。", "你"]
    assert chunk.sentences(" \n ") == []


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n好!x1", max_size=600))
def test_chunks_hold_all_words(text):
    words = text.split()
    told = chunk.relation_chunks(text, 20, 1)
    assert "".join("".join(told).split()) == "".join(words)
    assert all(chunk.estimate(c) <= 20 or len(c) <= 20 for c in told)
    assert not set("".join("".join(chunk.citation_chunks(text, 20, 5)).split())) ^ set("".join(words))


def test_overlap():
    text = " ".join(f"Sentence number {k} is here." for k in range(200))
    told = chunk.citation_chunks(text)
    assert all(chunk.estimate(c) <= 260 for c in told)
    assert all(a.split(". ")[-1].rstrip(".") in b for a, b in zip(told, told[1:]))


def test_relation_chunks_that_are_too_short_go():
    assert chunk.relation_chunks("Too short.") == []
    long = " ".join(f"Sentence number {k} is here for good." for k in range(60))
    told = chunk.relation_chunks(long + " " + "word " * 10)
    assert all(25 <= chunk.estimate(c) <= 250 for c in told) and len(told) == 3


def test_word_spans_and_words(spark):
    assert list(chunk.word_spans("漢字ab x-y_z! 漢-b")) == [("漢", 0, 1), ("字", 1, 2), ("ab", 2, 4), ("x-y_z", 5, 10), ("!", 10, 11), ("漢", 12, 13), ("-b", 13, 15)]
    texts = ["漢字ab", "x-y_z! 漢-b", "plain words, 3.14", "", "\u3000é\x1c?", "ａｂ 12"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.words(F.col("t")).alias("w")).collect()
    assert all(r.w == [w for w, *_ in chunk.word_spans(r.t)] for r in rows), rows


def test_names_and_lists(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).head().x
    assert one(T.node_name(T.nfkc(F.lit("  Ａｂ\u3000 c\t")))) == "ab c" == T.plain_name("  Ａｂ\u3000 c\t")
    for text, lists in {", ": True, " and ": True, " ": True, " met ": False, " oppure ": True, "、と": True, " ou ": True, "and and": False, " y; ": True, "ならびに": True, None: True}.items():
        assert one(T.enumerates(F.lit(text).cast("string"))) is lists, text
    for name, valid in {"ab": False, "abc": True, " ab ": False, "漢字": True, "漢": False, "see http": False, None: False}.items():
        assert one(T.entity_valid(F.lit(name).cast("string"))) is valid, name
    assert one(T.whole_numbers(F.array(*map(F.lit, ["3.9", "2", "x", ""])))) == [3, 2]
    assert one(T.row_numbers(F.array(*map(F.lit, [3, -1, 0, 3, 2])))) == [3, 2]


@pytest.mark.parametrize("text", ["a\nb", "a\n---\n \n", "a\nSECONDARY ELEMENT:\nb", " SECONDARY ELEMENT: \nx", "a\n\n--- \n\t\nSECONDARY ELEMENT:\nSECONDARY ELEMENT:", "", "---", "a ---", "x\nSECONDARY ELEMENT: no\n---", "a\r\n---\r"])
def test_appendix(spark, text):
    assert spark.range(1).select(T.primary_text(F.lit(text)).alias("t")).head().t == chunk.primary_text(text)


def test_table_chunks_by_the_limit():
    """The tokens of the chunk, the row and one more must fit; a row without cells is one; cells beyond the head go; a first row that is too long leaves the title alone."""
    head = "# S\n| row | A |\n| --- | --- |\n"
    assert chunk.table_chunks("f", head + "| 1 | x | y |\n| 2 | |") == ["f - S\nrow 1: A=x\nrow 2: "]
    assert chunk.table_chunks("f", head + "note\n") == []
    assert chunk.table_chunks("f", head + f"| 1 | {'x' * 1200} |") == ["f - S", f"f - S\nrow 1: A={'x' * 1200}"]
    told = chunk.table_chunks("f", head + "\n".join(f"| {k} | {'v' * 80} |" for k in range(40)))
    assert all(chunk.estimate(c) <= 250 for c in told) and sum(c.count("row ") for c in told) == 40


def test_table_chunks():
    told = chunk.table_chunks("f.xlsx", "# S\n| | A | B |\n|---|---|---|\n| 1 | x | |\n| 2 | a\\|b | 3 |\nMerge: A1\n# T\n| | A |\n| 1 | q |")
    assert told == ["f.xlsx - S\nrow 1: A=x\nrow 2: A=a|b, B=3\nMerge: A1", "f.xlsx - T\nrow 1: A=q"]


@pytest.mark.parametrize(("text", "told"), [("1+2*3", "7"), ("2^3^2", "512"), ("-2^2", "4"), ("(1+2)*-3", "-9"), ("0.1+0.2", "0.30000000000000004"), ("1/0", "Infinity"), ("-1/0", "-Infinity"), ("0/0", "NaN"), ("10^21", "1e+21"), ("1/10000000", "1e-7"), ("5-3-1", "1"), (" 4 ", "4")])
def test_expression(text, told):
    assert number_text(evaluate(text)) == told


@pytest.mark.parametrize("text", ["1.2.3", "2+", "-(1)", "(1", "1)", "a", "", "1 2"])
def test_expression_errors(text):
    with pytest.raises(ExpressionError):
        evaluate(text)


def test_expression_column(spark):
    rows = spark.createDataFrame([("1+1",), ("x",), (None,)], "e string").select(math_expression("e").alias("r")).select("r.*").collect()
    assert [r.text for r in rows] == ["2", None, None] and rows[1].error and not math.isnan(rows[0].value)


def pairs_by_hand(mentions):
    """The sequential rule: keep a group; a mention that only a list parts from it joins, one near it that words part is linked."""
    out, group, last = [], [], None
    for start, stop, name, lists in mentions:
        near = last is not None and 0 <= start - last <= graph.GAP
        if near and lists:
            group.append(name)
        else:
            if near:
                out += [(g, name) for g in group if g != name]
            group = [name]
        last = stop
    return set(out)


def test_relation_pairs(spark):
    rng, rows, want = random.Random(4), [], set()
    for c in range(60):
        at, mentions = 0, []
        for _ in range(rng.randint(1, 8)):
            at += rng.choice([1, 5, 30, 80])
            mentions.append((at, at + 3, rng.choice("abcd"), rng.random() < 0.5))
            at += 3
        want |= {(c, a, b) for a, b in pairs_by_hand(mentions)}
        rows += [(c, 0, s, e, n, ", and " if k else " founded ") for s, e, n, k in mentions]
    df = spark.createDataFrame(rows, "chunk_id int, sentence int, start int, stop int, name string, between string")
    assert {(r.chunk_id, r.source, r.target) for r in graph.relation_pairs(df).collect()} == want


def test_budget_passes_over_what_does_not_fit(spark):
    rows = [("g", 0, 0.9, "a", 1500), ("g", 1, 0.8, "b", 600), ("g", 2, 0.7, "a", 10), ("g", 3, 0.6, "c", 500), ("g", 4, 0.0004, "d", 1)]
    df = spark.createDataFrame(rows, "g string, seq long, score double, description string, tokens long")
    assert [r.seq for r in rank.budgeted(df, "g").orderBy("place").collect()] == [0, 3]


def test_wide_text(spark):
    row = spark.createDataFrame([("abcde好你",)], "t string").select(T.token_estimate(F.col("t")).alias("n"), T.sentence_count(F.lit("好。你")).alias("s")).head()
    assert row.n == 4 == chunk.estimate("abcde好你") and row.s == 2


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    rows = lambda t: spark.createDataFrame([(0, t)], "id long, chunk string").withColumn("embedding", F.array(F.lit(1.0).cast("float")))
    assert store.put("t", "a.md", {"chunks": rows("one")}) == "ok"
    assert store.put("t", "a.md", {"chunks": rows("two")}) == "ok"  # complete: not done again
    assert store.put("t", "b.md", {"chunks": rows("three")}) == "ok"
    assert sorted(r.chunk for r in store.table("chunks", "t").collect()) == ["one", "three"]
    store.delete("t", "a.md")
    assert [r.chunk for r in store.table("chunks", "t").collect()] == ["three"] and store.file_id("t", "a.md") == 0
    store.delete("t", "unknown")
    assert store.put("t", "", {}) == "ko"


def test_stream_stores_each_file_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.md").write_text("First. Second.")
    store = Store(spark, f"file://{tmp_path}/store")
    for _ in range(2):
        ingest_stream(spark, f"file://{folder}", store, "t", f"file://{tmp_path}/check").awaitTermination()
        (folder / "b.md").write_text("Third.")
    assert sorted(r.chunk for r in store.table("chunks", "t").collect()) == ["First. Second.", "Third."]
    assert listing(spark, f"file://{folder}").count() == 2 and whole_texts(spark, f"file://{folder}").count() == 2


def test_file_type(spark):
    cases = [(b"%PDF-1", "x.png", "pdf"), (b"PK\x03\x04..", "x.zip", "zip"), (b"PK\x03\x04..", "a.docx", "docx"), (b"nothing", "x.PNG", "png"), (b"nothing", "x.q", None), (b"RIFF....WAVE", "x", "wav"), (b"RIFF....WEBP", "x", "webp"), (b"RIFF....none", "x", None)]
    cases += [(b"....ftypavif", "x", "mp4"), (b"II*\x00", "x", "tiff"), (b"\xff\xd8", "", None), (b"", "a/b.tar.gz", "gz"), (None, "x.md", "md")]
    df = spark.createDataFrame(cases, "c binary, p string, want string")
    assert all(r.e == r.want for r in df.select("want", file_type(F.col("c"), F.col("p"))["extension"].alias("e")).collect())


def test_listings(spark):
    df = spark.createDataFrame([("a/a.pdf",), ("a/a.pdf.md",), ("b.txt",), ("c/d/d.md",), ("c/d/x.md",)], "path string")
    assert {r.name for r in first_levels(df).collect()} == {"a/", "b.txt", "c/"}
    assert {r.path for r in documents_of(df).collect()} == {"a/a.pdf", "a/a.pdf.md", "c/d/d.md"}
    assert folder_of(df, "x.md").head().folder == "c/d" and folder_of(df, "none").isEmpty()
