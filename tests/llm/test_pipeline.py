import collections
import re
import zlib

import corpus_pipeline as P
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lectern.llm.toxicity import learned

from .conftest import EDGES, SCHEMA, rows_of
from .test_models import base_spans
from .test_near_join import brute as near_brute
from .test_near_join import shingles
from .test_tokens import laid_out


def plain_redaction(text):
    spans = sorted((int(a), int(z), k) for k, a, z in (s.split(":") for s in base_spans(text)))
    out, at = "", 0
    for a, z, k in spans:
        if a >= at:
            out += text[at:a] + f"<{k.upper()}>"
        at = max(at, z)
    return out + text[at:]


def test_stages_on_edges(spark, none):
    near = " ".join(f"w{k}" for k in range(60))
    pairs = EDGES + [(50, near, "s"), (51, near + " x", "s"), (52, near.replace(" ", "\n"), "s")]
    docs = spark.createDataFrame(rows_of(pairs), SCHEMA)
    exact = P.exact_dedup(spark, docs, "")
    assert exact.schema == docs.schema
    left = sorted((r.doc_id if r.doc_id is not None else -1) for r in exact.collect())
    best = {}
    for i, t, _ in pairs:
        key = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best[key] = min(best.get(key, (1, True, 0)), (-len(t or ""), i is None, i if i is not None else 0))
    assert left == sorted(-1 if z else i for _, z, i in best.values())
    near_left = sorted((r.doc_id if r.doc_id is not None else -1) for r in P.near_dedup(spark, exact, "").collect())
    assert 51 not in near_left and 50 in near_left and -1 in near_left and set(near_left) <= set(left)
    assert len(shingles(near)) == 56
    for stage in (P.exact_dedup, P.near_dedup, P.private_data):
        assert stage(spark, none, "").count() == 0


def test_rows_that_share_an_id(spark):
    """The first row is a copy of the last; the second shares its id but not its text."""
    pairs = [(5, "same text here", "s"), (5, "other words", "s"), (3, "same text here", "s"), (3, "same  text here", "t"), (3, "same  text here", "s"), (None, "same  text here", "s")]
    out = P.exact_dedup(spark, spark.createDataFrame(rows_of(pairs), SCHEMA), "").collect()
    assert sorted((r.doc_id, r.text, r.source) for r in out) == [(3, "same  text here", "s"), (5, "other words", "s")]
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    pairs = [(5, a, "s"), (5, a, "t"), (5, b, "s"), (9, b + " x", "s"), (7, "c", "s")]
    out = P.near_dedup(spark, spark.createDataFrame(rows_of(pairs), SCHEMA), "").collect()
    assert sorted((r.doc_id, r.text, r.source) for r in out) == [(5, a, "s"), (5, b, "s"), (7, "c", "s")]


def test_toxicity_and_packing_on_edges(spark, sf_dir, edges, none):
    model = learned(edges, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    got = P.toxicity(spark, edges, sf_dir)
    assert got.schema == edges.schema
    want = collections.Counter((i, t) for i, t, _ in EDGES if model.score(t or "") < 0.3)
    assert collections.Counter((r.doc_id, r.text) for r in got.collect()) == want
    pieces = P.packing(spark, edges, sf_dir).collect()
    assert collections.Counter(r.doc_id for r in pieces if r.piece == 0) == collections.Counter(i for i, *_ in EDGES)
    assert P.toxicity(spark, none, sf_dir).count() == P.packing(spark, none, sf_dir).count() == 0


def test_redaction(spark):
    pairs = [e for e in EDGES if e[0] not in (10, 13)] + [(60, "a@b.co 10.0.0.1x +1 (663) 555-6869", "s"), (61, "nothing", "s"), (62, "x@1.2.3.4 y", "s")]
    df = spark.createDataFrame(rows_of(pairs), SCHEMA)
    got = sorted((r.doc_id or 0, r.text or "", r.n_chars or 0) for r in P.private_data(spark, df, "").collect())
    want = sorted((i or 0, plain_redaction(t or ""), len(plain_redaction(t or ""))) for i, t, _ in pairs)
    assert got == want


def test_run(spark):
    """All stages against plain versions of them, one after the other."""
    sf_dir = "/root/testdata/sf0.01"
    docs = P.documents(spark, sf_dir)
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    model = learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    left = {i: t for i, t in rows.items() if model.score(t) < 0.3}
    assert 0 < len(left) < len(rows)
    best = {}
    for i, t in left.items():
        key = re.sub(r"[\x20\x09-\x0D]", "", t)
        best[key] = min(best.get(key, (1, i)), (-len(t), i))
    left = {i: left[i] for _, i in best.values()}
    pairs = [(i, t) for i, t in sorted(left.items())]
    near = {d: c for d, _, c in near_brute(pairs)}
    assert any(d != c for d, c in near.items())
    left = {i: t for i, t in left.items() if near[i] == i}
    # The trees add secrets, and only those, on these documents.
    secret = r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|(?i:token|secret|password|api_key)\x20?=\x20?\"?[0-9a-z]{16,})"
    clean = {}
    for i, t in left.items():
        spans = [(int(a), int(z), k) for k, a, z in (s.split(":") for s in base_spans(t))] + [(m.start(), m.end(), "secret") for m in re.finditer(secret, t)]
        out, at, kind = "", 0, None
        for a, z, k in sorted(spans):
            if a >= at:
                out += t[at:a] + f"<{k.upper()}>"
            at = max(at, z)
        clean[i] = out + t[at:]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for i, t in clean.items():
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        first = len(ids) if len(ids) <= 2048 else len(ids) % 2048 or 2048
        for piece, at in enumerate([0, *range(first, len(ids), 2048)]):
            part = ids[at : at + 2048] if at else ids[:first]
            want[i, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    got = P.run(spark, sf_dir).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert laid_out(got, 2048) <= 1.05 * -(-sum(r.length for r in got) // 2048) + 1
