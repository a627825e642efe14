import collections
import hashlib
import re

from lectern.llm.exact_dedup import exact_groups
from lectern.llm.quality_rules import host_rates, measured, quality_verdicts

from .conftest import EDGES, SCHEMA, rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def groups(pairs):
    by = collections.defaultdict(list)
    for i, t, *_ in pairs:
        by[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i))
    out = collections.Counter()
    for plain, rows in by.items():
        keep = min(rows)[2]
        for _, _, i in rows:
            out[i, keep, len(rows), i == keep, hashlib.sha256(plain.encode()).hexdigest()] += 1
    return out


def test_exact_groups(spark, edges, none):
    assert collections.Counter(map(tuple, exact_groups(spark, edges).collect())) == groups(EDGES)
    assert exact_groups(spark, none).count() == 0


def test_exact_groups_part_late(spark):
    """Texts of one length that differ only behind the first digits, or at the last byte."""
    long = "ab" * 5000
    pairs = [(k, t, "s") for k, t in enumerate([long + "x", long + "y", long[:5000] + " " + long[5000:] + "x", "c" * 40 + "d", "c" * 41, "c" * 40 + "d", *["same same"] * 50])]
    df = spark.createDataFrame(rows_of(pairs), SCHEMA)
    assert collections.Counter(map(tuple, exact_groups(spark, df).collect())) == groups(pairs)


def rules(text):
    text = text or ""
    words = WORD.findall(text)
    places = collections.defaultdict(list)
    for i in range(len(words) - 4):
        places[tuple(words[i : i + 5])].append(i)
    repeated = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated), n < 10 or 100 * len(repeated) > 20 * n


REPEATS = [(100, "a b c d e f a b c d e g\nx\nx\n \nx y #*<", "h"), (101, "a a a a a a a", "h"), (102, "p q r s t u v w x y z p q r s t " + "z1 z2 z3 z4 z5 z6 z7 z8 z9 " * 1, "h"), (103, "Ä ö ü 漢字 $ | > " * 7, None)]


def test_rules(spark, edges, none):
    pairs = EDGES + REPEATS
    df = spark.createDataFrame(rows_of(pairs), SCHEMA)
    got = collections.Counter(tuple(r)[:1] + tuple(r)[2:] for r in measured(df).collect())
    assert got == collections.Counter((i, *rules(t)) for i, t, _ in pairs)
    assert quality_verdicts(spark, none).count() == 0
    out = {r.doc_id: r for r in quality_verdicts(spark, df).collect()}
    assert not out[4].base_failed and not out[2].kept and len(out) == len({i for i, _, _ in pairs})


def test_host_verdict(spark):
    good = " ".join(f"w{k}" for k in range(30))
    pairs = [(k, good if k % 10 else "bad", "fine") for k in range(300)] + [(1000 + k, "bad" if k % 10 else good, "spam") for k in range(300)]
    df = spark.createDataFrame(rows_of(pairs), SCHEMA)
    out = {r.doc_id: r.kept for r in quality_verdicts(spark, df).collect()}
    assert out[1] and not out[0] and not out[1000] and not out[1001]
    rates = {r.host: r.rate for r in host_rates(measured(df)).collect()}
    assert 0.1 < rates["fine"] < 0.12 and 0.88 < rates["spam"] < 0.9
