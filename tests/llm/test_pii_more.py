"""Candidates beyond the base formats, their labels, and spans that overlap."""

import re

from pyspark.sql import functions as F

from lectern.llm.pii import Trees, candidates, redacted, selected

from .conftest import SCHEMA, rows_of


def test_labels(spark):
    texts = {"call 555-123-4567 now": "phone", "Call me at 030 123 4567 now": "phone", "API_KEY=aZbYcXdWeVfU": "secret", "PASSWORD=horse-battery": "secret", "Token: 0641917ea4e9feb9": "secret", "SSN 123-45-6789 x": "ssn", "de89370400440532013000": "iban", "GB82 WEST 1234 5698 7654 32": "iban"}
    df = spark.createDataFrame(rows_of([(k, t, "s") for k, t in enumerate(texts)]), SCHEMA)
    got = {r.id: {s.span for s in r.proposed if s.yes} for r in candidates(df).collect()}
    assert all(kind in got[k] for k, kind in enumerate(texts.values())), got
    wrong = spark.createDataFrame(rows_of([(0, "DE88370400440532013000 and 123-45-6789 and 4111.1111.1111.1112", "s")]), SCHEMA)
    assert not any(s.yes for s in candidates(wrong).head().proposed)
    plain = spark.createDataFrame(rows_of([(0, "part 555-123-4567 in stock", "s")]), SCHEMA)
    assert not any(s.yes for s in candidates(plain).head().proposed)


def test_greedy_overlaps(spark):
    """Of a chain, the shortest stays when what it touches has gone."""
    span = "struct<span:string,start:int,stop:int>"
    df = spark.range(1).select("id", F.array().cast(f"array<{span}>").alias("base"), F.expr("array(named_struct('span', 'card', 'start', 0, 'stop', 10), named_struct('span', 'card', 'start', 8, 'stop', 16), named_struct('span', 'card', 'start', 15, 'stop', 18), named_struct('span', 'ssn', 'start', 30, 'stop', 40))").alias("proposed"))
    import lectern.llm.pii as pii

    saved, pii.Trees.column = pii.Trees.column, lambda self, s: F.lit(0.0)
    try:
        row = selected(df, Trees(0.0, [], {"card": 0.0, "ssn": 0.0})).head()
    finally:
        pii.Trees.column = saved
    assert {(s.start, s.stop) for s in row.added} == {(0, 10), (15, 18), (30, 40)} and len(row.picked) == 4


def test_phones_are_redacted(spark):
    texts = [f"call 555-{k % 900 + 100}-{k + 1000} and part {k % 90 + 10}.{k + 1000}.{k + 1000} is here" for k in range(400)]
    df = spark.createDataFrame(rows_of([(k, t, "s") for k, t in enumerate(texts)]), SCHEMA)
    out = redacted(spark, df).select("text").collect()
    assert sum("call <PHONE> and part" in r.text for r in out) == len(texts), out[:2]
    assert all(re.search(r"part [0-9]", r.text) for r in out)


def test_selection_against_brute_force(spark):
    """Which picked spans touch a base span, and which of the rest are taken, from random spans."""
    import random

    import lectern.llm.pii as pii

    rng = random.Random(9)
    span = lambda: (rng.choice(["card", "ssn"]), a := rng.randrange(300), a + rng.randrange(1, 20))
    rows = [(k, [span() for _ in range(rng.choice([0, 1, 8]))], [span() for _ in range(rng.choice([0, 1, 2, 30]))]) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, base array<struct<span:string,start:int,stop:int>>, proposed array<struct<span:string,start:int,stop:int>>")
    saved, pii.Trees.column = pii.Trees.column, lambda self, s: F.lit(0.0)
    try:
        got = {r.id: [tuple(s) for s in r.added] for r in selected(df, Trees(0.0, [], {"card": 0.0})).collect()}
    finally:
        pii.Trees.column = saved
    for k, base, proposed in rows:
        free = [s for s in proposed if s[0] == "card" and not any(s[1] < b[2] and b[1] < s[2] for b in base)]
        want, at = [], 0
        for s in sorted(free, key=lambda s: (s[1], -s[2])):
            if s[1] >= at:
                want.append(s)
                at = s[2]
        assert sorted(got[k]) == sorted(want)
