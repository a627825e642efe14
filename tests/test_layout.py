import random

import numpy as np

from lectern.operators import layout


def test_reading_order():
    left, right = [(0, 10 * k, 40, 10 * k + 8) for k in range(4)], [(60, 10 * k, 100, 10 * k + 8) for k in range(4)]
    head = [(0, -30, 100, -20)]
    boxes = np.array(right + left, dtype=float)
    assert layout.reading_order(boxes, 100, 100) == [4, 5, 6, 7, 0, 1, 2, 3]
    with_head = np.array(right + left + head, dtype=float)
    assert layout.reading_order(with_head, 100, 100) == [8, 4, 5, 6, 7, 0, 1, 2, 3]
    assert layout.reading_order(np.zeros((0, 4)), 1, 1) == []


def test_widest_gap():
    assert layout.widest_gap(np.array([0.0, 5, 20]), np.array([10.0, 7, 30])) == (10.0, 15.0)
    assert layout.widest_gap(np.array([0.0, 5]), np.array([10.0, 7])) == (0.0, 0.0)


def test_chosen_spans(spark):
    rng = random.Random(3)
    rows = [(u, s := rng.randrange(200), s + rng.randrange(12), rng.random(), k) for k, u in enumerate(rng.choices(range(6), k=400))]
    want = set()
    for u in range(6):
        taken = []
        for r in sorted((r for r in rows if r[0] == u), key=lambda r: (-r[3], r[4])):
            if all(r[1] > t[2] or t[1] > r[2] for t in taken):
                taken.append(r)
        want |= {r[4] for r in taken}
    df = spark.createDataFrame(rows, "u int, start int, stop int, score double, seq int")
    assert {r.seq for r in layout.chosen_spans(df, ["u"]).collect()} == want


def test_uncovered(spark):
    rows = [(1, 0, 0.0, 0.0, 10.0, 10.0), (1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 2.0, 2.0, 4.0, 4.0), (1, 3, 8.0, 8.0, 20.0, 20.0), (2, 4, 2.0, 2.0, 4.0, 4.0)]
    df = spark.createDataFrame(rows, "page int, seq int, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r.seq for r in layout.uncovered(df, ["page"]).collect()) == [1, 3, 4]


def test_bands_that_touch(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0), ("a", 1.0, 2.0), ("b", 0.0, 1.0), ("b", 1.0, 2.0), ("b", 0.5, 1.5)], "k string, lo double, hi double")
    got = sorted((r.k, r.low, r.high, r.n) for r in layout.bands(df, ["k"], "lo", "hi").collect())
    assert got == [("a", 0.0, 1.0, 1), ("a", 1.0, 2.0, 1), ("b", 0.0, 2.0, 3)]


def test_lateral_and_confirmed(spark):
    """Against the rules by hand, over random pages."""
    rng = random.Random(8)
    margin, items, refs = 0.1, [], []
    for page in range(30):
        for k in range(rng.randint(1, 7)):
            x0 = rng.choice([0.1, 0.12, 0.05, 0.4, 0.6, 0.7])
            y0 = rng.random()
            items.append((page % 3, page, k, x0, y0, x0 + rng.choice([0.1, 0.3, 0.5]), y0 + rng.choice([0.05, 0.3]), margin))
        refs += [(page % 3, page, rng.choice([0.2, 0.45, 0.72])) for _ in range(rng.choice([0, 0, 1]))]
    want = set()
    for d, p, k, x0, y0, x1, y1, m in items:
        if abs(x0 - m) <= 0.05:
            continue
        beside = any(q[:2] == (d, p) and abs(q[3] - m) <= 0.05 and min(y1, q[6]) - max(y0, q[4]) > 0 and (q[5] <= x0 + 0.01 or x1 <= q[3] + 0.01) for q in items)
        if beside or any(r[:2] == (d, p) and abs(x0 - r[2]) <= 0.05 for r in refs):
            want.add((d, p, k))
    a = spark.createDataFrame(items, "doc int, page int, item int, x0 double, y0 double, x1 double, y1 double, margin double")
    b = spark.createDataFrame(refs, "doc int, page int, at double")
    assert want and {tuple(r) for r in layout.lateral(a, b, ["doc", "page"]).collect()} == want
    lows = [(d, p, x0) for d, p, k, x0, *_ in items]
    sure = {(d, p, x) for d, p, x in lows if any(e == d and q != p and abs(x - y) <= 0.05 for e, q, y in lows) or any(e == d and q == p and abs(x - y) <= 0.05 for e, q, y in refs)}
    df = spark.createDataFrame(lows, "doc int, page int, low double")
    assert {tuple(r) for r in layout.confirmed_bands(df, b).collect()} == sure


def test_assigned_by_grid(spark):
    rng = random.Random(6)
    boxes = [(p, k, x := rng.uniform(-5, 5), y := rng.uniform(-5, 5), x + rng.choice([0.0, 0.5, 3, 9]), y + rng.choice([0.2, 2, 7])) for k, p in enumerate(rng.choices(range(3), k=60))]
    boxes += [(p, k + 100, *r) for p, k, *r in boxes[:20]]
    points = [(rng.randrange(4), k, rng.uniform(-6, 9), rng.uniform(-6, 9)) for k in range(400)]
    want = {}
    for p, k, x, y in points:
        held = [(-(b[4] - b[2]) * (b[5] - b[3]), b[1]) for b in boxes if b[0] == p and b[2] <= x <= b[4] and b[3] <= y <= b[5]]
        if held:
            want[p, k] = min(held)[1]
    a = spark.createDataFrame(points, "page int, point int, x double, y double")
    b = spark.createDataFrame(boxes, "page int, box int, x0 double, y0 double, x1 double, y1 double")
    for cell in (None, 0.7, 50.0):
        assert {(r.page, r.point): r.box for r in layout.assigned(a, b, cell).collect()} == want
