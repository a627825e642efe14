"""Personal data: base patterns, and boosted trees over candidates, in DataFrame functions alone.

Matches are placed without a UDF: ``split`` gives what lies between a pattern's matches,
``regexp_extract_all`` the matches, and running sums of their lengths the places. High-recall
generators propose overlapping spans in the same way. A candidate's format and context make a small
vector of small integers; all candidates of the corpus that are not base spans are counted by vector and by whether there is
evidence for them, boosted trees are fitted on those counts (a bounded table), a
threshold for each kind is calibrated on a fold that the trees have not seen, and the trees go back into the plan as an expression.

No marks by people exist, so evidence stands in for labels, and it is what the features do not see: checksums, valid ranges, how random a
key is, a country code before a number. Where it is a word before the candidate (phones, insurance numbers), that word is kept
from the features, so the trees learn which formats such words go with, and find the same formats without the word.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.store import scratch, written

#: The base kinds in their order, with patterns equal to the contract's. ``\G`` and the look-behind
#: let a match begin where the last one ended or a run of its first characters begins, where alone one can; the
#: possessive runs never back off, which no match needs. So time is linear in the text.
BASE: dict[str, str] = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of candidates beside the base patterns: proposed kind -> pattern.
PROPOSED: dict[str, str] = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\]|\{at\}|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z0-9-]{2,63}+){1,8}",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}(?::?[0-9A-Fa-f]{1,4})(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[.\x20-]{1,3}[0-9]{4}){2,3}(?:[.\x20-]{1,3}[0-9]{1,4})?(?![0-9])",
    "phone": r"(?<![0-9+(])(?:\(?[0-9]{2,4}\)?[\x20.-]{1,2}){1,3}[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|(?i:password|passwd|pwd|passphrase|token|secret|api[_-]?key|access[_-]?key|private[_-]?key)[\x22\x27]?\x20{0,3}[=:]\x20{0,3}[\x22\x27]?[^\x20\x09-\x0D\x22\x27]{8,})",
    "iban": r"(?i)(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}(?![0-9-])",
}
KINDS = ["email", "ip", "card", "phone", "secret", "iban", "ssn"]
#: Words before a candidate that speak for personal data.
FILLER = r"(?:[\x20:=.#]+(?:me|us|at|on|is|no|number|under))*[\x20:=.#]*$"
CUES = r"(?i)(?:mail|contact|phone|tel|call|fax|mobile|card|visa|account|iban|ip|host|address|password|token|secret|key|ssn|social security|insurance)" + FILLER
PHONE_CUES, SSN_CUES = r"(?i)\b(?:phone|telephone|tel|call|fax|mobile|cell)" + FILLER, r"(?i)\b(?:ssn|social security|insurance)" + FILLER
#: What a text must hold before a pattern is tried on it.
NEEDS = {"email": "@", "phone": "+"}
BLOCK = 64


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    kept = F.split(F.reverse(number), "")
    each = F.transform(kept, lambda c, i: F.when(i % 2 == 0, c.try_cast("int")).otherwise(2 * c.try_cast("int") - F.when(c >= "5", 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def passes(kind: str, text: Column) -> Column:
    """The base check of a match of a base kind."""
    if kind == "ip":
        return ~F.exists(F.split(text, "[.]"), lambda p: p.rlike("^0*(?:[1-9][0-9]{3,}|[3-9][0-9]{2}|2[6-9][0-9]|25[6-9])$"))
    if kind == "card":
        return F.when(F.length(digits(text)).between(12, 19), luhn(digits(text))).otherwise(False)
    if kind == "phone":
        return F.length(digits(text)).between(9, 15)
    return F.lit(True)


def placed(text: Column, pattern: str, kind: str, needs: str | None = None) -> Column:
    """``array<struct<kind, start, stop, match, before, after>>`` of a pattern's matches, code points, stop exclusive.

    Running sums go by blocks of matches, so a text with very many is no square of work.
    """
    held = text if needs is None else F.when(F.instr(text, needs) > 0, text)
    one = F.array(F.struct(F.regexp_extract_all(held, F.lit(pattern), F.lit(0)).alias("m")))
    one = F.transform(F.filter(one, lambda x: F.size(x["m"]) > 0), lambda x: F.struct(x["m"].alias("m"), F.split(held, pattern, -1).alias("g")))
    one = F.transform(one, lambda x: F.struct(x["m"].alias("m"), x["g"].alias("g"), F.zip_with(x["g"], x["m"], lambda g, m: F.length(g) + F.coalesce(F.length(m), F.lit(0))).alias("s")))
    add = lambda items: F.aggregate(items, F.lit(0), lambda a, b: a + b)
    blocks = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x["m"]) - 1) / BLOCK).cast("int")), lambda b: add(F.slice(x["s"], b * BLOCK + 1, F.lit(BLOCK))))
    one = F.transform(one, lambda x: F.struct(x["m"].alias("m"), x["g"].alias("g"), x["s"].alias("s"), blocks(x).alias("b")))
    starts = lambda x: F.transform(F.sequence(F.lit(1), F.size(x["b"])), lambda k: add(F.slice(x["b"], F.lit(1), k - 1)))
    one = F.transform(one, lambda x: F.struct(x["m"].alias("m"), x["g"].alias("g"), x["s"].alias("s"), starts(x).alias("b")))

    def span(x, m, i):
        block = F.floor(i / BLOCK).cast("int")
        start = F.get(x["b"], block) + add(F.slice(x["s"], block * BLOCK + 1, i % BLOCK)) + F.length(F.get(x["g"], i))
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(m)).alias("stop"), m.alias("match"), F.right(F.get(x["g"], i), F.lit(24)).alias("before"), F.left(F.get(x["g"], i + 1), F.lit(2)).alias("after"))

    return F.coalesce(F.flatten(F.transform(one, lambda x: F.transform(x["m"], lambda m, i: span(x, m, i)))), F.array().cast(SPANS))


SPANS = "array<struct<kind:string,start:int,stop:int,match:string,before:string,after:string>>"

#: Kinds whose evidence is a word before them; their ``cue`` feature is 0.
CUED = ("phone", "ssn")
#: Features of a candidate, each a small integer: name -> (count of values, expression of the span).
FEATURES: dict[str, tuple[int, object]] = {
    "kind": (7, lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).cast("int") - 1),
    "digits": (6, lambda s: _bins(F.length(digits(s["match"])), (1, 7, 9, 12, 16))),
    "length": (4, lambda s: _bins(F.length(s["match"]), (10, 20, 40))),
    "letters": (3, lambda s: _bins(F.length(F.regexp_replace(s["match"], "[^A-Za-z]", "")), (1, 12))),
    "dots": (3, lambda s: _bins(F.length(F.regexp_replace(s["match"], "[^.]", "")), (1, 3))),
    "hyphens": (3, lambda s: _bins(F.length(F.regexp_replace(s["match"], "[^-]", "")), (1, 2))),
    "spaces": (2, lambda s: F.contains(s["match"], F.lit(" ")).cast("int")),
    "brackets": (2, lambda s: F.contains(s["match"], F.lit("(")).cast("int")),
    "zero_start": (2, lambda s: s["match"].startswith("0").cast("int")),
    "mixed": (2, lambda s: s["match"].rlike("[0-9][a-z]|[a-z][0-9]|[A-Z][0-9]|[0-9][A-Z]").cast("int")),
    "named": (2, lambda s: s["before"].rlike(r"[:=]\x20*$").cast("int")),
    "cue": (2, lambda s: F.when(s["kind"].isin(*CUED), 0).otherwise(s["before"].rlike(CUES).cast("int"))),
    "edge_before": (2, lambda s: s["before"].rlike(r"[A-Za-z0-9@.-]$").cast("int")),
    "edge_after": (2, lambda s: s["after"].rlike(r"^[A-Za-z0-9@-]|^\.[0-9]").cast("int")),
}


def _bins(value: Column, edges: tuple[int, ...]) -> Column:
    return reduce(lambda a, b: a + b, [(value >= e).cast("int") for e in edges])


def mod97(text: Column) -> Column:
    """The remainder by which an IBAN is checked (1 if it holds): letters count as two digits, the first four characters come last."""
    bare = F.upper(F.regexp_replace(text, " ", ""))
    each = F.split(F.concat(F.substring(bare, 5, 64), F.substring(bare, 1, 4)), "")
    return F.aggregate(each, F.lit(0), lambda r, c: F.when(c.rlike("[A-Z]"), (r * 100 + F.ascii(c) - 55) % 97).when(c != "", (r * 10 + F.ascii(c) - 48) % 97).otherwise(r))


def confirmed(s: Column) -> Column:
    """The evidence that stands in for a label (see above)."""
    m = s["match"]
    n = F.length(digits(m))
    value = F.regexp_extract(m, r"[=:]\x20*[\x22\x27]?(.*)$", 1)
    return (
        F.when(s["kind"] == "email", m.rlike(r"(?i)[a-z0-9](?:@|\x20?[\[({]at[\])}]\x20?)[a-z0-9]") & m.rlike(r"(?i)[.\])}]\x20?[a-z]{2,12}$"))
        .when(s["kind"] == "ip", m.rlike(r"^[0-9.]+$") & passes("ip", m) | m.rlike(r"^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$"))
        .when(s["kind"] == "card", passes("card", m))
        .when(s["kind"] == "phone", n.between(9, 15) & (m.startswith("+") | s["before"].rlike(r"\+[0-9]{1,3}[\x20.-]?$") | s["before"].rlike(PHONE_CUES)))
        .when(s["kind"] == "secret", m.startswith("AKIA") | (F.length(value) >= 12) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") | value.rlike("[a-z]") & value.rlike("[A-Z]") & value.rlike("[^A-Za-z]") | m.rlike("^[A-Z_-]+=") & ~value.rlike(r"^[<$%{(]"))
        .when(s["kind"] == "ssn", m.rlike(r"^(?!000|666|9)[0-9]{3}[\x20-](?!00)[0-9]{2}[\x20-](?!0000)[0-9]{4}$") & s["before"].rlike(SSN_CUES))
        .when(s["kind"] == "iban", F.length(F.regexp_replace(m, " ", "")).between(15, 34) & (mod97(m) == 1))
        .otherwise(False)
    )


@dataclass
class Trees:
    """Boosted trees of depth 2 on integer features: ``(feature, edge, (feature, edge, low, high) twice)``; a score at or over its kind's limit selects."""

    bias: float
    trees: list[tuple]
    limits: dict[str, float]

    def score(self, x: tuple[int, ...]) -> float:
        z = self.bias
        for f, e, low, high in self.trees:
            g, d, a, b = low if x[f] < e else high
            z += a if x[g] < d else b
        return z

    def column(self, s: Column) -> Column:
        """The score of a judged candidate (see ``judged``)."""
        xs = [s[name] for name in FEATURES]
        z = F.lit(self.bias)
        for f, e, low, high in self.trees:
            leaf = lambda n: F.when(xs[n[0]] < n[1], n[2]).otherwise(n[3])
            z = z + F.when(xs[f] < e, leaf(low)).otherwise(leaf(high))
        return z

    def picks(self, s: Column) -> Column:
        """Whether a judged candidate reaches its kind's limit."""
        limit = F.lit(math.inf)
        for kind, least in self.limits.items():
            limit = F.when(s["span"] == kind, least).otherwise(limit)
        return self.column(s) >= limit


def boosted(cells: dict[tuple, list[float]], rounds: int = 40, rate: float = 0.4, least: float = 1.0) -> Trees:
    """Newton boosting on counted cells ``x -> [without, with evidence]``; the limits are set by ``calibrated``."""
    none, yes = (sum(c[i] for c in cells.values()) for i in (0, 1))
    bias = math.log((yes + 0.5) / (none + 0.5))
    xs, z, trees = list(cells), {x: bias for x in cells}, []
    sizes = [n for n, _ in FEATURES.values()]

    def best(part: list[tuple], grads: dict) -> tuple:
        """The split with the most gain: gain, feature, edge, low leaf, high leaf."""
        g, h = sum(grads[x][0] for x in part), sum(grads[x][1] for x in part)
        found = (0.0, 0, 0, -rate * g / (h + least), -rate * g / (h + least))
        for f, n in enumerate(sizes):
            at = defaultdict(lambda: [0.0, 0.0])
            for x in part:
                at[x[f]][0] += grads[x][0]
                at[x[f]][1] += grads[x][1]
            a = b = 0.0
            for e in range(1, n):
                a, b = a + at[e - 1][0], b + at[e - 1][1]
                gain = a * a / (b + least) + (g - a) ** 2 / (h - b + least) - g * g / (h + least)
                if gain > found[0] + 1e-9:
                    found = (gain, f, e, -rate * a / (b + least), -rate * (g - a) / (h - b + least))
        return found

    for _ in range(rounds if none and yes else 0):
        grads = {}
        for x in xs:
            p = 1 / (1 + math.exp(-z[x]))
            n = sum(cells[x])
            grads[x] = (n * p - cells[x][1], n * p * (1 - p))
        top = best(xs, grads)
        sides = [best([x for x in xs if (x[top[1]] >= top[2]) == high], grads) for high in (False, True)]
        tree = (top[1], top[2], sides[0][1:], sides[1][1:])
        trees.append(tree)
        for x in xs:
            g, d, a, b = tree[3] if x[top[1]] >= top[2] else tree[2]
            z[x] += a if x[g] < d else b
    return Trees(bias, trees, {})


def calibrated(model: Trees, cells: dict[tuple, list[float]], precision: float) -> Trees:
    """For each kind the lowest limit at which, and above which, the unseen fold's share of candidates with evidence is at least ``precision``; a kind that the fold has none of selects nothing."""
    limits = {}
    for k, kind in enumerate(KINDS):
        ranked = sorted(((model.score(x), c) for x, c in cells.items() if x[0] == k), key=lambda p: -p[0])
        yes = total = 0.0
        i = 0
        while i < len(ranked):
            j = i
            while j < len(ranked) and ranked[j][0] >= ranked[i][0] - 1e-9:
                yes, total, j = yes + ranked[j][1][1], total + sum(ranked[j][1]), j + 1
            if total and yes / total >= precision:
                limits[kind] = ranked[i][0] - 1e-6
            i = j
    return Trees(model.bias, model.trees, limits)


def judged(s: Column) -> Column:
    """A span with its features, whether there is evidence for it, and its fold."""
    features = [expr(s).alias(name) for name, (_, expr) in FEATURES.items()]
    return F.struct(s["kind"].alias("span"), s["start"].alias("start"), s["stop"].alias("stop"), *features, F.coalesce(confirmed(s), F.lit(False)).alias("yes"), (F.crc32(s["match"].cast("binary")) % 4 == 0).alias("held"))


def _passing(kind: str, yes: bool):
    return lambda s: passes(kind, s["match"]) == yes


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """``id, base, proposed``: the base spans that pass their checks, and what else generators propose: the base matches that fail, and the spans of ``PROPOSED``. If ``whole``, also ``row``, the whole row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = ["id", "row"] if whole else ["id"]
    df = docs.select(F.col(id_col).alias("id"), text.alias("text"), *([F.struct("*").alias("row")] if whole else []))
    has_digit = F.when(F.col("text").rlike("[0-9]"), F.col("text"))
    raw = [placed(F.col("text") if k == "email" else has_digit, p, k, NEEDS.get(k)) for k, p in BASE.items()]
    on = {"email": F.when(F.col("text").rlike(r"(?i)[\[({\x20]at[\])}\x20]"), F.col("text")), "secret": F.col("text")}
    more = [placed(on.get(k, has_digit), p, k) for k, p in PROPOSED.items()]
    df = df.select(*kept, *[r.alias(f"base_{k}") for k, r in zip(BASE, raw)], *[m.alias(f"more_{k}") for k, m in zip(PROPOSED, more)])
    base = F.concat(*[F.filter(f"base_{k}", _passing(k, True)) for k in BASE])
    failed = [F.filter(f"base_{k}", _passing(k, False)) for k in BASE if k != "email"]
    df = df.select(*kept, base.alias("base"), F.concat(*failed, *[F.col(f"more_{k}") for k in PROPOSED]).alias("proposed"))
    return df.select(*kept, F.transform("base", judged).alias("base"), F.transform("proposed", judged).alias("proposed"))


def fitted(found: DataFrame, precision: float = 0.97) -> Trees:
    """Trees fitted on all proposed candidates, counted by feature vector (a table bounded by the product of the features' sizes)."""
    spans = found.select(F.explode("proposed").alias("s")).select(*[F.col(f"s.{name}") for name in FEATURES], "s.yes", "s.held")
    train, held = defaultdict(lambda: [0.0, 0.0]), defaultdict(lambda: [0.0, 0.0])
    for r in spans.groupBy(*spans.columns).agg(F.count(F.lit(1)).alias("n")).collect():
        (held if r["held"] else train)[tuple(r)[: len(FEATURES)]][int(r["yes"])] += r["n"]
    return calibrated(boosted(dict(sorted(train.items()))), dict(held), precision)


def selected(found: DataFrame, model: Trees) -> DataFrame:
    """``id, base, picked, added``: candidates over the limit, and those of them that touch no base span, from the left, of two that begin
    together the longer, each that touches none taken before. Linear in the spans but for sorting them.
    """
    none = lambda spans: F.filter(spans, lambda s: F.lit(False))
    picked = F.filter("proposed", model.picks) if model.limits else none(F.col("proposed"))
    df = found.withColumn("picked", picked)
    # A picked span is free if the base spans that begin before it ends have all ended where it begins.
    marks = lambda spans, at, last: F.transform(spans, lambda s: F.struct(s[at].alias("at"), F.lit(last).alias("last"), s.alias("s")))
    order = F.array_sort(F.concat(marks(F.col("base"), "start", 1), marks(F.col("picked"), "stop", 0)))
    reach = F.aggregate(
        order,
        F.struct(F.lit(0).alias("stop"), none(F.col("picked")).alias("free")),
        lambda a, m: F.struct(
            F.when(m["last"] == 1, F.greatest(a["stop"], m["s"]["stop"])).otherwise(a["stop"]).alias("stop"),
            F.when((m["last"] == 0) & (a["stop"] <= m["s"]["start"]), F.concat(a["free"], F.array(m["s"]))).otherwise(a["free"]).alias("free"),
        ),
    )
    free = F.when(F.size("picked") == 0, F.col("picked")).when(F.size("base") == 0, F.col("picked")).otherwise(reach["free"])
    df = df.withColumn("free", free)
    ranked = F.array_sort(F.transform("free", lambda s: F.struct(s["start"].alias("at"), (-s["stop"]).alias("n"), s["span"].alias("kind"), s.alias("s"))))
    taken = F.aggregate(
        ranked,
        F.struct(F.lit(0).alias("stop"), none(F.col("free")).alias("taken")),
        lambda a, r: F.when(r["at"] >= a["stop"], F.struct(r["s"]["stop"].alias("stop"), F.concat(a["taken"], F.array(r["s"])).alias("taken"))).otherwise(a),
    )
    df = df.withColumn("added", F.when(F.size("free") > 1, taken["taken"]).otherwise(F.col("free")))
    return df.select("id", "base", "picked", "added", *([F.col("row")] if "row" in df.columns else []))


def redacted(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = 0.97) -> DataFrame:
    """``docs`` with ``<KIND>`` in place of every span, base or picked; spans that overlap make one mark, of the first's kind.

    Rows without spans, null texts among them, stay as they are. Texts are scanned twice, once to count the candidates and once to
    put in the marks, rather than stored a second time.
    """
    model = fitted(candidates(docs, id_col, text_col), precision)
    df = selected(candidates(docs, id_col, text_col, whole=True), model)
    order = F.transform(F.concat("base", "picked"), lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["span"]).alias("k"), s["stop"].alias("stop"), s["span"].alias("span")))
    df = df.select("row", F.array_sort(order).alias("spans"))
    # Runs of spans that overlap: the first of each, with the greatest stop so far before it.
    reach = F.aggregate("spans", F.struct(F.lit(0).alias("stop"), F.array().cast("array<struct<start:int,stop:int,span:string>>").alias("runs")), lambda a, s: F.struct(
        F.greatest(a["stop"], s["stop"]).alias("stop"),
        F.when((F.size(a["runs"]) > 0) & (s["start"] < a["stop"]), F.concat(F.slice(a["runs"], F.lit(1), F.greatest(F.size(a["runs"]) - 1, F.lit(0))), F.array(F.struct(F.element_at(a["runs"], -1)["start"].alias("start"), F.greatest(a["stop"], s["stop"]).alias("stop"), F.element_at(a["runs"], -1)["span"].alias("span")))))
        .otherwise(F.concat(a["runs"], F.array(F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["span"].alias("span"))))).alias("runs"),
    ))
    df = df.select("row", F.when(F.size("spans") > 0, reach["runs"]).alias("runs"))
    text = F.col("row")[text_col]
    before = lambda r, i: F.when(i == 0, F.lit(0)).otherwise(F.get(F.col("runs"), i - 1)["stop"])
    marked = F.transform("runs", lambda r, i: F.concat(F.substring(text, before(r, i) + 1, r["start"] - before(r, i)), F.lit("<"), F.upper(r["span"]), F.lit(">")))
    tail = F.substring(text, F.element_at("runs", -1)["stop"] + 1, F.length(text))
    new = F.when(F.col("runs").isNull(), text).otherwise(F.concat(F.array_join(marked, ""), tail))
    return df.select(F.col("row").withField(text_col, new).alias("row")).select("row.*")


def joined(spans: Column) -> Column:
    """``kind:start:stop`` by start, then kind in its order, joined by commas."""
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), F.array_position(F.array(*map(F.lit, KINDS)), s["span"]).alias("k"), s["stop"].alias("z"), s["span"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda t: F.concat_ws(":", t["kind"], t["a"].cast("string"), t["z"].cast("string"))), ",")


def pii_spans(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = 0.97) -> DataFrame:
    """``id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of every row; counts are of base spans.

    Null and empty texts have no spans; null ids and repeated rows are scanned each; an empty table gives
    an empty result, and without confirmed and other candidates nothing is added; columns other than id and text are not
    read. Texts are scanned once: what is found is written and both counted and judged from there.
    """
    found = written(candidates(docs, id_col, text_col), scratch(spark, "pii"))
    out = selected(found, fitted(found, precision))
    count = lambda k: F.size(F.filter("base", lambda s: s["span"] == k)).cast("long").alias(f"n_{k}")
    return out.select(F.col("id").alias(id_col), *map(count, BASE), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"))
