"""What SQL can say of this subpackage's queries, for DuckDB."""

from __future__ import annotations

from lectern.llm.license_scan import RULES, SENTENCES

WS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

EXACT_DEDUP = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '{WS}', '', 'g') AS plain FROM documents
), r AS (
  SELECT doc_id, plain, first_value(doc_id) OVER (PARTITION BY plain ORDER BY length(t) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY plain) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(plain) AS text_sha256 FROM r
"""

NEAR_JOIN = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents
), l AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE []::VARCHAR[] END) AS gs FROM w
), s AS (
  SELECT doc_id, len(gs) AS n, unnest(gs) AS g FROM l
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS r FROM l UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.r = links.a
)
SELECT l.doc_id, len(gs)::BIGINT AS n_shingles, min(r) AS component_id FROM l JOIN reach ON l.doc_id = reach.doc_id GROUP BY l.doc_id, len(gs)
"""

QUALITY_RULES = rf"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM documents
), win AS (
  SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) AS g FROM w WHERE len(ws) > 5
), rep AS (
  SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), n AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat FROM rep, range(5) r(k) GROUP BY doc_id
), f AS (
  SELECT w.doc_id, host, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words,
    (len(ws) < 10 OR 100 * coalesce(n_repeat, 0) > 20 * len(ws)) AS base_failed
  FROM w LEFT JOIN n ON w.doc_id = n.doc_id
), h AS (
  SELECT host, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS x FROM f GROUP BY host
), s AS (
  SELECT sum(n) AS n, sum(x) AS x, sum(x * x / n) AS xx, sum(n * n) AS nn, count(*)::DOUBLE AS k FROM h
), p AS (
  SELECT x / n AS mean, x / n * (1 - x / n) AS v, k, (xx - x * x / n - (k - 1) * v) / nullif(v * (n - nn / n - (k - 1)), 0) AS rho FROM s
), q AS (
  SELECT mean, CASE WHEN v > 0 AND k > 1 THEN least(greatest(1 / greatest(rho, 1e-9) - 1, 1.0), 10000.0) ELSE 1.0 END AS weight FROM p
), r AS (
  SELECT host, (x + mean * weight) / (n + weight) AS rate FROM h, q
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(rate, 6) AS host_rate, NOT base_failed AND rate <= 0.5 AS kept FROM f JOIN r ON f.host = r.host
"""


def license_sql() -> str:
    """Made from the same sentences and rules."""
    known = ", ".join(f"('{i}', '{s}')" for i, s in SENTENCES.items())
    mark = lambda seq: "|" + "||".join(seq) + "|"
    times = lambda seq: f"((length(chain) - length(replace(chain, '{mark(seq)}', ''))) // {len(mark(seq))})"
    cases = []
    for rule, licence, seq in RULES:
        longer = [s for _, _, s in RULES if len(s) > len(seq) and any(s[i : i + len(seq)] == seq for i in range(len(s)))]
        cases.append(f"CASE WHEN {times(seq)} > greatest(0, {', '.join(map(times, longer)) or '0'}) THEN {{'rule': '{rule}', 'licence': '{licence}'}} END")
    return rf"""
WITH k(id, s) AS (VALUES {known}), p AS (
  SELECT doc_id, unnest(range(0, len(ps))) AS i, unnest(ps) AS s FROM (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?;]){WS}+', '\1' || chr(10), 'g'), chr(10)) AS ps FROM documents)
), m AS (
  SELECT p.doc_id, string_agg(k.id, ',' ORDER BY i) AS ids, count(*) AS n FROM p JOIN k ON trim(regexp_replace(translate(p.s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'), ' ') = k.s GROUP BY p.doc_id
), c AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_known, coalesce(ids, '') AS sentence_ids, '|' || replace(coalesce(ids, ''), ',', '||') || '|' AS chain FROM documents d LEFT JOIN m ON d.doc_id = m.doc_id
), f AS (
  SELECT *, list_filter([{", ".join(cases)}], lambda x: x IS NOT NULL) AS found FROM c
)
SELECT doc_id, n_known, sentence_ids, array_to_string(list_sort(list_distinct(list_transform(found, lambda x: x.licence))), ',') AS licenses, array_to_string(list_transform(found, lambda x: x.rule), ',') AS rules FROM f
"""


ORACLE = {"op2_license_scan": license_sql(), "op3_near_join": NEAR_JOIN, "op9_exact_dedup": EXACT_DEDUP, "op10_quality_rules": QUALITY_RULES}
