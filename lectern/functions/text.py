"""Scalars over text as column expressions; character classes are made from the Unicode tables."""

from __future__ import annotations

import functools
import re
import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


#: White space as the rules have it, and the characters of words.
SPACE = r"[\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
WORD = r"[\p{L}\p{N}_]"
#: Fixed value: the words that only list.
SEPARATORS = ("and", "or", "e", "ed", "o", "oppure", "y", "et", "ou", "und", "oder", "と", "や", "および", "ならびに", "また", "かつ")
#: A URL, and the line at which a text's appendix begins.
URL, APPENDIX = r"https?://\S+", "SECONDARY ELEMENT:"


def char_class(test) -> str:
    """A regular-expression class of the characters that pass ``test``, as ranges."""
    out, start, last = [], None, None
    for c in range(sys.maxunicode + 1):
        if 0xD800 <= c <= 0xDFFF or not test(chr(c)):
            continue
        if start is None or c != last + 1:
            if start is not None:
                out.append((start, last))
            start = c
        last = c
    if start is not None:
        out.append((start, last))
    return "[" + "".join(f"\\x{{{a:X}}}" + (f"-\\x{{{b:X}}}" if b > a else "") for a, b in out) + "]"


@functools.lru_cache(maxsize=1)
def wide_class() -> str:
    """East Asian wide and full-width characters."""
    return char_class(lambda c: unicodedata.east_asian_width(c) in "WF")


def wide_one() -> str:
    """A pattern of one wide character; the look-ahead spares most others the long class, as none lies below U+1100."""
    return r"(?=[\x{1100}-\x{10FFFF}])" + wide_class()


def ends_sentence(c: str) -> bool:
    name = unicodedata.name(c, "")
    return c in "\n…" or ("INVERTED" not in name and any(w in name for w in ("FULL STOP", "QUESTION MARK", "EXCLAMATION MARK", "DANDA")))


@functools.lru_cache(maxsize=1)
def end_class() -> str:
    return char_class(ends_sentence)


def n_wide(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, wide_one(), ""))


def token_estimate(text: Column) -> Column:
    """A token for each wide character and for each four others, rounded up."""
    wide = n_wide(text)
    return (wide + F.floor((F.length(text) - wide + 3) / 4)).cast("long")


def nfkc(text: Column) -> Column:
    """Compatibility form, for which Spark has no expression: in Arrow batches. Texts are taken to it once, at ingest."""

    @F.pandas_udf("string")
    def normal(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return normal(text)


def node_name(text: Column) -> Column:
    """Lower case, white space collapsed, none at the ends, of a text in NFKC (F1)."""
    return F.btrim(F.regexp_replace(F.lower(text), SPACE + "+", " "))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def entity_valid(name: Column) -> Column:
    """Whether a name may be an entity: three characters or more, two if one is wide, and no address."""
    plain = stripped(name)
    return F.coalesce((F.length(plain) >= F.when(plain.rlike(wide_one()), TERM_LEAST_WIDE).otherwise(TERM_LEAST)) & ~F.lower(plain).contains("http"), F.lit(False))


def primary_text(text: Column) -> Column:
    """A text up to its appendix, without the blank lines and rules that are then last."""
    lines = F.split(text, "\n")
    at = F.array_position(F.transform(lines, stripped), APPENDIX).cast("int")
    inline = SPACE.replace(r"\x09-\x0D", r"\x09\x0B-\x0D")
    kept = F.when(at > 0, F.array_join(F.slice(lines, F.lit(1), at - 1), "\n")).otherwise(text)
    return F.regexp_replace(kept, rf"(?:(?:\A|\n){inline}*+(?:---{inline}*+)?)+\z", "")


TERM_LEAST, TERM_LEAST_WIDE = 3, 2


def plain_name(text: str) -> str:
    """``node_name`` of a plain string, in NFKC."""
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text).strip().lower())


def is_wide(text: str) -> bool:
    return any(unicodedata.east_asian_width(c) in "WF" for c in text)


def anchored(text: Column, terms: list[str]) -> Column:
    """Whether a text in NFKC holds a term: wide ones anywhere, others where a word begins; short ones don't count (P10)."""
    plain, names = node_name(text), [plain_name(t) for t in terms]
    wide = [t for t in names if is_wide(t) and len(t) >= TERM_LEAST_WIDE]
    other = [re.sub(r"([^\w\s])", r"\\\1", t) for t in names if not is_wide(t) and len(t) >= TERM_LEAST]
    held = [plain.contains(t) for t in wide] + ([plain.rlike(r"(?U)\b(?:" + "|".join(other) + ")")] if other else [])
    return F.coalesce(functools.reduce(lambda a, b: a | b, held), F.lit(False)) if held else F.lit(False)


def anchor_impossible(text: Column, terms: list[str]) -> Column:
    """Whether all terms are wide and the text has no wide character, so that none could be held."""
    return F.coalesce(~text.rlike(wide_one()), F.lit(True)) if terms and all(map(is_wide, terms)) else F.lit(False)


def words(text: Column) -> Column:
    """Words, hyphenated ones whole, and single marks; each wide character stands alone (F7). ``chunk.word_spans`` has their places."""
    found = F.regexp_extract_all(text, F.lit(rf"{WORD}+(?:[-_]{WORD}+)*|[^{WORD[1:-1]}{SPACE[1:-1]}]"), F.lit(0))
    parts = F.flatten(F.transform(found, lambda w: F.regexp_extract_all(w, F.lit(f"{wide_class()}|[^{wide_class()[1:]}+"), F.lit(0))))
    return F.when(text.rlike(wide_one()), parts).otherwise(found)


def sentence_count(text: Column) -> Column:
    """Sentences with something in them: a terminator that no plain letter or digit follows, or a line's end, parts them."""
    parts = F.split(text, rf"\n|(?<={end_class()})(?![\p{{L}}\p{{N}}&&[^{wide_class()[1:]}])")
    return F.size(F.filter(parts, lambda s: F.length(F.trim(s)) > 0)).cast("long")


def without_urls(text: Column) -> Column:
    return F.regexp_replace(text, URL, "")


def enumerates(between: Column) -> Column:
    """Whether the text between two mentions, in NFKC, only lists: its letters are none, or one of the words that list."""
    left = F.regexp_replace(F.lower(F.coalesce(between, F.lit(""))), f"[^{WORD[1:]}+", "")
    return left.isin("", *SEPARATORS)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    return F.regexp_extract(base_name(path), r"(\.[^.]+)$", 1)


def number_text(value: Column) -> Column:
    """Whole numbers without a fraction."""
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))


def excel_date(serial: Column) -> Column:
    """A sheet's serial number as time, date or both."""
    seconds = F.round(serial * 86400).cast("long")
    at = F.timestamp_seconds(seconds - 2209161600)
    return F.when(serial < 1, F.date_format(at, "HH:mm:ss")).when(serial == F.floor(serial), F.date_format(at, "yyyy-MM-dd")).otherwise(F.date_format(at, "yyyy-MM-dd HH:mm:ss"))


def column_letters(index: Column) -> Column:
    """0 -> A, 25 -> Z, 26 -> AA, up to three letters."""
    a = lambda x: F.char(65 + x)
    i = index.cast("long")
    two, three = i - 26, i - 702
    return F.when(i < 26, a(i)).when(i < 702, F.concat(a(F.floor(two / 26)), a(two % 26))).otherwise(F.concat(a(F.floor(three / 676)), a(F.floor(three / 26) % 26), a(three % 26)))


def file_size(size: Column) -> Column:
    """Bytes in the largest unit that leaves one or more, one decimal."""
    out = F.concat(size.cast("long").cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(size >= 1024**k, F.concat(F.format_string("%.1f", size / float(1024**k)), F.lit(f" {unit}"))).otherwise(out)
    return out


def cell_escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def heading(level: Column) -> Column:
    return F.repeat(F.lit("#"), F.least(level, F.lit(6)).cast("int"))


def without_ansi(text: Column) -> Column:
    return F.regexp_replace(text, r"\x1b\[[0-9;]*[a-zA-Z]", "")


def clamped(value: Column, low: float, high: float) -> Column:
    """A number from text, held between bounds; not a number gives null."""
    return F.least(F.greatest(value.try_cast("double"), F.lit(low)), F.lit(high))


def whole_numbers(values: Column) -> Column:
    """The numbers of a list of texts, cut to whole ones; others are passed over."""
    return F.transform(F.filter(F.transform(values, lambda v: v.try_cast("double")), lambda v: v.isNotNull() & ~F.isnan(v)), lambda v: v.cast("long"))


def row_numbers(values: Column) -> Column:
    """Distinct positive numbers, in order (U8)."""
    return F.array_distinct(F.filter(values, lambda v: v > 0))


def is_json(text: Column) -> Column:
    """Whether a text is JSON."""
    return F.coalesce(F.try_parse_json(text).isNotNull(), F.lit(False))


def parent_path(path: Column) -> Column:
    """What stands before the last slash; empty without one."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def clean_path(path: Column) -> Column:
    """Slashes run together, none at the ends."""
    return F.regexp_replace(F.regexp_replace(path, "/+", "/"), "^/|/$", "")


def relative_path(path: Column, root: Column) -> Column:
    """A path below ``root``, as seen from it; null for one that is not."""
    return F.when(path.startswith(F.concat(root, F.lit("/"))), F.substring(path, F.length(root) + 2, F.length(path)))


def uploadable(mime: Column, size: Column, kinds: list[str], most_mb: int) -> Column:
    """Whether a file's type is on the list and its size within the limit."""
    return F.coalesce(mime.isin(kinds) & (size <= most_mb * 1024 * 1024), F.lit(False))
