"""Chunkers: texts and tables to token-bounded parts (C1-C3, F6, F9-F11), Arrow-batched."""

from __future__ import annotations

import functools
import itertools
import re
import unicodedata
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import APPENDIX, URL, end_class

#: Estimated tokens of a chunk, of its overlap, and the least that a chunk of relations has.
LENGTH, OVERLAP, LEAST = 250, 50, 25


@functools.lru_cache(maxsize=65536)
def is_wide(c: str) -> bool:
    return unicodedata.east_asian_width(c) in "WF"


def estimate(text: str) -> int:
    wide = 0 if text.isascii() else sum(map(is_wide, text))
    return wide + (len(text) - wide + 3) // 4


_words = re.compile(r"\w+(?:[-_]\w+)*|[^\w\s]")


def word_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """Words and marks with their places; wide characters stand alone."""
    for m in _words.finditer(text):
        at = m.start()
        for wide, run in itertools.groupby(m[0], is_wide):
            whole = "".join(run)
            for part in whole if wide else [whole]:
                yield part, at, at + len(part)
                at += len(part)


def primary_text(text: str) -> str:
    """A text up to its appendix, without the blank lines and rules that are then last."""
    lines = list(itertools.takewhile(lambda x: x.strip() != APPENDIX, text.split("\n")))
    while lines and lines[-1].strip() in ("", "---"):
        lines.pop()
    return "\n".join(lines)


@functools.lru_cache(maxsize=1)
def _ends() -> re.Pattern:
    """All characters that may end a sentence, as one class."""
    return re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: re.escape(chr(int(m[1], 16))), end_class()))


def sentences(text: str) -> list[tuple[str, int, int]]:
    """``(stripped text, start, stop)`` of each sentence that holds something; the offsets are those before stripping."""
    out, start = [], 0
    for m in _ends().finditer(text):
        after = text[m.end() : m.end() + 1]
        if m[0] != "\n" and after.isalnum() and not is_wide(after):
            continue
        if part := text[start : m.end()].strip():
            out.append((part, start, m.end()))
        start = m.end()
    if part := text[start:].strip():
        out.append((part, start, len(text)))
    return out


def parts(text: str, length: int) -> Iterator[str]:
    """Sentences; words of those too long; slices of words too long."""
    for sentence, _, _ in sentences(text):
        if estimate(sentence) <= length:
            yield sentence
            continue
        for word in sentence.split():
            if estimate(word) <= length:
                yield word
            else:
                yield from (word[k : k + length] for k in range(0, len(word), length))


def join(some: list[str]) -> str:
    """With a space, but none between two wide characters; white space collapsed."""
    out = ""
    for p in some:
        out += p if not out or not p or (is_wide(out[-1]) and is_wide(p[0])) else " " + p
    return re.sub(r"\s+", " ", out).strip()


def citation_chunks(text: str, length: int = LENGTH, overlap: int = OVERLAP) -> list[str]:
    """Greedy and overlapping: a chunk begins with the last parts of the one before, up to ``overlap`` tokens."""
    out, held, used = [], [], 0
    for part in parts(text, length):
        size = estimate(part)
        if held and used + size + 1 > length:
            out.append(join(held))
            tail, kept = [], 0
            for p in reversed(held):
                n = estimate(p)
                if kept + n > overlap:
                    break
                tail, kept = [p, *tail], kept + n
            held, used = tail, kept
        held.append(part)
        used += size + 1
    return [c for c in [*out, join(held)] if c]


def glue(a: str, b: str) -> str:
    """What stands between two parts: a space, but nothing between two wide characters."""
    return "" if a and b and is_wide(a[-1]) and is_wide(b[0]) else " "


def relation_chunks(text: str, length: int = LENGTH, least: int = LEAST) -> list[str]:
    """Greedy and disjoint, without URLs, white space collapsed; chunks of fewer than ``least`` tokens are dropped."""
    out: list[str] = []
    for part in parts(re.sub(URL, "", text), length):
        if out and estimate(out[-1]) + estimate(part) + 1 <= length:
            out[-1] += glue(out[-1], part) + part
        else:
            out.append(part)
    clean = (re.sub(r"\s+", " ", c).strip() for c in out)
    return [c for c in clean if estimate(c) >= least]


def letters(index: int) -> str:
    out = ""
    while index >= 0:
        out, index = chr(65 + index % 26) + out, index // 26 - 1
    return out


def cells(line: str) -> list[str]:
    """Cells of a Markdown table row: parted at bars that no backslash stands before, unescaped."""
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line)[1:-1]]


def table_chunks(name: str, text: str, length: int = LENGTH) -> list[str]:
    """Rows of a sheet as ``row N: A=x, B=y`` under ``file - sheet``, so many a chunk as fit; empty cells and cells beyond the head are passed over.

    The tokens of the chunk so far, of the row and one more must fit; a row of which no cell is filled is a row;
    other lines after a row go to its chunk.
    """
    out, sheet, head, held, rows = [], "", [], "", 0
    for line in filter(None, map(str.strip, text.split("\n"))):
        if line.startswith("# "):
            out += [held] if rows else []
            sheet, head, held, rows = line[2:].strip(), [], "", 0
        elif not line.startswith("|"):
            held += f"\n{line}" if rows else ""
        elif line.strip("|- "):
            row = cells(line)
            if not head:
                head, held = row, f"{name} - {sheet}"
                continue
            told = f"row {row[0]}: " + ", ".join(f"{h}={c}" for h, c in zip(head[1:], row[1:]) if c)
            if estimate(held) + estimate(told) + 1 > length:
                out.append(held)
                held = f"{name} - {sheet}"
            held, rows = f"{held}\n{told}", rows + 1
    return out + [held] if rows else out


def chunked_tables(texts: DataFrame, id_col: str, name_col: str, text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``id, seq, chunk, tokens``: chunks of each sheet's Markdown in order, under the file's name. Null and empty texts have none."""
    import pyarrow as pa

    src = texts.select(F.col(id_col), F.col(name_col).alias("name"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            found = [table_chunks(n or "", t or "", length) for n, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(flattened(batch.column(0), found), [id_col, "seq", "chunk", "tokens"])

    return src.mapInArrow(run, f"`{id_col}` {src.schema[0].dataType.simpleString()}, seq bigint, chunk string, tokens bigint")


def flattened(ids, found: list[list[str]]) -> list:
    """Arrow columns of one row a chunk: id, place, chunk, tokens."""
    import pyarrow as pa

    flat = [c for f in found for c in f]
    at = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
    return [ids.take(at), pa.array([q for f in found for q in range(len(f))], pa.int64()), pa.array(flat, pa.string()), pa.array(map(estimate, flat), pa.int64())]


def chunked(texts: DataFrame, kind: str = "citation", id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``id, seq, chunk, tokens``: chunks of each text in order. Null and empty texts have none."""
    import pyarrow as pa

    make = {"citation": citation_chunks, "relation": relation_chunks}[kind]
    src = texts.select(F.col(id_col), F.col(text_col).alias("text"))
    names = [id_col, "seq", "chunk", "tokens"]

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                some = batch.slice(k, 256)
                yield pa.RecordBatch.from_arrays(flattened(some.column(0), [make(t or "", length) for t in some.column(1).to_pylist()]), names)

    return src.mapInArrow(run, f"`{id_col}` {src.schema[0].dataType.simpleString()}, seq bigint, chunk string, tokens bigint")
