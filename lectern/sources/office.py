"""Office archives as rows (S11-S17, O10, O13-O17): XML becomes raw cells and blocks in Arrow batches, the rules are columns."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.text import cell_escape, column_letters, excel_date, heading, number_text
from lectern.operators.layout import masked

#: Namespaces, and the built-in number formats that show dates.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
DRAW = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
SLIDE = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
DATE_FORMATS = {*range(14, 23), 45, 46, 47}

CELLS = "path string, sheet_no long, sheet string, row long, col long, kind string, raw string, is_date boolean"
BLOCKS = "path string, page long, seq long, kind string, style string, outline int, size int, place string, text string"


class Archive:
    def __init__(self, content: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = set(self.zip.namelist())

    def xml(self, name: str) -> ET.Element | None:
        return ET.fromstring(self.zip.read(name)) if name in self.names else None

    def links(self, part: str) -> dict[str, tuple[str, str]]:
        """Relationship id -> (type's last word, path in the archive) of a part."""
        folder, name = posixpath.split(part)
        root = self.xml(f"{folder}/_rels/{name}.rels")
        at = lambda t: t[1:] if t.startswith("/") else posixpath.normpath(posixpath.join(folder, t))
        return {r.get("Id"): (r.get("Type", "").rsplit("/", 1)[-1], at(r.get("Target", ""))) for r in root} if root is not None else {}


def string_of(node: ET.Element) -> str:
    """Text of a string item, phonetic runs left out."""
    if node.tag == f"{MAIN}rPh":
        return ""
    return (node.text or "" if node.tag == f"{MAIN}t" else "") + "".join(map(string_of, node))


def position(reference: str) -> tuple[int, int]:
    """``"AB12"`` -> (12, 27)."""
    letters = re.match(r"[A-Za-z]*", reference)[0].upper()
    col = 0
    for c in letters:
        col = col * 26 + ord(c) - 64
    return int(reference[len(letters) :] or 0), max(0, col - 1)


def shows_date(code: str) -> bool:
    return re.search(r"[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code), re.I) is not None


def raw_cells(path: str, content: bytes) -> Iterator[tuple]:
    """Cells of all sheets as they are stored; also a row of kind ``range`` for a pivot table's place and ``merge`` for merged cells."""
    a = Archive(content)
    shared = [string_of(n) for n in (a.xml("xl/sharedStrings.xml") or [])]
    dates, styles = set(), a.xml("xl/styles.xml")
    if styles is not None:
        codes = {int(n.get("numFmtId", -1)): n.get("formatCode", "") for n in styles.iter(f"{MAIN}numFmt")}
        ids = [int(x.get("numFmtId", 0)) for x in styles.findall(f"{MAIN}cellXfs/{MAIN}xf")]
        dates = {str(k) for k, i in enumerate(ids) if i in DATE_FORMATS or shows_date(codes.get(i, ""))}
    links = a.links("xl/workbook.xml")
    for no, node in enumerate(a.xml("xl/workbook.xml").iter(f"{MAIN}sheet"), 1):
        name, part = node.get("name", ""), links.get(node.get(f"{LINK}id"), ("", ""))[1]
        root = a.xml(part)
        yield path, no, name, None, None, "sheet", None, None
        if root is None:
            continue
        for kind, target in a.links(part).values():
            place = a.xml(target).find(f"{MAIN}location") if kind == "pivotTable" and a.xml(target) is not None else None
            if place is not None and ":" in place.get("ref", ""):
                yield path, no, name, None, None, "range", place.get("ref"), None
        for merge in root.iter(f"{MAIN}mergeCell"):
            yield path, no, name, None, None, "merge", merge.get("ref", ""), None
        after = 0
        for row in root.iter(f"{MAIN}row"):
            number = int(row.get("r")) if row.get("r", "").isdigit() else after + 1
            after, next_col = number, 0
            for c in row.findall(f"{MAIN}c"):
                col = position(c.get("r"))[1] if c.get("r") else next_col
                next_col = col + 1
                kind, v = c.get("t", "n"), c.findtext(f"{MAIN}v") or ""
                if kind == "s":
                    v = shared[int(v)] if v and int(v) < len(shared) else ""
                elif kind == "inlineStr":
                    v = "".join(string_of(n) for n in c.findall(f"{MAIN}is"))
                yield path, no, name, number, col, kind, v, c.get("s", "") in dates


def blocks_of_docx(path: str, content: bytes) -> Iterator[tuple]:
    """Paragraphs and table rows of the body in order. Rows are ``row`` blocks with cells parted by U+001F."""
    a = Archive(content)
    styles = {s.get(f"{WORD}styleId"): s for s in (a.xml("word/styles.xml") or []) if s.tag == f"{WORD}style"}
    val = lambda n, p: (x.get(f"{WORD}val") if (x := n.find(p)) is not None else None) if n is not None else None
    text = lambda n: "".join(t.text or "" if t.tag == f"{WORD}t" else "\t" if t.tag == f"{WORD}tab" else "\n" if t.tag == f"{WORD}br" else "" for t in n.iter()).strip()
    seq = 0
    for node in a.xml("word/document.xml").find(f"{WORD}body"):
        if node.tag == f"{WORD}p" and text(node):
            style = val(node, f"{WORD}pPr/{WORD}pStyle") or ""
            named = (val(styles.get(style), f"{WORD}name") or "").lower()
            outline = val(node, f"{WORD}pPr/{WORD}outlineLvl") or val(styles.get(style), f"{WORD}pPr/{WORD}outlineLvl")
            weights: dict[int, int] = {}
            for run in node.iter(f"{WORD}r"):
                size = int(val(run, f"{WORD}rPr/{WORD}sz") or val(styles.get(style), f"{WORD}rPr/{WORD}sz") or 22)
                weights[size] = weights.get(size, 0) + len(text(run))
            size = max(weights, key=weights.get, default=22)
            listed = node.find(f"{WORD}pPr/{WORD}numPr") is not None
            seq += 1
            yield path, 1, seq, "list" if listed else "paragraph", f"{style}|{named}", int(outline) if outline and int(outline) < 9 else -1, size, "main", text(node)
        elif node.tag == f"{WORD}tbl":
            for row in node.findall(f"{WORD}tr"):
                seq += 1
                yield path, 1, seq, "row", "", -1, 22, "main", "\x1f".join(text(c) for c in row.findall(f"{WORD}tc"))


def blocks_of_pptx(path: str, content: bytes) -> Iterator[tuple]:
    """Shapes of the slides in the presentation's order, groups entered; notes stand aside."""
    a = Archive(content)
    links = a.links("ppt/presentation.xml")
    lines = lambda n: "\n".join(t for p in n.iter(f"{DRAW}p") if (t := "".join(x.text or "" for x in p.iter(f"{DRAW}t")).strip()))
    for page, node in enumerate(a.xml("ppt/presentation.xml").iter(f"{SLIDE}sldId"), 1):
        part = links.get(node.get(f"{LINK}id"), ("", ""))[1]
        notes = [t for k, t in a.links(part).values() if k == "notesSlide"]
        seq = 0
        for place, name in [("main", part), *(("aside", n) for n in notes)]:
            root = a.xml(name)
            for shape in root.iter() if root is not None else ():
                if shape.tag == f"{SLIDE}sp":
                    holder = shape.find(f"{SLIDE}nvSpPr/{SLIDE}nvPr/{SLIDE}ph")
                    kind = holder.get("type", "body") if holder is not None else "body"
                    if (told := lines(shape)) and kind not in ("sldNum", "dt", "ftr", "sldImg"):
                        seq += 1
                        yield path, page, seq, "title" if kind in ("title", "ctrTitle") else "paragraph", "", -1, 0, place, told
                elif shape.tag == f"{DRAW}tr":
                    seq += 1
                    yield path, page, seq, "row", "", -1, 0, place, "\x1f".join(lines(c) for c in shape.findall(f"{DRAW}tc"))


def read_with(spark: SparkSession, root: str, pattern: str, make, schema: str) -> DataFrame:
    """Rows that ``make(path, content)`` gives for each file; a file is read by one task, rows leave in batches."""
    import pyarrow as pa

    names = [f.split()[0] for f in schema.split(", ")]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "content")
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    arrow = pa.schema([(n, kinds[f.split()[1]]) for n, f in zip(names, schema.split(", "))])

    def run(batches):
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns)):
                held = []
                for row in make(path, content):
                    held.append(row)
                    if len(held) >= 5000:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in held], schema=arrow)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in held], schema=arrow)

    return files.mapInArrow(run, schema)


def cell_text(kind: Column, raw: Column, is_date: Column) -> Column:
    """What a stored cell shows."""
    number = raw.try_cast("double")
    plain = raw.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$")
    shown = F.when(plain & is_date, excel_date(number)).when(plain & (number == F.floor(number)), number_text(number)).otherwise(raw)
    return F.trim(F.when(kind == "b", F.when(raw == "1", "TRUE").otherwise("FALSE")).when(kind.isin("s", "inlineStr", "str", "e"), raw).otherwise(shown))


def xlsx_cells(raw: DataFrame) -> DataFrame:
    """``path, sheet_no, sheet, row, col, text`` of filled cells, those under pivot tables blank."""
    cells = raw.filter("row is not null").select(F.struct("path", "sheet_no").alias("sheet"), F.col("sheet").alias("name"), "row", "col", cell_text(F.col("kind"), F.col("raw"), F.col("is_date")).alias("text"))
    ref = F.upper("raw")
    ends = [F.regexp_extract(ref, r"^([A-Z]+)([0-9]+):([A-Z]+)([0-9]+)$", k) for k in (1, 2, 3, 4)]
    column = lambda c: F.aggregate(F.split(c, ""), F.lit(0), lambda a, x: a * 26 + F.ascii(x) - 64) - 1
    ranges = raw.filter("kind = 'range'").select(F.struct("path", "sheet_no").alias("sheet"), ends[1].cast("long").alias("r0"), column(ends[0]).cast("long").alias("c0"), ends[3].cast("long").alias("r1"), column(ends[2]).cast("long").alias("c1"))
    return masked(cells, ranges).filter("text != ''").select("sheet.path", "sheet.sheet_no", F.col("name").alias("sheet"), "row", "col", "text")


def xlsx_markdown(raw: DataFrame) -> DataFrame:
    """``path, text``: each sheet a table under its name, rows from the first to the last that is filled, then its merged ranges."""
    cells = xlsx_cells(raw)
    by = ["path", "sheet_no"]
    size = cells.groupBy(*by).agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.max("col").alias("w"))
    rows = cells.groupBy(*by, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("m"))
    grid = size.select(*by, "w", F.explode(F.sequence("r0", "r1")).alias("row")).join(rows, [*by, "row"], "left")
    shown = F.transform(F.sequence(F.lit(0), F.col("w").cast("int")), lambda c: cell_escape(F.coalesce(F.try_element_at("m", c.cast("long")), F.lit(""))))
    lines = grid.select(*by, "row", "w", F.concat(F.lit("| "), F.col("row").cast("string"), F.lit(" | "), F.array_join(shown, " | "), F.lit(" |")).alias("line"))
    body = lines.groupBy(*by).agg(F.max("w").alias("w"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "line"))), lambda r: r["line"]), "\n").alias("body"))
    span = F.sequence(F.lit(0), F.col("w").cast("int"))
    head = F.concat(F.lit("| row | "), F.array_join(F.transform(span, column_letters), " | "), F.lit(" |\n| --- |"), F.repeat(F.lit(" --- |"), F.size(span)), F.lit("\n"))
    merges = raw.filter("kind = 'merge'").groupBy(*by).agg(F.concat(F.lit("Merge: "), F.array_join(F.sort_array(F.collect_list("raw")), ", "), F.lit("\n\n")).alias("merges"))
    sheets = raw.filter("kind = 'sheet'").select(*by, "sheet").join(body, by, "left").join(merges, by, "left")
    told = F.concat(F.lit("# "), F.col("sheet"), F.lit("\n\n"), F.when(F.col("body").isNotNull(), F.concat(head, "body", F.lit("\n\n"))).otherwise(""), F.coalesce("merges", F.lit("")))
    return sheets.select(*by, told.alias("t")).groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sheet_no", "t"))), lambda s: s["t"]), "").alias("text"))


def labelled(blocks: DataFrame) -> DataFrame:
    """Add ``label`` and ``level`` to blocks (O14, O16): by style, by outline, by size among the sizes above the body's, by placeholder."""
    doc = Window.partitionBy("path")
    order = doc.orderBy("page", "seq").rowsBetween(Window.unboundedPreceding, -1)
    style, name = F.split_part("style", F.lit("|"), F.lit(1)), F.split_part("style", F.lit("|"), F.lit(2))
    weight = blocks.filter("kind != 'row' and place = 'main' and size > 0").groupBy("path", "size").agg(F.sum(F.length("text")).alias("n"))
    body = weight.groupBy("path").agg(F.max_by("size", F.struct("n", -F.col("size"))).alias("body"))
    titles = weight.join(body, "path").filter(F.col("size") >= 1.15 * F.col("body")).groupBy("path").agg(F.sort_array(F.collect_set("size"), False).alias("sizes"))
    df = blocks.join(titles, "path", "left").withColumn("at", F.when(F.length("text") <= 120, F.coalesce(F.array_position("sizes", F.col("size")), F.lit(0)).cast("int")).otherwise(0))
    digit = F.regexp_extract(style, r"^Heading(\d)", 1)
    sure = (style == "Title") | (name == "title")
    caption = style.contains("Caption") | name.contains("caption") | name.contains("didascalia")
    sized = ~sure & ~caption & (digit == "") & (F.col("outline") < 0) & (F.col("at") > 0) & (F.col("kind") != "row")
    df = df.withColumn("may", (sure | (F.col("kind") == "title") | (sized & (F.col("at") == 1))).cast("int")).withColumn("found", F.coalesce(F.max("may").over(order), F.lit(0)))
    label = (
        F.when(F.col("kind") == "row", "tableRow")
        .when(F.col("place") == "aside", "aside_text")
        .when(sure | ((F.col("kind") == "title") & (F.col("found") == 0)) | (sized & (F.col("at") == 1) & (F.col("found") == 0)), "doc_title")
        .when(caption, "figure_title")
        .when((F.col("kind") == "title") | (digit != "") | (F.col("outline") >= 0) | sized, "paragraph_title")
        .otherwise("text")
    )
    level = F.when(F.col("kind") == "title", 2).when(digit != "", digit.try_cast("int") + 1).when(F.col("outline") >= 0, F.col("outline") + 2).when(F.col("found") == 1, F.greatest(F.lit(2), F.col("at"))).otherwise(F.col("at") + 1)
    return df.select(*blocks.columns, label.alias("label"), F.when(label == "paragraph_title", level).otherwise(0).alias("level"))


def markdown(items: DataFrame) -> DataFrame:
    """``path, text`` of labelled blocks: headings, text, tables opened by their first row; asides in an appendix."""
    line = Window.partitionBy("path", "place").orderBy("page", "seq")
    cells = F.split("text", "\x1f")
    row = F.concat(F.lit("| "), F.array_join(F.transform(cells, cell_escape), " | "), F.lit(" |\n"))
    opens = F.coalesce(F.lag("label").over(line) != "tableRow", F.lit(True))
    closes = F.coalesce(F.lead("label").over(line) != "tableRow", F.lit(True))
    table = F.concat(row, F.when(opens, F.concat(F.repeat(F.lit("| --- "), F.size(cells)), F.lit("|\n"))).otherwise(""), F.when(closes, "\n").otherwise(""))
    told = F.when(F.col("label") == "tableRow", table).when(F.col("label") == "doc_title", F.concat(F.lit("# "), "text", F.lit("\n\n"))).when(F.col("label") == "paragraph_title", F.concat(heading(F.col("level")), F.lit(" "), "text", F.lit("\n\n"))).when(F.col("kind") == "list", F.concat(F.lit("- "), "text", F.lit("\n\n"))).otherwise(F.concat("text", F.lit("\n\n")))
    rows = items.withColumn("t", told)
    part = lambda p: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("place") == p, F.struct("page", "seq", "t")))), lambda x: x["t"]), "")
    out = rows.groupBy("path").agg(part("main").alias("main"), part("aside").alias("aside"))
    return out.select("path", F.concat("main", F.when(F.col("aside") != "", F.concat(F.lit("---\n\nSECONDARY ELEMENT:\n\n"), "aside")).otherwise("")).alias("text"))


def read_xlsx(spark: SparkSession, root: str) -> DataFrame:
    return read_with(spark, root, "*.xlsx", raw_cells, CELLS)


def read_docx(spark: SparkSession, root: str) -> DataFrame:
    return labelled(read_with(spark, root, "*.docx", blocks_of_docx, BLOCKS))


def read_pptx(spark: SparkSession, root: str) -> DataFrame:
    return labelled(read_with(spark, root, "*.pptx", blocks_of_pptx, BLOCKS))
