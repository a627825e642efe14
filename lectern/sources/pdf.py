"""PDF files as positioned elements (S2-S10): a reader in Arrow batches, one file a task at a time."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from lectern.sources.office import read_with

ELEMENTS = "path string, page long, width long, height long, seq long, kind string, text string, x0 long, y0 long, x1 long, y1 long, font string, size long, bold boolean, color string"
_SPACE, _DELIMITER = b" \t\r\n\x0c\x00", b"()<>[]{}/%"
_BLANK = re.compile(rb"(?:[ \t\r\n\x0c\x00]+|%[^\r\n]*)*")
_WORD = re.compile(rb"[^ \t\r\n\x0c\x00()<>\[\]{}/%]+")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)$")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Name(str):
    pass


class Ref(int):
    pass


class Op(str):
    pass


class Scanner:
    """Values of the object grammar from a position on."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at

    def value(self):
        """The next value; ``None`` at the end, an ``Op`` for any other word."""
        d = self.data
        self.at = _BLANK.match(d, self.at).end()
        c = d[self.at : self.at + 1]
        if not c:
            return None
        if d.startswith(b"<<", self.at):
            self.at += 2
            items = self.until(b">>")
            return {k: v for k, v in zip(items[::2], items[1::2])}
        if c == b"[":
            self.at += 1
            return self.until(b"]")
        if c == b"(":
            return self.literal()
        if c == b"<":
            end = d.find(b">", self.at)
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", d[self.at + 1 : end])
            self.at = end + 1
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b"/":
            m = _WORD.match(d, self.at + 1)
            self.at = m.end() if m else self.at + 1
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), m[0]).decode("latin-1") if m else "")
        m = _WORD.match(d, self.at)
        if not m:
            self.at += 1
            return Op(c.decode("latin-1"))
        self.at = m.end()
        if _NUMBER.match(m[0]):
            ref = re.compile(rb"\s+\d+\s+R(?![A-Za-z])").match(d, self.at) if m[0].isdigit() else None
            if ref:
                self.at = ref.end()
                return Ref(int(m[0]))
            return float(m[0]) if b"." in m[0] else int(m[0])
        return {b"true": True, b"false": False}.get(m[0], Op(m[0].decode("latin-1")))

    def until(self, close: bytes) -> list:
        out = []
        while True:
            self.at = _BLANK.match(self.data, self.at).end()
            if self.data.startswith(close, self.at) or self.at >= len(self.data):
                self.at += len(close)
                return out
            out.append(self.value())

    def literal(self) -> bytes:
        d, out, deep, at = self.data, bytearray(), 1, self.at + 1
        while at < len(d) and deep:
            c = d[at : at + 1]
            if c == b"\\":
                octal = re.compile(rb"[0-7]{1,3}").match(d, at + 1)
                if octal:
                    out.append(int(octal[0], 8) & 255)
                    at = octal.end()
                    continue
                e = d[at + 1 : at + 2]
                at += 3 if d.startswith(b"\r\n", at + 1) else 2
                out += b"" if e in b"\r\n" else _ESCAPES.get(e, e)
                continue
            deep += (c == b"(") - (c == b")")
            if deep:
                out += c
            at += 1
        self.at = at
        return bytes(out)


class Document:
    def __init__(self, data: bytes) -> None:
        self.objects: dict[int, object] = {}
        self.streams: dict[int, bytes] = {}
        for m in re.finditer(rb"(?<!\d)(\d+)\s+\d+\s+obj\b", data):
            s = Scanner(data, m.end())
            value = s.value()
            self.objects[int(m[1])] = value
            start = re.compile(rb"\s*stream\r?\n").match(data, s.at)
            if start and isinstance(value, dict):
                size = self.get(value.get("Length"))
                end = start.end() + size if isinstance(size, int) and data[start.end() + size :].lstrip(_SPACE).startswith(b"endstream") else data.find(b"endstream", start.end())
                self.streams[int(m[1])] = data[start.end() : end]
        for number, value in list(self.objects.items()):
            if isinstance(value, dict) and value.get("Type") == "ObjStm":
                body, first = self.stream(Ref(number)), self.get(value.get("First"))
                heads = [int(x) for x in body[:first].split()]
                for n, at in zip(heads[::2], heads[1::2]):
                    self.objects.setdefault(n, Scanner(body, first + at).value())

    def get(self, value):
        seen = 0
        while isinstance(value, Ref) and seen < 50:
            value, seen = self.objects.get(int(value)), seen + 1
        return value

    def stream(self, ref) -> bytes:
        """A stream's bytes, inflated where Flate is its filter, predictors undone."""
        head, raw = self.get(ref), self.streams.get(int(ref), b"")
        filters = self.get(head.get("Filter"))
        if "FlateDecode" not in ([filters] if isinstance(filters, Name) else filters or []):
            return raw
        try:
            out = zlib.decompressobj().decompress(raw)
        except zlib.error:
            return b""
        parms = self.get(head.get("DecodeParms")) or {}
        parms = parms[0] if isinstance(parms, list) and parms else parms
        return unpredicted(out, int(parms.get("Columns", 1))) if isinstance(parms, dict) and parms.get("Predictor", 1) >= 10 else out

    def pages(self) -> Iterator[tuple[dict, dict]]:
        """Pages in order, with what they inherit."""
        root = next((v for v in self.objects.values() if isinstance(v, dict) and v.get("Type") == "Catalog"), {})
        todo = [(self.get(root.get("Pages")), {})]
        for _ in range(1_000_000):
            if not todo:
                return
            node, above = todo.pop()
            if not isinstance(node, dict):
                continue
            own = above | {k: node[k] for k in ("Resources", "MediaBox") if k in node}
            if "Kids" in node:
                todo += [(self.get(k), own) for k in reversed(self.get(node["Kids"]) or [])]
            else:
                yield node, own


def unpredicted(data: bytes, columns: int) -> bytes:
    """PNG predictors of one-byte pixels, row by row."""
    out, before = bytearray(), bytearray(columns)
    for k in range(0, len(data), columns + 1):
        kind, row = data[k], bytearray(data[k + 1 : k + 1 + columns])
        for i in range(len(row)):
            a, b, c = (row[i - 1] if i else 0), before[i], (before[i - 1] if i else 0)
            near = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            row[i] = (row[i] + (0, a, b, (a + b) // 2, near)[kind if kind < 5 else 0]) & 255
        out += row
        before = row + bytearray(columns - len(row))
    return bytes(out)


class Font:
    """How a font's codes read and how far they go."""

    def __init__(self, doc: Document, font: dict) -> None:
        self.name = str(doc.get(font.get("BaseFont")) or "")
        self.wide = doc.get(font.get("Subtype")) == "Type0"
        self.map: dict[int, str] = {}
        if isinstance(font.get("ToUnicode"), Ref):
            self.read_map(doc.stream(font["ToUnicode"]))
        self.widths: dict[int, float] = {}
        if self.wide:
            inner = doc.get((doc.get(font.get("DescendantFonts")) or [None])[0]) or {}
            items = [doc.get(x) for x in doc.get(inner.get("W")) or []]
            while len(items) >= 2:
                if isinstance(items[1], list):
                    self.widths |= {int(items[0]) + i: float(doc.get(w)) for i, w in enumerate(items[1])}
                    items = items[2:]
                else:
                    self.widths |= {c: float(items[2]) for c in range(int(items[0]), int(items[1]) + 1)}
                    items = items[3:]
        else:
            first = doc.get(font.get("FirstChar")) or 0
            self.widths = {first + i: float(doc.get(w) or 0) for i, w in enumerate(doc.get(font.get("Widths")) or [])}

    def read_map(self, data: bytes) -> None:
        word = lambda b: "".join(chr(int.from_bytes(b[i : i + 2], "big")) for i in range(0, len(b), 2))
        for kind, body in re.findall(rb"begin(bfchar|bfrange)(.*?)end\1", data, re.S):
            items = Scanner(body + b"]").until(b"]")
            if kind == b"bfchar":
                self.map |= {int.from_bytes(a, "big"): word(b) for a, b in zip(items[::2], items[1::2])}
                continue
            for a, z, to in zip(items[::3], items[1::3], items[2::3]):
                low, high = int.from_bytes(a, "big"), int.from_bytes(z, "big")
                for c in range(low, min(high, low + 65535) + 1):
                    self.map[c] = (word(to[c - low]) if c - low < len(to) else "") if isinstance(to, list) else word(to[:-2]) + chr(int.from_bytes(to[-2:], "big") + c - low)

    def read(self, data: bytes) -> tuple[str, list[float]]:
        step = 2 if self.wide else 1
        codes = [int.from_bytes(data[i : i + step], "big") for i in range(0, len(data), step)]
        return "".join(self.map.get(c, chr(c) if not self.wide else "") for c in codes), [self.widths.get(c, 500.0) / 1000 for c in codes]


def times(m, n):
    """Matrix ``m`` applied before ``n``."""
    return (m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5])


def elements(doc: Document, page: dict, own: dict, height: float) -> Iterator[tuple]:
    """``kind, text, x0, y0, x1, y1, font, size, bold, color`` in drawing order; y grows downward."""
    parts = doc.get(page.get("Contents"))
    refs = parts if isinstance(parts, list) else [page["Contents"]] if "Contents" in page else []
    resources = doc.get(own.get("Resources")) or {}
    fonts = {k: Font(doc, doc.get(v)) for k, v in (doc.get(resources.get("Font")) or {}).items() if isinstance(doc.get(v), dict)}
    images = doc.get(resources.get("XObject")) or {}
    s, held = Scanner(b"\n".join(doc.stream(r) for r in refs if isinstance(r, Ref))), []
    one = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    ctm, saved, tm, line, font, size, color = one, [], one, one, None, 0.0, "#000000"
    gap, word, scale, lead = 0.0, 0.0, 1.0, 0.0
    shade = lambda v: "#" + "".join(f"{int(max(0, min(1, x)) * 255 + 0.5):02x}" for x in v)

    def show(data: bytes):
        nonlocal tm
        if font is None:
            return
        text, widths = font.read(data)
        go = sum((w * size + gap + (word if not font.wide and b == 32 else 0)) * scale for w, b in zip(widths, data if not font.wide else widths))
        at = times(tm, ctm)
        tm = times((1, 0, 0, 1, go, 0), tm)
        to, tall = times(tm, ctm), abs(size) * (at[2] ** 2 + at[3] ** 2) ** 0.5
        if text.strip():
            yield "text", text, min(at[4], to[4]), height - at[5] - 0.8 * tall, max(at[4], to[4]), height - at[5] + 0.2 * tall, font.name, tall, "bold" in font.name.lower(), color

    while (v := s.value()) is not None:
        if not isinstance(v, Op):
            held.append(v)
            continue
        n = [x for x in held if isinstance(x, (int, float)) and not isinstance(x, (bool, Ref))]
        if v == "q":
            saved.append(ctm)
        elif v == "Q" and saved:
            ctm = saved.pop()
        elif v == "cm" and len(n) == 6:
            ctm = times(n, ctm)
        elif v == "BT":
            tm = line = one
        elif v == "Tf" and n and isinstance(held[0], Name):
            font, size = fonts.get(held[0]), float(n[-1])
        elif v in ("Td", "TD") and len(n) == 2:
            lead = -n[1] if v == "TD" else lead
            tm = line = times((1, 0, 0, 1, n[0], n[1]), line)
        elif v == "Tm" and len(n) == 6:
            tm = line = tuple(map(float, n))
        elif v == "TL" and n:
            lead = n[0]
        elif v == "Tc" and n:
            gap = n[0]
        elif v == "Tw" and n:
            word = n[0]
        elif v == "Tz" and n:
            scale = n[0] / 100
        elif v in ("T*", "'", '"'):
            tm = line = times((1, 0, 0, 1, 0, -lead), line)
        elif v in ("g", "rg", "k") and n:
            rgb = [n[0]] * 3 if v == "g" else n if v == "rg" else [(1 - c) * (1 - n[3]) for c in n[:3]]
            color = shade(rgb[:3])
        elif v == "re" and len(n) == 4:
            a, b = times((1, 0, 0, 1, n[0], n[1]), ctm), times((1, 0, 0, 1, n[0] + n[2], n[1] + n[3]), ctm)
            yield "rect", None, min(a[4], b[4]), height - max(a[5], b[5]), max(a[4], b[4]), height - min(a[5], b[5]), None, None, None, color
        elif v == "Do" and held and (doc.get(images.get(held[-1])) or {}).get("Subtype") == "Image":
            a, b = (ctm[4], ctm[5]), (ctm[4] + ctm[0] + ctm[2], ctm[5] + ctm[1] + ctm[3])
            yield "image", str(held[-1]), min(a[0], b[0]), height - max(a[1], b[1]), max(a[0], b[0]), height - min(a[1], b[1]), None, None, None, None
        elif v == "BI":
            s.at = (m.end() if (m := re.compile(rb"\sEI(?=\s|$)").search(s.data, s.at)) else len(s.data))
        if v in ("Tj", "'", '"') and held and isinstance(held[-1], bytes):
            yield from show(held[-1])
        elif v == "TJ" and held and isinstance(held[-1], list):
            for item in held[-1]:
                if isinstance(item, bytes):
                    yield from show(item)
                elif isinstance(item, (int, float)):
                    tm = times((1, 0, 0, 1, -item / 1000 * size * scale, 0), tm)
        held = []
    for note in doc.get(page.get("Annots")) or []:
        note = doc.get(note)
        action = doc.get(note.get("A")) if isinstance(note, dict) else None
        if isinstance(action, dict) and isinstance(doc.get(action.get("URI")), bytes):
            x0, y0, x1, y1 = (float(doc.get(x)) for x in doc.get(note["Rect"]))
            yield "link", doc.get(action["URI"]).decode("latin-1"), min(x0, x1), height - max(y0, y1), max(x0, x1), height - min(y0, y1), None, None, None, None


def elements_of_pdf(path: str, content: bytes) -> Iterator[tuple]:
    """Rows of ``ELEMENTS``; lengths in hundredths of a point."""
    doc = Document(content)
    cent = lambda x: None if x is None else round(100 * x)
    for number, (page, own) in enumerate(doc.pages(), 1):
        box = [float(doc.get(x)) for x in doc.get(own.get("MediaBox")) or (0, 0, 595, 842)]
        width, height = box[2] - box[0], box[3] - box[1]
        for seq, (kind, text, x0, y0, x1, y1, font, size, bold, color) in enumerate(elements(doc, page, own, height), 1):
            yield path, number, cent(width), cent(height), seq, kind, text, cent(x0), cent(y0), cent(x1), cent(y1), font, cent(size), bold, color


def read_pdf(spark: SparkSession, root: str) -> DataFrame:
    return read_with(spark, root, "*.pdf", elements_of_pdf, ELEMENTS)
