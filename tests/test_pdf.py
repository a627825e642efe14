import zlib

from lectern.sources.pdf import Scanner, read_pdf, unpredicted


def test_grammar():
    assert Scanner(rb"<< /A#20b [1 -2.5 (x\(y\)\101\n) <4142> true] /C 3 0 R >>").value() == {"A b": [1, -2.5, b"x(y)A\n", b"AB", True], "C": 3}


def test_predictors():
    assert unpredicted(bytes([0, 1, 2, 2, 1, 1, 1, 5, 1]), 2) == bytes([1, 2, 2, 3, 5, 6])


def pdf(content: bytes) -> bytes:
    body = zlib.compress(content)
    cmap = b"1 beginbfchar <01> <0048> endbfchar 1 beginbfrange <02> <03> <0069> endbfrange"
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>",
        b"<< /Type /Pages /Kids [3 0 R] /MediaBox [0 0 200 100] /Resources << /Font << /F 5 0 R /G 6 0 R >> >> >>",
        b"<< /Type /Page /Contents 4 0 R /Annots [8 0 R] >>",
        b"<< /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(body), body),
        b"<< /Subtype /Type1 /BaseFont /Sans-Bold /FirstChar 65 /Widths [1000 500] >>",
        b"<< /Subtype /Type1 /BaseFont /Own /ToUnicode 7 0 R >>",
        b"<< /Length %d >>\nstream\n%s\nendstream" % (len(cmap), cmap),
        b"<< /Rect [0 0 10 10] /A << /URI (http://x.y) >> >>",
    ]
    return b"%PDF-1.4\n" + b"\n".join(b"%d 0 obj\n%s\nendobj" % (k, o) for k, o in enumerate(objects, 1))


def test_pages(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(pdf(b"1 0 0 rg BT /F 10 Tf 20 50 Td (AB) Tj [(A) -1000 (B)] TJ ET q 2 0 0 2 0 0 cm 5 5 10 10 re Q BT /G 10 Tf 1 0 0 1 0 90 Tm <010203> Tj ET"))
    rows = read_pdf(spark, f"file://{tmp_path}").orderBy("page", "seq").collect()
    assert [(r.kind, r.text, r.x0, r.x1) for r in rows] == [("text", "AB", 2000, 3500), ("text", "A", 3500, 4500), ("text", "B", 5500, 6000), ("rect", None, 1000, 3000), ("text", "Hij", 0, 1500), ("link", "http://x.y", 0, 1000)]
    first = rows[0]
    assert (first.y0, first.y1, first.size, first.bold, first.color, first.width, first.height) == (4200, 5200, 1000, True, "#ff0000", 20000, 10000)
