"""Files made here are read as they were meant."""

import io
import zipfile


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
M = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def par(*runs):
    return "<w:p>" + "".join(f"<w:r><w:t>{x}</w:t></w:r>" for x in runs) + "</w:p>"


def cell(*lines):
    return "<w:tc>" + "".join(map(par, lines)) + "</w:tc>"


def test_docx(spark):
    from terrace.sources.documents import docx_text, extracted

    table = f"<w:tbl><w:tr>{cell('a', 'b')}{cell('c')}</w:tr><w:tr>{cell('')}{cell('d')}</w:tr></w:tbl>"
    good = zipped({"word/document.xml": f"<w:document {W}><w:body>{par('One ', 'line')}{table}{par('Two')}</w:body></w:document>"})
    assert docx_text(good) == "One line\nTwo\na b | c\n | d"
    files = [("/x/a.docx", good), ("/x/b.docx", b"no archive"), ("/x/c.odd", b"text"), ("/x/d.TXT", "café \xff".encode("latin-1")), ("/x/e.md", b" ")]
    df = spark.createDataFrame([(p, len(c), bytearray(c)) for p, c in files], "path string, length long, content binary")
    got = {r.name: r for r in extracted(df, 3).collect()}
    assert got["a.docx"].error is None and got["a.docx"].text.startswith("One line\nTwo")
    assert got["b.docx"].text is None and got["b.docx"].error
    assert "odd" in got["c.odd"].error
    assert got["d.TXT"].text.startswith("caf")
    assert got["e.md"].text is None and got["e.md"].error == "No extractable text found"


def test_workbook(spark, tmp_path):
    from terrace.sources.tables import read_workbook

    rows = '<row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>n</t></is></c><c r="C1" t="s"><v>0</v></c></row>'
    rows += '<row/><row><c r="A3" t="s"><v>1</v></c><c r="B3"><v>2.5</v></c><c r="C3" t="b"><v>1</v></c></row><row><c r="C4"><v>7</v></c></row>'
    parts = {
        "xl/sharedStrings.xml": f"<sst {M}><si><t>id</t></si><si><r><t> x</t></r><r><t>y </t></r></si></sst>",
        "xl/workbook.xml": f'<workbook {M} {R}><sheets><sheet name="blank" r:id="r1"/><sheet name="data" r:id="r2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/one.xml"/><Relationship Id="r2" Target="/xl/worksheets/two.xml"/></Relationships>',
        "xl/worksheets/one.xml": f"<worksheet {M}><sheetData/></worksheet>",
        "xl/worksheets/two.xml": f"<worksheet {M}><sheetData>{rows}</sheetData></worksheet>",
    }
    path = tmp_path / "book.xlsx"
    path.write_bytes(zipped(parts))
    df, sheet, others = read_workbook(spark, str(path))
    assert (sheet, others, df.columns) == ("data", ["blank"], ["id", "n", "id_2"])
    assert [tuple(r) for r in df.collect()] == [("xy", "2.5", "true"), (None, None, "7")]


def test_delimited(spark, tmp_path):
    from terrace.sources.tables import read_delimited

    path = tmp_path / "t.csv"
    path.write_bytes('﻿\n;;\nid;;id\n1;"a;\n""b""";\n;;\n 2 ; ;z\n'.encode())
    df = read_delimited(spark, str(path))
    assert df.columns == ["id", "column_2", "id_2"]
    assert sorted(tuple(r) for r in df.collect()) == [("1", 'a;\n"b"', None), ("2", None, "z")]
