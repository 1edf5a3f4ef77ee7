"""Format handlers on files built here, damaged ones included."""

import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from siltstone.operators import chunking
from siltstone.sources import files, formats, parsing
from siltstone.sources.formats import biff, grid, mail, markup, packages, records

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
X = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/").replace("_DOT_", "."), body)
    return out.getvalue()


def members(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def sections(name, data):
    return [(s.path, s.text) for s in formats.parse(name, data)[1].sections]


def test_markdown_and_text():
    note = b"---\ntitle: 'T'\n---\nintro\n# A #\none\n```\n# no\n```\n## B\ntwo\n# C\n"
    kind, found = formats.parse("x/n.md", note)
    assert (kind, found.title) == ("markdown", "T")
    assert sections("n.md", note) == [((), "---\ntitle: 'T'\n---\n\nintro"), (("A",), "one\n```\n# no\n```"), (("A", "B"), "two")]
    assert sections("a.log", b"\n\nx\n") == [((), "x")] and sections("a.txt", b" ") == []
    for bad in (("a.txt", b"a\0b"), ("a.zip", b"x"), ("a", b"x")):
        with pytest.raises(formats.Unreadable):
            formats.parse(*bad)


def test_grid():
    cells = {(1, 1): "Title", (3, 1): "Group", (3, 3): "Other", (4, 1): "a", (4, 2): "b", (4, 3): "c", (5, 1): "1", (5, 2): "2", (6, 3): "3", (7, 2): " "}
    found = grid.section("S", cells, [(3, 1, 3, 2)])
    assert found.text == "1: Title\n5: Group > a: 1 | Group > b: 2\n6: Other > c: 3" and found.locator == "sheet:S"
    assert grid.section("S", {(1, 1): "x", (9, 1): "y"}, []).text == "1: x\n9: y" and grid.section("S", {(1, 1): " "}, []) is None
    long_ = "h" * 70
    assert grid.section("S", {(r, c): (long_ if r == c == 1 else f"{r}{c}") for r in range(1, 6) for c in (1, 2)}, []).text.startswith(f"Column A = {long_}\n2: {'h' * 57}...: 21 | 12: 22")
    assert (grid.number(3.0), grid.number(0.1), grid.number(float("nan")), grid.letters(28)) == ("3", "0.1", "nan", "AB")


def test_html_and_xml():
    page = b"<html><head><title>T</title><style>x</style></head><body>a<h1>One</h1><p>b<br>c</p><h3>Deep</h3>d<h2>Two</h2><table><tr><th>x<td>y</td></tr><tr><td>1</td><td>2</td></tr></table><ul><li>i</ul><script>no</script></body>"
    kind, found = formats.parse("p.html", page)
    assert found.title == "T" and [(s.path, s.text) for s in found.sections][:3] == [((), "a"), (("One",), "b\nc"), (("One", "Deep"), "d")]
    assert found.sections[-1].path == ("One", "Two") and "1 | 2" in found.sections[-1].text and found.sections[-1].text.endswith("- i")
    assert sections("f.xml", b'<a k="1">t<b><c>x</c></b><d/></a>') == [(("a",), "/a [k=1]: t"), (("a", "b #1"), "/a/b/c: x")]
    wsdl = b'<definitions xmlns="w"><message name="M"><part name="p" element="e"/></message><portType name="P"><operation name="O"><input message="M"/></operation></portType><service name="S"><port name="Q" binding="B"><address location="http://h"/></port></service></definitions>'
    assert sections("s.wsdl", wsdl) == [(("Services",), "service S port Q binding B http://h"), (("Operations",), "P.O: input=M"), (("Messages",), "message M: p:e")]
    assert sections("t.xsd", b'<schema xmlns="x"><simpleType name="C"><restriction><enumeration value="r"/></restriction></simpleType><element name="E" type="C"/></schema>') == [(("Schema types",), "simpleType C: =r\nelement E (C):")]
    for bad in (b"<a>", b"<!DOCTYPE a [<!ENTITY x 'y'>]><a>&x;</a>"):
        with pytest.raises(formats.Unreadable):
            formats.parse("f.xml", bad)
    deep = b"<a>" * 5000 + b"x" + b"</a>" * 5000
    assert markup.xml("d.xml", deep).sections[-1].text.endswith("x")


def test_word():
    paragraph = lambda text, style=None, more="": f'<w:p><w:pPr>{f"""<w:pStyle w:val="{style}"/>""" if style else ""}{more}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
    body = paragraph("contents", "TOC1") + paragraph("One", "Own") + paragraph("text <w:x/>".replace("<w:x/>", "")) + "<w:p><w:r><w:delText>gone</w:delText><w:t>a</w:t><w:tab/><w:t>b</w:t><w:instrText>no</w:instrText></w:r></w:p>" + paragraph("Two", None, '<w:outlineLvl w:val="1"/>') + "<w:sdt><w:sdtContent>" + paragraph("inner") + "</w:sdtContent></w:sdt><w:tbl><w:tr><w:tc>" + paragraph("x") + "</w:tc><w:tc>" + paragraph("y") + "</w:tc></w:tr></w:tbl>"
    styles = f'<w:styles {W}><w:style w:type="paragraph" w:styleId="Own"><w:name w:val="mine"/><w:basedOn w:val="H"/></w:style><w:style w:type="paragraph" w:styleId="H"><w:name w:val="Heading 1"/></w:style></w:styles>'
    notes = f'<w:footnotes {W}><w:footnote w:type="separator"><w:p><w:r><w:t>-</w:t></w:r></w:p></w:footnote><w:footnote><w:p><w:r><w:t>note</w:t></w:r></w:p></w:footnote></w:footnotes>'
    data = members({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/styles.xml": styles, "word/footnotes.xml": notes, "word/media/i.png": "x", "docProps/core.xml": '<c xmlns:dc="d"><dc:title>Name</dc:title></c>'})
    kind, found = formats.parse("d.docx", data)
    assert [(s.path, s.text) for s in found.sections] == [(("One",), "text \na\tb".replace("text \n", "text\n")), (("One", "Two"), "inner\nx | y"), (("Footnotes",), "note")]
    assert found.metadata == {"title": "Name", "images": "1"} and found.warnings
    with pytest.raises(formats.Unreadable):
        formats.parse("d.docx", data[:100])


def test_slides():
    ns = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    shape = lambda text, kind=None: f'<p:sp><p:nvSpPr><p:nvPr>{f"""<p:ph type="{kind}"/>""" if kind else ""}</p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'
    data = members({
        "ppt/presentation.xml": f'<p:presentation {ns}><p:sldIdLst><p:sldId r:id="r1"/><p:sldId r:id="r2"/><p:sldId r:id="r9"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": RELS.format('<Relationship Id="r1" Target="slides/s1.xml"/><Relationship Id="r2" Target="/ppt/slides/s2.xml"/>'),
        "ppt/slides/s1.xml": f"<p:sld {ns}>{shape('Title', 'title')}{shape('line')}<p:pic/></p:sld>",
        "ppt/slides/s2.xml": f"<p:sld {ns}>{shape('first')}{shape('second')}</p:sld>",
        "ppt/slides/_rels/s1.xml.rels": RELS.format('<Relationship Id="n" Target="../notesSlides/n1.xml"/>'),
        "ppt/notesSlides/n1.xml": f"<p:notes {ns}>{shape('said', 'body')}{shape('1', 'sldNum')}</p:notes>",
    })
    kind, found = formats.parse("s.pptx", data)
    assert [(s.path, s.text) for s in found.sections] == [(("Slide 1: Title",), "line\nSpeaker notes:\nsaid"), (("Slide 2: first",), "second")] and len(found.warnings) == 2


def book(rows, strings=(), state=""):
    cells = "".join(f'<row r="{r}">' + "".join(f'<c r="{ref}" t="{t}"><v>{v}</v></c>' if t else f'<c r="{ref}"><v>{v}</v></c>' for ref, t, v in row) + "</row>" for r, row in enumerate(rows, 1))
    return members({
        "xl/workbook.xml": f'<workbook {X}><sheets><sheet name="S" sheetId="1" r:id="r1"{state}/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": RELS.format('<Relationship Id="r1" Target="worksheets/sheet1.xml"/>'),
        "xl/sharedStrings.xml": f"<sst {X}>" + "".join(f"<si><t>{s}</t><rPh><t>hint</t></rPh></si>" for s in strings) + "</sst>",
        "xl/worksheets/sheet1.xml": f'<worksheet {X}><sheetData>{cells}</sheetData><mergeCells><mergeCell ref="A4:A5"/></mergeCells></worksheet>',
    })


def test_workbook():
    data = book([[("A1", "s", 0), ("B1", "s", 1)], [("A2", "", 44000), ("B2", "b", 1)], [("A3", "str", "x"), ("B3", "", 0.5)], [("A4", "s", 2), ("B4", "e", "#N/A")], [("B5", "", 7)]], ("Day", "Flag", "both"), ' state="hidden"')
    found = formats.parse("b.xlsx", data)[1]
    assert found.sections[0].text == "2: Day: 44000 | Flag: TRUE\n3: Day: x | Flag: 0.5\n4: Day: both | Flag: #N/A\n5: Day: both | Flag: 7" and found.warnings == ["sheet 'S' is hidden"]
    specs = packages.workbook_specs(book([[("A1", "str", "Alarm list")], [("A2", "str", "Alarm ID"), ("B2", "str", "Alarm Name"), ("C2", "str", "Possible Causes")], [("A3", "", 26235), ("B3", "str", "Link"), ("C3", "str", "a; b")], [("A4", "str", "none")]]))
    assert [(s["kind"], s["id"], s["name"], s["causes"], s["severity"]) for s in specs] == [("alarm", "ALM-26235", "Link", ["a", "b"], None)]


def compound(stream):
    """A compound file with one stream of full sectors."""
    stream = stream.ljust(max(4096, -(-len(stream) // 512) * 512), b"\0")
    n = len(stream) // 512
    fat = [0xFFFFFFFD, 0xFFFFFFFE] + [k + 1 for k in range(2, n + 1)] + [0xFFFFFFFE]
    entry = lambda name, kind, start, size: (name.encode("utf-16-le") + b"\0\0").ljust(64, b"\0") + struct.pack("<H", 2 * len(name) + 2) + bytes([kind]) + b"\0" * 49 + struct.pack("<II", start, size) + b"\0" * 4
    directory = entry("Root Entry", 5, 0xFFFFFFFE, 0) + entry("Workbook", 2, 2, len(stream)) + b"\0" * 256
    head = biff.MAGIC + b"\0" * 16 + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + b"\0" * 10 + struct.pack("<IIIIIIIII", 1, 1, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0, 0)
    head = head[:0x4C].ljust(0x4C, b"\0") + struct.pack("<109I", 0, *[0xFFFFFFFF] * 108)
    return head + struct.pack(f"<{len(fat)}I", *fat).ljust(512, b"\xff") + directory + stream


def test_legacy_workbook():
    record = lambda kind, body: struct.pack("<HH", kind, len(body)) + body
    bof = record(biff.BOF, struct.pack("<HH", 0x0600, 5) + b"\0" * 12)
    strings = record(biff.SST, struct.pack("<II", 2, 2) + struct.pack("<HB", 5, 0) + b"he") + record(biff.CONTINUE, b"\x01" + "llo".encode("utf-16-le") + struct.pack("<HB", 2, 1) + "né".encode("utf-16-le"))
    sheet = bof + record(biff.LABELSST, struct.pack("<HHHI", 0, 0, 0, 0)) + record(biff.LABELSST, struct.pack("<HHHI", 0, 1, 0, 1))
    sheet += record(biff.NUMBER, struct.pack("<HHHd", 1, 0, 0, 2.5)) + record(biff.RK, struct.pack("<HHHI", 1, 1, 0, (1234 << 2) | 3)) + record(biff.MULRK, struct.pack("<HH", 2, 0) + struct.pack("<HIHI", 0, (7 << 2) | 2, 0, ((-5 & 0x3FFFFFFF) << 2) | 2) + struct.pack("<H", 1))
    sheet += record(biff.BOOLERR, struct.pack("<HHHBB", 3, 0, 0, 1, 0)) + record(biff.FORMULA, struct.pack("<HHH", 3, 1, 0) + b"\0\0\0\0\0\0\xff\xff" + b"\0" * 6) + record(biff.STRING, struct.pack("<HB", 3, 0) + b"res") + record(biff.EOF, b"")
    bound = lambda at: record(biff.BOUNDSHEET, struct.pack("<IBBBB", at, 1, 0, 1, 0) + b"S")
    head = bof + bound(0) + strings + record(biff.EOF, b"")
    stream = bof + bound(len(head)) + strings + record(biff.EOF, b"") + sheet
    found = formats.parse("b.xls", compound(stream))[1]
    assert found.sections[0].text == "2: hello: 2.5 | né: 12.34\n3: hello: 7 | né: -5\n4: hello: TRUE | né: res" and found.warnings == ["sheet 'S' is hidden"]
    for bad in (b"no", compound(b"x"), compound(record(biff.BOF, struct.pack("<HH", 0x0500, 5)) + b"\0" * 8), compound(bof + record(biff.FILEPASS, b"") + b"\0" * 8), compound(stream)[:1500]):
        with pytest.raises(formats.Unreadable):
            formats.parse("b.xls", bad)


MAIL = b"From: A <a@x.org>\r\nTo: b@x.org\r\nCc: C <c@x.org>\r\nSubject: INC-2026-1 down\r\nMessage-ID: <2@x>\r\nIn-Reply-To: <1@x>\r\nContent-Type: multipart/mixed; boundary=B\r\n\r\n--B\r\nContent-Type: text/html\r\n\r\n<p>see ALM-20104 and DSP  OPTM</p>\r\n--B\r\nContent-Disposition: attachment; filename=f.pdf\r\n\r\nxx\r\n--B--\r\n"


def test_mail():
    kind, found = formats.parse("m.eml", MAIL)
    assert [s.path[0] for s in found.sections] == ["Headers", "Message Body", "Attachments"] and found.sections[1].text == "see ALM-20104 and DSP OPTM"
    quoted = b"Subject: s\n\n> only\n> quotes"
    assert formats.parse("q.eml", quoted)[1].sections[1].text == "> only\n> quotes"
    box = b"From a Mon\n" + MAIL + b"\nFrom b Tue\nSubject: two\nMessage-ID: <1@x>\n\nhello"
    first, second = mail.mailbox(box)
    assert (first.recipients, first.attachments, first.identifiers) == (["b@x.org", "c@x.org"], ["f.pdf"], ["INC-2026-1", "ALM-20104", "DSP OPTM"]) and second.message_id == "1@x"
    assert ("INC-2026-1", "ALM-20104", "CORRELATED_WITH") in first.edges() and ("2@x", "1@x", "REPLIES_TO") in first.edges() and second.edges() == [("", "x", "")][:0]


def test_records():
    xml = b'<nfeProc xmlns="http://n"><NFe><infNFe Id="NFe123"><ide><nNF>9</nNF></ide><emit><CNPJ>12345678000195</CNPJ><xNome>E</xNome></emit><dest/><det><prod><cProd>P</cProd><qCom>x</qCom><rastro><nLote>L1</nLote></rastro><med><cProdANVISA>1023504910024</cProdANVISA></med></prod></det><det nItem="7"/></infNFe></NFe><protNFe><infProt><chNFe>777</chNFe></infProt></protNFe></nfeProc>'
    found = records.invoice(xml)
    assert (found.key, found.emitter["tax_id"], found.items[0]["quantity"], found.batches(), found.registrations()) == ("777", "12.345.678/0001-95", 0.0, ["L1"], ["1023504910024"])
    assert ("L1", "1023504910024", "REGISTERED_ANVISA") in found.edges() and not any(e[2] == "BILLED_TO" for e in found.edges())
    for bad in (b"<a/>", b"<!DOCTYPE x><a/>", b"no"):
        with pytest.raises(formats.Unreadable):
            records.invoice(bad)
    rows = records.table_rows("t", b"patient_id\tnote\nP1\tCID-10 E11.9\n\t\nP2\tcrm-sp 12345\n\tplain\n")
    assert [(r.index, r.primary, r.secondary) for r in rows[:2]] == [(1, "E11.9", ["CID-10 E11.9", "P1"]), (3, "CRM-SP 12345", ["P2"])] and rows[2].primary.startswith("ROW-")


def test_packages(spark):
    page = "<title>x</title><h1>ALM-26235 Link Down</h1><table><tr><th>Alarm ID</th><th>Alarm Severity</th></tr><tr><td>26235</td><td>Major</td></tr></table><h2><a>Possible Causes</a></h2><ul><li>dust</li><li>age</li></ul><h2>Procedure</h2><p>Run DSP OPTMODULE, then MOD CELL1.</p><img class='vsd' src='figure/a.png'><img src='note_1.png'>"
    inner = members({
        "profile.xml": "<p><libName>Book</libName><navi>nav/navi.xml</navi></p>",
        "nav/navi.xml": '<navi><node title="Alarms" url="p.html"><node title="Leaf"/></node></navi>',
        "nav/p.html": page,
        "maps/pid_bookmap_1.xml": '<bookmap><topic id="q" name="DSP CELL9"/></bookmap>',
        "q.html": "<p>about</p><table><tr><th>Parameter ID</th><th>Name</th><th>Range</th></tr><tr><td>ID</td><td>n</td><td>0-9</td></tr></table><p>VS.NR.Conn.Succ</p>",
        "resources/images.xml": '<i><image url="figure/a.png" msg="m"/></i>',
        "bad.xml": "<", "../out.html": "ALM-11111",
    })
    outer = members({"x/pkg.hwics": inner})
    found = packages.package(outer, "o.zip")
    assert (found.title, [(t.title, t.layer) for t in found.topics]) == ("Book", [("Book", "L2"), ("Alarms", "L1"), ("Leaf", "L0")])
    alarm = found.alarms[0]
    assert (alarm["alarm_id"], alarm["severity"], alarm["causes"], alarm["diagnostic"], alarm["remediation"], alarm["diagrams"], alarm["affected"]) == ("ALM-26235", "Major", ["dust", "age"], ["DSP OPTMODULE"], ["MOD CELL1"], ["nav/figure/a.png"], None)
    assert found.commands[0]["command"] == "DSP CELL9" and found.commands[0]["parameters"][0][:3] == ["ID", "n", "0-9"] and found.counters[0]["counter_id"] == "VS.NR.Conn.Succ" and found.images[0]["path"] == "resources/figure/a.png"
    frame = spark.createDataFrame([("o.zip", outer), ("bad.zip", b"x"), (None, None)], "path string, content binary")
    rows = parsing.package_specs(frame).collect()
    assert {(r.kind, r.id) for r in rows if r.kind} == {("alarm", "ALM-26235"), ("command", "DSP CELL9"), ("counter", "VS.NR.Conn.Succ")} and sum(r.error is not None for r in rows) == 2
    assert parsing.package_topics(frame).where("error is null").count() == 3
    assert {(r.source, r.relation) for r in parsing.edges(spark.createDataFrame([("p.hdx", inner)], "path string, content binary")).collect()} == {("ALM-26235", k) for k in ("CAUSED_BY", "DIAGNOSED_BY_MML", "REMEDIATED_BY_MML", "HAS_DIAGRAM")}


def test_handlers_are_total(spark):
    """Any bytes under any known ending give sections or an error, never a failed job."""
    import random

    draw = random.Random(1)
    bodies = [b"", b"\0", bytes(draw.randrange(256) for _ in range(700)), members({"a": "b"}), biff.MAGIC + b"\0" * 600, MAIL]
    rows = [(f"f{n}{ending}", body) for h in formats.handlers() for ending in h.extensions for n, body in enumerate(bodies)] + [("x.unknown", b""), (None, None)]
    found = parsing.sections(spark.createDataFrame(rows, "path string, content binary").repartition(4))
    assert {r.path or "" for r in found.where("error is not null").collect()} <= {r[0] or "" for r in rows} and found.where("error is null and kind <> 'warning'").count() > 0
    assert parsing.sections(spark.createDataFrame([], "path string, content binary")).count() == 0
    assert spark.createDataFrame([("a.MD",), ("b.xlsx",), ("c",)], "p string").select(parsing.format_of(F.col("p"))).collect() == [("markdown",), ("xlsx",), (None,)]


def test_a_handler_of_ones_own():
    @formats.handler("upper", ".up", priority=1)
    def upper(name, data):
        return formats.Document(name, [formats.Section((), data.decode().upper())])

    assert formats.parse("a.up", b"x")[1].sections[0].text == "X"


def test_members_by_address(spark, tmp_path):
    import tarfile

    import zstandard

    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w") as t:
        info = tarfile.TarInfo("in/t.txt")
        info.size = 3
        t.addfile(info, io.BytesIO(b"tar"))
    (tmp_path / "a.tar.zst").write_bytes(zstandard.compress(tar.getvalue()))
    (tmp_path / "b.zip").write_bytes(members({"x y.txt": "one", "z.txt": "two"}))
    found = files.scan(spark, str(tmp_path))
    asked = spark.createDataFrame([(f"archive://{tmp_path}/a.tar.zst#in/t.txt",), (f"archive://{tmp_path}/b.zip#x%20y.txt",), (f"archive://{tmp_path}/b.zip#no",), ("nothing",)], "uri string")
    rows = {r.uri.rsplit("/", 1)[-1]: r.text or r.error for r in files.resolve(asked, found).collect()}
    assert rows == {"t.txt": "tar", "b.zip#x%20y.txt": "one", "b.zip#no": "not found", "nothing": "no address"}
    (tmp_path / "d/e").mkdir(parents=True)
    (tmp_path / "d/e/f.md").write_text("x")
    (tmp_path / "n/below").mkdir(parents=True)
    (tmp_path / "n/q.no-index").write_text("x")
    (tmp_path / "n/below/g.md").write_text("x")
    stats = files.directory_stats(spark.createDataFrame([("/n/.no-index", 1), ("/n/below/g.md", 1), ("/d/e/f.md", 5), ("/d/e/h.MD", 6)], "path string, size long"))
    assert [(r.directory, r.files, r.bytes, r.formats) for r in stats.collect()] == [("/d/e", 2, 11, {".md": 2})]


def test_chunks_are_lossless(spark):
    import random

    draw = random.Random(7)
    texts = ["".join(draw.choice(["word", " ", "\n", "\n\n", "x" * 50, ". ", "# h\n", "- i\n", "$$ a = b $$", "```\ncode\n```\n", "; "]) for _ in range(draw.randint(0, 700))) for _ in range(60)]
    for text in texts:
        for policy in chunking.PROFILES.values():
            found = chunking.spans(text, policy)
            assert not text and not found or found[0][0] == 0 and found[-1][1] == len(text) and all(a < b <= a + policy.chars for a, b in found) and all(x[1] >= y[0] > x[0] for x, y in zip(found, found[1:]))  # noqa: B905
        body = text.strip()
        windows = chunking.Windows(body, 32, 100, 16, "header")
        pieces = list(windows.all())
        covered = [False] * len(body)
        for a, b, kind in pieces:
            covered[a:b] = [True] * (b - a)
            assert kind in ("header", "paragraph", "clause", "math_preserved") and not (windows.around(b) and b < len(body))
        assert all(c or body[i].isspace() for i, c in enumerate(covered))
    sections_ = [formats.Section(("A", f"h{n}"), "t" * draw.choice([0, 5, 300, 5000])) for n in range(40)] + [formats.Section(("B",), "1: x | y\n2: z" * 400, "sheet:S", "rows")]
    document = formats.Document("D", sections_)
    for policy in chunking.PROFILES.values():
        chunks = chunking.document_chunks(document, policy)
        for n, section in enumerate(sections_):
            seen = sorted((a, b) for c in chunks for k, a, b in c.spans if k == n)
            at = 0
            for a, b in seen:
                assert a <= at
                at = max(at, b)
            assert at == len(section.text)
        assert any("rows 1-" in c.locator for c in chunks) and all(c.header.startswith("[D > ") for c in chunks)
    note = "---\ntitle: T\ntags:\n- a\n- 'b'\nclearance: odd\n---\nintro\n\n# T\n\nx <!-- clearance: public -->\n## Sub\ny\n"
    rows = list(chunking.markdown("p/n.md", note))
    assert [(r[4], r[11], r[9]) for r in rows] == [("T", 3, 8), ("T", 0, 10), ("Sub", 3, 13)] and rows[0][7] == ["a", "b"]
    frame = spark.createDataFrame([("n.md", note.encode()), ("x.bin", b"\0")], "path string, content binary")
    assert {(r.path, r.total, r.error is None) for r in chunking.file_chunks(frame).collect()} == {("n.md", 2, True), ("x.bin", None, False)}
    sheets = spark.createDataFrame([("f", 0, 50, "rows"), ("f", 1, 80, "rows"), ("f", 2, 10, "text"), ("g", 0, 30, "rows")], "path string, section int, n long, kind string")
    assert {(r.path, r.section) for r in chunking.catalog_cards(sheets, 70).where("card").collect()} == {("f", 1)}


def test_an_invoice_reads_the_name_of_each_element_a_few_times(monkeypatch):
    """Each field looked through all children of its element."""
    from siltstone.sources.formats import records

    item = '<det nItem="{0}"><prod><cProd>P{0}</cProd><qCom>{0}</qCom><vProd>1.5</vProd><rastro><nLote>L{0}</nLote></rastro></prod></det>'
    body = f"<NFe><infNFe Id=\"NFe{'7' * 44}\"><ide><nNF>1</nNF></ide>{''.join(item.format(i) for i in range(1, 101))}</infNFe></NFe>"
    seen, local = [0], records.local
    monkeypatch.setattr(records, "local", lambda tag: (seen.__setitem__(0, seen[0] + 1), local(tag))[1])
    v = records.invoice(body.encode())
    assert [(i["item"], i["code"], i["quantity"], i["batches"][0]["batch"]) for i in v.items] == [(i, f"P{i}", float(i), f"L{i}") for i in range(1, 101)]
    assert seen[0] < 5 * body.count("</")
