"""File sources, digests and text operators on small files."""

import hashlib
import zipfile

from pyspark.sql import functions as F

from ledgerlens.operators import text
from ledgerlens.sources import documents, html, sinks, tables

X = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def book(path):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {X} xmlns:r="r"><sheets><sheet name="Лист" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {X}><si><t>Дата</t></si><si><t>Сумма</t></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {X}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet {X}><sheetData><row r="3"><c r="A3" t="s"><v>0</v></c><c r="C3" t="s"><v>1</v></c></row><row r="4"><c r="A4" s="1"><v>46054</v></c><c r="C4"><f>1+1</f></c></row><row r="5"><c r="A5" t="inlineStr"><is><t>ИТОГО</t></is></c><c r="C5"><v>7.5</v></c></row></sheetData></worksheet>')


def test_tables(spark, tmp_path):
    book(tmp_path / "a.xlsx")
    (tmp_path / "b.csv").write_bytes("Дата;Сумма\n01.02.2026;1,5\n".encode("cp1251"))
    (tmp_path / "c.xls").write_bytes(b"old")
    (tmp_path / "d.xlsx").write_bytes(b"broken")
    (tmp_path / "e.csv").write_bytes(b"")
    t = tables.read_tables(spark, str(tmp_path)).withColumn("file", F.element_at(F.split("file", "/"), -1)).cache()
    got = {(r.file, r.row_no): (r.cells, r.error) for r in t.collect()}
    assert got[("a.xlsx", 4)][0] == ["2026-02-01", None, None] and got[("a.xlsx", 5)][0] == ["ИТОГО", None, "7.5"]
    assert got[("b.csv", 1)][0] == ["Дата", "Сумма"] and got[("b.csv", 2)][0] == ["01.02.2026", "1,5"]
    assert [next(e for (n, _), (_, e) in got.items() if n == f).split(":")[0] for f in ("c.xls", "d.xlsx", "e.csv")] == ["legacy-format", "corrupt", "empty"]
    d = {r.file: r for r in tables.digest(t.where("error is null")).collect()}
    assert d["a.xlsx"].header_row == 3 and d["a.xlsx"].stale_formulas == 1 and d["a.xlsx"].totals[0].row_no == 5
    assert tables.as_markdown(t.where("file = 'b.csv' and row_no = 2")).first().line == "| 01.02.2026 | 1,5 |"
    wide = spark.createDataFrame([("f", "s", 1, ["a", "Note: ", None, "", "x|y"] + ["z"] * 8)], "file string, sheet string, row_no int, cells array<string>")
    assert tables.as_markdown(wide).first().line == "1: a; 2: Note: ; 5: x\\|y; " + "; ".join(f"{i}: z" for i in range(6, 14))


def test_documents(spark, tmp_path):
    (tmp_path / "x.txt").write_bytes("# Т\n\n1. Один.\nещё\n- a\n- b\n## Примечания\nконец".encode())
    t = documents.read_texts(spark, str(tmp_path))
    b = [(r.kind, r.first_line) for r in documents.blocks(documents.lines(t)).orderBy("block").collect()]
    assert b == [("title", 1), ("list", 3), ("paragraph", 4), ("list", 5), ("heading", 7), ("paragraph", 8)]
    assert not documents.without_notes(t).first().text.endswith("конец")
    p = documents.paragraphs(documents.lines(t).withColumnRenamed("path", "act")).where("item = 1").orderBy("para_no").collect()
    assert p[0].text == "1. Один." and p[1].para_no == 2


def test_html():
    assert html.parse("<nav>menu</nav><div>a <b>b</b></div><script>x</script><p>c</p>") == ("a b\nc", "menux")


def test_split_top_level(spark):
    def plain(said):
        depth, quoted, out = 0, False, [""]
        for c in said:
            depth += (c == "(") - (c == ")" and depth > 0)
            quoted = c == "«" or (quoted and c != "»")
            if c == ";" and not depth and not quoted:
                out.append("")
            else:
                out[-1] += c
        return [x.strip() for x in out if x.strip()]

    import random

    r = random.Random(1)
    said = ["а (б; в); г «д; е»; ж", "а (б (в; г); д; е); ж", ");а;(", "", ";;", "«а; (б»; в); г"] + ["".join(r.choices("аб ;()«»", k=r.randint(0, 25))) for _ in range(200)]
    got = spark.createDataFrame(list(enumerate(said)), "i int, t string").select("i", text.split_top_level(F.col("t")).alias("x")).collect()
    assert {x.i: x.x for x in got} == {i: plain(t) for i, t in enumerate(said)}


def test_replace_keeps_five_copies(spark, tmp_path):
    p = str(tmp_path / "t")
    for n in range(1, 9):
        sinks.replace(spark.range(n), p)
    assert spark.read.parquet(p).count() == 8
    kept = sorted(x.name for x in tmp_path.iterdir())
    assert kept == ["t", *[f"t.copy-{k}" for k in range(3, 8)]] and spark.read.parquet(f"{p}.copy-7").count() == 7


def test_texts_and_manifests(spark, tmp_path):
    rows = [("a.txt", "http://x", "2026-01-01", None, "body\nmore", "old"), ("b.txt", "http://y", None, "law", "other", None)]
    t = sinks.with_provenance(spark.createDataFrame(rows, "file string, source_url string, fetched string, reason string, body string, notes string"))
    got = {r.file: r.text for r in t.collect()}
    assert got["a.txt"] == "source_url: http://x\nfetched: 2026-01-01\nreason: -\n\nbody\nmore\n## Примечания\nold" and got["b.txt"].endswith("\n\nother")
    sinks.write_texts(t, str(tmp_path / "m"))
    assert {r.file for r in spark.read.text(str(tmp_path / "m")).select("file").distinct().collect()} == {"a.txt", "b.txt"}
    m = sinks.manifest(spark.createDataFrame([(1, "02", "h2", 5), (1, "01", "h1", 3)], "package int, label string, content_hash string, n_bytes long"), "package").first()
    assert (m.n_files, m.n_bytes) == (2, 8) and m.digest == hashlib.sha256(b"01 h1\n02 h2").hexdigest()


def test_digests_of_sheets(spark):
    rows = [("f.csv", "csv", 1, ["Дата", "Сумма", None], 0), ("f.csv", "csv", 2, ["01.02.2026", "5"], 0), ("f.csv", "csv", 3, ["03.02.2026", "7"], 0), ("f.csv", "csv", 4, ["Сальдо", "12"], 0), ("f.csv", "csv", 5, [None, " "], 0)]
    s = spark.createDataFrame(rows, "file string, sheet string, row_no int, cells array<string>, stale_formulas int")
    t = tables.trimmed(s)
    assert sorted(r.row_no for r in t.collect()) == [1, 2, 3, 4] and {len(r.cells) for r in tables.padded(t).collect()} == {3}
    d = tables.digest(t).first()
    assert (d.rows, d.header_row, [x.row_no for x in d.totals], str(d.date_min), str(d.date_max), d.date_col) == (4, 1, [4], "2026-02-01", "2026-02-03", 0)
    doc = tables.digest_document(tables.digest(t)).first().text
    assert doc.startswith("# f.csv\n\n## csv\nrows: 4") and "| 2 | 01.02.2026 | 5 |" in doc and "total rows:\n| 4 | Сальдо | 12 |" in doc
    assert tables.ingest_csv(s).first().fulltext and not tables.ingest_csv(s, 3).first().fulltext


def test_anchor_of_a_card():
    card = "case:\n  number: A1\n  bankruptcy:\n    case_opened_date: 2026-05-04  # first\nother:\n  case_opened_date: 2020-01-01\n"
    assert str(tables.anchor_date(card)[0]) == "2026-05-04"
    assert tables.anchor_date("case:\n  number: 1\n") == (None, "there is no such field")
    assert tables.anchor_date("case:\n  bankruptcy:\n    case_opened_date:\n")[1] == "the field is empty"
    assert tables.anchor_date("case:\n  bankruptcy:\n    x: 1\nother:\n  case_opened_date: 2020-01-01\n")[0] is None


def test_streaming_counters(spark, tmp_path):
    from ledgerlens.streaming import events

    spark.createDataFrame([(1, "2024-01-01 00:00:01", 7, "a", 1.0), (1, "2024-01-01 00:00:01", 7, "a", 1.0), (2, "2024-01-01 00:10:00", 7, "a", 2.0), (3, "2024-01-01 05:00:00", 7, "b", 1.0)], "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double").parquet(str(tmp_path / "in"))
    q = events.counters(src).writeStream.outputMode("append").format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.event_type, r.n, r.total) for r in spark.sql("select * from counted").collect()] == [("a", 2, 3.0)]


def test_docx_in_order(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{p('Раз')}<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl>{p('Два')}</w:body></w:document>")
    got = tables.read_tables(spark, str(tmp_path)).orderBy("row_no").collect()
    assert [(r.sheet, r.row_no, r.cells) for r in got] == [("text", 1, ["Раз"]), ("table", 2, ["a", "b"]), ("text", 3, ["Два"])]


def test_html_documents_odd_pages():
    assert html.document(None) == ("", [], []) and html.document("<p>no container</p>") == ("", [], [])
    assert html.document('<div class="full-text__wrapper">x</div><div class="full-text"><p>a<p>b<br>c</div>after') == ("a\n\nb\n\nc", [], [])
    assert html.document('<div class="full-text">a<div class="notes">n<div class="bn">m</div></div>b') == ("a\n\nb", [], [("notes", "n m")])
    assert html.document('<div class="full-text"></span>a<style>p{}</style>&amp;lt;\xa0b<div class="banner">open') == ("a< b", [], [("banner", "open")])
    assert html.document('<div class="full-text"><div class="doc-insert"> КонсультантПлюс: см. </div></div><div class="full-text">c</div>') == ("c", ["КонсультантПлюс: см."], [])


def test_findings_written_by_code(spark, tmp_path):
    rows = [("f", "s", "E1", "error", "m"), ("f", "s", "W1", "warning", "m"), ("f", "t", "W1", "warning", "m")]
    f = spark.createDataFrame(rows, "file string, sheet string, code string, severity string, message string")
    sinks.write_findings(f, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).where("code = 'W1'").count() == 2
    assert {tuple(r) for r in sinks.severity_counts(f).collect()} == {("f", "s", 1, 2), ("f", "t", 0, 1)}


def test_pages_split(spark):
    t = spark.createDataFrame([(1, "a\fb\f", 0), (2, "a\fb", 3), (3, "a\fb\fc", 1), (4, "a", None), (5, None, 1)], "id long, text string, declared int")
    got = sorted((r.id, r.page, r.text) for r in documents.split_pages(t, "id", "declared").collect())
    assert got == [(1, 1, "a"), (1, 2, "b"), (2, 1, "a"), (2, 2, "b"), (2, 3, ""), (3, 1, "a"), (4, 1, "a")]


def test_sessions_on_a_stream(spark, tmp_path):
    from ledgerlens.streaming import events

    rows = [(1, "2026-01-01 00:00:00"), (1, "2026-01-01 00:20:00"), (1, "2026-01-01 02:00:00"), (2, "2026-01-01 00:00:00")]
    e = spark.createDataFrame(rows, "user_id long, ts string").selectExpr("user_id", "cast(ts as timestamp) as ts")
    e.write.parquet(str(tmp_path / "in"))
    q = events.sessions(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("by_session").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert sorted((r.user_id, r.n) for r in spark.table("by_session").collect()) == [(1, 1), (1, 2), (2, 1)]
