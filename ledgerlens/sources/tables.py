"""Spreadsheets and delimited text as sheet relations, without third-party readers.

Files are read with Spark's own binaryFile source (any store, split by file); each is parsed in an
Arrow-batched map. Row numbers are the file's own.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from fnmatch import fnmatch
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHEET = "file string, sheet string, row_no int, cells array<string>, stale_formulas int, error string"
_A1 = re.compile(r"([A-Z]+)(\d+)")


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _column(ref: str) -> int:
    n = 0
    for c in ref:
        n = n * 26 + ord(c) - 64
    return n - 1


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Cell styles whose number format shows a date."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root, formats, styles = ElementTree.fromstring(book.read("xl/styles.xml")), {}, set()
    for e in root.iter():
        if _local(e.tag) == "numFmt":
            formats[int(e.get("numFmtId"))] = re.sub(r'"[^"]*"|\[[^\]]*\]', "", e.get("formatCode", "")).lower()
    for e in root.iter():
        if _local(e.tag) == "cellXfs":
            for i, x in enumerate(e):
                k = int(x.get("numFmtId", 0))
                if 14 <= k <= 22 or "y" in formats.get(k, "") or "d" in formats.get(k, ""):
                    styles.add(i)
    return styles


def _value(kind: str, raw: str | None, inline: str, shared: list[str], is_date: bool) -> str | None:
    if kind == "s":
        return shared[int(raw)] if raw else None
    if kind == "inlineStr":
        return inline
    if kind == "b":
        return {"1": "TRUE", "0": "FALSE"}.get(raw or "")
    if raw and is_date:
        at = datetime(1899, 12, 30) + timedelta(days=float(raw))
        return at.date().isoformat() if at.time() == at.time().min else at.isoformat(sep=" ", timespec="seconds")
    return raw


def parse_xlsx(data: bytes) -> Iterator[tuple[str, int, list, int]]:
    """(sheet, row number, cells, formulas in the row that have no cached value), sheet after sheet."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            for e in ElementTree.fromstring(book.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in e.iter() if _local(t.tag) == "t"))
        dates = _date_styles(book)
        rels = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        for s in (e for e in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if _local(e.tag) == "sheet"):
            rid = next(v for k, v in s.attrib.items() if _local(k) == "id")
            target = rels[rid].lstrip("/")
            path = target if target.startswith("xl/") else f"xl/{target}"
            last = 0
            with book.open(path) as f:
                for _, row in ElementTree.iterparse(f):
                    if _local(row.tag) != "row":
                        continue
                    last = int(row.get("r", last + 1))
                    cells, stale = [], 0
                    for c in row:
                        at = _column(_A1.match(c.get("r"))[1]) if c.get("r") else len(cells)
                        parts = {_local(x.tag): x for x in c}
                        raw = parts["v"].text if "v" in parts else None
                        stale += "f" in parts and raw is None
                        inline = "".join(t.text or "" for t in c.iter() if _local(t.tag) == "t")
                        cells += [None] * (at - len(cells))
                        cells.append(_value(c.get("t", "n"), raw, inline, shared, int(c.get("s", 0)) in dates))
                    yield s.get("name"), last, cells, stale
                    row.clear()


def decode(data: bytes) -> str:
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("cp1251", "replace")


def parse_csv(data: bytes) -> Iterator[tuple[str, int, list, int]]:
    text = decode(data)
    head = text[:4096]
    try:
        dialect = csv.Sniffer().sniff(head, delimiters=";,\t|")
        sep = dialect.delimiter
    except csv.Error:
        sep = max(";,\t|", key=head.count)
    for i, row in enumerate(csv.reader(io.StringIO(text), delimiter=sep), 1):
        yield "csv", i, [c if c != "" else None for c in row], 0


def parse_docx(data: bytes) -> Iterator[tuple[str, int, list, int]]:
    """Paragraphs and table rows of a document, in order."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        body = next(e for e in ElementTree.fromstring(book.read("word/document.xml")) if _local(e.tag) == "body")
    text = lambda e: "".join(t.text or "" for t in e.iter() if _local(t.tag) == "t")
    n = 0
    for e in body:
        if _local(e.tag) == "p":
            n += 1
            yield "text", n, [text(e)], 0
        elif _local(e.tag) == "tbl":
            for row in (x for x in e if _local(x.tag) == "tr"):
                n += 1
                yield "table", n, [text(c) for c in row if _local(c.tag) == "tc"], 0


PARSERS = {"xlsx": parse_xlsx, "xlsm": parse_xlsx, "csv": parse_csv, "docx": parse_docx}
REFUSED = ("xls", "doc", "rtf", "odt")


def parse(path: str, data: bytes) -> Iterator[tuple]:
    """Rows of one file; a file that cannot be read is one row with the reason, never silence."""
    kind = path.rsplit(".", 1)[-1].lower()
    if not data:
        yield None, None, None, None, "empty"
        return
    if kind not in PARSERS:
        yield None, None, None, None, "legacy-format" if kind in REFUSED else "unknown-format"
        return
    try:
        for x in PARSERS[kind](data):
            yield (*x, None)
    except Exception as e:  # a damaged file is a result of its own
        yield None, None, None, None, f"corrupt: {type(e).__name__}"


def empty_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """SHEET rows for files without content, which Spark's file sources do not list."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(p, True)
    names = []
    while found.hasNext():
        f = found.next()
        if f.getLen() == 0 and fnmatch(f.getPath().getName(), glob):
            names.append((f.getPath().toString(), None, None, None, None, "empty"))
    return spark.createDataFrame(names, SHEET)


def read_tables(spark: SparkSession, path: str, glob: str = "*", prune: str | None = None, report_empty: bool = True) -> DataFrame:
    """SHEET rows of all files under a path. prune: a pattern of paths to leave out. report_empty lists the
    folder once more for files without content, so that none goes unsaid."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    if prune:
        files = files.where(~F.col("path").rlike(prune))

    def run(frames):
        for f in frames:
            for p, data in zip(f["path"], f["content"]):
                rows = []
                for sheet, n, cells, stale, error in parse(p, bytes(data)):
                    rows.append((p, sheet, n, cells, stale, error))
                    if len(rows) == 5000:
                        yield pd.DataFrame(rows, columns=["file", "sheet", "row_no", "cells", "stale_formulas", "error"])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["file", "sheet", "row_no", "cells", "stale_formulas", "error"])

    rows = files.select("path", "content").mapInPandas(run, SHEET)
    if not report_empty:
        return rows
    none = empty_files(spark, path, glob)
    return rows.unionByName(none.where(~F.col("file").rlike(prune)) if prune else none)


def header_rows(sheets: DataFrame, look: int = 20) -> DataFrame:
    """(file, sheet, header_row): among the first rows the one with most text cells, two at least; two more
    points if a non-empty row follows; the first of equals."""
    from pyspark.sql import Window

    text = F.size(F.filter("cells", lambda c: c.isNotNull() & c.rlike(r"\p{L}")))
    full = F.size(F.filter("cells", lambda c: F.coalesce(F.trim(c), F.lit("")) != "")) > 0
    w = Window.partitionBy("file", "sheet").orderBy("row_no")
    r = sheets.where(F.col("row_no") <= look).withColumn("_t", text).withColumn("_next", F.coalesce(F.lead(full).over(w), F.lit(False)))
    good = r.where("_t >= 2").withColumn("_s", F.col("_t") + F.when(F.col("_next"), 2).otherwise(0))
    return good.groupBy("file", "sheet").agg(F.max_by("row_no", F.struct("_s", -F.col("row_no"))).alias("header_row"))


def trimmed(sheets: DataFrame) -> DataFrame:
    """Sheets without the empty rows at their ends."""
    full = F.exists("cells", lambda c: F.coalesce(F.trim(c), F.lit("")) != "")
    last = sheets.where(full).groupBy("file", "sheet").agg(F.max("row_no").alias("last_row"))
    return sheets.join(last, ["file", "sheet"]).where("row_no <= last_row").drop("last_row")


def padded(sheets: DataFrame) -> DataFrame:
    """Rows filled up with empty cells to their sheet's width, so that no value moves to the left."""
    width = sheets.groupBy("file", "sheet").agg(F.max(F.size("cells")).alias("width"))
    fill = F.array_repeat(F.lit(""), F.col("width") - F.size("cells"))
    return sheets.join(width, ["file", "sheet"]).withColumn("cells", F.concat(F.transform("cells", lambda c: F.coalesce(c, F.lit(""))), fill)).drop("width")


def digest(sheets: DataFrame, sample: int = 15, totals: int = 20) -> DataFrame:
    """Structural digest of each sheet: size, header, first rows, total rows (a wider set of marks than the calculation's),
    and the first and last date of its first column that holds dates in most rows."""
    from ledgerlens.functions.scalars import is_total_row, parse_date
    from pyspark.sql import Window

    heads = header_rows(sheets)
    s = sheets.join(heads, ["file", "sheet"], "left").withColumn("joined", F.array_join("cells", " "))
    w = Window.partitionBy("file", "sheet").orderBy("row_no")
    after = F.col("row_no") > F.col("header_row")
    s = s.withColumn("is_total", is_total_row("joined", "digest") & F.coalesce(after, F.lit(True))).withColumn("_total_no", F.sum(F.col("is_total").cast("int")).over(w))
    pick = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.struct("row_no", "cells"))))
    out = s.groupBy("file", "sheet").agg(F.max("row_no").alias("rows"), F.max(F.size("cells")).alias("cols"), F.max("header_row").alias("header_row"), F.max(F.when(F.col("row_no") == F.col("header_row"), F.col("cells"))).alias("header"), pick(after & (F.col("row_no") <= F.col("header_row") + sample)).alias("sample"), pick(F.col("is_total") & (F.col("_total_no") <= totals)).alias("totals"), F.sum("stale_formulas").alias("stale_formulas"))
    cells = s.where(after).select("file", "sheet", F.posexplode("cells").alias("col", "cell")).where("trim(cell) <> ''")
    dated = cells.withColumn("d", parse_date("cell")).groupBy("file", "sheet", "col").agg(F.count("*").alias("n"), F.count("d").alias("dates"), F.min("d").alias("date_min"), F.max("d").alias("date_max"))
    first = dated.where("dates >= 2 and dates * 2 > n").groupBy("file", "sheet").agg(F.min(F.struct("col", "date_min", "date_max")).alias("r")).select("file", "sheet", F.col("r.col").alias("date_col"), "r.date_min", "r.date_max")
    return out.join(first, ["file", "sheet"], "left")


def ingest_csv(sheets: DataFrame, fulltext_rows: int = 300) -> DataFrame:
    """(file, rows, fulltext): small CSV tables go on as text, larger ones as a digest."""
    return trimmed(sheets).groupBy("file").agg(F.count("*").alias("rows")).withColumn("fulltext", F.col("rows") <= fulltext_rows)


def digest_document(digests: DataFrame) -> DataFrame:
    """(file, text): a Markdown document of each file's digests, sheet after sheet."""
    from ledgerlens.functions.scalars import markdown_escape

    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: markdown_escape(c)), " | "), F.lit(" |"))
    listed = lambda rows: F.transform(rows, lambda r: line(F.concat(F.array(r["row_no"].cast("string")), r["cells"])))
    some = lambda title, rows: F.when(F.size(rows) > 0, F.concat(F.array(F.lit(""), F.lit(title)), listed(rows))).otherwise(F.array().cast("array<string>"))
    top = F.array(F.concat(F.lit("## "), "sheet"), F.concat(F.lit("rows: "), F.col("rows").cast("string"), F.lit(", columns: "), F.col("cols").cast("string")))
    dates = F.when(F.col("date_min").isNotNull(), F.array(F.concat(F.lit("dates: "), F.col("date_min").cast("string"), F.lit(" to "), F.col("date_max").cast("string")))).otherwise(F.array().cast("array<string>"))
    head = F.when(F.col("header").isNotNull(), F.array(line(F.concat(F.array(F.lit("row")), "header")))).otherwise(F.array().cast("array<string>"))
    body = F.array_join(F.concat(top, dates, head, some("first rows:", F.col("sample")), some("total rows:", F.col("totals"))), "\n")
    parts = digests.select("file", F.struct("sheet", body.alias("body")).alias("p")).groupBy("file").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return parts.select("file", F.concat(F.lit("# "), "file", F.lit("\n\n"), F.array_join("p.body", "\n\n"), F.lit("\n")).alias("text"))


def anchor_date(card: str, path: tuple[str, ...] = ("case", "bankruptcy", "case_opened_date")):
    """(date, reason): one value of a card of nested `key: value` lines; without one, why there is none."""
    from datetime import date

    depth, at = -1, 0
    for raw in card.splitlines():
        line = raw.split(" #")[0].rstrip()
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        indent = len(line) - len(line.lstrip())
        if at and indent <= depth:
            break  # the block has ended
        key, _, value = line.strip().partition(":")
        if key == path[at] and (at == 0) == (indent == 0):
            depth, at = indent, at + 1
            if at == len(path):
                value = value.strip().strip("\"'")
                if value in ("", "null", "~"):
                    return None, "the field is empty"
                try:
                    return date.fromisoformat(value), None
                except ValueError:
                    return None, f"{value!r} is no date"
    return None, "there is no such field"


def as_markdown(sheets: DataFrame, most_columns: int = 12) -> DataFrame:
    """(file, sheet, row_no, line): a Markdown table row, or key: value pairs for wide sheets."""
    from ledgerlens.functions.scalars import markdown_escape

    cells = F.transform("cells", lambda c: markdown_escape(c))
    named = F.transform(cells, lambda c, i: F.struct((i + 1).cast("string").alias("no"), c.alias("cell")))
    wide = F.array_join(F.transform(F.filter(named, lambda x: x["cell"] != ""), lambda x: F.concat(x["no"], F.lit(": "), x["cell"])), "; ")
    return sheets.select("file", "sheet", "row_no", F.when(F.size("cells") <= most_columns, F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))).otherwise(wide).alias("line"))
