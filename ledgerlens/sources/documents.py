"""Text files, Markdown blocks and act corpora."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import decode


def read_texts(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """(path, text): UTF-8 with or without a mark, else cp1251."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)

    def run(frames):
        for f in frames:
            yield pd.DataFrame({"path": f["path"], "text": [decode(bytes(x)) for x in f["content"]]})

    return files.select("path", "content").mapInPandas(run, "path string, text string")


def lines(texts: DataFrame, id_: str = "path") -> DataFrame:
    return texts.select(id_, F.posexplode(F.split("text", "\n")).alias("line_no", "text")).withColumn("line_no", F.col("line_no") + 1)


def split_pages(texts: DataFrame, id_: str = "path", declared: str | None = None) -> DataFrame:
    """Pages of texts that part them by form feeds; a blank last one goes. Where the column `declared` gives another count of
    pages (above 0), pages beyond it go and missing ones are empty."""
    parts = F.split("text", "\f")
    parts = F.when(F.trim(F.regexp_replace(F.element_at(parts, -1), r"\s", "")) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    if declared is not None:
        n = F.greatest(F.coalesce(F.col(declared), F.lit(0)).cast("int"), F.lit(0))
        parts = F.when(n > 0, F.slice(F.concat(parts, F.array_repeat(F.lit(""), n)), F.lit(1), n)).otherwise(parts)
    return texts.select(id_, F.posexplode(parts).alias("page", "text")).withColumn("page", F.col("page") + 1)


def blocks(md_lines: DataFrame, id_: str = "path") -> DataFrame:
    """Markdown as typed blocks: runs of lines of one kind."""
    t = F.col("text")
    kind = F.when(t.rlike(r"^\s*$"), "blank").when(t.startswith("# "), "title").when(t.rlike(r"^#{2,6} "), "heading").when(t.startswith("|"), "table").when(t.startswith(">"), "quote").when(t.rlike(r"^\s*([-*•]|[0-9]+[.)]) "), "list").otherwise("paragraph")
    w = Window.partitionBy(id_).orderBy("line_no")
    k = md_lines.withColumn("kind", kind)
    alone = F.col("kind").isin("title", "heading")
    k = k.withColumn("block", F.sum((alone | ~F.col("kind").eqNullSafe(F.lag("kind").over(w))).cast("int")).over(w))
    return k.where("kind <> 'blank'").groupBy(id_, "block", "kind").agg(F.min("line_no").alias("first_line"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("text"))


#: Beginnings that mark the parts of a court paper, and how its lines are told.
MINI_HEADS = ("Обжалуемые судебные акты", "Суть спора", "Участники спора")
REQUESTS = ("ПРОШУ", "Требую", "Требуем", "Ходатайства", "Ходатайство")
ENCLOSURES, SIGNED = "Приложение", "Представитель"
SOURCES = r"^(?:Постановление|Определение|Решение|Обзор|Пленум|п\.|ст\.|абз\.)"
LONGEST_SUBHEAD, LONGEST_SOURCE = 90, 160
_TITLE, _SECOND, _DATE = r"^\s*#\s+(.*\S)\s*$", r"^\s*##\s+(.*\S)\s*$", r"^\s*(\d{2}\.\d{2}\.\d{4})\s*$"
_NUMBERED, _BULLET, _QUOTE = r"^\s*(?:\d+)[.)]\s+(.*\S)\s*$", r"^\s*[—\-*]\s+(.*\S)\s*$", r"^\s*>\s?(.*)$"
_ROW, _SEPARATOR, _SUBHEAD = r"^\s*\|(.+)\|\s*$", r"^\s*\|?[\s:\-|]+\|?\s*$", r"^\s*[А-Д]\.\s+.*\S\s*$"
_REQUEST_TAIL = r"^\s*(?:При новом рассмотрении.*|.*просит суд:)\s*$"


def paper_blocks(texts: DataFrame, id_: str = "path") -> DataFrame:
    """(id, block, type, text, items, rows, role, name): a paper in Markdown as its blocks, in order.

    Lines before the title are the header. A date counts right after the title, a source right after a quotation. Points of
    one list stand on lines without a blank between them; numbered ones and others make a block each, the numbered first.
    Rows of a table and lines of a quotation go together; separators of tables are no rows. One window over a text's lines
    tells what a line is, one aggregate makes the blocks; control characters are taken out first."""
    clean = F.regexp_replace(F.regexp_replace("text", "\r\n?", "\n"), r"[\x00-\x08\x0b-\x1f]", "")
    t, s = F.col("text"), F.regexp_replace("text", r"^\s+|\s+$", "")
    starts = lambda marks: F.lit(False) if not marks else starts(marks[1:]) | F.col("s").startswith(marks[0])
    ls = lines(texts.select(id_, clean.alias("text")), id_).withColumn("s", s)
    kind = (
        F.when(F.col("s") == "", "blank").when(t.rlike(_TITLE), "title").when(t.rlike(_DATE), "date?").when(t.rlike(_SECOND), "h2").when(t.rlike(_ROW), "table").when(t.rlike(_QUOTE), "quote")
        .when(starts((ENCLOSURES,)), "appendix_head").when(starts((SIGNED,)), "signature").when(starts(REQUESTS), "prosba_head").when(t.rlike(_REQUEST_TAIL), "prosba_tail").when(starts(MINI_HEADS), "minihead")
        .when(t.rlike(_SUBHEAD) & (F.length("s") <= LONGEST_SUBHEAD), "subhead").when(t.rlike(_NUMBERED), "numlist").when(t.rlike(_BULLET), "bullet").otherwise("para")
    )
    w = Window.partitionBy(id_).orderBy("line_no")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    k = ls.withColumn("k", kind).withColumn("titles", F.count_if(F.col("k") == "title").over(w)).withColumn("any_title", F.max(F.when(F.col("k") == "title", 1).otherwise(0)).over(Window.partitionBy(id_)))
    k = k.withColumn("last", F.last(F.when(F.col("k") != "blank", F.col("k")), ignorenulls=True).over(before))
    header = (F.col("titles") == 0) & (F.col("any_title") == 1)
    source = F.col("s").rlike(SOURCES) & (F.length("s") <= LONGEST_SOURCE) & (F.col("last") == "quote")
    type_ = F.when(header & (F.col("k") != "blank"), "header").when(F.col("k") == "date?", F.when(F.col("last") == "title", "date").otherwise("para")).when((F.col("k") == "para") & source, "source").otherwise(F.col("k"))
    k = k.withColumn("type", type_)
    joint = F.when(F.col("type").isin("numlist", "bullet"), "list").when(F.col("type").isin("table", "quote"), F.col("type"))
    k = k.withColumn("joint", joint).withColumn("part", F.sum(F.when(F.col("joint").isNotNull() & F.col("joint").eqNullSafe(F.lag("joint").over(w)), 0).otherwise(1)).over(w))
    k = k.withColumn("part", F.when(header, 0).otherwise(F.col("part")))
    cells = F.transform(F.split(F.regexp_replace("s", r"^\|+|\|+$", ""), r"\|"), lambda c: F.regexp_replace(c, r"^\s+|\s+$", ""))
    one = F.struct(
        "line_no",
        F.when(F.col("type") == "title", F.regexp_extract(t, _TITLE, 1)).when(F.col("type") == "h2", F.regexp_extract(t, _SECOND, 1)).when(F.col("type") == "quote", F.regexp_replace(F.regexp_extract(t, _QUOTE, 1), r"^\s+|\s+$", ""))
        .when(F.col("type") == "numlist", F.regexp_extract(t, _NUMBERED, 1)).when(F.col("type") == "bullet", F.regexp_extract(t, _BULLET, 1)).when(F.col("type") == "header", t).otherwise(F.col("s")).alias("text"),
        F.when((F.col("type") == "table") & ~t.rlike(_SEPARATOR), cells).alias("cells"),
    )
    b = k.where("type <> 'blank'").groupBy(id_, "part", "type").agg(F.array_sort(F.collect_list(one)).alias("ls"))
    order = F.row_number().over(Window.partitionBy(id_).orderBy("part", F.desc("type")))  # of one list the numbered points first
    texts_of = F.transform("ls", lambda x: x["text"])
    items = F.when(F.col("type").isin("numlist", "bullet", "header"), texts_of)
    text = F.when(F.col("type") == "quote", F.array_join(F.filter(texts_of, lambda x: x != ""), " ")).when(items.isNull() & (F.col("type") != "table"), F.get(texts_of, F.lit(0)))
    rows = F.when(F.col("type") == "table", F.filter(F.transform("ls", lambda x: x["cells"]), lambda c: c.isNotNull()))
    out = b.select(id_, order.alias("block"), "type", text.alias("text"), items.alias("items"), rows.alias("rows"))
    part = lambda n: F.trim(F.when(F.col("text").contains("\t"), F.regexp_extract("text", r"(?s)^([^\t]*)\t(.*)$", n)).otherwise(F.regexp_extract("text", "(?s)^(.*)  (.*)$", n)))
    two = F.col("text").rlike(r"\t|  ")
    sign = F.col("type") == "signature"
    return out.select("*", F.when(sign, F.when(two, part(1)).otherwise(F.col("text"))).alias("role"), F.when(sign, F.when(two, part(2)).otherwise("")).alias("name"))


def paragraphs(act_lines: DataFrame, id_: str = "act") -> DataFrame:
    """Numbered items of acts with their paragraphs: the last number seen holds until the next one."""
    w = Window.partitionBy(id_).orderBy("line_no")
    n = F.nullif(F.regexp_extract("text", r"^\s*([0-9]+)\.\s", 1), F.lit("")).try_cast("int")
    r = act_lines.where(F.trim("text") != "").withColumn("item", F.last(n, ignorenulls=True).over(w)).where("item is not null")
    return r.withColumn("para_no", F.row_number().over(Window.partitionBy(id_, "item").orderBy("line_no")))


def without_notes(texts: DataFrame, mark: str = "## Примечания") -> DataFrame:
    """Texts cut at the last line that begins with the mark."""
    at = F.length("text") - F.instr(F.reverse("text"), F.reverse(F.lit("\n" + mark))) - len(mark)
    return texts.withColumn("text", F.when(F.contains("text", F.lit("\n" + mark)), F.substring("text", F.lit(1), at)).otherwise(F.col("text")))
