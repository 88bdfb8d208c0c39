"""Rules of ingest and triage: file states, pages to look at, grades, composite files, links to a table of contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import kind_status, page_status, tax_ids

#: Suffixes by how a file is taken in.
KINDS = {"table": ("xlsx", "xlsm", "csv"), "text": ("txt", "md"), "document": ("docx",), "pages": ("pdf",), "image": ("png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp"), "refused": ("xls", "doc", "rtf", "odt")}
#: Classes of documents that decide a case.
DECISIVE = ("ruling", "judgment", "act", "contract", "statement", "calculation")


def file_kind(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit("unknown")
    for kind, names in KINDS.items():
        out = F.when(suffix.isin(*names), kind).otherwise(out)
    return out


#: What an error says, and its numbers, where a file is not there yet.
ABSENT = ("no such file", "cannot find", "not materialized", "input/output error", "stale file")
ABSENT_NUMBERS = (2, 5, 11, 13, 116)
#: Headings of documents of their own; and those that count only on a court's letterhead.
HEADINGS = ("платежное поручение", "счет-фактура", "счет на оплату", "универсальный передаточный документ", "товарная накладная", "товарно-транспортная накладная", "приходный кассовый ордер", "расходный кассовый ордер")
COURT, COURT_HEADINGS = "арбитражный суд", ("определение", "решение", "постановление")


def open_error(size: Column, message: Column, number: Column | None = None) -> Column:
    """empty, not_materialized or corrupt; null where there is no error (no message and no number)."""
    m = F.lower(message)
    absent = F.lit(False)
    for mark in ABSENT:
        absent = absent | F.coalesce(m.contains(mark), F.lit(False))
    failed = message.isNotNull()
    if number is not None:
        absent, failed = absent | F.coalesce(number.isin(*ABSENT_NUMBERS), F.lit(False)), failed | number.isNotNull()
    return F.when(failed & F.coalesce(size == 0, F.lit(False)), "empty").when(failed & absent, "not_materialized").when(failed, "corrupt")


def retryable(error: Column) -> Column:
    return F.coalesce(error == "not_materialized", F.lit(False))


def vision_pages(pages: DataFrame, doc: str, limit: int = 15, head: int = 10) -> DataFrame:
    """Per document the pages a reader must look at; above `limit` of them, the first ones and the last. pages: (doc, page,
    has_images) with text, or with kind where text_kind() has been told already."""
    s = pages.withColumn("status", kind_status("kind", "has_images") if "kind" in pages.columns else page_status("text", "has_images"))
    need = F.array_sort(F.collect_list(F.when(F.col("status").isin("scan", "garbage"), F.col("page"))))
    g = s.groupBy(doc).agg(F.count("*").alias("n_pages"), need.alias("need"))
    short = F.array_distinct(F.concat(F.slice("need", 1, head), F.slice("need", -1, 1)))
    return g.select(doc, "n_pages", F.size("need").alias("n_need"), F.when(F.size("need") > limit, short).otherwise(F.col("need")).alias("look_at"), (F.size("need") > limit).alias("structural"))


def head_key(text: Column, n: int = 300) -> Column:
    """The beginning of a page in lower case, ё as е, white space as single blanks."""
    return F.regexp_replace(F.translate(F.lower(F.substring(text, 1, n)), "ё", "е"), r"\s+", " ")


def composite(pages: DataFrame, doc: str, headings: tuple[str, ...] = HEADINGS) -> DataFrame:
    """Documents in which one heading stands at the head of two pages or more, so that several files may be bound into one:
    headings with their pages, and how many tax ids the document names (beside the headings, never alone). Pages
    without a text layer are left out."""
    s = pages.withColumn("_head", head_key(F.col("text"))).where(page_status("text", "has_images") == "text")
    found = [F.when(F.col("_head").contains(h), h) for h in headings] + [F.when(F.col("_head").contains(COURT) & F.col("_head").contains(h), h) for h in COURT_HEADINGS]
    marks = F.concat(
        F.transform(F.array_compact(F.array(*found)), lambda h: F.struct(F.lit("heading").alias("kind"), h.alias("value"))),
        F.transform(F.array_distinct(tax_ids("text")), lambda t: F.struct(F.lit("tax").alias("kind"), t.alias("value"))),
    )
    each = s.select(doc, "page", F.explode(marks).alias("m")).groupBy(doc, "m.kind", "m.value").agg(F.array_sort(F.collect_set("page")).alias("pages"))
    repeated = (F.col("kind") == "heading") & (F.size("pages") >= 2)
    one = each.groupBy(doc).agg(F.array_sort(F.collect_list(F.when(repeated, F.struct("value", "pages")))).alias("headings"), F.count_if(F.col("kind") == "tax").alias("n_tax_ids"))
    return one.where(F.size("headings") > 0)


def origin(sender: Column, parties: dict[str, Column], own: Column) -> Column:
    """client, opponent, court or ally by who sent it, own-work by us, else unclear."""
    out = F.lit("unclear")
    for role, match in reversed(list(parties.items())):
        out = F.when(F.coalesce(match, F.lit(False)), role).otherwise(out)
    return F.when(F.coalesce(own, F.lit(False)), "own-work").otherwise(F.when(sender.isNotNull(), out).otherwise("unclear"))


def belongs(named: Column, number: Column, source: Column | None = None) -> Column:
    """False only on a positive contradiction: numbers are named and the case's is not among them. Where none is named, or
    the paper is our own work, there is nothing to tell from: null."""
    unknown = number.isNull() | named.isNull() | (F.size(named) == 0)
    if source is not None:
        unknown = unknown | F.coalesce(source == "own-work", F.lit(False))
    return F.when(~unknown, F.array_contains(named, number))


def grade(method: Column, unreadable: Column, unsure: Column, truncated: Column, unsaved_formulas: Column, few: int = 2) -> dict[str, Column]:
    """quality and needs_manual_review by way of extraction, unreadable places (more than `few` are many), critical fields read
    with low confidence, truncated renders, and formulas without saved values. A table is high or low, never between."""
    table = method == "table-structure"
    low = F.when(table, unsaved_formulas).otherwise((unreadable > few) | (unsure >= 3) | truncated)
    quality = F.when(low, "low").when(table | ((unreadable == 0) & (unsure == 0)), "high").otherwise("medium")
    return {"quality": quality, "needs_manual_review": low | (~table & (unsure > 0))}


def resolve_contents(wanted: DataFrame, contents: DataFrame, key: str) -> DataFrame:
    """Each wanted article with its address: found, missing, repealed or ambiguous."""
    c = contents.groupBy(key).agg(F.count("*").alias("_n"), F.min("url").alias("url"), F.max(F.col("title").rlike("(?iu)утратил")).alias("_gone"))
    state = F.when(F.col("_n").isNull(), "missing").when(F.col("_gone"), "repealed").when(F.col("_n") > 1, "ambiguous").otherwise("found")
    return wanted.join(c, key, "left").select(*wanted.columns, F.when(state == "found", F.col("url")).alias("url"), state.alias("state"))


def matching_samples(docs: DataFrame, samples: DataFrame) -> DataFrame:
    """Samples by shared norms (an equi join on each norm), else by relation and type."""
    d = docs.select("doc_id", "relation", "doc_type", "norms")
    one = d.select("doc_id", F.explode("norms").alias("norm")).join(samples.select("sample_id", F.explode("norms").alias("norm")), "norm").groupBy("doc_id", "sample_id").agg(F.count("*").alias("shared"))
    rest = d.join(one.select("doc_id").distinct(), "doc_id", "left_anti").join(samples.select("sample_id", "relation", "doc_type"), ["relation", "doc_type"]).select("doc_id", "sample_id", F.lit(0).cast("long").alias("shared"))
    return one.withColumn("via", F.lit("norms")).unionByName(rest.withColumn("via", F.lit("type")))


def aligned(ours: DataFrame, theirs: DataFrame, node: str) -> DataFrame:
    """Arguments against counter-arguments by issue: one full join, `state` tells what stands alone."""
    a, b = ours.groupBy(node).agg(F.count("*").alias("ours")), theirs.groupBy(node).agg(F.count("*").alias("theirs"))
    j = a.join(b, node, "full")
    return j.withColumn("state", F.when(F.col("theirs").isNull(), "unopposed").when(F.col("ours").isNull(), "unanswered").otherwise("met"))
