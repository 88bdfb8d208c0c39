"""Corpus checks: quotations, coverage, mentions, lists, links, runs of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(text) -> Column:
    """Lower case, signs and white space as single blanks, padded, so that containment respects words."""
    t = F.col(text) if isinstance(text, str) else text
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def coverage(items: DataFrame, used: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: how many items there are, how many are used, and used ones that do not exist."""
    i, u = items.select(*keys, "item").distinct().withColumn("is_item", F.lit(1)), used.select(*keys, "item").distinct().withColumn("is_used", F.lit(1))
    both = i.join(u, [*keys, "item"], "full")
    a, b = F.col("is_item").isNotNull(), F.col("is_used").isNotNull()
    return both.groupBy(*keys).agg(F.count_if(a).alias("n_items"), F.count_if(a & b).alias("n_used"), F.count_if(a & ~b).alias("n_missing"), F.count_if(~a & b).alias("n_ghost"))


def fold_ranges(numbers: DataFrame, keys: list[str], n: str = "n", block: int = 65_536) -> DataFrame:
    """Consecutive integers as ranges: first within blocks of `block` numbers, a window each. A range that touches no end
    of its block is final; of each block at most the one at its beginning and the one at its end go on, and these are
    joined where one ends right before the next begins: two rows a block at most, whatever the numbers."""
    d = numbers.select(*keys, n).distinct().withColumn("_b", F.floor(F.col(n) / block))
    d = d.withColumn("_i", F.col(n) - F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(n)))
    local = d.groupBy(*keys, "_b", "_i").agg(F.min(n).alias("first"), F.max(n).alias("last"))
    edge = (F.pmod(F.col("first"), F.lit(block)) == 0) | (F.pmod(F.col("last"), F.lit(block)) == block - 1)
    w = Window.partitionBy(*keys).orderBy("first")
    open_ = local.where(edge).withColumn("_run", F.sum(F.when(F.lag("last").over(w) == F.col("first") - 1, 0).otherwise(1)).over(w))
    joined = open_.groupBy(*keys, "_run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_run")
    return local.where(~edge).select(*keys, "first", "last").unionByName(joined.select(*keys, "first", "last"))


def nearest_before(points: DataFrame, marks: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """As-of: each point with the last mark at most `reach` before it in its key. A union and one window."""
    p = points.select(*keys, F.col("at"), F.col("id"), F.lit(None).cast("long").alias("mark_at"), F.lit(1).alias("_p"))
    m = marks.select(*keys, F.col("at"), F.lit(None).cast(dict(points.dtypes)["id"]).alias("id"), F.col("at").cast("long").alias("mark_at"), F.lit(0).alias("_p"))
    w = Window.partitionBy(*keys).orderBy("at", "_p").rowsBetween(Window.unboundedPreceding, 0)
    r = p.unionByName(m).withColumn("mark_at", F.last("mark_at", ignorenulls=True).over(w)).where("_p = 1")
    return r.select(*keys, "id", "at", F.when(F.col("at") - F.col("mark_at") <= reach, F.col("mark_at")).alias("mark_at"))


def runs(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Runs of equal neighbouring values (gaps and islands)."""
    w = Window.partitionBy(*keys).orderBy(order)
    r = rows.withColumn("_new", (~F.col(value).eqNullSafe(F.lag(value).over(w)) | F.lag(order).over(w).isNull()).cast("int")).withColumn("run", F.sum("_new").over(w))
    return r.groupBy(*keys, "run", value).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def state_of_lines(lines: DataFrame, keys: list[str], mark: Column, name: str = "state") -> DataFrame:
    """Each line with the last mark at or before it, as a parser's running state; fenced blocks are told by parity."""
    w = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.sum(F.col("text").startswith("```").cast("int")).over(w) % 2
    return lines.withColumn(name, F.last(mark, ignorenulls=True).over(w)).withColumn("fenced", fence == 1)


def split_top_level(text: Column, at: str = ";") -> Column:
    """array<string>: the parts of a list at a sign, but not inside parentheses, of any depth, or guillemets; trimmed, without
    empty ones. A fold over the text's pieces between these signs carries depth, quotation and the parts so far; an unopened
    parenthesis closes nothing."""
    pieces = F.split(text, f"(?=[()«»{at}])|(?<=[()«»{at}])")
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.array(F.lit("")).alias("parts"))

    def step(s: Column, p: Column) -> Column:
        depth = F.when(p == "(", s["depth"] + 1).when(p == ")", F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"])
        quoted = F.when(p == "«", True).when(p == "»", False).otherwise(s["quoted"])
        cut = (p == at) & (s["depth"] == 0) & ~s["quoted"]
        longer = F.concat(F.slice(s["parts"], F.lit(1), F.size(s["parts"]) - 1), F.array(F.concat(F.element_at(s["parts"], -1), p)))
        return F.struct(depth.alias("depth"), quoted.alias("quoted"), F.when(cut, F.concat(s["parts"], F.array(F.lit("")))).otherwise(longer).alias("parts"))

    return F.filter(F.transform(F.aggregate(pieces, start, step, lambda s: s["parts"]), lambda x: F.trim(x)), lambda x: x != "")


#: The container of links to a document's further pages.
PAGES = r"(?s)<div[^>]*class=\"[^\"]*\bpages\b[^\"]*\"(.*?)</div>"


def pagination_links(html: Column, base: Column) -> Column:
    """Links in a page's pagination container, resolved against its address, each once and in order; none without a container."""
    origin, path = F.regexp_extract(base, r"^(\w+://[^/?#]+)", 1), F.regexp_replace(base, r"[?#].*$", "")
    folder = F.when(path.rlike(r"^\w+://[^/]+$"), F.concat(path, F.lit("/"))).otherwise(F.regexp_replace(path, r"[^/]*$", ""))

    def full(h: Column) -> Column:
        out = F.when(h.contains("://"), h).when(h.startswith("//"), F.concat(F.regexp_extract(base, r"^(\w+:)", 1), h)).when(h.startswith("/"), F.concat(origin, h))
        return out.when(h.startswith("?"), F.concat(path, h)).when(h.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), h)).otherwise(F.concat(folder, F.regexp_replace(h, r"^(?:\./)+", "")))

    return F.array_distinct(F.transform(F.regexp_extract_all(F.regexp_extract(html, PAGES, 1), F.lit('href="([^"]+)"'), 1), full))


def hrefs(html: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(html, F.lit('href="([^"]+)"'), 1))
