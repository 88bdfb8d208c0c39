"""Numbers that texts announce, held against the lists that follow them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import split_top_level

#: Numbers from 1 to 20 in the forms that announce a list.
NUMBERS = {
    1: "один одна одно одного одной", 2: "два две двух оба обе обоих", 3: "три трёх трех", 4: "четыре четырёх четырех", 5: "пять пяти", 6: "шесть шести", 7: "семь семи", 8: "восемь восьми", 9: "девять девяти", 10: "десять десяти",
    11: "одиннадцать одиннадцати", 12: "двенадцать двенадцати", 13: "тринадцать тринадцати", 14: "четырнадцать четырнадцати", 15: "пятнадцать пятнадцати", 16: "шестнадцать шестнадцати", 17: "семнадцать семнадцати", 18: "восемнадцать восемнадцати", 19: "девятнадцать девятнадцати", 20: "двадцать двадцати",
}
#: Beginnings of the nouns that a list's points go by.
NOUNS = "услови элемент якор вопрос ветк основани критери признак презумпц позици случа способ маршрут шаг лини стади довод тест механизм ловушк грани форм блок вид тип состав фигур ситуац развилк исключен изъят требован подпункт разъяснен адресат потребител сценар оговорк реквизит проверк ось оси набор перечн разновидност уровн эшелон аргумент возражен контрдовод дат сроков-типов".split()
#: The smallest and largest number that announces a list; how far a list may begin, in lines, lines of prose and
#: characters of one line; blank lines within a list; characters around a claim in which words speak against it.
FEWEST, MOST, REACH, PROSE, COLON, BLANKS, AFTER, BEFORE, BACK = 2, 30, 40, 8, 90, 2, 40, 25, 30
#: Kinds of blocks in the order in which a line is taken for one.
BLOCKS = {
    "table": r"^\s*\|",
    "numbered": r"^\s{0,6}(?:\*\*)?\d{1,2}[.)](?:\*\*)?\s+\S",
    "bulleted": r"^\s{0,6}[-*+]\s+\S",
    "lettered": r"(?iu)^\s{0,6}\(?[а-яa-z]\)\s+\S",
    "subheads": r"^#{2,4}\s+(?:§?[\d.]+\.?|[A-FА-Я]\.)\s*\S",
    "bold leads": r"^\s{0,6}\*\*(?:[А-ЯЁA-Z][а-яёa-z-]+|\d{1,2})[.)]?\*\*[\s—-]",
}
SEPARATOR, STOP = r"^\s*\|[\s:|-]+\|\s*$", r"^(?:#{1,2}\s|---\s*$|___\s*$)"

_WORDS = "|".join(w for x in NUMBERS.values() for w in x.split())
_CLAIM = rf"(?iuU)(?<![\w§№.])(?:\d{{1,2}}|{_WORDS})\s+(?:[а-яё]+\s+){{0,2}}?(?:{'|'.join(NOUNS)})[а-яё]*"
#: Words beside a number that speak of a share, a time, a sum or an edition; of a list told elsewhere; of another place.
_OTHER = rf"(?iuU)\b(?:из\s+\d|из\s+(?:{_WORDS})\b|год|лет|дн|месяц|недел|рубл|процент|%|редакц|№|абзац\s+втор|части\s+втор)"
_TOLD = r"(?iuU)\b(?:по\s+всем|по\s+этим|всех?\s+эти[хм]|тех?\s+же|названн\w+|перечисленн\w+|указанн\w+|упомянут\w+|выше|обои[хм]|оба|обе)\b"
_ELSEWHERE = r"§\s?\d|см\.\s"
_MARKS = r"(?:^|[\s(])\(?(\d{1,2})\)\s+(?=[а-яёa-z«\"*])"


def number(word: Column) -> Column:
    table = F.create_map(*[F.lit(x) for n, words in NUMBERS.items() for w in words.split() for x in (w, n)])
    return F.coalesce(word.try_cast("int"), table[F.lower(word)])


def claims(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line_no, no, claimed, noun, tail): numbers that announce a list, each with the line after it; no claim is made in
    fenced lines, by numbers out of range, or where the words around speak of something else."""
    upto = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    t = lines.withColumn("fences", F.count_if(_fence()).over(upto)).where(~_fence() & (F.col("fences") % 2 == 0) & F.col("text").rlike(_CLAIM))
    return _claimed(t, [*keys, "line_no"])


def _fence() -> Column:
    return F.ltrim("text").startswith("```")


def _claimed(t: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, no, claimed, noun, tail) of lines that hold a claim; keys name the line, and what else goes with it."""
    t = t.select(*keys, "text", F.regexp_extract_all("text", F.lit(_CLAIM), 0).alias("found"), F.split("text", _CLAIM, -1).alias("between"))
    add = lambda a, b: a + b
    length = lambda array, n: F.aggregate(F.transform(F.slice(array, F.lit(1), n), lambda x: F.length(x)), F.lit(0), add)
    each = t.select("*", F.posexplode("found").alias("no", "said")).withColumn("start", length("between", F.col("no") + 1) + length("found", F.col("no"))).withColumn("end", F.col("start") + F.length("said"))
    piece = lambda a, z: F.substring("text", F.greatest(a, F.lit(0)) + 1, z - F.greatest(a, F.lit(0)))
    tail, ahead = piece(F.col("end"), F.col("end") + AFTER), piece(F.col("start") - BEFORE, F.col("start"))
    other = tail.rlike(_OTHER) | ahead.rlike(_OTHER) | piece(F.col("start") - BACK, F.col("end")).rlike(_TOLD) | tail.rlike(_ELSEWHERE)
    n = number(F.regexp_extract("said", rf"(?iu)^(\d{{1,2}}|{_WORDS})\s", 1))
    c = each.where(~other).select(*keys, "no", n.alias("claimed"), F.lower(F.regexp_extract("said", r"(\S+)$", 1)).alias("noun"), F.substring("text", F.col("end") + 1, F.length("text")).alias("tail"))
    return c.where(F.col("claimed").between(FEWEST, MOST))


def listed_inline(tail: Column) -> Column:
    """How many points follow in the line itself, behind a colon: marked 1), 2), ... in order, or set off by semicolons."""
    rest = F.regexp_extract(tail, rf"(?s)^[^:]{{0,{COLON}}}:(.*)$", 1)
    marks = F.transform(F.regexp_extract_all(rest, F.lit(_MARKS), 1), lambda x: x.cast("int"))
    in_order = (F.size(marks) >= 2) & (marks == F.sequence(F.lit(1), F.greatest(F.size(marks), F.lit(1))))
    parts = F.size(split_top_level(F.regexp_replace(rest, r"[ .]+$", "")))
    return F.when(F.length(F.trim(rest)) >= 15, F.when(in_order, F.size(marks)).when(parts >= 2, parts))


def blocks(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Every line with: kind (of the block it may begin), listed (the points of that block from this line on), stops and prose
    (lines of either so far). One shuffle by text, and windows over its lines in order and back.

    A table's points are its rows without separators and without the head. Any other block goes on over blank lines, up to
    BLANKS in a row, and other lines; a heading or rule ends it, and so does a line of another kind that does not follow
    a point directly (a bold lead is no other kind)."""
    return _blocks(lines, keys).select(*keys, "line_no", "at", "kind", "listed", "stops", "prose")


def _blocks(lines: DataFrame, keys: list[str]) -> DataFrame:
    """blocks(), with the texts of lines that hold a claim (else null), whether they stand in a fence, and the next line that
    begins a block (ahead). Lines are read before the shuffle and sorted twice in all, on and back: points are counted on, and
    what a block holds from a line on is the count where it ends, seen from behind, less the count before the line."""
    t = F.col("text")
    is_ = {k: t.rlike(p) for k, p in BLOCKS.items()}
    kind = F.lit(None).cast("string")
    for k in reversed(BLOCKS):
        kind = F.when(is_[k], k).otherwise(kind)
    w = Window.partitionBy(*keys).orderBy("line_no")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy(*keys).orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, 0)
    behind = Window.partitionBy(*keys).orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, -1)
    m = lines.select(*keys, "line_no", F.when(t.rlike(_CLAIM), t).alias("text"), _fence().alias("fence"), (F.trim("text") == "").alias("blank"), t.rlike(STOP).alias("stop"), t.rlike(SEPARATOR).alias("separator"), *[c.alias(f"is_{k}") for k, c in is_.items()], kind.alias("kind"))
    m = m.withColumn("kind", F.when(~F.col("stop") & ~F.col("blank"), F.col("kind")))
    point = {k: F.col(f"is_{k}") & ~F.col("separator") if k == "table" else F.col(f"is_{k}") for k in BLOCKS}
    m = m.withColumns({"at": F.row_number().over(w), "stops": F.count_if("stop").over(upto), "prose": F.count_if(F.col("kind").isNull() & ~F.col("blank") & ~F.col("stop")).over(upto), "fences": F.count_if("fence").over(upto), "blanks": F.min(F.col("blank").cast("int")).over(w.rowsBetween(-BLANKS, 0)),
                       **{f"n_{k}": F.count_if(point[k]).over(upto) for k in BLOCKS}})
    m = m.withColumns({f"last_{k}": F.max(F.when(F.col(f"is_{k}"), F.col("at"))).over(before) for k in BLOCKS if k != "table"})
    too_blank = F.coalesce(F.col("blanks") == 1, F.lit(False)) & (F.col("at") > BLANKS)
    so_far = {k: F.col(f"n_{k}") - F.coalesce(point[k], F.lit(False)).cast("int") for k in BLOCKS}  # before this line
    ends = {}
    for k in BLOCKS:
        own = F.col(f"is_{k}")
        others = F.lit(False)
        for o in BLOCKS:
            if o not in (k, "bold leads"):
                others = others | F.col(f"is_{o}")
        ends[k] = F.coalesce(~own if k == "table" else F.col("stop") | too_blank | (~own & ~F.col("blank") & others & (F.col("at") - F.col(f"last_{k}") > 1)), F.lit(False))
    m = m.withColumns({f"end_{k}": F.coalesce(F.last(F.when(ends[k], so_far[k]), ignorenulls=True).over(behind), F.first(f"n_{k}").over(back)) for k in BLOCKS})
    listed = F.lit(None).cast("long")
    for k in BLOCKS:
        n = F.col(f"end_{k}") - so_far[k]
        listed = F.when(F.col("kind") == k, F.greatest(n - 1, F.lit(0)) if k == "table" else n).otherwise(listed)
    m = m.select(*keys, "line_no", "text", (F.col("fence") | (F.col("fences") % 2 == 1)).alias("fenced"), "at", "kind", listed.alias("listed"), "stops", "prose")
    return m.withColumn("ahead", F.last(F.when(F.col("kind").isNotNull(), F.struct("at", "kind", "listed", "stops", "prose")), ignorenulls=True).over(behind))


def counted(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line_no, no, claimed, noun, inline, kind, listed, state): every claim with the points behind a colon in its own
    line, and the first block that begins within REACH lines and PROSE lines of prose, before a heading or rule. The state
    is agreed if either has as many points as claimed, mismatch if there is one, unknown without any. lines: (keys, line_no, text)."""
    b = _blocks(lines, keys).where(F.col("text").isNotNull() & ~F.col("fenced"))
    n = F.col("ahead")
    ok = (n["at"] - F.col("at") <= REACH) & (n["stops"] == F.col("stops")) & (n["prose"] - F.col("prose") <= PROSE)
    b = b.select(*keys, "line_no", "text", F.when(ok, n["kind"]).alias("kind"), F.when(ok, n["listed"]).alias("listed"))
    c = _claimed(b, [*keys, "line_no", "kind", "listed"]).withColumn("inline", listed_inline(F.col("tail")).cast("long"))
    state = F.when((F.col("inline") == F.col("claimed")) | (F.col("listed") == F.col("claimed")), "agreed").when(F.col("inline").isNull() & F.col("listed").isNull(), "unknown").otherwise("mismatch")
    return c.select(*keys, "line_no", "no", "claimed", "noun", "inline", "kind", "listed", F.coalesce(state, F.lit("mismatch")).alias("state"))


def announced(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line_no, claimed, listed): lines that announce a number of points, against the first block after them."""
    return counted(lines, keys).where("listed is not null").select(*keys, "line_no", "claimed", "listed")
