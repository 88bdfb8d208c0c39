"""Rules as texts state them: fragments, the norms they name, polarity, terms, and pairs that contradict one another."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.kept import kept

#: What a word is made of, in lower-case text: patterns here run over that, which spares them Unicode case rules.
_W = "[а-яёa-z0-9_]"
_NOT_IN_WORD, _WORD_ENDS = f"(?<!{_W})", f"(?!{_W})"

# --- fixed values

#: Beginnings of verbs whose negation turns a norm round.
NEGATABLE = (
    "применяетс", "применим", "распространяетс", "относитс", "требуетс", "допускаетс", "восстанавливаетс", "включаетс", "переноситс", "предусмотрен",
    "обязателен", "обязательн", "подлежит", "засчитываетс", "учитываетс", "прерываетс", "приостанавливаетс", "сохраняетс",
)
#: Pairs of modes that exclude one another without any negation (name, pattern, name, pattern).
MODES = (
    ("групповой иск (гл. 28.2)", rf"глав{_W}+\s*28\.2|групповой иск|225\.1[0-6]", "исковое производство", rf"правил{_W}+\s+исковог{_W}+\s+производств"),
    ("солидарно", r"солидарн", "в долях", rf"{_NOT_IN_WORD}в\s+дол{_W}+|долев{_W}+\s+ответственност"),
    ("текущее требование", rf"(?<!не )являетс{_W}*\s+текущ|(?<!не )относитс{_W}*\s+к\s+текущ", "реестровое требование", rf"реестров{_W}+\s+требован|не\s+являетс{_W}*\s+текущ"),
    ("бремя на заявителе", rf"дока{_W}+\s+заявител|бремя\s+(?:лежит\s+)?на\s+заявител|истец\s+доказ", "бремя на ответчике", rf"дока{_W}+\s+ответчик|бремя\s+(?:лежит\s+)?на\s+ответчик|презюмируетс"),
    ("срок восстановим", rf"восстанавливаетс{_W}*|подлежит\s+восстановлен|восстановлен{_W}+\s+срока", "срок невосстановим", rf"не\s+подлеж{_W}+\s+восстановлен|не\s+восстанавливаетс|восстановлен{_W}+\s+исключен"),
)
#: Numbers of terms as words, units by their beginnings with the largest plausible term.
TERM_WORDS = {"один": 1, "два": 2, "двух": 2, "три": 3, "трёх": 3, "трех": 3, "четыре": 4, "пять": 5, "пяти": 5, "шесть": 6, "шести": 6, "семь": 7, "восемь": 8, "девять": 9, "десять": 10, "десяти": 10, "пятнадцать": 15, "тридцать": 30, "тридцати": 30}
LIMITS = {"раб.дн": 30, "дн": 365, "мес": 36, "год": 15}
#: How norms are written: numbers of articles and items, names of codes and laws.
ARTICLE_NO, ITEM_NO = r"\d{1,4}(?:\.\d{1,2})?(?:-\d)?(?!\d)", r"\d{1,3}(?:\(\d{1,2}\))?(?!\d)"
LAWS = "апк гпк кас нк гк тк фз-\\d+ ук".split()
#: Abbreviations whose dot ends no sentence, the shortest fragment, and how often a norm may be named.
ABBREVIATIONS = "п ст абз подп пп ч гл".split()
SHORTEST, LARGEST, FIRST_RULING_ITEM = 25, 60, 20
#: Words by which an author shows that two rules are known to differ.
AWARE = (
    "расхожд{w}*", "расход{w}*тся", "коллиз", r"но\s+см\.", r"см\.\s+врезк", r"против\s+нормы", r"{b}шире{e}", r"{b}уже{e}", "ýже", r"уже\s+норм", r"по\s+букве", "резервн",
    r"за\s+исключением[^.]{0,40}(?:п\.|ст\.|пункт|стать)", r"не\s+путать", r"прежн{w}+\s+(?:редакц|правил)", r"прямого\s+разрешения", "зеркальн", r"как\s+(?:это\s+)?соотносится",
    r"как\s+это\s+разрешать", r"не\s+отменил", r"замени{w}+\s+качественн{w}+\s+запрет", r"выше[^.]{0,30}по\s+силе", r"читается\s+только\s+вместе\s+с", r"ошибочн{w}*\s+(?:была|было|редакц)",
    "устарел", r"не\s+переноситс", r"переносить\s+нельзя", r"сужен{w}*\s+до", r"адресован\s+(?:субсидиарн|друг)",
)
#: Lines of journals and registers, which state no rules.
NO_RULES = r"(?iu)^\s*(?:>\s*)?\|?\s*[А-ЯA-Z]?\.?\d{0,2}\s*(?:✅|⏳|❌)|^\s*\*\*Предыдущее|коммит|CHANGELOG|OPEN-ITEMS|проверя[\p{L}\d_]+\s+по\s+ос|^\s*#{1,4}\s*(?:§?17|Приложение|Источник)|\*\*Внесено:\*\*|Внесено:\s|хвост\s+закрыт"
APPENDIX, BODY = r"(?iu)^\s*#{1,3}\s*Приложение", r"^\s*#{1,3}\s*§"

_NEGATED = rf"{_NOT_IN_WORD}не\s+(?:{_W}+\s+){{0,3}}"
#: What every negatable verb holds one of.
_VERB_HINTS = "етс итс применим смотрен обязател подлежит".split()
#: Beginnings of words without one of which no pattern of MODES, NO_RULES or AWARE holds: looked for first, as most texts have none.
_MODE_HINTS = "28.2 225.1 группов исковог истец солидарн дол дока являетс относитс реестров бремя презюм восстан".split()
_NO_RULES_HINTS = "✅ ⏳ ❌ **предыдущее коммит changelog open-items проверя # внесено: хвост".split()
_AWARE_HINTS = "расхожд расход коллиз см. норм шире уже ýже букве резервн исключен путать прежн прямого зеркальн соотносится разрешать отменил замени выше читается ошибочн устарел перенос сужен адресован".split()
_TAIL = r",?\s+но\s+не\s+(?:всегда|во\s+всех|в\s+полном)"
_NO_STOP = "".join(rf"(?<!{a}\.)" for a in ABBREVIATIONS)


def _tree(words) -> str:
    """A pattern of the words as a tree of their letters, the longest first: a place in a text is left after a letter or two."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[:1], []).append(w[1:])
    ends = "" in heads
    branches = []
    for c, rest in heads.items():
        if c:
            while len({r[:1] for r in rest}) == 1 and rest[0]:
                c, rest = c + rest[0][0], [r[1:] for r in rest]
            branches.append(c.replace(".", r"\.") + ("" if rest == [""] else _tree(rest)))
    one = branches[0] if len(branches) == 1 and not ends else f"(?:{'|'.join(branches)})"
    return f"{one}?" if ends else one


def _class(letters) -> str:
    """A class of characters as few ranges: each range in a class is one more test of every character."""
    runs: list[list[int]] = []
    for c in sorted(map(ord, set(letters))):
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "[" + "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in runs) + "]"


def _holds(text: Column, words) -> Column:
    """Whether a text holds any of the words: searches of bytes, which cost less than the branches of one pattern."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def _once(df: DataFrame, *cols: str, **made: Column) -> DataFrame:
    """Columns of df and made ones, as a row exploded from an array of one: the optimiser takes no filter through that, so what is
    made is made once, and not again for each filter that looks at it."""
    return df.select(*cols, F.explode(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))).alias("_m")).select(*cols, *[F.col(f"_m.{n}").alias(n) for n in made])


# --- fragments

def fragments(lines: DataFrame, file: str = "file") -> DataFrame:
    """(file, line_no, pos, text, row_keys, in_appendix): the sentences of lines and of their table cells, of SHORTEST
    characters or more; row_keys are the norms in a table row's first cell, in_appendix holds from a heading of an appendix to the
    next section. Fenced lines and lines of journals are left out. lines: (file, line_no, text)."""
    upto = Window.partitionBy(file).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.ltrim("text").startswith("```")
    side = F.when(~fence & F.col("text").rlike(APPENDIX), True).when(~fence & F.col("text").rlike(BODY), False)
    t = lines.withColumn("fences", F.count_if(fence).over(upto)).withColumn("in_appendix", F.coalesce(F.last(side, ignorenulls=True).over(upto), F.lit(False)))
    t = t.where(~fence & (F.col("fences") % 2 == 0) & (F.length("text") >= SHORTEST))
    # a filter would fold the text anew for each hint
    t = _once(t, file, "line_no", "in_appendix", "text", s=F.btrim("text", F.lit(" \t\n\x0b\f\r")), folded=F.lower(F.upper("text")))
    t = t.where((F.length("s") >= SHORTEST) & ~(_holds(F.col("folded"), _NO_RULES_HINTS) & F.col("text").rlike(NO_RULES)))
    row = F.col("s").startswith("|")
    cells = F.when(row, F.split("s", r"\|")).otherwise(F.array("s"))
    row_keys = F.when(row, norm_keys(F.coalesce(F.get(cells, F.lit(1)), F.lit("")))).otherwise(F.array().cast("array<string>"))
    ends = rf"(?=\s)(?<=[.;!?]){_NO_STOP}\s+(?=[А-ЯЁA-Z«*])"
    parts = F.flatten(F.transform(cells, lambda c: F.transform(F.split(c, ends), lambda p: F.btrim(p, F.lit(" *|")))))
    t = _once(t, file, "line_no", "in_appendix", parts=F.filter(parts, lambda p: F.length(p) >= SHORTEST), row_keys=row_keys)
    return t.select(file, "line_no", F.posexplode("parts").alias("pos", "text"), "row_keys", "in_appendix")


def norm_keys(text: Column, loose: bool = False) -> Column:
    """Norms that a text names, from the top down: law and article, its item or part, the item's sub-item; items alone that
    can only be a ruling's (a number of 20 or more, or with brackets); chapters. With `loose` the article of every item as
    well, so that rules meet of which one names the article alone."""
    return _norm_keys(F.lower(text), loose)


def _norm_keys(t: Column, loose: bool = False) -> Column:
    article = rf"ст{_W}*\.?\s*({ARTICLE_NO})(?:\s*({'|'.join(LAWS)}))?"
    full = rf"(?=[пс])(?:(?:подп{_W}*\.?|пп\.)\s*({ITEM_NO})\s*[,)]?\s*)?(?:п{_W}*\.?\s*({ITEM_NO})\s*[,)]?\s*)?{article}"
    part = rf"ч{_W}*\.?\s*(\d{{1,2}}(?:\.\d)?)\s*{article}"
    alone = rf"п(?<![а-яёa-z0-9_.]п)(?:\.|ункт{_W}*)\s*({ITEM_NO})(?!\s*ст)"
    chapter = rf"гл(?:ав{_W}+|\.)\s*([ivx]+\.?\d*|\d{{1,2}}(?:\.\d)?)"
    all_groups = lambda m, pattern, n: F.split(F.regexp_replace(m, f"(?s)^{pattern}.*$", "\x01".join(f"${k + 1}" for k in range(n))), "\x01")
    above = lambda g, k: F.trim(F.concat(F.upper(g[k + 1]), F.lit(" ст."), g[k]))
    none = F.lit(None).cast("string")

    def down(g: Column) -> Column:
        of_item = F.when(g[1] != "", F.concat(above(g, 2), F.lit("/п."), g[1]))
        return F.array(F.when(F.lit(loose) | (g[1] == ""), above(g, 2)), of_item, F.when(g[0] != "", F.concat(of_item, F.lit("/подп."), g[0])))

    named = F.flatten(F.transform(F.transform(F.regexp_extract_all(t, F.lit(full), 0), lambda m: all_groups(m, full, 4)), down))
    parts = F.transform(F.transform(F.regexp_extract_all(t, F.lit(part), 0), lambda m: all_groups(m, part, 3)), lambda g: F.concat(above(g, 1), F.lit("/ч."), g[0]))
    items = F.transform(F.regexp_extract_all(t, F.lit(alone), 1), lambda n: F.when(n.contains("(") | (F.regexp_extract(n, r"^\d+", 0).cast("int") >= FIRST_RULING_ITEM), F.concat(F.lit("Пленум п."), n)).otherwise(none))
    chapters = F.transform(F.regexp_extract_all(t, F.lit(chapter), 1), lambda n: F.concat(F.lit("глава "), F.upper(F.rtrim(n, F.lit(".")))))
    return F.array_distinct(F.filter(F.concat(named, parts, items, chapters), lambda k: k.isNotNull()))


# --- polarity and terms

def polarity(text: Column) -> Column:
    """array<struct<axis, side>>: side is true for a negated verb, or for the first mode of a pair. A verb is negated apart
    (up to three words between), joined on, or by what follows it. Both modes of a pair in one text take no side."""
    return _polarity(F.lower(text))


def _polarity(t: Column) -> Column:
    verbs = _tree(NEGATABLE)
    first = _class(v[0] for v in (*NEGATABLE, "не"))
    found = F.regexp_extract_all(t, F.lit(rf"((?={first}){_NOT_IN_WORD}(?:не\s+(?:{_W}+\s+){{0,3}})?(?:не)?{verbs}{_W}*(?:{_TAIL})?)"), 1)

    def side(m: Column) -> Column:
        # no verb begins like a negation, and blanks inside come with one before the verb or with a tail
        verb = F.regexp_extract(m, rf"(?:^|\s)(?:не|)({verbs}){_W}*(?:{_TAIL})?$", 1)
        axis = F.when(verb.startswith("примен"), F.lit("применяетс")).otherwise(verb)
        return F.struct(F.concat(F.lit("не-"), axis).alias("axis"), (m.startswith("не") | m.rlike(r"\s")).alias("side"))

    modes = []
    for a, x, b, y in MODES:
        one, two = t.rlike(x), t.rlike(y)
        modes.append(F.when(one != two, F.struct(F.lit(f"{a} / {b}").alias("axis"), one.alias("side"))))
    empty = F.array().cast("array<struct<axis: string, side: boolean>>")
    sides = F.when(_holds(t, _VERB_HINTS), F.transform(found, side)).otherwise(empty)
    return F.array_distinct(F.concat(sides, F.when(_holds(t, _MODE_HINTS), F.filter(F.array(*modes), lambda m: m.isNotNull())).otherwise(empty)))


def terms(text: Column) -> Column:
    """array<struct<n, unit>> of the terms a text names, without numbers too large for their unit (dates, case numbers)."""
    return _terms(F.lower(text))


def _terms(t: Column) -> Column:
    number = r"\d{1,3}|" + _tree(TERM_WORDS)
    first, last = _class("0123456789" + "".join(w[0] for w in TERM_WORDS)), _class("ркдмгл")
    unit = rf"рабочи{_W}+\s+дн{_W}+|календарн{_W}+\s+дн{_W}+|дн{_W}+|месяц{_W}*|год{_W}*|лет"
    found = F.regexp_extract_all(t, F.lit(rf"(?={first})(?<![\d.,])((?:\d{{1,3}}+|{_tree(TERM_WORDS)})[\s-]*+(?={last})(?:{unit}))"), 1)
    table = F.create_map(*[F.lit(x) for p in TERM_WORDS.items() for x in p])
    limit = F.create_map(*[F.lit(x) for p in LIMITS.items() for x in p])

    def term(m: Column) -> Column:
        tok = F.regexp_extract(m, rf"^({number})", 1)
        u = F.when(m.contains("рабочи"), "раб.дн").when(m.contains("дн"), "дн").when(m.contains("месяц"), "мес").otherwise("год")
        return F.struct(F.coalesce(tok.try_cast("int"), table[tok]).alias("n"), u.alias("unit"))

    return F.array_distinct(F.filter(F.transform(found, term), lambda x: x["n"].isNotNull() & (x["n"] <= limit[x["unit"]])))


def aware(text: Column) -> Column:
    """Whether a text says itself that rules differ."""
    return _aware(F.lower(text))


def _aware(t: Column) -> Column:
    return _holds(t, _AWARE_HINTS) & t.rlike("|".join(p.replace("{w}", _W).replace("{b}", _NOT_IN_WORD).replace("{e}", _WORD_ENDS) for p in AWARE))


# --- contradictions

#: Rows of facts that one task pairs at a time: some have a dozen pairs each, which are held to be told apart.
FACTS_A_TASK = 100_000


def _facts(frags: DataFrame, with_terms: bool, loose: bool, with_class: bool) -> DataFrame:
    """(frag_id, same, norm, stances, aware, in_appendix): what fragments say of each norm they name, read off their texts once
    and written; texts themselves go no further, `same` tells equal ones. A stance is a side (n is 1 or 0) on an axis, or a
    term's n in a unit."""
    t = F.col("low")
    keys = _norm_keys(t, loose)
    if "row_keys" in frags.columns:
        keys = F.array_union(keys, F.coalesce("row_keys", F.array().cast("array<string>")))
    appendix = F.col("in_appendix") if "in_appendix" in frags.columns and with_class else F.lit(False)
    frags = frags.select("*", appendix.alias("_appendix"))
    cols = ["frag_id", "text", "_appendix", *[c for c in ("row_keys",) if c in frags.columns]]
    stance = lambda axis, n, term: F.struct(axis.alias("axis"), n.cast("int").alias("n"), F.lit(term).alias("term"))
    stances = F.transform(_polarity(t), lambda s: stance(s["axis"], s["side"], False))
    if with_terms:
        stances = F.concat(stances, F.transform(_terms(t), lambda x: stance(x["unit"], x["n"], True)))
    said = _once(_once(frags, *cols, low=F.lower("text")), *cols, "low", stances=stances).where(F.size("stances") > 0)
    said = _once(said, "frag_id", "text", "low", "_appendix", "stances", keys=keys)
    said = said.select("frag_id", F.md5("text").alias("same"), F.explode("keys").alias("norm"), "stances", (_aware(t) if with_class else F.lit(False)).alias("aware"), F.col("_appendix").alias("in_appendix"))
    return kept(said)


def _pairs(frags: DataFrame, largest: int, with_terms: bool, loose: bool, with_class: bool = False) -> DataFrame:
    """(norm, axis, a, b, aware, in_appendix): the fragments of a norm, `largest` at most by the rule, meet in one row; pairs are
    made there, and nothing is shuffled after. Stances are opened up before they meet, so that no function of lists runs for a pair."""
    each = _facts(frags, with_terms, loose, with_class)
    need = -(-each.count() // FACTS_A_TASK)
    if need > int(each.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        each = each.repartition(need, "norm")
    small = each.groupBy("norm").agg(F.count("*").alias("n")).where((F.col("n") <= largest) & (F.col("n") > 1)).select("norm")
    one = F.struct("frag_id", "same", "stances", "aware", "in_appendix")
    of = each.join(small, "norm", "left_semi").groupBy("norm").agg(F.collect_list(one).alias("all"))
    both = of.select("norm", "all", F.explode("all").alias("x")).select("norm", "all", "x", F.explode("x.stances").alias("p"))
    both = both.select("norm", "x", "p", F.explode("all").alias("y")).where("x.frag_id < y.frag_id and x.same <> y.same")
    both = both.select("norm", "x", "p", "y", F.explode("y.stances").alias("q")).where("p.axis = q.axis and p.term = q.term and p.n <> q.n")
    span = F.concat(F.lit("срок: "), F.least("p.n", "q.n").cast("string"), F.lit(" / "), F.greatest("p.n", "q.n").cast("string"), F.lit(" "), F.col("p.axis"))
    turned = ~F.col("p.term") & (F.col("p.n") == 0)
    a, b = F.when(turned, F.col("y.frag_id")).otherwise(F.col("x.frag_id")), F.when(turned, F.col("x.frag_id")).otherwise(F.col("y.frag_id"))
    return both.select("norm", F.when(F.col("p.term"), span).otherwise(F.col("p.axis")).alias("axis"), a.alias("a"), b.alias("b"), (F.col("x.aware") | F.col("y.aware")).alias("aware"), (F.col("x.in_appendix") & F.col("y.in_appendix")).alias("in_appendix"))


def contradictions(frags: DataFrame, largest: int = LARGEST, with_terms: bool = False, loose: bool = False) -> DataFrame:
    """(norm, axis, a, b): pairs of different fragments that name one norm and take opposite sides on one axis (a denies); with
    `with_terms` also pairs that name different terms in one unit (a is the smaller id). frags: (frag_id, text[, row_keys,
    in_appendix]). A norm named in more than `largest` fragments that say something is no evidence, by the rule itself; so no
    key joins more than that many rows."""
    return _pairs(frags, largest, with_terms, loose).select("norm", "axis", "a", "b").distinct()


def classified(frags: DataFrame, largest: int = LARGEST, with_terms: bool = False, loose: bool = False) -> DataFrame:
    """(first, second, norm, axes, state): contradictions as one row for each pair of fragments, however many norms they share, by
    the first of these. The state is aware if either side says that the rules differ, registry if both stand in appendices,
    else apart."""
    p = _pairs(frags, largest, with_terms, loose, with_class=True)
    pair = p.groupBy(F.least("a", "b").alias("first"), F.greatest("a", "b").alias("second")).agg(F.min("norm").alias("norm"), F.array_sort(F.collect_set("axis")).alias("axes"), F.max("aware").alias("aware"), F.max("in_appendix").alias("in_appendix"))
    return pair.select("first", "second", "norm", "axes", F.when(F.col("aware"), "aware").when(F.col("in_appendix"), "registry").otherwise("apart").alias("state"))


def unnamed(frags: DataFrame, with_terms: bool = True) -> DataFrame:
    """Fragments that take a side or name a term, but no norm: nothing can be held against them."""
    t = F.col("text")
    says = (F.size(polarity(t)) > 0) | (F.size(terms(t)) > 0 if with_terms else F.lit(False))
    named = F.size(norm_keys(t)) > 0
    return frags.where(says & ~(named | (F.size("row_keys") > 0) if "row_keys" in frags.columns else named))
