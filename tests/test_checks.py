"""The corpus checkers against plain Python on small texts."""

import difflib
import random
import re
import unicodedata

from pyspark.sql import functions as F

from ledgerlens.operators import checks, counts, norms, reconcile


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_typography(spark):
    for t in ["«Ёлка» — “да”", "ﬁn ①  −5\n\tх", "a‑b „c”", ""]:
        n = unicodedata.normalize("NFKC", t).replace("ё", "е").replace("Ё", "Е")
        n = re.sub(r"\s+", " ", re.sub("[‐-―−]", "-", re.sub('[«»“”„"]', '"', n))).strip().lower()
        assert one(spark, checks.typographic(F.lit(t))) == n
    assert one(spark, checks.typographic(F.lit(None).cast("string"))) is None


def test_quotations_have_their_lines(spark):
    t = "Текст\n«коротко»\n> «" + "длинная цитата " * 4 + "\n> и **ещё** строка»\nа вот\n«... " + "вторая цитата " * 4 + "…»"
    got = checks.quotations(spark.createDataFrame([(1, t), (2, None), (3, "")], "id long, text string"), "id").orderBy("no").collect()
    assert [(r.no, r.line) for r in got] == [(1, 3), (2, 6)]
    assert "**" not in got[0].quote and ">" not in got[0].quote and got[1].quote == ("вторая цитата " * 4).strip()


def words(r, n):
    return " ".join("".join(r.choices("abcde", k=r.randint(2, 6))) for _ in range(n))


def test_hits_confirmed_and_closest_equal_plain_search(spark):
    r = random.Random(3)
    docs = [(i, words(r, r.randint(3, 80))) for i in range(60)] + [(60, None), (61, ""), (62, "short")]
    docs += [(70, docs[5][1]), (71, docs[5][1])]
    quotes = []
    for i in range(40):
        t = docs[r.randrange(60)][1]
        a = r.randrange(max(1, len(t) - 40))
        if len(t) < 90:
            continue
        x, y = t[a : a + 25], t[a + 30 : a + 60]
        quotes.append((i, [x, f"{x} ... {y}", f"{y}…{x}", t[a : a + 40] + "zz"][i % 4], i % 7))
    corpus, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(quotes, "quote_id long, quote string, own long")
    want_hits = {(i, d) for i, s, _ in quotes for d, t in docs if t and len(s) >= 15 and s in t}
    assert {tuple(x) for x in checks.hits(q.select(F.col("quote_id").alias("needle_id"), F.col("quote").alias("needle")), corpus).collect()} == want_hits and want_hits

    def found(s, t):
        at = 0
        for f in [p.strip() for p in re.split(r"\.{2,}|…", s) if len(p.strip()) >= 15] or [s]:
            k = t.find(f, at)
            if k < 0:
                return False
            at = k + len(f)
        return True

    want = {(i, d) for i, s, own in quotes for d, t in docs if t and d != own and found(s, t)}
    assert {tuple(x) for x in checks.confirmed(q, corpus).collect()} == want and want
    near = {x.quote_id: round(x.ratio, 9) for x in checks.closest(q, corpus).collect()}
    for i, s, _ in quotes:
        best = 0.0
        for _, t in docs:
            at = (t or "").find(s[:20])
            while at != -1:
                best = max(best, difflib.SequenceMatcher(None, s, t[at : at + len(s) + 20]).ratio())
                at = t.find(s[:20], at + 1)
        assert (best < 0.99 and round(best, 9) == near.get(i, 0.0)) or near[i] >= 0.99


def test_statutes_keep_the_heavier_copy(spark):
    lines = ["Статья 5. Оглавление", "1. Кратко", "Статья 6. Другое", "1. Раз", "ещё", "2. Два", "Статья 5. Текст", "1. Первый", "абзац", "2. Второй", "", "хвост"]
    got = checks.statute_paragraphs(spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line_no int, text string")).collect()
    assert sorted((r.article, r.punkt, r.para_no, r.text) for r in got) == [("5", "1", 1, "1. Первый"), ("5", "1", 2, "абзац"), ("5", "2", 1, "2. Второй"), ("5", "2", 2, "хвост"), ("6", "1", 1, "1. Раз"), ("6", "1", 2, "ещё"), ("6", "2", 1, "2. Два")]


def test_polarity_of_verbs_and_modes(spark):
    cases = {
        "Правило применяется.": {("не-применяетс", False)},
        "Правило не во всех случаях применяется": {("не-применяетс", True)},
        "Срок неприменим": {("не-применяетс", True)},
        "Оно применяется, но не всегда": {("не-применяетс", True)},
        "как это соотносится с прежним": set(),
        "не требуется, но подлежит": {("не-требуетс", True), ("не-подлежит", False)},
        "отвечают солидарно": {("солидарно / в долях", True)},
        "отвечают в долях": {("солидарно / в долях", False)},
        "солидарно или в долях": set(),
        "ничего": set(),
    }
    for t, want in cases.items():
        assert {(x.axis, x.side) for x in one(spark, norms.polarity(F.lit(t)))} == want, t


def test_terms_and_norm_keys(spark):
    terms = lambda t: {(x.n, x.unit) for x in one(spark, norms.terms(F.lit(t)))}
    assert terms("в течение десяти рабочих дней, затем 3 месяца и один год") == {(10, "раб.дн"), (3, "мес"), (1, "год")}
    assert terms("в 2025 году, 40 лет, пять миллионов, 45 календарных дней") == {(45, "дн")}
    keys = lambda t: set(one(spark, norms.norm_keys(F.lit(t))))
    assert keys("по п. 2 ст. 61.3 и ч. 6 ст. 225.10 АПК") >= {"ст.61.3/п.2", "АПК ст.225.10/ч.6"}
    assert keys("пункт 51, п. 5, п. 26(11), глава 28.2") == {"Пленум п.51", "Пленум п.26(11)", "глава 28.2"}


def test_contradictions(spark):
    rows = [(1, "ст. 9 применяется в срок 5 дней"), (2, "ст. 9 не применяется в срок 7 дней"), (3, "ст. 9 применяется в срок 5 дней"), (4, "ст. 8 не применяется")] + [(100 + i, f"ст. 7 {'не ' * (i % 2)}применяется, случай {i}") for i in range(61)]
    f = spark.createDataFrame(rows, "frag_id long, text string")
    assert {tuple(r) for r in norms.contradictions(f).collect()} == {("ст.9", "не-применяетс", 2, 1), ("ст.9", "не-применяетс", 2, 3)}
    assert {tuple(r) for r in norms.contradictions(f, with_terms=True).where("axis like 'срок%'").collect()} == {("ст.9", "срок: 5 / 7 дн", 1, 2), ("ст.9", "срок: 5 / 7 дн", 2, 3)}


def test_announced_counts(spark):
    def got(lines):
        df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc long, line_no int, text string")
        return sorted((r.line_no, r.claimed, r.listed) for r in counts.announced(df, ["doc"]).collect())

    assert got(["Есть три условия:", "", "- a", "", "- b", "  продолжение", "- c"]) == [(0, 3, 3)]
    assert got(["Есть пять кумулятивных условий", "1. a", "2. b", "- c"]) == [(0, 5, 2)]
    assert got(["Есть два случая", "", "- a", "", "", "", "- b"]) == [(0, 2, 1)]
    assert got(["Есть два случая", "## Дальше", "- a", "- b"]) == []
    assert got(["Есть два случая", *["проза"] * 9, "- a", "- b"]) == []
    assert got(["Есть два случая", *["проза"] * 8, "- a", "- b"]) == [(0, 2, 2)]
    assert got(["Есть два случая", *[""] * 41, "- a"]) == []
    assert got(["Есть двенадцать вопросов:", "а) да", "б) нет", "Есть три года"]) == [(0, 12, 2)]


def plain_count(lines, c):
    """The first block after line c, and its points."""
    kinds = {k: re.compile(p.replace("(?iu)", ""), re.I if "(?iu)" in p else 0) for k, p in counts.BLOCKS.items()}
    stop, separator, prose, i = re.compile(counts.STOP), re.compile(counts.SEPARATOR), 0, c + 1
    while i < len(lines) and i <= c + 40:
        x = lines[i]
        if stop.match(x):
            return None
        k = next((k for k, p in kinds.items() if p.match(x)), None) if x.strip() else None
        if k == "table":
            j = i
            while j < len(lines) and kinds["table"].match(lines[j]):
                j += 1
            return k, max(0, sum(not separator.match(y) for y in lines[i:j]) - 1)
        if k:
            n, blanks, last = 0, 0, i
            for j in range(i, len(lines)):
                y = lines[j]
                if stop.match(y) and j > i:
                    break
                if kinds[k].match(y):
                    n, last, blanks = n + 1, j, 0
                elif not y.strip():
                    blanks += 1
                    if blanks > 2:
                        break
                else:
                    if j - last > 1 and any(p.match(y) for o, p in kinds.items() if o not in (k, "bold leads")):
                        break
                    blanks = 0
            return k, n
        prose += bool(x.strip())
        if prose > 8:
            return None
        i += 1
    return None


def test_blocks_of_all_kinds_equal_a_plain_reading(spark):
    r = random.Random(12)
    pool = ["", "", "проза", "1. а", "2) б", "**3.** в", "- г", "* д", "а) е", "(б) ж", "| з | и |", "| --- | --- |", "### 1. К", "## Л", "---", "**Первый** — м", "**Второй** н", "  продолжение"]
    texts = {}
    for d in range(120):
        some = r.sample(pool, r.randint(2, 6))
        texts[d] = [r.choice(some) if r.random() < 0.85 else r.choice(pool) for _ in range(r.randint(0, 25))]
        texts[d][r.randint(0, len(texts[d])) : 0] = ["Есть четыре условия и ничего более"]
    df = spark.createDataFrame([(d, i, x) for d, ls in texts.items() for i, x in enumerate(ls)], "doc long, line_no int, text string")
    got = {(x.doc, x.line_no): (x.kind, x.listed) if x.kind else None for x in counts.counted(df, ["doc"]).collect()}
    assert got == {(d, i): plain_count(ls, i) for d, ls in texts.items() for i, x in enumerate(ls) if x.startswith("Есть")}
    assert {k for k in counts.BLOCKS} <= {x[0] for x in got.values() if x}


def test_claims_that_announce_nothing_and_lists_in_a_line(spark):
    def got(line, *more):
        df = spark.createDataFrame([(1, i, x) for i, x in enumerate((line, *more))], "doc long, line_no int, text string")
        return sorted((x.claimed, x.inline, x.listed, x.state) for x in counts.counted(df, ["doc"]).collect())

    for line in ("по всем шести вопросам", "три сценария (§10.9)", "два случая из 96", "в редакции два случая", "оба случая", "одно условие", "40 условий", "№3 вопроса", "названные два случая", "три вопроса, см. ниже"):
        assert got(line) == [], line
    assert got("Нужны три условия: 1) первое из них 2) второе 3) третье") == [(3, 3, None, "agreed")]
    assert got("Нужны три условия: первое (оно; же), «второе; его», третье; иное") == [(3, 2, None, "mismatch")]
    assert got("Нужны два условия: коротко") == [(2, None, None, "unknown")]
    assert got("Нужны два условия: первое здесь; второе там; третье", "- а", "- б") == [(2, 3, 2, "agreed")]
    assert got("Есть два случая и три довода:", "- а", "- б") == [(2, None, 2, "agreed"), (3, None, 2, "mismatch")]
    assert got("```", "Есть два случая", "- а", "```") == []


def test_fragments_of_lines(spark):
    lines = ["# Заголовок раздела о порядке", "По п. 5 ст. 61.2 срок не применяется. Иначе он применяется всегда, см. ч. 2 ст. 9 АПК.", "| п. 2 ст. 8 | срок применяется судом без исключений; И второе правило этой же ячейки |", "```", "ст. 5 применяется в любом случае без оговорок", "```", "коротко", "✅ ст. 5 применяется в любом случае без оговорок", "## Приложение А", "ст. 5 не применяется по строке реестра А", "### А.1. и дальше в приложении, ст. 5 применяется", "## §2 Тело", "ст. 5 применяется и в теле документа"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines, 1)], "file string, line_no int, text string")
    got = [(r.line_no, r.pos, r.text, sorted(r.row_keys), r.in_appendix) for r in norms.fragments(df).orderBy("line_no", "pos").collect()]
    assert got == [
        (1, 0, "# Заголовок раздела о порядке", [], False),
        (2, 0, "По п. 5 ст. 61.2 срок не применяется.", [], False),
        (2, 1, "Иначе он применяется всегда, см. ч. 2 ст. 9 АПК.", [], False),
        (3, 0, "срок применяется судом без исключений;", ["ст.8/п.2"], False),
        (3, 1, "И второе правило этой же ячейки", ["ст.8/п.2"], False),
        (10, 0, "ст. 5 не применяется по строке реестра А", [], True),
        (11, 0, "### А.1. и дальше в приложении, ст. 5 применяется", [], True),
        (13, 0, "ст. 5 применяется и в теле документа", [], False),
    ]


def test_keys_go_down_to_sub_items_and_up_to_articles(spark):
    keys = lambda t, loose=False: set(one(spark, norms.norm_keys(F.lit(t), loose)))
    assert keys("подп. 2 п. 4 ст. 61.10") == {"ст.61.10/п.4", "ст.61.10/п.4/подп.2"}
    assert keys("подп. 2 п. 4 ст. 61.10 ФЗ-127", True) == {"ФЗ-127 ст.61.10", "ФЗ-127 ст.61.10/п.4", "ФЗ-127 ст.61.10/п.4/подп.2"}
    assert keys("статья 1080 ГК, пункт 3 статьи 5") == {"ГК ст.1080", "ст.5/п.3"}
    assert keys("глава III.1 и гл. 28.2.") == {"глава III.1", "глава 28.2"}


def test_classes_of_contradictions(spark):
    rows = [
        ("a", "п. 5 ст. 9 применяется судом", False), ("b", "п. 5 ст. 9 не применяется судом", False), ("c", "п. 5 ст. 9 не применяется, что расходится с буквой", False),
        ("d", "ст. 8 применяется по реестру", True), ("e", "ст. 8 не применяется по реестру", True), ("f", "статья 9 не применяется ни к чему", False), ("g", "применяется без нормы", False),
    ]
    f = spark.createDataFrame(rows, "frag_id string, text string, in_appendix boolean")
    got = {(x.first, x.second): (x.norm, x.axes, x.state) for x in norms.classified(f).collect()}
    assert got == {("a", "b"): ("ст.9/п.5", ["не-применяетс"], "apart"), ("a", "c"): ("ст.9/п.5", ["не-применяетс"], "aware"), ("d", "e"): ("ст.8", ["не-применяетс"], "registry")}
    loose = {(x.first, x.second) for x in norms.classified(f, loose=True).collect()}
    assert loose == {("a", "b"), ("a", "c"), ("a", "f"), ("d", "e")}
    assert [x.frag_id for x in norms.unnamed(f).collect()] == ["g"]


def test_links_against_files(spark):
    lines = [("a/x.md", 1, "[ok](y.md) [gone](z.md#q) [up](../../out.md) [root](../b.md) `[c](no.md)`"), ("a/x.md", 2, "```"), ("a/x.md", 3, "[f](no.md)"), ("a/x.md", 4, "```"), ("a/x.md", 5, '[sp](n%20m.md "t") [l](y.md:12-14) [d](.) [h](http://e) [m](#k) [bad](q.md:3)')]
    df = spark.createDataFrame(lines, "file string, line_no int, text string")
    files = spark.createDataFrame([("a/x.md",), ("a/y.md",), ("b.md",), ("a/n m.md",)], "file string")
    assert sorted((r.line_no, r.target) for r in checks.broken_links(df, files).collect()) == [(1, "a/z.md"), (5, "a/q.md:3")]


def test_small_rules(spark):
    assert one(spark, checks.ordinal(F.lit("Четвёртый"), F.lit(9))) == 4 and one(spark, checks.ordinal(F.lit("предпоследний"), F.lit(9))) == 8
    assert one(spark, checks.ordinal(F.lit("иной"), F.lit(9))) is None
    assert one(spark, checks.key_phrase(F.lit("Одно. Суд решил так! Иное."), "решил")) == "Суд решил так!"
    assert [one(spark, checks.is_numeric_cell(F.lit(x))) for x in ("1 200,50", "(5)", "12 %", "5 руб.", "п. 5", "")] == [True, True, True, True, False, False]
    assert one(spark, checks.is_total_cell(F.array(F.lit("x"), F.lit(" ИТОГО")))) and not one(spark, checks.is_total_cell(F.array(F.lit("Итого по делу"))))
    assert one(spark, reconcile.appended_once(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3)))) == [1, 2, 3]


def test_package_numbers_above_99_keep_their_digits(spark):
    df = spark.range(130).selectExpr("'g' AS g", "if(id < 128, 'b', concat('c', id)) AS b", "id")
    got = [r.label for r in reconcile.catalog_order(df, "g", "b", ["id"]).orderBy("id").collect()]
    assert len(set(got)) == 130 and got[8:10] == ["01.09", "01.10"] and got[98:101] == ["01.99", "01.100", "01.101"] and got[127:] == ["01.128", "02.01", "03.01"]


def test_checksums_name_the_level_that_is_wrong(spark):
    from ledgerlens.operators import debt

    rows = [("a", 1, 0, 10), ("a", 2, 0, 5), ("a", 3, 1, 15), ("a", 4, 0, 7), ("a", 5, 1, 8), ("a", 6, 2, 22), ("a", 7, 0, 3), ("a", 8, 1, 3), ("a", 9, 2, 4), ("b", 1, 0, 2), ("b", 2, 2, 2), ("c", 1, 1, 5)]
    df = spark.createDataFrame(rows, "doc string, row_no int, level int, amount int")
    got = {(r.doc, r.row_no): (r.level, r.stated, r.units, r.below, r.state) for r in debt.checksums(df, ["doc"]).collect()}
    assert got == {
        ("a", 3): (1, 15, 15, None, "agreed"), ("a", 5): (1, 8, 7, None, "units"), ("a", 6): (2, 22, 22, 23, "below"), ("a", 8): (1, 3, 3, None, "agreed"), ("a", 9): (2, 4, 3, 3, "units"),
        ("b", 2): (2, 2, 2, None, "agreed"), ("c", 1): (1, 5, 0, None, "units"),
    }


def test_checksums_of_three_levels_take_one_sort_and_agree_with_plain_sums(spark):
    from ledgerlens.operators import debt

    r = random.Random(12)
    rows = [(r.choice("abc"), i, r.choice([0, 0, 0, 0, 1, 1, 2, 3, 4, -1, None]), r.choice([None, 0, 0, 0, 1, 1, 2])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc string, row_no int, level int, amount int")
    want = {}
    for doc in "abc":
        mine = [x[1:] for x in rows if x[0] == doc]
        for at, (no, level, stated) in enumerate(mine):
            if level in (1, 2, 3):
                since = max([i for i in range(at) if mine[i][1] is not None and (mine[i][1] == 3 if level == 3 else mine[i][1] >= level)], default=-1)
                own = [[a for _, x, a in mine[since + 1:at] if x == y and a is not None] for y in (0, level - 1)]
                units, below = sum(own[0]), sum(own[1]) if level > 1 and own[1] else None
                off = stated is not None and (units != stated and "units" or below not in (None, stated) and "below")
                want[doc, no] = (level, stated, units, below, off or "agreed")
    out = debt.checksums(df, ["doc"], levels=3)
    assert {(x.doc, x.row_no): (x.level, x.stated, x.units, x.below, x.state) for x in out.collect()} == want and {x[4] for x in want.values()} == {"agreed", "units", "below"}
    plan = out._jdf.queryExecution().sparkPlan().toString(), out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan[0].count("Scan") == 1 and plan[1].count("Sort [") == 1


def test_checksums_by_level_are_dealt_by_rows_and_hold_long_and_shared_orders(spark, tmp_path, monkeypatch):
    import oracle
    from ledgerlens.plans import adapters, queries
    from ledgerlens.plans.address_queries import checksums_by_level

    r = random.Random(3)
    lines = [(k, r.randrange(50), r.randrange(9), r.randrange(1, 4), float(r.randrange(100, 9999)) / 100) for k in [7] * 1200 + [8] * 2 + [r.randrange(9, 300) for _ in range(800)]]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double").coalesce(1).write.parquet(str(tmp_path / "t/lineitem"))
    spark.createDataFrame([(k, k % 20) for k in range(250)] + [(8, 8), (8, 9), (40, 1)], "o_orderkey long, o_custkey long").coalesce(1).write.parquet(str(tmp_path / "t/orders"))
    for t in ("lineitem", "orders"):
        next((tmp_path / "t" / t).glob("*.parquet")).rename(tmp_path / f"{t}.parquet")
    monkeypatch.setattr(adapters, "ROWS_A_TASK", 200, raising=False)
    n, m, names, same, diff, _ = oracle.compare(spark, oracle.connect(str(tmp_path)), str(tmp_path), checksums_by_level, queries.SQL["checksums_by_level"])
    assert (n, names, same) == (m, True, True), diff
    assert checksums_by_level(spark, str(tmp_path)).rdd.getNumPartitions() >= 2002 // 200


def test_ranges_in_blocks_are_joined_at_their_borders(spark):
    from ledgerlens.operators import text

    r = random.Random(4)
    numbers = sorted({r.randint(-60, 200) for _ in range(180)} | set(range(15, 41)) | {-17, -16, -9, -8})
    want, last = [], None
    for n in numbers:
        if last is not None and n == last + 1:
            want[-1] = (want[-1][0], n)
        else:
            want.append((n, n))
        last = n
    df = spark.createDataFrame([("k", n) for n in numbers], "k string, n long")
    for block in (8, 64, 1000):
        assert sorted((x.first, x.last) for x in text.fold_ranges(df, ["k"], block=block).collect()) == want
