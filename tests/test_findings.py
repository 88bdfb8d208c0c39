"""What the findings on large tables were about: each test holds the shape that makes a query grow no faster than its input."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import scalars as S
from ledgerlens.operators import triage
from ledgerlens.plans import queries

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@tables
def test_texts_of_pages_are_looked_at_before_they_are_repeated(spark):
    plan = optimized(queries.QUERIES["vision_directives"](spark, SF))
    above, below = plan.split("Generate", 1)
    assert "regexp_replace" in below and "regexp_replace" not in above and "RLIKE" not in above


def test_pages_by_kind_are_those_by_text(spark):
    texts = ["", None, "  short ", "x" * 39, "y" * 40, "слово и слово " * 20, "a b " * 100, "�" * 60, "\x01\x02" * 40 + "z" * 30, " " * 90]
    rows = [(i // 20, i, texts[i % len(texts)], i % 3 > 0) for i in range(100)]
    pages = spark.createDataFrame(rows, "doc int, page int, text string, has_images boolean")
    by_kind = pages.select("doc", "page", S.text_kind("text").alias("kind"), "has_images")
    got = triage.vision_pages(by_kind, "doc", limit=5, head=3).orderBy("doc").collect()
    assert got == triage.vision_pages(pages, "doc", limit=5, head=3).orderBy("doc").collect() and sum(r.n_need for r in got) > 20
    assert {r.k for r in by_kind.select(F.col("kind").alias("k")).distinct().collect()} == {"short", "garbage", "text"}


def test_needles_have_their_signs_in_any_text_that_holds_them(spark):
    import random

    from ledgerlens.operators import checks

    r = random.Random(3)
    texts = ["".join(r.choice("аб в\U0001F600") for _ in range(n)) for n in (0, 14, 15, 40, 61, 3000)] + [None, "я" * 500, "ab" * 300]
    corpus = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    needles = [(i * 1000 + k, t[at : at + n]) for i, t in enumerate(texts) if t for k, (at, n) in enumerate((r.randint(0, max(len(t) - 15, 0)), r.choice([15, 19, 20, 39, 40, 59, 60, 200])) for _ in range(40)) if len(t) >= at + n]
    needles += [(10**6 + i, "нет такого " * (i + 2)) for i in range(3)]
    got = {tuple(x) for x in checks.hits(spark.createDataFrame(needles, "needle_id long, needle string"), corpus).collect()}
    assert got == {(i, d) for i, n in needles for d, t in enumerate(texts) if t and n in t} and len(got) > 100
    old = checks.PIECE
    try:  # texts longer than a piece lose no window at the cut
        checks.PIECE = 100
        whole = {g for _, g in [(s, x) for _, s, gs in checks.signs_of([texts[5]], sorted(checks.SPANS), False) for x in gs.tolist()]}
        cut = {x for nos, ts in checks._pieces([texts[5]], max(checks.SPANS)) for _, _, gs in checks.signs_of(ts, sorted(checks.SPANS), False) for x in gs.tolist()}
    finally:
        checks.PIECE = old
    assert whole == cut


def test_many_needles_of_a_text_are_found_like_one(spark):
    import random

    from ledgerlens.operators import checks

    r = random.Random(4)
    text = "".join(r.choice("абв \U0001F600") for _ in range(2000))
    needles = [text[a : a + 60] for a in range(0, 1900, 40)] + ["ab" * 30] * 20 + [text[:7], "", text, text + "x"]
    assert checks.held(text, needles) == [n in text for n in needles]


@tables
def test_documents_share_few_signs_with_needles_and_texts_of_the_others_are_not_normalised(spark):
    plan = optimized(queries.QUERIES["quote_in_corpus"](spark, SF))
    assert "regexp_extract_all" not in plan and "LeftSemi" in plan


@tables
def test_cells_of_sheets_are_typed_once_for_all_checks(spark):
    plan = optimized(queries.QUERIES["sheet_findings"](spark, SF))
    assert "o_totalprice" not in plan and "try_to_timestamp" not in plan


def test_needles_make_no_pairs_with_documents_that_only_share_their_sign(spark):
    from ledgerlens.operators import checks
    from pyspark.sql import functions as F

    made, write = [], checks.kept
    common = "а" * 30 + "бвгдежзиклмнопрстуфхцчшщ" * 2  # most grams of each needle, so many needles share their signs
    texts = [f"{i:06d} начало {common} конец {i * 7919 % 10007:06d} и ещё немного слов" for i in range(200)]
    corpus = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    needles = spark.createDataFrame([(i, t[10 + i % 3 : 70 + i % 3]) for i, t in enumerate(texts)] + [(1000 + i, t[40:100]) for i, t in enumerate(texts)], "needle_id long, needle string")
    checks.kept = lambda df: made.append(write(df)) or made[-1]
    try:
        got = checks.hits(needles, corpus)
        rows = {tuple(x) for x in got.collect()}
    finally:
        checks.kept = write
    want = {(r.needle_id, d) for r in needles.collect() for d, t in enumerate(texts) if r.needle in t}
    assert rows == want and len(want) == got.count()
    # what is written on the way grows with needles and texts, not with their product
    assert sum(x.count() for x in made) < 20 * (400 + len(texts))
    with_text = checks.hits(needles, corpus, texts=True).select("needle_id", "doc_id", F.col("text")).collect()
    assert {(r.needle_id, r.doc_id) for r in with_text} == want and all(r.text == texts[r.doc_id] for r in with_text)
