"""Queries of ingest, triage and single rules, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions import scalars as S
from ledgerlens.operators import rules, text, triage
from ledgerlens.sources import documents, html
from ledgerlens.streaming import events

from .adapters import read
from .queries import query


def _turn(values, key):
    """One of the values by turns."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def _list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


# --- ingest

_ERRORS = (None, "No such file or directory", "file not materialized", "format error: broken", "Input/output error", "something else")


@query(f"""SELECT o_orderkey, e, COALESCE(e = 'not_materialized', FALSE) AS again FROM (SELECT o_orderkey, CASE WHEN m IS NULL AND n IS NULL THEN NULL WHEN size = 0 THEN 'empty' WHEN n = 5 OR m IN ('No such file or directory', 'file not materialized', 'Input/output error') THEN 'not_materialized' ELSE 'corrupt' END AS e
 FROM (SELECT o_orderkey, o_orderkey % 4 AS size, ({_list(_ERRORS)})[o_orderkey % 6 + 1] AS m, CASE o_orderkey % 5 WHEN 1 THEN 5 WHEN 2 THEN 22 END AS n FROM orders))""")
def open_errors(spark, d):
    k = F.col("o_orderkey")
    e = triage.open_error(k % 4, _turn(_ERRORS, k), F.when(k % 5 == 1, 5).when(k % 5 == 2, 22))
    return read(spark, d, "orders").select("o_orderkey", e.alias("e"), triage.retryable(e).alias("again"))


_PAGES = (
    "ПЛАТЁЖНОЕ  поручение покупателя по договору поставки, ИНН 7700000001",
    "Арбитражный суд города вынес определение о принятии заявления, ИНН 770000000002",
    "определение того, что понимается сторонами под поставкой товара по договору",
    "",
    "Счет-фактура покупателя за поставку товара, принятого по договору без замечаний",
)


@query("""WITH p AS (SELECT c_custkey, CAST(page AS INT) AS page, c_custkey * page % 5 AS k FROM customer, (SELECT UNNEST(range(1, 8)) AS page)), h AS (SELECT c_custkey, CASE k WHEN 0 THEN 'платежное поручение' WHEN 1 THEN 'определение' WHEN 4 THEN 'счет-фактура' END AS h, page, k FROM p),
 g AS (SELECT c_custkey, h, array_to_string(list(page ORDER BY page), ',') AS pages FROM h WHERE h IS NOT NULL GROUP BY 1, 2 HAVING COUNT(*) >= 2), t AS (SELECT c_custkey, COUNT(DISTINCT k) FILTER (k IN (0, 1)) AS n_tax_ids FROM p GROUP BY 1)
 SELECT g.c_custkey, string_agg(h || ':' || pages, ';' ORDER BY h) AS headings, MAX(n_tax_ids) AS n_tax_ids FROM g JOIN t ON g.c_custkey = t.c_custkey GROUP BY 1""")
def composite_files(spark, d):
    p = read(spark, d, "customer").select("c_custkey", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("page"))
    found = triage.composite(p.select("c_custkey", "page", _turn(_PAGES, F.col("c_custkey") * F.col("page")).alias("text"), F.lit(False).alias("has_images")), "c_custkey")
    line = F.transform("headings", lambda h: F.concat(h["value"], F.lit(":"), F.array_join(h["pages"].cast("array<string>"), ",")))
    return found.select("c_custkey", F.array_join(line, ";").alias("headings"), "n_tax_ids")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 'own-work' WHEN s_suppkey % 6 = 0 THEN 'unclear' WHEN s_nationkey % 5 = 0 THEN 'client' WHEN s_nationkey % 5 = 1 THEN 'opponent' WHEN s_nationkey % 5 = 2 THEN 'court' WHEN s_nationkey % 5 = 3 THEN 'ally' ELSE 'unclear' END AS origin,
 CASE WHEN s_suppkey % 7 = 0 OR s_suppkey % 4 = 0 THEN NULL ELSE s_suppkey % 4 = 1 END AS belongs FROM supplier""")
def origins(spark, d):
    k, n = F.col("s_suppkey"), F.col("s_nationkey") % 5
    who = triage.origin(F.when(k % 6 > 0, F.col("s_name")), {"client": n == 0, "opponent": n == 1, "court": n == 2, "ally": n == 3}, k % 7 == 0)
    named = F.when(k % 4 == 0, F.array().cast("array<string>")).when(k % 4 == 1, F.array(F.lit("А33-2"), F.lit("А33-1"))).otherwise(F.array(F.lit("А33-11")))
    return read(spark, d, "supplier").select("s_suppkey", who.alias("origin"), triage.belongs(named, F.lit("А33-1"), who).alias("belongs"))


@query("""SELECT p_partkey, CASE WHEN m = 'table-structure' THEN CASE WHEN f THEN 'low' ELSE 'high' END WHEN u > 2 OR s >= 3 OR t THEN 'low' WHEN u = 0 AND s = 0 THEN 'high' ELSE 'medium' END AS quality,
 CASE WHEN m = 'table-structure' THEN f ELSE u > 2 OR s > 0 OR t END AS needs_manual_review FROM (SELECT p_partkey, ['pdf-text', 'table-structure', 'vision'][p_partkey % 3 + 1] AS m, p_partkey % 5 AS u, p_size % 5 AS s, p_partkey % 11 = 0 AS t, p_partkey % 2 = 0 AS f FROM part)""")
def grades(spark, d):
    k = F.col("p_partkey")
    g = triage.grade(_turn(("pdf-text", "table-structure", "vision"), k), k % 5, F.col("p_size") % 5, k % 11 == 0, k % 2 == 0)
    return read(spark, d, "part").select("p_partkey", *[c.alias(n) for n, c in g.items()])


@query("""SELECT c_custkey, page, CASE WHEN page <= 2 THEN 'p' || page || c_name ELSE '' END AS text FROM (SELECT c_custkey, c_name, CAST(UNNEST(range(1, CASE c_custkey % 4 WHEN 0 THEN 3 ELSE c_custkey % 4 + 1 END)) AS INT) AS page FROM customer)""")
def pages_split(spark, d):
    k = F.col("c_custkey")
    c = read(spark, d, "customer").select("c_custkey", (k % 4).alias("declared"), F.concat(F.lit("p1"), "c_name", F.lit("\fp2"), "c_name", F.lit("\f \n")).alias("text"))
    return documents.split_pages(c, "c_custkey", "declared")


@query("""SELECT p_partkey, p_name || chr(10) || chr(10) || '<' || p_type || '>' || chr(10) || chr(10) || p_partkey || chr(10) || chr(10) || 'tail' AS body, 'КонсультантПлюс: ' || p_brand || ' см.' AS notes, 'full-text__wrapper=Open ' || p_size AS furniture FROM part""")
def html_documents(spark, d):
    page = F.format_string(
        '<html><div class="menu">x<br></div><div class="wide full-text"><p>%s<br>  &lt;%s&gt; </p><div class="a doc-insert">КонсультантПлюс: %s<p>см.</p></div>'
        '<script>var p = "<p>";</script><div class="full-text__wrapper">Open<div>%s</div></div><h2>%s</h2>tail<span></div><p>after</p></html>', "p_name", "p_type", "p_brand", "p_size", "p_partkey",
    )
    got = html.extract_document(read(spark, d, "part").select("p_partkey", page.alias("html")), "p_partkey", "html")
    return got.select("p_partkey", "body", F.array_join("notes", "|").alias("notes"), F.array_join(F.transform("furniture", lambda f: F.concat(f["class"], F.lit("="), f["text"])), "|").alias("furniture"))


# --- strings

@query("""SELECT c_custkey, '00' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') || ',' || '770000' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS tax_ids, 'doc-' || c_custkey || ',doc-7' AS refs FROM customer""")
def ids_found(spark, d):
    k = F.col("c_custkey").cast("string")
    t = F.concat(F.lit("ИНН 00"), F.lpad(k, 8, "0"), F.lit(", 770000"), F.lpad(k, 6, "0"), F.lit(", 12345678901, 1234567890123 [doc-"), k, F.lit("] [doc-] [Doc-1] [doc-7]"))
    return read(spark, d, "customer").select("c_custkey", F.array_join(S.tax_ids(t), ",").alias("tax_ids"), F.array_join(S.doc_refs(t), ",").alias("refs"))


@query("""SELECT p_partkey, 'ООО-' || replace(p_name, ' ', '-') || '-И-И--' || replace(p_brand, '#', '-') || '-' || p_partkey AS slug, p_partkey % 8 < 7 AS draft FROM part""")
def slugs_and_drafts(spark, d):
    k = F.col("p_partkey")
    slug = S.slug(F.concat(F.lit(" ООО «"), "p_name", F.lit("», И. И. ")), F.concat("p_brand", F.lit(" / "), k.cast("string"), F.lit("!")))
    marks = ("[ПЛЕЙСХОЛДЕР]", "[TODO]", "[…]", "[...]", "XXX", "указать дату", "подпись ____", "проект решения ___ [..]")
    return read(spark, d, "part").select("p_partkey", slug.alias("slug"), S.is_draft(F.concat("p_name", F.lit(" "), _turn(marks, k))).alias("draft"))


@query("""SELECT p_partkey, p_name || ' ' || p_brand || ' and code 2*3 и 5*7 курсив, ' || p_type AS plain, p_name || ' |*' || p_brand || '| and code 2*3 и 5*7 курсив, |*' || p_type AS segments FROM part""")
def markup_stripped(spark, d):
    t = F.concat(F.lit("["), "p_name", F.lit("](x/y) **"), "p_brand", F.lit("** and `code` 2*3 и 5*7 *курсив*, __"), "p_type", F.lit("__"))
    pieces = F.transform(S.inline_segments(t), lambda s: F.concat(F.when(s["bold"], "*").otherwise(""), s["text"]))
    return read(spark, d, "part").select("p_partkey", S.strip_markup(t).alias("plain"), F.array_join(pieces, "|").alias("segments"))


# --- rules of one row

@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) < DATE '1997-01-01' AND o_orderkey % 3 <> 1 AS breach, COALESCE(o_totalprice / NULLIF(CAST(o_orderkey % 4 * 200000 AS DOUBLE), 0) >= 0.25::DOUBLE, FALSE) AS major,
 FLOOR(o_totalprice * ((o_orderkey % 5)::DOUBLE / NULLIF((o_orderkey % 7)::DOUBLE, 0)) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS share, CASE WHEN o_orderkey % 2 = 0 THEN TRUE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 3 = 1 END AS delivered,
 CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority ELSE o_orderstatus END AS value, o_orderkey % 5 <> 0 AND o_orderkey % 6 = 0 AS conflict FROM orders""")
def row_rules(spark, d):
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    told = rules.by_priority(F.when(k % 5 > 0, F.col("o_orderstatus")), F.when((k % 5 == 0) | (k % 6 == 0), F.col("o_orderpriority")))
    return read(spark, d, "orders").select(
        "o_orderkey", rules.schedule_breach(F.col("o_orderdate").cast("date"), F.when(k % 3 == 1, True), F.lit("1997-01-01").cast("date")).alias("breach"), rules.major_deal(price, (k % 4 * 200000).cast("double")).alias("major"),
        rules.cost_share(price, (k % 5).cast("double"), (k % 7).cast("double")).alias("share"), rules.delivered(k % 2 == 1, F.when(k % 3 > 0, k % 3 == 1)).alias("delivered"), *[c.alias(n) for n, c in told.items()],
    )


# --- runs

_LINES = ("```", "## Приложение", "текст строки", "## Итоги", "ещё текст", "```sql", "конец")


@query(f"""WITH l AS (SELECT c_custkey, CAST(n AS INT) AS line_no, ({_list(_LINES)})[(c_custkey + 1) * n % 7 + 1] AS t FROM customer, (SELECT UNNEST(range(1, 13)) AS n)), m AS (SELECT *, COUNT(*) FILTER (t LIKE '```%') OVER w % 2 = 1 AS fenced, MAX(line_no) FILTER (t LIKE '## %') OVER w AS at FROM l WINDOW w AS (PARTITION BY c_custkey ORDER BY line_no))
 SELECT m.c_custkey, m.line_no, m.fenced, h.t = '## Приложение' AS in_appendix FROM m LEFT JOIN l h ON m.c_custkey = h.c_custkey AND m.at = h.line_no""")
def line_states(spark, d):
    c = read(spark, d, "customer").select("c_custkey", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("line_no"))
    t = F.col("text")
    lines = c.withColumn("text", _turn(_LINES, (F.col("c_custkey") + 1) * F.col("line_no")))
    return text.state_of_lines(lines, ["c_custkey"], F.when(t.startswith("## "), t == "## Приложение"), "in_appendix").select("c_custkey", "line_no", "fenced", "in_appendix")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts <= LAG(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, SUM(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM e)
 SELECT user_id, MIN(ts) AS began, COUNT(*) AS n FROM s GROUP BY user_id, i""")
def user_sessions(spark, d):
    return events.sessions(read(spark, d, "events")).select("user_id", F.col("w.start").alias("began"), "n")
