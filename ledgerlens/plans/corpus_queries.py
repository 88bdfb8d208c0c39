"""Queries of the corpus checkers and the rule tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import checks, counts, norms, reconcile, rules, text

from .adapters import read
from .queries import query


def _nth(names, key: str):
    """One of the names, by turns; and none of them every so often."""
    return F.element_at(F.array(*[F.lit(x) for x in names], F.lit("other")), (F.col(key) % (len(names) + 1) + 1).cast("int"))


def _list(names) -> str:
    return "[" + ", ".join(f"'{x}'" for x in [*names, "other"]) + "]"


# --- rules

_K = list(rules.FLAT)


@query(f"""SELECT o.o_orderkey, CAST(CASE WHEN o.o_orderstatus = 'F' THEN t.c ELSE t.p END AS DOUBLE) AS fee FROM (SELECT *, ({_list(_K)})[o_orderkey % {len(_K) + 1} + 1] AS kind FROM orders) o
 LEFT JOIN (VALUES ('contract', 15000, 50000), ('unvalued', 15000, 50000), ('non-normative', 10000, 50000), ('creditor-bankruptcy', 10000, 100000), ('own-bankruptcy', 0, 0), ('legal-fact', 30000, 30000), ('succession', 5000, 25000),
 ('writ-paper', 10000, 10000), ('new-facts', 30000, 30000), ('interim-measure', 30000, 30000), ('delay', 300, 6000), ('appeal', 10000, 30000), ('cassation', 20000, 50000), ('supreme', 30000, 80000)) t(kind, p, c) ON o.kind = t.kind""")
def flat_fees(spark, d):
    return read(spark, d, "orders").select("o_orderkey", rules.flat_fee(_nth(_K, "o_orderkey"), F.col("o_orderstatus") == "F").alias("fee"))


_BASE = "LEAST(CASE WHEN p <= 100000 THEN 10000 WHEN p <= 1000000 THEN 10000 + 0.05::DOUBLE * (p - 100000) WHEN p <= 10000000 THEN 55000 + 0.03::DOUBLE * (p - 1000000) WHEN p <= 50000000 THEN 325000 + 0.01::DOUBLE * (p - 10000000) ELSE 725000 + 0.005::DOUBLE * (p - 50000000) END, 10000000)"
_CENT = lambda x: f"(FLOOR(({x}) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE)"


@query(f"""WITH o AS (SELECT o_orderkey, o_totalprice AS p, ['order', 'separate-dispute', 'arbitral-writ', 'copies'][o_orderkey % 4 + 1] AS k FROM orders), b AS (SELECT *, {_CENT(_BASE)} AS f FROM o)
 SELECT o_orderkey, CASE k WHEN 'copies' THEN 0.0 WHEN 'order' THEN GREATEST({_CENT('f * 0.5::DOUBLE')}, 8000.0) WHEN 'separate-dispute' THEN {_CENT('f * 0.5::DOUBLE')} ELSE {_CENT('f * 0.3::DOUBLE')} END AS fee FROM b""")
def shared_fees(spark, d):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("order", "separate-dispute", "arbitral-writ", "copies")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return read(spark, d, "orders").select("o_orderkey", rules.request_fee(kind, rules.shared_fee(kind, F.col("o_totalprice"))).alias("fee"))


@query("""SELECT o_orderkey, CAST((CASE o_orderkey % 3 WHEN 1 THEN CASE WHEN o_orderkey % 4 > 0 THEN s + 5 END WHEN 2 THEN s + 9 ELSE s END) + CASE WHEN o_orderkey % 5 = 0 THEN 30 ELSE CAST(o_orderkey % 5 * 10 AS INT) END AS DATE) AS ready FROM (SELECT *, CAST(o_orderdate AS DATE) AS s FROM orders)""")
def claim_ready(spark, d):
    s, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey")
    start = F.when(k % 3 == 1, "receipt").when(k % 3 == 2, "registration").otherwise("sending")
    return read(spark, d, "orders").select("o_orderkey", rules.claim_ready(start, s, F.when(k % 4 > 0, F.date_add(s, 5)), F.date_add(s, 9), F.when(k % 5 > 0, k % 5 * 10)).alias("ready"))


_L = list(rules.LIMITATION)


@query(f"""SELECT o_orderkey, CAST(LEAST(s + to_months(COALESCE(t.m, 36)), b + INTERVAL 120 MONTH) AS DATE) AS ends FROM (SELECT *, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) - CAST(o_orderkey % 4000 AS INT) AS b, ({_list(_L)})[o_orderkey % {len(_L) + 1} + 1] AS k FROM orders) o
 LEFT JOIN (VALUES ('general', 36), ('voidable', 12), ('void', 36), ('carriage', 12), ('works', 12), ('buildings', 36), ('property-insurance', 24), ('pre-emption', 3), ('labour', 3), ('wages', 12)) t(k, m) ON o.k = t.k""")
def limitation_ends(spark, d):
    s = F.col("o_orderdate").cast("date")
    return read(spark, d, "orders").select("o_orderkey", rules.limitation_end(_nth(_L, "o_orderkey"), s, F.date_sub(s, (F.col("o_orderkey") % 4000).cast("int"))).alias("ends"))


_S, _V = list(rules.STAGES), ["overturned", "modified", "upheld", "dismissed", "granted", "partial", "denied", "terminated", "settled", "withdrawn"]


@query(f"""SELECT c_custkey, t.stage, CASE WHEN c_custkey % 4 < 2 AND v IN ('overturned', 'modified') THEN 'granted' WHEN c_custkey % 4 < 2 AND v IN ('upheld', 'dismissed') THEN 'denied'
 WHEN c_custkey % 4 = 2 AND v IN ('granted', 'partial', 'denied') THEN v WHEN c_custkey % 4 = 3 AND v IN ('settled', 'withdrawn') THEN 'granted' END AS outcome
 FROM (SELECT *, ({_list(_S)})[c_custkey % {len(_S) + 1} + 1] AS k, ({_list(_V)})[c_custkey % {len(_V) + 1} + 1] AS v FROM customer) c LEFT JOIN (VALUES ('active', '1 инстанция'), ('suspended', '1 инстанция (приостановлено)'), ('pending_appeal', 'Апелляция'), ('pending_cassation', 'Кассация'), ('pending_settlement', 'Примирение'),
 ('settled', 'Завершено (мировое)'), ('withdrawn', 'Завершено (отказ)'), ('enforcement', 'Исполнение'), ('completed', 'Решение вступило в силу'), ('archived', 'Закрыто')) t(k, stage) ON c.k = t.k""")
def stages_and_outcomes(spark, d):
    source = F.element_at(F.array(*[F.lit(x) for x in ("appeal", "cassation", "adjustment", "status")]), (F.col("c_custkey") % 4 + 1).cast("int"))
    return read(spark, d, "customer").select("c_custkey", rules.stage(_nth(_S, "c_custkey")).alias("stage"), rules.outcome(source, _nth(_V, "c_custkey")).alias("outcome"))


_C = list(rules.SHARDS)


@query(f"""SELECT c_custkey, t.shard, t.court FROM (SELECT *, ({_list(_C)})[c_custkey % {len(_C) + 1} + 1] AS k FROM customer) c LEFT JOIN (VALUES ('исковое (АПК)', 'исковое-АПК', 'арбитражный'), ('экономические споры', 'исковое-АПК', 'арбитражный'), ('банкротство', 'банкротство', 'банкротный'),
 ('корпоративный спор', 'корпоративный-спор', 'арбитражный'), ('административное (АПК)', 'административное-АПК', 'арбитражный'), ('исковое (ГПК)', 'исковое-ГПК', 'СОЮ'), ('трудовой спор', 'трудовой-спор', 'СОЮ'), ('административное (КАС)', 'административное-КАС', 'КАС')) t(k, shard, court) ON c.k = t.k""")
def shards_and_routes(spark, d):
    k = _nth(_C, "c_custkey")
    return read(spark, d, "customer").select("c_custkey", rules.shard(k).alias("shard"), rules.route(k).alias("court"))


@query(f"""SELECT o_orderkey, CAST(s + to_months(t.m) AS DATE) AS complaint, CAST(s + u.d AS DATE) AS short FROM (SELECT *, CAST(o_orderdate AS DATE) AS s, ['general', 'insolvency'][o_orderkey % 2 + 1] AS c, ['appeal', 'cassation', 'supreme', 'supervision'][o_orderkey % 5 + 1] AS i, ({_list(rules.SHORT_TERMS)})[o_orderkey % {len(rules.SHORT_TERMS) + 1} + 1] AS k FROM orders) o
 LEFT JOIN (VALUES ('general', 'appeal', 1), ('general', 'cassation', 3), ('general', 'supreme', 3), ('general', 'supervision', 3), ('insolvency', 'appeal', 1), ('insolvency', 'cassation', 2), ('insolvency', 'supreme', 2)) t(c, i, m) ON o.c = t.c AND o.i = t.i
 LEFT JOIN (VALUES ('bailiff', 10), ('removal', 10), ('public-event', 10), ('dissolution', 10)) u(k, d) ON o.k = u.k""")
def complaint_terms(spark, d):
    k, s = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    court = F.when(k % 2 == 0, "general").otherwise("insolvency")
    instance = F.get(F.array(*[F.lit(x) for x in ("appeal", "cassation", "supreme", "supervision")]), (k % 5).cast("int"))
    return read(spark, d, "orders").select("o_orderkey", rules.complaint_deadline(court, instance, s).alias("complaint"), rules.short_deadline(_nth(rules.SHORT_TERMS, "o_orderkey"), s).alias("short"))


@query("SELECT a.p_partkey AS a, b.s_suppkey AS b FROM part a JOIN supplier b ON a.p_partkey = b.s_suppkey")
def file_names_matched(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("a"), rules.file_name_key(F.concat(F.lit("Отчёт__"), F.col("p_partkey").cast("string"), F.lit(" .PDF"))).alias("k"))
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("b"), rules.file_name_key(F.concat(F.lit("отчет "), F.col("s_suppkey").cast("string"), F.lit("_.pdf"))).alias("k"))
    return p.join(s, "k").select("a", "b")


# --- quotations

_TYPO = "lower(trim(regexp_replace(regexp_replace(regexp_replace(translate(%s, 'ёЁ', 'еЕ'), '[«»\"“”„]', '\"', 'g'), '[‐‑‒–—―−]', '-', 'g'), '[\\s\\pZ\\x1c-\\x1f\\x85\\v]+', ' ', 'g'), ' '))"


@query(f"SELECT doc_id, sha256({_TYPO % 'text'}) AS key FROM documents")
def typographic_keys(spark, d):
    return read(spark, d, "documents").select("doc_id", F.sha2(checks.typographic(F.col("text")), 256).alias("key"))


def _quotes(spark, d):
    """Each item of the benchmark as a quotation of the whole of it, with a gap marked in its middle."""
    half = F.expr("length(text) div 2")
    q = F.concat(F.substring(F.col("text"), F.lit(1), half), F.lit(" … "), F.substring(F.col("text"), half + 1, F.length("text")))
    return read(spark, d, "benchmark").select(F.col("item_id").alias("quote_id"), checks.typographic(q).alias("quote"))


def _corpus(spark, d):
    return read(spark, d, "documents").select("doc_id", checks.typographic(F.col("text")).alias("text"))


_CORPUS = f"SELECT doc_id, {_TYPO % 'text'} AS t FROM documents"
_PARTS = f"SELECT item_id, trim({_TYPO % 'substr(text, 1, length(text) // 2)'}) AS h, trim({_TYPO % 'substr(text, length(text) // 2 + 1)'}) AS e FROM benchmark"


@query(f"SELECT q.item_id AS quote_id, c.doc_id FROM ({_PARTS}) q JOIN ({_CORPUS}) c ON contains(c.t, q.h) AND contains(substr(c.t, strpos(c.t, q.h) + length(q.h)), q.e)")
def quote_in_corpus(spark, d):
    return checks.confirmed(_quotes(spark, d), _corpus(spark, d))


@query(f"""SELECT g, COUNT(*) AS n_items, COUNT(*) FILTER (used) AS n_used, COUNT(*) FILTER (NOT used) AS n_missing, (SELECT COUNT(*) FROM part WHERE p_partkey % 5 = g) AS n_ghost FROM
 (SELECT item_id % 5 AS g, EXISTS (SELECT 1 FROM ({_CORPUS}) c WHERE contains(c.t, q.h) AND contains(substr(c.t, strpos(c.t, q.h) + length(q.h)), q.e)) AS used FROM ({_PARTS}) q) GROUP BY 1""")
def coverage_missing(spark, d):
    """Items that some document quotes; parts are used as well, under numbers that no item has."""
    used = quote_in_corpus(spark, d).select((F.col("quote_id") % 5).alias("g"), F.col("quote_id").alias("item"))
    ghosts = read(spark, d, "part").select((F.col("p_partkey") % 5).alias("g"), (-1 - F.col("p_partkey")).alias("item"))
    return text.coverage(read(spark, d, "benchmark").select((F.col("item_id") % 5).alias("g"), F.col("item_id").alias("item")), used.unionByName(ghosts), ["g"])


@query()
def quotation_lines(spark, d):
    """Quotations of documents that quote their own text over several lines."""
    t = F.concat(F.lit("Вступление\n> «"), F.translate("text", "«»", "  "), F.lit("»\nи затем\n«"), F.substring(F.translate("text", "«»", "  "), 1, 50), F.lit("»"))
    return checks.quotations(read(spark, d, "documents").select("doc_id", t.alias("text")), "doc_id").withColumn("quote", F.sha2("quote", 256))


@query()
def closest_places(spark, d):
    """For each item of the benchmark, the place of the corpus that is likest to it."""
    return checks.closest(read(spark, d, "benchmark").select(F.col("item_id").alias("quote_id"), checks.typographic(F.col("text")).alias("quote")), _corpus(spark, d)).select("quote_id", "doc_id", F.round("ratio", 6).alias("ratio"))


@query(f"""WITH q AS (SELECT item_id, substr({_TYPO % 'text'}, 1, 60) AS h, item_id % 2 = 0 AS art FROM benchmark), h AS (SELECT q.item_id, c.doc_id, (c.doc_id % 2 = 0) = q.art AS fits FROM q JOIN ({_CORPUS}) c ON contains(c.t, q.h)),
 g AS (SELECT item_id, COUNT(*) AS n, COUNT(*) FILTER (fits) AS f, MIN(doc_id) AS a, MIN(doc_id) FILTER (fits) AS b FROM h GROUP BY 1)
 SELECT q.item_id AS quote_id, COALESCE(n, 0) AS n_hits, CASE WHEN n IS NULL THEN 'outside' WHEN n = 1 OR f = 1 THEN 'found' ELSE 'ambiguous' END AS state, CASE WHEN n = 1 THEN a WHEN f = 1 THEN b END AS para_id FROM q LEFT JOIN g ON q.item_id = g.item_id""")
def addresses_located(spark, d):
    q = read(spark, d, "benchmark").select(F.col("item_id").alias("quote_id"), checks.typographic(F.col("text")).alias("quote"), (F.col("item_id") % 2 == 0).alias("names_article"))
    p = _corpus(spark, d).select(F.col("doc_id").alias("para_id"), F.when(F.col("doc_id") % 2 == 0, "норма").otherwise("акт").alias("kind"), "text")
    return checks.located(q, p)


_O = [*checks.ORDINALS, "последний", "предпоследний", "4", "ВТОРОЙ", "четвёртый"]


@query(f"""SELECT p_partkey, CASE WHEN i < 20 THEN i + 1 WHEN i = 20 THEN p_size WHEN i = 21 THEN p_size - 1 WHEN i = 22 THEN 4 WHEN i = 23 THEN 2 WHEN i = 24 THEN 4 END AS n FROM (SELECT p_partkey, p_size, CAST(p_partkey % {len(_O) + 1} AS INT) AS i FROM part)""")
def ordinals(spark, d):
    return read(spark, d, "part").select("p_partkey", checks.ordinal(_nth(_O, "p_partkey"), F.col("p_size")).alias("n"))


# --- norms

_LAW, _ART, _ITEM = "l_orderkey // 8100000 + 127", "l_orderkey % 9000 + 1", "l_orderkey // 9000 % 900 + 1"
_FRAG = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT))"


def _fragments(spark, d):
    """Line items in the language of norms: an order's lines speak of one norm (law, article and item, so that norms grow with
    orders), apply it or not, within terms of days."""
    frag = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long"))
    k = F.col("l_orderkey")
    t = F.concat(F.lit("Пункт "), (F.floor(k / 9000) % 900 + 1).cast("string"), F.lit(" ст. "), (k % 9000 + 1).cast("string"), F.lit(" ФЗ-"), (F.floor(k / 8100000) + 127).cast("string"), F.lit(" в деле "), frag, F.when(F.col("l_returnflag") == "R", " не применяется в срок ").otherwise(" применяется в срок "), F.col("l_quantity").cast("int").cast("string"), F.lit(" дней"))
    return read(spark, d, "lineitem").select(frag.alias("frag_id"), t.alias("text"))


@query(f"""WITH f AS (SELECT DISTINCT {_FRAG} AS id, 'ФЗ-' || ({_LAW}) || ' ст.' || ({_ART}) || '/п.' || ({_ITEM}) AS norm, l_returnflag = 'R' AS neg, CAST(l_quantity AS INT) AS n FROM lineitem),
 c AS (SELECT norm FROM (SELECT {_FRAG} AS id, 'ФЗ-' || ({_LAW}) || ' ст.' || ({_ART}) || '/п.' || ({_ITEM}) AS norm FROM lineitem) GROUP BY norm HAVING COUNT(*) BETWEEN 2 AND 60), k AS (SELECT f.* FROM f JOIN c USING (norm))
 SELECT norm, 'не-применяетс' AS axis, a.id AS a, b.id AS b FROM k a JOIN k b USING (norm) WHERE a.neg AND NOT b.neg
 UNION SELECT norm, 'срок: ' || LEAST(a.n, b.n) || ' / ' || GREATEST(a.n, b.n) || ' дн', a.id, b.id FROM k a JOIN k b USING (norm) WHERE a.id < b.id AND a.n <> b.n""")
def norm_conflicts(spark, d):
    return norms.contradictions(_fragments(spark, d), with_terms=True)


# --- counts and links

@query("""SELECT o_orderkey, 1 AS line_no, CAST(o_orderkey % 6 + 2 AS INT) AS claimed, l.n AS listed FROM (SELECT DISTINCT o_orderkey FROM orders) o JOIN (SELECT l_orderkey, COUNT(*) AS n FROM lineitem GROUP BY 1) l ON o_orderkey = l_orderkey""")
def announced_counts(spark, d):
    """Orders as texts: a line that announces points, a blank one, and the order's lines as a list."""
    word = F.element_at(F.array(*[F.lit(x) for x in ("два", "трёх", "четыре", "пяти", "шесть", "7")]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    head = read(spark, d, "orders").select("o_orderkey").distinct().select("o_orderkey", F.explode(F.array(F.struct(F.lit(1).alias("line_no"), F.concat(F.lit("Нужно "), word, F.lit(" обязательных условия:")).alias("text")), F.struct(F.lit(2).alias("line_no"), F.lit("").alias("text")))).alias("l")).select("o_orderkey", "l.*")
    from pyspark.sql import Window

    no = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")) + 2
    body = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), no.alias("line_no"), F.concat(F.lit("- часть "), F.col("l_partkey").cast("string")).alias("text"))
    return counts.announced(head.unionByName(body), ["o_orderkey"])


@query("""SELECT 'd' || (doc_id % 50) || '/f ' || doc_id || '.md' AS file, 3 AS line_no, '../d' || ((doc_id + 7) % 50) || '/f%20' || (doc_id + 7) || '.md:12' AS href, 'd' || ((doc_id + 7) % 50) || '/f ' || (doc_id + 7) || '.md:12' AS target FROM documents WHERE doc_id + 7 NOT IN (SELECT doc_id FROM documents)""")
def links_broken(spark, d):
    k = F.col("doc_id")
    name = lambda n, space: F.concat(F.lit("d"), (n % 50).cast("string"), F.lit(f"/f{space}"), n.cast("string"), F.lit(".md"))
    docs = read(spark, d, "documents")
    lines = docs.select(name(k, " ").alias("file"), F.explode(F.array(
        F.struct(F.lit(1).alias("line_no"), F.lit("`[x](no.md)` [y](https://e.org) [z](#a) [up](../../releases)").alias("text")),
        F.struct(F.lit(2).alias("line_no"), F.lit("[folder](../d1/)").alias("text")),
        F.struct(F.lit(3).alias("line_no"), F.concat(F.lit("[next](../"), name(k + 7, "%20"), F.lit(":12)")).alias("text")),
        F.struct(F.lit(4).alias("line_no"), F.lit("```").alias("text")), F.struct(F.lit(5).alias("line_no"), F.lit("[in a fence](gone.md)").alias("text")), F.struct(F.lit(6).alias("line_no"), F.lit("```").alias("text")),
    )).alias("l")).select("file", "l.*")
    return checks.broken_links(lines, docs.select(name(k, " ").alias("file")))


# --- sets and registries

@query("""SELECT o_orderkey, list_sort(list_distinct([x for x in [o_orderkey % 7, o_orderkey % 3] if x not in [o_custkey % 5, o_orderkey % 3]])) AS unlisted, list_sort(list_distinct([x for x in [o_custkey % 5, o_orderkey % 3] if x not in [o_orderkey % 7, o_orderkey % 3]])) AS unused FROM orders""".replace("list_sort(list_distinct([x for", "array_to_string(list_sort(list_distinct([x for").replace("]])) AS", "]])), ',') AS"))
def refs_compared(spark, d):
    k = F.col("o_orderkey")
    two = checks.differing_refs(F.array(k % 7, k % 3), F.array(F.col("o_custkey") % 5, k % 3))
    return read(spark, d, "orders").select("o_orderkey", *[F.array_join(c.cast("array<string>"), ",").alias(n) for n, c in two.items()])


@query("""SELECT p.doc_id AS page, p.n AS para_no FROM (SELECT doc_id, n, (doc_id * n) % 5 AS t FROM documents, (SELECT UNNEST([1, 2, 3, 4]) AS n)) p WHERE NOT EXISTS (SELECT 1 FROM (SELECT UNNEST([0, 1]) AS t) s WHERE s.t = p.t)""")
def head_paragraphs(spark, d):
    k = read(spark, d, "documents").select(F.col("doc_id").alias("page"))
    head = k.select("page", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3, 4)])).alias("para_no")).withColumn("text", (F.col("page") * F.col("para_no") % 5).cast("string"))
    return checks.head_only(head, k.select("page", F.explode(F.array(F.lit("0"), F.lit("1"))).alias("text"))).select("page", "para_no")


@query("""WITH t AS (SELECT c_custkey AS id, 'A' || c_custkey AS number, c_custkey % 3 AS dispute, 'f' || c_custkey AS folder FROM customer), s AS (SELECT o_orderkey AS source_id, 'A' || (CASE WHEN o_orderkey % 5 = 4 THEN -o_orderkey ELSE o_custkey END) AS number, CASE WHEN o_orderkey % 5 < 2 THEN o_custkey % 3 ELSE 9 END AS dispute, CASE WHEN o_orderkey % 5 IN (1, 2) THEN 'f' || o_custkey ELSE 'new' END AS folder FROM orders)
 SELECT source_id, COALESCE(k.id, f.id) AS target_id, CASE WHEN k.id IS NOT NULL THEN 'key' WHEN f.id IS NOT NULL THEN 'folder' WHEN n.number IS NOT NULL THEN 'collision' ELSE 'insert' END AS via FROM s LEFT JOIN t k ON s.number = k.number AND s.dispute = k.dispute LEFT JOIN t f ON s.folder = f.folder LEFT JOIN (SELECT DISTINCT number FROM t) n ON s.number = n.number""")
def upsert_by_key_or_folder(spark, d):
    c = F.col("c_custkey")
    t = read(spark, d, "customer").select(c.alias("id"), F.concat(F.lit("A"), c.cast("string")).alias("number"), (c % 3).alias("dispute"), F.concat(F.lit("f"), c.cast("string")).alias("folder"))
    k, u = F.col("o_orderkey"), F.col("o_custkey")
    s = read(spark, d, "orders").select(k.alias("source_id"), F.concat(F.lit("A"), F.when(k % 5 == 4, -k).otherwise(u).cast("string")).alias("number"), F.when(k % 5 < 2, u % 3).otherwise(9).alias("dispute"), F.when((k % 5).isin(1, 2), F.concat(F.lit("f"), u.cast("string"))).otherwise("new").alias("folder"))
    return reconcile.keyed_upsert(t, s)


@query("""SELECT a.slug, a.i AS by_tax_id, b.i AS by_slug FROM (SELECT c_nationkey || '-' || (c_custkey % 97) AS slug, MIN(c_custkey) AS i FROM customer WHERE c_acctbal >= 0 GROUP BY 1) a JOIN (SELECT c_nationkey || '-' || (c_custkey % 97) AS slug, MIN(c_custkey) AS i FROM customer WHERE c_acctbal < 0 GROUP BY 1) b ON a.slug = b.slug""")
def shadow_parties(spark, d):
    c = F.col("c_custkey")
    return reconcile.shadow_duplicates(read(spark, d, "customer").select(c.alias("party_id"), F.when(F.col("c_acctbal") >= 0, c).alias("tax_id"), F.concat_ws("-", "c_nationkey", (c % 97).cast("string")).alias("slug")))


@query("""WITH u AS (SELECT l_orderkey AS k, COUNT(*) AS n, SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS t FROM lineitem WHERE l_orderkey % 11 <> 0 GROUP BY 1), s AS (SELECT l_orderkey AS k, COUNT(*) + (CASE WHEN l_orderkey % 5 = 0 THEN 1 ELSE 0 END) AS n, SUM(CAST(l_extendedprice AS DECIMAL(18,2))) + (CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE 0 END) AS t FROM lineitem WHERE l_orderkey % 13 <> 0 GROUP BY 1)
 SELECT COALESCE(u.k, s.k) AS k, COALESCE(u.n, 0) AS n_units, CAST(u.t AS DOUBLE) AS sum_units, CASE WHEN s.k IS NULL THEN 'orphan' WHEN u.k IS NULL THEN 'empty' WHEN u.n <> s.n THEN 'count' WHEN u.t <> s.t THEN 'total' ELSE 'complete' END AS state FROM u FULL JOIN s ON u.k = s.k""")
def packages_complete(spark, d):
    """Orders as packages of their lines; some state one line too many, or a wrong total, and either side lacks some."""
    li = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"))
    stated = li.where("k % 13 <> 0").groupBy("k").agg((F.count("*") + F.when(F.col("k") % 5 == 0, 1).otherwise(0)).alias("n"), (F.sum("amount") + F.when(F.col("k") % 3 == 0, 1).otherwise(0)).alias("total"))
    return reconcile.completeness(li.where("k % 11 <> 0"), stated, "k")


@query("SELECT p_type, COUNT(*) AS n FROM part GROUP BY 1")
def catalog_counts(spark, d):
    return reconcile.catalog_summary(read(spark, d, "part"), "p_type")
