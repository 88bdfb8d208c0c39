"""Every query with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions import scalars as S
from ledgerlens.operators import debt, payments, reconcile, register, rules, statement, text, triage
from ledgerlens.sources import html as html_source

from . import adapters as A
from .adapters import ACCRUALS_SQL, ANCHOR, REGISTER_SQL, STATEMENT_SQL, read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _anchor():
    return F.lit(ANCHOR).cast("date")

_M = lambda x: f"CAST(COALESCE(SUM(CAST({x} AS DECIMAL(18,2))), 0) AS DOUBLE)"
_BOUNDS = "DATE '1997-12-01' b1, DATE '1997-07-01' b6, DATE '1997-01-01' b12, DATE '1995-01-01' b36"
_BAND = f"""WITH p AS (SELECT o_orderkey row_no, CAST(o_orderdate AS DATE) d, o_totalprice amount, {_BOUNDS} FROM orders),
 c AS (SELECT *, CASE WHEN d >= DATE '{ANCHOR}' THEN 'after' WHEN d >= b1 THEN '1m' WHEN d >= b6 THEN '6m' WHEN d >= b12 THEN '1y' WHEN d >= b36 THEN '3y' ELSE 'outside' END band FROM p),
 b AS (SELECT band, CASE band WHEN 'after' THEN 0 WHEN '1m' THEN 1 WHEN '6m' THEN 2 WHEN '1y' THEN 3 WHEN '3y' THEN 4 ELSE 5 END AS depth, COUNT(*) n, SUM(CAST(amount AS DECIMAL(18,2))) t FROM c GROUP BY 1, 2) """


# --- payments

@query(_BAND + """SELECT band, CASE band WHEN 'after' THEN '61.3-2/61.2' WHEN '1m' THEN '61.3-2' WHEN '6m' THEN '61.3-3' WHEN '1y' THEN '61.2-1' WHEN '3y' THEN '61.2-2' ELSE '10/168' END article,
 CAST(depth AS INT) AS depth, n, CAST(t AS DOUBLE) AS total FROM b""")
def pay_bands(spark, d):
    return payments.by_band(payments.classify(A.payments(spark, d), _anchor()), [])


@query(_BAND + """SELECT CAST(SUM(b.n) AS BIGINT) n, CAST(SUM(b.t) AS DOUBLE) total, k.period FROM (VALUES (1, '1m'), (2, '6m'), (3, '1y'), (4, '3y')) k(w, period)
 JOIN b ON b.depth <= k.w GROUP BY k.period""")
def pay_cumulative(spark, d):
    return payments.cumulative(payments.by_band(payments.classify(A.payments(spark, d), _anchor()), []), [])


@query(f"""SELECT o_orderkey AS row_no, o_custkey AS party, CAST(o_orderdate AS DATE) AS date, o_totalprice AS amount, k.bound, k.bd AS bound_date,
 CAST(ABS(date_diff('day', k.bd, CAST(o_orderdate AS DATE))) AS INT) AS days FROM orders,
 (VALUES ('1m', DATE '1997-12-01'), ('6m', DATE '1997-07-01'), ('1y', DATE '1997-01-01'), ('3y', DATE '1995-01-01')) k(bound, bd)
 WHERE ABS(date_diff('day', k.bd, CAST(o_orderdate AS DATE))) <= 5""")
def pay_near_border(spark, d):
    return payments.near_border(A.payments(spark, d), _anchor())


@query(_BAND + "SELECT CAST(SUM(n) AS BIGINT) n, CAST(SUM(t) AS DOUBLE) total FROM b WHERE band IN ('after', '1m')")
def pay_easiest(spark, d):
    return payments.easiest(payments.by_band(payments.classify(A.payments(spark, d), _anchor()), []), [])


@query("""SELECT CAST(c_nationkey AS VARCHAR) AS inn, COUNT(DISTINCT c_mktsegment) AS n_names, array_to_string(list_sort(list(DISTINCT c_mktsegment)), '|') AS names
 FROM customer GROUP BY 1 HAVING COUNT(DISTINCT c_mktsegment) > 1""")
def pay_id_name_mismatch(spark, d):
    c = read(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("inn"), F.col("c_mktsegment").alias("party"))
    return payments.names_by_id(c, []).withColumn("names", F.array_join("names", "|"))


# --- statement

@query(f"SELECT account, COUNT(*) AS operations, {_M('credit')} AS credit_total, {_M('debit')} AS debit_total, MIN(date) AS period_from, MAX(date) AS period_to, 0.0::DOUBLE AS coverage FROM ({STATEMENT_SQL}) GROUP BY account")
def stmt_turnover(spark, d):
    return statement.turnover(A.statement(spark, d).withColumn("balance", F.lit(None).cast("double")), ["account"])


@query(f"""SELECT account, party, debit_total, operations, first_row, CAST(rank AS INT) AS rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY account ORDER BY debit_total DESC, first_row) rank FROM
 (SELECT account, party, {_M('debit')} debit_total, COUNT(*) operations, MIN(row_no) first_row FROM ({STATEMENT_SQL}) WHERE debit <> 0 GROUP BY 1, 2)) WHERE rank <= 10""")
def stmt_top_parties(spark, d):
    return statement.top_parties(A.statement(spark, d), ["account"])


_BALANCE = f"""WITH o AS ({STATEMENT_SQL}), b AS (SELECT *, COALESCE(credit, 0) - COALESCE(debit, 0) AS move,
 CAST(SUM(CAST(COALESCE(credit, 0) - COALESCE(debit, 0) AS DECIMAL(18,2)) + CASE WHEN row_no % 997 = 0 THEN 100000 ELSE 0 END) OVER (PARTITION BY account ORDER BY row_no) AS DOUBLE) AS balance FROM o) """


@query(_BALANCE + """SELECT account, prev_row, row_no, ROUND(prev + move, 2) AS expected, balance, ROUND(balance - (prev + move), 2) AS gap FROM
 (SELECT *, LAG(row_no) OVER w AS prev_row, LAG(balance) OVER w AS prev FROM b WINDOW w AS (PARTITION BY account ORDER BY row_no))
 WHERE prev_row IS NOT NULL AND ABS(prev + move - balance) > GREATEST(1.0, ABS(balance) * 0.005)""")
def stmt_balance_breaks(spark, d):
    return statement.balance_breaks(A.with_balance(A.statement(spark, d)), ["account"])


@query(_BALANCE + """, s AS (SELECT account, row_no, CASE WHEN account % 4 = 1 AND row_no % 2 = 0 OR account % 4 = 2 AND row_no % 150 > 0 THEN NULL ELSE balance END AS balance, CASE WHEN account % 4 = 3 THEN DATE '2050-01-01' - CAST(row_no // 3 AS INT) ELSE date END AS date FROM b),
 f AS (SELECT *, LAG(date) OVER (PARTITION BY account ORDER BY row_no) AS before FROM s) SELECT account, ROUND(COUNT(balance) / COUNT(*), 3) AS coverage,
 CASE WHEN COUNT(balance) < 3 THEN 'few-balances' WHEN COUNT(balance) / COUNT(*) < 0.95 THEN 'low-coverage' WHEN COUNT(date) >= 3 AND bool_and(before IS NULL OR date <= before) THEN 'descending' END AS skipped_reason FROM f GROUP BY account""")
def stmt_balance_state(spark, d):
    """Accounts by turns: whole, with every second balance missing, with next to none, with falling dates."""
    a, r = F.col("account") % 4, F.col("row_no")
    ops = A.with_balance(A.statement(spark, d)).withColumn("balance", F.when(~(((a == 1) & (r % 2 == 0)) | ((a == 2) & (r % 150 > 0))), F.col("balance")))
    return statement.balance_state(ops.withColumn("date", F.when(a == 3, F.date_sub(F.lit("2050-01-01").cast("date"), F.floor(r / 3).cast("int"))).otherwise(F.col("date"))), ["account"])


_DUP = "SELECT o_custkey % 100 AS account, o_orderkey AS row_no, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, CAST(NULL AS DOUBLE) AS credit, FLOOR(o_totalprice / 20000) * 20000 AS debit, 'c' || o_custkey AS party FROM orders"


def _orders_rounded(spark, d):
    o = read(spark, d, "orders")
    return o.select((F.col("o_custkey") % 100).alias("account"), F.col("o_orderkey").alias("row_no"), F.trunc(F.col("o_orderdate").cast("date"), "month").alias("date"), F.lit(None).cast("double").alias("credit"), (F.floor(F.col("o_totalprice") / 20000) * 20000).cast("double").alias("debit"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("party"))


_SPLIT = f"""WITH RECURSIVE o AS ({STATEMENT_SQL}), t AS (SELECT account, party, date AS d, COUNT(*) AS n, SUM(CAST(debit AS DECIMAL(18,2))) AS t FROM o WHERE debit <> 0 GROUP BY 1, 2, 3),
 p AS (SELECT a.account, a.party, a.d, SUM(b.n) AS n, SUM(b.t) AS t, MAX(b.d) AS last FROM t a JOIN t b ON a.account = b.account AND a.party = b.party AND b.d BETWEEN a.d AND a.d + 2 GROUP BY 1, 2, 3),
 q AS (SELECT p.*, (CASE WHEN n >= 3 THEN (SELECT MIN(x.d) FROM t x WHERE x.account = p.account AND x.party = p.party AND x.d > p.d + 2) ELSE (SELECT MIN(x.d) FROM t x WHERE x.account = p.account AND x.party = p.party AND x.d > p.d) END) AS next FROM p),
 w AS (SELECT account, party, MIN(d) AS d FROM t GROUP BY 1, 2 UNION ALL SELECT w.account, w.party, q.next FROM w JOIN q ON w.account = q.account AND w.party = q.party AND w.d = q.d WHERE q.next IS NOT NULL)
 SELECT q.account, q.party, q.d AS date_from, q.last AS date_to, CAST(q.n AS BIGINT) AS n, CAST(q.t AS DOUBLE) AS total FROM w JOIN q ON w.account = q.account AND w.party = q.party AND w.d = q.d WHERE q.n >= 3"""


@query(_SPLIT)
def stmt_splitting(spark, d):
    return statement.split_groups(A.statement(spark, d), ["account"])


@query(f"""WITH g AS ({_SPLIT.replace(STATEMENT_SQL, _DUP)}), r AS (SELECT *, MIN(row_no) OVER (PARTITION BY account, date, debit, credit, party) AS first_row FROM ({_DUP}))
 SELECT r.account, r.date, debit, credit, r.party, first_row, row_no, debit <> 0 AND date_from IS NOT NULL AS suppressed FROM r LEFT JOIN g ON r.account = g.account AND r.party = g.party AND r.date BETWEEN date_from AND date_to WHERE first_row <> row_no""")
def stmt_duplicates(spark, d):
    ops = _orders_rounded(spark, d)
    return statement.duplicates(ops, ["account"], statement.in_split(ops, statement.split_groups(ops, ["account"]), ["account"]))


@query("""SELECT account, prev_row, row_no, prev_date, date, CAST(date_diff('day', prev_date, date) AS INT) AS days FROM (SELECT o_custkey AS account, o_orderkey AS row_no, CAST(o_orderdate AS DATE) AS date,
 LAG(CAST(o_orderdate AS DATE)) OVER w AS prev_date, LAG(o_orderkey) OVER w AS prev_row FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey)) WHERE date_diff('day', prev_date, date) >= 31""")
def stmt_date_gaps(spark, d):
    p = A.payments(spark, d).withColumnRenamed("party", "account")
    return statement.date_gaps(p, ["account"])


# --- debt

_FACTS = f"""WITH r AS ({ACCRUALS_SQL}), f AS (SELECT sheet, COUNT(*) AS key_rows, arg_min(date_from, row_no) AS anchor FROM r GROUP BY 1),
 x AS (SELECT r.*, f.key_rows, CAST(dayofyear(make_date(year(f.anchor), 12, 31)) AS DOUBLE) AS ad, CAST(dayofyear(make_date(year(r.date_from), 12, 31)) AS DOUBLE) AS yd, r.base * (r.rate / 100.0::DOUBLE) * r.days AS s FROM r JOIN f USING (sheet)),
 m AS (SELECT x.*, k.ord, k.model, CASE k.ord WHEN 0 THEN s / yd WHEN 1 THEN s / ad WHEN 2 THEN s / 365.0::DOUBLE WHEN 3 THEN s / 366.0::DOUBLE WHEN 4 THEN s / 300.0::DOUBLE WHEN 5 THEN s ELSE base * rate * days END AS expected
   FROM x, (VALUES (0, 'annual/by-row'), (1, 'annual/actual'), (2, 'annual/365'), (3, 'annual/366'), (4, 'annual/300'), (5, 'daily-percent'), (6, 'daily-fraction')) k(ord, model)),
 sc AS (SELECT sheet, ord, model, COUNT(*) FILTER (ABS(expected - amount) <= GREATEST(1.0, ABS(amount) * 0.005::DOUBLE)) AS matched, MAX(key_rows) AS total FROM m GROUP BY 1, 2, 3),
 ch AS (SELECT *, matched >= GREATEST(1, FLOOR(total * 0.6)) AND total >= 2 AS accepted FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY sheet ORDER BY matched DESC, ord) AS k FROM sc) WHERE k = 1) """


def _scaled(spark, d):
    return debt.scaled_rates(A.accruals(spark, d), ["sheet"])


@query(_FACTS + "SELECT sheet, model, matched, total, accepted FROM ch")
def debt_model_choice(spark, d):
    return debt.choose_model(debt.model_scores(_scaled(spark, d), ["sheet"]), ["sheet"])


@query(_FACTS + """SELECT m.sheet, m.row_no, m.model, m.amount, (FLOOR((m.expected) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE) AS expected, (FLOOR((m.amount - m.expected) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE) AS delta FROM m JOIN ch ON m.sheet = ch.sheet AND m.model = ch.model
 WHERE ch.accepted AND NOT ABS(m.expected - m.amount) <= GREATEST(1.0, ABS(m.amount) * 0.005::DOUBLE)""")
def debt_row_check(spark, d):
    rows = _scaled(spark, d)
    return debt.row_errors(rows, debt.choose_model(debt.model_scores(rows, ["sheet"]), ["sheet"]), ["sheet"])


@query(f"""SELECT sheet, COUNT(*) FILTER (n = i) AS inclusive, COUNT(*) FILTER (n = i - 1) AS exclusive, COUNT(*) FILTER (n <> i AND n <> i - 1) AS other,
 CASE WHEN COUNT(*) FILTER (n = i) = 0 AND COUNT(*) FILTER (n = i - 1) = 0 THEN NULL WHEN COUNT(*) FILTER (n = i) >= COUNT(*) FILTER (n = i - 1) THEN 'inclusive' ELSE 'exclusive' END AS convention
 FROM (SELECT sheet, CAST(days AS INT) AS n, date_diff('day', date_from, date_to) + 1 AS i FROM ({ACCRUALS_SQL})) GROUP BY 1""")
def debt_day_convention(spark, d):
    return debt.day_convention(A.accruals(spark, d), ["sheet"])


@query(f"""SELECT sheet, row_no, n AS stated, CAST(i AS INT) AS expected, CAST(i AS INT) AS by_dates, 'inclusive' AS convention
 FROM (SELECT sheet, row_no, CAST(days AS INT) AS n, date_diff('day', date_from, date_to) + 1 AS i FROM ({ACCRUALS_SQL})) WHERE n <> i""")
def debt_day_errors(spark, d):
    rows = A.accruals(spark, d)
    return debt.day_errors(rows, debt.day_convention(rows, ["sheet"]), ["sheet"])


_PERIODS = f"""SELECT part, prev_row, row_no, CASE WHEN apart <= 0 THEN 'overlap' ELSE 'gap' END AS kind, CAST(CASE WHEN apart <= 0 THEN 1 - apart ELSE apart - 1 END AS INT) AS days FROM
 (SELECT *, date_diff('day', prev_to, date_from) AS apart FROM (SELECT part, row_no, date_from, <cols> FROM ({ACCRUALS_SQL}) WINDOW w AS (PARTITION BY part ORDER BY date_from, row_no <frame>))) WHERE apart <= 0 OR apart > 1"""


@query(_PERIODS.replace("<cols>", "LAG(row_no) OVER w AS prev_row, LAG(date_to) OVER w AS prev_to").replace("<frame>", ""))
def debt_period_overlap(spark, d):
    return debt.periods(A.accruals(spark, d), ["part"])


@query(_PERIODS.replace("<cols>", "(MAX(struct_pack(a := date_to, b := row_no)) OVER w).b AS prev_row, MAX(date_to) OVER w AS prev_to").replace("<frame>", "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"))
def debt_period_overlap_runmax(spark, d):
    return debt.periods(A.accruals(spark, d), ["part"], running=True)


@query("""SELECT o_orderkey AS sheet, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS rows_sum, MAX(o_totalprice) AS stated, CAST(0 AS INT) AS stated_row, CAST(1 AS BIGINT) AS n_totals,
 ROUND(MAX(o_totalprice) - CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE), 2) AS delta FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def debt_totals(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("sheet"), F.col("l_extendedprice").alias("amount"))
    stated = read(spark, d, "orders").select(F.col("o_orderkey").alias("sheet"), F.lit(0).alias("row_no"), F.col("o_totalprice").alias("amount"))
    return debt.totals(rows, stated, ["sheet"]).where("stated is not null")


@query(f"SELECT sheet, array_to_string(list_transform(list_sort(list(DISTINCT rate)), lambda x: CAST(CAST(x AS INT) AS VARCHAR)), ',') AS rates FROM ({ACCRUALS_SQL}) GROUP BY 1")
def debt_rates(spark, d):
    r = A.accruals(spark, d).groupBy("sheet").agg(F.array_sort(F.collect_set("rate")).alias("r"))
    return r.select("sheet", F.array_join(F.transform("r", lambda x: x.cast("int").cast("string")), ",").alias("rates"))


_RATES = [("1990-01-01", "1996-06-30", 10.0), ("1996-07-01", "1998-12-31", 12.5), ("1999-01-01", "2000-03-31", 9.0), ("2000-04-01", "2030-12-31", 7.5)]
_RATE_ROWS = ", ".join(f"(DATE '{a}', DATE '{b}', {r}::DOUBLE)" for a, b, r in _RATES)


@query(f"""SELECT row_no, rate_part AS rate, part_from, part_to, CAST(date_diff('day', part_from, part_to) + 1 AS INT) AS days,
 (FLOOR((base * (rate_part / 100.0::DOUBLE) * (date_diff('day', part_from, part_to) + 1) / CAST(dayofyear(make_date(year(part_from), 12, 31)) AS DOUBLE)) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE) AS amount FROM
 (SELECT i.row_no, i.base, r.rate AS rate_part, GREATEST(i.date_from, r.f) AS part_from, LEAST(i.date_to, r.t) AS part_to FROM ({ACCRUALS_SQL}) i JOIN (VALUES {_RATE_ROWS}) r(f, t, rate) ON i.date_from <= r.t AND i.date_to >= r.f)""")
def rate_split_accrual(spark, d):
    rates = spark.createDataFrame(_RATES, "f string, t string, rate double").select(F.col("f").cast("date").alias("valid_from"), F.col("t").cast("date").alias("valid_to"), "rate")
    parts = debt.split_by_rates(A.accruals(spark, d).drop("rate", "days", "amount"), rates)
    days = F.datediff("part_to", "part_from") + 1
    return parts.select("row_no", "rate", "part_from", "part_to", days.alias("days"), S.cents(F.col("base") * (F.col("rate") / 100.0) * days / S.days_in_year("part_from").cast("double")).alias("amount"))


# --- register

def _creditors(spark, d):
    return A.register(spark, d).withColumn("queue", S.parse_queue("queue_cell", F.lit("")))


@query(f"SELECT sheet, queue, COUNT(*) AS n, {_M('amount')} AS total, {_M('penalty')} AS penalty FROM ({REGISTER_SQL}) GROUP BY 1, 2")
def reg_queue_totals(spark, d):
    return register.queue_totals(_creditors(spark, d), ["sheet"])


@query(f"""WITH r AS ({REGISTER_SQL}), t AS (SELECT sheet, SUM(CAST(amount AS DECIMAL(18,2))) FILTER (queue = 'трет') t, SUM(CAST(penalty AS DECIMAL(18,2))) FILTER (queue = 'трет') tp,
 SUM(CAST(amount AS DECIMAL(18,2))) FILTER (contains(lower(party), '00001')) o, SUM(CAST(penalty AS DECIMAL(18,2))) FILTER (contains(lower(party), '00001')) op, COUNT(*) FILTER (contains(lower(party), '00001')) n FROM r GROUP BY 1)
 SELECT sheet, n AS our_rows, CAST(o AS DOUBLE) AS our_total, CAST(t - tp AS DOUBLE) AS voting_base, CAST(o - op AS DOUBLE) AS our_voting_amount, CAST(NULL AS VARCHAR) AS reason, ROUND(CAST(o - op AS DOUBLE) / CAST(t - tp AS DOUBLE) * 100, 2) AS share_percent FROM t""")
def reg_voting_share(spark, d):
    return register.voting_share(_creditors(spark, d), ["sheet"], F.lower("party").contains("00001"))


@query(f"SELECT sheet, inn, COUNT(*) AS n, {_M('amount')} AS total, MIN(row_no) AS first_row FROM ({REGISTER_SQL}) GROUP BY 1, 2 HAVING COUNT(*) > 1")
def reg_duplicates(spark, d):
    return register.repeated(_creditors(spark, d), ["sheet"])


# --- scalars

_NUM = """CASE o_orderkey % 6 WHEN 0 THEN k || ',' || f || ' руб.' WHEN 1 THEN k || '.' || f WHEN 2 THEN '(' || k || ',' || f || ')' WHEN 3 THEN '−' || k WHEN 4 THEN k || ' %' ELSE 'abc ' || k END"""


@query("""SELECT row_no, txt, CASE row_no % 6 WHEN 0 THEN CAST(k || '.' || f AS DOUBLE) WHEN 1 THEN CAST(k || '.' || f AS DOUBLE) WHEN 2 THEN -CAST(k || '.' || f AS DOUBLE) WHEN 3 THEN -CAST(k AS DOUBLE) WHEN 4 THEN CAST(k AS DOUBLE) END AS value
 FROM (SELECT *, CASE row_no % 6 WHEN 0 THEN k || ',' || f || ' руб.' WHEN 1 THEN k || '.' || f WHEN 2 THEN '(' || k || ',' || f || ')' WHEN 3 THEN '−' || k WHEN 4 THEN k || ' %' ELSE 'abc ' || k END AS txt
 FROM (SELECT o_orderkey AS row_no, CAST(CAST(FLOOR(o_totalprice) AS BIGINT) AS VARCHAR) AS k, printf('%02d', o_orderkey % 100) AS f FROM orders))""")
def num_parse(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("row_no"), F.floor("o_totalprice").cast("string").alias("k"), F.format_string("%02d", F.col("o_orderkey") % 100).alias("f"))
    k, f, m = F.col("k"), F.col("f"), F.col("row_no") % 6
    txt = F.when(m == 0, F.concat(k, F.lit(","), f, F.lit(" руб."))).when(m == 1, F.concat(k, F.lit("."), f)).when(m == 2, F.concat(F.lit("("), k, F.lit(","), f, F.lit(")"))).when(m == 3, F.concat(F.lit("−"), k)).when(m == 4, F.concat(k, F.lit(" %"))).otherwise(F.concat(F.lit("abc "), k))
    return o.withColumn("txt", txt).select("row_no", "txt", S.parse_number("txt").alias("value"))


@query("""SELECT o_orderkey AS row_no, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS value FROM orders""")
def date_parse(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("row_no"), F.col("o_orderdate").cast("date").alias("d"))
    names = F.array(*[F.lit(x) for x in ("января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря")])
    txt = F.when(F.col("row_no") % 4 == 0, F.date_format("d", "yyyy/MM/dd")).when(F.col("row_no") % 4 == 1, F.date_format("d", "d.MM.yyyy")).when(F.col("row_no") % 4 == 2, F.concat(F.dayofmonth("d").cast("string"), F.lit(" "), F.element_at(names, F.month("d")), F.lit(" "), F.year("d").cast("string"), F.lit(" г."))).otherwise("30.02.2026")
    return o.withColumn("txt", txt).select("row_no", S.parse_date("txt").alias("value"))


@query("""SELECT doc_id, COUNT(*) AS lines, COUNT(*) FILTER (regexp_matches(lower(line), '(итого|всего|total|the of)')) AS hits FROM
 (SELECT doc_id, UNNEST(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id""")
def total_row_filter(spark, d):
    lines = read(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    hit = S.is_total_row("line", "register") | F.lower("line").rlike("(total|the of)")
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(hit).alias("hits"))


# --- texts

_DIAG = """SELECT doc_id, LENGTH(text) AS n_chars, nw AS n_words, ROUND(CAST(LENGTH(text) - LENGTH(replace(text, '�', '')) AS DOUBLE) / GREATEST(LENGTH(text), 1), 6) AS bad_ratio,
 ROUND(CAST(LENGTH(text) - LENGTH(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')) AS DOUBLE) / GREATEST(LENGTH(text), 1), 6) AS control_ratio, lt AS letters,
 ROUND(CAST(LENGTH(text) - LENGTH(regexp_replace(text, '[А-Яа-яЁё]', '', 'g')) AS DOUBLE) / GREATEST(lt, 1), 6) AS cyrillic_ratio,
 ROUND(CAST(LENGTH(regexp_replace(text, '[ \\t\\n\\r]', '', 'g')) AS DOUBLE) / GREATEST(nw, 1), 6) AS avg_token FROM
 (SELECT doc_id, text, LENGTH(text) - LENGTH(regexp_replace(text, '[A-Za-zА-Яа-яЁёÀ-ÖØ-öø-ÿ]', '', 'g')) AS lt, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> '')) AS nw FROM documents)"""


@query(_DIAG)
def text_quality(spark, d):
    t = read(spark, d, "documents")
    return t.select("doc_id", *[c.alias(k) for k, c in S.text_diagnostics("text").items()])


@query(f"SELECT doc_id, bad_ratio > 0.02 OR control_ratio > 0.05 OR (n_chars > 200 AND avg_token < 2) AS garbage, bad_ratio > 0.02 OR control_ratio > 0.05 OR (n_chars > 200 AND avg_token < 2) OR (letters >= 30 AND cyrillic_ratio < 0.15) AS garbage_cyrillic FROM ({_DIAG})")
def text_garbage(spark, d):
    g = S.text_diagnostics("text")
    q = read(spark, d, "documents").select("doc_id", *[c.alias(k) for k, c in g.items()])
    c = {k: F.col(k) for k in g}
    return q.select("doc_id", S.is_garbage(c, False).alias("garbage"), S.is_garbage(c, True).alias("garbage_cyrillic"))


@query("SELECT 'sha256:' || sha256(text) AS key, COUNT(*) AS n, MIN(doc_id) AS first_id, MAX(doc_id) AS last_id FROM documents GROUP BY text HAVING COUNT(*) > 1")
def doc_hash_dups(spark, d):
    return reconcile.duplicate_groups(read(spark, d, "documents"), S.content_hash(F.encode("text", "utf-8")), "doc_id")


@query("""SELECT sha256(trim(regexp_replace(lower(text), '[ \\t\\n\\v\\f\\r]+', ' ', 'g'))) AS key, COUNT(*) AS n, MIN(doc_id) AS first_id, MAX(doc_id) AS last_id FROM documents GROUP BY 1 HAVING COUNT(*) > 1""")
def doc_soft_dups(spark, d):
    return reconcile.duplicate_groups(read(spark, d, "documents"), S.soft_key("text"), "doc_id")


@query("""SELECT page_id, UNNEST(list_distinct(regexp_extract_all(html, 'href="([^"]+)"', 1))) AS href FROM pages""")
def links_extract(spark, d):
    return read(spark, d, "pages").select("page_id", F.explode(text.hrefs(F.col("html"))).alias("href"))


@query()
def html_body(spark, d):
    return html_source.extract_body(read(spark, d, "pages"), "page_id", "html")


@query("""WITH a AS (SELECT conv_id, turn, role, CASE WHEN role IS DISTINCT FROM LAG(role) OVER w OR LAG(turn) OVER w IS NULL THEN 1 ELSE 0 END AS nw FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
 b AS (SELECT *, CAST(SUM(nw) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS run FROM a) SELECT conv_id, run, role, MIN(turn) AS first, MAX(turn) AS last, COUNT(*) AS n FROM b GROUP BY conv_id, run, role""")
def speaker_turn_runs(spark, d):
    return text.runs(read(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id"], "turn", "role")


@query("SELECT role, COUNT(*) AS n FROM (SELECT DISTINCT role, conv_id, turn FROM conversations) GROUP BY role")
def event_counters(spark, d):
    return reconcile.event_counters(read(spark, d, "conversations"), ["role"], ["conv_id", "turn"])


@query("""SELECT g, MIN(doc_id) AS first, MAX(doc_id) AS last FROM (SELECT doc_id, source AS g, doc_id - ROW_NUMBER() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents) GROUP BY g, i""")
def consecutive_ranges(spark, d):
    return text.fold_ranges(read(spark, d, "documents").select(F.col("source").alias("g"), F.col("doc_id").alias("n")), ["g"])


@query("""WITH p AS (SELECT user_id, event_id AS id, CAST(FLOOR(epoch(ts)) AS BIGINT) AS at FROM events WHERE event_type <> 'error'), m AS (SELECT user_id, CAST(FLOOR(epoch(ts)) AS BIGINT) AS at FROM events WHERE event_type = 'error')
 SELECT p.user_id, p.id, p.at, (SELECT MAX(m.at) FROM m WHERE m.user_id = p.user_id AND m.at <= p.at AND p.at - m.at <= 86400) AS mark_at FROM p""")
def nearest_mention(spark, d):
    e = read(spark, d, "events").select("user_id", F.col("event_id").alias("id"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("long").alias("at"), "event_type")
    return text.nearest_before(e.where("event_type <> 'error'"), e.where("event_type = 'error'"), ["user_id"], 86400)


# --- registries

@query("""SELECT COALESCE(d.k, l.k) AS k, d.v AS disk_value, l.v AS index_value, CASE WHEN l.k IS NULL THEN 'new' WHEN d.k IS NULL THEN 'orphan' WHEN d.v IS DISTINCT FROM l.v THEN 'stale' ELSE 'same' END AS state
 FROM (SELECT doc_id AS k, sha256(text) AS v FROM documents WHERE doc_id % 7 <> 0) d FULL JOIN (SELECT doc_id AS k, CASE WHEN doc_id % 11 = 0 THEN 'old' ELSE sha256(text) END AS v FROM documents WHERE doc_id % 5 <> 0) l ON d.k = l.k""")
def reconcile_full_outer(spark, d):
    return reconcile.reconcile(*_registries(spark, d), "k", "v")


def _registries(spark, d):
    t = read(spark, d, "documents").select(F.col("doc_id").alias("k"), F.sha2("text", 256).alias("v"))
    return t.where("k % 7 <> 0"), t.where("k % 5 <> 0").withColumn("v", F.when(F.col("k") % 11 == 0, "old").otherwise(F.col("v")))


@query("""WITH t AS (SELECT doc_id AS k, sha256(text) AS v FROM documents), i AS (SELECT doc_id AS k, CASE WHEN doc_id % 11 = 0 THEN 'old' ELSE sha256(text) END AS v FROM documents WHERE doc_id % 5 <> 0), n AS (SELECT v, MIN(k) AS nk, COUNT(*) AS c FROM t WHERE k % 7 <> 0 AND k % 5 = 0 GROUP BY v),
 o AS (SELECT v, MIN(k) AS ok, COUNT(*) AS c FROM i WHERE k % 7 = 0 GROUP BY v) SELECT v AS value, ok AS old_key, nk AS new_key FROM n JOIN o USING (v) WHERE n.c = 1 AND o.c = 1""")
def rename_link(spark, d):
    return reconcile.renames(reconcile.reconcile(*_registries(spark, d), "k", "v"), "k")


@query("SELECT k, disk_value, index_value FROM (SELECT d.k, d.v AS disk_value, l.v AS index_value FROM (SELECT doc_id AS k, sha256(text) AS v FROM documents WHERE doc_id % 7 <> 0) d JOIN (SELECT doc_id AS k, CASE WHEN doc_id % 11 = 0 THEN 'old' ELSE sha256(text) END AS v FROM documents WHERE doc_id % 5 <> 0) l ON d.k = l.k) WHERE disk_value <> index_value")
def stale_mirrors(spark, d):
    return reconcile.reconcile(*_registries(spark, d), "k", "v").where("state = 'stale'").drop("state")


_LATEST = "SELECT o_custkey, o_orderkey, CAST(rn AS INT) AS rn FROM (SELECT o_custkey, o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn <= %d"


@query(_LATEST % 1)
def latest_snapshot(spark, d):
    return reconcile.latest(read(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "rn")


@query(_LATEST % 5)
def keep_five(spark, d):
    return reconcile.latest(read(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 5).select("o_custkey", "o_orderkey", "rn")


@query("""SELECT COALESCE(t.k, s.k) AS k, COALESCE(s.nation, t.nation) AS nation, COALESCE(t.bal, s.bal) AS bal, CASE WHEN t.k IS NULL THEN 'insert' WHEN s.k IS NULL THEN 'keep' ELSE 'update' END AS action, COALESCE(s.nation <> t.nation, FALSE) AS conflict
 FROM (SELECT c_custkey AS k, c_nationkey AS nation, c_acctbal AS bal FROM customer) t FULL JOIN (SELECT s_suppkey * 40 AS k, s_nationkey AS nation, s_acctbal AS bal FROM supplier) s ON t.k = s.k""")
def upsert_priority(spark, d):
    t = read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("bal"))
    s = read(spark, d, "supplier").select((F.col("s_suppkey") * 40).alias("k"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("bal"))
    return reconcile.upsert(t, s, "k", ["nation", "bal"], ("bal",))


@query("""SELECT p_partkey, printf('%02d', DENSE_RANK() OVER (PARTITION BY p_type ORDER BY p_brand)) || '.' || printf('%02d', kk) AS label
 FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY p_type, p_brand ORDER BY p_size, p_partkey) AS kk FROM part)""")
def catalog_numbers(spark, d):
    return reconcile.catalog_order(read(spark, d, "part"), "p_type", "p_brand", ["p_size", "p_partkey"]).select("p_partkey", "label")


@query("""SELECT s.s_suppkey, COALESCE(a.id1, b.id2) AS match_id, CASE WHEN a.id1 IS NOT NULL THEN 'key' WHEN b.id2 IS NOT NULL THEN 'fields' END AS via FROM (SELECT s_suppkey, s_suppkey * 37 AS k, s_nationkey, CAST(FLOOR(s_acctbal / 1000) AS BIGINT) AS th FROM supplier) s
 LEFT JOIN (SELECT c_custkey AS k, MIN(c_custkey) AS id1 FROM customer GROUP BY 1) a ON s.k = a.k
 LEFT JOIN (SELECT c_nationkey AS n, CAST(FLOOR(c_acctbal / 1000) AS BIGINT) AS th, MIN(c_custkey) AS id2 FROM customer GROUP BY 1, 2 HAVING COUNT(*) = 1) b ON s.s_nationkey = b.n AND s.th = b.th""")
def appendix_lookup(spark, d):
    s = read(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") * 37).alias("k"), F.col("s_nationkey").alias("n"), F.floor(F.col("s_acctbal") / 1000).alias("th"))
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("n"), F.floor(F.col("c_acctbal") / 1000).alias("th"))
    return reconcile.second_chance(s, c, "k", ["n", "th"], "id").select("s_suppkey", "match_id", "via")


# --- rules

def _cents(x: str) -> str:
    return f"(FLOOR(({x}) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE)"


#: The tariffs once more, apart from the operator's own tables.
_P = "(o_totalprice * 50)"
_ARB = _cents(f"""LEAST(CASE WHEN {_P} <= 100000 THEN 10000 WHEN {_P} <= 1000000 THEN 10000 + 0.05::DOUBLE * ({_P} - 100000) WHEN {_P} <= 10000000 THEN 55000 + 0.03::DOUBLE * ({_P} - 1000000)
 WHEN {_P} <= 50000000 THEN 325000 + 0.01::DOUBLE * ({_P} - 10000000) ELSE 725000 + 0.005::DOUBLE * ({_P} - 50000000) END, 10000000::DOUBLE)""")
_GEN = _cents(f"""LEAST(CASE WHEN {_P} <= 100000 THEN 4000 WHEN {_P} <= 300000 THEN 4000 + 0.03::DOUBLE * ({_P} - 100000) WHEN {_P} <= 500000 THEN 10000 + 0.025::DOUBLE * ({_P} - 300000)
 WHEN {_P} <= 1000000 THEN 15000 + 0.02::DOUBLE * ({_P} - 500000) WHEN {_P} <= 3000000 THEN 25000 + 0.01::DOUBLE * ({_P} - 1000000) WHEN {_P} <= 8000000 THEN 45000 + 0.007::DOUBLE * ({_P} - 3000000)
 WHEN {_P} <= 24000000 THEN 80000 + 0.0035::DOUBLE * ({_P} - 8000000) WHEN {_P} <= 50000000 THEN 136000 + 0.003::DOUBLE * ({_P} - 24000000) WHEN {_P} <= 100000000 THEN 214000 + 0.002::DOUBLE * ({_P} - 50000000)
 ELSE 314000 + 0.0015::DOUBLE * ({_P} - 100000000) END, 900000::DOUBLE)""")


def _price():
    return F.col("o_totalprice") * 50


@query(f"SELECT o_orderkey, {_ARB} AS fee, GREATEST({_cents(_ARB + " * 0.5::DOUBLE")}, 8000.0::DOUBLE) AS order_fee FROM orders")
def fee_arbitration(spark, d):
    return read(spark, d, "orders").select("o_orderkey", rules.arbitration_fee(_price()).alias("fee"), rules.order_fee(_price()).alias("order_fee"))


@query(f"SELECT o_orderkey, {_GEN} AS fee FROM orders")
def fee_general(spark, d):
    return read(spark, d, "orders").select("o_orderkey", rules.general_fee(_price()).alias("fee"))


@query(f"SELECT o_orderkey, {_cents("GREATEST(0.0::DOUBLE, " + _GEN + " - 25000.0::DOUBLE)")} AS fee FROM orders")
def fee_relief(spark, d):
    return read(spark, d, "orders").select("o_orderkey", rules.relieved_fee(_price()).alias("fee"))


@query("SELECT o_orderkey, " + _cents(f"CASE WHEN o_orderpriority = '1-URGENT' THEN 0.0::DOUBLE ELSE {_ARB} * (CASE o_orderstatus WHEN 'O' THEN 0.7 WHEN 'F' THEN 0.5 ELSE 0.3 END)::DOUBLE END") + " AS refund FROM orders")
def fee_refund(spark, d):
    stage = F.when(F.col("o_orderstatus") == "O", "first").when(F.col("o_orderstatus") == "F", "appeal").otherwise("cassation")
    return read(spark, d, "orders").select("o_orderkey", rules.refund(rules.arbitration_fee(_price()), stage, F.col("o_orderpriority") == "1-URGENT").alias("refund"))


@query("""SELECT o_orderkey, CASE WHEN a <= CASE WHEN m THEN 100000 WHEN court = 'arbitration' THEN 750000 ELSE 500000 END THEN 'order' WHEN a <= CASE WHEN court = 'general' THEN 250000 WHEN debtor = 'entity' THEN 1200000 ELSE 600000 END THEN 'simplified' ELSE 'general' END AS kind
 FROM (SELECT o_orderkey, o_totalprice * 3 AS a, c_mktsegment = 'BUILDING' AS m, CASE WHEN c_nationkey % 2 = 0 THEN 'arbitration' ELSE 'general' END AS court, CASE WHEN c_custkey % 2 = 0 THEN 'entity' ELSE 'entrepreneur' END AS debtor FROM orders JOIN customer ON o_custkey = c_custkey)""")
def proceeding_type(spark, d):
    j = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    court, debtor = F.when(F.col("c_nationkey") % 2 == 0, "arbitration").otherwise("general"), F.when(F.col("c_custkey") % 2 == 0, "entity").otherwise("entrepreneur")
    return j.select("o_orderkey", rules.proceeding(F.col("o_totalprice") * 3, court, debtor, F.col("c_mktsegment") == "BUILDING").alias("kind"))


@query("""SELECT o_orderkey, dl AS deadline, CASE WHEN n < 0 THEN 'missed' WHEN n < 5 THEN 'critical' WHEN n < 15 THEN 'soon' ELSE 'calm' END AS urgency FROM (SELECT o_orderkey, dl, date_diff('day', DATE '1998-06-01', dl) AS n FROM
 (SELECT o_orderkey, CAST(CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + 15 ELSE CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH END AS DATE) AS dl FROM orders))""")
def deadline_urgency(spark, d):
    dl = rules.appeal_deadline(F.col("o_orderdate").cast("date"), F.when(F.col("o_orderstatus") == "F", "ruling").otherwise("decision"))
    return read(spark, d, "orders").select("o_orderkey", dl.alias("deadline"), rules.urgency(dl, F.lit("1998-06-01").cast("date")).alias("urgency"))


@query("""SELECT o_orderkey, CAST(CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH ELSE CAST(o_orderdate AS DATE) + INTERVAL 2 MONTH END AS DATE) AS cassation,
 CAST(CASE WHEN o_orderstatus = 'O' THEN CAST(o_orderdate AS DATE) + 30 ELSE CAST(o_orderdate AS DATE) + INTERVAL 2 MONTH END AS DATE) AS register_close, CAST(CAST(o_orderdate AS DATE) + INTERVAL 36 MONTH AS DATE) AS writ FROM orders""")
def other_deadlines(spark, d):
    o, s = F.col("o_orderdate").cast("date"), F.col("o_orderstatus")
    return read(spark, d, "orders").select("o_orderkey", rules.cassation_deadline(o, F.when(s == "F", "ruling")).alias("cassation"), rules.register_close(o, F.when(s == "O", "observation")).alias("register_close"), rules.writ_deadline(o, F.lit(None).cast("date")).alias("writ"))


# --- ingest

@query("""SELECT k, COUNT(*) AS n FROM (SELECT CASE doc_id % 5 WHEN 0 THEN 'table' WHEN 1 THEN 'pages' WHEN 2 THEN 'image' WHEN 3 THEN 'refused' ELSE 'unknown' END AS k FROM documents) GROUP BY k""")
def file_kinds(spark, d):
    suffix = F.element_at(F.array(*[F.lit(x) for x in ("a/b.XLSX", "c.pdf", "d.jpeg", "e.rtf", "noext")]), (F.col("doc_id") % 5 + 1).cast("int"))
    return read(spark, d, "documents").select(triage.file_kind(suffix).alias("k")).groupBy("k").agg(F.count("*").alias("n"))


_PAGES = """SELECT doc_id, p AS page, CASE WHEN (doc_id + p) % 3 = 0 THEN '' ELSE text END AS text, (doc_id + p) % 2 = 0 AS has_images FROM documents, (SELECT UNNEST(range(1, 41)) AS p)"""


@query(f"""WITH s AS (SELECT doc_id, page, length(trim(text, ' ')) < 40 AND has_images AS need FROM ({_PAGES})), g AS (SELECT doc_id, COUNT(*) AS n_pages, list(page ORDER BY page) FILTER (need) AS need FROM s GROUP BY doc_id)
 SELECT doc_id, n_pages, CAST(COALESCE(len(need), 0) AS INT) AS n_need, CASE WHEN len(need) > 5 THEN array_to_string(list_concat(need[1:3], need[-1:]), ',') ELSE COALESCE(array_to_string(need, ','), '') END AS look_at, COALESCE(len(need), 0) > 5 AS structural FROM g""")
def vision_directives(spark, d):
    """Documents as forty pages that all bear its text, or none; what the text is, is told once and not on each page."""
    t = read(spark, d, "documents").select("doc_id", S.text_kind("text").alias("kind")).select("doc_id", "kind", F.explode(F.sequence(F.lit(1), F.lit(40))).alias("page"))
    k = F.col("doc_id") + F.col("page")
    pages = t.select("doc_id", "page", F.when(k % 3 == 0, S.text_kind(F.lit(""))).otherwise(F.col("kind")).alias("kind"), (k % 2 == 0).alias("has_images"))
    return triage.vision_pages(pages, "doc_id", limit=5, head=3).withColumn("look_at", F.array_join(F.transform("look_at", lambda x: x.cast("string")), ","))


@query("""SELECT w.k, CASE WHEN c.n IS NULL THEN NULL WHEN c.gone OR c.n > 1 THEN NULL ELSE c.url END AS url, CASE WHEN c.n IS NULL THEN 'missing' WHEN c.gone THEN 'repealed' WHEN c.n > 1 THEN 'ambiguous' ELSE 'found' END AS state
 FROM (SELECT p_partkey AS k FROM part) w LEFT JOIN (SELECT page_id * 2 - (CASE WHEN page_id % 10 = 0 THEN 2 ELSE 0 END) AS k, COUNT(*) AS n, MIN(url) AS url, bool_or(page_id % 7 = 0) AS gone FROM pages GROUP BY 1) c ON w.k = c.k""")
def contents_resolve(spark, d):
    w = read(spark, d, "part").select(F.col("p_partkey").alias("k"))
    c = read(spark, d, "pages").select((F.col("page_id") * 2 - F.when(F.col("page_id") % 10 == 0, 2).otherwise(0)).alias("k"), "url", F.when(F.col("page_id") % 7 == 0, "Утратила силу").otherwise("Статья").alias("title"))
    return triage.resolve_contents(w, c, "k")


@query("""WITH d AS (SELECT o_orderkey AS doc_id, o_orderstatus AS relation, o_orderpriority AS doc_type, [o_custkey % 400, o_orderkey % 300 + 1000] AS norms FROM orders),
 s AS (SELECT s_suppkey AS sample_id, CASE s_suppkey % 3 WHEN 0 THEN 'O' WHEN 1 THEN 'F' ELSE 'P' END AS relation, '1-URGENT' AS doc_type, [s_suppkey * 3, s_suppkey + 1000] AS norms FROM supplier),
 o AS (SELECT doc_id, sample_id, COUNT(*) AS shared FROM (SELECT doc_id, UNNEST(norms) AS n FROM d) a JOIN (SELECT sample_id, UNNEST(norms) AS n FROM s) b USING (n) GROUP BY 1, 2)
 SELECT doc_id, sample_id, shared, 'norms' AS via FROM o UNION ALL SELECT d.doc_id, s.sample_id, 0, 'type' FROM d JOIN s ON d.relation = s.relation AND d.doc_type = s.doc_type WHERE d.doc_id NOT IN (SELECT doc_id FROM o)""")
def sample_match(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("relation"), F.col("o_orderpriority").alias("doc_type"), F.array(F.col("o_custkey") % 400, F.col("o_orderkey") % 300 + 1000).alias("norms"))
    k = F.col("s_suppkey")
    s = read(spark, d, "supplier").select(k.alias("sample_id"), F.when(k % 3 == 0, "O").when(k % 3 == 1, "F").otherwise("P").alias("relation"), F.lit("1-URGENT").alias("doc_type"), F.array(k * 3, k + 1000).alias("norms"))
    return triage.matching_samples(o, s)


@query("""SELECT COALESCE(a.n, b.n) AS node, a.c AS ours, b.c AS theirs, CASE WHEN b.c IS NULL THEN 'unopposed' WHEN a.c IS NULL THEN 'unanswered' ELSE 'met' END AS state
 FROM (SELECT c_nationkey AS n, COUNT(*) AS c FROM customer WHERE c_nationkey < 20 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS n, COUNT(*) AS c FROM supplier WHERE s_nationkey > 4 GROUP BY 1) b ON a.n = b.n""")
def arguments_aligned(spark, d):
    a = read(spark, d, "customer").where("c_nationkey < 20").select(F.col("c_nationkey").alias("node"))
    return triage.aligned(a, read(spark, d, "supplier").where("s_nationkey > 4").select(F.col("s_nationkey").alias("node")), "node")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def retractions_filter(spark, d):
    ledger = read(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return reconcile.retracted(read(spark, d, "orders").select("o_orderkey", "o_custkey"), ledger, "o_custkey")


@query("SELECT a.k, a.h FROM (SELECT doc_id AS k, sha256(text) AS h FROM documents) a LEFT JOIN (SELECT doc_id AS k, CASE WHEN doc_id % 9 = 0 THEN 'x' ELSE sha256(text) END AS h FROM documents WHERE doc_id % 13 <> 0) b ON a.k = b.k WHERE a.h IS DISTINCT FROM b.h")
def delta_refresh(spark, d):
    t = read(spark, d, "documents").select(F.col("doc_id").alias("k"), F.sha2("text", 256).alias("h"))
    return reconcile.delta(t, t.where("k % 13 <> 0").withColumn("h", F.when(F.col("k") % 9 == 0, "x").otherwise(F.col("h"))), "k", "h")


@query()
def sheet_findings(spark, d):
    """Findings of the payments profile over orders laid out as one sheet a priority and customer group, so that sheets grow in
    number with the customers."""
    from . import profiles

    o = read(spark, d, "orders").select(F.lit("orders.xlsx").alias("file"), F.concat_ws("/", "o_orderpriority", F.floor(F.col("o_custkey") / 100).cast("string")).alias("sheet"), (F.col("o_orderkey") + 2).cast("int").alias("row_no"), F.array(F.date_format("o_orderdate", "dd.MM.yyyy"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.format_string("77%08d", F.col("o_custkey") % 900), F.format_string("%.2f", "o_totalprice")).alias("cells"))
    return profiles.analyze(o, ["Дата", "Контрагент", "ИНН", "Сумма"], "payments", anchor=ANCHOR).select("file", "sheet", "code", "severity", "message", F.to_json("cells").alias("cells"), F.to_json("numbers").alias("numbers"))


from . import address_queries, corpus_queries, triage_queries  # noqa: E402, F401  register their queries here
