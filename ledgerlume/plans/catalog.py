"""Registered queries over the given tables, with the SQL that must give the same rows.

Keys begin with the identifier of the operator they cover. Every query reads whole tables; those with
a row limit are listings and rankings whose limit is the feature.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import audit, extraction, folds, learning, queueing, reports, rules, sweeps
from ..sources import documents
from ..sources.business import with_tables
from . import invoice_sql as sql
from . import layout_queries  # noqa: F401  registers more
from .registry import ORACLE_SQL, QUERIES, query  # noqa: F401

NOW, EVENT_NOW = "1998-01-01 00:00:00", "2024-01-30 00:00:00"
FROM, UNTIL = "1996-01-01", "1997-12-31"


MONEY = "CAST(coalesce(sum(CAST({0} AS DECIMAL(18,2))), 0) AS DOUBLE)"


def money(column: str) -> str:
    return MONEY.format(column)


IN_PERIOD = f"coalesce(issued, created) >= TIMESTAMP '{FROM}' AND coalesce(issued, created) < TIMESTAMP '{UNTIL}' + INTERVAL 1 DAY"
LABEL = f"coalesce(nullif(legal_name, ''), nullif(trade_name, ''), '{reports.NO_NAME}')"


def period(invoices: DataFrame) -> DataFrame:
    return invoices.filter(reports.in_period(FROM, UNTIL, "issued", "created"))


# Reports


@query("a01_report_totals", f"SELECT count(*) AS invoices, {money('gross')} AS gross, {money('net')} AS net, {money('iss')} AS iss, {money('withheld')} AS withheld, {money('anticipated')} AS anticipated FROM invoices WHERE {IN_PERIOD}", "invoices")
def _(get, spark, d):
    return reports.report_totals(period(get("invoices")))


@query("a02_report_by_status", f"SELECT status, count(*) AS invoices FROM invoices WHERE {IN_PERIOD} GROUP BY status", "invoices")
def _(get, spark, d):
    return reports.by_status(period(get("invoices")))


@query(
    "a03_report_by_customer",
    f"SELECT {LABEL} AS label, {money('gross')} AS gross, count(*) AS invoices FROM invoices LEFT JOIN parties ON party_id = customer_id WHERE {IN_PERIOD} GROUP BY 1",
    "invoices parties",
)
def _(get, spark, d):
    return reports.by_customer(period(get("invoices")), get("parties"))


@query("report_month_totals", f"SELECT strftime(coalesce(issued, created), '%Y-%m') AS month, {money('gross')} AS gross, count(*) AS invoices FROM invoices GROUP BY 1", "invoices")
def _(get, spark, d):
    return reports.by_month(get("invoices"))


@query(
    "a05_month_summary",
    f"""SELECT count(*) FILTER (date_trunc('month', issued) = TIMESTAMP '{NOW}') AS month_invoices, {money("CASE WHEN date_trunc('month', issued) = TIMESTAMP '" + NOW + "' THEN gross END")} AS month_gross,
    count(*) AS all_invoices, {money('gross')} AS all_gross, count(*) FILTER (status = 'CANCELADA') AS cancelled FROM invoices""",
    "invoices",
)
def _(get, spark, d):
    return reports.month_summary(get("invoices"), NOW)


@query("a07_expense_total", f"SELECT category, {money('spent')} AS spent, count(*) AS expenses FROM expenses GROUP BY category", "expenses")
def _(get, spark, d):
    return reports.rollup_expenses(get("expenses"), F.col("category"), "category")


@query(
    "a08_tax_totals",
    "SELECT kind, " + ", ".join(f"{money(f'CASE WHEN status = {chr(39)}{s}{chr(39)} THEN amount END')} AS {s.lower()}" for s in ("PENDENTE", "PAGO", "VENCIDO")) + f", {money('amount')} AS total FROM taxes GROUP BY kind",
    "taxes",
)
def _(get, spark, d):
    return reports.tax_totals(get("taxes"))


@query(
    "a09_service_profit",
    """, s AS (SELECT service_id, sum(CAST(spent AS DECIMAL(18,2))) AS s, count(*) AS n FROM expenses GROUP BY 1)
    SELECT v.service_id, name, CAST(coalesce(s, 0) AS DOUBLE) AS spent, coalesce(n, 0) AS expenses, CAST(CAST(contract AS DECIMAL(18,2)) - coalesce(s, 0) AS DOUBLE) AS profit,
    floor(CAST(coalesce(s, 0) AS DOUBLE) / nullif(contract, 0) * 100 * 10 + 0.5) / 10 AS used_percent FROM services v LEFT JOIN s ON s.service_id = v.service_id""".lstrip(", "),
    "services expenses",
)
def _(get, spark, d):
    return reports.service_profit(get("services"), get("expenses"))


for _name, _key, _sql, _as in (
    ("supplier", lambda: F.col("supplier"), "supplier", "supplier"),
    ("service", lambda: F.col("service_id"), "service_id", "service_id"),
    ("month", lambda: F.date_format("spent_on", "yyyy-MM"), "strftime(spent_on, '%Y-%m')", "month"),
):
    @query(f"a32_expenses_by_{_name}", f"SELECT {_sql} AS {_as}, {money('spent')} AS spent, count(*) AS expenses FROM expenses GROUP BY 1", "expenses")
    def _(get, spark, d, _key=_key, _as=_as):
        return reports.rollup_expenses(get("expenses"), _key(), _as)


@query(
    "a33_service_ranking",
    """s AS (SELECT service_id, sum(CAST(spent AS DECIMAL(18,2))) AS s FROM expenses GROUP BY 1)
    SELECT v.service_id, CAST(CAST(contract AS DECIMAL(18,2)) - coalesce(s, 0) AS DOUBLE) AS profit FROM services v LEFT JOIN s ON s.service_id = v.service_id ORDER BY profit DESC, v.service_id LIMIT 5""",
    "services expenses",
)
def _(get, spark, d):
    return reports.service_profit(get("services"), get("expenses")).select("service_id", "profit").orderBy(F.desc("profit"), "service_id").limit(5)


@query(
    "a34_tax_by_month",
    f"SELECT month, kind, {money('amount')} AS amount, count(*) AS taxes, max(due) AS last_due FROM taxes WHERE contains(month, '1996') GROUP BY 1, 2",
    "taxes",
)
def _(get, spark, d):
    taxes = reports.containing(get("taxes"), "1996", "month")
    return taxes.groupBy("month", "kind").agg(reports.money_sum("amount").alias("amount"), F.count(F.lit(1)).alias("taxes"), F.max("due").alias("last_due"))


@query(
    "a35_monthly_evolution",
    """m AS (SELECT strftime(DATE '1995-06-01' + INTERVAL 1 MONTH * i, '%Y-%m') AS month FROM range(90) AS t(i)),
    r AS (SELECT strftime(issued, '%Y-%m') AS month, sum(CAST(gross AS DECIMAL(18,2))) AS v FROM invoices GROUP BY 1),
    e AS (SELECT strftime(spent_on, '%Y-%m') AS month, sum(CAST(spent AS DECIMAL(18,2))) AS v FROM expenses GROUP BY 1)
    SELECT m.month, CAST(coalesce(r.v, 0) AS DOUBLE) AS revenue, CAST(coalesce(e.v, 0) AS DOUBLE) AS expense, CAST(coalesce(r.v, 0) - coalesce(e.v, 0) AS DOUBLE) AS profit
    FROM m LEFT JOIN r ON r.month = m.month LEFT JOIN e ON e.month = m.month""",
    "invoices expenses",
)
def _(get, spark, d):
    return reports.monthly_evolution(get("invoices"), get("expenses"), "1995-06-01", 90)


# Filters, joins, listings


@query("f01_equality_filter", "SELECT id, number, gross FROM invoices WHERE status = 'PAGA' AND tenant = 3", "invoices")
def _(get, spark, d):
    return reports.matching(get("invoices"), status="PAGA", tenant=3, supplier_id="").select("id", "number", "gross")


@query("f03_range_filter", "SELECT expense_id, spent FROM expenses WHERE spent_on >= TIMESTAMP '1996-03-01' AND spent_on < TIMESTAMP '1996-03-31' + INTERVAL 1 DAY", "expenses")
def _(get, spark, d):
    return get("expenses").filter(reports.in_period("1996-03-01", "1996-03-31", "spent_on")).select("expense_id", "spent")


_SEARCHED = ["number", "status", "description", "legal_name", "trade_name", "tax_id", "segment", "series_number"]


@query("f04_search", "SELECT id, legal_name FROM invoices LEFT JOIN parties ON party_id = customer_id WHERE " + " OR ".join(f"contains(lower(coalesce({c}, '')), 'loja 7')" for c in _SEARCHED), "invoices parties")
def _(get, spark, d):
    return reports.searched(reports.with_customer(get("invoices"), get("parties")), "Loja 7", _SEARCHED).select("id", "legal_name")


@query("f05_expense_search", "SELECT expense_id, description FROM expenses WHERE " + " OR ".join(f"contains(lower({c}), 'pedido 12')" for c in ("description", "supplier", "category", "CAST(service_id AS VARCHAR)")), "expenses")
def _(get, spark, d):
    rows = get("expenses").withColumn("service", F.col("service_id").cast("string"))
    return reports.searched(rows, "pedido 12", ["description", "supplier", "category", "service"]).select("expense_id", "description")


@query("f10_allowed_columns", "SELECT id, number, gross FROM invoices WHERE status = 'PAGA'", "invoices")
def _(get, spark, d):
    return reports.allowed(get("invoices").filter("status = 'PAGA'"), ["id", "number", "gross", "tenant", "secret"], ["id", "number", "gross", "net"])


@query("f11_light_rows", "SELECT doc_id, lang, text IS NOT NULL AND length(text) > 0 AS has_text FROM documents")
def _(get, spark, d):
    return reports.without_heavy(get("documents"), "text", "has_text").select("doc_id", "lang", "has_text")


@query("f13_display_texts", "SELECT id, CASE WHEN length(description) > 10 THEN substr(description, 1, 10) || '…' ELSE description END AS shown, coalesce(strftime(due, '%d/%m/%Y'), '—') AS due_shown FROM invoices", "invoices")
def _(get, spark, d):
    return get("invoices").select("id", reports.shown(F.col("description"), 10).alias("shown"), S.format_date(F.col("due")).alias("due_shown"))


@query("s02_point_lookup", "SELECT id, number, gross, status FROM invoices WHERE id = 77", "invoices")
def _(get, spark, d):
    return reports.matching(get("invoices"), id=77).select("id", "number", "gross", "status")


@query("o01_sorted_page", "SELECT id, gross FROM invoices ORDER BY gross DESC NULLS LAST, id LIMIT 20", "invoices")
def _(get, spark, d):
    rows = get("invoices")
    return reports.page(rows, reports.sorted_listing(rows, "gross", True), 1, 20).select("id", "gross")


@query("o01_unknown_sort_column", "SELECT id, created FROM invoices ORDER BY created ASC NULLS LAST, id LIMIT 20", "invoices")
def _(get, spark, d):
    rows = get("invoices")
    return reports.page(rows, reports.sorted_listing(rows, "password", False), 1, 20).select("id", "created")


@query("o04_job_page", "SELECT job_id, kind, status FROM jobs WHERE status = 'FALHA' ORDER BY created DESC, job_id LIMIT 20 OFFSET 20", "jobs")
def _(get, spark, d):
    return reports.page(reports.matching(get("jobs"), status="FALHA"), [F.desc("created"), F.col("job_id")], 2, 20).select("job_id", "kind", "status")


@query("f08_null_filter", "SELECT sub_id FROM subscriptions WHERE reminded IS NULL AND cancelled IS NOT NULL", "subscriptions")
def _(get, spark, d):
    return get("subscriptions").filter("reminded IS NULL AND cancelled IS NOT NULL").select("sub_id")


@query("f09_audit_search", """SELECT event_id, document, field FROM audit WHERE severity = 'CRITICO' AND actor = 'HUMANO' AND "at" >= TIMESTAMP '2024-01-02' AND "at" <= TIMESTAMP '2024-01-28' ORDER BY seq LIMIT 50 OFFSET 10""", "audit")
def _(get, spark, d):
    return audit.search(get("audit"), 10, 50, since="2024-01-02", until="2024-01-28", severity="CRITICO", actor="HUMANO").select("event_id", "document", "field")


@query("f12_number_forms", "SELECT id, TRY_CAST(CAST(gross AS DECIMAL(18,2)) AS DOUBLE) AS typed, CAST(replace(CAST(CAST(gross AS DECIMAL(18,2)) AS VARCHAR), '.', '') AS DOUBLE) AS local_form FROM invoices", "invoices")
def _(get, spark, d):
    text = F.col("gross").cast("decimal(18,2)").cast("string")
    return get("invoices").select("id", S.form_number(text).alias("typed"), S.parse_number(text).alias("local_form"))


@query("f14_short_names", r"SELECT party_id, substr(regexp_replace(trade_name, '\s+(Ltda|S\.A|ME|EIRELI)\.?$', '', 'i'), 1, 24) AS short FROM parties", "parties")
def _(get, spark, d):
    return get("parties").select("party_id", S.strip_company_suffix(F.col("trade_name")).alias("short"))


@query("f15_cancelled_guard", "SELECT status, count(*) AS n FROM invoices WHERE NOT regexp_matches(status, '(?i)cancelad') GROUP BY status", "invoices")
def _(get, spark, d):
    return get("invoices").filter(~F.col("status").rlike("(?i)cancelad")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("j02_tax_with_invoice", "SELECT t.tax_id, t.kind, i.number, i.status AS invoice_status FROM taxes t LEFT JOIN invoices i ON i.id = t.invoice_id", "taxes invoices")
def _(get, spark, d):
    inv = get("invoices").select(F.col("id").alias("invoice_id"), "number", F.col("status").alias("invoice_status"))
    return get("taxes").join(inv, "invoice_id", "left").select("tax_id", "kind", "number", "invoice_status")


@query(
    "j03_nested_taxes",
    """y AS (SELECT invoice_id, string_agg(kind || ':' || CAST(CAST(amount AS DECIMAL(18,2)) AS VARCHAR), ',' ORDER BY tax_id, kind, amount) AS taxes FROM taxes GROUP BY 1),
    h AS (SELECT CAST(document AS BIGINT) AS invoice_id, seq, row_number() OVER (PARTITION BY document ORDER BY seq DESC) AS n FROM audit), z AS (SELECT invoice_id, string_agg(CAST(seq AS VARCHAR), ',' ORDER BY n) AS history FROM h WHERE n <= 50 GROUP BY 1)
    SELECT id, number, coalesce(y.taxes, '') AS taxes, coalesce(z.history, '') AS history FROM invoices LEFT JOIN y ON y.invoice_id = id LEFT JOIN z ON z.invoice_id = id""",
    "taxes invoices audit",
)
def _(get, spark, d):
    return reports.invoice_detail(get("invoices"), get("taxes"), get("audit").select(F.col("document").cast("long").alias("invoice_id"), "seq"))


@query("j04_substitutions", "SELECT a.id, a.substitute_id, a.gross, b.gross AS old_gross FROM invoices a LEFT JOIN invoices b ON b.id = a.substitute_id WHERE a.substitute_id IS NOT NULL", "invoices")
def _(get, spark, d):
    return reports.substitutions(get("invoices"))


@query("j08_unpaid_invoices", "SELECT id FROM invoices WHERE id NOT IN (SELECT invoice_id FROM taxes WHERE status = 'PAGO')", "invoices taxes")
def _(get, spark, d):
    paid = get("taxes").filter("status = 'PAGO'").select(F.col("invoice_id").alias("id"))
    return get("invoices").join(paid, "id", "left_anti").select("id")


@query("j09_invoices_with_overdue_tax", "SELECT id FROM invoices WHERE id IN (SELECT invoice_id FROM taxes WHERE status = 'VENCIDO')", "invoices taxes")
def _(get, spark, d):
    late = get("taxes").filter("status = 'VENCIDO'").select(F.col("invoice_id").alias("id"))
    return get("invoices").join(late, "id", "left_semi").select("id")


@query("o02_page", "SELECT id, gross FROM invoices ORDER BY issued DESC NULLS LAST, id LIMIT 20 OFFSET 40", "invoices")
def _(get, spark, d):
    return reports.page(get("invoices"), [F.col("issued").desc_nulls_last(), F.col("id")], 3, 20).select("id", "gross")


@query("o02_page_count", "SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages FROM invoices WHERE status = 'ATIVA'", "invoices")
def _(get, spark, d):
    return reports.page_count(get("invoices").filter("status = 'ATIVA'"), 20)


@query("o06_latest_per_customer", "SELECT id, customer_id, rank FROM (SELECT id, customer_id, row_number() OVER (PARTITION BY customer_id ORDER BY created DESC NULLS LAST, id) AS rank FROM invoices) WHERE rank <= 3", "invoices")
def _(get, spark, d):
    return reports.latest_per(get("invoices"), "customer_id", [F.col("created").desc_nulls_last(), F.col("id")], 3).select("id", "customer_id", "rank")


@query("o10_latest_charge", "SELECT sub_id, arg_max(charge_id, (handled, charge_id)) AS charge_id, max(handled) AS handled FROM charges WHERE charge_status = 'APROVADA' GROUP BY sub_id", "charges")
def _(get, spark, d):
    return sweeps.latest_charge(get("charges"))


@query(
    "o11_recent_activity",
    """u AS (SELECT 'nota' AS source, id AS ref, created AS "at" FROM invoices UNION ALL SELECT 'imposto', tax_id, due FROM taxes UNION ALL SELECT 'gasto', expense_id, spent_on FROM expenses)
    SELECT * FROM u ORDER BY "at" DESC NULLS LAST, source, ref LIMIT 8""",
    "invoices taxes expenses",
)
def _(get, spark, d):
    return reports.recent_activity([("nota", get("invoices"), "id", "created"), ("imposto", get("taxes"), "tax_id", "due"), ("gasto", get("expenses"), "expense_id", "spent_on")], 8)


@query("u01_party_keys", "SELECT customer_id AS party FROM invoices UNION SELECT party_id FROM parties", "invoices parties")
def _(get, spark, d):
    return get("invoices").select(F.col("customer_id").alias("party")).union(get("parties").select("party_id")).distinct()


@query("u03_parties_without_invoice", "SELECT party_id FROM parties EXCEPT SELECT customer_id FROM invoices WHERE status = 'CANCELADA'", "invoices parties")
def _(get, spark, d):
    cancelled = get("invoices").filter("status = 'CANCELADA'").select(F.col("customer_id").alias("party_id"))
    return get("parties").select("party_id").join(cancelled, "party_id", "left_anti")


_MIDDAY = "1997-12-31 12:00:00"


@query(
    "r01_early_payment",
    f"""x AS (SELECT id, coalesce(net, gross, 0) AS base, coalesce(greatest(1, CAST(ceil(epoch(due - TIMESTAMP '{_MIDDAY}') / 86400) AS BIGINT)), 30) AS days FROM invoices)
    SELECT id, days, floor(base * 2.5 / 100 * days / 30 * 100 + 0.5) / 100 AS fee, floor(greatest(0, base - base * 2.5 / 100 * days / 30) * 100 + 0.5) / 100 AS paid_out FROM x""",
    "invoices",
)
def _(get, spark, d):
    return reports.early_payment(get("invoices"), 2.5, _MIDDAY)


@query(
    "r04_worker_status",
    f"""x AS (SELECT worker_id, kind, date_diff('day', TIMESTAMP '{NOW}', date_trunc('day', expires)) AS days FROM worker_docs), s AS (SELECT worker_id, count(*) FILTER (days < 0) AS o, count(*) FILTER (days BETWEEN 0 AND 30) AS n, min(kind) FILTER (days < 0) AS one FROM x GROUP BY 1)
    SELECT w.worker_id, coalesce(o, 0) AS overdue, coalesce(n, 0) AS near, CASE WHEN coalesce(o, 0) >= 2 THEN 'Integração e ASO vencidos' WHEN o = 1 THEN CASE one WHEN 'INTEGRACAO' THEN 'Integração vencida' WHEN 'ASO' THEN 'ASO vencido' ELSE one || ' vencido' END WHEN coalesce(n, 0) > 0 THEN 'Próximo do vencimento' ELSE 'Em dia' END AS label
    FROM workers w LEFT JOIN s ON s.worker_id = w.worker_id""",
    "workers worker_docs",
)
def _(get, spark, d):
    return reports.worker_status(get("worker_docs"), get("workers"), NOW)


@query(
    "r02_early_payment_direct",
    """x AS (SELECT id, coalesce(net, gross, 0) AS base, CASE id % 5 WHEN 0 THEN -1 WHEN 1 THEN coalesce(net, gross, 0) + 1 WHEN 2 THEN coalesce(net, gross, 0) WHEN 3 THEN 0 ELSE 15.5 END::DOUBLE AS fee FROM invoices)
    SELECT id, fee BETWEEN 0 AND base AS valid, CASE WHEN fee BETWEEN 0 AND base THEN floor(fee * 100 + 0.5) / 100 END AS fee, CASE WHEN fee BETWEEN 0 AND base THEN floor((base - fee) * 100 + 0.5) / 100 END AS paid_out FROM x""",
    "invoices",
)
def _(get, spark, d):
    k, base = F.col("id") % 5, F.coalesce("net", "gross", F.lit(0.0))
    return reports.early_payment_for(get("invoices"), F.when(k == 0, -1.0).when(k == 1, base + 1).when(k == 2, base).when(k == 4, 15.5))


_PERIODS = (("mes", "1997-08-01"), ("6meses", "1997-03-01"), ("ano", "1997-01-01"))


@query(
    "r10_periods",
    " UNION ALL ".join(f"SELECT '{n}' AS period, count(*) FILTER (created >= TIMESTAMP '{day}' AND created < TIMESTAMP '1997-09-01') AS invoices FROM invoices" for n, day in _PERIODS)
    + " UNION ALL SELECT 'total', count(*) FILTER (created >= TIMESTAMP '2000-01-01' AND created < TIMESTAMP '2000-06-01') FROM invoices",
    "invoices",
)
def _(get, spark, d):
    rows, spans = get("invoices"), {n: reports.period_of(n, "1997-08-20 10:00:00") for n, _ in _PERIODS} | {"total": reports.period_of("total", "2000-05-31 10:00:00")}
    counted = rows.agg(*[F.count_if((F.col("created") >= begins) & (F.col("created") < ends)).alias(n) for n, (begins, ends) in spans.items()])
    return counted.unpivot([], list(spans), "period", "invoices")


@query(
    "a36_worker_summary",
    f"""x AS (SELECT worker_id, date_diff('day', TIMESTAMP '{NOW}', date_trunc('day', expires)) AS days FROM worker_docs), s AS (SELECT worker_id, count(*) FILTER (days < 0) AS o, count(*) FILTER (days BETWEEN 0 AND 30) AS n FROM x GROUP BY 1)
    SELECT CASE WHEN o > 0 THEN 'VENCIDO' WHEN n > 0 THEN 'PROXIMO' ELSE 'EM_DIA' END AS state, count(*) AS workers FROM workers w LEFT JOIN s ON s.worker_id = w.worker_id GROUP BY 1""",
    "workers worker_docs",
)
def _(get, spark, d):
    return reports.worker_summary(get("worker_docs"), get("workers"), NOW)


@query("r05_due_months", "SELECT tax_id, CAST(CAST(due AS DATE) + INTERVAL 1 MONTH AS DATE) AS next_due FROM taxes", "taxes")
def _(get, spark, d):
    return get("taxes").select("tax_id", S.add_months(F.to_date("due"), 1).alias("next_due"))


@query(
    "r09_change_log",
    """o AS (SELECT id, CAST(status AS VARCHAR) AS s, CAST(tenant AS VARCHAR) AS t FROM invoices), n AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'CANCELADA' ELSE status END AS s, CAST((customer_id + id % 9 // 8) % 7 AS VARCHAR) AS t FROM invoices)
    SELECT o.id, 'status' AS field, o.s AS old, n.s AS new FROM o JOIN n ON o.id = n.id WHERE o.s <> n.s UNION ALL SELECT o.id, 'tenant', o.t, n.t FROM o JOIN n ON o.id = n.id WHERE o.t <> n.t""",
    "invoices",
)
def _(get, spark, d):
    old = get("invoices")
    new = old.withColumn("status", F.when(F.col("id") % 4 == 0, "CANCELADA").otherwise(F.col("status"))).withColumn("tenant", F.expr("(customer_id + id % 9 div 8) % 7"))
    return reports.change_log(old, new, "id", ["status", "tenant"])


@query(
    "q13_duplicate_invoices",
    "x AS (SELECT id, min(id) OVER (PARTITION BY series_number, supplier_id, issued) AS duplicate_of FROM invoices WHERE series_number IS NOT NULL AND supplier_id IS NOT NULL AND issued IS NOT NULL) SELECT id, duplicate_of FROM x WHERE id > duplicate_of",
    "invoices",
)
def _(get, spark, d):
    return reports.duplicates(get("invoices"), ["series_number", "supplier_id", "issued"], "id")


# Scalars over whole columns


@query("x01_tax_id_kinds", "SELECT party_id, CASE length(tax_id) WHEN 11 THEN 'CPF' WHEN 14 THEN 'CNPJ' END AS kind, tax_id[1:2] || '.' || tax_id[3:5] || '.' || tax_id[6:8] || '/' || tax_id[9:12] || '-' || tax_id[13:14] AS shown FROM parties", "parties")
def _(get, spark, d):
    return get("parties").select("party_id", S.tax_id_kind(F.col("tax_id")).alias("kind"), S.format_tax_id(F.col("tax_id")).alias("shown"))


_cnpj_sum = lambda w: " + ".join(f"CAST(tax_id[{i + 1}] AS INT) * {x}" for i, x in enumerate(w))
_cnpj_digit = lambda w: f"CASE WHEN ({_cnpj_sum(w)}) % 11 < 2 THEN 0 ELSE 11 - ({_cnpj_sum(w)}) % 11 END"


@query(
    "x02_valid_company_numbers",
    f"SELECT party_id, ({_cnpj_digit(S.CNPJ_FIRST)}) = CAST(tax_id[13] AS INT) AND ({_cnpj_digit(S.CNPJ_SECOND)}) = CAST(tax_id[14] AS INT) AND tax_id <> repeat(tax_id[1], 14) AS valid FROM parties",
    "parties",
)
def _(get, spark, d):
    return get("parties").select("party_id", S.valid_cnpj(F.col("tax_id")).alias("valid"))


@query(
    "x05_money_text",
    "x AS (SELECT id, format('{:,.2f}', gross) AS t FROM invoices) SELECT id, 'R$ ' || translate(t, ',.', '.,') AS shown, gross AS parsed FROM x JOIN invoices USING (id)",
    "invoices",
)
def _(get, spark, d):
    shown = S.format_money(F.col("gross"))
    return get("invoices").select("id", shown.alias("shown"), S.parse_number(shown).alias("parsed"))


@query("x07_dates_round_trip", "SELECT id, strftime(issued, '%d/%m/%Y') AS shown, CAST(issued AS DATE) AS parsed FROM invoices WHERE issued IS NOT NULL", "invoices")
def _(get, spark, d):
    shown = S.format_date(F.col("issued"))
    return get("invoices").filter("issued IS NOT NULL").select("id", shown.alias("shown"), S.parse_date(shown).alias("parsed"))


_PLAIN = f"trim(regexp_replace(regexp_replace(translate(lower(text), '{S.ACCENTED}', '{S.PLAIN}'), '[^A-Za-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("x11_normal_texts", f"SELECT doc_id, sha256({_PLAIN}) AS digest FROM documents")
def _(get, spark, d):
    return get("documents").select("doc_id", F.sha2(S.normal_text(F.col("text")), 256).alias("digest"))


@query("x14_name_distance", "SELECT party_id, levenshtein(legal_name, trade_name) AS distance FROM parties WHERE trade_name IS NOT NULL", "parties")
def _(get, spark, d):
    return get("parties").filter("trade_name IS NOT NULL").select("party_id", F.levenshtein("legal_name", "trade_name").cast("long").alias("distance"))


_SEALED = """'{"actor":"' || actor || '","document":"' || document || '","entry":"' || entry || '","event_id":' || event_id || ',"field":"' || field || '","seq":' || seq || ',"severity":"' || severity || '"}'"""


@query("x21_row_hashes", f"SELECT event_id, printf('%08x', list_reduce(list_prepend(5381::BIGINT, list_transform(string_split({_SEALED}, ''), lambda c: ord(c)::BIGINT)), lambda h, c: xor((h * 33) & 4294967295, c))) AS seal FROM audit", "audit")
def _(get, spark, d):
    return audit.sealed(get("audit"))


@query("x22_text_digests", "SELECT doc_id, sha256(text) AS digest, length(text) AS chars FROM documents")
def _(get, spark, d):
    return get("documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.char_length("text").cast("long").alias("chars"))


_REDACT = "text"
for _p, _m in S.REDACTIONS:
    _REDACT = f"regexp_replace({_REDACT}, '{_p}', '{_m}', 'g')"


@query("x23_redacted_texts", f"SELECT doc_id, sha256({_REDACT}) AS digest FROM documents")
def _(get, spark, d):
    return get("documents").select("doc_id", F.sha2(S.redact(F.col("text")), 256).alias("digest"))


_FAIL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(message), '{p}')" for p in parts) + f" THEN '{kind}'" for parts, kind in S.FAILURES) + " ELSE 'FALHA_EXTRACAO' END"


@query("x25_failure_kinds", f"SELECT {_FAIL} AS failure, count(*) AS jobs FROM jobs GROUP BY 1", "jobs")
def _(get, spark, d):
    return get("jobs").groupBy(S.failure_kind(F.col("message")).alias("failure")).agg(F.count(F.lit(1)).alias("jobs"))


@query("x31_json_props", "SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k FROM events GROUP BY 1")
def _(get, spark, d):
    k = F.from_json("props", "k long")["k"]
    return get("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("k"))


@query("s07_segments", "x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s FROM documents) SELECT doc_id, count(*) AS lines, sum(length(trim(s)))::BIGINT AS chars FROM x WHERE trim(s) <> '' GROUP BY 1".replace("x AS", "WITH x AS", 1))
def _(get, spark, d):
    return extraction.lines(get("documents")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.char_length("line")).alias("chars"))


# Audit and versions


@query(
    "w01_field_history",
    "SELECT document, field, seq, entry, row_number() OVER w AS version, lag(entry) OVER w AS previous, seq = max(seq) OVER (PARTITION BY document, field) AS is_final FROM audit WINDOW w AS (PARTITION BY document, field ORDER BY seq)",
    "audit",
)
def _(get, spark, d):
    return audit.field_history(get("audit"))


@query(
    "w02_human_edits",
    "x AS (SELECT *, lag(entry) OVER (PARTITION BY document, field ORDER BY seq) AS previous FROM audit) SELECT document, field, seq, previous, entry FROM x WHERE actor = 'HUMANO' AND entry IS DISTINCT FROM previous",
    "audit",
)
def _(get, spark, d):
    return audit.human_edits(get("audit"))


@query("w05_latest_values", "SELECT document, field, arg_max(entry, seq) AS entry, max(seq) AS seq FROM audit GROUP BY 1, 2", "audit")
def _(get, spark, d):
    return audit.latest_values(get("audit"))


@query(
    "w07_gaps",
    """x AS (SELECT document, seq, (epoch(date_trunc('second', "at"))::BIGINT - epoch(date_trunc('second', lag("at") OVER (PARTITION BY document ORDER BY seq)))::BIGINT) / 60.0 AS m FROM audit)
    SELECT document, seq, CAST(floor(m) AS BIGINT) AS minutes, CASE WHEN m > 480 THEN 'LONGA' ELSE 'CURTA' END AS kind FROM x WHERE m > 60""",
    "audit",
)
def _(get, spark, d):
    return audit.gaps(get("audit"))


@query("w09_version_span", 'SELECT document, min("at") AS first_at, max("at") AS last_at, count(*) AS events FROM audit GROUP BY 1', "audit")
def _(get, spark, d):
    return audit.version_span(get("audit"))


@query(
    "a28_instability",
    """x AS (SELECT document, field, lag(seq) OVER w IS NOT NULL AND entry IS DISTINCT FROM lag(entry) OVER w AS c FROM audit WINDOW w AS (PARTITION BY document, field ORDER BY seq))
    SELECT document, field, count(*) AS entries, count(*) FILTER (c) AS changes FROM x GROUP BY 1, 2""",
    "audit",
)
def _(get, spark, d):
    return audit.instability(get("audit"))


@query(
    "j12_snapshot_diff",
    """o AS (SELECT document, field, arg_max(entry, seq) AS old FROM audit WHERE seq <= 400 GROUP BY 1, 2), n AS (SELECT document, field, arg_max(entry, seq) AS new FROM audit WHERE seq <= 900 GROUP BY 1, 2)
    SELECT coalesce(o.document, n.document) AS document, coalesce(o.field, n.field) AS field, old, new FROM o FULL JOIN n ON o.document = n.document AND o.field = n.field WHERE old IS DISTINCT FROM new""",
    "audit",
)
def _(get, spark, d):
    return audit.snapshot_diff(get("audit"), 400, 900)


@query(
    "w06_version_changes",
    """x AS (SELECT document, seq, entry, row_number() OVER (PARTITION BY document ORDER BY seq) AS version, lag(entry) OVER w AS old, lag(seq) OVER w AS before FROM audit WINDOW w AS (PARTITION BY document, field ORDER BY seq))
    SELECT document, version, seq, CASE WHEN before IS NULL THEN 'NOVO' WHEN entry IS DISTINCT FROM old THEN 'ALTERADO' ELSE 'IGUAL' END AS change, old, entry AS new FROM x""",
    "audit",
)
def _(get, spark, d):
    return audit.version_changes(get("audit"))


@query("w05_latest_with_label", "SELECT document, max(seq) AS seq, arg_max(field, seq) AS field, arg_max(entry, seq) AS entry FROM audit WHERE severity = 'AVISO' GROUP BY 1", "audit")
def _(get, spark, d):
    return audit.latest_with_label(get("audit"), "AVISO")


@query("h08_field_traces", "SELECT document, field, string_agg(seq || '=' || entry, ' -> ' ORDER BY seq) AS trace FROM audit WHERE actor = 'HUMANO' GROUP BY 1, 2", "audit")
def _(get, spark, d):
    return audit.traces(get("audit").filter("actor = 'HUMANO'"))


@query(
    "x28_sensitivity",
    """SELECT CASE WHEN kind = 'EXPORTACAO' OR field = 'view' THEN 'critica' WHEN kind = 'LOGIN' THEN 'alta' WHEN kind = 'CONFIGURACAO' THEN 'alta' WHEN kind = 'CORRECAO' THEN CASE WHEN field = 'click' THEN 'critica' ELSE 'alta' END WHEN kind = 'VALIDACAO' THEN 'media' ELSE 'baixa' END AS level, count(*) AS events
    FROM (SELECT CASE event_id % 6 WHEN 0 THEN 'EXPORTACAO' WHEN 1 THEN 'LOGIN' WHEN 2 THEN 'CONFIGURACAO' WHEN 3 THEN 'CORRECAO' WHEN 4 THEN 'VALIDACAO' ELSE 'OUTRO' END AS kind, field FROM audit) GROUP BY 1""",
    "audit",
)
def _(get, spark, d):
    kind = F.expr("CASE event_id % 6 WHEN 0 THEN 'EXPORTACAO' WHEN 1 THEN 'LOGIN' WHEN 2 THEN 'CONFIGURACAO' WHEN 3 THEN 'CORRECAO' WHEN 4 THEN 'VALIDACAO' ELSE 'OUTRO' END")
    rows = get("audit").select(kind.alias("kind"), F.when(F.col("field") == "view", "VISUALIZACAO_SENSIVEL").otherwise(kind).alias("sub"), F.when(F.col("field") == "click", "cpf_cnpj").otherwise(F.col("field")).alias("name"))
    return rows.groupBy(audit.sensitivity(F.col("kind"), F.col("sub"), F.col("name")).alias("level")).agg(F.count(F.lit(1)).alias("events"))


@query("h04_integrity", "SELECT count(*) AS total, count(*) FILTER (event_id % 3 <> 0 AND event_id % 97 <> 0) AS intact, count(*) FILTER (event_id % 3 <> 0 AND event_id % 97 = 0) AS broken, count(*) FILTER (event_id % 3 = 0) AS unsealed FROM audit", "audit")
def _(get, spark, d):
    seals = audit.sealed(get("audit")).filter("event_id % 3 <> 0")
    return audit.integrity(get("audit"), seals.withColumn("seal", F.when(F.col("event_id") % 97 == 0, "0").otherwise(F.col("seal"))))


# Queue


@query("a10_jobs_by_status", "d AS (SELECT unnest(['PENDENTE','PROCESSANDO','CONCLUIDO','FALHA','DEAD_LETTER','CANCELADO']) AS status) SELECT d.status, count(j.job_id) AS n FROM d LEFT JOIN jobs j ON j.status = d.status GROUP BY 1", "jobs")
def _(get, spark, d):
    return reports.zero_filled(get("jobs").groupBy("status").agg(F.count(F.lit(1)).alias("n")), "status", list(queueing.STATES))


@query("a11_jobs_by_kind_and_status", "SELECT kind, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s.lower()}" for s in queueing.STATES) + " FROM jobs GROUP BY kind", "jobs")
def _(get, spark, d):
    return queueing.status_by_kind(get("jobs"))


_REPORT = f"""q AS (SELECT count(*) FILTER (status = 'PENDENTE') AS pending, count(*) FILTER (status = 'DEAD_LETTER') AS dead_letter,
    count(*) FILTER (status = 'CONCLUIDO' AND finished >= TIMESTAMP '{EVENT_NOW}' - INTERVAL 1 HOUR) AS throughput,
    count(*) FILTER (status IN ('FALHA', 'DEAD_LETTER') AND updated >= TIMESTAMP '{EVENT_NOW}' - INTERVAL 1 HOUR) AS lost,
    count(DISTINCT worker) FILTER (started >= TIMESTAMP '{EVENT_NOW}' - INTERVAL 60 SECOND) AS workers,
    avg(CASE WHEN status = 'CONCLUIDO' THEN CAST(epoch_ms(finished) - epoch_ms(started) AS DOUBLE) END) AS mean FROM jobs),
    r AS (SELECT pending, dead_letter, throughput, workers, CASE WHEN throughput + lost > 0 THEN floor(lost / (throughput + lost) * 100 * 10 + 0.5) / 10 ELSE 0.0::DOUBLE END AS error_rate, coalesce(floor(mean + 0.5), 0.0)::DOUBLE AS latency_ms FROM q)"""


@query("q07_queue_report", f"{_REPORT} SELECT * FROM r", "jobs")
def _(get, spark, d):
    return queueing.queue_report(get("jobs"), EVENT_NOW)


@query("a16_metric_rows", f"{_REPORT} " + " UNION ALL ".join(f"SELECT '{m}' AS metric, {m}::DOUBLE AS value FROM r" for m in ("pending", "dead_letter", "throughput", "workers", "error_rate", "latency_ms")), "jobs")
def _(get, spark, d):
    return queueing.metric_rows(queueing.queue_report(get("jobs"), EVENT_NOW))


@query(
    "q06_metric_log",
    f"""SELECT job_id, 'job.concluido.total' AS name, 1.0::DOUBLE AS value, 'jobs' AS unit, kind, NULL::VARCHAR AS detail FROM jobs WHERE status = 'CONCLUIDO'
    UNION ALL SELECT job_id, 'job.latencia.ms', CAST(epoch_ms(finished) - epoch_ms(started) AS DOUBLE), 'ms', kind, NULL FROM jobs WHERE status = 'CONCLUIDO'
    UNION ALL SELECT job_id, 'job.falha.total', 1, 'jobs', kind, {_FAIL} FROM jobs WHERE status = 'FALHA'
    UNION ALL SELECT job_id, 'job.dead_letter.total', 1, 'jobs', kind, NULL FROM jobs WHERE status = 'DEAD_LETTER'
    UNION ALL SELECT job_id, 'job.retry.total', 1, 'jobs', kind, CAST(attempts AS VARCHAR) FROM jobs WHERE attempts > 0""",
    "jobs",
)
def _(get, spark, d):
    return queueing.metric_log(get("jobs"))


@query("q08_alerts", f"{_REPORT} " + " UNION ALL ".join(f"SELECT '{n}' AS alert, '{s}' AS severity FROM r WHERE {rule}" for n, s, rule in queueing.ALERT_RULES), "jobs")
def _(get, spark, d):
    return queueing.active_alerts(queueing.queue_report(get("jobs"), EVENT_NOW))


@query(
    "q09_alert_changes",
    f"{_REPORT}, a AS (" + " UNION ALL ".join(f"SELECT '{n}' AS alert FROM r WHERE {rule}" for n, s, rule in queueing.ALERT_RULES) + """), o AS (SELECT DISTINCT CASE WHEN kind = 'UPLOAD' THEN 'fila_acumulando' WHEN kind = 'EXTRACAO' THEN 'latencia_alta' ELSE 'outro' END AS alert FROM jobs)
    SELECT coalesce(a.alert, o.alert) AS alert, CASE WHEN o.alert IS NULL THEN 'ABRIR' WHEN a.alert IS NULL THEN 'RESOLVER' ELSE 'MANTER' END AS action FROM a FULL JOIN o ON a.alert = o.alert""",
    "jobs",
)
def _(get, spark, d):
    kind = F.when(F.col("kind") == "UPLOAD", "fila_acumulando").when(F.col("kind") == "EXTRACAO", "latencia_alta").otherwise("outro")
    held = get("jobs").select(kind.alias("alert")).distinct()
    return queueing.alert_changes(queueing.active_alerts(queueing.queue_report(get("jobs"), EVENT_NOW)), held)


@query("o05_next_job", "SELECT job_id, kind FROM jobs WHERE status = 'PENDENTE' ORDER BY priority, created, job_id LIMIT 1", "jobs")
def _(get, spark, d):
    return queueing.next_job(get("jobs")).select("job_id", "kind")


@query("j10_blocked_jobs", "x AS (SELECT job_id, unnest(after_ids) AS after_id FROM jobs WHERE status = 'PENDENTE') SELECT x.job_id, x.after_id, b.status AS other_status FROM x LEFT JOIN jobs b ON b.job_id = x.after_id WHERE b.status IS NULL OR b.status <> 'CONCLUIDO'", "jobs")
def _(get, spark, d):
    return queueing.dependencies(get("jobs"))


@query(
    "j11_ready_jobs",
    "x AS (SELECT job_id, unnest(after_ids) AS after_id FROM jobs WHERE status = 'PENDENTE'), y AS (SELECT x.job_id, count(*) FILTER (b.status = 'CONCLUIDO') AS done FROM x LEFT JOIN jobs b ON b.job_id = x.after_id GROUP BY 1) SELECT a.job_id FROM jobs a LEFT JOIN y ON y.job_id = a.job_id WHERE a.status = 'PENDENTE' AND coalesce(len(a.after_ids), 0) = coalesce(y.done, 0)",
    "jobs",
)
def _(get, spark, d):
    return queueing.ready(get("jobs")).select("job_id")


@query("a17_alerts_by_severity", f"{_REPORT}, a AS (" + " UNION ALL ".join(f"SELECT '{s}' AS severity FROM r WHERE {rule}" for n, s, rule in queueing.ALERT_RULES) + ") SELECT v.severity, count(a.severity) AS alerts FROM (VALUES ('AVISO'), ('CRITICO'), ('EMERGENCIA')) AS v(severity) LEFT JOIN a ON a.severity = v.severity GROUP BY 1", "jobs")
def _(get, spark, d):
    return queueing.severity_counts(queueing.active_alerts(queueing.queue_report(get("jobs"), EVENT_NOW)))


_CONFIG = "c AS (SELECT * FROM (VALUES " + ", ".join(str(c) for c in queueing.JOB_CONFIG) + ") AS v(kind, timeout_s, max_attempts, base_s, cap_s))"


@query(
    "q03_after_failure",
    f"""{_CONFIG} SELECT job_id, {_FAIL} AS failure, CASE WHEN attempts < max_attempts THEN 'PENDENTE' ELSE 'DEAD_LETTER' END AS next_status,
    CASE WHEN attempts < max_attempts THEN greatest(1.0::DOUBLE, least(base_s * pow(2.0, greatest(attempts, 1) - 1), cap_s::DOUBLE)) END AS delay_s FROM jobs LEFT JOIN c ON c.kind = jobs.kind WHERE status = 'FALHA'""",
    "jobs",
)
def _(get, spark, d):
    return queueing.after_failure(get("jobs"))


@query(
    "q04_stuck_jobs",
    f"""{_CONFIG} SELECT job_id, epoch(TIMESTAMP '{EVENT_NOW}')::BIGINT - epoch(date_trunc('second', started))::BIGINT AS idle_s, CASE WHEN attempts < max_attempts THEN 'REENFILEIRAR' ELSE 'DEAD_LETTER' END AS action
    FROM jobs JOIN c ON c.kind = jobs.kind WHERE status = 'PROCESSANDO' AND epoch(TIMESTAMP '{EVENT_NOW}')::BIGINT - epoch(date_trunc('second', started))::BIGINT > 2 * timeout_s""",
    "jobs",
)
def _(get, spark, d):
    return queueing.stuck(get("jobs"), EVENT_NOW).drop("kind")


@query(
    "q05_blocked_jobs",
    "w AS (SELECT job_id, kind, unnest(after_ids) AS needs FROM jobs WHERE status = 'PENDENTE') SELECT w.job_id, w.kind, string_agg(DISTINCT needs, ',' ORDER BY needs) AS over FROM w JOIN jobs o ON o.job_id = w.needs WHERE o.status IN ('CANCELADO', 'DEAD_LETTER') GROUP BY 1, 2",
    "jobs",
)
def _(get, spark, d):
    return queueing.blocked(get("jobs")).withColumn("over", F.array_join("over", ","))


@query(
    "q11_repeated_uploads",
    """SELECT a.job_id, arg_max(b.job_id, (b.created, b.job_id)) AS first_id, a.file_hash FROM jobs a JOIN jobs b ON b.file_hash = a.file_hash AND b.status NOT IN ('CANCELADO', 'DEAD_LETTER')
    AND b.created >= a.created - INTERVAL 24 HOUR AND (b.created < a.created OR (b.created = a.created AND b.job_id < a.job_id)) GROUP BY a.job_id, a.file_hash""",
    "jobs",
)
def _(get, spark, d):
    return queueing.repeated_uploads(get("jobs"))


@query("q12_in_flight", "SELECT kind, file_hash, count(*) AS live, arg_max(job_id, (created, job_id)) AS newest FROM jobs WHERE status IN ('PENDENTE', 'PROCESSANDO') GROUP BY 1, 2", "jobs")
def _(get, spark, d):
    return queueing.in_flight(get("jobs"))


@query(
    "q12_file_states",
    "SELECT file_hash, arg_max(job_id, (created, job_id)) FILTER (status NOT IN ('CANCELADO', 'DEAD_LETTER')) AS newest, arg_max(status, (created, job_id)) FILTER (status NOT IN ('CANCELADO', 'DEAD_LETTER')) AS status, bool_or(kind = 'AUDITORIA' AND status = 'CONCLUIDO') AS audited FROM jobs GROUP BY 1",
    "jobs",
)
def _(get, spark, d):
    return queueing.file_states(get("jobs"))


@query(
    "q05_recovery_summary",
    f"""{_CONFIG}, x AS (SELECT jobs.kind, epoch(TIMESTAMP '{EVENT_NOW}')::BIGINT - epoch(date_trunc('second', started))::BIGINT AS idle_s, CASE WHEN attempts < max_attempts THEN 'REENFILEIRAR' ELSE 'DEAD_LETTER' END AS action, timeout_s FROM jobs JOIN c ON c.kind = jobs.kind WHERE status = 'PROCESSANDO'),
    w AS (SELECT job_id, kind, unnest(after_ids) AS needs FROM jobs WHERE status = 'PENDENTE'), b AS (SELECT DISTINCT w.job_id, w.kind FROM w JOIN jobs o ON o.job_id = w.needs WHERE o.status IN ('CANCELADO', 'DEAD_LETTER')),
    y AS (SELECT kind, action, idle_s FROM x WHERE idle_s > 2 * timeout_s UNION ALL SELECT kind, 'CANCELAR', 0 FROM b)
    SELECT kind, action, count(*) AS jobs, max(idle_s) AS longest_s FROM y GROUP BY GROUPING SETS ((kind, action), (action))""",
    "jobs",
)
def _(get, spark, d):
    return queueing.recovery_summary(get("jobs"), EVENT_NOW)


@query(
    "o08_latest_failures",
    f"x AS (SELECT kind, job_id, {_FAIL} AS failure, row_number() OVER (PARTITION BY kind ORDER BY updated DESC, job_id) AS rank FROM jobs WHERE status IN ('FALHA', 'DEAD_LETTER')) SELECT * FROM x WHERE rank <= 10",
    "jobs",
)
def _(get, spark, d):
    return queueing.latest_failures(get("jobs"), 10)


@query("o08_alert_history", "SELECT alert_id, kind, severity, resolved, created, resolved_at FROM alerts ORDER BY created DESC, alert_id DESC LIMIT 50", "alerts")
def _(get, spark, d):
    return queueing.alert_history(get("alerts"))


@query("q15_transitions", "SELECT status, count(*) FILTER (status IN ('PENDENTE', 'FALHA')) AS cancel, count(*) FILTER (status IN ('FALHA', 'DEAD_LETTER', 'CANCELADO')) AS retry FROM jobs GROUP BY 1", "jobs")
def _(get, spark, d):
    ok = lambda a: F.count_if(queueing.transition_allowed(F.col("status"), F.lit(a))).alias(a)
    return get("jobs").groupBy("status").agg(ok("cancel"), ok("retry"))


@query("s16_purge", f"SELECT job_id FROM jobs WHERE finished < TIMESTAMP '{EVENT_NOW}' - INTERVAL 10 DAY AND status IN ('CONCLUIDO', 'CANCELADO')", "jobs")
def _(get, spark, d):
    return queueing.purged(get("jobs"), "finished", EVENT_NOW, 10, ("CONCLUIDO", "CANCELADO")).select("job_id")


@query(
    "a15_metric_window",
    f"SELECT event_type, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) / count(value) AS mean FROM events WHERE ts >= TIMESTAMP '{EVENT_NOW}' - INTERVAL 72 HOUR GROUP BY 1",
)
def _(get, spark, d):
    return queueing.metric_window(get("events"), EVENT_NOW, 72)


# Sweeps

_DUE = f"""x AS (SELECT doc_id, worker_id, kind, date_diff('day', TIMESTAMP '{NOW}', date_trunc('day', expires)) AS days FROM worker_docs), m AS (SELECT * FROM (VALUES ('2M', 60), ('1M', 30), ('15D', 15), ('3D', 3), ('0D', 0)) AS v(milestone, lead)),
    due AS (SELECT doc_id, worker_id, kind, days, milestone FROM x JOIN m ON days <= lead)"""


@query("j07_milestones", f"{_DUE} SELECT milestone, count(*) AS docs, min(days) AS least FROM due GROUP BY 1", "worker_docs")
def _(get, spark, d):
    return sweeps.milestones_due(get("worker_docs"), NOW).groupBy("milestone").agg(F.count(F.lit(1)).alias("docs"), F.min("days").cast("long").alias("least"))


@query(
    "b01_notifications",
    f"{_DUE} SELECT due.doc_id, milestone, days, name AS worker, user_name FROM due LEFT JOIN workers w ON w.worker_id = due.worker_id LEFT JOIN users u ON u.user_id = w.user_id WHERE NOT (due.doc_id % 2 = 0 AND milestone IN ('2M', '1M')) AND days >= -200",
    "worker_docs workers users",
)
def _(get, spark, d):
    docs = get("worker_docs")
    sent = docs.filter("doc_id % 2 = 0").select("doc_id", F.explode(F.array(F.lit("2M"), F.lit("1M"))).alias("milestone"))
    return sweeps.notifications(docs, get("workers"), get("users"), sent, NOW).filter("days >= -200").withColumn("days", F.col("days").cast("long"))


@query("b07_still_sent", "SELECT doc_id, '2M' AS milestone FROM worker_docs WHERE doc_id % 2 = 0 AND doc_id % 6 <> 0", "worker_docs")
def _(get, spark, d):
    docs = get("worker_docs")
    sent = docs.filter("doc_id % 2 = 0").select("doc_id", F.lit("2M").alias("milestone"))
    after = docs.withColumn("expires", F.when(F.col("doc_id") % 6 == 0, F.col("expires") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("expires")))
    return sweeps.still_sent(sent, docs, after)


@query("b02_renewal_reminders", f"SELECT sub_id, user_id, period_end FROM subscriptions WHERE period_end > TIMESTAMP '{NOW}' AND period_end <= TIMESTAMP '{NOW}' + INTERVAL 3 DAY AND reminded IS NULL AND cancelled IS NULL", "subscriptions")
def _(get, spark, d):
    return sweeps.renewal_reminders(get("subscriptions"), NOW)


@query(
    "r07_subscription_states",
    f"""x AS (SELECT *, coalesce(trial_end > TIMESTAMP '{NOW}', false) AS t, coalesce(period_end > TIMESTAMP '{NOW}', false) AS p FROM subscriptions)
    SELECT sub_id, t OR p AS active, CASE WHEN t OR p THEN NULL WHEN period_end IS NULL THEN 'trial_expirado' ELSE 'assinatura_vencida' END AS reason, contract IS NOT NULL AND cancelled IS NULL AND p AS can_cancel,
    greatest(TIMESTAMP '{NOW}', coalesce(period_end, TIMESTAMP '{NOW}')) + INTERVAL 30 DAY AS extended FROM x""",
    "subscriptions",
)
def _(get, spark, d):
    return sweeps.subscription_states(get("subscriptions"), NOW)


@query(
    "b03_charge_decisions",
    """SELECT payment_id, CASE WHEN p.status <> 'approved' THEN 'status_nao_aprovado' WHEN NOT live THEN 'ambiente_divergente' WHEN c.charge_id IS NULL THEN 'cobranca_nao_encontrada' WHEN p.amount < c.amount - 0.01 THEN 'valor_divergente'
    WHEN p.currency <> c.currency THEN 'moeda_divergente' WHEN charge_status NOT IN ('PENDENTE', 'PROCESSANDO') THEN 'ja_processada' ELSE 'APLICAR' END AS decision FROM payments p LEFT JOIN charges c ON c.charge_id = p.charge_id""",
    "charges payments",
)
def _(get, spark, d):
    return sweeps.charge_decision(get("payments"), get("charges"))


@query(
    "b04_missing_charges",
    "SELECT DISTINCT payment_id AS charge_id, sub_id, price AS amount, 'BRL' AS currency, 'PROCESSANDO' AS charge_status, 'fatura:' || payment_id AS once_key FROM payments p JOIN subscriptions s ON s.contract = 'c' || (p.payment_id // 10) WHERE p.payment_id NOT IN (SELECT charge_id FROM charges WHERE charge_status <> 'RECUSADA')",
    "payments subscriptions charges",
)
def _(get, spark, d):
    invoices = get("payments").select(F.col("payment_id").alias("charge_id"), F.concat(F.lit("c"), F.expr("payment_id div 10")).alias("contract"))
    return sweeps.missing_charges(invoices, get("subscriptions"), get("charges").filter("charge_status <> 'RECUSADA'"))


@query(
    "b05_cancel_decisions",
    f"""x AS (SELECT *, CASE WHEN cancelled IS NOT NULL THEN 'ja_cancelada' WHEN NOT coalesce(period_end > TIMESTAMP '{NOW}', false) THEN 'sem_periodo_vigente' WHEN contract IS NULL THEN 'sem_assinatura_recorrente' END AS reason FROM subscriptions)
    SELECT sub_id, reason IS NULL AS can_cancel, reason, CASE WHEN reason IS NULL OR reason = 'ja_cancelada' THEN period_end END AS access_until FROM x""",
    "subscriptions",
)
def _(get, spark, d):
    return sweeps.cancel_decision(get("subscriptions"), NOW)


@query("b08_in_flight_charges", f"SELECT DISTINCT sub_id FROM charges WHERE charge_status = 'PROCESSANDO' AND handled >= TIMESTAMP '{NOW}' - INTERVAL 30 MINUTE", "charges")
def _(get, spark, d):
    return sweeps.in_flight_guard(get("charges"), NOW, 30)


@query("s17_missing_trials", f"SELECT party_id, TIMESTAMP '{NOW}' + INTERVAL 7 DAY AS trial_end FROM parties WHERE party_id NOT IN (SELECT user_id FROM subscriptions WHERE cancelled IS NULL AND period_end IS NULL)", "parties subscriptions")
def _(get, spark, d):
    return sweeps.missing_subscriptions(get("parties"), get("subscriptions").filter("cancelled IS NULL AND period_end IS NULL"), "party_id", NOW)


# Texts: classification, two extractions, reconciliation, scores, rules


def _texts(spark, d):
    # the narrow facts are spread before texts are rendered, read and judged, by the key that later groups share
    return documents.texts(documents.spread(documents.facts(spark, d)))


def _facts(spark, d):
    return extraction.fiscal_facts(_texts(spark, d))


@query("e01_classify", "SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 1 THEN 'DANFE' ELSE 'NFSE' END AS kind, CASE o_orderkey % 3 WHEN 2 THEN 'DANFSE_V2' ELSE 'MUNICIPAL' END AS layout FROM orders")
def _(get, spark, d):
    return extraction.classify(_texts(spark, d)).select("doc_id", "kind", "layout")


@query(
    "e09_extract_by_labels",
    """SELECT o_orderkey AS doc_id, CAST(o_orderkey AS VARCHAR) AS numero, CAST(CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate ELSE o_orderdate + INTERVAL 3 DAY END AS DATE) AS day, o_totalprice AS gross,
    (CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey % 8 + 1 ELSE o_orderkey % 8 END)::DOUBLE AS rate, 'contato' || o_custkey || '@exemplo.com.br' AS email FROM orders""",
)
def _(get, spark, d):
    w = extraction.values(*extraction.label_reading(extraction.trimmed(_texts(spark, d))))
    return w.select("doc_id", "numero", S.parse_date(F.col("data_emissao")).alias("day"), S.parse_number(F.col("valor_bruto")).alias("gross"), S.parse_number(F.col("aliquota")).alias("rate"), F.col("tomador_email").alias("email"))


@query("e26_extract_by_search", "SELECT o_orderkey AS doc_id, CAST(o_orderkey AS VARCHAR) AS numero, o_totalprice AS gross, 'contato' || o_custkey || '@exemplo.com.br' AS email FROM orders")
def _(get, spark, d):
    w = extraction.values(*extraction.search_reading(_texts(spark, d)))
    return w.select("doc_id", "numero", S.parse_number(F.col("valor_bruto")).alias("gross"), F.col("tomador_email").alias("email"))


@query(
    "e15_withholdings",
    f"WITH {sql.FACTS} SELECT k AS doc_id, " + ", ".join(f"CASE WHEN service THEN CASE WHEN k % 8 = {r} THEN {x} ELSE 0 END END::DOUBLE AS {f}" for f, r, x in documents.WITHHELD) + ", CASE WHEN service THEN held END AS total, CASE WHEN service AND k % 7 <> 3 THEN CASE WHEN k % 7 = 4 THEN '1401' ELSE '14.01' END END AS service_code FROM f",
)
def _(get, spark, d):
    number = lambda c: S.parse_number(F.col(c))
    total = sum((number(c) for c in extraction.WITHHELD), F.lit(0.0))  # unknown if one is
    return _facts(spark, d).select("doc_id", *[number(f).alias(f) for f, _, _ in documents.WITHHELD], total.alias("total"), F.col("codigo_servico").alias("service_code"))


def _compared(spark, d):
    return rules.compare(extraction.both(_texts(spark, d)))


@query("c04_compare", f"WITH {sql.COMPARED} SELECT doc_id, field, value_a, value_b, agreement FROM compared")
def _(get, spark, d):
    return _compared(spark, d).select("doc_id", "field", "value_a", "value_b", "agreement")


@query("c05_resolve", f"WITH {sql.COMPARED} SELECT doc_id, field, critical, value_a, value_b, agreement, value, confidence, winner, how, review FROM resolved")
def _(get, spark, d):
    return rules.resolve(_compared(spark, d)).drop("section", "weight")


_PARTIES = """f(n, name) AS (VALUES (0, 'email'), (1, 'telefone'), (2, 'endereco'), (3, 'inscricao_municipal')),
    x AS (SELECT o_orderkey AS k, name, (o_orderkey + n) % 5 AS c,
        CASE n WHEN 0 THEN 'fornecedor' || o_orderkey || '@exemplo.com.br' WHEN 1 THEN '11 3' || o_orderkey WHEN 2 THEN 'Rua do Fornecedor ' || o_orderkey ELSE CAST(o_orderkey * 10 AS VARCHAR) END AS p,
        CASE n WHEN 0 THEN 'cliente' || o_orderkey || '@exemplo.com.br' WHEN 1 THEN '11 9' || o_orderkey WHEN 2 THEN 'Avenida do Cliente ' || o_orderkey ELSE CAST(o_orderkey * 10 + 5 AS VARCHAR) END AS t FROM orders CROSS JOIN f)"""


def _owned(spark, d):
    compared = rules.compare(extraction.paired(*extraction.party_readings(documents.party_texts(documents.facts(spark, d)))))
    return rules.resolve(compared), rules.own_fields(rules.resolve(compared))


@query(
    "c06_ownership",
    f"WITH {_PARTIES} SELECT 'prestador_' || name AS field, count(*) FILTER (c = 1) AS emptied, count(*) FILTER (c IN (0, 2, 3)) AS kept FROM x GROUP BY 1 UNION ALL SELECT 'tomador_' || name, count(*) FILTER (c IN (0, 2)), count(*) FILTER (c IN (1, 3)) FROM x GROUP BY 1",
)
def _(get, spark, d):
    before, after = _owned(spark, d)
    changed = before.select("doc_id", "field", F.col("value").alias("had")).join(after.select("doc_id", "field", "value"), ["doc_id", "field"])
    return changed.groupBy("field").agg(F.count_if(F.col("had").isNotNull() & F.col("value").isNull()).alias("emptied"), F.count("value").alias("kept"))


@query(
    "c06_exclusive_fields",
    f"""WITH {_PARTIES}
    SELECT k AS doc_id, 'prestador_' || name AS field, CASE WHEN c IN (0, 2, 3) THEN p END AS value, CASE WHEN c IN (0, 2, 3) THEN 90 ELSE 0 END::DOUBLE AS confidence, CASE WHEN c = 1 THEN 'NENHUM' ELSE 'AMBOS' END AS winner FROM x
    UNION ALL SELECT k, 'tomador_' || name, CASE WHEN c IN (1, 3) THEN t END, CASE WHEN c IN (1, 3) THEN 90 ELSE 0 END::DOUBLE, CASE WHEN c IN (0, 2) THEN 'NENHUM' ELSE 'AMBOS' END FROM x""",
)
def _(get, spark, d):
    return _owned(spark, d)[1].select("doc_id", "field", "value", "confidence", "winner")


@query(
    "c07_consolidate",
    f"WITH {sql.COMPARED} SELECT doc_id, floor(sum(confidence * CASE WHEN critical THEN 2 ELSE 1 END) / sum(CASE WHEN critical THEN 2 ELSE 1 END) * 10 + 0.5) / 10 AS confidence, count(*) FILTER (review) AS to_review, false AS blocked FROM resolved GROUP BY 1",
)
def _(get, spark, d):
    return rules.consolidate(rules.resolve(_compared(spark, d)))


@query(
    "c08_agreement_statistics",
    f"""WITH {sql.COMPARED} SELECT doc_id, count(*) FILTER (agreement = 'CONCORDANCIA_TOTAL') AS "full", 0::BIGINT AS functional, 0::BIGINT AS light, count(*) FILTER (agreement = 'DIVERGENCIA_MODERADA') AS moderate, 0::BIGINT AS critical,
    floor(count(*) FILTER (agreement = 'CONCORDANCIA_TOTAL') / count(*) * 100 * 10 + 0.5) / 10 AS agree_percent FROM compared GROUP BY 1""",
)
def _(get, spark, d):
    return rules.agreement_statistics(_compared(spark, d))


def _rules(spark, d):
    return rules.fiscal_rules(_facts(spark, d))


def _scored(spark, d):
    rows, first, second = extraction.facts_and_readings(_texts(spark, d))
    rows, fails = rules.failed_checks(rows)
    compared = rules.compare(extraction.paired(rows, first, second, ("fatal",), {"fails": fails}))
    return rules.field_confidence(rules.resolve(compared))


@query("k03_field_confidence", f"WITH {sql.SCORED} SELECT doc_id, field, score, level, origin, risk, must AS review FROM scored")
def _(get, spark, d):
    return _scored(spark, d).select("doc_id", "field", "score", "level", "origin", "risk", "review")


@query("k05_section_scores", f"WITH {sql.SECTIONS} SELECT doc_id, section, floor(mean * 10 + 0.5) / 10 AS score, problems, problem_fields, weak > 0 OR mean < 70 AS review FROM sections")
def _(get, spark, d):
    return rules.section_scores(_scored(spark, d))


@query(
    "k06_ocr_score",
    f"WITH {sql.COMPARED} SELECT doc_id, floor((100 - sum(CASE WHEN scan THEN 15 * weight ELSE 0 END) / sum(weight)) * 10 + 0.5) / 10 AS ocr_score FROM resolved GROUP BY 1",
)
def _(get, spark, d):
    return rules.ocr_score(_scored(spark, d))


@query(
    "k07_structural_score",
    f"WITH {sql.FACTS} SELECT k AS doc_id, 40 + CASE WHEN service AND k % 7 <> 3 THEN 20 ELSE 0 END + CASE WHEN service THEN 20 + CASE WHEN k % 5 <> 0 THEN 20 ELSE 15 END ELSE 0 END AS structural_score FROM f",
)
def _(get, spark, d):
    return rules.structural_score(_facts(spark, d))


@query("k10_document_scores", f"WITH {sql.DOCUMENTS}")
def _(get, spark, d):
    return rules.document_scores(_scored(spark, d))


@query("g00_fiscal_rules", f"WITH {sql.RULES} SELECT * FROM rules")
def _(get, spark, d):
    return _rules(spark, d)


@query(
    "g00_classification",
    f"""WITH {sql.FACTS} SELECT k AS doc_id, CASE WHEN service AND k % 26 = 0 THEN 'MEI' WHEN simple THEN 'SIMPLES_NACIONAL' ELSE 'DESCONHECIDO' END AS regime_tributario,
    CASE WHEN service AND k % 26 = 0 THEN 'MEI' WHEN service AND k % 4 = 2 THEN 'ME_EPP' WHEN simple THEN 'EMPRESA_GERAL' ELSE 'DESCONHECIDO' END AS tipo_prestador, service AND k % 4 = 0 AS iss_retido, CASE WHEN service AND k % 4 = 0 THEN 'TOMADOR' ELSE 'PRESTADOR' END AS responsavel_iss,
    CASE WHEN service AND k % 5 <> 0 THEN CASE k % 5 WHEN 2 THEN 'Exportação de serviço' WHEN 3 THEN 'Isenta' ELSE 'Tributação no município' END END AS natureza_operacao, CASE WHEN service THEN CASE WHEN k % 4 = 0 THEN 'Retenção' ELSE 'Normal' END END AS situacao_issqn,
    CASE WHEN service THEN CASE WHEN k % 12 = 0 THEN 'Retida' ELSE 'Emitida' END END AS situacao_nfse, CASE WHEN service THEN 'São Paulo - SP' END AS local_prestacao, simple AS simples_nacional FROM f""",
)
def _(get, spark, d):
    return extraction.classification(_facts(spark, d))


@query(
    "g00b_approximate_taxes",
    f"""WITH {sql.FACTS} SELECT k AS doc_id, CASE WHEN approximate THEN {documents.FEDERAL_PERCENT} END::DOUBLE AS federal_pct, CASE WHEN approximate THEN CASE WHEN k % 10 = 9 THEN 3 ELSE 0 END END::DOUBLE AS estadual_val,
    CASE WHEN approximate THEN r + CASE WHEN k % 10 = 5 THEN 1 ELSE 0 END END AS municipal_pct FROM f""",
)
def _(get, spark, d):
    return _facts(spark, d).select("doc_id", *[S.parse_number(F.col(c)).alias(c) for c in ("federal_pct", "estadual_val", "municipal_pct")])


@query("g16_fiscal_alerts", f"WITH {sql.RULES} SELECT doc_id, rule AS alert, severity FROM rules WHERE outcome = 'REPROVADO'")
def _(get, spark, d):
    return rules.fiscal_alerts(_rules(spark, d))


@query("g17_fiscal_confidence", f"WITH {sql.RULES} {sql.CONFIDENCE}")
def _(get, spark, d):
    return rules.fiscal_confidence(_rules(spark, d))


@query(
    "h07_lineage",
    f"WITH {sql.COMPARED} SELECT doc_id, field, 1 AS step, 'METODO_A' AS origin, value_a AS value FROM resolved WHERE value_a IS NOT NULL UNION ALL SELECT doc_id, field, 2, 'METODO_B', value_b FROM resolved WHERE value_b IS NOT NULL UNION ALL SELECT doc_id, field, 3, 'DECISAO', value FROM resolved",
)
def _(get, spark, d):
    return audit.lineage(rules.resolve(_compared(spark, d)))


# Folds


# one correction after the other, as a recursion over each field's rows
_FORM = "(corrected IS NULL OR field NOT IN ('valor_iss', 'valor_servico_fin') OR corrected <> 'abc')"
_OWN = f"100 - CASE WHEN {_FORM} THEN 0 ELSE 40 END - CASE WHEN agreement = 'CONCORDANCIA_TOTAL' AND extracted IS DISTINCT FROM corrected THEN 30 ELSE 0 END - CASE WHEN human THEN 0 ELSE 20 END - CASE WHEN field IN ('numero_nota', 'valor_iss', 'tomador.cpf_cnpj') AND note IS NULL THEN 10 ELSE 0 END"
_STATUS = "CASE WHEN s.frozen THEN 'REJEITADA' WHEN s.two OR (s.v IS NOT NULL AND s.c >= 2 AND r.corrected IS DISTINCT FROM s.v) THEN 'CONGELADA' WHEN r.e THEN 'VALIDADA' ELSE 'REJEITADA' END"
_CORRECTED_LOG = f"""r0 AS (SELECT *, {_OWN} AS own, {_FORM} AND NOT (agreement = 'CONCORDANCIA_TOTAL' AND extracted IS DISTINCT FROM corrected) AND {_OWN} >= 50 AS e FROM corrections),
    r AS (SELECT tenant, field, seq, extracted, corrected, own, e, row_number() OVER (PARTITION BY tenant, field ORDER BY seq) AS n FROM r0),
    sim AS (SELECT DISTINCT tenant, field, 0::BIGINT AS n, NULL::BIGINT AS seq, NULL::VARCHAR AS v, 0 AS c, false AS two, false AS frozen, 0 AS validated, 0 AS sure, 0 AS delta, '' AS status, 0 AS score FROM r
    UNION ALL SELECT t.tenant, t.field, t.n, t.seq, CASE WHEN t.status = 'VALIDADA' THEN coalesce(t.v, t.corrected) ELSE t.v END, CASE WHEN t.status = 'VALIDADA' AND t.corrected IS NOT NULL AND t.corrected = coalesce(t.v, t.corrected) THEN t.c + 1 ELSE t.c END,
        t.two OR coalesce(t.status = 'VALIDADA' AND t.corrected IS NOT NULL AND t.corrected <> coalesce(t.v, t.corrected), false), t.frozen OR t.status = 'CONGELADA', t.validated + CASE WHEN t.status = 'VALIDADA' THEN 1 ELSE 0 END,
        t.sure + CASE WHEN t.status = 'VALIDADA' AND t.extracted IS NOT DISTINCT FROM t.corrected THEN 1 ELSE 0 END,
        greatest(-20, least(20, t.delta + CASE WHEN t.status <> 'VALIDADA' THEN 0 WHEN t.extracted IS NOT DISTINCT FROM t.corrected THEN 5 WHEN t.validated + 1 >= 3 THEN -8 ELSE 0 END)), t.status,
        CASE WHEN t.frozen THEN 0 WHEN t.status = 'CONGELADA' THEN greatest(0, t.own - 50) ELSE t.own END
    FROM (SELECT r.*, s.v, s.c, s.two, s.frozen, s.validated, s.sure, s.delta, {_STATUS} AS status FROM sim s JOIN r ON r.tenant = s.tenant AND r.field = s.field AND r.n = s.n + 1) t)"""


def _recursive(statement: str) -> str:
    return with_tables(f"{_CORRECTED_LOG} {statement}", "corrections").replace("WITH ", "WITH RECURSIVE ", 1)


def _judged(get):
    return learning.judged(get("corrections"))


@query("m04_judged_corrections", _recursive("SELECT seq AS correction_id, status, score FROM sim WHERE n > 0"))
def _(get, spark, d):
    return _judged(get).select("correction_id", "status", F.col("score").cast("int").alias("score"))


@query("m05_contradictions", _recursive("SELECT a.tenant, a.field, (SELECT count(DISTINCT r.corrected) FROM r JOIN sim b ON b.seq = r.seq WHERE b.status = 'VALIDADA' AND r.tenant = a.tenant AND r.field = a.field) AS values, a.seq AS frozen_at FROM sim a WHERE a.status = 'CONGELADA'"))
def _(get, spark, d):
    return learning.contradictions(_judged(get))


@query(
    "m07_learning",
    _recursive("SELECT tenant, field, arg_max(validated, n)::BIGINT AS validated, arg_max(sure, n)::BIGINT AS confirmations, CASE WHEN max(validated) >= 7 THEN 'PADRAO_CONSOLIDADO' WHEN max(validated) >= 5 THEN 'CONFIANCA' WHEN max(validated) >= 3 THEN 'HEURISTICA' ELSE 'MEMORIA' END AS level, arg_max(delta, n) AS delta, bool_or(frozen) AS frozen FROM sim GROUP BY 1, 2"),
)
def _(get, spark, d):
    return learning.knowledge(_judged(get))


_LOW, _HIGH = "lower(extracted)", "lower(corrected)"
_SCAN = lambda t: "".join(["replace("] * len(learning.CONFUSED)) + t + "".join(f", '{a}', '{b}')" for a, b in learning.CONFUSED)
_TYPE = f"""CASE WHEN extracted IS NULL AND corrected IS NOT NULL THEN 'ERRO_ANCORA' WHEN corrected IS NULL THEN 'ERRO_EXTRACAO_PARCIAL'
    WHEN extracted = corrected AND NOT (field IN ('valor_iss', 'valor_servico_fin') AND corrected = 'abc') THEN 'ERRO_FORMATACAO' WHEN field IN ('valor_iss', 'valor_servico_fin') AND extracted = '1010,00' AND corrected = '1.010,00' THEN 'ERRO_FORMATACAO'
    WHEN levenshtein({_LOW}, {_HIGH}) <= 3 AND ({_SCAN(_LOW)} = {_HIGH} OR {_SCAN(_HIGH)} = {_LOW}) THEN 'ERRO_OCR' WHEN field = 'valor_servico_fin' THEN 'ERRO_INFERENCIA' WHEN field = 'valor_iss' THEN 'ERRO_VALIDACAO_FISCAL'
    WHEN field = 'tomador.cpf_cnpj' AND section = 'prestador' THEN 'ERRO_ASSOCIACAO_SECAO' WHEN confidence >= 90 THEN 'ERRO_CLASSIFICACAO_CONFIANCA' WHEN starts_with(extracted, 'Data') THEN 'ERRO_FRONTEIRA' ELSE 'ERRO_ANCORA' END"""
_TYPED = f"ty AS (SELECT correction_id, field, agreement, winner, extracted, corrected, {_TYPE} AS type FROM corrections)"


@query(
    "m01_error_types",
    f"""{_TYPED} SELECT correction_id, field, type, CASE WHEN type = 'ERRO_FORMATACAO' OR (extracted IS NULL AND corrected IS NULL) THEN 'BAIXA' WHEN type IN ('ERRO_VALIDACAO_FISCAL', 'ERRO_ASSOCIACAO_SECAO', 'ERRO_FRONTEIRA') THEN 'ALTA' WHEN type = 'ERRO_CLASSIFICACAO_CONFIANCA' THEN 'MEDIA'
    WHEN field <> 'servico.descricao' THEN 'CRITICA' ELSE 'MEDIA' END AS severity, CASE WHEN agreement = 'DIVERGENCIA_CRITICA' THEN 'DESCONHECIDO' WHEN winner = 'A' THEN 'METODO_A' WHEN winner = 'B' THEN 'METODO_B' WHEN winner = 'AMBOS' THEN 'AMBOS' ELSE 'DESCONHECIDO' END AS origin FROM ty""",
    "corrections",
)
def _(get, spark, d):
    return learning.error_types(get("corrections"))


@query(
    "m03_impacts",
    f"""{_TYPED} SELECT correction_id, 'ancora' AS kind, field AS target FROM ty WHERE type IN ('ERRO_ANCORA', 'ERRO_VALIDACAO_FISCAL', 'ERRO_ASSOCIACAO_SECAO', 'ERRO_EXTRACAO_PARCIAL') OR (type = 'ERRO_FRONTEIRA' AND field = 'tomador.cpf_cnpj')
    UNION ALL SELECT correction_id, 'heuristica', field FROM ty WHERE type IN ('ERRO_ANCORA', 'ERRO_OCR', 'ERRO_FORMATACAO', 'ERRO_INFERENCIA', 'ERRO_VALIDACAO_FISCAL', 'ERRO_CLASSIFICACAO_CONFIANCA')
    UNION ALL SELECT correction_id, 'fronteira', CASE WHEN type = 'ERRO_EXTRACAO_PARCIAL' THEN string_split(field, '.')[1] ELSE CASE string_split(field, '.')[1] WHEN 'tomador' THEN 'tomador' WHEN 'servico' THEN 'servicos' ELSE 'financeiro' END END FROM ty WHERE type IN ('ERRO_FRONTEIRA', 'ERRO_EXTRACAO_PARCIAL')
    UNION ALL SELECT correction_id, 'fronteira', unnest(['prestador', 'tomador']) FROM ty WHERE type = 'ERRO_ASSOCIACAO_SECAO'""",
    "corrections",
)
def _(get, spark, d):
    return learning.impacts(learning.error_types(get("corrections")))


@query(
    "m09_reprocessed",
    f"WITH {sql.SCORED}, kn AS (SELECT * FROM (VALUES ('valor_iss', -8), ('numero', 5), ('aliquota', -20)) AS v(field, delta)), a AS (SELECT s.*, greatest(0.0, least(100.0, score + coalesce(delta, 0))) AS then FROM scored s LEFT JOIN kn USING (field)), b AS (SELECT doc_id, floor(sum(score * weight) / sum(weight) * 10 + 0.5) / 10 AS before, floor(sum(a.then * weight) / sum(weight) * 10 + 0.5) / 10 AS after, count(*) FILTER (a.then > score) AS better, count(*) FILTER (a.then < score) AS worse FROM a GROUP BY 1) SELECT *, floor((after - before) * 10 + 0.5) / 10 AS change FROM b",
)
def _(get, spark, d):
    known = spark.createDataFrame([("valor_iss", -8), ("numero", 5), ("aliquota", -20)], "field string, delta int")
    return learning.reprocessed(_scored(spark, d), known)


@query("q16_rate_limits")
def _(get, spark, d):
    return folds.rate_limited(get("events"), 5, 900)
