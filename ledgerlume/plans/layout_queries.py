"""Queries over texts of further layouts; the SQL states what each text says and never reads it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import baselines, candidates, goods, national, services, versions
from ..sources import layouts
from ..streaming import effects
from .invoice_sql import _company
from .registry import query

#: One row per product line (k, pos among those that can be read) and what its text says.
_ITEMS = """it0 AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, CAST(round(l_extendedprice * 100) AS BIGINT) AS c, CAST(l_quantity AS BIGINT) AS q, l_orderkey + l_linenumber AS cs, upper(p_name) AS name, p_size,
        CASE p_size % 3 WHEN 0 THEN 'UN' WHEN 1 THEN 'MT' ELSE 'pc' END AS unit FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey IN (SELECT o_orderkey FROM orders)),
    it AS (SELECT *, CASE WHEN cs % 11 = 0 THEN c * 105 // 100 ELSE c END AS stated, c * 10000 // q AS price, cs % 17 <> 0 AS named, cs % 17 <> 0 AND cs % 13 <> 0 AS whole FROM it0)"""
_SUMS = f"""{_ITEMS}, sums AS (SELECT k, count(*) FILTER (named) AS n_items, CAST(coalesce(sum(stated) FILTER (whole), 0) AS BIGINT) AS said,
        sum(CASE WHEN NOT named THEN 0 WHEN NOT whole THEN 40 WHEN cs % 11 = 0 THEN 70 ELSE 98 END) AS sure FROM it GROUP BY k),
    doc0 AS (SELECT k, CASE WHEN k % 19 = 0 THEN 0 ELSE n_items END AS n_items, CASE WHEN k % 19 = 0 THEN 0 ELSE said END AS cents, CASE WHEN k % 15 <> 4 THEN CASE WHEN k % 6 = 0 THEN said * 105 // 100 ELSE said END END AS total_cents,
        CASE WHEN k % 19 = 0 OR n_items = 0 THEN 0 ELSE floor(sure / n_items + 0.5) END AS sure FROM sums),
    doc AS (SELECT *, NOT coalesce(cents > 0 AND abs(cents - total_cents) > greatest(10, total_cents * 0.02), false) AS ok FROM doc0)"""


@query(
    "e21_product_lines",
    f"""WITH {_ITEMS} SELECT k AS doc_id, CAST(row_number() OVER (PARTITION BY k ORDER BY n, p, c, q) AS INT) AS pos, name || CASE WHEN whole THEN ' 50 X ' || p_size ELSE '' END AS description, CASE WHEN whole THEN upper(unit) END AS unit,
        CASE WHEN whole THEN q::DOUBLE END AS quantity, CASE WHEN whole THEN price / 1000000 END AS unit_price, CASE WHEN whole THEN stated / 100 END AS total, CASE WHEN NOT whole THEN 40 WHEN cs % 11 = 0 THEN 70 ELSE 98 END AS confidence
        FROM it WHERE named AND k % 19 <> 0""",
)
def _(get, spark, d):
    return goods.product_lines(layouts.goods_texts(spark, d))


@query(
    "w08_row_groups",
    f"""WITH {_ITEMS}, r AS (SELECT *, cs % 4 = 0 AND named AS broken FROM it) SELECT k AS doc_id, CAST(row_number() OVER (PARTITION BY k ORDER BY n, p, c, q) AS INT) AS group,
        CAST(1 + CASE WHEN broken THEN len(name) - len(replace(name, ' ', '')) ELSE 0 END + CASE WHEN whole AND cs % 8 = 0 THEN 1 ELSE 0 END AS INT) AS n_lines,
        (p + 1000000) || CASE WHEN NOT named THEN ' X' WHEN NOT whole THEN name ELSE name || ' 50 X ' || p_size || '730640000605102' || unit || q || ',0000' || price // 1000000 || ',' || lpad(CAST(price % 1000000 AS VARCHAR), 6, '0')
            || stated // 100 || ',' || lpad(CAST(stated % 100 AS VARCHAR), 2, '0') || '0,0018,00' END AS record FROM r WHERE k % 19 <> 0""",
)
def _(get, spark, d):
    lines = goods.table_lines(layouts.goods_texts(spark, d))
    return goods.row_groups(lines, F.col("line").rlike(goods.RECORD)).select("doc_id", "group", "n_lines", "record")


@query(
    "a29_product_reconciliation",
    f"WITH {_SUMS} SELECT k AS doc_id, CAST(n_items AS INT) AS n_items, cents / 100 AS product_sum, total_cents / 100 AS total, CAST(sure AS DOUBLE) AS product_confidence, ok AS reconciles FROM doc",
)
def _(get, spark, d):
    rows = goods.goods_invoices(layouts.goods_texts(spark, d))
    return rows.select("doc_id", F.size("products").alias("n_items"), S.js_round(F.col("product_sum"), 2).alias("product_sum"), "total", "product_confidence", "reconciles")


@query(
    "e20_goods_invoices",
    f"""WITH {_SUMS}, {_company('orders', 'o_custkey', 7_919_333, 'sup')}, {_company('orders', 'o_orderkey', 104_729_111, 'own')},
    said AS (SELECT doc.*, o_custkey, CASE WHEN k % 5 = 0 THEN sup.shown[1:17] || (CAST(sup.shown[18] AS INT) + 1) % 10 ELSE sup.shown END AS supplier_id, own.shown AS recipient_id, o_orderdate,
        CASE WHEN k % 14 <> 0 THEN 90 ELSE 0 END AS c1, CASE WHEN k % 5 = 0 THEN 55 ELSE 95 END AS c2, CASE WHEN k <> 0 THEN 90 ELSE 0 END AS c3, CASE WHEN k % 9 <> 0 THEN 85 ELSE 0 END AS c4, CASE WHEN k % 10 <> 2 THEN 90 ELSE 0 END AS c5, CASE WHEN total_cents IS NOT NULL THEN 95 ELSE 0 END AS c6
        FROM doc JOIN orders ON o_orderkey = k JOIN sup USING (k) JOIN own USING (k))
    SELECT k AS doc_id, CASE WHEN c1 > 0 THEN 'Materiais ' || o_custkey || ' Ltda' END AS supplier, supplier_id, recipient_id, CASE WHEN c3 > 0 THEN CAST(k AS VARCHAR) END AS number, CASE WHEN c4 > 0 THEN CAST(k % 100 AS VARCHAR) END AS series,
        CASE WHEN c5 > 0 THEN strftime(o_orderdate, '%d/%m/%Y') END AS issued, total_cents / 100 AS total, CAST(floor((2 * c1 + 2 * c2 + c3 + c4 + c5 + 2 * c6 + 2 * sure) / 11 * CASE WHEN ok THEN 1.0::DOUBLE ELSE 0.55::DOUBLE END + 0.5) AS INT) AS confidence,
        concat_ws(',', CASE WHEN c1 = 0 THEN 'supplier' END, CASE WHEN c3 = 0 THEN 'number' END, CASE WHEN c4 = 0 THEN 'series' END, CASE WHEN c5 = 0 THEN 'issued' END, CASE WHEN c6 = 0 THEN 'total' END, CASE WHEN n_items = 0 THEN 'products' END) AS missing,
        concat_ws(',', CASE WHEN c2 = 55 THEN 'supplier_id' END, CASE WHEN sure BETWEEN 1 AND 59 THEN 'products' END) AS unsure, concat_ws(',', CASE WHEN c2 = 55 THEN 'supplier_id' END, CASE WHEN NOT ok THEN 'product_sum' END) AS inconsistent FROM said""",
)
def _(get, spark, d):
    rows = goods.goods_invoices(layouts.goods_texts(spark, d)).drop("products", "product_sum", "product_confidence", "reconciles")
    return rows.withColumns({c: F.array_join(c, ",") for c in ("missing", "unsure", "inconsistent")})


#: What the texts of `layouts.critical_texts` say; `far` lines stand between the first lines and the labels.
_CRITICAL = """o AS (SELECT o_orderkey AS k, o_orderkey % 3 * 10 AS far, o_orderkey % 11 AS c, o_orderkey % 10 <> 0 AS ei, o_orderkey % 7 <> 0 AS en, o_orderkey % 8 <> 0 AS ec, o_orderkey % 6 = 0 AS seventy, o_orderkey % 5 <> 0 AS own, o_orderkey % 4 = 0 AS city, o_orderkey % 9 <> 0 AS coded,
        CASE WHEN o_orderkey % 11 = 4 THEN '31/02/2025 25:00:00' ELSE strftime(o_orderdate + INTERVAL 10 YEAR, '%d/%m/%Y') || ' 10:20:30' END AS d1, strftime(o_orderdate + INTERVAL 1 DAY + INTERVAL 10 YEAR, '%d/%m/%Y') || ' 11:00:00' AS d2 FROM orders),
    p AS (SELECT *, CASE WHEN seventy AND (NOT en OR far = 0 OR NOT own) THEN '77' WHEN own THEN CAST(k AS VARCHAR) WHEN en THEN CAST(k + 10000000 AS VARCHAR) ELSE '123456789' END AS nv,
        CASE WHEN city AND (NOT ec OR NOT coded) THEN 'PREFEITURA' WHEN coded THEN 'AB' || lpad(CAST(k AS VARCHAR), 8, '0') END AS cv FROM o),
    found AS (
        SELECT k, 'number' AS field, nv AS value, 35 + CASE WHEN own OR seventy THEN 20 ELSE 0 END + CASE WHEN en THEN 40 + CASE WHEN nv = '77' AND far = 20 THEN 0 ELSE 5 END ELSE 0 END AS s,
            CASE WHEN NOT own AND NOT seventy THEN 'fallback_any_numeric' WHEN en THEN 'short_numeric_closest_anchor' ELSE 'short_numeric_first' END AS method FROM p
        UNION ALL SELECT k, 'code', cv, CASE WHEN cv IS NULL THEN 0 ELSE 55 + CASE WHEN city AND coded THEN 0 ELSE 10 END + CASE WHEN ec THEN 20 + CASE WHEN cv = 'PREFEITURA' AND far = 20 THEN 0 ELSE 15 END ELSE 0 END END,
            CASE WHEN cv IS NULL THEN 'sem_candidatos' WHEN ec THEN 'pattern_com_ancora' ELSE 'pattern_sem_ancora' END FROM p
        UNION ALL SELECT k, 'issued', CASE WHEN c = 3 THEN NULL WHEN c = 0 AND ei THEN d2 ELSE d1 END, CASE WHEN c = 3 THEN 0 ELSE 40 + CASE WHEN c <> 2 THEN 10 ELSE 0 END + CASE WHEN c <> 4 THEN 20 ELSE 0 END + CASE WHEN ei THEN 30 ELSE 0 END END,
            CASE WHEN c = 3 THEN 'sem_datas' WHEN c = 0 AND ei THEN 'proximity_swap' WHEN c = 2 THEN 'unica_data_compartilhada' ELSE 'stream_order_primeiro' END FROM p
        UNION ALL SELECT k, 'event', CASE WHEN c = 3 THEN NULL WHEN c = 2 OR (c = 0 AND ei) THEN d1 ELSE d2 END, CASE c WHEN 3 THEN 0 WHEN 2 THEN 90 ELSE 100 END,
            CASE WHEN c = 3 THEN 'sem_datas' WHEN c = 0 AND ei THEN 'proximity_swap' WHEN c = 2 THEN 'unica_data_compartilhada' ELSE 'stream_order_segundo' END FROM p)"""
_LEVEL = "CASE WHEN {0} >= 90 THEN 'alta' WHEN {0} >= 70 THEN 'media' WHEN {0} >= 50 THEN 'baixa' ELSE 'nula' END"


@query("j17_nearest_candidates", f"WITH {_CRITICAL} SELECT k AS doc_id, field, value, s AS confidence, {_LEVEL.format('s')} AS level, method FROM found")
def _(get, spark, d):
    return candidates.long_form(candidates.critical_fields(layouts.critical_texts(spark, d)))


@query("e08_critical_bundle", f"WITH {_CRITICAL}, m AS (SELECT k, CAST(floor(sum(s) / 4 + 0.5) AS INT) AS s FROM found GROUP BY k) SELECT k AS doc_id, s AS confidence, {_LEVEL.format('s')} AS level FROM m")
def _(get, spark, d):
    return candidates.critical_fields(layouts.critical_texts(spark, d)).select("doc_id", "confidence", "level")


@query(
    "e22_national_invoices",
    f"""WITH {_company('orders', 'o_custkey', 7_919_333, 'sup')}, x AS (SELECT o_orderkey AS k, o_custkey AS cust, strftime(o_orderdate, '%d/%m/%Y') AS day, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, shown FROM orders JOIN sup ON sup.k = o_orderkey),
    y AS (SELECT *, cents * (k % 8) // 100 AS iss, k % 17 <> 0 AS keyed, k % 13 <> 0 AS bought, k % 19 <> 0 AS summed, k % 23 <> 0 AS served, CASE WHEN k % 9 <> 0 THEN k % 2 = 1 END AS withheld FROM x)
    SELECT k AS doc_id, CASE WHEN keyed THEN lpad(CAST(k AS VARCHAR), 50, '5') END AS access_key, CASE WHEN keyed THEN CAST(k AS VARCHAR) END AS number, CASE WHEN keyed THEN day END AS competence, CASE WHEN keyed THEN day || ' 14:47:16' END AS issued, CASE WHEN keyed THEN day || ' 15:00:00' END AS dps_issued,
        CASE WHEN keyed THEN CAST(k % 1000 AS VARCHAR) END AS dps_number, CASE WHEN keyed THEN '1' END AS dps_series, shown AS provider_id, 'Prestadora ' || cust || ' Ltda' AS provider_name, CASE WHEN k % 3 <> 0 THEN 'p' || k || '@exemplo.com.br' END AS provider_email,
        '(11) 3000-0000' AS provider_phone, CASE WHEN k % 4 <> 0 THEN CAST(k AS VARCHAR) END AS provider_registration, 'Rua Um, 1' AS provider_address, '79800-000' AS provider_zip, 'Dourados' AS provider_town, 'MS' AS provider_state,
        CASE WHEN bought AND k % 11 <> 0 THEN '111.222.' || lpad(CAST(k % 1000 AS VARCHAR), 3, '0') || '-09' END AS customer_id, CASE WHEN bought THEN 'Cliente ' || k END AS customer_name, CASE WHEN bought AND k % 2 = 1 THEN 'c' || k || '@exemplo.com.br' END AS customer_email,
        CASE WHEN bought THEN 'Rua Dois, 2' END AS customer_address, CASE WHEN bought THEN '01310-100' END AS customer_zip, CASE WHEN bought THEN 'Campo Grande' END AS customer_town, CASE WHEN bought THEN 'MS' END AS customer_state,
        CASE WHEN k % 6 <> 0 THEN true END AS simple, CASE WHEN k % 6 <> 0 THEN 'SIMPLES_NACIONAL' WHEN k % 7 <> 0 THEN 'Regime geral' END AS tax_regime, CASE WHEN k % 3 <> 1 THEN iss / 100 END AS ir, 11.0::DOUBLE AS inss, NULL::DOUBLE AS pis, 3.5::DOUBLE AS cofins, cents / 100 AS base,
        'Operação Tributável' AS iss_taxation, (k % 8)::DOUBLE AS rate, CASE WHEN k % 9 <> 0 THEN iss / 100 END AS iss, withheld, CASE WHEN withheld THEN 'Retido pelo Tomador' WHEN NOT withheld THEN 'Devido pelo Prestador' END AS iss_owed, 'Dourados - MS' AS iss_town, 'Brasil' AS result_country,
        CASE WHEN k % 4 <> 1 THEN 'Nenhum' END AS special_regime, cents / 100 AS gross, CASE WHEN NOT summed THEN cents / 100 WHEN k % 5 = 0 THEN 0.0 ELSE (cents - iss) / 100 END AS net, CASE WHEN summed THEN floor(cents / 100 * 13.45::DOUBLE / 100 * 100 + 0.5) / 100 END AS approximate_taxes, '1200' || k AS nbs,
        CASE WHEN served THEN '14.01.01' END AS national_code, CASE WHEN served THEN 'Dourados - MS' END AS place, CASE WHEN served THEN 'Manutenção ' || k END AS description,
        concat_ws(',', CASE WHEN NOT bought OR k % 11 = 0 THEN 'tomador.cpf_cnpj' END, CASE WHEN NOT keyed THEN 'numero_nota,data_emissao,chave_acesso_nfse' END) AS missing FROM y""",
)
def _(get, spark, d):
    rows = national.national_invoices(layouts.national_texts(spark, d)).withColumn("missing", F.array_join("missing", ","))
    return rows.drop("customer_phone", "customer_registration", "immunity", "suspension", "suspension_case", "benefit", "municipal_code", "country")


#: What the run-on line of every order's service text says: its amounts (v in ten-thousandths, d4: four decimals) in order.
_SERVICES = """s0 AS (SELECT o_orderkey AS k, o_orderpriority AS priority, o_orderkey % 8 AS m, CAST(round(o_totalprice * 100) AS BIGINT) % 3000000 + 2000000 AS c,
        CASE WHEN o_orderkey % 8 = 2 THEN o_orderkey % 80 + 10 ELSE o_orderkey % 9 + 1 END AS q, o_orderkey % 4 * 25 + 500 AS rate FROM orders),
    s1 AS (SELECT *, (c * rate + 5000) // 10000 + CASE WHEN m = 7 THEN 100 ELSE 0 END AS tax, c * 100 // q AS price FROM s0),
    s2 AS (SELECT *, [{'v': c * 100, 'd4': true}, {'v': c * 100, 'd4': false}, {'v': rate * 100, 'd4': false}] AS head FROM s1),
    s3 AS (SELECT *, CASE WHEN m IN (0, 1) THEN [] WHEN m = 4 THEN head[1:1] WHEN m = 2 THEN head || [{'v': tax * 100 + q, 'd4': true}, {'v': price, 'd4': true}]
        WHEN m = 3 THEN head || [{'v': tax * 100, 'd4': false}, {'v': q * 10000, 'd4': true}, {'v': price, 'd4': true}, {'v': 0, 'd4': false}]
        ELSE head || [{'v': tax * 100, 'd4': false}, {'v': q * 10000, 'd4': true}, {'v': price, 'd4': true}] END AS t FROM s2),
    s4 AS (SELECT *, len(t) AS n, list_sort(list_transform(t, lambda x: x.v)) AS z FROM s3),
    s5 AS (SELECT *, CASE WHEN n = 6 THEN t[1].v WHEN n >= 2 THEN z[n] END AS v1, CASE WHEN n = 6 THEN t[2].v WHEN n >= 2 THEN z[n - 1] END AS v2,
        CASE WHEN n = 6 THEN t[3].v WHEN n >= 2 THEN list_filter(t, lambda x: x.v % (CASE WHEN x.d4 THEN 100 ELSE 10000 END) <> 0 OR x.v <= 1000000)[1].v END AS v3,
        CASE WHEN n = 6 THEN t[4].v WHEN n >= 2 THEN z[1] END AS v4, CASE WHEN n = 6 THEN t[5].v WHEN n >= 2 THEN list_filter(t, lambda x: x.d4 AND x.v < 100000000)[1].v END AS v5,
        CASE WHEN n = 6 THEN t[6].v WHEN n >= 3 THEN z[n - 2] END AS v6 FROM s4),
    svc AS (SELECT k, m, n, c, tax, v1 / 10000 AS service_value, v2 / 10000 AS base, v3 / 10000 AS rate, v4 / 10000 AS tax_read, v5 / 10000 AS quantity, v6 / 10000 AS unit_price,
        CASE WHEN m <> 0 THEN 'Manutenção ' || priority || CASE WHEN k % 3 = 0 THEN ' Contrato ' || k ELSE '' END END AS description,
        CASE WHEN m <> 0 AND k % 6 <> 0 THEN CAST(k AS VARCHAR) END AS of_number, CASE WHEN m <> 0 AND k % 7 <> 3 THEN '14.01' END AS code, t FROM s5)"""


def _conf(value: str) -> str:
    return f"CASE WHEN m = 0 THEN 30 WHEN m = 1 THEN 40 WHEN {value} IS NULL THEN 55 WHEN n = 6 THEN 88 ELSE 60 END"


def _services(spark, d):
    return services.service_fields(layouts.service_texts(spark, d))


@query("x10_run_on_amounts", f"WITH {_SERVICES} SELECT k AS doc_id, CAST(i AS INT) AS pos, t[i].v / 10000 AS amount FROM (SELECT k, t, unnest(generate_series(1, n)) AS i FROM svc)")
def _(get, spark, d):
    lines = layouts.service_texts(spark, d).select("doc_id", F.regexp_extract("text", r"DISCRIMINAÇÃO[\s\S]*\nx=(.*)", 1).alias("line"))
    return lines.select("doc_id", F.posexplode_outer(services.amounts(F.col("line"))).alias("pos", "amount")).filter("amount IS NOT NULL").select("doc_id", (F.col("pos") + 1).alias("pos"), services.number(F.col("amount")).alias("amount"))


@query(
    "e11_service_zone",
    f"""WITH {_SERVICES}, sure AS (SELECT *, CASE WHEN m = 0 THEN 30 WHEN k % 3 = 0 THEN 95 ELSE 90 END AS c_text, CASE WHEN m = 0 THEN 30 WHEN of_number IS NULL THEN 40 ELSE 95 END AS c_order, CASE WHEN m = 0 THEN 30 WHEN code IS NULL THEN 40 ELSE 92 END AS c_code,
        {_conf('service_value')} AS c1, {_conf('base')} AS c2, {_conf('rate')} AS c3, {_conf('tax_read')} AS c4, {_conf('quantity')} AS c5, {_conf('unit_price')} AS c6 FROM svc)
    SELECT k AS doc_id, m <> 0 AS has_zone, CAST(n AS INT) AS n_amounts, description, of_number, code, CASE WHEN code IS NULL THEN 'campo_ausente' WHEN k % 7 = 5 THEN 'label_fora_da_zona' ELSE 'label_apos_zona' END AS code_how,
        service_value, base, rate, tax_read, quantity, unit_price, CASE WHEN v1_null THEN 'campo_ausente' WHEN n = 6 THEN 'positional_parse' ELSE 'heuristic_fallback' END AS value_how,
        CASE WHEN m = 0 THEN 0 ELSE (c_text * 20 + c_order * 10 + c5 * 10 + c6 * 10 + c1 * 20 + c2 * 10 + c3 * 10 + c4 * 10 + c_code * 8) / 108 END AS confidence
        FROM (SELECT *, service_value IS NULL AS v1_null FROM sure)""",
)
def _(get, spark, d):
    n = lambda f: services.number(F.col(f)).alias({"tax": "tax_read"}.get(f, f))
    return _services(spark, d).select("doc_id", "has_zone", "n_amounts", "description", F.col("order").alias("of_number"), "code", "code_how", *[n(f) for f in services.VALUES], F.col("service_value_how").alias("value_how"), "confidence")


@query(
    "e12_service_checks",
    f"WITH {_SERVICES} SELECT k AS doc_id, abs(quantity * unit_price - service_value) <= 0.02 AS product_fits, abs(service_value * rate / 100 - tax_read) <= 0.02 AS tax_fits FROM svc",
)
def _(get, spark, d):
    return services.service_checks(_services(spark, d))


@query(
    "e16_tax_table",
    f"WITH {_SERVICES} SELECT k AS doc_id, CASE WHEN m <> 6 THEN c / 100 END AS base, CASE WHEN m <> 6 THEN 90 ELSE 40 END AS base_conf, CASE WHEN m <> 6 THEN tax / 100 END AS tax, CASE WHEN m <> 6 THEN 88 ELSE 40 END AS tax_conf FROM svc",
)
def _(get, spark, d):
    rows = services.tax_table(layouts.service_texts(spark, d))
    return rows.select("doc_id", services.number(F.col("base")).alias("base"), "base_conf", services.number(F.col("tax")).alias("tax"), "tax_conf")


#: Paths that differ between two runs' records of every order: the amount, the third item's members, or all of them.
_CHANGES = """o AS (SELECT o_orderkey AS k, 'nota-' || o_orderkey || '.pdf' AS file, CAST(floor(o_totalprice) AS BIGINT) AS gross, o_orderstatus AS kind, o_orderkey % 7 AS r FROM orders),
    ch AS (SELECT file, 'resultado.valores.bruto' AS path, CAST(gross AS VARCHAR) AS before, CAST(gross + 5 AS VARCHAR) AS after FROM o WHERE k % 4 = 1 AND k % 10 NOT IN (0, 1)
        UNION ALL SELECT file, unnest(['resultado.valores.itens.2.q', 'resultado.valores.itens.2.v']), NULL, unnest([CAST(r + 3 AS VARCHAR), CAST(k * 3 AS VARCHAR)]) FROM o WHERE k % 4 = 2 AND k % 10 NOT IN (0, 1)
        UNION ALL SELECT file, unnest(['roteamento.tipo', 'resultado.numero', 'resultado.valores.bruto', 'resultado.valores.itens.0.q', 'resultado.valores.itens.0.v', 'resultado.valores.itens.1.q', 'resultado.valores.itens.1.v',
            'resultado.aviso', 'roteamento', 'resultado', 'erro']), unnest([kind, CAST(k AS VARCHAR), CAST(gross AS VARCHAR), CAST(r + 1 AS VARCHAR), CAST(k AS VARCHAR), CAST(r + 2 AS VARCHAR), CAST(k * 2 AS VARCHAR), 'null', NULL, NULL, 'undefined']),
            unnest([NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'undefined', 'undefined', 'falha ' || k]) FROM o WHERE k % 4 = 3 AND k % 10 NOT IN (0, 1)),
    st AS (SELECT o.file, CASE WHEN k % 10 = 0 THEN 'NOVO' WHEN k % 10 = 1 THEN 'SUMIU' WHEN k % 4 = 0 THEN 'IDENTICO' WHEN k % 3 = 0 THEN 'ESPERADO' ELSE 'ALTERADO' END AS state,
        CASE WHEN k % 10 IN (0, 1) THEN 0 ELSE [0, 1, 2, 11][k % 4 + 1] END::BIGINT AS n_changes FROM o)"""


def _runs(spark, d):
    return layouts.result_records(spark, d, False), layouts.result_records(spark, d, True)


def _states(spark, d):
    runs = _runs(spark, d)
    k = F.regexp_extract("file", r"(\d+)", 1).cast("long")
    return baselines.file_states(*runs, baselines.changes(*runs), runs[1].filter(k % 3 == 0))


@query("j13_baseline_changes", f"WITH {_CHANGES} SELECT * FROM ch")
def _(get, spark, d):
    return baselines.changes(*_runs(spark, d))


@query("j13_baseline_files", f"WITH {_CHANGES} SELECT * FROM st")
def _(get, spark, d):
    return _states(spark, d)


@query(
    "j13_baseline_verdict",
    f"""WITH {_CHANGES} SELECT count(*) FILTER (state <> 'NOVO') AS compared, count(*) FILTER (state = 'ESPERADO') AS expected, count(*) FILTER (state IN ('SUMIU', 'ALTERADO')) AS unexpected,
        count(*) FILTER (state = 'NOVO') AS new, count(*) FILTER (state IN ('SUMIU', 'ALTERADO')) > 0 AS regression FROM st""",
)
def _(get, spark, d):
    return baselines.verdict(_states(spark, d))


#: Orders of a customer as versions of one document; a note is there for two thirds, a total that is null for some.
_VERSIONS = """v AS (SELECT o_custkey AS document, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version, * FROM orders),
    f AS (SELECT document, version, unnest(['status', 'prioridade', 'valor', 'nota']) AS field, unnest([o_orderstatus, o_orderpriority,
        CASE WHEN o_orderkey % 5 = 0 THEN 'null' ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) END, CASE WHEN o_orderkey % 3 <> 0 THEN 'n' || o_orderkey % 4 END]) AS value FROM v),
    h AS (SELECT * FROM f WHERE value IS NOT NULL)"""


def _versions(spark, d):
    k = F.col("o_orderkey")
    total = F.when(k % 5 != 0, F.floor("o_totalprice").cast("long").cast("string"))
    base = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("prioridade"), F.col("o_orderpriority"), F.lit("valor"), total)
    snapshot = F.when(k % 3 == 0, base).otherwise(F.map_concat(base, F.create_map(F.lit("nota"), F.concat(F.lit("n"), k % 4))))
    label = F.when(k % 7 == 0, "corrigida").otherwise("apos_extracao")
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("document"), k.alias("seq"), label.alias("label"), snapshot.alias("snapshot"))
    return versions.versions(rows)


@query(
    "w06_version_diffs",
    f"""WITH {_VERSIONS}, p AS (SELECT document, version + 1 AS version, field, value FROM h WHERE (document, version + 1) IN (SELECT (document, version) FROM v))
    SELECT coalesce(h.document, p.document) AS document, CAST(coalesce(h.version, p.version) AS INT) AS version, CASE WHEN p.value IS NULL THEN 'ADICIONADO' WHEN h.value IS NULL THEN 'REMOVIDO' ELSE 'ALTERADO' END AS kind,
        coalesce(h.field, p.field) AS field, p.value AS before, h.value AS after FROM h FULL JOIN p ON h.document = p.document AND h.version = p.version AND h.field = p.field WHERE h.value IS DISTINCT FROM p.value""",
)
def _(get, spark, d):
    return versions.changes(_versions(spark, d))


@query(
    "h05_compare_versions",
    f"""WITH {_VERSIONS}, b AS (SELECT document FROM v WHERE version = 3), x AS (SELECT * FROM h SEMI JOIN b USING (document) WHERE version = 1), y AS (SELECT * FROM h SEMI JOIN b USING (document) WHERE version = 3)
    SELECT coalesce(x.document, y.document) AS document, coalesce(x.field, y.field) AS field, x.value AS before, y.value AS after FROM x FULL JOIN y ON x.document = y.document AND x.field = y.field WHERE x.value IS DISTINCT FROM y.value""",
)
def _(get, spark, d):
    return versions.compare(_versions(spark, d), 1, 3)


@query("h05_latest_labelled", f"WITH {_VERSIONS} SELECT document, CAST(max(version) AS INT) AS version, arg_max(o_orderpriority, version) AS priority, arg_max(CASE WHEN o_orderkey % 3 <> 0 THEN 4 ELSE 3 END, version) AS n_fields FROM v WHERE o_orderkey % 7 = 0 GROUP BY document")
def _(get, spark, d):
    rows = versions.as_of(_versions(spark, d), "corrigida")
    return rows.select("document", "version", F.col("snapshot")["prioridade"].alias("priority"), F.size("snapshot").alias("n_fields"))


@query("st05_effects_once", "SELECT DISTINCT user_id, user_id % 12 + 1 AS months FROM events WHERE user_id IS NOT NULL")
def _(get, spark, d):
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    out = effects.shared_folder(spark, "effects")
    effects.consume(stream.select("user_id"), "user_id", lambda rows: rows.withColumn("months", F.col("user_id") % 12 + 1), f"{out}/effects", f"{out}/checkpoint").awaitTermination()
    return effects.effects(spark, f"{out}/effects").drop("batch")
