"""What the rendered invoice texts must yield, as SQL over `orders`: stated from what each text says, not by reading it."""

from __future__ import annotations

from ..functions import scalars as S
from ..operators.extraction import FIELDS, SECTION_WEIGHTS

MONEY = "translate(format('{{:,.2f}}', {0}), ',.', '.,')"
PERCENT = "translate(format('{{:.2f}}', {0}), '.', ',')"
ROUND = "floor(({0}) * {1} + 0.5) / {1}"


def _digit(number: str, weights: tuple[int, ...]) -> str:
    total = " + ".join(f"CAST({number}[{i + 1}] AS INT) * {w}" for i, w in enumerate(weights))
    return f"CASE WHEN ({total}) % 11 < 2 THEN 0 ELSE 11 - ({total}) % 11 END"


def _company(source: str, key: str, salt: int, name: str) -> str:
    """CTEs that end in `name` (k, shown): the company number of every order, punctuated."""
    return (
        f"{name}0 AS (SELECT o_orderkey AS k, lpad(CAST((({key}) + 1) * {salt} % 999999999999 AS VARCHAR), 12, '0') AS b FROM {source}), "
        f"{name}1 AS (SELECT k, b || CAST({_digit('b', S.CNPJ_FIRST)} AS VARCHAR) AS b FROM {name}0), "
        f"{name}2 AS (SELECT k, b || CAST({_digit('b', S.CNPJ_SECOND)} AS VARCHAR) AS b FROM {name}1), "
        f"{name} AS (SELECT k, b[1:2] || '.' || b[3:5] || '.' || b[6:8] || '/' || b[9:12] || '-' || b[13:14] AS shown, b[8] = '0' AS zero FROM {name}2)"
    )


#: One row per order: values that the text states.
FACTS = f"""f AS (SELECT o_orderkey AS k, o_orderkey % 3 <> 1 AS service, o_totalprice AS g, (o_orderkey % 8)::DOUBLE AS r, (o_orderkey % 8)::DOUBLE + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS p,
    {ROUND.format('o_totalprice * (o_orderkey % 8)::DOUBLE / 100', 100)} AS iss, CASE WHEN o_orderkey % 3 = 1 THEN 0 WHEN o_orderkey % 8 = 6 THEN 10.5 WHEN o_orderkey % 8 = 2 THEN 3 WHEN o_orderkey % 8 = 3 THEN 11 WHEN o_orderkey % 8 = 4 THEN 1 ELSE 0 END::DOUBLE AS held,
    o_orderkey % 3 <> 1 AND o_orderkey % 2 = 0 AS simple, o_orderkey % 3 <> 1 AND o_orderkey % 6 <> 1 AS approximate, o_custkey, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate ELSE o_orderdate + INTERVAL 3 DAY END AS day FROM orders)"""

_VERDICT = "CASE WHEN {0} THEN 'APROVADO' ELSE 'REPROVADO' END"
_RULES = (
    ("R001", "CASE WHEN p = 0 AND service AND k % 5 IN (2, 3) THEN 'APROVADO' WHEN p = 0 OR p = 1 THEN 'AVISO' WHEN p BETWEEN 2 AND 5 THEN 'APROVADO' ELSE 'REPROVADO' END", "CASE WHEN (p = 0 AND NOT (service AND k % 5 IN (2, 3))) OR p = 1 THEN 'BAIXO' ELSE 'CRITICO' END"),
    ("R002", _VERDICT.format("abs(g * p / 100 - iss) <= 0.05"), "'CRITICO'"),
    ("R003", _VERDICT.format("k % 9 <> 0"), "'CRITICO'"),
    ("R004", _VERDICT.format("NOT (service AND k % 4 = 0 AND k % 12 <> 0)"), "'MEDIO'"),
    ("R005", f"CASE WHEN NOT simple THEN 'NAO_APLICAVEL' ELSE {_VERDICT.format('k % 8 <> 6')} END", "CASE WHEN simple THEN 'MEDIO' ELSE 'BAIXO' END"),
    ("R006", "CASE WHEN NOT simple THEN 'NAO_APLICAVEL' ELSE 'APROVADO' END", "CASE WHEN simple THEN 'MEDIO' ELSE 'BAIXO' END"),
    ("R007", f"CASE WHEN NOT simple THEN 'NAO_APLICAVEL' ELSE {_VERDICT.format('k % 8 <> 2')} END", "CASE WHEN simple THEN 'MEDIO' ELSE 'BAIXO' END"),
    ("R008", f"CASE WHEN NOT simple THEN 'NAO_APLICAVEL' ELSE {_VERDICT.format('k % 8 <> 4')} END", "CASE WHEN simple THEN 'MEDIO' ELSE 'BAIXO' END"),
    ("R009", "CASE WHEN simple THEN 'AVISO' ELSE 'NAO_APLICAVEL' END", "'BAIXO'"),
    ("R010", "'APROVADO'", "'MEDIO'"),
    ("R011", "CASE WHEN NOT approximate THEN 'AVISO' WHEN k % 10 = 3 THEN 'REPROVADO' WHEN k % 10 = 5 THEN 'AVISO' ELSE 'APROVADO' END", "'BAIXO'"),
    ("R012", "CASE WHEN NOT approximate OR k % 10 = 9 THEN 'AVISO' ELSE 'APROVADO' END", "'BAIXO'"),
    ("R013", "CASE WHEN NOT approximate THEN 'AVISO' WHEN k % 10 = 7 THEN 'REPROVADO' ELSE 'APROVADO' END", "'BAIXO'"),
    ("R014", "CASE WHEN NOT service OR k % 7 = 3 THEN 'NAO_APLICAVEL' WHEN k % 7 = 4 THEN 'REPROVADO' ELSE 'APROVADO' END", "'BAIXO'"),
    ("R015", _VERDICT.format("service AND k % 5 <> 0"), "'BAIXO'"),
)
RULES = f"{FACTS}, rules AS (" + " UNION ALL ".join(f"SELECT k AS doc_id, '{code}' AS rule, {outcome} AS outcome, {severity} AS severity FROM f" for code, outcome, severity in _RULES) + ")"

CONFIDENCE = (
    "SELECT doc_id, score, failed, CASE WHEN score >= 90 THEN 'APROVADO' WHEN score >= 75 THEN 'ALERTA_BAIXO' WHEN score >= 50 THEN 'ALERTA_MEDIO' WHEN score >= 25 THEN 'ALERTA_CRITICO' ELSE 'IRREGULAR' END AS level FROM ("
    "SELECT doc_id, greatest(0, 100 - sum(CASE WHEN outcome = 'AVISO' THEN 2 WHEN outcome <> 'REPROVADO' THEN 0 WHEN severity = 'CRITICO' THEN 30 WHEN severity = 'MEDIO' THEN 15 ELSE 5 END))::BIGINT AS score, count(*) FILTER (outcome = 'REPROVADO') AS failed FROM rules GROUP BY 1)"
)

#: doc_id, field, value_a, value_b, conf_a, conf_b: what either extraction reads.
_READ = (
    ("numero", "CAST(k AS VARCHAR)", "CAST(k AS VARCHAR)", 95, 85),
    ("data_emissao", "strftime(day, '%d/%m/%Y')", "strftime(day, '%d/%m/%Y')", 100, 80),
    ("prestador_cnpj", "s", "s", 100, 80),
    ("tomador_cnpj", "c", "CASE WHEN NOT scan THEN c END", 100, "CASE WHEN scan THEN 0 ELSE 75 END"),
    ("tomador_email", "'contato' || o_custkey || '@exemplo.com.br'", "'contato' || o_custkey || '@exemplo.com.br'", 100, 80),
    ("base_calculo", f"'R$ ' || {MONEY.format('g')}", f"'R$ ' || {MONEY.format('g')}", 90, 80),
    ("aliquota", PERCENT.format("p"), PERCENT.format("r"), 88, 70),
    ("valor_iss", f"'R$ ' || {MONEY.format('iss')}", f"'R$ ' || {MONEY.format('iss')}", 88, 80),
    ("valor_bruto", f"'R$ ' || {MONEY.format('g')}", f"'R$ ' || {MONEY.format('g')}", 95, 85),
    ("valor_liquido", f"'R$ ' || {MONEY.format('net')}", f"'R$ ' || {MONEY.format('net')}", 95, 85),
)
_FIELDS = "d AS (SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{section}', {critical}, {weight})" for f, section, critical, _, weight in FIELDS) + ") AS v(field, section, critical, weight))"
_AMOUNT = "replace({0}, 'R$ ', '')"
COMPARED = (
    f"{RULES}, {_company('orders', 'o_orderkey % 100 + 1', 7_919_333, 'sup')}, {_company('orders', 'o_custkey', 104_729_111, 'cus')}, {_FIELDS}, "
    f"t AS (SELECT f.*, sup.shown AS s, cus.shown AS c, f.k % 5 = 0 AND cus.zero AS scan, {ROUND.format('g - iss - held + CASE WHEN f.k % 9 = 0 THEN 1 ELSE 0 END', 100)} AS net FROM f JOIN sup ON sup.k = f.k JOIN cus ON cus.k = f.k), "
    "reads AS (" + " UNION ALL ".join(f"SELECT k AS doc_id, '{f}' AS field, {_AMOUNT.format(a)} AS value_a, {_AMOUNT.format(b)} AS value_b, {ca}::DOUBLE AS conf_a, ({cb})::DOUBLE AS conf_b, {'scan' if f == 'tomador_cnpj' else 'false'} AS scan FROM t" for f, a, b, ca, cb in _READ) + "), "
    "compared AS (SELECT *, CASE WHEN value_a IS NOT DISTINCT FROM value_b THEN 'CONCORDANCIA_TOTAL' ELSE 'DIVERGENCIA_MODERADA' END AS agreement FROM reads JOIN d USING (field)), "
    "resolved AS (SELECT *, value_a AS value, CASE WHEN agreement = 'CONCORDANCIA_TOTAL' THEN floor((conf_a + conf_b) / 2 * 10 + 0.5) / 10 ELSE floor(conf_a * 0.7 + 0.5) END AS confidence, "
    "CASE WHEN agreement = 'CONCORDANCIA_TOTAL' THEN 'AMBOS' ELSE 'A' END AS winner, CASE WHEN scan THEN 'ocr_reparado' ELSE 'pattern_com_ancora' END AS how, agreement <> 'CONCORDANCIA_TOTAL' AND critical AS review FROM compared)"
)

_BY_RULE = "CASE rule WHEN 'R001' THEN 'aliquota' WHEN 'R002' THEN 'valor_iss' WHEN 'R003' THEN 'valor_liquido' END"
_LEVEL = "CASE WHEN {0} >= 95 THEN 'MUITO_ALTA' WHEN {0} >= 85 THEN 'ALTA' WHEN {0} >= 70 THEN 'MEDIA' WHEN {0} >= 50 THEN 'BAIXA' ELSE 'MUITO_BAIXA' END"
SCORED = (
    f"{COMPARED}, failures AS (SELECT doc_id, {_BY_RULE} AS field, count(*) AS fails FROM rules WHERE outcome = 'REPROVADO' AND rule IN ('R001', 'R002', 'R003') GROUP BY 1, 2), "
    "s0 AS (SELECT r.*, coalesce(fails, 0) AS fails, CASE WHEN scan THEN 'OCR' ELSE 'TEXTO_DIRETO' END AS origin, greatest(0.0, least(100.0, floor((confidence - CASE WHEN scan THEN 10 ELSE 0 END - coalesce(fails, 0) * 5) * 10 + 0.5) / 10)) AS score FROM resolved r LEFT JOIN failures x ON x.doc_id = r.doc_id AND x.field = r.field), "
    "s1 AS (SELECT *, CASE WHEN critical AND score < 50 THEN 'CRITICO' WHEN fails > 0 AND critical AND score < 70 THEN 'CRITICO' WHEN fails > 0 AND critical THEN 'ALTO' WHEN score < 50 THEN 'ALTO' WHEN critical AND score < 70 THEN 'ALTO' WHEN score < 70 THEN 'MEDIO' ELSE 'BAIXO' END AS risk FROM s0), "
    f"scored AS (SELECT doc_id, field, section, critical, weight, score, {_LEVEL.format('score')} AS level, origin, risk, (critical AND score < 70) OR score < 50 OR risk = 'CRITICO' AS must FROM s1)"
)
SECTIONS = (
    f"{SCORED}, sections AS (SELECT doc_id, section, sum(score * weight) / sum(weight) AS mean, count(*) FILTER (must OR score < 70) AS problems, coalesce(string_agg(field, ',' ORDER BY field) FILTER (must OR score < 70), '') AS problem_fields, "
    "count(*) FILTER (critical AND score < 70) AS weak FROM scored GROUP BY 1, 2)"
)
DOCUMENTS = (
    f"{SECTIONS}, m AS (SELECT doc_id, sum(floor(mean * 10 + 0.5) / 10 * CASE section " + " ".join(f"WHEN '{name}' THEN {w}" for name, w in SECTION_WEIGHTS) + f" END) / {sum(w for _, w in SECTION_WEIGHTS)} AS mean FROM sections GROUP BY 1), "
    "w AS (SELECT doc_id, count(*) FILTER (critical AND risk = 'CRITICO') AS b1, count(*) FILTER (critical AND score < 50) AS b2 FROM scored GROUP BY 1), x AS (SELECT DISTINCT doc_id FROM rules WHERE outcome = 'REPROVADO' AND severity = 'CRITICO') "
    f"SELECT m.doc_id, floor(mean * 10 + 0.5) / 10 AS confidence, {_LEVEL.format('mean')} AS level, CASE WHEN b1 > 0 THEN 'B1' WHEN b2 > 0 THEN 'B2' WHEN x.doc_id IS NOT NULL THEN 'B3' WHEN mean < 60 THEN 'B4' END AS block FROM m JOIN w USING (doc_id) LEFT JOIN x USING (doc_id)"
)
