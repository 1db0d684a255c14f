"""Reconciliation of two extractions, confidence scores and fiscal rules, over long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .extraction import PARTY_FIELDS, SECTION_WEIGHTS, WITHHELD

RATE_LOW, RATE_HIGH, TOLERANCE = 2.0, 5.0, 0.05
#: What `failed_checks` adds to a document's fields, where there are rules: kept through reconciliation and scores.
CARRIED = ("fails", "fatal")


# Method names that tell where a value comes from.
def origin_of(how: Column) -> Column:
    """Where a value comes from, by the name of the method that read it."""
    m = F.lower(how)
    return (
        F.when(m.isin("campo_ausente", "nao_presente"), "AUSENTE").when(F.contains(m, F.lit("derivado")), "DERIVADO")
        .when(m.rlike("inferido|heuristic_fallback|pessoa_fisica_fallback"), "INFERIDO").otherwise("EXPLICITO")
    )


def compare(pairs: DataFrame) -> DataFrame:
    """Both readings of every document and field with how they agree, row by row (see `extraction.paired`)."""
    rows = pairs.withColumns({f"origin_{t}": origin_of(F.col(f"how_{t}")) for t in "ab"})
    return rows.withColumn("agreement", S.concordance(F.col("value_a"), F.col("value_b"), F.col("norm_a"), F.col("norm_b")))


def resolve(compared: DataFrame) -> DataFrame:
    """The winning value, its confidence and method, and whether a person must look."""
    agree = F.col("agreement")
    same = agree.isin("CONCORDANCIA_TOTAL", "CONCORDANCIA_FUNCIONAL")
    light, some = agree == "DIVERGENCIA_LEVE", agree == "DIVERGENCIA_MODERADA"
    first = F.col("conf_a") >= F.col("conf_b")
    best, conf = F.when(first, F.col("value_a")).otherwise(F.col("value_b")), F.greatest("conf_a", "conf_b")
    lost = (agree == "DIVERGENCIA_CRITICA") & F.col("critical")
    return compared.select(
        *[c for c in CARRIED if c in compared.columns],
        "doc_id", "field", "section", "critical", "weight", "value_a", "value_b", "agreement",
        F.when(lost, None).when(same | light | some, best).otherwise(F.col("value_a")).alias("value"),
        F.when(lost, 0.0).when(same, S.js_round((F.col("conf_a") + F.col("conf_b")) / 2, 1)).when(light, S.js_round(conf * 0.9)).when(some, S.js_round(conf * 0.7)).otherwise(S.js_round(F.col("conf_a") * 0.5)).alias("confidence"),
        F.when(lost, "NENHUM").when(same & F.col("value_a").eqNullSafe(F.col("value_b")), "AMBOS").when(same | light | some, F.when(first, "A").otherwise("B")).otherwise("A").alias("winner"),
        F.when(first, F.col("how_a")).otherwise(F.col("how_b")).alias("how"),
        ((agree == "DIVERGENCIA_CRITICA") | (some & F.col("critical"))).alias("review"),
    )


def agreement_statistics(compared: DataFrame) -> DataFrame:
    """Counts of each kind of agreement per document, and the share that agrees."""
    n = lambda kind: F.count_if(F.col("agreement") == kind)
    total = F.count(F.lit(1))
    agree = n("CONCORDANCIA_TOTAL") + n("CONCORDANCIA_FUNCIONAL")
    return compared.groupBy("doc_id").agg(
        n("CONCORDANCIA_TOTAL").alias("full"), n("CONCORDANCIA_FUNCIONAL").alias("functional"), n("DIVERGENCIA_LEVE").alias("light"),
        n("DIVERGENCIA_MODERADA").alias("moderate"), n("DIVERGENCIA_CRITICA").alias("critical"), S.js_round(agree / total * 100, 1).alias("agree_percent"),
    )


def consolidate(resolved: DataFrame) -> DataFrame:
    """Per document: confidence with critical fields counted twice, fields to review, whether it is blocked."""
    weight = F.when(F.col("critical"), 2).otherwise(1)
    return resolved.groupBy("doc_id").agg(
        S.js_round(F.sum(F.col("confidence") * weight) / F.sum(weight), 1).alias("confidence"),
        F.count_if("review").alias("to_review"),
        (F.count_if((F.col("winner") == "NENHUM") & F.col("critical")) > 0).alias("blocked"),
    )


def own_fields(resolved: DataFrame) -> DataFrame:
    """Empty exclusive fields that hold the other party's value.

    Where provider and customer of a document have the same value, the customer loses it, unless only
    the customer's was found by method A. The loser is absent: no confidence, winner or review.
    """
    part = lambda i: F.regexp_extract("field", f"^(prestador|tomador)_({'|'.join(f for f, _ in PARTY_FIELDS)})$", i)
    base = part(2)
    pair = Window.partitionBy("doc_id", F.when(base != "", base).otherwise(F.col("field")))
    of = lambda side, c: F.max(F.when(part(1) == side, c)).over(pair)
    provider, customer = (S.ownership_key(of(side, F.col("value"))) for side in ("prestador", "tomador"))
    found = {side: F.coalesce(of(side, F.col("value_a").isNotNull()), F.lit(False)) for side in ("prestador", "tomador")}
    loser = F.when(found["tomador"] & ~found["prestador"], "prestador").otherwise("tomador")
    leak = F.coalesce((base != "") & (provider != "") & (provider == customer) & (part(1) == loser), F.lit(False))
    rows = resolved.withColumn("leak", leak)
    empty = {"value": F.lit(None), "confidence": F.lit(0.0), "winner": F.lit("NENHUM"), "how": F.lit("campo_ausente"), "review": F.lit(False)}
    return rows.select(*[F.when(F.col("leak"), empty[c]).otherwise(F.col(c)).alias(c) if c in empty else F.col(c) for c in resolved.columns])


# Method names by how a reading came about.
def reading_origin(how: Column) -> Column:
    m = F.lower(how)
    return (
        F.when(m.isin("campo_ausente", "nao_presente") | m.startswith("derivado_"), "INFERENCIA").when(m.rlike("inferido|derivado"), "INFERENCIA")
        .when(m.rlike("heuristic|pessoa_fisica_fallback|fallback"), "FALLBACK_HEURISTICO").when(m.rlike("ocr|scanned"), "OCR").otherwise("TEXTO_DIRETO")
    )


def risk(confidence: Column, critical: Column, origin: Column, failed: Column) -> Column:
    """Impact and likelihood of a wrong value; the first rule that holds decides."""
    weak = origin.isin("FALLBACK_HEURISTICO", "INFERENCIA")
    return (
        F.when(critical & (confidence < 50), "CRITICO").when(failed & critical & (confidence < 70), "CRITICO").when(failed & critical, "ALTO")
        .when(confidence < 50, "ALTO").when(critical & (confidence < 70), "ALTO").when(confidence < 70, "MEDIO")
        .when(critical & weak, "MEDIO").when(origin == "INFERENCIA", "MEDIO").otherwise("BAIXO")
    )


def field_confidence(rows: DataFrame) -> DataFrame:
    """Adjusted confidence, risk and need of review of every field; `fails` counts its failed checks."""
    origin = reading_origin(F.col("how"))
    cut = F.when(origin == "OCR", 10).when(origin == "FALLBACK_HEURISTICO", 15).when(origin == "INFERENCIA", 20).otherwise(0)
    base = F.col("confidence") - cut
    base = F.when(F.col("value").isNull() & (origin == "INFERENCIA"), F.least(base, F.lit(45.0))).otherwise(base)
    score = S.clamp(S.js_round(base - F.col("fails") * 5, 1), 0.0, 100.0)
    rows = rows.select(*[c for c in CARRIED if c in rows.columns], "doc_id", "field", "section", "critical", "weight", "value", origin.alias("origin"), score.alias("score"))
    level = risk(F.col("score"), F.col("critical"), F.col("origin"), F.col("fails") > 0)
    rows = rows.withColumn("risk", level).withColumn("level", S.global_level(F.col("score")))
    return rows.withColumn("review", (F.col("critical") & (F.col("score") < 70)) | (F.col("score") < 50) | (F.col("risk") == "CRITICO"))


def section_scores(scored: DataFrame) -> DataFrame:
    """Weighted mean per document and section, whether a person must look, and the fields that call for it."""
    mean = F.sum(F.col("score") * F.col("weight")) / F.sum("weight")
    bad = F.col("review") | (F.col("score") < 70)
    rows = scored.groupBy("doc_id", "section").agg(
        mean.alias("mean"), F.count_if(F.col("critical") & (F.col("score") < 70)).alias("weak"), F.sort_array(F.collect_list(F.when(bad, F.col("field")))).alias("fields")
    )
    return rows.select(
        "doc_id", "section", S.js_round(F.col("mean"), 1).alias("score"), F.size("fields").alias("problems"), F.array_join("fields", ",").alias("problem_fields"),
        ((F.col("weak") > 0) | (F.col("mean") < 70)).alias("review"),
    )


def ocr_score(scored: DataFrame) -> DataFrame:
    """100 less the weighted penalties of fields that aren't direct text."""
    cut = F.when(F.col("origin") == "OCR", 15).when(F.col("origin") == "FALLBACK_HEURISTICO", 8).when((F.col("origin") == "INFERENCIA") & F.col("value").isNotNull(), 5).otherwise(0)
    return scored.groupBy("doc_id").agg(S.clamp(S.js_round(100 - F.sum(cut * F.col("weight")) / F.sum("weight"), 1), 0.0, 100.0).alias("ocr_score"))


def structural_score(facts: DataFrame) -> DataFrame:
    """Twenty points for each of the four blocks that was found, and five for each fact of the fiscal block."""
    found = lambda *fields: F.when(F.coalesce(*fields).isNotNull(), 20).otherwise(0)
    fiscal = sum((F.when(F.col(f).isNotNull(), 1).otherwise(0) for f in ("natureza_operacao", "situacao_issqn", "situacao_nfse", "local_prestacao")), F.lit(0))
    blocks = found("prestador_cnpj") + found("tomador_cnpj", "tomador_email") + found("codigo_servico") + found(*WITHHELD)
    return facts.select("doc_id", (blocks + S.js_round(fiscal / 4 * 20)).cast("long").alias("structural_score"))


def document_scores(scored: DataFrame) -> DataFrame:
    """Mean of the six sections by their weights, a section without fields as 0, and the first reason to block.

    `fatal` tells in every row of a document whether a critical fiscal rule failed. Sections are grouped first, their
    sums by document after that: the fields are worked out once.
    """
    share = sum((F.when(F.col("section") == name, w).otherwise(0) for name, w in SECTION_WEIGHTS), F.lit(0))
    mean = S.js_round(F.sum(F.col("score") * F.col("weight")) / F.sum("weight"), 1)
    low = {"b1": F.col("risk") == "CRITICO", "b2": F.col("score") < 50}
    sections = scored.groupBy("doc_id", "section").agg(mean.alias("score"), *[F.count_if(F.col("critical") & c).alias(n) for n, c in low.items()], F.max("fatal").alias("fatal"))
    rows = sections.groupBy("doc_id").agg(
        (F.sum(F.col("score") * share) / sum(w for _, w in SECTION_WEIGHTS)).alias("mean"), *[F.sum(n).alias(n) for n in low], F.max("fatal").alias("fatal")
    )
    block = F.when(F.col("b1") > 0, "B1").when(F.col("b2") > 0, "B2").when(F.col("fatal"), "B3").when(F.col("mean") < 60, "B4")
    return rows.select("doc_id", S.js_round(F.col("mean"), 1).alias("confidence"), S.global_level(F.col("mean")).alias("level"), block.alias("block"))


APPROVED, FAILED, WARNED, NOT_APPLICABLE = "APROVADO", "REPROVADO", "AVISO", "NAO_APLICAVEL"
#: Rules that judge a field.
FIELD_RULES = {"R001": "aliquota", "R002": "valor_iss", "R003": "valor_liquido"}


def _outcomes(facts: DataFrame) -> tuple[DataFrame, dict[str, tuple[Column, Column]]]:
    """The facts with their numbers, and outcome and severity of the fifteen rules over them."""
    numbers = facts.withColumns({f"n_{c}": S.parse_number(F.col(c)) for c in facts.columns if c in (*WITHHELD, "base_calculo", "aliquota", "valor_iss", "valor_bruto", "valor_liquido") or c.endswith(("_val", "_pct"))})
    n = lambda c: F.col(f"n_{c}")
    zero = lambda c: F.coalesce(n(c), F.lit(0.0))
    gone = lambda *c: F.coalesce(*[F.when(F.col(x).isNull(), True) for x in c], F.lit(False))
    near = lambda a, b: F.abs(a - b) <= TOLERANCE
    told = lambda c, pattern: F.coalesce(F.col(c).rlike(pattern), F.lit(False))
    verdict = lambda ok: F.when(ok, APPROVED).otherwise(FAILED)
    critical, medium, low = F.lit("CRITICO"), F.lit("MEDIO"), F.lit("BAIXO")

    rate, base = n("aliquota"), n("base_calculo")
    excused = told("situacao_issqn", "(?i)expor|isent|imun|suspens") | told("natureza_operacao", "(?i)expor|isent|imun|suspens")
    r1 = (
        F.when(F.col("aliquota").isNull(), FAILED).when((rate == 0) & excused, APPROVED).when(rate == 0, WARNED).when((rate >= 1) & (rate < RATE_LOW), WARNED)
        .when(rate.between(RATE_LOW, RATE_HIGH), APPROVED).otherwise(FAILED)
    )
    r2 = F.when(gone("base_calculo", "aliquota", "valor_iss"), FAILED).otherwise(verdict(near(base * rate / 100, n("valor_iss"))))
    federal = sum((zero(c) for c in WITHHELD), F.lit(0.0))
    r3 = F.when(gone("valor_bruto", "valor_iss", "valor_liquido"), FAILED).otherwise(verdict(near(n("valor_bruto") - n("valor_iss") - federal, n("valor_liquido"))))
    by_state, by_invoice = told("situacao_issqn", "(?i)reten[çc][aã]o"), told("situacao_nfse", "(?i)retida")
    r4 = verdict((by_state == by_invoice) & (by_state == (by_state | by_invoice)))
    simple = lambda c: F.when(~F.col("simples_nacional"), NOT_APPLICABLE).otherwise(verdict(zero(c) < TOLERANCE))
    fits = lambda level: near(n(f"{level}_pct") / 100 * base, n(f"{level}_val"))
    r11 = (
        F.when(gone("municipal_pct", "municipal_val", "base_calculo"), WARNED).when(~fits("municipal"), FAILED)
        .when(near(n("municipal_val"), zero("valor_iss")), APPROVED).otherwise(WARNED)
    )
    r12 = F.when(gone("estadual_val"), WARNED).when(n("estadual_val") < TOLERANCE, APPROVED).otherwise(WARNED)
    r13 = F.when(gone("federal_pct", "federal_val", "base_calculo"), WARNED).otherwise(verdict(fits("federal")))
    r14 = F.when(gone("codigo_servico"), NOT_APPLICABLE).otherwise(verdict(told("codigo_servico", r"^\d{1,2}\.\d{2,4}$")))
    return numbers, {
        "R001": (r1, F.when(F.col("aliquota").isNull(), "MEDIO").when(r1 == WARNED, "BAIXO").otherwise("CRITICO")), "R002": (r2, critical), "R003": (r3, critical), "R004": (r4, medium),
        **{code: (simple(c), F.when(F.col("simples_nacional"), medium).otherwise(low)) for code, c in (("R005", "ir"), ("R006", "pis_pasep"), ("R007", "cofins"), ("R008", "csll"))},
        "R009": (F.when(F.col("simples_nacional"), WARNED).otherwise(NOT_APPLICABLE), low), "R010": (F.lit(APPROVED), medium),
        "R011": (r11, low), "R012": (r12, low), "R013": (r13, low), "R014": (r14, low), "R015": (verdict(~gone("natureza_operacao")), low),
    }


def fiscal_rules(facts: DataFrame) -> DataFrame:
    """doc_id, rule, outcome, severity of the fifteen rules over `extraction.fiscal_facts`.

    The rows of a document come from one array, so no rule reads the table again and nothing is shuffled.
    """
    rows, outcomes = _outcomes(facts)
    made = [F.struct(F.lit(code).alias("rule"), outcome.alias("outcome"), severity.alias("severity")) for code, (outcome, severity) in outcomes.items()]
    return rows.select("doc_id", F.inline(F.array(*made)))


def failed_checks(facts: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """The facts with `fatal` (one of the critical rules failed) and, by field, the failures of the rules on it."""
    rows, outcomes = _outcomes(facts)
    # only the first three can be critical; each outcome is a column of its own, as it is read more than once
    rows = rows.withColumns({f"outcome_{code}": outcomes[code][0] for code in FIELD_RULES})
    failed = {code: F.col(f"outcome_{code}") == FAILED for code in FIELD_RULES}
    rows = rows.withColumn("fatal", (failed["R001"] & F.col("aliquota").isNotNull()) | failed["R002"] | failed["R003"])
    return rows, {f: failed[code].cast("long") for code, f in FIELD_RULES.items()}


def fiscal_alerts(rules: DataFrame) -> DataFrame:
    """Failed rules."""
    return rules.filter(F.col("outcome") == FAILED).select("doc_id", F.col("rule").alias("alert"), "severity")


def fiscal_confidence(rules: DataFrame) -> DataFrame:
    """100 less the penalties of failed rules and warnings, and the audit level."""
    cut = F.when(F.col("outcome") == WARNED, 2).when(F.col("outcome") != FAILED, 0).when(F.col("severity") == "CRITICO", 30).when(F.col("severity") == "MEDIO", 15).otherwise(5)
    rows = rules.groupBy("doc_id").agg(F.greatest(F.lit(0), 100 - F.sum(cut)).cast("long").alias("score"), F.count_if(F.col("outcome") == FAILED).alias("failed"))
    level = F.when(F.col("score") >= 90, "APROVADO").when(F.col("score") >= 75, "ALERTA_BAIXO").when(F.col("score") >= 50, "ALERTA_MEDIO").when(F.col("score") >= 25, "ALERTA_CRITICO").otherwise("IRREGULAR")
    return rows.select("doc_id", "score", "failed", level.alias("level"))
