"""Learning from corrections: what each correction does, when a field freezes, and what is known of a field afterwards.

Corrections are defined to act one after the other. The states that matter are few, so they are found by
sums per field instead: the first valid value, the second time it is confirmed, the first other value, the
correction that freezes the field. Each is one minimum that Spark combines before the shuffle, however many
corrections a field has; clamped sums are composed per stretch of the log and then over the stretches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

KEYS = ["tenant", "field"]

# Validated corrections that lift a field to a level, how confidence moves and how far, and the limit of contradictions.
LEVELS = ((7, "PADRAO_CONSOLIDADO"), (5, "CONFIANCA"), (3, "HEURISTICA"))
LIMIT, LOSS, GAIN, CONTRADICTIONS = 20, 8, 5, 2

# Critical, derived and fiscal fields, kinds of value, critical fields that want a note.
CRITICAL = ("numero_nota", "codigo_verificacao", "data_emissao", "prestador.razao_social", "prestador.cpf_cnpj", "tomador.razao_social", "tomador.cpf_cnpj", "servico.valor_servico", "valor_bruto", "valor_liquido", "aliquota_iss", "valor_iss", "valor_servico_fin", "iss_retido")
DERIVED = ("valor_servico_fin", "iss_retido", "valor_aproximado_tributos")
FISCAL = ("base_calculo", "aliquota_iss", "valor_iss", "iss_retido", "natureza_operacao", "situacao_issqn", "regime_tributario")
MONEY = ("servico.valor_servico", "valor_bruto", "valor_liquido", "base_calculo", "valor_iss", "valor_servico_fin", "valor_aproximado_tributos")
NOTED = ("numero_nota", "codigo_verificacao", "prestador.cpf_cnpj", "tomador.cpf_cnpj", "valor_bruto", "valor_liquido", "valor_iss", "iss_retido")
# Signs that a scan confuses.
CONFUSED = (("0", "o"), ("1", "l"), ("5", "s"), ("8", "b"), ("6", "b"), ("9", "q"), ("2", "z"), ("rn", "m"), ("cl", "d"), ("li", "h"), ("ij", "y"), ("ri", "n"))

#: Corrections of one stretch of the log: its sequence numbers bound what is gathered in one place.
STRETCH = 4096


def kind_of(field: Column) -> Column:
    """How a field's values are normalised; null without a known form."""
    return (
        F.when(field.isin(*MONEY), "money").when(field.isin("prestador.cpf_cnpj", "tomador.cpf_cnpj"), "cnpj")
        .when(field.isin("data_emissao", "data_fato_gerador"), "date").when(field == "aliquota_iss", "percent").when(field == "iss_retido", "boolean")
    )


def with_checks(corrections: DataFrame) -> DataFrame:
    """Add what can be said of a correction by itself: whether it is eligible, and its score before contradictions."""
    field, old, new = F.col("field"), F.col("extracted"), F.col("corrected")
    form = new.isNull() | kind_of(field).isNull() | S.normalise(new, kind_of(field)).isNotNull()
    agreed = (F.coalesce("agreement", F.lit("")) == "CONCORDANCIA_TOTAL") & ~old.eqNullSafe(new)
    unnoted = field.isin(*NOTED) & F.col("note").isNull()
    cut = lambda bad, n: F.when(bad, n).otherwise(0)
    score = 100 - cut(~form, 40) - cut(agreed, 30) - cut(~F.col("human"), 20) - cut(unnoted, 10)
    return corrections.select("*", score.alias("own_score"), (form & ~agreed & (score >= 50)).alias("eligible"))


def judged(corrections: DataFrame) -> DataFrame:
    """Every correction with its status (VALIDADA, REJEITADA, CONGELADA) and score, in the order of `seq` per field.

    A field freezes with the first correction that contradicts what is validated: another value after
    CONTRADICTIONS equal ones, or any correction once two values are validated. Later ones are rejected with 0.
    """
    rows = with_checks(corrections)
    counts = F.col("eligible") & F.col("corrected").isNotNull()
    first = rows.groupBy(*KEYS).agg(F.min(F.when(counts, F.struct("seq", "corrected"))).alias("first"))
    rows = rows.join(first, KEYS)
    same = F.col("corrected").eqNullSafe(F.col("first.corrected"))
    marks = rows.groupBy(*KEYS).agg(
        F.min(F.when(counts & same & (F.col("seq") > F.col("first.seq")), F.col("seq"))).alias("again"),
        F.min(F.when(counts & ~same, F.col("seq"))).alias("other"),
    )
    rows = rows.join(marks, KEYS)
    taken = F.coalesce(F.col("other") < F.col("again"), F.col("other").isNotNull())  # the other value was validated
    against = F.when(taken, F.col("seq") > F.col("other")).otherwise((F.col("seq") > F.col("again")) & ~same)
    frozen = rows.filter(against).groupBy(*KEYS).agg(F.min("seq").alias("frozen_at"))
    rows = rows.join(frozen, KEYS, "left")
    later, now = F.coalesce(F.col("seq") > F.col("frozen_at"), F.lit(False)), F.coalesce(F.col("seq") == F.col("frozen_at"), F.lit(False))
    status = F.when(later, "REJEITADA").when(now, "CONGELADA").when(F.col("eligible"), "VALIDADA").otherwise("REJEITADA")
    score = F.when(later, 0).when(now, F.greatest(F.lit(0), F.col("own_score") - 50)).otherwise(F.col("own_score"))
    return rows.select(*corrections.columns, status.alias("status"), score.alias("score"), "frozen_at")


def contradictions(judged_rows: DataFrame) -> DataFrame:
    """Frozen fields, with the number of different validated values."""
    values = F.count_distinct(F.when(F.col("status") == "VALIDADA", F.col("corrected")))
    return judged_rows.groupBy(*KEYS).agg(values.alias("values"), F.max("frozen_at").alias("frozen_at")).filter("frozen_at IS NOT NULL")


def knowledge(judged_rows: DataFrame) -> DataFrame:
    """tenant, field, validated, confirmations, level, delta, frozen of every field with a correction.

    A confirmation gives GAIN, a correction from the third validated one on takes LOSS, both within LIMIT.
    x -> min(high, max(low, x + add)) composes, so every stretch becomes one such triple before stretches meet.
    """
    fine = F.col("status") == "VALIDADA"
    step = F.struct("seq", F.col("extracted").eqNullSafe(F.col("corrected")).alias("confirms"))
    per = judged_rows.groupBy(*KEYS, F.floor(F.col("seq") / STRETCH).alias("stretch")).agg(
        F.sort_array(F.collect_list(F.when(fine, step))).alias("steps"), F.max(F.col("frozen_at").isNotNull()).alias("frozen")
    )
    # what a stretch does depends on how many were validated before it: only whether it was none, one, two or more
    made = [_composed(F.col("steps"), n).alias(f"after_{n}") for n in range(LEVELS[-1][0])]
    per = per.select(*KEYS, "stretch", "frozen", F.size("steps").alias("n"), F.size(F.filter("steps", lambda s: s["confirms"])).alias("sure"), *made)
    per = per.groupBy(*KEYS).agg(
        F.sort_array(F.collect_list(F.struct("stretch", "n", *[f"after_{n}" for n in range(LEVELS[-1][0])]))).alias("all"), F.sum("n").alias("validated"), F.sum("sure").alias("confirmations"), F.max("frozen").alias("frozen")
    )
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("delta"))

    def on(state: Column, s: Column) -> Column:
        triple = F.when(state["n"] == 0, s["after_0"]).when(state["n"] == 1, s["after_1"]).otherwise(s["after_2"])
        return F.struct((state["n"] + s["n"]).alias("n"), F.least(triple["high"], F.greatest(triple["low"], state["delta"] + triple["add"])).alias("delta"))

    level = F.when(F.lit(False), "")
    for least, name in LEVELS:
        level = level.when(F.col("validated") >= least, name)
    level = level.otherwise("MEMORIA")
    return per.select(*KEYS, "validated", "confirmations", level.alias("level"), F.aggregate("all", start, on)["delta"].alias("delta"), "frozen")


def _composed(steps: Column, before: int) -> Column:
    """The clamped sum of a stretch's steps as (add, low, high), with `before` corrections validated earlier."""
    start = F.struct(F.lit(before).alias("n"), F.lit(0).alias("add"), F.lit(-LIMIT).alias("low"), F.lit(LIMIT).alias("high"))
    within = lambda x: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), x))

    def on(state: Column, s: Column) -> Column:
        move = F.when(s["confirms"], GAIN).when(state["n"] + 1 >= LEVELS[-1][0], -LOSS).otherwise(0)
        return F.struct((state["n"] + 1).alias("n"), (state["add"] + move).alias("add"), within(state["low"] + move).alias("low"), within(state["high"] + move).alias("high"))

    return F.aggregate(steps, start, on)


def _unscanned(text: Column) -> Column:
    for sign, other in CONFUSED:
        text = F.replace(text, F.lit(sign), F.lit(other))
    return text


def error_types(corrections: DataFrame) -> DataFrame:
    """correction_id, type, severity, origin of the error that each correction tells of; the first case that holds decides."""
    field, old, new = F.col("field"), F.col("extracted"), F.col("corrected")
    low, high = F.lower(old), F.lower(new)
    kind = F.coalesce(kind_of(field), F.lit("raw"))
    form = S.normalise(old, kind).isNotNull() & (S.normalise(old, kind) == S.normalise(new, kind))
    scan = (F.levenshtein(low, high) <= 3) & ((_unscanned(low) == high) | (_unscanned(high) == low))
    swapped = (F.startswith(field, F.lit("prestador.")) & (F.col("section") == "tomador")) | (F.startswith(field, F.lit("tomador.")) & (F.col("section") == "prestador"))
    label = old.rlike("(?i)^(Data|Endereço|Nome|Número|CEP|Bairro|QtdValor|Município)")
    error = (
        F.when(old.isNull() & new.isNotNull(), "ERRO_ANCORA").when(new.isNull(), "ERRO_EXTRACAO_PARCIAL").when(form, "ERRO_FORMATACAO").when(scan, "ERRO_OCR")
        .when(field.isin(*DERIVED), "ERRO_INFERENCIA").when(field.isin(*FISCAL), "ERRO_VALIDACAO_FISCAL").when(swapped, "ERRO_ASSOCIACAO_SECAO")
        .when(F.coalesce("confidence", F.lit(0)) >= 90, "ERRO_CLASSIFICACAO_CONFIANCA").when(label, "ERRO_FRONTEIRA").otherwise("ERRO_ANCORA")
    )
    rows = corrections.withColumn("type", error)
    by_field = (
        F.when(field.isin(*CRITICAL), "CRITICA").when(field.isin(*FISCAL), "ALTA").when(F.col("type") == "ERRO_OCR", "MEDIA").otherwise("MEDIA")
    )
    severity = (
        F.when(F.col("type") == "ERRO_FORMATACAO", "BAIXA").when(old.isNull() & new.isNull(), "BAIXA").when(F.col("type").isin("ERRO_VALIDACAO_FISCAL", "ERRO_ASSOCIACAO_SECAO", "ERRO_FRONTEIRA"), "ALTA")
        .when(F.col("type") == "ERRO_CLASSIFICACAO_CONFIANCA", "MEDIA").otherwise(by_field)
    )
    origin = F.when(F.col("agreement") == "DIVERGENCIA_CRITICA", "DESCONHECIDO").when(F.col("winner") == "A", "METODO_A").when(F.col("winner") == "B", "METODO_B").when(F.col("winner") == "AMBOS", "AMBOS").otherwise("DESCONHECIDO")
    return rows.select("correction_id", "field", "type", severity.alias("severity"), origin.alias("origin"))


# What an error of a type may have an effect on.
IMPACTS = {
    "ERRO_ANCORA": ("ancora", "heuristica"), "ERRO_OCR": ("heuristica",), "ERRO_FORMATACAO": ("heuristica",), "ERRO_INFERENCIA": ("heuristica",),
    "ERRO_VALIDACAO_FISCAL": ("heuristica", "ancora"), "ERRO_CLASSIFICACAO_CONFIANCA": ("heuristica",), "ERRO_CALCULO": ("heuristica",),
}


def impacts(typed: DataFrame) -> DataFrame:
    """correction_id, kind (ancora, heuristica, fronteira), target of everything that an error may have an effect on."""
    field, hit = F.col("field"), lambda kind, target: F.struct(F.lit(kind).alias("kind"), target.alias("target"))
    section = F.element_at(F.split("field", r"\."), 1)
    border = F.when(section.isin("prestador", "tomador"), section).when(section == "servico", "servicos").otherwise("financeiro")
    told = None
    for error, kinds in IMPACTS.items():
        found = F.array(*[hit(k, field) for k in kinds])
        told = F.when(F.col("type") == error, found) if told is None else told.when(F.col("type") == error, found)
    told = (
        F.when(F.col("type") == "ERRO_FRONTEIRA", F.when(section.isin("prestador", "tomador"), F.array(hit("fronteira", border), hit("ancora", field))).otherwise(F.array(hit("fronteira", border))))
        .when(F.col("type") == "ERRO_ASSOCIACAO_SECAO", F.array(hit("fronteira", F.lit("prestador")), hit("fronteira", F.lit("tomador")), hit("ancora", field)))
        .when(F.col("type") == "ERRO_EXTRACAO_PARCIAL", F.array(hit("ancora", field), hit("fronteira", section)))
        .otherwise(told)
    )
    return typed.select("correction_id", F.inline(told))


def reprocessed(scored: DataFrame, known: DataFrame) -> DataFrame:
    """Per document: weighted score before and after the fields' deltas, and how many fields rise and fall.

    `scored` has doc_id, field, score, weight; `known` has field, delta of one tenant.
    """
    rows = scored.join(known.select("field", "delta"), "field", "left")
    after = S.clamp(F.col("score") + F.coalesce("delta", F.lit(0)), 0.0, 100.0)
    mean = lambda c: S.js_round(F.sum(c * F.col("weight")) / F.sum("weight"), 1)
    done = rows.groupBy("doc_id").agg(
        mean(F.col("score")).alias("before"), mean(after).alias("after"), F.count_if(after > F.col("score")).alias("better"), F.count_if(after < F.col("score")).alias("worse")
    )
    return done.select("*", S.js_round(F.col("after") - F.col("before"), 1).alias("change"))
