"""Critical fields as candidates and anchors: of the lines that could hold a value the one nearest to its label.

All lines of a document are one array. A candidate is a line with its place; distances are differences of places, the
least distance wins and of equal ones the first. Scores add up what was found. Nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

# Forms of the values, words that are no code, labels in the order they are tried.
MOMENT, NUMBER, CODE = r"^(\d{2})/(\d{2})/(\d{4})\s+(\d{2}):(\d{2}):(\d{2})$", r"^\d{1,10}$", r"^(?=.*[A-Z])[A-Z0-9]{7,15}$"
NO_CODES = (
    "PRESTADOR", "TOMADOR", "SERVICOS", "DISCRIMINACAO", "RETENCOES", "FEDERAIS", "FEDERAL", "INFORMACOES", "MUNICIPIO", "DOURADOS", "COFINS", "PASEP", "ISSQN", "INSS", "CSLL", "OUTRAS", "FONTES",
)
LABELS = {
    "number": ("número da nota", "numero da nota"),
    "code": ("código de verificação", "codigo de verificacao", "código de verificacão", "codigo de verificacão"),
    "issued": ("data da emissão da nota", "data da emissao da nota", "data de emissão da nota", "data de emissao da nota"),
    "event": ("data do fato gerador",),
}
# Digits of a short number, lines that are near, lines within reach, labels that stand together.
SHORT, NEAR, REACH, TOGETHER = 7, 15, 60, 3
# Least confidence of a level.
LEVELS = ((90, "alta"), (70, "media"), (50, "baixa"))


def level(score: Column) -> Column:
    found = F.when(score >= LEVELS[0][0], LEVELS[0][1])
    for least, name in LEVELS[1:]:
        found = found.when(score >= least, name)
    return found.otherwise("nula")


def anchor(lower: Column, labels: tuple[str, ...]) -> Column:
    """Place of the first line that contains the first label that occurs at all; null without one."""

    def place(label: str) -> Column:
        return F.array_position(F.transform(lower, lambda x: F.contains(x, F.lit(label))), True)

    return F.coalesce(*[F.nullif(place(label), F.lit(0)).cast("int") for label in labels])


def candidates(lines: Column, test) -> Column:
    """Array of (i, v): places and lines that pass."""
    placed = F.transform(lines, lambda x, i: F.struct((i + 1).cast("int").alias("i"), x.alias("v")))
    return F.filter(placed, lambda c: test(c["v"]))


def nearest(found: Column, at: Column) -> Column:
    """The candidate nearest to a place, of equally near ones the first; without a place the first one; null if there is none."""
    first = F.try_element_at(found, F.lit(1))
    by_distance = F.array_min(F.transform(found, lambda c: F.struct(F.abs(c["i"] - at).alias("d"), c["i"].alias("i"), c["v"].alias("v"))))
    return F.when(at.isNull(), first).otherwise(F.when(by_distance.isNotNull(), F.struct(by_distance["i"].alias("i"), by_distance["v"].alias("v"))))


def points(*rules: tuple[Column, int]) -> Column:
    """The points of all rules that hold, at most 100."""
    return F.least(F.lit(100), sum((F.when(test, n).otherwise(0) for test, n in rules), F.lit(0)))


def datetime_rules(text: Column) -> Column:
    """Rules that a moment's text breaks, in order; only the first one if it hasn't the form at all."""
    part = lambda n: F.regexp_extract(text, MOMENT, n).try_cast("int")
    rules = (
        ("mes_1_12", part(2).between(1, 12)), ("dia_1_31", part(1).between(1, 31)), ("hora_0_23", part(4).between(0, 23)), ("minuto_0_59", part(5).between(0, 59)),
        ("segundo_0_59", part(6).between(0, 59)), ("ano_2000_2099", part(3).between(2000, 2099)), ("data_existe_no_calendario", F.try_to_timestamp(F.substring(text, 1, 10), F.lit("dd/MM/yyyy")).isNotNull()),
    )
    broken = F.filter(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules]), lambda x: x.isNotNull())
    return F.when(F.coalesce(text.rlike(MOMENT), F.lit(False)), broken).otherwise(F.array(F.lit("formato_dd_mm_aaaa_hh_mm_ss")))


def critical_fields(docs: DataFrame) -> DataFrame:
    """One row per document: a struct (value, confidence, method) for number, code, issued and event, their mean and its level.

    Two moments go to issue and event in the order of the text, unless both labels are known, stand apart, and either
    moment isn't nearer to its own label: then they change places. A single moment is both.
    """
    rows = docs.select("doc_id", S.segments(F.coalesce(F.col("text"), F.lit(""))).alias("lines"))
    rows = rows.withColumn("lower", F.transform("lines", F.lower))
    lines, c = F.col("lines"), F.col
    rows = rows.select(
        "doc_id", *[anchor(c("lower"), labels).alias(f"{f}_at") for f, labels in LABELS.items()], candidates(lines, lambda v: v.rlike(NUMBER)).alias("numbers"),
        candidates(lines, lambda v: v.rlike(CODE) & ~v.isin(*NO_CODES)).alias("codes"), candidates(lines, lambda v: v.rlike(MOMENT)).alias("moments"),
    )
    rows = rows.withColumn("short", F.filter("numbers", lambda x: F.length(x["v"]) <= SHORT))
    first, second = F.try_element_at("moments", F.lit(1)), F.try_element_at("moments", F.lit(2))
    rows = rows.withColumns({
        "number": F.when(F.size("short") > 0, nearest(c("short"), c("number_at"))).otherwise(nearest(c("numbers"), c("number_at"))),
        "code": nearest(c("codes"), c("code_at")), "first": first, "second": second,
    })
    away = lambda moment, label: F.abs(c(f"{moment}.i") - c(f"{label}_at"))
    own = (away("first", "issued") < away("first", "event")) & (away("second", "event") < away("second", "issued"))
    swap = F.coalesce((F.abs(c("issued_at") - c("event_at")) > TOGETHER) & ~own, F.lit(False))  # null without both labels and moments
    rows = rows.withColumn("swap", swap)
    rows = rows.withColumns({
        "issued": F.when(c("swap"), c("second")).otherwise(c("first")),
        "event": F.when(c("swap"), c("first")).otherwise(F.coalesce("second", "first")),
    })
    rows = rows.withColumns({f"{f}_away": F.abs(c(f"{f}.i") - c(f"{f}_at")) for f in LABELS})
    near = lambda f, most=NEAR: F.coalesce(c(f"{f}_away") <= most, F.lit(False))
    known = lambda f: c(f"{f}_at").isNotNull()
    two = c("second").isNotNull()

    def moment(f: str, place: str) -> tuple[Column, Column]:
        score = points((F.lit(True), 40), (known(f), 15), (two, 10), (F.size(datetime_rules(c(f"{f}.v"))) == 0, 20), (near(f), 15))
        return score, F.when(c("first").isNull(), "sem_datas").when(c("swap"), "proximity_swap").when(two, f"stream_order_{place}").otherwise("unica_data_compartilhada")

    told = {
        "number": (
            points((F.lit(True), 25), (known("number"), 20), (F.size("short") > 0, 20), (c("number.v").cast("long") > 0, 10), (near("number", REACH), 20), (near("number"), 5)),
            F.when(F.size("numbers") == 0, "sem_candidatos").when(F.size("short") == 0, "fallback_any_numeric").when(known("number"), "short_numeric_closest_anchor").otherwise("short_numeric_first"),
        ),
        "code": (
            points((F.lit(True), 55), (known("code"), 20), (F.size("codes") == 1, 10), (near("code"), 15)),
            F.when(F.size("codes") == 0, "sem_candidatos").when(known("code"), "pattern_com_ancora").otherwise("pattern_sem_ancora"),
        ),
        "issued": moment("issued", "primeiro"),
        "event": moment("event", "segundo"),
    }
    rows = rows.select("doc_id", *[F.struct(c(f"{f}.v").alias("value"), F.when(c(f).isNull(), 0).otherwise(score).alias("confidence"), how.alias("method")).alias(f) for f, (score, how) in told.items()])
    mean = S.js_round(sum((c(f"{f}.confidence") for f in told), F.lit(0)) / len(told), 0).cast("int")
    return rows.withColumn("confidence", mean).withColumn("level", level(c("confidence")))


def long_form(fields: DataFrame) -> DataFrame:
    """doc_id, field, value, confidence, level, method: a row per field."""
    made = [F.struct(F.lit(f).alias("field"), F.col(f"{f}.value").alias("value"), F.col(f"{f}.confidence").alias("confidence"), level(F.col(f"{f}.confidence")).alias("level"), F.col(f"{f}.method").alias("method")) for f in LABELS]
    return fields.select("doc_id", F.inline(F.array(*made)))
