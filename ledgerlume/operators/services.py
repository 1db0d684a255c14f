"""The service zone of municipal invoices: description, order, run-on amounts, service code and arithmetic checks.

A text's lines are an array of its row; all reading is array and pattern work inside the row, and nothing is
shuffled. Every step that later steps use several times is a column of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

# What bounds the zone, what its lines are, how amounts look.
ANCHOR = r"(?iu)discrimina[çc][aã]o dos servi[çc]os"
ZONE_END = r"(?i)^(?:Forma de Pagamento$|Parcela\s*Vencimento)|ParcelaVencimento"
ORDER = r"(?i)^OF:\s*(\d+)"
VALUES_ROW = r"^x=\d"
COLUMN_HEAD = r"(?iu)^(?:Qtd|Valor unit[aá]rio|Valor do servi[çc]o|Base de c[aá]lculo|\(%\)ISS|ISS)"
CODE_LABEL = r"(?iu)c[oó]digos?\s+dos?\s+servi[çc]os?"
CODE = r"^(\d{1,2}\.\d{2,4})(?:\s*[-–]|\s*$)"
TWO_PLACES = r"\d{1,3}(?:\.\d{3})*,\d{2}"
FOUR_OR_TWO_PLACES = r"\d{1,3}(?:\.\d{3})*,\d{4}|\d{1,3}(?:\.\d{3})*,\d{2}"
TAX_TABLE = r"(?i)Valor\s+ISS\s*\(R\$\)"
#: Lines before the anchor that belong to the zone, lines after it where nothing ends it, lines below the code's label.
BEFORE, AFTER, BELOW = 2, 15, 4
TOLERANCE = 0.02
#: Values of a whole row in their order, and the weight of each field in the zone's confidence.
VALUES = ("service_value", "base", "rate", "tax", "quantity", "unit_price")
WEIGHTS = (("description", 20), ("order", 10), ("quantity", 10), ("unit_price", 10), ("service_value", 20), ("base", 10), ("rate", 10), ("tax", 10), ("code", 8))
NO_ZONE, ABSENT, ODD_ROW, GUESSED, PLACED = 30, 40, 55, 60, 88


def amounts(text: Column, places: str = FOUR_OR_TWO_PLACES) -> Column:
    """Amounts that follow each other without a separator, from the left; four decimals are tried before two."""
    return F.regexp_extract_all(text, F.lit(f"({places})"), 1)


def number(amount: Column) -> Column:
    """'1.234,50' as 1234.5."""
    return F.translate(amount, ",.", ".").cast("double")


def first_at(lines: Column, wanted: Callable[[Column, Column], Column]) -> Column:
    """Index from 0 of the first line that is wanted, by line and index; -1 if none is."""
    return F.array_position(F.transform(lines, wanted), F.lit(True)).cast("int") - 1


def zones(docs: DataFrame) -> DataFrame:
    """doc_id, lines, anchor, first, last: the zone's bounds as indexes from 0, -1 without an anchor.

    A null or empty text has no lines and so no zone.
    """
    rows = docs.select("doc_id", S.segments(F.coalesce("text", F.lit(""))).alias("lines"))
    rows = rows.withColumn("anchor", first_at(F.col("lines"), lambda s, i: s.rlike(ANCHOR)))
    rows = rows.withColumn("ends", first_at(F.col("lines"), lambda s, i: (i > F.col("anchor")) & s.rlike(ZONE_END)))
    found = F.col("anchor") >= 0
    last = F.when(F.col("ends") >= 0, F.col("ends") - 1).otherwise(F.least(F.size("lines") - 1, F.col("anchor") + AFTER))
    return rows.select(
        "doc_id", "lines", "anchor", F.when(found, F.greatest(F.lit(0), F.col("anchor") - BEFORE)).otherwise(-1).alias("first"), F.when(found, last).otherwise(-1).alias("last")
    )


def service_fields(docs: DataFrame) -> DataFrame:
    """doc_id, the nine fields (text or amount as written) with a confidence and a method each, and the zone's confidence.

    Six amounts are taken by their places. Any other number of at least two is read by size: the rate is the first
    that doesn't end in 00 or is at most 100, the quantity the first small one with four decimals, the tax the least,
    the service's value the largest, base and unit price the ones before; equal amounts keep their order.
    """
    rows = zones(docs).withColumn("found", F.col("anchor") >= 0)
    rows = rows.withColumn("body", F.when(F.col("found"), F.slice("lines", F.col("anchor") + 2, F.col("last") - F.col("anchor"))).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("row_at", first_at(F.col("body"), lambda s, i: s.rlike(VALUES_ROW)))
    above = F.when(F.col("row_at") >= 0, F.slice("body", F.lit(1), F.greatest(F.col("row_at"), F.lit(0)))).otherwise(F.col("body"))
    size = F.char_length
    told = F.filter(above, lambda s: ~s.rlike(COLUMN_HEAD) & ~s.rlike(ORDER) & (size(s) >= 4) & ~(s.rlike(r"(?i)^(?:Qtd|Valor)\w+") & (size(s) > 20)))
    labels = F.coalesce(F.nullif(first_at(F.col("lines"), lambda s, i: (i > F.col("last")) & s.rlike(CODE_LABEL)), F.lit(-1)), first_at(F.col("lines"), lambda s, i: s.rlike(CODE_LABEL)))
    rows = rows.withColumns({
        "told": told,
        "order_line": F.get(F.filter("body", lambda s: s.rlike(ORDER)), F.lit(0)),
        "amounts": F.when(F.col("row_at") >= 0, amounts(F.get("body", F.col("row_at")))).otherwise(F.array().cast("array<string>")),
        "label_at": labels,
    })
    rows = rows.withColumns({
        "n": F.size("amounts"),
        "by_size": F.array_sort(F.transform("amounts", lambda v, i: F.struct(number(v).alias("f"), i.alias("i"), v.alias("v")))),
        "code_line": F.get(F.filter(F.slice("lines", F.greatest(F.col("label_at"), F.lit(0)) + 2, F.lit(BELOW)), lambda s: s.rlike(CODE)), F.lit(0)),
    })
    whole, some = F.col("n") == len(VALUES), F.col("n") >= 2
    ranked = lambda back: F.get(F.col("by_size"), F.col("n") - back)["v"]
    guess = {
        "rate": F.get(F.filter("amounts", lambda v: ~v.endswith("00") | (number(v) <= 100)), F.lit(0)),
        "quantity": F.get(F.filter("amounts", lambda v: v.rlike(r",\d{4}$") & (number(v) < 10000)), F.lit(0)),
        "tax": F.get("by_size", F.lit(0))["v"], "service_value": ranked(1), "base": ranked(2), "unit_price": F.when(F.col("n") >= 3, ranked(3)),
    }
    rows = rows.withColumns({f: F.when(whole, F.get("amounts", F.lit(i))).when(some, guess[f]) for i, f in enumerate(VALUES)})
    order, code = F.regexp_extract("order_line", ORDER, 1), F.regexp_extract("code_line", CODE, 1)
    rows = rows.withColumns({
        "description": F.when(F.size("told") > 0, F.trim(F.array_join("told", " "))),
        "order": F.when(F.col("found"), order),
        "code": F.when(F.col("found") & (F.col("label_at") >= 0), code),
    })
    absent = F.when(~F.col("found"), NO_ZONE).otherwise(ABSENT)
    told_sure = S.clamp(F.lit(70) + F.when(size("description") >= 10, 15).otherwise(0) + F.when(F.size("told") == 1, 5).otherwise(10), 0.0, 100.0).cast("int")
    sure = {
        "description": (told_sure, F.lit("text_after_anchor")), "order": (F.lit(95), F.lit("pattern_OF")),
        "code": (F.lit(92), F.when(F.col("label_at") > F.col("last"), "label_apos_zona").otherwise("label_fora_da_zona")),
        **{f: (F.when(whole, PLACED).otherwise(GUESSED), F.when(whole, "positional_parse").otherwise("heuristic_fallback")) for f in VALUES},
    }
    missing = {f: F.when(F.col("row_at") >= 0, ODD_ROW).otherwise(absent) if f in VALUES else absent for f, _ in WEIGHTS}
    rows = rows.withColumns({f"{f}_conf": F.when(F.col(f).isNull(), missing[f]).otherwise(c) for f, (c, _) in sure.items()})
    rows = rows.withColumns({f"{f}_how": F.when(F.col(f).isNull(), "campo_ausente").otherwise(how) for f, (_, how) in sure.items()})
    mean = sum((F.col(f"{f}_conf") * w for f, w in WEIGHTS), F.lit(0)) / float(sum(w for _, w in WEIGHTS))
    return rows.select(
        "doc_id", F.col("found").alias("has_zone"), F.col("n").alias("n_amounts"), *[c for f, _ in WEIGHTS for c in (f, f"{f}_conf", f"{f}_how")], F.when(F.col("found"), mean).otherwise(0.0).alias("confidence")
    )


def service_checks(fields: DataFrame) -> DataFrame:
    """doc_id, product_fits, tax_fits: quantity x price is the value and value x rate the tax, within a tolerance; null where one is missing."""
    n = lambda f: number(F.col(f))
    return fields.select(
        "doc_id", (F.abs(n("quantity") * n("unit_price") - n("service_value")) <= TOLERANCE).alias("product_fits"),
        (F.abs(n("service_value") * n("rate") / 100 - n("tax")) <= TOLERANCE).alias("tax_fits"),
    )


def tax_table(docs: DataFrame) -> DataFrame:
    """doc_id, base, tax with their confidences from the line below the table's head: the largest amount is the base, the next one the tax.

    Equal amounts keep their order; with fewer than two amounts neither is known.
    """
    rows = docs.select("doc_id", S.segments(F.coalesce("text", F.lit(""))).alias("lines"))
    rows = rows.withColumn("at", first_at(F.col("lines"), lambda s, i: s.rlike(TAX_TABLE)))
    read = F.when(F.col("at") >= 0, amounts(F.get("lines", F.col("at") + 1), TWO_PLACES))
    rows = rows.withColumn("by_size", F.array_sort(F.transform(read, lambda v, i: F.struct((-number(v)).alias("f"), i.alias("i"), v.alias("v")))))
    known = F.coalesce(F.size("by_size") >= 2, F.lit(False))
    of = lambda i: F.when(known, F.get("by_size", F.lit(i))["v"])
    return rows.select("doc_id", of(0).alias("base"), F.when(known, 90).otherwise(ABSENT).alias("base_conf"), of(1).alias("tax"), F.when(known, 88).otherwise(ABSENT).alias("tax_conf"))
