"""Scalar expressions against plain values and plain Python."""

import datetime
import random

from pyspark.sql import functions as F

from ledgerlume.functions import scalars as S


def values(spark, fn, rows, schema="a string"):
    """Results in the order of `rows`."""
    data = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], f"i int, {schema}")
    columns = [F.col(c) for c in data.columns[1:]]
    return [r.v for r in data.select("i", fn(*columns).alias("v")).orderBy("i").collect()]


def test_dates(spark):
    got = values(spark, S.parse_date, ["09/06/2025", "19/05/2026 12:01:05", "31/02/2025", "18/15/2025", "", None, "01/01/1899"])
    assert got == [datetime.date(2025, 6, 9), datetime.date(2026, 5, 19), None, None, None, None, None]


def test_numbers(spark):
    assert values(spark, S.parse_number, ["R$ 1.092,34", "12,0000", "81,666670", "12abc", "abc", None]) == [1092.34, 12.0, 81.66667, 12.0, None, None]
    assert values(spark, S.form_number, ["1234.56", "12abc", None]) == [1234.56, None, None]
    assert values(spark, lambda a: S.js_round(a, 2), [1.005, -2.255], "a double") == [1.0, -2.25]
    assert values(spark, lambda a: S.js_round(a, 1), [-2.25], "a double") == [-2.2]


def check_digits(base, weights):
    for w in weights:
        rest = sum(int(c) * x for c, x in zip(base, w, strict=True)) % 11
        base += "0" if rest < 2 else str(11 - rest)
    return base


def test_tax_ids(spark):
    rng = random.Random(1)
    good = [check_digits("".join(rng.choices("0123456789", k=12)), (S.CNPJ_FIRST, S.CNPJ_SECOND)) for _ in range(50)]
    people = [check_digits("".join(rng.choices("0123456789", k=9)), (S.CPF_FIRST, S.CPF_SECOND)) for _ in range(50)]
    assert all(values(spark, S.valid_cnpj, good)) and all(values(spark, S.valid_cpf, people)) and all(values(spark, S.valid_tax_id, good + people))
    broken = [g[:-1] + str((int(g[-1]) + 1) % 10) for g in good]
    assert not any(values(spark, S.valid_cnpj, [*broken, "11111111111111", "1", "", None])) and not any(values(spark, S.valid_cpf, ["00000000000", None]))
    assert values(spark, S.format_tax_id, ["12345678000195", "12345678909", "x"]) == ["12.345.678/0001-95", "123.456.789-09", "x"]


def test_texts(spark):
    assert values(spark, S.segments, [" a \n\n b1 \n"]) == [["a", "b1"]]
    assert values(spark, S.normal_text, ["  São-Paulo,  ÁÉ x ", None]) == ["sao paulo ae x", None]
    assert values(spark, S.repair_digits, ["02.914.46O/0061-91", "49.52l.060/0001-49", "SOBRE", "", None]) == ["02.914.460/0061-91", "49.521.060/0001-49", "SOBRE", "", None]
    assert values(spark, S.djb2, ["abc"]) == ["0b873285"]
    assert values(spark, S.redact, ["12.345.678/0001-95 123.456.789-09 a@b.com (67) 3333-4444"]) == ["[CNPJ] [CPF] [EMAIL] [TEL]"]
    assert values(spark, S.failure_kind, ["Request timed out", "ENOENT", "Prisma lock", "?"]) == ["FALHA_TIMEOUT", "FALHA_STORAGE", "FALHA_PERSISTENCIA", "FALHA_EXTRACAO"]
    assert values(spark, S.next_version, ["1.2.9"]) == ["1.2.10"]
    assert values(spark, S.format_money, [1092.34, -5.0, None], "a double") == ["R$ 1.092,34", "-R$ 5,00", "—"]


def plain_dice(a, b):
    if a == b:
        return 1.0
    if min(len(a), len(b)) < 2:
        return 0.0
    left, common = [b[i : i + 2] for i in range(len(b) - 1)], 0
    for i in range(len(a) - 1):
        if a[i : i + 2] in left:
            left.remove(a[i : i + 2])
            common += 1
    return 2 * common / (len(a) + len(b) - 2)


def test_likeness(spark):
    rng = random.Random(2)
    pairs = [("".join(rng.choices("ab", k=rng.randrange(8))), "".join(rng.choices("abc", k=rng.randrange(8)))) for _ in range(80)] + [("night", "nacht")]
    assert values(spark, S.dice, pairs, "a string, b string") == [plain_dice(a, b) for a, b in pairs]


def test_agreement(spark):
    rows = [(None, None, "text"), ("a", None, "text"), ("R$ 5,00", "5,00", "money"), ("x", "x", "text"), ("abcdefghij", "zzzz", "text"), ("50.000,00", "50.000,01", "money")]
    fn = lambda a, b, k: S.concordance(a, b, S.normalise(a, k), S.normalise(b, k))
    assert values(spark, fn, rows, "a string, b string, k string") == [
        "CONCORDANCIA_TOTAL", "DIVERGENCIA_MODERADA", "CONCORDANCIA_FUNCIONAL", "CONCORDANCIA_TOTAL", "DIVERGENCIA_CRITICA", "DIVERGENCIA_MODERADA",
    ]


def test_calendar(spark):
    day = datetime.datetime(2026, 1, 31)
    assert values(spark, lambda a: S.add_months(F.to_date(a), 1), [day], "a timestamp") == [datetime.date(2026, 2, 28)]
    assert values(spark, lambda a: S.expiry_status(a), [-1, 0, 30, 31], "a int") == ["VENCIDO", "PROXIMO", "PROXIMO", "VALIDO"]
