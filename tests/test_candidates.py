import pytest
from pyspark.sql import functions as F

from ledgerlume.operators import candidates as C


def fields(spark, text):
    return C.critical_fields(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()


@pytest.mark.parametrize("text,broken", [
    ("29/02/2024 23:59:59", []), ("31/02/2025 10:00:00", ["data_existe_no_calendario"]), ("01/13/2025 24:60:61", ["mes_1_12", "hora_0_23", "minuto_0_59", "segundo_0_59", "data_existe_no_calendario"]),
    ("01/01/1999 00:00:00", ["ano_2000_2099"]), ("00/01/2020 00:00:00", ["dia_1_31", "data_existe_no_calendario"]), ("2020-01-01", ["formato_dd_mm_aaaa_hh_mm_ss"]), (None, ["formato_dd_mm_aaaa_hh_mm_ss"]),
])
def test_datetime_rules(spark, text, broken):
    assert spark.createDataFrame([(text,)], "t string").select(C.datetime_rules(F.col("t"))).first()[0] == broken


def test_the_nearest_code_wins_and_of_equals_the_first(spark):
    assert fields(spark, "ZZZZZZ1\nx\nx\nCódigo de verificação\nx\nABC1234")["code"]["value"] == "ABC1234"
    row = fields(spark, "ABC1234\nCódigo de verificação\nXYZ9876")
    assert row["code"]["value"] == "ABC1234" and row["code"]["confidence"] == 90
    assert fields(spark, "TOMADOR\n1234567\nabc1234\nABC-1234\nABCDEF\nABCDEFGHIJKLMNOP")["code"]["value"] is None


def test_labels_are_tried_in_their_order(spark):
    row = fields(spark, "numero da nota\n5\nx\nx\nNúmero da Nota\n6")
    assert row["number"]["value"] == "6" and row["number"]["confidence"] == 100


def test_short_numbers_before_long_ones(spark):
    assert fields(spark, "12345678\nNúmero da nota\n123456789\nx\nx\n42")["number"]["value"] == "42"
    row = fields(spark, "0\nx")
    assert row["number"]["value"] == "0" and row["number"]["confidence"] == 45 and row["number"]["method"] == "short_numeric_first"


def test_moments_change_places_only_between_labels_apart(spark):
    a, b = "01/01/2020 10:00:00", "02/01/2020 10:00:00"
    apart = fields(spark, f"Data do fato gerador\n{a}\nx\nx\nx\nData da emissão da nota\n{b}")
    assert apart["issued"]["value"] == b and apart["event"]["value"] == a and apart["issued"]["method"] == "proximity_swap"
    together = fields(spark, f"Data do fato gerador\n{a}\nx\nData da emissão da nota\n{b}")
    assert together["issued"]["value"] == a and together["issued"]["method"] == "stream_order_primeiro"
    single = fields(spark, f"Data da emissão da nota\n{a}")
    assert single["event"]["value"] == a and single["event"]["confidence"] == 60 and single["issued"]["confidence"] == 90


def test_null_and_empty_texts(spark):
    for text in (None, "", "\n \n"):
        row = fields(spark, text)
        assert row["confidence"] == 0 and row["level"] == "nula" and row["issued"]["method"] == "sem_datas"
