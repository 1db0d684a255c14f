"""Queries over invoice texts render and read each text once."""

import pytest
from pyspark.sql import functions as F

from ledgerlume.functions import scalars as S
from ledgerlume.operators import extraction as E
from ledgerlume.plans.catalog import QUERIES


@pytest.mark.parametrize("name", ["k10_document_scores", "m09_reprocessed", "k05_section_scores", "k03_field_confidence", "k06_ocr_score"])
def test_rules_and_comparison_share_one_pass(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("] parquet") == 1


def test_amounts_found_in_one_search_are_those_of_each_label(spark):
    texts = [None, "", " \n ", "IR = R$\n 5,00\nIR = R$ 7,00", " Valor ISS = R$ 1,00 Valor ISS R$ 2,00\n\n valor bruto: R$ 3,00\nVALOR BRUTO\n=R$4.000,00", "R$ " + " " * 3000 + "x\n y"]
    rows = E.trimmed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert rows.filter(~F.col("lines").eqNullSafe(F.array_join(S.segments(F.col("text")), "\n"))).count() == 0
    first, second = E.label_reading(rows)[0], E.search_reading(rows)[0]
    for label in ("IR", "Valor ISS", "Valor bruto"):
        one = rf"(?m)^{label} = {E.MONEY}"
        assert first.filter(~E.grab(F.col("amounts"), one).eqNullSafe(E.grab(F.col("lines"), one))).count() == 0
    one = rf"(?i)Valor bruto\s*=?\s*{E.MONEY}"
    assert second.filter(~E.grab(F.col("b_amounts"), one).eqNullSafe(E.grab(F.col("text"), one))).count() == 0
