from pyspark.sql import functions as F

from ledgerlume.operators import services as S

TEXT = """NFS-e
Qtd
Valor unitário
DISCRIMINAÇÃO DOS SERVIÇOS
Recuperação de eixo
OF: 6866682 .
ab
{row}
depois da linha
Forma de Pagamento
Códigos dos serviços:
14.01 - Lubrificação
Valor ISS(R$)
0,002.500,0050.000,00"""
WHOLE = "x=50.000,000050.000,005,002.500,001,000050.000,0000"


def fields(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return S.service_fields(rows).orderBy("doc_id").collect()


def test_run_on_amounts(spark):
    texts = ["x=50.000,000050.000,005,00", "x=1,00001,00", "12,3,45", "", None, "2.500,0012,0000"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", S.amounts(F.col("t")).alias("a")).orderBy("i").collect()
    assert [r.a for r in rows] == [["50.000,0000", "50.000,00", "5,00"], ["1,0000", "1,00"], ["3,45"], [], None, ["2.500,0012"]]
    # four decimals are tried first everywhere; the tax table knows two only
    two = spark.createDataFrame([("0,002.500,0050.000,00",)], "t string").select(S.amounts(F.col("t"), S.TWO_PLACES).alias("a")).first()
    assert two.a == ["0,00", "2.500,00", "50.000,00"]


def test_six_amounts_by_place(spark):
    (row,) = fields(spark, TEXT.format(row=WHOLE))
    assert [row[f] for f in S.VALUES] == ["50.000,0000", "50.000,00", "5,00", "2.500,00", "1,0000", "50.000,0000"]
    assert (row.description, row.order, row.code, row.n_amounts) == ("Recuperação de eixo", "6866682", "14.01", 6)
    assert {row[f"{f}_conf"] for f in S.VALUES} == {88} and row.description_conf == 90 and row.code_how == "label_apos_zona"
    assert row.confidence == (90 * 20 + 95 * 10 + 88 * 70 + 92 * 8) / 108


def test_five_seven_and_one_amounts(spark):
    five, seven, one, none = fields(
        spark, TEXT.format(row="x=50.000,000050.000,005,002.500,001,0000"), TEXT.format(row=WHOLE + "0,00"), TEXT.format(row="x=50.000,0000"), TEXT.format(row="sem valores")
    )
    assert five.n_amounts == 5 and [five[f] for f in S.VALUES] == ["50.000,00", "50.000,0000", "5,00", "1,0000", "1,0000", "2.500,00"]
    assert five.rate_conf == 60 and five.rate_how == "heuristic_fallback"
    assert seven.n_amounts == 7 and seven.tax == "0,00" and seven.service_value == "50.000,0000" and seven.quantity == "1,0000"
    assert [one[f] for f in S.VALUES] == [None] * 6 and one.tax_conf == 55 and one.description == "Recuperação de eixo"
    assert none.n_amounts == 0 and none.tax_conf == 40 and none.description == "Recuperação de eixo sem valores depois da linha"


def test_no_zone_empty_and_null(spark):
    for row in fields(spark, "NFS-e\nCódigos dos serviços:\n14.01", "", None):
        assert not row.has_zone and row.confidence == 0 and row.code is None and row.description_conf == 30 and row.tax_conf == 30


def test_code_before_the_zone_and_zone_without_end(spark):
    (row,) = fields(spark, "Código do serviço\nlinha\n7.02\nDISCRIMINAÇÃO DOS SERVIÇOS\n" + "\n".join(f"linha {i:02d}" for i in range(20)))
    assert (row.code, row.code_how) == ("7.02", "label_fora_da_zona")
    assert row.description.endswith("linha 14") and row.description_conf == 95


def test_checks(spark):
    rows = spark.createDataFrame([(0, TEXT.format(row=WHOLE)), (1, TEXT.format(row=WHOLE.replace("2.500,00", "2.600,00"))), (2, "x")], "doc_id long, text string")
    got = [(r.product_fits, r.tax_fits) for r in S.service_checks(S.service_fields(rows)).orderBy("doc_id").collect()]
    assert got == [(True, True), (True, False), (None, None)]


def test_tax_table(spark):
    texts = [TEXT.format(row=WHOLE), "Valor ISS (R$)\n5,00", "Valor ISS(R$)", "Valor ISS(R$)\n5,005,001,00", None]
    rows = S.tax_table(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.base, r.tax, r.base_conf) for r in rows] == [("50.000,00", "2.500,00", 90), (None, None, 40), (None, None, 40), ("5,00", "5,00", 90), (None, None, 40)]
