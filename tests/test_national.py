from ledgerlume.operators import national as N
from ledgerlume.sources import layouts

TEXT = """DANFSe v1.0
EMITENTE DA NFS-e
CNPJ / CPF / NIF
11.222.333/0001-81
Nome / Nome Empresarial
Prestadora Ltda
E-mail
a@exemplo.com.br
Município
Dourados - MS 79800-000
Simples Nacional na Data de Competência
Não Optante
12345678901234567890123456789012345678901234567890
77
194 1
10/07/2026 10/07/2026 14:47:16
TOMADOR DO SERVIÇO
CNPJ / CPF / NIF
123.456.789-09
Nome / Nome Empresarial
-
E-mail
-
INTERMEDIÁRIO DO SERVIÇO
E-mail
outro@exemplo.com.br
TRIBUTAÇÃO FEDERAL
IRRF
R$ 1.500,25
VALOR TOTAL DA NFS-e
R$ 80.000,00
TRIBUTAÇÃO MUNICIPAL
ISSQN Apurado
Não Retido R$ 2.400,00
BC ISSQN
80.000,00
SERVIÇO PRESTADO
Descrição do Serviço
Obra"""


def one(spark, text):
    return N.national_invoices(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()


def test_labels_answer_for_their_own_section_only(spark):
    row = one(spark, TEXT)
    assert row["provider_email"] == "a@exemplo.com.br" and row["customer_email"] is None and row["customer_name"] is None
    assert (row["provider_id"], row["customer_id"]) == ("11.222.333/0001-81", "123.456.789-09")
    assert (row["provider_town"], row["provider_state"], row["provider_zip"], row["customer_town"]) == ("Dourados", "MS", "79800-000", None)
    assert (row["number"], row["dps_number"], row["dps_series"], row["competence"], row["issued"], row["dps_issued"]) == ("77", "194", "1", "10/07/2026", "10/07/2026 14:47:16", "10/07/2026 14:47:16")
    assert (row["ir"], row["base"], row["iss"], row["withheld"], row["gross"], row["net"]) == (1500.25, 80000.0, 2400.0, False, 80000.0, 80000.0)
    assert row["description"] == "Obra" and row["missing"] == []


def test_sections_without_their_heading_are_empty(spark):
    row = one(spark, TEXT.replace("TOMADOR DO SERVIÇO", "Cliente"))
    assert row["customer_id"] is None and row["missing"] == ["tomador.cpf_cnpj"]
    assert row["provider_email"] == "a@exemplo.com.br"  # the provider's section then goes on to the end
    row = one(spark, TEXT.replace("VALOR TOTAL DA NFS-e", "x"))
    assert row["gross"] == 80000.0 and row["net"] == 80000.0  # from the tax base


def test_null_and_empty_texts(spark):
    for text in (None, "", "-"):
        row = one(spark, text)
        assert row["number"] is None and row["gross"] is None and len(row["missing"]) == 6


def test_texts_of_a_small_file_are_made_and_read_in_many_tasks(spark):
    texts = layouts.national_texts(spark, "/root/testdata/sf0.001")
    assert texts.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_label_is_looked_up_once(spark):
    docs = spark.createDataFrame([(1, TEXT)], "doc_id long, text string")
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    plan = N.national_invoices(docs)._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    for label, sections in ((N.AMOUNTS["ir"][1], 1), (N.PARTY["email"], 2), (N.TEXTS["iss_line"][1], 1)):
        assert plan.count(f"(?iu){label}") == sections
