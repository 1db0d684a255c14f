"""Invoice texts rendered from the business tables: input for classification and extraction.

Every order becomes one text in one of three layouts, with known values, so extraction can be held
against the tables at any scale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from .business import frame


def _company(number: Column, salt: int) -> Column:
    """A company number with right check digits, made from an id."""
    base = F.lpad(((number + 1) * salt % 999_999_999_999).cast("string"), 12, "0")
    first = F.concat(base, S._check_digit(base, S.CNPJ_FIRST).cast("string"))
    return F.concat(first, S._check_digit(first, S.CNPJ_SECOND).cast("string"))


def spread(rows: DataFrame) -> DataFrame:
    """Narrow rows over as many tasks as shuffles have: a small file is one task, and rendering and reading texts is the work."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")  # a stated number: narrow rows would be put together again otherwise


#: Withholdings by id % 8: field, remainder, amount.
WITHHELD = (("ir", 6, 10.5), ("cofins", 2, 3.0), ("inss", 3, 11.0), ("csll", 4, 1.0))
FEDERAL_PERCENT = 13.45


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each text says: one row per invoice with typed values.

    The remainders of the id decide which texts break which rule, so that every outcome occurs.
    """
    inv = frame(spark, sf_dir, "invoices")
    gross, k = F.col("gross"), F.col("id")
    service = k % 3 != 1  # goods have no municipal block
    iss = S.js_round(gross * F.col("rate") / 100, 2)
    federal = F.when(service, sum((F.when(k % 8 == r, amount).otherwise(0.0) for _, r, amount in WITHHELD), F.lit(0.0))).otherwise(0.0)
    return inv.select(
        k.alias("doc_id"),
        F.col("number"),
        F.to_date(F.coalesce("issued", "created")).alias("day"),
        _company(F.col("supplier_id"), 7_919_333).alias("provider"),
        _company(F.col("customer_id"), 104_729_111).alias("customer"),
        F.concat(F.lit("contato"), F.col("customer_id"), F.lit("@exemplo.com.br")).alias("email"),
        F.col("rate"),
        gross.alias("gross"),
        iss.alias("iss"),
        S.js_round(gross - iss - federal + F.when(k % 9 == 0, 1.0).otherwise(0.0), 2).alias("net"),
        (k % 3).alias("layout"),
        # every seventh text has the rate misread, every fifth holds a letter for a digit in the customer's number
        (k % 7 == 0).alias("misread"),
        (k % 5 == 0).alias("scanned"),
        *[F.when(service & (k % 8 == r), amount).otherwise(0.0).alias(f) for f, r, amount in WITHHELD],
        F.when(k % 7 == 3, None).when(k % 7 == 4, "1401").otherwise("14.01").alias("service_code"),
        F.when(k % 5 == 0, None).when(k % 5 == 2, "Exportação de serviço").when(k % 5 == 3, "Isenta").otherwise("Tributação no município").alias("nature"),
        F.when(k % 4 == 0, "Retenção").otherwise("Normal").alias("iss_state"),
        F.when(k % 12 == 0, "Retida").otherwise("Emitida").alias("invoice_state"),
        (k % 2 == 0).alias("simple"),
        (k % 26 == 0).alias("sole"),
        (k % 4 == 2).alias("small"),
    )


def texts(facts: DataFrame) -> DataFrame:
    """doc_id, text."""
    money = lambda c: F.concat(F.lit("R$ "), S.decimal_text(F.col(c) if isinstance(c, str) else c))
    percent = lambda c: F.concat(F.translate(F.format_string("%.2f", c), ".", ","), F.lit("%"))
    k, day = F.col("doc_id"), F.date_format("day", "dd/MM/yyyy")
    tail = F.lpad(F.col("number"), 8, "0")
    customer = S.format_tax_id(F.col("customer"))
    customer = F.when(F.col("scanned"), F.regexp_replace(customer, r"0(?=/)", "O")).otherwise(customer)
    rate = percent(F.when(F.col("misread"), F.col("rate") + 1).otherwise(F.col("rate")))
    values = ["Base de cálculo = ", money("gross"), "\nAlíquota = ", rate, "\nValor ISS = ", money("iss"), "\nValor bruto = ", money("gross"), "\nValor líquido = ", money("net")]
    parties = lambda p, c: [
        f"\n{p}\nEmpresa Fornecedora Ltda\nCNPJ: ", S.format_tax_id(F.col("provider")), f"\n{c}\nCliente Exemplo SA\nCNPJ: ", customer, "\nE-mail: ", F.col("email"), "\n",
    ]
    held = ["\nRETENÇÕES FEDERAIS\nIR = ", money("ir"), "\nPIS/PASEP = ", money(F.lit(0.0)), "\nCOFINS = ", money("cofins"), "\nINSS = ", money("inss"), "\nCSLL = ", money("csll"), "\nOUTRAS RETENÇÕES = ", money(F.lit(0.0))]
    line = lambda label, value: F.coalesce(F.concat(F.lit(f"\n{label}"), value), F.lit(""))
    said = lambda flag, text: F.when(F.col(flag), f"\n{text}").otherwise("")
    # approximate taxes: a sixth of the texts has none; some state a value, a percentage or a state tax that doesn't fit
    city = F.col("rate") + F.when(k % 10 == 5, 1.0).otherwise(0.0)
    city_value = S.js_round(F.col("gross") * city / 100, 2) + F.when(k % 10 == 3, 2.0).otherwise(0.0)
    federal = S.js_round(F.col("gross") * FEDERAL_PERCENT / 100, 2) + F.when(k % 10 == 7, 5.0).otherwise(0.0)
    state = F.when(k % 10 == 9, 3.0).otherwise(0.0)
    level = lambda name, value, share: [f"{name} - ", money(value), " (", percent(share), ")"]
    approximate = F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in ("\nValor aproximado do tributo ", *level("federal", federal, F.lit(FEDERAL_PERCENT)), "\n", *level("estadual", state, F.lit(0.0)), "; ", *level("municipal", city_value, city))])
    city_block = [
        line("Código do Serviço = ", F.col("service_code")), *held, "\nOUTRAS INFORMAÇÕES", line("Natureza da operação: ", F.col("nature")), line("Situação tributária do ISSQN: ", F.col("iss_state")),
        "\nLocal da prestação do serviço: São Paulo - SP", line("Situação desta NFS-e: ", F.col("invoice_state")), said("simple", "Documento emitido por optante pelo Simples Nacional"),
        said("small", "Empresa ME ou EPP"), said("sole", "Microempreendedor Individual"), F.when(k % 6 == 1, "").otherwise(approximate),
    ]
    municipal = ["NFS-e\nNúmero da Nota\n", F.col("number"), "\nData do Fato Gerador\n", day, " 12:01:05\nCódigo de Verificação\nAB", tail, *parties("PRESTADOR DE SERVIÇOS", "TOMADOR DE SERVIÇOS"), "DISCRIMINAÇÃO DOS SERVIÇOS\nManutenção\nISSQN\n", *values, *city_block]
    goods = ["DANFE\nNota Fiscal Eletrônica\nChave de Acesso\n", F.repeat(F.lpad(F.substring("number", 1, 4), 4, "0"), 11), "\nNúmero da Nota\n", F.col("number"), "\nEmissão\n", day, *parties("IDENTIFICAÇÃO DO EMITENTE", "DESTINATÁRIO / REMETENTE"), "NATUREZA DA OPERAÇÃO\nVenda\nDADOS DOS PRODUTOS / SERVIÇOS\n", *values]
    second = ["DANFSe v2.0\nDocumento Auxiliar da NFS-e\nChave de Acesso da NFS-e\n", F.lpad(F.col("number"), 50, "1"), "\nNúmero da DPS\n1\nNúmero da Nota\n", F.col("number"), "\nCompetência da NFS-e\n", day, *parties("PRESTADOR / FORNECEDOR", "TOMADOR / ADQUIRENTE"), "TRIBUTAÇÃO IBS/CBS\ncClassTrib\n000001\nISSQN\n", *values, *city_block]
    join = lambda parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    text = F.when(F.col("layout") == 0, join(municipal)).when(F.col("layout") == 1, join(goods)).otherwise(join(second))
    return facts.select("doc_id", text.alias("text"))


def party_texts(facts: DataFrame) -> DataFrame:
    """doc_id, text with the parties' exclusive fields.

    By (doc_id + number of the field) % 5 a field stands for the provider only, for the customer only,
    for both with one value (the customer's in capitals), for both with their own values, or not at all.
    """
    k = F.col("doc_id")
    text = k.cast("string")
    both = [
        ("E-mail", F.concat(F.lit("fornecedor"), text, F.lit("@exemplo.com.br")), F.concat(F.lit("cliente"), text, F.lit("@exemplo.com.br"))),
        ("Telefone", F.concat(F.lit("11 3"), text), F.concat(F.lit("11 9"), text)),
        ("Endereço", F.concat(F.lit("Rua do Fornecedor "), text), F.concat(F.lit("Avenida do Cliente "), text)),
        ("Inscrição Municipal", (k * 10).cast("string"), (k * 10 + 5).cast("string")),
    ]
    line = lambda label, here, value: F.when(here, F.concat(F.lit(f"{label}: "), value, F.lit("\n"))).otherwise("")
    case = lambda n: (k + n) % 5
    provider = [line(label, case(n).isin(0, 2, 3), p) for n, (label, p, _) in enumerate(both)]
    customer = [line(label, case(n).isin(1, 2, 3), F.when(case(n) == 2, F.upper(p)).otherwise(c)) for n, (label, p, c) in enumerate(both)]
    heads = [F.lit(x) for x in ("PRESTADOR DE SERVIÇOS\nEmpresa Fornecedora Ltda\n", "TOMADOR DE SERVIÇOS\nCliente Exemplo SA\n", "DISCRIMINAÇÃO DOS SERVIÇOS\nManutenção")]
    return facts.select("doc_id", F.concat(heads[0], *provider, heads[1], *customer, heads[2]).alias("text"))
