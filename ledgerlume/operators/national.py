"""The national service invoice: values on the line below their label, each label looked up in its own section only.

A section is the text from its heading to the heading of the one that follows in the text's order, so the same label in
two sections never answers for the other. A dash stands for an absent value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

# Headings, in the order of the text as it is read.
PROVIDER, CUSTOMER, BROKER = r"EMITENTE\s+DA\s+NFS-?e", r"TOMADOR\s+DO\s+SERVI[ÇC]O", r"INTERMEDI[AÁ]RIO"
FEDERAL, TOTALS, MUNICIPAL, SERVICE = r"TRIBUTA[ÇC][AÃ]O\s+FEDERAL", r"VALOR\s+TOTAL\s+DA\s+NFS-?e", r"TRIBUTA[ÇC][AÃ]O\s+MUNICIPAL", r"SERVI[ÇC]O\s+PRESTADO"
SECTIONS = {"provider": (PROVIDER, CUSTOMER), "customer": (CUSTOMER, BROKER), "federal": (FEDERAL, TOTALS), "totals": (TOTALS, MUNICIPAL), "municipal": (MUNICIPAL, SERVICE), "service": (SERVICE, None)}
# Labels of the parties' fields, of both; of texts and of amounts by section.
PARTY = {"name": r"Nome\s*/\s*Nome\s+Empresarial", "email": r"E-?mail", "phone": "Telefone", "registration": r"Inscri[çc][aã]o\s+Municipal", "address": r"Endere[çc]o"}
TEXTS = {
    "simple_line": ("provider", r"Simples\s+Nacional\s+na\s+Data\s+de\s+Compet[eê]ncia"), "assessment": ("provider", r"Regime\s+de\s+Apura[çc][aã]o\s+Tribut[aá]ria"),
    "iss_taxation": ("municipal", r"Tributa[çc][aã]o\s+do\s+ISSQN"), "immunity": ("municipal", r"Tipo\s+de\s+Imunidade"), "suspension": ("municipal", r"Suspens[aã]o\s+da\s+Exigibilidade\s+do\s+ISSQN"),
    "suspension_case": ("municipal", r"N[uú]mero\s+Processo\s+Suspens[aã]o"), "benefit": ("municipal", r"Benef[íi]cio\s+Municipal"), "rate_line": ("municipal", r"Al[íi]quota\s+Aplicada"), "iss_line": ("municipal", r"ISSQN\s+Apurado"),
    "national_code": ("service", r"C[oó]digo\s+de\s+Tributa[çc][aã]o\s+Nacional"), "municipal_code": ("service", r"C[oó]digo\s+de\s+Tributa[çc][aã]o\s+Municipal"), "place": ("service", r"Local\s+da\s+Presta[çc][aã]o"),
    "country": ("service", r"Pa[íi]s\s+da\s+Presta[çc][aã]o"), "description": ("service", r"Descri[çc][aã]o\s+do\s+Servi[çc]o"),
}
AMOUNTS = {"ir": ("federal", "IRRF"), "inss": ("federal", r"Contribui[çc][aã]o\s+Previdenci[aá]ria"), "pis": ("federal", r"PIS\s*[-–]"), "cofins": ("federal", r"COFINS\s*[-–]"), "base": ("municipal", r"BC\s+ISSQN")}
MONEY, MOMENT = r"R\$\s*([\d.]+,\d{2})", r"\d{2}/\d{2}/\d{4}\s+\d{2}:\d{2}:\d{2}"
COMPANY, PERSON = r"(\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2})", r"(\d{3}\.\d{3}\.\d{3}-\d{2})"
#: Signs after the access key that hold the header's numbers and dates.
HEADER = 600


def grab(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))  # searched once: a condition and its branch would search twice


def section(text: Column, begins: str, ends: str | None) -> Column:
    """From the first heading to the first following one after it, or to the end; empty without the heading."""
    until = rf"(?:(?!{ends}).)*" if ends else ".*"
    return F.regexp_extract(text, rf"(?isu){begins}{until}", 0)


def below(part: Column, label: str) -> Column:
    """The line below the first one with the label; null for a dash."""
    return F.nullif(F.nullif(F.trim(F.regexp_extract(part, rf"(?iu){label}[^\n]*\n([^\n]+)", 1)), F.lit("-")), F.lit(""))


def sections(docs: DataFrame) -> DataFrame:
    """doc_id, text and a column for every section."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns({n: section(F.col("text"), *ends) for n, ends in SECTIONS.items()})


def national_invoices(docs: DataFrame) -> DataFrame:
    """One row per document: header, parties, taxes, totals and service of the national layout; what is absent is null."""
    c = F.col
    rows = sections(docs)
    rows = rows.withColumn("access_key", grab(c("text"), r"\b(\d{50})\b"))
    rows = rows.withColumn("header", F.when(c("access_key").isNotNull(), F.expr(f"substring(text, locate(access_key, text), {HEADER})")))
    rows = rows.withColumn("header_lines", F.filter(F.slice(S.segments(c("header")), 2, HEADER), lambda x: x != ""))
    first_line = lambda pattern: F.try_element_at(F.filter("header_lines", lambda x: x.rlike(pattern)), F.lit(1))
    moments = F.regexp_extract_all("header", F.lit(f"({MOMENT})"), 1)
    rows = rows.withColumns({
        "number": first_line(r"^\d{1,10}$"), "dps": F.split(first_line(r"^\d{1,10}\s+\d{1,5}$"), r"\s+"), "competence": grab(c("header"), rf"(\d{{2}}/\d{{2}}/\d{{4}})\s+{MOMENT}"), "moments": moments,
        **{f"{party}_{f}": below(c(party), label) for party in ("provider", "customer") for f, label in PARTY.items()},
        **{f"{party}_{kind}": grab(c(party), pattern) for party in ("provider", "customer") for kind, pattern in (("company", COMPANY), ("person", PERSON))},
        **{f"{party}_zip": grab(c(party), r"(\d{5}-\d{3})") for party in ("provider", "customer")},
        **{f"{party}_town": below(c(party), r"Munic[íi]pio\b") for party in ("provider", "customer")},
        **{f: below(c(part), label) for f, (part, label) in TEXTS.items()},
        **{f"{f}_line": below(c(part), label) for f, (part, label) in AMOUNTS.items()},
        "iss_town": grab(c("municipal"), r"(?iu)Munic[íi]pio\s+de\s+Incid[eê]ncia\s+do\s+ISSQN[^\n]*\n([^\n]+)"), "result_country": grab(c("municipal"), r"(?iu)Pa[íi]s\s+Resultado[^\n]*\n([^\n]+)"),
        "regimes": F.filter(F.transform(F.split(grab(c("municipal"), r"(?iu)Regime\s+Especial\s+de\s+Tributa[çc][aã]o[^\n]*\n([^\n]+(?:\n[^\n]+)?)"), "\n"), F.trim), lambda x: ~x.isin("-", "")),
        "sums": F.regexp_extract_all("totals", F.lit(MONEY), 1), "federal_share": grab(c("totals"), r"(\d+,\d+)\s*%\s+\d+,\d+\s*%\s+\d+,\d+\s*%"), "nbs": grab(c("text"), r"(?i)NBS:\s*(\d+)"),
    })
    # what a value is read from is a column of its own, so that no line is looked up twice
    rows = rows.withColumns({
        **{f"{party}_id": F.coalesce(f"{party}_company", f"{party}_person") for party in ("provider", "customer")},
        **{f"{f}_money": grab(c(f"{f}_line"), MONEY) for f in (*AMOUNTS, "iss")},
        **{f"{party}_{n}_part": F.regexp_extract(f"{party}_town", pattern, 1) for party in ("provider", "customer") for n, pattern in (("town", r"^(.+?)\s*[-–]\s*[A-Z]{2}\b"), ("state", r"^.+?\s*[-–]\s*([A-Z]{2})\b"))},
    })
    rows = rows.withColumns({f: S.parse_number(F.coalesce(f"{f}_money", f"{f}_line")) for f in AMOUNTS})  # the first amount of a line, else the number it begins with
    gross = F.coalesce(S.parse_number(F.try_element_at("sums", F.lit(1))), c("base"))
    rows = rows.withColumn("gross", gross).withColumn("net", F.when(F.size("sums") > 1, S.parse_number(F.try_element_at("sums", F.lit(-1)))).otherwise(c("gross")))
    withheld = F.when(c("iss_line").isNotNull(), ~c("iss_line").rlike(r"(?iu)n[aã]o\s*retido"))
    rows = rows.withColumns({"simple": c("simple_line").rlike("(?i)optante"), "withheld": withheld})
    town = lambda party: F.coalesce(F.trim(F.nullif(c(f"{party}_town_part"), F.lit(""))), c(f"{party}_town"))
    state = lambda party: F.nullif(c(f"{party}_state_part"), F.lit(""))
    issued = F.try_element_at("moments", F.lit(1))
    wanted = (("prestador.cpf_cnpj", c("provider_id")), ("tomador.cpf_cnpj", c("customer_id")), ("numero_nota", c("number")), ("valor_bruto", F.nullif(c("gross"), F.lit(0.0))), ("data_emissao", issued), ("chave_acesso_nfse", c("access_key")))
    return rows.select(
        "doc_id", "access_key", "number", "competence", issued.alias("issued"), F.coalesce(F.try_element_at("moments", F.lit(2)), issued).alias("dps_issued"),
        F.try_element_at("dps", F.lit(1)).alias("dps_number"), F.try_element_at("dps", F.lit(2)).alias("dps_series"),
        *[f"{party}_{f}" for party in ("provider", "customer") for f in ("id", *PARTY, "zip")], *[e(party).alias(f"{party}_{n}") for party in ("provider", "customer") for n, e in (("town", town), ("state", state))],
        "simple", F.when(c("simple"), "SIMPLES_NACIONAL").otherwise(c("assessment")).alias("tax_regime"), *AMOUNTS, *[f for f in TEXTS if f not in ("simple_line", "assessment", "rate_line", "iss_line")],
        S.parse_number(F.replace("rate_line", F.lit("%"), F.lit(""))).alias("rate"), S.parse_number(c("iss_money")).alias("iss"), "withheld", F.when(c("withheld"), "Retido pelo Tomador").when(~c("withheld"), "Devido pelo Prestador").alias("iss_owed"),
        F.trim("iss_town").alias("iss_town"), F.trim("result_country").alias("result_country"), F.try_element_at("regimes", F.lit(1)).alias("special_regime"), "gross", "net",
        S.js_round(c("gross") * S.parse_number(c("federal_share")) / 100, 2).alias("approximate_taxes"), "nbs",
        F.filter(F.array(*[F.when(v.isNull(), F.lit(n)) for n, v in wanted]), lambda x: x.isNotNull()).alias("missing"),
    )
