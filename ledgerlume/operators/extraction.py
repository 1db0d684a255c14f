"""Classification of invoice texts and two independent extractions of their fields.

Both work on text columns only. The first reads fields from the lines after their labels, the second
searches the whole text; results are long rows (doc_id, method, field, value, confidence, how).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

# Evidence (pattern over lower-case text without accents, weight) of document types and layouts.
GOODS = (
    (r"\bdanfe\b", 40),
    (r"nota fiscal eletronica", 25),
    (r"chave de acesso", 25),
    (r"dados dos produtos\s*/?\s*servicos", 25),
    (r"identificacao do emitente", 20),
    (r"destinatario\s*/?\s*remetente", 15),
    (r"natureza da operacao", 10),
    (r"\bnf-?e\b", 10),
    (r"\d{4}(\s?\d{4}){10}", 20),
)
SERVICE = (
    (r"nfs-?e", 30),
    (r"\bissqn\b", 30),
    (r"prestador de servicos", 25),
    (r"tomador de servicos", 25),
    (r"codigo de verificacao", 20),
    (r"discriminacao dos servicos", 15),
    (r"data do fato gerador", 10),
)
LAYOUT_2 = (
    (r"danfse\s*v\s*2\.0", 50),
    (r"tributacao\s*ibs\s*/?\s*cbs", 35),
    (r"cclasstrib", 25),
    (r"prestador\s*/\s*fornecedor", 25),
    (r"tomador\s*/\s*adquirente", 25),
    (r"tributacao\s*federal\s*\(?\s*exceto\s*cbs", 20),
    (r"valor\s*liquido\s*da\s*nfs-?e\s*\+\s*ibs\s*/?\s*cbs", 20),
    (r"indicador\s*municipal\s*\(\s*inscricao", 15),
    (r"codigo\s*ibge\s*/\s*cep", 15),
    (r"documento\s*auxiliar\s*da\s*nfs-?e", 10),
    (r"chave\s*de\s*acesso\s*da\s*nfs-?e", 10),
    (r"competencia\s*da\s*nfs-?e", 10),
    (r"numero\s*da\s*dps", 10),
    (r"serie\s*da\s*dps", 10),
)
LAYOUT_1 = (
    (r"\bdanfse\b", 50),
    (r"documento auxiliar da nfs-?e", 25),
    (r"chave de acesso da nfs-?e", 25),
    (r"competencia da nfs-?e", 20),
    (r"numero da dps", 20),
    (r"serie da dps", 15),
    (r"\b\d{50}\b", 20),
    (r"codigo de tributacao nacional", 15),
    (r"emitente da nfs-?e", 10),
)
GOODS_LEAST, LAYOUT_2_LEAST, LAYOUT_1_LEAST = 60, 110, 50


def evidence(plain: Column, patterns: tuple[tuple[str, int], ...]) -> Column:
    """Sum of the weights of all patterns that occur; each counts once."""
    return reduce(lambda a, b: a + b, [F.when(plain.rlike(p), w).otherwise(0) for p, w in patterns])


def classify(docs: DataFrame) -> DataFrame:
    """doc_id, scores, document type, route and layout."""
    plain = docs.select("doc_id", F.lower(S.strip_accents("text")).alias("plain"))
    rows = plain.select(
        "doc_id", evidence(F.col("plain"), GOODS).alias("goods"), evidence(F.col("plain"), SERVICE).alias("service"),
        evidence(F.col("plain"), LAYOUT_2).alias("second"), evidence(F.col("plain"), LAYOUT_1).alias("first"),
    )
    goods = (F.col("goods") >= GOODS_LEAST) & (F.col("goods") > F.col("service"))
    layout = F.when(F.col("second") >= LAYOUT_2_LEAST, "DANFSE_V2").when(F.col("first") >= LAYOUT_1_LEAST, "DANFSE_NACIONAL").otherwise("MUNICIPAL")
    return rows.select(
        "doc_id", "goods", "service",
        F.when(goods, "DANFE").when(F.col("service") > 0, "NFSE").otherwise("DESCONHECIDO").alias("kind"),
        F.when(goods, "DANFE").otherwise("NFSE").alias("route"), layout.alias("layout"),
    )


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, pos, line: trimmed lines that are not empty."""
    return docs.select("doc_id", F.posexplode(S.segments(F.col("text"))).alias("pos", "line"))


def grab(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))  # searched once: a condition and its branch would search twice


def below(text: Column, label: str, lines: int = 1) -> Column:
    """The line so many lines below the first one that begins with `label`; lines of `text` are trimmed and not empty."""
    return grab(text, rf"(?m)^(?:{label})[^\n]*\n" + r"[^\n]*\n" * (lines - 1) + r"([^\n]+)")


MONEY = r"R\$\s*([\d.]+,\d{2})"
TAX_ID = r"([\dOlISBGZq]{2}\.[\dOlISBGZq]{3}\.[\dOlISBGZq]{3}/[\dOlISBGZq]{4}-[\dOlISBGZq]{2})"

# Section of each field, whether it is critical, how its values are normalised, its weight.
FIELDS = (
    ("numero", "cabecalho", True, "text", 10),
    ("data_emissao", "cabecalho", True, "date", 10),
    ("prestador_cnpj", "prestador", True, "cnpj", 10),
    ("tomador_cnpj", "tomador", True, "cnpj", 10),
    ("tomador_email", "tomador", False, "text", 3),
    ("base_calculo", "financeiro", True, "money", 9),
    ("aliquota", "financeiro", True, "percent", 8),
    ("valor_iss", "financeiro", True, "money", 9),
    ("valor_bruto", "financeiro", True, "money", 10),
    ("valor_liquido", "financeiro", True, "money", 10),
)
#: Fields that only one of the parties can own, with their labels.
PARTY_FIELDS = (("email", "E-mail"), ("telefone", "Telefone"), ("endereco", "Endereço"), ("inscricao_municipal", "Inscrição Municipal"))
SECTION_WEIGHTS = (("cabecalho", 25), ("prestador", 20), ("tomador", 20), ("servicos", 15), ("financeiro", 15), ("fiscal", 5))


#: A field's value, how sure its reader is of it, and by which method it was read.
Reading = dict[str, tuple[Column, Column, Column]]


def _told(reading: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    """A reading in which what wasn't found has no confidence."""
    value, confidence, how = reading
    return value, F.when(value.isNull(), 0.0).otherwise(confidence.cast("double")), F.when(value.isNull(), "campo_ausente").otherwise(how)


def _long(rows: DataFrame, method: str, fields: Reading) -> DataFrame:
    made = [F.struct(F.lit(f).alias("field"), *[c.alias(n) for c, n in zip(_told(r), ("value", "confidence", "how"), strict=True)]) for f, r in fields.items()]
    return rows.select("doc_id", F.lit(method).alias("method"), F.inline(F.array(*made)))


def values(rows: DataFrame, fields: Reading) -> DataFrame:
    """One row per document, a column per field; a reading is wide from the start and is never pivoted."""
    return rows.select("doc_id", *[value.alias(f) for f, (value, _, _) in fields.items()])


def paired(rows: DataFrame, first: Reading, second: Reading, kept: tuple[str, ...] = (), by_field: dict[str, dict[str, Column]] | None = None) -> DataFrame:
    """Both readings of every field side by side with their normal forms, from one pass over the texts: no join.

    A field's kind is known here, so each value goes through its own normal form only, before rows are made of them.
    Columns of `kept` stand in every row of the document; `by_field` has further numbers by name and field, 0 for the others.
    """
    more = {f"{n}_{f}": c for n, of in (by_field or {}).items() for f, c in of.items()}
    settings = {f: (section, critical, norm, weight) for f, section, critical, norm, weight in FIELDS}
    kind = {f: settings.get(f, (None, False, "text", None))[2] for f in first}
    told = {(t, f): _told(reading[f]) for t, reading in (("a", first), ("b", second)) for f in first}
    rows = rows.select("doc_id", *kept, *[c.alias(n) for n, c in more.items()], *[c.alias(f"{t}_{n}_{f}") for (t, f), reading in told.items() for c, n in zip(reading, ("value", "conf", "how"), strict=True)])
    rows = rows.select("*", *[S.normal_form(F.col(f"{t}_value_{f}"), kind[f]).alias(f"{t}_norm_{f}") for t, f in told])

    def row(f: str) -> Column:
        section, critical, _, weight = settings.get(f, (None, False, "text", None))
        fixed = [F.lit(f).alias("field"), F.lit(section).cast("string").alias("section"), F.lit(critical).alias("critical"), F.lit(weight).cast("int").alias("weight")]
        numbers = [(F.col(f"{n}_{f}") if f in of else F.lit(0)).cast("long").alias(n) for n, of in (by_field or {}).items()]
        return F.struct(*fixed, *numbers, *[F.col(f"{t}_{n}_{f}").alias(f"{n}_{t}") for t in "ab" for n in ("value", "conf", "how", "norm")])

    return rows.select("doc_id", *kept, F.inline(F.array(*[row(f) for f in first])))


def trimmed(docs: DataFrame) -> DataFrame:
    """doc_id, text, lines: the text, and its trimmed lines that are not empty as one text."""
    lines = F.regexp_replace("text", r"(?<! ) *\n[ \n]*", "\n")  # as `segments` cuts them, in one replacement; a run of blanks is entered at its beginning only
    return docs.select("doc_id", "text", F.btrim(lines, F.lit(" \n")).alias("lines"))


#: Labels of the amounts in a text, by field.
AMOUNTS = (
    ("base_calculo", "Base de c[áa]lculo"), ("valor_iss", "Valor ISS"), ("valor_bruto", "Valor bruto"), ("valor_liquido", "Valor l[íi]quido"),
    ("ir", "IR"), ("pis_pasep", "PIS/PASEP"), ("cofins", "COFINS"), ("inss", "INSS"), ("csll", "CSLL"), ("outras_retencoes", "OUTRAS RETENÇÕES"),
)
WITHHELD = ("ir", "pis_pasep", "cofins", "inss", "csll", "outras_retencoes")


def amount_lines(text: Column, labels: list[str], before: str, between: str) -> Column:
    """All amounts behind one of the labels, with their labels, a line each: the text is searched once, then each label in these few lines."""
    found = F.regexp_extract_all(text, F.lit(rf"{before}((?:{'|'.join(labels)}){between}R\$\s*[\d.]+,\d{{2}})"), 1)
    return F.array_join(found, "\n")


def label_reading(rows: DataFrame) -> tuple[DataFrame, Reading]:
    """First extraction: what stands after labels, digits repaired where a scan took letters for them. One search of the lines per field."""
    t = F.col("lines")
    rows = rows.withColumn("amounts", amount_lines(t, [label for _, label in AMOUNTS], "(?m)^", " = "))
    money = lambda label: grab(F.col("amounts"), rf"(?m)^{label} = {MONEY}")
    anchored, read = F.lit("pattern_com_ancora"), F.lit("ocr_reparado")
    labels = {"provider": "PRESTADOR|IDENTIFICAÇÃO DO EMITENTE", "customer": "TOMADOR|DESTINATÁRIO"}
    # each step is a column of its own: a repaired number is used many times by its check digits
    rows = rows.withColumns({f"{p}_read": grab(below(t, label, 2), TAX_ID) for p, label in labels.items()})
    rows = rows.withColumns({f"{p}_id": S.repair_digits(F.col(f"{p}_read")) for p in labels})
    rows = rows.withColumns({f"{p}_digits": S.digits(F.col(f"{p}_id")) for p in labels})
    rows = rows.withColumns({f"{p}_ok": S.valid_cnpj_digits(F.col(f"{p}_digits")) for p in labels})
    conf = lambda p: F.lit(75) + F.when(F.col(f"{p}_ok"), 25).otherwise(0)
    how = lambda p: F.when(F.col(f"{p}_read") == F.col(f"{p}_id"), anchored).otherwise(read)
    sure = {"base_calculo": 90, "valor_iss": 88, "valor_bruto": 95, "valor_liquido": 95}
    amounts = {f: (money(label), F.lit(sure[f]), anchored) for f, label in AMOUNTS if f in sure}
    return rows, {
        "numero": (grab(below(t, "Número da Nota"), r"^(\d{1,10})$"), F.lit(95), anchored),
        "data_emissao": (grab(below(t, "Data do Fato Gerador|Emissão|Competência da NFS-e"), r"^(\d{2}/\d{2}/\d{4})"), F.lit(100), anchored),
        "prestador_cnpj": (F.col("provider_id"), conf("provider"), how("provider")),
        "tomador_cnpj": (F.col("customer_id"), conf("customer"), how("customer")),
        "tomador_email": (F.lower(grab(t, r"E-mail: (\S+@\S+)")), F.lit(100), anchored),
        "base_calculo": amounts["base_calculo"],
        "aliquota": (grab(t, r"(?m)^Alíquota = ([\d,]+)%"), F.lit(88), anchored),
        "valor_iss": amounts["valor_iss"],
        "valor_bruto": amounts["valor_bruto"],
        "valor_liquido": amounts["valor_liquido"],
    }


def search_reading(rows: DataFrame) -> tuple[DataFrame, Reading]:
    """Second extraction: patterns over the whole text; the rate is worked out from the tax and its base."""
    t = F.col("text")
    rows = rows.withColumn("ids", F.regexp_extract_all(t, F.lit(r"(\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2})"), 1))
    labels = {f: label for f, label in AMOUNTS if f not in WITHHELD}
    rows = rows.withColumn("b_amounts", amount_lines(t, list(labels.values()), "(?i)", r"\s*=?\s*"))
    money = lambda label: grab(F.col("b_amounts"), rf"(?i){label}\s*=?\s*{MONEY}")
    rows = rows.withColumns({"b_iss": money("Valor ISS"), "b_base": money("Base de c[áa]lculo")})
    iss, base, ids = F.col("b_iss"), F.col("b_base"), F.col("ids")
    rate = S.js_round(S.parse_number(iss) / F.nullif(S.parse_number(base), F.lit(0.0)) * 100, 0)
    seen = F.lit("regex_global")
    return rows, {
        "numero": (grab(t, r"(?i)n[úu]mero da nota\s*\n\s*(\d+)"), F.lit(85), seen),
        "data_emissao": (grab(t, r"(\d{2}/\d{2}/\d{4})"), F.lit(80), seen),
        "prestador_cnpj": (F.try_element_at(ids, F.lit(1)), F.lit(80), seen),
        "tomador_cnpj": (F.try_element_at(ids, F.lit(2)), F.lit(75), seen),
        "tomador_email": (F.lower(grab(t, r"([\w.+-]+@[\w-]+\.[\w.-]+)")), F.lit(80), seen),
        "base_calculo": (base, F.lit(80), seen),
        "aliquota": (F.translate(F.format_string("%.2f", rate), ".", ","), F.lit(70), F.lit("derivado_calculo")),
        "valor_iss": (iss, F.lit(80), seen),
        "valor_bruto": (money("Valor bruto"), F.lit(85), seen),
        "valor_liquido": (money("Valor l[íi]quido"), F.lit(85), seen),
    }


def by_labels(docs: DataFrame) -> DataFrame:
    """The first extraction as long rows (doc_id, method, field, value, confidence, how)."""
    rows, fields = label_reading(trimmed(docs))
    return _long(rows, "A", fields)


def by_search(docs: DataFrame) -> DataFrame:
    """The second extraction as long rows."""
    rows, fields = search_reading(docs.select("doc_id", "text"))
    return _long(rows, "B", fields)


def both(docs: DataFrame) -> DataFrame:
    """Both extractions of every document and field."""
    rows, first = label_reading(trimmed(docs))
    rows, second = search_reading(rows)
    return paired(rows, first, second)


def fiscal_reading(rows: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """Withholdings, service code, classification and approximate taxes of the lines, after `label_reading`.

    The classification reads what follows OUTRAS INFORMAÇÕES (the whole text without it), the last line of a kind;
    approximate taxes the first such line and the two below it.
    """
    t = F.col("lines")
    info = F.regexp_extract(t, r"(?idms)^([^\n]*outras\s+informa[çc][oõ]es.*)", 1)
    approximate = F.regexp_extract(t, r"(?idm)^([^\n]*Valor\s+aproximado\s+do\s+tributo[^\n]*(?:\n[^\n]*){0,2})", 1)
    money = lambda label: grab(F.col("amounts"), rf"(?m)^{label} = {MONEY}")
    rows = rows.withColumns({"info": F.when(info == "", t).otherwise(info), "approximate": F.replace(approximate, F.lit("\n"), F.lit(" "))})
    last = lambda label: F.trim(F.try_element_at(F.regexp_extract_all("info", F.lit(rf"(?i){label}:\s*([^\n]+)"), 1), F.lit(-1)))
    says = lambda pattern: F.col("info").rlike(f"(?i){pattern}")
    part = lambda level, percent: grab(F.col("approximate"), rf"(?i){level}\s*[-–]\s*R\$\s*" + (r"[\d.,]+\s*\((\d+(?:,\d+)?)%\)" if percent else r"([\d.,]+)"))
    return rows, {
        **{f: money(label) for f, label in AMOUNTS if f in WITHHELD},
        "codigo_servico": grab(t, r"(?m)^Código do Serviço = (\S+)"),
        "natureza_operacao": last("Natureza da opera[çc][aã]o"),
        "situacao_issqn": last("Situa[çc][aã]o tribut[aá]ria do ISSQN"),
        "local_prestacao": last("Local da presta[çc][aã]o do servi[çc]o"),
        "situacao_nfse": last("Situa[çc][aã]o desta NFS-e"),
        "simples_nacional": says("optante pelo Simples Nacional"),
        "me_epp": says(r"ME\s+ou\s+EPP"),
        "mei": says(r"Microempreendedor\s+Individual|optante\s+pelo\s+MEI"),
        **{f"{level}_{kind}": part(level, kind == "pct") for level in ("federal", "estadual", "municipal") for kind in ("val", "pct")},
    }

def fiscal_facts(docs: DataFrame) -> DataFrame:
    """One row per document: the first extraction's values and the fiscal block, from one pass over the lines."""
    rows, fields = label_reading(trimmed(docs))
    rows, more = fiscal_reading(rows)
    return rows.select("doc_id", *[value.alias(f) for f, (value, _, _) in fields.items()], *[c.alias(n) for n, c in more.items()])


def facts_and_readings(docs: DataFrame) -> tuple[DataFrame, Reading, Reading]:
    """The columns of `fiscal_facts` and both extractions over the same rows, so that rules and comparison share one pass over the texts."""
    rows, first = label_reading(trimmed(docs))
    rows, second = search_reading(rows)
    rows, more = fiscal_reading(rows)
    rows = rows.withColumns({f: value for f, (value, _, _) in first.items()} | more)
    return rows, {f: (F.col(f), confidence, how) for f, (_, confidence, how) in first.items()}, second


def classification(facts: DataFrame) -> DataFrame:
    """doc_id, tax regime, kind of provider, whether the tax is withheld and who owes it."""
    withheld = F.coalesce(F.col("situacao_issqn").rlike("(?i)reten[çc][aã]o"), F.lit(False)) | F.coalesce(F.col("situacao_nfse").rlike("(?i)retida"), F.lit(False))
    return facts.select(
        "doc_id",
        F.when(F.col("mei"), "MEI").when(F.col("simples_nacional"), "SIMPLES_NACIONAL").otherwise("DESCONHECIDO").alias("regime_tributario"),
        F.when(F.col("mei"), "MEI").when(F.col("me_epp"), "ME_EPP").when(F.col("simples_nacional"), "EMPRESA_GERAL").otherwise("DESCONHECIDO").alias("tipo_prestador"),
        withheld.alias("iss_retido"),
        F.when(withheld, "TOMADOR").otherwise("PRESTADOR").alias("responsavel_iss"),
        "natureza_operacao", "situacao_issqn", "situacao_nfse", "local_prestacao", "simples_nacional",
    )


def party_readings(docs: DataFrame) -> tuple[DataFrame, Reading, Reading]:
    """The parties' exclusive fields, read twice: by labels within each party's own section; and by search, which gives the
    whole text's first value to the provider and its last to the customer, without regard to sections."""
    sections = {"prestador": r"(?s)PRESTADOR DE SERVIÇOS\n(.*?)TOMADOR DE SERVIÇOS\n", "tomador": r"(?s)TOMADOR DE SERVIÇOS\n(.*?)DISCRIMINAÇÃO"}
    rows = docs.select("doc_id", "text", *[F.regexp_extract("text", pattern, 1).alias(side) for side, pattern in sections.items()])
    found = lambda label, at: F.try_element_at(F.regexp_extract_all("text", F.lit(rf"(?m)^{label}: (.+)$"), 1), F.lit(at))
    first = {f"{side}_{f}": (grab(F.col(side), rf"(?m)^{label}: (.+)$"), F.lit(100), F.lit("pattern_com_ancora")) for side in sections for f, label in PARTY_FIELDS}
    second = {f"{side}_{f}": (found(label, at), F.lit(80), F.lit("regex_global")) for side, at in (("prestador", 1), ("tomador", -1)) for f, label in PARTY_FIELDS}
    return rows, first, second


def merged(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Field by field: the extra reading wins unless it is null."""
    b = base.select("doc_id", "field", F.col("value").alias("base_value"))
    e = extra.select("doc_id", "field", F.col("value").alias("extra_value"))
    return b.join(e, ["doc_id", "field"], "full_outer").select("doc_id", "field", F.coalesce("extra_value", "base_value").alias("value"))
