"""Scalar expressions for fiscal data: parsing, formatting, validation, similarity, hashes.

All of them are Column expressions, so they stay inside Spark's code generation. Null in, null out
unless a docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that lose their accents, and what they become.
ACCENTED = "áàâãäéèêëíìîïóòôõöúùûüçñÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑ"
PLAIN = "aaaaaeeeeiiiiooooouuuucnAAAAAEEEEIIIIOOOOOUUUUCN"

# Weights of the company number's check digits.
CNPJ_FIRST = (5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2)
CNPJ_SECOND = (6, *CNPJ_FIRST)
CPF_FIRST = tuple(range(10, 1, -1))
CPF_SECOND = tuple(range(11, 1, -1))

# A letter read for a digit, and the digit.
OCR_DIGITS = (("O", "0"), ("l", "1"), ("I", "1"), ("S", "5"), ("B", "8"), ("G", "6"), ("Z", "2"), ("q", "9"))

# Parts of a failure message and its kind, first match first.
FAILURES = (
    (("timeout", "timed out"), "FALHA_TIMEOUT"),
    (("network", "econnrefused"), "FALHA_REDE"),
    (("storage", "enoent"), "FALHA_STORAGE"),
    (("ocr",), "FALHA_OCR"),
    (("parse", "parsing"), "FALHA_PARSING"),
    (("database", "prisma"), "FALHA_PERSISTENCIA"),
    (("hash", "integr"), "FALHA_INTEGRIDADE"),
    (("autoriza", "forbidden"), "FALHA_AUTORIZACAO"),
    (("concurrent", "lock"), "FALHA_CONCORRENCIA"),
    (("extract", "extração"), "FALHA_EXTRACAO"),
    (("valid",), "FALHA_VALIDACAO"),
    (("confiança", "confianca"), "FALHA_CONFIANCA"),
    (("audit",), "FALHA_AUDITORIA"),
    (("read", "leitura"), "FALHA_LEITURA"),
    (("upload",), "FALHA_UPLOAD"),
)


def let(value: Column, then) -> Column:
    """`then(value)` with the value worked out once, however often `then` uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def nonempty(*columns: Column) -> Column:
    """The first column that is neither null nor the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def js_round(x: Column, places: int = 0) -> Column:
    """floor(x * 10^n + 0.5) / 10^n on doubles: halves go up, also below zero."""
    scale = float(10**places)
    return F.floor(x.cast("double") * scale + 0.5) / F.lit(scale)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def strip_accents(text: Column) -> Column:
    return F.translate(text, ACCENTED, PLAIN)


def _check_digit(number: Column, weights: tuple[int, ...]) -> Column:
    total = sum((F.substring(number, i + 1, 1).cast("int") * w for i, w in enumerate(weights)), F.lit(0))
    rest = total % 11
    return F.when(rest < 2, 0).otherwise(11 - rest)


def _checked(number: Column, size: int, first: tuple[int, ...], second: tuple[int, ...]) -> Column:
    ok = (_check_digit(number, first) == F.substring(number, size - 1, 1).cast("int")) & (_check_digit(number, second) == F.substring(number, size, 1).cast("int"))
    same = number == F.repeat(F.substring(number, 1, 1), size)
    return F.when(F.length(number) == size, ~same & ok).otherwise(False)


def valid_cpf(text: Column) -> Column:
    """A personal number: eleven digits, not all equal, both check digits right; false for null."""
    return F.coalesce(let(digits(text), lambda d: _checked(d, 11, CPF_FIRST, CPF_SECOND)), F.lit(False))


def valid_cnpj(text: Column) -> Column:
    """A company number: fourteen digits, not all equal, both check digits right; false for null."""
    return F.coalesce(let(digits(text), lambda d: _checked(d, 14, CNPJ_FIRST, CNPJ_SECOND)), F.lit(False))


def valid_cnpj_digits(digits: Column) -> Column:
    """As `valid_cnpj`, of digits that are a column of their own: read many times, but in generated code."""
    return F.coalesce(_checked(digits, 14, CNPJ_FIRST, CNPJ_SECOND), F.lit(False))


def tax_id_kind(text: Column) -> Column:
    """CPF or CNPJ by the number of digits, else null."""
    n = F.length(digits(text))
    return F.when(n == 11, "CPF").when(n == 14, "CNPJ")


def valid_tax_id(text: Column) -> Column:
    size = F.length(digits(text))
    return F.when(size == 11, valid_cpf(text)).when(size == 14, valid_cnpj(text)).otherwise(False)


def format_tax_id(text: Column) -> Column:
    """Punctuated by kind; other texts stay as they are."""
    d = digits(text)
    return (
        F.when(F.length(d) == 11, F.regexp_replace(d, r"^(\d{3})(\d{3})(\d{3})(\d{2})$", "$1.$2.$3-$4"))
        .when(F.length(d) == 14, F.regexp_replace(d, r"^(\d{2})(\d{3})(\d{3})(\d{4})(\d{2})$", "$1.$2.$3/$4-$5"))
        .otherwise(text)
    )


def format_money(value: Column) -> Column:
    """R$ with points between thousands and two decimals; a dash for null."""
    return F.coalesce(F.concat(F.when(value < 0, "-").otherwise(""), F.lit("R$ "), decimal_text(F.abs(value))), F.lit("—"))


def decimal_text(value: Column) -> Column:
    return F.translate(F.format_number(value, 2), ",.", ".,")


def format_date(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "dd/MM/yyyy"), F.lit("—"))


def format_rate(value: Column) -> Column:
    return F.coalesce(F.concat(F.translate(F.format_string("%.2f", value), ".", ","), F.lit("%")), F.lit("—"))


def leading_number(text: Column) -> Column:
    """The number that a text begins with, as a double: '12abc' is 12, 'abc' is null."""
    return F.nullif(F.regexp_extract(F.trim(text), r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", 0), F.lit("")).try_cast("double")


def parse_number(text: Column) -> Column:
    """'R$ 1.092,34' to 1092.34: points between thousands go, the comma becomes the point."""
    plain = F.regexp_replace(F.regexp_replace(text, r"R\$|\s", ""), r"\.", "")
    return leading_number(F.regexp_replace(plain, "^([^,]*),", "$1."))


def form_number(text: Column) -> Column:
    """A number typed with a decimal point, whole text or nothing."""
    return F.trim(text).try_cast("double")


def parse_date(text: Column) -> Column:
    """'dd/MM/yyyy...' to a date from 1900 on; null where the calendar has no such day."""
    found = F.regexp_extract(text, r"^(\d{2}/\d{2}/\d{4})", 1)
    day = F.try_to_date(F.nullif(found, F.lit("")), "dd/MM/yyyy")
    return F.when(F.year(day) >= 1900, day)


def fixed(value: Column, places: int) -> Column:
    """A number with so many decimals; null for null."""
    return F.when(value.isNotNull(), F.format_string(f"%.{places}f", value))


def normal_money(text: Column) -> Column:
    return fixed(parse_number(F.nullif(F.trim(text), F.lit(""))), 2)


def normal_tax_id(text: Column) -> Column:
    """Digits only, if there are at least eleven; no check digits."""
    d = digits(text)
    return F.when(F.length(d) >= 11, d)


def normal_date(text: Column) -> Column:
    turned = F.regexp_replace(text, r"^(\d{2})/(\d{2})/(\d{4})(?:(\s)\s*(\d{2}:\d{2}:\d{2}))?.*$", "$3-$2-$1$4$5")
    return F.when(text.rlike(r"^\d{2}/\d{2}/\d{4}"), turned).otherwise(F.trim(text))


def normal_percent(text: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(text, r"[%\s]", ""), "^([^,]*),", "$1.")
    return fixed(leading_number(plain), 4)


def normal_text(text: Column) -> Column:
    """Lower case without accents, punctuation or runs of white space."""
    return F.trim(F.regexp_replace(F.regexp_replace(strip_accents(F.lower(text)), r"[^\w\s]", " "), r"\s+", " "))


def normal_boolean(text: Column) -> Column:
    t = F.trim(F.lower(text))
    return F.when(t.isin("true", "sim", "1", "retido"), "true").when(t.isin("false", "nao", "não", "0"), "false").otherwise(t)


#: Normal forms by the kind of a value; any other kind is trimmed.
NORMAL = {"money": normal_money, "cnpj": normal_tax_id, "cpf": normal_tax_id, "date": normal_date, "percent": normal_percent, "text": normal_text, "boolean": normal_boolean}


def normal_form(text: Column, kind: str) -> Column:
    """The normal form of a value whose kind is known beforehand."""
    return NORMAL.get(kind, F.trim)(text)


def normalise(text: Column, kind: Column) -> Column:
    """The normal form of a value by its row's kind."""
    out = F.when(F.lit(False), text)
    for name, form in NORMAL.items():
        out = out.when(kind == name, form(text))
    return out.otherwise(F.trim(text))


def bigrams(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2)))


def dice(a: Column, b: Column) -> Column:
    """Dice similarity of bigrams as multisets; texts under two characters only equal themselves.

    Meant for field values: the cost grows with the product of the lengths.
    """
    ga, gb = bigrams(a), bigrams(b)
    times = lambda grams, g: F.size(F.filter(grams, lambda x: x == g))
    common = F.aggregate(F.array_distinct(ga), F.lit(0), lambda n, g: n + F.least(times(ga, g), times(gb, g)))
    short = (F.length(a) < 2) | (F.length(b) < 2)
    return F.when(a == b, 1.0).when(short, 0.0).otherwise(2.0 * common / (F.length(a) + F.length(b) - 2))


def concordance(raw_a: Column, raw_b: Column, a: Column, b: Column) -> Column:
    """How two readings of a field and their normalised forms agree; never null."""
    unlike = let(  # worked out once, and only where the other cases leave it open
        dice(a, b), lambda d: F.when(d >= 0.95, "DIVERGENCIA_LEVE").when(d >= 0.75, "DIVERGENCIA_MODERADA").otherwise("DIVERGENCIA_CRITICA")
    )
    return (
        F.when(a.isNull() & b.isNull(), "CONCORDANCIA_TOTAL")
        .when(a.isNull() | b.isNull(), "DIVERGENCIA_MODERADA")
        .when((a == b) & (F.coalesce(raw_a, F.lit("")) == F.coalesce(raw_b, F.lit(""))), "CONCORDANCIA_TOTAL")
        .when(a == b, "CONCORDANCIA_FUNCIONAL")
        .otherwise(unlike)
    )


def repair_digits(text: Column) -> Column:
    """Letters that stand for digits, where a neighbour is a digit, point, slash or hyphen in the text as read."""
    return F.when(text.isNotNull(), let(text, _repair))


def _repair(text: Column) -> Column:
    """Letters to repair are marked in one pass over the text as read, then replaced one kind after the other."""
    letters, near, mark = "".join(letter for letter, _ in OCR_DIGITS), r"[\d./\-]", "\ue000"
    text = F.regexp_replace(text, rf"(?<={near})([{letters}])|([{letters}])(?={near})", f"{mark}$1$2")
    for letter, digit in OCR_DIGITS:
        text = F.replace(text, F.lit(mark + letter), F.lit(digit))
    return text


def djb2(text: Column) -> Column:
    """32-bit xor hash of a text's characters, as eight hex digits."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    value = F.aggregate(F.filter(codes, lambda c: c > 0), F.lit(5381).cast("long"), lambda h, c: ((h * 33).bitwiseAND(0xFFFFFFFF)).bitwiseXOR(c))
    return F.lpad(F.lower(F.hex(value)), 8, "0")


# What is masked, in this order.
REDACTIONS = (
    (r"\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}", "[CNPJ]"),
    (r"\d{3}\.\d{3}\.\d{3}-\d{2}", "[CPF]"),
    (r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "[EMAIL]"),
    (r"(?:\(\d{2}\)\s*)?\d{4,5}[-.\s]?\d{4}", "[TEL]"),
)


def redact(text: Column) -> Column:
    """Company and personal numbers, e-mail addresses and phones masked, in that order."""
    for pattern, mask in REDACTIONS:
        text = F.regexp_replace(text, pattern, mask)
    return text


def failure_kind(message: Column) -> Column:
    """The kind of a failure message; the first part found decides."""
    low, out = F.lower(message), F.when(F.lit(False), "")
    for parts, kind in FAILURES:
        found = F.lit(False)
        for part in parts:
            found = found | F.contains(low, F.lit(part))
        out = out.when(found, kind)
    return out.otherwise("FALHA_EXTRACAO")


def backoff_seconds(attempt: Column, base: Column, most: Column) -> Column:
    """Exponential delay without jitter, at least one second."""
    return F.greatest(F.lit(1.0), F.least(base * F.pow(F.lit(2.0), attempt - 1), most.cast("double")))


def next_version(version: Column) -> Column:
    """x.y.z to x.y.(z+1)."""
    part = F.split(version, r"\.")
    return F.concat_ws(".", F.element_at(part, 1), F.element_at(part, 2), (F.element_at(part, 3).cast("int") + 1).cast("string"))


def extractor_level(confidence: Column) -> Column:
    return F.when(confidence >= 90, "ALTA").when(confidence >= 70, "MEDIA").when(confidence >= 50, "BAIXA").otherwise("CRITICA")


def global_level(confidence: Column) -> Column:
    return F.when(confidence >= 95, "MUITO_ALTA").when(confidence >= 85, "ALTA").when(confidence >= 70, "MEDIA").when(confidence >= 50, "BAIXA").otherwise("MUITO_BAIXA")


def ownership_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"\s+", "")


def scanned(text: Column) -> Column:
    """A text that looks like a bad scan: few different characters, or very short lines on average."""
    lines = segments(text)
    mean = F.aggregate(lines, F.lit(0), lambda n, s: n + F.length(s)) / F.greatest(F.size(lines), F.lit(1))
    return (F.size(F.array_distinct(F.split(text, ""))) < 30) | (mean < 8)


def segments(text: Column) -> Column:
    """Trimmed lines that are not empty."""
    return F.filter(F.transform(F.split(text, "\n"), lambda s: F.trim(s)), lambda s: s != "")


def add_months(day: Column, months: int) -> Column:
    """Months later, at the latest on the month's last day."""
    return F.add_months(day, months)


def days_left(day: Column, now: Column) -> Column:
    return F.datediff(F.to_date(day), F.to_date(now))


def expiry_status(days: Column, near: int = 30) -> Column:
    return F.when(days < 0, "VENCIDO").when(days <= near, "PROXIMO").otherwise("VALIDO")


def strip_company_suffix(name: Column, most: int = 24) -> Column:
    return F.substring(F.regexp_replace(name, r"(?i)\s+(Ltda|S\.A|ME|EIRELI)\.?$", ""), 1, most)
