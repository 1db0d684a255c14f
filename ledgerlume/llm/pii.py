"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors in a text: at-signs, plus signs, digits, URL schemes and
identifier cues. From each anchor a deterministic local parser walks to the left and right to the
boundary of an address, number or account and validates it. Parsers never look back over text that
their own kind has already taken, so every kind yields leftmost, non-overlapping spans and the cost
stays in proportion to the text.

Kinds: email, ip, card, phone (the base kinds), then url (`scheme://` or `mailto:`), account (what an
identifier cue announces, checked for its kind: an IBAN by its remainder modulo 97, a social security
number by its nine digits, other numbers by 6 to 34 letters and digits, half of them digits) and secret
(a key, token or password that is assigned: 16 signs or more, letters and digits mixed). Longer runs are
no identifiers; cues and schemes count in lower case, capitals, or with a capital.
Offsets are code points, the end exclusive. Base kinds are ASCII only.

Defined results: a null or empty text has no spans; whole texts are searched at any length; repeated
rows give repeated results; other columns pass by unseen; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import bounded_batches

KINDS = ("email", "ip", "card", "phone", "url", "account", "secret")
BASE = KINDS[:4]
RANK = {k: i for i, k in enumerate(KINDS)}

# Anchors of the added kinds.
SCHEMES = ("http://", "https://", "ftp://", "sftp://", "ws://", "wss://", "mailto:")
IBAN_CUES, SSN_CUES, PASSPORT_CUES = ("iban",), ("ssn",), ("passport", "passeport", "pasaporte", "reisepass")
ACCOUNT_CUES = ("account", "acct", "a/c", "konto", "compte", "cuenta")
SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "api-key", "apikey", "access_key", "private_key", "bearer")
NUMBER_WORDS = frozenset("number no nr num is numero número nummer".split())
#: Fewest and most signs of an identifier by the kind of its cue, and of a secret.
SIZES = {"iban": (15, 34), "ssn": (9, 9), "passport": (6, 9), "account": (6, 34)}
LEAST_SECRET, MOST_SECRET = 16, 512

DIGITS = frozenset("0123456789")
LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
LOCAL = LETTERS | DIGITS | frozenset("._%+-")
LABEL, SIGNS = LETTERS | DIGITS | frozenset("-"), LETTERS | DIGITS
KEY = SIGNS | frozenset("_+/=.-")
DIAL = DIGITS | frozenset(" ().-")
URL_STOP = frozenset(" \t\r\n\v\f<>\"'`|\\^{}")


def build_automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for c in DIGITS:
        found.add_word(c, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    forms = lambda word: {word, word.upper(), word.capitalize()}
    for word in SCHEMES:
        for form in forms(word):
            found.add_word(form, ("scheme", len(form)))
    for kind, words in (("iban", IBAN_CUES), ("ssn", SSN_CUES), ("passport", PASSPORT_CUES), ("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for word in words:
            for form in forms(word):
                found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def parse_email(s: str, at: int, floor: int) -> tuple[int, int] | None:
    """The address around the at-sign at `at`, its local part not before `floor`."""
    start = at
    while start > floor and s[start - 1] in LOCAL:
        start -= 1
    if start == at:
        return None
    n, end, labels = len(s), at + 1, 0
    while True:
        stop = end
        while stop < n and s[stop] in LABEL:
            stop += 1
        if stop == end:
            break
        labels, last = labels + 1, stop
        if stop < n and s[stop] == ".":
            end = stop + 1
        else:
            break
    return (start, last) if labels > 1 else None


def digit_end(s: str, i: int) -> int:
    n = len(s)
    while i < n and s[i] in DIGITS:
        i += 1
    return i


def parse_ip(s: str, start: int) -> tuple[int, bool, bool]:
    """(end, has four parts, all at most 255) of the dotted digits from `start`."""
    end, parts = digit_end(s, start), 1
    ok = small(s, start, end)
    while parts < 4 and end + 1 < len(s) and s[end] == "." and s[end + 1] in DIGITS:
        nxt = digit_end(s, end + 1)
        ok = ok and small(s, end + 1, nxt)
        end, parts = nxt, parts + 1
    return end, parts == 4, ok


def small(s: str, i: int, j: int) -> bool:
    part = s[i:j].lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def card_end(s: str, start: int) -> int:
    """The end of digits with single spaces or hyphens between them."""
    n, end = len(s), digit_end(s, start)
    while end + 1 < n and s[end] in " -" and s[end + 1] in DIGITS:
        end = digit_end(s, end + 1)
    return end


def parse_phone(s: str, plus: int) -> tuple[int, int] | None:
    n, i = len(s), plus + 1
    if i >= n or s[i] not in DIGITS:
        return None
    end = i + 1
    while end < n and s[end] in DIAL:
        end += 1
    while end > i + 1 and s[end - 1] not in DIGITS:
        end -= 1
    if end - (i + 1) < 2:
        return None
    return plus, end


def parse_url(s: str, start: int, body: int) -> tuple[int, int] | None:
    n, end = len(s), body
    while end < n and s[end] not in URL_STOP:
        end += 1
    while end > body and s[end - 1] in ".,;:!?)]":
        end -= 1
    return (start, end) if end - body > 3 and "." in s[body:end] else None


def valid_iban(signs: str) -> bool:
    """Two letters, two check digits, and the remainder 1 modulo 97 with these moved to the end."""
    if not (signs[:2].isalpha() and signs[2:4].isdigit()):
        return False
    return int("".join(str(int(c, 36)) for c in signs[4:] + signs[:4])) % 97 == 1


def joined(s: str, i: int) -> int:
    """Where at most four signs of joining end."""
    end = i
    while end < len(s) and end - i < 4 and s[end] in " :#.=":
        end += 1
    return end


def parse_account(s: str, after: int, kind: str) -> tuple[int, int] | None:
    """The identifier that follows a cue, past joining signs and words like `number`: groups of letters and digits.

    Groups after the first hold a digit each and stand one space or hyphen apart. An IBAN ends with the
    last group that makes it valid.
    """
    i = joined(s, after)
    if i == after:
        return None
    for _ in range(2):
        word = i
        while word < len(s) and s[word].isalpha():
            word += 1
        if s[i:word].lower() not in NUMBER_WORDS or (step := joined(s, word)) == word:
            break
        i = step
    least, most = SIZES[kind]
    start, ends, signs, digits = i, [], "", 0
    while len(signs) <= most:
        end = i
        while end < len(s) and s[end] in SIGNS and end - i <= most:
            end += 1
        group = s[i:end]
        if not group or (ends and not any(c in DIGITS for c in group)):
            break
        signs, digits = signs + group, digits + sum(c in DIGITS for c in group)
        ends.append((end, len(signs)))
        if end + 1 < len(s) and s[end] in " -" and s[end + 1] in SIGNS:
            i = end + 1
        else:
            break
    if kind == "iban":
        for end, size in reversed(ends):
            if least <= size <= most and valid_iban(signs[:size].upper()):
                return start, end
        return None
    if not ends or not least <= len(signs) <= most or digits * 2 < len(signs) or (kind == "ssn" and digits < 9):
        return None
    return start, ends[-1][0]


def parse_secret(s: str, after: int, cue: str) -> tuple[int, int] | None:
    """The value that is assigned to a key's name, without its quotes."""
    n, i, told = len(s), after, cue == "bearer"
    while i < n and i - after < 6 and s[i] in " \t\"':=>":
        told, i = told or s[i] in ":=", i + 1
    if i == after or not told:
        return None
    end = i
    while end < n and s[end] in KEY and end - i <= MOST_SECRET:
        end += 1
    while end > i and s[end - 1] in ".-":
        end -= 1
    value = s[i:end]
    mixed = any(c in DIGITS for c in value) and any(c in LETTERS for c in value) and len(set(value)) >= 8
    return (i, end) if LEAST_SECRET <= len(value) <= MOST_SECRET and mixed else None


def find_spans(s: str, automaton: ahocorasick.Automaton) -> list[tuple[int, str, int]]:
    """All spans as (start, kind, end), by start and then kind."""
    out: list[tuple[int, str, int]] = []
    taken = dict.fromkeys(KINDS, 0)
    for last, (anchor, size) in automaton.iter(s):
        if anchor == "digit":
            if last >= taken["ip"]:
                end, whole, ok = parse_ip(s, last)
                if whole and ok:
                    out.append((last, "ip", end))
                taken["ip"] = end
            if last >= taken["card"]:
                end = card_end(s, last)
                if end - last >= 14:
                    digits = s[last:end].replace(" ", "").replace("-", "")
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        out.append((last, "card", end))
                taken["card"] = end
        elif anchor == "at":
            if span := parse_email(s, last, taken["email"]):
                out.append((span[0], "email", span[1]))
                taken["email"] = span[1]
        elif anchor == "plus":
            if (span := parse_phone(s, last)) and 10 <= sum(c in DIGITS for c in s[last : span[1]]) <= 15:
                out.append((last, "phone", span[1]))
        elif anchor == "scheme":
            start = last + 1 - size
            if start >= taken["url"] and (start == 0 or s[start - 1] not in LETTERS) and (span := parse_url(s, start, last + 1)):
                out.append((start, "url", span[1]))
                taken["url"] = span[1]
        else:
            start, kind = last + 1 - size, "secret" if anchor == "secret" else "account"
            if (start == 0 or not s[start - 1].isalnum()) and last + 1 >= taken[kind]:
                span = parse_secret(s, last + 1, s[start : last + 1].lower()) if kind == "secret" else parse_account(s, last + 1, anchor)
                if span:
                    out.append((span[0], kind, span[1]))
                    taken[kind] = span[1]
    out.sort(key=lambda x: (x[0], RANK[x[1]]))
    return out


SPANS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField(
            "spans",
            T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])),
        ),
    ]
)


def detect(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, stop) of every row."""

    bounded_batches(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = build_automaton()
        kind_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            found = [
                [{"kind": k, "start": a, "stop": b} for a, k, b in find_spans(text, automaton)] if text else []
                for text in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind_type)], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(scan, SPANS)


def redact(text: str | None, spans, mask: str = "[{kind}]") -> str | None:
    """`text` with every span replaced; overlapping spans are merged under the first kind."""
    if text is None:
        return None
    out, at = [], 0
    for span in sorted(spans, key=lambda x: (x["start"], RANK[x["kind"]])):
        if span["start"] >= at:
            out += [text[at : span["start"]], mask.format(kind=span["kind"])]
        at = max(at, span["stop"])
    return "".join(out) + text[at:]


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans of every document."""
    found = detect(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    told = lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    of_kind = lambda k: F.filter("spans", lambda x: x["kind"] == k)
    count = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select(
        "doc_id",
        *count,
        F.sha2(F.array_join(F.transform(base, told), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", told), ",").alias("spans"),
    )
