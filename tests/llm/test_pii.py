import hashlib
import random
import re

from ledgerlume.llm import pii as P

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(s):
    digits = lambda m: re.sub("[^0-9]", "", m)
    out = [(m.start(), "email", m.end()) for m in EMAIL.finditer(s)]
    out += [(m.start(), "ip", m.end()) for m in IP.finditer(s) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), "card", m.end()) for m in CARD.finditer(s) if 14 <= len(digits(m[0])) <= 19 and P.luhn(digits(m[0]))]
    out += [(m.start(), "phone", m.end()) for m in PHONE.finditer(s) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda x: (x[0], P.RANK[x[1]]))


def base(s, automaton=P.build_automaton()):
    return [x for x in P.find_spans(s, automaton) if x[1] in P.BASE]


def test_random_texts_match_the_patterns():
    rng = random.Random(3)
    alphabets = ["a@.-b1 +", "0123456789.", "0123456789 -", "+12 ().-", "ab@.%_+-é1", "4111 1111-", "1.2@a+9 "]
    for i in range(30_000):
        s = "".join(rng.choices(alphabets[i % len(alphabets)], k=rng.randrange(60)))
        assert base(s) == brute(s), s


def test_planted_forms():
    s = "é x.y+z@mail.example.com, 10.0.0.255 1.2.3.256, 4111 1111 1111 1111 +1 (017) 555-7713."
    assert [k for _, k, _ in base(s)] == ["email", "ip", "card", "phone"] and base(s) == brute(s)
    more = P.find_spans("see https://a.example/x?y=1. IBAN: DE89 3704 0044 0532 0130 00, account 123456", P.build_automaton())
    assert [k for _, k, _ in more if k not in P.BASE] == ["url", "account", "account"]


def found(s):
    return [(k, s[a:b]) for a, k, b in P.find_spans(s, P.build_automaton()) if k not in P.BASE]


def test_identifiers_are_checked_by_their_kind():
    assert found("IBAN: de89 3704 0044 0532 0130 00 und 4 mehr") == [("account", "de89 3704 0044 0532 0130 00")]
    assert found("iban DE88 3704 0044 0532 0130 00") == [] and found("IBAN GB82WEST12345698765432 4 x") == [("account", "GB82WEST12345698765432")]
    assert found("Account number 12345678, passport no. X1234567; SSN is 123-45-6789") == [("account", "12345678"), ("account", "X1234567"), ("account", "123-45-6789")]
    assert found("account 12345") == [] and found("account " + "1" * 35) == [] and found("ssn 12-34") == [] and found("accounting 12345678") == [] and found("account closed 2019") == []
    assert found("HTTPS://A.example/x now") == [("url", "HTTPS://A.example/x")]


def test_secrets_that_are_assigned():
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    assert found(f'token = "{key}"!!') == [("secret", key)] and found(f"API_KEY: '{key}'") == [("secret", key)] and found(f"Bearer {key}.") == [("secret", key)]
    assert found(f"token {key}") == [] and found("token = short1") == [] and found("password: aaaaaaaaaaaaaaaaaaaaaaaa1") == [] and found("tokens = " + key) == []
    assert found("token = " + "a1b2c3d4" * 100) == []


def test_nulls_long_texts_repeats_and_extra_columns(spark):
    long = "word " * 100_000 + "a@b.co"
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, long, "x"), (3, long, "x"), (None, "a@b.co", "x")], "doc_id long, text string, spans string")
    got = sorted(((r.doc_id or -1, [(x.kind, x.start, x.stop) for x in r.spans]) for r in P.detect(docs).collect()), key=str)
    hit = [("email", 500_000, 500_006)]
    assert got == sorted([(1, []), (2, []), (3, hit), (3, hit), (-1, [("email", 0, 6)])], key=str)
    assert P.detect(docs.limit(0)).count() == 0


def test_query_on_the_small_tables(spark):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in P.op3_pii(spark, d).collect():
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, k, b in want).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for _, k, _ in want) for kind in P.BASE)


def test_redact():
    s = "mail a@b.co now"
    assert P.redact(s, [{"kind": k, "start": a, "stop": b} for a, k, b in base(s)]) == "mail [email] now"
