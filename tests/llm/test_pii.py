import hashlib
import random
import re

import pytest

from fieldloom.llm import pii

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def passes_luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def expected(text):
    out = []
    for kind, pattern in BASE.items():
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")),
                    "card": 13 <= len(digits) <= 19 and passes_luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def check(spark, texts):
    rows = pii.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = expected(texts[r.doc_id])
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        base = ",".join(x for x in r.spans.split(",") if x.split(":")[0] in BASE)
        assert base == said, texts[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in want) for kind in BASE]
    return {r.doc_id: r.spans for r in rows}


def test_random_texts_against_plain_patterns(spark):
    draw = random.Random(5)
    bits = ["a", "Z9", "@", ".", "-", "+", " ", "  ", "é", "€", "😀", "1", "12", "255", "256", "0003", "4111 1111 1111 1111", "4111-1111-1111-1112",
            "_", "%", "b.c", "x@y.zz", "(", ")", "+49 30 123", "10.0.0.1", "\n", "7" * 14, "79927398713"]
    check(spark, ["".join(draw.choices(bits, k=draw.randint(0, 25))) for _ in range(3000)])


def test_empty_null_and_long(spark):
    many = " ".join(f"u{i}@h{i}.org" for i in range(20_000))
    check(spark, [None, "", " ", "1" * 50_000, "a" * 50_000, "a." * 20_000 + "@", "x@" + "a." * 20_000 + "b", "+1" + "-" * 50_000, "1 " * 20_000, "1." * 20_000, many,
                  "A1" * 20_000, "a@b.c_d@e.f.+g@h.i"])


def test_added_kinds(spark):
    found = check(spark, ["account DE89 3704 0044 0532 0130 00.", "account DE88 3704 0044 0532 0130 00.", "ssn 123-45-6789", "order 123-45-6789", "ssn 000-45-6789", "xDE89370400440532013000"])
    assert found[0].endswith("iban:8:35") and "iban" not in found[1] + found[5]
    assert found[2] == "national_id:4:15" and found[3] == found[4] == ""


def test_mask(spark):
    docs = spark.createDataFrame([(1, "mail é a@b.org now", "k"), (2, None, "k"), (3, "", "k"), (4, "no", "k"), (5, "+1 10.0.0.1 55555 x", "k")], "doc_id long, text string, score string")
    got = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert got[1] == "mail é <EMAIL> now" and got[2] is None and got[3] == "" and got[4] == "no"
    assert got[5] == "<PHONE> x"
    assert pii.redact(docs).columns == docs.columns and pii.redact(docs.limit(0)).count() == 0


def test_clash_and_ties(spark):
    docs = spark.createDataFrame([(1, "a@b.org", 0), (1, "a@b.org", 0)], "doc_id long, text string, pii int")
    with pytest.raises(ValueError):
        pii.find_pii(docs)
    assert len(set(pii.digest(docs).collect())) == 1


def test_masking_with_a_column_of_the_same_name(spark):
    docs = spark.createDataFrame([(1, "mail a@b.org", "x", 1)], "doc_id int, text string, pii string, PII_ int")
    assert [tuple(r) for r in pii.redact(docs).collect()] == [(1, "mail <EMAIL>", "x", 1)]
