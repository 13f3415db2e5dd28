"""Personal data, against a plain reading of the contract."""

import hashlib
import re

import pytest
from nasty import documents, texts

from eventfold.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def fits(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def base_spans(text):
    return [
        (kind, m.start(), m.end())
        for kind, pattern in BASE.items()
        for m in re.finditer(pattern, text or "")
        if fits(kind, m[0])
    ]


def joined(spans):
    return ",".join(f"{k}:{b}:{e}" for k, b, e in spans)


ODD = [
    (1, "a@b.c%d@e.f g@h i@j.k. @l.m n@o..p x.@y-.z-"),
    (2, "1.2.3.4.5.6.7.8 256.1.1.1 255.255.255.255 001.02.3.0004 1.2.3 0256.1.1.1"),
    (3, "4111 1111 1111 1111 and 4111-1111-1111-1112, 5500005555555559x4111111111111111"),
    (4, "8 4111 1111 1111 1111"),
    (5, "+1 (743) 555-3824 +12 +123456789012345 +1234567890123456 ++44 20 7946 0958."),
    (6, "😀 é+1 (743) 555-3824 日本 me@例.com me@b.co 😀 1.1.1.1"),
    (7, "9" * 5000),
    (8, "1.1.1.1 " * 300),
    (9, "b" * 5000 + "@" + "c." * 3000 + "d"),
    (10, "+1 " * 2000 + "x"),
    (11, None),
    (12, ""),
    (None, "x@y.zz"),
    (8, "1.1.1.1 " * 300),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = pii.personal_data(documents(spark, ODD + texts())).collect()
    return rows


def test_base_spans_are_those_of_the_contract(spark, found):
    want = sorted((repr(i), joined(base_spans(t))) for i, t in ODD + texts())
    got = [
        (repr(r.doc_id), joined((s.kind, s.start, s.end) for s in r.spans if s.base)) for r in found
    ]
    assert sorted(got) == want
    digest = pii.digest(pii.personal_data(documents(spark, ODD + texts()))).collect()
    assert sorted((repr(r.doc_id), r.base_sha256) for r in digest) == sorted(
        (i, hashlib.sha256(s.encode()).hexdigest()) for i, s in want
    )
    assert sum(r.n_ip for r in digest) == sum(s.count("ip:") for _, s in want)
    assert sum(r.n_email for r in digest) == sum(s.count("email:") for _, s in want)


def test_values_are_what_stands_at_the_span(found):
    known = {repr(i): t for i, t in ODD}
    for r in found:
        for s in r.spans:
            if repr(r.doc_id) in known and r.doc_id != 8:
                assert known[repr(r.doc_id)][s.start : s.end] == s.value
            assert 0 < s.score <= 1


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("my IBAN is DE89 3704 0044 0532 0130 00 here", [("iban", 11, 38)]),
        ("GB82WEST12345698765432", [("iban", 0, 22)]),
        ("GB82WEST12345698765433", []),  # a wrong check
        ("XX82WEST12345698765432", []),  # no such country
        ("her SSN: 123-45-6789", [("ssn", 9, 20)]),
        ("part 123-45-6789", []),  # nothing says what it is
        ("ssn 000-45-6789 ssn 123-45-0000", []),  # never given out
        ("ssn " + "x " * 30 + "123-45-6789", []),  # named too far away
        ('token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', [("secret", 9, 49)]),
        ("commit 24be64439e3e49cf46b2d7c90f3602a3d0b907ff", []),
        ("password aaaaaaaaaaaaaaaaaaaaaaaaaaaaa", []),  # a word
        ("call (212) 555-1234 or phone 212-555-9876", [("tel", 5, 19), ("tel", 29, 41)]),
        ("sum 212 555 1234", []),
        ("call +1 (212) 555-1234", [("phone", 5, 22)]),
    ],
)
def test_added_kinds(spark, text, kinds):
    (row,) = pii.personal_data(documents(spark, [(1, text)])).collect()
    assert [(s.kind, s.start, s.end) for s in row.spans] == kinds


def test_context_raises_the_score(spark):
    rows = pii.personal_data(documents(spark, [(1, "host 1.2.3.4"), (2, "v 1.2.3.4")])).collect()
    near, far = (r.spans[0].score for r in sorted(rows))
    assert near > far


def test_nothing_but_spark_functions(spark, no_docs):
    plan = pii.digest(pii.personal_data(no_docs))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert pii.digest(pii.personal_data(no_docs)).collect() == []


def test_whole_table(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    want = sorted((r.doc_id, joined(base_spans(r.text))) for r in docs.select("doc_id", "text").collect())
    got = pii.personal_data(docs).collect()
    assert want == sorted(
        (r.doc_id, joined((s.kind, s.start, s.end) for s in r.spans if s.base)) for r in got
    )
