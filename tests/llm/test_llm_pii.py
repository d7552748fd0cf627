"""Personal data against the plain expressions."""

import random
import re
import time

import pytest

from pyspark.sql import functions as F

from barspark.llm import pii
from barspark.llm import queries as Q

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def digits(s):
    return [int(c) for c in s if c in "0123456789"]


def plain(text):
    def luhn(d):
        return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1])) % 10 == 0

    fits = {"email": lambda s: True, "ip": lambda s: all(int(x) <= 255 for x in s.split(".")), "card": lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s)), "phone": lambda s: 8 <= len(digits(s)) <= 15}
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text) if fits[k](m.group())]


def base(text):
    return [s[:3] for s in pii.find(text) if s.base]


@pytest.mark.parametrize("letters", ["a@.-1 ", "0123456789 -+().", "1.2 25", "ab@.é+-%_ ", "459 -", "+1 (0)-.x", "\U0001f600@a.1"])
def test_base_spans_are_those_of_the_plain_expressions(letters):
    rng = random.Random(letters)
    for _ in range(3000):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        assert base(t) == plain(t), t


def test_cards_and_odd_texts():
    rng = random.Random(3)
    hits = 0
    for _ in range(4000):
        t = "".join(rng.choice("0123456789") + rng.choice(["", "", "", " ", "-", "  "]) for _ in range(rng.randint(14, 22))) + rng.choice(["", " x", "@b.co", "\n4111 1111 1111 1111"])
        assert base(t) == plain(t), t
        hits += any(k == "card" for k, *_ in base(t))
    assert hits > 100
    assert base("000255.1.1.1") == [("ip", 0, 12)] and base("256.1.1.1") == [] and base("9" * 6000 + ".1.1.1") == []
    assert base("٤٤٤٤ ４１１１１１１１１１１１１１１１") == []


def test_linear_on_long_texts():
    begun = time.monotonic()
    for t in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1 " * 100_000, "+1" + " " * 300_000, "1-" * 150_000, "AB12" * 80_000, "a.b@c." * 150_000):
        pii.find(t)
    assert time.monotonic() - begun < 30


def test_validators():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and pii.mod97("DE89370400440532013000") and not pii.mod97("DE89370400440532013001")


def kinds(text):
    return [(s.kind, text[s.start:s.end]) for s in pii.find(text) if not s.base]


def test_added_spans_need_a_validator_and_their_context():
    assert kinds("pay to GB82 WEST 1234 5698 7654 32 IN time") == [("iban", "GB82 WEST 1234 5698 7654 32")]
    assert kinds("pay to GB82 WEST 1234 5698 7654 33 now") == [] and kinds("GB82WEST123456987654321") == []
    assert kinds("my phone 555 123-4567 ok") == [("phone", "555 123-4567")] and kinds("code 555 123-4567 ok") == []
    assert kinds("ssn 123-45-6789") == [("id", "123-45-6789")] and kinds("part 123-45-6789") == [] and kinds("ssn 000-45-6789") == []
    assert kinds("card 378282246310005 amex") == [("card", "378282246310005")] and kinds("order 378282246310005") == []
    assert kinds("call +1 (826) 555-4081 190.137.2.1") == [("phone", "+1 (826) 555-4081")]
    assert kinds("card 4111 1111 1111 1111 12") == [("card", "4111 1111 1111 1111")]


def test_context_moves_the_score_of_base_spans_but_keeps_them():
    near, bare, against = (pii.find(t)[0].score for t in ("server 10.0.0.1", "10.0.0.1", "version 10.0.0.1"))
    assert near > bare > against and all(s.base for s in pii.find("version 10.0.0.1"))


def test_table_with_odd_rows(spark, tmp_path):
    rows = [(1, "mail a.b@c.de now, or +1 (017) 555-7713"), (1, "mail a.b@c.de now, or +1 (017) 555-7713"), (2, None), (None, "é\U0001f600 x@y.zz"), (3, ""), (4, "10.1.2.3 " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"spans": F.lit(1), "kind": F.lit("x"), "base": F.lit("y")})
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = Q.op12_personal_data(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got) == [(0, 1, 0, 0, 0), (1, 1, 0, 0, 1), (1, 1, 0, 0, 1), (2, 0, 0, 0, 0), (3, 0, 0, 0, 0), (4, 0, 20_000, 0, 0)]
    assert {r.doc_id: r.spans for r in got}[None] == "email:3:9" and {r.spans for r in got if r.doc_id == 1} == {"email:5:13,phone:22:39"}
    assert pii.personal_data(df.where("doc_id > 99")).count() == 0
