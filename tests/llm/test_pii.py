import random
import re

import pytest

import __spark_entry__ as entry
from featuremill.llm import pii as P
from featuremill.llm.queries import PII_KEY

from .helpers import awkward, column_rows, empty

KEY = b"k"
VALUES = [
    ("card", "4111111111111111"), ("card", "4111-1111-1111-1111"), ("card", "378282246310005"), ("phone", "+1 (555) 555-1234"), ("phone", "+1-212-555-0199"), ("ip", "10.0.0.255"),
    ("ssn", "123-45-6789"), ("ssn", "899-99-9999"), ("date", "1999-12-31"), ("date", "29/02/2000"), ("date", "01.01.1900"), ("iban", "DE89370400440532013000"),
    ("iban", "GB82 WEST 1234 5698 7654 32"), ("secret", "ab1e" * 10), ("secret", "AB01" * 10), ("email", "a.b-9@mail3.example.com"), ("email", "Éric.ñ7@x.org"),
]
INVALID = ["4111111111111112", "300.1.1.1", "01.2.3.4", "1999-02-29", "666-12-1234", "000-12-1234", "DE88370400440532013000", "1.2.3.4.5", "12345678901234567890"]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 10, 97, 1000])
def test_permutation_is_one_to_one(size):
    seen = [P.permute(i, size, KEY, "t") for i in range(size)]
    assert sorted(seen) == list(range(size))
    assert [P.permute(v, size, KEY, "t", back=True) for v in seen] == list(range(size))
    if size >= 97:
        assert seen != [P.permute(i, size, b"other", "t") for i in range(size)] and seen != [P.permute(i, size, KEY, "u") for i in range(size)]


@pytest.mark.parametrize("kind,value", VALUES)
def test_values_keep_their_format(kind, value):
    text = f'say "{value}" and\n"{value}".' if kind == "secret" else f"say {value} and\n{value}."
    out, spans = P.pseudonymise_text(text, KEY)
    assert [k for _, _, k in spans] == [kind, kind] and all(text[s:e] == value for s, e, _ in spans)
    assert value not in out
    again, found = P.pseudonymise_text(out, KEY, back=True)
    assert again == text and [k for _, _, k in found] == [kind, kind]
    new = out[5 : 5 + len(value)] if kind == "secret" else out.split("say ")[1].split(" and\n")[0]
    assert out.count(new) == 2
    if kind not in ("ip", "email", "secret"):
        assert re.sub("[0-9]", "9", new) == re.sub("[0-9]", "9", value) if kind != "iban" else len(new) == len(value)


@pytest.mark.parametrize("value", INVALID)
def test_invalid_values_stay(value):
    assert P.pseudonymise_text(f"x {value} y", KEY) == (f"x {value} y", [])


def test_neighbours_and_edges():
    card = "4111111111111111"
    out, spans = P.pseudonymise_text(f"{card} {card}!!1.2.3.4,5", KEY)
    assert [(s, e, k) for s, e, k in spans] == [(0, 16, "card"), (17, 33, "card"), (35, 42, "ip")]
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice([*"0123456789.-+@() /\"aZé\n", *(v for _, v in VALUES)]) for _ in range(rng.randrange(30)))
        P.pseudonymise_text(text, KEY)


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0


def test_query_round_trip(spark, sf):
    docs = dict(column_rows(sf, "documents", "doc_id", "text"))
    got = entry.queries()["op4_pii"](spark, sf).collect()
    assert {r.doc_id for r in got} == set(docs)
    linked = {}
    for r in got:
        t = docs[r.doc_id]
        cards = [m for m in re.findall(r"(?<!\d)\d{16}(?!\d)", t) if luhn(m)]
        private = cards + re.findall(r"\+1 \(\d{3}\) \d{3}-\d{4}|[\w.]+@mail\d\.example\.com|(?<=\")[0-9a-fA-F]{40}(?=\")", t) + re.findall(r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])", t)
        assert r.n_replaced == len(private) and not any(re.search(rf"(?<!\d){re.escape(p)}(?!\d)", r.text) for p in private)
        assert P.pseudonymise_text(r.text, PII_KEY, back=True)[0] == t
        last, at = 0, 0
        for s in r.pii_spans:
            at += s.start - last
            value, last = t[s.start : s.end], s.end
            new = P.swap(s.kind, value, PII_KEY)
            assert r.text[at : at + len(new)] == new and linked.setdefault(value, new) == new
            at += len(new)
    assert len(linked) > 10


def test_awkward_and_empty(spark):
    df = awkward(spark)
    out = P.pseudonymise(df, KEY)
    assert out.columns == [*df.columns, "pii_spans"]
    assert sorted(map(str, out.select(*df.columns).collect())) == sorted(map(str, df.collect()))
    assert P.pseudonymise(empty(spark), KEY).count() == 0
