import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from featuremill.llm import licenses as L

from .helpers import LOWER, awkward, empty

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def base(text):
    w = words(text)
    places = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places}))


def index(templates=L.PHRASES + L.NOTICES):
    vocabulary = {}
    for t in templates:
        for w in L._listed(t.text):
            vocabulary.setdefault(w, len(vocabulary))
    return L.Index(templates, vocabulary, L.np.array([len(w) for w in vocabulary], float))


def labels(text, i=None):
    i = i or index()
    return {i.templates[t].label for t, _, _ in i.scan(text.encode())[1]}


def test_query_against_plain_python(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = entry.queries()["op12_license_scan"](spark, sf).collect()
    assert len(rows) == len(texts) and any(r.n_base for r in rows)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert r.labels == ",".join(sorted(set(filter(None, r.labels.split(","))))) and 0 <= r.score <= 1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("gnu general public license Apache LICENSE cc by mit x İ \x00 , . - version 3 2 0 nc 4".split() + ["\n"]), max_size=40))
def test_every_place_of_a_phrase(parts):
    text = " ".join(parts)
    n, found = SCANNER.scan(text.encode())
    places = [(s, SCANNER.templates[t].label) for t, s, _ in found if t < len(L.PHRASES)]
    starts = [s for s, _ in places]
    assert (n, len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))) == base(text)


SCANNER = index()


def test_whole_notices_and_edited_ones():
    for t in L.NOTICES:
        assert t.label in labels("Foo bar.\n# " + t.text.replace(". ", ".\n# ") + " baz")
    mit = next(t for t in L.NOTICES if t.label == "mit")
    assert labels("x " * 5000 + mit.text + " y" * 5000) == {"mit"}
    assert "mit" in labels(mit.text.replace("substantial portions", "major parts").replace("merge, ", ""))
    assert "mit" not in labels(mit.text.replace("free of charge", "for a fee"))  # a key phrase is missing
    assert "mit" not in labels("Permission is hereby granted, free of charge. To deal in the Software without restriction.")  # too little of the rest
    assert labels("mit der license by general apache gnu cc") == set()


def test_two_copies_are_two_places():
    bsd = next(t for t in L.NOTICES if t.label == "bsd")
    found = SCANNER.scan((bsd.text + " other words here " * 20 + bsd.text).encode())[1]
    assert [(SCANNER.templates[t].label, s) for t, s, _ in found] == [("bsd", 0), ("bsd", len(words(bsd.text)) + 60)]


def test_awkward_and_empty(spark):
    docs = awkward(spark).selectExpr("*", "1 AS n_words", "2 AS matches")
    got = sorted((str(r.doc_id), r.n_words, len(r.matches)) for r in L.scan(docs).collect())
    assert got == sorted((str(r.doc_id), len(words(r.text)), 0) for r in docs.collect())
    assert L.scan(empty(spark)).collect() == []


def test_templates_are_checked(spark):
    for bad in (L.Template("a", "--"), L.Template("a", "one two", ("two one",))):
        with pytest.raises(ValueError):
            L.build_index(awkward(spark), [bad])


def test_long_texts_are_read_whole():
    text = "word " * 400_000 + "Apache License" + " word" * 400_000 + " mit-license"
    n, found = SCANNER.scan(text.encode())
    assert n == 800_004 and [s for _, s, _ in found] == [400_000, 800_002]
