import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import __spark_entry__ as entry
from featuremill.llm import packing as P

from .helpers import awkward, column_rows, empty, groups

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
TOKENIZER.encode_special_tokens = True


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [1]


def check(pieces, docs, length=2048):
    by_doc, by_seq = groups((p["doc_id"], p) for p in pieces), groups((p["sequence_id"], p) for p in pieces)
    for d, text in docs:
        want, at = ids_of(text), 0
        for p in sorted(by_doc[d], key=lambda p: p["start"]):
            ids = want[at : at + p["length"]]
            assert p["start"] == at and p["doc_tokens"] == len(want) and len(ids) == p["length"]
            assert p["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
            at += p["length"]
        assert at == len(want)
    for s in by_seq.values():
        at = 0
        for p in sorted(s, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= length
    return sum(p["length"] for p in pieces) / (length * len(by_seq))


def test_query_round_trip(spark, sf):
    docs = column_rows(sf, "documents", "doc_id", "text")
    pieces = [r.asDict() for r in entry.queries()["op5_packing"](spark, sf).collect()]
    assert check(pieces, docs) > 0.97


def test_many_tasks_merge_over_levels(spark, monkeypatch):
    monkeypatch.setattr(P, "FAN_IN", 2)
    docs = [(i, f"text number {i} " * (i % 40)) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    out = P.pack(df, length=64, limit=4)
    rows = [r.asDict() | {"ids_crc32": zlib.crc32(bytes(r.token_ids))} for r in out.collect()]
    assert check(rows, docs, 64) > 0.93
    again = P.pack(df, length=64, limit=4)
    assert sorted((r["doc_id"], r["start"], r["sequence_id"]) for r in rows) == sorted((r.doc_id, r.start, r.sequence_id) for r in again.collect())


def test_windows_best_fit_and_closing():
    w = P.Windows(10, 2)
    assert w.add(6, "a") is None and w.add(7, "b") is None
    assert w.add(3, "c") == ["b", "c"]  # fills the tighter one
    assert w.add(8, "d") is None
    assert w.add(9, "e") == ["d"]  # none has room: the fullest closes
    assert w.rest() == [["e"], ["a"]]
    assert w.add(10, "f") == ["e", None, "f"]


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_pieces_give_the_ids_of_the_whole(text):
    assert np.frombuffer(P.encoder(public_tokenizers.path("byte_bpe_50k.json")).of([text])[0], "<u4").tolist() == ids_of(text)[:-1]


@pytest.mark.parametrize("text", ["a  b   c\n\n d\t\te ", "it's we'LL  don't", "\x1c\x1d x\u0085y z w​", " 12³ ½ ９", "<|endoftext|>x<|endoftext|>", "ȩ́a", "　　あ  い"])
def test_odd_white_space(text):
    assert np.frombuffer(P.encoder(public_tokenizers.path("byte_bpe_50k.json")).of([text])[0], "<u4").tolist() == ids_of(text)[:-1]


def test_every_kind_of_white_space_in_every_place():
    white = [chr(c) for c in range(0x10000) if chr(c).isspace()] + ["\u180e", "\u200b", "\ufeff", "\x00"]
    texts = [f"{a}x!{a}{b}y{b}{b}!!{a}{b}{a} 1{b}" for a in white for b in (" ", "\n", "\t", "\xa0", "\x1c")]
    ids = P._Ids(public_tokenizers.path("byte_bpe_50k.json"), room=1500)
    assert [np.frombuffer(i, "<u4").tolist() for i in ids.of(texts)] == [ids_of(t)[:-1] for t in texts]
    assert [i for t in texts for i in ids.of([t])] == ids.of(texts)


_PARTS = st.sampled_from(["a", "Wort", "don't", "x's", "'re", "12", "½", "é", "ß", "×", "日本", "\u0301", ".", ",", "...", "?!", ";)", "-", "'", '"', " ", "\n", "  ", "\n\n", " \n", "\n ", "\n\n\n", "\t", "\xa0", "\x00", "\x01", "<|endoftext|>"])


@settings(max_examples=120, deadline=None)
@given(st.lists(st.lists(_PARTS, max_size=14).map("".join), max_size=6), st.sampled_from([0, 200, 1 << 20]))
def test_words_and_marks_in_any_order(texts, room):
    ids = KEPT.setdefault(room, P._Ids(public_tokenizers.path("byte_bpe_50k.json"), room=room))
    for _ in range(2):
        assert [np.frombuffer(i, "<u4").tolist() for i in ids.of(texts)] == [ids_of(t)[:-1] for t in texts]


KEPT = {}


def test_long_texts_are_cut_between_words(monkeypatch, sf):
    monkeypatch.setattr(P, "SLICE_BYTES", 400)
    texts = [t or "" for _, t in column_rows(sf, "documents", "doc_id", "text")][:150] + ["x" * 1500, "a " * 700, "a  b " * 300, "one\n two " * 200, " " * 900, "日本" * 600]
    ids = P._Ids(public_tokenizers.path("byte_bpe_50k.json"))
    assert [np.frombuffer(i, "<u4").tolist() for i in ids.of(texts)] == [ids_of(t)[:-1] for t in texts]


def test_kept_words_stay_within_their_room():
    ids = P._Ids(public_tokenizers.path("byte_bpe_50k.json"), room=3000)
    for i in range(20):
        ids.of([" ".join(f"word{j}" for j in range(i * 30, i * 30 + 90))])
        kept = sum(len(w.encode()) for w in ids.words.to_pylist()) + 4 * len(ids.ids) + 16 * len(ids.words)
        assert kept <= 3000 and len(ids.ends) == len(ids.words) + 1 and ids.ends[-1] == len(ids.ids)


def test_awkward_and_empty(spark):
    df = awkward(spark)
    rows = [r.asDict() | {"ids_crc32": zlib.crc32(bytes(r.token_ids))} for r in P.pack(df).collect()]
    assert sum(r["length"] for r in rows if r["doc_id"] == 2) == 2 * len(ids_of("Alpha BETA gamma delta"))
    assert sum(r["length"] for r in rows if r["doc_id"] == 3) == 1
    assert sum(r["length"] for r in rows) == sum(len(ids_of(r.text)) for r in df.collect())
    assert P.pack(empty(spark)).count() == 0
