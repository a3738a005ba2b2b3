"""Bounded-space online packing of token ids into fixed-length sequences."""

from __future__ import annotations

import os
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..session import cut_lineage
from .batches import slices

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task on each core already

LENGTH, OPEN, FAN_IN, END = 2048, 64, 32, 1
#: Text that is encoded at a time, and bytes of words whose ids a worker keeps, between tasks too.
SLICE_BYTES, KNOWN_BYTES = 2 << 20, 8 << 20

# White space as the tokenizer's pattern sees it, and letters that every version of Unicode has as such.
_WHITE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
#: Texts that are cut with care: other white space than blanks and line ends, runs of more than two, or of two at the end; or marks.
_ODD = "[\t\x0b\x0c\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\x00\x01]|[ \n]{3}|[ \n]{2}\\z"
#: Stands before a word that no blank goes before.
_MARK = "\x01"


class _Ids:
    """Ids of texts. A word's ids are kept, as one of many in a few long arrays, until words that came later need the room."""

    def __init__(self, vocabulary: str, room: int = KNOWN_BYTES):
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = True
        self.room = room
        self.split = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+").findall
        # The vocabulary spells each byte as one character; printable ones of Latin-1 stand for themselves.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [x for x in range(256) if x not in plain]
        self.spelling = {x: x for x in plain} | {x: 256 + i for i, x in enumerate(rest)}
        self.words = pa.array([], pa.string())
        self.ids, self.ends = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def of(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, as little-endian bytes.

        The tokenizer cuts a text by a pattern and never merges over the cuts. It always cuts before a blank or line end that follows another
        character, and between a letter and a mark of punctuation. So the ids of a text are those of its words, a word being what lies between
        such places, with the white space before it; runs of white space, which the pattern takes together, are left whole.
        """
        pieces, of = [], []
        for i, t in enumerate(texts):
            while len(t) > SLICE_BYTES // 2 and (cut := self._place(t)) > 0:
                pieces.append(t[:cut])
                of.append(i)
                t = t[cut:]
            pieces.append(t)
            of.append(i)
        column = pa.array(pieces, pa.string())
        odd = pc.match_substring_regex(column, _ODD).to_numpy(zero_copy_only=False)
        out: list[list[bytes]] = [[] for _ in texts]
        parts: list[bytes] = [b""] * len(pieces)
        for i in np.flatnonzero(odd).tolist():
            parts[i] = self._careful(pieces[i])
        smooth = np.flatnonzero(~odd)
        for i, x in zip(smooth.tolist(), self._smooth(column.take(pa.array(smooth)))):
            parts[i] = x
        for i, x in zip(of, parts):
            out[i].append(x)
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]

    @staticmethod
    def _place(text: str) -> int:
        """A blank between two words in the first half of SLICE_BYTES, where a long text can be cut; 0 if there is none."""
        at = SLICE_BYTES // 2
        while (at := text.rfind(" ", 1, at)) > 0:
            if not text[at - 1].isspace() and not text[at + 1 : at + 2].isspace() and at + 1 < len(text):
                return at
        return 0

    def _careful(self, text: str) -> bytes:
        words = self.split(text)
        each = list(dict.fromkeys(words))
        of = {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(each, self.tokenizer.encode_batch_fast(each, add_special_tokens=False))}
        return b"".join(map(of.__getitem__, words))

    def _smooth(self, texts: pa.StringArray) -> list[bytes]:
        """Ids of texts without odd white space. Words are cut, counted and laid out in arrays; only words not known are looked at one by one."""
        if len(texts) == 0:
            return []
        marked = pc.binary_join_element_wise(pa.scalar(_MARK), texts, "")
        marked = pc.replace_substring(marked, "\n", f" {_MARK}\n")
        marked = pc.replace_substring_regex(marked, f"([{_LETTERS}])([.,;:!?])", rf"\1 {_MARK}\2")
        lists = pc.split_pattern(marked, " ")
        coded = lists.flatten().dictionary_encode()
        words, codes = coded.dictionary, coded.indices.to_numpy()
        at = pc.index_in(words, self.words)
        fresh = at.is_null()
        new_ids, new_ends = self._encode(words.filter(fresh))
        ids = np.concatenate([self.ids, new_ids])
        ends = np.concatenate([self.ends, len(self.ids) + new_ends[1:]])
        row = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        mask = fresh.to_numpy(zero_copy_only=False)
        row[mask] = len(self.words) + np.arange(mask.sum())
        flat, stops = _gather(ids, ends, row[codes])
        bounds = stops[lists.offsets.to_numpy()].tolist()
        self._keep(words, row, ids, ends)
        out = [flat[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
        del marked, lists, coded, words, codes, at, fresh, ids, ends, flat
        pa.default_memory_pool().release_unused()  # a worker shares its executor with others
        return out

    def _encode(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different words laid end to end, and where each ends. A word of letters is one piece of the pattern, and goes to the model as it is."""
        plain = pc.match_substring_regex(words, f"^{_MARK}?[{_LETTERS}]+$").to_numpy(zero_copy_only=False)
        whole = [w[1:] if w[:1] == _MARK else " " + w for w in words.to_pylist()]
        model, spelling = self.tokenizer.model.tokenize, self.spelling
        each: list[list[int]] = [[] for _ in whole]
        for i in np.flatnonzero(plain).tolist():
            each[i] = [x.id for x in model(whole[i].encode().decode("latin-1").translate(spelling))]
        rest = np.flatnonzero(~plain).tolist()
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([whole[i] for i in rest], add_special_tokens=False)):
            each[i] = e.ids
        ends = np.concatenate([[0], np.cumsum([len(x) for x in each], dtype=np.int64)])
        return np.fromiter((x for ids in each for x in ids), "<u4", ends[-1]), ends

    def _keep(self, words: pa.StringArray, row: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> None:
        """Keep the ids of the words just seen, then of those known before, as far as there is room."""
        before = np.ones(len(self.words), bool)
        before[row[row < len(before)]] = False
        order = np.concatenate([row, np.flatnonzero(before)])
        names = pa.concat_arrays([words, self.words.filter(pa.array(before))])
        cost = pc.binary_length(names).to_numpy() + 4 * (ends[order + 1] - ends[order]) + 16
        n = int(np.searchsorted(np.cumsum(cost), self.room, "right"))
        self.words = pa.concat_arrays([names.slice(0, n)]) if n < len(names) else names
        self.ids, self.ends = _gather(ids, ends, order[:n])


def _gather(ids: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``ids`` laid end to end in the order of ``rows``, and where each ends, from 0."""
    sizes = ends[rows + 1] - ends[rows]
    stops = np.concatenate([[0], np.cumsum(sizes)])
    small = np.int32 if max(len(ids), int(stops[-1])) < 1 << 31 else np.int64
    at = np.repeat((ends[rows] - stops[:-1]).astype(small), sizes)
    at += np.arange(stops[-1], dtype=small)
    return ids[at], stops


@cache
def encoder(vocabulary: str) -> _Ids:
    return _Ids(vocabulary)


class Windows:
    """At most ``limit`` open windows. A piece goes where it leaves least room; when none has room, the fullest is closed."""

    def __init__(self, length: int, limit: int):
        self.length, self.limit = length, limit
        self.free: list[tuple[int, int]] = []  # (room, window), sorted
        self.held: dict[int, list] = {}
        self.made = 0

    def add(self, size: int, piece) -> list | None:
        """Place a piece; gives back the window that was closed for it, if any."""
        closed = None
        i = bisect_left(self.free, (size, -1))
        if i < len(self.free):
            room, w = self.free.pop(i)
        else:
            if len(self.free) >= self.limit:
                closed = self.held.pop(self.free.pop(0)[1])
            room, w = self.length, self.made
            self.made += 1
            self.held[w] = []
        self.held[w].append(piece)
        if room > size:
            insort(self.free, (room - size, w))
            return closed
        full = self.held.pop(w)
        return [*closed, None, *full] if closed else full

    def rest(self) -> list[list]:
        return [self.held[w] for _, w in self.free]


def _schema(id_type: pa.DataType) -> pa.Schema:
    return pa.schema([("id", id_type), ("start", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("token_ids", pa.binary()), ("open", pa.bool_())])


class _Out:
    """Rows of windows, given out in batches. A sequence number holds level, task and a count."""

    def __init__(self, schema: pa.Schema, level: int, task: int):
        self.schema, self.base, self.count = schema, level << 58 | task << 32, 0
        self.rows: list[tuple] = []
        self.bytes = 0

    def window(self, pieces: list[tuple], open_: bool = False) -> None:
        offset = 0
        for id_, start, total, ids in pieces:
            self.rows.append((id_, start, total, self.base + self.count, offset, ids, open_))
            offset += len(ids) // 4
            self.bytes += len(ids)
        self.count += 1

    def batch(self, least: int = 0) -> Iterator[pa.RecordBatch]:
        if self.rows and self.bytes >= least:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.rows), self.schema.types)], schema=self.schema)
            self.rows, self.bytes = [], 0


def _split(window: list) -> list[list]:
    if None in window:
        i = window.index(None)
        return [window[:i], window[i + 1 :]]
    return [window]


def _pack(vocabulary: str, length: int, limit: int, end: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, last = encoder(vocabulary), np.array([end], "<u4").tobytes()
        out, windows = _Out(_schema(id_type), 0, TaskContext.get().partitionId()), Windows(length, limit)
        for whole in batches:
            for part in slices(whole, "text", SLICE_BYTES):
                texts = [t or "" for t in part.column(1).to_pylist()]
                for id_, tokens in zip(part.column(0).to_pylist(), ids.of(texts)):
                    tokens += last
                    total = len(tokens) // 4
                    for start in range(0, total, length):
                        piece = (id_, start, total, tokens[4 * start : 4 * (start + length)])
                        if closed := windows.add(len(piece[3]) // 4, piece):
                            for w in _split(closed):
                                out.window(w)
                yield from out.batch(8 << 20)
        for w in windows.rest():
            out.window(w, True)
        yield from out.batch()

    return run


def _merge(length: int, level: int, id_type: pa.DataType):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.select(["id", "start", "doc_tokens", "sequence_id", "offset", "token_ids", "open"]).sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        out = _Out(_schema(id_type), level, key[0].as_py())
        window, room = [], length
        for row in table.to_pylist():
            ids, start = row["token_ids"], row["start"]
            while ids:
                head = ids[: 4 * room]
                window.append((row["id"], start, row["doc_tokens"], head))
                ids, start, room = ids[len(head) :], start + len(head) // 4, room - len(head) // 4
                if room == 0:
                    out.window(window)
                    window, room = [], length
        if window:
            out.window(window, True)
        return pa.Table.from_batches(list(out.batch()), schema=_schema(id_type))

    return run


def pack(docs: DataFrame, vocabulary: str | None = None, text: str = "text", id: str = "doc_id", length: int = LENGTH, limit: int = OPEN, end: int = END) -> DataFrame:
    """Pieces of documents in sequences of at most ``length`` tokens: (id, start, length, doc_tokens, sequence_id, offset, token_ids).

    A document's ids are its text's and then ``end``. ``token_ids`` are little-endian unsigned 32-bit numbers.
    Each task keeps ``limit`` open windows and stores what it has placed. What stays open is then
    merged: groups of FAN_IN tasks lay their open windows end to end and cut at full length, again
    and again until one group is left, so at most one sequence of all is padded by the merge. A merge task holds at
    most FAN_IN x ``limit`` windows.

    Null and empty texts are one end token. A long text is cut into full sequences and a remainder. Repeated
    rows are packed each for itself. An empty table gives no rows; other columns are not read.
    """
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    id_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    if kind not in ("bigint", "int", "string"):
        rows, kind = rows.withColumn("id", F.col("id").cast("string")), "string"
    schema = f"id {kind}, start long, doc_tokens long, sequence_id long, offset long, token_ids binary, open boolean"
    packed = cut_lineage(rows.mapInArrow(_pack(vocabulary, length, limit, end, id_type), schema))
    done, open_, level = [packed.filter("not open")], packed.filter("open"), 0
    task = F.shiftright(F.col("sequence_id").bitwiseAND(F.lit((1 << 58) - 1)), 32)
    groups = open_.agg(F.max(task)).first()[0]
    while groups is not None:
        level, groups = level + 1, groups // FAN_IN
        merged = open_.groupBy(F.shiftright(task, FAN_IN.bit_length() - 1).alias("g")).applyInArrow(_merge(length, level, id_type), schema)
        if groups == 0:
            done.append(merged)
            break
        merged = cut_lineage(merged)
        done.append(merged.filter("not open"))
        open_ = merged.filter("open")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(F.col("id").alias(id), "start", (F.octet_length("token_ids") / 4).cast("long").alias("length"), "doc_tokens", "sequence_id", "offset", "token_ids")
