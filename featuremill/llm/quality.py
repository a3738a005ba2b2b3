"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's score comes from its own features and those of its neighbours, and
transitions tie labels of adjoining lines. Forward-backward gives each line's probability of being good; their mean, weighted by
line length, is the quality of the document, set against the labels once more by a one-dimensional logistic fit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .batches import bounded_sample, slices

#: Bounds of the sample the model is fitted on: labelled documents, and lines of one of them (longer documents are not fitted on).
SAMPLE_DOCS, SAMPLE_LINES = 4000, 500
#: Characters that are turned into features at a time; each takes about a hundred bytes meanwhile.
SLICE = 1 << 18
STEPS, RATE, RIDGE = 250, 0.1, 1e-3

# Classes of bytes: letters (and all parts of multi-byte characters), capitals, digits, blanks, then kinds of signs.
_LETTER, _CAPITAL, _DIGIT, _BLANK, _STOP, _QUOTE, _SIGN = range(7)
_CLASS = np.full(256, _SIGN, np.uint8)
_CLASS[128:] = _LETTER
for _k, _chars in ((_LETTER, b"abcdefghijklmnopqrstuvwxyz"), (_CAPITAL, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (_DIGIT, b"0123456789"), (_BLANK, b" \t\r\x0b\x0c\n"), (_STOP, b".,;:?-"), (_QUOTE, b"'\"()/")):
    _CLASS[list(_chars)] = _k
OWN = 13
_POWERS = np.cumprod(np.full(64, 1000003, np.uint64), dtype=np.uint64)


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line, its length in bytes, number of lines of each text). A text has a line more than line feeds."""
    data = [t.encode("utf-8", "replace") + b"\n" for t in texts]
    flat = np.frombuffer(b"".join(data), np.uint8)
    ends = np.flatnonzero(flat == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    doc_ends = np.cumsum([len(d) for d in data])
    lines = np.diff(np.searchsorted(ends, doc_ends - 1, "right"), prepend=0)
    kinds = _CLASS[flat]
    total = (ends - starts + 1).astype(np.float64)  # with the line feed
    count = lambda k: np.add.reduceat((kinds == k).view(np.uint8), starts, dtype=np.int64).astype(np.float64)
    letters, capitals, digits, stops, quotes, signs = (count(k) for k in (_LETTER, _CAPITAL, _DIGIT, _STOP, _QUOTE, _SIGN))
    # Words, by a hash of their bytes, against the word before and against the first word of the line.
    inside = kinds != _BLANK
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
    begin = np.flatnonzero(edge == 1)
    words = repeated = capital_words = np.zeros(len(ends))
    if len(begin):
        stop = np.flatnonzero(edge == -1)
        size = stop - begin
        place = np.arange(len(flat)) - np.repeat(np.concatenate([[0], begin]), np.diff(np.concatenate([[0], begin, [len(flat)]])))
        mixed = np.where(inside, (flat.astype(np.uint64) + np.uint64(1)) * _POWERS[place & 63], np.uint64(0))
        code = np.add.reduceat(mixed, begin) + size.astype(np.uint64)
        line = np.searchsorted(ends, begin)
        words = np.bincount(line, minlength=len(ends)).astype(np.float64)
        same = np.zeros(len(begin))
        same[1:] = (code[1:] == code[:-1]) & (line[1:] == line[:-1])
        repeated = np.bincount(line, same, minlength=len(ends))
        capital_words = np.bincount(line, (kinds[begin] == _CAPITAL).astype(np.float64), minlength=len(ends))
    # Lines that occur more than once in their text, by a hash of all their bytes.
    place = np.arange(len(flat)) - np.repeat(starts, (ends - starts + 1))
    hashed = np.add.reduceat((flat.astype(np.uint64) + np.uint64(7)) * (_POWERS[place & 63] ^ (place >> 6).astype(np.uint64)), starts)
    of = np.repeat(np.arange(len(texts)), lines)
    _, where, often = np.unique(hashed ^ (of.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), return_inverse=True, return_counts=True)
    twice = (often[where] > 1) & (total > 12)
    body = np.maximum(total - 1, 1)
    text_like = np.maximum(letters + capitals, 1)
    w = np.maximum(words, 1)
    last = flat[np.maximum(ends - 1, starts)]
    x = np.stack([
        np.log1p(total - 1) / 4, capitals / text_like, digits / body, stops / w, quotes / w, np.minimum(signs / w, 4), np.minimum(text_like / w, 30) / 8,
        repeated / w, capital_words / w, twice, np.isin(last, list(b".?!")), words == 0, np.minimum(words, 40) / 20,
    ], axis=1).astype(np.float32)
    return x, total, lines.astype(np.int64)


def with_neighbours(x: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Own features, those of the lines before and after (zero at the ends of a text), marks of first and last line, one."""
    first = np.concatenate([[0], np.cumsum(lines)[:-1]]).astype(np.int64)
    is_first, is_last = np.zeros(len(x), bool), np.zeros(len(x), bool)
    is_first[first], is_last[first + lines - 1] = True, True
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[is_first], after[is_last] = 0, 0
    return np.concatenate([x, before, after, is_first[:, None], is_last[:, None], np.ones((len(x), 1))], axis=1).astype(np.float32)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


@dataclass
class Model:
    """weights: a line's log-odds of good; moves[i, j]: score of label j after label i; scale and shift: the last logistic step."""

    weights: np.ndarray
    moves: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    scale: float = 1.0
    shift: float = 0.0

    def emissions(self, x: np.ndarray, lines: np.ndarray) -> np.ndarray:
        return with_neighbours((x - self.centre) / self.spread, lines) @ self.weights

    def quality(self, texts: list[str]) -> np.ndarray:
        x, size, lines = line_features(texts)
        good, _, _ = forward_backward(self.emissions(x, lines), lines, self.moves)
        return aggregate(good, size, lines)

    def score(self, texts: list[str]) -> np.ndarray:
        return _logistic(self.scale * _log_odds(self.quality(texts)) + self.shift)


def _log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def aggregate(good: np.ndarray, size: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Mean probability of a good line, weighted by length (with the line feed, so that empty lines count too)."""
    first = np.concatenate([[0], np.cumsum(lines)[:-1]]).astype(np.int64)
    return np.add.reduceat(good * size, first) / np.add.reduceat(size, first)


def forward_backward(odds: np.ndarray, lines: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probability of good for each line, forward and backward log-odds). Chains go forward together, longest first."""
    order = np.argsort(-lines, kind="stable")
    first = np.concatenate([[0], np.cumsum(lines)[:-1]]).astype(np.int64)[order]
    left = lines[order]
    counts = np.searchsorted(-left, -np.arange(int(left[0])), "left") if len(left) else []
    ahead, back = np.zeros(len(odds)), np.zeros(len(odds))
    ahead[first] = odds[first]
    for t in range(1, len(counts)):
        at = first[: counts[t]] + t
        a = ahead[at - 1]
        ahead[at] = odds[at] + np.logaddexp(a + moves[1, 1], moves[0, 1]) - np.logaddexp(a + moves[1, 0], moves[0, 0])
    for t in range(len(counts) - 1, 0, -1):
        at = first[: counts[t]] + t
        b = odds[at] + back[at]
        back[at - 1] = np.logaddexp(moves[1, 1] + b, moves[1, 0]) - np.logaddexp(moves[0, 1] + b, moves[0, 0])
    return _logistic(ahead + back), ahead, back


def fit(x: np.ndarray, size: np.ndarray, lines: np.ndarray, label: np.ndarray) -> Model:
    """Conditional likelihood by full-batch Adam; each line has its document's label. Labels weigh the same in sum."""
    centre, spread = x.mean(0), x.std(0) + 1e-3
    full = with_neighbours((x - centre) / spread, lines).astype(np.float64)
    model = Model(np.zeros(full.shape[1]), np.zeros((2, 2)), centre.astype(np.float32), spread.astype(np.float32))
    y = np.repeat(label, lines).astype(np.float64)
    share = label.mean()
    doc_weight = np.where(label == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9)) / np.sqrt(lines) / len(lines)
    weight = np.repeat(doc_weight, lines)
    inner = np.ones(len(y), bool)
    inner[np.concatenate([[0], np.cumsum(lines)[:-1]]).astype(np.int64)] = False
    t = np.flatnonzero(inner)
    m = v = np.zeros(full.shape[1] + 4)
    params = np.zeros(full.shape[1] + 4)
    for step in range(1, STEPS + 1):
        w, moves = params[:-4], params[-4:].reshape(2, 2)
        odds = full @ w
        good, ahead, back = forward_backward(odds, lines, moves)
        grad_w = full.T @ (weight * (y - good))
        scores = np.stack([moves[i, j] + i * ahead[t - 1] + j * (odds[t] + back[t]) for i in (0, 1) for j in (0, 1)])
        scores = np.exp(scores - scores.max(0))
        expected = (scores / scores.sum(0) * weight[t]).sum(1)
        seen = np.array([(weight[t] * (y[t - 1] == i) * (y[t] == j)).sum() for i in (0, 1) for j in (0, 1)])
        grad = np.concatenate([grad_w, seen - expected]) - RIDGE * params
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        params = params + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model.weights, model.moves = params[:-4], params[-4:].reshape(2, 2)
    good, _, _ = forward_backward(full @ model.weights, lines, model.moves)
    z = _log_odds(aggregate(good, size, lines))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps, with a little ridge towards scale one
        p = _logistic(a * z + b)
        r, h = label - p, p * (1 - p) + 1e-9
        grad = np.array([(r * z).sum() - 0.1 * (a - 1), r.sum()])
        hess = np.array([[(h * z * z).sum() + 0.1, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-3]])
        move = np.linalg.solve(hess, grad)
        a, b = a + np.clip(move[0], -0.5, 0.5), b + np.clip(move[1], -2, 2)
    model.scale, model.shift = float(a), float(b)
    return model


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for part in slices(whole, "text", SLICE):
            labels, texts = part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]
            keep = [i for i, t in enumerate(texts) if t.count("\n") < SAMPLE_LINES]
            if not keep:
                continue
            x, size, lines = line_features([texts[i] for i in keep])
            cut = np.cumsum(lines)[:-1]
            yield pa.RecordBatch.from_arrays([
                pa.array([labels[i] for i in keep], pa.int32()), pa.array([a.tobytes() for a in np.split(x, cut)], pa.binary()), pa.array([a.tobytes() for a in np.split(size, cut)], pa.binary()),
            ], ["label", "x", "size"])


def train(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", label: str = "quality") -> Model:
    """Fit on a sample of at most SAMPLE_DOCS labelled documents, chosen by the hash of the id; features are made on the executors.

    Null labels and labels without a document are left out. Without any labelled document the model scores 0.5.
    """
    sample = cut_lineage(bounded_sample(labels.filter(F.col(label).isNotNull() & F.col(id).isNotNull()).select(id, F.col(label).cast("int").alias("__label")), SAMPLE_DOCS, id))
    rows = docs.select(id, F.col(text).alias("text")).join(sample, id).select("__label", "text", id)
    found = rows.mapInArrow(_sampled, "label int, x binary, size binary").collect()
    if not found:
        return Model(np.zeros(3 * OWN + 3), np.zeros((2, 2)), np.zeros(OWN), np.ones(OWN))
    found.sort(key=lambda r: (r.label, bytes(r.x)))
    x = np.concatenate([np.frombuffer(r.x, np.float32).reshape(-1, OWN) for r in found])
    size = np.concatenate([np.frombuffer(r["size"], np.float64) for r in found])
    lines = np.array([len(r["size"]) // 8 for r in found])
    return fit(x, size, lines, np.array([r.label for r in found], np.float64))


def quality_score(text: Column, model: Model) -> Column:
    """Score of a whole text, 0 to 1, higher for better; null counts as empty."""

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        out, held, size = [], [], 0
        for t in texts:
            held.append(t or "")
            size += len(held[-1])
            if size > SLICE:
                out.append(model.score(held))
                held, size = [], 0
        if held:
            out.append(model.score(held))
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return of(text)


def line_quality(text: Column, model: Model) -> Column:
    """Probability of being good for each line of a text."""

    @F.pandas_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            x, _, lines = line_features([t or ""])
            out.append(forward_backward(model.emissions(x, lines), lines, model.moves)[0])
        return pd.Series(out, dtype=object)

    return of(text)


def classify(docs: DataFrame, model: Model, text: str = "text", score: str = "score", predicted: str = "predicted") -> DataFrame:
    """Documents with their score and 1 where it is at least one half, else 0.

    A row depends on its text alone: nothing is shuffled. Null and empty texts are one empty line; other columns pass through; an
    empty table stays empty. Columns named like the new ones are replaced.
    """
    return docs.withColumn(score, quality_score(F.col(text), model)).withColumn(predicted, (F.col(score) >= 0.5).cast("int"))
