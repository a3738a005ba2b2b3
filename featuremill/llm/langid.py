"""Language identification by a convolutional network over bytes, trained in numpy and applied to all windows of a text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .batches import hash_fraction

#: Bytes of a window, size of a byte's embedding, widths of the filters, filters of each width.
WINDOW, EMBED, WIDTHS, FILTERS = 256, 8, (2, 3, 4), 8
#: Bounds of the sample the network is fitted on: documents of a language, windows of a document.
SAMPLE_DOCS, SAMPLE_WINDOWS = 400, 3
EPOCHS, BATCH, RATE, SEED = 6, 64, 0.004, 11
UNKNOWN = "und"


def windows_of(text: str) -> np.ndarray:
    """All windows of a lower-cased text's UTF-8 bytes, one after the other; the last is filled up with zeros."""
    data = text.lower().encode("utf-8", "replace")
    n = max(1, -(-len(data) // WINDOW))
    return np.frombuffer(data.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


@dataclass
class Network:
    """Embedding of bytes, one bank of filters per width, max pooling over the window, rectifier, softmax."""

    languages: list[str]
    params: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def new(cls, languages: list[str]) -> Network:
        rng = np.random.default_rng(SEED)
        p = {"embed": rng.normal(0, 0.5, (256, EMBED))}
        p["embed"][0] = 0
        for w in WIDTHS:
            p[f"filter{w}"] = rng.normal(0, 1 / np.sqrt(w * EMBED), (w * EMBED, FILTERS))
            p[f"bias{w}"] = np.zeros(FILTERS)
        p["out"], p["out_bias"] = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))), np.zeros(len(languages))
        return cls(languages, {k: v.astype(np.float32) for k, v in p.items()})

    def step(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the weighted log-loss on one batch. Pooling passes it to one place for each window and filter."""
        p, n = self.params, len(x)
        e = p["embed"][x]
        pooled, places, patches = [], [], []
        for w in WIDTHS:
            view = np.lib.stride_tricks.sliding_window_view(e, w, axis=1).transpose(0, 1, 3, 2).reshape(n, WINDOW - w + 1, w * EMBED)
            a = view @ p[f"filter{w}"] + p[f"bias{w}"]
            at = a.argmax(1)
            pooled.append(np.take_along_axis(a, at[:, None], 1)[:, 0])
            places.append(at)
            patches.append(view[np.arange(n)[:, None], at])
        h = np.concatenate(pooled, 1)
        r = np.maximum(h, 0)
        z = r @ p["out"] + p["out_bias"]
        z = np.exp(z - z.max(1, keepdims=True))
        d = (z / z.sum(1, keepdims=True) - np.eye(len(self.languages), dtype=np.float32)[y]) * weight[:, None] / n
        g = {"out": r.T @ d, "out_bias": d.sum(0), "embed": np.zeros_like(p["embed"])}
        dh = (d @ p["out"].T) * (h > 0)
        for k, w in enumerate(WIDTHS):
            dk = dh[:, k * FILTERS : (k + 1) * FILTERS]
            g[f"bias{w}"] = dk.sum(0)
            g[f"filter{w}"] = np.einsum("nfd,nf->df", patches[k], dk)
            de = (dk[:, :, None] * p[f"filter{w}"].T[None]).reshape(n, FILTERS, w, EMBED)
            byte = x[np.arange(n)[:, None, None], places[k][:, :, None] + np.arange(w)]
            np.add.at(g["embed"], byte.reshape(-1), de.reshape(-1, EMBED))
        g["embed"][0] = 0
        return g

    def tables(self) -> dict[int, list[np.ndarray]]:
        """Filter responses looked up by byte pairs (and by a last single byte): what embedding and filter give together."""
        p, out = self.params, {}
        for w in WIDTHS:
            single = [p["embed"] @ p[f"filter{w}"][o * EMBED : (o + 1) * EMBED] for o in range(w)]
            pairs = [(single[o][:, None] + single[o + 1][None]).reshape(1 << 16, FILTERS) for o in range(0, w - 1, 2)]
            out[w] = pairs + ([single[-1]] if w % 2 else [])
        return out

    def probabilities(self, x: np.ndarray, tables: dict[int, list[np.ndarray]]) -> np.ndarray:
        """Softmax of each window. The convolution is a sum of table rows, the same as :meth:`step` computes."""
        p, out = self.params, []
        for s in range(0, len(x), 128):
            b = x[s : s + 128]
            pair = b[:, :-1].astype(np.int32) << 8 | b[:, 1:]
            pooled = []
            for w in WIDTHS:
                m, a = WINDOW - w + 1, None
                for k, t in enumerate(tables[w]):
                    got = t.take(pair[:, 2 * k : 2 * k + m] if len(t) > 256 else b[:, 2 * k : 2 * k + m], axis=0)
                    a = got if a is None else np.add(a, got, out=a)
                pooled.append(a.max(1) + p[f"bias{w}"])
            z = np.maximum(np.concatenate(pooled, 1), 0) @ p["out"] + p["out_bias"]
            z = np.exp(z - z.max(1, keepdims=True))
            out.append(z / z.sum(1, keepdims=True))
        return np.concatenate(out)


def fit(windows: np.ndarray, labels: np.ndarray, languages: list[str]) -> Network:
    """Adam on shuffled batches; languages weigh the same in sum, rare ones at most ten times the mean."""
    net, rng = Network.new(languages), np.random.default_rng(SEED)
    share = np.bincount(labels, minlength=len(languages)) / len(labels)
    weight = np.minimum(1 / np.maximum(share * len(languages), 1e-9), 10).astype(np.float32)[labels]
    m = {k: np.zeros_like(v) for k, v in net.params.items()}
    v = {k: np.zeros_like(x) for k, x in net.params.items()}
    turn = 0
    for _ in range(EPOCHS):
        for at in np.array_split(rng.permutation(len(windows)), max(1, len(windows) // BATCH)):
            turn += 1
            for k, g in net.step(windows[at], labels[at], weight[at]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                net.params[k] -= (RATE * (m[k] / (1 - 0.9**turn)) / (np.sqrt(v[k] / (1 - 0.999**turn)) + 1e-8)).astype(np.float32)
    return net


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Up to SAMPLE_WINDOWS windows of each text, evenly spread."""
    for batch in batches:
        out = []
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            w = windows_of(text)
            for i in np.unique(np.linspace(0, len(w) - 1, SAMPLE_WINDOWS).astype(int)):
                out.append((lang, w[i].tobytes()))
        if out:
            langs, data = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(data, pa.binary())], ["lang", "bytes"])


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", id: str = "doc_id") -> Network | None:
    """Fit on at most SAMPLE_DOCS labelled texts of each language, chosen by the hash of the id; windows are cut on the executors.

    Rows without a language or a letter teach nothing. None when nothing is left.
    """
    known = docs.filter(F.col(lang).isNotNull())
    rows = known.filter(has_letter(F.col(text)))
    counts = known.groupBy(F.col(lang).alias("__lang")).agg(F.count(F.lit(1)).alias("__n"))
    share = hash_fraction(F.lit("language"), id)
    few = rows.select(F.col(lang).alias("__lang"), F.col(text).alias("__text"), share.alias("__share"), F.col(id).alias("__id")).join(cut_lineage(counts), "__lang")
    few = few.filter(F.col("__share") * F.col("__n") < 1.3 * SAMPLE_DOCS + 20)
    # Only a bounded number of rows of a language comes this far.
    ranked = few.withColumn("__r", F.row_number().over(Window.partitionBy("__lang").orderBy("__share", "__id", "__text"))).filter(F.col("__r") <= SAMPLE_DOCS)
    found = ranked.select("__lang", "__text").mapInArrow(_cut, "lang string, bytes binary").collect()
    if not found:
        return None
    found = sorted((r.lang, bytes(r.bytes)) for r in found)
    languages = sorted({lang for lang, _ in found})
    windows = np.frombuffer(b"".join(b for _, b in found), np.uint8).reshape(-1, WINDOW)
    return fit(windows, np.array([languages.index(lang) for lang, _ in found]), languages)


def predictor(net: Network):
    """Mean softmax over all windows of each text, as (language numbers, probabilities)."""
    tables = net.tables()

    def predict(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cut = [windows_of(t) for t in texts]
        first = np.concatenate([[0], np.cumsum([len(w) for w in cut])[:-1]]).astype(np.int64)
        all_ = net.probabilities(np.concatenate(cut), tables)
        mean = np.add.reduceat(all_, first) / np.array([len(w) for w in cut])[:, None]
        return mean.argmax(1), mean.max(1)

    return predict


def language(text: Column, net: Network | None) -> Column:
    """Struct (lang, score) from the whole text; ``und`` with score 0 for texts that are null or have no letter, or without a network."""
    if net is None:
        return F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
    made = []

    @F.pandas_udf("lang string, score double")
    def of(texts: pd.Series) -> pd.DataFrame:
        if not made:
            made.append(predictor(net))
        langs, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        held, size = [], 0
        known = [i for i, t in enumerate(texts) if t is not None]
        for k, i in enumerate(known):
            held.append(i)
            size += len(texts.iloc[i])
            if size > 2 << 20 or k == len(known) - 1:
                best, p = made[0]([texts.iloc[j] for j in held])
                langs[held], scores[held] = np.array(net.languages, object)[best], p
                held, size = [], 0
        return pd.DataFrame({"lang": langs, "score": scores})

    return of(F.when(has_letter(text), text))


def identify(docs: DataFrame, net: Network | None, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """Documents with predicted language and its probability.

    A row depends on its text alone: nothing is shuffled. Other columns pass through, an empty table stays empty; columns named like the new ones
    are replaced.
    """
    done = docs.withColumn("__lang", language(F.col(text), net))
    return done.withColumn(lang, F.col("__lang.lang")).withColumn(score, F.col("__lang.score").cast("double")).drop("__lang")
