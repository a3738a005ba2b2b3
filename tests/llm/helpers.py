"""Plain-Python versions of what the operators compute, and tables with awkward rows."""

from collections import defaultdict

import pyarrow.parquet as pq

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def column_rows(sf, table, *names):
    t = pq.read_table(f"{sf}/{table}.parquet", columns=list(names))
    return list(zip(*[t.column(n).to_pylist() for n in names]))


def awkward(spark, extra=True):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns whose names clash with common inner ones."""
    long = "word and another one\n" * 6000
    rows = [
        (1, "alpha beta gamma delta", "en", "a", 22), (2, "Alpha BETA gamma delta", "en", "a", 22), (2, "Alpha BETA gamma delta", "en", "a", 22),
        (3, None, None, None, None), (4, "", "en", None, 0), (5, " \t\n", None, "b", 3), (6, long, "en", "b", len(long)),
        (7, long + "x", None, "b", len(long) + 1), (8, "été ÉTÉ İı ß \U0001f600", "fr", "c", 15), (9, "\x1c   x", "de", "c", 5), (None, "orphan text here", "en", "a", 16),
        (10, "one", "en", "a", 3), (11, "<|endoftext|> is plain", "en", "a", 22),
    ]
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        from pyspark.sql import functions as F

        for c in ("key", "size", "fp", "id", "u", "v", "range", "ahead", "n", "digest", "content", "cell", "label", "open", "start", "kept", "component_id", "target", "taken", "source_size", "shard", "slot", "fingerprint",
                  "number", "row", "salt", "salts", "keep_id", "group_size", "score", "rank", "matches", "n_words", "sequence_id", "offset", "length", "token_ids", "near_next", "grown_shard"):
            df = df.withColumn(c, F.lit(c))
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)


class Union:
    """Union-find whose root is the smallest member."""

    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def groups(pairs):
    out = defaultdict(list)
    for k, v in pairs:
        out[k].append(v)
    return out
