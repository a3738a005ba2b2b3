"""Queries over whole tables, one per operator, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import editprint, exactdedup, hardneg, langid, lexsearch, licenses, mixing, packing, pii, quality, sharding, simhash, warc

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
PAGES = "page_id bigint, url string, html string"
LABELS = "doc_id bigint, quality int, toxic int"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.schema(DOCUMENTS).parquet(f"{sf}/documents.parquet")


SHARDS = 8


@query("op1_sharding")
def op1_sharding(spark: SparkSession, sf: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = documents(spark, sf).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"), sharding.shard_of(SHARDS + 1, "doc_id").alias("grown_shard"),
    )
    return sharding.assign_shards(rows, ["doc_id"], SHARDS)


OP6 = """WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (t)"""


@query("op6_exact_dedup", OP6)
def op6_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exactdedup.decide(documents(spark, sf)).withColumnRenamed("digest", "text_sha256")


def water_sql(rounds: int = 24) -> str:
    """Clamping unrolled: a round more than once settled changes nothing."""
    steps = ["f0 AS (SELECT *, false AS above FROM w)"]
    for i in range(rounds):
        steps.append(f"""f{i + 1} AS (SELECT * EXCLUDE (above), weight::HUGEINT * (SELECT sum(size) * 3 - 2 * coalesce(sum(2 * size) FILTER (above), 0) FROM f{i})
  > (2 * size)::HUGEINT * 2 * (SELECT sum(weight) FILTER (NOT above) FROM f{i}) AS above FROM f{i})""")
    return ",\n".join(steps) + f""",
targets AS (SELECT source, size AS source_size, CASE WHEN above THEN (2 * size)::DOUBLE ELSE
  (SELECT sum(size) * 3 - 2 * coalesce(sum(2 * size) FILTER (above), 0) FROM f{rounds})::DOUBLE / 2.0::DOUBLE * weight::DOUBLE
  / (SELECT sum(weight) FILTER (NOT above) FROM f{rounds})::DOUBLE END AS target FROM f{rounds})"""


OP8 = f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size) AS size FROM d GROUP BY source),
w AS (SELECT source, size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
{water_sql()},
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(floor(target) / source_size) ELSE 0 END::BIGINT AS whole FROM targets),
o AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, floor(p.target)::BIGINT - p.whole * p.source_size AS rest,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('0:' || coalesce(d.doc_id::VARCHAR, '')), d.size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, (whole * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM o"""


@query("op8_mixing", OP8)
def op8_mixing(spark: SparkSession, sf: str) -> DataFrame:
    sized = cut_lineage(documents(spark, sf).select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")))
    return mixing.mix(sized, "size").select("doc_id", "size", "source_size", "target", "taken")


@query("op10_simhash")
def op10_simhash(spark: SparkSession, sf: str) -> DataFrame:
    fps = cut_lineage(documents(spark, sf).select("doc_id", simhash.fingerprint(F.col("text")).alias("fp")))
    return simhash.group_near(fps).select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


@query("op5_packing")
def op5_packing(spark: SparkSession, sf: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf))
    return pieces.select("doc_id", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op2_edit_fingerprint")
def op2_edit_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return editprint.compare_with_next(documents(spark, sf))


@query("op7_warc")
def op7_warc(spark: SparkSession, sf: str) -> DataFrame:
    pages = spark.read.schema(PAGES).parquet(f"{sf}/pages.parquet")
    folder = warc.archive_folder(spark)
    warc.archive(pages, folder)
    return warc.payload_table(warc.read_archives(spark, folder, with_data=False)).withColumnRenamed("record_id", "page_id")


#: Of this query; a deployment passes its own.
PII_KEY = b"key of the registered query"


@query("op4_pii")
def op4_pii(spark: SparkSession, sf: str) -> DataFrame:
    done = pii.pseudonymise(documents(spark, sf), PII_KEY)
    return done.select("doc_id", "text", F.size("pii_spans").cast("long").alias("n_replaced"), "pii_spans")


def remainder(n: int):
    """crc32 of the id as text, modulo n: how the contracts split learning from holding out."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


@query("op3_language")
def op3_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    net = langid.train(docs.filter(remainder(4) != 2))
    return langid.identify(docs.select("doc_id", "text"), net).select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score")


@query("op9_quality")
def op9_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = documents(spark, sf), spark.read.schema(LABELS).parquet(f"{sf}/labels.parquet")
    model = quality.train(docs, labels.filter(remainder(3) != 1))
    return quality.classify(docs.select("doc_id", "text"), model).select("doc_id", (remainder(3) == 1).alias("held_out"), "score", "predicted")


_TERMS = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11 = f"""WITH t AS (SELECT doc_id, unnest({_TERMS.format("text")}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS occ FROM d),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS.format("text")}) AS term FROM benchmark) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, c GROUP BY term),
s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // occ))))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN d USING (doc_id), c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20"""


@query("op11_lexical_search", OP11)
def op11_lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    return lexsearch.search(documents(spark, sf), spark.read.schema("item_id bigint, text string").parquet(f"{sf}/benchmark.parquet"))


@query("op12_license_scan")
def op12_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    found = licenses.scan(documents(spark, sf))
    base = F.filter("matches", lambda m: m["template"] < len(licenses.PHRASES))
    labels = lambda m: F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(m, lambda x: x["label"]))))
    starts = F.transform(base, lambda m: m["start"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0)).alias("score"),
    )


_MOVED = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"
OP13 = f"""WITH r AS (SELECT vec_id, {_MOVED} AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
  row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""


@query("op13_hard_negatives", OP13)
def op13_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.schema("vec_id bigint, embedding array<float>, label int").parquet(f"{sf}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)
