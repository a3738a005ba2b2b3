"""Queries on abundance tables: the feature is a part, its structure text is assembled from its attributes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import composition as K
from ..operators.reshape import to_wide
from ..session import cut_lineage
from .base import CONTROL, PART_COUNTS, TREATED, bh_sql, design, part_counts, query, r, rs, t_p_sql, table

# The fragments that part attributes stand for.
TIPS = {
    "ECONOMY": ["Fuc(a1-2)", "Gal(b1-3)"],
    "LARGE": ["Gal(b1-3)"],
    "MEDIUM": ["Neu5Ac(a2-3)", "Gal(b1-3)"],
    "PROMO": ["Fuc(a1-2)", "Gal(b1-4)", "GlcNAc(b1-3)"],
    "SMALL": ["GalNAc(a1-3)"],
    "STANDARD": ["GlcNAc(b1-3)"],
}
BRANCHES = [[], ["Neu5Ac(a2-6)"], ["Gal(b1-4)", "GlcNAc(b1-6)"], ["Fuc(a1-2)", "Gal(b1-4)", "GlcNAc(b1-6)"]]
RESIDUES = {"hex": "Gal\\(", "hexnac": "(GlcNAc|GalNAc)", "fucose": "Fuc", "neu5ac": "Neu5Ac"}
CARRIER = r"Terminal_Neu5Ac\(a2-.\)Gal"


def structures(spark, sf):
    """(feature, structure): main chain, optional side branch, and a core whose linkage is the brand number."""
    tip = F.create_map(*[F.lit(x) for k, v in TIPS.items() for x in (k, "".join(v))])[F.col("p_type")]
    branch = F.element_at(F.array(*[F.lit("[" + "".join(b) + "]" if b else "") for b in BRANCHES]), F.col("p_size") % 4 + 1)
    core = F.concat(F.lit("Gal(b1-"), F.substring("p_brand", 7, 3), F.lit(")GalNAc"))
    text = F.concat(tip, branch, F.when(F.col("p_size") > 25, core).otherwise("GalNAc"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("feature"), text.alias("structure"), "p_type", "p_size")


def _case(mapping: dict, col: str) -> str:
    return f"CASE {col} " + " ".join(f"WHEN {k} THEN {v}" for k, v in mapping.items()) + " END"


_TIP_LIST = _case({f"'{k}'": str(v) for k, v in TIPS.items()}, "p_type")
_BRANCH_LIST = _case({i: str(v) + "::VARCHAR[]" for i, v in enumerate(BRANCHES)}, "p_size % 4")
STRUCTURES = f"""chains AS (SELECT p_partkey AS feature, p_type, p_size, {_TIP_LIST} AS tip, {_BRANCH_LIST} AS branch,
  CASE WHEN p_size > 25 THEN ['Gal(b1-' || substr(p_brand, 7) || ')', 'GalNAc'] ELSE ['GalNAc'] END AS core FROM part),
structures AS (SELECT *, array_to_string(tip, '') || CASE WHEN len(branch) > 0 THEN '[' || array_to_string(branch, '') || ']' ELSE '' END
  || array_to_string(core, '') AS structure FROM chains)"""
MOTIFS = f"""{STRUCTURES}, kinds AS (SELECT DISTINCT structure, tip, branch, core FROM structures),
paths AS (SELECT structure, tip || core AS path FROM kinds UNION ALL SELECT structure, branch || core FROM kinds WHERE len(branch) > 0),
motifs AS (SELECT structure, 'Terminal_' || array_to_string(path[1:s], '') AS motif, count(*) AS n
  FROM paths, (SELECT unnest([1, 2, 3]) AS s) WHERE len(path) >= s GROUP BY 1, 2)"""


def shares(spark, sf):
    """(feature, sample, value, share)."""
    return K.relative_abundance(part_counts(spark, sf).withColumnRenamed("count", "value"))


SHARES = f"{PART_COUNTS}, shares AS (SELECT feature, sample, count AS value, count * 100.0 / sum(count) OVER (PARTITION BY sample) AS share FROM part_counts)"


# Reading and cleaning --------------------------------------------------------------------------

@query("parse_encoded", """SELECT user_id, 'file-' || event_type AS file, event_type AS sample,
  CASE WHEN event_type IN ('error', 'signup') THEN 'g2' ELSE 'g1' END AS grp, round(sum(value), 2) AS total, count(*)::DOUBLE AS events FROM events GROUP BY 1, 2, 3, 4""")
def parse_encoded(spark, sf):
    events, aggs = table(spark, sf, "events"), []
    # A wide table has a column for each type, so their names are needed before it is read.
    for kind in sorted(x["event_type"] for x in events.select("event_type").distinct().collect()):
        here, group = F.col("event_type") == kind, "g2" if kind in ("error", "signup") else "g1"
        aggs.append(F.round(F.sum(F.when(here, F.col("value"))), 2).alias(f"file-{kind}_{kind}_{group}_Total"))
        aggs.append(F.nullif(F.count_if(here), F.lit(0)).cast("double").alias(f"file-{kind}_{kind}_{group}_Events"))
    wide = events.groupBy("user_id").agg(*aggs)
    out = K.parse_encoded_columns(
        wide, ["user_id"], ["file", "sample", "grp", "variable"], {"Total": "total", "Events": "events"}, prefix="file-"
    )
    return out.filter(F.col("events").isNotNull())


@query("clean_measurements", """SELECT lpad(event_id::VARCHAR, greatest(3, length(event_id::VARCHAR))::INTEGER, '0') AS event_id, event_type,
  CASE WHEN event_type = 'error' THEN 0.0 ELSE value END AS value, CASE WHEN event_type = 'view' THEN 'starred' END AS comment FROM events""")
def clean_measurements(spark, sf):
    text = F.col("value").cast("string")
    raw = (
        F.when(F.col("event_type") == "error", "ND")
        .when(F.col("event_type") == "signup", F.translate(text, ".", ","))
        .when(F.col("event_type") == "view", F.concat(text, F.lit("*")))
        .otherwise(text)
    )
    events = table(spark, sf, "events").select("event_id", "event_type", raw.alias("value"))
    return K.clean_measurements(events, ["value"], "value", "starred", "event_id")


@query("canonical_structure", f"WITH {STRUCTURES} SELECT feature, structure FROM structures")
def canonical_structure(spark, sf):
    spelled = F.regexp_replace(F.translate(F.col("structure"), "ab[]-", "αβ{}–"), r"\)", ") ")
    # Residue names keep their Latin letters; only linkages were spelled with Greek ones.
    spelled = F.regexp_replace(spelled, "Gαl", "Gal")
    return structures(spark, sf).select("feature", K.canonical_structure(spelled).alias("structure"))


# Shares and profiles ---------------------------------------------------------------------------


@query("relative_abundance", f"WITH {SHARES} SELECT feature, sample, {rs('share', 8)} AS share FROM shares")
def relative_abundance(spark, sf):
    return shares(spark, sf).select("feature", "sample", r("share", 8).alias("share"))


@query("check_supplied", f"WITH {SHARES} SELECT count(*) AS rows, count(*) FILTER (WHERE value >= 100) AS different FROM shares")
def check_supplied(spark, sf):
    supplied = F.when(F.col("value") >= 100, F.col("share") + 0.001).otherwise(F.col("share"))
    return K.check_supplied(shares(spark, sf).withColumn("supplied", supplied), "share", "supplied", 9)


@query("feature_stats", f"""WITH {SHARES}, grid AS (SELECT f.feature, coalesce(share, 0.0) AS share FROM (SELECT DISTINCT feature FROM shares) f CROSS JOIN design d
  LEFT JOIN shares s ON s.feature = f.feature AND s.sample = d.sample)
SELECT feature, {rs('avg(share)', 8)} AS mean, {rs('stddev_samp(share)', 8)} AS sd, {rs('median(share)', 8)} AS median, {rs('mad(share) * 1.4826', 8)} AS mad FROM grid GROUP BY 1""")
def feature_stats(spark, sf):
    return K.feature_stats(shares(spark, sf), design(spark, sf)).select("feature", *[r(c, 8).alias(c) for c in ("mean", "sd", "median", "mad")])


def sized(spark, sf):
    counts = {n: F.regexp_count("structure", F.lit(p)) for n, p in RESIDUES.items()}
    return K.feature_size(structures(spark, sf).withColumns(counts), list(RESIDUES)).select("feature", "size", *RESIDUES)


_COUNTS = ", ".join(f"len(regexp_extract_all(structure, '{p}')) AS {n}" for n, p in RESIDUES.items())
SIZED = f"{SHARES}, {STRUCTURES}, sized AS (SELECT *, {' + '.join(RESIDUES)} AS size FROM (SELECT feature, {_COUNTS} FROM structures))"


@query("size_profile", f"WITH {SIZED} SELECT size, sample, {rs('sum(share)', 7)} AS abundance FROM shares JOIN sized USING (feature) GROUP BY 1, 2")
def size_profile(spark, sf):
    out = K.size_profile(shares(spark, sf).join(sized(spark, sf), "feature"))
    return out.select(F.col("size").cast("long").alias("size"), "sample", r("abundance", 7).alias("abundance"))


@query("moiety_composition", f"WITH {SIZED} " + " UNION ALL ".join(
    f"SELECT sample, '{n}' AS moiety, {rs(f'sum(share * {n} / size)', 7)} AS abundance FROM shares JOIN sized USING (feature) GROUP BY 1" for n in RESIDUES))
def moiety_composition(spark, sf):
    out = K.moiety_composition(shares(spark, sf).join(sized(spark, sf), "feature"), list(RESIDUES))
    return out.select("sample", "moiety", r("abundance", 7).alias("abundance"))


@query("moiety_summary", f"WITH {SIZED}, prof AS (" + " UNION ALL ".join(
    f"SELECT sample, '{n}' AS moiety, sum(share * {n} / size) AS abundance FROM shares JOIN sized USING (feature) GROUP BY 1" for n in RESIDUES)
    + f") SELECT moiety, {rs('avg(abundance)', 7)} AS mean, {rs('stddev_samp(abundance)', 7)} AS sd FROM prof GROUP BY 1")
def moiety_summary(spark, sf):
    out = K.moiety_summary(K.moiety_composition(shares(spark, sf).join(sized(spark, sf), "feature"), list(RESIDUES)))
    return out.select("moiety", r("mean", 7).alias("mean"), r("sd", 7).alias("sd"))


@query("share_by_predicate", f"""WITH {SIZED} SELECT fucose > 0 AS fucosylated, {rs('sum(share) * 100.0 / (SELECT sum(share) FROM shares)', 7)} AS percent
FROM shares JOIN sized USING (feature) GROUP BY 1""")
def share_by_predicate(spark, sf):
    joined = shares(spark, sf).join(sized(spark, sf), "feature")
    out = K.share_by_predicate(joined, F.col("fucose") > 0, name="fucosylated")
    return out.select("fucosylated", r("percent", 7).alias("percent"))


@query("duplicate_structures", f"WITH {STRUCTURES} SELECT structure, count(*) AS ids FROM structures GROUP BY 1 HAVING count(*) > 1")
def duplicate_structures(spark, sf):
    return K.duplicate_structures(structures(spark, sf), "feature", "structure")


NATIONS = [f"NATION_{i}" for i in range(25)]
BRANDS = [f"Brand#{i}" for i in range(1, 26)]
BRAND_SHARES = f"{SHARES}, bs AS (SELECT p_brand AS feature, sample, sum(share) AS share FROM shares JOIN part ON feature = p_partkey GROUP BY 1, 2)"


def brand_shares(spark, sf):
    brands = table(spark, sf, "part").select(F.col("p_partkey").alias("feature"), "p_brand")
    return shares(spark, sf).join(brands, "feature").groupBy(F.col("p_brand").alias("feature"), "sample").agg(F.sum("share").alias("share"))


@query("wide_by_sample", f"WITH {BRAND_SHARES} SELECT feature, " + ", ".join(
    f"{rs(f'coalesce(max(CASE WHEN sample = {chr(39)}{n}{chr(39)} THEN share END), 0.0)', 6)} AS {n}" for n in NATIONS) + " FROM bs GROUP BY 1")
def wide_by_sample(spark, sf):
    return K.wide_by_sample(brand_shares(spark, sf), NATIONS).select("feature", *[r(n, 6).alias(n) for n in NATIONS])


@query("wide_by_feature", f"WITH {BRAND_SHARES} SELECT sample, " + ", ".join(
    f"{rs(f'coalesce(max(CASE WHEN feature = {chr(39)}{b}{chr(39)} THEN share END), 0.0)', 6)} AS \"{b}\"" for b in BRANDS) + " FROM bs GROUP BY 1")
def wide_by_feature(spark, sf):
    return K.wide_by_feature(brand_shares(spark, sf), BRANDS).select("sample", *[r(F.col(f"`{b}`"), 6).alias(b) for b in BRANDS])


# Motifs ----------------------------------------------------------------------------------------


@query("terminal_motifs", f"WITH {MOTIFS} SELECT structure, motif, n FROM motifs")
def terminal_motifs(spark, sf):
    return K.terminal_motifs(structures(spark, sf))


def structure_shares(spark, sf):
    return shares(spark, sf).join(structures(spark, sf).select("feature", "structure"), "feature")


def motif_shares(spark, sf):
    return K.motif_abundance(K.terminal_motifs(structures(spark, sf)), structure_shares(spark, sf))


MOTIF_SHARES = f"""{SHARES}, {MOTIFS}, ms AS (SELECT motif, sample, sum(n * share) AS abundance
  FROM shares JOIN structures USING (feature) JOIN motifs USING (structure) GROUP BY 1, 2)"""


@query("motif_abundance", f"WITH {MOTIF_SHARES} SELECT motif, sample, {rs('abundance', 7)} AS abundance FROM ms")
def motif_abundance(spark, sf):
    return motif_shares(spark, sf).select("motif", "sample", r("abundance", 7).alias("abundance"))


@query("rarity_filter", f"""WITH {MOTIF_SHARES}, kept AS (SELECT motif FROM ms WHERE abundance > 0 GROUP BY 1 HAVING count(*) >= 0.8 * (SELECT count(*) FROM design))
SELECT motif, sample, {rs('abundance', 7)} AS abundance FROM ms WHERE motif IN (SELECT motif FROM kept)""")
def rarity_filter(spark, sf):
    out = K.rarity_filter(motif_shares(spark, sf), design(spark, sf), "motif", "abundance", 0.8)
    return out.select("motif", "sample", r("abundance", 7).alias("abundance"))


DIFFERENTIAL = f"""{MOTIF_SHARES}, kept AS (SELECT motif FROM ms WHERE abundance > 0 GROUP BY 1 HAVING count(*) >= 0.1 * (SELECT count(*) FROM design)),
grid AS (SELECT k.motif, d.condition, coalesce(log2((abundance + 0.001) / 0.001), 0.0) AS x FROM kept k CROSS JOIN design d LEFT JOIN ms ON ms.motif = k.motif AND ms.sample = d.sample),
st AS (SELECT motif, count(*) FILTER (WHERE condition = 'control') AS n1, count(*) FILTER (WHERE condition = 'treated') AS n2,
  avg(x) FILTER (WHERE condition = 'control') AS m1, avg(x) FILTER (WHERE condition = 'treated') AS m2,
  var_samp(x) FILTER (WHERE condition = 'control') AS v1, var_samp(x) FILTER (WHERE condition = 'treated') AS v2 FROM grid GROUP BY 1),
tt AS (SELECT motif, n1, n2, (m2 - m1) / sqrt(v1 / n1 + v2 / n2) AS t, (v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)) AS dof,
  (m2 - m1) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS effect FROM st),
tp AS (SELECT *, {t_p_sql('t', 'dof')} AS p FROM tt)"""


@query("differential_abundance", f"""WITH {DIFFERENTIAL} SELECT motif, n1, n2, {rs('t', 6)} AS t, {rs('dof', 5)} AS dof, {rs('effect', 6)} AS effect,
  {rs('p', 7)} AS p, {rs('padj', 7)} AS padj FROM ({bh_sql('tp', 'p')})""")
def differential_abundance(spark, sf):
    out = K.differential_abundance(motif_shares(spark, sf), design(spark, sf), "motif", "abundance", CONTROL, TREATED)
    return out.select("motif", "n1", "n2", r("t").alias("t"), r("dof", 5).alias("dof"), r("effect").alias("effect"), r("p", 7).alias("p"), r("padj", 7).alias("padj"))


COHORT = "CASE WHEN sample < 'NATION_2' THEN 'early' ELSE 'late' END"
# The same test with the samples split another way: the design alone changes.
BY_COHORT = DIFFERENTIAL.replace("grid AS (SELECT", f"cohorts AS (SELECT sample, {COHORT} AS cohort FROM design),\ngrid AS (SELECT").replace("d.condition, coalesce", "d.cohort AS condition, coalesce").replace("CROSS JOIN design d", "CROSS JOIN cohorts d")


@query("differential_by_cohort", f"""WITH {BY_COHORT.replace("FILTER (WHERE condition = 'control')", "FILTER (WHERE condition = 'early')").replace("FILTER (WHERE condition = 'treated')", "FILTER (WHERE condition = 'late')")}
SELECT motif, n1, n2, {rs('t', 6)} AS t, {rs('dof', 5)} AS dof, {rs('effect', 6)} AS effect, {rs('p', 7)} AS p, {rs('padj', 7)} AS padj FROM ({bh_sql('tp', 'p')})""")
def differential_by_cohort(spark, sf):
    cohort = F.when(F.col("sample") < "NATION_2", "early").otherwise("late")
    split = design(spark, sf).select("sample", cohort.alias("cohort"))
    out = K.differential_abundance(motif_shares(spark, sf), split, "motif", "abundance", "early", "late", group="cohort")
    return out.select("motif", "n1", "n2", r("t").alias("t"), r("dof", 5).alias("dof"), r("effect").alias("effect"), r("p", 7).alias("p"), r("padj", 7).alias("padj"))


@query("group_members", f"WITH {PART_COUNTS} SELECT sample FROM design WHERE condition = 'control'")
def group_members(spark, sf):
    return K.group_members(design(spark, sf), CONTROL)


@query("top_motifs", f"""WITH {MOTIF_SHARES}, m AS (SELECT motif, sum(abundance) / (SELECT count(*) FROM design) AS mean FROM ms GROUP BY 1)
SELECT motif, {rs('mean', 7)} AS mean FROM m QUALIFY rank() OVER (ORDER BY mean DESC) <= 10""")
def top_motifs(spark, sf):
    return K.top_motifs(motif_shares(spark, sf), design(spark, sf)).select("motif", r("mean", 7).alias("mean"))


def feature_means(spark, sf):
    """(feature, structure, mean) with absent cells as zero."""
    n = design(spark, sf).agg(F.count(F.lit(1)).alias("n")).scalar()
    return structure_shares(spark, sf).groupBy("feature", "structure").agg((F.sum("share") / n).alias("mean"))


MEANS = f"{SHARES}, fm AS (SELECT feature, sum(share) / (SELECT count(*) FROM design) AS mean FROM shares GROUP BY 1)"


@query("top_vs_rest", f"""WITH {MEANS}, k AS (SELECT mean, rank() OVER (ORDER BY mean DESC) <= 10 AS top FROM fm)
SELECT {rs('sum(mean) FILTER (WHERE top)', 7)} AS top_sum, {rs('sum(mean) FILTER (WHERE NOT top)', 7)} AS rest_sum, {rs('max(mean) FILTER (WHERE NOT top)', 7)} AS rest_max FROM k""")
def top_vs_rest(spark, sf):
    return K.top_vs_rest(feature_means(spark, sf)).select(*[r(c, 7).alias(c) for c in ("top_sum", "rest_sum", "rest_max")])


@query("motif_carriers", f"""WITH {MEANS}, {MOTIFS}, c AS (SELECT DISTINCT structure FROM motifs WHERE regexp_matches(motif, '{CARRIER}')),
f AS (SELECT mean, structure IN (SELECT structure FROM c) AS has FROM fm JOIN structures USING (feature))
SELECT {rs('sum(mean) FILTER (WHERE has)', 7)} AS carrier_sum, count(*) FILTER (WHERE has) AS carriers, {rs('sum(mean) FILTER (WHERE NOT has)', 7)} AS other_sum FROM f""")
def motif_carriers(spark, sf):
    out = K.motif_carriers(K.terminal_motifs(structures(spark, sf)), feature_means(spark, sf), CARRIER)
    return out.select(r("carrier_sum", 7).alias("carrier_sum"), "carriers", r("other_sum", 7).alias("other_sum"))


KEPT = ["Brand#3", "Brand#7", "Brand#12", "Brand#20"]


@query("annotated_ranking", f"""WITH {BRAND_SHARES} SELECT feature, {rs("coalesce(sum(CASE WHEN condition = 'control' THEN share END), 0.0) / (SELECT count(*) FROM design WHERE condition = 'control')", 7)} AS control_mean, """
       + ", ".join(f"{rs(f'coalesce(max(CASE WHEN sample = {chr(39)}{n}{chr(39)} THEN share END), 0.0)', 7)} AS {n}" for n in NATIONS)
       + f" FROM bs JOIN design USING (sample) WHERE feature IN ({', '.join(repr(b) for b in KEPT)}) GROUP BY 1")
def annotated_ranking(spark, sf):
    kept = spark.createDataFrame([(b,) for b in KEPT], "feature string")
    values = cut_lineage(brand_shares(spark, sf).join(design(spark, sf), "sample"))
    out = K.annotated_ranking(kept, values, design(spark, sf), CONTROL, NATIONS, "share")
    return out.select("feature", r("control_mean", 7).alias("control_mean"), *[r(n, 7).alias(n) for n in NATIONS])


@query("term_member_table", f"""WITH {SHARES} SELECT feature, """ + ", ".join(
    f"{rs(f'coalesce(max(CASE WHEN sample = {chr(39)}{n}{chr(39)} THEN share END), 0.0)', 7)} AS {n}" for n in NATIONS)
    + " FROM shares WHERE feature IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO') GROUP BY 1")
def term_member_table(spark, sf):
    annotation = table(spark, sf, "part").select(F.col("p_partkey").alias("gene"), F.col("p_type").alias("term"))
    members = K.term_member_table(annotation, shares(spark, sf), "PROMO")
    return to_wide(members, ["feature"], "sample", "share", NATIONS, fill=0.0).select("feature", *[r(n, 7).alias(n) for n in NATIONS])
