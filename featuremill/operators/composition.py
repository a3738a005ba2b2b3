"""Compositional abundance tables: encoded headers, clean-up, shares, sizes, motifs, top-against-rest."""

from __future__ import annotations

import re
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import equal_to_digits, to_double
from ..functions.text import pad_left, remove_all, replace_first
from ..session import cut_lineage
from .aggregate import repeated_keys, with_group_stats
from .inference import welch_stats_sparse, with_t_p
from .joins import keep_in, keep_not_in
from .ordered import top_and_rest, top_with_ties
from .reshape import split_column, to_long, to_wide

cloudpickle.register_pickle_by_value(sys.modules[__name__])


# Reading encoded tables ----------------------------------------------------------------------


def parse_encoded_columns(
    wide: DataFrame, ids: list[str], into: list[str], variables: dict[str, str], prefix: str, sep: str = "_"
) -> DataFrame:
    """Columns named ``part_part_..._variable`` to one row per (ids, parts) with a column per variable.

    ``into`` names the parts, the last of which is the variable; ``variables`` maps its values to
    output names. Unpivot, split and re-pivot in one pass.
    """
    encoded = [c for c in wide.columns if c.startswith(prefix)]
    long = to_long(wide, ids, encoded, "__name", "__value")
    parts = split_column(long, "__name", sep, into)
    keys = [*ids, *into[:-1]]
    return to_wide(parts, keys, into[-1], "__value", list(variables), name=lambda v: variables[v])


def header_census(names: DataFrame, parts: list[str]) -> DataFrame:
    """Count of counts over encoded names: every sample should occur once per variable."""
    from .aggregate import count_of_counts

    return count_of_counts(names, *parts)


def clean_number(col: Column, absent: tuple[str, ...] = ("ND", "NA")) -> Column:
    """Text measurement to number: absent marks to 0, decimal comma to point, a trailing * dropped."""
    text = remove_all(col, r"\*")
    for mark in absent:
        text = replace_first(text, mark, "0")
    return to_double(replace_first(text, ",", "."))


def clean_measurements(df: DataFrame, columns: list[str], flagged: str, comment: str, id_col: str, width: int = 3) -> DataFrame:
    """Clean every measurement column, note starred values of one column, and pad the id."""
    note = F.when(F.col(flagged).contains("*"), F.lit(comment)).alias("comment")
    rest = [c for c in df.columns if c not in (id_col, *columns)]
    return df.select(
        pad_left(F.col(id_col).cast("string"), width).alias(id_col), *rest, *[clean_number(F.col(c)).alias(c) for c in columns], note
    )


def canonical_structure(col: Column) -> Column:
    """One spelling per structure: Greek letters to a/b, curly to square brackets, no blanks, plain hyphens."""
    out = F.translate(col, "αβ{}–—", "ab[]--")
    return F.regexp_replace(out, r"\s+", "")


# Shares and profiles -------------------------------------------------------------------------


def relative_abundance(long: DataFrame, value: str = "value", out: str = "share") -> DataFrame:
    """Percent of the sample total."""
    totals = with_group_stats(long, ["sample"], __total=F.sum(value))
    return totals.withColumn(out, F.try_divide(F.col(value) * 100.0, F.col("__total"))).drop("__total")


def check_supplied(df: DataFrame, computed: str, supplied: str, digits: int = 9) -> DataFrame:
    """Rows checked and rows whose supplied share differs from the computed one."""
    same = equal_to_digits(F.col(computed), F.col(supplied), digits)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.coalesce(same, F.lit(False))).alias("different"))


def feature_stats(long: DataFrame, samples: DataFrame, value: str = "share") -> DataFrame:
    """Mean, sd, median and scaled MAD per feature over all samples; an absent cell is a zero.

    A feature's values make one array as long as the number of samples, and all four figures are
    read off its sorted form.
    """
    n = samples.select("sample").distinct().agg(F.count(F.lit(1)).cast("int").alias("n")).scalar()
    present = long.groupBy("feature").agg(F.collect_list(F.coalesce(F.col(value).cast("double"), F.lit(0.0))).alias("__v")).withColumn("__n", n)
    padded = F.array_sort(F.concat("__v", F.array_repeat(F.lit(0.0), F.col("__n") - F.size("__v"))))

    def middle(a: Column) -> Column:
        return (F.get(a, F.floor((F.col("__n") - 1) / 2).cast("int")) + F.get(a, F.floor(F.col("__n") / 2).cast("int"))) / 2

    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    out = present.withColumn("__v", padded).withColumn("mean", total(F.col("__v")) / F.col("__n")).withColumn("median", middle(F.col("__v")))
    squares = total(F.transform("__v", lambda x: (x - F.col("mean")) * (x - F.col("mean"))))
    apart = F.array_sort(F.transform("__v", lambda x: F.abs(x - F.col("median"))))
    return out.select("feature", "mean", F.when(F.col("__n") > 1, F.sqrt(squares / (F.col("__n") - 1))).alias("sd"), "median", (middle(apart) * 1.4826).alias("mad"))


def feature_size(df: DataFrame, residues: list[str], out: str = "size") -> DataFrame:
    """Number of residues per feature; a missing count is zero."""
    return df.withColumn(out, sum((F.coalesce(F.col(r), F.lit(0)) for r in residues[1:]), F.coalesce(F.col(residues[0]), F.lit(0))))


def size_profile(long: DataFrame, value: str = "share") -> DataFrame:
    """Total abundance per size and sample."""
    return long.groupBy("size", "sample").agg(F.sum(value).alias("abundance"))


def moiety_composition(long: DataFrame, residues: list[str], value: str = "share") -> DataFrame:
    """Share of each residue kind per sample: abundance x count / size, summed over features.

    Each input row fans out to one row per residue kind inside the aggregate, so the shuffle
    carries (sample, moiety) partial sums only.
    """
    parts = F.array(*[F.struct(F.lit(r).alias("moiety"), F.col(r).alias("n")) for r in residues])
    rows = long.select("sample", F.col(value).alias("__v"), "size", F.inline(parts))
    amount = F.try_divide(F.col("__v") * F.col("n"), F.col("size"))
    return rows.groupBy("sample", "moiety").agg(F.sum(amount).alias("abundance"))


def moiety_summary(profile: DataFrame) -> DataFrame:
    return profile.groupBy("moiety").agg(F.avg("abundance").alias("mean"), F.stddev_samp("abundance").alias("sd"))


def share_by_predicate(long: DataFrame, predicate: Column, value: str = "share", name: str = "has") -> DataFrame:
    """Percent of the total abundance carried by rows with and without the property."""
    total = long.agg(F.sum(value).alias("t")).scalar()
    sums = long.groupBy(predicate.alias(name)).agg(F.sum(value).alias("__s"))
    return sums.select(name, F.try_divide(F.col("__s") * 100.0, total).alias("percent"))


def duplicate_structures(df: DataFrame, id_col: str, structure: str) -> DataFrame:
    """Structures used by more than one id."""
    return repeated_keys(df.select(id_col, structure).distinct(), structure, name="ids")


def wide_by_sample(long: DataFrame, samples: list[str], value: str = "share") -> DataFrame:
    return to_wide(long, ["feature"], "sample", value, samples, fill=0.0)


def wide_by_feature(long: DataFrame, features: list[str], value: str = "share") -> DataFrame:
    return to_wide(long, ["sample"], "feature", value, features, fill=0.0)


def group_members(samples: DataFrame, condition: str) -> DataFrame:
    return samples.filter(F.col("condition") == condition).select("sample").distinct()


# Motifs --------------------------------------------------------------------------------------

_TOKEN = re.compile(r"[\[\]]|[^\[\]()]+(?:\([^()]*\))?")


def terminal_fragments(text: str, sizes: tuple[int, ...] = (1, 2, 3)) -> list[str]:
    """Fragments of each size that start at a tip of a branched structure and run towards its root.

    The root is the last residue; square brackets hold side branches of the residue that follows.
    """
    residues, parent, open_branches, current = [], [], [], -1
    for token in reversed(_TOKEN.findall(text or "")):
        if token == "]":
            open_branches.append(current)
        elif token == "[":
            current = open_branches.pop() if open_branches else current
        else:
            residues.append(token)
            parent.append(current)
            current = len(residues) - 1
    inner = set(parent)
    out = []
    for tip in (i for i in range(len(residues)) if i not in inner):
        chain, at = [], tip
        while at >= 0 and len(chain) < max(sizes):
            chain.append(residues[at])
            at = parent[at]
            if len(chain) in sizes:
                out.append("Terminal_" + "".join(chain))
    return out


def _fragments(text: pd.Series) -> pd.Series:
    return text.map(lambda s: terminal_fragments(s))


def terminal_motifs(structures: DataFrame, structure: str = "structure") -> DataFrame:
    """Motif counts per distinct structure: (structure, motif, n).

    Python sees each distinct structure once, however many rows share it.
    """
    fragments = F.pandas_udf(_fragments, "array<string>")
    distinct = structures.select(structure).filter(F.col(structure).isNotNull()).distinct()
    return (
        distinct.select(structure, F.explode(fragments(structure)).alias("motif"))
        .groupBy(structure, "motif")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def motif_abundance(motifs: DataFrame, abundance: DataFrame, key: str = "structure", value: str = "share") -> DataFrame:
    """Motif count x abundance, summed per (motif, sample).

    Abundance is first summed per (structure, sample), so the join sees one row per cell.
    """
    cells = abundance.groupBy(key, "sample").agg(F.sum(value).alias("__v"))
    return motifs.join(cells, key).groupBy("motif", "sample").agg(F.sum(F.col("n") * F.col("__v")).alias("abundance"))


def rarity_filter(long: DataFrame, samples: DataFrame, feature: str, value: str, min_share: float = 0.05) -> DataFrame:
    """Features present in at least the given share of all samples. The table is read twice, so it is stored."""
    long = cut_lineage(long)
    n = samples.select("sample").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    present = long.groupBy(feature).agg(F.count_if(F.col(value) > 0).alias("__p"))
    keep = present.filter(F.col("__p") >= n * min_share)
    return keep_in(long, feature, keep, feature)


def differential_abundance(
    long: DataFrame, samples: DataFrame, feature: str, value: str, first: str, second: str, group: str = "condition",
    min_share: float = 0.1, pseudo: float = 1e-3, with_p: bool = True,
) -> DataFrame:
    """Welch test on log2(value + pseudo) - log2(pseudo) between two groups, per feature.

    Shifted so that an absent cell is exactly zero: absent cells then need no rows.
    """
    kept = rarity_filter(long, samples, feature, value, min_share)
    design = samples.select("sample", group).distinct()
    logged = kept.join(design, "sample").withColumn("__x", F.log2((F.col(value) + pseudo) / pseudo))
    sizes = design.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    stats = welch_stats_sparse(logged, [feature], "__x", group, first, second, sizes)
    return with_t_p(stats) if with_p else stats


def top_motifs(long: DataFrame, samples: DataFrame, k: int = 10, feature: str = "motif", value: str = "abundance") -> DataFrame:
    """Highest mean over all samples, ties kept; absent cells count as zero."""
    n = samples.select("sample").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    means = long.groupBy(feature).agg((F.sum(value) / n).alias("mean"))
    return top_with_ties(means, "mean", k)


def top_vs_rest(means: DataFrame, k: int = 10, value: str = "mean") -> DataFrame:
    """Sum of the top k (ties kept), sum and maximum of the rest, as one row."""
    best, rest = top_and_rest(means, value, k)
    top = best.agg(F.sum(value).alias("v")).scalar()
    return rest.agg(F.sum(value).alias("rest_sum"), F.max(value).alias("rest_max")).withColumn("top_sum", top)


def motif_carriers(motifs: DataFrame, features: DataFrame, pattern: str, value: str = "mean") -> DataFrame:
    """Abundance of features whose structure carries a matching motif, and of all others."""
    carriers = motifs.filter(F.col("motif").rlike(pattern) & (F.col("n") > 0)).select("structure").distinct()
    having = keep_in(features, "structure", carriers, "structure").agg(F.sum(value).alias("carrier_sum"), F.count(F.lit(1)).alias("carriers"))
    without = keep_not_in(features, "structure", carriers, "structure").agg(F.sum(value).alias("v")).scalar()
    return having.withColumn("other_sum", without)


def annotated_ranking(kept: DataFrame, values: DataFrame, design: DataFrame, condition: str, samples: list[str], value: str) -> DataFrame:
    """Chosen features with their control mean and one column per sample; an absent cell is a zero."""
    chosen = values.join(kept, "feature", "left_semi")
    n = design.filter(F.col("condition") == condition).select("sample").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    means = chosen.groupBy("feature").agg((F.coalesce(F.sum(F.when(F.col("condition") == condition, F.col(value))), F.lit(0.0)) / n).alias("control_mean"))
    return means.join(to_wide(chosen, ["feature"], "sample", value, samples, fill=0.0), "feature")


def term_member_table(annotation: DataFrame, values: DataFrame, term: str) -> DataFrame:
    """Members of one term with their values, long form."""
    members = annotation.filter(F.col("term") == term).select("gene").distinct()
    return values.join(members.withColumnRenamed("gene", "feature"), "feature", "left_semi")
