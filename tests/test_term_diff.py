"""The comparison of two sources' terms uses every part, whatever its size."""

import duckdb

import __spark_entry__ as entry
from featuremill.plans.base import SCHEMAS

MIDDLE = [
    (1, "old ring", "Brand#1", "SMALL", 10),
    (2, "old ring", "Brand#1", "SMALL", 40),
    (3, "new bolt", "Brand#2", "PROMO", 31),
    (4, "new bolt", "Brand#2", "LARGE", 30),
    (5, "hot gear", "Brand#3", "LARGE", None),
    (6, None, "Brand#3", "LARGE", 20),
    (7, "hot gear", "Brand#4", None, 35),
]
WANT = [("hot gear Brand#4", "b"), ("new bolt Brand#2", "b"), ("new bolt Brand#2 PROMO", "a"), ("old ring Brand#1", "b")]


def run(spark, folder):
    df = entry.queries()["term_diff"](spark, str(folder))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{folder}/part.parquet/*.parquet'")
    cur = con.execute(entry.oracle_sql()["term_diff"])
    assert [d[0] for d in cur.description] == df.columns == ["term", "side"]
    return sorted(map(tuple, df.collect())), sorted(cur.fetchall())


def write(spark, rows, folder):
    spark.createDataFrame([(*r, 1.0) for r in rows], SCHEMAS["part"]).write.parquet(f"{folder}/part.parquet")


def test_parts_of_middle_size_count(spark, tmp_path):
    write(spark, MIDDLE, tmp_path)
    got, want = run(spark, tmp_path)
    assert got == want == WANT


def test_every_size_counts(spark, tmp_path):
    """A small part takes the full term of its name off the difference; where both parts are large, it stays."""
    rows = [(2 * s + i, f"n{s}", "Brand#1", "SMALL", size) for s in range(1, 51) for i, size in enumerate((s, 40))]
    write(spark, rows, tmp_path)
    got, want = run(spark, tmp_path)
    assert got == want == sorted([(f"n{s} Brand#1", "b") for s in range(1, 51)] + [(f"n{s} Brand#1 SMALL", "a") for s in range(31, 51)])
