"""Every query runs on the smallest tables and agrees with its SQL there."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: A few of each kind; the driver compares all.
NAMES = ["exact_knn", "epsilon_closure", "recall_at_k", "stratified_sample", "fixed_windows", "overall_outcomes", "manifest_digest"]


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 8)
    return str(value) if value is not None else None


@pytest.mark.parametrize("name", NAMES)
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    mine = entry.queries()[name](spark, SF)
    theirs = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in theirs.description]
    assert sorted(names) == sorted(mine.columns)
    rows = sorted(str([plain(r[c]) for c in sorted(names)]) for r in mine.collect())
    want = sorted(str([plain(r[names.index(c)]) for c in sorted(names)]) for r in theirs.fetchall())
    assert rows == want


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
