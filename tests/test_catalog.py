import glob
import os

import duckdb
import pytest

from tallyloom import catalog


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def sorted_rows(frame, cols):
    plain = frame[cols].astype(object)
    return sorted(map(str, plain.where(plain.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, duck, sf, name):
    mine, theirs = catalog.QUERIES[name](spark, sf).toPandas(), duck.execute(catalog.SQL[name]).df()
    cols = sorted(mine.columns)
    assert cols == sorted(theirs.columns) and sorted_rows(mine, cols) == sorted_rows(theirs, cols)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_chunk_states_of_the_corpus_fit(spark, sf):
    rows = catalog.chunk_states(spark, sf).collect()
    assert all(r["error"] is None and r["n_chars"] <= 4 * 600 for r in rows)


def test_plans(spark, sf):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    counts = plan(catalog.threshold_counts(spark, sf))
    assert "ReadSchema: struct<doc_id:bigint>" in counts and counts.count("Exchange hashpartitioning") == 1
    assert "CartesianProduct" not in plan(catalog.review_queue(spark, sf))


def test_weekly_coverage_holds_no_table_of_ids_in_a_task(spark, sf):
    plan = catalog.weekly_coverage(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_entry_points(spark, sf):
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and entry.entry(spark).count() == 4
