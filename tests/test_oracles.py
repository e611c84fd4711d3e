"""Registered queries with SQL against DuckDB on the smallest tables: a sample of all families."""

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ("paragraph_scan", "zones", "loss_by_kind", "guard_subscripts", "ms4_unbalanced", "ms8_doubled", "ms18_citation_numbers", "ref_entries", "renumber", "rw1_authors", "rw4_keywords", "rw11_variant", "quota", "usage_rollup", "daily_findings", "recommend_topk", "skipped_levels", "daily_stream", "package_styles", "package_cells", "package_outline", "package_media", "package_table_format", "package_triage", "guard_twins_mixed", "guard_locants", "entry_moves", "dangling_citations", "fill_dois", "ref_gaps", "heading_scan", "cell_edits", "stalled_stream", "review_stream", "mechanical_summary")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, duck, name, tmp_path):
    out = str(tmp_path / name)
    __spark_entry__.queries()[name](spark, SF).write.parquet(out)
    want = duck.sql(__spark_entry__.oracle_sql()[name])
    columns = ", ".join(f'"{c}"' for c in sorted(want.columns))
    duck.sql(f"CREATE OR REPLACE TABLE a AS SELECT {columns} FROM '{out}/*.parquet'")
    duck.sql(f"CREATE OR REPLACE TABLE b AS SELECT {columns} FROM want")
    assert duck.sql("SELECT count(*) FROM a").fetchall()[0][0] > 0
    assert duck.sql("DESCRIBE a").fetchall() == duck.sql("DESCRIBE b").fetchall()
    for x, y in (("a", "b"), ("b", "a")):
        assert duck.sql(f"SELECT * FROM {x} EXCEPT ALL SELECT * FROM {y}").fetchall() == []


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
