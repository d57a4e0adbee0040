"""Spark against DuckDB on the smallest tables, for queries of different kinds."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = ["edge_summary", "overlap_class", "compat_pairs", "chain_best", "coverage_outliers", "interval_union", "kmer_threshold", "fasta_wrap", "consensus", "any_primary_retain", "chain_orders", "clip_ends", "cluster_weights", "anchor_cliques", "unitigs", "scrubbed_ranges", "degrees", "sane_contraction", "kmer_count"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = entry.queries()[name](spark, SF)
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(found.columns)
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r)) for r in found.select(*columns).collect())
