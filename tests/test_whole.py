"""Queries read whole tables: no SQL takes a subset by the remainder of an id, and callers are followed to depth 2."""

import re

import pytest

from plexigraph.plans import catalog

#: Remainders that a WHERE may compare because they make two versions of a table to be told apart.
VERSIONS = {"snapshot_diff", "incremental_plan", "dirty_phases", "compare_runs", "unresolved_breakdown", "owner_longest_prefix"}


@pytest.mark.parametrize("name", sorted(set(catalog.SQL) - VERSIONS))
def test_no_subset_by_remainder(name):
    assert not re.search(r"(WHERE|AND) [a-z_.]*(id|key|hunk) % \d+ (=|<>)", catalog.SQL[name])


def test_change_wide_impact_counts_second_callers(spark, tmp_path):
    """A chain of calls 3 > 2 > 1 > 0, of which a hunk changes the last: two callers, not three and not one."""
    part = [(k, "n", "Brand#1", f"T{k}", 10) for k in range(4)]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    lines = [(0, 1, 0), *[(10 + k, n, p) for k in range(3) for n, p in ((2, k + 1), (3, k))]]
    rows = [(o, n, p, 1, 50.0, "d") for o, n, p in lines]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_shipdate string").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert [tuple(r) for r in catalog.QUERIES["change_wide_impact"](spark, str(tmp_path)).collect()] == [("Brand#1", 1, 2)]
