"""Registered queries against their SQL.  ``ALL_QUERIES=1`` runs every one of them."""

import os

import pytest

import __spark_entry__ as entry
from oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
CORE = ["a01_threads", "a04_top_kernels", "t07_parent", "t14_gaps", "a08_overlap_by_step", "a03_modules", "a11_source_hotspots",
        "a16_attribution", "t19_external_id_module", "g31_call_edges", "g09_absorption", "g28_ranks", "g27_lift_to_siblings", "g22_routed_edges", "d05_submodules"]


@pytest.mark.parametrize("name", sorted(entry.queries()) if os.environ.get("ALL_QUERIES") else CORE)
def test_query_matches_sql(spark, name):
    problem = compare(spark, connect(SF), name, SF)
    assert not problem, problem


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
