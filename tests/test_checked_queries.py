"""Every checked query against its SQL, and proof that the comparison notices differences."""

import pytest

from __spark_entry__ import entry
from checks import all_checks
from tools.compare import compare, oracle_connection

QUERIES, ORACLES = all_checks()
ROWS_ONLY = {"file_fingerprint", "bootstrap_rank_ci",
             "baseline_models", "cv_models", "model_margins", "study_models"}


@pytest.fixture(scope="module")
def con(sf):
    return oracle_connection(sf)


def test_every_query_but_the_named_ones_has_sql():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, sf, name):
    outcome = compare(spark, con, name, QUERIES[name], ORACLES[name], sf)
    assert outcome.startswith("ok"), outcome


@pytest.mark.parametrize("name", ["file_fingerprint", "bootstrap_rank_ci"])
def test_rows_only_queries_give_rows(spark, con, sf, name):
    assert compare(spark, con, name, QUERIES[name], None, sf).startswith("rows-only")


@pytest.mark.parametrize("name, old, new", [
    ("confusion", "gold=0 AND label=1", "gold=0 AND label=0"),
    ("late_label", "100+200*", "90+20*"),
    ("reliability", "score>=lo", "score>=lo-0.02"),
    ("edit_set", "Traffic_Status: $9", "Traffic_Status: $8"),
])
def test_a_perturbed_oracle_is_caught(spark, con, sf, name, old, new):
    assert old in ORACLES[name]
    assert not compare(spark, con, name, QUERIES[name], ORACLES[name].replace(old, new), sf).startswith("ok")


def test_flagship_finds_the_planted_rule(spark):
    row = entry(spark).first()
    assert row["rule"] == 'l_returnflag == "R" OR o_orderpriority == "1-URGENT"'
    assert row["mismatches"] == 0 and row["positives"] == row["positives_covered"] == 2732
