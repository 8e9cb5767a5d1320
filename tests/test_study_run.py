"""The study in one call, and block bootstraps per group against plain resampling."""

import hashlib
import random

import numpy as np
import pytest

from checks import study
from labelwright.operators.resampling import block_draws, bootstrap_blocks
from labelwright.plans import study_run


def plain_auroc(y, s):
    pos, neg = [b for a, b in zip(y, s, strict=True) if a], [b for a, b in zip(y, s, strict=True) if not a]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


def plain_bootstrap(rows, n_boot, seed):
    """rows (block, y, score) of one group."""
    blocks = sorted({b for b, _, _ in rows})
    values = []
    for r in range(n_boot):
        drawn = [blocks[int(hashlib.md5(f"{seed}|{r}|{d}".encode()).hexdigest()[:8], 16) % len(blocks)] for d in range(len(blocks))]
        some = [(y, s) for b in drawn for bb, y, s in rows if bb == b]
        if len({y for y, _ in some}) == 2:
            values.append(plain_auroc(*zip(*some, strict=True)))
    return len(values), np.percentile(values, 2.5), np.percentile(values, 97.5), len(blocks)


@pytest.mark.parametrize("limits", [{}, {"small": 5, "range_cells": 4}])
def test_block_bootstrap_per_group_equals_plain_resampling(spark, limits):
    rnd = random.Random(6)
    rows = [(rnd.choice(["a", "b", None]), f"m{rnd.randint(0, 5)}", int(rnd.random() < 0.4), rnd.randint(0, 9) / 10) for _ in range(240)]
    rows = [r for r in rows if not (r[0] == "b" and r[1] > "m2")]  # groups with other numbers of blocks
    df = spark.createDataFrame([*rows, ("a", None, 1, 0.5), ("a", "m1", None, 0.5)], "g string, block string, y int, s double")
    got = {r.g: r for r in bootstrap_blocks(df, "y", "s", "block", 30, 9, by=["g"], **limits).collect()}
    assert set(got) == {"a", "b", None}
    for g, row in got.items():
        want = plain_bootstrap([r[1:] for r in rows if r[0] == g], 30, 9)
        assert (row.replicates, row.auroc_lo, row.auroc_hi, row.blocks) == pytest.approx(want)


def test_every_replicate_draws_as_many_blocks_as_there_are(spark):
    draws = block_draws(spark.createDataFrame([(1,), (7,), (40,)], "blocks long"), 25, 3)
    sums = {}
    for r in draws.collect():
        for t in r.times:
            sums[r.blocks, t.replicate] = sums.get((r.blocks, t.replicate), 0) + t.w
    assert sums == {(n, k): n for n in (1, 7, 40) for k in range(25)}


def test_the_study_runs_whole(spark, sf):
    parts = study.study_sections(spark, sf, specs=study_run.study_specs(rounds=2), n_boot=20)
    models = {r.model: r for r in parts["models"].collect()}
    assert set(models) == {s.name for s in study_run.study_specs()} | {study_run.IN_FLIGHT_MODEL}
    splits = {r.split: r for r in parts["splits"].collect()}
    plain = models["logistic_regression"]
    assert (plain.n, plain.positives) == (splits["test"].n, splits["test"].late)
    flown = models[study_run.IN_FLIGHT_MODEL]
    assert flown.n - plain.n == flown.positives - plain.positives > 0
    assert all(r.auroc_lo <= r.auroc_hi and r.auroc_month_lo <= r.auroc_month_hi and r.months > 1 for r in models.values())
    months = parts["by_month_test"].filter("model = 'logistic_regression'").collect()
    assert sum(r.n for r in months) == plain.n and len(months) == plain.months
    assert sum(r.n for r in parts["by_month"].collect()) == splits["train"].n + splits["test"].n
    assert parts["sweep"].count() == 5 * 4 and parts["pr_curve"].count() == 30 * 4
    assert parts["constant"].first().n == parts["audit_summary"].first().n == plain.n
    assert parts["lead_days_only"].first().n == plain.n and parts["audit_tree"].first().folds == 5
    assert parts["cutoff"].count() == 1 and parts["notes"].count() > 0 and parts["audit_rule"].count() == 1
    assert parts["reliability"].filter("model = 'logistic_regression'").groupBy().sum("n").first()[0] == plain.n


def test_a_section_that_is_not_wanted_costs_nothing(spark, sf, monkeypatch):
    """The audit of all test rows, trees included, was run whenever the models were asked for."""
    def no(*_, **__):
        raise AssertionError("not asked for")

    monkeypatch.setattr(study_run, "audit", no)
    monkeypatch.setattr(study_run, "scored_cohorts", lambda table, specs, seed: table.filter("cohort = 'test'").selectExpr(
        "'m' AS model", "order_id", "date_format(purchased, 'yyyy-MM') AS month", "late", "order_id % 7 / 7.0D AS p1"))
    parts = study.study_sections(spark, sf, n_boot=5, wanted=["models"])
    assert list(parts) == ["models"] and parts["models"].count() == 1
