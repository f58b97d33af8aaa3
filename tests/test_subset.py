"""The search for a representative subset: draws in one scan, distances, swaps."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillstream.operators import subset as U

ROWS = "row_id long, stratum string, x double, y double, c string, keep boolean"


def table(n=300):
    rng = np.random.default_rng(0)
    kind = lambda: None if rng.random() < 0.1 else "abcde"[int(rng.integers(5))]
    return [(i, "pq"[i % 5 == 0] if i != 7 else "lone", None if i % 11 == 0 else float(rng.normal()), float(i % 17), kind(), i % 50 == 3) for i in range(n)]


def quotas(rows, part, fixed=0):
    sizes = pd.Series([r[1] for r in rows]).value_counts()
    return [(k, int(n), max(1, int(n * part))) for k, n in sizes.items()] + [("none", 0, 0)]


def frames(spark, rows, q):
    return spark.createDataFrame(rows, ROWS), spark.createDataFrame(q, "stratum string, n long, quota long")


def place(draw, row):
    return int(hashlib.md5(f"{draw}:{row}".encode()).hexdigest()[:8], 16), row


@pytest.mark.parametrize("spare, slack", [(0.0, 8.0), (1.0, 8.0), (0.0, 0.0), (0.0, -2.0)])
def test_draws_are_those_of_a_full_sort(spark, spare, slack):
    """With thresholds that are too low, too: what they miss is taken again."""
    rows = table()
    q = quotas(rows, 0.1)
    df, qf = frames(spark, rows, q)
    got = {}
    for r in U.seeded_rows(df, qf, 6, spare=spare, slack=slack).collect():
        got.setdefault((r["draw"], r["stratum"]), []).append((r["_k"], r["row_id"]))
    for d in range(6):
        for key, n, quota in q[:-1]:
            order = sorted((place(d, r[0]) for r in rows if r[1] == key))
            want = [row for _, row in order[: min(n, int(np.ceil(quota * (1 + spare))))]]
            assert [row for _, row in sorted(got[d, key])] == want


def test_few_rows_are_shuffled(spark):
    """A twentieth of the rows in 40 draws: about twice the rows, not 40 times."""
    df = spark.range(20_000).selectExpr("id AS row_id", "'s' AS stratum")
    qf = spark.createDataFrame([("s", 20_000, 1000)], "stratum string, n long, quota long")
    plan = U.seeded_rows(df, qf, 40)
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert plan.count() == 40_000 and "Window" in text
    h = F.conv(F.substring(F.md5(F.concat_ws(":", "d", F.col("row_id").cast("string"))), 1, 8), 16, 10).cast("long")
    kept = df.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(39)))).where(h < (1000 + 8 * 1000**0.5 + 1) / 20_000 * 2**32).count()
    assert 40_000 < kept < 54_000


def by_hand(whole, sub, numbers, categories):
    """KS on all values as binned, total variation, coverage."""
    ks = []
    for v in range(len(numbers)):
        a, b = np.sort(whole[0][:, v]), np.sort(sub[0][:, v])
        at = np.arange(U.BINS + 2)
        ks.append(np.abs(np.searchsorted(a, at, "right") / len(a) - np.searchsorted(b, at, "right") / len(b)).max())
    tv, cover = [], [1.0]
    for c in range(len(categories)):
        a, b = (np.bincount(x[1][:, c], minlength=U.LEVELS + 1) for x in (whole, sub))
        tv.append(0.5 * np.abs(a / a.sum() - b / b.sum()).sum())
        cover.append((b[a > 0] / (a[a > 0] / a.sum() * b.sum())).min())
    return ks, tv, min(cover)


def test_distances_after_swaps_are_those_of_the_subset(spark):
    rows = table()
    df, _ = frames(spark, rows, quotas(rows, 0.1))
    whole = U.Whole(df, ["x", "y"], {"c": 2.0})
    pdf = df.toPandas()
    bins, levels = whole.coded(pdf)
    rng, on = np.random.default_rng(1), np.arange(len(rows)) < 60
    now = U.Subset(whole, bins[on], levels[on])
    for _ in range(200):
        i, j = rng.choice(np.flatnonzero(on)), rng.choice(np.flatnonzero(~on))
        now.swap((bins[i], levels[i]), (bins[j], levels[j]))
        on[i], on[j] = False, True
        want = by_hand((bins, levels), (bins[on], levels[on]), ["x", "y"], ["c"])
        got = now.parts()
        assert np.allclose(got[0], want[0]) and np.allclose(got[1], want[1]) and np.isclose(got[2], want[2])
    assert U.bins_of(np.array([np.nan, -9, 0, 1, 2, 9]), np.array([0.0, 1.0, 2.0])).tolist() == [0, 1, 1, 2, 3, 4]


def test_swaps_bring_every_draw_nearer_and_keep_quotas(spark):
    rows = table()
    q = quotas(rows, 0.15)
    df, qf = frames(spark, rows, q)
    found = U.polished(df, qf, 5, ["x", "y"], {"c": 1.0}, swaps=400, fixed="keep").collect()
    keep, stratum = {r[0] for r in rows if r[5]}, {r[0]: r[1] for r in rows}
    assert sorted(r["draw"] for r in found) == list(range(5))
    for r in found:
        ids = r["row_ids"]
        assert r["after"] < r["before"] and r["swaps"] > 0 and keep <= set(ids) and len(set(ids)) == len(ids)
        held = pd.Series([stratum[i] for i in ids]).value_counts().to_dict()
        assert held == {k: max(quota, sum(stratum[i] == k for i in keep)) for k, _, quota in q[:-1]}
    again = U.polished(df, qf, 5, ["x", "y"], {"c": 1.0}, swaps=400, fixed="keep")
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, found), key=str)
    best = U.best_subset(again).collect()
    assert {r["after"] for r in best} == {min(r["after"] for r in found)} and len(best) == len(found[0]["row_ids"])


def test_hard_tables(spark):
    one, qf = frames(spark, [(1, "s", None, 1.0, None, False)], [("s", 1, 1)])
    assert [tuple(r)[1:4] for r in U.polished(one, qf, 2, ["x", "y"], {"c": 1.0}).collect()] == [(0.0, 0.0, 0)] * 2
    none, qf = frames(spark, [], [])
    assert U.polished(none, qf, 2, ["x"], {"c": 1.0}).count() == 0
    df, qf = frames(spark, table(40), quotas(table(40), 0.2))
    assert U.polished(df, qf, 2, [], {}).count() == 2
