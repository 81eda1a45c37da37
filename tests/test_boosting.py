"""The leaf-wise booster against a replay of the same fit on one machine."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from coppice.operators import binning
from coppice.plans import boosting


def table(spark, seed, n=500, classes=2):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = r.gauss(0, 1), float(r.randrange(12)), r.random()
        y = int(a + 0.3 * b > 2) if classes == 2 else int(a > 0) + int(b > 6)
        y = y if r.random() < 0.9 else r.randrange(classes)
        rows.append((round(a, 3) if i % 41 else None, b, round(c, 2), 1.0, f"c{y}", float(r.randrange(1, 4)), i % 5 == 0))
    return spark.createDataFrame(rows, "a double, b double, c double, one double, y string, w double, valid boolean").repartition(3)


FEATURES = ["a", "b", "c", "one"]


def replay(rows, booster, s):
    """Splits and validation losses of two-class rounds, every histogram from the rows themselves."""
    x = np.array([[booster.fill[f] if r[f] is None else r[f] for f in FEATURES] for r in rows], float)
    y, w, held = (np.array([r[k] for r in rows]) for k in ("y", "w", "valid"))
    y = (y == "c1").astype(float)
    fit = ~held
    m = np.full(len(rows), math.log((w * y)[fit].sum() / (w * (1 - y))[fit].sum()))
    parts = boosting.PARTS
    found, losses = [], []

    def score(g, h):
        g, h = g / parts, h / parts + s.ridge
        return g * g / h if h > 0 else 0.0

    for _ in range(s.trees):
        p = 1 / (1 + np.exp(-m))
        g, h = np.floor((p - y) * (w * parts) + 0.5), np.floor(p * (1 - p) * (w * parts) + 0.5)

        def best(own):
            top = (1e-12, None)
            for f in FEATURES:
                for e in booster.edges[f]:
                    low = own & (x[:, FEATURES.index(f)] < e)
                    high = own & ~low
                    sides = [(g[k & fit].sum(), h[k & fit].sum(), (k & fit).sum()) for k in (low, high)]
                    if min(k[2] for k in sides) < s.min_rows or min(k[1] for k in sides) < s.min_hessian * parts:
                        continue
                    gain = sum(score(a, b) for a, b, _ in sides) - score(g[own & fit].sum(), h[own & fit].sum())
                    if gain > top[0]:
                        top = (gain, (f, e, low, high))
            return top

        every = np.ones(len(rows), bool)
        leaves, splits = [(every, 0, best(every))], []
        while len(leaves) < s.leaves:
            able = [i for i, (_, d, b) in enumerate(leaves) if b[1] and (s.depth is None or d < s.depth)]
            if not able:
                break
            i = max(able, key=lambda i: leaves[i][2][0])
            _, d, (gain, (f, e, low, high)) = leaves.pop(i)
            splits.append((f, e, gain))
            leaves += [(low, d + 1, best(low)), (high, d + 1, best(high))]
        for own, *_ in leaves:
            m[own] += -s.rate * (g[own & fit].sum() / parts) / (h[own & fit].sum() / parts + s.ridge)
        found.append(splits)
        sign = np.where(y == 1, -m, m)
        losses.append(float((w * np.logaddexp(0, sign))[held].sum() / w[held].sum()))
    return found, losses, m


@pytest.mark.parametrize(("seed", "depth"), [(0, None), (1, 2)])
def test_splits_are_those_of_a_replay(spark, seed, depth):
    df = table(spark, seed).cache()
    s = boosting.Settings(trees=4, leaves=6, depth=depth, rate=0.4, bins=16, ridge=0.5, min_rows=8, patience=50, cut_every=2)
    got = boosting.fit(df, FEATURES, "y", s, "w", "valid")
    rows = df.collect()
    want, losses, margins = replay(rows, got, s)
    assert got.losses == pytest.approx(losses, abs=1e-5)
    assert len(got.splits[0]) == 1 + int(np.argmin(losses))
    for mine, theirs in zip(got.splits[0], want, strict=False):
        assert [(f, t) for f, t, *_ in mine] == [(f, t) for f, t, _ in theirs]
        assert [x[2] for x in mine] == pytest.approx([x[2] for x in theirs], rel=1e-6)
    if len(got.splits[0]) == s.trees:
        scored = {(r["a"], r["b"], r["c"], r["y"]): r["m"] for r in got.logits(df, "m").collect()}
        for r, m in zip(rows, margins, strict=True):
            assert scored[r["a"], r["b"], r["c"], r["y"]] == pytest.approx(m)
    assert got.edges["one"] == []
    df.unpersist()


def test_partitions_change_nothing(spark):
    df = table(spark, 3)
    s = boosting.Settings(trees=2, leaves=5, bins=8)
    assert boosting.fit(df, FEATURES, "y", s).splits == boosting.fit(df.repartition(7, "c"), FEATURES, "y", s).splits


def test_stops_when_validation_rows_say_so(spark):
    df = table(spark, 4, 200).withColumn("y", F.when(F.col("valid"), F.when(F.col("y") == "c0", "c1").otherwise("c0")).otherwise(F.col("y")))
    got = boosting.fit(df, FEATURES, "y", boosting.Settings(trees=30, leaves=4, rate=0.5, bins=8, patience=2), valid="valid")
    assert len(got.losses) < 30
    assert len(got.trees[0]) == 1 + int(np.argmin(got.losses))


def test_three_classes_and_shares_of_rows(spark):
    df = table(spark, 5, 400, 3).cache()
    s = boosting.Settings(trees=3, leaves=4, rate=0.5, bins=8, feature_share=0.75, row_share=0.7)
    both = boosting.fit_several(df, FEATURES, "y", 2, s)
    assert [len(t) for t in both.boosters[0].trees] == [3, 3, 3]
    told = both.logits(df).withColumn("best", F.array_position("teacher_logit", F.array_max("teacher_logit")) - 1)
    assert told.columns == [*df.columns, "teacher_logit", "best"]
    assert told.where(F.concat(F.lit("c"), F.col("best")) == F.col("y")).count() > 280
    assert {f for f, *_ in both.thresholds()} <= set(FEATURES)
    df.unpersist()


def test_edges_fall_back_to_quantiles(spark):
    df = table(spark, 6).withColumn("two", F.when(F.col("b") > 5, 4.0).otherwise(1.0))
    features = [*FEATURES, "two"]
    got = boosting.fit(df, ["a", "b"], "y", boosting.Settings(trees=2, leaves=4, bins=16))
    edges = boosting.teacher_edges(got, df, features, 6)
    used = {f: {t for g, t, *_ in got.thresholds() if g == f} for f in ("a", "b")}
    assert all(set(edges[f]) <= used[f] and len(edges[f]) <= 5 for f in used if used[f])
    assert edges["c"] == binning.edges_of(df, ["c"], 6)["c"]
    assert edges["one"] == []
    assert edges["two"] == [2.5]


def test_odd_rows(spark):
    df = spark.createDataFrame([(1.0, "x"), (float("nan"), "x"), (None, "z"), (float("inf"), None)], "a double, y string")
    got = boosting.fit(df, ["a"], "y", boosting.Settings(trees=2))
    assert got.thresholds() == []
    assert got.logits(df, "m").count() == 4
    with pytest.raises(ValueError, match="classes"):
        boosting.fit(df.where("y = 'x'"), ["a"], "y")
    with pytest.raises(ValueError, match="classes"):
        boosting.fit(df.where("false"), ["a"], "y")


def test_columns_go_by_halving(spark, monkeypatch):
    r = random.Random(8)
    rows = []
    for _ in range(300):
        x = [float(r.randrange(6)) for _ in range(8)]
        rows.append((*x, int(x[2] > 2) + 2 * int(x[5] > 3)))
    names = [f"x{i}" for i in range(8)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names) + ", y int").coalesce(2).cache()
    fits, own = [], boosting.fit
    monkeypatch.setattr(boosting, "fit", lambda *a, **k: fits.append(1) or own(*a, **k))
    kept, share = boosting.eliminate_columns(df, names, "y", boosting.Settings(trees=3, leaves=4, rate=0.5, bins=8))
    assert kept == ["x2", "x5"]
    assert share == 1.0
    assert len(fits) <= 4
    df.unpersist()
