"""Searches against brute force, invariants, and the small fixtures of the blueprint."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from coppice.functions.impurity import softmax
from coppice.operators import binning, evaluate, prep, ranks, rowsets
from coppice.plans import bounded, exact, imbalance, levelwise, modelstore, multiway, rashomon, scatter, selection, trees
from coppice.sources import tables

BITS = ["a", "b", "c"]


def frame(spark, rows, names):
    return spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names))


def all_trees(x, y, rows, depth, features):
    """Every tree of at most this depth: (errors, leaves, text). No split leaves a side empty."""
    for label in sorted(set(y)):
        yield sum(y[i] != label for i in rows), 1, str(label)
    if depth:
        for f in features:
            on, off = [i for i in rows if x[i][f]], [i for i in rows if not x[i][f]]
            if on and off:
                for a, b in itertools.product(all_trees(x, y, on, depth - 1, features), all_trees(x, y, off, depth - 1, features)):
                    yield a[0] + b[0], a[1] + b[1], f"({f} {a[2]} {b[2]})"


@pytest.mark.parametrize("seed", range(4))
def test_optimal_equals_brute_force(spark, seed):
    r = random.Random(seed)
    x = [[r.randint(0, 1) for _ in range(3)] for _ in range(24)]
    y = [(a ^ b) if r.random() < 0.8 else c for a, b, c in x]
    reg = 0.02
    best = min(e / 24 + max(reg, 1 / 24) * n for e, n, _ in all_trees(x, y, range(24), 2, range(3)))
    cases = exact.collapse(frame(spark, [(*a, b) for a, b in zip(x, y, strict=True)], [*BITS, "y"]), BITS, "y")
    got = exact.optimal(cases, exact.Settings(2, reg))
    assert got.objective == pytest.approx(best)
    s = exact.Search(cases, exact.Settings(2, reg))
    assert s.objective(np.arange(len(cases.x)), got.tree) == pytest.approx(best)
    for other in (exact.lookahead(cases, exact.Settings(2, reg), 1), exact.recursive_lookahead(cases, exact.Settings(2, reg)), exact.greedy(cases, exact.Settings(2, reg))):
        assert other.objective >= best - 1e-9


def test_lookahead_fits_small_frames(spark):
    five = list(zip([1, 1, 0, 0, 1], [1, 0, 1, 0, 1], [1, 0, 0, 1, 1], strict=True))
    cases = exact.collapse(frame(spark, five, ["a", "b", "y"]), ["a", "b"], "y")
    for got in (exact.lookahead(cases, exact.Settings(2, 0.001, True), 1), exact.recursive_lookahead(cases, exact.Settings(2, 0.001, True), 2)):
        assert all(trees.predict_one(got.tree, {"a": a, "b": b}) == y for a, b, y in five)
    nine = list(zip([1, 1, 0, 0, 1, 0, 1, 0, 1], [1, 0, 1, 0, 1, 0, 1, 1, 0], [1, 0, 1, 0, 1, 1, 0, 0, 1], [1, 1, 0, 0, 1, 1, 0, 1, 0], strict=True))
    got = exact.lookahead(exact.collapse(frame(spark, nine, [*BITS, "y"]), BITS, "y"), exact.Settings(6, 0.001, True), 3)
    assert all(trees.predict_one(got.tree, {"a": a, "b": b, "c": c}) == y for a, b, c, y in nine)


def test_rule_list_and_costs(spark):
    rows = [(a, b, int(a or b)) for a in (0, 1) for b in (0, 1)] * 5
    cases = exact.collapse(frame(spark, rows, ["a", "b", "y"]), ["a", "b"], "y")
    got = exact.optimal(cases, exact.Settings(2, 0.001, True, rule_list=True))
    assert got.objective == pytest.approx(0.003)
    costly = exact.collapse(frame(spark, [(0, 0, 0)] * 6 + [(0, 0, 1)] * 2, ["a", "b", "y"]), ["a", "b"], "y", costs={(0, 1): 10.0})
    assert exact.optimal(costly).tree.prediction == 1
    with pytest.raises(ValueError, match="0 or 1"):
        exact.collapse(frame(spark, [(2, 0)], ["a", "y"]), ["a"], "y")


@pytest.mark.parametrize("seed", range(3))
def test_rashomon_equals_brute_force(spark, seed):
    r = random.Random(seed)
    x = [[r.randint(0, 1) for _ in range(3)] for _ in range(20)]
    y = [a & b if r.random() < 0.85 else 1 - (a & b) for a, b, _ in x]
    reg, cases = 0.05, None
    cases = exact.collapse(frame(spark, [(*a, b) for a, b in zip(x, y, strict=True)], [*BITS, "y"]), BITS, "y")
    got = rashomon.ModelSet(cases, exact.Settings(2, reg), adder=0.1)

    def leaf_label(rows):
        return max(sorted(set(y)), key=lambda v: (sum(y[i] == v for i in rows), -v))

    def grow(rows, depth):  # leaves predict the majority; no two leaves of one class side by side
        label = leaf_label(rows)
        yield sum(y[i] != label for i in rows), 1, str(label)
        if depth:
            for f in range(3):
                on, off = [i for i in rows if x[i][f]], [i for i in rows if not x[i][f]]
                if on and off:
                    for a, b in itertools.product(grow(on, depth - 1), grow(off, depth - 1)):
                        if not (a[2] == b[2] and len(a[2]) == 1):
                            yield a[0] + b[0], a[1] + b[1], f"({f} {a[2]} {b[2]})"

    want = [t for t in grow(range(20), 2) if t[0] / 20 + reg * t[1] <= got.bound + 1e-9]
    assert len(got) == len(want)
    made = [got[i] for i in range(len(got))]
    names = {rashomon.keys(t, BITS, cases.classes) for t in made}
    assert len(names) == len(made)
    found = rashomon.trie(made, BITS, cases.classes)
    assert all(rashomon.contains(found, t, BITS, cases.classes) for t in made)
    assert sum(n for *_, n in got.metric_counts()) == len(got)
    assert len(got.covered(rashomon.f1, 10)) == len(got)
    with pytest.raises(IndexError):
        got[len(got)]


def metric_of(models, tree, metric):
    """1 - metric + regularisation * leaves by walking the tree."""
    c = models.cases

    def walk(rows, t):
        if isinstance(t, trees.Leaf):
            w = c.w[rows].sum(0)
            return (w[1], 0.0, 1) if t.prediction == c.classes[1] else (0.0, w[0], 1)
        return tuple(map(sum, zip(*(walk(r, k) for r, k in zip(models.search.halves(rows, c.features.index(t.feature)), t.children, strict=True)), strict=True)))

    tp, tn, leaves = walk(np.arange(len(c.w)), tree)
    return 1 - metric(tp, tn, *c.w.sum(0)[::-1]) + models.search.reg * leaves


def noisy(spark, bits, rows, seed, names="abcdef"):
    r = random.Random(seed)
    x = [[r.randint(0, 1) for _ in range(bits)] for _ in range(rows)]
    y = [int((a[0] and a[1]) or a[-1]) if r.random() < 0.7 else r.randint(0, 1) for a in x]
    return exact.collapse(frame(spark, [(*a, b) for a, b in zip(x, y, strict=True)], [*names[:bits], "y"]), list(names[:bits]), "y")


@pytest.mark.parametrize("seed", range(3))
def test_covered_trees_equal_listing(spark, seed):
    models = rashomon.ModelSet(noisy(spark, 3, 30, seed), exact.Settings(2, 0.02), adder=0.15)
    every = [models[i] for i in range(len(models))]
    for metric in (rashomon.f1, rashomon.balanced_accuracy):
        values = [metric_of(models, t, metric) for t in every]
        for cut in sorted(values)[:: max(1, len(values) // 5)]:
            want = [i for i, v in enumerate(values) if v <= cut + 1e-9]
            assert models.covered(metric, cut).tolist() == want and models.covered_count(metric, cut) == len(want)
        best, at = models.best_metric(metric)
        assert best == pytest.approx(min(values)) and values[at] == pytest.approx(best)
    assert sum(n for *_, n in models.confusion()) == len(models)


def test_a_set_of_millions_is_covered_without_its_trees(spark, monkeypatch):
    models = rashomon.ModelSet(noisy(spark, 5, 200, 4), exact.Settings(5, 0.005), adder=0.2)
    assert len(models) > 1_000_000
    some = random.Random(0).sample(range(len(models)), 20)
    values = {i: metric_of(models, models[i], rashomon.f1) for i in some}
    monkeypatch.setattr(rashomon.ModelSet, "_tree", None)  # whatever makes a tree fails from here on
    best, first = models.best_metric(rashomon.f1)
    cut = best + 0.02
    at = models.covered(rashomon.f1, cut)
    assert models.covered_count(rashomon.f1, cut) == len(at) == len(np.unique(at)) and at[0] <= first and 0 < len(at) < len(models)
    assert all((i in at) == (v <= cut + 1e-9) for i, v in values.items()) and min(values.values()) >= best - 1e-9
    assert models.covered_count(rashomon.f1, 10) == len(models)


@pytest.mark.parametrize("seed", range(4))
def test_completed_prefixes_equal_listing(spark, seed):
    cases = noisy(spark, 3, 40, seed)
    prefix = rashomon.ModelSet(cases, exact.Settings(1 + seed % 2, 0.02), adder=0.2)
    whole = prefix.completed(1, 0.05)
    leaf = prefix.search.leaf

    def ends(rows):
        found = [(leaf(rows)[0], leaf(rows)[1])]
        for f in np.flatnonzero(prefix.search.gains(rows) > -np.inf):
            a, b = (leaf(x) for x in prefix.search.halves(rows, int(f)))
            if a[1].prediction != b[1].prediction:
                found.append((a[0] + b[0], trees.boolean(cases.features[f], a[1], b[1])))
        least = min(v for v, _ in found)
        return [t for v, t in found if v <= least + 0.05 + 1e-9]

    def fills(rows, t):
        if isinstance(t, trees.Leaf):
            return ends(rows)
        a, b = prefix.search.halves(rows, cases.features.index(t.feature))
        return [trees.boolean(t.feature, x, y) for x in fills(a, t.children[0]) for y in fills(b, t.children[1])]

    names = lambda ts: sorted(rashomon.keys(t, cases.features, cases.classes) for t in ts)
    listed = [t for i in range(len(prefix)) for t in fills(np.arange(len(cases.x)), prefix[i])]
    assert len(whole) == len(listed) and names(whole[i] for i in range(len(whole))) == names(listed)
    assert sum(n for *_, n in whole.metric_counts()) == len(whole)
    assert whole.metric_counts()[0][0] == pytest.approx(min(prefix.search.objective(np.arange(len(cases.x)), t) for t in listed))
    with pytest.raises(IndexError):
        whole[len(whole)]


EIGHT = [(0, 0, 0, 1.0, -3.0), (1, 0, 0, 1.0, -2.0), (2, 0, 1, 2.0, 2.0), (3, 0, 1, 2.0, 3.0), (0, 1, 0, 1.0, -1.5), (1, 1, 1, 1.0, 0.5), (2, 1, 0, 1.0, -0.5), (3, 1, 1, 1.0, 1.5)]


def eight(spark):
    return spark.createDataFrame(EIGHT, "f0 int, f1 int, y int, w double, t double")


def test_multiway_smoke(spark):
    got = multiway.fit(eight(spark), ["f0", "f1"], "y", "t", "w", multiway.Settings(4, 2, 0.02, 1, max_branching=4))
    assert got.lower <= got.objective + 1e-9 <= got.upper + 2e-9
    scored = trees.predict(eight(spark), got.tree).agg(F.sum(F.when(F.col("predicted") != F.col("y"), F.col("w")).otherwise(0.0))).first()[0]
    assert scored / 10 + 0.02 * trees.statistics(got.tree)["leaves"] == pytest.approx(got.objective)
    default = multiway.fit(eight(spark), ["f0", "f1"], "y", "t", settings=multiway.Settings(5))
    assert default.lookahead == 3
    with pytest.raises(ValueError, match="teacher_logit"):
        multiway.fit(eight(spark), ["f0", "f1"], "y")


def test_margin_equals_matrix(spark):
    df = eight(spark).withColumn("m", F.array(-F.col("t") / 2, F.col("t") / 2))
    s = multiway.Settings(3, 2, 0.01)
    a, b = multiway.fit(df, ["f0", "f1"], "y", "t", settings=s), multiway.fit(df, ["f0", "f1"], "y", "m", settings=s)
    assert trees.same(a.tree, b.tree)
    assert a.objective == pytest.approx(b.objective)
    assert df.select(softmax(F.col("m")).alias("p")).where("abs(p[0] + p[1] - 1) > 1e-12").count() == 0


@pytest.mark.parametrize("classes", [2, 3])
def test_scattered_groups_equal_brute_force(classes):
    """Up to ten bins, all partitions: two classes always reach the best, three nearly always."""
    rng, missed, tried = np.random.default_rng(classes), 0, 0
    for m in (2, 4, 7, 10):
        for _ in range(6):
            hard, rows = rng.integers(0, 6, (m, classes)).astype(float), rng.integers(1, 9, m).astype(float)
            for cost, slope in ((scatter.loss, scatter.loss_slope), (scatter.gini, scatter.gini_slope)):
                bins = scatter.Bins((hard,), rows, cost, slope, 1)
                for k in (2, 3):
                    start = multiway._intervals(bins, k) if m >= k else None
                    if start is None:
                        continue
                    best = min(bins.total(np.array(p), k) for p in itertools.product(range(k), repeat=m) if len(set(p)) == k)
                    got = scatter.best_groups(bins, start, k, multiway._intervals)
                    assert len(set(got)) == k and bins.total(got, k) >= best - 1e-9
                    missed, tried = missed + (bins.total(got, k) > best + 1e-9), tried + 1
    assert missed <= (0 if classes == 2 else tried // 20)


@pytest.mark.parametrize("m", [24, 25, 40, 400])
def test_scattered_groups_of_many_bins(spark, m):
    df = spark.range(m).selectExpr("cast(id as int) b", "cast(id % 2 as int) y", "0.0D t")
    got = multiway.fit(df, ["b"], "y", "t", settings=multiway.Settings(1, max_branching=2))
    assert got.objective == 0 and trees.statistics(got.tree)["non_contiguous"] == 2
    held = multiway.fit(df, ["b"], "y", "t", settings=multiway.Settings(1, max_branching=2, min_child=m // 2))
    assert held.objective == 0
    assert multiway.fit(df, ["b"], "y", "t", settings=multiway.Settings(1, max_branching=2, scatter_bins=10)).objective > 0.4


def test_a_move_that_costs_nothing_bridges():
    """Two ties between better places: neither a bin nor a stretch lowers the cost, one free move leads to fewer runs."""
    bins = scatter.Bins((np.array([[4.0, 0], [2, 2], [4, 0], [0, 4], [2, 2], [0, 4]]),), np.ones(6), scatter.loss, scatter.loss_slope, 1)
    got = scatter.refined(bins, [0, 1, 0, 1, 0, 1], 2)
    assert bins.total(got, 2) == pytest.approx(4) and scatter.run_count(got) == 2


def test_interval_program_and_refinement():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a = rng.integers(0, 6, (7, 2)).astype(float)
        c = np.concatenate([np.zeros((1, 2)), a.cumsum(0)])
        seg = c[None] - c[:, None]
        ok = np.arange(8)[None] > np.arange(8)[:, None]
        found = multiway.interval_partitions(np.where(ok, multiway.loss(np.where(ok[..., None], seg, 0)), 0), ok, 3)
        for g in (2, 3):
            def cost(group, a=a):
                return multiway.Solver._groups(list(group), a, multiway.loss)

            contiguous = min(cost(np.searchsorted(cuts, np.arange(7), side="right")) for cuts in itertools.combinations(range(1, 7), g - 1))
            assert found[g][0] == pytest.approx(contiguous)
            best = min(cost(p) for p in itertools.product(range(g), repeat=7) if len(set(p)) == g)
            bins = scatter.Bins((a,), np.ones(7), multiway.loss, scatter.loss_slope, 1)
            better = cost(scatter.best_groups(bins, found[g][1], g, multiway._intervals))
            assert best == pytest.approx(better)


def test_nominees_anchors_and_dominance():
    def nominee(score, family, ceiling, floor=0.0, feature=0, groups=2):
        return multiway.Nominee(score, groups, 0.0, family, ceiling, [0, 1], {"feature": feature, "groups": groups, "floor": floor})

    good, middle, loss = nominee(0.1, "impurity", 0.5), nominee(0.2, "impurity", 0.4, feature=1), nominee(0.9, "loss", 0.2)
    solver = multiway.Solver.__new__(multiway.Solver)
    solver.s = multiway.Settings()
    assert solver.shortlist([loss, middle, good], None, 1) == [good, loss]  # the anchors, whatever the budget
    assert solver.shortlist([loss, middle, good], None, 3) == [good, middle, loss]
    assert solver.shortlist([loss, middle, good], None, None) == [good]
    assert solver.shortlist([nominee(0.5, "loss", 0.3, 0.3), good], 1.0, 3)[0].ceiling == 0.3  # attains its floor: alone
    assert solver.shortlist([nominee(0.1, "loss", 0.9, 0.8), good], 0.5, 3) == [good]
    solver.s = multiway.Settings(drop_dominated=True)
    worse = nominee(0.2, "loss", 0.5)
    assert good.dominates(worse) and not good.dominates(loss) and not good.dominates(good)
    assert solver.shortlist([worse, good, middle], None, 3) == [good, middle]
    assert multiway.canonical([2, 0, 0, 2, 1]) == [0, 1, 1, 0, 2]


def test_boundaries_decide_ties():
    strength, bins = [0.0, 1.0, 0.0], np.arange(4)
    assert multiway.boundary_penalty([0, 0, 1, 1], bins, strength) == -1.0
    assert multiway.boundary_penalty([0, 1, 1, 0], bins, strength) == pytest.approx(1 / 3)  # leaps over three bins, cuts two of none
    ok = np.triu(np.ones((5, 5), bool), 1)
    bonus = np.array([0.0, 0.0, 1.0, 0.0])
    assert multiway.interval_partitions(np.zeros((5, 5)), ok, 2, bonus)[2][1] == [0, 0, 1, 1]


def test_linear_selector(spark):
    got = multiway.fit(eight(spark), ["f0", "f1"], "y", "t", "w", multiway.Settings(2, regularisation=0.02, max_branching=4, selector="linear"))
    scored = trees.predict(eight(spark), got.tree).agg(F.sum(F.when(F.col("predicted") != F.col("y"), F.col("w")).otherwise(0.0))).first()[0]
    assert scored / 10 + 0.02 * trees.statistics(got.tree)["leaves"] == pytest.approx(got.objective)
    assert trees.statistics(got.tree)["non_contiguous"] == 0
    forced = multiway.fit(eight(spark), ["f0", "f1"], "y", "t", "w", multiway.Settings(1, regularisation=9.0, selector="linear"))
    assert trees.statistics(forced.tree)["leaves"] > 1  # taken although a leaf costs less
    with pytest.raises(ValueError, match="selector"):
        multiway.fit(eight(spark), ["f0"], "y", "t", settings=multiway.Settings(selector="x"))


def test_feature_exchange_keeps_the_optimum():
    rng = np.random.default_rng(5)
    dropped = 0
    for turn in range(40):
        v = rng.integers(0, 5, (30, 2))
        x = np.unique(np.concatenate([v[:, [c]] >= np.arange(1, 5) for c in (0, 1)], 1).astype(int), axis=0)
        n = rng.integers(1, 6, (len(x), 2)).astype(float)
        w = n / n.sum()
        cases = exact.Cases([f"f{i}" for i in range(8)], [0, 1], x, n.sum(1).astype(int), w, w @ (1 - np.eye(2)))
        plain, less = (exact.Search(cases, exact.Settings(3, 0.02 + 0.002 * turn, feature_exchange=k)) for k in (False, True))
        rows = np.arange(len(x))
        assert less.solve(rows, 3)[0] == pytest.approx(plain.solve(rows, 3)[0])
        dropped += len(less.exchanged(rows, np.arange(8), 2))
    assert dropped


def test_neighbouring_bins_merge():
    assert binning.merge_by_plateau([(50, 50), (52, 48), (10, 90), (9, 91)]) == [(0, 1), (2, 3)]
    assert binning.merge_by_plateau([(50, 50), (50, 50)]) == [(0, 0), (1, 1)]  # two spans stay
    assert binning.merge_by_plateau([(90, 10), (50, 50), (10, 90)]) == [(0, 0), (1, 1), (2, 2)]
    assert binning.merge_by_confidence([(50, 50), (52, 48), (10, 90), (0, 0)]) == [(0, 1), (2, 2), (3, 3)]
    assert binning.merge_by_confidence([]) == binning.merge_by_plateau([]) == []


def test_bins_of_the_same_shares_merge(spark):
    hist = spark.createDataFrame([("f", 0, 1, 2), ("f", 1, 2, 4), ("f", 3, 3, 1), ("g", 0, 1, 2)], "feature string, bin int, n0 long, n1 long")
    assert sorted(map(tuple, binning.merge_proportional(hist).collect())) == [("f", 0, 0, 1, 3, 6), ("f", 1, 3, 3, 3, 1), ("g", 0, 0, 0, 1, 2)]
    merged = binning.merged_by(binning.merge_by_plateau, hist).collect()
    assert sorted(map(tuple, merged)) == [("f", 0, 0, 1, 3, 6), ("f", 1, 3, 3, 3, 1), ("g", 0, 0, 0, 1, 2)]


def test_boundary_tensors(spark):
    from coppice.plans import teacher

    rows = [(float(i % 7), float(i * 5 % 11), int(i % 7 + i * 5 % 11 > 8)) for i in range(77)]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    edges, reps = {"a": [2.0, 4.0], "b": [5.0]}, {"a": [1.0, 3.0, 5.0], "b": [2.0, 8.0]}
    t = teacher.fit(df, ["a", "b"], "y", trees=3, depth=2)
    priors = teacher.boundary_priors(t, edges)
    assert [p[:2] for p in priors] == [("a", 0), ("a", 1), ("b", 0)] and all(p[3] > 0 for p in priors if p[2] > 0)
    ready = binning.digitise(df, edges)
    got = teacher.boundary_tensors(t, ready, {"a": "a_bin", "b": "b_bin"}, reps)
    assert set(ready.columns) < set(got.columns)
    sample = got.limit(12).collect()
    for f in ("a", "b"):
        at = lambda r, k, f=f: {**{c: r[c] for c in ("a", "b")}, f: reps[f][k]} if 0 <= k < len(reps[f]) else None
        wanted = [(i, side, x) for i, r in enumerate(sample) for side in (-1, 0, 1) if (x := at(r, r[f"{f}_bin"] + side))]
        asked = spark.createDataFrame([(i, side, x["a"], x["b"]) for i, side, x in wanted], "i int, side int, a double, b double")
        margin = {(r["i"], r["side"]): r["m"] for r in t.logits(asked, "m").collect()}
        for i, r in enumerate(sample):
            low, mid, high = (margin.get((i, side)) for side in (-1, 0, 1))
            assert r[f"{f}_left_delta"] == pytest.approx(0 if low is None else mid - low)
            assert r[f"{f}_right_delta"] == pytest.approx(0 if high is None else high - mid)
            assert r[f"{f}_left_conf"] == pytest.approx(0 if low is None else (abs(mid) + abs(low)) / 2)
            assert r[f"{f}_right_conf"] == pytest.approx(0 if high is None else (abs(high) + abs(mid)) / 2)


def test_single_class(spark):
    df = frame(spark, [(i % 3, 1) for i in range(9)], ["f", "y"])
    with pytest.raises(ValueError, match="classes"):
        multiway.collapse(df, ["f"], "y", F.array(F.lit(0.5), F.lit(0.5)))
    assert isinstance(levelwise.grow(df, ["f"], "y"), trees.Leaf)
    assert exact.optimal(exact.collapse(df.withColumn("f", F.col("f") % 2), ["f"], "y")).tree.prediction == 1


def test_levelwise_kinds(spark):
    rows = [(b, c, int(b in (0, 3, 6))) for b in range(8) for c in range(2)] * 4
    df = frame(spark, rows, ["b", "c", "y"])
    shape = levelwise.grow(df, ["b", "c"], "y", levelwise.Settings(1, "shape", 2))
    assert trees.statistics(shape)["non_contiguous"] == 2
    assert df.where(trees.expression(shape) != F.col("y")).count() == 0
    binary = levelwise.grow(df, ["b", "c"], "y", levelwise.Settings(6))
    assert df.where(trees.expression(binary) != F.col("y")).count() == 0
    number = levelwise.grow(df.withColumn("v", F.col("b") * 10.0), ["b"], "v", levelwise.Settings(1, "multiway", 8, criterion="variance"))
    assert trees.statistics(number)["leaves"] == 8
    weak = levelwise.grow(df, ["c", "b"], "y", levelwise.Settings(1, "threshold"))
    better = levelwise.alternate(df, weak, ["b", "c"], "y", levelwise.Settings(1, "shape", 2))
    assert levelwise._errors(df, better, "y") <= levelwise._errors(df, weak, "y")


def test_tree_forms(spark):
    t = trees.Split("f", [[(0, 1), (6, 6)], [(3, 3)]], [trees.boolean("g", trees.Leaf(1), trees.Leaf(2), prediction=1), trees.Leaf(3)], prediction=9)
    rows = [(f, g) for f in (None, 0, 1, 2, 3, 4, 5, 6, 7) for g in (None, 0, 1)]
    df = frame(spark, rows, ["f", "g"])
    for depth in (None, 0, 1):
        want = sorted((str(f), str(g), trees.predict_one(t, {"f": f, "g": g}, depth)) for f, g in rows)
        for most in (200, 0):
            got = trees.predict(df, t, depth=depth, most=most).collect()
            assert sorted((str(r["f"]), str(r["g"]), r["predicted"]) for r in got) == want
    assert trees.same(trees.from_dict(trees.to_dict(t)), t)
    assert trees.statistics(t) == {"leaves": 3, "internal": 2, "depth": 2, "max_arity": 2, "non_contiguous": 1}
    assert len(trees.rules(t, {"f": [0.5, 1.5, 2.5, 3.5, 4.5, 5.5]})) == 3
    assert trees.node_table(spark, t).count() == 5
    twins = trees.Split("f", [[(0, 0)], [(1, 1)], [(2, 2)]], [trees.Leaf(1), trees.Leaf(1), trees.Leaf(2)], prediction=1)
    assert trees.merged(twins).branches == [[(0, 1)], [(2, 2)]]
    assert '"version": 1' in tables.artifact(t)


def test_binariser_document_example(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (0.0, 2.0), (1.0, 3.0)], "x double, z double")
    ts = binning.thresholds_of(df, ["x", "z"])
    assert ts == {"x": [0.5], "z": [0.5, 1.5, 2.5]}
    rows = binning.binarise(df, ts).drop("x", "z").collect()
    assert [tuple(r) for r in rows] == [(1, 1, 1, 1), (0, 0, 1, 1), (1, 0, 0, 1), (0, 0, 0, 0)]
    assert binning.merge_by_bic([(9, 1), (90, 10), (1, 99)]) == [(0, 1), (2, 2)]
    assert binning.merge_by_bic([(9, 1), (9, 1)]) == [(0, 0), (1, 1)]
    assert binning.encoder_predicates([1, 2], "rational") == [">= 1.5"]


def test_imputation_and_labels(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("inf",), (None,), ("2.5",)], "v string")
    assert sorted(r[0] for r in prep.impute_median(df, ["v"]).collect()) == [1.5, 2.0, 2.0, 2.0, 2.5]
    fit = spark.createDataFrame([("a",), ("b",), ("b",)], "c string")
    assert [r[0] for r in prep.impute_mode(spark.createDataFrame([("z",), (None,), ("a",)], "c string"), "c", fit).collect()].count("b") == 2
    codes = prep.label_codes(spark.createDataFrame([(10,), (9,), (100,)], "y int"), "y")
    assert {r["label"]: r["code"] for r in codes.collect()} == {10: 0, 100: 1, 9: 2}
    with pytest.raises(ValueError, match="classes"):
        prep.require_classes(fit.where("c = 'a'"), "c")
    assert prep.feature_dictionary(["c"], ["c__a", "c__b", "d"]) == {"c": ["c__a", "c__b"]}


def test_small_evaluations(spark):
    df = spark.createDataFrame([([1, 2], 1), ([3], 1)], "ls array<int>, p int")
    assert evaluate.any_label_accuracy(df, "ls", "p").first()[0] == 0.5
    w = evaluate.error_weights(spark.createDataFrame([(1, [3.0, 1.0, 2.0])], "i int, e array<double>"), "e").orderBy("rank").collect()
    assert [(r["branch"], r["weight"]) for r in w] == [(1, 2.0), (2, 1.0), (0, 0.0)]


def test_selection(spark):
    assert len(selection.grid(a=[1, 2], b=[3])) == 2
    assert selection.draws(3, 1, a=selection.whole(1, 2)) == selection.draws(3, 1, a=selection.whole(1, 2))
    df = frame(spark, [(i % 4, int(i % 4 > 1), i) for i in range(40)], ["b", "y", "k"])
    folded = prep.stratified_folds(df, "k", "y", 2)

    def fit(part, s):
        tree = levelwise.grow(part, ["b"], "y", levelwise.Settings(**s))
        return lambda held: trees.predict(held, tree)

    rows = selection.cross_validate(folded, [{"depth": 1}, {"depth": 2}], fit, "y", 2)
    assert all(r["accuracy"] == 1.0 for r in rows)
    assert selection.support(0.001, 100) == 2


def test_registry_and_store(spark, tmp_path):
    df = frame(spark, [(1, 0)], ["x", "y"]).withColumn("split", F.lit("fit"))
    r = tables.Registry([tables.Dataset("One", lambda s: df.drop("split"), aliases=("uno",))])
    assert r.load(spark, " UNO ")[1] == "y"
    with pytest.raises(KeyError):
        r.spec("two")
    tables.write_store(df, f"{tmp_path}/set_v2")
    assert tables.resolve_store(spark, str(tmp_path), "set_v3", ["x", "y"]).count() == 1
    with pytest.raises(FileNotFoundError):
        tables.resolve_store(spark, str(tmp_path), "set", ["z"])
    (tmp_path / "costs.csv").write_text("a,b\n0,2\n3,0\n")
    assert {(c["prediction"], c["truth"]): c["cost"] for c in tables.read_costs(spark, f"{tmp_path}/costs.csv", ["a", "b"]).collect()}[("b", "a")] == 3.0


def test_streaming(spark, tmp_path):
    from coppice.streaming import incremental

    rows = spark.createDataFrame([(i, i % 3, i % 2) for i in range(30)], "i int, b int, y int").withColumn("ts", F.timestamp_seconds(F.col("i") * 60))
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    tree = trees.Split("b", [[(0, 0)], [(1, 2)]], [trees.Leaf(0), trees.Leaf(1)], prediction=0)
    q = incremental.predict(stream, tree).writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(predicted) FROM scored").first()[0] == 20
    q = incremental.windowed_histogram(stream, "ts", ["b"], "y").writeStream.outputMode("complete").format("memory").queryName("hist").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM hist").first()[0] == 30


@pytest.mark.parametrize("objective", ["acc", "bacc", "f1"])
def test_imbalance_equals_brute_force(spark, objective):
    r = random.Random(11)
    x = [[r.randint(0, 1) for _ in range(3)] for _ in range(30)]
    y = [int(a and b or r.random() < 0.1) for a, b, _ in x]
    cases = exact.collapse(frame(spark, [(*a, b) for a, b in zip(x, y, strict=True)], [*BITS, "y"]), BITS, "y")
    p, n = sum(y) / 30, 1 - sum(y) / 30

    def confusions(rows, depth):
        for label in (0, 1):
            yield sum(label == 1 and y[i] == 0 for i in rows), sum(label == 0 and y[i] == 1 for i in rows), 1
        if depth:
            for f in range(3):
                on, off = [i for i in rows if x[i][f]], [i for i in rows if not x[i][f]]
                if on and off:
                    for a, b in itertools.product(list(confusions(on, depth - 1)), list(confusions(off, depth - 1))):
                        yield a[0] + b[0], a[1] + b[1], a[2] + b[2]

    loss = imbalance.LOSSES[objective]
    best = min(loss(fp / 30, fn / 30, p, n) + 0.01 * k for fp, fn, k in confusions(range(30), 2))
    value, tree = imbalance.optimal(cases, exact.Settings(2, 0.01), objective)
    assert value == pytest.approx(best)
    got = [trees.predict_one(tree, dict(zip(BITS, row, strict=True))) for row in x]
    fp, fn = sum(g > t for g, t in zip(got, y, strict=True)) / 30, sum(g < t for g, t in zip(got, y, strict=True)) / 30
    assert loss(fp, fn, p, n) + 0.01 * trees.statistics(tree)["leaves"] == pytest.approx(best)


def test_areas_and_proposals(spark):
    assert imbalance.leaf_area([(3, 0), (1, 2), (0, 2)]) == pytest.approx(0.9375)
    rows = [(a, b, int(a ^ b)) for a in (0, 1) for b in (0, 1)] * 3 + [(1, 0, 0)]
    cases = exact.collapse(frame(spark, rows, ["a", "b", "y"]), ["a", "b"], "y")
    models = rashomon.ModelSet(cases, exact.Settings(2, 0.08), adder=0.3)
    value, tree = imbalance.best_area(models)
    assert value <= 1 and trees.statistics(tree)["leaves"] >= 1
    one, all_ = (exact.optimal(cases, exact.Settings(2, 0.08, proposals=k)).objective for k in (1, None))
    assert all_ <= one + 1e-12


def test_pair_features(spark):
    df = frame(spark, [(a, b, int((a + b) % 2)) for a in range(4) for b in range(4)] * 2, ["a", "b", "y"])
    wide, names = levelwise.with_pairs(df, [("a", "b")], {"a": 4, "b": 4})
    tree = levelwise.grow(wide, ["a", "b", *names], "y", levelwise.Settings(1, "shape", 2))
    assert tree.feature == "a_x_b"
    assert trees.predict(wide.withColumnRenamed("a_x_b", "pair"), trees.Split("pair", tree.branches, tree.children, tree.prediction)).where("predicted <> y").count() == 0


def test_class_cuts_refine_to_the_row(spark):
    from coppice.operators import prep

    rows = [(i, "ab"[i % 3 == 0]) for i in range(3000)] + [(None, "a"), (7, None), (8, None), (9, "one")]
    df = spark.createDataFrame(rows, "k long, l string")
    want = {}
    for label in ("a", "b", "one", None):
        import hashlib

        own = sorted((hashlib.md5(f"5:{k}".encode()).hexdigest() if k is not None else "-", k or 0) for k, l in rows if l == label)
        n = len(own)
        t, v = int(n * 0.2 + 0.5), int(n * 0.1 + 0.5)
        want |= {(k if h != "-" else None, label): "test" if i < t else "val" if i < t + v else "fit" for i, (h, k) in enumerate(own)}
    got = prep.stratified_split(df, "k", "l", seed=5).collect()
    assert {(r["k"], r["l"]): r["split"] for r in got} == want and len(got) == len(rows)
    hashed = df.select(F.col("l").alias("_l"), F.coalesce(prep.hashed(F.col("k"), 5), F.lit("-")).alias("_h"), F.col("k").alias("_k"))
    both = [prep.class_cuts(hashed, lambda n: [n // 5, n // 2, 0], digits=d, most=m) for d, m in ((3, 10_000), (1, 3), (2, 0))]
    assert both[0] == both[1] == both[2]


def test_nodes_of_more_than_ten_branches(spark):
    rows = [(b, c, (b * 7 + c) % 3) for b in range(12) for c in range(4) for _ in range(3)]
    df = spark.createDataFrame(rows, "a int, b int, y int")
    wide = trees.Split("a", [[(i, i)] for i in range(12)], [trees.Leaf(i) for i in range(12)], prediction=0)
    tree = levelwise._replaced(wide, "11", trees.Split("b", [[(0, 1)], [(2, 3)]], [trees.Leaf(100), trees.Leaf(101)], prediction=0))
    got = {(r["a"], r["b"]): r["p"] for r in df.select("a", "b", trees.expression(tree, "path").alias("p")).distinct().collect()}
    assert got[11, 0] == "11.0" and got[11, 3] == "11.1" and got[1, 0] == "1" and got[10, 2] == "10"
    assert levelwise._paths(tree) == ["", "11"] and levelwise._at(tree, "11").feature == "b"
    with pytest.raises(ValueError):
        levelwise.grow(df, ["a"], "y", levelwise.Settings(branches=1))
    full = levelwise.grow(df, ["a", "b"], "y", levelwise.Settings(2, "multiway", 12))
    few = levelwise.grow_best_first(df, ["a", "b"], "y", levelwise.Settings(4, "multiway", 3), leaves=5)
    assert trees.statistics(few)["leaves"] <= 5 and trees.statistics(full)["max_arity"] > 2


def test_summaries_of_trees():
    inner = trees.Split("a", [[(0, 2)], [(3, 9)]], [trees.Leaf(1), trees.Leaf(2)], prediction=1)
    tree = trees.Split("a", [[(0, 4)], [(5, 9)]], [inner, trees.boolean("b", trees.Leaf(3), trees.Leaf(4), prediction=3)], prediction=1)
    flat = trees.summarised(tree)
    assert flat.branches == [[(0, 2)], [(3, 4)], [(5, 9)]] and len(flat.children) == 3
    assert all(trees.predict_one(tree, {"a": a, "b": b}) == trees.predict_one(flat, {"a": a, "b": b}) for a in range(10) for b in (0, 1))
    groups = trees.leaf_groups(tree)
    assert [g for g, _ in groups] == [{"a": [(0, 2)]}, {"a": [(3, 4)]}, {"a": [(5, 9)], "b": [(1, 1)]}, {"a": [(5, 9)], "b": [(0, 0)]}]
    text = trees.latex(tree)
    assert text.startswith("\\begin{forest}\n[{a}") and text.count("[{") == 7 and "$\\le$" in text


def test_parzen_search_beats_its_start():
    from coppice.plans import selection as sel

    def score(s):
        if s["kind"] == "bad":
            raise ValueError
        return -abs(s["n"] - 37) / 100 - abs(s["rate"] - 0.003) * 10

    done = sel.parzen_search(score, 60, seed=1, n=sel.whole(0, 100), rate=sel.log_uniform(1e-5, 1.0, zero=0.1), kind=sel.one_of("good", "bad"))
    assert len(done) == 60 and all(v == -1.0 for v, s in done if s["kind"] == "bad")
    assert sum(v for v, _ in done[40:]) / 20 > sum(v for v, _ in done[:10]) / 10
    assert sel.feature_sparsity(["a", "a"], ["a", "b"]) == 0.5


def test_rows_beside_need_both_sides(spark):
    from coppice.operators import prep

    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "r int, p string"), spark.createDataFrame([(1, "z")], "r int, q string")
    with pytest.raises(Exception, match="missing on one side"):
        prep.beside(a, b, "r").collect()
    assert prep.beside(a.where("r = 1"), b, "r").collect() == [(1, "x", "z")]
    got = spark.createDataFrame([("12",), ("-3",), ("1.5",), ("2e3",), ("x",), (None,), ("1.x",)], "t string").select(prep.numeric_token(F.col("t")).alias("v")).select("v.*").collect()
    assert [tuple(r) for r in got] == [(12, None), (-3, None), (None, 1.5), (None, 2000.0), (None, None), (None, None), (None, None)]


def test_bounds_of_proposals():
    x = np.array([[i >> j & 1 for j in range(4)] for i in range(16)])
    w = np.zeros((16, 2))
    w[np.arange(16), x[:, :2].sum(1) % 2] = 1 / 16
    cases = exact.Cases(list("abcd"), [0, 1], x, np.ones(16, int), w, w[:, ::-1].copy())
    got = exact.optimal(cases, exact.Settings(3, 0.001, allow_small=True, proposals=1))
    best = exact.optimal(cases, exact.Settings(3, 0.001, allow_small=True))
    assert (got.status, best.status) == ("proposals", "optimal") and got.lower <= best.objective <= got.objective


def test_decision_process_lies_between_greedy_and_optimal():
    r = random.Random(3)
    for _ in range(20):
        x = np.array([[i >> j & 1 for j in range(4)] for i in range(16)])
        w = np.array([[r.random(), r.random()] for _ in range(16)])
        w /= w.sum()
        cases = exact.Cases(list("abcd"), [0, 1], x, np.ones(16, int), w, w[:, ::-1].copy())
        s = exact.Settings(3, 0.004, allow_small=True)
        low, mid, high = exact.optimal(cases, s).objective, exact.over_proposals(cases, s), exact.greedy(cases, s).objective
        assert low - 1e-9 <= mid.objective <= high + 1e-9 and mid.objective == pytest.approx(exact.Search(cases, s).objective(np.arange(16), mid.tree))
        front = exact.pareto(cases, s, [0.0, 0.001, 0.01, 0.1])
        assert [n for n, *_ in front] == sorted({n for n, *_ in front}) and [x for _, x, _ in front] == sorted((x for _, x, _ in front), reverse=True)


def test_means_group_bins_of_several_targets(spark):
    centre = {0: (0, 0), 1: (9, 9), 2: (0, 9), 3: (9, 9), 4: (0, 0), 5: (0, 9)}
    rows = [(b, float(u + i % 2), float(v - i % 3)) for b, (u, v) in centre.items() for i in range(6)]
    df = spark.createDataFrame(rows, "b int, u double, v double")
    tree = levelwise.grow(df, ["b"], ["u", "v"], levelwise.Settings(1, "kmeans", 3, criterion="variance"))
    groups = sorted(sorted(b for lo, hi in s for b in range(lo, hi + 1)) for s in tree.branches)
    assert groups == [[0, 4], [1, 3], [2, 5]]
    assert trees.predict(df, tree).where("b = 0").first()["predicted"] == [0.5, -1.0]


def test_columns_that_tell_nothing_go(spark):
    from coppice.plans import teacher

    r = random.Random(2)
    rows = [(a, b, r.randrange(2), a & b) for a in (0, 1) for b in (0, 1) for _ in range(40)]
    kept, score = teacher.eliminate_columns(frame(spark, rows, ["a", "b", "noise", "y"]), ["a", "b", "noise"], "y", trees=3, depth=2)
    assert kept == ["a", "b"] and score == 1.0


def test_timing_drawing_and_zip(spark, tmp_path):
    import zipfile

    assert selection.timed(lambda: None).steady
    waits = iter([0, 0.0, 0.3])
    import time as clock

    assert not selection.timed(lambda: clock.sleep(next(waits)), absolute=0.01).steady
    tree = trees.Split("a<b", [[(0, 1)], [(2, 3)]], [trees.Leaf("x&y"), trees.boolean("c", trees.Leaf(1), trees.Leaf(0))], prediction=0)
    drawn = trees.svg(tree)
    assert drawn.count("<rect") == 5 and drawn.count("<line") == 4 and "a&lt;b" in drawn and "x&amp;y" in drawn
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("d/train.txt", "1,2.5,A\n2,3.5,B\n")
        z.writestr("d/test.txt", "3,4.5,A\r\n\r\n")
        z.writestr("readme.md", "no,rows,here\n")
    got = tables.read_zip(spark, f"{tmp_path}/d.zip", r"(train|test)\.txt$", "f1 int, f2 double, label string")
    assert sorted((r["member"], r["f1"], r["f2"], r["label"]) for r in got.collect()) == [("d/test.txt", 3, 4.5, "A"), ("d/train.txt", 1, 2.5, "A"), ("d/train.txt", 2, 3.5, "B")]


def test_thresholds_that_share_six_digits_stay_apart(spark):
    df = spark.createDataFrame([(1, 123456.0), (2, 123456.2), (3, 123456.4), (4, 1e15), (5, None)], "i int, v double")
    ts = binning.thresholds_of(df, ["v"])
    wide = binning.binarise(df, ts)
    assert len(wide.columns) == 5 and binning.feature_map(ts)[binning.column_of("v", ts["v"][0])] == ("v", ts["v"][0])
    back = binning.unbinarise(wide.drop("v").where("i < 5"), "v", [123456.0, 123456.2, 123456.4, 1e15], ts["v"], "back")
    assert {r["i"]: r["back"] for r in back.collect()} == {1: 123456.0, 2: 123456.2, 3: 123456.4, 4: 1e15}
    assert "123456.1" in trees.condition("v", [(0, 0)], [123456.1])


def test_null_has_no_bin(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (0.5,), (2.0,)], "v double")
    assert [r["v_bin"] for r in binning.digitise(df, {"v": [1.0, 2.0]}).collect()] == [None, 2, 0, 2]
    assert [r["v_bin"] for r in binning.digitise(df, {"v": []}).collect()] == [None, 0, 0, 0]


@pytest.mark.parametrize("values", [([0.5, 1.0], [2.0, -1.0], [3.0, 3.0]), (True, False, True), (1 << 40, 2, 3), ("a", "b", None), (1.5, 2, 3), (1, 2, 3)])
def test_walked_predictions_equal_the_expression(spark, values):
    tree = trees.Split("b", [[(0, 1)], [(2, 5)]], [trees.Leaf(values[0]), trees.Leaf(values[1])], values[2])
    df = spark.createDataFrame([(i if i < 6 else None, i, "x") for i in range(8)], "b int, _n int, _bins string")
    one, two = trees.predict(df, tree), trees.predict(df, tree, most=1)
    assert one.columns == two.columns and sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_one_deadline_for_all_lookaheads(spark):
    r = random.Random(1)
    cases = exact.collapse(frame(spark, [tuple(r.randint(0, 1) for _ in range(7)) for _ in range(80)], [*"abcdef", "y"]), list("abcdef"), "y")
    for f in (exact.optimal, exact.lookahead, exact.recursive_lookahead):
        assert f(cases, exact.Settings(3, 0.001, True, seconds=0.0)).status == "timeout"
    assert exact.recursive_lookahead(cases, exact.Settings(3, 0.001, True)).status == "done"


def test_order_statistics_equal_sorting(spark):
    rng, inf, nan = np.random.default_rng(5), math.inf, math.nan
    columns = {
        "normal": rng.normal(size=4000), "ties": rng.integers(0, 3, 4000).astype(float), "hot": np.where(rng.random(4000) < 0.6, 7.25, rng.normal(size=4000) * 1e-9),
        "wide": 10.0 ** rng.uniform(-300, 300, 4000) * rng.choice([-1, 1], 4000), "odd": rng.choice([nan, inf, -inf, 0.0, 1.5], 4000), "one": np.full(4000, 2.0), "ends": rng.choice([-1.7e308, 1.7e308], 4000),
    }
    df = spark.createDataFrame([tuple(None if i % 7 == 0 else float(v[i]) for v in columns.values()) for i in range(4000)], ", ".join(f"{c} double" for c in columns)).repartition(3)
    for pieces, most in ((4096, 2000), (8, 5)):
        got = ranks.order_statistics(df, {c: F.col(c) for c in columns}, lambda n: [0, n - 1, *ranks.quantile_ranks(n, [0.1, 0.5, 0.77])], pieces, most)
        for c, v in columns.items():
            want = np.sort(np.array([x for i, x in enumerate(v) if i % 7]))
            assert got[c].n == len(want) and all(got[c].values[r] == want[r] or np.isnan(want[r]) for r in got[c].values), c
            assert got[c].between == bool(np.isnan(want).any() or ((want > want[0]) & (want < want[-1])).any()), c
        assert got["normal"].quantile(0.77) == pytest.approx(np.percentile([x for i, x in enumerate(columns["normal"]) if i % 7], 77))
    none = ranks.order_statistics(df.where("false"), {"one": F.col("one")}, lambda n: ranks.quantile_ranks(n, [0.5]))["one"]
    assert none.n == 0 and none.quantile(0.5) is None and none.low is None


def test_edges_of_odd_columns(spark):
    df = spark.createDataFrame([(1.0, None, 5.0), (2.0, None, 5.0), (2.0, None, 5.0)], "two double, none double, one double")
    for exact_ in (True, False):
        assert {r["feature"]: r["edges"] for r in binning.quantile_edges(df, ["two", "none", "one"], 4, exact=exact_).collect()} == {"two": [1.5], "none": None if not exact_ else [], "one": []}


@pytest.mark.parametrize("seed", range(4))
def test_bounded_search_equals_the_optimum_and_its_bounds_hold(spark, seed):
    cases, s = noisy(spark, 5, 120, seed), exact.Settings(3, 0.01)
    want, got = exact.optimal(cases, s), bounded.optimal(cases, s)
    assert got.status == "optimal" and got.objective == pytest.approx(want.objective) and got.lower == got.objective
    assert exact.Search(cases, s).objective(np.arange(len(cases.x)), got.tree) == pytest.approx(want.objective)
    gaps = []
    for n in range(0, got.more["expanded"], max(1, got.more["expanded"] // 12)):
        part = bounded.optimal(cases, s, most=n)
        assert part.lower <= want.objective + 1e-9 <= part.objective + 2e-9 and part.status == "timeout"
        assert exact.Search(cases, s).objective(np.arange(len(cases.x)), part.tree) <= part.objective + 1e-9
        gaps.append(part.objective - part.lower)
    assert gaps == sorted(gaps, reverse=True) and (not gaps or gaps[0] > 0)
    assert bounded.optimal(cases, exact.Settings(3, 0.01, seconds=0.0)).status == "timeout"


def test_label_joins_leave_rows_where_they_are(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        df = spark.range(1000).selectExpr("id", "cast(id % 3 as string) l").repartition(4)
        plan = prep.encode_labels(df, "l")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        assert prep.encode_labels(df, "l").where("code = cast(l as int)").count() == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("most", [1.0, 0.3])
def test_best_area_equals_brute_force(spark, most):
    for seed in range(3):
        cases = noisy(spark, 4, 60, seed)
        s = exact.Search(cases, exact.Settings(2, 0.01))
        n, p = cases.w.sum(0)

        def every(rows, depth, s=s, cases=cases):
            yield [tuple(cases.w[rows].sum(0))]
            for f in np.flatnonzero(s.gains(rows) > -np.inf) if depth else ():
                a, b = s.halves(rows, int(f))
                for x, y in itertools.product(every(a, depth - 1), every(b, depth - 1)):
                    yield x + y

        def area(leaves, n=n, p=p):
            x = y = total = 0.0
            for a, b in sorted(leaves, key=lambda q: -q[1] / (q[0] + q[1])):
                w = max(0.0, min(most, (x + a) / n) - min(most, x / n))
                total += w * (y / p + (w * n / a * b / p / 2 if a else 0))
                x, y = x + a, y + b
            return total / most

        want = min(1 - area(t) + 0.01 * len(t) for t in every(np.arange(len(cases.x)), 2))
        value, tree = imbalance.optimal_area(cases, exact.Settings(2, 0.01), most)
        assert value == pytest.approx(want)
        assert trees.statistics(tree)["depth"] <= 2


def test_row_sets_equal_python_sets(spark):
    r = random.Random(2)
    rows = [(r.choice([None, r.randint(0, 500)]), r.random() < 0.4, r.choice([True, False, None])) for _ in range(600)]
    df = spark.createDataFrame(rows, "k long, a boolean, b boolean")
    one, two = {k for k, a, _ in rows if a and k is not None}, {k for k, _, b in rows if b and k is not None}
    a, b = rowsets.rowset(df, F.col("a"), F.col("k")), rowsets.rowset(df, F.col("b"), F.col("k"))
    for f, want in ((rowsets.union, one | two), (rowsets.intersection, one & two), (rowsets.difference, one - two), (rowsets.symmetric_difference, one ^ two)):
        got = f(a, b)
        assert {x[0] for x in rowsets.members(got).collect()} == want and rowsets.size(got).first()[0] == len(want)
    assert rowsets.same(a, rowsets.union(a, rowsets.intersection(a, b))) and not rowsets.same(a, b)
    assert rowsets.fingerprint(a) == rowsets.fingerprint(a.repartition(3)) != rowsets.fingerprint(b)
    none = rowsets.rowset(df.where("false"), F.col("a"), F.col("k"))
    assert rowsets.size(none).first()[0] == 0 and rowsets.same(rowsets.difference(a, a), none) and rowsets.fingerprint(none) == 0
    sets = rowsets.rowsets(df, {"a": F.col("a"), "b": F.col("b")}, F.col("k"))
    assert {(x["one"], x["two"]): x["both"] for x in rowsets.crossed(sets, ["a", "b"]).collect()} == {("a", "a"): len(one), ("a", "b"): len(one & two), ("b", "b"): len(two)}


@pytest.mark.parametrize("seed", range(2))
def test_model_sets_are_stored_and_merged(spark, seed, tmp_path):
    cases = noisy(spark, 3, 40, seed)
    narrow, wide = (rashomon.ModelSet(cases, exact.Settings(2, 0.02), adder=a) for a in (0.03, 0.15))
    one, two = modelstore.stored(narrow), modelstore.stored(wide)
    names = lambda m: sorted(rashomon.keys(m[i], cases.features, cases.classes) for i in range(len(m)))
    assert names(one) == names(narrow) and names(two) == names(wide) and len(one) < len(two)
    for merged in (one.union(two), two.union(one), two.union(two)):
        assert names(merged) == names(wide) and merged.metric_counts() == two.metric_counts()
    for name, t in zip(("keys", "ways"), two.tables(spark), strict=True):
        t.write.parquet(f"{tmp_path}/{name}")
    keys, ways = (spark.read.parquet(f"{tmp_path}/{x}") for x in ("keys", "ways"))
    back = modelstore.read(keys, ways, cases.features, cases.classes, narrow.search.reg)
    assert names(back) == names(wide) and back.ways == two.ways and back.roots == two.roots
    with pytest.raises(ValueError, match="more than 3 ways"):
        modelstore.read(keys, ways, cases.features, cases.classes, narrow.search.reg, most=3)
    with pytest.raises(ValueError, match="do not merge"):
        one.union(modelstore.stored(rashomon.ModelSet(cases, exact.Settings(2, 0.05), adder=0.1)))
    with pytest.raises(IndexError):
        two[len(two)]


def test_labels_are_collected_up_to_a_stated_number(spark):
    df = spark.range(30).selectExpr("cast(id as string) l", "id v")
    assert prep.distinct_values(df, "l")[:3] == ["0", "1", "10"] and len(prep.distinct_values(df, "l", 30)) == 30
    for f in (prep.distinct_values, prep.categories):
        with pytest.raises(ValueError, match="more than 29"):
            f(df, "l", most=29)
