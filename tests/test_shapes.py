"""Inner trees, pairs by priority and refits by level against plain versions."""

import itertools
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from coppice import queries
from coppice.plans import levelwise, shapes, trees


def frame(spark, rows, names):
    return spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names))


def plain_leaves(values, stats, depth):
    """Runs of one feature's bins by a greedy tree, as lists of bins."""
    mass = lambda i: float(levelwise.impurity(stats[i].sum(0), "gini"))
    own = list(range(len(values)))
    if depth:
        cuts = [(mass(own[:j]) + mass(own[j:]), j) for j in range(1, len(own))]
        if cuts and min(cuts)[0] < mass(own) - 1e-12:
            j = min(cuts)[1]
            return plain_leaves(values[:j], stats[:j], depth - 1) + plain_leaves(values[j:], stats[j:], depth - 1)
    return [list(values)]


@pytest.mark.parametrize("seed", range(12))
def test_inner_tree_mapped_to_branches(seed):
    r = np.random.default_rng(seed)
    stats = r.integers(0, 30, (9, 2)).astype(float) + 1
    bins = np.arange(9) * 2
    s = levelwise.Settings(1, "inner", 3, penalty=0.001, inner_depth=2)
    got = levelwise.best_split(bins, stats, s, stats.sum())
    leaves = plain_leaves(bins.tolist(), stats, 2)
    at = {b: i for i, b in enumerate(bins)}
    want = np.inf
    for branch in itertools.product(range(3), repeat=len(leaves)):
        groups = [[at[b] for l, g in zip(leaves, branch, strict=True) if g == k for b in l] for k in range(3)]
        used = [g for g in groups if g]
        if len(used) > 1:
            want = min(want, sum(float(levelwise.impurity(stats[g].sum(0), "gini")) for g in used) + 0.001 * stats.sum() * (len(used) - 1))
    assert got[0] == pytest.approx(want)
    for leaf in leaves:  # a leaf goes to one branch as a whole
        assert sum(bool(set(leaf) & set(g)) for g in got[1]) == 1


def test_inner_tree_levels_and_odd_rows(spark):
    rows = [(b, c, int(b in (2, 3, 6, 7) or c > 2)) for b in range(10) for c in range(4) for _ in range(2)] + [(None, 1, 1), (1, None, 0)]
    df = frame(spark, rows, ["b", "c", "y"])
    t = levelwise.grow(df, ["b", "c"], "y", levelwise.Settings(2, "inner", 2, inner_depth=4))
    assert df.where("b is not null and c is not null").where(trees.expression(t) != F.col("y")).count() == 0
    assert trees.statistics(t)["non_contiguous"] > 0
    number = levelwise.grow(df.withColumn("v", F.when(F.col("b").isin(1, 2, 8), 5.0).otherwise(1.0)), ["b"], "v", levelwise.Settings(1, "inner", 2, criterion="variance", inner_depth=4))
    assert sorted(c.prediction for c in number.children) == [1.0, 5.0]


def pair_rows(seed, n=400):
    """Six features, four of them nearly always 0, and a label by two of them."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        a, b = r.randrange(4), r.randrange(3)
        rare = [int(r.random() < 0.02) for _ in range(4)]
        out.append((a, b, *rare, int((a % 2) ^ (b > 0)) if r.random() < 0.95 else r.randrange(2)))
    return out


@pytest.mark.parametrize(("kind", "criterion", "seed"), [("inner", "gini", 0), ("inner", "entropy", 1), ("shape", "gini", 2)])
def test_best_pair_is_that_of_all_pairs(spark, kind, criterion, seed):
    names = ["a", "b", "p", "q", "u", "v"]
    df = frame(spark, pair_rows(seed), [*names, "y"]).cache()
    sizes = dict(zip(names, (4, 3, 2, 2, 2, 2), strict=True))
    s = levelwise.Settings(1, kind, 2, criterion=criterion, inner_depth=3, penalty=0.001)
    got = shapes.best_pair(df, names, "y", sizes, s, pair_penalty=0.001, batch=1)
    every = shapes.best_pair(df, names, "y", sizes, s, pair_penalty=0.001, batch=15)
    assert every.asked == 15
    assert got.asked < 8
    assert (got.features, got.groups) == (every.features, every.groups) == (("a", "b"), got.groups)
    assert got.cost == pytest.approx(every.cost)
    cell = F.col("a") * 3 + F.col("b")
    branch = F.when(cell.isin(got.groups[0]), 0).otherwise(1)
    counts = np.zeros((2, 2))
    for b, y, n in df.groupBy(branch.alias("g"), "y").count().collect():
        counts[b, y] = n
    assert got.cost == pytest.approx(float(levelwise.impurity(counts, criterion).sum()) + 0.002 * df.count())
    df.unpersist()


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("criterion", ["gini", "entropy"])
@pytest.mark.parametrize("classes", [2, 3])
def test_pair_bound_holds(seed, criterion, classes):
    r = np.random.default_rng(seed)
    s = levelwise.Settings(criterion=criterion)
    shares = r.dirichlet(np.full(6, 0.4)).reshape(3, 2)
    cells = np.stack([r.multinomial(int(200 * p) + 1, r.dirichlet(np.full(classes, 0.5))) for p in shares.ravel()]).reshape(3, 2, classes).astype(float)
    bound = shapes.pair_bound(cells.sum(1), cells.sum(0), cells.sum(), s)
    assert bound <= float(levelwise.impurity(cells.reshape(6, classes), criterion).sum()) + 1e-9


def test_best_pair_of_nothing(spark):
    df = frame(spark, [(0, 0, 1)] * 4 + [(None, 0, 1)], ["a", "b", "y"])
    assert shapes.best_pair(df, ["a", "b"], "y", {"a": 1, "b": 1}) is None


def line_items(kind):
    """Quantity, discount, tax and status of rows that the query of pairs has met in no sample table."""
    r = random.Random(kind)
    rows = [(r.choice([1.0, 11.0, 21.0]), r.randrange(4), r.randrange(3)) for _ in range(120)]
    if kind == "no gain":  # a cut lowers the impurity by less than its penalty
        return [(q, d, 0, "OF"[i % 2]) for d, n in ((0, 400), (1, 404)) for q in (1.0, 11.0) for i in range(n + (d and q == 1.0))]
    if kind == "no cut of one feature lowers anything":
        return [(1.0, d, t, "OF"[(d + t) % 2]) for d in range(4) for t in range(4)]
    if kind == "equal shares":
        return [(q, d, t, x) for q, d, t in rows for x in "OFF"]
    if kind == "one status":
        return [(*x, "F") for x in rows]
    if kind == "nulls":
        return [(None if i % 7 == 0 else q, None if i % 5 == 0 else d, t, (None, "O", "F")[(i + d) % 3]) for i, (q, d, t) in enumerate(rows)]
    if kind == "bins beyond the sizes":
        return [(-8.0, d, t, "FO"[d == 0 and t > 0]) for d in (0, 1) for t in (-1, 0, 8, 9) for _ in range(5)]
    return [(1.0, 0, 0, "O"), (1.0, 0, 0, "F")]  # one cell: no split


KINDS = ["no gain", "no cut of one feature lowers anything", "equal shares", "one status", "nulls", "bins beyond the sizes", "one cell"]


@pytest.mark.parametrize("kind", KINDS)
def test_pair_priority_split_equals_sql_on_odd_rows(spark, tmp_path, kind):
    db = duckdb.connect()
    db.execute("CREATE TABLE lineitem (l_quantity DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_linestatus VARCHAR)")
    db.executemany("INSERT INTO lineitem VALUES (?, ? / 100.0, ? / 100.0, ?)", line_items(kind))
    db.execute(f"COPY lineitem TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    want = db.execute(queries.SQL["pair_priority_split"]).fetchall()
    assert len(want) == (kind != "one cell")
    got = queries.QUERIES["pair_priority_split"](spark, str(tmp_path)).collect()
    assert [tuple(x) for x in got] == want


def test_pair_priority_split_equals_sql_where_penalties_outweigh_all_gains(spark):
    sf = "/root/testdata/sf0.1"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{sf}/lineitem.parquet')")
    got = queries.QUERIES["pair_priority_split"](spark, sf).collect()
    assert [tuple(x) for x in got] == db.execute(queries.SQL["pair_priority_split"]).fetchall()


@pytest.mark.parametrize("criterion", ["gini", "entropy", "variance"])
def test_best_pair_without_gain_is_that_of_all_groupings(spark, criterion):
    r = random.Random(criterion)
    rows = [(r.randrange(3), r.randrange(2), r.randrange(2), r.randrange(2 if criterion != "variance" else 9)) for _ in range(60)]
    names, sizes = ["a", "b", "c"], {"a": 3, "b": 2, "c": 2}
    s = levelwise.Settings(1, "inner", 2, penalty=10.0, criterion=criterion)  # the penalty outweighs any split
    df = frame(spark, rows, [*names, "y"])
    assert shapes.best_pair(df, names, "y", sizes, s, pair_penalty=0.01) is None
    got = shapes.best_pair(df, names, "y", sizes, s, pair_penalty=0.01, batch=1, gain=False)
    mass = lambda ys: float(levelwise.impurity(np.array([len(ys), sum(ys), sum(y * y for y in ys)] if criterion == "variance" else [ys.count(0), ys.count(1)], float), criterion))
    want = np.inf
    for k in (1, 2):
        for at in itertools.combinations(range(3), k):
            cells = sorted({tuple(x[i] for i in at) for x in rows})
            for side in itertools.product((0, 1), repeat=len(cells)):
                if len(set(side)) == 2:
                    branch = dict(zip(cells, side, strict=True))
                    parts = [[x[3] for x in rows if branch[tuple(x[i] for i in at)] == g] for g in (0, 1)]
                    want = min(want, sum(map(mass, parts)) + (10.0 + 0.01 * (k - 1)) * len(rows))
    assert got.cost == pytest.approx(want)


def test_best_pair_without_gain_is_of_two_classes(spark):
    df = frame(spark, [(0, 0, 0), (1, 0, 1), (0, 1, 2)], ["a", "b", "y"])
    with pytest.raises(ValueError, match="in two only"):
        shapes.best_pair(df, ["a", "b"], "y", {"a": 2, "b": 2}, levelwise.Settings(1, "inner", 2), gain=False)


@pytest.mark.parametrize("seed", [2])
def test_levels_refit_as_single_nodes_do(spark, monkeypatch, seed):
    r = random.Random(seed)
    rows = []
    for _ in range(300):
        a, b, c = r.randrange(6), r.randrange(5), r.randrange(4)
        y = int((a in (1, 4)) ^ (b > 2)) if r.random() < 0.9 else c % 2
        rows.append((None if r.random() < 0.03 else a, b, None if r.random() < 0.03 else c, y))
    df = frame(spark, rows, ["a", "b", "c", "y"]).coalesce(1).cache()
    leaf = lambda p: trees.Leaf(p)
    low = lambda f, top, x, z: trees.Split(f, [[(0, top)], [(top + 1, 9)]], [x, z], prediction=0)
    start = low("c", 1, low("a", r.randrange(4), leaf(0), leaf(1)), low("b", 1, low("a", 2, leaf(1), leaf(0)), leaf(1)))
    s = levelwise.Settings(1, "shape", 2)
    jobs = []  # a job at least for each tree grown and each count of errors
    for name in ("grow", "_errors"):
        own = getattr(levelwise, name)
        monkeypatch.setattr(levelwise, name, lambda *a, _own=own, **k: jobs.append(1) or _own(*a, **k))
    want = levelwise.alternate(df, start, ["a", "b", "c"], "y", s, rounds=12)
    monkeypatch.undo()
    got, passes = shapes.alternate_levels(df, start, ["a", "b", "c"], "y", s)
    assert trees.same(got, want)
    assert levelwise._errors(df, got, "y") < levelwise._errors(df, start, "y")
    assert passes < len(jobs)
    again, one = shapes.alternate_levels(df, got, ["a", "b", "c"], "y", s)
    assert trees.same(again, got)
    assert one <= 3  # a level each
    df.unpersist()
