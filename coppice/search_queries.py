"""Queries of searches and fitted trees, each beside SQL that finds the same by enumerating."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.functions.impurity import sigmoid, softmax
from coppice.operators import binning, evaluate, histogram, prep
from coppice.plans import bounded, exact, imbalance, levelwise, modelstore, multiway, rashomon, selection, trees
from coppice.queries import BINNED, CASE, FEATURES, FLAGGED, FLAGS, ROUTED, THREE, TWO, binned, flagged, query, routed, sql_entropy
from coppice.sources.tables import table
from coppice.streaming import incremental

# --- optimal trees over three 0/1 features, by all subcubes: 0 or 1 fixes a feature, 2 leaves it free

ABC = list(FLAGS)


def cubes(y: str, classes: list[str], leaf: str) -> str:
    """CTEs n (totals), cc (class weights n0, n1, ... of each nonempty subcube) and leaf (subcube, o: price of a leaf)."""
    sums = ", ".join(f"CAST(sum(CASE WHEN {y} = {c} THEN 1 ELSE 0 END) AS DOUBLE) AS n{i}" for i, c in enumerate(classes))
    at = " AND ".join(f"(c.{f} = 2 OR c.{f} = p.{f})" for f in ABC)
    free = ", ".join(f"(VALUES (0), (1), (2)) {f}({f})" for f in ABC)
    total = " + ".join(f"n{i}" for i in range(len(classes)))
    return f"""p AS (SELECT {", ".join(ABC)}, {y} FROM {FLAGGED} f),
n AS (SELECT {sums}, CAST(count(*) AS DOUBLE) AS total FROM p),
c AS (SELECT * FROM {free}),
cc AS (SELECT {", ".join(f"c.{f}" for f in ABC)}, {sums} FROM c JOIN p ON {at} GROUP BY ALL),
leaf AS (SELECT {", ".join(f"cc.{f}" for f in ABC)}, {", ".join(f"cc.n{i}" for i in range(len(classes)))}, {total.replace("n", "cc.n")} AS m, {leaf} AS o FROM cc, n)"""


def halves(prev: str, f: str, one: str, two: str) -> str:
    """Joins the halves of leaf l by feature f in table prev."""
    def side(name: str, v: int) -> str:
        return f"LEFT JOIN {prev} {name} ON l.{f} = 2 AND " + " AND ".join(f"{name}.{g} = " + (str(v) if g == f else f"l.{g}") for g in ABC)

    return f"{side(one, 1)} {side(two, 0)}"


def each_split(name: str, price: str, value: str, more: str = "") -> str:
    """A CTE of (subcube, f, i, price, v) for each split of a subcube into nonempty halves x and y; price and v are
    expressions over l, x, y and what ``more`` joins."""
    rows = " UNION ALL ".join(
        f"SELECT {", ".join(f"l.{g}" for g in ABC)}, {i} AS i, l.o AS o, {price} AS price, {value} AS v, l.n0 AS n0 FROM leaf l {halves('{prev}', f, 'x', 'y')} {more} WHERE x.o IS NOT NULL AND y.o IS NOT NULL"
        for i, f in enumerate(ABC)
    )
    return f"{name} AS ({rows})"


def best(name: str, prev: str) -> str:
    """The optimum one level deeper than that of ``prev`` (subcube, o)."""
    splits = each_split(f"{name}_s", "x.o + y.o", "x.o + y.o").replace("{prev}", prev)
    key = ", ".join(f"l.{g}" for g in ABC)
    return f"{splits}, {name} AS (SELECT {key}, least(l.o, coalesce(min(s.price), l.o)) AS o FROM leaf l LEFT JOIN {name}_s s USING ({', '.join(ABC)}) GROUP BY {key}, l.o)"


def greedy(name: str, prev: str) -> str:
    """The price of a tree of the best gains one level deeper, cut back where a leaf costs no more; needs ``gain``."""
    splits = each_split(f"{name}_s", "x.o + y.o", "x.o + y.o").replace("{prev}", prev)
    key = ", ".join(f"l.{g}" for g in ABC)
    return (
        f"{splits}, {name} AS (SELECT {key}, CASE WHEN s.price < l.o - 1e-12 THEN s.price ELSE l.o END AS o FROM leaf l LEFT JOIN gain g USING ({', '.join(ABC)}) "
        f"LEFT JOIN {name}_s s ON {' AND '.join(f's.{g} = l.{g}' for g in ABC)} AND s.i = g.i)"
    )


#: gain: of each subcube the split of the most information, ties to the last feature.
GAIN = (
    each_split("gains", "0 - (" + sql_entropy("x.n0", "x.n1") + ") * x.m - (" + sql_entropy("y.n0", "y.n1") + ") * y.m", "(" + sql_entropy("l.n0", "l.n1") + ") * l.m").replace("{prev}", "leaf")
    + f", gain AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {', '.join(ABC)} ORDER BY round(price + v, 12) DESC, i DESC) AS r FROM gains) WHERE r = 1 AND price + v > 1e-12)"
)


def looked_ahead(name: str, price: str, then: str) -> str:
    """The value of the tree whose root is the split of least ``price`` in both halves (ties: the most gain) and which goes on as
    ``then`` there; where no split is cheaper than the leaf, NULL."""
    splits = each_split(f"{name}_s", "p.o + q.o", "x.o + y.o", "JOIN {p} p ON " + " AND ".join(f"p.{g} = x.{g}" for g in ABC) + " JOIN {p} q ON " + " AND ".join(f"q.{g} = y.{g}" for g in ABC)).replace("{prev}", then).replace("{p}", price)
    ranked = f"SELECT s.*, row_number() OVER (PARTITION BY {', '.join(f's.{g}' for g in ABC)} ORDER BY round(s.price, 12), round(g.price + g.v, 12) DESC, s.i) AS r FROM {name}_s s JOIN gains g USING ({', '.join(ABC)}, i)"
    return f"{splits}, {name}_b AS (SELECT * FROM ({ranked}) WHERE r = 1 AND price < o - 1e-12)"


def pruned(name: str, found: str) -> str:
    key = ", ".join(f"l.{g}" for g in ABC)
    return f"{name} AS (SELECT {key}, coalesce(b.v, l.o) AS o FROM leaf l LEFT JOIN {found} b USING ({', '.join(ABC)}))"


def root(name: str) -> str:
    return f"(SELECT o FROM {name} WHERE " + " AND ".join(f"{f} = 2" for f in ABC) + ")"


def minority(classes: int, reg: float) -> str:
    every, most = " + ".join(f"cc.n{i}" for i in range(classes)), ", ".join(f"cc.n{i}" for i in range(classes))
    return f"({every} - greatest({most})) / n.total + greatest({reg}, 1 / n.total)"


def _fitted(rows: DataFrame, y: str, got: exact.Fitted, reg: float, **more: object) -> DataFrame:
    """objective, and the same from the tree's predictions for all rows and its leaves."""
    leaves = trees.statistics(got.tree)["leaves"]
    scored = trees.predict(rows, got.tree).agg(F.count(F.lit(1)).alias("_n"), F.sum((F.col("predicted") != F.col(y)).cast("int")).alias("_e"))
    reg = F.greatest(F.lit(reg), 1 / F.col("_n"))
    return scored.select(F.lit(round(got.objective, 9)).alias("objective"), F.round(F.col("_e") / F.col("_n") + leaves * reg, 9).alias("scored"), *(F.lit(v).alias(k) for k, v in more.items()))


def _both(o: str, *more: str) -> str:
    return f"SELECT round({o}, 9) AS objective, round({o}, 9) AS scored{''.join(', ' + m for m in more)}"


@query("WITH " + cubes("l_returnflag", ["'A'", "'N'", "'R'"], minority(3, 0.001)) + ", " + ", ".join(best(f"o{i}", f"o{i - 1}" if i > 1 else "leaf") for i in (1, 2, 3)) + " " + _both(root("o3"), "'optimal' AS status"))
def optimal_sparse_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flagged(spark, sf_dir)
    got = exact.optimal(exact.collapse(rows, ABC, "l_returnflag"), exact.Settings(3, 0.001))
    return _fitted(rows, "l_returnflag", got, 0.001, status=got.status)


@query("WITH " + cubes("l_returnflag", ["'A'", "'N'", "'R'"], minority(3, 0.001)) + ", " + ", ".join(best(f"o{i}", f"o{i - 1}" if i > 1 else "leaf") for i in (1, 2, 3)) + " " + _both(root("o3"), "'optimal' AS status"))
def feature_exchange_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flagged(spark, sf_dir)
    got = exact.optimal(exact.collapse(rows, ABC, "l_returnflag"), exact.Settings(3, 0.001, feature_exchange=True))
    return _fitted(rows, "l_returnflag", got, 0.001, status=got.status)


@query("WITH " + cubes("l_returnflag", ["'A'", "'N'", "'R'"], minority(3, 0.001)) + ", " + ", ".join(best(f"o{i}", f"o{i - 1}" if i > 1 else "leaf") for i in (1, 2, 3))
       + " " + _both(root("o3"), "'optimal' AS status", "true AS bounds_hold"))
def bounded_search_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The optimum by bounds that close in, and whether those reported on the way all hold and only close in."""
    rows = flagged(spark, sf_dir)
    got = bounded.optimal(exact.collapse(rows, ABC, "l_returnflag"), exact.Settings(3, 0.001))
    trace = got.more["trace"]
    hold = all(lo <= got.objective + 1e-9 and hi >= got.objective - 1e-9 for _, lo, hi in trace) and all(a[1] <= b[1] + 1e-9 and a[2] >= b[2] - 1e-9 for a, b in zip(trace, trace[1:], strict=False))
    return _fitted(rows, "l_returnflag", got, 0.001, status=got.status, bounds_hold=hold)


TWO_CLASSES = "WITH " + cubes("y", ["0", "1"], minority(2, 0.0001)) + ", " + GAIN + ", "


@query(TWO_CLASSES + ", ".join([greedy("g1", "leaf"), greedy("g2", "g1"), best("o1", "leaf"), best("o2", "o1"), looked_ahead("a", "g2", "o2")])
       + " " + _both(f"coalesce((SELECT v FROM a_b WHERE {' AND '.join(f'{f} = 2' for f in ABC)}), {root('o2')})"))
def lookahead_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flagged(spark, sf_dir)
    return _fitted(rows, "y", exact.lookahead(exact.collapse(rows, ABC, "y"), exact.Settings(3, 0.0001), 1), 0.0001)


@query(TWO_CLASSES + ", ".join([greedy("g1", "leaf"), greedy("g2", "g1"), looked_ahead("r1", "leaf", "leaf"), pruned("v1", "r1_b"), looked_ahead("r2", "g1", "v1"), pruned("v2", "r2_b"), looked_ahead("r3", "g2", "v2"), pruned("v3", "r3_b")])
       + " " + _both(root("v3")))
def recursive_lookahead_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flagged(spark, sf_dir)
    return _fitted(rows, "y", exact.recursive_lookahead(exact.collapse(rows, ABC, "y"), exact.Settings(3, 0.0001)), 0.0001)


@query(TWO_CLASSES + ", ".join([greedy("g1", "leaf"), greedy("g2", "g1"), greedy("g3", "g2")]) + " " + _both(root("g3")))
def greedy_sparse_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flagged(spark, sf_dir)
    return _fitted(rows, "y", exact.greedy(exact.collapse(rows, ABC, "y"), exact.Settings(3, 0.0001)), 0.0001)


@query("WITH " + cubes("y", ["0", "1"], "least(cc.n0 / n.n0, cc.n1 / n.n1) / 2 + 0.01") + ", " + best("o1", "leaf") + ", " + best("o2", "o1") + f" SELECT round({root('o2')}, 9) AS objective")
def balanced_accuracy_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    loss, _ = imbalance.optimal(exact.collapse(flagged(spark, sf_dir), ABC, "y"), exact.Settings(2, 0.01), "bacc")
    return spark.createDataFrame([(round(loss, 9),)], "objective double")


def areas(reg: float, most: float) -> str:
    """SQL of the best area of all trees of up to two levels: each tree as the list of its leaves, which are put in order."""
    cube = ", ".join(f"l.{g}" for g in ABC)
    leaf_ = "struct_pack(n := {t}.n0, p := {t}.n1)"
    splits = " UNION ALL ".join(f"SELECT {cube}, [{leaf_.format(t='x')}, {leaf_.format(t='y')}] AS v FROM leaf l {halves('leaf', f, 'x', 'y')} WHERE x.o IS NOT NULL AND y.o IS NOT NULL" for f in ABC)
    at = lambda t, **fixed: " AND ".join(f"{t}.{f} = {fixed.get(f, 2)}" for f in ABC)
    two = " UNION ALL ".join(f"SELECT a.v || b.v FROM opt a, opt b WHERE {at('a', **{f: 1})} AND {at('b', **{f: 0})}" for f in ABC)
    return ("WITH " + cubes("y", ["0", "1"], "0") + f""", opt AS (SELECT {cube}, [{leaf_.format(t='l')}] AS v FROM leaf l UNION ALL {splits}),
tree AS (SELECT row_number() OVER () AS id, v FROM (SELECT v FROM opt WHERE {at('opt')} UNION ALL {two})),
part AS (SELECT id, len(v) AS leaves, unnest(v) AS q FROM tree),
curve AS (SELECT id, leaves, q.n / n.n0 AS dx, q.p / n.n1 AS dy, sum(q.n / n.n0) OVER w AS x, sum(q.p / n.n1) OVER w AS y FROM part, n WINDOW w AS (PARTITION BY id ORDER BY q.p / (q.n + q.p) DESC, q.n ROWS UNBOUNDED PRECEDING)),
cut AS (SELECT id, leaves, dx, dy, x - dx AS x0, y - dy AS y0, greatest(0, least({most}, x) - least({most}, x - dx)) AS w FROM curve),
area AS (SELECT id, any_value(leaves) AS leaves, sum(CASE WHEN dx > 0 THEN w * (y0 + w / dx * dy / 2) ELSE 0 END) / {most} AS a FROM cut GROUP BY id)
SELECT round(min(1 - a + {reg} * leaves), 9) AS objective FROM area""")


@query(areas(0.01, 1.0))
def area_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best area under the curve of all trees of two levels."""
    value, _ = imbalance.optimal_area(exact.collapse(flagged(spark, sf_dir), ABC, "y"), exact.Settings(2, 0.01))
    return spark.createDataFrame([(round(value, 9),)], "objective double")


@query(areas(0.001, 0.25))
def partial_area_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best area up to a quarter of false positives of all trees of two levels."""
    value, _ = imbalance.optimal_area(exact.collapse(flagged(spark, sf_dir), ABC, "y"), exact.Settings(2, 0.001), 0.25)
    return spark.createDataFrame([(round(value, 9),)], "objective double")


def solutions(depth: int, reg: float, adder: float, found: str = "SELECT CAST(e AS BIGINT) AS errors, leaves, count(*) AS trees FROM within GROUP BY 1, 2") -> str:
    """SQL of (errors, leaves, trees) of all trees within ``adder`` of the optimum, by listing them."""
    ctes = ["t0 AS (SELECT " + ", ".join(f"{f}" for f in ABC) + ", CASE WHEN n1 > n0 THEN n0 ELSE 0 END AS fp, CASE WHEN n1 > n0 THEN 0 ELSE n1 END AS fn, 1 AS leaves, CASE WHEN n1 > n0 THEN 1 ELSE 0 END AS one, o FROM leaf)"]
    for d in range(1, depth + 1):
        rows = " UNION ALL ".join(
            f"SELECT {', '.join(f'l.{g}' for g in ABC)}, x.fp + y.fp AS fp, x.fn + y.fn AS fn, x.leaves + y.leaves AS leaves, NULL AS one, 0 AS o FROM leaf l {halves(f't{d - 1}', f, 'x', 'y')} "
            "WHERE x.o IS NOT NULL AND y.o IS NOT NULL AND (x.one IS NULL OR y.one IS NULL OR x.one <> y.one)" for f in ABC
        )
        ctes.append(f"t{d} AS (SELECT * FROM t0 UNION ALL {rows})")
    at = " AND ".join(f"{f} = 2" for f in ABC)
    ctes.append(f"every AS (SELECT fp, fn, fp + fn AS e, leaves, 1 - ((n.n1 - fn) / n.n1 + (n.n0 - fp) / n.n0) / 2 + leaves * greatest({reg}, 1 / n.total) AS balanced, (fp + fn) / n.total + leaves * greatest({reg}, 1 / n.total) AS price FROM t{depth}, n WHERE {at})")
    ctes.append(f"within AS (SELECT * FROM every WHERE price <= (SELECT min(price) FROM every) + {adder} + 1e-12)")
    return "WITH " + cubes("y", ["0", "1"], minority(2, reg)) + ", " + ", ".join(ctes) + " " + found


def _models(spark: SparkSession, sf_dir: str, depth: int, reg: float, adder: float) -> tuple[rashomon.ModelSet, DataFrame]:
    cases = exact.collapse(flagged(spark, sf_dir), ABC, "y")
    models, n = rashomon.ModelSet(cases, exact.Settings(depth, reg), adder=adder), int(cases.n.sum())
    rows: dict[tuple[int, int], int] = {}
    for price, leaves, count in models.metric_counts():
        key = round((price - leaves * models.search.reg) * n), leaves
        rows[key] = rows.get(key, 0) + count
    return models, spark.createDataFrame([(*k, v) for k, v in rows.items()], "errors long, leaves int, trees long")


@query(solutions(2, 0.005, 0.2))
def rashomon_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _models(spark, sf_dir, 2, 0.005, 0.2)[1]


@query(solutions(3, 0.005, 0.03))
def rashomon_metric_convolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _models(spark, sf_dir, 3, 0.005, 0.03)[1]


@query(f"SELECT CAST(sum(trees) AS BIGINT) AS trees, CAST(sum(trees) AS BIGINT) AS distinct_trees, CAST(sum(trees) AS BIGINT) AS found, CAST(0 AS BIGINT) AS strangers FROM ({solutions(2, 0.005, 0.2)})")
def model_set_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of a model set by ordinal, how many differ, how many its trie holds, and how many trees of other classes."""
    models, _ = _models(spark, sf_dir, 2, 0.005, 0.2)
    every = [models[i] for i in range(len(models))]
    kinds = ABC, models.cases.classes
    root_ = rashomon.trie(every, *kinds)
    deep = trees.boolean(ABC[0], trees.boolean(ABC[0], trees.Leaf(1), trees.Leaf(0)), trees.Leaf(1))
    row = len(every), len({rashomon.keys(t, *kinds) for t in every}), sum(rashomon.contains(root_, t, *kinds) for t in every), int(rashomon.contains(root_, deep, *kinds))
    return spark.createDataFrame([row], "trees long, distinct_trees long, found long, strangers long")


@query(solutions(2, 0.005, 0.2, "SELECT count(*) AS covered FROM within WHERE balanced <= 0.55 + 1e-12"))
def model_set_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    models, _ = _models(spark, sf_dir, 2, 0.005, 0.2)
    at = models.covered(rashomon.balanced_accuracy, 0.55)
    assert len(at) == models.covered_count(rashomon.balanced_accuracy, 0.55)
    return spark.createDataFrame([(len(at),)], "covered long")


@query(solutions(3, 0.005, 0.1, "SELECT leaves, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, count(*) AS trees FROM within GROUP BY 1, 2, 3"))
def model_set_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many trees of a set have so many false positives, false negatives and leaves, by products over the graph."""
    models, _ = _models(spark, sf_dir, 3, 0.005, 0.1)
    rows, (none, one) = int(models.cases.n.sum()), models.cases.w.sum(0)
    found: dict[tuple[int, int, int], int] = {}
    for leaves, tp, tn, n in models.confusion():
        key = leaves, round((none - tn) * rows), round((one - tp) * rows)
        found[key] = found.get(key, 0) + n
    return spark.createDataFrame([(*k, n) for k, n in found.items()], "leaves int, fp long, fn long, trees long")


@query(solutions(3, 0.005, 0.1, "SELECT round(min(balanced), 9) AS objective, round(min(balanced), 9) AS scored, count(*) AS trees FROM within"))
def model_set_best_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best balanced accuracy of a set, and the same of the tree that has it, by its own predictions."""
    models, _ = _models(spark, sf_dir, 3, 0.005, 0.1)
    objective, at = models.best_metric(rashomon.balanced_accuracy)
    rows, best = flagged(spark, sf_dir), models[at]
    scored = trees.predict(rows, best).agg(*((F.avg(F.when(F.col("y") == k, (F.col("predicted") != k).cast("int")))).alias(f"_e{k}") for k in (0, 1)))
    direct = (F.col("_e0") + F.col("_e1")) / 2 + F.lit(trees.statistics(best)["leaves"] * models.search.reg)
    return scored.select(F.lit(round(objective, 9)).alias("objective"), F.round(direct, 9).alias("scored"), F.lit(len(models)).cast("long").alias("trees"))


@query(solutions(3, 0.005, 0.1))
def model_set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of a narrow and a wide bound through their tables and merged: all trees of the wide one, each once."""
    sets = []
    for adder in (0.02, 0.1):
        models, _ = _models(spark, sf_dir, 3, 0.005, adder)
        sets.append(modelstore.read(*modelstore.stored(models).tables(spark), ABC, models.cases.classes, models.search.reg))
    merged, n = sets[0].union(sets[1]), int(models.cases.n.sum())
    found: dict[tuple[int, int], int] = {}
    for price, leaves, count in merged.metric_counts():
        key = round((price - leaves * merged.regularisation) * n), leaves
        found[key] = found.get(key, 0) + count
    return spark.createDataFrame([(*k, v) for k, v in found.items()], "errors long, leaves int, trees long")


def completions(reg: float, adder: float, more: float) -> str:
    """SQL of (errors, leaves, trees): prefixes of one level within ``adder`` of the best, each leaf replaced by each tree of one
    more level within ``more`` of the best for its rows."""
    head = solutions(1, reg, adder, "").strip()
    cube = ", ".join(ABC)
    price = f"(fp + fn) / n.total + leaves * greatest({reg}, 1 / n.total)"
    ends = f"ends AS (SELECT {cube}, fp + fn AS e, leaves FROM (SELECT t1.*, {price} AS price FROM t1, n) QUALIFY price <= min(price) OVER (PARTITION BY {cube}) + {more} + 1e-12)"
    at = lambda t, **fixed: " AND ".join(f"{t}.{f} = {fixed.get(f, 2)}" for f in ABC)
    bound = f"(SELECT min(price) FROM every) + {adder} + 1e-12"
    rows = [f"SELECT c.e, c.leaves FROM t0 x, n, ends c WHERE {at('x')} AND {at('c')} AND (x.fp + x.fn) / n.total + greatest({reg}, 1 / n.total) <= {bound}"]
    rows += [f"SELECT c.e + d.e, c.leaves + d.leaves FROM t0 x, t0 y, n, ends c, ends d WHERE {at('x', **{f: 1})} AND {at('y', **{f: 0})} AND {at('c', **{f: 1})} AND {at('d', **{f: 0})} "
             f"AND x.one <> y.one AND (x.fp + x.fn + y.fp + y.fn) / n.total + 2 * greatest({reg}, 1 / n.total) <= {bound}" for f in ABC]  # fmt: skip
    return f"{head}, {ends}, whole AS ({' UNION ALL '.join(rows)}) SELECT CAST(e AS BIGINT) AS errors, leaves, count(*) AS trees FROM whole GROUP BY 1, 2"


@query(completions(0.005, 0.2, 0.05))
def completed_model_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefixes of one level, each leaf completed by every good tree of one more: counted on the shared graph."""
    models, _ = _models(spark, sf_dir, 1, 0.005, 0.2)
    whole, n = models.completed(1, 0.05), int(models.cases.n.sum())
    found: dict[tuple[int, int], int] = {}
    for price, leaves, count in whole.metric_counts():
        key = round((price - leaves * models.search.reg) * n), leaves
        found[key] = found.get(key, 0) + count
    assert sum(found.values()) == len(whole)
    return spark.createDataFrame([(*k, v) for k, v in found.items()], "errors long, leaves int, trees long")


def either_class(depth: int, reg: float, loss: str) -> str:
    """SQL of the least loss + reg * leaves over all trees whose leaves may be of either class; loss is of fp, fn, p, n."""
    ctes = [f"t0 AS (SELECT {', '.join(ABC)}, n0 AS fp, 0.0 AS fn, 1 AS leaves, o FROM leaf UNION ALL SELECT {', '.join(ABC)}, 0.0, n1, 1, o FROM leaf)"]
    for d in range(1, depth + 1):
        rows = " UNION ALL ".join(
            f"SELECT DISTINCT {', '.join(f'l.{g}' for g in ABC)}, x.fp + y.fp AS fp, x.fn + y.fn AS fn, x.leaves + y.leaves AS leaves, 0.0 AS o FROM leaf l {halves(f't{d - 1}', f, 'x', 'y')} WHERE x.o IS NOT NULL AND y.o IS NOT NULL" for f in ABC)
        ctes.append(f"t{d} AS (SELECT * FROM t0 UNION ALL {rows})")
    at = " AND ".join(f"{f} = 2" for f in ABC)
    return "WITH " + cubes("y", ["0", "1"], "cc.n0") + ", " + ", ".join(ctes) + f" SELECT round(min({loss} + {reg} * leaves), 9) AS objective FROM (SELECT fp / n.total AS fp, fn / n.total AS fn, leaves, n.n1 / n.total AS p, n.n0 / n.total AS n FROM t{depth}, n WHERE {at})"


def _imbalanced(spark: SparkSession, sf_dir: str, objective: object) -> DataFrame:
    loss, _ = imbalance.optimal(exact.collapse(flagged(spark, sf_dir), ABC, "y"), exact.Settings(2, 0.01), objective)
    return spark.createDataFrame([(round(loss, 9),)], "objective double")


@query(either_class(2, 0.01, "(fp + fn) / (2 * p + fp - fn)"))
def f1_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _imbalanced(spark, sf_dir, "f1")


@query(either_class(2, 0.01, "(3 * fn + fp) / (3 * p + n)"))
def weighted_accuracy_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _imbalanced(spark, sf_dir, imbalance.weighted(3))


def rule_list(name: str, prev: str) -> str:
    """The best list of rules one longer than those of ``prev``: of every split one side is a leaf."""
    joins = " ".join(f"JOIN leaf {p} ON " + " AND ".join(f"{p}.{g} = {x}.{g}" for g in ABC) for p, x in (("p", "x"), ("q", "y")))
    splits = each_split(f"{name}_s", "least(p.o + y.o, x.o + q.o)", "0", joins).replace("{prev}", prev)
    key = ", ".join(f"l.{g}" for g in ABC)
    return f"{splits}, {name} AS (SELECT {key}, least(l.o, coalesce(min(s.price), l.o)) AS o FROM leaf l LEFT JOIN {name}_s s USING ({', '.join(ABC)}) GROUP BY {key}, l.o)"


@query("WITH " + cubes("l_returnflag", ["'A'", "'N'", "'R'"], minority(3, 0.001)) + ", " + ", ".join(rule_list(f"o{i}", f"o{i - 1}" if i > 1 else "leaf") for i in (1, 2, 3)) + " " + _both(root("o3")))
def optimal_rule_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flagged(spark, sf_dir)
    return _fitted(rows, "l_returnflag", exact.optimal(exact.collapse(rows, ABC, "l_returnflag"), exact.Settings(3, 0.001, rule_list=True)), 0.001)


@query("WITH " + cubes("y", ["0", "1"], "least(5 * cc.n1, cc.n0) / n.total + 0.001") + ", " + best("o1", "leaf") + ", " + best("o2", "o1") + f" SELECT round({root('o2')}, 9) AS objective")
def cost_matrix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing a 1 costs five times a false alarm."""
    cases = exact.collapse(flagged(spark, sf_dir), ABC, "y", costs={(0, 1): 5.0, (1, 0): 1.0})
    return spark.createDataFrame([(round(exact.optimal(cases, exact.Settings(2, 0.001)).objective, 9),)], "objective double")


@query("WITH " + cubes("y", ["0", "1"], "least(cc.n0 / n.n0, cc.n1 / n.n1) / 2 + 0.001") + ", " + best("o1", "leaf") + ", " + best("o2", "o1") + f" SELECT round({root('o2')}, 9) AS objective")
def balanced_weights_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = exact.collapse(flagged(spark, sf_dir), ABC, "y", balance=True)
    return spark.createDataFrame([(round(exact.optimal(cases, exact.Settings(2, 0.001)).objective, 9),)], "objective double")


@query(f"WITH two AS (SELECT feature, min(loss) AS l FROM ({TWO}) GROUP BY feature), three AS (SELECT feature, min(loss) AS l FROM ({THREE}) GROUP BY feature) SELECT feature, two.l AS loss_2, three.l AS loss_3 FROM two JOIN three USING (feature)")
def interval_program(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least errors of two and of three runs of bins, by the interval program on the histogram."""
    out = []
    hist = histogram.binary_histogram(binned(spark, sf_dir), FEATURES, "y").orderBy("feature", "bin").toPandas()
    for feature, rows in hist.groupby("feature"):
        c = np.concatenate([np.zeros((1, 2)), rows[["n0", "n1"]].to_numpy(float).cumsum(0)])
        seg = c[None] - c[:, None]
        found = multiway.interval_partitions(multiway.loss(seg), seg.sum(-1) > 0, 3)
        out.append((feature, round(found[2][0]), round(found[3][0])))
    return spark.createDataFrame(out, "feature string, loss_2 long, loss_3 long")


# --- trees grown by levels


def grown(levels: int, y: str, classes: list[str], least: int, features: list[str] = FEATURES) -> str:
    """CTEs r0 to r{levels}: the rows with the path of a threshold tree of the least gini mass, a level each."""
    k, ctes = len(classes), [f"r0 AS (SELECT {', '.join(features)}, {y} AS y, '' AS path FROM {BINNED} b)"]

    def mass(of: str) -> str:
        n = " + ".join(of.format(i=i) for i in range(k))
        return f"(({n}) - ({' + '.join(f'({of.format(i=i)}) * ({of.format(i=i)})' for i in range(k))}) / ({n}))"

    left, right = "c{i}", "(t{i} - c{i})"
    n_left, n_right = (" + ".join(s.format(i=i) for i in range(k)) for s in (left, right))
    for d in range(levels):
        long = " UNION ALL ".join(f"SELECT path, {j} AS f, {c} AS b, y FROM r{d}" for j, c in enumerate(features))
        hist = ", ".join(f"CAST(sum(CASE WHEN y = {c} THEN 1 ELSE 0 END) AS DOUBLE) AS n{i}" for i, c in enumerate(classes))
        sums = ", ".join(f"sum(n{i}) OVER (PARTITION BY path, f ORDER BY b) AS c{i}, sum(n{i}) OVER (PARTITION BY path, f) AS t{i}" for i in range(k))
        value = " ".join(f"WHEN {j} THEN {c}" for j, c in enumerate(features))
        ctes += [
            f"h{d} AS (SELECT path, f, b, {hist} FROM ({long}) GROUP BY path, f, b)",
            f"p{d} AS (SELECT path, f, b, {sums} FROM h{d})",
            f"s{d} AS (SELECT path, f, b, {mass(left)} + {mass(right)} AS cost, {mass('t{i}')} AS own FROM p{d} WHERE {n_left} >= {least} AND {n_right} >= {least})",
            f"b{d} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY round(cost, 6), f, b) AS r FROM s{d}) WHERE r = 1 AND cost < own - 1e-9)",
            f"r{d + 1} AS (SELECT {', '.join(features)}, y, CASE WHEN s.f IS NULL THEN r.path ELSE r.path || CASE WHEN r.path = '' THEN '' ELSE '.' END || CASE WHEN CASE s.f {value} END <= s.b THEN '0' ELSE '1' END END AS path FROM r{d} r LEFT JOIN b{d} s USING (path))",
        ]
    return "WITH " + ", ".join(ctes)


def _leaves(rows: DataFrame, tree: trees.Tree, y: str) -> DataFrame:
    scored = trees.predict(rows, tree).withColumn("path", trees.expression(tree, "path"))
    return scored.groupBy("path", F.col("predicted").cast("string").alias("predicted")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("predicted") != F.col(y)).cast("int")).alias("errors"))


def _leaf_sql(levels: int) -> str:
    return f"SELECT path, CAST(y AS VARCHAR) AS predicted, CAST(n AS BIGINT) AS n, CAST(n - c AS BIGINT) AS errors FROM (SELECT path, y, c, sum(c) OVER (PARTITION BY path) AS n, row_number() OVER (PARTITION BY path ORDER BY c DESC, y) AS k FROM (SELECT path, y, count(*) AS c FROM r{levels} GROUP BY path, y)) WHERE k = 1"


@query(grown(3, "l_returnflag", ["'A'", "'N'", "'R'"], 20) + " " + _leaf_sql(3))
def levelwise_threshold_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = binned(spark, sf_dir)
    return _leaves(rows, levelwise.grow(rows, FEATURES, "l_returnflag", levelwise.Settings(3, min_child=20)), "l_returnflag")


@query(grown(2, "l_returnflag", ["'A'", "'N'", "'R'"], 20) + " " + _leaf_sql(2))
def best_first_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = binned(spark, sf_dir)
    return _leaves(rows, levelwise.grow_best_first(rows, FEATURES, "l_returnflag", levelwise.Settings(2, min_child=20), leaves=4), "l_returnflag")


@query(grown(2, "y", ["0", "1"], 20) + ", s AS (SELECT path, avg(1.0 - y) AS a, avg(1.0 * y) AS b FROM r2 GROUP BY path) SELECT qb, db, tb, round(a, 9) AS share_0, round(b, 9) AS share_1, count(*) AS n FROM r2 JOIN s USING (path) GROUP BY ALL")
def tree_class_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = binned(spark, sf_dir)
    tree = levelwise.grow(rows, FEATURES, "y", levelwise.Settings(2, min_child=20))
    shared = trees.predict_shares(rows, tree, [0, 1])
    return shared.groupBy("qb", "db", "tb", F.round("share_0", 9).alias("share_0"), F.round("share_1", 9).alias("share_1")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH h AS (SELECT qb, count(*) AS n, sum(db) AS s, sum(db * db) AS q, sum(tb) AS t, sum(tb * tb) AS u FROM """ + BINNED + """ b GROUP BY qb),
p AS (SELECT qb, sum(n) OVER o AS n, sum(s) OVER o AS s, sum(q) OVER o AS q, sum(t) OVER o AS t, sum(u) OVER o AS u, sum(n) OVER () AS an, sum(s) OVER () AS as_, sum(q) OVER () AS aq, sum(t) OVER () AS at_, sum(u) OVER () AS au FROM h WINDOW o AS (ORDER BY qb)),
c AS (SELECT *, q + u - CAST(s * s + t * t AS DOUBLE) / n + (aq - q) + (au - u) - CAST((as_ - s) * (as_ - s) + (at_ - t) * (at_ - t) AS DOUBLE) / (an - n) AS cost FROM p WHERE an > n),
b AS (SELECT * FROM c ORDER BY cost, qb LIMIT 1)
SELECT h.qb, round(CASE WHEN h.qb <= b.qb THEN CAST(b.s AS DOUBLE) / b.n ELSE CAST(b.as_ - b.s AS DOUBLE) / (b.an - b.n) END, 9) AS db_mean, round(CASE WHEN h.qb <= b.qb THEN CAST(b.t AS DOUBLE) / b.n ELSE CAST(b.at_ - b.t AS DOUBLE) / (b.an - b.n) END, 9) AS tb_mean, h.n FROM h, b""")
def multi_target_regression_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = binned(spark, sf_dir)
    tree = levelwise.grow(rows, ["qb"], ["db", "tb"], levelwise.Settings(1, criterion="variance"))
    got = trees.predict(rows, tree)
    return got.groupBy("qb", F.round(F.col("predicted")[0], 9).alias("db_mean"), F.round(F.col("predicted")[1], 9).alias("tb_mean")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH h AS (SELECT db, CAST(count(*) AS DOUBLE) AS n, sum(l_quantity) AS s, sum(l_quantity * l_quantity) AS q FROM {BINNED} b GROUP BY db),
p AS (SELECT db, s / n AS m, sum(n) OVER o AS n, sum(s) OVER o AS s, sum(q) OVER o AS q, sum(n) OVER () AS an, sum(s) OVER () AS as_, sum(q) OVER () AS aq FROM h WINDOW o AS (ORDER BY s / n)),
c AS (SELECT *, q - s * s / n + (aq - q) - (as_ - s) * (as_ - s) / (an - n) AS cost FROM p WHERE an > n),
b AS (SELECT * FROM c ORDER BY cost LIMIT 1)
SELECT h.db, round(CASE WHEN h.s / h.n <= b.m THEN b.s / b.n ELSE (b.as_ - b.s) / (b.an - b.n) END, 6) AS predicted FROM h, b""")
def kmeans_branch_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of one feature in two groups of like means of a number."""
    rows = binned(spark, sf_dir)
    tree = levelwise.grow(rows, ["db"], "l_quantity", levelwise.Settings(1, "kmeans", 2, criterion="variance"))
    return trees.predict(rows, tree).groupBy("db", F.round("predicted", 6).alias("predicted")).count().select("db", "predicted")


# --- preparation and search


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50)")
def row_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "lineitem").where("l_quantity >= 50").select(F.col("l_orderkey").alias("o_orderkey"))
    return prep.slice_rows(table(spark, sf_dir, "orders"), "o_orderkey", wanted).select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def rows_beside(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return prep.beside(orders.select("o_orderkey", "o_totalprice"), orders.select("o_orderkey", "o_orderstatus"), "o_orderkey")


TOKENS = "CASE WHEN c_custkey % 5 = 0 THEN CAST(c_custkey AS VARCHAR) WHEN c_custkey % 5 = 1 THEN c_custkey || '.5' WHEN c_custkey % 5 = 2 THEN c_custkey || 'e1' WHEN c_custkey % 5 = 3 THEN '-' || c_custkey ELSE 'n/a' END"


@query("SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN c_custkey WHEN 3 THEN -c_custkey END AS whole, CASE c_custkey % 5 WHEN 1 THEN c_custkey + 0.5 WHEN 2 THEN c_custkey * 10.0 END AS \"real\" FROM customer")
def numeric_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "customer").select("c_custkey", F.expr(TOKENS.replace("VARCHAR", "STRING")).alias("t"))
    return tokens.select("c_custkey", prep.numeric_token(F.col("t")).alias("v")).select("c_custkey", "v.*")


@query(f"SELECT big + cheap + taxed AS ones, count(*) AS n, count(DISTINCT big + 2 * cheap + 4 * taxed) AS masks FROM {FLAGGED} f GROUP BY 1")
def population_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flagged(spark, sf_dir).select(prep.population(ABC).alias("ones"), prep.mask(ABC).alias("m"))
    return rows.groupBy("ones").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("m").alias("masks"))


@query(grown(2, "y", ["0", "1"], 20).replace("WITH ", "WITH ", 1) + ", u AS (SELECT f FROM b0 UNION SELECT f FROM b1) SELECT round(1 - count(*) / 3.0, 9) AS sparsity FROM u")
def feature_sparsity(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = levelwise.grow(binned(spark, sf_dir), FEATURES, "y", levelwise.Settings(2, min_child=20))
    used = [t.feature for *_, t in trees.nodes(tree) if isinstance(t, trees.Split)]
    return spark.createDataFrame([(round(selection.feature_sparsity(used, FEATURES), 9),)], "sparsity double")


@query("SELECT bin AS best FROM (SELECT qb AS bin, sum(n1 - n0) OVER (ORDER BY qb DESC) AS score FROM (SELECT qb, sum(y) AS n1, sum(1 - y) AS n0 FROM " + BINNED + " b GROUP BY qb)) ORDER BY score DESC, bin LIMIT 1")
def parzen_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bin from which predicting 1 wins most, by a model-guided search over one whole number."""
    counts = {r["qb"]: r["d"] for r in binned(spark, sf_dir).groupBy("qb").agg(F.sum(2 * F.col("y") - 1).alias("d")).collect()}
    done = selection.parzen_search(lambda s: float(sum(d for b, d in counts.items() if b >= s["cut"])), 60, seed=3, cut=selection.whole(min(counts), max(counts)))
    top = max(v for v, _ in done)
    return spark.createDataFrame([(min(s["cut"] for v, s in done if v == top),)], "best int")


@query("SELECT o_orderkey, o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS code FROM orders")
def label_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    coded = prep.encode_labels(orders, "o_orderstatus").select("o_orderkey", "code")
    return prep.decode_labels(coded, prep.label_codes(orders, "o_orderstatus"), "code").select("o_orderkey", F.col("label").alias("o_orderstatus"), "code")


@query("SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN c_custkey WHEN 1 THEN c_custkey + 0.5 WHEN 2 THEN c_custkey * 10.0 WHEN 3 THEN -c_custkey END AS x FROM customer")
def coerced_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "customer").select("c_custkey", F.expr(TOKENS.replace("VARCHAR", "STRING").replace("n/a", "Infinity")).alias("t"))
    return tokens.select("c_custkey", prep.finite(F.col("t")).alias("x"))


@query("SELECT event_id, round(1 / (1 + exp(-(value - 100) / 50)), 9) AS p, round(exp(value / 50 - 4) / (exp(value / 50 - 4) + 1 + exp(1)), 9) AS q FROM events")
def logistic_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    q = softmax(F.array(v / 50 - 4, F.lit(0.0), F.lit(1.0)))[0]
    return table(spark, sf_dir, "events").select("event_id", F.round(sigmoid((v - 100) / 50), 9).alias("p"), F.round(q, 9).alias("q"))


@query("SELECT p_partkey, CAST(floor(p_retailprice) % 10 AS INTEGER) AS d0, CAST(floor(p_retailprice / 10) % 10 AS INTEGER) AS d1, CAST(floor(p_retailprice / 100) % 10 AS INTEGER) AS d2 FROM part")
def radix_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = binning.digits(F.col("p_retailprice"), [0, 1, 2])
    return table(spark, sf_dir, "part").select("p_partkey", *(c.alias(f"d{i}") for i, c in enumerate(found)))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binned(spark, sf_dir).select(F.array("qb", "tb").alias("labels"), (F.col("db") % 5).alias("p"))


@query(f"SELECT round(avg(CASE WHEN db % 5 IN (qb, tb) THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM {BINNED} b")
def any_label_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.any_label_accuracy(_labelled(spark, sf_dir), "labels", "p").select(F.round("accuracy", 9).alias("accuracy"))


@query(f"SELECT label, count(*) AS n FROM (SELECT qb AS label FROM {BINNED} b UNION ALL SELECT tb FROM {BINNED} c) GROUP BY label")
def rows_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.one_row_per_label(_labelled(spark, sf_dir), "labels", "label").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH e AS (SELECT qb, db, tb, count(*) AS n FROM {BINNED} b GROUP BY ALL), u AS (SELECT qb, db, tb, 0 AS branch, qb AS e, n FROM e UNION ALL SELECT qb, db, tb, 1, db, n FROM e UNION ALL SELECT qb, db, tb, 2, tb, n FROM e), "
       "r AS (SELECT *, row_number() OVER (PARTITION BY qb, db, tb ORDER BY e, branch) - 1 AS rank, max(e) OVER (PARTITION BY qb, db, tb) - e AS weight FROM u) SELECT branch, CAST(rank AS INTEGER) AS rank, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * weight) AS BIGINT) AS weight FROM r GROUP BY 1, 2")  # fmt: skip
def error_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluate.error_weights(binned(spark, sf_dir).select(F.array("qb", "db", "tb").alias("e")), "e")
    return found.groupBy("branch", "rank").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").cast("long").alias("weight"))


HASHED = "CAST('0x' || substr(md5('3:' || CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0"


@query(f"SELECT o_orderkey, CASE WHEN h >= 0.8 THEN 2 WHEN h >= 0.7 THEN 1 ELSE 0 END AS part FROM (SELECT o_orderkey, {HASHED} AS h FROM orders)")
def random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.random_split(table(spark, sf_dir, "orders"), "o_orderkey", [0.7, 0.1, 0.2], seed=3).select("o_orderkey", "part")


@query("SELECT count(DISTINCT o_orderstatus) AS classes FROM orders")
def class_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(prep.require_classes(table(spark, sf_dir, "orders"), "o_orderstatus"),)], "classes long")


ROUTED_CASE = CASE.format(a="CASE WHEN db >= 5 THEN 1 ELSE 0 END")


@query(f"SELECT {ROUTED_CASE} AS predicted, count(*) AS n, 3 AS leaves FROM {BINNED} b GROUP BY 1")
def tree_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of a tree that went through its dictionary."""
    tree = trees.from_dict(trees.to_dict(ROUTED))
    return trees.predict(routed(spark, sf_dir), tree).groupBy("predicted").agg(F.count(F.lit(1)).alias("n"), F.lit(trees.statistics(tree)["leaves"]).alias("leaves"))


@query(f"SELECT {ROUTED_CASE} AS predicted, count(*) AS n, 2 AS branches FROM {BINNED} b GROUP BY 1")
def tree_group_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions after branches of equal subtrees became one."""
    inner = ROUTED.children[0]
    tree = trees.merged(trees.Split("qb", [[(0, 1)], [(2, 2)], [(4, 4)]], [inner, trees.Leaf(1), inner], prediction=0))
    return trees.predict(routed(spark, sf_dir), tree).groupBy("predicted").agg(F.count(F.lit(1)).alias("n"), F.lit(len(tree.children)).alias("branches"))


@query(f"SELECT CASE WHEN qb <= 0 THEN 0 WHEN qb <= 2 THEN 1 ELSE 2 END AS predicted, count(*) AS n, 1 AS depth FROM {BINNED} b GROUP BY 1")
def tree_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions after a child's split of the same feature was taken up."""
    inner = trees.Split("qb", [[(0, 0)], [(1, 2)]], [trees.Leaf(0), trees.Leaf(1)], prediction=0)
    tree = trees.summarised(trees.Split("qb", [[(0, 2)], [(3, 4)]], [inner, trees.Leaf(2)], prediction=0))
    return trees.predict(binned(spark, sf_dir), tree).groupBy("predicted").agg(F.count(F.lit(1)).alias("n"), F.lit(trees.statistics(tree)["depth"]).alias("depth"))


@query(f"SELECT leaf, count(*) AS n FROM (SELECT CASE WHEN qb IN (0, 1, 4) AND db >= 5 THEN 0 WHEN qb IN (0, 1, 4) THEN 1 WHEN qb = 2 THEN 2 END AS leaf FROM {BINNED} b) WHERE leaf IS NOT NULL GROUP BY leaf")
def leaf_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in the bins that each leaf's groups name."""
    groups = trees.group_table(spark, ROUTED).select("leaf", "feature", F.explode("spans").alias("s"))
    patterns = routed(spark, sf_dir).groupBy("qb", "cheap").agg(F.count(F.lit(1)).alias("n"))
    cells = patterns.select("qb", "cheap", "n", F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias("bin")) for f in ("qb", "cheap")))).alias("c"))
    inside = (F.col("c.feature") == F.col("feature")) & F.col("c.bin").between(F.col("s.lo"), F.col("s.hi"))
    hits = cells.join(F.broadcast(groups), inside).groupBy("leaf", "qb", "cheap", "n").agg(F.count_distinct("feature").alias("k"))
    needed = F.broadcast(trees.group_table(spark, ROUTED).groupBy("leaf").agg(F.count_distinct("feature").alias("k")))
    return hits.join(needed, ["leaf", "k"]).groupBy("leaf").agg(F.sum("n").alias("n"))


@query(f"SELECT qb * 11 + db AS cell, count(*) AS n FROM {BINNED} b GROUP BY 1")
def pair_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide, names = levelwise.with_pairs(binned(spark, sf_dir), [("qb", "db")], {"qb": 5, "db": 11})
    return wide.groupBy(F.col(names[0]).alias("cell")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, 'b' AS feature, CAST(floor(value / 50) AS INTEGER) AS bin, event_type AS y, count(*) AS n FROM events GROUP BY ALL")
def windowed_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.floor(F.col("value") / 50).cast("int").alias("b"), "event_type")
    got = incremental.windowed_histogram(e, "ts", ["b"], "event_type", width="1 day")
    return got.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "feature", "bin", "y", "n")
