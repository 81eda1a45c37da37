"""Trees over binned or boolean columns: one representation for binary, multiway and shape trees.

A split routes the bins of one feature to branches; a branch is a list of inclusive spans, not always neighbouring. A
boolean split has the branches [(1, 1)] and [(0, 0)], true first. Trees are small driver objects; they become a node
table, JSON, text, or a column expression, by which prediction is a projection in batch and on streams.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.operators.binning import number

Spans = list[tuple[int, int]]


@dataclass
class Leaf:
    prediction: object
    loss: float = 0.0
    counts: dict = field(default_factory=dict)


@dataclass
class Split:
    feature: str
    branches: list[Spans]
    children: list[Leaf | Split]
    prediction: object = None
    loss: float = 0.0
    counts: dict = field(default_factory=dict)


Tree = Leaf | Split


def to_spans(bins: list[int]) -> Spans:
    out: Spans = []
    for b in sorted(bins):
        if out and b == out[-1][1] + 1:
            out[-1] = (out[-1][0], b)
        else:
            out.append((b, b))
    return out


def boolean(feature: str, true: Tree, false: Tree, **more) -> Split:  # noqa: ANN003
    return Split(feature, [[(1, 1)], [(0, 0)]], [true, false], **more)


def cuts(branches: list[Spans]) -> list[tuple[int | None, int]]:
    """(highest bin, branch) in order, the last open: bins in a gap go to the nearer span, halfway ones to the lower."""
    flat = sorted((lo, hi, k) for k, spans in enumerate(branches) for lo, hi in spans)
    out = [((hi + nxt[0]) // 2, k) for (lo, hi, k), nxt in zip(flat, flat[1:], strict=False)]
    return [*out, (None, flat[-1][2])]


def route(split: Split, bin_: int | None) -> int | None:
    if bin_ is None:
        return None
    return next(k for top, k in cuts(split.branches) if top is None or bin_ <= top)


def predict_one(tree: Tree, row: dict, depth: int | None = None) -> object:
    while isinstance(tree, Split) and depth != 0:
        k = route(tree, row.get(tree.feature))
        if k is None:
            break
        tree, depth = tree.children[k], None if depth is None else depth - 1
    return tree.prediction


def below(path: str, branch: int) -> str:
    return f"{path}.{branch}" if path else str(branch)


def expression(tree: Tree, what: str = "prediction", depth: int | None = None) -> Column:
    """The prediction (or ``path``: the leaf's branches from the root, joined by dots) as a CASE over the bins. A null bin stops at the
    node; so does a depth limit."""
    def of(t: Tree, path: str, d: int | None) -> Column:
        own = F.lit(path if what == "path" else t.prediction)
        if isinstance(t, Leaf) or d == 0:
            return own
        c, bins = None, F.col(t.feature)
        for top, k in cuts(t.branches):
            value = of(t.children[k], below(path, k), None if d is None else d - 1)
            cond = bins.isNotNull() if top is None else bins <= top
            c = F.when(cond, value) if c is None else c.when(cond, value)
        return c.otherwise(own)

    return of(tree, "", depth)


def shares(tree: Tree, classes: list, out: str = "share_", depth: int | None = None) -> dict[str, Column]:
    """The share of each class (``out`` and its name: column) in the leaf that a row reaches, by class position; leaves
    without rows share alike. The shares of a row add up to 1."""
    def of(t: Tree, d: int | None, i: int) -> Column:
        total = sum(t.counts.values())
        own = F.lit(float(t.counts.get(str(classes[i]), 0.0) / total) if total else 1 / len(classes))
        if isinstance(t, Leaf) or d == 0:
            return own
        c, bins = None, F.col(t.feature)
        for top, k in cuts(t.branches):
            cond = bins.isNotNull() if top is None else bins <= top
            value = of(t.children[k], None if d is None else d - 1, i)
            c = F.when(cond, value) if c is None else c.when(cond, value)
        return c.otherwise(own)

    return {f"{out}{c}": of(tree, depth, i) for i, c in enumerate(classes)}


def predict_shares(df: DataFrame, tree: Tree, classes: list, out: str = "share_", depth: int | None = None) -> DataFrame:
    """Adds a column for each class with its share in the row's leaf (class probabilities)."""
    return df.withColumns(shares(tree, classes, out, depth))


def leaf_groups(tree: Tree) -> list[tuple[dict[str, Spans], Leaf]]:
    """For each leaf the bins that each feature may have there: all conditions on a feature as one list of spans."""
    def walk(t: Tree, held: dict[str, set[int] | None]) -> Iterator[tuple[dict[str, Spans], Leaf]]:
        if isinstance(t, Leaf):
            yield {f: to_spans(list(b)) for f, b in held.items()}, t
            return
        for spans, c in zip(t.branches, t.children, strict=True):
            bins = {b for lo, hi in spans for b in range(lo, hi + 1)}
            yield from walk(c, held | {t.feature: bins & held[t.feature] if t.feature in held else bins})

    return list(walk(tree, {}))


def group_table(spark: SparkSession, tree: Tree) -> DataFrame:
    """leaf, feature, spans, prediction, n: the leaf groups as rows; a tree of one leaf has one row of a null feature."""
    rows = []
    for i, (held, leaf) in enumerate(leaf_groups(tree)):
        for f, spans in held.items() or [(None, None)]:
            rows.append((i, f, spans, str(leaf.prediction), float(sum(leaf.counts.values()))))
    return spark.createDataFrame(rows, "leaf int, feature string, spans array<struct<lo:int,hi:int>>, prediction string, n double")


def latex(tree: Tree, edges: dict[str, list[float]] | None = None) -> str:
    """The tree for LaTeX's forest package: a node for each split, branches labelled by their conditions."""
    def safe(x: object) -> str:
        return re.sub(r"([#$%&_{}])", r"\\\1", str(x)).replace("<=", r"$\le$").replace("<", "$<$")

    def of(t: Tree, label: str) -> str:
        edge = f", edge label={{node[midway]{{{safe(label)}}}}}" if label else ""
        if isinstance(t, Leaf):
            return f"[{{{safe(t.prediction)}}}{edge}]"
        inner = " ".join(of(c, condition(t.feature, s, (edges or {}).get(t.feature))) for s, c in zip(t.branches, t.children, strict=True))
        return f"[{{{safe(t.feature)}}}{edge} {inner}]"

    return f"\\begin{{forest}}\n{of(tree, '')}\n\\end{{forest}}"


def summarised(tree: Tree) -> Tree:
    """Children that split the same feature as their parent are taken up into it: their branches, cut to the bins that
    reach them, become the parent's. Predictions of bins that the splits name stay the same."""
    if isinstance(tree, Leaf):
        return tree
    spans, children = [], []
    for s, c in zip(tree.branches, map(summarised, tree.children), strict=True):
        if isinstance(c, Split) and c.feature == tree.feature:
            for bins in ([b for lo, hi in s for b in range(lo, hi + 1)],):
                for k, g in enumerate(c.children):
                    if inside := [b for b in bins if route(c, b) == k]:
                        spans.append(to_spans(inside))
                        children.append(g)
        else:
            spans.append(s)
            children.append(c)
    return Split(tree.feature, spans, children, tree.prediction, tree.loss, tree.counts)


def nodes(tree: Tree) -> Iterator[tuple[int, int | None, int | None, int, Tree]]:
    """(node, parent, branch, depth, subtree), parents first."""
    todo: list[tuple[int | None, int | None, int, Tree]] = [(None, None, 0, tree)]
    n = 0
    while todo:
        parent, branch, depth, t = todo.pop(0)
        yield n, parent, branch, depth, t
        if isinstance(t, Split):
            todo += [(n, k, depth + 1, c) for k, c in enumerate(t.children)]
        n += 1


NODE_TABLE = "node int, parent int, branch int, depth int, feature string, spans array<struct<lo:int,hi:int>>, prediction string, loss double, n double"


def node_table(spark: SparkSession, tree: Tree) -> DataFrame:
    """A row for each node; spans are those of the parent's branch that lead to it."""
    by_id = {n: t for n, _, _, _, t in nodes(tree)}
    rows = []
    for n, parent, branch, depth, t in nodes(tree):
        spans = by_id[parent].branches[branch] if parent is not None else None
        rows.append((n, parent, branch, depth, t.feature if isinstance(t, Split) else None, spans, str(t.prediction), float(t.loss), float(sum(t.counts.values()))))
    return spark.createDataFrame(rows, NODE_TABLE)


def predict(df: DataFrame, tree: Tree, out: str = "predicted", depth: int | None = None, most: int = 200) -> DataFrame:
    """Adds the prediction: a CASE for up to ``most`` leaves; beyond that a walk through the node table, a level a join,
    as nested CASEs would outgrow what the JVM compiles."""
    if statistics(tree)["leaves"] <= most:
        return df.withColumn(out, expression(tree, depth=depth))
    return _walk(df, tree, out, depth)


def _walk(df: DataFrame, tree: Tree, out: str, depth: int | None) -> DataFrame:
    edges, values = [], []
    by_id = {n: t for n, _, _, _, t in nodes(tree)}
    child = {(p, b): n for n, p, b, _, _ in nodes(tree)}
    for n, t in by_id.items():
        values.append((n, t.feature if isinstance(t, Split) else None, t.prediction.item() if hasattr(t.prediction, "item") else t.prediction))
        if isinstance(t, Split):
            low = None
            for top, k in cuts(t.branches):
                edges.append((n, low, top, child[n, k]))
                low = top
    kind = _type_of([v for *_, v in values])
    if kind == "double":
        values = [(n, f, None if v is None else float(v)) for n, f, v in values]
    spark = df.sparkSession
    info = F.broadcast(spark.createDataFrame(values, f"_n int, _feature string, _value {kind}"))  # bounded by the tree
    steps = F.broadcast(spark.createDataFrame(edges, "_n int, _lo int, _hi int, _next int"))
    features = sorted({t.feature for t in by_id.values() if isinstance(t, Split)})
    whole = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row")  # so that no column of df clashes with those of the walk
    walked = df.select(whole, F.lit(0).alias("_n"), F.create_map(*(x for f in features for x in (F.lit(f), F.col(f"`{f}`").cast("int")))).alias("_bins"))
    for _ in range(min(statistics(tree)["depth"], depth if depth is not None else 1 << 30)):
        at = walked.join(info.drop("_value"), "_n").withColumn("_b", F.col("_bins")[F.col("_feature")])
        hit = (at["_n"] == steps["_n"]) & (F.coalesce(at["_b"] > steps["_lo"], steps["_lo"].isNull() & at["_b"].isNotNull())) & (F.coalesce(at["_b"] <= steps["_hi"], steps["_hi"].isNull()))
        walked = at.join(steps, hit, "left").withColumn("_to", F.coalesce("_next", at["_n"])).select("_row", "_bins", F.col("_to").alias("_n"))
    return walked.join(info, "_n").select("_row", "_value").select(*(F.col("_row").getField(c).alias(c) for c in df.columns if c != out), F.col("_value").alias(out))


def _type_of(predictions: list) -> str:
    """The type that holds the predictions of all nodes: of several targets an array."""
    known = [p for p in predictions if p is not None]
    if known and all(isinstance(p, (list, tuple)) for p in known):
        return f"array<{_type_of([x for p in known for x in p])}>"
    if all(isinstance(p, bool) for p in known):
        return "boolean"
    if all(isinstance(p, int) for p in known):
        return "int" if all(-(1 << 31) <= p < 1 << 31 for p in known) else "long"
    return "string" if any(isinstance(p, str) for p in known) else "double"


def statistics(tree: Tree) -> dict[str, int]:
    leaves = internal = arity = scattered = deepest = 0
    for _, _, _, depth, t in nodes(tree):
        deepest = max(deepest, depth)
        if isinstance(t, Leaf):
            leaves += 1
        else:
            internal += 1
            arity = max(arity, len(t.children))
            scattered += sum(len(s) > 1 for s in t.branches)
    return {"leaves": leaves, "internal": internal, "depth": deepest, "max_arity": arity, "non_contiguous": scattered}


def condition(feature: str, spans: Spans, edges: list[float] | None = None) -> str:
    """Text of a branch, in values where the feature's edges are given."""
    def part(lo: int, hi: int) -> str:
        if edges is None:
            return f"{feature} = {lo}" if lo == hi else f"{lo} <= {feature} <= {hi}"
        low = f"{number(edges[lo - 1])} <= " if lo > 0 else ""
        high = f" < {number(edges[hi])}" if hi < len(edges) else ""
        return f"{low}{feature}{high}" if low or high else "any"

    return " or ".join(part(lo, hi) for lo, hi in spans)


def rules(tree: Tree, edges: dict[str, list[float]] | None = None) -> list[tuple[str, object]]:
    """(conjunction, prediction) of each leaf."""
    def walk(t: Tree, path: list[str]) -> Iterator[tuple[str, object]]:
        if isinstance(t, Leaf):
            yield " and ".join(path) or "true", t.prediction
            return
        for spans, c in zip(t.branches, t.children, strict=True):
            yield from walk(c, [*path, condition(t.feature, spans, (edges or {}).get(t.feature))])

    return list(walk(tree, []))


def text(tree: Tree, edges: dict[str, list[float]] | None = None, indent: str = "") -> str:
    if isinstance(tree, Leaf):
        return f"{indent}predict {tree.prediction}\n"
    return "".join(f"{indent}if {condition(tree.feature, s, (edges or {}).get(tree.feature))}:\n{text(c, edges, indent + '  ')}" for s, c in zip(tree.branches, tree.children, strict=True))


def to_dict(tree: Tree) -> dict:
    own = {"prediction": tree.prediction, "loss": tree.loss, "counts": tree.counts}
    if isinstance(tree, Split):
        own |= {"feature": tree.feature, "branches": [{"spans": s, "child": to_dict(c)} for s, c in zip(tree.branches, tree.children, strict=True)]}
    return own


def from_dict(d: dict) -> Tree:
    if "feature" not in d:
        return Leaf(d["prediction"], d["loss"], d["counts"])
    return Split(d["feature"], [[tuple(x) for x in b["spans"]] for b in d["branches"]], [from_dict(b["child"]) for b in d["branches"]], d["prediction"], d["loss"], d["counts"])


def merged(tree: Tree) -> Tree:
    """Branches with equal subtrees become one, and a split with one branch its child; predictions stay the same."""
    if isinstance(tree, Leaf):
        return tree
    groups: list[tuple[dict, list[Spans], Tree]] = []
    for s, c in zip(tree.branches, tree.children, strict=True):
        c = merged(c)
        shape = _shape(c)
        for k, (other, spans, _) in enumerate(groups):
            if other == shape:
                groups[k][1].append(s)
                break
        else:
            groups.append((shape, [s], c))
    if len(groups) == 1:
        return groups[0][2]
    branches = [to_spans([b for spans in g for lo, hi in spans for b in range(lo, hi + 1)]) for _, g, _ in groups]
    return Split(tree.feature, branches, [c for *_, c in groups], tree.prediction, tree.loss, tree.counts)


def _shape(t: Tree) -> object:
    return t.prediction if isinstance(t, Leaf) else (t.feature, t.branches, [_shape(c) for c in t.children])


def same(a: Tree, b: Tree) -> bool:
    return _shape(a) == _shape(b)


def svg(tree: Tree, edges: dict[str, list[float]] | None = None, wide: int = 120, high: int = 70) -> str:
    """A drawing of the tree: leaves from left to right, a split above the middle of its children."""
    shapes: list[str] = []
    leaves = 0

    def safe(x: object) -> str:
        return html.escape(str(x))

    def draw(t: Tree, depth: int) -> float:
        nonlocal leaves
        y = high * (depth + 0.5)
        if isinstance(t, Leaf):
            leaves += 1
            x = wide * (leaves - 0.5)
        else:
            at = [draw(c, depth + 1) for c in t.children]
            x = (at[0] + at[-1]) / 2
            for cx, spans in zip(at, t.branches, strict=True):
                shapes.append(f'<line x1="{x:g}" y1="{y:g}" x2="{cx:g}" y2="{y + high:g}" stroke="#888"/>')
                shapes.append(f'<text x="{(x + cx) / 2:g}" y="{y + high / 2:g}" font-size="9" text-anchor="middle">{safe(condition(t.feature, spans, (edges or {}).get(t.feature)))}</text>')
        label = safe(t.prediction if isinstance(t, Leaf) else t.feature)
        shapes.append(f'<rect x="{x - 0.4 * wide:g}" y="{y - 12:g}" width="{0.8 * wide:g}" height="24" fill="#fff" stroke="#333"/>')
        shapes.append(f'<text x="{x:g}" y="{y + 4:g}" font-size="12" text-anchor="middle">{label}</text>')
        return x

    draw(tree, 0)
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{wide * leaves}" height="{high * (statistics(tree)["depth"] + 1)}">{"".join(shapes)}</svg>'
