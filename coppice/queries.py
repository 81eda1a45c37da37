"""Queries over the test tables: each applies operators of this library, most with equivalent SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.functions.impurity import entropy, gini
from coppice.operators import binning, evaluate, histogram, prep, rowsets
from coppice.plans import levelwise, multiway, selection, teacher, trees
from coppice.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: The sample view: three binned features, a binary and a three-class target, a whole-number weight.
BINNED = """(SELECT *, CAST(floor((l_quantity - 1) / 10) AS INTEGER) AS qb, CAST(round(l_discount * 100) AS INTEGER) AS db,
  CAST(round(l_tax * 100) AS INTEGER) AS tb, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS y, CAST(l_quantity AS BIGINT) AS w FROM lineitem)"""
FEATURES = ["qb", "db", "tb"]
LONG = " UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS bin, y, w, l_returnflag FROM {BINNED} b" for f in FEATURES)
HIST = f"(SELECT feature, bin, sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS n0, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS n1 FROM ({LONG}) l GROUP BY feature, bin)"
PREFIX = f"""(SELECT *, sum(n0) OVER (PARTITION BY feature ORDER BY bin) AS c0, sum(n1) OVER (PARTITION BY feature ORDER BY bin) AS c1,
  sum(n0) OVER (PARTITION BY feature) AS t0, sum(n1) OVER (PARTITION BY feature) AS t1 FROM {HIST} h)"""


def sql_gini(a: str, b: str) -> str:
    return f"(CASE WHEN ({a}) + ({b}) > 0 THEN ({a}) + ({b}) - (({a}) * ({a}) + ({b}) * ({b})) / CAST(({a}) + ({b}) AS DOUBLE) ELSE 0 END)"


def sql_entropy(a: str, b: str) -> str:
    def term(x: str) -> str:
        return f"CASE WHEN ({x}) > 0 THEN -(({x}) / CAST(({a}) + ({b}) AS DOUBLE)) * log2(({x}) / CAST(({a}) + ({b}) AS DOUBLE)) ELSE 0 END"

    return f"({term(a)} + {term(b)})"


def binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumns({
        "qb": F.floor((F.col("l_quantity") - 1) / 10).cast("int"), "db": F.round(F.col("l_discount") * 100).cast("int"),
        "tb": F.round(F.col("l_tax") * 100).cast("int"), "y": (F.col("l_linestatus") == "O").cast("int"), "w": F.col("l_quantity").cast("long"),
    })


def hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.binary_histogram(binned(spark, sf_dir), FEATURES, "y")


# --- preparation


@query("SELECT o_orderstatus AS label, CAST(row_number() OVER (ORDER BY o_orderstatus) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT o_orderstatus FROM orders)")
def label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.label_codes(table(spark, sf_dir, "orders"), "o_orderstatus")


PROFILED = ["l_linestatus", "l_returnflag", "l_linenumber", "l_quantity", "l_discount"]


@query("SELECT feature, count(DISTINCT v) AS n_distinct, CAST(sum(CASE WHEN v IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_null, "
       "CASE WHEN count(DISTINCT v) <= 1 THEN 'redundant' WHEN count(DISTINCT v) = 2 THEN 'binary' WHEN bool_and(regexp_full_match(v, '[+-]?[0-9]+([.]0+)?')) THEN 'integral' "
       "WHEN bool_and(regexp_full_match(v, '[+-]?[0-9]*[.]?[0-9]+')) THEN 'rational' ELSE 'categorical' END AS kind FROM ("
       + " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS v FROM lineitem" for c in PROFILED) + ") GROUP BY feature")
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.column_profile(table(spark, sf_dir, "lineitem"), PROFILED)


@query("WITH t AS (SELECT *, nullif(l_tax, 0.05) AS x FROM lineitem), m AS (SELECT quantile_cont(x, 0.5) AS m FROM t) SELECT l_linenumber, round(sum(coalesce(x, m)), 4) AS total, count(*) AS n FROM t, m GROUP BY l_linenumber")
def median_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").withColumn("x", F.expr("nullif(l_tax, 0.05)"))
    return prep.impute_median(t, ["x"]).groupBy("l_linenumber").agg(F.round(F.sum("x"), 4).alias("total"), F.count(F.lit(1)).alias("n"))


@query("WITH t AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS s FROM customer), "
       "m AS (SELECT s AS mode FROM t WHERE s IS NOT NULL GROUP BY s ORDER BY count(*) DESC, s LIMIT 1) SELECT c_custkey, coalesce(s, mode) AS s FROM t, m")  # fmt: skip
def mode_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("s"))
    return prep.impute_mode(t, "s")


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _one_hot(spark: SparkSession, sf_dir: str, drop_first: bool) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    wide = prep.one_hot(orders, "o_orderpriority", prep.categories(orders, "o_orderpriority"), drop_first)
    columns = [c for c in wide.columns if "__" in c]
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").alias("v")) for c in columns))).alias("s")
    return wide.select(pairs).groupBy("s.feature").agg(F.sum("s.v").alias("ones"), F.count(F.lit(1)).alias("n"))


@query("SELECT 'o_orderpriority__' || o_orderpriority AS feature, count(*) AS ones, (SELECT count(*) FROM orders) AS n FROM orders GROUP BY o_orderpriority")
def one_hot_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one_hot(spark, sf_dir, False)


@query("SELECT 'o_orderpriority__' || o_orderpriority AS feature, count(*) AS ones, (SELECT count(*) FROM orders) AS n FROM orders "
       "WHERE o_orderpriority <> (SELECT min(o_orderpriority) FROM orders) GROUP BY o_orderpriority")  # fmt: skip
def one_hot_drop_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one_hot(spark, sf_dir, True)


@query("SELECT p_partkey, round((p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT stddev_pop(p_retailprice) FROM part), 6) AS z FROM part")
def standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.standardise(table(spark, sf_dir, "part"), ["p_retailprice"]).select("p_partkey", F.round("p_retailprice", 6).alias("z"))


RANKED = "SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('7:' || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders"


@query(f"SELECT o_orderkey, CASE WHEN r <= floor(n * 0.2 + 0.5) THEN 'test' WHEN r <= floor(n * 0.2 + 0.5) + floor(n * 0.1 + 0.5) THEN 'val' ELSE 'fit' END AS split FROM ({RANKED})")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.stratified_split(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderstatus", seed=7).select("o_orderkey", "split")


@query(f"SELECT o_orderkey, CAST((r - 1) % 5 AS INTEGER) AS fold FROM ({RANKED})")
def stratified_kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.stratified_folds(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderstatus", 5, seed=7).select("o_orderkey", "fold")


@query("WITH c AS (SELECT o_orderstatus AS label, count(*) AS n, count(*) * 0.37 AS x FROM orders GROUP BY 1), t AS (SELECT CAST(floor(sum(n) * 0.37 + 0.5) AS BIGINT) - CAST(sum(floor(x)) AS BIGINT) AS extra FROM c) "
       "SELECT label, n, CAST(floor(x) AS BIGINT) + CASE WHEN row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, label) <= extra THEN 1 ELSE 0 END AS taken FROM c, t")  # fmt: skip
def largest_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.largest_remainder(table(spark, sf_dir, "orders"), "o_orderstatus", 0.37)


@query("SELECT o_orderkey, CASE WHEN o_totalprice >= (SELECT quantile_cont(o_totalprice, 0.5) FROM orders) THEN 1 ELSE 0 END AS high FROM orders")
def median_binarize_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.binarise_at_median(table(spark, sf_dir, "orders"), "o_totalprice", "high").select("o_orderkey", "high")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('3:' || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS r FROM orders) WHERE r <= 100")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.top_per_class(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderstatus", 100, seed=3).select("o_orderkey")


@query("SELECT 'full' AS variant, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer UNION ALL SELECT 'c_mktsegment=' || c_mktsegment, count(*), round(sum(c_acctbal), 2) FROM customer GROUP BY c_mktsegment")
def subset_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.variants(table(spark, sf_dir, "customer"), "c_mktsegment").groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("SELECT d.doc_id, source FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NOT NULL AND source IS NOT NULL")
def drop_null_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.dropna("any").select("doc_id", "source")


@query("SELECT DISTINCT c_mktsegment AS raw, regexp_replace(trim('  ' || c_mktsegment || '.. '), '[.]+$', '') AS clean FROM customer")
def string_clean_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select(raw.alias("raw"), prep.clean_label(F.concat(F.lit("  "), raw, F.lit(".. "))).alias("clean")).distinct()


@query("SELECT kind, count(*) AS n, CAST(sum(key) AS BIGINT) AS keys FROM (SELECT 'customer' AS kind, c_custkey AS key FROM customer UNION ALL SELECT 'supplier', s_suppkey FROM supplier) GROUP BY kind")
def union_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("key"))
    b = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("key"))
    return a.unionByName(b).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("key").alias("keys"))


# --- bins


@query("WITH v AS (SELECT DISTINCT 'l_discount' AS feature, l_discount AS v FROM lineitem UNION SELECT DISTINCT 'l_tax', l_tax FROM lineitem), n AS (SELECT feature, v, lead(v) OVER (PARTITION BY feature ORDER BY v) AS n FROM v) "
       "SELECT feature, round((v + n) / 2, 9) AS threshold FROM n WHERE n IS NOT NULL")  # fmt: skip
def midpoint_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binning.midpoints(table(spark, sf_dir, "lineitem"), ["l_discount", "l_tax"]).select("feature", F.round("threshold", 9).alias("threshold"))


@query("WITH v AS (SELECT DISTINCT l_tax AS v FROM lineitem), t AS (SELECT (v + lead(v) OVER (ORDER BY v)) / 2 AS t FROM v) "
       "SELECT round(t, 6) AS threshold, count(CASE WHEN l_tax <= t THEN 1 END) AS ones FROM t, lineitem WHERE t IS NOT NULL GROUP BY 1")  # fmt: skip
def numeric_binarize(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    ts = binning.thresholds_of(li, ["l_tax"])
    wide = binning.binarise(li, ts).agg(F.array(*(F.struct(F.lit(round(t, 6)).alias("threshold"), F.sum(F.col(f"`{binning.column_of('l_tax', t)}`")).alias("ones")) for t in ts["l_tax"])).alias("a"))
    return wide.select(F.explode("a").alias("s")).select("s.*")


@query("SELECT l_tax AS value, count(*) AS n FROM lineitem GROUP BY l_tax")
def binarize_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    ts = binning.thresholds_of(li, ["l_tax"])
    values = sorted(r[0] for r in li.select("l_tax").distinct().collect())
    back = binning.unbinarise(binning.binarise(li, ts).drop("l_tax"), "l_tax", values, ts["l_tax"], "value")
    return back.groupBy("value").agg(F.count(F.lit(1)).alias("n"))


QUANTILES = "[" + ", ".join(str(i / 8) for i in range(1, 8)) + "]"
EDGES = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, unnest(q) AS edge, lo, hi FROM (SELECT quantile_cont({c}, {QUANTILES}) AS q, min({c}) AS lo, max({c}) AS hi FROM {t})" for t, c in (("events", "value"), ("part", "p_retailprice"))
)


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = binning.quantile_edges(table(spark, sf_dir, "events"), ["value"], 8)
    return a.unionByName(binning.quantile_edges(table(spark, sf_dir, "part"), ["p_retailprice"], 8))


@query(f"SELECT DISTINCT feature, round(edge, 2) AS edge FROM ({EDGES}) WHERE edge > lo AND edge < hi")
def quantile_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).select("feature", F.explode("edges").alias("e")).select("feature", F.round("e", 2).alias("edge")).distinct()


@query("SELECT e.event_id, CAST((CASE WHEN value >= 1 THEN 1 ELSE 0 END) + (CASE WHEN value >= 10 THEN 1 ELSE 0 END) + (CASE WHEN value >= 50 THEN 1 ELSE 0 END) + (CASE WHEN value >= 100 THEN 1 ELSE 0 END) AS INTEGER) AS bin FROM events e")
def digitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binning.digitise(table(spark, sf_dir, "events"), {"value": [1.0, 10.0, 50.0, 100.0]}).select("event_id", F.col("value_bin").alias("bin"))


@query("WITH b AS (SELECT p_retailprice AS v, CAST((CASE WHEN p_retailprice >= 950 THEN 1 ELSE 0 END) + (CASE WHEN p_retailprice >= 1000 THEN 1 ELSE 0 END) + (CASE WHEN p_retailprice >= 900000 THEN 1 ELSE 0 END) AS INTEGER) AS bin FROM part), "
       "e(bin, e) AS (VALUES (0, 950.0), (1, 975.0), (2, 450500.0), (3, 900000.0)) SELECT e.bin, round(coalesce(avg(v), any_value(e)), 4) AS representative FROM e LEFT JOIN b ON b.bin = e.bin GROUP BY e.bin")  # fmt: skip
def bin_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = [950.0, 1000.0, 900000.0]
    parts = binning.digitise(table(spark, sf_dir, "part"), {"p_retailprice": edges})
    return binning.representatives(parts, "p_retailprice", "p_retailprice_bin", edges).select("bin", F.round("representative", 4).alias("representative"))


@query("WITH e(boundary, e) AS (VALUES (0, 5.0), (1, 20.0), (2, 60.0)) SELECT event_id, boundary FROM (SELECT event_id, boundary, row_number() OVER (PARTITION BY event_id ORDER BY abs(value - e), boundary) AS r FROM events, e) WHERE r = 1")
def nearest_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "events").select("event_id", F.lit("value").alias("feature"), F.col("value").alias("v"))
    edges = spark.createDataFrame([("value", [5.0, 20.0, 60.0])], "feature string, edges array<double>")
    return binning.nearest_boundary(values, F.broadcast(edges)).select("event_id", "boundary")


PURE = "CASE WHEN n1 = 0 THEN 0 WHEN n0 = 0 THEN 1 END"
DAYS = "(SELECT 'day' AS feature, CAST(date_part('day', ts) AS INTEGER) AS bin, CAST(sum(CASE WHEN value >= 150 THEN 0 ELSE 1 END) AS BIGINT) AS n0, CAST(sum(CASE WHEN value >= 150 THEN 1 ELSE 0 END) AS BIGINT) AS n1 FROM events GROUP BY 2)"


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.dayofmonth("ts").alias("day"), (F.col("value") >= 150).cast("int").alias("y"))
    return histogram.binary_histogram(e, ["day"], "y")


@query(f"WITH m AS (SELECT *, {PURE} AS p FROM {DAYS} d), i AS (SELECT *, CASE WHEN lag(p) OVER (PARTITION BY feature ORDER BY bin) = p THEN 0 ELSE 1 END AS new FROM m), a AS (SELECT *, sum(new) OVER (PARTITION BY feature ORDER BY bin) - 1 AS atom FROM i) "
       "SELECT feature, CAST(atom AS BIGINT) AS atom, min(bin) AS lo, max(bin) AS hi, CAST(sum(n0) AS BIGINT) AS n0, CAST(sum(n1) AS BIGINT) AS n1 FROM a GROUP BY feature, atom")  # fmt: skip
def pure_run_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binning.merge_pure_runs(days(spark, sf_dir))


@query(f"WITH i AS (SELECT *, CASE WHEN lag(n0) OVER w * n1 = lag(n1) OVER w * n0 THEN 0 ELSE 1 END AS new FROM {DAYS} d WINDOW w AS (PARTITION BY feature ORDER BY bin)), a AS (SELECT *, sum(new) OVER (PARTITION BY feature ORDER BY bin) - 1 AS atom FROM i) "
       "SELECT feature, CAST(atom AS BIGINT) AS atom, min(bin) AS lo, max(bin) AS hi, CAST(sum(n0) AS BIGINT) AS n0, CAST(sum(n1) AS BIGINT) AS n1 FROM a GROUP BY feature, atom")  # fmt: skip
def proportional_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binning.merge_proportional(days(spark, sf_dir))


Z = 1.959963984540054
WILSON = f"(n1 / n + {Z * Z} / (2 * n)) / (1 + {Z * Z} / n)", f"{Z} * sqrt(n1 / n * (1 - n1 / n) / n + {Z * Z} / (4 * n * n)) / (1 + {Z * Z} / n)"


@query(f"WITH r AS (SELECT feature, bin, n1 / n AS p, {WILSON[0]} - {WILSON[1]} AS lo, {WILSON[0]} + {WILSON[1]} AS hi FROM (SELECT feature, bin, CAST(n1 AS DOUBLE) AS n1, CAST(n0 + n1 AS DOUBLE) AS n FROM {HIST} h)), "
       "q AS (SELECT *, lead(lo) OVER w AS lo2, lead(hi) OVER w AS hi2, lead(p) OVER w AS p2 FROM r WINDOW w AS (PARTITION BY feature ORDER BY bin)) "
       "SELECT feature, bin, CASE WHEN lo <= hi2 AND lo2 <= hi THEN 1 ELSE 0 END AS overlap, round(abs(p - p2), 6) AS tv FROM q WHERE lo2 IS NOT NULL")  # fmt: skip
def wilson_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binning.wilson_neighbours(hist(spark, sf_dir)).withColumn("tv", F.round("tv", 6))


def sql_apart(k: str, n: str, k2: str, n2: str) -> str:
    """Whether the score intervals of k of n and of k2 of n2 do not meet."""
    def at(k: str, n: str, sign: str) -> str:
        p = f"({k} / CAST({n} AS DOUBLE))"
        return f"(({p} + {Z * Z} / (2.0 * {n})) {sign} {Z} * sqrt({p} * (1 - {p}) / {n} + {Z * Z} / (4.0 * {n} * {n}))) / (1 + {Z * Z} / {n})"

    return f"({at(k, n, '-')} > {at(k2, n2, '+')} OR {at(k2, n2, '-')} > {at(k, n, '+')})"


APART = sql_apart("s.n1", "(s.n0 + s.n1)", "h.n1", "(h.n0 + h.n1)")


@query(f"WITH RECURSIVE h AS (SELECT feature, bin, CAST(n0 AS BIGINT) AS n0, CAST(n1 AS BIGINT) AS n1, row_number() OVER (PARTITION BY feature ORDER BY bin) AS r FROM {HIST} x), "
       "s AS (SELECT feature, r, bin AS lo, bin AS hi, n0, n1, CAST(0 AS BIGINT) AS atom FROM h WHERE r = 1 UNION ALL "
       f"SELECT s.feature, h.r, CASE WHEN {APART} THEN h.bin ELSE s.lo END, h.bin, CASE WHEN {APART} THEN h.n0 ELSE s.n0 + h.n0 END, CASE WHEN {APART} THEN h.n1 ELSE s.n1 + h.n1 END, "
       f"CASE WHEN {APART} THEN s.atom + 1 ELSE s.atom END FROM s JOIN h ON h.feature = s.feature AND h.r = s.r + 1) "
       "SELECT feature, atom, lo, hi, n0, n1 FROM s QUALIFY row_number() OVER (PARTITION BY feature, atom ORDER BY r DESC) = 1")  # fmt: skip
def confidence_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binning.merged_by(binning.merge_by_confidence, hist(spark, sf_dir))


LOGS = "ln(1 + n0) AS a, ln(1 + n0 + n1) AS b, ln(1 + abs(n0 - n1)) AS c"


@query(f"WITH l AS (SELECT feature, bin, {LOGS} FROM {HIST} h), m AS (SELECT *, max(a) OVER w AS ma, max(b) OVER w AS mb, max(c) OVER w AS mc FROM l WINDOW w AS (PARTITION BY feature)) "
       f"SELECT feature, bin, round(({' + '.join(f'CASE WHEN m{x} > 1e-12 THEN {x} / m{x} ELSE 0 END' for x in 'abc')}) / 3, 6) AS strength FROM m")  # fmt: skip
def relative_strengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    priors = hist(spark, sf_dir).select("feature", "bin", F.col("n0").alias("gain"), (F.col("n0") + F.col("n1")).alias("cover"), F.abs(F.col("n0") - F.col("n1")).alias("jump"))
    return teacher.relative_strengths(priors).select("feature", "bin", F.round("strength", 6).alias("strength"))



@query("WITH b AS (SELECT DISTINCT event_type, CAST(date_part('hour', ts) AS INTEGER) AS bin FROM events WHERE value > 140), i AS (SELECT *, bin - row_number() OVER (PARTITION BY event_type ORDER BY bin) AS i FROM b) SELECT event_type, min(bin) AS lo, max(bin) AS hi FROM i GROUP BY event_type, i")
def bins_to_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "events").where("value > 140").select("event_type", F.hour("ts").alias("bin")).distinct()
    return binning.spans(b, ["event_type"])


# --- histograms, impurities, bounds


@query(f"SELECT feature, bin, l_returnflag AS y, count(*) AS n, count(*) AS weight FROM ({LONG}) l GROUP BY feature, bin, l_returnflag")
def class_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.class_histogram(binned(spark, sf_dir), FEATURES, "l_returnflag")


@query(f"SELECT feature, bin, y, count(*) AS n, CAST(sum(w) AS BIGINT) AS weight FROM ({LONG}) l GROUP BY feature, bin, y")
def weighted_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.class_histogram(binned(spark, sf_dir), FEATURES, "y", "w")


@query(f"SELECT feature, bin, CAST(c0 AS BIGINT) AS c0, CAST(c1 AS BIGINT) AS c1 FROM {PREFIX} p")
def prefix_class_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.prefix_sums(hist(spark, sf_dir)).select("feature", "bin", "c0", "c1")


NODE = f"SELECT l_returnflag, y, count(*) AS n, sum(w) AS w, sum(w * w) AS w2 FROM {BINNED} b GROUP BY l_returnflag, y"


@query(f"WITH c AS ({NODE}), a AS (SELECT sum(w) AS t FROM c) SELECT l_returnflag, CAST(sum(n) AS BIGINT) AS n, CAST(sum(w) AS BIGINT) AS weight, round((sum(w) - max(w)) / CAST(any_value(t) AS DOUBLE) + 0.01, 9) AS objective, "
       "CAST(CASE WHEN sum(CASE WHEN y = 1 THEN w ELSE 0 END) > sum(CASE WHEN y = 0 THEN w ELSE 0 END) THEN 1 ELSE 0 END AS INTEGER) AS prediction FROM c, a GROUP BY l_returnflag")  # fmt: skip
def leaf_solution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.node_statistics(binned(spark, sf_dir), ["l_returnflag"], "y", "w", 0.01).select("l_returnflag", "n", "weight", F.round("objective", 9).alias("objective"), "prediction")


@query(f"SELECT qb, db, count(*) AS n_classes, CASE WHEN count(*) = 1 THEN 1 ELSE 0 END AS pure FROM (SELECT DISTINCT qb, db, y FROM {BINNED} b) GROUP BY qb, db")
def node_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.node_statistics(binned(spark, sf_dir), ["qb", "db"], "y", "w").select("qb", "db", "n_classes", (F.col("n_classes") == 1).cast("int").alias("pure"))


@query(f"SELECT l_returnflag, round(sum(w2) / CAST(sum(w) * sum(w) AS DOUBLE), 12) AS effective_unit FROM ({NODE}) GROUP BY l_returnflag")
def effective_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.node_statistics(binned(spark, sf_dir), ["l_returnflag"], "y", "w").select("l_returnflag", F.round("effective_unit", 12).alias("effective_unit"))


@query(f"SELECT feature, bin, round({sql_gini('n0', 'n1')}, 6) AS gini_mass, CAST(least(n0, n1) AS BIGINT) AS loss FROM {HIST} h")
def gini_per_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.bin_impurities(hist(spark, sf_dir)).withColumn("gini_mass", F.round("gini_mass", 6))


@query(f"SELECT l_returnflag, round({sql_entropy('n0', 'n1')}, 6) AS entropy, round({sql_gini('n0', 'n1')} / (n0 + n1), 6) AS gini FROM (SELECT l_returnflag, sum(1 - y) AS n0, sum(y) AS n1 FROM {BINNED} b GROUP BY l_returnflag)")
def entropy_per_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = binned(spark, sf_dir).groupBy("l_returnflag").agg(F.sum(1 - F.col("y")).alias("n0"), F.sum("y").alias("n1"))
    return g.select("l_returnflag", F.round(entropy(F.col("n0"), F.col("n1")), 6).alias("entropy"), F.round(gini(F.col("n0"), F.col("n1")), 6).alias("gini"))


GAIN = (f"{sql_entropy('t0', 't1')} - (c0 + c1) / CAST(t0 + t1 AS DOUBLE) * {sql_entropy('c0', 'c1')} - (t0 - c0 + t1 - c1) / CAST(t0 + t1 AS DOUBLE) * {sql_entropy('t0 - c0', 't1 - c1')}")


@query(f"SELECT feature, bin, round({GAIN}, 7) AS gain, round({sql_gini('c0', 'c1')} + {sql_gini('t0 - c0', 't1 - c1')}, 5) AS gini, CAST(least(c0, c1) + least(t0 - c0, t1 - c1) AS BIGINT) AS loss FROM {PREFIX} p WHERE t0 - c0 + t1 - c1 > 0")
def threshold_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.threshold_splits(hist(spark, sf_dir)).withColumns({"gain": F.round("gain", 7), "gini": F.round("gini", 5)})


@query(f"SELECT feature, bin FROM (SELECT feature, bin, row_number() OVER (ORDER BY round({GAIN}, 9) DESC, feature, bin) AS r FROM {PREFIX} p WHERE t0 - c0 + t1 - c1 > 0) WHERE r = 1")
def best_info_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.best_threshold(hist(spark, sf_dir)).select("feature", "bin")


TWO = f"SELECT feature, bin AS cut1, CAST(least(c0, c1) + least(t0 - c0, t1 - c1) AS BIGINT) AS loss, {sql_gini('c0', 'c1')} + {sql_gini('t0 - c0', 't1 - c1')} AS gini FROM {PREFIX} p WHERE t0 - c0 + t1 - c1 > 0"
THREE = (f"SELECT a.feature, a.bin AS cut1, b.bin AS cut2, CAST(least(a.c0, a.c1) + least(b.c0 - a.c0, b.c1 - a.c1) + least(b.t0 - b.c0, b.t1 - b.c1) AS BIGINT) AS loss, "
         f"{sql_gini('a.c0', 'a.c1')} + {sql_gini('b.c0 - a.c0', 'b.c1 - a.c1')} + {sql_gini('b.t0 - b.c0', 'b.t1 - b.c1')} AS gini FROM {PREFIX} a JOIN {PREFIX} b ON a.feature = b.feature AND a.bin < b.bin WHERE b.t0 - b.c0 + b.t1 - b.c1 > 0")  # fmt: skip


@query(f"SELECT feature, cut1, loss, round(gini, 5) AS gini FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY loss, round(gini, 6), cut1) AS r FROM ({TWO})) WHERE r = 1")
def two_group_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.best_partition(hist(spark, sf_dir), 2).withColumn("gini", F.round("gini", 5))


@query(f"SELECT feature, cut1, cut2, loss, round(gini, 5) AS gini FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY loss, round(gini, 6), cut1, cut2) AS r FROM ({THREE})) WHERE r = 1")
def three_group_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.best_partition(hist(spark, sf_dir), 3).withColumn("gini", F.round("gini", 5))


@query(f"WITH p AS (SELECT l_returnflag, qb, db, tb, count(*) AS n, max(n1) AS top FROM (SELECT l_returnflag, qb, db, tb, y, count(*) AS n1 FROM {BINNED} b GROUP BY ALL) GROUP BY 1, 2, 3, 4), "
       f"q AS (SELECT l_returnflag, qb, db, tb, sum(n1) AS n, max(n1) AS top FROM (SELECT l_returnflag, qb, db, tb, y, count(*) AS n1 FROM {BINNED} b GROUP BY ALL) GROUP BY 1, 2, 3, 4) "
       "SELECT l_returnflag, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n - top) AS BIGINT) AS minority, round(sum(n - top) / CAST(sum(n) AS DOUBLE) + 0.01, 9) AS bound FROM q GROUP BY l_returnflag")  # fmt: skip
def signature_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.signature_bound(binned(spark, sf_dir), FEATURES, "y", 0.01, ["l_returnflag"]).withColumn("bound", F.round("bound", 9))


@query(f"WITH c AS (SELECT qb, db, tb, y, count(*) AS n FROM {BINNED} b GROUP BY qb, db, tb, y) SELECT qb, db, tb, y AS label, CAST(t AS BIGINT) AS n, CAST(t - n AS BIGINT) AS errors FROM (SELECT *, sum(n) OVER (PARTITION BY qb, db, tb) AS t, row_number() OVER (PARTITION BY qb, db, tb ORDER BY n DESC, y) AS r FROM c) WHERE r = 1")
def equivalent_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.majority_labels(binned(spark, sf_dir), FEATURES, "y")


@query(f"SELECT qb, db, count(*) AS n, CAST(row_number() OVER (ORDER BY qb, db) - 1 AS INTEGER) AS pattern FROM {BINNED} b GROUP BY qb, db")
def row_pattern_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.pattern_ids(binned(spark, sf_dir), ["qb", "db"])


COSTS = "SELECT p.o_orderstatus AS prediction, t.o_orderstatus AS truth, CASE WHEN p.o_orderstatus = t.o_orderstatus THEN 0.0 ELSE 1 / CAST(t.n * k AS DOUBLE) END AS cost FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1) p, (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1) t, (SELECT count(DISTINCT o_orderstatus) AS k FROM orders)"


@query(f"SELECT prediction, truth, round(cost, 12) AS cost FROM ({COSTS})")
def balanced_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.balanced_costs(table(spark, sf_dir, "orders"), "o_orderstatus").withColumn("cost", F.round("cost", 12))


@query(f"WITH c AS ({COSTS}), n AS (SELECT o_orderpriority, o_orderstatus AS truth, count(*) AS n FROM orders GROUP BY 1, 2), e AS (SELECT o_orderpriority, prediction, sum(n * cost) AS cost FROM n JOIN c USING (truth) GROUP BY 1, 2) "
       "SELECT o_orderpriority, prediction, round(cost, 9) AS cost FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY round(cost, 9), prediction) AS r FROM e) WHERE r = 1")  # fmt: skip
def cost_sensitive_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return histogram.cost_sensitive_leaf(orders, ["o_orderpriority"], "o_orderstatus", histogram.balanced_costs(orders, "o_orderstatus")).withColumn("cost", F.round("cost", 9))


FLAGS = {"big": "qb >= 3", "cheap": "db >= 5", "taxed": "tb >= 4"}
FLAGGED = f"(SELECT {', '.join(f'CASE WHEN {v} THEN 1 ELSE 0 END AS {k}' for k, v in FLAGS.items())}, y, l_returnflag FROM {BINNED} b)"


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binned(spark, sf_dir).select(*(F.expr(f"CASE WHEN {v} THEN 1 ELSE 0 END").alias(k) for k, v in FLAGS.items()), "y", "l_returnflag")


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, CAST(least(sum(CASE WHEN {a} <> {b} THEN 1 ELSE 0 END), sum(CASE WHEN {a} = {b} THEN 1 ELSE 0 END)) AS BIGINT) AS distance FROM {FLAGGED} f" for a, b in (("big", "cheap"), ("big", "taxed"), ("cheap", "taxed"))))
def feature_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.feature_distances(flagged(spark, sf_dir), list(FLAGS))


@query(f"WITH c AS (SELECT qb, db, sum(1 - y) AS n0, sum(y) AS n1 FROM {BINNED} b GROUP BY qb, db), a AS (SELECT qb, sum(n0) AS n0, sum(n1) AS n1 FROM c GROUP BY qb), d AS (SELECT db, sum(n0) AS n0, sum(n1) AS n1 FROM c GROUP BY db), "
       f"s AS (SELECT (SELECT sum({sql_gini('n0', 'n1')}) / sum(n0 + n1) FROM c) AS joint, (SELECT sum({sql_gini('n0', 'n1')}) / sum(n0 + n1) FROM a) AS single_a, (SELECT sum({sql_gini('n0', 'n1')}) / sum(n0 + n1) FROM d) AS single_b) "
       "SELECT round(joint, 8) AS joint, round(single_a, 8) AS single_a, round(single_b, 8) AS single_b, round(least(single_a, single_b) - joint, 8) AS gain FROM s")  # fmt: skip
def pairwise_partition_impurity(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = histogram.pairwise_partition_impurity(binned(spark, sf_dir), "qb", "db", "y")
    return got.select(*(F.round(c, 8).alias(c) for c in got.columns))


@query(f"WITH g AS (SELECT qb, count(*) AS n, sum(db) AS s, sum(db * db) AS q FROM {BINNED} b GROUP BY qb) SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(s) / CAST(sum(n) AS DOUBLE), 8) AS mean, round((sum(q) - sum(s * s / CAST(n AS DOUBLE))) / sum(n), 6) AS within, "
       "round(sum(s * s / CAST(n AS DOUBLE)) / sum(n) - (sum(s) / CAST(sum(n) AS DOUBLE)) * (sum(s) / CAST(sum(n) AS DOUBLE)), 6) AS between FROM g".replace("AS between", 'AS "between"'))  # fmt: skip
def partition_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = histogram.partition_variance(binned(spark, sf_dir), "qb", "db")
    return got.select("n", F.round("mean", 8).alias("mean"), F.round("within", 6).alias("within"), F.round("between", 6).alias("between"))


@query("SELECT p_partkey, round(0.5 * p_size + 0.866 * p_retailprice, 4) AS a60, round(-0.5 * p_size + 0.866 * p_retailprice, 4) AS a120 FROM part")
def pair_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = binning.line_projections(table(spark, sf_dir, "part"), "p_size", "p_retailprice", 3)
    return wide.select("p_partkey", F.round(F.col("`p_size:p_retailprice@60`"), 4).alias("a60"), F.round(F.col("`p_size:p_retailprice@120`"), 4).alias("a120"))


# --- prediction and evaluation

ROUTED = trees.Split("qb", [[(0, 1), (4, 4)], [(2, 2)]], [trees.boolean("cheap", trees.Leaf(1), trees.Leaf(0), prediction=0), trees.Leaf(1)], prediction=0)
CASE = "CASE WHEN qb <= 1 THEN {a} WHEN qb <= 3 THEN 1 ELSE {a} END"


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binned(spark, sf_dir).withColumn("cheap", (F.col("db") >= 5).cast("int"))


@query(f"SELECT qb, db, {CASE.format(a='CASE WHEN db >= 5 THEN 1 ELSE 0 END')} AS predicted, count(*) AS n FROM {BINNED} b GROUP BY 1, 2, 3")
def tree_predict_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.predict(routed(spark, sf_dir), ROUTED).groupBy("qb", "db", "predicted").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT qb, {CASE.format(a='0')} AS predicted, count(*) AS n FROM {BINNED} b GROUP BY 1, 2")
def depth_limited_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.predict(routed(spark, sf_dir), ROUTED, depth=1).groupBy("qb", "predicted").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH s(branch, lo, hi) AS (VALUES (0, 0, 1), (1, 2, 2), (0, 4, 4)) SELECT branch, count(*) AS n FROM (SELECT branch, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN qb < lo THEN lo - qb WHEN qb > hi THEN qb - hi ELSE 0 END, lo) AS r FROM (SELECT row_number() OVER () AS id, qb FROM {BINNED} b), s) WHERE r = 1 GROUP BY branch")
def nearest_span_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = trees.expression(trees.Split("qb", ROUTED.branches, [trees.Leaf(0), trees.Leaf(1)], prediction=0))
    return binned(spark, sf_dir).select(path.alias("branch")).groupBy("branch").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH s(branch, lo, hi) AS (VALUES (0, 0, 2), (1, 3, 6), (2, 7, 10)) SELECT branch, y, count(*) AS n FROM {BINNED} b JOIN s ON db BETWEEN lo AND hi GROUP BY branch, y")
def route_by_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.broadcast(spark.createDataFrame([(0, 0, 2), (1, 3, 6), (2, 7, 10)], "branch int, lo int, hi int"))
    rows = binned(spark, sf_dir)
    return rows.join(spans, F.col("db").between(F.col("lo"), F.col("hi"))).groupBy("branch", "y").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(quality AS INTEGER) AS truth, CASE WHEN n_chars >= 1000 THEN 1 ELSE 0 END AS prediction, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion(_judged(spark, sf_dir), "quality", "p")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") >= 1000).cast("int").alias("p"))
    return table(spark, sf_dir, "labels").join(docs, "doc_id")


@query("WITH c AS (SELECT count(*) AS n, sum(CASE WHEN quality = 1 AND n_chars >= 1000 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN quality = 0 AND n_chars < 1000 THEN 1 ELSE 0 END) AS tn, sum(CASE WHEN quality = 0 AND n_chars >= 1000 THEN 1 ELSE 0 END) AS fp, "
       "sum(CASE WHEN quality = 1 AND n_chars < 1000 THEN 1 ELSE 0 END) AS fn FROM labels JOIN documents USING (doc_id)) SELECT n, round((tp + tn) / CAST(n AS DOUBLE), 9) AS accuracy, round((tp / CAST(tp + fn AS DOUBLE) + tn / CAST(tn + fp AS DOUBLE)) / 2, 9) AS balanced_accuracy, round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 9) AS f1 FROM c")  # fmt: skip
def accuracy_f1_bacc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = evaluate.binary_scores(_judged(spark, sf_dir), "quality", "p")
    return got.select("n", *(F.round(c, 9).alias(c) for c in got.columns[1:]))


LEAVES = f"(SELECT db AS leaf, sum(y) AS p, sum(1 - y) AS n FROM {BINNED} b GROUP BY db)"
ROC = (f"(SELECT tpr, fpr, coalesce(lag(tpr) OVER (ORDER BY r), 0) AS tpr0, coalesce(lag(fpr) OVER (ORDER BY r), 0) AS fpr0 FROM (SELECT row_number() OVER o AS r, sum(p) OVER o / CAST(sum(p) OVER () AS DOUBLE) AS tpr, sum(n) OVER o / CAST(sum(n) OVER () AS DOUBLE) AS fpr "
       f"FROM {LEAVES} l WINDOW o AS (ORDER BY p / CAST(p + n AS DOUBLE) DESC, leaf)))")  # fmt: skip


def _leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binned(spark, sf_dir).groupBy(F.col("db").alias("leaf")).agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))


@query(f"SELECT round(sum((fpr - fpr0) * (tpr0 + tpr) / 2), 8) AS auc FROM {ROC} r")
def auc_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.auc(_leaves(spark, sf_dir)).select(F.round("auc", 8).alias("auc"))


@query(f"SELECT round(sum(CASE WHEN fpr0 < 0.3 THEN (least(fpr, 0.3) - fpr0) * (tpr0 + CASE WHEN fpr <= 0.3 THEN tpr ELSE tpr0 + (tpr - tpr0) / (fpr - fpr0) * (0.3 - fpr0) END) / 2 ELSE 0 END), 8) AS auc FROM {ROC} r")
def partial_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.auc(_leaves(spark, sf_dir), 0.3).select(F.round("auc", 8).alias("auc"))


@query("WITH t AS (SELECT l_quantity AS y, 25.0 + 10 * l_discount AS p FROM lineitem) SELECT count(*) AS n, round(avg((y - p) * (y - p)), 6) AS mse, round(avg(abs(y - p)), 6) AS mae, round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) AS r2 FROM t")
def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("y"), (25.0 + 10 * F.col("l_discount")).alias("p"))
    got = evaluate.regression_scores(t, "y", "p")
    return got.select("n", *(F.round(c, 6).alias(c) for c in got.columns[1:]))


RUNS = "(SELECT o_orderstatus AS dataset, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS depth, CASE WHEN o_custkey % 2 = 0 THEN 'multiway' ELSE 'shape' END AS algorithm, o_totalprice / 1000 AS score FROM orders)"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("dataset"), F.substring("o_orderpriority", 1, 1).cast("int").alias("depth"), F.when(F.col("o_custkey") % 2 == 0, "multiway").otherwise("shape").alias("algorithm"), (F.col("o_totalprice") / 1000).alias("score"))


@query(f"SELECT dataset, depth, algorithm, count(*) AS n_runs, round(avg(score), 6) AS score_mean, round(stddev_samp(score), 6) AS score_std, round(min(score), 6) AS score_min, round(max(score), 6) AS score_max FROM {RUNS} r GROUP BY dataset, depth, algorithm")
def benchmark_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = evaluate.summary(runs(spark, sf_dir), ["dataset", "depth", "algorithm"], ["score"])
    return got.select("dataset", "depth", "algorithm", "n_runs", *(F.round(c, 6).alias(c) for c in got.columns[4:]))


@query(f"SELECT dataset, algorithm, depth FROM (SELECT *, row_number() OVER (PARTITION BY dataset, algorithm ORDER BY round(m, 6) DESC, depth) AS r FROM (SELECT dataset, algorithm, depth, avg(score) AS m FROM {RUNS} r GROUP BY ALL)) WHERE r = 1")
def best_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = evaluate.summary(runs(spark, sf_dir), ["dataset", "algorithm", "depth"], ["score"])
    return evaluate.best_per_group(means, ["dataset", "algorithm"], [F.desc(F.round("score_mean", 6)), "depth"]).select("dataset", "algorithm", "depth")


@query(f"SELECT g.dataset, g.depth, round(avg(CASE WHEN algorithm = 'multiway' THEN score END), 6) AS multiway, round(avg(CASE WHEN algorithm = 'shape' THEN score END), 6) AS shape FROM (SELECT d.dataset, k.depth FROM (SELECT DISTINCT o_orderstatus AS dataset FROM orders) d, (SELECT unnest([1, 2, 3, 4, 5, 6]) AS depth) k) g LEFT JOIN {RUNS} r ON g.dataset = r.dataset AND g.depth = r.depth GROUP BY g.dataset, g.depth")
def algorithm_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir)
    points = r.select("dataset").distinct().crossJoin(F.broadcast(spark.range(1, 7).select(F.col("id").cast("int").alias("depth"))))
    wide = evaluate.pivot_by_algorithm(r, points, ["multiway", "shape"], "score")
    return wide.select("dataset", "depth", F.round("multiway", 6).alias("multiway"), F.round("shape", 6).alias("shape"))


@query("SELECT flag, status, share, CAST(count(l_orderkey) AS BIGINT) AS rows FROM (SELECT DISTINCT l_returnflag AS flag FROM lineitem WHERE l_returnflag IS NOT NULL) CROSS JOIN "
       "(SELECT DISTINCT l_linestatus AS status FROM lineitem WHERE l_linestatus IS NOT NULL) CROSS JOIN (SELECT unnest([0.02, 0.05]::DOUBLE[]) AS share) "
       "LEFT JOIN lineitem ON l_returnflag = flag AND l_linestatus = status AND l_tax <= share GROUP BY ALL")
def grid_cross_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of the table's flags, states and two bounds of the tax, each setting with the rows that meet it: one scan for all."""
    li, shares = table(spark, sf_dir, "lineitem"), [0.02, 0.05]
    grid = selection.grid_table(spark, flag=prep.distinct_values(li, "l_returnflag"), status=prep.distinct_values(li, "l_linestatus"), share=shares)
    met = F.explode(F.array_compact(F.array(*(F.when(F.col("l_tax") <= s, F.lit(s)) for s in shares))))
    counts = li.select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), met.alias("share")).groupBy("flag", "status", "share").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["flag", "status", "share"], "left").select("flag", "status", "share", F.coalesce("n", F.lit(0)).alias("rows"))


@query(f"WITH m AS (SELECT algorithm, depth, avg(score) AS mean, stddev_pop(score) AS std FROM {RUNS} r GROUP BY ALL) SELECT algorithm, depth, round(mean, 6) AS mean, round(std, 6) AS std, CAST(row_number() OVER (ORDER BY round(mean, 9) DESC, algorithm, depth) AS INTEGER) AS rank FROM m")
def cross_validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = evaluate.cross_validation_summary(runs(spark, sf_dir), ["algorithm", "depth"], "score")
    return got.select("algorithm", "depth", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "rank")


@query("SELECT event_type, count(*) AS n, count(DISTINCT json_keys(props::JSON)[1]) AS first_keys FROM events GROUP BY event_type")
def json_prop_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", F.element_at(F.json_object_keys("props"), 1).alias("k"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("k").alias("first_keys"))


# --- searches: no SQL


def _rows(spark: SparkSession, tree: trees.Tree, **more: object) -> DataFrame:
    out = trees.node_table(spark, tree)
    return out.withColumns({k: F.lit(v) for k, v in more.items()})


@query()
def multiway_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = binned(spark, sf_dir).withColumn("t", (F.col("qb") - 2) * 0.1)
    got = multiway.fit(df, FEATURES, "y", "t", "w", multiway.Settings(depth=2, min_child=50, regularisation=0.001))
    return _rows(spark, got.tree, objective=got.objective, status=got.status)


WAYS = f"""WITH c AS {PREFIX}, two AS (SELECT least(c0, c1) + least(t0 - c0, t1 - c1) AS loss, 2 AS ways FROM c WHERE c0 + c1 >= 50 AND t0 + t1 - c0 - c1 >= 50),
  three AS (SELECT least(a.c0, a.c1) + least(b.c0 - a.c0, b.c1 - a.c1) + least(a.t0 - b.c0, a.t1 - b.c1) AS loss, 3 AS ways FROM c a JOIN c b ON a.feature = b.feature AND a.bin < b.bin
  WHERE a.c0 + a.c1 >= 50 AND b.c0 + b.c1 - a.c0 - a.c1 >= 50 AND a.t0 + a.t1 - b.c0 - b.c1 >= 50), n AS (SELECT count(*) AS n, least(sum(y), sum(1 - y)) AS leaf FROM {BINNED} b)"""


@query(f"{WAYS} SELECT round(least((SELECT leaf / n + 0.00001 FROM n), (SELECT min(loss / (SELECT n FROM n) + 0.00001 * ways) FROM (SELECT * FROM two UNION ALL SELECT * FROM three) x)), 9) AS objective, 'done' AS status")
def multiway_stump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One level over contiguous groups, all nominees searched: the objective is the least of all 2- and 3-way splits."""
    df = binned(spark, sf_dir).withColumn("t", F.lit(0.0))
    got = multiway.fit(df, FEATURES, "y", "t", None, multiway.Settings(1, 1, 0.00001, 50, top_k=1000, scatter_bins=0))
    return spark.createDataFrame([(round(got.objective, 9), got.status)], "objective double, status string")


FIFTY = "(SELECT CAST(l_quantity AS INTEGER) AS b, CAST(l_partkey % 2 AS INTEGER) AS y FROM lineitem WHERE l_quantity IS NOT NULL AND l_partkey IS NOT NULL)"


@query(f"WITH c AS (SELECT b, sum(y) AS one, sum(1 - y) AS none FROM {FIFTY} r GROUP BY b) SELECT round(sum(least(one, none)) / sum(one + none) + 0.00002, 9) AS objective, count(*) AS bins, 'done' AS status FROM c")
def scattered_stump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two groups of the 50 quantities, however they lie: each goes with its own majority, which no contiguous groups can do."""
    df = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("int").alias("b"), (F.col("l_partkey") % 2).cast("int").alias("y"), F.lit(0.0).alias("t")).where("b is not null and y is not null")
    got = multiway.fit(df, ["b"], "y", "t", None, multiway.Settings(1, 1, 0.00001, 1, max_branching=2))
    predicted = trees.predict(df, got.tree).agg((F.avg((F.col("predicted") != F.col("y")).cast("double")) + 0.00002).alias("o"), F.countDistinct("b").alias("bins"))
    return predicted.select(F.round("o", 9).alias("objective"), "bins", F.lit(got.status).alias("status"))


@query("SELECT 100000 + l_tax + l_discount / 10 AS value, count(*) AS n FROM lineitem GROUP BY 1")
def binarize_inverse_of_close_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values whose midpoints differ beyond the sixth digit: each has a column, and each value comes back."""
    rows = table(spark, sf_dir, "lineitem").select((100000 + F.col("l_tax") + F.col("l_discount") / 10).alias("v"))
    ts = binning.thresholds_of(rows, ["v"])
    values = sorted(r[0] for r in rows.distinct().collect())  # at most one more than thresholds_of allows
    back = binning.unbinarise(binning.binarise(rows, ts).drop("v"), "v", values, ts["v"], "value")
    return back.groupBy("value").agg(F.count(F.lit(1)).alias("n"))


RETURNED, CHEAP = "SELECT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R'", "SELECT l_orderkey AS k FROM lineitem WHERE l_discount > 0.05"


@query(" UNION ALL ".join(f"SELECT '{name}' AS op, count(*) AS n, CAST(coalesce(sum(k), 0) AS BIGINT) AS total FROM ({sql}) s" for name, sql in (
    ("union", f"{RETURNED} UNION {CHEAP}"), ("intersection", f"{RETURNED} INTERSECT {CHEAP}"), ("difference", f"{RETURNED} EXCEPT {CHEAP}"),
    ("symmetric difference", f"({RETURNED} EXCEPT {CHEAP}) UNION ({CHEAP} EXCEPT {RETURNED})"))))
def row_set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a returned item and orders with a discounted one as bitmaps: size and members of each combination."""
    li, key = table(spark, sf_dir, "lineitem"), F.col("l_orderkey")
    a, b = rowsets.rowset(li, F.col("l_returnflag") == "R", key), rowsets.rowset(li, F.col("l_discount") > 0.05, key)
    rows = None
    for name, f in (("union", rowsets.union), ("intersection", rowsets.intersection), ("difference", rowsets.difference), ("symmetric difference", rowsets.symmetric_difference)):
        c = f(a, b)
        total = rowsets.members(c).agg(F.coalesce(F.sum("number"), F.lit(0)).cast("long").alias("total"))
        one = rowsets.size(c).crossJoin(F.broadcast(total)).select(F.lit(name).alias("op"), "n", "total")  # one row each
        rows = one if rows is None else rows.unionByName(one)
    return rows


FLAG_SETS = {"returned": "l_returnflag = 'R'", "cheap": "l_discount > 0.05", "small": "l_quantity < 10", "open": "l_linestatus = 'O'"}


@query("WITH " + ", ".join(f"{n} AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE {p})" for n, p in FLAG_SETS.items()) + " "
       + " UNION ALL ".join(f"SELECT '{a}' AS one, '{b}' AS two, (SELECT count(*) FROM {a} JOIN {b} USING (k)) AS both" for i, a in enumerate(FLAG_SETS) for b in list(FLAG_SETS)[i:]))
def row_set_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many orders each two of four predicates share, from one scan of the items."""
    sets = rowsets.rowsets(table(spark, sf_dir, "lineitem"), {n: F.expr(p) for n, p in FLAG_SETS.items()}, F.col("l_orderkey"))
    return rowsets.crossed(sets, list(FLAG_SETS))


@query()
def shape_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, levelwise.grow(binned(spark, sf_dir), FEATURES, "y", levelwise.Settings(2, "shape", 3, min_child=20, penalty=1e-5)))


@query()
def shape_regression_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, levelwise.grow(binned(spark, sf_dir), ["db", "tb"], "l_quantity", levelwise.Settings(2, "shape", 3, criterion="variance", min_child=20)))


@query()
def boosted_teacher_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = binned(spark, sf_dir).select("l_quantity", "l_extendedprice", "y")
    t = teacher.fit(li, ["l_quantity", "l_extendedprice"], "y", trees=3, depth=2, bins=32)
    r = li.agg(F.min("l_quantity"), F.max("l_quantity"), F.min("l_extendedprice"), F.max("l_extendedprice")).first()
    edges = teacher.guided_edges(t, {"l_quantity": (r[0], r[1]), "l_extendedprice": (r[2], r[3])}, 8)
    return spark.createDataFrame([(f, k, g, j, float(edges[f][k])) for f, k, g, j in teacher.boundary_strengths(t, edges)], "feature string, boundary int, gain double, jump double, edge double")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split, quantile bins, histogram, best multiway split, node table, prediction: a row for each branch of the tree
    with its rows and accuracy in the fit and test parts."""
    features = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]
    li = table(spark, sf_dir, "lineitem")
    key = F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    parts = prep.stratified_split(li.select(*features, "l_linestatus", key.alias("key")), "key", "l_linestatus").drop("key")
    parts = parts.persist()  # read by every scan below; what is lost is computed again
    fit = parts.where("split <> 'test'")
    rows = binning.digitise(parts, binning.edges_of(fit, features, 8))
    bins = [f"{f}_bin" for f in features]
    tree = levelwise.grow(rows.where("split <> 'test'"), bins, "l_linestatus", levelwise.Settings(1, "multiway", 3))
    branches = [(str(k), min(lo for lo, _ in sp), max(hi for _, hi in sp), c.prediction) for k, (sp, c) in enumerate(zip(tree.branches, tree.children, strict=True))] if isinstance(tree, trees.Split) else [("", None, None, tree.prediction)]
    nodes = spark.createDataFrame(branches, "path string, lo int, hi int, prediction string").withColumn("feature", F.lit(getattr(tree, "feature", None)).cast("string"))
    scored = trees.predict(rows, tree).withColumn("path", trees.expression(tree, "path"))
    right, held = (F.col("predicted") == F.col("l_linestatus")).cast("int"), F.col("split") == "test"
    by = scored.groupBy("path").agg(F.round(F.avg(F.when(~held, right)), 9).alias("fit_accuracy"), F.round(F.avg(F.when(held, right)), 9).alias("test_accuracy"), F.count(F.lit(1)).alias("rows"))
    return by.join(F.broadcast(nodes), "path", "left")  # a row a branch


_COLUMNS = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]
_SEG2 = sql_gini("a.c0", "a.c1") + " + " + sql_gini("a.t0 - a.c0", "a.t1 - a.c1")
_SEG3 = sql_gini("a.c0", "a.c1") + " + " + sql_gini("b.c0 - a.c0", "b.c1 - a.c1") + " + " + sql_gini("a.t0 - b.c0", "a.t1 - b.c1")
FLAGSHIP = f"""WITH k AS (SELECT {", ".join(_COLUMNS)}, l_linestatus AS y, concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS key FROM lineitem),
  r AS (SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY y ORDER BY md5('0:' || key), key) <= floor(count(*) OVER (PARTITION BY y) * 0.2 + 0.5) AS held FROM k),
  l AS ({" UNION ALL ".join(f"SELECT '{c}_bin' AS feature, {i} AS place, {c} AS v, id, y, held FROM r" for i, c in enumerate(_COLUMNS))}),
  q AS (SELECT feature, unnest(quantile_cont(v, {QUANTILES})) AS edge, min(v) AS lo, max(v) AS hi FROM l WHERE NOT held GROUP BY feature),
  e AS (SELECT DISTINCT feature, round(edge, 6) AS edge FROM q WHERE round(edge, 6) > lo AND round(edge, 6) < hi),
  b AS (SELECT l.feature, l.place, l.id, l.y, l.held, count(e.edge) AS bin FROM l LEFT JOIN e ON l.feature = e.feature AND e.edge <= l.v GROUP BY ALL),
  h AS (SELECT feature, place, bin, CAST(count_if(y = 'F') AS DOUBLE) AS n0, CAST(count_if(y = 'O') AS DOUBLE) AS n1 FROM b WHERE NOT held GROUP BY ALL),
  c AS (SELECT *, sum(n0) OVER w AS c0, sum(n1) OVER w AS c1, sum(n0) OVER (PARTITION BY feature) AS t0, sum(n1) OVER (PARTITION BY feature) AS t1, max(bin) OVER (PARTITION BY feature) AS last FROM h WINDOW w AS (PARTITION BY feature ORDER BY bin)),
  s AS (SELECT a.feature, a.place, 2 AS ways, a.bin AS one, a.last AS two, a.last, {_SEG2} AS cost FROM c a WHERE a.bin < a.last
    UNION ALL SELECT a.feature, a.place, 3, a.bin, b.bin, a.last, {_SEG3} FROM c a JOIN c b ON a.feature = b.feature AND a.bin < b.bin AND b.bin < b.last),
  best AS (SELECT * FROM s ORDER BY cost, place, ways LIMIT 1),
  d AS (SELECT b.*, CASE WHEN b.bin <= s.one THEN '0' WHEN b.bin <= s.two THEN '1' ELSE '2' END AS path FROM b JOIN best s ON b.feature = s.feature),
  p AS (SELECT path, CASE WHEN count_if(y = 'F') >= count_if(y = 'O') THEN 'F' ELSE 'O' END AS prediction, CAST(min(bin) AS INTEGER) AS lo, CAST(max(bin) AS INTEGER) AS hi FROM d WHERE NOT held GROUP BY path)
  SELECT d.path, round(avg(CASE WHEN NOT held THEN CAST(y = prediction AS INTEGER) END), 9) AS fit_accuracy, round(avg(CASE WHEN held THEN CAST(y = prediction AS INTEGER) END), 9) AS test_accuracy,
    count(*) AS rows, p.lo, p.hi, p.prediction, d.feature FROM d JOIN p ON d.path = p.path GROUP BY d.path, p.lo, p.hi, p.prediction, d.feature"""


query(FLAGSHIP)(flagship)


from coppice import search_queries, shape_queries  # noqa: E402, F401  registers the queries of searches
