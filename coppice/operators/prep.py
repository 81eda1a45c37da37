"""Row preparation: encoding, imputation, scaling and deterministic splits, as lazy plans.

Statistics are separate small aggregates, joined or crossed back as one-row or one-row-per-class tables; ranks over
classes use a hash of the row's key so that any engine can repeat them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from coppice.operators import ranks


def one_row(df: DataFrame) -> DataFrame:
    """Marks a one-row aggregate for broadcast: its size is fixed."""
    return F.broadcast(df)


def hashed(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def bounded(table: DataFrame, most: int = 1_000_000) -> DataFrame:
    """The table with a hint to broadcast it if it has at most ``most`` rows, which are counted: rows that are joined with it
    stay where they are."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def distinct_values(df: DataFrame, column: str, most: int = 10_000) -> list:
    """The values of a column but null, on the driver, in the order of their text; refuses more than ``most``."""
    rows = df.select(F.col(column)).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{column} has more than {most} distinct values")
    return sorted((r[0] for r in rows), key=str)


def label_codes(df: DataFrame, label: str) -> DataFrame:
    """label, code: labels in the order of their text, from 0. One row a class; null labels have no code."""
    labels = df.where(F.col(label).isNotNull()).select(F.col(label).alias("label")).distinct()
    return labels.withColumn("code", (F.row_number().over(Window.orderBy(F.col("label").cast("string"))) - 1).cast("int"))


def encode_labels(df: DataFrame, label: str, code: str = "code") -> DataFrame:
    """Adds the class code. A label that is not among the codes would be null, which no fit row is."""
    return df.join(bounded(label_codes(df, label).withColumnRenamed("label", label).withColumnRenamed("code", code)), label, "left")


def decode_labels(df: DataFrame, codes: DataFrame, code: str) -> DataFrame:
    return df.join(bounded(codes.withColumnRenamed("code", code)), code, "left")


def require_classes(df: DataFrame, label: str, n: int | None = None) -> int:
    """Number of classes; an error if there are fewer than two, or not the number asked for."""
    found = df.select(F.count_distinct(label)).first()[0]
    if found < 2 or (n and found != n):
        raise ValueError(f"{label} has {found} classes, not {n or '2 or more'}")
    return found


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature, n_distinct, n_null, kind for each column: integral, rational or categorical by what its values look like;
    redundant with one value, binary with two and no null."""
    text = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("v")) for c in columns))).alias("s")
    long = df.select(text).select("s.feature", "s.v").groupBy("feature", "v").agg(F.count(F.lit(1)).alias("n"))
    blank = F.col("v").isNull() | F.trim("v").isin("", "NULL", "null", "Null", "NA", "na", "NaN")
    whole, number = F.col("v").rlike(r"^[+-]?[0-9]+([.]0+)?$"), F.col("v").rlike(r"^[+-]?[0-9]*[.]?[0-9]+([eE][+-]?[0-9]+)?$")
    agg = long.groupBy("feature").agg(
        F.count(F.when(~blank, 1)).alias("n_distinct"), F.coalesce(F.sum(F.when(blank, F.col("n"))), F.lit(0)).cast("long").alias("n_null"),
        F.min(F.when(~blank, whole)).alias("whole"), F.min(F.when(~blank, number)).alias("number"),
    )
    kind = (
        F.when(F.col("n_distinct") <= 1, "redundant").when((F.col("n_distinct") == 2) & (F.col("n_null") == 0), "binary")
        .when(F.col("whole"), "integral").when(F.col("number"), "rational").otherwise("categorical")
    )
    return agg.select("feature", "n_distinct", "n_null", kind.alias("kind"))


def clean_label(c: Column) -> Column:
    """Trims and drops trailing full stops."""
    return F.regexp_replace(F.trim(c), r"[.]+$", "")


def finite(c: Column) -> Column:
    """The number, or null for what is no finite number."""
    x = c.try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the exact median of each column's finite values, 0 where there is none; found by counting (ranks.py)."""
    got = ranks.order_statistics(df, {c: finite(F.col(c)) for c in columns}, lambda n: ranks.quantile_ranks(n, [0.5]))
    return df.sparkSession.createDataFrame([[got[c].quantile(0.5) if got[c].n else 0.0 for c in columns]], StructType([StructField(c, DoubleType()) for c in columns]))


def impute_median(df: DataFrame, columns: Sequence[str], fit: DataFrame | None = None) -> DataFrame:
    """Missing and non-finite numbers become the median of the fit rows."""
    stats = one_row(medians(fit if fit is not None else df, columns).select(*(F.col(c).alias(f"_m_{c}") for c in columns)))
    return df.crossJoin(stats).withColumns({c: F.coalesce(finite(F.col(c)), F.col(f"_m_{c}")) for c in columns}).drop(*(f"_m_{c}" for c in columns))


def mode(df: DataFrame, column: str) -> DataFrame:
    """One row: the most frequent value; of equally frequent ones the first in order."""
    return df.where(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.desc("count"), column).limit(1).select(F.col(column).alias("mode"))


def impute_mode(df: DataFrame, column: str, fit: DataFrame | None = None) -> DataFrame:
    """Missing values, and values that no fit row has, become the mode of the fit rows."""
    source = fit if fit is not None else df
    known = source.where(F.col(column).isNotNull()).select(F.col(column)).distinct().withColumn("_known", F.lit(True))
    joined = df.join(bounded(known), column, "left").join(one_row(mode(source, column)), how="left")
    return joined.withColumn(column, F.when(F.col("_known"), F.col(column)).otherwise(F.col("mode"))).select(*df.columns)


def one_hot(df: DataFrame, column: str, categories: Sequence[str], drop_first: bool = False) -> DataFrame:
    """Adds 0/1 columns ``column__category``; all categories, or all but the first."""
    return df.withColumns({f"{column}__{c}": F.when(F.col(column) == c, 1).otherwise(0) for c in categories[1 if drop_first else 0 :]})


def categories(df: DataFrame, column: str, seen_by: str | None = None, most: int = 10_000) -> list[str]:
    """Categories in order, or in the order in which they first appear by ``seen_by``; refuses more than ``most``."""
    order = F.min(seen_by) if seen_by else F.min(column)
    rows = df.where(F.col(column).isNotNull()).groupBy(column).agg(order.alias("o")).orderBy("o", column).limit(most + 1).collect()  # one row a category
    if len(rows) > most:
        raise ValueError(f"{column} has more than {most} categories")
    return [r[0] for r in rows]


def feature_dictionary(columns: Sequence[str], encoded: Sequence[str]) -> dict[str, list[str]]:
    """Each source column with the columns that encode it."""
    return {c: [e for e in encoded if e == c or e.startswith(f"{c}__")] for c in columns}


def standardise(df: DataFrame, columns: Sequence[str], fit: DataFrame | None = None) -> DataFrame:
    """Z-scores by mean and population deviation of the fit rows; a constant column becomes 0."""
    source = fit if fit is not None else df
    stats = one_row(source.agg(*(f(c).alias(f"_{k}_{c}") for c in columns for k, f in (("a", F.avg), ("d", F.stddev_pop)))))
    scaled = {c: F.when(F.col(f"_d_{c}") == 0, 0.0).otherwise((F.col(c) - F.col(f"_a_{c}")) / F.col(f"_d_{c}")) for c in columns}
    return df.crossJoin(stats).withColumns(scaled).drop(*(f"_{k}_{c}" for c in columns for k in "ad"))


def binarise_at_median(df: DataFrame, column: str, out: str) -> DataFrame:
    got = ranks.order_statistics(df, {column: F.col(column)}, lambda n: ranks.quantile_ranks(n, [0.5]))[column]
    return df.withColumn(out, (F.col(column) >= F.lit(got.quantile(0.5)).cast("double")).cast("int"))


def largest_remainder(df: DataFrame, label: str, share: float) -> DataFrame:
    """label, n, taken: how many of each class a sample of ``share`` gets; whole numbers that add up to
    round(share * all), the largest remainders rounded up, ties by label."""
    classes = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = one_row(df.agg(F.floor(F.count(F.lit(1)) * share + 0.5).alias("_take")))
    exact = classes.withColumn("_x", F.col("n") * share).withColumn("_f", F.floor("_x")).crossJoin(total)
    rank = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("_x") - F.col("_f"), 9)), "label"))
    floors = one_row(exact.agg(F.sum("_f").alias("_floors")))
    return exact.crossJoin(floors).withColumn("_r", rank).select("label", "n", (F.col("_f") + (F.col("_r") <= F.col("_take") - F.col("_floors")).cast("int")).cast("long").alias("taken"))


def stratified_split(df: DataFrame, key: str, label: str, test: float = 0.2, validation: float = 0.1, seed: int = 0) -> DataFrame:
    """Adds split: test, val or fit. In each class rows are ordered by a hash of the key; exact shares by class.

    Rows of equal key go together, so shares are exact up to such ties. No row is moved: the two rows where a class is
    cut are found by counting, and a row is held against its class's cuts. Classes are collected, so they must be few.
    """
    h = F.coalesce(hashed(F.col(key), seed), F.lit("-"))  # a null key comes first
    rows = df.select(F.col(label).alias("_l"), h.alias("_h"), F.col(key).alias("_k"))

    def ranks(n: int) -> list[int]:
        n_test, n_val = math.floor(n * test + 0.5), math.floor(n * validation + 0.5)
        return [n_test, n_test + n_val]

    found = class_cuts(rows, ranks)
    schema = StructType([StructField("_l", df.schema[label].dataType), *(StructField(f"_{c}{i}", t) for i in (0, 1) for c, t in (("h", StringType()), ("k", df.schema[key].dataType)))])
    cuts = df.sparkSession.createDataFrame([(k, *(x for c in v for x in c)) for k, v in found.items()], schema)
    first, second = (F.coalesce(F.struct("_h", F.col(key)) <= F.struct(f"_h{i}", f"_k{i}"), F.lit(False)) for i in (0, 1))
    split = F.when(first & F.col("_h0").isNotNull(), "test").when(second & F.col("_h1").isNotNull(), "val").otherwise("fit")
    cut = df.withColumn("_h", h).join(F.broadcast(cuts), F.col(label).eqNullSafe(F.col("_l")), "left")  # a row a class
    return cut.withColumn("split", split).drop("_h", "_l", "_h0", "_k0", "_h1", "_k1")


def class_cuts(rows: DataFrame, ranks: Callable[[int], list[int]], digits: int = 3, most: int = 10_000) -> dict:
    """For each class (_l) the (hash, key) of the rows of the given ranks of its size, in order of _h and _k; (None, None)
    for rank 0.

    Rows are counted by the first digits of the hash, then by further ones within the pieces that hold a cut, until
    those have at most ``most`` rows, which are looked at.
    """
    spark, key_types = rows.sparkSession, rows.schema
    piece = F.substring("_h", 1, digits)
    counts: dict = {}
    for r in rows.groupBy("_l", piece.alias("p")).count().collect():  # classes times 16 ** digits
        counts.setdefault(r["_l"], []).append((r["p"], r["count"]))
    wanted = {k: ranks(sum(n for _, n in v)) for k, v in counts.items()}
    left = {(k, i): ("", r) for k, v in wanted.items() for i, r in enumerate(v) if r > 0}  # prefix, rank within it
    sizes: dict = {}
    pieces = {(k, ""): v for k, v in counts.items()}
    while True:
        for at, (prefix, rank) in list(left.items()):
            for p, n in sorted(pieces.get((at[0], prefix), ())):
                if rank <= n:
                    left[at], sizes[at[0], p] = (p, rank), n
                    break
                rank -= n
        open_ = {(k, p) for (k, _), (p, _) in left.items() if sizes[k, p] > most}
        if not open_ or digits >= 32:
            break
        digits = min(32, digits + 3)
        inside = spark.createDataFrame(sorted(open_, key=str), StructType([StructField("c", key_types["_l"].dataType), StructField("p", StringType())]))
        hit = rows.join(F.broadcast(inside), F.col("_l").eqNullSafe(F.col("c")) & F.col("_h").startswith(F.col("p")))
        pieces = {}
        for r in hit.groupBy("_l", "p", F.substring("_h", 1, digits).alias("q")).count().collect():
            pieces.setdefault((r["_l"], r["p"]), []).append((r["q"], r["count"]))
    ends = {(k, p) for (k, _), (p, _) in left.items()}
    found = {k: [(None, None)] * len(v) for k, v in wanted.items()}
    if ends:
        inside = spark.createDataFrame(sorted(ends, key=str), StructType([StructField("c", key_types["_l"].dataType), StructField("p", StringType())]))
        hit = rows.join(F.broadcast(inside), F.col("_l").eqNullSafe(F.col("c")) & F.col("_h").startswith(F.col("p")))
        members: dict = {}
        for r in hit.groupBy("_l", "p", "_h", "_k").count().collect():  # at most ``most`` a cut
            members.setdefault((r["_l"], r["p"]), []).append((r["_h"], r["_k"], r["count"]))
        for (k, i), (p, rank) in left.items():
            for h, key, n in sorted(members[k, p], key=lambda x: (x[0], x[1] is not None, x[1])):
                if rank <= n:
                    found[k][i] = (h, key)
                    break
                rank -= n
    return found


def stratified_folds(df: DataFrame, key: str, label: str, folds: int = 5, seed: int = 0) -> DataFrame:
    """Adds fold, 0 to folds - 1, dealt round by rank within the class."""
    return rank_in_class(df, key, label, seed).withColumn("fold", ((F.col("_rank") - 1) % folds).cast("int")).drop("_rank")


def rank_in_class(df: DataFrame, key: str, label: str, seed: int, piece_rows: int = 1_000_000) -> DataFrame:
    """Adds _rank: 1, 2, ... within the class by hash of the key, then the key.

    A class is ranked in pieces by the first digits of the hash, as many as leave about ``piece_rows`` rows a piece,
    with a running sum over the counts of the pieces before, so no class is sorted in one task.
    """
    digits = max(2, math.ceil(math.log(max(1, df.count() / piece_rows), 16)))
    h = df.withColumn("_h", hashed(F.col(key), seed)).withColumn("_b", F.substring("_h", 1, digits))
    pieces = h.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_c"))
    base = pieces.withColumn("_base", F.sum("_c").over(Window.partitionBy(label).orderBy("_b")) - F.col("_c")).drop("_c")
    local = h.withColumn("_local", F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", key)))
    return local.join(base, [label, "_b"]).withColumn("_rank", F.col("_base") + F.col("_local")).drop("_h", "_b", "_local", "_base")


def random_split(df: DataFrame, key: str, shares: Sequence[float], seed: int = 0) -> DataFrame:
    """Adds part, 0 to len(shares) - 1, by the hash of the key alone: independent of all other rows."""
    x = F.conv(F.substring(hashed(F.col(key), seed), 1, 8), 16, 10).cast("double") / 2**32
    edges = [sum(shares[: i + 1]) / sum(shares) for i in range(len(shares) - 1)]
    part = F.lit(0)
    for e in edges:
        part = part + (x >= e).cast("int")
    return df.withColumn("part", part)


def top_per_class(df: DataFrame, key: str, label: str, n: int, seed: int = 0) -> DataFrame:
    """A stratified down-sample: of each class the n rows of the smallest hash."""
    order = Window.partitionBy(label).orderBy("_h", key)
    return df.withColumn("_h", hashed(F.col(key), seed)).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_h", "_r")


def variants(df: DataFrame, column: str) -> DataFrame:
    """variant, and the row: all rows as ``full`` and each row under ``column=value``."""
    names = F.array(F.lit("full"), F.concat(F.lit(f"{column}="), F.col(column)))
    return df.withColumn("variant", F.explode(F.filter(names, lambda x: x.isNotNull())))


def slice_rows(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows of df whose key is in the column ``key`` of ``wanted``; each once, however often it is wanted."""
    return df.join(wanted.select(key).distinct(), key, "left_semi")


def beside(a: DataFrame, b: DataFrame, row: str) -> DataFrame:
    """The columns of two tables of the same rows side by side, by their row number; an error where either lacks one."""
    both = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), row, "full")
    ok = F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.raise_error(F.lit("a row is missing on one side")))
    return both.withColumn(row, F.coalesce(ok.cast(a.schema[row].dataType), F.col(row))).drop("_a", "_b")


def numeric_token(text: Column) -> Column:
    """(whole, real) of a text: a number with a point or an exponent is real, any other number whole, else both null."""
    t = F.trim(text)
    real = t.rlike(r"[.eE]")
    return F.struct(F.when(~real, F.try_to_number(t, F.lit("S9999999999999999999")).cast("long")).alias("whole"), F.when(real, t.try_cast("double")).alias("real"))


def mask(features: Sequence[str]) -> Column:
    """Boolean (0/1) columns as the bits of one number, the first the lowest; at most 63."""
    if len(features) > 63:
        raise ValueError("at most 63 features")
    bits = [F.shiftleft(F.col(f).cast("long"), i) for i, f in enumerate(features)]
    return sum(bits[1:], bits[0])


def population(features: Sequence[str]) -> Column:
    """How many of the 0/1 columns are 1."""
    return F.bit_count(mask(features)).cast("int")
