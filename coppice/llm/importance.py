r"""Importance resampling towards a target by hashed n-grams.

Words are given their positions by posexplode; a window over each row, in the order of positions, brings the words that
follow beside each word, so that runs of one to three words are expressions over one row of the position table. Each run
goes to a bucket by its hash. Buckets are counted for the documents and for the target; how much more of the target than
of the documents falls into a bucket is its gain; gains are joined to the position table and summed for each document.
Gains with Gumbel noise, drawn from the document's id, rank the documents: the highest are a draw without replacement
in proportion to the exponent of the gains.

The rows are dealt once, as whole texts, by a number of their own, before their words are told apart: the windows need no
further shuffle, no key can be hot, and long texts are a task's sequence of small rows. The position table is written
with the three buckets of each word as its only payload; counting and summing read it from there. What is shuffled
afterwards is a row for each bucket and task, and a narrow row for each document to rank them by range. What is
broadcast is the table of gains, of at most as many rows as there are buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coppice.llm.common import written
from coppice.llm.oracles import CRC_TABLE, crc32

#: What separates words, A-Z being lower-cased and kept.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCALE = 4294967296


def _lowered(word: Column) -> Column:
    """A-Z to a-z: by ``lower`` for words of ASCII, where that is the same and fast."""
    return F.when(F.length(word) == F.octet_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def positions(docs: DataFrame, orders: int = 3, buckets: int = 10_000) -> DataFrame:
    """The position table (_row, doc_id, b1, b2, ...): a row for each word, with the bucket of the run of k words that it
    begins as b<k>, null where the text ends before. A text without words has one row without buckets.

    Rows of docs are told apart by a number of their own, so ids may be null or repeat. docs must be a table that is
    read from files, or else rows that come in the same order whenever they are computed again.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id"), F.col("text").cast("string").alias("text")).repartition("_row")
    words = F.filter(F.split("text", SEPARATORS), lambda w: w != "")
    words = rows.select("_row", "doc_id", F.posexplode_outer(words).alias("_at", "_word")).withColumn("_word", _lowered(F.col("_word")))
    order = Window.partitionBy("_row").orderBy("_at")
    ahead = [F.col("_word"), *(F.lead("_word", k).over(order) for k in range(1, orders))]
    beside = words.select("_row", "doc_id", *(w.alias(f"_w{k}") for k, w in enumerate(ahead)))
    run = lambda k: F.concat_ws(" ", *(F.col(f"_w{j}") for j in range(k + 1)))
    bucket = lambda k: F.when(F.col(f"_w{k}").isNotNull(), (F.crc32(run(k)) % buckets).cast("int"))
    return beside.select("_row", "doc_id", *(bucket(k).alias(f"b{k + 1}") for k in range(orders)))


def counts(table: DataFrame, orders: int, name: str) -> DataFrame:
    """(bucket, name): how many runs of the position table fall into each bucket."""
    each = table.select(F.explode(F.array(*(f"b{k + 1}" for k in range(orders)))).alias("bucket")).where("bucket is not null")
    return each.groupBy("bucket").agg(F.count(F.lit(1)).alias(name))


def gains(docs: DataFrame, target: DataFrame, orders: int = 3, buckets: int = 10_000) -> DataFrame:
    """(bucket, gain) of every bucket, from the position tables of both: floor of 1000 times the logarithm of its share of the
    target's runs over its share of the documents', one run being added to each bucket."""
    spark = docs.sparkSession
    both = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    for table, name in ((docs, "s"), (target, "t")):
        both = both.join(counts(table, orders, name), "bucket", "left")
    both = both.select("bucket", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("s", "t")))
    both = written(both, "bucket-counts")
    all_s, all_t = both.agg(F.sum("s"), F.sum("t")).first()
    share = ((F.col("t") + 1) * F.lit(float(all_s + buckets))) / ((F.col("s") + 1) * F.lit(float(all_t + buckets)))
    return both.select("bucket", F.floor(1000 * F.log(share)).cast("long").alias("gain"))


def noise(doc_id: Column, seed: int) -> Column:
    """Floor of 1000 times standard Gumbel noise, from the first 32 bits of the digest of ``seed:doc_id``."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / SCALE))).cast("long")


def resample(docs: DataFrame, target: DataFrame, share: int = 5, min_words: int = 20, orders: int = 3, buckets: int = 10_000, seed: int = 42) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs (doc_id, text); target has text.

    n_features: runs of 1 to ``orders`` words, repeats counted. weight: the sum of their gains. score: weight and Gumbel noise.
    rank: 1, 2, 3, ... by falling score, ties to the smaller doc_id (null last), of the ``share`` in 100 rows (rounded down) drawn
    from those of ``min_words`` words or more; null for the others. Null and empty texts, and those without a word, have no
    features and weight 0; a null id draws its noise as an empty one; rows that repeat are each counted, scored and
    ranked; long texts count whole. No documents give no rows; without a target's words all gains come from the smoothing.
    Other columns are ignored, whatever their names.
    """
    table = written(positions(docs, orders, buckets), "positions")
    aims = positions(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), orders, buckets)
    gain = F.broadcast(gains(table, aims, orders, buckets))  # as many rows as buckets
    weighed = table
    for k in range(orders):
        weighed = weighed.join(gain.select(F.col("bucket").alias(f"b{k + 1}"), F.col("gain").alias(f"g{k + 1}")), f"b{k + 1}", "left")
    summed = [F.coalesce(F.sum(f"g{k + 1}"), F.lit(0).cast("long")) for k in range(orders)]
    features = [F.count(f"b{k + 1}") for k in range(orders)]
    total = weighed.groupBy("_row").agg(
        F.max("doc_id").alias("doc_id"), F.count("b1").alias("n_words"), sum(features[1:], features[0]).alias("n_features"), sum(summed[1:], summed[0]).alias("weight"))
    total = total.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("eligible", F.col("n_words") >= min_words)
    return ranked(total, share).select("doc_id", "n_features", "weight", "score", "rank")


def ranked(rows: DataFrame, share: int) -> DataFrame:
    """Adds rank, by score, of the share in 100 of the eligible rows: sorted by range, then numbered from where each
    partition begins. Only the number of rows of each partition comes to the driver."""
    by = [F.col("eligible").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_row")]
    placed = rows.orderBy(*by).withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id()})
    placed = written(placed, "ranked")
    parts = sorted(tuple(r) for r in placed.groupBy("_part").agg(F.count(F.lit(1)), F.sum(F.col("eligible").cast("long"))).collect())
    drawn, before, starts = share * sum(p[2] for p in parts) // 100, 0, []
    for part, n, _ in parts:
        starts.append((part, before))
        before += n
    if not starts:
        return placed.withColumn("rank", F.lit(None).cast("long"))
    offset = F.broadcast(rows.sparkSession.createDataFrame(starts, "_part int, _start long"))  # a row for each partition
    place = F.col("_start") + F.col("_place").bitwiseAND((1 << 33) - 1) + 1  # the low 33 bits number the rows of a partition
    return placed.join(offset, "_part").withColumn("rank", F.when(F.col("eligible") & (place <= drawn), place))



def sql(orders: int = 3, buckets: int = 10_000, share: int = 5, min_words: int = 20, seed: int = 42) -> str:
    """DuckDB SQL of the query, with CRC-32 written out over the bytes of each different run of words."""
    words = "list_filter(string_split_regex(translate(coalesce(text, ''), '{u}', '{l}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')".format(u=UPPER, l=LOWER)
    runs = " UNION ALL ".join(f"SELECT t, r, array_to_string(list_slice(w, i, i + {k}), ' ') AS f FROM (SELECT t, r, w, unnest(range(1, len(w) + 1 - {k})) AS i FROM d WHERE len(w) > {k})" for k in range(orders))
    hashed = "list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda x: CAST(('0x' || x) AS BIGINT))"
    return f"""
WITH tab AS ({CRC_TABLE}),
d AS MATERIALIZED (SELECT 0 AS t, row_number() OVER () AS r, doc_id, {words} AS w FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, {words} FROM benchmark),
f AS MATERIALIZED (SELECT t, r, f, count(*) AS n FROM ({runs}) GROUP BY ALL),
b AS MATERIALIZED (SELECT f, {crc32(hashed)} % {buckets} AS b FROM (SELECT DISTINCT f FROM f), tab),
fb AS MATERIALIZED (SELECT t, r, b, n FROM f JOIN b USING (f)),
c AS (SELECT i AS b, coalesce(sum(n) FILTER (t = 0), 0) AS s, coalesce(sum(n) FILTER (t = 1), 0) AS t FROM (SELECT unnest(range({buckets})) AS i) LEFT JOIN fb ON fb.b = i GROUP BY i),
g AS (SELECT b, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * ((SELECT sum(s) FROM c) + {buckets}.0::DOUBLE) / ((CAST(s AS DOUBLE) + 1) * ((SELECT sum(t) FROM c) + {buckets}.0::DOUBLE)))) AS BIGINT) AS gain FROM c),
w AS (SELECT r, sum(n) AS n_features, sum(n * gain) AS weight FROM fb JOIN g USING (b) WHERE t = 0 GROUP BY r),
z AS (SELECT r, doc_id, len(w) AS m, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
  CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST(('0x' || substr(sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) + 0.5) / {SCALE}.0))) AS BIGINT) AS score FROM d LEFT JOIN w USING (r) WHERE t = 0),
q AS (SELECT *, row_number() OVER (PARTITION BY m >= {min_words} ORDER BY score DESC, doc_id NULLS LAST, r) AS place, count(*) FILTER (m >= {min_words}) OVER () AS n FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN m >= {min_words} AND place <= {share} * n // 100 THEN place END AS rank FROM q"""
