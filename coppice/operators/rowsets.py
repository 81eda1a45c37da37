"""Sets of rows as bitmaps: a table of 64-bit words, (word, bits), for the numbers of the rows that a predicate holds for.

Sets are made by a partial bitwise or for each word, several of them in one scan; algebra is a join by word and a bitwise
operation on long columns, counting a sum of bit counts. A word stands for 64 rows, so a set of a table of n rows has at
most n / 64 words of 16 bytes, whatever its size; words without a row are left out, so equal sets are equal tables.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _places(number: Column) -> tuple[Column, Column]:
    n = number.cast("long")
    return F.shiftright(n, 6), F.call_function("shiftleft", F.lit(1).cast("long"), n.bitwiseAND(63).cast("int"))


def rowsets(df: DataFrame, predicates: Mapping[str, Column], number: Column) -> DataFrame:
    """(word, one column of bits for each predicate): ``number`` numbers the rows, from 0 on; rows that share a number are
    one member, rows without a number and predicates that are null are in no set."""
    word, bit = _places(number)
    rows = df.where(number.isNotNull()).select(word.alias("word"), bit.alias("_bit"), *(p.alias(n) for n, p in predicates.items()))
    bits = [F.coalesce(F.bit_or(F.when(F.col(n), F.col("_bit"))), F.lit(0).cast("long")).alias(n) for n in predicates]
    return rows.groupBy("word").agg(*bits)


def rowset(df: DataFrame, predicate: Column, number: Column) -> DataFrame:
    """(word, bits) of one set."""
    return nonempty(rowsets(df.where(predicate), {"bits": F.lit(True)}, number))


def nonempty(a: DataFrame) -> DataFrame:
    return a.where("bits <> 0")


def _joined(a: DataFrame, b: DataFrame, f: Callable[[Column, Column], Column], how: str) -> DataFrame:
    none = F.lit(0).cast("long")
    both = a.withColumnRenamed("bits", "_a").join(b.withColumnRenamed("bits", "_b"), "word", how)
    return nonempty(both.select("word", f(F.coalesce("_a", none), F.coalesce("_b", none)).alias("bits")))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return _joined(a, b, lambda x, y: x.bitwiseOR(y), "full")


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return _joined(a, b, lambda x, y: x.bitwiseAND(y), "inner")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return _joined(a, b, lambda x, y: x.bitwiseAND(F.bitwise_not(y)), "left")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return _joined(a, b, lambda x, y: x.bitwiseXOR(y), "full")


def size(a: DataFrame) -> DataFrame:
    """One row, n: the members of the set."""
    return a.agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).cast("long").alias("n"))


def same(a: DataFrame, b: DataFrame) -> bool:
    return symmetric_difference(a, b).isEmpty()


def fingerprint(a: DataFrame) -> int:
    """A number that equal sets share, in whatever order their words come."""
    return nonempty(a).agg(F.bit_xor(F.xxhash64("word", "bits"))).first()[0] or 0


def members(a: DataFrame) -> DataFrame:
    """(number) of each member."""
    at = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit("bits", i) == 1)
    return a.select("word", F.explode(at).alias("_i")).select((F.col("word") * 64 + F.col("_i")).alias("number"))


def crossed(sets: DataFrame, names: list[str]) -> DataFrame:
    """(one, two, both): how many members each two of the named sets of a table of ``rowsets`` share, from one scan."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = [F.struct(F.lit(a).alias("one"), F.lit(b).alias("two"), F.sum(F.bit_count(F.col(a).bitwiseAND(F.col(b)))).cast("long").alias("both")) for a, b in pairs]
    return sets.agg(F.array(*sums).alias("s")).select(F.explode("s").alias("s")).select("s.*")
