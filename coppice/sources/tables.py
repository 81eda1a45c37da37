"""Sources and sinks: tables, delimited files with declared schemas, cost matrices, feature stores, artifacts."""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str | list[str], schema: str | StructType, header: bool = True) -> DataFrame:
    """Delimited text with a declared schema; nothing is inferred. Several paths are one table."""
    return spark.read.schema(schema).option("header", header).csv(path)


def read_zip(spark: SparkSession, path: str, members: str, schema: str | StructType, header: bool = False) -> DataFrame:
    """Delimited text inside zip files: the lines of all members whose names match the regular expression ``members``,
    as one table with a declared schema and the member's name. An archive is read by one task, a member line by line."""
    def lines(frames):  # noqa: ANN001, ANN202
        import io
        import zipfile

        import pandas as pd

        for frame in frames:
            for content in frame["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        if re.search(members, name):
                            with io.TextIOWrapper(z.open(name), "utf-8", "replace") as f:
                                rows = itertools.islice(f, 1 if header else 0, None)
                                while part := list(itertools.islice(rows, 10_000)):
                                    yield pd.DataFrame({"member": name, "line": [x.rstrip("\r\n") for x in part]})

    ddl = schema if isinstance(schema, str) else schema.simpleString().removeprefix("struct<").removesuffix(">")
    found = spark.read.format("binaryFile").load(path).select("content").mapInPandas(lines, "member string, line string")
    return found.where("line <> ''").select("member", F.from_csv("line", ddl).alias("row")).select("member", "row.*")


@dataclass(frozen=True)
class Dataset:
    """A registered source: how to load it and which column is the target (the last one if None)."""

    name: str
    load: Callable[[SparkSession], DataFrame]
    target: str | None = None
    aliases: tuple[str, ...] = ()
    description: str = ""


class Registry:
    """Datasets by name, whatever its case and outer spaces, or by alias."""

    def __init__(self, datasets: list[Dataset] | None = None):
        self.by_name: dict[str, Dataset] = {}
        for d in datasets or []:
            self.add(d)

    def add(self, d: Dataset) -> None:
        for n in (d.name, *d.aliases):
            self.by_name[n.strip().lower()] = d

    def spec(self, name: str) -> Dataset:
        key = name.strip().lower()
        if key not in self.by_name:
            raise KeyError(f"no dataset {name!r}; there are {', '.join(sorted({d.name for d in self.by_name.values()}))}")
        return self.by_name[key]

    def load(self, spark: SparkSession, name: str) -> tuple[DataFrame, str]:
        """The table and its target column."""
        spec = self.spec(name)
        df = spec.load(spark)
        if len(df.columns) < 2:
            raise ValueError(f"{spec.name} has fewer than two columns")
        target = spec.target or df.columns[-1]
        if df.columns.count(target) != 1:
            raise ValueError(f"{spec.name} has no single column {target}")
        return df, target


def read_costs(spark: SparkSession, path: str, classes: list[str]) -> DataFrame:
    """prediction, truth, cost of a square file whose header names the classes; its rows are in the header's order."""
    whole = spark.read.text(path, wholetext=True)  # one row a file, so the order of its lines is that of the file
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    cells = whole.select(F.posexplode(lines).alias("i", "line")).where("i > 0").select("i", F.posexplode(F.split("line", ",")).alias("j", "cost"))
    name = lambda at: F.element_at(F.array(*map(F.lit, classes)), at)
    return cells.select(name(F.col("i")).alias("prediction"), name(F.col("j") + 1).alias("truth"), F.trim("cost").cast("double").alias("cost"))


def store_name(stem: str, **parameters: object) -> str:
    """Folder name that says how a feature store was made."""
    return "_".join([stem, *(f"{k}{v}" for k, v in sorted(parameters.items()))])


def write_store(df: DataFrame, path: str, by: str = "split") -> None:
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def resolve_store(spark: SparkSession, root: str, name: str, required: list[str]) -> DataFrame:
    """The store asked for, else its highest ``_vN``, else the one without a version; those lacking columns are skipped."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(root)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    stem = re.sub(r"_v\d+$", "", name)
    versions = sorted((n for n in there if re.fullmatch(re.escape(stem) + r"_v\d+", n)), key=lambda n: -int(n.rsplit("_v", 1)[1]))
    for n in dict.fromkeys([name, *versions, stem]):
        if n in there:
            df = spark.read.parquet(f"{root}/{n}")
            if not set(required) - set(df.columns):
                return df
    raise FileNotFoundError(f"no complete store {name} in {root}")


def append_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A small result table as one file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def artifact(tree: object, edges: dict[str, list[float]] | None = None, model: dict | None = None, split: dict | None = None) -> str:
    """Versioned JSON of a tree: how it was made, its bins, the recursive tree and the rules of its leaves."""
    from coppice.plans import trees

    return json.dumps({
        "version": 1, "model": model or {}, "split": split or {}, "edges": edges or {}, "tree": trees.to_dict(tree), "statistics": trees.statistics(tree),
        "rules": [{"if": c, "then": p} for c, p in trees.rules(tree, edges)],
    })
