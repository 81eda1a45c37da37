"""Cleaning of a document corpus in stages: each is a DataFrame in, a DataFrame out, written and reread between."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from coppice.llm import langid, packing, probminhash, toxicity, wumanber
from coppice.llm.common import own_names, remainder, table, written
from coppice.llm.queries import tokenizer_path


def passing(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], verdict: str) -> DataFrame:
    """The rows of docs of which ``verdict`` holds over the columns that ``judge`` adds to them, as they were. The judge sees
    doc_id and text by name and the other columns under names of their own, so it replaces none, whatever they are called."""
    own = own_names(docs)
    return judge(docs.toDF(*own)).where(verdict).select(*own).toDF(*docs.columns)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose highest window scores 0.7 or more go. Learns from two thirds of the labelled rows, whole texts.

    Null and empty texts are one window without words; all windows of a long text are scored, whatever its length; rows
    that repeat are scored alike; nothing ties, as 0.7 itself goes. Without labels of both kinds all score alike and stay.
    No documents give none. The columns of docs come back as they were.
    """
    labels = table(spark, sf_dir, "labels")
    net = toxicity.fit(docs, labels.where(remainder("doc_id", 3) != 1))
    return passing(docs, lambda d: toxicity.score(d, net), "predicted = 0")


def language_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or as near to two languages but for a byte, go. Learns from four fifths of the rows.

    Null and empty texts have no letter and go; long texts are encoded whole; a tie of two languages is a margin of 0 and
    goes; rows that repeat are judged alike; where nothing can be learned all go. No documents give none. The columns of
    docs come back as they were.
    """
    model = langid.fit(docs.where(remainder("doc_id", 5) != 0))
    return passing(docs, lambda d: langid.predict(d, model), "not rejected")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by five-word shingles with a Jaccard similarity of 0.8 or more one stays: that of the smallest id,
    then of the smallest digest of its text. Rows of one id but other texts are documents of their own; of rows that repeat
    id and text one stays (ties: the smallest hash of the other columns). Rows without an id, or with a null or empty text,
    stay. Long texts are compared whole. No documents give none. The columns of docs come back as they were."""
    return probminhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more of the words lie in windows of the benchmark go.

    Null, empty and wordless texts hold no window and stay; long texts are searched whole; rows that repeat are judged
    alike; exactly a twentieth goes; an empty benchmark leaves all. No documents give none. The columns of docs come back
    as they were.
    """
    return passing(docs, lambda d: wumanber.scan(d, table(spark, sf_dir, "benchmark")), "not contaminated")


def pattern_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents kept, packed into sequences of 1024 tokens.

    Null and empty texts are the end token alone; longer texts than a sequence are cut, whole; rows that repeat are packed
    each; equal lengths go in any order; columns but doc_id and text are left out. No documents give none.
    """
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", toxicity_filter),
    ("language ID", language_filter),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("pattern packing", pattern_packing),
]

#: The first two stages learn and the last packs; SQL expresses none of these. Tests hold each stage and run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "-"))
    return docs
