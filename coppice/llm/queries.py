"""The operators over whole tables with production parameters, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.llm import brown, importance, langid, licences, line_rules, multi_index, oracles, packing, periods, probminhash, toxicity, warc, wrappers, wumanber
from coppice.llm.common import table


def tokenizer_path(name: str) -> str:
    """Place of a vocabulary file: a parameter of the operators, here that of the installed package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_compression_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.fit_predict(docs, without=("text", "lang")).select("doc_id", "held_out", "lang_pred", "score", "margin_bytes", "margin", "rejected")


def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read(warc.write(table(spark, sf_dir, "pages")), payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_wrapper_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op4_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.linked(table(spark, sf_dir, "embeddings"))


def op5_wu_manber_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = wumanber.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_brown_class_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score(table(spark, sf_dir, "documents"))


def op7_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(
        table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken")
    )


def op8_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text_digest", "licence", "notices", "n_notice_lines")


def op9_probminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_bigru_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.fit_score(docs, table(spark, sf_dir, "labels"), without=("text",)).select("doc_id", "held_out", "score", "predicted")


def op11_lag_counting_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = periods.find(with_planted_periods(docs), without=("text",))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    got = got.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("_best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = -F.col("_best.start"), F.col("_best.length"), -F.col("_best.period")
    return got.select(
        "doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text, where in one of ten documents, by the checksum of the id, the words from some place on repeat."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    plant = docs.select("doc_id", "text", h.alias("_h"), g.alias("_g"))

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(F.col("_g"), n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(F.col("_g"), F.lit(8))))
        place = lambda i, ap: F.when(i < ap["a"], i).otherwise(ap["a"] + F.pmod(i - ap["a"], ap["p"])).cast("int")
        made = line_rules.let(F.struct(a.alias("a"), p.alias("p")), lambda ap: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, place(i, ap))))
        return F.when(n > 0, F.concat_ws(" ", made)).otherwise(F.lit(""))

    words = F.filter(F.split("text", line_rules.SPACE), lambda x: x != "")
    return plant.select("doc_id", F.when(F.col("_h") % 10 == 0, line_rules.let(words, repeated)).otherwise(F.col("text")).alias("text"))


def op12_position_table_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_line_first_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = line_rules.clean(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_failed_lines", "lost_chars", "base_failed", "kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
