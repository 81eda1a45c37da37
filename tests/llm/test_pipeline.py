"""The pipeline against what its stages say of their own inputs, and against a plain version of each."""

import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import LONG, brute_classes, brute_hits

from coppice.llm import common, langid, packing, probminhash, queries, toxicity
from coppice.llm.common import table
from coppice.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """The smallest tables with odd rows: nulls, empty and long texts, copies, benchmark passages, repeated ids, clashing columns."""
    path = str(tmp_path_factory.mktemp("sf"))
    d = table(spark, SF, "documents")
    rows = d.orderBy("doc_id").collect()
    item = next(r["text"] for r in table(spark, SF, "benchmark").collect() if len(r["text"].split()) > 30)
    plain = next(r for r in rows if len(r["text"]) > 1500 and r["lang"] == "en")
    words = plain["text"].split()
    near = " ".join([*words[:-3], "xx", "yy", "zz"])
    own = " ".join(f"the{i} and{i % 7}" for i in range(40))
    more = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, LONG), (10**6 + 3, plain["text"]), (10**6 + 4, near), (10**6 + 5, "Well then. " + item), (10**6 + 6, "12 34"), (None, own), (10**6 + 7, rows[0]["text"]), (10**6 + 7, "like no other text"), (10**6 + 7, "like no other text")]
    odd = spark.createDataFrame([(i, t, None, "src", None) for i, t in more], d.schema)
    d.unionByName(odd).withColumns({c: F.lit(c) for c in CLASHING}).write.parquet(f"{path}/documents.parquet")
    for t in ("labels", "benchmark"):
        table(spark, SF, t).write.parquet(f"{path}/{t}.parquet")
    return path


CLASHING = ("score", "kept", "items", "predicted", "held_out", "class_id", "piece", "n_words", "n_hit", "contaminated", "margin", "rejected", "_doc", "_digest", "_1", "row")


def untouched(df):
    """Whether the columns that operators use themselves hold what they held, of the type they had."""
    told = " AND ".join(f"`{c}` = '{c}'" for c in CLASHING)
    return all(dict(df.dtypes)[c] == "string" for c in CLASHING) and df.where(f"NOT coalesce({told}, false)").count() == 0


def ids(rows):
    return Counter((r["doc_id"], r["text"]) for r in rows)


def test_stages_equal_plain_versions(spark, planted):
    df = table(spark, planted, "documents")
    columns, stages = df.columns, dict(corpus_pipeline.STAGES)
    crc = lambda i: zlib.crc32(str(i).encode()) if i is not None else 0

    rows = df.collect()
    labels = {}
    for r in table(spark, planted, "labels").collect():
        if r["toxic"] is not None and crc(r["doc_id"]) % 3 != 1:
            labels[r["doc_id"]] = max(labels.get(r["doc_id"], 0), int(r["toxic"] > 0))
    known = sorted((r["doc_id"], r["text"] or "") for r in rows if r["doc_id"] in labels)
    scorer = toxicity.Scorer(toxicity.train([t for _, t in known], [labels[i] for i, _ in known]))
    scores = [float(scorer([r["text"]])[0]) for r in rows]
    assert all(abs(s - 0.7) > 1e-4 for s in scores)
    got = stages["toxicity"](spark, df, planted).cache()
    assert ids(got.collect()) == ids(r for r, s in zip(rows, scores, strict=True) if s < 0.7) and got.columns == columns and untouched(got)

    rows = got.collect()
    classify = langid.Classifier(langid.fit(got.where(F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5, F.lit(0)) != 0)))
    told = [classify(r["text"]) for r in rows]
    df, got = got, stages["language ID"](spark, got, planted).cache()
    assert ids(got.collect()) == ids(r for r, (k, _, b, m) in zip(rows, told, strict=True) if k != "und" and b > 1 and m > 0.0005) and got.columns == columns and untouched(got)
    assert not {10**6, 10**6 + 1, 10**6 + 6} & {r["doc_id"] for r in got.collect()}

    rows = got.collect()
    odd = (None, 10**6 + 7)  # ids that are missing, or repeat
    want = brute_classes(sorted((r["doc_id"], r["text"]) for r in rows if r["doc_id"] not in odd))
    text = {r["doc_id"]: r["text"] for r in rows if r["doc_id"] not in odd}
    df, got = got, stages["near-dedup"](spark, got, planted).cache()
    left = got.collect()
    kept = Counter((i, text[i]) for i in set(want.values())) + Counter((None, r["text"]) for r in rows if r["doc_id"] is None)
    kept[10**6 + 7, "like no other text"] += 1
    assert any(r["text"] == text[min(text)] for r in rows if r["doc_id"] == 10**6 + 7)  # a copy that shares its id
    assert ids(left) == kept and got.columns == columns and untouched(got)

    items = [(r["item_id"], r["text"]) for r in table(spark, planted, "benchmark").collect()]
    hits = [brute_hits(r["text"], items) for r in left]
    df, got = got, stages["decontamination"](spark, got, planted).cache()
    assert ids(got.collect()) == ids(r for r, (n, h, _) in zip(left, hits, strict=True) if not (h > 0 and 20 * h >= n)) and got.columns == columns and untouched(got)
    assert 10**6 + 5 not in {r["doc_id"] for r in got.collect()}

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = Counter()
    for r in got.collect():
        own = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        for k, (s, n) in enumerate(packing.pieces_of(len(own), 1024)):
            want[r["doc_id"], k, s, n, zlib.crc32(np.array(own[s : s + n], "<u4").tobytes())] += 1
    packed = stages["pattern packing"](spark, got, planted).collect()
    assert Counter(tuple(r)[:5] for r in packed) == want
    total, used = sum(r["length"] for r in packed), len({r["sequence_id"] for r in packed})
    assert used <= -(-total // 1024) + 3
    run = corpus_pipeline.run(spark, planted).collect()
    assert Counter(tuple(r)[:5] for r in run) == want


def test_an_id_that_repeats_decides_over_its_own_text_only(spark):
    rows = [(1, "a"), (5, "a"), (5, "z"), (7, "m"), (7, "y"), (7, "y"), (8, ""), (8, ""), (9, None), (None, "a"), (None, "a")]
    got = probminhash.deduplicated(spark.createDataFrame([(*r, i, {"k": i}) for i, r in enumerate(rows)], "doc_id long, text string, _doc int, m map<string,int>"))
    assert Counter((r[0], r[1]) for r in got.collect()) == Counter([(1, "a"), (5, "z"), (7, "m"), (7, "y"), (8, ""), (8, ""), (9, None), (None, "a"), (None, "a")])
    assert got.columns == ["doc_id", "text", "_doc", "m"] and all(rows[r["_doc"]] == (r[0], r[1]) for r in got.collect())
    classes = probminhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r[0], r[1], r[2]) for r in classes) == Counter([(1, 1, True), (5, 1, False), (5, 5, True), (7, 7, True), (7, 7, True), (7, 7, True), (8, 8, True), (8, 8, True), (9, 9, True), (None, None, True), (None, None, True)])


def test_near_dedup_where_ids_are_too_many_to_broadcast(spark, monkeypatch):
    df = table(spark, SF, "documents")
    few = probminhash.deduplicated(df)
    want = ids(few.collect())
    monkeypatch.setattr(common, "BROADCAST_IDS", 0)
    assert ids(probminhash.deduplicated(df).collect()) == want and len(want) < 200


def test_empty_tables(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        table(spark, SF, t).limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    df = table(spark, str(tmp_path), "documents")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, df, str(tmp_path))
        assert got.count() == 0 and (name == "pattern packing" or got.columns == df.columns)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_take_effect(spark):
    df = table(spark, SF, "documents")
    columns = df.columns
    sizes = [df.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, SF)
        assert df.columns == columns, name
        df = df.cache()
        sizes.append(df.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] < sizes[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, df, SF)
    ids = {r[0] for r in df.select("doc_id").collect()}
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == ids
    assert packed.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 1024


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert got.count() > 0


def test_queries_are_registered():
    names = queries.queries()
    assert [sum(k.startswith(f"op{n}_") for k in names) for n in range(1, 14)] == [1] * 13
    assert set(queries.oracle_sql()) <= set(names)
