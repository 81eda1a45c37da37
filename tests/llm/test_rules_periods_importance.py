"""Line rules, periodic runs and importance resampling against plain versions, with odd rows and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from test_operators import DOCS, LONG, ODD, docs

from coppice.llm import importance, line_rules, periods, queries

MORE = [(8, "a b " * 50 + "a", "en"), (9, "One.\n\nTwo two.\nOne.\n | home | news | mail |\nPlease accept our cookies.\nIt ends here", None), (10, " x y z\x0bq\x1cr", None)]


# --- 11


def plain_runs(ids, times=4, least=6):
    n, out = len(ids), []
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and ids[j] == ids[j + q]:
                j += 1
            s = ids[i : j + q]
            if len(s) >= max(least, times * q) and not any(s[d:] == s[:-d] for d in range(1, q)):
                out.append((i, len(s), q))
            i = max(i + 1, j)
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic(r):
    x = [r.randrange(r.choice([1, 2, 3, 8, 30])) for _ in range(r.randint(0, 120))]
    for _ in range(r.randint(0, 3) if len(x) > 8 else 0):
        a, p = r.randrange(len(x)), r.randint(1, 12)
        for i in range(a, min(len(x), a + p * r.randint(2, 9))):
            x[i] = x[a + (i - a) % p]
    return x


def test_runs_and_lag_counts_equal_plain_ones():
    r = random.Random(1)
    for _ in range(1500):
        x = periodic(r)
        number = {}
        ids = np.array([number.setdefault(v, len(number)) for v in x], np.int64)
        assert periods.runs_of(ids) == plain_runs(ids.tolist())
        want = [0, *(int((ids[q:] == ids[:-q]).sum()) for q in range(1, len(ids)))] if len(ids) > 1 else None
        for heavy in (0.0, 0.5, 1e9):  # all words by transforms, some, none
            assert want is None or periods.lag_matches(ids, len(ids) - 1, heavy).tolist() == want


def test_long_texts_of_few_words_are_scanned_within_bounds():
    assert periods.runs_of(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]
    assert periods.runs_of(np.arange(200_000) % 997) == [(0, 200_000, 997)]


def test_runs_of_rows(spark):
    rows = [*ODD, *MORE]
    got = periods.find(docs(spark, rows)).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() >= {"doc_id", "text", "lang", "score", "kept"}
    key = lambda x: str(x)
    want = []
    for i, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        runs = plain_runs(words) if len(words) < 1000 else periods.runs_of(np.unique(words, return_inverse=True)[1])
        gone = {p for s, n, q in runs for p in range(s + q, s + n)}
        want.append((i, len(words), runs, " ".join(w for p, w in enumerate(words) if p not in gone)))
    assert sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got), key=key) == sorted(want, key=key)
    assert any(x[2] == [(0, 101, 2)] and x[3] == "a b" for x in want)
    assert periods.find(docs(spark, [])).count() == 0 and "text" not in periods.find(docs(spark, []), without=("text",)).columns


def test_planted_periods(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 57))) for i in range(300)] + [(None, "a b"), (4, None), (17, " ")]
    for r in queries.with_planted_periods(docs(spark, rows)).collect():
        h = zlib.crc32(str(r["doc_id"]).encode())
        w = next(t for i, t in rows if i == r["doc_id"]) if r["doc_id"] not in (4, 17) else (r["text"] or "")
        w, g = (w or "").split(), h // 10
        if r["doc_id"] is None or h % 10 or not w:
            assert (r["text"] or "").split() == w
            continue
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        assert r["text"].split() == [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]


# --- 12


def plain_resample(rows, target, share=5, least=20, buckets=10_000):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    hashed = lambda w: [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in (1, 2, 3) for i in range(len(w) - k + 1)]
    told, s, t = [(i, split(x), hashed(split(x))) for i, x in rows], Counter(), Counter()
    for _, _, h in told:
        s.update(h)
    for x in target:
        t.update(hashed(split(x)))
    all_s, all_t = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for i, w, h in told:
        u = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in h)
        out.append([i, len(h), weight, weight + math.floor(-1000 * math.log(-math.log((u + 0.5) / 2**32))), None, len(w)])
    drawn = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] is None, x[0]))
    for place, x in enumerate(drawn[: share * len(drawn) // 100]):
        x[4] = place + 1
    return sorted((tuple(x[:5]) for x in out), key=str)


@pytest.mark.parametrize("share", [5, 60])
def test_resampling_equals_a_plain_version(spark, share):
    r = random.Random(2)
    vocabulary = ["Alpha", "beta", "été", "ÉTÉ", "x1", "don't", "中文", "zz", "the", "The"]
    rows = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 60)))) for i in range(250)]
    rows += [(1, None), (2, ""), (None, "beta " * 30), (None, "beta " * 30), (3, rows[3][1]), (900, LONG), (901, "one two three"), (902, "--- ..")]
    target = ["alpha beta the", None, "", "x1 " * 7]
    aims = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id int, text string")
    df = docs(spark, rows).selectExpr("*", "'a' AS rank", "'b' AS weight", "'c' AS bucket", "'d' AS _row", "'e' AS b1").repartition(5)
    got = importance.resample(df, aims, share).collect()
    assert sorted(map(tuple, got), key=str) == plain_resample(rows, target, share)


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id int, text string")
    assert importance.resample(docs(spark, []), none).count() == 0
    assert sorted(map(tuple, importance.resample(docs(spark, ODD), none).collect()), key=str) == plain_resample([r[:2] for r in ODD], [])


# --- 13


def plain_clean(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {p for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for p in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    lost = failed = 0
    left = []
    for line in (text or "").split("\n"):
        own = re.findall(r"[^\x20\x09-\x0D]+", line)
        low = re.sub("[A-Z]", lambda m: m[0].lower(), line)
        marks = sum(c in line_rules.MARKS for c in line)
        ends = any(re.search(r"""[.!?…。！？؟।]["'”’»)\]]*$""", w) for w in own)
        if own and (not ends or (marks >= 3 and 4 * marks >= len(own)) or (len(own) <= 20 and any(p in low for p in line_rules.PHRASES))):
            failed, lost = failed + 1, lost + sum(map(len, own))
        else:
            left.append(line)
    chars, n = sum(map(len, words)), len(words)
    base = n < 10 or 100 * len(covered) > 20 * n
    return (n, chars, sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed, lost, base,
            not base and 100 * lost <= 30 * chars, None if text is None else "\n".join(left))


def test_line_rules_equal_a_plain_version(spark):
    r = random.Random(4)
    pieces = ["He said so.", "home | news | mail", "Sign in", "cookie policy", "no end", "(It is true!)", "a & b % c $", "  ", "Wirklich？ ja", "x y z w v", "x y z w v", "\ttab.\x0bvt", "…", "un deux trois."]
    rows = [(i, "\n".join(" ".join(r.choice(pieces) for _ in range(r.randint(0, 5))) for _ in range(r.randint(0, 7)))) for i in range(300)]
    rows += [x[:2] for x in [*ODD, *MORE]]
    got = line_rules.clean(docs(spark, rows)).collect()
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_failed_lines", "lost_chars", "base_failed", "kept", "cleaned"]
    assert sorted(((x["doc_id"], *(x[f] for f in fields)) for x in got), key=str) == sorted(((i, *plain_clean(t)) for i, t in rows), key=str)
    assert sum(x["kept"] is True for x in got) > 5 and all(x["lang"] in ("src", "en", "de", None) for x in got)
    assert line_rules.clean(docs(spark, [])).count() == 0


def test_line_rules_run_no_python(spark):
    plan = line_rules.clean(docs(spark, ODD).coalesce(1))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_columns_of_docs_are_kept(spark):
    df = docs(spark, ODD)
    assert df.columns == [f.split()[0] for f in DOCS.split(", ")]
    assert set(line_rules.clean(df).columns) >= set(df.columns) and line_rules.clean(df).first()["score"] is not None
