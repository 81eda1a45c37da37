"""The ten operators on small tables: brute force, round trips, held-out accuracy and odd rows."""

import json
import math
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from coppice.llm import brown, graph, langid, licences, multi_index, packing, probminhash, toxicity, warc, wrappers, wumanber
from coppice.llm.common import words
from coppice.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, score string, kept string, items string, chunk string, blocks string"
LONG = " ".join(f"w{i % 997} and x{i % 31}" for i in range(30_000))


def docs(spark, rows, extra=True):
    """doc_id, text, lang with further columns whose names the operators use themselves."""
    more = ("src", "a", "b", "c", "d", "e") if extra else ()
    schema = DOCS if extra else "doc_id long, text string, lang string"
    return spark.createDataFrame([(*(tuple(r) + (None,) * (3 - len(r))), *more) for r in rows], schema)


ODD = [(1, None, None), (2, "", "en"), (3, "!!! ...", None), (4, "Same words here again and again", "en"), (4, "Same words here again and again", "en"), (5, "Same words here again and again", "en"), (None, "no id at all", "en"), (6, LONG, None), (7, "éß 中文 \U0001f600", "de")]


def sample(n, seed=1):
    r = random.Random(seed)
    vocabulary = {"en": "the and of tion ing th er wh".split(), "de": "der und ein ung lich sch keit ver".split()}
    return [(i, " ".join("".join(r.choice(vocabulary[k]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(3, 60))), k) for i in range(n) for k in [r.choice(["en", "de"])]]


# --- 1


def test_language_accuracy_and_odd_rows(spark):
    rows = sample(400)
    got = {r["doc_id"]: r for r in langid.fit_predict(docs(spark, rows)).collect()}
    held = [(got[i]["lang_pred"], k) for i, _, k in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in rows)
    assert sum(a == b for a, b in held) / len(held) > 0.95
    odd = langid.fit_predict(docs(spark, [*ODD, *((i + 100, t, k) for i, t, k in rows)])).collect()
    assert len(odd) == len(ODD) + len(rows)
    by = {r["doc_id"]: r for r in odd}
    assert by[1]["lang_pred"] == by[2]["lang_pred"] == by[3]["lang_pred"] == "und"
    assert by[1]["rejected"] and by[1]["score"] == 0 and all(0 <= r["score"] <= 1 for r in odd)
    assert by[6]["lang_pred"] in ("en", "de")
    nothing = langid.fit_predict(docs(spark, [(1, "word", None)])).first()
    assert nothing["lang_pred"] == "und"
    assert langid.fit_predict(docs(spark, [])).count() == 0


def test_texts_without_letters_are_undetermined(spark):
    rows = [(i + 10, t, k) for i, (_, t, k) in enumerate(sample(100))]
    got = {r["doc_id"]: r for r in langid.fit_predict(docs(spark, [(1, "½ ² Ⅷ", "en"), (2, "42 -- _", "en"), (3, "½ der und", None), (3, "½ der und", None), *rows])).collect()}
    assert [got[i]["lang_pred"] == "und" for i in (1, 2, 3)] == [True, True, False] and got[1]["score"] == 0


def test_languages_are_learned_from_all_of_a_text(spark):
    rows = [(i, "xq " * 3000 + f"{stem}ta {stem}lo {stem}mi " * 400, stem) for i in range(40) for stem in [("gra", "pol")[i % 2]] if zlib.crc32(str(i).encode()) % 5]
    model = langid.fit(docs(spark, rows), dictionary_bytes=2000)
    assert all(stem.encode() in d for stem, d in zip(model.languages, model.dictionaries, strict=True))
    c = langid.Classifier(model)
    assert [c("grata gralo grami")[0], c("polta pollo polmi")[0]] == ["gra", "pol"]
    assert c("xq xq")[2] <= 1  # the same in both: too narrow


def test_narrow_margins_reject(spark):
    model = langid.Model(("a", "b"), (b"one two three " * 9, b"one two three " * 9), (b"one ", b"one "))
    got = langid.predict(docs(spark, [(1, "one two"), (2, None), (3, "one two")]), model).collect()
    assert all(r["rejected"] for r in got) and [r["lang_pred"] for r in got] == ["a", "und", "a"]
    assert "text" not in langid.predict(docs(spark, []), model, without=("text",)).columns


def test_languages_equal_a_plain_version(spark):
    import zstandard as z

    rows = [*sample(150), (900, LONG, None), (901, "Ünd der üng", None), (902, "x", None)]
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    model = langid.fit(docs(spark, held))
    got = {r["doc_id"]: r for r in langid.predict(docs(spark, rows), model).collect()}
    params = z.ZstdCompressionParameters.from_level(model.level, min_match=3, window_log=19, write_content_size=0, write_checksum=0, write_dict_id=0)
    for i, text, _ in rows:
        data, sizes = langid.letters(text), []
        for d, p in zip(model.dictionaries, model.prefixes, strict=True):
            size = lambda x, d=d: len(z.ZstdCompressor(dict_data=z.ZstdCompressionDict(d, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=params).compress(x))
            sizes.append(sum(size(p + data[k : k + model.block]) - size(p) for k in range(0, len(data), model.block)))
        best = int(np.argmin(sizes))
        assert got[i]["lang_pred"] == model.languages[best] and got[i]["margin_bytes"] == sorted(sizes)[1] - min(sizes)
        assert got[i]["score"] == pytest.approx(1 / sum(2.0 ** (min(sizes) - s) for s in sizes))


def test_whole_text_counts():
    model = langid.Model(("a", "b"), (b"alpha beta gamma " * 50, b"uno dos tres " * 50), (b"alpha ", b"uno "), block=64)
    c = langid.Classifier(model)
    assert c("alpha beta gamma " * 20 + "uno dos tres " * 200)[0] == "b"


# --- 2

PAGES = "page_id long, url string, html string, digest string, first string"


def test_warc_round_trip(spark, tmp_path):
    rnd = random.Random(3)
    noise = bytes(rnd.randrange(256) for _ in range(60_000)).decode("latin-1")
    rows = [(1, "http://a/", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://c/\r\nX: y", None), (4, "", ""), (5, "http://e", "é" * 1000), (6, "u", noise), (9, "v", noise), (2, None, "<p>x</p>")]
    rows += [(100 + i, f"http://h/{i}", noise[i : i + 500]) for i in range(200)]
    df = spark.createDataFrame([(*r, "d", "f") for r in rows], PAGES).repartition(3)
    manifest = warc.write(df)
    for size in (100, 5000, 1 << 23):
        got = warc.read(manifest, split_bytes=size).collect()
        assert len(got) == len(rows)
        by = {r["page_id"]: r for r in got}
        for i, _, html in rows:
            payload = (html or "").encode()
            assert by[i]["payload_bytes"] == len(payload) and by[i]["payload_digest"] == warc.base32_sha1(payload)
            if by[i]["record_type"] == "response":
                assert bytes(by[i]["payload"]) == payload and by[i]["refers_to"] is None
        assert [(by[i]["record_type"], by[i]["refers_to"]) for i in (1, 2, 3, 4, 6, 9)] == [("response", None), ("revisit", 1), ("response", None), ("revisit", 3), ("response", None), ("revisit", 6)]
    assert by[1]["url"] == "http://a/" and by[2]["url"] is None
    assert {r["record_type"] for r in warc.read(warc.write(df.where("page_id < 5"), min_bytes=9)).collect()} == {"response"}
    assert warc.read(warc.write(df.limit(0))).count() == 0


def test_warc_reads_long_records_in_linear_time(spark):
    import io
    import time

    long = b"".join(random.Random(1).randbytes(1 << 20) for _ in range(24))
    z = zlib.compressobj(0, zlib.DEFLATED, 31)
    member = z.compress(b"WARC/1.1\r\nContent-Length: %d\r\n\r\n" % len(long) + long) + z.flush()
    start = time.process_time()
    found = list(warc.records_in(io.BytesIO(member * 2), 1, 1 << 40))
    assert [(at, len(raw)) for at, raw in found] == [(len(member), len(long) + 38)] and time.process_time() - start < 5
    rows = spark.createDataFrame([(None, "a", "x"), (7, "b", "x"), (None, "c", "y"), (None, "d", "y")], "page_id long, url string, html string")
    got = {r["url"]: (r["page_id"], r["record_type"], r["refers_to"]) for r in warc.read(warc.write(rows)).collect()}
    assert got["b"] == (7, "response", None) and got["a"] == (None, "revisit", 7) and got["c"][1] == got["d"][1] == "response"


def test_warc_reader_passes_over_false_magic(tmp_path):
    import gzip
    import io

    inner = warc.MAGIC + b"no member" + gzip.compress(b"not a record")
    z = zlib.compressobj(0, zlib.DEFLATED, 31)
    raw = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % len(inner) + inner + b"\r\n\r\n"
    member = z.compress(raw) + z.flush()  # stored: the magic occurs inside
    data = b"junk" + member + member
    for step in (1, 7, 50, 10_000):
        found = [at for lo in range(0, len(data), step) for at, got in warc.records_in(io.BytesIO(data), lo, lo + step) if got == raw]
        assert found == [4, 4 + len(member)]


# --- 3


def test_wrappers(spark):
    def page(paragraphs, extra=""):
        return f"<html><head><title>t</title><script>var a='</p>'</script></head><body><nav><ul><li><a href=x>menu</a></ul></nav><div class='ad'>buy</div><article><h1>A &amp; B</h1>{''.join(f'<p>{p}' for p in paragraphs)}{extra}</article><footer>f</footer>"

    rows = [(i, f"http://h{i % 2}.x/{i}", page([f"one {i}", "two <b>bold</b><br>\n next"][: 1 + i % 2] * (i + 1)), "t", 1, "h") for i in range(8)]
    rows += [(20, "http://h0.x/z", page(["p"], "<section class='comments'><p>reader</p></section>"), "t", 1, "h"), (21, None, None, "t", 1, "h"), (22, "odd", "", "t", 1, "h"), (23, "http://h1.x/q", "plain  text", "t", 1, "h"), (20, "http://h0.x/z", page(["p"]), "t", 1, "h"),
             (24, "http://h1.x/w", "<body><div class='content'><main><h2>T</h2><p>x<p>y<form>f</form></main></div><aside>s</aside></body>", "t", 1, "h")]
    got = wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int, host string")).collect()
    by = defaultdict(list)
    for r in got:
        by[r["page_id"]].append(r["text"])
        assert r["n_chars"] == len(r["text"])
    for i in range(8):
        assert by[i] == ["\n".join(["A & B", *[f"one {i}", "two bold next"][: 1 + i % 2] * (i + 1)])]
    assert by[20] == ["A & B\np"] * 2
    assert by[21] == by[22] == [""] and by[23] == ["plain text"] and by[24] == ["T\nx\ny"]
    assert wrappers.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def text_of(html):
    return wrappers.Extractor()(html, None)


def test_alignment_covers_both():
    a, b = (wrappers.fold(wrappers.parse(h)[0]) for h in ("<div><p>1<p>2<ul><li>x<li>y</ul></div>", "<div><h2>t</h2><p>1</div>"))
    ((one, n),) = wrappers.infer([(a, 3), (b, 1)])
    e = wrappers.Expression(one)
    assert n == 4
    for html in ("<div><p>1<p>2<p>3</div>", "<div><h2>t</h2><p>1<ul><li>x</ul></div>"):
        stream, texts, _ = wrappers.parse(html)
        slots = e.fill(stream)
        assert len(slots) == len(texts) and e.followed("".join(e.letters[t] for t in stream)) == slots
    assert json.loads(json.dumps(one)) == one


def test_pages_that_are_not_well_formed():
    assert text_of("<html><head><title>t</title><body><article><p>Hello world</p></article>") == "Hello world"
    assert text_of("<html><head><title>t</title>Hello <b>world") == "Hello world"
    assert text_of("<article><p>Let x be <math><mi>b</mi><mo>+</mo></math> or <button>z</button></p></article>") == "Let x be b+ or z"
    assert text_of("<article><p>a</p><select><option>b</article><footer>f</footer>") == "a"
    assert text_of("<article><p>a<svg><text>b</text></svg> c<form><button>d</button></form>") == "a c"
    assert text_of('<article class="post teaser-style social"><p>a</article><article class="comment"><p>b</article>') == "a"
    assert text_of('<article><section class="related work"><p>a</section><section class="related-posts"><p>b</section></article>') == "a"
    assert text_of("<script>x") == text_of(None) == text_of("<nav>only a menu</nav>") == ""


def test_long_and_deep_pages_are_read_whole(spark):
    long = "<article>" + "".join(f"<h{i % 5 + 1}>h{i}</h{i % 5 + 1}><p>t{i}" for i in range(20_000)) + "</article>"
    deep = "<div>" * 3000 + "<article><p>x</article>"
    got = wrappers.extract(spark.createDataFrame([(1, "http://a/", long), (2, "http://a/", deep), (2, "http://a/", deep)], "page_id long, url string, html string")).collect()
    by = {r["page_id"]: r["text"] for r in got}
    assert len(got) == 3 and by[2] == "x" and by[1] == "\n".join(f"h{i}\nt{i}" for i in range(20_000))


def test_slots_do_not_hang_on_the_time():
    group = [["p", 0], ["#", 0], ["/p", 0]]
    hard = [[group, 0]] + [[group, i] for i in range(1, 30)] + [["div", 0], ["/div", 0]]
    e = wrappers.Expression(hard)
    for n in (1, 60, 400):
        stream = ["p", "#", "/p"] * n
        assert e.fill([*stream, "div", "/div"]) == [0] * n
        assert e.fill(stream) is None and e.followed("".join(e.letters[t] for t in stream)) is None


def test_templates_without_names_are_told_by_what_varies(spark):
    def page(i, content):
        return f"<body><div><div><a href=/>Home</a> <a href=/b>Books {i}</a></div><div>{content}</div><div>All rights of the site</div></div></body>"

    rows = [(i, f"http://a.x/{i}", page(i, "".join(f"<p>Words {i} of {k}</p>" for k in range(1 + i % 4)))) for i in range(12)]
    rows += [(100 + i, "http://b.x/", page(0, "<p>the same words</p>")) for i in range(5)]  # copies of one page
    rows += [(200 + i, f"http://c.x/{i}", f"<body><article><p>All rights of the site</p><p>{i}</p></article></body>") for i in range(6)]  # named
    got = {r["page_id"]: r["text"] for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(12)] == ["\n".join(f"Words {i} of {k}" for k in range(1 + i % 4)) for i in range(12)]
    assert {got[100 + i] for i in range(5)} == {"the same words\nAll rights of the site"}
    assert [got[200 + i] for i in range(6)] == [f"All rights of the site\n{i}" for i in range(6)]
    assert wrappers.Extractor()(rows[1][2], None) != got[1]  # what a page tells alone is not the answer


def test_all_skeletons_of_a_host_are_aligned(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "GROUP", 4)
    tags = ["h2", "h3", "pre", "blockquote", "ul"]
    shape = lambda i: "".join(f"<{t}>x{i}</{t}>" for k, t in enumerate(tags) if i >> k & 1)
    rows = [(i, "http://a.x/", f"<nav>m</nav><article><h1>t{i}</h1><p>a{i}</p>{shape(i)}<h6>z</h6></article>") for i in range(32)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    counted = wrappers.skeleton_counts(df.withColumn("host", F.lit("a")))
    n = counted.count()
    found = wrappers.wrappers(counted).collect()
    assert n == 32 and len(found) < 8 and sum(r["n"] for r in found) == 32
    assert {r["page_id"]: r["text"].count("\n") for r in wrappers.extract(df).collect()} == {i: 2 + i.bit_count() for i in range(32)}


# --- 4


def test_multi_index_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(150, 16))
    near = np.concatenate([base[:20] + rng.normal(size=(20, 16)) * s for s in (0.01, 0.05, 0.1)] + [base[:1] + rng.normal(size=(300, 16)) * 0.08])
    x = np.concatenate([base, near, base[:5], 3 * base[5:8]]).astype(np.float32)
    rows = [(int(i), [float(v) for v in r], 0) for i, r in enumerate(x)]
    n = len(rows)
    odd = [(n, None, 0), (n + 1, [], 0), (n + 2, [0.0] * 16, 0), (n + 3, [float("nan")] * 16, 0), (n + 4, [None] + [1.0] * 15, 0), (n + 5, [1.0], 0), (None, [1.0] * 16, 0), (3, rows[3][1], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, cell int")
    got = multi_index.linked(df).collect()
    assert len(got) == n + len(odd)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    link = (u @ u.T >= 0.95) & ~np.eye(n, dtype=bool)
    label = np.arange(n)
    for _ in range(n):
        new = np.minimum(label, np.where(link, label[None], n).min(1))
        if (new == label).all():
            break
        label = new
    by = {r["vec_id"]: r for r in got}
    found = np.array([by[i]["n_links"] for i in range(n)])
    assert (found <= link.sum(1)).all() and found.sum() >= 0.98 * link.sum()
    assert np.mean([by[i]["component_id"] == label[i] for i in range(n)]) > 0.98
    assert all((by[i]["n_links"], by[i]["component_id"], by[i]["kept"]) == (0, i, True) for i in range(n, n + 6))
    assert multi_index.recall_against_brute_force(df, every=10) >= 0.9
    assert multi_index.linked(df.limit(0)).count() == 0
    assert multi_index.linked(df.where(f"vec_id = {n}")).first()["n_links"] == 0


def test_vectors_of_every_length_and_size_link(spark):
    rng = np.random.default_rng(4)
    rows = []
    for dim in (9, 16, 33):
        for i in range(6):
            x = rng.normal(size=dim)
            rows += [(len(rows) + j, [float(v) for v in x * s]) for j, s in enumerate((1.0, 1e200, 1e-200, -1.0))]
    for options in ({}, {"sample": 1}):  # lengths that the sample has not are indexed too
        got = {r["vec_id"]: r for r in multi_index.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), **options).collect()}
        for i in range(0, len(rows), 4):
            assert [got[i + j]["component_id"] for j in range(3)] == [i] * 3 and got[i + 3]["component_id"] == i + 3
            assert [got[i + j]["n_links"] for j in range(4)] == [2, 2, 2, 0]


def test_blocks_split_hot_cells(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "MEMBERS", 8)
    monkeypatch.setattr(multi_index, "VISITORS", 8)
    rng = np.random.default_rng(1)
    x = np.ones(8) + rng.normal(size=(60, 8)) * 0.01
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = multi_index.linked(df).collect()
    assert sum(r["n_links"] for r in got) >= 0.98 * 60 * 59 and max(r["n_links"] for r in got) == 59
    assert {r["component_id"] for r in got} == {0}


# --- 5


def brute_hits(text, items):
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        b = words(t)
        for k in range(max(1, len(b) - 12)) if b else ():
            win = b[k : k + 13]
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit |= set(range(i, i + len(win)))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [200_000, 3, 40])
def test_decontamination_equals_brute_force(spark, block):
    r = random.Random(5)
    v = ["Ab", "c", "dé", "e1", "f"]
    items = [(10, " ".join(r.choice(v) for _ in range(20))), (2, "c f, C"), (33, "solo"), (4, ""), (5, None), (6, "c f c"), (7, "--")]
    texts = [" ".join(r.choice(v) for _ in range(r.randint(0, 40))) for _ in range(40)] + ["x " + items[0][1].upper().replace("É", "é") + " y", "solo; SOLO", LONG + " solo"]
    rows = [(i, t) for i, t in enumerate(texts)] + [r[:2] for r in ODD]
    bench = spark.createDataFrame([*items, (None, "again and again")], "item_id long, text string")
    got = wumanber.scan(docs(spark, rows), bench, block_windows=block).collect()
    assert len(got) == len(rows)
    want = Counter()
    for i, t in rows:
        n, h, found = brute_hits(t, items)
        import hashlib

        want[i, n, h, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), h > 0 and 20 * h >= n] += 1
    assert Counter((g["doc_id"], g["n_words"], g["n_hit"], g["n_items"], g["items_sha256"], g["contaminated"]) for g in got) == want
    empty = wumanber.scan(docs(spark, rows), bench.limit(0)).agg(F.sum("n_hit")).first()[0]
    assert empty == 0 and wumanber.scan(docs(spark, []), bench).count() == 0


# --- 6


def test_class_model(spark):
    rows = [(i, t) for i, t, _ in sample(300)]
    s = brown.Settings(seed_words=20, moved=30, hot=60, endings=10, classes=8, chunk_bytes=2000)
    got = brown.score(docs(spark, [*rows, *(r[:2] for r in ODD)]), settings=s).collect()
    everything = [*rows, *(r[:2] for r in ODD)]
    assert len(got) == len(everything)
    split = lambda t: [*((t or "").encode().lower().split()), b" "]
    c = Counter(w for i, t in everything if i is None or zlib.crc32(str(i).encode()) % 5 != 1 for w in split(t))
    n, v = sum(c.values()), len(c)
    want = Counter((i, len(split(t)), sum(c[w] > 0 for w in split(t)), round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in split(t)), 6)) for i, t in everything)
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {n}
    held = [r for r in brown.score(docs(spark, rows), settings=brown.Settings(seed_words=100, hot=200, endings=100, classes=8)).collect() if r["held_out"]]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert brown.score(docs(spark, []), settings=s).count() == 0
    alone = brown.score(docs(spark, [(1, "a b")]).where("true"), settings=s).first()
    assert alone["n_tokens"] == 3


@pytest.mark.parametrize("hot", [4, 50, 1000])
def test_words_of_one_ending_are_told_by_their_neighbours(spark, hot):
    held = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 5 == 1][:20]
    rows = [(i, f"aa nn bb vv aa n{i % 40}ing bb v{i % 40}ing aa nn bb vv") for i in range(1000) if zlib.crc32(str(i).encode()) % 5 != 1]
    rows += [(i, f"aa n{j}ing bb v{j}ing" if j % 2 else f"aa v{j - 1}ing bb n{j - 1}ing") for j, i in enumerate(held, 1)]
    got = {r["doc_id"]: r["score"] for r in brown.score(docs(spark, rows), settings=brown.Settings(seed_words=4, moved=max(4, hot // 2), hot=hot, endings=1, classes=8)).collect()}
    assert all(got[a] > got[b] + 1 for a, b in zip(held[::2], held[1::2], strict=True))


def test_class_scores_equal_a_plain_version(spark):
    rows = [(i, t) for i, t, _ in sample(120)] + [(1000, None), (1001, ""), (1002, "unseen words only zzz")]
    settings = brown.Settings(seed_words=5000, moved=5000, hot=5000, endings=1, classes=6, rounds=0, chunk_bytes=3000)
    got = {r["doc_id"]: r["score"] for r in brown.score(docs(spark, rows, extra=False), settings=settings).collect()}
    split = {i: [*brown.tokens(t), brown.END] for i, t in rows}
    train = [w for i, w in split.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    c = Counter(x for w in train for x in w)
    order = [brown.END, *sorted((w for w in c if w != brown.END), key=lambda w: (-c[w], w))]
    number = {w: k for k, w in enumerate(order)}
    m = np.zeros((len(order) + 1,) * 2)  # the last symbol is that of all other words
    for w in train:
        for a, b in zip([brown.END, *w], w, strict=False):
            m[number[a], number[b]] += 1
    own = brown.exchange(m, 6)
    k = own.max() + 1
    g, n, v = np.zeros((k, k)), np.zeros(k), np.zeros(k)
    np.add.at(g, (own[:, None].repeat(len(own), 1), own[None].repeat(len(own), 0)), m)
    np.add.at(n, own[:-1], [c[w] for w in order])
    np.add.at(v, own[:-1], 1)
    share = (n + 0.5) / (n.sum() + 0.5 * k)

    def plain(w):
        total, before = 0.0, 0
        for x in w:
            cls = own[number.get(x, len(order))]
            total += math.log10((g[before, cls] + settings.prior * share[cls]) / (g[before].sum() + settings.prior))
            total += math.log10((c[x] + 0.5) / (n[cls] + 0.5 * (v[cls] + 1)))
            before = cls
        return total

    assert got == pytest.approx({i: plain(w) for i, w in split.items()})
    for before in range(k):  # what may follow a class adds up to 1, one unseen word in each class among it
        p = sum((g[before, x] + settings.prior * share[x]) / (g[before].sum() + settings.prior) * (sum(c[w] + 0.5 for w in order if own[number[w]] == x) + 0.5) / (n[x] + 0.5 * (v[x] + 1)) for x in range(k))
        assert p == pytest.approx(1)


@pytest.mark.parametrize("hot", [10, 50])
def test_rounds_and_rare_words_equal_a_plain_version(spark, hot):
    """Exchange rounds, words dealt by neighbours and endings, and words too long to go by themselves."""
    long = ["-" * 80, "x" * 70 + "ing", "x" * 71 + "ing"]
    r = random.Random(3)
    rows = [(i, " ".join([*t.split(), r.choice(long), *(["-" * 80] * (i % 3))])) for i, t, _ in sample(160, 7)] + [(1000, None), (1001, ""), (1002, "unseen words only zzz")]
    s = brown.Settings(seed_words=6, moved=hot // 2, hot=hot, endings=5, classes=6, rounds=2)
    got = {r["doc_id"]: r["score"] for r in brown.score(docs(spark, rows, extra=False).coalesce(1), settings=s).collect()}
    names = {i: [brown.name(w, s.name_bytes) for w in brown.tokens(t)] for i, t in rows}
    split = {i: [*w, brown.END] for i, w in names.items()}
    train = [w for i, w in split.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    c, every = Counter(x for w in train for x in w), Counter(x for w in split.values() for x in w if x != brown.END)
    listed = [w for w, _ in sorted(every.items(), key=lambda x: -x[1])][:hot]  # of one chunk
    units = brown.Units({w: k for k, w in enumerate([brown.END, *sorted((w for w in listed if c[w]), key=lambda w: (-c[w], w))])}, s.endings)
    assert brown.name(b"-" * 80, 64) in units.number and len(units.number) < len(c)
    unit = {w: int(units.of([w])[0]) for w in every | c}

    def pairs(own):
        return [(own[unit[a]], unit[b], b) for w in train for a, b in zip([brown.END, *w], w, strict=False)]

    def around(kinds, own, k):
        m = np.zeros((len(own), 2 * k))
        for w in train:
            u = [kinds[unit[x]] for x in w]
            for j, x in enumerate(u):
                m[x, own[u[j - 1]] if j else 0] += 1
                m[x, k + (own[u[j + 1]] if j + 1 < len(u) else 0)] += 1
        return m

    few, kinds = units.first(s.seed_words + 1), units.first(s.moved + 1)
    b = np.zeros((few.max() + 1,) * 2)
    for before, x, _ in pairs(few):
        b[before, few[x]] += 1
    seed = brown.exchange(b, s.classes)
    words_ = int(kinds.max()) + 1 - s.endings
    own = np.zeros(words_ + s.endings, np.int64)
    own[kinds] = seed[few]
    k, best = int(seed.max()) + 1, None
    for _ in range(s.rounds + 1):
        m = around(kinds, own, k)
        gain, _, fits = brown._fits(m, own, words_, s.prior)
        if best is not None and gain <= best[0] + 1e-4 * abs(best[0]):
            break
        best = gain, own
        seen = m[:, :k].sum(1) > 0
        seen[0] = False
        own = np.where(seen, fits.argmax(1), own)
    own = best[1][kinds]
    first, n_hot = own.copy(), len(units.number)
    m = around(np.arange(len(units)), own, k)
    _, pull, fits = brown._fits(m, own, n_hot, s.prior)
    typical = fits[n_hot:] / np.maximum(1, m[n_hot:, :k].sum(1))[:, None]
    for w, u in units.number.items():
        if u >= words_ and c[w]:
            first[u] = (fits[u] + s.ending_tokens * typical[brown.ending(w, s.endings)]).argmax()
    sums = {}
    for w in train:
        for j, x in enumerate(w):
            near = sums.setdefault(x, np.zeros(2 * k))
            near[first[unit[w[j - 1]]] if j else 0] += 1
            near[k + (first[unit[w[j + 1]]] if j + 1 < len(w) else 0)] += 1
    cls = {w: int(first[u]) if u < n_hot or not c[w] else int((sums[w] @ pull + s.ending_tokens * typical[brown.ending(w, s.endings)]).argmax()) for w, u in unit.items()}
    g, n, v = np.zeros((k, k)), np.zeros(k), np.zeros(k)
    for w in train:
        for a, x in zip([brown.END, *w], w, strict=False):
            g[cls[a], cls[x]] += 1
    for w in c:
        n[cls[w]] += c[w]
        v[cls[w]] += 1
    transition, emission = brown._probabilities(g, n, v, s.prior)
    want = {i: sum(math.log10(transition[cls[a], cls[x]]) + math.log10((c[x] + 0.5) / emission[cls[x]]) for a, x in zip([brown.END, *w], w, strict=False)) for i, w in split.items()}
    assert got == pytest.approx(want)


def test_exchange_finds_blocks():
    b = np.zeros((9, 9))
    b[0, 1:5] = 5
    b[1:5, 5:9], b[5:9, 1:5] = 10, 10
    own = brown.exchange(b, 3)
    assert own[0] == 0 and len(set(own[1:5])) == 1 and len(set(own[5:9])) == 1 and own[1] != own[5]


# --- 7


def test_packing(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    rows = [r[:2] for r in ODD] + [(i + 50, x) for i, x, _ in sample(200)] + [(900, "a  b\n c \t<|endoftext|>"), (901, " lead and trail "), (902, "a <|endoftext|> b"), (903, "end<|endoftext|>")]
    size = 64
    got = packing.pack(docs(spark, rows).repartition(3), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken"), size).collect()
    want = Counter()
    total = 0
    for i, x in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        total += len(ids)
        for k, (s, n) in enumerate(packing.pieces_of(len(ids), size)):
            want[i, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= size
    assert len(by) <= math.ceil(total / size) + 8  # few pieces, so the bound is not reached
    assert packing.pack(docs(spark, []), tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(2)
    h = np.bincount(rng.integers(1, 1025, 20_000), minlength=1025)
    found = packing.plan(h, 1024)
    used = np.zeros(1025, int)
    for lengths, k in found:
        assert sum(lengths) <= 1024
        for v in lengths:
            used[v] += k
    assert (used == h).all()
    assert sum(k for _, k in found) <= 1.01 * math.ceil((h * np.arange(1025)).sum() / 1024)


# --- 8


def test_licences(spark):
    mit = next(t for k, t in licences.KNOWN if k == "MIT")
    rows = [(1, mit), (2, "Copyright (c) 2020 Somebody\nAll rights reserved.\n" + mit.upper().replace("LICENSE", "Licence")), (3, mit + " more"), (4, "text\n  licensed under THE apache licence, version 2.0\nRELEASED under the MIT License!!"), *(r[:2] for r in ODD)]
    rows = [(i if i is None or j < 4 else i + 10, t) for j, (i, t) in enumerate(rows)]
    got = licences.scan(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["licence"] == by[2]["licence"] == "MIT" and by[3]["licence"] is None
    assert (by[4]["notices"], by[4]["n_notice_lines"]) == ("Apache-2.0,MIT", 2)
    assert by[11]["licence"] is None and by[11]["text_digest"] == by[12]["text_digest"]
    assert licences.scan(docs(spark, [])).count() == 0


def test_every_spelling_of_a_repeated_word_is_made_one(spark):
    rows = [(1, "licence licence terms"), (2, "license license terms"), (3, "sub licence copyright owner\ncopyright owners"), (4, "sublicense copyright holder copyright holders"), (5, "licences")]
    got = {r["doc_id"]: r["text_digest"] for r in licences.scan(docs(spark, rows)).collect()}
    assert got[1] == got[2] and got[3] == got[4] and got[5] != got[1]
    import duckdb

    c = duckdb.connect()
    c.execute("CREATE TABLE documents AS SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in rows) + ") d(doc_id, text)")
    assert {r[0]: r[1] for r in c.execute(licences.sql()).fetchall()} == got


def test_whole_texts_of_long_licences(spark):
    folder = Path("/usr/share/common-licenses")
    known = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    if not all((folder / f).exists() for f in known):
        pytest.skip("no licence texts on this box")
    texts = [((folder / f).read_text(), i) for f, i in known.items()]
    rows = [(k, t) for k, (t, _) in enumerate(texts)]
    rows += [(100, texts[0][0].upper().replace("\n", "\r\n")), (101, texts[0][0].split("END OF TERMS")[0]), (102, texts[1][0] + " more"), (103, texts[2][0][1000:])]
    by = {r["doc_id"]: r["licence"] for r in licences.scan(docs(spark, rows)).collect()}
    assert [by[k] for k in range(len(texts))] == [i for _, i in texts]
    assert [by[k] for k in (100, 101, 102, 103)] == ["Apache-2.0", "Apache-2.0", None, None]
    made = licences.digests_of(spark, tuple((i, x) for t, i in texts for x in licences.forms(t)))
    assert made.items() <= licences.full_texts().items()


# --- 9


def edited(r, w, n):
    w = list(w)
    for _ in range(n):
        w[r.randrange(len(w))] = f"z{r.randrange(10**6)}"
    return w


def brute_classes(rows, k=5, threshold=0.8):
    def sets(t):
        w = words(t)
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    ids = sorted({i for i, _ in rows if i is not None})
    text = dict((i, t) for i, t in rows if i is not None)
    s = {i: sets(text[i]) for i in ids}
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and text[a] and ((text[a] == text[b]) or (s[a] and len(s[a] & s[b]) >= threshold * len(s[a] | s[b]))):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("block", [1024, 16])
def test_near_duplicates_equal_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(probminhash.links, "__defaults__", (*probminhash.links.__defaults__[:-1], block))
    r = random.Random(4)
    base = [[f"w{r.randrange(500)}" for _ in range(120)] for _ in range(12)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    rows += [(100 + i, " ".join(edited(r, base[i % 12], i % 4))) for i in range(60)]
    rows += [(200 + i, " ".join(edited(r, base[0], 2))) for i in range(40)]
    rows += [(400, rows[3][1]), (401, rows[3][1].upper()), (402, "short text"), (403, "short text"), (404, "Short, text")]
    rows += [(500 + (i or 0), t) if i is not None else (None, t) for i, t, *_ in ODD]
    got = probminhash.classes(docs(spark, rows)).collect()
    want = brute_classes(rows)
    assert len(got) == len(rows)
    assert all(g["class_id"] == (want[g["doc_id"]] if g["doc_id"] is not None else None) for g in got)
    assert all(g["kept"] == (g["doc_id"] is None or g["doc_id"] == g["class_id"]) for g in got)
    left = probminhash.deduplicated(docs(spark, rows))
    assert left.columns == docs(spark, []).columns
    assert sorted(x["doc_id"] for x in left.where("doc_id is not null").collect()) == sorted(set(want.values()))
    assert probminhash.classes(docs(spark, [])).count() == 0


def test_lines_repeated_hundreds_of_times_link(spark):
    rows = []
    for i, (n, m, times) in enumerate([(200, 20, 200), (100, 12, 200), (200, 20, 1000)] * 6):
        own, line = [f"p{i}w{j}" for j in range(n)], [f"p{i}l{j}" for j in range(m)]
        rows += [(2 * i, " ".join(own + line * (times == 1000))), (2 * i + 1, " ".join(own + line * times))]
    want = brute_classes(rows)
    assert all(want[2 * i + 1] == 2 * i for i in range(18))
    assert {g["doc_id"]: g["class_id"] for g in probminhash.classes(docs(spark, rows)).collect()} == want


def test_candidates_by_counts_and_by_sets_find_all_similar_texts():
    """Bands of both sketches against all pairs: of counts alone most, of either all."""
    r = random.Random(6)
    texts = []
    for i in range(150):
        own = [f"p{i}w{j}" for j in range(r.randint(30, 200))]
        line = own[:12] * r.choice([0, 0, 1, 3])
        texts += [own + line, edited(r, own, r.randint(0, 2)) + line * r.choice([1, 1, 4])]
    texts = [" ".join(t) for t in texts]
    even, counted = probminhash._sketcher(5, 80)()(texts)
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (words(t) for t in texts)]
    band = lambda x: {(b, x[8 * b : 8 * b + 8]) for b in range(20)}
    by_count = [band(c or e) for e, c in zip(even, counted, strict=True)]
    either = [x | band(e) for e, x in zip(even, by_count, strict=True)]
    similar = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    recall = lambda of: sum(bool(of[i] & of[j]) for i, j in similar) / len(similar)
    assert len(similar) >= 100 and any(counted) and recall(by_count) >= 0.9 and recall(either) == 1


def test_registers_estimate_probability_jaccard():
    r = random.Random(9)
    a = [f"w{r.randrange(10**6)}".encode() for _ in range(400)]
    b = a[:300] + [f"v{i}".encode() for i in range(100)]
    text, h = probminhash.shingle_hashes([a, b], 1)
    won = probminhash.sketch(*probminhash.weighted(text, h), 2, 4096)
    assert abs((won[0] == won[1]).mean() - 300 / 500) < 0.04
    w = np.where(text == 0, 1.0, 1.0)
    w[(text == 1) & (np.arange(len(w)) >= 700)] = 3.0  # b's own elements weigh more
    share = 1 / np.array([[max(1, 1), 1, 3]])  # common, a's own, b's own
    exact = sum(1 / (300 + 100 * 1 + 100 * 3) for _ in range(300))
    won = probminhash.sketch(text, h, w, 2, 4096)
    assert share.shape == (1, 3) and abs((won[0] == won[1]).mean() - exact) < 0.04


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(30)] + [(r.randrange(100, 160), r.randrange(100, 160)) for _ in range(50)] + [(7, 7), (None, 3)]
    got = {x["id"]: x["component"] for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}

    def root(i):
        up.setdefault(i, i)
        return i if up[i] == i else root(up[i])

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    assert got == {i: root(i) for i in up}


# --- 10


def test_toxicity(spark):
    rows = sample(500)
    r = random.Random(2)
    stems = ["gronk", "vleri"]
    toxic = {}
    texts = []
    for i, t, _ in rows:
        w = t.split()
        toxic[i] = int(r.random() < 0.3)
        if toxic[i]:
            for _ in range(3):
                w.insert(r.randrange(len(w) + 1), r.choice(stems) + r.choice(["a", "en", "ish", "ado", "s"]))
        texts.append((i, " ".join(w)))
    labels = spark.createDataFrame([*toxic.items(), (10**6, None), (None, 1)], "doc_id long, toxic int")
    everything = [*texts, *((10**5 + (i or 0), t) if i else (None, t) for i, t, *_ in ODD)]
    got = toxicity.fit_score(docs(spark, everything), labels).collect()
    assert len(got) == len(everything) and all(0 <= g["score"] <= 1 and g["predicted"] == int(g["score"] >= 0.7) for g in got)
    held = [(g["predicted"], toxic[g["doc_id"]]) for g in got if g["held_out"] and g["doc_id"] in toxic]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert all(g["held_out"] == (zlib.crc32(str(g["doc_id"]).encode()) % 3 == 1) for g in got if g["doc_id"] is not None)
    none = toxicity.fit_score(docs(spark, everything[:5]), labels.limit(0)).collect()
    assert {g["predicted"] for g in none} == {0}
    assert toxicity.fit_score(docs(spark, []), labels).count() == 0


def test_toxicity_is_learned_from_whole_texts_and_defined_labels(spark):
    tail = {i: i % 2 for i in range(80)}
    rows = [(i, "plain words of no harm " * 450 + (" gronkado vleriish" if y else " calm end")) for i, y in tail.items()]
    labels = spark.createDataFrame([*tail.items(), *((i, 0) for i in tail), (None, 1), (3, None)], "doc_id long, toxic int")  # one toxic label is enough
    net = toxicity.fit(docs(spark, rows), labels)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs(spark, [(1, "so gronkado vleriish now"), (2, "plain words of no harm calm end"), (2, "plain words of no harm calm end")]), net).collect()}
    assert got == {1: 1, 2: 0}


def test_gradients_match_differences():
    rng = np.random.default_rng(3)
    p = {k: v.astype(float) for k, v in toxicity.fresh(4, 3, rng).items() if k != "table"}
    mask = rng.random((6, 5)) < 0.8
    mask[0] = True
    x = tuple(rng.normal(size=(6, 5, 9)) for _ in (0, 1))
    y, w = rng.integers(0, 2, 5).astype(float), np.ones(5)
    _, g, dx = toxicity.gradients(p, x, mask, y, w)

    def loss():
        logit = toxicity.forward(p, x, mask)[0]
        return (np.logaddexp(0, logit) - y * logit).mean()

    for k in ("U0", "U1", "A", "a", "o", "c"):
        i = tuple(rng.integers(0, n) for n in p[k].shape)
        old = p[k][i]
        p[k][i] = old + 1e-3
        up = loss()
        p[k][i] = old - 1e-3
        down = loss()
        p[k][i] = old
        assert g[k][i] == pytest.approx((up - down) / 2e-3, rel=0.05, abs=2e-4)
    old = x[1][2, 1, 4]
    x[1][2, 1, 4] = old + 1e-3
    up = loss()
    x[1][2, 1, 4] = old - 1e-3
    assert dx[1][2, 1, 4] == pytest.approx((up - loss()) / 2e-3, rel=0.05, abs=2e-4)


def test_scores_equal_a_plain_version(spark):
    rows = [*((i, t) for i, t, _ in sample(40)), (900, LONG[:9000]), (901, ""), (902, None)]
    p = toxicity.fresh(6, 4, np.random.default_rng(5))
    net = toxicity.Network(p, bias=0.3)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs(spark, rows), net).collect()}

    def vector(word):
        flat, _ = toxicity.cells([word])
        return p["table"][flat[0]] + p["table"][flat[1:]].mean(0)

    def gru(x, d):
        h, s, out = 4, np.zeros(4), []
        for v in x:
            g, u = v @ p[f"W{d}"] + p[f"b{d}"], s @ p[f"U{d}"]
            zz, r = (1 / (1 + np.exp(-(g + u)[i * h : (i + 1) * h])) for i in (0, 1))
            s = s + zz * (np.tanh(g[2 * h :] + r * u[2 * h :]) - s)
            out.append(s)
        return out

    def window(words):
        if not words:
            return None
        x = [vector(w) for w in words]
        both = [np.concatenate(s) for s in zip(gru(x, 0), gru(x[::-1], 1)[::-1], strict=True)]
        e = np.exp([np.tanh(b @ p["A"]) @ p["a"] for b in both])
        return float((e / e.sum()) @ np.array(both) @ p["o"] + p["c"][0])

    for i, text in rows:
        words = toxicity.tokens(text)
        found = [window(words[s : s + 32]) for s in toxicity.starts(len(words), 32, 24)]
        want = max(x for x in found) if words else float(p["c"][0])
        assert got[i] == pytest.approx(1 / (1 + math.exp(-want - 0.3)), abs=1e-5)


def test_long_runs_of_word_characters_are_read_whole():
    for n in (1, 40, 41, 70, 71, 1000):
        run = "".join(chr(0x4E00 + i) for i in range(n))
        pieces = toxicity.tokens(f"a {run} b")
        assert max(map(len, pieces)) <= 40 and set("".join(pieces)) == {"a", *run, "b"}
    score = toxicity.Scorer(toxicity.Network(toxicity.fresh(12, 8, np.random.default_rng(1))))
    for start in ("slug_" * 20, "中" * 500):
        assert len({float(x) for x in score([start + "gronk", start + "vleri"])}) == 2


def test_every_word_is_in_a_window():
    for n in range(200):
        seen = {i for s in toxicity.starts(n, 32, 24) for i in range(s, min(n, s + 32))}
        assert seen == set(range(n))
