r"""Line-first cleaning: rules on each line, lines that fail are removed, texts that lose too much are rejected.

Everything is a column expression over one row: texts stay where they are, nothing is shuffled and no Python runs on
them. Words are ``[^\x20\x09-\x0D]+``. A line that holds a word fails

* punctuation, if no word of it ends a sentence: none is followed by a full stop, an exclamation or a question mark, or an
  ellipsis (or their full-width, Arabic, Devanagari and Chinese forms), closing quotes and brackets aside;
* navigation, if it has three or more separators and symbols, and a quarter as many as words at least;
* boilerplate, if it is of 20 words or fewer and has one of a few fixed phrases of web pages (``PHRASES``).

What is counted of whole texts beside: symbols, repeated lines, and words in five-word windows that occur twice or more.
Windows are compared by 64-bit hashes, so that two different ones of a text of a million words are taken for equal with
a probability of 3e-8; only texts that have a repeated window sort them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The space characters, symbols, sentence ends and phrases that rules look for.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MARKS = SYMBOLS + "»«›‹•·→"
SENTENCE_END = r"""[.!?…。！？؟।]["'”’»)\]]*([\x20\x09-\x0D]|\z)"""
PHRASES = (
    "cookie", "privacy policy", "terms of use", "terms of service", "all rights reserved", "copyright ©", "copyright (c)", "click here",
    "read more", "sign in", "sign up", "log in", "subscribe", "javascript", "lorem ipsum", "powered by", "follow us", "share this",
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SHORT_LINE = 20
#: A text is rejected that loses more than this many hundredths of its word characters.
MOST_LOST = 30


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), value being computed once however often f (and lambdas in it) use it."""
    return F.transform(F.array(value), f)[0]


def count_of(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def word_chars(text: Column) -> Column:
    return F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long")


def line_fails(line: Column) -> Column:
    """Whether a line that holds a word fails a rule."""
    n = F.size(F.split(F.trim(F.translate(line, "\t\n\x0b\x0c\r", "     ")), " +"))
    lowered = F.translate(line, UPPER, LOWER)
    marks = count_of(line, MARKS)
    phrase = F.lit(False)
    for p in PHRASES:
        phrase = phrase | lowered.contains(p)
    return ~line.rlike(SENTENCE_END) | ((marks >= 3) & (4 * marks >= n)) | ((n <= SHORT_LINE) & phrase)


def repeated_words(words: Column, window: int = 5) -> Column:
    """How many words lie in windows of so many words that occur twice or more, the first occurrence included."""

    def hashes(h: Column) -> Column:
        at = F.when(F.size(h) >= window, F.sequence(F.lit(0), F.size(h) - window)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(window))))

    def again(s: Column) -> Column:
        same = lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"])
        return F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        each = F.transform(p, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - x, F.lit(window))))
        return F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)

    def total(w: Column) -> Column:
        ordered = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(let(let(ordered, again), covered))

    return let(let(F.transform(words, lambda x: F.xxhash64(x)), hashes), total)


def clean(docs: DataFrame, most_lost: int = MOST_LOST) -> DataFrame:
    """Adds cleaned (the lines that pass, joined by newlines) and the counts and verdicts of each text to all columns of docs.

    New columns: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_failed_lines, lost_chars (word characters
    of the lines removed), base_failed, kept and cleaned; columns of docs of these names are replaced. base_failed: fewer
    than 10 words, or over 20 in 100 of them repeated. kept: not base_failed, and no more than ``most_lost`` in 100 word
    characters lost. Lines without a word are neither rules' business nor removed. A null text has no words, so it is
    rejected like an empty one, and its cleaned text is null. Texts are read whole, of any length that a row may have;
    repeated rows, null ids and ids that repeat are judged row by row; there are no ties; no rows give none.
    """
    new = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_failed_lines", "lost_chars", "base_failed", "kept", "cleaned")
    text = F.col("text").cast("string")
    none = F.lit(0).cast("long")
    sized = lambda c: F.coalesce(F.when(text.isNotNull(), F.size(c)).cast("long"), none)
    counted = lambda c: F.coalesce(c, none)
    has_word = lambda x: x.rlike(WORD)
    lines = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), F.when(has_word(x), line_fails(x)).otherwise(F.lit(False)).alias("fails")))
    words = F.filter(F.split(text, SPACE), lambda x: x != "")
    got = docs.drop(*new).withColumns({"_words": words, "_lines": lines})
    spoken = F.filter(F.transform(F.col("_lines"), lambda x: x["line"]), has_word)
    lost = F.aggregate(F.filter("_lines", lambda x: x["fails"]), none, lambda a, x: a + word_chars(x["line"]))
    got = got.select(
        *docs.drop(*new).columns,
        sized(F.col("_words")).alias("n_words"),
        counted(word_chars(text)).alias("word_chars"),
        counted(count_of(text, SYMBOLS)).alias("n_symbols"),
        counted(F.when(text.isNotNull(), let(spoken, lambda s: F.size(s) - F.size(F.array_distinct(s)))).cast("long")).alias("n_dup_lines"),
        counted(repeated_words(F.col("_words"))).alias("n_repeat_words"),
        sized(F.filter("_lines", lambda x: x["fails"])).alias("n_failed_lines"),
        counted(lost).alias("lost_chars"),
        F.when(text.isNotNull(), F.array_join(F.transform(F.filter("_lines", lambda x: ~x["fails"]), lambda x: x["line"]), "\n")).alias("cleaned"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    got = got.withColumns({"base_failed": failed, "kept": ~failed & (100 * F.col("lost_chars") <= most_lost * F.col("word_chars"))})
    return got.select(*docs.drop(*new).columns, *new)


def sql() -> str:
    """DuckDB SQL of the query: a row for each word, window and line instead of arrays in a row."""
    phrases = " OR ".join(f"contains(low, '{p}')" for p in PHRASES)
    end = SENTENCE_END.replace("'", "''")
    spaces = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS MATERIALIZED (SELECT r, regexp_extract_all(text, '{WORD}') AS w FROM d),
win AS (SELECT r, i, array_to_string(list_slice(w, i, i + 4), ' ') AS t FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, t) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY r),
line AS (SELECT r, line FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{WORD}')),
judged AS (SELECT r, line, len(regexp_extract_all(line, '{WORD}')) AS n, translate(line, '{UPPER}', '{LOWER}') AS low, length(translate(line, {spaces}, '')) AS chars,
  length(line) - length(translate(line, '{MARKS}', '')) AS marks FROM line),
failed AS (SELECT r, line, chars, NOT regexp_matches(line, '{end}') OR (marks >= 3 AND 4 * marks >= n) OR (n <= {SHORT_LINE} AND ({phrases})) AS bad FROM judged),
l AS (SELECT r, count(*) - count(DISTINCT line) AS dup, count(*) FILTER (bad) AS n, coalesce(sum(chars) FILTER (bad), 0) AS lost FROM failed GROUP BY r),
base AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(translate(text, {spaces}, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(translate(text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols, CAST(coalesce(l.dup, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(l.n, 0) AS BIGINT) AS n_failed_lines, CAST(coalesce(l.lost, 0) AS BIGINT) AS lost_chars
  FROM d JOIN w USING (r) LEFT JOIN cov USING (r) LEFT JOIN l USING (r))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * lost_chars <= {MOST_LOST} * word_chars AS kept FROM base"""
