r"""Quality rules: word and repetition rules of each document, and line frequency across a host's documents.

One projection over the texts gives a narrow table of metrics and line hashes, which all later steps read. Line
frequency, by DataFrame operations alone:

1. Lines (``\n``-split, with a word) are normalised - A-Z lower-cased, digits to 0, white space runs to one
   space, trimmed - and hashed.
2. For each host (``source``) and line hash the distinct documents that hold the line are counted. Equal texts of
   a host are one document, so a widely copied document does not make its own lines look like boilerplate.
3. A line is above the limit where more than ``max(min_docs, share * distinct documents of the host)`` documents hold
   it. Such lines are removed from all of the host's documents.
4. A document that lost lines is depleted, and rejected, where less than half of its words or fewer than the base
   rules' words are left.

Nulls: a null text has no words and fails the base rules; a null host counts as the empty host; the doc_id decides
nothing. Empty texts hold no line. A text of any length is one row of work, sorted in memory. Counts have no ties to
break. Repeated rows are judged alike. An empty table gives an empty result. Other columns are passed by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.llm.storage import materialize

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
LINE_MIN_DOCS = 5
LINE_SHARE_PERCENT = 2
KEEP_PERCENT = 50

_SPACE = r"[ \t\n\x0B\f\r]+"
_A_Z, _a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, _SPACE), lambda w: w != "")


def normalised(line: Column) -> Column:
    folded = F.translate(line, _A_Z + "123456789", _a_z + "0" * 9)
    return F.trim(F.regexp_replace(folded, _SPACE, " "))


def base_metrics(text: DataFrame) -> DataFrame:
    """``text`` (with a column of that name) and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    n_repeat_words: window hashes are sorted with their positions, equal neighbours give the positions of repeated
    windows, and each position counts the words up to the next one, three at most.
    """
    body = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.trim(F.translate(x, "\t\x0b\f\r", "    ")) != "")
    df = text.withColumns({"_w": words_of(body), "_lines": lines})
    df = df.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.translate(body, " \t\n\x0b\f\r", "")).cast("long"),
        "n_symbols": (F.length(body) - F.length(F.translate(body, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_grams": F.sort_array(F.expr("transform(slice(_w, 1, greatest(size(_w) - 2, 0)), (x, i) -> struct(xxhash64(x, get(_w, i + 1), get(_w, i + 2)) AS h, i AS p))")),
    })
    df = df.withColumn("_p", F.sort_array(F.expr("transform(filter(_grams, (x, i) -> coalesce(get(_grams, i - 1).h = x.h, false) OR coalesce(get(_grams, i + 1).h = x.h, false)), x -> x.p)")))
    df = df.withColumn("n_repeat_words", F.expr("aggregate(transform(_p, (x, i) -> least(3, coalesce(get(_p, i + 1) - x, 3))), 0L, (a, x) -> a + x)"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return df.withColumn("base_failed", failed).drop("_w", "_lines", "_grams", "_p")


METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def _host() -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit(""))


def _content() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def described(docs: DataFrame) -> DataFrame:
    """doc_id, host, content hash, metrics and lines (hash, words) of every row of ``docs``: one read of the texts."""
    norms = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), normalised), lambda x: x != "")
    lines = F.transform(norms, lambda x: F.struct(F.xxhash64(x).alias("h"), F.size(F.split(x, " ")).alias("n")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "source")
    rows = base_metrics(rows).select("doc_id", _host().alias("host"), _content().alias("content"), *METRICS, lines.alias("lines"))
    return materialize(rows, "lines")


def removals(rows: DataFrame, min_docs: int = LINE_MIN_DOCS, share_percent: float = LINE_SHARE_PERCENT, keep_percent: float = KEEP_PERCENT) -> DataFrame:
    """For documents (host, content hash) of ``described`` rows with lines above the limit: the line hashes to remove,
    lines_removed, words_removed and depleted."""
    texts = rows.groupBy("host", "content").agg(F.first("n_words").alias("n_words"), F.first("lines").alias("lines"))
    limits = texts.groupBy("host").agg(F.greatest(F.lit(float(min_docs)), F.count("*") * share_percent / 100).alias("most"))
    held = texts.select("host", "content", "n_words", F.inline("lines")).groupBy("host", "content", "n_words", "h").agg(F.count("*").alias("times"), F.sum("n").alias("n"))
    frequent = held.groupBy("host", "h").agg(F.count("*").alias("docs")).join(limits, "host").where("docs > most").select("host", "h")
    found = held.join(frequent, ["host", "h"]).groupBy("host", "content", "n_words")
    found = found.agg(F.collect_set("h").alias("drop_lines"), F.sum("times").alias("lines_removed"), F.sum("n").alias("words_removed"))
    left = F.col("n_words") - F.col("words_removed")
    return found.withColumn("depleted", (100 * left < keep_percent * F.col("n_words")) | (left < MIN_WORDS)).drop("n_words")


def quality_verdicts(docs: DataFrame, **limits: float) -> DataFrame:
    """doc_id, the base metrics, lines_removed, words_removed, depleted and kept of every row of ``docs`` (doc_id, text, source)."""
    rows = described(docs)
    judged = rows.drop("lines").join(removals(rows, **limits).drop("drop_lines"), ["host", "content"], "left").drop("host", "content")
    judged = judged.withColumns({"lines_removed": F.coalesce("lines_removed", F.lit(0)), "words_removed": F.coalesce("words_removed", F.lit(0)), "depleted": F.coalesce("depleted", F.lit(False))})
    return judged.withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))


def clean_documents(docs: DataFrame, **limits: float) -> DataFrame:
    """The kept rows of ``docs``, all columns, lines above the limits taken out of ``text`` (and of ``n_chars``)."""
    columns = docs.columns
    rows = described(docs)
    lost = removals(rows, **limits).select("host", "content", "drop_lines", "depleted")
    gone = rows.where("base_failed").select("host", "content", F.lit(None).cast("array<long>").alias("drop_lines"), F.lit(True).alias("depleted")).distinct()
    verdicts = gone.unionByName(lost.join(gone, ["host", "content"], "left_anti"))
    verdicts = verdicts.select(F.col("host").alias("_host"), F.col("content").alias("_content"), F.col("drop_lines").alias("_drop"), F.col("depleted").alias("_gone"))
    others = F.struct(*[F.col(c) for c in columns if c != "text"]).alias("_row")  # their names cannot clash in there
    kept = docs.select(others, F.col("text").cast("string").alias("text"), _host().alias("_host"), _content().alias("_content"))
    kept = kept.join(verdicts, ["_host", "_content"], "left").where("NOT coalesce(_gone, false)")
    whole = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.coalesce(F.array_contains("_drop", F.xxhash64(normalised(x))), F.lit(False))), "\n")
    out = kept.withColumn("_text", F.when(F.col("_drop").isNull(), F.col("text")).otherwise(whole))
    made: dict[str, Column] = {"text": F.col("_text")}
    if "n_chars" in columns:
        made["n_chars"] = F.when(F.col("_drop").isNull(), F.col("_row")["n_chars"]).otherwise(F.length("_text").cast("long"))
    return out.select(*[made.get(c, F.col("_row")[c]).alias(c) for c in columns])


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, text FROM d),
g AS (SELECT doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM w WHERE len(w) > 2)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
l AS (SELECT doc_id, ln FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS ln FROM d) WHERE regexp_matches(ln, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT ln) AS n FROM l GROUP BY doc_id),
base AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
         FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)),
n AS (SELECT host, text, trim(regexp_replace(translate(ln, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '[\x20\x09-\x0D]+', ' ', 'g')) AS ln
      FROM (SELECT host, text, unnest(string_split(text, chr(10))) AS ln FROM (SELECT DISTINCT host, text FROM d))),
held AS (SELECT host, text, ln, count(*) AS times, sum(len(string_split(ln, ' '))) AS n FROM n WHERE ln <> '' GROUP BY host, text, ln),
most AS (SELECT host, greatest(5.0, count(DISTINCT text) * 2 / 100) AS most FROM d GROUP BY host),
freq AS (SELECT host, ln FROM held JOIN most USING (host) GROUP BY host, ln, most HAVING count(*) > most),
gone AS (SELECT host, text, sum(times) AS lines, sum(n) AS words FROM held JOIN freq USING (host, ln) GROUP BY host, text),
lost AS (SELECT doc_id, CAST(lines AS BIGINT) AS lines, CAST(words AS BIGINT) AS words FROM d JOIN gone USING (host, text)),
judged AS (SELECT base.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, coalesce(lines, 0) AS lines_removed, coalesce(words, 0) AS words_removed,
                  words IS NOT NULL AND (100 * (n_words - words) < 50 * n_words OR n_words - words < 50) AS depleted
           FROM base LEFT JOIN lost USING (doc_id))
SELECT *, NOT base_failed AND NOT depleted AS kept FROM judged
"""
