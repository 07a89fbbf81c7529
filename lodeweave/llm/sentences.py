"""Substring dedup by sliding sentence spans.

A text is cut into sentences (up to and including '.', '!', '?', their full-width forms or a line break, and the white space
after it). From every sentence on, a run is the fewest consecutive sentences that have `words` words together, so a run of
several short sentences and one of two long ones say equally much; a sentence of as many words is a run by itself. Runs are
hashed, in lower case and without the marks and white space between words. An ideograph, kana or Hangul character is a word.
Equal hashes are brought together over the whole corpus. The first occurrence, by (doc_id, place), stays;
every sentence that any later occurrence covers is removed, in whichever document it is, the same one included.

All of it is built-in expressions. Runs are written once to the shared folder, without their texts. The first of each hash is a
minimum, which map tasks combine, and what repeats is joined to it again, so a passage that a large share of
documents has is in no single task (adaptive execution splits such a join). A hash is 64 bits: two different runs
of a corpus of n runs share one with probability of about n**2 / 2**65.

Defined results: a null or empty text, or one of fewer than `words` words, is unchanged. Rows of
equal doc_id and text are one document and are treated alike; a null doc_id comes after all others.
Rows with the same doc_id but different texts are different documents. Other columns are left alone.
A repeat that holds no whole run (one that is cut out of the middle of one long sentence) stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import table, written

WORDS = 20
_END = ".!?。！？"
SENTENCE = rf"[^{_END}\n]*[{_END}\n]+[ \t\r\n\f]*|[^{_END}\n]+"
GAP = rf"[ \t\r\n\f{_END}]+"
SYMBOL = "([぀-ヿ㐀-鿿가-힣])"


def sentences(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))


def runs(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """id, version (hash of the text), runs (array of hash, place of the first sentence, last) of every text."""
    # the same sentences as those of `sentences`, without marks, in two passes with small character classes
    blank = F.regexp_replace(F.translate(F.regexp_replace(F.lower("text"), SYMBOL, " $1 "), _END, ".!?.!?"), r"[ \t\r\f]+", " ")
    plain = F.split(F.trim(blank), r" ?[.!?\n]+[ \n]*")
    rows = docs.filter("text is not null").select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("version"), plain.alias("s"))
    owner = F.flatten(F.transform("s", lambda s, i: F.array_repeat(i + 1, F.when(s == "", 0).otherwise(F.size(F.split(s, " "))))))
    rows = rows.withColumn("w", owner)  # the sentence that each word is in
    begins = F.filter(F.transform("w", lambda s, k: F.when((k == 0) | (F.get("w", k - 1) != s), F.struct(s.alias("place"), F.get("w", k + (words - 1)).alias("last")))), lambda r: r["last"].isNotNull())
    hashed = F.transform(begins, lambda r: F.struct(F.xxhash64(F.slice("s", r["place"], r["last"] - r["place"] + 1)).alias("hash"), r["place"].alias("place"), r["last"].alias("last")))
    return rows.select("id", "version", hashed.alias("runs"))


def repeated(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """id, version, place, last, first_id: every run that isn't the first of its kind."""
    each = written(runs(docs, words), "runs").select("id", "version", F.inline("runs"))
    at = F.struct(F.col("id").isNull().alias("none"), "id", "version", "place")
    first = each.groupBy("hash").agg(F.min(at).alias("first"), F.count("*").alias("n")).filter("n > 1").select("hash", "first")
    return each.join(first, "hash").filter(at != F.col("first")).select("id", "version", "place", "last", F.col("first.id").alias("first_id"))


def cleaned(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, text (what is left), n_removed (sentences), first_ids (documents that keep what was removed): a row for each changed document."""
    per = repeated(docs, words).groupBy("id", "version").agg(F.array_distinct(F.flatten(F.collect_set(F.sequence("place", "last")))).alias("gone"), F.sort_array(F.collect_set("first_id")).alias("first_ids"))
    named = docs.filter("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("v"))
    both = named.join(per, named["doc_id"].eqNullSafe(per["id"]) & (named["v"] == per["version"])).withColumn("s", sentences(F.col("text")))
    kept = F.transform(F.array_except(F.sequence(F.lit(1), F.size("s")), "gone"), lambda i: F.get("s", i - 1))
    return both.select("doc_id", F.array_join(kept, "").alias("text"), F.size("gone").alias("n_removed"), "first_ids")


def op8_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH s AS (SELECT doc_id, text, regexp_extract_all(text, '{SENTENCE}') AS u,
  list_transform(regexp_extract_all(regexp_replace(lower(text), '{SYMBOL}', ' \1 ', 'g'), '{SENTENCE}'), lambda x: trim(regexp_replace(x, '{GAP}', ' ', 'g'))) AS n FROM documents WHERE text IS NOT NULL),
o AS (SELECT doc_id, text, n, flatten(list_transform(range(1, len(n) + 1), lambda i: list_transform(range(CASE WHEN n[i] = '' THEN 0 ELSE len(string_split(n[i], ' ')) END), lambda j: i))) AS w FROM s),
k AS (SELECT doc_id, text, n, w, unnest(range(1, len(w) - {WORDS - 2})) AS k FROM o),
r AS (SELECT doc_id, text, w[k] AS place, w[k + {WORDS - 1}] AS last, array_to_string(n[w[k]:w[k + {WORDS - 1}]], chr(10)) AS run FROM k WHERE k = 1 OR w[k - 1] <> w[k]),
f AS (SELECT doc_id, text, place, last, rank() OVER v AS nth, first_value(doc_id) OVER v AS first_id FROM r WINDOW v AS (PARTITION BY run ORDER BY doc_id NULLS LAST, text, place)),
g AS (SELECT doc_id, text, list_distinct(flatten(list(range(place, last + 1)))) AS gone, list_sort(list_distinct(list(first_id))) AS first_ids FROM f WHERE nth > 1 GROUP BY doc_id, text)
SELECT s.doc_id, coalesce(array_to_string(list_filter(list_transform(range(1, len(u) + 1), lambda i: CASE WHEN list_contains(gone, i) THEN NULL ELSE u[i] END), lambda x: x IS NOT NULL), ''), '') AS text,
  len(gone)::INTEGER AS n_removed, first_ids
FROM s JOIN g ON s.doc_id IS NOT DISTINCT FROM g.doc_id AND s.text = g.text
"""
