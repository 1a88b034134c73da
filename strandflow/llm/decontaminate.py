"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

Each item gives windows of `window` consecutive words (one shorter window if it has fewer, none if it has none).
A window can only occur where its rarest word does, so its prefix is that one necessary word, rarity being the
word's count over the whole corpus. Document words join the prefixes; a length and a position bound drop places where the
window would leave the document; then the whole window is compared with the document at that place. The windows of
the benchmark are broadcast only while their estimated bytes, with those of the items that share them, are below BROADCAST_BYTES, else joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

WINDOW = 10
BROADCAST_BYTES = 32 << 20
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _small(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def lowered(word: Column) -> Column:
    """A-Z lower-cased and no other letter; only words with other letters take the slower translate."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def cut_words(text: Column) -> Column:
    """Words of a text as they are; upper-case A-Z is inside words, so it is excluded from the separators."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), "")


def item_windows(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """(item_id, words) of each window; words is an array of at most `window` words."""
    words = F.transform(cut_words(F.col(text)), lowered)
    w = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item_id"), words.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    return w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("words"))


def decontaminate(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, contaminated) of each document; items is the sorted array of item ids as strings.

    doc_id names one document: rows that share it, repeated or not, are judged together, and a row with a null id is hit by nothing. Null and empty
    texts have no words; an empty benchmark hits nothing; items without an id are one item whose id is the empty string. Other columns are not read."""
    docs = documents.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    pairs = item_windows(items, item_id, item_text, window)
    windows = staged(pairs.groupBy("words").agg(F.collect_set("item_id").alias("items")).withColumn("win", F.xxhash64("words")), "windows")
    count, size = windows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.array_join("words", " ")) + F.octet_length(F.array_join("items", " ")) + 24 * (F.size("words") + F.size("items"))), F.lit(0))).first()
    small = size < BROADCAST_BYTES
    vocabulary = windows.select(F.explode("words").alias("word")).distinct()
    every = docs.select("doc", F.posexplode(cut_words(F.col("text"))).alias("pos", "raw"))
    words = docs.select(F.explode(cut_words(F.col("text"))).alias("raw")).select(lowered(F.col("raw")).alias("word"))
    rarity = words.join(_small(vocabulary, small), "word").groupBy("word").agg(F.count("*").alias("n"))
    ranked = windows.select("words", "items", "win", F.posexplode("words").alias("at", "word")).join(_small(rarity, small), "word", "left")
    # a window with a word that the corpus lacks occurs nowhere
    prefix = ranked.groupBy("words", "items").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "at")).alias("p")).where("p.n > 0")
    prefix = staged(prefix.select(F.col("p.word").alias("word"), F.col("p.at").alias("at"), "words", "items"), "prefixes")
    placed = every.select("doc", "pos", lowered(F.col("raw")).alias("word")).join(_small(prefix.select("word", "at").distinct(), small), "word")
    # position bound on the left; the right bound needs the document's length and follows with the words
    places = placed.where("pos >= at").groupBy("doc").agg(F.collect_set(F.struct("pos", "at", "word")).alias("places"))
    at_hand = docs.join(places, "doc").select("doc", F.transform(cut_words(F.col("text")), lowered).alias("w"), "places")
    slots = at_hand.select("doc", F.explode(F.transform("places", lambda p: F.struct((p["pos"] - p["at"]).alias("start"), p["at"].alias("at"), p["word"].alias("word"), F.slice("w", p["pos"] - p["at"] + 1, window).alias("seen")))).alias("s")).select("doc", "s.*")
    wins = _small(prefix.select("word", "at", "words", "items"), small)
    hits = slots.join(wins, ["word", "at"]).where((F.size("words") <= F.size("seen")) & (F.slice("seen", 1, F.size("words")) == F.col("words")))
    per_doc = hits.groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.size("words")).alias("stop")))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    # spans sorted by start: each adds what lies beyond the furthest stop so far
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("stop"), F.lit(0).alias("n")), lambda a, s: F.struct(F.greatest(a["stop"], s["stop"]).alias("stop"), (a["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(a["stop"], s["start"]))).alias("n")), lambda a: a["n"])
    found = per_doc.select("doc", covered.cast("long").alias("n_hit"), "items")
    counted = docs.select("doc", F.size(cut_words(F.col("text"))).cast("long").alias("n_words"))
    out = counted.join(found, "doc", "left")
    hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(F.col("doc").alias(doc_id), "n_words", hit.alias("n_hit"), F.size(items_of).cast("long").alias("n_items"), items_of.alias("items"), (hit > 0).alias("contaminated"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return d.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def _sql_words(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_sql_words("text")} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, {_sql_words("text")} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, w[i:i + {WINDOW - 1}] AS words FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 2}, 2))) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(words) AS n FROM iw),
dw AS (SELECT doc_id, i, n, w[i:i + n - 1] AS words FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) JOIN lens ON i + n - 1 <= len(w)),
h AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN iw USING (words)),
c AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
s AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM h GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)
"""
