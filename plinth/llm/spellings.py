"""Spelling variants grouped without pairs.

Words are runs of Latin letters in whole texts; those of LONG code points or more
that occur LEAST times or more are kept with their number of occurrences n. Two
are near if one inserted, deleted or replaced code point makes one the other. No
pair of words is ever formed:

- Replacements. A word stands in one group for each of its places: the place, what
  is before it and what is after. The words of a group differ in that place alone,
  so a group's size gives each of them its near words there, and its two best words
  (largest n, then code-point order) give each its best one other than itself.
- Indels. Every distinct result of deleting one code point joins the vocabulary.
  Where it is a word, it is near to the longer word, and that one to it.

A word's counts and best words from all its groups combine by one aggregate. The
form is the best near word, if its n is FACTOR times the word's or more. Since n
grows so at every step, chains of forms are short, and pointers that double find
the roots in a number of joins that follows from the largest n.

Both use one shuffle by the word without the code point. A group holds at most a
word a letter (90), so none is hot; the hot words of texts combine before they are
shuffled.

As a fixed rule of the input, a run whose digest (``crc32`` of ``<doc_id>:<run>``)
is divisible by EVERY loses one code point first.

Defined cases: a null text has no words; a null doc_id counts as an empty one; rows
that repeat count each time; ties in n go to the word that is first in code-point
order; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.storage import checkpoint

LONG, LEAST = 7, 2
FACTOR = 10
EVERY = 31
#: A run of letters (the multiplication and division signs of the range included).
RUN = r"[A-Za-z\x{C0}-\x{FF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(docs: DataFrame) -> DataFrame:
    """word and n of every word of the documents that is long and frequent enough."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    run = runs.select("id", F.translate("run", UPPER, LOWER).alias("run")).where(F.length("run") >= LONG)
    digest = F.crc32(F.concat_ws(":", "id", "run"))
    at = (digest % F.length("run")).cast("int")
    word = F.when(digest % EVERY == 0, F.concat(F.expr("substring(run, 1, at)"), F.expr("substring(run, at + 2)"))).otherwise(F.col("run"))
    return run.withColumn("at", at).select(word.alias("word")).where(F.length("word") >= LONG).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST)


def _place(n: str = "n", word: str = "word") -> Column:
    """What orders near words: larger n first, then code-point order (which UTF-8's bytes keep)."""
    return F.struct((-F.col(n)).alias("by"), F.col(word).alias("word"))


def near_words(vocabulary: DataFrame) -> DataFrame:
    """word, n_near and best (struct of by, which is minus its n, and word) of every word of (word, n) that has near words."""
    places = vocabulary.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at"))
    without = F.concat(F.expr("substring(word, 1, at - 1)"), F.expr("substring(word, at + 1)"))
    #: Of a stretch of equal letters only the first gives a new result.
    new = (F.col("at") == 1) | (F.expr("substring(word, at - 1, 1)") != F.expr("substring(word, at, 1)"))
    cut = places.select("word", "n", "at", without.alias("key"), new.alias("new")).repartition("key")

    group = cut.groupBy("key", "at").agg(F.array_sort(F.collect_list(_place())).alias("all")).where(F.size("all") > 1)
    members = group.select(F.size("all").alias("size"), F.col("all")[0].alias("first"), F.col("all")[1].alias("second"), F.explode("all.word").alias("word"))
    replaced = members.select("word", (F.col("size") - 1).alias("near"), F.when(F.col("word") == F.col("first.word"), F.col("second")).otherwise(F.col("first")).alias("best"))

    shorter = vocabulary.select(F.col("word").alias("key"), F.col("n").alias("key_n"))
    indel = cut.where("new").join(shorter, "key")
    ends = indel.select(F.explode(F.array(F.struct("word", _place("key_n", "key").alias("best")), F.struct(F.col("key").alias("word"), _place().alias("best")))).alias("end"))
    indels = ends.select("end.word", F.lit(1).alias("near"), "end.best")
    return replaced.union(indels).groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(links: DataFrame, most: int) -> DataFrame:
    """word and root of links of (word, form, form_n) along which n grows FACTOR times a step, up to ``most``."""
    root = links.select("word", F.col("form").alias("root"))
    steps = math.log(max(1, most / LEAST), FACTOR)
    for _ in range(math.ceil(math.log2(max(1, steps + 1)))):
        onward = root.select(F.col("word").alias("root"), F.col("root").alias("on"))
        root = checkpoint(root.join(onward, "root", "left").select("word", F.coalesce("on", "root").alias("root")))
    return root


def variants(docs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word."""
    vocabulary = checkpoint(words(docs), most=F.max("n"))
    near = vocabulary.join(near_words(vocabulary), "word", "left")
    follows = -F.col("best.by") >= FACTOR * F.col("n")
    named = checkpoint(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(follows, F.col("best.word")).alias("form"), F.when(follows, -F.col("best.by")).alias("form_n")))
    root = roots(named.where("form IS NOT NULL"), vocabulary.measured["most"] or 0)
    return named.join(root, "word", "left").withColumn("root", F.coalesce("root", "word"))


def query(spark, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = rf"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda c: list_reduce([c, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS steps
), r AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '{RUN}')), '{UPPER}', '{LOWER}') AS run FROM documents
), l AS (
  SELECT id, run, count(*) AS times FROM r WHERE length(run) >= {LONG} GROUP BY id, run
), b AS (
  SELECT *, flatten(list_transform(string_split(id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, (unicode(c) - 64)::BIGINT] END)) AS bytes FROM l
), h AS (
  SELECT run, times, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda a, c: xor(a >> 8, crc.steps[xor(a, c) % 256 + 1])), 4294967295::BIGINT) AS h FROM b, crc
), c AS (
  SELECT times, CASE WHEN h % {EVERY} = 0 THEN left(run, (h % length(run))::INT) || substring(run, (h % length(run) + 2)::INT) ELSE run END AS word FROM h
), v AS (
  SELECT word, sum(times)::BIGINT AS n FROM c WHERE length(word) >= {LONG} GROUP BY word HAVING sum(times) >= {LEAST}
), p AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS place FROM v
), d AS (
  SELECT word, n, place, left(word, (place - 1)::INT) || substring(word, (place + 1)::INT) AS key FROM p
), i AS (
  SELECT DISTINCT d.word, d.n, v.word AS short, v.n AS short_n FROM d JOIN v ON d.key = v.word
), near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM d a JOIN d b ON a.key = b.key AND a.place = b.place AND a.word <> b.word
  UNION ALL SELECT word, n, short, short_n FROM i
  UNION ALL SELECT short, short_n, word, n FROM i
), g AS (
  SELECT word, count(*) AS n_near, max(other_n) AS best_n, arg_min(other, struct_pack(a := -other_n, b := encode(other))) AS best FROM near GROUP BY word
), f AS (
  SELECT v.word, v.n, coalesce(g.n_near, 0)::BIGINT AS n_near, CASE WHEN best_n >= {FACTOR} * n THEN best END AS form, CASE WHEN best_n >= {FACTOR} * n THEN best_n END AS form_n FROM v LEFT JOIN g ON v.word = g.word
), w AS (
  SELECT word, word AS root, 0 AS step FROM f UNION ALL SELECT w.word, f.form, step + 1 FROM w JOIN f ON w.root = f.word WHERE f.form IS NOT NULL
)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, (SELECT arg_max(w.root, w.step) FROM w WHERE w.word = f.word) AS root FROM f
"""
