"""Removal of lines that spread over many sites.

A line's spread is the number of distinct sites (here: sources) it stands on.
Sketches of the sites are built for each line hash where the rows lie and
merged by aggregation. Where a sketch's estimate can't decide against MIN_SITES
for its error, the exact number of distinct sites is counted. Lines with a word,
however short, that spread over MIN_SITES sites or more are boilerplate: their
first occurrence (smallest doc_id, then position) stays, the others are cut from
their documents.

Lines are known by two hashes of 96 bits together. Sketches and minima combine
before the shuffle, so a line that is everywhere costs a row a task. Texts are
dealt once, by document, to meet the positions to cut.

Defined cases: a null text stays null and has no lines; an empty text has one,
empty, line; white space around a line doesn't count for its identity; rows
without a source share one site; rows that share doc_id and text are one
document and cut alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.texts import spaces_sql
from plinth.storage import broadcast_within, checkpoint, row_count

MIN_SITES = 6
LG_K = 12
#: Four standard errors of a sketch of 2^LG_K registers; at least one site.
BAND = 4 * 1.04 / (2**LG_K) ** 0.5
LOW, HIGH = MIN_SITES - max(1.0, BAND * MIN_SITES), MIN_SITES + max(1.0, BAND * MIN_SITES)
BROADCAST_LINES = 200_000


#: What a line with a word matches.
_WORD = r"[^\x20\x09-\x0D]"
_ROW = "xxhash64(text)"


def _lines(docs: DataFrame) -> DataFrame:
    """Lines with a word: doc_id, th (of the text), site, pos, h1, h2."""
    rows = docs.select("doc_id", "source", F.expr(f"{_ROW} AS th"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    rows = rows.withColumn("line", F.expr(f"trim(BOTH {spaces_sql()} FROM line)")).where(F.col("line").rlike(_WORD))
    site = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    return rows.select("doc_id", "th", site.alias("site"), "pos", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"))


def boilerplate(docs: DataFrame) -> DataFrame:
    """The lines to cut: h1, h2 and first (doc_id, pos, th)."""
    lines = _lines(docs)
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"), F.min(F.struct(F.col("doc_id"), F.col("pos"), F.col("th"))).alias("first"))
    spread = spread.select("h1", "h2", "first", F.hll_sketch_estimate("sketch").cast("double").alias("sites")).where(F.col("sites") >= LOW)
    spread = checkpoint(spread)
    n = row_count(spread)
    near = spread.where(F.col("sites") <= HIGH).select("h1", "h2")
    exact = lines.join(broadcast_within(near, n, BROADCAST_LINES), ["h1", "h2"], "left_semi").select("h1", "h2", "site").distinct()
    exact = exact.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_SITES).select("h1", "h2")
    sure = spread.where(F.col("sites") > HIGH)
    return checkpoint(sure.unionByName(spread.join(exact, ["h1", "h2"], "left_semi")).select("h1", "h2", "first"))


def _cuts(docs: DataFrame) -> DataFrame:
    """Positions to cut: doc_id, th, cut (array of positions)."""
    found = boilerplate(docs)
    hit = _lines(docs).join(broadcast_within(found, row_count(found), BROADCAST_LINES), ["h1", "h2"])
    return hit.where("NOT (struct(doc_id, pos, th) <=> first)").groupBy("doc_id", "th").agg(F.collect_set("pos").alias("cut"))


def _dedup(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.struct(*(F.col(c) for c in docs.columns if c != "text")).alias("__row"), "doc_id", "text", F.expr(f"{_ROW} AS th"))
    cuts = _cuts(docs).hint("shuffle_hash")
    joined = rows.alias("d").join(cuts.alias("c"), F.expr("d.doc_id <=> c.doc_id AND d.th = c.th"), "left")
    keep = "array_join(transform(array_except(sequence(0, size(__lines) - 1), cut), i -> __lines[i]), '\n')"
    out = joined.select("__row", "d.text", "c.cut", F.when(F.col("c.cut").isNotNull(), F.split("d.text", "\n")).alias("__lines"))
    return out.select(
        "__row",
        F.coalesce(F.size("cut"), F.lit(0)).cast("long").alias("__removed"),
        F.when(F.col("cut").isNull(), F.col("text")).otherwise(F.expr(keep)).alias("__text"),
        F.expr("CASE WHEN text IS NULL THEN 0L ELSE char_length(text) - char_length(replace(text, '\n', '')) + 1L END").alias("__n"),
    )


def dedup_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with the same columns and its lines cut."""
    out = _dedup(docs)
    return out.select(*(F.col("__text").alias("text") if c == "text" else F.col("__row").getField(c).alias(c) for c in docs.columns))


def line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, text without the lines that are cut, n_lines (before), n_removed."""
    out = _dedup(docs.select("doc_id", "text", "source"))
    return out.select(F.col("__row.doc_id").alias("doc_id"), F.col("__text").alias("text"), F.col("__n").alias("n_lines"), F.col("__removed").alias("n_removed"))


def query(spark, sf_dir: str) -> DataFrame:
    return line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = rf"""
WITH l AS (
  SELECT doc_id, source, md5(text) AS th, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents
), k AS (
  SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l
), e AS (
  SELECT * FROM k WHERE regexp_matches(key, '{_WORD}')
), b AS (
  SELECT key, min((doc_id, pos)) AS first FROM e GROUP BY key HAVING count(DISTINCT coalesce('s' || source, 'n')) >= {MIN_SITES}
), m AS (
  SELECT k.doc_id, k.th, k.pos, k.line, b.key IS NOT NULL AND (k.doc_id, k.pos) <> b.first AS cut FROM k LEFT JOIN b ON k.key = b.key
), g AS (
  SELECT doc_id, th, count(*) AS n_lines, count(*) FILTER (cut) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT cut), '') AS text FROM m GROUP BY doc_id, th
)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN g.text END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id AND md5(d.text) = g.th
"""
