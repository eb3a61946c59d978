"""Quality rules with a verdict on hosts.

Rules fail single documents. Failures are then summed by host (here the
document's ``source``), each host's failure rate is shrunk towards a beta prior
that the hosts themselves yield, and a host whose shrunk rate is surely too
high takes its remaining documents with it.

Everything is DataFrame expressions. A document's windows are compared within
its own row, so no text is exploded or shuffled; hosts meet as one row of
counts a task.

Defined cases: a null or empty text has no words and fails; documents without
a source form one host of their own; repeated rows are judged alike and each
counts; an empty table gives an empty result. Input columns other than those
named may have any name and are passed on by ``filter_documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.texts import WORD, spaces_sql
from plinth.storage import broadcast_within, checkpoint, row_count, staging_path

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A host goes if its failure rate is above this at Z posterior deviations below its mean.
MAX_HOST_RATE = 0.6
Z = 2.0
BROADCAST_HOSTS = 200_000

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

# Positions of the words in a window that occurs more than once: windows sorted by hash, equal neighbours, their words.
_REPEATED = """
CASE WHEN size(array_distinct(__h)) = size(__h) THEN 0L ELSE
  CAST(size(array_distinct(flatten(transform(array(sort_array(transform(__h, (h, i) -> struct(h, i)))), s ->
    flatten(transform(filter(s, (x, j) -> (j > 0 AND x.h = s[j - 1].h) OR (j + 1 < size(s) AND x.h = s[j + 1].h)),
      x -> array(x.i, x.i + 1, x.i + 2))))))) AS BIGINT) END
"""


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the five counts of COUNTS and ``base_failed``.

    ``n_repeat_words`` counts each word position once, however many repeated
    windows hold it. Windows are compared by their 64-bit hashes.
    """
    t = f"coalesce({text}, '')"
    word_line = "x -> x RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'"
    words = docs.withColumn("__w", F.regexp_extract_all(F.expr(t), F.lit(f"({WORD})")))
    hashed = words.select(
        *docs.columns,
        F.expr("size(__w)").cast("long").alias("n_words"),
        F.expr("CASE WHEN size(__w) < 3 THEN array() ELSE transform(sequence(0, size(__w) - 3), i -> xxhash64(__w[i], __w[i + 1], __w[i + 2])) END").cast("array<long>").alias("__h"),
    )
    lines = F.expr(f"filter(split({t}, '\\n'), {word_line})")
    out = hashed.withColumn("__l", lines).select(
        *docs.columns,
        "n_words",
        F.expr(f"char_length(translate({t}, {spaces_sql()}, ''))").cast("long").alias("word_chars"),
        F.expr(f"char_length({t}) - char_length(translate({t}, '#*$%&|<>', ''))").cast("long").alias("n_symbols"),
        F.expr("size(__l) - size(array_distinct(__l))").cast("long").alias("n_dup_lines"),
        F.expr(_REPEATED).alias("n_repeat_words"),
    )
    # Through a generator, so that no filter on the counts is pushed down into computing them again.
    out = out.select(*docs.columns, F.inline(F.array(F.struct(*COUNTS))))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def _prior(m: int, nn: int | None, ff: int | None, n2: int | None, fr: float | None) -> tuple[float, float]:
    """(mean, weight) of the beta prior from sums over hosts: hosts, n, f, n^2 and f^2/n."""
    if not nn:
        return 0.0, 1000.0
    p, room, spread = ff / nn, nn - n2 / nn - (m - 1), fr - ff * (ff / nn)
    rho = (spread - p * (1 - p) * (m - 1)) / (room * p * (1 - p)) if 0 < p < 1 and room > 0 else 0.0
    return p, 1000.0 if rho <= 0.001 else 1.0 if rho >= 0.5 else (1 - rho) / rho


def host_verdicts(judged: DataFrame, host: str = "source", failed: str = "base_failed") -> DataFrame:
    """One row a host: n, f (failures), rate (posterior mean), low (posterior bound), host_rejected.

    The beta prior has the hosts' pooled rate p as its mean; its weight k is
    the moment estimate from how much the hosts' rates differ beyond chance,
    held between 1 and 1000 (1000 where they don't).
    """
    hosts = judged.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(failed)).alias("f"))
    hosts = checkpoint(hosts)
    p, k = _prior(*hosts.agg(
        F.count(F.lit(1)), F.sum("n"), F.sum("f"), F.sum(F.col("n") * F.col("n")), F.sum(F.col("f") * F.col("f") / F.col("n")),
    ).first())
    out = hosts.withColumns({"k": F.lit(k), "rate": (F.col("f") + F.lit(k * p)) / (F.col("n") + F.lit(k))})
    out = out.withColumn("low", F.expr(f"rate - {Z}D * sqrt(rate * (1 - rate) / (n + k + 1))"))
    return out.withColumn("host_rejected", F.col("low") > F.lit(MAX_HOST_RATE))


def _with_verdicts(judged: DataFrame, hosts: DataFrame) -> DataFrame:
    hosts = checkpoint(hosts.select("host", "rate", "low", "host_rejected"))
    hosts = broadcast_within(hosts, row_count(hosts), BROADCAST_HOSTS).alias("h")
    joined = judged.alias("d").join(hosts, F.expr("d.source <=> h.host"), "left")
    return joined.select("d.*", (~F.col("d.base_failed") & ~F.coalesce(F.col("h.host_rejected"), F.lit(False))).alias("kept"), "h.rate", "h.low")


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, source, the counts, base_failed, kept, and the host's rate and low, of every document."""
    judged = checkpoint(counts(docs.select("doc_id", "text", "source")).drop("text"))
    return _with_verdicts(judged, host_verdicts(judged))


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with the columns they came with.

    Texts are read and counted once: the rows that pass the rules are staged, and
    for the others their source alone, from which the hosts are summed; the rows
    of rejected hosts then go as the staged rows are read. No text is shuffled.
    """
    spark = docs.sparkSession
    judged = counts(docs.select(F.struct("*").alias("__row"), "text", "source"))
    path = staging_path(spark, "quality")
    judged.select("source", "base_failed", F.when(~F.col("base_failed"), F.col("__row")).alias("__row")).write.parquet(path)
    staged = spark.read.parquet(path)
    return _with_verdicts(staged.where("NOT base_failed"), host_verdicts(staged.select("source", "base_failed"))).where("kept").select("__row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", *COUNTS, "base_failed", "kept", F.round("rate", 6).alias("rate"), F.round("low", 6).alias("low"))


ORACLE = rf"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws, row_number() OVER () AS rid FROM documents
), pos AS (
  SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3
), win AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i + 1], ws[i + 2]) AS c FROM pos
), rep AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM win WHERE c > 1) GROUP BY rid
), ln AS (
  SELECT rid, count(*) - count(DISTINCT l) AS n_dup_lines FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM w)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid
), c AS (
  SELECT doc_id, source, len(ws) AS n_words,
    CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    len(ws) < {MIN_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {MAX_REPEAT_PERCENT} * len(ws) AS base_failed
  FROM w LEFT JOIN rep USING (rid) LEFT JOIN ln USING (rid)
), h AS (
  SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (base_failed) AS DOUBLE) AS f FROM c GROUP BY source
), m AS (
  SELECT count(*) AS m, sum(n) AS nn, sum(f) AS ff, sum(n * n) AS n2, sum(f * f / n) AS fr FROM h
), r AS (
  SELECT ff / nn AS p, nn - n2 / nn - (m - 1) AS room, fr - ff * (ff / nn) AS spread, m FROM m
), k AS (
  SELECT p, CASE WHEN p > 0 AND p < 1 AND room > 0 THEN (spread - p * (1 - p) * (m - 1)) / (room * p * (1 - p)) ELSE 0 END AS rho FROM r
), pr AS (
  SELECT p, CASE WHEN rho <= 0.001 THEN 1000.0 WHEN rho >= 0.5 THEN 1.0 ELSE (1 - rho) / rho END AS k FROM k
), v AS (
  SELECT source, (f + k * p) / (n + k) AS rate, n + k + 1 AS s FROM h, pr
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (rate - {Z} * sqrt(rate * (1 - rate) / s) > {MAX_HOST_RATE}) AS kept,
  round(rate, 6) AS rate, round(rate - {Z} * sqrt(rate * (1 - rate) / s), 6) AS low
FROM c LEFT JOIN v ON c.source IS NOT DISTINCT FROM v.source
"""
