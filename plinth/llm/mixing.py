"""Mixing sources to target weights by capped water-filling.

Sources in code point order (null last) weigh 1, 2, 3, 1, ... and share the
corpus's words. A source stops at MAX_EPOCHS times its own words; what it can't
take is dealt again among the others by weight until none is above. A source
then repeats all its documents as often as its target holds it whole. For what
is left it takes documents once more: in seeded order, passing over those longer
than the gap that is left, until one doesn't fit; PASSES times, each over what
the one before left; then, ROUNDS times, the document and the number of
repetitions that come nearest to the gap, if they come nearer than none. No
document is taken more than MAX_EPOCHS times.

The water level comes from one running total over the sources, by their size a
weight. A pass is a prefix in seeded order, found by a running total over
ranges, and a round one aggregate, so a source's documents never meet in one
task. All decisions follow from one row a source; that is what is joined back.

Defined cases: a null or empty text has size 0; documents without a source are
one source; rows with the same doc_id, source and size are one unit and share one
decision; ties in the seeded order go by doc_id, then size; an empty table gives
an empty result. A source whose documents are all longer than its gap ends as
near as one of them brings it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.llm.texts import WORD
from plinth.operators.ranking import running_total
from plinth.storage import broadcast_within, checkpoint, row_count

MAX_EPOCHS = 3
WEIGHTS = 3
PASSES, ROUNDS = 2, 2
SEED = "mix-1"
BROADCAST_SOURCES = 200_000


def _key(doc_id: str = "doc_id") -> Column:
    return F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))), 1, 16)


def n_words(text: str = "text") -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_level(sources: DataFrame) -> DataFrame:
    """Add ``target`` to sources of (source, source_size, cap, weight): the caps, and the level that shares out the rest of all sizes."""
    full, weights = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    order = [F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()]
    placed = running_total(sources, order, {"caps": "cap", "used": "weight", "place": F.lit(1)})
    placed = placed.withColumn("level", (F.lit(full) - F.col("caps")).cast("double") / (F.lit(weights) - F.col("used")))
    level = placed.where("cap >= level * weight").agg(F.min_by("level", "place")).first()[0]
    fair = F.lit(level).cast("double") * F.col("weight")
    return sources.withColumn("target", F.when(fair.isNull() | (F.col("cap") < fair), F.col("cap").cast("double")).otherwise(fair))


_ORDER = ["key", "doc_id", "size"]
_UNIT = "struct(d.key, d.doc_id, d.size)"


def _got(passes: int, rounds: int) -> str:
    """How often more than ``whole`` a document of alias d is taken, by its source's row of alias s, after so many passes and rounds."""
    took = "0L"
    for k in range(passes):
        took = f"({took} + CASE WHEN {took} = 0 AND d.size > 0 AND d.size <= s.gap{k} AND {_UNIT} <= s.last{k} THEN 1L ELSE 0L END)"
    return " + ".join([took, *(f"CASE WHEN {_UNIT} <=> s.pick{k} THEN s.more{k} ELSE 0L END" for k in range(rounds))])


def _beside(rows: DataFrame, shares: DataFrame, n: int) -> DataFrame:
    return rows.alias("d").join(broadcast_within(shares, n, BROADCAST_SOURCES).alias("s"), F.expr("d.source <=> s.source"))


def _with_columns(shares: DataFrame, found: DataFrame) -> DataFrame:
    """``shares`` with the columns of ``found`` (a row a source, for some sources) added."""
    more = [c for c in found.columns if c != "source"]
    return checkpoint(shares.alias("s").join(found.alias("t"), F.expr("s.source <=> t.source"), "left").select("s.*", *(f"t.{c}" for c in more)))


def _fill(units: DataFrame, shares: DataFrame, n: int) -> DataFrame:
    """Add to shares, for each pass, its gap and the last unit taken, and for each round the unit picked and how often."""
    gap = F.col("rest")
    for k in range(PASSES):
        shares = shares.withColumn(f"gap{k}", gap)
        fits = _beside(units, shares, n).where(f"d.size <= s.gap{k} AND ({_got(k, 0)}) = 0").select("d.*", f"s.gap{k}")
        fits = checkpoint(running_total(fits, [F.col("source").asc_nulls_last(), *_ORDER], {"before": "w"}))
        base = fits.groupBy("source").agg(F.min("before").alias("base"))
        taken = fits.alias("d").join(broadcast_within(base, n, BROADCAST_SOURCES).alias("b"), F.expr("d.source <=> b.source"))
        taken = taken.where(f"before - base + w <= gap{k}").groupBy("d.source").agg(F.max(F.struct(*_ORDER)).alias(f"last{k}"), F.sum("w").alias(f"used{k}"))
        shares, gap = _with_columns(shares, taken), F.col(f"gap{k}") - F.coalesce(f"used{k}", F.lit(0))
    for k in range(ROUNDS):
        shares = shares.withColumn("gap", gap)
        open_ = _beside(units, shares, n).withColumn("room", F.lit(MAX_EPOCHS) - F.col("s.whole") - F.expr(_got(PASSES, k))).where("room > 0")
        open_ = open_.withColumn("m", F.expr("greatest(1L, least(room, CAST(floor(s.gap / w) AS BIGINT)))")).withColumn("off", F.expr("abs(s.gap - m * w)"))
        best = open_.where("off < abs(s.gap)").groupBy("d.source").agg(F.min(F.struct("off", *(f"d.{c}" for c in _ORDER), "m", "w")).alias("best"))
        best = best.select("source", F.struct(*(f"best.{c}" for c in _ORDER)).alias(f"pick{k}"), F.col("best.m").alias(f"more{k}"), F.col("best.w").alias(f"w{k}"))
        shares, gap = _with_columns(shares, best), F.col("gap") - F.coalesce(F.col(f"more{k}") * F.col(f"w{k}"), F.lit(0))
    return shares


def plan(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(documents with doc_id, source, size, key; sources with target, whole repetitions and what tells who is taken once more; their number)."""
    sized = checkpoint(docs.select("doc_id", "source", n_words().alias("size"), _key().alias("key")))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = running_total(sources, [F.col("source").asc_nulls_last()], {"rank": F.lit(1)})
    sources = checkpoint(sources.select("source", "source_size", (F.col("rank") % WEIGHTS + 1).alias("weight"), (MAX_EPOCHS * F.col("source_size")).alias("cap")))
    shares = water_level(sources)
    shares = shares.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    shares = checkpoint(shares.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))
    n = row_count(shares)
    units = checkpoint(sized.where("size > 0").groupBy("source", *_ORDER).agg((F.count(F.lit(1)) * F.col("size")).alias("w")))
    return sized, _fill(units, shares, n), n


def _copies() -> Column:
    return F.col("s.whole") + F.expr(_got(PASSES, ROUNDS))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target (of the source), copies and taken (words) of every document."""
    sized, shares, n = plan(docs)
    out = _beside(sized, shares, n).select("d.doc_id", "d.source", "d.size", "s.source_size", "s.target", _copies().alias("copies"))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """Each document as many times as the mix takes it, with the columns it came with."""
    _, shares, n = plan(docs)
    rows = docs.select(F.struct("*").alias("__row"), "source", "doc_id", n_words().alias("size"), _key().alias("key"))
    out = _beside(rows, shares, n).withColumn("__copies", _copies()).where("__copies > 0")
    return out.select("__row", F.explode(F.expr("sequence(1L, __copies)"))).select("__row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


def _pass_sql(k: int) -> str:
    """A pass over the units of CTE q{k}."""
    fits = "got = 0 AND size <= gap"
    upto = f"sum(CASE WHEN {fits} THEN w END) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING)"
    return f"""
), h{k} AS (
  SELECT *, coalesce({fits} AND {upto} <= gap, FALSE) AS hit FROM q{k}
), q{k + 1} AS (
  SELECT * EXCLUDE (hit) REPLACE (gap - coalesce(sum(w) FILTER (hit) OVER (PARTITION BY source), 0) AS gap, got + CAST(hit AS BIGINT) AS got) FROM h{k}"""


def _round_sql(k: int) -> str:
    """A round over the units of CTE q{k}."""
    return f"""
), m{k} AS (
  SELECT *, greatest(1, least(room - got, CAST(floor(gap / w) AS BIGINT))) AS m FROM q{k}
), h{k} AS (
  SELECT *, room > got AND abs(gap - m * w) < abs(gap)
    AND row_number() OVER (PARTITION BY source ORDER BY room > got DESC, abs(gap - m * w), key, doc_id NULLS FIRST, size) = 1 AS hit FROM m{k}
), q{k + 1} AS (
  SELECT * EXCLUDE (m, hit) REPLACE (gap - coalesce(sum(m * w) FILTER (hit) OVER (PARTITION BY source), 0) AS gap, got + CASE WHEN hit THEN m ELSE 0 END AS got) FROM h{k}"""


_STEPS = "".join([*map(_pass_sql, range(PASSES)), *map(_round_sql, range(PASSES, PASSES + ROUNDS))])

ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size,
    substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 16) AS key FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {WEIGHTS} + 1 AS weight FROM d GROUP BY source
), o AS (
  SELECT *, {MAX_EPOCHS} * source_size AS cap, row_number() OVER f2 AS place, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
    coalesce(sum({MAX_EPOCHS} * source_size) OVER f, 0) AS c, coalesce(sum(weight) OVER f, 0) AS w
  FROM s WINDOW f AS (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    f2 AS (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST)
), l AS (
  SELECT arg_min(CAST(total - c AS DOUBLE) / (weights - w), place) AS level FROM o WHERE cap >= CAST(total - c AS DOUBLE) / (weights - w) * weight
), t AS (
  SELECT source, source_size, CASE WHEN level IS NULL OR cap < level * weight THEN CAST(cap AS DOUBLE) ELSE level * weight END AS target FROM o, l
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t
), u AS (
  SELECT source, doc_id, key, size, CAST(count(*) * size AS BIGINT) AS w FROM d WHERE size > 0 GROUP BY source, doc_id, key, size
), q0 AS (
  SELECT u.*, target - whole * source_size AS gap, {MAX_EPOCHS} - whole AS room, CAST(0 AS BIGINT) AS got FROM u JOIN r ON u.source IS NOT DISTINCT FROM r.source{_STEPS}
)
SELECT d.doc_id, d.size, source_size, target, CAST(d.size * (whole + coalesce(got, 0)) AS BIGINT) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
LEFT JOIN q{PASSES + ROUNDS} q ON d.source IS NOT DISTINCT FROM q.source AND d.doc_id IS NOT DISTINCT FROM q.doc_id AND d.size = q.size
"""
