"""Licence scans: a trained paragraph classifier, confirmed against templates.

A paragraph is a line, or a block of lines without a blank one among them. Sparse
word n-grams (one to MOST_N words, each with at least one anchor) go into a
multinomial logistic regression over licence families, an unknown licence and no
licence. It is trained on the driver from the paragraphs in ``licence_texts``,
whole and in parts, from sentences that name licences, and from other text. Anchors are chosen by training: the
words that licence paragraphs hold much oftener than other text does. The
temperature is the one under which parts of paragraphs, left out of training, are
likeliest to be what the whole is. A prediction holds if its probability is at least MIN_PROBABILITY and the paragraph
overlaps a template of that family by at least MIN_OVERLAP of the smaller one's
n-grams; else its licence is unknown.

Scoring is DataFrame expressions: texts and lines without an anchor have no
feature, so they are no licence, and one pattern passes them over; the others'
n-grams meet the weights and the templates' n-grams (fixed tables of the model, a
few thousand rows) in broadcast joins, and are summed by paragraph. Sums over
n-grams combine before the shuffle.

``scan`` reports paragraphs that are confirmed, and as ``unknown`` those that are
a licence of some kind with probability MIN_ANY or more. A block of lines is
reported if none of its lines is.

Defined cases: null and empty texts have no paragraph of note; a paragraph is
scored whole, whatever its length; rows that share doc_id and text are one
document and reported once; ties between families go to the first by name; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm import licence_texts as texts
from plinth.llm.texts import spaces_sql
from plinth.storage import checkpoint

MOST_N = 3
MIN_PROBABILITY = 0.6
MIN_OVERLAP = 0.5
MIN_GRAMS = 3
L2 = 0.02
RATE, STEPS = 0.05, 250
KEEP = 1e-3
MIN_ANY = 0.8
#: An anchor stands in at least so many licence paragraphs, and so many times oftener there than in other text.
ANCHOR_PARAGRAPHS, ANCHOR_RATIO = 2, 1.5
UNKNOWN, NONE = "unknown", "none"
#: What each family is learned from and confirmed by: paragraphs, and sentences that name it.
NOTICES = {family: found + texts.NAMED[family] for family, found in texts.NOTICES.items()}

_WORDS = r"[a-z0-9À-ɏ](?:[a-z0-9À-ɏ.+-]*[a-z0-9À-ɏ])?"


def words(text: str) -> list[str]:
    return re.findall(_WORDS, text.lower())


@lru_cache(maxsize=1)
def anchors() -> tuple[str, ...]:
    """The words that tell licences from other text, by how many paragraphs of each hold them; common words, numbers and single letters don't count."""
    whole = [t for ts in texts.NOTICES.values() for t in ts]
    named = {w for names in texts.NAMES.values() for t in names for w in words(t)}
    licence = [set(words(t)) for t in [*whole, *texts.UNKNOWN_NOTICES]]
    other = [set(words(t)) for t in texts.OTHER_TEXTS]
    inside, outside = (Counter(w for ws in held for w in ws) for held in (licence, other))
    scale = len(licence) / len(other)
    titles = {w for t in whole if len(ws := words(t)) <= 3 for w in ws} | named
    for w in named:
        inside[w] += 1
    return tuple(sorted(
        w for w, n in inside.items()
        if len(w) > 1 and w not in texts.COMMON and (n >= ANCHOR_PARAGRAPHS or w in titles) and n >= ANCHOR_RATIO * scale * outside[w] and re.search("[a-z]{2}", w)
    ))


@lru_cache(maxsize=1)
def _anchor_set() -> frozenset[str]:
    return frozenset(anchors())


def grams(ws: list[str]) -> list[str]:
    """Distinct n-grams with an anchor."""
    held = _anchor_set()
    return sorted({" ".join(g) for n in range(1, MOST_N + 1) for g in zip(*(ws[k:] for k in range(n)), strict=False) if not held.isdisjoint(g)})


def _examples() -> list[tuple[str, int, list[str]]]:
    """(class, 0 for a whole paragraph or the number of a part, features): each paragraph whole, without its first and without its last third; and each anchor alone, as no licence."""
    out = [(NONE, 0, [w]) for w in anchors()]
    for name, notices in [*NOTICES.items(), (UNKNOWN, texts.UNKNOWN_NOTICES + texts.NAMED_UNKNOWN), (NONE, texts.OTHER_TEXTS)]:
        for text in notices:
            ws = words(text)
            third = len(ws) // 3
            for k, part in enumerate([ws] if len(ws) < 6 else [ws, ws[third:], ws[:-third]]):
                out.append((name, k, grams(part)))
    return out


class _Rows:
    """Examples as sparse rows of features; the last feature is the bias, which all have."""

    def __init__(self, examples, vocabulary: list[str]):
        at = {g: k for k, g in enumerate(vocabulary)}
        self.width = len(vocabulary) + 1
        self.rows = [np.array([*(at[g] for g in gs if g in at), len(vocabulary)]) for _, _, gs in examples]

    def scores(self, w: np.ndarray, which: np.ndarray) -> np.ndarray:
        return np.stack([w[self.rows[k]].sum(axis=0) for k in np.flatnonzero(which)])

    def train(self, which: np.ndarray, labels: np.ndarray, classes: list[str]) -> np.ndarray:
        """Weights by feature and class of a logistic regression on some rows, classes balanced, by Adam on the full batch."""
        rows, labels = [self.rows[k] for k in np.flatnonzero(which)], labels[which]
        columns, starts = np.concatenate(rows), np.cumsum([0, *map(len, rows)])[:-1]
        order = np.argsort(columns, kind="stable")
        of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])[order]
        used, firsts = np.unique(columns[order], return_index=True)
        y = np.eye(len(classes), dtype=np.float32)[labels]
        balance = np.clip(len(rows) / len(classes) / np.maximum(1, y.sum(axis=0)), 0.5, 4)[labels, None].astype(np.float32)
        w = np.zeros((self.width, len(classes)), np.float32)
        mean, square = np.zeros((len(used), len(classes)), np.float32), np.zeros((len(used), len(classes)), np.float32)
        for step in range(1, STEPS + 1):
            z = np.add.reduceat(w[columns], starts, axis=0)
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            slope = np.add.reduceat((balance * (p - y))[of], firsts, axis=0) + L2 * w[used]
            mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope * slope
            w[used] -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        return w.astype(np.float64)


def left_out(turns: int = 3) -> tuple[list[tuple[np.ndarray, int]], list[tuple[np.ndarray, int]], list[str]]:
    """(scores and true class of parts of paragraphs, by a fit on wholes; scores of the paragraphs of families left out, as unknown; classes)."""
    examples = _examples()
    classes = sorted({c for c, _, _ in examples})
    vocabulary = sorted({g for _, _, gs in examples for g in gs})
    rows = _Rows(examples, vocabulary)
    labels, parts = np.array([classes.index(c) for c, _, _ in examples]), np.array([k for _, k, _ in examples])

    def scored(held: np.ndarray, true: np.ndarray) -> list[tuple[np.ndarray, int]]:
        return list(zip(rows.scores(rows.train(~held, labels, classes), held), true[held].tolist(), strict=True))

    seen, strange = scored(parts > 0, labels), []
    families = sorted(NOTICES)
    for turn in range(turns):
        held = np.isin(labels, [classes.index(f) for f in families[turn::turns]])
        strange += scored(held, np.full(len(labels), classes.index(UNKNOWN)))
    return seen, strange, classes


def _temperature(seen: list[tuple[np.ndarray, int]]) -> float:
    """The temperature under which left-out parts are likeliest to be what they are."""
    z, at = np.stack([s for s, _ in seen]), np.array([k for _, k in seen])

    def loss(t: float) -> float:
        return float((np.logaddexp.reduce(z / t, axis=1) - z[np.arange(len(z)), at] / t).mean())

    return min(np.linspace(0.3, 3, 28).tolist(), key=loss)


@lru_cache(maxsize=1)
def fit() -> tuple[list[str], list[str], np.ndarray, float]:
    """(classes, features, weights with the bias last, temperature)."""
    seen, _, classes = left_out(0)
    temperature = _temperature(seen)
    examples = _examples()
    vocabulary = sorted({g for _, _, gs in examples for g in gs})
    w = _Rows(examples, vocabulary).train(np.ones(len(examples), bool), np.array([classes.index(c) for c, _, _ in examples]), classes)
    used = np.abs(w[:-1]).max(axis=1) >= KEEP
    return classes, [g for g, u in zip(vocabulary, used, strict=True) if u], np.concatenate([w[:-1][used], w[-1:]]), temperature


def _trie(ws: list[str]) -> str:
    """A pattern for any of the words, by shared prefixes."""
    tails: dict[str, list[str]] = {}
    for w in ws:
        if w:
            tails.setdefault(w[0], []).append(w[1:])
    body = "|".join(re.escape(c) + _trie(rest) for c, rest in sorted(tails.items()))
    return (f"(?:{body})" + ("?" if "" in ws else "")) if body else ""


def _tables(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(weights by gram, n-grams of templates, size of templates)."""
    classes, features, w, temperature = fit()
    weights = spark.createDataFrame([(g, (w[k] / temperature).tolist()) for k, g in enumerate(features)], "gram string, weights array<double>")
    notices = [(name, k, gs) for name, ts in NOTICES.items() for k, t in enumerate(ts) if (gs := grams(words(t)))]
    templates = spark.createDataFrame([(g, name, k, len(gs)) for name, k, gs in notices for g in gs], "gram string, family string, notice int, size int")
    return F.broadcast(weights), F.broadcast(templates), classes


def _units(docs: DataFrame, key: list[str]) -> DataFrame:
    """The paragraphs with an anchor: doc_id, th, pos (first line), n_lines and line (the text, its lines joined by spaces)."""
    pattern = rf"(?<![a-z0-9À-ɏ.+-]){_trie(list(anchors()))}(?![a-z0-9À-ɏ])"
    rows = docs.select("doc_id", "text").where(F.lower("text").rlike(pattern)).distinct()
    rows = rows.select("doc_id", F.xxhash64("text").alias("th"), F.split("text", "\n").alias("ls"))
    full = f"transform(ls, x -> length(translate(x, {spaces_sql()}, '')) > 0)"
    rows = rows.withColumn("full", F.expr(full))
    edge = "filter(sequence(0, size(ls) - 1), i -> full[i] AND NOT coalesce(try_element_at(full, {}), false))"
    first = "filter(sequence(0, size(ls) - 1), i -> full[i] AND (i = 0 OR NOT full[i - 1]))"
    rows = rows.withColumn("blocks", F.expr(f"filter(zip_with({first}, {edge.format('i + 2')}, (s, e) -> struct(s, e)), b -> b.e > b.s)"))
    single = F.expr("transform(ls, (x, i) -> struct(i AS pos, 1 AS n_lines, x AS line))")
    several = F.expr("transform(blocks, b -> struct(b.s AS pos, b.e - b.s + 1 AS n_lines, array_join(slice(ls, b.s + 1, b.e - b.s + 1), ' ') AS line))")
    rows = rows.select("doc_id", "th", F.inline(F.concat(single, several)))
    return rows.where(F.lower("line").rlike(pattern)).select(*key, "line")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, pos (line, from 0), n_lines, family, probability (of the family, or of any licence for unknown), overlap and the paragraph's text."""
    spark = docs.sparkSession
    weights, templates, classes = _tables(spark)
    _, _, w, temperature = fit()
    key = ["doc_id", "th", "pos", "n_lines"]
    same = "{0}.doc_id <=> {1}.doc_id AND {0}.th = {1}.th AND {0}.pos = {1}.pos AND {0}.n_lines = {1}.n_lines"
    ws = _units(docs, key).withColumn("ws", F.regexp_extract_all(F.lower("line"), F.lit(f"({_WORDS})")))
    held = "array(" + ", ".join(f"'{w}'" for w in anchors()) + ")"
    about = "transform(filter(sequence(greatest(1, p - n + 1), p), s -> s + n - 1 <= size(ws)), s -> array_join(slice(ws, s, n), ' '))"
    found = f"filter(sequence(1, size(ws)), i -> array_contains({held}, ws[i - 1]))"
    ngrams = f"array_distinct(flatten(transform({found}, p -> flatten(transform(sequence(1, {MOST_N}), n -> {about})))))"
    ws = checkpoint(ws.where("size(ws) > 0").select(*key, "line", F.expr(ngrams).alias("grams")))
    each = ws.select(*key, F.size("grams").alias("n"), F.explode("grams").alias("gram"))

    scored = each.join(weights, "gram").groupBy(*key).agg(*(F.sum(F.col("weights")[k]).alias(f"z{k}") for k in range(len(classes))))
    logits = F.array(*(F.col(f"z{k}") + F.lit(float(w[-1, k] / temperature)) for k in range(len(classes))))
    scored = scored.select(*key, logits.alias("z")).withColumn("top", F.array_max("z"))
    scored = scored.withColumn("share", F.expr("transform(z, x -> exp(x - top))")).withColumn("total", F.expr("aggregate(share, 0D, (a, x) -> a + x)"))
    names = F.array(*(F.lit(c) for c in classes))
    none = classes.index(NONE)
    scored = scored.select(*key, F.element_at(names, F.array_position("z", F.col("top")).cast("int")).alias("likely"), (1 / F.col("total")).alias("p"), (1 - F.col("share")[none] / F.col("total")).alias("p_any"))

    shared = each.join(templates, "gram").groupBy(*key, "family", "notice").agg(F.count(F.lit(1)).alias("both"), F.max("n").alias("n"), F.max("size").alias("size"))
    overlap = F.col("both") / F.least("n", "size")
    shared = shared.where(F.col("both") >= F.least(F.lit(MIN_GRAMS), "size")).groupBy(*key, "family").agg(F.max(overlap).alias("overlap"))

    joined = scored.alias("s").join(shared.alias("t"), F.expr(f"{same.format('s', 't')} AND s.likely = t.family"), "left")
    confirmed = ~F.col("likely").isin(UNKNOWN, NONE) & (F.col("p") >= MIN_PROBABILITY) & (F.coalesce("overlap", F.lit(0.0)) >= MIN_OVERLAP)
    out = joined.select(*(f"s.{c}" for c in key), F.when(confirmed, F.col("likely")).otherwise(UNKNOWN).alias("family"), F.when(confirmed, F.col("p")).otherwise(F.col("p_any")).alias("probability"), F.coalesce("overlap", F.lit(0.0)).alias("overlap"))
    out = checkpoint(out.where((F.col("family") != UNKNOWN) | (F.col("probability") >= MIN_ANY)))
    lines = out.where("n_lines = 1").select("doc_id", "th", "pos")
    inside = F.expr("b.doc_id <=> l.doc_id AND b.th = l.th AND l.pos >= b.pos AND l.pos < b.pos + b.n_lines")
    blocks = out.where("n_lines > 1").alias("b").join(lines.alias("l"), inside, "left_anti")
    told = out.where("n_lines = 1").unionByName(blocks).alias("o").join(ws.alias("w"), F.expr(same.format("o", "w")))
    return told.select("o.doc_id", "o.pos", "o.n_lines", "family", "probability", "overlap", "line")


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
