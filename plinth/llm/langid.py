"""Language identification by error-correcting output codes.

Each language gets a codeword of bits. For each bit a binary classifier over
hashed byte trigrams predicts the bit: multinomial log-odds between the languages
that have it set and those that don't, its margin calibrated by a logistic fit on
documents it wasn't counted from. Decoding adds up, for each codeword, the
logistic losses of all bits' margins, weighted by how well a bit did in
calibration, and takes the least. The score is the share of the chosen codeword
in exp(-loss); a prediction whose two least losses are close is flagged.

The classifiers are fitted on at most SAMPLE documents of each language, those
of the smallest hashes of doc_id, half for counts and half for calibration; every
document is predicted from its whole text. Codewords: all distinct splits of the
languages in two while these are at most EXHAUSTIVE; else MANY_BITS splits for
each doubling of their number, drawn by a fixed seed.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so
are all if nothing is labelled; with one language all others are that language
with score 1; rows that repeat are predicted alike (and may be learned from
twice); rows without a doc_id are predicted but never learned from, and their
held_out is false; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plinth.storage import broadcast_within, checkpoint, row_count

SAMPLE = 2000
SPARE = 2
RANGE = 1 << 40
BUCKET_BITS = 14
EXHAUSTIVE = 6
MANY_BITS = 8
SMOOTH = 0.5
CLOSE = 1.0
CHUNK = 1 << 20
BROADCAST_IDS = 200_000

_LETTER = regex.compile(r"\p{L}")
_FOLD = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def _bytes(text: str) -> np.ndarray:
    """A text's bytes, lower-cased, with signs and digits as spaces, between two spaces."""
    return np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass").translate(_FOLD) + b" ", np.uint8)


def _grams(a: np.ndarray) -> np.ndarray:
    """Buckets of the trigrams of bytes."""
    a = a.astype(np.uint32)
    return ((a[:-2] | a[1:-1] << np.uint32(8) | a[2:] << np.uint32(16)) * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)


def _codes(text: str):
    """The buckets of all trigrams of a text, in stretches that bound memory."""
    a = _bytes(text)
    for at in range(0, len(a) - 2, CHUNK):
        yield _grams(a[at : at + CHUNK + 2])


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def codewords(n: int) -> np.ndarray:
    """One codeword of -1 and 1 for each of n languages."""
    if n <= EXHAUSTIVE:
        splits = range(1, 1 << (n - 1)) if n > 1 else []
        return np.array([[1 if k and s >> (k - 1) & 1 else -1 for s in splits] for k in range(n)], np.float64).reshape(n, len(splits))
    bits = MANY_BITS * int(np.ceil(np.log2(n)))
    rng = np.random.default_rng(17)
    best = max((rng.permuted(np.tile(np.arange(n)[:, None] % 2 * 2 - 1, bits), axis=0) for _ in range(50)), key=lambda c: min((c[i] != c[j]).sum() for i in range(n) for j in range(i)))
    return best.astype(np.float64)


class Model:
    """Codewords, weights by bucket and bit, calibration by bit and loss weights."""

    def __init__(self, langs, code, weights, scale, loss):
        self.langs, self.code, self.weights, self.scale, self.loss = langs, code, weights, scale, loss

    def evidence(self, text: str) -> np.ndarray:
        """Mean weight of a text's trigrams by bit, times the root of their number's logarithm."""
        total, n = np.zeros(self.code.shape[1]), 0
        for codes in _codes(text):
            total += self.weights[codes].sum(axis=0, dtype=np.float64)
            n += len(codes)
        return total / max(n, 1) * np.sqrt(np.log1p(n))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, whether it is ambiguous)."""
        if not self.langs or not has_letter(text):
            return "und", 0.0, True
        if len(self.langs) == 1:
            return self.langs[0], 1.0, False
        margins = self.scale[0] * self.evidence(text) + self.scale[1]
        losses = (np.logaddexp(0, -self.code * margins) * self.loss).sum(axis=1)
        order = np.argsort(losses, kind="stable")
        share = 1 / np.exp(losses[order[0]] - losses).sum()
        return self.langs[order[0]], float(min(1.0, share)), bool(losses[order[1]] - losses[order[0]] < CLOSE)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and offset of a one-dimensional logistic fit (y in 0, 1), by damped Newton steps."""
    w = np.array([1.0, 0.0])
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (p - y) + 1e-2 * w
        hess = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w - step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
    return float(w[0]), float(w[1])


def _sample(docs: DataFrame) -> DataFrame:
    """At most SAMPLE learnable documents a language: text, lang and half (0: counts, 1: calibration).

    A bound on the hash, set by a language's number of documents to let about
    SPARE times SAMPLE of them through, goes before the exact choice, so that few
    rows meet in one task however large the table.
    """
    ids = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL AND crc32(cast(doc_id AS string)) % 4 <> 2")
    ids = ids.select("doc_id", "lang", F.pmod(F.xxhash64("doc_id"), F.lit(RANGE)).alias("h"))
    sizes = checkpoint(ids.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    n = row_count(sizes)
    ids = ids.join(broadcast_within(sizes, n, BROADCAST_IDS), "lang").where(F.col("h") < F.lit(float(RANGE) * SPARE * SAMPLE) / F.col("n"))
    place = Window.partitionBy("lang").orderBy("h", "doc_id")
    ids = ids.withColumn("place", F.row_number().over(place)).where(F.col("place") <= SAMPLE)
    ids = ids.groupBy("doc_id", "lang").agg(F.min("place").alias("place"))
    found = docs.select("doc_id", "lang", "text").join(broadcast_within(ids, n * SAMPLE, BROADCAST_IDS), ["doc_id", "lang"])
    return found.select("lang", (F.col("place") % 2).cast("int").alias("half"), "text")


def _counts(batches):
    sums: dict[str, np.ndarray] = {}
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
            own = sums.setdefault(lang, np.zeros(1 << BUCKET_BITS, np.int64))
            for codes in _codes(text.as_py()):
                own += np.bincount(codes, minlength=len(own))
    for lang, own in sums.items():
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(own[at])], ["lang", "bucket", "n"])


def fit(docs: DataFrame) -> Model:
    """Fit on the learnable documents of ``docs`` (doc_id, text, lang)."""
    sample = _sample(docs)
    counted = sample.where("half = 1").select("lang", "text").mapInArrow(_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counted["lang"].unique().tolist())
    code = codewords(len(langs))
    size = 1 << BUCKET_BITS
    if len(langs) < 2:
        return Model(langs, code, np.zeros((size, 0), np.float32), np.ones((2, 0)), np.ones(0))
    of = np.zeros((len(langs), size))
    of[counted["lang"].map(langs.index), counted["bucket"]] = counted["n"]
    of = of / np.maximum(1, of.sum(axis=1, keepdims=True))  # a language weighs the same, however much of it there is
    smooth = SMOOTH / size
    weights = np.stack([np.log(of[c > 0].mean(axis=0) + smooth) - np.log(of[c < 0].mean(axis=0) + smooth) for c in code.T], axis=1).astype(np.float32)
    model = Model(langs, code, weights, None, None)

    def evidence(batches):
        for b in batches:
            found = [model.evidence(x.as_py()).tolist() for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(found, pa.list_(pa.float64()))], ["lang", "evidence"])

    held = sample.where("half = 0").select("lang", "text").mapInArrow(evidence, "lang string, evidence array<double>").toPandas()
    held = held[held["lang"].isin(langs)].sort_values("lang", kind="stable")
    bits = code.shape[1]
    scale, loss = np.array([[5.0] * bits, [0.0] * bits]), np.ones(bits)
    if len(held):
        x, y = np.stack(held["evidence"].to_list()), code[held["lang"].map(langs.index)]
        for k in range(bits):
            scale[:, k] = _logistic(x[:, k], (y[:, k] > 0).astype(float))
        wrong = ((scale[0] * x + scale[1]) * y <= 0).mean(axis=0)
        loss = 0.5 * np.log((1 - wrong + 0.01) / (wrong + 0.01))
        loss = np.maximum(loss, 0.05) * bits / np.maximum(loss, 0.05).sum()
    return Model(langs, code, weights, scale, loss)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous of every row, from its text alone."""

    def run(batches):
        for b in batches:
            found = [model.predict(x.as_py()) for x in b.column("text")]
            cols = list(zip(*found, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.bool_())], ["doc_id", "lang_pred", "score", "ambiguous"])

    rows = docs.select("doc_id", "text")
    out = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, ambiguous boolean")
    held = F.coalesce(F.expr("crc32(cast(doc_id AS string)) % 4 = 2"), F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, fit(docs))
