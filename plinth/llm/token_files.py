"""Token ids as binary output.

Format: a folder of Parquet files in ascending order of doc_id and text_hash,
with columns doc_id, text_hash (XXH64 of the text, null: of the empty text),
n_tokens and tokens (list of 32-bit ids, the end id included). Tokens are
dictionary-encoded, numbers delta-encoded; row groups and pages have a set size
and page indexes, so a reader takes single documents, or doc_id and n_tokens
alone, without reading the rest.

Ids are those of the tokenizers library; equal pieces of text (see ``pieces``)
are given to it once per worker while they stay in the cache. For a tokenizer
file that cuts texts otherwise than ``pieces`` does, whole texts are given to it.

Defined cases: null and empty texts hold the end id only; whole texts are
encoded whatever their length; rows without a doc_id come first; rows that share
a doc_id stand in order of their texts' hashes, and rows that repeat are dealt
over files like any other; an empty table gives an empty folder that reads as an
empty result.
"""

from __future__ import annotations

import json
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm.bpe import default_path
from plinth.llm.pieces import PieceIds, byte_level, cuts_like, is_plain, pieces
from plinth.operators.ranking import running_total
from plinth.storage import checkpoint, staging_path

END = 2
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 128 << 10
PAGE_ROWS = 500
ROWS = 500
_WRITE = {
    "compression": "zstd",
    "parquet.compression.codec.zstd.level": "1",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(ROW_GROUP_BYTES),
    "parquet.page.size": str(PAGE_BYTES),
    "parquet.page.row.count.limit": str(PAGE_ROWS),
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#text_hash": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}
_SCHEMA = "doc_id long, text_hash long, n_tokens long, tokens array<int>"


@lru_cache(maxsize=2)
def _worker_ids(path: str) -> PieceIds:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    word = tokenizer.model.tokenize
    with open(path, encoding="utf-8") as f:
        cuts = cuts_like(json.load(f))

    def encode(piece: str) -> bytes:
        ids = [t.id for t in word(byte_level(piece))] if cuts and is_plain(piece) else tokenizer.encode(piece, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    return PieceIds(encode, pieces if cuts else lambda text: [text])


def tokenize(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text_hash, n_tokens and tokens of every row of (doc_id, text_hash, text), in the order of the rows."""

    def run(batches):
        ids, end = _worker_ids(path or default_path()), np.array([END], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                found = [ids.ids(x.as_py()) + end for x in b.column("text")]
                ends = np.cumsum([0, *(len(x) // 4 for x in found)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<i4")))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(np.diff(ends).astype(np.int64)), lists], ["doc_id", "text_hash", "n_tokens", "tokens"])

    return docs.select("doc_id", "text_hash", "text").mapInArrow(run, _SCHEMA)


def write(docs: DataFrame, folder: str, path: str | None = None) -> None:
    """Write the token files of ``docs`` to ``folder``."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text", F.monotonically_increasing_id().alias("__tie"))
    rows = rows.repartitionByRange(parts, "doc_id", "text_hash", "__tie").sortWithinPartitions("doc_id", "text_hash")
    tokenize(rows, path).write.mode("overwrite").options(**_WRITE).parquet(folder)


def read(spark: SparkSession, folder: str, doc_ids: list[int] | None = None, columns: tuple[str, ...] = ("doc_id", "n_tokens", "tokens")) -> DataFrame:
    """Read token files, of all documents or of some, with all columns or some."""
    out = spark.read.schema(_SCHEMA).parquet(folder)
    return (out if doc_ids is None else out.where(F.col("doc_id").isin(doc_ids))).select(*columns)


def index(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document, from the files, which are read once."""

    def run(batches):
        for b in batches:
            lists = b.column("tokens")
            values, ends = memoryview(np.ascontiguousarray(lists.values.to_numpy().astype("<u4", copy=False))).cast("B"), (4 * lists.offsets.to_numpy().astype(np.int64)).tolist()
            crc = [zlib.crc32(values[i:j]) for i, j in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), b.column("n_tokens"), pa.array(crc, pa.int64())], ["doc_id", "text_hash", "n_tokens", "ids_crc32"])

    files = read(spark, folder, columns=("doc_id", "text_hash", "n_tokens", "tokens"))
    found = checkpoint(files.mapInArrow(run, "doc_id long, text_hash long, n_tokens long, ids_crc32 long"))
    return running_total(found, [F.col("doc_id").asc_nulls_first(), F.col("text_hash")], {"start": "n_tokens"}).drop("text_hash")


def query(spark, sf_dir: str) -> DataFrame:
    folder = staging_path(spark, "tokens")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return index(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")
