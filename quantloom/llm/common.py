"""What several text operators share: table access, shared folders, Arrow chunks, word splitting."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one step of a Python operator holds at once; a longer text is a chunk of its own.
CHUNK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def application_root(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables, which driver and executors share: below spark.checkpoint.dir of
    the session, or below ./spark-checkpoints of a local session without it; a cluster must name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: set it to a folder that driver and executors share")
        base = f"file://{os.path.abspath('spark-checkpoints')}"
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder in the application's; results may still read it, so that it stays until clear()."""
    return f"{application_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read again: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(made: DataFrame) -> None:
    """Removes the folder of a materialised frame that nothing reads any more."""
    spark = made.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(made.written_to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def crc32_mod(id_col: str, modulus: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `limit` bytes of `column`, texts or lists of texts."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        values = batch.column(column)
        of = values.offsets.to_numpy() - values.offsets[0].as_py() if pa.types.is_list(values.type) else np.arange(n + 1)
        texts = values.flatten() if pa.types.is_list(values.type) else values
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        ends = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))[of[1:]]
        start = 0
        while start < n:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def joined(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in fewer batches, each of about `limit` bytes of `column` or one of the given ones."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += pc.sum(pc.binary_length(batch.column(column)), min_count=0).as_py() or 0
        if size >= limit:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def split_words(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(offsets, index, distinct): text i holds the words distinct[index[offsets[i]:offsets[i+1]]].

    Words are `[^\\x20\\x09-\\x0D]+`; `lower` folds A-Z alone. A null text has no words."""
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten()
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(flat), 0)
    if not pc.all(full, min_count=0).as_py():
        keep = full.to_numpy(zero_copy_only=False)
        offsets = np.concatenate(([0], np.cumsum(keep, dtype=np.int64)))[offsets]
        flat = flat.filter(full)
    coded = flat.dictionary_encode()
    return offsets, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def byte_classes(words: str = "", spaces: str = "", delimiters: str = "", default: int = 0) -> np.ndarray:
    """Class of every byte for byte_words: 0 in a word, 1 space, 2 delimiter. Bytes above 127 are in words."""
    kinds = np.zeros(256, np.uint8)
    kinds[:128] = default
    for kind, members in enumerate((words, spaces, delimiters)):
        kinds[list(members.encode("ascii"))] = kind
    return kinds


def byte_words(texts: pa.Array, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """(offsets, index, distinct, part): text i holds the words distinct[index[offsets[i]:offsets[i+1]]], A-Z folded; words of
    one text without a delimiter between them have the same part. A null text has no words."""
    texts = pc.ascii_lower(pc.fill_null(texts, ""))
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8)[bounds[0] : bounds[-1]] if body is not None else np.zeros(0, np.uint8)
    kind, bounds = kinds[data], (bounds - bounds[0]).astype(np.int64)
    word = kind == 0
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    first = bounds[:-1][bounds[:-1] < len(data)]
    begins[first] = word[first]
    at = np.flatnonzero(begins)
    offsets = np.searchsorted(at, bounds)
    letters = data[word]
    places = np.append(np.cumsum(word, dtype=np.int32)[at] - 1, len(letters)).astype(np.int32)
    coded = pa.StringArray.from_buffers(len(at), pa.py_buffer(places), pa.py_buffer(letters)).dictionary_encode()
    part = np.cumsum(kind == 2, dtype=np.int64)[at] + np.repeat(np.arange(len(texts)), np.diff(offsets))
    return offsets, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, part


def segments(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[0], starts[0]+1, ... of all segments, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
