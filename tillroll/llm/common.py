"""Helpers shared by the training-data operators."""

from __future__ import annotations

import sys
import types

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def n_words(text: Column | str) -> Column:
    """Number of words as a long; 0 for null and empty texts."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Columns of ``with_row_key``.
ROW_KEY = ["__key_blank", "__key_id", "__key_text1", "__key_text2"]


def with_row_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with ROW_KEY: whether the id is null, the id, and 128 bits of
    the text. None is null, so rows can meet by plain equality, and rows with a
    null or repeated id are told apart by their text."""
    text = docs[text_col].cast("string")
    return docs.withColumns(dict(zip(ROW_KEY, [
        docs[id_col].cast("long").isNull(), F.coalesce(docs[id_col].cast("long"), F.lit(0).cast("long")),
        F.xxhash64(text), F.xxhash64(F.lit(1), text)])))


def word_spans(text: str | None, lower: bool = False) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words of a text joined by single spaces (UTF-8) with the start and
    end offset of each. ``bytes.split`` and ``bytes.lower`` treat exactly the
    ASCII white space and A-Z, whatever the script of the text."""
    raw = (text or "").encode()
    words = (raw.lower() if lower else raw).split()
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    return b" ".join(words), ends - lengths, ends


def pack(array: np.ndarray) -> bytes:
    """Compress a numeric array byte plane by byte plane: the planes of small
    or slowly changing values are nearly constant."""
    width = array.dtype.itemsize
    planes = np.ascontiguousarray(array.view(np.uint8).reshape(-1, width).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(dtype).reshape(-1)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared store, whatever lies in it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def worker_kept(key: str, make):
    """What ``make`` returns, kept for later tasks of the Python worker. Only
    one thing is kept, so a worker that goes on to another operator gives the
    memory back. Only a cache: losing it costs time."""
    name = "tillroll_worker_kept"
    store = sys.modules.setdefault(name, types.ModuleType(name)).__dict__
    if store.get("key") != key:
        store["kept"] = None
        store["kept"], store["key"] = make(), key
    return store["kept"]
