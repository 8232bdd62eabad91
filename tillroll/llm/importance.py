"""Importance resampling towards a target by hashed word runs.

Features are runs of one to three words, hashed by CRC-32 into buckets. CRC-32
is linear: without its fixed start and end it is the XOR of what each byte
gives at its distance from the end, and start and end give a constant for each
length. So the hashes of all runs of many texts come from one table of
contributions by byte and distance, gathered for all bytes of all runs and
reduced by ``bitwise_xor.reduceat``; runs longer than the table are folded a
block at a time.

Bucket counts of the corpus and of the target give each bucket a log gain; a
text's weight is the sum over its features, a score adds Gumbel noise from a
hash of its id, and the highest scores are a draw without replacement in
proportion to the exponential of the weight.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage

BUCKETS = 10_000
RUN = 3
MIN_WORDS = 20
PERCENT = 5
SEED = 42
#: Distances from the end that the table of contributions has; also the block
#: by which longer runs are folded.
BLOCK = 128
#: Bytes of text that are hashed together; one text may have more.
BATCH_BYTES = 1 << 18
#: Bytes of runs whose contributions are gathered at once.
GATHER_BYTES = 1 << 16
#: Bytes that separate words: ASCII other than digits and small letters, after
#: A-Z became small.
SEPARATE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
                 for b in range(256))


def crc_table(n: int = BLOCK) -> np.ndarray:
    """(n x 256) contributions to a CRC-32 of a byte that ``n`` bytes follow."""
    # a lone byte without the constant of length one
    table = np.zeros((n, 256), np.uint32)
    table[0] = [zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)]
    for d in range(1, n):  # one zero byte more behind it
        table[d] = (table[d - 1] >> np.uint32(8)) ^ table[0][table[d - 1] & np.uint32(255)]
    return table


class SpanCrc:
    """CRC-32 of spans of a byte array."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        table = crc_table(block)
        self.flat = table.reshape(-1)
        # the register so far counts as four more bytes on the next block's first four
        self.carry = [table[block - 1 - i] for i in range(4)]
        #: what the start value and the final inversion give, by length
        self.constant = np.array([zlib.crc32(bytes(n)) for n in range(block + 1)], np.uint32)

    def raw(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """XOR of the contributions of spans of 1 to ``block`` bytes."""
        first = np.cumsum(lengths) - lengths
        # ends of the spans, by byte gathered; the distance from the end follows
        step = np.arange(int(lengths.sum()), dtype=np.int32)
        at = step + np.repeat((starts - first).astype(np.int32), lengths)
        distance = np.repeat((first + lengths - 1).astype(np.int32), lengths) - step
        return np.bitwise_xor.reduceat(self.flat.take((distance << 8) + data.take(at)), first)

    def __call__(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Unsigned CRC-32 of each span, a step of bounded size at a time."""
        out = np.zeros(len(starts), np.uint32)
        short = np.flatnonzero((lengths > 0) & (lengths <= self.block))
        ends = np.cumsum(lengths[short])
        lo = 0
        while lo < len(short):
            hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + GATHER_BYTES, "right"))
            some = short[lo:max(hi, lo + 1)]
            out[some] = self.raw(data, starts[some], lengths[some]) ^ self.constant[lengths[some]]
            lo = max(hi, lo + 1)
        for i in np.flatnonzero(lengths > self.block):
            out[i] = self.long(data, int(starts[i]), int(lengths[i]))
        return out

    def long(self, data: np.ndarray, start: int, length: int) -> int:
        """CRC-32 of one span of more than a block: the first bytes that do not
        fill a block, then the register carried over block after block."""
        head = (length - 1) % self.block + 1
        reg = int(self.raw(data, np.array([start]), np.array([head]))[0]) ^ int(self.constant[head]) ^ 0xFFFFFFFF
        c0, c1, c2, c3 = self.carry
        for at in range(start + head, start + length, self.block * 4096):
            blocks = np.arange(at, min(at + self.block * 4096, start + length), self.block)
            for gained in self.raw(data, blocks, np.full(len(blocks), self.block)).tolist():
                reg = (int(c0[reg & 255]) ^ int(c1[reg >> 8 & 255]) ^ int(c2[reg >> 16 & 255])
                       ^ int(c3[reg >> 24]) ^ gained)
        return reg ^ 0xFFFFFFFF


def normal(text: str | None) -> bytes:
    """The words of a text, joined by single spaces (UTF-8)."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").translate(SEPARATE).split())


def run_spans(data: np.ndarray, first: np.ndarray, run: int):
    """Starts, lengths and text numbers of all runs of 1 to ``run`` words.
    ``data`` holds texts that end in a line feed each, the text i starts at
    ``first[i]``; a text without words is a line feed alone."""
    ends = np.flatnonzero((data == 32) | (data == 10))
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    some = ends > starts
    starts, ends = starts[some], ends[some]
    owner = np.searchsorted(first, starts, "right") - 1
    parts = []
    for k in range(1, run + 1):
        here = len(starts) - k + 1
        if here <= 0:
            break
        whole = owner[:here] == owner[k - 1:]
        parts.append((starts[:here][whole], (ends[k - 1:] - starts[:here])[whole], owner[:here][whole]))
    none = np.zeros(0, np.int64)
    return [np.concatenate(x) for x in zip(*parts)] if parts else [none, none, none], np.bincount(
        owner, minlength=len(first))


def _batches(texts):
    """Lists of normal texts of bounded size together."""
    held, size = [], 0
    for t in texts:
        t = normal(t)
        held.append(t)
        size += len(t)
        if size >= BATCH_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def feature_buckets(texts, crc: SpanCrc, buckets: int, run: int):
    """For lists of texts in turn: bucket and text number of each feature, and
    the number of words of each text."""
    for held in _batches(texts):
        data = np.frombuffer(b"".join(t + b"\n" for t in held), np.uint8)
        lengths = np.fromiter(map(len, held), np.int64, len(held)) + 1
        (starts, sizes, owner), words = run_spans(data, np.cumsum(lengths) - lengths, run)
        yield (crc(data, starts, sizes) % np.uint32(buckets)).astype(np.int64), owner, words


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS, run: int = RUN) -> DataFrame:
    """(bucket, n long): features of all texts by bucket; buckets without one
    are absent. A task sends a row a bucket at most. Null and empty texts have
    no features; an empty table gives an empty result."""
    def count(batches):
        crc, total = SpanCrc(), np.zeros(buckets, np.int64)
        for batch in batches:
            for found, _, _ in feature_buckets(batch.column(0).to_pylist(), crc, buckets, run):
                total += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])
    return (docs.select(F.col(text_col).cast("string")).mapInArrow(count, "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_text_col: str = "text",
          buckets: int = BUCKETS, run: int = RUN) -> DataFrame:
    """(bucket, gain long), a row a bucket: 1000 times the log ratio, rounded
    down, of the bucket's shares in the target and in the corpus, each with one
    feature a bucket added."""
    spark = docs.sparkSession
    both = (bucket_counts(docs, text_col, buckets, run).select("bucket", F.col("n").alias("s"), F.lit(0).alias("t"))
            .unionByName(bucket_counts(target, target_text_col, buckets, run)
                         .select("bucket", F.lit(0).alias("s"), F.col("n").alias("t")))
            .unionByName(spark.range(buckets).select(F.col("id").alias("bucket"), F.lit(0).alias("s"),
                                                     F.lit(0).alias("t"))))
    # counted once: the totals are taken from the stored rows, one a bucket
    by_bucket = cut_lineage(both.groupBy("bucket").agg(F.sum("s").cast("double").alias("s"),
                                                       F.sum("t").cast("double").alias("t")))
    all_s, all_t = (by_bucket.select(F.sum(c)).scalar() for c in "st")
    ratio = ((F.col("t") + 1) * (all_s + buckets)) / ((F.col("s") + 1) * (all_t + buckets))
    return by_bucket.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def noise(id_col: Column, seed: int = SEED) -> Column:
    """1000 times a Gumbel number from the id, rounded down."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text",
            run: int = RUN) -> DataFrame:
    """(id_col, n_words, n_features, weight long), a row a row of ``docs``;
    ``gain`` holds a number a bucket."""
    def weigh(batches):
        crc = SpanCrc()
        for batch in batches:
            words, n, weight = [], [], []
            for found, owner, held in feature_buckets(batch.column(1).to_pylist(), crc, len(gain), run):
                words.append(held)
                n.append(np.bincount(owner, minlength=len(held)))
                # the features of one run length lie in order of their texts: summed in whole numbers
                each = np.zeros(len(held), np.int64)
                np.add.at(each, owner, gain[found])
                weight.append(each)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))
                                    for x in (words, n, weight)]], ["id", "n_words", "n_features", "weight"])
    return (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string"))
            .mapInArrow(weigh, "id long, n_words long, n_features long, weight long")
            .withColumnRenamed("id", id_col))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             target_text_col: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS,
             seed: int = SEED, buckets: int = BUCKETS, run: int = RUN) -> DataFrame:
    """(id_col, n_words, n_features, weight, score, rank long), a row a row of
    ``docs``. Of the rows with ``min_words`` words or more, ``percent`` in a
    hundred (rounded down) with the highest scores get their rank, equal scores
    by smaller id; the others' rank is null.

    Null and empty texts have no features and weight zero. A null id comes
    after all others and has the noise of the word null; rows with equal ids
    and scores are drawn in any order. An empty target counts as one without
    features; an empty table gives an empty result. Other columns are ignored.

    Ranks come from a range-partitioned sort: a partition numbers its own rows
    and the driver adds up one count a partition. The gains, one number a
    bucket, go to all tasks."""
    found = gains(docs, target, text_col, target_text_col, buckets, run).collect()  # one row a bucket
    gain = np.zeros(buckets, np.int64)
    for r in found:
        gain[r["bucket"]] = r["gain"]
    scored = cut_lineage(weights(docs, gain, id_col, text_col, run)
                         .withColumn("score", F.col("weight") + noise(F.col(id_col), seed)))
    # the stored rows are numbered to tell equal ones apart, so one group of them can be split
    open_rows = (scored.where(F.col("n_words") >= min_words)
                 .select(F.col(id_col).alias("id"), "n_words", "n_features", "weight", "score",
                         F.monotonically_increasing_id().alias("__row")))
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("__row")]
    ordered = cut_lineage(open_rows.orderBy(*order).withColumn("__part", F.spark_partition_id()))
    counts = sorted((r[0], r[1]) for r in ordered.groupBy("__part").count().collect())
    drawn, before, starts = sum(n for _, n in counts) * percent // 100, 0, []
    for part, n in counts:
        starts.append((part, before))
        before += n
    spark = docs.sparkSession
    offset = spark.createDataFrame(starts or [(0, 0)], "__part int, __before long")
    place = F.col("__before") + F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    ranked = (ordered.join(F.broadcast(offset), "__part")  # a row a partition
              .select("id", "n_words", "n_features", "weight", "score", place.alias("place"))
              .withColumn("rank", F.when(F.col("place") <= drawn, F.col("place")).cast("long")).drop("place"))
    rest = (scored.where(F.col("n_words") < min_words)
            .select(F.col(id_col).alias("id"), "n_words", "n_features", "weight", "score",
                    F.lit(None).cast("long").alias("rank")))
    return ranked.unionByName(rest).withColumnRenamed("id", id_col)
