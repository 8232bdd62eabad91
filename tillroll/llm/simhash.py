"""SimHash near-duplicates with pivot distance tables.

Fingerprints are made a text at a time, and equal fingerprints are merged
before anything is compared. Two fingerprints that differ in at most ``r``
bits agree in ``blocks - r`` of ``blocks`` bit blocks, so candidates meet in
buckets keyed by those blocks. Random pivots alone cannot find them: a pair of
unrelated 64-bit fingerprints passes one pivot with a probability near one
half, so a join on pivot cells would have to probe most cells. In a bucket the
pivot table decides: Hamming distances to ``pivots`` reference fingerprints
are computed once a member, pairs whose distances to some pivot differ by more
than ``r`` are discarded (triangle inequality), and the survivors are verified
by their bits. A task returns the links that join its groups, not all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import cut_lineage
from .common import ROW_KEY, with_row_key, word_spans
from .components import components

BITS = 64
SEED = 42
#: Shingles whose bits are counted at a time, so that a text of any length fits.
STEP = 1 << 15


def fingerprint(text: str | None, shingle: int) -> int:
    """Majority bits of the shingles' XXH64; 0 for a text without words."""
    joined, starts, ends = word_spans(text, lower=True)
    k = min(shingle, len(starts))
    if not k:
        return 0
    starts, ends = starts[: len(starts) - k + 1], ends[k - 1:]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, len(starts), STEP):
        h = np.array([digest(joined[a:b], SEED) for a, b in
                      zip(starts[at:at + STEP].tolist(), ends[at:at + STEP].tolist())], np.uint64)
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = 3) -> DataFrame:
    """(id: long, fp: long, the fingerprint's bits as a signed long), a row a row."""
    return _fingerprints(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string")), shingle)


def _fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """``docs`` with fp in the place of its last column, the text."""
    slim = docs.select(*docs.columns[:-1])
    names = [*slim.columns, "fp"]

    def make(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(len(names) - 1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps.view(np.int64))], names)
    return docs.mapInArrow(make, StructType([*slim.schema.fields, StructField("fp", LongType())]))


def block_masks(blocks: int, bits: int) -> list[int]:
    """Masks (signed) of every choice of ``blocks - bits`` blocks."""
    cuts = [round(i * BITS / blocks) for i in range(blocks + 1)]
    one = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    masks = [sum(one[i] for i in c) for c in combinations(range(blocks), blocks - bits)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def pivot_table(fps: np.ndarray, pivots: int) -> np.ndarray:
    """Hamming distances to ``pivots`` fixed reference fingerprints."""
    reference = np.random.default_rng(SEED).integers(0, 1 << 63, pivots, np.uint64) * np.uint64(2) + np.uint64(1)
    return np.bitwise_count(fps[:, None] ^ reference[None, :])


def _root(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def link_groups(group: np.ndarray, fps: np.ndarray, bits: int, pivots: int) -> list[tuple[int, int]]:
    """Index pairs that join the members of each group linked at ``bits`` or
    fewer differing bits: a spanning forest. ``group`` is sorted."""
    n = len(fps)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    after = np.repeat(np.r_[starts[1:], n], np.diff(np.r_[starts, n])) - np.arange(n)
    table, parent, links = pivot_table(fps, pivots), np.arange(n), []
    a = np.flatnonzero(after > 1)
    step = 1
    while len(a):
        near = a
        for p in range(pivots):  # discard by the largest difference of coordinates
            d = table[near, p].astype(np.int16) - table[near + step, p]
            near = near[np.abs(d) <= bits]
        near = near[np.bitwise_count(fps[near] ^ fps[near + step]) <= bits]
        near = near[parent[near] != parent[near + step]]
        for i in near.tolist():
            x, y = _root(parent, i), _root(parent, i + step)
            if x != y:
                parent[max(x, y)] = min(x, y)
                links.append((i, i + step))
        if len(near):
            while not np.array_equal(up := parent[parent], parent):
                parent = up
        step += 1
        a = a[after[a] > step]
    return links


def fingerprint_links(nodes: DataFrame, bits: int = 3, blocks: int = 5, pivots: int = 16,
                      chunk: int = 2048) -> DataFrame:
    """``nodes`` (fp, node: long, one row a fingerprint) to links (a, b) between
    nodes that give the components of "at most ``bits`` bits differ".

    A bucket of more than ``chunk`` members is dealt to tasks as pairs of its
    chunks, so a task never holds more than two chunks of a bucket."""
    masks = block_masks(blocks, bits)
    keys = nodes.select("fp", "node", F.posexplode(F.array(
        *[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("t", "key"))
    many = (keys.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"))
    parts = F.ceil(F.col("n") / F.lit(chunk)).cast("int")
    dealt = (keys.join(many, ["t", "key"])
             .withColumn("parts", parts)
             .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("t", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                     "fp", "node"))
    by = ["t", "key", "i", "j"]

    def link(batches):
        held = None
        def out(table):
            cols = [table.column(c).to_numpy() for c in by]
            new = np.zeros(table.num_rows, bool)
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            node = table.column("node").to_numpy()
            fps = table.column("fp").to_numpy().view(np.uint64)
            found = np.array(link_groups(np.cumsum(new), fps, bits, pivots), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(node[found[:, 0]]), pa.array(node[found[:, 1]])], ["a", "b"])
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            if not held.num_rows:
                continue
            # the last group may go on in the next batch
            last = np.ones(held.num_rows, bool)
            for c in by:
                col = held.column(c).to_numpy()
                last &= col == col[-1]
            cut = int(np.argmax(last))
            if cut:
                yield out(held.slice(0, cut).combine_chunks())
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield out(held.combine_chunks())

    return dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 3, bits: int = 3, blocks: int = 5, pivots: int = 16) -> DataFrame:
    """One row (id_col long, fingerprint: 16 hex digits, component_id long) a
    row of ``docs``; component_id is the smallest id reachable over links of at
    most ``bits`` differing bits.

    Null and empty texts have fingerprint zero and link like any other. Rows
    with a null id take part; their component is the smallest other id, or null
    where all are null. Repeated rows come out as often as they come in. Other
    columns are ignored; an empty table gives an empty result.
    """
    fps = cut_lineage(fingerprints(docs, id_col, text_col, shingle))
    # a fingerprint's node is its smallest id, so the smallest node of a
    # component is the smallest id; fingerprints of null ids only can't be smallest
    nodes = cut_lineage(fps.groupBy("fp").agg(F.min("id").alias("node")))
    far = F.lit((1 << 63) - 1)
    # nodes of null ids only: numbered above all ids by their fingerprint's order
    known = nodes.where("node is not null")
    blank = nodes.where("node is null").select("fp", (far - F.pmod("fp", F.lit(1 << 61))).alias("node"))
    found = components(fingerprint_links(known.unionByName(blank), bits, blocks, pivots))
    labels = (known.unionByName(blank).join(found, "node", "left")
              .select("fp", F.coalesce("component", "node").alias("c"), "node"))
    ceiling = (1 << 63) - 1 - (1 << 61)
    return (fps.join(labels, "fp")
            .select(F.col("id").alias(id_col),
                    F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                    F.when(F.col("c") < ceiling, F.col("c")).alias("component_id")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         shingle: int = 3, bits: int = 3) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, with all
    their columns. A row with a null id stays; rows that repeat an id stay or
    go together. ``keep_one_a_group`` decides a row at a time."""
    found = near_duplicates(docs, id_col, text_col, shingle, bits)
    gone = (found.where(F.col(id_col) != F.col("component_id"))
            .select(F.col(id_col).cast("long").alias("__gone")).distinct())
    return docs.join(gone, docs[id_col].cast("long") == F.col("__gone"), "left_anti")


def keep_one_a_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                     bits: int = 3, blocks: int = 5, pivots: int = 16) -> DataFrame:
    """One row of ``docs``, with all its columns, of each group of near
    duplicates: the one with the smallest id, null ids last, and of those with
    one id the one whose text hashes lowest. Of rows with one id and text any
    one stays. Groups are by text alone; a shared id links nothing."""
    keyed = with_row_key(docs, id_col, text_col)
    fps = _fingerprints(keyed.select(*ROW_KEY, F.col(text_col).cast("string").alias("text")), shingle)
    # a row a fingerprint, which is its own node: rows that share an id may differ in text
    best = cut_lineage(fps.groupBy("fp").agg(F.min(F.struct(*ROW_KEY)).alias("best")))
    found = components(fingerprint_links(best.select("fp", F.col("fp").alias("node")), bits, blocks, pivots))
    stay = (best.join(found, best.fp == found.node, "left")
            .groupBy(F.coalesce("component", "fp").alias("c")).agg(F.min("best").alias("best")).select("best.*"))
    # rows of one id and text are reduced before the shuffle, so that many of them are no hot key
    return keyed.dropDuplicates(ROW_KEY).join(stay, ROW_KEY, "left_semi").drop(*ROW_KEY)
