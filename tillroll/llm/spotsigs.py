"""Document fingerprints by SpotSigs.

A signature is a chain: a common word (anchor) and the content words that
follow it. Common words are spread evenly over running text and rare in
menus and lists, so chains mark the running text. A fingerprint is the sorted
set of a text's signatures; two are compared by Jaccard, which the sizes of
the sets bound from above.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .components import components

#: Anchors: common words of the languages of the corpus.
ANCHORS = {
    "en": "a an the is are was were be been to of and in that it for on with as by at from this or not",
    "es": "el la los las un una de que y en es por para con se no del al lo su como o",
    "fr": "le la les un une des du de et en est que qui dans pour par sur au pas ce il elle",
    "de": "der die das und in den von zu mit sich des auf ist im dem nicht ein eine als auch für",
}
CHAIN = 2
#: Parts that :func:`edit_report` orders documents in, at most; the driver
#: holds an id a part, and a part streams through its task.
PARTS = 20_000
STRIP = b".,;:!?\"'()[]{}|"


def anchor_set(anchors=ANCHORS) -> frozenset[bytes]:
    return frozenset(w.encode() for line in anchors.values() for w in line.split())


def signatures(text: str | None, anchors: frozenset[bytes], chain: int = CHAIN) -> np.ndarray:
    """The sorted distinct 32-bit signatures of a text. A text without chains
    has one signature over all its words, so unlike texts stay unlike."""
    words = [w.strip(STRIP) for w in (text or "").encode().lower().split()]
    content, at = [], []
    for w in words:
        if w in anchors:
            at.append((w, len(content)))
        elif w:
            content.append(w)
    last, digest = len(content) - chain, xxhash.xxh32_intdigest
    found = {digest(b" ".join((w, *content[k:k + chain]))) for w, k in at if k <= last}
    if not found:
        found = {digest(b"\n" + b" ".join((text or "").encode().split()))}
    return np.sort(np.fromiter(found, ">u4", len(found)))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard of two signature sets."""
    if a is b or (len(a) == len(b) and np.array_equal(a, b)):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def edited(text: str, follower: str) -> str:
    """``text`` with its last floor(n/2) code points replaced by the first as
    many (or all) of ``follower``."""
    half = len(text) // 2
    return text[: len(text) - half] + follower[:half]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 anchors=ANCHORS, chain: int = CHAIN) -> DataFrame:
    """(id long, signatures array<long> sorted), a row a row of ``docs``. Null
    and empty texts have the one signature of no words."""
    words = anchor_set(anchors)

    def make(batches):
        for batch in batches:
            sets = [signatures(t, words, chain).astype(np.int64) for t in batch.column(1).to_pylist()]
            offsets = np.cumsum([0, *map(len, sets)])
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))],
                ["id", "signatures"])
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
        make, "id long, signatures array<long>")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    threshold: float = 0.8, anchors=ANCHORS, chain: int = CHAIN) -> DataFrame:
    """(id_col long, component_id long, n_links long), a row a row of ``docs``:
    classes of documents linked by a signature Jaccard of ``threshold`` or more.

    Equal sets are one class member. The rest meet by the rarest signatures of
    each set (a prefix that two sets of that likeness must share) within
    partitions of set length whose bounds grow by 1/threshold, so a set is
    compared with its own and the next length partition only; pairs are then
    pruned by their lengths and verified. Null ids take part but are no
    component's id: a component of null ids only has none. An empty table gives
    an empty result."""
    sets = cut_lineage(fingerprints(docs, id_col, text_col, anchors, chain))
    # classes of null ids only: numbered above all ids by a hash of their set
    above, spread = (1 << 63) - 1 - (1 << 61), F.pmod(F.xxhash64("signatures"), F.lit(1 << 61))
    classes = cut_lineage(sets.groupBy("signatures").agg(F.min("id").alias("node"))
                          .withColumn("node", F.coalesce("node", F.lit(above) + spread)))
    size = F.size("signatures")
    rare = (classes.select(F.explode("signatures").alias("s")).groupBy("s").agg(F.count("*").alias("df")))
    by_rarity = (classes.select("node", size.alias("n"), F.explode("signatures").alias("s"))
                 .join(rare, "s").groupBy("node", "n")
                 .agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("ranked")))
    prefix = (F.col("n") - F.ceil(F.lit(threshold) * F.col("n")) + 1).cast("int")
    part = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(1 / threshold)))).cast("int")
    keyed = (by_rarity.select("node", "n", part.alias("part"),
                              F.explode(F.slice("ranked", 1, prefix)).alias("k"))
             .select("node", "n", "part", F.col("k.s").alias("s")))
    left = keyed.select(F.col("node").alias("a"), F.col("n").alias("an"), "s", F.explode(
        F.array(F.col("part"), F.col("part") + 1)).alias("part"))
    pairs = (left.join(keyed.select(F.col("node").alias("b"), F.col("n").alias("bn"), "s", "part"),
                       ["s", "part"])
             .where((F.col("an") < F.col("bn")) | ((F.col("an") == F.col("bn")) & (F.col("a") < F.col("b"))))
             .where(F.col("an") >= F.lit(threshold) * F.col("bn")).select("a", "b").distinct())
    x = classes.select(F.col("node").alias("a"), F.col("signatures").alias("x"))
    y = classes.select(F.col("node").alias("b"), F.col("signatures").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    links = cut_lineage(pairs.join(x, "a").join(y, "b")
                        .where(both >= F.lit(threshold) * (F.size("x") + F.size("y") - both)).select("a", "b"))
    found = components(links)
    n_links = (links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node")
               .agg(F.count("*").alias("n_links")))
    labels = (classes.join(found, "node", "left").join(n_links, "node", "left")
              .select("signatures", F.coalesce("component", "node").alias("component_id"),
                      F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))
    return (sets.join(labels, "signatures", "left")
            .select(F.col("id").alias(id_col),
                    F.when(F.col("component_id") < above, F.col("component_id")).alias("component_id"), "n_links"))


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                anchors=ANCHORS, chain: int = CHAIN, per_part: int = 4000) -> DataFrame:
    """Each document's fingerprint beside that of its text edited with the next
    document's (ascending id, nulls first, rows with one id by text; after the
    last comes the first): (id_col long, n_chars long, edited_sha256,
    fingerprint, edited_fingerprint: 8 hex digits a signature, near_edited,
    near_next: double), a row a row of ``docs``.

    Texts travel once. The order is cut at ids that exist (quantiles), so the
    first document of a part is known and is sent to the part before it too.
    Null and empty texts have no characters; a table of one document follows
    itself; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    schema = (f"`{id_col}` long, n_chars long, edited_sha256 string, fingerprint string, "
              "edited_fingerprint string, near_edited double, near_next double")
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(
        F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ids = slim.select("id")
    n, blank, low = ids.agg(F.count("*"), F.sum(F.col("id").isNull().cast("int")), F.min("id")).first()
    if not n:
        return spark.createDataFrame([], schema)
    cuts = min(-(-n // per_part), PARTS)
    bounds = ids.agg(F.percentile_approx("id", [i / cuts for i in range(cuts)] if cuts > 1 else [0.0],
                                         max(10_000, 20 * cuts))).first()[0]
    # part p holds ids from bounds[p] on; part 0 also nulls, which come first
    bounds = np.unique(np.array([low, *bounds], np.int64)) if low is not None else np.zeros(1, np.int64)
    wrap = None if blank else low  # the id after the last; None: the null ids
    words = anchor_set(anchors)

    def deal(batches):
        for batch in batches:
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            value = batch.column(0).fill_null(0).to_numpy()
            part = np.where(known, np.maximum(np.searchsorted(bounds, value, "right") - 1, 0), 0)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(np.zeros(len(part), np.int32)),
                                              *batch.columns], ["part", "tail", "id", "text"])
            head = known & np.isin(value, bounds[1:])
            first = known & (value == wrap) if wrap is not None else ~known
            for pick, to in ((head, part - 1), (first, np.full(len(part), len(bounds) - 1))):
                if pick.any():
                    i = np.flatnonzero(pick)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(to[i], pa.int64()), pa.array(np.ones(len(i), np.int32)),
                        batch.column(0).take(pa.array(i)), batch.column(1).take(pa.array(i))],
                        ["part", "tail", "id", "text"])

    def compare(batches):
        held = None  # the row whose follower comes next
        rows = []

        def close(row, follower, f_set):
            text, own = row[1], row[2]
            new = edited(text, follower)
            new_set = own if new == text else signatures(new, words, chain)
            rows.append((row[0], len(text), hashlib.sha256(new.encode()).hexdigest(), own.tobytes().hex(),
                         new_set.tobytes().hex(), likeness(own, new_set), likeness(own, f_set)))

        def out():
            cols = list(zip(*rows))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                     "near_edited", "near_next"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

        for batch in batches:
            for part, tail, i, text in zip(*[c.to_pylist() for c in batch.columns]):
                if held is not None and held[3] != part:
                    held = None
                if tail and held is None:
                    continue
                own = signatures(text, words, chain)
                if held is not None:
                    close(held, text, own)
                held = None if tail else (i, text, own, part)
                if len(rows) >= 1000:
                    yield out()
                    rows.clear()
        if rows:
            yield out()

    order = ["part", "tail", F.col("id").asc_nulls_first(), "text"]
    return (slim.mapInArrow(deal, "part long, tail int, id long, text string")
            .repartition("part").sortWithinPartitions(*order).mapInArrow(compare, schema))
