"""Benchmark decontamination by spaced seeds, DataFrame functions only.

A leak is a window of ``WINDOW`` consecutive tokens in which a document and a
benchmark item agree in all but ``SUBSTITUTIONS`` positions at most. The
window's positions form four blocks; two substitutions leave two blocks whole,
so each of six fixed masks keeps two blocks and ignores the other positions,
and every leak has a mask whose kept tokens are equal. Hashes of the kept
tokens of all windows of the documents meet those of the benchmark in a join;
hits are verified token by token over the whole window.

An item too short for a window is one window of its own length, from
``SHORTEST`` tokens on. The first mask keeps the first ``SHORTEST`` tokens of a
window, so its hashes find these items too; all their tokens must agree.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW_KEY, with_row_key

WINDOW = 13
SUBSTITUTIONS = 2
#: First position and length of each block of a window.
BLOCKS = ((0, 4), (4, 3), (7, 3), (10, 3))
MASKS = tuple(combinations(range(len(BLOCKS)), len(BLOCKS) - SUBSTITUTIONS))
#: Fewest tokens of an item that is looked for: what the first mask keeps.
SHORTEST = sum(BLOCKS[MASKS[0][-1]])
#: Seeds of the benchmark (about 200 bytes each) that are broadcast at most.
BROADCAST_SEEDS = 1_000_000


def tokens(text: Column | str) -> Column:
    """Lower-case runs of letters and digits, hashed; no null."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text,
                                                               F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ")
    return F.transform(words, lambda w: F.xxhash64(w))


def _windows(df: DataFrame, keep: list[str]) -> DataFrame:
    """A row a window and mask: its position and the key of the mask; of what
    is left at the end, the first mask's."""
    at = lambda i: F.get(F.col("t"), F.col("pos") + i)
    block = [F.xxhash64(*[at(a + i) for i in range(n)]) for a, n in BLOCKS]
    keys = [F.xxhash64(F.lit(m), *[F.col(f"b{i}") for i in mask]) for m, mask in enumerate(MASKS)]
    whole = F.col("pos") + WINDOW <= F.size("t")
    return (df.where(F.size("t") >= SHORTEST)
            .select(*keep, "t", F.explode(F.sequence(F.lit(0), F.size("t") - SHORTEST)).alias("pos"))
            .select(*keep, "t", "pos", *[b.alias(f"b{i}") for i, b in enumerate(block)])
            .select(*keep, "t", "pos", F.explode(F.when(whole, F.array(*keys)).otherwise(F.array(keys[0]))).alias("key")))


def _window() -> Column:
    return F.slice("t", F.col("pos") + 1, WINDOW)


def seeds(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(key, item, item_pos, item_window) of the benchmark; an item shorter
    than a window has one, shorter than the others."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), tokens(text_col).alias("t"))
    return (_windows(items, ["item"]).select("key", "item", F.col("pos").alias("item_pos"), _window().alias("item_window"))
            .where((F.size("item_window") == WINDOW) | (F.col("item_pos") == 0)))


def _verified(hits: DataFrame) -> DataFrame:
    """``hits`` (window, item_window, ...) that are leaks; ``n`` is the tokens of the item's window."""
    n = F.size("item_window")
    same = F.aggregate(F.zip_with(F.slice("window", 1, n), "item_window", lambda a, b: (a == b).cast("int")),
                       F.lit(0), lambda x, y: x + y)  # null where the document ends before
    return hits.where(same >= F.when(n < WINDOW, n).otherwise(WINDOW - SUBSTITUTIONS)).withColumn("n", n)


def _hits(d: DataFrame, keep: list[str], s: DataFrame) -> DataFrame:
    """(keep, item, pos, n): windows of ``d`` (keep, t) that leak, by seed; a
    window may come out more than once."""
    out = [*keep, "item", "pos", "n"]
    if s.limit(BROADCAST_SEEDS + 1).count() <= BROADCAST_SEEDS:  # size checked
        return _verified(_windows(d, keep).withColumn("window", _window()).drop("t").join(F.broadcast(s), "key")).select(*out)
    # a larger benchmark is joined by shuffle: windows travel as key, text hash and
    # position, and only the texts with a hit once more with their tokens
    text = ["__t1", "__t2"]
    d = d.withColumns({"__t1": F.xxhash64("t"), "__t2": F.xxhash64(F.lit(1), "t")})
    met = (_windows(d, text).drop("t").join(s.select("key", "item", "item_pos"), "key")
           .select(*text, "pos", "item", "item_pos").distinct())
    texts = (d.join(met.select(*text).distinct(), text, "left_semi").groupBy(*text).agg(F.first("t").alias("t")))
    parts = s.select("item", "item_pos", "item_window").distinct()
    found = _verified(met.join(parts, ["item", "item_pos"]).join(texts, text).withColumn("window", _window()).drop("t"))
    return d.select(*keep, *text).join(found.select(*text, "item", "pos", "n").distinct(), text).select(*out)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id_col long, item long, first_token, last_token, n_windows long): what
    of an item a document holds, by document and item; the tokens of the
    document from its first to its last leaked window, and the number of
    leaked windows.

    Items of SHORTEST tokens or more that are shorter than a window are found
    whole and unchanged, as one window; still shorter ones cannot be told from
    chance and are not looked for. Null and empty texts hold nothing. Documents with a null id are reported under null; rows with one id are
    one document; repeated items count once each. Empty tables give an empty
    result; other columns are ignored."""
    d = docs.select(F.col(id_col).cast("long").alias("doc"), tokens(F.col(text_col).cast("string")).alias("t"))
    found = (_hits(d, ["doc"], seeds(benchmark, item_col, item_text_col))
             .groupBy("doc", "item", "pos").agg(F.max("n").alias("n")))
    return (found.groupBy("doc", "item")
            .agg(F.min("pos").cast("long").alias("first_token"),
                 (F.max(F.col("pos") + F.col("n")) - 1).cast("long").alias("last_token"), F.count("*").alias("n_windows"))
            .withColumnsRenamed({"doc": id_col}))


def drop_leaked(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a leak, all their columns. Rows with a null
    id share their fate: all go if one of them leaks. ``drop_leaked_rows``
    decides a row at a time."""
    bad = leaks(docs, benchmark, id_col, text_col, item_col, item_text_col).select(
        F.col(id_col).alias("__bad")).distinct()
    return docs.join(bad, docs[id_col].cast("long").eqNullSafe(F.col("__bad")), "left_anti")


def drop_leaked_rows(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose own text has no leak, all their columns: a
    clean row stays, whatever other rows hold that have its id or none."""
    keyed = with_row_key(docs, id_col, text_col)
    d = keyed.select(*ROW_KEY, tokens(F.col(text_col).cast("string")).alias("t"))
    bad = _hits(d, ROW_KEY, seeds(benchmark, item_col, item_text_col)).select(*ROW_KEY).distinct()
    return keyed.join(bad, ROW_KEY, "left_anti").drop(*ROW_KEY)
