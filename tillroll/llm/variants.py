"""Spelling variants: words one edit apart, by a frontier walked through a trie.

The trie is a table: a row a node, with its edges; a node is the prefix that it
stands for, and its edges are at most as many as the alphabet has letters. A
state is (word, node, position, edits). A level joins all states of one depth
with their nodes. A state without an edit sends out, for each edge besides its
own letter, a state that has replaced that letter, and one that has deleted it;
a state with an edit follows its next letter or ends. One whose word is used up
on a node where a word ends has found a neighbour.

An edit lies in one half of a word. So there is a trie of the words and one of
the reversed words, and a word sends out edits from its middle on only, where
its node is known: the crowded first levels are never walked. An inserted
letter is the other word's deleted one, and of two words that differ in a
letter the one with the smaller letter finds the other, so a pair comes out
once. Each edge has the lengths of what lies behind it, as bits, and a state
goes where its word can end.

Words of more than ``TRIE`` letters would need a level a letter. They meet by
hashes of themselves less each letter, kept in sums so that a word costs time
in proportion to its length, and are compared in whole: exact as well.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_path
from .common import drop_folder

#: Runs of letters, and the letters that become small.
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DROP = 97
MIN_LENGTH = 5
MIN_COUNT = 3
#: Longest word that is walked through the trie; lengths are bits of a long.
TRIE = 40
#: A form has at least so many times the occurrences of its word.
TIMES = 2


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop: int = DROP,
          min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n long): letter runs of the texts, A-Z made small, that have
    ``min_length`` letters and ``min_count`` occurrences. A run whose CRC-32
    together with its document's id can be divided by ``drop`` has lost the
    letter that the CRC names. Null and empty texts have no words; a null id is
    the word null; an empty table gives an empty result. Occurrences are summed
    in the tasks before they are dealt out."""
    runs = (docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"),
                        F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(RUN), F.lit(0))).alias("run"))
            .where(F.length("run") >= min_length)
            .select("id", F.translate("run", UPPER, LOWER).alias("run")))
    h = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = F.pmod("h", F.length("run")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return (h.select(F.when(F.col("h") % drop == 0, short).otherwise(F.col("run")).alias("word"))
            .where(F.length("word") >= min_length)
            .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count))


def _letter(at):
    """The letter of ``text`` at a position from 0; empty behind its end."""
    return F.substring("text", at + 1, F.lit(1))


def _trie(both: DataFrame) -> DataFrame:
    """(depth, way, node, edges): a row a node of the tries of ``both`` (way,
    text, n) from the middle of their words on. An edge is its letter, the
    bits of the lengths behind it and, where the letter is empty, the n of the
    word that ends on the node."""
    size = F.length("text")
    steps = both.select("way", "text", "n", F.explode(F.sequence(F.floor(size / 2).cast("int"), size)).alias("depth"))
    behind = F.when(F.col("depth") == size, 0).otherwise(F.expr("shiftleft(1L, length(text) - depth - 1)"))
    edges = (steps.select("depth", "way", F.substring("text", F.lit(1), F.col("depth")).alias("node"),
                          _letter(F.col("depth")).alias("letter"), behind.cast("long").alias("behind"),
                          F.when(F.col("depth") == size, F.col("n")).alias("n"))
             .groupBy("depth", "way", "node", "letter").agg(F.bit_or("behind").alias("behind"), F.max("n").alias("n")))
    return edges.groupBy("depth", "way", "node").agg(F.collect_list(F.struct("letter", "behind", "n")).alias("edges"))


def _moves() -> str:
    """SQL: where a state (text, pos, edited) on a node goes along ``edges``, as
    an array of (letter, pos, n). An empty letter has found the word that ends
    on the node."""
    can = "(shiftrightunsigned(e.behind, length(text) - {p}) & 1) = 1"
    to = "named_struct('letter', e.letter, 'pos', {p}, 'n', e.n)"

    def move(where: str, p: str) -> str:
        return f"transform(filter(edges, e -> {where}), e -> {to.format(p=p)})"
    # the letter behind decides which letter of a run is the one deleted: the last in the word's own order
    once = "IF(way = 0, y, IF(pos = 0, '', substring(text, pos, 1))) <> x"
    follow = move(f"e.letter = x AND (x = '' OR {can.format(p='(pos + 1)')})", "(pos + 1)")
    replace = move(f"e.letter > x AND {can.format(p='(pos + 1)')}", "(pos + 1)")
    delete = move(f"e.letter = y AND {once} AND (y = '' OR {can.format(p='(pos + 2)')})", "(pos + 2)")
    return f"IF(edited, {follow}, concat({replace}, {delete}))"


def _walked(vocabulary: DataFrame, at: str) -> DataFrame:
    """(word, n, near, near_n): words of at most ``TRIE`` letters and their
    neighbours, each pair once. The trie and the levels are stored in ``at``."""
    spark = vocabulary.sparkSession
    short = vocabulary.where(F.length("word").between(1, TRIE))
    both = short.select(F.lit(0).alias("way"), F.col("word").alias("text"), "n").unionByName(
        short.select(F.lit(1).alias("way"), F.reverse("word").alias("text"), "n"))
    # sorted by depth, so a level reads the pages of its depth
    _trie(both).sortWithinPartitions("depth").write.parquet(f"{at}/nodes")
    trie = spark.read.parquet(f"{at}/nodes")
    # forward the edits of the second half, backward those of the first
    middle = F.floor((F.length("text") + F.col("way")) / 2)
    longest = short.agg(F.max(F.length("word"))).first()[0] or 0
    levels = []
    for depth in range(longest + 1):
        states = (both.where((middle <= depth) & (F.length("text") > depth))
                  .select("way", "text", "n", F.substring("text", 1, depth).alias("node"),
                          F.lit(depth).alias("pos"), F.lit(False).alias("edited")))
        if levels:
            states = states.unionByName(spark.read.parquet(levels[-1]).where("near_n IS NULL").drop("near_n")
                                        .withColumn("edited", F.lit(True)))
        moves = (states.join(trie.where(F.col("depth") == depth).drop("depth"), ["way", "node"])
                 .withColumns({"x": _letter(F.col("pos")), "y": _letter(F.col("pos") + 1)})
                 .select("way", "text", "n", "node", F.explode(F.expr(_moves())).alias("to"))
                 .select("way", "text", "n", F.concat("node", "to.letter").alias("node"), "to.pos",
                         F.col("to.n").alias("near_n")))
        levels.append(f"{at}/level{depth}")
        moves.write.parquet(levels[-1])
    if not levels:
        return vocabulary.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n")).limit(0)
    own = lambda c: F.when(F.col("way") == 0, F.col(c)).otherwise(F.reverse(c))
    return (spark.read.parquet(*levels).where("near_n IS NOT NULL")
            .select(own("text").alias("word"), "n", own("node").alias("near"), "near_n"))


def _less_a_letter(batches):
    """(id, size, pos, key) of (id, word): a hash of the word (pos -1) and of
    the word less the letter at each position. It is a sum over the letters,
    so all of them come from running sums."""
    multiplier = 0x9E3779B97F4A7C15
    back = np.uint64(pow(multiplier, -1, 1 << 64))
    for batch in batches:
        for i, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            c = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
            power = np.full(len(c), multiplier, np.uint64)
            power[:1] = 1
            sums = np.append(np.zeros(1, np.uint64), np.cumsum(c * np.cumprod(power)))
            key = np.append(sums[:-1] + (sums[-1] - sums[1:]) * back, sums[-1]).view(np.int64)
            pos = np.append(np.arange(len(c)), -1)
            for lo in range(0, len(key), 4096):
                k, at = key[lo:lo + 4096], pos[lo:lo + 4096]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), i, np.int64)), pa.array(len(c) - (at >= 0)),
                                                  pa.array(at), pa.array(k)], ["id", "size", "pos", "key"])


def _long(vocabulary: DataFrame) -> DataFrame:
    """(word, n, near, near_n): neighbours of which one at least has more than
    ``TRIE`` letters, each pair once."""
    some = cut_lineage(vocabulary.where(F.length("word") >= TRIE).withColumn("id", F.xxhash64("word")))
    keys = some.select("id", "word").mapInArrow(_less_a_letter, "id long, size long, pos long, key long")
    cut, whole = keys.where("pos >= 0"), keys.where("pos < 0")
    # equal but for one place: a group has a word a letter at most
    replaced = (cut.alias("a").join(cut.alias("b"), ["size", "pos", "key"]).where("a.id < b.id")
                .select(F.col("a.id").alias("a"), F.col("b.id").alias("b")))
    deleted = (cut.alias("a").join(whole.alias("b"), ["size", "key"])
               .select(F.col("a.id").alias("a"), F.col("b.id").alias("b")))
    x = some.select(F.col("id").alias("a"), "word", "n")
    y = some.select(F.col("id").alias("b"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return (replaced.unionByName(deleted).distinct().join(x, "a").join(y, "b")
            .where((F.greatest(F.length("word"), F.length("near")) > TRIE)
                   & (F.levenshtein("word", "near", 1) == 1)).drop("a", "b"))


def neighbours(vocabulary: DataFrame, at: str | None = None) -> DataFrame:
    """(word, n, near, near_n) of ``vocabulary`` (word, n): all pairs of words
    that differ by one inserted, deleted or replaced letter, both ways round.
    The empty word and null are no one's neighbour; words are distinct; an
    empty table gives an empty result. The trie and its levels are stored in
    ``at`` (else a new folder of the shared store) while the frame is built;
    the frame reads them, so the caller removes them after it."""
    once = _walked(vocabulary, at or scratch_path(vocabulary.sparkSession, "trie")).unionByName(_long(vocabulary))
    other = F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"),
                     F.col("n").alias("near_n"))
    return (once.select(F.explode(F.array(F.struct("word", "n", "near", "near_n"), other)).alias("p"))
            .select("p.word", "p.n", "p.near", "p.near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form): where the forms lead from each
    word. A step doubles the length of the way, and forms grow in n by
    ``TIMES`` each, so there are few steps."""
    p = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        q = p.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        p = cut_lineage(p.join(q, "root", "left")
                        .select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        if p.where("moved").isEmpty():
            return p.drop("moved")
        p = p.drop("moved")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop: int = DROP,
             min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, times: int = TIMES) -> DataFrame:
    """(word, form, root string; n, n_near, form_n long): a row a word of
    :func:`words`. The form of a word is its neighbour with the largest n (of
    equal ones the smallest in code-point order) if that is at least ``times``
    the word's n, else null; the root is where the forms lead, the word itself
    without one; ``n_near`` counts its neighbours. ``times`` above 1 keeps forms
    from going in circles. Empty tables and texts without words give no rows."""
    vocabulary = cut_lineage(words(docs, id_col, text_col, drop, min_length, min_count))
    at = scratch_path(docs.sparkSession, "trie")
    near = cut_lineage(neighbours(vocabulary, at).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")))
    drop_folder(docs.sparkSession, at)
    found = vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("best.less") >= times * F.col("n"), F.col("best")).alias("best"))
    formed = found.where("best IS NOT NULL").select("word", F.col("best.near").alias("form"))
    return (found.join(roots(formed), "word", "left")
            .select("word", F.col("best.near").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near",
                    (-F.col("best.less")).alias("form_n")))
