"""Line dedup by winnowing, DataFrame functions only.

A passage is a run of lines, blank ones passed over. The lines of a run that
stands earlier (in a smaller id, or before in the same text) go if the run has
``words`` words or more, however few lines that are: one long line, or short
ones in a row.

Lines are hashed. From each line on, the lines up to the one that completes the
words make a window, and so do the lines back from it: every run of enough
words is made of such windows, the last of a run too. A window selects its line
with the smallest hash as its fingerprint, so runs that are equal have equal
fingerprints, and windows whose fingerprint was selected at one place only are
dropped. The others meet by fingerprint and whole content, and the first place
of each keeps it. A match goes on both ways as the windows beside it match in
turn; a run's lines are those of its windows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import WORD

#: Words of the shortest run that goes. Also the most lines of a window.
WORDS = 5


def _split(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, text, lines, items): all lines, and of those that are not blank the
    position (at), hash (h) and number of words (n, ``words`` at most). One
    pass over the lines: nothing inside looks a line up by its number."""
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    items = F.filter(F.transform(lines, lambda x, i: F.struct(
        i.alias("at"), F.xxhash64(F.trim(x)).alias("h"), F.least(F.regexp_count(x, F.lit(WORD)), F.lit(words)).alias("n"))),
        lambda s: s["n"] > 0)
    return (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
            .select("id", "text", lines.alias("lines"), items.alias("items")))


def _reach(first: Column, step: int, words: int) -> Column:
    """How many lines from ``first`` on (or back) hold ``words`` words; null if
    the text ends before."""
    sums = [F.coalesce(F.when(first + step * k >= 0, F.get("items", first + step * k)["n"]), F.lit(0)) for k in range(words)]
    total = [reduce(lambda x, y: x + y, sums[:k + 1]) for k in range(words)]
    return F.coalesce(*[F.when(t >= words, F.lit(k + 1)) for k, t in enumerate(total)])


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  words: int = WORDS) -> DataFrame:
    """(id long, start, size int): windows of a document whose lines stand
    earlier, as the number of their first line (blank ones not counted) and
    their number of lines."""
    i, start, size = F.col("i"), F.col("start"), F.col("size")
    lines = (_split(docs, id_col, text_col, words).where(F.col("id").isNotNull()).select("id", "items")
             .select("id", "items", F.posexplode("items").alias("i", "item")).drop("item"))
    reached = lines.withColumns({"on": _reach(i, 1, words), "back": _reach(i, -1, words)})
    # a window back is another one than that from its first line on if the words are complete before its last line
    before = _reach(F.col("w.start"), 1, words)
    each = F.array(F.struct(i.alias("start"), F.col("on").alias("size"), F.lit(True).alias("on")),
                   F.struct((i - F.col("back") + 1).alias("start"), F.col("back").alias("size"), F.lit(False).alias("on")))
    windows = (reached.select("id", "items", F.explode(each).alias("w")).where("w.size IS NOT NULL")
               .where(F.col("w.on") | (before < F.col("w.size"))).select("id", "items", "w.start", "w.size"))
    held = [F.when(size > k, F.get("items", start + k)["h"]) for k in range(words)]
    low = F.least(*held) if words > 1 else held[0]
    # the selected place: the first line of the window with its smallest hash
    place = start + F.coalesce(*[F.when(x == F.col("fp"), F.lit(k)) for k, x in enumerate(held)])
    keyed = windows.withColumn("fp", low).select("id", "start", "size", "fp", place.alias("place"),
                                                 F.xxhash64(size, *held).alias("content"))
    # one row a selected place; fingerprints of one place only are dropped
    shared = (keyed.groupBy("fp").agg(F.min(F.struct("id", "place")).alias("a"), F.max(F.struct("id", "place")).alias("b"))
              .where("a != b").select("fp"))
    # stored: two passes follow, and the texts need not be taken apart for each
    near = cut_lineage(keyed.join(shared, "fp", "left_semi").select("id", "start", "size", "fp", "content"))
    first = (near.groupBy("fp", "content").agg(F.min(F.struct("id", "start")).alias("first"), F.count("*").alias("places"))
             .where("places > 1").select("fp", "content", "first"))
    return (near.join(first, ["fp", "content"])
            .where(F.struct("id", "start") > F.col("first")).select("id", "start", "size"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                words: int = WORDS) -> DataFrame:
    """(id_col long, n_lines, n_removed long, kept_text), a row a row of ``docs``.

    Lines end at a line feed and are compared without the spaces at their
    ends. A line without a word is blank: it parts no run, and goes with the
    line before it (one that leads a text stays). A null text has no lines and
    stays null; an empty text has one. Rows with a null id are kept whole and
    take nothing from others; rows with one id are one document, whose lines
    with one number share their fate, and repeated rows are not repeats of each
    other. Other columns are ignored; an empty table gives an empty result."""
    runs = repeated_runs(docs, id_col, text_col, words)
    gone = (runs.groupBy("id").agg(F.collect_set(F.struct("start", "size")).alias("runs"))
            .select("id", F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(
                r["start"], r["start"] + r["size"] - 1)))).alias("gone")))
    # each line with the blank ones behind it; a number that another text of this id has may be beyond this one's end
    last = F.size("lines") - 1
    with_blanks = F.flatten(F.transform(F.filter("gone", lambda k: k < F.size("items")), lambda k: F.sequence(
        F.get("items", k)["at"], F.coalesce(F.get("items", k + 1)["at"] - 1, last))))
    # a set difference of positions: its cost grows with the lines, not with lines times removed lines
    kept = F.transform(F.array_except(F.sequence(F.lit(0), last), with_blanks), lambda i: F.get("lines", i))
    return (_split(docs, id_col, text_col, words).join(gone, "id", "left")
            .withColumn("kept", F.when(F.col("gone").isNull(), F.col("lines")).otherwise(kept))
            .select(F.col("id").alias(id_col),
                    F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
                    (F.size("lines") - F.size("kept")).cast("long").alias("n_removed"),
                    F.when(F.col("text").isNotNull(), F.array_join("kept", "\n")).alias("kept_text")))
