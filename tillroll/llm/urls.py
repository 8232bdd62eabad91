"""URL filter: host and path rules, then gradient-boosted trees.

A rule (verdict, host, path) fits its host and all subdomains where the url's
path starts with the rule's; the longest wins. URLs without a rule are judged
by trees on lexical features, trained from labelled URLs: given ones, or those
that a list of words in hosts labels. The rules take no part in the training,
since they say what is wanted and not what a URL looks like. DataFrame
functions and Spark's own tree learner only.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Most labelled URLs that the trees are fitted on, half of them of each class.
SAMPLE = 20_000
FEATURES = ["url_length", "host_length", "path_length", "depth", "labels", "digit_share", "entropy",
            "parameters", "hyphens", "host_hyphens", "host_digits", "escapes", "fragment",
            "suffix_share", "suffix_block"]
#: Labelled URLs that a suffix's block rate is smoothed with.
SMOOTH = 20.0
#: Most frequent suffixes whose statistics are broadcast; rarer ones are joined by shuffle.
BROADCAST_SUFFIXES = 10_000
#: Words of hosts that are commonly blocked: gambling, adult, drugs, advertising, spam.
BLOCK_WORDS = """ad ads adult adserver adware bet bets betting bingo casino clickbait dating escort gamble gambling
    jackpot malware nude phishing pharma pharmacy pill pills poker popup porn roulette sex slots spam spyware
    tracker tracking viagra warez xxx""".split()


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0),
                                  string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))


def rule_of(rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule that fits columns ``host`` and ``path``: struct(rule,
    verdict) or null. The plan grows with the rules."""
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = lambda h, p: ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    return F.coalesce(*[F.when(fits(h, p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
                        for v, h, p in order], none)


def word_labels(urls: DataFrame, words: Sequence[str] = BLOCK_WORDS) -> DataFrame:
    """``urls`` (url, host, path, ...) with ``blocked``: 1 where one of the
    host's words (parted by dots and hyphens) is among ``words``, 0 for other
    hosts, null without a host. The trees see no words, only their features, so
    they go beyond the list."""
    listed = F.arrays_overlap(F.split("host", r"[.\-]"), F.array(*[F.lit(w) for w in words]))
    return urls.withColumn("blocked", F.when(F.col("host") != "", listed.cast("int")))


def suffix(host: Column) -> Column:
    """The host's last label."""
    return F.substring_index(host, ".", -1)


def lexical(urls: DataFrame) -> DataFrame:
    """``urls`` (url, host, path, ...) with the lexical features and ``suffix``,
    the host's last label."""
    url, n = F.coalesce("url", F.lit("")), F.greatest(F.length(F.coalesce("url", F.lit(""))), F.lit(1))
    count = lambda pattern: F.regexp_count(url, F.lit(pattern)).cast("double")
    chars = F.array_sort(F.split(url, ""))
    # runs of the sorted characters: entropy = log2(n) - sum(c log2 c) / n
    runs = F.regexp_extract_all(F.array_join(chars, ""), F.lit(r"((?s:.))\1*"), F.lit(0))
    spread = F.aggregate(runs, F.lit(0.0), lambda s, r: s + F.length(r) * F.log2(F.length(r).cast("double")))
    return urls.withColumns({
        "url_length": F.length(url).cast("double"), "host_length": F.length("host").cast("double"),
        "path_length": F.length("path").cast("double"), "depth": F.regexp_count("path", F.lit("/")).cast("double"),
        "labels": F.regexp_count("host", F.lit(r"\.")).cast("double"), "digit_share": count("[0-9]") / n,
        "entropy": F.when(F.length(url) > 0, F.log2(n.cast("double")) - spread / n).otherwise(0.0),
        "parameters": count("[?&][^=&#]*="), "hyphens": count("-"), "escapes": count("%"), "fragment": count("#"),
        "host_hyphens": F.regexp_count("host", F.lit("-")).cast("double"),
        "host_digits": F.regexp_count("host", F.lit("[0-9]")).cast("double"), "suffix": suffix(F.col("host"))})


class UrlModel:
    """Trees and suffix statistics (suffix, n, share, block); ``trees`` is None
    where the labels have one class or none, and ``rate`` is then the answer
    for all."""

    def __init__(self, trees: GBTClassificationModel | None, rate: float, suffixes: DataFrame | None = None):
        self.trees, self.rate, self.suffixes = trees, rate, suffixes

    def featured(self, urls: DataFrame) -> DataFrame:
        stats = self.suffixes.select(F.col("suffix"), F.col("share").alias("__share"), F.col("block").alias("__block"))
        made = lexical(urls)
        if stats.limit(BROADCAST_SUFFIXES + 1).count() <= BROADCAST_SUFFIXES:
            made = made.join(F.broadcast(stats), "suffix", "left")
        else:  # a suffix beyond the most frequent ones has few rows, so the shuffle has no hot key
            top = (self.suffixes.orderBy(F.desc("n"), "suffix").limit(BROADCAST_SUFFIXES)
                   .select("suffix", F.col("share").alias("__share"), F.col("block").alias("__block")))
            near = made.join(F.broadcast(top), "suffix", "left")
            made = near.where("__share is not null").unionByName(
                near.where("__share is null").drop("__share", "__block").join(stats, "suffix", "left"))
        made = made.withColumns({"suffix_share": F.coalesce("__share", F.lit(0.0)),
                                 "suffix_block": F.coalesce("__block", F.lit(self.rate))})
        return VectorAssembler(inputCols=FEATURES, outputCol="__features").transform(made)

    def block_probability(self, urls: DataFrame) -> DataFrame:
        """``urls`` (url, host, path, ...) with ``block``, a probability."""
        if self.trees is None:
            return urls.withColumn("block", F.lit(self.rate))
        return (self.trees.transform(self.featured(urls))
                .withColumn("block", vector_to_array("__probability")[1]).select(*urls.columns, "block"))


def fit(labelled: DataFrame, sample: int = SAMPLE, trees: int = 20, depth: int = 4, seed: int = 42) -> UrlModel:
    """Fit on labelled URLs (url, host, path, blocked int); rows without a label
    are left out. Suffix statistics are over all of them. The trees read at
    most ``sample`` / 2 of each class, those with the lowest MD5s, weighted to
    the class's share of all labels."""
    rows = labelled.where(F.col("blocked").isNotNull()).select("url", "host", "path", "blocked")
    sums = cut_lineage(rows.groupBy(suffix(F.col("host")).alias("suffix"))
                       .agg(F.count("*").alias("n"), F.sum("blocked").alias("b")))
    n, b = sums.agg(F.sum("n"), F.sum("b")).first()
    if not n:
        return UrlModel(None, 0.0)
    rate = b / n
    model = UrlModel(None, rate, cut_lineage(sums.select(
        "suffix", "n", (F.col("n") / n).alias("share"), ((F.col("b") + SMOOTH * rate) / (F.col("n") + SMOOTH)).alias("block"))))
    if b in (0, n):
        return model
    digest = F.md5(F.coalesce("url", F.lit("")))
    place = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / (1 << 32)
    half = sample // 2

    def taken(label: int, total: int) -> DataFrame:
        # twice as many as asked for go to the sort, not all rows
        few = rows.where((F.col("blocked") == label) & (place < min(1.0, 2.0 * half / total) + 1e-3))
        return few.orderBy(digest, "url").limit(half).withColumn("__weight", F.lit(total / min(total, half)))
    train = cut_lineage(taken(0, n - b).unionByName(taken(1, b)))  # `sample` rows at most
    learner = GBTClassifier(featuresCol="__features", labelCol="__label", predictionCol="__prediction",
                            weightCol="__weight", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=seed)
    learner.setProbabilityCol("__probability").setRawPredictionCol("__raw")
    model.trees = learner.fit(model.featured(train).select(
        "__features", "__weight", F.col("blocked").cast("double").alias("__label")))
    return model


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], model: UrlModel | None = None,
          id_col: str = "page_id", url_col: str = "url", sample: int = SAMPLE) -> DataFrame:
    """(id_col, host, path, rule, verdict, block), a row a row of ``pages``:
    verdict is the rule's or, without one, ``block`` where the trees give a
    probability of one half or more, else ``allow``. Without a ``model`` the
    trees are trained from all of these URLs, labelled by ``word_labels``.

    A null url, or one without ``://``, has an empty host and path and no rule
    or label. Repeated rows are judged alike; where no host has a blocked word
    all others are allowed; an empty table gives an empty result; other columns
    are ignored."""
    parts = (pages.select(F.col(id_col).alias("__id"), F.col(url_col).cast("string").alias("url"))
             .withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
             .withColumn("found", rule_of(rules)))
    if model is None:
        model = fit(word_labels(parts), sample)
    return (model.block_probability(parts)
            .select(F.col("__id").alias(id_col), "host", "path", F.col("found.rule").alias("rule"),
                    F.coalesce("found.verdict", F.when(F.col("block") >= 0.5, "block").otherwise("allow")).alias("verdict"),
                    "block"))
