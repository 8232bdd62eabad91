"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from tillroll.llm import decontaminate, lines, mixing, quality, sharding, simhash, spotsigs, substring, tokens, urls
from tillroll.llm.queries import RULES, tokenizer_path

#: Names that the operators use inside.
CLASHING = ["id", "fp", "node", "part", "tail", "hash", "key", "h", "pos", "size", "target", "copies", "t", "window",
            "slice", "cell", "shard", "n_bytes", "lines", "gone", "kept", "doc", "item", "block", "host", "found",
            "__rank", "__id", "component_id", "expected_grade", "signatures", "n_words", "grade"]
LONG = " ".join(f"w{i % 977} v{i % 13}" for i in range(60_000))
COPY = "the cat sat on the mat and the dog lay by the door of the old house in the town\nline two\nline three\nline four"
ROWS = [(3, None, "a"), (1, "", "a"), (1, "", "a"), (None, COPY, None), (None, None, None), (7, COPY, None),
        (8, COPY, "null"), (8, COPY, "null"), (9, " \t\n ", "b"), (10, LONG, "b"), (11, LONG, "b"), (12, "one", ""),
        (13, "\u00c9t\u00e9 \U0001f600 \u4e2d\u6587", "c"), (14, "a\x00b", "c")]


def table(spark, rows):
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(*r, *["x"] * len(CLASHING)) for r in rows], schema)


@pytest.fixture(scope="module")
def df(spark):
    return table(spark, ROWS)


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


def by_id(rows):
    out = {}
    for r in rows:
        out.setdefault(r["doc_id"], []).append(r)
    return out


def test_simhash(df, none):
    got = by_id(simhash.near_duplicates(df).collect())
    assert sum(map(len, got.values())) == len(ROWS)
    blank = [r for i in (3, 1, 9) for r in got[i]]
    assert {(r["fingerprint"], r["component_id"]) for r in blank} == {("0" * 16, 1)}
    assert {r["component_id"] for i in (7, 8) for r in got[i]} == {7}
    assert {r["component_id"] for r in got[None]} == {1, 7}
    assert {r["component_id"] for i in (10, 11) for r in got[i]} == {10}
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, -1, 1, 1, 7, 10, 12, 13, 14]
    assert simhash.near_duplicates(none).collect() == [] == simhash.drop_near_duplicates(none).collect()


def test_one_row_of_each_simhash_group_stays(spark, df, none):
    import corpus_pipeline as P
    other, alone = (" ".join(f"{w}{i}" for i in range(40)) for w in ("other", "alone"))
    rows = [*ROWS, (None, other, "d"), (None, other, "d"), (20, COPY, "d"), (20, alone, "d"), (20, alone, "d"),
            (1, LONG[:2_000], "d")]
    kept = simhash.keep_one_a_group(table(spark, rows))
    assert kept.columns == df.columns
    want = sorted([(1, ""), (7, COPY), (10, LONG), (12, "one"), (13, ROWS[12][1]), (14, "a\x00b"), (None, other),
                   (20, alone), (1, LONG[:2_000])], key=str)
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == want
    assert simhash.keep_one_a_group(none).collect() == []
    docs = table(spark, rows).withColumns({"lang": F.lit("en"), "n_chars": F.lit(1)})
    got = P.simhash_near_dedup(spark, docs, "").collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == want


def test_simhash_of_null_ids_only(spark):
    got = simhash.near_duplicates(table(spark, [(None, COPY, "a"), (None, COPY, "a")])).collect()
    assert [r["component_id"] for r in got] == [None, None]


def test_mix(df, none):
    got = mixing.mix_report(df).collect()
    assert len(got) == len(ROWS) and mixing.mix_report(none).collect() == []
    assert all(r["copies"] in (0, 1, 2) and r["taken"] == r["size"] * r["copies"] for r in got)
    assert sorted(mixing.mix_report(df).collect(), key=str) == sorted(got, key=str)
    rows = mixing.mix(df)
    assert rows.columns == df.columns and rows.count() == sum(r["copies"] for r in got)
    assert mixing.mix(none).collect() == []


def test_tokens(df, none):
    manifest = tokens.write_tokens(df, tokenizer_path())
    got = tokens.read_documents(manifest).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, 1, 1, 3, 7, 8, 8, 9, 10, 11, 12, 13, 14]
    assert [r["n_tokens"] for r in got][2:5] == [1, 1, 1]
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:]))
    tokens.drop_files(manifest)
    empty = tokens.write_tokens(none, tokenizer_path())
    assert empty.collect() == [] == tokens.read_documents(empty).collect()


def test_substrings(df, none):
    got = by_id(substring.dedup(df).collect())
    assert sum(map(len, got.values())) == len(ROWS)
    assert [(r["n_words"], r["n_removed"]) for r in got[None]].count((0, 0)) == 1
    assert all(r["n_removed"] == 0 for r in got[None] + got[7] + got[10])
    assert all(r["n_removed"] == r["n_words"] > 13 and r["kept_text"] == "" for r in got[8] + got[11])
    assert (got[1][0]["n_words"], got[3][0]["kept_text"], got[9][0]["kept_text"]) == (0, "", "")
    assert substring.dedup(none).collect() == []


def test_spotsigs(df, none):
    got = spotsigs.edit_report(df).collect()
    assert len(got) == len(ROWS) and spotsigs.edit_report(none).collect() == []
    assert sorted(spotsigs.edit_report(df, per_part=1).collect(), key=str) == sorted(got, key=str)
    same = {r["fingerprint"] for r in got if r["doc_id"] in (7, 8)}
    assert len(same) == 1
    classes = spotsigs.near_duplicates(df).collect()
    assert len(classes) == len(ROWS) and spotsigs.near_duplicates(none).collect() == []
    one = spotsigs.edit_report(df.where("doc_id = 12")).collect()
    assert [(r["n_chars"], r["near_next"]) for r in one] == [(3, 1.0)]


def test_spotsigs_null_id_links_others(spark):
    def text(changed):
        return " ".join(f"the {'y' if i in changed else 'x'}{i} z{i}" for i in range(60))
    rows = [(1, text(()), "a"), (None, text(range(6)), "a"), (3, text(range(12)), "a"), (None, "only one here", "a")]
    got = by_id(spotsigs.near_duplicates(table(spark, rows)).collect())
    assert [(r["component_id"], r["n_links"]) for i in (1, 3) for r in got[i]] == [(1, 1), (1, 1)]
    assert sorted((str(r["component_id"]), r["n_links"]) for r in got[None]) == [("1", 2), ("None", 0)]


def test_leaks(spark, df, none):
    items = spark.createDataFrame([(1, COPY), (1, COPY), (2, None), (3, "short")], "item_id long, text string")
    got = by_id(decontaminate.leaks(df, items).collect())
    assert set(got) == {None, 7, 8} and {r["item"] for v in got.values() for r in v} == {1}
    kept = decontaminate.drop_leaked(df, items)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 1, 3, 9, 10, 11, 12, 13, 14]
    assert decontaminate.leaks(none, items).collect() == []
    assert decontaminate.leaks(df, items.where("item_id > 9")).collect() == []
    assert decontaminate.drop_leaked(df, items.where("item_id > 9")).count() == len(ROWS)


def test_leaked_rows_go_by_their_own_text(spark, df, none, monkeypatch):
    import corpus_pipeline as P
    items = spark.createDataFrame([(1, COPY), (2, None)], "item_id long, text string")
    rows = [*ROWS, (20, COPY, "d"), (20, "a clean text under the id of a leak", "d"), (None, "clean, no id", "d")]
    kept = decontaminate.drop_leaked_rows(table(spark, rows), items)
    assert kept.columns == df.columns
    want = sorted(((r[0], r[1]) for r in rows if r[1] != COPY), key=str)
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == want
    assert decontaminate.drop_leaked_rows(none, items).collect() == []
    assert decontaminate.drop_leaked_rows(df, items.where("item_id > 9")).count() == len(ROWS)
    docs = table(spark, rows).withColumns({"lang": F.lit("en"), "n_chars": F.lit(1)})
    monkeypatch.setattr(P, "read_table", lambda *_: items)
    got = P.benchmark_decontamination(spark, docs, "").collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == want


def test_leaks_of_a_benchmark_too_large_to_broadcast(df, spark, monkeypatch):
    items = spark.createDataFrame([(1, COPY)], "item_id long, text string")
    want = sorted(decontaminate.leaks(df, items).collect(), key=str)
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", 0)
    assert sorted(decontaminate.leaks(df, items).collect(), key=str) == want


def test_quality(spark, df, none):
    ratings = spark.createDataFrame([(7, 2), (8, 2), (10, 0), (11, 0), (3, 1), (None, 1), (99, 2), (12, None), (13, 9)],
                                    "doc_id long, grade int")
    model = quality.fit(df, ratings, bits=10, steps=10)
    scored = quality.score(df, model)
    assert scored.count() == len(ROWS) and scored.columns.count("expected_grade") == 1
    got = by_id(scored.select("doc_id", "tail_probability").collect())
    assert got[7][0]["tail_probability"] > got[10][0]["tail_probability"]
    assert quality.score(none, model).collect() == []
    blank = quality.fit(none, ratings, bits=10)
    assert not blank.weights.any() and quality.score(df, blank).count() == len(ROWS)
    assert not quality.fit(df, ratings.where("grade = 2"), bits=10).weights.any()


def test_quality_without_fitting_labels_keeps_all(spark, df, monkeypatch):
    import corpus_pipeline as P
    docs = df.withColumns({"lang": F.lit("en"), "n_chars": F.lit(1)})
    for labels in ([], [(99, 1, 0)], [(7, 0, 0)]):  # none, none of these documents, one grade only
        frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        monkeypatch.setattr(P, "read_table", lambda *_: frame)
        assert P.quality_classifier(spark, docs, "").count() == len(ROWS)


def test_quality_sample_holds_known_documents(spark, df):
    unknown = [(i, 2) for i in range(100, 300)]
    ratings = spark.createDataFrame([(7, 2), (8, 2), (10, 0), (11, 0), *unknown], "doc_id long, grade int")
    assert quality.fit(df, ratings, bits=10, steps=10, sample=4).weights.any()


def test_lines(df, none):
    got = by_id(lines.dedup_lines(df).collect())
    assert sum(map(len, got.values())) == len(ROWS)
    assert got[3][0]["kept_text"] is None and got[3][0]["n_lines"] == 0 and got[1][0]["n_lines"] == 1
    assert all(r["n_removed"] == 0 for r in got[None] + got[7])
    assert all(r["n_removed"] == 4 for r in got[8])
    assert lines.dedup_lines(none).collect() == []


def test_lines_of_long_texts(spark):
    n = 60_000
    text = "\n".join(f"line {i}" for i in range(n))
    got = by_id(lines.dedup_lines(table(spark, [(1, text, "a"), (2, "own\n" + text, "a")])).collect())
    assert (got[1][0]["n_removed"], got[2][0]["n_removed"], got[2][0]["kept_text"]) == (0, n, "own")


def test_lines_of_one_id_and_of_blank_texts(spark):
    """Texts of unlike length under one id, blank lines only, one very long line and many blank ones."""
    same = "this line has more than five words"
    rows = [(1, same, "a"), (2, same + "\nx\n" + same, "a"), (2, same, "a"), (3, "\n\n", "a"), (4, "\n" * 100_000, "a"),
            (5, "w " * 100_000, "a"), (6, "w " * 100_000, "a"), (7, "\n" * 50_000 + same, "a")]
    got = {}
    for r in lines.dedup_lines(table(spark, rows)).collect():
        got.setdefault(r["doc_id"], []).append((r["n_removed"], r["kept_text"] if len(r["kept_text"]) < 99 else "long"))
    assert got == {1: [(0, same)], 2: [(2, "x"), (1, "")] if len(got[2][0][1]) else [(1, ""), (2, "x")], 3: [(0, "\n\n")],
                   4: [(0, "long")], 5: [(0, "long")], 6: [(1, "")], 7: [(1, "long")]}


def test_shards(df, none):
    got = sharding.shards(df, limit=200).collect()
    assert len(got) == len(ROWS) and sharding.shards(none).collect() == []
    size = {}
    for r in got:
        size.setdefault(r["shard"], []).append(r["n_bytes"])
    assert all(sum(v) <= 200 or max(v) > 200 and sum(1 for x in v if x) == 1 for v in size.values())


def test_shards_of_repeated_ids(spark):
    rows = [(5, f"{i:03d} " + "x" * 60, "a") for i in range(40)] + [(None, "y" * 90, "a")] * 6 + [(6, "z" * 500, "a")]
    got = sharding.shards(table(spark, rows), limit=300).collect()
    size = {}
    for r in got:
        size.setdefault(r["shard"], []).append(r["n_bytes"])
    assert sum(map(len, size.values())) == len(rows)
    assert all(sum(v) <= 300 or v == [500] for v in size.values())


def test_urls(spark):
    rows = [(1, None), (1, None), (None, "http://a.org/"), (2, "no scheme"), (3, "http://x.net/" + "a" * 50_000),
            (4, "http://b.com/de/"), (5, "http://b.com/de/")]
    schema = "page_id long, url string, host string, path string, rule string, block string, features string"
    df = spark.createDataFrame([(*r, *["x"] * 5) for r in rows], schema)
    got = urls.judge(df, RULES).collect()
    assert len(got) == len(rows) and all(r["verdict"] in ("allow", "block") for r in got)
    assert {(r["host"], r["path"], r["rule"]) for r in got if r["page_id"] in (1, 2)} == {("", "", None)}
    assert urls.judge(df.limit(0), RULES).collect() == []
    assert {r["verdict"] for r in urls.judge(df.where("page_id < 4"), RULES).collect()} == {"allow"}
