"""Spelling variants, personal data and importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__ as E
from tillroll.llm import importance, pii, variants

SF = "/root/testdata/sf0.001"
CLASHING = ["id", "run", "word", "h", "n", "text1", "way", "node", "pos", "edges", "near", "root", "form", "spans", "kind",
            "bucket", "n_words", "weight", "score", "rank", "__row", "__part", "x", "y", "size", "key", "a", "b"]


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def table(spark, rows):
    schema = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(*r, *["x"] * len(CLASHING)) for r in rows], schema)


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def brute_words(rows, min_length=5, min_count=3):
    n = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-z\u00C0-\u00FF]+", t or ""):
            w = low(w)
            h = zlib.crc32(f"{'null' if i is None else i}:{w}".encode())
            n[w[:h % len(w)] + w[h % len(w) + 1:] if h % 97 == 0 else w] += 1
    return {w: c for w, c in n.items() if len(w) >= min_length and c >= min_count}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(n):
    near = defaultdict(list)
    for a in n:
        for b in n:
            if abs(len(a) - len(b)) < 2 and one_edit(a, b):
                near[a].append(b)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w
    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def got_variants(df):
    rows = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_variants_of_whole_table(spark, docs):
    assert got_variants(E.queries()["op11_spelling_variants"](spark, SF)) == brute_variants(brute_words(docs))


def test_variants_of_dense_words(spark):
    """Words over two letters of 1 to 8 letters: nearly every edit is a word."""
    rng = random.Random(3)
    words = {"".join(rng.choice("ab\u00e9") for _ in range(rng.randint(1, 8))): rng.randint(1, 99) for _ in range(250)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = Counter((r["word"], r["n"], r["near"], r["near_n"]) for r in variants.neighbours(df).collect())
    want = Counter((a, words[a], b, words[b]) for a in words for b in words if a != b and one_edit(a, b))
    assert got == want


def test_variants_of_long_words(spark):
    """Around and beyond the longest word of the trie, with runs of one letter."""
    base = ["a" * n for n in (38, 39, 40, 41, 42, 300)] + ["ab" * 20, "ab" * 21, "x" * 5000, "x" * 2500 + "y" + "x" * 2500]
    words = set(base)
    for w in base:
        k = len(w) // 3
        words |= {w[:k] + "q" + w[k:], w[:k] + "q" + w[k + 1:], w[:k] + w[k + 1:], w[1:], w + "z", w[:-1] + "z"}
    df = spark.createDataFrame([(w, i + 1) for i, w in enumerate(sorted(words))], "word string, n long")
    got = Counter((r["word"], r["near"]) for r in variants.neighbours(df).collect())

    def near(a, b):  # as one_edit, for long words
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        a, b = sorted((a, b), key=len)
        k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
        return a[k + (len(a) == len(b)):] == b[k + 1:]
    assert got == Counter((a, b) for a in words for b in words if near(a, b))


def test_variants_edges(spark):
    rows = [(None, None), (1, ""), (1, ""), (2, "12 ! \u4e2d"), (3, "House house HOUSE mouse mouse mouse mouse mouse mouse"),
            (3, "House house HOUSE mouse mouse mouse mouse mouse mouse"), (None, "mouses mouses mouses \u00c9T\u00c9S\u00c9 " * 3),
            (9, "abcdefgh " * 40_000)]
    got = got_variants(variants.variants(table(spark, rows)))
    assert got == brute_variants(brute_words(rows)) and got["house"][:2] == ("mouse", "mouse")
    assert variants.variants(table(spark, [])).collect() == []
    assert variants.variants(table(spark, rows[:4])).collect() == []


def test_roots_follow_long_chains(spark):
    n = 37
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(n)] + [("a", "b")], "word string, form string")
    assert {r["word"]: r["root"] for r in variants.roots(forms).collect()} == {
        **{f"w{i}": f"w{n}" for i in range(n)}, "a": "b"}


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_luhn(digits):
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def brute_base(text):
    out = {}
    for kind, p in PATTERNS.items():
        out[kind] = []
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and max(map(int, m[0].split("."))) <= 255
                    or kind == "card" and 16 <= len(digits) <= 19 and brute_luhn(digits)
                    or kind == "phone" and 8 <= len(digits) <= 15):
                out[kind].append(m.span())
    return out


def brute_list(found):
    return ",".join(f"{k}:{s}:{e}" for k in found for s, e in found[k])


def test_pii_of_whole_tables(spark, docs):
    got = {r["doc_id"]: r for r in E.queries()["op12_pii"](spark, SF).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        base = brute_base(t)
        assert [got[i][f"n_{k}"] for k in base] == [len(v) for v in base.values()]
        assert got[i]["base_sha256"] == hashlib.sha256(brute_list(base).encode()).hexdigest()
        spans = got[i]["spans"].split(",") if got[i]["spans"] else []
        assert set(filter(None, brute_list(base).split(","))) <= set(spans)
        parts = [(pii.KINDS.index(x.split(":")[0]), *map(int, x.split(":")[1:])) for x in spans]
        assert parts == sorted(parts) and all(0 <= s < e <= len(t) for _, s, e in parts)


def test_pii_base_entries_of_random_texts():
    rng, finder = random.Random(1), pii.Finder()
    pieces = ["0", "1", "5", "255", "256", "0255", ".", "..", "@", "+", " ", "-", "(", ")", "a", "b.c", "%", "_", "\u00e9", "\U0001f600",
              "4929348385146306", "\n", "+1 ", "4111 1111 1111 1111", "x@y.z", "mailto:", "://", "token = ", " [at] ", " [dot] ",
              "iban: ", "\u0661", "\x00"]
    for _ in range(40_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 24)))
        found = finder(text)
        assert {k: [(s, e) for s, e, b in found[k] if b] for k in pii.BASE} == brute_base(text), text


@pytest.mark.parametrize("text,kind,entry", [
    ("write to john.doe [at] example (dot) org now", "email", "john.doe [at] example (dot) org"),
    ("see https://bob:pw@host.org/x.", "url", "https://bob:pw@host.org/x"),
    ("(http://x.org/~ann/)", "url", "http://x.org/~ann/"),
    ("IBAN: DE89 3704 0044 0532 0130 00 thanks", "account", "DE89 3704 0044 0532 0130 00"),
    ("my password is: hunter22 ok", "account", "hunter22"),
    ('TOKEN = "1EB9C654E721B4F8"!! x', "account", "1EB9C654E721B4F8"),
    ("accountant: 50000 apples", None, ""), ("IBAN: DE88 3704 0044 0532 0130 00", None, ""),
    ("the token of thanks, and https://example.org/a/b", None, ""), ("account: nobody", None, "")])
def test_pii_added_entries(text, kind, entry):
    found = {k: [text[s:e] for s, e, _ in v] for k, v in pii.Finder()(text).items() if k in ("url", "account") or k == kind}
    assert {k: v for k, v in found.items() if v} == ({kind: [entry]} if kind else {})


def test_pii_edges(spark):
    rows = [(None, None), (1, ""), (1, ""), (None, "a@b.c"), (4, "\u4e2d\U0001f600a@b.c"), (5, "1." * 60_000), (6, "7" * 120_000),
            (7, "x@" * 60_000), (8, "a://" * 30_000), (9, "+" + "1(" * 60_000), (10, "0" * 5000 + ".1.1.1")]
    df = table(spark, rows)
    got = sorted(pii.report(df).collect(), key=str)
    want = []
    for i, t in rows:
        base = brute_base(t) if i != 10 else {"email": [], "ip": [(0, 5006)], "card": [], "phone": []}
        want.append((i, *map(len, base.values()), hashlib.sha256(brute_list(base).encode()).hexdigest()))
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)
    found = {(r["doc_id"], r["text"]): [(s["kind"], s["start"], s["end"], s["base"]) for s in r["spans"]]
             for r in pii.find(df.where("text LIKE '%a@b.c' OR text IS NULL OR text = ''")).collect()}
    assert found == {(None, None): [], (1, ""): [], (None, "a@b.c"): [("email", 0, 5, True)],
                     (4, "\u4e2d\U0001f600a@b.c"): [("email", 2, 7, True)]}
    masked = {r["doc_id"]: r["text"] for r in pii.mask(df.where("doc_id = 4 OR text IS NULL")).collect()}
    assert masked == {None: None, 4: "\u4e2d\U0001f600<email>"}
    none = table(spark, [])
    assert pii.report(none).collect() == [] == pii.find(none).collect() == pii.mask(none).collect()


def test_span_crc():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 60_000).astype(np.uint8)
    starts = rng.integers(0, 30_000, 1500)
    lengths = np.concatenate([np.arange(1, 601), rng.integers(1, 200, 890), [1024, 1025, 4096, 9_999, 25_000, 127, 128, 129, 0, 256]])
    got = importance.SpanCrc()(data, starts, lengths)
    assert got.tolist() == [zlib.crc32(data[s:s + n].tobytes()) for s, n in zip(starts, lengths)]


def brute_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
    return [zlib.crc32(" ".join(words[i:i + k]).encode()) % 10_000 for k in (1, 2, 3)
            for i in range(len(words) - k + 1)], len(words)


def brute_resample(rows, target):
    feats = [brute_features(t) for _, t in rows]
    s, t = Counter(), Counter()
    for f, _ in feats:
        s.update(f)
    for x in target:
        t.update(brute_features(x)[0])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in range(10_000)]
    out = []
    for (i, _), (f, words) in zip(rows, feats):
        h = int(hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[:5 * len(able) // 100]):
        r[5] = k + 1
    return out


def test_importance_of_whole_tables(spark, docs):
    target = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {r["doc_id"]: (r["n_features"], r["weight"], r["score"], r["rank"]) for r in
           E.queries()["op13_importance"](spark, SF).collect()}
    want = {i: (n, w, s, k) for i, _, n, w, s, k in brute_resample(docs, target)}
    assert got == want and sum(x[3] is not None for x in got.values()) > 5


def test_importance_edges(spark):
    long = " ".join(f"w{i % 977} V{i % 13}\u00e9" for i in range(60_000))
    rows = [(None, None), (1, ""), (1, ""), (2, " .,- "), (3, long), (4, "\u4e2d" * 40_000), (5, "a\x00b`c{d A_B " * 9),
            *[(None, "the same words of twenty or more " * 5)] * 60, *[(10 + i, f"word{i} " * 25) for i in range(60)]]
    df, target = table(spark, rows), table(spark, [(1, "word7 word7"), (2, None)])
    got = importance.resample(df, target).collect()
    want = brute_resample(rows, ["word7 word7"])
    assert sorted((tuple(r) for r in got), key=str) == sorted(map(tuple, want), key=str)
    assert importance.resample(table(spark, []), target).collect() == []
    free = importance.resample(df, table(spark, [])).collect()
    assert sorted((tuple(r) for r in free), key=str) == sorted(map(tuple, brute_resample(rows, [])), key=str)
