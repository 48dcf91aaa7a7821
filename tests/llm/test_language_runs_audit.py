import random
import unicodedata
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import filter_audit, language_id, periodic_runs

from .test_operators import corpus, frame

KINDS = language_id.kinds()


# --- language identification

def plain_grams(text):
    out, line = Counter(), "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in (text or "").lower())
    if not any(unicodedata.category(c)[0] == "L" for c in line):
        return out
    for w in line.split(" "):
        for n in (1, 2, 3):
            w and out.update(x for x in (f"\x01{w}\x01"[i : i + n] for i in range(len(w) + 3 - n)) if x.strip("\x01"))
    # a blank ends one word and begins the next, so no n-gram is counted twice
    return out


def code(gram):
    out = 0
    for c in gram:
        out = out << 21 | ord(c)
    return out


def test_grams_are_those_within_words():
    for t in ("a", "Ab, ab cd!", "Ümläut ✓ 😀 x", "1 2 3", "", None, "é é", "名前は", "́ ́"):
        grams, counts = language_id.gram_counts(t, KINDS)
        assert dict(zip(grams.tolist(), counts.tolist())) == {code(g): n for g, n in plain_grams(t).items()}


def test_long_texts_are_counted_in_pieces(monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choice("abc  é") for _ in range(5000))
    whole = language_id.gram_counts(text, KINDS)
    for piece in (1, 2, 3, 7, 4999):
        monkeypatch.setattr(language_id, "PIECE", piece)
        assert all(np.array_equal(a, b) for a, b in zip(language_id.gram_counts(text, KINDS), whole))


def plain_profile(counts):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))[: language_id.SIZE]]


def plain_language(text, profiles):
    mine = plain_profile(plain_grams(text))
    if not mine or not profiles:
        return "und", 0.0
    far = {lang: sum(abs(p.index(g) - k) if g in p else language_id.SIZE for k, g in enumerate(mine)) for lang, p in profiles.items()}
    best = min(sorted(far), key=far.get)
    return best, 1 - far[best] / (len(mine) * language_id.SIZE)


TEXTS = [
    (1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, "der Hund und die Katze", "de"), (4, "the rain in the plain", "en"), (5, None, "en"), (6, "", "fr"), (7, "12 34", "xx"),
    (8, "et le the", None), (9, "THE DOG", None), (None, "le the", "fr"), (1, "the cat and the dog", "en"), (10, "z" * 3000, None), (11, "ő", None),
]


@pytest.mark.parametrize("block", [1000, 1])
def test_languages_equal_the_plain_way(spark, monkeypatch, block):
    monkeypatch.setattr(language_id, "BLOCK", block)
    df = spark.createDataFrame(TEXTS, "doc_id long, text string, lang string").withColumns({"score": F.lit("x"), "gram": F.lit(1), "n": F.lit("n")})
    counts = defaultdict(Counter)
    for _, t, lang in TEXTS:
        if t and lang:
            counts[lang].update(plain_grams(t))
    profiles = {k: plain_profile(c) for k, c in counts.items() if c}
    assert set(profiles) == {"en", "fr", "de"}
    out = language_id.predict(df, language_id.fit(df))
    assert out.columns == ["doc_id", "text", "lang", "gram", "n", "lang_pred", "score"]
    got = sorted((r.doc_id or 0, r.text or "", r.lang_pred, round(r.score, 9)) for r in out.collect())
    assert got == sorted((d or 0, t or "", (p := plain_language(t, profiles))[0], round(p[1], 9)) for d, t, _ in TEXTS)


def test_nothing_learned_and_nothing_asked(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string, lang string")
    none = language_id.fit(df.limit(0))
    assert {(r.lang_pred, r.score) for r in language_id.predict(df, none).collect()} == {("und", 0.0)}
    assert language_id.predict(df.limit(0), language_id.fit(df)).collect() == []


def test_held_out_by_checksum(spark):
    ids = [*range(50), -7, None, 1 << 61]
    rows = spark.createDataFrame([(k,) for k in ids], "doc_id long").select("doc_id", language_id.held_out().alias("h")).collect()
    assert {r.doc_id: r.h for r in rows} == {k: k is not None and zlib.crc32(str(k).encode()) % 3 == 1 for k in ids}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", language_id.held_out().alias("h"))
    out = language_id.predict(docs, language_id.fit(docs.where("NOT h"))).where("h AND text RLIKE '[a-z]'").select((F.col("lang") == F.col("lang_pred")).alias("right"))
    right, n = out.agg(F.sum(F.col("right").cast("int")), F.count("*")).first()
    assert n > 200 and right / n > 0.97


# --- periodic runs

def plain_runs(w, least, power):
    n, out = len(w), []
    for q in range(1, n // power + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(least, power * q) and not any(all(w[x] == w[x + r] for x in range(s, i + q - r)) for r in range(1, q)):
                out.append((s, i + q - s, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("near", [0, 1, 12])
def test_runs_equal_brute_force(monkeypatch, near):
    monkeypatch.setattr(periodic_runs, "NEAR", near)
    rng = random.Random(near)
    for _ in range(600):
        w = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randrange(70))]
        if w and rng.random() < 0.5:
            s, p = rng.randrange(len(w)), rng.randrange(1, 12)
            w = [x if i < s or s + (i - s) % p >= len(w) else w[s + (i - s) % p] for i, x in enumerate(w)] * rng.randrange(1, 4)
        for least, power in ((6, 4), (2, 2), (1, 3)):
            assert periodic_runs.find_runs(w, least, power) == plain_runs(w, least, power)


def test_hashes_that_lie_are_caught(monkeypatch):
    # with a modulus of 3 nearly every second comparison is wrong; the words decide. A common part that the hashes cut
    # short is no longer than the true one, and runs found from it are checked by their own words.
    monkeypatch.setattr(periodic_runs, "NEAR", 4)
    monkeypatch.setattr(periodic_runs, "_PRIME", 3)
    monkeypatch.setattr(periodic_runs, "_BASE", 1)
    monkeypatch.setattr(periodic_runs, "_powers", periodic_runs.array("Q", [1]))
    rng = random.Random(8)
    w = [rng.randrange(2) for _ in range(300)] + [7]
    s = periodic_runs.Stretches([x + 1 for x in w] + [0])
    for _ in range(300):
        i, j = sorted(rng.sample(range(len(w)), 2))
        k = 0
        while j + k < len(w) and w[i + k] == w[j + k]:
            k += 1
        assert s.ahead(i, j) == k


def test_long_periodic_texts_end_soon():
    rng = random.Random(4)
    fib, b = [0], [0, 1]
    while len(b) < 60_000:
        fib, b = b, b + fib
    assert periodic_runs.find_runs([1] * 100_000) == [(0, 100_000, 1)]
    assert periodic_runs.find_runs(b) == []
    block = [rng.randrange(10_000) for _ in range(20_000)]
    assert periodic_runs.find_runs(block * 5) == [(0, 100_000, 20_000)]


def plain_document(doc_id, text, plant):
    w = [x for x in (text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if x]
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(w)
    if plant and h % 10 == 0 and n:
        a, g = (h // 10) % n, h // 10
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = plain_runs(w, 6, 4)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return len(w), runs, " ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.mark.parametrize("plant", [False, True])
def test_documents_with_runs(spark, plant):
    docs = [*corpus(120, 6), (1, "a " * 9), (2, "a b " * 5 + "\x1cc"), (1, "a " * 9), (None, "x y " * 6)]
    df = frame(spark, docs)
    if plant:
        df = periodic_runs.with_planted(df)
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.periodic_runs(df).collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    want = [(d, *plain_document(d, t, plant)) for d, t in docs]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(len(x[2]) for x in want) >= 5
    assert periodic_runs.periodic_runs(df.limit(0)).collect() == []


def test_summary_of_runs(spark):
    df = spark.createDataFrame([(1, "a b " * 4 + "c c c c c c c c"), (2, None)], "doc_id long, text string")
    one, none = periodic_runs.summary(periodic_runs.periodic_runs(df)).orderBy("doc_id").collect()
    assert (one.n_runs, one.start, one.length, one.period, one.exponent_milli) == (2, 0, 8, 2, 4000)
    assert (none.n_runs, none.start, none.length, none.period, none.exponent_milli) == (0, None, None, None, None)
    assert none.runs_sha256 == none.collapsed_sha256 != one.runs_sha256


# --- filter audit

def plain_audit(docs, labels):
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    good, toxic = ({d for d, *v in labels if v[k] == 1} for k in (0, 1))
    good, toxic, judged = good - {None}, toxic - {None}, []
    for d, t, lang in docs:
        x = t or ""
        w = x.encode().split()
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in x) > 3 * len(x), "D": any(c in "#$%&*|" for c in x), "E": d is not None and first[x] < d}
        judged.append((lang or "", {k for k, v in fails.items() if v}, d in good, d in toxic))
    out, shapley = {}, Counter()
    for part in {j[0] for j in judged}:
        for order in map("".join, permutations("ABCDE")):
            left = [j for j in judged if j[0] == part]
            own, gone = list(left), []
            for step, f in enumerate(order, 1):
                removed = [j for j in left if f in j[1]]
                left = [j for j in left if f not in j[1]]
                shapley[part, f] += len(removed)
                out[part, order, step] = [len(left), len(removed), sum(f in j[1] for j in gone), sum(j[1] == {f} for j in own), sum(j[2] for j in removed), sum(j[3] for j in removed)]
                gone += removed
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_equals_every_order_by_itself(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(500)]
    texts = [None, "", " \n", "ABC def", "x $ y", "the " * 250, " ".join(words[:220]), " ".join(words[:220]) + " #", "T" * 30]
    docs = [(rng.choice([None, 1, 2, *range(5, 90)]), rng.choice([*texts, " ".join(rng.choices(words, k=rng.randrange(400)))]), rng.choice(["en", "de", None, ""])) for _ in range(200)]
    labels = [(rng.choice([None, *range(60)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(80)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({c: F.lit("x") for c in ("key", "part", "mask", "good", "toxic", "quality", "n")})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("y"))
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit(df, marks).collect()}
    assert got == plain_audit(docs, labels)
    assert filter_audit.audit(df.limit(0), marks).collect() == []
    assert len(filter_audit.audit(df, marks.limit(0)).collect()) == len(got)


def test_survivors_are_zeta_sums(spark):
    counts = [("p", m, m * m + 1, m, 1) for m in range(8) if m != 5]
    df = spark.createDataFrame(counts, "part string, mask int, n long, good long, toxic long")
    row = filter_audit.survivors(df, 3).first()
    for s in range(8):
        assert row.n[s] == sum(n for _, m, n, _, _ in counts if not m & s)
        assert row.good[s] == sum(g for _, m, _, g, _ in counts if not m & s)
