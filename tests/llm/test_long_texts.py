import base64
import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from foliospark.llm import line_dedup, pii, secrets, sentencepiece_sa
from foliospark.llm.queries import tokenizer_file

from . import brute


def pseudonyms(spark, text):
    return pii.pseudonymize(spark.createDataFrame([(1, text)], "doc_id long, text string"), "k").first()


def test_domains_with_very_many_labels(spark):
    # a domain has 127 labels at most; the patterns match without recursion, whatever follows an @
    row = pseudonyms(spark, "a@" + "bb." * 100_000 + "com and x@y.example.org")
    assert [p.kind for p in row.pii] == ["email", "email"] and row.text.endswith("@y.example.org")
    assert pseudonyms(spark, "a@" + "b." * 100_000 + "com").pii == []
    assert pseudonyms(spark, "a@" + "b." * 126 + "com").pii[0].kind == "email"


def test_numbers_with_very_many_groups(spark):
    text = "-".join(["123"] * 5_000)
    row = pseudonyms(spark, text)
    assert len(row.pii) == 1 and len(row.text) == len(text) and row.text.count("-") == 4_999 and row.text != text


def test_refilled_in_blocks(spark, one):
    rng = random.Random(1)
    values = ["".join(rng.choice("12-") for _ in range(n)) for n in (1, 255, 256, 257, 511, 513, 2000)]
    wanted = []
    for v in values:
        letters = iter("abcdefghij" * 300)
        wanted.append("".join(c if c == "-" else next(letters) for c in v))
    assert one(lambda c: pii._refill(c, F.lit("abcdefghij" * 300), "[^0-9]"), *values) == wanted


def test_very_many_secrets_in_a_text(spark):
    rng = random.Random(2)
    kinds = (lambda: f"{rng.getrandbits(96):024x}", lambda: f"token=abc{rng.getrandbits(30):x}", lambda: f"aB3dE6gH9jK2mN5pQ8sT{rng.getrandbits(30)}", lambda: "word", lambda: f"secret: {rng.getrandbits(130):033x}")
    text = " ".join(rng.choice(kinds)() for _ in range(3_000))
    df = spark.createDataFrame([(1, text, "s", "en")], "doc_id long, text string, source string, lang string")
    row = secrets.scan_secrets(df).select("base", "spans", F.sha2(secrets.written("base"), 256).alias("digest")).first()
    want = brute.secrets(text)
    assert (*(sum(b.kind == k for b in row.base) for k in ("assign", "access", "hex")), row.digest) == want
    assert all(text[x.start : x.end].startswith("aB3d") for x in row.spans if x.kind == "owned") and len(row.spans) > len(row.base) > 2 * secrets.BLOCK
    taken = [(b.start, b.end) for b in row.base]
    assert len(row.spans) - len(row.base) == text.count("aB3dE6gH9jK2mN5pQ8sT")
    assert sorted(taken) == taken


def test_words_of_any_length_equal_the_model():
    model = tokenizer_file("piece_bpe_32k.model")
    sp, v, rng = sentencepiece.SentencePieceProcessor(model_file=model), sentencepiece_sa.load(model), random.Random(5)
    signs = {"han": [chr(c) for c in range(0x4E00, 0x9FA5)], "thai": [chr(c) for c in range(0xE01, 0xE3B)], "letters": "etaoinshrdlu", "two": "ae", "one": "-", "pieces": [p for p in v.ids if sentencepiece_sa.MARK not in p]}
    words = []
    for _ in range(300):
        kind, n = rng.choice([*signs, "base64"]), rng.choice([5, 30, 63, 64, 100, 400, 1500])
        words.append(base64.b64encode(rng.randbytes(n)).decode() if kind == "base64" else "".join(rng.choice(signs[kind]) for _ in range(n)))
    for occurrences in (1, 5_000, sentencepiece_sa.OCCURRENCES):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(sentencepiece_sa, "OCCURRENCES", occurrences)
            some = words if occurrences > 1 else words[:5]
            ids, sizes = sentencepiece_sa.encode_words([sentencepiece_sa.MARK + w for w in some], v)
        ends = np.cumsum(sizes)
        for w, n, end in zip(some, sizes, ends, strict=True):
            assert ids[end - n : end].tolist() == sp.encode(w)


def test_long_words_are_not_merged_one_by_one(monkeypatch):
    v, rng, sizes = sentencepiece_sa.load(tokenizer_file("piece_bpe_32k.model")), random.Random(6), []
    merged = sentencepiece_sa.merged
    monkeypatch.setattr(sentencepiece_sa, "merged", lambda word, v: sizes.append(len(word)) or merged(word, v))
    for word in ("".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(50_000)), base64.b64encode(rng.randbytes(50_000)).decode()):
        sizes.clear()
        sentencepiece_sa.encode_words([word], v)
        assert sum(sizes) < len(word) / 2


def test_line_dedup_of_texts_without_spaces(spark):
    shared = ["这是第一行共同的文字内容", "短", "これは二番目の共通の行です", "บรรทัดที่สามเหมือนกัน"]
    docs = [(1, "\n".join(["甲", *shared])), (2, "\n".join(["乙", *shared, "丙"])), (3, "短\n短\n" + shared[0][:7]), (4, shared[0][:7]), (5, shared[0] + "\n" + "短")]
    got = {r.doc_id: (r.text, r.n_removed_lines) for r in line_dedup.drop_common_blocks(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute.common_blocks(docs)
    assert got[2] == ("乙\n丙", 4) and got[4] == (shared[0][:7], 0) and got[5] == ("", 2)


def test_line_dedup_of_very_many_lines(spark):
    lines = [f"line number {k} of the text" for k in range(200_000)]
    docs = [(1, "\n".join(lines[::2])), (2, "\n".join(lines)), (3, "\n".join(["own words of the third"] * 100_000))]
    got = {r.doc_id: r for r in line_dedup.drop_common_blocks(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1].n_removed_lines == 0 and got[3].n_removed_lines == 0
    assert got[2].n_removed_lines == 100_000 and got[2].text == "\n".join(lines[1::2])
