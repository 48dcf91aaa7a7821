import random

import pytest

from foliospark.llm import decontam


def index_of(items):
    return decontam.ItemIndex(items, 0.2, decontam.walks_by_length(items, 0.2, 0.99))


@pytest.mark.parametrize("held", [1, 40, 2500])
def test_items_that_share_their_keys(monkeypatch, held):
    """Hits taken few at a time, bound by rare words or not, find what all at once find."""
    rng = random.Random(3)
    vocab = [f"w{k}" for k in range(3000)]
    items = [(k, " ".join(["what is the name of the", *rng.choices(vocab[:60], k=rng.randrange(1, 9))])) for k in range(80)] + [(1000 + k, " ".join(rng.choices(vocab, k=rng.randrange(1, 50)))) for k in range(30)]
    texts = [None, ""]
    for _ in range(25):
        parts = []
        for _ in range(rng.randrange(1, 20)):
            w = rng.choice(items)[1].split()
            for _ in range(rng.randrange(len(w) // 5 + 1)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            parts += w if rng.random() < 0.7 else rng.choices(vocab, k=9)
        texts.append(" ".join(parts))
    index = index_of(items)
    all_at_once = sorted(index.search(texts))
    monkeypatch.setattr(decontam, "HITS", held)
    assert sorted(index.search(texts)) == all_at_once and len(all_at_once) > 100


def test_hits_are_held_in_bounded_parts(monkeypatch):
    items = [(k, f"what is the name of the thing number {k} in the list") for k in range(300)]
    texts = [" ".join(f"what is the name of the thing number {k} in the list" for k in range(0, 600, 3))]
    index, sizes = index_of(items), []
    monkeypatch.setattr(decontam, "HITS", 2000)
    words, begins = decontam.words_of_all(texts)
    assert max(len(part) for part in index._candidates(words, begins)) <= 2 * 2000 + 300
    for at, _, _ in index._hits(words):
        sizes.append(len(at))
    assert max(sizes) <= 2000 and sum(sizes) > 50 * 2000
