import random
import re
from collections import Counter

import numpy as np
import pytest

from helixframe.llm import near_dedup, shingles

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def counts(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else Counter([tuple(words)] if words else [])


def similarity(a, b):
    a, b = counts(a), counts(b)
    both = sum((a & b).values())
    return both / total if (total := sum(a.values()) + sum(b.values()) - both) else 0.0


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        words = [f"w{rng.randint(0, 4000)}" for _ in range(rng.randint(5, 200))]
        out.append(" ".join(words))
        for _ in range(rng.choice([0, 0, 1, 3])):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 40))):
                copy[rng.randrange(len(copy))] = "Changed"
            out.append(" ".join(copy))
    return out + ["a b c d e f g " * 50, "a b c d e f g " * 48, "Short one", "short ONE", "", None, "..."]


def brute_classes(texts):
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if similarity(texts[i] or "", texts[j] or "") >= 0.8:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


def test_cells_are_the_shingles():
    texts = [t or "" for t in corpus(10)]
    owner, hashes, count = shingles.cells([t.encode() for t in texts])
    for i, t in enumerate(texts):
        assert sorted(count[owner == i]) == sorted(counts(t).values())
        assert len(set(hashes[owner == i])) == len(counts(t))


def test_signature_is_unbiased_and_stays_with_weights():
    a, b = "a b c d e f g h " * 30 + "x y z q r s t", "a b c d e f g h " * 24 + "k l m n o p q"
    owner, hashes, count = shingles.cells([a.encode(), b.encode(), a.encode()])
    points = near_dedup.signatures(owner, hashes, count, 3, m=4096)
    assert np.isfinite(points).all() and (points[0] == points[2]).all()
    assert abs((points[0] == points[1]).mean() - similarity(a, b)) < 0.04


def test_pair_similarities():
    texts = [t or "" for t in corpus(20)]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i)][:200]
    flat = [texts[k].encode() for p in pairs for k in p]
    assert shingles.weighted_jaccard(len(pairs), *shingles.cells(flat)) == pytest.approx([similarity(texts[i], texts[j]) for i, j in pairs])


def test_classes_match_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, node string")
    got = {r.doc_id: r.class_id for r in near_dedup.classes(df).collect()}
    assert got == dict(enumerate(brute_classes(texts)))


def test_keep_first_and_repeated_rows(spark):
    text = " ".join(f"word{i}" for i in range(50))
    df = spark.createDataFrame([(5, text, "a", 1), (5, text, "a", 1), (3, text + " more", "b", 2), (9, None, "c", 3), (9, "", "c", 3), (None, "quite another text of several words here", "d", 4)], "doc_id long, text string, class string, uid2 int")
    rows = near_dedup.keep_first(df).collect()
    assert sorted((r.doc_id or 0, r["class"]) for r in rows) == [(0, "d"), (3, "b"), (9, "c"), (9, "c")]
    assert near_dedup.classes(df.limit(0)).collect() == []


def test_copies_around_the_threshold(spark, monkeypatch):
    """A group in which many copies are linked to some others and not to the first, cut into several blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK_NODES", 20)
    monkeypatch.setattr(near_dedup, "COLUMNS", 64)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(90):
        copy = list(words)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(120)] = f"x{rng.randint(0, 30)}"
        texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_dedup.classes(df).collect()} == dict(enumerate(brute_classes(texts)))
