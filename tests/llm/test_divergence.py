"""Divergence audit: the scans against plain counting, with small bundles, groups and cells, and odd rows."""

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helixframe.llm import divergence


def plain(docs, least):
    """Rows of the audit of (text, lang, source) rows."""
    docs = [tuple(x or "" for x in d) for d in docs]
    found = [(lang, source, [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]) for text, lang, source in docs]
    df, n = Counter(), Counter()
    for lang, source, ws in found:
        df.update({(lang, w) for w in ws})
        n.update((lang, source, w) for w in ws)
    out = []
    for lang in {d[1] for d in docs}:
        terms = sorted((w for a, w in df if a == lang and df[a, w] >= least), key=str.encode)
        sources = sorted({s for _, a, s in docs if a == lang}, key=str.encode)
        count = {s: {w: n[lang, s, w] for w in terms} for s in sources}
        share = lambda c: {w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(terms)) for w in terms}
        p = {s: share(count[s]) for s in sources}
        q = share({w: sum(count[s][w] for s in sources) for w in terms})
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(f(p[s][w], p[t][w]) for w in terms), t) for t in sources if t != s]
            best = [(f(p[s][w], q[w]), w) for w in terms if count[s][w] and p[s][w] > q[w]]
            for part, items, top in (("pair", pairs, None), ("term", best, 10)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(items[:top])]
    return sorted(out)


def corpus(n=150, langs=2, sources=7, words=60, seed=4):
    rng = np.random.default_rng(seed)
    names = [f"{chr(97 + k % 26)}é{chr(97 + k // 26)}" for k in range(words)] + ["The", "THE", "x1y"]
    docs = []
    for _ in range(n):
        s = int(rng.integers(sources)) if rng.random() < 0.6 else 0  # one source holds much
        picked = [names[int(k) % len(names)] for k in rng.zipf(1.5, int(rng.integers(0, 40))) + s]
        docs.append((" ".join(picked), f"l{rng.integers(langs)}", f"s{s}"))
    return docs + [(None, "l0", "s0"), ("", None, None), ("a b", "l0", None), ("only words here", "l9", "s0"), ("12 34 !", "l8", "s1"), ("", "l8", "s2")] + docs[:20]


@pytest.mark.parametrize("bundle, part, cells", [(divergence.BUNDLE, divergence.PART_ENTRIES, divergence.CELLS), (20, 15, 16)])
def test_against_plain_counting(spark, monkeypatch, bundle, part, cells):
    monkeypatch.setattr(divergence, "PART_ENTRIES", part)
    monkeypatch.setattr(divergence, "BUNDLE", bundle)
    monkeypatch.setattr(divergence, "CELLS", cells)
    docs = corpus()
    df = spark.createDataFrame([(None if k == 3 else k, *d, "clash") for k, d in enumerate(docs)], "doc_id long, text string, lang string, source string, term string").repartition(5)
    got = sorted(tuple(r) for r in divergence.audit(df, least=5).collect())
    assert got == plain(docs, 5)


def test_small_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "one two", "en", "a"), (2, "one", "en", "b"), (3, None, "de", "a")], "doc_id long, text string, lang string, source string")
    assert sorted(tuple(r) for r in divergence.audit(df).collect()) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    assert divergence.audit(df.limit(0)).collect() == []


def test_a_very_long_text(spark):
    docs = [("word " * 300_000 + "end", "en", "a")] + [("word end other", "en", "b")] * 12
    df = spark.createDataFrame([(k, *d) for k, d in enumerate(docs)], "doc_id long, text string, lang string, source string")
    assert sorted(tuple(r) for r in divergence.audit(df).collect()) == plain(docs, 10)


@given(st.lists(st.tuples(st.integers(0, 10**14), st.integers(0, 10**14)), min_size=1, max_size=20))
@settings(max_examples=200, deadline=None)
def test_shares_are_exact(pairs):
    n, total = (np.array(x, dtype=np.int64) for x in zip(*((min(p) + 2, max(p) + 2) for p in pairs)))
    assert divergence.share(n, total).tolist() == [1 + 10**9 * int(a) // int(b) for a, b in zip(n, total)]
