"""Toxicity: neighbours against brute force, calibration, planted words, odd rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helixframe.llm import queries, toxicity
from helixframe.llm.common import read_table

VECTOR = st.dictionaries(st.integers(0, 11), st.integers(1, 4), max_size=4)


def brute(examples, idf, vector, k, without=None):
    unit = lambda v: {t: (1 + math.log(c)) * idf[t] for t, c in v.items()}
    norm = lambda v: math.sqrt(sum(w * w for w in v.values()))
    own, found = unit(vector), []
    for i, v, _ in examples:
        other = unit(v)
        dot = sum(w * other.get(t, 0) for t, w in own.items())
        if dot > 0 and i != without:
            found.append((-round(dot / norm(own) / norm(other), 9), i))
    return sorted(found)[:k]


@given(st.lists(st.tuples(VECTOR.filter(bool), st.integers(0, 1)), max_size=40), VECTOR, st.integers(1, 6), st.integers(1, 9))
@settings(max_examples=200, deadline=None)
def test_neighbours_are_those_of_brute_force(rows, query, k, block):
    idf = np.linspace(1, 3, 12)
    examples = [(i, v, y) for i, (v, y) in enumerate(rows)]
    index = toxicity.Index([(i, *map(tuple, zip(*sorted(v.items()))), y) for i, v, y in examples], idf, block)
    terms, counts = (tuple(x) for x in zip(*sorted(query.items()))) if query else ((), ())
    got = [(-round(s, 9), int(index.ids[at])) for s, at in index.nearest(terms, counts, k, without=1)]
    assert got == brute(examples, idf, query, k, without=1)


def test_votes_are_calibrated_without_the_row_itself():
    rng = np.random.default_rng(0)
    examples = [(i, (int(rng.integers(3)),), (1,), 0) for i in range(300)]
    examples = [(i, t, c, int(rng.random() < (0.1, 0.5, 0.9)[t[0]])) for i, t, c, _ in examples]
    model = toxicity.fit(examples, (100, 2), np.ones(3), 30)
    low, _, high = (model.score((t,), (1,))[0] for t in range(3))
    assert model.score((), ())[0] <= low < high and all(0 <= model.score((t,), (1,))[0] <= 1 for t in range(3))
    assert toxicity.fit([], (0, 0), np.ones(0)).score((), ())[0] == 0.5


WORDS = [f"w{k}" for k in range(400)]


def planted(n=900, seed=8):
    rng = np.random.default_rng(seed)
    docs, labels = [], []
    for i in range(n):
        said = [WORDS[k] for k in rng.integers(0, 400, int(rng.integers(5, 60)))]
        toxic = int(rng.random() < 0.15)
        if toxic:
            for bad in rng.choice(["vile", "Übel", "nasty"], 2, replace=False):
                said.insert(int(rng.integers(len(said))), str(bad))
        docs.append((i, " ".join(said)))
        labels.append((i, toxic))
    return docs, labels


def test_planted_words_and_odd_rows(spark):
    docs, labels = planted()
    odd = [(None, "vile and nasty"), (5000, None), (5001, ""), (5002, "w1 " * 200_000 + "NASTY vile"), (5003, docs[3][1]), docs[7]]
    df = spark.createDataFrame([(*d, "x") for d in docs + odd], "doc_id long, text string, toxic string").repartition(4)
    known = spark.createDataFrame(labels + [(None, 1), (5000, None), labels[2]], "doc_id long, toxic int")
    got = toxicity.classify(df, known).collect()
    assert len(got) == len(docs) + len(odd)
    truth, texts = dict(labels), dict(docs)
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert sum(a == b for a, b in held) >= 0.98 * len(held) and {b for _, b in held} == {0, 1}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        for e in r.evidence:
            assert zlib.crc32(str(e.doc_id).encode()) % 5 and e.toxic == truth[e.doc_id] and 0 < e.similarity <= 1 + 1e-9
            assert set(re.findall("vile|übel|nasty|w\\d+", texts[e.doc_id].lower()))
    by = {r.doc_id: r for r in got}
    assert by[None].predicted == by[5002].predicted == 1 and by[5000].score == by[5001].score < 0.5
    assert by[5003].score == by[3].score and len({r.score for r in got if r.doc_id == 7}) == 1


def test_no_labels_no_documents_and_one_class(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.classify(df, none).collect()] == [0.5, 0.5]
    assert toxicity.classify(df.limit(0), none).collect() == []
    known = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 1)], "doc_id long, toxic int")
    assert all(r.score == 1.0 for r in toxicity.classify(df, known).collect())


def test_copies_of_one_text_do_not_make_a_term(spark):
    copies = [("same words again and again here", 1)] * 30 + [(f"plain {k} text", 0) for k in range(100)] + [(f"bad{k % 3} before slur after{k}", 1) for k in range(30)]
    texts = spark.createDataFrame(copies, "text string, toxic int")
    assert set(toxicity.choose_terms(texts)) == {b"slur", b"before"} - {b"before"}


def test_op12_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.toxic for r in read_table(spark, sf, "labels").collect()}
    got = queries.op12_toxicity(spark, sf).collect()
    held = Counter((truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth)
    assert held[1, 1] >= 0.6 * (held[1, 0] + held[1, 1]) and held[0, 1] <= 0.02 * (held[0, 0] + held[0, 1])
    assert len(got) == read_table(spark, sf, "documents").count()
    # the neighbours of each scored text, by brute force over the same examples
    model_rows = {e.doc_id for r in got for e in r.evidence}
    assert all(r.evidence == sorted(r.evidence, key=lambda e: (-e.similarity, e.doc_id)) for r in got) and not {i for i in model_rows if zlib.crc32(str(i).encode()) % 5 == 0}
