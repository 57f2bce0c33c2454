import random
import re
from collections import Counter

import numpy as np
import pytest

from helixframe.llm import line_rules, quality


def brute_repeats(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    return len({i + k for i, w in enumerate(windows) if w in often for k in range(3)})


def test_counts_match_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choices(["a", "b ", "c\n", "d\n", " ", "\t", "é", "#", "|", "\x1c", " ", "\n\n", "x y z "], k=rng.randint(0, 120)))
        got, words = line_rules.clean(text), re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (got["n_words"], got["word_chars"], got["n_symbols"]) == (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)))
        assert got["n_dup_lines"] == len(lines) - len(set(lines)) and got["n_repeat_words"] == brute_repeats(words)
        assert got["base_failed"] == (len(words) < 50 or 100 * got["n_repeat_words"] > 50 * len(words))


def test_line_verdicts():
    good = "This is a sentence of ordinary running text that says something and ends."
    assert line_rules.line_verdict(good, good.split()) is None
    assert line_rules.line_verdict("Home | News | About | Contact", "Home | News | About | Contact".split()) == "navigation"
    assert line_rules.line_verdict("All rights reserved.", "All rights reserved.".split()) == "boilerplate"
    assert line_rules.line_verdict("BUY!! NOW!! CHEAP!! HERE!! GO!!", "BUY!! NOW!! CHEAP!! HERE!! GO!!".split()) == "punctuation"


def test_documents(spark):
    body = "\n".join(f"Sentence number {i} tells of thing{i} and of other{i} matters{i} too." for i in range(20))
    junk = "\n".join(f"Item{i} | part{i} | link{i} | more{i} | all{i}" for i in range(30))
    df = spark.createDataFrame([(1, body, 7), (2, junk, 7), (3, None, 7), (None, "", 7), (1, body, 7)], "doc_id long, text string, kept int")
    rows = line_rules.line_rules(df, cleaned=True).collect()
    assert [(r.doc_id, r.kept) for r in rows] == [(1, True), (2, False), (3, False), (None, False), (1, True)]
    assert rows[0].cleaned == body and rows[1].cleaned == "" and rows[2].n_words == 0
    assert [r.doc_id for r in line_rules.keep_good(df).collect()] == [1, 1] and line_rules.keep_good(df).columns == df.columns
    assert line_rules.line_rules(df.limit(0)).collect() == []


def test_pooling_is_the_nearest_rising_sequence():
    assert quality.pooled(np.array([1.0, 3.0, 2.0, 4.0]), np.ones(4)).tolist() == [1.0, 2.5, 2.5, 4.0]
    values = quality.pooled(np.random.default_rng(0).random(200), np.ones(200))
    assert (np.diff(values) >= 0).all()


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice("alpha beta gamma delta house river green walks over under".split()) + str(rng.randint(0, 30)) for _ in range(80)]
        bad = i % 4 == 0
        text = " ".join(w + "$$$" if bad else w for w in words) + "."
        rows.append((i, text, int(not bad)))
        labels.append((i, int(not bad), 0))
    rows += [(1000, None, 1), (1001, "", 1), (1002, "x " * 60000, 1), (None, rows[1][1], 1), (1, rows[1][1], 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, score int"), spark.createDataFrame([*labels, (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")


def test_classifier_on_held_out_rows(spark, labelled):
    docs, labels = labelled
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id < 400]
    assert len(held) > 80 and all(r.predicted == int(r.doc_id % 4 != 0) for r in held)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows if r.doc_id is not None)
    kept = quality.keep_predicted(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect() if r.doc_id and r.doc_id < 400} == {i for i in range(1, 400) if i % 4}


def test_classifier_without_rows(spark, labelled):
    docs, labels = labelled
    assert quality.classify(docs.limit(0), labels).collect() == []
    assert {r.score for r in quality.classify(docs.limit(5), labels.limit(0)).collect()} == {0.5}
