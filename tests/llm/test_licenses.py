import re

from helixframe.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = [
    "Released under the MIT License.", "Licensed under CC BY-NC 4.0.\nmore text", "cc by nc cc by nc, CC-BY-NC under the mit license", "This work is licensed under the GNU General Public License, version 3.\nthe rest", "under the mit", "", None,
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in\nthe Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nother",
    "Licensed under the Apache License, Version 2.0", "nothing of that kind here", "ÉÜ licensed 語 under", "x " * 30000 + "apache license version 2",
]


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text):
    own, places, base, more, best = words(text), [], set(), set(), 0.0
    for phrase, label in licenses.PHRASES.items():
        parts = phrase.split()
        found = [i for i in range(len(own) - len(parts) + 1) if own[i : i + len(parts)] == parts]
        places += found
        base |= {label} if found else set()
    for block in [*(text or "").split("\n"), *re.split(r"\n[ \t\r]*\n", text or "")]:
        tokens = set(words(block))
        for label, template in licenses.TEMPLATES:
            want = set(licenses.tokens_of(template))
            if len(tokens & want) >= licenses.needed(len(want), licenses.CONTAINMENT):
                more.add(label)
                best = max(best, len(tokens & want) / len(want))
    return len(own), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if places else best


def test_matches_brute_force(spark):
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(TEXTS)], "doc_id long, text string, labels string")
    rows = {r.doc_id: r for r in licenses.scan(df.repartition(3)).collect()}
    for i, t in enumerate(TEXTS):
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == brute(t), t
    assert rows[7].labels == "mit" and rows[3].labels == "gpl-3"


def test_empty_repeated_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert licenses.scan(spark.createDataFrame([], schema)).collect() == []
    rows = licenses.scan(spark.createDataFrame([(1, TEXTS[0]), (1, TEXTS[0]), (None, TEXTS[0])], schema)).collect()
    assert [r.n_base for r in rows] == [1, 1, 1]


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, TEXTS[0])], "doc_id long, text string")
    assert "Python" not in licenses.scan(df)._jdf.queryExecution().toString()
