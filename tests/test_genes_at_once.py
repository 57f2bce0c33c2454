"""A strand's frames and motifs by arrays against those of its text, and genes that leave a task by many texts."""

import random
import time

from helixframe.operators import genes as gn

RNG = random.Random(11)
TEXTS = ["", "A", "ATGTAA", "AGGAGGATGTAA", "ATGNTAGATGCCCTGA"] + ["".join(RNG.choice("ACGTN"[: RNG.choice([4, 5])]) for _ in range(RNG.randint(0, 400))) for _ in range(80)]


def test_frames_and_motifs():
    for text in TEXTS:
        strand = gn.Strand(text)
        want = []
        for i in range(len(text) - 2):
            if text[i : i + 3] in gn.START_WEIGHTS:
                j = next((j for j in range(i + 3, len(text) - 2, 3) if text[j : j + 3] in gn.STOPS), None)
                if j is not None and j - i >= 6:
                    want.append((j, i))
        at, stop = strand.frames(6)
        assert list(zip(stop.tolist(), at.tolist())) == sorted(want)
        for m in gn.BINDING:
            assert strand.upstream(m, at).tolist() == [m in text[max(0, i - gn.UPSTREAM) : i] for i in at.tolist()]
        for size in range(1, 10):
            assert strand.words(size).tolist() == gn.words(gn.codes(text), size).tolist()


def test_genes_of_many_texts_leave_together(spark):
    df = spark.createDataFrame([*enumerate(TEXTS), (-1, None)], "id long, seq string").coalesce(1)
    found = gn.predict(df, "id", least=30, fragments=True)
    whole = sorted((r.id, r.start, r.end, r.strand, r.score) for r in found.collect())
    assert whole == sorted((k, *g[:4]) for k, s in enumerate(TEXTS) for g in gn.scan(s, None, 30)) and whole


def test_a_long_text_takes_little_time():
    text = "".join(RNG.choice("ACGT") for _ in range(2_000_000))
    began = time.perf_counter()
    assert len(gn.scan(text, None, 60)) > 10_000
    assert time.perf_counter() - began < 3
