"""Gene prediction against a plain two-pass version, over whole texts too."""

import math
import random
from collections import Counter

import pytest

from helixframe import catalog
from helixframe.operators import genes as gn
from helixframe.plans.common import text_dna
from tests.test_mapping import bases, reverse

STARTS, STOPS = {"ATG": 1.0, "GTG": 0.8, "TTG": 0.5}, {"TAA", "TAG", "TGA"}
MOTIFS = ("AGGAGG", "AGGAG", "GGAGG", "AGGA", "GAGG")


def frames(s, least):
    """(start, stop) of every start up to its stop on one strand."""
    for i in range(len(s) - 2):
        if s[i : i + 3] in STARTS:
            for j in range(i + 3, len(s) - 2, 3):
                if s[j : j + 3] in STOPS:
                    if j + 3 - i >= least:
                        yield i, j
                    break


def plain(contigs, least=90):
    motifs, contexts = Counter(), [Counter() for _ in range(9)]
    for s in contigs.values():
        for text in (s, reverse(s)):
            longest = {}
            for i, j in frames(text, 300):
                motifs.update(m for m in MOTIFS if m in text[max(0, i - 20) : i])
                longest[j] = min(i, longest.get(j, i))
            for j, i in longest.items():
                gene = text[i : j + 3]
                for k in range(9):
                    contexts[k].update(gene[x : x + k + 1] for x in range(len(gene) - k))
    total, length = sum(motifs.values()) or 1, sum(map(len, contigs.values()))
    gc = sum(s.count("G") + s.count("C") for s in contigs.values()) / max(1, length)

    def chance(word):
        if not word:
            return 0.25
        n = sum(contexts[len(word) - 1][word[:-1] + b] for b in "ACGT")
        shorter = chance(word[1:]) if len(word) > 1 else 0.25
        return (contexts[len(word) - 1][word] + 10 * shorter) / (n + 10)

    out = {}
    for key, s in contigs.items():
        found = []
        for strand, text in (("+", s), ("-", reverse(s))):
            for j in range(len(text) - 2):
                if text[j : j + 3] not in STOPS:
                    continue
                best, at, i = 0.0, None, j - 3
                while i >= 0 and text[i : i + 3] not in STOPS:
                    if text[i : i + 3] in STARTS and i <= j - least:
                        n = j + 3 - i
                        score = STARTS[text[i : i + 3]] * 10 + min(n / 1000, 1) * 5 + sum(motifs[m] / total * 20 for m in MOTIFS if m in text[max(0, i - 20) : i]) - abs((text[i : j + 3].count("G") + text[i : j + 3].count("C")) / n - gc) * 5
                        if score >= best and score > 0:
                            best, at = score, i
                    i -= 3
                if at is not None:
                    gene = text[at : j + 3]
                    odds = sum(math.log(chance(gene[max(0, x - 8) : x + 1]) / (gc / 2 if gene[x] in "GC" else (1 - gc) / 2)) for x in range(len(gene))) / len(gene)
                    a, b = (at, j + 3) if strand == "+" else (len(s) - j - 3, len(s) - at)
                    found.append((a + 1, b, strand, best, odds))
        kept = []
        for g in sorted(found, key=lambda g: (g[0], -g[3], g[1], g[2])):
            if kept and min(kept[-1][1], g[1]) - max(kept[-1][0], g[0]) > 60:
                kept[-1] = g if g[3] > kept[-1][3] else kept[-1]
            else:
                kept.append(g)
        out[key] = kept
    return out


def same(got, want):
    assert {k: [g[:3] for g in v] for k, v in got.items()} == {k: [g[:3] for g in v] for k, v in want.items() if v}
    for k, rows in got.items():
        for a, b in zip(rows, want[k]):
            assert a[3:] == pytest.approx(b[3:], abs=1e-6)


def collected(df, key):
    out = {}
    for r in df.orderBy("start", "end", "strand").collect():
        out.setdefault(r[key], []).append((r.start, r.end, r.strand, r.score, r.coding))
    return out


def gene(rng, codons):
    return "ATG" + "".join(rng.choice(["GCT", "GAA", "AAA", "CTG", "GGC", "ACC"]) for _ in range(codons)) + "TAA"


def test_two_passes_are_the_plain_ones(spark):
    rng = random.Random(21)
    contigs = {}
    for k in range(4):
        s = bases(rng, 120)
        for _ in range(3):
            s += "AGGAGG" + bases(rng, 7) + gene(rng, rng.randrange(80, 200)) + bases(rng, 60)
        contigs[k] = s if k % 2 else reverse(s)
    odd = {10: "", 11: "ATGTAA", 12: "N" * 50}
    df = spark.createDataFrame([(k, s.lower() if k == 1 else s) for k, s in (contigs | odd).items()] + [(13, None)], "id long, seq string")
    got = collected(gn.predict(df, "id"), "id")
    same(got, plain(contigs | odd))
    assert sum(len(v) for v in got.values()) >= 12
    best = gn.coding_genes(gn.predict(df, "id")).count()
    assert 6 <= best < sum(len(v) for v in got.values())
    assert gn.predict(df.where("id > 9"), "id").collect() == []


def test_fragments(spark):
    seq = "CC" + "AGGAGG" + "CCCCCC" + "ATG" + "GCA" * 40 + "TAG" + "CC"
    rows = gn.predict(spark.createDataFrame([(1, seq)], "id long, seq string"), "id", least=60, fragments=True).collect()
    r = next(r for r in rows if r.strand == "+")
    gc = (seq.count("G") + seq.count("C")) / len(seq)
    assert (r.start, r.end) == (15, 140) and 0.65 <= gc < 0.8 and r.score == pytest.approx(2 * (1 + 126 / 1000)) and r.coding is None


def test_the_query_over_whole_texts(spark):
    sf = "/root/testdata/sf0.001"
    contigs = {r.doc_id: r.seq for r in text_dna(spark, sf).collect()}
    got = collected(catalog.queries()["gene_prediction"](spark, sf), "doc_id")
    small = {k: s for k, s in contigs.items()}
    want = plain(small)
    assert {k: [g[:3] for g in v] for k, v in got.items()} == {k: [g[:3] for g in v] for k, v in want.items() if v} and len(got) > 100
