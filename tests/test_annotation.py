"""Annotation and scaffolding against worked examples and brute force."""

import random

from helixframe.operators import annotation as an
from helixframe.operators import scaffolds as sc


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_protein_terms(spark):
    df = spark.createDataFrame([(1, "xxgaggvxx"), (2, "MEEPQGAGGV"), (3, ""), (4, None), (5, "CCCCA"), (6, "DEEEE")], "id long, seq string")
    got = {r.id: r for r in an.protein_terms(df, "id").collect()}
    assert (got[1].product, got[1].confidence, got[1].ko, got[1].kegg_enzyme, got[1].enzyme) == ("Protein kinase domain-containing protein", 0.42, "K00001", "1.1.1.1", "2.7.11.1")
    assert (got[2].ko, got[2].pathways, got[2].kegg_enzyme) == ("K04451", ["map04115"], None)
    assert got[3].go_terms is None and got[4].go_terms is None and got[3].cog is None and got[4].product is None
    assert got[5].go_terms == ["GO:0005576", "GO:0008150"] and got[6].go_terms == ["GO:0003824", "GO:0008150"] and got[6].cog == "COG0533"
    assert rows(an.profile_hits(df, "id"), "id", "domain_id", "start", "end") == [(1, "PF00069", 2, 7), (2, "PF00069", 5, 10)]


def test_transfer_rna_and_chunks(spark):
    rng = random.Random(5)
    stem = "GCGGATT"
    pair = {"A": "T", "T": "A", "G": "C", "C": "G"}
    body = list("".join(rng.choice("ACGT") for _ in range(95)))
    body[:7], body[7], body[13], body[92:] = stem, "T", "A", "CCA"
    for j in range(7):
        body[71 - j] = pair[stem[j]]
    seq = "".join(rng.choice("ACGT") for _ in range(700)) + "".join(body) + "".join(rng.choice("ACGT") for _ in range(300))
    df = spark.createDataFrame([(1, seq), (2, ""), (3, None), (4, "ACGT")], "id long, seq string")
    whole, cut = (rows(an.transfer_rna(df, "id", chunk=c), "id", "first", "last", "strand", "score", "anticodon") for c in (5000, 37))
    assert whole == cut and (1, 701, 775, "+", 75.0, "".join(body[33:36])) in whole


def test_ribosomal_rna(spark):
    seq = "A" * 50 + "GACTAAGGACTAAGG" + "C" * 40
    got = rows(an.ribosomal_rna(spark.createDataFrame([(1, seq), (2, "GACTAAGG"), (3, None)], "id long, seq string"), "id"), "id", "first", "last", "strand", "product")
    assert got == [(1, 1, 105, "+", "23S ribosomal RNA")] * 2 + [(2, 1, 8, "+", "23S ribosomal RNA")]


def brute_crispr(seq):
    out = []
    for k in range(23, 56):
        at = {}
        for i in range(len(seq) - k + 1):
            at.setdefault(seq[i : i + k], []).append(i)
        for w, p in at.items():
            if len(p) >= 3 and "N" not in w and all(26 <= b - a - k <= 72 for a, b in zip(p, p[1:])):
                out.append((w, p[0] + 1, p[-1] + k, len(p)))
    return sorted(out)


def test_crispr_arrays(spark):
    rng = random.Random(7)

    def bases(n):
        return "".join(rng.choice("ACGT") for _ in range(n))

    unit = bases(28)
    seqs = [bases(90) + "".join(unit + bases(rng.randint(30, 40)) for _ in range(4)) + bases(50), bases(40) + unit + bases(30) + unit, "A" * 200, ""]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)] + [(9, None)], "id long, seq string")
    for chunk in (2000, 45):
        got = rows(an.crispr_arrays(df, "id", chunk=chunk), "id", "repeat", "first", "last", "n_repeats")
        assert got == sorted((i, *r) for i, s in enumerate(seqs) for r in brute_crispr(s)) and got


def test_marker_completeness(spark):
    m = list(an.MARKERS.values())
    df = spark.createDataFrame([("a", m[0] + "AA" + m[1].lower()), ("a", m[1]), ("a", m[2][:10]), ("b", None), ("b", "")], "g string, seq string")
    assert rows(an.marker_completeness(df, ["g"]), "g", "complete", "single", "duplicated", "fragmented", "missing", "total") == [("a", 2, 1, 1, 1, 2, 5), ("b", 0, 0, 0, 0, 5, 5)]


def test_tips_and_bubbles(spark):
    edges = spark.createDataFrame([("s", "a"), ("s", "b"), ("a", "t"), ("b", "c"), ("c", "t"), ("t", "u"), ("x", "s")], "src string, dst string")
    nodes = spark.createDataFrame([(n, 10 if n != "x" else 5000) for n in "sabctux"], "node string, length long")
    assert rows(sc.tips(edges, nodes), "node") == [("u",)]
    assert [tuple(r) for r in sc.bubbles(edges).collect()] == [("s", "u", ["a", "t", "u"], ["b", "c", "t", "u"])]


def test_polished(spark):
    rng = random.Random(3)
    true = "".join(rng.choice("ACGT") for _ in range(200))
    wrong = true[:100] + ("A" if true[100] != "A" else "C") + true[101:]
    reads = [(i, true[s : s + 60]) for i, s in enumerate(range(60, 141, 10))] + [(99, "A" * 60), (100, None)]
    drafts = spark.createDataFrame([(1, wrong), (2, "ACGT" * 10), (3, None)], "id long, seq string")
    got = {r.id: (r.seq, r.n_corrections) for r in sc.polished(drafts, spark.createDataFrame(reads, "read long, seq string"), "id", "read").collect()}
    assert got == {1: (true, 1), 2: ("ACGT" * 10, 0), 3: (None, 0)}


def test_cluster_similarity(spark):
    members = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "c"), (2, "d"), (3, None)], "cluster long, gene string")
    similar = spark.createDataFrame([("a", "c", 0.9), ("d", "b", 0.6), ("a", "d", 0.5)], "gene1 string, gene2 string, score double")
    pairs = spark.createDataFrame([(1, 2), (2, 1), (1, 3)], "cluster1 long, cluster2 long")
    assert rows(an.cluster_similarity(members, similar, pairs), "cluster1", "cluster2", "matched", "similarity") == [(1, 2, 2, 1.0), (1, 3, 0, 0.0), (2, 1, 2, 1.0)]


def test_lipids_ages_and_entries(spark):
    lipids = spark.createDataFrame([("s", "PC(16:0/18:2)", 2.0), ("s", "TG(18:1/18:1/20:4)", 3.0), ("s", "none", 5.0), ("s", None, 1.0)], "sample string, feature string, value double")
    assert rows(an.fatty_acids(lipids), "sample", "saturated", "monounsaturated", "polyunsaturated") == [("s", 2.0, 6.0, 5.0)]
    long = spark.createDataFrame([("s", "p", 1.0), ("s", "q", 9.0), ("t", "p", -9.0)], "sample string, feature string, value double")
    ages = dict(rows(an.methylation_age(long, spark.createDataFrame([("p", 2.0)], "feature string, weight double")), "sample", "age"))
    assert abs(ages["s"] - (21 + 50 * 0.7615941559)) < 1e-5 and ages["t"] == 0.0
    one = spark.createDataFrame([(7, "T", [("Roe", "J"), ("Poe", "E")], "J", None, None)], "pmid long, title string, authors array<struct<last_name:string,first_name:string>>, journal string, year int, doi string")
    assert an.bibtex(one).first().entry == "@article{7,\n  title = {T},\n  author = {Roe, J and Poe, E},\n  journal = {J},\n  year = {n.d.},\n  pmid = {7},\n}"


def test_rank_assemblies(spark):
    got = sc.rank_assemblies(spark.createDataFrame([("a", "ACGTN"), ("a", "ACG"), ("a", None), ("b", "A" * 10)], "name string, seq string"), "name")
    found = {r.name: (r.n50, r.n, r.n_percent, round(r.score, 9)) for r in got.collect()}
    assert found == {"a": (5, 2, 12.5, round(5 * 0.3e-6 + 8 * 0.2e-9 - 2e-4 - 1.25, 9)), "b": (10, 1, 0.0, round(3e-6 + 2e-9 - 1e-4, 9))}


def test_fill_gaps(spark):
    rng = random.Random(11)
    true = "".join(rng.choice("ACGT") for _ in range(160))
    turned = true[70:120][::-1].translate(str.maketrans("ACGT", "TGCA"))
    parts = [(1, 0, true[:50], "+", 0), (1, 1, turned, "-", 20), (1, 2, true[125:], "+", 5), (2, 0, true[:50], "+", 0), (2, 1, true[70:120], "+", 100), (3, 0, "ACGT", "+", 0), (3, 1, None, "+", 9)]
    reads = [(5, true[20:100].lower()), (4, true[60:90]), (6, true), (7, None), (8, "")]
    df = sc.fill_gaps(spark.createDataFrame(parts, "scaffold long, i int, seq string, orientation string, gap int"), spark.createDataFrame(reads, "read long, seq string"), "read")
    assert rows(df, "scaffold", "i", "read", "fill") == [(1, 1, 5, true[50:70]), (1, 2, 6, true[120:125])]
