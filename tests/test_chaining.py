"""Chains of minimizers against the quadratic recurrence."""

import random

from helixframe import catalog
from helixframe.operators import chaining as ch
from helixframe.plans.assembly import _passages
from helixframe.plans.common import text_dna
from tests.test_mapping import bases, changed, reverse


def own_minimizers(s, k, w):
    out = set()
    for i in range(len(s) - k - w + 2):
        window = [(min(x, reverse(x)), j) for j in range(i, i + w) if "N" not in (x := s[j : j + k])]
        if len(window) == w:
            out.add(min(window))
    return out


def own_anchors(reads, contigs, k, w):
    index = {}
    for c, t in contigs.items():
        for m, j in own_minimizers(t, k, w):
            index.setdefault(m, []).append((c, j, t[j : j + k] == m))
    out = set()
    for a, s in reads.items():
        for m, i in own_minimizers(s, k, w):
            for c, j, there in index.get(m, []):
                same = (s[i : i + k] == m) == there
                out.add((a, c, "+" if same else "-", i if same else len(s) - k - i, j))
    return out


def quadratic(anchors, k, least=3):
    """The best chain from each first anchor, by comparing every anchor with all before it."""
    groups = {}
    for a, c, s, q, r in anchors:
        groups.setdefault((a, c, s), []).append((r, q))
    out = set()
    for key, own in groups.items():
        done = []
        best = {}
        for r, q in sorted(own):
            value, n, start = 4 * k, 1, (q, r)
            for q2, r2, score, m, first in done:
                dq, dr = q - q2, r - r2
                if dq > 0 and dr > 0 and max(dq, dr) <= 5000 and abs(dq - dr) < 1000 and score + 4 * min(dq, dr, k) - abs(dq - dr) > value:
                    value, n, start = score + 4 * min(dq, dr, k) - abs(dq - dr), m + 1, first
            done.append((q, r, value, n, start))
            if n >= least:
                best[start] = max(best.get(start, (0,)), (value, n, -r - k, -q - k))
        out |= {(*key, v, n, q, -e, r, -b) for (q, r), (v, n, b, e) in best.items()}
    return out


def plain(df):
    return {tuple(r) for r in df.select("read_id", "contig", "strand", "score", "n", "q_start", "q_end", "r_start", "r_end").collect()}


def test_chains_are_the_quadratic_recurrence(spark):
    rng = random.Random(9)
    genome = bases(rng, 9000)
    contigs = {"g": genome[:8000], "h": reverse(genome[7000:]) + genome[300:700], "n": "N" * 40, "e": ""}
    reads = {}
    for k in range(12):
        i = rng.randrange(6500)
        s = changed(rng, genome[i : i + 900], 25)
        s = s[:300] + bases(rng, rng.choice([0, 40])) + s[300 + rng.choice([0, 60]) :]  # insertions and deletions
        reads[k] = reverse(s) if k % 2 else s
    reads[20] = genome[100:400] + genome[6500:6900]  # further apart than a step
    reads[21], reads[22] = bases(rng, 200), "ACG"
    r = spark.createDataFrame([*reads.items(), (30, None)], "read_id long, seq string")
    c = spark.createDataFrame([*contigs.items(), ("z", None)], "contig string, seq string")
    found = ch.anchors(r, c, k=11, w=5)
    want = own_anchors(reads, contigs, 11, 5)
    assert {tuple(x) for x in found.select("read_id", "contig", "strand", "q", "r").collect()} == want
    got = ch.chains(found, 11, look_back=10_000)
    assert plain(got) == quadratic(want, 11) and len(plain(got)) > 12
    best = {x.read_id: x for x in ch.best_chains(got).collect()}
    assert all(best[k].strand == ("-" if k % 2 else "+") and best[k].contig == "g" and best[k].r_end - best[k].r_start > 600 for k in range(12)) and 22 not in best
    assert plain(ch.chains(found.limit(0), 11)) == set()


def test_the_query_against_the_recurrence(spark):
    sf = "/root/testdata/sf0.001"
    reads = {r.item_id: r.g for r in _passages(spark, sf).collect()}
    contigs = {r.doc_id: r.seq for r in text_dna(spark, sf).collect()}
    want = quadratic(own_anchors(reads, contigs, 15, 10), 15)
    best = {}
    for a, c, s, v, n, q0, q1, r0, r1 in want:
        best[a] = min(best.get(a, (1,)), (-v, c, s, r0, q0, q1, r1, n))
    got = {r.read_id: (-r.score, r.contig, r.strand, r.r_start, r.q_start, r.q_end, r.r_end, r.n) for r in catalog.queries()["chain_reads"](spark, sf).collect()}
    assert got == best and got


def test_minimizers_of_a_sequence_are_those_of_spark(spark):
    from helixframe.operators.sequences import minimizers

    rng = random.Random(4)
    texts = ["".join(rng.choice(letters) for _ in range(n)) for letters in ("ACGT", "AT", "ACGTNU*Ä") for n in (3, 7, 8, 30, 90)] + ["AC" * 40]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, seq string")
    want = sorted(tuple(r) for r in minimizers(rows, "id", 5, 4).select("id", "pos", "kmer").collect())
    got = sorted((i, pos, kmer) for i, t in enumerate(texts) for pos, kmer, _ in ch.sequence_minimizers(t, 5, 4))
    assert got == want
    assert all(as_is == (t[pos : pos + 5] == kmer) for t in texts for pos, kmer, as_is in ch.sequence_minimizers(t, 5, 4))
