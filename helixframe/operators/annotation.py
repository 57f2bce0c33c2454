"""Annotation of proteins by motifs and composition, of contigs by RNA signals, and marker completeness of assemblies.

Proteins and contigs of null sequences have no hits and null terms; letter case does not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from helixframe.functions import sequence as sq
from helixframe.operators.graph import settled

# Fixed values, all tables down to MARKERS: screening motifs of domains (identifier, name, description, motif, score, e-value), of orthology groups and
# enzymes, pathways of orthology groups, category names, conserved stretches of ribosomal genes with their least lengths, marker stretches of assemblies.
PROFILES = (
    ("PF00069", "Pkinase", "Protein kinase domain", "GAGGV", 42.0, 2e-5),
    ("PF00001", "Rhodopsin", "7 transmembrane receptor", "DRYLAIV", 30.0, 5e-4),
    ("PF00076", "RRM_1", "RNA recognition motif", "RNPXKG", 28.0, 1e-3),
)
ORTHOLOGY = (("MEEPQ", "K04451"), ("GAGGV", "K00001"))
PATHWAYS = {"K00001": ["map00010", "map00071"], "K00002": ["map00010"], "K04451": ["map04115"]}
ORTHOLOGY_ENZYMES = {"K00001": "1.1.1.1", "K00002": "1.1.1.2"}
ENZYME_MOTIFS = (("GAGGV", "2.7.11.1"), ("GHSAG", "3.1.1.3"))
RIBOSOMAL = (("16S", 1400, "GGATTAGATACCC"), ("16S", 1400, "TTTAATTGACTCAACG"), ("23S", 2800, "GACTAAGG"), ("23S", 2800, "GTCCTGACT"))
MARKERS = {"18S_euk_5prime": "GTAGTCATATGCTTGTCTC", "28S_euk_core": "ACCTGTTGATCCGCCA", "16S_bact_conserved": "AGAGTTTGATCCTGGCTCAG", "rpoB_seed": "ATGGCAATCGCTGAA", "gyrB_seed": "ATGAGCGATCTGGCG"}

#: Lengths of the window that is scored as a transfer RNA and of the one that is reported, and the score to exceed.
TRNA_WINDOW, TRNA_LENGTH, TRNA_SCORE = 95, 75, 50


def profile_hits(df: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """(key, domain_id, name, start, end, score, evalue, coverage), the first place of each motif a protein holds."""
    s = F.upper(seq)
    hits = F.array(*(F.struct(F.lit(i).alias("domain_id"), F.lit(n).alias("name"), (F.instr(s, m) - 1).cast("long").alias("start"), F.lit(len(m)).cast("long").alias("size"), F.lit(v).alias("score"), F.lit(e).alias("evalue")) for i, n, _, m, v, e in PROFILES))
    found = df.select(key, F.length(s).alias("_n"), F.explode(F.filter(hits, lambda h: h["start"] >= 0)).alias("h"))
    return found.select(key, "h.domain_id", "h.name", "h.start", (F.col("h.start") + F.col("h.size")).alias("end"), "h.score", "h.evalue", (F.col("h.size") / F.col("_n")).alias("coverage"))


def _first_motif(s: Column, table) -> Column:
    out = F.lit(None).cast("string")
    for motif, value in reversed(table):
        out = F.when(s.contains(motif), value).otherwise(out)
    return out


def protein_terms(df: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """(key, product, confidence, go_terms, ko, pathways, kegg_enzyme, cog, cog_category, enzyme), from motifs and composition.

    The product is that of the matched domain with the least e-value. An empty sequence has no GO terms and no COG.
    """
    s = F.upper(seq)
    n = F.length(s)

    def share(chars: str) -> Column:
        return sq.count_of(s, chars) / n

    best = F.lit(None).cast("struct<product:string,confidence:double>")
    for _, _, text, motif, score, _ in sorted(PROFILES, key=lambda p: -p[5]):
        best = F.when(s.contains(motif), F.struct(F.lit(f"{text}-containing protein").alias("product"), F.lit(min(1.0, score / 100)).alias("confidence"))).otherwise(best)
    terms = F.when(share("C") > 0.08, F.array(F.lit("GO:0005576"), F.lit("GO:0008150"))).when(s.contains("RRRK") | s.contains("KRAR"), F.array(F.lit("GO:0003677"), F.lit("GO:0006355"), F.lit("GO:0008150")))
    terms = terms.when(s.contains("DE") & (share("E") > 0.12), F.array(F.lit("GO:0003824"), F.lit("GO:0008150"))).otherwise(F.array(F.lit("GO:0008150")))
    cog = F.when(share("AILVFWYM") > 0.34, F.struct(F.lit("COG0207").alias("id"), F.lit("M").alias("category"))).when(share("DEKRH") > 0.22, F.struct(F.lit("COG0533").alias("id"), F.lit("T").alias("category"))).otherwise(F.struct(F.lit("COG0539").alias("id"), F.lit("S").alias("category")))
    ko = _first_motif(s, ORTHOLOGY)
    pathways = F.create_map(*(x for k, v in PATHWAYS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    enzymes = F.create_map(*(F.lit(x) for pair in ORTHOLOGY_ENZYMES.items() for x in pair))
    out = df.select(key, best.alias("_b"), F.when(n > 0, terms).alias("go_terms"), ko.alias("ko"), F.when(n > 0, cog).alias("_c"), _first_motif(s, ENZYME_MOTIFS).alias("enzyme"))
    return out.select(key, "_b.product", F.when(F.col("go_terms").isNull(), F.lit(None)).otherwise(F.coalesce("_b.confidence", F.lit(0.0))).alias("confidence"), "go_terms", "ko", F.try_element_at(pathways, F.col("ko")).alias("pathways"), F.try_element_at(enzymes, F.col("ko")).alias("kegg_enzyme"), F.col("_c.id").alias("cog"), F.col("_c.category").alias("cog_category"), "enzyme")


def both_strands(df: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """(key, n, strand, s): each sequence and its reverse complement."""
    s = F.upper(seq)
    strands = F.array(F.struct(F.lit("+").alias("strand"), s.alias("s")), F.struct(F.lit("-").alias("strand"), sq.reverse_complement(s).alias("s")))
    return df.select(key, F.length(seq).alias("n"), F.explode(strands).alias("_x")).select(key, "n", "_x.strand", "_x.s")


def chunks(df: DataFrame, seq: str, size: int, overlap: int) -> DataFrame:
    """Cuts `seq` into overlapping parts of size + overlap at every `size` (column `offset`), so that windows of a chromosome are no single row's work."""
    cuts = F.when(F.length(seq) > 0, F.sequence(F.lit(0), F.length(seq) - 1, F.lit(size)))
    parts = F.transform(cuts, lambda o: F.struct(o.alias("offset"), F.substring(F.col(seq), o + 1, F.lit(size + overlap)).alias("part")))
    return df.withColumn("_p", F.explode(parts)).drop(seq).select("*", "_p.offset", F.col("_p.part").alias(seq)).drop("_p")


def _placed(found: DataFrame, key: str, *columns: str) -> DataFrame:
    """From (n, strand, start, end) on the strand, from 0, to (start from 1, end) on the forward strand."""
    back = F.col("strand") == "-"
    return found.select(key, F.when(back, F.col("n") - F.col("end") + 1).otherwise(F.col("start") + 1).cast("long").alias("first"), F.when(back, F.col("n") - F.col("start")).otherwise(F.col("end")).cast("long").alias("last"), "strand", *columns)


def trna_windows(part: str, chunk: int, rest: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and scores of the windows of a part that score above 50; `rest` bases are left from its start to the contig's end."""
    b = np.frombuffer(part.encode("ascii", "replace"), np.uint8)
    i = np.arange(max(0, min(chunk, rest - 73)))
    pairs = np.zeros((256, 256), bool)
    for x, y in (b"AT", b"TA", b"GC", b"CG", b"GT", b"TG"):
        pairs[x, y] = True
    score = sum((5 * pairs[b[i + j], b[i + 71 - j]] for j in range(7)), np.zeros(len(i), np.int64))
    end = np.minimum(i + TRNA_WINDOW, len(b))
    cca = (b[end - 3] == ord("C")) & (b[end - 2] == ord("C")) & (b[end - 1] == ord("A"))
    score = score + 20 * cca + 10 * (b[i + 7] == ord("T")) + 10 * (b[i + 13] == ord("A"))
    keep = score > TRNA_SCORE
    return i[keep], score[keep]


def transfer_rna(df: DataFrame, key: str, seq: str = "seq", chunk: int = 20000) -> DataFrame:
    """(key, first, last, strand, score, anticodon) of windows that score above 50.

    20 for a final CCA, 10 each for T at place 8 and A at place 14, 5 for each pair of the acceptor stem (places 1 to 7 with 72 to 66; G pairs with T too).
    """
    def scan(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                i, score = trna_windows(row.s, chunk, row.n - row.offset)
                if len(i):
                    start = row.offset + i
                    yield pd.DataFrame({key: [row[0]] * len(i), "n": row.n, "strand": row.strand, "start": start, "end": start + TRNA_LENGTH, "score": score.astype(float), "anticodon": [row.s[a + 33 : a + 36] for a in i]})

    cut = chunks(both_strands(df, key, seq), "s", chunk, TRNA_WINDOW - 1).select(key, "n", "strand", F.col("offset").cast("long").alias("offset"), "s")
    kind = df.schema[key].dataType.simpleString()
    hits = cut.mapInPandas(scan, f"`{key}` {kind}, n long, strand string, start long, end long, score double, anticodon string")
    return _placed(hits, key, "score", "anticodon")


def occurrences(seq: str, motif: str) -> Column:
    """Starts, from 0, of all occurrences of a plain motif, overlapping ones too."""
    parts = F.split(seq, f"(?={motif})", -1)  # every part but the first begins at an occurrence
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("hits"))
    later = F.aggregate(F.slice(parts, 1, F.size(parts) - 1), state, lambda a, p: F.struct((a["at"] + F.length(p)).alias("at"), F.array_append(a["hits"], a["at"] + F.length(p)).alias("hits")), lambda a: a["hits"])
    return F.when(F.col(seq).startswith(motif), F.array_prepend(later, F.lit(0))).otherwise(later)


def ribosomal_rna(df: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """(key, first, last, strand, product, score): half the least gene length to both sides of each conserved stretch, cut at the contig's ends.

    The score is 12 for each base of the stretch and 0.02 for each of the span (60 at most), 100 at most.
    """
    def stretch(kind: str, least: int, motif: str) -> Column:
        return F.transform(occurrences("s", motif), lambda at: F.struct(at.alias("at"), F.lit(f"{kind} ribosomal RNA").alias("product"), F.lit(least // 2).alias("half"), F.lit(12.0 * len(motif)).alias("base")))

    hits = F.flatten(F.array(*(stretch(*r) for r in RIBOSOMAL)))
    found = both_strands(df, key, seq).select(key, "n", "strand", F.explode(hits).alias("h"))
    found = found.select(key, "n", "strand", F.greatest(F.lit(0), F.col("h.at") - F.col("h.half")).alias("start"), F.least("n", F.col("h.at") + F.col("h.half")).alias("end"), "h.product", "h.base")
    score = F.least(F.lit(100.0), F.col("base") + F.least(F.lit(60.0), F.greatest(F.lit(1), F.col("end") - F.col("start")) * 0.02))
    return _placed(found.withColumn("score", score), key, "product", "score")


def near_heads(parts: DataFrame, key: str, size: int, within: int) -> DataFrame:
    """(key, head): the words of `size` letters that recur at most `within` places on in a part (column s). Told apart by hashes, so a few others may be among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found = [], []
            for k, s in enumerate(batch.column(1).to_pylist()):
                letters = np.frombuffer(s.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
                n = len(letters) - size + 1
                if n < 2:
                    continue
                code = np.zeros(n, dtype=np.uint64)
                for j in range(size):
                    code = code * np.uint64(0x9E3779B97F4A7C15) + letters[j : j + n]
                order = np.argsort(code, kind="stable")
                again = (code[order][1:] == code[order][:-1]) & (np.diff(order) <= within)
                words = {s[i : i + size] for i in order[1:][again]}
                keys += [k] * len(words)
                found += sorted(words)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), pa.array(found, pa.string())], names=[key, "head"])

    return parts.select(key, "s").mapInArrow(run, StructType([parts.schema[key], StructField("head", StringType())])).distinct()


#: Letters of a contig whose words one task compares; longer ones are cut and shuffled.
WHOLE = 1 << 20


def word_classes(letters: np.ndarray, longest: int) -> dict[int, np.ndarray]:
    """For the powers of two up to `longest` the words of so many letters at each place as numbers, equal ones for equal words only."""
    found, size = {1: np.unique(letters, return_inverse=True)[1]}, 1
    while size * 2 <= min(longest, len(letters)):
        one = found[size]
        found[size * 2] = np.unique(one[:-size] * len(letters) + one[size:], return_inverse=True)[1]
        size *= 2
    return found


def spaced_words(s: str, repeat: tuple[int, int], spacer: tuple[int, int], least: int) -> list[tuple[str, int, int, int]]:
    """(word, first, last, n) of the words without N found `least` times or more, all gaps between neighbours a spacer's length; places from 1."""
    letters = np.frombuffer(s.encode("utf-32-le"), dtype=np.uint32)
    short, n = repeat[0], len(letters)
    code = letters.astype(np.uint64)
    for _ in range(short - 1):  # hashes of the shortest words, to leave out at once what does not recur nearby
        code = code[:-1] * np.uint64(0x9E3779B97F4A7C15) + letters[n - len(code) + 1 :].astype(np.uint64)
    if len(code) < 2:
        return []
    order = np.argsort(code, kind="stable")
    new = np.concatenate([[True], code[order][1:] != code[order][:-1]])
    near = np.concatenate([[False], np.diff(order) <= spacer[1] + repeat[1]]) & ~new
    if not near.any():
        return []
    group = np.cumsum(new) - 1
    some = np.bincount(group, near) > 0
    at = np.sort(order[some[group]])
    classes, unknown = word_classes(letters, repeat[1]), np.concatenate([[0], np.cumsum(letters == ord("N"))])
    found = []
    for size in range(short, min(repeat[1], n) + 1):
        at = at[at + size <= n]
        at = at[unknown[at + size] == unknown[at]]
        half = 1 << size.bit_length() - 1
        word = classes[half][at] * n + classes[half][at + size - half]
        order = np.argsort(word, kind="stable")
        places, first = at[order], np.flatnonzero(np.concatenate([[True], word[order][1:] != word[order][:-1]])) if len(at) else np.zeros(0, int)
        if not len(first):
            break
        count, gap = np.diff(np.append(first, len(places))), np.diff(places) - size
        wrong = np.concatenate([[0], np.cumsum((gap < spacer[0]) | (gap > spacer[1]))])
        last = first + count - 1
        for a, b in zip(first, last):
            if b - a + 1 >= least and wrong[b] == wrong[a]:
                found.append((s[places[a] : places[a] + size], int(places[a]) + 1, int(places[b]) + size, int(b - a + 1)))
    return found


def crispr_arrays(df: DataFrame, key: str, seq: str = "seq", repeat: tuple[int, int] = (23, 55), spacer: tuple[int, int] = (26, 72), least: int = 3, chunk: int = 2000) -> DataFrame:
    """(key, repeat, first, last, n_repeats): words without N found `least` times or more in a contig, with every gap between neighbours a spacer's length.

    Words of a contig of up to WHOLE letters are compared where it is read, nothing is shuffled for it; longer ones are cut (`arrays_in_parts`).
    """
    named = df.select(key, F.upper(seq).alias("s")).where(F.col(key).isNotNull() & F.col("s").isNotNull())
    most = WHOLE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, rows = [], []
            for k, s in enumerate(batch.column(1).to_pylist()):
                found = [(None, 0, 0, 0)] if len(s) > most else spaced_words(s, repeat, spacer, least)  # a row without a word stands for a long contig
                owners += [k] * len(found)
                rows += found
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owners, pa.int64())), *columns], names=[key, "repeat", "first", "last", "n_repeats"])

    kind = named.schema[key].dataType.simpleString()
    found = settled(named.mapInArrow(run, f"`{key}` {kind}, repeat string, first long, last long, n_repeats long"))
    arrays, long = found.where("repeat IS NOT NULL"), found.where("repeat IS NULL").select(key).distinct()
    if not long.take(1):
        return arrays
    return arrays.unionByName(arrays_in_parts(df.join(long, key, "left_semi"), key, seq, repeat, spacer, least, chunk))


def arrays_in_parts(df: DataFrame, key: str, seq: str = "seq", repeat: tuple[int, int] = (23, 55), spacer: tuple[int, int] = (26, 72), least: int = 3, chunk: int = 2000) -> DataFrame:
    """`crispr_arrays` of contigs of any length, by their parts.

    A longer word repeats only where its first letters do, and its neighbours are no further apart than its length and a spacer. So only places of
    shortest words that recur so near (`near_heads`) are widened to the other lengths, and contigs without such words are not shuffled.
    """
    short, longest = repeat
    named = df.select(key, F.upper(seq).alias("s"), F.length(seq).alias("n")).where(F.col(key).isNotNull())
    heads = settled(near_heads(chunks(named, "s", chunk, spacer[1] + longest + short), key, short, spacer[1] + longest))
    cut = chunks(named.join(heads.select(key).distinct(), key, "left_semi"), "s", chunk, longest - 1)
    starts = sq.positions(F.least(F.lit(chunk), F.col("n") - F.col("offset") - short + 1))
    places = cut.select(key, "offset", F.explode(F.transform(starts, lambda i: F.struct(i.alias("i"), F.substring(F.col("s"), i, F.lit(longest)).alias("w")))).alias("h"))
    places = places.select(key, (F.col("offset") + F.col("h.i") - 1).alias("at"), "h.w").where(~F.substring("w", 1, short).contains("N"))
    seen = places.withColumn("head", F.substring("w", 1, short)).join(heads, [key, "head"], "left_semi")
    sizes = F.sequence(F.lit(short), F.length("w"))
    words = seen.select(key, "at", F.explode(F.transform(sizes, lambda k: F.substring(F.col("w"), F.lit(1), k))).alias("repeat")).where(~F.col("repeat").contains("N"))
    gap = F.col("at") - F.lag("at").over(Window.partitionBy(key, "repeat").orderBy("at")) - F.length("repeat")
    found = words.withColumn("gap", gap).groupBy(key, "repeat").agg((F.min("at") + 1).cast("long").alias("first"), (F.max("at") + F.length("repeat")).cast("long").alias("last"), F.count("*").alias("n_repeats"), F.min("gap").alias("_a"), F.max("gap").alias("_b"))
    return found.where((F.col("n_repeats") >= least) & (F.col("_a") >= spacer[0]) & (F.col("_b") <= spacer[1])).drop("_a", "_b")


def marker_completeness(df: DataFrame, group: list[str], seq: str = "seq", markers: dict[str, str] = MARKERS) -> DataFrame:
    """(group, complete, single, duplicated, fragmented, missing, total) of marker stretches; a marker is fragmented where only one of its halves is found.

    Occurrences are counted within contigs, without overlaps, and never across the joint of two contigs.
    """
    s = F.upper(seq)
    halves = {m: (w[: len(w) // 2], w[-(len(w) // 2) :]) for m, w in markers.items()}
    counts = df.groupBy(*group).agg(*(F.coalesce(F.sum(F.regexp_count(s, F.lit(w))), F.lit(0)).alias(f"n_{m}") for m, w in markers.items()), *(F.coalesce(F.bool_or(s.contains(a) | s.contains(b)), F.lit(False)).alias(f"part_{m}") for m, (a, b) in halves.items()))

    def how_many(condition) -> Column:
        return sum((F.when(condition(F.col(f"n_{m}"), F.col(f"part_{m}")), 1).otherwise(0) for m in markers), F.lit(0)).cast("long")

    single, duplicated, part = how_many(lambda n, p: n == 1), how_many(lambda n, p: n > 1), how_many(lambda n, p: (n == 0) & p)
    return counts.select(*group, (single + duplicated).alias("complete"), single.alias("single"), duplicated.alias("duplicated"), part.alias("fragmented"), (F.lit(len(markers)) - single - duplicated - part).alias("missing"), F.lit(len(markers)).cast("long").alias("total"))


def cluster_similarity(members: DataFrame, similar: DataFrame, pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(cluster1, cluster2, matched, similarity) of given pairs of clusters, from members (cluster, gene) and gene similarities (gene1, gene2, score).

    matched: genes of the first cluster with a gene of the second more similar than the threshold, in either order of the two genes (the order of
    the table first, the other only where that has no score or 0). The similarity is matched of both sizes less matched; 0 for empty clusters.
    """
    genes = members.where("gene IS NOT NULL").select("cluster", "gene").distinct()
    sizes = genes.groupBy("cluster").agg(F.count("*").alias("n"))
    turned = similar.select(F.col("gene2").alias("gene1"), F.col("gene1").alias("gene2"), F.lit(0.0).alias("first"), F.col("score").alias("second"))
    scores = similar.select("gene1", "gene2", F.col("score").alias("first"), F.lit(0.0).alias("second")).unionByName(turned).groupBy("gene1", "gene2").agg(F.max("first").alias("first"), F.max("second").alias("second"))
    close = scores.where(F.when(F.col("first") != 0, F.col("first")).otherwise(F.col("second")) > threshold).select("gene1", "gene2")
    one = pairs.select("cluster1", "cluster2").distinct().join(genes.select(F.col("cluster").alias("cluster1"), F.col("gene").alias("gene1")), "cluster1").join(close, "gene1")
    found = one.join(genes.select(F.col("cluster").alias("cluster2"), F.col("gene").alias("gene2")), ["cluster2", "gene2"], "left_semi").groupBy("cluster1", "cluster2").agg(F.count_distinct("gene1").alias("matched"))
    out = pairs.select("cluster1", "cluster2").distinct().join(found, ["cluster1", "cluster2"], "left").withColumn("matched", F.coalesce("matched", F.lit(0)).cast("long"))
    for side in ("1", "2"):
        out = out.join(sizes.select(F.col("cluster").alias(f"cluster{side}"), F.col("n").alias(f"n{side}")), f"cluster{side}", "left")
    union = F.coalesce("n1", F.lit(0)) + F.coalesce("n2", F.lit(0)) - F.col("matched")
    return out.select("cluster1", "cluster2", "matched", F.when(union > 0, F.col("matched") / union).otherwise(0.0).alias("similarity"))


def fatty_acids(long: DataFrame) -> DataFrame:
    """(sample, saturated, monounsaturated, polyunsaturated): values of lipids named like PC(16:0/18:2), added once for each chain by its double bonds."""
    bonds = F.transform(F.regexp_extract_all("feature", F.lit(r"[0-9]+:([0-9]+)"), F.lit(1)), lambda b: b.cast("int"))
    chains = long.select("sample", "value", bonds.alias("b"))

    def total(condition) -> Column:
        return F.coalesce(F.sum(F.size(F.filter("b", condition)) * F.col("value")), F.lit(0.0))

    return chains.groupBy("sample").agg(total(lambda b: b == 0).alias("saturated"), total(lambda b: b == 1).alias("monounsaturated"), total(lambda b: b > 1).alias("polyunsaturated"))


def methylation_age(long: DataFrame, clock: DataFrame) -> DataFrame:
    """(sample, age): 21 and 50 times the hyperbolic tangent of values times the clock's weights (feature, weight), scaled to length 1; from 0 to 110.

    Probes that the clock lacks or a sample misses count nothing.
    """
    length = clock.agg((F.sqrt(F.sum(F.pow("weight", F.lit(2.0)))) + 1e-9).alias("_length"))  # one row
    scores = long.join(clock, "feature").groupBy("sample").agg(F.sum(F.col("value") * F.col("weight")).alias("_s"))
    return scores.crossJoin(F.broadcast(length)).select("sample", F.greatest(F.lit(0.0), F.least(F.lit(110.0), 21.0 + 50.0 * F.tanh(F.col("_s") / F.col("_length")))).alias("age"))


def bibtex(articles: DataFrame) -> DataFrame:
    """(pmid, entry) from articles (pmid, title, authors as an array of (last_name, first_name), journal, year, doi); no year: n.d., no DOI: no such line."""
    names = F.array_join(F.transform(F.coalesce("authors", F.array().cast("array<struct<last_name:string,first_name:string>>")), lambda a: F.concat(a["last_name"], F.lit(", "), a["first_name"])), " and ")

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"\n  {name} = {{"), value, F.lit("},"))

    fields = [line("title", F.coalesce("title", F.lit(""))), line("author", names), line("journal", F.coalesce("journal", F.lit(""))), line("year", F.coalesce(F.col("year").cast("string"), F.lit("n.d."))), line("pmid", F.col("pmid").cast("string"))]
    return articles.select("pmid", F.concat(F.lit("@article{"), F.col("pmid").cast("string"), F.lit(","), *fields, F.coalesce(line("doi", F.col("doi")), F.lit("")), F.lit("\n}")).alias("entry"))
