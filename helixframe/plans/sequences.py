"""Queries over sequences: DNA made of the documents' digests, and word lengths as read lengths."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions import sequence as sq
from helixframe.operators import sequences as ops
from helixframe.plans.common import DNA, R, dna, integers, query, rounded, table

QUERIES: dict = {}


def add(name: str, make, sql: str | None, *floats: str, ints: tuple[str, ...] = ()) -> None:
    QUERIES[name] = (lambda spark, sf_dir: integers(rounded(make(spark, sf_dir), *floats), *ints), sql)


def on_dna(name: str, make, sql: str | None, *floats: str, ints: tuple[str, ...] = ()) -> None:
    add(name, lambda s, d: make(dna(s, d)), query(DNA, sql=sql) if sql else None, *floats, ints=ints)


_GC = "(length(seq) - length(translate(seq, 'GC', '')))"
_RC = "reverse(translate(seq, 'ACGT', 'TGCA'))"
on_dna("seq_gc_content", lambda x: x.select("doc_id", sq.gc_content("seq").alias("gc")), f"SELECT doc_id, {R(f'{_GC} / length(seq)')} AS gc FROM dna", "gc")
on_dna("seq_reverse_complement", lambda x: x.select("doc_id", sq.complement("seq").alias("comp"), sq.reverse_complement("seq").alias("rc")), f"SELECT doc_id, translate(seq, 'ACGT', 'TGCA') AS comp, {_RC} AS rc FROM dna")
on_dna("seq_transcribe", lambda x: x.select("doc_id", sq.transcribe("seq").alias("rna"), sq.back_transcribe(sq.transcribe("seq")).alias("back")), "SELECT doc_id, replace(seq, 'T', 'U') AS rna, seq AS back FROM dna")
_CODE = "code AS (SELECT unnest([" + ",".join(f"'{c}'" for c in sq.CODONS) + "]) AS codon, unnest([" + ",".join(f"'{a}'" for a in sq.CODONS.values()) + "]) AS aa)"
_TRANSLATED = "SELECT doc_id, string_agg(aa, '' ORDER BY i) AS protein FROM (SELECT doc_id, i, substr({s}, i * 3 + 1 + {f}, 3) AS codon FROM dna, (SELECT unnest(range(0, 21)) AS i)) JOIN code USING (codon) GROUP BY doc_id"
for _f in range(3):
    on_dna(f"seq_translate_frame{_f}", lambda x, f=_f: x.select("doc_id", sq.translate("seq", f).alias("protein")), None)
    QUERIES[f"seq_translate_frame{_f}"] = (QUERIES[f"seq_translate_frame{_f}"][0], query(DNA, _CODE, sql=_TRANSLATED.format(s="seq", f=_f)))
add("seq_translate_to_stop", lambda s, d: dna(s, d).select("doc_id", sq.translate("seq", 0, True).alias("protein")), query(DNA, _CODE, sql=f"SELECT doc_id, split_part(protein, '*', 1) AS protein FROM ({_TRANSLATED.format(s='seq', f=0)})"))
_FRAMES = " UNION ALL ".join(f"SELECT doc_id, '{'+-'[_m]}{_f + 1}' AS frame, protein FROM ({_TRANSLATED.format(s=('seq', _RC)[_m], f=_f)})" for _m in range(2) for _f in range(3))
add("seq_six_frames", lambda s, d: dna(s, d).select("doc_id", F.explode(sq.six_frames("seq")).alias("frame", "protein")), query(DNA, _CODE, sql=_FRAMES))
on_dna("seq_composition", lambda x: x.groupBy("lang").agg(*(F.sum(sq.count_of("seq", b)).alias(b.lower()) for b in "ACGT")), "SELECT lang, " + ", ".join(f"sum(length(seq) - length(replace(seq, '{b}', '')))::BIGINT AS {b.lower()}" for b in "ACGT") + " FROM dna GROUP BY lang")
on_dna("seq_frequency", lambda x: x.select("doc_id", F.explode(sq.frequency("seq", "ACGT")).alias("base", "share")), "SELECT doc_id, base, " + R("(length(seq) - length(replace(seq, base, ''))) / length(seq)") + " AS share FROM dna, (SELECT unnest(['A', 'C', 'G', 'T']) AS base)", "share")
on_dna("seq_find", lambda x: x.select("doc_id", sq.find("seq", "ACG").alias("first"), sq.count_pattern("seq", "AC").alias("n"), F.size(sq.find_all("seq", "AA")).cast("long").alias("overlapping")), "SELECT doc_id, strpos(seq, 'ACG')::BIGINT - 1 AS first, ((length(seq) - length(replace(seq, 'AC', ''))) / 2)::BIGINT AS n, (SELECT count(*) FROM (SELECT unnest(range(1, 64)) AS i) WHERE substr(seq, i, 2) = 'AA') AS overlapping FROM dna")
on_dna("seq_subsequence", lambda x: x.select("doc_id", sq.subsequence("seq", 10, 25).alias("part"), sq.generated_id("seq").alias("id")), "SELECT doc_id, substr(seq, 11, 15) AS part, 'seq_' || substr(md5(seq), 1, 8) AS id FROM dna")
on_dna("seq_type", lambda x: x.select("doc_id", sq.sequence_type("seq").alias("kind"), sq.sequence_type(sq.transcribe("seq")).alias("kind_rna"), sq.is_valid("seq", "ACGT").alias("valid")), "SELECT doc_id, 'dna' AS kind, CASE WHEN seq LIKE '%T%' THEN 'rna' ELSE 'dna' END AS kind_rna, true AS valid FROM dna")
on_dna("seq_melting_temperature", lambda x: x.select("doc_id", sq.melting_temperature("seq").alias("tm"), sq.melting_temperature(F.substring("seq", 1, 12)).alias("tm_short"), sq.melting_temperature("seq", "salt_adjusted").alias("tm_salt")), f"SELECT doc_id, {R(f'64.9 + 41.0 * ({_GC} / length(seq) - 0.41) - 500.0 / length(seq)')} AS tm, {R('''(2.0 * (12 - g) + 4.0 * g)::DOUBLE''')} AS tm_short, {R(f'81.5 + 16.6 * log10(0.05) + 41.0 * {_GC} / length(seq) - 500.0 / length(seq)')} AS tm_salt FROM (SELECT *, 12 - length(translate(substr(seq, 1, 12), 'GC', '')) AS g FROM dna)", "tm", "tm_short", "tm_salt")
on_dna("seq_restriction_sites", lambda x: x.select("doc_id", F.explode(sq.restriction_sites("seq", {"AluI": "AGCT", "HinfI": "GANTC"})).alias("s")).select("doc_id", "s.enzyme", F.col("s.start").cast("long").alias("start"), "s.text"), "SELECT doc_id, enzyme, i::BIGINT - 1 AS start, substr(seq, i, n) AS text FROM dna, (SELECT unnest(['AluI', 'HinfI']) AS enzyme, unnest(['AGCT', 'GA[ACGT]TC']) AS p, unnest([4, 5]) AS n), (SELECT unnest(range(1, 65)) AS i) WHERE length(substr(seq, i, n)) = n AND regexp_full_match(substr(seq, i, n), p)")
on_dna("seq_homopolymers", lambda x: x.select("doc_id", F.explode(sq.homopolymers("seq", 3)).alias("run")).groupBy(F.substring("run", 1, 1).alias("base"), F.length("run").cast("long").alias("size")).agg(F.count("*").alias("n")), "SELECT base, len AS size, count(*) AS n FROM (SELECT doc_id, base, count(*) AS len FROM (SELECT doc_id, i, substr(seq, i, 1) AS base, i - row_number() OVER (PARTITION BY doc_id, substr(seq, i, 1) ORDER BY i) AS g FROM dna, (SELECT unnest(range(1, 65)) AS i)) GROUP BY doc_id, base, g HAVING count(*) >= 3) GROUP BY 1, 2")
_N = "(length(seq) - length(replace(seq, '{}', '')))"
on_dna("seq_molecular_weight", lambda x: x.select("doc_id", sq.molecular_weight("seq", "dna").alias("dna"), sq.molecular_weight(sq.transcribe("seq"), "rna").alias("rna")), "SELECT doc_id, " + R(" + ".join(f"{_N.format(b)} * {m}" for b, m in (("A", 313.21), ("T", 304.19), ("G", 329.21), ("C", 289.18))) + " - 61.97 * (length(seq) - 1)") + " AS dna, " + R(" + ".join(f"{_N.format(b)} * {m}" for b, m in (("A", 329.21), ("T", 306.17), ("G", 345.21), ("C", 305.18))) + " - 61.97 * (length(seq) - 1)") + " AS rna FROM dna", "dna", "rna")
_NN = "(VALUES ('AA', -7.9, -22.2), ('TT', -7.9, -22.2), ('AT', -7.2, -20.4), ('TA', -7.2, -21.3), ('CA', -8.5, -22.7), ('TG', -8.5, -22.7), ('GT', -8.4, -22.4), ('AC', -8.4, -22.4), ('CT', -7.8, -21.0), ('AG', -7.8, -21.0), ('GA', -8.2, -22.2), ('TC', -8.2, -22.2), ('CG', -10.6, -27.2), ('GC', -9.8, -24.4), ('GG', -8.0, -19.9), ('CC', -8.0, -19.9)) AS nn(pair, h, s)"
on_dna("seq_melting_nearest_neighbour", lambda x: x.select("doc_id", sq.melting_temperature("seq", "nearest_neighbor").alias("tm")), f"SELECT doc_id, {R('1000 * (0.2 + sum(h)) / (-5.7 + sum(s) + 0.368 * 63 * ln(0.05) + 1.987 * ln(0.25e-6 / 4)) - 273.15')} AS tm FROM dna, (SELECT unnest(range(1, 64)) AS i), {_NN} WHERE pair = substr(seq, i, 2) GROUP BY doc_id", "tm")
_PROTEIN = query(DNA, _CODE, "prot AS (" + _TRANSLATED.format(s="seq", f=0) + ")", sql="{}")


def on_protein(name: str, expr, sql: str, *floats: str) -> None:
    add(name, lambda s, d: dna(s, d).select("doc_id", sq.translate("seq").alias("protein")).select("doc_id", *expr()), _PROTEIN.format(sql), *floats)


on_protein("protein_weight", lambda: [sq.molecular_weight("protein").alias("weight")], "SELECT doc_id, " + R(" + ".join(f"(length(protein) - length(replace(protein, '{a}', ''))) * {m}" for a, m in sq.RESIDUE_MASS.items()) + " - 18.015 * (length(protein) - 1)") + " AS weight FROM prot", "weight")
on_protein("protein_hydropathy", lambda: [sq.mean_hydropathy("protein").alias("gravy"), sq.aromaticity("protein").alias("aromaticity"), sq.instability_index("protein").alias("instability")], "SELECT doc_id, " + R("(" + " + ".join(f"(length(protein) - length(replace(protein, '{a}', ''))) * {m}" for a, m in sq.HYDROPATHY.items()) + ") / length(protein)") + " AS gravy, " + R("(length(protein) - length(translate(protein, 'FWY', ''))) / length(protein)") + " AS aromaticity, " + R("10.0 / length(protein) * (length(protein) - 1)") + " AS instability FROM prot", "gravy", "aromaticity", "instability")
on_protein("protein_isoelectric_point", lambda: [sq.isoelectric_point("protein").alias("pi")], "", "pi")
QUERIES["protein_isoelectric_point"] = (QUERIES["protein_isoelectric_point"][0], None)
on_protein("protein_domains", lambda: [F.explode(sq.protein_domains("protein")).alias("d")], "")
QUERIES["protein_domains"] = (QUERIES["protein_domains"][0], None)
on_protein("protein_hydrophobicity_profile", lambda: [F.posexplode(sq.hydrophobicity_profile("protein", 9)).alias("pos", "value")], "")
QUERIES["protein_hydrophobicity_profile"] = (QUERIES["protein_hydrophobicity_profile"][0], None)
_MOTIFS = "(VALUES ('TATA_box', 'TATA[AT]A[AT]', 7), ('CAAT_box', 'GG[TC]CAATCT', 9), ('GC_box', 'GGGCGG', 6), ('initiator', '[CT][CT]A[ACGT]T[CT][CT]', 7), ('BRE', '[GC][GC][GA]CGCC', 7), ('DPE', '[AG]G[AT][CT][GT]', 5)) AS motifs(motif, p, n)"
on_dna("seq_promoter_elements", lambda x: x.select("doc_id", F.explode(sq.promoter_elements("seq")).alias("m")).select("doc_id", "m.motif", F.col("m.start").cast("long").alias("start")), f"SELECT doc_id, motif, (list_sum(list_transform(parts[1:k], lambda x: length(x))) + (k - 1) * n)::BIGINT AS start FROM (SELECT doc_id, motif, n, regexp_split_to_array(seq, p) AS parts, unnest(range(1, len(regexp_extract_all(seq, p)) + 1)) AS k FROM dna, {_MOTIFS})")
_LEVELS = {"helix": "A1.42 L1.21 E1.51 M1.45 Q1.11 K1.16 R0.98 H1.00 V1.06 I1.08 Y0.69 C0.70 W1.08 F1.13 T0.83 G0.57 N0.67 P0.57 S0.77 D1.01", "sheet": "V1.70 I1.60 Y1.47 F1.38 W1.37 L1.30 T1.19 C1.19 M1.05 A0.83 R0.93 G0.75 D0.54 K0.74 S0.75 H0.87 N0.89 Q1.10 P0.55 E0.37"}
_SHARES = {n: "(" + " + ".join(f"(length(protein) - length(replace(protein, '{x[0]}', ''))) * {x[1:]}" for x in v.split()) + " + length(translate(protein, 'ALEMQKRHVIYCWFTGNPSD', ''))) / length(protein)" for n, v in _LEVELS.items()}
on_protein("protein_structure_propensity", lambda: [F.col("s.helix").alias("helix"), F.col("s.sheet").alias("sheet"), F.col("s.coil").alias("coil")], "SELECT doc_id, " + ", ".join(f"{R(e)} AS {n}" for n, e in {**_SHARES, "coil": f"3.0 - {_SHARES['helix']} - {_SHARES['sheet']}"}.items()) + " FROM prot", "helix", "sheet", "coil")
QUERIES["protein_structure_propensity"] = (lambda s, d: rounded(dna(s, d).select("doc_id", F.explode(F.array(sq.translate("seq"))).alias("protein")).select("doc_id", sq.structure_propensity("protein").alias("s")).select("doc_id", "s.helix", "s.sheet", "s.coil"), "helix", "sheet", "coil"), QUERIES["protein_structure_propensity"][1])
add("quality_by_position", lambda s, d: ops.quality_by_position(table(s, d, "benchmark").select(F.md5("text").alias("quality"))), "SELECT i - 1 AS pos, count(*) AS n, " + R("avg(ascii(substr(q, i, 1)) - 33)") + " AS mean FROM (SELECT md5(text) AS q FROM benchmark), (SELECT unnest(range(1, 33)) AS i) GROUP BY 1", "mean")
add("adapter_trim", lambda s, d: dna(s, d).select("doc_id", sq.trim_adapter("seq", "GTCA", 2).alias("trimmed")), query(DNA, sql="SELECT doc_id, CASE WHEN strpos(seq, 'GTCA') > 0 THEN substr(seq, 1, strpos(seq, 'GTCA') - 1) WHEN seq LIKE '%GTC' THEN substr(seq, 1, 61) WHEN seq LIKE '%GT' THEN substr(seq, 1, 62) ELSE seq END AS trimmed FROM dna"))
add("error_profile", lambda s, d: ops.error_profile(dna(s, d).select(F.explode(F.arrays_zip(F.split(F.substring("seq", 1, 32), "").alias("ref"), F.split(F.substring("seq", 33, 32), "").alias("base"))).alias("x")).select("x.ref", "x.base").where("ref <> ''")), query(DNA, sql=f"SELECT ref, base, count(*) AS n, {R('count(*) / sum(count(*)) OVER (PARTITION BY ref)')} AS rate FROM (SELECT substr(seq, i, 1) AS ref, substr(seq, i + 32, 1) AS base FROM dna, (SELECT unnest(range(1, 33)) AS i)) GROUP BY ref, base"), "rate")
add("suffix_array", lambda s, d: ops.suffix_array(dna(s, d), "doc_id"), query(DNA, sql="SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY substr(seq || '$', i)) - 1 AS rank, i - 1 AS pos, substr(seq || '$', CASE WHEN i = 1 THEN 65 ELSE i - 1 END, 1) AS bwt FROM dna, (SELECT unnest(range(1, 66)) AS i)"))
add("exact_search", lambda s, d: ops.search_all(dna(s, d), table(s, d, "nation").select(F.substring(F.translate(F.md5("n_name"), "0123456789abcdef", "ACGTACGTACGTACGT"), 1, 5).alias("pattern")).distinct(), "doc_id"), query(DNA, "pats AS (SELECT DISTINCT substr(translate(md5(n_name), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 5) AS pattern FROM nation)", sql="SELECT doc_id, pattern, i - 1 AS pos FROM dna, pats, (SELECT unnest(range(1, 65)) AS i) WHERE substr(seq, i, 5) = pattern"))
add("longest_repeat", lambda s, d: ops.longest_repeat(dna(s, d), "doc_id").select("doc_id", "length"), query(DNA, sql="SELECT doc_id, max(n)::BIGINT AS length FROM (SELECT doc_id, n FROM dna, (SELECT unnest(range(1, 64)) AS i), (SELECT unnest(range(1, 41)) AS n) WHERE i + n <= 65 AND strpos(substr(seq, i + 1), substr(seq, i, n)) > 0) GROUP BY doc_id"))
add("assembly_unitigs", lambda s, d: ops.unitigs(dna(s, d), "doc_id", 9), None)
add("assembly_overlaps", lambda s, d: ops.overlap_edges(dna(s, d), "doc_id", 6), query(DNA, sql="SELECT a.doc_id AS a, b.doc_id AS b, max(65 - i)::BIGINT AS overlap FROM (SELECT doc_id, seq, i FROM dna, (SELECT unnest(range(2, 60)) AS i)) a JOIN dna b ON substr(a.seq, a.i) = substr(b.seq, 1, 65 - a.i) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2"))



def _contigs(spark, sf_dir):
    hexa = F.concat(F.md5("text"), F.md5(F.reverse("text")))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("contig"), F.translate(hexa, "0123456789abcdef", "ACGTACGTACGTACGT").alias("seq"))


_KMERS = "kmers AS (SELECT doc_id, lang, i - 1 AS pos, substr(seq, i, 4) AS raw, least(substr(seq, i, 4), reverse(translate(substr(seq, i, 4), 'ACGT', 'TGCA'))) AS kmer FROM dna, (SELECT unnest(range(1, 62)) AS i))"
on_dna("kmer_counts", lambda x: ops.kmer_counts(x, "doc_id", 4), None)
QUERIES["kmer_counts"] = (QUERIES["kmer_counts"][0], query(DNA, _KMERS, sql="SELECT kmer, count(*) AS n FROM kmers GROUP BY kmer"))
add("kmer_frequency", lambda s, d: ops.kmer_frequency(ops.kmer_counts(dna(s, d), "doc_id", 4)), query(DNA, _KMERS, sql=f"SELECT kmer, count(*) AS n, {R('count(*) / (SELECT count(*) FROM kmers)')} AS frequency FROM kmers GROUP BY kmer"), "frequency")
_NEXT = "d AS (SELECT doc_id, kmer, count(*) AS n FROM kmers GROUP BY 1, 2), z AS (SELECT doc_id, count(*) AS c, sqrt(sum(n * n)) AS norm FROM d GROUP BY 1)"
add("kmer_similarity", lambda s, d: (lambda x: ops.kmer_similarity(x, "doc_id", 4, candidates=x.select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b"))))(dna(s, d)), query(DNA, _KMERS, _NEXT, sql=f"SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared, {R('count(*) / (any_value(zx.c) + any_value(zy.c) - count(*))')} AS jaccard, {R('count(*) / any_value(zx.c)')} AS containment, {R('sum(x.n * y.n) / (any_value(zx.norm) * any_value(zy.norm))')} AS cosine FROM d x JOIN d y ON y.doc_id = x.doc_id + 1 AND x.kmer = y.kmer JOIN z zx ON zx.doc_id = x.doc_id JOIN z zy ON zy.doc_id = y.doc_id GROUP BY 1, 2"), "jaccard", "containment", "cosine")
on_dna("kmer_sketch", lambda x: ops.bottom_sketch(x, "doc_id", 8, 16).select("doc_id", F.size("hashes").cast("long").alias("n")), None)
add("kmer_completeness", lambda s, d: ops.kmer_completeness(dna(s, d).where("lang = 'de'"), dna(s, d).where("lang = 'en'"), "doc_id", 6), None, "completeness", "qv")
add("motif_exact", lambda s, d: ops.exact_motifs(dna(s, d), "doc_id", 4, 150), query(DNA, _KMERS, sql="SELECT raw AS kmer, count(DISTINCT doc_id) AS n_sequences FROM kmers GROUP BY raw HAVING count(DISTINCT doc_id) >= 150"))
add("motif_weights", lambda s, d: ops.position_weights(dna(s, d), "doc_id", 4), query(DNA, _KMERS, "b AS (SELECT p - 1 AS pos, substr(raw, p, 1) AS base, count(*) AS n FROM kmers, (SELECT unnest(range(1, 5)) AS p) GROUP BY 1, 2)", sql=f"SELECT pos, base, n, {R('log2((n + 1) / (sum(n) OVER (PARTITION BY pos) + 4) / 0.25)')} AS weight FROM b"), "weight", ints=("pos",))
add("motif_scan", lambda s, d: ops.score_motif(dna(s, d), {0: {"A": 1.0}, 1: {"C": 1.0, "G": 0.5}, 2: {"G": 1.0}}, "doc_id", threshold=2.5).select("doc_id", "pos", "score"), query(DNA, sql="SELECT * FROM (SELECT doc_id, i - 1 AS pos, (CASE substr(seq, i, 1) WHEN 'A' THEN 1.0 ELSE 0 END + CASE substr(seq, i + 1, 1) WHEN 'C' THEN 1.0 WHEN 'G' THEN 0.5 ELSE 0 END + CASE substr(seq, i + 2, 1) WHEN 'G' THEN 1.0 ELSE 0 END)::DOUBLE AS score FROM dna, (SELECT unnest(range(1, 63)) AS i)) WHERE score >= 2.5"), ints=("pos",))
add("codon_usage", lambda s, d: ops.codon_usage(dna(s, d)), query(DNA, "c AS (SELECT substr(seq, i * 3 + 1, 3) AS codon FROM dna, (SELECT unnest(range(0, 21)) AS i))", sql=f"SELECT codon, count(*) AS n, {R('count(*) / (SELECT count(*) FROM c)')} AS frequency FROM c GROUP BY codon"), "frequency")
add("codon_adaptation", lambda s, d: ops.codon_adaptation(dna(s, d), ops.codon_usage(dna(s, d)).select("codon", F.col("frequency").alias("w")), "doc_id"), query(DNA, "c AS (SELECT doc_id, substr(seq, i * 3 + 1, 3) AS codon FROM dna, (SELECT unnest(range(0, 21)) AS i)), w AS (SELECT codon, count(*) / (SELECT count(*) FROM c) AS w FROM c GROUP BY codon)", sql=f"SELECT doc_id, {R('exp(avg(ln(w)))')} AS cai FROM c JOIN w USING (codon) GROUP BY doc_id"), "cai")
_W = "w AS (SELECT doc_id, i * 8 AS start, substr(seq, i * 8 + 1, 16) AS w FROM dna, (SELECT unnest(range(0, 7)) AS i))"
_E = " - ".join(["0"] + [f"CASE WHEN w LIKE '%{b}%' THEN (16 - length(replace(w, '{b}', ''))) / 16 * log2((16 - length(replace(w, '{b}', ''))) / 16) ELSE 0 END" for b in "ACGT"])
add("gc_windows", lambda s, d: ops.gc_windows(dna(s, d), "doc_id", 16, 8), query(DNA, _W, sql=f"SELECT doc_id, start, {R('(16 - length(translate(w, $$GC$$, $$$$))) / 16')} AS gc, {R('coalesce((length(replace(w, $$C$$, $$$$)) - length(replace(w, $$G$$, $$$$))) / nullif(16 - length(translate(w, $$GC$$, $$$$)), 0), 0)')} AS skew, {R(_E)} AS entropy FROM w"), "gc", "skew", "entropy")
add("gc_skew_cumulative", lambda s, d: ops.cumulative_skew(dna(s, d), "doc_id"), query(DNA, sql="SELECT doc_id, i - 1 AS pos, sum(CASE substr(seq, i, 1) WHEN 'G' THEN 1 WHEN 'C' THEN -1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS skew FROM dna, (SELECT unnest(range(1, 65)) AS i)"))
on_dna("cpg_islands", lambda x: ops.cpg_islands(x, "doc_id", 32, 8, 0.5, 0.9), None)
add("n50_by_language", lambda s, d: ops.nx(table(s, d, "documents").select("lang", F.col("n_chars").alias("length")), ["lang"], levels=(50, 90)).select("lang", "n", "total", "n50", "l50", "n90", "l90"), "WITH r AS (SELECT lang, n_chars AS len, sum(n_chars) OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING) AS cum, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS k, sum(n_chars) OVER (PARTITION BY lang) AS total FROM documents) SELECT lang, count(*) AS n, max(total)::BIGINT AS total, max(len) FILTER (WHERE cum >= total * 0.5) AS n50, min(k) FILTER (WHERE cum >= total * 0.5) AS l50, max(len) FILTER (WHERE cum >= total * 0.9) AS n90, min(k) FILTER (WHERE cum >= total * 0.9) AS l90 FROM r GROUP BY lang")
add("contig_statistics", lambda s, d: ops.contig_statistics(dna(s, d), ["lang"]).select("lang", "n", "total", "gc"), query(DNA, sql=f"SELECT lang, count(*) AS n, sum(length(seq))::BIGINT AS total, {R(f'sum({_GC}) / sum(length(seq))')} AS gc FROM dna GROUP BY lang"), "gc")
add("consensus_sequence", lambda s, d: ops.consensus(dna(s, d), ["lang"]), query(DNA, "b AS (SELECT lang, i, substr(seq, i, 1) AS base, count(*) AS n FROM dna, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY lang, i ORDER BY n DESC, base) AS k FROM b)", sql="SELECT lang, string_agg(base, '' ORDER BY i) AS consensus FROM r WHERE k = 1 GROUP BY lang"))
add("minimizers", lambda s, d: ops.minimizers(dna(s, d), "doc_id", 4, 5), query(DNA, _KMERS, sql="SELECT DISTINCT doc_id, m.pos AS pos, m.kmer AS kmer FROM (SELECT doc_id, min({'kmer': kmer, 'pos': pos}) OVER w AS m, count(*) OVER w AS c FROM kmers WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) WHERE c = 5"), ints=("pos",))
add("seed_neighbours", lambda s, d: dna(s, d).select("doc_id", F.explode(ops.mismatch_neighbours(F.substring("seq", 1, 4))).alias("seed")), query(DNA, sql="SELECT DISTINCT doc_id, CASE WHEN i = 0 THEN substr(seq, 1, 4) ELSE substr(seq, 1, i - 1) || c || substr(seq, i + 1, 4 - i) END AS seed FROM dna, (SELECT unnest(range(0, 5)) AS i), (SELECT unnest(['A', 'C', 'G', 'T']) AS c)"))
add("seed_diagonals", lambda s, d: ops.seed_hits(dna(s, d).withColumnRenamed("doc_id", "read_id"), _contigs(s, d), 8).select("read_id", "contig", "diagonal", "n"), query(DNA, "bench AS (SELECT item_id, translate(md5(text) || md5(reverse(text)), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq FROM benchmark), k AS (SELECT doc_id, i, substr(seq, i, 8) AS k FROM dna, (SELECT unnest(range(1, 58)) AS i)), c AS (SELECT item_id, i, substr(seq, i, 8) AS k FROM bench, (SELECT unnest(range(1, 58)) AS i)), h AS (SELECT a.doc_id AS read_id, b.item_id AS contig, b.i - a.i AS diagonal, count(*) AS n FROM k a JOIN c b ON a.k = b.k GROUP BY 1, 2, 3)", sql="SELECT read_id, contig, diagonal, n FROM (SELECT *, row_number() OVER (PARTITION BY read_id, contig ORDER BY n DESC, diagonal) AS r FROM h) WHERE r = 1"), ints=("diagonal",))
on_dna("orf_find", lambda x: ops.find_orfs(x, "doc_id", least=15, starts=("ATG", "GTG")), None)
on_dna("tandem_repeats", lambda x: ops.find_tandem_repeats(x, "doc_id", least=6, copies=3), None)
on_dna("palindromes", lambda x: ops.find_palindromes(x, "doc_id", shortest=5), None)
on_dna("stem_loops", lambda x: ops.find_stem_loops(x, "doc_id", stem=6), None)
on_dna("align_global", lambda x: ops.align_pairs(x.select("doc_id", F.col("seq").alias("a"), sq.reverse_complement("seq").alias("b")), "a", "b").select("doc_id", "score", "identity"), None, "identity")
on_dna("align_local", lambda x: ops.align_pairs(x.select("doc_id", F.col("seq").alias("a"), sq.reverse_complement("seq").alias("b")), "a", "b", local=True).select("doc_id", "score"), None)

_CIGAR = "(1 + l_linenumber) || 'S' || (l_orderkey % 40 + 5) || 'M' || (l_partkey % 3 + 1) || 'I' || (l_suppkey % 9 + 1) || 'M' || (l_suppkey % 4 + 1) || 'D' || '7M'"


def _cigars(spark, sf_dir):
    c = F.concat((1 + F.col("l_linenumber")).cast("string"), F.lit("S"), (F.col("l_orderkey") % 40 + 5).cast("string"), F.lit("M"), (F.col("l_partkey") % 3 + 1).cast("string"), F.lit("I"), (F.col("l_suppkey") % 9 + 1).cast("string"), F.lit("M"), (F.col("l_suppkey") % 4 + 1).cast("string"), F.lit("D7M"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", c.alias("cigar"))


add("cigar_lengths", lambda s, d: _cigars(s, d).groupBy("cigar").agg(F.count("*").alias("n")).select("cigar", "n", sq.cigar_length("cigar", "MDN=X").alias("ref_length"), sq.cigar_length("cigar", "MIS=X").alias("query_length"), sq.cigar_simplify(F.concat("cigar", F.lit("3M"))).alias("simple")), f"SELECT cigar, count(*) AS n, any_value(l_orderkey % 40 + 5 + l_suppkey % 9 + 1 + l_suppkey % 4 + 1 + 7)::BIGINT AS ref_length, any_value(1 + l_linenumber + l_orderkey % 40 + 5 + l_partkey % 3 + 1 + l_suppkey % 9 + 1 + 7)::BIGINT AS query_length, regexp_replace(cigar, '7M$', '10M') AS simple FROM (SELECT *, {_CIGAR} AS cigar FROM lineitem) GROUP BY cigar")
add("aligned_pairs", lambda s, d: _cigars(s, d).groupBy("cigar").agg(F.count("*").alias("records")).select("cigar", "records", F.explode(sq.aligned_pairs(F.lit(100), "cigar")).alias("p")).groupBy("cigar").agg(F.sum("records").alias("n"), F.min("p.query").cast("long").alias("q0"), F.max("p.query").cast("long").alias("q1"), F.min("p.reference").cast("long").alias("r0"), F.max("p.reference").cast("long").alias("r1")), f"SELECT cigar, (count(*) * any_value(l_orderkey % 40 + 5 + l_suppkey % 9 + 1 + 7))::BIGINT AS n, any_value(1 + l_linenumber)::BIGINT AS q0, any_value(l_linenumber + l_orderkey % 40 + 5 + l_partkey % 3 + 1 + l_suppkey % 9 + 1 + 7)::BIGINT AS q1, 100::BIGINT AS r0, any_value(99 + l_orderkey % 40 + 5 + l_suppkey % 9 + 1 + l_suppkey % 4 + 1 + 7)::BIGINT AS r1 FROM (SELECT *, {_CIGAR} AS cigar FROM lineitem) GROUP BY cigar")
add("alignment_flags", lambda s, d: table(s, d, "lineitem").agg(*(F.count_if(sq.flag(F.col("l_orderkey") % 4096, n)).alias(n) for n in sq.FLAGS)), "SELECT " + ", ".join(f"count(*) FILTER (WHERE (l_orderkey % 4096) & {b} <> 0) AS {n}" for n, b in sq.FLAGS.items()) + " FROM lineitem")
add("phred_quality", lambda s, d: table(s, d, "benchmark").select("item_id", F.substring(F.md5("text"), 1, 20).alias("q")).select("item_id", sq.mean_phred("q").alias("mean"), sq.trim_bounds("q", 60)["first"].cast("long").alias("first"), sq.trim_bounds("q", 60)["last"].cast("long").alias("last")), "SELECT item_id, " + R("avg(ascii(substr(q, i, 1)) - 33)") + " AS mean, coalesce(min(i) FILTER (WHERE ascii(substr(q, i, 1)) - 33 >= 60), 1) AS first, coalesce(max(i) FILTER (WHERE ascii(substr(q, i, 1)) - 33 >= 60), 20) AS last FROM (SELECT item_id, substr(md5(text), 1, 20) AS q FROM benchmark), (SELECT unnest(range(1, 21)) AS i) GROUP BY item_id", "mean")
_VAR = "v AS (SELECT o_orderkey, substr('ACGT', (o_orderkey % 4 + 1)::INT, 1) AS ref, substr('ACGT', (o_custkey % 4 + 1)::INT, 1) AS alt FROM orders)"
add("ti_tv_ratio", lambda s, d: table(s, d, "orders").select(F.substring(F.lit("ACGT"), (F.col("o_orderkey") % 4 + 1).cast("int"), F.lit(1)).alias("ref"), F.substring(F.lit("ACGT"), (F.col("o_custkey") % 4 + 1).cast("int"), F.lit(1)).alias("alt")).withColumn("ti", sq.is_transition("ref", "alt")).agg(F.count("ti").alias("n"), F.count_if("ti").alias("transitions"), (F.count_if("ti") / F.count_if(~F.col("ti"))).alias("ratio")), query(_VAR, sql=f"SELECT count(*) AS n, count(*) FILTER (WHERE t) AS transitions, {R('count(*) FILTER (WHERE t) / count(*) FILTER (WHERE NOT t)')} AS ratio FROM (SELECT ref || alt IN ('AG', 'GA', 'CT', 'TC') AS t FROM v WHERE ref <> alt)"), "ratio")
