"""Scalar functions of DNA, RNA and protein strings as column expressions, and of qualities and alignment strings."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, all tables down to COIL: the standard genetic code in the order TCAG, residue masses, hydropathy of Kyte and Doolittle, nucleotide masses
# in chains, ambiguity codes, cutting sites, patterns of domains and promoters, pK values, nearest-neighbour enthalpies and entropies, propensities.
BASES = "TCAG"
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = dict(zip(("".join(c) for c in product(BASES, repeat=3)), AMINO_ACIDS))
RESIDUE_MASS = {"A": 89.09, "R": 174.20, "N": 132.12, "D": 133.10, "C": 121.15, "E": 147.13, "Q": 146.15, "G": 75.07, "H": 155.16, "I": 131.17, "L": 131.17, "K": 146.19, "M": 149.21, "F": 165.19, "P": 115.13, "S": 105.09, "T": 119.12, "W": 204.23, "Y": 181.19, "V": 117.15}
HYDROPATHY = {"A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "Q": -3.5, "E": -3.5, "G": -0.4, "H": -3.2, "I": 4.5, "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8, "P": -1.6, "S": -0.8, "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2}
NUCLEOTIDE_MASS = {"dna": {"A": 313.21, "T": 304.19, "G": 329.21, "C": 289.18}, "rna": {"A": 329.21, "U": 306.17, "G": 345.21, "C": 305.18}}
IUPAC = {"R": "[AG]", "Y": "[CT]", "S": "[GC]", "W": "[AT]", "K": "[GT]", "M": "[AC]", "B": "[CGT]", "D": "[AGT]", "H": "[ACT]", "V": "[ACG]", "N": "[ACGT]"}
ENZYMES = {"EcoRI": "GAATTC", "BamHI": "GGATCC", "HindIII": "AAGCTT", "HinfI": "GANTC", "AluI": "AGCT"}
DOMAINS = {"signal_peptide": "^M[A-Z]{15,30}[AVILMFYW]{3,}", "transmembrane": "[AVILMFYW]{18,25}", "nuclear_localization": "[KR]{4,}|[KR][A-Z]{10,12}[KR]{3,}", "zinc_finger": "C[A-Z]{2,4}C[A-Z]{12,14}H[A-Z]{3,5}H", "leucine_zipper": "L[A-Z]{6}L[A-Z]{6}L[A-Z]{6}L"}
PROMOTERS = {"TATA_box": "TATA[AT]A[AT]", "CAAT_box": "GG[TC]CAATCT", "GC_box": "GGGCGG", "initiator": "[CT][CT]A[ACGT]T[CT][CT]", "BRE": "[GC][GC][GA]CGCC", "DPE": "[AG]G[AT][CT][GT]"}
CHARGE_PK = {"D": 3.86, "E": 4.25, "C": 8.33, "Y": 10.07, "H": 6.00, "K": 10.53, "R": 12.48}
NEIGHBOURS = {
    "AA": (-7.9, -22.2), "TT": (-7.9, -22.2), "AT": (-7.2, -20.4), "TA": (-7.2, -21.3), "CA": (-8.5, -22.7), "TG": (-8.5, -22.7), "GT": (-8.4, -22.4), "AC": (-8.4, -22.4),
    "CT": (-7.8, -21.0), "AG": (-7.8, -21.0), "GA": (-8.2, -22.2), "TC": (-8.2, -22.2), "CG": (-10.6, -27.2), "GC": (-9.8, -24.4), "GG": (-8.0, -19.9), "CC": (-8.0, -19.9),
}
HELIX = {"A": 1.42, "L": 1.21, "E": 1.51, "M": 1.45, "Q": 1.11, "K": 1.16, "R": 0.98, "H": 1.00, "V": 1.06, "I": 1.08, "Y": 0.69, "C": 0.70, "W": 1.08, "F": 1.13, "T": 0.83, "G": 0.57, "N": 0.67, "P": 0.57, "S": 0.77, "D": 1.01}
SHEET = {"V": 1.70, "I": 1.60, "Y": 1.47, "F": 1.38, "W": 1.37, "L": 1.30, "T": 1.19, "C": 1.19, "M": 1.05, "A": 0.83, "R": 0.93, "G": 0.75, "D": 0.54, "K": 0.74, "S": 0.75, "H": 0.87, "N": 0.89, "Q": 1.10, "P": 0.55, "E": 0.37}
COIL = 3.0


def _literal_map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def _col(seq) -> Column:
    return F.col(seq) if isinstance(seq, str) else seq


def count_of(seq, chars: str) -> Column:
    """How many characters of `seq` are among `chars`."""
    s = _col(seq)
    return F.length(s) - F.length(F.translate(s, chars, ""))


def positions(n: Column, step: int = 1, start: int = 1) -> Column:
    """start, start + step ... n as an array; empty if n is smaller than start."""
    return F.when(n >= start, F.sequence(F.lit(start), F.greatest(n, F.lit(start)), F.lit(step))).otherwise(F.array().cast("array<int>"))


def windows(seq, size: int, step: int = 1) -> Column:
    """All substrings of `size` at each `step`."""
    s = _col(seq)
    return F.transform(positions(F.length(s) - size + 1, step), lambda i: F.substring(s, i, F.lit(size)))


def complement(seq) -> Column:
    """Unknown characters become N."""
    return F.regexp_replace(F.translate(F.upper(_col(seq)), "ACGTUN", "TGCAAN"), "[^ACGTN]", "N")


def reverse_complement(seq) -> Column:
    return F.reverse(complement(seq))


def gc_content(seq) -> Column:
    """(G + C) over the full length; 0 for an empty sequence."""
    s = F.upper(_col(seq))
    return F.when(F.length(s) > 0, count_of(s, "GC") / F.length(s)).otherwise(F.lit(0.0))


def transcribe(seq) -> Column:
    return F.translate(F.upper(_col(seq)), "T", "U")


def back_transcribe(seq) -> Column:
    return F.translate(F.upper(_col(seq)), "U", "T")


def codons(seq, frame: int = 0) -> Column:
    s = F.substring(back_transcribe(seq), frame + 1, 1 << 30)
    return F.transform(positions(F.length(s) - 2, 3), lambda i: F.substring(s, i, F.lit(3)))


def translate(seq, frame: int = 0, to_stop: bool = False) -> Column:
    """Protein of a frame; codons that are not of four bases become X; with to_stop up to the first stop."""
    table = _literal_map(CODONS)
    protein = F.array_join(F.transform(codons(seq, frame), lambda c: F.coalesce(F.try_element_at(table, c), F.lit("X"))), "")
    return F.substring_index(protein, "*", 1) if to_stop else protein


def six_frames(seq) -> Column:
    """Map from frame (+1..+3, -1..-3) to protein."""
    back = reverse_complement(seq)
    return F.create_map(*(x for f in range(3) for x in (F.lit(f"+{f + 1}"), translate(seq, f), F.lit(f"-{f + 1}"), translate(back, f))))


def count_pattern(seq, pattern: str) -> Column:
    """Non-overlapping occurrences."""
    s = _col(seq)
    return ((F.length(s) - F.length(F.replace(s, F.lit(pattern), F.lit("")))) / len(pattern)).cast("long")


def find(seq, pattern: str) -> Column:
    """First place from 0, or -1."""
    return (F.instr(_col(seq), pattern) - 1).cast("long")


def find_all(seq, pattern: str) -> Column:
    """All places from 0, overlapping ones too."""
    s = _col(seq)
    return F.transform(F.filter(positions(F.length(s) - len(pattern) + 1), lambda i: F.substring(s, i, F.lit(len(pattern))) == pattern), lambda i: i - 1)


def composition(seq, alphabet: str) -> Column:
    """Map from character to its count, for a known alphabet."""
    return F.create_map(*(x for c in alphabet for x in (F.lit(c), count_of(seq, c).cast("long"))))


def frequency(seq, alphabet: str) -> Column:
    s = _col(seq)
    return F.when(F.length(s) > 0, F.create_map(*(x for c in alphabet for x in (F.lit(c), count_of(s, c) / F.length(s)))))


def subsequence(seq, start: int, end: int) -> Column:
    """Half-open, from 0."""
    return F.substring(_col(seq), start + 1, max(0, end - start))


def generated_id(seq) -> Column:
    return F.concat(F.lit("seq_"), F.substring(F.md5(_col(seq)), 1, 8))


def is_valid(seq, alphabet: str) -> Column:
    """Only characters of the alphabet, N, X, gap signs."""
    return F.upper(_col(seq)).rlike(f"^[{alphabet}NX.-]*$")


def sequence_type(seq) -> Column:
    """rna if it holds U and only nucleotides, dna if only these, else protein."""
    s = F.upper(_col(seq))
    return F.when(s.rlike("^[ACGUN.-]*U[ACGUN.-]*$"), "rna").when(s.rlike("[^ACGTN.-]"), "protein").otherwise("dna")


def wrapped(seq, width: int = 60) -> Column:
    """Lines of `width` characters."""
    return F.array_join(windows_all(seq, width), "\n")


def windows_all(seq, size: int) -> Column:
    """Consecutive pieces; the last may be shorter."""
    s = _col(seq)
    return F.transform(positions(F.length(s), size), lambda i: F.substring(s, i, F.lit(size)))


def fasta(name, description, seq, width: int = 60) -> Column:
    return F.concat(F.lit(">"), F.trim(F.concat_ws(" ", _col(name), _col(description))), F.lit("\n"), wrapped(seq, width))


def melting_temperature(seq, method: str = "basic", na_millimolar: float = 50.0, oligo_micromolar: float = 0.25) -> Column:
    """In Celsius. basic: two a weak and four a strong pair below 14 bases, else by GC share and length; salt_adjusted: with sodium; nearest_neighbor: from
    summed enthalpies and entropies of neighbouring pairs (ambiguous ones count nothing)."""
    s = F.upper(_col(seq))
    n, gc = F.length(s), count_of(s, "GC")
    if method == "basic":
        return F.when(n == 0, F.lit(0.0)).when(n < 14, 2.0 * count_of(s, "AT") + 4.0 * gc).otherwise(64.9 + 41.0 * (gc / n - 0.41) - 500.0 / n)
    if method == "salt_adjusted":
        return F.when(n > 0, 81.5 + 16.6 * F.log10(F.lit(na_millimolar / 1000)) + 41.0 * gc / n - 500.0 / n)
    if method != "nearest_neighbor":
        raise ValueError(f"unknown method {method!r}")
    def summed(k: int, start: float) -> Column:
        table = _literal_map({p: v[k] for p, v in NEIGHBOURS.items()})
        return F.aggregate(windows(s, 2), F.lit(start), lambda t, w: t + F.coalesce(F.try_element_at(table, w), F.lit(0.0)))

    enthalpy, entropy = summed(0, 0.2), summed(1, -5.7)
    entropy = entropy + 0.368 * (n - 1) * F.log(F.lit(na_millimolar / 1000))
    return F.when(n > 0, 1000 * enthalpy / (entropy + 1.987 * F.log(F.lit(oligo_micromolar * 1e-6 / 4))) - 273.15)


def iupac_pattern(motif: str) -> str:
    return "".join(IUPAC.get(c, c) for c in motif.upper())


def matches(seq, pattern: str) -> Column:
    """(start from 0, text) of the non-overlapping matches of a pattern."""
    s = _col(seq)
    parts, found = F.split(s, pattern, -1), F.regexp_extract_all(s, F.lit(pattern), F.lit(0))
    before = F.transform(positions(F.size(found)), lambda i: F.aggregate(F.slice(parts, 1, i), F.lit(0), lambda a, x: a + F.length(x)) + F.aggregate(F.slice(found, 1, i - 1), F.lit(0), lambda a, x: a + F.length(x)))
    return F.arrays_zip(before.alias("start"), found.alias("text"))


def restriction_sites(seq, enzymes: dict[str, str] = ENZYMES) -> Column:
    """Array of (enzyme, start, text)."""
    def named(name: str):
        return lambda x: F.struct(F.lit(name).alias("enzyme"), x["start"].alias("start"), x["text"].alias("text"))

    return F.flatten(F.array(*(F.transform(matches(seq, iupac_pattern(m)), named(e)) for e, m in enzymes.items())))


def motif_hits(seq, motifs: dict[str, str]) -> Column:
    """Array of (motif, start, text), by start."""
    def named(name: str):
        return lambda x: F.struct(x["start"].alias("start"), F.lit(name).alias("motif"), x["text"].alias("text"))

    return F.array_sort(F.flatten(F.array(*(F.transform(matches(seq, p), named(n)) for n, p in motifs.items()))))


def protein_domains(seq) -> Column:
    return motif_hits(seq, DOMAINS)


def promoter_elements(seq) -> Column:
    return motif_hits(seq, PROMOTERS)


def _sum_over(seq, values: dict) -> Column:
    """Sum of a value for each character, by counts of characters: constant work in the number of different ones."""
    s = F.upper(_col(seq))
    total = F.lit(0.0)
    for c, v in values.items():
        total = total + count_of(s, c) * F.lit(float(v))
    return total


def molecular_weight(seq, kind: str = "protein") -> Column:
    """Sum of masses less, for each bond, a water (protein) or 61.97 (dna, rna)."""
    n = F.length(_col(seq))
    if kind == "protein":
        return F.when(n > 0, _sum_over(seq, RESIDUE_MASS) - 18.015 * (n - 1)).otherwise(F.lit(0.0))
    return F.when(n > 0, _sum_over(seq, NUCLEOTIDE_MASS[kind]) - 61.97 * (n - 1)).otherwise(F.lit(0.0))


def mean_hydropathy(seq) -> Column:
    n = F.length(_col(seq))
    return F.when(n > 0, _sum_over(seq, HYDROPATHY) / n)


def hydrophobicity_profile(seq, window: int = 9) -> Column:
    """Mean hydropathy of every full window."""
    return F.transform(windows(seq, window), lambda w: F.round(sum((F.length(w) - F.length(F.translate(w, c, ""))) * F.lit(v) for c, v in HYDROPATHY.items()) / window, 6))


def structure_propensity(seq) -> Column:
    """Mean propensities for helix and sheet, 1 for unknown residues, and what is left of 3 for coil."""
    def shares(s: Column, counts: Column) -> Column:
        n, known = F.length(s), {c: F.get(counts, F.lit(k)) for k, c in enumerate(HELIX)}
        helix, sheet = ((sum((known[c] * F.lit(float(v)) for c, v in values.items()), F.lit(0.0)) + n - sum(known[c] for c in values)) / n for values in (HELIX, SHEET))
        return F.when(n > 0, F.struct(helix.alias("helix"), sheet.alias("sheet"), (COIL - helix - sheet).alias("coil")))

    # residues are counted once, in a loop: written out, the counts make a method too long for the JVM to compile
    counted = F.transform(F.array(F.upper(_col(seq))), lambda s: F.struct(s.alias("s"), F.transform(F.array(*map(F.lit, HELIX)), lambda c: F.length(s) - F.length(F.replace(s, c, F.lit("")))).alias("n")))
    return F.get(F.transform(counted, lambda x: shares(x["s"], x["n"])), F.lit(0))


def aromaticity(seq) -> Column:
    n = F.length(_col(seq))
    return F.when(n > 0, count_of(F.upper(_col(seq)), "FWY") / n).otherwise(F.lit(0.0))


def charge(seq, ph: float) -> Column:
    """Net charge at a pH with both ends."""
    s, total = F.upper(_col(seq)), F.lit(1 / (1 + 10 ** (ph - 9.69)) - 1 / (1 + 10 ** (2.34 - ph)))
    for residue, pk in CHARGE_PK.items():
        one = 1 / (1 + 10 ** (ph - pk)) if residue in "HKR" else -1 / (1 + 10 ** (pk - ph))
        total = total + count_of(s, residue) * F.lit(one)
    return total


def isoelectric_point(seq) -> Column:
    """The pH of 0 to 14 at which the net charge, which falls with pH, vanishes: eleven halvings."""
    s = F.upper(_col(seq))
    counts = F.array(*(count_of(s, r) for r in CHARGE_PK))

    def net(ph):
        total = 1 / (1 + F.pow(F.lit(10.0), ph - 9.69)) - 1 / (1 + F.pow(F.lit(10.0), 2.34 - ph))
        for k, (r, pk) in enumerate(CHARGE_PK.items()):
            total = total + counts[k] * (1 / (1 + F.pow(F.lit(10.0), ph - pk)) if r in "HKR" else -1 / (1 + F.pow(F.lit(10.0), pk - ph)))
        return total

    def halve(state, _):
        middle = (state["low"] + state["high"]) / 2
        return F.when(net(middle) > 0, F.struct(middle.alias("low"), state["high"].alias("high"))).otherwise(F.struct(state["low"].alias("low"), middle.alias("high")))

    start = F.struct(F.lit(0.0).alias("low"), F.lit(14.0).alias("high"))
    return F.when(F.length(s) > 0, F.aggregate(F.sequence(F.lit(1), F.lit(11)), start, halve, lambda x: F.round((x["low"] + x["high"]) / 2, 2)))


def instability_index(seq) -> Column:
    """10 / n for each dipeptide of weight one."""
    n = F.length(_col(seq))
    return F.when(n > 1, 10.0 / n * (n - 1)).otherwise(F.lit(0.0))


def shannon_entropy(seq, alphabet: str) -> Column:
    """In bits, over an alphabet's characters."""
    s = _col(seq)
    n = F.length(s)
    total = F.lit(0.0)
    for c in alphabet:
        p = count_of(s, c) / n
        total = total - F.when(p > 0, p * F.log2(p)).otherwise(F.lit(0.0))
    return F.when(n > 0, total)


def homopolymers(seq, least: int = 3) -> Column:
    """Runs of one character of at least `least`."""
    return F.regexp_extract_all(_col(seq), F.lit(rf"((.)\2{{{least - 1},}})"), F.lit(1))


# --- qualities ------------------------------------------------------------------------------------------------------


def phred(quality, offset: int = 33) -> Column:
    return F.transform(F.split(_col(quality), ""), lambda c: F.ascii(c) - offset)


def mean_phred(quality, offset: int = 33) -> Column:
    q = _col(quality)
    return F.when(F.length(q) > 0, F.aggregate(phred(q, offset), F.lit(0), lambda a, x: a + x) / F.length(q))


def trim_adapter(seq, adapter: str, least: int = 8) -> Column:
    """The sequence before the first occurrence of the adapter, or before the longest of its prefixes of `least` or more bases that ends the sequence."""
    s = _col(seq)
    whole = F.instr(s, adapter)
    tails = F.coalesce(*(F.when(F.endswith(s, F.lit(adapter[:k])), F.length(s) - k + 1) for k in range(len(adapter) - 1, least - 1, -1)), F.lit(0))
    place = F.when(whole > 0, whole).otherwise(tails)
    return F.when(place > 0, s.substr(F.lit(1), place - 1)).otherwise(s)


def aligned_pairs(start, cigar) -> Column:
    """Array of (query, reference) places from 0 of the aligned bases of a record that starts at `start` on the reference."""
    zero = F.struct(F.lit(0).alias("q"), F.col(start).cast("int").alias("r") if isinstance(start, str) else start.cast("int").alias("r"), F.array().cast("array<struct<query:int,reference:int>>").alias("out"))

    def step(at, x):
        n, op = x["length"], x["op"]
        pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((at["q"] + i).alias("query"), (at["r"] + i).alias("reference")))
        aligned = op.isin("M", "=", "X")
        return F.struct(
            F.when(aligned | op.isin("I", "S"), at["q"] + n).otherwise(at["q"]).alias("q"), F.when(aligned | op.isin("D", "N"), at["r"] + n).otherwise(at["r"]).alias("r"),
            F.when(aligned, F.concat(at["out"], pairs)).otherwise(at["out"]).alias("out"),
        )

    return F.aggregate(F.filter(cigar_ops(cigar), lambda x: x["length"] > 0), zero, step, lambda at: at["out"])


def error_rate(q) -> Column:
    return F.pow(F.lit(10.0), -_col(q) / 10.0)


def trim_bounds(quality, least: int = 20, offset: int = 33) -> Column:
    """(first, last) place from 1 with quality of at least `least`; the whole range if there is none."""
    good = F.filter(F.transform(phred(quality, offset), lambda x, i: F.when(x >= least, i + 1)), lambda x: x.isNotNull())
    return F.struct(F.coalesce(F.array_min(good), F.lit(1)).alias("first"), F.coalesce(F.array_max(good), F.length(_col(quality))).alias("last"))


# --- alignment strings ----------------------------------------------------------------------------------------------


def cigar_ops(cigar) -> Column:
    """Array of (length, op)."""
    c = _col(cigar)
    return F.arrays_zip(F.transform(F.regexp_extract_all(c, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(1)), lambda x: x.cast("int")).alias("length"), F.regexp_extract_all(c, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(2)).alias("op"))


def cigar_length(cigar, ops: str) -> Column:
    """Sum of the lengths of the given operations: "MDN=X" on the reference, "MIS=X" on the query."""
    return F.aggregate(F.filter(cigar_ops(cigar), lambda x: x["op"].isin(*ops)), F.lit(0), lambda a, x: a + x["length"]).cast("long")


def cigar_simplify(cigar) -> Column:
    """Joins neighbouring operations of the same kind."""
    def step(done, x):
        last = F.try_element_at(done, F.lit(-1))
        merged = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct((last["length"] + x["length"]).alias("length"), x["op"].alias("op"))))
        return F.when(last["op"] == x["op"], merged).otherwise(F.concat(done, F.array(F.struct(x["length"].alias("length"), x["op"].alias("op")))))

    done = F.aggregate(cigar_ops(cigar), F.array().cast("array<struct<length:int,op:string>>"), step)
    return F.array_join(F.transform(done, lambda x: F.concat(x["length"].cast("string"), x["op"])), "")


# The flag bits of alignment records.
FLAGS = {"paired": 0x1, "proper_pair": 0x2, "unmapped": 0x4, "mate_unmapped": 0x8, "reverse": 0x10, "mate_reverse": 0x20, "read1": 0x40, "read2": 0x80, "secondary": 0x100, "failed": 0x200, "duplicate": 0x400, "supplementary": 0x800}


def flag(column, name: str) -> Column:
    return _col(column).bitwiseAND(FLAGS[name]) != 0


# --- variants -------------------------------------------------------------------------------------------------------


def is_snp(ref, alt) -> Column:
    """`alt` is an array."""
    return (F.length(_col(ref)) == 1) & F.forall(_col(alt), lambda x: F.length(x) == 1)


def is_indel(ref, alt) -> Column:
    return F.exists(_col(alt), lambda x: F.length(x) != F.length(_col(ref)))


def is_passed(filters) -> Column:
    """`filters` is an array: only "." or only "PASS"."""
    return (F.size(_col(filters)) == 1) & _col(filters)[0].isin(".", "PASS")


def is_transition(ref, alt) -> Column:
    """Both purines or both pyrimidines; null unless both are one base."""
    r, a = F.upper(_col(ref)), F.upper(_col(alt))
    return F.when(r.rlike("^[ACGT]$") & a.rlike("^[ACGT]$") & (r != a), F.concat(r, a).isin("AG", "GA", "CT", "TC"))
