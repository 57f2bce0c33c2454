"""Readers and writers of genomic text formats as DataFrames.

Line formats go through Spark's text source (gzip by suffix, any store, split by file blocks) and are parsed by column
expressions. FASTA and GenBank use their record separator as the line separator; FASTQ files are framed whole. Coordinates keep the format's convention: GFF, VCF and SAM from 1, BED from 0.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions.sequence import fasta, sequence_type


def lines(spark: SparkSession, path: str, comment: str | None = "#") -> DataFrame:
    """Lines that are not empty and no comments."""
    rows = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    return rows.where(~F.col("value").startswith(comment)) if comment else rows


def _dot(column: Column) -> Column:
    """`.` is a missing value."""
    return F.when(column != ".", column)


def _fields(rows: DataFrame, *names: str) -> DataFrame:
    f = F.split("value", "\t", -1)
    return rows.withColumn("__f", f).select("*", *(F.try_element_at("__f", F.lit(i + 1)).alias(n) for i, n in enumerate(names)))


def key_values(column: Column, pair: str = ";", key: str = "=") -> Column:
    """Map of `k=v;k=v`; entries without value are "true"."""
    entries = F.filter(F.transform(F.split(column, pair), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    return F.map_from_entries(F.transform(entries, lambda x: F.struct(F.substring_index(x, key, 1).alias("k"), F.when(x.contains(key), F.regexp_replace(x, f"^[^{key}]*{key}", "")).otherwise(F.lit("true")).alias("v"))))


# --- sequences ------------------------------------------------------------------------------------------------------


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, description, seq, kind)."""
    rows = spark.read.option("lineSep", "\n>").text(path).where(F.length(F.trim("value")) > 0)
    head = F.regexp_replace(F.regexp_extract("value", r"^([^\n]*)", 1), r"^>|\r$", "")
    body = F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s+", ""))
    return rows.select(F.substring_index(head, " ", 1).alias("id"), F.when(head.contains(" "), F.regexp_replace(head, r"^\S+\s+", "")).otherwise("").alias("description"), body.alias("seq")).withColumn("kind", sequence_type("seq"))


def write_fasta(df: DataFrame, path: str, width: int = 60) -> None:
    df.select(fasta("id", "description", "seq", width).alias("value")).write.text(path)


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(id, description, seq, quality) of four-line records. A file is framed in one task, since lines alone do not tell a quality from a name; large sets come as many files."""

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["content"]:
                data = bytes(text)
                rows = (gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data).decode().splitlines()
                out += [(rows[i][1:], rows[i + 1], rows[i + 3]) for i in range(0, len(rows) - 3, 4) if rows[i].startswith("@")]
            yield pd.DataFrame(out, columns=["head", "seq", "quality"])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(records, "head string, seq string, quality string")
    return rows.select(F.substring_index("head", " ", 1).alias("id"), F.when(F.col("head").contains(" "), F.regexp_replace("head", r"^\S+\s+", "")).otherwise("").alias("description"), F.upper("seq").alias("seq"), "quality")


def read_fastq_pairs(spark: SparkSession, first: str, second: str) -> DataFrame:
    """Mates joined by read name (without /1, /2); unpaired ones are left out."""
    name = F.regexp_replace("id", r"/[12]$", "")
    a, b = (read_fastq(spark, p).withColumn("name", name) for p in (first, second))
    return a.select("name", F.col("seq").alias("seq1"), F.col("quality").alias("quality1")).join(b.select("name", F.col("seq").alias("seq2"), F.col("quality").alias("quality2")), "name")


def write_fastq(df: DataFrame, path: str) -> None:
    df.select(F.concat(F.lit("@"), F.col("id"), F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.col("quality")).alias("value")).write.text(path)


# --- features and intervals -----------------------------------------------------------------------------------------


def read_gff(spark: SparkSession, path: str, gtf: bool = False) -> DataFrame:
    """(seqid, source, type, start, end, score, strand, phase, attributes), from 1, both ends included; lines of fewer than eight fields are left out."""
    rows = _fields(lines(spark, path), "seqid", "source", "type", "start", "end", "score", "strand", "phase", "attrs").where(F.size("__f") >= 8)
    if gtf:
        attributes = F.map_from_arrays(F.regexp_extract_all("attrs", F.lit(r'(\w+)\s+"([^"]*)"'), F.lit(1)), F.regexp_extract_all("attrs", F.lit(r'(\w+)\s+"([^"]*)"'), F.lit(2)))
    else:
        attributes = key_values(F.coalesce("attrs", F.lit("")))
    return rows.select("seqid", _dot(F.col("source")).alias("source"), "type", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), _dot(F.col("score")).cast("double").alias("score"), _dot(F.col("strand")).alias("strand"), _dot(F.col("phase")).cast("int").alias("phase"), attributes.alias("attributes"))


def genes_of(features: DataFrame) -> DataFrame:
    """(gene, seqid, start, end, n): features by gene_id, else ID."""
    gene = F.coalesce(F.try_element_at("attributes", F.lit("gene_id")), F.try_element_at("attributes", F.lit("ID")))
    return features.withColumn("gene", gene).where("gene IS NOT NULL").groupBy("gene", "seqid").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"))


def write_gff(df: DataFrame, path: str) -> None:
    text = F.concat_ws(";", F.transform(F.map_entries("attributes"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    df.select(F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in ("seqid", "source", "type", "start", "end", "score", "strand", "phase")), text).alias("value")).write.text(path)


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """BED3 to BED12, half-open from 0; block columns as arrays."""
    rows = lines(spark, path).where(~F.col("value").rlike("^(track|browser)"))
    rows = _fields(rows, "chrom", "start", "end", "name", "score", "strand", "thick_start", "thick_end", "rgb", "n_blocks", "sizes", "starts")
    numbers = lambda c: F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.cast("int"))
    return rows.select("chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "name", F.col("score").cast("double").alias("score"), _dot(F.col("strand")).alias("strand"), F.col("thick_start").cast("long").alias("thick_start"), F.col("thick_end").cast("long").alias("thick_end"), "rgb", F.col("n_blocks").cast("int").alias("n_blocks"), numbers("sizes").alias("block_sizes"), numbers("starts").alias("block_starts"))


def write_bed(df: DataFrame, path: str) -> None:
    df.select(F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in ("chrom", "start", "end", "name", "score", "strand"))).alias("value")).write.text(path)


# --- alignments -----------------------------------------------------------------------------------------------------


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """The eleven columns (pos from 1) and a map of tags to (type, value)."""
    rows = _fields(lines(spark, path, "@"), "qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")
    tags = F.map_from_entries(F.transform(F.slice("__f", 12, 1 << 20), lambda x: F.struct(F.substring(x, 1, 2).alias("k"), F.struct(F.substring(x, 4, 1).alias("type"), F.substring(x, 6, 1 << 20).alias("value")).alias("v"))))
    ints = ("flag", "pos", "mapq", "pnext", "tlen")
    return rows.select(*(F.col(c).cast("long").alias(c) if c in ints else _dot(F.col(c)).alias(c) if c in ("seq", "qual") else F.col(c) for c in ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")), tags.alias("tags"))


def sam_references(spark: SparkSession, path: str) -> DataFrame:
    """(name, length) of the header."""
    return spark.read.text(path).where(F.col("value").startswith("@SQ")).select(F.regexp_extract("value", r"\tSN:(\S+)", 1).alias("name"), F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("long").alias("length"))


def write_sam(df: DataFrame, path: str) -> None:
    tags = F.transform(F.map_entries("tags"), lambda e: F.concat_ws(":", e["key"], e["value"]["type"], e["value"]["value"]))
    df.select(F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("*")) for c in ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")), tags).alias("value")).write.text(path)


# --- variants -------------------------------------------------------------------------------------------------------


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos, id, ref, alt, qual, filter, info, samples); samples map names to maps of the FORMAT keys."""
    head = spark.read.text(path).where(F.col("value").startswith("#CHROM")).limit(1).collect()  # one line
    names = head[0]["value"].split("\t")[9:] if head else []
    rows = _fields(lines(spark, path), "chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format")
    keys = F.split("format", ":")
    values = F.slice("__f", 10, max(1, len(names)))
    fit = lambda v: F.map_from_entries(F.filter(F.arrays_zip(keys.alias("k"), F.split(v, ":").alias("v")), lambda e: e["k"].isNotNull()))
    samples = F.map_from_arrays(F.array(*map(F.lit, names)), F.transform(values, fit)) if names else F.create_map().cast("map<string,map<string,string>>")
    return rows.select("chrom", F.col("pos").cast("long").alias("pos"), _dot(F.col("id")).alias("id"), "ref", F.split("alt", ",").alias("alt"), _dot(F.col("qual")).cast("double").alias("qual"), F.split("filter", ";").alias("filter"), F.when(F.col("info") == ".", F.create_map().cast("map<string,string>")).otherwise(key_values(F.col("info"))).alias("info"), samples.alias("samples"))


def vcf_meta(spark: SparkSession, path: str) -> DataFrame:
    """(kind, id, fields) of the header's INFO, FORMAT, FILTER and contig lines."""
    rows = spark.read.text(path).where(F.col("value").rlike(r"^##(INFO|FORMAT|FILTER|contig)=<"))
    inner = F.regexp_extract("value", r"=<(.*)>$", 1)
    pairs = F.map_from_arrays(F.regexp_extract_all(inner, F.lit(r'(\w+)=("[^"]*"|[^,]*)'), F.lit(1)), F.transform(F.regexp_extract_all(inner, F.lit(r'(\w+)=("[^"]*"|[^,]*)'), F.lit(2)), lambda x: F.regexp_replace(x, '^"|"$', "")))
    return rows.select(F.regexp_extract("value", r"^##(\w+)=", 1).alias("kind"), F.element_at(pairs, "ID").alias("id"), pairs.alias("fields"))


def read_maf(spark: SparkSession, path: str, required: tuple[str, ...] = ("Hugo_Symbol", "Variant_Classification", "Tumor_Sample_Barcode")) -> DataFrame:
    """Tab-separated mutations with header; fails if a required column is missing."""
    df = spark.read.option("sep", "\t").option("header", True).option("comment", "#").csv(path)
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df


# --- matrices and sets ----------------------------------------------------------------------------------------------


def read_matrix(spark: SparkSession, path: str, sep: str = ",", features_on_rows: bool = False) -> DataFrame:
    """(sample, feature, value) of a delimited matrix whose first column names the rows."""
    df = spark.read.option("sep", sep).option("header", True).csv(path)
    first, rest = df.columns[0], df.columns[1:]
    long = df.unpivot([first], rest, "c", "v")
    row, column = ("feature", "sample") if features_on_rows else ("sample", "feature")
    return long.select(F.col(first).alias(row), F.col("c").alias(column), F.expr("try_cast(v AS double)").alias("value")).select("sample", "feature", "value")


def read_gct(spark: SparkSession, path: str) -> DataFrame:
    """(sample, feature, description, value): two lines are skipped, the third names the samples."""
    head = spark.read.text(path).where(F.lower("value").rlike(r"^name\t")).limit(1).collect()[0]["value"].split("\t")  # one line
    rows = spark.read.text(path).withColumn("f", F.split("value", "\t", -1)).where((F.size("f") == len(head)) & ~F.lower("value").rlike(r"^name\t"))
    values = rows.select(F.col("f")[0].alias("feature"), F.col("f")[1].alias("description"), F.posexplode(F.slice("f", 3, len(head) - 2)).alias("i", "v"))
    return values.select(F.element_at(F.array(*map(F.lit, head[2:])), F.col("i") + 1).alias("sample"), "feature", "description", F.expr("try_cast(v AS double)").alias("value"))


def read_matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """(row, column, value) from 1 of a coordinate file; the size line is left out."""
    rows = lines(spark, path, "%").select(F.split(F.trim("value"), r"\s+").alias("f"), F.monotonically_increasing_id().alias("n"))
    first = rows.agg(F.min("n")).first()[0]
    return rows.where(F.col("n") != (first if first is not None else -1)).select(F.col("f")[0].cast("long").alias("row"), F.col("f")[1].cast("long").alias("column"), F.coalesce(F.try_element_at("f", F.lit(3)), F.lit("1")).cast("double").alias("value"))


def read_gmt(spark: SparkSession, path: str) -> DataFrame:
    """(pathway, description, gene)."""
    f = F.split("value", "\t")
    return lines(spark, path).select(f[0].alias("pathway"), f[1].alias("description"), F.explode(F.slice(f, 3, 1 << 20)).alias("gene")).where("gene <> ''")


def read_edges(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    f = F.split("value", sep)
    return lines(spark, path).select(f[0].alias("src"), f[1].alias("dst"), F.expr(f"try_cast(try_element_at(split(value, '{sep}'), 3) AS double)").alias("weight"))


def write_sif(df: DataFrame, path: str, relation: str = "interacts") -> None:
    df.select(F.concat_ws("\t", "src", F.lit(relation), "dst").alias("value")).write.text(path)


def read_gfa(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Segments (id, seq) and links (src, src_strand, dst, dst_strand, overlap)."""
    f = F.split("value", "\t")
    rows = spark.read.text(path)
    return rows.where(F.col("value").startswith("S\t")).select(f[1].alias("id"), f[2].alias("seq")), rows.where(F.col("value").startswith("L\t")).select(f[1].alias("src"), f[2].alias("src_strand"), f[3].alias("dst"), f[4].alias("dst_strand"), F.regexp_extract(f[5], r"^(\d+)", 1).cast("int").alias("overlap"))


def write_gfa(segments: DataFrame, links: DataFrame, path: str) -> None:
    spark = segments.sparkSession
    head = spark.range(1).select(F.lit("H\tVN:Z:1.0").alias("value"))
    s = segments.select(F.concat_ws("\t", F.lit("S"), F.col("id").cast("string"), "seq").alias("value"))
    link = links.select(F.concat_ws("\t", F.lit("L"), F.col("src").cast("string"), "src_strand", F.col("dst").cast("string"), "dst_strand", F.concat(F.col("overlap").cast("string"), F.lit("M"))).alias("value"))
    head.unionAll(s).unionAll(link).write.text(path)


def agp(parts: DataFrame) -> DataFrame:
    """AGP lines of (scaffold, part, contig or null for a gap, length, strand): running positions from 1."""
    from pyspark.sql import Window

    run = F.sum("length").over(Window.partitionBy("scaffold").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    rows = parts.withColumn("end", run).withColumn("start", run - F.col("length") + 1)
    tail = F.when(F.col("contig").isNull(), F.concat_ws("\t", F.lit("N"), F.col("length").cast("string"), F.lit("scaffold\tyes\tpaired-ends"))).otherwise(F.concat_ws("\t", F.lit("W"), "contig", F.lit("1"), F.col("length").cast("string"), "strand"))
    return rows.select("scaffold", "part", F.concat_ws("\t", "scaffold", F.col("start").cast("string"), F.col("end").cast("string"), F.col("part").cast("string"), tail).alias("line"))


def read_blast(spark: SparkSession, path: str) -> DataFrame:
    """Tabular hits (outfmt 6)."""
    names = ("query", "subject", "identity", "length", "mismatches", "gaps", "q_start", "q_end", "s_start", "s_end", "evalue", "bits")
    kinds = dict.fromkeys(names, "long") | dict.fromkeys(("identity", "evalue", "bits"), "double") | dict.fromkeys(("query", "subject"), "string")
    rows = _fields(lines(spark, path), *names, "description")
    return rows.select(*(F.col(n).cast(kinds[n]).alias(n) for n in names), "description")


def read_pdb(spark: SparkSession, path: str) -> DataFrame:
    """Atoms of ATOM and HETATM lines, by their fixed columns."""
    cut = lambda a, n: F.trim(F.substring("value", a, n))
    rows = spark.read.text(path).where(F.col("value").rlike("^(ATOM|HETATM)"))
    return rows.select(cut(7, 5).cast("int").alias("serial"), cut(13, 4).alias("name"), cut(18, 3).alias("residue"), cut(22, 1).alias("chain"), cut(23, 4).cast("int").alias("residue_number"), *(cut(a, 8).cast("double").alias(n) for a, n in ((31, "x"), (39, "y"), (47, "z"))), F.coalesce(F.nullif(cut(77, 2), F.lit("")), F.substring(F.regexp_replace(cut(13, 4), "[0-9]", ""), 1, 1)).alias("element"))


def parse_genbank(record: str) -> dict:
    """Name, definition, accession, features with qualifiers, and sequence of one record."""
    def section(name: str) -> str:
        m = re.search(rf"^{name}\s+(.*?)(?=^\S|\Z)", record, re.M | re.S)
        return re.sub(r"\s*\n\s+", " ", m[1]).strip() if m else ""

    features = []
    body = re.search(r"^FEATURES[^\n]*\n(.*?)(?=^\S|\Z)", record, re.M | re.S)
    for m in re.finditer(r"^ {5}(\S+)\s+(.*?)(?=^ {5}\S|\Z)", body[1] if body else "", re.M | re.S):
        head, *rest = re.split(r"\n\s+/", m[2])
        found: dict[str, list[str]] = {}
        for q in rest:
            k, _, v = q.partition("=")
            found.setdefault(k.strip(), []).append(re.sub(r"\n\s+", " ", v).strip().strip('"'))
        features.append({"type": m[1], "location": re.sub(r"\s+", "", head), "qualifiers": found})
    origin = re.search(r"^ORIGIN[^\n]*\n(.*)", record, re.M | re.S)
    return {"name": section("LOCUS").split(" ")[0], "definition": section("DEFINITION"), "accession": section("ACCESSION"), "features": features, "seq": re.sub(r"[^A-Za-z]", "", origin[1] if origin else "").upper()}


def read_genbank(spark: SparkSession, path: str) -> DataFrame:
    """(name, definition, accession, features, seq), a record at a time."""
    schema = "name string, definition string, accession string, features array<struct<type:string,location:string,qualifiers:map<string,array<string>>>>, seq string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([parse_genbank(x) for x in batch["value"]], columns=["name", "definition", "accession", "features", "seq"])

    rows = spark.read.option("lineSep", "\n//").text(path).where(F.col("value").contains("LOCUS")).select(F.regexp_replace("value", r"^\s+", "").alias("value"))
    return rows.mapInPandas(run, schema)


def features_of_type(records: DataFrame, kind: str) -> DataFrame:
    return records.select("name", F.explode(F.filter("features", lambda f: f["type"] == kind)).alias("f")).select("name", "f.*")


# --- data-quality rules ----------------------------------------------------------------------------------------------


def violations(rows: DataFrame, **rules: Column) -> DataFrame:
    """(rule, n) of rows that break each rule (a condition that should hold); null counts as broken."""
    return rows.agg(*(F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items())).unpivot([], list(rules), "rule", "n")
