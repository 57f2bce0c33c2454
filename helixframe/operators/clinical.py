"""Clinical rules and catalogue queries: risk scores, guideline look-up, star alleles, paging, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Genes and weights of the rules.
ONCOGENES = ("TP53", "KRAS", "BRAF", "EGFR", "PIK3CA", "PTEN", "APC", "RB1")
PGX_GENES = ("CYP2D6", "CYP2C19", "CYP2C9", "CYP3A4", "CYP3A5", "SLCO1B1", "TPMT", "DPYD", "UGT1A1", "VKORC1", "HLA-A", "HLA-B", "ABCB1", "ABCG2")
STAGE_WEIGHT, UNKNOWN_STAGE = {"I": 0.2, "II": 0.4, "III": 0.6, "IV": 0.8}, 0.5
RISK_GENES, GENE_WEIGHT, PROTECTION, AGE_WEIGHT, PERFORMANCE_WEIGHT = ("TP53", "PIK3CA", "KRAS", "BRAF"), 0.1, 0.1, 0.1, 0.2


def risk_score(stage: Column, genes: Column, age: Column, performance: Column, msi_high: Column | None = None) -> Column:
    """Stage, mutations in risk genes (each counts), age over 70 and performance status of 2 or more, less the protection of high microsatellite instability; clipped to 0..1. `genes` is an array."""
    by_stage, name = F.lit(UNKNOWN_STAGE), F.trim(F.replace(F.upper(stage), F.lit("STAGE"), F.lit("")))
    for k, w in STAGE_WEIGHT.items():
        by_stage = F.when(name == k, F.lit(w)).otherwise(by_stage)
    by_gene = F.coalesce(F.size(F.filter(genes, lambda g: g.isin(*RISK_GENES))), F.lit(0)) * GENE_WEIGHT
    protected = F.when(msi_high, PROTECTION).otherwise(0.0) if msi_high is not None else F.lit(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), by_stage + by_gene - protected + F.when(age > 70, AGE_WEIGHT).otherwise(0.0) + F.when(performance >= 2, PERFORMANCE_WEIGHT).otherwise(0.0)))


def risk_level(score: Column) -> Column:
    return F.when(score >= 0.7, "high").when(score >= 0.4, "intermediate").otherwise("low")


def guidelines_for(patients: DataFrame, guidelines: DataFrame) -> DataFrame:
    """Patients (patient, tumor, biomarkers) with the guidelines of their tumour and each biomarker, strongest evidence first."""
    rows = patients.select("patient", "tumor", F.explode("biomarkers").alias("biomarker")).join(guidelines, ["tumor", "biomarker"])
    return rows.orderBy("patient", F.desc("strength"), "drug")


def first_gene_in(name: Column, genes: tuple[str, ...] = PGX_GENES) -> Column:
    """The first of the genes that a feature's name contains, whatever the case."""
    return F.coalesce(*(F.when(F.upper(name).contains(g), F.lit(g)) for g in genes))


def star_allele(sample: Column, gene: Column) -> Column:
    """A synthetic allele, the same in every run."""
    return F.concat(F.lit("*"), (F.pmod(F.xxhash64(sample, gene), F.lit(5)) + 1).cast("string"))


def oncogenic(df: DataFrame, gene: str) -> DataFrame:
    return df.where(F.col(gene).isin(*ONCOGENES))


def drivers(df: DataFrame, gene: str, n_samples: int, share: float = 0.05) -> DataFrame:
    """(gene, n) of genes mutated in more than that share of samples."""
    return df.groupBy(gene).agg(F.count("*").alias("n")).where(F.col("n") > share * n_samples)


def page(df: DataFrame, number: int, size: int, *order) -> DataFrame:
    """A page of rows, numbered from 1."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def search(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows that hold the text in any column, whatever the case."""
    condition = F.lit(False)
    for c in columns:
        condition = condition | F.contains(F.lower(F.col(c)), F.lit(text.lower()))
    return df.where(condition)


def tagged(df: DataFrame, tags: list[str], column: str = "tags", match_all: bool = False) -> DataFrame:
    wanted = F.array(*map(F.lit, tags))
    return df.where(F.size(F.array_intersect(F.col(column), wanted)) == len(set(tags)) if match_all else F.arrays_overlap(F.col(column), wanted))


def older_than(df: DataFrame, column: str, days: int, now: Column) -> DataFrame:
    return df.where(F.col(column) < now - F.make_dt_interval(F.lit(days)))


def class_totals(df: DataFrame, name: str, value: str) -> DataFrame:
    """Sums by the class, the part of the name before the first bracket or blank."""
    return df.groupBy(F.trim(F.regexp_extract(name, r"^([^( ]+)", 1)).alias("class")).agg(F.sum(value).alias("total"))
