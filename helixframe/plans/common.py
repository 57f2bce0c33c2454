"""Input views shared by the registered queries, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions.numeric import r6
from helixframe.operators import matrix


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as an expression matrix (sample, grp, feature, value)."""
    return matrix.from_arrays(table(spark, sf_dir, "embeddings").withColumnRenamed("label", "grp"), "vec_id", "embedding", "grp")


EXPRESSION = "expression AS (SELECT vec_id AS sample, label AS grp, unnest(range(0, len(embedding)))::INT AS feature, unnest(embedding)::DOUBLE AS value FROM embeddings)"


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities by supplier and part as a count matrix."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("sample"), F.col("l_partkey").alias("feature")).agg(F.sum("l_quantity").alias("value"))


COUNTS = "counts AS (SELECT l_suppkey AS sample, l_partkey AS feature, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2)"


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values by type, every seventh missing."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("sample"), F.col("event_type").alias("feature"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"))


GAPS = "gaps AS (SELECT event_id AS sample, event_type AS feature, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events)"


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """Doubles of results rounded (see r6)."""
    return df.withColumns({n: r6(n) for n in names})


def integers(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def query(*views: str, sql: str) -> str:
    """SQL over the named view definitions."""
    return f"WITH {', '.join(views)} {sql}" if views else sql


def R(x: str) -> str:
    """The SQL of r6."""
    return f"round({x} + 1e-9, 6)"


def dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DNA of 64 bases a document, made of digests of its text (doc_id, lang, seq)."""
    hexa = F.concat(F.md5("text"), F.md5(F.reverse("text")))
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.translate(hexa, "0123456789abcdef", "ACGTACGTACGTACGT").alias("seq"))


DNA = "dna AS (SELECT doc_id, lang, translate(md5(text) || md5(reverse(text)), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq FROM documents)"


def text_dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long DNA: the Latin letters of each whole text as bases (doc_id, lang, seq)."""
    letters = F.lower(F.regexp_replace("text", "[^A-Za-z]", ""))
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.translate(letters, "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC").alias("seq"))


TEXT_DNA = "text_dna AS (SELECT doc_id, lang, translate(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS seq FROM documents)"


def proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proteins: the Latin letters of each whole text, with a few known stretches behind them by language (doc_id, seq)."""
    tail = F.when(F.col("lang") == "en", "MEEPQDRYLAIV").when(F.col("lang") == "de", "GAGGVRRRK").when(F.col("lang") == "fr", "GHSAGRNPXKG").otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.upper(F.regexp_replace("text", "[^A-Za-z]", "")), tail).alias("seq"))


PROTEINS = "proteins AS (SELECT doc_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) || CASE lang WHEN 'en' THEN 'MEEPQDRYLAIV' WHEN 'de' THEN 'GAGGVRRRK' WHEN 'fr' THEN 'GHSAGRNPXKG' ELSE '' END AS seq FROM documents)"
