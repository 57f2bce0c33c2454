"""Message streams: typed JSON messages, routing, mutation alerts, sliding rates, late data. Works on batch tables too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# The kinds of messages and the genes whose mutations are acted on.
MESSAGE_TYPES = ("data_update", "analysis_request", "analysis_result", "mutation_detected", "alert", "status_update")
ACTIONABLE = ("EGFR", "BRAF", "KRAS", "ALK", "ROS1", "BRCA1", "BRCA2")
SCHEMA = "type string, gene string, mutation string, sample_id string, clinical_significance string, analysis_id string, timestamp timestamp"


def from_kafka(spark: SparkSession, servers: str, topics: str, **options: str) -> DataFrame:
    """(key, value, timestamp, headers) of the topics; offsets are kept in the query's checkpoint."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics).option("includeHeaders", "true").options(**options).load().select(F.col("key").cast("string"), F.col("value").cast("string"), "timestamp", "headers")


def to_kafka(df: DataFrame, servers: str, topic: str, checkpoint: str, key: str = "sample_id") -> StreamingQuery:
    """Writes rows as JSON messages."""
    out = df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))
    return out.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start()


def parsed(messages: DataFrame, column: str = "value") -> DataFrame:
    """Fields of the JSON messages; `error` says why a message cannot be used (null: it can)."""
    m = F.from_json(column, SCHEMA)
    rows = messages.withColumn("__m", m).select("*", "__m.*").drop("__m") if "timestamp" not in messages.columns else messages.withColumnRenamed("timestamp", "received").withColumn("__m", m).select("*", "__m.*").drop("__m")
    error = F.when(F.col(column).isNull() | F.col("type").isNull(), "not a message").when(~F.col("type").isin(*MESSAGE_TYPES), "unknown type")
    return rows.withColumn("error", error)


def mutation_alerts(rows: DataFrame) -> DataFrame:
    """(sample_id, gene, mutation, type, severity): alerts for actionable genes (symbols as they are written), else status updates."""
    acted = F.col("gene").isin(*ACTIONABLE)
    return rows.where("type = 'mutation_detected'").select("sample_id", "gene", "mutation", F.when(acted, "alert").otherwise("status_update").alias("type"), F.when(acted, "high").otherwise("info").alias("severity"))


def accepted_requests(rows: DataFrame) -> DataFrame:
    return rows.where("type = 'analysis_request'").select("analysis_id", F.lit("processing").alias("status"), "timestamp")


def processed(rows: DataFrame) -> DataFrame:
    """(type, sample_id, payload): what each message becomes; errors are rows too."""
    kind = F.when(F.col("error").isNotNull(), "error").when((F.col("type") == "mutation_detected") & F.col("gene").isin(*ACTIONABLE), "alert").otherwise("status_update")
    return rows.select(kind.alias("type"), "sample_id", F.coalesce("error", F.concat_ws(" ", "gene", "mutation")).alias("payload"))


def rates(rows: DataFrame, key: str, time: str = "timestamp", window: str = "60 seconds", slide: str = "10 seconds", late: str | None = "2 minutes") -> DataFrame:
    """(key, start, n): messages of a key in sliding windows; on a stream what is later than `late` is dropped with its window."""
    source = rows.withWatermark(time, late) if late and rows.isStreaming else rows
    return source.groupBy(F.window(time, window, slide).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def over_limit(counts: DataFrame, limit: int) -> DataFrame:
    return counts.where(F.col("n") > limit)


def deduplicated(rows: DataFrame, keys: list[str], time: str = "timestamp", late: str = "10 minutes") -> DataFrame:
    """The first of equal messages; on a stream as long as the watermark remembers them."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if rows.isStreaming else rows.dropDuplicates(keys)


def actionable(gene: Column) -> Column:
    return gene.isin(*ACTIONABLE)
