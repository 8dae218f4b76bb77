"""Reading, writing and repairing the knowledge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.schemas import DDL


def scan_kb(spark: SparkSession, directory: str, name: str, ddl: str | None = None) -> DataFrame:
    """One knowledge table by its fixed schema (or the given one), never inferred."""
    return spark.read.schema(ddl or DDL[name]).parquet(f"{directory}/{name}.parquet")


def active(df: DataFrame) -> DataFrame:
    return df.where(~F.col("archived"))


def append_log(df: DataFrame, path: str) -> None:
    """Append-only write by day; rows are never updated."""
    df.withColumn("event_date", F.to_date("ts")).write.mode("append").partitionBy("event_date").parquet(path)


def upsert_latest(base: DataFrame, changes: DataFrame, keys: list[str], order_by: str) -> DataFrame:
    """The newest row of each key; of equal versions the change wins."""
    both = base.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order_by), F.desc("_new")))
    return both.withColumn("_r", r).where("_r = 1").drop("_r", "_new")


def rebuild_tier(edges: DataFrame, path: str) -> None:
    """Replaces the rows of the methods in edges and leaves those of other methods."""
    edges.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("method").parquet(path)


def harvest_relations(synsets: DataFrame, relations: tuple[str, ...] = ("is_a", "part_of", "entails", "attribute", "similar_to", "antonym")) -> DataFrame:
    """(subject, relation, object, pos): distinct edges out of nested sense rows with one array of objects for each relation."""
    def edges(relation: str) -> Column:
        return F.transform(F.coalesce(F.col(relation), F.array().cast("array<string>")), lambda o: F.struct(F.lit(relation).alias("relation"), o.alias("object")))

    listed = F.flatten(F.array(*[edges(r) for r in relations]))
    return synsets.select(F.col("sense").alias("subject"), "pos", F.explode(listed).alias("e")).select("subject", "e.relation", "e.object", "pos").distinct()


def resume_anti(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Keys, once each, that an earlier run has not processed."""
    return todo.dropDuplicates([key]).join(done.select(key), key, "left_anti")


def parse_log(lines: DataFrame) -> DataFrame:
    """(us, phase, event, premises, level) of raw lines `2024-01-01 00:00:00,123 [phase] event: a, b`."""
    x = lambda i: F.regexp_extract("value", r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d),(\d{3}) \[(\w+)\] (\w+): ?(.*)$", i)
    us = F.unix_micros(F.to_timestamp(x(1))) + x(2).try_cast("long") * 1000
    level = F.when(x(4).isin("error", "warning"), x(4)).otherwise("info")
    return lines.where(x(3) != "").select(us.alias("us"), x(3).alias("phase"), x(4).alias("event"), F.filter(F.split(x(5), ", "), lambda p: p != "").alias("premises"), level.alias("level"))


def meta_json(log: DataFrame) -> DataFrame:
    """(id, channel_id, message_id, reply_to) of the metadata; bad JSON gives null, and a null channel falls back to the row's channel."""
    parsed = F.from_json("metadata", "channel_id string, message_id string, reply_to string", {"mode": "PERMISSIVE"})
    return log.select("id", F.coalesce(parsed["channel_id"], F.concat(F.lit("#"), F.col("channel").cast("string"))).alias("channel_id"), parsed["message_id"].alias("message_id"), parsed["reply_to"].alias("reply_to"))


def repair_epoch(c: Column) -> Column:
    """Epoch seconds of a text that holds either them or a UTC date and time."""
    return F.coalesce(c.try_cast("double").cast("long"), F.unix_seconds(F.try_to_timestamp(c)))


def mark_addressed(findings: DataFrame, batch: DataFrame) -> DataFrame:
    """Findings with those of the batch stamped."""
    hit = batch.select("id", F.lit(True).alias("_hit"))
    return findings.join(hit, "id", "left").withColumn("addressed", F.col("addressed") | F.coalesce("_hit", F.lit(False))).drop("_hit")


def validate_metrics(df: DataFrame) -> DataFrame:
    """Rows with the reason they are rejected for, or null."""
    finite = F.forall(F.map_values("metrics"), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    reason = F.when(F.coalesce(F.col("state"), F.lit("")) == "", "state").when(~finite, "metrics").when(F.length("version") > 24, "version").when(F.col("hour").isNull(), "date")
    return df.withColumn("reason", reason)


def rehome(axioms: DataFrame, definitions: DataFrame, keep_days: list[int]) -> DataFrame:
    """Axioms created outside the kept days whose text the definitions don't have."""
    return axioms.where(~F.col("day").isin(keep_days)).join(definitions.select("original"), "original", "left_anti")
