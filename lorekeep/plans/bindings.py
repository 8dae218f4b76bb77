"""Knowledge tables derived from the supplied tables, for Spark and, as CTEs, for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


EVENTS = "ev AS (SELECT event_id, ts, epoch_us(ts) AS us, user_id, event_type, value, CAST(regexp_extract(props, '[0-9]+') AS INT) AS k FROM events)"

_QUANT = ["universal", "negative", "existential", "indefinite", "definite", "generic", "negated_universal"]
_OPS = {"view": "AND", "click": "OR", "purchase": "IMPLY", "signup": "NOT", "error": "THAT"}


def clauses(spark: SparkSession, sf_dir: str, conjoined: bool = False) -> DataFrame:
    """A statement is a user's day, a clause an event. conjoined: all fold by AND, few have attitudes."""
    e = events(spark, sf_dir).withColumn("stmt_id", F.col("user_id") * 100000 + F.floor(F.col("us") / 86400000000).cast("long"))
    k = F.col("k")
    op = F.lit("AND") if conjoined else F.element_at(F.create_map(*[F.lit(x) for kv in _OPS.items() for x in kv]), F.col("event_type"))
    senses = F.map_filter(
        F.create_map(
            F.lit("subject"), F.concat(F.lit("s"), (k % 5).cast("string"), F.lit(".n.01")),
            F.lit("predicate"), F.concat("event_type", F.lit(".v.0"), (1 + k % 3).cast("string")),
            F.lit("direct"), F.when(k % 4 != 0, F.concat(F.lit("d"), (k % 6).cast("string"), F.lit(".n.01"))),
        ),
        lambda _, v: v.isNotNull(),
    )
    identities = F.when(k % 6 == 0, F.create_map(F.lit("subject"), F.concat(F.lit("person:"), F.col("user_id").cast("string")))).otherwise(F.create_map().cast("map<string,string>"))
    return e.select(
        "stmt_id",
        (F.row_number().over(Window.partitionBy("stmt_id").orderBy("us", "event_id")) - 1).alias("pos"),
        op.alias("op"),
        F.when(k % 23 == 0, (k % 10) / 10.0).alias("attitude"),
        (k % 2 == 1).alias("negated"),
        (k % 19 == 0).alias("unknown"),
        F.element_at(F.array(*[F.lit(q) for q in _QUANT]), (k % 7 + 1).cast("int")).alias("quantifier"),
        F.when(k % 29 == 0, F.lit("what")).alias("wh_role"),
        (k % 31 == 0).alias("contrast"),
        F.when(k % 17 == 0, F.lit("because")).alias("cause"),
        F.when(k % 11 == 0, F.lit("possibility")).alias("modal"),
        senses.alias("senses"),
        identities.alias("identities"),
        F.create_map(F.lit("direct"), F.element_at(F.array(F.lit("in"), F.lit("to"), F.lit("with")), (k % 3 + 1).cast("int"))).alias("markers"),
        ((k % 10) / 10.0).alias("dubitative"),
        F.least(F.lit(1.0), F.col("value") / 100).alias("truth"),
        F.col("us"),
        F.col("user_id"),
        F.col("event_id"),
    )


def clauses_sql(conjoined: bool = False) -> str:
    op = "'AND'" if conjoined else "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _OPS.items()) + " END"
    return f"""{EVENTS}, clauses AS (SELECT user_id * 100000 + CAST(floor(us / 86400000000) AS BIGINT) AS stmt_id,
  CAST(row_number() OVER (PARTITION BY user_id, CAST(floor(us / 86400000000) AS BIGINT) ORDER BY us, event_id) - 1 AS INT) AS pos, {op} AS op,
  CASE WHEN k % 23 = 0 THEN (k % 10) / 10.0::DOUBLE END AS attitude, k % 2 = 1 AS negated, k % 19 = 0 AS unknown,
  list_extract({_QUANT!r}, CAST(k % 7 + 1 AS INT)) AS quantifier, CASE WHEN k % 29 = 0 THEN 'what' END AS wh_role, k % 31 = 0 AS contrast,
  CASE WHEN k % 17 = 0 THEN 'because' END AS cause, CASE WHEN k % 11 = 0 THEN 'possibility' END AS modal,
  's' || (k % 5) || '.n.01' AS s_subject, event_type || '.v.0' || (1 + k % 3) AS s_predicate, CASE WHEN k % 4 <> 0 THEN 'd' || (k % 6) || '.n.01' END AS s_direct,
  CASE WHEN k % 6 = 0 THEN 'person:' || user_id END AS i_subject, list_extract(['in', 'to', 'with'], CAST(k % 3 + 1 AS INT)) AS m_direct,
  (k % 10) / 10.0::DOUBLE AS dubitative, least(1.0::DOUBLE, value / 100) AS truth, us, user_id, event_id, coalesce(i_subject, s_subject) AS subject FROM ev)"""


def edges(spark: SparkSession, sf_dir: str, deep: bool = False) -> DataFrame:
    """(child, parent): order lines, orders, customers, suppliers, nations, regions and the world; deep: with orders and lines."""
    t = lambda n: table(spark, sf_dir, n)
    link = lambda df, a, ca, b, cb: df.select(F.concat(F.lit(a), F.col(ca).cast("string")).alias("child"), F.concat(F.lit(b), F.col(cb).cast("string")).alias("parent"))
    out = link(t("customer"), "C:", "c_custkey", "N:", "c_nationkey").unionByName(link(t("supplier"), "S:", "s_suppkey", "N:", "s_nationkey"))
    out = out.unionByName(link(t("nation"), "N:", "n_nationkey", "R:", "n_regionkey")).unionByName(t("region").select(F.concat(F.lit("R:"), F.col("r_regionkey").cast("string")).alias("child"), F.lit("world").alias("parent")))
    if deep:
        line = t("lineitem").select("l_orderkey", "l_suppkey").distinct()
        child = F.concat(F.lit("L:"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string")).alias("child")
        out = out.unionByName(link(t("orders"), "O:", "o_orderkey", "C:", "o_custkey"))
        for prefix, key in (("O:", "l_orderkey"), ("S:", "l_suppkey")):
            out = out.unionByName(line.select(child, F.concat(F.lit(prefix), F.col(key).cast("string")).alias("parent")))
    return out


def edges_sql(deep: bool = False) -> str:
    more = """ UNION SELECT 'O:' || o_orderkey, 'C:' || o_custkey FROM orders UNION SELECT 'L:' || l_orderkey || '-' || l_suppkey, 'O:' || l_orderkey FROM lineitem
 UNION SELECT 'L:' || l_orderkey || '-' || l_suppkey, 'S:' || l_suppkey FROM lineitem""" if deep else ""
    return f"""edges AS (SELECT 'C:' || c_custkey AS child, 'N:' || c_nationkey AS parent FROM customer UNION SELECT 'S:' || s_suppkey, 'N:' || s_nationkey FROM supplier
 UNION SELECT 'N:' || n_nationkey, 'R:' || n_regionkey FROM nation UNION SELECT 'R:' || r_regionkey, 'world' FROM region{more})"""


def closure_sql(deep: bool = False) -> str:
    """Needs WITH RECURSIVE."""
    return edges_sql(deep) + """, walk AS (SELECT child AS node, parent AS ancestor, [child, parent] AS path FROM edges
 UNION ALL SELECT w.node, e.parent, list_append(w.path, e.parent) FROM walk w JOIN edges e ON e.child = w.ancestor WHERE NOT list_contains(w.path, e.parent) AND len(w.path) <= 12),
closure AS (SELECT node, ancestor, path, len(path) - 1 AS depth FROM (SELECT *, row_number() OVER (PARTITION BY node, ancestor ORDER BY len(path), path) AS r FROM walk) WHERE r = 1)"""


_KINDS = {"purchase": "kicker", "signup": "correction", "view": "agreement", "click": "disagreement", "error": "logic_violation"}


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stakeholder, kind, belief_trust, us, id): an event is a trust episode of its user."""
    kinds = F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv])
    return events(spark, sf_dir).select(F.col("user_id").alias("stakeholder"), F.element_at(kinds, F.col("event_type")).alias("kind"), F.lit(0.5).alias("belief_trust"), "us", F.col("event_id").alias("id"))


EPISODES = EVENTS + ", episodes AS (SELECT user_id AS stakeholder, CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _KINDS.items()) + " END AS kind, 0.5::DOUBLE AS belief_trust, us, event_id AS id FROM ev)"


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, us, source_id, target_id, channel, directedness, original, senses, metadata): an event is a message to agent 0."""
    e = events(spark, sf_dir)
    k = F.col("k")
    senses = F.array(F.concat("event_type", F.lit(".v.01")), F.concat(F.lit("s"), (k % 50).cast("string"), F.lit(".n.01")))
    return e.select(
        F.col("event_id").alias("id"), "us", "ts", F.col("user_id").alias("source_id"), F.when(k % 8 == 0, F.lit(0)).otherwise(F.lit(1)).cast("long").alias("target_id"), (k % 10).alias("channel"),
        F.when(k % 4 == 0, F.lit(1.0)).when(k % 4 == 1, F.lit(0.9)).when(k % 4 == 2, F.lit(0.6)).otherwise(F.lit(0.15)).alias("directedness"),
        F.concat("event_type", F.lit(" "), k.cast("string")).alias("original"), senses.alias("senses"), F.concat(F.lit('{"channel_id": "c'), k.cast("string"), F.lit('"'), F.when(k % 5 == 0, F.lit("")).otherwise(F.lit("}"))).alias("metadata"),
    )


LOG = EVENTS + """, log AS (SELECT event_id AS id, us, user_id AS source_id, CASE WHEN k % 8 = 0 THEN 0 ELSE 1 END AS target_id, k % 10 AS channel, k,
  CASE k % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 WHEN 2 THEN 0.6 ELSE 0.15 END::DOUBLE AS directedness, event_type || ' ' || k AS original,
  [event_type || '.v.01', 's' || (k % 50) || '.n.01'] AS senses FROM ev)"""


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(hour, version, metrics): hourly event counts by type as a metric map."""
    e = events(spark, sf_dir).withColumn("hour", F.floor(F.col("us") / 3600000000).cast("long"))
    counts = e.groupBy("hour", "event_type").agg(F.count("*").cast("double").alias("n"))
    return counts.groupBy("hour").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n")))).alias("metrics")).withColumn("version", F.when(F.col("hour") % 5 == 0, F.concat(F.lit("v"), (F.col("hour") % 100).cast("string"))).otherwise(F.lit("")))


SNAPSHOTS = EVENTS + """, points AS (SELECT CAST(floor(us / 3600000000) AS BIGINT) AS hour, event_type AS metric, count(*)::DOUBLE AS value FROM ev GROUP BY 1, 2),
snaps AS (SELECT DISTINCT hour, CASE WHEN hour % 5 = 0 THEN 'v' || (hour % 100) ELSE '' END AS version FROM points)"""


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("slug"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("date"), F.col("o_orderpriority").alias("kind"), "o_totalprice", "o_orderstatus", "o_custkey")


POSTS = "posts AS (SELECT o_orderkey AS slug, CAST(epoch(o_orderdate) AS BIGINT) AS date, o_orderpriority AS kind, o_totalprice, o_orderstatus, o_custkey FROM orders)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), "label")


VECTORS = "vecs AS (SELECT vec_id, embedding::DOUBLE[] AS vector, label FROM embeddings)"
