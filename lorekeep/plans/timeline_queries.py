"""Queries of the log, window, page and decision operators, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.operators import timeline as T
from lorekeep.plans import bindings as B
from lorekeep.plans.ledger_queries import E_SQL, with_delta

L_SQL = f"WITH {B.LOG}"
V_SQL = f"WITH {B.EVENTS}"
START = 1704067200  # 2024-01-01, the first day of the events


def _ids(df):
    return df.select("id")


def _turns(s, d):
    """Turns 400 seconds apart, longer ones every seventh; every third user turn names the message two before it."""
    t = B.table(s, d, "conversations")
    turn = F.col("turn")
    name = lambda k: F.concat(F.lit("m"), k.cast("string"))
    return t.select("conv_id", "turn", "role", (turn % 2 == 1).alias("question"), ((turn * 400 + F.floor(turn / 7) * 600) * 1000000).alias("us"), name(turn).alias("message_id"), F.when((F.col("role") == "user") & ((turn + F.col("conv_id")) % 3 == 0), name(turn - 3)).alias("reply_to"))


def _picks(s, d):
    return B.events(s, d).where("event_type = 'view'").select(F.col("event_id").alias("id"), F.col("user_id").alias("stakeholder"), "us")


def _scenes(s, d):
    li = B.table(s, d, "part")
    return li.select(F.col("p_brand").alias("scene"), F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"), F.lit(3.0).alias("z"), (F.col("p_partkey") % 7).cast("double").alias("size"))


def _track(s, d):
    return B.events(s, d).select((F.col("user_id") % 3).alias("scene"), F.col("user_id").alias("entity"), (F.col("us") / 1000000000).cast("long").alias("t"), F.col("event_id").alias("id"), (F.col("value") / 100).alias("x"))


def _velocity(s, d):
    """Two axes; every seventh entity has a stated way, every eleventh event is a ground."""
    e = F.col("entity")
    track = _track(s, d).withColumns({"y": F.col("x") * (F.col("id") % 5), "ground": F.col("id") % 11 == 0})
    routes = track.where(e % 7 == 0).select("scene", "entity", (e / 100).alias("d_x"), F.lit(None).cast("double").alias("d_y")).distinct()
    rows = T.velocity(track, ("x", "y"), routes)
    return rows.select("scene", "entity", "t", "id", F.round("v_x", 6).alias("v_x"), F.round("v_y", 6).alias("v_y"))


def _new_turns(s, d):
    """What a second look at the log finds: the first one saw the first half, in which a fifth of the speakers said nothing."""
    log = B.log(s, d).select("id", "us", "source_id")
    seen = log.where((F.col("id") % 10 < 5) & (F.col("source_id") % 5 > 0))
    none = log.limit(0).select("source_id", "us", "id")
    return T.new_turns(log, T.next_cursors(seen.where("id < 500"), none)).select("id", "source_id")


def _digest_sessions(s, d):
    o = B.table(s, d, "orders")
    rules = F.array(*[F.lit(f"r{i}") for i in range(4)])
    premises = F.array(F.concat(F.lit("r"), (F.col("o_custkey") % 6).cast("string")), F.col("o_orderpriority"))
    key = T.digest_key(premises, rules, F.when(F.col("o_custkey") % 6 == 4, F.col("o_orderstatus")))
    created = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    rows = o.select(F.col("o_orderkey").alias("id"), key.alias("key"), created.alias("created"), F.floor(created / 31536000).alias("session")).where("key is not null")
    return T.digest(rows, 7)


def _features(s, d):
    p = B.table(s, d, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.array_join(F.array_repeat(F.lit("n"), F.col("p_size")), ",").alias("alternatives"))


def _candidates(s, d):
    e = B.events(s, d)
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("source"), F.col("event_type").alias("trigger"), (F.col("k") / 100).alias("urge"), F.when(F.col("k") % 6 == 0, "ignore").otherwise("speak").alias("action"), (F.col("k") % 4 > 0).cast("int").alias("feasible"))


def _rules(s):
    return s.createDataFrame([("view", "nod", 0.4, True, 1), ("view", "speak", 0.6, True, 2), ("click", "speak", 0.5, False, 3), ("error", "ask", 0.9, True, 4)], "trigger string, action string, urge double, enabled boolean, order int")


def _grade(s, d):
    m = B.log(s, d)
    o = T.open_exchange(m, window=21600)
    k = F.col("channel")
    return m.join(o, "id").select("id", T.grade_directedness(k == 0, k == 1, k == 2, F.col("open")).alias("grade"))


def _urge(s, d):
    e = B.events(s, d)
    return e.select("event_id", F.round(T.effective_urge(F.col("k") / 100, F.col("value") / 100, F.col("k") % 2 == 0, F.col("k") % 7 == 0), 6).alias("urge"))


def _feasible(s, d):
    e = B.events(s, d)
    fam = F.element_at(F.array(F.lit("internal"), F.lit("ledger"), F.lit("post"), F.lit("outward")), (F.col("k") % 4 + 1).cast("int"))
    return e.select("event_id", T.feasible(fam, F.col("k") % 3 == 0, F.col("k") % 5 == 0, F.col("k") % 2 == 0).alias("feasible"))


def _digest(s, d):
    o = B.table(s, d, "orders")
    return T.digest(o.select(F.col("o_orderkey").alias("id"), F.concat_ws("-", "o_orderpriority", (F.col("o_custkey") % 20).cast("string")).alias("key"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("created")), 5)


def _rings(s, d):
    r = B.table(s, d, "nation").select(F.col("n_nationkey").alias("seq"), "n_name")
    return T.rings(r, B.table(s, d, "region").where("r_regionkey = 0").select(F.col("r_name").alias("edge")))


def _liveliest(s, d):
    log = B.log(s, d)
    return T.liveliest(log, log.where("source_id % 2 = 0").groupBy("source_id").agg(F.max("us").alias("cursor")))


def _feed(s, d):
    p = B.posts(s, d).withColumn("updated", F.when(F.col("slug") % 3 == 0, F.col("date") + 86400))
    return T.feed_top(p).select("slug", "date", "modified")


QUERIES = {
    "search_memory": lambda s, d: _ids(T.search_memory(B.log(s, d), frm=START, to=START + 20 * 86400, target=1, channel=3, limit=50)),
    "open_exchange": lambda s, d: T.open_exchange(B.log(s, d), window=21600),
    "reply_context": lambda s, d: T.reply_context(_turns(s, d)),
    "episode_near": lambda s, d: _ids(T.episode_near(_picks(s, d), with_delta(s, d), within=21600)),
    "recent_room": lambda s, d: T.recent_room(B.log(s, d), (START + 5 * 86400) * 1000000, 7, within=86400).select("id", "source_id", "channel"),
    "pending_items": lambda s, d: _ids(T.pending_items(B.log(s, d), B.log(s, d).where("channel < 5").select("id"), 7, 40)),
    "sense_overlap": lambda s, d: _ids(T.sense_overlap(B.log(s, d), B.log(s, d).where("id % 100 = 0").select(F.col("senses")[1].alias("sense")).distinct(), 256)),
    "metric_trend": lambda s, d: T.metric_trend(B.snapshots(s, d)),
    "sparkline": lambda s, d: T.sparkline(B.snapshots(s, d)).withColumn("values", F.array_join(F.transform("values", lambda x: x.cast("int").cast("string")), ",")),
    "sticky_version": lambda s, d: T.sticky_version(B.snapshots(s, d), block=24),
    "latency_gaps": lambda s, d: T.latency_gaps(B.events(s, d), "event_type"),
    "context_ring": lambda s, d: T.context_ring(B.log(s, d), 30, 21600).withColumn("ring", F.array_join(F.transform("ring", lambda x: x.cast("string")), ",")),
    "talker_depth": lambda s, d: T.talker_depth(B.log(s, d), 30, 86400, 2),
    "awake_ledger": lambda s, d: T.awake_ledger(B.events(s, d).select("user_id", "event_id", "us", (F.col("k") % 2 == 0).alias("opens"))).withColumn("seconds", F.round("seconds", 3)),
    "scene_normalise": lambda s, d: T.scene_normalise(_scenes(s, d)).select("scene", "id", *[F.round(c, 6).alias(c) for c in ("x", "y", "z", "size")]),
    "velocity": _velocity,
    "stream_turns": _new_turns,
    "digest_sessions": _digest_sessions,
    "page_before": lambda s, d: T.page_before(B.posts(s, d), before=800000000, kind="1-URGENT", limit=20).select("slug", "date", "total"),
    "history_range": lambda s, d: T.history_range(B.snapshots(s, d), START // 3600 + 24, START // 3600 + 240, 100).select("hour", "version"),
    "recent_activity": lambda s, d: T.recent_activity(B.events(s, d).withColumnRenamed("event_type", "type").withColumn("status", F.col("k") % 3), 5),
    "feed_top": _feed,
    "important_features": lambda s, d: T.important_features(_features(s, d)),
    "rings": _rings,
    "drift_sample": lambda s, d: _ids(T.drift_sample(B.log(s, d), 20, "7")),
    "liveliest": _liveliest,
    "top_candidate": lambda s, d: T.top_candidate(_candidates(s, d)).select("id", "status"),
    "throttle": lambda s, d: T.throttle(_candidates(s, d).join(B.events(s, d).select(F.col("event_id").alias("id"), "us"), "id"), ["source"], 86400),
    "session_state": lambda s, d: T.session_state(B.events(s, d)),
    "grade_directedness": _grade,
    "effective_urge": _urge,
    "feasible": _feasible,
    "keep_or_drop": lambda s, d: T.keep_or_drop(_candidates(s, d)).select("id", "decision"),
    "rule_fanout": lambda s, d: T.rule_fanout(B.events(s, d).select(F.col("event_id").alias("id"), F.col("event_type").alias("trigger"), (F.col("k") / 100).alias("scale")), _rules(s)).withColumn("urge", F.round("urge", 6)),
    "digest": _digest,
}

_CAND = "cand AS (SELECT event_id AS id, user_id AS source, event_type AS \"trigger\", k / 100 AS urge, CASE WHEN k % 6 = 0 THEN 'ignore' ELSE 'speak' END AS action, k % 4 > 0 AS ok, us FROM ev)"
_OPEN = """o AS (SELECT a.id, a.channel, EXISTS (SELECT 1 FROM log b WHERE b.channel = a.channel AND (b.us, b.id) < (a.us, a.id) AND b.us >= a.us - 21600000000 AND ((b.source_id = a.source_id AND b.directedness >= 0.9) OR (b.source_id = 0 AND b.target_id = a.source_id))) AS open FROM log a)"""

ORACLES = {
    "search_memory": f"{L_SQL} SELECT id FROM log WHERE us BETWEEN {START}000000 AND {START + 20 * 86400}000000 AND target_id = 1 AND channel = 3 ORDER BY us DESC, id LIMIT 50",
    "open_exchange": f"{L_SQL}, {_OPEN} SELECT id, open FROM o",
    "reply_context": """WITH t AS (SELECT conv_id, turn, role, (turn * 400 + turn // 7 * 600) AS sec FROM conversations),
n AS (SELECT u.conv_id, u.turn, max(a.turn) FILTER (a.role = 'assistant') AS asked, max(a.turn) FILTER (a.role = 'user') AS spoken, max(CASE WHEN a.role = 'assistant' AND a.turn = u.turn - 3 AND (u.turn + u.conv_id) % 3 = 0 THEN a.turn END) AS named
 FROM t u LEFT JOIN t a ON a.conv_id = u.conv_id AND a.turn < u.turn WHERE u.role = 'user' GROUP BY 1, 2)
SELECT conv_id, turn, CASE WHEN named IS NOT NULL THEN named WHEN asked % 2 = 1 AND asked > coalesce(spoken, -1) AND (turn * 400 + turn // 7 * 600) - (asked * 400 + asked // 7 * 600) <= 900 THEN asked END AS question_turn FROM n""",
    "episode_near": f"{E_SQL} SELECT event_id AS id FROM ev p WHERE event_type = 'view' AND EXISTS (SELECT 1 FROM d WHERE d.stakeholder = p.user_id AND delta > 0 AND abs(d.us - p.us) <= 21600000000)",
    "recent_room": f"{L_SQL} SELECT id, source_id, channel FROM log WHERE us > {START + 4 * 86400}000000 AND us <= {START + 5 * 86400}000000 AND source_id <> 7 ORDER BY us DESC, id LIMIT 1",
    "pending_items": f"{L_SQL} SELECT id FROM log WHERE source_id <> 7 AND channel >= 5 ORDER BY us, id LIMIT 40",
    "sense_overlap": f"{L_SQL}, n AS (SELECT DISTINCT senses[2] AS sense FROM log WHERE id % 100 = 0) SELECT id FROM log WHERE senses[1] IN (SELECT sense FROM n) OR senses[2] IN (SELECT sense FROM n) ORDER BY us DESC, id LIMIT 256",
    "metric_trend": f"WITH {B.SNAPSHOTS} SELECT hour, metric, coalesce(sign(value - lag(value) OVER (PARTITION BY metric ORDER BY hour)), 0)::INT AS trend FROM points",
    "sparkline": f"WITH {B.SNAPSHOTS} SELECT hour, metric, array_to_string(list(value::INT) OVER (PARTITION BY metric ORDER BY hour ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), ',') AS values FROM points",
    "sticky_version": f"WITH {B.SNAPSHOTS} SELECT hour, last_value(nullif(version, '') IGNORE NULLS) OVER (ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS version FROM snaps",
    "latency_gaps": f"{V_SQL}, g AS (SELECT event_type, (us - lag(us) OVER (PARTITION BY event_type ORDER BY us, event_id)) / 1000000 AS gap FROM ev) SELECT event_type, min(gap) AS least, round(avg(gap), 4) AS mean, max(gap) AS most FROM g WHERE gap IS NOT NULL GROUP BY 1",
    "context_ring": f"""{L_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY us, id) AS n FROM log) SELECT a.id, string_agg(b.id::VARCHAR, ',' ORDER BY b.n) AS ring FROM r a JOIN r b ON a.channel = b.channel AND b.n BETWEEN a.n - 29 AND a.n AND b.us >= a.us - 21600000000 GROUP BY 1""",
    "talker_depth": f"""{L_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY us, id) AS n FROM log), j AS (SELECT a.id, count(b.id) AS depth FROM r a LEFT JOIN r b ON a.channel = b.channel AND b.n BETWEEN a.n - 29 AND a.n - 1 AND b.us >= a.us - 86400000000 AND b.source_id = a.source_id GROUP BY 1)
SELECT id, depth, depth >= 2 AS momentum FROM j""",
    "awake_ledger": f"""{V_SQL}, m AS (SELECT user_id, k % 2 = 0 AS opens, us, least(lead(us) OVER (PARTITION BY user_id ORDER BY us, event_id), max(us) OVER (PARTITION BY user_id)) AS e FROM ev)
SELECT user_id, round(sum(CASE WHEN opens THEN greatest(0, coalesce(e, us) - us) ELSE 0 END) / 1000000, 3)::DOUBLE AS seconds FROM m GROUP BY 1""",
    "scene_normalise": """WITH p AS (SELECT p_brand AS scene, p_partkey AS id, p_size::DOUBLE AS x, p_retailprice AS y, (p_partkey % 7)::DOUBLE AS size FROM part), b AS (SELECT scene, min(x) x0, max(x) x1, min(y) y0, max(y) y1, greatest(max(x) - min(x), max(y) - min(y)) AS span FROM p GROUP BY 1)
SELECT scene, id, round(CASE WHEN x1 = x0 OR span = 0 THEN 0 ELSE (x - (x0 + x1) / 2) * 2 / span END, 6) AS x, round(CASE WHEN y1 = y0 OR span = 0 THEN 0 ELSE (y - (y0 + y1) / 2) * 2 / span END, 6) AS y, 0.0::DOUBLE AS z, round(CASE WHEN span = 0 THEN size ELSE size * 2 / span END, 6) AS size FROM p JOIN b USING (scene)""",
    "velocity": f"""{V_SQL}, k AS (SELECT user_id % 3 AS scene, user_id AS entity, CAST(floor(us / 1000000000) AS BIGINT) AS t, event_id AS id, value / 100 AS x, value / 100 * (event_id % 5) AS y FROM ev WHERE event_id % 11 > 0),
w AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, nullif(lead(t) OVER w - t, 0) AS dt FROM k WINDOW w AS (PARTITION BY scene, entity ORDER BY t, id)),
q AS (SELECT scene, entity, t, id, CASE WHEN entity % 7 = 0 THEN entity / 100 ELSE (nx - x) / dt END AS vx, (ny - y) / dt AS vy FROM w WHERE dt IS NOT NULL), m AS (SELECT scene, greatest(1.0, max(abs(vx)), max(abs(vy))) AS m FROM q GROUP BY 1)
SELECT scene, entity, t, id, round(vx / m, 6) AS v_x, round(vy / m, 6) AS v_y FROM q JOIN m USING (scene)""",
    "stream_turns": f"{L_SQL}, c AS (SELECT source_id, max(us) AS us FROM log WHERE id % 10 < 5 AND source_id % 5 > 0 AND id < 500 GROUP BY 1) SELECT id, source_id FROM log JOIN c USING (source_id) WHERE log.us > c.us",
    "digest_sessions": """WITH o AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 6 < 4 THEN sha1('r' || (o_custkey % 6)) ELSE sha1('teacher:' || o_orderstatus) END AS key, epoch(o_orderdate)::BIGINT AS c, epoch(o_orderdate)::BIGINT // 31536000 AS s FROM orders WHERE o_custkey % 6 < 5),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY c, id) AS n FROM o), b AS (SELECT *, (row_number() OVER (PARTITION BY key, s ORDER BY c, id) - 1) // 7 AS p FROM r WHERE n > 1)
SELECT id, key, 'buffer' AS role, (dense_rank() OVER (PARTITION BY key ORDER BY s, p) - 1)::INT AS chapter FROM b UNION ALL SELECT id, key, 'post', NULL FROM r WHERE n = 1""",
    "page_before": f"WITH {B.POSTS} SELECT slug, date, (SELECT count(*) FROM posts WHERE kind = '1-URGENT') AS total FROM posts WHERE date < 800000000 AND kind = '1-URGENT' ORDER BY date DESC, slug LIMIT 20",
    "history_range": f"WITH {B.SNAPSHOTS} SELECT hour, version FROM snaps WHERE hour BETWEEN {START // 3600 + 24} AND {START // 3600 + 240} ORDER BY hour DESC LIMIT 100",
    "recent_activity": f"{V_SQL} SELECT event_id, event_type AS type, k % 3 AS status FROM ev ORDER BY us DESC, event_id LIMIT 5",
    "feed_top": f"WITH {B.POSTS} SELECT slug, date, CASE WHEN slug % 3 = 0 THEN date + 86400 ELSE date END AS modified FROM posts ORDER BY date DESC, slug LIMIT 50",
    "important_features": "SELECT p_partkey AS id, p_name AS name, p_type AS type, p_size AS names FROM part WHERE p_size >= 10 QUALIFY row_number() OVER (PARTITION BY p_name, p_type ORDER BY p_size DESC, p_partkey) = 1",
    "rings": "SELECT n_nationkey AS seq, n_name, (SELECT r_name FROM region WHERE r_regionkey = 0) AS edge FROM nation",
    "drift_sample": f"{L_SQL} SELECT id FROM log ORDER BY md5(id::VARCHAR || '7'), id LIMIT 20",
    "liveliest": f"{L_SQL}, u AS (SELECT source_id, max(us) AS newest, arg_min(id, us) AS id FROM log WHERE source_id % 2 = 1 GROUP BY 1) SELECT source_id, id FROM u ORDER BY newest DESC, source_id LIMIT 1",
    "top_candidate": f"{V_SQL}, {_CAND} SELECT id, CASE WHEN row_number() OVER (PARTITION BY source, \"trigger\" ORDER BY urge DESC, id) = 1 THEN 'kept' ELSE 'superseded' END AS status FROM cand",
    "throttle": f"""WITH RECURSIVE {B.EVENTS}, {_CAND}, r AS (SELECT source, id, us, row_number() OVER (PARTITION BY source ORDER BY us, id) AS n FROM cand),
t AS (SELECT source, id, us, n, us AS last, true AS kept FROM r WHERE n = 1 UNION ALL SELECT r.source, r.id, r.us, r.n, CASE WHEN r.us - t.last >= 86400000000 THEN r.us ELSE t.last END, r.us - t.last >= 86400000000 FROM t JOIN r ON r.source = t.source AND r.n = t.n + 1) SELECT source, id FROM t WHERE kept""",
    "session_state": f"""{V_SQL}, g AS (SELECT user_id, event_id, (us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id)) / 1000000 AS gap, (us - min(us) OVER (PARTITION BY user_id, floor(us / 86400000000) ORDER BY us ROWS UNBOUNDED PRECEDING)) / 1000000 AS day FROM ev)
SELECT user_id, event_id, CASE WHEN day > 7200 AND gap > 60 THEN 'sleeping' WHEN gap > 600 THEN 'wondering' ELSE 'thinking' END AS state FROM g""",
    "grade_directedness": f"{L_SQL}, {_OPEN} SELECT id, CASE WHEN channel = 0 THEN 1.0 WHEN channel = 1 THEN 0.9 WHEN channel = 2 THEN 0.15 WHEN open THEN 0.85 ELSE 0.6 END::DOUBLE AS grade FROM o",
    "effective_urge": f"{V_SQL} SELECT event_id, round(CASE WHEN k % 7 = 0 THEN k / 100 ELSE k / 100 * CASE WHEN k % 2 = 0 AND value / 100 >= 0.6 THEN greatest(value / 100, 0.9) ELSE value / 100 END END, 6) AS urge FROM ev",
    "feasible": f"{V_SQL} SELECT event_id, CASE k % 4 WHEN 0 THEN 1 WHEN 1 THEN (k % 3 = 0)::INT WHEN 2 THEN (k % 5 = 0)::INT ELSE (k % 2 = 0)::INT END AS feasible FROM ev",
    "keep_or_drop": f"""{V_SQL}, {_CAND}, r AS (SELECT *, urge >= 0.5 AND ok AS good, row_number() OVER (PARTITION BY source ORDER BY (urge >= 0.5 AND ok) DESC, urge DESC, id) AS n FROM cand)
SELECT id, CASE WHEN good AND n = 1 AND action <> 'ignore' THEN 'keep' WHEN good AND n > 1 THEN 'discard' ELSE 'drop' END AS decision FROM r""",
    "rule_fanout": f"""{V_SQL}, rules AS (SELECT * FROM (VALUES ('view', 'nod', 0.4, 1), ('view', 'speak', 0.6, 2), ('error', 'ask', 0.9, 4)) t("trigger", action, urge, "order")) SELECT event_id AS id, event_type AS "trigger", action, round((k / 100 * urge)::DOUBLE, 6) AS urge, "order" FROM ev JOIN rules ON event_type = "trigger" """,
    "digest": """WITH r AS (SELECT o_orderkey AS id, o_orderpriority || '-' || (o_custkey % 20) AS key, row_number() OVER (PARTITION BY o_orderpriority, o_custkey % 20 ORDER BY epoch(o_orderdate), o_orderkey) AS n FROM orders)
SELECT id, key, CASE WHEN n = 1 THEN 'post' ELSE 'buffer' END AS role, CASE WHEN n > 1 THEN floor((n - 2) / 5)::INT END AS chapter FROM r""",
}
