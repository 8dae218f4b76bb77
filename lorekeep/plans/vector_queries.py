"""Queries of the vector, text and source operators, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.functions import text as X
from lorekeep.operators import neighbours as N
from lorekeep.operators import vectors as V
from lorekeep.plans import bindings as B
from lorekeep.sources import tables as S

STOP = ["the", "and", "that", "this", "with", "for"]
SEGMENT = "list_cosine_similarity"


def _pairs(s, d):
    v = B.vectors(s, d)
    return v.select(F.col("vec_id").alias("a"), F.col("vector").alias("va")).join(v.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("vector").alias("vb")), "a")


def _queries(s, d):
    return B.vectors(s, d).where("vec_id % 100 = 0")


def _cells(s, d):
    v = B.vectors(s, d)
    around = N.pivots(v)
    return N.knn_cells(_queries(s, d), N.vector_index(v, around), around, 5)


def _anchors(s, d):
    v = B.vectors(s, d)
    first = v.groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    return v.join(first.select("vec_id"), "vec_id", "left_semi").select(F.col("vec_id").alias("anchor_id"), F.col("label").cast("string").alias("value"), "vector")


def _part(c, a, b):
    return F.slice(c, a + 1, b - a)


def _clause_pairs(s, d):
    p = _pairs(s, d)
    a, b = F.col("va"), F.col("vb")
    sim = lambda x, y: V.role_similarity(_part(a, x, y), _part(b, x, y))
    absent = F.when(F.col("a") % 3 > 0, V.role_similarity(_part(a, 32, 48), _part(b, 32, 48)))
    same = F.when(F.col("a") % 5 == 0, F.col("a") % 2 == 0)
    parts = {"predicate": sim(0, 16), "subject": sim(16, 32), "direct": absent, "sentiment": sim(48, 64)}
    return p.select("a", "b", F.round(V.compare_clause(parts, {"subject": same}), 6).alias("similarity"))


def _statement_pairs(s, d):
    v = B.vectors(s, d).select((F.col("vec_id") / 4).cast("long").alias("st"), (F.col("vec_id") % 4).alias("leaf"), "vector")
    l = v.select(F.col("st").alias("a"), F.col("leaf").alias("i"), F.col("vector").alias("va"))
    r = v.where("leaf < 3").select((F.col("st") - 1).alias("a"), F.col("st").alias("b"), F.col("leaf").alias("j"), F.col("vector").alias("vb"))
    leaves = l.join(r, "a").select("a", "b", "i", "j", V.cosine(F.col("va"), F.col("vb")).alias("sim"))
    heads = leaves.select("a", "b").distinct().select("a", "b", (F.col("a") % 2 == 0).alias("directional"), F.lit(0.5).alias("operator"), F.when(F.col("a") % 3 == 0, F.lit(1.0)).alias("attitude"))
    return V.compare_statement(leaves, heads).withColumn("similarity", F.round("similarity", 6))


def _soft(s, d):
    v = B.vectors(s, d).select((F.col("vec_id") / 6).cast("long").alias("pair"), (F.col("vec_id") % 6).alias("item"), "vector")
    return V.soft_f1(v.where("item < 3"), v.where("item >= 3"), 16).withColumn("f1", F.round("f1", 6))


def _flat(df, *keys):
    return df.select(*keys, F.posexplode("vector").alias("i", "x")).select(*keys, "i", F.round("x", 6).alias("x"))


def _senses(s, d):
    p = B.table(s, d, "part")
    return p.select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("word"), F.when(F.col("p_partkey") % 2 == 0, "n").otherwise("v").alias("pos"), F.concat("p_name", F.lit("."), F.col("p_partkey").cast("string")).alias("sense"), F.col("p_partkey").alias("nr"), (F.col("p_partkey") % 5 == 0).alias("preferred"))


SENSES = "senses AS (SELECT split_part(p_name, ' ', 2) AS word, CASE WHEN p_partkey % 2 = 0 THEN 'n' ELSE 'v' END AS pos, p_name || '.' || p_partkey AS sense, p_partkey AS nr, p_partkey % 5 = 0 AS preferred FROM part)"


def _disambiguate(s, d):
    c = B.events(s, d).select(F.col("user_id").alias("token"), F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("sense"), F.col("event_id").alias("nr"), (F.col("k") % 30).alias("overlap"), (F.col("k") == 50).alias("preferred"), (F.col("value") / 100).alias("centroid"))
    return V.disambiguate(c)


def _set_preferred(s, d):
    sense = _senses(s, d)
    rulings = sense.where("word <> 'ring'").groupBy("word", "pos").agg(F.max(F.struct("nr", "sense")).alias("m")).select("word", "pos", F.col("m.sense").alias("sense"))
    return V.set_preferred(sense, rulings).select("sense", "preferred")


def _templates(s, d):
    r = B.events(s, d).select(F.col("event_id").alias("request"), F.col("event_type").alias("category"), F.when(F.col("k") % 2 == 0, F.array(F.lit("who"), F.lit("what"))).otherwise(F.array(F.lit("who"))).alias("data"), F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string")).alias("target"))
    kinds = ["view", "click", "error", "purchase"]
    rows = [(k, f"{k}{i}", ["what"] if i % 3 == 0 else ["who"], 1.0 + i, "global" if i < 4 else "u1", i != 2) for k in kinds for i in range(6)]
    shelf = s.createDataFrame(rows, "category string, template string, slots array<string>, weight double, scope string, enabled boolean")
    return V.pick_template(r, shelf, "3")


def _axis(s, d):
    v = B.vectors(s, d)
    return V.axis_antonyms(v.select(F.col("vec_id").alias("word"), F.col("vec_id").alias("index"), "vector"))


def _compose(s, d):
    p = _pairs(s, d)
    m = F.array(F.struct(F.when(F.col("a") % 2 == 0, F.lit(0.5)).otherwise(F.lit(0.0)).alias("weight"), F.col("vb").alias("vector")))
    return _flat(p.select("a", V.compose_vector(F.col("va"), m).alias("vector")), "a")


def _nearest_category(s, d):
    e = B.events(s, d)
    return V.nearest_category(e.select(F.col("user_id").alias("item"), F.col("event_type").alias("category"), (F.col("value") / 200).alias("score")), 0.85)


def _docs(s, d):
    return B.table(s, d, "documents")


def _log_lines(s, d):
    e = B.events(s, d)
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return e.select(F.concat(stamp, F.lit(",123 ["), "event_type", F.lit("] "), F.when(F.col("k") % 9 == 0, "error").otherwise("materialise"), F.lit(": p"), F.col("k").cast("string"), F.lit(", q")).alias("value"))


def _upsert(s, d):
    o = B.table(s, d, "orders")
    rows = o.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("version"), F.col("o_orderpriority").alias("payload"))
    return S.upsert_latest(rows.where("version % 2 = 0"), rows.where("version % 2 = 1"), ["key"], "version")


def _metadata(s, d):
    """The log with ids of messages in its JSON; a fifth of it is broken."""
    log = B.log(s, d)
    told = F.concat(F.lit(', "message_id": "m'), F.col("id").cast("string"), F.lit('"'))
    k = F.element_at(F.split("original", " "), -1).cast("int")
    reply = F.when(k % 3 == 0, F.concat(F.lit(', "reply_to": "m'), (F.col("id") - 1).cast("string"), F.lit('"}'))).otherwise(F.lit("}"))
    return log.withColumn("metadata", F.when(F.col("metadata").endswith("}"), F.concat(F.expr("substr(metadata, 1, length(metadata) - 1)"), told, reply)).otherwise(F.col("metadata")))


def _harvest(s, d):
    """Parts as senses, with relations by key."""
    p, k = B.table(s, d, "part"), F.col("p_partkey")
    each = lambda n, *objects: F.when(k % n == 0, F.array(*objects))
    rows = p.select(
        F.concat("p_name", F.lit("."), k.cast("string")).alias("sense"), F.when(k % 2 == 0, "n").otherwise("a").alias("pos"), F.array("p_brand", "p_type", "p_brand").alias("is_a"), each(2, F.lit("earth")).alias("part_of"),
        each(3, "p_type").alias("entails"), each(5, "p_name").alias("attribute"), each(7, "p_brand", "p_name").alias("similar_to"), each(4, F.lit("sea"), F.lit("sea")).alias("antonym"),
    )
    return S.harvest_relations(rows)


def _repair(s, d):
    o = B.table(s, d, "orders")
    mixed = F.when(F.col("o_orderkey") % 2 == 0, F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("string")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return o.select("o_orderkey", S.repair_epoch(mixed).alias("epoch"))


def _validate(s, d):
    e = B.events(s, d)
    m = F.create_map(F.lit("v"), F.when(F.col("k") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    rows = e.select("event_id", F.when(F.col("k") % 7 > 0, "idle").otherwise("").alias("state"), m.alias("metrics"), F.repeat(F.lit("v"), F.col("k") % 30).alias("version"), F.lit(1).alias("hour"))
    return S.validate_metrics(rows).select("event_id", "reason")


QUERIES = {
    "cosine": lambda s, d: _pairs(s, d).select("a", "b", F.round(V.cosine(F.col("va"), F.col("vb")), 6).alias("cosine"), F.round(V.cosine(F.col("va"), F.col("vb"), False), 6).alias("raw")),
    "role_similarity": lambda s, d: _pairs(s, d).select("a", "b", F.round(V.role_similarity(F.when(F.col("a") % 3 > 0, F.col("va")), F.when(F.col("a") % 2 > 0, F.col("vb"))), 6).alias("s")),
    "compare_clause": _clause_pairs,
    "compare_statement": _statement_pairs,
    "soft_f1": _soft,
    "knn": lambda s, d: V.knn(_queries(s, d), B.vectors(s, d), 5),
    "knn_cells": _cells,
    "knn_opposite": lambda s, d: V.knn_opposite(_queries(s, d), B.vectors(s, d), 5),
    "centroid": lambda s, d: _flat(V.centroid(B.vectors(s, d), "label", F.when(F.col("vec_id") % 2 == 0, 1.0).otherwise(0.25)), "label"),
    "phrase_search": lambda s, d: V.phrase_search(B.vectors(s, d).select((F.col("vec_id") / 3).cast("long").alias("phrase"), "vec_id").where("phrase % 100 = 0"), B.vectors(s, d), 3),
    "label_statement": lambda s, d: V.label_statement(V.centroid(B.vectors(s, d), "label").select(F.col("label").alias("vec_id"), "vector"), B.vectors(s, d)),
    "anchor_classify": lambda s, d: V.anchor_classify(B.vectors(s, d), _anchors(s, d), 0.2, 0.05),
    "axis_antonyms": _axis,
    "nearest_category": _nearest_category,
    "compose_vector": _compose,
    "gloss_tokens": lambda s, d: _docs(s, d).select("doc_id", F.array_join(F.array_sort(V.gloss_tokens(F.col("text"), STOP)), " ").alias("tokens")),
    "primary_senses": lambda s, d: V.primary_senses(_senses(s, d)).select("word", "pos", "sense"),
    "sibling_senses": lambda s, d: V.sibling_senses(_senses(s, d), 4),
    "disambiguate": _disambiguate,
    "set_preferred": _set_preferred,
    "pick_template": _templates,
    "clean_gloss": lambda s, d: _docs(s, d).select("doc_id", X.clean_gloss(F.concat(F.lit('a ("x") '), F.substring("text", 1, 200), F.lit("; more"))).alias("gloss")),
    "frame_gloss": lambda s, d: B.table(s, d, "part").select("p_partkey", X.frame_gloss(F.split_part("p_name", F.lit(" "), F.lit(1)), F.element_at(F.array(F.lit("n"), F.lit("v"), F.lit("a"), F.lit("r")), (F.col("p_partkey") % 4 + 1).cast("int")), F.col("p_type")).alias("sentence")),
    "tidy_text": lambda s, d: B.events(s, d).select("event_id", X.tidy_text(F.concat(F.lit("I can't  see "), "event_type", F.lit(" , we're late ."))).alias("text")),
    "speaker_view": lambda s, d: B.events(s, d).select("event_id", X.speaker_view(F.concat(F.lit("I give you my "), "event_type", F.when(F.col("k") % 5 == 0, " here").otherwise("")), F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("text")),
    "strip_vocative": lambda s, d: B.events(s, d).select("event_id", X.strip_vocative(F.concat(F.lit("Hey Lore, "), "event_type", F.lit(" it, Lore?")), "lore").alias("text")),
    "social_act": lambda s, d: B.events(s, d).select("event_id", X.social_act(F.concat(F.element_at(F.array(F.lit("Hello"), F.lit("Thank you"), F.lit("Go")), (F.col("k") % 3 + 1).cast("int")), F.lit(", "), "event_type")).alias("a")).select("event_id", "a.act", "a.rest"),
    "surface": lambda s, d: B.clauses(s, d).select("stmt_id", "pos", X.surface(F.element_at("senses", "predicate")).alias("word")),
    "render_conclusion": lambda s, d: B.clauses(s, d).select("stmt_id", "pos", X.render_conclusion(F.element_at("senses", "subject"), F.element_at("senses", "predicate"), F.try_element_at("senses", F.lit("direct")), F.col("negated")).alias("text")),
    "majority_vote": lambda s, d: B.events(s, d).select("event_id", X.majority_vote(F.col("k") % 2, F.col("k") % 3, F.col("k") % 5).alias("vote")),
    "conjunct_topics": lambda s, d: B.events(s, d).select("event_id", F.array_join(X.conjunct_topics(F.concat("event_type", F.when(F.col("k") % 2 == 0, " and more").otherwise("")), F.lit(2)), "|", "-").alias("topics")),
    "scrub_names": lambda s, d: B.events(s, d).select("event_id", X.scrub_names(F.concat(F.lit("person:1 met Ann\nmail a@b "), "event_type", F.lit("\nperson:12 "), "event_type"), [("person:1", "Ann", "someone"), ("person:12", "Bob", "another")]).alias("text")),
    "read_min": lambda s, d: _docs(s, d).select("doc_id", X.read_min(F.split("text", "\n")).alias("minutes")),
    "modality_kind": lambda s, d: B.table(s, d, "events").select("event_id", X.modality_kind(F.when(F.col("event_id") % 2 == 0, F.lit('{"items": [], "map": []}')).otherwise(F.col("props"))).alias("kind")),
    "scan_kb": lambda s, d: S.scan_kb(s, d, "orders", "o_orderkey bigint, o_orderstatus string"),
    "active": lambda s, d: S.active(B.table(s, d, "orders").withColumn("archived", F.col("o_orderstatus") == "F")).select("o_orderkey"),
    "upsert_latest": _upsert,
    "harvest_relations": _harvest,
    "resume_anti": lambda s, d: S.resume_anti(B.table(s, d, "orders").select("o_custkey"), B.table(s, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey"),
    "parse_log": lambda s, d: S.parse_log(_log_lines(s, d)).withColumn("premises", F.array_join("premises", ";")),
    "meta_json": lambda s, d: S.meta_json(_metadata(s, d)),
    "repair_epoch": _repair,
    "mark_addressed": lambda s, d: S.mark_addressed(B.events(s, d).select(F.col("event_id").alias("id"), (F.col("k") % 2 == 0).alias("addressed")), B.events(s, d).where("k % 3 = 0").select(F.col("event_id").alias("id"))),
    "validate_metrics": _validate,
    "rehome": lambda s, d: S.rehome(B.table(s, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("original"), (F.col("o_orderkey") % 30).alias("day")), B.table(s, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").cast("string").alias("original")), [1, 2, 3]).select("o_orderkey"),
}

_PAIR = f"WITH {B.VECTORS}, p AS (SELECT x.vec_id AS a, y.vec_id AS b, x.vector AS va, y.vector AS vb FROM vecs x JOIN vecs y ON y.vec_id = x.vec_id + 1)"
_S = lambda a, b: f"((list_cosine_similarity(va[{a + 1}:{b}], vb[{a + 1}:{b}]) + 1) / 2)"
_RANK = "QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= "
_U = "((CAST('0x' || substr(md5(request || ':' || template || ':3'), 1, 8) AS BIGINT) + 1) / 4294967297.0)"

ORACLES = {
    "cosine": f"{_PAIR} SELECT a, b, round((list_cosine_similarity(va, vb) + 1) / 2, 6) AS cosine, round(list_cosine_similarity(va, vb), 6) AS raw FROM p",
    "role_similarity": f"{_PAIR} SELECT a, b, CASE WHEN a % 6 = 0 THEN NULL WHEN a % 3 = 0 OR a % 2 = 0 THEN 0 ELSE round((list_cosine_similarity(va, vb) + 1) / 2, 6) END AS s FROM p",
    "compare_clause": f"""{_PAIR}, q AS (SELECT a, b, {_S(0, 16)} AS p, CASE WHEN a % 5 = 0 THEN (a % 2 = 0)::INT::DOUBLE ELSE {_S(16, 32)} END AS s, CASE WHEN a % 3 > 0 THEN {_S(32, 48)} END AS d, {_S(48, 64)} AS t FROM p)
SELECT a, b, round((0.3 * p + 0.25 * s + coalesce(0.2 * d, 0) + 0.05 * t) / (0.6 + CASE WHEN d IS NULL THEN 0 ELSE 0.2 END), 6)::DOUBLE AS similarity FROM q""",
    "compare_statement": f"""WITH {B.VECTORS}, v AS (SELECT vec_id // 4 AS st, vec_id % 4 AS leaf, vector FROM vecs), l AS (SELECT x.st AS a, y.st AS b, x.leaf AS i, y.leaf AS j, (list_cosine_similarity(x.vector, y.vector) + 1) / 2 AS sim FROM v x JOIN v y ON y.st = x.st + 1 AND y.leaf < 3),
bi AS (SELECT a, b, avg(m) AS r FROM (SELECT a, b, i, max(sim) AS m FROM l GROUP BY 1, 2, 3) GROUP BY 1, 2), bj AS (SELECT a, b, avg(m) AS p FROM (SELECT a, b, j, max(sim) AS m FROM l GROUP BY 1, 2, 3) GROUP BY 1, 2), pl AS (SELECT a, b, sum(CASE WHEN i = j THEN sim ELSE 0 END) / 4 AS placed FROM l GROUP BY 1, 2)
SELECT a, b, round((0.7 * CASE WHEN a % 2 = 0 THEN placed ELSE 2 * r * p / (r + p) END + 0.1 + CASE WHEN a % 3 = 0 THEN 0.1 ELSE 0 END) / (0.9 + CASE WHEN a % 3 = 0 THEN 0.1 ELSE 0 END), 6)::DOUBLE AS similarity FROM bi JOIN bj USING (a, b) JOIN pl USING (a, b)""",
    "soft_f1": f"""WITH {B.VECTORS}, v AS (SELECT vec_id // 6 AS pair, vec_id % 6 AS item, vector FROM vecs), l AS (SELECT x.pair, x.item AS i, y.item AS j, greatest(0, list_cosine_similarity(x.vector[1:16], y.vector[1:16])) * (list_cosine_similarity(x.vector[17:], y.vector[17:]) + 1) / 2 AS s FROM v x JOIN v y ON x.pair = y.pair AND x.item < 3 AND y.item >= 3),
bi AS (SELECT pair, avg(m) AS r FROM (SELECT pair, i, max(s) AS m FROM l GROUP BY 1, 2) GROUP BY 1), bj AS (SELECT pair, avg(m) AS p FROM (SELECT pair, j, max(s) AS m FROM l GROUP BY 1, 2) GROUP BY 1) SELECT pair, CASE WHEN r + p = 0 THEN 0 ELSE round(2 * r * p / (r + p), 6) END::DOUBLE AS f1 FROM bi JOIN bj USING (pair)""",
    "knn": f"WITH {B.VECTORS}, s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.vector, v.vector), 6) AS score FROM vecs q, vecs v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id) SELECT * FROM s {_RANK} 5",
    "knn_opposite": f"WITH {B.VECTORS}, s AS (SELECT q.vec_id AS query_id, v.vec_id, round(-list_cosine_similarity(q.vector, v.vector), 6) AS score FROM vecs q, vecs v WHERE q.vec_id % 100 = 0) SELECT * FROM s {_RANK} 5",
    "centroid": f"WITH {B.VECTORS}, e AS (SELECT label, CASE WHEN vec_id % 2 = 0 THEN 1.0 ELSE 0.25 END AS w, unnest(vector) AS x, unnest(range(64)) AS i FROM vecs) SELECT label, i::INT AS i, round(sum(w * x) / sum(w), 6)::DOUBLE AS x FROM e GROUP BY 1, 2",
    "phrase_search": f"""WITH {B.VECTORS}, e AS (SELECT vec_id // 3 AS query_id, unnest(vector) AS x, unnest(range(64)) AS i FROM vecs WHERE (vec_id // 3) % 100 = 0), m AS (SELECT query_id, i, avg(x) AS x FROM e GROUP BY 1, 2), c AS (SELECT query_id, list(x ORDER BY i) AS v FROM m GROUP BY 1),
s AS (SELECT query_id, vec_id, round(list_cosine_similarity(v, vector), 6) AS score FROM c, vecs) SELECT * FROM s {_RANK} 3""",
    "label_statement": f"""WITH {B.VECTORS}, e AS (SELECT label AS query_id, unnest(vector) AS x, unnest(range(64)) AS i FROM vecs), m AS (SELECT query_id, i, avg(x) AS x FROM e GROUP BY 1, 2), c AS (SELECT query_id, list(x ORDER BY i) AS v FROM m GROUP BY 1),
s AS (SELECT query_id, vec_id, round(list_cosine_similarity(v, vector), 6) AS score FROM c, vecs) SELECT * FROM s {_RANK} 1""",
    "anchor_classify": f"""WITH {B.VECTORS}, f AS (SELECT label, arg_min(vector, vec_id) AS av FROM vecs GROUP BY 1), s AS (SELECT v.vec_id, f.label::VARCHAR AS value, round(list_cosine_similarity(v.vector, av), 6) AS s FROM vecs v, f),
r AS (SELECT *, row_number() OVER w AS n, lead(s) OVER w AS s2 FROM s WINDOW w AS (PARTITION BY vec_id ORDER BY s DESC, value DESC)) SELECT vec_id, CASE WHEN s >= 0.2 AND s - s2 >= 0.05 THEN value ELSE 'none' END AS value FROM r WHERE n = 1""",
    "axis_antonyms": f"WITH {B.VECTORS}, e AS (SELECT vec_id AS a, unnest(vector) AS x, unnest(range(64)) AS b FROM vecs), p AS (SELECT a, b FROM e WHERE x < 0 AND a <> b) SELECT a, b FROM p UNION SELECT b, a FROM p",
    "nearest_category": f"WITH {B.EVENTS} SELECT user_id AS item, arg_min(event_type, (-value, event_type)) AS category FROM ev WHERE value / 200 >= 0.85 GROUP BY 1",
    "compose_vector": f"{_PAIR}, e AS (SELECT a, unnest(va) AS x, unnest(vb) AS y, unnest(range(64)) AS i FROM p) SELECT a, i::INT AS i, round(tanh(x + CASE WHEN a % 2 = 0 THEN 0.5 ELSE 0 END * y), 6) AS x FROM e",
    "gloss_tokens": f"WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents), u AS (SELECT DISTINCT doc_id, w FROM w WHERE length(w) > 2 AND w NOT IN {tuple(STOP)!r}) SELECT d.doc_id, coalesce(string_agg(w, ' ' ORDER BY w), '') AS tokens FROM documents d LEFT JOIN u USING (doc_id) GROUP BY 1",
    "primary_senses": f"WITH {SENSES} SELECT word, pos, sense FROM senses QUALIFY row_number() OVER (PARTITION BY word, pos ORDER BY nr, sense) <= 3",
    "sibling_senses": f"WITH {SENSES}, r AS (SELECT *, row_number() OVER (PARTITION BY word, pos ORDER BY nr, sense) AS rank FROM senses) SELECT s.sense, r.sense AS sibling, rank FROM senses s JOIN r ON s.word = r.word AND s.pos = r.pos AND s.sense <> r.sense WHERE rank <= 4",
    "disambiguate": f"""WITH {B.EVENTS}, c AS (SELECT user_id AS token, 's' || event_id AS sense, event_id AS nr, k % 30 AS overlap, k = 50 AS preferred, value / 100 AS centroid FROM ev), m AS (SELECT token, max(overlap) AS o, max(centroid) AS c1 FROM c GROUP BY 1),
n AS (SELECT c.token, o, c1, count(*) FILTER (overlap = o) AS n, max(centroid) FILTER (centroid < c1) AS c2, min(CASE WHEN overlap = o THEN sense END) AS by_o, min(CASE WHEN preferred THEN sense END) AS by_p, min(CASE WHEN centroid = c1 THEN sense END) AS by_c, arg_min(sense, (nr, sense)) AS low FROM c JOIN m USING (token) GROUP BY 1, 2, 3)
SELECT token, coalesce(CASE WHEN o > 0 AND n = 1 THEN by_o END, by_p, CASE WHEN c1 >= 0.5 AND c1 - coalesce(c2, 0) >= 0.1 THEN by_c END, low) AS sense FROM n""",
    "set_preferred": f"WITH {SENSES} SELECT sense, CASE WHEN word <> 'ring' THEN nr = max(nr) OVER (PARTITION BY word, pos) ELSE preferred END AS preferred FROM senses",
    "pick_template": f"""WITH {B.EVENTS}, shelf AS (SELECT c AS category, c || i AS template, CASE WHEN i % 3 = 0 THEN 'what' ELSE 'who' END AS slot, 1.0 + i AS weight, CASE WHEN i < 4 THEN 'global' ELSE 'u1' END AS scope FROM (SELECT unnest(['view', 'click', 'error', 'purchase']) AS c), range(6) x(i) WHERE i <> 2),
f AS (SELECT event_id AS request, template, ln({_U.replace("request", "event_id")}) / weight AS key FROM ev JOIN shelf ON event_type = category WHERE (slot = 'who' OR k % 2 = 0) AND (scope = 'global' OR scope = 'u' || (user_id % 3))) SELECT request, arg_max(template, key) AS template FROM f GROUP BY 1""",
    "clean_gloss": r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace('a ("x") ' || substr(text, 1, 200) || '; more', '\([^)]*\)', '', 'g'), '[;:][^\n]*$', ''), '["''`]', '', 'g'), '\s+', ' ', 'g')) AS gloss FROM documents""",
    "frame_gloss": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CASE WHEN regexp_matches(lower(p_name), '^[aeiou]') THEN 'an ' ELSE 'a ' END || split_part(p_name, ' ', 1) || ' is ' || p_type WHEN 1 THEN 'to ' || split_part(p_name, ' ', 1) || ' is to ' || p_type WHEN 2 THEN split_part(p_name, ' ', 1) || ' means ' || p_type END AS sentence FROM part",
    "tidy_text": f"WITH {B.EVENTS} SELECT event_id, 'I cannot see ' || event_type || ', we are late.' AS text FROM ev",
    "speaker_view": f"WITH {B.EVENTS} SELECT event_id, CASE WHEN k % 5 > 0 THEN 'u' || user_id || ' give i u' || user_id || '''s ' || event_type END AS text FROM ev",
    "strip_vocative": f"WITH {B.EVENTS} SELECT event_id, event_type || ' it?' AS text FROM ev",
    "social_act": f"WITH {B.EVENTS} SELECT event_id, CASE k % 3 WHEN 0 THEN 'greeting' WHEN 1 THEN 'thanks' END AS act, event_type AS rest FROM ev",
    "surface": f"WITH {B.clauses_sql()} SELECT stmt_id, pos, split_part(s_predicate, '.', 1) AS word FROM clauses",
    "render_conclusion": f"WITH {B.clauses_sql()} SELECT stmt_id, pos, concat_ws(' ', split_part(s_subject, '.', 1), CASE WHEN negated THEN 'does not ' ELSE '' END || split_part(s_predicate, '.', 1), split_part(s_direct, '.', 1)) AS text FROM clauses",
    "majority_vote": f"WITH {B.EVENTS} SELECT event_id, CASE WHEN k % 2 = k % 3 THEN k % 2 WHEN k % 2 = k % 5 THEN k % 2 WHEN k % 3 = k % 5 THEN k % 3 ELSE k % 5 END AS vote FROM ev",
    "conjunct_topics": f"WITH {B.EVENTS} SELECT event_id, CASE WHEN k % 2 = 0 THEN event_type || '|more' ELSE '-|-' END AS topics FROM ev",
    "scrub_names": f"WITH {B.EVENTS} SELECT event_id, 'someone met someone' || chr(10) || 'another ' || event_type AS text FROM ev",
    "read_min": r"SELECT doc_id, greatest(1, floor(list_sum(list_transform(string_split(text, chr(10)), lambda p: len(regexp_split_to_array(trim(p), '\s+')))) / 200))::INT AS minutes FROM documents",
    "modality_kind": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'statement' ELSE 'language' END AS kind FROM events",
    "scan_kb": "SELECT o_orderkey, o_orderstatus FROM orders",
    "active": "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'",
    "upsert_latest": "SELECT o_custkey AS key, max(o_orderkey) AS version, arg_max(o_orderpriority, o_orderkey) AS payload FROM orders GROUP BY 1",
    "harvest_relations": """WITH p AS (SELECT *, p_name || '.' || p_partkey AS sense, CASE WHEN p_partkey % 2 = 0 THEN 'n' ELSE 'a' END AS pos FROM part), e AS (SELECT sense, 'is_a' AS relation, p_brand AS object, pos FROM p UNION SELECT sense, 'is_a', p_type, pos FROM p
 UNION SELECT sense, 'part_of', 'earth', pos FROM p WHERE p_partkey % 2 = 0 UNION SELECT sense, 'entails', p_type, pos FROM p WHERE p_partkey % 3 = 0 UNION SELECT sense, 'attribute', p_name, pos FROM p WHERE p_partkey % 5 = 0
 UNION SELECT sense, 'similar_to', unnest([p_brand, p_name]), pos FROM p WHERE p_partkey % 7 = 0 UNION SELECT sense, 'antonym', 'sea', pos FROM p WHERE p_partkey % 4 = 0) SELECT sense AS subject, relation, object, pos FROM e""",
    "resume_anti": "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)",
    "parse_log": f"WITH {B.EVENTS} SELECT us // 1000000 * 1000000 + 123000 AS us, event_type AS phase, CASE WHEN k % 9 = 0 THEN 'error' ELSE 'materialise' END AS event, 'p' || k || ';q' AS premises, CASE WHEN k % 9 = 0 THEN 'error' ELSE 'info' END AS level FROM ev",
    "meta_json": f"WITH {B.EVENTS} SELECT event_id AS id, CASE WHEN k % 5 = 0 THEN '#' || (k % 10) ELSE 'c' || k END AS channel_id, CASE WHEN k % 5 > 0 THEN 'm' || event_id END AS message_id, CASE WHEN k % 5 > 0 AND k % 3 = 0 THEN 'm' || (event_id - 1) END AS reply_to FROM ev",
    "repair_epoch": "SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS epoch FROM orders",
    "mark_addressed": f"WITH {B.EVENTS} SELECT event_id AS id, k % 2 = 0 OR k % 3 = 0 AS addressed FROM ev",
    "validate_metrics": f"WITH {B.EVENTS} SELECT event_id, CASE WHEN k % 7 = 0 THEN 'state' WHEN k % 11 = 0 THEN 'metrics' WHEN k % 30 > 24 THEN 'version' END AS reason FROM ev",
    "rehome": "SELECT o_orderkey FROM orders WHERE o_orderkey % 30 NOT IN (1, 2, 3) AND o_custkey % 3 <> 0",
}
ORACLES["knn_cells"] = ORACLES["knn"].replace("SELECT * FROM s", "SELECT *, true AS proved FROM s")
