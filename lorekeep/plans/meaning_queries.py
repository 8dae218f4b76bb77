"""Queries of topics, word similarity, rewrite checks, discourse time and sense pins, with SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.operators import graph as G
from lorekeep.operators import meaning as M
from lorekeep.operators.clauses import role_key
from lorekeep.plans import bindings as B

_WITHIN = 3 * 86400
_ME = 7


def _floats(*columns):
    return F.array(*[c.cast("double") for c in columns])


def topics(s, d):
    k = F.element_at(F.split("original", " "), -1).cast("int")
    log = B.log(s, d).withColumn("k", k)
    return M.topic_centroid(log.select("id", "us", "channel", "source_id", _floats(F.col("k") % 7 - 3, F.col("k") % 5, F.lit(1)).alias("vector")), me=_ME, within=_WITHIN)


TOPICS = f"""{B.LOG}, ring AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY us DESC, id DESC) AS r, max(us) OVER (PARTITION BY channel) AS now FROM log),
topic AS (SELECT channel, avg(k % 7 - 3) AS x0, avg(k % 5) AS x1, 1.0::DOUBLE AS x2 FROM ring WHERE r <= 30 AND us >= now - {_WITHIN}::BIGINT * 1000000 AND source_id <> {_ME} GROUP BY 1)"""


def _topic_rows(s, d):
    return topics(s, d).select("channel", *[F.round(F.get("vector", F.lit(i)), 6).alias(f"x{i}") for i in range(3)])


def notions(s, d):
    o = B.table(s, d, "orders")
    k = F.col("o_orderkey")
    told = o.where(k % 4 == 0).select((k % 10).alias("channel"), k.alias("notion_id"))
    return o.select(k.alias("notion_id"), _floats(k % 11 - 5, k % 13, k % 3).alias("vector")), told


def association(s, d):
    n, told = notions(s, d)
    return M.association(topics(s, d), n, told, s.createDataFrame([(3,)], "channel long"), floor=0.6)


ASSOCIATION = f"""{TOPICS}, notion AS (SELECT o_orderkey AS id, (o_orderkey % 11 - 5)::DOUBLE AS y0, (o_orderkey % 13)::DOUBLE AS y1, (o_orderkey % 3)::DOUBLE AS y2 FROM orders),
near AS (SELECT channel, id, round((x0 * y0 + x1 * y1 + x2 * y2) / sqrt(x0 * x0 + x1 * x1 + x2 * x2) / sqrt(y0 * y0 + y1 * y1 + y2 * y2), 6) AS p FROM topic, notion WHERE channel <> 3 AND NOT (id % 4 = 0 AND id % 10 = channel) AND y0 * y0 + y1 * y1 + y2 * y2 > 0),
assoc AS (SELECT channel, arg_min(id, (-p, id)) AS notion_id, max(p) AS proximity FROM near GROUP BY 1 HAVING max(p) >= 0.6)"""


def _matrix(s, d):
    """Customers are senses of 40 words, suppliers base words, some with a customer's sense; the taxonomy is that of nations and regions."""
    c, z = B.table(s, d, "customer"), B.table(s, d, "supplier")
    k, j = F.col("c_custkey"), F.col("s_suppkey")
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    targets = c.select(text("w", k % 40).alias("word"), text("C:", k).alias("synset"), F.when(k % 9 == 0, "v").otherwise("n").alias("pos"), F.lit(0).alias("rank"))
    base = z.select(text("w", j).alias("word"), text("S:", j).alias("synset"), F.lit("n").alias("pos"), F.lit(1).alias("rank"))
    base = base.unionByName(z.where(j % 3 == 0).select(text("w", j).alias("word"), text("C:", j).alias("synset"), F.lit("n").alias("pos"), F.lit(0).alias("rank")))
    link = lambda n, r: c.where(k % n == r).select(text("C:", k).alias("synset"), text("S:", k % 100).alias("other"))
    p = B.table(s, d, "part")
    tokens = F.concat(F.split("p_name", " "), F.array("p_brand", "p_type"))
    glosses = p.select(text("C:", F.col("p_partkey")).alias("key"), tokens.alias("tokens")).unionByName(p.select(text("w", F.col("p_partkey")).alias("key"), tokens.alias("tokens")))
    return M.semantic_matrix(targets, base, link(5, 1), link(7, 2), G.ancestors(B.edges(s, d)), glosses)


MATRIX = """WITH tgt AS (SELECT 'w' || (c_custkey % 40) AS word, 'C:' || c_custkey AS synset, c_custkey AS k, c_custkey % 9 > 0 AS noun, n_nationkey, n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey),
bs AS (SELECT 'w' || s_suppkey AS base, 'S:' || s_suppkey AS sense, s_suppkey AS j, n_nationkey AS bn, n_regionkey AS br, NULL AS own FROM supplier JOIN nation ON n_nationkey = s_nationkey
 UNION ALL SELECT 'w' || s_suppkey, 'C:' || s_suppkey, s_suppkey, n_nationkey, n_regionkey, c_custkey FROM supplier JOIN customer ON c_custkey = s_suppkey JOIN nation ON n_nationkey = c_nationkey WHERE s_suppkey % 3 = 0),
tok AS (SELECT DISTINCT p_partkey AS k, unnest(list_concat(string_split(p_name, ' '), [p_brand, p_type])) AS t FROM part), size AS (SELECT k, count(*) AS n FROM tok GROUP BY 1),
common AS (SELECT a.k, b.k AS j, count(*) AS c FROM tok a JOIN tok b USING (t) WHERE b.k IN (SELECT s_suppkey FROM supplier) AND a.k IN (SELECT c_custkey FROM customer) GROUP BY 1, 2 HAVING count(*) >= 2),
gl AS (SELECT common.k, j, least(round(5.0::DOUBLE * c / (x.n + y.n - c), 3), 0.5::DOUBLE) AS v FROM common JOIN size x ON x.k = common.k JOIN size y ON y.k = j),
pairs AS (SELECT word, synset, t.k, b.j, base, bool_or(synset = sense) AS same, bool_or(t.k % 5 = 1 AND sense = 'S:' || (t.k % 100)) AS opposed, bool_or(t.k % 7 = 2 AND sense = 'S:' || (t.k % 100)) AS derives,
 bool_or(noun AND (n_nationkey = bn)) AS near, bool_or(noun AND synset = sense) AS self FROM tgt t, bs b GROUP BY ALL),
ruled AS (SELECT word, synset, base, CASE WHEN word = base THEN 1 WHEN same THEN 2 WHEN opposed THEN 3 WHEN derives THEN 4 WHEN near THEN 5 WHEN v > 0.1 THEN 6 END AS rule, v FROM pairs LEFT JOIN gl USING (k, j))
SELECT word, synset, base, rule, CASE rule WHEN 1 THEN 1.0 WHEN 2 THEN 1.0 WHEN 3 THEN -1.0 WHEN 4 THEN 0.9 WHEN 5 THEN 0.75 ELSE v END::DOUBLE AS value FROM ruled WHERE rule IS NOT NULL"""


def _leaves(s, d):
    e = F.col("event_id")
    vector = F.when(e % 10 > 0, _floats(e % 7 - 3, e % 5, F.lit(1)))
    asks = F.col("wh_role").isNotNull() | (e % 17 == 0)
    keys = [role_key(r).alias(r) for r in ("subject", "predicate", "direct")]
    return B.clauses(s, d).select(F.col("stmt_id").alias("doc_id"), "pos", (e % 13 != 0).alias("sound"), *keys, "negated", "quantifier", "modal", asks.alias("question"), vector.alias("vector"))


def _rewritten(rows: DataFrame) -> DataFrame:
    """Rewrites with one change each, by document."""
    case, pos = F.col("doc_id") % 11, F.col("pos")
    out = rows.where(~((case == 1) & (pos == 0)))
    out = out.withColumn("negated", F.when((case == 2) & (pos == 0), ~F.col("negated")).otherwise(F.col("negated")))
    out = out.withColumn("quantifier", F.when((case == 3) & (pos == 0), F.lit("other")).otherwise(F.col("quantifier")))
    out = out.withColumn("question", F.col("question") & (case != 5))
    out = out.withColumn("vector", F.when(case == 6, F.transform("vector", lambda x: -x)).otherwise(F.col("vector")))
    out = out.withColumn("sound", F.when(case == 7, F.col("sound")).otherwise(F.lit(True)))
    more = [out.where((case == 4) & (pos == 0)).withColumn("pos", F.lit(1000 + i)) for i in range(3)]
    return reduce(DataFrame.unionByName, [out, *more])


def _preserves(strict):
    def query(s, d):
        rows = _leaves(s, d)
        return M.preserves(rows, _rewritten(rows), strict=strict)

    return query


def _preserves_sql(strict):
    raw, count = ("WHEN NOT b.sound THEN 'raw'", "WHEN a.n <> b.n THEN 'count'") if strict else ("", "")
    sums = "count(*) AS n, bool_and(sound) AS sound, bool_or(question) AS asks, sum(x0) FILTER (WHERE sound) AS s0, sum(x1) FILTER (WHERE sound) AS s1, sum(x2) FILTER (WHERE sound) AS s2"
    return f"""WITH {B.clauses_sql()}, bef AS (SELECT stmt_id AS doc_id, pos, event_id % 13 <> 0 AS sound, subject, s_predicate AS predicate, s_direct AS direct, negated, quantifier, modal, wh_role IS NOT NULL OR event_id % 17 = 0 AS question,
 CASE WHEN event_id % 10 > 0 THEN event_id % 7 - 3 END::DOUBLE AS x0, CASE WHEN event_id % 10 > 0 THEN event_id % 5 END::DOUBLE AS x1, CASE WHEN event_id % 10 > 0 THEN 1.0 END::DOUBLE AS x2 FROM clauses),
one AS (SELECT doc_id, pos, doc_id % 11 <> 7 OR sound AS sound, subject, predicate, direct, CASE WHEN doc_id % 11 = 2 AND pos = 0 THEN NOT negated ELSE negated END AS negated, CASE WHEN doc_id % 11 = 3 AND pos = 0 THEN 'other' ELSE quantifier END AS quantifier, modal,
 question AND doc_id % 11 <> 5 AS question, CASE WHEN doc_id % 11 = 6 THEN -x0 ELSE x0 END AS x0, CASE WHEN doc_id % 11 = 6 THEN -x1 ELSE x1 END AS x1, CASE WHEN doc_id % 11 = 6 THEN -x2 ELSE x2 END AS x2 FROM bef WHERE NOT (doc_id % 11 = 1 AND pos = 0)),
aft AS (SELECT * FROM one UNION ALL SELECT one.* REPLACE ((1000 + i)::INT AS pos) FROM one, range(3) r(i) WHERE doc_id % 11 = 4 AND pos = 0),
b AS (SELECT doc_id, {sums} FROM bef GROUP BY 1), a AS (SELECT doc_id, {sums} FROM aft GROUP BY 1),
m AS (SELECT doc_id, subject, predicate, direct, negated, arg_max(coalesce(quantifier, '') || '/' || coalesce(modal, ''), pos) AS flags FROM aft GROUP BY ALL),
f AS (SELECT bef.doc_id, arg_min(CASE WHEN m.doc_id IS NULL THEN 'dropped' ELSE 'flag' END, pos) AS why FROM bef LEFT JOIN m ON m.doc_id = bef.doc_id AND m.subject IS NOT DISTINCT FROM bef.subject AND m.predicate IS NOT DISTINCT FROM bef.predicate AND m.direct IS NOT DISTINCT FROM bef.direct AND m.negated = bef.negated
 WHERE sound AND (m.doc_id IS NULL OR m.flags <> coalesce(quantifier, '') || '/' || coalesce(modal, '')) GROUP BY 1),
r AS (SELECT b.doc_id, CASE {raw} WHEN a.n IS NULL OR NOT a.sound THEN 'unsound' WHEN a.n > b.n + 2 THEN 'balloons' WHEN b.asks AND NOT a.asks THEN 'mood'
 WHEN round((a.s0 * b.s0 + a.s1 * b.s1 + a.s2 * b.s2) / sqrt(a.s0 ** 2 + a.s1 ** 2 + a.s2 ** 2) / sqrt(b.s0 ** 2 + b.s1 ** 2 + b.s2 ** 2), 6) < 0.6 THEN 'drifts' WHEN why IS NOT NULL THEN why {count} END AS reason FROM b LEFT JOIN a ON a.doc_id = b.doc_id LEFT JOIN f ON f.doc_id = b.doc_id)
SELECT doc_id, reason IS NULL AS ok, reason FROM r"""


_WORDS = ["today", "tomorrow", "yesterday", "nowhere"]
_THEN = ["then", "finally", "before", "meanwhile", "perhaps"]
_TENSE = ["past", "pres", "fut", "none"]


def _time(s, d):
    e = F.col("event_id")
    pick = lambda xs, k: F.element_at(F.array(*[F.lit(x) for x in xs]), (k + 1).cast("int"))
    rows = B.clauses(s, d).select(
        F.col("user_id").alias("doc_id"),
        e.alias("pos"),
        F.when(e % 23 == 0, (e % 48) / 24.0).alias("offset"),
        F.when(e % 11 == 0, pick(_WORDS, e % 4)).alias("anchor"),
        F.when(e % 3 == 0, pick(_THEN, e % 5)).alias("sequence"),
        pick(_TENSE, e % 4).alias("tense"),
    )
    return M.discourse_time(rows)


TIME_SQL = f"""WITH RECURSIVE ev AS (SELECT user_id AS doc_id, event_id AS e, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
cue AS (SELECT *, CASE WHEN e % 23 = 0 THEN (e % 48) / 24.0::DOUBLE WHEN e % 11 = 0 THEN CASE e % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 WHEN 2 THEN -1.0 END::DOUBLE END AS put,
 CASE WHEN e % 3 = 0 THEN CASE e % 5 WHEN 0 THEN 0.1 WHEN 1 THEN 0.2 WHEN 2 THEN -0.1 ELSE 0.0 END ELSE 0.0 END::DOUBLE AS move, CASE e % 4 WHEN 0 THEN -0.5 WHEN 1 THEN 0.0 WHEN 2 THEN 0.5 END::DOUBLE AS tense FROM ev),
walk AS (SELECT doc_id, 0::BIGINT AS n, NULL::BIGINT AS pos, 0.0::DOUBLE AS t, false AS anchored FROM (SELECT DISTINCT doc_id FROM ev)
 UNION ALL SELECT w.doc_id, c.n, c.e, CASE WHEN c.put IS NOT NULL THEN c.put WHEN c.move <> 0 THEN w.t + c.move WHEN NOT w.anchored AND c.tense IS NOT NULL THEN c.tense ELSE w.t END, w.anchored OR c.put IS NOT NULL FROM walk w JOIN cue c ON c.doc_id = w.doc_id AND c.n = w.n + 1)
SELECT doc_id, pos, round(t, 6) + 0.0 AS time FROM walk WHERE n > 0"""


def pins(s, d):
    p = B.table(s, d, "part")
    k = F.col("p_partkey")
    word, number = F.split_part("p_name", F.lit(" "), F.lit(2)), k.cast("string")
    tail = F.concat(F.lit("made of "), "p_name", F.lit(" "), (k % 500).cast("string"))
    frames = [F.concat(F.lit("a "), word, F.lit(" is "), tail), F.concat(F.lit("something "), word, F.lit(" is "), tail), F.concat(F.lit("an "), word, F.lit(" is of "), "p_type"), F.concat(F.lit("to "), word, F.lit(" is "), tail)]
    original = F.element_at(F.array(*frames), (k % 4 + 1).cast("int"))
    pos = F.when(k % 4 == 0, "n").when(k % 8 == 1, "s").otherwise("a")
    glosses = p.select(word.alias("word"), pos.alias("pos"), k.alias("rank"), F.concat(word, F.lit(".x."), number).alias("sense"), F.concat(F.lit('("old") '), tail, F.lit("; more")).alias("gloss"))
    right = F.concat(word, F.lit(".x."), number)
    first = F.when(k % 6 == 0, F.lit(None)).when(k % 5 == 0, right).otherwise(F.lit("w.n.01"))
    subjects = F.array(first, F.when(k % 3 == 0, F.lit("v.n.01")).otherwise(F.lit("w.n.01")), F.lit("w.n.01"))
    leaves = p.select(k.alias("doc_id"), F.posexplode(F.when(k % 10 < 9, subjects).otherwise(F.array(F.lit(None).cast("string")))).alias("pos", "subject"))
    return M.pin_senses(p.select(k.alias("doc_id"), original.alias("original")), leaves, glosses)


PINS_SQL = """WITH p AS (SELECT p_partkey AS k, split_part(p_name, ' ', 2) AS word, p_name, p_partkey % 500 AS t, p_partkey % 4 AS f, split_part(p_name, ' ', 2) || '.x.' || p_partkey AS own FROM part),
g AS (SELECT word, p_name, t, CASE WHEN f = 0 THEN 'n' ELSE 'a' END AS pos, arg_min(own, k) AS sense FROM p GROUP BY ALL),
l AS (SELECT k AS doc_id, 0 AS pos, CASE WHEN k % 6 = 0 THEN NULL WHEN k % 5 = 0 THEN own ELSE 'w.n.01' END AS subject FROM p WHERE k % 10 < 9 UNION ALL SELECT k, 1, CASE WHEN k % 3 = 0 THEN 'v.n.01' ELSE 'w.n.01' END FROM p WHERE k % 10 < 9 UNION ALL SELECT k, 2, 'w.n.01' FROM p WHERE k % 10 < 9 UNION ALL SELECT k, 0, NULL FROM p WHERE k % 10 = 9),
c AS (SELECT doc_id, arg_min(subject, pos) FILTER (WHERE subject IS NOT NULL) AS compiled FROM l GROUP BY 1),
r AS (SELECT p.k AS doc_id, CASE WHEN f = 3 THEN 'other frame' WHEN g.sense IS NULL THEN 'no sense' WHEN compiled IS NULL THEN 'no subject' WHEN compiled = g.sense THEN 'already' ELSE 'pinned' END AS status, g.sense, compiled
 FROM p JOIN c ON c.doc_id = p.k LEFT JOIN g ON f < 2 AND g.word = p.word AND g.p_name = p.p_name AND g.t = p.t AND g.pos = CASE f WHEN 0 THEN 'n' ELSE 'a' END)
SELECT r.doc_id, status, sense, CASE WHEN status = 'pinned' THEN (SELECT count(*) FROM l WHERE l.doc_id = r.doc_id AND l.subject = compiled) ELSE 0 END AS patched FROM r"""

QUERIES = {
    "topic_centroid": _topic_rows,
    "association": association,
    "semantic_matrix": _matrix,
    "preserves": _preserves(False),
    "preserves_strict": _preserves(True),
    "discourse_time": _time,
    "pin_senses": lambda s, d: pins(s, d)[1],
}

ORACLES = {
    "topic_centroid": f"WITH {TOPICS} SELECT channel, round(x0, 6) AS x0, round(x1, 6) AS x1, x2 FROM topic",
    "association": f"WITH {ASSOCIATION} SELECT * FROM assoc",
    "semantic_matrix": MATRIX,
    "preserves": _preserves_sql(False),
    "preserves_strict": _preserves_sql(True),
    "discourse_time": TIME_SQL,
    "pin_senses": PINS_SQL,
}
