"""Topics and associations, word similarity matrices, rewrite checks, discourse time and sense pins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.text import clean_gloss
from lorekeep.operators.neighbours import knn
from lorekeep.operators.timeline import SECOND
from lorekeep.operators.vectors import centroid, cosine, norm
from lorekeep.runtime import cut, store

# Words that set the time of a clause (days from now), that move it on, and tenses.
ANCHORS = {"now": 0.0, "today": 0.0, "tonight": 0.0, "yesterday": -1.0, "tomorrow": 1.0}
SEQUENCE = {
    "then": 0.1, "after": 0.1, "afterward": 0.1, "afterwards": 0.1, "later": 0.1, "next": 0.1, "subsequently": 0.1, "finally": 0.2,
    "before": -0.1, "previously": -0.1, "earlier": -0.1, "meanwhile": 0.0, "simultaneously": 0.0,
}
TENSES = {"past": -0.5, "pres": 0.0, "fut": 0.5}


def _lookup(values: dict[str, float], c: Column) -> Column:
    return F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in values.items()])


def topic_centroid(log: DataFrame, me: int = 0, rows: int = 30, within: int = 1800) -> DataFrame:
    """(channel, vector): mean vector of what others said in each channel's last `rows` rows of the last `within` seconds.

    log (id, us, channel, source_id, vector); time is that of the channel's newest row. Channels where nobody else spoke, or
    nothing with a vector, have no topic. The ring is a row_number filter, so only its rows are shuffled.
    """
    newest = Window.partitionBy("channel").orderBy(F.desc("us"), F.desc("id"))
    ring = log.select("id", "us", "channel", "source_id", "vector", F.row_number().over(newest).alias("r")).where(F.col("r") <= rows)
    ring = ring.withColumn("now", F.max("us").over(Window.partitionBy("channel"))).where(F.col("us") >= F.col("now") - within * SECOND)
    return centroid(ring.where((F.col("source_id") != me) & F.col("vector").isNotNull()), "channel")


def association(topics: DataFrame, notions: DataFrame, mentioned: DataFrame, cooling: DataFrame, floor: float = 0.6) -> DataFrame:
    """(channel, notion_id, proximity): the nearest notion to each channel's topic, at or above the floor; ties by id.

    Channels in `cooling` get none, a notion in `mentioned` (channel, notion_id) is passed over. A notion takes along who mentioned it, so a
    task holds one notion a channel, however many were mentioned.
    """
    t = topics.join(cooling.select("channel").distinct(), "channel", "left_anti")
    t = cut(t.where(norm(F.col("vector")) > 0).select(F.col("channel").alias("vec_id"), "vector"))
    told = mentioned.join(t.select(F.col("vec_id").alias("channel")), "channel", "left_semi").groupBy(F.col("notion_id").alias("vec_id")).agg(F.collect_set("channel").alias("barred"))
    n = notions.where(norm(F.col("vector")) > 0).select(F.col("notion_id").alias("vec_id"), "vector").join(told, "vec_id", "left")
    near = knn(t, n, 1, keep_self=True).where(F.col("score") >= floor)
    return near.select(F.col("query_id").alias("channel"), F.col("vec_id").alias("notion_id"), F.col("score").alias("proximity"))


def _classes(df: DataFrame, c: str, number: str) -> DataFrame:
    """(c, number): the distinct values of a column, numbered and stored."""
    return store(df.select(c).distinct().withColumn(number, F.monotonically_increasing_id()))


def _meet(many: DataFrame, others: DataFrame, key: str, rows: int = 4096) -> DataFrame:
    """Equi-join in which the rows of a key come in blocks of about `rows`, each with a copy of the other side's rows of that key, so tasks share a
    frequent key and what it gives, and a small table that gives many rows is not one task."""
    blocks = store(many.groupBy(key).agg(F.ceil(F.count("*") / rows).cast("int").alias("_n")))
    dealt = many.join(blocks, key).withColumn("_block", F.pmod(F.xxhash64(*many.columns), "_n").cast("int")).drop("_n")
    copies = others.join(blocks, key).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    tasks = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(tasks, key, "_block").join(copies, [key, "_block"]).drop("_block")


def _wu_palmer(targets: DataFrame, base: DataFrame, closure: DataFrame, least: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(word, synset, tc), (base, bc) and (tc, bc, sim): classes of senses and of base words, and what is above `least` between them, to three places.

    The similarity is twice the depth of a common ancestor over the depths by way of it, the best of all. closure (node, ancestor,
    depth) without a node itself. What lies below the same ancestors at the same depths is one class. An ancestor counts only if it is
    near enough, for its depth from the root, to what the other side has below it; a sense that both have is left to the rule for that.
    """
    level = closure.groupBy("node").agg((F.max("depth") + 1).alias("d")).select(F.col("node").alias("ancestor"), "d")
    nodes = closure.select("node").union(closure.select("ancestor")).distinct()
    up = closure.select("node", "ancestor", "depth").unionByName(nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth")))
    up = up.join(level, "ancestor", "left").withColumn("d", F.coalesce("d", F.lit(1))).where(2 * F.col("d") > least * (2 * F.col("d") + F.col("depth")))
    a = targets.join(up, F.col("synset") == F.col("node")).select("word", "synset", "pos", "ancestor", "d", F.col("depth").alias("a"))
    b = base.join(up, F.col("synset") == F.col("node")).select(F.col("word").alias("base"), "pos", "ancestor", "d", F.col("depth").alias("b"))
    sim = lambda x, y: 2 * F.col("d") / (2 * F.col("d") + x + y)

    def near(df: DataFrame, c: str, others: DataFrame, o: str) -> DataFrame:
        low = others.groupBy("ancestor", "pos").agg(F.min(o).alias("low"), F.min(F.when(F.col(o) > 0, F.col(o))).alias("below"))
        return df.join(low, ["ancestor", "pos"]).where(sim(F.col(c), F.when(F.col(c) == 0, F.col("below")).otherwise(F.col("low"))) > least)

    profile = lambda df, keys, c: store(df.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("pos", "ancestor", "d", c))).alias("profile")))
    senses, words = profile(near(a, "a", b, "b"), ["word", "synset"], "a"), profile(near(b, "b", a, "a"), ["base"], "b")
    x, y = _classes(senses, "profile", "tc"), _classes(words, "profile", "bc")
    met = x.select("tc", F.inline("profile")).join(y.select("bc", F.inline("profile")).drop("d"), ["ancestor", "pos"])
    sims = met.groupBy("tc", "bc").agg(F.max(sim(F.col("a"), F.col("b"))).alias("sim")).where(F.col("sim") > least)
    sims = store(sims.withColumn("sim", F.round("sim", 3)))
    return senses.join(x, "profile").drop("profile"), words.join(y, "profile").drop("profile"), sims


def _overlaps(synsets: DataFrame, words: DataFrame, glosses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, gc) and (gc, wc, v): classes of equal sets of words, and the overlap of a sense's class with a base word's.

    Two words must be in common, so the first common one, from the rarest on, is never the last of either set: sets meet by the others, and
    a pair counts where its first common word is met.
    """
    synsets, words = synsets.toDF("key").distinct(), words.toDF("key").distinct()
    used = glosses.join(synsets.union(words).distinct(), "key", "left_semi")
    sets = store(used.groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("tokens")))).alias("tokens")))
    classes = _classes(sets, "tokens", "gc")
    of = store(sets.join(classes, "tokens").select("key", "gc"))
    told = classes.select("gc", F.size("tokens").alias("n"), F.explode("tokens").alias("token")).where("token is not null")
    rank = store(told.groupBy("token").agg(F.count("*").alias("f")).orderBy("f", "token").select("token", F.monotonically_increasing_id().alias("r")))
    coded = store(told.join(rank, "token").groupBy("gc", "n").agg(F.array_sort(F.collect_list("r")).alias("rs")).where(F.size("rs") >= 2))
    side = lambda keys, gc, n, rs: coded.join(of.join(keys, "key", "left_semi").select("gc"), "gc", "left_semi").select(F.col("gc").alias(gc), F.col("n").alias(n), F.col("rs").alias(rs), F.explode(F.slice("rs", 1, F.size("rs") - 1)).alias("r"))
    met = _meet(side(synsets, "gc", "n", "rs"), side(words, "wc", "m", "ws"), "r", 128).withColumn("both", F.array_intersect("rs", "ws"))
    met = met.where((F.get("both", F.lit(0)) == F.col("r")) & (F.size("both") >= 2))
    c = F.size("both")
    v = F.least(F.round(5 * c / (F.col("n") + F.col("m") - c), 3), F.lit(0.5))
    return of, store(met.select("gc", "wc", v.alias("v")).where("v > 0.1"))


def semantic_matrix(targets: DataFrame, base: DataFrame, antonyms: DataFrame, derived: DataFrame, closure: DataFrame, glosses: DataFrame, least: float = 0.65) -> DataFrame:
    """(word, synset, base, rule, value): similarity of senses to base words by the first rule that applies; other pairs are 0.

    1 the same word (1); 2 a sense in common (1); 3 an antonym (-1); 4 a derivation (0.9); 5 taxonomic similarity above
    `least`, same part of speech, of at most three senses of each part of speech of a base word; 6 at least two words of the
    glosses in common: five times their Jaccard similarity, at most 0.5, above 0.1. targets and base (word, synset, pos, rank; no nulls in word
    and synset); antonyms and derived (synset, other), read as given; glosses (key, tokens) with a synset or a base word as key, several of a key count
    as one. Every rule is an equi-join. Rules 5 and 6 are decided between classes of senses and of base words that have the same
    ancestors, or the same gloss; their pairs are only listed, neither shuffled nor grouped, by as many tasks as there are shuffle partitions: a sense
    takes along the base words that earlier rules gave it.
    """
    t, b = targets.select("word", "synset", "pos"), base.select("word", "synset", "pos", "rank")
    words = b.select(F.col("word").alias("base")).distinct()
    senses = b.select(F.col("word").alias("base"), F.col("synset").alias("other"))
    pair = t.select("word", "synset").distinct()
    rule = lambda df, k, v: df.select("word", "synset", "base", F.lit(k).alias("rule"), v.cast("double").alias("value"))
    linked = lambda links: pair.join(links.select("synset", "other").distinct(), "synset").join(senses, "other")
    primary = b.withColumn("r", F.row_number().over(Window.partitionBy("word", "pos").orderBy("rank", "synset"))).where("r <= 3").select("word", "synset", "pos")
    parts = [
        rule(pair.join(words, F.col("word") == F.col("base")), 1, F.lit(1.0)),
        rule(pair.join(senses, F.col("synset") == F.col("other")), 2, F.lit(1.0)),
        rule(linked(antonyms), 3, F.lit(-1.0)),
        rule(linked(derived), 4, F.lit(0.9)),
    ]
    first = store(reduce(DataFrame.unionByName, parts).groupBy("word", "synset", "base").agg(F.min(F.struct("rule", "value")).alias("m")).select("word", "synset", "base", "m.rule", "m.value"))
    tax, tax_words, sims = _wu_palmer(t, primary, closure, least)
    gloss, overlaps = _overlaps(pair.select("synset"), words, glosses)
    told = first.where("rule > 1").groupBy("word", "synset").agg(F.collect_set("base").alias("told"))
    pair = pair.join(tax, ["word", "synset"], "left").join(gloss.withColumnRenamed("key", "synset"), "synset", "left").join(told, ["word", "synset"], "left")
    pair = store(pair.where("tc is not null or gc is not null"))
    words = store(words.join(tax_words, "base", "left").join(gloss.select(F.col("key").alias("base"), F.col("gc").alias("wc")), "base", "left"))
    later = lambda df: df.where((F.col("word") != F.col("base")) & ~F.coalesce(F.array_contains("told", F.col("base")), F.lit(False)))
    by_tree = later(_meet(pair.where("tc is not null"), sims.join(words, "bc").select("tc", "base", "sim"), "tc"))
    by_gloss = later(_meet(pair.where("gc is not null"), overlaps, "gc").join(words.select("base", "wc", "bc"), "wc").join(sims.select("tc", "bc"), ["tc", "bc"], "left_anti"))
    return first.unionByName(rule(by_tree, 5, F.col("sim"))).unionByName(rule(by_gloss, 6, F.col("v")))


def preserves(before: DataFrame, after: DataFrame, strict: bool = False, floor: float = 0.6) -> DataFrame:
    """(doc_id, ok, reason): whether a rewrite keeps what the text said; the first reason against it.

    Leaves (doc_id, pos, sound, subject, predicate, direct, negated, quantifier, modal, question, vector). Reasons: `raw` (strict
    only: the text has an unsound leaf or none), `unsound` (the rewrite has, or no leaf), `balloons` (over two leaves more), `mood` (a question
    became none), `drifts` (cosine of the sums of sound vectors, to six places, below the floor), `dropped` and `flag` (of the first sound leaf that has
    no leaf of its key, or one of another quantifier or modal), `count` (strict only: another number of leaves).
    """
    key = ["subject", "predicate", "direct", "negated"]

    def summary(leaves: DataFrame, side: str) -> DataFrame:
        sums = centroid(leaves.where(F.col("sound") & F.col("vector").isNotNull()), "doc_id").withColumnRenamed("vector", f"v_{side}")
        counts = leaves.groupBy("doc_id").agg(F.count("*").alias(f"n_{side}"), F.bool_and("sound").alias(f"sound_{side}"), F.bool_or("question").alias(f"asks_{side}"))
        return counts.join(sums, "doc_id", "left")

    said = after.groupBy("doc_id", *key).agg(F.max(F.struct("pos", "quantifier", "modal")).alias("m"))
    said = said.select("doc_id", *[F.col(c).alias(f"_{c}") for c in key], "m")
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key])
    kept = before.where("sound").alias("b").join(said.withColumnRenamed("doc_id", "_doc"), (F.col("doc_id") == F.col("_doc")) & same, "left")
    changed = ~(F.col("quantifier").eqNullSafe(F.col("m.quantifier")) & F.col("modal").eqNullSafe(F.col("m.modal")))
    fault = kept.groupBy("doc_id").agg(F.min(F.when(F.col("m").isNull(), F.struct("pos", F.lit("dropped").alias("why"))).when(changed, F.struct("pos", F.lit("flag").alias("why")))).alias("f"))
    rows = summary(before, "b").join(summary(after, "a"), "doc_id", "left").join(fault, "doc_id", "left")
    near = F.round(cosine(F.col("v_b"), F.col("v_a"), rescale=False), 6)
    reason = F.when(F.lit(strict) & ~F.col("sound_b"), "raw")
    reason = reason.when(F.col("n_a").isNull() | ~F.col("sound_a"), "unsound").when(F.col("n_a") > F.col("n_b") + 2, "balloons").when(F.col("asks_b") & ~F.col("asks_a"), "mood")
    reason = reason.when(F.col("v_a").isNotNull() & F.col("v_b").isNotNull() & (near < floor), "drifts").when(F.col("f").isNotNull(), F.col("f.why"))
    reason = reason.when(F.lit(strict) & (F.col("n_a") != F.col("n_b")), "count")
    return rows.select("doc_id", reason.isNull().alias("ok"), reason.alias("reason"))


def discourse_time(clauses: DataFrame) -> DataFrame:
    """(doc_id, pos, time): days from now of each clause, in document order.

    clauses (doc_id, pos, offset, anchor, sequence, tense): a quantity in days or an anchor word sets the time, else a sequence
    word moves it, else, before anything was set explicitly, a tense sets it, else it stays. The cursor is the last value set
    plus the moves since, so windows do it: no state in Python, no array of a document.
    """
    explicit = F.coalesce("offset", _lookup(ANCHORS, F.col("anchor")))
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    until = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    move = F.when(explicit.isNull(), F.coalesce(_lookup(SEQUENCE, F.col("sequence")), F.lit(0.0))).otherwise(0.0)
    rows = clauses.select("doc_id", "pos", explicit.alias("explicit"), move.alias("move"), _lookup(TENSES, F.col("tense")).alias("tense"))
    rows = rows.withColumn("anchored", F.coalesce(F.max(F.col("explicit").isNotNull()).over(before), F.lit(False)))
    rows = rows.withColumn("put", F.coalesce("explicit", F.when(~F.col("anchored") & (F.col("move") == 0), F.col("tense"))))
    rows = rows.withColumn("moved", F.sum("move").over(until))
    base = F.last(F.when(F.col("put").isNotNull(), F.struct("put", "moved")), ignorenulls=True).over(until)
    rows = rows.withColumn("base", base)
    return rows.select("doc_id", "pos", F.round(F.coalesce("base.put", F.lit(0.0)) + F.col("moved") - F.coalesce("base.moved", F.lit(0.0)), 6).alias("time"))


def pin_senses(definitions: DataFrame, leaves: DataFrame, glosses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(leaves, ledger): definitions framed as `a WORD is GLOSS` or `something WORD is GLOSS` get the sense whose clean gloss is just that one.

    definitions (doc_id, original), leaves (doc_id, pos, subject), glosses (word, pos, rank, sense, gloss). All leaves with the subject of the
    first leaf that has one are patched. The ledger (doc_id, status, sense, patched) has `pinned`, `already`, `no subject`, `no
    sense` or `other frame`.
    """
    frame = F.when(F.col("original").rlike(r"^an? \S+ is .+$"), "n").when(F.col("original").rlike(r"^something \S+ is .+$"), "a")
    cut = F.regexp_extract("original", r"^(?:an?|something) (\S+) is (.+)$", 1), F.trim(F.regexp_extract("original", r"^(?:an?|something) (\S+) is (.+)$", 2))
    d = definitions.select("doc_id", frame.alias("frame"), cut[0].alias("word"), cut[1].alias("gloss"))
    g = glosses.select("word", F.when(F.col("pos") == "s", "a").otherwise(F.col("pos")).alias("frame"), clean_gloss(F.col("gloss")).alias("gloss"), "rank", "sense")
    g = g.groupBy("word", "frame", "gloss").agg(F.min(F.struct("rank", "sense")).alias("m")).select("word", "frame", "gloss", F.col("m.sense").alias("sense"))
    first = leaves.where("subject is not null").groupBy("doc_id").agg(F.min(F.struct("pos", "subject")).alias("m")).select("doc_id", F.col("m.subject").alias("compiled"))
    told = d.join(g, ["word", "frame", "gloss"], "left").join(first, "doc_id", "left")
    status = F.when(F.col("frame").isNull(), "other frame").when(F.col("sense").isNull(), "no sense").when(F.col("compiled").isNull(), "no subject").when(F.col("compiled") == F.col("sense"), "already").otherwise("pinned")
    told = told.select("doc_id", status.alias("status"), "sense", "compiled")
    pins = told.where("status = 'pinned'").select("doc_id", "sense", F.col("compiled").alias("subject"))
    marked = leaves.join(pins.withColumnRenamed("subject", "_was"), "doc_id", "left").withColumn("_hit", F.coalesce(F.col("subject") == F.col("_was"), F.lit(False)))
    patched = marked.select("doc_id", "pos", F.when(F.col("_hit"), F.col("sense")).otherwise(F.col("subject")).alias("subject"))
    count = marked.where("_hit").groupBy("doc_id").agg(F.count("*").alias("patched"))
    return patched, told.join(count, "doc_id", "left").select("doc_id", "status", "sense", F.coalesce("patched", F.lit(0)).alias("patched"))
