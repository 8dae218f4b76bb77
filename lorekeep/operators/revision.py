"""Corrections, sense repair, requeued work and public rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.operators.anonymity import hide_people
from lorekeep.operators.extraction import lemma, noun
from lorekeep.operators.timeline import drift_sample, sense_overlap
from lorekeep.operators.neighbours import knn
from lorekeep.runtime import store


def correction_target(claims: DataFrame, rules: DataFrame, sources: DataFrame) -> DataFrame:
    """(claim_id, rule_id, belief_trust, docs, weakened): exceptions (corner O or E) against a held positive rule on the same subject and
    predicate that was learned through retractable documents only; weakened is the rule as `some` (subject, predicate, quantifier).
    sources: (rule_id, doc, trust, readonly)."""
    learned = sources.groupBy("rule_id").agg(F.min("trust").alias("belief_trust"), F.array_sort(F.collect_set("doc")).alias("docs"), F.bool_or("readonly").alias("fixed")).where("not fixed")
    hit = claims.where(F.col("corner").isin("O", "E")).join(rules.where("not negated"), ["subject", "predicate"])
    some = F.struct("subject", "predicate", F.lit("existential").alias("quantifier"))
    return hit.join(learned, "rule_id").select("claim_id", "rule_id", "belief_trust", "docs", some.alias("weakened"))


def accept_correction(targets: DataFrame, claims: DataFrame, trust: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(claim_id, rule_id): corrections by speakers trusted at least as much as the belief, and denials of a premise that the speaker was asked about.

    asked (rule_id, speaker, subject, predicate, net): a claim (claim_id, speaker, subject, predicate, net) of that speaker with the opposite polarity denies it.
    """
    who = claims.select("claim_id", "speaker").join(trust, "speaker")
    out = targets.join(who, "claim_id").where(F.col("trust") >= F.col("belief_trust")).select("claim_id", "rule_id")
    if asked is None:
        return out
    told = asked.select("rule_id", "speaker", "subject", "predicate", F.col("net").alias("_net"))
    denied = claims.join(told, ["speaker", "subject", "predicate"]).where(F.col("net") != F.col("_net")).select("claim_id", "rule_id")
    return out.unionByName(denied).distinct()


def differentia_rules(leaves: DataFrame, genus: DataFrame) -> DataFrame:
    """(doc_id, pos, verdict): the other leaves of a definition as property rules of the defined class: abstract genus, circular
    (four letters in common), noun, verb without object, else accept; genus: (doc_id, klass, genus, abstract)."""
    rows = leaves.where("predicate is not null").join(genus, "doc_id").where(F.col("predicate") != F.col("genus"))
    verb_alone = F.col("predicate").rlike(r"\.v\.\d+$") & F.col("object").isNull()
    verdict = F.when(F.col("abstract"), "abstract").when(F.substring(lemma(F.col("predicate")), 1, 4) == F.substring(lemma(F.col("klass")), 1, 4), "circular").when(noun(F.col("predicate")), "noun").when(verb_alone, "no object").otherwise("accept")
    return rows.select("doc_id", "pos", verdict.alias("verdict"))


def graph_sense_fix(pairs: DataFrame, siblings: DataFrame, closure: DataFrame) -> DataFrame:
    """Pairs (child, parent) with the parent's sense kept if the graph supports it, else the sibling of lowest rank that it supports."""
    up = closure.select(F.col("node").alias("child"), F.col("ancestor").alias("s"), F.lit(True).alias("_up"))
    tried = pairs.join(siblings.select(F.col("sense").alias("parent"), F.col("sibling").alias("s"), "rank").unionByName(siblings.select(F.col("sense").alias("parent"), F.col("sense").alias("s"), F.lit(0).alias("rank")).distinct()), "parent")
    best = tried.join(up, ["child", "s"]).groupBy("child", "parent").agg(F.min(F.struct("rank", "s"))["s"].alias("fixed"))
    return pairs.join(best, ["child", "parent"], "left").withColumn("fixed", F.coalesce("fixed", "parent"))


def ground_place(claims: DataFrame, contained: DataFrame, types: DataFrame | None = None, closure: DataFrame | None = None) -> DataFrame:
    """(claim_id, holds, derivation), one row a claim: containment claims decided by operators.graph.place_contains rows (inner, outer,
    contains); complete chains refute. Of contradictory rows of one pair the one that contains counts.

    With types (uid, sense) and the closure of classes (node, ancestor), claims that containment does not decide, that a place is of a
    class, hold if its type's sense is that class or below it; they are not refuted.
    """
    pair = ["subject", "object"]
    known = contained.where("contains is not null").groupBy(F.col("inner").alias("subject"), F.col("outer").alias("object")).agg(F.max("contains").alias("contains"))
    rows = claims.join(known, pair, "left").withColumn("sense", F.lit(None).cast("string"))
    if types is not None:
        up = closure.select(F.col("node").alias("sense"), F.col("ancestor").alias("object"))
        up = up.unionByName(types.select("sense", F.col("sense").alias("object"))).distinct()
        kinds = types.select(F.col("uid").alias("subject"), "sense").join(up, "sense").groupBy(*pair).agg(F.min("sense").alias("sense"))
        rows = rows.drop("sense").join(kinds, pair, "left")
    value = F.coalesce("contains", F.when(F.col("sense").isNotNull(), True))
    by_place = F.concat_ws(" ", "subject", F.when(F.col("contains"), "is in").otherwise("is not in"), "object")
    said = F.when(F.col("contains").isNotNull(), by_place).otherwise(F.concat_ws(" ", "subject", F.lit("is of the type"), "sense", F.lit("and so"), "object"))
    return rows.where(value.isNotNull()).select("claim_id", (value != F.col("negated")).alias("holds"), F.array(said).alias("derivation"))


def ground_definition(scores: DataFrame) -> DataFrame:
    """(claim_id, truth): the similarity furthest from 0.5, complemented if negated; 0.5 for claims of unknown words."""
    best = scores.groupBy("claim_id", "negated", "unknown").agg(F.max(F.struct(F.abs(F.col("sim") - 0.5).alias("d"), "sim"))["sim"].alias("s"))
    return best.select("claim_id", F.when(F.col("unknown"), 0.5).when(F.col("negated"), 1 - F.col("s")).otherwise(F.col("s")).alias("truth"))


def nearest_marker(words: DataFrame, markers: DataFrame, floor: float = 0.85) -> DataFrame:
    """(vec_id, marker, how): the exact marker of a word, else the nearest vector at or above the floor, else new."""
    exact = words.join(markers.select("word", F.col("vec_id").alias("marker")), "word", "left")
    near = knn(exact.where("marker is null").select("vec_id", "vector"), markers, 1, keep_self=True).where(F.col("score") >= floor).select(F.col("query_id").alias("vec_id"), F.col("vec_id").alias("near"))
    out = exact.join(near, "vec_id", "left")
    return out.select("vec_id", F.coalesce("marker", "near").alias("marker"), F.when(F.col("marker").isNotNull(), "exact").when(F.col("near").isNotNull(), "near").otherwise("new").alias("how"))


def requeue(log: DataFrame, delta: DataFrame, sample: int = 4, seed: str = "0", cap: int = 256) -> DataFrame:
    """(id, why): rows that share a sense with new knowledge, newest first up to the cap, or a drift sample if there is no new knowledge."""
    if delta.isEmpty():
        return drift_sample(log, sample, seed).select("id", F.lit("drift").alias("why"))
    return sense_overlap(log, delta, cap).select("id", F.lit("sense").alias("why"))


def post_rows(theorems: DataFrame, people: DataFrame | None = None) -> DataFrame:
    """(slug, kind, multi_hop, proof): public rows of postable theorems (id, original, postable, premises, derived_by): the slug is the id
    or else a content hash; empty drafts are rejected; the proof numbers its premises.

    people (name, label, optional uid, is_me): premises have labels for people as in anonymity.hide_people; a premise that still names
    somebody is left out of the proof, which counts on without it.
    """
    ok = theorems.where(F.col("postable") & (F.trim(F.coalesce("original", F.lit(""))) != ""))
    slug = F.coalesce("id", F.substring(F.sha1("original"), 1, 12)).alias("slug")
    rows = ok.select(slug, F.coalesce("derived_by", F.lit("chain")).alias("kind"), (F.size("premises") > 2).alias("multi_hop"), "premises")
    if people is not None:
        rows = store(rows.withColumn("row", F.monotonically_increasing_id()))
        lines = rows.select(F.posexplode("premises").alias("pos", "text"), "row").select(F.concat_ws(":", "row", "pos").alias("id"), "text")
        at = [F.split_part("id", F.lit(":"), F.lit(i + 1)).cast(kind).alias(c) for i, (c, kind) in enumerate((("row", "long"), ("pos", "int")))]
        shown = hide_people(lines, people).where("text is not null").select(*at, "text")
        kept = shown.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("lines"))
        rows = rows.join(kept, "row", "left").withColumn("premises", F.transform(F.coalesce("lines", F.array().cast("array<struct<pos:int,text:string>>")), lambda x: x["text"]))
    proof = F.array_join(F.transform("premises", lambda p, i: F.concat((i + 1).cast("string"), F.lit(". "), p)), "\n")
    return rows.select("slug", "kind", "multi_hop", proof.alias("proof"))


def route_category(actions: DataFrame, routes: DataFrame) -> DataFrame:
    """(id, category): the template category of (action, trigger), else of the action alone, else `plain`; routes: (action, trigger or null, category)."""
    exact = routes.where("trigger is not null").select("action", "trigger", F.col("category").alias("_a"))
    wide = routes.where("trigger is null").select("action", F.col("category").alias("_b"))
    return actions.join(exact, ["action", "trigger"], "left").join(wide, "action", "left").select("id", F.coalesce("_a", "_b", F.lit("plain")).alias("category"))
