"""People, documents behind premises, teaching, hypotheses and what is told about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resolve_canonical(refs: DataFrame, people: DataFrame) -> DataFrame:
    """(ref, uid): a ref by uid, else row id, else channel key (never individuals), then one hop to the canonical person if that exists."""
    by = lambda key, n, cond="true": people.where(cond).groupBy(F.col(key).alias("ref")).agg(F.min("uid").alias(n))
    found = refs.select("ref").distinct().join(by("uid", "u"), "ref", "left").join(by("row_id", "r"), "ref", "left").join(by("context_key", "k", "kind <> 'individual'"), "ref", "left").withColumn("uid", F.coalesce("u", "r", "k"))
    hop = people.select("uid", "canonical_uid").where("canonical_uid is not null")
    real = people.select(F.col("uid").alias("canonical_uid"), F.lit(True).alias("_there"))
    out = found.select("ref", "uid").join(hop, "uid", "left").join(real, "canonical_uid", "left")
    return out.select("ref", F.when(F.col("_there"), F.col("canonical_uid")).otherwise(F.col("uid")).alias("uid"))


def detect_renames(seen: DataFrame) -> DataFrame:
    """(context_key, name, aliases): the latest display name of each channel key, earlier ones once each as aliases; seen: (context_key, name, us)."""
    g = seen.groupBy("context_key").agg(F.max(F.struct("us", "name"))["name"].alias("name"), F.collect_set("name").alias("names"))
    return g.select("context_key", "name", F.array_sort(F.array_remove("names", F.col("name"))).alias("aliases"))


def premise_docs(verdicts: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, pos, doc, kind, original): premises that are stored sentences, in order; graph keys (|) and prefixed keys (:) are dropped; axioms come before theorems."""
    p = verdicts.select("id", F.posexplode("premises").alias("pos", "doc")).where(~F.col("doc").rlike(r"[|:]"))
    best = docs.groupBy(F.col("id").alias("doc")).agg(F.min(F.struct("kind", "original")).alias("m"))
    return p.join(best, "doc").select("id", "pos", "doc", "m.kind", "m.original")


def refuting_belief(verdicts: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, original): text of the first premise that is a stored sentence."""
    return premise_docs(verdicts, docs).groupBy("id").agg(F.min(F.struct("pos", "original"))["original"].alias("original"))


def sense_glossary(statement_senses: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(stmt_id, glossary): definitions of the senses a statement uses, in order of sense."""
    rows = statement_senses.select("stmt_id", F.explode("senses").alias("sense")).join(dictionary.select("sense", "definition"), "sense", "left")
    return rows.groupBy("stmt_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("sense", F.coalesce("definition", F.lit("?")).alias("d")))), lambda x: F.concat(x["sense"], F.lit(": "), x["d"])).alias("glossary"))


def resolve_route(actions: DataFrame, people: DataFrame) -> DataFrame:
    """(id, route): an explicit destination, else the platform id after the colon of the target's channel key."""
    keys = people.select(F.col("uid").alias("target"), F.when(F.col("context_key").contains(":"), F.split_part("context_key", F.lit(":"), F.lit(2))).alias("_key"))
    return actions.join(keys, "target", "left").select("id", F.coalesce("destination", "_key").alias("route"))


def trace_join(inputs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(id, expected, got, breach): inputs against their verdicts; a false one accepted or a contradiction missed is a breach."""
    rows = inputs.join(verdicts.select("id", F.col("token").alias("got")), "id", "left")
    breach = F.when((F.col("expected") == "false") & (F.col("got") == "true"), "accepted false").when((F.col("expected") == "inconsistent") & ~F.coalesce(F.col("got") == "inconsistent", F.lit(False)), "missed contradiction")
    return rows.select("id", "expected", "got", breach.alias("breach"))


def reductio_target(groups: DataFrame, sources: DataFrame, people: DataFrame) -> DataFrame:
    """(signature, uid): the most trusted contributor of a conflict's documents, imprinted ones first; sources: (id, uid)."""
    rows = groups.select("signature", F.explode("premises").alias("id")).join(sources, "id").join(people.select("uid", "imprint", "trust"), "uid")
    return rows.groupBy("signature").agg(F.max(F.struct("imprint", "trust", "uid"))["uid"].alias("uid"))


def morning_questions(stash: DataFrame, ledger: DataFrame, docs: DataFrame) -> DataFrame:
    """(signature): stashed signatures still open with an active premise sentence."""
    still = stash.join(ledger.where("status = 'open'").select("signature"), "signature", "left_semi")
    alive = still.select("signature", F.explode("premises").alias("id")).join(docs.where("not archived").select("id"), "id", "left_semi")
    return alive.select("signature").distinct()


def taught(rows: DataFrame, held: DataFrame, bar: float = 0.9) -> DataFrame:
    """(id, text, trust): unknown statements of known words by teachers trusted enough that are not held yet; rows (id, text, token, sound, teacher_trust)."""
    ok = rows.where((F.col("token") == "unknown") & F.col("sound") & (F.col("teacher_trust") >= bar)).join(held.select("text"), "text", "left_anti")
    first = ok.groupBy("text").agg(F.min(F.struct("id", "teacher_trust")).alias("m"))
    return first.select(F.col("m.id").alias("id"), "text", F.least(F.lit(0.9), F.col("m.teacher_trust")).alias("trust"))


def hypotheses(rows: DataFrame, floor: float = 0.6, most: float = 0.3) -> DataFrame:
    """(id, reason, trust): unknown claims that resemble something held; each refusal names its gate; rows (id, token, sound, likeness, speaker_trust)."""
    reason = F.when(F.col("token") != "unknown", "decided").when(~F.col("sound"), "unsound").when(F.col("likeness") < floor, "unlike").when(F.col("speaker_trust") >= 0.9, "taught")
    return rows.select("id", reason.alias("reason"), F.when(reason.isNull(), F.least(F.lit(most), F.col("speaker_trust"))).alias("trust"))


def observations(verdicts: DataFrame) -> DataFrame:
    """(speaker, id): one "said false" fact of each speaker, from the first refuted claim with premises."""
    return verdicts.where((F.col("token") == "false") & (F.size("premises") > 0)).groupBy("speaker").agg(F.min("id").alias("id"))


def derived_theorems(verdicts: DataFrame, held: DataFrame) -> DataFrame:
    """(id, text): chained true verdicts with premises, once for each text that is not held."""
    ok = verdicts.where((F.col("token") == "true") & (F.size("premises") > 0) & F.exists("derivation", lambda d: F.startswith(d, F.lit("chain: "))))
    return ok.join(held.select("text"), "text", "left_anti").groupBy("text").agg(F.min("id").alias("id")).select("id", "text")


def personal(theorems: DataFrame, identities: DataFrame, people: DataFrame) -> DataFrame:
    """(id, personal): the text begins with "I " or a leaf names a known person; identities: (id, uid)."""
    named = identities.join(people.select("uid"), "uid", "left_semi").select("id", F.lit(True).alias("_named")).distinct()
    return theorems.join(named, "id", "left").select("id", (F.startswith("original", F.lit("I ")) | F.coalesce("_named", F.lit(False))).alias("personal"))


def dream_digest(convicted: DataFrame) -> DataFrame:
    """(key, n): order-free hash of the publishable retractions, one for each text with its first reason, and how many there are."""
    one = convicted.where("postable").groupBy("original").agg(F.min(F.struct("id", "reason"))["reason"].alias("reason"))
    return one.agg(F.hex(F.bit_xor(F.xxhash64("original", "reason"))).alias("key"), F.count("*").alias("n"))


def momentum_pick(log: DataFrame, trust: DataFrame, held: DataFrame, floor: float = 0.6, depth: int = 3, cap: int = 8, longest: int = 120) -> DataFrame:
    """(source_id, text): short phrasings without braces of trusted speakers with enough prior turns, not held, the oldest few of each."""
    rows = log.join(trust.where(F.col("trust") >= floor).select("source_id"), "source_id", "left_semi").where((F.col("depth") >= depth) & (F.length("text") <= longest) & ~F.col("text").rlike(r"[{}]"))
    first = rows.groupBy("source_id", "text").agg(F.min("id").alias("id")).join(held.select("text"), "text", "left_anti")
    return first.withColumn("_r", F.row_number().over(Window.partitionBy("source_id").orderBy("id"))).where(F.col("_r") <= cap).select("source_id", "text")


def consolidate(picks: DataFrame, near: DataFrame, trust: DataFrame, bar: float = 0.9) -> DataFrame:
    """(id, enabled): picks of fully trusted people that were used or lie near a good episode are promoted, others disabled."""
    rows = picks.join(near.select("id", F.lit(True).alias("_near")), "id", "left").join(trust, "stakeholder", "left")
    return rows.select("id", ((F.coalesce("trust", F.lit(0.0)) >= bar) & (F.col("used") | F.coalesce("_near", F.lit(False)))).alias("enabled"))


def quiet_band(log: DataFrame, association: Column, floor: float = 0.6) -> DataFrame:
    """(id, urge): ambient rows whose association reaches the floor, urge scaled by (1 + p) / 2."""
    return log.where((F.col("directedness") < 0.9) & (F.col("directedness") >= 0.15) & (association >= floor)).select("id", (F.col("directedness") * (1 + association) / 2).alias("urge"))


def place_type_sense(types: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(type, sense): the noun sense of lowest number of a type label, else location.n.01."""
    d = dictionary.where("pos = 'n'").groupBy(F.col("word").alias("type")).agg(F.min(F.struct("nr", "sense"))["sense"].alias("_s"))
    return types.select("type").distinct().join(d, "type", "left").select("type", F.coalesce("_s", F.lit("location.n.01")).alias("sense"))


def ground_part(claims: DataFrame, forward: DataFrame) -> DataFrame:
    """(claim_id, holds, derivation): part_of claims from operators.graph.part_of rows (part, whole, holds); a negated claim is flipped."""
    known = forward.where("holds is not null").select(F.col("part").alias("subject"), F.col("whole").alias("object"), F.col("holds").alias("_h")).distinct()
    said = F.when(F.col("_h"), F.concat_ws(" is part of ", "subject", "object")).otherwise(F.concat_ws(" is part of ", "object", "subject"))
    return claims.join(known, ["subject", "object"]).select("claim_id", (F.col("_h") != F.col("negated")).alias("holds"), F.array(said).alias("derivation"))


def best_match(scores: DataFrame) -> DataFrame:
    """(stmt_id, kind, ordinal): the most similar stored statement; ties: axioms first, then the lowest ordinal."""
    best = scores.groupBy("stmt_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "kind", "ordinal")).alias("m"))
    return best.select("stmt_id", "m.kind", "m.ordinal")
