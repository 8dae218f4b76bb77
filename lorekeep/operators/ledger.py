"""Trust episodes, beliefs' bookkeeping and aggregate reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Signed weight of each kind of trust episode.
WEIGHTS = {"agreement": 0.02, "kicker": 0.10, "correction": 0.08, "disagreement": -0.15, "logic_violation": -0.15, "self_inconsistency": -0.20}


def episode_delta(kind: Column, belief_trust: Column) -> Column:
    """Signed delta of an episode; a disagreement counts by the trust in the refuted belief (0.5 if unknown)."""
    base = F.coalesce(*[F.when(kind == k, F.lit(w)) for k, w in WEIGHTS.items()])
    return F.when(kind == "disagreement", base * F.coalesce(belief_trust, F.lit(0.5))).otherwise(base)


def trust_fold(episodes: DataFrame, imprinted: DataFrame | None = None, neutral: float = 0.5, span: int = 86400) -> DataFrame:
    """(stakeholder, trust): deltas added in order of (us, id) from neutral, clamped to [0, 1] at each step; imprinted people have 1.

    Clamped additions of `span` seconds are again one clamped addition (shift, low, high), so a person's episodes are folded by
    time and only one row for each stretch is gathered.
    """
    one = F.struct(F.lit(0.0).alias("shift"), F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    add = lambda f, e: F.struct((f["shift"] + e["delta"]).alias("shift"), clamp(f["low"] + e["delta"]).alias("low"), clamp(f["high"] + e["delta"]).alias("high"))
    trail = F.array_sort(F.collect_list(F.struct("us", "id", "delta")))
    parts = episodes.groupBy("stakeholder", F.floor(F.col("us") / (span * 1000000)).alias("part")).agg(F.aggregate(trail, one, add).alias("f"))
    folded = parts.groupBy("stakeholder").agg(F.aggregate(F.array_sort(F.collect_list(F.struct("part", "f"))), F.lit(neutral), lambda t, p: F.greatest(p["f"]["low"], F.least(p["f"]["high"], t + p["f"]["shift"]))).alias("trust"))
    if imprinted is None:
        return folded
    return folded.join(imprinted.select("stakeholder", F.lit(True).alias("_own")), "stakeholder", "left").select("stakeholder", F.when(F.col("_own"), F.lit(1.0)).otherwise(F.col("trust")).alias("trust"))


def trust_bands(trust: Column, imprint: Column, me: Column, channel: Column | None = None) -> Column:
    """Band of a person's trust to six places; of those that are neither the agent nor its maker with `@channel`, where one is told.

    Trust is a sum of fractions, so one that is just at a border is told by its rounded value and not by the order of additions.
    """
    told = F.round(trust, 6)
    band = F.when(told >= 0.65, "trusted").when(told >= 0.45, "neutral").otherwise("wary")
    suffix = F.lit("") if channel is None else F.coalesce(F.concat(F.lit("@"), channel), F.lit(""))
    return F.when(me, "self").when(imprint, "maker").otherwise(F.concat(band, suffix))


def trust_echo(token: Column, closes_question: Column, self_inconsistent: Column) -> Column:
    """The episode that a verdict implies: true and closing a question is a kicker."""
    return F.when(self_inconsistent, "self_inconsistency").when(token == "inconsistent", "logic_violation").when((token == "true") & closes_question, "kicker").when(token == "true", "agreement").when(token == "false", "disagreement")


def kb_fingerprint(tables: dict[str, DataFrame]) -> DataFrame:
    """(fingerprint): active count and newest creation of each table, as one string."""
    parts = [df.where("not archived").agg(F.concat_ws(":", F.lit(n), F.count("*").cast("string"), F.coalesce(F.max("created"), F.lit(0)).cast("string")).alias("p")) for n, df in sorted(tables.items())]
    return reduce(DataFrame.unionByName, parts).agg(F.array_join(F.array_sort(F.collect_list("p")), ";").alias("fingerprint"))


def snapshot_metrics(counts: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """(metric, value): rows of each table that fulfil its condition."""
    return reduce(DataFrame.unionByName, [df.agg(F.count_if(c).alias("value")).select(F.lit(n).alias("metric"), "value") for n, (df, c) in sorted(counts.items())])


def funnel(candidates: DataFrame) -> DataFrame:
    """(step, verdict, n) and each step's total under verdict null."""
    return candidates.rollup("step", "verdict").agg(F.count("*").alias("n")).where("step is not null")


def phase_counts(log: DataFrame) -> DataFrame:
    """(phase, n, errors, first, last) of log events."""
    return log.groupBy("phase").agg(F.count("*").alias("n"), F.count_if("error").alias("errors"), F.min("us").alias("first"), F.max("us").alias("last"))


def churn(events: DataFrame) -> DataFrame:
    """(conclusion, n): conclusions that were materialised more than once."""
    return events.groupBy("conclusion").agg(F.count("*").alias("n")).where("n > 1")


def integrity(theorems: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, problem): theorems without premises or with a premise that is no document and no graph key."""
    needs = theorems.select("id", F.explode_outer("premises").alias("premise"))
    none = needs.where("premise is null").select("id", F.lit("no premises").alias("problem"))
    loose = needs.where(~F.col("premise").contains("|")).join(docs.select(F.col("id").alias("premise")), "premise", "left_anti")
    return none.unionByName(loose.where("premise is not null").select("id", F.concat(F.lit("unresolved "), "premise").alias("problem")))


def version_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(total, changed, gained, lost, gained_senses) between two versions (id, digest, senses)."""
    o = old.select("id", F.col("digest").alias("od"), F.col("senses").alias("os"))
    both = o.join(new.select("id", F.col("digest").alias("nd"), F.col("senses").alias("ns")), "id", "full")
    return both.agg(F.count("*").alias("total"), F.count_if(F.expr("od <> nd")).alias("changed"), F.count_if(F.col("od").isNull()).alias("gained"), F.count_if(F.col("nd").isNull()).alias("lost"), F.count_if(F.size(F.array_except("ns", "os")) > 0).alias("gained_senses"))


def active_mimics(shelf: DataFrame, cap: int = 8) -> DataFrame:
    """(scope, n, room): live learned rows of each person and how many more fit."""
    return shelf.where("enabled").groupBy("scope").agg(F.count("*").alias("n")).withColumn("room", F.greatest(F.lit(0), F.lit(cap) - F.col("n")))


def coverage(expected: DataFrame, got: DataFrame) -> DataFrame:
    """(status, item): found, missing and extra."""
    return expected.intersect(got).withColumn("status", F.lit("found")).unionByName(expected.subtract(got).withColumn("status", F.lit("missing"))).unionByName(got.subtract(expected).withColumn("status", F.lit("extra")))


def net_sources(parts: list[DataFrame]) -> DataFrame:
    """One rule or fact set over all sources; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def dedup_anti(new: DataFrame, held: DataFrame, key: list[str]) -> DataFrame:
    """Conclusions whose key is not held yet."""
    return new.join(held.select(*key), key, "left_anti")


def spawn_dedup(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidates whose (source, trigger, action) exists in neither table; those without a source always stay."""
    first = candidates.groupBy("source", "trigger", "action").agg(F.min("id").alias("id"))
    named = first.where("source is not null").join(existing.select("source", "trigger", "action"), ["source", "trigger", "action"], "left_anti").select("id")
    return candidates.where("source is null").unionByName(candidates.join(named, "id", "left_semi"))


def conflict_groups(conflicts: DataFrame) -> DataFrame:
    """(signature, premises): one group for each subject|predicate|object with the union of premises."""
    sig = F.concat_ws("|", "subject", "predicate", F.coalesce("object", F.lit("")))
    return conflicts.select(sig.alias("signature"), F.explode("premises").alias("p")).groupBy("signature").agg(F.array_sort(F.collect_set("p")).alias("premises"))


def convict(groups: DataFrame, docs: DataFrame) -> DataFrame:
    """(signature, verdict, convicted): hypotheses first (all), else the only revisable premise; two or more are asked about."""
    told = groups.select("signature", F.explode("premises").alias("id")).join(docs.select("id", "kind", "readonly"), "id", "left")
    pick = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("id"))))
    seen = told.groupBy("signature").agg(pick(F.col("kind") == "hypothesis").alias("hyp"), pick((F.col("kind") != "hypothesis") & ~F.col("readonly")).alias("soft"), F.count("kind").alias("docs"))
    verdict = F.when(F.size("hyp") > 0, "convicted").when(F.size("soft") == 1, "convicted").when(F.size("soft") > 1, "asked").when(F.col("docs") == 0, "unresolvable").otherwise("constitution")
    return seen.select("signature", verdict.alias("verdict"), F.when(F.size("hyp") > 0, F.col("hyp")).when(F.size("soft") == 1, F.col("soft")).otherwise(F.array().cast("array<string>")).alias("convicted"))


def convict_dependents(verdicts: DataFrame, theorems: DataFrame) -> DataFrame:
    """(signature, id): what falls with the convicted of each group (signature, convicted): active theorems (id, archived, premises) that rest
    on one of them, however far."""
    from lorekeep.operators.graph import dependents

    roots = verdicts.select(F.col("signature").alias("root"), F.explode("convicted").alias("id"))
    return dependents(theorems, roots).select(F.col("root").alias("signature"), "id")


def reductio_ledger(ledger: DataFrame, groups: DataFrame) -> DataFrame:
    """(signature, status, generation): open rows whose signature is gone are resolved, new ones opened, resolved ones that return reopened."""
    both = ledger.join(groups.select("signature", F.lit(True).alias("_now")), "signature", "full")
    now = F.col("_now").isNotNull()
    status = F.when(now, "open").otherwise(F.when(F.col("status") == "open", "resolved").otherwise(F.col("status")))
    generation = F.when(F.col("generation").isNull(), 0).when(now & (F.col("status") == "resolved"), F.col("generation") + 1).otherwise(F.col("generation"))
    return both.select("signature", status.alias("status"), generation.alias("generation"))


def apply_retreat(docs: DataFrame, accepted: DataFrame, weakened: DataFrame) -> DataFrame:
    """A new version of docs: accepted ones archived (never readonly ones), weakened statements added.

    With a column premises, what rests on an archived document, however far, is archived too, unless it is readonly.
    """
    hit = accepted.select("id").distinct().join(docs.where("not readonly").select("id"), "id", "left_semi")
    if "premises" in docs.columns:
        from lorekeep.operators.graph import revoke_cascade

        hit = hit.unionByName(revoke_cascade(docs.select("id", "premises", "archived"), hit).select("id")).distinct()
    hit = hit.withColumn("_hit", F.lit(True))
    kept = docs.join(hit, "id", "left").withColumn("archived", F.col("archived") | (F.coalesce("_hit", F.lit(False)) & ~F.col("readonly"))).drop("_hit")
    return kept.unionByName(weakened, allowMissingColumns=True)


def conclusion_trust(conclusions: DataFrame, edge_trust: DataFrame, derived: float = 0.9, tier: float = 0.3) -> DataFrame:
    """(id, trust): derived trust capped by the lowest premise; an unknown graph key (with a bar) counts as tier trust."""
    needs = conclusions.select("id", F.explode_outer("premises").alias("key")).join(edge_trust, "key", "left")
    each = F.coalesce("trust", F.when(F.col("key").contains("|"), F.lit(tier)), F.lit(derived))
    return needs.groupBy("id").agg(F.least(F.lit(derived), F.min(each)).alias("trust"))


def significance(multi_hop: Column, personal: Column, taught: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.7 + F.when(multi_hop, 0.1).otherwise(0.0) + F.when(personal, 0.2).otherwise(0.0) + F.when(taught, 0.1).otherwise(0.0)))


def verdict_confidence(token: Column, truth: Column, premise_trust: Column) -> Column:
    return F.when(token == "inconsistent", F.lit(1.0)).when(token == "true", truth * premise_trust).when(token == "false", (1 - truth) * premise_trust)


def hedge(confidence: Column) -> Column:
    return F.when(confidence < 0.45, "maybe").when(confidence < 0.7, "probably")
