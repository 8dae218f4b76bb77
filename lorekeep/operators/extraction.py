"""Edges, rules and facts out of clause rows of definitions, axioms and theorems.

Leaves are rows (doc_id, pos, op, attitude, modal, quantifier, negated, dubitative, wh_role, subject,
predicate, object, identity, mods): senses already resolved, `identity` the subject's uid if it names one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Genera that only stand for a name.
PLACEHOLDERS = ("name", "term", "word", "designation")
LAWS, GENERICS = ("universal", "negative"), ("generic", "indefinite")


def noun(c: Column) -> Column:
    return c.rlike(r"\.n\.\d+$")


def lemma(c: Column) -> Column:
    return F.split_part(c, F.lit("."), F.lit(1))


def crisp() -> Column:
    return F.coalesce("modal", F.lit("")) == ""


def asserted(leaves: DataFrame) -> DataFrame:
    """The leaves of documents that only conjoin, without attitudes."""
    w = Window.partitionBy("doc_id")
    return leaves.withColumn("_plain", F.bool_and((F.col("op") == "AND") & F.col("attitude").isNull()).over(w)).where("_plain").drop("_plain")


def candidate_edges(leaves: DataFrame) -> DataFrame:
    """(doc_id, subject, object): the first crisp leaf of a definition whose subject and predicate are different nouns."""
    ok = leaves.where(crisp() & noun(F.col("subject")) & noun(F.col("predicate")) & (F.col("subject") != F.col("predicate")))
    return ok.groupBy("doc_id").agg(F.min(F.struct("pos", "subject", "predicate")).alias("m")).select("doc_id", F.col("m.subject").alias("subject"), F.col("m.predicate").alias("object"))


def gate_edges(candidates: DataFrame, closure: DataFrame, apart: DataFrame) -> DataFrame:
    """The candidates with the first verdict that applies: redundant, placeholder, cycle, disjoint, else accept.

    closure (node, ancestor); apart (subject, object): pairs known to be disjoint.
    """
    up = closure.select(F.col("node").alias("subject"), F.col("ancestor").alias("object"), F.lit(True).alias("_up"))
    down = closure.select(F.col("ancestor").alias("subject"), F.col("node").alias("object"), F.lit(True).alias("_down"))
    no = apart.select("subject", "object", F.lit(True).alias("_no")).distinct()
    rows = candidates.join(up, ["subject", "object"], "left").join(down, ["subject", "object"], "left").join(no, ["subject", "object"], "left")
    verdict = F.when(F.col("_up"), "redundant").when(lemma(F.col("object")).isin(*PLACEHOLDERS), "placeholder").when(F.col("_down"), "cycle").when(F.col("_no"), "disjoint").otherwise("accept")
    return rows.select("doc_id", "subject", "object", verdict.alias("verdict"))


def isa_edges(candidates: DataFrame, closure: DataFrame, apart: DataFrame) -> DataFrame:
    """(subject, object, doc_id): accepted edges, once each, with their first source."""
    return gate_edges(candidates, closure, apart).where("verdict = 'accept'").groupBy("subject", "object").agg(F.min("doc_id").alias("doc_id"))


def generic_isa_edges(leaves: DataFrame, closure: DataFrame | None = None) -> DataFrame:
    """(doc_id, pos, reason): null for generic or indefinite copular noun pairs of plain class statements, else why a leaf is no edge.

    With a closure (node, ancestor) pairs that it has are `redundant`, and those that it has the other way round a `cycle`.
    """
    reason = (
        F.when(F.col("op") != "AND", "operator")
        .when(F.col("attitude").isNotNull(), "attitude")
        .when(~crisp(), "modal")
        .when((F.col("dubitative") >= 0.75) | F.col("wh_role").isNotNull(), "question")
        .when(F.col("negated"), "negated")
        .when(F.col("identity").isNotNull(), "individual")
        .when(~F.col("quantifier").isin("generic", "indefinite"), "quantifier")
        .when(F.size("mods") > 0, "modified")
        .when(~F.coalesce(noun(F.col("subject")) & noun(F.col("predicate")), F.lit(False)), "not nouns")
    )
    rows = leaves
    if closure is not None:
        up = closure.select(F.col("node").alias("subject"), F.col("ancestor").alias("predicate"), F.lit(True).alias("_up")).distinct()
        down = up.select(F.col("predicate").alias("subject"), F.col("subject").alias("predicate"), F.lit(True).alias("_down"))
        rows = leaves.join(up, ["subject", "predicate"], "left").join(down, ["subject", "predicate"], "left")
        reason = reason.when(F.col("_up"), "redundant").when(F.col("_down"), "cycle")
    return rows.select("doc_id", "pos", reason.alias("reason"))


def question() -> Column:
    return (F.coalesce("dubitative", F.lit(0.5)) >= 0.75) | F.col("wh_role").isNotNull()


def class_rules(leaves: DataFrame) -> DataFrame:
    """(doc_id, pos, kind, subject, predicate, object, negated, strength, conds): membership and property rules by quantifier.

    A universal one is always a rule; generic, indefinite and negative ones are if they are about no individual and are no question. A negative
    one flips the polarity; plain positive pairs of nouns of a defeasible kind are edges and no rules. The subject's modifiers are conditions.
    """
    q = F.col("quantifier")
    rows = asserted(leaves).where(crisp() & F.col("subject").isNotNull() & F.col("predicate").isNotNull() & q.isin(*LAWS, *GENERICS))
    rows = rows.where((q == "universal") | (F.col("identity").isNull() & ~question()))
    rows = rows.select("doc_id", "pos", F.when(noun(F.col("predicate")), "membership").otherwise("property").alias("kind"), "subject", "predicate", "object", (F.col("negated") != (q == "negative")).alias("negated"), F.when(q.isin(*LAWS), "law").otherwise("defeasible").alias("strength"), F.col("mods").alias("conds"), q.alias("q"))
    edge = (F.col("q") != "universal") & (F.col("kind") == "membership") & F.col("object").isNull() & (F.size("conds") == 0) & ~F.col("negated")
    return rows.where(~edge).drop("q")


def facts(leaves: DataFrame) -> DataFrame:
    """(doc_id, pos, kind, seed, predicate, object, negated, mods): memberships, with the modifiers of their class, and properties of named subjects."""
    rows = asserted(leaves).where(crisp() & F.col("identity").isNotNull() & F.col("predicate").isNotNull() & ~F.col("quantifier").eqNullSafe("universal"))
    kind = F.when(noun(F.col("predicate")) & F.col("object").isNull(), "membership").otherwise("property")
    none = F.array().cast("array<string>")
    return rows.select("doc_id", "pos", kind.alias("kind"), F.col("identity").alias("seed"), "predicate", "object", "negated", F.when(kind == "membership", F.col("mods")).otherwise(none).alias("mods"))


def _documents(leaves: DataFrame) -> DataFrame:
    """(doc_id, l): the leaves of each document in order; a document is a sentence, so its array is small."""
    names = [c for c in leaves.columns if c not in ("doc_id", "pos")]
    return leaves.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", *names))).alias("l"))


def _asks(x: Column) -> Column:
    return (F.coalesce(x["dubitative"], F.lit(0.5)) >= 0.75) | x["wh_role"].isNotNull()


def _plain(x: Column) -> Column:
    return F.coalesce(x["modal"], F.lit("")) == ""


def class_conditional_rules(leaves: DataFrame) -> DataFrame:
    """(doc_id, cond_class, cond_pred, cond_obj, cond_extra, concl_pred, concl_obj, concl_negated, strength): an `if` or `because` about one class.

    Either one CONV leaf (the condition) directly behind its conclusion, with nothing but THAT complements behind it, which are further
    conditions; or two AND leaves of which one has a cause: a `reason` is the condition, a `result` the conclusion. Documents with an
    individual, a modal or a question give none, nor do a negated condition, two subjects, or quantifiers other than generic, indefinite and universal.
    """
    d = _documents(leaves).where(F.size("l") >= 2)
    d = d.where(F.forall("l", lambda x: x["identity"].isNull() & _plain(x) & ~_asks(x)))
    ifs, causes = F.filter("l", lambda x: x["op"] == "CONV"), F.filter("l", lambda x: x["cause"].isin("reason", "result"))
    at = F.array_position(F.transform("l", lambda x: x["op"]), "CONV").cast("int")  # from 1
    by_if = (F.size(ifs) == 1) & (F.size(causes) == 0) & (at > 1)
    behind = F.slice("l", at + 1, F.size("l"))
    by_if = by_if & F.forall(behind, lambda x: x["op"] == "THAT") & ~F.exists(F.slice("l", 1, at - 1), lambda x: x["op"] == "THAT")
    by_cause = (F.size(causes) == 1) & (F.size(ifs) == 0) & (F.size("l") == 2) & F.forall("l", lambda x: x["op"] == "AND")
    cause, other = F.get(causes, F.lit(0)), F.get(F.filter("l", lambda x: ~F.coalesce(x["cause"].isin("reason", "result"), F.lit(False))), F.lit(0))
    reason = cause["cause"] == "reason"
    cond = F.when(by_if, F.get("l", at - 1)).when(by_cause & reason, cause).when(by_cause, other)
    concl = F.when(by_if, F.get("l", at - 2)).when(by_cause & reason, other).when(by_cause, cause)
    extra = F.when(by_if, behind).otherwise(F.slice("l", 1, 0))
    d = d.select("doc_id", cond.alias("a"), concl.alias("c"), extra.alias("e")).where("a is not null and c is not null")
    usual = lambda c: F.coalesce(F.col(c)["quantifier"].isin("universal", *GENERICS), F.lit(False))
    ok = F.col("a.subject").isNotNull() & (F.col("c.subject").isNull() | (F.col("c.subject") == F.col("a.subject"))) & F.col("a.predicate").isNotNull() & F.col("c.predicate").isNotNull() & ~F.col("a.negated") & usual("a") & usual("c")
    good = F.forall("e", lambda x: (x["subject"].isNull() | (x["subject"] == F.col("a.subject"))) & ~x["negated"] & x["predicate"].isNotNull())
    further = F.transform("e", lambda x: F.struct(x["predicate"].alias("predicate"), x["object"].alias("object")))
    strength = F.when(F.col("c.quantifier") == "universal", "law").otherwise("defeasible")
    names = {"cond_class": F.col("a.subject"), "cond_pred": F.col("a.predicate"), "cond_obj": F.col("a.object"), "cond_extra": further, "concl_pred": F.col("c.predicate"), "concl_obj": F.col("c.object"), "concl_negated": F.col("c.negated"), "strength": strength}
    return d.where(ok & good).select("doc_id", *[v.alias(k) for k, v in names.items()])


def reportative_facts(leaves: DataFrame) -> DataFrame:
    """(doc_id, pos, seed, predicate, object): what an individual is said to do and to report of itself, all of a document or nothing.

    One leaf without attitude that folds by AND, about an individual, and else only THAT complements of attitude class `reportative` that have no
    subject of their own but inherit that individual. A modal, negated, universal or asking leaf, or a missing predicate, gives none.
    """
    d = _documents(leaves).where(F.size("l") >= 2)
    matrix = F.filter("l", lambda x: (x["op"] == "AND") & x["attitude"].isNull())
    d = d.withColumn("m", F.get(matrix, F.lit(0))).where((F.size(matrix) == 1) & (F.size(F.filter("l", lambda x: x["op"] == "THAT")) == F.size("l") - 1))
    fine = lambda x: _plain(x) & ~x["negated"] & ~x["quantifier"].eqNullSafe("universal") & ~_asks(x) & x["predicate"].isNotNull()
    own = lambda x: (x["pos"] == F.col("m.pos")) | (x["attitude_class"].eqNullSafe("reportative") & x["subject"].isNull() & x["identity"].eqNullSafe(F.col("m.identity")))
    d = d.where(F.col("m.identity").isNotNull() & F.forall("l", lambda x: fine(x) & own(x)))
    return d.select("doc_id", F.col("m.identity").alias("seed"), F.explode("l").alias("x")).select("doc_id", "x.pos", "seed", "x.predicate", "x.object")


def conditional_rules(leaves: DataFrame) -> DataFrame:
    """(doc_id, cond_pred, cond_obj, concl_pred, concl_obj, concl_negated): an IMPLY leaf directly after a universal one without a subject sense."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    before = F.lag(F.struct("quantifier", "subject", "predicate", "object", "modal")).over(w)
    rows = leaves.withColumn("b", before).where((F.col("op") == "IMPLY") & (F.col("b.quantifier") == "universal") & F.col("b.subject").isNull() & F.col("b.predicate").isNotNull() & F.col("predicate").isNotNull())
    return rows.select("doc_id", F.col("b.predicate").alias("cond_pred"), F.col("b.object").alias("cond_obj"), F.col("predicate").alias("concl_pred"), F.col("object").alias("concl_obj"), F.col("negated").alias("concl_negated"))


def dnf_branches(leaves: DataFrame) -> DataFrame:
    """(doc_id, branch, members): alternative lists of leaf positions by a left fold: OR starts an alternative, AND joins all;
    any other operator taints (members null)."""
    packed = leaves.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "op"))).alias("l"))
    start = F.array(F.array(F.col("l")[0]["pos"]))
    fold = F.aggregate(F.slice("l", 2, F.size("l")), start, lambda acc, x: F.when(x["op"] == "OR", F.concat(acc, F.array(F.array(x["pos"])))).otherwise(F.transform(acc, lambda b: F.concat(b, F.array(x["pos"])))))
    tainted = F.exists(F.slice("l", 2, F.size("l")), lambda x: ~x["op"].isin("AND", "OR"))
    return packed.select("doc_id", F.posexplode(F.when(tainted, F.array(F.lit(None).cast("array<int>"))).otherwise(fold)).alias("branch", "members"))


def genera(leaves: DataFrame) -> DataFrame:
    """(doc_id, klass, genus, pos): the leaf of a definition that says what its class is."""
    ok = leaves.where(crisp() & noun(F.col("subject")) & noun(F.col("predicate")) & (F.col("subject") != F.col("predicate")))
    return ok.groupBy("doc_id").agg(F.min(F.struct("pos", "subject", "predicate")).alias("m")).select("doc_id", F.col("m.subject").alias("klass"), F.col("m.predicate").alias("genus"), F.col("m.pos").alias("genus_pos"))


def sufficient_rules(branches: DataFrame, leaves: DataFrame, genus: DataFrame) -> DataFrame:
    """(doc_id, branch, verdict, conds): a branch is accepted if each member other than the genus leaf is a usable condition of the
    defined class; else the first member's fault: taint, no_pred, foreign_subj (about neither the class, the genus nor nothing named),
    negated_cond, noun_cond, verb_noobj, circular; a branch without a condition is bare. A member that says the genus again is no condition.

    genus: rows of `genera`. conds are distinct, in order.
    """
    flat = branches.select("doc_id", "branch", F.explode_outer("members").alias("pos"))
    rows = flat.join(leaves.select("doc_id", "pos", "subject", "predicate", "object", "negated"), ["doc_id", "pos"], "left").join(genus, "doc_id")
    own = F.coalesce(F.col("pos") == F.col("genus_pos"), F.lit(False))
    again = F.coalesce(F.col("predicate") == F.col("genus"), F.lit(False))
    begin = lambda c: F.substring(lemma(F.col(c)), 1, 4)
    fault = (
        F.when(F.col("pos").isNull(), "taint")
        .when(own, F.lit(None))
        .when(F.col("predicate").isNull(), "no_pred")
        .when(F.col("subject").isNotNull() & ~F.col("subject").isin(F.col("klass"), F.col("genus")), "foreign_subj")
        .when(F.col("negated"), "negated_cond")
        .when(again, F.lit(None))
        .when(noun(F.col("predicate")), "noun_cond")
        .when(F.col("predicate").rlike(r"\.v\.\d+$") & F.col("object").isNull(), "verb_noobj")
        .when(begin("predicate") == begin("klass"), "circular")
    )
    marked = rows.withColumn("fault", fault).withColumn("cond", F.when(~own & ~again & F.col("predicate").isNotNull(), F.struct("pos", "predicate", "object")))
    first = F.min(F.when(F.col("fault").isNotNull(), F.struct(F.coalesce("pos", F.lit(-1)).alias("p"), F.col("fault").alias("f"))))["f"]
    listed = F.array_distinct(F.transform(F.array_sort(F.collect_list("cond")), lambda c: F.struct(c["predicate"].alias("predicate"), c["object"].alias("object"))))
    out = marked.groupBy("doc_id", "branch").agg(first.alias("first"), listed.alias("conds"))
    return out.select("doc_id", "branch", F.coalesce("first", F.when(F.size("conds") == 0, "bare"), F.lit("accept")).alias("verdict"), "conds")


def leaf_fates(leaves: DataFrame) -> DataFrame:
    """(fate, n): what each leaf becomes."""
    q = F.col("quantifier")
    fate = (
        F.when(F.col("predicate").isNull(), "dropped")
        .when(F.col("op") == "IMPLY", "conditional")
        .when(F.col("identity").isNotNull(), "fact")
        .when(q == "universal", "law")
        .when(q == "negative", "disjointness")
        .when(q.isin("generic", "indefinite") & noun(F.col("predicate")) & ~F.col("negated"), "edge")
        .when(q.isin("generic", "indefinite"), "generic")
        .otherwise("dropped")
    )
    return leaves.groupBy(fate.alias("fate")).agg(F.count("*").alias("n"))


def extract_logic(leaves: DataFrame) -> DataFrame:
    """(shape, verdict, n): the funnel over all shapes."""
    parts = [
        class_rules(leaves).select(F.lit("rule").alias("shape"), "kind"),
        facts(leaves).select(F.lit("fact").alias("shape"), "kind"),
        conditional_rules(leaves).select(F.lit("conditional").alias("shape"), F.lit("property").alias("kind")),
        generic_isa_edges(leaves).select(F.lit("edge").alias("shape"), F.coalesce("reason", F.lit("accept")).alias("kind")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("shape", F.col("kind").alias("verdict")).agg(F.count("*").alias("n"))


def definition_profile(leaves: DataFrame, closure: DataFrame) -> DataFrame:
    """(what, value, n): definitions by their number of leaves, leaves by quantifier and by word class of the predicate, and definitions'
    candidate edges by whether the closure (node, ancestor) has them (redundant), has the subject (new) or does not (off the graph)."""
    counted = lambda df, what, c: df.groupBy(c.cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "value", "n")
    sizes = leaves.groupBy("doc_id").agg(F.count("*").alias("leaves"))
    have = closure.select(F.col("node").alias("subject"), F.col("ancestor").alias("object"), F.lit(True).alias("_has")).distinct()
    on = closure.select(F.col("node").alias("subject"), F.lit(True).alias("_on")).distinct()
    edges = candidate_edges(leaves).join(have, ["subject", "object"], "left").join(on, "subject", "left")
    state = F.when(F.col("_has"), "redundant").when(F.col("_on"), "new").otherwise("off the graph")
    word_class = F.nullif(F.regexp_extract("predicate", r"\.([a-z])\.\d+$", 1), F.lit(""))
    parts = [counted(sizes, "leaves", F.col("leaves")), counted(leaves, "quantifier", F.col("quantifier")), counted(leaves, "class", word_class), counted(edges, "edge", state)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
