"""Forward chaining for all seeds at once: class and property fixpoints with premises, conflicts, novelty and trust.

A seed is a column, never a loop; loops run over rounds only, each written to the checkpoint folder.
Of several routes to a class the one of the first round counts, then the fewest premises, then the
smallest list of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.operators.ledger import conclusion_trust
from lorekeep.runtime import store

KEY = ["seed", "predicate", "object", "negated"]


def _lemma(sense: Column) -> Column:
    return F.split_part(sense, F.lit("."), F.lit(1))


def cond_match(cond: Column, have: Column) -> Column:
    """Equal senses, or a shorter lemma of at least four letters that begins the longer one."""
    a, b = _lemma(cond), _lemma(have)
    return (cond == have) | ((F.least(F.length(a), F.length(b)) >= 4) & (F.startswith(a, b) | F.startswith(b, a)))


def _first(rows: DataFrame, keys: list[str], *more: str) -> DataFrame:
    """The route with fewest premises, then the smallest, of each key, with what it came from (`more`)."""
    least = F.min(F.struct(F.size("premises").alias("n"), "premises", *more)).alias("m")
    return rows.groupBy(*keys).agg(least).select(*keys, *[F.col(f"m.{c}").alias(c) for c in ("premises", *more)])


def _compact(rounds: list[DataFrame], most: int = 8) -> list[DataFrame]:
    """The rounds, written as one where there are many, so that plans stay short however many rounds it takes."""
    return [store(reduce(DataFrame.unionByName, rounds))] if len(rounds) > most else rounds


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


#: What a conclusion came from: a class of the seed, the rule, and the conditions of the rule that properties met.
ORIGIN = "struct<klass:string,rule:string,uses:array<struct<predicate:string,object:string>>>"


def _plus(premises: Column, *more: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.concat(premises, *more), lambda x: x.isNotNull())))


def seeds(facts: DataFrame, rules: DataFrame, tier_subjects: DataFrame) -> DataFrame:
    """(seed, priority): individuals with facts (0), then rule subjects (1), then tier subjects (2)."""
    parts = [facts.select("seed", F.lit(0).alias("priority")), rules.select(F.col("subject").alias("seed"), F.lit(1).alias("priority")), tier_subjects.select("seed", F.lit(2).alias("priority"))]
    return reduce(DataFrame.unionByName, parts).where("seed is not null").groupBy("seed").agg(F.min("priority").alias("priority"))


def conds_met(rules: DataFrame, properties: DataFrame) -> DataFrame:
    """(seed, rule_id, premises): rules (rule_id, conds array<struct<predicate,object>>) whose every condition a seed's property
    facts fulfil: relational division. Predicates match charitably, a null object matches any."""
    need = rules.where(F.size("conds") > 0).select("rule_id", F.size("conds").alias("all"), F.posexplode("conds").alias("i", "c")).select("rule_id", "all", "i", F.col("c.predicate").alias("cp"), F.col("c.object").alias("co"))
    block = lambda c: F.substring(_lemma(c), 1, 4)
    have = properties.where("not negated").select("seed", F.col("predicate").alias("hp"), F.col("object").alias("ho"), "fact_id")
    hit = have.join(need, block(F.col("hp")) == block(F.col("cp"))).where(cond_match(F.col("cp"), F.col("hp")) & (F.col("co").isNull() | (F.col("co") == F.col("ho"))))
    one = hit.groupBy("seed", "rule_id", "all", "i").agg(F.min("fact_id").alias("fact_id"))
    return one.groupBy("seed", "rule_id", "all").agg(F.array_sort(F.collect_set("fact_id")).alias("premises"), F.count("*").alias("n")).where(F.col("n") == F.col("all")).select("seed", "rule_id", "premises")


def rules_met(kb: dict[str, DataFrame]) -> DataFrame:
    """(seed, rule_id, premises): conds_met of all rules that have conditions, memberships, properties and sufficient ones; it needs no edges."""
    return store(conds_met(kb["rules"].select("rule_id", "conds").unionByName(kb["sufficient"].select("rule_id", "conds")), kb["properties"]))


def class_fixpoint(facts: DataFrame, edges: DataFrame, rules: DataFrame, sufficient: DataFrame, properties: DataFrame, met: DataFrame | None = None) -> DataFrame:
    """(seed, klass, premises, via, step): classes of each seed by its facts, the class edges, membership rules and sufficient
    rules; via is the class before (null for a fact's own), step the rule that led on from it (null for an edge).

    facts (seed, klass, negated, fact_id); edges (child, parent, source); rules (rule_id, kind, subject,
    predicate, object, negated, conds); sufficient (rule_id, genus, klass, conds). Negated memberships
    never seed; an edge's source (null for bedrock) is a premise. Rounds go on until nothing is new: a class is found once for a
    seed, so they end, cycles included. met: rules_met, where it is known.
    """
    member = rules.where("kind = 'membership' and not negated")
    step = edges.select(F.col("child").alias("klass"), F.col("parent").alias("to"), F.col("source").alias("premise"), _none("string").alias("needs"), _none("string").alias("rule"))
    rule = F.col("rule_id").alias("rule")
    step = step.unionByName(member.select(F.col("subject").alias("klass"), F.col("predicate").alias("to"), F.col("rule_id").alias("premise"), F.when(F.size("conds") > 0, F.col("rule_id")).alias("needs"), rule))
    step = store(step.unionByName(sufficient.select(F.col("genus").alias("klass"), F.col("klass").alias("to"), F.col("rule_id").alias("premise"), F.col("rule_id").alias("needs"), rule)))
    met = met if met is not None else store(conds_met(member.select("rule_id", "conds").unionByName(sufficient.select("rule_id", "conds")), properties))
    met = met.select("seed", F.col("rule_id").alias("needs"), F.col("premises").alias("met"))
    told = facts.where("not negated").select("seed", "klass", F.array_compact(F.array("fact_id")).alias("premises"), _none("string").alias("via"), _none("string").alias("step"))
    frontier = store(_first(told, ["seed", "klass"], "via", "step"))
    rounds = [frontier]
    while True:
        reach = frontier.drop("via", "step").join(step, "klass")
        on = ["seed", F.col("to").alias("klass"), F.col("klass").alias("via"), F.col("rule").alias("step")]
        free = reach.where("needs is null").select(*on, _plus(F.col("premises"), F.array("premise")).alias("premises"))
        bound = reach.where("needs is not null").join(met, ["seed", "needs"]).select(*on, _plus(F.col("premises"), F.array("premise"), F.col("met")).alias("premises"))
        known = reduce(DataFrame.unionByName, rounds).select("seed", "klass")
        frontier = store(_first(free.unionByName(bound), ["seed", "klass"], "via", "step").join(known, ["seed", "klass"], "left_anti"))
        if frontier.isEmpty():
            break
        rounds = _compact([*rounds, frontier])
    return reduce(DataFrame.unionByName, rounds)


def membership_fixpoint(facts: DataFrame, edges: DataFrame, rules: DataFrame, properties: DataFrame) -> DataFrame:
    """Classes by membership rules and edges only."""
    none = rules.select("rule_id", F.col("subject").alias("genus"), F.col("predicate").alias("klass"), "conds").limit(0)
    return class_fixpoint(facts, edges, rules, none, properties)


def derive_properties(closure: DataFrame, rules: DataFrame, properties: DataFrame, met: DataFrame | None = None) -> DataFrame:
    """(seed, predicate, object, negated, premises, origin) by property rules and negated memberships. met: rules_met, where it is known."""
    use = rules.where("kind = 'property' or (kind = 'membership' and negated)")
    hit = closure.join(use, F.col("klass") == F.col("subject"))
    met = (met if met is not None else conds_met(use, properties)).select("seed", "rule_id", F.col("premises").alias("met"))
    out = hit.join(met, ["seed", "rule_id"], "left").where((F.size("conds") == 0) | F.col("met").isNotNull())
    origin = F.struct("klass", F.col("rule_id").alias("rule"), F.array().cast("array<struct<predicate:string,object:string>>").alias("uses")).alias("origin")
    return _first(out.select(*KEY, _plus(F.col("premises"), F.array("rule_id"), F.coalesce("met", F.array().cast("array<string>"))).alias("premises"), origin), KEY, "origin")


def derive_conditional(held: DataFrame, rules: DataFrame, closure: DataFrame) -> DataFrame:
    """Conclusions (KEY, premises, origin) of conditional rules (rule_id, cond_class, cond_pred, cond_obj, cond_extra, concl_pred, concl_obj,
    concl_negated) from the properties held, until nothing is added; only affirmative conclusions are conditions again.

    cond_extra array<struct<predicate,object>>, optional: further properties that must hold, given or derived in any round. A rule fires in the round after
    its last condition is met, so of its conditions one is of the last round and the others are looked up in all rounds.
    """
    if "cond_extra" not in rules.columns:
        rules = rules.withColumn("cond_extra", F.array().cast("array<struct<predicate:string,object:string>>"))
    rules = rules.withColumn("conds", F.concat(F.array(F.struct(F.col("cond_pred").alias("predicate"), F.col("cond_obj").alias("object"))), F.coalesce("cond_extra", F.array().cast("array<struct<predicate:string,object:string>>"))))
    need = store(rules.select("rule_id", F.size("conds").alias("all"), F.posexplode("conds").alias("i", "c")).select("rule_id", "all", "i", F.col("c.predicate").alias("predicate"), F.col("c.object").alias("co")))
    # Only properties that some rule asks for or concludes can matter.
    told = need.select("predicate", "co").unionByName(rules.select(F.col("concl_pred").alias("predicate"), _none("string").alias("co"))).distinct()
    told = store(told.select(F.col("predicate").alias("_predicate"), F.col("co").alias("_co")))
    matters = (F.col("predicate") == F.col("_predicate")) & (F.col("_co").isNull() | (F.col("_co") == F.col("object")))
    known = store(_first(held.where("not negated").join(told, matters, "left_semi").select("seed", "predicate", "object", "negated", "premises"), KEY))
    rounds: list[DataFrame] = []
    mets: list[DataFrame] = []
    frontier = known
    heads = rules.select("rule_id", "cond_class", "concl_pred", "concl_obj", "concl_negated")
    classes = closure.select("seed", F.col("klass").alias("cond_class"), F.col("premises").alias("class_premises"))
    while True:
        hit = frontier.join(need, "predicate").where(F.col("co").isNull() | (F.col("co") == F.col("object")))
        hit = _first(hit.select("seed", "rule_id", "all", "i", "premises", F.struct("predicate", "object").alias("use")), ["seed", "rule_id", "all", "i"], "use")
        fresh = store(hit.join(reduce(DataFrame.unionByName, mets), ["seed", "rule_id", "i"], "left_anti") if mets else hit)
        if fresh.isEmpty():
            break
        now = reduce(DataFrame.unionByName, mets).join(fresh.select("seed", "rule_id").distinct(), ["seed", "rule_id"], "left_semi").unionByName(fresh) if mets else fresh
        mets = _compact([*mets, fresh])
        full = now.groupBy("seed", "rule_id", "all").agg(F.count("*").alias("n"), F.flatten(F.collect_list("premises")).alias("premises"), F.array_sort(F.collect_list(F.struct("i", "use"))).alias("uses")).where(F.col("n") == F.col("all"))
        fired = full.join(heads, "rule_id").join(classes, ["seed", "cond_class"], "left").where("cond_class is null or class_premises is not null")
        origin = F.struct(F.col("cond_class").alias("klass"), F.col("rule_id").alias("rule"), F.transform("uses", lambda u: u["use"]).alias("uses")).alias("origin")
        new = fired.select("seed", F.col("concl_pred").alias("predicate"), F.col("concl_obj").alias("object"), F.col("concl_negated").alias("negated"), _plus(F.col("premises"), F.array("rule_id"), F.coalesce("class_premises", F.array().cast("array<string>"))).alias("premises"), origin)
        seen = reduce(DataFrame.unionByName, [known, *[r.drop("origin") for r in rounds]]).select(*[F.col(c).alias(f"_{c}") for c in KEY])
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in KEY])
        frontier = store(_first(new, KEY, "origin").join(seen, same, "left_anti"))
        if frontier.isEmpty():
            break
        rounds = _compact([*rounds, frontier])
        frontier = frontier.where("not negated")
    return reduce(DataFrame.unionByName, rounds) if rounds else known.limit(0).withColumn("origin", _none(ORIGIN))


def mark_conflicts(derived: DataFrame, closure: DataFrame) -> DataFrame:
    """The conclusions with conflict: both polarities of one (seed, predicate, object), or a negated predicate without object
    that is held as a class; premises of the other arm are added."""
    keys = ["seed", "predicate", "object"]
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys])
    sides = derived.groupBy(*keys).agg(F.min("negated").alias("lo"), F.max("negated").alias("hi"), F.collect_list("premises").alias("every")).where("lo <> hi")
    clashing = store(sides.select(*[F.col(c).alias(f"_{c}") for c in keys], F.array_sort(F.array_distinct(F.flatten("every"))).alias("every")))
    rows = derived.join(clashing, same, "left")
    # Only a negated predicate without object can be held as a class; the others meet no class.
    bare = F.coalesce(F.col("negated") & F.col("object").isNull(), F.lit(False))
    denied = store(derived.where(bare).select("predicate").distinct())
    held = closure.select("seed", F.col("klass").alias("predicate"), F.col("premises").alias("held")).join(denied, "predicate", "left_semi")
    rows = rows.where(bare).join(held, ["seed", "predicate"], "left").unionByName(rows.where(~bare).withColumn("held", _none("array<string>")))
    clash = F.coalesce(F.col("negated") & F.col("object").isNull() & F.col("held").isNotNull(), F.lit(False))
    premises = F.coalesce("every", "premises")
    origin = ["origin"] if "origin" in derived.columns else []
    return rows.select(*keys, "negated", F.when(clash, _plus(premises, F.col("held"))).otherwise(premises).alias("premises"), (F.col("every").isNotNull() | clash).alias("conflict"), *origin)


def forward_chain(kb: dict[str, DataFrame], closure: DataFrame | None = None, met: DataFrame | None = None) -> DataFrame:
    """All conclusions, conflicts marked. kb: facts, properties, edges, rules, sufficient, conditional; closure: the classes, and met: rules_met, where they are known."""
    met = met if met is not None else rules_met(kb)
    closure = closure if closure is not None else store(class_fixpoint(kb["facts"], kb["edges"], kb["rules"], kb["sufficient"], kb["properties"], met))
    direct = store(derive_properties(closure, kb["rules"], kb["properties"], met))
    told = kb["properties"].select("seed", "predicate", "object", "negated", F.array("fact_id").alias("premises"))
    further = derive_conditional(direct.drop("origin").unionByName(told), kb["conditional"], closure)
    return mark_conflicts(store(direct.unionByName(further)), closure)


def class_chains(asked: DataFrame, closure: DataFrame) -> DataFrame:
    """(seed, klass, chain): how each seed asked about (seed, klass) came to a class: `x is a —is_a→ b -> all b are c`.

    The rounds of the closure keep a pointer to the class before; chains are walked back from their ends, all at once, one join a step.
    """
    back = closure.select("seed", F.col("klass").alias("at"), "via", "step")
    walk = store(asked.select("seed", "klass").distinct()).select("seed", "klass", F.col("klass").alias("at"), F.lit("").alias("text"))
    done: list[DataFrame] = []
    while True:
        met = walk.join(back, ["seed", "at"])
        arrow = F.when(F.col("via").isNull(), F.concat("seed", F.lit(" is "), "at")).when(F.col("step").isNull(), F.concat(F.lit(" —is_a→ "), "at")).otherwise(F.concat(F.lit(" -> all "), "via", F.lit(" are "), "at"))
        walk = store(met.select("seed", "klass", F.col("via").alias("at"), F.concat(arrow, "text").alias("text")))
        done = _compact([*done, walk.where("at is null")])
        walk = walk.where("at is not null")
        if walk.isEmpty():
            return reduce(DataFrame.unionByName, done).select("seed", "klass", F.col("text").alias("chain"))


def derivations(asked: DataFrame, derived: DataFrame, closure: DataFrame) -> DataFrame:
    """(id, derivation): for conclusions asked about (id, KEY) the lines that prove them, what others rest on first.

    Each line is one conclusion of forward_chain: the chain of classes or the conditions it rests on, its rule, and what follows. The
    conditions' own conclusions are looked up in turn, a round for each level; told facts have no line of their own.
    """
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in KEY])
    known = derived.where("origin is not null").select(*[F.col(c).alias(f"_{c}") for c in KEY], "origin")
    frontier = asked.select("id", *KEY).distinct()
    levels: list[DataFrame] = []
    level = 0
    while True:
        found = store(frontier.join(known, same).select("id", *KEY, "origin", F.lit(level).alias("level")))
        if found.isEmpty():
            break
        levels = _compact([*levels, found])
        level += 1
        frontier = found.select("id", "seed", F.explode("origin.uses").alias("u")).select("id", "seed", "u.predicate", "u.object", F.lit(False).alias("negated")).distinct()
    if not levels:
        return asked.select("id", F.array().cast("array<string>").alias("derivation")).limit(0)
    every = reduce(DataFrame.unionByName, levels).groupBy("id", *KEY, "origin").agg(F.max("level").alias("level"))
    chains = class_chains(every.select("seed", F.col("origin.klass").alias("klass")).where("klass is not null"), closure).withColumnRenamed("klass", "k")
    rows = every.withColumn("k", F.col("origin.klass")).join(chains, ["seed", "k"], "left")
    said = lambda p, o, n: F.concat_ws(" ", F.when(n, F.lit("not")), p, o)
    met = F.array_join(F.transform("origin.uses", lambda u: said(u["predicate"], u["object"], F.lit(False))), " and ")
    ground = F.concat_ws(" and ", "chain", F.when(F.size("origin.uses") > 0, F.concat_ws(" ", "seed", met)))
    line = F.concat(ground, F.lit(" -> "), F.col("origin.rule"), F.lit(" -> "), F.concat_ws(" ", "seed", said(F.col("predicate"), F.col("object"), F.col("negated"))))
    return rows.groupBy("id").agg(F.array_sort(F.collect_set(F.struct((-F.col("level")).alias("level"), line.alias("line")))).alias("d")).select("id", F.transform("d", lambda x: x["line"]).alias("derivation"))


def novel_conclusions(derived: DataFrame, min_premises: int = 2) -> DataFrame:
    """Conclusions without conflict that rest on at least so many premises, once each."""
    return _first(derived.where((~F.col("conflict")) & (F.size("premises") >= min_premises)), KEY)


def saturate(kb: dict[str, DataFrame], edge_trust: DataFrame | None = None) -> DataFrame:
    """Novel conclusions with the trust that their premises allow; edge_trust: (key, trust)."""
    return _trusted(novel_conclusions(forward_chain(kb)), edge_trust)


def _trusted(made: DataFrame, edge_trust: DataFrame | None = None) -> DataFrame:
    made = store(made.withColumn("id", F.to_json(F.struct(*KEY))))
    trust = edge_trust if edge_trust is not None else made.select(F.col("id").alias("key"), F.lit(0.9).alias("trust")).limit(0)
    return made.join(conclusion_trust(made, trust), "id").drop("id")


def tier_ablation(kb: dict[str, DataFrame], without: DataFrame) -> DataFrame:
    """Conclusions that exist only with all edges, not with those in `without`; conditions of rules are matched once for both."""
    met = rules_met(kb)
    less = novel_conclusions(forward_chain(kb | {"edges": without}, met=met)).select(*[F.col(c).alias(f"_{c}") for c in KEY])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in KEY])
    return _trusted(novel_conclusions(forward_chain(kb, met=met)).join(less, same, "left_anti"))


def reductio_prove(claims: DataFrame, kb: dict[str, DataFrame]) -> DataFrame:
    """(claim_id, proved, derivation, premises): claims (claim_id, seed, predicate, optional object and negated) decided by
    contradiction. Assuming a claim and its opposite, each in a context of its own, makes conflicts; those that the knowledge
    has without the assumption prove nothing, and one must rest on it. False if the claim itself fails, else true if its opposite does,
    else null.

    A predicate is a class if it is a noun's sense or the knowledge has it as one; the claim is then a membership. Of an individual (a
    seed with facts or properties) it is assumed as a fact; that it is none would add nothing and is not assumed. Of a class
    it is assumed as a rule, either way. Other predicates are assumed as properties, either way. A context has the facts of one
    subject, so the work grows with the claims.
    """
    yes = F.coalesce("negated", F.lit(False)) if "negated" in claims.columns else F.lit(False)
    people = kb["facts"].select("seed").unionByName(kb["properties"].select("seed")).distinct().withColumn("known", F.lit(True))
    named = [kb["facts"].select("klass"), kb["edges"].select("child"), kb["edges"].select("parent"), kb["rules"].select("subject"), kb["rules"].where("kind = 'membership'").select("predicate"), kb["sufficient"].select("genus"), kb["sufficient"].select("klass")]
    classes = reduce(DataFrame.union, named).toDF("predicate").distinct().withColumn("listed", F.lit(True))
    asked = claims.select("claim_id", "seed", "predicate", (F.col("object") if "object" in claims.columns else _none("string")).alias("object"), yes.alias("negated"))
    asked = asked.join(people, "seed", "left").join(classes, "predicate", "left")
    member = F.col("object").isNull() & (F.col("listed").isNotNull() | F.contains("predicate", F.lit(".n.")))
    asked = store(asked.select("claim_id", "seed", "predicate", "object", "negated", F.col("known").isNotNull().alias("individual"), member.alias("member")))
    arms = asked.withColumn("assumed", F.explode(F.array(F.col("negated"), ~F.col("negated")))).where("not (individual and member and assumed)")
    arms = arms.withColumn("context", F.concat_ws("#", F.lit("if"), F.col("claim_id").cast("string"), F.col("assumed").cast("string")))
    before = F.concat(F.lit("as is#"), F.col("seed"))
    contexts = store(arms.select("context", "seed", "individual").unionByName(asked.select(before.alias("context"), "seed", "individual").distinct()))
    own = lambda df: df.join(contexts.select("seed", "context"), "seed").drop("seed").withColumnRenamed("context", "seed")
    facts = own(kb["facts"]).select("seed", "klass", "negated", "fact_id")
    facts = facts.unionByName(contexts.where("not individual").select(F.col("context").alias("seed"), F.col("seed").alias("klass"), F.lit(False).alias("negated"), _none("string").alias("fact_id")))
    facts = facts.unionByName(arms.where("member and not assumed").select(F.col("context").alias("seed"), F.col("predicate").alias("klass"), F.lit(False).alias("negated"), F.lit("hypothesis").alias("fact_id")))
    supposed = arms.where("not member").select(F.col("context").alias("seed"), "predicate", "object", F.col("assumed").alias("negated"), F.lit("hypothesis").alias("fact_id"))
    properties = store(own(kb["properties"]).select(*KEY, "fact_id").unionByName(supposed))
    closure = store(class_fixpoint(facts, kb["edges"], kb["rules"], kb["sufficient"], properties))
    denied = arms.where("member and assumed").select(F.col("context").alias("seed"), "predicate", _none("string").alias("object"), F.lit(True).alias("negated"), F.array(F.lit("hypothesis")).alias("premises"), _none(ORIGIN).alias("origin"))
    told = properties.select(*KEY, F.array("fact_id").alias("premises"), _none(ORIGIN).alias("origin"))
    direct = derive_properties(closure, kb["rules"], properties).unionByName(denied).unionByName(told)
    direct = store(direct)
    marked = store(mark_conflicts(direct.unionByName(derive_conditional(direct.drop("origin"), kb["conditional"], closure)), closure))
    sign = ["predicate", "object", "negated"]
    clashes = marked.where("conflict").select(F.col("seed").alias("context"), *sign, "premises")
    old = clashes.join(asked.select(before.alias("context"), "seed").distinct(), "context").select(F.col("seed").alias("_seed"), *[F.col(c).alias(f"_{c}") for c in sign]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in sign], F.col("seed") == F.col("_seed"))
    of_arm = arms.select("context", "claim_id", "seed", F.concat_ws(" ", F.when(F.col("member"), F.lit("is")), F.when(F.col("assumed"), F.lit("not")), "predicate", "object").alias("claimed"), (F.col("assumed") != F.col("negated")).alias("other"))
    new = clashes.where(F.array_contains("premises", "hypothesis")).join(of_arm, "context").join(old, same, "left_anti")
    first = store(new.groupBy("claim_id").agg(F.min(F.struct("other", *sign, "premises", "context", "seed", "claimed")).alias("m")).select("claim_id", "m.*"))
    sides = F.explode(F.array(F.lit(False), F.lit(True))).alias("negated")
    lines = derivations(first.select(F.col("claim_id").alias("id"), F.col("context").alias("seed"), "predicate", "object", sides), marked, closure).withColumnRenamed("id", "claim_id")
    assume = F.concat_ws(" ", F.lit("assume"), "seed", "claimed")
    shown = F.transform(F.coalesce("derivation", F.array().cast("array<string>")), lambda x: F.replace(x, F.col("context"), F.col("seed")))
    proof = first.join(lines, "claim_id", "left").select("claim_id", F.col("other").alias("proved"), F.concat(F.array(assume), shown, F.array(F.lit("the assumption is false"))).alias("derivation"), F.array_remove("premises", "hypothesis").alias("premises"))
    return asked.select("claim_id").distinct().join(proof, "claim_id", "left")


#: What a rung says of a claim besides whether it holds: the lines of its proof, and the knowledge it can't do without.
GROUND = ["derivation", "premises"]


def _grounded(rows: DataFrame) -> DataFrame:
    """Rung rows with both columns of GROUND, empty where the rung has none."""
    empty = F.array().cast("array<string>")
    return rows.select("claim_id", "holds", *[(F.coalesce(F.col(c), empty) if c in rows.columns else empty).alias(c) for c in GROUND])


def _line(*parts) -> Column:
    return F.array(F.concat_ws(" ", *parts))


def _not(negated: str) -> Column:
    return F.when(F.col(negated), F.lit("not"))


def direct_fact(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """(claim_id, holds, derivation): the first fact (kind, ordinal) with exactly the claim's key; the same polarity confirms."""
    key = ["subject", "predicate", "object"]
    on = reduce(lambda a, b: a & b, [claims[k].eqNullSafe(facts[k]) if k == "object" else claims[k] == facts[k] for k in key])
    hit = claims.join(facts, on).select("claim_id", claims["negated"].alias("cn"), facts["negated"].alias("fn"), "kind", "ordinal", *[claims[k] for k in key])
    first = hit.groupBy("claim_id", "cn").agg(F.min(F.struct("kind", "ordinal", "fn", *key)).alias("m")).select("claim_id", "cn", "m.*")
    holds = F.col("cn") == F.col("fn")
    said = _line(F.when(holds, "direct fact confirms: stored").otherwise("direct fact refutes: stored"), "kind", "subject", _not("fn"), "predicate", "object")
    return first.select("claim_id", holds.alias("holds"), said.alias("derivation"))


def individual_fact(claims: DataFrame, memberships: DataFrame, properties: DataFrame) -> DataFrame:
    """(claim_id, holds, derivation, premises): a membership by exact class, else a property where either object is null or both agree.

    The null-tolerant comparison is a filter after an equi-join on (subject, predicate).
    """
    key = ["subject", "predicate"]
    m = claims.join(memberships.select(F.col("seed").alias("subject"), F.col("klass").alias("predicate"), F.col("negated").alias("fn"), "fact_id"), key).where("object is null")
    p = claims.join(properties.select(F.col("seed").alias("subject"), "predicate", F.col("object").alias("fo"), F.col("negated").alias("fn"), "fact_id"), key).where("object is null or fo is null or object = fo")
    both = m.select("claim_id", "negated", "fn", "fact_id", F.lit(0).alias("p"), *key, _none("string").alias("fo")).unionByName(p.select("claim_id", "negated", "fn", "fact_id", F.lit(1).alias("p"), *key, "fo"))
    first = both.groupBy("claim_id", "negated").agg(F.min(F.struct("p", "fact_id", "fn", *key, "fo")).alias("m")).select("claim_id", "negated", "m.*")
    said = _line(F.lit("fact:"), "subject", F.when(F.col("p") == 0, "is"), _not("fn"), "predicate", "fo")
    return first.select("claim_id", (F.col("negated") == F.col("fn")).alias("holds"), said.alias("derivation"), F.array("fact_id").alias("premises"))


def chain_ground(claims: DataFrame, derived: DataFrame, siblings: DataFrame | None = None, closure: DataFrame | None = None) -> DataFrame:
    """(claim_id, holds, derivation, premises): a derived property decides unless derivations conflict or disagree; objects agree
    or the rule had none. Of several that decide the one of fewest premises is told; its lines need the closure of classes.

    siblings (sense, sibling): of claims that the subject itself does not decide, the siblings do if those that decide all agree; the
    first sibling by name is told.
    """
    premises = F.col("premises") if "premises" in derived.columns else F.array().cast("array<string>")
    d = derived.select(F.col("seed").alias("subject"), "predicate", F.col("object").alias("do"), F.col("negated").alias("dn"), "conflict", premises.alias("premises"))

    def decided(rows: DataFrame, *keys: str) -> DataFrame:
        hit = rows.join(d, ["subject", "predicate"]).where("do is null or object = do")
        told = F.min(F.struct(F.size("premises").alias("n"), "premises", "subject", "predicate", "do", "dn")).alias("m")
        g = hit.groupBy(*keys, "negated").agg(F.bool_or("conflict").alias("clash"), F.min("dn").alias("lo"), F.max("dn").alias("hi"), told)
        return g.where((~F.col("clash")) & (F.col("lo") == F.col("hi"))).select(*keys, (F.col("negated") == F.col("lo")).alias("holds"), F.col("m").alias("told"))

    found = decided(claims, "claim_id")
    if siblings is not None:
        others = claims.join(found.select("claim_id"), "claim_id", "left_anti").join(siblings.select(F.col("sense").alias("subject"), "sibling"), "subject").where("subject <> sibling")
        each = decided(others.drop("subject").withColumnRenamed("sibling", "subject"), "claim_id", "subject")
        voted = each.groupBy("claim_id").agg(F.bool_and("holds").alias("holds"), F.bool_or("holds").alias("any"), F.min_by("told", "subject").alias("told"))
        found = found.unionByName(voted.where("holds = any").select("claim_id", "holds", "told"))
    if closure is None or "origin" not in derived.columns:
        return found.select("claim_id", "holds", F.col("told.premises").alias("premises"))
    found = store(found)
    asked = found.select(F.col("claim_id").alias("id"), F.col("told.subject").alias("seed"), F.col("told.predicate").alias("predicate"), F.col("told.do").alias("object"), F.col("told.dn").alias("negated"))
    lines = derivations(asked, derived, closure).withColumnRenamed("id", "claim_id")
    return found.join(lines, "claim_id", "left").select("claim_id", "holds", "derivation", F.col("told.premises").alias("premises"))


def ground_isa(claims: DataFrame, subsumed: DataFrame, apart: DataFrame, closure: DataFrame | None = None) -> DataFrame:
    """(claim_id, holds, derivation, premises): true if subsumed, false if disjoint, else undecided; flipped by a negation. subsumed
    (subject, object, optional premises) and apart (subject, object); chains of classes need the closure."""
    more = ["premises"] if "premises" in subsumed.columns else []
    up = subsumed.select("subject", F.col("object").alias("predicate"), F.lit(True).alias("_up"), *more)
    no = apart.select("subject", F.col("object").alias("predicate"), F.lit(True).alias("_no"))
    rows = claims.join(up, ["subject", "predicate"], "left").join(no, ["subject", "predicate"], "left").where("_up or _no")
    chain = F.concat_ws(" is below ", "subject", "predicate")
    if closure is not None:
        rows = store(rows)
        chains = class_chains(rows.where("_up").select(F.col("subject").alias("seed"), F.col("predicate").alias("klass")), closure)
        rows = rows.join(chains.select(F.col("seed").alias("subject"), F.col("klass").alias("predicate"), "chain"), ["subject", "predicate"], "left")
        chain = F.coalesce(F.col("chain"), chain)
    value = F.when(F.col("_up"), True).otherwise(False)
    said = F.when(F.col("_up"), _line(F.lit("subsumed:"), chain)).otherwise(_line(F.lit("refuted:"), "subject", F.lit("is disjoint from"), "predicate"))
    return rows.select("claim_id", (value != F.col("negated")).alias("holds"), said.alias("derivation"), *more)


def definition_rung(claims: DataFrame, best: DataFrame, floor: float = 0.85) -> DataFrame:
    """(claim_id, holds, derivation): claims that are not negated and are as near as the floor to a definition (claim_id, sim) hold;
    nothing is refuted."""
    near = best.groupBy("claim_id").agg(F.max("sim").alias("sim")).where(F.col("sim") >= floor)
    return claims.where("not negated").join(near, "claim_id").select("claim_id", F.lit(True).alias("holds"), _line(F.lit("as near as"), F.round("sim", 2).cast("string"), F.lit("to a definition")).alias("derivation"))


def evaluate(claims: DataFrame, rungs: list[tuple[str, DataFrame]], contradictory: DataFrame | None = None) -> DataFrame:
    """(claim_id, truth, status, rung, missing, derivation, premises): the first rung (name, (claim_id, holds, optional derivation
    and premises)) that decides, with the lines of its proof and the sorted ids of what it rests on.

    Claims in `contradictory` (claim_id) are false and inconsistent before anything else. A claim with a modal is a possibility, which no rung
    decides. Undecided claims are neutral and insufficient; missing says why: `modal`, `unknown words` or `no ground`. Optional
    columns of claims: modal, unknown.
    """
    has = lambda c, kind: F.col(c) if c in claims.columns else F.lit(None).cast(kind)
    rows = claims.select("claim_id", has("modal", "string").isNotNull().alias("modal"), F.coalesce(has("unknown", "boolean"), F.lit(False)).alias("unknown"))
    for i, (_, r) in enumerate(rungs):
        rows = rows.join(_grounded(r).select("claim_id", F.col("holds").alias(f"_{i}"), F.struct(*GROUND).alias(f"_g{i}")), "claim_id", "left")
    if contradictory is None:
        rows = rows.withColumn("_no", F.lit(False))
    else:
        rows = rows.join(contradictory.select("claim_id", F.lit(True).alias("_no")).distinct(), "claim_id", "left").withColumn("_no", F.coalesce("_no", F.lit(False)))
    decided = F.when(~F.col("modal"), F.coalesce(*[F.col(f"_{i}") for i in range(len(rungs))]))
    rung = F.when(~F.col("modal") & ~F.col("_no"), F.coalesce(*[F.when(F.col(f"_{i}").isNotNull(), F.lit(n)) for i, (n, _) in enumerate(rungs)]))
    ground = F.coalesce(*[F.when(F.col(f"_{i}").isNotNull(), F.col(f"_g{i}")) for i in range(len(rungs))])
    rows = rows.withColumns({"holds": decided, "rung": rung, "ground": ground})
    truth = F.when(F.col("_no"), 0.0).when(F.col("holds"), 1.0).when(~F.col("holds"), 0.0).otherwise(0.5)
    status = F.when(F.col("_no"), "inconsistent").when(F.col("holds").isNull(), "insufficient").otherwise("resolved")
    missing = F.when((status == "insufficient"), F.when(F.col("modal"), "modal").when(F.col("unknown"), "unknown words").otherwise("no ground"))
    lines = lambda c: F.when(F.col("rung").isNotNull(), F.col(f"ground.{c}")).otherwise(F.array().cast("array<string>"))
    return rows.select("claim_id", truth.alias("truth"), status.alias("status"), "rung", missing.alias("missing"), lines("derivation").alias("derivation"), F.array_sort(lines("premises")).alias("premises"))


def answer_polar(verdicts: DataFrame, trust: float = 1.0, high: float = 0.85, low: float = 0.15, direct: DataFrame | None = None, proved: DataFrame | None = None) -> DataFrame:
    """(claim_id, answer, confidence): inconsistent is no; beyond the bands yes or no by premise trust; else what a direct fact (claim_id,
    holds, trust) says, by its trust; else a proof by contradiction (claim_id, proved), by premise trust; else unknown."""
    rows = verdicts
    rows = rows.withColumns({"_d": F.lit(None).cast("boolean"), "_t": F.lit(None).cast("double")}) if direct is None else rows.join(direct.select("claim_id", F.col("holds").alias("_d"), F.col("trust").alias("_t")), "claim_id", "left")
    rows = rows.withColumn("_p", F.lit(None).cast("boolean")) if proved is None else rows.join(proved.select("claim_id", F.col("proved").alias("_p")), "claim_id", "left")
    bad = F.col("status") == "inconsistent"
    banded = F.when(F.col("truth") > high, True).when(F.col("truth") < low, False)
    says = F.coalesce(banded, "_d", "_p")
    sure = F.when(banded.isNotNull(), F.lit(trust)).when(F.col("_d").isNotNull(), F.col("_t")).when(F.col("_p").isNotNull(), F.lit(trust)).otherwise(0.5)
    return rows.select("claim_id", F.when(bad, "no").when(says, "yes").when(~says, "no").otherwise("unknown").alias("answer"), F.when(bad, 1.0).otherwise(sure).alias("confidence"))


def answer_what(questions: DataFrame, edges: DataFrame, memberships: DataFrame) -> DataFrame:
    """(question_id, answer, confidence): the first direct parent (0.9), else a class of the individual (0.7), else unknown (0.3)."""
    e = edges.groupBy(F.col("child").alias("subject")).agg(F.min("parent").alias("a"))
    m = memberships.where("not negated").groupBy(F.col("seed").alias("subject")).agg(F.min("klass").alias("b"))
    rows = questions.join(e, "subject", "left").join(m, "subject", "left")
    return rows.select("question_id", F.coalesce("a", "b", F.lit("unknown")).alias("answer"), F.when(F.col("a").isNotNull(), 0.9).when(F.col("b").isNotNull(), 0.7).otherwise(0.3).alias("confidence"))


def answer_who(questions: DataFrame, properties: DataFrame) -> DataFrame:
    """(question_id, answer): the first stored subject with the predicate."""
    return questions.join(properties.where("not negated").groupBy("predicate").agg(F.min(F.struct("fact_id", "seed")).alias("m")), "predicate", "left").select("question_id", F.col("m.seed").alias("answer"))


def answer_object(questions: DataFrame, properties: DataFrame) -> DataFrame:
    """(question_id, answer): the object of the first fact of the same subject and predicate lemma."""
    p = properties.where("not negated and object is not null").select(F.col("seed").alias("subject"), _lemma(F.col("predicate")).alias("lemma"), "fact_id", "object")
    first = p.groupBy("subject", "lemma").agg(F.min(F.struct("fact_id", "object")).alias("m"))
    return questions.withColumn("lemma", _lemma(F.col("predicate"))).join(first, ["subject", "lemma"], "left").select("question_id", F.col("m.object").alias("answer"))


def answer_why(questions: DataFrame, derived: DataFrame) -> DataFrame:
    """(question_id, answer): the premises of the conclusion asked about, in order."""
    d = derived.select(F.col("seed").alias("subject"), "predicate", F.array_join("premises", "; ").alias("answer"))
    return questions.join(d.groupBy("subject", "predicate").agg(F.min("answer").alias("answer")), ["subject", "predicate"], "left").select("question_id", "answer")


def answer_where(questions: DataFrame, parents: DataFrame, properties: DataFrame) -> DataFrame:
    """(question_id, answer, confidence): a place's container (0.9), else the first place (`...@place`) among its facts' objects (0.7)."""
    p = parents.select(F.col("uid").alias("subject"), F.col("parent").alias("a"))
    f = properties.where(F.col("object").endswith("@place")).groupBy(F.col("seed").alias("subject")).agg(F.min("object").alias("b"))
    rows = questions.join(p, "subject", "left").join(f, "subject", "left")
    return rows.select("question_id", F.coalesce("a", "b").alias("answer"), F.when(F.col("a").isNotNull(), 0.9).when(F.col("b").isNotNull(), 0.7).otherwise(0.3).alias("confidence"))
