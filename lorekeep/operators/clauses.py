"""Predicates, keys and projections on clause rows (schemas.DDL["clauses"])."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Quantifiers that make a claim negative.
NEGATIVE = ("negative", "negated_universal")


def _nonempty(c: Column) -> Column:
    return F.when(c != "", c)


def explode_leaves(statements: DataFrame) -> DataFrame:
    """(stmt_id, pos, leaf.*) in order, from statements that hold their leaves as array<struct>."""
    return statements.select("stmt_id", F.posexplode("leaves").alias("pos", "leaf")).select("stmt_id", "pos", "leaf.*")


def is_asserted(clauses: DataFrame) -> DataFrame:
    """(stmt_id, asserted): every node folds with AND and none has an attitude."""
    return clauses.groupBy("stmt_id").agg(F.bool_and((F.col("op") == "AND") & F.col("attitude").isNull()).alias("asserted"))


def is_crisp() -> Column:
    return F.coalesce(F.col("modal"), F.lit("")) == ""


def is_question(threshold: float = 0.999) -> Column:
    return (F.col("dubitative") >= threshold) | F.col("wh_role").isNotNull()


def is_private(chat: Column, floor: float = 0.95) -> Column:
    return chat & (F.col("directedness") >= floor)


def role_key(role: str) -> Column:
    """The identity in the role, else its sense."""
    return F.coalesce(_nonempty(F.try_element_at("identities", F.lit(role))), F.try_element_at("senses", F.lit(role)))


def claim_key() -> Column:
    """(subject, predicate, direct) of a claim; null where subject or predicate is missing."""
    s, p, d = role_key("subject"), role_key("predicate"), role_key("direct")
    return F.when(s.isNotNull() & p.isNotNull(), F.struct(s.alias("subject"), p.alias("predicate"), d.alias("direct")))


def negative_quantifier() -> Column:
    return F.coalesce(F.col("quantifier").isin(*NEGATIVE), F.lit(False))


def net_negated() -> Column:
    return F.col("negated") != negative_quantifier()


def net_key(clauses: DataFrame) -> DataFrame:
    """(stmt_id, pos, subject, predicate, direct, net) of the matchable claims."""
    return clauses.select("stmt_id", "pos", claim_key().alias("key"), net_negated().alias("net")).where("key is not null").select("stmt_id", "pos", "key.*", "net")


def conclusion_key(clauses: DataFrame) -> DataFrame:
    """(stmt_id, key): hash of the set of (subject, predicate, direct, negated, is a negated universal); order and repeats don't matter."""
    part = F.concat_ws("|", *[F.coalesce(role_key(r), F.lit("~")) for r in ("subject", "predicate", "direct")], F.col("negated").cast("string"), F.coalesce(F.col("quantifier") == "negated_universal", F.lit(False)).cast("string"))
    return clauses.groupBy("stmt_id").agg(F.md5(F.array_join(F.array_sort(F.collect_set(part)), ";")).alias("key"))


def statement_senses(clauses: DataFrame) -> DataFrame:
    """(stmt_id, senses): sorted distinct senses of all roles and leaves."""
    return clauses.groupBy("stmt_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.map_values("senses"))))).alias("senses"))


def statement_digest(clauses: DataFrame) -> DataFrame:
    """(stmt_id, digest): one line of text for a statement, the same on every run."""
    leaf = F.concat_ws(" ", F.col("op"), F.when(F.col("negated"), F.lit("not")), F.col("quantifier"), *[F.coalesce(role_key(r), F.lit("-")) for r in ("subject", "predicate", "direct")])
    return clauses.groupBy("stmt_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", leaf.alias("leaf")))), lambda x: x["leaf"]), " / ").alias("digest"))


def leaf_sound() -> Column:
    """Known words, a subject, a predicate (unless it is asked for) that is neither the subject nor a bare copula."""
    s, p = role_key("subject"), F.try_element_at("senses", F.lit("predicate"))
    return ~F.coalesce(F.col("unknown"), F.lit(False)) & s.isNotNull() & F.when(p.isNull(), F.col("wh_role").isNotNull()).otherwise((s != p) & (p != "be.v.01"))


def stumbles(clauses: DataFrame) -> DataFrame:
    return clauses.groupBy("stmt_id").agg((~F.bool_and(leaf_sound())).alias("stumbles"))


def sense_parts(sense: Column) -> Column:
    """(lemma, pos, nr) of `word.pos.NN`; a bad number is null and sorts last."""
    part = lambda i: F.regexp_extract(sense, r"^(.*)\.([a-z])\.([^.]*)$", i)
    return F.struct(part(1).alias("lemma"), part(2).alias("pos"), F.coalesce(part(3).try_cast("int"), F.lit(2147483647)).alias("nr"))


def mod_senses(prefix: str, most: int = 16) -> Column:
    """Ordered modifiers prefix0, prefix1, ... of the senses, up to the first gap."""
    found = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.try_element_at("senses", F.concat(F.lit(prefix), i.cast("string"))))
    gap = F.array_position(F.transform(found, lambda x: x.isNull()), True)
    return F.slice(found, 1, F.when(gap > 0, gap.cast("int") - 1).otherwise(most))


def role_pairs(clauses: DataFrame, containers: tuple[str, ...] = ("in", "within", "inside", "on", "at")) -> DataFrame:
    """(stmt_id, pos, frame, subject, object): is_a pairs (noun predicate), part_of pairs (predicate part.n.01 or a direct of it) and containment (marker)."""
    sub, pred, direct = role_key("subject"), F.try_element_at("senses", F.lit("predicate")), role_key("direct")
    marker = F.try_element_at("markers", F.lit("direct"))
    frame = F.when(marker.isin(*containers) & direct.isNotNull(), "place").when((pred == "part.n.01") & direct.isNotNull(), "part_of").when(pred.rlike(r"\.n\."), "is_a")
    other = F.when(frame == "is_a", pred).otherwise(direct)
    return clauses.select("stmt_id", "pos", frame.alias("frame"), sub.alias("subject"), other.alias("object")).where("frame is not null and subject is not null")


def corner() -> Column:
    """Corner of the square of opposition: A, E, I, O, CRISP, or MODAL."""
    q, n = F.col("quantifier"), F.col("negated")
    either = lambda yes, no: F.when(n, yes).otherwise(no)
    return (
        F.when(~is_crisp(), "MODAL")
        .when(q == "universal", either("O", "A"))
        .when(q == "negated_universal", either("I", "O"))
        .when(q == "negative", either("I", "E"))
        .when(q.isin("existential", "indefinite"), either("O", "I"))
        .otherwise("CRISP")
    )


def split_conjuncts(clauses: DataFrame) -> DataFrame:
    """(stmt_id, part, pos): the leaves of each independent claim, by subject; cause leaves are in every part.

    A statement stays whole (part 0) when a leaf folds by other than AND, has an attitude or a
    contrast, asks, or has no subject, or when there is only one subject.
    """
    w = Window.partitionBy("stmt_id")
    sub = role_key("subject")
    cause = F.col("cause").isNotNull()
    plain = (F.col("op") == "AND") & F.col("attitude").isNull() & ~F.coalesce(F.col("contrast"), F.lit(False)) & ~is_question() & (cause | sub.isNotNull())
    rows = clauses.select("stmt_id", "pos", cause.alias("cause"), sub.alias("subject"), F.bool_and(plain).over(w).alias("plain"))
    first = F.min(F.when(~F.col("cause"), F.col("pos"))).over(Window.partitionBy("stmt_id", "subject"))
    rows = rows.withColumn("first", F.when(~F.col("cause"), first))
    groups = F.array_sort(F.collect_set("first").over(w))
    rows = rows.withColumn("groups", groups).withColumn("splits", F.col("plain") & (F.size("groups") >= 2))
    part = F.when(~F.col("splits"), F.array(F.lit(0))).when(F.col("cause"), F.sequence(F.lit(0), F.greatest(F.size("groups"), F.lit(1)) - 1)).otherwise(F.array((F.array_position("groups", F.col("first")) - 1).cast("int")))
    return rows.select("stmt_id", F.explode(part).alias("part"), "pos")


def verdict_token(status: Column, truth: Column, high: float = 0.85, low: float = 0.15) -> Column:
    return F.when(status == "inconsistent", "inconsistent").when(status == "insufficient", "unknown").when(truth > high, "true").when(truth < low, "false")


# Closed-class words and their quantifiers.
QUANTIFIERS = {
    "universal": ("all", "every", "each", "everything", "everyone", "everybody", "always"),
    "existential": ("some", "any", "several", "something", "someone", "somebody", "sometimes", "occasionally"),
    "indefinite": ("a", "an"),
    "negative": ("no", "none", "neither", "nothing", "nobody", "never"),
    "definite": ("the", "this", "that", "these", "those"),
    "generic": ("usually", "often", "normally", "generally", "typically"),
}
# What a question word asks for.
ASKS = {
    "subject": ("who", "whom", "which", "whose"),
    "predicate": ("what",),
    "location": ("where",),
    "time": ("when",),
    "manner": ("how",),
    "cause": ("why",),
}


def quantifier_of(words: DataFrame, column: str = "word") -> DataFrame:
    """The words with their quantifier, `generic` for those outside the closed class, and with what they ask for, if anything."""
    named = lambda table: F.coalesce(*[F.when(F.col(column).isin(*w), F.lit(k)) for k, w in table.items()])
    return words.withColumns({"quantifier": F.coalesce(named(QUANTIFIERS), F.lit("generic")), "asks": named(ASKS)})


def fold_truth(clauses: DataFrame) -> DataFrame:
    """(stmt_id, truth): left fold of the clause truths by their operators, attitudes drawing a truth towards 0.5."""
    from lorekeep.functions.fuzzy import fold_step

    t = F.when(F.col("attitude").isNotNull(), 0.5 + (F.col("truth") - 0.5) * F.col("attitude")).otherwise(F.col("truth"))
    leaves = F.array_sort(F.collect_list(F.struct("pos", "op", t.alias("t"))))
    rows = clauses.groupBy("stmt_id").agg(leaves.alias("leaves"))
    first = F.get("leaves", F.lit(0))
    seed = F.when(first["op"] == "NOT", 1.0 - first["t"]).otherwise(first["t"])
    return rows.select("stmt_id", F.coalesce(F.aggregate(F.slice("leaves", 2, F.size("leaves")), seed, lambda acc, x: fold_step(x["op"], acc, x["t"])), F.lit(0.5)).alias("truth"))


def operator_similarity(spark, steps: int = 21) -> DataFrame:
    """(op_a, op_b, similarity): 1 less the mean absolute difference on a grid; THAT is like itself only."""
    from lorekeep.functions.fuzzy import OPERATORS

    grid = spark.range(steps * steps).select((F.floor(F.col("id") / steps) / (steps - 1)).alias("a"), ((F.col("id") % steps) / (steps - 1)).alias("b"))
    values = grid.select(*[f(F.col("a"), F.col("b")).alias(n) for n, f in OPERATORS.items()])
    pairs = [(x, y) for x in OPERATORS for y in OPERATORS]
    means = values.agg(*[F.avg(F.abs(F.col(x) - F.col(y))).alias(f"{x}-{y}") for x, y in pairs])
    rows = means.select(F.explode(F.array(*[F.struct(F.lit(x).alias("op_a"), F.lit(y).alias("op_b"), F.round(1 - F.col(f"{x}-{y}"), 6).alias("similarity")) for x, y in pairs])).alias("r")).select("r.*")
    names = [*OPERATORS, "THAT"]
    that = [(x, "THAT", float(x == "THAT")) for x in names] + [("THAT", x, 0.0) for x in OPERATORS]
    return rows.unionByName(spark.createDataFrame(that, "op_a string, op_b string, similarity double"))
