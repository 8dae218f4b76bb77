"""Contradictions inside a statement, and between statements of one speaker.

A leaf says something about its claim (subject, predicate, direct) by its corner of the square of opposition, and so clashes
with what others can say about it. Both are lists of tokens, so conflicts are equi-joins and array intersections.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.fuzzy import fold_step
from lorekeep.runtime import cut, store

# What cannot hold together on one claim (T and F: a crisp claim and its denial), and statements of more atoms abstain.
CLASHES = {"A": ("O", "E"), "E": ("I", "A"), "I": ("E",), "O": ("A",), "T": ("F",), "F": ("T",)}
MOST_ATOMS = 16


def _strings(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def coded(leaves: DataFrame, antonyms: DataFrame | None = None) -> DataFrame:
    """The leaves with `key`, `says` and `clashes`.

    leaves (subject, predicate, direct, corner, negated, unknown, ...); antonyms (a, b) read both ways. Unknown words and possibilities
    say nothing. Antonyms clash if both claims are strong (all, none or crisp) and not negated.
    """
    key = F.concat_ws("|", *[F.coalesce(c, F.lit("~")) for c in ("subject", "predicate", "direct")])
    code = F.when(F.col("unknown") | (F.col("corner") == "MODAL"), F.lit(None)).when(F.col("corner") == "CRISP", F.when(F.col("negated"), "F").otherwise("T")).otherwise(F.col("corner"))
    rows = leaves.withColumns({"key": key, "code": code})
    if antonyms is None:
        rows = rows.withColumn("others", F.array().cast("array<string>"))
    else:
        both = antonyms.select("a", "b").unionByName(antonyms.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rows = rows.join(store(both.groupBy(F.col("a").alias("predicate")).agg(F.collect_set("b").alias("others"))), "predicate", "left")
    token = lambda c: F.concat_ws("#", "key", c)
    claim = lambda p: F.concat(F.col("subject"), F.lit("|"), p, F.lit("#claim"))
    strong = F.col("code").isin("A", "E", "T") & ~F.col("negated") & F.col("subject").isNotNull() & F.col("predicate").isNotNull()
    against = reduce(lambda w, kv: w.when(F.col("code") == kv[0], F.array(*[token(F.lit(c)) for c in kv[1]])), CLASHES.items(), F)
    says = F.concat(F.when(F.col("code").isNotNull(), F.array(token(F.col("code")))).otherwise(_strings(F.lit(None).cast("array<string>"))), F.when(strong, F.array(claim(F.col("predicate")))).otherwise(_strings(F.lit(None).cast("array<string>"))))
    clashes = F.concat(_strings(against), F.when(strong, F.transform(_strings(F.col("others")), claim)).otherwise(_strings(F.lit(None).cast("array<string>"))))
    return rows.withColumns({"says": says, "clashes": clashes}).drop("others")


def _atoms(rows: DataFrame, unknown: Column) -> DataFrame:
    """Coded leaves with `atom`: a claim at one corner; what is unknown is an atom of its own, named so."""
    claim = F.when(F.col("code").isin("T", "F"), F.col("key")).otherwise(F.concat_ws("#", "key", "code"))
    return rows.withColumn("atom", F.when(F.col("code").isNull(), F.concat(F.lit("@"), unknown)).otherwise(claim))


def _leaves(rows: DataFrame, by: str) -> DataFrame:
    """(by, l): the leaves of each statement in order."""
    leaf = F.struct("pos", "op", "attitude", "negated", "reflexive", "atom", "says", "clashes")
    return rows.groupBy(by).agg(F.array_sort(F.collect_list(leaf)).alias("l"))


def _parts(packed: DataFrame) -> DataFrame:
    """With `free` (leaves of `l` that are no identities), `atoms` and `reps` (the first leaf of each atom stands for it)."""
    packed = packed.withColumn("free", F.filter("l", lambda x: ~x["reflexive"])).withColumn("atoms", F.array_distinct(F.transform("free", lambda x: x["atom"])))
    return packed.withColumn("reps", F.transform("atoms", lambda a: F.get(F.filter("free", lambda x: x["atom"] == a), F.lit(0))))


def _listed(c: str) -> Column:
    return F.flatten(F.transform("free", lambda x: x[c]))


def _mutex() -> Column:
    """Pairs of atoms (i, j) whose first leaves clash: they are not true together."""

    def pairs(r: Column, i: Column) -> Column:
        each = F.transform("reps", lambda s, j: F.struct(i.alias("i"), j.alias("j"), F.arrays_overlap(r["says"], s["clashes"]).alias("c")))
        return F.transform(F.filter(each, lambda p: p["c"] & (p["i"] < p["j"])), lambda p: F.struct(p["i"].alias("i"), p["j"].alias("j")))

    return F.flatten(F.transform("reps", pairs))


def _named(x: Column) -> Column:
    """Does negation not turn this leaf's atom round?"""
    return F.startswith(x["atom"], F.lit("@")) | F.contains(x["atom"], F.lit("#"))


def _told(x: Column) -> Column:
    at = (F.array_position("atoms", x["atom"]) - 1).cast("int")
    same = _named(x) | (x["negated"] == F.get("reps", at)["negated"])
    fixed = F.when(x["reflexive"], F.when(x["negated"], 0.0).otherwise(1.0))
    return F.struct(x["op"].alias("op"), x["attitude"].alias("attitude"), fixed.alias("fixed"), at.alias("at"), same.alias("same"))


def _never_true(packed: DataFrame, keys: list[str]) -> DataFrame:
    """The keys whose `statements` (arrays of leaves) cannot all be true at once.

    If all fold by AND without attitudes, a clash of two leaves or a denied identity does it; else they are folded for every 0/1 assignment
    that no clash rules out. More than 16 atoms abstain.
    """
    packed = _parts(packed.withColumn("l", F.flatten("statements"))).where(F.size("atoms") <= MOST_ATOMS)
    plain = F.forall("l", lambda x: (x["op"] == "AND") & x["attitude"].isNull())
    denied = F.exists("l", lambda x: x["reflexive"] & x["negated"])
    simple = packed.where(plain & (denied | F.arrays_overlap(_listed("says"), _listed("clashes")))).select(*keys)
    every_told = F.transform("statements", lambda st: F.transform(st, _told))
    mixed = packed.where(~plain).select(*keys, F.size("atoms").alias("k"), _mutex().alias("mutex"), every_told.alias("told"))
    mixed = cut(mixed)  # else the optimizer writes these columns into the filter below, which would compute them anew for every assignment
    bit = lambda m, i: F.bit_get(m, i) == 1

    def truth(m: Column, x: Column) -> Column:
        t = F.coalesce(x["fixed"], F.when(bit(m, x["at"]) == x["same"], 1.0).otherwise(0.0))
        return F.when(x["attitude"].isNotNull(), 0.5 + (t - 0.5) * x["attitude"]).otherwise(t)

    def folded(m: Column, st: Column) -> Column:
        head = F.get(st, F.lit(0))
        start = F.when(head["op"] == "NOT", 1.0 - truth(m, head)).otherwise(truth(m, head))
        return F.aggregate(F.slice(st, 2, F.size(st)), start, lambda acc, x: fold_step(x["op"], acc, truth(m, x)))

    allowed = lambda m: F.forall("mutex", lambda p: ~(bit(m, p["i"]) & bit(m, p["j"])))
    every = F.sequence(F.lit(0), (F.pow(F.lit(2.0), F.col("k")) - 1).cast("int"))
    holds = lambda m: allowed(m) & F.forall("told", lambda st: folded(m, st) > 1e-9)
    return simple.unionByName(mixed.where(~F.exists(every, holds)).select(*keys))


def contradictions(leaves: DataFrame, antonyms: DataFrame | None = None) -> DataFrame:
    """(stmt_id): statements that are false whatever their atoms are.

    leaves (stmt_id, pos, op, attitude, subject, predicate, direct, corner, negated, unknown, reflexive). An atom is a claim at one corner;
    an unknown word or a possibility is an atom of its own; a thing's identity with itself is true. If all fold by AND without attitudes, a
    clash of two leaves or a denied identity does it; else the statement is folded for every 0/1 assignment that no clash rules out.
    Statements of more than 16 atoms abstain.
    """
    packed = _leaves(_atoms(coded(leaves, antonyms), F.col("pos").cast("string")), "stmt_id")
    return _never_true(packed.select("stmt_id", F.array("l").alias("statements")), ["stmt_id"])


def _numbered(statements: DataFrame) -> DataFrame:
    """(id, speaker, n): statements (id, speaker, us) numbered from 1 by time. Sorted in ranges, so a speaker is as many tasks as they fill."""
    parts = int(statements.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = cut(statements.where("speaker is not null").repartitionByRange(parts, "speaker", "us", "id").withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("speaker").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = spread.groupBy("speaker", "part").agg(F.count("*").alias("c")).select("speaker", "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("off"))
    here = F.row_number().over(Window.partitionBy("part", "speaker").orderBy("us", "id"))
    return spread.withColumn("n", here).join(counts, ["speaker", "part"]).select("id", "speaker", (F.col("n") + F.col("off")).alias("n"))


# Kinds of links: 0 and 1 one atom, of equal or other negation (from 4 on one of them is null), and
_REPS, _LEAVES = 2, 3  # a clash of the first leaves of two atoms, or of leaves of theirs that are not both first


def _shaped(packed: DataFrame) -> DataFrame:
    """(id, l, shape, says, clashes) of statements of at most 16 atoms.

    The shape is all that the fold of a statement depends on, whatever its atoms are called. says and clashes (named, token, at, rep, neg) are what
    its atoms meet those of other statements by: their names (named), and what each leaf says or clashes with.
    """
    packed = _parts(packed).where(F.size("atoms") <= MOST_ATOMS)

    def leaf(x: Column) -> Column:
        raw = F.when(F.get("reps", (F.array_position("atoms", x["atom"]) - 1).cast("int"))["negated"].isNull(), x["negated"])
        return F.struct(_told(x).alias("t"), raw.alias("raw"))

    def tokens(c: str) -> Column:
        def of(x: Column, i: Column) -> Column:
            at = (F.array_position("atoms", x["atom"]) - 1).cast("int")
            rep = F.array_position(F.transform("free", lambda y: y["atom"]), x["atom"]) - 1 == i
            neg = F.when(_named(x), 0).otherwise(F.coalesce(x["negated"].cast("int"), F.lit(2)))
            token = lambda named, t: F.struct(named.alias("named"), t.alias("token"), at.alias("at"), rep.alias("rep"), neg.alias("neg"))
            meets = F.transform(x[c], lambda t: token(F.lit(False), t))
            return F.when(rep & (F.size(x["says"]) > 0), F.array_append(meets, token(F.lit(True), x["atom"]))).otherwise(meets)

        return F.array_distinct(F.flatten(F.transform("free", of)))

    clash = F.arrays_overlap(_listed("says"), _listed("clashes"))
    shape = F.to_json(F.struct(F.transform("l", leaf).alias("l"), _mutex().alias("mutex"), clash.alias("clash")))
    return packed.select("id", "l", shape.alias("shape"), tokens("says").alias("says"), tokens("clashes").alias("clashes"))


def cross_item_mixed(leaves: DataFrame, k: int = 25, antonyms: DataFrame | None = None) -> DataFrame:
    """(id, other): the newest of a speaker's k statements before one that cannot be true together with it; neither contradicts itself.

    leaves (id, speaker, us, pos, op, attitude, subject, predicate, direct, corner, negated, unknown, reflexive); any operators. Only two
    statements that share an atom or clash can be at odds; these meet by equi-joins within blocks of k statements, at most k a statement.
    What decides a pair is the shapes of both and the links between their atoms: one pair of each such pattern is decided, over the union of its
    atoms, each statement folded by itself, and so is one statement of each shape. Unions of more than 16 atoms abstain, as do
    statements without speaker.
    """
    rows = _atoms(coded(leaves, antonyms), F.concat_ws("-", F.col("id").cast("string"), F.col("pos").cast("string")))
    packed = store(_shaped(_leaves(rows, "id")))
    shapes = store(packed.groupBy("shape").agg(F.min("id").alias("sid")))
    own = _never_true(shapes.join(packed.select(F.col("id").alias("sid"), "l"), "sid").select("sid", F.array("l").alias("statements")), ["sid"])
    sound = store(shapes.join(own, "sid", "left_anti"))
    numbered = _numbered(leaves.select("id", "speaker", "us").distinct()).withColumn("block", F.floor(F.col("n") / k))
    numbered = store(numbered.join(packed.join(sound, "shape").select("id", "sid", "says", "clashes"), "id"))
    new = numbered.withColumn("block", F.explode(F.array("block", F.col("block") - 1))).select("id", "speaker", "n", "sid", "block", F.inline("says"))
    old = numbered.select(F.col("id").alias("other"), "speaker", F.col("n").alias("m"), F.col("sid").alias("old"), "block", F.inline("clashes"))
    old = old.withColumnsRenamed({"at": "_at", "rep": "_rep", "neg": "_neg"})
    met = new.join(old, ["speaker", "block", "named", "token"]).where((F.col("m") < F.col("n")) & (F.col("m") >= F.col("n") - k))
    turned = F.when((F.col("neg") < 2) & (F.col("_neg") < 2), (F.col("neg") != F.col("_neg")).cast("int")).otherwise(4 + 3 * F.col("neg") + F.col("_neg"))
    kind = F.when(F.col("named"), turned).when(F.col("rep") & F.col("_rep"), _REPS).otherwise(_LEAVES)
    link = (F.col("at") * MOST_ATOMS + F.col("_at")) * 16 + kind
    met = store(met.groupBy("id", "other", "m", "sid", "old").agg(F.array_sort(F.collect_set(link)).alias("links")))
    pattern = ["sid", "old", "links"]
    one = met.select("id", "other", *pattern).dropDuplicates(pattern)
    both = one.join(packed.select("id", "l"), "id").join(packed.select(F.col("id").alias("other"), F.col("l").alias("_l")), "other")
    odd = _never_true(store(both.select(*pattern, F.array("l", "_l").alias("statements"))), pattern)
    return met.join(odd, pattern).groupBy("id").agg(F.max(F.struct("m", "other"))["other"].alias("other"))


def cross_item_conflict(leaves: DataFrame, k: int = 25, antonyms: DataFrame | None = None) -> DataFrame:
    """(id, other): the newest of a speaker's k statements before one that contradicts it; neither contradicts itself.

    leaves (id, speaker, us, subject, predicate, direct, corner, negated, unknown) of conjoined statements. Statements are numbered by
    speaker and dealt into blocks of k, so a leaf meets only leaves of its own or the block before that say what it clashes with.
    """
    rows = coded(leaves, antonyms)
    own = rows.groupBy("id").agg(F.flatten(F.collect_list("says")).alias("s"), F.flatten(F.collect_list("clashes")).alias("c")).where(F.arrays_overlap("s", "c")).select("id")
    numbered = _numbered(rows.select("id", "speaker", "us").distinct())
    sound = rows.join(own, "id", "left_anti").select("id", "says", "clashes").join(numbered.select("id", "speaker", "n"), "id").withColumn("block", F.floor(F.col("n") / k))
    near = sound.withColumn("block", F.explode(F.array("block", F.col("block") - 1)))
    new = near.select("id", "speaker", "n", "block", F.explode("clashes").alias("token"))
    old = sound.select(F.col("id").alias("other"), "speaker", F.col("n").alias("m"), "block", F.explode("says").alias("token"))
    met = new.join(old, ["speaker", "block", "token"]).where((F.col("m") < F.col("n")) & (F.col("m") >= F.col("n") - k))
    return met.groupBy("id").agg(F.max(F.struct("m", "other"))["other"].alias("other"))
