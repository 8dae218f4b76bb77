"""Closure, containment and disjointness over relation edges (child, parent)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.runtime import store


def _marked(edges: DataFrame) -> DataFrame:
    """(child, parent, below, n): distinct edges, whether the child is a parent itself, and how many parents it has; one shuffle of the edges."""
    marks = edges.select("parent").distinct().select(F.col("parent").alias("child"), F.lit(None).cast(edges.schema["parent"].dataType).alias("parent"))
    rows = edges.unionByName(marks).repartition("child").distinct()
    of = Window.partitionBy("child")
    return rows.select("child", "parent", F.max(F.col("parent").isNull()).over(of).alias("below"), F.count("parent").over(of).alias("n")).where("parent is not null")


def _rounds(edges: DataFrame, max_depth: int) -> DataFrame:
    """(node, ancestor, path) of distinct edges: one join a round from the last round's frontier; the prefix of a smallest shortest
    path is itself smallest, so keeping one path per pair and round is exact."""
    frontier = store(edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.array("child", "parent").alias("path")))
    up = frontier.select(F.col("node").alias("child"), F.col("ancestor").alias("parent"))  # read again, not computed again
    rounds = [frontier]
    for _ in range(max_depth - 1):
        step = frontier.join(up, frontier["ancestor"] == up["child"]).where("parent <> node")
        step = step.groupBy("node", "parent").agg(F.min(F.concat("path", F.array("parent"))).alias("path")).withColumnRenamed("parent", "ancestor")
        found = reduce(DataFrame.unionByName, rounds).select("node", "ancestor")
        frontier = store(step.join(found, ["node", "ancestor"], "left_anti").select("node", "ancestor", "path"))
        if frontier.isEmpty():
            break
        rounds.append(frontier)
    return reduce(DataFrame.unionByName, rounds)


def _trees(layer: DataFrame, above: DataFrame | None, max_depth: int) -> DataFrame:
    """(node, tree) of nodes whose parents all have their trees in `above`, or no ancestors.

    A tree lists a node's ancestors (d, a) so that each follows those on its path. Of several parents that reach an ancestor the nearest has it, of
    those the smallest: all paths begin with the node, so the second name decides between paths of one length.
    """
    own = F.struct(F.lit(1).alias("d"), F.col("parent").alias("a"))
    if above is None:
        layer = layer.withColumn("tree", F.array(own))
    else:
        far = F.transform(F.filter("tree", lambda e: e["d"] < max_depth), lambda e: F.struct((e["d"] + 1).alias("d"), e["a"].alias("a")))
        layer = layer.join(above.withColumnRenamed("node", "parent"), "parent", "left").withColumn("tree", F.when(F.col("tree").isNull(), F.array(own)).otherwise(F.concat(F.array(own), far)))
    one = layer.where("n = 1").select(F.col("child").alias("node"), "tree")
    several = layer.where("n > 1").select("child", F.struct(F.transform("tree", lambda e: e["a"]).alias("a"), F.transform("tree", lambda e: e["d"]).alias("d")).alias("tree"))
    tagged = lambda t: F.transform(t["a"], lambda a, k: F.struct(a.alias("a"), F.get(t["d"], k).alias("d"), F.get(t["a"], F.lit(0)).alias("parent"), k.alias("k")))
    several = several.repartition("child").groupBy("child").agg(F.collect_list("tree").alias("trees"))  # a tree begins with the parent
    several = several.select("child", F.sort_array(F.flatten(F.transform("trees", tagged))).alias("all"))
    first = F.zip_with("all", F.concat(F.array(F.lit(None).cast(several.schema["all"].dataType.elementType)), F.slice("all", 1, F.size("all") - 1)), lambda x, y: F.when(y.isNull() | (x["a"] != y["a"]), F.struct(x["parent"], x["k"], x["d"].alias("d"), x["a"].alias("a"))))
    kept = F.transform(F.sort_array(F.filter(first, lambda x: x.isNotNull())), lambda x: F.struct(x["d"].alias("d"), x["a"].alias("a")))
    return one.unionByName(several.select(F.col("child").alias("node"), kept.alias("tree")))


def ancestors(edges: DataFrame, max_depth: int = 12) -> DataFrame:
    """(node, ancestor, path, depth): every node reached upwards, by the shortest path and among those the smallest.

    Nodes that are nobody's parent are set aside, layer by layer, as long as a layer has at least half of the edges left; what remains (chains, cycles) goes
    through rounds. Then each layer takes over its parents' ancestors as one row a node, so paths of the many nodes at the bottom are
    neither stored nor shuffled; they are listed last. Cycle-safe; a node is never its own ancestor.
    """
    rows, layers = store(_marked(edges.where("child <> parent").select("child", "parent"))), []
    while True:
        left, low = rows.agg(F.count("*"), F.count_if(~F.col("below"))).first()
        if not low or 2 * low < left:
            break
        layers.append(rows.where("not below"))
        rows = rows.where("below").select("child", "parent")
        if low == left:
            break
        rows = store(_marked(rows))
    parts, above = [], None
    if not layers or low < left:
        core = _rounds(rows, max_depth)
        parts.append(core.select("node", "ancestor", "path"))
        if layers:
            tree = F.sort_array(F.collect_list(F.struct("path", (F.size("path") - 1).alias("d"), F.col("ancestor").alias("a"))))
            above = store(core.groupBy("node").agg(F.transform(tree, lambda e: F.struct(e["d"].alias("d"), e["a"].alias("a"))).alias("tree")))
    for k, layer in enumerate(reversed(layers), 1):
        trees = _trees(layer, above, max_depth)
        if k < len(layers):
            trees = store(trees)
            above = trees if above is None else above.unionByName(trees)
        walk = F.aggregate("tree", F.array(F.array("node")), lambda paths, e: F.concat(paths, F.array(F.concat(F.slice(F.element_at(paths, -1), 1, e["d"]), F.array(e["a"])))))
        path = trees.select("node", F.explode(F.slice(walk, 2, F.size("tree"))).alias("path"))
        parts.append(path.select("node", F.element_at("path", -1).alias("ancestor"), "path"))
    return reduce(DataFrame.unionByName, parts).withColumn("depth", F.size("path") - 1)


def subsumes(pairs: DataFrame, closure: DataFrame) -> DataFrame:
    """Pairs (child, parent) with the path from child up to parent, null if there is none; a node subsumes itself."""
    reach = closure.select(F.col("node").alias("child"), F.col("ancestor").alias("parent"), "path")
    return pairs.join(reach, ["child", "parent"], "left").withColumn("path", F.when(F.col("child") == F.col("parent"), F.array("child")).otherwise(F.col("path")))


def part_of(pairs: DataFrame, closure: DataFrame) -> DataFrame:
    """Pairs (part, whole) with holds: true if whole is reached, false if part is reached from it, else null (absence never refutes)."""
    forward = closure.select(F.col("node").alias("part"), F.col("ancestor").alias("whole"), F.lit(True).alias("_yes"))
    back = closure.select(F.col("ancestor").alias("part"), F.col("node").alias("whole"), F.lit(True).alias("_no"))
    return pairs.join(forward, ["part", "whole"], "left").join(back, ["part", "whole"], "left").withColumn("holds", F.when(F.col("_yes"), True).when(F.col("_no"), False)).drop("_yes", "_no")


def anchored(closure: DataFrame, tiers: DataFrame) -> DataFrame:
    """(node, tier, anchor): the nearest anchor of each tier above a node, or the node itself."""
    up = closure.select("node", F.col("ancestor").alias("anchor"), "depth").unionByName(tiers.select(F.col("anchor").alias("node"), "anchor", F.lit(0).alias("depth")))
    near = up.join(tiers, "anchor")
    return near.groupBy("node", "tier").agg(F.min(F.struct("depth", "anchor")).alias("m")).select("node", "tier", F.col("m.anchor").alias("anchor"))


def disjoint(pairs: DataFrame, closure: DataFrame, tiers: DataFrame) -> DataFrame:
    """Pairs (a, b) with disjoint and the tier that tells: neither subsumes the other and at the finest tier that places both their anchors differ."""
    near = anchored(closure, tiers)
    both = pairs.join(near.select(F.col("node").alias("a"), "tier", F.col("anchor").alias("anchor_a")), "a").join(near.select(F.col("node").alias("b"), "tier", F.col("anchor").alias("anchor_b")), ["b", "tier"])
    finest = both.groupBy("a", "b").agg(F.max(F.struct("tier", "anchor_a", "anchor_b")).alias("m")).select("a", "b", "m.*")
    related = closure.select(F.col("node").alias("x"), F.col("ancestor").alias("y"))
    related = related.unionByName(related.select(F.col("y").alias("x"), F.col("x").alias("y"))).select(F.col("x").alias("a"), F.col("y").alias("b"), F.lit(True).alias("_rel"))
    out = pairs.join(finest, ["a", "b"], "left").join(related, ["a", "b"], "left")
    apart = F.col("_rel").isNull() & (F.col("a") != F.col("b")) & (F.col("anchor_a") != F.col("anchor_b"))
    return out.select("a", "b", F.coalesce(apart, F.lit(False)).alias("disjoint"), F.when(F.coalesce(apart, F.lit(False)), F.col("tier")).alias("tier"))


def union_tiers(bedrock: DataFrame, derived: DataFrame, in_memory: DataFrame) -> DataFrame:
    """(child, parent, tier): one edge set, each edge at its lowest tier."""
    parts = [df.select("child", "parent", F.lit(i).alias("tier")) for i, df in enumerate((bedrock, derived, in_memory))]
    return reduce(DataFrame.unionByName, parts).groupBy("child", "parent").agg(F.min("tier").alias("tier"))


def edge_key(child: Column, parent: Column) -> Column:
    return F.concat_ws("|", child, F.lit("is_a"), parent)


def edge_source(edges: DataFrame) -> DataFrame:
    """The edges with the premise key of those that are not bedrock."""
    return edges.withColumn("source", F.when(F.col("tier") > 0, edge_key(F.col("child"), F.col("parent"))))


def edge_trust(assertions: DataFrame, generic_cap: float = 0.7) -> DataFrame:
    """(key, trust) from (key, trust, precedence, generic): highest precedence, then highest trust; generic rules are capped."""
    capped = F.when(F.col("generic"), F.least("trust", F.lit(generic_cap))).otherwise(F.col("trust"))
    return assertions.groupBy("key").agg(F.max(F.struct("precedence", capped.alias("trust"))).alias("m")).select("key", F.col("m.trust").alias("trust"))


def edge_sources(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """(key, sources): every document that asserts an edge, with kind and readonly flag, in order of id."""
    told = edges.select(edge_key(F.col("child"), F.col("parent")).alias("key"), "source_id").join(docs, F.col("source_id") == F.col("id"))
    return told.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("id", "kind", "readonly"))).alias("sources"))


def path_premises(paths: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, ancestor, premises): keys of the edges that are not bedrock on a path."""
    step = paths.select("node", "ancestor", F.explode(F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("child"), F.slice("path", 2, F.size("path")).alias("parent"))).alias("e")).select("node", "ancestor", "e.*")
    return step.join(sources, ["child", "parent"], "left").groupBy("node", "ancestor").agg(F.array_sort(F.collect_set("source")).alias("premises"))


def place_contains(pairs: DataFrame, places: DataFrame) -> DataFrame:
    """Pairs (inner, outer) with contains: chains of places are complete, so two known unrelated places refute; an unknown one gives null."""
    p = places.select("uid", "path_admin", "path_geo", "parent_admin", "parent_geo", "physical_features")
    i, o = p.alias("i"), p.alias("o")
    rows = pairs.join(i, F.col("inner") == F.col("i.uid"), "left").join(o, F.col("outer") == F.col("o.uid"), "left")

    def inside(a: str, b: Column) -> Column:
        listed = [F.array_contains(F.coalesce(F.col(f"{a}.{c}"), F.array().cast("array<string>")), b) for c in ("path_admin", "path_geo", "physical_features")]
        return reduce(lambda x, y: x | y, listed) | F.coalesce(F.col(f"{a}.parent_admin") == b, F.lit(False)) | F.coalesce(F.col(f"{a}.parent_geo") == b, F.lit(False))

    known = F.col("i.uid").isNotNull() & F.col("o.uid").isNotNull()
    holds = F.when(~known, F.lit(None).cast("boolean")).when(F.col("inner") == F.col("outer"), True).when(inside("i", F.col("outer")), True).otherwise(False)
    return rows.select("inner", "outer", holds.alias("contains"))


def place_parent(places: DataFrame) -> DataFrame:
    """(uid, parent, chain): the immediate container, administrative before geographic."""
    admin, geo = F.when(F.col("parent_admin") != "", F.col("parent_admin")), F.when(F.col("parent_geo") != "", F.col("parent_geo"))
    return places.select("uid", F.coalesce(admin, geo).alias("parent"), F.when(admin.isNotNull(), "admin").when(geo.isNotNull(), "geo").alias("chain"))


def antonyms(edges: DataFrame) -> DataFrame:
    """(a, b): antonym edges read both ways."""
    pairs = edges.where("relation = 'antonym'").select(F.col("subject").alias("a"), F.col("object").alias("b"))
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def relation_union(edges: DataFrame, extra: DataFrame) -> DataFrame:
    """(subject, object): distinct objects of each subject over tiers."""
    return edges.select("subject", "object").unionByName(extra.select("subject", "object")).distinct()


def charitable_subsumes(pairs: DataFrame, siblings: DataFrame, closure: DataFrame) -> DataFrame:
    """Pairs (child, parent) with the senses that subsume: the exact pair, else the first of the sibling pairs by rank.

    siblings: (sense, sibling, rank); a sense's closure row is looked up by key, so the 12 x 12 choices never leave their pair.
    """
    own = siblings.select("sense", "sibling", "rank").unionByName(siblings.select("sense", F.col("sense").alias("sibling"), F.lit(0).alias("rank")).distinct())
    c = own.select(F.col("sense").alias("child"), F.col("sibling").alias("c"), F.col("rank").alias("i"))
    p = own.select(F.col("sense").alias("parent"), F.col("sibling").alias("p"), F.col("rank").alias("j"))
    tried = pairs.join(c, "child").join(p, "parent")
    exact = F.col("c") == F.col("p")
    reach = closure.select(F.col("node").alias("c"), F.col("ancestor").alias("p"), F.lit(True).alias("_up"))
    hits = tried.join(reach, ["c", "p"], "left").where(F.col("_up") | exact)
    best = hits.groupBy("child", "parent").agg(F.min(F.struct((F.col("i") + F.col("j") > 0).alias("far"), "i", "j", "c", "p")).alias("m"))
    return pairs.join(best, ["child", "parent"], "left").select("child", "parent", F.col("m.c").alias("child_sense"), F.col("m.p").alias("parent_sense"))


def _hang(jumps: DataFrame) -> DataFrame:
    """(id, to, w) of jumps, one an id, followed to a node without a jump of its own, with the steps to it.

    Pointer doubling: every round doubles the steps of a jump, so a chain of n takes log2(n) rounds. Jumps still open after as many
    steps as there are rows run into a cycle and lead nowhere.
    """
    more = jumps.select(F.col("id").alias("to"), F.lit(False).alias("done"))
    jumps = store(jumps.join(more, "to", "left").select("id", "to", "w", F.coalesce("done", F.lit(True)).alias("done")))
    ended, running, rows, steps = [jumps.where("done")], jumps.where("not done"), jumps.count(), 1
    while steps <= rows and not running.isEmpty():
        ahead = reduce(DataFrame.unionByName, [*ended, running]).select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("w").alias("_w"), F.col("done").alias("_done"))
        moved = store(running.drop("done").join(ahead, "to").select("id", F.col("_to").alias("to"), (F.col("w") + F.col("_w")).alias("w"), F.col("_done").alias("done")))
        ended.append(moved.where("done"))
        running, steps = moved.where("not done"), steps * 2
    return reduce(DataFrame.unionByName, ended).drop("done")


def revoke_cascade(theorems: DataFrame, premise_ids: DataFrame) -> DataFrame:
    """(id, round): active theorems that rest on the ids, directly or through others, however far; round is the least distance. Cycle-safe.

    Theorems that rest on one other theorem jump along it by doubling, so a chain of n takes log2(n) rounds. Those that rest on several
    are settled in rounds over what is left, as many as there are such theorems on a shortest path.
    """
    needs = store(theorems.where("not archived").select("id", F.explode("premises").alias("premise")).distinct())
    first = store(needs.join(premise_ids.select(F.col("id").alias("premise")), "premise", "left_semi").select("id").distinct())
    known = first.select("id", F.lit(1).cast("long").alias("round"))
    steps = needs.where("premise <> id").join(first, "id", "left_anti").join(needs.select(F.col("id").alias("premise")), "premise", "left_semi")
    steps = store(steps.withColumn("n", F.count("*").over(Window.partitionBy("id"))))
    hanging = _hang(steps.where("n = 1").select("id", F.col("premise").alias("to"), F.lit(1).cast("long").alias("w")))
    several = steps.where("n > 1")
    if not several.isEmpty():
        arcs = several.join(hanging.select(F.col("id").alias("premise"), "to", "w"), "premise", "left")
        arcs = store(arcs.groupBy(F.coalesce("to", "premise").alias("to"), "id").agg((F.min(F.coalesce("w", F.lit(0))) + 1).alias("w")))
        settled, frontier = known.limit(0), known
        while True:
            found = arcs.join(frontier.select(F.col("id").alias("to"), "round"), "to").groupBy("id").agg(F.min(F.col("round") + F.col("w")).alias("round"))
            better = found.join(settled.withColumnRenamed("round", "_round"), "id", "left").where("_round is null or round < _round")
            frontier = store(better.select("id", "round"))
            if frontier.isEmpty():
                break
            settled = store(settled.unionByName(frontier).groupBy("id").agg(F.min("round").alias("round")))
        known = known.unionByName(settled)
    far = hanging.join(known.select(F.col("id").alias("to"), "round"), "to").select("id", (F.col("round") + F.col("w")).alias("round"))
    return known.unionByName(far).select("id", F.col("round").cast("int").alias("round"))


def dependents(theorems: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, id): active theorems that rest on any of a root's ids, directly or through others, for all roots (root, id) at once.

    Theorems that no root hits and that rest on one other theorem hang on the first one below that is hit or rests on several, found once
    for all roots by doubling; only pairs of a root and one of the others go through rounds, until none is new. Cycle-safe; an id
    is not its own root's dependent.
    """
    needs = store(theorems.where("not archived").select("id", F.explode("premises").alias("premise")).distinct())
    known = store(needs.join(roots.select("root", F.col("id").alias("premise")).distinct(), "premise").select("root", "id").distinct())
    inner = needs.where("premise <> id").join(needs.select(F.col("id").alias("premise")).distinct(), "premise", "left_semi")
    inner = inner.withColumn("n", F.count("*").over(Window.partitionBy("id"))).join(known.select("id", F.lit(True).alias("hit")).distinct(), "id", "left")
    inner = store(inner)
    hanging = _hang(inner.where("n = 1 and hit is null").select("id", F.col("premise").alias("to"), F.lit(1).cast("long").alias("w")))
    rest = inner.where("n > 1 or hit").join(hanging.select(F.col("id").alias("premise"), "to"), "premise", "left")
    arcs = store(rest.select(F.coalesce("to", "premise").alias("to"), "id").distinct())
    frontier, rounds = known, [known]
    while True:
        found = frontier.withColumnRenamed("id", "to").join(arcs, "to").select("root", "id").distinct()
        frontier = store(found.join(reduce(DataFrame.unionByName, rounds), ["root", "id"], "left_anti"))
        if frontier.isEmpty():
            break
        rounds = [store(reduce(DataFrame.unionByName, [*rounds, frontier]))] if len(rounds) > 8 else [*rounds, frontier]
    held = reduce(DataFrame.unionByName, rounds)
    far = hanging.join(held.withColumnRenamed("id", "to"), "to").select("root", "id")
    own = roots.select("root", "id").distinct()
    return held.unionByName(far).distinct().join(own, ["root", "id"], "left_anti")


def postable_taint(theorems: DataFrame) -> DataFrame:
    """(id, postable): a conclusion is publishable only if it is itself and every theorem below it is."""
    tainted = theorems.where("not postable").select("id")
    below = revoke_cascade(theorems.withColumn("archived", F.lit(False)), tainted).select("id")
    bad = tainted.unionByName(below).distinct().withColumn("_bad", F.lit(True))
    return theorems.join(bad, "id", "left").select("id", F.col("_bad").isNull().alias("postable"))
