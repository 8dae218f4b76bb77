"""Merkle manifest of a table: labels of nested intervals, containment joins for ancestors, interval differences for siblings.

Leaves have gapless ranks inside their tree. A node carries the interval [lo, hi) of the leaf ranks it covers, and the run of
nodes it was hashed from, each with its own interval. A node's parent is the node one level up whose interval contains its own:
intervals of one level are dealt to buckets by where they begin, so the join is on (tree, bucket) with the containment as its
condition. A leaf's siblings at a level are what its ancestor's interval has besides the part that contains the leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, read_table, shuffle_partitions

FANOUT = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "array<struct<lo:bigint,hi:bigint,digest:binary>>"


def digest(text: Column) -> Column:
    """SHA-256 as 32 bytes; hex() of it is what parents hash."""
    return F.unhex(F.sha2(text, 256))


def as_hex(column: Column) -> Column:
    return F.lower(F.hex(column))


def leaf_of(*columns: Column) -> Column:
    """Digest of a row: each column as `-` if null, else its UTF-8 byte count, `:` and its value (integers decimal)."""
    return digest(F.concat(*[F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in columns]))


def ranked(rows: DataFrame, group: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with `part` and `at`, places): rows in order of group and `order`, nulls first, and for each group and part of them
    the place of its first row (`first`), the rank of that row in its group (`before`) and the rows of the group (`n`).

    Rows are sorted in ranges, so neither a group nor repeats of one row need to fit in one task; only counts by group and range
    are put in a row. Ties have any order.
    """
    n = shuffle_partitions(rows.sparkSession)
    told_apart = rows.withColumn("row", F.monotonically_increasing_id())
    sorted_rows = told_apart.repartitionByRange(n, *group, *order, "row").sortWithinPartitions(*group, *order, "row").drop("row")
    placed = cut(sorted_rows.withColumn("at", F.monotonically_increasing_id())).withColumn("part", F.shiftright("at", 33))
    counts = placed.groupBy(*group, "part").agg(F.count("*").alias("c"), F.min("at").alias("first"))
    of_group = Window.partitionBy(*group)
    before = F.coalesce(F.sum("c").over(of_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed, counts.withColumn("before", before).withColumn("n", F.sum("c").over(of_group)).drop("c")


def with_rank(placed: DataFrame, places: DataFrame, group: list[str]) -> DataFrame:
    """Rows of ranked() with `rank` and the columns of places; the join is on group and range, so a large group is many keys."""
    p = places.select(*[F.col(g).alias(f"p_{g}") for g in group], F.col("part").alias("p_part"), *[c for c in places.columns if c not in (*group, "part")])
    on = placed["part"] == p["p_part"]
    for g in group:
        on = on & placed[g].eqNullSafe(p[f"p_{g}"])
    return placed.join(p, on).withColumn("rank", F.col("before") + F.col("at") - F.col("first")).drop("at", "part", "first", "before", "p_part", *[f"p_{g}" for g in group])


def width(n: Column, level: int) -> Column:
    """Nodes that a tree of n leaves has at a level."""
    return F.ceil(n / F.lit(FANOUT**level)) if level else n


def grow(leaves: DataFrame, most: int) -> list[DataFrame]:
    """Levels 1 and up of all trees, (tree, n, lo, hi, run, digest): every FANOUT neighbours become one node until a tree has one.

    leaves: (tree, n, lo, hi, digest), n leaves a tree and `most` at most. A level is an eighth of the one below.
    """
    levels, below, k = [], leaves, 0
    while FANOUT**k < most:
        k += 1
        parts = below.where(width(F.col("n"), k - 1) > 1).groupBy("tree", "n", (F.col("lo") - F.col("lo") % FANOUT**k).alias("start"))
        made = parts.agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "digest"))).alias("run"))
        below = cut(made.select("tree", "n", F.col("run")[0]["lo"].alias("lo"), F.element_at("run", -1)["hi"].alias("hi"), "run", digest(F.concat_ws("", F.transform("run", lambda c: as_hex(c["digest"])))).alias("digest")))
        levels.append(below)
    return levels


def roots(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(tree, digest) of each tree; a lone leaf is its own root."""
    found = leaves.where("n = 1").select("tree", "digest")
    for k, level in enumerate(levels, 1):
        found = found.unionByName(level.where(width(F.col("n"), k) == 1).select("tree", "digest"))
    return found


def climb(levels: list[DataFrame], above: DataFrame | None = None) -> DataFrame | None:
    """Level 1 with `path`: the runs that a leaf below passes on its way up, its own first, then what `above` (tree, path) adds.

    Runs are attached from the roots down, each level to the one below by containment in the parent's interval.
    """
    upper = None
    for k in range(len(levels), 0, -1):
        level = levels[k - 1].select("tree", "n", "lo", "hi", "run")
        own = lambda top: F.array(F.struct(F.lit(top).alias("top"), F.col("run")))
        tops = level.where(width(F.col("n"), k) == 1)
        if above is None:
            found = tops.select("tree", "lo", "hi", own(True).alias("path"))
        else:
            found = tops.join(above, "tree").select("tree", "lo", "hi", F.concat(own(False), "path").alias("path"))
        if upper is not None:
            found = found.unionByName(contained(level.where(width(F.col("n"), k) > 1), upper, k + 1).select("tree", "lo", "hi", F.concat(own(above is None), "path").alias("path")))
        upper = found
    return upper


def contained(nodes: DataFrame, parents: DataFrame, level: int) -> DataFrame:
    """Nodes (tree, lo, hi, ...) with the `path` of the parent of that level whose interval contains theirs."""
    p = parents.select(F.col("tree").alias("p_tree"), F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"), "path")
    bucket = F.col("lo") - F.col("lo") % FANOUT**level
    return nodes.join(p, (F.col("tree") == F.col("p_tree")) & (bucket == F.col("p_lo")) & (F.col("hi") <= F.col("p_hi"))).drop("p_tree", "p_lo", "p_hi")


def _inside(c: Column, run: Column) -> Column:
    """Whether a node of a run covers the leaf: runs of the tree of trees are in ranks of trees."""
    at = F.when(run["top"], F.col("tree")).otherwise(F.col("lo"))
    return (c["lo"] <= at) & (at < c["hi"])


def siblings(path: Column) -> Column:
    """Hex digests of the siblings along a path: what each run covers besides the part with the leaf."""
    return F.flatten(F.transform(path, lambda run: F.transform(F.filter(run["run"], lambda c: ~_inside(c, run)), lambda c: as_hex(c["digest"]))))


def fold(path: Column, leaf: Column) -> Column:
    """The root that follows from a leaf (hex) and the siblings along its path."""
    step = lambda h, run: F.sha2(F.concat_ws("", F.transform(run["run"], lambda c: F.when(_inside(c, run), h).otherwise(as_hex(c["digest"])))), 256)
    return F.aggregate(path, leaf, step)


def manifest(rows: DataFrame, group: str, order: str) -> DataFrame:
    """Each row of rows (group, order, leaf, ...) with tree, rank, subroot, root and path, all digests but in path as hex.

    A tree for each value of `group`, null first, and one above their roots. Nulls of `order` come first, ties in order of the leaf;
    repeated rows are leaves of their own. No rows give no rows. Other columns are kept; none may be named as one of those made here,
    nor `at`, `part`, `row`, `lo`, `hi`, `n`. The driver gets the number of trees, the leaves of the largest, and the root.
    """
    spark = rows.sparkSession
    placed, places = ranked(rows, [group], [order, "leaf"])
    trees, tree_places = ranked(places.select(group, "n").distinct(), [], [group, "n"])
    trees = cut(with_rank(trees, tree_places.withColumnRenamed("n", "trees"), []).select(group, "n", F.col("rank").alias("tree"), "trees"))
    most = trees.agg(F.max("n").alias("n"), F.max("trees").alias("trees")).first()
    t = trees.select(F.col(group).alias("t_group"), "tree")
    numbered = places.join(t, places[group].eqNullSafe(t["t_group"])).drop("t_group")
    leaves = cut(with_rank(placed, numbered, [group]).withColumn("lo", F.col("rank")).withColumn("hi", F.col("rank") + 1))
    nodes = leaves.select("tree", "n", "lo", "hi", F.col("leaf").alias("digest"))
    levels = grow(nodes, most["n"] or 0)
    subroots = cut(roots(nodes, levels))
    one = subroots.select(F.lit(0).cast("long").alias("tree"), F.lit(most["trees"] or 0).cast("long").alias("n"), F.col("tree").alias("lo"), (F.col("tree") + 1).alias("hi"), "digest")
    upper = grow(one, most["trees"] or 0)
    found = roots(one, upper).select(as_hex(F.col("digest")).alias("root")).first()
    nothing = F.from_json(F.lit("[]"), f"array<struct<top:boolean,run:{RUN}>>")
    chains = climb(upper)
    above = subroots.select("tree", nothing.alias("path")) if chains is None else contained(one, chains, 1).select(F.col("lo").alias("tree"), "path")
    paths = climb(levels, above)
    # Trees of one leaf have no level of their own; there are as many of those leaves as trees.
    result = leaves.where("n = 1").join(above, "tree")
    if paths is not None:
        result = contained(leaves.where("n > 1"), paths, 1).unionByName(result)
    first = F.get(F.filter("path", lambda run: run["top"]), F.lit(0))
    subroot = as_hex(F.get(F.filter(first["run"], lambda c: _inside(c, first)), F.lit(0))["digest"])
    root = F.lit(found["root"] if found else None).cast("string")
    return result.withColumn("root", root).withColumn("subroot", F.coalesce(subroot, root)).withColumn("leaf", as_hex(F.col("leaf")))


def op11_merkle(spark, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and whether its root follows from the text as found: where 3 divides
    the CRC-32 of the decimal doc_id, A-Z became lower case.

    Null columns are hashed as `-`, empty ones as `0:`. A document without doc_id is never tampered with and comes first in its tree; of
    equal doc_ids the smaller leaf does; repeated rows are returned each. An empty table gives an empty table, further
    columns are left out.
    """
    docs = read_table(spark, sf_dir, "documents")
    known = [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars")]
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    changed = F.when(tampered, leaf_of(*known, F.translate("text", UPPER, LOWER)))
    rows = docs.select("doc_id", "lang", leaf_of(*known, F.col("text")).alias("leaf"), changed.alias("changed"))
    made = manifest(rows, "lang", "doc_id")
    folded = fold(F.col("path"), F.coalesce(as_hex(F.col("changed")), F.col("leaf")))
    proof = F.sha2(F.concat_ws("", siblings(F.col("path"))), 256)
    result = made.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"), "rank")
    return result.withColumn("verified", F.col("folded_root") == F.col("root"))


OP11_SQL = f"""
WITH RECURSIVE field AS (
  SELECT doc_id, lang, text,
    coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
      || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head
  FROM documents),
crc AS (
  SELECT doc_id, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS crc
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)),
hashed AS (
  SELECT f.doc_id, lang, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
    CASE WHEN crc % 3 = 0 THEN sha256(head || coalesce(octet_length(encode(text)) || ':' || translate(text, '{UPPER}', '{LOWER}'), '-')) END AS changed
  FROM field f LEFT JOIN crc USING (doc_id)),
trees AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT lang FROM documents)),
leaves AS (
  SELECT doc_id, tree, leaf, changed, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank
  FROM hashed h JOIN trees t ON h.lang IS NOT DISTINCT FROM t.lang),
nodes AS (
  SELECT tree, 0 AS level, rank AS i, leaf AS digest FROM leaves
  UNION ALL
  SELECT tree, any_value(level) + 1, i // 8, sha256(string_agg(digest, '' ORDER BY i))
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS c FROM nodes) WHERE c > 1 GROUP BY tree, i // 8),
subroots AS (SELECT tree, max(level) AS height, arg_max(digest, level) AS digest FROM nodes GROUP BY tree),
tops AS (
  SELECT 0 AS level, tree AS i, digest FROM subroots
  UNION ALL
  SELECT any_value(level) + 1, i // 8, sha256(string_agg(digest, '' ORDER BY i))
  FROM (SELECT *, count(*) OVER () AS c FROM tops) WHERE c > 1 GROUP BY i // 8),
roots AS (SELECT max(level) AS height, arg_max(digest, level) AS root FROM tops),
up AS (
  SELECT l.tree, l.rank, n.level, n.i, n.digest
  FROM leaves l JOIN subroots s USING (tree) JOIN nodes n ON n.tree = l.tree AND n.level < s.height AND n.i // 8 = l.rank // (8 ** (n.level + 1))::BIGINT),
placed AS (
  SELECT tree, rank, level, i, digest, i = rank // (8 ** level)::BIGINT AS own FROM up
  UNION ALL
  SELECT l.tree, l.rank, s.height + t.level, t.i, t.digest, t.i = l.tree // (8 ** t.level)::BIGINT
  FROM leaves l JOIN subroots s USING (tree) CROSS JOIN roots r JOIN tops t ON t.level < r.height AND t.i // 8 = l.tree // (8 ** (t.level + 1))::BIGINT),
folded AS (
  SELECT tree, rank, 0 AS level, coalesce(changed, leaf) AS h FROM leaves
  UNION ALL
  SELECT f.tree, f.rank, any_value(f.level) + 1, sha256(string_agg(CASE WHEN p.own THEN f.h ELSE p.digest END, '' ORDER BY p.i))
  FROM folded f JOIN placed p ON p.tree = f.tree AND p.rank = f.rank AND p.level = f.level GROUP BY f.tree, f.rank),
proofs AS (SELECT tree, rank, sha256(coalesce(string_agg(digest, '' ORDER BY level, i) FILTER (WHERE NOT own), '')) AS proof_sha256 FROM placed GROUP BY tree, rank),
ends AS (SELECT tree, rank, arg_max(h, level) AS folded_root FROM folded GROUP BY tree, rank)
SELECT doc_id, leaf, s.digest AS subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, rank, folded_root = root AS verified
FROM leaves JOIN subroots s USING (tree) CROSS JOIN roots JOIN ends USING (tree, rank) LEFT JOIN proofs USING (tree, rank)"""
