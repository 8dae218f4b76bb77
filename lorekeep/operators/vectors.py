"""Vector similarity on array<double> columns, and sense selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.operators.neighbours import knn

# Weights of a clause's parts, and of a statement's.
CLAUSE = {"predicate": 0.30, "subject": 0.25, "direct": 0.20, "indirects": 0.15, "sentiment": 0.05, "modality": 0.05}
STATEMENT = {"content": 0.70, "operator": 0.20, "attitude": 0.10}


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, rescale: bool = True) -> Column:
    """(cos + 1) / 2, two zero vectors 1, one 0; without rescaling the cosine itself, 0 for a zero vector."""
    na, nb = norm(a), norm(b)
    raw = dot(a, b) / (na * nb)
    if not rescale:
        return F.when((na == 0) | (nb == 0), 0.0).otherwise(raw)
    return F.when((na == 0) & (nb == 0), 1.0).when((na == 0) | (nb == 0), 0.0).otherwise((raw + 1) / 2)


def role_similarity(a: Column, b: Column) -> Column:
    """Null if both roles are absent (null or zero), 0 if one is, else the rescaled cosine."""
    za, zb = a.isNull() | (norm(a) == 0), b.isNull() | (norm(b) == 0)
    return F.when(za & zb, F.lit(None).cast("double")).when(za | zb, 0.0).otherwise(cosine(a, b))


def weighted(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    """Mean of the parts that are present, by weight; 0 when none is."""
    total = sum((F.when(c.isNotNull(), F.lit(weights[k])).otherwise(0.0) for k, c in parts.items()), F.lit(0.0))
    value = sum((F.coalesce(c * weights[k], F.lit(0.0)) for k, c in parts.items()), F.lit(0.0))
    return F.when(total == 0, 0.0).otherwise(value / total)


def compare_clause(parts: dict[str, Column], same: dict[str, Column] | None = None) -> Column:
    """Similarity of two clauses from their parts' similarities; a known (not) same individual overrides its role."""
    parts = dict(parts)
    for role, s in (same or {}).items():
        parts[role] = F.when(parts[role].isNotNull() & s.isNotNull(), s.cast("double")).otherwise(parts[role])
    return weighted(parts, CLAUSE)


def compare_statement(leaves: DataFrame, heads: DataFrame) -> DataFrame:
    """(a, b, similarity) of statement pairs: bag F1 of the leaf similarities (a, b, i, j, sim), or their positional mean where
    `directional`, with heads' operator and attitude similarities (a, b, directional, operator, attitude)."""
    best = lambda k: leaves.groupBy("a", "b", k).agg(F.max("sim").alias("m")).groupBy("a", "b").agg(F.avg("m").alias(f"best_{k}"))
    at = leaves.groupBy("a", "b").agg((F.sum(F.when(F.col("i") == F.col("j"), F.col("sim")).otherwise(0.0)) / F.greatest(F.max("i") + 1, F.max("j") + 1)).alias("placed"))
    both = heads.join(best("i"), ["a", "b"]).join(best("j"), ["a", "b"]).join(at, ["a", "b"])
    f1 = F.when(F.col("best_i") + F.col("best_j") == 0, 0.0).otherwise(2 * F.col("best_i") * F.col("best_j") / (F.col("best_i") + F.col("best_j")))
    content = F.when(F.col("directional"), F.col("placed")).otherwise(f1)
    return both.select("a", "b", weighted({"content": content, "operator": F.col("operator"), "attitude": F.col("attitude")}, STATEMENT).alias("similarity"))


def soft_f1(left: DataFrame, right: DataFrame, marker: int) -> DataFrame:
    """(pair, f1): best-match F1 of two sets of vectors (pair, item, vector); the first `marker` numbers are the type, which gates."""
    l, r = left.select("pair", F.col("item").alias("i"), F.col("vector").alias("a")), right.select("pair", F.col("item").alias("j"), F.col("vector").alias("b"))
    kind = lambda c: F.slice(c, 1, marker)
    rest = lambda c: F.slice(c, marker + 1, F.size(c))
    gate = F.greatest(F.lit(0.0), cosine(kind(F.col("a")), kind(F.col("b")), rescale=False))
    sims = l.join(r, "pair").select("pair", "i", "j", (gate * cosine(rest(F.col("a")), rest(F.col("b")))).alias("s"))
    best = lambda k: sims.groupBy("pair", k).agg(F.max("s").alias("m")).groupBy("pair").agg(F.avg("m").alias(f"best_{k}"))
    both = best("i").join(best("j"), "pair")
    return both.select("pair", F.when(F.col("best_i") + F.col("best_j") == 0, 0.0).otherwise(2 * F.col("best_i") * F.col("best_j") / (F.col("best_i") + F.col("best_j"))).alias("f1"))


def knn_opposite(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """Neighbours of the negated vector, itself included."""
    return knn(queries.withColumn("vector", F.transform("vector", lambda x: -x)), vectors, k, keep_self=True)


def centroid(vectors: DataFrame, by: str, weight: Column | None = None) -> DataFrame:
    """(by, vector): weighted mean of the non-zero vectors of a group, by dimension."""
    rows = vectors.where(norm(F.col("vector")) > 0).select(by, (F.lit(1.0) if weight is None else weight).alias("w"), F.posexplode("vector").alias("i", "x"))
    means = rows.groupBy(by, "i").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("m"))
    return means.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("vector"))


def phrase_search(words: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """Nearest vectors to the mean of each phrase's word vectors; words: (phrase, vec_id)."""
    mean = centroid(words.join(vectors, "vec_id"), "phrase").select(F.col("phrase").alias("vec_id"), "vector")
    return knn(mean, vectors, k, keep_self=True)


def label_statement(statements: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Nearest dictionary word to each statement's centroid."""
    return knn(statements, dictionary, 1, keep_self=True)


def anchor_classify(items: DataFrame, anchors: DataFrame, floor: float, margin: float, default: str = "none", antonyms: DataFrame | None = None) -> DataFrame:
    """(vec_id, value): the value of the anchor of the item's own word, else of the nearest anchor at or above the floor.

    The default if an anchor of another value is within the margin, or (antonyms (a, b) of words given) is an antonym of the nearest.
    anchors (anchor_id, value, vector[, word]) are a fixed small set: a few for each class; items may have a word.
    """
    named = "word" in items.columns and "word" in anchors.columns
    word = F.col("word") if "word" in anchors.columns else F.lit(None).cast("string")
    own = F.col("word") if named else F.lit(None).cast("string")
    packed = anchors.agg(F.collect_list(F.struct("anchor_id", "value", word.alias("word"), F.col("vector").alias("a"))).alias("anchors")).withColumn("_k", F.lit(1))
    met = items.select("vec_id", own.alias("own"), "vector", F.lit(1).alias("_k")).join(F.broadcast(packed), "_k").select("vec_id", "own", "vector", F.explode("anchors").alias("a"))
    scored = met.select("vec_id", "own", "a.value", "a.anchor_id", "a.word", F.round(cosine(F.col("vector"), F.col("a.a"), rescale=False), 6).alias("s"))
    if antonyms is None:
        scored = scored.withColumn("against", F.array().cast("array<string>"))
    else:
        both = antonyms.select("a", "b").unionByName(antonyms.select(F.col("b").alias("a"), F.col("a").alias("b")))
        scored = scored.join(both.groupBy(F.col("a").alias("word")).agg(F.collect_set("b").alias("against")), "word", "left")
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("d"), "anchor_id", "value", "word", F.coalesce("against", F.array().cast("array<string>")).alias("against"))))
    r = scored.groupBy("vec_id").agg(ranked.alias("r"), F.min(F.when(F.col("word") == F.col("own"), F.struct("anchor_id", "value"))).alias("exact"))
    first = F.get("r", F.lit(0))
    rivals = F.filter("r", lambda x: x["value"] != first["value"])
    close = F.coalesce(F.get(rivals, F.lit(0))["d"] - first["d"] < margin, F.lit(False))
    opposed = F.exists(rivals, lambda x: F.array_contains(first["against"], F.coalesce(x["word"], F.lit(""))))
    ok = (-first["d"] >= floor) & ~close & ~opposed
    return r.select("vec_id", F.coalesce("exact.value", F.when(ok, first["value"]), F.lit(default)).alias("value"))


def axis_antonyms(base: DataFrame) -> DataFrame:
    """(a, b): words with a negative value on another word's axis, both ways; base: (word, index, vector)."""
    low = base.select("word", F.posexplode("vector").alias("i", "x")).where("x < 0")
    pairs = low.join(base.select(F.col("word").alias("other"), F.col("index").alias("i")), "i").where("word <> other").select(F.col("word").alias("a"), F.col("other").alias("b"))
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def nearest_category(scores: DataFrame, floor: float = 0.85) -> DataFrame:
    """(item, category): the best category at or above the floor, ties by name."""
    best = scores.where(F.col("score") >= floor).groupBy("item").agg(F.min(F.struct((-F.col("score")).alias("s"), "category")).alias("m"))
    return best.select("item", F.col("m.category").alias("category"))


def compose_vector(entity: Column, modifiers: Column) -> Column:
    """tanh of an entity vector plus its weighted modifiers, array<struct<weight,vector>>; weight 0 (negation) adds nothing."""
    total = F.aggregate(modifiers, entity, lambda acc, m: F.zip_with(acc, m["vector"], lambda x, y: x + m["weight"] * y))
    return F.transform(total, lambda x: F.tanh(x))


def gloss_tokens(definition: Column, stop: list[str]) -> Column:
    """Distinct lower-case letter tokens of more than two letters, stop words removed."""
    words = F.regexp_extract_all(F.lower(definition), F.lit("[a-z]+"), F.lit(0))
    return F.array_except(F.array_distinct(F.filter(words, lambda w: F.length(w) > 2)), F.array(*[F.lit(w) for w in stop]))


def primary_senses(senses: DataFrame, n: int = 3) -> DataFrame:
    """The first n senses of each (word, pos) by number."""
    return senses.withColumn("_r", F.row_number().over(Window.partitionBy("word", "pos").orderBy("nr", "sense"))).where(F.col("_r") <= n).drop("_r")


def sibling_senses(dictionary: DataFrame, most: int = 12) -> DataFrame:
    """(sense, sibling, rank): senses of the same lemma and class, at most 12."""
    ranked = primary_senses(dictionary, most).withColumn("rank", F.row_number().over(Window.partitionBy("word", "pos").orderBy("nr", "sense")))
    return dictionary.select("word", "pos", "sense").join(ranked.select("word", "pos", F.col("sense").alias("sibling"), "rank"), ["word", "pos"]).where("sense <> sibling").select("sense", "sibling", "rank")


def disambiguate(candidates: DataFrame, floor: float = 0.5, margin: float = 0.1) -> DataFrame:
    """(token, sense) from (token, sense, nr, overlap, preferred, centroid): a unique best gloss overlap, else the preferred
    sense, else the centroid if high enough and ahead, else the lowest number."""
    w = Window.partitionBy("token")
    rows = candidates.withColumns({"_o": F.max("overlap").over(w), "_c": F.max("centroid").over(w)})
    top = rows.withColumn("_n", F.count_if(F.col("overlap") == F.col("_o")).over(w)).withColumn("_c2", F.max(F.when(F.col("centroid") < F.col("_c"), F.col("centroid"))).over(w))
    by_overlap = F.min(F.when((F.col("_o") > 0) & (F.col("_n") == 1) & (F.col("overlap") == F.col("_o")), F.col("sense")))
    by_choice = F.min(F.when(F.col("preferred"), F.col("sense")))
    by_centroid = F.min(F.when((F.col("centroid") == F.col("_c")) & (F.col("_c") >= floor) & (F.col("_c") - F.coalesce("_c2", F.lit(0.0)) >= margin), F.col("sense")))
    lowest = F.min(F.struct("nr", "sense"))["sense"]
    return top.groupBy("token").agg(F.coalesce(by_overlap, by_choice, by_centroid, lowest).alias("sense"))


def set_preferred(dictionary: DataFrame, rulings: DataFrame) -> DataFrame:
    """The dictionary with exactly one preferred sense for each ruled (word, pos): the ruling's."""
    r = rulings.select("word", "pos", F.col("sense").alias("_ruled"))
    return dictionary.join(r, ["word", "pos"], "left").withColumn("preferred", F.when(F.col("_ruled").isNotNull(), F.col("sense") == F.col("_ruled")).otherwise(F.col("preferred"))).drop("_ruled")


def pick_template(requests: DataFrame, shelf: DataFrame, seed: str = "0") -> DataFrame:
    """(request, template): weighted choice, repeatable by seed, of the enabled templates of the category whose slots the request can fill.

    Templates of a person's own scope are for that person only. Templates whose bands (optional columns confidence_low, confidence_high,
    arousal_low, arousal_high; null: open) hold the request's confidence and arousal go first; if none does, all that fit are chosen from.
    """
    fits = requests.join(shelf.where("enabled"), "category").where((F.size(F.array_except("slots", "data")) == 0) & ((F.col("scope") == "global") | (F.col("scope") == F.col("target"))))
    banded = F.lit(True)
    for c in ("confidence", "arousal"):
        if c in requests.columns and f"{c}_low" in shelf.columns:
            banded = banded & F.coalesce(F.col(c) >= F.col(f"{c}_low"), F.lit(True)) & F.coalesce(F.col(c) <= F.col(f"{c}_high"), F.lit(True))
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.col("request").cast("string"), "template", F.lit(seed))), 1, 8), 16, 10).cast("double") + 1) / 4294967297.0
    return fits.groupBy("request").agg(F.max(F.struct(banded.alias("banded"), (F.log(u) / F.col("weight")).alias("key"), "template")).alias("m")).select("request", F.col("m.template").alias("template"))
