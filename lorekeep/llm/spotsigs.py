"""Document fingerprints by SpotSigs, on DataFrame functions.

A spot is an antecedent (a very common word); its signature is the antecedent with the next content
words, common words left out. A text's fingerprint is its set of signature hashes. Fingerprints are
compared by Jaccard similarity; sets whose lengths alone rule the threshold out are never compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, documents, read_table, shuffle_partitions

# Very common words of English, German, French and Spanish.
COMMON = (
    "a an and are as at be by for from in is it of on that the this to was with "
    "auf das dem den der des die ein eine für im ist mit nicht sich und von zu "
    "au avec dans du en est et la le les ou par pas pour que qui sur un une "
    "al con de del el es las lo los no para por se su una y"
).split()
#: Stands in for a null doc_id while rows are put in order.
LAST = -(1 << 63)
_STOP = "|".join(sorted(COMMON, key=len, reverse=True))


def signatures(text: Column) -> Column:
    """Sorted distinct 64-bit hashes of a text's spot signatures (antecedent and the next two content words, as far as there are any).

    A text without spots has one signature, the hash of the whole text; so has the empty text. A null text is empty.
    """
    plain = F.coalesce(text, F.lit(""))
    spaced = F.concat(F.lit(" "), F.regexp_replace(F.lower(plain), r"[^\p{L}]+", " "), F.lit(" "))
    # After this every element between blanks is a content word, followed by the common words behind it: word#of#the.
    marked = F.regexp_replace(spaced, rf" (?=(?:{_STOP}) )", "#")
    words = F.split(F.rtrim(marked), " ")

    def spots(words: Column) -> Column:
        """Hashes of all spots; the words are bound once, not split anew for each of them."""

        def behind(word: Column, i: Column) -> Column:
            after = F.concat_ws(" ", F.substring_index(F.get(words, i + 1), "#", 1), F.substring_index(F.get(words, i + 2), "#", 1))
            antecedents = F.filter(F.split(F.substr(word, F.locate("#", word) + 1), "#"), lambda a: a != "")
            return bind(after, lambda c: F.transform(antecedents, lambda a: F.xxhash64(a, c)))

        return F.flatten(F.transform(words, lambda w, i: F.when(F.contains(w, F.lit("#")), behind(w, i)).otherwise(F.array().cast("array<bigint>"))))

    unique = F.array_sort(F.array_distinct(bind(F.split(F.rtrim(marked), " "), spots)))
    return bind(unique, lambda u: F.when(F.size(u) > 0, u).otherwise(F.array(F.xxhash64(plain))))


def bind(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def fingerprint(signed: Column) -> Column:
    """A signature set as text: hexadecimal hashes of 16 digits each, in order."""
    return F.array_join(F.transform(signed, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def likeness(a: Column, b: Column, threshold: float = 0.0) -> Column:
    """Jaccard similarity of two signature sets; 0 without comparing them where their lengths rule the threshold out."""
    pruned = F.least(F.size(a), F.size(b)) < F.lit(threshold) * F.greatest(F.size(a), F.size(b))
    shared = bind(F.size(F.array_intersect(a, b)), lambda n: n / (F.size(a) + F.size(b) - n))
    return F.when(pruned, F.lit(0.0)).otherwise(shared)


def near_pairs(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(a, b, likeness) of representatives of different signature sets with a likeness of at least the threshold, a < b.

    Equal sets are one class, under its smallest doc_id, so copies are never paired. Lists are kept by
    set length and signature: two sets that reach the threshold share one of the first
    n - ceil(threshold * n) + 1 signatures of each, the rarest first, and their lengths are in the same or neighbouring
    partitions. Null ids are left out. Rows of an empty table and repeated rows make no pairs, and neither does a threshold of 1, as sets that
    reach it are equal. The threshold is over 0 and at most 1.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is over 0 and at most 1")
    signed = documents(docs).where(F.col("doc_id").isNotNull()).select("doc_id", signatures(F.col("text")).alias("s"))
    classes = cut(signed.groupBy("s").agg(F.min("doc_id").alias("doc_id")))
    # Rare signatures first: a list then holds few sets, and one that is in most texts is hardly ever among the first.
    spread = classes.select("doc_id", F.explode("s").alias("sig"))
    often = spread.groupBy("sig").agg(F.count("*").alias("often"))
    ranked = spread.join(often, "sig").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("often", "sig"))), lambda x: x["sig"]).alias("s"))
    size = F.size("s")
    part = F.floor(F.log(size) / F.log(F.lit(1 / threshold))) if threshold < 1 else size.cast("long")
    listed = ranked.select("doc_id", "s", part.alias("part"), F.explode(F.slice("s", 1, size - F.ceil(F.lit(threshold) * size - 1e-9).cast("int") + 1)).alias("sig"))
    left = listed.select(F.col("doc_id").alias("a"), F.size("s").alias("na"), "sig", F.explode(F.array(F.col("part"), F.col("part") + 1, F.col("part") - 1)).alias("part"))
    right = listed.select(F.col("doc_id").alias("b"), F.size("s").alias("nb"), "sig", "part")
    pruned = F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb") - 1e-9
    candidates = left.join(right, ["sig", "part"]).where((F.col("a") < F.col("b")) & pruned).select("a", "b").distinct()
    sets = classes.select("doc_id", "s")
    both = candidates.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b")
    return both.select("a", "b", likeness(F.col("sa"), F.col("sb"), threshold).alias("likeness")).where(F.col("likeness") >= threshold - 1e-12)


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text) with next_text, the text of the next row in descending order of doc_id; after the last comes the first.

    Only keys (id and 64-bit hash of the text) are put in order, by range partitions whose first keys the driver
    links; then each text travels once to its own key and once to the one before it. Rows of equal doc_id follow each other in the
    order of the hash, repeated rows are each other's next, a null doc_id is the last (LAST stands in for it and is read as null).
    An empty table gives an empty table.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("d"), F.xxhash64("text").alias("h"), "text")
    keys = rows.groupBy("d", "h").agg(F.count("*").alias("n"))
    order = F.desc("d"), F.asc("h")
    laid = cut(keys.repartitionByRange(max(8, shuffle_partitions(spark)), *order).sortWithinPartitions(*order).select("d", "h", "n", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    ends = laid.groupBy("part").agg(F.max_by(F.struct("d", "h"), "at").alias("last")).orderBy("part").collect()
    border = spark.createDataFrame([(r["part"], tuple(ends[i - 1]["last"])) for i, r in enumerate(ends)], "part int, border struct<d:bigint,h:bigint>")
    lag = F.lag(F.struct("d", "h")).over(Window.partitionBy("part").orderBy("at"))
    linked = laid.withColumn("lag", lag).join(F.broadcast(border), "part").select("d", "h", "n", F.coalesce("lag", "border").alias("before"))
    # Both uses of the placed rows need key and text alone, so that they share one exchange of the texts.
    placed = rows.join(linked.hint("shuffle_merge"), ["d", "h"]).withColumn("place", F.row_number().over(Window.partitionBy("d", "h").orderBy("d")))
    ahead = placed.where("place = 1").select("before.d", "before.h", F.col("text").alias("ahead"))
    met = placed.join(ahead.hint("shuffle_merge"), ["d", "h"])
    return met.select(F.nullif(F.col("d"), F.lit(LAST)).alias("doc_id"), "text", F.when(F.col("place") < F.col("n"), F.col("text")).otherwise(F.col("ahead")).alias("next_text"))


def op6_spotsigs(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, and how like they are to each other and to the next text's.

    Null texts are empty; rows without doc_id come last in the order; repeated rows are returned each; of one row only the next is itself.
    """
    docs = documents(read_table(spark, sf_dir, "documents")).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pairs = with_next(docs)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr(F.col("text"), F.lit(1), n - half), F.substr(F.col("next_text"), F.lit(1), half))
    signed = pairs.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), signatures(F.col("text")).alias("s"), signatures(F.col("next_text")).alias("sn")).withColumn("se", signatures(F.col("edited")))
    return signed.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("s")).alias("fingerprint"),
        fingerprint(F.col("se")).alias("edited_fingerprint"),
        likeness(F.col("s"), F.col("se")).alias("near_edited"),
        likeness(F.col("s"), F.col("sn")).alias("near_next"),
    )
