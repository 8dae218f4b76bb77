"""People's names and uids out of lines of text: a dictionary of any size, matched by joins, and a guard behind it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.text import name_pattern, replacement, uid_pattern
from lorekeep.runtime import store

#: Words of a name that are looked up, and last characters of a uid; the whole of either is compared afterwards.
WORDS, CHARS = 8, 64
#: Last characters of a uid that are looked at first, and cells that they, and first words of names, are hashed to.
GRAM, CELLS = 4, 1 << 18
#: Characters of a line that are looked at as one piece.
PIECE = 512


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), 1)


def _cell(text: Column) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(CELLS)).cast("int")


def _wanted(people: DataFrame) -> DataFrame:
    """(key, kind, n, cell, turn, length, literal, label): what to look for; uids have the first turn, names the second, longest first."""
    has = lambda c, kind: F.col(c).cast(kind) if c in people.columns else F.lit(None).cast(kind)
    known = people.select(F.trim(has("uid", "string")).alias("uid"), F.trim("name").alias("name"), "label", F.coalesce(has("is_me", "boolean"), F.lit(False)).alias("is_me")).where("not is_me and label is not null")
    both = known.select(F.explode(F.array(F.struct(F.lit(0).alias("turn"), F.col("uid").alias("literal")), F.struct(F.lit(1).alias("turn"), F.col("name").alias("literal")))).alias("x"), "label").select("x.*", "label")
    rows = both.where(F.char_length("literal") >= 2).groupBy("turn", "literal").agg(F.min("label").alias("label"))
    words = F.slice(_words(F.col("literal")), 1, WORDS)
    by_word = (F.col("turn") == 1) & (F.size(words) > 0)
    end = F.lower(F.right("literal", F.lit(CHARS)))
    key = F.when(by_word, F.array_join(words, " ")).otherwise(end)
    n = F.when(by_word, F.size(words)).otherwise(F.char_length(end))
    first = F.when(by_word, F.get(words, F.lit(0))).otherwise(F.right(end, F.lit(GRAM)))
    return rows.select(key.alias("key"), F.when(by_word, "words").otherwise("chars").alias("kind"), n.alias("n"), _cell(first).alias("cell"), "turn", F.char_length("literal").alias("length"), "literal", "label")


def _pattern(turn: Column, literal: Column) -> Column:
    return F.when(turn == 0, uid_pattern(literal)).otherwise(name_pattern(literal))


def mentions(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, named): who may be named in lines (id, text), as an array of (turn, shorter, literal, label) in order; whole words and ends agree.

    A word, or an end of a run of characters, whose cell has no key goes no further; the cells are a table of bounded size that tasks hold.
    What is left makes one key for each size that its cell has, and keys meet by an equi-join, so who only ends like another is never met.
    """
    grams = [r.g for r in wanted.where("kind = 'chars'").select(F.least("n", F.lit(GRAM)).alias("g")).distinct().collect()]  # at most GRAM rows
    cells = F.broadcast(wanted.groupBy("kind", "cell").agg(F.collect_set("n").alias("sizes")))
    words, low, piece = F.col("words"), F.col("low"), F.col("piece")
    upto = lambda size: F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    near = lambda rows, kind: rows.join(cells.where(F.col("kind") == kind).drop("kind"), "cell").withColumn("n", F.explode("sizes"))
    texts = lines.where("text is not null").select("id", _words(F.col("text")).alias("words"), F.lower("text").alias("low"))
    runs = F.transform(upto(F.size(words)), lambda i: F.slice(words, i, WORDS))
    begun = near(texts.select("id", F.explode(runs).alias("run")).select("id", "run", _cell(F.get("run", F.lit(0))).alias("cell")), "words")
    parts = [begun.where(F.size("run") >= F.col("n")).select("id", F.lit("words").alias("kind"), F.array_join(F.slice("run", F.lit(1), F.col("n")), " ").alias("key"))]
    # A piece of a line begins with the characters before it that a key can reach back to.
    starts = F.sequence(F.lit(1), F.greatest(F.char_length(low), F.lit(1)), F.lit(PIECE))
    pieces = F.transform(starts, lambda i: F.struct(F.substr(low, F.greatest(i - CHARS, F.lit(1)), F.least(i - 1, F.lit(CHARS)) + PIECE).alias("piece"), F.least(i, F.lit(CHARS + 1)).alias("new")))
    cut = texts.select("id", F.explode(pieces).alias("p")).select("id", "p.*")
    for g in grams:
        ends = F.when(F.char_length(piece) >= F.greatest("new", F.lit(g)), F.sequence(F.greatest("new", F.lit(g)), F.char_length(piece)))
        ended = F.transform(ends, lambda i: F.struct(i.alias("i"), _cell(F.substr(piece, i - (g - 1), F.lit(g))).alias("cell")))  # noqa: B023
        ended = near(cut.select("id", "piece", F.explode(ended).alias("e")).select("id", "piece", "e.*"), "chars").where(F.col("i") >= F.col("n"))
        parts.append(ended.select("id", F.lit("chars").alias("kind"), F.substr(piece, F.col("i") - F.col("n") + 1, F.col("n")).alias("key")))
    parts = reduce(DataFrame.unionByName, parts)
    met = parts.join(wanted, ["kind", "key"])
    return met.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("turn", (-F.col("length")).alias("shorter"), "literal", "label"))).alias("named"))


def hide_people(lines: DataFrame, people: DataFrame) -> DataFrame:
    """(id, text, named): lines (id, text) with the label for every uid, then for every name of people (name, label, optional uid, is_me).

    Uids are found inside other text, names between word borders, both in any case and the longest first; labels may have any
    signs. A label that is repeated in brackets behind itself is said once. A line that names somebody even then, say
    because a label does, has a null text, and so has a null line. Those marked is_me, literals of one character and people
    without label are left as they are; of people who share a name the smallest label is taken. A line only meets those it names, so
    neither side is held whole anywhere; ids are unique.
    """
    wanted = store(_wanted(people))
    in_text = lambda text, x: F.regexp_count(text, _pattern(x["turn"], x["literal"])) > 0
    swap = lambda text, x: F.regexp_replace(text, _pattern(x["turn"], x["literal"]), replacement(x["label"]))
    met = lines.join(mentions(lines, wanted), "id", "left").select("id", "text", F.filter("named", lambda x: in_text(F.col("text"), x)).alias("named"))
    hidden = F.aggregate("named", F.col("text"), swap)
    once = F.regexp_replace(hidden, r"(?iu)\b(.{2,40}?) \(\1\)", "$1")
    named = F.coalesce(F.size("named") > 0, F.lit(False))
    touched = store(met.select("id", F.when(named, once).otherwise(F.col("text")).alias("text"), named.alias("named")))
    changed = touched.where("named").select("id", "text")
    leaking = changed.join(mentions(changed, wanted), "id").where(F.exists("named", lambda x: in_text(F.col("text"), x)))
    out = touched.join(store(leaking.select("id", F.lit(True).alias("leaks"))), "id", "left")
    return out.select("id", F.when(F.col("leaks"), F.lit(None).cast("string")).otherwise(F.col("text")).alias("text"), "named")
