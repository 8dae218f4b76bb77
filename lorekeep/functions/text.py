"""Text functions as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Contractions, and the first and second person seen from a listener.
CONTRACTIONS = {"can't": "cannot", "won't": "will not", "n't": " not", "'re": " are", "'ve": " have", "'ll": " will", "'m": " am"}
VIEW = {"i": "{s}", "me": "{s}", "my": "{s}'s", "mine": "{s}'s", "myself": "{s}", "you": "i", "your": "my", "yours": "mine"}
DEICTIC = ["here", "there", "this", "that", "these", "those", "now", "we", "us", "our"]


def clean_gloss(c: Column) -> Column:
    """Parentheses out, cut at the first ; or :, quotes out, spaces collapsed."""
    bare = F.regexp_replace(c, r"\([^)]*\)", "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, "[;:].*$", ""), "[\"'`]", ""), r"\s+", " "))


def article(word: Column) -> Column:
    return F.when(F.lower(word).rlike("^[aeiou]"), "an").otherwise("a")


def frame_gloss(word: Column, pos: Column, gloss: Column) -> Column:
    """A sentence for a definition: nouns are, verbs are to, adjectives mean."""
    g = clean_gloss(gloss)
    return F.when(g == "", F.lit(None)).when(pos == "n", F.concat_ws(" ", article(word), word, F.lit("is"), g)).when(pos == "v", F.concat_ws(" ", F.lit("to"), word, F.lit("is to"), g)).when(pos.isin("a", "s"), F.concat_ws(" ", word, F.lit("means"), g))


def tidy_text(c: Column) -> Column:
    """Contractions expanded, spaces before punctuation and double spaces removed."""
    out = reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), CONTRACTIONS.items(), c)
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"\s+([.,;:!?])", "$1"), r"\s+", " "))


def speaker_view(text: Column, speaker: Column) -> Column:
    """First and second person rewritten from the speaker's to the listener's view; null when a deictic word remains."""
    words = F.split(F.lower(text), " ")
    swapped = F.transform(words, lambda w: reduce(lambda acc, kv: acc.when(w == kv[0], F.replace(F.lit(kv[1]), F.lit("{s}"), speaker)), list(VIEW.items())[1:], F.when(w == "i", speaker)).otherwise(w))
    return F.when(F.exists(words, lambda w: w.isin(DEICTIC)), F.lit(None)).otherwise(F.array_join(swapped, " "))


def strip_vocative(text: Column, name: str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, rf"(?i)^\s*(?:hey\s+)?{name}\s*[,:]?\s+", ""), rf"(?i)\s*,?\s+{name}\s*([.?!]?)\s*$", "$1"))


# Heads of social acts.
SOCIAL = {"hello": "greeting", "hi": "greeting", "good morning": "greeting", "thanks": "thanks", "thank you": "thanks", "bye": "farewell", "good night": "farewell"}


def social_act(text: Column) -> Column:
    """(act, rest): greeting, thanks or farewell by the first two words, then the first; the rest only after a separator."""
    t = F.lower(text)
    two, one = F.regexp_extract(t, r"^\s*(\w+ \w+)", 1), F.regexp_extract(t, r"^\s*(\w+)", 1)
    look = lambda c: F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in SOCIAL.items()])
    rest = F.regexp_extract(t, r"^[\w ]+[,.!;]\s*(.+)$", 1)
    return F.struct(F.coalesce(look(two), look(one)).alias("act"), F.when(rest != "", rest).alias("rest"))


def surface(sense: Column) -> Column:
    """Readable word of a sense `word_x.n.01` or a uid `name@kind`."""
    return F.replace(F.split_part(F.split_part(sense, F.lit("@"), F.lit(1)), F.lit("."), F.lit(1)), F.lit("_"), F.lit(" "))


def render_conclusion(subject: Column, predicate: Column, obj: Column, negated: Column) -> Column:
    """A simple sentence: nouns with is (not) a, verbs with (does not), the object last."""
    s, p = surface(subject), surface(predicate)
    noun = predicate.rlike(r"\.n\.")
    verb = F.when(noun, F.concat(F.when(negated, "is not ").otherwise("is "), article(p), F.lit(" "), p)).otherwise(F.concat(F.when(negated, "does not ").otherwise(""), p))
    return F.concat_ws(" ", s, verb, surface(obj))


def majority_vote(a: Column, b: Column, c: Column) -> Column:
    return F.when(a == b, a).when(a == c, a).when(b == c, b).otherwise(c)


def conjunct_topics(text: Column, n: Column) -> Column:
    """The slices of a text around "and" if there are exactly n, else n nulls."""
    parts = F.split(text, r"\s+and\s+")
    return F.when(F.size(parts) == n, parts).otherwise(F.array_repeat(F.lit(None).cast("string"), n))


def quoted(literal: Column) -> Column:
    """A pattern that is this text and nothing else."""
    return F.concat(F.lit(r"\Q"), F.replace(literal, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def name_pattern(name: Column) -> Column:
    """The name in any case, not as a part of a longer word."""
    return F.concat(F.lit(r"(?iuU)(?<!\w)"), quoted(name), F.lit(r"(?!\w)"))


def uid_pattern(uid: Column) -> Column:
    """The uid in any case, inside other text too."""
    return F.concat(F.lit("(?iu)"), quoted(uid))


def replacement(label: Column) -> Column:
    """A replacement that is this text, whatever signs it has."""
    return F.replace(F.replace(label, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit(r"\$"))


def scrub_names(text: Column, people: list[tuple[str, str, str]]) -> Column:
    """Uids, then names replaced by labels, the longest first and in any case; uids inside other text, names between word borders.
    Lines that still hold one of them or an @ are dropped. people: (uid, name, label), a few; operators.anonymity takes a table."""
    swaps = [(uid_pattern(F.lit(u)), u, label) for u, _, label in sorted(people, key=lambda x: (-len(x[0]), x))]
    swaps += [(name_pattern(F.lit(n)), n, label) for _, n, label in sorted(people, key=lambda x: (-len(x[1]), x[1], x))]
    swaps = [(pattern, label) for pattern, literal, label in swaps if len(literal) >= 2]
    out = reduce(lambda c, x: F.regexp_replace(c, x[0], replacement(F.lit(x[1]))), swaps, text)
    leaks = lambda line: reduce(lambda a, x: a | (F.regexp_count(line, x[0]) > 0), swaps, F.contains(line, F.lit("@")))
    return F.array_join(F.filter(F.split(out, "\n"), lambda x: ~leaks(x)), "\n")


def read_min(body: Column) -> Column:
    """Whole minutes at 200 words each over all paragraphs, at least 1."""
    words = F.aggregate(body, F.lit(0), lambda n, p: n + F.size(F.split(F.trim(p), r"\s+")))
    return F.greatest(F.lit(1), F.floor(words / 200).cast("int"))


def modality_kind(text: Column) -> Column:
    """`statement` for a JSON object with items and map, else `language`."""
    keys = F.json_object_keys(text)
    return F.when(F.coalesce(F.array_contains(keys, "items") & F.array_contains(keys, "map"), F.lit(False)), "statement").otherwise("language")
