"""Phrases that occur oftener than their parts let expect: counts kept as sorted streams, and looked up by merging streams.

A task sorts what begins at each word, up to the longest phrase, so that one sorted stream has the counts of all its
prefixes as sums of runs. Streams of a key range are merged by sorting again. What is left (phrases of at
least `least` occurrences, and as many of their parts, since a part is never rarer) is kept in prefix order and in suffix
order; left counts, right counts and counts of extensions are merge joins of these two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import LOWER, runs, text_buffer
from .common import cut, read_table, text_bytes

#: Words of text that a task sorts at once, and bytes of text whose counts are merged at once.
WORDS, MERGED = 1 << 20, 8 << 20
#: What follows the last word of a piece.
END = b""
BLANK, BREAK = np.zeros(256, bool), np.zeros(256, bool)
BLANK[[0x20, 0x09]] = True
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all words without what is between them, offsets of words in it, number of each word's piece).

    Words `[^\\x20\\x09]+` of the pieces between `[.,;:!?\\x0A-\\x0D]`; A-Z are lower-cased; a row ends a piece.
    """
    n = len(data)
    begins = np.zeros(n + 1, bool)
    begins[offsets[:-1]] = True
    begins = begins[:n]
    broken = BREAK[data]
    ink = ~(BLANK[data] | broken)
    start = ink.copy()
    start[1:] &= ~ink[:-1] | begins[1:]
    starts = np.flatnonzero(start)
    piece = np.cumsum(broken)[starts] + np.cumsum(begins)[starts]
    place = np.cumsum(ink)
    return LOWER[data[ink]], np.append(place[starts] - 1, place[-1] if n else 0), piece


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _binary(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(values))])


def _word_hash(words: list[bytes]) -> np.ndarray:
    """The same number for a word in all tasks; it only deals phrases out."""
    from xxhash import xxh64_intdigest

    return np.fromiter((xxh64_intdigest(w) for w in words), np.uint64, len(words))


def _grouped(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of the columns in order, and their sums of n."""
    if not len(n):
        return columns, n
    key = columns[0].astype(np.int64)
    for c in columns[1:]:
        size = int(c.max()) + 1
        if int(key.max()) >= (1 << 62) // size:
            key = np.unique(key, return_inverse=True)[1]
        key = key * size + c
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return [c[order[first]] for c in columns], np.add.reduceat(n[order], first)


def _pack(columns: list[np.ndarray], n: np.ndarray, words: list[bytes]) -> tuple[bytes, bytes]:
    """A stream as two binaries: the words it has, joined by blanks, and its columns as numbers of these words, then counts."""
    used = np.unique(np.concatenate(columns))
    small = np.uint16 if len(used) < 1 << 16 else np.uint32
    body = b"".join(np.searchsorted(used, c).astype(small).tobytes() for c in columns)
    return b" ".join(words[i] for i in used), body + n.astype(np.uint32).tobytes()


def _streams(parts: int, longest: int):
    """Sorted streams of what begins at each word, dealt to parts by the first two words, and of single words by themselves."""

    def flush(lang: list[str], blocks: list[tuple]) -> Iterator[dict]:
        encoded = pa.chunked_array([b[0] for b in blocks]).dictionary_encode()
        code = np.concatenate([c.indices.to_numpy() for c in encoded.chunks]).astype(np.int64)
        words = [END, *encoded.chunk(0).dictionary.to_pylist()]
        by = sorted(range(len(words)), key=words.__getitem__)
        rank = np.empty(len(words), np.int64)
        rank[by] = np.arange(len(words))
        words, code = [words[i] for i in by], rank[code + 1]
        piece, base = [], 0
        for _, p, _ in blocks:
            piece.append(p + base)
            base = int(piece[-1][-1]) + 1
        piece = np.concatenate(piece)
        where = np.repeat([b[2] for b in blocks], [len(b[1]) for b in blocks])
        hashed = _word_hash(words)
        for k in np.unique(where):
            mine = where == k
            c, p = code[mine], piece[mine]
            columns = [c]
            for j in range(1, longest):
                follows = np.zeros(len(c), np.int64)  # END
                follows[:-j] = np.where(p[j:] == p[:-j], c[j:], 0) if len(c) > j else follows[:-j]
                columns.append(follows)
            rows, n = _grouped(columns, np.ones(len(c), np.int64))
            with np.errstate(over="ignore"):
                deal = (_mix(hashed[rows[0]] + np.uint64(1)) + hashed[rows[1]] * np.uint64(3)) >> np.uint64(1)
            deal = np.where(rows[1] == 0, -1, (deal % np.uint64(parts)).astype(np.int64))
            yield from out(lang[k], rows, n, deal, words, 0)
            rows, n = _grouped([c], np.ones(len(c), np.int64))
            yield from out(lang[k], rows, n, (_mix(hashed[rows[0]]) % np.uint64(parts)).astype(np.int64), words, parts)

    def out(name: str, rows: list[np.ndarray], n: np.ndarray, deal: np.ndarray, words: list[bytes], base: int) -> Iterator[dict]:
        order = np.argsort(deal, kind="stable")
        deal = deal[order]
        cuts = np.append(np.flatnonzero(np.append(True, deal[1:] != deal[:-1])), len(deal)) if len(deal) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if deal[a] >= 0:
                at = order[a:b]
                text, body = _pack([c[at] for c in rows], n[at], words)
                yield {"part": int(deal[a]) + base, "lang": name, "words": text, "body": body}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int32()), ("lang", pa.string()), ("words", pa.binary()), ("body", pa.binary())])
        number: dict[str, int] = {}
        blocks, held = [], 0

        def emit() -> Iterator[pa.RecordBatch]:
            made, size = [], 0
            for row in flush(list(number), blocks):
                made.append(row)
                size += len(row["words"]) + len(row["body"])
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(made, schema)
                    made, size = [], 0
            yield pa.RecordBatch.from_pylist(made, schema)

        for batch in batches:
            langs = batch.column(0).to_pylist()
            for name in dict.fromkeys(langs):
                k = number.setdefault(name, len(number))
                data, offsets = text_buffer(batch.column(1).filter(pa.array([x == name for x in langs])))
                for a, b in runs(offsets):
                    values, at, piece = pieces(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    if len(piece):
                        blocks.append((_binary(values, at), piece, k))
                        held += len(piece)
                    if held >= WORDS:
                        yield from emit()
                        blocks, held = [], 0
                        number = {name: 0}
                        k = 0
        if blocks:
            yield from emit()

    return work


def _merge(parts: int, longest: int, least: int):
    """Counts of one part's streams: phrases and words of at least `least` occurrences, and of all words by language (no word)."""

    def work(table: pa.Table) -> pa.Table:
        single = table["part"][0].as_py() >= parts
        names, bodies, texts = table["lang"].to_pylist(), table["body"].to_pylist(), table["words"].to_pylist()
        width = 1 if single else longest
        found: list[tuple[str, list, int]] = []
        for name in dict.fromkeys(names):
            mine = [i for i, x in enumerate(names) if x == name]
            lists = [texts[i].split(b" ") for i in mine]
            vocabulary = sorted(set().union(*lists))
            at = {w: i for i, w in enumerate(vocabulary)}
            columns, counts = [[] for _ in range(width)], []
            for i, own in zip(mine, lists, strict=True):
                to = np.fromiter(map(at.__getitem__, own), np.int64, len(own))
                small = np.dtype(np.uint16 if len(own) < 1 << 16 else np.uint32)
                rows = len(bodies[i]) // (width * small.itemsize + 4)
                for j in range(width):
                    columns[j].append(to[np.frombuffer(bodies[i], small, rows, j * rows * small.itemsize)])
                counts.append(np.frombuffer(bodies[i], np.uint32, rows, width * rows * small.itemsize))
            columns, n = _grouped([np.concatenate(c) for c in columns], np.concatenate(counts).astype(np.int64))
            end = vocabulary[0] == END
            if single:
                found.append((name, [], int(n.sum())))
            for length in range(1 if single else 2, width + 1):
                key = columns[:length]
                change = np.zeros(len(n), bool)
                change[:1] = True
                for c in key:
                    change[1:] |= c[1:] != c[:-1]
                first = np.flatnonzero(change)
                total = np.add.reduceat(n, first)
                keep = (total >= least) & ~((key[-1][first] == 0) & end)
                picked = np.column_stack([c[first[keep]] for c in key])
                found += [(name, [vocabulary[i].decode() for i in row], t) for row, t in zip(picked.tolist(), total[keep].tolist(), strict=True)]
        return pa.table({"lang": pa.array([x[0] for x in found], pa.string()), "words": pa.array([x[1] for x in found], pa.list_(pa.string())), "n": pa.array([x[2] for x in found], pa.int64())})

    return work


def counts(docs: DataFrame, longest: int = 3, least: int = 10) -> DataFrame:
    """(lang, words, n): phrases of 1 to `longest` words that occur at least `least` times in texts of a language, and with no
    words how many words it has at all. Null texts are empty, a null lang is `und`."""
    known = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    parts = max(1, -(-text_bytes(known) // MERGED))
    streams = known.mapInArrow(_streams(parts, longest), "part int, lang string, words binary, body binary")
    merged = streams.groupBy("part").applyInArrow(_merge(parts, longest, least), "lang string, words array<string>, n long")
    return cut(merged.groupBy("lang", "words").agg(F.sum("n").alias("n")))


def collocations(docs: DataFrame, *, longest: int = 3, least: int = 10, percent: int = 50, top: int = 2000) -> DataFrame:
    """Each language's first `top` phrases of 2 to `longest` words: (lang, rank, phrase, a, l, r, n, score).

    a, l and r are the occurrences of the phrase and of its two parts at the cut of lowest score floor(1000000 a a / (l r)), the
    first such cut; n are the language's words. Phrases inside a longer one that is at least percent/100 as
    frequent are left out. Order: score, then a, descending, then the phrase by its bytes. Null and blank texts
    count for nothing, repeated rows each time; an empty table gives an empty table. Products are exact up to 38 digits.
    """
    found = counts(docs, longest, least)
    size = F.size("words")
    grams = found.where(size > 0)
    # The two orders of a stream: by what a phrase begins with, and by what it ends with.
    part = lambda a, n: F.slice("words", a, n)
    stream = grams.select(F.col("lang").alias("k_lang"), F.col("words").alias("k_words"), F.col("n").alias("k_n")).hint("merge")
    phrases = grams.where(size > 1).withColumnRenamed("n", "a")
    best = None
    for k in range(1, longest):
        cuts = phrases.where(size > k).select("lang", "words", "a", part(1, k).alias("head"), part(F.lit(k + 1), size - k).alias("tail"))
        left = cuts.join(stream, (F.col("lang") == F.col("k_lang")) & (F.col("head") == F.col("k_words"))).select("lang", "words", "a", "tail", F.col("k_n").alias("l"))
        both = left.join(stream, (F.col("lang") == F.col("k_lang")) & (F.col("tail") == F.col("k_words"))).select("lang", "words", "a", "l", F.col("k_n").alias("r"))
        scored = both.withColumn("k", F.lit(k))
        best = scored if best is None else best.unionByName(scored)
    big = lambda c: f"cast({c} as decimal(19,0))"
    score = F.expr(f"(cast(1000000 * {big('a')} as decimal(26,0)) * {big('a')}) div ({big('l')} * {big('r')})").cast("long")
    lowest = best.withColumn("score", score).groupBy("lang", "words").agg(F.min_by(F.struct("a", "l", "r", "score"), F.struct("score", "k")).alias("cut")).select("lang", "words", "cut.*")
    inner = lambda words: F.struct(F.col("lang").alias("e_lang"), words.alias("e_words"))
    longer = grams.where(size > 2).select(F.explode(F.array(inner(part(1, size - 1)), inner(part(F.lit(2), size - 1)))).alias("e"), F.col("n").alias("e_n"))
    extended = longer.groupBy("e.e_lang", "e.e_words").agg(F.max("e_n").alias("longer")).hint("merge")
    kept = lowest.join(extended, (F.col("lang") == F.col("e_lang")) & (F.col("words") == F.col("e_words")), "left").where(F.coalesce(100 * F.col("longer") < percent * F.col("a"), F.lit(True)))
    listed = kept.select("lang", F.concat_ws(" ", "words").alias("phrase"), "a", "l", "r", "score")
    listed = listed.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))).where(F.col("rank") <= top)
    total = found.where(size == 0).select(F.col("lang").alias("t_lang"), F.col("n"))
    return listed.join(total, F.col("lang") == F.col("t_lang")).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    """Phrases of two and three words of all documents, by language."""
    return collocations(read_table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
cut AS (SELECT lang, row_number() OVER () AS piece, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
starts AS (SELECT lang, piece, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM cut),
words AS (SELECT lang, count(*) AS n FROM starts GROUP BY lang),
follow AS (SELECT lang, w, lead(w) OVER p AS w2, lead(w, 2) OVER p AS w3 FROM starts WINDOW p AS (PARTITION BY piece ORDER BY i)),
f AS MATERIALIZED (
  SELECT lang, [w] AS p, count(*) AS n FROM follow GROUP BY ALL HAVING n >= 10
  UNION ALL SELECT lang, [w, w2], count(*) AS n FROM follow WHERE w2 IS NOT NULL GROUP BY ALL HAVING n >= 10
  UNION ALL SELECT lang, [w, w2, w3], count(*) AS n FROM follow WHERE w3 IS NOT NULL GROUP BY ALL HAVING n >= 10),
split AS MATERIALIZED (
  SELECT lang, p, n AS a, 1 AS k, p[1:1] AS head, p[2:] AS tail FROM f WHERE len(p) > 1
  UNION ALL SELECT lang, p, n, 2, p[1:2], p[3:] FROM f WHERE len(p) > 2),
cuts AS (
  SELECT s.lang, s.p, a, x.n AS l, y.n AS r, k, (1000000 * a::HUGEINT * a // (x.n::HUGEINT * y.n))::BIGINT AS score
  FROM split s JOIN f x ON x.lang = s.lang AND x.p = s.head JOIN f y ON y.lang = s.lang AND y.p = s.tail),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inside AS (SELECT lang, e, max(n) AS longer FROM (SELECT lang, unnest([p[1:2], p[2:3]]) AS e, n FROM f WHERE len(p) = 3) GROUP BY lang, e),
kept AS (
  SELECT b.lang, array_to_string(p, ' ') AS phrase, a, l, r, score
  FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.e = b.p WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN words USING (lang) WHERE rank <= 2000"""
