"""Toxicity by two Kneser-Ney models of words, one of toxic and one of ordinary documents.

A model counts in how many documents of its class a word occurs (a continuation count: repeats inside a document add nothing), takes
an absolute discount from each count, and gives what it took to counts that both classes share. So a rare
expression is as likely in both as it is at all, and a word that neither has seen tells nothing. A toxic text
is an ordinary one in which a small share of the words comes from the toxic model; what is compared is the log likelihood a word,
with and without that share, over the whole text and over its most toxic stretch of a few words. A logistic curve, fitted
to labelled documents by models that have not seen them, turns both into a probability.

Counts and log ratios are distributed tables that grow with the labelled texts; they are sent in chunks of bounded size, of which a
task holds one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .arrays import runs, text_buffer
from .common import cut, read_table

#: Share of a toxic text's words that the toxic model says; words of the stretch that is compared.
SHARE, STRETCH = 0.01, 10
#: Models that are fitted to what the others leave out, and labelled documents that the curve is fitted to, chosen by a hash.
FOLDS, SAMPLE = 3, 20_000
COUNTS = [f"n{i}" for i in range(2 * FOLDS)]
#: Words of a chunk of the table, and words that a task remembers.
CHUNK, REMEMBER = 4_000_000, 300_000
_INK = np.ones(256, bool)
_INK[:48] = _INK[58:65] = _INK[91:97] = _INK[123:128] = False


def words_of(column: pa.Array) -> Iterator[tuple[int, int, pa.DictionaryArray, np.ndarray]]:
    """(first row, end row, words, each row's first word) of blocks of rows: runs of letters and digits, in lower case."""
    data, offsets = text_buffer(pc.utf8_lower(column.cast(pa.large_string())))
    for a, b in runs(offsets):
        d, o = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        ink = _INK[d]
        start = ink.copy()
        begins = np.zeros(len(d) + 1, bool)
        begins[o[:-1]] = True
        start[1:] &= ~ink[:-1] | begins[1 : len(d)]
        starts = np.flatnonzero(start)
        place = np.cumsum(ink)
        at = np.append(place[starts] - 1, place[-1] if len(d) else 0)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(np.ascontiguousarray(d[ink]))])
        yield a, b, words.dictionary_encode(), np.searchsorted(starts, o)


def _keys(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words; two words of one hash would count as one."""
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words)).view(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n0, n1, ...): in how many rows (packed text, mark) of each mark a word occurs."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        table = np.zeros((len(keys), 2 * FOLDS), np.int64)
        np.add.at(table, at, np.concatenate([n for _, n in held]))
        return keys, table

    def emit(keys: np.ndarray, table: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(c) for c in table.T)], ["key", *COUNTS])

    for batch in batches:
        mark = batch.column(1).to_numpy()
        texts = [_unpack(x) for x in batch.column(0).to_pylist()]
        for a, b, words, first in words_of(pa.array(texts, pa.large_string())):
            size = max(1, len(words.dictionary))
            row = np.repeat(np.arange(b - a), np.diff(first))
            once = np.unique(row * size + words.indices.to_numpy())
            table = np.zeros((len(words.dictionary), 2 * FOLDS), np.int64)
            np.add.at(table, (once % size, mark[a:b][once // size]), 1)
            held.append((_keys(words.dictionary.to_pylist()), table))
            waiting += len(table)
            if waiting > 2 * REMEMBER:
                held = [merged()]
                waiting = len(held[0][0])
                if waiting > REMEMBER:
                    yield emit(*held[0])
                    held, waiting = [], 0
    if held:
        yield emit(*merged())


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts in less room, before they travel to their labels."""
    import zstandard

    press = zstandard.ZstdCompressor(3)
    for batch in batches:
        packed = [press.compress(t.encode()) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["doc_id", "packed"])


def _unpack(packed: bytes) -> str:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(packed).decode()


def log_ratios(counted: DataFrame, models: list[tuple[Column, Column]]) -> DataFrame:
    """(key, v0, v1, ...) of counts by word: for each model (its ordinary and its toxic counts) the log ratio of a word, toxic to
    ordinary, less that of an unseen word; null where the model lacks the word or a class.

    The discount of a class is n1 / (n1 + 2 n2) of its words counted once and twice in the first model (0.5 where nothing tells, never
    under 0.1 nor over 0.95); all models take the same, so that their ratios are on one scale."""
    asked = []
    for k, counts in enumerate(models):
        for y, c in enumerate(counts):
            told = [F.sum(c), F.count_if(c > 0), F.count_if(c == 1), F.count_if(c == 2)]
            asked += [x.cast("double").alias(f"{name}{k}{y}") for name, x in zip(("sum", "seen", "one", "two"), told, strict=True)]
        asked.append(F.count_if(counts[0] + counts[1] > 0).cast("double").alias(f"kinds{k}"))
    got = counted.agg(*asked).first()
    values = []
    for k, counts in enumerate(models):
        sums = [got[f"sum{k}{y}"] or 0 for y in (0, 1)]
        if not all(sums):
            values.append(F.lit(None).cast("float").alias(f"v{k}"))
            continue
        shared = (counts[0] + counts[1] + 0.5) / (sum(sums) + 0.5 * got[f"kinds{k}"])
        p, left = [], []
        for y in (0, 1):
            one, two = got[f"one0{y}"], got[f"two0{y}"]
            d = min(max(one / (one + 2 * two), 0.1), 0.95) if one else 0.5
            left.append(d * got[f"seen{k}{y}"] / sums[y])
            p.append(F.greatest(counts[y] - d, F.lit(0.0)) / sums[y] + left[y] * shared)
        values.append(F.when(counts[0] + counts[1] > 0, F.log(p[1] / p[0]) - float(np.log(left[1] / left[0]))).cast("float").alias(f"v{k}"))
    return counted.select("key", *values)


def chunks_of(table: DataFrame) -> list:
    """Broadcasts of (keys, values) in order of keys, of about CHUNK words each; the driver has one at a time."""
    chunks = max(1, -(-table.count() // CHUNK))
    sent = []
    for k in range(chunks):
        found = table.where(F.pmod("key", F.lit(chunks)) == k).select("key", "value").toArrow()
        keys, values = found["key"].to_numpy(), found["value"].to_numpy()
        order = np.argsort(keys)
        sent.append(table.sparkSession.sparkContext.broadcast((keys[order], values[order])))
    return sent


def ratios(words: list[bytes], chunks: list) -> np.ndarray:
    """Log ratios of words, 0 for those not in the table."""
    keys = _keys(words)
    value = np.zeros(len(keys))
    for k, sent in enumerate(chunks):
        mine = np.flatnonzero(keys % len(chunks) == k)
        table, ratio = sent.value
        if len(table):
            at = np.minimum(np.searchsorted(table, keys[mine]), len(table) - 1)
            value[mine] = np.where(table[at] == keys[mine], ratio[at], 0)
        if len(chunks) > 1:
            vars(sent).pop("_value", None)  # read again from its file when it is needed again
    return value


def features(docs: DataFrame, chunks: list, carry: tuple[str, ...]) -> DataFrame:
    """Carried columns with `whole` and `stretch`, differences of log likelihood a word over the text and over the most toxic
    STRETCH words in a row (all, if it has fewer), null for a text without words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        values = np.zeros(1024)
        for batch in batches:
            whole, most = np.full(batch.num_rows, np.nan), np.full(batch.num_rows, np.nan)
            for a, b, words, first in words_of(batch.column(0)):
                own = words.dictionary.to_pylist()
                number = np.fromiter((known.get(w, -1) for w in own), np.int64, len(own))
                new = np.flatnonzero(number < 0)
                if len(new):
                    number[new] = len(known) + np.arange(len(new))
                    fresh = [own[i] for i in new]
                    while len(known) + len(new) > len(values):
                        values = np.concatenate((values, values))
                    values[number[new]] = np.log(1 - SHARE + SHARE * np.exp(ratios(fresh, chunks)))
                    known.update(zip(fresh, number[new].tolist(), strict=True))
                total = np.concatenate(([0], np.cumsum(values[number[words.indices.to_numpy()]])))
                begin, end = first[:-1], first[1:]
                some = end > begin
                whole[a:b][some] = most[a:b][some] = ((total[end] - total[begin]) / np.maximum(end - begin, 1))[some]
                row = np.repeat(np.arange(b - a), end - begin)
                i = np.arange(len(row))
                i = i[i + STRETCH <= end[row]]
                np.maximum.at(most[a:b], row[i], (total[i + STRETCH] - total[i]) / STRETCH)
                if len(known) > REMEMBER:
                    known = {}
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(1, batch.num_columns)), pa.array(whole, from_pandas=True), pa.array(most, from_pandas=True)], [*batch.schema.names[1:], "whole", "stretch"])

    rows = docs.select(F.col("text").cast("string").alias("_text"), *carry)
    return rows.mapInArrow(work, StructType([*rows.drop("_text").schema.fields, *StructType.fromDDL("whole double, stretch double").fields]))


def curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Offset and weights, none below 0, of a logistic regression with a slight penalty, by Newton's steps, each halved until it helps."""
    scale = np.maximum(x.std(axis=0), 1e-9)
    used = np.ones(x.shape[1], bool)
    while True:
        z = np.column_stack([np.ones(len(x)), x[:, used] / scale[used]])
        w, penalty = np.zeros(z.shape[1]), 0.01

        def loss(v: np.ndarray, z: np.ndarray = z, penalty: float = penalty) -> float:
            return float(np.logaddexp(0, np.where(y == 1, -1, 1) * (z @ v)).sum() + penalty / 2 * v @ v)

        now = loss(w)
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty * np.eye(len(w)), z.T @ (p - y) + penalty * w)
            size = 1.0
            while size > 1e-6 and loss(w - size * step) > now:
                size /= 2
            w = w - size * step
            before, now = now, loss(w)
            if before - now < 1e-9 * (1 + abs(now)):
                break
        if (w[1:] >= 0).all():
            break
        used[np.flatnonzero(used)[np.argmin(w[1:])]] = False
    out = np.zeros(1 + x.shape[1])
    out[0] = w[0]
    out[1:][used] = w[1:] / scale[used]
    return out


class Scorer:
    """What fit() learned: the share of toxic documents, the table of log ratios, offset and weights of the curve."""

    def __init__(self, share: float, chunks: list, weights: np.ndarray | None) -> None:
        self.share, self.chunks, self.weights = share, chunks, weights


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Scorer:
    """Learns from rows (doc_id, text) and labels (doc_id, toxic), toxic 0 or 1: counts of all labelled rows, the curve from
    about `sample` at most, chosen by a hash of the id. Null ids, texts and labels are left out; a document with several labels is
    toxic if one says so. Without documents of both classes there is no model, only the share of toxic ones (0 without labels)."""
    spread = F.xxhash64("doc_id")
    told = labels.where("doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kinds = {r["toxic"]: r["n"] for r in known.select("doc_id").join(told, "doc_id").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    total = sum(kinds.values())
    share = kinds.get(1, 0) / max(1, total)
    if len(kinds) < 2:
        return Scorer(share, [], None)
    packed = known.mapInArrow(_pack, "doc_id long, packed binary")
    # Both sides are sorted at any size: which texts have labels is known only after they met.
    marked = packed.join(told.hint("merge"), "doc_id").select("packed", (F.pmod(spread, F.lit(FOLDS)) * 2 + F.col("toxic")).cast("int").alias("mark"))
    parts = marked.mapInArrow(_count, "key long, " + ", ".join(f"{c} long" for c in COUNTS))
    counted = cut(parts.groupBy("key").agg(*[F.sum(c).alias(c) for c in COUNTS]))
    # The first model has all folds, each other one leaves one out.
    add = lambda y, out: sum((F.col(COUNTS[2 * k + y]) for k in range(FOLDS) if k != out), F.lit(0))
    table = log_ratios(counted, [(add(0, k), add(1, k)) for k in [None, *range(FOLDS)]])
    model = lambda k: chunks_of(table.select("key", F.col(f"v{k}").alias("value")).where("value is not null"))
    some = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 40)) < int(min(1.0, sample / total) * (1 << 40))
    picked = cut(known.where(some).join(told.where(some), "doc_id").select("text", "toxic", F.pmod(spread, F.lit(FOLDS)).alias("fold")))
    scored = [features(picked.where(F.col("fold") == k), model(k + 1), ("toxic",)).where("whole is not null").toArrow() for k in range(FOLDS)]
    found = pa.concat_tables(scored)
    x, y = np.column_stack([found["whole"].to_numpy(), found["stretch"].to_numpy()]), found["toxic"].to_numpy()
    weights = curve(x, y) if len(np.unique(y)) == 2 else None
    return Scorer(share, model(0) if weights is not None else [], weights)


def score(docs: DataFrame, scorer: Scorer, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns of every row with `score`, the probability that it is toxic, and `whole` and `stretch`; texts without
    words, and all texts if nothing was learned, have the share of toxic rows. Carried columns must not be called so."""
    if scorer.weights is None:
        return docs.select(*carry, F.lit(None).cast("double").alias("whole"), F.lit(None).cast("double").alias("stretch"), F.lit(float(scorer.share)).alias("score"))
    w = [float(v) for v in scorer.weights]
    z = F.lit(w[0]) + w[1] * F.col("whole") + w[2] * F.col("stretch")
    return features(docs, scorer.chunks, carry).withColumn("score", F.coalesce(1 / (1 + F.exp(-z)), F.lit(float(scorer.share))))


def held_out() -> Column:
    """Whether a document's label is kept from learning."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def op13_toxicity(spark, sf_dir: str) -> DataFrame:
    """How likely each document is toxic, learned from the labels of those that are not held out.

    Rows without doc_id are never held out and have no label. Null and empty texts have the share of toxic documents as their
    score; repeated rows are learned from and returned each; an empty table gives an empty table.
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    made = score(docs, fit(docs.where(~held_out()), read_table(spark, sf_dir, "labels").where(~held_out())))
    return made.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "whole", "stretch")
