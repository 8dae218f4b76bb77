"""Languages of spans and of whole texts: script ranges, word scores, and Viterbi with a switching penalty.

A model holds log likelihoods of letter trigrams by language, learned here from labelled rows. A
word's script leaves only the languages that are written in it; its score for each of them is the
sum over its trigrams. Viterbi over the words of a text, with a penalty for each switch, labels
spans; all texts of a batch take each step together.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .arrays import runs, text_buffer
from .common import read_table

#: Distinct labelled texts of a language that are learned from.
ROWS = 2000
#: A switch costs as much as a word that is so much likelier in the other language; scores of a word differ by WORD at most.
SWITCH, WORD = 6.0, 10.0
#: Words that a worker remembers.
REMEMBER = 300_000
# Unicode ranges of scripts (first and last code point).
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
}
_STARTS = sorted((a, b, s) for s, x in SCRIPTS.items() for a, b in x)


def script_of(char: str) -> str:
    code = ord(char)
    return next((s for a, b, s in _STARTS if a <= code <= b), "other")


def letters(token: str) -> str:
    return token if token.isalpha() else "".join(c if c.isalpha() else " " for c in token)


def grams_of(token: str) -> list[str]:
    """Letter trigrams of each run of letters, with its ends marked."""
    return [w[i : i + 3] for run in letters(token).split() for w in (f"^{run}$",) for i in range(len(w) - 2)]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams: Counter[tuple[str, str]] = Counter()
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for token, n in Counter((text or "").lower().split()).items():
                for g in grams_of(token):
                    grams[lang, g] += n
                for c in letters(token):
                    if c != " ":
                        grams[lang, f"#{script_of(c)}"] += n
        if len(grams) > 500_000:
            yield _counted(grams)
            grams.clear()
    yield _counted(grams)


def _counted(grams: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in grams], pa.string()), pa.array([k[1] for k in grams], pa.string()), pa.array(list(grams.values()), pa.int64())], ["lang", "gram", "n"])


class Model:
    """Languages, the scripts they use, and log likelihoods of their trigrams."""

    def __init__(self, rows: list) -> None:
        self.langs = sorted({r["lang"] for r in rows})
        at = {x: i for i, x in enumerate(self.langs)}
        k = len(self.langs)
        scripts: dict[str, np.ndarray] = {}
        self.number: dict[str, int] = {}
        for r in rows:
            if r["gram"][0] == "#" and len(r["gram"]) > 3:
                scripts.setdefault(r["gram"][1:], np.zeros(k))[at[r["lang"]]] += r["n"]
            else:
                self.number.setdefault(r["gram"], len(self.number))
        counts = np.zeros((len(self.number) + 1, k))
        for r in rows:
            if r["gram"] in self.number:
                counts[self.number[r["gram"]], at[r["lang"]]] = r["n"]
        total = counts.sum(axis=0)
        self.table = np.log((counts + 0.5) / (total + 0.5 * (len(self.number) + 1))).astype(np.float32)  # the last row: an unknown trigram
        self.table[-1] = self.table[-1].max(initial=0) if k else 0
        written = sum(scripts.values(), np.zeros(k))
        #: Languages that a script leaves: those with a twentieth of their letters in it.
        self.allowed = {s: x >= 0.05 * np.maximum(written, 1) for s, x in scripts.items()}
        self.prior = int(total.argmax()) if k else 0


class Labeller:
    def __init__(self, model: Model) -> None:
        self.model = model
        self.reset()

    def reset(self) -> None:
        k = len(self.model.langs)
        self.known: dict[str, int] = {}
        self.scores = np.zeros((1024, k), np.float32)
        self.letters = np.zeros(1024, np.int32)

    def learn(self, tokens: set[str]) -> None:
        model, number, unknown = self.model, self.model.number, len(self.model.number)
        new = sorted(t for t in tokens if t not in self.known)
        if not new:
            return
        base = len(self.known)
        self.known.update(zip(new, range(base, base + len(new)), strict=True))
        while len(self.known) > len(self.letters):
            self.scores = np.concatenate((self.scores, np.zeros_like(self.scores)))
            self.letters = np.concatenate((self.letters, np.zeros_like(self.letters)))
        ids: list[int] = []
        sizes, limits = [], {}
        for i, t in enumerate(new):
            plain = letters(t)
            self.letters[base + i] = len(plain) - plain.count(" ")
            found = [number.get(w[j : j + 3], unknown) for run in plain.split() for w in (f"^{run}$",) for j in range(len(w) - 2)]
            sizes.append(len(found))
            ids += found
            if not plain.isascii():
                script = Counter(script_of(c) for c in plain if c != " ").most_common(1)
                if script and script[0][0] != "latin":
                    limits[base + i] = script[0][0]
        sums = np.zeros((len(new), len(model.langs)), np.float32)
        size = np.array(sizes)
        if ids:
            at = np.cumsum(size) - size
            sums[size > 0] = np.add.reduceat(model.table[np.array(ids)], at[size > 0], axis=0)
        latin = model.allowed.get("latin")
        if latin is not None and latin.any():
            sums[:, ~latin] -= 1e6
        for i, script in limits.items():
            fits = model.allowed.get(script)
            row = sums[i - base] + (0 if latin is None or not latin.any() else np.where(latin, 0, 1e6))
            sums[i - base] = row if fits is None or not fits.any() else np.where(fits, row, -1e6)
        sums = np.maximum(sums - sums.max(axis=1, keepdims=True, initial=-1e9), -WORD)
        sums[size == 0] = 0
        self.scores[base : base + len(new)] = sums

    def label(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word labels of all texts in a row, the words' letters, and where each text's words start."""
        tokens = [(t or "").lower().split() for t in texts]
        self.learn(set().union(*tokens))
        first = np.concatenate(([0], np.cumsum([len(t) for t in tokens])))
        get = self.known.__getitem__
        ids = np.fromiter((get(t) for row in tokens for t in row), np.int64, int(first[-1]))
        paths = viterbi(self.scores, ids, first)
        return paths, self.letters[ids], first


def viterbi(scores: np.ndarray, ids: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label of each word of each row; a change of label costs `switch`; ties keep the label, then take the first."""
    k = scores.shape[1]
    length = np.diff(first)
    by = np.argsort(-length, kind="stable")
    start, length = first[:-1][by], length[by]
    steps = int(length[0]) if len(length) else 0
    alive = np.searchsorted(-length, -np.arange(steps), "left")
    small = np.min_scalar_type(max(k - 1, 0))
    came = np.zeros((len(ids), k), small)
    label = np.zeros(len(ids), small)
    value = np.zeros((len(by), k), np.float32)
    own = np.arange(k, dtype=small)
    ends = np.zeros(len(by), small)
    for t in range(steps):
        n = alive[t]
        if n < len(value):
            ends[n : len(value)] = value[n:].argmax(axis=1)
            value = value[:n]
        at = start[:n] + t
        best = value.argmax(axis=1)
        leap = value[np.arange(n), best][:, None] - switch
        jump = leap > value
        came[at] = np.where(jump, best[:, None].astype(small), own)
        value = np.where(jump, leap, value) + scores[ids[at]]
    ends[: len(value)] = value.argmax(axis=1) if k else 0
    state = np.zeros(0, small)
    for t in range(steps - 1, -1, -1):
        n = alive[t]
        if n > len(state):
            state = np.concatenate((state, ends[len(state) : n]))
        at = start[:n] + t
        label[at] = state
        state = came[at, state]
    return label


def fit(labelled: DataFrame, rows: int = ROWS) -> Model:
    """Learns from text and non-null lang, from at most about `rows` distinct texts a language and at least one, chosen by
    a hash of the text, and whole texts. Null, blank and rare languages' rows need no care; no rows give a model without languages.

    The driver gets one count for each trigram and language of the sample: at most as many as the sample has letters, and all
    of them, whatever the number of languages."""
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text")
    hashed = known.withColumn("h", F.xxhash64("text"))
    # Copies of a text count once: they are one text to learn from. Only hashes are shuffled.
    count = hashed.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("count"), F.min("h").alias("least"))
    share = F.least(F.lit(1.0), F.lit(float(rows)) / F.col("count"))
    chosen = (F.pmod("h", F.lit(1 << 40)) < share * (1 << 40)) | (F.col("h") == F.col("least"))
    sample = hashed.join(F.broadcast(count), "lang").where(chosen).select("lang", "text").distinct()
    grams = sample.mapInArrow(_counts, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return Model(grams.collect())


def identify(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns of every row with lang_pred, score and spans: the language with most letters, its share of
    them, and the labelled spans (lang, first word, end word).

    `und`, score 0 and no spans where text is null or has no letter, or nothing was learned. Ties go to the first
    language by name. Texts may be of any length. Carried columns must not be called lang_pred, score or spans: pack
    columns of any name in one struct.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("lang", pa.string()), ("first", pa.int64()), ("end", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(sent.value)
        k = len(labeller.model.langs)
        names = pa.array(labeller.model.langs, pa.string())
        for batch in batches:
            column = batch.column(0)
            _, offsets = text_buffer(column)
            for a, b in runs(offsets, max(1 << 20, (32 << 20) // max(k, 4))):
                texts = column.slice(a, b - a).to_pylist()
                pred, share, lists = ["und"] * len(texts), np.zeros(len(texts)), pa.array([[]] * len(texts), pa.list_(span))
                if k:
                    path, weight, first = labeller.label(texts)
                    doc = np.repeat(np.arange(len(texts)), np.diff(first))
                    mass = np.bincount(doc * k + path, weights=weight, minlength=len(texts) * k).reshape(len(texts), k)
                    total = mass.sum(axis=1)
                    share = np.where(total > 0, mass.max(axis=1) / np.maximum(total, 1), 0.0)
                    pred = [labeller.model.langs[i] if n else "und" for i, n in zip(mass.argmax(axis=1).tolist(), total.tolist(), strict=True)]
                    change = np.ones(len(path), bool)
                    change[1:] = (path[1:] != path[:-1]) | (doc[1:] != doc[:-1])
                    at = np.flatnonzero(change)
                    end = np.append(at[1:], len(path))
                    real = total[doc[at]] > 0
                    at, end = at[real], end[real]
                    found = pa.StructArray.from_arrays([names.take(pa.array(path[at])), pa.array(at - first[doc[at]]), pa.array(end - first[doc[at]])], fields=list(span))
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(doc[at], minlength=len(texts))))).astype(np.int32)), found)
                kept = [batch.column(i).slice(a, b - a) for i in range(1, batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(pred), pa.array(share), lists], [*batch.schema.names[1:], "lang_pred", "score", "spans"])
                if len(labeller.known) > REMEMBER:
                    labeller.reset()

    rows = docs.select(F.col("text").cast("string").alias("_text"), *carry)
    schema = StructType([*rows.drop("_text").schema.fields, *_parse("lang_pred string, score double, spans array<struct<lang:string,first:bigint,end:bigint>>")])
    return rows.mapInArrow(work, schema)


def _parse(ddl: str) -> list:
    return StructType.fromDDL(ddl).fields


def held_out():
    """Whether a document is kept from learning."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def op2_langid(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out.

    Null and empty texts and texts without a letter are `und` with score 0; rows without doc_id are never held out;
    repeated rows are returned each; an empty table gives an empty table.
    """
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()).select("lang", "text"))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
