"""Benchmark decontamination by pigeonhole edit matching.

With a budget of e edits an item that occurs in a text keeps at least one of its e + 1 pieces
unchanged. The pieces of all items are found in one Aho-Corasick pass over a text, each hit gives the
place where the item would lie, and Myers' bit-parallel distance decides there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import runs, text_buffer
from .common import read_table

#: Edits allowed for each character of an item.
RATE = 0.05
#: Bytes of items that are sent to the executors at once; more items are searched in further passes.
BLOCK_BYTES = 8 << 20


def normal(text: str | None) -> str:
    """Lower case, each white space one blank."""
    return " ".join((text or "").lower().split())


def pieces(item: str, rate: float = RATE) -> tuple[int, list[tuple[int, str]]]:
    """The edit budget and the budget + 1 pieces (offset, text)."""
    budget = int(rate * len(item))
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return budget, [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def positions(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def myers(masks: dict[str, int], size: int, text: str) -> tuple[int, int]:
    """Least edit distance of a pattern to a part of the text, and the first end where it is reached."""
    full, top = (1 << size) - 1, 1 << (size - 1)
    up, down, score = full, 0, size
    best, end = size, 0
    get = masks.get
    for i, c in enumerate(text, 1):
        eq = get(c, 0)
        x = eq | down
        d = (((eq & up) + up) ^ up) | eq
        plus = down | ~(d | up) & full
        minus = up & d
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus = plus << 1 & full
        minus = minus << 1 & full
        up = minus | ~(x | plus) & full
        down = plus & x
        if score < best:
            best, end = score, i
    return best, end


def _whole(text: str, start: int, end: int) -> bool:
    """Whether no ASCII letter or digit goes on beyond either end."""
    joins = lambda a, b: a.isascii() and b.isascii() and a.isalnum() and b.isalnum()
    return not (start and joins(text[start - 1], text[start])) and not (end < len(text) and joins(text[end - 1], text[end]))


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float) -> None:
        import ahocorasick

        self.items, self.found = [], ahocorasick.Automaton()
        where: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            plain = normal(text)
            if not plain:
                continue
            budget, parts = pieces(plain, rate)
            for at, part in parts:
                where.setdefault(part, []).append((len(self.items), at))
            self.items.append((item_id, plain, budget, positions(plain), positions(plain[::-1])))
        for part, owners in where.items():
            self.found.add_word(part, (len(part), owners))
        if where:
            self.found.make_automaton()
        self.empty = not where

    def match(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, start, end, distance) of each item's best place in the normalised text."""
        spots: dict[int, set[int]] = {}
        for end, (size, owners) in self.found.iter(text):
            for item, at in owners:
                spots.setdefault(item, set()).add(end + 1 - size - at)
        out = []
        for item, begins in spots.items():
            item_id, plain, budget, masks, back = self.items[item]
            n = len(plain)
            best = None
            exact = next((b for b in sorted(begins) if b >= 0 and text.startswith(plain, b) and (budget or _whole(text, b, b + n))), None)
            if exact is not None:
                best = (0, exact, exact + n)
            elif budget:
                windows: list[list[int]] = []  # of nearby hits together
                for b in sorted(begins):
                    if windows and b - budget <= windows[-1][1]:
                        windows[-1][1] = b + n + budget
                    else:
                        windows.append([max(0, b - budget), b + n + budget])
                for lo, hi in windows:
                    distance, end = myers(masks, n, text[lo:hi])
                    if distance <= budget and (best is None or distance < best[0]):
                        _, length = myers(back, n, text[lo : lo + end][::-1][: n + budget])
                        best = (distance, lo + end - length, lo + end)
            if best:
                out.append((item_id, best[1], best[2], best[0]))
        return sorted(out)


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items, in blocks of bounded size."""
    known = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").dropDuplicates()
    size = known.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    n = max(1, -(-size // BLOCK_BYTES))
    for k in range(n):
        yield sorted(((r["item_id"], r["text"]) for r in known.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).collect()), key=lambda x: (x[0] is None, x))


def _matcher(spark, items: list[tuple[int, str]], rate: float) -> Callable[[], Matcher]:
    sent = spark.sparkContext.broadcast(items)
    return lambda: Matcher(sent.value, rate)


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, item_id, start, end, distance): each item that occurs in a document with at most rate * length edits.

    Places are characters of the normalised text (lower case, white space as one blank); of several
    the one of least distance counts, then the first. Items of fewer than 1 / rate characters have no
    edits and match whole words only. Null and empty texts and items match nothing; of repeated rows
    each is reported; a null doc_id or item_id stays null; texts may be of any length; further columns
    are left out. For each BLOCK_BYTES of items the documents are read once.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for items in _blocks(benchmark):
        load = _matcher(docs.sparkSession, items, rate)

        def work(batches: Iterator[pa.RecordBatch], load=load) -> Iterator[pa.RecordBatch]:
            matcher = load()
            for batch in batches:
                found = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if not matcher.empty and text.is_valid:
                        found += [(doc, *m) for m in matcher.match(normal(text.as_py()))]
                columns = list(zip(*found, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "start", "end", "distance"])

        made = rows.mapInArrow(work, "doc_id long, item_id long, start long, end long, distance long")
        out = made if out is None else out.unionByName(made)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of docs, all columns of whatever names, whose text holds no item: null and empty texts stay, repeated rows all
    stay or all go, an empty table gives an empty table."""
    kept = docs
    for items in _blocks(benchmark):
        load = _matcher(docs.sparkSession, items, rate)

        def work(batches: Iterator[pa.RecordBatch], load=load) -> Iterator[pa.RecordBatch]:
            matcher = load()
            for batch in batches:
                column = batch.column(batch.schema.get_field_index("text"))
                _, offsets = text_buffer(column)
                for a, b in runs(offsets):
                    clean = [matcher.empty or not t.is_valid or not matcher.match(normal(t.as_py())) for t in column.slice(a, b - a)]
                    yield batch.slice(a, b - a).filter(pa.array(clean, pa.bool_()))

        kept = kept.mapInArrow(work, docs.schema)
    return kept


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every benchmark item in every document, as `contaminated` gives it."""
    return contaminated(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"))
