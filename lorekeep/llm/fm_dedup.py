"""Removal of word windows that start in an earlier document, by FM-indexes of the shared passages."""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table
from .passages import Rule, earlier_passages, plain_ids, spans_of
from .suffix import suffix_array
from .suffix_dedup import joined, window_groups

#: Words of a minimizer.
GRAM = 8


class WaveletMatrix:
    """Ranks of symbols in a sequence: one packed bit row for each bit of a symbol, with a count for every 64 bits."""

    def __init__(self, sequence: np.ndarray, kinds: int) -> None:
        self.levels = []
        current = sequence.astype(np.int64)
        for level in reversed(range(max(1, int(kinds - 1).bit_length()))):
            bit = (current >> level) & 1
            packed = np.packbits(np.append(bit, np.zeros(-len(bit) % 64 + 64, np.int64)).astype(np.uint8), bitorder="little").view(np.uint64)
            counts = np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64))).astype(np.int32)
            self.levels.append((level, packed, counts, int(len(bit) - bit.sum())))
            current = np.concatenate((current[bit == 0], current[bit == 1]))

    def rank(self, symbol: np.ndarray, place: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Number of each symbol before the place; start is where the matrix has the symbol's block."""
        for level, packed, counts, zeros in self.levels:
            word = place >> 6
            ones = counts[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)))
            place = np.where((symbol >> level) & 1 == 1, zeros + ones, place - ones)
        return place - start

    def starts(self, kinds: int) -> np.ndarray:
        symbol = np.arange(kinds)
        return self.rank(symbol, np.zeros(kinds, np.int64), np.zeros(kinds, np.int64))


class FmIndex:
    """Backward search over the pieces of a bucket."""

    def __init__(self, text: np.ndarray, sa: np.ndarray) -> None:
        kinds = int(text.max()) + 1
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=kinds))))
        self.matrix = WaveletMatrix(text[sa - 1], kinds)
        self.start = self.matrix.starts(kinds)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges after putting a symbol in front."""
        base, start = self.first[symbol], self.start[symbol]
        return base + self.matrix.rank(symbol, low, start), base + self.matrix.rank(symbol, high, start)


def earliest_by_index(symbols: np.ndarray, sizes: np.ndarray, ids: np.ndarray, span: int) -> np.ndarray:
    """For each window of each piece the smallest id of a piece with that window.

    Pieces stream through the index from their right ends, side by side. The state is a suffix range
    and the length that it matches; once the length exceeds the span, the range is widened to all
    suffixes that agree in the first `span` symbols, so each place gives its matching statistic cut
    at the threshold. A place that reaches the threshold reports its range.
    """
    _, ranked = np.unique(symbols, return_inverse=True)
    text, starts = joined(ranked, sizes)
    sa = suffix_array(text)
    begins = window_groups(text, sa, starts, sizes, span)
    begin_at = np.flatnonzero(begins)
    group = np.cumsum(begins) - 1
    owner = np.full(len(text), np.iinfo(np.int64).max)
    windows = sizes - span + 1
    at = np.repeat(starts - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
    owner[at] = np.repeat(ids, windows)
    least = np.minimum.reduceat(owner[sa], begin_at)
    begin_end = np.append(begin_at, len(sa))
    index = FmIndex(text, sa)

    by = np.argsort(-sizes, kind="stable")
    start, size = starts[by], sizes[by]
    low, high = np.zeros(len(by), np.int64), np.full(len(by), len(text), np.int64)
    out = np.full(len(text), np.iinfo(np.int64).max)
    for k in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -k, "left"))
        place = start[:n] + size[:n] - 1 - k
        low, high = index.extend(text[place].astype(np.int64), low[:n], high[:n])
        if k + 1 >= span:
            g = group[low]
            low, high = begin_end[g], begin_end[g + 1]
            out[place] = least[g]
    return out[at]


def remove_windows(docs: DataFrame, span: int = 50) -> DataFrame:
    """(doc_id, n_words, kept, spans) for every row: each word in a window of `span` words that also starts in a
    document of smaller doc_id is removed; kept are the other words, joined by one space, spans the removed runs of words.

    Words are `[^\\x20\\x09-\\x0D]+`. Null, empty and blank texts have none. Rows of the same doc_id are one
    document's, so neither is earlier; a null doc_id is later than any.
    """

    def finish(table: pa.Table, offsets: np.ndarray, covered: np.ndarray) -> pa.Table:
        kept, spans = [], []
        for text, a, b in zip(table["text"].to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            found, mine = (text or "").encode().split(), covered[a:b]
            starts, ends = spans_of(mine)
            spans.append([{"start": int(s), "end": int(e)} for s, e in zip(starts, ends, strict=True)])
            kept.append(b" ".join(compress(found, (~mine).tolist()) if len(starts) else found).decode())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"doc_id": plain_ids(table["doc_id"].to_numpy()), "n_words": pa.array(np.diff(offsets), pa.int64()), "kept": pa.array(kept, pa.string()), "spans": pa.array(spans, kind)})

    return earlier_passages(docs, Rule(span, min(GRAM, span), True), earliest_by_index, finish, "doc_id long, n_words long, kept string, spans array<struct<start:long,end:long>>")


def op10_fm_dedup(spark, sf_dir: str) -> DataFrame:
    """What `remove_windows` leaves of every document, as digests; null and empty texts have no words."""
    made = remove_windows(read_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return made.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
