"""Repeated passages across documents: where does a window of `span` symbols start in an earlier document?

Equal windows have equal minimizers (the gram of least hash in the window, the first of equal ones). Windows
with the same minimizer follow each other in runs. A run has up to two halves: in one all windows begin far
before the minimizer, in the other all end far behind it, so each half has a second gram in all its windows.
Documents lie in chunks of bounded size:

1. each chunk asks, for its distinct halves (hash of both grams), which of them other chunks have too;
   requests are packed by hash bucket and answered with one bit each, so a very common passage costs a
   chunk one hash, not a row for each document;
2. shared halves are sent to the bucket of their minimizer as pieces, once for each different text in a
   chunk; where a bucket counts too many of them around a few minimizers, each window is a piece of its
   own and goes to the bucket of its own hash, so no bucket gathers all surroundings of a common phrase;
3. a bucket indexes what its pieces may have in common (a window whose hash comes up once is its piece's own) and
   answers, for each window of each piece, the smallest doc_id;
4. the chunk marks the symbols of windows that an earlier document has.

Hashes choose what meets where; pieces of equal hash are compared before they count as one, and the index
compares the symbols. All answers go back by chunk.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import _VALUE, U, mix, text_buffer, words
from .common import NO_ID, text_bytes

#: Bytes of text in a chunk, and bytes of text for each bucket of minimizers.
CHUNK_BYTES, BUCKET_BYTES = 4 << 20, 8 << 20
#: Windows that are looked at together: few enough for the processor's cache.
WINDOWS = 1 << 16
_PLACE = U((1 << 17) - 1)
#: Requests of one group of minimizers (a bucket has 4096 groups, 250 requests each on average) from which its windows travel singly.
HOT = 4096


@dataclass(frozen=True)
class Rule:
    """span: symbols of a window; gram: symbols of its minimizer; lexical: symbols are words, else bytes."""

    span: int
    gram: int
    lexical: bool

    @property
    def width(self) -> int:
        if not 1 <= self.span - self.gram + 1 <= 64:
            raise ValueError("a window must hold 1 to 64 grams")
        return self.span - self.gram + 1

    def symbols(self, table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = text_buffer(table["text"])
        return words(data, offsets) if self.lexical else (data, offsets)


def _values(symbols: np.ndarray) -> np.ndarray:
    return _VALUE[symbols] if symbols.dtype == np.uint8 else symbols


def _grams(v: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k symbols in a row, by doubling."""
    out, done, length = None, 0, 1
    h = v
    while True:
        if k & length:
            out, done = (h, length) if out is None else (out[: len(h) - done] * U(0x9E3779B97F4A7C15) + h[done:][: len(out)], done + length)
        if length * 2 > k:
            return mix(out[: len(v) - k + 1])
        h = h[:-length] * (U(0xD1B54A32D192ED03) + U(2 * length)) + h[length:]
        length *= 2


def _least(key: np.ndarray, width: int) -> np.ndarray:
    length = 1
    n = len(key) - width + 1
    while length * 2 <= width:
        key = np.minimum(key[:-length], key[length:])
        length *= 2
    return np.minimum(key[:n], key[width - length :][:n])


@dataclass(frozen=True)
class Runs:
    """Windows in runs that share their minimizer: first and last window, the first window of the second half,
    the minimizer's hash, and the hashes of both halves (of the grams before and behind it)."""

    first: np.ndarray
    last: np.ndarray
    split: np.ndarray
    value: np.ndarray
    left: np.ndarray
    right: np.ndarray


def minimizer_runs(symbols: np.ndarray, offsets: np.ndarray, rule: Rule) -> Runs:
    """The runs of all rows. No window crosses rows."""
    n, span, width = len(symbols), rule.span, rule.width
    half = width // 2
    found: list[tuple[np.ndarray, ...]] = []
    inner = offsets[1:-1]
    for s in range(0, n - span + 1, WINDOWS):
        e = min(n - span + 1, s + WINDOWS)
        h = _grams(_values(symbols[s : e - 1 + span]), rule.gram)
        least = _least((h & ~_PLACE) | np.arange(len(h), dtype=U), width) & _PLACE
        edge = np.zeros(e - s + 1, np.int32)
        near = inner[np.searchsorted(inner, s, "right") : np.searchsorted(inner, e - 1 + span, "left")]
        new = np.ones(e - s, bool)
        new[1:] = least[1:] != least[:-1]
        last = np.append(new[1:], True)
        if len(near):
            np.add.at(edge, np.maximum(near - span + 1 - s, 0), 1)
            np.add.at(edge, np.minimum(near - s, e - s), -1)
            valid = np.cumsum(edge[:-1], dtype=np.int32) == 0
            new[1:] |= ~valid[:-1]
            new &= valid
            last[:-1] |= ~valid[1:]
            last &= valid
        first, last = np.flatnonzero(new), np.flatnonzero(last)
        place = least[first].astype(np.int64)
        at = h[place]
        before, behind = h[np.maximum(place - half, 0)], h[np.minimum(place + half, len(h) - 1)]
        left, right = mix(before * U(0xA0761D6478BD642F) + at), mix(at * U(0xE7037ED1A0B428DB) + behind)
        found.append((first + s, last + s, place - half + 1 + s, at, left, right))
    if not found:
        return Runs(*[np.zeros(0, np.int64)] * 3, *[np.zeros(0, U)] * 3)
    return Runs(*[np.concatenate(x) for x in zip(*found, strict=True)])


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one after the other."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)


_BASE = 0x9E3779B97F4A7C15


def _piece_hashes(symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of pieces in order of their starts, as differences of sums over the text that are moved back to where a piece begins."""
    out = np.zeros(len(starts), U)
    if not len(starts):
        return out
    most = WINDOWS + int(sizes.max())
    power = np.multiply.accumulate(np.concatenate((np.ones(1, U), np.full(most, _BASE, U))))
    back = np.multiply.accumulate(np.concatenate((np.ones(1, U), np.full(WINDOWS, pow(_BASE, -1, 1 << 64), U))))
    edges = np.searchsorted(starts, np.arange(0, int(starts[-1]) + WINDOWS + 1, WINDOWS))
    for s, (a, e) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
        if a < e:
            v = mix(_values(symbols[s * WINDOWS : s * WINDOWS + most]))
            v *= power[: len(v)]
            sums = np.zeros(len(v) + 1, U)
            np.cumsum(v, out=sums[1:])
            first = starts[a:e] - s * WINDOWS
            out[a:e] = mix((sums[first + sizes[a:e]] - sums[first]) * back[first] + sizes[a:e].astype(U))
    return out


def _same(symbols: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the symbols from a and from b on are the same."""
    out = np.ones(len(a), bool)
    for k in range(0, len(a), 1 << 14):
        size = sizes[k : k + (1 << 14)]
        equal = symbols[_ranges(a[k : k + (1 << 14)], size)] == symbols[_ranges(b[k : k + (1 << 14)], size)]
        out[k : k + (1 << 14)] = np.logical_and.reduceat(equal, np.cumsum(size) - size)
    return out


def _repeated(symbols: np.ndarray, sizes: np.ndarray, span: int) -> np.ndarray:
    """Whether the hash of each window of the pieces comes up again among them."""
    ends, windows = np.cumsum(sizes), sizes - span + 1
    starts, hashes = ends - sizes, np.empty(int(windows.sum()), U)
    k = 0
    for a in range(0, len(sizes), 1 << 10):
        b = min(a + (1 << 10), len(sizes))
        found = _grams(_values(symbols[starts[a] : ends[b - 1]]), span)[_ranges(starts[a:b] - starts[a], windows[a:b])]
        hashes[k : k + len(found)] = found
        k += len(found)
    order = np.argsort(hashes)
    hashes = hashes[order]
    same = np.flatnonzero(hashes[1:] == hashes[:-1])
    again = np.zeros(len(order), bool)
    again[order[same]] = again[order[same + 1]] = True
    return again


def _sorted(table: pa.Table) -> pa.Table:
    """Rows come in another order each time they are read from a shuffle; runs and pieces need one order."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


class Chunk:
    """What one chunk of documents asks for and sends."""

    def __init__(self, table: pa.Table, rule: Rule, buckets: int) -> None:
        table = _sorted(table)
        self.rule, self.buckets = rule, buckets
        self.symbols, self.offsets = rule.symbols(table)
        with np.errstate(over="ignore"):
            runs = minimizer_runs(self.symbols, self.offsets, rule)
            self.bucket = (runs.value % U(buckets)).astype(np.int64)
            group = (self.bucket.astype(U) << U(32)) | ((mix(runs.value) >> U(52)) << U(20))
        self.first, self.last, self.split = runs.first, runs.last, runs.split
        self.doc = np.searchsorted(self.offsets, self.first, "right") - 1
        self.owner = table["doc_id"].to_numpy()[self.doc]
        # Halves: the left ones of all runs, then the right ones.
        self.lefts, self.rights = np.flatnonzero(self.first < self.split), np.flatnonzero(self.last >= self.split)
        code = np.concatenate((group[self.lefts] | (runs.left[self.lefts] >> U(44)), group[self.rights] | (runs.right[self.rights] >> U(44))))
        self.codes, self.which, self.count = np.unique(code, return_inverse=True, return_counts=True)
        place = (self.codes >> U(32)).astype(np.int64)
        self.asks, self.ask_at = np.unique(place, return_index=True)
        self.ask_end = np.append(self.ask_at[1:], len(place))[: len(self.asks)]

    def requests(self) -> Iterator[dict]:
        for b, a, e in zip(self.asks.tolist(), self.ask_at, self.ask_end, strict=True):
            more = np.minimum(self.count[a:e] >> 4, 255).astype(np.uint8)
            yield {"bucket": b, "asked": self.codes[a:e].astype(np.uint32).tobytes(), "more": more.tobytes() if more.any() else None}

    def choose(self, answers: dict[int, tuple[bytes, bytes | None]]) -> None:
        """Keeps the halves that another document has, as pieces; equal pieces of a bucket become one."""
        shared, hot = np.zeros(len(self.codes), bool), np.zeros(len(self.codes), bool)
        for b, a, e in zip(self.asks.tolist(), self.ask_at, self.ask_end, strict=True):
            if b in answers:
                for into, bits in zip((shared, hot), answers[b], strict=True):
                    if bits is not None:
                        into[a:e] = np.unpackbits(np.frombuffer(bits, np.uint8), count=e - a).astype(bool)
        if len(self.which):
            owner = self.owner[np.concatenate((self.lefts, self.rights))]
            order = np.argsort(self.which, kind="stable")
            at = np.cumsum(self.count) - self.count
            shared |= np.minimum.reduceat(owner[order], at) < np.maximum.reduceat(owner[order], at)
        n = len(self.first)
        kept, single = np.zeros((2, n), bool), np.zeros((2, n), bool)
        for side, runs, mine in ((0, self.lefts, self.which[: len(self.lefts)]), (1, self.rights, self.which[len(self.lefts) :])):
            kept[side, runs] = shared[mine] & ~hot[mine]
            single[side, runs] = shared[mine] & hot[mine]
        first = np.where(kept[0], self.first, np.maximum(self.first, self.split))
        last = np.where(kept[1], self.last, np.minimum(self.last, self.split - 1))
        run = np.flatnonzero(kept[0] | kept[1])
        first, last = first[run], last[run]
        windows, of = [first], [run]
        for side, a, e in ((0, self.first, np.minimum(self.last, self.split - 1)), (1, np.maximum(self.first, self.split), self.last)):
            at = np.flatnonzero(single[side])
            windows.append(_ranges(a[at], e[at] - a[at] + 1))
            of.append(np.repeat(at, e[at] - a[at] + 1))
        alone = len(windows[1]) + len(windows[2])
        start, run = np.concatenate(windows), np.concatenate(of)
        size = np.concatenate((last - first, np.zeros(alone, np.int64))) + self.rule.span
        by = np.argsort(start, kind="stable")
        start, run, size, alone = start[by], run[by], size[by], np.repeat([False, True], [len(first), alone])[by]
        with np.errstate(over="ignore"):
            hashed = _piece_hashes(self.symbols, start, size)
            bucket = np.where(alone, (hashed % U(self.buckets)).astype(np.int64), self.bucket[run])
        order = np.lexsort((size, hashed, bucket))
        again = (hashed[order][1:] == hashed[order][:-1]) & (bucket[order][1:] == bucket[order][:-1]) & (size[order][1:] == size[order][:-1])
        maybe = np.flatnonzero(again)
        again[maybe] = _same(self.symbols, start[order[maybe]], start[order[maybe + 1]], size[order[maybe]])
        at = np.flatnonzero(np.concatenate((np.ones(min(1, len(order)), bool), ~again)))
        self.piece_start, self.piece_hash, self.piece_bucket, self.piece_size = start[order[at]], hashed[order[at]], bucket[order[at]], size[order[at]]
        owner = self.owner[run][order]
        self.piece_id = np.minimum.reduceat(owner, at) if len(at) else owner
        piece = np.empty(len(order), np.int64)
        piece[order] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(order))))
        self.start, self.piece = start, piece

    def pieces(self) -> Iterator[dict]:
        for b in np.unique(self.piece_bucket).tolist():
            a, e = np.searchsorted(self.piece_bucket, b), np.searchsorted(self.piece_bucket, b, "right")
            where = _ranges(self.piece_start[a:e], self.piece_size[a:e])
            yield {"bucket": b, "hashes": self.piece_hash[a:e].tobytes(), "sizes": self.piece_size[a:e].astype(np.uint16).tobytes(), "ids": self.piece_id[a:e].tobytes(), "symbols": zlib.compress(self.symbols[where].tobytes(), 1)}

    def own(self) -> bytes:
        """What `covered` needs: row offsets, and the pieces' buckets, windows and places."""
        parts = (self.offsets, np.diff(self.piece_bucket, prepend=0), self.piece_size - self.rule.span + 1, np.diff(self.start, prepend=0), self.piece)
        return zlib.compress(np.array([len(x) for x in parts]).tobytes() + b"".join(x.astype(np.int64).tobytes() for x in parts), 1)


def covered(own: bytes, ids: np.ndarray, answers: dict[int, bytes], span: int) -> tuple[np.ndarray, np.ndarray]:
    """Row offsets in symbols, and which symbols are in a window that starts in an earlier document too."""
    numbers = np.frombuffer(zlib.decompress(own), np.int64)
    offsets, bucket, windows, start, piece = np.split(numbers[5:], np.cumsum(numbers[:4]))
    bucket, start = np.cumsum(bucket), np.cumsum(start)
    earliest = np.full(int(windows.sum()), NO_ID, np.int64)
    at = np.cumsum(windows) - windows
    for b in np.unique(bucket).tolist():
        a, e = np.searchsorted(bucket, b), np.searchsorted(bucket, b, "right")
        earliest[at[a] : at[e - 1] + windows[e - 1]] = np.frombuffer(zlib.decompress(answers[b]), np.int64)
    count = windows[piece]
    owner = ids[np.searchsorted(offsets, start, "right") - 1]
    hit = earliest[_ranges(at[piece], count)] < np.repeat(owner, count)
    place = _ranges(start, count)[hit]
    edge = np.zeros(int(offsets[-1]) + 1, np.int32)
    np.add.at(edge, place, 1)
    np.add.at(edge, place + span, -1)
    return offsets, np.cumsum(edge[:-1], dtype=np.int32) > 0


Index = Callable[[np.ndarray, np.ndarray, np.ndarray, int], np.ndarray]
Finish = Callable[[pa.Table, np.ndarray, np.ndarray], pa.Table]


def _shared(table: pa.Table) -> pa.Table:
    """For each request one bit: does another chunk ask for it too? And, if there are any, one bit for those around hot minimizers."""
    asked = [np.frombuffer(x, np.uint32) for x in table["asked"].to_pylist()]
    every = np.concatenate(asked)
    weight = np.concatenate([np.frombuffer(m, np.uint8) if m is not None else np.zeros(len(x), np.uint8) for x, m in zip(asked, table["more"].to_pylist(), strict=True)])
    hot = np.bincount(every >> 20, weights=1.0 + weight, minlength=4096) > HOT
    every.sort()
    twice = np.unique(every[1:][every[1:] == every[:-1]])

    def bits(x: np.ndarray) -> bytes:
        at = np.minimum(np.searchsorted(twice, x), max(len(twice) - 1, 0))
        return np.packbits(twice[at] == x if len(twice) else np.zeros(len(x), bool)).tobytes()

    heated = [np.packbits(hot[x >> 20]).tobytes() if hot.any() and hot[x >> 20].any() else None for x in asked]
    return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "bits": pa.array([bits(x) for x in asked], pa.binary()), "hot": pa.array(heated, pa.binary())})


def _earliest(rule: Rule, index: Index):
    def work(table: pa.Table) -> pa.Table:
        n = table.num_rows
        if table["own"].null_count < n:  # a chunk's own notes, on their way back to it
            return table.select(["chunk", "bucket", "own"]).append_column("earliest", pa.nulls(n, pa.binary()))
        kind = U if rule.lexical else np.uint8
        hashes = [np.frombuffer(x, U) for x in table["hashes"].to_pylist()]
        sizes = np.concatenate([np.frombuffer(x, np.uint16) for x in table["sizes"].to_pylist()]).astype(np.int64)
        ids = np.concatenate([np.frombuffer(x, np.int64) for x in table["ids"].to_pylist()])
        symbols = np.frombuffer(b"".join(zlib.decompress(x) for x in table["symbols"].to_pylist()), kind)
        # Equal pieces of several chunks are indexed once, under the smallest doc_id.
        starts = np.cumsum(sizes) - sizes
        every = np.concatenate(hashes)
        order = np.lexsort((sizes, every))
        again = (every[order][1:] == every[order][:-1]) & (sizes[order][1:] == sizes[order][:-1])
        maybe = np.flatnonzero(again)
        again[maybe] = _same(symbols, starts[order[maybe]], starts[order[maybe + 1]], sizes[order[maybe]])
        at = np.flatnonzero(np.concatenate(([True], ~again)))
        one = order[at]
        which = np.empty(len(order), np.int64)
        which[order] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(order))))
        owner = np.minimum.reduceat(ids[order], at)
        symbols, size = symbols[_ranges(starts[one], sizes[one])], sizes[one]
        starts, windows = np.cumsum(size) - size, size - rule.span + 1
        at = np.cumsum(windows) - windows
        found = np.repeat(owner, windows)
        # Only windows of equal hash can be equal: of each piece the part from the first of them to the last is indexed.
        again = np.flatnonzero(_repeated(symbols, size, rule.span))
        if len(again):
            piece = np.searchsorted(at, again, "right") - 1
            head = np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1])))
            first, count, piece = again[head], again[np.append(head[1:], len(again)) - 1] - again[head] + 1, piece[head]
            part = count + rule.span - 1
            found[_ranges(first, count)] = index(symbols[_ranges(starts[piece] + first - at[piece], part)], part, owner[piece], rule.span)
        out, k = [], 0
        for h in hashes:
            mine = which[k : k + len(h)]
            out.append(zlib.compress(found[_ranges(at[mine], windows[mine])].tobytes(), 1))
            k += len(h)
        return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "own": pa.nulls(len(out), pa.binary()), "earliest": pa.array(out, pa.binary())})

    return work


def earlier_passages(docs: DataFrame, rule: Rule, index: Index, finish: Finish, schema: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Applies `finish` (table of doc_id and text, row offsets in symbols, covered symbols) to every chunk.

    index(symbols, sizes, ids, span) gets the distinct pieces of a bucket and returns, for each
    window of each piece, the smallest id of a piece that has the window. Carried columns stay in the
    table that finish gets, packed in `rest`. Rows are dealt to chunks by id and text, so rows of one id
    or of none are no chunk of their own.
    """
    total = text_bytes(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([F.struct(*carry).alias("rest")] if carry else []))
    chunks, buckets = max(8, -(-total // CHUNK_BYTES)), max(8, -(-total // BUCKET_BYTES))
    laid = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), *docs.columns[1:]).withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int"))

    def rows_of(chunk: int, rows: list[dict], kinds: dict[str, pa.DataType]) -> pa.Table:
        return pa.table({"chunk": pa.array([chunk] * len(rows), pa.int32()), **{c: pa.array([r.get(c) for r in rows], t) for c, t in kinds.items()}})

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        return rows_of(key[0].as_py(), list(Chunk(table, rule, buckets).requests()), {"bucket": pa.int32(), "asked": pa.binary(), "more": pa.binary()})

    def send(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        chunk, number = Chunk(left, rule, buckets), key[0].as_py()
        chunk.choose({b: (x, y) for b, x, y in zip(*(right[c].to_pylist() for c in ("bucket", "bits", "hot")), strict=True)})
        # The chunk's own notes take a bucket of their own, so that this step runs once.
        rows = [*chunk.pieces(), {"bucket": -1 - number, "own": chunk.own()}]
        return rows_of(number, rows, {"bucket": pa.int32(), **dict.fromkeys(("hashes", "sizes", "ids", "symbols", "own"), pa.binary())})

    def apply(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        answers = list(zip(right["bucket"].to_pylist(), right["earliest"].to_pylist(), right["own"].to_pylist(), strict=True))
        table = _sorted(left)
        offsets, gone = covered(next(o for _, _, o in answers if o is not None), table["doc_id"].to_numpy(), {b: x for b, x, o in answers if o is None}, rule.span)
        return finish(table, offsets, gone)

    shared = laid.groupBy("chunk").applyInArrow(ask, "chunk int, bucket int, asked binary, more binary").groupBy("bucket").applyInArrow(_shared, "chunk int, bucket int, bits binary, hot binary")
    pieces = laid.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(send, "chunk int, bucket int, hashes binary, sizes binary, ids binary, symbols binary, own binary")
    found = pieces.groupBy("bucket").applyInArrow(_earliest(rule, index), "chunk int, bucket int, own binary, earliest binary")
    return laid.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(apply, schema)


def plain_ids(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NO_ID)


def spans_of(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of covered symbols of one row."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], covered.view(np.int8), [0]))))
    return edge[::2], edge[1::2]
