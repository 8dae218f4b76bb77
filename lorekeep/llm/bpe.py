"""Byte-level BPE, encoding and decoding, by longest matches and backtracking.

Token bytes are mapped to Latin-1 text, so that one Aho-Corasick pass finds every token in a piece
and with it the longest one at each place. The encoder takes longest matches, checks each new pair
of neighbours for compatibility (would the merges have produced exactly these two?) and steps back
to shorter tokens where it fails, marking ends that lead nowhere; each place fails once, so the
time is linear. Pair checks are memoised.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import runs, text_buffer
from .common import documents, read_table

#: Pieces and pairs that a worker remembers; a full memory is emptied.
REMEMBER = 800_000
#: Greatest vocabulary file that is sent to the executors.
MOST_BYTES = 64 << 20

_ready: dict[int, Bpe] = {}


class Bpe:
    """Encoder and decoder of one vocabulary: lines of base64 token and rank."""

    def __init__(self, lines: bytes, pattern: str) -> None:
        import ahocorasick
        import regex

        self.pieces = regex.compile(pattern).findall
        self.rank = {base64.b64decode(t).decode("latin-1"): int(r) for t, r in (x.split() for x in lines.splitlines() if x)}
        self.token = {r: t for t, r in self.rank.items()}
        self.bytes = {r: t.encode("latin-1") for r, t in self.token.items()}
        self.joined: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        for r in sorted(self.token):  # a token's halves are the two lower ones that its own merges end with
            t = self.token[r]
            self.halves[r] = (r, r)
            for k in range(1, len(t)):
                a, b = self.rank.get(t[:k], r), self.rank.get(t[k:], r)
                if a < r and b < r and a in self.halves and b in self.halves and self._compatible(a, b):
                    self.joined[a, b], self.halves[r] = r, (a, b)
                    break
            else:
                if len(t) > 1:  # merges never make it; only a whole piece can be it
                    del self.halves[r]
        self.pairs.clear()
        self.found = ahocorasick.Automaton()
        self.single = {}
        for r in self.halves:
            t = self.token[r]
            if len(t) > 1:
                self.found.add_word(t, (r, len(t)))
            else:
                self.single[t] = r
        self.found.make_automaton()
        self.shorter = {}
        for r in self.halves:
            t = self.token[r]
            self.shorter[r] = next((p for k in range(len(t) - 1, 0, -1) if (p := self.rank.get(t[:k])) in self.halves), None)
        self.length = {r: len(t) for r, t in self.token.items()}
        self.known: dict[str, bytes] = {}

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The parts of a token that lie at one of its ends (side 0: the left one), each with the rank of the merge that uses it up."""
        out = [(token, 1 << 62)]
        while (part := self.halves[token][side]) != token:
            out.append((part, token))
            token = part
        return out

    def _compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b side by side ends in just these two.

        While a and b are made, the border lies between a part at a's right end and one at b's left end. They are there together from the
        later one's merge to the first merge that uses one of them up; a merge of both in that time would cross the border. Of
        merges of equal rank the left one goes first.
        """
        left_parts = self._spine(b, 0)
        for x, x_used in self._spine(a, 1):
            for y, y_used in left_parts:
                if max(x, y) < min(x_used, y_used):
                    crossing = self.joined.get((x, y))
                    if crossing is not None and crossing < x_used and crossing <= y_used:
                        return False
        return True

    def _fits(self, a: int, b: int) -> bool:
        fits = self.pairs[a, b] = self._compatible(a, b)
        return fits

    def piece(self, piece: str) -> bytes:
        """Ids of one piece as little-endian unsigned 32-bit integers."""
        text = piece.encode().decode("latin-1")
        whole = self.rank.get(text)
        if whole is not None:
            return whole.to_bytes(4, "little")
        length, shorter = self.length, self.shorter
        longest = [*map(self.single.__getitem__, text), -1]
        for end, (r, n) in self.found.iter(text):  # by end, so the last one of a start is its longest
            longest[end + 1 - n] = r
        pairs, fit = self.pairs, self._fits
        ids: list[int] = []
        dead = bytearray(len(text) + 1)
        at, token = 0, longest[0]
        while token >= 0:
            last = ids[-1] if ids else -1
            while True:
                end = at + length[token]
                if not dead[end] and (last < 0 or (fits if (fits := pairs.get((last, token))) is not None else fit(last, token))):
                    ids.append(token)
                    at, token = end, longest[end]
                    break
                token = shorter[token]
                if token is None:
                    dead[at] = 1
                    token = ids.pop()
                    at -= length[token]
                    break
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        known, out = self.known, []
        for p in self.pieces(text):
            ids = known.get(p)
            if ids is None:
                ids = self.piece(p)
                if len(p) <= 64:
                    known[p] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def forget(self) -> None:
        if len(self.known) > REMEMBER:
            self.known.clear()
        if len(self.pairs) > REMEMBER:
            self.pairs.clear()


def _loader(spark, path: str, pattern: str) -> Callable[[], Bpe]:
    with open(path, "rb") as f:
        lines = f.read()
    if len(lines) > MOST_BYTES:
        raise ValueError(f"{path} has more than {MOST_BYTES} bytes")
    sent = spark.sparkContext.broadcast(lines)

    def load() -> Bpe:
        key = hash((sent.value, pattern))
        if key not in _ready:
            _ready.clear()
            _ready[key] = Bpe(sent.value, pattern)
        return _ready[key]

    return load


def encode_decode(docs: DataFrame, path: str, pattern: str, keep_text: bool = False) -> DataFrame:
    """(doc_id, ids, decoded): ids as little-endian unsigned 32-bit integers, decoded the bytes that they stand for.

    Null texts are empty and have no ids. Texts of any length, ties and repeated rows need nothing
    special; special tokens are ordinary text. The vocabulary is read on the driver and must be a
    file of at most MOST_BYTES. keep_text adds the text.
    """
    load = _loader(docs.sparkSession, path, pattern)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load()
        for batch in batches:
            _, offsets = text_buffer(batch.column(1))
            for a, b in runs(offsets, 1 << 21):
                ids = [bpe.encode(t or "") for t in batch.column(1).slice(a, b - a).to_pylist()]
                columns = {"doc_id": batch.column(0).slice(a, b - a), "ids": pa.array(ids, pa.binary()), "decoded": pa.array([bpe.decode(x) for x in ids], pa.binary())}
                yield pa.RecordBatch.from_pydict(columns | ({"text": batch.column(1).slice(a, b - a)} if keep_text else {}))
                bpe.forget()

    return documents(docs).mapInArrow(work, "doc_id long, ids binary, decoded binary" + ", text string" * keep_text)


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    """Token ids of every document and what they decode to, as digests; null and empty texts have no ids, repeated rows are
    returned each, a null doc_id stays null."""
    import public_tokenizers

    made = encode_decode(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return made.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
