import zlib

import numpy as np
import pyarrow as pa
import pytest

from lorekeep.llm import passages as P
from lorekeep.llm.fm_dedup import earliest_by_index
from lorekeep.llm.suffix_dedup import earliest_by_suffix


def _bucket(pieces: list[tuple[int, np.ndarray]], chunks: int) -> pa.Table:
    rows = []
    for chunk in range(chunks):
        mine = pieces[chunk::chunks]
        hashes = np.array([hash(s.tobytes()) & ((1 << 62) - 1) for _, s in mine], np.uint64)
        rows.append((chunk, hashes.tobytes(), np.array([len(s) for _, s in mine], np.uint16).tobytes(), np.array([i for i, _ in mine], np.int64).tobytes(), zlib.compress(b"".join(s.tobytes() for _, s in mine))))
    names = ("chunk", "hashes", "sizes", "ids", "symbols")
    table = pa.table({n: pa.array(c, pa.int32() if n == "chunk" else pa.binary()) for n, c in zip(names, zip(*rows, strict=True), strict=True)})
    return table.append_column("bucket", pa.array([0] * chunks, pa.int32())).append_column("own", pa.nulls(chunks, pa.binary()))


@pytest.mark.parametrize(("index", "lexical"), [(earliest_by_suffix, False), (earliest_by_index, True)])
@pytest.mark.parametrize("shared", [0, 3, 200])
def test_a_bucket_indexes_only_what_its_pieces_may_have_in_common(index, lexical, shared):
    random, span, kind = np.random.default_rng(4), 10, np.uint64 if lexical else np.uint8
    pieces = [(int(random.integers(0, 1000)), random.integers(0, 200, int(random.integers(span, 18))).astype(kind)) for _ in range(400)]
    for k in range(shared):  # piece k begins with what piece 200 + k ends with, on a window or more
        n = min(len(pieces[k][1]), len(pieces[200 + k][1])) - k % 2
        n = max(n, span)
        pieces[k][1][:n] = pieces[200 + k][1][-n:]
    pieces += [(i + 1, s) for i, s in pieces[100:200]]  # copies from other chunks
    taken = []

    def counting(symbols, sizes, ids, width):
        taken.append(len(symbols))
        return index(symbols, sizes, ids, width)

    out = P._earliest(P.Rule(span, 4, lexical), counting)(_bucket(pieces, 7))
    least: dict[bytes, int] = {}
    for i, s in pieces:
        for w in range(len(s) - span + 1):
            key = s[w : w + span].tobytes()
            least[key] = min(least.get(key, 10**9), i)
    for chunk, got in zip(out["chunk"].to_pylist(), out["earliest"].to_pylist(), strict=True):
        want = [least[s[w : w + span].tobytes()] for _, s in pieces[chunk::7] for w in range(len(s) - span + 1)]
        assert np.frombuffer(zlib.decompress(got), np.int64).tolist() == want
    assert sum(taken) <= 2 * shared * 18  # all 400 distinct pieces have some 5600 symbols


def test_hashes_of_pieces_do_not_depend_on_where_they_are():
    text = np.random.default_rng(5).integers(0, 256, 3 * P.WINDOWS).astype(np.uint8)
    text[P.WINDOWS - 20 : P.WINDOWS + 60] = text[7:87]
    text[-80:] = text[7:87]
    hashes = P._piece_hashes(text, np.array([7, 8, P.WINDOWS - 20, P.WINDOWS - 19, len(text) - 80]), np.array([80, 79, 80, 79, 80]))
    assert hashes[0] == hashes[2] == hashes[4] != hashes[1] == hashes[3]
    assert len(P._piece_hashes(text, np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0
