"""Removal of byte strings that start in an earlier document, by suffix arrays of the shared passages."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import read_table
from .passages import Rule, earlier_passages, plain_ids, spans_of
from .suffix import permuted_prefixes, suffix_array

#: Bytes of a minimizer.
GRAM = 20


def joined(symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces as one text: symbols from 2 on, 1 after each piece, 0 at the end; and where each piece starts."""
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    text = np.ones(int(sizes.sum()) + len(sizes) + 1, np.int32)
    text[-1] = 0
    inside = np.ones(len(text), bool)
    inside[starts + sizes] = False
    inside[-1] = False
    text[inside] = symbols.astype(np.int32) + 2
    return text, starts


def window_groups(text: np.ndarray, sa: np.ndarray, starts: np.ndarray, sizes: np.ndarray, span: int) -> np.ndarray:
    """For each place of the suffix array whether it begins a group of suffixes with `span` symbols in common."""
    common = permuted_prefixes(text, sa, starts, starts + sizes, span)
    return common[sa] < span


def earliest_by_suffix(symbols: np.ndarray, sizes: np.ndarray, ids: np.ndarray, span: int) -> np.ndarray:
    """For each window of each piece the smallest id of a piece with that window."""
    text, starts = joined(symbols, sizes)
    sa = suffix_array(text)
    begins = window_groups(text, sa, starts, sizes, span)
    owner = np.full(len(text), np.iinfo(np.int64).max)
    windows = sizes - span + 1
    count = int(windows.sum())
    at = np.repeat(starts - (np.cumsum(windows) - windows), windows) + np.arange(count)
    owner[at] = np.repeat(ids, windows)
    group = np.cumsum(begins) - 1
    least = np.minimum.reduceat(owner[sa], np.flatnonzero(begins)) if len(sa) else owner
    place = np.empty(len(text), np.int64)
    place[sa] = group
    return least[place[at]]


def _character_spans(data: bytes, covered: np.ndarray) -> np.ndarray:
    """Covered bytes without characters that are covered in part."""
    lead = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    number = np.cumsum(lead) - 1
    whole = np.ones(int(lead.sum()), bool)
    np.logical_and.at(whole, number, covered)
    return whole[number]


def remove_repeats(docs: DataFrame, span: int = 50, whole_characters: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, kept, spans) for every row: each byte in a `span`-byte string that also starts in a
    document of smaller doc_id is removed; kept are the other bytes, spans the removed runs (start, end).

    Null and empty texts have no bytes. Rows of the same doc_id are one document's, so neither is
    earlier; a null doc_id is later than any. whole_characters keeps a character that is covered
    only in part, so that kept is valid UTF-8. Carried columns follow; they must not have one of the names above.
    """

    def finish(table: pa.Table, offsets: np.ndarray, covered: np.ndarray) -> pa.Table:
        ids, kept, spans = table["doc_id"].to_numpy(), [], []
        texts = table["text"].to_pylist()
        for text, a, b in zip(texts, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            data, mine = (text or "").encode(), covered[a:b]
            if whole_characters and mine.any():
                mine = _character_spans(data, mine)
            starts, ends = spans_of(mine)
            spans.append([{"start": int(s), "end": int(e)} for s, e in zip(starts, ends, strict=True)])
            kept.append(b"".join(data[e:s] for e, s in zip([0, *ends.tolist()], [*starts.tolist(), len(data)], strict=True)))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        out = {"doc_id": plain_ids(ids), "n_bytes": pa.array(np.diff(offsets), pa.int64()), "kept": pa.array(kept, pa.binary()), "spans": pa.array(spans, kind)}
        return pa.table(out | ({"rest": table["rest"]} if carry else {}))

    schema = StructType.fromDDL("doc_id long, n_bytes long, kept binary, spans array<struct<start:long,end:long>>")
    if carry:
        schema = schema.add("rest", docs.select(*carry).schema)
    made = earlier_passages(docs, Rule(span, min(GRAM, span), False), earliest_by_suffix, finish, schema, carry)
    return made.select("doc_id", "n_bytes", "kept", "spans", "rest.*") if carry else made


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What `remove_repeats` leaves of every document, as digests; null and empty texts have no bytes."""
    made = remove_repeats(read_table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
