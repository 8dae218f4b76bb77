"""Near duplicates by SuperMinHash signatures, banding, exact verification and union-find.

Equal shingle sets are one class. Class representatives whose signatures agree in a band are
candidates; the candidate graph is cut into its components, and inside a component all sets that
can reach the threshold (their sizes say so) meet in tasks of two bounded blocks, where exact
intersections come from one matrix product. Tasks return forests of links, not pairs, and the
links' components are the groups. A set travels once for each block it meets, never with a pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import U, mix, runs, text_buffer, words
from .common import cut, documents, read_table
from .components import Forest, components

#: Registers of a signature at most, and how often two sets just at the threshold may miss all bands.
REGISTERS, MISS = 128, 1e-7
#: Sets in a block of a verification task.
BLOCK = 256


def banding(percent: int) -> tuple[int, int]:
    """(bands, rows): as many rows a band as leave a chance of at most MISS that sets of that similarity share no band.

    0.85 gives 22 bands of 4, 0.8 gives 31 of 4, 0.5 gives 57 of 2; below 0.12 one row a band and a greater chance is left.
    """
    for rows in (8, 7, 6, 5, 4, 3, 2, 1):
        bands = math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** rows))) if percent < 100 else 1
        if bands * rows <= REGISTERS:
            return bands, rows
    return REGISTERS, 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its n-word shingles (fewer words: all of them as one; no word: none)."""
    h, first = words(data, offsets, lower=True)
    z = h.copy()
    with np.errstate(over="ignore"):
        for k in range(1, n):
            z = z[:-1] * U(0x9E3779B97F4A7C15) + mix(h[k:] + U(k)) if len(z) > 1 else z[:0]
        z = mix(z)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(z[a : b - n + 1]))
        elif b > a:
            out.append(np.array([hash_sequence(h[a:b])], U))
        else:
            out.append(np.zeros(0, U))
    return out


def hash_sequence(h: np.ndarray) -> U:
    acc = U(len(h))
    with np.errstate(over="ignore"):
        for x in h:
            acc = mix(np.array([acc * U(0xD1B54A32D192ED03) + x], U))[0]
    return acc


def superminhash(sets: list[np.ndarray], m: int = 96) -> np.ndarray:
    """SuperMinHash signatures (rows x m): element e has the value j + r_j(e) in register p_j(e), p(e) a random permutation.

    All elements take step j together; a row is left out as soon as no register can still fall,
    which for sets much larger than m is after the first step. Values are j in the high 11 bits and
    r below. Empty sets have the greatest value throughout.
    """
    sizes = np.array([len(s) for s in sets])
    out = np.full((len(sets), m), np.iinfo(np.uint64).max, U)
    rows = np.repeat(np.arange(len(sets)), sizes)
    e = np.concatenate(sets) if len(sets) else np.zeros(0, U)
    flat = out.reshape(-1)
    perm = None
    for j in range(m):
        if not len(e):
            break
        with np.errstate(over="ignore"):
            x = mix(e + U(j + 1) * U(0x9E3779B97F4A7C15))
        k = j + (mix(x ^ U(0xA0761D6478BD642F)) % U(m - j)).astype(np.int64)
        if perm is None:
            register = k
        else:
            at = np.arange(len(e))
            register = perm[at, k].astype(np.int64)
            perm[at, k] = perm[at, j]
        np.minimum.at(flat, rows * m + register, (U(j) << U(53)) | (x >> U(11)))
        open_rows = out.max(axis=1) > (U(j + 1) << U(53))
        keep = open_rows[rows]
        if perm is None:
            e, rows = e[keep], rows[keep]
            perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(e), 1))
            at = np.arange(len(e))
            perm[at, k[keep]] = 0
        elif not keep.all():
            e, rows, perm = e[keep], rows[keep], perm[keep]
    return out


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    parts = signatures.reshape(len(signatures), bands, -1)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=U) * U(0xE7037ED1A0B428DB), parts.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for r in range(parts.shape[2]):
            key = mix(key * U(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key.view(np.int64)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(values))


def signatures(docs: DataFrame, shingle: int = 3, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, bands): set_a and set_b tell shingle sets apart; empty sets have no bands."""
    n_bands, n_rows = banding(percent)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for a, b in runs(offsets):
                sets = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shingle)
                sizes = np.array([len(s) for s in sets], np.int64)
                with np.errstate(over="ignore"):
                    marks = [np.array([mix(s + U(k)).sum() + U(k) for s in sets], U).view(np.int64) for k in (1, 2)]
                keys = band_keys(superminhash(sets, n_bands * n_rows), n_bands)[sizes > 0]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes), *map(pa.array, marks), _lists(keys.reshape(-1), np.where(sizes > 0, n_bands, 0))], ["doc_id", "n_shingles", "set_a", "set_b", "bands"])

    return docs.mapInArrow(work, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>")


def _verify(percent: int):
    """Links of one task: sets of side 1 with each other (if `own`) and with those of side 2, by exact intersections."""

    def work(table: pa.Table) -> pa.Table:
        ids = table["doc"].to_numpy()
        side = table["side"].to_numpy()
        own = bool(table["own"][0].as_py())
        sets = [np.frombuffer(x, U) for x in table["hashes"].to_pylist()]
        sizes = np.array([len(s) for s in sets])
        _, element, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = np.flatnonzero(count > 1)
        number = np.full(len(count), -1)
        number[shared] = np.arange(len(shared))
        row, column = np.repeat(np.arange(len(sets)), sizes), number[element]
        row, column = row[column >= 0], column[column >= 0]
        common = np.zeros((len(sets), len(sets)), np.float32)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for c in range(0, len(shared), 4096):
            lo, hi = np.searchsorted(column, (c, c + 4096))
            x = np.zeros((len(sets), min(4096, len(shared) - c)), np.float32)
            x[row[lo:hi], column[lo:hi] - c] = 1
            common += x @ x.T
        common = common.astype(np.int64)
        linked = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
        linked &= (side[:, None] == 1) & ((side[None, :] == 2) | own)
        forest = Forest()
        made = [(int(ids[a]), int(ids[b])) for a, b in zip(*np.nonzero(linked), strict=True) if ids[a] != ids[b] and forest.union(int(ids[a]), int(ids[b]))]
        return pa.table({"a": pa.array([a for a, _ in made], pa.int64()), "b": pa.array([b for _, b in made], pa.int64())})

    return work


def near_duplicates(docs: DataFrame, *, shingle: int = 3, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text).

    Links are exact: Jaccard similarity of whole shingle sets of at least percent/100, where shingles are
    64-bit hashes of their words and sets are equal if their sizes and two 64-bit sums over them are. Null, empty
    and blank texts have an empty set, link with nothing and are kept. Equal sets (copies, repeated
    rows) are one class; rows of one doc_id are one document, which links what any of its texts links, and
    each of its rows is returned. Rows without doc_id link with nothing, have no component and are kept.
    Further columns are left out; an empty table gives an empty table.
    """
    known = documents(docs)
    signed = cut(signatures(known, shingle, percent))
    classes = signed.where("n_shingles > 0 and doc_id is not null").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n"))
    classes = cut(classes)
    banded = classes.select("rep", F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    candidates = banded.join(hubs, "band").where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    grouped = components(candidates)
    members = cut(grouped.join(classes.select(F.col("rep").alias("node"), "n"), "node"))
    # Blocks: a component of up to BLOCK sets is one task; a larger one is split by size class (sets of
    # neighbouring classes only can reach the threshold), and a class into blocks.
    ratio = np.log(100 / percent) + 1e-9
    sized = members.withColumn("level", F.floor(F.log("n") / F.lit(float(ratio))).cast("int"))
    whole = members.groupBy("component").agg(F.count("*").alias("c"))
    level = sized.groupBy("component", "level").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    near = level.select("component", F.col("level").alias("l"), F.col("blocks").alias("k"))
    sized = sized.join(whole, "component").join(level, ["component", "level"])
    sized = sized.join(near.select("component", (F.col("l") - 1).alias("level"), F.col("k").alias("above")), ["component", "level"], "left")
    sized = sized.join(near.select("component", (F.col("l") + 1).alias("level"), F.col("k").alias("below")), ["component", "level"], "left")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    key = lambda la, a, lb, b, side: F.struct(la.alias("la"), a.alias("ka"), lb.alias("lb"), b.alias("kb"), F.lit(side).alias("side"))
    each = lambda n, f: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), f)).otherwise(F.array())
    lv, zero = F.col("level"), F.lit(0)
    meets = F.when(F.col("c") <= BLOCK, F.array(key(zero, zero, zero, zero, 1))).otherwise(
        F.concat(
            F.array(key(lv, F.col("block"), lv, F.col("block"), 1)),
            F.filter(each(F.col("blocks"), lambda k: key(lv, F.least(F.col("block"), k), lv, F.greatest(F.col("block"), k), 1)), lambda s: s["ka"] != s["kb"]),
            each(F.coalesce("above", F.lit(0)), lambda k: key(lv, F.col("block"), lv + 1, k, 1)),
            each(F.coalesce("below", F.lit(0)), lambda k: key(lv - 1, k, lv, F.col("block"), 2)),
        )
    )
    plan = sized.withColumn("block", block).select("node", "component", F.explode(meets).alias("m")).select("node", "component", "m.*")
    plan = plan.groupBy("node").agg(F.collect_list(F.struct("component", "la", "ka", "lb", "kb", "side")).alias("tasks"))
    repeated = cut(known.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    once = repeated.isEmpty()
    wanted = known.join(plan, F.col("doc_id") == F.col("node")).select("node", "text", "tasks")
    wanted = wanted if once else wanted.dropDuplicates(["node", "text"])

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for a, b in runs(offsets):
                sets = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shingle)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([s.tobytes() for s in sets], pa.binary()), batch.column(2).slice(a, b - a)], ["doc", "hashes", "tasks"])

    shipped = wanted.mapInArrow(sets_of, f"doc long, hashes binary, tasks {plan.schema['tasks'].dataType.simpleString()}").select("doc", "hashes", F.explode("tasks").alias("t"))
    shipped = shipped.select("doc", "hashes", "t.*").withColumn("own", F.col("la") == F.col("lb"))
    links = shipped.groupBy("component", "la", "ka", "lb", "kb").applyInArrow(_verify(percent), "a long, b long")
    if not once:  # classes that one document has
        own = signed.where("n_shingles > 0").join(repeated, "doc_id").join(classes.select("set_a", "set_b", "rep"), ["set_a", "set_b"])
        links = links.unionByName(own.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b").distinct())
    labels = components(links).select(F.col("node").alias("rep"), "component")
    named = classes.join(labels, "rep", "left").select("set_a", "set_b", F.coalesce("component", "rep").alias("component"))
    linked = signed.where("n_shingles > 0 and doc_id is not null").join(named, ["set_a", "set_b"]).select("doc_id", "n_shingles", "component")
    alone = signed.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component"))
    return linked.unionByName(alone).select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))


def op3_minhash(spark, sf_dir: str) -> DataFrame:
    """Near duplicates of all documents: 3-word shingles, similarity 0.85."""
    return near_duplicates(read_table(spark, sf_dir, "documents"))
