"""Near duplicates and repeats against brute force."""

import hashlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from lorekeep.llm import fm_dedup, minhash, suffix, suffix_dedup
from lorekeep.llm.components import components
from lorekeep.llm.fm_dedup import FmIndex


def groups(rows, n=3, percent=85):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def covered(rows, units, span):
    first, out = {}, {}
    for d, t in sorted(rows):
        u = units(t or "")
        mask = [False] * len(u)
        for i in range(len(u) - span + 1):
            w = tuple(u[i : i + span])
            if first.setdefault(w, d) < d:
                mask[i : i + span] = [True] * span
        out[d] = (u, mask)
    return out


def test_near_duplicates_match_brute_force(docs, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert got == groups(rows)


def test_near_duplicates_of_real_documents(spark, sf, real):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.op3_minhash(spark, sf).collect()}
    assert got == groups(real)


def test_large_components_are_verified_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for d in range(40):
        w = list(base)
        for k in range(d % 7):
            w[(d * 5 + k * 11) % 60] = f"x{d}-{k}"
        rows.append((d, " ".join(w[: 60 - d % 9])))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == groups(rows)


def test_rows_without_id_and_repeated_rows(spark):
    t = "a b c d e f g"
    df = spark.createDataFrame([(None, t), (None, t), (4, t), (4, t), (2, t), (9, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, None, True), (None, None, True), (4, 2, False), (4, 2, False), (2, 2, True), (9, 9, True)], key=str)


def test_empty_tables(empty):
    assert minhash.near_duplicates(empty).count() == 0
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert fm_dedup.remove_windows(empty).count() == 0


def test_superminhash_estimates_similarity():
    r = np.random.default_rng(3)
    for size, common in ((40, 20), (400, 300), (3000, 1500), (2, 1)):
        est = []
        for _ in range(30):
            x = r.integers(0, 1 << 63, 2 * size - common, dtype=np.int64).astype(np.uint64)
            s = minhash.superminhash([np.unique(x[:size]), np.unique(x[size - common :])])
            assert (s < np.iinfo(np.uint64).max).all()
            est.append((s[0] == s[1]).mean())
        assert abs(np.mean(est) - common / (2 * size - common)) < 0.04


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 99), (200, 200), (98, 100)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {98: 98, 99: 98, 100: 98}


@pytest.mark.parametrize("kind", ["fixture", "real"])
def test_byte_repeats_match_brute_force(docs, rows, spark, sf, real, kind):
    data, df = (rows, docs) if kind == "fixture" else (real, spark.read.parquet(f"{sf}/documents.parquet"))
    want = covered(data, lambda t: t.encode(), 50)
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(df).collect()}
    for d, (u, mask) in want.items():
        assert got[d].n_bytes == len(u)
        assert bytes(got[d].kept) == bytes(x for x, m in zip(u, mask, strict=True) if not m)
        assert sum(s.end - s.start for s in got[d].spans) == sum(mask)


def test_whole_characters_and_carried_columns(spark):
    a, b = "é" * 40 + "x", "ü" + "é" * 40 + "y"
    df = spark.createDataFrame([(1, a, 7), (2, "z" + a[:-1], 8), (3, b, 9)], "doc_id long, text string, kept int")
    made = suffix_dedup.remove_repeats(df.withColumnRenamed("kept", "extra"), whole_characters=True, carry=("extra",)).collect()
    assert {r.doc_id: (bytes(r.kept).decode(), r.extra) for r in made} == {1: (a, 7), 2: ("z", 8), 3: ("üy", 9)}


@pytest.mark.parametrize("kind", ["fixture", "real"])
def test_word_repeats_match_brute_force(docs, rows, spark, sf, real, kind):
    data, df = (rows, docs) if kind == "fixture" else (real, spark.read.parquet(f"{sf}/documents.parquet"))
    want = covered(data, lambda t: t.encode().split(), 50)
    got = {r.doc_id: r for r in fm_dedup.remove_windows(df).collect()}
    for d, (u, mask) in want.items():
        assert got[d].n_words == len(u)
        assert got[d].kept.encode() == b" ".join(x for x, m in zip(u, mask, strict=True) if not m)


def test_rows_of_one_id_are_one_document(spark):
    t = " ".join(f"w{i}" for i in range(80))
    df = spark.createDataFrame([(5, t), (5, t), (None, t), (7, "n " + t)], "doc_id long, text string")
    got = sorted(((r.doc_id, len(r.kept.split())) for r in fm_dedup.remove_windows(df).collect()), key=str)
    assert got == sorted([(5, 80), (5, 80), (None, 0), (7, 1)], key=str)


def test_suffix_arrays_and_backward_search():
    r = np.random.default_rng(0)
    cases = [np.append(r.integers(1, int(r.integers(2, 6)), int(r.integers(1, 70))), 0) for _ in range(150)]
    cases += [np.append(np.ones(400, int), 0), np.append(np.tile([2, 1, 1], 200), 0), np.append(np.tile(np.arange(1, 40), 9), 0)]
    cases.append(np.append(np.tile(np.arange(30, 0, -1), 12), 0))  # substrings longer than a packed key
    for t in cases:
        sa = suffix.suffix_array(t)
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
    t = np.append(r.integers(1, 30, 500), 0)
    sa = suffix.suffix_array(t)
    index = FmIndex(t, sa)
    for size in (1, 2, 3, 5):
        for at in r.integers(0, 490, 20):
            low, high = np.array([0]), np.array([len(t)])
            for c in t[at : at + size][::-1]:
                low, high = index.extend(np.array([c]), low, high)
            assert sorted(sa[low[0] : high[0]]) == [i for i in range(len(t)) if t[i : i + size].tolist() == t[at : at + size].tolist()]


def test_op_queries_have_the_agreed_columns(spark, sf):
    r = suffix_dedup.op4_suffix_dedup(spark, sf).orderBy("doc_id").first()
    text = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id = 0").first().text
    assert (r.doc_id, r.n_removed, r.kept_sha256) == (0, 0, hashlib.sha256(text.encode()).hexdigest())
    assert {*defaultdict(int, r.asDict())} == {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"}
