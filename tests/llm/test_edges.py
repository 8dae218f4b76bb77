"""Hot groups, long texts, repeated and empty rows, clashing names, and columns recomputed by plain code."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash

from lorekeep.llm import decontam, fm_dedup, langid, licenses, minhash, passages, sharding, spotsigs, suffix_dedup
from lorekeep.llm.fm_dedup import earliest_by_index
from lorekeep.llm.passages import Chunk, Rule, covered
from lorekeep.llm.suffix_dedup import earliest_by_suffix
from test_dedup import groups

WORDS = "the of and to in is ab cd ef gh ij kl mn op qr st uv wx yz ba dc fe hg ji lk".split()


def say(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def passes(rows, rule, index, chunks=3, buckets=4):
    """The passes of earlier_passages without Spark: {(doc_id, text): covered symbols}."""
    dealt = [[x for x in rows if hash((x[0], x[1])) % chunks == c] for c in range(chunks)]
    tables = [pa.table({"doc_id": pa.array([d for d, _ in x], pa.int64()), "text": pa.array([t for _, t in x], pa.string())}) for x in dealt]
    made = [Chunk(t, rule, buckets) for t in tables]
    asked = [{"chunk": c, "more": None, **r} for c, m in enumerate(made) for r in m.requests()]
    answers = {c: {} for c in range(chunks)}
    for b in {r["bucket"] for r in asked}:
        mine = [r for r in asked if r["bucket"] == b]
        told = passages._shared(pa.table({k: [r[k] for r in mine] for k in ("chunk", "bucket", "asked", "more")} | {"more": pa.array([r["more"] for r in mine], pa.binary())}))
        for c, bits, hot in zip(told["chunk"].to_pylist(), told["bits"].to_pylist(), told["hot"].to_pylist(), strict=True):
            answers[c][b] = (bits, hot)
    for c, m in enumerate(made):
        m.choose(answers[c])
    sent = [{"chunk": c, **r} for c, m in enumerate(made) for r in m.pieces()]
    found = {c: {} for c in range(chunks)}
    for b in {r["bucket"] for r in sent}:
        mine = [r for r in sent if r["bucket"] == b]
        table = pa.table({k: [r[k] for r in mine] for k in ("chunk", "bucket", "hashes", "sizes", "ids", "symbols")} | {"own": pa.nulls(len(mine), pa.binary())})
        told = passages._earliest(rule, index)(table)
        for c, x in zip(told["chunk"].to_pylist(), told["earliest"].to_pylist(), strict=True):
            found[c][b] = x
    out = {}
    for c, m in enumerate(made):
        table = passages._sorted(tables[c])
        offsets, gone = covered(m.own(), table["doc_id"].to_numpy(), found[c], rule.span)
        for i, (d, t) in enumerate(zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True)):
            out[d, t] = gone[offsets[i] : offsets[i + 1]].tolist()
    return out, sum(len(m.piece_id) for m in made)


def plain_cover(rows, span, units):
    first = {}
    for d, t in rows:
        u = units(t or "")
        for i in range(len(u) - span + 1):
            w = tuple(u[i : i + span])
            first[w] = min(first.get(w, d), d)
    out = {}
    for d, t in rows:
        u = units(t or "")
        mask = [False] * len(u)
        for i in range(len(u) - span + 1):
            if first[tuple(u[i : i + span])] < d:
                mask[i : i + span] = [True] * span
        out[d, t] = mask
    return out


def passage_rows():
    r = random.Random(3)
    line, passage = "a common line of words here", say(r, 60)
    rows = [(i, say(r, r.randrange(1, 40)) + " " + line + " " + say(r, r.randrange(0, 60))) for i in range(30)]
    rows += [(i, say(r, 5) + " " + passage + " " + say(r, i % 7)) for i in range(30, 40)] + [(40, "z" * 200), (41, "z" * 90), (42, None), (43, ""), (44, rows[0][1]), (3, say(r, 80)), (passages.NO_ID, passage)]
    return rows


@pytest.mark.parametrize("hot", [4096, 0])
@pytest.mark.parametrize("windows", [1 << 16, 97])
def test_hot_minimizers_and_small_blocks_change_nothing(monkeypatch, hot, windows):
    monkeypatch.setattr(passages, "HOT", hot)
    monkeypatch.setattr(passages, "WINDOWS", windows)
    rows = passage_rows()
    cases = ((Rule(50, 20, False), earliest_by_suffix, lambda t: list(t.encode())), (Rule(12, 4, True), earliest_by_index, lambda t: t.encode().split()), (Rule(9, 9, True), earliest_by_index, lambda t: t.encode().split()))
    for rule, index, units in cases:
        got, pieces = passes(rows, rule, index)
        assert got == plain_cover(rows, rule.span, units)
        assert pieces


def test_bands_follow_from_the_similarity(docs, rows):
    assert minhash.banding(85) == (22, 4)
    for p in (50, 70, 95):
        bands, per = minhash.banding(p)
        assert bands * per <= minhash.REGISTERS and (1 - (p / 100) ** per) ** bands <= minhash.MISS
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, percent=50).collect()}
    assert got == groups(rows, 3, 50)


def test_texts_of_one_document_link_its_groups(spark):
    a, b = "one two three four five", "six seven eight nine ten"
    df = spark.createDataFrame([(2, a), (4, a), (4, b), (9, b), (11, "other words are here now")], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(df).collect())
    assert got == [(2, 2), (4, 2), (4, 2), (9, 2), (11, 11)]


def spots(text):
    """Signature hashes by plain code: Spark's xxhash64 is XXH64 with seed 42, of several columns one after the other."""
    parts = [["", []]]
    for w in regex.sub(r"[^\p{L}]+", " ", text.lower()).split():
        if w in spotsigs.COMMON:
            parts[-1][1].append(w)
        else:
            parts.append([w, []])
    out = set()
    for i, (_, commons) in enumerate(parts):
        after = " ".join(p[0] for p in parts[i + 1 : i + 3])
        out |= {xxhash.xxh64_intdigest(after, seed=xxhash.xxh64_intdigest(a, seed=42)) for a in commons}
    return out or {xxhash.xxh64_intdigest(text, seed=42)}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_every_fingerprint_column_matches_plain_code(spark, sf, real):
    got = {r.doc_id: r for r in spotsigs.op6_spotsigs(spark, sf).collect()}
    ids = sorted(got, reverse=True)
    texts = {d: t or "" for d, t in real}
    assert len(got) == len(real)
    for d, after in zip(ids, ids[1:] + ids[:1], strict=True):
        text, other = texts[d], texts[after]
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        sets = [spots(x) for x in (text, edited, other)]
        prints = ["".join(f"{h:016X}" for h in sorted(s, key=signed)) for s in sets]
        near = [len(sets[0] & s) / len(sets[0] | s) for s in sets[1:]]
        r = got[d]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(text), hashlib.sha256(edited.encode()).hexdigest(), prints[0], prints[1])
        assert abs(r.near_edited - near[0]) < 1e-9 and abs(r.near_next - near[1]) < 1e-9


def test_the_next_of_repeated_and_nameless_rows(spark):
    df = spark.createDataFrame([(5, "a"), (5, "a"), (5, "b"), (3, "c"), (None, "d"), (None, "d")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.text, r.next_text) for r in spotsigs.with_next(df).collect()), key=str)
    five = sorted(("a", "b"), key=lambda t: signed(xxhash.xxh64_intdigest(t, seed=42)))
    order = [(5, five[0])] * (2 if five[0] == "a" else 1) + [(5, five[1])] * (2 if five[1] == "a" else 1) + [(3, "c"), (None, "d"), (None, "d")]
    assert got == sorted(((d, t, n) for (d, t), (_, n) in zip(order, order[1:] + order[:1], strict=True)), key=str)
    assert spotsigs.with_next(df.limit(0)).count() == 0
    one = spotsigs.with_next(df.where("doc_id = 3")).collect()
    assert [(r.text, r.next_text) for r in one] == [("c", "c")]


def least_distance(item, text):
    """Least edit distance of an item to a part of the text, by dynamic programming."""
    t = np.array([ord(c) for c in text])
    row = np.zeros(len(t) + 1, np.int64)
    at = np.arange(len(t) + 1)
    for i, c in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (t != ord(c)), row[1:] + 1)
        row = np.minimum.accumulate(new - at) + at
    return int(row.min())


def test_contaminated_documents_match_dynamic_programming(spark, sf):
    docs = [r for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect() if r.text and len(r.text) < 900][:60]
    items = [r for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if r.text][:12]
    r = random.Random(2)
    hurt = lambda t, n: "".join(c if r.random() > n / len(t) else r.choice("xyz") for c in t)
    rows = [(d.doc_id, d.text) for d in docs] + [(100000 + 10 * i + n, say(r, 4) + " " + hurt(x.text, n) + " " + say(r, 3)) for i, x in enumerate(items) for n in (0, 2, 5, 9)]
    found = decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(x.item_id, x.text) for x in items], "item_id long, text string"))
    got = {(x.doc_id, x.item_id): x.distance for x in found.collect()}
    want = {}
    for d, t in rows:
        for x in items:
            plain = decontam.normal(x.text)
            distance = least_distance(plain, decontam.normal(t))
            if distance <= int(decontam.RATE * len(plain)):
                want[d, x.item_id] = distance
    assert got == want and len(got) > 20


def test_short_items_match_whole_words(spark):
    df = spark.createDataFrame([(1, "a concatenated thing"), (2, "the cat sat"), (3, "cat")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "Cat")], "item_id long, text string")
    assert sorted(r.doc_id for r in decontam.contaminated(df, items).collect()) == [2, 3]


def test_tags_nameless_files_and_prose(spark):
    mit = "Released under the MIT License."
    files = [(None, "a/x.py", mit), (None, "a/y.py", "nothing"), (1, "a/z.py", "# SPDX-License-Identifier: MPL-2.0\ncode"), (2, "a/prose.txt", mit), (3, "a/w.py", "code"), (4, None, mit), (5, "", "")]
    rows = licenses.scan_licenses(spark.createDataFrame(files, "file_id long, path string, text string")).collect()
    got = sorted(((r.file_id, r.license, r.how) for r in rows), key=str)
    assert got == sorted([(None, "MIT", "own"), (None, None, "none"), (1, "MPL-2.0", "own"), (2, "MIT", "own"), (3, None, "none"), (4, "MIT", "own"), (5, None, "none")], key=str)


def test_three_hundred_languages(spark):
    letters = "abcdefghijklmnopqrst"
    names = [f"l{i:03d}" for i in range(300)]
    word = lambda i, k: letters[i // 20] + letters[i % 20] + letters[(i + k) % 20] + letters[(i * 7 + 3 * k) % 20]
    rows = [(n, " ".join(word(i, k % 5) for k in range(12))) for i, n in enumerate(names)]
    model = langid.fit(spark.createDataFrame(rows, "lang string, text string"))
    assert model.langs == names
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string").repartition(2)
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, model).collect()}
    assert sum(got[i] == n for i, n in enumerate(names)) >= 295


def test_long_texts_and_clashing_names(spark, sf):
    """A text of more than two megabytes, beside empty ones, through the operators and the stages."""
    import corpus_pipeline as p

    r = random.Random(9)
    long = " ".join(f"w{r.randrange(1 << 20):x}" for _ in range(350_000))
    rows = [(1, long, None), (2, long[:200_000] + " own tail", "en"), (3, "", None), (4, None, "en"), (None, "short words here", None), (None, "short words here", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as kept", "2 as score", "'x' as lang_pred", "3 as spans", "4 as n_bytes", "5 as rest", "cast(length(text) as long) as n_chars", "'s' as source")
    removed = {x.doc_id: x.n_bytes - len(x.kept) for x in suffix_dedup.remove_repeats(df).where("doc_id is not null").collect()}
    assert removed[1] == 0 and removed[2] >= 200_000 and removed[3] == removed[4] == 0
    words = {x.doc_id: x.n_words for x in fm_dedup.remove_windows(df).where("doc_id is not null").collect()}
    assert words[1] == 350_000 and words[3] == 0
    assert {x.doc_id: x.kept for x in minhash.near_duplicates(df).where("doc_id is not null").collect()} == {1: True, 2: True, 3: True, 4: True}
    kept = df
    sizes = []
    for name, stage in p.STAGES:
        made = stage(spark, kept, sf)
        if name != "tokens":
            assert made.columns == df.columns
        kept = p.cut(made)
        sizes.append(kept.count())
        assert stage(spark, df.limit(0), sf).count() == 0
    assert sizes == [4, 4, 4, 4, 4]
    assert all(x.decodes for x in kept.collect())


def test_shards_of_all_documents(spark, sf, real):
    rows = sharding.op1_sharding(spark, sf).collect()
    texts, by, slots, sizes = dict(real), {}, {}, {}
    for r in rows:
        by.setdefault(texts[r.doc_id], set()).add(r.shard)
        slots.setdefault(r.shard, []).append(r.slot)
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
    assert all(len(x) == 1 for x in by.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) <= set(range(24))
    largest = max(sum(r.size for r in rows if texts[r.doc_id] == t) for t in by)
    assert max(sizes.values()) <= sum(sizes.values()) / 24 + largest
