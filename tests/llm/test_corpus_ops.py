"""Merkle manifest, collocations and toxicity against plain code, and their edges."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.llm import merkle
from lorekeep.llm.collocations import OP12_SQL, collocations, counts
from lorekeep.llm.toxicity import SHARE, STRETCH, _keys, chunks_of, curve, features, fit, log_ratios, score

H = lambda text: hashlib.sha256(text.encode()).hexdigest()


def leaf(*values):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def parents(row):
    while len(row) > 1:
        yield row
        row = [H("".join(row[i : i + 8])) for i in range(0, len(row), 8)]
    yield row


def brute_manifest(rows):
    """{(doc_id, leaf): (subroot, root, proof, folded, rank)} by walking lists."""
    by = defaultdict(list)
    for doc_id, text, lang, source, n in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text) if text is not None else None
        changed = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        by[lang].append((doc_id is not None, doc_id, leaf(doc_id, source, lang, n, text), leaf(doc_id, source, lang, n, lower if changed else text)))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    levels = {x: list(parents([r[2] for r in sorted(by[x], key=lambda r: (r[0], r[1] or 0, r[2]))])) for x in langs}
    top = list(parents([levels[x][-1][0] for x in langs]))
    out = []
    for t, x in enumerate(langs):
        for i, r in enumerate(sorted(by[x], key=lambda r: (r[0], r[1] or 0, r[2]))):
            siblings, h = [], r[3]
            for at, tree in ((i, levels[x]), (t, top)):
                for row in tree[:-1]:
                    run = row[at // 8 * 8 : at // 8 * 8 + 8]
                    siblings += run[: at % 8] + run[at % 8 + 1 :]
                    h = H("".join(run[: at % 8] + [h] + run[at % 8 + 1 :]))
                    at //= 8
            out.append((r[1], r[2], levels[x][-1][0], top[-1][0], H("".join(siblings)), h, i, h == top[-1][0]))
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, path int"
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "rank", "verified"]


def manifest_of(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    return [tuple(r[c] for c in COLUMNS) for r in merkle.op11_merkle(spark, str(tmp_path)).collect()]


def test_manifest_equals_plain_code_with_nulls_ties_repeats_and_long_texts(spark, tmp_path):
    r = random.Random(3)
    rows = [(i, r.choice(["Ab c", "ñ Über", "", None, "x"]), r.choice(["en", "en", "en", None, "de", "é", "Z"]), r.choice(["s", None]), r.choice([1, None])) for i in range(0, 700, 2)]
    rows += [(5, "Tie one", "en", "s", 1), (5, "Tie two", "en", "s", 1), (7, "Same", "en", "s", 1), (7, "Same", "en", "s", 1), (None, "No id", "en", None, None), (9, "Wx" * 500_000, "de", "s", 2), (11, "Alone", "only", "s", 1)]
    key = lambda x: tuple(map(str, x))
    assert sorted(manifest_of(spark, tmp_path, rows), key=key) == sorted(brute_manifest(rows), key=key)


@pytest.mark.parametrize("n", [0, 1, 8, 9, 65])
def test_manifest_of_one_tree_of_any_size(spark, tmp_path, n):
    rows = [(i, f"Text {i}", "en", "s", i) for i in range(n)]
    assert sorted(manifest_of(spark, tmp_path, rows)) == sorted(brute_manifest(rows))


def test_only_texts_that_change_fail(spark, tmp_path):
    rows = [(i, "all lower" if i % 2 else "Not", "en", "s", 1) for i in range(40)]
    for doc_id, *_, verified in manifest_of(spark, tmp_path, rows):
        assert verified == (doc_id % 2 == 1 or zlib.crc32(str(doc_id).encode()) % 3 != 0)


def brute_phrases(rows, longest=3, least=10, percent=50, top=2000):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        scored = []
        for p, a in c.items():
            if len(p) < 2 or a < least:
                continue
            if any(len(q) > len(p) and b >= least and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in c.items()):
                continue
            s, _, left, right = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            scored.append((-s, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def phrase_rows():
    r = random.Random(8)
    say = lambda n: " ".join(r.choice("a b c d the of new york city ñ é".split()) + r.choice(["", "", "", ",", ".", " ", "\t", "\n"]) for _ in range(n))
    rows = [(r.choice(["en", "en", "de", None, "und"]), say(r.randrange(1, 60))) for _ in range(150)]
    rows += [("en", "New York City is New"), ("en", "new york city")] * 12
    return rows + [("en", None), ("de", ""), ("xx", " .. \n"), ("en", "x" * 100_000), ("fr", "la la la la " * 30)]


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_collocations_equal_plain_code(spark, longest):
    rows = phrase_rows()
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "lang string, text string, phrase string, n int").repartition(5)
    got = sorted(tuple(r) for r in collocations(df, longest=longest).collect())
    assert got == brute_phrases(rows, longest)
    assert {x[0] for x in got} >= {"en", "de", "und", "fr"}


def test_collocations_in_many_parts_and_without_rows(spark, monkeypatch):
    from lorekeep.llm import collocations as module

    rows = phrase_rows()
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    monkeypatch.setattr(module, "MERGED", 2000)
    monkeypatch.setattr(module, "WORDS", 300)
    assert sorted(tuple(r) for r in collocations(df, top=7).collect()) == brute_phrases(rows, top=7)
    assert collocations(df.limit(0)).count() == 0
    assert counts(df.where("lang = 'xx'")).count() == 0


def test_collocations_equal_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    result = con.execute(OP12_SQL)
    names = [x[0] for x in result.description]
    got = collocations(spark.read.parquet(f"{sf}/documents.parquet")).select(*names)
    assert sorted(tuple(r) for r in got.collect()) == sorted(result.fetchall())


def words(text):
    return [w for w in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").lower()) if w]


def brute_ratios(rows):
    n = [Counter(), Counter()]
    for text, toxic in rows:
        n[toxic].update(set(words(text)))
    all_words = set(n[0]) | set(n[1])
    whole = sum(n[0].values()) + sum(n[1].values()) + 0.5 * len(all_words)
    p, left = [], []
    for c in n:
        ones, twos = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
        total = sum(c.values())
        lam = d * len(c) / total
        left.append(lam)
        p.append(lambda w, c=c, d=d, total=total, lam=lam: max(c[w] - d, 0) / total + lam * (n[0][w] + n[1][w] + 0.5) / whole)
    return {w: math.log(p[1](w) / p[0](w)) - math.log(left[1] / left[0]) for w in all_words}


def toxic_rows(n=240):
    r = random.Random(1)
    plain, bad = [f"w{i}" for i in range(300)], ["scum", "idiot", "Ünfug"]
    rows = []
    for i in range(n):
        toxic = i % 4 == 0
        text = [r.choice(plain) for _ in range(r.randrange(5, 60))]
        if toxic:
            for _ in range(1 + len(text) // 20):
                text.insert(r.randrange(len(text)), r.choice(bad) + r.choice(["", "!", ","]))
        rows.append((" ".join(text), int(toxic)))
    return rows


def test_ratios_and_features_equal_plain_code(spark):
    rows = toxic_rows()
    n = [Counter(), Counter()]
    for text, toxic in rows:
        n[toxic].update(set(words(text)))
    every = sorted(set(n[0]) | set(n[1]))
    keys = _keys([w.encode() for w in every]).tolist()
    counted = spark.createDataFrame([(k, n[0][w], n[1][w]) for k, w in zip(keys, every, strict=True)], "key long, a long, b long")
    table = log_ratios(counted, [(F.col("a"), F.col("b")), (F.col("a"), F.lit(0))])
    assert table.where("v1 is not null").count() == 0  # a model without toxic words
    table = table.select("key", F.col("v0").alias("value"))
    want = brute_ratios(rows)
    texts = [rows[0][0], "unseen words only", "scum", "", None, " ".join(t for t, _ in rows)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for chunks in (chunks_of(table), None):
        if chunks is None:
            from lorekeep.llm import toxicity

            old, toxicity.CHUNK = toxicity.CHUNK, 50
            chunks, toxicity.CHUNK = chunks_of(table), old
            assert len(chunks) > 3
        for row in features(docs, chunks, ("doc_id",)).collect():
            z = [math.log(1 - SHARE + SHARE * math.exp(want.get(w, 0.0))) for w in words(texts[row["doc_id"]])]
            if not z:
                assert row["whole"] is None and row["stretch"] is None
                continue
            k = min(STRETCH, len(z))
            assert row["whole"] == pytest.approx(sum(z) / len(z), abs=1e-5)
            assert row["stretch"] == pytest.approx(max(sum(z[i : i + k]) / k for i in range(len(z) - k + 1)), abs=1e-5)


def test_fit_tells_toxic_from_clean_texts_it_has_not_seen(spark):
    rows = toxic_rows(400)
    learned, new = rows[:300], rows[300:]
    texts = [(i, t) for i, (t, _) in enumerate(learned)] + [(300, None), (301, "text"), (302, "text"), (None, "text"), (0, learned[0][0])]
    told = [(i, y) for i, (_, y) in enumerate(learned)] + [(300, 1), (301, None), (302, 7), (None, 1), (1, 0), (1, 1), (999, 1)]
    scorer = fit(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), spark.createDataFrame(told, "doc_id long, toxic int"))
    assert scorer.share == pytest.approx((sum(y for _, y in learned) + learned[0][1] + (1 - learned[1][1])) / 301)
    docs = spark.createDataFrame([(i, t, "de", 1.0) for i, (t, _) in enumerate(new)] + [(998, "", "", 0.0), (999, None, "", 0.0)], "doc_id long, text string, lang string, z double")
    got = {r["doc_id"]: r["score"] for r in score(docs, scorer).collect()}
    assert got[998] == got[999] == pytest.approx(scorer.share)
    wrong = sum((got[i] >= 0.5) != bool(y) for i, (_, y) in enumerate(new))
    assert wrong <= 3


def test_nothing_or_one_class_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = fit(docs, docs.limit(0).selectExpr("doc_id", "1 AS toxic"))
    assert [r["score"] for r in score(docs, none).collect()] == [0.0, 0.0]
    assert fit(docs, docs.selectExpr("doc_id", "1 AS toxic")).share == 1.0
    assert score(docs.limit(0), none).count() == 0


def test_curve_is_a_logistic_regression_without_negative_weights():
    r = np.random.default_rng(0)
    x = r.normal(size=(4000, 2))
    y = (r.random(4000) < 1 / (1 + np.exp(-(1 + 2 * x[:, 0])))).astype(int)
    w = curve(np.column_stack([x[:, 0], -x[:, 0] + x[:, 1]]), y)
    assert w[0] == pytest.approx(1, abs=0.2) and w[1] == pytest.approx(2, abs=0.3) and w[2] >= 0


def test_curve_converges_where_the_classes_are_apart():
    x = np.concatenate([np.full((90, 2), -0.005), np.full((10, 2), 0.04)]) + np.random.default_rng(1).normal(size=(100, 2)) / 1000
    y = np.repeat([0, 1], [90, 10])
    w = curve(x, y)
    p = 1 / (1 + np.exp(-(w[0] + x @ w[1:])))
    assert p[y == 1].min() > 0.9 and p[y == 0].max() < 0.1
