"""Tokens, chats, fingerprints, languages, licences, decontamination and sharding."""

import base64
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.llm import bpe, chat, decontam, langid, licenses, sharding, spotsigs
from lorekeep.llm.queries import ORACLES

tokenizers = pytest.importorskip("public_tokenizers")


def test_tokens_are_those_of_the_library_and_decode(docs, rows, real):
    import tiktoken

    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in bpe.encode_decode(docs, path, tokenizers.PATTERN, keep_text=True).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    own = bpe.Bpe(open(path, "rb").read(), tokenizers.PATTERN)
    r = random.Random(1)
    odd = ["".join(chr(r.choice([97, 98, 32, 233, 0x1F600, 10, 39, 49])) for _ in range(n)) for n in range(1, 200)]
    for text in [t for _, t in real] + odd:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_chats_match_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    assert sorted(map(tuple, chat.op8_chat(spark, sf).collect())) == sorted(con.execute(ORACLES["op8_chat"]).fetchall())


def test_control_strings_come_back(spark):
    odd = ["<|end|>", "\\", "<\\|", "[/INST] [INST] </s> <s>", "<|turn|>user<|body|>x", "", None, "a\\<|\\\\[INST]", "<", "|>", "<" * 9 + "|"]
    turns = spark.createDataFrame([(1, i, "assistant" if i % 2 else "user<|", t) for i, t in enumerate(odd)], "conv_id long, turn long, role string, text string")
    made = chat.format_chats(turns.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))).withColumn("back", chat.read_turns(F.col("formatted"))).first()
    assert [(t.role, t.text) for t in made.back] == [("assistant" if i % 2 else "user<|", t or "") for i, t in enumerate(odd)]
    raw = [made.formatted[m.start : m.start + m.length] for m in made.loss_mask]
    assert len(raw) == 5
    for control in ("</s>", "[INST]", "[/INST]", "<|"):
        assert not any(control in x for x in raw)


def test_parts_flatten_in_order(spark):
    parts = [("text", "see", None, None), ("image", None, "i.png", None), ("audio", None, "a.wav", 9), ("video", None, "v", 1), ("text", None, None, None), ("document", None, "d.pdf", None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, None, None)], "conv_id long, turn long, role string, parts array<struct<type:string,text:string,ref:string,tokens:int>>")
    made = chat.format_chats(df).first()
    assert made.formatted == "<|turn|>user<|body|>see<|image:1|><|audio:2|><|document:5|><|end|><|turn|><|body|><|end|>"
    assert [(a.turn, a.place, a.type, a.ref, a.tokens) for a in made.attachments] == [(1, 1, "image", "i.png", 576), (1, 2, "audio", "a.wav", 9), (1, 5, "document", "d.pdf", 1024)]
    assert chat.format_chats(df.limit(0)).count() == 0


def test_fingerprints(spark, sf, real):
    got = {r.doc_id: r for r in spotsigs.op6_spotsigs(spark, sf).collect()}
    order = sorted(real, reverse=True)
    prints = {}
    for i, (d, t) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[d].n_chars == len(t)
        assert prints.setdefault(t, got[d].fingerprint) == got[d].fingerprint
        sets = [{x[k : k + 16] for k in range(0, len(x), 16)} for x in (got[d].fingerprint, got[d].edited_fingerprint)]
        if all(len(y) % 16 == 0 for y in (got[d].fingerprint, got[d].edited_fingerprint)):
            assert 0 <= got[d].near_edited <= 1
        assert sets[0]
    assert np.mean([r.near_edited for r in got.values()]) > 5 * np.mean([r.near_next for r in got.values()])


def test_spots_skip_common_words(spark):
    df = spark.createDataFrame([("the cat of the dog ran",), ("THE cat, of the -- dog ran!",), ("the cat dog ran",), ("",), (None,), ("zzz",)], "t string")
    s = [r.s for r in df.select(spotsigs.signatures(F.col("t")).alias("s")).collect()]
    assert s[0] == s[1] != s[2]
    assert s[3] == s[4] != s[5]
    assert len(s[0]) == 3 and len(s[5]) == 1


def test_near_pairs_match_brute_force(docs, rows):
    signed = {r.doc_id: frozenset(r.s) for r in docs.select("doc_id", spotsigs.signatures(F.col("text")).alias("s")).collect()}
    first = {}
    for d in sorted(signed):
        first.setdefault(signed[d], d)
    want = {(a, b): len(x & y) / len(x | y) for x, a in first.items() for y, b in first.items() if a < b and len(x & y) >= 0.5 * len(x | y)}
    got = {(r.a, r.b): r.likeness for r in spotsigs.near_pairs(docs, 0.5).collect()}
    assert got == pytest.approx(want)


def test_languages_of_held_out_documents(spark, sf):
    path = sf.replace("0.001", "0.01")
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang").collect()}
    got = langid.op2_langid(spark, path).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {d for d in lang if zlib.crc32(str(d).encode()) % 4 == 2}
    assert np.mean([lang[r.doc_id] == r.lang_pred for r in held]) > 0.97
    assert len(got) == len(lang)


def test_scripts_spans_and_odd_texts(spark):
    en, ru, el = "the house and the garden of the king " * 9, "дом и сад у реки и леса на горе " * 9, "το σπίτι και ο κήπος του βασιλιά " * 9
    model = langid.fit(spark.createDataFrame([("en", en), ("ru", ru), ("el", el), (None, en), ("en", None)], "lang string, text string"))
    df = spark.createDataFrame([(1, "the garden дом и сад у реки"), (2, None), (3, "12 !"), (4, "日本"), (5, ru + en + el), (6, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identify(df, model).collect()}
    assert [(s.lang, s.first, s.end) for s in got[1].spans] == [("en", 0, 2), ("ru", 2, 7)]
    assert [got[i].lang_pred for i in (2, 3, 6)] == ["und"] * 3 and got[2].score == 0 and not got[3].spans
    assert got[4].lang_pred in ("en", "ru", "el")
    assert [s.lang for s in got[5].spans] == ["ru", "en", "el"]
    assert langid.identify(df.limit(0), model).count() == 0
    none = langid.fit(spark.createDataFrame([], "lang string, text string"))
    assert {r.lang_pred for r in langid.identify(df, none).collect()} == {"und"}


def test_viterbi_matches_brute_force():
    from itertools import product

    r = np.random.default_rng(2)
    scores = r.normal(size=(20, 3)).astype(np.float32) * 3
    ids, first = r.integers(0, 20, 18), np.array([0, 5, 5, 11, 18])
    got = langid.viterbi(scores, ids, first, 2.0)
    for a, b in zip(first[:-1], first[1:], strict=True):
        cost = lambda p: sum(scores[w, x] for w, x in zip(ids[a:b], p, strict=True)) - 2.0 * sum(x != y for x, y in zip(p, p[1:], strict=False))
        best = max(product(range(3), repeat=b - a), key=cost)
        assert cost(got[a:b].tolist()) == pytest.approx(cost(best), abs=1e-4)


def distance(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [row[0] + 1]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_myers_matches_dynamic_programming():
    r = random.Random(4)
    for _ in range(200):
        p, t = ("".join(r.choice("abc") for _ in range(n)) for n in (r.randrange(1, 90), r.randrange(0, 120)))
        assert decontam.myers(decontam.positions(p), len(p), t)[0] == distance(p, t)


def test_decontamination_finds_edited_items(spark, docs):
    r = random.Random(8)
    item = " ".join(r.choice(["alpha", "beta", "gamma", "delta", "omega"]) for _ in range(40))
    budget = int(decontam.RATE * len(item))
    edit = lambda n: "".join(c if i % (len(item) // n) else "#" for i, c in enumerate(item))[: len(item)]
    texts = [(1, "x " + item + " y"), (2, "pre " + edit(budget) + " post"), (3, item.upper().replace(" ", "\n")), (4, edit(3 * budget)), (5, item[: len(item) // 2]), (6, None), (7, "")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame([(9, item), (8, None), (7, " ")], "item_id long, text string")
    got = {r.doc_id: r for r in decontam.contaminated(df, bench).collect()}
    assert set(got) == {1, 2, 3}
    assert got[1].distance == got[3].distance == 0 and 0 < got[2].distance <= budget
    assert sorted(r.doc_id for r in decontam.decontaminate(df, bench).collect()) == [4, 5, 6, 7]
    assert decontam.contaminated(docs, bench).count() == 0
    assert decontam.contaminated(df, bench.limit(0)).count() == 0


def test_licences_are_inherited_from_the_nearest_directory(spark):
    files = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c/x.py", "code here"), (3, "a/b/NOTICE", "Licensed under the Apache License, Version 2.0."), (4, "d/y.py", "plain"),
        (5, "a/z.py", "Licensed under CC BY-NC 4.0.\n" + "long text " * 50), (6, None, "code"), (7, "a/q.py", None), (8, "a/r.py", "a license to say anything at all about nothing of note"),
    ]
    got = {r.file_id: (r.license, r.how, r.inherited_from) for r in licenses.scan_licenses(spark.createDataFrame(files, "file_id long, path string, text string")).collect()}
    assert got[1] == ("MIT", "own", None) and got[3] == ("Apache-2.0", "own", None) and got[5] == ("CC-BY-NC-4.0", "own", None)
    assert got[2] == ("Apache-2.0", "inherited", "a/b/NOTICE")
    assert got[7] == ("MIT", "inherited", "a/LICENSE") == got[8]
    assert got[4] == got[6] == (None, "none", None)
    assert licenses.scan_licenses(spark.createDataFrame([], "file_id long, path string, text string")).count() == 0


def best_capacity(sizes, n):
    lo, hi = max([*sizes, -(-sum(sizes) // n)]), sum(sizes)
    while lo < hi:
        mid, used, room = (lo + hi) // 2, 1, (lo + hi) // 2
        for s in sizes:
            if s > room:
                used, room = used + 1, mid
            room -= s
        lo, hi = (lo, mid) if used <= n else (mid + 1, hi)
    return lo


@pytest.mark.parametrize("skip", [5, 16384])
def test_shards_are_minimax(spark, monkeypatch, skip):
    monkeypatch.setattr(sharding, "SKIP", skip)
    r = random.Random(6)
    rows = [(i, f"g{r.randrange(60):02d}" if r.random() < 0.9 else "hot", r.randrange(1, 500)) for i in range(400)] + [(900, None, 7), (901, "g00", None), (901, "g00", None)]
    made = sharding.minimax_shards(spark.createDataFrame(rows, "row_id long, group_key string, size long"), 7).collect()
    by_group, by_shard, load = {}, {}, {}
    for x in made:
        by_group.setdefault(x.group_key, set()).add(x.shard)
        by_shard.setdefault(x.shard, []).append(x.slot)
        load[x.shard] = load.get(x.shard, 0) + (x["size"] or 0)
    assert all(len(s) == 1 for s in by_group.values())
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    names = sorted(by_group, key=lambda g: (g is not None, g or ""))
    sizes = [sum((x[2] or 0) for x in rows if x[1] == g) for g in names]
    assert max(load.values()) == best_capacity(sizes, 7)
    assert [next(iter(by_group[g])) for g in names] == sorted(next(iter(by_group[g])) for g in names)


def test_sharding_of_documents(spark, sf, real):
    got = sharding.op1_sharding(spark, sf).collect()
    text = dict(real)
    assert len(got) == len(real) and {r.shard for r in got} <= set(range(24))
    for r in got:
        assert (r["size"], r.text_crc32) == (len(text[r.doc_id].encode()) + 8, zlib.crc32(text[r.doc_id].encode()))
    empty = spark.createDataFrame([], "row_id long, group_key string, size long")
    assert sharding.minimax_shards(empty, 3).count() == 0


def test_near_pairs_at_and_beyond_the_ends_of_the_threshold(spark):
    from lorekeep.llm.spotsigs import near_pairs

    docs = spark.createDataFrame([(1, "the cat saw a dog by the bird sang well"), (2, "the cat saw a dog by the fish sang well"), (3, "the cat saw a dog by the bird sang well"), (3, None), (None, "the x")], "doc_id long, text string")
    assert near_pairs(docs, 1.0).count() == 0
    assert near_pairs(docs.limit(0), 1.0).count() == near_pairs(docs.limit(0)).count() == 0
    assert [(r.a, r.b) for r in near_pairs(docs, 0.1).collect()] == [(1, 2)]
    for bad in (0, 1.5):
        with pytest.raises(ValueError):
            near_pairs(docs, bad)
