"""The corpus pipeline on the smallest table, against plain code."""

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")


def test_pipeline_matches_plain_code(spark, sf, real, tmp_path):
    import corpus_pipeline as p
    from test_dedup import groups

    from lorekeep.llm import decontam

    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in p.STAGES:
        made = stage(spark, docs, sf)
        made.write.parquet(str(tmp_path / name))
        made = spark.read.parquet(str(tmp_path / name))
        if name != "tokens":
            assert made.columns == docs.columns
        seen[name], docs = made, made
    text = lambda name: {r.doc_id: r.text for r in seen[name].select("doc_id", "text").collect()}
    first = text("language")
    assert first == {d: t for d, t in real if any(c.isalpha() for c in t)}
    second = text("near_duplicates")
    assert second == {d: first[d] for d, (_, _, kept) in groups(list(first.items()), 5, 80).items() if kept}
    third, earlier = text("repeats"), {}
    for d in sorted(second):
        data = second[d].encode()
        hit = np.zeros(len(data), bool)
        for i in range(len(data) - 49):
            if earlier.setdefault(data[i : i + 50], d) < d:
                hit[i : i + 50] = True
        at, out = 0, []
        for c in second[d]:
            n = len(c.encode())
            if not hit[at : at + n].all():
                out.append(c)
            at += n
        assert third[d] == "".join(out)
    items = [decontam.normal(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    fourth = text("benchmarks")
    assert not [d for d, t in fourth.items() if any(i in decontam.normal(t) for i in items)]
    matcher = decontam.Matcher(list(enumerate(items)), decontam.RATE)
    assert set(fourth) == {d for d, t in third.items() if not matcher.match(decontam.normal(t))}
    last = seen["tokens"].collect()
    assert {r.doc_id for r in last} == set(fourth) and all(r.decodes and 4 * r.n_tokens == len(r.ids) for r in last)


def test_near_duplicates_keep_every_text_of_a_document(spark, sf):
    import corpus_pipeline as p

    a, b = " ".join(f"a{i}" for i in range(80)), " ".join(f"b{i}" for i in range(80))
    rows = [(2, a), (4, a), (4, b), (9, b), (9, b), (7, None), (7, ""), (8, "short"), (None, a), (None, a)]
    docs = spark.createDataFrame([(d, t, "en", "r", 1, 0.5) for d, t in rows], "doc_id long, text string, lang string, rank string, n_chars long, mark double").repartition(3)
    made = p.one_of_each_group(spark, docs, sf)
    assert made.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in made.collect()), key=repr)
    assert got == sorted([(2, a), (4, b), (7, None), (7, ""), (8, "short"), (None, a), (None, a)], key=repr)
    assert p.one_of_each_group(spark, docs.limit(0), sf).count() == 0
