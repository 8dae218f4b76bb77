"""Learning from copied texts and from many languages."""

import numpy as np

from lorekeep.llm import langid


def test_copies_of_a_text_do_not_thin_what_is_learned(spark):
    # 40 distinct texts of 50 copies each, and one text copied 2,000 times: 10 rows of 2,000 and more would be picked by rows.
    rows = [("aa", f"kalo{i} mena{i} tiru") for i in range(40) for _ in range(50)] + [("bb", "zumbo wexil qarp")] * 2000
    model = langid.fit(spark.createDataFrame(rows, "lang string, text string"), rows=40)
    assert model.langs == ["aa", "bb"]
    single = langid.fit(spark.createDataFrame(sorted(set(rows)), "lang string, text string"), rows=40)
    assert single.number.keys() == model.number.keys() and np.array_equal(np.sort(single.table, axis=0), np.sort(model.table, axis=0))


def test_every_language_keeps_a_text_and_there_is_no_256th(spark):
    rows = [(f"l{i:03}", f"{chr(97 + i // 26)}{chr(97 + i % 26)}q{chr(97 + i % 7)}") for i in range(300)]
    model = langid.fit(spark.createDataFrame(rows, "lang string, text string"), rows=0)
    assert len(model.langs) == 300
    scores = np.full((300, 300), -10, np.float32)
    np.fill_diagonal(scores, 0)
    assert langid.viterbi(scores, np.array([299, 299, 270]), np.array([0, 2, 3])).tolist() == [299, 299, 270]
