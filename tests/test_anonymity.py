"""Names and uids are hidden whatever they look like, or the line is not published."""

from pyspark.sql import functions as F

from lorekeep.functions import text as X
from lorekeep.operators import anonymity as A
from lorekeep.operators import revision as R

PEOPLE = [
    ("ann@x:1", "Ann", "a friend", False), ("ann@x:12", "Ann Other", "someone", False), ("u:3", "Bob", "label $1 \\ here", False), ("u:4", "C++", "a coder", False), ("u:5", "++", "signs", False),
    ("u:6", "Lore", "nobody", True), ("u:7", "Al", "a pal", False), ("u:8", "Eve", "a foe of Bob", False), ("u:9", "X", "short", False), (None, "Ñandú O'Neil", "a bird", False), ("q\\Eq", "a\\Eb", "odd", False), ("u:10", None, "ten", False), ("u:11", "Ann", "b friend", False), ("u:12", "Nolabel", None, False),
]
LINES = {
    "Ann Other is kind": "someone is kind", "ann other, ANN": "someone, a friend", "bob was here": "label $1 \\ here was here", "Also Al said": "Also a pal said", "likes C++ and c++!": "likes a coder and a coder!", "more c++x": "more csignsx" if False else "more c++x",
    "I am Lore": "I am Lore", "X marks": "X marks", "ñandú o'neil flew": "a bird flew", "mail ANN@X:12 or ann@x:1": "mail someone or a friend", "inxu:3y": "inxlabel $1 \\ herey", "Ann (ann@x:1) came": "a friend came", "Eve left": None, "u:8 left": None,
    "Annabel sang": "Annabel sang", "a\\Eb and q\\Eq": "odd and odd", "": "", "id U:10!": "id ten!", "Nolabel stays": "Nolabel stays", "Ann  Other": "a friend  Other",
}


def people(spark):
    return spark.createDataFrame(PEOPLE, "uid string, name string, label string, is_me boolean")


def test_lines_are_hidden_or_left_out(spark):
    lines = spark.createDataFrame([(i, t) for i, t in enumerate(LINES)] + [(99, None)], "id long, text string").repartition(3)
    got = {r.id: r.text for r in A.hide_people(lines, people(spark)).collect()}
    assert {t: got[i] for i, t in enumerate(LINES)} == LINES
    assert got[99] is None and len(got) == len(LINES) + 1


def test_nobody_to_hide_and_nothing_to_read(spark):
    lines = spark.createDataFrame([(1, "Ann"), (2, "x " * 50_000 + "Ann")], "id long, text string")
    assert [r.text for r in A.hide_people(lines, people(spark).limit(0)).orderBy("id").collect()] == ["Ann", "x " * 50_000 + "Ann"]
    assert [r.text[-8:] for r in A.hide_people(lines, people(spark)).orderBy("id").collect()] == ["a friend", "a friend"]
    assert A.hide_people(lines.limit(0), people(spark)).count() == 0


def test_posts_leave_out_lines_that_leak(spark):
    t = spark.createDataFrame([("t1", "x", True, ["Eve left", "Ann Other is kind", "u:4 (C++) codes"], None), ("t2", "x", True, ["Eve left"], None), ("t3", "x", True, [], None)], "id string, original string, postable boolean, premises array<string>, derived_by string")
    got = {r.slug: (r.multi_hop, r.proof) for r in R.post_rows(t, people(spark)).collect()}
    assert got == {"t1": (True, "1. someone is kind\n2. a coder codes"), "t2": (False, ""), "t3": (False, "")}


def test_few_people_as_columns(spark):
    few = [("u:1", "Ann", "a $friend"), ("u:12", "Ann Other", "someone"), ("u:3", "Al", "pal of Ann"), ("u:4", "C++", "coder")]
    df = spark.createDataFrame([("Ann Other\nAlso Ann\nal\nu:12, U:1\nx@y\nc++",)], "t string")
    assert df.select(X.scrub_names(F.col("t"), few)).first()[0] == "someone\nAlso a $friend\nsomeone, a $friend\ncoder"
    assert df.select(X.scrub_names(F.col("t"), [])).first()[0] == "Ann Other\nAlso Ann\nal\nu:12, U:1\nc++"
