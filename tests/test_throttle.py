"""Throttled actions against a plain walk, for keys of any size, and scenes without extent."""

import random

import pytest

from lorekeep.operators import timeline as T


def brute(rows, seconds):
    kept, last = [], {}
    for k, us, i in sorted(set(rows), key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2])):
        if us is None or k not in last or us - last[k] >= seconds * T.SECOND:
            kept.append((k, i))
            if us is not None:
                last[k] = us
    return sorted(kept, key=repr)


@pytest.mark.parametrize("seconds", [1, 7, 1000])
def test_throttle_equals_a_walk(spark, seconds):
    r = random.Random(seconds)
    rows = [("hot", r.randrange(500) * T.SECOND // 2, i) for i in range(900)]  # one key with most rows, many ties
    rows += [(r.choice(["a", "b", None]), r.randrange(60) * T.SECOND, 1000 + i) for i in range(150)]
    rows += [("long", i * seconds * T.SECOND, 5000 + i) for i in range(70)]  # all are kept
    rows += [("dup", 5, 7000), ("dup", 5, 7000), ("none", None, 8000), ("none", None, 8001), ("none", 3, 8002), ("one", 1, 9000)]
    df = spark.createDataFrame(rows, "source string, us long, id long").repartition(5)
    got = sorted(((x.source, x.id) for x in T.throttle(df, ["source"], seconds).collect()), key=repr)
    assert got == brute(rows, seconds)


def test_throttle_of_nothing_and_without_a_wait(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 1, 2)], "source string, us long, id long")
    assert T.throttle(df.limit(0), ["source"], 5).count() == 0
    assert T.throttle(df, ["source"], 0).count() == 2
    assert [x.id for x in T.throttle(df, ["source"], 5).collect()] == [1]


def test_scenes_without_name_or_extent(spark):
    df = spark.createDataFrame([(None, 1, 0.0, 0.0, 5.0, 1.0), (None, 2, 4.0, 2.0, 5.0, 1.0), ("flat", 3, 1.0, 1.0, 1.0, 2.0)], "scene string, id long, x double, y double, z double, size double")
    got = {x.id: (x.x, x.y, x.z, x.size) for x in T.scene_normalise(df).collect()}
    assert got == {1: (-1.0, -0.5, 0.0, 0.5), 2: (1.0, 0.5, 0.0, 0.5), 3: (0.0, 0.0, 0.0, 2.0)}
