"""Licences of files: sparse TF-IDF cosine of statements to templates, and inheritance from the nearest ancestor directory.

All on DataFrame functions. A text is cut at line ends and sentence ends, long lines at commas too. A
statement is a window of neighbouring segments that begins at most two before a word of licences, so
wrapped notices, paragraphs of licences and sentences inside long lines are statements; in each of its
segments at least half of the words occur in some template. The whole text is one more, scored against
those full licence texts of whose words it has at least half. Weights come from the segments where
statements begin. A file's licence is what its SPDX tag names, else that of its best statement. Files
that are named as licence files or that are a full licence text are their directory's licence file, and
files without a licence of their own take that of the nearest directory above them that has one.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, read_table
from .spotsigs import COMMON, bind

# Short forms, standard headers, titles and grants of licences, by SPDX identifier.
_GNU = "This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation{mark2} either version {n} of the License, or (at your option) any later version."
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    ],
    "BSD-2-Clause": ["BSD 2-Clause License.", "Licensed under the BSD 2-Clause License."],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted. BSD 3-Clause License.",
        "BSD 3-Clause License.",
        "Licensed under the BSD 3-Clause License.",
    ],
    "CC-BY-4.0": [
        "This work is licensed under the Creative Commons Attribution 4.0 International License. Licensed under CC BY 4.0.",
        "This work is licensed under the Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Creative Commons Attribution 4.0 International Public License",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Creative Commons Attribution-NonCommercial 4.0 International Public License",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "GNU General Public License Version 2, June 1991",
        _GNU.format(what="program", mark=";", mark2=";", kind="General Public License", n=2),
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "GNU General Public License Version 3, 29 June 2007",
        _GNU.format(what="program", mark=":", mark2=",", kind="General Public License", n=3),
    ],
    "LGPL-2.1": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "GNU Lesser General Public License Version 2.1, February 1999",
        _GNU.format(what="library", mark=";", mark2=";", kind="Lesser General Public License", n="2.1"),
    ],
    "LGPL-3.0": [
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "GNU Lesser General Public License Version 3, 29 June 2007",
        _GNU.format(what="library", mark=":", mark2=",", kind="Lesser General Public License", n=3),
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "MIT License",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    ],
    "MPL-2.0": [
        "This source code form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Mozilla Public License Version 2.0",
    ],
}
#: Full licence texts, by SPDX identifier.
TEXTS = {p.stem: p.read_text() for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
#: Words near which a statement begins; each template has one.
ANCHORS = r"licen[cs]\w*|redistribut\w*|permission|mozilla|gnu|apache|bsd|creative commons|cc[ -]by"
#: Segments of a window, words from which on a line is cut at commas too, and how far before an anchor a window begins.
LENGTHS, LONG, BEFORE = (1, 2, 3, 4, 5, 6, 8, 10, 12, 16), 25, 2
#: Least cosine of a statement to its template; least share of a segment's words in templates, and of a full text's words in a text.
COSINE, SHARE = 0.7, 0.5
#: Tasks that the files of one directory are dealt to.
SALT = 32
# Names of licence files, and the tag that names a licence.
LICENSE_NAME = r"(?i)^(?:.*/)?(?:un)?(?:licen[cs]e|copying|notice)[^/]*$"
SPDX = r"SPDX-License-Identifier:\s*\(?([A-Za-z0-9][A-Za-z0-9.+-]*)"
_WORD = r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*"


def words_of(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(_WORD), F.lit(0))


def _key_words(templates: dict[str, str]) -> list[str]:
    import re

    found = {w for t in templates.values() for w in re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", t.lower())}
    return sorted(w for w in found - set(COMMON) if len(w) > 2 and not w[0].isdigit())


def segments_of(text: Column) -> Column:
    """Lines and sentences with a word; lines of more than LONG words are cut at commas, brackets and before `licensed under` too."""
    clean = lambda x: F.regexp_replace(x, r"([.!?;:])\s+", "$1\n")
    fine = lambda x: F.regexp_replace(F.regexp_replace(x, r"[,()]\s*", "$0\n"), r"(?i)\s(?=(?:licensed|released|distributed|available) under)", "\n")
    lines = F.split(text, r"[\r\n]+")
    cut_up = F.transform(lines, lambda x: F.when(F.size(words_of(x)) > LONG, fine(clean(x))).otherwise(clean(x)))
    return F.filter(F.split(F.array_join(cut_up, "\n"), "\n+"), lambda x: x.rlike(r"[\p{L}\p{N}]"))


def _vocabulary(texts: list[str]) -> list[str]:
    import re

    return sorted({w for t in texts for w in re.findall(r"[^\W_]+(?:[.-][^\W_]+)*", t.lower())})


def _share(words: Column, known: list[str]) -> Column:
    return F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in known])))


def _near(files: DataFrame, anchors: str, forms: list[str], texts: dict[str, str]) -> DataFrame:
    """(file, segs, sizes, like, spots, full) of files that have a word of licences: segments, their words, whether each
    can be part of a statement, where statements begin, and the full licence texts that the whole text is scored against."""
    near = files.where(F.lower("text").rlike(anchors)).select("file", "text", segments_of(F.col("text")).alias("segs")).where(F.size("segs") > 0)
    near = near.withColumn("sizes", F.transform("segs", lambda x: F.size(words_of(x))))
    vocabulary = _vocabulary(forms)
    like = F.transform("segs", lambda x: bind(F.array_distinct(words_of(x)), lambda w: _share(w, vocabulary) >= SHARE * F.size(w)))
    every = F.array_distinct(words_of(F.col("text")))
    full = F.filter(F.array(*[F.when(_share(F.col("every"), v) >= SHARE * len(v), F.lit(k)) for k, t in texts.items() for v in (_vocabulary([t]),)]), lambda x: x.isNotNull()) if texts else F.array().cast("array<string>")
    marked = F.transform("segs", lambda x: F.lower(x).rlike(anchors))
    near = near.withColumns({"like": like, "marked": marked, "every": every})
    spots = F.filter(F.sequence(F.lit(1), F.size("segs")), lambda i: F.get("like", i - 1) & F.exists(F.slice("marked", i, BEFORE + 1), lambda x: x))
    return near.select("file", "segs", "sizes", "like", "marked", spots.alias("spots"), full.alias("full"))


def _statements(near: DataFrame) -> DataFrame:
    """(file, key, first, unit, sizes, single, whole): windows of segments, and whole texts; key tells units apart."""
    lengths = F.array(*[F.lit(n) for n in LENGTHS])
    window = lambda i, n, single, whole: F.struct(i.alias("first"), F.array_join(F.slice("segs", i, n), " ").alias("unit"), F.slice("sizes", i, n).alias("sizes"), single.alias("single"), F.lit(whole).alias("whole"))
    fits = lambda i: lambda n: (i + n - 1 <= F.size("segs")) & F.forall(F.slice("like", i, n), lambda x: x)
    some = F.flatten(F.transform("spots", lambda i: F.transform(F.filter(lengths, fits(i)), lambda n: window(i, n, (n == 1) & F.get(F.col("marked"), i - 1), False))))
    every = F.when(F.size("full") > 0, F.array(window(F.lit(1), F.size("segs"), F.lit(False), True))).otherwise(F.slice(some, 1, 0))
    out = near.select("file", F.explode(F.concat(some, every)).alias("w")).select("file", "w.*")
    return out.withColumn("key", F.unhex(F.md5("unit")))


def scan_licenses(files: DataFrame, templates: dict[str, str] | None = None, cosine: float = COSINE) -> DataFrame:
    """(file_id, license, score, how, inherited_from) for each of files (file_id, path, text).

    how is `own`, `inherited` or `none`; a tag has score 1. Null and empty texts have no statements; a
    null path is in no directory; files without id are told apart by path and text. Of equally good
    statements the first by licence counts; of several licence files in a directory the one of highest
    score, then of first path and smallest id. Repeated rows get one answer each. Further columns are left out. An
    empty table gives an empty table. With templates (licence, text) of the caller's own only those are looked for.
    """
    spark = files.sparkSession
    forms = [(k, f"{k} {i}", False, t) for k, v in (templates or TEMPLATES).items() for i, t in enumerate([v] if isinstance(v, str) else v)]
    texts = {} if templates else TEXTS
    pattern = rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(_key_words(templates)) if templates else ANCHORS})(?![\p{{L}}\p{{N}}])"
    files = files.select("file_id", F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    # Rows are told apart by all they have, as an id can be null or used twice.
    files = files.withColumn("file", F.unhex(F.md5(F.to_json(F.struct(F.col("file_id").cast("string").alias("i"), "path", F.md5("text").alias("t"))))))
    near = cut(_near(files, pattern, [t for *_, t in forms], texts).distinct())
    lines = _statements(near)
    singles = lines.where("single")
    total = singles.count()
    # Words of full texts and of forms: known before any text is read.
    known = spark.createDataFrame([*forms, *((k, f"{k} text", True, t) for k, t in texts.items())], "license string, template string, whole boolean, text string")
    damped = (F.log(F.count("*")) + 1).alias("tf")
    wanted = known.select("license", "template", "whole", F.explode(words_of(F.col("text"))).alias("word")).groupBy("license", "template", "whole", "word").agg(damped)
    # Equal statements are scored once, whatever their number.
    statements = lines.groupBy("key", "whole").agg(F.first("unit").alias("unit"))
    terms = statements.select("key", "whole", F.explode(words_of(F.col("unit"))).alias("word")).groupBy("key", "whole", "word").agg(damped)
    df = singles.select(F.explode(F.array_distinct(words_of(F.col("unit")))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    weights = df.select("word", (F.log(F.lit(total + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    unseen = F.log(F.lit(float(total + 1))) + 1
    weighed = terms.join(weights, "word", "left").select("key", "whole", "word", (F.col("tf") * F.coalesce("idf", unseen)).alias("w"))
    models = wanted.join(weights, "word", "left").select("license", "template", "whole", "word", (F.col("tf") * F.coalesce("idf", unseen)).alias("m"))
    norms = models.groupBy("template").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("m_norm"))
    own_norm = weighed.groupBy("key", "whole").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("w_norm"))
    dots = weighed.join(F.broadcast(models), ["whole", "word"]).groupBy("key", "whole", "license", "template").agg(F.sum(F.col("w") * F.col("m")).alias("dot"))
    scored = dots.join(own_norm, ["key", "whole"]).join(F.broadcast(norms), "template").select("key", "whole", "license", F.round(F.col("dot") / F.col("w_norm") / F.col("m_norm"), 9).alias("score"))
    top = scored.groupBy("key", "whole").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b")).select("key", "whole", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score")).where(F.col("score") >= cosine)
    found = lines.select("file", "key", "whole").join(top, ["key", "whole"])
    # A whole licence text tells more than a statement in it.
    best = found.groupBy("file").agg(F.min(F.struct((~F.col("whole")).alias("part"), (-F.col("score")).alias("s"), "license")).alias("b"), F.max("whole").alias("whole"))
    best = best.select("file", F.col("b.license").alias("found"), (-F.col("b.s")).alias("found_score"), "whole")
    tag = F.regexp_extract("text", SPDX, 1)
    placed = files.select("file_id", "file", "path", F.when(tag != "", tag).alias("tag")).join(best, "file", "left")
    directory = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.when(F.col("path").isNotNull(), F.lit("")))
    own = {"own": F.coalesce("tag", "found"), "own_score": F.when(F.col("tag").isNotNull(), 1.0).otherwise(F.col("found_score")), "dir": directory}
    placed = placed.withColumns(own).withColumn("is_file", F.coalesce("whole", F.lit(False)) | F.col("path").rlike(LICENSE_NAME))
    first = F.min(F.struct((-F.col("own_score")).alias("s"), "path", "file_id", "own")).alias("b")
    declared = placed.where("is_file and own is not null and dir is not null").groupBy("dir").agg(first).select("dir", F.col("b.own").alias("dir_license"), (-F.col("b.s")).alias("dir_score"), F.col("b.path").alias("dir_file"))
    # Directories above each directory, nearest first: a path join instead of a walk.
    dirs = placed.where("dir is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.struct((F.size(parts) - n).alias("up"), F.array_join(F.slice(parts, 1, n), "/").alias("above")))
    nearest = (
        dirs.select("dir", F.explode(above).alias("a"))
        .select("dir", "a.*")
        .join(declared.withColumnRenamed("dir", "above"), "above")
        .groupBy("dir")
        .agg(F.min(F.struct("up", "dir_license", "dir_score", "dir_file")).alias("n"))
        .select("dir", "n.dir_license", "n.dir_score", "n.dir_file")
    )
    # A directory may hold a third of all files: its few rows are repeated, its files dealt to SALT tasks.
    salted = nearest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    out = placed.withColumn("salt", F.pmod(F.xxhash64("file"), F.lit(SALT)).cast("int")).join(salted, ["dir", "salt"], "left")
    return out.select(
        "file_id",
        F.coalesce("own", "dir_license").alias("license"),
        F.coalesce("own_score", "dir_score", F.lit(0.0)).alias("score"),
        F.when(F.col("own").isNotNull(), "own").when(F.col("dir_license").isNotNull(), "inherited").otherwise("none").alias("how"),
        F.when(F.col("own").isNull(), F.col("dir_file")).alias("inherited_from"),
    )


def op9_licenses(spark, sf_dir: str) -> DataFrame:
    """Licences of all documents, as files source/lang/doc_id."""
    docs = read_table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.col("doc_id").cast("string"))
    found = scan_licenses(docs.select(F.col("doc_id").alias("file_id"), path.alias("path"), "text"))
    return found.select(F.col("file_id").alias("doc_id"), "license", "score", "how", "inherited_from")
