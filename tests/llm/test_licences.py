"""Licences in the forms that files have: wrapped headers, whole texts, and statements inside paragraphs."""

import re
import textwrap
from pathlib import Path

from lorekeep.llm import licenses

TEXTS = Path(licenses.__file__).parent / "license_texts"
GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
import os
"""
GRANT = textwrap.dedent("""\
    /* Permission is hereby granted, free of charge, to any person obtaining a copy
     * of this software and associated documentation files (the "Software"), to deal
     * in the Software without restriction, including without limitation the rights
     * to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
     * copies of the Software, and to permit persons to whom the Software is
     * furnished to do so, subject to the following conditions: */
    int main(void) { return 0; }
    """)
PARAGRAPH = "The tables of this survey were gathered over several summers by many hands, (first in the north, then along the coast). Released under the MIT License. Comments on them are welcome, and the next edition will hold those of the islands too, where weather allows."


def test_licences_in_headers_whole_texts_and_paragraphs(spark):
    whole = {p.stem: p.read_text() for p in TEXTS.glob("*.txt")}
    files = [("gpl", "s/gpl.py", GPL), ("gpl2", "s/gpl2.py", GPL.replace("version 3", "version 2")), ("grant", "s/x.c", GRANT), ("sentence", "s/p.txt", PARAGRAPH), ("title", "s/t", "MIT License")]
    files += [("plain", "n/q.txt", "You may use this work as you like, with or without permission; no license is meant. " * 30)]
    for name, text in whole.items():
        files += [(name, f"{name}/LICENSE", re.sub(r"(?i)copyright \(c\)[^\n]*", "Copyright (c) 2024 Ann Other", text)), (f"in {name}", f"{name}/src/a.py", "code")]
    found = {r.file_id: r for r in licenses.scan_licenses(spark.createDataFrame(files, "file_id string, path string, text string")).collect()}
    got = {k: (r.license, r.how) for k, r in found.items()}
    want = {"gpl": ("GPL-3.0", "own"), "gpl2": ("GPL-2.0", "own"), "grant": ("MIT", "own"), "sentence": ("MIT", "own"), "title": ("MIT", "own"), "plain": (None, "none")}
    want |= {k: (k, "own") for k in whole} | {f"in {k}": (k, "inherited") for k in whole}
    assert got == want


def test_every_template_has_an_anchor():
    assert all(re.search(licenses.ANCHORS, t.lower()) for forms in licenses.TEMPLATES.values() for t in forms)
