"""Licences of small trees, the plan, and the query's SQL twin."""

import math
import random
import re
import textwrap

import pytest

from lethe.llm import license, queries

from .frames import DATA


def scan(spark, files):
    frame = spark.createDataFrame([(p, t, 1) for p, t in files], "path string, text string, score int")
    return {r["path"]: (r["license"], r["origin"], r["license_path"]) for r in license.scan(frame).collect()}


def test_inheritance(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    found = scan(
        spark,
        [
            ("a/LICENSE", mit), ("a/b/c/x.py", "import os"), ("a/b/COPYING.txt", apache), ("a/b/d/y.py", None), ("ab/z.py", "text"), ("a/own.py", f"# {apache}\ncode"),
            ("top.py", ""), ("a/notes.txt", "the licence of the photo is unclear"), ("a/b/license_check.py", mit + " x y z"),
        ],
    )
    assert found["a/b/c/x.py"] == ("Apache-2.0", "inherited", "a/b/COPYING.txt") and found["a/b/d/y.py"] == ("Apache-2.0", "inherited", "a/b/COPYING.txt")
    assert found["ab/z.py"] == (None, "none", None) == found["top.py"]
    assert found["a/own.py"] == ("Apache-2.0", "own", "a/own.py") and found["a/notes.txt"] == ("MIT", "inherited", "a/LICENSE")
    assert found["a/LICENSE"] == ("MIT", "own", "a/LICENSE")


def test_root_licence_covers_all(spark):
    found = scan(spark, [("LICENSE", "All rights reserved."), ("deep/er/x", "text"), (None, "text")])
    assert found["deep/er/x"] == ("Proprietary", "inherited", "LICENSE") and found[None] == (None, "none", None)


def test_templates_are_found(spark):
    found = scan(spark, [(f"{name}/a.txt", f"Some words.\n{text}\nMore words.") for name, text in license.TEMPLATES.items()])
    assert {name: found[f"{name}/a.txt"][0] for name in license.TEMPLATES} == {name: license.licence_of(name) for name in license.TEMPLATES}


def wrapped(text, width=60, comment="# "):
    return "\n".join(comment + line for line in textwrap.wrap(text, width))


def test_real_files(spark):
    """Headers wrapped in comments, whole licences without a title, and files of several notices."""
    header, body = license.TEMPLATES["GPL-2.0 header"], license.TEMPLATES["BSD-2-Clause"]
    code = "\n\nimport os\nprint(os.name)\n" * 3
    found = scan(
        spark,
        [
            ("gpl2/a.py", wrapped("Copyright (C) 2019 Jane Roe") + "\n#\n" + wrapped(header) + code), ("gpl3/a.c", wrapped(license.TEMPLATES["GPL-3.0 header"], 50, " * ") + code),
            ("mit/LICENSE", "Copyright (c) 2021 Jane Roe\n\n" + wrapped(license.TEMPLATES["MIT text"], 78, "")), ("isc/LICENSE", "Copyright 2020 Jane Roe\n\n" + wrapped(license.TEMPLATES["ISC"], 78, "")),
            ("bsd/LICENSE", "Copyright (c) 2018, Jane Roe\nAll rights reserved.\n\n" + wrapped(body, 78, "")), ("gpl/COPYING", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n" + "terms " * 500),
            ("spdx/a.rs", "// SPDX-License-Identifier: GPL-2.0-or-later" + code), ("none/a.rs", "// SPDX-License-Identifier: LicenseRef-Acme" + code), ("firm/LICENSE", "Copyright Acme\nAll rights reserved."),
        ],
    )
    assert {p.split("/")[0]: x[0] for p, x in found.items()} == {"gpl2": "GPL-2.0", "gpl3": "GPL-3.0", "mit": "MIT", "isc": "ISC", "bsd": "BSD-2-Clause", "gpl": "GPL-3.0", "spdx": "GPL-2.0", "none": None, "firm": "Proprietary"}


def test_several_licence_files_and_long_texts(spark):
    """In one directory the highest score counts, then the first licence and path by name; long texts are read whole."""
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    found = scan(spark, [("a/LICENSE.a", f"{mit} It is kind."), ("a/LICENSE.b", apache), ("a/x", "text"), ("b/LICENSE.2", mit), ("b/COPYING", apache), ("b/y", None), ("c/z", "word\n" * 200000 + mit)])
    assert found["a/x"] == ("Apache-2.0", "inherited", "a/LICENSE.b") and found["b/y"] == ("Apache-2.0", "inherited", "b/COPYING") and found["c/z"][0] == "MIT"


def cosine(line, template):
    known, other = license.idf(license.TEMPLATES)
    vector = lambda t: {w: license.tokens(t).count(w) * known.get(w, other) for w in license.tokens(t)}
    a, b = vector(line), vector(template)
    return sum(v * b.get(w, 0) for w, v in a.items()) / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))


def test_scores_are_cosines(spark):
    rng = random.Random(5)
    lines = []
    for text in license.TEMPLATES.values():
        words = text.split()
        for _ in range(3):
            lines.append(" ".join(rng.choice(["it", "is", w, w, w]) for w in words) + " license")
    frame = spark.createDataFrame([(f"f/{i}", t) for i, t in enumerate(lines)], "path string, text string")
    for r in license.scan(frame, keys=("text",)).collect():
        scored = {n: cosine(r["text"], t) for n, t in license.TEMPLATES.items()}
        best = max(scored.values())
        strong = {n: v for n, v in scored.items() if license.licence_of(n) not in license.WEAK and v >= license.THRESHOLD}
        assert (r["license"] is None) == (best < license.THRESHOLD)
        if r["license"]:
            wanted = max((strong or scored).values())
            own = max(v for n, v in scored.items() if license.licence_of(n) == r["license"])
            assert abs(own - wanted) < 1e-9 and abs(r["score"] - wanted) < 1e-5


def test_repeated_rows_and_empty_table(spark):
    frame = spark.createDataFrame([("a/LICENSE", "Released under the MIT License.")] * 2, "path string, text string")
    assert license.scan(frame).count() == 2 and license.scan(frame.where("path = 'x'")).count() == 0


def test_no_python_in_plans(spark, capsys):
    frame = spark.createDataFrame([("a/x", "t")], "path string, text string").selectExpr("path", "text")
    license.scan(frame).explain("formatted")
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


def test_query_covers_every_document(spark):
    rows = queries.op7_license_scan(spark, DATA)
    assert rows.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert rows.where("origin = 'own'").count() > 0
