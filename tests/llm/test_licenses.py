import math
import re
from collections import Counter

import rows
from pyspark.sql import functions as F

from visitflow.llm import licenses as L
from visitflow.llm.registry import TEMPLATES

SCHEMA = "path string, text string"
PROSE = "some prose about other things " * 8


def _templates(spark):
    return spark.createDataFrame(list(TEMPLATES), "license string, text string")


def _files(spark):
    return spark.createDataFrame([
        ("a/LICENSE", "Released under the MIT License."),
        ("a/b/code.py", PROSE),
        ("a/b/c/more.py", "# Licensed under the Apache License, Version 2.0.\n" + PROSE),
        ("a/b/d/NOTICE.txt", "all RIGHTS reserved!"),
        ("a/b/d/x.py", PROSE + "x"),
        ("z/alone.py", None), ("top.py", ""), (None, PROSE), ("ab/other.py", PROSE + "y"), ("a/b/code.py", PROSE),
    ], SCHEMA)


def test_nearest_directory_wins(spark):
    got = {r["path"]: (r["license"], r["how"], r["from_directory"]) for r in L.scanned(
        _files(spark), _templates(spark)).select("row.path", "license", "how", "from_directory").collect()}
    assert got == {
        "a/LICENSE": ("MIT", "stated", None), "a/b/code.py": ("MIT", "inherited", "a"),
        "a/b/c/more.py": ("Apache-2.0", "stated", None), "a/b/d/NOTICE.txt": ("all-rights-reserved", "stated", None),
        "a/b/d/x.py": ("all-rights-reserved", "inherited", "a/b/d"), "z/alone.py": (None, "none", None),
        "top.py": (None, "none", None), None: (None, "none", None), "ab/other.py": (None, "none", None),
    }
    assert L.scanned(_files(spark), _templates(spark)).count() == 10


def _words(text):
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def _units(text, templates):
    """Lines, paragraphs and runs of comments of several lines, stretches as high as a template of several lines."""
    lines = text.split("\n")
    comments = [x if re.match(r"\s*(#|//|/?\*|--|;|%|<!--)", x) else "" for x in lines]
    out = list(lines)
    for part in (text, "\n".join(comments)):
        out += [b for b in re.split("\n[ \t\r]*\n", part) if "\n" in b]
    for k in {t.count("\n") + 1 for _, t in templates} - {1}:
        out += ["\n".join(lines[i:i + k]) for i in range(len(lines) - k + 1)]
    return out


def _brute(texts, templates=TEMPLATES):
    """Best cosine of the units of each text with the templates."""
    n = len(texts)
    vocabulary = {w for _, t in templates for w in _words(t)}
    held = Counter(w for t in texts for w in set(_words(t)) & vocabulary)
    idf = lambda w: math.log((n + 1) / (held[w] + 1)) + 1
    vector = lambda t: {w: c * idf(w) for w, c in Counter(_words(t)).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    out = []
    for t in texts:
        best = []
        for line in _units(t, templates):
            v = vector(line)
            for name, template in templates:
                w = vector(template)
                if v:
                    best.append((-round(sum(v[x] * w[x] for x in v.keys() & w.keys()) / norm(v) / norm(w), 6), name))
        top = min(best, default=(0, None))
        out.append((top[1], -top[0]) if -top[0] >= L.SIMILAR else (None, None))
    return out


def test_cosines_are_those_of_brute_force(spark):
    lines = [t for _, t in TEMPLATES] + ["Licensed under the Apache License", "the work is licensed", "GNU license version 3",
                                         "released under CC BY-NC", "rights reserved by all", "the", ""]
    texts = [f"{PROSE}{i}\n{lines[i % len(lines)]} {'extra' if i % 5 == 0 else ''}\n{lines[(i * 3) % len(lines)]}"
             for i in range(60)]
    files = spark.createDataFrame([(f"d/{i}.txt", t) for i, t in enumerate(texts)], SCHEMA)
    got = L.statements(files.withColumn("key", F.col("path")), _templates(spark)).collect()
    found = {r["key"]: (r["license"], r["similarity"]) for r in got}
    for i, want in enumerate(_brute(texts)):
        have = found.get(f"d/{i}.txt", (None, None))
        assert have[0] == want[0] and (want[1] is None or abs(have[1] - want[1]) < 2e-6), texts[i]


LONG = (
    ("BSD-like", "Redistribution and use in source and binary forms are permitted\nprovided that the above copyright notice "
                 "is kept.\nThere is no warranty of any kind."),
    ("MIT-like", "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software,\n"
                 "to deal in it without restriction."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
)


def test_headers_over_several_lines(spark):
    """Wrapped as written, wrapped anew, as comments with code below, in the middle of prose, mixed with other words."""
    def wrapped(text, n):
        words = text.split()
        return [" ".join(words[i:i + n]) for i in range(0, len(words), n)]

    code = "\n".join(f"value_{i} = call({i})" for i in range(30))
    texts = [
        "\n".join(wrapped(LONG[0][1], 4)) + "\n\n" + code,
        "\n".join(f"# {x}" for x in wrapped(LONG[1][1], 3)) + "\n" + code,
        "\n".join(f" * {x}" for x in wrapped(LONG[2][1], 1)) + "\n" + code,
        f"{PROSE}\n{PROSE}\n{LONG[0][1]}\n{PROSE}",
        code + "\n" + LONG[1][1].replace("free of charge", "at no cost"),
        "Redistribution is discussed here\n\nin source and elsewhere\n" + code, code, "\n\n\n", "",
    ] + [f"{PROSE}{i}" for i in range(20)]
    templates = spark.createDataFrame(list(LONG), "license string, text string")
    files = spark.createDataFrame([(f"d/{i}.txt", t) for i, t in enumerate(texts)], SCHEMA)
    got = L.statements(files.withColumn("key", F.col("path")), templates).collect()
    found = {r["key"]: (r["license"], r["similarity"]) for r in got}
    have = [found.get(f"d/{i}.txt", (None, None)) for i in range(len(texts))]
    assert [name for name, _ in have[:6]] == ["BSD-like", "MIT-like", "Apache-2.0", "BSD-like", "MIT-like", None]
    for (name, similarity), want in zip(have, _brute(texts, LONG), strict=True):
        assert name == want[0] and (name is None or abs(similarity - want[1]) < 2e-6)


def test_equally_similar_templates_take_the_lowest_name(spark):
    templates = spark.createDataFrame([("B", "one two three"), ("A", "three two one"), ("C", "one two three")],
                                      "license string, text string")
    files = spark.createDataFrame([("d/x", "One two, three!"), ("d/y", "two\nthree\none")], SCHEMA)
    got = L.statements(files.withColumn("key", F.col("path")), templates).collect()
    assert {r["key"]: (r["license"], r["similarity"]) for r in got} == {"d/x": ("A", 1.0), "d/y": ("A", 1.0)}


def test_odd_rows_and_empty_tables(spark):
    files = rows.widened(rows.odd(spark)).withColumn("path", F.concat(F.lit("d/"), F.col("doc_id").cast("string")))
    assert L.scanned(files, _templates(spark)).count() == files.count()
    assert L.scanned(files.limit(0), _templates(spark)).count() == 0
    assert L.scanned(files, _templates(spark).limit(0)).where("license IS NOT NULL").count() == 0
