from datetime import datetime as dt

import pytest

from codeweft.llm import provenance as pv
from conftest import rows

FILE = "repo_id string, file_path string, content string, parsed_at timestamp_ntz, evidence string, lines string"
UP = "package string, version string, file_path string, content string"
HAND = 'import os\n\n\ndef clean(path, depth=3):\n    """Keeps the last parts."""\n    parts = path.split("/")\n    return parts[-depth:]\n\n\nclass Store:\n    def __init__(self, root):\n        self.root = root\n\n    def put(self, name, data):\n        with open(os.path.join(self.root, name), "wb") as out:\n            out.write(data)\n'
LONG = HAND + "".join(f"\n\ndef step_{w}(value):\n    other = value.{w} or {len(w)}\n    if other > {len(w) * 3}:\n        raise ValueError('{w}')\n    return other\n" for w in "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split())


@pytest.mark.parametrize(("text", "kind"), [
    ("# Generated by the schema compiler.  DO NOT EDIT!\nx = 1\n", "generated"), ("// @generated by tool\nexports.a = 1;\n", "generated"), ("# Automatisch erzeugt, nicht bearbeiten.\nx = 1\n", "generated"),
    ('"""\nAUTOGENERATED FILE - regenerate with `make x`\n"""\nx = 1\n', "generated"), ("/* eslint-disable */\n/* produced by weave 3.1 */\nx()\n", "generated"), ("# Code written by modelgen. Do not modify by hand.\nx = 1\n", "generated"),
    ("exports.aField0 = function (m) { return m.f[0]; };\n" * 30, "generated"), ("!function(){" + "function a(b,c){return c?b:7}" * 60 + "}();", "minified"), ("DATA = [\n" + "".join(f"    {i * 7919 % 99991}, {i},\n" for i in range(200)) + "]\n", "data"),
    ("X = '''id,name\n" + "".join(f"{i},item{i}\n" for i in range(200)) + "'''\n", "data"), ("# somepkg 1.4.2\n# Permission is granted.\nx = 1\n", "vendored"),
    (HAND, None), (LONG, None), ('BANNER = "# Generated by reportkit. DO NOT EDIT"\n' + HAND, None), ('"""Checks files generated by the vendor tools; this module itself is kept by hand."""\n' + HAND, None),
    ("// reads the generated bundle; edit freely\nfunction a() { return 1; }\n", None), ("# table checked by hand against the manual\nSTEPS = [1, 2, 3]\n" + HAND, None), ("", None), (" \n", None), ("﻿x = 1\r\n", None),
])
def test_evidence(text, kind):
    assert pv.evidence(text) == kind


def test_attribute_rules_and_globs():
    r = pv.attribute_rules("lib", "# c\n*.gen.py linguist-generated=true\nold/ linguist-vendored\nkeep/x.py -linguist-vendored\n[bad\nz/**/q.py generated=false text\n\n")
    assert [(x["attr"], x["value"]) for x in r] == [("generated", True), ("vendored", True), ("vendored", False), ("generated", False)]
    more = pv.attribute_rules("", '[attr]tool linguist-generated -text\n"a b.py" tool\n*.x !linguist-generated\n*.y generated=unset\n!*.z generated\n')
    assert [(x["attr"], x["value"]) for x in more] == [("generated", True), ("generated", None), ("generated", False)]
    import re

    assert re.search(more[0]["pattern"], "q/a b.py")
    hit = lambda p, s: bool(re.search(pv._glob(p), s))
    assert hit("*.js", "a/b.js") and not hit("/*.js", "a/b.js") and hit("a/**", "a/b/c") and hit("**/b/*.py", "x/b/c.py") and hit("a/**/c", "a/c") and not hit("a?", "a/") and hit("[!x]y", "zy") and hit("d/", "d/e/f")


def files(spark, data):
    return spark.createDataFrame([(*x, "zz", "zz") for x in data], FILE)


def upstream(spark, data=()):
    return spark.createDataFrame(list(data), UP)


def found(spark, data, up=()):
    return {(r.repo_id, r.file_path): r.reason for r in pv.not_by_hand(files(spark, data), upstream(spark, up)).collect()}


T = [dt(2024, 1, d) for d in (1, 2)]


def test_declarations_precedence_and_conventions(spark):
    gen = "# @generated\nx = 1\n"
    data = [
        ("r", ".gitattributes", "gen/** linguist-generated\nvendor/ours/** -linguist-vendored\n", T[0]), ("r", "gen/sub/.gitattributes", "mine.py -linguist-generated\n", T[0]),
        ("r", "gen/a.py", HAND, T[0]), ("r", "gen/sub/mine.py", gen, T[0]), ("r", "vendor/ours/b.py", HAND, T[0]), ("r", "vendor/x.py", HAND, T[0]), ("r", "c.py", gen, T[0]), ("r", "c.py", HAND, T[1]), ("r", "d.py", HAND, T[0]), ("r", "d.py", gen, T[1]), ("r", "d.py", gen, T[1]),
        ("q", "gen/a.py", HAND, T[0]), ("q", "a.min.js", "a()", T[0]), ("q", "b.json", "[1]", T[0]), ("q", "vendor/empty.py", "", T[0]), ("q", "e.py", None, T[0]), (None, "f.py", gen, T[0]), ("q", None, gen, T[0]),
    ]
    assert found(spark, data) == {("r", "gen/a.py"): "declared", ("r", "vendor/x.py"): "pattern", ("r", "d.py"): "generated", ("q", "a.min.js"): "pattern"}


def test_patterns_are_mined_from_several_repositories(spark):
    data = [(f"r{i % 3}", f"src/stubs/m{i}.py", "# @generated\nx = 1\n", T[0]) for i in range(6)] + [("s", "lib/stubs/own.py", HAND, T[0]), ("s", "lib/other.py", HAND, T[0])]
    data += [("s", f"auto/m{i}.py", "# @generated\nx = 1\n", T[0]) for i in range(6)] + [("s", "auto/own.py", HAND, T[0])]
    got = found(spark, data)
    assert got["s", "lib/stubs/own.py"] == "pattern" and ("s", "auto/own.py") not in got and ("s", "lib/other.py") not in got


def test_copies_of_upstream_files(spark):
    changed = "# local\n" + LONG.replace("depth=3", "depth=4")
    data = [("r", "a/x.py", LONG, T[0]), ("r", "a/y.py", changed, T[0]), ("q", "z.py", LONG.replace("\n", "\r\n"), T[0]), ("q", "h.py", HAND.replace("Store", "Shelf").replace("clean", "tidy").replace("parts", "bits"), T[0])]
    assert found(spark, data, [("p", "1.0", "x.py", LONG), ("p", "1.0", "n.py", None), ("p", "1.0", "e.py", "")]) == {("r", "a/x.py"): "upstream", ("r", "a/y.py"): "upstream", ("q", "z.py"): "upstream"}


def test_size_and_place_of_the_evidence():
    licence = "".join(f"# Line {i} of the licence of this project.\n" for i in range(300))
    assert pv.evidence(licence + "# @generated by tool\nx = 1\n") == "generated"
    prose = '"""' + "".join(f"Paragraph {i} tells what the package is for, at some length, and in plain words.\n" for i in range(70)) + '"""\n'
    assert pv.evidence(prose) is None and pv.evidence(prose + HAND) is None
    noted = "".join(f"# The {i}. setting, and what it is good for when it is set.\nLIMIT_{i} = {i}\n" for i in range(40))
    assert pv.evidence(noted) is None
    assert pv.evidence("!function(){" + "function a(b,c){return c?b:7}" * 60 + "}();") == "minified" and pv.evidence("T = {'a': 1, 'b': 2}\n") is None


def test_unspecified_again_falls_to_the_content(spark):
    gen = "# @generated\nx = 1\n"
    data = [("r", ".gitattributes", "*.py -linguist-generated\nb.py !linguist-generated\n", T[0]), ("r", "a.py", gen, T[0]), ("r", "b.py", gen, T[0])]
    assert found(spark, data) == {("r", "b.py"): "generated"}


def test_shortened_and_embedded_copies(spark):
    half = LONG[: int(len(LONG) * 0.75)]
    data = [("r", "short.py", half, T[0]), ("r", "more.py", LONG + LONG.replace("value", "other").replace("step", "walk").replace("raise", "return"), T[0]), ("r", "one.py", "x = 1\n", T[0]), ("r", "two.py", "import os\nimport os.path\n", T[0])]
    assert found(spark, data, [("p", "1", "x.py", LONG), ("p", "1", "i.py", "x = 1\n")]) == {("r", "short.py"): "upstream", ("r", "one.py"): "upstream"}


def test_copies_against_all_pairs(spark):
    import random

    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    ups = [" ".join(rnd.choice(vocabulary) for _ in range(60)) for _ in range(6)]
    texts = []
    for u in ups:
        for change in (0, 1, 2, 4, 8):
            w = u.split()
            for _ in range(change):
                w[rnd.randrange(len(w))] = "changed"
            texts.append(" ".join(w[: rnd.choice([60, 50, 40])]))

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    want = set()
    for i, t in enumerate(texts):
        for u in ups:
            a, b = shingles(t), shingles(u)
            n = len(a & b)
            if n and (n >= 0.8 * len(a | b) or (n >= 0.8 * len(a) and n >= 0.6 * len(b))):
                want.add(("r", f"{i}.py"))
    got = found(spark, [("r", f"{i}.py", t, T[0]) for i, t in enumerate(texts)], [("p", "1", f"{i}", u) for i, u in enumerate(ups)])
    assert {k for k, v in got.items() if v == "upstream"} == want and 5 < len(want) < 30


def test_empty_tables(spark):
    assert pv.not_by_hand(files(spark, [("r", "a.py", "", T[0])]).limit(0), upstream(spark)).count() == 0
    assert rows(pv.provenance_report(files(spark, [("r", "a.py", "# @generated\n", T[0])]), upstream(spark))) == [("r", "generated", 1)]
