import pytest

from codelode.llm import handwritten as H

SCHEMA = "repository_id string, path string, content string, text string, kind string, n_chars int"
CODE = "import os\n\ndef f(x):\n    return os.path.join(x, 'a')\n" * 12
MIN = "function a0(p,s){return p&&s.x(478)?p[478]:void 0}" * 30
CASES = [
    ("src/a.py", CODE, None),
    ("src/gen.py", "# Copyright us.\n#\n# Code generated by tool. DO NOT EDIT.\n" + CODE, "generated"),
    ("src/end.ts", "const a = 1;\n\n// @generated by tool from a.idl\n", "generated"),
    ("src/mid.ts", "const a = `\n// @generated by tool from a.idl\n`;\nconst b = 2;\n", None),
    ("src/speaks.py", '"""The file is not generated; edit it by hand. DO NOT EDIT applies to its output only."""\n' + CODE, None),
    ("src/own.js", "// Generates the table; change the template, not its output.\nconst a = 1;\n", None),
    ("src/fr.js", "// Ce fichier est généré par outil ; ne pas le modifier.\nconst a = 1;\n", "generated"),
    ("src/lib.js", "/*! lib v1.2.3 | (c) The lib Authors | licence */\nconst a = 1;\n", "vendored"),
    ("node_modules/x/y.js", "const a = 1;\n", "vendored"),
    ("src/vendors/x.py", CODE, None),
    ("app/static/x.js", MIN, "minified"),
    ("src/stats/x.min.ts", "const a = 1;\n", None),
    ("src/data/t.py", "T = [\n" + "    12345, 67890, 13579, 24680,\n" * 40 + "]\n", "data"),
    ("src/data/h.ts", "const a = [\n" + "  '" + "ab12" * 16 + "',\n" * 1 + ("  '" + "0f" * 32 + "',\n") * 20 + "];\n", "data"),
    ("src/one.js", "const s = '" + "word " * 60 + "';\n" + "const a = b + c;\n" * 20, None),
    ("a/b.css", ".a {\n  margin: 3px;\n}\n", None),
    ("src/empty.py", "", None),
    ("src/none.py", None, None),
    ("vendor/none.js", None, "vendored"),
    ("x/y.min.js", None, "minified"),
    (None, "text", None),
]


@pytest.fixture(scope="module")
def kinds(spark):
    df = spark.createDataFrame([("r", p, c, "clash", "clash", 1) for p, c, _ in CASES] * 2, SCHEMA)
    return {r.path: r.kind for r in H.classify(df).collect()}, sorted(r.path for r in H.not_handwritten(df).collect())


def test_kinds(kinds):
    assert kinds[0] == {p: k for p, _, k in CASES if p is not None}
    assert kinds[1] == sorted(p for p, _, k in CASES if p is not None and k)


def test_long_texts_and_empty_table(spark, rows):
    comment = "// note\n" * 200_000
    df = spark.createDataFrame([("r", "a.js", comment + "const a = 1;", "", "", 0), ("r", "b.js", "const a = 1;\n// @generated by t\n" + comment, "", "", 0)], SCHEMA)
    assert rows(H.not_handwritten(df)) == [("r", "b.js")]
    assert rows(H.not_handwritten(spark.createDataFrame([], SCHEMA))) == []


def test_other_code_endings(spark, rows):
    java = "class A {\n    int f(int x) {\n        return x + 1;\n    }\n}\n" * 12
    files = spark.createDataFrame([("r", p, c, "", "", 0) for p, c in [
        ("a/api.pb.go", "package a\n"), ("a/Gen.java", "// Code generated by tool. DO NOT EDIT.\n" + java), ("a/Own.java", java), ("a/page.html", MIN), ("a/t.c", "int t[] = {\n" + "    12345, 67890, 13579, 24680,\n" * 40 + "};\n"), ("a/notes.txt", MIN),
    ]], SCHEMA)
    assert rows(H.classify(files).where("kind is not null"), "path", "kind") == [("a/Gen.java", "generated"), ("a/api.pb.go", "generated"), ("a/page.html", "minified"), ("a/t.c", "data")]


def test_texts_of_several_repositories(spark, rows):
    """A text that three repositories hold is a copy of a library; short texts, copies within one repository and documents are none."""
    files = spark.createDataFrame(
        [(r, f"src/{r}/lib.py", CODE, "", "", 0) for r in "abc"] + [("a", "src/again.py", CODE, "", "", 0)] + [("a", f"src/{i}.js", "const a = b(c);\n" * 40, "", "", 0) for i in range(5)]
        + [(r, "src/__init__.py", "", "", "", 0) for r in "abcd"] + [(r, "src/two.ts", "let x = y(z);\n" * 50, "", "", 0) for r in "ab"] + [(r, "README.md", "Prose. " * 90, "", "", 0) for r in "abcd"]
        + [(None, "src/null.py", CODE, "", "", 0)], SCHEMA,
    )
    assert sorted(p for _, p in rows(H.not_handwritten(files), "repository_id", "path")) == ["src/a/lib.py", "src/again.py", "src/b/lib.py", "src/c/lib.py", "src/null.py"]


def test_layout_alone(spark, rows):
    df = spark.createDataFrame([("r", p, c, "", "", 1) for p, c, _ in CASES], SCHEMA)
    assert rows(H.by_layout(df).where("kind is not null"), "path", "kind") == [("app/static/x.js", "minified"), ("src/data/h.ts", "data"), ("src/data/t.py", "data")]
    wrapped = "K = '''\n" + "\n".join("Ab9x" * 9 for _ in range(30)) + "\n'''\n"
    assert rows(H.by_layout(spark.createDataFrame([("r", "k.py", wrapped, "", "", 1)], SCHEMA)), "kind") == [("data",)]
