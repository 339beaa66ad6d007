from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from codelode.functions import predicates as P
from codelode.functions import text as X


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


@pytest.mark.parametrize("path, ext", [("a/b.PY", ".py"), ("a.b/c", ""), ("x.tar.GZ", ".gz"), ("", "")])
def test_extension(spark, path, ext):
    assert one(spark, X.extension(F.lit(path))) == ext


@pytest.mark.parametrize("text, n", [("", 0), ("a", 1), ("a\n", 1), ("a\nb", 2), ("\n\n", 2)])
def test_line_count(spark, text, n):
    assert one(spark, X.line_count(F.lit(text))) == n


def pack(text, limit):
    if len(text) <= limit:
        return [text]
    out, cur = [], None
    for line in text.split("\n"):
        if cur is not None and len(cur) + 1 + len(line) + 1 > limit:
            out.append(cur)
            cur = line
        else:
            cur = line if cur is None else cur + "\n" + line
    return out + [cur]


@pytest.mark.parametrize("text", ["short", "\n".join("x" * (i % 37) for i in range(300)), "y" * 5000, "a\n" + "z" * 3000 + "\nb"])
def test_chunks(spark, text):
    got = one(spark, X.chunks(F.lit(text), 200))
    assert got == pack(text, 200) and "\n".join(got) == text


def test_modules_and_stems(spark):
    assert one(spark, X.module_of(F.lit("src/services/user_service.py"))) == "src.services.user_service"
    assert one(spark, X.clean_stem(F.lit("src/user.test.ts"))) == "user"
    assert one(spark, X.clean_stem(F.lit("tests/test_auth_service.py"))) == "auth_service"


def test_similarity(spark):
    assert one(spark, X.name_similarity(F.lit("Order"), F.lit("order"))) == 1.0
    assert one(spark, X.name_similarity(F.lit("order"), F.lit("OrderService"))) == pytest.approx(5 / 12)
    assert one(spark, X.name_similarity(F.lit("abc"), F.lit("bcd"))) == pytest.approx(0.5)
    assert one(spark, X.path_similarity(F.lit("b/c.py"), F.lit("a/b/c.py"))) == 0.95
    assert one(spark, X.path_similarity(F.lit("x/b/c.py"), F.lit("a/b/c.py"))) == pytest.approx(2 / 3)


def test_csv_names_keep_zeros(spark):
    assert one(spark, X.csv_names(F.lit(" 000a , b,,1"))) == ["000a", "b", "1"]
    assert one(spark, X.parent_count(F.lit("0" * 40))) == 1


@pytest.mark.parametrize("message, kind, trace, want, sure", [
    ("Expected 5, got 3", "AssertionError", "assert x == 5", "assertion", "0.95"), ("No module named 'requests'", "ModuleNotFoundError", "import requests", "import_error", "0.85"),
    ("Test timed out after 30 seconds", "TimeoutError", "TimeoutError: exceeded time limit", "timeout", "0.95"), ("Connection refused", "ConnectionError", "Cannot connect to database", "dependency_error", "0.75"),
    ("Something went wrong", "CustomError", "", "unknown", "0.50"), (None, None, None, "unknown", "0.00"),
])
def test_failure_class(spark, message, kind, trace, want, sure):
    r = one(spark, P.failure_class(*[F.lit(x).cast("string") for x in (kind, message, trace)]))
    assert (r.failure_class, r.confidence) == (want, Decimal(sure))


@pytest.mark.parametrize("name, kind, want", [("_x", "function", False), ("__init__", "method", True), ("__x", "function", True), ("__x", "method", False), ("x", "class", True)])
def test_public(spark, name, kind, want):
    assert one(spark, P.is_public_symbol(F.lit(name), F.lit(kind))) is want


def test_paths(spark):
    for p in ("tests/a.py", "a/b.test.ts", "e2e/x.js"):
        assert one(spark, P.is_test_file(F.lit(p)))
    assert not one(spark, P.is_test_file(F.lit("src/order.py")))
    assert one(spark, P.is_ci_file(F.lit(".github/workflows/ci.yml"))) and not one(spark, P.is_ci_file(F.lit("a.yml")))
    assert not one(spark, P.safe_relative_path(F.lit("a/../b"))) and one(spark, P.safe_relative_path(F.lit("a/b.py")))


def test_sanitised_and_sections(spark):
    assert one(spark, X.sanitised(F.lit("password = hunter2"))) == "password=***REDACTED***"
    assert one(spark, X.sanitised(F.lit("postgresql+x://u:p@h"))) == "postgresql+x://***:***@h"
    answer = F.lit("## Summary\nfine\n## Risk\nlow\n")
    assert one(spark, X.section(answer, "Risk")) == "low" and one(spark, X.section(answer, "None")) is None
    assert one(spark, X.citation_numbers(F.lit("[Evidence 2] [Evidence 1] [Evidence 2]"))) == [2, 1]
    assert one(spark, X.human_size(F.lit(1536))) == "1.5 KB"
