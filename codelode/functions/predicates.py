"""Boolean and rule columns on paths, names and messages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.functions import constants as K
from codelode.functions.text import extension, filename


def any_of(text: Column, parts: list[str]) -> Column:
    """Whether the text holds one of the substrings: one pattern, so generated code stays small enough to be compiled."""
    return text.rlike("|".join(re.escape(p) for p in parts))


def _test_path(path: Column, dirs: list[str], names: list[str]) -> Column:
    p = F.lower(path)
    return F.arrays_overlap(F.split(p, "/"), F.array(*[F.lit(d) for d in dirs])) | any_of(filename(p), names)


def is_changed_test(path: Column) -> Column:
    return _test_path(path, K.CHANGE_TEST_DIRS, K.CHANGE_TEST_NAMES)


def is_test_file(path: Column) -> Column:
    return _test_path(path, K.TEST_DIRS, K.TEST_NAMES)


def looks_like_test(path: Column) -> Column:
    return any_of(F.lower(path), ["test", "spec"])


def is_ci_file(path: Column) -> Column:
    p = F.lower(path)
    return p.rlike(r"\.github/workflows/.*\.ya?ml$|\.gitlab-ci\.ya?ml$|\.circleci/config\.yml$|azure-pipelines\.yml$|\.travis\.yml$|jenkinsfile|\.drone\.yml$|bitbucket-pipelines\.yml$")


def is_source_file(path: Column, language: Column) -> Column:
    return F.coalesce(language.isin(*K.SOURCE_LANGUAGES), F.lit(False)) & ~any_of(F.lower(path), K.NON_SOURCE_PATHS)


def is_public_symbol(name: Column, kind: Column) -> Column:
    dunder = F.startswith(name, F.lit("__")) & F.endswith(name, F.lit("__"))
    return (
        F.when(F.startswith(name, F.lit("_")) & ~F.startswith(name, F.lit("__")), False)
        .when(dunder, True)
        .when(kind == "method", ~F.startswith(name, F.lit("_")))
        .otherwise(True)
    )


def is_test_symbol(name: Column, kind: Column) -> Column:
    return kind.isin("function", "method") & F.lower(name).rlike("^(" + "|".join(K.TEST_FUNCTIONS) + ")")


def is_binary(path: Column) -> Column:
    return extension(path).isin(*K.BINARY_EXTENSIONS)


def is_sensitive(path: Column) -> Column:
    return F.lower(filename(path)).isin(*K.SENSITIVE_FILES)


def is_ignored(path: Column) -> Column:
    """Whether a directory of the path is one that scans do not enter."""
    return F.arrays_overlap(F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1), F.array(*[F.lit(d) for d in K.IGNORED_DIRECTORIES]))


def is_security_path(path: Column) -> Column:
    return any_of(F.lower(path), K.SECURITY_PATHS)


def is_database_path(path: Column) -> Column:
    return any_of(F.lower(path), K.DATABASE_PATHS)


def is_payment_path(path: Column) -> Column:
    return any_of(F.lower(path), K.PAYMENT_PATHS)


def safe_relative_path(path: Column) -> Column:
    """No absolute path, back slash, empty, ``.`` or ``..`` segment."""
    return ~F.startswith(path, F.lit("/")) & ~path.contains("\\") & ~F.exists(F.split(path, "/"), lambda s: s.isin("", ".", ".."))


def test_type(name: Column, path: Column) -> Column:
    both = F.concat(F.lower(path), F.lit(" "), F.lower(name))
    return (
        F.when(any_of(both, ["e2e", "end_to_end"]), "e2e")
        .when(F.lower(path).contains("integration") | F.lower(name).contains("integr"), "integration")
        .when(any_of(both, ["functional", "feature"]), "functional")
        .when(both.contains("unit"), "unit")
        .when(F.arrays_overlap(F.split(F.lower(path), "/"), F.array(F.lit("test"), F.lit("tests"))), "unit")
        .otherwise("unknown")
    )


def framework(roots: Column, language: Column) -> Column:
    """First framework whose root modules are imported, else the default of the language."""
    out = None
    for name, modules in K.FRAMEWORKS.items():
        hit = F.arrays_overlap(roots, F.array(*[F.lit(m) for m in modules]))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    default = F.create_map(*[F.lit(x) for kv in K.DEFAULT_FRAMEWORKS.items() for x in kv])
    return F.coalesce(out, F.try_element_at(default, language), F.lit("unknown"))


def root_module(source: Column) -> Column:
    return F.substring_index(source, ".", 1)


def failure_class(kind: Column, message: Column, trace: Column) -> Column:
    """Struct of class and confidence; the order of the patterns decides."""
    text = F.concat_ws(" ", kind, message, trace)
    blank = F.coalesce(F.length(F.trim(text)), F.lit(0)) == 0
    out = F.when(blank, F.struct(F.lit("unknown").alias("failure_class"), F.lit("0.00").cast("decimal(3,2)").alias("confidence")))
    named = {"assertion": "assert", "import_error": "import", "timeout": "timeout"}
    fixed = {"setup_error": "0.80", "dependency_error": "0.75", "network_error": "0.75"}
    for name, patterns in K.FAILURE_PATTERNS.items():
        hit = text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))
        sure = F.when(F.lower(F.coalesce(kind, F.lit(""))).contains(named.get(name, " ")), "0.95").otherwise(fixed.get(name, "0.85"))
        out = out.when(hit, F.struct(F.lit(name).alias("failure_class"), sure.cast("decimal(3,2)").alias("confidence")))
    return out.otherwise(F.struct(F.lit("unknown").alias("failure_class"), F.lit("0.50").cast("decimal(3,2)").alias("confidence")))


def _plain_words(pattern: str) -> list[str] | None:
    """The alternatives of a pattern that only asks for one of some words; null for any other pattern."""
    m = re.fullmatch(r"\\b\(([A-Za-z|]+)\)\\b", pattern)
    return [w.lower() for w in m[1].split("|")] if m else None


def _literal_words(pattern: str) -> list[str]:
    """The words written in a pattern; a text that matches holds one of them, as each alternative has one."""
    return sorted({w.lower() for w in re.findall(r"[A-Za-z0-9]{2,}", re.sub(r"\\[a-zA-Z]", " ", pattern))})


def matches_any(text: Column, words: Column, patterns: list[str]) -> list[Column]:
    """Whether each of the patterns occurs in the text, whatever the case; ``words`` are the distinct words of the text.

    Patterns of plain words ask the words only; the others read the text only
    where one of their words is there.
    """
    out = []
    for p in patterns:
        plain = _plain_words(p)
        hit = F.arrays_overlap(words, F.array(*[F.lit(w) for w in plain or _literal_words(p)]))
        out.append(hit if plain else hit & text.rlike("(?i)" + p))
    return out


def words_of(text: Column) -> Column:
    """The distinct runs of ASCII letters, digits and ``_`` of a text, in lower case."""
    return F.array_distinct(F.split(F.lower(text), "[^a-z0-9_]+"))


def intents(questions: DataFrame, question: str, has_context: Column) -> DataFrame:
    """The rows with ``intent`` and ``confidence``: most matching patterns, the earlier intent on a tie."""
    text = F.col(question)
    # the words are a column of their own, so they are split off once for all patterns
    rows = questions.withColumn("_context", has_context).withColumn("_words", words_of(text))
    words = F.col("_words")
    counts = [
        F.struct(sum((c.cast("int") for c in matches_any(text, words, patterns)), F.lit(0)).alias("score"), F.lit(-i).alias("rank"), F.lit(name).alias("intent"))
        for i, (name, patterns) in enumerate(K.INTENT_PATTERNS.items())
    ]
    short = (F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")) <= 4) & F.col("_context")
    rows = rows.withColumn("_best", F.array_max(F.array(*counts))).withColumn("_short", short)
    best = F.col("_best")
    about = lambda patterns: F.col("_short") & text.rlike("(?i)" + "|".join(patterns))
    answer = lambda name, c: F.struct(F.lit(name).alias("intent"), c.alias("confidence"))
    said = (
        F.when(about(K.CONTEXT_DEPENDENCY), answer("dependency_question", F.lit(0.7)))
        .when(about(K.CONTEXT_DETAIL), answer("symbol_explanation", F.lit(0.7)))
        .when(best["score"] > 0, F.struct(best["intent"].alias("intent"), F.least(best["score"] / 2.0, F.lit(1.0)).alias("confidence")))
        .otherwise(answer("unknown", F.lit(0.5)))
    )
    return rows.withColumn("_i", said).select(*questions.columns, "_i.intent", "_i.confidence")


def is_sufficient(answer: Column, n_evidence: Column) -> Column:
    return (n_evidence >= 2) & ~any_of(F.lower(answer), K.INSUFFICIENT_PHRASES)


def test_command(path: Column) -> Column:
    e = F.lower(F.substring_index(path, ".", -1))
    with_path = lambda before, after="": F.concat(F.lit(before), path, F.lit(after))
    return (
        F.when(e == "py", with_path("pytest ", " -v"))
        .when(e.isin("js", "jsx", "ts", "tsx"), with_path("npm test "))
        .when(e == "go", with_path("go test "))
        .when(e == "rs", with_path("cargo test --test "))
        .when(e == "java", with_path("mvn test -Dtest="))
        .otherwise(with_path("# Run tests in "))
    )
