"""Files that nobody wrote by hand: generated, minified, vendored, data saved as code.

Layout statistics of each whole file are computed with built-in expressions
and held against thresholds for its language.  They find what is minified and
what is data; texts of tools and libraries are laid out like written ones, so
these are found by the marks that tools leave in the first or last comment, by
the places where tools and package managers put files, and, for libraries, by
equal texts in several repositories.  Texts are not shuffled, only the hashes
of texts and the statistics.

Defined results
* Where several rules hold the kind is the first of generated, vendored,
  minified, data; that a text is found elsewhere counts last.
* A null text has null statistics; only its path can make it a case.  Empty
  texts are cases only by path too.
* A null path is no case.  A null extension or language changes nothing: the
  language is read from the path.
* Rows repeated with the same repository and path give one row; any of their
  texts can make it a case.  Extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.staging import stage

#: Openings of the comments that code generators leave.
GENERATED_MARKS = (
    r"@generated\b",
    r"generated-by:",
    r"(this )?(code|file) (is |was )?(auto-?)?generated (automatically )?(by|from|with)\b",
    r"<auto-?generated",
    r"auto-?generated (file|code|by)\b",
    r"this file was (produced|created|written) automatically",
    r"automatisch (erzeugt|generiert)",
    r"ce fichier est g.n.r.",
    r"(este archivo|archivo) (es |fue |ha sido )?generado",
    r"output of \S+ \(\S+\)",
)
#: Comments with which libraries name themselves.
LIBRARY_MARKS = (
    r"@license \S+",
    r"\S+ v?[0-9]+\.[0-9]+\.[0-9]+\b( \||\s*$)",
)
#: Folders and names that hold what tools put there.
GENERATED_PLACES = r"(?i)(^|/)(__generated__)/|\.(gen|generated)\.[a-z]+$|_(pb2|pb2_grpc|generated)\.py$|\.pb\.go$"
LIBRARY_PLACES = r"(?i)(^|/)(node_modules|bower_components|third_party|vendor|_vendor|site-packages|extern)/|(^|/)deps/[^/]+@[0-9]|(^|/)libs/[^/]+-[0-9]+\.[0-9]+\.[0-9]+\.[a-z]+$"
#: Only where the text was not stored.
MINIFIED_PLACES = r"(?i)(^|/)(static|dist|_site)/([^/]+/)*[^/]+\.(js|css)$|[.-](min|bundle)\.(js|css)$|\.[0-9a-f]{8,}\.(js|css)$"
GENERATED_PLACES_UNSEEN = r"(?i)(^|/)(gen|proto)/"

#: Thresholds by language: longest and mean line and white space share, for minified; numeric, encoded and alphanumeric share, for data.
LIMITS = {
    "script": {"longest": 250, "mean": 60, "space": 0.09, "numeric": 0.22, "encoded": 0.30, "alnum": 0.85},
    "python": {"longest": 400, "mean": 80, "space": 0.07, "numeric": 0.25, "encoded": 0.30, "alnum": 0.85},
    "style": {"longest": 250, "mean": 60, "space": 0.09, "numeric": 2.0, "encoded": 0.50, "alnum": 0.90},
    "other": {"longest": 400, "mean": 80, "space": 0.07, "numeric": 0.25, "encoded": 0.30, "alnum": 0.85},
}
#: Endings of code in languages without thresholds of their own.
OTHER_CODE = (
    "c h cc cpp cxx hh hpp hxx m mm cs java kt kts scala groovy go rs swift dart php phtml rb pl pm lua r jl hs ml ex exs erl clj "
    "html htm xhtml vue svelte scss sass less sh bash ps1 sql pyi pyx mts cts"
).split()
#: Shortest text that layout, or its being found elsewhere, can judge.
LEAST_CHARS = 300
#: A text that so many repositories hold is a copy of a library.
COPIES = 3

_COMMENT = r"[ \t]*(?:#+|//+|/\*+!?|\*+)[ \t]*"


def _mark(marks: tuple[str, ...]) -> str:
    return rf"(?im)^{_COMMENT}(?:{'|'.join(marks)})"


#: Capturing groups in the marks, which stand before the group of what follows them.
GROUPS_BEFORE = {m: sum(re.compile(x).groups for x in m) for m in (GENERATED_MARKS, LIBRARY_MARKS)}


def _in_outer_comment(text: Column, marks: tuple[str, ...]) -> Column:
    """Whether a mark opens a comment line with no code before it, or none after it."""
    pattern = F.lit(_mark(marks))
    at = F.regexp_instr(text, pattern)
    before = F.substr(text, F.lit(1), at - 1)
    code = r"(?m)^[ \t]*[^\s#/*﻿]"
    after = F.regexp_extract(text, rf"(?is)^.*(?:^|\n){_COMMENT}(?:{'|'.join(marks)})[^\n]*(.*)$", GROUPS_BEFORE[marks] + 1)
    return (at > 0) & (~before.rlike(code) | ~after.rlike(code))


def layout(text: Column) -> dict[str, Column]:
    """Columns of layout statistics of a text."""
    n = F.length(text)
    lines = F.split(text, r"\r\n|\r|\n")
    share = lambda pattern: (n - F.length(F.regexp_replace(text, pattern, ""))) / n
    filled = F.when(n > 0, text)
    return {
        "n_chars": n,
        "n_lines": F.when(n > 0, F.size(lines)).when(n == 0, 0),
        "longest_line": F.array_max(F.transform(lines, F.length)),
        "mean_line": F.when(filled.isNotNull(), n / F.size(lines)),
        "space_share": F.when(filled.isNotNull(), share(r"\s+")),
        "alnum_share": F.when(filled.isNotNull(), share(r"[\p{L}\p{N}]+")),
        "numeric_share": F.when(filled.isNotNull(), share(r"(?<![A-Za-z_#0-9])[-+]?(0x[0-9A-Fa-f]+|[0-9][0-9_]*(\.[0-9]+)?([eE][-+]?[0-9]+)?)(?![A-Za-z_0-9])[,;:\s]*+")),
        "encoded_share": F.when(filled.isNotNull(), share(r"[A-Za-z0-9+/_=-]{40,}+")),
    }


def classify(files: DataFrame, marks: bool = True) -> DataFrame:
    """Every (repository_id, path) row with its layout statistics and ``kind``, null for hand-written.

    Without ``marks`` the thresholds decide alone, as far as layout can: texts
    that tools emit or libraries hold are laid out like written ones.
    """
    text, path = F.col("text"), F.col("path")
    rows = files.select("repository_id", "path", F.col("content").alias("text")).where("path is not null")
    stats = rows.select("repository_id", "path", "text", *[c.alias(k) for k, c in layout(text).items()])
    ending = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    language = (
        F.when(ending.isin("js", "jsx", "ts", "tsx", "mjs", "cjs"), "script").when(ending == "py", "python").when(ending == "css", "style").when(ending.isin(*OTHER_CODE), "other")
    )
    limit = lambda k: F.coalesce(*[F.when(language == g, F.lit(v[k])) for g, v in LIMITS.items()])
    enough = F.col("n_chars") >= LEAST_CHARS
    packed = enough & (F.col("longest_line") >= limit("longest")) & (F.col("mean_line") >= limit("mean")) & (F.col("space_share") < limit("space"))
    # long runs of an encoding, or short ones that leave hardly anything else
    encoded = (F.col("encoded_share") >= limit("encoded")) | (F.col("alnum_share") >= limit("alnum"))
    data = enough & ((F.col("numeric_share") >= limit("numeric")) | encoded)
    slashed = F.translate(path, "\\", "/")
    is_data = data & ~((language == "script") & packed & ~encoded & (F.col("numeric_share") < 0.4))
    # what cannot be a copy has a key of its own, so that nothing piles up
    key = F.when(enough & language.isNotNull(), F.xxhash64("text")).otherwise(F.xxhash64("repository_id", "path", F.lit("alone")))
    stats = stats.withColumn("text_id", key)
    if not marks:
        return _with_copies(stats.withColumn("kind", F.when(is_data, "data").when(packed, "minified")).drop("text"))
    kind = (
        F.when(language.isNotNull() & (slashed.rlike(GENERATED_PLACES) | (text.isNull() & slashed.rlike(GENERATED_PLACES_UNSEEN)) | _in_outer_comment(text, GENERATED_MARKS)), "generated")
        .when(slashed.rlike(LIBRARY_PLACES) | _in_outer_comment(text, LIBRARY_MARKS), "vendored")
        .when(is_data, "data")
        .when(packed | (text.isNull() & slashed.rlike(MINIFIED_PLACES)), "minified")
    )
    return _with_copies(stats.withColumn("kind", kind).drop("text"))


def _with_copies(rows: DataFrame) -> DataFrame:
    """The rows, those without a kind ``vendored`` if enough repositories hold their text."""
    rows = stage(rows).df
    held = rows.select("text_id", "repository_id").distinct().groupBy("text_id").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") >= COPIES)
    kind = F.coalesce("kind", F.when(F.col("held").isNotNull(), "vendored"))
    return rows.join(held, "text_id", "left").withColumn("kind", kind).drop("text_id", "held")


def by_layout(files: DataFrame) -> DataFrame:
    """As ``classify``, but without marks and places: by layout, and by equal texts in several repositories."""
    return classify(files, marks=False)


def not_handwritten(files: DataFrame) -> DataFrame:
    """Distinct (repository_id, path) of the cases."""
    return classify(files).where("kind is not null").select("repository_id", "path").distinct()
