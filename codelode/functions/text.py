"""Column functions on texts and paths.  All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codelode.functions import constants as K


def filename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    """Lower case, with its dot; empty without one."""
    name = filename(path)
    return F.when(name.contains("."), F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))).otherwise("")


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in K.LANGUAGES.items() for x in kv])
    return F.try_element_at(table, extension(path))


def line_count(text: Column) -> Column:
    n = F.size(F.split(text, "\n"))
    return F.when(text == "", 0).otherwise(n - F.endswith(text, F.lit("\n")).cast("int"))


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("int")


def line_range(text: Column, start: Column, end: Column) -> Column:
    """Lines start to end (from 1, clipped), trimmed; null if nothing is left."""
    lines = F.split(text, "\n")
    first = F.greatest(start, F.lit(1))
    cut = F.slice(lines, first, F.greatest(F.least(end, F.size(lines)) - first + 1, F.lit(0)))
    out = F.trim(F.array_join(cut, "\n"))
    return F.when(out != "", out)


def truncated(text: Column, n: int, suffix: str) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit(suffix))).otherwise(text)


def chunks(text: Column, limit: int = 2000) -> Column:
    """Array of chunks: whole lines are packed while they fit; a line that alone exceeds the limit stays whole."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(acc: Column, line: Column) -> Column:
        full = acc["open"].isNotNull() & (F.length(acc["open"]) + F.length(line) + 2 > limit)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"),
            F.when(full | acc["open"].isNull(), line).otherwise(F.concat(acc["open"], F.lit("\n"), line)).alias("open"),
        )

    packed = F.aggregate(F.split(text, "\n"), start, step, lambda a: F.concat(a["done"], F.array(a["open"])))
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(packed)


def module_of(path: Column) -> Column:
    return F.regexp_replace(F.translate(F.regexp_replace(path, r"\.[^./]*$", ""), "/", "."), r"^\.+", "")


def clean_stem(path: Column) -> Column:
    """File name without suffix and without marks of a test."""
    c = F.regexp_replace(filename(path), r"\.[^.]*$", "")
    for mark in ("test_", "_test", ".test", ".spec", "_spec"):
        c = F.replace(c, F.lit(mark), F.lit(""))
    return c


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def csv_names(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def subject(message: Column) -> Column:
    return F.substring_index(message, "\n", 1)


def body(message: Column) -> Column:
    return F.when(message.contains("\n"), F.trim(F.regexp_replace(message, r"^[^\n]*\n", ""))).otherwise("")


def parent_count(parents: Column) -> Column:
    return F.when(F.coalesce(F.trim(parents), F.lit("")) == "", 0).otherwise(F.size(csv_names(parents)))


def milliseconds(seconds: Column) -> Column:
    """Text in seconds to whole milliseconds, cut off; null if it is no number."""
    return (seconds.try_cast("double") * 1000).cast("long")


def sanitised(text: Column) -> Column:
    for pattern, new in K.SECRET_PATTERNS:
        text = F.regexp_replace(text, pattern, new)
    return text


def human_size(n: Column) -> Column:
    """Bytes in units of 1024 with two decimals."""
    unit = F.least(F.floor(F.log(1024.0, F.greatest(n, F.lit(1)))), F.lit(3)).cast("int")
    units = F.array(F.lit("B"), F.lit("KB"), F.lit("MB"), F.lit("GB"))
    return F.concat(F.round(n / F.pow(F.lit(1024.0), unit), 2).cast("string"), F.lit(" "), F.element_at(units, unit + 1))


def characters(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))


def name_similarity(a: Column, b: Column) -> Column:
    """1 if equal but for case; by length if one holds the other; else the Jaccard share of common characters."""
    x, y = F.lower(a), F.lower(b)
    short, long_ = F.least(F.length(x), F.length(y)), F.greatest(F.length(x), F.length(y))
    cx, cy = characters(x), characters(y)
    union = F.size(F.array_union(cx, cy))
    return (
        F.when(x == y, 1.0)
        .when(x.contains(y) | y.contains(x), short / long_)
        .otherwise(F.when(union > 0, F.size(F.array_intersect(cx, cy)) / union).otherwise(0.0))
    )


def path_similarity(query: Column, path: Column) -> Column:
    """1 if equal, 0.95 if the path ends with the query, 0.8 if it holds it, else equal segments from the end over the longer path's."""
    x, y = F.lower(F.translate(query, "\\", "/")), F.lower(F.translate(path, "\\", "/"))
    p, q = F.reverse(F.split(x, "/")), F.reverse(F.split(y, "/"))
    same = F.size(F.filter(F.zip_with(p, q, lambda s, t: F.coalesce(s == t, F.lit(False))), lambda b: b))
    return (
        F.when(x == y, 1.0)
        .when(F.endswith(y, x), 0.95)
        .when(y.contains(x), 0.8)
        .otherwise(same / F.greatest(F.size(p), F.size(q)))
    )


def citation_numbers(answer: Column) -> Column:
    """Distinct evidence numbers in the order they are first mentioned."""
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[Evidence (\d+)\]"), F.lit(1)), lambda x: x.cast("int")))


def section(text: Column, title: str) -> Column:
    """Body of a markdown section, up to the next heading of its depth; null if there is none."""
    found = F.trim(F.regexp_extract(text, rf"(?is)(?:^|\n)#+ {title}[^\n]*\n(.*?)(?=\n#+ |$)", 1))
    return F.when(found != "", found)


def fenced_json(text: Column) -> Column:
    """Text of the first fenced JSON block; null if there is none."""
    found = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    return F.when(found != "", found)


def vector_cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles; null if either is null or has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return dot / F.nullif(norm(a) * norm(b), F.lit(0.0))


def progress(value: Column) -> Column:
    """A percentage within its bounds; 0 where it is missing."""
    return F.least(F.greatest(F.coalesce(value, F.lit(0)), F.lit(0)), F.lit(100))


def percent(part: Column, whole: Column) -> Column:
    """A share as whole per cent, such as ``75%``; null of nothing."""
    return F.when(whole > 0, F.concat(F.round(100 * part / whole).cast("long").cast("string"), F.lit("%")))
