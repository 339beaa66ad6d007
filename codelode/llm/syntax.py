"""Source files that do not parse.

A text is cut where the lexer-state map of its chunk shows that a statement
outside all brackets begins (see ``lexmap``), and each statement is read on its
own: of JavaScript and TypeScript by groups from the inside out (see ``ecma``),
of Python by the interpreter's compiler.  Statements that are all valid make a
valid text.  Where one is not, or the map finds a bracket or string without
end, the whole text is read once more, and that decides: some statements go on
over such a line, and maps know no markup.  So the verdict does not depend on
where a text is cut.

Texts over LONG_CHARS are cut into chunks that are read on different executors:
first their maps, reduced by file to the state and depth at each chunk's start,
then the statements that lie within a chunk; those that lie across chunks are
put together.

Defined results
* The language is that of the path's ending (.py, .js, .jsx, .ts, .tsx, in any
  case); other files have none and are not judged.
* Empty and blank texts are valid.  Where the interpreter's compiler runs out of
  stack or memory on a Python text, or the script reader out of its million
  frames, there is no verdict and no case.
* Several rows of one file: it is a case if any of its texts is invalid.  If
  all are null it is a case if a failed report on it speaks of the syntax.
* Rows without path are ignored; extra columns too.
"""

from __future__ import annotations

import __future__
import json
import re
import warnings
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm import ecma, lexmap
from codelode.staging import spread, stage

ENDINGS = {"py": "Python", "js": "JavaScript", "jsx": "JavaScript", "ts": "TypeScript", "tsx": "TypeScript"}
#: Texts that are longer than this are cut and their chunks spread over the cluster.
LONG_CHARS = 1 << 20
#: Wordings of parsers about a text; other failures are about machines, limits or files.
SYNTAX_WORDS = (
    r"(?i)syntax|unterminated|never closed|unexpected (token|indent|unindent|end|eof|character|identifier|string|number)|"
    r"expected '|expected an indented|invalid (token|character|decimal|syntax)|unmatched|does not match any outer|unindent|missing parenthes"
)
#: A word that binds a name for its whole module; in a function it is no concern of other statements.
_GLOBAL = re.compile(r"(?:^|[:;])[ \t]*global\b", re.M)
_SCOPE = re.compile(r"(?:async[ \t]+)?(?:def|class)\b|@")
_FUTURE = re.compile(r"^from[ \t]+__future__[ \t]+import\b.*", re.M)
#: Statements are read together until they have so many characters, as each call of a parser has its cost.
LEAST_PIECE = 512


def _language(path: str) -> str | None:
    ending = path.rsplit(".", 1)[-1].lower() if "." in path else ""
    return ending if ending in ENDINGS else None


def _lexer(ending: str) -> str:
    return "python" if ending == "py" else "script"


def _plain(text: str) -> str:
    """The text with one kind of line end and without byte order mark."""
    return text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")


def _compiled(text: str, flags: int = 0) -> str | None:
    try:
        # some statements are refused only when code is made
        compile(text, "text", "exec", flags, dont_inherit=True)
    except (SyntaxError, ValueError) as e:
        return f"syntax: {e.args[0] if e.args else e}"
    except (RecursionError, MemoryError):
        return "unknown"
    return None


def _future_flags(line: str) -> int:
    """Flags of the features that a line names; the compiler has refused those that are none."""
    names = re.findall(r"\w+", line.split("#")[0].split("import", 1)[1])
    return sum({getattr(__future__, n).compiler_flag for n in names if n in __future__.all_feature_names})


def _only_scopes(piece: str) -> bool:
    """Whether all that stands at the margin begins a scope of its own, so no name is bound for the module."""
    return all(line[:1] in ("", " ", "\t", "#", ")", "]", "}") or _SCOPE.match(line) for line in piece.split("\n"))


def _python_statements(pieces: list[str], flags: int = 0, at_start: bool = True) -> bool:
    """Whether all are valid, with what one statement of a module means for the others."""
    for piece in pieces:
        if not at_start and _FUTURE.search(piece) or _GLOBAL.search(piece) and not _only_scopes(piece):
            return False
        if _compiled(piece, flags) is not None:
            return False
        # with the features it names, a first piece says how the others are read
        flags |= sum(map(_future_flags, _FUTURE.findall(piece)))
        at_start = at_start and not piece.strip()
    return True


def _pieces(text: str, starts: list[int]) -> list[str]:
    """The statements of a text, short ones together; what decorates stays with what it decorates."""
    out: list[str] = []
    begin = last = 0
    for at in starts:
        decorates, last = text[last] == "@", at
        if not decorates and at - begin >= LEAST_PIECE:
            out.append(text[begin:at])
            begin = at
    out.append(text[begin:])
    return out


def _whole(text: str, ending: str) -> str | None:
    if ending == "py":
        return _compiled(text)
    try:
        return None if ecma.valid(text, ending in ("ts", "tsx"), ending != "ts") else "syntax: no rule fits"
    except (RecursionError, MemoryError):
        return "unknown"


def _statements_valid(pieces: list[str], ending: str, at_start: bool = True) -> bool:
    if ending == "py":
        return _python_statements(pieces, at_start=at_start)
    return all(_whole(piece, ending) is None for piece in pieces)


def judge(text: str, ending: str) -> str | None:
    """What is wrong with the text, None if it is valid, ``unknown`` if that cannot be told."""
    text = _plain(text)
    if not text.strip():
        return None
    # one chunk, entered in code
    starts: list[tuple[int, int]] = []
    fault = lexmap.verdict(lexmap.chunk_map(text, _lexer(ending), (lexmap.CODE,), starts))
    if not fault and _statements_valid(_pieces(text, [at for at, closed in starts if not closed]), ending):
        return None
    return _whole(text, ending)


def _judge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    warnings.simplefilter("ignore")
    for batch in batches:
        rows = batch.to_pydict()
        errors = [None if t is None else judge(t, e) for t, e in zip(rows["text"], rows["ending"])]
        yield pa.record_batch(
            [*(batch.column(c) for c in ("repository_id", "path", "ending")), pa.array([t is not None for t in rows["text"]]), pa.array(errors, pa.string())],
            names=["repository_id", "path", "ending", "stored", "error"],
        )


# --- long texts, chunk by chunk ---------------------------------------------------------------------


def _cut_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pydict()
        for key, ending, text in zip(rows["key"], rows["ending"], rows["text"]):
            parts = lexmap.cut(_plain(text), size)
            yield pa.record_batch(
                [pa.array([key] * len(parts), pa.int64()), pa.array([ending] * len(parts)), pa.array(range(len(parts)), pa.int32()), pa.array(parts)],
                names=["key", "ending", "pos", "chunk"],
            )


def _map_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pydict()
        maps = [json.dumps(lexmap.chunk_map(t, _lexer(e))) for t, e in zip(rows["chunk"], rows["ending"])]
        yield pa.record_batch([batch.column("key"), batch.column("pos"), pa.array(maps, pa.string())], names=["key", "pos", "map"])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """State and depth at the start of each chunk, null where the maps cannot tell."""
    for batch in batches:
        rows = batch.to_pydict()
        for key, maps in zip(rows["key"], rows["maps"]):
            whole = {lexmap.CODE: (lexmap.CODE, "", "")}
            states, depths = [], []
            for m in maps:
                effect = whole[lexmap.CODE]
                states.append(effect and effect[0])
                depths.append(effect and (-1 if effect[1] else len(effect[2])))
                whole = lexmap.combine(whole, {k: v and tuple(v) for k, v in json.loads(m["map"]).items()})
            fine = whole[lexmap.CODE] is not None and lexmap.verdict(whole) is None
            n = len(maps)
            yield pa.record_batch(
                [pa.array([key] * n, pa.int64()), pa.array([m["pos"] for m in maps], pa.int32()), pa.array(states, pa.string()), pa.array(depths, pa.int32()), pa.array([fine] * n)],
                names=["key", "pos", "state", "depth", "fine"],
            )


def _chunk_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each chunk whether its inner statements are valid, and what lies before the first and after the last of them."""
    warnings.simplefilter("ignore")
    for batch in batches:
        rows = batch.to_pydict()
        out = []
        for ending, pos, chunk, state, depth, fine in zip(*(rows[c] for c in ("ending", "pos", "chunk", "state", "depth", "fine"))):
            if not fine or state is None or depth < 0:
                out.append((False, None, None))
                continue
            pieces = _pieces(chunk, lexmap.statement_starts(chunk, state, _lexer(ending), depth))
            inner = pieces[1:-1] if len(pieces) > 1 else []
            ok = not any(map(_FUTURE.search, inner)) and _statements_valid(inner, ending, at_start=False)
            out.append((ok, pieces[0], pieces[-1] if len(pieces) > 1 else None))
        ok, heads, ends = zip(*out) if out else ((), (), ())
        yield pa.record_batch(
            [batch.column("key"), batch.column("ending"), batch.column("pos"), pa.array(ok, pa.bool_()), pa.array(heads, pa.string()), pa.array(ends, pa.string())],
            names=["key", "ending", "pos", "ok", "head", "end"],
        )


def _join_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether the statements that lie across chunks, and all others, are valid."""
    warnings.simplefilter("ignore")
    for batch in batches:
        rows = batch.to_pydict()
        found = []
        for ending, parts in zip(rows["ending"], rows["parts"]):
            ok = all(p["ok"] for p in parts)
            pieces, open_ = [], ""
            for p in parts if ok else ():
                open_ += p["head"]
                if p["end"] is not None:
                    pieces.append(open_)
                    open_ = p["end"]
            pieces.append(open_)
            # the order of imports from the future is left to the reading of the whole
            ok = ok and not any(map(_FUTURE.search, pieces[1:]))
            found.append(ok and all(not p.strip() or _statements_valid(_pieces(p, lexmap.statement_starts(p, lexmap.CODE, _lexer(ending))), ending) for p in pieces))
        yield pa.record_batch([batch.column("key"), pa.array(found, pa.bool_())], names=["key", "fine"])


def long_text_verdicts(long_files: DataFrame, size: int = lexmap.CHUNK_CHARS) -> DataFrame:
    """(key, fine) of long texts, each chunk read on its own; where not ``fine`` the whole text has to be read."""
    chunks = long_files.select("key", "ending", "text").mapInArrow(partial(_cut_batches, size=size), "key long, ending string, pos int, chunk string").repartition("key", "pos")
    maps = chunks.mapInArrow(_map_batches, "key long, pos int, map string")
    entries = (
        maps.groupBy("key")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "map"))).alias("maps"))
        .mapInArrow(_fold, "key long, pos int, state string, depth int, fine boolean")
    )
    read = chunks.join(entries, ["key", "pos"]).mapInArrow(_chunk_batches, "key long, ending string, pos int, ok boolean, head string, end string")
    return (
        read.groupBy("key", "ending")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "ok", "head", "end"))).alias("parts"))
        .mapInArrow(_join_batches, "key long, fine boolean")
    )


def file_verdicts(files: DataFrame, long_chars: int = LONG_CHARS, size: int = lexmap.CHUNK_CHARS) -> DataFrame:
    """(repository_id, path, ending, stored, error) of each row of a judged language."""
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    rows = files.select("repository_id", "path", ending.alias("ending"), F.col("content").alias("text")).where(
        F.col("path").isNotNull() & F.col("ending").isin(*ENDINGS)
    )
    schema = "repository_id string, path string, ending string, stored boolean, error string"
    is_long = F.coalesce(F.length("text") > long_chars, F.lit(False))
    short = spread(rows.where(~is_long), "repository_id", "path")
    # equal texts have one key, so each is read once; written apart, they cost the listing one scan
    long_ = stage(rows.where(is_long).withColumn("key", F.xxhash64("ending", "text"))).df
    distinct = long_.dropDuplicates(["key"])
    judged = long_.join(long_text_verdicts(distinct, size), "key")
    fine = judged.where("fine").select("repository_id", "path", "ending", F.lit(True).alias("stored"), F.lit(None).cast("string").alias("error"))
    again = judged.where("not fine").select("repository_id", "path", "ending", "text")
    return short.mapInArrow(_judge_batches, schema).unionByName(fine).unionByName(again.mapInArrow(_judge_batches, schema))


def syntax_report(files: DataFrame, reports: DataFrame) -> DataFrame:
    """One row per judged file: (repository_id, file_path, language, invalid)."""
    v = file_verdicts(files).groupBy("repository_id", "path", "ending").agg(
        F.max("stored").alias("stored"), F.max(F.startswith("error", F.lit("syntax"))).alias("bad")
    )
    said = (
        reports.where(~F.col("success") & F.col("error").rlike(SYNTAX_WORDS))
        .select("repository_id", F.col("file_path").alias("path"))
        .distinct()
        .withColumn("said", F.lit(True))
    )
    names = F.create_map(*[F.lit(x) for kv in ENDINGS.items() for x in kv])
    return v.join(said, ["repository_id", "path"], "left").select(
        "repository_id", F.col("path").alias("file_path"), names[F.col("ending")].alias("language"),
        F.coalesce(F.when(F.col("stored"), F.col("bad")).otherwise(F.col("said")), F.lit(False)).alias("invalid"),
    )


def unparsable(files: DataFrame, reports: DataFrame) -> DataFrame:
    return syntax_report(files, reports).where("invalid").select("repository_id", "file_path").distinct()


def syntax_rates(files: DataFrame, reports: DataFrame) -> DataFrame:
    """(repository_id, language, n_files, n_invalid, rate)."""
    return (
        syntax_report(files, reports)
        .groupBy("repository_id", "language")
        .agg(F.count(F.lit(1)).alias("n_files"), F.count_if("invalid").alias("n_invalid"))
        .withColumn("rate", F.round(F.col("n_invalid") / F.col("n_files"), 6))
    )
