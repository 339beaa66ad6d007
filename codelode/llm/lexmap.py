"""Chunks of source text as maps of lexer states, with their unmatched brackets.

A chunk is read once for each state the lexer may be in at its start; what it
does is a small map from entry state to exit state and to the brackets that
neither open nor close within it.  Maps of neighbouring chunks combine
associatively, so the chunks of a long text can be read anywhere and reduced
in any grouping.  Once the state at the start of a chunk is known, so are the
lines in it at which a statement outside all brackets begins.
"""

from __future__ import annotations

import re

from codelode.llm.ecma import STARTERS

#: States: code, block comment, template (JavaScript) or one of the long strings (Python).
CODE, COMMENT, TEMPLATE, LONG1, LONG2 = "c", "m", "t", "'", '"'
STATES = {"script": (CODE, COMMENT, TEMPLATE), "python": (CODE, LONG1, LONG2)}
CHUNK_CHARS = 1 << 16

#: Where a line may begin a statement: the word of a declaration, or anything that goes on nothing.
_NEW = {"script": rf"\n(?={STARTERS})", "python": r"\n(?=[^\s#)\]}](?<!\\\n.))(?!(?:else|elif|except|finally)\b)"}
_SCRIPT = re.compile(rf"""//[^\n]*|/\*|'(?:[^'\\\n]|\\[\s\S])*'|"(?:[^"\\\n]|\\[\s\S])*"|`|[()\[\]{{}}]|/|{_NEW["script"]}""")
_SCRIPT_END = {COMMENT: re.compile(r"\*/"), TEMPLATE: re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{)")}
_REGEX = re.compile(r"/(?:[^\\/\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/")
_OPERAND = re.compile(r"(?:[\w$)\]'\"`}]|\+\+|--)\s*\Z")
_BEFORE_REGEX = re.compile(r"(?:^|[^\w$.])(?:return|typeof|case|do|else|in|instanceof|new|void|delete|throw|yield|await|of)\s*\Z")
_PYTHON = re.compile(rf"""\#[^\n]*|'''|\"\"\"|'(?:[^'\\\n]|\\[\s\S])*'|"(?:[^"\\\n]|\\[\s\S])*"|[()\[\]{{}}]|{_NEW["python"]}""")
_PYTHON_END = {LONG1: re.compile(r"(?:[^'\\]|\\[\s\S]|'(?!''))*'''"), LONG2: re.compile(r'(?:[^"\\]|\\[\s\S]|"(?!""))*"""')}
_PAIR = {")": "(", "]": "[", "}": "{"}

#: What a chunk does from one entry state: exit state, unmatched closers, unmatched openers; None if it cannot be.
Effect = tuple[str, str, str] | None


def _scan(text: str, state: str, language: str, starts: list[tuple[int, int]] | None = None) -> Effect:
    """The effect of a chunk; ``starts`` takes where statements may begin: outside all brackets opened in it, with the number closed so far."""
    python = language == "python"
    token, ends = (_PYTHON, _PYTHON_END) if python else (_SCRIPT, _SCRIPT_END)
    opened: list[str] = []
    closed: list[str] = []
    i = 0
    while True:
        if state != CODE:
            m = ends[state].match(text, i) if state != COMMENT else ends[state].search(text, i)
            if not m:
                return state, "".join(closed), "".join(opened)
            i = m.end()
            if state == TEMPLATE and m[1] == "${":
                opened.append("$")
            state = CODE
        for m in token.finditer(text, i):
            x = m[0]
            if x == "\n":
                if not opened and starts is not None:
                    starts.append((m.end(), len(closed)))
            elif x in "([{":
                opened.append(x)
            elif x in ")]}":
                if not opened:
                    closed.append(x)
                elif opened[-1] == "$" and x == "}":
                    opened.pop()
                    state = TEMPLATE
                elif opened.pop() != _PAIR[x]:
                    return None
            elif x == "/*":
                state = COMMENT
            elif x == "`":
                state = TEMPLATE
            elif x == "'''" or x == '"""':
                state = x[0]
            elif x == "/":
                at = m.start()
                before = text[max(0, at - 80) : at]
                if not _OPERAND.search(before) or _BEFORE_REGEX.search(before):
                    r = _REGEX.match(text, at)
                    if r:
                        i = r.end()
                        break
            else:
                continue
            if state != CODE:
                i = m.end()
                break
        else:
            return CODE, "".join(closed), "".join(opened)


def chunk_map(text: str, language: str, states: tuple[str, ...] | None = None, starts: list[tuple[int, int]] | None = None) -> dict[str, Effect]:
    """The map of a chunk, for all entry states or some of them; ``starts`` as in ``_scan``, with one state only."""
    return {s: _scan(text, s, language, starts) for s in states or STATES[language]}


def statement_starts(text: str, state: str, language: str, depth: int = 0) -> list[int]:
    """Where statements outside all brackets begin in a chunk that is entered in this state, ``depth`` brackets deep."""
    starts: list[tuple[int, int]] = []
    _scan(text, state, language, starts)
    return [at for at, closed in starts if closed == depth]


def combine(a: dict[str, Effect], b: dict[str, Effect]) -> dict[str, Effect]:
    """The map of two chunks in a row."""
    out: dict[str, Effect] = {}
    for s, first in a.items():
        second = b.get(first[0]) if first else None
        if first is None or second is None:
            out[s] = None
            continue
        opened, closed, ok = list(first[2]), first[1], True
        for x in second[1]:
            if not opened:
                closed += x
            elif opened[-1] == "$" and x == "}":
                ok = False  # a substitution that ends in a later chunk: left to the grammar
                break
            elif opened.pop() != _PAIR[x]:
                ok = False
                break
        out[s] = (second[0], closed, "".join(opened) + second[2]) if ok else None
    return out


def cut(text: str, size: int = CHUNK_CHARS) -> list[str]:
    """Chunks that end with a line, where a line ends within the size."""
    if len(text) <= size:
        return [text]
    out, at = [], 0
    while at < len(text):
        end = at + size
        if end < len(text):
            nl = text.rfind("\n", at, end)
            end = nl + 1 if nl > at else end
        out.append(text[at:end])
        at = end
    return out


def verdict(whole: dict[str, Effect]) -> str | None:
    """What is wrong with a text that has this map, as far as the map tells."""
    e = whole[CODE]
    if e is None:
        return None
    state, closed, opened = e
    if state != CODE:
        return "comment or string without end"
    if closed:
        return "bracket closed that was not open"
    if opened:
        return "bracket left open"
    return None
