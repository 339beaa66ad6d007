"""Whether a text is syntactically valid JavaScript or TypeScript.

The text is first reduced to token classes: strings, templates, numbers,
regular expressions and comments by one lexical pass, identifiers that are no
words of the language to one letter.  Then balanced groups are parsed from the
inside out: the content of an innermost pair of brackets has no brackets left,
so it is one flat token string, which a small grammar reads once for every
role the group could play (block, object, class body, parameters, ...).  The
group is replaced by one character that stands for its roles.  What a content
string is worth is remembered, so text that repeats its forms costs a lookup.

Brackets are matched by a stack in one pass, and no depth of nesting is
refused: the reader's recursion lives on the heap (see ``DEEPEST``).

Scope rules (double declarations, labels that do not exist) and most rules of
strict mode are not syntax here; ``with`` in a module, in a class or under a
leading ``use strict`` is.  ``await`` and ``yield`` count as words of the language.
"""

from __future__ import annotations

import re
import sys
from functools import lru_cache


#: Frames of the reader; they are Python frames only, which take memory but none of the C stack.
DEEPEST = 1_000_000


class Bad(Exception):
    """The text is not valid."""


# --- lexical pass --------------------------------------------------------------------------------

#: Words that are never names.
RESERVED = (
    "await break case catch class const continue debugger default delete do else enum export extends false finally for "
    "function if import in instanceof new null return super switch this throw true try typeof var void while with yield"
).split()
#: Words with a meaning in some places only.
SOFT = (
    "abstract accessor any as asserts async bigint boolean constructor declare from get global implements infer interface is keyof let module "
    "namespace never number object of out override private protected public readonly require satisfies set static string symbol type undefined unique unknown"
).split()
_SOFT = frozenset(SOFT)
_RESERVED = frozenset(RESERVED)

_NAME_START = r"A-Za-z_$ªµºÀ-ÖØ-öø-˿Ͱ-ͽͿ-῿‌-‍⁰-↏Ⰰ-⿯、-퟿豈-﷏ﷰ-�\U00010000-\U000EFFFF"
_NAME = rf"[{_NAME_START}][{_NAME_START}0-9\u0300-\u036f]*"
_DIGITS = r"[0-9]+(?:_[0-9]+)*"
_NUMBER = re.compile(
    rf"(?<![\w$])(?:0[xX][0-9a-fA-F]+(?:_[0-9a-fA-F]+)*n?|0[bB][01]+(?:_[01]+)*n?|0[oO][0-7]+(?:_[0-7]+)*n?|(?:0|[1-9][0-9]*(?:_[0-9]+)*)n|(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?)(?![\w$])"
)
_LEFT_DIGIT = re.compile(r"(?<![\w$])[0-9]")
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*")
_PIECE = re.compile(
    r"""(?P<c>//[^\n\u2028\u2029]*|/\*.*?\*/)"""
    r"""|(?P<s>"(?:[^"\\\n]|\\(?:\r\n|[\s\S]))*"|'(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*')"""
    r"""|(?P<t>`(?:[^`\\$]|\\[\s\S]|\$(?!\{))*`)"""
    r"""|(?P<x>[`"'/#\\@])""",
    re.S,
)
#: The same inside braces, with elements, and both.
_PIECES = {
    (inside, jsx): re.compile(_PIECE.pattern + (r"|(?P<b>[{}])" if inside else "") + (r"|(?P<l><)" if jsx else ""), re.S) for inside in (False, True) for jsx in (False, True)
}
_WORD_BEFORE = re.compile(r"([A-Za-z_$][\w$]*)\s*\Z")
_AFTER_WORD = frozenset("return typeof case do else in instanceof new void delete throw yield await of extends default".split())
_TEMPLATE_TEXT = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
_JSX_OPEN = re.compile(rf"<\s*(?:>|{_NAME}(?:[-.:][\w$]+)*)")
_GENERIC = re.compile(r"\s*(?:,|extends\b)")
_PRIVATE = re.compile(rf"#{_NAME}")
_JSX_TEXT = re.compile(r"[^<{}>]*")
_JSX_ATTR = re.compile(r"\s*(?:/\*.*?\*/\s*)*([A-Za-z_$][\w$:-]*)(\s*=\s*)?", re.S)
_WORD = re.compile(rf"(?<![\w$])({_NAME})")
_KEPT = {w: w for w in RESERVED + SOFT}
_SPACES = re.compile(r"[ \t\f\v\u00a0\ufeff]*[\n\u2028\u2029]\s*")
_BLANKS = re.compile(r"[ \t\f\v\u00a0\ufeff\u2000-\u200a\u3000]+")
_UNESCAPE = re.compile(r"\\u(?:\{[0-9a-fA-F]+\}|[0-9a-fA-F]{4})")


def _starts_expression(out: list[str]) -> bool:
    """Whether an operand, not an operator, comes next."""
    for part in reversed(out):
        tail = part.rstrip()
        if tail:
            break
    else:
        return True
    last = tail[-1]
    if last in ")]}'`0\x02":
        return last == "}"
    word = _WORD_BEFORE.search(tail)
    if word:
        return word[1] in _AFTER_WORD and not tail[: word.start()].rstrip().endswith(".")
    if tail.endswith(("++", "--")):
        return False
    return not (last.isalnum() or last in "_$")


def _template(text: str, i: int, out: list[str], jsx: bool) -> int:
    """Read a template from its back quote; substitutions become marked groups."""
    out.append(" `")
    i += 1
    while True:
        i = _TEMPLATE_TEXT.match(text, i).end()
        if i >= len(text):
            raise Bad("template without end")
        if text[i] == "`":
            return i + 1
        out.append("\x01(")
        i = _code(text, i + 2, out, jsx, inside=True)
        out.append(")")


def _jsx(text: str, i: int, out: list[str]) -> int:
    """Read an element from its ``<``; expressions in braces become marked groups."""
    m = _JSX_OPEN.match(text, i)
    if not m:
        raise Bad("element expected")
    fragment = m[0].endswith(">")
    name = "" if fragment else m[0][1:].strip()
    i = m.end()
    while not fragment:
        rest = re.compile(r"\s*(?:/>|>|\{)").match(text, i)
        if rest:
            i = rest.end()
            if rest[0].endswith("/>"):
                return i
            if rest[0].endswith(">"):
                break
            i = _braces(text, i, out)
            continue
        a = _JSX_ATTR.match(text, i)
        if not a:
            raise Bad("attribute expected")
        i = a.end()
        if a[2]:
            if i >= len(text):
                raise Bad("attribute without value")
            if text[i] == "{":
                i = _braces(text, i + 1, out)
            elif text[i] in "'\"":
                end = text.find(text[i], i + 1)
                if end < 0:
                    raise Bad("string without end")
                i = end + 1
            else:
                raise Bad("attribute value expected")
    while True:
        i = _JSX_TEXT.match(text, i).end()
        if i >= len(text) or text[i] in ">}":
            raise Bad("element without end")
        if text[i] == "{":
            i = _braces(text, i + 1, out)
        elif text.startswith("</", i):
            m = re.compile(r"</\s*([\w$.:-]*)\s*>").match(text, i)
            if not m or m[1] != name:
                raise Bad("closing tag expected")
            return m.end()
        else:
            i = _jsx(text, i, out)


def _braces(text: str, i: int, out: list[str]) -> int:
    out.append("\x01[")
    i = _code(text, i, out, True, inside=True)
    out.append("]")
    return i


def _code(text: str, i: int, out: list[str], jsx: bool, inside: bool = False) -> int:
    """Append the text from ``i`` on without comments and literals; inside braces, up to the closing one."""
    depth = 0
    piece = _PIECES[inside, jsx]
    while True:
        m = piece.search(text, i)
        if not m:
            if inside:
                raise Bad("braces without end")
            out.append(text[i:])
            return len(text)
        out.append(text[i : m.start()])
        i, kind = m.end(), m.lastgroup
        if kind == "c":
            out.append("\n" if "\n" in m[0] else " ")
        elif kind == "s":
            out.append(" '")
        elif kind == "t":
            out.append(" `")
        elif kind == "b":
            if m[0] == "{":
                depth += 1
            elif depth == 0:
                return i
            else:
                depth -= 1
            out.append(m[0])
        elif kind == "l":
            follow = _JSX_OPEN.match(text, m.start()) if _starts_expression(out) else None
            if follow and not _GENERIC.match(text, follow.end()):
                out.append(" `")
                i = _jsx(text, m.start(), out)
            else:
                out.append("<")
        else:
            c = m[0]
            if c == "`":
                i = _template(text, m.start(), out, jsx)
            elif c in "\"'":
                raise Bad("string without end")
            elif c == "/":
                if text.startswith("/*", m.start()):
                    raise Bad("comment without end")
                r = _starts_expression(out) and _REGEX.match(text, m.start())
                if r:
                    out.append(" \x02 ")
                    i = r.end()
                else:
                    out.append("/")
            elif c == "#":
                if m.start() == 0 and text.startswith("#!"):
                    i = text.find("\n") if "\n" in text else len(text)
                elif _PRIVATE.match(text, m.start()):
                    out.append(" #")
                else:
                    raise Bad("unexpected character")
            elif c == "@":
                out.append(" @ ")
            else:
                u = _UNESCAPE.match(text, m.start())
                if not u:
                    raise Bad("unexpected character")
                out.append("u")
                i = u.end()


def reduce_text(text: str, jsx: bool) -> str:
    """The text as token classes."""
    out: list[str] = []
    if text.startswith("\ufeff"):
        text = text[1:]
    _code(text.replace("\r\n", "\n").replace("\r", "\n"), 0, out, jsx)
    flat = _NUMBER.sub(" \x03 ", "".join(out))
    if _LEFT_DIGIT.search(flat):
        raise Bad("number followed by a name")
    kept = _KEPT.get
    words = _WORD.split(flat)
    words[1::2] = [kept(w, "a") for w in words[1::2]]
    flat = "".join(words).replace("\x03", "0")
    return _BLANKS.sub(" ", _SPACES.sub("\n", flat))


# --- grammar ---------------------------------------------------------------------------------------

RETURN, AWAIT, YIELD, BREAK, CONTINUE, SUPER, TARGET, WITH, MODULE = 1, 2, 4, 8, 16, 32, 64, 128, 256
#: What a function that is no method must not hold, and what leaves a function's body.
_OF_METHODS, _OF_ARROWS, _OF_BODIES = SUPER, SUPER | TARGET | WITH, WITH
_TOKEN = re.compile(
    r"\n|[A-Za-z_$]+|0|'|`|\x02|\x01|#a?|[\ue000-\uf8ff\U000f0000-\U0010ffff]|>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?![0-9])|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|\*\*|[-+*/%=<>!~?:;,.&|^@]| +"
)
_ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
_BINARY = frozenset("+ - * / % ** == != === !== < > <= >= << & | ^ && || ?? in instanceof >> >>>".split())
_UNARY = frozenset("+ - ! ~ typeof void delete ++ --".split())
_MODIFIERS = frozenset("public private protected readonly static abstract override declare accessor".split())
_TYPE_WORDS = frozenset("keyof unique readonly infer asserts".split())


class Groups:
    """Characters that stand for bracketed groups and their roles."""

    def __init__(self) -> None:
        self.by_key: dict[tuple, str] = {}
        self.roles: dict[str, tuple[str, dict[str, int]]] = {}

    def char(self, bracket: str, roles: dict[str, int]) -> str:
        key = (bracket, tuple(sorted(roles.items())))
        c = self.by_key.get(key)
        if c is None:
            n = len(self.by_key)
            c = chr(0xE000 + n) if n < 6400 else chr(0xF0000 + n - 6400)
            self.by_key[key] = c
            self.roles[c] = (bracket, roles)
        return c


GROUPS = Groups()


def tokenise(flat: str) -> tuple[list[str], list[bool]]:
    """Tokens, and whether each begins a line."""
    tokens: list[str] = []
    fresh_: list[bool] = []
    fresh, at = False, 0
    for m in _TOKEN.finditer(flat):
        if m.start() != at:
            raise Bad("unexpected character")
        at = m.end()
        x = m[0]
        if x == "\n":
            fresh = True
        elif x[0] != " ":
            tokens.append(x)
            fresh_.append(fresh)
            fresh = False
    if at != len(flat):
        raise Bad("unexpected character")
    tokens.append("")
    fresh_.append(True)
    return tokens, fresh_


class Reader:
    """Recursive descent over one flat token string."""

    def __init__(self, tokens: tuple[list[str], list[bool]], ts: bool):
        self.t, self.nl = tokens
        self.i, self.ts, self.flags = 0, ts, 0

    # tools
    @property
    def tok(self) -> str:
        return self.t[self.i]

    def peek(self, n: int = 1) -> str:
        return self.t[min(self.i + n, len(self.t) - 1)]

    def eat(self, x: str) -> bool:
        if self.t[self.i] == x and x:
            self.i += 1
            return True
        return False

    def need(self, x: str) -> None:
        if not self.eat(x):
            raise Bad(f"{x} expected")

    def bracket(self, n: int = 0) -> str:
        g = GROUPS.roles.get(self.peek(n) if n else self.tok)
        return g[0] if g else ""

    def group(self, bracket: str, *roles: str, keep: bool = True) -> int:
        """Take a group that can play one of the roles."""
        g = GROUPS.roles.get(self.tok)
        if g and g[0] == bracket:
            for r in roles:
                if r in g[1]:
                    self.i += 1
                    if keep:
                        self.flags |= g[1][r]
                    return g[1][r]
        raise Bad(f"{bracket} expected")

    def can(self, bracket: str, role: str, n: int = 0) -> bool:
        g = GROUPS.roles.get(self.peek(n) if n else self.tok)
        return bool(g and g[0] == bracket and role in g[1])

    def name(self) -> None:
        x = self.tok
        if x != "a" and x not in _SOFT:
            raise Bad("name expected")
        self.i += 1

    def is_name(self, n: int = 0) -> bool:
        x = self.peek(n) if n else self.tok
        return x == "a" or x in _SOFT

    def is_word(self, n: int = 0) -> bool:
        x = self.peek(n) if n else self.tok
        return x == "a" or x in _SOFT or x in _RESERVED

    def done(self) -> None:
        if self.tok:
            raise Bad("unexpected token")

    def attempt(self, f, *args) -> bool:
        at, flags = self.i, self.flags
        try:
            f(*args)
            return True
        except Bad:
            self.i, self.flags = at, flags
            return False

    def semicolon(self) -> None:
        if not self.eat(";") and self.tok and not self.nl[self.i]:
            raise Bad("; expected")

    # types
    def type_note(self) -> None:
        if self.ts and self.eat(":"):
            if self.tok == "asserts" and self.is_name(1) and not self.nl[self.i + 1] or self.tok == "asserts" and self.peek() == "this":
                self.i += 1
                self.i += 1
                if self.eat("is"):
                    self.type_()
                return
            if (self.is_name() or self.tok == "this") and self.peek() == "is" and not self.nl[self.i + 1]:
                self.i += 2
            self.type_()

    def type_(self) -> None:
        self.type_union()
        if self.tok == "extends" and not self.nl[self.i]:
            def rest() -> None:
                self.need("extends")
                self.type_union()
                self.need("?")
                self.type_()
                self.need(":")
                self.type_()
            self.attempt(rest)

    def type_union(self) -> None:
        self.eat("|") or self.eat("&")
        self.type_operator()
        while self.tok in ("|", "&"):
            self.i += 1
            self.type_operator()

    def type_operator(self) -> None:
        while self.tok in _TYPE_WORDS and (self.is_word(1) or self.peek() in ("'", "`", "0") or self.bracket(1)) and not self.nl[self.i + 1]:
            self.i += 1
        if self.tok in ("abstract",) and self.peek() == "new":
            self.i += 1
        if self.tok == "new":
            self.i += 1
            self.type_params()
            self.group("(", "P")
            self.need("=>")
            self.type_()
            return
        if self.tok == "<" or self.bracket() == "(" and self.peek() == "=>":
            self.type_params()
            self.group("(", "P")
            self.need("=>")
            if (self.is_name() or self.tok == "this") and self.peek() == "is":
                self.i += 2
            elif self.tok == "asserts" and self.is_word(1):
                self.i += 2
                if self.eat("is"):
                    self.type_()
                return
            self.type_()
            return
        b = self.bracket()
        if b == "(":
            self.group("(", "T")
        elif b == "[":
            self.group("[", "T")
        elif b == "{":
            self.group("{", "T")
        elif self.tok in ("'", "0"):
            self.i += 1
        elif self.tok == "-" and self.peek() == "0":
            self.i += 2
        elif self.tok == "`":
            self.template("T")
        elif self.tok == "typeof":
            self.i += 1
            if self.tok == "import":
                self.i += 1
                self.group("(", "G")
            elif self.is_word():
                self.i += 1
            else:
                raise Bad("name expected")
            while self.eat("."):
                self.word()
            if self.tok == "<":
                self.attempt(self.type_args)
        elif self.tok == "import":
            self.i += 1
            self.group("(", "G")
            while self.eat("."):
                self.word()
            if self.tok == "<":
                self.type_args()
        elif self.is_name() or self.tok in ("void", "null", "this", "true", "false"):
            self.i += 1
            while self.eat("."):
                self.word()
            if self.tok == "<" and not self.nl[self.i]:
                self.type_args()
        else:
            raise Bad("type expected")
        while self.bracket() == "[" and not self.nl[self.i]:
            self.group("[", "T")

    def word(self) -> None:
        if not self.is_word():
            raise Bad("name expected")
        self.i += 1

    def close_angle(self) -> None:
        x = self.tok
        if x == ">":
            self.i += 1
        elif x[:1] == ">":
            # of a longer operator, one sign is left for the rest; the list may be shared
            self.t = [*self.t[: self.i], x[1:], *self.t[self.i + 1 :]]
        else:
            raise Bad("> expected")

    def type_args(self) -> None:
        saved = self.t
        try:
            self.need("<")
            self.type_()
            while self.eat(","):
                self.type_()
            self.close_angle()
        except Bad:
            self.t = saved
            raise

    def type_params(self) -> None:
        if not (self.ts and self.tok == "<"):
            return
        self.need("<")
        while True:
            while self.tok in ("const", "in", "out") and (self.is_name(1) or self.peek() in ("in", "out")):
                self.i += 1
            self.name()
            if self.eat("extends"):
                self.type_()
            if self.eat("="):
                self.type_()
            if not self.eat(",") or self.tok == ">":
                break
        self.close_angle()

    # bindings
    def binding(self) -> None:
        b = self.bracket()
        if b in ("[", "{"):
            self.group(b, "P")
        else:
            self.name()

    def params(self) -> None:
        while self.tok:
            while self.eat("@"):
                self.decorator()
            if self.ts:
                while self.tok in _MODIFIERS and (self.is_name(1) or self.bracket(1) in ("[", "{")):
                    self.i += 1
            rest = self.eat("...")
            if self.ts and self.tok == "this":
                self.i += 1
            else:
                self.binding()
            if self.ts and self.eat("?") and rest:
                raise Bad("optional rest")
            if self.ts:
                self.type_note()
            if self.tok == "=" and not rest:
                self.i += 1
                self.assign()
            if rest:
                if self.ts:
                    self.eat(",")
                self.done()
            if not self.eat(","):
                break
        self.done()

    def array_pattern(self) -> None:
        while self.tok:
            if self.eat(","):
                continue
            rest = self.eat("...")
            self.binding()
            if self.tok == "=" and not rest:
                self.i += 1
                self.assign()
            if rest:
                self.done()
            if self.tok:
                self.need(",")

    def object_pattern(self) -> None:
        while self.tok:
            if self.eat("..."):
                self.name()
                self.done()
                return
            if self.is_name() and self.peek() in (",", "=", ""):
                self.i += 1
            else:
                self.key()
                self.need(":")
                self.binding()
            if self.eat("="):
                self.assign()
            if self.tok:
                self.need(",")

    def key(self) -> None:
        if self.tok in ("'", "0"):
            self.i += 1
        elif self.bracket() == "[":
            self.group("[", "C")
        elif self.tok == "#a":
            self.i += 1
        elif self.tok == "#":
            self.i += 1
            self.word()
        else:
            self.word()

    # expressions
    def expression(self, no_in: bool = False) -> None:
        self.assign(no_in)
        while self.eat(","):
            self.assign(no_in)

    def assign(self, no_in: bool = False) -> None:
        if self.tok == "yield":
            self.i += 1
            self.flags |= YIELD
            if self.tok and not self.nl[self.i] and self.tok not in (",", ";", ":"):
                self.eat("*")
                self.assign(no_in)
            return
        while True:
            if self.pattern("="):
                self.i += 1
            elif self.arrow(no_in):
                return
            else:
                kind = self.conditional(no_in)
                if self.tok not in _ASSIGN:
                    return
                if kind != "ref":
                    raise Bad("target expected")
                self.i += 1
            if self.tok == "yield":
                self.assign(no_in)
                return

    def pattern(self, *then: str) -> bool:
        """Take a group that is a pattern of targets, if one of the tokens comes after it."""
        b = self.bracket()
        if b in ("[", "{") and self.peek() in then and self.can(b, "A"):
            self.group(b, "A")
            return True
        return False

    def target(self) -> None:
        if not self.pattern(",", "=", "") and self.postfix() != "ref":
            raise Bad("target expected")
        if self.ts and self.tok in ("as", "satisfies"):
            self.i += 1
            self.type_()

    def array_targets(self) -> None:
        while self.tok:
            if self.eat(","):
                continue
            rest = self.eat("...")
            self.target()
            if rest:
                self.done()
            elif self.eat("="):
                self.assign()
            if self.tok:
                self.need(",")

    def object_targets(self) -> None:
        while self.tok:
            if self.eat("..."):
                self.target()
                self.done()
                return
            if self.is_name() and self.peek() in (",", "=", ""):
                self.i += 1
            else:
                self.key()
                self.need(":")
                self.target()
            if self.eat("="):
                self.assign()
            if self.tok:
                self.need(",")

    def arrow(self, no_in: bool) -> bool:
        at = self.i
        is_async = self.tok == "async" and not self.nl[self.i + 1] and (self.bracket(1) == "(" or self.is_name(1) and self.peek(2) == "=>" or self.ts and self.peek() == "<")
        n = 1 if is_async else 0
        if self.is_name(n) and self.peek(n + 1) == "=>" and not self.nl[self.i + n + 1]:
            self.i += n + 1
        elif self.can("(", "P", n) and (self.peek(n + 1) == "=>" and not self.nl[self.i + n + 1] or self.ts and self.peek(n + 1) == ":"):
            flags = self.flags

            def head() -> None:
                self.i += n
                self.flags |= self.group("(", "P", keep=False) & _OF_ARROWS
                self.type_note()
                if self.tok != "=>" or self.nl[self.i]:
                    raise Bad("=> expected")

            if not self.attempt(head):
                self.i, self.flags = at, flags
                return False
        elif self.ts and self.peek(n) == "<" if n else self.ts and self.tok == "<":
            def generic() -> None:
                self.i += n
                self.type_params()
                self.group("(", "P", keep=False)
                self.type_note()
                if self.tok != "=>":
                    raise Bad("=> expected")

            saved = self.t
            if not self.attempt(generic):
                self.t = saved
                return False
        else:
            return False
        self.need("=>")
        if self.bracket() == "{":
            self.flags |= self.body(is_async, False) & _OF_ARROWS
            return True
        before, self.flags = self.flags, 0
        self.assign(no_in)
        if self.flags & AWAIT and not is_async or self.flags & YIELD:
            raise Bad("await outside of async")
        self.flags = before | self.flags & _OF_ARROWS
        return True

    def body(self, is_async: bool, generator: bool) -> int:
        f = self.group("{", "B", keep=False)
        if f & AWAIT and not is_async or f & YIELD and not generator or f & (BREAK | CONTINUE):
            raise Bad("misplaced statement in a body")
        return f

    def conditional(self, no_in: bool) -> str:
        kind = self.binary(no_in)
        while self.tok == "?":
            self.i += 1
            at, flags = self.i, self.flags
            saved = self.t
            try:
                self.assign()
                self.need(":")
            except Bad:
                if not self.ts:
                    raise
                # the colon was taken for the type of an arrow function
                self.t, self.i, self.flags = saved, at, flags
                self.conditional(False)
                self.need(":")
            kind = "value"
            if self.tok == "yield" or self.pattern("=") or self.arrow(no_in):
                # after a pattern its value follows; nothing of these is a condition
                if self.eat("=") or self.tok == "yield":
                    self.assign(no_in)
                return kind
            # a further condition is read by the next round
            inner = self.binary(no_in)
            if self.tok in _ASSIGN:
                if inner != "ref":
                    raise Bad("target expected")
                self.i += 1
                self.assign(no_in)
                return kind
        return kind

    def binary(self, no_in: bool) -> str:
        kind = self.unary()
        mixed = set()
        while True:
            x = self.tok
            if x in ("??", "||", "&&"):
                mixed.add(x == "??")
                if len(mixed) > 1:
                    raise Bad("?? beside || or &&")
            elif x == "**" and kind == "unary":
                raise Bad("power of a sign")
            if x == ">" and self.peek() == ">":
                while self.tok == ">":
                    self.i += 1
                kind = "unary" if self.unary() == "unary" else "value"
            elif x in _BINARY and not (no_in and x == "in"):
                self.i += 1
                kind = "unary" if self.unary() == "unary" else "value"
            elif x == ">=":
                self.i += 1
                kind = "unary" if self.unary() == "unary" else "value"
            elif self.ts and x in ("as", "satisfies") and not self.nl[self.i]:
                self.i += 1
                if self.tok == "const":
                    self.i += 1
                else:
                    self.type_()
                kind = "ref" if kind == "ref" else "value"
            else:
                return kind

    def unary(self) -> str:
        x, signs = self.tok, False
        while x in _UNARY and x not in ("++", "--") or x == "await":
            if x == "await":
                self.flags |= AWAIT
            self.i += 1
            x, signs = self.tok, True
        if signs:
            self.unary()
            return "unary"
        if x in ("++", "--"):
            self.i += 1
            if self.unary() != "ref":
                raise Bad("target expected")
            return "value"
        if self.ts and x == "<":
            self.type_args()
            self.unary()
            return "value"
        if x == "#a" and self.peek() == "in":
            self.i += 1
            return "value"
        kind = self.postfix()
        if self.tok in ("++", "--") and not self.nl[self.i]:
            if kind != "ref":
                raise Bad("target expected")
            self.i += 1
            return "value"
        return kind

    def template(self, role: str = "E") -> None:
        self.need("`")
        while self.tok == "\x01":
            self.i += 1
            if self.bracket() == "[":
                self.group("[", "E")
            else:
                self.group("(", role)

    def postfix(self) -> str:
        kind = self.primary()
        while True:
            x = self.tok
            if x == ".":
                self.i += 1
                if self.tok in ("#a", "#"):
                    self.key()
                else:
                    self.word()
                kind = "ref"
            elif x == "?.":
                self.i += 1
                b = self.bracket()
                if b == "(":
                    self.group("(", "G")
                elif b == "[":
                    self.group("[", "X")
                elif self.tok == "`":
                    raise Bad("template in a chain")
                elif self.tok in ("#a", "#"):
                    self.key()
                else:
                    self.word()
                kind = "value"
            elif x == "`":
                self.template()
                kind = "value"
            elif self.bracket() == "(":
                self.group("(", "G")
                kind = "value"
            elif self.bracket() == "[":
                self.group("[", "X")
                kind = "ref"
            elif self.ts and x == "!" and not self.nl[self.i]:
                self.i += 1
            elif self.ts and x in ("<", "<<"):
                def call() -> None:
                    self.type_args()
                    if not (self.bracket() == "(" or self.tok in ("`", ")", ",", ";", "", ":", ".") or self.nl[self.i]):
                        raise Bad("no type arguments")

                saved = self.t
                if not self.attempt(call):
                    self.t = saved
                    return kind
                kind = "value"
            else:
                return kind

    def primary(self) -> str:
        x = self.tok
        b = self.bracket()
        if b == "(":
            g = GROUPS.roles[x][1]
            self.group("(", "E")
            return "ref" if g.get("ref") == 0 else "value"
        if b == "[":
            self.group("[", "E")
            return "value"
        if b == "{":
            self.group("{", "O")
            return "value"
        if x in ("0", "'", "\x02", "this", "null", "true", "false"):
            self.i += 1
            return "value"
        if x == "`":
            self.template()
            return "value"
        if x == "function" or x == "async" and self.peek() == "function" and not self.nl[self.i + 1]:
            self.function(named=False)
            return "value"
        if x == "class":
            self.class_(named=False)
            return "value"
        if x == "@":
            while self.eat("@"):
                self.decorator()
            self.class_(named=False)
            return "value"
        if x == "new":
            self.i += 1
            if self.eat("."):
                self.flags |= TARGET
                self.word()
                return "value"
            self.callee()
            if self.ts and self.tok == "<":
                self.type_args()
            if self.bracket() == "(":
                self.group("(", "G")
            return "value"
        if x == "super":
            self.i += 1
            self.flags |= SUPER
            if self.bracket() not in ("(", "[") and self.tok != ".":
                raise Bad("super alone")
            return "value"
        if x == "import":
            self.i += 1
            if self.eat("."):
                self.word()
                return "value"
            self.group("(", "G")
            return "value"
        self.name()
        return "ref"

    def callee(self) -> None:
        if self.tok == "new":
            self.primary()
        else:
            if self.tok == "import":
                raise Bad("import as constructor")
            self.primary()
        while True:
            if self.eat("."):
                if self.tok in ("#a", "#"):
                    self.key()
                else:
                    self.word()
            elif self.bracket() == "[":
                self.group("[", "X")
            elif self.tok == "`":
                self.template()
            elif self.ts and self.tok == "!":
                self.i += 1
            else:
                return

    def elements(self, holes: bool) -> None:
        while self.tok:
            if holes and self.eat(","):
                continue
            self.eat("...")
            self.assign()
            if self.tok:
                self.need(",")

    def object_(self) -> None:
        while self.tok:
            if self.eat("..."):
                self.assign()
            elif self.is_name() and self.peek() in (",", ""):
                self.i += 1
            else:
                is_async, generator, accessor = self.method_head()
                self.key()
                if self.tok == ":" and not (is_async or generator or accessor):
                    self.i += 1
                    self.assign()
                else:
                    self.signature_and_body(is_async, generator, must=True, method=True)
            if self.tok:
                self.need(",")

    def method_head(self) -> tuple[bool, bool, bool]:
        key_next = lambda n: self.is_word(n) or self.peek(n) in ("'", "0", "#a", "#") or self.bracket(n) == "["
        is_async = generator = accessor = False
        if self.tok == "async" and (key_next(1) or self.peek() == "*") and not self.nl[self.i + 1]:
            self.i += 1
            is_async = True
        if self.eat("*"):
            generator = True
        elif not is_async and self.tok in ("get", "set") and key_next(1):
            self.i += 1
            accessor = True
        return is_async, generator, accessor

    def signature_and_body(self, is_async: bool, generator: bool, must: bool, method: bool = False) -> bool:
        """Whether there is a body."""
        self.type_params()
        f = self.group("(", "P", keep=False)
        self.type_note()
        has_body = self.bracket() == "{"
        if has_body:
            f |= self.body(is_async, generator)
        elif must or not self.ts:
            raise Bad("body expected")
        else:
            self.semicolon()
        if f & _OF_METHODS and not method:
            raise Bad("super outside of a method")
        self.flags |= f & _OF_BODIES
        return has_body

    def function(self, named: bool) -> None:
        is_async = self.eat("async")
        self.need("function")
        generator = self.eat("*")
        if self.is_name() or self.tok in ("await", "yield") and not named:
            self.i += 1
        elif named:
            raise Bad("name expected")
        self.signature_and_body(is_async, generator, must=not named)

    def heritage(self) -> None:
        if self.eat("extends"):
            self.postfix()
            if self.ts and self.tok == "<":
                self.type_args()
        if self.ts and self.eat("implements"):
            self.type_operator()
            while self.eat(","):
                self.type_operator()

    def class_(self, named: bool) -> None:
        if self.ts:
            self.eat("abstract")
        self.need("class")
        if self.is_name() and self.tok != "implements":
            self.i += 1
        elif named:
            raise Bad("name expected")
        self.type_params()
        self.heritage()
        f = self.group("{", "C", keep=False)
        if f & WITH:
            raise Bad("with in a class")
        self.flags |= f & ~(SUPER | TARGET)

    def decorator(self) -> None:
        if self.bracket() == "(":
            self.group("(", "E")
            return
        self.word()
        while self.eat("."):
            self.word()
        if self.ts and self.tok == "<":
            self.type_args()
        if self.bracket() == "(":
            self.group("(", "G")

    def class_body(self) -> None:
        key_next = lambda n: self.is_word(n) or self.peek(n) in ("'", "0", "#a", "#", "*") or self.bracket(n) in ("[", "{")
        constructors = 0
        while self.tok:
            if self.eat(";"):
                continue
            while self.eat("@"):
                self.decorator()
            if self.tok == "static" and self.bracket(1) == "{":
                self.i += 1
                if self.group("{", "B", keep=False) & (WITH | RETURN | AWAIT | YIELD | BREAK | CONTINUE):
                    raise Bad("misplaced statement in a static block")
                continue
            static = False
            words = _MODIFIERS if self.ts else ("static", "accessor")
            while self.tok in words and key_next(1) and not (self.nl[self.i + 1] and self.tok not in ("static", "public", "private", "protected", "abstract")):
                if self.bracket(1) == "{":
                    break
                static |= self.tok == "static"
                self.i += 1
            if self.ts and self.can("[", "I") and self.peek() == ":":
                self.i += 1
                self.type_note()
                self.semicolon()
                continue
            is_async, generator, accessor = self.method_head()
            makes = self.tok == "constructor" and not static
            self.key()
            if self.ts:
                self.eat("?") or self.eat("!")
            if self.bracket() == "(" or self.ts and self.tok == "<":
                has_body = self.signature_and_body(is_async, generator, must=not self.ts, method=True)
                constructors += makes and has_body
                if makes and (is_async or generator or accessor) or constructors > 1:
                    raise Bad("one plain constructor expected")
            else:
                if is_async or generator or accessor:
                    raise Bad("method expected")
                self.type_note()
                if self.eat("="):
                    self.assign()
                self.semicolon()

    # TypeScript members
    def type_members(self) -> None:
        while self.tok:
            if self.tok in (",", ";"):
                self.i += 1
                continue
            while self.tok in ("+", "-") and self.peek() == "readonly" or self.tok == "readonly" and (self.is_word(1) or self.peek() in ("'", "0") or self.bracket(1) == "["):
                self.i += 2 if self.tok in ("+", "-") else 1
            if self.tok == "new" and (self.bracket(1) == "(" or self.peek() == "<"):
                self.i += 1
            elif self.bracket() == "(" or self.tok == "<":
                pass
            elif self.can("[", "I"):
                self.i += 1
            else:
                if self.tok in ("get", "set") and (self.is_word(1) or self.peek() == "'"):
                    self.i += 1
                self.key()
            if self.tok in ("+", "-") and self.peek() == "?":
                self.i += 1
            self.eat("?")
            if self.tok == "<" or self.bracket() == "(":
                self.type_params()
                self.group("(", "P")
            self.type_note()
            if self.tok and not self.nl[self.i] and self.tok not in (",", ";"):
                raise Bad("separator expected")

    def enum_members(self) -> None:
        while self.tok:
            self.key()
            if self.eat("="):
                self.assign()
            if self.tok:
                self.need(",")

    def tuple_(self) -> None:
        while self.tok:
            self.eat("...")
            if self.is_word() and (self.peek() == ":" or self.peek() == "?" and self.peek(2) == ":"):
                self.i += 1
                self.eat("?")
                self.need(":")
            self.type_()
            self.eat("?")
            if self.tok:
                self.need(",")

    def index_signature(self) -> None:
        self.name()
        if self.eat(":"):
            self.type_()
        else:
            self.need("in")
            self.type_()
            if self.eat("as"):
                self.type_()
        self.done()

    # modules
    def specifiers(self) -> None:
        while self.tok:
            if self.ts and self.tok == "type" and (self.is_word(1) or self.peek() == "'") and self.peek() != "as":
                self.i += 1
            if not self.eat("'"):
                self.word()
            if self.eat("as"):
                if not self.eat("'"):
                    self.word()
            if self.tok:
                self.need(",")

    def source(self) -> None:
        self.need("from")
        self.need("'")
        if self.tok in ("with", "assert") and self.bracket(1) == "{":
            self.i += 1
            self.group("{", "O")
        self.semicolon()

    def import_(self) -> None:
        self.need("import")
        if self.eat("'"):
            if self.tok == "with":
                self.i += 1
                self.group("{", "O")
            self.semicolon()
            return
        if self.ts and self.tok == "type" and (self.bracket(1) == "{" or self.peek() == "*" or self.is_name(1) and (self.peek() != "from" or self.peek(2) == "from")):
            self.i += 1
        if self.is_name():
            self.i += 1
            if self.ts and self.eat("="):
                self.expression()
                self.semicolon()
                return
            if not self.eat(","):
                self.source()
                return
        if self.eat("*"):
            self.need("as")
            self.name()
        else:
            self.group("{", "M")
        self.source()

    def export(self) -> None:
        self.need("export")
        if self.eat("*"):
            if self.eat("as"):
                if not self.eat("'"):
                    self.word()
            self.source()
        elif self.bracket() == "{" or self.ts and self.tok == "type" and (self.bracket(1) == "{" or self.peek() == "*"):
            if self.tok == "type":
                self.i += 1
            if self.eat("*"):
                if self.eat("as"):
                    self.word()
                self.source()
                return
            self.group("{", "M")
            if self.tok == "from":
                self.source()
            else:
                self.semicolon()
        elif self.eat("default"):
            if self.tok == "function" or self.tok == "async" and self.peek() == "function" and not self.nl[self.i + 1]:
                is_async = self.eat("async")
                self.need("function")
                generator = self.eat("*")
                if self.is_name():
                    self.i += 1
                self.signature_and_body(is_async, generator, must=not self.ts)
            elif self.tok in ("class", "@") or self.ts and self.tok == "abstract" and self.peek() == "class":
                while self.eat("@"):
                    self.decorator()
                self.class_(named=False)
            elif self.ts and self.tok == "interface" and self.is_name(1):
                self.statement(False)
            else:
                self.assign()
                self.semicolon()
        elif self.ts and self.eat("="):
            self.expression()
            self.semicolon()
        elif self.ts and self.tok == "as" and self.peek() == "namespace":
            self.i += 2
            self.name()
            self.semicolon()
        elif self.ts and self.tok == "import":
            self.import_()
        else:
            if not (self.tok in ("var", "const", "let", "function", "class", "async", "@") or self.ts and self.tok in ("interface", "type", "enum", "namespace", "module", "declare", "abstract")):
                raise Bad("declaration expected")
            if self.tok == "async" and self.peek() != "function":
                raise Bad("declaration expected")
            self.statement(False)

    # statements
    def statements(self, module: bool = False) -> None:
        while self.tok:
            self.statement(module)

    def declarations(self, kind: str, no_in: bool = False) -> bool:
        """Whether all have what their kind asks for."""
        ok = True
        while True:
            pattern = self.bracket() in ("[", "{")
            self.binding()
            if self.ts:
                self.eat("!")
                self.type_note()
            if self.eat("="):
                self.assign(no_in)
            elif pattern or kind == "const":
                ok = False
            if not self.eat(","):
                return ok

    def loop_body(self) -> None:
        before, self.flags = self.flags, 0
        if self.tok == "function" or self.tok == "async" and self.peek() == "function" and not self.nl[self.i + 1]:
            raise Bad("declaration in place of a statement")
        self.statement(False, declare=False)
        self.flags = before | self.flags & ~(BREAK | CONTINUE)

    def statement(self, module: bool, declare: bool = True) -> None:
        x = self.tok
        if x == ";":
            self.i += 1
        elif self.bracket() == "{" and self.can("{", "B"):
            self.group("{", "B")
        elif x in ("var", "const") or x == "let" and (self.is_name(1) or self.bracket(1) in ("[", "{")):
            if not declare and x != "var":
                raise Bad("declaration in place of a statement")
            if x == "const" and self.peek() == "enum" and self.ts:
                self.i += 1
                self.statement(module)
                return
            self.i += 1
            if not self.declarations(x) and not getattr(self, "ambient", False):
                raise Bad("initializer expected")
            self.semicolon()
        elif x == "function" or x == "async" and self.peek() == "function" and not self.nl[self.i + 1]:
            self.function(named=True)
        elif x == "class" or x == "@" or self.ts and x == "abstract" and self.peek() == "class":
            if not declare:
                raise Bad("declaration in place of a statement")
            while self.eat("@"):
                self.decorator()
            if self.tok == "export":
                self.export()
            else:
                self.class_(named=True)
        elif x == "if":
            while True:
                self.i += 1
                self.group("(", "E")
                self.statement(False, declare=False)
                if not self.eat("else"):
                    break
                if self.tok != "if":
                    self.statement(False, declare=False)
                    break
        elif x == "for":
            self.i += 1
            if self.eat("await"):
                self.flags |= AWAIT
            self.group("(", "F")
            self.loop_body()
        elif x == "while":
            self.i += 1
            self.group("(", "E")
            self.loop_body()
        elif x == "do":
            self.i += 1
            self.loop_body()
            self.need("while")
            self.group("(", "E")
            self.eat(";")
        elif x in ("break", "continue"):
            self.i += 1
            if self.is_name() and not self.nl[self.i]:
                self.i += 1
            else:
                self.flags |= BREAK if x == "break" else CONTINUE
            self.semicolon()
        elif x == "return":
            self.i += 1
            self.flags |= RETURN
            if self.tok and self.tok != ";" and not self.nl[self.i]:
                self.expression()
            self.semicolon()
        elif x == "throw":
            self.i += 1
            if not self.tok or self.nl[self.i]:
                raise Bad("expression expected")
            self.expression()
            self.semicolon()
        elif x == "try":
            self.i += 1
            self.group("{", "B")
            caught = self.eat("catch")
            if caught:
                if self.bracket() == "(":
                    self.group("(", "K")
                self.group("{", "B")
            if self.eat("finally"):
                self.group("{", "B")
            elif not caught:
                raise Bad("catch expected")
        elif x == "switch":
            self.i += 1
            self.group("(", "E")
            before, self.flags = self.flags, 0
            self.group("{", "W")
            self.flags = before | self.flags & ~BREAK
        elif x == "with":
            self.i += 1
            self.flags |= WITH
            self.group("(", "E")
            self.statement(False, declare=False)
        elif x == "debugger":
            self.i += 1
            self.semicolon()
        elif x == "import" and self.bracket(1) != "(" and self.peek() != ".":
            if not module:
                raise Bad("import in a block")
            self.flags |= MODULE
            self.import_()
        elif x == "export":
            if not module:
                raise Bad("export in a block")
            self.flags |= MODULE
            self.export()
        elif self.is_name() and self.peek() == ":":
            self.i += 2
            self.statement(False, declare=declare)
        elif self.ts and self.ts_statement(module):
            pass
        else:
            self.expression()
            self.semicolon()

    def ts_statement(self, module: bool) -> bool:
        x = self.tok
        if x == "interface" and self.is_name(1) and not self.nl[self.i + 1]:
            self.i += 2
            self.type_params()
            if self.eat("extends"):
                self.type_operator()
                while self.eat(","):
                    self.type_operator()
            self.group("{", "T")
        elif x == "type" and self.is_name(1) and not self.nl[self.i + 1] and self.peek(2) in ("=", "<"):
            self.i += 2
            self.type_params()
            self.need("=")
            self.type_()
            self.semicolon()
        elif x == "enum":
            self.i += 1
            self.name()
            self.group("{", "N")
        elif x in ("namespace", "module") and (self.is_name(1) or self.peek() == "'") and not self.nl[self.i + 1] or x == "global" and self.bracket(1) == "{":
            self.i += 1
            if x != "global" and not self.eat("'"):
                self.name()
                while self.eat("."):
                    self.word()
            if self.bracket() == "{":
                self.group("{", "S", "B", keep=False)
            else:
                self.semicolon()
        elif x == "declare" and self.is_word(1) and not self.nl[self.i + 1]:
            self.i += 1
            before, self.ambient = getattr(self, "ambient", False), True
            self.statement(module)
            self.ambient = before
        else:
            return False
        return True

    def switch_body(self) -> None:
        while self.tok:
            if self.eat("case"):
                self.expression()
            else:
                self.need("default")
            self.need(":")
            while self.tok and self.tok not in ("case", "default"):
                self.statement(False)

    def for_head(self) -> None:
        if self.tok in ("var", "const") or self.tok == "let" and (self.is_name(1) or self.bracket(1) in ("[", "{")):
            kind = self.tok
            self.i += 1
            at = self.i
            ok = self.declarations(kind, no_in=True)
            if self.tok in ("of", "in"):
                of = self.eat("of")
                here = self.t[at : self.i - of]
                if "," in here or "=" in here and (of or kind != "var" or here[0] != "a"):
                    raise Bad("one name without a value expected")
                if not of:
                    self.i += 1
                self.assign() if of else self.expression()
                self.done()
                return
            if not ok:
                raise Bad("initializer expected")
        elif self.tok != ";":
            def each() -> None:
                if not self.pattern("of", "in") and self.postfix() != "ref" or self.tok not in ("of", "in"):
                    raise Bad("target expected")

            if self.attempt(each):
                of = self.eat("of")
                if not of:
                    self.i += 1
                self.assign() if of else self.expression()
                self.done()
                return
            self.expression(no_in=True)
        self.need(";")
        if self.tok != ";":
            self.expression()
        self.need(";")
        if self.tok:
            self.expression()
        self.done()

    def catch_param(self) -> None:
        self.binding()
        self.type_note()
        self.done()

    def reference(self) -> None:
        """A parenthesised target of an assignment."""
        if self.conditional(False) != "ref":
            raise Bad("target expected")
        self.done()

    def all_(self, f, *args) -> None:
        f(*args)
        self.done()


#: For each bracket, the roles of its content and the rule that reads it; the flag says if only in TypeScript.
ROLES = {
    "(": [("E", lambda r: r.all_(r.expression), False), ("ref", lambda r: r.reference(), False), ("G", lambda r: r.elements(False), False), ("P", lambda r: r.params(), False), ("F", lambda r: r.for_head(), False), ("K", lambda r: r.catch_param(), False), ("T", lambda r: r.all_(r.type_), True)],
    "[": [("E", lambda r: r.elements(True), False), ("P", lambda r: r.array_pattern(), False), ("A", lambda r: r.array_targets(), False), ("X", lambda r: r.all_(r.expression), False), ("C", lambda r: r.all_(r.assign), False), ("T", lambda r: r.tuple_(), True), ("I", lambda r: r.index_signature(), True)],
    "{": [("B", lambda r: r.statements(), False), ("O", lambda r: r.object_(), False), ("P", lambda r: r.object_pattern(), False), ("A", lambda r: r.object_targets(), False), ("C", lambda r: r.class_body(), False), ("W", lambda r: r.switch_body(), False), ("M", lambda r: r.specifiers(), False), ("T", lambda r: r.type_members(), True), ("N", lambda r: r.enum_members(), True), ("S", lambda r: r.statements(True), True)],
}


#: Line ends before a word that no expression goes on with.
_NEXT = re.compile(r"\n(?=(?:const|var|if|for|while|return|try|switch|throw|break|continue|debugger)\b)")


@lru_cache(maxsize=100_000)
def _piece_flags(flat: str, ts: bool) -> int:
    """Flags of statements, -1 if they are none."""
    try:
        r = Reader(tokenise(flat), ts)
        r.statements()
        return r.flags
    except (Bad, IndexError):
        return -1


def _block_flags(flat: str, ts: bool) -> int | None:
    """Flags of a block whose pieces are all whole statements; None if they have to be read as one."""
    flags = 0
    for piece in _NEXT.split(flat):
        f = _piece_flags(piece.strip(" "), ts)
        if f < 0:
            return None
        flags |= f
    return flags


@lru_cache(maxsize=200_000)
def content_roles(bracket: str, flat: str, ts: bool) -> str:
    """The character that stands for a group with this content."""
    roles: dict[str, int] = {}
    tokens = tokenise(flat)
    flags = _block_flags(flat, ts) if bracket == "{" else None
    if flags is not None:
        roles["B"] = flags
        if ts:
            roles["S"] = flags
    for role, rule, only_ts in ROLES[bracket]:
        if role in roles or only_ts and not ts:
            continue
        try:
            r = Reader(tokens, ts)
            rule(r)
            roles[role] = 0 if role == "ref" else r.flags
        except (Bad, IndexError):
            pass
    if not roles:
        raise Bad("nothing that may stand in brackets")
    return GROUPS.char(bracket, roles)


@lru_cache(maxsize=50_000)
def top_flags(flat: str, ts: bool) -> int:
    """Flags of statements that stand in no group, -1 if they are none."""
    try:
        r = Reader(tokenise(flat), ts)
        r.statements(True)
        return -1 if r.flags & (RETURN | YIELD | BREAK | CONTINUE | SUPER | TARGET) else r.flags
    except (Bad, IndexError):
        return -1


#: A list that repeats an item is as valid as one that has it twice; a line end after a comma means nothing.
_REPEATED = re.compile(r"([^,\n]{1,12},)\1{2,}")
_COMMA_LINE = re.compile(r", ?\n ?")
#: A group without brackets in it, or a bracket of another.
_BRACKET = re.compile(r"(\([^()\[\]{}]*\)|\[[^()\[\]{}]*\]|\{[^()\[\]{}]*\}|[()\[\]{}])")
_OPENS = {")": "(", "]": "[", "}": "{"}
_BLANK_EDGE = " \n"
#: Words that mostly begin a statement; one that goes on over a line end before such a word makes its pieces invalid.
STARTERS = r"(?:export|import|function|class|const|interface)\b"
_TOP = re.compile(rf"\n(?={STARTERS})")
_STRICT = re.compile(r"\A(?:#![^\n]*)?(?:\s|//[^\n]*|/\*.*?\*/)*(?:'use strict'|\"use strict\")", re.S)
#: Comments as pages had them, which scripts may hold and modules not.
_PAGE_COMMENT = re.compile(r"<!--|^[ \t]*-->", re.M)


def _grouped(flat: str, ts: bool) -> str:
    """The token classes with one character in place of each group, from the inside out."""
    outer: list[tuple[str, list[str]]] = []
    here: list[str] = []
    parts = _BRACKET.split(flat)
    for i in range(0, len(parts) - 1, 2):
        if parts[i]:
            here.append(parts[i])
        x = parts[i + 1]
        if len(x) > 1:
            content, bracket = x[1:-1], x[0]
        elif x in _OPENS:
            if not outer or outer[-1][0] != _OPENS[x]:
                raise Bad("bracket closed that was not open")
            content = "".join(here)
            bracket, here = outer.pop()
        else:
            outer.append((x, here))
            here = []
            continue
        content = content.strip(" ")
        if len(content) > 40:
            content = _REPEATED.sub(r"\1\1", _COMMA_LINE.sub(",", content))
        here.append(content_roles(bracket, content, ts))
    if outer:
        raise Bad("bracket left open")
    here.append(parts[-1])
    return "".join(here)


def _reads(text: str, ts: bool, jsx: bool, comments: bool = False) -> bool:
    try:
        flat = _grouped(reduce_text(text, jsx), ts)
    except Bad:
        return False
    # pieces that are all whole statements are as valid as the whole, which has to be read only if one of them is none
    parts = _TOP.split(flat)
    found = [top_flags(part.strip(_BLANK_EDGE), ts) for part in parts]
    if -1 in found:
        if len(parts) == 1:
            return False
        found = [top_flags(flat.strip(_BLANK_EDGE), ts)]
        if found[0] == -1:
            return False
    flags = 0
    for f in found:
        flags |= f
    return not (flags & WITH and (flags & MODULE or _STRICT.match(text)) or comments and flags & MODULE)


def valid(text: str, ts: bool, jsx: bool) -> bool:
    """Whether the text is valid JavaScript, or with ``ts`` TypeScript; RecursionError beyond DEEPEST frames."""
    if sys.getrecursionlimit() < DEEPEST:
        sys.setrecursionlimit(DEEPEST)
    return _reads(text, ts, jsx) or _PAGE_COMMENT.search(text) is not None and _reads(_PAGE_COMMENT.sub("//", text), ts, jsx, comments=True)
