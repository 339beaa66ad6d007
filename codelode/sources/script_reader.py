"""Declarations, imports, calls and routes of JavaScript and TypeScript texts.

One lexical pass gives tokens without comments; strings, regular expressions
and templates are tokens, what stands in a template's braces is read like code.
Brackets are matched once with a stack.  One walk over the tokens then finds
the rows; every token is looked at a bounded number of times, so a text takes
time in proportion to its length.  Texts that do not parse give what can be
read of them.
"""

from __future__ import annotations

import re
from bisect import bisect_left

Row = tuple[str, str | None, str | None, str | None, int | None, int | None]
METHODS = frozenset(["get", "post", "put", "delete", "patch", "options", "head"])
APPS = frozenset(["app", "router", "api"])

_TOKEN = re.compile(
    r"""(?P<c>//[^\n]*|/\*.*?(?:\*/|\Z))"""
    r"""|(?P<s>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')"""
    r"""|(?P<w>\#?[A-Za-z_$ª-ￜ][\w$]*)"""
    r"""|(?P<n>\.?[0-9][\w.]*)"""
    r"""|(?P<p>=>|\?\.(?![0-9])|\.\.\.|[^\s\w])""",
    re.S,
)
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*")
_PAIR = {")": "(", "]": "[", "}": "{"}
#: After these an operand comes, so a slash begins a regular expression.
_BEFORE_OPERAND = frozenset(["return", "typeof", "case", "do", "else", "in", "instanceof", "new", "void", "delete", "throw", "yield", "await", "of"])
#: Words before a parenthesis that is no call.
_NO_CALL = frozenset(["if", "for", "while", "switch", "catch", "function", "return", "with", "constructor", "super", "typeof", "await", "async", "import", "void", "delete", "throw", "new", "in", "of", "yield", "case", "do", "else", "instanceof"])
#: Words that stand in no type.
_NO_TYPE = frozenset(["const", "let", "var", "function", "class", "interface", "return", "if", "for", "while", "switch", "throw", "export"])
#: Words that stand in no expression.
_NO_VALUE = _NO_TYPE - {"function", "class", "interface"}
#: Words that may stand before the name of a member.
_MODIFIERS = frozenset(["static", "async", "get", "set", "public", "private", "protected", "readonly", "abstract", "override", "declare", "*"])
#: What a function or class follows where it is a declaration.
_STARTS = frozenset(["", ";", "{", "}", ")", "export", "default", "declare", "abstract", "async", "else", "do"])
#: Punctuation after which a type goes on, so a brace belongs to it.
_IN_TYPE = frozenset([":", "|", "&", "<", ",", "=>", "extends", "is", "keyof", "?", "="])


class Tokens:
    """Texts, kinds and places of the tokens, with the partner of each bracket."""

    def __init__(self, text: str):
        self.text: list[str] = []
        self.kind: list[str] = []
        self.at: list[int] = []
        self.ends = [m.start() for m in re.finditer("\n", text)]
        self._read(text)
        self.pair = self._match()

    def _add(self, text: str, kind: str, at: int) -> None:
        self.text.append(text)
        self.kind.append(kind)
        self.at.append(at)

    def _read(self, text: str) -> None:
        i = 0
        # for each open template the depth of braces in its substitution
        inside: list[int] = []
        while i < len(text):
            m = _TOKEN.search(text, i)
            if not m:
                return
            kind, x, start = m.lastgroup, m[0], m.start()
            i = m.end()
            if kind == "c":
                continue
            if x == "`":
                i = self._template(text, start + 1, start, inside)
            elif x == "/" and self._operand_next():
                r = _REGEX.match(text, start)
                i = r.end() if r else i
                self._add(x, "r" if r else "p", start)
            elif x == "}" and inside and inside[-1] == 0:
                inside.pop()
                i = self._template(text, i, start, inside)
            else:
                if inside and x in "{}":
                    inside[-1] += 1 if x == "{" else -1
                self._add(x, kind, start)

    def _template(self, text: str, i: int, start: int, inside: list[int]) -> int:
        """A piece of a template from ``i`` on, up to its end or the next substitution."""
        end = _TEMPLATE.match(text, i).end()
        self._add(text[i:end], "t", start)
        if text.startswith("${", end):
            inside.append(0)
            # what a piece with a substitution says is not known
            self.kind[-1] = "T"
            return end + 2
        return end + 1

    def _operand_next(self) -> bool:
        if not self.text:
            return True
        x, k = self.text[-1], self.kind[-1]
        return x in _BEFORE_OPERAND if k == "w" else k == "p" and x not in (")", "]")

    def _match(self) -> list[int]:
        """Partners of brackets, and of angles that close within the brackets and the statement in which they open."""
        pair, open_ = [-1] * len(self.text), []
        count = dict.fromkeys("([{<", 0)
        for i, (x, k) in enumerate(zip(self.text, self.kind)):
            if k != "p":
                continue
            if x in count:
                open_.append(i)
                count[x] += 1
            elif x in _PAIR and count[_PAIR[x]]:
                # what is left open within is passed over
                while self.text[open_[-1]] != _PAIR[x]:
                    count[self.text[open_.pop()]] -= 1
                count[_PAIR[x]] -= 1
                pair[open_[-1]] = i
                pair[i] = open_.pop()
            elif x == ">" and open_ and self.text[open_[-1]] == "<":
                count["<"] -= 1
                pair[open_[-1]] = i
                pair[i] = open_.pop()
            elif x == ";":
                while open_ and self.text[open_[-1]] == "<":
                    open_.pop()
                    count["<"] -= 1
        return pair

    def line(self, i: int) -> int:
        return bisect_left(self.ends, self.at[i]) + 1

    def __len__(self) -> int:
        return len(self.text)


class Reader:
    def __init__(self, text: str):
        self.t = Tokens(text)
        self.rows: list[Row] = []
        #: Tokens that name what they declare, and so call nothing.
        self.names: set[int] = set()

    def tok(self, i: int) -> str:
        return self.t.text[i] if 0 <= i < len(self.t) and self.t.kind[i] in "wp" else ""

    def is_word(self, i: int) -> bool:
        return 0 <= i < len(self.t) and self.t.kind[i] == "w"

    def close(self, i: int) -> int:
        """The partner of an opening bracket; the last token if it has none."""
        return self.t.pair[i] if self.t.pair[i] >= 0 else len(self.t) - 1

    def skip_angles(self, i: int) -> int:
        """The token after a list of type parameters that begins at ``i``; ``i`` if it is none."""
        return self.t.pair[i] + 1 if self.tok(i) == "<" and self.t.pair[i] >= 0 else i

    def skip_type(self, i: int, *ends: str) -> int:
        """The token at which the type that follows a colon at ``i`` ends: one of ``ends``, or what cannot go on with it."""
        k = i + 1
        while k < len(self.t):
            x = self.tok(k)
            if x in ends and x and not (x == "{" and self.tok(k - 1) in _IN_TYPE):
                return k
            if x in (")", "]", "}", ";") or x in _NO_TYPE:
                return k
            # a word on a new line goes on only after an operator
            if k > i + 1 and self.t.kind[k] == "w" and self.t.line(k) > self.t.line(k - 1) and (self.t.kind[k - 1] != "p" or self.tok(k - 1) in (")", "]", "}", ">")):
                return k
            k = self.close(k) + 1 if x in ("(", "[", "{") and x else max(self.skip_angles(k), k + 1)
        return k

    def body(self, i: int) -> int:
        """The brace of the body after the parameters that begin at ``i``; -1 if there is none."""
        if self.tok(i) != "(" or self.t.pair[i] < 0:
            return -1
        k = self.t.pair[i] + 1
        if self.tok(k) == ":":
            k = self.skip_type(k, "{")
        return k if self.tok(k) == "{" else -1

    def statement(self, i: int) -> bool:
        """Whether a word stands where a declaration may begin."""
        k = i - 1
        while self.tok(k) in ("async", "abstract", "declare", "export", "default"):
            k -= 1
        if k < 0:
            return True
        x = self.tok(k)
        return x in _STARTS and x != "" or self.t.line(k) < self.t.line(i) and (self.t.kind[k] != "p" or x in (")", "]", "}"))

    def symbol(self, name: int, kind: str, owner: str | None, end: int) -> None:
        self.names.add(name)
        self.rows.append(("symbol", self.t.text[name], kind, owner, self.t.line(name), self.t.line(min(end, len(self.t) - 1))))

    def read(self) -> list[Row]:
        t = self.t
        around: list[tuple[int, str]] = []
        for i in range(len(t)):
            while around and i > around[-1][0]:
                around.pop()
            if t.kind[i] == "w":
                x = t.text[i]
                if x == "function" and self.statement(i):
                    self.function(i, around)
                elif x == "class" and self.is_word(i + 1) and self.statement(i) and self.tok(i - 1) != ".":
                    self.class_(i)
                elif x == "interface" and self.is_word(i + 1) and self.statement(i):
                    k = self.heritage(i + 2)
                    if k >= 0:
                        self.symbol(i + 1, "interface", None, self.close(k))
                        self.interface(k)
                elif x in ("const", "let", "var"):
                    self.declarations(i)
                elif x == "import" and self.tok(i + 1) not in ("(", ".") and self.statement(i):
                    self.import_(i)
                elif x in APPS and self.tok(i + 1) == "." and self.tok(i - 1) != "." and self.tok(i + 2) in METHODS and self.tok(i + 3) == "(":
                    self.route(i)
            elif t.kind[i] == "p" and t.text[i] == "(":
                self.call(i, around[-1][1] if around else None)
        return self.rows

    def function(self, i: int, around: list[tuple[int, str]]) -> None:
        name = i + 2 if self.tok(i + 1) == "*" else i + 1
        if not self.is_word(name):
            return
        b = self.body(self.skip_angles(name + 1))
        if b >= 0:
            self.symbol(name, "function", None, self.close(b))
            around.append((self.close(b), self.t.text[name]))
        else:
            self.names.add(name)

    def heritage(self, i: int) -> int:
        """The brace of a body after a name and what it extends; -1 if there is none."""
        k = i
        while k < len(self.t):
            x = self.tok(k)
            if x == "{":
                return k
            if x in (";", ")", "}", "=") or x in _NO_TYPE:
                return -1
            k = self.close(k) + 1 if x in ("(", "[") and x else max(self.skip_angles(k), k + 1)
        return -1

    def member(self, n: int) -> bool:
        """Whether a word names a member of a class, an interface or an object; such a word calls nothing."""
        k = n - 1
        while self.tok(k) in _MODIFIERS:
            k -= 1
        x = self.tok(k)
        # after a decorator or a field without semicolon a member begins its own line
        found = x in ("{", ";", "}") or self.t.line(max(k, 0)) < self.t.line(n) and (self.t.kind[k] != "p" or x in (")", "]", ">"))
        if found:
            self.names.add(n)
        return found

    def interface(self, b: int) -> None:
        """Mark the methods in the body that begins at ``b`` as names."""
        end, k = self.close(b), b + 1
        while k < end:
            x = self.tok(k)
            if x == "(" and self.is_word(k - 1) and (self.tok(k - 2) in ("{", ";", ",", "}", "get", "set") or self.t.line(k - 2) < self.t.line(k - 1)):
                self.names.add(k - 1)
            if x in ("(", "[", "{") and x:
                k = self.close(k)
            k += 1

    def class_(self, i: int) -> None:
        b = self.heritage(i + 2)
        if b < 0:
            return
        end = self.close(b)
        owner = self.t.text[i + 1]
        self.symbol(i + 1, "class", None, end)
        k = b + 1
        while k < end:
            x = self.tok(k)
            if x == "(":
                n = k - 1
                if self.tok(n) == ">" and self.t.pair[n] >= 0:
                    # type parameters between the name and its parentheses
                    n = self.t.pair[n] - 1
                m = self.body(k) if self.is_word(n) and self.member(n) else -1
                if m >= 0:
                    self.symbol(n, "method", owner, self.close(m))
                    k = self.close(m)
                else:
                    k = self.close(k)
            elif x in ("{", "[") and x:
                k = self.close(k)
            k += 1

    def declarations(self, i: int) -> None:
        """Arrow functions and required modules among the declared names."""
        k = i + 1
        while k < len(self.t):
            start = k
            if self.tok(k) in ("{", "["):
                names = [self.t.text[j] for j in range(k + 1, self.close(k)) if self.is_word(j) and self.tok(j - 1) in ("{", ",", "[", "...")]
                k = self.close(k) + 1
            elif self.is_word(k):
                names = [self.t.text[k]]
                k += 1
            else:
                return
            if self.tok(k) == ":":
                k = self.skip_type(k, "=", ",")
            if self.tok(k) != "=":
                if self.tok(k) != ",":
                    return
                k += 1
                continue
            v = k + 1
            if self.tok(v) == "require" and self.tok(v + 1) == "(" and v + 3 < len(self.t) and self.t.kind[v + 2] == "s" and self.tok(v + 3) == ")":
                self.names.add(v)
                self.rows.append(("import", self.t.text[v + 2][1:-1], ",".join(names), None, self.t.line(i), None))
            elif self.is_word(start):
                a = self.arrow(v)
                if a >= 0:
                    end = self.close(a) if self.tok(a) == "{" else self.expression_end(a)
                    self.symbol(start, "arrow_function", None, end)
            k = self.expression_end(v) + 1
            if self.tok(k) != ",":
                return
            k += 1

    def arrow(self, v: int) -> int:
        """The first token of the body of an arrow function whose value begins at ``v``; -1 if it is none."""
        if self.tok(v) == "async":
            v += 1
        if self.is_word(v) and self.tok(v + 1) == "=>":
            return v + 2
        v = self.skip_angles(v)
        if self.tok(v) != "(" or self.t.pair[v] < 0:
            return -1
        k = self.t.pair[v] + 1
        if self.tok(k) == ":":
            k = self.skip_type(k, "=>")
        return k + 1 if self.tok(k) == "=>" else -1

    def expression_end(self, i: int) -> int:
        """The last token of the expression that begins at ``i``."""
        k = i
        while k < len(self.t):
            x = self.tok(k)
            if x in (";", ",", ")", "]", "}") or x in _NO_VALUE and self.tok(k - 1) != ".":
                return k - 1
            # a line end ends it where nothing goes on
            if k > i and self.t.line(k) > self.t.line(k - 1) and (self.t.kind[k - 1] != "p" or self.tok(k - 1) in (")", "]", "}")) and (self.t.kind[k] != "p" or x in ("{", "@")):
                return k - 1
            if x in ("(", "[", "{") and x:
                k = self.close(k)
            k += 1
        return len(self.t) - 1

    def import_(self, i: int) -> None:
        names: list[str] = []
        k = i + 1
        if self.tok(k) == "type" and self.tok(k + 1) not in ("from", ","):
            k += 1
        while k < len(self.t) and self.t.kind[k] != "s":
            x = self.tok(k)
            if x == "{":
                end = self.close(k)
                for j in range(k + 1, end):
                    if self.is_word(j) and (self.tok(j - 1) in ("{", ",") and self.tok(j) != "type" or self.tok(j - 1) == "type"):
                        names.append(self.t.text[j])
                k = end
            elif x == "*":
                k += 2  # as, and a name for the whole
            elif x == ",":
                pass
            elif x == "from" and k + 1 < len(self.t) and self.t.kind[k + 1] == "s":
                pass
            elif self.is_word(k) and x == self.t.text[k]:
                names.append(x)
            else:
                return
            k += 1
        if k < len(self.t):
            self.rows.append(("import", self.t.text[k][1:-1], ",".join(names), None, self.t.line(i), None))

    def call(self, i: int, function: str | None) -> None:
        n = i - 2 if self.tok(i - 1) == "?." else i - 1
        if not self.is_word(n) or n in self.names:
            return
        name, member = self.t.text[n], self.tok(n - 1) in (".", "?.")
        # a word before parentheses and a brace names a method of an object
        method = self.t.pair[i] >= 0 and self.tok(self.t.pair[i] + 1) == "{" or self.tok(n - 1) in ("{", ",") and self.tok(self.close(i) + 1) == ":"
        if not member and (name in _NO_CALL or method):
            return
        # a constructor call is none; its name may be a chain of members
        k = n
        while self.tok(k - 1) in (".", "?.") and self.is_word(k - 2):
            k -= 2
        if self.tok(k - 1) in ("new", "function", "class"):
            return
        self.rows.append(("call", name, None, function, self.t.line(n), None))

    def route(self, i: int) -> None:
        end = self.close(i + 3)
        first = i + 4
        if first >= len(self.t) or self.t.kind[first] not in ("s", "t") or self.tok(first + 1) != ",":
            return
        path = self.t.text[first][1:-1] if self.t.kind[first] == "s" else self.t.text[first]
        handler: list[str] = []
        k = first + 2
        while k < end:
            x = self.tok(k)
            if x == ",":
                handler = []
            else:
                handler.append(self.t.text[k])
                if x in ("(", "[", "{") and x:
                    k = self.close(k)
                    handler.append("")
            k += 1
        text = "".join(handler)
        named = text if re.fullmatch(r"[\w$.]+", text) else None
        self.rows.append(("route", named, f"{self.t.text[i + 2].upper()} {path}", "express", self.t.line(i), None))


def script_rows(text: str) -> list[Row]:
    """Rows of one JavaScript or TypeScript text, in the order of the text.

    ``symbol``: function declarations, arrow functions that a declaration names,
    classes, their methods, interfaces.  ``import``: the names taken from a
    module, by import or require; a name for a whole module is none.  ``call``:
    the name that is called and the function declaration around it.
    """
    return Reader(text).read()
