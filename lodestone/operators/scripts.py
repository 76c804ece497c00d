"""Declarations of script files (TypeScript, JavaScript, JSX) by a scanner, and calls and throws by the scope that they stand in.

A file is one row; a task reads its tokens once, left to right (strings, templates, comments, regular expressions and brackets are told apart, so nothing
inside a string or comment is code), and gives its declarations, the bodies they have and the places where names are used. All
further work, joining uses with imports and with the innermost body around them, is done by Spark on these rows.

What counts: functions, classes with their methods, interfaces, types, enums, exported variables and default exports, wherever a statement may
stand but in bodies of other declarations; functions within bodies are scopes but no symbols. Files without any of these give the names that `module.exports` is set to.
Not modelled: JSX text (an apostrophe there may hide the rest of its line), private methods (left out), automatic semicolons after an operator.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Blanks within a line match nothing, so a search passes over them; the space group begins at a line break.
_TOKEN = re.compile(
    r"""(?P<space>[^\S\ \t]\s*)|(?P<note>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<quoted>'(?:[^'\\\n]|\\[\s\S])*'|"(?:[^"\\\n]|\\[\s\S])*")
    |(?P<word>\#?(?:[^\W\d]|\$)[\w$]*)|(?P<number>\d[\w.]*)|(?P<mark>=>|\.\.\.|\?\.|\?\?=?|[=!]==?|&&|\|\||\+\+|--|[^\ \t])""",
    re.X,
)
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*")
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
#: Words after which an operand stands, so a slash opens a regular expression and a line break ends nothing.
_OPERATORS = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "do", "else", "instanceof", "await", "yield", "extends", "default"}
_TYPE_PREFIXES = {"typeof", "keyof", "readonly", "unique", "infer", "new", "asserts", "abstract"}
_MODIFIERS = {"public", "protected", "private", "static", "async", "readonly", "abstract", "override", "declare", "get", "set", "accessor"}

SCAN = (
    "path string, ext string, symbols array<struct<n:int,name:string,kind:string,signature:string,doc:string,exported:boolean,line:int,near:int>>, around array<struct<above:string,below:string>>, "
    "scopes array<struct<n:int,symbol:int,name:string,start:int,stop:int>>, uses array<struct<word:string,at:int>>, throws array<struct<name:string,at:int>>"
)


class Tokens:
    """Tokens of a text: words, where they stand, their lines, partners of brackets, and the doc comment before a token."""

    def __init__(self, text: str):
        self.source, self.text, self.at, self.line, self.kind, self.mate, self.doc = text, [], [], [], [], [], {}
        opened: list[int] = []
        templates: list[int] = []  # brackets that a template's placeholders opened
        self.pairs: list[tuple[int, int]] = []
        add_text, add_at, add_line, add_kind = self.text.append, self.at.append, self.line.append, self.kind.append
        at, line = 0, 1
        while at < len(text):
            # What the pattern alone doesn't tell, templates and regular expressions, ends a run of its matches.
            for found in _TOKEN.finditer(text, at):
                kind, word, at = found.lastgroup, found[0], found.start()
                if kind == "space":
                    line += word.count("\n")
                    continue
                if kind == "mark":
                    if word == "`" or (word == "}" and opened and templates and opened[-1] == templates[-1]):
                        at, line = self._template(word, at, line, opened, templates)
                        break
                    if word == "/" and self._operand_next() and (literal := _REGEX.match(text, at)):
                        self._add(literal[0], at, line, "quoted")
                        at = literal.end()
                        break
                    if word in _CLOSE:
                        self._close(opened, at, line)
                        continue
                    if word in _OPEN:
                        opened.append(len(self.text))
                elif kind == "note":
                    if word.startswith("/**") and word.endswith("*/"):
                        self.doc[len(self.text)] = word
                    line += word.count("\n")
                    continue
                add_text(word)
                add_at(at)
                add_line(line)
                add_kind(kind)
                if kind == "quoted":
                    line += word.count("\n")
            else:
                break
        self.mate = [-1] * len(self.text)
        for low, high in self.pairs:
            self.mate[low], self.mate[high] = high, low

    def _template(self, word: str, at: int, line: int, opened: list[int], templates: list[int]) -> tuple[int, int]:
        """Read a template up to its end or next placeholder; where to go on, and the line there."""
        if word == "}":
            self._close(opened, at, line)
            templates.pop()
        stop = _TEMPLATE.match(self.source, at + 1).end()
        word = self.source[at : stop + 1]
        self._add(word, at, line, "quoted")
        line += word.count("\n")
        if self.source[stop : stop + 1] != "$":
            return at + len(word), line
        self._add("{", stop, line, "mark")
        opened.append(len(self.text) - 1)
        templates.append(opened[-1])
        return stop + 2, line

    def _add(self, word: str, at: int, line: int, kind: str) -> None:
        self.text.append(word)
        self.at.append(at)
        self.line.append(line)
        self.kind.append(kind)

    def _close(self, opened: list[int], at: int, line: int) -> None:
        word = self.source[at]
        self._add(word, at, line, "mark")
        # A bracket that fits none of the open ones closes nothing.
        for k in range(len(opened) - 1, max(-1, len(opened) - 9), -1):
            if _OPEN[self.text[opened[k]]] == word:
                self.pairs.append((opened[k], len(self.text) - 1))
                del opened[k:]
                break

    def _operand_next(self) -> bool:
        if not self.text:
            return True
        last, kind = self.text[-1], self.kind[-1]
        return last in _OPERATORS if kind == "word" else kind == "mark" and last not in (")", "]", "<")

    def is_(self, i: int, *words: str) -> bool:
        return 0 <= i < len(self.text) and self.kind[i] != "quoted" and self.text[i] in words

    def word(self, i: int) -> bool:
        return i < len(self.text) and self.kind[i] == "word"

    def raw(self, low: int, high: int) -> str:
        """The source from token low to before token high."""
        return self.source[self.at[low] : self.at[high - 1] + len(self.text[high - 1])] if low < high else ""

    def after(self, i: int) -> int:
        """The token behind a bracket group, or behind an unclosed bracket itself."""
        return (self.mate[i] if self.mate[i] > i else i) + 1

    def generics(self, i: int) -> int:
        """The token behind `<...>`, if that stands here."""
        if not self.is_(i, "<"):
            return i
        depth, k = 0, i
        while k < len(self.text):
            if self.is_(k, "<"):
                depth += 1
            elif self.is_(k, ">"):
                depth -= 1
                if not depth:
                    return k + 1
            elif self.is_(k, ";", ")", "}", "]"):
                break
            k = self.after(k) if self.is_(k, "(", "[", "{") else k + 1
        return i

    def type_end(self, i: int) -> int:
        """The token behind the type that begins here."""
        operand, group, conditions = True, False, 0
        while i < len(self.text):
            if operand:
                if self.is_(i, "|", "&", "-") or (self.word(i) and self.text[i] in _TYPE_PREFIXES and (self.word(i + 1) or self.is_(i + 1, "(", "[", "{"))):
                    i += 1
                    continue
                start = self.generics(i)  # of a function type
                if start > i:
                    i = start
                    continue
                if self.is_(i, "(", "[", "{"):
                    operand, group, i = False, self.is_(i, "("), self.after(i)
                elif self.word(i) or self.kind[i] in ("quoted", "number"):
                    operand, group, i = False, False, i + 1
                    # A template goes on behind its placeholders.
                    while self.is_(i, "{") and self.text[i - 1].startswith("`") and self.mate[i] > i:
                        i = self.mate[i] + 2
                else:
                    return i
            elif self.is_(i, "<") and self.generics(i) > i:
                i = self.generics(i)
            elif self.is_(i, "[") and self.line[i] == self.line[i - 1]:
                i = self.after(i)
            elif self.is_(i, "|", "&", ".") or (self.is_(i, "=>") and group) or self.is_(i, "is", "extends"):
                conditions += self.is_(i, "extends")
                operand, i = True, i + 1
            elif conditions and self.is_(i, "?", ":"):
                conditions -= self.is_(i, ":")
                operand, i = True, i + 1
            else:
                return i
        return i

    def value_end(self, i: int) -> int:
        """The token behind the expression that begins here: a comma, semicolon, closing bracket or line end."""
        first = i
        while i < len(self.text) and not self.is_(i, ",", ";", ")", "]", "}"):
            if i > first and self.line[i] > self.line[i - 1] and not self._goes_on(i):
                return i
            i = self.after(i) if self.is_(i, "(", "[", "{") else i + 1
        return i

    def _goes_on(self, i: int) -> bool:
        """Whether a line break before token i is inside a statement."""
        last, kind = self.text[i - 1], self.kind[i - 1]
        if (kind == "word" and last in _OPERATORS) or (kind == "mark" and last not in (")", "]", "}", "++", "--", ">")):
            return True
        return self.kind[i] == "mark" and self.text[i] not in ("{", "}", "++", "--", "@", "`", "!")

    def begins(self, i: int) -> bool:
        """Whether a statement may begin at token i."""
        if i == 0:
            return True
        last, kind = self.text[i - 1], self.kind[i - 1]
        if kind == "mark" and last in (";", "{", "}"):
            return True
        broken = self.line[i] > self.line[i - 1]
        if kind != "mark" or last == ")":
            return broken and not (kind == "word" and last in _OPERATORS) or (kind == "word" and last in ("else", "do"))
        return last in ("]", ">") and broken


class Script:
    """Declarations and scopes of one file."""

    def __init__(self, text: str):
        self.t = Tokens(text)
        self.symbols: list[dict] = []
        self.scopes: list[dict] = []
        self.listed: set[str] = set()  # names in import statements
        # Stretches still to be read, as (first token, end, symbol that they belong to).
        waiting = [(0, len(self.t.text), -1)]
        while waiting:
            i, high, owner = waiting.pop()
            while i < high:
                i = self._statement(i, owner, waiting) if self.t.kind[i] == "word" and self.t.begins(i) else i + 1
        if not self.symbols:
            self._module_exports()

    def _symbol(self, name: str, kind: str, signature: str, exported: bool, first: int) -> int:
        self.symbols.append({"n": len(self.symbols), "name": name, "kind": kind, "signature": signature, "doc": _doc_line(self.t.doc.get(first)), "exported": exported, "line": self.t.line[first]})
        return len(self.symbols) - 1

    def _body(self, low: int, high: int, owner: int, name: str, waiting: list) -> None:
        """A body from token low to before token high."""
        if low < high:
            self.scopes.append({"n": len(self.scopes), "symbol": owner, "name": name, "start": self.t.at[low], "stop": self.t.at[high - 1]})
            waiting.append((low, high, owner))

    def _params(self, i: int) -> str:
        """Parameters of the bracket at i, each with its type and default as written, on one line."""
        t, out, k = self.t, [], i + 1
        stop = t.mate[i] if t.mate[i] > i else k
        while k < stop:
            end = k
            while end < stop and not t.is_(end, ","):
                end = t.after(end) if t.is_(end, "(", "[", "{") else max(end + 1, t.generics(end))
            while k < end and (t.is_(k, "@", "...") or (t.is_(k, *_MODIFIERS) and t.word(k + 1)) or t.is_(k - 1, "@")):
                k = t.after(k + 1) if t.is_(k - 1, "@") and t.is_(k + 1, "(") else k + 1
            if k < end:
                out.append(t.raw(k, end))
            k = end + 1
        return ", ".join(out)

    def _returns(self, i: int) -> tuple[str, int]:
        """`: type` behind a parameter list, and the token behind it."""
        if not self.t.is_(i, ":"):
            return "", i
        end = self.t.type_end(i + 1)
        return ": " + self.t.raw(i + 1, end), end

    def _statement(self, i: int, owner: int, waiting: list) -> int:
        """Read the statement that may begin at the word i; the token to go on with."""
        t = self.t
        if t.is_(i, "import"):
            return self._import(i)
        first, exported = i, False
        while t.is_(i, "export", "default", "declare", "abstract", "async") or (t.is_(i, "const") and t.is_(i + 1, "enum")):
            exported |= t.is_(i, "export")
            i += 1
        if i >= len(t.text):
            return i
        inside = owner >= 0
        if t.is_(i, "function"):
            return self._function(first, i, exported, owner, waiting)
        if not inside and t.is_(i, "class") and t.word(i + 1) and not t.is_(i + 1, "extends", "implements"):
            return self._class(first, i, exported, waiting)
        if not inside and t.is_(i, "interface", "enum", "type") and t.word(i + 1):
            return self._type(first, i, exported)
        if t.is_(i, "const", "let", "var") and (exported or inside):
            return self._variables(first, i + 1, owner, waiting)
        if not inside and t.is_(i - 1, "default") and t.word(i) and not t.is_(i, "class", "function", "new") and (t.is_(i + 1, ";") or i + 1 == len(t.text) or t.begins(i + 1)):
            self._symbol(t.text[i], "function", f"{t.text[i]} (default export)", True, first)
        if t.is_(i, "const", "let", "var"):
            self._required(i)
        return max(i, first + 1)

    def _import(self, i: int) -> int:
        t, k = self.t, i + 1
        while k < len(t.text) and t.kind[k] != "quoted" and (t.kind[k] == "word" or t.is_(k, "{", "}", ",", "*")):
            if t.word(k):
                self.listed.add(t.text[k])
            k += 1
        return k + 1 if k < len(t.text) and t.kind[k] == "quoted" else i + 1

    def _required(self, i: int) -> None:
        """Names that a variable statement takes out of require()."""
        t, k = self.t, i + 1
        end = t.after(k) if t.is_(k, "{", "[") else k + 1
        if t.is_(end, "=") and t.is_(end + 1, "require"):
            self.listed |= {t.text[j] for j in range(k, end) if t.word(j)}

    def _function(self, first: int, i: int, exported: bool, owner: int, waiting: list) -> int:
        t = self.t
        k = i + 2 if t.is_(i + 1, "*") else i + 1
        if not t.word(k):
            return i + 1
        name, open_ = t.text[k], t.generics(k + 1)
        if not t.is_(open_, "(") or t.mate[open_] < 0:
            return i + 1
        result, end = self._returns(t.after(open_))
        if owner < 0:
            n = self._symbol(name, symbol_kind(name) if exported else "function", f"{name}({self._params(open_)}){result}", exported, first)
        else:
            n = owner
        if t.is_(end, "{"):
            self._body(end + 1, t.mate[end] if t.mate[end] > end else end + 1, n, name, waiting)
            return t.after(end)
        return end

    def _class(self, first: int, i: int, exported: bool, waiting: list) -> int:
        t, name, k = self.t, self.t.text[i + 1], self.t.generics(i + 2)
        heads: list[tuple[str, list[str]]] = []
        while t.is_(k, "extends", "implements"):
            word, low, types = t.text[k], k + 1, []
            k += 1
            while k < len(t.text) and not t.is_(k, "{", "implements"):
                if t.is_(k, ","):
                    types.append(t.raw(low, k))
                    low = k + 1
                k = t.after(k) if t.is_(k, "(", "[") else max(k + 1, t.generics(k))
            heads.append((word, [*types, t.raw(low, k)]))
        self._symbol(name, "class", name + "".join(f" {w} {', '.join(x)}" for w, x in heads), exported, first)
        if not t.is_(k, "{"):
            return max(k, i + 2)
        stop, j = (t.mate[k] if t.mate[k] > k else k + 1), k + 1
        while j < stop:
            j = self._member(name, j, stop, waiting)
        return t.after(k)

    def _member(self, owner: str, i: int, stop: int, waiting: list) -> int:
        t, first, k = self.t, i, i
        if t.is_(k, ";"):
            return k + 1
        if t.is_(k, "@"):  # a decorator
            k += 2
            while t.is_(k, "."):
                k += 2
            return t.after(k) if t.is_(k, "(") else k
        words = set()
        while t.is_(k, *_MODIFIERS) and not t.is_(k + 1, "(", "=", ":", ";", "?", "<", "!"):
            words.add(t.text[k])
            k += 1
        if t.is_(k, "*"):
            k += 1
        low = k
        k = t.after(k) if t.is_(k, "[", "{") else k + 1
        name, open_ = t.raw(low, min(k, stop)), t.generics(k + 1 if t.is_(k, "?") else k)
        if not t.is_(open_, "(") or t.mate[open_] < 0 or open_ >= stop:
            return max(self._property_end(k, stop), i + 1)
        result, end = self._returns(t.after(open_))
        shown = not words & {"private", "get", "set"} and name != "constructor" and not name.startswith("_")
        if shown:
            n = self._symbol(f"{owner}.{name}", "method", f"{name}({self._params(open_)}){result}", False, first)
        if not t.is_(end, "{"):
            return max(end, i + 1)
        if shown:
            self._body(end + 1, t.mate[end] if t.mate[end] > end else end + 1, n, f"{owner}.{name}", waiting)
        return t.after(end)

    def _property_end(self, k: int, stop: int) -> int:
        t = self.t
        while k < stop and not t.is_(k, ";"):
            if t.line[k] > t.line[k - 1] and not t._goes_on(k):
                return k
            k = t.after(k) if t.is_(k, "(", "[", "{") else k + 1
        return k

    def _type(self, first: int, i: int, exported: bool) -> int:
        t, word, name, k = self.t, self.t.text[i], self.t.text[i + 1], self.t.generics(i + 2)
        if word == "type":
            if not t.is_(k, "="):
                return i + 1
            end = t.type_end(k + 1)
            shown = t.raw(k + 1, end)
            self._symbol(name, "type", f"{name} = {shown[:60]}{'...' if len(shown) > 60 else ''}", exported, first)
            return end
        low = k
        while k < len(t.text) and not t.is_(k, "{"):
            k = max(k + 1, t.generics(k))
        if k == len(t.text):
            return i + 1
        if word == "interface":
            self._symbol(name, "interface", name + (" " + t.raw(low, k) if k > low else ""), exported, first)
            return t.after(k)
        names, j, stop = [], k + 1, t.mate[k] if t.mate[k] > k else k + 1
        while j < stop:
            names.append(t.text[j].strip("'\""))
            while j < stop and not t.is_(j, ","):
                j = t.after(j) if t.is_(j, "(", "[", "{") else j + 1
            j += 1
        values = names[:8] + ["..."] * (len(names) > 8)
        self._symbol(name, "enum", f"{name} = {' | '.join(values)}" if values else name, exported, first)
        return t.after(k)

    def _variables(self, first: int, i: int, owner: int, waiting: list) -> int:
        """Variables of one statement. Exported ones are symbols; within bodies, functions are scopes."""
        t = self.t
        while i < len(t.text):
            if not t.word(i):
                return i
            name, k, annotation = t.text[i], i + 1, ""
            if t.is_(k, "!"):
                k += 1
            if t.is_(k, ":"):
                end = t.type_end(k + 1)
                annotation, k = ": " + t.raw(k + 1, end), end
            low = k + 1
            made = self._function_value(low) if t.is_(k, "=") else None
            if made:
                params, result, start, stop = made
                n = owner if owner >= 0 else self._symbol(name, symbol_kind(name), name + (annotation or f"({params}){result}"), True, first)
                self._body(start, stop, n, name, waiting)
                k = stop + t.is_(stop, "}") * t.is_(start - 1, "{")
            else:
                if owner < 0:
                    self._symbol(name, "variable", name + annotation, True, first)
                k = t.value_end(low) if t.is_(k, "=") else k
            if not t.is_(k, ","):
                return max(k, i + 1) if owner < 0 else max(low if t.is_(low - 1, "=") and not made else k, i + 1)
            i = k + 1
        return i

    def _function_value(self, i: int) -> tuple[str, str, int, int] | None:
        """(parameters, result, first token of the body, end) of an arrow function or function expression at token i."""
        t = self.t
        if t.is_(i, "async") and not t.is_(i + 1, "=>"):
            i += 1
        if t.is_(i, "function"):
            k = i + 2 if t.is_(i + 1, "*") else i + 1
            open_ = t.generics(k + 1 if t.word(k) else k)
            if not t.is_(open_, "("):
                return None
            result, end = self._returns(t.after(open_))
            return (self._params(open_), result, end + 1, t.mate[end] if t.mate[end] > end else end + 1) if t.is_(end, "{") else None
        open_ = t.generics(i)
        if t.is_(open_, "("):
            result, end = self._returns(t.after(open_))
            params = self._params(open_)
        elif t.word(i):
            params, result, end = t.text[i], "", i + 1
        else:
            return None
        if not t.is_(end, "=>"):
            return None
        if t.is_(end + 1, "{"):
            return params, result, end + 2, t.mate[end + 1] if t.mate[end + 1] > end + 1 else end + 2
        return params, result, end + 1, t.value_end(end + 1)

    def _module_exports(self) -> None:
        t = self.t
        for i in range(len(t.text) - 4):
            if not (t.is_(i, "module") and t.is_(i + 1, ".") and t.is_(i + 2, "exports") and t.is_(i + 3, "=") and t.begins(i)):
                continue
            k = i + 4
            named = t.is_(k, "class", "function") and t.word(k + 1)
            if named or (t.word(k) and not t.is_(k, "class", "function")):
                name = t.text[k + named]
                self._symbol(name, t.text[k] if named else "variable", f"{name} (module.exports)", True, i)
            elif t.is_(k, "{"):
                j, stop = k + 1, t.mate[k]
                while j < stop:
                    if t.word(j) and t.is_(j + 1, ",", ":", "}", "("):
                        self._symbol(t.text[j], "variable", t.text[j], True, j)
                    while j < stop and not t.is_(j, ","):
                        j = t.after(j) if t.is_(j, "(", "[", "{") else j + 1
                    j += 1

    def uses(self) -> list[dict]:
        """Places of names that import statements list, the statements themselves left out with all that no body holds."""
        t = self.t
        return [{"word": w, "at": a} for w, a, k in zip(t.text, t.at, t.kind) if k == "word" and w in self.listed] if self.scopes else []

    def throws(self) -> list[dict]:
        t, out = self.t, []
        for i, word in enumerate(t.text):
            if word != "throw" or t.kind[i] != "word":
                continue
            if t.is_(i + 1, "new") and t.word(i + 2) and not t.is_(i + 3, "."):
                out.append({"name": t.text[i + 2], "at": t.at[i]})
            elif t.word(i + 1) and (i + 2 >= len(t.text) or t.is_(i + 2, ";", "}") or t.line[i + 2] > t.line[i + 1]):
                out.append({"name": t.text[i + 1], "at": t.at[i]})
        return out


def symbol_kind(name: str) -> str:
    if name in ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS"):
        return "route"
    return "component" if re.match(r"[A-Z]", name) and not re.fullmatch(r"[A-Z_]+", name) else "function"


def _doc_line(note: str | None) -> str | None:
    """The first line of a doc comment, of 6 to 199 characters."""
    if note is None:
        return None
    first = re.sub(r"(?m)^\s*\*+ ?", "", note[3:-2]).strip().split("\n")[0].strip()
    return first if 5 < len(first) < 200 and not first.startswith("@") else None


def _around(text: str, symbols: list[dict]) -> list[dict]:
    """(above, below) of each line on which a symbol without a doc comment stands, if a description may be there: up to ten lines above and the one below. Such symbols get its number as near."""
    lines, found, out = text.split("\n"), {}, []
    for s in symbols:
        n = s["line"]
        if s["doc"] is None and n not in found:
            above, below = lines[max(0, n - 11) : n - 1], "".join(lines[n : n + 1])
            found[n] = None
            if any("/**" in x for x in above) or (above and "//" in above[-1]) or '"""' in below or "'''" in below:
                found[n] = len(out)
                out.append({"above": "\n".join(above), "below": below})
        s["near"] = found.get(n) if s["doc"] is None else None
    return out


def scan_scripts(files: DataFrame) -> DataFrame:
    """A row for each script of files (path, ext, content): see SCAN. Null contents are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 50):
                rows = []
                for path, ext, text in zip(*(c.to_pylist() for c in batch.slice(at, 50).columns)):
                    s = Script(text or "")
                    rows.append({"path": path, "ext": ext, "around": _around(text or "", s.symbols), "symbols": s.symbols, "scopes": s.scopes, "uses": s.uses(), "throws": s.throws()})
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return files.select("path", "ext", "content").mapInArrow(run, SCAN)


_SYMBOL = [("n", pa.int32()), ("name", pa.string()), ("kind", pa.string()), ("signature", pa.string()), ("doc", pa.string()), ("exported", pa.bool_()), ("line", pa.int32()), ("near", pa.int32())]
_ARROW = pa.schema(
    [
        ("path", pa.string()),
        ("ext", pa.string()),
        ("symbols", pa.list_(pa.struct(_SYMBOL))),
        ("around", pa.list_(pa.struct([("above", pa.string()), ("below", pa.string())]))),
        ("scopes", pa.list_(pa.struct([("n", pa.int32()), ("symbol", pa.int32()), ("name", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))),
        ("uses", pa.list_(pa.struct([("word", pa.string()), ("at", pa.int32())]))),
        ("throws", pa.list_(pa.struct([("name", pa.string()), ("at", pa.int32())]))),
    ]
)


def script_symbols(scanned: DataFrame) -> DataFrame:
    """(path, n, name, kind, signature, doc, exported, line) of scanned files."""
    return scanned.select("path", F.explode("symbols").alias("s")).select("path", "s.*").drop("near")


def innermost(points: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """points (key, at, ...) with n: the number of the innermost span (key, n, start, stop; ends included) around each, null outside all. Spans of a key nest or are apart.

    One sweep over starts, ends and points in order: a running sum is the depth at each, and the innermost span around a point is the last that began at the point's depth. No point meets any span but its own."""
    carried = [c for c in points.columns if c not in (key, "at")]
    none = lambda: [F.lit(None).cast(points.schema[c].dataType).alias(c) for c in carried]
    # At one place, spans open first, wider ones before, and close last.
    events = spans.select(key, F.col("start").alias("at"), F.lit(0).alias("turn"), (-F.col("stop")).cast("long").alias("wide"), F.lit(1).alias("step"), F.col("n").alias("opens"), *none())
    events = events.unionByName(spans.select(key, F.col("stop").alias("at"), F.lit(2).alias("turn"), F.lit(0).cast("long").alias("wide"), F.lit(-1).alias("step"), F.lit(None).cast(spans.schema["n"].dataType).alias("opens"), *none()))
    events = events.unionByName(points.select(key, "at", F.lit(1).alias("turn"), F.lit(0).cast("long").alias("wide"), F.lit(0).alias("step"), F.lit(None).cast(spans.schema["n"].dataType).alias("opens"), *carried))
    return _swept(events, key).filter("turn = 1").select(key, "at", *carried, "n")


def _swept(events: DataFrame, key: str) -> DataFrame:
    """events (key, at, turn, wide, step, opens, ...) with n: the innermost span that is open at each, which for an opening is the span itself. See innermost."""
    order = ("at", "turn", "wide", "opens")
    deep = events.withColumn("depth", F.sum("step").over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    last = F.last("opens", ignorenulls=True).over(Window.partitionBy(key, "depth").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return deep.withColumn("n", F.when(F.col("depth") > 0, last))


def scope_names(scanned: DataFrame, local_names: DataFrame) -> DataFrame:
    """(path, scope, symbol, name, calls, throws): for each body, the names imported from relative modules that stand in it and in no body within, and what it throws itself. local_names: (path, word).

    Files meet their names as one row each; from there on all goes by file, so one exchange serves the sweep and the groups, and scanned is read once."""
    files = scanned.select("path", "scopes", "uses", "throws").join(local_names.groupBy("path").agg(F.collect_set("word").alias("local")), "path", "left")
    kinds = {"at": "int", "turn": "int", "wide": "long", "step": "int", "opens": "int", "symbol": "int", "name": "string", "word": "string", "thrown": "boolean"}
    event = lambda **given: F.struct(*[F.lit(given.get(k)).cast(t).alias(k) if not isinstance(given.get(k), Column) else given[k].cast(t).alias(k) for k, t in kinds.items()])
    events = F.concat(
        F.transform("scopes", lambda s: event(at=s["start"], turn=0, wide=-s["stop"], step=1, opens=s["n"], symbol=s["symbol"], name=s["name"])),
        F.transform("scopes", lambda s: event(at=s["stop"], turn=2, wide=0, step=-1)),
        F.transform(F.filter("uses", lambda u: F.array_contains("local", u["word"])), lambda u: event(at=u["at"], turn=1, wide=0, step=0, word=u["word"], thrown=False)),
        F.transform("throws", lambda t: event(at=t["at"], turn=1, wide=0, step=0, word=t["name"], thrown=True)),
    )
    inside = _swept(files.select("path", F.explode(events).alias("e")).select("path", "e.*"), "path").filter("turn < 2 AND n IS NOT NULL")
    named = lambda thrown: F.array_sort(F.collect_set(F.when(F.col("thrown") == thrown, F.col("word"))))
    return inside.groupBy("path", F.col("n").alias("scope")).agg(F.max("symbol").alias("symbol"), F.max("name").alias("name"), named(False).alias("calls"), named(True).alias("throws"))


def script_bodies(scanned: DataFrame, local_names: DataFrame, most_throws: int = 5) -> DataFrame:
    """(path, symbol, calls, throws) of symbols with bodies, functions within a body included; up to five throws."""
    each = scope_names(scanned, local_names).groupBy("path", "symbol").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("calls")))).alias("calls"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("throws")))), 1, most_throws).alias("throws"))
    return each
