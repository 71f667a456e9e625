"""Declarations, calls, bases and types of one Rust, TypeScript or Go file.

A scanner turns the text into tokens (strings, raw strings, nested comments and
templates are each one token or none), and one pass over them keeps a stack of
scopes: every brace opens the function, type or block that was declared before
it.  So calls have the function around them, methods their type, and names a
type where the function says one: parameters, annotations and constructors.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

STRINGS = r"\"(?:\\.|[^\"\\])*\""
COMMON = r"(?P<id>[A-Za-z_$][\w$]*)|(?P<num>\d[\w]*(?:\.\d\w*)?)"
SCANNERS = {
    "rust": re.compile(rf"(?P<ws>\s+|//[^\n]*)|(?P<str>b?r(?P<h>#*)\"(?s:.*?)\"(?P=h)|b?{STRINGS}|b?'(?:\\[^\n']*'?|[^\\'\n])')|(?P<life>'[A-Za-z_]\w*)|(?:r#)?{COMMON}|(?P<p>::|->|=>|&&|\|\||\.\.=?|.)", re.S),
    "typescript": re.compile(rf"(?P<ws>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<str>{STRINGS}|'(?:\\.|[^'\\\n])*')|{COMMON}|(?P<p>=>|\?\.(?!\d)|\.\.\.|&&|\|\||\?\?|.)", re.S),
    "go": re.compile(rf"(?P<ws>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<str>{STRINGS}|`[^`]*`|'(?:\\.|[^'\\\n])*')|{COMMON}|(?P<p>:=|&&|\|\||\.\.\.|<-|.)", re.S),
}
PATTERN = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
OPENING, CLOSING = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
NOT_CALLS = {
    "rust": {"if", "for", "while", "match", "return", "fn", "in", "let", "loop", "move", "as", "pub", "where", "impl", "mut", "ref", "else", "unsafe", "await", "dyn"},
    "typescript": {"if", "for", "while", "switch", "return", "function", "catch", "await", "in", "of", "super", "typeof", "import", "delete", "void", "async", "constructor", "throw", "case", "do", "else", "with", "instanceof", "yield", "new"},
    "go": {"if", "for", "switch", "return", "func", "select", "go", "defer", "range", "case", "interface", "struct", "map", "chan", "var", "const", "type", "import", "else"},
}
#: Methods of a Rust type that make one of it, by name or beginning.
MAKERS, MAKER_HEADS = {"new", "default", "from"}, ("new_", "with_", "from_")
HOLDERS = {"Box", "Arc", "Rc", "RefCell", "Mutex", "RwLock"}
MODIFIERS = {"public", "private", "protected", "static", "async", "readonly", "abstract", "override", "get", "set", "declare", "*", "accessor"}
# fixed values: type names that make no reference
PRIMITIVES = set(
    """i8 i16 i32 i64 i128 isize u8 u16 u32 u64 u128 usize f32 f64 bool char str String Vec Option Result Box Arc Rc HashMap HashSet BTreeMap BTreeSet
    string number boolean void any unknown never undefined null int float dict list tuple set None""".split()
)


@dataclass
class Scope:
    kind: str
    name: str | None = None
    types: dict[str, str] = field(default_factory=dict)


def scan(content: str, language: str, at: int = 0, end: str = "") -> tuple[list[tuple[str, str, int]], int]:
    """Tokens ``(kind, text, place)`` up to an unmatched ``end``, and the place after."""
    out, depth, n = [], 0, len(content)
    while at < n:
        two = content[at : at + 2]
        if language == "rust" and two == "/*":
            depth_in, at = 1, at + 2
            while at < n and depth_in:
                m = re.compile(r"/\*|\*/").search(content, at)
                depth_in, at = (depth_in + (1 if m[0] == "/*" else -1), m.end()) if m else (0, n)
            continue
        if language == "typescript" and two[:1] == "`":
            start, at = at, at + 1
            out.append(("str", "`", start))
            while at < n and content[at] != "`":
                if content.startswith("${", at):
                    inner, at = scan(content, language, at + 2, "}")
                    out += inner
                else:
                    at += 2 if content[at] == "\\" else 1
            at += 1
            continue
        if language == "typescript" and two[:1] == "/" and two not in ("//", "/*"):
            before = out[-1] if out else ("p", "", 0)
            if before[0] == "p" and before[1] not in (")", "]", "}") or before[1] in ("return", "typeof", "case", "in", "of"):
                if m := PATTERN.match(content, at):
                    out.append(("str", "/", at))
                    at = m.end()
                    continue
        m = SCANNERS[language].match(content, at)
        kind = m.lastgroup if m.lastgroup != "h" else "str"
        text = m[kind]
        if end and text == end and not depth:
            return out, m.end()
        depth += (text == "{") - (text == "}")
        if kind != "ws":
            out.append((kind, text if kind != "str" else text[:1], m.start(kind)))
        at = m.end()
    return out, at


def without_comments(content: str, language: str) -> str:
    """The text with comments blanked; strings stay."""
    out, at = [], 0
    blank = lambda s: re.sub(r"[^\n]", " ", s)
    comment = re.compile(rf"(?P<keep>b?r(?P<h>#*)\"(?s:.*?)\"(?P=h)|{STRINGS}|'(?:\\.|[^'\\\n])'|`[^`]*`)|//[^\n]*|/\*" if language in ("rust", "go") else rf"(?P<keep>{STRINGS}|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|//[^\n]*|/\*", re.S)
    while m := comment.search(content, at):
        end = m.end()
        if m[0] == "/*":
            depth = 1
            while depth and (x := re.compile(r"/\*|\*/" if language == "rust" else r"\*/").search(content, end)):
                depth, end = depth + (1 if x[0] == "/*" else -1), x.end()
            end = len(content) if depth else end
        out += [content[at : m.start()], m[0] if m["keep"] is not None else blank(content[m.start() : end])]
        at = end
    return "".join([*out, content[at:]])


class Reader:
    """One file's findings; ``rows`` has tuples as ``row`` makes them."""

    def __init__(self, content: str, language: str, row) -> None:
        self.content, self.language, self.row = content, language, row
        self.tokens, _ = scan(content, language)
        self.text = [t for _, t, _ in self.tokens] + [""] * 4
        self.kind = [k for k, _, _ in self.tokens] + [""] * 4
        self.lines, self.starts = content.split("\n"), [0]
        for x in self.lines:
            self.starts.append(self.starts[-1] + len(x) + 1)
        self.rows, self.pending, self.fields, self.late = [], {}, {}, []
        self.match, stack = {}, []
        for i, t in enumerate(self.text):
            if self.kind[i] != "p":
                continue
            if t in OPENING:
                stack.append(i)
            elif t in CLOSING and stack and OPENING[self.text[stack[-1]]] == t:
                self.match[stack[-1]] = i
                self.match[i] = stack.pop()
        self.stack: list[Scope] = []
        self.no_generics: set[int] = set()
        self.seen: set[int] = set()
        self.heads: set[tuple[int, int]] = set()
        self.spans: list[tuple[int, int, Scope]] = []
        #: Calls up to here are inside a macro, whose tokens need not be expressions.
        self.quiet = -1

    # ---- helpers over tokens ----

    def close(self, i: int) -> int:
        return self.match.get(i, len(self.tokens))

    def line(self, i: int) -> int:
        place, lo, hi = self.tokens[i][2], 0, len(self.starts) - 1
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if self.starts[mid] <= place else (lo, mid)
        return lo + 1

    def place(self, i: int) -> tuple[int, int]:
        no = self.line(i)
        return no, self.tokens[i][2] - self.starts[no - 1]

    def add(self, what: str, kind: str, name: str | None, i: int, owner: str | None = None, target: str | None = None, receiver: str | None = None, context: str | None = None, of: str | None = None) -> None:
        no, column = self.place(i)
        if what == "symbol":
            self.heads.add((no, column))
        self.rows.append(self.row(what, kind, name, no, column, self.lines[no - 1], owner, target, receiver, False, context, of))

    def generics(self, i: int) -> int:
        """The place after type arguments that begin at ``i``; ``i`` if none do."""
        if self.text[i] != "<":
            return i
        depth, j = 0, i
        while j < len(self.tokens):
            t, k = self.text[j], self.kind[j]
            if t == "<":
                depth += 1
            elif t == ">":
                depth -= 1
                if not depth:
                    return j + 1
            elif t in "([" and k == "p":
                j = self.close(j)
            elif k not in ("id", "life", "num") and t not in ("::", ",", "&", "->", "=>", "=", "+", "?", ";", "*", ":", "|", "[", "]", ".", "{", "}", '"', "'", "#"):
                return i
            elif t in (";", "{") and self.language != "typescript":
                return i
            j += 1
        return i

    def body(self, i: int) -> int | None:
        """The brace that opens what is declared before ``i``, if one does before the statement ends."""
        while i < len(self.tokens):
            t = self.text[i] if self.kind[i] == "p" else ""
            if t in ("(", "["):
                i = self.close(i)
            elif t == "{":
                return i
            elif t in (";", "}", ")", ",") and not (t == "," and self.language == "rust"):
                return None
            i += 1
        return None

    def split(self, lo: int, hi: int) -> list[tuple[int, int]]:
        """Ranges between ``lo`` and ``hi`` that commas part, brackets and type arguments kept whole."""
        out, begin, i = [], lo, lo
        while i < hi:
            t = self.text[i] if self.kind[i] == "p" else ""
            if t in OPENING:
                i = self.close(i)
            elif t == "<" and (after := self.generics(i)) > i:
                i = after - 1
            elif t == "," or (t == ";" and self.language == "typescript"):
                out.append((begin, i))
                begin = i + 1
            i += 1
        return [(a, b) for a, b in [*out, (begin, hi)] if a < b]

    def named_type(self, lo: int, hi: int) -> str | None:
        """The type that ``lo`` to ``hi`` name, without references, holders and type arguments."""
        i = lo
        while i < hi and (self.text[i] in ("&", "&&", "mut", "dyn", "impl", "*", "const", "readonly") or self.kind[i] == "life"):
            i += 1
        name = None
        while i < hi and self.kind[i] == "id":
            name = self.text[i]
            if self.text[i + 1] not in ("::", ".") or i + 2 >= hi:
                break
            i += 2
        if name in HOLDERS and self.text[i + 1] == "<":
            return self.named_type(i + 2, hi)
        return name

    def refer(self, lo: int, hi: int, context: str) -> None:
        """A reference where the type is one plain name."""
        if hi - lo == 1 and self.kind[lo] == "id" and self.text[lo] not in PRIMITIVES and self.text[lo] not in ("Self", "self", "this"):
            self.add("edge", "references", None, lo, self.owner(), self.text[lo], context=context)

    def owner(self) -> str | None:
        return next((s.name for s in reversed(self.stack) if s.kind == "fn" and s.name), None)

    def type_around(self) -> str | None:
        return next((s.name for s in reversed(self.stack) if s.kind == "type"), None)

    def holder(self) -> str | None:
        """The type or module that what is declared here belongs to."""
        return self.stack[-1].name if self.stack and self.stack[-1].kind in ("type", "space") else None

    def types(self) -> dict[str, str]:
        out: dict[str, str] = {}
        for s in self.stack:
            out |= s.types
        return out

    def made(self, i: int) -> str | None:
        """The type that the expression at ``i`` makes, where its form says one."""
        while self.text[i] in ("&", "await", "mut"):
            i += 1
        if self.text[i] == "new" and self.language == "typescript":
            return self.named_type(i + 1, i + 8)
        names, j = [], i
        while self.kind[j] == "id":
            names.append(self.text[j])
            j += 1
            j = self.generics(j + 1) if self.text[j] == "::" and self.text[j + 1] == "<" else self.generics(j) if self.language == "rust" else j
            if self.text[j] not in ("::", "."):
                break
            j += 1
        if not names:
            return None
        last = names[-1]
        if self.language == "go":
            return last if self.text[j] == "{" and last[:1].isupper() else last[3:] if last.startswith("New") and self.text[j] == "(" and last[3:] else None
        if self.language == "rust":
            if len(names) > 1 and names[-2][:1].isupper() and self.text[j] == "(" and (last in MAKERS or last.startswith(MAKER_HEADS)):
                return self.type_around() if names[-2] == "Self" else names[-2]
            if last[:1].isupper() and self.text[j] in ("{", "("):
                return self.type_around() if last == "Self" else last
        return None

    def parameters(self, at: int, context: bool = True) -> dict[str, str]:
        """Types by name of the parameters in the brackets at ``at``."""
        out: dict[str, str] = {}
        waiting: list[str] = []
        for lo, hi in self.split(at + 1, self.close(at)):
            if self.language == "go":
                waiting.append(self.text[lo])
                if hi - lo > 1 and (name := self.named_type(lo + 1, hi)):
                    out |= dict.fromkeys(waiting, name)
                    waiting = []
                continue
            while lo < hi and (self.text[lo] in MODIFIERS or self.text[lo] in ("mut", "ref", "...") or (self.text[lo] == "@" and self.language == "typescript")):
                if self.text[lo] == "@":
                    lo = self.close(lo + 2) + 1 if self.text[lo + 2] == "(" else lo + 2
                else:
                    lo += 1
            colon = lo + 1 + (self.text[lo + 1] == "?")
            if self.text[colon] != ":" or colon >= hi or self.kind[lo] != "id":
                continue
            end = next((j for j in range(colon + 1, hi) if self.text[j] == "="), hi)
            if name := self.named_type(colon + 1, end):
                out[self.text[lo]] = name
                if context:
                    self.refer(colon + 1, end, "parameter_type")
        return out

    # ---- calls ----

    def before(self, i: int) -> int:
        """Where the expression begins whose member is named at ``i``; ``i - 1`` is the dot."""
        k = i - 2
        while k >= 0:
            t = self.text[k]
            if t in (")", "]") and k in self.match:
                k = self.match[k]
                if self.kind[k - 1] == "id" and (self.text[k - 1] not in NOT_CALLS[self.language] or self.text[k - 1] in ("import", "super")) or self.text[k - 1] in (")", "]", "?", "!"):
                    k -= 1
                    continue
            elif t == ">" and self.text[i - 1] == "::":
                depth = 0
                while k >= 0:
                    depth += (self.text[k] == ">") - (self.text[k] == "<")
                    if not depth:
                        break
                    k -= 1
                k -= 1 + (self.text[k - 1] == "::")
                continue
            elif t in ("?", "!"):
                k -= 1
                continue
            if self.text[k - 1] in (".", "::", "?.") and k >= 2:
                k -= 2
                continue
            return k
        return 0

    def call(self, i: int) -> None:
        after = i + 1
        if self.language == "rust" and self.text[after] == "::" and self.text[after + 1] == "<":
            after = self.generics(after + 1)
        elif self.language != "rust" and self.text[after] in ("<", "["):
            wide = self.generics(after) if self.text[after] == "<" else after
            after = wide if self.text[wide] == "(" else after
        if self.text[after] == "?.":
            after += 1
        last = self.text[i - 1] if i else ""
        if self.text[after] != "(" or self.text[i] in NOT_CALLS[self.language] or last in ("fn", "function", "func", "new", "macro_rules"):
            return
        receiver = of = None
        if last in (".", "::", "?."):
            begin = self.before(i)
            receiver = " ".join(self.content[self.tokens[begin][2] : self.tokens[i - 1][2]].split())[:200]
            if last == "::":
                path = [self.text[k] for k in range(begin, i) if self.kind[k] == "id"]
                of = self.type_around() if path[-1:] == ["Self"] else path[-1] if path and path[-1] not in ("crate", "self", "super") else None
            elif receiver in ("self", "this"):
                of = self.type_around()
            elif re.fullmatch(r"[\w$]+", receiver):
                of = self.types().get(receiver)
                if of is None and (receiver[:1].isupper() or self.language == "go"):
                    of = receiver  # a type, a namespace or, in Go, a package
            elif m := re.fullmatch(r"(\w+)\.(\w+)", receiver):
                base = self.type_around() if m[1] in ("self", "this") else self.types().get(m[1])
                self.late.append((len(self.rows), base, m[2]))
        self.add("edge", "calls", self.owner(), i, self.owner(), self.text[i], receiver, None, of)

    # ---- declarations ----

    def opens(self, at: int | None, scope: Scope) -> None:
        if at is not None:
            self.pending[at] = scope

    def skipped(self, i: int) -> int:
        after = self.generics(i)
        if after > i:
            self.no_generics.add(i)
        return after

    def function(self, i: int, name: str, kind: str, owner: str | None, types: dict[str, str] | None = None) -> None:
        """A function whose name is at ``i``."""
        j = self.skipped(i + 1 + (self.text[i + 1] in ("?", "!")))
        if self.text[j] != "(":
            return
        types = dict(types or {})
        end = self.close(j)
        after = end + 1
        self.stack.append(Scope("fn", name))
        types |= self.parameters(j)
        if self.text[after] in ("->", ":"):
            stop = next((k for k in range(after + 1, len(self.tokens)) if self.text[k] in ("{", ";", "where", "=")), after + 1)
            if self.language == "rust" or kind == "function":
                self.refer(after + 1, stop, "return_type")
            after = self.close(after + 1) + 1 if self.text[after + 1] == "{" else after + 1
        self.stack.pop()
        brace = self.body(after)
        self.add("symbol", kind, name, i, owner)
        self.opens(brace, Scope("fn", name, types))

    def members(self, lo: int, hi: int, owner: str) -> None:
        """Named fields between two braces of a Rust type."""
        for a, b in self.split(lo + 1, hi):
            while a < b and (self.text[a] in ("#", "pub") or self.text[a] == "(" and self.text[a - 1] == "pub"):
                a = self.close(a + 1) + 1 if self.text[a] == "#" else self.close(a) + 1 if self.text[a] == "(" else a + 1
            if self.text[a + 1] == ":" and self.kind[a] == "id":
                if name := self.named_type(a + 2, b):
                    self.fields[owner, self.text[a]] = name
                self.refer(a + 2, b, "field")
            elif self.text[a + 1] == "{":
                self.members(a + 1, self.close(a + 1), owner)

    def path_end(self, i: int) -> tuple[str | None, int]:
        """The last name of a path at ``i`` and the place after it and its type arguments."""
        name = None
        while self.kind[i] == "id":
            name = self.text[i]
            i = self.skip_arguments(i + 1)
            if self.text[i] not in ("::", "."):
                break
            i += 1
        return name, i

    def skip_arguments(self, i: int) -> int:
        return self.generics(i)

    def rust(self, i: int) -> None:
        t, name, last = self.text[i], self.text[i + 1], self.text[i - 1] if i else ""
        named = self.kind[i + 1] == "id"
        if t == "fn" and named:
            around = self.type_around()
            self.function(i + 1, name, "function", self.holder(), {"self": around} if around else None)
        elif t in ("struct", "enum", "union", "trait") and named and last not in (".", "::"):
            self.add("symbol", t, name, i + 1)
            j = self.skipped(i + 2)
            if t == "trait":
                if self.text[j] == ":":
                    while self.text[j] in (":", "+"):
                        base, after = self.path_end(j + 1 + (self.text[j + 1] == "?"))
                        if base:
                            self.add("edge", "inherits", name, j, name, base)
                        j = after if after > j + 1 or base else j + 2
                self.opens(self.body(j), Scope("type", name))
            else:
                brace = self.body(j)
                if brace is not None:
                    self.members(brace, self.close(brace), name)
                    self.opens(brace, Scope("block"))
        elif t in ("const", "static") and self.text[i + 1 + (name == "mut") + 1] == ":" and last not in ("<", ",", "*"):
            self.add("symbol", "const", self.text[i + 1 + (name == "mut")], i + 1)
        elif t == "type" and named and last not in (".", "::"):
            self.add("symbol", "type", name, i + 1)
            self.skipped(i + 2)
        elif t == "mod" and named and self.text[i + 2] in (";", "{"):
            self.add("symbol", "module", name, i + 1)
            self.opens(i + 2, Scope("space", name))
        elif t == "macro_rules" and name == "!":
            self.add("symbol", "macro", self.text[i + 2], i + 2)
            self.quiet = max(self.quiet, self.close(i + 3))
        elif t == "impl" and (last in ("", "}", ";", "]", "{", "unsafe", "default")):
            j = self.skipped(i + 1)
            first, j = self.path_end(j + (self.text[j] == "!"))
            own = first
            if self.text[j] == "for":
                j += 1
                while self.text[j] in ("&", "mut", "dyn") or self.kind[j] == "life":
                    j += 1
                own, j = self.path_end(j)
                if first and own:
                    self.add("edge", "implements", own, i, own, first)
            self.opens(self.body(j), Scope("type", own))
        elif t == "let":
            at = i + 1 + (name == "mut")
            self.bind(at, at + 1)

    def bind(self, name: int, i: int) -> None:
        """Note the type of a variable named at ``name`` whose annotation or value begins at ``i``."""
        found = None
        if self.text[i] == ":" and self.text[i + 1] != ":":
            end = next((k for k in range(i + 1, len(self.tokens)) if self.text[k] in ("=", ";", "{", ")", ",")), i + 1)
            found, i = self.named_type(i + 1, end), end
        if found is None and self.text[i] in ("=", ":="):
            found = self.made(i + 1)
        inner = next((s for s in reversed(self.stack) if s.kind in ("fn", "block")), None)
        if inner is not None and self.kind[name] == "id":
            inner.types.pop(self.text[name], None)
            if found:
                inner.types[self.text[name]] = found

    def arrow(self, i: int, name: str | None) -> None:
        """A function value at ``i``: an arrow function, or one without a name."""
        i += self.text[i] == "async"
        if i in self.seen:
            return
        self.seen.add(i)
        if self.text[i] == "function":
            j = i + 1 + (self.text[i + 1] == "*")
            j = self.skipped(j + (self.kind[j] == "id"))
        else:
            j = self.skipped(i)
        types: dict[str, str] = {}
        if self.text[j] == "(":
            after = self.close(j) + 1
            if self.text[i] != "function" and self.text[after] not in ("=>", ":"):
                return
            arrow = after
            if self.text[after] == ":":
                arrow = next((k for k in range(after, min(after + 60, len(self.tokens))) if self.text[k] in ("=>", ";")), after)
                if self.text[arrow] != "=>" and self.text[i] != "function":
                    return
            types = self.parameters(j)
            brace = arrow + 1 if self.text[arrow] == "=>" else self.body(after)
        elif self.kind[j] == "id" and self.text[j + 1] == "=>":
            brace = j + 2
        else:
            return
        if brace is not None and self.text[brace] == "{":
            self.opens(brace, Scope("fn", name, types))
        elif name and brace is not None:  # an expression: to the end of the statement
            end, depth = brace, 0
            while end < len(self.tokens) and not (depth == 0 and self.text[end] in (";", ",", ")", "}")) and not (depth == 0 and end > brace and self.line(end) > self.line(end - 1) and self.text[end] not in (".", "?.", "?", ":", "&&", "||")):
                end = self.close(end) if self.text[end] in OPENING and self.kind[end] == "p" else end
                end += 1
            self.spans.append((brace, end, Scope("fn", name, types)))

    def typescript(self, i: int) -> None:
        t, name, last = self.text[i], self.text[i + 1], self.text[i - 1] if i else ""
        named, top = self.kind[i + 1] == "id", self.stack[-1] if self.stack else None
        if last in (".", "?."):
            return
        if t == "class" and (named or name == "{"):
            own = name if named and name not in ("extends", "implements") else None
            j = self.skipped(i + 1 + (own is not None))
            if own:
                self.add("symbol", "class", own, i + 1)
            while self.text[j] in ("extends", "implements", ","):
                kind = {"extends": "inherits", "implements": "implements"}.get(self.text[j], "implements")
                base, j = self.path_end(j + 1)
                if own and base:
                    self.add("edge", kind, own, j - 1, own, base)
                j = self.close(j) + 1 if self.text[j] == "(" else j
            self.opens(self.body(j), Scope("type", own))
        elif t == "interface" and named and self.text[i + 2] in ("{", "<", "extends"):
            self.add("symbol", "interface", name, i + 1)
            j = self.skipped(i + 2)
            while self.text[j] in ("extends", ","):
                base, j = self.path_end(j + 1)
                if base:
                    self.add("edge", "inherits", name, j - 1, name, base)
            self.opens(self.body(j), Scope("interface", name))
        elif t == "type" and named and self.text[i + 2] in ("=", "<"):
            self.add("symbol", "type", name, i + 1)
            self.skipped(i + 2)
        elif t == "enum" and named:
            self.add("symbol", "enum", name, i + 1)
        elif t in ("namespace", "module") and named and self.text[i + 2] == "{":
            self.add("symbol", "module", name, i + 1)
            self.opens(i + 2, Scope("space", name))
        elif t == "function":
            at = i + 1 + (name == "*")
            if self.kind[at] == "id":
                self.function(at, self.text[at], "function", self.holder())
            else:
                self.arrow(i, None)
        elif t in ("const", "let", "var") and named and name != "enum":
            self.add("symbol", "variable", name, i + 1)
            self.bind(i + 1, i + 2)
            equals = next((k for k in range(i + 2, min(i + 60, len(self.tokens))) if self.text[k] in ("=", ";", "of", "in")), i + 2)
            if self.text[equals] == "=":
                self.arrow(equals + 1, name)
        elif top is not None and top.kind in ("type", "interface") and last not in ("=", "=>", "new", "return", ":", "@", ",", "(", "|", "&", "?") and t not in MODIFIERS:
            j = self.generics(i + 1 + (name in ("?", "!")))
            if self.text[j] == "(":
                modifiers, k = set(), i - 1
                while self.text[k] in MODIFIERS:
                    modifiers.add(self.text[k])
                    k -= 1
                after = self.close(j) + 1
                if top.kind == "interface":
                    self.heads.add(self.place(i))
                    self.parameters(j)
                elif self.body(after + 1 if self.text[after] == ":" else after) is not None or "abstract" in modifiers:
                    if t == "constructor":
                        for lo, hi in self.split(j + 1, self.close(j)):
                            at = next((k for k in range(lo, hi) if self.text[k] == ":"), None)
                            if self.text[lo] in MODIFIERS and at and (of := self.named_type(at + 1, hi)):
                                self.fields[top.name, self.text[at - 1 - (self.text[at - 1] == "?")]] = of
                    self.function(i, t, "method", top.name, {"this": top.name} if top.name else None)
            elif top.kind == "type" and self.text[j] in (":", "="):
                if self.text[j] == ":":
                    end = next((k for k in range(j + 1, len(self.tokens)) if self.text[k] in (";", "=", "}") or self.line(k) > self.line(j + 1)), j + 1)
                    self.refer(j + 1, end, "field")
                    if of := self.named_type(j + 1, end):
                        self.fields[top.name, t] = of
                    j = end
                if self.text[j] == "=":
                    if of := self.made(j + 1):
                        self.fields.setdefault((top.name, t), of)
                    self.arrow(j + 1, t)

    def go(self, i: int) -> None:
        t, name, last = self.text[i], self.text[i + 1], self.text[i - 1] if i else ""
        if t == "func":
            if self.kind[i + 1] == "id":
                self.function(i + 1, name, "function", None)
            elif not self.stack and name == "(" and self.kind[(end := self.close(i + 1)) + 1] == "id":
                parts = [self.text[k] for k in range(i + 2, end) if self.kind[k] == "id"]
                own = parts[1] if len(parts) > 1 else parts[0] if parts else None
                self.function(end + 1, self.text[end + 1], "method", own, {parts[0]: own} if len(parts) > 1 else None)
        elif t == "type" and self.kind[i + 1] == "id" and not (self.stack and self.stack[-1].kind == "type"):
            self.add("symbol", "type", name, i + 1)
            if self.text[i + 2] == "struct":
                brace = i + 3
                for k in range(brace + 1, self.close(brace)):
                    if self.kind[k] == "id" and self.line(k) > self.line(k - 1) and self.line(k + 1) == self.line(k) and (of := self.named_type(k + 1, k + 4)):
                        self.fields[name, self.text[k]] = of
        elif t in ("const", "var") and self.kind[i + 1] == "id":
            if not self.stack:
                self.add("symbol", "const", name, i + 1)
            elif t == "var":
                inner = self.stack[-1]
                if of := self.named_type(i + 2, i + 6):
                    inner.types[name] = of
        elif name == ":=" and last != ".":
            self.bind(i, i + 1)

    def run(self) -> list[tuple]:
        step = {"rust": self.rust, "typescript": self.typescript, "go": self.go}[self.language]
        ends: list[int] = []
        for i in range(len(self.tokens)):
            t, k = self.text[i], self.kind[i]
            while ends and ends[-1] <= i:
                ends.pop()
                self.stack.pop()
            while self.spans and self.spans[0][0] <= i:
                _, end, scope = self.spans.pop(0)
                self.stack.append(scope)
                ends.append(end)
            if k == "p":
                if t == "{":
                    self.stack.append(self.pending.pop(i, None) or Scope("block"))
                elif t == "}" and self.stack and not ends:
                    self.stack.pop()
                elif t == "}" and self.stack and len(self.stack) > len(ends):
                    self.stack.pop()
                elif t in ("(", "=>") and self.language == "typescript" and i not in self.pending:
                    if t == "(" and self.text[self.close(i) + 1] in ("=>", ":") and self.text[i - 1] not in (")",) and self.kind[i - 1] != "id":
                        self.arrow(i, None)
                continue
            if k != "id":
                continue
            step(i)
            if self.language == "rust" and self.text[i + 1] == "!" and self.text[i + 2] in OPENING and t != "macro_rules":
                self.quiet = max(self.quiet, self.close(i + 2))
            if i > self.quiet:
                self.call(i)
            if self.text[i + 1] == "<" and i + 1 not in self.no_generics and self.language != "go":
                self.arguments(i + 1)
            elif self.text[i + 1] == "::" and self.text[i + 2] == "<":
                self.arguments(i + 2)
        for at, base, name in self.late:
            if of := self.fields.get((base, name)):
                self.rows[at] = (*self.rows[at][:-1], of)
        # the head of a method has the form of a call
        return [r for r in self.rows if r[1] != "calls" or (r[3], r[4]) not in self.heads]

    def arguments(self, i: int) -> None:
        """References to the plain type arguments at ``i``."""
        after = self.generics(i)
        if after == i or not (self.text[i - 1][:1].isupper() or self.text[i - 1] == "::" or self.text[after] in ("(", ")", ";", ",", "{", "=")):
            return
        for lo, hi in self.split(i + 1, after - 1):
            self.refer(lo, hi, "generic_arg")


def read(content: str, language: str, row) -> list[tuple]:
    """Symbols and raw edges of one file; ``row`` makes a finding of its fields."""
    return Reader(content, language, row).run()
