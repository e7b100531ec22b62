"""Source files as shapes: sequences of token classes, cut at brackets and statements.

A shape is a string of one character per token.  Bracketed parts are shapes of
their own and leave one character behind, so shapes stay short and recur all
over a corpus.  A segment is (goal, shape, places): the goal names what the
shape has to derive, places are the offsets of its tokens in the file.

Nothing is judged here: what does not lex leaves a character that no grammar
knows, and brackets without a partner stay in the shape.
"""

from __future__ import annotations

import bisect
import functools
import re
import unicodedata

from codeweft.llm.chart import JAVASCRIPT, PYTHON

Segment = tuple[str, str, list[int]]
#: Characters from this one on stand for a line that begins at one of the indentations of the file.
_INDENT = 0xE000
_FIRST_INDENT = chr(_INDENT)
_CLOSE = {"(": ")", "[": "]", "{": "}"}


class _Classes(dict):
    """Token text to class, remembered; bounded, as names are without number."""

    def __init__(self, fixed: dict[str, str], rule):
        super().__init__(fixed)
        self.fixed, self.rule = fixed, rule

    def __missing__(self, token: str) -> str:
        if len(self) > 300_000:
            self.clear()
            self.update(self.fixed)
        out = self.rule(token)
        if len(token) < 80:
            self[token] = out
        return out


def _remembered(f):
    """A pure function of a shape, remembered; bounded."""
    seen: dict[str, str] = {}

    def g(shape: str) -> str:
        out = seen.get(shape)
        if out is None:
            if len(seen) > 100_000:
                seen.clear()
            out = f(shape)
            if len(shape) < 200:
                seen[shape] = out
        return out

    return g


_PERIOD = re.compile(r"((?:[^,]*,){1,6}?)\1{2,}")
_STATEMENTS = re.compile(r"((?:[dchfwMK@]|[dchfwMK][Bb]|i[Bb]|;)+?[Bb;])\1+")


@_remembered
def _thin_list(shape: str) -> str:
    return _PERIOD.sub(r"\1\1", shape)


def thin(goal: str, shape: str) -> str:
    """A shorter shape that derives if and only if this one does: list elements over and over count twice, statements once.

    Lists go through modes (places, names, …) that only move on, so the same
    elements a third time change nothing; whole statements one after the other
    have no bearing on each other.
    """
    if goal in ("block", "file", "cases"):
        return _STATEMENTS.sub(r"\1", re.sub(";+", ";", shape)) if len(shape) > 8 or ";;" in shape else shape
    return _thin_list(shape) if shape.count(",") > 2 else shape


# ---- Python -----------------------------------------------------------------
# The classes of keywords and operators.
PY_CLASSES = {
    "if": "i", "elif": "l", "else": "e", "while": "w", "for": "f", "in": "n", "try": "t", "except": "x", "finally": "y", "with": "h",
    "as": "s", "def": "d", "class": "c", "return": "r", "raise": "R", "yield": "Y", "import": "I", "from": "F", "global": "g", "nonlocal": "g",
    "del": "D", "assert": "T", "pass": "k", "break": "k", "continue": "k", "lambda": "L", "not": "!", "and": "&", "or": "&", "is": "z",
    "await": "a", "async": "A", "None": "C", "True": "C", "False": "C", "...": "C",
    "match": "M", "case": "K", "type": "X",
    "+": "-", "-": "-", "~": "~", "*": "*", "**": "P", "/": "/", "//": "%", "%": "%", "@": "@", "|": "|", "^": "%", "&": "%", "<<": "%", ">>": "%",
    "<": "<", ">": "<", "==": "<", "!=": "<", "<=": "<", ">=": "<", "=": "=", ":=": "W", "->": ">", ",": ",", ":": ":", ".": ".", ";": ";",
    "(": "(", ")": ")", "[": "[", "]": "]", "{": "{", "}": "}",
} | {op + "=": "G" for op in ("+", "-", "*", "**", "/", "//", "%", "@", "|", "^", "&", "<<", ">>")}
_PY_STRING = r"(?:[rRbBuUfF]{1,2})?(?:'''(?:[^\\']|\\.|'(?!''))*'''|\"\"\"(?:[^\\\"]|\\.|\"(?!\"\"))*\"\"\"|''(?!')|'(?:[^'\\\n]|\\.)+'|\"\"(?!\")|\"(?:[^\"\\\n]|\\.)+\")"
_PY_TOKEN = re.compile(
    _PY_STRING
    + r"|#[^\n]*|\\\n|\n[ \t\f]*|[ \t\f]+|[^\W\d]\w*"
    r"|(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*)?\.\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*\.?(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)(?:(?!(?:if|else|and|or|in|is|not|for)\b)[\w]+)?"
    r"|\.\.\.|\*\*=|//=|<<=|>>=|:=|->|==|!=|<=|>=|[-+*/%@|&^]=|\*\*|//|<<|>>|[-+*/%@|&^~<>=,:.;()\[\]{}]|.",
    re.S,
)
_PY_QUICK = re.compile(r"[ \t\f]*(" + _PY_TOKEN.pattern + ")", re.S)
_SOFT_LINE = re.compile(r"(?:^|[:;])[ \t]*(?:match|case|type)\b", re.M)
_PY_NUMBER = re.compile(r"(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:[1-9](?:_?\d)*|0(?:_?0)*)|(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*[jJ]?|[jJ]))\Z")
_PY_BAD_ESCAPE = re.compile(r"(?<!\\)(?:\\\\)*\\(?:x(?![0-9a-fA-F]{2})|u(?![0-9a-fA-F]{4})|U(?!00(?:0[0-9a-fA-F]|10)[0-9a-fA-F]{4})|N(?!\{[^}]+\}))")
_PY_BAD_BYTE = re.compile(r"(?<!\\)(?:\\\\)*\\x(?![0-9a-fA-F]{2})")
_PY_NAMED = re.compile(r"(?<!\\)(?:\\\\)*\\N\{([^}]+)\}")
_F_OPEN = re.compile(r"(?<!\w)(?:[fF][rR]?|[rR][fF])('''|\"\"\"|'|\")")
_F_PLAIN = re.compile(r"[^{}\\'\"\n]+")
_F_STRING = re.compile(_PY_STRING)
_SOFT = {
    "M": re.compile(r"match\b(?![ \t]*[=.,:)\]])[^\n]*:[ \t]*(?:#[^\n]*)?$", re.M),
    "K": re.compile(r"case\b(?![ \t]*[=.,:)\]])(?:[^\n]*:|[^\n]*[(\[{,|][ \t]*(?:#[^\n]*)?$)", re.M),
    "X": re.compile(r"type[ \t]+[^\W\d]\w*[ \t]*[=\[]"),
}


def _known_name(name: str) -> bool:
    try:
        return len(unicodedata.lookup(name)) == 1
    except KeyError:
        return False


def _py_string(token: str) -> str:
    prefix = token[: len(token) - len(token.lstrip("rRbBuUfF"))].lower()
    if prefix not in ("", "r", "b", "u", "f", "rb", "br", "rf", "fr"):
        return "?"
    if "b" in prefix:
        return "?" if not token.isascii() or ("r" not in prefix and "\\" in token and _PY_BAD_BYTE.search(token)) else "β"
    if "r" not in prefix and "\\" in token and (_PY_BAD_ESCAPE.search(token) or not all(map(_known_name, _PY_NAMED.findall(token)))):
        return "?"
    return "S"


def _py_class(token: str) -> str:
    c = token[0]
    if c == "\n":
        return "\n"
    if c == "#" or c in " \t\f" or token == "\\\n":
        return ""
    if token[-1] in "'\"" and len(token) > 1:
        return _py_string(token)
    if c.isdigit() or (c == "." and len(token) > 1):
        return "?" if not _PY_NUMBER.match(token) else "J" if token[-1] in "jJ" else "0"
    if c == "_" or c.isalpha():
        return "N" if token.isidentifier() else "?"
    return "?"


_PY = _Classes(PY_CLASSES, _py_class)
_PY_PLAIN = frozenset(PY_CLASSES.values()) - set("([{)]}MKXi") | set("N0J?")
_PY_ATOM_END = frozenset("N0JSβCp12345qbuv§?")


@_remembered
def _py_paren(body: str) -> str:
    """1: one target in brackets, 2: several, 4: several with a star, p: no target."""
    if body in ("2", "3", "4", "5"):
        return "2" if body in "23" else "4"
    for goal, kind in (("one_target", "1"), ("some_targets", "2"), ("some_star_targets", "4")):
        if PYTHON.accepts(goal, body):
            return kind
    return "p"


@_remembered
def _py_list(body: str) -> str:
    for goal, kind in (("list_targets", "3"), ("list_star_targets", "5")):
        if PYTHON.accepts(goal, body):
            return kind
    return "q"


def _py_close(sign: str, body: str, before: str, pattern: bool) -> tuple[str, str]:
    """(goal, character left) of a bracketed part; no goal: it derives, as its kind was told by a grammar. before: the last tokens before it."""
    last = before[-1:]
    if pattern:
        return {"(": ("pat_args", "u") if last == "N" else ("pat_seq", "p"), "[": ("pat_seq", "q"), "{": ("pat_map", "b")}[sign]
    if sign == "(":
        if last and last in _PY_ATOM_END:
            defined = before[-2:-1] == "d" or (last == "§" and before[-3:-2] == "d")
            return ("params", "m") if defined else ("args", "u")
        if last == "I":
            return "names", "o"
        if last == "h" and "s" in body and not PYTHON.accepts("paren", body):
            return "withs", "p"
        kind = _py_paren(body)
        return ("paren" if kind == "p" else "", kind)
    if sign == "[":
        if last and last in _PY_ATOM_END:
            named = last == "N" and len(before) > 1 and before[-2] in "dcX"
            return ("typeparams", "§") if named else ("index", "v")
        kind = _py_list(body)
        return ("list" if kind == "q" else "", kind)
    return "braces", "b"


def _f_fields(text: str, at: int, out: list[tuple[int, int]]) -> int:
    """The end of the f-string that begins at ``at``; its replacement fields go to ``out``. -1: it is none."""
    m = _F_OPEN.match(text, at)
    quote, raw = m.group(1), "r" in m.group().lower()
    return _f_body(text, m.end(), quote, raw, out, False)


def _f_body(text: str, i: int, quote: str, raw: bool, out: list, spec: bool) -> int:
    """Literal text up to the closing quote, or up to the } of a format specification."""
    n = len(text)
    while i < n:
        m = _F_PLAIN.match(text, i)
        if m:
            i = m.end()
            continue
        c = text[i]
        if text.startswith(quote, i):
            return -1 if spec else i + len(quote)
        if c == "{":
            if not spec and text.startswith("{{", i):
                i += 2
                continue
            i = _f_field(text, i + 1, quote, raw, out)
            if i < 0:
                return -1
        elif c == "}":
            if spec:
                return i
            if not text.startswith("}}", i):
                return -1
            i += 2
        elif c == "\\" and i + 1 < n:
            if text.startswith("\\N{", i) and not raw:
                i = text.find("}", i) + 1 or n
            else:
                i += 1 if text[i + 1] in "{}" else 2
        elif c == "\n" and len(quote) == 1:
            return -1
        else:
            i += 1
    return -1


def _f_field(text: str, i: int, quote: str, raw: bool, out: list) -> int:
    start, depth, n = i, 0, len(text)
    while i < n:
        c = text[i]
        if c in "'\"" or (c in "rRbBuUfF" and not (i and (text[i - 1].isalnum() or text[i - 1] == "_")) and _F_STRING.match(text, i)):
            if _F_OPEN.match(text, i):
                i = _f_fields(text, i, [])
                if i < 0:
                    return -1
                continue
            m = _F_STRING.match(text, i)
            if not m:
                return -1
            i = m.end()
            continue
        if c in "([{":
            depth += 1
        elif c in ")]" or (c == "}" and depth):
            depth -= 1
            if depth < 0:
                return -1
        elif not depth and (c in "}:" or (c == "!" and text[i + 1 : i + 2] != "=") or (c == "=" and text[i - 1] not in "=!<>" and text[i + 1 : i + 2] != "=" and re.match(r"=\s*[!:}]", text[i : i + 200]))):
            break
        elif c == "#" and len(quote) == 1:
            return -1
        i += 1
    if not text[start:i].strip():
        return -1
    out.append((start, i))
    if text[i : i + 1] == "=":
        i += 1
        while i < n and text[i].isspace():
            i += 1
    if text[i : i + 1] == "!":
        m = re.compile(r"![sra]\s*(?=[:}])").match(text, i)
        if not m:
            return -1
        i = m.end()
    if text[i : i + 1] == ":":
        i = _f_body(text, i + 1, quote, raw, out, True)
        if i < 0:
            return -1
    return i + 1 if text[i : i + 1] == "}" else -1


@functools.lru_cache(4096)
def _width(blanks: str) -> tuple[int, int]:
    """Columns of an indentation with tabs to 8, and with tabs as one: what the language compares."""
    blanks = blanks.rsplit("\f", 1)[-1]
    return len(blanks.expandtabs(8)), len(blanks)


def python_segments(text: str, quick: bool = False) -> list[Segment]:
    """Segments of a Python file: one per bracketed part, statement line and block; with ``quick`` the places are not told."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    first = 1 if text[:1] == "﻿" else 0
    out: list[Segment] = []
    lines = _quick_lines(text, first, out) if quick else None
    if lines is None:
        out.clear()
        lines = _python_lines(text, first, len(text), out, False)
    _python_blocks(lines, out)
    if "\0" in text:
        out.append(("simple", "?", [text.index("\0")]))
    return out


_PIECES = re.compile(r"[^()\[\]{}\n]+|.", re.S)
_SIDE_BY_SIDE = re.compile(r"([Sβ])\1+")
_NAMES_ONLY = str.maketrans("MKX", "NNN")


def _quick_lines(text: str, at: int, out: list[Segment]) -> list | None:
    """What ``_python_lines`` gives of a file, without places; None if it takes these to tell: brackets without a partner, match, case and type."""
    if ("match" in text or "case" in text or "type" in text) and _SOFT_LINE.search(text, at):
        return None
    tokens = _PY_QUICK.findall(text, at)
    if "f'" in text or 'f"' in text or "F" in text or "fr" in text or "fR" in text:
        for t in [t for t in tokens if t[0] in "fFrR" and t[-1] in "'\""]:
            if _F_OPEN.match(t):
                parts = _F_MEMO.get(t)
                if parts is None:
                    fields: list[tuple[int, int]] = []
                    if _f_fields(t, 0, fields) != len(t):
                        return None
                    parts = []
                    for a, b in fields:
                        _python_lines(t, a, b, parts, True)
                    if len(_F_MEMO) > 50_000:
                        _F_MEMO.clear()
                    _F_MEMO[t] = parts
                out += parts
    breaks = iter([t for t in tokens if t[0] == "\n"])
    shape = "".join(map(_PY.__getitem__, tokens)).translate(_NAMES_ONLY)
    if "SS" in shape or "ββ" in shape:
        shape = _SIDE_BY_SIDE.sub(r"\1", shape)
    lines: list = []
    frames: list[tuple[str, str]] = []
    cur, blanks = "", text[at : len(text) - len(text[at:].lstrip(" \t\f"))]
    for piece in _PIECES.findall(shape):
        c = piece[0]
        if c == "\n":
            if frames:
                cur += c
                next(breaks)
            else:
                if cur:
                    _python_line(cur, range(len(cur)), _width(blanks), out, lines)
                    cur = ""
                blanks = next(breaks)[1:]
        elif c in "([{":
            frames.append((c, cur))
            cur = ""
        elif c in ")]}":
            if not frames or _CLOSE[frames[-1][0]] != c:
                return None
            sign, outer = frames.pop()
            if "\n" in cur:
                cur = _SIDE_BY_SIDE.sub(r"\1", cur.replace("\n", ""))
            goal, kind = _py_close(sign, cur, outer[-60:].replace("\n", "")[-3:], False)
            if goal:
                out.append((goal, cur, []))
            cur = outer + kind
        else:
            cur += piece
    if frames:
        return None
    if cur:
        _python_line(cur, range(len(cur)), _width(blanks), out, lines)
    return lines


#: Segments of the fields of f-strings seen.
_F_MEMO: dict[str, list[Segment]] = {}


def _placed_tokens(text: str, at: int, end: int, out: list[Segment]):
    """(offset, token) of text[at:end]; the fields of f-strings go to ``out``."""
    pos = at
    while pos < end:
        if text[pos] in "fFrR" and _F_OPEN.match(text, pos) and not (pos and (text[pos - 1].isalnum() or text[pos - 1] == "_")):
            fields: list[tuple[int, int]] = []
            stop = _f_fields(text, pos, fields)
            if 0 < stop <= end:
                for a, b in fields:
                    _python_lines(text, a, b, out, True)
                yield pos, text[pos:stop] if stop - pos < 400 and "\n" not in text[pos:stop] else "f''"
                pos = stop
                continue
            m = _PY_TOKEN.match(text, pos, end)
            yield pos, "?" if m.group()[-1] in "'\"" else m.group()
            pos = m.end()
            continue
        m = _PY_TOKEN.match(text, pos, end)
        yield pos, m.group()
        pos = m.end()


def _python_lines(text: str, at: int, end: int, out: list[Segment], field: bool) -> list[tuple[tuple[int, int], str, bool, int]]:
    """Lexes text[at:end]; its segments go to ``out``. Gives (indentation, kind, opens a block, offset) per statement line; a field is one expression."""
    widths: list[tuple[int, int]] = []
    known: dict[tuple[int, int], str] = {}

    def indent(blanks: str) -> str:
        w = _width(blanks)
        if w not in known:
            known[w] = chr(_INDENT + len(widths))
            widths.append(w)
        return known[w]

    lines: list[tuple[tuple[int, int], str, bool, int]] = []
    cur: list[str] = []
    off: list[int] = []
    frames: list[tuple[str, int, list[str], list[int]]] = []
    line_at = indent("" if field else text[at : at + len(text[at:end]) - len(text[at:end].lstrip(" \t\f"))])
    pattern = False  # in the pattern of a case line

    def finish(indentation: str) -> None:
        nonlocal cur, off, pattern
        if cur:
            if field:
                out.append(("field", "".join(cur), off))
            else:
                _python_line("".join(cur), off, widths[ord(indentation) - _INDENT], out, lines)
        cur, off, pattern = [], [], False

    def inlined(k: int) -> None:
        """Brackets from the k-th open one on have no partner: they stay, and their lines are lines of their own."""
        nonlocal cur, off
        parts_c, parts_o = [], []
        for o, p, c, f in frames[k:]:
            parts_c.append((c, f, o, p))
        last_c, last_o = cur, off
        cur, off = parts_c[0][0], parts_c[0][1]
        for j, (_, _, o, p) in enumerate(parts_c):
            cur.append(o)
            off.append(p)
            nxt_c, nxt_o = (parts_c[j + 1][0], parts_c[j + 1][1]) if j + 1 < len(parts_c) else (last_c, last_o)
            cur += nxt_c
            off += nxt_o
        del frames[k:]

    def flat() -> None:
        """Lines that were kept in a bracket now found to have no partner."""
        nonlocal cur, off, line_at
        if frames or not any(c >= _FIRST_INDENT for c in cur):
            return
        all_c, all_o = cur, off
        cur, off = [], []
        for c, o in zip(all_c, all_o):
            if c >= _FIRST_INDENT:
                finish(line_at)
                line_at = c
            else:
                cur.append(c)
                off.append(o)

    classes = _PY
    for pos, tok in _placed_tokens(text, at, end, out):
        c = classes[tok]
        if c in _PY_PLAIN:
            cur.append(c)
            off.append(pos)
            continue
        if not c:
            continue
        if c == "\n":
            if frames:
                cur.append(indent(tok[1:]))
                off.append(pos)
            elif not field:
                finish(line_at)
                line_at = indent(tok[1:])
            continue
        if c in "([{":
            frames.append((c, pos, cur, off))
            cur, off = [], []
            continue
        if c in "MKX":
            start = not frames and not cur and not field
            hard = start and _SOFT[c].match(text, pos)
            pattern = bool(hard) and c == "K"
            c = c if hard else "N"
        elif c in "Sβ" and cur and cur[-1] == c:
            continue  # strings side by side are one
        elif c == "i" and pattern and not frames:
            pattern = False
        if c in ")]}":
            k = len(frames) - 1
            while k >= 0 and _CLOSE[frames[k][0]] != c:
                k -= 1
            if k < 0:
                cur.append(c)
                off.append(pos)
                continue
            if k < len(frames) - 1:
                inlined(k + 1)
            o, p, outer_c, outer_o = frames.pop()
            if cur and max(cur) >= _FIRST_INDENT:
                keep = [j for j, x in enumerate(cur) if x < _FIRST_INDENT]
                cur, off = [cur[j] for j in keep], [off[j] for j in keep]
                merged = [j for j in range(len(cur)) if not (j and cur[j] in "Sβ" and cur[j] == cur[j - 1])]
                if len(merged) < len(cur):
                    cur, off = [cur[j] for j in merged], [off[j] for j in merged]
            body = "".join(cur)
            goal, kind = _py_close(o, body, "".join(x for x in outer_c[-60:] if x < _FIRST_INDENT)[-3:], pattern)
            if goal:
                out.append((goal, body, off or [p]))
            cur, off = outer_c, outer_o
            cur.append(kind)
            off.append(p)
            continue
        cur.append(c)
        off.append(pos)
    if frames:
        inlined(0)
        if field:
            keep = [j for j, x in enumerate(cur) if x < _FIRST_INDENT]
            cur, off = [cur[j] for j in keep], [off[j] for j in keep]
        flat()
    finish(line_at)
    return lines


def _python_line(line: str, off: list[int], width: tuple[int, int], out: list[Segment], lines: list) -> None:
    colon = _header_colon(line)
    if colon is not None:
        out.append(("header", line[: colon + 1], off[: colon + 1]))
        kind = line[1] if line[0] == "A" and len(line) > 1 else line[0]
        if kind == "x" and line[1:2] == "*":
            kind = "X"
        rest = line[colon + 1 :]
        lines.append((width, kind, not rest, off[0]))
        if not rest:
            return
        line, off = rest, off[colon + 1 :]
    elif line[0] == "@":
        out.append(("header", line, off))
        lines.append((width, "@", False, off[0]))
        return
    else:
        lines.append((width, ";", False, off[0]))
    a = 0
    while a < len(line):
        b = line.find(";", a)
        b = len(line) if b < 0 else b
        if b > a or b < len(line):  # an empty part derives from nothing
            out.append(("simple", line[a:b], off[a:b] or [off[b]]))
        a = b + 1


def _header_colon(line: str) -> int | None:
    """Where the colon of a compound statement's header stands, or None."""
    c = line[1:2] if line[:1] == "A" else line[:1]
    if not c or c not in "ilewftxyhdcMK":
        return None
    depth = 0
    for i, ch in enumerate(line):
        if ch == "L":
            depth += 1
        elif ch == ":":
            if not depth:
                return i
            depth -= 1
    return None


def _python_blocks(lines: list[tuple[tuple[int, int], str, bool, int]], out: list[Segment]) -> None:
    """One segment per block: its statements as ';' (simple), '@' or a header's letter followed by B (a block) or b (a body in its line).

    A missing block is left out, an unexpected indentation leaves '>', a dedent
    to a depth that no line had, tabs and blanks that do not compare, and more
    than 99 levels leave '<'.
    """
    stack: list[tuple[tuple[int, int], list[str], list[int], str]] = [((0, 0), [], [], "file")]
    want = ""
    for width, kind, opens, at in lines:
        top = stack[-1][0]
        if width[0] > top[0]:
            if want:
                stack[-1][1].append("B")
            else:
                stack[-1][1].append(">")
            stack[-1][2].append(at)
            if width[1] <= top[1] or len(stack) > 99:
                stack[-1][1].append("<")
                stack[-1][2].append(at)
            stack.append((width, [], [], "cases" if want == "M" else "block"))
        else:
            while width[0] < stack[-1][0][0]:
                _, s, o, goal = stack.pop()
                out.append((goal, "".join(s), o))
            if width != stack[-1][0]:
                stack[-1][1].append("<")
                stack[-1][2].append(at)
                if width[0] > stack[-1][0][0]:
                    stack.append((width, [], [], "block"))
        want = kind if opens else ""
        stack[-1][1].append(kind)
        stack[-1][2].append(at)
        if kind not in ";@" and not opens:
            stack[-1][1].append("b")
            stack[-1][2].append(at)
    while stack:
        _, s, o, goal = stack.pop()
        if s:
            out.append((goal, "".join(s), o))


# ---- JavaScript ---------------------------------------------------------------
# The classes of keywords and operators.
JS_CLASSES = {
    "function": "f", "class": "c", "const": "κ", "let": "v", "var": "v", "if": "i", "else": "e", "for": "o", "while": "w", "do": "d",
    "return": "r", "throw": "R", "break": "k", "continue": "k", "debugger": "k", "switch": "s", "case": "K", "default": "D", "try": "t",
    "catch": "x", "finally": "y", "new": "n", "delete": "u", "void": "u", "typeof": "u", "in": "j", "instanceof": "j", "import": "I", "export": "E",
    "extends": "X", "super": "C", "this": "C", "null": "C", "true": "C", "false": "C", "async": "A", "await": "a", "yield": "Y", "enum": "\x7f", "with": "\x7f",
    "=>": ">", "=": "=", "++": "P", "--": "P", "+": "-", "-": "-", "!": "!", "~": "!", "*": "*", "**": "π", "...": "Z", ".": ".", "?.": "Q", "?": "?", ":": ":",
    "??": "ν", "&&": "ω", "||": "ω", ",": ",", ";": ";", "(": "(", ")": ")", "[": "[", "]": "]", "{": "{", "}": "}",
} | {op: "%" for op in ("/", "%", "<", ">", "<=", ">=", "==", "!=", "===", "!==", "&", "|", "^", "<<", ">>", ">>>")} | {
    op + "=": "G" for op in ("+", "-", "*", "/", "%", "**", "&&", "||", "??", "&", "|", "^", "<<", ">>", ">>>")
}
#: In JavaScript shapes this stands for a token that is none.
_JS_WRONG = "\x7f"
_JS_TOKEN = re.compile(
    r"//[^\n\u2028\u2029]*|/\*(?:[^*]|\*(?!/))*\*/|\n|[^\S\n]+|\ufeff+"
    r"|'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\""
    r"|#?(?:[^\W\d]|[$])[\w$\u200c\u200d]*|(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*)?\.\d[\d_]*(?:[eE][+-]?\d+)?|\d[\d_]*\.?(?:[eE][+-]?\d+)?)n?[\w$]*"
    r"|>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|\+\+|--|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\*\*|<<|>>|[-+*/%&|^]=|[-+*/%&|^~!<>=?:,.;()\[\]{}]|.",
    re.S,
)
_JS_QUICK = re.compile(r"[^\S\n]*(" + _JS_TOKEN.pattern + ")?", re.S)
_JS_REGEX = re.compile(r"/(?![*/])((?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+)/([A-Za-z]*)")
_JS_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)
_JS_NUMBER = re.compile(r"(?:0[xX][0-9a-fA-F]+(?:_[0-9a-fA-F]+)*n?|0[bB][01]+(?:_[01]+)*n?|0[oO][0-7]+(?:_[0-7]+)*n?|(?:0|[1-9]\d*(?:_\d+)*)n?|(?:(?:0|[1-9]\d*(?:_\d+)*)?\.\d+(?:_\d+)*|(?:0|[1-9]\d*(?:_\d+)*)\.?)(?:[eE][+-]?\d+)?)\Z")
_JS_BAD_ESCAPE = re.compile(r"(?<!\\)(?:\\\\)*\\(?:x(?![0-9a-fA-F]{2})|u(?!\{[0-9a-fA-F]+\}|[0-9a-fA-F]{4})|0[0-9]|[1-9])")
_JS_NEXT = re.compile(r"(?:\s|//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/)*(=>|.)?", re.S)
_JS_HEIR = re.compile(r"c[NA]?(?:X[NCpA1](?:\.[a-zA-Z]|[gbS])*)?$")


def _js_class(token: str) -> str:
    c = token[0]
    if c == "\n":
        return "\n"
    if c == "\ufeff" or c.isspace() or token.startswith("//"):
        return ""
    if token.startswith("/*"):
        return "\n" if "\n" in token else ""
    if c in "'\"" and len(token) > 1:
        return _JS_WRONG if "\\" in token and _JS_BAD_ESCAPE.search(token) else "S"
    if c.isdigit() or (c == "." and len(token) > 1):
        return "0" if _JS_NUMBER.match(token) else _JS_WRONG
    if c.isalpha() or c in "_$" or (c == "#" and len(token) > 1):
        return "N"
    return _JS_WRONG


_JS = _Classes(JS_CLASSES, _js_class)
_JS_PLAIN = frozenset("=.S0-*!>πνωZQP")
_JS_OPERAND = frozenset("NCA0Spqbg12345O")


@_remembered
def _js_array(body: str) -> str:
    """q: an array, 4: a pattern, 2: either, ? neither."""
    a, p = JAVASCRIPT.accepts("array", body), JAVASCRIPT.accepts("array_pattern", body)
    return "2" if a and p else "q" if a else "4" if p else "?"


@_remembered
def _js_object(body: str) -> str:
    """O: an object, 5: a pattern, 3: either, ? neither."""
    a, p = JAVASCRIPT.accepts("object", body), JAVASCRIPT.accepts("object_pattern", body)
    return "3" if a and p else "O" if a else "5" if p else "?"


def _js_regex(body: str, flags: str) -> bool:
    """Do the brackets of a regular expression match, do its quantifiers stand after something, are its flags known?"""
    depth, i, atom = 0, 0, False
    while i < len(body):
        c = body[i]
        if c == "\\":
            i, atom = i + 1, True
        elif c == "[":
            j = i + 1
            while body[j] != "]":
                j += 2 if body[j] == "\\" else 1
            i, atom = j, True
        elif c == "(":
            depth, atom = depth + 1, False
            m = re.match(r"\(\?(?::|=|!|<=|<!|<[A-Za-z_$][\w$]*>)", body[i:])
            if m:
                i += m.end() - 1
            elif body[i + 1 : i + 2] == "?":
                return False
        elif c == ")":
            depth, atom = depth - 1, True
            if depth < 0:
                return False
        elif c in "*+?":
            if not atom:
                return False
            atom = body[i + 1 : i + 2] == "?"  # lazy
        else:
            atom = c not in "|^"
        i += 1
    return not depth and len(set(flags)) == len(flags) and set(flags) <= set("dgimsuyv")


class _Frame:
    """An open bracket: its sign, offset, what it holds so far, and what kind of part it is."""

    __slots__ = ("sign", "at", "chars", "places", "kind", "inside", "asked", "names", "declares", "awaits", "called_at", "expression")

    def __init__(self, sign: str, at: int, kind: str, inside: bool):
        self.sign, self.at, self.kind, self.inside = sign, at, kind, inside
        self.chars: list[str] = []
        self.places: list[int] = []
        self.asked: list[int] = []  # question marks without their colon
        self.names: dict[str, str] = {}  # declared names by the word that declares them
        self.declares, self.awaits, self.called_at, self.expression = "", False, -1, False

    def last(self, k: int = 1) -> str:
        """The k-th last token, line ends aside."""
        for c in reversed(self.chars):
            if c != "\n":
                k -= 1
                if not k:
                    return c
        return ""


# Words before the name of a member.
_JS_MODIFIERS = frozenset(("static", "get", "set", "accessor"))
_BLOCKS = ("block", "switch", "module")


def javascript_segments(text: str) -> list[Segment]:
    """Segments of a JavaScript module: one per bracketed part, class member and statement."""
    at = 1 if text[:1] == "﻿" else 0
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if text.startswith("#!", at):
        at = text.find("\n") if "\n" in text else len(text)
    out: list[Segment] = []
    frames = [_Frame("", 0, "module", False)]
    n = len(text)

    def put(c: str, pos: int) -> None:
        frames[-1].chars.append(c)
        frames[-1].places.append(pos)

    def template(pos: int, i: int) -> int:
        """Past the literal part of a template from i on: to its end, or into a hole."""
        i = _JS_TEMPLATE.match(text, i).end()
        if i < n and text[i] == "`":
            put("S", pos)
            return i + 1
        if i < n and text[i] == "$":
            frames.append(_Frame("$", pos, "hole", frames[-1].inside))
            return i + 2
        put(_JS_WRONG, pos)
        return n

    def fold(k: int) -> None:
        """Frames from the k-th on have no partner: their tokens go into the one below."""
        f = frames[k - 1]
        for g in frames[k:]:
            f.chars += [_JS_WRONG if g.sign == "$" else g.sign, *g.chars]
            f.places += [g.at, *g.places]
        del frames[k:]

    step = _JS_QUICK.match
    while at < n:
        m = step(text, at)
        tok = m.group(1)
        if tok is None:
            break
        pos, at = m.start(1), m.end()
        c = _JS[tok]
        if not c:
            continue
        f = frames[-1]
        if c in _JS_PLAIN or (c == "N" and not f.declares and tok not in _JS_MODIFIERS and not (f.chars and f.chars[-1] in "c\n" and f.last() == "c")):
            f.chars.append(c)
            f.places.append(pos)
            continue
        if c == ",":
            if f.asked:
                f.asked.clear()
            f.awaits = f.declares != ""
            f.chars.append(c)
            f.places.append(pos)
            continue
        if tok == "`":
            at = template(pos, pos + 1)
            continue
        if tok[0] == "/" and tok in ("/", "/="):
            p = f.last()
            divides = (p in _JS_OPERAND and p) or (p == "P" and f.last(2) in _JS_OPERAND and f.last(2)) or (p in "BW" and p and f.called_at == len(f.chars) - 1)
            m = None if divides else _JS_REGEX.match(text, pos)
            if m:
                put("S" if _js_regex(*m.groups()) else _JS_WRONG, pos)
                at = m.end()
                continue
        p = f.last()
        if c == "\n":
            if f.chars:
                put(c, pos)
            if p != ",":
                f.declares = ""
            continue
        if tok in _JS_MODIFIERS and f.kind in ("class", "object") and p != "=" and p != ":":
            nxt = _JS_NEXT.match(text, at).group(1) or ""
            c = "N" if nxt in ("(", "=", ";", "}", ",", ":", "") else "µ"
        elif tok == "with" and p == "S":
            c = "N"  # attributes of an import
        elif tok[0].isalpha() and c != "N":
            if p and p in ".Q":
                c = "N"
            elif f.kind == "specs":
                c = "N"
            elif c == "A" or f.kind == "object" or f.kind == "class":
                nxt = _JS_NEXT.match(text, at).group(1) or ""
                key = f.kind == "object" and (p in ("", ",") or (p in "µA*" and nxt == "(")) or f.kind == "class" and (p in ("", ";", "B") or f.chars[-1:] == ["\n"] or (p in "µA*" and nxt in ("(", "=", ";")))
                if c == "A":
                    if nxt in (":", ",", "}", "=", "", ")", ";", ".") or (key and nxt == "("):
                        c = "A" if nxt == "=" and f.kind not in ("object", "class") else "N"
                elif key and c != "I":
                    c = "N"
        if f.declares and f.awaits and c == "N":
            f.awaits = False
            if f.kind in _BLOCKS:
                seen = f.names.get(tok)
                if seen and not (seen == "var" and f.declares == "var"):
                    c = _JS_WRONG
                f.names[tok] = f.declares
        elif c == "N" and p == "c" and f.kind in _BLOCKS and f.last(2) in ("", ";", "B", "E", "D", "}"):
            if tok in f.names:
                c = _JS_WRONG
            f.names[tok] = "class"
        if c in "vκ":
            f.declares, f.awaits = tok, True
        elif c == ",":
            f.asked.clear()
            f.awaits = bool(f.declares)
        elif c == ";":
            f.asked.clear()
            f.declares = ""
        elif c == "?":
            f.asked.append(len(f.chars))
        elif c == ":" and f.asked:
            f.chars[f.asked.pop()] = "¿"
            c = "¦"
        if c in "([{":
            frames.append(_js_open(f, c, pos))
            continue
        if c in ")]}":
            k = len(frames) - 1
            while k and _CLOSE.get(frames[k].sign, "}" if frames[k].sign == "$" else "") != c:
                k -= 1
            if not k:
                put(c, pos)
                continue
            fold(k + 1)
            g = frames.pop()
            if g.sign == "$":
                chars, places = _no_breaks(g.chars, g.places)
                out.append(("expr", "".join(chars), places or [g.at]))
                at = template(g.at, at)
                continue
            put(_js_close(g, frames[-1], text, at, out), g.at)
            if g.kind == "class" or g.expression:
                frames[-1].called_at = len(frames[-1].chars) - 1
            continue
        put(c, pos)
    fold(1)
    f = frames[0]
    _js_statements(f.chars, f.places, "module", out)
    return out


def _js_open(f: _Frame, sign: str, pos: int) -> _Frame:
    """What kind of part an opening bracket begins, by what stands before it."""
    p, q = f.last(), f.last(2)
    inside = f.inside
    if sign == "(":
        if p and p in "iws":
            kind = "cond"
        elif p == "x":
            kind = "caught"
        elif p == "o" or (p == "a" and q == "o"):
            kind = "forhead"
        elif p == "f" or (p == "*" and q == "f") or (p and p in "NA" and (q == "f" or (q == "*" and f.last(3) == "f"))):
            kind = "params"
        elif p and (p in _JS_OPERAND or p in "IQ" or (p in "BW" and f.called_at == len(f.chars) - 1)):
            kind = "args"
        else:
            kind = "paren"
        return _Frame(sign, pos, kind, inside)
    if sign == "[":
        member = f.kind == "class" and (f.chars[-1:] == ["\n"] or p in ("", ";", "B", "µ", "*", "A")) and not (p == "N" and q == "=")
        return _Frame(sign, pos, "index" if not member and p and (p in _JS_OPERAND or p == "Q" or (p in "BW" and f.called_at == len(f.chars) - 1)) else "array", inside)
    last = f.chars[-80:]
    tail = "".join(last).replace("\n", "") if p == "m" or p == "," or "c" in last else ""
    if "c" in tail and _JS_HEIR.search(tail):
        return _Frame(sign, pos, "class", inside)
    if p == "h" and q == "s":
        return _Frame(sign, pos, "switch", inside)
    if p and (p in "IE" or (p == "," and _JS_IMPORTS.search(tail))):
        return _Frame(sign, pos, "specs", inside)
    if p == "m" or (p == ">" and p):
        g = _Frame(sign, pos, "block", True)
        if p == "m":
            head = re.search(r"(?:^|(.))A?f\*?[NA]?m$", tail, re.S)
            # the body of a function expression: a call may follow
            g.expression = bool(head) and (head.group(1) not in tuple(";{}BEDW") if head.group(1) else f.kind not in _BLOCKS) and not _line_break_before(f)
        return g
    if not p or p in "edtyxhB;){}VW_":
        block = f.kind in _BLOCKS or f.kind == "class" or bool(p)
    elif p == ":":
        block = f.kind in _BLOCKS
    elif p == "µ" and f.kind == "class":
        block = True
        inside = True
    else:
        block = f.chars[-1:] == ["\n"] and p not in "=(,[?¿¦%-!&Gr*ωνπ" and f.kind in _BLOCKS
    if not p and f.kind not in _BLOCKS:
        block = False
    return _Frame(sign, pos, "block" if block else "object", inside)


_JS_IMPORTS = re.compile(r"(?:^|[;B])IN,$|(?:^|[;B])I[NA],$")


def _line_break_before(f: _Frame) -> bool:
    """Does the function that ends this frame so far begin a line?"""
    i = len(f.chars) - 1
    while i >= 0 and f.chars[i] != "f":
        i -= 1
    if i > 0 and f.chars[i - 1] == "A":
        i -= 1
    return i > 0 and f.chars[i - 1] == "\n" and f.chars[max(0, i - 2)] not in "=(,[?¿¦:%-!&G>"


def _no_breaks(chars: list[str], places: list[int]) -> tuple[list[str], list[int]]:
    if "\n" not in chars:
        return chars, places
    keep = [i for i, c in enumerate(chars) if c != "\n"]
    return [chars[i] for i in keep], [places[i] for i in keep]


def _js_close(g: _Frame, outer: _Frame, text: str, at: int, out: list[Segment]) -> str:
    """Adds the segments of a closed part and gives the character it leaves."""
    if g.kind in ("block", "switch", "class"):
        goal = {"block": "fstatements" if g.inside else "statements", "switch": "fcases" if g.inside else "cases", "class": "members"}[g.kind]
        _js_statements(g.chars, g.places, goal, out)
        return {"block": "B", "switch": "V", "class": "W"}[g.kind]
    chars, places = _no_breaks(g.chars, g.places)
    body, places = "".join(chars), places or [g.at]
    goal = kind = ""
    if g.sign == "(":
        nxt = _JS_NEXT.match(text, at).group(1)
        goal, kind = {"cond": ("cond", "h"), "caught": ("caught", "h"), "forhead": ("forhead", "h"), "params": ("params", "m"), "args": ("args", "g"), "paren": ("paren", "p")}[g.kind]
        if nxt == "=>" or (nxt == "{" and outer.kind in ("object", "class") and g.kind in ("args", "paren") and outer.last() in tuple("NA0Sq2b")):
            goal, kind = "params", "m"
        elif kind == "p" and JAVASCRIPT.accepts("paren_place", body):
            kind = "1"
    elif g.sign == "[":
        if g.kind == "index":
            goal, kind = "index", "b"
        else:
            kind = _js_array(body)
            goal, kind = ("array", "q") if kind == "?" else ("", kind)
    elif g.kind == "specs":
        goal, kind, body = "specs", "J", "".join(c if c in "S,*" else "N" for c in chars)
    else:
        kind = _js_object(body)
        goal, kind = ("object", "O") if kind == "?" else ("", kind)
    if goal:
        out.append((goal, body, places))
    return kind


# Line ends after or before these do not end a statement.
_GLUE_AFTER = frozenset("=G>,.Q?¿¦:%*!Z-fcvκedtnujIEXxyhsoνωπm")
_GLUE_BEFORE = frozenset("=G>,.Q?¿¦:%*j-exy)]gbνωπ")


def _js_statements(chars: list[str], places: list[int], goal: str, out: list[Segment]) -> None:
    """The statements of a block: cut at semicolons and at line ends that end a statement."""
    s: list[str] = []
    o: list[int] = []

    def done() -> None:
        nonlocal s, o
        if s:
            if goal != "members":  # what begins like a declaration is one
                k = s[0] == "A" and s[1:2] == ["f"]
                s[k] = {"f": "φ", "c": "ς"}.get(s[k], s[k])
            out.append((goal, "".join(s), o))
        s, o = [], []

    n = len(chars)
    i = 0
    while i < n:
        c = chars[i]
        if c not in ";\n":
            s.append(c)
            o.append(places[i])
            i += 1
            continue
        j, semi = i, False
        while j < n and chars[j] in ";\n":
            semi = semi or chars[j] == ";"
            if semi and chars[j] == ";" and j > i and ";" in chars[i:j]:
                break  # the next one is an empty statement of its own
            j += 1
        nxt = chars[j] if j < n else ""
        p = s[-1] if s else ""
        if goal == "members":
            if semi or not (p and p in _GLUE_AFTER and p != "m" or nxt and nxt in _GLUE_BEFORE - set("*b(")):
                done()
        elif semi:
            if (p == "h" and not _do_while("".join(s))) or p == "e" or (p == ":" and s[-2:-1] == ["N"] and goal != "object"):
                s.append("_")
                o.append(places[i])
            if nxt == "e" or (nxt == "w" and _open_do("".join(s))):
                pass
            else:
                done()
        elif p and nxt and ((p in _GLUE_AFTER and not (p == "h" and _do_while("".join(s)))) or nxt in _GLUE_BEFORE or (nxt == "w" and _open_do("".join(s)))):
            pass
        else:
            done()
        i = j if j > i else i + 1
    done()


_DO = re.compile(r"(?:^|[hed:B])d(?:B$|[^B]*[^dB]$)")


def _open_do(s: str) -> bool:
    """Is there a do whose while is still to come?"""
    return s.count("d") > s.count("w") and bool(_DO.search(s))


def _do_while(s: str) -> bool:
    return s.endswith("wh") and "d" in s


# ---- JSON -----------------------------------------------------------------------
_JSON_TOKEN = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"|[ \t\n\r]+|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|true\b|false\b|null\b|[{}\[\],:]|.', re.S)


def _json_class(token: str) -> str:
    c = token[0]
    if c in " \t\n\r":
        return ""
    if c == '"':
        return "S" if len(token) > 1 else "?"
    if c == "-" or c.isdigit():
        return "0" if re.fullmatch(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?", token) else "?"
    if token in ("true", "false", "null"):
        return "N"
    return token if token in "{}[],:" else "?"


_JSON = _Classes({}, _json_class)


def json_segments(text: str) -> list[Segment]:
    at = 1 if text[:1] == "﻿" else 0
    out: list[Segment] = []
    frames: list[tuple[str, int, list[str], list[int]]] = []
    cur: list[str] = []
    off: list[int] = []

    def inlined(k: int) -> None:
        nonlocal cur, off
        for o, p, c, f in reversed(frames[k:]):
            cur, off = [*c, o, *cur], [*f, p, *off]
        del frames[k:]

    for tok in _JSON_TOKEN.findall(text, at):
        c, pos = _JSON[tok], at
        at += len(tok)
        if not c:
            continue
        if c in "[{":
            frames.append((c, pos, cur, off))
            cur, off = [], []
            continue
        if c in "]}":
            k = len(frames) - 1
            while k >= 0 and _CLOSE[frames[k][0]] != c:
                k -= 1
            if k >= 0:
                inlined(k + 1)
                o, p, outer_c, outer_o = frames.pop()
                out.append(("object" if o == "{" else "array", "".join(cur), off or [p]))
                cur, off, pos = outer_c, outer_o, p
                c = "o" if o == "{" else "q"
        cur.append(c)
        off.append(pos)
    inlined(0)
    out.append(("doc", "".join(cur), off or [0]))
    return out


# ---- TOML -------------------------------------------------------------------------
_TOML_DATE = r"\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?:[Tt ](?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d+)?(?:[Zz]|[+-](?:[01]\d|2[0-3]):[0-5]\d)?)?|(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d+)?"
_TOML_ESCAPE = r"\\(?:[btnfr\"\\]|u(?![dD][89a-fA-F])[0-9a-fA-F]{4}|U00(?:0(?![0-9a-fA-F]*[dD][89a-fA-F][0-9a-fA-F]{2}(?<=0000....))[0-9a-fA-F]|10)[0-9a-fA-F]{4})"
_TOML_TOKEN = re.compile(
    rf"\"\"\"(?:[^\\\"\x00-\x08\x0b-\x1f\x7f]|{_TOML_ESCAPE}|\\[ \t]*\n|\"(?!\"\"))*\"{{3,5}}|'''(?:[^'\x00-\x08\x0b-\x1f\x7f]|'(?!''))*'{{3,5}}|\"(?:[^\"\\\n\x00-\x08\x0b-\x1f\x7f]|{_TOML_ESCAPE})*\"|'[^'\n\x00-\x08\x0b-\x1f\x7f]*'"
    rf"|#[^\n\x00-\x08\x0b-\x1f\x7f]*|\n|[ \t]+|(?:{_TOML_DATE})(?![\w:.-])|[A-Za-z0-9_+-]+(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?|[=\[\]{{}},.]|.",
    re.S,
)
_TOML_VALUE = re.compile(rf"(?:{_TOML_DATE}|[+-]?(?:0|[1-9](?:_?\d)*)|0x[0-9a-fA-F](?:_?[0-9a-fA-F])*|0o[0-7](?:_?[0-7])*|0b[01](?:_?[01])*|[+-]?(?:0|[1-9](?:_?\d)*)(?:\.\d(?:_?\d)*)?(?:[eE][+-]?\d(?:_?\d)*)?|[+-]?(?:inf|nan)|true|false)\Z")
_TOML_KEY = re.compile(r"[A-Za-z0-9_-]+\Z")
_TOML_DOTTED = re.compile(r"[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\Z")


def _toml_day(token: str) -> bool:
    month, day = int(token[5:7]), int(token[8:10])
    year = int(token[:4])
    return day <= (31, 29 if year % 4 == 0 and (year % 100 or year % 400 == 0) else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[month - 1]


def _toml_class(token: str) -> str:
    """K: a key, N: key or value, F: a number or two keys, S: a string on one line (key or value), M: a string of several, 0: another value."""
    c = token[0]
    if c == "\n":
        return "\n"
    if c in " \t" or c == "#":
        return ""
    if c in "\"'":
        return "?" if len(token) < 2 or token[0] != token[-1] else "M" if token[:3] in ('"""', "'''") and len(token) > 5 else "S"
    if token in "=[]{},.":
        return token
    if re.match(r"\d{4}-\d\d-\d\d", token) and _TOML_VALUE.match(token):
        return ("N" if _TOML_KEY.match(token) else "0") if _toml_day(token) else "K" if _TOML_KEY.match(token) else "?"
    value, key = bool(_TOML_VALUE.match(token)), bool(_TOML_KEY.match(token))
    return "N" if value and key else "F" if value and _TOML_DOTTED.match(token) else "0" if value else "K" if key else "?"


_TOML = _Classes({}, _toml_class)


class _Names:
    """The tables and keys of a TOML file as they are defined; add() says whether a definition clashes with earlier ones."""

    def __init__(self):
        self.root = {"t": "open", "c": {}}
        self.table, self.section = self.root, 0

    def _down(self, node: dict, path: list[str]) -> dict | None:
        for part in path:
            node = node["c"].setdefault(part, {"t": "open", "c": {}})
            if node["t"] == "value":
                return None
        return node

    def header(self, path: list[str], many: bool) -> bool:
        self.section += 1
        up = self._down(self.root, path[:-1])
        if up is None:
            self.table = {"t": "open", "c": {}}
            return False
        old = up["c"].get(path[-1])
        fine = old is None or old["t"] == ("array" if many else "open")
        if many or old is None or not fine:
            self.table = {"t": "array" if many else "table", "c": {}}
            if fine:
                up["c"][path[-1]] = self.table
        else:
            old["t"] = "table"
            self.table = old
        return fine

    def key(self, path: list[str], node: dict | None = None) -> bool:
        node = self.table if node is None else node
        for part in path[:-1]:
            child = node["c"].setdefault(part, {"t": "dotted", "c": {}, "s": self.section})
            if child["t"] == "open":
                child["t"], child["s"] = "dotted", self.section
            if child["t"] != "dotted" or child["s"] != self.section:
                return False
            node = child
        if path[-1] in node["c"]:
            return False
        node["c"][path[-1]] = {"t": "value", "c": {}}
        return True


def _toml_path(tokens: list[str]) -> list[str]:
    out = []
    for t in tokens:
        if t[0] == '"':
            out.append(re.sub(r"\\(?:u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|(.))", lambda m: chr(int(m.group(1) or m.group(2), 16)) if not m.group(3) else {"b": "\b", "t": "\t", "n": "\n", "f": "\f", "r": "\r"}.get(m.group(3), m.group(3)), t[1:-1]))
        elif t[0] == "'":
            out.append(t[1:-1])
        elif t != ".":
            out += t.split(".")
    return out


def toml_segments(text: str) -> list[Segment]:
    """Segments of a TOML file; a table or key defined twice leaves '?'."""
    at = 1 if text[:1] == "﻿" else 0
    text = text.replace("\r\n", "\n")
    out: list[Segment] = []
    names = _Names()
    frames: list[tuple[str, int, list, list, list]] = []
    cur: list[str] = []
    off: list[int] = []
    toks: list[str] = []

    def inlined(k: int) -> None:
        nonlocal cur, off, toks
        for o, p, c, f, t in reversed(frames[k:]):
            cur, off, toks = [*c, o, *cur], [*f, p, *off], [*t, o, *toks]
        del frames[k:]

    def keys_of(chars: list[str], tokens: list[str]) -> list[str] | None:
        key = tokens[: chars.index("=")] if "=" in chars else []
        return _toml_path(key) if key and all(c in "KNFS." for c in chars[: chars.index("=")]) else None

    def line() -> None:
        nonlocal cur, off, toks
        if cur:
            shape, wrong = "".join(cur), False
            if cur[0] == "[":
                many = cur[1:2] == ["["] and off[1] == off[0] + 1
                inner = slice(2, -2) if many else slice(1, -1)
                closed = cur[-1] == "]" and (not many or cur[-2:] == ["]", "]"] and off[-1] == off[-2] + 1)
                if closed:
                    body = "".join(cur[inner])
                    wrong = bool(body) and all(c in "KNFS." for c in body) and not names.header(_toml_path(toks[inner]), many)
                    out.append(("table", body + "?" * wrong, off[inner] or off[:1]))
                    shape = ""
            else:
                path = keys_of(cur, toks)
                wrong = path is not None and not names.key(path)
            if shape:
                out.append(("line", shape + "?" * wrong, off + off[-1:] * wrong))
        cur, off, toks = [], [], []

    for tok in _TOML_TOKEN.findall(text, at):
        c, pos = _TOML[tok], at
        at += len(tok)
        if not c:
            continue
        if c == "\n":
            if not frames:
                line()
                continue
            if frames[-1][0] == "[":
                continue
            # a line ends inside an inline table: its bracket has no partner
            inlined(0)
            line()
            continue
        if c in "[{" and (frames or "=" in cur):
            frames.append((c, pos, cur, off, toks))
            cur, off, toks = [], [], []
            continue
        if c in "]}" and frames:
            k = len(frames) - 1
            while k >= 0 and _CLOSE[frames[k][0]] != c:
                k -= 1
            if k >= 0:
                inlined(k + 1)
                o, p, outer_c, outer_o, outer_t = frames.pop()
                wrong = False
                if o == "{":
                    own, start = _Names(), 0
                    for i in [*(i for i, x in enumerate(cur) if x == ","), len(cur)]:
                        path = keys_of(cur[start:i], toks[start:i])
                        wrong = wrong or (path is not None and not own.key(path))
                        start = i + 1
                out.append(("inline" if o == "{" else "array", "".join(cur) + "?" * wrong, (off or [p]) + (off or [p])[-1:] * wrong))
                cur, off, toks, pos, tok = outer_c, outer_o, outer_t, p, o
                c = "o" if o == "{" else "q"
        cur.append(c)
        off.append(pos)
        toks.append(tok)
    inlined(0)
    line()
    if "\r" in text:
        out.append(("line", "?", [text.index("\r")]))
    return out


SEGMENTERS = {"python": ("py", python_segments), "javascript": ("js", javascript_segments), "json": ("json", json_segments), "toml": ("toml", toml_segments)}


def distinct_segments(lang: str, text: str) -> list[str]:
    """The distinct shortened segments of a file as ``language.goal shape``."""
    short, cut = SEGMENTERS[lang]
    found = {(goal, shape) for goal, shape, _ in (cut(text, True) if lang == "python" else cut(text))}
    return sorted({f"{short}.{goal} {thin(goal, shape)}" for goal, shape in found})


def line_and_column(starts: list[int], at: int) -> tuple[int, int]:
    """Both from 1, for an offset; starts: offsets of the line starts."""
    k = bisect.bisect_right(starts, at)
    return k, at - starts[k - 1] + 1
