"""Least-cost syntax repair by error-correcting chart parsing.

A grammar is a set of rules whose right sides are regular (sequence, choice,
option, repetition); each is compiled to the least automaton.  The chart holds,
for every place in a shape and every state, the least number of edits that lead
there; an edit puts in, takes out or replaces one token.  Back-pointers are read
off the chart, so every edit has its place.  Cost and places are exact at any
length of a shape.
"""

from __future__ import annotations

import re

import numpy as np

_META = re.compile(r"'[^']+'|[A-Za-z_]\w*|[()\[\]{}/=;]")
_FAR = 1 << 28
#: Columns of the chart that are kept at once; the others are worked out again from kept ones.
BLOCK = 2048


class _Nfa:
    """States of one rule while it is read: moves on a token and free moves."""

    def __init__(self):
        self.moves: list[list[tuple[str, int]]] = []
        self.free: list[list[int]] = []
        self.start, self.end = self.state(), self.state()

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.free) - 1


class _Rule:
    """The least deterministic automaton of one rule: per state the next state by token, and whether it may end there."""

    def __init__(self, nfa: _Nfa):
        own: dict[int, frozenset] = {}

        def closure(x: int) -> frozenset:
            if x not in own:
                seen, todo = {x}, [x]
                while todo:
                    for t in nfa.free[todo.pop()]:
                        if t not in seen:
                            seen.add(t)
                            todo.append(t)
                # only states with a token, and the end, tell subsets apart
                own[x] = frozenset(y for y in seen if nfa.moves[y] or y == nfa.end)
            return own[x]

        def closed(states) -> frozenset:
            return frozenset().union(*map(closure, states))

        number: dict[frozenset, int] = {closed([nfa.start]): 0}
        table: list[dict[str, int]] = []
        todo = list(number)
        while todo:
            subset = todo.pop(0)
            by: dict[str, set] = {}
            for x in subset:
                for sym, t in nfa.moves[x]:
                    by.setdefault(sym, set()).add(t)
            row = {}
            for sym, ts in by.items():
                c = closed(ts)
                if c not in number:
                    number[c] = len(number)
                    todo.append(c)
                row[sym] = number[c]
            table.append(row)
        final = [nfa.end in subset for subset in number]
        symbols: dict[tuple, int] = {}
        rows = [sorted(row.items()) for row in table]
        kind = [symbols.setdefault((final[i], *(s for s, _ in row)), len(symbols)) for i, row in enumerate(rows)]
        targets = [[t for _, t in row] for row in rows]
        while True:  # states that no rest of a shape tells apart become one
            sign: dict[tuple, int] = {}
            new = [sign.setdefault((k, *[kind[t] for t in row]), len(sign)) for k, row in zip(kind, targets)]
            if len(sign) == len(set(kind)):
                break
            kind = new
        n = len(set(kind))
        self.start = kind[0]
        self.final = [False] * n
        self.next: list[dict[str, int]] = [{} for _ in range(n)]
        for i, row in enumerate(table):
            self.final[kind[i]] = final[i]
            self.next[kind[i]] = {s: kind[t] for s, t in row.items()}
        self._steps: tuple | None = None

    def accepts(self, shape: str) -> bool:
        s, table = self.start, self.next
        for c in shape:
            s = table[s].get(c, -1)
            if s < 0:
                return False
        return self.final[s]

    def steps(self) -> tuple:
        """(sources, targets, where each target's run begins, targets without repeats, moves by token) of the one-token steps, sorted by target."""
        if self._steps is None:
            pairs = np.array(sorted({(t, s) for s, row in enumerate(self.next) for t in row.values()}), np.int64).reshape(-1, 2)
            by: dict[str, tuple[list[int], list[int]]] = {}
            for s, row in enumerate(self.next):
                for c, t in row.items():
                    a, b = by.setdefault(c, ([], []))
                    a.append(s)
                    b.append(t)
            runs = np.flatnonzero(np.r_[True, pairs[1:, 0] != pairs[:-1, 0]]) if len(pairs) else np.array([], np.int64)
            self._steps = pairs[:, 1], pairs[:, 0], runs, pairs[runs, 0], {c: (np.array(a), np.array(b)) for c, (a, b) in by.items()}
        return self._steps


class Grammar:
    """Rules written as ``name = alternatives ;`` with '…' for any one of the quoted tokens, [ ] option, { } repetition, / choice.

    A rule is written out where it is named; brackets inside a source are told
    apart before (see ``shapes``), so no rule needs to call itself.
    """

    def __init__(self, text: str):
        self.source: dict[str, list[str]] = {}
        words = _META.findall(text)
        i = 0
        while i < len(words):
            j = words.index(";", i)
            self.source[words[i]] = words[i + 2 : j]
            i = j + 1
        self.rules: dict[str, _Rule] = {}

    def rule(self, name: str) -> _Rule:
        if name not in self.rules:
            nfa = _Nfa()
            self._choice(nfa, self.source[name], nfa.start, nfa.end)
            self.rules[name] = _Rule(nfa)
        return self.rules[name]

    def _choice(self, r: _Nfa, words: list[str], a: int, b: int) -> None:
        for part in _split(words):
            at = a
            k = 0
            while k < len(part):
                w = part[k]
                nxt = r.state()
                if w in "([{":
                    end = _closing(part, k)
                    inner = part[k + 1 : end]
                    if w == "{":
                        loop = r.state()
                        r.free[at].append(loop)
                        r.free[loop].append(nxt)
                        self._choice(r, inner, loop, loop)
                    else:
                        self._choice(r, inner, at, nxt)
                        if w == "[":
                            r.free[at].append(nxt)
                    k = end
                elif w[0] == "'":
                    r.moves[at] += [(t, nxt) for t in w[1:-1]]
                else:  # written out, from its own least automaton
                    sub = self.rule(w)
                    own = [r.state() for _ in sub.final]
                    r.free[at].append(own[sub.start])
                    for i, x in enumerate(own):
                        r.moves[x] += [(t, own[y]) for t, y in sub.next[i].items()]
                        if sub.final[i]:
                            r.free[x].append(nxt)
                at = nxt
                k += 1
            r.free[at].append(b)

    def accepts(self, goal: str, shape: str) -> bool:
        return self.rule(goal).accepts(shape)

    def cost(self, goal: str, shape: str) -> int:
        """The least number of edits that make ``shape`` derive from ``goal``."""
        return 0 if self.accepts(goal, shape) else len(self.repair(goal, shape))

    def repair(self, goal: str, shape: str) -> list[tuple[int, str]]:
        """The edits of a cheapest repair as (place in the shape, '+' put in before it, '-' taken out, '~' replaced), in order."""
        r = self.rule(goal)
        src, dst, runs, heads, by = r.steps()
        none = (np.array([], np.int64),) * 2

        far = np.full(len(r.final), _FAR, np.int64)

        def one_more(d: np.ndarray) -> np.ndarray:
            out = far.copy()
            if len(runs):
                out[heads] = np.minimum.reduceat(d[src], runs) + 1
            return out

        def with_puts(e: np.ndarray) -> np.ndarray:
            while True:
                d = np.minimum(e, one_more(e))
                if (d == e).all():
                    return d
                e = d

        def before_puts(d: np.ndarray, c: str) -> np.ndarray:
            e = np.minimum(d + 1, one_more(d))
            a, b = by.get(c, none)
            np.minimum.at(e, b, d[a])
            return e

        start = far.copy()
        start[r.start] = 0
        kept = {0: with_puts(start)}
        d = kept[0]
        for i, c in enumerate(shape):
            d = with_puts(before_puts(d, c))
            if (i + 1) % BLOCK == 0:
                kept[i + 1] = d
        ends = np.flatnonzero(r.final)
        state = int(ends[d[ends].argmin()])
        out: list[tuple[int, str]] = []
        block: dict[int, np.ndarray] = {}
        want = int(d[state])

        def back_over_puts(i: int, state: int, want: int, e: np.ndarray, d: np.ndarray) -> tuple[int, int]:
            while e[state] != want:
                froms = src[dst == state]
                state = int(froms[np.flatnonzero(d[froms] == want - 1)[0]])
                want -= 1
                out.append((i, "+"))
            return state, want

        for i in range(len(shape), 0, -1):
            if i - 1 not in block:
                low = (i - 1) // BLOCK * BLOCK
                block = {low: kept[low]}
                for k in range(low, min(low + BLOCK, len(shape)) - 1):
                    block[k + 1] = with_puts(before_puts(block[k], shape[k]))
            prev, c = block[i - 1], shape[i - 1]
            e = before_puts(prev, c)
            state, want = back_over_puts(i, state, want, e, with_puts(e))
            a, b = by.get(c, none)
            same = a[(b == state) & (prev[a] == want)] if len(a) else a
            if len(same):
                state = int(same[0])
                continue
            froms = src[dst == state]
            swap = np.flatnonzero(prev[froms] == want - 1)
            if len(swap):
                state, op = int(froms[swap[0]]), "~"
            else:
                op = "-"
            out.append((i - 1, op))
            want -= 1
        back_over_puts(0, state, want, start, kept[0])
        return out[::-1]


def _split(words: list[str]) -> list[list[str]]:
    out, depth = [[]], 0
    for w in words:
        depth += (w in "([{") - (w in ")]}")
        if w == "/" and not depth:
            out.append([])
        else:
            out[-1].append(w)
    return out


def _closing(words: list[str], k: int) -> int:
    depth = 0
    for i in range(k, len(words)):
        depth += (words[i] in "([{") - (words[i] in ")]}")
        if not depth:
            return i
    raise ValueError("bracket without a partner in the grammar")


PYTHON = Grammar(
    """
    E = { lambda } Or { 'i' Or 'e' { lambda } Or } ;
    lambda = 'L' [ lambda_params ] ':' ;
    Or = { '!' } bit { comparison bit } { '&' { '!' } bit { comparison bit } } ;
    comparison = '<nz' / '!' 'n' / 'z' '!' ;
    bit = unary { '-*%/@P|' unary } ;
    unary = { '-~' } [ 'a' ] primary ;
    primary = 'N0JSβCp12qb345' { '.' 'N' / 'uv' } ;
    plain = 'N' ;
    given = 'N' '=' { 'L' [ 'N' { ',' 'N' } ] ':' } Or ;
    lambda_params = lambda_before [ ',' lambda_star ] [ ',' ] / lambda_star [ ',' ] ;
    lambda_before = plain { ',' plain } { ',' given } / given { ',' given }
           / plain { ',' plain } ',' '/' { ',' plain } { ',' given } / plain { ',' plain } { ',' given } ',' given ',' '/' { ',' given } / given { ',' given } ',' '/' { ',' given } ;
    lambda_star = '*' plain { ',' 'N' [ '=' Or ] } [ ',' 'P' plain ] / '*' ',' 'N' [ '=' Or ] { ',' 'N' [ '=' Or ] } [ ',' 'P' plain ] / 'P' plain ;
    star = E / '*' bit ;
    stars = star { ',' star } [ ',' ] ;
    named = [ 'N' 'W' ] E ;
    starred = named / '*' bit ;
    starreds = starred { ',' starred } [ ',' ] ;
    yield = 'Y' [ stars / 'F' E ] ;
    value = stars / yield ;
    single = 'N1' / 'N0JSβCp12qb345' { '.' 'N' / 'uv' } ( '.' 'N' / 'v' ) ;
    target = single / '2345' ;
    targets = [ '*' ] target { ',' [ '*' ] target } [ ',' ] ;
    loop_targets = targets ;
    loop = [ 'A' ] 'f' loop_targets 'n' Or { [ 'A' ] 'f' loop_targets 'n' Or / 'i' Or } ;
    paren = [ named / '*' bit ',' [ starreds ] / named ',' [ starreds ] / yield / named loop ] ;
    one_target = single ;
    some_targets = [ ( single / '23' ) ',' [ ( single / '23' ) { ',' ( single / '23' ) } [ ',' ] ] ] ;
    some_star_targets = ( [ '*' ] target ) ',' [ [ '*' ] target { ',' [ '*' ] target } [ ',' ] ] ;
    list_targets = [ ( single / '23' ) { ',' ( single / '23' ) } [ ',' ] ] ;
    list_star_targets = [ '*' ] target { ',' [ '*' ] target } [ ',' ] ;
    withs = paren / with_item { ',' with_item } [ ',' ] ;
    list = [ starreds / named loop ] ;
    braces = [ starreds / named loop / entry { ',' entry } [ ',' ] / E ':' E loop ] ;
    entry = E ':' E / 'P' bit ;
    args = [ named loop / arg { ',' arg } [ ',' keyword_args ] [ ',' ] / keyword_args [ ',' ] ] ;
    arg = named / '*' E ;
    keyword_args = keyword { ',' ( keyword / '*' E ) } [ ',' doubles ] / doubles ;
    keyword = 'N' '=' E ;
    doubles = 'P' E { ',' ( keyword / 'P' E ) } ;
    noted = 'N' [ ':' E ] ;
    valued = 'N' [ ':' E ] '=' E ;
    either = 'N' [ ':' E ] [ '=' E ] ;
    params = [ before [ ',' after ] [ ',' ] / after [ ',' ] ] ;
    before = noted { ',' noted } { ',' valued } / valued { ',' valued }
           / noted { ',' noted } ',' '/' { ',' noted } { ',' valued } / noted { ',' noted } { ',' valued } ',' valued ',' '/' { ',' valued } / valued { ',' valued } ',' '/' { ',' valued } ;
    after = '*' 'N' [ ':' star ] { ',' either } [ ',' 'P' noted ] / '*' ',' either { ',' either } [ ',' 'P' noted ] / 'P' noted ;
    slice = [ E ] ':' [ E ] [ ':' [ E ] ] / starred ;
    index = ( [ E ] ':' [ E ] [ ':' [ E ] ] / named ) / slice ',' [ slice { ',' slice } [ ',' ] ] / '*' bit ;
    typeparams = typeparam { ',' typeparam } [ ',' ] ;
    typeparam = 'N' [ ':' E ] [ '=' E ] / 'P' 'N' [ '=' E ] / '*' 'N' [ '=' star ] ;
    names = as_name { ',' as_name } [ ',' ] ;
    as_name = 'N' [ 's' 'N' ] ;
    dotted = 'N' { '.' 'N' } ;
    module = dotted [ 's' 'N' ] ;
    field = value ;
    simple = { targets '=' } value / single 'G' value / single ':' E [ '=' value ] / 'r' [ stars ] / 'R' [ E [ 'F' E ] ]
           / 'g' 'N' { ',' 'N' } / 'D' ( single / '23' ) { ',' ( single / '23' ) } [ ',' ] / 'T' E [ ',' E ] / 'k' / 'I' module { ',' module }
           / 'F' ( dotted / '.C' { '.C' } [ dotted ] ) 'I' ( '*' / 'o' / as_name { ',' as_name } ) / 'X' 'N' [ '§' ] '=' E ;
    with_item = E [ 's' target ] ;
    number = [ '-' ] '0J' / [ '-' ] '0' '-' 'J' ;
    closed = number / 'Sβ' / 'C' / 'N' { '.' 'N' } [ 'u' ] / 'pqb' ;
    pattern = closed { '|' closed } [ 's' 'N' ] ;
    maybe_star = pattern / '*' 'N' ;
    pat_seq = [ maybe_star { ',' maybe_star } [ ',' ] ] ;
    pat_args = [ ( pattern / 'N' '=' pattern ) { ',' ( pattern / 'N' '=' pattern ) } [ ',' ] ] ;
    pat_map = [ ( map_key ':' pattern / 'P' 'N' ) { ',' ( map_key ':' pattern / 'P' 'N' ) } [ ',' ] ] ;
    map_key = number / 'Sβ' / 'C' / 'N' '.' 'N' { '.' 'N' } ;
    header = 'ilw' named ':' / 'ety' ':' / [ 'A' ] 'f' loop_targets 'n' stars ':' / 'x' [ [ '*' ] E [ 's' 'N' ] ] ':'
           / [ 'A' ] 'h' with_item { ',' with_item } ':' / [ 'A' ] 'h' 'p' ':' / [ 'A' ] 'd' 'N' [ '§' ] 'm' [ '>' E ] ':' / 'c' 'N' [ '§' ] [ 'u' ] ':'
           / 'M' ( starred [ ',' [ starreds ] ] ) ':' / 'K' maybe_star [ ',' [ maybe_star { ',' maybe_star } [ ',' ] ] ] [ 'i' named ] ':' / '@' named ;
    body = 'Bb' ;
    block = statement { statement } ;
    cases = 'K' body { 'K' body } ;
    file = { statement } ;
    statement = ';' / '@' { '@' } 'dc' body / 'dc' body / 'i' body { 'l' body } [ 'e' body ] / 'wf' body [ 'e' body ] / 'hM' body
              / 't' body ( 'x' body { 'x' body } [ 'e' body ] [ 'y' body ] / 'X' body { 'X' body } [ 'e' body ] [ 'y' body ] / 'y' body ) ;
    """
)

JSON = Grammar(
    """
    value = 'SN0oq' ;
    doc = value ;
    object = [ 'S' ':' value { ',' 'S' ':' value } ] ;
    array = [ value { ',' value } ] ;
    """
)

TOML = Grammar(
    """
    key = 'KNFS' { '.' 'KNFS' } ;
    value = 'S0VNFqo' ;
    line = key '=' 'S0VNFMqo' / 't' / 'T' ;
    table = key ;
    array = [ 'S0NFMqo' { ',' 'S0NFMqo' } [ ',' ] ] ;
    inline = [ key '=' 'S0NFMqo' { ',' key '=' 'S0NFMqo' } ] ;
    """
)

JAVASCRIPT = Grammar(
    """
    Assign = head { '¿¦' head } ;
    head = { place '=' / brace_place '=' / place 'G' / [ 'A' ] ( 'Nm' / 'A' ) '>' / 'Y' [ '*' ] } ( chain / [ 'A' ] ( 'Nm' / 'A' ) '>' 'B' / 'Y' ) ;
    chain = unit { op unit } / level { 'ν' level } ;
    level = unit { '-*%j' unit } ;
    op = '-*%jω' ;
    sign = '-!uPa' ;
    unit = { sign } value [ 'P' ] / { 'a' } value [ 'P' ] 'π' { { 'a' } value [ 'P' ] 'π' } { sign } value [ 'P' ] ;
    value = { 'n' } atom { '.' 'N' / 'Q' 'Ngb' / 'Q' 'S' / 'gbS' } ;
    atom = 'NCA0Sp1q2O3' / function / klass / 'I' 'g' / 'I' '.' 'N' ;
    place = 'NA1' / { 'n' } atom { '.' 'N' / 'gbS' / 'Q' 'Ngb' } ( '.' 'N' / 'b' ) ;
    brace_place = '2345' ;
    function = [ 'A' ] 'f' [ '*' ] [ 'NA' ] 'm' 'B' ;
    heritage = 'NCpA1' { '.' 'N' / 'gbS' } / klass ;
    klass = 'c' [ 'NA' ] [ 'X' 'NCpA1' { '.' 'N' / 'gbS' } ] 'W' ;
    exprs = Assign { ',' Assign } ;
    bound = 'NA' ;
    shaped = '2345' ;
    pattern = bound / shaped ;
    declared = bound [ '=' Assign ] / shaped '=' Assign ;
    decls = 'v' declared { ',' declared } / 'κ' pattern '=' Assign { ',' pattern '=' Assign } ;
    loose = bound [ '=' Assign ] ;
    fordecls = decls / 'vκ' pattern ;
    paren = exprs ;
    paren_place = place ;
    cond = exprs ;
    args = [ argument { ',' argument } [ ',' ] ] ;
    argument = [ 'Z' ] Assign ;
    array = { ',' } [ argument { ',' { ',' } argument } { ',' } ] ;
    array_pattern = { ',' } [ item { ',' { ',' } item } { ',' } ] [ 'Z' ( place / brace_place ) ] ;
    item = ( place / brace_place ) [ '=' Assign ] ;
    index = exprs ;
    params = [ param { ',' param } [ ',' ] / { param ',' } 'Z' pattern ] ;
    param = pattern [ '=' Assign ] ;
    caught = pattern ;
    key = 'N0Sq2b' ;
    method = { 'µA' } [ '*' ] ( key / 'A' ) 'm' 'B' ;
    object = [ prop { ',' prop } [ ',' ] ] ;
    prop = ( key / 'A' ) ':' Assign / 'NA' / 'Z' Assign / method ;
    object_pattern = [ target { ',' target } [ ',' ] / { target ',' } 'Z' place ] ;
    target = 'NA' [ '=' Assign ] / ( key / 'A' ) ':' ( place / brace_place ) [ '=' Assign ] ;
    specs = [ spec { ',' spec } [ ',' ] ] ;
    spec = 'NS' [ 'N' 'NS' ] ;
    forhead = [ decls / exprs ] ';' [ exprs ] ';' [ exprs ] / ( 'vκ' pattern / place / brace_place ) ( 'N' Assign / 'j' exprs ) ;
    members = { method / 'µ' 'B' } [ method / { 'µ' } ( key / 'A' ) [ '=' Assign ] / 'µ' 'B' ] ;
    declaration = [ 'A' ] 'fφ' [ '*' ] 'NA' 'm' 'B' / 'cς' 'NA' [ 'X' heritage ] 'W' ;
    closed = declaration / 'B' / 'd' 'B' 'w' 'h' / 't' 'B' ( 'x' [ 'h' ] 'B' [ 'y' 'B' ] / 'y' 'B' ) / 's' 'h' 'V' ;
    outer = closed / 'E' declaration / 'E' 'D' ( function / klass ) ;
    nest = { 'i' 'h' / 'i' 'h' ( closed / fsimple / '_' ) 'e' / 'o' [ 'a' ] 'h' / 'w' 'h' / 'N' ':' } ;
    simple = exprs / decls / 'R' exprs / 'k' [ 'N' ] / 'd' ( 'B' / fsimple ) 'w' 'h' [ '_' ] ;
    fsimple = exprs / decls / 'R' exprs / 'k' [ 'N' ] / 'd' 'B' 'w' 'h' [ '_' ] / 'r' [ exprs ] ;
    fbody = exprs / decls / 'R' exprs / 'k' [ 'N' ] / 'd' ( 'B' / fsimple ) 'w' 'h' [ '_' ] / 'r' [ exprs ] ;
    modular = 'I' ( 'S' / imported { ',' imported } 'N' 'S' ) [ 'i' 'O3' / 'N' 'O3' ]
           / 'E' ( decls / 'D' Assign / 'J' [ 'N' 'S' ] / '*' [ 'N' 'NS' ] 'N' 'S' ) ;
    imported = 'NA' / 'J' / '*' 'N' 'NA' ;
    nest0 = { 'i' 'h' / 'i' 'h' ( closed / simple / '_' ) 'e' / 'o' [ 'a' ] 'h' / 'w' 'h' / 'N' ':' } ;
    statements = { nest0 closed } [ nest0 ( simple / '_' ) ] ;
    module = { nest0 outer } [ nest0 ( simple / '_' ) / modular ] ;
    fstatements = { nest closed } [ nest ( fbody / '_' ) ] ;
    cases = { 'K' exprs ':' / 'D' ':' } statements ;
    fcases = { 'K' exprs ':' / 'D' ':' } fstatements ;
    expr = exprs ;
    """
)

GRAMMARS = {"py": PYTHON, "json": JSON, "toml": TOML, "js": JAVASCRIPT}


def compiled(goals: dict[str, list[str]] | None = None) -> dict[str, dict[str, _Rule]]:
    """The automata of the goals of each grammar (None: all), to be sent to tasks, which then need not build them."""
    return {lang: {name: GRAMMARS[lang].rule(name) for name in names} for lang, names in (goals or {k: list(g.source) for k, g in GRAMMARS.items()}).items()}


def adopt(tables: dict[str, dict[str, _Rule]]) -> None:
    for lang, rules in tables.items():
        GRAMMARS[lang].rules.update(rules)


def split_segment(segment: str) -> tuple[Grammar, str, str]:
    """(grammar, goal, shape) of a segment ``language.goal shape``."""
    head, _, shape = segment.partition(" ")
    lang, _, goal = head.partition(".")
    return GRAMMARS[lang], goal, shape


def segment_cost(segment: str) -> int:
    g, goal, shape = split_segment(segment)
    return g.cost(goal, shape)


def derives(segment: str) -> bool:
    g, goal, shape = split_segment(segment)
    return g.accepts(goal, shape)
