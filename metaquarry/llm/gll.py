"""A generalised LL recogniser with a graph-structured stack.

Rules are regular expressions over terminals and rules. Each becomes a deterministic automaton;
where it may go on in more than one way, all are followed. Calls of one rule at one position
share a node of the stack, which keeps the positions where the rule has ended, so that a later
call takes them over. Ways that the next token excludes are never entered."""

from __future__ import annotations

import re

END = "<end>"
_ITEM = re.compile(r"\s*(?:(#[^\n]*)|('(?:[^'\\]|\\.)+')|([A-Za-z_][A-Za-z_0-9]*)|([()|?*+;:]))")


def _read(text: str) -> dict[str, tuple]:
    """Rules `name: body ;` as nested tuples. 'x' is a terminal, as is a name in capitals."""
    toks, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _ITEM.match(text, at)
        if not m:
            raise ValueError(f"grammar: {text[at : at + 40]!r}")
        at = m.end()
        if m[2]:
            toks.append(("t", m[2][1:-1].replace("\\'", "'").replace("\\\\", "\\")))
        elif m[3]:
            toks.append(("t" if m[3].isupper() else "n", m[3]))
        elif m[4]:
            toks.append(("op", m[4]))
    pos = 0

    def peek() -> tuple:
        return toks[pos] if pos < len(toks) else ("op", ";")

    def alternatives() -> tuple:
        nonlocal pos
        out = [sequence()]
        while peek() == ("op", "|"):
            pos += 1
            out.append(sequence())
        return out[0] if len(out) == 1 else ("alt", out)

    def sequence() -> tuple:
        nonlocal pos
        out = []
        while peek()[0] != "op" or peek()[1] == "(":
            tok = peek()
            pos += 1
            if tok == ("op", "("):
                tok = alternatives()
                pos += 1
            while peek()[0] == "op" and peek()[1] in "?*+":
                tok = (peek()[1], tok)
                pos += 1
            out.append(tok)
        return ("seq", out)

    rules: dict[str, tuple] = {}
    while pos < len(toks):
        name = toks[pos][1]
        pos += 2
        if name in rules:
            raise ValueError(f"grammar: {name} twice")
        rules[name] = alternatives()
        pos += 1
    return rules


class Rows(dict):
    """Of each state the actions by the kind of the next token, made when first asked for: to take
    the token (0, state, 0), to call a rule (1, state, state after it) or to end one (2, 0, 0)."""

    def __init__(self, grammar: Grammar, of: tuple):
        super().__init__()
        self.grammar, self.of = grammar, of

    def __missing__(self, s: int) -> dict[int, tuple]:
        edges, final, owner, entry, empty, first, follow = self.of
        after, a = follow[owner[s]], {}

        def add(mask: int, way: tuple) -> None:
            while mask:
                low = mask & -mask
                a.setdefault(low.bit_length() - 1, []).append(way)
                mask ^= low

        for (k, x), t in edges[s].items():
            if k == "t":
                add(1 << self.grammar.kinds[x], (0, t, 0))
            else:
                ahead = first[entry[x]]
                if empty[entry[x]]:
                    ahead |= first[t] | (after if empty[t] else 0)
                add(ahead, (1, entry[x], t))
        if final[s]:
            add(after, (2, 0, 0))
        for (one, two), number in self.grammar.both.items():
            ways = dict.fromkeys(a.get(one, []) + a.get(two, []))
            if ways:
                a[number] = list(ways)
        row = self[s] = {k: tuple(v) for k, v in a.items()}
        return row


class Grammar:
    """The automata of all rules as one table of actions per state and token.

    Only the rules in `calls` (all, if none are named) are called through the stack. The others
    are built into the automata that use them, where alternatives with the same beginning become
    one way; every recursion has to pass through a rule that is called."""

    def __init__(self, text: str, start: str, calls: str = ""):
        rules = _read(text)
        self.kinds: dict[str, int] = {END: 0}
        self.both: dict[tuple[int, int], int] = {}
        self.start = start
        self.inner = {x: b for x, b in rules.items() if calls and x not in calls.split() and x != start}
        edges: list[dict[tuple, int]] = []  # of each state: (kind, symbol) -> state
        final: list[bool] = []
        owner: list[str] = []
        entry: dict[str, int] = {}
        for name, body in rules.items():
            if name not in self.inner:
                self._automaton(name, body, edges, final, owner, entry)
        unknown = {s for e in edges for k, s in e if k == "n" and s not in entry}
        if unknown:
            raise ValueError(f"grammar: no rule {sorted(unknown)}")
        for e in edges:
            for k, s in e:
                if k == "t":
                    self.kinds.setdefault(s, len(self.kinds))
        self._tables(edges, final, owner, entry)

    def _automaton(self, name: str, body: tuple, edges: list, final: list, owner: list, entry: dict) -> None:
        eps: list[list[int]] = []
        on: list[list[tuple[tuple, int]]] = []

        def node() -> int:
            eps.append([])
            on.append([])
            return len(eps) - 1

        def build(x: tuple, a: int) -> int:
            kind = x[0]
            if kind == "n" and x[1] in self.inner:
                return build(self.inner[x[1]], a)
            if kind in "tn" and len(kind) == 1:
                b = node()
                on[a].append((x, b))
                return b
            if kind == "seq":
                for y in x[1]:
                    a = build(y, a)
                return a
            if kind == "alt":
                b = node()
                for y in x[1]:
                    c = node()
                    eps[a].append(c)
                    eps[build(y, c)].append(b)
                return b
            c, b = node(), node()
            eps[a].append(c)
            d = build(x[1], c)
            eps[d].append(b)
            if kind in "?*":
                eps[a].append(b)
            if kind in "*+":
                eps[d].append(c)
            return b

        first = node()
        last = build(body, first)

        known_from: dict[int, frozenset[int]] = {}

        def reach(a: int) -> frozenset[int]:
            """The nodes with edges, or the last one, that are reached without a symbol."""
            if a not in known_from:
                todo, met = [a], {a}
                while todo:
                    for y in eps[todo.pop()]:
                        if y not in met:
                            met.add(y)
                            todo.append(y)
                known_from[a] = frozenset(y for y in met if on[y] or y == last)
            return known_from[a]

        def closure(s: set[int]) -> frozenset[int]:
            return frozenset().union(*map(reach, s))

        begin = closure({first})
        known = {begin: len(edges)}
        entry[name] = len(edges)
        todo = [begin]
        edges.append({})
        final.append(last in begin)
        owner.append(name)
        while todo:
            s = todo.pop()
            moves: dict[tuple, set[int]] = {}
            for n in s:
                for sym, b in on[n]:
                    moves.setdefault(sym, set()).add(b)
            for sym, b in moves.items():
                t = closure(b)
                if t not in known:
                    known[t] = len(edges)
                    edges.append({})
                    final.append(last in t)
                    owner.append(name)
                    todo.append(t)
                edges[known[s]][sym] = known[t]

    def _tables(self, edges: list, final: list, owner: list, entry: dict) -> None:
        """What may come next, as sets of kinds in the bits of numbers; see Rows."""
        n = len(edges)
        empty = [False] * n  # the rest of the rule may be empty
        first = [0] * n
        change = True
        while change:
            change = False
            for s in range(n - 1, -1, -1):
                e, f = final[s] or empty[s], first[s]
                for (k, x), t in edges[s].items():
                    if k == "t":
                        f |= 1 << self.kinds[x]
                    else:
                        f |= first[entry[x]]
                        if empty[entry[x]]:
                            f |= first[t]
                            e = e or empty[t]
                if e != empty[s] or f != first[s]:
                    empty[s], first[s], change = e, f, True
        follow = dict.fromkeys(entry, 0)
        follow[self.start] = 1
        change = True
        while change:
            change = False
            for s in range(n):
                for (k, x), t in edges[s].items():
                    if k == "n":
                        add = follow[x] | first[t] | (follow[owner[s]] if empty[t] else 0)
                        if add != follow[x]:
                            follow[x], change = add, True
        self.entry = entry[self.start]
        self.act = Rows(self, (edges, final, owner, entry, empty, first, follow))

    def kind(self, *names: str) -> int:
        """The number of a kind of token. A token of two kinds, as a word that is a keyword and a
        name, has a number of its own; ways by either are followed."""
        if len(names) == 1:
            return self.kinds[names[0]]
        pair = (self.kinds[names[0]], self.kinds[names[1]])
        if pair not in self.both:
            self.both[pair] = len(self.kinds) + len(self.both)
            self.act.clear()
        return self.both[pair]

    def accepts(self, kinds: list[int]) -> tuple[bool, int]:
        """(whether the tokens are a sentence, how far they can be read)."""
        tokens = [*kinds, 0]
        act, last, far = self.act, len(kinds), 0
        # A node of the stack: (calls that wait for it: (state, node), positions where it ended).
        root: tuple[list, list] = ([], [])
        nodes: dict[int, dict[int, tuple[list, list]]] = {}  # of each position: by the state entered
        seen: set[tuple[int, int, int]] = set()
        work: list[tuple[int, tuple, int]] = [(self.entry, root, 0)]
        while work:
            state, node, i = work.pop()
            while True:
                ways = act[state].get(tokens[i])
                if ways is None:
                    if i > far:
                        far = i
                    break
                if len(ways) > 1:
                    for way in ways[1:]:
                        work.append((way[1], node, i + 1)) if way[0] == 0 else self._step(way, node, i, nodes, seen, work)
                kind, x, back = ways[0]
                if kind == 0:
                    state = x
                    i += 1
                elif kind == 1:
                    here = nodes.get(i)
                    if here is None:
                        here = nodes[i] = {}
                    called = here.get(x)
                    if called is None:
                        called = here[x] = ([(back, node)], [])
                        state, node = x, called
                    else:
                        self._step(ways[0], node, i, nodes, seen, work)
                        break
                else:
                    if node is root and i == last:
                        return True, last
                    calls, ended = node
                    if i in ended:
                        break
                    ended.append(i)
                    if not calls:
                        break
                    if len(calls) > 1:
                        for b, parent in calls[1:]:
                            key = (b, id(parent), i)
                            if key not in seen:
                                seen.add(key)
                                work.append((b, parent, i))
                    b, parent = calls[0]
                    key = (b, id(parent), i)
                    if key in seen:
                        break
                    seen.add(key)
                    state, node = b, parent
        return last in root[1], far

    @staticmethod
    def _step(way: tuple, node: tuple, i: int, nodes: dict, seen: set, work: list) -> None:
        kind, x, back = way
        if kind == 1:
            here = nodes.setdefault(i, {})
            called = here.get(x)
            if called is None:
                called = here[x] = ([(back, node)], [])
                work.append((x, called, i))
                return
            for b, parent in called[0]:
                if b == back and parent is node:
                    return
            called[0].append((back, node))
            for j in called[1]:
                key = (back, id(node), j)
                if key not in seen:
                    seen.add(key)
                    work.append((back, node, j))
        else:
            if i in node[1]:
                return
            node[1].append(i)
            for b, parent in node[0]:
                key = (b, id(parent), i)
                if key not in seen:
                    seen.add(key)
                    work.append((b, parent, i))
