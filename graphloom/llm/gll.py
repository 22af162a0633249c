"""Generalised LL recognition over recursive transition networks with a graph-structured stack.

A grammar is EBNF text. The right sides of each nonterminal become one deterministic automaton over terminals and
nonterminals, which factors common prefixes; FIRST and FOLLOW sets select the moves that the next token allows. Where
one move is left, it is taken at once; otherwise descriptors (state, stack node) fork and meet again in stack nodes
shared per nonterminal and position, so ambiguity and left recursion cost polynomial time at most.

Notation: ``Name: a | b (c d)? e* f+ ;``  'x' is a token's text, UPPER a token class, ``@set: ...;`` a set of terminals,
``%any`` every terminal but brackets and the end, ``%asi`` passes without input where a semicolon may be inserted.
Within ``%mode`` rules ``X^`` means X in the same mode, ``%{ .. %}`` alternatives are left out of the restricted mode, and
``X!`` is X in the restricted mode.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

_LEX = re.compile(r"\s*(?:#[^\n]*\n\s*)*('(?:\\.|[^'])*'|@?[A-Za-z_]\w*(?:\^|!(?!\w))?|%\{|%\}|%\w+|[:;|()?*+])")
END = "<end>"
ASI = "%asi"
NL = 1 << 16  # added to a token id: a line break stands before it
#: Tokens that end a stretch.
STRETCH_ENDS = [";", "{", "}", "NEWLINE", "INDENT", "DEDENT"]
#: Stretches remembered at most, and the mark of those that need more than one stack.
MOST_LEAPS = 200_000
#: Stretches that are tried together.
TOGETHER = 4
FORKS: dict = {}


class Node:
    """Stack node: the edges (return state, parent) of one nonterminal begun at one position."""

    __slots__ = ("edges",)

    def __init__(self) -> None:
        self.edges: list = []


def _read(text: str) -> tuple[dict, dict]:
    """Rules as nested lists (op, ...) and terminal sets."""
    toks, i = [], 0
    text = text.strip()
    while i < len(text):
        m = _LEX.match(text, i)
        if not m:
            if not re.sub(r"#[^\n]*(\n|$)", "", text[i:]).strip():
                break
            raise ValueError(f"grammar near {text[i : i + 40]!r}")
        toks.append(m[1])
        i = m.end()
    defined = {a for a, b in zip(toks, toks[1:]) if b == ":"}
    rules: dict[str, tuple] = {}
    sets: dict[str, list[str]] = {}
    pos = 0
    restricted = False

    def alt():
        nonlocal pos
        out = [seq()]
        while toks[pos] == "|":
            pos += 1
            out.append(seq())
        out = [x for x in out if x is not None]
        return ("alt", out) if len(out) != 1 else out[0]

    def seq():
        nonlocal pos
        out, cut = [], False
        while toks[pos] not in ("|", ")", ";"):
            if toks[pos] in ("%{", "%}"):
                cut |= toks[pos] == "%{"
                pos += 1
                continue
            x = atom()
            while toks[pos] in ("?", "*", "+"):
                x = (toks[pos], x)
                pos += 1
            out.append(x)
        return None if cut and restricted else ("seq", out)

    def atom():
        nonlocal pos
        t = toks[pos]
        pos += 1
        if t == "(":
            x = alt()
            if toks[pos] != ")":
                raise ValueError(f"expected ) before {toks[pos : pos + 5]}")
            pos += 1
            return x
        if t[0] == "'":
            return ("t", t[1:-1].replace("\\'", "'"))
        if t[-1] in "^!":
            return ("n", t[:-1] + ("!" if restricted or t[-1] == "!" else ""))
        if t in ("%any", "%asi"):
            return ("t", t)
        if t[0] == "@":
            return ("set", t)
        return ("t", t) if t.isupper() and t not in defined else ("n", t)

    mode = False
    while pos < len(toks):
        if toks[pos] in ("%mode", "%end"):
            mode = toks[pos] == "%mode"
            pos += 1
            continue
        name = toks[pos]
        if toks[pos + 1] != ":":
            raise ValueError(f"expected : after {name}, got {toks[pos : pos + 4]}")
        begin = pos + 2
        if name[0] == "@":
            pos = begin
            sets[name] = []
            while toks[pos] != ";":
                t = toks[pos]
                sets[name] += sets[t] if t[0] == "@" else [t[1:-1].replace("\\'", "'") if t[0] == "'" else t]
                pos += 1
            pos += 1
            continue
        for restricted in (False, True) if mode else (False,):
            pos = begin
            rules[name + ("!" if restricted else "")] = alt()
            if toks[pos] != ";":
                raise ValueError(f"expected ; in {name}, got {toks[pos - 3 : pos + 4]}")
            pos += 1
        restricted = False
    return rules, sets


class Grammar:
    """Compiled tables. ``extra`` adds terminals to sets, which is how dialects differ; ``not_first`` names terminals with which a rule must not begin."""

    def __init__(self, text: str, start: str, extra: dict[str, list[str]] | None = None, not_first: dict[str, list[str]] | None = None) -> None:
        rules, sets = _read(text)
        rules["%start"] = ("seq", [("n", start), ("t", END)])
        for k, more in (extra or {}).items():
            sets[k] = sets[k] + more
        names: set[str] = set()

        def walk(x):
            if x[0] == "t":
                names.add(x[1])
            elif x[0] == "set":
                names.update(sets[x[1]])
            elif x[0] == "n":
                if x[1] not in rules:
                    raise ValueError(f"undefined {x[1]}")
            elif x[0] in ("alt", "seq"):
                for y in x[1]:
                    walk(y)
            else:
                walk(x[1])

        for r in rules.values():
            walk(r)
        names -= {"%any"}
        names |= {END, "OTHER"}
        self.terminals = sorted(names)
        self.ids = {t: i for i, t in enumerate(self.terminals)}
        self.other = self.ids["OTHER"]
        brackets = set("()[]{}") | {END, ASI}
        any_ids = [self.ids[t] for t in self.terminals if t not in brackets]
        self.term: list[dict[int, int]] = []
        self.nont: list[list[tuple[str, int]]] = []
        self.final: list[bool] = []
        self.owner: list[str] = []
        self.start_of: dict[str, int] = {}
        for name, body in rules.items():
            self._automaton(name, body, sets, any_ids)
        self.not_first = {a: {self.ids[t] for t in ts if t in self.ids} for a, ts in (not_first or {}).items()}
        self._sets()
        self.start = self.start_of["%start"]
        self.asi = self.ids.get(ASI, -1)
        self.closers = {self.ids[t] for t in ("}", END) if t in self.ids}
        self.moves: list[dict[int, tuple | None]] = [{} for _ in self.term]
        self.leaps: dict[tuple[int, str], dict] = {}
        self.lines: dict[str, list[int]] = {}  # tokens of lines, kept by the lexers
        self.watched: dict[Node, int] = {}  # nodes of the stack that a stretch begins with, by depth
        self.deepest = 0  # so many of them have been looked at
        ends = "".join(re.escape(chr(self.ids[t] | nl)) for t in STRETCH_ENDS if t in self.ids for nl in (0, NL))
        self.cut = re.compile(f"[^{ends}]*[{ends}]|[^{ends}]+" if ends else "[^\\0]+|\\0", re.S).findall

    def _automaton(self, name, body, sets, any_ids) -> None:
        eps: list[list[int]] = []
        arc: list[list[tuple]] = []

        def new():
            eps.append([])
            arc.append([])
            return len(eps) - 1

        def build(x):
            a, b = new(), new()
            if x[0] == "t":
                labels = any_ids if x[1] == "%any" else [self.ids[x[1]]]
                arc[a] += [(t, b) for t in labels]
            elif x[0] == "set":
                arc[a] += [(self.ids[t], b) for t in sets[x[1]]]
            elif x[0] == "n":
                arc[a].append((x[1], b))
            elif x[0] == "seq":
                at = a
                for y in x[1]:
                    s, e = build(y)
                    eps[at].append(s)
                    at = e
                eps[at].append(b)
            elif x[0] == "alt":
                for y in x[1]:
                    s, e = build(y)
                    eps[a].append(s)
                    eps[e].append(b)
            else:
                s, e = build(x[1])
                eps[a].append(s)
                eps[e].append(b)
                if x[0] in "?*":
                    eps[a].append(b)
                if x[0] in "*+":
                    eps[e].append(s)
            return a, b

        first, last = build(body)

        def close(states):
            todo, seen = list(states), set(states)
            while todo:
                for y in eps[todo.pop()]:
                    if y not in seen:
                        seen.add(y)
                        todo.append(y)
            return frozenset(seen)

        base = len(self.term)
        start = close([first])
        number, order = {start: base}, [start]
        self.start_of[name] = base
        for states in order:
            step: dict = {}
            for s in states:
                for label, to in arc[s]:
                    step.setdefault(label, set()).add(to)
            self.term.append({})
            self.nont.append([])
            self.final.append(last in states)
            self.owner.append(name)
            for label, to in step.items():
                to = close(to)
                if to not in number:
                    number[to] = base + len(order)
                    order.append(to)
                if isinstance(label, str):
                    self.nont[number[states]].append((label, number[to]))
                else:
                    self.term[number[states]][label] = number[to]

    def _sets(self) -> None:
        n = range(len(self.term))
        empty: set[int] = set()  # states from which the end of the rule is reached without input
        changed = True
        while changed:
            changed = False
            for s in n:
                if s not in empty and (self.final[s] or any(self.start_of[a] in empty and to in empty for a, to in self.nont[s])):
                    empty.add(s)
                    changed = True
        self.nullable = {a for a, s in self.start_of.items() if s in empty}
        first: list[set[int]] = [set(self.term[s]) for s in n]
        changed = True
        while changed:
            changed = False
            for s in n:
                size = len(first[s])
                for a, to in self.nont[s]:
                    first[s] |= first[self.start_of[a]]
                    if a in self.nullable:
                        first[s] |= first[to]
                changed |= len(first[s]) != size
        follow: dict[str, set[int]] = {a: set() for a in self.start_of}
        changed = True
        while changed:
            changed = False
            for s in n:
                for a, to in self.nont[s]:
                    size = len(follow[a])
                    follow[a] |= first[to]
                    if to in empty:
                        follow[a] |= follow[self.owner[s]]
                    changed |= len(follow[a]) != size
        for a, kept_out in self.not_first.items():
            first[self.start_of[a]] -= kept_out
        self.first, self.follow = first, follow

    def _compute(self, s: int, t: int) -> tuple | None:
        """Moves of state s on token t: ('shift', returns, state) or ('fork', moves) or ('pop',) or None."""
        bare = t & (NL - 1)
        seen_as = {bare}
        if self.asi >= 0 and (t >= NL or bare in self.closers):
            seen_as.add(self.asi)
        out: list[tuple] = []
        done = set()

        def visit(x):
            if x in done:
                return
            done.add(x)
            if bare in self.term[x]:
                out.append((0, self.term[x][bare]))
            if self.asi in seen_as and self.asi in self.term[x]:
                out.append((4, self.term[x][self.asi]))
            for a, to in self.nont[x]:
                b = self.start_of[a]
                if self.first[b] & seen_as:
                    tail = self.final[to] and not self.term[to] and not self.nont[to]
                    out.append((3, b) if tail else (1, b, to))
                if a in self.nullable:
                    visit(to)
            if self.final[x] and self.follow[self.owner[x]] & seen_as:
                out.append((2,))

        visit(s)
        return tuple(dict.fromkeys(out)) or None

    def move(self, s: int, t: int) -> tuple | None:
        """Memoised _compute, with chains of single calls folded into one move (5, calls, shift state)."""
        found = self._compute(s, t)
        if found is not None and len(found) == 1 and found[0][0] in (1, 3):
            calls, at, hops = [], found, 0
            while at is not None and len(at) == 1 and at[0][0] in (1, 3) and hops < 60:
                if at[0][0] == 1:
                    calls.append((at[0][1], at[0][2]))
                at = self._compute(at[0][1], t)
                hops += 1
            if at is not None and len(at) == 1 and at[0][0] == 0:
                found = ((5, tuple(calls), at[0][1]),)
        self.moves[s][t] = found
        return found

    def recognise(self, tokens: Sequence[int]) -> int:
        """-1 if the tokens (closed by END) form the start symbol, else the index of the first token that fits nowhere.

        The tokens are taken in stretches that end with a bracket of a block or the end of a statement. What a stretch does to a
        single stack is remembered: the return states it takes off, those it puts on, and the state it ends in.
        """
        active: list[tuple[int, Node]] = [(self.start, Node())]
        i = at = 0
        stretches = self.cut("".join(map(chr, tokens)))
        while at < len(stretches):
            taken = stretches[at]
            if len(active) == 1:
                # A stretch at whose end several stacks are left is taken together with those after it.
                for more in range(at + 1, at + 1 + TOGETHER):
                    after = self._leap(*active[0], taken)
                    if after is not None or more >= len(stretches):
                        break
                    taken += stretches[more]
                if after is not None:
                    active, i, at = [after], i + len(taken), more
                    continue
            for c in stretches[at]:
                active = self._step(active, ord(c))
                if active is None:
                    return i
                i += 1
            at += 1
        return -1

    def _leap(self, s: int, node: Node, stretch: str) -> tuple[int, Node] | None:
        """The state and stack after a stretch that begins and ends with one stack."""
        known = self.leaps.get((s, stretch))
        if known is FORKS:
            return None
        if known is None:
            if len(self.leaps) > MOST_LEAPS:
                self.leaps.clear()
            known = self.leaps[s, stretch] = {}
        for size, by_returns in known.items():
            line, returns = [node], []
            while len(returns) < size and len(line[-1].edges) == 1:
                r, below = line[-1].edges[0]
                returns.append(r)
                line.append(below)
            found = by_returns.get(tuple(returns)) if len(returns) == size else None
            if found is not None:
                at = line[found[0]]
                for r in found[1]:
                    new = Node()
                    new.edges.append((r, at))
                    at = new
                return found[2], at
        return self._learn(s, node, stretch, known)

    def _learn(self, s: int, node: Node, stretch: str, known: dict) -> tuple[int, Node] | None:
        """Take a stretch token by token and remember what it does to the stack, whatever forks meet again within it.

        It holds for every stack with the same return states as far down as any branch has looked. None where several stacks are
        left or a token fits nowhere.
        """
        line, depth = [node], {node: 0}
        while len(line[-1].edges) == 1 and len(line) < 200:
            line.append(line[-1].edges[0][1])
            depth[line[-1]] = len(line) - 1
        self.watched, self.deepest = depth, 0
        active: list[tuple[int, Node]] | None = [(s, node)]
        for c in stretch:
            active = self._step(active, ord(c))
            if active is None:
                break
        looked, self.watched = self.deepest, {}
        if active is None:
            return None
        if len(active) == 1 and looked < len(line):
            end, at = active[0]
            on = []
            while at not in depth and len(at.edges) == 1:
                r, at = at.edges[0]
                on.append(r)
            if at in depth and depth[at] <= looked:
                known.setdefault(looked, {})[tuple(x.edges[0][0] for x in line[:looked])] = (depth[at], tuple(reversed(on)), end)
                return active[0]
        self.leaps[s, stretch] = FORKS
        return None

    def _step(self, active: list[tuple[int, Node]], t: int) -> list[tuple[int, Node]] | None:
        """The descriptors after a token, None if it fits nowhere."""
        moves, watched = self.moves, self.watched
        nodes: dict[int, Node] = {}
        if len(active) == 1:
            s, node = active[0]
            while True:  # as long as one move is open, no descriptor is kept
                m = moves[s]
                a = m[t] if t in m else self.move(s, t)
                if a is None:
                    return None
                if len(a) > 1:
                    break
                a = a[0]
                k = a[0]
                if k == 0:
                    s = a[1]
                    active = [(s, node)]
                    s = -1
                    break
                if k == 2:
                    if node in watched and watched[node] >= self.deepest:
                        self.deepest = watched[node] + 1
                    e = node.edges
                    if len(e) != 1:
                        if not e:
                            return None
                        break
                    s, node = e[0]
                elif k == 5:
                    shared = False
                    for b, to in a[1]:
                        old = nodes.get(b)
                        if old is not None:
                            old.edges.append((to, node))
                            shared = True
                            break
                        new = nodes[b] = Node()
                        new.edges.append((to, node))
                        node = new
                    if shared:
                        return None  # a left recursion without an exit on this token
                    active = [(a[2], node)]
                    s = -1
                    break
                elif k == 1:
                    old = nodes.get(a[1])
                    if old is not None:
                        break
                    new = nodes[a[1]] = Node()
                    new.edges.append((a[2], node))
                    s, node = a[1], new
                else:  # 3, 4
                    s = a[1]
            if s == -1:
                return active
            active = [(s, node)]
        work, seen, after = list(active), set(active), {}
        while work:
            s, node = work.pop()
            m = moves[s]
            found = m[t] if t in m else self.move(s, t)
            if found is None:
                continue
            for a in found:
                k = a[0]
                if k == 0:
                    after[(a[1], node)] = None
                elif k == 2:
                    if node in watched and watched[node] >= self.deepest:
                        self.deepest = watched[node] + 1
                    for d in node.edges:
                        if d not in seen:
                            seen.add(d)
                            work.append(d)
                elif k == 1 or k == 5:
                    at, fresh = node, True
                    for b, to in ((a[1], a[2]),) if k == 1 else a[1]:
                        edge = (to, at)
                        at = nodes.get(b)
                        if at is None:
                            at = nodes[b] = Node()
                            at.edges.append(edge)
                        else:
                            if edge not in at.edges:
                                at.edges.append(edge)
                            fresh = False
                            if k == 5:
                                break
                    if k == 5:
                        if fresh:
                            after[(a[2], at)] = None
                    elif (a[1], at) not in seen:
                        seen.add((a[1], at))
                        work.append((a[1], at))
                elif (d := (a[1], node)) not in seen:
                    seen.add(d)
                    work.append(d)
        return list(after) or None
