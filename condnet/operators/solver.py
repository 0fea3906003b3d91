"""Decision procedure for condition lists: contradiction, tautology, implication, redundancy.

Two theories share no terms. Integers: terms of a `<=` comparison, lengths `l(...)`, and what is compared with them, decided by
difference bounds (no negative cycle). Strings: everything else, decided by merging equal terms, closing the order graph
(constants in code-point order, '' the least) and looking for a strict cycle. Disjunctions, and `!=` between integers, are
searched with backtracking, however many there are: a partial choice that contradicts itself goes no further. Kept as
satisfiable: a string that would have to lie between two neighbours in the order.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import lru_cache

from condnet.operators.conditions import NO_PATH, Atom, Condition, parse, variable


def _number(term: str) -> int | None:
    t = term.strip()
    body = t[1:] if t[:1] in "+-" else t
    return int(t) if body.isascii() and body.isdigit() else None


def _length(term: str) -> bool:
    return term.startswith("l(") and term.endswith(")")


def integers(conds: Iterable[Condition]) -> frozenset[str]:
    """The variables that stand for integers."""
    atoms = [a for c in conds for a in c]
    out = {t for a in atoms for t in (a.left, a.right) if _length(t)}
    for a in atoms:
        if a.op == "<=" and all(variable(t) or _number(t) is not None for t in (a.left, a.right)):
            out |= {t for t in (a.left, a.right) if variable(t)}
    grown = True
    while grown:
        grown = False
        for a in atoms:
            if variable(a.left) and variable(a.right) and (a.left in out) != (a.right in out):
                out |= {a.left, a.right}
                grown = True
    return frozenset(out)


def _is_int(a: Atom, ints: frozenset[str]) -> bool:
    sides = [(t in ints) if variable(t) else None for t in (a.left, a.right)]
    numbers = all(variable(t) or _number(t) is not None for t in (a.left, a.right))
    if sides == [None, None]:
        return a.op == "<=" and numbers
    return numbers and any(s for s in sides)


def _int_sat(atoms: Sequence[Atom]) -> bool:
    """Difference bounds a - b <= k over the atoms (no !=)."""
    edges: list[tuple[str, str, int]] = []

    def le(a: str, b: str, k: int) -> None:
        na, nb = _number(a) if not variable(a) else None, _number(b) if not variable(b) else None
        edges.append(("" if na is not None else a, "" if nb is not None else b, k - (na or 0) + (nb or 0)))

    for a in atoms:
        if a.op in ("<=", "=="):
            le(a.left, a.right, 0)
        if a.op in (">=", "=="):
            le(a.right, a.left, 0)
        if a.op == "<":
            le(a.left, a.right, -1)
        if a.op == ">":
            le(a.right, a.left, -1)
    names = {n for x, y, _ in edges for n in (x, y)}
    # lengths are at least 0
    edges += [("", n, 0) for n in names if _length(n)]
    dist = dict.fromkeys(names | {""}, 0)
    for _ in range(len(dist)):
        changed = False
        for x, y, k in edges:
            if dist[y] + k < dist[x]:
                dist[x] = dist[y] + k
                changed = True
        if not changed:
            return True
    return False


def _str_sat(atoms: Sequence[Atom]) -> bool:
    root: dict[str, str] = {}

    def find(t: str) -> str:
        root.setdefault(t, t)
        while root[t] != t:
            t = root[t]
        return t

    # a variable and a constant never share a name, as only variables start with a letter
    for a in atoms:
        find(a.left), find(a.right)
        if a.op == "==":
            root[find(a.left)] = find(a.right)
    ordered = any(a.op not in ("==", "!=") for a in atoms)
    if ordered:
        find("")
    while True:
        value: dict[str, str] = {}
        for t in root:
            if not variable(t):
                if value.setdefault(find(t), t) != t:
                    return False
        if any(find(a.left) == find(a.right) for a in atoms if a.op in ("!=", "<", ">")):
            return False
        if not ordered:
            return True
        nodes = {find(t) for t in root}
        below: dict[str, set[str]] = {n: set() for n in nodes}  # n <= each of these
        strict: set[tuple[str, str]] = set()

        def add(x: str, y: str, s: bool) -> None:
            below[x].add(y)
            if s:
                strict.add((x, y))

        for a in atoms:
            x, y = find(a.left), find(a.right)
            if a.op in ("<", "<="):
                add(x, y, a.op == "<")
            elif a.op in (">", ">="):
                add(y, x, a.op == ">")
        consts = sorted((v, n) for n, v in value.items())
        for (_, x), (_, y) in zip(consts, consts[1:]):
            add(x, y, True)
        least = find("")
        for n in nodes:
            if n != least:
                below[least].add(n)
        reach: dict[str, set[str]] = {}
        for n in nodes:
            seen, todo = set(), [n]
            while todo:
                for m in below[todo.pop()]:
                    if m not in seen:
                        seen.add(m)
                        todo.append(m)
            reach[n] = seen
        if any(x in reach[y] for x, y in strict):
            return False
        merged = False
        for x in nodes:
            for y in reach[x]:
                if x != y and x in reach[y] and find(x) != find(y):
                    root[find(x)] = find(y)
                    merged = True
        if not merged:
            return True


def _ground(a: Atom, as_int: bool) -> bool | None:
    if variable(a.left) or variable(a.right):
        return None
    x, y = (_number(a.left), _number(a.right)) if as_int else (a.left, a.right)
    return {"==": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[a.op]


def _choices(conds: Sequence[Condition], ints: frozenset[str]) -> list[list[tuple[Atom, bool]]]:
    """For each condition that isn't valid by itself the atoms, marked as of integers or not, of which one must hold."""
    choices: list[list[tuple[Atom, bool]]] = []
    for c in conds:
        options: list[tuple[Atom, bool]] = []
        valid = False
        for a in c:
            i = _is_int(a, ints)
            g = _ground(a, i)
            if g:
                valid = True
                break
            if g is None:
                options += [(Atom(a.left, "<", a.right), True), (Atom(a.left, ">", a.right), True)] if i and a.op == "!=" else [(a, i)]
        if not valid:
            choices.append(options)
    return choices


def _apart(choices: list[list[tuple[Atom, bool]]]) -> list[list[list[tuple[Atom, bool]]]]:
    """The choices in sets that share no variable."""
    sets: list[tuple[set[str], list[list[tuple[Atom, bool]]]]] = []
    for c in choices:
        names, mine = {t for a, _ in c for t in (a.left, a.right) if variable(t)}, [c]
        rest = []
        for n, m in sets:
            if n & names:
                names, mine = n | names, m + mine
            else:
                rest.append((n, m))
        sets = [*rest, (names, mine)]
    return [m for _, m in sets]


def satisfiable(conds: Sequence[Condition], ints: frozenset[str]) -> bool:
    return all(map(_search, _apart(_choices(conds, ints))))


def _search(first: list[list[tuple[Atom, bool]]]) -> bool:
    """Depth-first: each step drops the options that contradict what is picked and picks for the choice with fewest left."""

    def fits(picked: tuple[tuple[Atom, bool], ...], i: bool) -> bool:
        mine = [a for a, k in picked if k == i]
        return _int_sat(mine) if i else _str_sat(mine)

    sure = tuple(c[0] for c in first if len(c) == 1)
    if not all(first) or not fits(sure, True) or not fits(sure, False):
        return False
    todo = [(sure, [c for c in first if len(c) > 1])]
    while todo:
        picked, choices = todo.pop()
        while True:
            left = [[o for o in c if fits((*picked, o), o[1])] for c in choices]
            if not all(left):
                break
            forced = [c[0] for c in left if len(c) == 1]
            choices = [c for c in left if len(c) > 1]
            if not forced:
                if not choices:
                    return True
                at = min(range(len(choices)), key=lambda k: len(choices[k]))
                rest = choices[:at] + choices[at + 1 :]
                todo += [((*picked, o), rest) for o in reversed(choices[at])]
                break
            picked = (*picked, *forced)
            if not fits(picked, True) or not fits(picked, False):
                break
    return False


def _implies(p: Condition, q: Condition, ints: frozenset[str]) -> bool:
    return not satisfiable([p, *((a.negated(),) for a in q)], ints)


def _valid(c: Condition, ints: frozenset[str]) -> bool:
    return not satisfiable([(a.negated(),) for a in c], ints)


def _parsed(conds: Sequence[str]) -> tuple[list[Condition], frozenset[str]]:
    got = [parse(c) for c in conds]
    return got, integers(got)


def is_contradiction(conds: Sequence[str] | None) -> bool:
    """No world satisfies all conditions. A condition that names the special constant nopath never holds."""
    if not conds:
        return False
    if any(NO_PATH in c for c in conds):
        return True
    return not satisfiable(*_parsed(conds))


def is_tautology(conds: Sequence[str] | None) -> bool:
    """Every world satisfies all conditions."""
    if not conds:
        return True
    if any(NO_PATH in c for c in conds):
        return False
    got, ints = _parsed(conds)
    return all(_valid(c, ints) for c in got)


def _dropped(conds: Sequence[str]) -> list[int]:
    return _implied(*_parsed(conds))


def _implied(got: Sequence[Condition], ints: frozenset[str]) -> list[int]:
    n = len(got)
    imp = [[i != j and (got[i] == got[j] or _implies(got[i], got[j], ints)) for j in range(n)] for i in range(n)]
    return [j for j in range(n) if any(imp[i][j] and (not imp[j][i] or i < j) for i in range(n))]


def has_redundant(conds: Sequence[str] | None) -> bool:
    """Some condition is implied by another."""
    return bool(conds) and len(conds) > 1 and bool(_dropped(conds))


def remove_redundant(conds: Sequence[str] | None) -> list[str]:
    """The conditions that no other implies, in order; of equivalent ones the first."""
    if not conds:
        return []
    gone = set(_dropped(conds))
    return [c for j, c in enumerate(conds) if j not in gone]


def _shape(conds: Sequence[str]) -> tuple[tuple[tuple[str, str, str], ...], ...]:
    """The list with variables, and constants that are only compared for equality, numbered: lists of one shape are decided alike."""
    got, ints = _parsed(conds)
    kinds = [[_is_int(a, ints) for a in c] for c in got]
    exact = any(not i and a.op not in ("==", "!=") for c, ks in zip(got, kinds) for a, i in zip(c, ks))
    names: dict[str, str] = {}
    consts: dict[str, str] = {}

    def name(t: str, is_int: bool) -> str:
        if variable(t):
            if t not in names:
                names[t] = f"l(v{len(names)})" if _length(t) else f"v{len(names)}"
            return names[t]
        return t if is_int or exact else consts.setdefault(t, f"[{len(consts)}]")

    return tuple(tuple((name(a.left, i), a.op, name(a.right, i)) for a, i in zip(c, ks)) for c, ks in zip(got, kinds))


@lru_cache(maxsize=100_000)
def _kept(shape: tuple[tuple[tuple[str, str, str], ...], ...]) -> tuple[int, ...] | None:
    """None for a contradiction, () for a tautology, else the places of the conditions to keep."""
    got = [tuple(Atom(*a) for a in c) for c in shape]
    ints = integers(got)
    if not satisfiable(got, ints):
        return None
    if all(_valid(c, ints) for c in got):
        return ()
    gone = set(_implied(got, ints))
    return tuple(j for j in range(len(got)) if j not in gone)


def normalized(conds: tuple[str, ...]) -> tuple[str, ...] | None:
    """None for a contradiction, () for a tautology, else the list without redundant conditions."""
    if not conds:
        return ()
    if any(NO_PATH in c for c in conds):
        return None
    kept = _kept(_shape(conds))
    return None if kept is None else tuple(conds[j] for j in kept)
