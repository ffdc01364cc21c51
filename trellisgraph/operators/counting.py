"""Counts over joined patterns, without the joined rows.

Where patterns meet in a node, every row of one goes with every row of the other: customers and suppliers of one nation make
a product that grows with the square of the tables. A statement that only counts such rows needs none of them. Each piece of
its patterns is reduced to the columns that are read later and the number of rows that share them, pieces are joined in this
form, and the numbers are multiplied. So what is joined grows with the distinct values read, not with their pairs.

DIFFERENT EDGES keeps apart edges of two pieces that may come from one fragment. Comparing them would need every edge, so
rows with equal edges are counted as well and taken off: all pairs, less those that agree in one pair of edges, plus those
that agree in two, and so on. Rows that agree are found by an equi-join on the edge.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lang.nodes import Clause, EdgePattern, Linear, Match, NodePattern, Result, walk
from ..lang.parser import AGGREGATES
from ..plans.binder import labeled, names_in
from ..plans.scope import Element, Table, fresh
from .match import Matcher, State, conjuncts

#: Pairs of edges that are compared by taking off; each doubles the number of joins. With more the rows are joined as they are.
MOST_PAIRS = 3


@dataclass
class Piece:
    """Part of a path: its factors, nodes known before it by position, and whether it goes on where the piece before ends."""

    factors: list
    shared: dict = field(default_factory=dict)
    goes_on: bool = False

    @property
    def edges(self) -> list:
        return [f for f in self.factors if isinstance(f, EdgePattern)]


def counted(tree: Linear) -> bool:
    """Whether a statement joins fixed patterns and returns nothing but counts and grouping keys."""
    clauses = [c for c in tree.clauses if not (isinstance(c, Clause) and c.kind == "use")]
    matches = [c for c in clauses if isinstance(c, Match)]
    if not matches or any(isinstance(c, Clause) and c.kind == "use" for c in tree.clauses[tree.clauses.index(matches[0]) :]):
        return False
    if clauses[0] is not matches[0] or not all(isinstance(c, Match) or isinstance(c, Clause) and c.kind in ("let", "filter") for c in clauses):
        return False
    res = tree.result
    if res is None or res.finish or res.items is None:
        return False
    calls = [x for x in walk(_trees(res)) if isinstance(x, tuple) and x and x[0] == "call" and x[1] in AGGREGATES]
    if not calls or any(x[1] != "COUNT" or x[2] for x in calls):
        return False
    values = {name.lower() for c in clauses if isinstance(c, Clause) and c.kind == "let" for name, _, _ in c.items}
    nodes, edges, hops = set(), [], 0
    for m in matches:
        if m.optional or m.keep or m.yields is not None:
            return False
        for p in m.patterns:
            if p.selector != ("all",) or p.var or p.mode not in (None, "walk") or not isinstance(p.path, list):
                return False
            for f in p.path:
                if not isinstance(f, (NodePattern, EdgePattern)) or getattr(f, "quantifier", None):
                    return False
                own = {f.var.lower()} if f.var else set()
                if not names_in([a for _, a in f.properties]) <= own:
                    return False
                if isinstance(f, EdgePattern):
                    edges += own
                else:
                    nodes |= own
            kinds = [isinstance(f, EdgePattern) for f in p.path]
            if len(kinds) % 2 == 0 or kinds != [i % 2 == 1 for i in range(len(kinds))]:
                return False  # not node, edge, node
            hops += max(1, sum(kinds))
    return hops > 1 and len(set(edges)) == len(edges) and not nodes & set(edges) and not values & (nodes | set(edges))


def counting_rows(res: Result, clauses: list) -> Result:
    """COUNT of an element that cannot be null counts rows."""
    sure = {f.var.lower() for m in clauses if isinstance(m, Match) for p in m.patterns for f in p.path if f.var} - {alias.lower() for _, alias in res.items if alias}

    def change(ast):
        if isinstance(ast, tuple):
            if len(ast) == 4 and ast[0] == "call" and ast[1] == "COUNT" and len(ast[3]) == 1 and ast[3][0][:1] == ("var",) and ast[3][0][1].lower() in sure:
                return (*ast[:3], type(ast[3])([("star",)]))
            return tuple(change(a) for a in ast)
        return [change(a) for a in ast] if isinstance(ast, list) else ast

    order = [replace(o, expr=change(o.expr)) for o in res.page.order]
    return replace(res, items=[(change(a), alias) for a, alias in res.items], having=change(res.having), page=replace(res.page, order=order))


def _trees(res: Result) -> list:
    return [a for a, _ in res.items] + list(res.group or []) + ([res.having] if res.having else []) + [o.expr for o in res.page.order]


def read_later(clauses: list, res: Result) -> dict:
    """Folded name: the properties that are read of it, or None for all of it. Of names in patterns all is read."""
    return _uses([clauses, _trees(res)], {})


def _uses(tree, out: dict) -> dict:
    """Add what a tree reads."""
    if isinstance(tree, tuple) and len(tree) == 3 and tree[0] == "prop" and isinstance(tree[1], tuple) and tree[1][:1] == ("var",) and isinstance(tree[2], str):
        name = tree[1][1].lower()
        if out.get(name, ()) is not None:
            out.setdefault(name, set()).add(tree[2].lower())
        return out
    if isinstance(tree, tuple) and len(tree) == 2 and tree[0] == "var" and isinstance(tree[1], str):
        out[tree[1].lower()] = None
    elif isinstance(tree, (list, tuple)):
        for x in tree:
            _uses(x, out)
    elif hasattr(tree, "__dataclass_fields__"):
        if getattr(tree, "var", None):
            out[tree.var.lower()] = None
        for f in tree.__dataclass_fields__:
            _uses(getattr(tree, f), out)
    return out


def pieces_of(match: Match, hops: bool, known: set) -> list[Piece]:
    """The paths of a clause, or with ``hops`` each edge by itself."""
    out, known = [], set(known)
    for p in match.patterns:
        cuts = range(0, max(1, len(p.path) - 2), 2) if hops else [0]
        for at in cuts:
            factors = list(p.path[at : at + 3] if hops else p.path)
            goes_on = at > 0
            piece = Piece(factors, goes_on=goes_on)
            for i in range(0, len(factors), 2):
                var = factors[i].var and factors[i].var.lower()
                if goes_on and i == 0:
                    factors[0] = NodePattern()
                elif var in known:
                    piece.shared[i // 2] = factors[i]
                    factors[i] = NodePattern()
            known |= {f.var.lower() for f in factors if f.var}
            out.append(piece)
    return out


class Counter:
    """Matches one clause over a table, each row of which stands for as many rows as its column ``weight`` says (None: one)."""

    def __init__(self, matcher: Matcher, match: Match):
        self.matcher = matcher
        self.match = match

    def plan(self, known: set) -> tuple[list[Piece], list] | None:
        """(pieces, pairs of edges to take off): single hops if that takes off one pair at most, else whole paths."""
        for hops, most in ((True, 1), (False, MOST_PAIRS)):
            pieces = pieces_of(self.match, hops, known)
            pairs = self.pairs(pieces)
            if len(pairs) <= most:
                return pieces, pairs
        return None

    def pairs(self, pieces: list[Piece]) -> list[tuple]:
        """((piece, edge), (later piece, edge)) that may be the same edge."""
        if not self.matcher.different:
            return []
        places = [(i, j, self.matcher.edge_fragments(e)) for i, p in enumerate(pieces) for j, e in enumerate(p.edges)]
        return [((i, j), (k, m)) for i, j, a in places for k, m, b in places if i < k and a & b]

    def run(self, table: Table, weight: str | None, pieces: list[Piece], pairs: list, later: dict, more: bool) -> tuple[Table, str]:
        """(matches, their weight); with ``more`` to be joined they are reduced to what is read later."""
        m = self.matcher
        if self.match.where is not None:
            m.waiting += conjuncts(self.match.where)
        found = [self.alone(p) for p in pieces]
        waiting, m.waiting = m.waiting, []
        parts = []
        for n in range(len(pairs) + 1):
            for equal in combinations(pairs, n):
                here, number = self.term(table, weight, pieces, found, waiting, equal, later)
                sign = F.lit(1 if n % 2 == 0 else -1).cast("bigint")
                parts.append((here, sign if number is None else sign * F.col(number)))
        scope, signed = parts[0][0].scope, fresh("weight")
        columns = kept(scope, later, parts[0][0].df)
        rows = reduce(DataFrame.unionAll, [here.df.select(*columns, w.alias(signed)) for here, w in parts])
        if more:
            rows, signed = reduced(rows, columns, signed)
        return Table(rows, scope), signed

    def alone(self, piece: Piece) -> tuple[Table, State] | None:
        """The matches of a piece over no input; none if it only names a node again."""
        if not piece.edges and piece.shared:
            return None
        m = self.matcher
        table, state = m.path(Table(m.spark.range(0, 1, 1, 1).select(), {}, unit=True), State(), piece.factors, "walk", outermost=True)
        table, state = m.close(table, state)
        return m.flush(table), state

    def term(self, left: Table, weight: str | None, pieces: list[Piece], found: list, waiting: list, equal: tuple, later: dict) -> tuple[Table, str | None]:
        """The matches in which these pairs of edges are equal, whatever the other edges are."""
        m = self.matcher
        m.waiting = list(waiting)
        edge: dict = {}  # (piece, edge): column
        end = None  # where the next piece goes on
        for i, (piece, right) in enumerate(zip(pieces, found, strict=True)):
            following = pieces[i + 1 :]
            for node in piece.shared.values():
                element = left.find(node.var)
                if node.labels is not None:
                    left = left.where(labeled(element, node.labels))
                left = m.inline(left, element, node)
            if right is not None:
                table, state = right
                edge.update({(i, j): c for j, (_, c) in enumerate(state.edges)})
                on = [(left.find(node.var).id, state.nodes[at][1]) for at, node in piece.shared.items()]
                on += [(end, state.nodes[0][1])] if piece.goes_on else []
                on += [(edge[a], edge[b]) for a, b in equal if b[0] == i]
                end = state.nodes[-1][1] if following and following[0].goes_on else None
                held = [edge[a] for a, _ in equal if a[0] == i] + ([end] if end else [])
                columns = [*kept(table.scope, self.reads(later, following), table.df), *held, *[b for _, b in on]]
                whole = {c for _, c in state.nodes + state.edges} <= set(columns)  # then no two rows are alike
                rows, number = (table.df.select(*dict.fromkeys(columns)), None) if whole else reduced(table.df, columns, None)
                df, weight = joined(left, weight, rows, number, on)
                left = Table(df, {**left.scope, **table.scope})
            left = m.flush(left, last=not following)
            if following:
                held = [edge[a] for a, b in equal if a[0] <= i < b[0]] + ([end] if end else [])
                df, weight = reduced(left.df, [*kept(left.scope, self.reads(later, following), left.df), *held], weight)
                left = Table(df, left.scope)
        return left, weight

    def reads(self, later: dict, following: list[Piece]) -> dict:
        """What is read after a piece: by conditions that wait, the pieces that follow, and later clauses."""
        out = {n: None if p is None else set(p) for n, p in later.items()}
        return _uses([self.matcher.waiting, [p.factors for p in following], [list(p.shared.values()) for p in following]], out)


def kept(scope: dict, reads: dict, df: DataFrame) -> list[str]:
    """The columns of a table that are read later."""
    out: dict = {}
    for name, (_, binding) in scope.items():
        if name not in reads:
            continue
        columns = binding.columns()
        if isinstance(binding, Element) and reads[name] is not None:
            hits = [binding.properties[p] for p in sorted(reads[name]) if p in binding.properties]
            columns = [c for _, column, _, variants in hits for c in (column, *(variants or {}).values())]
        out.update(dict.fromkeys(columns))
    there = set(df.columns)
    return [c for c in out if c in there]


def reduced(df: DataFrame, columns: list[str], weight: str | None) -> tuple[DataFrame, str]:
    """(distinct values of columns, how many rows have them)."""
    number = fresh("weight")
    total = F.count(F.lit(1)) if weight is None else F.coalesce(F.sum(weight), F.lit(0).cast("bigint"))
    return df.groupBy(*dict.fromkeys(columns)).agg(total.alias(number)), number


def joined(left: Table, weight: str | None, rows: DataFrame, number: str | None, on: list) -> tuple[DataFrame, str | None]:
    """An equi-join on these columns, and the product of the weights."""
    if left.unit:
        return rows, number
    df = left.df.join(rows, reduce(lambda a, b: a & b, [F.col(a) == F.col(b) for a, b in on])) if on else left.df.crossJoin(rows)
    if weight is None or number is None:
        return df, weight or number
    product = fresh("weight")
    return df.withColumn(product, F.col(weight) * F.col(number)).drop(weight, number), product
