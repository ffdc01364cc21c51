"""Graph patterns: scans, hops, quantified paths, groups, alternatives and selectors as joins and windows.

A path in progress is a table with the columns of its bindings, the end node's id, and its parts: ids of single nodes and
edges, or arrays of them where the length varies. Fixed chains never build arrays, so they stay plain joins that Catalyst
reorders; arrays appear only where a quantifier, a path value or a path mode needs them.

What depends on the input row (selectors, alternatives without repeats, OPTIONAL) is computed once for each distinct
combination of the input values that the pattern reads and joined back on them. No row numbers are needed, so nothing
depends on evaluation order.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidQuery, UnsupportedFeature
from ..functions.scalar import compare, spark_type
from ..lang.nodes import Alternatives, EdgePattern, Group, Match, NodePattern, PathPattern, Quantifier
from ..plans.binder import Context, bind, boolean, label_matches, labeled, names_in, properties_in, property_of
from ..plans.scope import Element, GraphRef, PathValue, Scalar, Table, check_new, fresh, typed_null
from ..sources.graph import ID, SOURCE, TARGET, spark_kind, unified

#: Levels of a quantified path that are planned lazily; longer ones are written level by level until none is reached.
LAZY_LEVELS = 8
_IDS = "array<bigint>"


@dataclass
class State:
    """A path in progress."""

    end: str | None = None
    start: str | None = None
    nodes: list = field(default_factory=list)  # (is array, column)
    edges: list = field(default_factory=list)
    #: Nothing matched yet but an unconstrained node.
    open: bool = False

    def copy(self) -> State:
        return State(self.end, self.start, list(self.nodes), list(self.edges), self.open)


def array_of(parts: list) -> Column:
    if not parts:
        return F.array().cast(_IDS)
    pieces = [F.col(c) if is_array else F.array(F.col(c)) for is_array, c in parts]
    return pieces[0] if len(pieces) == 1 else F.concat(*pieces)


def apart(a: tuple, b: tuple, sources: dict[str, frozenset]) -> Column:
    """Two parts share no element. Parts from different fragments never do, and then their ids need not be read."""
    one, other = sources.get(a[1]), sources.get(b[1])
    if one is not None and other is not None and not one & other:
        return F.lit(True)
    if a[0] and b[0]:
        return ~F.arrays_overlap(a[1], b[1])
    if a[0] or b[0]:
        many, one = (a, b) if a[0] else (b, a)
        return ~F.array_contains(many[1], F.col(one[1]))
    return F.col(a[1]) != F.col(b[1])


def scan(
    graph: GraphRef, kind: str, labels, wanted: set | None, directions: frozenset = frozenset("R"), spark=None, once: bool = False, only: set | None = None
) -> tuple[DataFrame, Element, str, str]:
    """(rows, element, from, to) of the fragments that a label expression selects; ``wanted`` None reads all properties.

    ``once`` gives undirected edges one way only; ``only`` restricts the fragments by number.
    """
    fits = []
    for i, f in enumerate(graph.data.fragments(kind)):
        if only is not None and i not in only:
            continue
        if label_matches(f.labels, labels) and (kind == "node" or (directions & frozenset("RL") if f.directed else "U" in directions)):
            fits.append((i, f))
    stored: dict[str, tuple[str, list]] = {}
    for i, f in fits:
        for name, t in f.properties:
            if wanted is None or name.lower() in wanted:
                stored.setdefault(name.lower(), (name, []))[1].append((i, name, t))
    id_column, number, source, target = fresh("id"), fresh("fragment"), fresh("from"), fresh("to")
    properties = {}
    for key, (display, places) in stored.items():
        kind_, mixed = unified([t for _, _, t in places])
        families = {}
        if mixed:
            for _, _, t in places:
                families.setdefault("float" if t in ("int", "float") and {"int", "float"} <= {x for _, _, x in places} else t, fresh(key))
        properties[key] = (display, fresh(key), kind_, families or None)
    element = Element(kind, graph, id_column, number, properties)

    def branch(i, f, ways: tuple[str, str] | None, skip_loops: bool) -> DataFrame:
        columns = [F.col(ID).alias(id_column), F.lit(i).alias(number)]
        if ways:
            columns += [F.col(ways[0]).alias(source), F.col(ways[1]).alias(target)]
        own = {name.lower(): (name, t) for name, t in f.properties}
        for key, (_, column, kind_, families) in properties.items():
            name, t = own.get(key, (None, None))
            value = F.col(f"`{name}`") if name else F.lit(None)
            columns.append(value.cast(spark_kind(kind_)).alias(column))
            for wide, c in (families or {}).items():
                fits_here = t == wide or wide == "float" and t == "int"
                columns.append((value if name and fits_here else F.lit(None)).cast(spark_kind(wide)).alias(c))
        rows = f.df.where(F.col(SOURCE) != F.col(TARGET)) if skip_loops else f.df
        return rows.select(*columns)

    branches = []
    for i, f in fits:
        if kind == "node":
            branches.append(branch(i, f, None, False))
            continue
        forward = "R" in directions if f.directed else True
        backward = "L" in directions if f.directed else True
        if forward:
            branches.append(branch(i, f, (SOURCE, TARGET), False))
        if backward and not (once and forward):
            branches.append(branch(i, f, (TARGET, SOURCE), forward))
    if not branches:
        schema = f"`{id_column}` bigint, `{number}` int" + (f", `{source}` bigint, `{target}` bigint" if kind == "edge" else "")
        for _, column, kind_, families in properties.values():
            schema += f", `{column}` {spark_kind(kind_)}"
        rows = spark.createDataFrame([], schema)
    else:
        rows = branches[0]
        for b in branches[1:]:
            rows = rows.unionAll(b)
    return rows, element, source, target


def conjuncts(ast) -> list:
    """The conditions that AND joins."""
    if isinstance(ast, tuple) and ast[:2] == ("bin", "AND"):
        return conjuncts(ast[2]) + conjuncts(ast[3])
    return [ast]


class Matcher:
    """Compiles one MATCH clause over a table."""

    def __init__(self, context: Context, graph: GraphRef, wanted: set | None, different: bool):
        self.context = context
        self.graph = graph
        self.wanted = wanted
        self.different = different
        self.spark = context.session.spark
        #: Fragments that the edges of a column can come from; columns that are not here may hold any edge.
        self.sources: dict[str, frozenset] = {}
        #: Predicates whose names are not all bound yet.
        self.waiting: list = []
        self.fresh_names: set[str] = set()

    # Clauses

    def run(self, table: Table, match: Match) -> Table:
        if match.keep or match.yields is not None:
            raise UnsupportedFeature("KEEP and YIELD in MATCH")
        selective = [p for p in match.patterns if p.selector != ("all",)]
        if len(match.patterns) > 1 and selective and self.different:
            raise UnsupportedFeature("selective paths beside others under DIFFERENT EDGES")
        used: list = []
        # Each condition of a WHERE that is joined by AND is applied as soon as its names are bound, so before long paths are
        # walked. Selectors choose before it applies.
        late = match.where is not None and bool(selective)
        if match.where is not None and not late:
            self.waiting += conjuncts(match.where)
        for pattern in match.patterns:
            by_row = pattern.selector != ("all",) or _has(pattern.path, (Alternatives,))
            if by_row and not table.unit:
                aside, self.waiting = self.waiting, []
                table, edges = self.by_key(table, [pattern], lambda t, p=pattern: self.pattern(t, p))
                self.waiting += aside
            else:
                table, edges = self.pattern(table, pattern)
            if self.different:
                for a in used:
                    for b in edges:
                        table = table.where(apart(a, b, self.sources))
            used += edges
        table = self.flush(table, last=True)
        if late:
            table = table.where(boolean(match.where, table, self.context, "WHERE"))
        return table

    def by_key(self, table: Table, trees: list, compute, how: str = "inner"):
        """``compute`` over the distinct input values that the trees read, joined back to every input row."""
        names = set().union(*[names_in(t) for t in trees]) & set(table.scope)
        read = set().union(*[properties_in(t) for t in trees])

        def trimmed(b):
            """Of an element only the properties that the trees read: fewer columns to tell apart."""
            return replace(b, properties={k: v for k, v in b.properties.items() if k in read}) if isinstance(b, Element) else b

        scope = {n: (table.scope[n][0], trimmed(table.scope[n][1])) for n in table.scope if n in names}
        sure = {b.id for _, b in scope.values() if isinstance(b, Element) and not b.conditional}
        columns = list(dict.fromkeys(c for _, b in scope.values() for c in b.columns()))
        keys = list(dict.fromkeys(c for _, b in scope.values() for c in ([b.id] if isinstance(b, Element) else b.columns())))
        if columns:
            inner = Table(table.df.select(*columns).distinct(), scope)
        else:
            inner = Table(self.spark.range(1).select(), {}, unit=True)
        found, extra = compute(inner)
        added = [c for c in dict.fromkeys([c for n, (_, b) in found.scope.items() if n not in scope for c in b.columns()] + [c for _, c in extra]) if c not in columns]
        renamed = {k: fresh("key") for k in keys}
        right = found.df.select(*[F.col(k).alias(r) for k, r in renamed.items()], *added)
        on = F.lit(True) if not renamed else None
        for k, r in renamed.items():
            same = F.col(k) == F.col(r) if k in sure else F.col(k).eqNullSafe(F.col(r))
            on = same if on is None else on & same
        joined = table.df.join(right, on, how) if renamed or not table.unit or how != "inner" else right
        if not renamed and how == "inner" and not table.unit:
            joined = table.df.crossJoin(right)
        joined = joined.drop(*renamed.values())
        return Table(joined, {**table.scope, **{n: v for n, v in found.scope.items() if n not in scope}}), extra

    def pattern(self, table: Table, pattern: PathPattern):
        """One path of the clause: (table, its edge parts)."""
        self.check_bounds(pattern)
        if pattern.var:
            check_new(table, pattern.var)
        before = set(table.scope)
        table, state = self.path(table, State(), pattern.path, pattern.mode or "walk", outermost=True)
        table, state = self.close(table, state)
        table = self.flush(table)
        if pattern.mode and pattern.mode != "walk":
            table = table.where(self.mode_holds(pattern.mode, state.nodes, state.edges))
        if pattern.selector != ("all",):
            table = self.select(table, state, pattern.selector, before)
        if pattern.var:
            nodes, edges = fresh("nodes"), fresh("edges")
            df = table.df.withColumns({nodes: array_of(state.nodes), edges: array_of(state.edges)})
            table = Table(df, table.scope).bind(pattern.var, PathValue(nodes, edges, self.graph))
        return table, state.edges

    def flush(self, table: Table, last: bool = False) -> Table:
        left = []
        for ast in self.waiting:
            if last or names_in(ast) <= set(table.scope):
                table = table.where(boolean(ast, table, self.context, "WHERE"))
            else:
                left.append(ast)
        self.waiting = [] if last else left
        return table

    def close(self, table: Table, state: State):
        """A path of one unconstrained node reads all nodes."""
        if state.open:
            return self.bind_node(table, state, NodePattern(None, ("or", ("any",), ("not", ("any",)))))
        return table, state

    def select(self, table: Table, state: State, selector: tuple, outer: set) -> Table:
        kind, count = selector
        k = self.context.session.count(count)
        if k < 1:
            raise InvalidQuery("a selector's count must be positive")
        inputs = list(dict.fromkeys(c for n in outer for c in ([table.scope[n][1].id] if isinstance(table.scope[n][1], Element) else table.scope[n][1].columns())))
        length, rank = fresh("length"), fresh("rank")
        size = sum((F.size(c) if is_array else F.lit(1) for is_array, c in state.edges), F.lit(0))
        window = Window.partitionBy(*dict.fromkeys([*inputs, state.start, state.end])).orderBy(length)
        ranked = table.df.withColumn(length, size).withColumn(rank, F.dense_rank().over(window) if kind == "groups" else F.row_number().over(window))
        return Table(ranked.where(F.col(rank) <= k).drop(rank, length), table.scope)

    def edge_fragments(self, edge: EdgePattern) -> frozenset:
        return frozenset(i for i, f in enumerate(self.graph.data.edges) if label_matches(f.labels, edge.labels))

    # Bounds

    def check_bounds(self, pattern: PathPattern) -> None:
        for x in _walk(pattern.path):
            q = x.quantifier
            if q and q.high is not None and not q.questioned and (q.high == 0 or q.low > q.high):
                raise InvalidQuery("the bounds of a quantifier are empty")
            most = self.context.session.limits.max_path_hops
            if q and max(q.low, q.high or 0) > most:
                raise InvalidQuery(f"a quantifier exceeds {most} hops")
            if isinstance(x, Group):
                if x.has_search:
                    raise UnsupportedFeature("a search prefix within a path")
                if q and not q.questioned and not _least(x.path):
                    raise InvalidQuery("a quantified path must have edges")
                if q and not q.questioned and q.high is None and not self.different:
                    raise UnsupportedFeature("an unbounded group of repeatable elements")

    def limit(self, q: Quantifier, mode: str) -> int:
        if q.high is not None:
            return q.high
        if self.different or mode != "walk":
            return self.context.session.limits.max_path_hops + 1  # finite, and it stops where nothing is reached
        raise UnsupportedFeature("an unbounded repeatable WALK")

    # Paths

    def path(self, table: Table, state: State, path, mode: str, outermost: bool = False):
        if isinstance(path, Alternatives):
            return self.alternatives(table, state, path, mode)
        for factor in path:
            if isinstance(factor, NodePattern):
                table, state = self.node(table, state, factor)
            elif isinstance(factor, EdgePattern):
                table, state = self.edge(table, state, factor, mode)
            else:
                table, state = self.group(table, state, factor, mode)
            if outermost:
                table = self.flush(table)
        return table, state

    def node(self, table: Table, state: State, node: NodePattern):
        bare = not node.var and node.labels is None and not node.properties and node.where is None
        if bare and (state.end or state.open):
            return table, state
        if bare and state.start is None and not state.nodes:
            state = state.copy()
            state.open = True
            return table, state
        return self.bind_node(table, state, node)

    def bind_node(self, table: Table, state: State, node: NodePattern):
        state = state.copy()
        state.open = False
        known = table.find(node.var) if node.var else None
        if known is not None:
            if not isinstance(known, Element) or known.kind != "node":
                raise InvalidQuery(f"{node.var} is not a node")
            if known.conditional and node.var.lower() in self.fresh_names:
                raise InvalidQuery(f"{node.var} may be absent and cannot be used again here")
            element = known
            table = table.where(F.col(state.end) == F.col(known.id)) if state.end else table.where(F.col(known.id).isNotNull())
            if node.labels is not None:
                table = table.where(labeled(element, node.labels))
        else:
            rows, element, _, _ = scan(self.graph, "node", node.labels, self.wanted, spark=self.spark)
            if state.end:
                df = table.df.join(rows, F.col(state.end) == F.col(element.id))
            else:
                df = table.cross(rows)
            table = Table(df, table.scope)
            if node.var:
                table = table.bind(node.var, element)
                self.fresh_names.add(node.var.lower())
        if not state.end:
            state.start = element.id
            state.nodes.append((False, element.id))
        state.end = element.id
        return self.inline(table, element, node), state

    def inline(self, table: Table, element: Element, pattern) -> Table:
        """Property maps and WHERE of an element; a WHERE that reads later names waits."""
        for name, ast in pattern.properties:
            table = table.where(compare("=", property_of(element, name), bind(ast, table, self.context)).col)
        if pattern.where is not None:
            if names_in(pattern.where) <= set(table.scope):
                table = table.where(boolean(pattern.where, table, self.context, "WHERE"))
            else:
                self.waiting.append(pattern.where)
        return table

    def edge(self, table: Table, state: State, edge: EdgePattern, mode: str):
        if edge.quantifier:
            return self.expand(table, state, edge, mode)
        known = table.find(edge.var) if edge.var else None
        rows, element, source, target = scan(self.graph, "edge", edge.labels, self.wanted, edge.directions, self.spark)
        self.sources[element.id] = self.edge_fragments(edge)
        state = state.copy()
        on = F.lit(True)
        if state.end:
            on = on & (F.col(state.end) == F.col(source))
        if known is not None:
            if not isinstance(known, Element) or known.kind != "edge":
                raise InvalidQuery(f"{edge.var} is not an edge")
            if known.conditional and edge.var.lower() in self.fresh_names:
                raise InvalidQuery(f"{edge.var} may be absent and cannot be used again here")
            on = on & (F.col(known.id) == F.col(element.id))
        df = table.df.join(rows, on) if state.end or known is not None else table.cross(rows)
        table = Table(df, table.scope)
        if not state.end:
            state.start, state.open = source, False
            state.nodes.append((False, source))
        if self.different:
            repeat = known is not None and any(c == known.id for _, c in state.edges)
            table = table.where(F.lit(False)) if repeat else table
            for part in state.edges:
                table = table.where(apart(part, (False, element.id), self.sources))
        state.edges.append((False, element.id))
        state.nodes.append((False, target))
        state.end = target
        if edge.var and known is None:
            table = table.bind(edge.var, element)
            self.fresh_names.add(edge.var.lower())
        return self.inline(table, element, edge), state

    def expand(self, table: Table, state: State, edge: EdgePattern, mode: str):
        """A quantified edge: level by level joins with one step table; its variable becomes a list."""
        q = edge.quantifier
        if edge.var:
            check_new(table, edge.var)
        if state.open or not state.end:
            table, state = self.bind_node(table, state, NodePattern())
        high = self.limit(q, mode)
        carried = [*table.columns(), *[c for _, c in state.nodes + state.edges], state.start, state.end]
        carried = [c for c in dict.fromkeys(carried) if c]
        nodes, edges, end = fresh("nodes"), fresh("edges"), fresh("end")
        self.sources[edges] = self.edge_fragments(edge)

        def step(level: DataFrame) -> DataFrame:
            rows, element, source, target = scan(self.graph, "edge", edge.labels, self.wanted, edge.directions, self.spark)
            self.sources[element.id] = self.edge_fragments(edge)
            df = level.join(rows, F.col(end) == F.col(source))
            here = Table(df, table.scope)
            if edge.var:
                here = here.bind(edge.var, element)
            for name, ast in edge.properties:
                here = here.where(compare("=", property_of(element, name), bind(ast, here, self.context)).col)
            if edge.where is not None:
                here = here.where(boolean(edge.where, here, self.context, "WHERE"))
            if self.different or mode == "trail":
                here = here.where(~F.array_contains(edges, F.col(element.id)))
                for part in state.edges:
                    here = here.where(apart(part, (False, element.id), self.sources))
            before = F.concat(array_of(state.nodes), F.col(nodes))
            if mode == "acyclic":
                here = here.where(~F.array_contains(before, F.col(target)))
            if mode == "simple":
                closed = (F.size(F.concat(array_of(state.edges), F.col(edges))) > 0) & (F.col(end) == F.col(state.start))
                here = here.where(~closed & (~F.array_contains(before, F.col(target)) | (F.col(target) == F.col(state.start))))
            return here.df.select(
                *carried, F.array_append(nodes, F.col(target)).alias(nodes), F.array_append(edges, F.col(element.id)).alias(edges), F.col(target).alias(end)
            )

        first = table.df.select(*carried, F.array().cast(_IDS).alias(nodes), F.array().cast(_IDS).alias(edges), F.col(state.end).alias(end))
        df = self.levels(first, step, q.low, high, q.high is None)
        state = state.copy()
        state.nodes.append((True, nodes))
        state.edges.append((True, edges))
        state.end = end
        table = Table(df, table.scope)
        if edge.var:
            table = table.bind(edge.var, Scalar(edges, ("list", ("ref", "edge")), self.graph, group=True))
        return table, state

    def levels(self, first: DataFrame, step, low: int, high: int, unbounded: bool) -> DataFrame:
        """Union of the levels low to high. Deep or unbounded ones are written and stop when nothing is reached."""
        level, out, most = first, [first] if low == 0 else [], self.context.session.limits.max_path_hops
        for depth in range(1, high + 1):
            level = step(level)
            if depth > LAZY_LEVELS or unbounded:
                if depth > most:
                    if level.isEmpty():
                        break
                    raise UnsupportedFeature(f"a path of more than {most} hops")
                level = self.context.session.freeze(level)
                if level.isEmpty():
                    break
            if depth >= low:
                out.append(level)
        if not out:
            return first.limit(0)
        df = out[0]
        for other in out[1:]:
            df = df.unionByName(other)
        return df

    def mode_holds(self, mode: str, nodes: list, edges: list) -> Column:
        if mode == "walk":
            return F.lit(True)
        if mode == "trail":
            all_edges = array_of(edges)
            return F.size(F.array_distinct(all_edges)) == F.size(all_edges)
        all_nodes = array_of(nodes)
        if mode == "acyclic":
            return F.size(F.array_distinct(all_nodes)) == F.size(all_nodes)
        n = F.size(all_nodes)
        head, tail = F.slice(all_nodes, 1, F.greatest(n - 1, F.lit(1))), F.slice(all_nodes, 2, F.greatest(n - 1, F.lit(0)))
        return (F.size(F.array_distinct(head)) == F.size(head)) & (F.size(F.array_distinct(tail)) == F.size(tail))

    # Groups

    def group(self, table: Table, state: State, group: Group, mode: str):
        q = group.quantifier
        if q is None:
            return self.once(table, state, group, mode)
        if q.questioned:
            return self.questioned(table, state, group, mode)
        return self.repeat(table, state, group, mode)

    def once(self, table: Table, state: State, group: Group, mode: str):
        """A parenthesised path: matched in place, with its own mode and WHERE."""
        nodes, edges, begin = len(state.nodes), len(state.edges), state.end
        table, state = self.path(table, state, group.path, group.mode or mode)
        if group.var or group.mode or group.where is not None:
            table, state = self.close(table, state)
        own_nodes = ([(False, begin)] if begin else []) + state.nodes[nodes:]
        own_edges = state.edges[edges:]
        if group.where is not None:
            if names_in(group.where) <= set(table.scope):
                table = table.where(boolean(group.where, table, self.context, "WHERE"))
            else:
                self.waiting.append(group.where)
        if group.mode and group.mode != "walk":
            table = table.where(self.mode_holds(group.mode, own_nodes, own_edges))
        if group.var:
            check_new(table, group.var)
            n, e = fresh("nodes"), fresh("edges")
            df = table.df.withColumns({n: array_of(own_nodes), e: array_of(own_edges)})
            table = Table(df, table.scope).bind(group.var, PathValue(n, e, self.graph))
        return table, state

    def repeat(self, table: Table, state: State, group: Group, mode: str):
        q = group.quantifier
        if state.open or not state.end:
            table, state = self.bind_node(table, state, NodePattern())
        for name in _declared(group):
            check_new(table, name)
        high = q.high if q.high is not None else self.limit(q, mode)
        outer = dict(table.scope)
        carried = [c for c in dict.fromkeys([*table.columns(), *[c for _, c in state.nodes + state.edges], state.start, state.end]) if c]
        nodes, edges, end = fresh("nodes"), fresh("edges"), fresh("end")
        lists: dict[str, tuple[str, str, object]] = {}
        for name in _declared(group):
            lists[name.lower()] = (name, fresh(name), None)
        kinds: dict[str, object] = {}

        def step(level: DataFrame) -> DataFrame:
            inner = State(end, state.start, [*state.nodes, (True, nodes)], [*state.edges, (True, edges)])
            base_nodes, base_edges = len(inner.nodes), len(inner.edges)
            saved, self.waiting = self.waiting, []
            here, after = self.once(Table(level, outer), inner, replace(group, quantifier=None), mode)
            here = self.flush(here, last=True)
            self.waiting = saved
            if mode in ("acyclic", "simple", "trail"):
                here = here.where(self.mode_holds(mode, after.nodes, after.edges))
            columns = []
            for key, (name, column, _) in lists.items():
                found = here.find(name)
                if found is None:
                    columns.append(F.col(column))
                elif isinstance(found, Element):
                    kinds[key] = ("ref", found.kind)
                    columns.append(F.array_append(column, F.col(found.id)).alias(column))
                elif isinstance(found, Scalar):
                    kinds[key] = found.type[1]
                    columns.append(F.concat(column, found.column).alias(column))
                else:
                    kinds[key] = "path"
                    columns.append(F.col(column))
            added_nodes = array_of(after.nodes[base_nodes:])
            added_edges = array_of(after.edges[base_edges:])
            return here.df.select(*carried, *columns, F.concat(nodes, added_nodes).alias(nodes), F.concat(edges, added_edges).alias(edges), F.col(after.end).alias(end))

        empty = F.array().cast(_IDS)
        first = table.df.select(*carried, *[empty.alias(c) for _, c, _ in lists.values()], empty.alias(nodes), empty.alias(edges), F.col(state.end).alias(end))
        df = self.levels(first, step, q.low, high, q.high is None)
        state = state.copy()
        state.nodes.append((True, nodes))
        state.edges.append((True, edges))
        state.end = end
        table = Table(df, table.scope)
        for key, (name, column, _) in lists.items():
            self.fresh_names.discard(key)
            if kinds.get(key) != "path":
                table = table.bind(name, Scalar(column, ("list", kinds.get(key, ("ref", "node"))), self.graph, group=True))
        return table, state

    def questioned(self, table: Table, state: State, group: Group, mode: str):
        """Zero or one time: both branches stay; what the segment declares is null on the absent one."""
        if state.open or not state.end:
            table, state = self.bind_node(table, state, NodePattern())
        present, after = self.once(table, state.copy(), replace(group, quantifier=None), mode)
        return self.merge(table, state, [(present, after), (table, state.copy())], mode, conditional=True)

    def alternatives(self, table: Table, state: State, path: Alternatives, mode: str):
        branches = []
        for branch in path.branches:
            saved, names = self.waiting, set(self.fresh_names)
            self.waiting = []
            found, after = self.path(table, state.copy(), branch, mode)
            found, after = self.close(found, after)
            found = self.flush(found, last=True)
            if mode != "walk":
                found = found.where(self.mode_holds(mode, after.nodes, after.edges))
            self.waiting, self.fresh_names = saved, names
            branches.append((found, after))
        return self.merge(table, state, branches, mode, distinct=not path.bag)

    def merge(self, table: Table, state: State, branches: list, mode: str, distinct: bool = False, conditional: bool = False):
        """Union of branches from one table: paths become arrays, variables of one name share columns."""
        carried = [] if table.unit else list(dict.fromkeys([*table.columns(), *[c for _, c in state.nodes + state.edges], *[c for c in (state.start, state.end) if c]]))
        nodes, edges, end, start = fresh("nodes"), fresh("edges"), fresh("end"), fresh("start")
        names: dict[str, str] = {}
        for found, _ in branches:
            names.update({n: d for n, (d, _) in found.scope.items() if n not in table.scope})
        merged, outputs = {}, [[] for _ in branches]
        for name, display in names.items():
            own = [found.find(display) for found, _ in branches]
            there = [b for b in own if b is not None]
            absent = len(there) < len(own)
            sample = there[0]
            if any(type(b) is not type(sample) or getattr(b, "kind", None) != getattr(sample, "kind", None) for b in there):
                raise InvalidQuery(f"{display} stands for different kinds of values")
            if isinstance(sample, Element):
                binding, columns = self.merged_element(own, absent or conditional)
            elif isinstance(sample, PathValue):
                n, e = fresh("nodes"), fresh("edges")
                binding = PathValue(n, e, self.graph, absent)
                columns = [[(F.col(b.nodes) if b else F.lit(None).cast(_IDS)).alias(n), (F.col(b.edges) if b else F.lit(None).cast(_IDS)).alias(e)] for b in own]
            else:
                c = fresh(name)
                binding = replace(sample, column=c, conditional=absent)
                columns = [[(F.col(b.column) if b else typed_null(sample.type)).alias(c)] for b in own]
            merged[name] = (display, binding)
            for out, cs in zip(outputs, columns, strict=True):
                out.extend(cs)
            self.fresh_names.add(name)
        parts = []
        for (found, after), extra in zip(branches, outputs, strict=True):
            own_nodes, own_edges = after.nodes[len(state.nodes) :], after.edges[len(state.edges) :]
            parts.append(
                found.df.select(*carried, *extra, array_of(own_nodes).alias(nodes), array_of(own_edges).alias(edges), F.col(after.end).alias(end), F.col(after.start).alias(start))
            )
        df = parts[0]
        for p in parts[1:]:
            df = df.unionByName(p)
        if distinct:
            df = df.distinct()
        state = state.copy()
        state.nodes.append((True, nodes))
        state.edges.append((True, edges))
        state.end, state.open = end, False
        state.start = state.start or start
        return Table(df, {**table.scope, **merged}), state

    def merged_element(self, own: list, conditional: bool):
        there = [b for b in own if b is not None]
        id_column, number = fresh("id"), fresh("fragment")
        keys: dict[str, str] = {}
        for b in there:
            keys.update({k: v[0] for k, v in b.properties.items()})
        properties, plans = {}, {}
        for key, display in keys.items():
            kinds = [b.properties[key][2] for b in there if key in b.properties]
            kind, mixed = unified(kinds)
            column = fresh(key)
            families = {t: fresh(key) for t in dict.fromkeys(x for b in there if key in b.properties for x in (b.properties[key][3] or {b.properties[key][2]: 0}))} if mixed or any(b.properties[key][3] for b in there if key in b.properties) else None
            properties[key] = (display, column, kind, families)
            plans[key] = (column, kind, families)
        columns = []
        for b in own:
            out = [(F.col(b.id) if b else F.lit(None).cast("bigint")).alias(id_column), (F.col(b.fragment) if b else F.lit(None).cast("int")).alias(number)]
            for key, (column, kind, families) in plans.items():
                hit = b.properties.get(key) if b else None
                out.append((F.col(hit[1]) if hit else F.lit(None)).cast(spark_type(kind)).alias(column))
                for t, c in (families or {}).items():
                    source = hit and ((hit[3] or {}).get(t) or (hit[1] if hit[2] == t and not hit[3] else None))
                    out.append((F.col(source) if source else F.lit(None)).cast(spark_type(t)).alias(c))
            columns.append(out)
        return Element(there[0].kind, self.graph, id_column, number, properties, conditional), columns


def _walk(path):
    """Edges and groups of a path that may be quantified."""
    for p in path.branches if isinstance(path, Alternatives) else [path]:
        for factor in p:
            if isinstance(factor, EdgePattern):
                yield factor
            elif isinstance(factor, Group):
                yield factor
                yield from _walk(factor.path)


def _has(path, kinds) -> bool:
    if isinstance(path, kinds):
        return True
    return any(_has(f.path, kinds) for f in (path if isinstance(path, list) else []) if isinstance(f, Group))


def _least(path) -> int:
    """Fewest edges that a path can have."""
    if isinstance(path, Alternatives):
        return min(_least(b) for b in path.branches)
    total = 0
    for factor in path:
        if isinstance(factor, EdgePattern):
            total += factor.quantifier.low if factor.quantifier else 1
        elif isinstance(factor, Group):
            total += _least(factor.path) * (factor.quantifier.low if factor.quantifier else 1)
    return total


def _declared(group: Group) -> list[str]:
    """Variables that a group declares, in order."""
    out: dict[str, str] = {}

    def visit(path):
        for p in path.branches if isinstance(path, Alternatives) else [path]:
            for f in p:
                if f.var:
                    out.setdefault(f.var.lower(), f.var)
                if isinstance(f, Group):
                    visit(f.path)

    if group.var:
        out[group.var.lower()] = group.var
    visit(group.path)
    return list(out.values())


def optional(table: Table, trees: list, compute, matcher: Matcher) -> Table:
    """Left join of every input row with what ``compute`` finds for it; new names are null where it finds nothing."""
    outer = set(table.scope)
    if table.unit:
        found = compute(Table(table.df, {}, unit=True))
        joined = matcher.spark.range(1).select().join(found.df, F.lit(True), "left")
        out = Table(joined, found.scope)
    else:
        out, _ = matcher.by_key(table, trees, lambda t: (compute(t), []), "left")
    return Table(out.df, {n: (d, replace(b, conditional=True) if n not in outer and isinstance(b, Element) else b) for n, (d, b) in out.scope.items()})
