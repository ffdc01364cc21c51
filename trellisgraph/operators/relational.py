"""Clauses between patterns and results: LET, FILTER, FOR, pages, nested sources, results, set operations."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidQuery, UnsupportedFeature
from ..functions.aggregates import aggregate, apart, beside, counted_rows
from ..functions.scalar import E, common_type, family, spark_type, type_name, widened
from ..lang.nodes import Clause, Composite, Linear, Match, OptionalBlock, Page, Query, Result, walk
from ..lang.parser import AGGREGATES
from ..plans.binder import Context, bind, boolean, folded, has_aggregate, names_in
from ..plans.scope import Element, GraphRef, PathValue, Scalar, Table, check_new, fresh, output
from .counting import Counter, counted, counting_rows, read_later
from .match import Matcher, optional, scan


def unit(session) -> Table:
    return Table(session.spark.range(0, 1, 1, 1).select(), {}, unit=True)


class Runner:
    """Runs the clauses of one statement; ``graph`` is the current graph and follows USE."""

    def __init__(self, session, graph: GraphRef | None, wanted: set | None):
        self.session = session
        self.graph = graph
        self.wanted = wanted
        self.affected = 0
        self.depth = 0

    @property
    def context(self) -> Context:
        return Context(self.session)

    # Queries

    def query(self, query: Query, table: Table | None = None) -> Table:
        table = table or unit(self.session)
        for step, yields in query.steps:
            table = self.step(step, table)
            if yields not in (None, "*"):
                scope = {}
                for name, new in yields:
                    hit = table.scope.get(name.lower())
                    if hit is None:
                        raise InvalidQuery(f"YIELD: unknown column {name}")
                    if new.lower() in scope:
                        raise InvalidQuery(f"YIELD: {new} is written twice")
                    scope[new.lower()] = (new, hit[1])
                table = Table(table.df, scope)
        return table

    def step(self, step, table: Table) -> Table:
        if isinstance(step, Composite):
            return self.composite(step, table)
        return self.linear(step, table)

    def composite(self, tree: Composite, table: Table) -> Table:
        if any(isinstance(x, Clause) and x.kind in ("insert", "set", "remove", "delete") for x in walk(tree)):
            raise UnsupportedFeature("changes within set operations")
        right_tree, page = tree.right, Page()
        if isinstance(right_tree, Linear) and right_tree.result and right_tree.result.page and tree.op != "otherwise":
            # A trailing page belongs to the combined rows.
            page = right_tree.result.page
            right_tree = replace(right_tree, result=replace(right_tree.result, page=Page()))
        graph = self.graph
        left = self.step(tree.left, table)
        self.graph, left_graph = graph, self.graph
        right = self.step(right_tree, table)
        if [d for d, _ in left.scope.values()] != [d for d, _ in right.scope.values()]:
            raise InvalidQuery("set operation: the columns differ")
        if tree.op == "otherwise":
            chosen = right if left.df.limit(1).isEmpty() else left
            self.graph = left_graph if chosen is left else self.graph
            return chosen
        a, b, scope, refs = self.aligned(left, right)
        op = {
            ("union", True): lambda: a.unionAll(b), ("union", False): lambda: a.unionAll(b).distinct(), ("intersect", True): lambda: a.intersectAll(b),
            ("intersect", False): lambda: a.intersect(b), ("except", True): lambda: a.exceptAll(b), ("except", False): lambda: a.subtract(b),
        }[tree.op, tree.all]
        out = Table(op(), scope)
        for display, column, kind, graph_ in refs:
            out = self.resolve(out, display, column, kind, graph_)
        return self.page(out, page)

    def aligned(self, left: Table, right: Table) -> tuple[DataFrame, DataFrame, dict, list]:
        a, b, scope, refs = [], [], {}, []
        for (key, (display, x)), (_, y) in zip(left.scope.items(), right.scope.values(), strict=True):
            column = fresh(key)
            if isinstance(x, Element) or isinstance(y, Element):
                sample = x if isinstance(x, Element) else y
                cols = []
                for side in (x, y):
                    if isinstance(side, Element) and side.kind == sample.kind and side.graph.id == sample.graph.id:
                        cols.append(F.col(side.id))
                    elif isinstance(side, Scalar) and side.type == "null":
                        cols.append(F.lit(None).cast("bigint"))
                    else:
                        raise InvalidQuery(f"set operation: column {display} has different kinds")
                a.append(cols[0].alias(column))
                b.append(cols[1].alias(column))
                scope[key] = (display, Scalar(column, ("ref", sample.kind), sample.graph))
                refs.append((display, column, sample.kind, sample.graph))
                continue
            if isinstance(x, PathValue) and isinstance(y, PathValue):
                nodes, edges = fresh("nodes"), fresh("edges")
                a += [F.col(x.nodes).alias(nodes), F.col(x.edges).alias(edges)]
                b += [F.col(y.nodes).alias(nodes), F.col(y.edges).alias(edges)]
                scope[key] = (display, replace(x, nodes=nodes, edges=edges))
                continue
            if isinstance(x, PathValue) or isinstance(y, PathValue):
                raise InvalidQuery(f"set operation: column {display} has different kinds")
            kind = common_type(x.type, y.type)
            if kind is None:
                raise InvalidQuery(f"set operation: {type_name(x.type)} and {type_name(y.type)} in column {display}")
            # Untyped nulls are compared as strings: void columns do not take part in joins.
            stored = "string" if kind == "null" else kind
            a.append(widened(E(F.col(x.column), x.type), stored).col.cast(spark_type(stored)).alias(column))
            b.append(widened(E(F.col(y.column), y.type), stored).col.cast(spark_type(stored)).alias(column))
            scope[key] = (display, Scalar(column, kind if kind != "null" else "null", x.graph or y.graph))
        return left.df.select(*a), right.df.select(*b), scope, refs

    def linear(self, tree: Linear, table: Table) -> Table:
        if tree.schema:
            self.session.check_schema(tree.schema)
        schema = tree.schema
        if table.unit and not table.scope and counted(tree):
            found = self.counts(tree, table, schema)
            if found is not None:
                return found
        for clause in tree.clauses:
            table = self.clause(clause, table, schema)
        return self.result(table, tree.result)

    def counts(self, tree: Linear, table: Table, schema) -> Table | None:
        """The result of a statement that only counts its matches, from weighted rows; none if too many edges are compared."""
        res, graph, weight = counting_rows(tree.result, tree.clauses), self.graph, None
        for i, clause in enumerate(tree.clauses):
            if not isinstance(clause, Match):
                table = self.clause(clause, table, schema)
                continue
            counter = Counter(self.matcher(clause), clause)
            planned = counter.plan(set(table.scope))
            if planned is None:
                self.graph = graph
                return None
            rest = tree.clauses[i + 1 :]
            table, weight = counter.run(table, weight, *planned, read_later(rest, res), any(isinstance(c, Match) for c in rest))
        return self.grouped(table, res, self.named_items(res), weight)

    # Clauses

    def clause(self, clause, table: Table, schema=None) -> Table:
        if isinstance(clause, Match):
            if clause.optional:
                return self.optional([replace(clause, optional=False)], table)
            return self.match(clause, table)
        if isinstance(clause, OptionalBlock):
            return self.optional(clause.matches, table)
        return getattr(self, f"c_{clause.kind}")(clause, table, schema)

    def matcher(self, match: Match) -> Matcher:
        if self.graph is None:
            raise InvalidQuery("no current graph")
        return Matcher(self.context, self.graph, self.wanted, match.mode != "repeatable")

    def match(self, match: Match, table: Table) -> Table:
        return self.matcher(match).run(table, match)

    def optional(self, matches: list, table: Table) -> Table:
        def compute(inner: Table) -> Table:
            for m in matches:
                inner = self.optional([replace(m, optional=False)], inner) if m.optional else self.match(m, inner)
            return inner

        return optional(table, matches, compute, self.matcher(matches[0]))

    def c_use(self, clause, table, schema) -> Table:
        self.graph = self.session.graph_ref(clause.items, schema)
        return table

    def c_let(self, clause, table, schema) -> Table:
        values = []
        for name, ast, typed in clause.items:
            if typed:
                raise UnsupportedFeature("typed LET")
            check_new(table, name)
            value = bind(ast, table, self.context)
            values.append((name, value))
            table = self.named(table, name, value)
        return table

    def named(self, table: Table, name: str, value: E) -> Table:
        """Bind a name to a value: elements and paths keep their columns."""
        if isinstance(value.binding, (Element, PathValue)):
            return Table(table.df, table.scope, table.unit).bind(name, value.binding)
        column = fresh(name)
        columns = {column: value.col}
        families = None
        if value.variants:
            families = {v.type: fresh(name) for v in value.variants}
            columns |= {c: v.col for c, v in zip(families.values(), value.variants, strict=True)}
        graph = value.binding.graph if isinstance(value.binding, Scalar) else None
        return Table(table.df.withColumns(columns), table.scope).bind(name, Scalar(column, value.type, graph, variants=families))

    def c_filter(self, clause, table, schema) -> Table:
        return table.where(boolean(clause.items, table, self.context, "FILTER"))

    def c_for(self, clause, table, schema) -> Table:
        name, ast = clause.items
        value = bind(ast, table, self.context)
        check_new(table, name)
        if value.type == "null":
            value = E(F.lit(None).cast("array<string>"), ("list", "null"))
        if not (isinstance(value.type, tuple) and value.type[0] == "list"):
            raise InvalidQuery(f"FOR needs a list, not {type_name(value.type)}")
        position, item = fresh("position"), fresh(name)
        list_column = value.col.cast("array<string>") if value.type[1] == "null" else value.col
        df = table.df.select("*", F.posexplode(list_column).alias(position, item))
        table = Table(df, table.scope)
        kind = value.type[1]
        if isinstance(kind, tuple) and kind[0] == "ref" and kind[1] in ("node", "edge") and value.binding is not None and value.binding.graph:
            table = self.resolve(table, name, item, kind[1], value.binding.graph)
        else:
            table = table.bind(name, Scalar(item, kind))
        if clause.extra:
            what, ordinal = clause.extra
            check_new(table, ordinal)
            table = table.with_column(ordinal, E(F.col(position).cast("bigint") + (1 if what == "ORDINALITY" else 0), "int"))
        return table

    def resolve(self, table: Table, name: str, column: str, kind: str, graph: GraphRef) -> Table:
        """Bind a name to the elements whose ids a column holds."""
        rows, element, source, target = scan(graph, kind, None, self.wanted, frozenset("RU"), self.session.spark, once=True)
        rows = rows.drop(source, target) if kind == "edge" else rows
        df = table.df.join(rows, F.col(column) == F.col(element.id), "left")
        return Table(df, table.scope).bind(name, replace(element, conditional=True))

    def c_page(self, clause, table, schema) -> Table:
        return self.page(table, clause.items)

    def c_nested(self, clause, table, schema) -> Table:
        inner = Runner(self.session, self.graph, self.wanted)
        found = inner.query(clause.items).pruned()
        return self.crossed(table, found)

    def crossed(self, table: Table, found: Table) -> Table:
        for display, _ in found.scope.values():
            check_new(table, display, "column")
        df = found.df if table.unit else table.df.crossJoin(found.df)
        return Table(df, {**table.scope, **found.scope})

    def c_table(self, clause, table, schema) -> Table:
        if isinstance(clause.items, tuple):
            found = self.session.binding_table(clause.items[1])
        else:
            found = Runner(self.session, self.graph, self.wanted).query(clause.items).pruned()
        return self.crossed(table, found)

    def c_call(self, clause, table, schema) -> Table:
        raise UnsupportedFeature("CALL")

    def _change(self, clause, table: Table) -> Table:
        from .mutate import change

        return change(self, clause, table)

    def c_insert(self, clause, table, schema) -> Table:
        return self._change(clause, table)

    c_set = c_remove = c_delete = c_insert

    # Pages

    def page(self, table: Table, page: Page, context: Context | None = None) -> Table:
        if page.order:
            table = replace(table, df=table.df.orderBy(*self.sort_keys(page.order, table, context or self.context)), unit=False)
        return self.cut(table, page)

    def cut(self, table: Table, page: Page) -> Table:
        df = table.df
        if page.offset is not None:
            df = df.offset(self.session.count(page.offset))
        if page.limit is not None:
            df = df.limit(self.session.count(page.limit))
        return table if df is table.df else Table(df, table.scope)

    def sort_keys(self, order: list, table: Table, context: Context) -> list:
        keys = []
        for item in order:
            value = one_family(bind(item.expr, table, context), "ORDER BY")
            first = item.nulls_first if item.nulls_first is not None else item.descending
            c = value.col
            if item.descending:
                keys.append(c.desc_nulls_first() if first else c.desc_nulls_last())
            else:
                keys.append(c.asc_nulls_first() if first else c.asc_nulls_last())
        return keys

    # Results

    def result(self, table: Table, res: Result) -> Table:
        if res.finish:
            return FinishedTable(table.df, {})
        items = res.items
        if items is None:
            if not table.scope:
                raise InvalidQuery("there is nothing to return")
            items = [(("var", d), d) for d, _ in table.scope.values()]
        named = self.named_items(replace(res, items=items))
        trees = [a for _, a in named] + ([res.having] if res.having else []) + [o.expr for o in res.page.order]
        if res.group is not None or any(has_aggregate(t) for t in trees):
            return self.grouped(table, res, named)
        if res.having is not None:
            raise InvalidQuery("HAVING needs groups")
        values = [(name, ast, bind(ast, table, self.context)) for name, ast in named]
        out, known = table, {}
        scope: dict = {}
        for name, ast, value in values:
            out = self.named(Table(out.df, {**out.scope}), name + "\0", value)
            _, binding = out.scope.pop((name + "\0").lower())
            scope[name.lower()] = (name, binding)
            known[folded(ast)] = bound(binding)
        if res.distinct:
            for name, _, value in values:
                one_family(value, "DISTINCT")
            rows = Table(out.df, scope).pruned().df.distinct()
            projected = Table(rows, scope)
            return self.page(projected, res.page, Context(self.session, known))
        ordered = Table(out.df, {**table.scope, **scope})
        ordered = self.page(ordered, res.page)
        return Table(ordered.df, scope).pruned()

    @staticmethod
    def named_items(res: Result) -> list:
        """(column name, expression) of a result's items."""
        named = []
        for i, (ast, alias) in enumerate(res.items, 1):
            name = alias or (ast[1] if ast[0] == "var" else f"column_{i}")
            if name.lower() in {n.lower() for n, _ in named}:
                raise InvalidQuery(f"column {name} is written twice")
            named.append((name, ast))
        return named

    def grouped(self, table: Table, res: Result, named: list, weight: str | None = None) -> Table:
        """Groups of rows; with ``weight`` a row stands for as many rows as this column says, and all aggregates are counts."""
        aliases = {name.lower(): ast for name, ast in named}

        def expanded(ast):
            """Aliases of items written out."""
            if isinstance(ast, tuple):
                if len(ast) == 2 and ast[0] == "var" and ast[1].lower() in aliases and aliases[ast[1].lower()] != ast:
                    return aliases[ast[1].lower()]
                return tuple(expanded(a) for a in ast)
            return ast

        if res.group is None:
            keys = [ast for _, ast in named if not has_aggregate(ast) and names_in(ast)]
        else:
            keys = []
            for g in res.group:
                in_items = g[0] == "var" and g[1].lower() in aliases and table.find(g[1]) is None
                keys.append(aliases[g[1].lower()] if in_items else g)
        order = [replace(o, expr=expanded(o.expr)) for o in res.page.order]
        having = expanded(res.having) if res.having is not None else None
        calls: dict = {}
        for tree in [a for _, a in named] + [o.expr for o in order] + ([having] if having else []):
            for x in walk(tree):
                if isinstance(x, tuple) and x and x[0] == "call" and x[1] in AGGREGATES:
                    if any(has_aggregate(a) for a in x[3]):
                        raise InvalidQuery("an aggregate cannot hold another")
                    calls.setdefault(folded(x), x)
        prepared, known, by, carried = table.df, {}, [], {}
        for ast in keys:
            value = one_family(bind(ast, table, self.context), "GROUP BY")
            if folded(ast) in known:
                continue
            if isinstance(value.binding, Element):
                element = value.binding
                by.append(element.id)
                carried.update({c: F.first(c).alias(c) for c in element.columns() if c != element.id})
                known[folded(ast)] = value
                continue
            if isinstance(value.binding, PathValue):
                by += value.binding.columns()
                known[folded(ast)] = value
                continue
            column = fresh("key")
            prepared = prepared.withColumn(column, value.col.cast("string") if value.type == "null" else value.col)
            by.append(column)
            known[folded(ast)] = E(F.col(column), value.type, binding=value.binding)
        outputs, sides = [], []
        for key, (_, name, distinct, args) in calls.items():
            column, fraction, arg, argument = fresh("aggregate"), None, None, ""
            if args[0] != ("star",):
                arg = bind(args[0], table, self.context)
                if not (arg.variants and name == "COUNT"):
                    arg = one_family(arg, name)
                argument = fresh("argument")
                prepared = prepared.withColumn(argument, arg.col.cast("bigint") if arg.type == "null" else arg.col)
                arg = replace(arg, col=F.col(argument), variants=None)
                if len(args) > 1:
                    fraction = bind(args[1], table, self.context)
            if apart(name, distinct, arg):
                sides.append((name, distinct, arg, fraction, argument, column, key))
                continue
            made = aggregate(name, distinct, arg) if weight is None else counted_rows(arg, weight)
            outputs.append(made.col.alias(column))
            binding = None
            if isinstance(made.type, tuple) and made.type[0] == "list" and isinstance(arg.binding, Element):
                binding = Scalar(column, made.type, arg.binding.graph)
            known[key] = E(F.col(column), made.type, binding=binding)
        outputs += list(carried.values())
        if by and weight is not None:
            # What is taken off may leave nothing of a group.
            total = fresh("total")
            df = prepared.groupBy(*dict.fromkeys(by)).agg(*outputs, F.sum(weight).alias(total)).where(F.col(total) > 0).drop(total)
        elif by:
            df = prepared.groupBy(*dict.fromkeys(by)).agg(*outputs) if outputs else prepared.select(*dict.fromkeys(by)).distinct()
        else:
            df = prepared.agg(*outputs) if outputs else prepared.agg(F.count(F.lit(1)).alias(fresh("n")))
        for name, distinct, arg, fraction, argument, column, key in sides:
            if arg.variants:
                raise InvalidQuery(f"{name} cannot combine stored types")
            keys_of_side = list(dict.fromkeys(by))
            side, made = beside(name, distinct, arg, fraction, prepared, keys_of_side, argument, column, self.session.freeze)
            on, renamed = F.lit(True), {b: fresh("key") for b in keys_of_side}
            for b, r in renamed.items():
                on = on & F.col(b).eqNullSafe(F.col(r))
            df = df.join(side.withColumnsRenamed(renamed), on, "left").drop(*renamed.values())
            known[key] = E(F.col(column), made.type)
        after = Context(self.session, known, grouped=True)
        scope_in = {n: v for n, v in table.scope.items()}
        current = Table(df, scope_in)
        if having is not None:
            current = current.where(boolean(having, current, after, "HAVING"))
        scope: dict = {}
        item_values: dict = {}
        for name, ast in named:
            value = bind(ast, current, after)
            out = self.named(Table(current.df, {}), name, value)
            scope[name.lower()] = out.scope[name.lower()]
            item_values[folded(ast)] = bound(scope[name.lower()][1])
            current = Table(out.df, scope_in)
        if res.distinct:
            projected = Table(Table(current.df, scope).pruned().df.distinct(), scope)
            keys_ = Context(self.session, item_values, grouped=True)
            if order:
                projected = replace(projected, df=projected.df.orderBy(*self.sort_keys(order, projected, keys_)))
            return self.cut(projected, res.page)
        if order:
            current = replace(current, df=current.df.orderBy(*self.sort_keys(order, current, after)))
        return self.cut(Table(current.df, scope).pruned(), res.page)


class FinishedTable(Table):
    """The outcome of FINISH: nothing to show, but the work is done."""


def bound(binding) -> E:
    if isinstance(binding, Element):
        return E(F.col(binding.id), ("ref", binding.kind), binding=binding)
    if isinstance(binding, PathValue):
        return E(F.col(binding.nodes), "path", binding=binding)
    return E(F.col(binding.column), binding.type, binding=binding if binding.graph else None)


def one_family(value: E, what: str) -> E:
    """Values that sort or group together must be of one family."""
    if value.variants and len({family(v.type) for v in value.variants}) > 1:
        raise InvalidQuery(f"{what} cannot combine {' and '.join(type_name(v.type) for v in value.variants)}")
    return value


def to_frame(table: Table) -> DataFrame:
    """The result as users see it."""
    if isinstance(table, FinishedTable):
        return table.df.sparkSession.createDataFrame([], "finished boolean").select()
    columns = []
    for display, binding in table.scope.values():
        c = output(binding)
        if isinstance(binding, Scalar) and binding.type == "null":
            c = c.cast("string")
        columns.append(c.alias(display))
    return table.df.select(*columns)
