"""INSERT, SET, REMOVE and DELETE: each replaces the statement's private snapshot of the graph.

The working table is written first, so that ids and values stay fixed. Only fragments that hold affected elements change,
and of them only the affected rows are written: a layer of ids that are gone and a layer of new rows. A fragment is written
anew where its layout changes.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidQuery
from ..lang.nodes import Clause, EdgePattern, NodePattern
from ..plans.binder import bind
from ..plans.scope import Element, Table, check_new, fresh, live
from ..sources.graph import ID, SOURCE, TARGET, Fragment, GraphData, spark_kind
from .match import scan


def change(runner, clause: Clause, table: Table) -> Table:
    runner.session.check_writable()
    if runner.graph is None:
        raise InvalidQuery("no current graph")
    runner.graph = runner.session.writable(runner.graph)
    keep = table.pruned()
    table = Table(runner.session.freeze(keep.df), table.scope, table.unit)
    return {"insert": insert, "set": patch, "remove": patch, "delete": delete}[clause.kind](runner, clause, table)


def labels_of(expr) -> frozenset:
    """The labels of an INSERT: names joined by &."""
    if expr is None:
        return frozenset()
    if expr[0] == "label":
        return frozenset([expr[1]])
    if expr[0] == "and":
        return labels_of(expr[1]) | labels_of(expr[2])
    raise InvalidQuery("INSERT takes labels joined by & only")


def add_fragment(data: GraphData, new: Fragment) -> GraphData:
    kind = "edges" if new.is_edge else "nodes"
    fragments = list(getattr(data, kind))
    for i, f in enumerate(fragments):
        if f.labels != new.labels or f.directed != new.directed:
            continue
        old = {n.lower(): (n, t) for n, t in f.properties}
        for name, t in new.properties:
            known = old.get(name.lower())
            if known and known[1] != t and not (known[1] == "float" and t == "int"):
                raise InvalidQuery(f"property {name} is stored as another type on these labels")
        merged = list(f.properties) + [(n, t) for n, t in new.properties if n.lower() not in old]
        own = {n.lower(): n for n, _ in new.properties}
        fixed = [ID] + ([SOURCE, TARGET] if new.is_edge else [])

        def aligned(df: DataFrame, names: dict) -> DataFrame:
            return df.select(*fixed, *[(F.col(f"`{names[n.lower()]}`") if n.lower() in names else F.lit(None)).cast(spark_kind(t)).alias(n) for n, t in merged])

        if tuple(merged) == f.properties:
            fragments[i] = f.plus(aligned(new.df, own))
        else:
            df = aligned(f.df, {n.lower(): n for n, _ in f.properties}).unionAll(aligned(new.df, own))
            fragments[i] = Fragment(df, f.labels, f.directed, tuple(merged))
        break
    else:
        fragments.append(new)
    return replace(data, **{kind: tuple(fragments)}, counts={})


def insert(runner, clause: Clause, table: Table) -> Table:
    session, graph = runner.session, runner.graph
    context = runner.context
    made: list[tuple[Element, str | None]] = []
    base = graph.data.fresh_id()
    rows = table.df
    # One block of ids for each element: numbers of the rows of the written table, without gaps.
    row = fresh("row")
    rows = session.freeze(rows.withColumn(row, F.monotonically_increasing_id()) if rows.columns else rows.select(F.monotonically_increasing_id().alias(row)))
    parts = {r[0]: r[1] for r in rows.groupBy(F.shiftright(row, 33)).count().collect()}  # one for each partition
    n_rows, starts = 0, []
    for i in range(max(parts, default=-1) + 1):
        starts.append(n_rows)
        n_rows += parts.get(i, 0)
    before = F.element_at(F.split(F.lit(",".join(map(str, starts or [0]))), ",").cast("array<bigint>"), (F.shiftright(row, 33) + 1).cast("int"))
    rows = rows.withColumn(row, before + F.col(row).bitwiseAND((1 << 33) - 1))
    table = Table(rows, table.scope)
    total = sum(isinstance(f, EdgePattern) or not (f.var and table.find(f.var)) for path in clause.items for f in path)
    serial = 0

    def new_id() -> str:
        nonlocal table, serial
        column = fresh("id")
        table = Table(table.df.withColumn(column, F.lit(base + serial) + F.col(row) * max(total, 1)), table.scope)
        serial += 1
        return column

    def write(kind: str, id_column: str, pattern, extra: list, directed=None) -> None:
        nonlocal table
        labels = labels_of(pattern.labels)
        columns, properties = [F.col(id_column).alias(ID), *extra], []
        for name, ast in pattern.properties:
            value = bind(ast, table, context)
            if value.type == "null":
                continue
            if value.type not in ("bool", "int", "float", "string", "bytes"):
                raise InvalidQuery(f"property {name} cannot hold this value")
            columns.append(value.col.alias(name))
            properties.append((name, value.type))
        df = session.freeze(table.df.select(*columns))
        if properties:
            filled = df.agg(*[F.count(F.col(f"`{n}`")).alias(f"c{i}") for i, (n, _) in enumerate(properties)]).first()
            kept = [p for i, p in enumerate(properties) if filled[i]]
            df = df.drop(*[n for n, _ in properties if n not in {k for k, _ in kept}])
            properties = kept
        if extra and not df.where(F.col(SOURCE).isNull() | F.col(TARGET).isNull()).isEmpty():
            raise InvalidQuery("an inserted edge has a null endpoint")
        graph.cell[0] = add_fragment(graph.data, Fragment(df, labels, directed, tuple(properties)))
        made.append((Element(kind, graph, id_column, ""), pattern.var))
        runner.affected += n_rows

    for path in clause.items:
        if not isinstance(path[0], NodePattern) or not isinstance(path[-1], NodePattern):
            raise InvalidQuery("an inserted path begins and ends with nodes")
        ends = []
        for f in path:
            if not isinstance(f, NodePattern):
                ends.append(None)
                continue
            known = table.find(f.var) if f.var else None
            if known is not None:
                if f.labels is not None or f.properties or not isinstance(known, Element) or known.kind != "node":
                    raise InvalidQuery(f"{f.var} is bound; write it bare")
                ends.append(known.id)
                continue
            column = new_id()
            write("node", column, f, [])
            ends.append(column)
            if f.var:
                table = table.bind(f.var, Element("node", graph, column, ""))
        for i, f in enumerate(path):
            if not isinstance(f, EdgePattern):
                continue
            if f.quantifier or len(f.directions) != 1:
                raise InvalidQuery("an inserted edge needs one direction")
            if f.var:
                check_new(table, f.var)
            way = next(iter(f.directions))
            a, b = (ends[i - 1], ends[i + 1]) if way != "L" else (ends[i + 1], ends[i - 1])
            column = new_id()
            write("edge", column, f, [F.col(a).alias(SOURCE), F.col(b).alias(TARGET)], way != "U")
            if f.var:
                table = table.bind(f.var, Element("edge", graph, column, ""))
    graph.cell[0] = replace(graph.data, next_id=base + n_rows * max(total, 1))
    return refresh(runner, Table(table.df.drop(row), table.scope))


def refresh(runner, table: Table, only: dict | None = None) -> Table:
    """Read the bound elements of the changed graph again; other values stay as they were.

    ``only`` gives the numbers of the fragments that nodes and edges of the table can be in.
    """
    rescanned: dict[str, Element] = {}
    df = table.df
    scope = {}
    for key, (display, b) in table.scope.items():
        if not isinstance(b, Element) or b.graph is not runner.graph:
            scope[key] = (display, b)
            continue
        if b.id not in rescanned:
            rows, element, source, target = scan(runner.graph, b.kind, None, runner.wanted, frozenset("RU"), runner.session.spark, once=True, only=only and only[b.kind])
            rows = rows.drop(source, target) if b.kind == "edge" else rows
            # The id that was bound stays: where it finds no row any more, reading is an error.
            df = df.join(rows.withColumnRenamed(element.id, found := fresh("found")), F.col(b.id) == F.col(found), "left").drop(found)
            rescanned[b.id] = replace(element, id=b.id, conditional=True, guarded=True)
        scope[key] = (display, rescanned[b.id])
    return Table(df, scope)


def fragments_of(runner, table: Table) -> dict:
    """Numbers of the fragments that hold the bound nodes and edges of a written table."""
    bound = {b.id: b for _, b in table.scope.values() if isinstance(b, Element) and b.graph is runner.graph and b.fragment in table.df.columns}
    out: dict[str, set] = {"node": set(), "edge": set()}
    if bound:
        found = table.df.agg(*[F.collect_set(b.fragment).alias(f"f{i}") for i, b in enumerate(bound.values())]).first()
        for b, numbers in zip(bound.values(), found, strict=True):
            out[b.kind] |= set(numbers)
    return out


def target(table: Table, name: str) -> Element:
    found = table.find(name)
    if not isinstance(found, Element):
        raise InvalidQuery(f"{name} is not an element")
    return found


def patch(runner, clause: Clause, table: Table) -> Table:
    """SET and REMOVE. Items on one element make one patch; different values for one element are refused."""
    graph, session = runner.graph, runner.session
    plans: dict[tuple[str, str], dict] = {}
    for item in clause.items:
        element = target(table, item[1])
        plan = plans.setdefault((element.kind, element.id), {"element": element, "values": {}, "all": False, "add": set(), "drop": set()})
        if item[0] == "property":
            name = item[2]
            if name.lower() in {n.lower() for n in plan["values"]}:
                raise InvalidQuery(f"{name} is set twice")
            plan["values"][name] = bind(item[3], table, runner.context) if clause.kind == "set" else None
        elif item[0] == "all":
            plan["all"] = True
            for name, ast in item[2]:
                plan["values"][name] = bind(ast, table, runner.context)
        else:
            plan["add" if clause.kind == "set" else "drop"] |= set(item[2])
    data, held = graph.data, fragments_of(runner, table)
    for plan in plans.values():
        element = plan["element"]
        values = {n: v for n, v in plan["values"].items()}
        columns = [F.col(element.id).alias("__gone"), live(element, F.col(element.fragment)).alias("__patch_fragment")]
        columns += [(v.col if v is not None else F.lit(None).cast("string")).alias(f"__patch_{i}") for i, v in enumerate(values.values())]
        changes = session.freeze(table.df.select(*columns).where(F.col(element.id).isNotNull()).distinct())
        counted = changes.groupBy("__patch_fragment", "__gone").count().groupBy("__patch_fragment").agg(F.count("*"), F.max("count")).collect()  # one row for each fragment
        if any(most > 1 for _, _, most in counted):
            raise InvalidQuery("one element is given different values")
        counts = {number: n for number, n, _ in counted}
        runner.affected += sum(counts.values())
        fragments = list(data.fragments(element.kind))
        moved = []
        for number in counts:
            f = fragments[number]
            labels = (f.labels | plan["add"]) - plan["drop"]
            stays = labels == f.labels
            old = {n.lower(): (n, t) for n, t in f.properties}
            layout = list(f.properties)
            for name, v in values.items():
                known = old.get(name.lower())
                if v is None or v.type == "null":
                    continue
                if known is None:
                    layout.append((name, v.type))
                elif known[1] != v.type and not (known[1] == "float" and v.type == "int"):
                    raise InvalidQuery(f"property {name} is stored as another type on these labels")
            position = {n.lower(): i for i, n in enumerate(values)}
            fixed = [ID] + ([SOURCE, TARGET] if f.is_edge else [])
            # A change of the layout writes the fragment anew, any other only the rows it affects.
            anew = stays and tuple(layout) != f.properties
            joined = f.df.join(changes.drop("__patch_fragment").withColumn("__hit", F.lit(True)), F.col(ID) == F.col("__gone"), "left" if anew else "inner")
            out = []
            for name, t in layout:
                before = F.col(f"`{old[name.lower()][0]}`") if name.lower() in old else F.lit(None)
                if name.lower() in position:
                    after = F.col(f"__patch_{position[name.lower()]}")
                elif plan["all"]:
                    after = F.lit(None)
                else:
                    out.append(before.cast(spark_kind(t)).alias(name))
                    continue
                out.append(F.when(F.col("__hit"), after.cast(spark_kind(t))).otherwise(before.cast(spark_kind(t))).alias(name))
            written = session.freeze(joined.select(*fixed, *out))
            loses = plan["all"] or any(v is None or not v.literal or v.value is None for v in values.values())
            if stays and not anew:
                whole = f.without(changes).plus(written)
                kept = without_empty(whole.df, layout, values, plan["all"]) if loses else layout
                fragments[number] = whole if kept == layout else Fragment(whole.df.drop(*[n for n, t in layout if (n, t) not in kept]), labels, f.directed, tuple(kept))
                continue
            kept = without_empty(written, layout, values, plan["all"] or not stays) if loses or not stays else layout
            new = Fragment(written.drop(*[n for n, t in layout if (n, t) not in kept]), labels, f.directed, tuple(kept))
            if stays:
                fragments[number] = new
            else:
                fragments[number] = f.without(changes)
                moved.append(new)
        kind = "nodes" if element.kind == "node" else "edges"
        data = replace(data, **{kind: tuple(fragments)}, counts={})
        for new in moved:
            data = add_fragment(data, new)
            held[element.kind] |= {i for i, f in enumerate(data.fragments(element.kind)) if f.labels == new.labels and f.directed == new.directed}
    graph.cell[0] = data
    return refresh(runner, table, held)


def without_empty(df: DataFrame, layout: list, values: dict, everything: bool) -> list:
    """The layout without those properties, of the changed ones or of all, that hold only nulls: they are not stored."""
    named = {n.lower() for n in values}
    asked = [p for p in layout if everything or p[0].lower() in named]
    if not asked:
        return layout
    filled = df.agg(*[F.count(F.col(f"`{n}`")).alias(f"c{i}") for i, (n, _) in enumerate(asked)]).first()
    empty = {p for i, p in enumerate(asked) if not filled[i]}
    return [p for p in layout if p not in empty]


def delete(runner, clause: Clause, table: Table) -> Table:
    """Only fragments that hold deleted elements get a layer of ids that are gone; edge tables are read for lost edges."""
    graph, session = runner.graph, runner.session
    gone: dict[str, list[DataFrame]] = {"node": [], "edge": []}
    for ast in clause.items:
        value = bind(ast, table, runner.context)
        if not isinstance(value.binding, Element):
            raise InvalidQuery("DELETE needs elements")
        element = value.binding
        ids = table.df.select(F.col(element.id).alias("__gone"), live(element, F.col(element.fragment)).alias("__fragment"))
        gone[element.kind].append(ids.where("__gone is not null"))
    data, held = graph.data, fragments_of(runner, table)
    nodes, edges = list(data.nodes), list(data.edges)

    def written(frames: list[DataFrame]) -> tuple[DataFrame | None, dict[int, int]]:
        """One frame of the ids, and how many each fragment holds."""
        if not frames:
            return None, {}
        out = frames[0]
        for other in frames[1:]:
            out = out.unionAll(other)
        out = session.freeze(out.distinct())
        return out, {number: n for number, n in out.groupBy("__fragment").count().collect()}  # one row for each fragment

    lost, touched = written(gone["edge"])
    for number in touched:
        edges[number] = edges[number].without(lost)
    runner.affected += sum(touched.values())
    dead, touched = written(gone["node"])
    if touched:
        runner.affected += sum(touched.values())
        ends = []
        for number, f in enumerate(edges):
            for side in (SOURCE, TARGET):
                hit = f.df.join(dead.select("__gone"), F.col(side) == F.col("__gone"), "left_semi")
                ends.append(hit.select(F.col(ID).alias("__gone"), F.lit(number).alias("__fragment")))
        hanging, per_fragment = written(ends)
        if per_fragment and not clause.extra:
            raise InvalidQuery("a deleted node still has edges")
        for number, n in per_fragment.items():
            edges[number] = edges[number].without(hanging)
            runner.affected += n
        for number in touched:
            nodes[number] = nodes[number].without(dead)
    graph.cell[0] = replace(data, nodes=tuple(nodes), edges=tuple(edges), next_id=data.fresh_id(), counts={})
    return refresh(runner, table, held)
