"""Plans to DataFrames: one memoised walk, and no action but where a whole table is numbered or its graph labelled, which
write scratch tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import Expressions, compatible, quoted
from ..functions.registry import NEED_ORDER
from ..sources.scratch import BROADCAST_ROWS, small_tasks, stored
from . import nodes as N
from .expr import Call, Col, Lit


def compile_plan(plan: N.Plan, tables: dict[str, DataFrame], *, strict: bool = False) -> DataFrame:
    """The plan over tables by name; a shared node becomes one DataFrame, so Spark can reuse its exchanges."""
    return compiled_nodes(plan, tables, strict=strict)[id(plan)]


def compiled_nodes(plan: N.Plan, tables: dict[str, DataFrame], *, strict: bool = False, types_only: bool = False) -> dict[int, DataFrame]:
    """The lazy DataFrame of every node, by the node's id.  types_only: frames of the right types that nothing is run for."""
    memo: dict[int, DataFrame] = {}
    for p in plan.nodes():
        step = _typed if types_only and isinstance(p, N.Extend) else _STEPS.get(type(p))
        memo[id(p)] = step(p, *[memo[id(s)] for s in p.sources]) if p.sources else _leaf(p, tables, strict)
    return memo


def _typed(p: N.Extend, df: DataFrame) -> DataFrame:
    """The extend's columns by name and type, each window by itself."""
    e, made = Expressions(df), {}
    order = [quoted(c).asc_nulls_last() for c in p.order_by]
    for k, t in p.ops:
        if isinstance(t, Call) and t.op in ("connected_components", "co_equalizer"):
            made[k] = quoted(t.args[0].name)
        elif not p.windowed:
            made[k] = e.column(t)
        elif t.op == "_ngroup" or t.op.startswith("is_monotonic"):
            made[k] = F.lit(None).cast("bigint" if t.op == "_ngroup" else "boolean")
        else:
            made[k] = e.windowed(t, list(p.partition_by), order)
    return _assigned(df, p.columns, made)


def _free(*frames: DataFrame) -> Callable[[str], str]:
    """Names that none of the frames has, whatever their case."""
    taken = {c.lower() for f in frames for c in f.columns}

    def name(like: str) -> str:
        while like.lower() in taken:
            like += "_"
        taken.add(like.lower())
        return like

    return name


def _leaf(p: N.Plan, tables: dict[str, DataFrame], strict: bool) -> DataFrame:
    if isinstance(p, N.SqlTable):
        return SparkSession.active().sql(p.sql).select(*map(quoted, p.columns))
    df = tables.get(p.name, p.frame)
    if df is None:
        df = SparkSession.active().table(p.name)
    if not isinstance(df, DataFrame):
        from ..sources.frames import from_pandas

        df = from_pandas(SparkSession.active(), df)
    if missing := [c for c in p.columns if c not in df.columns]:
        raise ValueError(f"table {p.name} lacks {missing}")
    if strict and len(df.columns) != len(p.columns):
        raise ValueError(f"table {p.name} has columns beyond {list(p.columns)}")
    return df.select(*map(quoted, p.columns))


def _assigned(df: DataFrame, columns, made: dict) -> DataFrame:
    return df.select(*[made[c].alias(c) if c in made else quoted(c) for c in columns])


def _extend(p: N.Extend, df: DataFrame) -> DataFrame:
    e, made = Expressions(df), {}
    if not p.windowed:
        if any(isinstance(t, Call) and t.op in ("connected_components", "co_equalizer") for _, t in p.ops):
            from ..operators.components import label_edges

            for name, t in p.ops:
                f, g = (a.name for a in t.args)
                df = label_edges(df, f, g, name)
            return df.select(*map(quoted, p.columns))
        return _assigned(df, p.columns, {k: e.column(t) for k, t in p.ops})
    order = [quoted(c).desc_nulls_last() if c in p.reverse else quoted(c).asc_nulls_last() for c in p.order_by]
    monotone = {k: t for k, t in p.ops if t.op.startswith("is_monotonic")}
    grouped = {k: t for k, t in p.ops if t.op == "_ngroup"}
    rest = {k: t for k, t in p.ops if k not in monotone and k not in grouped}
    if not p.partition_by:
        for k in [k for k, t in rest.items() if _goes_by_ranges(e, t, bool(p.order_by))]:
            name = _free(df)(f"_{k}")
            df = _by_ranges(df, name, rest.pop(k), order)
            made[k] = quoted(name)
    totals = {k: t for k, t in rest.items() if t.op not in NEED_ORDER and not (t.op == "_count" and p.order_by) and (t.op in ("nunique", "median") or not p.partition_by)}
    if totals:
        # aggregates beside all rows: of the whole table, or ones whose window would hold a partition's values in a task
        e, free = Expressions(df), _free(df)
        names, keys = {k: free(f"_{i}") for i, k in enumerate(totals)}, {k: free(f"_k{i}") for i, k in enumerate(p.partition_by)}
        made |= {k: quoted(n) for k, n in names.items()}
        sums = df.groupBy(*[quoted(k).alias(n) for k, n in keys.items()]).agg(*[_global(e, t).alias(names[k]) for k, t in totals.items()])
        match = [quoted(k).eqNullSafe(quoted(n)) for k, n in keys.items()]
        df = df.join(sums, match, "left") if match else df.crossJoin(F.broadcast(sums))
        rest = {k: t for k, t in rest.items() if k not in totals}
    e = Expressions(df)
    for k, t in monotone.items():
        x, part = e.column(t.args[0]), Window.partitionBy(*map(quoted, p.partition_by))
        before = F.lag(x).over(part.orderBy(*order))
        made[k] = x >= before if t.op.endswith("increasing") else x <= before
    made |= {k: e.windowed(t, list(p.partition_by), order) for k, t in rest.items()}
    out = _assigned(df, [*df.columns, *(k for k in made if k not in df.columns)], made)
    if monotone:
        part = Window.partitionBy(*map(quoted, p.partition_by))
        out = _assigned(out, out.columns, {k: F.bool_and(F.coalesce(quoted(k), F.lit(True))).over(part) for k in monotone})
    if grouped:
        keys = list(p.partition_by)
        if not keys:
            out = _assigned(out, p.columns, {k: F.lit(0).cast("bigint") for k in grouped})
        else:
            free = _free(out)
            at, number = [free(f"_k{i}") for i in range(len(keys))], free("_n")
            numbered = numbered_rows(df.select(*map(quoted, keys)).distinct(), [quoted(k).asc_nulls_last() for k in keys], number)
            numbered = numbered.select(*[quoted(k).alias(n) for k, n in zip(keys, at, strict=True)], quoted(number))
            # said, since sizes guessed from files may make df the side to broadcast
            numbered = F.broadcast(numbered) if numbered.count() <= BROADCAST_ROWS else numbered.hint("merge")
            match = [quoted(k).eqNullSafe(quoted(n)) for k, n in zip(keys, at, strict=True)]
            out = _assigned(out.join(numbered, match, "left"), p.columns, {k: quoted(number) for k in grouped})
    return out.select(*map(quoted, p.columns))


def _goes_by_ranges(e: Expressions, t: Call, ordered: bool) -> bool:
    if t.op == "rank" or not ordered:
        return t.op == "rank"
    kind = e.kind(e.column(t.args[0])) if t.op in ("shift", "cumsum") else ""
    return t.op in ("_row_number", "cumcount") or t.op == "shift" and kind != "null" or t.op == "cumsum" and kind in ("int", "bool")


def _ranges(df: DataFrame, order: list[Column], part: str) -> tuple[DataFrame, list[Column]]:
    """df stored in ranges of the order, with the number of each row's range; and the columns of df from it."""
    ranged = df.repartitionByRange(*order).withColumn(part, F.spark_partition_id())
    voids = {c for c, kind in df.dtypes if kind == "void"}  # which no file holds
    # the ranges hang on a sample, so all uses must have the same ones
    with small_tasks(df.sparkSession):
        ranged = stored(ranged.select(*[quoted(c) for c in ranged.columns if c not in voids]), "ranges")
    return ranged, [F.lit(None).alias(c) if c in voids else quoted(c) for c in df.columns]


def numbered_rows(df: DataFrame, order: list[Column], name: str, amount: Column | None = None) -> DataFrame:
    """df with what the rows before each, by order, amount to: ranges of rows are summed side by side, and each goes on
    where those before it end.  Each row amounts to 1 if nothing else is said, so that rows are numbered from 0."""
    free = _free(df)
    part, rows, before, own = free("_part"), free("_rows"), free("_before"), free("_own")
    ranged, kept = _ranges(df.withColumn(own, F.lit(1).cast("bigint") if amount is None else amount), order, part)
    sums = ranged.groupBy(part).agg(F.sum(quoted(own)).alias(rows))  # a row a partition
    starts = sums.select(quoted(part).alias(before), F.coalesce(F.sum(quoted(rows)).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(rows))
    earlier = F.coalesce(F.sum(quoted(own)).over(Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    both = ranged.join(F.broadcast(starts), quoted(part) == quoted(before))
    return both.select(*kept[:-1], (earlier + quoted(rows)).try_cast("bigint").alias(name))


def shifted_rows(df: DataFrame, order: list[Column], name: str, x: Column, steps: int) -> DataFrame:
    """df with x of the row that is `steps` before each by order, behind it if negative: ranges of rows are shifted side by
    side, and the rows at their edges, which have theirs in another range, look it up by number."""
    free = _free(df)
    part, value, tie, rows, before, start, place, near, at, far = map(free, ("_part", "_value", "_tie", "_rows", "_before", "_start", "_place", "_near", "_at", "_far"))
    ranged, kept = _ranges(df.withColumn(value, x).withColumn(tie, F.monotonically_increasing_id()), order, part)
    sums = ranged.groupBy(part).agg(F.count(F.lit(1)).alias(rows))  # a row a partition
    starts = sums.select(quoted(part).alias(before), quoted(rows), (F.sum(quoted(rows)).over(Window.orderBy(part)) - quoted(rows)).alias(start))
    within = Window.partitionBy(part).orderBy(*order, tie)  # ties fall alike each time
    both = ranged.join(F.broadcast(starts), quoted(part) == quoted(before))
    both = both.withColumns({place: F.row_number().over(within), near: F.lag(quoted(value), steps).over(within)}).withColumn(at, quoted(start) + quoted(place))
    given = quoted(place) > quoted(rows) - steps if steps > 0 else quoted(place) <= -steps
    edges = both.where(given).select((quoted(at) + steps).alias(before), quoted(value).alias(far))
    if abs(steps) <= 100:
        edges = F.broadcast(edges)  # so many rows a range
    inside = quoted(place) > steps if steps > 0 else quoted(place) <= quoted(rows) + steps
    both = both.drop(before).join(edges, quoted(at) == quoted(before), "left")
    return both.select(*kept[:-2], F.when(inside, quoted(near)).otherwise(quoted(far)).alias(name))


def _by_ranges(df: DataFrame, name: str, t: Call, order: list[Column]) -> DataFrame:
    """df with a rank, a row number, a shift or a sum of whole numbers over the whole table, without a task that has all rows."""
    e, free = Expressions(df), _free(df)
    if t.op == "shift":
        return shifted_rows(df, order, name, e.column(t.args[0]), t.args[1].value if len(t.args) > 1 else 1)
    if t.op == "cumsum":
        x = e.column(t.args[0]).cast("bigint")
        # sums of what comes before are decimals until they are whole: one that no bigint holds is null
        numbered = numbered_rows(df, order, name, F.coalesce(x, F.lit(0)).cast("decimal(38,0)"))
        return _assigned(numbered, numbered.columns, {name: F.when(x.isNotNull(), F.try_add(quoted(name), x))})
    if t.op != "rank":
        numbered = numbered_rows(df, order, name)
        return numbered if t.op == "cumcount" else _assigned(numbered, numbered.columns, {name: quoted(name) + 1})
    value, rows, before, again = free("_value"), free("_rows"), free("_before"), free("_again")
    tied = df.select(e.column(t.args[0]).alias(value)).where(quoted(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias(rows))
    ranks = numbered_rows(tied, [quoted(value)], before, quoted(rows)).select(F.struct(value).alias(again), (quoted(before) + (quoted(rows) + 1) / 2.0).alias(rows))
    joined = df.join(ranks, F.struct(e.column(t.args[0]).alias(value)) == quoted(again), "left")  # structs: exchanges that can be split
    return joined.select(*map(quoted, df.columns), quoted(rows).alias(name))


def _global(e: Expressions, t: Call):
    return F.count(F.lit(1)) if t.op == "_count" else e.aggregate(t)


def _project(p: N.Project, df: DataFrame) -> DataFrame:
    keys = [quoted(k) for k in p.group_by]
    if not p.ops:
        return df.select(*keys).distinct()
    e = Expressions(df)
    aggs = []
    for name, t in p.ops:
        a = e.aggregate(t)
        if t.op == "sum" and isinstance(t.args[0], Lit) and not keys:
            a = F.coalesce(a, F.lit(0).cast("bigint"))
        aggs.append(a.alias(name))
    return df.groupBy(*keys).agg(*aggs).select(*map(quoted, p.columns))


def _order(p: N.OrderRows, df: DataFrame) -> DataFrame:
    if p.by:
        df = df.orderBy(*[quoted(c).desc_nulls_last() if c in p.reverse else quoted(c).asc_nulls_last() for c in p.by])
    return df if p.limit is None else df.limit(p.limit)


def _renamed(p, df: DataFrame) -> DataFrame:
    return df.select(*[quoted(old).alias(new) for old, new in p.pairs()])


def _join(p: N.NaturalJoin, a: DataFrame, b: DataFrame) -> DataFrame:
    left, right = dict(zip(p.a.columns, a.schema, strict=True)), dict(zip(p.b.columns, b.schema, strict=True))
    for x, y in [*p.on, *((c, c) for c in right if c in left)]:
        if not compatible(left[x].dataType, right[y].dataType):
            raise ValueError(f"{x} and {y} have types that don't compare")
    free = _free(a, b)
    at = {c: free(f"_r{i}") for i, c in enumerate(p.b.columns)}
    b = b.select(*[quoted(c).alias(n) for c, n in at.items()])  # new names: one table may stand on both sides
    if p.hint:
        b = b.hint(p.hint)
    if p.jointype == "CROSS":
        both = a.crossJoin(b)
    else:
        match = [quoted(x) == F.col(at[y]) for x, y in p.on]
        both = a.join(b, match, N.JOINS[p.jointype])
    return both.select(*[
        (F.coalesce(quoted(c), F.col(at[c])).alias(c) if c in at else quoted(c)) if c in left else F.col(at[c]).alias(c) for c in p.columns
    ])


def _concat(p: N.ConcatRows, a: DataFrame, b: DataFrame) -> DataFrame:
    right = dict(zip(b.columns, b.schema, strict=True))
    for f in a.schema:
        if not compatible(f.dataType, right[f.name].dataType):
            raise ValueError(f"{f.name} has types that don't compare")
    a, b = a.select(*map(quoted, p.a.columns)), b.select(*map(quoted, p.a.columns))
    if p.id_column is not None:
        a, b = a.withColumn(p.id_column, F.lit(p.a_name)), b.withColumn(p.id_column, F.lit(p.b_name))
    return a.unionByName(b)


def _replicate(p: N.ReplicateRows, df: DataFrame) -> DataFrame:
    n = quoted(p.count_column).cast("bigint")
    return df.select(*map(quoted, p.source.columns), F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1))).alias(p.seq_column))


def _records(p: N.ConvertRecords, df: DataFrame) -> DataFrame:
    return p.record_map.apply(df, validate=p.validate)


_STEPS = {
    N.Extend: _extend, N.Project: _project, N.SelectRows: lambda p, df: df.filter(Expressions(df).column(p.expr)),
    N.SelectColumns: lambda p, df: df.select(*map(quoted, p.columns)), N.DropColumns: lambda p, df: df.select(*map(quoted, p.columns)),
    N.RenameColumns: _renamed, N.MapColumns: _renamed, N.OrderRows: _order, N.NaturalJoin: _join, N.ConcatRows: _concat, N.ConvertRecords: _records,
    N.ReplicateRows: _replicate,
}
__all__ = ["Col", "compile_plan"]
