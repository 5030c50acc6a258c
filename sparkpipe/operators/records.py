"""Record maps: blocks of rows to single rows and back, a generalised pivot and unpivot."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import kind_of, quoted


@dataclass(frozen=True)
class RecordSpecification:
    """The shape of a record: control_table {column: cells}; key columns tell its rows apart, other cells name columns of
    the single-row form."""

    control_table: dict[str, list] = field(hash=False)
    record_keys: tuple[str, ...] = ()
    control_table_keys: tuple[str, ...] | None = None
    strict: bool = True

    def __post_init__(self):
        table = {k: list(v) for k, v in self.control_table.items()}
        sizes = {len(v) for v in table.values()}
        if len(sizes) != 1 or not min(sizes):
            raise ValueError("a control table has rows, as many in each column")
        keys = self.control_table_keys
        if keys is None:
            keys = (next(iter(table)),) if min(sizes) > 1 else ()
        keys, record_keys = ((k,) if isinstance(k, str) else tuple(k) for k in (keys, self.record_keys))
        if missing := [k for k in keys if k not in table]:
            raise ValueError(f"control table lacks {missing}")
        rows = list(zip(*(table[k] for k in keys), strict=True)) if keys else [()]
        if any(v is None for r in rows for v in r) or len(set(rows)) != min(sizes):
            raise ValueError("control keys must tell the control table's rows apart, without nulls")
        cells = [v for c, vs in table.items() if c not in keys for v in vs]
        if not cells or not all(isinstance(v, str) for v in cells):
            raise ValueError("cells must name columns")
        if self.strict and len(set(cells)) != len(cells):
            raise ValueError("cells must differ")
        if set(record_keys) & ({*table} | set(cells)):
            raise ValueError("record keys must differ from control columns and cells")
        object.__setattr__(self, "control_table", table)
        object.__setattr__(self, "control_table_keys", keys)
        object.__setattr__(self, "record_keys", record_keys)

    @property
    def n_rows(self) -> int:
        return len(next(iter(self.control_table.values())))

    @property
    def value_columns(self) -> list[str]:
        return [c for c in self.control_table if c not in self.control_table_keys]

    @property
    def content_keys(self) -> list[str]:
        return list(dict.fromkeys(v for c in self.value_columns for v in self.control_table[c]))

    @property
    def row_columns(self) -> list[str]:
        return [*self.record_keys, *self.content_keys]

    @property
    def block_columns(self) -> list[str]:
        return [*self.record_keys, *self.control_table]

    def row_version(self) -> RecordSpecification:
        return RecordSpecification({c: [c] for c in self.content_keys}, self.record_keys, (), self.strict)

    def value_column_form(self, key: str = "measure", value: str = "value") -> RecordSpecification:
        return RecordSpecification({key: self.content_keys, value: self.content_keys}, self.record_keys, (key,), self.strict)

    def map_to_rows(self) -> RecordMap:
        return RecordMap(blocks_in=self, strict=self.strict)

    def map_from_rows(self) -> RecordMap:
        return RecordMap(blocks_out=self, strict=self.strict)

    def map_to_keyed_column(self, key: str = "measure", value: str = "value") -> RecordMap:
        return RecordMap(blocks_in=self, blocks_out=self.value_column_form(key, value), strict=self.strict)

    def map_from_keyed_column(self, key: str = "measure", value: str = "value") -> RecordMap:
        return RecordMap(blocks_in=self.value_column_form(key, value), blocks_out=self, strict=self.strict)

    def __repr__(self) -> str:
        return f"RecordSpecification({self.control_table!r}, record_keys={list(self.record_keys)!r}, control_table_keys={list(self.control_table_keys)!r}, strict={self.strict!r})"


@dataclass(frozen=True)
class RecordMap:
    """From the shape blocks_in to the shape blocks_out; None stands for single rows."""

    blocks_in: RecordSpecification | None = None
    blocks_out: RecordSpecification | None = None
    strict: bool = True

    def __post_init__(self):
        for side in ("blocks_in", "blocks_out"):
            spec = getattr(self, side)
            if spec is not None and spec.n_rows == 1 and not spec.control_table_keys and all(c == v[0] for c, v in spec.control_table.items()):
                object.__setattr__(self, side, None)
                object.__setattr__(self, f"_{side}_rows", spec)
        one = self.blocks_in or self.blocks_out
        if one is None:
            raise ValueError("a record map needs a shape of more than one row on a side")
        if self.blocks_in is not None and self.blocks_out is not None:
            if set(self.blocks_out.record_keys) - set(self.blocks_in.record_keys) or set(self.blocks_out.content_keys) - set(self.blocks_in.content_keys):
                raise ValueError("the outgoing shape asks for keys or cells that the incoming one lacks")

    @property
    def columns_needed(self) -> list[str]:
        return self.blocks_in.block_columns if self.blocks_in is not None else self.blocks_out.row_columns

    @property
    def columns_produced(self) -> list[str]:
        return self.blocks_out.block_columns if self.blocks_out is not None else self.blocks_in.row_columns

    def apply(self, df: DataFrame, *, validate: bool = False) -> DataFrame:
        """Lazy; with validate, a job first makes sure that keys tell the incoming rows apart."""
        if validate:
            spec = self.blocks_in
            keys = [*spec.record_keys, *spec.control_table_keys] if spec is not None else list(self.blocks_out.record_keys)
            if keys and not df.groupBy(*map(quoted, keys)).count().where("count > 1").limit(1).isEmpty():
                raise ValueError(f"rows are not keyed by {keys}")
        if self.blocks_in is not None:
            df = rows_of_blocks(df, self.blocks_in)
        return df if self.blocks_out is None else _to_blocks(df, self.blocks_out)

    transform = apply

    def act_on(self, other):
        from ..plans.nodes import Plan

        if isinstance(other, RecordMap):
            return self.compose(other)
        return other.convert_records(self) if isinstance(other, Plan) else self.apply(other)

    def as_pipeline(self, name: str = "data_frame"):
        from ..plans.nodes import table

        return table(name, self.columns_needed).convert_records(self)

    def inverse(self) -> RecordMap:
        if not self.strict:
            raise ValueError("only strict maps have an inverse")
        return RecordMap(blocks_in=self.blocks_out, blocks_out=self.blocks_in)

    def compose(self, first: RecordMap) -> RecordMap:
        """self after first."""
        if set(first.columns_produced) != set(self.columns_needed):
            raise ValueError("the maps don't meet")
        inner, outer = first.blocks_out, self.blocks_in
        if (inner is None) != (outer is None):
            raise ValueError("the maps don't meet")
        to = {}
        if inner is not None:  # cell names of the outer shape by place, as those of the inner one
            keys = inner.control_table_keys
            if set(keys) != set(outer.control_table_keys):
                raise ValueError("the maps don't meet")
            at = {tuple(inner.control_table[k][i] for k in keys): i for i in range(inner.n_rows)}
            for j in range(outer.n_rows):
                i = at.get(tuple(outer.control_table[k][j] for k in keys))
                if i is None:
                    raise ValueError("the maps don't meet")
                to |= {outer.control_table[c][j]: inner.control_table[c][i] for c in outer.value_columns}
        out = self.blocks_out
        if out is None and any(k != v for k, v in to.items()):
            out = None if first.blocks_in is None else RecordSpecification({k: [v] for k, v in to.items()}, outer.record_keys, ())
        elif out is not None:
            table = {c: v if c in out.control_table_keys else [to.get(x, x) for x in v] for c, v in out.control_table.items()}
            out = RecordSpecification(table, out.record_keys, out.control_table_keys, out.strict)
        return RecordMap(blocks_in=first.blocks_in, blocks_out=out)

    def __rrshift__(self, other):
        return self.act_on(other)

    def example_input(self) -> dict[str, list]:
        """One record, each cell holding its own name."""
        spec = self.blocks_in
        if spec is None:
            return {c: [c] for c in self.columns_needed}
        return {**{k: [k] * spec.n_rows for k in spec.record_keys}, **spec.control_table}

    def fmt(self) -> str:
        return f"{self.blocks_in or 'rows'} -> {self.blocks_out or 'rows'}"

    def __repr__(self) -> str:
        return f"RecordMap(blocks_in={self.blocks_in!r}, blocks_out={self.blocks_out!r}, strict={self.strict!r})"


def rows_of_blocks(df: DataFrame, spec: RecordSpecification) -> DataFrame:
    """One aggregate: for each cell the largest value at its control key; a missing row gives null."""
    cells = {}
    for i in range(spec.n_rows):
        match = F.lit(True)
        for k in spec.control_table_keys:
            match = match & (quoted(k).cast("string") == F.lit(str(spec.control_table[k][i])))
        for c in spec.value_columns:
            cells[spec.control_table[c][i]] = F.max(F.when(match, quoted(c)))
    return df.groupBy(*map(quoted, spec.record_keys)).agg(*[cells[c].alias(c) for c in spec.content_keys])


def common_types(types: dict, spec: RecordSpecification) -> dict[str, str]:
    """For each value column the type that its cells share; types: fields by name."""
    common = {}
    for c in spec.value_columns:
        found = [types[v].dataType for v in spec.control_table[c]]
        kinds = {kind_of(t) for t in found} - {"null"}
        if len(kinds) > 1 and kinds != {"int", "float"}:
            raise ValueError(f"cells of {c} have no common type: {sorted(kinds)}")
        common[c] = "double" if kinds == {"int", "float"} else "bigint" if kinds == {"int"} else found[0].simpleString()
    return common


def _to_blocks(df: DataFrame, spec: RecordSpecification) -> DataFrame:
    """One row per control row: an exploded array of structs, so no shuffle."""
    common = common_types(dict(zip(df.columns, df.schema, strict=True)), spec)
    rows = [
        F.struct(*[(F.lit(v[i]) if c in spec.control_table_keys else quoted(v[i]).cast(common[c])).alias(f"f{j}") for j, (c, v) in enumerate(spec.control_table.items())]) for i in range(spec.n_rows)
    ]
    row = "_row"
    while row in {k.lower() for k in spec.record_keys}:
        row += "_"
    out = df.select(*map(quoted, spec.record_keys), F.explode(F.array(*rows)).alias(row))
    return out.select(*map(quoted, spec.record_keys), *[F.col(f"{row}.f{j}").alias(c) for j, c in enumerate(spec.control_table)])


def pivot_specification(*, row_keys, col_name_key: str, col_value_key: str, value_cols: list[str]) -> RecordMap:
    """Key and value columns to one column per key value."""
    return RecordSpecification({col_name_key: list(value_cols), col_value_key: list(value_cols)}, tuple(row_keys), (col_name_key,)).map_to_rows()


def unpivot_specification(*, row_keys, col_name_key: str, col_value_key: str, value_cols: list[str]) -> RecordMap:
    return RecordSpecification({col_name_key: list(value_cols), col_value_key: list(value_cols)}, tuple(row_keys), (col_name_key,)).map_from_rows()


def pivot_blocks_to_rowrecs(*, attribute_key_column: str, attribute_value_column: str, record_keys, record_value_columns) -> RecordMap:
    return pivot_specification(row_keys=record_keys, col_name_key=attribute_key_column, col_value_key=attribute_value_column, value_cols=list(record_value_columns))


def pivot_rowrecs_to_blocks(*, attribute_key_column: str, attribute_value_column: str, record_keys, record_value_columns) -> RecordMap:
    return unpivot_specification(row_keys=record_keys, col_name_key=attribute_key_column, col_value_key=attribute_value_column, value_cols=list(record_value_columns))
