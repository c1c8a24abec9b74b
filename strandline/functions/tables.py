"""Table functions for SQL: folds over the rows of a table in order, each key by itself.

``register(spark)``, then for instance::

    select * from moving_average(table(select * from t), key => 'run', ordered => 'step', value => 'seconds', alpha => 0.3)

The functions say themselves how their table is partitioned and ordered, and take only what they need, so callers name
columns and Spark shuffles and sorts; a row is in memory at a time, beside the state.  Keys are dealt to shares by their hash,
and a share's rows come key by key, so many small keys cost no more than a large one."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udtf, udtf
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BooleanType, DataType, DoubleType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, SelectedColumn

from strandline.operators.machines import same
from strandline.operators.ordered import averaging
from strandline.operators.trajectory import POSE_CELLS, clamping, keyframe_test

#: Shares that a fold's keys are dealt to.
SHARES = 16_384


@dataclass
class FoldPlan(AnalyzeResult):
    options: dict[str, float] = field(default_factory=dict)


@dataclass(frozen=True)
class Fold:
    """``make(**options)`` gives start and step of a fold; ``step(state, *fields)`` is called for each row in order, null leaves
    a row out.  ``read``, given the fields' columns, names the SQL expressions of one type that are the step's arguments instead."""

    make: Callable
    fields: tuple[str, ...]
    name: str
    kind: DataType
    read: Callable[..., list[str]] | None = None

    def expressions(self, columns: list[str]) -> list[str]:
        columns = [f"`{c}`" for c in columns]
        return columns if self.read is None else [f"array({', '.join(self.read(*columns))})"]

    def rows(self, held: StructType, key: str, ordered: str) -> StructType:
        return StructType().add(key, held[key].dataType).add(ordered, held[ordered].dataType).add(self.name, self.kind)


def _share(key: str) -> str:
    return f"pmod(hash(`{key}`), {SHARES})"


def _known(held: StructType, names: list[str]) -> None:
    absent = sorted(set(names) - set(held.names))
    if absent:
        raise ValueError(f"no such columns: {', '.join(absent)}")


def fold_function(make: Callable, fields: tuple[str, ...], name: str, kind: DataType, read: Callable[..., list[str]] | None = None) -> type:
    """A table function with the rows (key, order, ``name``) of a fold, see ``Fold``.

    In SQL ``key``, ``ordered`` and the fields take names of columns (a field its own name by default), options take
    numbers.  Orders should be unique within a key."""
    fold = Fold(make, fields, name, kind, read)

    class Function:
        how = fold

        @staticmethod
        def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, ordered: AnalyzeArgument, **given: AnalyzeArgument) -> FoldPlan:
            if not rows.isTable or not all(a.isConstantExpression for a in (key, ordered, *given.values())):
                raise ValueError("a fold takes a table, then names of columns and numbers")
            names = [given[f].value if f in given else f for f in fields]
            _known(rows.dataType, [key.value, ordered.value, *names])
            options = {k: float(a.value) for k, a in given.items() if k not in fields}
            make(**options)
            k, o = f"`{key.value}`", f"`{ordered.value}`"
            wanted = [SelectedColumn(e, f"_{i}") for i, e in enumerate([k, o, *fold.expressions(names)])]
            return FoldPlan(fold.rows(rows.dataType, key.value, ordered.value), partitionBy=[PartitioningColumn(_share(key.value))], orderBy=[OrderingColumn(k), OrderingColumn(o)], select=wanted, options=options)

        def __init__(self, plan: FoldPlan):
            self.start, self.step = make(**plan.options)
            self.now, self.state = object(), None

        def eval(self, rows: Row, *_, **__) -> list[tuple] | None:
            key, order, *values = rows
            if not same(key, self.now):
                self.now, self.state = key, self.start()
            found = self.step(self.state, *(values if read is None else values[0]))
            return None if found is None else [(key, order, found)]

    return Function


def batch_function(fold: Fold) -> type:
    """The fold over Arrow batches of (key, order, the fold's expressions), in the shares and order of ``batched``."""

    class Function:
        def __init__(self) -> None:
            self.now, self.state, self.step = object(), None, None

        def eval(self, rows: pa.RecordBatch, **options: pa.Array) -> Iterator[pa.Table]:
            if not rows.num_rows:
                return
            if self.step is None:
                self.start, self.step = fold.make(**{k: float(v[0].as_py()) for k, v in options.items()})
            keys, orders, *values = rows.columns[1:]
            fields = zip(*(v.to_pylist() for v in values), strict=True) if fold.read is None else _lists(values[0])
            out = []
            for key, row in zip(keys.to_pylist(), fields, strict=True):
                if not same(key, self.now):
                    self.now, self.state = key, self.start()
                out.append(self.step(self.state, *row))
            found = pa.array(out, to_arrow_type(fold.kind))
            table = pa.table([keys, orders, found], names=[*rows.schema.names[1:3], fold.name])
            yield table.filter(found.is_valid()) if found.null_count else table

    return Function


def _lists(column: pa.Array) -> list[list]:
    """Lists of equal length; by way of a matrix where nothing is null."""
    flat = column.flatten()
    if column.null_count or flat.null_count or not pa.types.is_floating(flat.type):
        return column.to_pylist()
    return flat.to_numpy().reshape(len(column), -1).tolist()


def batched(rows: DataFrame, function: str, key: str, ordered: str, functions: dict[str, type] | None = None, **columns: str) -> DataFrame:
    """Makes ``function``_batches callable in the session's SQL, for the rows that are given back::

        select * from keyframes_batches(table({rows}) partition by share order by run, step, far => 10)

    Spark lets no function of batches say itself how its table is partitioned or what rows it has, so key, order and the
    fields' columns are named here, and SQL deals whole keys to shares and orders them."""
    fold = (functions or FUNCTIONS)[function].how
    names = [columns.get(f, f) for f in fold.fields]
    _known(rows.schema, [key, ordered, *names])
    rows.sparkSession.udtf.register(f"{function}_batches", arrow_udtf(batch_function(fold), returnType=fold.rows(rows.schema, key, ordered)))
    taken = [F.expr(e).alias(f"_{i}") for i, e in enumerate(fold.expressions(names))]
    return rows.select(F.expr(_share(key)).alias("share"), key, ordered, *taken)


def _pose_cells(pose: str, match: str) -> list[str]:
    return [f"double({pose}[{i}])" for i in POSE_CELLS] + [f"double({match})"]


#: The table functions by their names in SQL.
FUNCTIONS = {
    "moving_average": fold_function(averaging, ("value",), "ema", DoubleType()),
    "keyframes": fold_function(keyframe_test, ("pose", "match_ratio"), "keyframe", BooleanType(), _pose_cells),
    "clamped_yaw": fold_function(clamping, ("yaw",), "yaw_held", DoubleType()),
}


def register(spark: SparkSession, prefix: str = "", functions: dict[str, type] | None = None) -> None:
    """Makes the functions (by default all of this module) callable in the session's SQL."""
    for name, function in (functions or FUNCTIONS).items():
        spark.udtf.register(prefix + name, udtf(function))
