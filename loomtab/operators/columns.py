"""Whole-frame column rewriting: names, labels, types, recoding, alignment, row ranges."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtab.operators.ordering import ordinal


def rename_all(df: DataFrame, rule: Callable[[str], str]) -> DataFrame:
    names = [rule(c) for c in df.columns]
    clashes = sorted({n for n in names if names.count(n) > 1})
    if clashes:
        raise ValueError(f"column names collide after renaming: {clashes}")
    return df.toDF(*names)


def normalize_names(df: DataFrame) -> DataFrame:
    return rename_all(df, lambda name: name.replace(" ", "_").lower())


def map_columns(df: DataFrame, rule: Callable[[str], Column], columns: Iterable[str] | None = None) -> DataFrame:
    """Rewrite each chosen column with ``rule(name)``; other columns pass through."""
    chosen = set(df.columns if columns is None else columns)
    return df.select(*[rule(c).alias(c) if c in chosen else F.col(c) for c in df.columns])


def label_name(df: DataFrame, label: str | None = None) -> str:
    """The named label, or the last column when none is named."""
    if label is None:
        return df.columns[-1]
    if label not in df.columns:
        raise ValueError(f"no column {label!r}")
    return label


def pop_label(df: DataFrame, label: str | None = None) -> tuple[list[str], str]:
    """Feature names and label name of one frame; the rows stay together."""
    name = label_name(df, label)
    return [c for c in df.columns if c != name], name


def numeric_columns(df: DataFrame, integers: bool = True) -> list[str]:
    kinds = (T.NumericType,) if integers else (T.FractionalType,)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def select_by_type(df: DataFrame, kind: str, keep: Sequence[str] = ()) -> DataFrame:
    chosen = numeric_columns(df) if kind == "numeric" else categorical_columns(df)
    return df.select(*keep, *[c for c in chosen if c not in keep])


def resolve_chain(steps: Iterable[tuple[object, object]]) -> dict[object, object]:
    """Fold replacements applied one after the other into one direct mapping."""
    final: dict[object, object] = {}
    for old, new in steps:
        for start, end in list(final.items()):
            if end == old:
                final[start] = new
        final.setdefault(old, new)
    return final


def recode(
    df: DataFrame,
    steps: Mapping[object, object] | Iterable[tuple[object, object]],
    columns: Sequence[str] | str,
    to: str | None = None,
) -> DataFrame:
    """Replace values; ``columns='*'`` touches every text column.

    With ``to`` the result is cast, for labels that turn from text into numbers.
    """
    mapping = resolve_chain(steps.items() if isinstance(steps, Mapping) else steps)
    names = categorical_columns(df) if columns == "*" else ([columns] if isinstance(columns, str) else columns)

    def rule(name: str) -> Column:
        value = F.col(name)
        result = value.cast("string")
        for old, new in mapping.items():
            result = F.when(value == F.lit(old), F.lit(str(new))).otherwise(result)
        return result.try_cast(to) if to else result

    return map_columns(df, rule, names)


def cast_all(df: DataFrame, to: str = "float", columns: Sequence[str] | None = None) -> DataFrame:
    return map_columns(df, lambda c: F.col(c).try_cast(to), columns)


def finite(name: str | Column) -> Column:
    """NULL in place of NaN and both infinities."""
    value = F.col(name) if isinstance(name, str) else name
    bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(~bad, value)


def clean_inf(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    fractional = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return map_columns(df, finite, fractional if columns is None else set(columns) & fractional)


def fill_value(df: DataFrame, value: float = 0, columns: Sequence[str] | None = None) -> DataFrame:
    chosen = numeric_columns(df) if columns is None else columns
    return df.na.fill(value, subset=list(chosen))


def align_columns(left: DataFrame, right: DataFrame, fill: float = 0, keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Give both frames the sorted union of their columns; absent ones hold ``fill``."""
    union = sorted((set(left.columns) | set(right.columns)) - set(keep))

    def widen(df: DataFrame) -> DataFrame:
        present = set(df.columns)
        return df.select(*keep, *[F.col(c) if c in present else F.lit(fill).alias(c) for c in union])

    return widen(left), widen(right)


def stack_frames(frames: Sequence[DataFrame]) -> DataFrame:
    """Append frames whose columns differ; missing ones become NULL."""
    stacked = frames[0]
    for frame in frames[1:]:
        stacked = stacked.unionByName(frame, allowMissingColumns=True)
    return stacked


def reorder(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*names)


def rows_of_class(df: DataFrame, label: str, value: object) -> DataFrame:
    return df.filter(F.col(label) == F.lit(value))


def row_range(
    df: DataFrame, order: str, start: int, stop: int, group: Sequence[str] = (), ties: Sequence[str] = ()
) -> DataFrame:
    """Rows start <= position < stop in ``order``, positions counted from 0 per group."""
    placed = ordinal(df, order, ties, group, name="_position")
    return placed.filter(F.col("_position").between(start + 1, stop)).drop("_position")
