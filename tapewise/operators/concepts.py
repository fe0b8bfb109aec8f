"""Queries over signal columns by concept and role, and discovery of such columns from the schema."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.draws import drawn
from .frames import last, windowed

PRICES = ("symbol", "ts", "open", "high", "low", "close", "volume", "bar_no", "chunk", "chunk_len")
HELD = 20


def flag_columns(df: DataFrame) -> list[str]:
    """Boolean columns other than prices and keys; the schema tells, nothing is read."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.BooleanType) and f.name not in PRICES]


def numeric_flags(df: DataFrame) -> list[str]:
    """Numeric columns that hold only 0, 1 and null; one aggregate over all candidates."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in PRICES]
    if not names:
        return []
    odd = df.agg(*[F.max((~F.col(c).isin(0, 1)).cast("int")).alias(c) for c in names]).first()
    return [c for c in names if not odd[c]]


def zone_prefixes(df: DataFrame) -> list[str]:
    """Prefixes with a bull zone: {p}_bull, {p}_bull_high, {p}_bull_low and {p}_bull_filled."""
    names = set(df.columns)
    return sorted(c[: -len("_bull")] for c in names if c.endswith("_bull") and {f"{c}_high", f"{c}_low", f"{c}_filled"} <= names)


def level_columns(df: DataFrame) -> list[str]:
    """Numeric *_high and *_low columns that are neither prices nor zone bounds."""
    zones = tuple(f"{p}_{s}_" for p in zone_prefixes(df) for s in ("bull", "bear"))
    return [f.name for f in df.schema if f.name.endswith(("_high", "_low")) and isinstance(f.dataType, T.NumericType) and not (zones and f.name.startswith(zones))]


def concept_mask(df: DataFrame, concept: str, columns: Mapping[str, Sequence[str]]) -> Column | None:
    """Any of the concept's columns that are there, else the column of its name, else None."""
    names = [c for c in columns.get(concept, ()) if c in df.columns] or ([concept] if concept in df.columns else [])
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c).cast("boolean"), F.lit(False)) for c in names]) if names else None


def role_query(df: DataFrame, columns: Mapping[str, Sequence[str]], entry: Sequence[str], zone: Sequence[str] = (), context: Sequence[str] = (), timing: Sequence[str] = (), held: int = HELD) -> DataFrame:
    """Bars at which any entry concept was true within the last ``held`` bars, any zone is true, and every context and timing concept is.

    Unknown concepts are ignored; without a known entry concept nothing qualifies.
    """
    masks = lambda names: [m for m in (concept_mask(df, c, columns) for c in names) if m is not None]
    entries, zones, must = masks(entry), masks(zone), masks([*context, *timing])
    if not entries:
        return df.limit(0)
    flags = {f"_e{i}": m for i, m in enumerate(entries)}
    marked = df.withColumns(flags)
    lasting = windowed(marked, lambda b: b.withColumns({c: F.max(F.col(c).cast("int")).over(last(held)) == 1 for c in flags}), back=held)
    wanted = reduce(lambda a, b: a | b, [F.col(c) for c in flags])
    if zones:
        wanted = wanted & reduce(lambda a, b: a | b, zones)
    for m in must:
        wanted = wanted & m
    return lasting.where(wanted).drop(*flags)


def any_query(df: DataFrame, concepts: Sequence[str], columns: Mapping[str, Sequence[str]], every: bool = False) -> DataFrame:
    """Bars at which any (or every) known concept is true; none known: none."""
    masks = [m for m in (concept_mask(df, c, columns) for c in concepts) if m is not None]
    if not masks:
        return df.limit(0)
    return df.where(reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), masks))


def sampled(events: DataFrame, key: Sequence[str], by: Sequence[str], most: int, seed: int = 0) -> DataFrame:
    """At most ``most`` events of each group, drawn by their key: the same ones however the data are partitioned. Each task keeps its own ``most`` before the shuffle."""
    order = Window.partitionBy(*by).orderBy(drawn(seed, *key), *key)
    return events.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most).drop("_k")
