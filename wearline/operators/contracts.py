"""Data contracts as column predicates: violations, accept/quarantine, coercion."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from wearline.functions.columns import require_columns
from wearline.operators.ordered import ROWS_PER_BUCKET, shifted
from wearline.operators.tiles import Signals

# The air-compressor channels, their closed physical ranges, and the states.
COMPRESSOR_RANGES: dict[str, tuple[float, float]] = {
    "TP2": (-1.0, 12.0),
    "TP3": (-1.0, 12.0),
    "H1": (-1.0, 12.0),
    "DV_pressure": (-1.0, 12.0),
    "Reservoirs": (-1.0, 12.0),
    "Oil_temperature": (-10.0, 120.0),
    "Motor_current": (-1.0, 12.0),
}
COMPRESSOR_STATES = (
    "COMP",
    "DV_eletric",
    "Towers",
    "MPG",
    "LPS",
    "Pressure_switch",
    "Oil_level",
    "Caudal_impulses",
)
COMPRESSOR_SIGNALS = Signals(tuple(COMPRESSOR_RANGES), COMPRESSOR_STATES)


@dataclass(frozen=True)
class Check:
    """One rule: the row is good where ``ok`` is true; unknown counts as bad."""

    column: str
    rule: str
    ok: Column

    @property
    def bad(self) -> Column:
        return ~F.coalesce(self.ok, F.lit(False))


def _present(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value)


def _signal_rules(
    ranges: Mapping[str, tuple[float, float]], states: Sequence[str]
) -> list[tuple[str, str, Callable[[Column], Column]]]:
    """(signal, rule, test of its value); a missing value breaks ``not_null`` only."""

    def inside(low: float, high: float) -> Callable[[Column], Column]:
        return lambda value: ~_present(value) | value.between(low, high)

    rules: list[tuple[str, str, Callable[[Column], Column]]] = []
    for name, (low, high) in ranges.items():
        rules += [(name, "not_null", _present), (name, "in_range", inside(low, high))]
    for name in states:
        binary = lambda value: ~_present(value) | value.isin(0.0, 1.0)
        rules += [(name, "not_null", _present), (name, "binary", binary)]
    return rules


def telemetry_contract(
    ranges: Mapping[str, tuple[float, float]] = COMPRESSOR_RANGES,
    states: Sequence[str] = COMPRESSOR_STATES,
    *,
    ts: str = "ts",
) -> list[Check]:
    """Time present, analogs present and in range, states present and 0 or 1."""
    timed = Check(ts, "not_null", F.col(ts).isNotNull())
    signals = [
        Check(name, rule, test(F.col(name).cast("double")))
        for name, rule, test in _signal_rules(ranges, states)
    ]
    return [timed, *signals]


def lifetime_contract() -> list[Check]:
    """Capacity not below 0 (0 = unknown), model and dates present, failed 0 or 1, and no
    negative lifetime."""
    present = [Check(c, "not_null", F.col(c).isNotNull()) for c in ("model", "min_date", "max_date")]
    dates = F.col("max_date") >= F.col("min_date")
    return [
        Check("capacity_tb", "not_negative", F.col("capacity_tb") >= 0),
        *present,
        Check("failed", "binary", F.col("failed").isin(0, 1)),
        Check("max_date", "not_before_min_date", dates | F.col("max_date").isNull() | F.col("min_date").isNull()),
    ]


def violations(
    df: DataFrame, contract: Sequence[Check], *, ident: Sequence[str] = (), lazy: bool = True
) -> DataFrame:
    """One row per broken rule and input row, with the offending value as text.

    ``lazy=False`` stops at the first violation found.
    """
    require_columns(df, sorted({c.column for c in contract}))
    found = [
        F.when(
            c.bad,
            F.struct(
                F.lit(c.column).alias("column"),
                F.lit(c.rule).alias("rule"),
                F.col(c.column).cast("string").alias("value"),
            ),
        )
        for c in contract
    ]
    out = df.select(*ident, F.inline(F.array_compact(F.array(*found))))
    return out if lazy else out.limit(1)


def violation_counts(df: DataFrame, contract: Sequence[Check]) -> DataFrame:
    """Broken rules with their number of rows, in one aggregation without row output."""
    require_columns(df, sorted({c.column for c in contract}))
    counts = df.agg(*[F.count_if(c.bad).alias(f"_{i}") for i, c in enumerate(contract)])
    rows = [
        F.struct(
            F.lit(c.column).alias("column"), F.lit(c.rule).alias("rule"), F.col(f"_{i}").alias("rows")
        )
        for i, c in enumerate(contract)
    ]
    return counts.select(F.inline(F.array(*rows))).where(F.col("rows") > 0)


def is_valid(contract: Sequence[Check]) -> Column:
    ok = F.lit(True)
    for c in contract:
        ok = ok & ~c.bad
    return ok


def split_valid(df: DataFrame, contract: Sequence[Check]) -> tuple[DataFrame, DataFrame]:
    """Accepted and quarantined rows."""
    ok = is_valid(contract)
    return df.where(ok), df.where(~ok)


def time_order_violations(
    df: DataFrame,
    ts: str,
    seq: str,
    keys: Sequence[str] = (),
    *,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Rows earlier than the row before them in arrival order (``seq``, unique per key)."""
    near = shifted(
        df.select(*keys, seq, ts), [seq], {"previous": (ts, -1)}, keys, rows_per_bucket=rows_per_bucket
    )
    return near.where(F.col("previous") > F.col(ts))


def coerce(df: DataFrame, schema: T.StructType) -> tuple[DataFrame, list[Check]]:
    """Cast to the declared types, and the rules that name failed casts.

    Raw values stay in ``_raw_<column>`` so that a failed cast shows what was there. All
    missing columns are named in one error; further columns pass through.
    """
    require_columns(df, schema.fieldNames())
    rest = [c for c in df.columns if c not in schema.fieldNames()]
    cast = [F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields]
    raw = [F.col(f.name).alias(f"_raw_{f.name}") for f in schema.fields]
    checks = [
        Check(
            f"_raw_{f.name}",
            f"castable_to_{f.dataType.simpleString()}",
            F.col(f"_raw_{f.name}").isNull() | F.col(f.name).isNotNull(),
        )
        for f in schema.fields
    ]
    return df.select(*rest, *cast, *raw), checks


def request_contract(
    df: DataFrame,
    ranges: Mapping[str, tuple[float, float]] = COMPRESSOR_RANGES,
    states: Sequence[str] = COMPRESSOR_STATES,
    *,
    readings: str = "readings",
) -> DataFrame:
    """Add ``accepted`` and ``reasons``: a request needs readings and every one in contract."""
    cells, reasons = F.col(readings), []

    def breaks(name: str, test: Callable[[Column], Column]):
        return lambda reading: ~test(reading[name].cast("double"))

    for name, rule, test in _signal_rules(ranges, states):
        any_bad = F.coalesce(F.exists(cells, breaks(name, test)), F.lit(False))
        reasons.append(F.when(any_bad, F.lit(f"{name}:{rule}")))
    empty = F.coalesce(F.size(cells) <= 0, F.lit(True)) | cells.isNull()
    reasons.append(F.when(empty, F.lit("readings:not_empty")))
    listed = df.withColumn("reasons", F.array_compact(F.array(*reasons)))
    return listed.withColumn("accepted", F.size("reasons") == 0)

