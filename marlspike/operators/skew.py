"""Per-key results although a few keys hold most rows.

The operators never bring the rows of a key together: inputs are reduced to
one compact state per key inside each map task, only states are shuffled and
joined, and join results are computed from them algebraically.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlspike.session import durable


def key_states(
    rows: DataFrame, keys: list[str], sums: dict[str, Column] | None = None, weight: str | None = None
) -> DataFrame:
    """One state per key: ``n`` rows and, per entry of ``sums``, the sum of a column.

    A sum over nulls only is null, as in SQL. Null keys form a key of their own.
    ``weight`` names a column that says how many rows a row stands for; states
    can so be rolled up to coarser states.
    """
    rows_held = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return rows.groupBy(*keys).agg(rows_held.alias("n"), *[F.sum(c).alias(k) for k, c in (sums or {}).items()])


def _times(states: DataFrame, name: str, n: Column) -> Column:
    """A sum taken ``n`` times. Decimals get room for the product, so none of their digits is lost to Spark's rule."""
    kind = states.schema[name].dataType
    if isinstance(kind, T.DecimalType):
        return F.col(name).try_cast(T.DecimalType(27, min(kind.scale, 9))) * n.try_cast(T.DecimalType(10, 0))
    return F.col(name) * n


def eager_join_totals(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_sums: dict[str, Column] | None = None,
    right_sums: dict[str, Column] | None = None,
    by: list[str] | None = None,
    roll_up: list[str] | None = None,
    how: str = "inner",
    weight: str | None = None,
) -> DataFrame:
    """Totals of ``left JOIN right USING (keys)`` without making the join.

    Both sides become states (``key_states``), the left one per ``keys`` and
    ``by`` (further left columns to keep apart), the right one per ``keys``.
    States are joined, so n left and m right rows of a key meet as one row with
    one row. Their join has n*m rows, in which every left value stands m times
    and every right value n times: ``pairs`` is n*m, a left sum counts m times,
    a right sum n times; ``left_rows`` is n and ``right_rows`` m. With
    ``roll_up`` (columns out of ``keys`` and ``by``) these are summed up further.

    ``how`` is 'inner' or 'left'; with 'left' a key without partner counts each
    left row once, with null right sums and no right rows. Null keys match
    nothing. Equal names on both sides don't clash: only keys and the named sums
    come out. ``weight``: both inputs are states already, with their number of
    rows in that column; sums are then not weighted again. Decimal sums come out
    exact to 9 places; one of 10^18 or more, and one with 10^10 partners or more,
    is null.
    """
    left_sums, right_sums, by = left_sums or {}, right_sums or {}, by or []
    a = key_states(left, [*keys, *by], {f"l_{k}": c for k, c in left_sums.items()}, weight).withColumnRenamed("n", "l_n")
    b = key_states(right, keys, {f"r_{k}": c for k, c in right_sums.items()}, weight).withColumnRenamed("n", "r_n")
    times = F.coalesce(F.col("r_n"), F.lit(1))
    per_key = a.join(b, keys, how).select(
        *keys,
        *by,
        (F.col("l_n") * times).alias("pairs"),
        F.col("l_n").alias("left_rows"),
        F.coalesce(F.col("r_n"), F.lit(0)).alias("right_rows"),
        *[_times(a, f"l_{k}", times).alias(k) for k in left_sums],
        *[_times(b, f"r_{k}", F.col("l_n")).alias(k) for k in right_sums],
    )
    if roll_up is None:
        return per_key
    measures = ["pairs", "left_rows", "right_rows", *left_sums, *right_sums]
    return per_key.groupBy(*roll_up).agg(*[F.sum(k).alias(k) for k in measures])


def heavy_keys(rows: DataFrame, group: str, key: str, share: float) -> DataFrame:
    """(``group``, ``key``, n, total) of non-null keys that hold at least ``share`` of their group's rows.

    Null keys count in the total. This is the eager join of the rows with
    themselves on ``group``: per (group, key) states on the left, per group on
    the right, both rolled up from one pass over the rows. ``group`` tells apart
    a handful of inputs (tables), so the right side has a handful of rows.
    """
    # read by both sides: one row per key, so the rows themselves are read once
    states = durable(key_states(rows, [group, key]), "states")
    joined = eager_join_totals(states, states, [group], by=[key], weight="n")
    return joined.filter(
        F.col(key).isNotNull() & (F.col("left_rows") >= F.lit(share) * F.col("right_rows"))
    ).select(group, key, F.col("left_rows").alias("n"), F.col("right_rows").alias("total"))


def salted_states(rows: DataFrame, keys: list[str], aggs: list[Column], merges: list[Column], salts: int = 32) -> DataFrame:
    """Two-level aggregation for aggregates without a small partial state (e.g. ``collect_set``).

    Rows of a key are spread over ``salts`` sub-keys by the hash of the whole
    row, aggregated there, and the sub-results merged.
    """
    spread = F.pmod(F.xxhash64(*rows.columns), F.lit(salts))
    return rows.groupBy(*keys, spread.alias("__salt")).agg(*aggs).groupBy(*keys).agg(*merges)
