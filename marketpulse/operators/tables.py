"""Keyed table maintenance: high-water marks, insert-if-absent, upsert,
cascade delete, keyed update (A1, A2, J3–J7, W10, X2, X3, S10).

Plain Parquet tables have no MERGE or UPDATE, so each operator is a pure
function ``(target, batch) -> rows``; the sink writes the new snapshot (see
``marketpulse.sources.sinks``).  Every operator is a join or aggregate on the
table key, so it partitions on that key; the batch-side folds are
map-side-combined aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType


def max_per_key(df: DataFrame, by: Sequence[str], ts: str, alias: str = "max_ts") -> DataFrame:
    """A1: latest timestamp per key."""
    return df.groupBy(*by).agg(F.max(ts).alias(alias))


def global_max(df: DataFrame, ts: str, alias: str = "max_ts") -> DataFrame:
    """A2: latest timestamp of the whole table (one row)."""
    return df.agg(F.max(ts).alias(alias))


def newer_than(batch: DataFrame, target: DataFrame, ts: str, target_ts: str | None = None,
               by: Sequence[str] | None = None, inclusive: bool = False) -> DataFrame:
    """Keep batch rows strictly later than the target's maximum.

    Per key when ``by`` is given (the per-key maxima are one row per key and
    joined on the key), otherwise against the global maximum as a scalar
    subquery.  An empty target keeps everything; once the target has rows a
    batch row with a null time is dropped.  ``inclusive`` keeps rows equal
    to the maximum (safe only when the write that follows is keyed).
    """
    target_ts = target_ts or ts
    cmp = (lambda a, b: a >= b) if inclusive else (lambda a, b: a > b)
    if by:
        mx = target.groupBy(*by).agg(F.max(target_ts).alias("_mx"))
        j = batch.join(mx, on=list(by), how="left")
        return j.where(F.col("_mx").isNull() | cmp(F.col(ts), F.col("_mx"))).drop("_mx")
    mx = target.agg(F.max(target_ts)).scalar()
    return batch.where(mx.isNull() | F.coalesce(cmp(F.col(ts), mx), F.lit(False)))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in the given order.

    ``row_number() = 1`` over (keys) — Spark plans it with a WindowGroupLimit
    below the exchange, so at most one row per key per task is shuffled.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def insert_absent(target: DataFrame, batch: DataFrame, keys: Sequence[str],
                  order: Sequence[str]) -> DataFrame:
    """Rows of ``batch`` to insert under ON CONFLICT DO NOTHING.

    The first batch row per key (in ``order``) is the candidate; a key already
    in the target keeps the target's row.
    """
    first = first_per_key(batch, keys, order)
    return first.join(target.select(*keys), on=list(keys), how="left_anti")


def append_rows(target: DataFrame, new: DataFrame) -> DataFrame:
    """The table after appending ``new`` (columns matched by name)."""
    return target.unionByName(new, allowMissingColumns=True)


def upsert(target: DataFrame, batch: DataFrame, key: str, order: str,
           update_cols: Sequence[str]) -> DataFrame:
    """Insert new keys with all columns; for existing keys update only
    ``update_cols``.  Duplicate keys inside the batch: the first row (by
    ``order``) supplies the inserted columns, the last row supplies
    ``update_cols`` — the result of applying the rows one at a time.

    Returns the new table.  The batch fold is one aggregate on ``key``; the
    merge is one full outer join on ``key``.
    """
    cols = [c for c in target.columns]
    ins_cols = [c for c in cols if c != key and c in batch.columns and c not in update_cols]
    fold = batch.groupBy(key).agg(
        *[F.min_by(F.col(c), F.col(order)).alias(c) for c in ins_cols],
        F.max_by(F.struct(*[F.col(c) for c in update_cols]), F.col(order)).alias("_upd"))
    t = target.alias("t")
    b = fold.alias("b")
    j = t.join(b, F.col(f"t.{key}") == F.col(f"b.{key}"), "full_outer")
    out = []
    for c in cols:
        if c == key:
            out.append(F.coalesce(F.col(f"t.{key}"), F.col(f"b.{key}")).alias(key))
        elif c in update_cols:
            out.append(F.when(F.col(f"b.{key}").isNotNull(), F.col(f"b._upd.{c}"))
                        .otherwise(F.col(f"t.{c}")).alias(c))
        elif c in ins_cols:
            out.append(F.when(F.col(f"t.{key}").isNotNull(), F.col(f"t.{c}"))
                        .otherwise(F.col(f"b.{c}")).alias(c))
        else:
            out.append(F.col(f"t.{c}").alias(c))
    return j.select(*out)


def delete_cascade(parent: DataFrame, child: DataFrame, ids: DataFrame, parent_key: str,
                   child_fk: str, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """Remove the given parents and every child that references them."""
    gone = ids.select(F.col(id_col).alias("_gone"))
    return (parent.join(gone, F.col(parent_key) == F.col("_gone"), "left_anti"),
            child.join(gone, F.col(child_fk) == F.col("_gone"), "left_anti"))


def keyed_update(target: DataFrame, changes: DataFrame, key: str, col: str, order: str,
                 new_col: str = "new_value") -> DataFrame:
    """Set ``col`` from ``changes`` where the key matches; unknown keys
    change nothing.  Of several changes of a key the last (by ``order``) wins,
    so a key stays one row.
    """
    ch = (changes.groupBy(key).agg(F.max_by(F.col(new_col), F.col(order)).alias("_new"))
                 .withColumn("_hit", F.lit(True)))
    j = target.join(ch, on=key, how="left")
    return j.withColumn(col, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(col)))\
            .select(*target.columns)


def ensure_columns(df: DataFrame, columns: dict[str, DataType | str]) -> DataFrame:
    """Add each absent column as nulls of its type (existing ones kept)."""
    out = df
    for name, t in columns.items():
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(t))
    return out


def title_exists(table: DataFrame, titles: DataFrame, col: str = "title") -> DataFrame:
    """A3: each asked title with ``exists`` = the table has a row with it."""
    have = table.select(F.col(col).alias("_t")).distinct().withColumn("_e", F.lit(True))
    j = titles.select(col).join(have, F.col(col) == F.col("_t"), "left")
    return j.select(col, F.coalesce(F.col("_e"), F.lit(False)).alias("exists"))
