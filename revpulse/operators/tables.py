"""Keyed table updates as pure transforms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revpulse.plans.per_key import first_per_key


def upsert(
    target: DataFrame, batch: DataFrame, keys: Sequence[str], update_cols: Sequence[str], *,
    newest: Sequence[Column], defaults: dict | None = None,
) -> DataFrame:
    """The target after inserting new keys and overwriting ``update_cols`` of known ones.

    A batch may carry only some columns: the others keep their stored value, and a new key
    gets ``defaults`` for them.  Of several batch rows with one key the first by ``newest``
    counts; an empty list says that
    the batch has one row per key.  Applying the same batch again changes nothing.
    """
    defaults = defaults or {}
    single = first_per_key(batch, keys, list(newest))
    incoming = single.select(
        *keys, *[F.col(c).alias(f"__new_{c}") for c in single.columns if c not in keys], F.lit(True).alias("__given")
    )
    joined = target.withColumn("__known", F.lit(True)).join(incoming, list(keys), "full")
    out = []
    for c in target.columns:
        if c in keys:
            out.append(F.col(c))
            continue
        kind = target.schema[c].dataType
        new = F.col(f"__new_{c}").cast(kind) if f"__new_{c}" in incoming.columns else F.lit(defaults.get(c)).cast(kind)
        replace = F.col("__given").isNotNull() if c in update_cols else F.col("__known").isNull()
        out.append(F.when(replace, new).otherwise(F.col(c)).alias(c))
    return joined.select(*out)


def insert_if_absent(target: DataFrame, batch: DataFrame, keys: Sequence[str], *, first: Sequence[Column] = ()) -> DataFrame:
    """The batch rows to append: those whose key the target does not hold, one per key."""
    return first_per_key(batch, keys, list(first)).join(target.select(*keys), list(keys), "left_anti")
