"""Merkle manifest of a dataset by slot pivot.

Rows are leaves, in order within their group; every ``fanout`` consecutive nodes have a parent.  Conditional aggregates
spread the children of a parent into one column per slot; the concatenated columns hash to the parent, and without the own
slot's column they are the siblings of a child.  One shuffle serves several levels: it spreads ``WIDTH`` nodes at most
and the levels between are hashed column by column.  The groups' roots are leaves of one more tree of the same kind.

Going down again, each spread row gives its children their siblings in front of those of the node above, joined by (group,
place), so no key is hot and no tree passes through one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revpulse.llm.components import cut
from revpulse.llm.sharding import with_rank

WIDTH = 16  # slot columns, unless one parent has more children
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FEW = 10_000  # groups that may be broadcast: 200 bytes each

_PATH = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts, end to end; null parts are left out."""
    return F.sha2(F.concat_ws("", *parts), 256)


def leaf(fields: Sequence[Column]) -> Column:
    """Digest of a row: each field is ``-`` if null, else its length in UTF-8 bytes, ``:`` and its value."""
    said = [c.cast("string") for c in fields]
    return digest(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in said])


def _several(nodes: DataFrame, fanout: int, level: int, steps: int) -> DataFrame:
    """Spread rows of ``nodes`` (tree, n, at, node, own) at ``level``: (tree, n, at of the ancestor ``steps`` up, node of that, children with their paths)."""
    width = fanout ** steps
    slots = [F.max(F.when(F.col("at") % width == i, F.struct("node", "own"))).alias(f"slot{i}") for i in range(width)]
    wide = nodes.groupBy("tree", "n", F.expr(f"at div {width}").alias("above")).agg(*slots)
    wide = wide.withColumns({f"n0_{i}": F.col(f"slot{i}.node") for i in range(width)})
    paths: list[list[Column]] = [[] for _ in range(width)]
    for j in range(steps):
        size = fanout ** (level + j)
        many = F.col("n") > size  # more than one node is left at this level
        parents = {}
        for p in range(width // fanout ** (j + 1)):
            children = [F.col(f"n{j}_{p * fanout + c}") for c in range(fanout)]
            parents[f"n{j + 1}_{p}"] = F.when(children[0].isNotNull(), F.when(many, digest(*children)).otherwise(children[0]))
        for i in range(width):
            own = i // fanout ** j
            run = range(own - own % fanout, own - own % fanout + fanout)
            beside = [F.concat_ws("", *[F.col(f"n{j}_{k}") for k in run if (k < own) == first and k != own]) for first in (True, False)]
            paths[i].append(F.when(many, F.struct(beside[0].alias("before"), beside[1].alias("after"))))
        wide = wide.withColumns(parents)
    kept = [F.when(F.col(f"slot{i}").isNotNull(), F.struct(F.lit(i).alias("slot"), F.col(f"slot{i}.node").alias("node"), F.col(f"slot{i}.own").alias("own"),
                                                           F.array_compact(F.array(*paths[i])).alias("path"))) for i in range(width)]
    return wide.select("tree", "n", F.col("above").alias("at"), F.col(f"n{steps}_0").alias("node"), F.array_compact(F.array(*kept)).alias("children"))


def _climb(nodes: DataFrame, most: int, fanout: int) -> tuple[list[DataFrame], int]:
    """Spread tables from the leaves up to one row per tree, and children per row; ``most`` is the largest tree."""
    steps = 1
    while fanout ** (steps + 1) <= WIDTH:
        steps += 1
    width, level, tables = fanout ** steps, 0, []
    while not tables or most > fanout ** level:
        tables.append(cut(_several(nodes, fanout, level, steps)))
        nodes = tables[-1].select("tree", "n", "at", "node", F.lit(None).cast("int").alias("own"))
        level += steps
    return tables, width


def _descend(tables: list[DataFrame], width: int, above: DataFrame | None = None) -> DataFrame:
    """(tree, n, at, node, own, path, *columns of ``above``) of the leaves; ``above`` has tree, path and more per tree."""
    more = [c for c in above.columns if c not in ("tree", "path")] if above is not None else []
    down, keys = above, ["tree"]
    for table in reversed(tables):
        met = table.withColumn("path", F.array().cast(_PATH)) if down is None else table.join(down, keys)
        met = met.select("tree", "n", "at", F.col("path").alias("upper"), *more, F.explode("children").alias("child"))
        down = met.select("tree", "n", (F.col("at") * width + F.col("child.slot")).alias("at"), F.col("child.node").alias("node"), F.col("child.own").alias("own"),
                          F.concat("child.path", "upper").alias("path"), *more)
        if table is not tables[0]:
            down, keys = down.select("tree", "at", "path", *more), ["tree", "at"]
    return down


def fold(start: Column, path: Column) -> Column:
    """Root that follows from a leaf and its siblings, level by level."""
    return F.aggregate(path, start, lambda node, step: digest(step["before"], node, step["after"]))


def manifest(docs: DataFrame, group: str = "lang", order: str = "doc_id", fields: Sequence[str] = FIELDS, fanout: int = 2,
             changed: Mapping[str, Column] | None = None) -> DataFrame:
    """(order column, leaf, subroot, root, path, claimed): one row per row of ``docs``.

    ``path`` lists, from the leaf to the root, the siblings before and after the own node, each end to end; a node that is
    alone in its run has two empty ones.  ``claimed`` is the leaf with the fields in ``changed`` replaced; fold it along
    ``path`` and compare with ``root`` to verify it.

    Nulls come first in both orders and are marked in the leaf, so null and empty differ.  Rows of one id are ordered by
    their leaves; equal rows are leaves of their own.  Texts enter whole.  An empty table gives no row.  Other columns of
    ``docs`` are ignored; a missing field is an error.
    """
    if fanout < 2:
        raise ValueError("fanout must be 2 or more")
    spark = docs.sparkSession
    changed = changed or {}
    rows = docs.select(F.col(group).alias("grp"), F.col(order).alias("id"), leaf([F.col(f) for f in fields]).alias("leaf"),
                       leaf([changed.get(f, F.col(f)) for f in fields]).alias("claimed") if changed else F.lit(None).cast("string").alias("claimed"))
    ranked, total = with_rank(rows, ["grp", "id", "leaf"])
    groups = cut(ranked.groupBy("grp").agg(F.min("rank").alias("tree"), F.count("*").alias("n")))
    many, most = groups.agg(F.count("*"), F.max("n")).first()
    small = F.broadcast if many <= FEW else (lambda df: df)
    nodes = ranked.join(small(groups), ranked["grp"].eqNullSafe(groups["grp"])).select(
        "tree", "n", (F.col("rank") - F.col("tree")).alias("at"), F.col("leaf").alias("node"), F.struct("id", "claimed").alias("own"))
    if not total:
        empty = spark.createDataFrame([], f"leaf string, subroot string, root string, path {_PATH}, claimed string")
        return empty.select(F.lit(None).cast(docs.schema[order].dataType).alias(order), *empty.columns)
    tables, width = _climb(nodes, most, fanout)
    # The tree over the groups' roots, in the order of the groups.
    placed, _ = with_rank(tables[-1].select("tree", "node"), ["tree"])
    tops, top_width = _climb(placed.select(F.lit(0).cast("long").alias("tree"), F.lit(many).cast("long").alias("n"), F.col("rank").alias("at"), "node", F.struct("tree").alias("own")), many, fanout)
    root = tops[-1].first()["node"]
    above = _descend(tops, top_width).select(F.col("own.tree").alias("tree"), "path", F.col("node").alias("subroot"))
    return _descend(tables, width, above).select(
        F.col("own.id").alias(order), F.col("node").alias("leaf"), "subroot", F.lit(root).alias("root"), "path", F.col("own.claimed").alias("claimed"))
