"""Lineages: forests of merging objects, ids written as dotted paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parent(lineage: Column) -> Column:
    """a path without its last step; empty at a root."""
    return F.regexp_replace(lineage, r"\.?[^.]*$", "")


def dotted_prefixes(lineage: Column) -> Column:
    """The path and all its ancestors' paths."""
    steps = F.split(lineage, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "."))


def roots(df: DataFrame, label: str, lineage: str, strict: bool = False) -> DataFrame:
    """Paths of a label that no other one is a prefix of, as strings (so "10" counts as below "1"); with `strict` as paths. Prefixes are exploded and matched by equality, so nothing is compared pairwise."""
    ids = df.select(label, lineage).where(F.col(lineage).isNotNull()).distinct()
    n = F.char_length(lineage)
    strings = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.substr(F.col(lineage), F.lit(1), k)))
    above = F.filter(dotted_prefixes(F.col(lineage)), lambda p: p != F.col(lineage)) if strict else strings
    prefix = ids.withColumn("_p", F.explode(above))
    below = prefix.join(ids.select(label, F.col(lineage).alias("_p")), [label, "_p"], "left_semi").select(label, lineage).distinct()
    return ids.join(below, [label, lineage], "left_anti")


def descendants(df: DataFrame, root: DataFrame, label: str, lineage: str) -> DataFrame:
    """Rows under each root, the root's own among them; column `root`."""
    up = df.withColumn("root", F.explode(dotted_prefixes(F.col(lineage))))
    return up.join(root.select(label, F.col(lineage).alias("root")), [label, "root"], "left_semi")


def rolled_up(df: DataFrame, label: str, lineage: str, bin_: str, order: Sequence[str], sums: Sequence[str], firsts: Sequence[str], strict: bool = False) -> DataFrame:
    """A2: sums over all descendants of a root in a time bin, and the first row's other columns. A sum of missing values alone is 0."""
    d = descendants(df, roots(df, label, lineage, strict), label, lineage)
    key = F.struct(*order)
    clean = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    return d.groupBy(label, "root", bin_).agg(*[F.coalesce(F.sum(clean(c)), F.lit(0.0)).alias(c) for c in sums], *[F.min_by(c, key).alias(c) for c in firsts])


def vanished(df: DataFrame, label: str, name: str, order: str) -> DataFrame:
    """The last row of each name that no other name of the label extends."""
    lone = roots_of_names(df, label, name)
    last = df.groupBy(label, name).agg(F.max(order).alias(order))
    return last.join(lone, [label, name], "left_semi")


def roots_of_names(df: DataFrame, label: str, name: str) -> DataFrame:
    """Names that are not a proper prefix of another name of the label."""
    ids = df.select(label, name).where(F.col(name).isNotNull()).distinct()
    n = F.char_length(name)
    prefix = ids.select(label, F.explode(F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.substr(F.col(name), F.lit(1), k)))).alias(name)).distinct()
    return ids.join(prefix, [label, name], "left_anti")


def child_number(existing: list[str], origin: str) -> str:
    """The next id below `origin` ('' for a root)."""
    depth = origin.count(".") + 1 if origin else 0
    n = sum(1 for e in existing if e.count(".") == depth and (not origin or e.startswith(origin + ".")))
    return f"{origin}.{n}" if origin else str(n)


def fold(counts: Sequence[int], look) -> tuple[list[list[int]], list[str], dict[int, str]]:
    """Spec of the lineage fold over a label's frames, backwards in time. counts: objects in each frame. look(t, ids of frame t + 1) gives, for the objects of frame t, the id painted there or -1. Ids exist for all frames but the last. Returns ids by frame, paths by id, names by id."""
    paths: list[str] = []
    by_frame: list[list[int]] = [[] for _ in range(max(len(counts) - 1, 0))]
    after: list[int] = [-1] * (counts[-1] if counts else 0)
    for t in range(len(counts) - 2, -1, -1):
        ids = list(look(t, after))
        for i, x in enumerate(ids):
            if x < 0:
                paths.append(child_number(paths, ""))
                ids[i] = len(paths) - 1
        shared = sorted({x for x in ids if ids.count(x) > 1})
        for x in shared:
            for i in [i for i, y in enumerate(ids) if y == x]:
                paths.append(child_number(paths, paths[x]))
                ids[i] = len(paths) - 1
        by_frame[t] = ids
        after = ids
    n = len(paths)
    return by_frame, paths, {i: str(n - 1 - i) for i in range(n)}


def numbered_children(df: DataFrame, label: str, parent_: str, id_: str) -> DataFrame:
    """`child` numbers a parent's children from 0 by ascending id; `path` is the parent before that number."""
    w = Window.partitionBy(label, parent_).orderBy(id_)
    return df.withColumn("child", F.row_number().over(w) - 1).withColumn("path", F.concat_ws(".", F.col(parent_).cast("string"), F.col("child").cast("string")))
