"""Taxonomy paths, ancestors, descendants, common ancestors and similarity.

A taxonomy is a forest of (id, name, parent). ``paths`` walks it from the roots down, one join per
level, so each node is joined once; everything else is array arithmetic on the path column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.functions.keys import NO_FORM, class_parts, display_name
from quadrat.operators.staging import pin


def paths(nodes: DataFrame) -> DataFrame:
    """(id, name, parent, path, root): ``path`` runs from the root to the node itself."""
    nodes = pin(nodes.select("id", "name", "parent"))
    expected = nodes.count()
    level = pin(nodes.where(F.col("parent").isNull()).select("*", F.array("id").alias("path")))
    found = level.count()
    if expected and not found:
        raise ValueError("The taxonomy has no root.")
    levels, total = [level], found
    while found and total < expected:
        above = level.select(F.col("id").alias("parent"), F.col("path").alias("_above"))
        below = nodes.join(above, "parent").select(
            "id", "name", "parent", F.concat("_above", F.array("id")).alias("path")
        )
        level = pin(below)
        found = level.count()
        levels.append(level)
        total += found
    walked = reduce(DataFrame.unionByName, levels).withColumn("root", F.col("path")[0])
    if total < expected:
        lost = nodes.join(walked.select("id"), "id", "left_anti").limit(3).collect()
        raise ValueError(f"Nodes with an unknown parent or in a cycle: {[r['id'] for r in lost]}")
    return walked


def ancestors(walked: DataFrame) -> DataFrame:
    """(id, position, ancestor), root first, without the node itself."""
    own = walked.select("id", F.slice("path", F.lit(1), F.size("path") - 1).alias("_up"))
    return own.select("id", F.posexplode("_up").alias("position", "ancestor"))


def closure(walked: DataFrame) -> DataFrame:
    """(id, ancestor, distance) including (id, id, 0)."""
    up = walked.select("id", F.posexplode(F.reverse("path")).alias("distance", "ancestor"))
    return up.select("id", "ancestor", "distance")


def descendants(walked: DataFrame) -> DataFrame:
    """(ancestor, id, name, parent, distance), children of a parent by name."""
    below = walked.select(
        "id", "name", "parent", F.posexplode(F.reverse("path")).alias("distance", "ancestor")
    ).where(F.col("distance") > 0)
    return below.select("ancestor", "id", "name", "parent", "distance").orderBy(
        "ancestor", "distance", "parent", "name"
    )


def roots(walked: DataFrame) -> DataFrame:
    names = walked.where(F.col("parent").isNull()).select(
        F.col("id").alias("root"), F.col("name").alias("root_name")
    )
    return walked.select("id", "root").join(names, "root").select("id", "root", "root_name")


def lca(path_a: Column, path_b: Column) -> Column:
    """Last common node of two root-to-node paths; NULL across roots."""
    return F.try_element_at(F.array_intersect(path_a, path_b), F.lit(-1))


def similarity(path_a: Column, path_b: Column) -> Column:
    """Shared depth over the longer path: 1 for the same node, 0 across roots."""
    return F.size(F.array_intersect(path_a, path_b)) / F.greatest(F.size(path_a), F.size(path_b))


def class_list(keys: DataFrame, key: str = "class_id") -> DataFrame:
    """(idx, class_id, attribute_id, form_id) in class order from distinct class keys.

    Pin it (or make it a class table, which is pinned) before joining it to samples.
    """
    distinct = keys.select(F.col(key).alias("class_id")).distinct()
    order = Window.partitionBy(F.lit(0)).orderBy("class_id")
    parts = class_parts("class_id")
    return distinct.select(
        (F.row_number().over(order) - 1).alias("idx"),
        "class_id",
        parts["attribute"].alias("attribute_id"),
        parts["form"].alias("form_id"),
    )


def class_table(classes: DataFrame, walked: DataFrame, form_names: DataFrame | None = None) -> DataFrame:
    """Class list with attribute path, root, root name and display name, pinned.

    A class whose attribute or form is unknown is an error.
    """
    nodes = walked.select(
        F.col("id").alias("attribute_id"), F.col("name").alias("attribute_name"), "path", "root"
    )
    tops = walked.where(F.col("parent").isNull()).select(
        F.col("id").alias("root"), F.col("name").alias("root_name")
    )
    named = classes.join(nodes, "attribute_id", "left").join(tops, "root", "left")
    if form_names is None:
        named = named.withColumn("form_name", F.col("form_id"))
    else:
        forms = form_names.select(F.col("id").alias("form_id"), F.col("name").alias("form_name"))
        named = named.join(forms, "form_id", "left")
    known = F.col("path").isNotNull() & ((F.col("form_id") == NO_FORM) | F.col("form_name").isNotNull())
    table = pin(
        named.select(
            "idx",
            "class_id",
            "attribute_id",
            "form_id",
            "path",
            "root",
            "root_name",
            F.when(F.col("form_id") == NO_FORM, NO_FORM).otherwise(F.col("form_name")).alias("form_name"),
            display_name(F.col("attribute_name"), F.col("form_id"), F.col("form_name")).alias("class_name"),
            known.alias("_known"),
        )
    )
    unknown = table.where(~F.col("_known")).limit(1).collect()
    if unknown:
        raise ValueError(f"Class {unknown[0]['class_id']!r} is not in the taxonomy or form list.")
    return table.drop("_known")


def unresolved_names(names: DataFrame, nodes: DataFrame) -> DataFrame:
    return names.join(nodes.select("name"), "name", "left_anti")


def by_root(samples: DataFrame, classes: DataFrame, *aggs: Column, min_samples: int = 30) -> DataFrame:
    """Aggregates per root category of the true class, categories below ``min_samples`` left out."""
    cats = classes.select(F.col("class_id").alias("gt"), F.col("root_name").alias("category"), "root")
    grouped = (
        samples.join(cats, "gt")
        .groupBy("root", "category")
        .agg(*aggs, F.count(F.lit(1)).alias("n_samples"))
    )
    return grouped.where(F.col("n_samples") >= min_samples)
