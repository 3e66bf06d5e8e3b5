"""Extracted triplets: validation, duplicates, aliases, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lynceus.operators import search
from lynceus.operators.filters import RELATIONS, named_entity, vague
from lynceus.operators.merge import first_by_key


def reject_reason(subject: str = "subject", relation: str = "relation", object_: str = "object") -> Column:
    """Why a triplet isn't valid; null if it is. The relation's case counts."""
    empty = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    return (
        F.when(empty(subject), "empty subject").when(empty(object_), "empty object")
        .when(~F.coalesce(F.col(relation), F.lit("")).isin(*RELATIONS), "relation")
        .when(vague(F.col(subject)), "vague subject").when(vague(F.col(object_)), "vague object")
    )


def validate(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejected ones with their reason."""
    marked = rows.withColumn("reason", reject_reason())
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def rejection_rate(rows: DataFrame) -> DataFrame:
    return rows.withColumn("reason", reject_reason()).agg(F.count("*").alias("n"), F.count_if(F.col("reason").isNotNull()).alias("rejected"), F.round(F.coalesce(F.try_divide(F.count_if(F.col("reason").isNotNull()), F.count("*")), F.lit(0.0)), 6).alias("rate"))


def first_of_each(rows: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Triplets without repeats: case counts in the relation only, the first one stays."""
    keyed = rows.withColumn("_s", F.lower(F.trim("subject"))).withColumn("_o", F.lower(F.trim("object")))
    return first_by_key(keyed, ["_s", "relation", "_o"], [F.col(ordinal)]).drop("_s", "_o")


def numbered(rows: DataFrame, parent: str, order: str, into: str = "triplet_id", width: int = 3) -> DataFrame:
    """Ids ``parent_000``, ``parent_001``, ... in order."""
    n = F.row_number().over(Window.partitionBy(parent).orderBy(order)) - 1
    return rows.withColumn(into, F.concat(F.col(parent), F.lit("_"), F.lpad(n.cast("string"), F.lit(width), F.lit("0"))))


def without_repeats(rows: DataFrame, id_col: str = "triplet_id", *key: str) -> DataFrame:
    """Of rows that are equal in ``key`` the one with the least id."""
    key = key or ("advisory_id", "subject", "relation", "object")
    return rows.join(rows.groupBy(*key).agg(F.min(id_col).alias(id_col)).select(id_col), id_col, "left_semi")


def entity_names(rows: DataFrame) -> DataFrame:
    """Subjects and objects, trimmed, each once."""
    names = rows.select(F.trim("subject").alias("name")).unionByName(rows.select(F.trim("object").alias("name")))
    return names.where("name <> ''").distinct()


def alias_pairs(entities: DataFrame, least: float, *, name_col: str = "name", vector_col: str = "vector") -> DataFrame:
    """Similar named entities to be judged, most similar first."""
    named = entities.where(named_entity(F.col(name_col)))
    return search.similar_pairs(named, least, id_col=name_col, vector_col=vector_col).orderBy(F.col("score").desc(), "a", "b")


def approve(pairs: DataFrame) -> DataFrame:
    """``alias_name, canonical_name, entity_type`` of judged pairs ``a, b, score, same, canonical, type_a, type_b``.

    The alias is the name that isn't canonical, ``a`` if neither is. Each alias
    is decided by its most similar pair.
    """
    good = pairs.where("same")
    rows = good.select(
        F.when(F.col("canonical") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("alias_name"),
        F.col("canonical").alias("canonical_name"),
        F.when(F.col("canonical") == F.col("a"), F.col("type_a")).otherwise(F.col("type_b")).alias("entity_type"),
        "score",
    )
    return first_by_key(rows, ["alias_name"], [F.col("score").desc(), F.col("canonical_name")]).drop("score")


def one_alias_each(aliases: DataFrame) -> DataFrame:
    """Aliases that differ only in case become one, the least."""
    return first_by_key(aliases.withColumn("_low", F.lower("alias_name")), ["_low"], [F.col("alias_name")])


def apply_aliases(rows: DataFrame, aliases: DataFrame, columns: tuple[str, ...] = ("subject", "object")) -> DataFrame:
    """Names replaced by their canonical ones, in one pass and without regard to case.

    The alias table is left to the planner: it broadcasts a small one.
    """
    names = one_alias_each(aliases).select("_low", F.col("canonical_name").alias("_canonical"))
    order = rows.columns
    for column in columns:
        rows = rows.join(names, F.lower(F.col(column)) == F.col("_low"), "left").withColumn(column, F.coalesce("_canonical", column)).drop("_low", "_canonical")
    return rows.select(*order)


def alias_leaks(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """Triplets that still hold an alias; empty after ``apply_aliases`` unless aliases are chained."""
    names = one_alias_each(aliases).where("lower(alias_name) <> lower(canonical_name)").select("_low", "alias_name")
    hit = lambda c: rows.join(names, F.lower(F.col(c)) == F.col("_low")).select("triplet_id", "alias_name")
    return hit("subject").unionByName(hit("object")).distinct()


def demonstrations(targets: DataFrame, pool: DataFrame, k: int = 4, *, id_col: str, vector_col: str) -> DataFrame:
    """The ``k`` most similar rows of the pool for every target, itself excluded."""
    return search.nearest(targets.select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("vector")), pool, k, id_col=id_col, vector_col=vector_col, exclude_self=True)


def verified(rounds: DataFrame, *verdicts: str) -> DataFrame:
    """Rows that every round of verification found valid."""
    keep = F.lit(True)
    for v in verdicts:
        keep = keep & F.coalesce(F.col(v), F.lit(False))
    return rounds.where(keep)
