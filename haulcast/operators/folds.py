"""Hold-out tags and folds that depend on keys only.

A fold is a function of the row's (or entity's) key, so it survives
repartitioning, retries and reordering, and needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulcast.functions.values import hash_bucket
from haulcast.operators.keyed import KeyedTable, ranked
from haulcast.session import materialise


def assign_holdout(df: DataFrame, key: str, percent: int = 20, seed: int | str = 42,
                   out: str = "is_holdout") -> DataFrame:
    """Tag about ``percent`` of the rows for validation."""
    return df.withColumn(out, hash_bucket(F.col(key), seed, 100) < percent)


def assign_folds(df: DataFrame, key: str, k: int = 5, seed: int | str = 42, out: str = "fold") -> DataFrame:
    """Fold 0..k-1 by row key; another seed gives independent inner folds."""
    return df.withColumn(out, hash_bucket(F.col(key), seed, k))


def assign_group_folds(df: DataFrame, entity: str, k: int = 5, seed: int | str = 42, balance: bool = False,
                       out: str = "fold") -> DataFrame:
    """Fold by entity: the rows of an entity share a fold.

    With ``balance`` the folds come out with similar row counts, as far as the
    largest entities allow.
    """
    if not balance:
        return df.withColumn(out, hash_bucket(F.col(entity), seed, k))
    return balanced_fold_table(df, entity, k, out).attach(df)


def balanced_fold_table(df: DataFrame, entity: str, k: int, out: str = "fold") -> KeyedTable:
    """Fold per entity.

    Entities larger than half a fold are placed one by one, largest first, in the
    emptiest fold; there are fewer than 2k of them. If there are any, the others
    fill the room that is left in proportion; if not, all are dealt out by
    descending size.
    """
    sizes = materialise(df.filter(F.col(entity).isNotNull()).groupBy(entity).agg(F.count("*").alias("_rows")), "sizes")
    total = sizes.agg(F.sum("_rows")).first()[0] or 0
    large = F.col("_rows") * 2 * k > total
    giants = sizes.filter(large).orderBy(F.desc("_rows"), F.asc(entity)).collect()
    if giants:
        load, placed = [0] * k, {}
        for row in giants:
            placed[row[entity]] = load.index(min(load))
            load[placed[row[entity]]] += row["_rows"]
        fold = F.when(large, _literal_map(placed)[F.col(entity)]).otherwise(_fill(F.col(entity), load, total))
        table = sizes.withColumn(out, fold.cast("int"))
    else:
        order = ranked(sizes, [F.desc("_rows"), F.asc(entity)], "entity-order", "_rank")
        step = F.col("_rank") % (2 * k)
        table = order.select(entity, "_rows", F.when(step < k, step).otherwise(2 * k - 1 - step).cast("int").alias(out))
    return KeyedTable.of(materialise(table, "folds"), entity, "_rows")


def _literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _fill(entity: Column, load: list[int], total: int) -> Column:
    """Fold by hash, each fold as likely as it has room below the common level."""
    level = _level(load, total)
    share = hash_bucket(entity, "fill", 1_000_000) / 1_000_000 * max(total - sum(load), 1)
    fold, start = F.lit(len(load) - 1), 0.0
    steps = []
    for f, used in enumerate(load):
        start += max(level - used, 0.0)
        steps.append((f, start))
    for f, stop in reversed(steps[:-1]):
        fold = F.when(share < stop, f).otherwise(fold)
    return fold


def _level(load: list[int], total: int) -> float:
    """Row count that the folds below it reach when the remaining rows are spread over them."""
    spare, filled = total - sum(load), sorted(load)
    for n in range(len(filled), 0, -1):
        level = (spare + sum(filled[:n])) / n
        if level >= filled[n - 1]:
            return level
    return float(filled[0])


def straddling_entities(df: DataFrame, entity: str, fold: str = "fold") -> DataFrame:
    """One row: number of entities, and how many of them occur in more than one fold."""
    per_entity = df.groupBy(entity).agg(F.min(fold).alias("lo"), F.max(fold).alias("hi"))
    return per_entity.agg(F.count("*").alias("entities"),
                          F.count_if(F.col("lo") != F.col("hi")).alias("straddling_entities"))
