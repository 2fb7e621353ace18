"""Imports put into a table by falling keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upserted(base: DataFrame, changes: DataFrame, scope: list[str], keys: list[list[str]], id_col: str, replace: Column) -> DataFrame:
    """All rows of base and changes with `fate`: inserted, replaced (by the change that has its `target`), kept, replacing or ignored.

    A change and a row of base are of one product if, in the same scope, they
    are equal in the first of `keys` that both have whole. Of the rows that a
    change meets the one by the earliest key and least id is its target; of the
    changes of one target, and of new ones of the same first key, the least id
    acts, others are ignored. `replace` is a condition over the structs
    `old` and `new` of the two rows; without it the row stays and the change is ignored.
    Inserted, replacing and ignored changes are all changes; kept and replaced rows are all of base.
    """

    def keyed(df: DataFrame) -> DataFrame:
        whole = lambda cols: F.when(F.expr(" and ".join(f"`{c}` is not null" for c in cols)), F.to_json(F.struct(*cols)))
        place = F.to_json(F.struct(*(F.coalesce(F.col(s).cast("string"), F.lit("")).alias(s) for s in scope)))
        return df.select(F.col(id_col).alias("id"), place.alias("scope"), F.array(*map(whole, keys)).alias("keys"), F.struct(*df.columns).alias("row"))

    old, new = keyed(base), keyed(changes)
    own = F.coalesce(*(F.concat(F.lit(f"{i}:"), F.col("keys")[i]) for i in range(len(keys))), F.concat(F.lit("id:"), F.col("id").cast("string")))
    first = Window.partitionBy("scope", "own").orderBy("id")
    new = new.withColumn("own", own).withColumn("alone", F.row_number().over(first) == 1)
    acting = new.where("alone").drop("own", "alone")

    # candidates share some key; the first one that both have must be equal
    exploded = lambda df, side: df.select("scope", F.col("id").alias(f"{side}_id"), F.col("keys").alias(f"{side}_keys"), F.posexplode("keys").alias("rank", "key")).where("key is not null")
    met = exploded(acting, "new").join(exploded(old, "old"), ["scope", "rank", "key"])
    fits = F.coalesce(*(F.when(F.col("new_keys")[i].isNotNull() & F.col("old_keys")[i].isNotNull(), F.col("new_keys")[i] == F.col("old_keys")[i]) for i in range(len(keys))))
    best = met.where(fits).groupBy("new_id").agg(F.min(F.struct("rank", "old_id")).alias("b")).select("new_id", "b.rank", "b.old_id")
    once = best.withColumn("n", F.row_number().over(Window.partitionBy("old_id").orderBy("new_id")))

    pairs = once.join(acting.select(F.col("id").alias("new_id"), F.col("row").alias("new")), "new_id").join(old.select(F.col("id").alias("old_id"), F.col("row").alias("old")), "old_id")
    decided = pairs.select("new_id", "old_id", (F.coalesce(replace, F.lit(False)) & (F.col("n") == 1)).alias("acts"))
    changed = new.join(decided.withColumnRenamed("new_id", "id"), "id", "left")
    fate = F.when(~F.col("alone"), "ignored").when(F.col("old_id").isNull(), "inserted").when(F.col("acts"), "replacing").otherwise("ignored")
    out = changed.select(fate.alias("fate"), F.when(F.col("acts"), F.col("old_id")).alias("target"), "row.*")
    stays = old.join(decided.where("acts").select(F.col("old_id").alias("id"), "acts"), "id", "left")
    return out.unionByName(stays.select(F.when(F.col("acts"), "replaced").otherwise("kept").alias("fate"), F.lit(None).cast(dict(out.dtypes)["target"]).alias("target"), "row.*"))
