"""Resolution of moved codes: latest movement wins, chains are followed, live codes never move."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelrisk.session import cut_lineage

# Movement kinds that really change a code, and the split kind that is ambiguous.
MERGE_KINDS = ("31", "32", "33", "34", "35", "41", "50")
AMBIGUOUS_KINDS = ("21",)
FULL_ENTITY = "COM"


def latest(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """Keep the first row of each key in the given order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def latest_moves(moves: DataFrame) -> DataFrame:
    """(source, target): the most recent effective move of each code; equal dates take the smallest target."""
    used = moves.filter(
        F.col("kind").isin(*MERGE_KINDS) & (F.col("target_type") == FULL_ENTITY) & (F.col("source") != F.col("target"))
    )
    # Two partial aggregates instead of a window: a code with a long history stays map-side.
    last = used.groupBy("source", "effective").agg(F.min("target").alias("target"))
    return last.groupBy("source").agg(F.max_by("target", "effective").alias("target"))


def _followed(moves: DataFrame, live: DataFrame) -> DataFrame:
    """(source, target, hops, done) after following every chain to its end.

    Pointer doubling: each round joins the table with itself and doubles the hops behind a pointer. The codes along
    a chain are sources too, so as long as some chain is unfinished each round finishes at least one code:
    the first round that finishes none is the last, and what is left are cycles and dead ends.
    """
    alive = live.select(F.col("code").alias("target")).distinct().withColumn("_live", F.lit(True))
    hop = latest_moves(moves).join(alive.withColumnRenamed("target", "source"), "source", "left_anti")
    step = cut_lineage(
        hop.join(alive, "target", "left").select("source", "target", F.lit(1).alias("hops"), F.coalesce("_live", F.lit(False)).alias("done"))
    )
    finished, before = step.filter("done").count(), -1
    while finished > before:
        nxt = step.select(
            F.col("source").alias("target"), F.col("target").alias("_t"), F.col("hops").alias("_h"), F.col("done").alias("_d")
        )
        moved = ~F.col("done") & F.col("_t").isNotNull()
        step = step.join(nxt, "target", "left").select(
            "source",
            F.when(moved, F.col("_t")).otherwise(F.col("target")).alias("target"),
            F.when(moved, F.col("hops") + F.col("_h")).otherwise(F.col("hops")).alias("hops"),
            F.when(moved, F.col("_d")).otherwise(F.col("done")).alias("done"),
        )
        step = cut_lineage(step)
        finished, before = step.filter("done").count(), finished
    return step


def resolve_codes(moves: DataFrame, live: DataFrame) -> DataFrame:
    """(source, target, hops) for every dead code that reaches a live one, over a chain of any length."""
    return _followed(moves, live).filter("done").select("source", "target", "hops")


def unresolved_codes(moves: DataFrame, live: DataFrame) -> DataFrame:
    """Moved codes whose chain ends in a cycle or at a code that is neither live nor moved."""
    return _followed(moves, live).filter(~F.col("done")).select("source")


def ambiguous_codes(moves: DataFrame) -> DataFrame:
    """Codes born from a split: listed, never resolved."""
    return moves.filter(F.col("kind").isin(*AMBIGUOUS_KINDS)).select(F.col("source").alias("code")).distinct()


def remap(df: DataFrame, column: str, passage: DataFrame) -> DataFrame:
    """Replace a code by its current one; a code without a move keeps itself."""
    table = passage.select(F.col("source").alias(column), F.col("target").alias("_new"))
    return df.join(table, column, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def attach_known(events: DataFrame, known: DataFrame, code: str, out_of_scope) -> DataFrame:
    """Unknown codes become NULL in ``entity``; ``cause`` says why (out of scope or unresolved)."""
    table = known.select(F.col("code").alias(code), F.col("code").alias("entity")).distinct()
    joined = events.join(table, code, "left")
    cause = F.when(F.col("entity").isNotNull(), "attached").when(out_of_scope, "out_of_scope").otherwise("unresolved")
    return joined.withColumn("cause", cause)


def attachment_report(attached: DataFrame, limit: float = 0.01) -> DataFrame:
    """Counts by cause, and whether the unresolved share of the in-scope events stays below the limit."""
    out = attached.agg(
        F.count_if(F.col("cause") == "attached").alias("attached"),
        F.count_if(F.col("cause") == "out_of_scope").alias("out_of_scope"),
        F.count_if(F.col("cause") == "unresolved").alias("unresolved"),
    )
    scope = F.greatest(F.col("attached") + F.col("unresolved"), F.lit(1))
    return out.withColumn("acceptable", F.col("unresolved") / scope < limit)
