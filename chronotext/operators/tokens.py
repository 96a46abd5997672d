"""Operators over token tables: keys, tok_pos, normalized_token, text, start_char, end_char, [times and score]."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _in_order(keys: Sequence[str], pos: str = "tok_pos"):
    return Window.partitionBy(*keys).orderBy(pos)


def run_ids(rows: DataFrame, keys: Sequence[str], order: str, same: Sequence[str], name: str = "run_id") -> DataFrame:
    """Numbers runs of neighbouring rows that agree in `same`, from 0: consecutive group-by, run-length merging."""
    w = _in_order(keys, order)
    differs = F.lit(False)
    for c in same:
        differs = differs | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    changed = F.when(F.row_number().over(w) == 1, 0).when(differs, 1).otherwise(0)
    return rows.withColumn("__new", changed).withColumn(name, F.sum("__new").over(w).cast("int")).drop("__new")


def interpolate_times(tokens: DataFrame, keys: Sequence[str], start: Column | str, end: Column | str) -> DataFrame:
    """Spreads n tokens evenly over [start, end]: start_time, end_time, score 0.0 (the fallback where alignment is infeasible)."""
    start, end = (F.col(c) if isinstance(c, str) else c for c in (start, end))
    n = F.count("*").over(Window.partitionBy(*keys))
    i = F.row_number().over(_in_order(keys)) - 1
    step = (end - start) / n
    return tokens.withColumn("__i", i).withColumn("__step", step).withColumn("start_time", start + F.col("__i") * F.col("__step")).withColumn("end_time", start + (F.col("__i") + 1) * F.col("__step")).withColumn("score", F.lit(0.0)).drop("__i", "__step")


def merge_multitoken(tokens: DataFrame, keys: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """Neighbouring tokens of one original span as one row: first start, last end, mean score, tokens joined by a space.

    `carry` names columns that are alike within a span.  tok_pos is renumbered.
    The grouping keeps the partitioning of the windows: no further exchange.
    """
    marked = run_ids(tokens, keys, "tok_pos", ["start_char", "end_char"], "__span")
    timed = {"start_time", "end_time", "score"} <= set(tokens.columns)
    ordered = F.array_sort(F.collect_list(F.struct("tok_pos", "normalized_token")))
    aggs = [
        F.array_join(F.transform(ordered, lambda x: x.normalized_token), " ").alias("normalized_tokens"),
        F.first("text").alias("text"),
        F.first("start_char").alias("start_char"),
        F.first("end_char").alias("end_char"),
        *(F.first(c).alias(c) for c in carry),
    ]
    if timed:
        aggs += [F.min_by("start_time", "tok_pos").alias("start_time"), F.max_by("end_time", "tok_pos").alias("end_time"), F.avg("score").alias("score")]
    return marked.groupBy(*keys, F.col("__span").alias("tok_pos")).agg(*aggs)


def extend_over_deletions(tokens: DataFrame, keys: Sequence[str], length: Column | str) -> DataFrame:
    """Adds end_char_extended: the next token's start, or the text's length after the last."""
    length = F.col(length) if isinstance(length, str) else length
    return tokens.withColumn("end_char_extended", F.coalesce(F.lead("start_char").over(_in_order(keys)), length).cast("int"))


def add_wildcards(tokens: DataFrame, keys: Sequence[str], start: bool = True, end: bool = True) -> DataFrame:
    """A "*" token at (0, 0) before the first and one past the last token's end; positions are renumbered from 0."""
    out = tokens
    star = {"normalized_token": F.lit("*"), "text": F.lit("*")}
    if start:
        first = tokens.groupBy(*keys).agg((F.min("tok_pos") - 1).cast("int").alias("tok_pos"))
        out = out.unionByName(first.select(*keys, "tok_pos", *(c.alias(k) for k, c in star.items()), F.lit(0).alias("start_char"), F.lit(0).alias("end_char")), allowMissingColumns=True)
    if end:
        last = tokens.groupBy(*keys).agg((F.max("tok_pos") + 1).cast("int").alias("tok_pos"), (F.max_by("end_char", "tok_pos") + 1).cast("int").alias("start_char"))
        out = out.unionByName(last.select(*keys, "tok_pos", *(c.alias(k) for k, c in star.items()), "start_char", F.col("start_char").alias("end_char")), allowMissingColumns=True)
    return out.withColumn("tok_pos", (F.row_number().over(_in_order(keys)) - 1).cast("int")) if start else out


def without_wildcards(tokens: DataFrame, token_col: str = "normalized_tokens") -> DataFrame:
    return tokens.where(F.col(token_col) != "*")
