"""Word timings rolled up to segments of the original text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def whole_text_segment(tokens: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The segmentation without any splitter: one span from the first token's start to the last one's end."""
    return tokens.groupBy(*keys).agg(F.lit(0).alias("seg_pos"), F.min_by("start_char", "tok_pos").alias("start_char"), F.max_by("end_char", "tok_pos").alias("end_char"))


def custom_spans(speeches: DataFrame, keys: Sequence[str], spans_col: str = "text_spans") -> DataFrame:
    """Given spans as rows: keys, seg_pos, start_char, end_char; an empty list counts as none given."""
    return speeches.select(*keys, F.posexplode(spans_col).alias("seg_pos", "__s")).select(*keys, "seg_pos", F.col("__s").getField("start_char").cast("int").alias("start_char"), F.col("__s").getField("end_char").cast("int").alias("end_char"))


def segment_words(tokens: DataFrame, spans: DataFrame, keys: Sequence[str], strict: bool = True) -> DataFrame:
    """Words with the segment that each belongs to: the tokens' columns, seg_pos, in_span, seg_start_time, seg_end_time.

    A span begins in the token with start_char <= a < end_char_extended and ends
    in the one with start_char < b <= end_char_extended.  Both are as-of lookups:
    tokens and span ends are one stream ordered by character, and the last token
    so far is carried along, so the cost is that of a sort, not of a join of
    every span with every token.  All windows share the partitioning by key.

    With strict, spans from the first one on that can't be located (or that begin
    before the end of their predecessor) have no words; words between located
    spans belong to the later one.  Without strict only the spans that can't be
    located are left out.
    """
    keys = list(keys)
    ordered = Window.partitionBy(*keys).orderBy("tok_pos")
    t = tokens.withColumn("__ord", (F.row_number().over(ordered) - 1).cast("int"))
    # a frame that ends at the current row is a running value; one that begins there would be computed anew for each row
    backwards = Window.partitionBy(*keys).orderBy(F.col("tok_pos").desc())
    t = t.withColumn("__prev", F.last("end_time", ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    t = t.withColumn("__next", F.last("start_time", ignorenulls=True).over(backwards.rowsBetween(Window.unboundedPreceding, 0)))
    token = F.struct("__ord", "end_char_extended", "__next", "__prev")
    none = F.lit(None)
    stream = t.select(*keys, F.col("start_char").alias("__at"), F.lit(0).alias("__kind"), none.cast("int").alias("seg_pos"), none.cast("int").alias("__limit"), token.alias("__tok"))
    kind = stream.schema["__tok"].dataType
    ends = spans.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.col("start_char").alias("__at"), F.lit(1).alias("__kind"), F.col("start_char").alias("__limit")),
                F.struct((F.col("end_char") - 1).alias("__at"), F.lit(2).alias("__kind"), F.col("end_char").alias("__limit")),
            )
        ).alias("__e"),
        "seg_pos",
    ).select(*keys, "__e.__at", "__e.__kind", F.col("seg_pos").cast("int").alias("seg_pos"), F.col("__e.__limit").cast("int").alias("__limit"), none.cast(kind).alias("__tok"))
    carried = F.last("__tok", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0))
    found = stream.unionByName(ends).withColumn("__tok", carried).where("__kind > 0")
    at_start = F.when(F.col("__kind") == 1, F.when(F.col("__limit") < F.col("__tok.end_char_extended"), F.col("__tok")))
    at_end = F.when(F.col("__kind") == 2, F.when(F.col("__limit") <= F.col("__tok.end_char_extended"), F.col("__tok")))
    segs = found.groupBy(*keys, "seg_pos").agg(F.first(at_start, ignorenulls=True).alias("__s"), F.first(at_end, ignorenulls=True).alias("__e"))
    by_seg = Window.partitionBy(*keys).orderBy("seg_pos")
    located = F.col("__s").isNotNull() & F.col("__e").isNotNull()
    segs = segs.withColumn("__low", F.least("__s.__ord", "__e.__ord")).withColumn("__high", F.greatest("__s.__ord", "__e.__ord"))
    if strict:
        before = F.coalesce(F.lag("__high").over(by_seg), F.lit(-1))
        segs = segs.withColumn("__ok", located & (F.col("__low") > before))
        segs = segs.withColumn("__ok", F.bool_and("__ok").over(by_seg.rowsBetween(Window.unboundedPreceding, 0))).where("__ok")
    else:
        segs = segs.where(located)
    seg = F.struct("seg_pos", F.col("__s.__ord").alias("first"), F.col("__e.__ord").alias("last"), F.col("__s.__next").alias("t0"), F.col("__e.__prev").alias("t1"))
    # each token takes the first segment that ends at or after it
    rows = t.select(*keys, F.col("__ord").alias("__at"), F.lit(0).alias("__kind"), F.struct(*t.columns).alias("__row"))
    marks = segs.select(*keys, F.col("__high").alias("__at"), F.lit(1).alias("__kind"), seg.alias("__seg"))
    both = rows.unionByName(marks, allowMissingColumns=True)
    latest_first = Window.partitionBy(*keys).orderBy(F.col("__at").desc(), F.col("__kind").desc(), F.col("__seg.seg_pos").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("__seg", F.last("__seg", ignorenulls=True).over(latest_first)).where("__kind = 0 and __seg is not null")
    inside = (F.col("__row.__ord") >= F.col("__seg.first")) & (F.col("__row.__ord") <= F.col("__seg.last"))
    return out.select(
        *(F.col("__row")[c].alias(c) for c in tokens.columns),
        F.col("__seg.seg_pos").alias("seg_pos"),
        inside.alias("in_span"),
        F.col("__seg.t0").alias("seg_start_time"),
        F.col("__seg.t1").alias("seg_end_time"),
    )


def encode_segments(words: DataFrame, keys: Sequence[str], digits: int = 5) -> DataFrame:
    """One row per segment: start, end, duration, text, score (mean of its words), words; rounded once, here.

    Segments without a time are left out.
    """
    r = lambda c: F.round(c, digits)
    word = F.struct("tok_pos", F.col("text_span_full").alias("text"), r("start_time").alias("start"), r("end_time").alias("end"), r("score").alias("score"))
    listed = F.array_sort(F.collect_list(word))
    text = F.array_sort(F.collect_list(F.when(F.col("in_span"), F.struct("tok_pos", F.col("text_span_full").alias("text")))))
    grouped = words.groupBy(*keys, "seg_pos").agg(
        F.first("seg_start_time").alias("__a"),
        F.first("seg_end_time").alias("__b"),
        F.array_join(F.transform(text, lambda x: x.text), "").alias("text"),
        F.avg("score").alias("__score"),
        F.transform(listed, lambda x: F.struct(x.text.alias("text"), x.start.alias("start"), x.end.alias("end"), x.score.alias("score"))).alias("words"),
    )
    return grouped.where("__a is not null and __b is not null").select(
        *keys, "seg_pos", r("__a").alias("start"), r("__b").alias("end"), r(F.col("__b") - F.col("__a")).alias("duration"), "text", r("__score").alias("score"), "words"
    )


def segment_id(*parts: Column | str) -> Column:
    """speech-chunk-segment, or speech-segment."""
    return F.concat_ws("-", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
