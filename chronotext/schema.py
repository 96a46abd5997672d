"""Record types of nested files, and their flat tables.

Flat tables are keyed by (audio_path, speech_pos, chunk_pos | seg_pos, word_pos);
positions are kept because the order of lists matters everywhere.  Identifiers
are strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronotext.functions.frames import duration
from chronotext.functions.text import no_leading_space

D, L, S = T.DoubleType(), T.LongType(), T.StringType()
_f = lambda **k: T.StructType([T.StructField(n, t) for n, t in k.items()])

WORD = _f(text=S, start=D, end=D, score=D)
SEGMENT = _f(start=D, end=D, text=S, words=T.ArrayType(WORD), id=S, duration=D, score=D)
CHUNK = _f(start=D, end=D, text=S, duration=D, audio_frames=L, num_logits=L, language=S, language_prob=D, id=S)
SPEECH = _f(
    speech_id=S, start=D, end=D, text=S, text_spans=T.ArrayType(T.ArrayType(T.IntegerType())), chunks=T.ArrayType(CHUNK),
    alignments=T.ArrayType(SEGMENT), duration=D, audio_frames=L, probs_path=S, metadata=T.MapType(S, S),
)
FILE = _f(audio_path=S, sample_rate=T.IntegerType(), duration=D, speeches=T.ArrayType(SPEECH), metadata=T.MapType(S, S))


def speeches_of(files: DataFrame) -> DataFrame:
    """One row per speech: speech_id filled with its position, duration with end - start; an error for leading white space in a text."""
    x = files.select("audio_path", "sample_rate", F.posexplode_outer("speeches").alias("speech_pos", "s")).where("s is not null")
    rest = [F.col(f"s.{n}").alias(n) for n in SPEECH.names if n not in ("speech_id", "duration", "text", "text_spans")]
    spans = F.transform("s.text_spans", lambda p: F.struct(p[0].alias("start_char"), p[1].alias("end_char")))
    return x.select(
        "audio_path", "sample_rate", "speech_pos",
        F.coalesce("s.speech_id", F.col("speech_pos").cast("string")).alias("speech_id"),
        duration("s.start", "s.end", "s.duration").alias("duration"),
        no_leading_space("s.text").alias("text"), spans.alias("text_spans"), *rest,
    )


def chunks_of(speeches: DataFrame) -> DataFrame:
    x = speeches.select("audio_path", "speech_pos", "speech_id", F.posexplode("chunks").alias("chunk_pos", "c"))
    rest = [F.col(f"c.{n}").alias(n) for n in CHUNK.names if n != "duration"]
    return x.select("audio_path", "speech_pos", "speech_id", "chunk_pos", duration("c.start", "c.end", "c.duration").alias("duration"), *rest)


def segments_of(speeches: DataFrame) -> DataFrame:
    x = speeches.select("audio_path", "speech_pos", "speech_id", F.posexplode("alignments").alias("seg_pos", "g"))
    rest = [F.col(f"g.{n}").alias(n) for n in SEGMENT.names if n != "duration"]
    return x.select("audio_path", "speech_pos", "speech_id", "seg_pos", duration("g.start", "g.end", "g.duration").alias("duration"), *rest)


def words_of(segments: DataFrame) -> DataFrame:
    x = segments.select("audio_path", "speech_pos", "seg_pos", F.posexplode("words").alias("word_pos", "w"))
    return x.select("audio_path", "speech_pos", "seg_pos", "word_pos", "w.text", "w.start", "w.end", "w.score")


def _listed(pos: str, record: T.StructType, columns: list[str]) -> Column:
    """The rows of a group as an array of records, in order of pos; missing fields are null."""
    fields = [(F.col(n) if n in columns else F.lit(None)).cast(record[n].dataType).alias(n) for n in record.names]
    rows = F.collect_list(F.struct(F.col(pos).alias("__pos"), F.struct(*fields).alias("__r")))
    ordered = F.array_sort(rows, lambda a, b: a["__pos"] - b["__pos"])  # maps have no order of their own
    return F.transform(ordered, lambda x: x["__r"])


def nest(speeches: DataFrame, segments: DataFrame | None = None, chunks: DataFrame | None = None) -> DataFrame:
    """Flat tables back to one row per file; every exchange is on the file."""
    keys = ["audio_path", "speech_pos"]
    s = speeches
    if segments is not None:
        grouped = segments.groupBy(*keys).agg(_listed("seg_pos", SEGMENT, segments.columns).alias("alignments"))
        s = s.drop("alignments").join(grouped, keys, "left")
    if chunks is not None:
        grouped = chunks.groupBy(*keys).agg(_listed("chunk_pos", CHUNK, chunks.columns).alias("chunks"))
        s = s.drop("chunks").join(grouped, keys, "left")
    if "text_spans" in s.columns:
        s = s.withColumn("text_spans", F.transform("text_spans", lambda p: F.array(p.start_char, p.end_char)))
    for n in ("chunks", "alignments"):
        if n in s.columns:
            s = s.withColumn(n, F.coalesce(n, F.array().cast(SPEECH[n].dataType)))
    rate = F.first("sample_rate").alias("sample_rate") if "sample_rate" in s.columns else F.lit(None).cast("int").alias("sample_rate")
    return s.groupBy("audio_path").agg(rate, _listed("speech_pos", SPEECH, s.columns).alias("speeches"))


def nest_rows(speeches: DataFrame) -> DataFrame:
    """nest() where each row is the only speech of its file and holds its lists of records already: no exchange."""
    fields = [(F.col(n) if n in speeches.columns else F.lit(None)).cast(SPEECH[n].dataType).alias(n) for n in SPEECH.names]
    return speeches.select("audio_path", F.col("sample_rate").cast("int").alias("sample_rate"), F.array(F.struct(*fields)).alias("speeches"))
