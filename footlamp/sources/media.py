"""Sources: media probes, file listings, run state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footlamp.operators.validation import extension

PROBE_SCHEMA = """
format STRUCT<duration: STRING, bit_rate: STRING, size: STRING, format_name: STRING>,
streams ARRAY<STRUCT<codec_type: STRING, codec_name: STRING, width: INT, height: INT, r_frame_rate: STRING,
  duration: STRING, bit_rate: STRING, channels: INT, channel_layout: STRING, sample_rate: STRING,
  sample_fmt: STRING, tags: STRUCT<language: STRING>>>
"""

# Fixed values.
DISCOVERED_EXTENSIONS = ["mp4", "avi", "mkv", "mov", "wmv", "flv", "webm"]
DEFAULT_FPS = 25.0


def parse_probe(docs: DataFrame, json: str = "probe") -> DataFrame:
    """Add the typed ``doc`` of a probe document held as JSON text."""
    return docs.withColumn("doc", F.from_json(json, f"STRUCT<{_inline(PROBE_SCHEMA)}>"))


def _inline(ddl: str) -> str:
    return " ".join(ddl.split()).replace("format STRUCT", "format: STRUCT").replace("streams ARRAY", "streams: ARRAY")


def read_probes(spark: SparkSession, path: str) -> DataFrame:
    """One row per probe file."""
    return spark.read.schema(PROBE_SCHEMA).option("multiLine", True).json(path).select(
        F.struct("format", "streams").alias("doc")
    )


def _streams(kind: str) -> Column:
    return F.filter(F.col("doc.streams"), lambda s: s["codec_type"] == kind)


def _number(value: Column, kind: str) -> Column:
    return value.try_cast(kind)


def frame_rate(text: Column) -> Column:
    """``num/den`` as a number; a zero denominator gives 25."""
    parts = F.split(F.coalesce(text, F.lit("25/1")), "/")
    num, den = F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    return F.when(den == 0, F.lit(DEFAULT_FPS)).otherwise(num / F.coalesce(den, F.lit(1.0)))


def probe_assets(docs: DataFrame, format_only: bool = False) -> DataFrame:
    """Flatten parsed probe documents; a file without a video stream becomes an error row."""
    df = docs.withColumn("__v", F.get(_streams("video"), F.lit(0))).withColumn("__a", F.get(_streams("audio"), F.lit(0)))
    v, a, f = F.col("__v"), F.col("__a"), F.col("doc.format")
    from_stream = F.lit(None) if format_only else v["duration"]
    rate_stream = F.lit(None) if format_only else v["bit_rate"]
    missing = v.isNull()

    def video(c: Column) -> Column:
        return F.when(~missing, c)

    return df.select(
        *[c for c in docs.columns if c not in ("doc", "probe")],
        video(v["width"]).alias("width"),
        video(v["height"]).alias("height"),
        video(_number(F.coalesce(from_stream, f["duration"], F.lit("0")), "double")).alias("duration_s"),
        video(frame_rate(v["r_frame_rate"])).alias("fps"),
        video(v["codec_name"]).alias("codec"),
        video(_number(F.coalesce(rate_stream, f["bit_rate"], F.lit("0")), "bigint")).alias("bitrate"),
        video(a.isNotNull()).alias("has_audio"),
        video(F.when(a.isNotNull(), F.coalesce(a["channels"], F.lit(2)))).alias("channels"),
        video(F.when(a.isNotNull(), F.coalesce(_number(a["sample_rate"], "int"), F.lit(44100)))).alias("audio_rate"),
        F.when(missing, F.lit("no_video_stream")).alias("error"),
    )


def explode_tracks(docs: DataFrame) -> DataFrame:
    """One row per audio stream with defaults for missing keys; silent files keep one null row."""
    keep = [c for c in docs.columns if c not in ("doc", "probe")]
    df = docs.select(*keep, F.posexplode_outer(_streams("audio")).alias("pos", "s"))
    s = F.col("s")
    known = s.isNotNull()

    def default(c: Column, value) -> Column:
        return F.when(known, F.coalesce(c, F.lit(value)))

    return df.select(
        *keep,
        (F.col("pos") + 1).alias("track"),
        default(s["codec_name"], "unknown").alias("codec"),
        default(_number(s["bit_rate"], "bigint"), 0).alias("bitrate"),
        default(s["channels"], 2).alias("channels"),
        default(s["channel_layout"], "stereo").alias("layout"),
        default(_number(s["sample_rate"], "int"), 44100).alias("rate"),
        default(s["tags"]["language"], "unknown").alias("language"),
    )


def scan_files(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """File inventory of a folder; the content column is pruned, so only listings are read."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", recursive)
        .load(folder)
    )
    return files.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))


def discover_assets(files: DataFrame, preset: Column, quality: Column) -> DataFrame:
    """Videos of an inventory with the output name each one would get."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    stem, suffix = F.regexp_extract(name, r"^(.*)(\.[^.]+)$", 1), F.regexp_extract(name, r"(\.[^.]+)$", 1)
    return files.where(extension().isin(DISCOVERED_EXTENSIONS)).withColumn(
        "output_name", F.concat(stem, F.lit("_enhanced_"), preset, F.lit("_"), quality, F.lit("_4k"), suffix)
    )


RUN_STATE = "STRUCT<stage: STRING, total_segments: INT, completed: ARRAY<INT>, failed: ARRAY<INT>>"


def load_run_state(states: DataFrame, json: str = "state") -> DataFrame:
    """Overlay saved state on the defaults, top level only; unreadable text gives the defaults."""
    s = F.from_json(json, RUN_STATE)
    none = F.array().cast("array<int>")
    return states.select(
        *[c for c in states.columns if c != json],
        F.coalesce(s["stage"], F.lit("init")).alias("stage"),
        F.coalesce(s["total_segments"], F.lit(0)).alias("total_segments"),
        F.coalesce(s["completed"], none).alias("completed"),
        F.coalesce(s["failed"], none).alias("failed"),
    )
