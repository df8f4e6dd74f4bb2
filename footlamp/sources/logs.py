"""Source: JSON-lines log records with open-ended custom keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_SCHEMA = """STRUCT<timestamp: STRING, level: STRING, logger: STRING, message: STRING, module: STRING,
function: STRING, line: INT, exception: STRUCT<type: STRING, message: STRING>,
system: STRUCT<cpu_percent: DOUBLE, memory_percent: DOUBLE>, _corrupt_record: STRING>"""
PREFIX = "custom_"


def parse_logs(lines: DataFrame, text: str = "value") -> DataFrame:
    """Typed columns, the custom keys as a map without their prefix, and the raw text of bad lines."""
    record = F.from_json(text, LOG_SCHEMA, {"columnNameOfCorruptRecord": "_corrupt_record"})
    everything = F.from_json(text, "MAP<STRING, STRING>")
    custom = F.transform_keys(
        F.map_filter(everything, lambda k, _: k.startswith(PREFIX)),
        lambda k, _: F.right(k, F.length(k) - len(PREFIX)),
    )
    rest = [c for c in lines.columns if c != text]
    return lines.select(*rest, record.alias("r"), custom.alias("custom")).select(*rest, "r.*", "custom")


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    return parse_logs(spark.read.text(path))
