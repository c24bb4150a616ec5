"""Per-document operators over a stream of arriving documents.

Masking, repair, chunking, segmentation and checks look at one row alone, so they hold no state and
run unchanged on a stream; what needs several documents (alignment, baselines) isn't offered here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.functions.text import newlines, strip_bom
from bitloom.operators.segment import segments


def document_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """(path, text) of text files as they arrive in a folder."""
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("path"), strip_bom(newlines(F.col("value"))).alias("text"))


def write_segments(documents: DataFrame, out: str, checkpoint_dir: str):
    """Segments of each arriving document, appended as Parquet; returns the started query."""
    return (
        segments(documents, "path").writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", checkpoint_dir).outputMode("append").trigger(availableNow=True).start()
    )
