"""Job events as status files: the newest by the files' own time of change, and a stream that archives what it has read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SCHEMA = "job string, status string, detail string"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """(job, status, detail, file, changed) of all JSON status files below a folder; a file that does not parse has a missing status."""
    x = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True)
    x = x.select(F.from_json("value", SCHEMA).alias("e"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("changed"))
    return x.select("e.*", "file", "changed")


def latest_events(events: DataFrame, by: tuple[str, ...] = ("job",)) -> DataFrame:
    """The newest readable event of each job, or of all; of equal times the last file name counts."""
    row = F.struct(*[c for c in events.columns if c not in by])
    out = events.where("status IS NOT NULL").groupBy(*by).agg(F.max_by(row, F.struct("changed", "file")).alias("r"))
    return out.select(*by, "r.*")


def follow_events(spark: SparkSession, path: str, archive: str) -> DataFrame:
    """A stream of status files; files of finished batches move to `archive`."""
    x = spark.readStream.schema(SCHEMA).option("cleanSource", "archive").option("sourceArchiveDir", archive).option("maxFilesPerTrigger", 100)
    return x.option("pathGlobFilter", "*.json").json(path)
