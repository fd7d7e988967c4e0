"""Session files: finding a project's, reading their lines, and figures kept up to date while they grow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orecart.sources.store import _files


def project_folder(spark: SparkSession, projects: str, cwd: str) -> str | None:
    """The first folder, by name, below `projects` whose name holds the working folder's path with dashes for slashes; None without one."""
    fs, path = _files(spark, projects)
    if not fs.exists(path):
        return None
    key = cwd.replace("/", "-").lstrip("-")
    found = sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory() and key in s.getPath().getName())
    return f"{projects.rstrip('/')}/{found[0]}" if found else None


def session_files(spark: SparkSession, folder: str, pattern: str = "*.jsonl") -> DataFrame:
    """(session_id, modified, file, value): each session file as it is now, whole; unreadable text counts as no lines.

    A session is a file named after it, or a folder `session_id=...` of files that follow each other in time.
    """
    raw = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("wholetext", "true").text(folder)
    path = F.col("_metadata.file_path")
    by_folder = F.regexp_extract(path, r"/session_id=([^/]+)/[^/]*$", 1)
    name = F.when(by_folder != "", by_folder).otherwise(F.regexp_replace(F.col("_metadata.file_name"), r"(?<=.)\.[^.]*$", ""))
    return raw.select(name.alias("session_id"), F.col("_metadata.file_modification_time").alias("modified"), path.alias("file"), "value")


def session_lines(files: DataFrame) -> DataFrame:
    """(session_id, line_no, line) of session files; line_no orders the lines of a session."""
    each = files.select("session_id", "modified", "file", F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))
    return each.select("session_id", F.struct("modified", "file", "pos").alias("line_no"), "line")


def watch(spark: SparkSession, folder: str, checkpoint: str, sink: Callable[[DataFrame, int], None], seconds: int | None = None, pattern: str = "*.jsonl"):
    """Give `sink(lines, tick)` all session lines, (session_id, line_no, line), at each tick of a stream.

    Session files grow by lines at their end, which a stream of new files would not see, so each tick reads the folder again and figures
    are made anew. 0 seconds count as 2; without an interval there is one tick with what is there now.
    """
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()
    writer = ticks.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda _, tick: sink(session_lines(session_files(spark, folder, pattern)), tick))
    return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds or 2} seconds")).start()
