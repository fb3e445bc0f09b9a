"""Subtitle files and lenient JSON lines as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TIME = r"(\d+):(\d{2}):(\d{2})[,.](\d{3})"


def file_format(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext.isin("srt", "vtt", "ass"), ext).otherwise("unknown")


def _ms(block: Column, nth: int) -> Column:
    group = lambda k: F.regexp_extract(block, f"{_TIME}\\s*-->\\s*{_TIME}", 4 * nth + k).cast("long")
    return ((group(1) * 60 + group(2)) * 60 + group(3)) * 1000 + group(4)


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (file), cue_index (order in the file), start_ms, end_ms, text of SRT and VTT files."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), "value")
    return parse_srt(files)


def parse_srt(files: DataFrame) -> DataFrame:
    blocks = F.filter(F.split(F.regexp_replace("value", "\r\n?", "\n"), r"\n[ \t]*\n+", -1), lambda x: F.contains(x, F.lit("-->")))
    d = files.select("doc_id", F.posexplode(blocks).alias("cue_index", "b"))
    body = F.regexp_replace(F.regexp_replace("b", r"(?s)^.*?-->[^\n]*\n?", ""), r"\n+$", "")
    return d.select("doc_id", "cue_index", _ms(F.col("b"), 0).alias("start_ms"), _ms(F.col("b"), 1).alias("end_ms"), body.alias("text"))


def read_ass(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (file), cue_index, style, start_ms, end_ms, text of ASS files."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), "value")
    return parse_ass(files)


def parse_ass(files: DataFrame) -> DataFrame:
    """The dialogue lines of the events of files(doc_id, value), in their order; the text is the last of ten fields, as written.

    Times are in hundredths of a second; lines that hold fewer fields or no times are left out."""
    lines = F.filter(F.split(F.regexp_replace("value", "\r\n?", "\n"), "\n", -1), lambda x: F.startswith(x, F.lit("Dialogue:")))
    parts = F.transform(lines, lambda x: F.split(F.regexp_replace(x, r"^Dialogue:\s*", ""), ",", 10))
    whole = F.filter(parts, lambda p: (F.size(p) == 10) & p[1].rlike(r"^\s*\d+:\d+:\d+[.]\d+\s*$") & p[2].rlike(r"^\s*\d+:\d+:\d+[.]\d+\s*$"))
    d = files.select("doc_id", F.posexplode(whole).alias("cue_index", "p"))

    def ms(c: Column) -> Column:
        t = F.split(F.trim(c), "[:.]")
        return ((t[0].cast("long") * 60 + t[1].cast("long")) * 60 + t[2].cast("long")) * 1000 + F.rpad(t[3], 3, "0").cast("long")

    return d.select("doc_id", F.col("cue_index").cast("long").alias("cue_index"), F.trim(F.col("p")[3]).alias("style"), ms(F.col("p")[1]).alias("start_ms"), ms(F.col("p")[2]).alias("end_ms"), F.col("p")[9].alias("text"))


def write_documents(cues: DataFrame, path: str) -> None:
    """One SRT text for each doc_id, each a single file in a folder of its name; a document is one row here."""
    from lexweave.functions.text import srt_time

    one = F.concat(F.format_string("%d\n", F.col("cue_index") + 1), srt_time(F.col("start_ms")), F.lit(" --> "), srt_time(F.col("end_ms")), F.lit("\n"), "text", F.lit("\n\n"))
    d = cues.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cue_index", one.alias("v")))), lambda x: x["v"]), "").alias("value"))
    d.select("doc_id", "value").write.partitionBy("doc_id").option("lineSep", "\n").text(path)


def write_srt(cues: DataFrame, path: str) -> None:
    """One folder for each doc_id, its cues in order."""
    from lexweave.functions.text import srt_time

    line = F.concat(F.format_string("%d\n", F.col("cue_index") + 1), srt_time(F.col("start_ms")), F.lit(" --> "), srt_time(F.col("end_ms")), F.lit("\n"), "text", F.lit("\n"))
    cues.select("doc_id", "cue_index", line.alias("value")).repartition("doc_id").sortWithinPartitions("doc_id", "cue_index").select("doc_id", "value").write.partitionBy("doc_id").text(path)


def json_objects(lines: DataFrame) -> DataFrame:
    """value -> ok, failed and skipped: JSON objects, other lines, blank lines."""
    v = F.trim("value")
    parsed = F.try_parse_json(v)
    return lines.withColumn("state", F.when(v == "", "skipped").when(F.schema_of_variant(parsed).startswith("OBJECT"), "ok").otherwise("failed"))
