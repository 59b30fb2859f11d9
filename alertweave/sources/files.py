"""Uploaded alert files: format detection, the import gate, and JSON, JSON Lines and CSV readers.

A reader gives two tables: `verdicts`, what is wrong with each file, and `records`, one row per event with its payload as JSON
text. A file that does not parse gives no records at all. JSON Lines files are read by splits, many tasks to a file; the other formats
have no place where a reader could start in the middle, so such a file is read whole by one task, after the gate
(50 MB) has looked at its size. Files are spread over the cluster.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alertweave import model
from alertweave.session import cut_lineage, no_rows

PREVIEW_BYTES = 1024
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
RECORDS = "path string, record_no bigint, payload string"
PARSED = RECORDS + ", error_message string"
#: Files that are read by lines, whatever the case of their names.
LINE_FILES = "*.{[jJ][sS][oO][nN][lL],[nN][dD][jJ][sS][oO][nN]}"


@dataclass(frozen=True)
class Uploads:
    """The files of one format that passed the gate: path with content, and the same as lines.

    `contents` has path and content; `lines` has path, block (where the split it was read from begins) and text, in the
    order of the file within a split. Both are lazy: a reader pays for what it uses.
    """

    contents: DataFrame
    lines: DataFrame


def _file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def detect_format(name: Column, preview: Column) -> Column:
    """CSV, JSONL, JSON by extension, else JSON when the text looks like one, else UNKNOWN."""
    lower = F.lower(name)
    text = F.regexp_replace(preview, r"(?U)^\s+|\s+$", "")
    one_object = text.startswith("{") & ~text.contains("\n") & (F.length(text) > 2) & text.endswith("}")
    return (
        F.when(lower.endswith(".csv"), "CSV")
        .when(lower.endswith(".jsonl") | lower.endswith(".ndjson"), "JSONL")
        .when(lower.endswith(".json"), "JSON")
        .when(F.coalesce(text.startswith("[") | one_object, F.lit(False)), "JSON")
        .otherwise("UNKNOWN")
    )


def gate_error(name: Column, length: Column) -> Column:
    """Why an upload is refused, or null."""
    extension = F.when(name.contains("."), F.lower(F.element_at(F.split(name, r"\."), -1))).otherwise("")
    return (
        F.when(~extension.isin(*model.IMPORT_EXTENSIONS), "Unsupported file extension")
        .when(length > model.IMPORT_MAX_BYTES, "File size exceeds limit")
    )


def _text(content: Column) -> Column:
    """File bytes as text, null when they are not UTF-8."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text)


def read_json(uploads: Uploads) -> tuple[DataFrame, DataFrame]:
    """(verdicts, records) of files holding one JSON array of objects or a single object."""
    parsed = uploads.contents.select("path", F.try_parse_json(_text(F.col("content"))).alias("_v"))
    kind = F.schema_of_variant("_v")
    shaped = parsed.withColumn(
        "_items",
        F.when(kind.rlike("^OBJECT"), F.array("_v")).when(
            kind.rlike("^ARRAY"), F.try_variant_get("_v", "$", "array<variant>")
        ),
    )
    strange = F.exists("_items", lambda x: ~F.schema_of_variant(x).rlike("^OBJECT"))
    error = (
        F.when(F.col("_v").isNull(), "Parsing failed: Invalid JSON")
        .when(F.col("_items").isNull(), "Parsing failed: Root of JSON must be an object or array")
        .when(strange, "Parsing failed: JSON array contains non-object elements")
    )
    judged = shaped.withColumn("error_message", error)
    records = (
        judged.where("error_message is null")
        .select("path", F.posexplode("_items").alias("_no", "_item"))
        .select("path", (F.col("_no") + 1).cast("long").alias("record_no"), F.to_json("_item").alias("payload"))
    )
    return judged.select("path", "error_message"), records


def numbered_lines(lines: DataFrame) -> DataFrame:
    """(path, record_no, encoded, text): lines with their number in the file, split as Python's splitlines does.

    Lines keep their order within a split, so a line's number is its place there plus the number of lines of the splits
    before, one row per split.
    """
    encoded = F.is_valid_utf8("text").alias("encoded")  # to be asked before anything is done with the text
    parts = lines.select("path", "block", encoded, F.explode(F.split("text", LINE_BREAK, -1)).alias("text"))
    placed = cut_lineage(parts.withColumn("_place", F.monotonically_increasing_id()))
    splits = placed.groupBy("path", "block").agg(F.count(F.lit(1)).alias("_size"), F.min("_place").alias("_first"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_size").over(earlier), F.lit(0)) - F.col("_first") + 1
    shifts = splits.withColumn("_shift", shift).select("path", "block", "_shift")
    return placed.join(shifts, ["path", "block"]).select(
        "path", (F.col("_place") + F.col("_shift")).alias("record_no"), "encoded", "text"
    )


def read_jsonl(uploads: Uploads) -> tuple[DataFrame, DataFrame]:
    """(verdicts, records) of files with one JSON object per line; the first bad line fails the file."""
    lines = numbered_lines(uploads.lines)
    payload = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    judged = (
        lines.select("path", "record_no", "encoded", payload.alias("payload"))
        .where("payload <> '' or not encoded")
        .withColumn("_v", F.when(F.col("encoded"), F.try_parse_json("payload")))
    )
    fault = (
        F.when(~F.col("encoded"), "Unexpected error during parsing: not UTF-8")
        .when(F.col("_v").isNull(), F.concat(F.lit("Parsing failed: Invalid JSON at line "), F.col("record_no")))
        .when(~F.schema_of_variant("_v").rlike("^OBJECT"),
              F.concat(F.lit("Parsing failed: Line "), F.col("record_no"), F.lit(" does not contain a JSON object")))
    )
    judged = cut_lineage(judged.withColumn("_fault", fault).drop("_v"))
    # A file that is not text fails as such, whatever its lines hold.
    first = judged.where("_fault is not null").groupBy("path").agg(
        F.min_by("_fault", F.struct("encoded", "record_no")).alias("error_message")
    )
    good = judged.join(first.select("path"), "path", "left_anti").select("path", "record_no", "payload")
    return first, good


def _parse_csv(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of whole CSV files: the header names the cells, a missing cell is null, surplus cells go, blank lines do not count."""
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            numbers, payloads, error = [], [], None
            try:
                rows = csv.reader(io.StringIO(content.as_py().decode("utf-8"), newline=""))
                header, begins = None, 1
                for cells in rows:
                    if header is None:
                        header = cells or None
                    elif cells:
                        filled = [*cells, *[None] * (len(header) - len(cells))]
                        numbers.append(begins)
                        payloads.append(json.dumps(dict(zip(header, filled, strict=False)), ensure_ascii=False, separators=(",", ":")))
                    begins = rows.line_num + 1
            except UnicodeDecodeError:
                error = "Parsing failed: CSV parsing error: not UTF-8"
            except csv.Error as fault:
                error = f"Parsing failed: CSV parsing error: {fault}"
            if error:
                numbers, payloads = [None], [None]
            columns = [[path] * len(numbers), numbers, payloads, [error] * len(numbers)]
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string()]
            names = [part.split()[0] for part in PARSED.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def read_csv(uploads: Uploads) -> tuple[DataFrame, DataFrame]:
    """(verdicts, records) of CSV files with a header row; record_no is the line on which a record begins."""
    parsed = cut_lineage(uploads.contents.select("path", "content").mapInArrow(_parse_csv, PARSED))
    bad = parsed.where("error_message is not null")
    return bad.select("path", "error_message"), parsed.where("error_message is null").drop("error_message")


def _empty_files(spark: SparkSession, paths: list[str]) -> list[str]:
    """Files without a byte, which Spark's file scan passes over."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for text in paths:
        pattern = jvm.org.apache.hadoop.fs.Path(text)
        fs = pattern.getFileSystem(conf)
        for status in fs.globStatus(pattern) or []:
            below = fs.listFiles(status.getPath(), True)
            while below.hasNext():
                file = below.next()
                if file.getLen() == 0:
                    found.append(file.getPath().toString())
    return found


Reader = Callable[[Uploads], tuple[DataFrame, DataFrame]]


def readers() -> dict[str, Reader]:
    """The reader of each format. A further format is a further entry given to load_alerts."""
    return {"JSON": read_json, "JSONL": read_jsonl, "CSV": read_csv}


def load_alerts(spark: SparkSession, path: str | list[str], fmt: str | None = None, gate: bool = True,
                known: dict[str, Reader] | None = None, name_format: Callable[[Column, Column], Column] = detect_format):
    """(files, records) of all files under a path. `fmt` overrides detection, gate=False skips the gate.

    files: path, filename, length, format, error_message. records: path, record_no, payload. `known` and `name_format`
    replace the readers and the detection. Contents are read of files that passed the gate only, and of files without a
    known extension only if their beginning has to tell the format.
    """
    known = known or readers()
    if fmt and fmt.upper() not in known:
        raise ValueError(f"No parser available for format: {fmt}")
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    empty = _empty_files(spark, [path] if isinstance(path, str) else path)
    nothing = spark.createDataFrame([(p, 0, bytearray()) for p in empty], "path string, length bigint, content binary")
    raw = scan.select("path", "length", "content").unionByName(nothing).withColumn("filename", _file_name(F.col("path")))
    refused = gate_error(F.col("filename"), F.col("length")) if gate else F.lit(None).cast("string")
    by_name = F.lit(fmt.upper()) if fmt else name_format(F.col("filename"), F.lit(None).cast("string"))
    listed = raw.withColumn("refused", refused).withColumn("format", F.when(refused.isNull(), by_name))
    named = listed.where("refused is not null or format <> 'UNKNOWN'")
    unnamed = listed.where("refused is null and format = 'UNKNOWN'")
    if not fmt and not gate:
        preview = F.substring("content", 1, PREVIEW_BYTES).cast("string")
        unnamed = unnamed.withColumn("format", name_format(F.col("filename"), preview))
    listed = named.unionByName(unnamed)

    lines = spark.read.option("recursiveFileLookup", True)
    if not fmt:
        lines = lines.option("pathGlobFilter", LINE_FILES)
    lines = lines.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("length"), F.col("value").alias("text"),
    )
    if gate:
        lines = lines.where(gate_error(_file_name(F.col("path")), F.col("length")).isNull())

    verdicts, records = no_rows(spark, "path string, error_message string"), no_rows(spark, RECORDS)
    for kind, reader in known.items():
        if fmt and fmt.upper() != kind:
            continue
        mine = listed.where((F.col("format") == kind) & F.col("refused").isNull())
        judged, rows = reader(Uploads(mine.select("path", "content"), lines.select("path", "block", "text")))
        verdicts, records = verdicts.unionByName(judged), records.unionByName(rows)
    files = (
        listed.select("path", "filename", "length", F.coalesce("format", F.lit("UNKNOWN")).alias("format"), "refused")
        .join(verdicts, "path", "left")
        .select(
            "path", "filename", "length", "format",
            F.coalesce("refused", F.when(F.col("format") == "UNKNOWN", "Could not detect format"), "error_message")
            .alias("error_message"),
        )
    )
    return files, records
