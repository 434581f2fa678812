"""Index as text, and the cluster file.

The single file has a `#` line of JSON, a header line, and tab-separated rows in file order. `write_index` gives the same
as a folder: `metadata` (one JSON line) and `rows` (parts with a header line each). Parquet is the native form: write
`IndexResult.index` as it is.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagfold.operators.index import IndexResult
from tagfold.schemas import INDEX, METADATA
from tagfold.shared import new_folder, remove_folder
from tagfold.sources.fastq import list_files, open_store

COPY_BYTES = 8 << 20


def metadata_json(result: IndexResult, facts: dict) -> str:
    """All fields of `METADATA`, in its order; what neither the index nor the facts know is null."""
    known = result.metadata.first().asDict() | facts
    return json.dumps({x: known.get(x) for x in METADATA.names} | {k: v for k, v in facts.items() if k not in METADATA.names})


def write_index(result: IndexResult, path: str, **facts) -> None:
    spark = result.index.sparkSession
    result.index.orderBy("pos").write.csv(f"{path}/rows", sep="\t", header=True)
    spark.createDataFrame([(metadata_json(result, facts),)], "value string").coalesce(1).write.text(f"{path}/metadata")


def write_index_file(result: IndexResult, path: str, **facts) -> dict:
    """The single file, and its metadata. Sorted parts are written by tasks and appended to each other by the driver, a
    few megabytes at a time, as one file has one writer."""
    spark = result.index.sparkSession
    parts = new_folder(spark, "index")
    result.index.orderBy("pos").write.csv(parts, sep="\t")
    meta = metadata_json(result, facts)
    store, inner = open_store(path)
    with store.open_output_stream(inner) as out:
        out.write(f"#{meta}\n{chr(9).join(INDEX.names)}\n".encode())
        for part, _ in list_files(parts):
            source, at = open_store(part)
            with source.open_input_stream(at) as rows:
                while piece := rows.read(COPY_BYTES):
                    out.write(piece)
    remove_folder(spark, parts)
    return json.loads(meta)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).csv(f"{path}/rows", sep="\t", header=True)


def read_metadata(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/metadata").first()[0])


def read_index_file(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """The single-file form. Only the first line is metadata: an identifier may itself begin with `#`. Fields may be quoted,
    as the writer quotes those that need it."""
    first = spark.read.text(path).first()
    if first is None or not first[0].startswith("#"):
        raise ValueError(f"{path}: the first line is not metadata")
    lines = spark.read.text(path).where((F.col("value") != first[0]) & (F.col("value") != "\t".join(INDEX.names)) & (F.col("value") != ""))
    parsed = F.from_csv("value", INDEX.simpleString()[len("struct<") : -1].replace(":", " "), {"sep": "\t"})
    return json.loads(first[0][1:]), lines.select(parsed.alias("r")).select("r.*")


class ClusterError(ValueError):
    pass


def parse_clusters(lines: DataFrame) -> DataFrame:
    """lines: line_no, value. Two or three fields by `;`, the same number in all; blank lines are skipped."""
    parts = F.split("value", ";")
    rows = lines.where(F.col("value") != "").withColumn("_p", parts)
    text = F.when(F.size("_p") == 3, F.concat_ws("_", F.col("_p")[1], F.try_element_at("_p", F.lit(3)))).otherwise(F.col("_p")[1])
    checked = F.when(F.size("_p").between(2, 3), text).otherwise(
        F.raise_error(F.concat(F.lit("a cluster row needs two or three fields: "), F.col("value"))).cast("string")
    )
    return rows.select("line_no", F.col("_p")[0].alias("read_id"), checked.alias("identifier"), F.size("_p").alias("n_fields"))


def read_clusters(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """line_no orders lines by file name, place in the file and line; the last line of a read wins."""
    at = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select("value", at.alias("line_no"))
    rows = parse_clusters(lines)
    if check and rows.agg(F.count_distinct("n_fields")).first()[0] > 1:
        raise ClusterError(f"{path}: rows of two and of three fields are mixed")
    return rows.drop("n_fields")
