"""Reads and clusters derived from the `events` table, in Spark's API and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagfold.operators.ordering import running_total

FROM_EVENTS = """
  SELECT read_no, bc, umi, seq, qual, MORE
    CASE WHEN mod(read_no, 50) = 0 THEN concat('junk#', cast(read_no AS string))
         ELSE concat(bc, '_', umi, '#', cast(read_no AS string)) END AS id,
    concat('read', cast(read_no AS string), '_', short_umi) AS id_umi_tools,
    concat('read', cast(read_no AS string), ':', short_umi) AS id_illumina,
    concat('read', cast(read_no AS string)) AS read_id
  FROM (
    SELECT event_id AS read_no, MORE
      substr(translate(md5(concat('bc', cast(user_id AS string))), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 16) AS bc,
      substr(translate(md5(concat('umi', event_type, cast(mod(event_id, 7) AS string))), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 12) AS umi,
      substr(translate(md5(concat('s', cast(event_id AS string))), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 3) AS short_umi,
      substr(concat(translate(md5(concat('s1', cast(event_id AS string))), '0123456789abcdef', 'ACGTACGTACGTACGT'),
                    translate(md5(concat('s2', cast(event_id AS string))), '0123456789abcdef', 'ACGTACGTACGTACGT')),
             1, cast(20 + mod(event_id, 45) AS int)) AS seq,
      substr(concat(translate(md5(concat('q1', cast(event_id AS string))), '0123456789abcdef', '!#%)+-/1357:<>@I'),
                    translate(md5(concat('q2', cast(event_id AS string))), '0123456789abcdef', '!#%)+-/1357:<>@I')),
             1, cast(20 + mod(event_id, 45) AS int)) AS qual
    FROM events
  ) k
"""

ROWS_SQL = f"SELECT *, cast(length(id) + length(seq) + length(qual) + 6 AS bigint) AS rec_len FROM ({FROM_EVENTS.replace('MORE', '')}) r"

#: The same length without the texts, so that positions are summed over numbers alone.
REC_LEN = """cast(CASE WHEN mod(event_id, 50) = 0 THEN 5 ELSE 30 END + length(cast(event_id AS string)) + 2 * (20 + mod(event_id, 45)) + 6 AS bigint)"""

READS_SQL = f"""
SELECT *, cast(coalesce(sum(rec_len) OVER (ORDER BY read_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS pos
FROM ({ROWS_SQL}) l
"""

#: Reads whose sequence depends on their barcode and UMI alone, 30 bases each.
EQUAL_SEQ = "substr(translate(md5(concat('t', bc, umi)), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 30)"
EQUAL_QUAL = "substr(concat(qual, '555555555555'), 1, 30)"

CLUSTERS_SQL = """
SELECT read_no AS line_no, read_id, concat(bc, '_', umi) AS identifier FROM reads WHERE mod(read_no, 50) <> 0
UNION ALL
SELECT read_no + 1000000, read_id, concat(bc, '_AAAACCCCGGGG') FROM reads WHERE mod(read_no, 50) = 1
"""

#: Reads in a range of the running byte position.
RANGE_READS = 8192


def reads(spark: SparkSession, sf_dir: str, header: str = "id") -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", F.expr(REC_LEN).alias("rec_len"))
    placed = running_total(events, "event_id", F.col("rec_len"), RANGE_READS, "pos")
    rows = spark.sql(FROM_EVENTS.replace("MORE", "rec_len, pos,").replace("FROM events", "FROM {events}"), events=placed)
    return rows if header == "id" else rows.drop("id").withColumnRenamed(header, "id")


def equal_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).withColumn("seq", F.expr(EQUAL_SEQ)).withColumn("qual", F.expr(EQUAL_QUAL))


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CLUSTERS_SQL.replace("FROM reads", "FROM {reads}"), reads=reads(spark, sf_dir))
