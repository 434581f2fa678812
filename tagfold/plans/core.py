"""Queries over the fixture reads, and the same in DuckDB's SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagfold import jobs
from tagfold.functions.intervals import Interval
from tagfold.functions.scalars import fastq_lines, phred_average, phred_total
from tagfold.operators import index as ix
from tagfold.operators.consensus import call_consensus, call_headers
from tagfold.operators.groups import kept_index, kept_of, number_groups, tag_groups
from tagfold.operators.stats import duplicate_stats, group_sizes, size_histogram
from tagfold.plans import fixture
from tagfold.shared import new_folder
from tagfold.sources.fastq import read_fastq, write_fasta, write_fastq
from tagfold.sources.index_file import read_index_file

LEN, QUAL = Interval.parse("22,60"), Interval.parse("15,24")
VARYING = r"^([ATCG]{16})_([ATCG]{6})(T)?"
CUSTOM = r"^([ATCG]{4})[ATCG]{12}_([ATCG]{6})([ATCG]{99})?"


def build(spark: SparkSession, d: str, preset: str = "bc-umi", header: str = "id", length=LEN, quality=QUAL, **more) -> ix.IndexResult:
    return ix.build_index(fixture.reads(spark, d, header), None if more else preset, length=length, quality=quality, skip_unmatched=True, check=False, **more)


INDEX = ("id", "pos", "avg_qual", "n_bases", "rec_len", "ignored")


def _metadata(spark, d):
    return build(spark, d).metadata


def _group_keys(spark, d, exact):
    index = build(spark, d, "umi-tools", "id_umi_tools").index
    return group_sizes(index, exact)


def _kept(spark, d):
    """Kept reads after one pass over the source."""
    return kept_of(build(spark, d, once=True))


def _headers(spark, d, **more):
    return call_headers(_kept(spark, d), **more).withColumn("kind", F.col("kind").cast("long"))


def _consensus(spark, d):
    return call_consensus(_kept(spark, d))


def _equal(spark, d):
    """Consensus of groups whose reads are equal but for their qualities."""
    index = ix.build_index(fixture.equal_reads(spark, d), "bc-umi", skip_unmatched=True, check=False, once=True)
    return call_consensus(kept_of(index)).select("ug", "id", "seq", "qual")


def _tags(spark, d):
    return tag_groups(_kept(spark, d))


def _quality(spark, d):
    return number_groups(kept_index(build(spark, d).index))


def _phred(spark, d):
    r = fixture.reads(spark, d)
    total = phred_total(F.col("qual"))
    return r.select("read_no", total.alias("total_q"), phred_average(total, F.length("seq")).alias("avg_qual"))


def _stats(spark, d):
    s = duplicate_stats(build(spark, d).index)
    return s.select("total_reads", "duplicate_reads", "duplicate_ids", "proportion_duplicate")


def _lines(spark, d):
    r = fixture.reads(spark, d)
    return r.select("pos", fastq_lines(F.col("id"), F.col("seq"), F.col("qual")).alias("record"))


def read_files(spark, d, write=write_fastq, kind="reads"):
    """The fixture reads as several files in the shared folder, in order of their names."""
    path = new_folder(spark, kind)
    write(fixture.reads(spark, d), path, ("read_no",))
    return path


def _index_file(spark, d, **more):
    """An index file made from read files, and its metadata."""
    out = new_folder(spark, "index.tsv")
    meta = jobs.index(spark, read_files(spark, d), out, skip_unmatched=True, length=LEN, quality=QUAL, **more)
    return out, meta


def _file_clusters(spark, d):
    path = new_folder(spark, "clusters")
    lines = fixture.clusters(spark, d).join(fixture.reads(spark, d).select("read_id", F.col("id").alias("header")), "read_id")
    text = F.concat_ws(";", "header", F.substring_index("identifier", "_", 1), F.substring_index("identifier", "_", -1))
    lines.orderBy("line_no").select(text).write.text(path)
    return read_index_file(spark, _index_file(spark, d, clusters=path)[0])[1]


def _file_metadata(spark, d):
    counts = ("read_count", "matched_read_count", "unmatched_read_count", "filtered_reads", "avg_qual", "avg_len", "gb")
    meta = _index_file(spark, d)[1]
    return spark.createDataFrame([tuple(meta[x] for x in counts)], ", ".join(f"{x} {'long' if k < 4 else 'double'}" for k, x in enumerate(counts)))


def _file_report(spark, d):
    out = new_folder(spark, "report")
    report = jobs.summarise(spark, _index_file(spark, d)[0], f"{out}.html", f"{out}.json")
    stats = report["stats"]
    sizes = ",".join(f"{k}:{v}" for k, v in stats["distribution"].items())
    row = (report["gb"], stats["total_reads"], stats["duplicate_reads"], stats["duplicate_ids"], sizes, max(map(int, stats["distribution"])))
    return spark.createDataFrame([row], "gb string, total_reads long, duplicate_reads long, duplicate_ids long, distribution string, largest long")


def _file_order(spark, d):
    """Line by line, as one file is short here."""
    path = _index_file(spark, d)[0]
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.trim("value", F.lit("\n")), "\n")).alias("line", "text"))
    fields = F.split("text", "\t")
    return lines.where("line > 1").select(F.col("line").cast("long"), fields[0].alias("id"), fields[1].cast("long").alias("pos"))


def _file_page(spark, d):
    """The bars of the page's two charts."""
    out = new_folder(spark, "report")
    jobs.summarise(spark, _index_file(spark, d)[0], f"{out}.html")
    charts = spark.read.text(f"{out}.html", wholetext=True).first()[0].split("<h2>")[1:]
    rows = [(c.split("</h2>")[0], int(k), int(v)) for c in charts for k, v in re.findall(r"<tr><td>(\d+)</td>.*?<td>(\d+)</td></tr>", c)]
    return spark.createDataFrame(rows, "chart string, size long, value long")


def _captures(spark, d):
    return ix.match_facts(build(spark, d, barcode_regex=VARYING).marked).select("header", "unmatched", *(F.col(x).cast("long") for x in ("least", "most")))


def _file_group(spark, d):
    reads, out = read_files(spark, d), new_folder(spark, "tagged")
    index = new_folder(spark, "index.tsv")
    jobs.index(spark, reads, index, skip_unmatched=True, length=LEN, quality=QUAL)
    jobs.group(spark, index, reads, out)
    return read_fastq(spark, out).select("id", "seq", "qual", "pos")


def _file_call(spark, d):
    reads, out = read_files(spark, d), new_folder(spark, "called")
    index = new_folder(spark, "index.tsv")
    jobs.index(spark, reads, index, skip_unmatched=True, length=LEN, quality=QUAL)
    jobs.call(spark, index, reads, out, report_original_reads=True)
    return read_fastq(spark, out).select("id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    free = Interval()
    return {
        "index_bc_umi": lambda s, d: build(s, d).index,
        "index_umi_tools": lambda s, d: build(s, d, "umi-tools", "id_umi_tools").index,
        "index_illumina": lambda s, d: build(s, d, "illumina", "id_illumina").index,
        "index_custom_regex": lambda s, d: build(s, d, barcode_regex=CUSTOM).index,
        "index_clusters": lambda s, d: build(s, d, header="read_id", clusters=fixture.clusters(s, d)).index,
        "index_skip_unmatched": lambda s, d: build(s, d, length=(0, 15000), quality=(0, float("inf"))).index,
        "filter_len": lambda s, d: build(s, d, quality=free).index.where("ignored").select("pos", "n_bases"),
        "filter_qual": lambda s, d: build(s, d, length=free).index.where("ignored").select("pos", "avg_qual"),
        "filter_len_qual": lambda s, d: build(s, d).index.where("not ignored").select("pos", "n_bases", "avg_qual"),
        "index_metadata": _metadata,
        "phred_avg": _phred,
        "duplicate_stats": _stats,
        "duplicate_histogram": lambda s, d: size_histogram(build(s, d).index).select("n", "groups"),
        "reads_by_group_size": lambda s, d: size_histogram(build(s, d).index).select("n", "reads"),
        "group_key_collapse": lambda s, d: _group_keys(s, d, False),
        "group_key_exact": lambda s, d: _group_keys(s, d, True),
        "group_tags": _tags,
        "group_quality": _quality,
        "call_headers": _headers,
        "call_headers_duplicates_only": lambda s, d: _headers(s, d, duplicates_only=True),
        "call_originals": lambda s, d: _headers(s, d, report_original_reads=True),
        "fastq_lines": _lines,
        "call_consensus": _consensus,
        "call_equal_reads": _equal,
        "fastq_scan": lambda s, d: read_fastq(s, read_files(s, d)),
        "fasta_scan": lambda s, d: read_fastq(s, read_files(s, d, write_fasta)).select("id", "seq", "qual", "pos", "rec_len"),
        "fastq_index": lambda s, d: read_index_file(s, _index_file(s, d)[0])[1],
        "fastq_clusters_file": _file_clusters,
        "fastq_metadata": _file_metadata,
        "fastq_summary": _file_report,
        "summary_page": _file_page,
        "index_file_order": _file_order,
        "capture_check": _captures,
        "fastq_group": _file_group,
        "fastq_call": _file_call,
    }


def oracle_sql() -> dict[str, str]:
    total = "cast(coalesce(list_sum(list_transform(string_split(qual, ''), lambda c: ascii(c) - 33)), 0) AS bigint)"
    avg = "round(cast(total_q AS double) / n_bases * 100.0) / 100.0"

    def marked(length="n_bases > 22 AND n_bases < 60", quality="avg_qual > 15 AND avg_qual < 24") -> str:
        return f"""reads AS ({fixture.READS_SQL}),
          t AS (SELECT *, {total} AS total_q, cast(length(seq) AS bigint) AS n_bases FROM reads),
          a AS (SELECT *, {avg} AS avg_qual FROM t),
          m AS (SELECT *, NOT (({length}) AND ({quality})) AS ignored FROM a)"""

    def ident(header: str, pattern: str, groups: int) -> str:
        text = " || '_' || ".join(f"regexp_extract({header}, '{pattern}', {g + 1})" for g in range(groups))
        return f"CASE WHEN regexp_matches({header}, '{pattern}') THEN {text} END"

    bc = ident("id", "^([ATCG]{16})_([ATCG]{12})", 2)
    cols = "identifier AS id, pos, avg_qual, n_bases, rec_len, ignored"

    def idx(identifier=bc, **k) -> str:
        return f"WITH {marked(**k)}, i AS (SELECT *, {identifier} AS identifier FROM m), idx AS (SELECT {cols} FROM i WHERE identifier IS NOT NULL)"

    key = "CASE WHEN instr(id, '_') IN (0, length(id)) THEN substr(id, 1, length(id) - 1) ELSE id END"
    sizes = f"sizes AS (SELECT {key} AS gkey, count(*) AS n FROM idx WHERE NOT ignored GROUP BY 1)"
    hist = f"{sizes}, h AS (SELECT n, cast(sum(g) AS bigint) AS groups FROM (SELECT n, count(*) AS g FROM sizes GROUP BY n UNION ALL SELECT 1, 0) GROUP BY n)"
    grouped = f"""kept AS (SELECT idx.*, {key} AS gkey FROM idx WHERE NOT ignored),
      g AS (SELECT gkey, count(*) AS n, min(pos) AS first_pos,
                   list_reduce(list_prepend(0.0::double, list(avg_qual ORDER BY pos)), lambda x, y: x + y) / count(*) AS quality
            FROM kept GROUP BY gkey)"""
    ranked = f"{grouped}, u AS (SELECT *, row_number() OVER (ORDER BY first_pos) - 1 AS ug FROM g)"
    rows = "w AS (SELECT k.pos, k.gkey, u.n, u.ug, u.quality, row_number() OVER (PARTITION BY k.gkey ORDER BY k.pos) AS i, r.id AS header, r.seq, r.qual FROM kept k JOIN u USING (gkey) JOIN reads r ON r.pos = k.pos)"
    con = "SELECT ug, 1::bigint AS kind, 0::bigint AS i, gkey || ' UT:Z:CON_' || n || ' UG:i:' || ug || ' QL:f:' || printf('%.2f', quality) AS id FROM u WHERE n > 1"
    sin = "SELECT ug, 1::bigint AS kind, 0::bigint AS i, header || ' UT:Z:SIN UG:i:' || ug || ' QL:f:' || printf('%.2f', quality) AS id FROM w WHERE n = 1"
    orig = "SELECT ug, 0::bigint AS kind, i, header || ' UT:Z:ORIG_' || i || '_OF_' || n || ' UG:i:' || ug AS id FROM w WHERE n > 1"
    q = {
        "index_bc_umi": f"{idx()} SELECT * FROM idx",
        "index_umi_tools": f"{idx(ident('id_umi_tools', '_([ATCG]+)$', 1))} SELECT * FROM idx",
        "index_illumina": f"{idx(ident('id_illumina', ':([ATCG]+)$', 1))} SELECT * FROM idx",
        "index_custom_regex": f"{idx(ident('id', '^([ATCG]{4})[ATCG]{12}_([ATCG]{6})', 2))} SELECT * FROM idx",
        "index_clusters": f"""WITH {marked()}, clusters AS ({fixture.CLUSTERS_SQL}),
            last AS (SELECT read_id, arg_max(identifier, line_no) AS identifier FROM clusters GROUP BY read_id)
            SELECT last.identifier AS id, pos, avg_qual, n_bases, rec_len, ignored FROM m JOIN last USING (read_id)""",
        "index_skip_unmatched": f"{idx(length='n_bases > 0 AND n_bases < 15000', quality='avg_qual > 0')} SELECT * FROM idx",
        "filter_len": f"{idx(quality='true')} SELECT pos, n_bases FROM idx WHERE ignored",
        "filter_qual": f"{idx(length='true')} SELECT pos, avg_qual FROM idx WHERE ignored",
        "filter_len_qual": f"{idx()} SELECT pos, n_bases, avg_qual FROM idx WHERE NOT ignored",
        "index_metadata": f"""WITH {marked()}, i AS (SELECT *, {bc} AS identifier FROM m)
            SELECT count(*) AS read_count, count(identifier) AS matched_read_count, count(*) - count(identifier) AS unmatched_read_count,
              count(*) FILTER (ignored) AS filtered_reads,
              cast(sum(total_q) FILTER (identifier IS NOT NULL) AS double) / count(identifier) AS avg_qual,
              cast(sum(n_bases) FILTER (identifier IS NOT NULL) AS double) / count(identifier) AS avg_len,
              max(pos + rec_len) / 1073741824.0::double AS gb FROM i""",
        "phred_avg": f"WITH {marked()} SELECT read_no, total_q, avg_qual FROM m",
        "duplicate_stats": f"""{idx()}, {sizes} SELECT cast(sum(n) AS bigint) AS total_reads, cast(coalesce(sum(n) FILTER (n > 1), 0) AS bigint) AS duplicate_reads,
            count(*) FILTER (n > 1) AS duplicate_ids, cast(coalesce(sum(n) FILTER (n > 1), 0) AS double) / cast(sum(n) AS double) AS proportion_duplicate FROM sizes""",
        "duplicate_histogram": f"{idx()}, {hist} SELECT n, groups FROM h",
        "reads_by_group_size": f"{idx()}, {hist} SELECT n, n * groups AS reads FROM h",
        "group_key_collapse": f"{idx(ident('id_umi_tools', '_([ATCG]+)$', 1))}, {sizes} SELECT * FROM sizes",
        "group_key_exact": f"{idx(ident('id_umi_tools', '_([ATCG]+)$', 1))} SELECT id AS gkey, count(*) AS n FROM idx WHERE NOT ignored GROUP BY id",
        "group_tags": f"{idx()}, {ranked}, {rows} SELECT ug, i, header || ' UT:Z:ORIG_' || i || '_OF_' || n || ' UG:i:' || ug AS id, seq, qual FROM w",
        "group_quality": f"{idx()}, {ranked} SELECT gkey, n, ug, quality FROM u",
        "call_headers": f"{idx()}, {ranked}, {rows} {con} UNION ALL {sin}",
        "call_headers_duplicates_only": f"{idx()}, {ranked.replace('FROM g)', 'FROM g WHERE n > 1)')} {con}",
        "call_originals": f"{idx()}, {ranked}, {rows} {con} UNION ALL {sin} UNION ALL {orig}",
        "fastq_scan": f"WITH {marked()} SELECT id, seq, qual, pos, rec_len, total_q FROM m",
        "fasta_scan": f"""WITH reads AS ({fixture.READS_SQL}), l AS (SELECT read_no, id, seq, '' AS qual, cast(length(id) + length(seq) + 3 AS bigint) AS rec_len FROM reads)
            SELECT id, seq, qual, rec_len, cast(coalesce(sum(rec_len) OVER (ORDER BY read_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS pos FROM l""",
        "fastq_group": f"""{idx()}, {ranked}, {rows}, o AS (SELECT ug, i, header || ' UT:Z:ORIG_' || i || '_OF_' || n || ' UG:i:' || ug AS id, seq, qual FROM w)
            SELECT id, seq, qual, cast(coalesce(sum(length(id) + length(seq) + length(qual) + 6) OVER (ORDER BY ug, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS pos FROM o""",
        "fastq_call": f"{idx()}, {ranked}, {rows} SELECT id FROM ({con} UNION ALL {sin} UNION ALL {orig})",
        "fastq_summary": f"""{idx()}, {hist}
            SELECT printf('%.3f', (SELECT max(pos + rec_len) FROM reads) / 1073741824.0::double) AS gb, cast(sum(n * groups) AS bigint) AS total_reads,
              cast(coalesce(sum(n * groups) FILTER (n > 1), 0) AS bigint) AS duplicate_reads, cast(coalesce(sum(groups) FILTER (n > 1), 0) AS bigint) AS duplicate_ids,
              string_agg(n || ':' || groups, ',' ORDER BY n) AS distribution, max(n) AS largest FROM h""",
        "summary_page": f"{idx()}, {hist} SELECT 'Groups by size' AS chart, n AS size, groups AS value FROM h UNION ALL SELECT 'Reads by group size', n, n * groups FROM h",
        "index_file_order": f"{idx()} SELECT row_number() OVER (ORDER BY pos) + 1 AS line, id, pos FROM idx",
        "capture_check": f"""WITH {marked()}, x AS (SELECT id, pos, regexp_matches(id, '^[ATCG]{{16}}_[ATCG]{{6}}') AS hit, 2 + regexp_matches(id, '^[ATCG]{{16}}_[ATCG]{{6}}T')::bigint AS n FROM m)
            SELECT min_by(id, pos) FILTER (NOT hit) AS header, count(*) FILTER (NOT hit) AS unmatched, min(n) FILTER (hit) AS least, max(n) FILTER (hit) AS most FROM x""",
        "fastq_lines": f"WITH reads AS ({fixture.READS_SQL}) SELECT pos, '@' || id || chr(10) || seq || chr(10) || '+' || chr(10) || qual AS record FROM reads",
    }
    # a base's quality is the rounded mean of its reads', an even half rounded to the even number
    every = idx(length="n_bases > 0 AND n_bases < 15000", quality="avg_qual > 0").replace(fixture.READS_SQL, f"SELECT * REPLACE ({fixture.EQUAL_SEQ} AS seq, {fixture.EQUAL_QUAL} AS qual) FROM ({fixture.READS_SQL})")
    q["call_equal_reads"] = f"""{every}, {ranked}, {rows}, b AS (SELECT gkey, x, round_even(sum(ascii(substr(qual, x::int, 1)) - 33)::double / count(*), 0)::int AS q FROM w, range(1, 31) t(x) GROUP BY gkey, x),
      mq AS (SELECT gkey, string_agg(chr(33 + q), '' ORDER BY x) AS qual FROM b GROUP BY gkey), sq AS (SELECT gkey, min(seq) AS seq FROM w GROUP BY gkey)
      SELECT c.ug, c.id, CASE WHEN u.n > 1 THEN sq.seq ELSE w.seq END AS seq, CASE WHEN u.n > 1 THEN mq.qual ELSE w.qual END AS qual FROM ({con} UNION ALL {sin}) c JOIN u ON u.ug = c.ug JOIN mq ON mq.gkey = u.gkey JOIN sq ON sq.gkey = u.gkey
        JOIN w ON w.gkey = u.gkey AND w.i = 1"""
    # the same read files, index and clusters, by way of files
    q["fastq_index"], q["fastq_metadata"], q["fastq_clusters_file"] = q["index_bc_umi"], q["index_metadata"], q["index_clusters"]
    return q
