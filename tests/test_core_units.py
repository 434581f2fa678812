import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagfold.functions.intervals import Interval
from tagfold.functions.scalars import group_key, phred_average, phred_total, two_decimals
from tagfold.operators import index as ix
from tagfold.operators.consensus import call_consensus
from tagfold.operators.groups import kept_of, kept_reads, tag_groups
from tagfold.operators import poa
from tagfold.operators.poa import consensus
from tagfold.operators.stats import duplicate_stats
from tagfold.sources import fastq as fastq_files
from tagfold.sources.fastq import read_fastq, read_range, write_fastq
from tagfold.sources.index_file import parse_clusters, read_clusters, read_index, read_index_file, read_metadata, write_index, write_index_file
from tagfold.sources.report import render, summary

READS = "id string, seq string, qual string, pos long, rec_len long"
T = "ACGTTGCAACGGTCATTGACCGATAGGCTTAACGTC"


def test_interval():
    assert Interval.parse(" -INF , 3") == Interval(-math.inf, 3)
    for bad in ("1", "1,2,3", "a,2", "1,b"):
        with pytest.raises(ValueError):
            Interval.parse(bad)


def test_bounds_are_open(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (math.nan,)], "x double")
    assert [r[0] for r in df.where(Interval(0, 2).contains(F.col("x"))).collect()] == [1.0]
    assert df.where(Interval(math.nan, 2).contains(F.col("x"))).count() == 0


def test_phred(spark):
    df = spark.createDataFrame([("I!", 2), ("", 0)], "q string, n int")
    t = phred_total(F.col("q"))
    rows = df.select(t.alias("t"), phred_average(t, F.col("n")).alias("a")).collect()
    assert (rows[0]["t"], rows[0]["a"], rows[1]["t"]) == (40, 20.0, 0) and math.isnan(rows[1]["a"])


def test_group_key(spark):
    df = spark.createDataFrame([("ACG",), ("A_C",), ("AC_",), ("_A",)], "id string")
    assert [r[0] for r in df.select(group_key(F.col("id"))).collect()] == ["AC", "A_C", "AC", "_A"]


def test_two_decimals(spark):
    df = spark.createDataFrame([(0.125,), (2.675,), (1.005,)], "x double")
    assert [r[0] for r in df.select(two_decimals("x")).collect()] == ["0.12", "2.67", "1.00"]


def _reads(spark):
    rows = [("AAAACCCCGGGGTTTT_AAAACCCCGGGG#1", T, "I" * len(T), 0, 90), ("AAAACCCCGGGGTTTT_AAAACCCCGGGG#2", T, "I" * len(T), 90, 90),
            ("junk", T, "I" * len(T), 180, 90), ("AAAACCCCGGGGTTTT_AAAACCCCGGGT#3", T, "I" * len(T), 270, 90),
            ("AAAACCCCGGGGTTTT_AAAACCCCGGGT#4", "", "", 360, 40)]
    return spark.createDataFrame(rows, READS)


def test_strict_and_skip(spark):
    with pytest.raises(ix.UnmatchedReads, match="junk"):
        ix.build_index(_reads(spark))
    with pytest.raises(ValueError):
        ix.build_index(_reads(spark), "bc-umi", barcode_regex="(A)")
    with pytest.raises(ValueError):
        ix.build_index(_reads(spark), barcode_regex="A")
    with pytest.raises(ix.UnequalCaptures):
        ix.build_index(_reads(spark), barcode_regex="(^AAAA).*#([12])?|(junk)")


def test_calls(spark):
    reads = _reads(spark)
    r = ix.build_index(reads, skip_unmatched=True)
    assert r.metadata.first()["unmatched_read_count"] == 1 and r.metadata.first()["filtered_reads"] == 1
    out = call_consensus(kept_reads(reads, r.index), report_original_reads=True).orderBy("ug", "kind", "i").collect()
    assert [x["id"].split(" ")[1] for x in out] == ["UT:Z:ORIG_1_OF_2", "UT:Z:ORIG_2_OF_2", "UT:Z:CON_2", "UT:Z:SIN"]
    assert out[2]["seq"] == T and out[2]["qual"] == "I" * len(T)
    assert tag_groups(kept_of(r)).count() == 3
    assert [x["ug"] for x in call_consensus(kept_of(r), duplicates_only=True).collect()] == [0]
    with pytest.raises(Exception, match="max_group_reads"):
        call_consensus(kept_of(r), max_group_reads=1).collect()


def test_empty_statistics(spark):
    empty = spark.createDataFrame([], "id string, pos long, avg_qual double, n_bases long, rec_len long, ignored boolean")
    s = duplicate_stats(empty).first()
    assert s["distribution"] == {1: 0} and math.isnan(s["proportion_duplicate"])


@pytest.mark.parametrize("edit", [T, T[:10] + "T" + T[11:], T[:10] + T[11:], T[:10] + "G" + T[10:], T[:12] + T[17:]])
def test_consensus_corrects_one_read(edit):
    for order in ((T, T, edit), (edit, T, T), (T, edit, T)):
        seq, qual = consensus([(s, "I" * len(s)) for s in order])
        assert seq == T and len(qual) == len(T)


def test_consensus_of_pair_and_fragments():
    pair = [(T, "I" * len(T)), (T[:5] + "A" + T[6:], "5" * len(T))]
    assert consensus(pair) == consensus(pair)
    assert consensus([(T[:25], "I" * 25), (T[8:], "I" * len(T[8:]))])[0] == T
    assert consensus([("", ""), (T, "I" * len(T))])[0] == T
    assert consensus([("", ""), ("", "")]) == ("", "")


def _branched(rng, n):
    """A graph as reads make it, with several ways through, and its bases."""
    g = poa.Graph()
    bases = rng.choice(list(b"ACGT"), n)
    last = None
    for b in bases:
        v = g.add_node(int(b), None)
        if last is not None:
            g.add_edge(last, v, 1)
        last = v
    for _ in range(n // 3):
        u, v = sorted(rng.choice(n, 2, replace=False).tolist())
        if v - u > 1:
            w = g.add_node(int(rng.choice(list(b"ACGT"))), None)
            g.add_edge(u, w, 1)
            g.add_edge(w, v, 1)
    return g


def _slow_overlap(g, read):
    """Best score of an overlap, cell by cell. States: 0 both, 1 and 2 gaps in the read, 3 and 4 gaps in the graph."""
    low = -(10**9)
    best, cells = 0, {}
    after = {u for p in g.before for u in p}
    start = [[0, low, low, low, low] for _ in range(len(read) + 1)]
    for v in g.order():
        rows = [cells[u] for u in g.before[v]] or [start]
        row = []
        for j in range(len(read) + 1):
            both = 0 if j == 0 else max(max(r[j - 1]) for r in rows) + (poa.MATCH if read[j - 1] == g.base[v] else poa.MISMATCH)
            cell = [both]
            for k, (o, e) in enumerate(poa.GAPS):
                cell.append(max(max(max(r[j]) + o, r[j][1 + k] + e) for r in rows))
            for k, (o, e) in enumerate(poa.GAPS):
                cell.append(low if j == 0 else max(max(row[-1]) + o, row[-1][3 + k] + e))
            row.append(cell)
            if j == len(read) or v not in after:
                best = max(best, max(cell))
        cells[v] = row
    return best


def _score_of(g, read, pairs):
    """Score of an alignment, which must be an overlap through the graph."""
    total, gap, last_v, last_j, after = 0, None, None, None, {u for p in g.before for u in p}
    runs = []
    for v, j in pairs:
        if v is not None:
            assert last_v is None or last_v in g.before[v]
            last_v = v
        if j is not None:
            assert last_j is None or j == last_j + 1
            last_j = j
        kind = "v" if j is None else "j" if v is None else None
        if kind is None:
            total += poa.MATCH if g.base[v] == read[j] else poa.MISMATCH
        elif kind == gap:
            runs[-1] += 1
        else:
            runs.append(1)
        gap = kind
    if pairs:
        nodes, places = [v for v, _ in pairs if v is not None], [j for _, j in pairs if j is not None]
        assert not nodes or not places or not g.before[nodes[0]] or places[0] == 0
        assert not nodes or not places or nodes[-1] not in after or places[-1] == len(read) - 1
    return total + sum(max(o + (n - 1) * e for o, e in poa.GAPS) for n in runs)


def test_alignment_is_the_best_overlap():
    rng = np.random.default_rng(5)
    for turn in range(1000):
        g = _branched(rng, int(rng.integers(1, 14)))
        if turn % 2:
            read = rng.choice(list(b"ACGT"), rng.integers(1, 14)).astype(np.uint8)
        else:  # a way through the graph with errors
            path = [b for b in g.base if rng.random() > 0.2] or [65]
            read = np.array([b if rng.random() > 0.1 else int(rng.choice(list(b"ACGT"))) for b in path], np.uint8)
        pairs = poa._align(g, read)
        assert pairs == poa._align(g, read, 0)
        assert _score_of(g, read, pairs) == _slow_overlap(g, read), turn


FASTQ = b"@a\nAC\n+\n@I\n@b x\nACGT\n+b\nIIII\n@c\n\n+\n\n@d\nA\n+\n@"


@pytest.mark.parametrize("split", [1, 3, 7, 1000])
def test_fastq_splits(spark, tmp_path, split):
    p = tmp_path / "x.fastq"
    p.write_bytes(FASTQ)
    rows = sorted(map(tuple, read_fastq(spark, str(p), split).collect()), key=lambda r: r[3])
    assert [r[:3] for r in rows] == [("a", "AC", "@I"), ("b x", "ACGT", "IIII"), ("c", "", ""), ("d", "A", "@")]
    assert [r[3] for r in rows] == [0, 11, 29, 36] and rows[-1][3] + rows[-1][4] == len(FASTQ) + 1


def _range(p, start=0, end=1000):
    return [tuple(r.values()) for b in read_range(str(p), start, end) for r in b.to_pylist()]


def test_fastq_errors(tmp_path):
    for k, bad in enumerate((b"@a\nAC\n+\nI\n", b"@a\nAC\nx\nII\n", b"a\nAC\n+\nII\n", b"@\xff\nA\n+\nI\n", b"@a\nAC\n+\n", b"@a\nAC\n+\nII\n\n\n\n\n@b\nA\n+\nI\n")):
        p = tmp_path / str(k)
        p.write_bytes(bad)
        with pytest.raises(ValueError):
            _range(p)
    p = tmp_path / "cr"
    p.write_bytes(b"@a\r\nAC\r\n+\r\nII\r\n")
    assert _range(p) == [("a", "AC", "II", 0, 15, 80)]


@pytest.mark.parametrize("chunk", [1, 2, 5, 11, 1 << 20])
@pytest.mark.parametrize("split", [1, 2, 5, 1000])
def test_chunks_and_splits_of_files(tmp_path, monkeypatch, chunk, split):
    monkeypatch.setattr(fastq_files, "CHUNK_BYTES", chunk)

    def rows(data):
        p = tmp_path / "x"
        p.write_bytes(data)
        return [r for a in range(0, len(data), split) for r in _range(p, a, min(len(data), a + split))]

    assert [r[:3] for r in rows(FASTQ)] == [("a", "AC", "@I"), ("b x", "ACGT", "IIII"), ("c", "", ""), ("d", "A", "@")]
    assert len(rows(b"@a\nAC\n+\nII\n" + b"\n" * 9)) == 1
    assert [r[0] for r in rows(b"@a\nAC\n+\nII\n@e\n\n+\n")] == ["a", "e"]
    got = rows(b">a b\nACGT\nAC\n>b\n\n>c\r\nA\r\nC\r\n>d\nGG")
    assert [r[:4] for r in got] == [("a b", "ACGTAC", "", 0), ("b", "", "", 13), ("c", "AC", "", 17), ("d", "GG", "", 27)]


def test_several_files_make_one_order(spark, tmp_path):
    one = b"@AAAACCCCGGGGTTTT_AAAACCCCGGGG#1\nAC\n+\nII\n"
    for name in ("a.fastq", "b.fastq"):
        (tmp_path / name).write_bytes(one)
    reads = read_fastq(spark, str(tmp_path))
    r = ix.build_index(reads)
    want = [f"AAAACCCCGGGGTTTT_AAAACCCCGGGG#1 UT:Z:ORIG_{k}_OF_2 UG:i:0" for k in (1, 2)]
    for kept in (kept_of(r), kept_reads(reads, r.index)):
        assert [x["id"] for x in tag_groups(kept).orderBy("i").collect()] == want
        assert call_consensus(kept).count() == 1
    (tmp_path / "c1").write_text("r1;A\n")
    (tmp_path / "clusters").mkdir()
    (tmp_path / "clusters" / "1").write_text("r1;A\n" * 3000)
    (tmp_path / "clusters" / "2").write_text("r1;B\n")
    c = read_clusters(spark, str(tmp_path / "clusters"))
    assert c.agg(F.max_by("identifier", "line_no")).first()[0] == "B"


def test_jobs(spark, tmp_path, capsys):
    import json

    from tagfold import jobs

    reads = tmp_path / "r.fastq"
    reads.write_text("".join(f"@{r['id']}\n{r['seq']}\n+\n{r['qual']}\n" for r in _reads(spark).orderBy("pos").collect()))
    at = lambda x: str(tmp_path / x)
    with pytest.raises(ix.UnmatchedReads):
        jobs.main(["index", str(reads), "-o", at("i.tsv")], spark)
    jobs.main(["index", str(reads), "-o", at("i.tsv"), "--skip-unmatched"], spark)
    lines = (tmp_path / "i.tsv").read_text().splitlines()
    meta = json.loads(lines[0][1:])
    assert list(meta) == ["tool_version", "file_path", "index_date", "elapsed", "gb", "matched_read_count", "unmatched_read_count", "read_count", "avg_qual", "avg_len", "filtered_reads"]
    assert None not in meta.values() and lines[1].split("\t")[:2] == ["id", "pos"]
    places = [int(x.split("\t")[1]) for x in lines[2:]]
    assert places == sorted(places) and len(places) == 4
    jobs.main(["summary", "--index", at("i.tsv"), "-o", at("s.html")], spark)
    assert json.loads(capsys.readouterr().out)["stats"]["distribution"] == {"1": 1, "2": 1}
    assert "Groups by size" in (tmp_path / "s.html").read_text()
    jobs.main(["call", "--index", at("i.tsv"), "--input", str(reads), "-o", at("called"), "-r"], spark)
    jobs.main(["group", "--index", at("i.tsv"), "--input", str(reads), "-o", at("tagged")], spark)
    assert [r["id"].split(" ")[1] for r in read_fastq(spark, at("called")).orderBy("pos").collect()] == ["UT:Z:ORIG_1_OF_2", "UT:Z:ORIG_2_OF_2", "UT:Z:CON_2", "UT:Z:SIN"]
    assert read_fastq(spark, at("tagged")).count() == 3


def test_round_trips(spark, tmp_path):
    reads = _reads(spark)
    r = ix.build_index(reads, skip_unmatched=True)
    write_index(r, str(tmp_path / "idx"), file_path="x")
    assert sorted(map(str, read_index(spark, str(tmp_path / "idx")).collect())) == sorted(map(str, r.index.collect()))
    meta = read_metadata(spark, str(tmp_path / "idx"))
    assert meta["read_count"] == 5 and meta["file_path"] == "x"
    (tmp_path / "one.tsv").write_text('#{"read_count": 1}\nid\tpos\tavg_qual\tn_bases\trec_len\tignored\n#A\t0\t1.5\t3\t9\tfalse\n')
    head, rows = read_index_file(spark, str(tmp_path / "one.tsv"))
    assert head == {"read_count": 1} and tuple(rows.first()) == ("#A", 0, 1.5, 3, 9, False)
    assert "Groups by size" in render(summary(r.index, meta))
    write_index_file(r, str(tmp_path / "whole.tsv"), file_path="x")
    head, rows = read_index_file(spark, str(tmp_path / "whole.tsv"))
    assert head["read_count"] == 5 and sorted(map(str, rows.collect())) == sorted(map(str, r.index.collect()))
    write_fastq(tag_groups(kept_of(r)), str(tmp_path / "fq"))
    assert read_fastq(spark, str(tmp_path / "fq")).count() == 3


def test_clusters(spark):
    lines = spark.createDataFrame([(0, "r1;A;C"), (1, ""), (2, "r1;G;T")], "line_no long, value string")
    assert [x["identifier"] for x in parse_clusters(lines).collect()] == ["A_C", "G_T"]
    with pytest.raises(Exception, match="two or three"):
        parse_clusters(spark.createDataFrame([(0, "r1")], "line_no long, value string")).collect()
    reads = spark.createDataFrame([("r1", T, "I" * len(T), 0, 90)], READS)
    r = ix.build_index(reads, clusters=parse_clusters(lines))
    assert r.index.first()["id"] == "G_T"


def test_stream(spark, tmp_path):
    from tagfold.streaming.index_stream import index_stream

    _reads(spark).write.parquet(str(tmp_path / "in"))
    stream = index_stream(spark.readStream.schema(READS).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("idx").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("idx").count() == 4


def test_shared_tables(spark):
    import os

    from tagfold.shared import hold, new_folder, scratch, shared_dir

    df = spark.range(5)
    kept = hold(df)
    with scratch(spark):
        gone = hold(df)
        assert gone.count() == 5
        where = gone.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0].replace("//", "/")
        assert os.path.isdir(where)
    assert not os.path.isdir(where) and kept.count() == 5
    assert new_folder(spark, "x").startswith(shared_dir(spark))


def test_a_group_with_most_reads(spark, monkeypatch):
    """A group of a third of all reads, spread over ranges of the file; some groups have one read."""
    from tagfold.operators import groups

    monkeypatch.setattr(groups, "RANGE_BYTES", 700)
    rng = np.random.default_rng(1)
    names = ["hot_A" if rng.random() < 0.4 else f"g{rng.integers(0, 700)}_A" for _ in range(3000)]
    rows = [(name, f"r{k}", "AC", "II", 10 * k, float(k % 40) / 4) for k, name in enumerate(names)]
    kept = spark.createDataFrame(rows, "gkey string, id string, seq string, qual string, pos long, avg_qual double").repartition(9)
    seen, first, total = {}, {}, {}
    for name, *_, q in rows:
        first.setdefault(name, len(first))
        seen[name], total[name] = seen.get(name, 0) + 1, total.get(name, 0.0) + q
    got = {(r["gkey"], r["ug"], r["n"], r["quality"]) for r in groups.number_groups(kept).collect()}
    assert got == {(x, first[x], n, total[x] / n) for x, n in seen.items()}
    place = {}
    want = set()
    for name, header, *_ in rows:
        place[name] = place.get(name, 0) + 1
        want.add((first[name], place[name], f"{header} UT:Z:ORIG_{place[name]}_OF_{seen[name]} UG:i:{first[name]}"))
    assert {(r["ug"], r["i"], r["id"]) for r in tag_groups(kept).collect()} == want
