import random

import pytest
from pyspark.sql import functions as F

from kmerweave import DNA
from kmerweave.operators.lineage import work_dir
from kmerweave.sources import alignments as AL, fasta
from kmerweave.sources.cache import cached
from kmerweave.streaming.ingest import index_stream, read_index


def test_fasta_offsets(spark, tmp_path):
    text = "> one\nACGT\nAC\n\n>two words \nGG>GG\n> empty\n>three\nTTT"
    path = tmp_path / "x.fa"
    path.write_text(text)
    rows = fasta.read_fasta(spark, str(path)).orderBy("pos").collect()
    assert [(r.name, r.seq) for r in rows] == [("one", "ACGTAC"), ("two words", "GG>GG"), ("three", "TTT")]
    assert [r.pos for r in rows] == [0, text.index(">two"), text.index(">three")]
    assert [r.name for r in fasta.read_fasta(spark, str(path), 2).collect()] == ["one", "two words"]
    # The same offsets when the file is read in many splits.
    big = tmp_path / "big.fa"
    big.write_text("".join(f">r{k}\n{'ACGT' * (k % 50 + 1)}\n" for k in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = fasta.read_fasta(spark, str(big))
        assert spark.read.text(str(big)).rdd.getNumPartitions() > 5
        data = big.read_bytes()
        rows = df.collect()
        assert len(rows) == 3000
        assert all(data[r.pos:].startswith(f">{r.name}\n".encode()) for r in rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_mapped_reads_and_bases(spark, tmp_path):
    path = tmp_path / "m.fa"
    path.write_text("> + 10:14\nACGT\n> - 3:5\nGG\n")
    rows = fasta.read_mapped_reads(spark, str(path)).orderBy("pos").collect()
    assert [(r.strand, r.map_from, r.map_to, r.seq) for r in rows] == [("+", 10, 14, "ACGT"), ("-", 3, 5, "GG")]
    g = tmp_path / "g.fa"
    g.write_text(">a\nacgNNt\nAC\n>b\nNgg\n")
    assert [(r.name, r.seq, r.start) for r in fasta.read_bases(spark, str(g)).orderBy("start").collect()] == [
        ("a", "ACGT", 0), ("a", "AC", 4), ("b", "GG", 6)]


def test_transcripts_without_long_gaps(spark, tmp_path):
    df = spark.createDataFrame([("p", "M" + "D" * 5 + "M")], "name string, seq string")
    fasta.clean_transcripts(df, str(tmp_path / "out"), 5)
    r = fasta.read_fasta(spark, str(tmp_path / "out")).first()
    assert (r.name, r.seq) == ("(cleaned, max_gap = 5) p", "MM")


def test_sam(spark, tmp_path):
    line = "r1\t0\tref\t5\t60\t{}\t*\t0\t0\tACGT\t*\n"
    (tmp_path / "a.sam").write_text("@HD\tVN:1\n" + line.format("2I3M1D2M4D") + line.format("3M") + line.format("*"))
    assert [r.opseq for r in AL.read_sam(spark, str(tmp_path / "a.sam")).collect()] == ["MMMDMM", "MMM"]
    (tmp_path / "b.sam").write_text(line.format("3S4M"))
    with pytest.raises(Exception):
        AL.read_sam(spark, str(tmp_path / "b.sam")).collect()


MAF = """##maf version=1

a score=1
s x 0 4 + 9 AC-GT
s y 0 4 + 9 ACT-T
s z 0 5 + 9 ACTNT

a score=2
s x 4 3 + 9 GGA
s z 5 2 + 9 G-A

"""


def whole(parts, keys, part):
    """Parts put together, each where it says it starts."""
    found = {}
    for r in parts.orderBy(*keys, "start").collect():
        key = r[keys[0]] if len(keys) == 1 else tuple(r[k] for k in keys)
        assert len(found.get(key, "")) == r.start
        found[key] = found.get(key, "") + r[part]
    return found


def test_ids_that_the_first_block_lacks(spark, tmp_path):
    path = tmp_path / "late.maf"
    path.write_text("a\ns x 0 2 + 2 AC\ns y 0 2 + 2 AC\n\na\ns y 2 2 + 4 GT\ns late 0 2 + 2 GA\n")
    got = whole(AL.pairwise(AL.read_blocks(spark, str(path))), ["id1", "id2"], "opseq")
    assert got == {("x", "y"): "MMII", ("y", "late"): "DDMS"}


def test_the_last_start_is_a_seed(spark, tmp_path):
    path = tmp_path / "end.maf"
    path.write_text("a\ns x 0 3 + 3 ACG\ns y 0 3 + 3 ACG\n")
    seeds = AL.exact_seeds(AL.read_blocks(spark, str(path)), 2).collect()
    assert {r.col: r.positions for r in seeds} == {0: [1, 1], 1: [2, 2]}


def test_exact_seeds_compare_columns_in_place(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(AL, "COLUMNS_TOGETHER", 3)
    path = tmp_path / "long.maf"
    path.write_text("a\ns x 0 9 + 9 acg-tgé-cgt\ns y 0 8 + 8 ACG-AGÉ-CG\n\na\ns x 0 3 + 3 GGG\n\na\ns y 0 4 + 4 GT-CA\ns x 0 4 + 4 GT-CAA\n")
    seeds = AL.exact_seeds(AL.read_blocks(spark, str(path)), 2)
    assert {r.col: r.positions for r in seeds.collect()} == {
        0: [1, 1], 1: [2, 2], 2: [3, 3], 5: [5, 5], 6: [6, 6], 7: [6, 6], 8: [7, 7], 14: [13, 9], 15: [14, 10], 16: [14, 10], 17: [15, 11]}
    assert "posexplode" not in seeds._jdf.queryExecution().optimizedPlan().toString()


def test_multiple_alignments(spark, tmp_path):
    path = tmp_path / "a.maf"
    path.write_text(MAF)
    blocks = AL.read_blocks(spark, str(path))
    assert whole(AL.sequences(blocks), ["id"], "seq") == {"x": "ACGTGGA", "y": "ACTT", "z": "ACTNTGA"}
    got = whole(AL.pairwise(blocks), ["id1", "id2"], "opseq")
    assert got == {("x", "y"): "MMIDMDDD", ("x", "z"): "MMISMMDM", ("y", "z"): "MMMIMII"}
    seeds = {r.col: r.positions for r in AL.exact_seeds(blocks, 2, ids=["x", "z"]).collect()}
    assert seeds == {0: [1, 1], 4: [4, 5]}
    AL.write_pairwise(blocks, str(tmp_path / "pw"))
    back = whole(fasta.read_parts(spark, str(tmp_path / "pw")), ["name"], "seq")
    assert back == {f"{a}:{b}": tx for (a, b), tx in got.items()}
    AL.write_individual(blocks, str(tmp_path / "each"))
    assert whole(fasta.read_parts(spark, str(tmp_path / "each")), ["name"], "seq") == {"x": "ACGTGGA", "y": "ACTT", "z": "ACTNTGA"}
    clustal = tmp_path / "a.aln"
    clustal.write_text("CLUSTAL W\n\nx  AC-G\ny  ACTG\n   ** *\n\nx  TT\ny  T-\n")
    assert whole(AL.sequences(AL.read_blocks(spark, str(clustal), "clustal")), ["id"], "seq") == {"x": "ACGTT", "y": "ACTGT"}
    n = spark.createDataFrame([("N", "N"), ("N", "A")], "x string, y string").select(AL._op(F.col("x"), F.col("y"))).collect()
    assert [r[0] for r in n] == ["S", "S"]


def test_records_in_parts_over_splits_and_files(spark, tmp_path, monkeypatch):
    """Records that go over lines, input splits and files come back with the offsets of their parts."""
    rng = random.Random(1)
    text = {f"r{k}": "".join(rng.choice("ACGTN") for _ in range(n)) for k, n in enumerate((700, 3, 1, 2500, 40))}
    parts = [(name, at, seq[at:at + 90]) for name, seq in text.items() for at in range(0, len(seq), 90)] + [("none", 0, "")]
    monkeypatch.setattr(fasta, "LINE", 50)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    fasta.write_parts(spark.createDataFrame(parts, "name string, start int, seq string").repartition(5), str(tmp_path / "out"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "out").glob("part-*"))
    assert len(files) > 3 and sum(f.read_text().count(">") for f in files) == len(text)
    monkeypatch.undo()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "64"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            found = fasta.read_parts(spark, str(tmp_path / "out"))
            assert whole(found, ["name"], "seq") == text
            assert all(text[r.name][r.start:r.start + len(r.seq)] == r.seq for r in found.collect())
            one = tmp_path / f"one-{size}.fa"
            one.write_text("".join(f.read_text() for f in files))
            genome = sorted((r.start, r.seq) for r in fasta.read_bases(spark, str(one)).where("seq <> ''").collect())
            assert "".join(seq for _, seq in genome) == "".join(text[n] for n in sorted(text)).replace("N", "")
            assert all(b == a + len(s) for (a, s), (b, _) in zip(genome, genome[1:])) and genome[0][0] == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_hits_and_cache(spark, tmp_path):
    (tmp_path / "hits").write_text("V r1 IGHV1 98.5 200/203\n")
    r = AL.read_hits(spark, str(tmp_path / "hits")).first()
    assert (r.gene_type, r.read, r.gene, r.p, r.num_matches, r.length) == ("V", "r1", "IGHV1", .985, 200, 203)
    built = []
    def build():
        built.append(1)
        return spark.range(3)
    for _ in range(2):
        assert cached(spark, str(tmp_path / "kept"), build).count() == 3
    assert len(built) == 1


def test_index_stream(spark, tmp_path):
    src, schema = tmp_path / "in", "seq_id bigint, seq string"
    def run():
        stream = spark.readStream.schema(schema).parquet(str(src))
        q = index_stream(stream, str(tmp_path / "index"), str(tmp_path / "cp"), DNA, 3, trigger={"availableNow": True})
        q.awaitTermination(120)
    spark.createDataFrame([(1, "ACGTA"), (2, "ACGTA"), (3, "GGGG")], schema).write.mode("append").parquet(str(src))
    run()
    assert read_index(spark, str(tmp_path / "index")).count() == 5
    spark.createDataFrame([(4, "GGGG"), (5, "TTTTT")], schema).write.mode("append").parquet(str(src))
    run()
    index = read_index(spark, str(tmp_path / "index"))
    assert index.count() == 8 and {r.seq_id for r in index.collect()} == {1, 3, 5}


def test_work_dir_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert work_dir(spark) == named if named else work_dir(spark)
