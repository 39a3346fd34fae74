import gzip

from seqloom.plans.engine import Index
from seqloom.operators import bwt, pml
from seqloom.sources import bpf, fasta, transform_files
from seqloom.streaming import reads as stream


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first\nACG\nTTA\n>two\nGG\n\n>three\n")
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(">four\r\nAC\r\nGT\r\n")
    got = {r["name"]: r["seq"] for r in fasta.read_fasta(spark, str(tmp_path / "*.fa*")).collect()}
    assert got == {"one": "ACGTTA", "two": "GG", "three": "", "four": "ACGT"}
    (tmp_path / "list.txt").write_text(f"{tmp_path}/a.fa\n{tmp_path}/b.fa.gz\n")
    assert fasta.read_fasta_list(spark, str(tmp_path / "list.txt")).select("path").distinct().count() == 2


def test_fastq(spark, tmp_path):
    (tmp_path / "r.fq").write_text("@r1 x\nACGT\n+\n@III\n@r2\nGG\n+r2\nII\n")
    rows = fasta.read_fastq(spark, str(tmp_path / "r.fq")).collect()
    assert [tuple(r) for r in rows] == [("r1", "ACGT", "@III"), ("r2", "GG", "II")]
    assert fasta.read_reads(spark, str(tmp_path / "r.fq")).count() == 2


def test_texts(spark):
    lens = spark.createDataFrame([("r", [3, 2, 1])], "read_id string, lens array<int>")
    assert fasta.lengths_text(lens).first()[0] == ">r \n3 2 1 "
    assert fasta.lengths_text(lens, compat=False).first()[0] == ">r\n3 2 1"
    assert fasta.count_text(spark.createDataFrame([("r", 3, 7, 2)], "read_id string, matched long, total long, occurrences long")).first()[0] == "r\t3/7\t2"
    assert fasta.mems_text(spark.createDataFrame([("r", 3, 7, 2)], "read_id string, s long, e long, cnt long")).first()[0] == "r\t3\t7\t2"
    import struct

    from seqloom.sources import bpf

    content = bpf.encode(["r1"], [[3, 1, 70_000]])
    assert content[:12] == struct.pack("<IBBBB", 0x42504600, 1, 0, 0, 16) + bytes(4) and len(content) == 12 + 2 + 2 + 8 + 6
    assert bpf.decode(content) == [("r1", [3, 1, 65_535])] and bpf.decode(bpf.encode(["r1"], [[1 << 40]], 64)) == [("r1", [1 << 40])]
    assert bpf.decode(bpf.encode(["a", "b"], [[5], []], 64, header=False), 64) == [("a", [5]), ("b", [])]
    long = spark.createDataFrame([("r" * 40, "FOUND", 3.254, 2, 1), ("s", "FOUND", 12.0, 2, 1), ("t", "FOUND", 0.0, 0, 1), ("u", "FOUND", 123.4, 0, 1)], "read_id string, status string, avg_max double, above long, below long")
    lines = [r[0] for r in fasta.report_text(long, 14).collect()]
    assert lines[0].startswith("read id:") and "(thr=14" in lines[0]
    assert [x.split()[-3].removeprefix("FOUND") for x in lines[1:]] == ["3.25", "12", "0", "123"] and lines[1].startswith("r" * 40 + "FOUND")
    row = fasta.report_text(spark.createDataFrame([("r", "FOUND", 1.5, 2, 1)], "read_id string, status string, avg_max double, above long, below long")).first()[0]
    assert len(row) == 95 and row.startswith("r ")


def test_profiles(spark, tmp_path):
    rows = [("a", [1, 2, 70000]), ("b", []), ("é", [5])]
    assert bpf.decode(bpf.encode([r[0] for r in rows], [r[1] for r in rows])) == [("a", [1, 2, 65535]), ("b", []), ("é", [5])]
    assert bpf.decode(bpf.encode(["a"], [[1, 70000]], 32)) == [("a", [1, 70000])]
    assert bpf.decode(bpf.encode(["a"], [[1, 2]], 64, header=False), 64) == [("a", [1, 2])]
    (tmp_path / "x.bpf").write_bytes(bpf.encode(["a"], [[3, 4]]))
    read = bpf.read_bpf(spark, str(tmp_path / "x.bpf"))
    assert [tuple(r) for r in read.collect()] == [("a", [3, 4])]
    assert bpf.view(read).first()[0] == ">a\n3 4"


def test_stream(spark, tmp_path):
    index = Index(spark.createDataFrame([(0, "GATTACAGG")], "doc_id long, seq string")).arrays()
    reads = spark.createDataFrame([("r1", "GATTACA"), ("r2", "")], stream.READS)
    reads.write.parquet(str(tmp_path / "in"))
    found = stream.profile_stream(stream.reads_stream(spark, str(tmp_path / "in")), index)
    run = found.writeStream.format("memory").queryName("profiles").trigger(availableNow=True).start()
    run.awaitTermination()
    got = {r["read_id"]: r["lens"] for r in spark.sql("select * from profiles").collect()}
    assert got == {r["read_id"]: r["lens"] for r in pml.query(reads, index).collect()}
    batches = stream.run_batches(stream.reads_stream(spark, str(tmp_path / "in")), lambda b: pml.query(b, index), str(tmp_path / "out"), str(tmp_path / "state"))
    batches.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_transform_files(spark, tmp_path):
    index = Index(spark.createDataFrame([(0, "GATTACAGG"), (1, "AAAAAT")], "doc_id long, seq string"))
    rows = sorted((r["row"], r["c"]) for r in index.rows.collect())
    (tmp_path / "raw").write_bytes("".join(c for _, c in rows).replace("$", "\0").encode())
    assert sorted(map(tuple, transform_files.read_transform(spark, str(tmp_path / "raw")).collect())) == rows
    heads, lengths = str(tmp_path / "heads"), str(tmp_path / "lengths")
    transform_files.write_runs(index.moves, heads, lengths)
    runs = transform_files.read_runs(spark, heads, lengths)
    assert {(r["run"], r["c"], r["n"], r["p"]) for r in runs.collect()} == {(r["run"], r["c"], r["n"], r["p"]) for r in index.moves.collect()}
    again = transform_files.expand(runs)
    assert sorted(map(tuple, again.collect())) == rows
    stepped = bwt.lf_of_transform(again)
    assert {r["row"]: r["lf"] for r in stepped.collect()} == {r["row"]: r["lf"] for r in index.rows.collect()}
    assert {r["row"]: r["pos"] for r in bwt.places_of_transform(stepped).collect()} == {r["row"]: r["pos"] for r in index.rows.collect()}


def test_thresholds_file(spark, tmp_path):
    from seqloom.sources import transform_files

    values = [0, 1, 70_000, (1 << 40) - 1]
    (tmp_path / "thr").write_bytes(b"".join(v.to_bytes(5, "little") for v in values))
    assert [r["thr"] for r in transform_files.read_thresholds(spark, str(tmp_path / "thr")).orderBy("run").collect()] == values


def test_fastq_in_many_tasks(spark, tmp_path):
    """Records over many splits of a file, with qualities that begin like titles, and of several files."""
    rows = [(f"r{i}", "ACGT" * (1 + i % 5), "@" * (4 + 4 * (i % 5))) for i in range(400)]
    text = "".join(f"@{n} more\n{s}\n+\n{q}\n" for n, s, q in rows)
    (tmp_path / "a.fq").write_text(text)
    (tmp_path / "b.fq").write_text("@x\r\nGG\r\n+\r\nII\r\n@y\nA")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000b")
    try:
        got = {(r["name"], r["seq"], r["qual"]) for r in fasta.read_fastq(spark, [str(tmp_path / "a.fq"), str(tmp_path / "b.fq")]).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {*rows, ("x", "GG", "II"), ("y", "A", "")}
