import brute

from seqloom import cli


def test_build_and_ask(spark, tmp_path, capsys):
    (tmp_path / "refs.fa").write_text(">b\nGATTACAGATT\n>a\nACGTNACGGT\n")
    (tmp_path / "reads.fq").write_text("@r1\nGATTACA\n+\nIIIIIII\n@r2\nNNN\n+\nIII\n")
    index, reads = str(tmp_path / "index"), str(tmp_path / "reads.fq")
    assert cli.main(["build", "--fasta", str(tmp_path / "refs.fa"), "--index", index, "--ftab-k", "3", "--verify"]) == 0
    ask = lambda *more: (cli.main(["query", "--index", index, "--read", reads, *more]), capsys.readouterr().out)[1]
    refs = ["GATTACAGATT", "ACGTAACGGT"]  # in the order of the file
    segments = [x for s in refs for x in (s, brute.rc(s))]
    text = "".join(f"{s}%{brute.rc(s)}%" for s in refs) + "$"
    capsys.readouterr()
    lines = ask("--kind", "pml").split("\n")
    assert lines[lines.index(">r1 ") + 1].split() == [str(x) for x in brute.pml("GATTACA", text)]
    assert "r1\t7/7\t1" in ask("--kind", "count")
    assert ask("--kind", "mem", "-l", "5").strip() == "r1\t0\t7\t1"
    lines = ask("--kind", "zml").split("\n")
    assert lines[lines.index(">r1 ") + 1].split() == [str(x) for x in brute.zml("GATTACA", segments)]
    assert "r1,1,0" in ask("--multi-classify")
    assert {"r1,1", "r2,0"} <= set(ask("--multi-classify", "--report-all").split())
    assert "r1,1,0" in ask("--multi-classify", "--early-stop", "--min-diff-frac", "0.1")
    lines = ask("--sa-entries").split("\n")
    assert lines[lines.index(">r1 ") + 1].split() == [str(x) for x in brute.pml("GATTACA", text, places=True)]
    lines = ask("--report-colors").split("\n")
    assert len(lines[lines.index(">r1 ") + 1].split()) == 7
    assert ask("--no-output") == ""
    assert cli.main(["inspect", "--index", index]) == 0
    assert f"n\t{len(text)}" in capsys.readouterr().out
    cli.main(["query", "--index", index, "--read", reads, "--bpf", "--out", str(tmp_path / "p")])
    capsys.readouterr()
    assert cli.main(["view", "--bpf", str(tmp_path / "p.0.bpf")]) == 0
    assert ">r" in capsys.readouterr().out
    # stored lengths against a stored null model
    assert cli.main(["null", "--index", index, "--kind", "pml"]) == 0
    said = capsys.readouterr().out
    assert "percentile" in said
    shown = ask("--classify")
    assert shown.startswith("read id:") and "thr=" in shown
    assert cli.main(["view", "--bpf", str(tmp_path / "p.0.bpf"), "--classify", "--index", index]) == 0
    assert sorted(capsys.readouterr().out.split("\n")) == sorted(shown.split("\n"))


def test_reads_from_standard_input(spark, tmp_path, capsys, monkeypatch):
    import io

    (tmp_path / "refs.fa").write_text(">b\nGATTACAGATT\n")
    index = str(tmp_path / "index")
    assert cli.main(["build", "--fasta", str(tmp_path / "refs.fa"), "--index", index]) == 0
    monkeypatch.setattr("sys.stdin", io.StringIO(">r1\nGATT\nACA\n>r2\nCCC\n"))
    assert cli.main(["query", "--index", index, "--read", "-", "--kind", "count"]) == 0
    assert "r1\t7/7\t1" in capsys.readouterr().out


def test_documents_of_several_records(spark, tmp_path, capsys):
    """Records of a listed file are parts of one document: in their order, without matches across their ends."""
    (tmp_path / "a.fa").write_text(">a1\nTTTTGGGG\n>a2\nACGTACCA\n")
    (tmp_path / "b.fa").write_text(">b1\nGATTACAG\n")
    (tmp_path / "list").write_text(f"{tmp_path / 'a.fa'}\n{tmp_path / 'b.fa'}\n")
    (tmp_path / "taxa").write_text("70\n50\n")
    index, out = str(tmp_path / "index"), tmp_path / "clean"
    assert cli.main(["prepare", "--list", str(tmp_path / "list"), "--out", str(out)]) == 0
    records = [("a1", "TTTTGGGG"), ("a2", "ACGTACCA"), ("b1", "GATTACAG")]
    want = "".join(f">{n}\n{s}%\n>{n}_rev_comp\n{brute.rc(s)}%\n" for n, s in records)
    assert "".join(p.read_text() for p in sorted((out / "fasta").glob("part-*"))) == want
    assert "".join(p.read_text() for p in sorted((out / "doc_offsets").glob("part-*"))) == "36\n54\n"
    assert cli.main(["build", "--list", str(tmp_path / "list"), "--index", index, "--doc-ids", str(tmp_path / "taxa"), "--null", "pml", "--verify"]) == 0
    from seqloom.plans.engine import Index

    loaded = Index.load(spark, index)
    text = "".join(f"{s}%{brute.rc(s)}%" for _, s in records) + "$"
    assert "".join(r["c"] for r in loaded.text.orderBy("pos").collect()) == text
    assert [r["pos"] for r in loaded.sa.orderBy("row").collect()] == brute.suffixes(text)
    assert loaded.null("pml").first()["num_values"] > 0
    (tmp_path / "reads.fa").write_text(">r1\nGGGGACGT\n>r2\nGATTACAG\n")
    capsys.readouterr()
    cli.main(["query", "--index", index, "--read", str(tmp_path / "reads.fa"), "--kind", "mem", "-l", "4"])
    found = capsys.readouterr().out
    assert "r1\t0\t4" in found and "r1\t4\t8" in found and "r1\t0\t8" not in found
    cli.main(["query", "--index", index, "--read", str(tmp_path / "reads.fa"), "--multi-classify"])
    assert "r2,50,0" in capsys.readouterr().out
    # a taxonomy over classes
    (tmp_path / "nodes.dmp").write_text("1\t|\t1\t|\n70\t|\t7\t|\n50\t|\t7\t|\n7\t|\t1\t|\n")
    (tmp_path / "classes.csv").write_text("r1,70,50\nr2,50,0\nr3,0,0\n")
    assert cli.main(["lca", "--nodes", str(tmp_path / "nodes.dmp"), "--classes", str(tmp_path / "classes.csv")]) == 0
    assert {"r1,7", "r2,50", "r3,0"} <= set(capsys.readouterr().out.split())
    assert cli.main(["rlbwt", "--index", index, "--out", str(tmp_path / "t")]) == 0
    from seqloom.sources import transform_files

    back = transform_files.expand(transform_files.read_runs(spark, str(tmp_path / "t.heads"), str(tmp_path / "t.lengths")))
    assert "".join(r["c"] for r in back.orderBy("row").collect()) == "".join(brute.transform(text)[1])
