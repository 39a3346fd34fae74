"""Command line: build an index from FASTA, ask it, look at it.

    python -m seqloom.cli prepare --fasta refs.fa | --list files.txt --out DIR [--no-separators]
    python -m seqloom.cli build --fasta refs.fa | --list files.txt --index DIR [--ftab-k 8,12] [--doc-ids FILE] [--null pml,zml]
    python -m seqloom.cli null --index DIR --kind pml|rpml|ms|zml
    python -m seqloom.cli query --index DIR --read reads.fq|- --kind pml|rpml|ms|zml|count|kmer|kmer_count|mem [-k K] [-l L]
                                [--classify | --filter [-v] | --multi-classify [--report-all]] [--reverse] [--out PATH]
    python -m seqloom.cli inspect --index DIR
    python -m seqloom.cli rlbwt --index DIR --out PREFIX
    python -m seqloom.cli view --bpf FILE [--classify --index DIR]
    python -m seqloom.cli lca --nodes nodes.dmp --classes results.csv
"""

from __future__ import annotations

import argparse
import sys
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.sequence import clean, legal
from seqloom.operators import bwt, classify, corpus, taxonomy
from seqloom.operators.order import global_rank
from seqloom.plans.engine import Engine, Index
from seqloom.session import materialize, shared_dir, ship
from seqloom.sources import bpf, fasta, taxa, transform_files


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="seqloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = out.add_subparsers(dest="command", required=True)
    build, prepare = commands.add_parser("build"), commands.add_parser("prepare")
    for command in (build, prepare):
        source = command.add_mutually_exclusive_group(required=True)
        source.add_argument("--fasta", "-f")
        source.add_argument("--list", "-l")
        command.add_argument("--no-separators", action="store_true")
        command.add_argument("--soft-mask", choices=["upper", "A"], default="upper")
    prepare.add_argument("--out", "-o", required=True)
    build.add_argument("--index", "-i", required=True)
    build.add_argument("--ftab-k", default="", help="k of k-mer tables, comma-separated")
    build.add_argument("--doc-ids", help="a file with a taxon a line, in the order of documents")
    build.add_argument("--null", default="", help="queries whose null model is kept with the index, comma-separated")
    build.add_argument("--verify", action="store_true")
    null = commands.add_parser("null")
    null.add_argument("--index", "-i", required=True)
    null.add_argument("--kind", default="pml", choices=["pml", "rpml", "ms", "zml"])
    query = commands.add_parser("query")
    query.add_argument("--index", "-i", required=True)
    query.add_argument("--read", "-r", required=True)
    query.add_argument("--kind", default="pml", choices=["pml", "rpml", "ms", "zml", "count", "kmer", "kmer_count", "mem"])
    query.add_argument("-k", type=int, default=31)
    query.add_argument("-l", type=int, default=25)
    query.add_argument("--ignore-illegal-chars", type=int, choices=[0, 1, 2], default=0)
    query.add_argument("--reverse", action="store_true")
    query.add_argument("--sa-entries", action="store_true")
    query.add_argument("--classify", action="store_true")
    query.add_argument("--filter", action="store_true")
    query.add_argument("-v", "--invert", action="store_true")
    query.add_argument("--multi-classify", action="store_true")
    query.add_argument("--bin-width", type=int, default=classify.BIN_WIDTH)
    query.add_argument("--min-len", type=int, default=1)
    query.add_argument("--report-all", action="store_true")
    query.add_argument("--report-colors", action="store_true")
    query.add_argument("--min-diff-frac", type=float, default=classify.SECOND_MARGIN)
    query.add_argument("--min-score-frac", type=float, default=0.0)
    query.add_argument("--pvalue-scoring", action="store_true")
    query.add_argument("--early-stop", action="store_true")
    query.add_argument("--no-output", action="store_true", help="work out everything and write nothing")
    query.add_argument("--logs", action="store_true", help="seconds on standard error")
    query.add_argument("--bpf", action="store_true", help="profiles in binary files")
    query.add_argument("--out", "-o")
    commands.add_parser("inspect").add_argument("--index", "-i", required=True)
    rlbwt = commands.add_parser("rlbwt")
    rlbwt.add_argument("--index", "-i", required=True)
    rlbwt.add_argument("--out", "-o", required=True)
    view = commands.add_parser("view")
    view.add_argument("--bpf", required=True)
    view.add_argument("--bits", type=int, default=16, help="entry size of a file without a header")
    view.add_argument("--classify", action="store_true")
    view.add_argument("--index", "-i")
    view.add_argument("--kind", default="pml", choices=["pml", "rpml", "ms", "zml"])
    view.add_argument("--bin-width", type=int, default=classify.BIN_WIDTH)
    lca = commands.add_parser("lca")
    lca.add_argument("--nodes", required=True)
    lca.add_argument("--classes", required=True)
    lca.add_argument("--root", type=int, default=1)
    return out


def references(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """``doc_id, part, name, seq``: a document for each record, in the order of the file, or for each file of a list, whose
    records are its parts; both count from 1."""
    rows = fasta.read_fasta(spark, args.fasta) if args.fasta else fasta.read_fasta_list(spark, args.list)
    rows = global_rank(rows, ["path", "block", "at"] if args.fasta else ["doc", "block", "at"], "part", unique=True)
    doc = F.col("part") + 1 if args.fasta else F.col("doc") + 1
    return materialize(rows.select(doc.alias("doc_id"), "part", "name", clean(F.col("seq"), args.soft_mask).alias("seq")))


def piped(spark: SparkSession, lines) -> str:
    """Reads from standard input, in the shared folder."""
    path = f"{shared_dir(spark)}/seqloom/{uuid.uuid4().hex}"
    spark.createDataFrame([("".join(lines).rstrip("\n"),)], "value string").coalesce(1).write.text(path)
    return path


def answer(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Lines of text, or ``part, content`` of binary files."""
    engine = Engine(Index.load(spark, args.index))
    path = piped(spark, sys.stdin) if args.read == "-" else args.read
    reads = fasta.read_reads(spark, path).select(F.col("name").alias("read_id"), legal(F.col("seq"), args.ignore_illegal_chars).alias("seq"))
    if args.reverse:
        reads = reads.withColumn("seq", F.reverse("seq"))
    reads = materialize(reads)
    if args.multi_classify:
        how = {"least": args.min_len, "min_diff_frac": args.min_diff_frac, "pvalue": args.pvalue_scoring, "early_stop": args.early_stop}
        if args.report_all:
            return fasta.all_classes_text(engine.all_classes(reads, min_score_frac=args.min_score_frac, **how), reads)
        return fasta.classes_text(engine.multi_class(reads, **how))
    if args.classify or args.filter:
        verdicts = engine.classify(reads, args.kind, args.bin_width)
        if args.filter:
            return fasta.fasta_text(classify.filtered(reads, verdicts, args.invert))
        return fasta.report_text(verdicts, classify.threshold(engine.null_statistics(args.kind)).first()["thr"])
    if args.report_colors:
        order = F.array_sort(F.collect_list(F.struct("pos", "color_id")))
        none = engine.index.colors[1].count()  # stands for a base without a color
        found = engine.report_colors(reads).groupBy("read_id").agg(F.transform(order, lambda x: F.when(x["color_id"] < 0, none).otherwise(x["color_id"])).alias("lens"))
        return bpf.to_files(found, 64) if args.bpf else fasta.lengths_text(found)
    if args.kind in ("pml", "rpml"):
        found = engine.query(reads, args.kind, sa_entries=args.sa_entries)
        if args.sa_entries:
            found = found.select("read_id", F.col("sa").alias("lens"))
            return bpf.to_files(found, 64, header=False) if args.bpf else fasta.lengths_text(found)
        return bpf.to_files(found) if args.bpf else fasta.lengths_text(found)
    if args.kind in ("ms", "zml"):
        rows = engine.query(reads, args.kind).groupBy("read_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "len"))), lambda x: x["len"]).alias("lens"))
        return bpf.to_files(rows) if args.bpf else fasta.lengths_text(rows)
    if args.kind == "count":
        return fasta.count_text(engine.count(reads))
    if args.kind == "kmer":
        return fasta.kmers_text(engine.kmer(reads, args.k))
    if args.kind == "kmer_count":
        return engine.kmer_count(reads, args.k).select(F.concat_ws("\t", *[F.col(c).cast("string") for c in ("read_id", "found", "occurrences")]).alias("value"))
    return fasta.mems_text(engine.mem(reads, args.l))


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = ship(SparkSession.builder.appName("seqloom").getOrCreate())
    if args.command == "prepare":
        refs = references(spark, args)
        fasta.write_lines(fasta.clean_text(corpus.strands(refs), refs.select("doc_id", "part", "name"), not args.no_separators), f"{args.out}/fasta")
        ends = corpus.doc_offsets(refs, not args.no_separators)
        fasta.write_lines(ends.orderBy("doc_id").select(F.col("end_off").cast("string").alias("value")), f"{args.out}/doc_offsets")
    elif args.command == "build":
        refs = references(spark, args)
        index = Index(refs.select("doc_id", "part", "seq"), not args.no_separators, taxa.read_doc_ids(spark, args.doc_ids) if args.doc_ids else None)
        index.save(args.index, [int(k) for k in args.ftab_k.split(",") if k], [k for k in args.null.split(",") if k])
        if args.verify and not bwt.verify(index.rows).first()["ok"]:
            print("the index is not sound")
            return 1
    elif args.command == "null":
        index = Index.load(spark, args.index)
        index._made.pop(("null", args.kind), None)
        found = materialize(Engine(index).null_statistics(args.kind))
        found.write.mode("overwrite").parquet(f"{args.index}/nulls/{args.kind}")
        for name, value in found.first().asDict().items():
            print(f"{name}\t{value}")
    elif args.command == "query":
        began = time.time()
        lines = answer(spark, args)
        if args.no_output:
            lines.write.format("noop").mode("overwrite").save()
        elif args.out and "content" in lines.columns:
            for k, row in enumerate(lines.orderBy("part").select("content").toLocalIterator()):
                with open(f"{args.out}.{k}.bpf", "wb") as file:
                    file.write(row["content"])
        elif args.out:
            fasta.write_lines(lines, args.out)
        else:
            for row in lines.toLocalIterator():
                print(row[-1])
        if args.logs:
            print(f"{args.kind}\t{time.time() - began:.3f} s", file=sys.stderr)
    elif args.command == "inspect":
        index = Index.load(spark, args.index)
        for name, value in bwt.inspect(index.rows).first().asDict().items():
            print(f"{name}\t{value}")
        for row in bwt.row_histogram(index.moves).orderBy("power").collect():
            print(f"rows of at least 2^{row['power']}\t{row['at_least']}")
    elif args.command == "rlbwt":
        runs = Index.load(spark, args.index).moves.select("run", "c", "n", "p")
        transform_files.write_runs(runs, f"{args.out}.heads", f"{args.out}.lengths")
    elif args.command == "lca":
        pairs = taxa.read_classes(spark, args.classes).select(F.col("read_id").alias("key"), F.col("best").alias("a"), F.col("second").alias("b"))
        for row in taxonomy.lca(pairs, taxa.read_nodes(spark, args.nodes), args.root).toLocalIterator():
            print(f"{row['key']},{row['lca']}")
    else:
        profiles = bpf.read_bpf(spark, args.bpf, args.bits)
        if args.classify:
            engine = Engine(Index.load(spark, args.index))
            verdicts = engine.classify_profiles(profiles, args.kind, args.bin_width)
            lines = fasta.report_text(verdicts, classify.threshold(engine.null_statistics(args.kind)).first()["thr"])
        else:
            lines = bpf.view(profiles)
        for row in lines.toLocalIterator():
            print(row[0])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
