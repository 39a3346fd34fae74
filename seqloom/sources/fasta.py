"""FASTA and FASTQ, compressed or not, as DataFrames; and the text outputs of queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators.order import global_rank


def read_fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``name, seq, path, block, at``: records of multi-line FASTA. Records are split by Spark's reader, so a large plain file
    is many tasks; gzip files are a task each. The name is the header's first word; block and at order the records of a file
    (of one scan)."""
    rows = spark.read.text(paths, lineSep="\n>").select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    rows = rows.withColumn("at", F.monotonically_increasing_id()).filter(F.trim("value") != "")
    text = F.regexp_replace(F.regexp_replace("value", "^>", ""), "\r", "")
    rows = rows.select("path", "block", "at", text.alias("text"))
    body = F.when(F.instr("text", "\n") > 0, F.expr("substring(text, instr(text, '\\n') + 1)")).otherwise("")
    name = F.split(F.substring_index("text", "\n", 1), r"\s+")[0]
    return rows.select(name.alias("name"), F.regexp_replace(body, r"\s", "").alias("seq"), "path", "block", "at")


def read_fasta_list(spark: SparkSession, list_path: str) -> DataFrame:
    """``name, seq, path, block, at, doc`` of all FASTA files that a file names, one path a line; doc is the file's number."""
    paths = [r[0].strip() for r in spark.read.text(list_path).collect() if r[0].strip()]  # a line a file
    found = [read_fasta(spark, p).withColumn("doc", F.lit(k).cast("long")) for k, p in enumerate(paths)]
    return reduce(DataFrame.unionByName, found)


def read_fastq(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``name, seq, qual`` of four-line FASTQ. Lines are numbered by ranges over all tasks, so a large plain file is many
    tasks; gzip files are read by a task each."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    numbered = global_rank(lines, ["path", "block", "at"], "n", unique=True)
    first = numbered.groupBy("path").agg(F.min("n").alias("first"))  # a row a file
    placed = numbered.join(first, "path").withColumn("n", F.col("n") - F.col("first"))
    line = lambda k: F.rtrim(F.coalesce(F.max(F.when(F.col("n") % 4 == k, F.regexp_replace("value", "\r$", ""))), F.lit("")))
    records = placed.groupBy("path", F.floor(F.col("n") / 4).alias("record")).agg(*[line(k).alias(c) for k, c in ((0, "title"), (1, "seq"), (3, "qual"))])
    name = F.split(F.expr("substring(title, 2)"), r"\s+")[0]
    return records.filter(F.startswith("title", F.lit("@"))).select(name.alias("name"), "seq", "qual")


def read_reads(spark: SparkSession, path: str) -> DataFrame:
    """``name, seq`` of FASTA or FASTQ, by the file's first character."""
    first = spark.read.text(path).filter("value <> ''").first()
    found = read_fastq(spark, path) if first and first[0].startswith("@") else read_fasta(spark, path)
    return found.select("name", "seq")


def lengths_text(lengths: DataFrame, compat: bool = True) -> DataFrame:
    """``value``: two lines a read, ``>id`` and its lengths left to right; ``compat`` keeps blanks at line ends."""
    tail = " " if compat else ""
    return lengths.select(F.concat(F.lit(">"), F.col("read_id").cast("string"), F.lit(tail + "\n"), F.array_join("lens", " "), F.lit(tail)).alias("value"))


def count_text(counts: DataFrame) -> DataFrame:
    """``value``: id, matched/total, occurrences."""
    return counts.select(F.format_string("%s\t%d/%d\t%d", F.col("read_id").cast("string"), "matched", "total", "occurrences").alias("value"))


def kmers_text(tokens: DataFrame) -> DataFrame:
    """``value``: id, found/total, tokens."""
    return tokens.select(F.format_string("%s\t%d/%d\t%s", F.col("read_id").cast("string"), "found", "total", "tokens").alias("value"))


def mems_text(mems: DataFrame) -> DataFrame:
    """``value``: id, start, end, count."""
    return mems.select(F.format_string("%s\t%d\t%d\t%d", F.col("read_id").cast("string"), "s", "e", "cnt").alias("value"))


def _cell(column: Column, size: int) -> Column:
    """Padded to a size; longer ones stay whole."""
    return F.when(F.char_length(column) < size, F.rpad(column, size, " ")).otherwise(column)


def report_text(verdicts: DataFrame, thr: int | None = None) -> DataFrame:
    """``value``: the classification report in fixed columns, the mean with three digits, after a line of titles if
    ``thr`` is given."""
    mean = F.col("avg_max").cast("double")
    # three significant digits, without zeros at the end
    digits = F.when(mean == 0, 0).otherwise(2 - F.floor(F.log10(F.abs(mean)))).cast("int")
    tenth = F.pow(F.lit(10.0), digits)
    short = F.regexp_replace(F.regexp_replace(F.format_number(F.round(mean * tenth) / tenth, 6), ",", ""), r"\.?0+$", "")
    cells = [(F.col("read_id").cast("string"), 30), (F.col("status"), 15), (short, 26), (F.col("above").cast("string"), 12), (F.col("below").cast("string"), 12)]
    lines = verdicts.select(F.concat(*[_cell(c, n) for c, n in cells]).alias("value"))
    if thr is None:
        return lines
    title = f"{'read id:':<30}{'status:':<15}avg max-value (thr={thr:<2}{'):':<5}{'above thr:':<12}{'below thr:':<12}"
    return lines.sparkSession.createDataFrame([(title,)], "value string").unionByName(lines)


def fasta_text(reads: DataFrame) -> DataFrame:
    """``value``: FASTA records of reads."""
    return reads.select(F.concat(F.lit(">"), F.col("read_id").cast("string"), F.lit("\n"), F.col("seq")).alias("value"))


def classes_text(classes: DataFrame) -> DataFrame:
    """``value``: id, best, second."""
    return classes.select(F.concat_ws(",", F.col("read_id").cast("string"), F.col("best").cast("string"), F.col("second").cast("string")).alias("value"))


def clean_text(segments: DataFrame, names: DataFrame, separators: bool = True) -> DataFrame:
    """``value``: cleaned FASTA of both strands. ``segments``: doc_id, [part,] strand, seq; ``names``: doc_id, [part,] name."""
    keys = ["doc_id", *(["part"] if "part" in segments.columns else [])]
    tail = F.lit("%" if separators else "")
    title = F.concat(F.lit(">"), "name", F.when(F.col("strand") == 1, "_rev_comp").otherwise(""))
    return segments.join(names, keys).orderBy(*keys, "strand").select(F.concat(title, F.lit("\n"), "seq", tail).alias("value"))


def all_classes_text(votes: DataFrame, reads: DataFrame) -> DataFrame:
    """``value``: id and all classes that are reported, the best first, ``0`` for none. ``votes``: read_id, species, cnt."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("cnt")).alias("less"), "species")))
    listed = votes.groupBy("read_id").agg(F.array_join(F.transform(order, lambda x: x["species"].cast("string")), ",").alias("names"))
    return reads.select("read_id").join(listed, "read_id", "left").select(F.concat_ws(",", F.col("read_id").cast("string"), F.coalesce("names", F.lit("0"))).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    """One file a partition; the reads' order is not kept, as in any parallel output."""
    lines.write.mode("overwrite").text(path)
