"""Registered queries over the test tables, with their SQL.

The tables hold no sequences, so texts are read letter by letter as bases (``functions.sequence.fold``), whole and with
all rows. References are ``documents`` and reads are ``benchmark`` for queries that are relational; where suffix order
matters, ``benchmark`` is the reference collection, which SQL can still sort by suffix.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import sequence as S
from seqloom.operators import bwt, classify, colors, corpus, kmers, pml, scan, taxonomy
from seqloom.plans.engine import Engine, opened
from seqloom.session import materialize, ship
from seqloom.sources import bpf

SEED = 11
SHORT_K, COUNT_K, REPORT_K = 8, 12, 16
MEM = 24
BIN = 150

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def registered(sql: str | None = None):
    def keep(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return keep


# ---- tables -------------------------------------------------------------------------------------------------------


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", S.fold(F.col("text")).alias("seq"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ship(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    return rows.select(F.col("item_id").alias("read_id"), S.fold(F.col("text")).alias("seq"))


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """Documents as references; their language is their taxon."""
    taxa = ship(spark).read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("lang").alias("taxon"))
    return opened(spark, f"documents {sf_dir}", lambda: materialize(records(spark, sf_dir)), SEED, taxa=taxa)


def small_engine(spark: SparkSession, sf_dir: str) -> Engine:
    """Benchmark items as references, each its own taxon."""
    return opened(spark, f"benchmark {sf_dir}", lambda: materialize(items(spark, sf_dir).withColumnRenamed("read_id", "doc_id")), SEED)


def doc_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).withColumnRenamed("doc_id", "read_id")


# ---- SQL parts ----------------------------------------------------------------------------------------------------


def _fold(column: str) -> str:
    return f"regexp_replace(translate(lower(coalesce({column}, '')), '{S.LETTERS}', '{S.AS_BASES}'), '[^ACGT]', '', 'g')"


def _rc(column: str) -> str:
    return f"reverse(translate({column}, 'ACGT', 'TGCA'))"


_DOCS = f"docs AS MATERIALIZED (SELECT doc_id, lang, {_fold('text')} AS seq FROM documents)"
_SEGS = f"""{_DOCS},
segs AS (SELECT doc_id, 0 AS strand, seq FROM docs UNION ALL SELECT doc_id, 1, {_rc('seq')} FROM docs)"""
_READS = f"reads AS MATERIALIZED (SELECT item_id AS read_id, {_fold('text')} AS seq FROM benchmark)"


def _kmers(source: str, keys: str, k: int, place: str = "pos") -> str:
    at = f", {place}" if place else ""
    return f"""(SELECT {keys}substr(seq, p + 1, {k}) AS kmer{', p AS ' + place if place else ''}
      FROM (SELECT *, unnest(range(0, len(seq) - {k - 1})) AS p FROM {source} WHERE len(seq) >= {k}))"""


def _islands(k: int, reads: str = "reads") -> str:
    return f"""hits AS (
  SELECT r.read_id, t.doc_id, t.strand, t.j - r.i AS diag, r.i
  FROM {_kmers(reads, 'read_id, ', k, 'i')} r JOIN {_kmers('segs', 'doc_id, strand, ', k, 'j')} t USING (kmer)),
islands AS MATERIALIZED (
  SELECT read_id, doc_id, strand, diag, min(i) AS s, max(i) + {k} AS e
  FROM (SELECT *, i - row_number() OVER (PARTITION BY read_id, doc_id, strand, diag ORDER BY i) AS g FROM hits)
  GROUP BY read_id, doc_id, strand, diag, g)"""


_WORDS = f"""full_words AS (SELECT DISTINCT kmer FROM {_kmers('segs', '', SEED, '')}),
tails AS (SELECT DISTINCT right(seq, {SEED - 1}) AS tail FROM segs WHERE seq <> ''),
words AS MATERIALIZED (
  SELECT DISTINCT substr(kmer, 1, n) AS word FROM full_words, range(1, {SEED}) r(n)
  UNION
  SELECT substr(tail, a, n) FROM tails, range(1, {SEED}) x(a), range(1, {SEED}) y(n) WHERE a + n - 1 <= len(tail))"""


def _short(at_end: bool, reads: str = "reads") -> str:
    start = "pos - n + 2" if at_end else "pos + 1"
    room = "n <= pos + 1" if at_end else "n <= len(seq) - pos"
    return f"""short AS (
  SELECT read_id, pos, max(n) AS len
  FROM (SELECT read_id, pos, n, substr(seq, {start}, n) AS word
        FROM (SELECT *, unnest(range(0, len(seq))) AS pos FROM {reads}), range(1, {SEED}) r(n) WHERE {room})
  WHERE word IN (SELECT word FROM words) GROUP BY read_id, pos)"""


def _ms(reads: str = "reads") -> str:
    return f"""{_islands(SEED, reads)}, {_WORDS}, {_short(False, reads)},
long AS (
  SELECT read_id, pos, max(e) - pos AS len
  FROM (SELECT DISTINCT read_id, s, e FROM islands), LATERAL (SELECT unnest(range(s, e - {SEED - 1})) AS pos)
  GROUP BY read_id, pos),
ms AS MATERIALIZED (
  SELECT read_id, pos, least(coalesce(l.len, k.len, 0), 65535) AS len
  FROM (SELECT read_id, unnest(range(0, len(seq))) AS pos FROM {reads}) LEFT JOIN long l USING (read_id, pos) LEFT JOIN short k USING (read_id, pos))"""


def _left(reads: str = "reads") -> str:
    return f"""{_islands(SEED, reads)}, {_WORDS}, {_short(True, reads)},
long AS (
  SELECT read_id, pos, max(pos - s + 1) AS len
  FROM (SELECT DISTINCT read_id, s, e FROM islands), LATERAL (SELECT unnest(range(s + {SEED - 1}, e)) AS pos)
  GROUP BY read_id, pos),
lefts AS MATERIALIZED (
  SELECT read_id, pos, coalesce(l.len, k.len, 0) AS len
  FROM (SELECT read_id, unnest(range(0, len(seq))) AS pos FROM {reads}) LEFT JOIN long l USING (read_id, pos) LEFT JOIN short k USING (read_id, pos)),
walk AS (
  SELECT read_id, pos, len FROM lefts JOIN {reads} USING (read_id) WHERE pos = len(seq) - 1
  UNION ALL
  SELECT l.read_id, l.pos, l.len FROM walk w JOIN lefts l ON l.read_id = w.read_id AND l.pos = w.pos - greatest(w.len, 1)),
factors AS MATERIALIZED (SELECT read_id, pos - len + 1 AS s, pos + 1 AS e FROM walk WHERE len > 0)"""


_TEXT = f"""ref AS (SELECT item_id AS doc_id, {_fold('text')} AS seq FROM benchmark),
whole AS MATERIALIZED (SELECT coalesce(string_agg(seq || '%' || {_rc('seq')} || '%', '' ORDER BY doc_id), '') || '$' AS t FROM ref),
chars AS MATERIALIZED (SELECT unnest(range(0, len(t))) AS pos, unnest(string_split(t, '')) AS c FROM whole),
ends AS (SELECT doc_id, sum(2 * len(seq) + 2) OVER (ORDER BY doc_id) AS stop FROM ref),
sa AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY suffix) - 1 AS row, pos
  FROM (SELECT pos, substr(t, pos + 1) AS suffix FROM chars, whole))"""
_BWT = f"""{_TEXT},
size AS (SELECT count(*) AS n FROM chars),
bwt AS MATERIALIZED (
  SELECT sa.row, sa.pos, c.c, longer.row AS lf
  FROM sa, size JOIN chars c ON c.pos = (sa.pos + size.n - 1) % size.n JOIN sa longer ON longer.pos = c.pos),
runs AS MATERIALIZED (
  SELECT *, sum(new) OVER (ORDER BY row) - 1 AS run
  FROM (SELECT *, CASE WHEN c = lag(c) OVER (ORDER BY row) THEN 0 ELSE 1 END AS new FROM bwt)),
moves AS MATERIALIZED (
  SELECT h.run, h.c, h.p, h.n, g.run AS id, h.lf - gh.p AS off
  FROM (SELECT run, any_value(c) AS c, min(row) AS p, count(*) AS n, arg_min(lf, row) AS lf FROM runs GROUP BY run) h
  JOIN runs g ON g.row = h.lf
  JOIN (SELECT run, min(row) AS p FROM runs GROUP BY run) gh ON gh.run = g.run)"""
_ROW_DOCS = """row_docs AS MATERIALIZED (
  SELECT r.row, r.run, CAST(dense_rank() OVER (ORDER BY e.doc_id) - 1 AS INTEGER) AS species
  FROM runs r ASOF JOIN ends e ON r.pos < e.stop)"""
_SETS = f"""{_ROW_DOCS},
run_sets AS (SELECT run, string_agg(DISTINCT species, ',' ORDER BY species) AS docs, count(DISTINCT species) AS n FROM row_docs GROUP BY run),
sets AS MATERIALIZED (
  SELECT docs, any_value(n) AS n, count(*) AS freq, row_number() OVER (ORDER BY min(run)) - 1 AS color_id FROM run_sets GROUP BY docs)"""


# ---- references and k-mers ----------------------------------------------------------------------------------------


@registered(f"SELECT doc_id, regexp_replace(translate(coalesce(text, ''), 'acgt', 'ACGT'), '[^ACGT]', 'A', 'g') AS seq FROM documents")
def clean_seq(spark, sf_dir):
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    return corpus.prepare(docs.select("doc_id", F.col("text").alias("seq")))


@registered(f"WITH {_SEGS} SELECT doc_id, strand, seq FROM segs")
def revcomp(spark, sf_dir):
    return corpus.strands(records(spark, sf_dir))


@registered(f"WITH {_DOCS} SELECT doc_id, CAST(sum(2 * len(seq) + 2) OVER (ORDER BY doc_id) AS BIGINT) AS end_off FROM docs")
def doc_offsets(spark, sf_dir):
    return corpus.doc_offsets(records(spark, sf_dir))


@registered(f"WITH {_SEGS} SELECT kmer, count(*) AS cnt FROM {_kmers('segs', '', SHORT_K, '')} GROUP BY kmer")
def kmer_table(spark, sf_dir):
    return scan.all_counts(records(spark, sf_dir), SHORT_K)


@registered(
    f"WITH {_SEGS}, u AS (SELECT DISTINCT kmer FROM {_kmers('segs', '', SHORT_K, '')}) SELECT kmer, CAST("
    + " + ".join(f"(strpos('ACGT', substr(kmer, {i + 1}, 1)) - 1) * {4 ** (SHORT_K - 1 - i)}" for i in range(SHORT_K))
    + " AS BIGINT) AS code, kmer AS decoded FROM u"
)
def kmer_codec(spark, sf_dir):
    table = scan.all_counts(records(spark, sf_dir), SHORT_K)
    coded = table.select("kmer", S.kmer_code(F.col("kmer")).alias("code"))
    return coded.withColumn("decoded", S.kmer_decode(F.col("code"), SHORT_K))


@registered(
    f"""WITH {_SEGS}, {_READS}
SELECT read_id, count(kmer) FILTER (kmer IN (SELECT kmer FROM {_kmers('segs', '', REPORT_K, '')})) AS found,
       CAST(any_value(greatest(len(seq) - {REPORT_K - 1}, 0)) AS BIGINT) AS total
FROM reads LEFT JOIN {_kmers('reads', 'read_id, ', REPORT_K)} USING (read_id) GROUP BY read_id"""
)
def kmer_membership(spark, sf_dir):
    return engine(spark, sf_dir).kmer_membership(items(spark, sf_dir), REPORT_K)


@registered(
    f"""WITH RECURSIVE {_SEGS}, {_READS}, {_islands(REPORT_K)},
lefts AS MATERIALIZED (
  SELECT read_id, pos, min(s) AS s
  FROM (SELECT DISTINCT read_id, s, e FROM islands), LATERAL (SELECT unnest(range(s + {REPORT_K - 1}, e)) AS pos) GROUP BY read_id, pos),
walk AS (
  SELECT read_id, CAST(len(seq) - 1 AS BIGINT) AS pos FROM reads
  UNION ALL
  SELECT w.read_id, CASE WHEN l.s IS NULL THEN w.pos - 1 ELSE l.s + {REPORT_K - 2} END
  FROM walk w LEFT JOIN lefts l USING (read_id, pos) WHERE w.pos >= {REPORT_K - 1}),
tokens AS (SELECT read_id, pos, s, pos + 1 - s - {REPORT_K - 1} AS n FROM walk JOIN lefts USING (read_id, pos))
SELECT r.read_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS found, CAST(any_value(greatest(len(r.seq) - {REPORT_K - 1}, 0)) AS BIGINT) AS total,
       coalesce(string_agg(s || ':' || n, ' ' ORDER BY pos DESC), '') AS tokens
FROM reads r LEFT JOIN tokens t ON r.read_id = t.read_id GROUP BY r.read_id"""
)
def kmer_tokens(spark, sf_dir):
    return engine(spark, sf_dir).kmer(items(spark, sf_dir), REPORT_K)


_COUNTED = f"""WITH {_SEGS}, {_READS},
table_ AS (SELECT kmer, count(*) AS cnt FROM {_kmers('segs', '', COUNT_K, '')} GROUP BY kmer),
hits AS (SELECT read_id, cnt FROM {_kmers('reads', 'read_id, ', COUNT_K)} JOIN table_ USING (kmer))"""


@registered(f"{_COUNTED} SELECT count(*) AS found, CAST(coalesce(sum(cnt), 0) AS BIGINT) AS occurrences FROM hits")
def kmer_count(spark, sf_dir):
    reads = items(spark, sf_dir)
    return kmers.count_total(reads, engine(spark, sf_dir).table(reads, COUNT_K), COUNT_K)


@registered(f"{_COUNTED} SELECT read_id, count(cnt) AS found, CAST(coalesce(sum(cnt), 0) AS BIGINT) AS occurrences FROM reads LEFT JOIN hits USING (read_id) GROUP BY read_id")
def kmer_count_by_read(spark, sf_dir):
    return engine(spark, sf_dir).kmer_count(items(spark, sf_dir), COUNT_K)


# ---- matches ------------------------------------------------------------------------------------------------------


@registered(f"WITH {_SEGS}, {_READS}, {_ms()} SELECT read_id, pos, len FROM ms")
def matching_statistics(spark, sf_dir):
    return engine(spark, sf_dir).ms(items(spark, sf_dir))


@registered(
    f"""WITH RECURSIVE {_SEGS}, {_READS}, {_left()}
SELECT read_id, pos, least(coalesce(e - 1 - pos, 0), 65535) AS len
FROM (SELECT read_id, unnest(range(0, len(seq))) AS pos FROM reads)
LEFT JOIN (SELECT read_id, e, unnest(range(s, e)) AS pos FROM factors) USING (read_id, pos)"""
)
def zml(spark, sf_dir):
    return engine(spark, sf_dir).zml(items(spark, sf_dir))


@registered(
    f"""WITH RECURSIVE {_SEGS}, {_READS}, {_left()},
suffixes AS (SELECT read_id, seq, coalesce(l.len, 0) AS matched, len(seq) AS total FROM reads LEFT JOIN lefts l USING (read_id) WHERE l.pos = len(seq) - 1 OR seq = ''),
wanted AS (SELECT DISTINCT matched AS n, right(seq, matched) AS word FROM suffixes WHERE matched BETWEEN 1 AND {SEED - 1}),
short_found AS (
  SELECT word, count(*) AS cnt
  FROM (SELECT substr(seq, p + 1, n) AS word FROM (SELECT seq, n, unnest(range(0, len(seq) - n + 1)) AS p FROM segs, (SELECT DISTINCT n FROM wanted) WHERE len(seq) >= n))
  WHERE word IN (SELECT word FROM wanted) GROUP BY word),
long_found AS (
  SELECT read_id, count(*) AS cnt FROM suffixes JOIN islands i USING (read_id) WHERE matched >= {SEED} AND i.e = total AND i.s <= total - matched GROUP BY read_id)
SELECT read_id, CAST(matched AS BIGINT) AS matched, CAST(total AS BIGINT) AS total, CAST(coalesce(l.cnt, s.cnt, 0) AS BIGINT) AS occurrences
FROM suffixes LEFT JOIN long_found l USING (read_id) LEFT JOIN short_found s ON word = right(seq, matched) AND matched BETWEEN 1 AND {SEED - 1}"""
)
def count_suffix(spark, sf_dir):
    return engine(spark, sf_dir).count(items(spark, sf_dir))


@registered(
    f"""WITH {_SEGS}, {_READS}, {_islands(MEM)},
spans AS (SELECT read_id, s, e, count(*) AS n FROM islands GROUP BY read_id, s, e),
best AS (SELECT * FROM spans a WHERE NOT EXISTS (SELECT 1 FROM spans b WHERE b.read_id = a.read_id AND b.s <= a.s AND b.e >= a.e AND (b.s < a.s OR b.e > a.e)))
SELECT a.read_id, a.s, a.e, CAST(sum(b.n) AS BIGINT) AS cnt
FROM best a JOIN spans b ON b.read_id = a.read_id AND b.s <= a.s AND b.e >= a.e GROUP BY a.read_id, a.s, a.e"""
)
def mem(spark, sf_dir):
    return engine(spark, sf_dir).mem(items(spark, sf_dir), MEM)


# ---- suffix order -------------------------------------------------------------------------------------------------


@registered(f"WITH {_TEXT} SELECT row, pos FROM sa")
def suffix_array(spark, sf_dir):
    return small_engine(spark, sf_dir).index.sa


@registered(f"WITH {_BWT} SELECT row, c FROM bwt")
def burrows_wheeler(spark, sf_dir):
    return small_engine(spark, sf_dir).index.rows.select("row", "c")


@registered(f"WITH {_BWT} SELECT CAST(run AS BIGINT) AS run, any_value(c) AS c, count(*) AS n FROM runs GROUP BY run")
def bwt_runs(spark, sf_dir):
    return small_engine(spark, sf_dir).index.rows.groupBy("run").agg(F.min_by("c", "row").alias("c"), F.count("*").alias("n"))


@registered(f"WITH {_TEXT} SELECT CAST(row_number() OVER (ORDER BY c) - 1 AS INTEGER) AS code, c, cnt FROM (SELECT c, count(*) AS cnt FROM chars WHERE c <> '$' GROUP BY c)")
def alphabet_counts(spark, sf_dir):
    return bwt.alphabet(small_engine(spark, sf_dir).index.text)


@registered(f"WITH {_BWT} SELECT row, lf FROM bwt")
def lf_map(spark, sf_dir):
    return small_engine(spark, sf_dir).index.rows.select("row", "lf")


@registered(f"WITH {_BWT} SELECT row, c, lf FROM bwt")
def lf_of_transform(spark, sf_dir):
    """From the transform's characters alone."""
    return bwt.lf_of_transform(small_engine(spark, sf_dir).index.rows.select("row", "c"))


@registered(f"WITH {_TEXT} SELECT row, pos FROM sa")
def places_of_transform(spark, sf_dir):
    """The suffix array read off the transform."""
    return bwt.places_of_transform(small_engine(spark, sf_dir).index.rows.select("row", "c", "lf"))


@registered(f"WITH {_BWT} SELECT CAST(run AS BIGINT) AS run, c, p, n, CAST(id AS BIGINT) AS id, off FROM moves")
def move_rows(spark, sf_dir):
    return small_engine(spark, sf_dir).index.moves


@registered(
    f"""WITH {_BWT}, counts AS (SELECT c, count(*) AS cnt FROM chars GROUP BY c),
f AS (SELECT c, CAST(sum(cnt) OVER (ORDER BY c) AS BIGINT) AS stop, cnt FROM counts)
SELECT f.c, stop - cnt AS first_row, stop - 1 AS last_row, CAST(a.run AS BIGINT) AS first_run, CAST(b.run AS BIGINT) AS last_run
FROM f JOIN runs a ON a.row = stop - cnt JOIN runs b ON b.row = stop - 1 WHERE f.c <> '$'"""
)
def first_last(spark, sf_dir):
    index = small_engine(spark, sf_dir).index
    return bwt.first_last(index.text, index.rows)


@registered(f"WITH {_TEXT} SELECT row, pos FROM sa WHERE row % 100 = 0")
def sampled_sa(spark, sf_dir):
    return bwt.sampled(small_engine(spark, sf_dir).index.sa)


@registered(
    f"""WITH {_BWT}, letters AS (SELECT unnest(['A', 'C', 'G', 'T']) AS b),
x AS (
  SELECT m.run, m.c, b, max(CASE WHEN m.c = b THEN m.run END) OVER (PARTITION BY b ORDER BY m.run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above,
         min(CASE WHEN m.c = b THEN m.run END) OVER (PARTITION BY b ORDER BY m.run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS below
  FROM moves m, letters)
SELECT CAST(run AS BIGINT) AS run, b AS c, CAST(coalesce(run - above, 0) AS BIGINT) AS up, CAST(coalesce(below - run, 0) AS BIGINT) AS down
FROM x WHERE c <> b AND (above IS NOT NULL OR below IS NOT NULL)"""
)
def next_up_down(spark, sf_dir):
    """0 stands for none."""
    return bwt.neighbours(small_engine(spark, sf_dir).index.moves).fillna(0)


@registered(f"WITH {_BWT}, back AS (SELECT lf, pos FROM bwt) SELECT count(*) AS n, count(DISTINCT lf) AS distinct_lf, count(*) = count(DISTINCT lf) AS ok FROM back")
def lf_verify(spark, sf_dir):
    return bwt.verify(small_engine(spark, sf_dir).index.rows)


@registered(f"WITH {_TEXT} SELECT pos, c FROM chars")
def reconstruct_text(spark, sf_dir):
    """From the transform's characters alone."""
    return bwt.reconstruct(small_engine(spark, sf_dir).index.rows)


@registered(f"WITH {_BWT} SELECT count(*) AS n, count(DISTINCT run) AS r, count(*) / count(DISTINCT run) AS ratio, max(row) FILTER (c = '$') AS end_row FROM runs")
def inspect_stats(spark, sf_dir):
    return bwt.inspect(small_engine(spark, sf_dir).index.rows)


@registered(f"WITH {_BWT} SELECT CAST(p.power AS INTEGER) AS power, count(*) FILTER (n >= pow(2, p.power)) AS at_least FROM moves, range(0, 16) p(power) GROUP BY p.power")
def row_histogram(spark, sf_dir):
    return bwt.row_histogram(small_engine(spark, sf_dir).index.moves)


@registered(
    f"""WITH {_BWT}, borders AS (SELECT run, arg_min(pos, row) AS a, arg_max(pos, row) AS b FROM runs GROUP BY run),
x AS (SELECT run, d, CASE WHEN a >= d AND b >= d THEN substr(t, a - d + 1, 1) = substr(t, b - d + 1, 1) ELSE false END AS same FROM borders, whole, range(1, 34) r(d))
SELECT CAST(run AS BIGINT) AS run, CAST(coalesce(min(d) FILTER (NOT same), 34) - 1 AS INTEGER) AS lcs FROM x GROUP BY run"""
)
def run_lcs(spark, sf_dir):
    index = small_engine(spark, sf_dir).index
    return bwt.run_lcs(index.rows, index.text)


@registered(f"WITH {_BWT} SELECT c, CAST(run AS BIGINT) AS run, CAST(id AS BIGINT) AS id FROM moves")
def output_ids(spark, sf_dir):
    return small_engine(spark, sf_dir).index.moves.select("c", "run", "id")


@registered(f"WITH {_TEXT} SELECT row, pos FROM sa")
def located(spark, sf_dir):
    """Places of all rows by steps of LF to a sampled row."""
    index = small_engine(spark, sf_dir).index
    return bwt.locate(index.rows, bwt.sampled(index.sa, 10), index.rows.select("row"))


# ---- colors -------------------------------------------------------------------------------------------------------


@registered(f"WITH {_BWT}, {_ROW_DOCS} SELECT row, species FROM row_docs")
def doc_of_row(spark, sf_dir):
    return small_engine(spark, sf_dir).index.documents.select("row", "species")


@registered(f"WITH {_BWT}, {_SETS} SELECT CAST(run AS BIGINT) AS run, color_id FROM run_sets JOIN sets USING (docs)")
def color_of_run(spark, sf_dir):
    return small_engine(spark, sf_dir).index.colors[0]


@registered(f"WITH {_BWT}, {_SETS} SELECT color_id, docs, freq FROM sets")
def color_sets(spark, sf_dir):
    named = small_engine(spark, sf_dir).index.colors[1]
    return named.select("color_id", F.array_join(F.transform("docs", lambda x: x.cast("string")), ",").alias("docs"), "freq")


@registered(f"WITH {_BWT}, {_SETS} SELECT color_id, CAST(sum(n + 1) OVER (ORDER BY color_id) - n - 1 AS BIGINT) AS flat_off, CAST(n AS INTEGER) AS size FROM sets")
def flat_colors(spark, sf_dir):
    return colors.flat_colors(small_engine(spark, sf_dir).index.colors[1])


@registered(f"WITH {_BWT}, {_SETS} SELECT color_id, freq FROM sets ORDER BY n = 1 DESC, freq DESC, color_id DESC LIMIT 64")
def color_freq_topk(spark, sf_dir):
    return colors.frequent(small_engine(spark, sf_dir).index.colors[1], 64).select("color_id", "freq")


@registered(
    f"""WITH {_BWT}, {_SETS}, m AS (SELECT DISTINCT run, species FROM row_docs)
SELECT x.species AS a, y.species AS b, count(*) AS together FROM m x JOIN m y ON x.run = y.run AND x.species < y.species GROUP BY 1, 2"""
)
def color_similarity(spark, sf_dir):
    return colors.similarity(small_engine(spark, sf_dir).index.colors[1])


# ---- classification -----------------------------------------------------------------------------------------------

_NULLS = "nulls AS MATERIALIZED (SELECT read_id, reverse(seq) AS seq FROM reads)"
_NULL_STATS = f"""WITH {_SEGS}, {_READS}, {_NULLS}, {_ms('nulls')},
counts AS (SELECT len, count(*) AS cnt FROM ms GROUP BY len)"""


def _null_statistics(spark, sf_dir) -> DataFrame:
    """Of matching statistics of reversed reads."""
    return classify.null_statistics(engine(spark, sf_dir).ms(classify.null_reversed(items(spark, sf_dir))))


@registered(
    f"""{_NULL_STATS}
SELECT CAST(sum(cnt) AS BIGINT) AS num_values, CAST(sum(len * cnt) AS DOUBLE) / sum(cnt) AS mean, CAST(coalesce(max(len) FILTER (cnt >= 5), 0) AS BIGINT) AS percentile FROM counts"""
)
def null_percentile(spark, sf_dir):
    return _null_statistics(spark, sf_dir)


@registered(f"WITH {_DOCS} SELECT doc_id AS read_id, reverse(seq) AS seq FROM docs")
def null_reads_whole(spark, sf_dir):
    """A null sample of whole references, reversed."""
    return classify.null_reversed(doc_reads(spark, sf_dir))


@registered()
def null_reads_drawn(spark, sf_dir):
    """A null sample drawn by hash, the same whenever it is drawn."""
    return classify.null_reads(records(spark, sf_dir))


_BINS = f"""WITH {_SEGS}, {_READS}, {_ms()},
bins AS MATERIALIZED (
  SELECT read_id, CAST(least(floor((len(seq) - 1 - pos) / {BIN}), greatest(floor(len(seq) / {BIN}), 1) - 1) AS BIGINT) AS bin, max(ms.len) AS top
  FROM ms JOIN reads USING (read_id) GROUP BY 1, 2)"""


def _bins(spark, sf_dir) -> DataFrame:
    reads = items(spark, sf_dir)
    sizes = reads.select("read_id", F.char_length("seq").cast("long").alias("total"))
    return classify.bins(engine(spark, sf_dir).ms(reads), sizes, BIN)


@registered(f"{_BINS} SELECT read_id, bin, top FROM bins")
def bin_max(spark, sf_dir):
    return _bins(spark, sf_dir)


THR = 14
_REPORT = f"""{_BINS},
report AS (SELECT read_id, avg(top) AS avg_max, count(*) FILTER (top >= {THR}) AS above, count(*) FILTER (top < {THR}) AS below FROM bins GROUP BY read_id),
verdicts AS (SELECT read_id, CASE WHEN above / (above + below) > 0.5 THEN 'FOUND' ELSE 'NOT_PRESENT' END AS status, avg_max, above, below FROM report)"""


def _report(spark, sf_dir) -> DataFrame:
    thr = spark.range(1).select(F.lit(THR).cast("long").alias("thr"))
    return classify.report(_bins(spark, sf_dir), thr)


@registered(f"{_REPORT} SELECT * FROM verdicts")
def classify_report(spark, sf_dir):
    return _report(spark, sf_dir)


@registered(f"{_REPORT} SELECT read_id, seq FROM reads WHERE read_id IN (SELECT read_id FROM verdicts WHERE status = 'FOUND')")
def filter_found(spark, sf_dir):
    return classify.filtered(items(spark, sf_dir), _report(spark, sf_dir))


@registered(f"{_REPORT} SELECT read_id, seq FROM reads WHERE read_id NOT IN (SELECT read_id FROM verdicts WHERE status = 'FOUND')")
def filter_invert(spark, sf_dir):
    return classify.filtered(items(spark, sf_dir), _report(spark, sf_dir), invert=True)


# Votes: a base votes for every species with a match of MEM bases over it.
_VOTES = f"""WITH RECURSIVE {_SEGS}, {_READS}, {_islands(MEM)},
species AS (SELECT doc_id, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS species FROM docs WHERE lang IS NOT NULL),
covered AS MATERIALIZED (
  SELECT DISTINCT read_id, species, pos
  FROM (SELECT DISTINCT read_id, species, s, e FROM islands JOIN species USING (doc_id)), LATERAL (SELECT unnest(range(s, e)) AS pos)),
votes AS MATERIALIZED (SELECT read_id, species, count(*) AS cnt FROM covered GROUP BY read_id, species)"""


def _covered(spark, sf_dir) -> DataFrame:
    spans = engine(spark, sf_dir).species_spans(items(spark, sf_dir), MEM)
    return spans.select("read_id", "species", F.explode(F.sequence("s", F.col("e") - 1)).alias("pos")).distinct()


def _votes(spark, sf_dir, covered: DataFrame | None = None) -> DataFrame:
    covered = covered if covered is not None else _covered(spark, sf_dir)
    return covered.groupBy("read_id", "species").agg(F.count("*").alias("cnt"))


@registered(f"{_VOTES} SELECT read_id, species, cnt FROM votes")
def color_votes(spark, sf_dir):
    return _votes(spark, sf_dir)


_TWO = f"""{_VOTES},
two AS (
  SELECT read_id, max(species) FILTER (rank = 1) AS best, max(cnt) FILTER (rank = 1) AS best_cnt, max(species) FILTER (rank = 2) AS second, max(cnt) FILTER (rank = 2) AS second_cnt
  FROM (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY cnt DESC, species) AS rank FROM votes) GROUP BY read_id)"""


@registered(f"{_TWO} SELECT read_id, best, best_cnt, coalesce(second, -1) AS second, coalesce(second_cnt, 0) AS second_cnt FROM two")
def best_second(spark, sf_dir):
    """A second of -1 stands for none."""
    return classify.best_two(_votes(spark, sf_dir)).fillna({"second": -1, "second_cnt": 0})


@registered(
    f"""{_TWO},
means AS (SELECT read_id, coalesce(count(DISTINCT pos) / nullif(any_value(len(seq)), 0), 0) AS mean FROM reads LEFT JOIN covered USING (read_id) GROUP BY read_id)
SELECT read_id, CASE WHEN best IS NOT NULL AND mean >= 0.4 THEN best ELSE 0 END AS best,
       CASE WHEN best IS NOT NULL AND mean >= 0.4 AND best_cnt - second_cnt < 0.05 * best_cnt THEN second ELSE 0 END AS second
FROM means LEFT JOIN two USING (read_id)"""
)
def read_classes(spark, sf_dir):
    """With the share of covered bases in place of the mean length."""
    reads = items(spark, sf_dir)
    each = _covered(spark, sf_dir)
    covered = each.select("read_id", "pos").distinct().groupBy("read_id").agg(F.count("*").alias("n"))
    size = F.nullif(F.char_length("seq"), F.lit(0))
    means = reads.join(covered, "read_id", "left").select("read_id", F.coalesce(F.col("n") / size, F.lit(0.0)).alias("mean"))
    return classify.classes(classify.best_two(_votes(spark, sf_dir, each)), means)


@registered(f"{_VOTES}, t AS (SELECT *, max(cnt) OVER (PARTITION BY read_id) AS top FROM votes) SELECT read_id, species, cnt FROM t WHERE cnt = top OR top - cnt < 0.05 * top")
def report_all(spark, sf_dir):
    return classify.report_all(_votes(spark, sf_dir))


@registered(
    f"""{_VOTES}, bases AS (SELECT read_id, count(DISTINCT pos) AS voting FROM reads LEFT JOIN covered USING (read_id) GROUP BY read_id)
SELECT b.read_id, coalesce(string_agg(species, ',' ORDER BY species), '0') AS classes
FROM bases b LEFT JOIN votes v ON v.read_id = b.read_id AND v.cnt >= 0.5 * b.voting GROUP BY b.read_id"""
)
def min_score_frac(spark, sf_dir):
    each = _covered(spark, sf_dir)
    voting = each.select("read_id", "pos").distinct().groupBy("read_id").agg(F.count("*").alias("voting"))
    bases = items(spark, sf_dir).select("read_id").join(voting, "read_id", "left").fillna(0)
    return classify.min_score(_votes(spark, sf_dir, each), bases, 0.5)


@registered(
    f"""{_VOTES}, sizes AS (SELECT species, sum(2 * len(seq)) AS bases FROM docs JOIN species USING (doc_id) GROUP BY species),
x AS (SELECT read_id, species, {MEM} - ln(bases) / ln(4.0) AS value FROM covered JOIN sizes USING (species))
SELECT read_id, species, round(sum(least(value, 1.0)), 6) AS score FROM x WHERE value >= 0 GROUP BY read_id, species"""
)
def pvalue_scoring(spark, sf_dir):
    """Each covered base scores as a match of MEM bases."""
    index = engine(spark, sf_dir).index
    sizes = index.segments.join(index.species.select("doc_id", "species"), "doc_id").groupBy("species").agg(F.sum(F.char_length("seq")).alias("bases"))
    scores = classify.pvalue_scores(_covered(spark, sf_dir).withColumn("len", F.lit(MEM)), sizes)
    return scores.select("read_id", "species", F.round("score", 6).alias("score"))


@registered(
    f"""WITH RECURSIVE {_SEGS}, {_READS}, {_left()},
species AS (SELECT doc_id, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS species FROM docs WHERE lang IS NOT NULL)
SELECT f.read_id, species, CAST(sum(f.e - f.s) AS BIGINT) AS cnt
FROM factors f JOIN islands i ON i.read_id = f.read_id AND i.s <= f.s AND i.e >= f.e JOIN species USING (doc_id)
WHERE f.e - f.s >= {REPORT_K} GROUP BY f.read_id, species"""
)
def zml_multiclass(spark, sf_dir):
    held, reads = engine(spark, sf_dir), items(spark, sf_dir)
    return colors.factor_votes(held.factors(reads), held.species_spans(reads, REPORT_K), REPORT_K)


# ---- taxonomy -----------------------------------------------------------------------------------------------------


@registered(
    """WITH RECURSIVE tree AS (
  SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'r' || r_regionkey, 'root' FROM region),
pairs AS (SELECT c_custkey AS key, 'n' || c_nationkey AS a, 'n' || s_nationkey AS b FROM customer JOIN supplier ON c_custkey = s_suppkey),
up AS (
  SELECT child AS node, child AS ancestor, 0 AS steps FROM tree
  UNION ALL SELECT node, parent, steps + 1 FROM up JOIN tree ON ancestor = child)
SELECT key, arg_min(x.ancestor, x.steps) AS lca
FROM pairs JOIN up x ON x.node = a JOIN up y ON y.node = b AND y.ancestor = x.ancestor GROUP BY key"""
)
def taxon_lca(spark, sf_dir):
    read = lambda t: ship(spark).read.parquet(f"{sf_dir}/{t}.parquet")
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    tree = read("nation").select(name("n", "n_nationkey").alias("child"), name("r", "n_regionkey").alias("parent"))
    tree = tree.unionByName(read("region").select(name("r", "r_regionkey").alias("child"), F.lit("root").alias("parent")))
    pairs = read("customer").join(read("supplier"), F.col("c_custkey") == F.col("s_suppkey"))
    pairs = pairs.select(F.col("c_custkey").alias("key"), name("n", "c_nationkey").alias("a"), name("n", "s_nationkey").alias("b"))
    return taxonomy.lca(pairs, tree, "root", "")


# ---- walks over the transform: sequential, so without SQL; tests hold them against brute force --------------------


@registered()
def pml_lengths(spark, sf_dir):
    return pml.long_form(small_engine(spark, sf_dir).pml(doc_reads(spark, sf_dir)))


@registered()
def rpml_lengths(spark, sf_dir):
    return pml.long_form(small_engine(spark, sf_dir).rpml(doc_reads(spark, sf_dir)))


@registered()
def sa_entries(spark, sf_dir):
    found = small_engine(spark, sf_dir).pml(doc_reads(spark, sf_dir), sa_entries=True)
    return found.select("read_id", F.posexplode("sa").alias("pos", "sa"))


@registered()
def report_colors(spark, sf_dir):
    """The color of each base's row, -1 for a base without a match or a row without documents."""
    return small_engine(spark, sf_dir).report_colors(doc_reads(spark, sf_dir))


@registered()
def pml_classes(spark, sf_dir):
    return small_engine(spark, sf_dir).multi_class(doc_reads(spark, sf_dir))


@registered()
def pml_report(spark, sf_dir):
    return small_engine(spark, sf_dir).classify(doc_reads(spark, sf_dir))


@registered()
def early_stop(spark, sf_dir):
    return classify.early_stop(small_engine(spark, sf_dir).pml(doc_reads(spark, sf_dir)))


@registered()
def tree_compress(spark, sf_dir):
    index = small_engine(spark, sf_dir).index
    named = index.colors[1]
    count = index.species.select("species").distinct().count()
    merges = colors.clusters(colors.similarity(named), count, index.moves.count())
    packed = colors.tree_compress(named, merges, count)
    return packed.select("color_id", F.array_join(F.transform("docs", lambda x: x.cast("string")), ",").alias("docs"))


@registered()
def bpf_roundtrip(spark, sf_dir):
    profiles = small_engine(spark, sf_dir).pml(items(spark, sf_dir))
    back = bpf.from_files(bpf.to_files(profiles))
    return back.select("read_id", F.posexplode("lens").alias("pos", "len"))
