"""Pseudo-matching lengths: a walk over the transform, one step a base, for all reads of a batch at once.

The walk depends on its own past, so it is no join: steps for each row and base are looked up in arrays that are
broadcast. Their size is that of the indexed text; MOST_ROWS bounds it, beyond it matching statistics
(``matches.matching_statistics``), which need no index in memory, are the way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions.sequence import BASES, TERMINATOR

#: Rows of an index that is broadcast: 37 bytes a row on the driver and in each Python worker.
MOST_ROWS = 50_000_000
#: Lengths are clamped.
CLAMP = 65_535
#: Reads that are walked together, by bases.
TOGETHER = 4 << 20
#: Bases of reads whose results a worker holds at once, or one read.
SLICE = 2 << 20
#: Votes of runs for species that are written out at once, or those of one run.
SPREAD = 4 << 20


@dataclass
class Index:
    """For each row and base the row that the walk goes on from; each row's LF step and base, its suffix's place and run."""

    goal: np.ndarray  # rows x bases, int32; -1 for a base that the text lacks
    lf: np.ndarray  # int32
    base: np.ndarray  # int8, -1 for other characters
    pos: np.ndarray
    run: np.ndarray
    start: int

    @property
    def rows(self) -> int:
        return len(self.pos)


def lcp_array(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Longest common prefixes of neighbours in suffix order (the first is 0), by doubling from long to short: all
    neighbours at once, comparing blocks by their ranks."""
    n = len(sa)
    levels = [np.unique(text, return_inverse=True)[1].astype(np.int64)]
    h = 1
    while h < n and len(np.unique(levels[-1])) < n:
        rank = levels[-1]
        second = np.full(n, -1, np.int64)
        second[: n - h] = rank[h:]
        levels.append(np.unique(rank * (n + 1) + second + 1, return_inverse=True)[1])
        h *= 2
    out = np.zeros(n, np.int64)
    a, b = sa[:-1].copy(), sa[1:].copy()
    done = np.zeros(max(n - 1, 0), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = np.zeros(len(a), bool)
        same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
        same &= (a + (1 << k) <= n) & (b + (1 << k) <= n)
        done[same] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    out[1:] = done
    return out


def cuts(lcp: np.ndarray, same: np.ndarray, last: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the gaps between rows with a base (``same``): first and last row of the gap, and its threshold, the place of the
    least common prefix from the gap's first row to the row below it; ``last``: the last of equal minima."""
    gap = np.flatnonzero(~same)
    if not gap.size:
        return gap, gap, gap
    breaks = np.flatnonzero(np.diff(gap) > 1)
    first, end = gap[np.concatenate([[0], breaks + 1])], gap[np.append(breaks, len(gap) - 1)]
    stop = np.minimum(end + 1, len(lcp) - 1)  # the row below the gap
    size = stop - first + 1
    owner = np.repeat(np.arange(len(first)), size)
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + first[owner]
    values = lcp[place]
    least = np.minimum.reduceat(values, np.cumsum(size) - size)
    at = np.flatnonzero(values == least[owner])
    pick = np.searchsorted(owner[at], np.arange(len(first)), side="right" if last else "left") - last
    return first, end, place[at[pick]]


def _lcp_of(table: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Characters and least common prefixes of a transform's rows in order."""
    char, pos, n = table["c"].to_numpy(), table["pos"].to_numpy(), len(table)
    text = np.empty(n, "U1")
    text[(pos - 1) % n] = char
    codes = np.array([0 if c == TERMINATOR else ord(c) for c in text], np.int64) if n else np.zeros(0, np.int64)
    return char, lcp_array(codes, pos)


def thresholds(table: pd.DataFrame) -> pd.DataFrame:
    """``c, first, last, cut`` of the whole transform (row, pos, c): gaps between rows with a base, and the row from which on
    a walk that looks for the base goes down."""
    char, lcp = _lcp_of(table.sort_values("row"))
    found = [pd.DataFrame(dict(zip(("first", "last", "cut"), cuts(lcp, char == base)))).assign(c=base) for base in BASES if (char == base).any()]
    return pd.concat([*found, pd.DataFrame({"c": [], "first": [], "last": [], "cut": []})]).astype({"c": str, "first": "int64", "last": "int64", "cut": "int64"})[["c", "first", "last", "cut"]]


def split_rows(table: pd.DataFrame) -> int:
    """How many rows the index has when runs are split at every threshold inside them that parts rows of a gap."""
    table = table.sort_values("row")
    run = table["run"].to_numpy()
    heads = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if len(run) else run
    found = thresholds(table)
    inside = found[(found["cut"] > found["first"]) & (found["cut"] <= found["last"])]["cut"]
    return len(np.union1d(heads, inside))


def build(table: pd.DataFrame, thresholds: bool = True, last: bool = False) -> Index:
    """An index from the whole transform (row, pos, c, lf, run).

    ``thresholds``: a base that does not match moves down if its row is at or below the least common prefix between the
    rows with this base above and below, else up; ``last``: the last of equal minima. Without thresholds it moves to
    the nearer end of its run.
    """
    table = table.sort_values("row")
    n = len(table)
    if n > MOST_ROWS:
        raise ValueError(f"an index of {n} rows is too large to broadcast; matching statistics take any size")
    lf, pos, run = (table[c].to_numpy() for c in ("lf", "pos", "run"))
    char, lcp = _lcp_of(table)
    goals, own = np.zeros((n, len(BASES)), np.int32), np.full(n, -1, np.int8)
    place = np.arange(n)
    heads = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if n else place
    first = heads[np.searchsorted(heads, place, side="right") - 1] if n else place
    size = np.diff(np.append(heads, n))[np.searchsorted(heads, place, side="right") - 1] if n else place
    for k, base in enumerate(BASES):
        same = char == base
        up = np.maximum.accumulate(np.where(same, place, -1))
        down = np.minimum.accumulate(np.where(same, place, n)[::-1])[::-1]
        if thresholds:
            cut = np.zeros(n, np.int64)
            begin, end, at = cuts(lcp, same, last)
            cut[np.flatnonzero(~same)] = np.repeat(at, end - begin + 1)
            go_down = place >= cut
        else:
            go_down = 2 * (place - first) >= size
        goal = np.where(go_down, down, up)
        goal = np.where(goal == n, up, np.where(goal < 0, down, goal))
        goal = np.where(same, place, goal)
        goals[:, k] = np.where((goal >= 0) & (goal < n), goal, -1)
        own[same] = k
    return Index(goals, lf.astype(np.int32), own, pos, run, n - 1)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch (read_id, seq) in parts of SLICE bases at most, or of one read."""
    ends = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SLICE, side="right"))
        stop = max(stop, start + 1)
        yield batch.slice(start, stop - start)
        start = stop


def walk(index: Index, reads: list[str], rows: bool = False) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Lengths of each read, left to right, and, with ``rows``, the row of each base before and after its LF step.

    A character that is no base of the text has length 0 and leaves the row where it is; the LF step is taken all the same.
    """
    lengths = np.array([len(r) for r in reads])
    order = np.argsort(-lengths, kind="stable")
    code = np.full(256, -1, np.int8)
    for k, base in enumerate(BASES):
        code[ord(base)] = k
    out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(reads)
    befores: list[np.ndarray] = [np.zeros(0, np.int64)] * len(reads)
    afters: list[np.ndarray] = [np.zeros(0, np.int64)] * len(reads)
    low = 0
    while low < len(order):
        width = int(lengths[order[low]])
        high = min(len(order), low + max(1, TOGETHER // max(width, 1)))
        some, low = order[low:high], high
        if not width or not index.rows:
            for i in some:
                out[i], befores[i], afters[i] = np.zeros(lengths[i], np.int32), np.full(lengths[i], -1), np.full(lengths[i], -1)
            continue
        bases = np.full((len(some), width), -1, np.int8)
        for j, i in enumerate(some):
            bases[j, : lengths[i]] = code[np.frombuffer(reads[i].encode("ascii", "replace"), np.uint8)][::-1]
        now, length = np.full(len(some), index.start), np.zeros(len(some), np.int32)
        found, before, after = np.zeros((len(some), width), np.int32), *(np.full((len(some), width if rows else 0), -1, np.int32) for _ in "ba")
        live = len(some)
        for t in range(width):  # right to left, all reads that are long enough
            while live and lengths[some[live - 1]] <= t:
                live -= 1
            c = bases[:live, t]
            legal = c >= 0
            at = now[:live]
            c0 = np.where(legal, c, 0)
            goal = index.goal[at, c0]
            known = legal & (goal >= 0)
            length[:live] = np.where(known & (index.base[at] == c0), length[:live] + 1, 0)
            goal = np.where(known, goal, at)
            now[:live] = index.lf[goal]
            found[:live, t] = length[:live]
            if rows:
                before[:live, t], after[:live, t] = goal, now[:live]
        for j, i in enumerate(some):
            out[i] = np.minimum(found[j, : lengths[i]][::-1], CLAMP)
            befores[i], afters[i] = before[j, : lengths[i]][::-1], after[j, : lengths[i]][::-1]
    return out, befores, afters


def query(reads: DataFrame, index: Index, sa_entries: bool = False, runs: bool = False) -> DataFrame:
    """``read_id, lens`` (array, left to right) and, if asked for, ``sa``, the text's place of the row that each base has been
    looked up in, before the LF step, and ``runs``, the run of the row after it."""
    shared = reads.sparkSession.sparkContext.broadcast(index)
    kind = reads.schema["read_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in (part for whole in batches for part in _parts(whole)):
            lens, before, after = walk(held, [s or "" for s in batch.column(1).to_pylist()], sa_entries or runs)
            columns, names = [batch.column(0), pa.array(lens, pa.list_(pa.int32()))], ["read_id", "lens"]
            for name, wanted, values, stops in (("sa", sa_entries, held.pos, before), ("runs", runs, held.run, after)):
                if wanted:
                    columns.append(pa.array([np.where(s >= 0, values[s], -1) for s in stops], pa.list_(pa.int64())))
                    names.append(name)
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"read_id {kind}, lens array<int>" + ", sa array<long>" * sa_entries + ", runs array<long>" * runs
    return reads.select("read_id", F.col("seq").cast("string").alias("seq")).mapInArrow(run, schema)


def _lists(values: list[np.ndarray], kind: np.dtype) -> pa.ListArray:
    """Arrays as one column of lists."""
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*values, np.zeros(0, kind)]).astype(kind)))


def run_values(reads: DataFrame, index: Index, values: np.ndarray) -> DataFrame:
    """``read_id, found`` (array, left to right): the value of the run of each base's row after its LF step, -1 without a match."""
    shared = reads.sparkSession.sparkContext.broadcast((index, values))
    kind = reads.schema["read_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of_run = shared.value
        for batch in (part for whole in batches for part in _parts(whole)):
            lens, _, after = walk(held, [s or "" for s in batch.column(1).to_pylist()], True)
            found = [np.where(n >= 1, of_run[held.run[a]], -1) if len(n) and held.rows else np.full(len(n), -1) for n, a in zip(lens, after)]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(found, np.int64)], ["read_id", "found"])

    return reads.select("read_id", F.col("seq").cast("string").alias("seq")).mapInArrow(run, f"read_id {kind}, found array<long>")


def _tally(key: np.ndarray, cnt: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different keys with the sum of their counts and their last step."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, np.diff(key) != 0))[: len(key)]
    if not len(key):
        return key, cnt, step
    return key[first], np.add.reduceat(cnt[order], first), np.maximum.reduceat(step[order], first)


def _voted(lens: list[np.ndarray], runs: list[np.ndarray], starts: np.ndarray, species: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Read's number, species, count and last step of votes; ``starts`` of each run's ``species``."""
    sizes = np.array([len(n) for n in lens], np.int64)
    read = np.repeat(np.arange(len(lens)), sizes)
    step = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(read))
    good = np.concatenate(lens) >= least
    count, width = len(starts) - 1, int(species.max(initial=0)) + 1
    key, cnt, step = _tally((read * count + np.concatenate(runs))[good], np.ones(good.sum(), np.int64), step[good])
    read, run = key // max(count, 1), key % max(count, 1)
    size = starts[run + 1] - starts[run]
    ends = np.cumsum(size)
    parts, first = [], 0
    while first < len(run):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + SPREAD, side="right")))
        n = size[first:last]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        of = species[np.repeat(starts[run[first:last]], n) + inner]
        parts.append(_tally(np.repeat(read[first:last], n) * width + of, np.repeat(cnt[first:last], n), np.repeat(step[first:last], n)))
        first = last
    none = np.zeros(0, np.int64)
    key, cnt, step = _tally(*(np.concatenate([none, *x]) for x in zip(*parts))) if parts else (none, none, none)
    return key // width, key % width, cnt, step


def votes(reads: DataFrame, index: Index, starts: np.ndarray, species: np.ndarray, least: int = 1) -> DataFrame:
    """``read_id, mean, voting, votes``: the mean length (0 of none), how many bases have a length of at least ``least``, and
    ``cnt, step`` of these bases' votes for each ``species`` of their runs (``colors.votes``), added up where reads are walked.
    ``starts``: where each run's species start in ``species``, and the end."""
    shared = reads.sparkSession.sparkContext.broadcast((index, starts, species))
    kind = reads.schema["read_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, begin, of_run = shared.value
        for batch in (part for whole in batches for part in _parts(whole)):
            lens, _, after = walk(held, [s or "" for s in batch.column(1).to_pylist()], True)
            runs = [held.run[a] if held.rows else np.zeros(len(a), np.int64) for a in after]
            read, kinds, cnt, step = _voted(lens, runs, begin, of_run, least)
            offsets = np.searchsorted(read, np.arange(batch.num_rows + 1)).astype(np.int32)
            each = pa.StructArray.from_arrays([pa.array(kinds.astype(np.int32)), pa.array(cnt), pa.array(step)], ["species", "cnt", "step"])
            mean = np.array([n.sum(dtype=np.int64) / len(n) if len(n) else 0.0 for n in lens])
            voting = np.array([(n >= least).sum() for n in lens], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(mean), pa.array(voting), pa.ListArray.from_arrays(pa.array(offsets), each)], ["read_id", "mean", "voting", "votes"])

    schema = f"read_id {kind}, mean double, voting long, votes array<struct<species: int, cnt: long, step: long>>"
    return reads.select("read_id", F.col("seq").cast("string").alias("seq")).mapInArrow(run, schema)


def long_form(lengths: DataFrame) -> DataFrame:
    """``read_id, pos, len`` of arrays."""
    return lengths.select("read_id", F.posexplode("lens").alias("pos", "len")).select("read_id", F.col("pos").cast("long"), F.col("len").cast("long"))
