"""Binary profile files: a header, then for each read its id, a count and values from right to left.

Layout, little-endian: a header of 12 bytes (magic, 4; version in three parts, 1 each; entry size in bits, 1; four bytes 0),
then for each read a 16-bit length of the id, the id, a 64-bit count and the values. Lengths have 16 bits, colors 64. A file
without the magic, as files of text places are, is read with a given entry size.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format.
MAGIC, VERSION = 0x42504600, (1, 0, 0)
HEADER = struct.Struct("<IBBBBI")
SIZES = {16: "<u2", 32: "<u4", 64: "<u8"}


def encode(ids: list[str], values: list[list[int]], bits: int = 16, header: bool = True) -> bytes:
    out = [HEADER.pack(MAGIC, *VERSION, bits, 0)] if header else []
    top = (1 << bits) - 1
    for name, row in zip(ids, values):
        raw = name.encode()
        out += [struct.pack("<H", len(raw)), raw, struct.pack("<Q", len(row)), np.minimum(np.array(row[::-1], np.uint64), top).astype(SIZES[bits]).tobytes()]
    return b"".join(out)


def decode(content: bytes, bits: int = 16) -> list[tuple[str, list[int]]]:
    at = 0
    if len(content) >= HEADER.size and content[:4] == struct.pack("<I", MAGIC):
        _, version, _, _, bits, _ = HEADER.unpack_from(content)
        if version != VERSION[0] or bits not in SIZES:
            raise ValueError(f"version {version} with entries of {bits} bits is not known")
        at = HEADER.size
    out = []
    while at < len(content):
        (n,) = struct.unpack_from("<H", content, at)
        name = content[at + 2 : at + 2 + n].decode()
        (count,) = struct.unpack_from("<Q", content, at + 2 + n)
        at += 10 + n
        values = np.frombuffer(content, SIZES[bits], count, at)[::-1]
        at += count * bits // 8
        out.append((name, values.astype(np.int64).tolist()))
    return out


def to_files(lengths: DataFrame, bits: int = 16, header: bool = True) -> DataFrame:
    """``part, content``: whole files of some reads of ``read_id, lens`` each; ``part`` numbers partitions and files in them."""

    def run(batches):
        for k, batch in enumerate(batches):
            content = encode([str(x) for x in batch.column(1).to_pylist()], batch.column(2).to_pylist(), bits, header)
            first = batch.column(0)[0].as_py() if batch.num_rows else 0
            yield pa.RecordBatch.from_arrays([pa.array([(first << 32) + k], pa.int64()), pa.array([content], pa.binary())], ["part", "content"])

    return lengths.select(F.spark_partition_id().alias("_part"), "read_id", "lens").mapInArrow(run, "part long, content binary")


def from_files(files: DataFrame, bits: int = 16) -> DataFrame:
    """``read_id, lens`` of files given as ``content``."""

    def run(batches):
        for batch in batches:
            rows = [r for content in batch.column(0).to_pylist() for r in decode(content, bits)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], ["read_id", "lens"])

    return files.select("content").mapInArrow(run, "read_id string, lens array<long>")


def read_bpf(spark: SparkSession, path: str, bits: int = 16) -> DataFrame:
    """``read_id, lens`` of profile files; a file is one task."""
    return from_files(spark.read.format("binaryFile").load(path), bits)


def view(profiles: DataFrame) -> DataFrame:
    """``value``: profiles as text, left to right."""
    return profiles.select(F.concat(F.lit(">"), F.col("read_id"), F.lit("\n"), F.array_join("lens", " ")).alias("value"))
