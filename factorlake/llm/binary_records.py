"""Token ids in length-delimited binary records with a separate offset index."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorlake.llm.pieces import balanced, encoder, strings
from factorlake.llm.scratch import bounded_batches, kept

#: A frame is the payload's length (8 bytes), the masked checksum of those bytes
#: (4), the payload, and its masked checksum (4), all little-endian. The mask rotates a CRC-32
#: by 15 bits and adds the constant, so that checksums of data that hold checksums stay sound.
MASK = 0xA282EAD8
#: A payload is the width of an id in bytes (1 byte), then the ids, of 2 bytes where all fit, else 4.
FRAME_BYTES = 16


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def unframe(data: bytes) -> bytes:
    """The payload of one frame; ValueError where lengths or checksums don't hold."""
    if len(data) < FRAME_BYTES:
        raise ValueError("record is cut short")
    length, check = struct.unpack("<QI", data[:12])
    if check != masked(data[:8]) or length != len(data) - FRAME_BYTES:
        raise ValueError("record has a wrong length")
    payload = data[12:-4]
    if struct.unpack("<I", data[-4:])[0] != masked(payload):
        raise ValueError("record has a wrong checksum")
    return payload


def to_payload(ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    return bytes([width]) + ids.astype(f"<u{width}").tobytes()


def from_payload(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, dtype=f"<u{payload[0]}", offset=1)


def write_records(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, append `end_id`, and write records in ascending id order under `path`.

    Returns the offset index, itself a table in the shared folder: id, part (int), offset and
    length (long: the frame in the file), n_tokens (long) and start (long: ids of all records
    before it). Files are path/part-00000.rec and so on, in order. `path` is a URI that all
    machines reach. Null and empty texts give a record with the end id alone; null ids come
    first; rows of one id are in the order of a hash of their texts; an empty table writes nothing.

    Texts are dealt by ranges of the id and sorted there (the one shuffle); each task encodes as
    it writes, under a name of its own, and renames at its end, so that a task that runs twice
    leaves one whole file.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    # the hash parts the rows of one id, or of none, among tasks
    order = [F.col(id_col).asc_nulls_first(), F.xxhash64(F.lit(29), text_col)]
    ordered = docs.select(id_col, text_col).repartitionByRange(*order).sortWithinPartitions(*order, text_col)
    names = [id_col, "part", "offset", "length", "n_tokens", "before"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, "bytes")
        files, root = fs.FileSystem.from_uri(path)
        files.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        own, final = f"{root}/.{uuid.uuid4().hex}", f"{root}/part-{part:05d}.rec"
        end, offset, before, out = struct.pack("<I", end_id), 0, 0, None
        try:
            for b in batches:
                out = out or files.open_output_stream(own)
                lengths, counts = [], []
                for group in balanced(strings(b.column(1))):
                    for pieces in encode(group):
                        ids = np.frombuffer(b"".join([*pieces, end]), dtype="<u4")
                        record = frame(to_payload(ids))
                        out.write(record)
                        lengths.append(len(record))
                        counts.append(len(ids))
                starts = np.cumsum([offset, *lengths])
                firsts = np.cumsum([before, *counts])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([part] * b.num_rows, pa.int32()), pa.array(starts[:-1], pa.int64()), pa.array(lengths, pa.int64()), pa.array(counts, pa.int64()), pa.array(firsts[:-1], pa.int64())], names=names
                )
                offset, before = int(starts[-1]), int(firsts[-1])
        finally:
            if out:
                out.close()
        if out:
            files.move(own, final)

    index = kept(ordered.mapInArrow(run, f"`{id_col}` {kind}, part int, offset bigint, length bigint, n_tokens bigint, before bigint"), "index")
    # one row per file: the ids of all files before it
    sums = index.groupBy("part").agg(F.sum("n_tokens").alias("s"))
    firsts = sums.select(F.col("part").alias("p"), F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    return index.join(firsts, F.col("part") == F.col("p")).select(id_col, "part", "offset", "length", "n_tokens", (F.col("first") + F.col("before")).alias("start"))


def _read(part: np.ndarray, offset: np.ndarray, length: np.ndarray, path: str, span: int) -> Iterator[np.ndarray]:
    """The ids of records, neighbours in one read of about `span` bytes; lengths and checksums are verified."""
    files, root = fs.FileSystem.from_uri(path)
    s = 0
    while s < len(part):
        e = s + 1
        while e < len(part) and part[e] == part[s] and offset[e] == offset[e - 1] + length[e - 1] and offset[e] + length[e] - offset[s] <= span:
            e += 1
        with files.open_input_file(f"{root}/part-{part[s]:05d}.rec") as f:
            data = f.read_at(int(offset[e - 1] + length[e - 1] - offset[s]), int(offset[s]))
        for o, n in zip((offset[s:e] - offset[s]).tolist(), length[s:e].tolist(), strict=True):
            yield from_payload(unframe(data[o : o + n]))
        s = e


def read_records(index: DataFrame, path: str, span: int = 4 << 20) -> DataFrame:
    """The index's columns and ids (array of int) of its records, in any order the index has.

    A record whose length or checksum doesn't hold fails the task.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 500):
                c = b.slice(s, 500)
                ids = [x.astype(np.int32) for x in _read(*(c.column(k).to_numpy() for k in ("part", "offset", "length")), path, span)]
                yield pa.RecordBatch.from_arrays([*c.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*b.schema.names, "ids"])

    return index.mapInArrow(run, T.StructType([*index.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def record_digests(index: DataFrame, path: str, id_col: str = "doc_id", span: int = 4 << 20) -> DataFrame:
    """id, start, n_tokens and ids_crc32 (of the ids as little-endian unsigned 32-bit integers), from the files."""
    kind = index.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, crcs = [], []
            for ids, want in zip(_read(*(b.column(k).to_numpy() for k in ("part", "offset", "length")), path, span), b.column("n_tokens").to_pylist(), strict=True):
                if len(ids) != want:  # the index's starts are sums of these
                    raise ValueError("record has another number of ids than its index says")
                counts.append(len(ids))
                crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(id_col), b.column("start"), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())], names=[id_col, "start", "n_tokens", "ids_crc32"])

    by_file = index.repartition("part").sortWithinPartitions("part", "offset")
    return by_file.mapInArrow(run, f"`{id_col}` {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")
