"""Token-ID output: length-delimited binary records with masked checksums and a separate offset index.

A data file is a run of records in ascending doc_id order. A record is

    length of payload, u64 | masked CRC-32 of those 8 bytes, u32 | payload | masked CRC-32 of the payload, u32

all little-endian; the mask is the rotation and constant of the well-known record format (fixed values below),
over zlib's CRC-32. The payload is ``doc_id i64, has_id u8, width u8`` and the ids, ``width`` (2 or 4) bytes each.
The index beside it (``.idx``) has one 16-byte entry a record, ``offset u64, ids u64``, so that a reader can
visit records in any shuffled order without scanning.

Cases: a null text is an empty one (just the end id); a null doc_id sorts first and is read back as null; rows
that repeat a doc_id all get a record, in any order among themselves; an empty table gives no rows; other
columns are ignored, whatever their names. Files are written under a temporary name and renamed, so a task that
is run again after a lost executor replaces its own file; what failed and lost attempts leave under temporary names is
deleted by the attempt itself or, at the latest, once all files are written. Memory: one Arrow batch and one record at a time.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh_path, in_batches, write_table
from .tokens import encoder, with_end
from .words import chunks

#: Fixed values of the checksum mask.
_ROTATE, _DELTA = 15, 0xA282EAD8
_HEAD = struct.Struct("<QI")
_KEY = struct.Struct("<qBB")
_ENTRY = np.dtype([("offset", "<u8"), ("ids", "<u8")])

SUMMARY = "path string, docs long, ids long, bytes long"
RECORDS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> _ROTATE | crc << (32 - _ROTATE)) + _DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def read_record(stream) -> bytes | None:
    """The next payload, or None at the end; raises ValueError where a checksum fails or the file is cut short."""
    head = stream.read(_HEAD.size)
    if not head:
        return None
    if len(head) < _HEAD.size:
        raise ValueError("record header cut short")
    size, crc = _HEAD.unpack(head)
    if masked(head[:8]) != crc:
        raise ValueError("checksum of a record's length is wrong")
    body = stream.read(size + 4)
    if len(body) < size + 4 or masked(body[:size]) != struct.unpack("<I", body[size:])[0]:
        raise ValueError("checksum of a record is wrong")
    return body[:size]


def parse(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, has_id, width = _KEY.unpack_from(payload)
    return doc_id if has_id else None, np.frombuffer(payload, f"<u{width}", offset=_KEY.size)


def _write(batches, folder: str, tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    fs, root = pafs.FileSystem.from_uri(folder)
    task = TaskContext.get()
    name = f"{root}/ids-{task.partitionId():06d}"
    temp = f"{root}/.ids-{task.partitionId():06d}-{task.taskAttemptId()}"
    enc = encoder(tokenizer)
    docs = ids = at = 0
    out = index = None
    try:
        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            for i, _, data, offsets in chunks(batch.column("text")):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out, index = fs.open_output_stream(temp), fs.open_output_stream(f"{temp}.idx")
                got, bounds = with_end(*enc.encode(data, offsets), end_id)
                entries = np.zeros(len(bounds) - 1, _ENTRY)
                for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    key = keys[i + k]
                    record = frame(_KEY.pack(key or 0, key is not None, enc.width) + got[a:b].tobytes())
                    out.write(record)
                    entries[k] = at, b - a
                    at += len(record)
                index.write(entries.tobytes())
                docs += len(entries)
                ids += len(got)
    except BaseException:
        if out is not None:
            out.close()
            index.close()
            _delete(fs, temp, f"{temp}.idx")
        raise
    if out is not None:
        out.close()
        index.close()
        for suffix, made in ((".idx", f"{temp}.idx"), (".rec", temp)):
            _delete(fs, name + suffix)  # an earlier attempt's, of the same content
            fs.move(made, name + suffix)
        yield pa.RecordBatch.from_pydict({"path": [f"{folder}/ids-{task.partitionId():06d}"], "docs": [docs], "ids": [ids], "bytes": [at]})


def _delete(fs: pafs.FileSystem, *paths: str | None) -> None:
    for path in paths:
        if path and fs.get_file_info(path).type != pafs.FileType.NotFound:
            fs.delete_file(path)


def _drop_leftovers(folder: str) -> None:
    """Delete the files of attempts that were lost before they could rename or delete them."""
    fs, root = pafs.FileSystem.from_uri(folder)
    for found in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
        if found.base_name.startswith(".ids-"):
            fs.delete_file(found.path)


def _read(batches, shuffle_seed: int | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
            fs, name = pafs.FileSystem.from_uri(f"{path}.rec")
            with fs.open_input_stream(f"{name[:-4]}.idx") as stream:
                index = np.frombuffer(stream.read(), _ENTRY)
            starts = base + np.cumsum(index["ids"]).astype(np.int64) - index["ids"].astype(np.int64)
            with fs.open_input_stream(name, buffer_size=1 << 20) if shuffle_seed is None else fs.open_input_file(name) as stream:
                order = range(len(index)) if shuffle_seed is None else np.random.default_rng(shuffle_seed).permutation(len(index))
                rows: list[tuple] = []
                for k in order:
                    if shuffle_seed is not None:
                        stream.seek(int(index["offset"][k]))
                    doc_id, ids = parse(read_record(stream))
                    rows.append((doc_id, int(starts[k]), len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(rows) == 20_000:
                        yield _rows(rows)
                        rows = []
                if shuffle_seed is None and read_record(stream) is not None:
                    raise ValueError("the index misses a record")
                if rows:
                    yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def write_records(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, partitions: int | None = None) -> DataFrame:
    """Write ``docs`` (doc_id, text) as record files in ``folder``; one row a file (path, docs, ids, bytes), in file order.

    The rows are dealt by ranges of doc_id, and of a hash of the text within one doc_id, so that one repeated
    doc_id does not end in one file.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"))
    rows = rows.repartitionByRange(n, "doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row").select("doc_id", "text")
    files = write_table(in_batches(rows, keep_words=True).mapInArrow(lambda it: _write(it, folder, tokenizer, end_id), SUMMARY), "record-files")
    _drop_leftovers(folder)
    return files


def read_records(files: DataFrame, shuffle_seed: int | None = None) -> DataFrame:
    """Read the record files back, checking every checksum; ``shuffle_seed`` visits each file's records in shuffled order.

    Only the list of files, one short row each, passes through the driver, to sum the ids of the files before.
    """
    spark = files.sparkSession
    listed = sorted(files.select("path", "ids").collect())
    base, at = [], 0
    for path, ids in listed:
        base.append((path, at))
        at += ids
    if not base:
        return spark.createDataFrame([], RECORDS)
    tasks = spark.createDataFrame(base, "path string, base long").repartition(len(base), "path")
    return in_batches(tasks).mapInArrow(lambda it: _read(it, shuffle_seed), RECORDS)


def token_records(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write all documents' ids and read them back: doc_id, start, n_tokens, ids_crc32."""
    return read_records(write_records(docs, tokenizer, fresh_path(docs.sparkSession, "records"), end_id))
