"""Request bodies kept as files: bounded inflation of gzip, and text that is UTF-8.

A body is one file; ``.gz`` names gzip. Only the first member of a gzip file is read, whatever follows it. Inflation stops
at the limit, so a body that would grow beyond it costs a task the limit and no more; files too long to be read at
all are refused by their length, and their content is never opened. What can't be read gets a ``fault`` and no text: it
never fails the job. A file of no bytes is no delivery: Spark's readers pass over it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 64 << 20
#: What bodies are refused with.
CORRUPT = "The request body could not be inflated: Content-Encoding said gzip, but the body is not valid gzip."
INFLATES = "The gzipped request body inflates to more than {} MiB."
TOO_LARGE = "the request body is too large"
NOT_JSON = "The request body could not be parsed as JSON."

FILES = "path string, modificationTime timestamp, length long, content binary, repository_id long"
BODIES = "path string, received_at timestamp, repository_id long, value string, fault string"
#: Text that is sent on at once.
SEND_BYTES = 8 << 20


def inflates(max_bytes: int) -> str:
    return INFLATES.format(max_bytes >> 20)


def inflate(raw: bytes, max_bytes: int = MAX_BYTES) -> tuple[bytes | None, str | None]:
    """(the first member's bytes, None), or (None, why it is refused)."""
    reader = zlib.decompressobj(31)
    try:
        out = reader.decompress(raw, max_bytes + 1)
    except zlib.error:
        return None, CORRUPT
    if len(out) > max_bytes:
        return None, inflates(max_bytes)
    return (out, None) if reader.eof else (None, CORRUPT)


def body_text(path: str, raw: bytes | None, length: int, max_bytes: int = MAX_BYTES) -> tuple[str | None, str | None]:
    """(text, None) or (None, fault) of one file; no ``raw``: its length alone refuses it."""
    gzipped = path.endswith(".gz")
    if raw is None or (not gzipped and length > max_bytes):
        return None, inflates(max_bytes) if gzipped else TOO_LARGE
    out, fault = inflate(raw, max_bytes) if gzipped else (raw, None)
    if fault:
        return None, fault
    try:
        return out.decode("utf-8"), None
    except UnicodeDecodeError:
        return None, NOT_JSON


def _texts(batches, max_bytes: int) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in BODIES.split(", ")]
    for batch in batches:
        path, time, length, content, repository = (batch.column(c) for c in ("path", "modificationTime", "length", "content", "repository_id"))
        first, held, size = 0, [], 0
        for i in range(len(batch)):
            held.append(body_text(path[i].as_py(), content[i].as_py(), length[i].as_py(), max_bytes))
            size += len(held[-1][0] or "")
            if size > SEND_BYTES or i + 1 == len(batch):
                own = slice(first, i + 1)
                columns = [c[own] for c in (path, time, repository)] + [pa.array([h[k] for h in held], pa.string()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, names)
                first, held, size = i + 1, [], 0


def read_bodies(spark: SparkSession, folder: str, streaming: bool = False, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Files under ``repository_id=<n>/`` as path, received_at, repository_id, value and fault, one row a file."""
    reader = spark.readStream if streaming else spark.read
    rows = reader.format("binaryFile").schema(FILES).option("recursiveFileLookup", "false").load(folder)
    # gzip adds under a thousandth: a longer file inflates to more, or goes on after its first member
    most = max_bytes + max_bytes // 1000 + 4096
    short = rows.filter(F.col("length") <= most)
    long = rows.filter(F.col("length") > most).withColumn("content", F.lit(None).cast("binary"))
    return texts_of(short.unionByName(long), max_bytes)


def texts_of(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Files (the columns of FILES; no content: too long to be read) as bodies."""
    return files.select(*(c.split()[0] for c in FILES.split(", "))).mapInArrow(lambda it: _texts(it, max_bytes), BODIES)
