"""Media columns: content-addressed payloads in tar shards, metadata from header-only reads.

Tasks encode payloads losslessly (8-bit greyscale PNG, 64 samples a row), name each
by its SHA-256 and append it to the task's current tar shard in the shared folder,
once for each digest and task. Rows carry digest, shard, offset and length. A
catalogue keeps one place for each digest. Tasks then read the first bytes of every
object in the catalogue (signature, IHDR) to fill the metadata columns, and the whole
object where features are wanted.

Shards have names of their own for every attempt at a task, and the rows that name
them are written as a table: a lost or repeated attempt leaves a shard that no row
names. Payloads never pass through a shuffle.

Defined results: a null or empty text is a payload of 64 zero bytes; equal texts get
equal values; of several stored copies of a digest the least (shard, offset) is read; a very long text is one
object; repeated rows and ids stay apart; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import io
import math
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloq.llm.common import fresh_path, pieces, table, written

WIDTH = 64
SHARD_BYTES = 64 << 20
#: Stored bytes that one task decodes, about.
TASK_BYTES = 8 << 20
#: Signature, IHDR chunk with its checksum: what a header-only read fetches.
HEADER_BYTES = 33
PLACED = "doc_id long, n_bytes long, payload_bytes long, media_sha256 string, media_bytes long, shard string, offset long"


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % WIDTH if data else WIDTH)


def encode_png(payload: bytes, level: int = 6) -> bytes:
    """8-bit greyscale, 64 wide, one row for each 64 bytes of a payload."""
    rows = np.frombuffer(payload, "uint8").reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), "uint8")  # filter 0 before each row
    raw[:, 1:] = rows

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(raw.tobytes(), level)) + chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """(width, height, bit depth) from a stored object's first bytes."""
    if head[:8] != b"\x89PNG\r\n\x1a\n" or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    width, height, depth = struct.unpack(">IIB", head[16:25])
    return width, height, depth


def decode_png(data: bytes) -> bytes:
    width, height, _ = png_header(data)
    at, packed = 8, []
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":
            packed.append(data[at + 8 : at + 8 + size])
        at += size + 12
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), "uint8").reshape(height, width + 1)
    return rows[:, 1:].tobytes()


def features(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, and a 64-bit difference hash of 9 x 8 cells."""
    samples = np.frombuffer(payload, "uint8")
    share = np.bincount(samples, minlength=256) / len(samples)
    level = np.arange(256)
    mean = float(share @ level)
    deviation = math.sqrt(max(0.0, float(share @ (level * level)) - mean * mean))
    entropy = -float(sum(p * math.log2(p) for p in share[share > 0].tolist()))
    sums = np.r_[0, np.cumsum(samples, dtype="int64")]
    bounds = np.linspace(0, len(samples), 73).astype("int64")
    cells = (np.diff(sums[bounds]) / np.maximum(1, np.diff(bounds))).reshape(8, 9)
    bits = int("".join("01"[int(x)] for x in (cells[:, 1:] > cells[:, :-1]).ravel()), 2)
    return f"mean={mean:.4f};std={deviation:.4f};entropy={entropy:.4f};dhash={bits:016x}"


def _filesystem(uri: str):
    """File system and path of a shared folder: local paths and what Arrow can open (s3, gs, hdfs)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Shards:
    """Appends objects to tar shards under a folder; a new shard once one is large."""

    def __init__(self, folder: str):
        self.fs, self.folder = _filesystem(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.out, self.name, self.at = None, "", 0

    def add(self, name: str, data: bytes) -> tuple[str, int]:
        """(shard, offset of the data)."""
        if self.out is None:
            self.name, self.at = f"{uuid.uuid4().hex}.tar", 0
            self.out = self.fs.open_output_stream(f"{self.folder}/{self.name}")
        info = tarfile.TarInfo(name)
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.out.write(head + data + bytes(-len(data) % 512))
        place = self.name, self.at + len(head)
        self.at += len(head) + len(data) + -len(data) % 512
        if self.at >= SHARD_BYTES:
            self.close()
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()
            self.out = None


def store(docs: DataFrame, folder: str) -> DataFrame:
    """One row per document with its payload's digest and place; written, so computed once."""

    def run(batches):
        shards, places = Shards(folder), {}
        for batch in batches:
            out = []
            for doc_id, text in zip(batch[0].to_pylist(), batch[1].to_pylist()):
                data = (text or "").encode()
                payload = padded(data)
                key = hashlib.md5(payload).digest()
                if key not in places:
                    media = encode_png(payload)
                    digest = hashlib.sha256(media).hexdigest()
                    places[key] = (digest, len(media), *shards.add(f"{digest}.png", media))
                digest, size, shard, at = places[key]
                out.append((doc_id, len(data), len(payload), digest, size, shard, at))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            columns = zip(*out) if out else ([],) * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], PLACED.replace(" long", "").replace(" string", "").split(", "))
        shards.close()

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PLACED), "media-rows")


def catalogue(rows: DataFrame) -> DataFrame:
    """One place for each digest."""
    return rows.groupBy("media_sha256").agg(F.min(F.struct("shard", "offset", "media_bytes")).alias("p")).select("media_sha256", "p.*")


def _ranges(folder: str, batch, size=None):
    """Bytes of the objects in a batch, or the first ``size`` of each."""
    fs, base = _filesystem(folder)
    open_name, source = None, None
    for shard, offset, length in zip(batch["shard"].to_pylist(), batch["offset"].to_pylist(), batch["media_bytes"].to_pylist()):
        if shard != open_name:
            open_name, source = shard, fs.open_input_file(f"{base}/{shard}")
        yield source.read_at(min(size or length, length), offset)


def with_metadata(places: DataFrame, folder: str) -> DataFrame:
    """Adds width, height and bit_depth from header-only range reads."""

    def run(batches):
        for batch in batches:
            found = [png_header(x) for x in _ranges(folder, batch, HEADER_BYTES)]
            new = [pa.array([f[k] for f in found], pa.int32()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "width", "height", "bit_depth"])

    return places.mapInArrow(run, "media_sha256 string, shard string, offset long, media_bytes long, width int, height int, bit_depth int")


READ = "media_sha256 string, payload_sha256 string, tail_crc32 long, stored_sha256 string, feature string"


def read_back(places: DataFrame, folder: str) -> DataFrame:
    """Digests and features of every object, from its stored bytes."""

    def run(batches):
        for batch in batches:
            out = []
            wide = [f"{w}x{h}x{d}" for w, h, d in zip(*(batch[c].to_pylist() for c in ("width", "height", "bit_depth")))]
            for digest, shape, media in zip(batch["media_sha256"].to_pylist(), wide, _ranges(folder, batch)):
                payload = decode_png(media)
                out.append((digest, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), hashlib.sha256(media).hexdigest(), f"png:{shape};{features(payload)}"))
            columns = zip(*out) if out else ([],) * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()))], ["media_sha256", "payload_sha256", "tail_crc32", "stored_sha256", "feature"])

    return places.mapInArrow(run, READ)


def media_columns(docs: DataFrame, folder: str) -> DataFrame:
    """Stores every text and returns a row per document with places, metadata and features."""
    rows = store(docs, folder)
    places = with_metadata(ordered_places(rows), folder)
    return rows.drop("shard", "offset", "media_bytes").join(
        places.join(read_back(places, folder).drop("stored_sha256"), "media_sha256"), "media_sha256", "left"
    )


def ordered_places(rows: DataFrame) -> DataFrame:
    """One place for each digest; neighbours in a shard are one task's, in order, and a task has about ``TASK_BYTES`` of stored bytes."""
    n = rows.agg(F.coalesce(F.sum("media_bytes"), F.lit(0)).alias("n")).first()["n"]
    return catalogue(rows).repartitionByRange(pieces(int(n), TASK_BYTES), "shard", "offset").sortWithinPartitions("shard", "offset")


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "media")
    rows = store(table(spark, sf_dir, "documents"), folder)
    places = with_metadata(ordered_places(rows), folder)
    back = read_back(places, folder)
    return rows.join(back, "media_sha256", "left").select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes",
        F.col("stored_sha256").alias("media_sha256"), "feature", "shard", "offset",
    )
