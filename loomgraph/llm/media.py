"""Media columns: content-addressed payloads in tar shards.

Each task writes the payloads of its partition, as PNG images of 8-bit grey
samples, into tar shards in the shared folder, each content once a task, under
the SHA-256 of the payload.  A row carries digest, shard, offset and length;
one place a digest (the first by shard and offset) is the address of a content
everywhere.  Header-only range reads (33 bytes at an offset) fill the metadata
columns; full range reads bring a payload back.  A failed attempt leaves a
shard that no row names.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesets
from .shared import keep, shared_path, table

#: Bytes of a row of samples; payloads are padded with spaces to a positive multiple of it.
WIDTH = 192
#: A shard is closed after so many bytes.
SHARD = 1 << 28
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature and the image header chunk: all that metadata needs.
HEADER = 33


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def padded(data: bytes, width: int = WIDTH) -> bytes:
    return data + b" " * (max(1, -(-len(data) // width)) * width - len(data))


def to_png(payload: bytes, width: int = WIDTH) -> bytes:
    lines = np.frombuffer(payload, np.uint8).reshape(-1, width)
    body = np.zeros((len(lines), width + 1), np.uint8)  # filter type 0 before each line
    body[:, 1:] = lines
    head = struct.pack(">IIBBBBB", width, len(lines), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(body.tobytes(), 2)) + _chunk(b"IEND", b"")


def png_header(data: bytes) -> tuple[int, int, int]:
    """Width, height and bits a sample from the first 33 bytes."""
    if data[:8] != _SIGNATURE or data[12:16] != b"IHDR":
        raise ValueError("no PNG header at this place")
    return struct.unpack(">IIB", data[16:25])


def from_png(data: bytes) -> bytes:
    width, height, _ = png_header(data)
    at, packed = 8, []
    while at < len(data):
        (size,) = struct.unpack(">I", data[at : at + 4])
        if data[at + 4 : at + 8] == b"IDAT":
            packed.append(data[at + 8 : at + 8 + size])
        at += size + 12
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("only unfiltered lines are written")
    return lines[:, 1:].tobytes()


def feature(payload: bytes, width: int = WIDTH) -> str:
    """A 64-bit average hash: which cells of an 8 x 8 grid are brighter than the mean, as hex."""
    grid = np.frombuffer(payload, np.uint8).reshape(-1, width)
    columns = grid.reshape(len(grid), 8, width // 8).sum(2, dtype=np.int64)
    edges = np.arange(9) * len(grid) // 8
    first = np.minimum(edges[:8], len(grid) - 1)
    size = np.maximum(edges[1:] - edges[:8], 1)
    cells = np.add.reduceat(columns, first, axis=0) / size[:, None] if len(grid) >= 8 else columns[first] / 1.0
    return np.packbits((cells > cells.mean()).ravel()).tobytes().hex()


class ShardWriter:
    def __init__(self, folder: str, stem: str):
        self.store, self.path = fs.FileSystem.from_uri(folder)
        self.stem, self.count, self.out, self.at = stem, 0, None, 0

    def add(self, name: str, body: bytes) -> tuple[str, int, int]:
        """Append one member; its shard, offset and length."""
        if self.out is None:
            self.store.create_dir(self.path, recursive=True)
            self.name = f"{self.stem}-{self.count:04d}.tar"
            self.out, self.at = self.store.open_output_stream(f"{self.path}/{self.name}"), 0
        info = tarfile.TarInfo(f"{name}.png")
        info.size = len(body)
        head = info.tobuf(tarfile.GNU_FORMAT)
        place = (self.name, self.at + len(head), len(body))
        whole = head + body + b"\0" * (-len(body) % 512)
        self.out.write(whole)
        self.at += len(whole)
        if self.at >= SHARD:
            self.close()
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * 1024)
            self.out.close()
            self.out, self.count = None, self.count + 1


def store(df: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all texts; one row a row: id, n_bytes, digest, shard, offset, length (a written table).

    Null counts as empty, and an empty text has a payload of 192 spaces.  Equal
    payloads share their digest; a content lies once in the shards of each task
    that met it.  A text of any length is one payload.  Repeated rows come back as often as they
    came; other columns do not matter; an empty table writes nothing.
    """
    picked = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches):
        task = TaskContext.get()
        out, places = ShardWriter(folder, f"shard-{task.partitionId():06d}-{task.taskAttemptId()}"), {}
        for batch in batches:
            data, offsets = bytesets.raw(batch.column(1))
            rows = []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                payload = padded(data[a:b].tobytes())
                digest = hashlib.sha256(payload).hexdigest()
                if digest not in places:
                    places[digest] = out.add(digest, to_png(payload))
                rows.append((b - a, digest, *places[digest]))
            size, digest, shard, offset, length = zip(*rows, strict=True) if rows else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(digest, pa.string()), pa.array(shard, pa.string()), pa.array(offset, pa.int64()), pa.array(length, pa.int64())], names=["id", "n_bytes", "digest", "shard", "offset", "length"])
        out.close()

    return keep(picked.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, n_bytes long, digest string, shard string, offset long, length long"), "media-index")


def addresses(index: DataFrame) -> DataFrame:
    """One place for each digest: the first by shard and offset."""
    return index.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*")


def _ranged(places: DataFrame, folder: str, read, schema: str) -> DataFrame:
    """Each place with ``read(file, offset, length)``, shard by shard, in the order of the offsets."""
    schema = f"shard string, offset long, length long, {schema}"
    fields = [c.split() for c in f"digest string, {schema}".split(", ")]
    names, kinds = [n for n, _ in fields], [pa.int64() if k == "long" else pa.string() for _, k in fields]

    def run(batches):
        where, path = fs.FileSystem.from_uri(folder)
        name, file = None, None
        for batch in batches:
            rows = []
            for digest, shard, offset, length in zip(*(batch.column(c).to_pylist() for c in ("digest", "shard", "offset", "length")), strict=True):
                if shard != name:
                    if file:
                        file.close()
                    name, file = shard, where.open_input_file(f"{path}/{shard}")
                rows.append((digest, shard, offset, length, *read(file, offset, length)))
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], kind) for kind in kinds], names=names)
        if file:
            file.close()

    ordered = places.repartition("shard").sortWithinPartitions("shard", "offset")
    return ordered.mapInArrow(run, f"digest string, {schema}")


def metadata(places: DataFrame, folder: str) -> DataFrame:
    """digest, width, height, bits: by reads of 33 bytes at each offset."""

    def read(file, offset, length):
        return png_header(file.read_at(HEADER, offset))

    return _ranged(places, folder, read, "width long, height long, bits long")


def features(places: DataFrame, folder: str) -> DataFrame:
    """digest, place, what the header shows (read by itself) and what the stored bytes show, read back whole; a wrong payload is an error."""

    def read(file, offset, length):
        head = png_header(file.read_at(HEADER, offset))
        stored = file.read_at(length, offset)
        payload = from_png(stored)
        return *head, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(payload)

    return _ranged(places, folder, read, "width long, height long, bits long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "media")
    index = store(table(spark, sf_dir, "documents"), folder)
    contents = keep(features(addresses(index), folder), "media-features")
    shown = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "digest", "shard", "offset", "length", "width", "height", "bits"]
    return index.select(F.col("id").alias("doc_id"), "n_bytes", "digest").join(contents, "digest").select(*shown)
