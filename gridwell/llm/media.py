"""Media columns: payloads in tar shards, addressed by content.

A task writes the payloads of its rows to one tar file in the shared folder.
Each different payload is stored once in a shard, under its digest; a row
carries the digest, the shard, and the offset and length of the payload in it.
Nothing is shuffled, so it doesn't matter how many rows have the same payload.
Metadata columns come from range reads of the first bytes of each payload;
features come from range reads of the whole.

Texts are stored as 8-bit greyscale PNG: their UTF-8 bytes, padded to a multiple
of 64, are the samples of an image 64 wide. PNG is lossless and compressed.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .shards import Folder

WIDTH = 64
LEVEL = 3
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature and the IHDR chunk.
HEADER = 33


def padded(text: str) -> tuple[int, bytes]:
    """The UTF-8 bytes' number, and the bytes with zeros up to a positive multiple of 64."""
    data = text.encode("utf-8", "surrogatepass")
    return len(data), data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """Samples as an 8-bit greyscale PNG; each line starts with filter type 0."""
    rows = len(payload) // WIDTH
    lines = np.zeros((rows, WIDTH + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH)
    header = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits of a sample, from the first HEADER bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != int.from_bytes(head[29:33], "big"):
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", head[16:25])


def from_png(data: bytes) -> np.ndarray:
    """The samples; checks every chunk."""
    width, height, _ = png_header(data[:HEADER])
    at, packed = 8, []
    while at < len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        body = data[at + 4 : at + 8 + size]
        if zlib.crc32(body) != int.from_bytes(data[at + 8 + size : at + 12 + size], "big"):
            raise ValueError("a PNG chunk is damaged")
        if body[:4] == b"IDAT":
            packed.append(body[4:])
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("only PNG lines without a filter are read")
    return lines[:, 1:]


class TarWriter:
    """Appends members to a tar stream and tells where their data begin."""

    def __init__(self, stream):
        self.stream, self.at, self.known = stream, 0, {}

    def put(self, digest: str, data: bytes) -> tuple[int, int]:
        if digest not in self.known:
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(data)
            head = info.tobuf(tarfile.USTAR_FORMAT)
            self.stream.write(head)
            self.stream.write(data)
            self.stream.write(bytes(-len(data) % 512))
            self.known[digest] = (self.at + len(head), len(data))
            self.at += len(head) + len(data) + -len(data) % 512
        return self.known[digest]

    def close(self) -> None:
        self.stream.write(bytes(1024))
        self.stream.close()


#: Most different payloads in a shard.
MOST_PAYLOADS = 200_000
#: What a row carries in place of its payload.
REFERENCE = "digest string, shard string, offset long, length long, n_bytes long"


def stored(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, digest, shard, offset, length, n_bytes) of each row; shards are written as it runs.

    Write the result before using it: running it again writes new shards. A null
    text is stored as an empty one, 64 zero bytes. Every row gets a reference,
    repeated rows and copies to the same bytes if they are in one shard. A very
    long text is one payload, whole. Only key and text are read, so other columns
    can't clash; an empty table gives no rows and no shards that hold payloads.
    """
    Folder(folder).make()
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        place = Folder(folder)
        name = place.new_name(TaskContext.get().partitionId(), ".tar")
        writer = None
        texts: dict[bytes, tuple] = {}  # digests only, one for each different text
        for batch in batches:
            out = []
            for t in batch.column(1):
                size, payload = padded(t.as_py() or "")
                same = hashlib.blake2b(payload, digest_size=20, salt=size.to_bytes(8, "little")).digest()
                if same not in texts:
                    if len(texts) >= MOST_PAYLOADS:  # a shard is full: what a task remembers is bounded
                        writer.close()
                        writer, name = None, place.new_name(TaskContext.get().partitionId(), ".tar")
                        texts.clear()
                    writer = writer or TarWriter(place.create(name))
                    png = to_png(payload)
                    digest = hashlib.sha256(png).hexdigest()
                    texts[same] = (digest, name, *writer.put(digest, png), size)
                out.append(texts[same])
            columns = zip(*out, strict=True) if out else [[]] * 5
            types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[key, "digest", "shard", "offset", "length", "n_bytes"])
        if writer:
            writer.close()

    return docs.select(key, F.col(text).cast("string").alias("text")).mapInArrow(run, f"`{key}` {kind}, {REFERENCE}")


class Reader:
    """Range reads from shards; keeps the last few open."""

    def __init__(self, folder: str, most: int = 4):
        self.folder, self.most, self.open = Folder(folder), most, OrderedDict()

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard not in self.open:
            if len(self.open) >= self.most:
                self.open.popitem(last=False)[1].close()
            self.open[shard] = self.folder.open(shard)
        return self.open[shard].read_at(length, offset)


def _over(rows: DataFrame, fields: str, kinds: list, of) -> DataFrame:
    """rows with fields that of(Reader, shard, offset, length) makes, once for each place in a batch."""
    names = [*rows.columns, *(f.split()[0] for f in fields.split(", "))]
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", " + fields

    def run(batches):
        make = of[1](of[0])
        for batch in batches:
            places = list(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("shard", "offset", "length")), strict=True))
            made = {p: make(*p) for p in sorted(set(places))}
            columns = zip(*(made[p] for p in places), strict=True) if places else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=names)

    return rows.mapInArrow(run, schema)


def with_metadata(rows: DataFrame, folder: str) -> DataFrame:
    """rows with width, height and bits, of which only the header bytes are read."""

    def make(folder):
        reader = Reader(folder)
        return lambda shard, offset, length: png_header(reader.read(shard, offset, HEADER))

    return _over(rows, "width int, height int, bits int", [pa.int32()] * 3, (folder, make))


def with_features(rows: DataFrame, folder: str) -> DataFrame:
    """rows with what the stored bytes say, read back and checked against their digest."""

    def make(folder):
        reader = Reader(folder)

        def of(shard, offset, length):
            data = reader.read(shard, offset, length)
            samples = from_png(data)
            flat = samples.reshape(-1)
            payload = flat.tobytes()
            mean, high = int(flat.sum(dtype=np.int64)) * 1000 // flat.size, np.bincount(flat >> 5, minlength=8)
            feature = f"{samples.shape[1]}x{samples.shape[0]}:{mean}:" + ",".join(map(str, high.tolist()))
            return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature

        return of

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    fields = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return _over(rows, fields, kinds, (folder, make))


def op2_media(spark, sf_dir: str) -> DataFrame:
    """Every document's text as a stored image, and what reading it back gives."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    with Scratch(spark) as scratch:
        folder = f"{scratch.root}/shards"
        index = scratch.table(stored(docs, folder), "index")
        rows = with_features(with_metadata(index, folder), folder)
        return scratch.keep(
            rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "bits")
        )
