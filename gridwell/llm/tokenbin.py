"""Token ids in binary files, coded by a static range asymmetric numeral system.

A file holds the ids of successive documents. Its frequency table, scaled to
``1 << BITS``, is shared by its blocks. A block is coded by itself, by LANES
interleaved coders whose states stand at its front (its checkpoint), so any
block can be decoded without the others. Blocks, tables and the list of
documents have checksums.

Layout: ``GWT1``, the length of a JSON head (8 bytes), the head, then the
sections that the head lists with offset, length and CRC-32: ``docs`` (an Arrow
stream: key and number of ids), ``table`` (zlib: ids present and their
frequencies, 32-bit), and for each block its number of ids and the CRC-32 of
the ids themselves.
"""

from __future__ import annotations

import gc
import json
import re
import zlib
from array import array
from contextlib import contextmanager
from functools import lru_cache
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_symbols
from .common import Scratch, tasks
from .shards import Folder

MAGIC = b"GWT1"
BITS = 18
LANES = 2048
#: Ids in a block.
BLOCK = 1 << 19
#: A file ends with the document in which it reaches so many ids.
FILE = 1 << 23
LOW = np.uint64(1 << 31)
END_ID = 2


def scaled(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Frequencies that sum up to 1 << bits, 1 at least for each count above 0.

    What rounding leaves over or owes goes to the largest ones."""
    total = 1 << bits
    if np.count_nonzero(counts) > total:
        raise ValueError("more different ids than the table has room for")
    out = np.where(counts > 0, np.maximum(1, counts * (total / max(1, counts.sum()))).astype(np.int64), 0)
    order = np.argsort(-out, kind="stable")
    k, owed = 0, total - int(out.sum())
    while owed and counts.any():
        i = order[k % len(order)]
        step = owed if owed > 0 else -min(-owed, max(0, int(out[i]) // 2))
        out[i] += step
        owed -= step
        k += 1
    return out


class Coder:
    """Codes and decodes blocks by one frequency table."""

    def __init__(self, ids: np.ndarray, frequencies: np.ndarray):
        self.ids = ids.astype(np.int64)
        self.f = frequencies.astype(np.uint64)
        self.c = np.cumsum(self.f) - self.f
        self.most = self.f << np.uint64(31 - BITS + 32)

    @classmethod
    def of(cls, ids: np.ndarray) -> Coder:
        counts = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.int64)
        for k in range(0, len(ids), BLOCK):
            counts += np.bincount(ids[k : k + BLOCK], minlength=len(counts))
        there = np.flatnonzero(counts)
        return cls(there, scaled(counts[there]))

    def encode(self, ids: np.ndarray) -> bytes:
        place = np.searchsorted(self.ids, ids) if not hasattr(self, "_at") else self._at[ids]
        f, c, most = self.f[place], self.c[place], self.most[place]
        states, words = np.full(LANES, LOW, np.uint64), []
        bits, half = np.uint64(BITS), np.uint64(32)
        for k in range((len(ids) - 1) // LANES * LANES, -1, -LANES):
            part = slice(k, k + LANES)
            x, fk = states[: len(f[part])], f[part]
            full = x >= most[part]
            words.append(x[full].astype(np.uint32))
            x = np.where(full, x >> half, x)
            q = x // fk
            states[: len(fk)] = (q << bits) + (x - q * fk) + c[part]
        return states.tobytes() + b"".join(w.tobytes() for w in reversed(words))

    def index(self) -> Coder:
        """Looks ids up by a direct table while many blocks are encoded."""
        self._at = np.zeros(int(self.ids[-1]) + 1 if len(self.ids) else 1, np.int64)
        self._at[self.ids] = np.arange(len(self.ids))
        return self

    def slots(self) -> Coder:
        self._slot = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.f.astype(np.int64))
        return self

    def decode(self, data: bytes, n: int) -> np.ndarray:
        states = np.frombuffer(data, np.uint64, LANES).copy()
        words = np.frombuffer(data, np.uint32, offset=LANES * 8).astype(np.uint64)
        out, at = np.empty(n, np.int64), 0
        bits, half, low = np.uint64(BITS), np.uint64(32), np.uint64((1 << BITS) - 1)
        for k in range(0, n, LANES):
            x = states[: min(LANES, n - k)]
            slot = x & low
            place = self._slot[slot]
            out[k : k + LANES] = place
            x = self.f[place] * (x >> bits) + slot - self.c[place]
            short = np.flatnonzero(x < LOW)
            x[short] = (x[short] << half) | words[at : at + len(short)]
            at += len(short)
            states[: len(x)] = x
        if at != len(words) or (states != LOW).any():
            raise ValueError("a block's codes don't end where they should")
        return self.ids[out]


def write_file(stream, docs: pa.RecordBatch, ids: np.ndarray) -> None:
    """docs: key and n_tokens of each document, in the order of ids."""
    sections, parts, at = [], [], 0

    def add(data: bytes, **more) -> None:
        nonlocal at
        sections.append({"at": at, "size": len(data), "crc": zlib.crc32(data), **more})
        parts.append(data)
        at += len(data)

    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, docs.schema) as out:
        out.write_batch(docs)
    add(zlib.compress(sink.getvalue().to_pybytes(), 1), kind="docs")
    coder = Coder.of(ids).index()
    table = np.concatenate([coder.ids, coder.f.astype(np.int64)]).astype("<u4")
    add(zlib.compress(table.tobytes(), 6), kind="table")
    for k in range(0, len(ids), BLOCK):
        block = ids[k : k + BLOCK]
        add(coder.encode(block), kind="block", n=len(block), ids_crc=zlib.crc32(block.astype("<u4").tobytes()))
    head = json.dumps({"bits": BITS, "lanes": LANES, "n": len(ids), "sections": sections}).encode()
    stream.write(MAGIC + len(head).to_bytes(8, "little") + head)
    for p in parts:
        stream.write(p)


class FileReader:
    def __init__(self, stream):
        self.stream = stream
        if stream.read_at(4, 0) != MAGIC:
            raise ValueError("not a token file")
        size = int.from_bytes(stream.read_at(8, 4), "little")
        self.head = json.loads(stream.read_at(size, 12))
        if (self.head["bits"], self.head["lanes"]) != (BITS, LANES):
            raise ValueError("a token file of other parameters")
        self.base = 12 + size
        self.blocks = [s for s in self.head["sections"] if s["kind"] == "block"]
        table = np.frombuffer(zlib.decompress(self._section(self._one("table"))), "<u4").astype(np.int64)
        self.coder = Coder(*np.split(table, 2)).slots()

    def _one(self, kind: str) -> dict:
        return next(s for s in self.head["sections"] if s["kind"] == kind)

    def _section(self, s: dict) -> bytes:
        data = self.stream.read_at(s["size"], self.base + s["at"])
        if zlib.crc32(data) != s["crc"]:
            raise ValueError(f"a token file's {s['kind']} is damaged")
        return data

    def docs(self) -> pa.Table:
        return pa.ipc.open_stream(zlib.decompress(self._section(self._one("docs")))).read_all()

    def block(self, k: int) -> np.ndarray:
        s = self.blocks[k]
        ids = self.coder.decode(self._section(s), s["n"])
        if zlib.crc32(ids.astype("<u4").tobytes()) != s["ids_crc"]:
            raise ValueError("a block's ids are not what they were")
        return ids

    def each(self):
        """(key, ids as packed little-endian 32-bit integers) of each document; a block at a time."""
        left, k = b"", 0
        for batch in self.docs().to_batches():
            for key, n in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                parts = []
                need = 4 * n
                while need > len(left):
                    parts.append(left)
                    need -= len(left)
                    left = self.block(k).astype("<u4").tobytes()
                    k += 1
                parts.append(left[:need])
                left = left[need:]
                yield key, b"".join(parts)


_ID = attrgetter("id")


class Memory(dict):
    """What a function gives, for the keys met lately: two generations."""

    def __init__(self, of, most: int, longest: int = 64):
        self.of, self.most, self.longest, self.old = of, most, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.of(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Later(Memory):
    """Parts behind a space. Most new ones are plain words, with a stop or without,
    and go to the model from here."""

    def __init__(self, of, most: int, tokenize, packed: list[bytes], stops: dict[str, bytes]):
        super().__init__(of, most)
        self.tokenize, self.packed, self.stops = tokenize, packed.__getitem__, stops

    def __missing__(self, part: str):
        value = self.old.get(part)
        if value is None:
            if not part.isascii():
                value = self.of(part)
            elif part.isalpha():
                value = b"".join(map(self.packed, map(_ID, self.tokenize("\u0120" + part))))  # the symbol of a space
            elif (word := part[:-1]).isalpha() and (stop := self.stops.get(part[-1])):
                value = self[word] + stop
            else:
                value = self.of(part)
        if len(part) <= self.longest:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[part] = value
        return value


class Odd(Exception):
    """A part that can't be encoded by itself."""


class Tokens:
    """Texts' ids by the tokenizers library, which sees each word of a text once.

    The byte-level pre-tokenizer never lets a token reach over the border before
    a space that something other than white space follows, so texts are cut
    there. A part of letters is a word, and so is what stands in front of a full
    stop or the like; any other part goes through the pre-tokenizer's pattern in
    terms that ``re`` knows. The library's model splits the words; parts and
    words are remembered. Parts of other than everyday characters go to the
    library whole: Python and the library go by other editions of Unicode.
    """

    #: In a part between spaces: what only the library can judge, in the light of the whole text.
    ODD = re.compile(r"\s|\Z|.*?(?:[\x1c-\x1f\x85]|<\|)", re.DOTALL)
    COMMON = re.compile("[\0-\x84\x86-\u024f\u0386-\u03ce\u0410-\u044f\u2010-\u2027\u20ac\u2122\u3001\u3002\u3041-\u3093\u4e00-\u9fa5]*")
    PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_\xb2\xb3\xb9\xbc-\xbe]+| ?[\d\xb2\xb3\xb9\xbc-\xbe]+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")
    STOPS = frozenset(".,;:!?")
    #: How many words and parts a generation holds.
    WORDS, PARTS = 60_000, 700_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.tokenize, self.symbol = self.library.model.tokenize, byte_symbols()
        self.packed = [k.to_bytes(4, "little") for k in range(max(self.library.get_vocab().values()) + 1)]
        self.words = Memory(self._word, self.WORDS)
        self.first = Memory(self._first, self.PARTS // 20)
        self.later = Later(self._later, self.PARTS, self.tokenize, self.packed, {c: self._word(c) for c in self.STOPS})

    def _ids(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        return b"".join(map(self.packed.__getitem__, map(_ID, self.tokenize("".join(map(self.symbol.__getitem__, word.encode()))))))

    def _first(self, part: str) -> bytes:
        if part and self.ODD.match(part):
            raise Odd
        if not self.COMMON.fullmatch(part):
            return self._ids(part)
        return b"".join(map(self.words.__getitem__, self.PIECES.findall(part)))

    def _later(self, part: str) -> bytes:
        if part.isalpha():
            if self.COMMON.fullmatch(part):
                return self._word(" " + part)
        elif part[-1:] in self.STOPS and part[:-1].isalpha() and self.COMMON.fullmatch(part):
            return self.later[part[:-1]] + self.words[part[-1]]
        if self.ODD.match(part):
            raise Odd
        if not self.COMMON.fullmatch(part):
            return self._ids(" " + part)
        later, words = self.later, self.words
        return b"".join([later[w[1:]] if w[0] == " " and w[1:].isalpha() else words[w] for w in self.PIECES.findall(" " + part)])

    def encode(self, text: str) -> bytes:
        """Packed little-endian 32-bit ids."""
        first, *later = text.split(" ")
        try:
            return b"".join([self.first[first], *map(self.later.__getitem__, later)])
        except Odd:
            return self._ids(text)


@lru_cache(2)
def tokens(path: str) -> Tokens:
    return Tokens(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@contextmanager
def paused():
    """Without garbage collection: the many small objects here don't refer to each other."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def written(docs: DataFrame, folder: str, path: str | None = None, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """(part, file, name, n) of the files written, with documents in ascending order of key.

    Files go by part and file. A null or empty text has no ids but the end id; null
    keys come first; documents with one key stand next to each other, and repeated
    rows are written each. A very long text goes whole into one file. Only key and
    text are read, so other columns can't clash; an empty table gives no files.
    Write the result before using it: running it again writes new files.
    """
    path = path or default_path()
    Folder(folder).make()
    rows = docs.select(key, F.col(text).cast("string").alias("text")).repartitionByRange(tasks(docs), key).sortWithinPartitions(key)

    def run(batches):
        place, encoder, end = Folder(folder), tokens(path), np.uint32(end_id).tobytes()
        part = TaskContext.get().partitionId()
        keys, sizes, ids, count = [], [], bytearray(), 0

        def flush():
            nonlocal keys, sizes, ids, count
            name = place.new_name(part, f"-{count:04d}.gwt")
            docs = pa.RecordBatch.from_arrays([pa.chunked_array(keys).combine_chunks(), pa.array(sizes, pa.int64())], names=["key", "n_tokens"])
            with place.create(name) as stream:
                write_file(stream, docs, np.frombuffer(ids, "<u4"))
            out = pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((part, pa.int32()), (count, pa.int32()), (name, pa.string()), (len(ids) // 4, pa.int64()))], names=["part", "file", "name", "n"])
            keys, sizes, ids, count = [], [], bytearray(), count + 1
            return out

        with paused():
            for batch in batches:
                begin = 0
                for i, text in enumerate(batch.column(1)):
                    before = len(ids)
                    ids += encoder.encode(text.as_py() or "")
                    ids += end
                    sizes.append((len(ids) - before) // 4)
                    if len(ids) >= 4 * FILE:
                        keys.append(batch.column(0).slice(begin, i + 1 - begin))
                        begin = i + 1
                        yield flush()
                keys.append(batch.column(0).slice(begin))
            if sizes:
                yield flush()

    return rows.mapInArrow(run, "part int, file int, name string, n long")


def read_back(files: DataFrame, folder: str, kind: str = "bigint") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files alone.

    Each file is read by itself; where it starts is a sum over the files before it.
    """
    by_part = files.groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = by_part.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = files.withColumn("within", within).join(parts, "part").select("name", (F.col("base") + F.col("within")).alias("start"))

    def run(batches):
        place = Folder(folder)
        for batch in batches:
            for name, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with place.open(name) as stream:
                    keys, out = [], []
                    for key, ids in FileReader(stream).each():
                        keys.append(key)
                        out.append((start, len(ids) // 4, zlib.crc32(ids)))
                        start += len(ids) // 4
                    columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(keys), *columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n).mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def op4_token_files(spark, sf_dir: str) -> DataFrame:
    """Every document's place and checksum in the token files, as read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    with Scratch(spark) as scratch:
        folder = f"{scratch.root}/tokens"
        files = scratch.table(written(docs, folder), "files")
        return scratch.keep(read_back(files, folder))
