"""Benchmark decontamination by winnowing.

A window is ``WINDOW`` consecutive words of a benchmark item, or the whole of a
shorter one. Hashes of short runs of words (k-grams) are winnowed: of each run
of so many neighbouring k-grams the least is kept as a fingerprint, so two texts
that share a window share a fingerprint from it, whatever stands around. The
fingerprints of documents meet those of items by equality; a hit is extended to
the windows that can lie over it, which count if the item holds them word by word.

Items are few beside documents. Their windows go to every task in blocks of
``BLOCK`` words at most, so that what a task holds has a bound; every document meets
each block. With one block documents aren't shuffled at all; with more, only those
with hits are, and their hits are united.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, binaries, lean, read, window_hashes
from .wordhash import word_hashes

WINDOW = 10
#: Words of benchmark items that go to every task at once: some 40 bytes each.
BLOCK = 1 << 21
#: Words of a document whose fingerprints are sought at once.
STRETCH = 1 << 16
#: What parts words: all of ASCII but digits and letters.
PARTS = np.zeros(256, bool)
PARTS[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def gram(size: int) -> int:
    """Words of a k-gram for windows of so many words: more than half of them."""
    return size // 2 + 1


def winnowed(grams: np.ndarray, run: int) -> np.ndarray:
    """Places of the least of each run of successive k-gram hashes (the last among
    equals), each once. run k-grams at least must be there."""
    if run == 1:
        return np.arange(len(grams))
    least = np.lib.stride_tricks.sliding_window_view(grams, run)[:, ::-1].argmin(1)
    return np.unique(np.arange(len(least)) + run - 1 - least)


@dataclass
class Windows:
    """Windows of one size: fingerprints, and each different window once with its items."""

    size: int
    fingerprints: np.ndarray  # sorted
    hashes: np.ndarray  # sorted, of windows
    at: np.ndarray  # where each window's first example begins in words
    begins: np.ndarray  # each window's items are items[begins[w] : begins[w + 1]]
    items: np.ndarray


@dataclass
class Block:
    """Windows of some items, and what they are made of."""

    words: np.ndarray  # hashes of the words of all items
    names: list[str]
    kinds: list[Windows]

    def found(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n, 2) ranges of a document's words that windows occur at, in order and
        apart; the numbers of the items that these are of."""
        edge, items = np.zeros(len(words) + 1, np.int64), []
        for kind in self.kinds:
            places, windows = self._occurrences(words, kind)
            edge += np.bincount(places, minlength=len(edge)) - np.bincount(places + kind.size, minlength=len(edge))
            items += [kind.items[kind.begins[w] : kind.begins[w + 1]] for w in np.unique(windows)]
        inside = np.diff(np.concatenate([[0], np.cumsum(edge)[:-1] > 0, [0]]).astype(np.int8))
        spans = np.stack([np.flatnonzero(inside == 1), np.flatnonzero(inside == -1)], 1)
        return spans, np.unique(np.concatenate(items)) if items else np.zeros(0, np.int64)

    def _occurrences(self, words: np.ndarray, kind: Windows) -> tuple[np.ndarray, np.ndarray]:
        """Where windows occur in a document, and which."""
        k, last = gram(kind.size), len(words) - kind.size
        hits = []
        for a in range(0, last + 1, STRETCH):  # stretches overlap, so that each window lies whole in one
            grams = window_hashes(words[a : min(a + STRETCH + kind.size - 1, len(words))], k)
            kept = winnowed(grams, kind.size - k + 1)
            to = np.searchsorted(kind.fingerprints, grams[kept])
            hits.append(a + kept[kind.fingerprints[np.minimum(to, len(kind.fingerprints) - 1)] == grams[kept]])
        hits = np.concatenate(hits) if hits else np.zeros(0, np.int64)
        if not len(hits):
            return hits, hits
        # a hit is extended to each window over it
        first = np.unique(np.clip(hits[:, None] - np.arange(kind.size - k + 1), 0, last))
        h = _windows(words, first, kind.size)
        w = np.minimum(np.searchsorted(kind.hashes, h), len(kind.hashes) - 1)
        same = kind.hashes[w] == h
        first, w = first[same], w[same]
        same = np.ones(len(first), bool)
        for j in range(kind.size):
            same &= words[first + j] == self.words[kind.at[w] + j]
        return first[same], w[same]


#: What has no window.
NOTHING = Block(np.zeros(0, np.uint64), [], [])


def _windows(words: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the windows that begin at some words."""
    runs = np.flatnonzero(np.diff(first, prepend=-2) != 1)
    out = [window_hashes(words[first[a] : first[b - 1] + size], size) for a, b in zip(runs, [*runs[1:], len(first)], strict=True)]
    return np.concatenate(out)


def block_of(texts: list[tuple[str, np.ndarray]], window: int = WINDOW) -> Block:
    """texts: names of items and the hashes of their words."""
    names = sorted({name for name, _ in texts})
    number = {name: k for k, name in enumerate(names)}
    texts = [(number[name], w) for name, w in texts]
    begin = np.cumsum([0, *(len(w) for _, w in texts)])
    words = np.concatenate([np.zeros(0, np.uint64), *(w for _, w in texts)])
    sizes: dict[int, list[int]] = {}
    for k, (_, w) in enumerate(texts):
        sizes.setdefault(min(window, len(w)), []).append(k)
    kinds = []
    for size, those in sorted(sizes.items()):
        k = gram(size)
        prints, hashes, at, of = [], [], [], []
        for t in those:
            item, w = texts[t]
            grams = window_hashes(w, k)
            prints.append(grams[winnowed(grams, size - k + 1)])
            hashes.append(window_hashes(w, size))
            at.append(begin[t] + np.arange(len(hashes[-1])))
            of.append(np.full(len(hashes[-1]), item))
        hashes, at, of = map(np.concatenate, (hashes, at, of))
        order = np.lexsort((of, hashes))
        hashes, at, of = hashes[order], at[order], of[order]
        again = np.append(False, (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1]))
        hashes, at, of = hashes[~again], at[~again], of[~again]
        new = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        kinds.append(Windows(size, np.unique(np.concatenate(prints)), hashes[new], at[new], np.append(new, len(hashes)), of))
    return Block(words, names, kinds)


def blocks(items: DataFrame, item: str, text: str, window: int) -> Iterator[Block]:
    """All items with words, in blocks of BLOCK words or one text more; a text of
    more words than that goes in pieces that overlap, so each window is in one."""
    rows = items.select(F.coalesce(F.col(item).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))).distinct()
    waiting, size = [], 0
    for name, raw in rows.toLocalIterator():
        words = word_hashes(np.frombuffer(raw.encode("utf-8", "surrogatepass"), np.uint8), PARTS)
        for k in range(0, len(words) if len(words) <= BLOCK else len(words) - window + 1, BLOCK):
            waiting.append((name, words[k : k + BLOCK + window - 1]))
            size += len(waiting[-1][1])
            if size >= BLOCK:
                yield block_of(waiting, window)
                waiting, size = [], 0
    if waiting:
        yield block_of(waiting, window)


def _hits(docs: DataFrame, text: str, carry: Column, block: Block) -> DataFrame:
    """(row, n_words, spans, items) of every document against one block."""
    shared = docs.sparkSession.sparkContext.broadcast(block)
    rows = docs.select(F.col(text).cast("string").alias("text"), carry.alias("row"))

    def run(batches):
        known = shared.value
        names = pa.array(known.names, pa.string())
        for batch in batches:
            counts, spans, items = [], [], []
            for raw in binaries(batch.column(0)):
                words = word_hashes(raw, PARTS)
                ranges, those = known.found(words)
                counts.append(len(words))
                spans.append([(int(a), int(b)) for a, b in ranges])
                items.append(names.take(pa.array(those, pa.int64())))
            kinds = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
            spans = pa.array([[{"begin": a, "end": b} for a, b in s] for s in spans], pa.list_(kinds))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, items)]), pa.int32()), pa.concat_arrays([names.slice(0, 0), *items]))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(counts, pa.int64()), spans, lists], names=["row", "n_words", "spans", "items"])

    return rows.mapInArrow(lean(run), f"row {rows.schema['row'].dataType.simpleString()}, n_words long, spans array<struct<begin:long,end:long>>, items array<string>")


def _united(hits: DataFrame) -> DataFrame:
    """(row, spans, items) of each row of hits' blocks; ranges that overlap or touch become one."""
    each = Window.partitionBy("row").orderBy("begin")
    before = F.max("end").over(each.rowsBetween(Window.unboundedPreceding, -1))
    spans = hits.select("row", F.explode("spans").alias("s")).select("row", "s.*").distinct()
    spans = spans.withColumn("new", F.coalesce(F.col("begin") > before, F.lit(True)).cast("long")).withColumn("run", F.sum("new").over(each))
    spans = spans.groupBy("row", "run").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("spans"))
    return spans.join(hits.select("row", F.explode("items").alias("item")).groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items")), "row")


def marked(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, carry: tuple[str, ...] = ("*",)) -> DataFrame:
    """Each document as (row, n_words, spans, items): its columns named by carry in
    ``row``, so none can clash; ranges (begin, end) of its words inside windows of
    items, apart and in order; the items' ids as strings, sorted.

    Null and empty texts have no words and no hits; documents are treated one by
    one, so repeated rows get the same marks. Rows of items with one id are one
    item (a null id is an item named ""); items without words occur nowhere, and
    without any item no document has a hit.
    """
    rest = blocks(items, item, item_text, window)
    first, second = next(rest, NOTHING), next(rest, None)
    if second is None:
        return _hits(docs, text, F.struct(*carry), first)
    # more than one block: hits belong to a text, which documents then find by its digest
    digest = F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256)
    with Scratch(docs.sparkSession) as scratch:
        parts = [scratch.keep(_hits(docs, text, digest, b).filter("size(items) > 0")) for b in chain([first, second], rest)]
        found = scratch.keep(_united(reduce(DataFrame.unionByName, parts)))
    plain = _hits(docs, text, F.struct(F.struct(*carry).alias("row"), digest.alias("d")), NOTHING).select("row.*", "n_words", F.col("spans").alias("none"), F.col("items").alias("no"))
    return plain.join(found.withColumnRenamed("row", "d"), "d", "left").select("row", "n_words", F.coalesce("spans", "none").alias("spans"), F.coalesce("items", "no").alias("items"))


def op13_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every document's hits."""
    rows = marked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), carry=("doc_id",))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return rows.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated")
    )


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, least(10, len(w)) AS size, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS words
  FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS u(k) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (SELECT r, k, size, array_to_string(w[k : k + size - 1], ' ') AS words FROM d, sizes, unnest(range(1, len(w) - size + 2)) AS u(k) WHERE len(w) >= size),
hits AS (SELECT DISTINCT r, k, p.size, item FROM places p JOIN windows USING (size, words)),
n AS (SELECT r, count(DISTINCT k + j) AS n_hit FROM (SELECT DISTINCT r, k, size FROM hits), unnest(range(size)) AS u(j) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN i USING (r)
"""
