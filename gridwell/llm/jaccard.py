"""Similar documents by a grouped prefix join on word shingles.

Every document is its set of 5-word shingles, as 64-bit hashes. In any fixed
order of shingles, two sets with a Jaccard similarity of t or more share one of
their first ``n - ceil(t n) + 1`` shingles. The order puts shingles that many
documents have last, so prefixes are made of rare ones.

Documents with the same prefix and size form a group, and only groups go
through the join: a posting for each shingle of a group's prefix is dealt out by
shingle, in packed runs, one for each of many buckets. In a list of up to
``SHORT`` groups each two within the bounds of size make a pair. In a longer one
the first (smallest) group stands for those near it in size, and the list itself
is kept for later. A shingle known to be very frequent is dealt to as many
buckets as its count needs; the groups that stand for its parts meet in turn.

Two sets that are similar enough share no fewer elements than that takes, so
pairs of groups that met too seldom are left out. The others are expanded to
members and members verified by their whole texts' sets in two steps. First each
group is held against the one before it that it met most often, and each member
against its group's first: a text travels once, and one with very many others is
dealt to several tasks. Verified links make components. What is left are pairs
and long lists with members in different components: of these each two members
within the bounds of size are held against a bound of their intersection (a bit
of one set's bitmap that the other's doesn't have is an element that they don't
share), in blocks of bounded size. Pairs that pass are verified, in ``NEAREST``
rounds only the likeliest of each set, between components as they then are, and
in the last round all: where no more pairs of a list pass than it has rows, one by
one; else the list's texts come together, again in blocks, and only those links come
out that join components, fewer than a block has rows. Copies and near copies, however many, so cost a few pairs
each, documents that only share a passage cost no verification, and no link
between components is lost.

No shingle, set or link goes to the driver; what does is bounded by a parameter:
the ``FREQUENT`` most frequent shingles, which shape the order and deal out long
lists, and a filter of ``FILTER_BITS`` bits at most, which only spares work.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROWS_AT_ONCE, Scratch, binaries, lean, per_text, scramble, tasks, window_hashes
from .components import components
from .wordhash import word_hashes

SHINGLE = 5
#: Least similarity, in percent.
PERCENT = 75
FREQUENT = 1 << 20
#: Shingles are counted over so many at a time; those found less often there don't count as frequent.
COUNT_AT_ONCE, SEEN = 1 << 20, 2
#: Bits of a set's bitmap: four for each element or more, a power of two within these bounds.
FEWEST_BITS, MOST_BITS = 64, 1 << 18
#: Postings held before they are dealt out, buckets for each shuffle partition, and postings of a frequent shingle in a bucket.
POSTINGS_AT_ONCE, BUCKETS, HOT = 1 << 18, 8, 1 << 14
#: Groups in a list whose pairs are all made.
SHORT = 24
#: Sets held against one in a task, and members of a list that are held against each other in one.
SPOKES, BLOCK = 1 << 12, 1 << 12
#: Elements of the sets of a block whose texts come together.
ELEMENTS = 1 << 22
#: Bits of a filter for each key, and most bits. Beyond these keys a join takes the filter's place.
BITS_A_KEY, FILTER_BITS = 8, 1 << 25
#: Rows of a small table that make a file.
ROWS_A_FILE = 500_000
#: Most keys, pairs or marks that a task remembers to leave out repeats.
REMEMBERED = 100_000
POSTING = np.dtype([("token", "<u8"), ("grp", "<i8"), ("n", "<i4")])
MEMBER = np.dtype([("grp", "<i8"), ("set_key", "<i8")])


def distinct(s: np.ndarray) -> np.ndarray:
    """Sorts s in place; its different elements."""
    s.sort()
    return s[np.append(True, s[1:] != s[:-1])] if len(s) else s


def shingles(raw: np.ndarray) -> np.ndarray:
    """The hashes of the different shingles of a text's UTF-8 bytes, ascending; of
    the whole sequence if it has fewer words."""
    words = word_hashes(raw)
    if not len(words):
        return words
    size = min(SHINGLE, len(words))
    return distinct(window_hashes(words, size) ^ np.uint64(size))


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - (-(-percent * n // 100)) + 1


def set_key(s: np.ndarray) -> int:
    """A signed 64-bit key of a set."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


class Order:
    """The order of shingles: those not known to be frequent first, then by how frequent, then by hash."""

    PLACES = 22

    def __init__(self, frequent: np.ndarray, levels: np.ndarray, hot: np.ndarray, shares: np.ndarray):
        """hot: those of frequent that are dealt to several buckets, and to how many each."""
        self.frequent, self.levels, self.hot, self.shares = frequent, levels, hot, shares
        self._may = np.zeros(1 << self.PLACES, bool)  # by upper bits: most shingles aren't frequent
        self._may[(frequent >> np.uint64(64 - self.PLACES)).astype(np.int64)] = True

    def __reduce__(self):
        return Order, (self.frequent, self.levels, self.hot, self.shares)

    @classmethod
    def of(cls, frequent: np.ndarray, seen: np.ndarray) -> Order:
        """frequent, ascending, and how often each was seen."""
        hot = seen > HOT
        return cls(frequent, (1 + np.log2(np.maximum(seen, 1))).astype(np.uint8), frequent[hot], -(-seen[hot] // HOT))

    def prefix(self, s: np.ndarray, size: int) -> np.ndarray:
        level = np.zeros(len(s), np.uint8)
        may = np.flatnonzero(self._may[(s >> np.uint64(64 - self.PLACES)).astype(np.int64)])
        if len(may):
            at = np.minimum(np.searchsorted(self.frequent, s[may]), len(self.frequent) - 1)
            level[may] = np.where(self.frequent[at] == s[may], self.levels[at], 0)
        return s[np.argsort(level, kind="stable")[:size]]  # s is ascending, so ties go by hash

    def shares_of(self, s: np.ndarray) -> np.ndarray:
        if not len(self.hot):
            return np.ones(len(s), np.int64)
        at = np.minimum(np.searchsorted(self.hot, s), len(self.hot) - 1)
        return np.where(self.hot[at] == s, self.shares[at], 1)


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two ascending arrays."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


def bitmap(s: np.ndarray) -> bytes:
    """A bit for each element, by its upper bits."""
    bits = min(MOST_BITS, max(FEWEST_BITS, 4 << max(0, len(s) - 1).bit_length()))
    at = (s >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)
    out = np.zeros(bits, np.uint8)
    out[at] = 1
    return np.packbits(out).tobytes()


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Rows of packed bits, brought down to so many bytes: the neighbours that
    agree in the upper bits of their place are put together."""
    while bits.shape[1] > words:
        plain = np.unpackbits(bits, axis=1)
        bits = np.packbits(plain[:, ::2] | plain[:, 1::2], axis=1)
    return bits


def most_shared(na, one: np.ndarray, nb, many: np.ndarray) -> np.ndarray:
    """How many elements sets of sizes na and nb may share, by rows of bitmaps of one length.

    Each bit that only one of two has is an element which the other lacks."""
    over_a = np.bitwise_count(one & ~many).sum(1, dtype=np.int64)
    over_b = np.bitwise_count(many & ~one).sum(1, dtype=np.int64)
    return np.minimum(na - over_a, nb - over_b)


def batch_of(names: list[str], kinds: list, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def of_text(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")


class Lately(set):
    """What a task has met; it forgets all of it when there is too much."""

    def new(self, key) -> bool:
        if key in self:
            return False
        if len(self) >= REMEMBERED:
            self.clear()
        self.add(key)
        return True


def keyed_sets(docs: DataFrame, text: str, key: str) -> DataFrame:
    """One pass over the texts: (key, n, set_key) of each row, and (shingle, seen)
    of shingles found often, in one table: n is null in the latter."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        seen, held, size = Lately(), [], 0
        names = [key, "n", "set_key", "shingle", "seen"]
        key_type = None

        def frequent():
            s = np.concatenate(held)
            s.sort()
            begins = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
            n = np.diff(np.append(begins, len(s)))
            often = n >= SEEN
            s, n = s[begins[often]], n[often]
            return pa.RecordBatch.from_arrays([pa.nulls(len(s), key_type), pa.nulls(len(s), pa.int64()), pa.nulls(len(s), pa.int64()), pa.array(s.view(np.int64)), pa.array(n, pa.int64())], names=names)

        for batch in batches:
            key_type = batch.column(0).type
            ns, keys = [], []
            for raw in binaries(batch.column(1)):
                s = shingles(raw)
                k = set_key(s) if len(s) else None
                ns.append(len(s))
                keys.append(k)
                if k is not None and seen.new(k):
                    held.append(s)
                    size += len(s)
                    if size >= COUNT_AT_ONCE:
                        yield frequent()
                        held, size = [], 0
            m = len(ns)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), pa.array(keys, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())], names=names)
        if held:
            yield frequent()

    return docs.select(key, of_text(text)).mapInArrow(lean(run), f"`{key}` {kind}, n long, set_key long, shingle long, seen long")


def order_of(seen: DataFrame, scratch: Scratch, most: int = FREQUENT) -> Order:
    """The order that the most frequent shingles of (shingle, seen) give.

    Counts fall into steps of a quarter of a power of two; a histogram of these
    tells from which step on there are no more than so many shingles, and only
    those come to the driver.
    """
    counts = scratch.table(seen.groupBy("shingle").agg(F.sum("seen").alias("seen")).withColumn("step", F.floor(4 * F.log2("seen")).cast("int")), "counts")
    total, least = 0, None
    for r in sorted(counts.groupBy("step").count().collect(), reverse=True):  # some 250 steps at most
        total += r["count"]
        if total > most:
            break
        least = r["step"]
    top = counts.filter(F.lit(False) if least is None else F.col("step") >= least).select("shingle", "seen").toArrow()
    scratch.drop("counts")
    s = np.array(top.column("shingle").combine_chunks(), np.int64).view(np.uint64)
    n = np.array(top.column("seen").combine_chunks(), np.int64)
    by = np.argsort(s)
    return Order.of(s[by], n[by])


def postings(docs: DataFrame, order, text: str, buckets: int) -> DataFrame:
    """(bucket, rows, own): packed postings (token, grp, n) of each bucket, and
    packed members (grp, set_key). A task leaves out groups and sets that it has met."""

    def run(batches):
        known, groups, sets, size = order.value, Lately(), Lately(), 0
        held: list[np.ndarray] = []
        owned: list[tuple[int, int]] = []

        def dealt():
            rows = np.concatenate(held) if held else np.zeros(0, POSTING)
            own = np.array(owned, MEMBER)
            # a frequent shingle is dealt to several buckets, by groups
            salt = scramble(rows["grp"].view(np.uint64)) % known.shares_of(rows["token"]).astype(np.uint64)
            parts = []
            for of, x in ((bucket_of(rows["token"] + salt * np.uint64(0x9E3779B97F4A7C15), buckets), rows), (bucket_of(own["grp"].view(np.uint64), buckets), own)):
                by = np.argsort(of, kind="stable")
                x, of = x[by], of[by]
                at = np.searchsorted(of, np.arange(buckets + 1))
                parts.append((x, at))
            (rows, at), (own, to) = parts
            there = np.flatnonzero((at[1:] > at[:-1]) | (to[1:] > to[:-1]))
            return batch_of(["bucket", "rows", "own"], [pa.int32(), pa.binary(), pa.binary()], there, [rows[at[k] : at[k + 1]].tobytes() for k in there], [own[to[k] : to[k + 1]].tobytes() for k in there])

        for batch in batches:
            for raw in binaries(batch.column(0)):
                s = shingles(raw)
                if not len(s) or not sets.new(k := set_key(s)):
                    continue
                p = known.prefix(s, prefix_size(len(s)))
                g = set_key(np.append(p, np.uint64(len(s))))
                owned.append((g, k))
                if groups.new(g):
                    rows = np.empty(len(p), POSTING)
                    rows["token"], rows["grp"], rows["n"] = p, g, len(s)
                    held.append(rows)
                    size += len(p)
                if size >= POSTINGS_AT_ONCE or len(owned) >= POSTINGS_AT_ONCE:
                    yield dealt()
                    held, owned, size = [], [], 0
        if owned:
            yield dealt()

    return docs.select(of_text(text)).mapInArrow(lean(run), "bucket int, rows binary, own binary")


def bucket_of(tokens: np.ndarray, buckets: int) -> np.ndarray:
    return ((scramble(tokens) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


#: What a row of ``met`` says: a group's member (grp, set_key); a pair of groups,
#: how often they met in short lists or as one that stands for others, and their
#: sizes; a group in a long list (list, grp) and how many shingles' lists are the
#: same; one that stands for others in a part of a list, and its size (shingle, grp, n).
MEMBERS, PAIR, STAR, LISTED, FRONT = range(5)
WIDE = 32


def meetings(rows: np.ndarray, own: np.ndarray, order: Order):
    """(kind, a, b, n, sizes) of one bucket."""
    zeros = lambda x: np.zeros(len(x), np.int64)
    own = np.unique(own)
    yield MEMBERS, own["grp"], own["set_key"], zeros(own), zeros(own)
    if not len(rows):
        return
    # most shingles have one group: they go before anything else
    rows = rows[np.argsort(rows["token"], kind="stable")]
    token = rows["token"]
    same = token[1:] == token[:-1]
    rows = rows[np.append(same, False) | np.append(False, same) | (order.shares_of(token) > 1)]
    rows = rows[np.lexsort((rows["grp"], rows["n"], rows["token"]))]
    if not len(rows):
        return
    rows = rows[np.append(True, (rows["token"][1:] != rows["token"][:-1]) | (rows["grp"][1:] != rows["grp"][:-1]))]  # tasks may share a group
    token, grp, n = (np.ascontiguousarray(rows[c]) for c in ("token", "grp", "n"))
    n = n.astype(np.int64)
    begins = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    sizes = np.diff(np.append(begins, len(token)))
    hot = order.shares_of(token[begins]) > 1
    long = (sizes > SHORT) | hot
    short = np.repeat(np.where(long, 0, sizes), sizes)
    met_at = {PAIR: [], STAR: []}
    for d in range(1, min(SHORT, len(token))):
        at = np.flatnonzero((short[:-d] > d) & (token[:-d] == token[d:]) & (100 * n[:-d] >= PERCENT * n[d:]))
        met_at[PAIR].append((at, at + d))
    fronts, lists = [], {}
    for i, size, is_hot in zip(begins[long].tolist(), sizes[long].tolist(), hot[long].tolist(), strict=True):
        j = i + size
        # lists of the same groups are one
        name = int(token[i]) if is_hot else int(scramble(grp[i:j].view(np.uint64)).sum(dtype=np.uint64))
        lists.setdefault(name, [i, j, 0])[2] += 1
        while i < j:
            k = i + int(np.searchsorted(n[i:j], n[i] * 100 // PERCENT, side="right"))
            met_at[STAR].append((np.full(k - i - 1, i), np.arange(i + 1, k)))
            if is_hot:
                fronts.append((token[i].astype(np.int64), grp[i], n[i], n[i]))
            i = k
    for name, (i, j, count) in lists.items():
        yield LISTED, np.full(j - i, name, np.uint64).view(np.int64), grp[i:j], np.full(j - i, count), n[i:j]
    for kind, found in met_at.items():
        if not found:
            continue
        x, y = (np.concatenate(c) for c in zip(*found, strict=True))
        x, y = np.where(grp[x] < grp[y], x, y), np.where(grp[x] < grp[y], y, x)
        a, b = grp[x], grp[y]
        by = np.lexsort((b, a))
        a, b, both = a[by], b[by], (n[x] << WIDE | n[y])[by]
        new = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, np.int64)
        yield kind, a[new], b[new], np.diff(np.append(new, len(a))), both[new]
    if fronts:
        yield FRONT, *(np.array(x, np.int64) for x in zip(*fronts, strict=True))


def met(dealt: DataFrame, order) -> DataFrame:
    """(kind, a, b, n, sizes), from packed postings sorted by bucket, a bucket at a time."""

    def run(batches):
        known, at, rows, own = order.value, None, [], []

        def bucket():
            for kind, *columns in meetings(np.concatenate(rows), np.concatenate(own), known):
                if len(columns[0]):
                    yield batch_of(["kind", "a", "b", "n", "sizes"], [pa.int32()] + [pa.int64()] * 4, np.full(len(columns[0]), kind), *columns)

        for batch in batches:
            for b, x, y in zip(batch.column(0).to_pylist(), binaries(batch.column(1)), binaries(batch.column(2)), strict=True):
                if b != at and rows:
                    yield from bucket()
                    rows, own = [], []
                at = b
                rows.append(np.frombuffer(x.tobytes(), POSTING))
                own.append(np.frombuffer(y.tobytes(), MEMBER))
        if rows:
            yield from bucket()

    return dealt.sortWithinPartitions("bucket").mapInArrow(lean(run), "kind int, a long, b long, n long, sizes long")


class Filter:
    """A bounded set of bits, two for each key, that says whether a key may be one of many."""

    def __init__(self, keys: DataFrame, bits: int):
        key = F.col(keys.columns[0])
        self.size = bits
        places = F.explode(F.array(F.pmod(key, F.lit(bits)), F.pmod(F.shiftright(key, 27), F.lit(bits))))
        words = keys.select(places.alias("at")).groupBy(F.floor(F.col("at") / 32).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 32 as int))")).alias("bits")).toArrow()
        self.bits = np.zeros(bits // 32, np.uint32)
        self.bits[np.asarray(words.column("word"))] = np.asarray(words.column("bits")).astype(np.uint32)

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        held = np.ones(len(keys), bool)
        for at in (keys % self.size, (keys >> 27) % self.size):
            held &= (self.bits[at >> 5] >> (at & 31).astype(np.uint32) & np.uint32(1)).astype(bool)
        return held


def wanted(rows: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, object]:
    """rows whose key, a long, is one of keys, or all rows and a filter that says
    which may be: the filter is as large as their number needs; beyond
    FILTER_BITS a join takes its place."""
    count = keys.count()
    if count * BITS_A_KEY >= FILTER_BITS:
        return rows.join(keys.toDF(key).distinct(), key, "left_semi").select(rows.columns), None
    return rows, rows.sparkSession.sparkContext.broadcast(Filter(keys, 1 << max(15, (count * BITS_A_KEY).bit_length())))


def kept_by(batches, known):
    """The rows of batches whose first column may be among the keys of a filter."""
    for batch in batches:
        yield batch.filter(pa.array(known.value.may_hold(np.asarray(batch.column(0))))) if known else batch


def members(docs: DataFrame, keys: DataFrame, text: str, key: str) -> DataFrame:
    """(set_key, n, bits, text) of the documents whose hashed key may be one of keys.

    Texts go on from here instead of sets: hashed again where they are needed,
    they take up half the room of 64-bit hashes."""
    rows, known = wanted(docs.select(F.xxhash64(key).alias("at"), of_text(text)), "at", keys)

    def run(batches):
        for batch in kept_by(batches, known):
            for k in range(0, batch.num_rows, ROWS_AT_ONCE):
                texts = batch.column(1).slice(k, ROWS_AT_ONCE)
                found = [(i, s) for i, raw in enumerate(binaries(texts)) if len(s := shingles(raw))]
                if found:
                    made = [(set_key(s), len(s), bitmap(s)) for _, s in found]
                    columns = [pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)]
                    yield pa.RecordBatch.from_arrays([*columns, texts.take(pa.array([i for i, _ in found]))], names=["set_key", "n", "bits", "text"])

    return rows.mapInArrow(lean(run), "set_key long, n long, bits binary, text string")


def starred(pairs: DataFrame, sets: DataFrame, scratch: Scratch, parts: int) -> DataFrame:
    """pairs (a, b) of set keys, each b in one pair, with the sizes na, nb and that of their intersection.

    Sets go to the task of their a, where the set of a comes first; an a with
    many others is dealt to several tasks.
    """
    centres = pairs.groupBy("a").agg(F.ceil(F.count("*") / SPOKES).cast("int").alias("shares"))
    spokes = pairs.join(centres, "a").select(F.col("b").alias("set_key"), "a", F.pmod(F.xxhash64("b"), F.col("shares")).cast("int").alias("share"), F.lit(1).alias("role"))
    centres = centres.select(F.col("a").alias("set_key"), "a", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("role"))
    rows = spokes.unionByName(centres).join(sets.select("set_key", "text"), "set_key")

    def run(batches):
        own = last = None
        for batch in batches:
            a, b, sizes = [], [], []
            for to, key, role, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), binaries(batch.column(3)), strict=True):
                if (to, role, key) == last:
                    continue  # a repeated row of the same set
                s, last = shingles(s), (to, role, key)
                if role == 0:
                    own = s
                else:
                    a.append(to)
                    b.append(key)
                    sizes.append((len(own), len(s), shared(own, s)))
            if a:
                yield batch_of(["a", "b", "na", "nb", "both"], [pa.int64()] * 5, a, b, *zip(*sizes, strict=True))

    dealt = rows.repartition(parts, "a", "share").sortWithinPartitions("a", "share", "role", "set_key").select("a", "set_key", "role", "text")
    return scratch.table(dealt.mapInArrow(lean(run), "a long, b long, na long, nb long, both long"), "starred", rows=1000)


def verified(pairs: DataFrame, sets: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """pairs (a, b) of set keys with the sizes na, nb and that of their intersection."""
    pairs = scratch.keep(pairs)
    sets, known = wanted(sets.select("set_key", "text"), "set_key", pairs.select("a").union(pairs.select("b")).distinct())
    sets = sets.mapInArrow(lean(lambda batches: kept_by(batches, known)), sets.schema) if known else sets
    sets = sets.groupBy("set_key").agg(F.first("text").alias("text"))
    left = sets.select(F.col("set_key").alias("a"), F.col("text").alias("sa"))
    right = sets.select(F.col("set_key").alias("b"), F.col("text").alias("sb"))

    def run(batches):
        for batch in batches:
            rows = []
            for x, y in zip(binaries(batch.column(2)), binaries(batch.column(3)), strict=True):
                x, y = shingles(x), shingles(y)
                rows.append((len(x), len(y), shared(x, y)))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))], names=["a", "b", "na", "nb", "both"])

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")
    return scratch.table(joined.mapInArrow(lean(run), "a long, b long, na long, nb long, both long"), name, rows=500)


SIMILAR = f"100 * both >= {PERCENT} * (na + nb - both)"


def runs(batches, columns: list[str]):
    """Of rows sorted by their first two columns: arrays of the rows of successive
    values, and where each value begins. A value is never cut in two."""
    held: list[np.ndarray] = []

    def array(column):
        if pa.types.is_binary(column.type):
            out = np.empty(len(column), object)
            out[:] = column.to_pylist()
            return out
        return np.asarray(column)

    for batch in batches:
        now = [array(batch.column(i)) for i in range(len(columns))]
        if not len(now[0]):
            continue
        held = [np.concatenate(x) for x in zip(held, now, strict=True)] if held else now
        other = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
        if len(other):
            cut = int(other[-1]) + 1
            yield [x[:cut] for x in held]
            held = [x[cut:] for x in held]
    if held:
        yield held


def in_cells(rows: DataFrame, n_blocks: Column, more: list[str], parts: int) -> DataFrame:
    """rows of lists, (list, component, n, set_key, more), dealt by (list, cell) and sorted by n.
    A list is cut to so many blocks, and each two of them meet in a cell of their own;
    side tells them apart, 2 where a block meets itself."""
    rows = rows.withColumn("n_blocks", n_blocks.cast("int")).withColumn("block", F.pmod(F.xxhash64("set_key"), F.col("n_blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other")
    rows = rows.select("list", "component", "n", "set_key", *more, "block", "n_blocks", other)
    cell = F.least("block", "other").cast("long") * F.col("n_blocks") + F.greatest("block", "other")
    side = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1)
    rows = rows.select("list", cell.alias("cell"), side.cast("int").alias("side"), "n", "component", "set_key", *more).repartition(parts, "list", "cell")
    return rows.sortWithinPartitions("list", "cell", "n", "set_key")


def cells_of(token: np.ndarray, cell: np.ndarray):
    """(begin, end) of the cells in rows sorted by them."""
    begins = np.flatnonzero(np.append(True, (token[1:] != token[:-1]) | (cell[1:] != cell[:-1])))
    return zip(begins.tolist(), np.append(begins[1:], len(token)).tolist(), strict=True)


def survivors(size, own, side, bits):
    """(x, y, score) of a list's rows, each pair once: y is wider than x, or further on among the like."""
    width = np.array([len(x) for x in bits])
    for w in sorted(set(width.tolist())):
        at = np.flatnonzero(width >= w)
        like = np.flatnonzero(width[at] == w)
        table = np.zeros((len(at), w), np.uint8)
        for v in sorted(set(width[at].tolist())):
            of = np.flatnonzero(width[at] == v)
            table[of] = folded(np.frombuffer(b"".join(bits[at[of]]), np.uint8).reshape(len(of), v), w)
        table = table.view(np.uint64)
        step = max(1, (1 << 18) // max(1, len(at)))
        for k in range(0, len(like), step):
            x = like[k : k + step]
            a, b = size[at[x]][:, None], size[at][None]
            may = (own[at[x]][:, None] != own[at][None]) & ((width[at] > w)[None] | (at[None] > at[x][:, None])) & (100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b))
            may &= (side[at[x]] == 2)[:, None] | (side[at[x]][:, None] != side[at][None])
            p, q = np.nonzero(may)
            more = max(1, (1 << 20) // w)
            for m in range(0, len(p), more):
                i, j = at[x[p[m : m + more]]], at[q[m : m + more]]
                both = most_shared(size[i], table[x[p[m : m + more]]], size[j], table[q[m : m + more]])
                union = size[i] + size[j] - both
                ok = 100 * both >= PERCENT * union
                yield i[ok], j[ok], both[ok] * 10_000 // union[ok]


def between(rows: DataFrame, every: bool, parts: int) -> DataFrame:
    """Pairs (a, b, score) that are left, of (list, component, n, set_key, bits, total):
    each two rows of a list in different components, within the bounds of
    size, whose bitmaps don't rule out a link.

    A list of more than BLOCK rows is cut to blocks. With every, all of the pairs, but of a
    cell where these are more than its rows only its list, as (list, null, -1); else for each
    row a of a cell the one b that it may share the most with, by score.
    """

    def run(batches):
        pairs, lists = Lately(), Lately()
        for token, cell, side, n, c, key, bits in runs(batches, ["list", "cell", "side", "n", "component", "set_key", "bits"]):
            total = np.append(np.uint64(0), np.cumsum(scramble(key.view(np.uint64)), dtype=np.uint64))
            for i, j in cells_of(token, cell):
                if j - i < 2 or (c[i:j] == c[i]).all():
                    continue
                whole = bool((side[i:j] == 2).all())
                if whole and not lists.new(((int(total[j]) - int(total[i])) % (1 << 64), j - i)):
                    continue  # the same rows met in another list
                best, found, count = np.zeros(j - i, np.int64), [], 0
                for x, y, score in survivors(n[i:j], c[i:j], side[i:j], bits[i:j]):
                    if every:
                        found.append((x, y))
                        if (count := count + len(x)) > j - i:
                            break
                        continue
                    np.maximum.at(best, x, score << 32 | y + 1)
                    np.maximum.at(best, y, score << 32 | x + 1)
                if count > j - i:
                    yield batch_of(["a", "b", "score"], [pa.int64()] * 3, [token[i]], [None], [-1])
                    continue
                for x, y in found:
                    a, b = key[i + x], key[i + y]
                    new = [p for p in zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True) if pairs.new(p)]
                    if new:
                        yield batch_of(["a", "b", "score"], [pa.int64()] * 3, *zip(*new, strict=True), np.zeros(len(new), np.int64))
                if at := np.flatnonzero(best).tolist():
                    yield batch_of(["a", "b", "score"], [pa.int64()] * 3, key[i:j][at], key[i - 1 + (best[at] & 0xFFFFFFFF)], best[at] >> 32)

    return in_cells(rows, F.ceil(F.col("total") / BLOCK), ["bits"], parts).mapInArrow(lean(run), "a long, b long, score long")


def joining(rows: DataFrame, parts: int) -> DataFrame:
    """(a, b): links between different components of (list, component, n, set_key, text), as
    many in each cell as join all that its links reach, so fewer than it has rows.

    A block has BLOCK rows and ELEMENTS elements at most. How many rows a list has, and
    how many elements their sets, may be known, as total and elements."""
    if "elements" not in rows.columns:
        rows = rows.join(rows.groupBy("list").agg(F.count("*").alias("total"), F.sum("n").alias("elements")), "list")

    def run(batches):
        for token, cell, side, n, c, key, texts in runs(batches, ["list", "cell", "side", "n", "component", "set_key", "text"]):
            for i, j in cells_of(token, cell):
                if j - i < 2 or (c[i:j] == c[i]).all():
                    continue
                sets, own, out = [shingles(np.frombuffer(t, np.uint8)) for t in texts[i:j]], c[i:j].copy(), []
                bits = np.empty(j - i, object)
                bits[:] = [bitmap(s) for s in sets]
                names = np.unique(np.concatenate(sets))
                sets = [np.searchsorted(names, s) for s in sets]
                there = np.zeros(len(names), bool)
                for xs, ys, _ in survivors(n[i:j], c[i:j], side[i:j], bits):
                    apart = own[xs] != own[ys]
                    xs, ys = xs[apart], ys[apart]
                    for begin, end in cells_of(xs, xs) if len(xs) else ():
                        x, y = int(xs[begin]), ys[begin:end]
                        y = y[own[y] != own[x]]
                        if not len(y):
                            continue
                        there[sets[x]] = True
                        sizes = n[i + y]
                        both = np.add.reduceat(there[np.concatenate([sets[k] for k in y.tolist()])], np.cumsum(sizes) - sizes, dtype=np.int64)
                        there[sets[x]] = False
                        for k in y[100 * both >= PERCENT * (n[i + x] + sizes - both)].tolist():
                            if own[k] != own[x]:
                                own[own == own[k]] = own[x]
                                out.append((int(key[i + x]), int(key[i + k])))
                if out:
                    yield batch_of(["a", "b"], [pa.int64()] * 2, *zip(*out, strict=True))

    rows = rows.withColumn("text", F.col("text").cast("binary"))
    return in_cells(rows, F.greatest(F.ceil(F.col("total") / BLOCK), F.ceil(F.col("elements") / ELEMENTS)), ["text"], parts).mapInArrow(lean(run), "a long, b long")


#: Rounds in which what is left is held against the nearest in other components, before all the rest.
NEAREST = 1


def possible(of, lists: DataFrame) -> DataFrame:
    """(a, b, n, stars) of the pairs of groups that may be similar by how often
    they met, in short lists (n) and as one that stands for the other (stars).

    Elements that two sets share are either in both prefixes or in the rest of
    that one whose prefix ends first. So they share no more than they met in
    short lists, plus the long lists that either is in at the least, plus the
    larger rest.
    """
    by_size = Window.partitionBy("a").orderBy("n", "b")
    fronts = of(FRONT).select(F.lag("b").over(by_size).alias("x"), F.lag("n").over(by_size).alias("nx"), F.col("b").alias("y"), F.col("n").alias("ny"))
    fronts = fronts.filter(f"100 * nx >= {PERCENT} * ny AND x <> y").select(
        F.lit(STAR).alias("kind"), F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.lit(1).cast("long").alias("n"),
        F.when(F.col("x") < F.col("y"), F.shiftleft("nx", WIDE) + F.col("ny")).otherwise(F.shiftleft("ny", WIDE) + F.col("nx")).alias("sizes"),
    )
    pairs = of(PAIR).union(of(STAR)).unionByName(fronts).groupBy("a", "b").agg(
        F.sum(F.expr(f"if(kind = {PAIR}, n, 0L)")).alias("n"), F.sum(F.expr(f"if(kind = {STAR}, n, 0L)")).alias("stars"), F.first("sizes").alias("sizes")
    )
    long = lists.groupBy("grp").agg(F.sum("n").alias("m"))
    for x in ("a", "b"):
        pairs = pairs.join(long.select(F.col("grp").alias(x), F.col("m").alias(f"long_{x}")), x, "left")
    rest = lambda n: F.ceil(n * PERCENT / 100).cast("long") - 1
    pairs = pairs.withColumns({"na": F.shiftright("sizes", WIDE), "nb": F.col("sizes") % (1 << WIDE)})
    most = F.col("n") + F.least(F.coalesce("long_a", F.lit(0)), F.coalesce("long_b", F.lit(0))) + F.greatest(rest(F.col("na")), rest(F.col("nb")))
    pairs = pairs.withColumn("both", F.least(most, "na", "nb"))
    return pairs.filter(SIMILAR).select("a", "b", "n", "stars")


def similar(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", sets_too: bool = False) -> DataFrame:
    """(key, n_shingles, component_id) of every row; component_id is the least key
    that links of at least PERCENT percent reach.

    Rows without words have an empty set, link with nothing and are their own
    component. Rows with equal sets link; repeated rows are all returned. A null
    key takes part; a component of null keys alone has a null id. Only key and
    text are read, so other columns can't clash. An empty table gives an empty
    result. A very long text is read in pieces and costs eight bytes a word.
    With sets_too, a row also tells its set_key and component, a set_key that
    stands for its component whatever the keys are; both are null without words.
    """
    spark = docs.sparkSession
    parts = tasks(docs)
    first = scratch.table(keyed_sets(docs, text, key), "first", rows=1000)
    rows = first.filter("n IS NOT NULL")
    order = spark.sparkContext.broadcast(order_of(first.filter("n IS NULL").select("shingle", "seen"), scratch))

    # what meets
    dealt = postings(docs, order, text, BUCKETS * parts).repartition(parts, "bucket")
    found = scratch.table(met(dealt, order), "met", rows=1000)
    of = lambda kind: found.filter(F.col("kind") == kind)
    lists = of(LISTED).groupBy(F.col("a").alias("list"), F.col("b").alias("grp")).agg(F.sum("n").alias("n"))
    pairs = scratch.table(possible(of, lists), "pairs")
    lists = lists.select("list", "grp")
    meets = pairs.select(F.col("a").alias("grp")).union(pairs.select("b")).union(lists.select("grp")).distinct().withColumn("meets", F.lit(True))
    inside = of(MEMBERS).select(F.col("a").alias("grp"), F.col("b").alias("set_key"))
    hub = inside.groupBy("grp").agg(F.min("set_key").alias("hub"), F.count("*").alias("size")).join(meets, "grp", "left").filter("meets OR size > 1")
    hub = scratch.table(hub.select("grp", "hub"), "hubs")
    group_of = scratch.table(inside.join(hub, "grp"), "groups")
    few = group_of.count() // ROWS_A_FILE + 1

    # the sets of these groups' members, each from one document
    there = group_of.select("set_key").distinct()
    at = rows.groupBy("set_key").agg(F.min(F.xxhash64(key)).alias("at")).join(there, "set_key").select("at")
    sets = scratch.table(members(docs, scratch.table(at, "at"), text, key), "sets", rows=1000)
    # the filter may let copies through: they go where sets come together by key
    bits = sets.groupBy("set_key").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))

    # each group's first member stands for it, and of the groups before it the one that it met most often
    across = pairs.groupBy("b").agg(F.max_by("a", F.struct(F.col("n") + F.col("stars"), F.col("a"))).alias("a"))
    across = across.join(hub.select(F.col("grp").alias("a"), F.col("hub").alias("ha")), "a").join(hub.select(F.col("grp").alias("b"), F.col("hub").alias("hb")), "b")
    once = group_of.filter("set_key <> hub").select(F.col("hub").alias("a"), F.col("set_key").alias("b")).union(across.filter("ha <> hb").select("ha", "hb"))
    tried = starred(once, sets, scratch, parts)
    links = tried.filter(SIMILAR).select("a", "b")
    tried = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    # what else met, member by member, where components differ
    pair_lists = pairs.filter("n > 0").withColumn("list", F.xxhash64("a", "b"))
    lists = lists.union(pair_lists.select("list", "a")).union(pair_lists.select("list", "b"))
    # members of a group may be similar to each other, though not to its first
    several = group_of.groupBy("grp").count().filter("count > 2")
    lists = lists.union(several.select(F.xxhash64("grp").alias("list"), "grp"))
    for k in range(NEAREST + 1):
        whole = scratch.keep(components(links, scratch))
        own = group_of.join(whole.withColumnRenamed("node", "set_key"), "set_key", "left").select("grp", "set_key", F.coalesce("component", "set_key").alias("component"))
        own = scratch.table(own.coalesce(few), f"own{k}")
        # how many elements there are counts only where texts come together
        sized = own.join(bits.select("set_key", "n"), "set_key") if k == NEAREST else own.withColumn("n", F.lit(0).cast("long"))
        spread = sized.groupBy("grp").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("size"), F.sum("n").alias("elements"))
        placed = scratch.table(lists.join(spread, "grp").coalesce(8 * few), f"placed{k}")
        mixed = placed.groupBy("list").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum("size").alias("total"), F.sum("elements").alias("elements")).filter("least <> most").select("list", "total", "elements")
        lists = scratch.table(placed.select("list", "grp").join(mixed, "list").coalesce(8 * few), f"lists{k}")
        left = between(lists.drop("elements").join(own, "grp").join(bits, "set_key"), k == NEAREST, parts)
        if k < NEAREST:
            left = left.groupBy("a").agg(F.max_by("b", F.struct("score", "b")).alias("b"))
        else:
            left = scratch.table(left, "left", rows=1000)
            crowded = scratch.keep(left.filter("score < 0").select(F.col("a").alias("list")).distinct())
            left = left.filter("score >= 0")
            if not crowded.isEmpty():
                texts = sets.groupBy("set_key").agg(F.first("n").alias("n"), F.first("text").alias("text"))
                placed = lists.join(crowded, "list").join(own, "grp").join(texts, "set_key")
                links = links.union(scratch.table(joining(placed, parts), "joining", rows=500))
        left = left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        lists = lists.select("list", "grp")
        more = verified(left.join(tried, ["a", "b"], "left_anti").coalesce(8 * few), sets, scratch, f"verified{k}")
        links = links.union(more.filter(SIMILAR).select("a", "b"))
        tried = tried.union(more.select("a", "b"))
    final = components(links, scratch)

    # from sets to documents
    least = rows.filter("set_key IS NOT NULL").groupBy("set_key").agg(F.min(key).alias("least"))
    joined = scratch.keep(final.withColumnRenamed("node", "set_key").join(least, "set_key"))
    ids = joined.groupBy("component").agg(F.min("least").alias("id"))
    ids = joined.select("set_key", "component").join(ids, "component").select("set_key", "component", "id")
    ids = least.join(ids, "set_key", "left").select("set_key", F.coalesce("component", "set_key").alias("component"), F.coalesce("id", "least").alias("component_id"))
    out = rows.join(ids, "set_key", "left")
    more = ["set_key", "component"] if sets_too else []
    return out.select(key, F.col("n").alias("n_shingles"), F.coalesce("component_id", key).alias("component_id"), *more)


def op7_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Every document's component of similar documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    with Scratch(spark) as scratch:
        return scratch.keep(similar(docs, scratch))


def with_set_key(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, set_key) of docs: all of its columns, and its text's set_key."""
    rows = docs.select(F.struct("*").alias("row"), F.col(text).cast("string").alias("text"))

    def make():
        return lambda raw: (set_key(s) if len(s := shingles(raw)) else None,)

    return per_text(rows, ["row"], "text", "set_key long", make, raw=True)


def kept(docs: DataFrame) -> DataFrame:
    """One document of each component, with its own columns: the one whose id is
    the component's, and of several such rows the least by all columns in order.
    Rows without words are their own components; those equal in every column
    are one document."""
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        found = scratch.keep(similar(docs, scratch, sets_too=True))
    stay = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    ids = stay.groupBy(F.col("doc_id").alias("stays")).count()
    out = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("stays")), "left_semi")
    if ids.filter("count > 1 OR stays IS NULL").isEmpty() and found.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return out  # ids tell the rows apart
    # else texts do: a row's set tells its component
    of = stay.filter("set_key IS NOT NULL").select(F.col("doc_id").alias("stays"), F.col("set_key").alias("of"), "component").distinct()
    keyed = with_set_key(out)
    several = keyed.join(of, F.col("row.doc_id").eqNullSafe(F.col("stays")) & (F.col("set_key") == F.col("of")))
    one = several.groupBy("component").agg(F.min("row").alias("row")).select("row.*")
    return one.unionAll(keyed.filter("set_key IS NULL").select("row.*").distinct())
