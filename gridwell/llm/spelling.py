"""Grouping of spelling variants: words that differ by one letter, without pairs of them.

Words are counted, and numbered from the most frequent one on, so that of two
numbers the lesser is the better form. A word stands in one group for each of
its letters: the word with a wildcard there, that is its position with what goes
before and after. Words that differ by a replaced letter share exactly one such
group; a group keeps its size and its two best words, which is enough to tell each
member how many others there are and which is best. A word's deletions meet the
words that are spelled so, for letters left out or put in. Both kinds travel by
one shuffle of keys, and what each word learns from its groups is added up.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, binaries, lean, read

LETTERS = r"[a-zÀ-ÿ]"
FEWEST_LETTERS, FEWEST = 5, 3
#: Of so many runs in a document's crc32 one loses a letter.
SLIP = 97
#: Different words that a task counts before it hands them on.
COUNTED = 200_000
#: Letters of a piece of text whose words are listed at once.
PIECE = 1 << 20
#: Longer spellings are known by a hash, so that a word of very many letters costs no more than its length.
LONG = 64
#: Hashes of spellings: polynomials over a Mersenne prime at a fixed place.
PRIME, BASE = (1 << 127) - 1, 0x9E3779B97F4A7C15F39CC0605CEDC835 % ((1 << 127) - 1)
SELF, DELETION, WILDCARD = range(3)


def slipped(run: str, seed: int) -> str:
    """run, without a letter where its crc32 says so. seed: the crc32 of what goes before."""
    h = zlib.crc32(run.encode(), seed)
    if h % SLIP:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def counted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of all documents, of words with letters enough. Null texts have no
    words; a null id stands before its runs as an empty text. Repeated rows count
    as often as they are there."""
    find = re.compile(f"{LETTERS}{{{FEWEST_LETTERS},}}")  # a run never gets longer, so the others can't count

    def run(batches):
        total: Counter[str] = Counter()
        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), binaries(batch.column(1)), strict=True):
                text = raw.tobytes().lower().decode("utf-8", "surrogatepass")  # of bytes, only A-Z change
                seed = zlib.crc32(f"{'' if key is None else key}:".encode("utf-8", "surrogatepass"))
                here = Counter(find.findall(text)) if len(text) < PIECE else Counter(m.group() for m in find.finditer(text))
                for word, n in here.items():
                    word = slipped(word, seed)
                    if len(word) >= FEWEST_LETTERS:
                        total[word] += n
                if len(total) >= COUNTED:
                    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
                    total.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    rows = docs.select(F.col(doc_id).cast("string"), F.col(text).cast("string"))
    return rows.mapInArrow(lean(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _hash(size: int, value: int) -> bytes:
    return b"\0\0" + size.to_bytes(8, "big") + value.to_bytes(16, "big")


def _long_keys(word: str) -> tuple[bytes, set[bytes], list[bytes]]:
    """spellings, of a long word: hashes of its parts before and after each letter, put together."""
    size = len(word)
    before, power = [0], [1]
    for c in word:
        before.append((before[-1] * BASE + ord(c)) % PRIME)
        power.append(power[-1] * BASE % PRIME)
    deletions, wildcards, after = set(), [], 0
    for k in range(size - 1, -1, -1):
        rest = size - 1 - k
        deletions.add(_hash(size - 1, (before[k] * power[rest] + after) % PRIME))
        wildcards.append(_hash(size, (before[k] * power[rest + 1] + after) % PRIME))
        after = (after + ord(word[k]) * power[rest]) % PRIME
    return _hash(size, before[-1]), deletions, wildcards


def spellings(word: str) -> tuple[bytes, set[bytes], list[bytes]]:
    """Keys of the word itself, of each different spelling without one letter, and of
    each with a wildcard for one letter. No two spellings share a key, but for
    hashes of 127 bits of those of more than LONG letters."""
    size = len(word)
    if size > LONG:
        own, deletions, wildcards = _long_keys(word)
        if size == LONG + 1:
            deletions = {(word[:k] + word[k + 1 :]).encode() for k in range(size)}
        return own, deletions, wildcards
    return word.encode(), {(word[:k] + word[k + 1 :]).encode() for k in range(size)}, [f"{word[:k]}\0{word[k + 1 :]}".encode() for k in range(size)]


def keys(words: DataFrame) -> DataFrame:
    """(key, kind, id) of each word's spellings; words are (id, word)."""

    def run(batches):
        for batch in batches:
            found, kinds, ids = [], [], []
            for id_, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own, deletions, wildcards = spellings(word)
                found += [own, *deletions, *wildcards]
                kinds += [SELF] + [DELETION] * len(deletions) + [WILDCARD] * len(wildcards)
                ids += [id_] * (1 + len(deletions) + len(wildcards))
                if len(found) >= COUNTED:
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(kinds, pa.int32()), pa.array(ids, pa.int64())], names=["key", "kind", "id"])
                    found, kinds, ids = [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(kinds, pa.int32()), pa.array(ids, pa.int64())], names=["key", "kind", "id"])

    return words.select("id", "word").mapInArrow(lean(run), "key binary, kind int, id long")


def neighbours(words: DataFrame) -> DataFrame:
    """(id, n_near, best) of the words that have near ones: how many, and the least of their ids."""
    group = Window.partitionBy("key")
    inside = group.orderBy("kind", "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = keys(words).select("kind", "id", F.count("*").over(inside).alias("size"), F.first("kind").over(inside).alias("first_kind"), F.first("id").over(inside).alias("first"), F.nth_value("id", 2).over(inside).alias("second"))
    # a deletion knows the word that is spelled so, which stands first; others know their whole group
    rows = rows.filter("size > 1").filter((F.col("kind") != DELETION) | (F.col("first_kind") == SELF))
    deletion = F.col("kind") == DELETION
    near = F.when(deletion, F.lit(1).cast("long")).otherwise(F.col("size") - 1)
    best = F.when(deletion | (F.col("first") != F.col("id")), F.col("first")).otherwise(F.col("second"))
    return rows.select("id", near.alias("near"), best.alias("best")).groupBy("id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, root) of each row of (id, form): the last of its chain of forms. Each round
    doubles how far a row sees; a form is twice as frequent as its word at least, so
    chains are short."""
    now = scratch.keep(forms.select("id", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("id").alias("root"), F.col("root").alias("next"))
        step = scratch.keep(now.join(further, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if step.filter("moved").isEmpty():
            return step.select("id", "root")
        now = step.select("id", "root")


def variants(counts: DataFrame, fewest: int = FEWEST) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of counts (word, n) that come
    up so often. form: the near word of largest n, the first among equals, where
    that is twice the word's n at least. Words are different ones; an empty table
    gives an empty one."""
    with Scratch(counts.sparkSession) as scratch:
        ordered = counts.filter(F.col("n") >= fewest).orderBy(F.desc("n"), "word")
        words = scratch.table(ordered.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")  # ids rise in this order
        near = scratch.table(neighbours(words), "near")
        all_ = words.join(near, "id", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("long")))
        better = all_.filter("best IS NOT NULL").join(words.select(F.col("id").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n")), "best").filter("form_n >= 2 * n")
        forms = scratch.table(better.select("id", "best", "form", "form_n"), "forms")
        last = roots(forms.select("id", F.col("best").alias("form")), scratch)
        named = last.join(words.select(F.col("id").alias("root"), F.col("word").alias("named")), "root").select("id", "named")
        out = all_.join(forms.drop("best"), "id", "left").join(named, "id", "left")
        return scratch.keep(out.select("word", "form", F.coalesce("named", "word").alias("root"), "n", "n_near", "form_n"))


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """Every word of all documents, with its form and root."""
    return variants(counted(read(spark, sf_dir, "documents")))


#: crc32 bit by bit as a table, then byte by byte over each different run of a document.
OP12_SQL = r"""
WITH RECURSIVE bits AS (SELECT i AS byte, 0 AS k, i AS c FROM range(256) AS r(i)
  UNION ALL SELECT byte, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY byte) AS t FROM bits WHERE k = 8),
runs AS MATERIALIZED (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents) WHERE length(run) >= 5 GROUP BY ALL),
bytes AS (SELECT *, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END)) AS b FROM runs),
hashed AS (SELECT doc_id, run, n, xor(list_reduce(list_prepend(4294967295, list_transform(b, lambda x: CAST(x AS BIGINT))), lambda h, x: xor(h >> 8, t[1 + (xor(h, x) & 255)])), 4294967295) AS h FROM bytes, crc),
slipped AS (SELECT n, CASE WHEN h % 97 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM words),
cards AS (SELECT word, n, k, word[:k - 1] AS a, word[k + 1:] AS z FROM places),
near AS (SELECT x.word, y.word AS other, y.n FROM cards x JOIN cards y USING (k, a, z) WHERE x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM cards x JOIN words y ON x.a || x.z = y.word
  UNION SELECT y.word, x.word, x.n FROM cards x JOIN words y ON x.a || x.z = y.word),
best AS (SELECT word, count(*) AS n_near, min({'n': -n, 'other': other}) AS b FROM near GROUP BY word),
forms AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.n >= 2 * n THEN b.other END AS form, CASE WHEN -b.n >= 2 * n THEN -b.n END AS form_n FROM words LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root, form AS next FROM forms UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON f.word = c.next)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, root FROM chain WHERE next IS NULL) USING (word)
"""
