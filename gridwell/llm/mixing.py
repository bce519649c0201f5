"""Mixing sources to target weights by systematic sampling.

Every document of a source expects the same number of copies, its source's
target divided by its source's size. Within a source these expectations are
summed up in a fixed order, one random offset is added, and a document is
emitted once for each integer that the running sum crosses. The order goes by
size class, so that what is over in one document is made up for by the next
ones of much the same size: a source's words miss its target by about one
document at most.

Only DataFrame functions are used. The running sum isn't a window over a whole
source: documents are dealt to cells (source, size class, one of ``SALTS``
salts), the cells' counts are summed up in two small windows, and the place
within the cell comes from a window over the cell, so a source with a third of
all rows, or with a third of all rows equal, is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, word_count

WEIGHTS = (1, 2, 3)
#: No source is asked for more than so many times its words.
CAP = 3
SALTS = 4096
SEED = 20
#: Expected copies count in units of 1 / ONE, so that running sums are exact.
ONE = 1 << 31


def size_class(n: Column) -> Column:
    """32 classes for each doubling of a size, in ascending order; integers only."""
    bits = F.length(F.bin(n)).cast("long")
    shift = F.greatest(bits - 6, F.lit(0))
    return bits * 64 + F.floor(n / F.pow(F.lit(2.0), shift)).cast("long")


def hashed(value: Column) -> Column:
    """32 bits of an MD5, as an integer."""
    return F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, cap=CAP) -> DataFrame:
    """Of a row (src, source, words) for each source: its target.

    Sources in code point order, null last, get the weights in turn and share
    all words by them. A target stops at cap times the source's words and the
    rest goes to the others by weight. With sources in order of cap * words /
    weight, those at their cap come first, and each possible number of them
    gives a share per weight; the right one is the greatest that its own source
    can take.
    """
    every = Window.partitionBy()
    ranked = sizes.withColumn("rank", F.row_number().over(every.orderBy(F.col("source").isNull(), "source")) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = ranked.withColumn("weight", weight).withColumn("most", F.col("words") * cap)
    by_ratio = every.orderBy(F.col("most") / F.col("weight"), "rank")
    rows = (
        rows.withColumn("before", F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("after", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("words").over(every))
        .withColumn("level", (F.col("total") - F.col("before")) / F.col("after"))
    )
    fits = F.when(F.col("level") <= F.col("most") / F.col("weight"), F.col("level"))
    rows = rows.withColumn("share", F.max(fits).over(every))
    target = F.least(F.col("most").cast("double"), F.col("share") * F.col("weight"))
    return rows.select("src", F.col("words").alias("source_size"), F.coalesce(target, F.lit(0.0)).alias("target"))


def mix(docs: DataFrame, size: Column | None = None, source: str = "source", key: str = "doc_id", weights=WEIGHTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """Rows of docs, as a struct ``row``, with size, source_size, target and copies.

    size: a column of whole numbers; by default the words of ``text``, however
    long. Ties and repeated rows each count for themselves and may get different
    numbers of copies; rows that share a key go by a hash of all their columns, so
    reruns agree. A null text has size 0; so has an empty one. Null sources are one
    source. A null key is a key. Sources without words have target 0 and no
    copies. Any further columns stay inside ``row``, so no name can clash. An
    empty table gives an empty one.
    """
    spark = docs.sparkSession
    size = word_count(F.col("text")) if size is None else size
    name = F.col(source).cast("string")
    rows = docs.select(
        F.struct("*").alias("row"),
        F.when(name.isNull(), "n").otherwise(F.concat(F.lit("s"), name)).alias("src"),
        size.cast("long").alias("size"),
        F.col(key).alias("key"),
        hashed(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit("null")))).alias("hash"),
        F.xxhash64(*(f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString())).alias("tie"),
    ).withColumns({"class": size_class(F.col("size")), "salt": F.col("hash") % SALTS})
    cell = ["src", "class", "salt"]
    with Scratch(spark) as scratch:
        cells = scratch.keep(rows.groupBy(*cell).agg(F.count("*").alias("n"), F.sum("size").alias("words")))
    classes = cells.groupBy("src", "class").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    sizes = classes.groupBy("src").agg(F.sum("words").alias("words")).withColumn("source", F.when(F.col("src") != "n", F.expr("substr(src, 2)")))
    classes = classes.select("src", "class", F.coalesce(F.sum("n").over(before("src", "class")), F.lit(0)).alias("base"))
    aims = targets(sizes, weights, cap)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    classes = classes.join(
        aims.select(
            "src", "source_size", "target",
            F.floor(rate).alias("whole"),
            F.floor((rate - F.floor(rate)) * ONE).alias("part"),
            (hashed(F.concat_ws(":", F.lit(f"{seed}/offset"), "src")) % ONE).alias("offset"),
        ),
        "src",
    )
    cells = cells.select(*cell, F.coalesce(F.sum("n").over(before("src", "class", "salt")), F.lit(0)).alias("within")).join(classes, ["src", "class"])
    place = F.row_number().over(Window.partitionBy(*cell).orderBy("size", "hash", "key", "tie"))
    placed = rows.join(cells, cell).withColumn("place", F.col("base") + F.col("within") + place)
    crossed = (F.col("offset") + F.col("place") % ONE * F.col("part")) % ONE < F.col("part")
    return placed.select("row", "size", "source_size", "target", (F.col("whole") + crossed.cast("long")).alias("copies"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: docs' own columns, each document as often as it is taken."""
    rows = mix(docs, **how).filter("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).select("row.*")


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    with Scratch(spark) as scratch:
        slim = scratch.keep(docs)  # the texts are read once
    rows = mix(slim, F.col("size"))
    return rows.select(
        F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


OP1_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('20:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT AS hash
  FROM documents),
classed AS (
  SELECT *, length(bin(size)) * 64 + (size >> greatest(length(bin(size)) - 6, 0)) AS class, hash % 4096 AS salt FROM docs),
sizes AS (SELECT source, sum(size)::BIGINT AS words FROM docs GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM sizes),
weighed AS (SELECT *, rank % 3 + 1 AS weight, words * 3 AS most FROM ranked),
levels AS (
  SELECT *, (sum(words) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(weight) OVER (ORDER BY most / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level
  FROM weighed),
shares AS (SELECT *, max(CASE WHEN level <= most / weight THEN level END) OVER () AS share FROM levels),
aims AS (SELECT source, words AS source_size, least(most::DOUBLE, share * weight) AS target,
                CASE WHEN words > 0 THEN least(most::DOUBLE, share * weight) / words ELSE 0 END AS rate,
                ('0x' || substr(md5('20/offset:' || CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END), 1, 8))::BIGINT % 2147483648 AS off
         FROM shares),
placed AS (
  SELECT c.*, row_number() OVER (PARTITION BY source ORDER BY class, salt, size, hash, doc_id) AS place FROM classed c),
parts AS (
  SELECT p.doc_id, p.size, p.place, a.*, floor(rate)::BIGINT AS whole, floor((rate - floor(rate)) * 2147483648)::BIGINT AS part
  FROM placed p JOIN aims a ON p.source IS NOT DISTINCT FROM a.source),
taken AS (
  SELECT *, whole + CASE WHEN (off + (place % 2147483648) * part) % 2147483648 < part THEN 1 ELSE 0 END AS copies FROM parts)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM taken
"""
