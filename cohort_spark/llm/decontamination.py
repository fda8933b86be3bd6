"""Benchmark items inside documents: size-partitioned MinHash containment search.

Items are partitioned by their number of shingles.  In a partition whose items
have at most u shingles, an item that is contained to a share t in a document
lacks at most floor((1 - t) u) of its shingles there, so of its bottom-k MinHash
sketch (its k = floor((1 - t) u) + 1 smallest shingle hashes) at least one value
is a shingle of the document, however long that is.  A document is therefore
searched by those of its shingle hashes that lie below the partitions' largest
sketch value and meet a sketch value there; nothing that contains an item is
missed.  Candidates are verified by the exact containment of the shingles' texts.

Everything is a DataFrame expression.  The sketches are written first, so their
size is known: Spark broadcasts them where they are small and shuffles beyond.
"""

from __future__ import annotations

from math import floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohort_spark.llm.tables import spare
from cohort_spark.sources.stages import stage

#: Words of a shingle and the share of an item's shingles that a document must hold.
WORDS, SHARE = 5, 0.8
#: White space between words, and A to Z in lower case.
SPACE = r"[ \t\n\x0B\f\r]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str) -> Column:
    """Words of a text, A-Z lower-cased; none for a missing one."""
    parts = F.split(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), SPACE)
    return F.filter(parts, lambda w: w != "")


def _runs(items: str, k: int) -> Column:
    """The first place of each run of k words, once for a shorter text, none without words."""
    n = F.size(items)
    return (F.when(n == 0, F.array().cast("array<int>"))
            .otherwise(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1)))))


def shingle_hashes(hashes: str, k: int = WORDS) -> Column:
    """Distinct 64-bit hashes of runs of k words, from the words' hashes."""
    run = F.transform(_runs(hashes, k), lambda i: F.xxhash64(
        *[F.coalesce(F.try_element_at(F.col(hashes), i + j), F.lit(0)) for j in range(k)]))
    return F.array_distinct(run)


def shingle_texts(items: str, k: int = WORDS) -> Column:
    """Distinct texts of runs of k words."""
    return F.array_distinct(F.transform(_runs(items, k), lambda i: F.array_join(F.slice(F.col(items), i, k), " ")))


def hashed(df: DataFrame, text: str, k: int) -> DataFrame:
    """``df`` with ``_shingles``, the hashes of its text's shingles."""
    return (df.withColumn("_hashes", F.transform(words(text), lambda w: F.xxhash64(w)))
            .withColumn("_shingles", shingle_hashes("_hashes", k)).drop("_hashes"))


def sketches(items: DataFrame, k: int = WORDS, share: float = SHARE) -> DataFrame:
    """(value, item_id): the bottom-k MinHash sketch of every item by size partition.

    Partitions hold the sizes over 2**(p-1) up to 2**p.
    """
    sized = hashed(items.select("item_id", "text"), "text", k).withColumn("n", F.size("_shingles")).where("n > 0")
    upper = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n"))))
    kept = F.least(F.floor((1 - share) * upper + 1e-9) + 1, F.col("n")).cast("int")
    return sized.select("item_id", F.explode(F.slice(F.array_sort("_shingles"), F.lit(1), kept)).alias("value"))


def contained(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id",
              k: int = WORDS, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) for pairs with ``share`` or more.

    A shingle is a run of k words; a shorter text is one shingle, and a text
    without words has none and is in no pair.  Items with equal texts all
    appear.  Rows with one id count as one document holding the shingles of all
    of them, and items likewise; a missing id is an id.  Empty tables give an
    empty result; other columns play no part.
    """
    if not 0 < share <= 1:
        raise ValueError("share must be over 0 and at most 1")
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    items = items.select("item_id", "text")
    sketch = stage(sketches(items, k, share), "sketches")
    top = sketch.agg(F.max("value")).first()[0]
    if top is None:
        top = -(1 << 63)
    hits = (hashed(docs, "text", k)
            .select("doc_id", F.explode(F.filter("_shingles", lambda v: v <= F.lit(top))).alias("value"))
            .join(sketch, "value").select("doc_id", "item_id").distinct())
    found = stage(hits, "candidates")
    # exact shingles of the candidates only
    wanted = found.select(F.col("doc_id").alias("_d")).distinct()
    held = (docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("_d")), "left_semi")
            .withColumn("_words", words("text")).select("doc_id", shingle_texts("_words", k).alias("_doc")))
    asked = (items.withColumn("_words", words("text")).select("item_id", F.explode(shingle_texts("_words", k)).alias("s"))
             .groupBy("item_id").agg(F.collect_set("s").alias("_item")))
    pairs = (found.join(asked.withColumnRenamed("item_id", "_i"), F.col("item_id").eqNullSafe(F.col("_i"))).drop("_i")
             .join(held.withColumnRenamed("doc_id", "_d"), F.col("doc_id").eqNullSafe(F.col("_d"))).drop("_d")
             .select("doc_id", "item_id", F.size("_item").alias("n_item"),
                     F.explode_outer(F.array_intersect("_item", "_doc")).alias("s")))
    return (pairs.groupBy("doc_id", "item_id", "n_item").agg(F.countDistinct("s").cast("int").alias("n_shared"))
            .withColumn("containment", F.col("n_shared") / F.col("n_item"))
            .where(F.col("n_shared") >= share * F.col("n_item") - 1e-9))


def without_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id",
                         k: int = WORDS, share: float = SHARE) -> DataFrame:
    """``docs`` without those that contain an item; rows of one id go together."""
    other = f"{spare(docs)}d"
    found = contained(docs, items, text, doc_id, k, share).select(F.col("doc_id").alias(other)).distinct()
    return docs.join(stage(found, "contaminated"), F.col(doc_id).eqNullSafe(F.col(other)), "left_anti")


#: DuckDB SQL for op2 over the tables ``documents`` and ``benchmark``.
CONTAINED_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS w
           FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS w
      FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)),
             lambda i: list_aggregate(w[i:i + 4], 'string_agg', ' '))) AS s FROM d WHERE len(w) > 0),
bs AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)),
             lambda i: list_aggregate(w[i:i + 4], 'string_agg', ' '))) AS s FROM b WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id)
SELECT doc_id, item_id, CAST(n_item AS INTEGER) AS n_item, CAST(count(*) AS INTEGER) AS n_shared,
       count(*) / n_item AS containment
FROM bs JOIN ds USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING count(*) >= 0.8 * n_item - 1e-9
"""
