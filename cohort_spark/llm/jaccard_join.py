"""N-gram Jaccard join with adaptive prefixes that must share several tokens.

Tokens of a document are its distinct word n-grams.  In one order of all
tokens, two sets that overlap in ``o`` tokens or more share at least l tokens
among the first ``size - o + l`` of each, for every l.  Each document picks its
own l: a longer prefix meets more postings, but then l of them must agree before
a pair is verified.  The estimate it minimises is

    postings(l) + VERIFY * postings(l) / l

with the postings of its prefix counted over all documents: every candidate
with l shared tokens takes up l postings.

Documents with equal sets are one vertex.  Vertices that share prefix tokens
are joined in two steps, so that a group of thousands of near copies never
emits all its pairs: first each vertex meets one hub a token and size band, and
verified pairs are joined into components; then the vertices of a token that
still lie in different components meet each other, except those within the
token's largest component.  Every link between sets of different components is
found, so the components are exact.

Near copies just short of a link are in no common component, and all of them
share tokens.  Each vertex has a parity sketch: one bit for each residue of its
tokens, set if their number is odd.  A token in both sets leaves no trace in the
difference of two sketches, so the bits that differ are never more than the
tokens that differ, and pairs with too many go before they are made.

Frequent tokens come last in the order;
they are found in a pass over all texts whose list has at most ``SHARES`` times
the mean set size entries.  Their number decides speed only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohort_spark.llm.components import components
from cohort_spark.llm.tables import spare
from cohort_spark.llm.worker import few_texts, held, one_by_one
from cohort_spark.sources.stages import stage

#: Words of an n-gram; the similarity as a percentage.
WORDS, PERCENT = 3, 90
#: Most tokens a pair may be asked to share; cost of a verification in postings.
MOST_SHARED, VERIFY = 6, 40
#: A token is frequent if one in SHARES documents holds it; documents of one count.
SHARES, CHUNK_DOCS, CHUNK_LEAST = 2048, 2000, 4
#: Words whose hash a worker keeps, longest word kept; bits of the filter for candidates' texts (8 MB).
CACHED, LONGEST, MOST_BITS = 200_000, 48, 1 << 26
#: Tokens of texts that a task keeps while it verifies pairs (8 MB).
MOST_TOKENS = 1_000_000
#: Longs of a parity sketch, 64 bits each.
SKETCH = 4


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED:
            self.clear()
        found = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONGEST:
            self[word] = found
        return found


def shingles(text: str | None, k: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of k words; a shorter text is one run."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.int64)
    hashed = np.fromiter(map(held("word hashes", _Hashes).__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - k + 1)
    out = np.full(n, min(k, len(words)), dtype=np.uint64)
    for j in range(min(k, len(words))):
        out = (out ^ hashed[j:j + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return np.unique(out.view(np.int64))


def least_overlap(n: int, percent: int) -> int:
    """Tokens that a set of n tokens shares with any linked one, at least."""
    return -(-percent * n // 100)


def _frequent(k: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(sets: list[np.ndarray]) -> pa.RecordBatch:
            tokens, n = np.unique(np.concatenate(sets), return_counts=True)
            often = n >= CHUNK_LEAST
            return pa.RecordBatch.from_pydict({"token": pa.array(tokens[often], pa.int64()),
                                               "n": pa.array(n[often], pa.int64())})

        sets: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for text in one_by_one(batch.column(0)):
                sets.append(shingles(text, k))
                size += len(sets[-1])
                if len(sets) >= CHUNK_DOCS or size > 2_000_000:
                    yield counted(sets)
                    sets, size = [], 0
        if sets:
            yield counted(sets)
    return task


def frequent_tokens(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens found often in all texts, sorted, and their counts."""
    n_docs = docs.count()
    rows = (docs.select("text").mapInArrow(_frequent(k), "token long, n long").groupBy("token")
            .agg(F.sum("n").alias("n")).where(F.col("n") >= max(CHUNK_LEAST, n_docs // SHARES)).toPandas())
    rows = rows.sort_values("token")
    return rows["token"].to_numpy(dtype=np.int64), rows["n"].to_numpy(dtype=np.int64)


def _signatures(sent, k: int, percent: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, often = sent.value
        for batch in batches:
            sizes, keys, prefixes, sketches = [], [], [], []
            for text in one_by_one(batch.column(2)):
                tokens = shingles(text, k)
                n = len(tokens)
                sizes.append(n)
                keys.append(xxhash.xxh3_128_digest(tokens.tobytes()))
                sketches.append(parity_sketch(tokens))
                kept = n - least_overlap(n, percent) + MOST_SHARED
                if not joinable(n, percent):
                    prefixes.append(tokens[:0])
                    continue
                if len(heavy):
                    at = np.minimum(np.searchsorted(heavy, tokens), len(heavy) - 1)
                    weight = np.where(heavy[at] == tokens, often[at], 0)
                    tokens = tokens[np.lexsort((tokens, weight))]
                prefixes.append(tokens[:kept])
            ends = np.cumsum([0, *map(len, prefixes)])
            flat = np.concatenate([np.zeros(0, dtype=np.int64), *prefixes])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64())),
                 *map(pa.array, np.array(sketches, dtype=np.int64).reshape(-1, SKETCH).T)],
                names=["doc_id", "th", "n", "key", "prefix", *sketch_columns()])
    return task


def sketch_columns(side: str = "") -> list[str]:
    return [f"sketch{i}{side}" for i in range(SKETCH)]


def parity_sketch(tokens: np.ndarray) -> np.ndarray:
    """Longs whose bits tell whether a residue occurs an odd number of times."""
    odd = np.bincount(tokens & (64 * SKETCH - 1), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _near_sketches(percent: int) -> Column:
    """Whether the sketches of a pair allow the overlap of a link; true for every link."""
    differ = sum((F.bit_count(F.col(a).bitwiseXOR(F.col(b))) for a, b in zip(sketch_columns("_a"), sketch_columns("_b"))), F.lit(0))
    both = F.col("n_a") + F.col("n_b")
    # the overlap is half of both sizes less the tokens that differ
    return (100 + percent) * (both - differ) >= 2 * percent * both


def joinable(n: int, percent: int) -> bool:
    """Whether a set of n tokens can be linked with a different one (of n + 1 tokens or less)."""
    return n > 0 and (100 * n >= percent * (n + 1) or 100 * (n - 1) >= percent * n)


def _links(percent: int, k: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        held_tokens = 0
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            linked = []
            for i, texts in enumerate(zip(one_by_one(batch.column(2)), one_by_one(batch.column(3)))):
                x, y = (known.get(v) for v in (a[i], b[i]))
                x = shingles(texts[0], k) if x is None else x
                y = shingles(texts[1], k) if y is None else y
                if held_tokens + len(x) + len(y) > MOST_TOKENS:
                    known.clear()
                    held_tokens = 0
                for v, tokens in ((a[i], x), (b[i], y)):
                    if v not in known:
                        known[v] = tokens
                        held_tokens += len(tokens)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * shared >= percent * (len(x) + len(y) - shared))
            keep = np.flatnonzero(linked)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep))],
                                             names=["a", "b"])
    return task


def _text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _maybe_in(spark: SparkSession, wanted: DataFrame, col: str) -> Callable[[Column], Column]:
    """A filter for hashes in ``wanted``: a bit for each, up to MOST_BITS, so what tasks get is bounded.

    It lets all wanted ones pass and a few others, which a join then takes out.
    """
    bits = min(MOST_BITS, max(1 << 16, 16 * wanted.count() // 64 * 64))
    words = (wanted.select(F.pmod(F.col(col), F.lit(bits)).alias("at"))
             .groupBy(F.expr("at div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("set"))
             .toPandas())
    table = np.zeros(bits // 64, dtype=np.int64)
    table[words["word"]] = words["set"]
    sent = spark.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def passes(values: pd.Series) -> pd.Series:
        at = values.to_numpy(dtype=np.int64) % bits
        return pd.Series((sent.value[at >> 6] >> (at & 63)) & 1 == 1)

    return passes


def _verified(pairs: DataFrame, vertices: DataFrame, docs: DataFrame, percent: int, k: int) -> DataFrame:
    """The linked ones among candidate ``pairs`` (a, b), by the whole texts of both."""
    pairs = stage(pairs, "pairs")
    ids = pairs.select(F.col("a").alias("vid")).union(pairs.select(F.col("b").alias("vid"))).distinct()
    wanted = stage(vertices.select("vid", "rep").join(ids, "vid")
                   .select("vid", F.col("rep.doc_id").alias("_id"), F.col("rep.th").alias("_th")), "wanted")
    maybe = _maybe_in(docs.sparkSession, wanted, "_th")
    with few_texts(docs.sparkSession):
        texts = stage(docs.where(maybe(F.col("th")))
                      .join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")))
                      .select("vid", "text").dropDuplicates(["vid"]), "texts")
        sides = (pairs.join(texts.withColumnsRenamed({"vid": "a", "text": "left"}), "a")
                 .join(texts.withColumnsRenamed({"vid": "b", "text": "right"}), "b").select("a", "b", "left", "right"))
        return stage(sides.mapInArrow(_links(percent, k), "a long, b long"), "links")


def _probe() -> Column:
    """Shared tokens asked for by the larger of two vertices, the one that probes."""
    larger = (F.col("n_a") > F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") > F.col("b")))
    return F.when(larger, F.col("l_a")).otherwise(F.col("l_b"))


def _can_link(percent: int) -> Column:
    """Whether two sizes allow a link, and the tokens that could be in the overlap.

    Up to the end of the shorter prefix these are tokens that stand in another
    prefix as well (``met``); beyond it at most the rest of that set.
    """
    most = F.least("met_a", "met_b") + F.greatest("rest_a", "rest_b")
    return ((100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
            & ((100 + percent) * most >= percent * (F.col("n_a") + F.col("n_b"))))


def _counted(met: DataFrame, percent: int) -> DataFrame:
    """Pairs that share as many tokens within their prefixes as their prober asks for.

    Tokens after both prefixes add at most the longer rest, ``o - l``, to the
    overlap; pairs that cannot reach a link's overlap with it go too.
    """
    asked = met.withColumn("asked", _probe()).where("level_a <= asked and level_b <= asked")
    # a pair may be met in either order, by different tokens
    pairs = asked.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "asked",
                          (F.col("n_a") + F.col("n_b")).alias("both"), F.greatest("n_a", "n_b").alias("larger"))
    most = F.col("met") + F.ceil(F.col("larger") * percent / 100.0) - F.col("asked")
    return (pairs.agg(F.count("*").alias("met"))
            .where((F.col("met") >= F.col("asked")) & ((100 + percent) * most >= percent * F.col("both")))
            .select("a", "b"))


def _side(rows: DataFrame, side: str, *more: str) -> DataFrame:
    own = ("n", "l", "level", "met", "rest", "label", *sketch_columns())
    return rows.select("token", *more, F.col("vid").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in own if c in rows.columns])


def _sketched(pairs: DataFrame, vertices: DataFrame, percent: int) -> DataFrame:
    """The candidate pairs whose sketches allow a link."""
    for side in ("a", "b"):
        pairs = pairs.join(vertices.select(F.col("vid").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("n", *sketch_columns())]), side)
    return pairs.where(_near_sketches(percent)).select("a", "b")


def jaccard_join(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT,
                 k: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """Classes of documents linked by similar n-gram sets, and the links that span them.

    Returns (doc_id, th, n_shingles, vertex, class) per row of ``docs``, ``th``
    being a hash of the text, and (a, b) between vertices.  Rows of equal sets have one vertex; ``class`` is the
    smallest vertex reachable, null for a row without words, which is linked
    with nothing.  Missing and repeated ids stay as they are, rows are joined by
    their texts; an empty table gives empty results.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("th", _text_hash("text"))
    longs = ", ".join(f"{c} long" for c in sketch_columns())
    with few_texts(spark):
        sent = spark.sparkContext.broadcast(frequent_tokens(docs, k))
        rows = stage(docs.select("doc_id", "th", "text").mapInArrow(
            _signatures(sent, k, percent), f"doc_id long, th long, n long, key binary, prefix array<long>, {longs}"), "rows")
    reps = (rows.where("n > 0").groupBy("key")
            .agg(F.min(F.struct("doc_id", "th")).alias("rep"), *[F.first(c).alias(c) for c in ("n", "prefix", *sketch_columns())]))
    # the written number of a vertex is the same wherever the table is read
    vertices = stage(reps.withColumn("size", F.size("prefix").cast("long")).withColumn("vid", F.monotonically_increasing_id()), "vertices")

    # a posting is a token with its vertex and level, in two numbers
    first = F.col("n") - F.ceil(F.col("n") * percent / 100.0)
    level = F.greatest(F.lit(1), F.col("pos") - first + 1).cast("long")
    posted = (vertices.select("vid", "n", F.posexplode("prefix").alias("pos", "token"))
              .select("token", F.shiftleft("vid", 4).bitwiseOR(level).alias("at")).repartition("token"))
    # counted and joined in one shuffle of the postings; two of a token are never equal
    often = (posted.groupBy("token").agg(F.count("*").alias("df"), F.min("at").alias("lo"), F.max("at").alias("hi"))
             .where("lo < hi").select("token", "df"))
    shared = posted.join(often, "token").select("token", F.shiftright("at", 4).alias("vid"),
                                                F.expr("cast(at & 15 as int)").alias("level"), "df")
    own = Window.partitionBy("vid")
    postings = [F.sum(F.when(F.col("level") <= l, F.col("df") - 1).otherwise(0)).over(own).alias(f"s{l}") for l in range(1, MOST_SHARED + 1)]
    # a link overlaps in o = size - first tokens at least, so no more can be asked for
    costs = F.array(*[F.when(F.col("n") - first >= l, F.col(f"s{l}") * (1 + VERIFY / l)) for l in range(1, MOST_SHARED + 1)])
    band = F.floor(F.log("n") / -F.log(F.lit(percent / 100.0))) if percent < 100 else F.col("n")
    posts = stage(shared.select("token", "vid", "level", *postings, F.count("*").over(own).alias("met"))
                 .join(vertices.select("vid", "n", "size"), "vid")
                 .select("token", "vid", "level", "n", F.array_position(costs, F.array_min(costs)).cast("int").alias("l"),
                         "met", (F.col("n") - F.col("size")).alias("rest"), band.alias("band")), "postings")

    # the hub is the vertex that others share most of, as the text that near copies come from
    hubs = (posts.groupBy("token", "band").agg(F.max(F.struct("met", "vid", "n", "l", "level", "rest")).alias("hub"), F.count("*").alias("c"))
            .where("c > 1").select("token", "band", "hub.*"))
    met = (_side(posts, "b", "band").join(_side(hubs, "a", "band"), ["token", "band"])
           .where((F.col("a") != F.col("b")) & _can_link(percent)))
    links = _verified(_sketched(_counted(met, percent), vertices, percent), vertices, docs, percent, k)
    labels = components(links)

    of_vertex = stage(posts.groupBy("vid").agg(*[F.first(c).alias(c) for c in ("n", "l", "met", "rest")])
                      .join(vertices.select("vid", *sketch_columns()), "vid")
                      .join(labels.withColumnRenamed("v", "vid"), "vid", "left")
                      .withColumn("label", F.coalesce("label", "vid")), "of_vertex")
    named = stage(posts.select("token", "vid", "level").join(of_vertex.select("vid", "label"), "vid"), "named")
    per = named.groupBy("token", "label").agg(F.count("*").alias("c"))
    major = (per.groupBy("token").agg(F.max_by("label", F.struct("c", "label")).alias("major"), F.count("*").alias("labels"))
             .where("labels > 1").drop("labels"))
    open_ = stage(named.join(major, "token").select("token", "vid", "level", F.expr("label = major").alias("is_major"))
                  .join(of_vertex, "vid"), "open")
    met = (_side(open_.where("not is_major"), "a").join(_side(open_, "b", "is_major"), "token")
           .where(F.expr("label_a <> label_b and (is_major or a < b)") & _can_link(percent) & _near_sketches(percent)))
    links = stage(links.union(_verified(_counted(met, percent), vertices, docs, percent, k)), "all_links")
    labels = components(links)

    found = (vertices.select("key", "vid").join(labels.withColumnRenamed("v", "vid"), "vid", "left")
             .select("key", F.col("vid").alias("vertex"), F.coalesce("label", "vid").alias("class")))
    return (rows.select("doc_id", "th", F.col("n").alias("n_shingles"), "key").join(found, "key", "left").drop("key"), links)


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT, k: int = WORDS) -> DataFrame:
    """``docs`` with one row of each class, that of the smallest id (a missing one is smallest), then text hash.

    Rows without words stay.  Of rows repeated with id and text one stays, in
    its other columns any of them.
    """
    classes, _ = jaccard_join(docs, text, doc_id, percent, k)
    # keys without nulls, so that the repeated rows and the join share one shuffle of the texts
    p = spare(docs)
    names = [f"{p}id", f"{p}null", f"{p}th"]
    best = (classes.where("class is not null").groupBy("class").agg(F.min(F.struct("doc_id", "th")).alias("k"))
            .select(F.coalesce("k.doc_id", F.lit(0)).alias(names[0]), F.col("k.doc_id").isNull().alias(names[1]),
                    F.col("k.th").alias(names[2])))
    with_words = F.coalesce(F.col(text).rlike(r"[^ \t\n\x0B\f\r]"), F.lit(False))
    rows = docs.where(with_words).select("*", F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias(names[0]),
                                         F.col(doc_id).isNull().alias(names[1]), _text_hash(text).alias(names[2]))
    kept = rows.dropDuplicates(names).join(stage(best, "kept"), names, "left_semi")
    return kept.select(docs.columns).union(docs.where(~with_words))


def with_components(classes: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest id of each row's class, its own without words."""
    smallest = classes.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("component_id"))
    return (classes.join(smallest, "class", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")))
