"""Line dedup by two Bloom filters.

A pass over all texts sets, for each line of a document, bits of its key's
hash in a filter of once-seen and, where they were set before, in one of
twice-seen hashes.  Each task sends the places set in the two filters of its
own rows, a bounded number at a time, and never holds a whole filter; places
set by two such lots, or twice within one, make up the twice-seen filter of the
whole table.  A key found in two documents or more
always passes that filter.

The second pass sends on the lines that pass, as suspected repeats, and only
these are shuffled: their documents are counted by the key's whole text, and
the one that keeps its lines is chosen.  The last pass drops the lines.

The filter has ``BITS_A_LINE`` bits a line of the table, up to ``MOST_BITS``
(64 MB), so what tasks get has a bound.  Beyond it more lines are suspected
without need and shuffled; results stay the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort_spark.llm.tables import SPACES
from cohort_spark.sources.stages import stage

#: A key's least length in code points and the documents that must hold it.
LEAST_CHARS, LEAST_DOCS = 20, 3
#: Filter bits a line, bits set for a key, bound of the filter, places of one row.
BITS_A_LINE, HASHES, MOST_BITS, CHUNK = 24, 2, 1 << 29, 1 << 16
#: Places that a task holds before it sends them (32 MB).
HELD = 4_000_000


def line_keys(text: str | None, least: int = LEAST_CHARS) -> list[bytes | None]:
    """A key for each line, None for lines too short to be dropped."""
    out: list[bytes | None] = []
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        key = line.strip(SPACES).lower()  # bytes: A-Z only
        n = len(key)
        if n >= least and (n >= 4 * least or len(key.decode("utf-8", "surrogatepass")) >= least):
            out.append(key)
        else:
            out.append(None)
    return out


def _places(keys: list[bytes], bits: int) -> np.ndarray:
    """Filter places of each key: one row a hash."""
    pairs = np.frombuffer(b"".join(xxhash.xxh3_128_digest(k) for k in keys), dtype=">u8").astype(np.uint64).reshape(-1, 2)
    return np.stack([(pairs[:, j] % np.uint64(bits)).astype(np.int64) for j in range(HASHES)])


def _set_bits(bits: int, least: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(places: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            at, times = np.unique(np.concatenate(places), return_counts=True)
            for name, filled in ((1, at[times == 1]), (2, at[times > 1])):
                chunks, first = np.unique(filled // CHUNK, return_index=True)
                parts = np.split(filled % CHUNK, first[1:]) if len(chunks) else []
                yield pa.RecordBatch.from_pydict({
                    "chunk": pa.array(chunks, pa.int64()), "seen": pa.array([name] * len(chunks), pa.int32()),
                    "places": pa.array([p.astype(np.uint16).tobytes() for p in parts], pa.binary())})

        places, size = [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                keys = [k for k in set(line_keys(text, least)) if k is not None]
                if keys:
                    # a key sets its places once for each document
                    places.append(np.unique(_places(keys, bits).ravel()))
                    size += len(places[-1])
                if size > HELD:
                    yield from sent(places)
                    places, size = [], 0
        if places:
            yield from sent(places)
    return task


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts up to 2 of each place over the rows of a task's chunks; rows come by chunk."""
    def out(chunk: int, times: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int64()),
                                           "twice": pa.array([np.packbits(times > 1).tobytes()], pa.binary())})

    now, times = None, np.zeros(CHUNK, dtype=np.uint8)
    for batch in batches:
        for chunk, seen, places in zip(*[c.to_pylist() for c in batch.columns]):
            if chunk != now:
                if now is not None:
                    yield out(now, times)
                now, times = chunk, np.zeros(CHUNK, dtype=np.uint8)
            at = np.frombuffer(places, dtype=np.uint16)
            times[at] = np.minimum(times[at] + seen, 2)
    if now is not None:
        yield out(now, times)


def twice_seen(docs: DataFrame, text: str = "text", least: int = LEAST_CHARS) -> tuple[int, np.ndarray]:
    """The size and the packed bits of the filter of hashes seen in two documents or more."""
    texts = docs.select(F.col(text).alias("text"))
    # lines long enough to matter hold at least ``least`` characters
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    lines = texts.agg(F.sum(F.least(breaks, F.floor(F.length("text") / least) + 1))).first()[0] or 1
    bits = min(MOST_BITS, max(CHUNK, -(-int(lines) * BITS_A_LINE // CHUNK) * CHUNK))
    parts = max(2, min(bits // CHUNK, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    merged = (texts.mapInArrow(_set_bits(bits, least), "chunk long, seen int, places binary")
              .repartition(parts, "chunk").sortWithinPartitions("chunk")
              .mapInArrow(_merge, "chunk long, twice binary"))
    packed = np.zeros(bits // 8, dtype=np.uint8)
    for row in merged.toLocalIterator():
        start = row.chunk * (CHUNK // 8)
        packed[start:start + CHUNK // 8] = np.frombuffer(row.twice, dtype=np.uint8)
    return bits, packed


def _suspects(sent, least: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, packed = sent.value
        for batch in batches:
            ids, found = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys = [k for k in set(line_keys(text, least)) if k is not None]
                if keys:
                    at = _places(keys, bits)
                    hit = ((packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0)
                    for i in np.flatnonzero(hit):
                        ids.append(doc)
                        found.append(keys[i])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.binary())],
                                             names=["doc_id", "key"])
    return task


def _drop_lines(least: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n_lines, n_dropped = [], [], []
            for text, drops in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                whole = text or ""
                lines = whole.split("\n")
                if drops:
                    gone = set(drops)
                    stay = [line for line, key in zip(lines, line_keys(whole, least))
                            if key is None or md5(key).hexdigest() not in gone]
                    whole = "\n".join(stay)
                    n_dropped.append(len(lines) - len(stay))
                else:
                    n_dropped.append(0)
                kept.append(whole)
                n_lines.append(len(lines))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()),
                                              pa.array(n_dropped, pa.int64())], names=["row", "text", "n_lines", "n_dropped"])
    return task


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least_chars: int = LEAST_CHARS,
                least_docs: int = LEAST_DOCS) -> DataFrame:
    """``docs`` without repeated lines, with ``n_lines`` (before) and ``n_dropped``.

    A line's key is the line without white space at its ends, A-Z lower-cased.
    A key of ``least_chars`` code points or more that ``least_docs`` documents
    or more hold stays in the document of the largest id; a missing id is the
    smallest.  A missing or empty text is one empty line and comes back empty.
    Rows with one id are one document when documents are counted, and each of
    them keeps or loses its lines alike.  An empty table gives an empty result;
    columns of the results' names are replaced.
    """
    base = docs.drop("n_lines", "n_dropped")
    sent = docs.sparkSession.sparkContext.broadcast(twice_seen(base, text, least_chars))
    pairs = base.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # whole key texts decide; a key in a document counts once, so a hot key is dealt by document first
    suspected = stage(pairs.mapInArrow(_suspects(sent, least_chars), "doc_id long, key binary"), "suspects")
    confirmed = (suspected.groupBy("key", "doc_id").agg(F.lit(1).alias("one"))
                 .groupBy("key").agg(F.count("*").alias("docs"), F.max("doc_id").alias("keeper"))
                 .where(F.col("docs") >= least_docs))
    gone = (suspected.join(confirmed, "key").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
            .groupBy("doc_id").agg(F.collect_set(F.md5("key")).alias("_gone")).withColumnRenamed("doc_id", "_id"))
    names = [c for c in base.columns if c != text]
    row = F.struct(*(names or [F.lit(0).alias("none")])).alias("row")
    held = base.select(row, F.col(text).alias("text"), F.col(doc_id).cast("long").alias("doc_id"))
    held = held.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select("row", "text", "_gone")
    kinds = held.schema["row"].dataType.simpleString()
    done = held.mapInArrow(_drop_lines(least_chars), f"row {kinds}, text string, n_lines long, n_dropped long")
    return done.select(*[F.col("text").alias(text) if c == text else F.col(f"row.`{c}`").alias(c) for c in base.columns],
                       "n_lines", "n_dropped")


#: DuckDB SQL for op3 over the table ``documents``.
LINES_SQL = r"""
WITH lines AS (
  SELECT doc_id, p, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS p
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
shared AS (SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20
           GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT doc_id, p, line, keeper IS NOT NULL AND keeper <> doc_id AS gone
           FROM lines LEFT JOIN shared USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
