"""SimHash near-duplicates, joined at the words of covering codes (anchor points).

A fingerprint's 64 bits are cut into segments, so two fingerprints that differ
in ``MOST`` bits differ in at most ``MOST // segments`` of one segment.  The
anchors of a segment are the words of a covering code: every value lies within
the code's radius of one, its home.  A value within ``t`` bits of another lies
within radius + t of the other's home, so each fingerprint is replicated to all
anchors within radius + t of it, and at every anchor those at home are compared
with all that came there, by all 64 bits.  No pair is missed.

Two codes are at hand, both perfect: the Golay code of 23 bits over three
segments (few replicas, large anchors) and the Hamming code of 31 bits, with one
bit left as it is, over two (many replicas, tiny anchors).  The estimated cost
for the number of fingerprints decides between them; both find the same pairs.

Equal fingerprints are one vertex.  At an anchor, fingerprints that meet are
joined at once, so an anchor sends on at most one edge for each of its rows,
never all pairs.  An anchor with many at home is split into blocks of them, and
the others are copied to each block; a task holds one block and streams the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohort_spark.llm.components import components
from cohort_spark.llm.tables import tasks_for
from cohort_spark.sources.stages import stage

#: Words of a shingle, bits of two linked fingerprints that may differ, seed of the hash.
WORDS, MOST, SEED = 4, 4, 42
#: Fingerprints at home in one block of an anchor; comparisons worked at a time.
HOMES, CELLS = 8192, 2_000_000
#: Cost of a replica in comparisons, for the choice of the code.
REPLICA_COST = 1000
#: Shingles hashed at a time, which bounds the memory of a very long text.
RUN = 1 << 16


def fingerprint(text: str | None, k: int = WORDS) -> int:
    """The bits set in over half the hashes of a text's shingles; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - k + 1)
    starts, ends = starts[:n].tolist(), ends[len(words) - n:].tolist()
    digest, held = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, n, RUN):
        hashes = np.array([digest(flat[s:e], SEED) for s, e in zip(starts[at:at + RUN], ends[at:at + RUN])], dtype="<u8")
        held += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * held > n, bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprint(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])


@dataclass(frozen=True)
class Code:
    """A linear covering code, by the syndrome of each bit; ``free`` further bits stay as they are."""

    name: str
    segments: int
    syndromes: tuple[int, ...]
    radius: int
    free: int = 0

    def shape(self) -> tuple[int, int]:
        """Most bits of a segment, and the bits it may differ in."""
        return -(-64 // self.segments), MOST // self.segments

    def errors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Patterns that lead from a value to its anchors, by syndrome: (first pattern of each, pattern, weight).

        Within a syndrome the lightest comes first, so that is the way home.
        A flipped free bit uses up one of the bits that a pair may differ in.
        """
        far, n = self.radius + self.shape()[1], len(self.syndromes)
        rows = []
        for flipped in range(self.shape()[1] + 1):
            for free in combinations(range(n, n + self.free), flipped):
                for weight in range(far - flipped + 1):
                    for bits in combinations(range(n), weight):
                        s = 0
                        for b in bits:
                            s ^= self.syndromes[b]
                        rows.append((s, weight + flipped * 64, sum(1 << b for b in bits) + sum(1 << b for b in free)))
        rows.sort()
        s, weight, pattern = (np.array(c, dtype=np.int64) for c in zip(*rows))
        return np.searchsorted(s, np.arange(max(s) + 2)), pattern, weight

    def syndrome(self, values: np.ndarray) -> np.ndarray:
        """Syndrome of each value, a byte of it at a time."""
        out = np.zeros(len(values), dtype=np.int64)
        for at in range(0, len(self.syndromes), 8):
            table = np.zeros(256, dtype=np.int64)
            for bit, s in enumerate(self.syndromes[at:at + 8]):
                table ^= np.where(np.arange(256) >> bit & 1, s, 0)
            out ^= table[values >> at & 255]
        return out

    def cost(self, n: int) -> float:
        """Comparisons a fingerprint costs among ``n``, replicas included."""
        first, _, _ = self.errors()
        replicas = np.diff(first).mean()
        anchors = 2.0 ** (min(len(self.syndromes) + self.free, self.shape()[0])) / len(first[:-1])
        return self.segments * replicas * (REPLICA_COST + n / anchors)


def _remainders(polynomial: int, degree: int, n: int) -> tuple[int, ...]:
    out, value = [], 1
    for _ in range(n):
        out.append(value)
        value <<= 1
        if value >> degree:
            value ^= polynomial
    return tuple(out)


GOLAY = Code("golay", 3, _remainders(0b110001110101, 11, 23), 3)
HAMMING = Code("hamming", 2, tuple(range(1, 32)), 1, 1)


def choose(n: int) -> Code:
    """The code of less estimated cost for ``n`` different fingerprints."""
    return min((GOLAY, HAMMING), key=lambda code: code.cost(n))


def _to_anchors(code: Code):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, patterns, _ = code.errors()
        width = code.shape()[0]
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(values), 4096):
                fps = values[at:at + 4096]
                for segment in range(code.segments):
                    part = (fps >> np.uint64(segment * width)).astype(np.int64) & ((1 << width) - 1)
                    s = code.syndrome(part)
                    n = first[s + 1] - first[s]
                    begin = np.concatenate([[0], np.cumsum(n)[:-1]])
                    place = np.arange(n.sum()) - np.repeat(begin, n)
                    anchors = np.repeat(part, n) ^ patterns[np.repeat(first[s], n) + place]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchors * code.segments + segment, pa.int64()), pa.array(place == 0),
                         pa.array(np.repeat(fps, n).view(np.int64), pa.int64())], names=["anchor", "home", "fp"])
    return task


class _Anchor:
    """One block of an anchor: the fingerprints at home and how they hang together."""

    def __init__(self, homes: np.ndarray):
        self.homes, self.label = homes, np.arange(len(homes))
        self.edges: list[np.ndarray] = []
        self.meet(homes)

    def meet(self, others: np.ndarray) -> None:
        """Join those at home that ``others`` are near to, and keep one edge for each of the others."""
        rows = max(1, CELLS // max(1, len(self.homes)))
        for at in range(0, len(others) if len(self.homes) else 0, rows):
            part = others[at:at + rows]
            near = np.bitwise_count(part[:, None] ^ self.homes[None, :]) <= MOST
            hit = np.flatnonzero(near.any(axis=1))
            if not len(hit):
                continue
            near, part = near[hit], part[hit]
            one = self.homes[near.argmax(axis=1)]
            apart = one != part
            self.edges.append(np.stack([part[apart], one[apart]]))
            low = np.where(near, self.label, len(self.homes)).min(axis=1)
            high = np.where(near, self.label, -1).max(axis=1)
            for row in np.flatnonzero(low != high):
                labels = np.unique(self.label[near[row]])
                if len(labels) > 1:
                    self.label[np.isin(self.label, labels)] = labels[0]

    def links(self) -> np.ndarray:
        moved = self.label != np.arange(len(self.homes))
        return np.concatenate([*self.edges, np.stack([self.homes[moved], self.homes[self.label[moved]]])], axis=1)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges among rows (group, home, fp) sorted by group, those at home first."""
    def sent(links: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(side.view(np.int64), pa.int64()) for side in links], names=["a", "b"])

    group, held, anchor = None, [], None
    for batch in batches:
        keys, homes = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        fps = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
        cuts = np.flatnonzero((np.diff(keys) != 0) | (np.diff(homes.astype(np.int8)) != 0)) + 1
        for begin, end in zip([0, *cuts], [*cuts, len(keys)]):
            if begin == end:
                continue
            if keys[begin] != group:
                if group is not None:
                    links = (anchor or _Anchor(np.concatenate(held) if held else fps[:0])).links()
                    if links.shape[1]:
                        yield sent(links)
                group, held, anchor = keys[begin], [], None
            if homes[begin]:
                held.append(fps[begin:end])
            else:
                anchor = anchor or _Anchor(np.concatenate(held) if held else fps[:0])
                anchor.meet(fps[begin:end])
    if group is not None:
        links = (anchor or _Anchor(np.concatenate(held) if held else np.zeros(0, np.uint64))).links()
        if links.shape[1]:
            yield sent(links)


def near_links(fps: DataFrame, code: Code | None = None, homes: int = HOMES) -> DataFrame:
    """Edges (a, b) among distinct fingerprints ``fp`` whose components are those of all pairs within ``MOST`` bits."""
    spark = fps.sparkSession
    code = code or choose(fps.count())
    posted = fps.select("fp").mapInArrow(_to_anchors(code), "anchor long, home boolean, fp long")
    # anchors with more at home than a block takes, each with its number of blocks
    hot = stage(posted.where("home").groupBy("anchor").agg(F.ceil(F.count("*") / homes).alias("blocks")).where("blocks > 1"), "hot")
    own = F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1)))
    spread = (posted.join(hot, "anchor", "left")
              .select("anchor", "home", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("block"))
              .select(F.xxhash64("anchor", "block").alias("deal"), "anchor", "block", F.expr("home and block = own").alias("home"), "fp"))
    groups = (spread.repartition(tasks_for(spark), "deal").sortWithinPartitions("deal", "anchor", "block", F.desc("home"))
              .select(F.xxhash64("anchor", "block", "deal").alias("group"), "home", "fp"))
    return groups.mapInArrow(_compare, "a long, b long")


def simhash_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", code: Code | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp, component_id) for every row of ``docs``, and the edges (a, b) between fingerprints.

    ``component_id`` is the smallest id reachable, missing ids apart; a row
    whose component holds no id at all has none.  Texts that are missing, empty
    or without words have fingerprint zero and are linked like any other;
    repeated rows stay, an empty table gives none, other columns take no part.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = stage(docs.mapInArrow(_fingerprints, "doc_id long, fp long"), "signed")
    classes = stage(signed.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    links = stage(near_links(classes, code), "links")
    labels = components(links).withColumnRenamed("v", "fp")
    labelled = stage(classes.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp")), "labelled")
    smallest = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    found = labelled.join(smallest, "label").select("fp", "component_id")
    return signed.join(found, "fp").select("doc_id", "fp", "component_id"), links


def digits(fp: str = "fp"):
    """A fingerprint as 16 hex digits."""
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")
