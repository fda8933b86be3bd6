"""Sharding by a k-d tree over metadata.

The tree halves the shards until each leaf is one: a node with k shards is cut
at the weighted quantile k1/k along the dimension in which its units lie widest.
The cut is found over all units by counting bytes in bins and looking closer
into the bin that holds it, so nothing is sorted and a task only holds counts.

Documents with equal texts form one unit and stay together.  A group of copies
heavier than ``SLACK`` of a shard is cut into pieces by a hash of the ids, so a
group that holds a third of all rows fills several shards evenly.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohort_spark.llm.ranks import ranked
from cohort_spark.llm.tables import mixed, spare
from cohort_spark.sources.stages import stage

#: Part of a shard's bytes that a unit may hold, and by which a cut may miss.
SLACK = 0.02
#: Bins of one look at a node; three looks tell 2**30 places apart.
BINS, LOOKS = 1024, 5
#: Bytes that a row costs besides its text.
ROW_BYTES = 8
#: Dimensions of the tree.  A unit's place in one is a number in [0, 1): 20 bits
#: of the value, then a hash that tells units of one value apart.
DIMENSIONS = ("k_size", "k_lang", "k_source")
LEVELS = float(1 << 20)


@dataclass
class Node:
    """Shards ``first`` to ``first + n - 1``; after a cut, units below it go to ``low``."""

    first: int
    n: int
    dimension: str | None = None
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None

    def split(self, dimension: str, cut: float) -> None:
        self.dimension, self.cut = dimension, cut
        self.low = Node(self.first, self.n // 2)
        self.high = Node(self.first + self.n // 2, self.n - self.n // 2)


def place(node: Node) -> Column:
    """The leaf's shard as one expression over a unit's dimensions."""
    if node.dimension is None:
        return F.lit(node.first)
    return F.when(F.col(node.dimension) < node.cut, place(node.low)).otherwise(place(node.high))


def _leaves(node: Node) -> list[Node]:
    return [node] if node.dimension is None else _leaves(node.low) + _leaves(node.high)


def _all_bins(rows: DataFrame) -> dict[int, dict[str, dict[int, int]]]:
    """Bytes in the bins of every dimension and leaf: the first look."""
    spots = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.floor(F.col(d) * BINS).alias("bin")) for d in DIMENSIONS]))
    counted = (rows.select("leaf", "weight", spots.alias("at")).groupBy("leaf", "at.d", "at.bin")
               .agg(F.sum("weight").alias("w")).collect())
    out: dict[int, dict[str, dict[int, int]]] = {}
    for row in counted:
        out.setdefault(row.leaf, {}).setdefault(row.d, {})[row.bin] = row.w
    return out


def _near_bins(rows: DataFrame, looks: dict[int, tuple[str, float, float]]) -> dict[int, dict[int, int]]:
    """Bytes in the bins of one dimension between two bounds, for each leaf."""
    spot = F.lit(None).cast("long")
    for leaf, (d, lo, width) in looks.items():
        inside = (F.col("leaf") == leaf) & (F.col(d) >= lo) & (F.col(d) < lo + width)
        spot = F.when(inside, F.floor((F.col(d) - lo) / (width / BINS))).otherwise(spot)
    counted = (rows.select("leaf", "weight", spot.alias("bin")).where(F.col("bin").isNotNull())
               .groupBy("leaf", "bin").agg(F.sum("weight").alias("w")).collect())
    out: dict[int, dict[int, int]] = {leaf: {} for leaf in looks}
    for row in counted:
        out[row.leaf][row.bin] = row.w
    return out


def _pick(bins: dict[int, int], below: float, goal: float) -> tuple[int, float, float]:
    """The bin that holds the goal, the bytes below it and those in it."""
    for b in sorted(bins):
        if below + bins[b] >= goal:
            return b, below, bins[b]
        below += bins[b]
    return BINS, below, 0


def build(units: DataFrame, shards: int) -> Node:
    """The tree for units with a place in each dimension and a ``weight``.

    The driver holds the tree and at most BINS counts a leaf and dimension,
    whatever the rows.
    """
    root = Node(0, shards)
    while open_ := [x for x in _leaves(root) if x.n > 1]:
        rows = units.withColumn("leaf", place(root))
        first = _all_bins(rows)
        state: dict[int, tuple[str, float, float, float, float, float]] = {}
        for x in open_:
            held = first.get(x.first)
            if held is None:  # no units: any cut will do
                x.split(DIMENSIONS[0], 0.0)
                continue
            widest = max(DIMENSIONS, key=lambda d: max(held[d]) - min(held[d]))
            weight = sum(held[widest].values())
            goal = weight * (x.n // 2) / x.n
            b, below, w = _pick(held[widest], 0.0, goal)
            state[x.first] = (widest, b / BINS, 1.0 / BINS, goal, below, w)
        for _ in range(LOOKS - 1):
            near = {x.first: state[x.first] for x in open_ if x.first in state
                    and state[x.first][5] > SLACK / 4 * state[x.first][3] / max(1, x.n // 2)}
            if not near:
                break
            found = _near_bins(rows, {k: (d, lo, width) for k, (d, lo, width, *_) in near.items()})
            for k, (d, lo, width, goal, below, _) in near.items():
                b, below, w = _pick(found[k], below, goal)
                state[k] = (d, lo + b * (width / BINS), width / BINS, goal, below, w)
        for x in open_:
            if x.first in state:
                d, lo, width, goal, below, w = state[x.first]
                x.split(d, lo + width if below + w - goal < goal - below else lo)
    return root


def _axis(col: Column) -> Column:
    """A place in [0, 1) for a name; missing names share one."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(col, F.lit(""))), 11) / float(1 << 53)


def shard(docs: DataFrame, shards: int = 24, text: str = "text", doc_id: str = "doc_id",
          lang: str = "lang", source: str = "source") -> DataFrame:
    """``docs`` with ``size``, ``text_crc32``, ``shard`` and ``slot`` (gapless in a shard).

    ``size`` is the UTF-8 bytes of the text plus 8; a missing text has none and
    crc32 0, like an empty one.  Shards come out near equal in size: a cut
    misses its goal by at most about a fiftieth of a shard.  Equal texts stay
    together unless they outweigh that.  Repeated rows are rows; an empty table
    gives an empty result; columns of the results' names are replaced.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    whole = F.coalesce(F.col(text), F.lit(""))
    rest = docs.drop("size", "text_crc32", "shard", "slot")
    p = spare(rest)
    group, crc, piece = f"{p}group", "text_crc32", f"{p}piece"
    base = (rest.withColumn("size", (F.octet_length(whole) + ROW_BYTES).cast("long"))
            .withColumn(crc, F.crc32(whole.cast("binary")))
            .withColumn(group, F.xxhash64(whole, F.lit(1)))
            .withColumn(piece, F.shiftrightunsigned(mixed(doc_id), 33)))
    slim = stage(base.select(group, piece, "size", crc,
                             _axis(F.col(lang)).alias("lang"), _axis(F.col(source)).alias("source")), "slim")
    total = slim.agg(F.sum("size")).first()[0] or 0
    most = max(1.0, SLACK * total / shards)
    # heavy groups are cut into so many pieces that one weighs no more than ``most``
    heavy = (slim.groupBy(group, crc).agg(F.sum("size").alias("w")).where(F.col("w") > most)
             .select(F.col(group).alias(f"{p}hg"), F.col(crc).alias(f"{p}hc"), F.ceil(F.col("w") / most * 2).alias(f"{p}pieces")))
    heavy = stage(heavy, "heavy")

    def pieced(rows: DataFrame) -> DataFrame:
        return (rows.join(heavy, (F.col(group) == F.col(f"{p}hg")) & (F.col(crc) == F.col(f"{p}hc")), "left")
                .withColumn(piece, F.coalesce(F.col(piece) % F.col(f"{p}pieces"), F.lit(0)))
                .drop(f"{p}hg", f"{p}hc", f"{p}pieces"))

    units = (pieced(slim).groupBy(group, crc, piece)
             .agg(F.sum("size").alias("weight"), (F.log(F.min("size")) / 40.0).alias("size"),
                  F.min("lang").alias("lang"), F.min("source").alias("source")))
    tie = F.shiftrightunsigned(mixed(group, piece), 32) / float(1 << 32)
    units = stage(units.select(group, crc, piece, "weight",
                               *[((F.floor(F.col(d) * LEVELS) + tie) / LEVELS).alias(f"k_{d}")
                                 for d in ("size", "lang", "source")]), "units")
    placed = stage(units.select(F.col(group).alias(f"{p}g"), F.col(crc).alias(f"{p}c"), F.col(piece).alias(f"{p}p"),
                                place(build(units, shards)).alias("shard")), "placed")
    same = (F.col(group) == F.col(f"{p}g")) & (F.col(crc) == F.col(f"{p}c")) & (F.col(piece) == F.col(f"{p}p"))
    out = pieced(base).join(placed, same).drop(group, piece, f"{p}g", f"{p}c", f"{p}p")
    return ranked(out, ["shard"], [doc_id])
