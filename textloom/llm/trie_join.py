"""N-gram Jaccard self-join (prefix-tree join).

A document's set is its distinct five-word shingles. Documents with equal sets are one node. All shingles have one global order,
rare before common. Two sets of similarity 0.8 or more share a shingle among their rarest fifth plus one, so the nodes of a
shingle's posting list, where lengths and positions allow the similarity, are candidates of one another. A sketch of 256 bins
bounds the overlap of two sets from above before whole sets are moved.

Candidates are gathered into groups without a list of all pairs: each shingle's members are first held against one centre; the
shingles whose members are then still in different groups are split into cells of two blocks of bounded size, in bands of
length, and a cell gives no more than the pairs that join its groups. A group holds every link of its members.

The whole sets of the groups are then dealt to prefix trees: small groups many to a tree, large ones in cells of two blocks.
Each tree is walked once with all its probes (`prefix_tree`): what a probe has in common with a path is counted once for all
sets below it, and a subtree is left when too little can follow. This finds every link, adds it to the number of links of both
sides, and gives the pairs that make up the components. Copies of a text are never expanded.

Defined cases: null, empty or blank texts have no shingles, link with nothing and are components of their own; with fewer than
five words the whole sequence is the one shingle; repeated rows and equal texts share a component and are links of one another;
a row with a null doc_id takes part, its component is named by the smallest doc_id that is not null (null if there is none);
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import Scratch, materialize, prepare, row_shingles, string_columns, text_bytes, word_hashes
from .components import connected_components
from .prefix_tree import Limits, Sets, join_sets

NO_ID = -(1 << 63)


@dataclass(frozen=True)
class JoinOptions:
    common_shingles: int = 1 << 18  # how many of the commonest are put last in the order; the rest go by hash
    least_common: int = 4
    sample: int = 256  # one set in so many reports all its shingles, so that one spread thinly over the tasks is counted too
    members_per_block: int = 512  # of one shingle and band of length, where a cell compares two blocks
    shingles_per_tree: int = 1 << 18  # of small groups that share a tree
    sets_per_block: int = 4096  # of one large group, where trees compare two blocks: as many times as blocks a set is moved
    shingles_per_block: int = 1 << 21  # 16 MB
    broadcast_pairs: int = 200_000  # five numbers each, some 10 MB
    filter_bits: int = 1 << 27  # at most; marks the documents whose sets are wanted, before the exact join
    limits: Limits = Limits()


def _node(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int | None, np.ndarray]]:
    words, first, _, _ = word_hashes(*text_bytes(batch.column(1)))
    yield from zip(batch.column(0).to_pylist(), row_shingles(words, first), strict=True)


BINS = 256


def sketch(shingles: np.ndarray) -> bytes:
    """How many shingles fall into each of 256 bins, 255 at most: the smaller counts bound the overlap of two sets."""
    return np.minimum(np.bincount((shingles & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS), 255).astype(np.uint8).tobytes()


def _may_reach(least: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the smaller bins of two sketches (last axis) allow the overlap that two sets of these sizes together need.

    A full bin says nothing: 255 may be any number, so a pair where both have one stays.
    """
    return (9 * least.sum(axis=-1, dtype=np.int64) >= 4 * sizes) | (least == 255).any(axis=-1)


_READ = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("times", pa.int64()), ("sketch", pa.binary())])


def _packed(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _sets_and_common(docs: DataFrame, o: JoinOptions) -> DataFrame:
    """Rows (doc_id, n, node, times, sketch): one for each document (times 0; the sketch where its task first sees the set), and
    shingles as node: those that recur within a task (n -1) and all of a sample of the sets (n -2), with their times."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        sampled: list[np.ndarray] = []
        size = 0

        def counted() -> list[tuple]:
            out = []
            for kind, sets, least in ((-1, held, 2), (-2, sampled, 1)):
                values, times = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, int))
                again = times >= least
                out += [(None, kind, h, t, None) for h, t in zip(values[again].view(np.int64).tolist(), times[again].tolist(), strict=True)]
            return out

        for batch in batches:
            rows = []
            for doc, shingles in _rows(batch):
                node = _node(shingles)
                fresh = node not in seen and len(shingles) > 0
                rows.append((doc, len(shingles), node, 0, sketch(shingles) if fresh else None))
                if fresh:
                    seen.add(node)
                    held.append(shingles)
                    size += len(shingles)
                    if node % o.sample == 0:
                        sampled.append(shingles)
            if size > 1_000_000:
                rows += counted()
                held, sampled, size = [], [], 0
                seen.clear()
            if rows:
                yield _packed(rows, _READ)
        if rest := counted():
            yield _packed(rest, _READ)

    return docs.mapInArrow(read, "doc_id long, n long, node long, times long, sketch binary")


class _Order:
    """The global order: shingles that are not common by hash, then the common ones, the commonest last."""

    def __init__(self, common: np.ndarray):
        """common: hashes, the least common first."""
        at = np.argsort(common)
        self.hashes, self.ranks = common[at], at.astype(np.int64)

    def is_common(self, shingles: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(shingles), bool)
        at = np.minimum(np.searchsorted(self.hashes, shingles), len(self.hashes) - 1)
        return self.hashes[at] == shingles

    def arrange(self, shingles: np.ndarray) -> np.ndarray:
        """Rare first; `shingles` are sorted by hash already."""
        if not len(self.hashes):
            return shingles
        at = np.minimum(np.searchsorted(self.hashes, shingles), len(self.hashes) - 1)
        common = self.hashes[at] == shingles
        late = shingles[common][np.argsort(self.ranks[at[common]], kind="stable")]
        return np.concatenate([shingles[~common], late])


def _postings(docs: DataFrame, order) -> DataFrame:
    """(token, node, n, pos, common): the rarest fifth plus one of each set; a set that a task has seen is not repeated."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            tokens, nodes, sizes = [], [], []
            for _, shingles in _rows(batch):
                node = _node(shingles)
                if not len(shingles) or node in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(node)
                tokens.append(order.value.arrange(shingles)[: len(shingles) // 5 + 1])
                nodes.append(node)
                sizes.append(len(shingles))
            if tokens:
                lens = [len(t) for t in tokens]
                columns = [np.concatenate(tokens).view(np.int64), np.repeat(np.array(nodes, np.int64), lens), np.repeat(np.array(sizes, np.int32), lens), np.concatenate([np.arange(k, dtype=np.int32) for k in lens]), order.value.is_common(np.concatenate(tokens))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "node", "n", "pos", "common"])

    return docs.mapInArrow(read, "token long, node long, n int, pos int, common boolean")


def _may_overlap(pairs: DataFrame, sketches: DataFrame, o: JoinOptions) -> DataFrame:
    """The pairs (centre, node) whose sketches allow the overlap that they need; a few hundred bytes stand for each set."""
    mine = sketches.select(F.col("node").alias("centre"), F.col("n").alias("n1"), F.col("sketch").alias("s1"))
    first = mine.join(F.broadcast(pairs) if pairs.count() <= o.broadcast_pairs else pairs, "centre")
    both = first.join(sketches, "node").select("centre", "node", "n1", "n", "s1", "sketch")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                a, b = (np.frombuffer(b"".join(x.as_py() for x in batch.column(i)), np.uint8).reshape(n, BINS) for i in (4, 5))
                keep = _may_reach(np.minimum(a, b), np.array(batch.column(2)).astype(np.int64) + np.array(batch.column(3)))
                yield batch.select(["centre", "node"]).filter(pa.array(keep))

    return both.mapInArrow(bound, "centre long, node long").distinct()


def _may_link(n1, p1, n2, p2) -> F.Column:
    """Whether two sets that share a shingle at these places of the order, and none before, can be alike enough."""
    reach = 9 * (1 + F.least(n1 - p1 - 1, n2 - p2 - 1)) >= 4 * (n1 + n2)
    return reach & (10 * F.least(n1, n2) >= 8 * F.greatest(n1, n2))


def _stars(dealt: DataFrame, sketches: DataFrame, o: JoinOptions, scratch: Scratch) -> DataFrame:
    """Likely pairs (a, b) of each shingle's centre with its members: the one with the fewest rarer shingles is the centre, as it
    is the nearest to what its copies share."""
    me, choice = F.struct("node", "n", "pos"), F.struct("pos", F.xxhash64("node"))
    centres = dealt.groupBy("token").agg(F.min_by(me, choice).alias("c"))
    pairs = dealt.join(centres, "token").where(F.col("node") != F.col("c.node")).where(_may_link(F.col("n"), F.col("pos"), F.col("c.n"), F.col("c.pos")))
    pairs = scratch.write(pairs.select(F.least("c.node", "node").alias("centre"), F.greatest("c.node", "node").alias("node")).distinct(), "pairs")
    likely = scratch.write(_may_overlap(pairs, sketches, o), "likely")
    return likely.select(F.col("centre").alias("a"), F.col("node").alias("b"))


BAND = float(np.log(1.26))  # sets of similarity 0.8 differ in length by a factor of 1.25 at most: by one band


def _cells(dealt: DataFrame, labels: DataFrame, sketches: DataFrame, o: JoinOptions, scratch: Scratch) -> DataFrame:
    """Likely pairs (a, b) that join the groups (node, label) which have a shingle in common."""
    now = dealt.join(labels, "node", "left").withColumn("part", F.coalesce("label", "node")).drop("label")
    divided = now.groupBy("token").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x <> y").select("token")
    now = now.join(divided, "token").withColumn("band", F.floor(F.log("n") / BAND).cast("int"))
    now = scratch.write(now, "divided")
    blocks = now.groupBy("token", "band").agg(F.ceil(F.count("*") / o.members_per_block).alias("k"))
    above = blocks.select("token", (F.col("band") - 1).alias("band"), F.col("k").alias("up"))
    below = blocks.select("token", (F.col("band") + 1).alias("band"), F.col("k").alias("down"))
    sizes = blocks.join(above, ["token", "band"], "left").join(below, ["token", "band"], "left")
    own = F.pmod(F.xxhash64("node"), F.col("k"))
    # A block meets itself, the later and earlier blocks of its band, and all blocks of the bands beside it.
    every = lambda k: F.when(k > 0, F.sequence(F.lit(0).cast("long"), k - 1)).otherwise(F.array().cast("array<long>"))
    cell = lambda band, next_, i, j: F.struct(band.alias("band"), F.lit(next_).alias("next"), i.alias("i"), j.alias("j"))
    band, none = F.col("band"), F.lit(0).cast("long")
    places = lambda own: F.concat(
        F.transform(every(F.col("k")), lambda j: cell(band, 0, F.least(own, j), F.greatest(own, j))),
        F.transform(every(F.coalesce("up", none)), lambda j: cell(band, 1, own, j)),
        F.transform(every(F.coalesce("down", none)), lambda i: cell(band - 1, 1, i, own)),
    )
    # Which cells join anything is told by the groups of their two blocks alone: a row for each block, not for each member, is dealt
    # to the cells. Cells of one group have nothing to join; most are such once the stars have been seen.
    now = now.join(sizes, ["token", "band"]).withColumn("own", own)
    sides = now.groupBy("token", "band", "own", "k", "up", "down").agg(F.min("part").alias("x"), F.max("part").alias("y"))
    places_of = sides.select("token", "x", "y", F.explode(places(F.col("own"))).alias("c")).select("token", "c.band", "c.next", "c.i", "c.j", "x", "y")
    key = ["token", "cell_band", "next", "i", "j"]
    live = places_of.withColumnRenamed("band", "cell_band").groupBy(*key).agg(F.min("x").alias("x"), F.max("y").alias("y")).where("x <> y").select(*key)
    # A cell's members are those of its first block and, where it is another, of its second.
    first = F.struct(F.lit(0).alias("side"), F.col("cell_band").alias("band"), F.col("i").alias("own"))
    second = F.struct(F.lit(1).alias("side"), (F.col("cell_band") + F.col("next")).alias("band"), F.col("j").alias("own"))
    both = F.when((F.col("next") == 0) & (F.col("i") == F.col("j")), F.array(first)).otherwise(F.array(first, second))
    rows = now.select("token", "band", "own", "node", "n", "pos", "part").join(live.select(*key, F.inline(both)), ["token", "band", "own"])
    rows = rows.join(sketches.select("node", "sketch"), "node").select(*key, "side", "node", "n", "pos", "part", "sketch")
    rows = rows.repartition(*key).sortWithinPartitions(*key)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple[int, int]] = []
        for cell_key, group in groupby(_stream(batches), key=lambda r: r[:5]):
            group = list(group)
            side, node, n, pos, part = (np.array([r[k] for r in group], np.int64) for k in range(5, 10))
            bins = np.frombuffer(b"".join(r[10] for r in group), np.uint8).reshape(len(group), BINS)
            left = np.flatnonzero(side == 0)
            right = left if cell_key[2] == 0 and cell_key[3] == cell_key[4] else np.flatnonzero(side == 1)
            label = part.copy()
            for x in left.tolist():
                ys = right[label[right] != label[x]]
                low, high = np.minimum(n[ys], n[x]), np.maximum(n[ys], n[x])
                ys = ys[(9 * (1 + np.minimum(n[x] - pos[x] - 1, n[ys] - pos[ys] - 1)) >= 4 * (n[x] + n[ys])) & (10 * low >= 8 * high)]
                if len(ys):
                    ys = ys[_may_reach(np.minimum(bins[ys], bins[x]), n[ys] + n[x])]
                    labels, first = np.unique(label[ys], return_index=True)
                    made += [(int(node[x]), int(node[ys[k]])) for k in first]
                    label[np.isin(label, labels)] = label[x]
            if len(made) > 10_000:
                yield _packed(made, _EDGE)
                made = []
        if made:
            yield _packed(made, _EDGE)

    return rows.mapInArrow(compare, "a long, b long")


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _whole_sets(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """(node, low, shingles): sets of the documents whose id is marked in `bits`."""
    marked = docs.sparkSession.sparkContext.broadcast(bits)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.array(batch.column(0).fill_null(NO_ID))
            at = ids % (8 * len(marked.value))
            batch = batch.filter(pa.array((marked.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0))
            rows = [(_node(s), NO_ID if doc is None else doc, s.tobytes()) for doc, s in _rows(batch) if len(s)]
            if rows:
                yield _packed(rows, pa.schema([("node", pa.int64()), ("low", pa.int64()), ("shingles", pa.binary())]))

    return docs.mapInArrow(read, "node long, low long, shingles binary")


def _marked(lows: DataFrame, o: JoinOptions) -> np.ndarray:
    """A bounded filter of the ids `low`, eight to a byte: 16 bits for each id, as far as `filter_bits` allows."""
    size = min(o.filter_bits, max(1 << 16, 1 << (16 * lows.count()).bit_length()))
    place = F.pmod(F.col("low"), F.lit(size)) + 1  # bits of a bucket stand for values from 1
    buckets = lows.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    bits = np.zeros(size // 8, np.uint8)
    for r in buckets.collect():  # `filter_bits` in all
        bits[(r.k - 1) * 4096 : r.k * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return bits


_FOUND = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])


def _trees(docs: DataFrame, groups: DataFrame, o: JoinOptions, scratch: Scratch) -> DataFrame:
    """From groups (node, label, low, n, copies): (node, links, null) sums to add up, and (node, null, other) links that join components."""
    sizes = groups.groupBy("label").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("sets") / o.sets_per_block), F.ceil(F.col("shingles") / o.shingles_per_block))
    sizes = scratch.write(sizes.withColumn("k", blocks), "sizes")
    small = sizes.where("k = 1").agg(F.coalesce(F.sum("shingles"), F.lit(0)).alias("s")).collect()[0].s
    trees = 1 + small // o.shingles_per_tree
    own = F.pmod(F.xxhash64("node"), F.col("k"))
    later = F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.col("k") - 1), lambda j: j >= own), lambda j: F.struct(own.alias("i"), j.alias("j"), F.lit(0).alias("side")))
    earlier = F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.col("k") - 1), lambda i: i < own), lambda i: F.struct(i.alias("i"), own.alias("j"), F.lit(1).alias("side")))
    named = groups.join(sizes.select("label", "k"), "label").withColumn("place", F.explode(F.concat(later, earlier)))
    tree = F.when(F.col("k") > 1, F.col("label")).otherwise(F.pmod(F.xxhash64("label"), F.lit(trees)))
    wanted = scratch.write(named.select("node", "low", "copies", (F.col("k") > 1).alias("large"), tree.alias("tree"), "place.*"), "wanted")
    # Places are few next to sets: where their number is small enough, they go to the sets rather than the sets to them.
    near = F.broadcast(wanted) if wanted.count() <= o.broadcast_pairs else wanted
    key = ["large", "tree", "i", "j"]
    rows = _whole_sets(docs, _marked(groups.select("low").distinct(), o)).join(near, ["node", "low"]).select(*key, "side", "node", "copies", "shingles")
    # Neighbours in the order of nodes are copies of one row: all but one are left out.
    rows = rows.repartition(*key).sortWithinPartitions(*key, "side", "node")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, group in groupby(_stream(batches), key=lambda r: r[:4]):
            nodes: list[list[int]] = [[], []]
            copies: list[list[int]] = [[], []]
            sets: list[list[np.ndarray]] = [[], []]
            for *_, side, node, count, shingles in group:
                if not nodes[side] or nodes[side][-1] != node:
                    nodes[side].append(node)
                    copies[side].append(count)
                    sets[side].append(np.frombuffer(shingles, np.uint64))
            sides = [Sets(s, c) for s, c in zip(sets, copies, strict=True)]
            # The small groups of a tree, and a block with itself, are joined within; two blocks of a large group with each other.
            within = cell[2] == cell[3]
            forest = join_sets(sides[0], None if within else sides[1], o.limits)
            names = nodes[0] + nodes[1]
            rows = [(v, k, None) for v, k in zip(names, np.concatenate([s.links for s in sides]).tolist(), strict=True) if k]
            rows += [(names[a], None, names[b]) for a, b in forest]
            if rows:
                yield _packed(rows, _FOUND)

    return rows.mapInArrow(walk, "node long, links long, other long")


def _postings_that_matter(docs: DataFrame, order) -> DataFrame:
    """(token, node, n, pos) of shingles that two sets have among their rarest and that their lengths allow to be alike."""
    # Postings are dealt by shingle once, in order of length. Those are dropped that cannot be half of a candidate pair: shingles
    # of one set only, members whose neighbours in length are too short and too long, and pairs that fail the exact bound.
    # A common shingle may belong to a large part of all sets: it is shared for certain, stays, and is spread by salt.
    alike = Window.partitionBy("token", "salt")
    ranked = alike.orderBy("n", "node")
    salt = F.when(F.col("common"), F.pmod("node", F.lit(1024))).otherwise(-1)
    dealt = _postings(docs, order).withColumn("salt", salt).withColumns(
        {
            "shared": F.min("node").over(alike) != F.max("node").over(alike),
            "two": (F.count("*").over(alike) == 2) & (9 * F.min(F.col("n") - F.col("pos")).over(alike) < 4 * F.sum("n").over(alike)),
            "shorter": F.lag("n").over(ranked),
            "longer": F.lead("n").over(ranked),
        }
    )
    longest = 5 * F.col("n") - 9 * F.col("pos")  # four times the longest partner
    near = (10 * F.col("shorter") >= 8 * F.col("n")) | (4 * F.col("longer") <= longest)
    kept = dealt.where(F.col("common") | (F.col("shared") & ~F.col("two") & F.coalesce(near, F.lit(False))))
    return kept.select("token", "node", "n", "pos").distinct()


def _order(read: DataFrame, o: JoinOptions) -> _Order:
    """The commonest shingles by the larger of what tasks have counted and what the sample says."""
    counts = read.where("times > 0").groupBy("node").agg(F.coalesce(F.sum(F.when(F.col("n") == -1, F.col("times"))), F.lit(0)).alias("t"), F.coalesce(F.sum(F.when(F.col("n") == -2, F.col("times"))), F.lit(0)).alias("s"))
    common = counts.where((F.col("t") >= o.least_common) | (F.col("s") >= o.least_common))
    common = common.select("node", F.greatest(F.col("t"), F.when(F.col("s") >= o.least_common, F.col("s") * o.sample).otherwise(0)).alias("t"))
    top = common.orderBy(F.desc("t"), "node").limit(o.common_shingles).toPandas()  # bounded
    return _Order(top.sort_values(["t", "node"])["node"].to_numpy(np.int64).view(np.uint64))


def jaccard_components(docs: DataFrame, options: JoinOptions = JoinOptions()) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links, node) of every row of (doc_id, text).

    n_links: with how many other rows it is alike enough. Rows of equal sets share a `node`.
    """
    o, spark = options, prepare(docs.sparkSession)
    docs = string_columns(docs, "doc_id", "text")
    scratch = Scratch(spark)
    read = scratch.write(_sets_and_common(docs, o), "sets")
    rows = read.where("times = 0").select("doc_id", "n", "node")
    order = spark.sparkContext.broadcast(_order(read, o))
    dealt = scratch.write(_postings_that_matter(docs, order), "postings")
    lows = rows.where("n > 0").groupBy("node").agg(F.coalesce(F.min("doc_id"), F.lit(NO_ID)).alias("low"), F.first("n").alias("n"), F.count("*").alias("copies"))
    lows = scratch.write(lows, "lows")
    found, labels = None, None
    if not dealt.isEmpty():
        members = dealt.select("node").distinct()
        sketches = read.where("sketch IS NOT NULL").select("node", "n", "sketch").join(members, "node").groupBy("node", "n").agg(F.first("sketch").alias("sketch"))
        sketches = scratch.write(sketches, "sketches")
        pairs = _stars(dealt, sketches, o, scratch)
        groups = connected_components(pairs, scratch)
        more = scratch.write(_cells(dealt, groups, sketches, o, scratch), "cells")
        if not more.isEmpty():
            groups = connected_components(pairs.unionByName(more), scratch)
        groups = scratch.write(groups.join(lows, "node"), "groups")
        found = scratch.write(_trees(docs, groups, o, scratch), "found")
        labels = connected_components(found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")), scratch)
    # Sets are named first and rows after: a set that very many rows share is one row until the last join.
    named = lows.withColumns({"label": F.col("node"), "others": F.lit(0).cast("long")})
    if found is not None:
        links = found.where("links IS NOT NULL").groupBy("node").agg(F.sum("links").alias("others"))
        named = lows.join(labels, "node", "left").join(links, "node", "left").withColumns({"label": F.coalesce("label", "node"), "others": F.coalesce("others", F.lit(0))})
    least = named.groupBy("label").agg(F.min(F.nullif("low", F.lit(NO_ID))).alias("component_id"))
    named = named.join(least, "label").select("node", "component_id", (F.col("copies") - 1 + F.col("others")).alias("n_links"))
    named = scratch.write(named, "named")
    scratch.clear(read, named)
    whole = rows.join(named, "node", "left")
    has = F.col("n") > 0
    return whole.select("doc_id", F.col("n").alias("n_shingles"), F.when(has, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(has, F.col("n_links")).otherwise(F.lit(0)).alias("n_links"), "node")


def keep_one(docs: DataFrame, options: JoinOptions = JoinOptions()) -> DataFrame:
    """`docs`, all columns, with one row of each component: that of its smallest doc_id.

    Rows without shingles link with nothing and all stay. Where a doc_id is repeated or null, one of the rows that have the
    component's set is kept.
    """
    found = materialize(jaccard_components(docs, options).where("n_shingles > 0"), "components")
    counts = found.groupBy("doc_id").agg(F.count("*").alias("k"), F.first("component_id").alias("component_id"))
    # Plain ids: one row each, so that the id alone decides. Only the ids that go are joined, without the texts of a group.
    gone = materialize(counts.where("k = 1 AND doc_id <> component_id").select(F.col("doc_id").alias("gone_id")), "gone")
    odd = materialize(counts.where("k > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("odd_id")), "odd")
    if odd.isEmpty():
        return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
    plain = docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti").join(odd, docs["doc_id"].eqNullSafe(odd["odd_id"]), "left_anti")
    kept = found.groupBy(F.coalesce("component_id", "node").alias("group"), F.col("component_id").isNull().alias("nameless"))
    kept = kept.agg(F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)), "node")).alias("m")).select(F.col("m.col1").alias("keep_id"), F.col("m.node").alias("keep_node"))
    rest = docs.join(odd, docs["doc_id"].eqNullSafe(odd["odd_id"]), "left_semi")
    noted = rest.mapInArrow(_with_node(rest.columns), StructType([*rest.schema.fields, StructField("_node", LongType()), StructField("_size", LongType())]))
    first = Window.partitionBy("doc_id", "_node").orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in rest.columns]))
    noted = noted.withColumn("_r", F.when(F.col("_size") == 0, 1).otherwise(F.row_number().over(first))).where("_r = 1")
    match = (F.coalesce("doc_id", F.lit((1 << 63) - 1)) == F.col("keep_id")) & (F.col("_node") == F.col("keep_node"))
    single = noted.where("_size > 0").join(kept, match, "left_semi").unionByName(noted.where("_size = 0"))
    return plain.unionByName(single.select(*[F.col(f"`{c}`") for c in docs.columns]))


def _with_node(names: list[str]):
    at, text = names.index("doc_id"), names.index("text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = pa.RecordBatch.from_arrays([batch.column(at), batch.column(text)], names=["doc_id", "text"])
            sets = [s for _, s in _rows(pairs)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([_node(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())], names=[*names, "_node", "_size"])

    return read
