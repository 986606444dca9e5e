"""Merkle manifest of a dataset (DuckDB block engine).

Every row is a leaf. The leaves of a group (a source) ascend by their key and are dealt, by rank, into aligned buckets of
`fanout ** levels`; an aligned bucket is a whole subtree, so it can be hashed alone. Tasks take whole buckets as Arrow tables and
run one ordered `string_agg` plus `sha256` query of DuckDB for each level, over all buckets of the table at once. The bucket
roots are the leaves of the next pass, until each group has one node; the groups' roots, in the groups' order, go through the
same passes to the root. What lies to the left and to the right of a node at each level is its outer proof; it joins the rows of
its bucket, which then work out each leaf's proof and fold what is handed over for checking back to the root.

Ranks come from a range partitioning with counts by partition, so that a group of any size is spread over tasks; texts are
hashed where they are read, and only digests are shuffled. The driver sees the number of nodes of the largest group, no more.

Defined cases: a null column is hashed as `-` and an empty text as `0:`; a null group is a group of its own, the first; rows of
one key (null keys come first) stand in the order of their leaves, so equal rows are leaves of their own with their own proofs;
a single leaf is its group's root, a single group's root the root, both with an empty proof; an empty table gives no rows; extra
columns are ignored; texts of any length are hashed whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, prepare, string_columns


@dataclass(frozen=True)
class MerkleOptions:
    columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")
    group: str = "source"
    key: str = "doc_id"
    fanout: int = 3
    levels: int = 8  # of a bucket: 6,561 leaves
    rows_per_table: int = 20_000  # leaves that a task hands to DuckDB at once, and one bucket more


def leaf_digest(columns: list[Column]) -> Column:
    """sha256 of all values: `-` for null, else the number of bytes, a colon and the value."""
    value = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*[value(c) for c in columns]), 256)


def group_key(group: Column) -> Column:
    """A text that orders groups bytewise with the null group first, and that null-safe joins can use."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


# --- places of leaves --------------------------------------------------------------------------------------------------


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of each run of equal `gkey` in a sorted partition; `part` names the partition."""
    from pyspark import TaskContext

    part, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        at = 0
        runs = pc.run_end_encode(batch.column("gkey"))
        numbers = []
        for key, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
            seen = seen if key == last else 0
            numbers.extend(range(seen, seen + end - at))
            seen, last, at = seen + end - at, key, end
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), pa.array(numbers, pa.int64())], names=[*batch.schema.names, "part", "at"])


def _placed(leaves: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """Add `pos`, the rank of a row in its group, and `n`, the group's size; no group meets in one task."""
    dealt = leaves.repartitionByRange("gkey", *order).sortWithinPartitions("gkey", *order)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in leaves.schema.fields)
    dealt = scratch.write(dealt.mapInArrow(_numbered, f"{schema}, part int, at long"), "leaves")
    counts = dealt.groupBy("gkey", "part").agg(F.count("*").alias("k"))
    before = Window.partitionBy("gkey").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("gkey", "part", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("base"), F.sum("k").over(Window.partitionBy("gkey")).alias("n"))
    base = scratch.write(base, "ranks")
    return dealt.join(base, ["gkey", "part"]).withColumn("pos", F.col("base") + F.col("at")).drop("part", "at", "base")


# --- buckets in DuckDB -------------------------------------------------------------------------------------------------


class _Tree:
    """The levels of all buckets of one Arrow table as tables n0, n1, ...: `pos` counts within a bucket, `lev` says how far it climbs."""

    def __init__(self, table: pa.Table, fanout: int):
        import duckdb

        self.fanout, self.db = fanout, duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "512MB"})
        self.db.register("given", table)
        self.db.execute("CREATE TABLE n0 AS SELECT gkey, bucket, lev, pos, h FROM given WHERE h IS NOT NULL")
        self.top = self.db.execute("SELECT coalesce(max(lev), 0) FROM n0").fetchall()[0][0]
        for i in range(self.top):
            self.db.execute(
                f"CREATE TABLE n{i + 1} AS SELECT gkey, bucket, lev, pos // {fanout} AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h "
                f"FROM n{i} WHERE lev > {i} GROUP BY gkey, bucket, lev, pos // {fanout}"
            )

    def _rows(self, sql: str) -> list[pa.RecordBatch]:
        made = self.db.sql(sql).to_arrow_table().to_batches()
        self.db.close()
        return made

    def roots(self) -> list[pa.RecordBatch]:
        """(gkey, pos, h): a root for each bucket."""
        return self._rows(" UNION ALL ".join(f"SELECT gkey, bucket AS pos, h FROM n{i} WHERE lev = {i}" for i in range(self.top + 1)))

    def paths(self, columns: str) -> list[pa.RecordBatch]:
        """The given columns of each node, and what stands left and right of its path (ls, rs), from its own level up."""
        run = f"PARTITION BY gkey, bucket, pos // {self.fanout} ORDER BY pos ROWS BETWEEN"
        for i in range(self.top):
            self.db.execute(
                f"CREATE TABLE s{i} AS SELECT gkey, bucket, pos, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, "
                f"coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM n{i} WHERE lev > {i}"
            )
        met = "".join(f" LEFT JOIN s{i} ON s{i}.gkey = g.gkey AND s{i}.bucket = g.bucket AND s{i}.pos = g.pos // {self.fanout**i} AND g.lev > {i}" for i in range(self.top))
        inner = [f"list_filter([{', '.join(f's{i}.{side}' for i in range(self.top))}]::VARCHAR[], lambda x: x IS NOT NULL)" for side in "lr"]
        lists = ", ".join(f"list_concat({own}, coalesce(o.{c}, [])) AS {c}" for own, c in zip(inner, ("ls", "rs"), strict=True))
        leaves = "(SELECT * FROM given WHERE h IS NOT NULL) g"
        above = "(SELECT gkey, bucket, ls, rs FROM given WHERE h IS NULL) o"
        return self._rows(f"SELECT {columns}, {lists} FROM {leaves}{met} LEFT JOIN {above} ON o.gkey = g.gkey AND o.bucket = g.bucket")


def _whole_buckets(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of whole buckets out of batches that are sorted by bucket: at least `rows` rows in each but the last."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < rows:
            continue
        table = pa.Table.from_batches(held)
        same = [pc.equal(table.column(c), table.column(c)[-1]) for c in ("gkey", "bucket")]
        unfinished = pc.sum(pc.and_(*same)).as_py()  # the last bucket may go on in the next batch
        if unfinished < size:
            yield table.slice(0, size - unfinished)
            held, size = table.slice(size - unfinished).to_batches(), unfinished
    if held:
        yield pa.Table.from_batches(held)


def _bucketed(nodes: DataFrame, o: MerkleOptions) -> DataFrame:
    """Nodes (gkey, pos, n, ...) with `bucket`, the place in it as `pos`, and `lev`: every level where more buckets follow, else up to one node."""
    width = o.fanout**o.levels
    climb = F.lit(o.levels)
    for i in reversed(range(o.levels)):
        climb = F.when(F.col("n") <= o.fanout**i, i).otherwise(climb)
    return nodes.select(
        *[c for c in nodes.columns if c not in ("pos", "n")], climb.cast("int").alias("lev"), F.expr(f"pos div {width}").alias("bucket"), F.expr(f"pos % {width}").alias("pos")
    )


def _dealt(rows: DataFrame) -> DataFrame:
    """Whole buckets in one partition, in order; a fixed number of partitions, so that none is cut or put together later."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "gkey", "bucket").sortWithinPartitions("gkey", "bucket", "pos")


def _bucket_roots(nodes: DataFrame, o: MerkleOptions) -> DataFrame:
    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_buckets(batches, o.rows_per_table):
            yield from _Tree(table, o.fanout).roots()

    return _dealt(nodes.select("gkey", "bucket", "lev", "pos", "h")).mapInArrow(climb, "gkey string, pos long, h string")


def _paths(nodes: DataFrame, above: DataFrame | None, columns: str, schema: str, o: MerkleOptions) -> DataFrame:
    """The columns (g.name AS name, ...) of bucketed nodes with ls, rs: what lies left and right, level by level, up to the end of `above`.

    `above` gives the same of the buckets (gkey, pos, ls, rs). Its rows join those of their bucket in the same partition.
    """
    rows = nodes.withColumns({c: F.lit(None).cast("array<string>") for c in ("ls", "rs")})
    if above is not None:
        over = above.select("gkey", F.col("pos").alias("bucket"), F.lit(-1).cast("long").alias("pos"), "ls", "rs")
        rows = rows.unionByName(over, allowMissingColumns=True)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_buckets(batches, o.rows_per_table):
            yield from _Tree(table, o.fanout).paths(columns)

    return _dealt(rows).mapInArrow(walk, f"{schema}, ls array<string>, rs array<string>")


def _node_paths(nodes: DataFrame, above: DataFrame | None, o: MerkleOptions) -> DataFrame:
    place = f"g.gkey, g.bucket * {o.fanout**o.levels} + g.pos AS pos"
    return _paths(nodes.select("gkey", "bucket", "lev", "pos", "h"), above, place, "gkey string, pos long", o)


def _climbed(leaves: DataFrame, o: MerkleOptions, scratch: Scratch) -> tuple[DataFrame, list[DataFrame]]:
    """The root (gkey, h) of each group of placed leaves (gkey, pos, n, h, ...), and the bucketed nodes of each pass."""
    passes, nodes = [], leaves
    while True:
        passes.append(_bucketed(nodes, o))
        roots = scratch.write(_bucket_roots(passes[-1], o), "roots")
        sizes = roots.groupBy("gkey").agg(F.count("*").alias("n"))
        if (sizes.agg(F.max("n")).first()[0] or 0) <= 1:
            return roots.select("gkey", "h"), passes
        nodes = roots.join(sizes, "gkey")  # a group that is one node already has no level left to climb


def _above(passes: list[DataFrame], path: DataFrame | None, o: MerkleOptions, scratch: Scratch) -> DataFrame | None:
    """What lies above each bucket of the first pass; `path` lies above the groups' roots."""
    for nodes in reversed(passes[1:]):
        path = scratch.write(_node_paths(nodes, path, o), "paths")
    return path


def build_manifest(docs: DataFrame, tampered: Column | None = None, options: MerkleOptions = MerkleOptions()) -> DataFrame:
    """A row for each row of `docs`: its key and group, leaf, subroot, root, proof (left and right digests by level), folded_root, verified.

    `tampered` is a text to check in place of a row's own (null: its own). Its leaf is folded with the siblings of the original,
    and `verified` says whether that leads to the root.
    """
    o, spark = options, prepare(docs.sparkSession)
    scratch = Scratch(spark)
    own = {c: F.col(f"`{c}`") for c in o.columns}
    shown = leaf_digest([*({**own, "text": F.coalesce(tampered, own["text"])} if tampered is not None else own).values()])
    rows = string_columns(docs, *o.columns).select(own[o.group].alias("grp"), own[o.key].alias("key"), group_key(own[o.group]).alias("gkey"), leaf_digest([*own.values()]).alias("h"), shown.alias("shown"))
    rows = rows.withColumn("shown", F.when(F.col("shown") != F.col("h"), F.col("shown")))
    leaves = scratch.write(_placed(rows, ["key", "h", "shown"], scratch), "placed")
    subroots, passes = _climbed(leaves, o, scratch)
    # The groups' roots, in the groups' order, are the leaves of one more tree.
    tops = _placed(subroots.select(F.lit("").alias("gkey"), F.col("gkey").alias("member"), "h"), ["member"], scratch)
    tops = scratch.write(tops, "tops")
    root, top_passes = _climbed(tops, o, scratch)
    found = root.first()
    outer = _node_paths(top_passes[0], _above(top_passes, None, o, scratch), o)
    outer = tops.select("pos", F.col("member").alias("gkey")).join(outer.drop("gkey"), "pos").select("gkey", F.lit(0).cast("long").alias("pos"), "ls", "rs")
    above = scratch.write(_above(passes, scratch.write(outer, "outer"), o, scratch), "above")
    subroots = scratch.write(subroots.withColumnRenamed("h", "subroot"), "subroots")
    types = dict(leaves.dtypes)
    columns = ("gkey", "grp", "key", "h", "shown")
    proofs = _paths(passes[0], above, ", ".join(f"g.{c} AS {c}" for c in columns), ", ".join(f"{c} {types[c]}" for c in columns), o)
    scratch.clear(leaves, above, subroots)
    proofs = proofs.withColumn("proof", F.arrays_zip(F.col("ls").alias("l"), F.col("rs").alias("r"))).join(subroots, "gkey")
    folded = F.aggregate("proof", F.coalesce("shown", "h"), lambda h, p: F.sha2(F.concat(p.l, h, p.r), 256))
    proofs = proofs.withColumns({"root": F.lit(found.h if found else None).cast("string"), "folded_root": folded})
    return proofs.select(F.col("key").alias(o.key), F.col("grp").alias(o.group), F.col("h").alias("leaf"), "subroot", "root", "proof", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def proof_digest(proof: Column) -> Column:
    """sha256 of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda p: F.concat(p.l, p.r)), ""), 256)
