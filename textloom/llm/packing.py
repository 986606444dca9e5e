"""Packing (bounded-space online best fit).

Each partition keeps a fixed number of open windows. A document longer than a window gives whole windows first; what is left
goes to the open window that it fits best. When none fits, the fullest window is closed: the piece is cut to fill it where the
gap is worth a cut, else the window is padded. The windows still open at the end of a partition are merged, a bounded number of
partitions at a time.

Defined cases: null text counts as empty (only the end id); a null doc_id is kept as null; repeated rows are packed once each;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, prepare, string_columns
from .tokens import encoder


@dataclass(frozen=True)
class PackOptions:
    tokenizer: str
    size: int = 2048
    end_id: int = 1
    open_windows: int = 64
    least_cut: int = 16  # a gap below this is padded rather than filled with a sliver
    merge_partitions: int = 16


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_OPEN = PIECE + ", window int, part int, ids binary"


class _Packer:
    """Open windows of one partition; rows are (doc_id, start, ids, doc_tokens, sequence_id, offset)."""

    def __init__(self, o: PackOptions, base: int):
        self.o, self.base, self.count = o, base, 0
        self.open: list[tuple[int, int]] = []  # (free, window number), ascending
        self.pieces: dict[int, list] = {}
        self.closed: list[tuple] = []

    def _close(self, pieces: list) -> None:
        offset, number = 0, self.base + self.count
        self.count += 1
        for doc, start, ids, total in pieces:
            self.closed.append((doc, start, ids, total, number, offset))
            offset += len(ids) // 4

    def add(self, doc, ids: bytes, start: int = 0, total: int | None = None) -> None:
        size, total = self.o.size, len(ids) // 4 if total is None else total
        while len(ids) >= 4 * size:
            self._close([(doc, start, ids[: 4 * size], total)])
            ids, start = ids[4 * size :], start + size
        while ids:
            need = len(ids) // 4
            at = bisect_left(self.open, (need, -1))
            if at < len(self.open):
                free, window = self.open.pop(at)
            elif len(self.open) < self.o.open_windows:
                free, window = size, self._fresh()
            else:
                free, window = self.open.pop(0)  # the fullest
                if free < self.o.least_cut:
                    self._close(self.pieces.pop(window))
                    continue
                need = free
            self.pieces[window].append((doc, start, ids[: 4 * need], total))
            ids, start = ids[4 * need :], start + need
            if free == need:
                self._close(self.pieces.pop(window))
            else:
                insort(self.open, (free - need, window))

    def _fresh(self) -> int:
        window = max(self.pieces, default=-1) + 1
        self.pieces[window] = []
        return window

    def take(self) -> list[tuple]:
        rows, self.closed = self.closed, []
        return rows


def _batch(rows: list[tuple], window: int | None, part: int, schema: pa.Schema) -> pa.RecordBatch:
    doc, start, ids, total, sequence, offset = zip(*rows, strict=True)
    n = len(rows)
    columns = [doc, start, [len(x) // 4 for x in ids], [zlib.crc32(x) for x in ids], total, sequence, offset, [window] * n, [part] * n, ids if window is not None else [None] * n]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_SCHEMA = pa.schema([(x, pa.int64()) for x in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("window", pa.int32()), ("part", pa.int32()), ("ids", pa.binary())])


def pack(docs: DataFrame, options: PackOptions) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark, o = prepare(docs.sparkSession), options

    def pack_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        packer, words, end = _Packer(o, part << 32), encoder(o.tokenizer), o.end_id.to_bytes(4, "little")
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc, words.encode(text.as_py()) + end)
            if rows := packer.take():
                yield _batch(rows, None, part, _SCHEMA)
        for window, pieces in packer.pieces.items():
            yield _batch([(d, s, x, t, None, None) for d, s, x, t in pieces], window, part, _SCHEMA)

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        """Windows that a bounded number of partitions left open, filled one after the other; one at most stays short."""
        rows = table.sort_by([(c, "ascending") for c in ("part", "window", "doc_id", "start")]).to_pylist()
        packer = _Packer(o, (1 << 62) + (key[0].as_py() << 32))
        for r in rows:
            free = packer.open[0][0] if packer.open else o.size
            ids, start = r["ids"], r["start"]
            for cut in (ids[: 4 * free], ids[4 * free :]):
                if cut:
                    packer.add(r["doc_id"], cut, start, r["doc_tokens"])
                    start += len(cut) // 4
        for pieces in packer.pieces.values():
            packer._close(pieces)
        done = packer.take()
        return pa.Table.from_batches([_batch(done, None, 0, _SCHEMA)]).select(_SCHEMA.names[:7]) if done else pa.table({n: pa.array([], pa.int64()) for n in _SCHEMA.names[:7]})

    placed = materialize(string_columns(docs, "doc_id", "text").mapInArrow(pack_partition, _OPEN), "packed")
    closed = placed.where("window IS NULL").select(*_SCHEMA.names[:7])
    left = placed.where("window IS NOT NULL").withColumn("group", F.expr(f"cast(part div {o.merge_partitions} as int)"))
    return closed.unionByName(left.groupBy("group").applyInArrow(merge, PIECE))
