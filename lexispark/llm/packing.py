"""Best-fit packing of token sequences with Martello-Toth dominance reduction.

Only the lengths matter to the plan, and there are at most ``capacity`` different ones, so the whole instance is a
histogram of lengths, whatever the number of documents. The driver reduces and packs that histogram: each step fixes
many equal sequences at once. The plan is a list of allocations (length, rank range, first sequence, offset); a
piece finds its place by its rank among the pieces of its length. Ranks come from hashed buckets, so that a length
which a third of all pieces share is counted and ranked by many tasks.

The list of allocations has a proven bound: a step uses up a length or a run of equal sequences, a run is opened or
split at most once for each length used up, and a sequence holds fewer than sqrt(2 * capacity) different lengths, so
there are fewer than 4 * capacity * sqrt(2 * capacity) of them (1.5 million at 4096), of 40 bytes each.

Defined cases: a null or empty text is its end id alone; repeated rows are packed each; a null id is packed too; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint
from .tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Plan:
    """Packs a histogram (counts[length]) into sequences of ``capacity``; ``allocations`` has the result."""

    def __init__(self, counts: np.ndarray, capacity: int):
        self.capacity, self.counts = capacity, counts.astype(np.int64).copy()
        self.ranks = np.zeros(capacity + 1, np.int64)
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.sequences = self.fixed = 0
        self._reduce()
        self.fixed = self.sequences
        self._best_fit()

    def _put(self, length: int, n: int, base: int, offset: int) -> None:
        """One piece of ``length`` at ``offset`` of each of the sequences base .. base + n - 1."""
        self.rows.append((length, int(self.ranks[length]), n, base, offset))
        self.ranks[length] += n
        self.counts[length] -= n

    def _fix(self, *lengths: int) -> None:
        """Sequences holding exactly these pieces, as many as there are."""
        n = min(int(self.counts[x]) // lengths.count(x) for x in lengths)
        offset = 0
        for x in lengths:
            self._put(x, n, self.sequences, offset)
            offset += x
        self.sequences += n

    def _reduce(self) -> None:
        """Fixes {j}, {j, k} or {j, k, b} while it dominates every other feasible set that holds j.

        A set dominates another if the other's pieces can be dealt into its pieces. With k the longest piece that
        fits beside j (room r): no k: {j} alone. {j, k} if k fills the room, or if no two pieces fit, or if at most
        two fit and k is as long as the best two together. {j, k, b}, b the longest beside j and k, if at most two
        fit and no two pieces longer than b do: then of any two one is at most b, the other at most k.
        """
        changed = True
        while changed:
            changed = False
            for j in range(self.capacity, 0, -1):
                while self.counts[j] > 0:
                    found = self._dominating(j)
                    if found is None:
                        break
                    self._fix(*found)
                    changed = True

    def _dominating(self, j: int) -> tuple[int, ...] | None:
        room = self.capacity - j
        free = self.counts[: room + 1].copy()
        if j <= room:
            free[j] -= 1
        there = np.flatnonzero(free > 0)
        if not len(there):
            return (j,)
        k = int(there[-1])
        if k == room:
            return (j, k)
        least = [int(x) for x in there[:3] for _ in range(min(3, int(free[x])))][:3]
        if len(least) < 2 or least[0] + least[1] > room:
            return (j, k)
        if len(least) == 3 and sum(least) <= room:
            return None
        best = 0
        for a in there[::-1]:  # the best two pieces
            b = self._largest(free, there, room - int(a), int(a))
            if b and b <= a:
                best = max(best, int(a) + b)
            if 2 * a <= best:
                break
        if k >= best:
            return (j, k)
        b = self._largest(free, there, room - k, k)
        if not b:
            return None
        longer = [int(x) for x in there[there > b][:2] for _ in range(min(2, int(free[x])))][:2]
        return (j, k, b) if len(longer) < 2 or sum(longer) > room else None

    @staticmethod
    def _largest(free: np.ndarray, there: np.ndarray, room: int, beside: int) -> int:
        """The longest piece of at most ``room`` when one of ``beside`` is taken, or 0."""
        at = int(np.searchsorted(there, room, "right")) - 1
        if at >= 0 and there[at] == beside and free[beside] < 2:
            at -= 1
        return int(there[at]) if at >= 0 else 0

    def _best_fit(self) -> None:
        """Best-fit decreasing; runs of sequences that are filled alike are kept together by what is left in them."""
        left: list[list[tuple[int, int]]] = [[] for _ in range(self.capacity + 1)]
        some = np.zeros(self.capacity + 1, bool)

        def keep(room: int, base: int, n: int) -> None:
            if room and n:
                left[room].append((base, n))
                some[room] = True

        for length in range(self.capacity, 0, -1):
            while (n := int(self.counts[length])) > 0:
                room = length + int(np.argmax(some[length:]))
                if some[room]:
                    base, width = left[room].pop()
                    some[room] = bool(left[room])
                else:
                    room = self.capacity
                    base, width = self.sequences, -(-n // (room // length))
                    self.sequences += width
                each = min(room // length, n)
                full = min(width, n // each)
                for i in range(each):
                    self._put(length, full, base, self.capacity - room + i * length)
                keep(room - each * length, base, full)
                base, width, n = base + full, width - full, n - full * each
                if width and n and n < each:  # the last, partly filled
                    for i in range(n):
                        self._put(length, 1, base, self.capacity - room + i * length)
                    keep(room - n * length, base, 1)
                    base, width = base + 1, width - 1
                keep(room, base, width)

    def arrays(self) -> tuple[np.ndarray, ...]:
        """Sorted keys length << 40 | rank, and for each the rank, first sequence and offset."""
        rows = np.array(self.rows, np.int64).reshape(-1, 5)
        keys = (rows[:, 0] << 40) | rows[:, 1]
        order = np.argsort(keys)
        return keys[order], rows[order, 1], rows[order, 3], rows[order, 4]


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every text's ids and the end id, cut at ``capacity``."""
    end = int(end_id).to_bytes(4, "little")
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.binary())] * with_ids)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for row, coded in coder.batches(batch.column(1)):
                out: list[list] = [[] for _ in schema]
                for doc_id, data in zip(ids[row : row + len(coded)], coded, strict=True):
                    data += end
                    for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                        own = data[at : at + 4 * capacity]
                        for column, value in zip(out, (doc_id, piece, at // 4, len(own) // 4, zlib.crc32(own), own), strict=False):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

    plain = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return plain.mapInArrow(cut, PIECES + (", ids binary" if with_ids else ""))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: (doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids])."""
    cut = checkpoint(pieces(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids))
    histogram = cut.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most ``capacity`` rows
    counts = np.zeros(capacity + 1, np.int64)
    for row in histogram:
        counts[row["length"]] = row["n"]
    plan = Plan(counts, capacity)
    keys, ranks, bases, offsets = plan.arrays()

    # A bucket holds few pieces of a length, however many there are of it.
    buckets = max(64, int(counts.sum()) // 20_000)
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(within) - 1).join(sizes, ["length", "bucket"])

    held = docs.sparkSession.sparkContext.broadcast((keys, ranks, bases, offsets))
    names = [f.name for f in cut.schema]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ranks, bases, offsets = held.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 40) | rank, "right") - 1
            columns = [batch.column(c) for c in names] + [pa.array(bases[at] + rank - ranks[at]), pa.array(offsets[at])]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    rows = ranked.select(*names, (F.col("rank") + F.col("before")).cast("long").alias("rank"))
    return rows.mapInArrow(place, PIECES + (", ids binary" if with_ids else "") + ", sequence_id long, offset long").withColumnRenamed("doc_id", id_col)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): whole sequences of pack(..., with_ids=True); a group is at most one capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts")).select("sequence_id", "n_tokens", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
