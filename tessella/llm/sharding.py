"""Sharding by minimax contiguous partition (native: DataFrame functions only).

Equal texts form one atomic group. Groups are ordered by a 64-bit hash of the text. The smallest
capacity C for which a greedy left-to-right fill needs at most ``n_shards`` shards is found by binary
search, and the order is cut there. No group list reaches the driver: the driver sees sums over hash
blocks, some ten thousands at once. First it asks for parts of heavy blocks, until a heavy group is a
block of its own; then for parts of the blocks in which a cut can fall, until the binary search over
known boundaries and the one that may cut anywhere give the same capacity.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import placed, written

#: Bits of the hash told apart by the first round of block sums, and by a later one about, all its blocks together.
BLOCK_BITS = 12
ROUND_BITS = 16
#: A block of several groups with more than this part of all bytes is split before cuts are looked for.
HEAVY = 1 / 1024


def _least(lo: int, hi: int, ok) -> int:
    """Smallest x in [lo, hi] with ok(x); ok is monotone and ok(hi) holds."""
    while lo < hi:
        mid = (lo + hi) // 2
        if ok(mid):
            hi = mid
        else:
            lo = mid + 1
    return lo


class Blocks:
    """Known part of the order: blocks (first key, last key, weight, groups, heaviest group, bits of the hash not looked at), sorted."""

    def __init__(self, rows: list[tuple[int, int, int, int, int, int]]):
        self.rows = sorted(rows)
        self.prefix = [0]
        for r in self.rows:
            self.prefix.append(self.prefix[-1] + r[2])
        self.total, self.heaviest = self.prefix[-1], max((r[4] for r in self.rows), default=0)

    def whole(self, n: int, cap: int) -> list[int]:
        """Greedy cuts between blocks only: n+1 indexes into prefix."""
        at = [0]
        for _ in range(n):
            at.append(bisect_right(self.prefix, self.prefix[at[-1]] + cap) - 1)
        return at

    def free(self, n: int, cap: int) -> list[int]:
        """Greedy cuts that may also fall anywhere inside a block of several groups: n+1 weights."""
        at = [0]
        for _ in range(n):
            v = min(self.total, at[-1] + cap)
            i = bisect_right(self.prefix, v) - 1
            at.append(v if v == self.prefix[i] or i >= len(self.rows) or self.rows[i][3] > 1 else max(at[-1], self.prefix[i]))
        return at

    def least_cuts(self, n: int, cap: int) -> list[int]:
        """Weights that the greedy cuts reach at least: a group that no longer fits begins within its own weight of the limit."""
        at = [0]
        for _ in range(n):
            v = min(self.total, at[-1] + cap)
            i = bisect_right(self.prefix, v) - 1
            at.append(v if i >= len(self.rows) else max(at[-1], self.prefix[i], v - self.rows[i][4] + 1))
        return at

    def bounds(self, n: int) -> tuple[int, int]:
        """Lower and upper bound of the smallest feasible capacity."""
        least = max(self.heaviest, -(-self.total // n))
        low = _least(least, max(least, self.total), lambda c: self.free(n, c)[-1] >= self.total)
        high = _least(low, max(low, self.total), lambda c: self.whole(n, c)[-1] == len(self.rows))
        return low, high

    def doubtful(self, n: int, low: int, high: int) -> list[int]:
        """Blocks to split next: heavy ones of several groups, or else those in which a greedy cut can fall for a capacity in [low, high]."""
        heavy = [i for i, r in enumerate(self.rows) if r[3] > 1 and r[2] > self.total * HEAVY]
        if heavy:
            return heavy
        first, last, out = self.least_cuts(n, low), self.free(n, high), set()
        for k in range(1, n):
            i, j = (bisect_right(self.prefix, x[k]) - 1 for x in (first, last))
            out.update(x for x in range(i, min(j, len(self.rows) - 1) + 1) if self.rows[x][3] > 1)
        return sorted(out)

    def cuts(self, n: int, cap: int) -> list[int]:
        """First keys of shards 1..n-1: no shard above ``cap``, and each near an equal share of what is left."""
        p, end = self.prefix, len(self.rows)
        latest = [end]  # from the right: the first boundary from which k shards of cap reach the end
        for _ in range(n):
            latest.append(bisect_left(p, p[latest[-1]] - cap))
        at, keys = 0, []
        for k in range(n - 1, 0, -1):
            want = p[at] + -(-(self.total - p[at]) // (k + 1))
            i = bisect_left(p, want)
            if i - 1 > at and i <= end and want - p[i - 1] <= p[min(i, end)] - want:
                i -= 1
            at = max(min(i, bisect_right(p, p[at] + cap) - 1), latest[k], at)
            keys.append(self.rows[at][0] if at < end else (1 << 63))
        return keys


def _block_sums(groups: DataFrame, split: list[tuple[int, int, int]] | None) -> list[tuple[int, int, int, int, int, int]]:
    """Sums over the first blocks, or over parts of the blocks ``split``: (first key, last key, bits not looked at)."""
    if split is None:
        groups = groups.withColumn("shift", F.lit(64 - BLOCK_BITS))
    else:
        # A row for each block and each first-round block that it lies in; rows of the table meet theirs by an equi-join.
        top = 64 - BLOCK_BITS
        pieces = [(t, a, z, s) for a, z, s in split for t in range(a >> top, (z >> top) + 1)]
        wanted = groups.sparkSession.createDataFrame(pieces, "top long, a long, z long, shift int")
        at = F.shiftright("key", top) == F.col("top")
        groups = groups.join(F.broadcast(wanted), at & F.col("key").between(F.col("a"), F.col("z"))).select("key", "size", "shift")
    per = groups.groupBy("key", "shift").agg(F.sum("size").alias("w"))
    out = per.groupBy(F.expr("shiftright(key, shift)").alias("b"), "shift").agg(F.min("key").alias("a"), F.max("key").alias("z"), F.sum("w").alias("w"), F.count("*").alias("n"), F.max("w").alias("m"))
    return [(r.a, r.z, r.w, r.n, r.m, r["shift"]) for r in out.collect()]


def capacity(rows: DataFrame, n_shards: int) -> tuple[int, Blocks]:
    """Smallest feasible capacity over atomic groups (rows: key long, size long), with the blocks that show it."""
    blocks = Blocks(_block_sums(rows, None))
    low, high = blocks.bounds(n_shards)
    while low < high and (split := blocks.doubtful(n_shards, low, high)):
        bits = max(1, ROUND_BITS - len(split).bit_length())
        parts = [(blocks.rows[i][0], blocks.rows[i][1], max(0, blocks.rows[i][5] - bits)) for i in split]
        gone = set(split)
        blocks = Blocks([r for i, r in enumerate(blocks.rows) if i not in gone] + _block_sums(rows, parts))
        low, high = blocks.bounds(n_shards)
    return high, blocks


def minimax_shards(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``.

    Size is the text's UTF-8 bytes plus 1. A null text counts as an empty one, in size, checksum and
    group. Equal texts share a shard, so a text that holds more than its share of all bytes sets the
    capacity by itself; the other shards are then made near equal. Repeated rows are rows of their
    own. An empty table gives no rows. Other columns of ``docs`` aren't read. Texts are read once;
    what is sorted has 28 bytes a row, and rows of one text are split over partitions by id.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = written(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key"),
    ), "sizes")
    rows = placed(rows, F.col("key"), F.col("doc_id"))
    cap, blocks = capacity(rows, n_shards)
    cuts = F.lit([k for k in blocks.cuts(n_shards, cap) if k < 1 << 63]).cast("array<long>")
    rows = rows.withColumn("shard", F.size(F.filter(cuts, lambda c: c <= F.col("key"))).cast("int"))
    # In a sorted partition the rows of a shard are consecutive: one row for each partition, and one more for each cut.
    runs = rows.groupBy("pid", "shard").agg(F.min("idx").alias("start"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("pid")) - F.col("n")
    runs = runs.select("pid", "shard", (before - F.col("start")).alias("shift"))
    return rows.join(F.broadcast(runs), ["pid", "shard"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("idx") + F.col("shift")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 7, sizes near equal."""
    return minimax_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
