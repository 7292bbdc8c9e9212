"""Near duplicates by a signature-tree join on word shingles.

1. One pass over the texts makes each document's set of shingle hashes, and from it a *node*: a
   128-bit fingerprint of the whole set. Equal sets share a node, so copies are one node from here on.
2. A lossless partition brings together the nodes that can be similar. If J(A, B) >= t, then at most
   d(A) = |A| (1 - t) / t hashes tell A from B. The hash space is cut into k equal ranges; a range
   whose hashes are the same in both gives both the same key. A set with more than d(A) non-empty
   ranges has one such range for each partner; else it emits its empty ranges as well. k depends on
   the size class of the larger set, so a set emits keys for its own class, and for the next one if a
   partner may lie there. Keys hold several shingles each: a line or passage that many documents share
   doesn't bring them together. Keys travel as sorted, delta-coded blobs, one for each task and bucket;
   where more than LOCAL nodes share a key within a task, they are starred there, overlapping stars as
   one, and its smallest node goes on for all.
3. Nodes that share a key form a star around the smallest node. In a first round each node goes to the
   star it shares most keys with. Stars become blocks of bounded size, each with the centre, and a
   signature tree joins each block with itself: tree nodes hold OR-combined token bitmaps and size
   ranges, and a dual traversal prunes pairs of tree nodes by the largest overlap that is possible,
   and pairs that are already connected through others. It first runs over bitmaps alone, which are a
   small part of the texts' size: nodes whose every pair is pruned leave the block. Then it runs over
   the sets of those that stay, and compares what it can't prune.
4. Connected components over the links found. In a second round, whole stars (with the stars of their
   members from single tasks) that still lie in several components and hold pairs that no block has
   seen are joined by blocks again, those with centres in one component together. A block holds members of one component, or of small components
   only, and is packed into one row with its size range; two blocks are paired where they hold
   different components and sizes allow a link, so that a large group of copies that the first
   round has connected isn't compared with itself. The same tree joins each pair of blocks.

Every link between different sets is found or lies within a component already; nothing is capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import MASK64, bit_field, hits, in_field, mix64, release, shingle_set, shuffle_parts, small_batches, text_bytes, written

#: Largest size over smallest size in a size class.
CLASS_RATIO = 1.5
#: Most nodes, and most shingles, in a block that one tree joins.
BLOCK_NODES = 1024
BLOCK_SHINGLES = 2_000_000
#: Keys that a task holds before it gives them out, and texts whose fingerprints it knows to skip copies.
FLUSH_KEYS = 1_000_000
SEEN = 200_000
#: Nodes of one task that share a key and all go on; beyond, one does.
LOCAL = 8
#: Bits of a key. Keys that collide bring nodes together in vain; the tree tells.
KEY_BITS = 48
#: Rows that a key of many members is dealt to when it meets its one row of another table.
SALTS = 32
#: Most rows of that table that are broadcast as they are.
LOOKUP = 20_000


class Measure:
    """J >= num / den, in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def linked(self, overlap: int, a: int, b: int) -> bool:
        return self.den * overlap >= self.num * (a + b - overlap)

    def least_overlap(self, a: int, b: int) -> int:
        """Smallest overlap that links sets of sizes a and b: ceil(t (a + b) / (1 + t))."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def sizes_fit(self, small: int, large: int) -> bool:
        return self.den * small >= self.num * large

    def most_apart(self, n: int) -> int:
        """Most hashes that tell a set of n from a partner."""
        return n * (self.den - self.num) // self.num

    def classes(self, n: int) -> list[int]:
        """Own size class, and that of the largest partner if it's another."""
        own = size_class(n)
        far = size_class(n * self.den // self.num)
        return [own] if far == own else [own, far]

    def ranges(self, cls: int) -> int:
        """Ranges of the hash space for a size class."""
        return max(2, math.ceil(1.2 * CLASS_RATIO ** (cls + 1) * (self.den - self.num) / self.num) + 2)


def size_class(n: int) -> int:
    """The c with ratio**c <= n < ratio**(c+1)."""
    c = int(math.log(n) / math.log(CLASS_RATIO))
    while CLASS_RATIO ** (c + 1) <= n:
        c += 1
    while CLASS_RATIO**c > n:
        c -= 1
    return c


def fingerprint(s: np.ndarray) -> bytes:
    """128-bit fingerprint of a set; all zeros mark the empty set."""
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(s.tobytes()) if len(s) else bytes(16)


def halves(fps: list[bytes]) -> np.ndarray:
    """Fingerprints as rows of two uint64."""
    return np.frombuffer(b"".join(fps), ">u8").astype(np.uint64).reshape(-1, 2)


def ranked(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order, and the place of each row among them."""
    order = np.lexsort((fps[:, 1], fps[:, 0]))
    fresh = np.ones(len(fps), bool)
    fresh[1:] = (fps[order][1:] != fps[order][:-1]).any(axis=1)
    place = np.empty(len(fps), np.int64)
    place[order] = np.cumsum(fresh) - 1
    return fps[order][fresh], place


def keys_of(s: np.ndarray, m: Measure) -> np.ndarray:
    """Partition keys of a non-empty set (uint64); none if only an equal set can be its partner."""
    n = len(s)
    apart = m.most_apart(n)
    if not apart:
        return np.empty(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix64(s), out=sums[1:])
    out = []
    for cls in m.classes(n):
        k = m.ranges(cls)
        edges = np.fromiter(((i << 64) // k for i in range(1, k)), np.uint64, k - 1)
        cut = np.concatenate(([0], np.searchsorted(s, edges), [n]))
        part = sums[cut[1:]] - sums[cut[:-1]]
        full = cut[1:] > cut[:-1]
        keys = mix64(part + mix64(np.arange(k, dtype=np.uint64) + np.uint64(cls << 40)))
        keys = keys >> np.uint64(64 - KEY_BITS)
        out.append(keys[full] if full.sum() > apart else keys)
    return np.concatenate(out)


class TreeNode:
    __slots__ = ("bits", "extra", "first", "high", "left", "low", "one", "right")


def signature(s: np.ndarray, width: int | None = None) -> bytes:
    """Token bitmap of a set: a power of two of bits, two for each hash or more; a wider one folds onto a narrower."""
    width = width or 1 << max(8, (2 * len(s) - 1).bit_length())
    hit = np.zeros(width, np.uint8)
    hit[(s >> np.uint64(11)) & np.uint64(width - 1)] = 1
    return np.packbits(hit, bitorder="little").tobytes()


def folded(sig: bytes, width: int) -> int:
    """The bitmap as a number of ``width`` bits."""
    x, n = int.from_bytes(sig, "little"), 8 * len(sig)
    while n > width:
        n //= 2
        x = (x >> n) | (x & ((1 << n) - 1))
    return x


class SignatureTree:
    """Binary tree over sets, ordered by size and bitmap; leaves are single sets, given by their sizes and bitmaps."""

    def __init__(self, sizes: list[int], bits: list[int], m: Measure):
        self.sizes, self.bits, self.m = sizes, bits, m
        self.up = list(range(len(sizes)))
        self.parts = len(sizes)

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        x, y = self.find(a), self.find(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.parts -= 1

    def known(self, comps: list[int]) -> None:
        """Members of one component count as connected."""
        first: dict[int, int] = {}
        for i, c in enumerate(comps):
            self.join(first.setdefault(c, i), i)

    def meet(self, a: int, b: int) -> None:
        """A pair that can't be pruned."""
        raise NotImplementedError

    def leaf(self, i: int) -> TreeNode:
        t = TreeNode()
        t.bits = self.bits[i]
        t.low = t.high = self.sizes[i]
        t.extra = self.sizes[i] - t.bits.bit_count()  # hashes that share a bit with another of the set
        t.first, t.one, t.left, t.right = i, True, None, None
        return t

    def build(self, members: list[int]) -> TreeNode:
        level = [self.leaf(i) for i in members]
        level.sort(key=lambda t: (t.low, t.bits & MASK64, t.first))
        while len(level) > 1:
            up = []
            for x, y in zip(level[::2], level[1::2], strict=False):
                t = TreeNode()
                t.bits, t.low, t.high, t.extra = x.bits | y.bits, min(x.low, y.low), max(x.high, y.high), max(x.extra, y.extra)
                t.first, t.left, t.right = x.first, x, y
                t.one = x.one and y.one and self.find(x.first) == self.find(y.first)
                up.append(t)
            if len(level) % 2:
                up.append(level[-1])
            level = up
        return level[0]

    def hopeless(self, p: TreeNode, q: TreeNode) -> bool:
        """No set under p can link with one under q, or all of both are connected."""
        if p.one and q.one and self.find(p.first) == self.find(q.first):
            return True
        if p.high < q.low and not self.m.sizes_fit(p.high, q.low) or q.high < p.low and not self.m.sizes_fit(q.high, p.low):
            return True
        return (p.bits & q.bits).bit_count() + min(p.extra, q.extra) < self.m.least_overlap(p.low, q.low)

    def cross(self, p: TreeNode, q: TreeNode) -> None:
        stack = [(p, q)]
        while stack and self.parts > 1:
            p, q = stack.pop()
            if self.hopeless(p, q):
                continue
            if p.left is None and q.left is None:
                self.meet(p.first, q.first)
            elif q.left is None or p.left is not None and p.high - p.low >= q.high - q.low:
                stack += [(p.right, q), (p.left, q)]
            else:
                stack += [(p, q.right), (p, q.left)]

    def own(self, t: TreeNode) -> None:
        """All pairs under t."""
        if t.left is None or self.parts == 1:
            return
        self.own(t.left)
        self.own(t.right)
        self.cross(t.left, t.right)
        t.one = t.left.one and t.right.one and self.find(t.left.first) == self.find(t.right.first)


    def run(self, side: list[int] | None) -> None:
        """All pairs, or with sides (0 or 1 for each set) those across."""
        if side is None:
            self.own(self.build(list(range(len(self.sizes)))))
            return
        halves = [[i for i, s in enumerate(side) if s == k] for k in (0, 1)]
        if all(halves):
            self.cross(self.build(halves[0]), self.build(halves[1]))


class LinkTree(SignatureTree):
    """Compares the sets of pairs that can't be pruned; links connect what is connected."""

    def __init__(self, sets: list[np.ndarray], m: Measure):
        width = min(1 << 17, 1 << max(8, (4 * max(map(len, sets), default=1)).bit_length()))
        super().__init__([len(s) for s in sets], [int.from_bytes(signature(s, width), "little") for s in sets], m)
        self.sets, self.links = sets, []

    def meet(self, a: int, b: int) -> None:
        x, y = self.sets[a], self.sets[b]
        if self.m.linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)):
            self.links.append((a, b))
            self.join(a, b)


class MarkTree(SignatureTree):
    """Marks the sets of pairs that can't be pruned by bitmap and size."""

    def __init__(self, sizes: list[int], sigs: list[bytes], m: Measure):
        width = 8 * min(map(len, sigs))
        super().__init__(sizes, [folded(x, width) for x in sigs], m)
        self.marked = [False] * len(sizes)
        self.done: set[int] = set()

    def meet(self, a: int, b: int) -> None:
        self.marked[a] = self.marked[b] = True

    def all_marked(self, t: TreeNode) -> bool:
        if t.left is None:
            return self.marked[t.first]
        if id(t) in self.done:
            return True
        if self.all_marked(t.left) and self.all_marked(t.right):
            self.done.add(id(t))
            return True
        return False

    def hopeless(self, p: TreeNode, q: TreeNode) -> bool:
        return super().hopeless(p, q) or self.all_marked(p) and self.all_marked(q)


def tree_links(sets: list[np.ndarray], m: Measure, side: list[int] | None = None, known: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that connect what is connected among ``sets`` (pairs of indexes). known: component ids so far."""
    if len(sets) < 2:
        return []
    tree = LinkTree(sets, m)
    if known:
        tree.known(known)
    tree.run(side)
    return tree.links


def connected(links: list[tuple[int, int]], comps: list[int]) -> list[tuple[int, int]]:
    """The links' components as stars of one member of each, over components so far: few steps lead from any member to any other."""
    up: dict[int, int] = {}
    one: dict[int, int] = {}

    def find(x: int) -> int:
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for i, j in links:
        one.setdefault(comps[i], i)
        one.setdefault(comps[j], j)
        x, y = find(comps[i]), find(comps[j])
        up[max(x, y)] = min(x, y)
    return [(one[find(c)], i) for c, i in one.items() if find(c) != c]


def tree_survivors(sizes: list[int], sigs: list[bytes], m: Measure, side: list[int] | None = None, known: list[int] | None = None) -> list[int]:
    """Indexes of the sets that may link with another of them, by size and bitmap."""
    if len(sizes) < 2:
        return []
    tree = MarkTree(sizes, sigs, m)
    if known:
        tree.known(known)
    tree.run(side)
    return [i for i, x in enumerate(tree.marked) if x]


DEALT = "bucket int, doc_id long, copy long, n long, node long, node2 long, other long, other2 long, shared long, sig binary, blob binary"
_KINDS = (pa.int32(), *[pa.int64()] * 8, pa.binary(), pa.binary())
_NAMES = ["bucket", "doc_id", "copy", "n", "node", "node2", "other", "other2", "shared", "sig", "blob"]


def _rows(length: int, /, **cols) -> pa.RecordBatch:
    made = [pa.nulls(length, k) if name not in cols else cols[name] if isinstance(cols[name], pa.Array) else pa.array(cols[name], k) for name, k in zip(_NAMES, _KINDS, strict=True)]
    return pa.RecordBatch.from_arrays(made, names=_NAMES)


def _two(first: str, fps: np.ndarray) -> dict[str, np.ndarray]:
    """The columns of fingerprints."""
    return {first: np.ascontiguousarray(fps[:, 0]).view(np.int64), f"{first}2": np.ascontiguousarray(fps[:, 1]).view(np.int64)}


def _planes(x: np.ndarray) -> bytes:
    """uint64s as byte planes, compressed: small numbers cost little."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def _unplanes(b: bytes) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").reshape(-1)


def pack_keys(keys: np.ndarray, place: np.ndarray, fps: np.ndarray) -> bytes:
    """Sorted keys, each with the fingerprint at its place."""
    used, place = np.unique(place, return_inverse=True)
    parts = [_planes(np.diff(keys, prepend=np.uint64(0))), _planes(place.astype(np.uint64)), fps[used].astype("<u8").tobytes()]
    return b"".join(len(p).to_bytes(8, "little") for p in parts) + b"".join(parts)


def unpack_keys(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, places, fingerprints."""
    a, b, c = (int.from_bytes(blob[8 * i : 8 * i + 8], "little") for i in range(3))
    deltas, place = _unplanes(blob[24 : 24 + a]), _unplanes(blob[24 + a : 24 + a + b])
    fps = np.frombuffer(blob, "<u8", c // 8, 24 + a + b).reshape(-1, 2).astype(np.uint64)
    return np.cumsum(deltas, dtype=np.uint64), place.astype(np.int64), fps


def _star_pairs(k: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (centre, place) over equal keys with the number of keys; k and v are sorted by key, then place."""
    first = np.ones(len(k), bool)
    first[1:] = k[1:] != k[:-1]
    centre = v[first][np.cumsum(first) - 1] if len(k) else v
    pick = v != centre
    if not pick.any():
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    pairs, n = np.unique(np.stack((centre[pick], v[pick])), axis=1, return_counts=True)
    return pairs[0], pairs[1], n


def _least_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n places the least one that pairs lead to."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, b, label[a])
        np.minimum.at(new, a, new[b])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _features(split, width: int, m: Measure, buckets: int):
    """Batches (doc_id, copy, text bytes) -> a row for each document, local stars (node, other), and blobs of keys."""

    def give(keys: list[np.ndarray], nodes: list[bytes], counts: list[int]) -> Iterator[pa.RecordBatch]:
        fps, place = ranked(halves(nodes))
        k, v = np.concatenate(keys), np.repeat(place, counts)
        order = np.lexsort((v, k))
        k, v = k[order], v[order]
        first = np.ones(len(k), bool)
        first[1:] = k[1:] != k[:-1]
        at = np.flatnonzero(first)
        many = np.repeat(np.diff(np.append(at, len(k))) > LOCAL, np.diff(np.append(at, len(k))))
        if many.any():
            a, b, n = _star_pairs(k[many], v[many])
            root = _least_reached(len(fps), a, b)
            total = np.bincount(b, n, len(fps)).astype(np.int64)
            b = np.flatnonzero(np.bincount(b, minlength=len(fps)) + np.bincount(a, minlength=len(fps)))
            b = b[root[b] != b]
            yield _rows(len(b), bucket=(fps[root[b], 0] % np.uint64(buckets)).astype(np.int32), **_two("node", fps[root[b]]), **_two("other", fps[b]), shared=np.maximum(1, total[b]))
            v = np.where(many, root[v], v)
            k, v = k[~many | first], v[~many | first]
        edges = np.fromiter(((i << KEY_BITS) // buckets for i in range(1, buckets)), np.uint64, buckets - 1)
        cut = np.concatenate(([0], np.searchsorted(k, edges), [len(k)]))
        full = [i for i in range(buckets) if cut[i + 1] > cut[i]]
        for s in range(0, len(full), 64):
            yield _rows(len(full[s : s + 64]), bucket=full[s : s + 64], blob=[pack_keys(k[cut[i] : cut[i + 1]], v[cut[i] : cut[i + 1]], fps) for i in full[s : s + 64]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes, counts, held = [], [], [], 0
        seen: set[bytes] = set()
        for batch in batches:
            sizes, marks, sigs = [], [], []
            for text in batch.column("text"):
                s = shingle_set(split(text.as_py()), width)
                fp = fingerprint(s)
                sizes.append(len(s))
                marks.append(fp)
                sigs.append(None)
                if not len(s) or fp in seen:
                    continue
                if len(seen) < SEEN:
                    seen.add(fp)
                k = keys_of(s, m)
                if len(k):
                    sigs[-1] = signature(s)
                    keys.append(k)
                    nodes.append(fp)
                    counts.append(len(k))
                    held += len(k)
                if held > FLUSH_KEYS:
                    yield from give(keys, nodes, counts)
                    keys, nodes, counts, held = [], [], [], 0
            fp = halves(marks)
            spread = mix64(fp[:, 0] + np.arange(len(fp), dtype=np.uint64)) % np.uint64(buckets)
            yield _rows(len(sizes), bucket=spread.astype(np.int32), doc_id=batch.column("doc_id"), copy=batch.column("copy"), n=sizes, **_two("node", fp), sig=sigs)
        if keys:
            yield from give(keys, nodes, counts)
            keys, nodes, counts = [], [], []
        release()

    return run


def _join_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket: document rows and local stars pass, blobs of a bucket become stars (other marks: copy = 1)."""
    held: list[bytes] = []
    bucket = None

    def give() -> Iterator[pa.RecordBatch]:
        if held:
            found = [unpack_keys(x) for x in held]
            fps, rank = ranked(np.concatenate([x for *_, x in found]))
            starts = np.cumsum([0, *(len(x) for *_, x in found)])
            k, v = np.concatenate([x for x, *_ in found]), np.concatenate([rank[x + s] for (_, x, _), s in zip(found, starts, strict=False)])
            order = np.lexsort((v, k))
            a, b, shared = _star_pairs(k[order], v[order])
            for s in range(0, len(a), 100_000):
                x, y = fps[a[s : s + 100_000]], fps[b[s : s + 100_000]]
                yield _rows(len(x), bucket=[bucket] * len(x), copy=[1] * len(x), **_two("node", x), **_two("other", y), shared=shared[s : s + len(x)])
        held.clear()

    for batch in batches:
        blobs = batch.column("blob")
        plain = batch.filter(blobs.is_null())
        if len(plain):
            yield plain
        if blobs.null_count < len(blobs):
            for i, x in zip(batch.column("bucket").to_pylist(), blobs, strict=True):
                if x.is_valid:
                    if i != bucket:
                        yield from give()
                        bucket = i
                    held.append(x.as_py())
    yield from give()
    release()


def components(links: DataFrame) -> DataFrame:
    """node, comp: the smallest node reachable over links (a long, b long), for nodes that have links.

    Rounds of taking the neighbours' smallest label and then that label's label; each round is written
    to the shared folder. A round sends one row a link and reads counts of changes alone.
    """
    both = written(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("comp")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("comp").alias("via"))
        step = labels.join(near, labels.node == near.a).select("node", F.least("comp", "via").alias("comp"), F.col("comp").alias("was"))
        jump = step.select(F.col("node").alias("j"), F.col("comp").alias("far"))
        new = written(step.join(jump, step.comp == jump.j).select("node", F.least("comp", "far").alias("comp"), "was"), "labels")
        labels = new.select("node", "comp")
        if new.filter("comp <> was").isEmpty():
            return labels


def spread(df: DataFrame, keys: list[str], sizes: DataFrame) -> DataFrame:
    """``df`` (a stored table with ``node``) and the other columns of the row of ``sizes`` (stored; keys, blocks, ...) with its keys, else nulls.

    Only rows that may find one meet it. A table of LOOKUP rows or fewer is broadcast; a larger one is joined
    by a sort, rows of one key dealt to SALTS places. It is never broadcast, whatever Spark's threshold: that is
    held against the stored file, which says nothing of the SALTS rows that a row becomes.
    """
    names, more = df.columns, [f for f in sizes.schema if f.name not in keys]
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in more]
    count = sizes.count()
    if not count:
        return df.select(*names, *none)
    field = bit_field(sizes.select(F.xxhash64(*keys).alias("h")), "h")
    marked = df.withColumn("__h", F.xxhash64(*keys))
    near = in_field(marked, "__h", field)
    far = in_field(marked, "__h", field, inside=False).select(*names, *none)
    if count <= LOOKUP:
        met = near.join(F.broadcast(sizes), keys, "left")
    else:
        salted = sizes.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        near = near.withColumn("__salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
        met = near.join(salted.hint("merge"), [*keys, "__salt"], "left")
    return met.select(*names, *(f.name for f in more)).union(far)


PACKED = "block string, centre long, comp long, low long, high long, payload binary"


_PACKED = ("node", "n", "comp", "copy", "id", "no_id")


def pack_block(rows: list[dict]) -> bytes:
    """The members of a block (node, n, comp, copy, id, sig)."""
    lens = np.array([len(r["sig"]) for r in rows], "<i8")
    rows = [r | {"id": r["id"] or 0, "no_id": r["id"] is None} for r in rows]
    cols = [np.array([r[c] for r in rows], "<i8") for c in _PACKED]
    return b"".join([len(rows).to_bytes(8, "little"), *(x.tobytes() for x in (*cols, lens)), *(r["sig"] for r in rows)])


def unpack_block(blob: bytes) -> list[dict]:
    k = int.from_bytes(blob[:8], "little")
    *cols, lens = (np.frombuffer(blob, "<i8", k, 8 + 8 * k * i).tolist() for i in range(len(_PACKED) + 1))
    ends = (8 + 8 * k * (len(_PACKED) + 1) + np.cumsum([0, *lens])).tolist()
    rows = [dict(zip(_PACKED, r, strict=True)) | {"sig": blob[x:y]} for r, x, y in zip(zip(*cols, strict=True), ends, ends[1:], strict=False)]
    return [r | {"id": None} if r.pop("no_id") else r for r in rows]


class NearDuplicates:
    """The join over ``docs``; ``split`` cuts a text's bytes into words."""

    def __init__(self, docs: DataFrame, split, width: int, m: Measure, id_col: str = "doc_id", text_col: str = "text"):
        self.spark, self.m, self.split, self.width = small_batches(docs).sparkSession, m, split, width
        self.docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(id_col, text_col).alias("copy"), text_bytes(text_col).alias("text"))
        parts = shuffle_parts(self.spark)
        found = self.docs.mapInArrow(_features(split, width, m, parts), DEALT)
        dealt = found.repartition(parts, "bucket").sortWithinPartitions("bucket")
        self.dealt = written(dealt.mapInArrow(_join_buckets, DEALT).drop("blob"), "dealt")
        self.rows = self.dealt.filter("other is null").select("doc_id", "copy", "n", "node", "node2")
        stars = self.dealt.filter("other is not null")
        wanted = stars.select("node", "node2").union(stars.select("other", "other2")).distinct()
        first = self.dealt.filter("other is null").groupBy("node", "node2").agg(F.min(F.struct("doc_id", "copy", "n")).alias("f"), F.max("sig").alias("sig"))
        nodes = written(first.join(wanted, ["node", "node2"], "left_semi").select("node", "node2", "f.*", "sig"), "nodes")
        self.clashes = self._clashes(nodes)
        self.nodes = self._short(nodes, "node").select("node", "doc_id", "copy", "n", "sig")
        self.full = self._short(nodes.select("node", "node2", F.col("node").alias("first")), "node").select("node", "first", "node2")
        found = self._short(self._short(stars, "node"), "other")
        mine = found.groupBy(F.col("node").alias("centre"), F.col("other").alias("node")).agg(F.max(F.coalesce("copy", F.lit(0))).alias("top"), F.sum("shared").alias("shared"))
        self.stars = written(mine, "stars")
        self.local = written(found.filter("copy IS NULL").select(F.col("node").alias("mid"), F.col("other").alias("node")).distinct(), "local")

    @staticmethod
    def _clashes(nodes: DataFrame) -> DataFrame | None:
        """A node goes by the first half of its fingerprint. Nodes whose first half another has get a new number each (node, node2, short)."""
        twice = nodes.groupBy("node").agg(F.count("*").alias("k")).filter("k > 1").select("node")
        if twice.isEmpty():
            return None
        same, seed = nodes.join(twice, "node", "left_semi").select("node", "node2"), 0
        while True:
            new = written(same.select("node", "node2", F.xxhash64(F.lit(seed), "node", "node2").alias("short")), "clashes")
            taken = nodes.select(F.col("node").alias("short")).union(new.select("short")).groupBy("short").agg(F.count("*").alias("k"))
            if taken.filter("k > 1").join(new, "short", "left_semi").isEmpty():
                return new
            seed += 1

    def _short(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` with the number of a node in column ``name``, by which nodes go from here on."""
        if self.clashes is None:
            return df
        c = self.clashes.select(F.col("node").alias("__a"), F.col("node2").alias("__b"), "short")
        out = df.join(c, (df[name] == c["__a"]) & (df[f"{name}2"] == c["__b"]), "left")
        return out.withColumn(name, F.coalesce("short", name)).select(*df.columns)

    def with_texts(self, members: DataFrame) -> DataFrame:
        """members (copy, id) and the text (zstandard) of their documents, in a scan that drops other documents before the shuffle."""
        held = self.spark.sparkContext.broadcast(bit_field(members, "copy"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import zstandard

            f, pack = held.value, zstandard.ZstdCompressor(level=1).compress
            seen: set[tuple] = set()  # equal rows: one of a task goes on
            for b in batches:
                pick, texts, ids = [], b.column("text"), b.column("doc_id")
                for i in np.flatnonzero(hits(f, b.column("copy").to_numpy())).tolist():
                    k = (b.column("copy")[i].as_py(), ids[i].as_py())
                    if k not in seen:
                        pick.append(i)
                        if len(seen) < SEEN:
                            seen.add(k)
                at = pa.array(pick, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("copy").take(at), ids.take(at), pa.array([pack(texts[i].as_py()) for i in pick], pa.binary())], names=["copy", "id", "text"])

        docs = self.docs.mapInArrow(run, "copy long, id long, text binary")
        return members.join(docs, (members["copy"] == docs["copy"]) & members["id"].eqNullSafe(docs["id"])).drop("copy", "id")

    def survivors(self, members: DataFrame) -> DataFrame:
        """The members (block string, node) that may link with another of their block, by size and bitmap."""
        m = self.m

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows, block = {}, None

            def give() -> pa.RecordBatch:
                use = [rows[k] for k in sorted(rows)]
                rows.clear()
                stay = [use[i] for i in tree_survivors([r["n"] for r in use], [r["sig"] for r in use], m)]
                return _survivors([(block, r["node"], None, None, r["copy"], r["id"]) for r in stay])

            for b in batches:
                for r in b.to_pylist():
                    if r["block"] != block:
                        yield give()
                        block = r["block"]
                    rows[r["node"]] = r
            yield give()
            release()

        dealt = members.join(self.nodes, "node").select("block", "node", "n", "copy", F.col("doc_id").alias("id"), "sig")
        dealt = dealt.repartition("block").sortWithinPartitions("block")
        return written(dealt.mapInArrow(run, SURVIVORS), "survivors")

    def pair_survivors(self, pairs: DataFrame) -> DataFrame:
        """The members of pairs of packed blocks (block, a, b: payloads; b null: a with itself) that may link across, by size and bitmap."""
        m = self.m

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    rows = unpack_block(r["a"])
                    side = None if r["b"] is None else [0] * len(rows)
                    if side is not None:
                        rows += unpack_block(r["b"])
                        side += [1] * (len(rows) - len(side))
                    stay = tree_survivors([x["n"] for x in rows], [x["sig"] for x in rows], m, side, [x["comp"] for x in rows])
                    yield _survivors([(r["block"], rows[i]["node"], side and side[i], rows[i]["comp"], rows[i]["copy"], rows[i]["id"]) for i in stay])
            release()

        return written(pairs.mapInArrow(run, SURVIVORS), "survivors")

    def block_links(self, members: DataFrame) -> DataFrame:
        """a, b: links within blocks of what ``survivors`` (nodes) or ``pair_survivors`` (components so far) left."""
        split, width, m = self.split, self.width, self.m

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import zstandard

            unpack = zstandard.ZstdDecompressor().decompress
            rows, block = {}, None

            def give() -> pa.RecordBatch:
                use = [rows[k] for k in sorted(rows)]
                rows.clear()
                got = []
                sides = None if not use or use[0]["side"] is None else [r["side"] for r in use]
                known = None if not use or use[0]["comp"] is None else [r["comp"] for r in use]
                if len(use) > 1 and not (known and len(set(known)) == 1):
                    got = connected(tree_links([shingle_set(split(unpack(r["text"])), width) for r in use], m, sides, known), known or list(range(len(use))))
                name = "node" if not use or known is None else "comp"
                return pa.RecordBatch.from_arrays([pa.array([use[i][name] for i, _ in got], pa.int64()), pa.array([use[j][name] for _, j in got], pa.int64())], names=["a", "b"])

            for b in batches:
                for r in b.to_pylist():
                    if r["block"] != block:
                        yield give()
                        block = r["block"]
                    rows[r["node"], r["side"] or 0] = r
            yield give()
            release()

        dealt = self.with_texts(members).select("block", "node", "side", "comp", "text").repartition("block").sortWithinPartitions("block")
        return dealt.mapInArrow(run, "a long, b long")

    @staticmethod
    def sized(groups: DataFrame, *keys: str) -> DataFrame:
        """keys, k (members), total (shingles), blocks of groups (keys, n)."""
        size = groups.groupBy(*keys).agg(F.count("*").alias("k"), F.sum("n").alias("total"))
        return size.select(*keys, "k", "total", _blocks("k", "total").alias("blocks"))

    def labels(self) -> DataFrame:
        """node, comp: the component of each node that has links."""
        sizes = self.nodes.select("node", "n")
        best = self.stars.groupBy("node").agg(F.max(F.struct("shared", "centre"))["centre"].alias("centre"))
        chosen = written(best.join(sizes, "node").select("centre", "node", "n"), "chosen")
        size = written(self.sized(chosen, "centre"), "sizes")
        rest = spread(chosen, ["centre"], size.filter("blocks > 1").select("centre", "blocks")).select("centre", "node", _part().alias("part"))
        centres = size.select("centre", F.col("centre").alias("node"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"))
        members = rest.union(centres).select(F.concat_ws(".", "centre", "part").alias("block"), "node")
        labels = components(written(self.block_links(self.survivors(members)), "found"))

        # Stars that may hold pairs no block has seen, and are in several components: not those that were one block.
        # A member taken over from a task stands for its own star there: what range of components that has.
        comp = written(self.nodes.join(labels, "node", "left").select("node", "n", F.coalesce("comp", "node").alias("comp")), "comp")
        within = self.local.join(comp, "node").groupBy("mid").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
        mine = self.stars.select("centre", "node", "top").union(self.stars.select("centre", F.col("centre").alias("node"), F.lit(0).alias("top")).distinct())
        mine = mine.join(comp, "node").join(within, (F.col("top") == 1) & (F.col("node") == F.col("mid")), "left")
        span = mine.groupBy("centre").agg(F.min(F.least("comp", "low")).alias("low"), F.max(F.greatest("comp", "high")).alias("high"), F.count("mid").alias("below"), (F.count("*") - 1).alias("k"))
        whole = size.select("centre", F.col("k").alias("chosen"), F.col("blocks").alias("b"))
        open_ = span.filter("low < high").join(whole, "centre", "left").filter("below > 0 OR NOT coalesce(k = chosen AND b = 1, false)").select("centre")
        open_ = written(open_, "open")
        if open_.isEmpty():
            return labels
        # Stars with their centres in one component overlap: they are taken as one group.
        open_ = written(open_.join(comp.select(F.col("node").alias("centre"), F.col("comp").alias("all")), "centre"), "open")
        star = written(spread(self.stars, ["centre"], open_).filter("all IS NOT NULL").select("all", "node", "top").distinct(), "star")
        below = star.filter("top = 1").select("all", F.col("node").alias("mid")).join(self.local, "mid").select("all", "node")
        group = star.select("all", "node").union(below).union(open_.select("all", F.col("centre").alias("node"))).distinct()
        group = written(group.join(comp, "node").select(F.col("all").alias("centre"), "node", "n", "comp"), "groups")
        more = written(self.block_links(self.pair_survivors(self.pairs(group))), "found")
        if more.isEmpty():
            return labels
        after = components(more).select(F.col("node").alias("was"), F.col("comp").alias("now"))
        return comp.join(after, comp.comp == after.was, "left").select("node", F.coalesce("now", "comp").alias("comp"))

    def pairs(self, group: DataFrame) -> DataFrame:
        """block, a, b: pairs of packed blocks of a star's members (centre, node, n, comp) that may hold a link between components."""
        per = self.sized(group, "centre", "comp")
        own = (F.col("k") * 2 >= BLOCK_NODES) | (F.col("total") * 2 >= BLOCK_SHINGLES)
        per = written(per.withColumn("own", own), "comps")
        own = per.filter("own").select("centre", "comp", "blocks")
        pool = per.filter("NOT own").groupBy("centre").agg(F.sum("k").alias("k"), F.sum("total").alias("total"), F.count("*").alias("comps"))
        pool = written(pool.select("centre", "comps", _blocks("k", "total").alias("blocks")), "pool")
        wide = per.filter("NOT own").select("centre", "comp").join(pool.filter("blocks > 1").select("centre", "blocks"), "centre").select("centre", "comp", "blocks", F.lit(False).alias("own"))
        dealt = spread(group, ["centre", "comp"], written(own.withColumn("own", F.lit(True)).union(wide), "wide"))
        only = F.when(F.coalesce("own", F.lit(False)), F.col("comp"))
        dealt = dealt.join(self.nodes.select("node", "copy", F.col("doc_id").alias("id"), "sig"), "node")
        dealt = dealt.select(_block_name(only, _part()).alias("block"), "centre", "node", "n", only.alias("only"), "comp", "copy", "id", "sig")

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows: list[dict] = []

            def give() -> pa.RecordBatch:
                some = [rows[0]] if rows else []
                cols = [[r["block"] for r in some], [r["centre"] for r in some], [r["only"] for r in some], [min(r["n"] for r in rows) for _ in some], [max(r["n"] for r in rows) for _ in some], [pack_block(rows) for _ in some]]
                rows.clear()
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), *[pa.int64()] * 4, pa.binary()), strict=True)], names=["block", "centre", "comp", "low", "high", "payload"])

            for b in batches:
                for r in b.to_pylist():
                    if rows and r["block"] != rows[0]["block"]:
                        yield give()
                    rows.append(r)
            yield give()
            release()

        packed = written(dealt.repartition("block").sortWithinPartitions("block", "n", "node").mapInArrow(pack, PACKED), "packed")
        blocks = packed.drop("payload")
        # Blocks of small components meet themselves, each other and those of large components; of these, different ones meet.
        mixed = blocks.filter("comp IS NULL")
        one = mixed.join(pool.filter("comps > 1").select("centre"), "centre", "left_semi").select(F.col("block").alias("x"), F.lit(None).cast("string").alias("y"))
        x, y = mixed.alias("x"), blocks.alias("y")
        fit = (F.col("x.high") * self.m.den >= F.col("y.low") * self.m.num) & (F.col("y.high") * self.m.den >= F.col("x.low") * self.m.num)
        two = x.join(y, (F.col("x.centre") == F.col("y.centre")) & (F.col("y.comp").isNotNull() | (F.col("x.block") < F.col("y.block"))) & fit).select(F.col("x.block").alias("x"), F.col("y.block").alias("y"))
        p, q = own.alias("p"), own.alias("q")
        large = p.join(q, (F.col("p.centre") == F.col("q.centre")) & (F.col("p.comp") < F.col("q.comp"))).select(F.col("p.centre").alias("centre"), F.col("p.comp").alias("c1"), F.col("p.blocks").alias("b1"), F.col("q.comp").alias("c2"), F.col("q.blocks").alias("b2"))
        large = large.select("*", F.explode(F.sequence(F.lit(0), F.col("b1") - 1)).alias("i")).select("*", F.explode(F.sequence(F.lit(0), F.col("b2") - 1)).alias("j"))
        large = large.select(_block_name(F.col("c1"), F.col("i")).alias("x"), _block_name(F.col("c2"), F.col("j")).alias("y"))
        both = one.union(two).union(large)
        a = packed.select(F.col("block").alias("x"), F.col("payload").alias("a"), F.col("low").alias("l1"), F.col("high").alias("h1"))
        b = packed.select(F.col("block").alias("y"), F.col("payload").alias("b"), F.col("low").alias("l2"), F.col("high").alias("h2"))
        ready = both.join(a, "x").join(b, "y", "left").filter("y IS NULL OR b IS NOT NULL")
        ready = ready.filter(F.expr(f"y IS NULL OR h1 * {self.m.den} >= l2 * {self.m.num} AND h2 * {self.m.den} >= l1 * {self.m.num}"))
        return ready.select(F.concat_ws("|", "x", "y").alias("block"), "a", "b").repartition(shuffle_parts(self.spark), "block")

    def classes(self) -> DataFrame:
        """doc_id, copy, n, component_id (the smallest id that links reach), kept (the copy that stays) for each row."""
        known = self.full.join(self.labels(), "node").select(F.col("first").alias("node"), "node2", "comp")
        best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "copy"))
        some = self.rows.filter("n > 0").groupBy("node", "node2").agg(best.alias("best"))
        some = written(some.join(known, ["node", "node2"], "left"), "best")
        linked = some.filter("comp IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64("node2"), F.lit(SALTS)).cast("int"))
        least = linked.groupBy("comp", "salt").agg(F.min("best").alias("b")).groupBy("comp").agg(F.min("b").alias("b"), F.collect_list("salt").alias("salts"))  # SALTS rows of a component at most
        own = linked.join(least.select("comp", "b", F.explode("salts").alias("salt")), ["comp", "salt"]).select("node", "node2", "b")
        own = own.union(some.filter("comp IS NULL").select("node", "node2", F.col("best").alias("b")))
        full = self.rows.filter("n > 0").join(own, ["node", "node2"]).select("doc_id", "copy", "n", F.col("b.doc_id").alias("component_id"), F.col("b.copy").alias("kept"))
        return full.union(self.rows.filter("n = 0").select("doc_id", "copy", "n", F.col("doc_id").alias("component_id"), F.col("copy").alias("kept")))


SURVIVORS = "block string, node long, side int, comp long, copy long, id long"


def _survivors(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int32(), *[pa.int64()] * 3)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["block", "node", "side", "comp", "copy", "id"])


def _blocks(k: str, total: str) -> Column:
    return F.greatest(F.ceil(F.col(k) / BLOCK_NODES), F.ceil(F.col(total) / BLOCK_SHINGLES)).cast("int")


def _part() -> Column:
    """The block of a node among ``blocks`` (null: one)."""
    return F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1))).cast("int")


def _block_name(comp: Column, part: Column) -> Column:
    """Name of a block of a star in the second round: of one component, or of small ones."""
    return F.concat_ws(".", "centre", F.coalesce(comp.cast("string"), F.lit("-")), part)


def blank_words(text: bytes) -> list[bytes]:
    """A-Z lower-cased; words are runs of what isn't ASCII white space."""
    return text.lower().split()


def jaccard_components(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs``: components of documents with J >= num / den.

    A text of fewer words than ``width`` has one shingle, of all its words. Null and empty texts, and
    those without words, have none and are linked with nothing: their component is their own id. Texts
    are taken whole, however long. Repeated rows give a row each. Null ids are in no one's way: a
    component's id is the smallest id that isn't null (null if there is none). An empty table gives no
    rows. Other columns aren't read.
    """
    found = NearDuplicates(docs, blank_words, width, Measure(num, den), id_col, text_col)
    return found.classes().select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates: one row of each component stays, every column of it.

    It is the row of the smallest id (null ids last), and among rows of that id the one of the smallest
    hash of id and text; rows are told apart by that hash, so different texts of one id are judged apart.
    Of rows equal in id and text the smallest by its other columns stays. Texts without words are linked
    with nothing and stay, every row. Only rows that a field of bits takes for possible copies are
    shuffled with their texts.
    """
    names = docs.columns
    found = NearDuplicates(docs, blank_words, width, Measure(num, den), id_col, text_col)
    rows = written(found.classes().filter("n > 0").groupBy(F.col("doc_id").alias("id"), "copy", "kept").agg(F.count("*").alias("rows")), "judged")
    gone = rows.filter("copy <> kept").select("id", "copy")
    again = rows.filter("copy = kept AND rows > 1").select("id", "copy")
    marked = docs.withColumn("__copy", F.xxhash64(id_col, text_col))
    field = bit_field(gone.union(again).select("copy"), "copy")
    clear = in_field(marked, "__copy", field, inside=False).select(*names)

    def same(table: DataFrame) -> Column:
        return (F.col("__copy") == table["copy"]) & F.col(id_col).cast("long").eqNullSafe(table["id"])

    doubtful = in_field(marked, "__copy", field).join(gone, same(gone), "left_anti")
    if again.isEmpty():
        return clear.union(doubtful.select(*names))
    once = doubtful.join(again, same(again), "left_anti").select(*names)
    repeated = doubtful.join(again, same(again), "left_semi")
    others = [c for c in names if c not in (id_col, text_col)]
    first = repeated.groupBy("__copy").agg(F.min(F.struct(id_col, text_col, *others)).alias("r")).select(*[F.col("r")[c].alias(c) for c in names])
    return clear.union(once).union(first)


def op4_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 9, 10)


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(3, len(w)) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
sig AS (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS k FROM s GROUP BY doc_id),
rep AS (SELECT k, min(doc_id) AS r FROM sig GROUP BY k),
t AS (SELECT s.doc_id, g, n FROM s JOIN rep ON s.doc_id = rep.r JOIN n ON s.doc_id = n.doc_id),
common AS (SELECT g FROM t GROUP BY g HAVING count(*) > 1),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM (SELECT * FROM t SEMI JOIN common USING (g)) a JOIN (SELECT * FROM t SEMI JOIN common USING (g)) b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p UNION SELECT r, r FROM rep),
c AS (SELECT a AS x, b AS y FROM e UNION SELECT c.x, e.b FROM c JOIN e ON c.y = e.a),
m AS (SELECT x, min(y) AS least_id FROM c GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.least_id, d.doc_id) AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN sig ON d.doc_id = sig.doc_id LEFT JOIN rep ON sig.k = rep.k LEFT JOIN m ON m.x = rep.r
"""
