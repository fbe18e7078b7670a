"""All pairs of similar sets, by sorted sketch forests.

Method: every set gets minhash signatures in many independent trees. In each tree the signatures are
sorted lexicographically, and sets whose signatures share a prefix are compared: shallow prefixes
where few sets share them, deeper ones where many do. The depth never exceeds the one at which the
number of trees gives the target recall at the threshold, so crowded neighbourhoods lose no more than
that; the others lose less. A neighbourhood that is crowded at that depth is planted anew, as a forest of
its own with other hash functions, and so on; what is still crowded after some rounds, sets that are
indeed all alike, is compared block by block. Candidates are verified exactly.

Trees carry a set's items as 16-bit codes, which never hide a common item, so that most candidates are
refused where they are found. A set of very many items carries none: its signature is a minimum over its
rows, and its candidates are those of a fitting size. Sets with the same items are one class; classes are
compared once, and copies are expanded at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.blocks import pairs_within
from quillgraph.llm.cooccurrence import baskets
from quillgraph.session import cut

#: Longest prefix that is compared, and the chance of finding a pair at the threshold by such prefixes
#: alone. Both together give the number of trees.
DEPTH = 3
RECALL = 0.9995
#: A neighbourhood of up to so many sets is compared without going deeper.
CROWD = 96
#: Sets held in memory at once, and sets of one deepest neighbourhood that a task compares itself.
HELD = 60_000
#: Sets of more items do not carry them along in the trees.
CARRIED_ITEMS = 4096
#: Forests that are planted, one within the crowded neighbourhoods of the other.
ROUNDS = 3
#: Side of the blocks in which a crowded neighbourhood is compared.
SIDE = 512
_MIX = np.uint64(0x9E3779B97F4A7C15)


def tree_count(threshold: float, recall: float = RECALL, depth: int = DEPTH) -> int:
    """Trees needed so that two sets at the threshold share a prefix of ``depth`` in one of them."""
    if threshold >= 1:
        return 1
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**depth)))


def _mixed(values: np.ndarray, seed: int) -> np.ndarray:
    """32-bit hashes of 64-bit hashes, another function per seed (finaliser of splitmix64)."""
    x = values + np.uint64(((seed + 1) * int(_MIX)) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(32)).astype(np.uint32)


_TREE_ROW = "tree int, s1 int, s2 int, s3 int, no long, n int, items array<smallint>"
_NAMES = ["tree", "s1", "s2", "s3", "no", "n", "items"]


def _plant(trees: int, turn: int):
    """Rows (base, no, n, hashes) to one row per tree, with the tree's signature of ``DEPTH`` minhashes
    and 16 bits of every hash. ``base`` is the neighbourhood that the forest grows in; trees of different
    ones have different numbers, and should two share one, some sets are compared for nothing."""

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(3)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            first, values = offsets[0], lists.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            values, starts = values[first : offsets[-1]], offsets[:-1] - first
            short = pa.array((values >> np.uint64(48)).astype(np.uint16).view(np.int16))
            items = pa.ListArray.from_arrays(pa.array((offsets - first).astype(np.int32)), short)
            base = batch.column(0).to_numpy()
            for tree in range(trees):
                signs = [
                    pa.array(np.minimum.reduceat(_mixed(values, _seed(turn, tree, k)), starts).view(np.int32))
                    for k in range(DEPTH)
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(base ^ np.int32(tree)), *signs, batch.column(1), batch.column(2), items],
                    names=_NAMES,
                )

    return plant


def _seed(turn: int, tree: int, k: int) -> int:
    return (turn * 1000 + tree) * DEPTH + k


def _row_minima(functions: list[int]):
    """Rows (no, hash) to (no, minima): the least value of every hash function over rows of a batch."""

    def minima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            no, values = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            order = np.argsort(no, kind="stable")
            own, starts = np.unique(no[order], return_index=True)
            values = values[order]
            least = np.stack([np.minimum.reduceat(_mixed(values, f), starts) for f in functions], 1).astype(np.int64)
            flat = pa.array(least.ravel())
            ends = pa.array(np.arange(0, len(flat) + 1, len(functions), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.ListArray.from_arrays(ends, flat)], names=["no", "minima"])

    return minima


def _large_trees(rows: DataFrame, base: DataFrame, trees: int, turn: int) -> DataFrame:
    """Tree rows of the large sets of ``base`` (base, no, n) from their ``rows`` (no, item). A set's items
    are never together: each task gives minima over the rows it has, and these are combined."""
    functions = [_seed(turn, tree, k) for tree in range(trees) for k in range(DEPTH)]
    hashed = rows.join(base.select("no").distinct(), "no", "left_semi").select("no", F.xxhash64("item").alias("hash"))
    parts = hashed.mapInArrow(_row_minima(functions), "no long, minima array<long>")
    least = parts.groupBy("no").agg(F.array(*[F.min(F.col("minima")[i]) for i in range(len(functions))]).alias("minima"))
    signed = F.transform("minima", lambda v: F.when(v >= 2**31, v - 2**32).otherwise(v).cast("int"))
    own = base.join(least.select("no", signed.alias("s")), "no")
    tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))
    each = own.select("base", "no", "n", "s", tree.alias("t"))
    sign = lambda k: F.element_at("s", F.col("t") * DEPTH + k + 1).alias(f"s{k + 1}")
    nothing = F.array(F.lit(0).cast("smallint")).alias("items")
    return each.select(F.col("base").bitwiseXOR(F.col("t")).alias("tree"), *[sign(k) for k in range(DEPTH)], "no", "n", nothing)


class _Sets:
    """Rows of the trees as arrays; ``cols`` are tree, s1, s2, s3, no, n; ``values`` the 16-bit items."""

    def __init__(self, cols: list[np.ndarray], starts: np.ndarray, values: np.ndarray):
        self.cols, self.starts, self.values = cols, starts, values

    @staticmethod
    def of(batch: pa.RecordBatch) -> _Sets:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
        offsets = batch.column(6).offsets.to_numpy().astype(np.int64)
        values = batch.column(6).values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
        return _Sets(cols, offsets - offsets[0], values)

    def __len__(self) -> int:
        return len(self.cols[0])

    def part(self, a: int, b: int) -> _Sets:
        s = self.starts[a : b + 1]
        return _Sets([c[a:b] for c in self.cols], s - s[0], self.values[s[0] : s[-1]])

    @staticmethod
    def joined(parts: list[_Sets]) -> _Sets:
        if len(parts) == 1:
            return parts[0]
        lengths = np.concatenate([np.diff(p.starts) for p in parts])
        return _Sets(
            [np.concatenate([p.cols[i] for p in parts]) for i in range(6)],
            np.concatenate([[0], np.cumsum(lengths)]),
            np.concatenate([p.values for p in parts]),
        )


class _Verifier:
    """Similarity of pairs of rows by their 16-bit items, which never hide a common one. Rows of large sets,
    which carry none, fit whatever has a fitting size."""

    def __init__(self, sets: _Sets, threshold: float):
        self.t, self.n = threshold, sets.cols[5].astype(np.int64)
        self.length = np.diff(sets.starts)  # repeated codes stay, so these are the sizes
        self.loose = self.length < self.n
        self.starts, self.values = sets.starts[:-1], sets.values.view(np.uint16).astype(np.uint64)
        bits = np.uint64(1) << (self.values & np.uint64(63))
        more = np.uint64(1) << ((self.values >> np.uint64(6)) & np.uint64(63))
        self.bits = np.bitwise_or.reduceat(bits, self.starts) if len(self.n) else bits
        self.more = np.bitwise_or.reduceat(more, self.starts) if len(self.n) else more
        owner = np.repeat(np.arange(len(self.n), dtype=np.uint64), self.length)
        self.keys = (owner << np.uint64(16)) | self.values
        self.keys.sort()  # by owner, then by item

    def similar(self, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        np_, nq = self.n[p], self.n[q]
        need = self.t * (np_ + nq) / (1 + self.t) - 1e-6  # common items that reach the threshold
        keep = np.minimum(np_, nq) >= need
        p, q, need = p[keep], q[keep], need[keep]
        loose = self.loose[p] | self.loose[q]
        far, off = p[loose], q[loose]
        p, q, need = p[~loose], q[~loose], need[~loose]
        for b in (self.bits, self.more):  # every bit that the other lacks is an item that the other lacks
            x, y = b[p], b[q]
            keep = (self.n[p] - np.bitwise_count(x & ~y) >= need) & (self.n[q] - np.bitwise_count(y & ~x) >= need)
            p, q, need = p[keep], q[keep], need[keep]
        if not len(p):
            return far, off
        swap = self.length[p] > self.length[q]
        a, b = np.where(swap, q, p), np.where(swap, p, q)
        length = self.length[a]
        ends = np.cumsum(length)
        at = np.arange(ends[-1]) - np.repeat(ends - length - self.starts[a], length)
        wanted = (np.repeat(b, length).astype(np.uint64) << np.uint64(16)) | self.values[at]
        where = np.searchsorted(self.keys, wanted)
        hit = self.keys[np.minimum(where, len(self.keys) - 1)] == wanted
        common = np.add.reduceat(hit.astype(np.int64), ends - length)
        keep = common >= need
        return np.concatenate([p[keep], far]), np.concatenate([q[keep], off])


def _groups(sets: _Sets, floor: int) -> np.ndarray:
    """Where neighbourhoods begin: each row's depth is the least at which few share its prefix."""
    n = len(sets)
    change = np.zeros((DEPTH, n), bool)
    change[:, 0] = True
    differs = sets.cols[0][1:] != sets.cols[0][:-1]
    for d in range(DEPTH):
        differs = differs | (sets.cols[d + 1][1:] != sets.cols[d + 1][:-1])
        change[d, 1:] = differs
    begin, open_rows = np.zeros(n, bool), np.ones(n, bool)
    for d in range(DEPTH):
        starts = np.flatnonzero(change[d])
        size = np.repeat(np.diff(np.append(starts, n)), np.diff(np.append(starts, n)))
        final = open_rows & (size <= CROWD if d + 1 >= floor else False) if d + 1 < DEPTH else open_rows
        begin |= change[d] & final
        open_rows = open_rows & ~final
        # A finished neighbourhood is followed by a new one, whatever its depth.
        begin[1:] |= final[:-1] & change[d][1:]
    return np.flatnonzero(begin | change[0])


def _compare(sets: _Sets, floor: int, threshold: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
    verify = _Verifier(sets, threshold)
    starts = _groups(sets, floor)
    sizes = np.diff(np.append(starts, len(sets)))
    left, right = [], []

    def take(p: np.ndarray, q: np.ndarray) -> None:
        p, q = verify.similar(p, q)
        if len(p):
            left.append(sets.cols[4][p])
            right.append(sets.cols[4][q])

    for m in np.unique(sizes[(sizes > 1) & (sizes <= CROWD)]):
        i, j = np.triu_indices(m, 1)
        own = starts[sizes == m]
        for k in range(0, len(own), step := max(1, 2_000_000 // len(i))):
            base = own[k : k + step, None]
            take((base + i).ravel(), (base + j).ravel())
    for s, m in zip(starts[sizes > CROWD], sizes[sizes > CROWD]):
        for a in range(0, m, SIDE):
            for b in range(a, m, SIDE):
                i = np.arange(a, min(a + SIDE, m))
                j = np.arange(b, min(b + SIDE, m))
                p, q = np.repeat(i, len(j)), np.tile(j, len(i))
                if a == b:
                    p, q = p[p < q], q[p < q]
                take(s + p, s + q)
    return left, right


_FOUND = "a long, b long, tree int, s1 int, s2 int, s3 int, block int, no long, n int, items array<smallint>"
_FOUND_ARROW = pa.schema(
    [
        ("a", pa.int64()),
        ("b", pa.int64()),
        ("tree", pa.int32()),
        ("s1", pa.int32()),
        ("s2", pa.int32()),
        ("s3", pa.int32()),
    ]
    + [("block", pa.int32()), ("no", pa.int64()), ("n", pa.int32()), ("items", pa.list_(pa.int16()))]
)


def _harvest(threshold: float, held: int):
    """Sorted rows of the trees to pairs (a, b). Rows of a deepest neighbourhood that is too large for
    one task come out as they are, numbered by blocks, to be compared in the next stage."""

    def pairs(left: list[np.ndarray], right: list[np.ndarray]) -> pa.RecordBatch:
        x, y = np.concatenate(left), np.concatenate(right)
        both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
        nulls = [pa.nulls(len(both), f.type) for f in list(_FOUND_ARROW)[2:]]
        return pa.RecordBatch.from_arrays(
            [pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), *nulls],
            schema=_FOUND_ARROW,
        )

    def rest(sets: _Sets, first: int) -> pa.RecordBatch:
        block = ((first + np.arange(len(sets))) // held).astype(np.int32)
        items = pa.ListArray.from_arrays(pa.array(sets.starts.astype(np.int32)), pa.array(sets.values))
        none = pa.nulls(len(sets), pa.int64())
        c = [pa.array(x) for x in sets.cols]
        return pa.RecordBatch.from_arrays([none, none, *c[:4], pa.array(block), *c[4:], items], schema=_FOUND_ARROW)

    def harvest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[_Sets] = []
        # The neighbourhood that was too large to hold: its depth, its key, and rows given out so far.
        floor, crowded, given = 1, None, 0

        def key(sets: _Sets, row: int, depth: int) -> tuple:
            return tuple(int(c[row]) for c in sets.cols[: depth + 1])

        def closed(sets: _Sets, depth: int) -> int:
            """Rows before the last neighbourhood at a depth."""
            last = key(sets, len(sets) - 1, depth)
            same = np.ones(len(sets), bool)
            for c, v in zip(sets.cols, last):
                same &= c == v
            return int(len(sets) - same.sum())

        def settle(sets: _Sets, last: bool) -> tuple[list[pa.RecordBatch], _Sets | None]:
            nonlocal floor, crowded, given
            out: list[pa.RecordBatch] = []
            while len(sets):
                if crowded is not None:  # the head may belong to the crowded neighbourhood
                    same = np.ones(len(sets), bool)
                    for c, v in zip(sets.cols, crowded):
                        same &= c == v
                    head = int(same.sum())
                    if head < len(sets) or last:
                        if given:
                            out += [rest(sets.part(0, head), given)] if head else []
                        elif head:
                            found = _compare(sets.part(0, head), floor, threshold)
                            out += [pairs(*found)] if found[0] else []
                        sets, floor, crowded, given = sets.part(head, len(sets)), 1, None, 0
                        continue
                upto = len(sets) if last else closed(sets, floor)
                if upto:
                    found = _compare(sets.part(0, upto), floor, threshold)
                    out += [pairs(*found)] if found[0] else []
                    sets = sets.part(upto, len(sets))
                if last or len(sets) < held:
                    break
                if floor < DEPTH:  # go deeper within this neighbourhood
                    crowded = crowded or key(sets, 0, floor)
                    floor += 1
                    continue
                crowded = crowded if given else key(sets, 0, DEPTH)
                out.append(rest(sets, given))
                given += len(sets)
                return out, None
            return out, sets if len(sets) else None

        size = 0
        for batch in batches:
            if batch.num_rows:
                kept.append(_Sets.of(batch))
                size += batch.num_rows
            if size >= held:
                out, left = settle(_Sets.joined(kept), False)
                yield from out
                kept, size = ([left], len(left)) if left is not None else ([], 0)
        if kept:
            yield from settle(_Sets.joined(kept), True)[0]

    return harvest


def _compare_blocks(threshold: float):
    """One pair of blocks of a crowded neighbourhood; i = j means within one block."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        if not table.num_rows:
            return
        sets = _Sets.of(table.select(_NAMES).combine_chunks().to_batches(max_chunksize=table.num_rows)[0])
        block = table.column("block").to_numpy()
        verify, no = _Verifier(sets, threshold), sets.cols[4]
        first, second = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
        within = block.min() == block.max()
        for a in range(0, len(first), SIDE):
            for b in range(a if within else 0, len(second), SIDE):
                i, j = first[a : a + SIDE], second[b : b + SIDE]
                p, q = np.repeat(i, len(j)), np.tile(j, len(i))
                if within and a == b:
                    p, q = p[p < q], q[p < q]
                p, q = verify.similar(p, q)
                if len(p):
                    x, y = no[p], no[q]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))],
                        names=["a", "b"],
                    )

    return compare


def numbered_sets(lists: DataFrame) -> DataFrame:
    """(no, basket, n, x, y, items) of (basket, item, n) rows: every set with its sorted items and the 128
    bits x, y of them all.

    A set of more than ``CARRIED_ITEMS`` items is not brought together; its items are an empty array.
    """
    carried = F.when(F.col("n") <= CARRIED_ITEMS, F.col("item"))
    sets = lists.groupBy("basket", "n").agg(
        F.sort_array(F.collect_list(carried)).alias("items"),
        F.bit_xor(F.xxhash64("item")).alias("x"),
        F.bit_xor(F.xxhash64(F.lit(1), "item")).alias("y"),
    )
    return sets.select(F.monotonically_increasing_id().alias("no"), "basket", F.col("n").cast("int").alias("n"), "x", "y", "items")


def copies_of(sets: DataFrame) -> DataFrame:
    """(no, class_no, basket) of the sets of classes with more than one set: of the same size and the same
    128 bits. A class goes by its least number, and none is brought together."""
    of = ["n", "x", "y"]
    several = sets.groupBy(*of).agg(F.min("no").alias("class_no"), F.max("no").alias("_last"))
    several = several.where(F.col("class_no") != F.col("_last")).drop("_last")
    return sets.select("no", "basket", *of).join(several, of).select("no", "class_no", "basket")


def similar_classes(sets: DataFrame, rows: DataFrame | None, threshold: float, held: int = HELD) -> DataFrame:
    """(a, b), a < b: numbers of sets that may be similar, which all pairs at the threshold are with the
    target recall. ``sets`` has no, n and items; ``rows`` (no, item) those of large sets, if there are."""
    trees = tree_count(threshold)
    base = F.lit(0).alias("base")
    small = sets if rows is None else sets.where(F.col("n") <= CARRIED_ITEMS)
    source = small.select(base, "no", "n", F.transform("items", lambda i: F.xxhash64(i)).alias("hashes"))
    crowd = ["tree", "s1", "s2", "s3"]
    large = None if rows is None else sets.where(F.col("n") > CARRIED_ITEMS).select(base, "no", "n")
    near = None
    for turn in range(ROUNDS):
        forest = source.mapInArrow(_plant(trees, turn), _TREE_ROW)
        if large is not None:
            forest = forest.unionByName(_large_trees(rows, large, trees, turn))
        # By the first hash of a tree: a hot item can gather at most its share of one tree in a task.
        sorted_trees = forest.repartition("tree", "s1").sortWithinPartitions(*crowd)
        both = cut(sorted_trees.mapInArrow(_harvest(threshold, held), _FOUND))
        found = both.where(F.col("a").isNotNull()).select("a", "b")
        near = found if near is None else near.unionByName(found)
        left = both.where(F.col("no").isNotNull())
        if not left.limit(1).count():
            return near.distinct()
        # The codes of a crowd's sets, in the upper bits as hashes have them, are sets as alike as these.
        inner = F.xxhash64(*crowd).cast("int").alias("base")
        codes = F.transform("items", lambda i: F.shiftleft(i.cast("long"), 48))
        source = left.where(F.col("n") <= CARRIED_ITEMS).select(inner, "no", "n", codes.alias("hashes"))
        large = None if rows is None else left.where(F.col("n") > CARRIED_ITEMS).select(inner, "no", "n")
    blocks = left.groupBy(*crowd).agg(F.max("block").alias("_last"))
    cells = (
        left.join(blocks, crowd)
        .withColumn("_c", F.explode(F.sequence(F.lit(0), F.col("_last"))))
        .select(
            *crowd,
            F.least("block", "_c").alias("_i"),
            F.greatest("block", "_c").alias("_j"),
            "block",
            "no",
            "n",
            "items",
        )
    )
    more = cells.groupBy(*crowd, "_i", "_j").applyInArrow(_compare_blocks_grouped(threshold), "a long, b long")
    return near.unionByName(more).distinct()


def _compare_blocks_grouped(threshold: float):
    compare = _compare_blocks(threshold)

    def of(table: pa.Table) -> pa.Table:
        out = list(compare(iter(table.to_batches())))
        return pa.Table.from_batches(out) if out else pa.table(
            {"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())},
        )

    return of


class SimilarSets:
    """Similar sets among (basket, item, n) rows, each once, where n is the size of the basket.

    ``links`` (a, b), a < b, are numbers of similar classes; a class is all sets with the same items.
    """

    def __init__(self, lists: DataFrame, threshold: float, held: int = HELD):
        self.threshold = threshold
        self.sets = cut(numbered_sets(lists))
        self.copies = cut(copies_of(self.sets))
        again = self.copies.where(F.col("no") != F.col("class_no")).select("no")
        kinds = self.sets.select("no", "basket", "n", "items").join(again, "no", "left_anti")
        large = kinds.where(F.col("n") > CARRIED_ITEMS).select("basket", "no", "n")
        rows = None
        if large.limit(1).count():  # at most rows / CARRIED_ITEMS sets
            rows = cut(lists.join(large.select("basket", "no"), "basket").select("no", "item"))
        near = cut(similar_classes(kinds.select("no", "n", "items"), rows, threshold, held))
        # Only sets with a candidate are shuffled again.
        ends = near.select(F.col("a").alias("no")).unionByName(near.select(F.col("b").alias("no"))).distinct()
        items = cut(self.sets.join(ends, "no", "left_semi").select("no", "n", "items"))
        of = lambda end: items.select(F.col("no").alias(end), F.col("n").alias(f"n_{end}"), F.col("items").alias(f"items_{end}"))
        both = near.join(of("a"), "a").join(of("b"), "b")
        common = F.size(F.array_intersect("items_a", "items_b"))
        carried = F.greatest("n_a", "n_b") <= CARRIED_ITEMS
        exact = both.where(carried & self._enough(common)).select("a", "b")
        if rows is not None:
            exact = exact.unionByName(self._large(lists, cut(both.where(~carried).select("a", "b", "n_a", "n_b"))))
        self.links = cut(exact)

    def _enough(self, common: Column) -> Column:
        return common >= F.lit(self.threshold - 1e-9) * (F.col("n_a") + F.col("n_b") - common)

    def _large(self, lists: DataFrame, near: DataFrame) -> DataFrame:
        """Those of the candidates with a large set that are similar: common items are counted by joins on
        the candidate and the item, with nothing brought together."""
        ends = near.select(F.col("a").alias("no")).unionByName(near.select(F.col("b").alias("no"))).distinct()
        baskets_of = self.sets.select("no", "basket").join(ends, "no", "left_semi")
        rows = cut(lists.join(baskets_of, "basket").select("no", "item"))
        left = near.join(rows.withColumnRenamed("no", "a"), "a")
        shared = left.join(rows.withColumnRenamed("no", "b"), ["b", "item"])
        counts = shared.groupBy("a", "b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("common"))
        return counts.where(self._enough(F.col("common"))).select("a", "b")

    def pairs(self) -> DataFrame:
        """(a, b), a < b: every two baskets with similar sets; copies are expanded."""
        within = pairs_within(self.copies, "class_no", "basket").select("a", "b")
        ends = self.links.select(F.col("a").alias("no")).unionByName(
            self.links.select(F.col("b").alias("no")),
        ).distinct()
        firsts = self.sets.join(ends, "no", "left_semi").select(F.col("no").alias("class_no"), "basket")
        others = self.copies.where(F.col("no") != F.col("class_no")).select("class_no", "basket")
        members = cut(
            firsts.unionByName(others.join(ends.withColumnRenamed("no", "class_no"), "class_no", "left_semi")),
        )
        left = members.select(F.col("class_no").alias("a"), F.col("basket").alias("x"))
        right = members.select(F.col("class_no").alias("b"), F.col("basket").alias("y"))
        across = self.links.join(left, "a").join(right, "b").select(
            F.least("x", "y").alias("a"),
            F.greatest("x", "y").alias("b"),
        )
        return within.unionByName(across)

    def summary(self) -> DataFrame:
        """(basket, class_id, links): the smallest basket of the set's class and the number of other
        classes that are similar to it."""
        ends = self.links.select(F.col("a").alias("no")).unionByName(self.links.select(F.col("b").alias("no")))
        counts = ends.groupBy("no").agg(F.count(F.lit(1)).alias("links"))
        first = self.copies.groupBy(F.col("class_no").alias("no")).agg(F.min("basket").alias("class_id"))
        all_sets = self.sets.select("no", "basket").join(self.copies.select("no", "class_no"), "no", "left")
        of = all_sets.select("basket", F.coalesce("class_no", "no").alias("no"))
        return (
            of.join(first, "no", "left")
            .join(counts, "no", "left")
            .select("basket", F.coalesce("class_id", "basket").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
        )


def similar_reference_lists(citation: DataFrame, threshold: float = 0.6, held: int = HELD) -> SimilarSets:
    """Similar reference lists: sets of five or more different papers that one paper cites.

    NULL ends, citations of itself and repeated rows do not count; exactly the threshold is similar;
    empty tables, or none with such lists, give empty results; further columns are ignored.
    """
    rows = baskets(
        citation,
        "citing_paper_id",
        "cited_paper_id",
        5,
        F.col("citing_paper_id") != F.col("cited_paper_id"),
    )
    return SimilarSets(rows, threshold, held)
