"""Filling containers of fixed capacity with texts, measured in tokens of a public tokenizer.

Method: Karmarkar-Karp multiway differencing. Every text starts as a partial partition of its own; the
two partial partitions with the largest imbalances are merged with opposing order, the largest window
of one with the smallest of the other, until one is left. Its windows are nearly equal. The number of
windows starts at the least possible and rises while a window exceeds the capacity.

Texts are dealt into blocks of bounded size by a hash, and each block is packed by one task; a block
wastes less than a few containers, and blocks hold thousands of texts.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import bpe
from quillgraph.session import cut

#: Texts that one task packs at once, on average.
BLOCK = 4096


def difference(sizes: np.ndarray, windows: int) -> tuple[np.ndarray, np.ndarray]:
    """Assign items to ``windows``; gives each item's window and the sums of the windows.

    A partial partition is held as its non-empty windows, sorted by sum, largest first; each is a node
    of a tree of merges, whose leaves are items.
    """
    n = len(sizes)
    left, right = np.full(2 * n + 1, -1, np.int64), np.full(2 * n + 1, -1, np.int64)
    free = n
    # Imbalance is the largest sum less the smallest, which is 0 while a window is empty.
    parts = {i: (np.array([s], np.int64), np.array([i], np.int64)) for i, s in enumerate(sizes)}
    heap = [(-int(s) if windows > 1 else 0, i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    name = n
    while len(heap) > 1:
        _, x = heapq.heappop(heap)
        _, y = heapq.heappop(heap)
        (a, i), (b, j) = parts.pop(x), parts.pop(y)
        over = len(a) + len(b) - windows
        if over > 0:  # the smallest windows of both meet in opposing order; the rest met empty ones
            p, q = len(a) - over, len(b) - over
            nodes = np.arange(free, free + over)
            left[nodes], right[nodes] = i[p:], j[q:][::-1]
            free += over
            sums = np.concatenate([a[:p], b[:q], a[p:] + b[q:][::-1]])
            ids = np.concatenate([i[:p], j[:q], nodes])
        else:
            sums, ids = np.concatenate([a, b]), np.concatenate([i, j])
        order = np.argsort(-sums, kind="stable")
        sums, ids = sums[order], ids[order]
        parts[name] = (sums, ids)
        heapq.heappush(heap, (-int(sums[0] - (sums[-1] if len(sums) == windows else 0)), name))
        name += 1
    sums, ids = parts.popitem()[1] if n else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    window = np.full(2 * n + 1, -1, np.int64)
    window[ids] = np.arange(len(ids))
    for node in range(free - 1, n - 1, -1):  # parents come after their children
        window[left[node]] = window[right[node]] = window[node]
    return window[:n], sums


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item. Sizes are from 1 to ``capacity``. No container exceeds it.

    The number of containers rises from the least possible by the excess of the fullest; then the
    least number that was not yet seen to fail is tried, halving the gap.
    """
    if not len(sizes):
        return np.zeros(0, np.int64)
    low = max(
        math.ceil(int(sizes.sum()) / capacity),
        int((sizes > capacity // 2).sum() if capacity % 2 else (sizes > capacity / 2).sum()),
        1,
    ) - 1
    k = low + 1
    while True:
        best, sums = difference(sizes, k)
        if sums.max() <= capacity:
            break
        low, k = k, min(max(k + 1, math.ceil(k * float(sums.max()) / capacity)), len(sizes))
    while k - low > 1:
        middle = (low + k) // 2
        window, sums = difference(sizes, middle)
        if sums.max() <= capacity:
            best, k = window, middle
        else:
            low = middle
    return best


def _pack_block(capacity: int):
    def of(table: pa.Table) -> pa.Table:
        table = table.sort_by([("tokens", "descending"), ("no", "ascending")])  # whatever order rows arrive in
        sizes = table.column("tokens").to_numpy().astype(np.int64)
        window = pack(sizes, capacity)
        order = np.lexsort((np.arange(len(sizes)), window))
        ends = np.zeros(len(sizes), np.int64)
        total = np.cumsum(sizes[order])
        first = np.r_[True, window[order][1:] != window[order][:-1]]
        base = (total - sizes[order])[first][np.cumsum(first) - 1] if len(sizes) else total
        ends[order] = total - sizes[order] - base
        return table.select(["block", "no"]).append_column("window", pa.array(window)).append_column("at", pa.array(ends))

    return of


def containers(sized: DataFrame, id_column: str, capacity: int, block: int = BLOCK) -> DataFrame:
    """(container, at, id, piece, begin, tokens): where every text, or piece of one, lies.

    ``sized`` has an id and ``tokens``. A text of more than ``capacity`` is cut into pieces of exactly
    the capacity, which fill containers of their own, and a last piece, packed with the other texts;
    no other text is split. ``begin`` is where the piece begins in its text, ``at`` where it lies in
    its container, both in tokens. A text without tokens comes out with container and at NULL, in no
    container. Repeated rows are texts of their own; ids may be NULL. No rows give no containers.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    rows = cut(
        sized.select(
            F.col(id_column).alias("_id"),
            F.coalesce("tokens", F.lit(0)).cast("long").alias("_t"),
        ).withColumn("no", F.monotonically_increasing_id()),
    )
    items = rows.select("no", (F.col("_t") % capacity).alias("tokens")).where("tokens > 0")
    blocks = max(1, math.ceil(items.count() / block))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("no"), F.lit(blocks)))
    # Blocks are a few bytes a text but seconds of work, so tasks are counted by blocks, not by bytes: a
    # number that is named is not coalesced.
    dealt = dealt.repartition(blocks, "block")
    packed = dealt.groupBy("block").applyInArrow(_pack_block(capacity), "block long, no long, window long, at long")
    last = rows.join(packed, "no").select(
        F.concat_ws("-", F.lit("b"), "block", "window").alias("container"),
        "at",
        F.col("_id").alias(id_column),
        F.floor(F.col("_t") / capacity).cast("int").alias("piece"),
        (F.col("_t") - F.col("_t") % capacity).alias("begin"),
        (F.col("_t") % capacity).alias("tokens"),
    )
    whole = rows.where(F.col("_t") >= capacity).withColumn(
        "piece",
        F.explode(F.sequence(F.lit(0), F.floor(F.col("_t") / capacity).cast("int") - 1)),
    )
    full = whole.select(
        F.concat_ws("-", F.lit("f"), "no", "piece").alias("container"),
        F.lit(0).cast("long").alias("at"),
        F.col("_id").alias(id_column),
        "piece",
        (F.col("piece") * F.lit(capacity).cast("long")).alias("begin"),
        F.lit(capacity).cast("long").alias("tokens"),
    )
    zero = F.lit(0).cast("long")
    empty = rows.where("_t = 0").select(
        F.lit(None).cast("string").alias("container"), F.lit(None).cast("long").alias("at"), F.col("_id").alias(id_column), F.lit(0).alias("piece"), zero.alias("begin"), zero.alias("tokens")
    )
    return last.unionByName(full).unionByName(empty)


def packed_documents(documents: DataFrame, capacity: int = 2048, path: str | None = None) -> DataFrame:
    """``containers`` of the texts of ``documents``, in tokens of a public tokenizer."""
    return containers(bpe.count_column(documents, path=path), "doc_id", capacity)
