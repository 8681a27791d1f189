"""Optimal length buckets over the global histogram, and token-budget batches inside them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.session import staged

#: Groups that a bucket's documents are dealt to by hash; batches run through them in order.
CHUNKS = 1024
#: Lengths up to this are told apart; above, lengths within a step that doubles with each
#: octave, at most 1/512 of the length, are taken together. So the histogram has a bounded size.
EXACT = 1024


def candidate(length: Column) -> Column:
    """The end of the histogram bin of ``length``."""
    step = F.when(length <= EXACT, F.lit(1)).otherwise(
        F.pow(F.lit(2.0), F.floor(F.log2(length.cast("double"))) - 9)
    )
    return (F.ceil(length / step) * step).cast("bigint")


def optimal_ends(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Ends of at most ``buckets`` ranges of ascending ``lengths`` with the least padding.

    Documents of a range are padded to its end. With C the running count, a range of lengths
    i + 1 .. j takes lengths[j] * (C[j] - C[i]) slots; dynamic programming over the number of
    ranges finds the least total. The best i never falls as j grows (the cost satisfies the
    quadrangle inequality), so each layer is solved by halving, in about n log n steps.
    """
    n = len(lengths)
    if not n:
        return []
    ends = np.array(lengths, np.float64)
    before = np.concatenate(([0.0], np.cumsum(np.array(counts, np.float64))))
    best = ends * before[1:]
    chosen = [np.zeros(n, np.int64)]
    for _ in range(min(buckets, n) - 1):
        # cost[i]: all lengths below i are in earlier ranges.
        cost = np.concatenate(([0.0], best[:-1]))
        found, start = np.empty(n), np.zeros(n, np.int64)
        todo = [(0, n - 1, 0, n - 1)]
        while todo:
            low, high, first, last = todo.pop()
            if low > high:
                continue
            j = (low + high) // 2
            i = np.arange(first, min(j, last) + 1)
            total = cost[i] + ends[j] * (before[j + 1] - before[i])
            k = int(total.argmin())
            found[j], start[j] = total[k], i[k]
            todo += [(low, j - 1, first, int(i[k])), (j + 1, high, int(i[k]), last)]
        chosen.append(start)
        best = found
    out, j = [], n - 1
    for start in reversed(chosen):
        if j < 0:
            break
        out.append(int(lengths[j]))
        j = int(start[j]) - 1
    return out[::-1]


def pack(
    docs: DataFrame, *, id_col: str = "doc_id", length_col: str = "n_tokens", buckets: int = 16,
    batch_tokens: int = 65_536,
) -> DataFrame:
    """One row per row of ``docs``: id, length, bucket, padded_length, batch and slot.

    Buckets have the ends that pad least over all documents (at most ``buckets`` of them), where
    each histogram bin stays whole; an end is the largest length of its bucket.
    Within a bucket, batches of padded_length * documents <= batch_tokens are filled one after
    the other, so each bucket has at most one batch that is not full; a document over the
    budget is a batch of its own. ``batch`` counts from 0 in each bucket, ``slot`` in each
    batch. The order is by a hash, so batches mix; rows alike in id and length are
    interchangeable. A null length counts as 0; null ids pass through; other columns are left
    out; an empty table gives an empty result.

    Only the histogram, of bounded size, reaches the driver. Places in a bucket come from row
    numbers in hash groups and the sizes of the groups before, so no task holds a bucket.
    """
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(length_col), F.lit(0)).cast("bigint").alias("n")
    )
    rows = staged(rows, "lengths")
    bins = rows.groupBy(candidate(F.col("n")).alias("bin")).agg(F.max("n").alias("end"), F.count("*").alias("c"))
    histogram = bins.orderBy("end").collect()
    ends = optimal_ends([r.end for r in histogram], [r.c for r in histogram], buckets)
    array = F.array(*[F.lit(e).cast("bigint") for e in ends or [0]])
    placed = rows.withColumn("bucket", F.size(F.filter(array, lambda e: e < F.col("n")))).withColumns({
        "padded": F.element_at(array, F.col("bucket") + 1),
        "chunk": F.pmod(F.xxhash64("id", "n"), F.lit(CHUNKS)).cast("int"),
    })
    earlier = Window.partitionBy("bucket").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    # At most CHUNKS rows per bucket.
    sizes = placed.groupBy("bucket", "chunk").count().select(
        "bucket", "chunk", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("base")
    )
    within = Window.partitionBy("bucket", "chunk").orderBy(F.xxhash64("n", "id"), "id", "n")
    numbered = placed.withColumn("row", F.row_number().over(within)).join(F.broadcast(sizes), ["bucket", "chunk"])
    room = F.greatest(F.lit(1), F.floor(F.lit(batch_tokens) / F.greatest(F.col("padded"), F.lit(1))))
    place = F.col("base") + F.col("row") - 1
    return numbered.select(
        F.col("id").alias(id_col), F.col("n").alias(length_col), "bucket", F.col("padded").alias("padded_length"),
        F.floor(place / room).alias("batch"), F.pmod(place, room).cast("int").alias("slot"),
    )
