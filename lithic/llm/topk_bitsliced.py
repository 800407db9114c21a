"""Exact top-k inner products by a bit-sliced index.

A block of up to ``BLOCK`` vectors is indexed by slices: for each component a
list of bitmaps, one per bit of the component above the block's least, with a
bit per row.  A query adds the slices, shifted by the bits of its own components
(complemented for negative ones), with carry-save adders on whole bitmaps; the
result is the score of all rows of the block, again as slices.  From the most
significant slice downward the rows that can be among the best k are kept, and
rows tied at the boundary are settled by their ids.  Bitmaps are Python integers.

Rows are dealt to blocks once and queries to every block.  A task reads a block's rows,
builds the index once, and then lets the queries stream through it, so it holds one
block and one batch of queries however many there are; a block's k best a query go to a
final ranking of a few rows a query.

Defined results: vectors that are null or hold null or non-finite components, and rows
of a null id, take no part; vectors that are shorter than others count as padded with
zeros; a query never meets rows of its own id; rows that repeat an id are candidates
each, and queries of one id share one ranking over all their pairs; fewer than k other
rows give fewer results; ties go to the smaller id; an empty table gives an empty table;
other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of an index block.
BLOCK = 16_384
SCALE = 256


class BitSlicedIndex:
    """Slices of a block of integer vectors, rows in order of their ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, vectors = ids[order], vectors[order]
        self.n, self.dims = vectors.shape
        self.all = (1 << self.n) - 1
        self.low = vectors.min(axis=0) if self.n else np.zeros(self.dims, np.int64)
        self.slices: list[list[int]] = []
        self.flipped: list[list[int]] = []
        for j in range(self.dims):
            column = vectors[:, j] - self.low[j]
            bits = int(column.max()).bit_length() if self.n else 0
            own = [int.from_bytes(np.packbits((column >> b & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for b in range(bits)]
            self.slices.append(own)
            self.flipped.append([self.all ^ s for s in own])
        self.rows_of: dict[int, int] = {}
        for row, i in enumerate(self.ids.tolist()):
            self.rows_of[i] = self.rows_of.get(i, 0) | 1 << row

    def scores(self, query: list[int]) -> tuple[list[int], int]:
        """Score slices, least significant first, and the constant to add to what they say."""
        columns: list[list[int]] = []
        constant = 0
        for j, q in enumerate(query):
            constant += q * int(self.low[j])
            own = self.slices[j]
            if q < 0:  # q * u = |q| * (top - u) - |q| * top
                own = self.flipped[j]
                constant += q * ((1 << len(own)) - 1)
                q = -q
            for t in range(q.bit_length()):
                if q >> t & 1:
                    while len(columns) < t + len(own):
                        columns.append([])
                    for b, s in enumerate(own, t):
                        columns[b].append(s)
        out, w = [], 0
        while w < len(columns):
            column = columns[w]
            if len(column) > 1 and w + 1 == len(columns):
                columns.append([])
            while len(column) > 2:  # full adder: three slices of a weight to a sum and a carry
                a, b, c = column.pop(), column.pop(), column.pop()
                x = a ^ b
                column.append(x ^ c)
                columns[w + 1].append(a & b | x & c)
            if len(column) == 2:
                a, b = column
                columns[w + 1].append(a & b)
                column = [a ^ b]
            out.append(column[0] if column else 0)
            w += 1
        return out, constant

    def top(self, query: list[int], own_id: int, k: int) -> list[tuple[int, int]]:
        """(id, score) of the k best rows that don't have the query's id."""
        slices, constant = self.scores(query)
        open_rows, sure = self.all & ~self.rows_of.get(own_id, 0), 0
        for s in reversed(slices):
            high = open_rows & s
            n = (sure | high).bit_count()
            if n > k:
                open_rows = high
            else:
                sure |= high
                open_rows &= ~s
                if n == k:
                    open_rows = 0
                    break
        need = k - sure.bit_count()
        while need > 0 and open_rows:  # tied at the boundary: the lowest rows have the smallest ids
            low = open_rows & -open_rows
            sure |= low
            open_rows ^= low
            need -= 1
        found = []
        while sure:
            row = (sure & -sure).bit_length() - 1
            sure &= sure - 1
            found.append((int(self.ids[row]), constant + sum((s >> row & 1) << b for b, s in enumerate(slices))))
        return sorted(found, key=lambda x: (-x[1], x[0]))


def _matrix(lists: list[pa.ListArray], dims: int = 0) -> np.ndarray:
    """Vectors as rows, padded with zeros to the longest (or to ``dims``, and beyond it cut, where others have nothing)."""
    size = np.concatenate([np.zeros(0, np.int64), *(np.diff(x.offsets.to_numpy()).astype(np.int64) for x in lists)])
    flat = np.concatenate([np.zeros(0, np.int64), *(x.flatten().to_numpy() for x in lists)])
    width = dims or int(size.max(initial=0))
    out = np.zeros((len(size), width), np.int64)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    inside = at < width
    out[np.repeat(np.arange(len(size)), size)[inside], at[inside]] = flat[inside]
    return out


def quantised(vectors: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """``id, v array<bigint>``: floor(scale * component) of the vectors that take part."""
    bad = f"exists(`{vector}`, x -> x is null or isnan(x) or abs(cast(x as double)) = cast('Infinity' as double))"
    return vectors.where(f"`{key}` is not null and `{vector}` is not null and not {bad}").selectExpr(
        f"cast(`{key}` as bigint) as id", f"transform(`{vector}`, x -> cast(floor({scale} * cast(x as double)) as bigint)) as v"
    )


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best of all rows for each row whose id divides by ``every``."""
    rows = quantised(vectors, key, vector)
    total = rows.count()
    blocks = max(1, -(-total // BLOCK), min(8, total // 1024))
    base = rows.select(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("asks"), "id", "v")
    asked = rows.where(F.col("id") % every == 0).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"), "id", "v")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, index = None, [], None
        for batch in batches:  # by block, rows before queries
            numbers, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((numbers[1:] != numbers[:-1]) | (asks[1:] != asks[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(numbers)]):
                if numbers[lo] != block:
                    block, held, index = numbers[lo], [], None
                ids, v = batch.column(2).slice(lo, hi - lo).to_numpy(), batch.column(3).slice(lo, hi - lo)
                if not asks[lo]:
                    held.append((ids, v))
                    continue
                if index is None:
                    index = BitSlicedIndex(np.concatenate([np.zeros(0, np.int64), *(i for i, _ in held)]), _matrix([x for _, x in held])) if held else False
                if not index:
                    continue
                found = [(q, other, score) for q, row in zip(ids.tolist(), _matrix([v], index.dims).tolist(), strict=True) for other, score in index.top(row, q, k)]
                yield pa.RecordBatch.from_arrays([pa.array(np.array([r[c] for r in found], np.int64)) for c in range(3)], names=["query_id", "vec_id", "score"])

    dealt = base.union(asked).repartition(blocks, "block").sortWithinPartitions("block", "asks")
    best = dealt.mapInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= 5
"""
