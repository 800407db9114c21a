"""SimHash near-duplicates by a vantage-point tree over fingerprints.

Fingerprints are grouped first, so a text that occurs a thousand times is one
point.  A tree is built on the driver from a sample of the points, some for each leaf and
at most ``MAX_SAMPLE``: each node has a vantage fingerprint and a shell around it, chosen
for little overlap.  Every point goes to one home leaf, and by the triangle inequality to
each other leaf that may hold a point within the radius on the outer side of a shell; a
pair is therefore met in the home leaf of one of its points.

A leaf's task holds its home points only; the points that visit stream past them in
batches.  Two fingerprints within the radius agree in one of ``radius + 1`` parts, so a
leaf looks its visitors up by parts of its home points and compares what it finds: the
work is that of the routed points and not of all pairs of a leaf.  A leaf gives a spanning
forest of its links, never all pairs.  Components come from star contraction.

``keep_representatives`` deletes rows, so there fingerprints only propose.  They have
128 bits and are made of the *distinct* five-word shingles.  The tree over the whole table
finds all that differ in at most 4 of the first 64 bits.  Texts whose sets have a Jaccard
similarity of exactly 0.8 differ in about 19 of 128 bits (deviation about 4), and a radius of
32 misses some 0.1 % of such pairs.  Where the smaller text has at most ``FEW`` shingles bits
scatter more (a bit differs with a probability of up to 0.19), and the radius is 56, which a
pair of similarity 0.8 exceeds with a probability of 2e-11 at most.  Texts that share nothing are
some 64 bits apart (deviation 6), so at such a radius a tree over all points sends each to
half of all leaves, however many.  The wide search therefore goes by a metric that is the
Hamming distance inside a pocket and infinite between pockets.  Pockets are ``BANDS`` bands
of ``ROWS`` least hashes of a text's shingles under different multipliers, and of texts of
few shingles each shingle among the least hashes of which a similar text must share one (a
prefix filter, which misses none).  A pair of similarity 0.8 meets in some band with a
probability of 0.9994 (each agrees with 0.8 ** 4); texts that only share a passage of half
their shingles meet in one with 6 % a band.  Points at an infinite distance never visit, so
the tree's uppermost levels are a shuffle by pocket; below, each pocket has a vantage-point
tree of its own, with the shells that spare most pairs.  Trees of large pockets are grown
from a sample and deal points to shards as above, home points and visitors; the home points
of a shard, or a whole smaller pocket, have a tree in their task, in whose leaves fingerprints
are compared.  Inside each component of proposals all pairs are compared by their shingle
sets, large components by pairs of blocks, and only pairs of similarity 0.8 or more are links.

Defined results: a null, empty or word-free text has fingerprint zero and is
linked like any other; fewer than four words give one shingle; repeated rows
share a fingerprint and get a row each; a component whose ids are all null has a null
``component_id``, else null ids don't count for it; texts of any length are read whole; an
empty table gives an empty table; other columns are left out by ``simhash_groups`` and
kept by ``keep_representatives``, whatever their names.  The latter keeps one row of each
group: that of the smallest id, a null id after all others, and of rows of one id that of
the least hash of the text.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesio import P1, U64, column_bytes, lower_ascii, runs, segment_sums, steps, xxh64
from .components import connected_components
from .scratch import discard, materialize

#: Points of the driver's sample at least and at most, sampled points of a leaf, and home points that a leaf should hold.
SAMPLE, MAX_SAMPLE, PER_LEAF, LEAF = 8192, 2_000_000, 8, 4096
RADIUS = 4
#: Shares of the points that a node may have inside its shell.
SHELLS = (0.02, 0.05, 0.1, 0.2, 0.3, 0.5)
#: Points that visit one task, about; a leaf that more visit is dealt over several tasks that all hold its home points.
VISITORS = 32_768
#: Pairs that are compared at a time.
PAIRS = 200_000
#: Radius of wide fingerprints, of those of texts of few shingles, and the similarity of shingle sets (as a fraction) that makes texts near duplicates.
WIDE_RADIUS, FEW_RADIUS, ALIKE = 32, 56, (4, 5)
#: Bands of a text and least hashes of a band, that deal texts to pockets; home points that a shard of a large pocket should hold.
BANDS, ROWS, SHARD_BLOCK = 14, 4, 4096
#: Sampled points of such a shard, points of a leaf in a task, and comparisons that a shell must spare each point of a node on average.
PER_SHARD, POCKET_LEAF, SPARED = 64, 64, 16
#: Edges of a batch.
EDGES = 1 << 16
#: Texts of up to so many distinct shingles meet by common shingles too; a partner may have a quarter more.
FEW = 24
#: Texts, and shingles, of a block; two blocks are compared at a time.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 500_000
#: Texts to compare, up to so many, are found by a broadcast of their ids; more by a shuffle.
BROADCAST_NODES = 1_500_000
LANES = U64(0x0101010101010101)


def shingle_hashes(raw: np.ndarray, at: np.ndarray, width: int = 4, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the documents ``raw[at[i]:at[i+1]]``, and each document's offsets among them."""
    low = lower_ascii(raw)
    word = ~((low == 32) | ((low >= 9) & (low <= 13)))
    start, end = runs(word, at)
    if not len(start):
        return np.zeros(0, U64), np.zeros(len(at), np.int64)
    # words side by side, one space after each
    size = end - start
    new = np.zeros(len(start) + 1, np.int64)
    np.cumsum(size + 1, out=new[1:])
    buf = np.full(new[-1], 32, np.uint8)
    inside = np.flatnonzero(word)
    buf[np.arange(len(inside)) + np.repeat(np.arange(len(start)), size)] = low[inside]
    first = np.searchsorted(start, at)  # index of each document's first word
    words = np.diff(first)
    shingles = np.where(words >= width, words - width + 1, (words > 0).astype(np.int64))
    many = np.zeros(len(at), np.int64)
    np.cumsum(shingles, out=many[1:])
    head = np.arange(many[-1]) - np.repeat(many[:-1] - first[:-1], shingles)
    last = np.minimum(head + width, np.repeat(first[1:], shingles)) - 1
    return xxh64(buf, new[head], new[last] + size[last], seed), many


def majority_bits(h: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Of each slice ``h[many[i]:many[i+1]]`` the bits that more than half of its hashes have."""
    out = np.zeros(len(many) - 1, U64)
    if not len(h):
        return out
    shingles = np.diff(many)
    # bits are counted in eight byte lanes, at most 255 shingles at a time
    parts = -(-shingles // 255)
    part_end = np.zeros(len(many), np.int64)
    np.cumsum(parts, out=part_end[1:])
    cut = np.repeat(many[:-1], parts) + 255 * (np.arange(part_end[-1]) - np.repeat(part_end[:-1], parts))
    for bit in range(8):
        sums = np.add.reduceat((h >> U64(bit)) & LANES, cut).view(np.uint8).reshape(-1, 8)
        counts = segment_sums(sums, part_end, np.int64)
        for lane in range(8):
            out |= (2 * counts[:, lane] > shingles).astype(U64) << U64(8 * lane + bit)
    return out


def simhash_rows(raw: np.ndarray, at: np.ndarray, width: int = 4, seed: int = 42) -> np.ndarray:
    """Unsigned fingerprints of the documents ``raw[at[i]:at[i+1]]``."""
    return majority_bits(*shingle_hashes(raw, at, width, seed))


def shingle_sets(raw: np.ndarray, at: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document in ascending order, and each document's offsets among them."""
    h, many = shingle_hashes(raw, at, width)
    doc = np.repeat(np.arange(len(many) - 1), np.diff(many))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    offs = np.zeros(len(many), np.int64)
    np.cumsum(np.bincount(doc[new], minlength=len(many) - 1), out=offs[1:])
    return h[new], offs


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 4) -> DataFrame:
    """``doc_id, fp``: a fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = column_bytes(batch.column(1))
            fps = [simhash_rows(part, offs, width) for _, _, part, offs in steps(raw, at)]
            fp = np.concatenate(fps) if fps else np.zeros(0, U64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.selectExpr(f"cast(`{key}` as bigint) as doc_id", f"cast(`{text}` as string) as text")
    return rows.mapInArrow(run, "doc_id bigint, fp bigint")


def _mixed(h: np.ndarray, by: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U64(32))) * U64(by)
        h = (h ^ (h >> U64(29))) * U64(0xBF58476D1CE4E5B9)
        return h ^ (h >> U64(32))


MULTIPLIERS = np.random.default_rng(31).integers(0, 1 << 62, BANDS * ROWS, dtype=np.int64).view(U64) * U64(2) + U64(1)


def least_hash_bands(h: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of ``BANDS`` keys for each slice of hashes that isn't empty: ``ROWS`` least products with an odd number each."""
    full = np.flatnonzero(offs[:-1] < offs[1:])
    out = np.zeros((len(full), BANDS), U64)
    with np.errstate(over="ignore"):
        for k in range(BANDS * ROWS):
            least = np.minimum.reduceat(h * MULTIPLIERS[k], offs[:-1][full])
            out[:, k // ROWS] = (out[:, k // ROWS] ^ least) * P1 + U64(k // ROWS + 1)
    return _mixed(out, 0xC2B2AE3D27D4EB4F)


def set_fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, fp, fp2, set, n, keys, bands`` of ``docs(id, text)``: 128 bits of the distinct shingles, their hash and number,
    of a text of few the hashes of which a text of similarity ``ALIKE`` has one among its own, and keys of shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = column_bytes(batch.column(1))
            for i, j, part, part_at in steps(raw, at):
                h, offs = shingle_sets(part, part_at, width)
                n = np.diff(offs)
                with np.errstate(over="ignore"):
                    same = segment_sums(_mixed(h, 0x9FB21C651E98DF25), offs, U64)
                fp, fp2 = majority_bits(h, offs), majority_bits(_mixed(h, 0xA24BAED4963EE407), offs)
                # the least n - ceil(0.8 n) + 1; under four shingles only an equal set is as similar
                prefix = np.where((n >= 4) & (n <= FEW * ALIKE[1] // ALIKE[0]), n + 1 + (-ALIKE[0] * n) // ALIKE[1], 0)
                ends = np.zeros(len(n) + 1, np.int64)
                np.cumsum(prefix, out=ends[1:])
                keys = h[np.arange(ends[-1]) + np.repeat(offs[:-1] - ends[:-1], prefix)]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.view(np.int64)))
                bands = least_hash_bands(_mixed(h, 0x9E6C63D0876A9A47), offs)
                cuts = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))])
                bands = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(bands.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(x.view(np.int64)) for x in (fp, fp2, same)), pa.array(n), lists, bands], names=["doc_id", "fp", "fp2", "set", "n", "keys", "bands"])

    return docs.mapInArrow(run, "doc_id bigint, fp bigint, fp2 bigint, set bigint, n bigint, keys array<bigint>, bands array<bigint>")


def distances(points: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Differing bits of points, of one word or rows of several, and one of them."""
    d = np.bitwise_count(points ^ v).astype(np.int64)
    return d if d.ndim == 1 else d.sum(axis=1)


class VantageTree:
    """Vantage-point tree whose leaves number the shards."""

    def __init__(self, sample: np.ndarray, total: int, leaf: int = LEAF, radius: int = RADIUS):
        self.radius, self.leaves = radius, 0
        self.rng = np.random.default_rng(7)
        sample = np.unique(np.asarray(sample, U64), axis=0)
        self.root = self._grow(sample, max(1.0, total / max(1, len(sample))), leaf, 0)

    def _grow(self, pts: np.ndarray, scale: float, leaf: int, depth: int):
        if len(pts) * scale > leaf and len(pts) >= PER_LEAF and depth < 200:
            best = self._shell(pts)
            if best is not None:
                v, shell, beyond, inner = best
                return (v, shell, beyond, self._grow(pts[inner], scale, leaf, depth + 1), self._grow(pts[~inner], scale, leaf, depth + 1))
        self.leaves += 1
        return self.leaves - 1

    def _vantage(self, pts: np.ndarray) -> np.ndarray:
        return pts[self.rng.choice(len(pts), size=min(8, len(pts)), replace=False)]

    def _shell(self, pts: np.ndarray):
        """(vantage point, shell, least distance outside, which points it holds) of the least copying, or None."""
        best = None
        for v in self._vantage(pts):
            d = distances(pts, v)
            within = np.cumsum(np.bincount(d, minlength=65)) / len(pts)
            for share in SHELLS:
                shell = int(np.searchsorted(within, share))
                inside = within[shell]
                if not 0 < inside < 1:
                    continue
                # copies made for what is learnt of a point's place: inner points within the radius of the shell visit its outside
                over = inside - (within[shell - self.radius] if shell >= self.radius else 0.0)
                bits = -(inside * np.log2(inside) + (1 - inside) * np.log2(1 - inside))
                if best is None or np.log2(1 + over) / bits < best[0]:
                    best = (np.log2(1 + over) / bits, v, shell, shell + 1, d <= shell)
        return best and best[1:]

    def route(self, pts: np.ndarray, at_home: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, whether it's at home) of every leaf that a point must be in; of points without a home, of all that may hold a point within the radius."""
        out: list[tuple[np.ndarray, int, np.ndarray]] = []
        stack = [(self.root, np.arange(len(pts)), np.full(len(pts), at_home))]
        while stack:
            node, rows, home = stack.pop()
            if not len(rows):
                continue
            if not isinstance(node, tuple):
                out.append((rows, node, home))
                continue
            v, shell, beyond, inner, outer = node
            d = distances(pts[rows], v)
            near = d <= shell
            # a pair that the shell parts is met where its outer point is at home
            go_in = near | (~home & (d <= shell + self.radius))
            go_out = ~near | (d >= beyond - self.radius)
            stack.append((inner, rows[go_in], home[go_in] & near[go_in]))
            stack.append((outer, rows[go_out], home[go_out] & ~near[go_out]))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        return (np.concatenate([r for r, _, _ in out]), np.concatenate([np.full(len(r), k) for r, k, _ in out]), np.concatenate([h for _, _, h in out]))


class WideTree(VantageTree):
    """Tree over rows of two words for a radius beyond most distances: its shells spare most pairs.

    Where none spares enough a node is a leaf.  A tree that ``deals`` knows a sample only, and halves such a node,
    so that leaves stay bounded; another knows all its points, and so how far they are inside and outside a shell.
    """

    def __init__(self, sample: np.ndarray, total: int, leaf: int, radius: int, deals: bool):
        self.deals = deals
        super().__init__(sample, total, leaf, radius)
        del self.rng

    def _shell(self, pts: np.ndarray):
        best, middle = None, None
        for v in self._vantage(pts):
            d = distances(pts, v)
            within = np.cumsum(np.bincount(d, minlength=129)) / len(pts)
            # inner points further than the radius from the shell don't meet the points outside
            spared = np.concatenate([np.zeros(self.radius), within[: -self.radius]]) * (1 - within)
            shell = int(spared.argmax())
            if spared[shell] * len(pts) >= SPARED and (best is None or spared[shell] > best[0]):
                best = (spared[shell], v, shell, d)
            half = min(int(np.searchsorted(within, 0.5)), int(d.max()) - 1)
            if self.deals and (middle is None or abs(within[half] - 0.5) < middle[0]):
                middle = (abs(within[half] - 0.5), v, half, d)
        if best is None and middle is None:
            return None
        _, v, shell, d = best or middle
        inner = d <= shell
        return (v, shell, shell + 1, inner) if self.deals else (v, d[inner].max(), d[~inner].min(), inner)


class Forest:
    """Groups of things by number, and the edges that made them: a spanning forest, whatever the number of links."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Link pairs; returns those that joined two groups."""
        out: list[tuple[int, int]] = []
        while True:
            apart = np.flatnonzero(self.label[a] != self.label[b])
            if not len(apart):
                break
            a, b = a[apart], b[apart]
            # as many unions at once as don't meet in a group
            x, y = np.minimum(self.label[a], self.label[b]), np.maximum(self.label[a], self.label[b])
            _, once = np.unique(y, return_index=True)
            moved = np.arange(len(self.label))
            moved[y[once]] = x[once]
            while (moved[moved] != moved).any():
                moved = moved[moved]
            out.extend(zip(a[once].tolist(), b[once].tolist()))
            self.label = moved[self.label]
        found = np.array(out, np.int64).reshape(-1, 2)
        return found[:, 0], found[:, 1]


class HomePoints:
    """A leaf's home points, looked up by parts of their fingerprints."""

    def __init__(self, fp: np.ndarray, radius: int = RADIUS):
        self.fp, self.radius, self.forest = fp, radius, Forest(len(fp))
        edges = np.linspace(0, 64, radius + 2).astype(int)
        self.parts = []
        for lo, hi in zip(edges, edges[1:]):
            shift, mask = U64(lo), U64((1 << int(hi - lo)) - 1)
            part = (fp >> shift) & mask
            order = np.argsort(part, kind="stable")
            self.parts.append((shift, mask, part[order], order))

    def links(self, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(home point, visitor) of all pairs within the radius, some at a time, a pair perhaps more than once."""
        for shift, mask, known, order in self.parts:
            part = (fp >> shift) & mask
            lo, hi = np.searchsorted(known, part), np.searchsorted(known, part, side="right")
            run = np.cumsum(hi - lo)
            at = 0
            while at < len(fp):
                end = max(at + 1, int(np.searchsorted(run, (run[at - 1] if at else 0) + PAIRS, side="right")))
                many = (hi - lo)[at:end]
                visitor = np.repeat(np.arange(at, end), many)
                home = order[np.arange(len(visitor)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo[at:end], many)]
                near = np.bitwise_count(self.fp[home] ^ fp[visitor]) <= self.radius
                yield home[near], visitor[near]
                at = end

    def joined(self, fp: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray | None, np.ndarray]]:
        """Edges (home point, other home point, empty) and (home point, None, visitor) that link visitors, or the home points among themselves."""
        if fp is None:
            for a, b in self.links(self.fp):
                x, y = self.forest.join(a, b)
                yield x, y, np.zeros(0, np.int64)
            return
        first = np.full(len(fp), -1)
        for home, visitor in self.links(fp):
            fresh = first[visitor] < 0
            seen, at = np.unique(visitor[fresh], return_index=True)
            first[seen] = home[fresh][at]
            # further home points of a visitor belong to the group of its first
            x, y = self.forest.join(first[visitor], home)
            yield x, y, np.zeros(0, np.int64)
        linked = np.flatnonzero(first >= 0)
        yield first[linked], None, linked


class VantagePoints(HomePoints):
    """Home points of two words, looked up by a vantage-point tree over them."""

    def __init__(self, fp: np.ndarray, radius: int):
        self.fp, self.radius, self.forest = fp, radius, Forest(len(fp))
        self.tree, self.held = None, [np.arange(len(fp))]
        if len(fp) > POCKET_LEAF:
            self.tree = WideTree(fp, len(fp), POCKET_LEAF, radius, deals=False)
            row, leaf, home = self.tree.route(fp)
            self.held = [row[home & (leaf == k)] for k in range(self.tree.leaves)]

    def links(self, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.tree is None:
            yield from self._compared(self.held[0], np.arange(len(fp)), fp)
            return
        row, leaf, _ = self.tree.route(fp, at_home=False)
        for k, held in enumerate(self.held):
            yield from self._compared(held, row[leaf == k], fp)

    def _compared(self, home: np.ndarray, visitor: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        step = max(1, PAIRS // max(1, len(home)))
        for lo in range(0, len(visitor), step):
            part = visitor[lo : lo + step]
            d = np.bitwise_count(self.fp[home, None, 0] ^ fp[None, part, 0])
            d += np.bitwise_count(self.fp[home, None, 1] ^ fp[None, part, 1])
            x, y = np.nonzero(d <= self.radius)
            yield home[x], part[y]


def leaf_tasks(tree: VantageTree, fp: np.ndarray, key: np.ndarray, tasks: np.ndarray, first_task: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, task, whether it's at home): visitors go to one of a leaf's ``tasks`` by ``key``, home points to all of them."""
    row, leaf, home = tree.route(fp)
    many = np.where(home, tasks[leaf], 1)
    copy = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    row, leaf, home = np.repeat(row, many), np.repeat(leaf, many), np.repeat(home, many)
    own = np.where(home, copy, (_mixed(key[row], 0x9FB21C651E98DF25) % tasks[leaf].astype(U64)).astype(np.int64))
    return row, first_task[leaf] + own, home


def visitor_tasks(tree: VantageTree, sample: np.ndarray, total: int) -> np.ndarray:
    """Number of tasks of each leaf, by the visitors that a sample of the points lets expect."""
    expected = np.zeros(max(1, tree.leaves))
    for lo in range(0, len(sample), 1024):
        _, leaf, home = tree.route(sample[lo : lo + 1024])
        expected += np.bincount(leaf[~home], minlength=len(expected)) * (total / max(1, len(sample)))
    return np.maximum(1, np.ceil(expected / VISITORS)).astype(np.int64)


def leaf_links(batches: Iterator[pa.RecordBatch], words: int, hold: Callable) -> Iterator[pa.RecordBatch]:
    """Rows (shard, visits, node, radius, fingerprint words), by shard and home points first, to edges ``a, b``.

    ``hold`` makes home points of fingerprints and a radius.
    """

    def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        shard, parts, home, nodes = None, [], None, None
        for batch in batches:
            numbers, visits = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((numbers[1:] != numbers[:-1]) | (visits[1:] != visits[:-1])) + 1
            of, radii = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            fps = [batch.column(4 + k).to_numpy().view(U64) for k in range(words)]
            fps = fps[0] if words == 1 else np.stack(fps, axis=1)
            for lo, hi in zip([0, *cuts], [*cuts, len(numbers)]):
                if lo == hi:
                    continue
                if numbers[lo] != shard:
                    if parts:
                        yield from closed(parts)
                    shard, home, parts = numbers[lo], None, []
                if not visits[lo]:
                    parts.append((fps[lo:hi], of[lo:hi], radii[lo]))
                    continue
                if home is None:
                    if not parts:  # nobody is at home
                        continue
                    home, nodes = held(parts)
                    yield from edges(home.joined(None), nodes, None)
                    parts = []
                yield from edges(home.joined(fps[lo:hi]), nodes, of[lo:hi])
        if parts:
            yield from closed(parts)

    def held(parts):
        return hold(np.concatenate([f for f, _, _ in parts]), int(parts[0][2])), np.concatenate([n for _, n, _ in parts])

    def closed(parts):
        home, nodes = held(parts)
        if len(nodes) > 1:
            yield from edges(home.joined(None), nodes, None)

    def edges(joined, nodes, visitors):
        for x, y, v in joined:
            a, b = nodes[x], nodes[y] if y is not None else visitors[v]
            if len(a):
                yield np.minimum(a, b), np.maximum(a, b)

    some, many = [], 0
    for pair in found():
        some.append(pair)
        many += len(pair[0])
        if many >= EDGES:
            yield edge_batch(some)
            some, many = [], 0
    if some:
        yield edge_batch(some)


def edge_batch(some: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([pair[k] for pair in some])) for k in range(2)], names=["a", "b"])


def near_duplicate_links(points: DataFrame, radius: int = RADIUS, leaf: int = LEAF) -> DataFrame:
    """``points(fp, node)``, one row per fingerprint, to a spanning set ``a, b`` of the links within ``radius``."""
    total = points.count()
    size = min(MAX_SAMPLE, max(SAMPLE, PER_LEAF * total // leaf))
    taken = points.select("fp").where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(min(1.0, size / max(1, total)) * (1 << 30)))
    sample = taken.toArrow()["fp"].to_numpy().view(U64)
    tree = VantageTree(sample, total, leaf, radius)
    tasks = visitor_tasks(tree, sample, total)
    first_task = np.concatenate([[0], np.cumsum(tasks)])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, node = (batch.column(k).to_numpy() for k in range(2))
            for lo in range(0, len(fp), 1024):
                part = fp[lo : lo + 1024].view(U64)
                row, task, home = leaf_tasks(tree, part, part, tasks, first_task)
                row = row + lo
                yield pa.RecordBatch.from_arrays([pa.array(task.astype(np.int32)), pa.array(~home), pa.array(node[row]), pa.array(np.full(len(row), radius, np.int32)), pa.array(fp[row])], names=["shard", "visits", "node", "radius", "fp"])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return leaf_links(batches, 1, HomePoints)

    routed = points.select("fp", "node").mapInArrow(route, "shard int, visits boolean, node bigint, radius int, fp bigint")
    parts = int(first_task[-1])
    return routed.repartition(min(parts, 20_000), "shard").sortWithinPartitions("shard", "visits").mapInArrow(links, "a bigint, b bigint")


def wide_links(fp: np.ndarray, node: np.ndarray, radius: int) -> np.ndarray:
    """A spanning forest, as rows (node, node), of the links of fingerprints of two words."""
    found = [np.stack([x, y], axis=1) for x, y, _ in VantagePoints(fp, radius).joined(None)]
    return node[np.concatenate([np.zeros((0, 2), np.int64), *found])]


def pocket_links(dealt: DataFrame) -> DataFrame:
    """``dealt(pocket, radius, node, fp, fp2)`` to a spanning set ``a, b`` of the links within ``radius`` inside pockets, by vantage-point trees."""
    block, key = SHARD_BLOCK, ["pocket", "radius"]
    sizes = dealt.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    dealt = materialize(dealt.join(sizes, key).select("pocket", "radius", "n", "node", "fp", "fp2"), "pockets")
    rows = dealt.count()

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, total, radius = pdf[["fp", "fp2"]].to_numpy().view(U64), int(pdf["n"].iloc[0]), int(pdf["radius"].iloc[0])
        tree = WideTree(fp, total, block, radius, deals=True)
        return pd.DataFrame({"pocket": pdf["pocket"].iloc[:1], "radius": radius, "tree": pickle.dumps((tree, visitor_tasks(tree, fp, total)))})

    sampled = dealt.where(f"n > {block} and pmod(xxhash64(node, 5), {block}) < {PER_SHARD}")
    grown = sampled.groupBy(*key).applyInPandas(grow, "pocket bigint, radius int, tree binary").collect()
    trees = {(r["pocket"], r["radius"]): pickle.loads(r["tree"]) for r in grown}

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pocket, radius, n, node = (batch.column(k).to_numpy() for k in range(4))
            fp = np.stack([batch.column(k).to_numpy().view(U64) for k in (4, 5)], axis=1)
            with np.errstate(over="ignore"):
                shard = _mixed(pocket.view(U64) + radius.astype(U64), 0x9FB21C651E98DF25)
            whole = np.ones(len(node), bool)
            for p, r in set(zip(pocket[n > block].tolist(), radius[n > block].tolist())):
                if (p, r) not in trees:
                    continue
                tree, tasks = trees[p, r]
                first_task = np.concatenate([[0], np.cumsum(tasks)])
                own = np.flatnonzero((pocket == p) & (radius == r))
                whole[own] = False
                for lo in range(0, len(own), 1024):
                    part = own[lo : lo + 1024]
                    row, task, home = leaf_tasks(tree, fp[part], fp[part, 0] ^ fp[part, 1], tasks, first_task)
                    with np.errstate(over="ignore"):
                        numbers = _mixed(shard[part[row]] + task.astype(U64) + U64(1), 0xC2B2AE3D27D4EB4F)
                    yield routed(numbers, ~home, part[row], node, radius, fp)
            own = np.flatnonzero(whole)
            yield routed(shard[own], np.zeros(len(own), bool), own, node, radius, fp)

    def routed(shard, visits, row, node, radius, fp) -> pa.RecordBatch:
        columns = [shard.view(np.int64), visits, node[row], radius[row], fp[row, 0].view(np.int64), fp[row, 1].view(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["shard", "visits", "node", "radius", "fp", "fp2"])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return leaf_links(batches, 2, VantagePoints)

    parts = max(1, min(20_000, rows // (4 * block)), sum(int(t.sum()) for _, t in trees.values()))
    shards = dealt.mapInArrow(route, "shard bigint, visits boolean, node bigint, radius int, fp bigint, fp2 bigint")
    return shards.repartition(min(parts, 20_000), "shard").sortWithinPartitions("shard", "visits").mapInArrow(links, "a bigint, b bigint")


def simhash_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 4, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``."""
    fps = materialize(fingerprints(docs, text, key, width), "fingerprints")
    # a fingerprint is its own node, so null ids need none
    points = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")).selectExpr("fp", "fp as node", "least"), "points")
    parts = connected_components(near_duplicate_links(points, radius))
    named = materialize(points.join(parts, "node", "left").selectExpr("fp", "coalesce(component, node) as component", "least"), "components")
    discard(points)
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "component").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def proposed_links(points: DataFrame, radius: int = WIDE_RADIUS) -> DataFrame:
    """``points(fp, fp2, node, n, keys, bands)``, one row per shingle set, to links ``a, b`` whose components hold all pairs to compare."""
    # all that is within RADIUS in the first word, by the tree over the whole table
    words = materialize(points.groupBy("fp").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("sets")), "words")
    equal = points.join(words.where("sets > 1").selectExpr("fp", "node as a"), "fp").selectExpr("a", "node as b").where("a <> b")
    links = near_duplicate_links(words).union(equal)
    # and what is within the wide radius; sets of one fingerprint are one point, in the pockets of all of them
    several = points.groupBy("fp", "fp2").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("sets")).where("sets > 1").drop("sets")
    named = points.join(several, ["fp", "fp2"], "left")
    pockets = F.expr(f"explode(concat(transform(bands, x -> struct(x as pocket, {radius} as radius)), transform(keys, x -> struct(x as pocket, {FEW_RADIUS} as radius)))) as p")
    dealt = named.select("first", F.coalesce("first", "node").alias("node"), "fp", "fp2", pockets).select("first", "p.pocket", "p.radius", "node", "fp", "fp2")
    alone, shared = dealt.where("first is null").drop("first"), dealt.where("first is not null").drop("first").distinct()
    return links.union(pocket_links(alone.union(shared)))


def similar_links(sets: list[np.ndarray], node: np.ndarray) -> list[tuple[int, int]]:
    """Rows (smallest node, node) of the groups that pairs of a set similarity of ``ALIKE`` or more link."""
    size = np.array([len(x) for x in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    offs = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(len(flat) + 1, bool)
    left, group = np.arange(len(sets)), np.arange(len(sets))
    seen, seen_at = flat, offs
    stack: list[int] = []
    while len(left):
        i = stack.pop() if stack else int(left[0])
        own = flat[offs[i] : offs[i + 1]]
        mark[own] = True
        common = segment_sums(mark[seen], seen_at, np.int64)
        mark[own] = False
        hit = (ALIKE[1] * common >= ALIKE[0] * (size[left] + size[i] - common)) | (left == i)
        if hit.any():
            group[left[hit]] = group[i]
            stack.extend(j for j in left[hit].tolist() if j != i)
            seen, left = seen[np.repeat(~hit, size[left])], left[~hit]
            seen_at = np.concatenate([[0], np.cumsum(size[left])])
    least = np.full(len(sets), np.iinfo(np.int64).max)
    np.minimum.at(least, group, node)
    top = least[group]
    return [(int(a), int(b)) for a, b in zip(top, node) if a != b]


def exact_links(docs: DataFrame, proposed: DataFrame, width: int = 5) -> DataFrame:
    """``proposed(node, component, n)`` to a spanning set ``a, b`` of the similar pairs inside each component."""
    sizes = proposed.groupBy("component").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES), F.lit(1)).alias("blocks")
    )
    total = proposed.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    buckets = max(1, total["rows"] // BLOCK_ROWS, total["n"] // BLOCK_SHINGLES)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = column_bytes(batch.column(1))
            for i, j, part, part_at in steps(raw, at):
                h, offs = shingle_sets(part, part_at, width)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([h[a:b].tobytes() for a, b in zip(offs[:-1], offs[1:])], pa.binary())], names=["node", "shingles"])

    nodes = proposed.select(F.col("node").alias("id"))
    texts = docs.join(F.broadcast(nodes) if total["rows"] <= BROADCAST_NODES else nodes, "id", "left_semi")
    # a component of one block shares its task with others; of several, each pair of blocks is a task
    placed = proposed.join(sizes, "component").withColumn("own", F.expr("pmod(xxhash64(node, 3), blocks)"))
    single = placed.where("blocks = 1").selectExpr("node", "component", f"pmod(xxhash64(component), {buckets}L) as g", "-1L as p", "-1L as q")
    pairs = placed.where("blocks > 1").selectExpr("*", "explode(sequence(0L, blocks - 1)) as x").where("x <> own")
    several = pairs.selectExpr("node", "component", "component as g", "least(own, x) as p", "greatest(own, x) as q")
    rows = single.union(several).join(texts.mapInArrow(sets, "node bigint, shingles binary"), "node")

    def resolve(pdf: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int]] = []
        for _, part in pdf.groupby("component"):
            found.extend(similar_links([np.frombuffer(b, U64) for b in part["shingles"]], part["node"].to_numpy()))
        return pd.DataFrame(np.array(found, np.int64).reshape(-1, 2), columns=["a", "b"])

    return rows.groupBy("g", "p", "q").applyInPandas(resolve, "a bigint, b bigint")


def _free_name(docs: DataFrame, name: str) -> str:
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


def keep_representatives(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, radius: int = WIDE_RADIUS) -> DataFrame:
    """One row of each near-duplicate group of ``docs``: that of the smallest id."""
    ids = docs.select(F.col(f"`{key}`").cast("bigint").alias("id"))
    if ids.groupBy("id").count().where("id is null or count > 1").limit(1).count():
        # ids that don't tell rows apart: number the rows in their order
        name = _free_name(docs, "row_number")
        ordered = docs.orderBy(F.col(f"`{key}`").asc_nulls_last(), F.xxhash64(F.col(f"`{text}`")), F.col(f"`{text}`")).withColumn(name, F.monotonically_increasing_id())
        return keep_representatives(materialize(ordered, "numbered"), text, name, width, radius).drop(name)
    plain = docs.selectExpr(f"cast(`{key}` as bigint) as id", f"cast(`{text}` as string) as text")
    rows = materialize(set_fingerprints(plain, width), "fingerprints")
    points = materialize(rows.groupBy("fp", "fp2", "set", "n", "keys", "bands").agg(F.min("doc_id").alias("node")), "points")
    discard(rows)
    proposed = connected_components(proposed_links(points, radius))
    sized = points.groupBy("node").agg(F.max("n").alias("n"))
    proposed = materialize(proposed.join(sized, "node"), "proposed")
    gone = connected_components(exact_links(plain, proposed, width)).where("node <> component")
    name = _free_name(docs, "kept_id")
    keep = points.select("node").join(gone, "node", "left_anti").select(F.col("node").alias(name))
    return docs.join(keep, F.col(f"`{key}`").cast("bigint") == F.col(name), "left_semi")
