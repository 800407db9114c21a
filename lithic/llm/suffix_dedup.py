"""Removing repeated byte strings, by merging Burrows-Wheeler transforms of shards.

A byte goes if some string of ``LENGTH`` bytes that covers it starts earlier too
(in a document of smaller id, or before in the same document).

1. Dealing.  Of the ``GRAM``-byte pieces in a string the one with the least hash is
   its anchor, so the string alone decides it, and equal strings share it at the same
   place.  Neighbouring strings of one anchor form a context.  Contexts are grouped by
   anchor; only anchors that occur again go on.  Equal contexts of a batch (compared
   byte for byte) travel once.
2. Deciding.  The contexts of an anchor meet in one task.  Each different one (by its
   bytes) is held once, with its places; the different ones are cut into shards; a shard's strings are sorted from their ends backward, ``SYMBOL`` bytes at a
   time, and what precedes each sorted suffix is the shard's Burrows-Wheeler transform
   of that depth.  Shards are merged by refining an interleave: it starts as "first
   shard, then second" and each round deals the merged transform stably by its symbols,
   so no suffix is sorted again.  A boundary that appears in a round has that depth as
   its common prefix.  What lies between boundaries after ``LENGTH`` bytes is one
   repeated string, compared byte for byte; all its places but the earliest go.
3. Hot anchors.  An anchor with more than ``HOT`` contexts is dealt anew by
   longer common bytes: strings whose anchor lies ``CLASS`` offsets apart at most share
   a core, and cores are groups of their own.  A core that is hot again is dealt by
   whole strings; there each group is one string, and its least place is a minimum that
   is aggregated before the shuffle.  Anchors that a sample shows to be very frequent
   are spread over tasks from the start.  So no task holds an unbounded group.  Only at
   that last step, whole strings of a hot core, two XXH64 of a string stand for it.

Texts travel compressed.  Intermediate tables are written to shared storage.

Defined results: null is the empty text; texts shorter than ``LENGTH`` keep all bytes;
strings never cross documents; a null id comes before all others; rows of one id (null
included) with equal texts are copies of one document and get equal results; different
texts of one id are documents of their own, in the order of a hash of the text; an empty
table gives an empty table; other columns are left out, whatever their names; very long
texts are one step of their own and processed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytesio import U64, column_bytes, steps, xxh64
from .scratch import discard, materialize

LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM + 1
#: Offsets of an anchor in one class of a hot anchor.
CLASS = 23
#: Bytes of a symbol; the first symbol of a string's end has what is left of ``LENGTH``.
SYMBOL = 8
#: Contexts of a shard, about; different contexts of a group that one task merges, at most.
SHARD, HOT = 256, 8192
#: Contexts of a task, about.
TASK = 8192
#: One document in so many is looked at for very frequent anchors, and tasks that such an anchor is spread over.
SAMPLE, SALTS = 64, 64
STEP = 1 << 18
_RNG = np.random.default_rng(20)
CODES = _RNG.integers(0, 1 << 63, size=256, dtype=np.int64).view(U64) * U64(2) + U64(1)
BASE = U64(0x9E3779B97F4A7C15)
_powers: list[tuple[np.ndarray, np.ndarray]] = []


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(31))) * U64(0x7FB5D329728EA185)
        x = (x ^ (x >> U64(27))) * U64(0x81DADEF4BC2DD44D)
        return x ^ (x >> U64(33))


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of every ``GRAM`` bytes: sums of codes times powers of an odd number."""
    n = len(raw)
    if not _powers or len(_powers[0][0]) < n:
        size = 1 << max(18, n.bit_length())
        with np.errstate(over="ignore"):
            up, down = (np.multiply.accumulate(np.concatenate([[U64(1)], np.full(size - 1, b, U64)])) for b in (BASE, U64(pow(int(BASE), -1, 1 << 64))))
        _powers[:] = [(up, down)]
    up, down = _powers[0]
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, U64)
        np.cumsum(CODES[raw] * up[:n], out=sums[1:])
        h = (sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1]
        h ^= h >> U64(32)
        h *= U64(0xD6E8FEB86659FD93)
    return h


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of ``x[i:i+width]`` for every whole window."""
    reach = 1
    while 2 * reach <= width:
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def contexts(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, first start in it, number of strings, bytes from there to the anchor, anchor hash) of all contexts."""
    n = len(raw)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none, none.view(U64)
    gram = gram_hashes(raw)
    bits = U64(n.bit_length())
    # the position in the low bits: of equal grams the leftmost is the anchor
    low = _least((gram >> bits << bits) | np.arange(len(gram), dtype=U64), SPAN)
    whole = np.zeros(n - LENGTH + 2, np.int32)
    size = np.diff(at)
    long = size >= LENGTH
    whole[at[:-1][long]] += 1
    whole[at[1:][long] - LENGTH + 1] -= 1
    start = np.flatnonzero(np.cumsum(whole[:-1]) > 0)
    if not len(start):
        return none, none, none, none, none.view(U64)
    owner = (low[start] & ((U64(1) << bits) - U64(1))).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    p, a = start[first], owner[first]
    many = np.diff(np.append(first, len(start)))
    doc = np.searchsorted(at, p, side="right") - 1
    return doc, p - at[doc], many, a - p, _mix(gram[a])


def _merged(doc: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of intervals of each document, as few rows as possible."""
    if not len(doc):
        return doc, s, e
    order = np.lexsort((s, doc))
    doc, s, e = doc[order], s[order], e[order]
    number = np.concatenate([[0], np.cumsum(doc[1:] != doc[:-1])])
    wide = np.int64(e.max() + 1)
    reach = np.maximum.accumulate(e + number * wide) - number * wide
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (s[1:] > reach[:-1])
    first = np.flatnonzero(new)
    return doc[first], s[first], np.append(reach[first[1:] - 1], reach[-1])


def _equal(raw: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether ``raw[a:a+size]`` and ``raw[b:b+size]`` are the same bytes."""
    out = np.zeros(len(a), bool)
    for lo in range(0, len(a), 4096):
        n = size[lo : lo + 4096]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        differ = raw[np.repeat(a[lo : lo + 4096], n) + inside] != raw[np.repeat(b[lo : lo + 4096], n) + inside]
        out[lo : lo + 4096] = ~np.logical_or.reduceat(differ, np.cumsum(n) - n)
    return out


def _segments(raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, bytes before it that are left out, bytes, offsets) of runs of documents; a long one in parts that share ``LENGTH - 1`` bytes."""
    for i, j, part, offs in steps(raw, at, STEP):
        if len(part) <= 2 * STEP:
            yield i, 0, part, offs
            continue
        for lo in range(0, len(part), STEP):  # one document; each string starts in one part
            some = part[lo : lo + STEP + LENGTH - 1]
            yield i, lo, some, np.array([0, len(some)])


def first_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts that are the first of their bytes in a batch (``kind`` 0; ``x``: place), and intervals of the others (1; ``anchor, x``: start, end)."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        raw, at = column_bytes(batch.column(1))
        rows, places, hashes = [], [], []
        for i, lo, part, offs in _segments(raw, at):
            doc, p, many, lead, h = contexts(part, offs)
            rows.append((doc + i).astype(np.int32))
            places.append((p + lo) << 14 | many << 7 | lead)
            hashes.append(h)
        if not rows:
            continue
        row, place, anchor = (np.concatenate(x) for x in (rows, places, hashes))
        del rows, places, hashes
        ordered = (ids[1:] >= ids[:-1]).all()
        order = np.argsort(anchor, kind="stable") if ordered else np.lexsort((place, ids[row], anchor))
        twice = np.zeros(len(order), bool)  # contexts whose anchor the batch has again
        twice[1:] = anchor[order[1:]] == anchor[order[:-1]]
        twice[:-1] |= twice[1:]
        near = order[twice]
        del order, twice
        again = np.zeros(len(anchor), bool)
        if len(near):
            here, size = at[row[near]] + (place[near] >> 14), (place[near] >> 7 & 127) - 1 + LENGTH
            shape = place[near] & ((1 << 14) - 1)  # number of strings and bytes to the anchor
            ctx = np.empty(len(near), U64)
            for lo in range(0, len(near), 100_000):
                part = slice(lo, lo + 100_000)
                low = int(here[part].min())
                ctx[part] = xxh64(raw[low : int((here[part] + size[part]).max())], here[part] - low, here[part] + size[part] - low)
            with np.errstate(over="ignore"):
                ctx += shape.astype(U64) * U64(0x9E6C63D0876A9A47)
            by = np.argsort(ctx, kind="stable")
            one, two = by[:-1], by[1:]
            met = np.flatnonzero((ctx[one] == ctx[two]) & (shape[one] == shape[two]))
            again[near[two[met]]] = _equal(raw, here[one[met]], here[two[met]], size[one[met]])
        p, many = place[again] >> 14, place[again] >> 7 & 127
        d, s, e = _merged(ids[row[again]], p, p + many - 1 + LENGTH)
        keep = np.flatnonzero(~again)
        for lo in range(0, len(keep), 100_000):
            k = keep[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.zeros(len(k), np.int32), anchor[k].view(np.int64), ids[row[k]], place[k])], names=["kind", "anchor", "id", "x"])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.ones(len(d), np.int32), s, d, e)], names=["kind", "anchor", "id", "x"])


FIRST = "kind int, anchor bigint, id bigint, x bigint"


def _stable(rank: np.ndarray) -> np.ndarray:
    """Stable order by small numbers, by distribution on 16 bits at a time."""
    order = np.argsort(rank.astype(np.uint16), kind="stable")
    if len(rank) and rank.max() >> 16:
        order = order[np.argsort((rank >> 16).astype(np.uint16)[order], kind="stable")]
    return order


class Alphabet:
    """The bytes of some contexts one after the other, and the symbol (``SYMBOL`` bytes, numbered in their order) at each place."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b"".join(texts) + bytes(SYMBOL), np.uint8)
        self.base = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        n = len(raw) - SYMBOL
        code = np.ndarray((n + 1,), ">u8", raw, strides=(1,))[:n].astype(U64) if n else np.zeros(0, U64)
        order = np.argsort(code)
        code = code[order]
        new = np.zeros(n, bool)
        new[1:] = code[1:] != code[:-1]
        head = np.zeros(n, bool)  # of the first bytes of a symbol only
        head[1:] = (code[1:] >> TAIL) != (code[:-1] >> TAIL)
        self.whole, self.head = np.empty(n, np.int32), np.empty(n, np.int32)
        self.whole[order] = np.cumsum(new, dtype=np.int32)
        self.head[order] = np.cumsum(head, dtype=np.int32)


#: Bits of a symbol beyond what ``LENGTH`` leaves for the last one of a string.
TAIL = U64(8 * (SYMBOL - LENGTH % SYMBOL)) if LENGTH % SYMBOL else U64(0)
ROUNDS = -(-LENGTH // SYMBOL)


class Shard:
    """Strings of ``LENGTH`` bytes in order, with the transform of each depth."""

    def __init__(self, alphabet: Alphabet, start: np.ndarray):
        """``start``: places of the strings in the alphabet's bytes."""
        order = np.arange(len(start))
        self.transforms: list[np.ndarray] = []
        for k in range(ROUNDS):
            # the symbol before each suffix, in the suffixes' order
            symbol = (alphabet.whole if k else alphabet.head)[start + SYMBOL * (ROUNDS - 1 - k)] if len(start) else np.zeros(0, np.int32)
            bwt = symbol[order]
            self.transforms.append(bwt)
            order = order[_stable(bwt)]
        self.order = order


def merge_shards(shards: list[Shard]) -> tuple[np.ndarray, np.ndarray]:
    """(string, block) of all strings in merged order, numbered shard after shard; those of equal blocks are equal."""
    sizes = [len(s.order) for s in shards]
    z = np.repeat(np.arange(len(shards), dtype=np.int16), sizes)
    block = np.zeros(len(z), np.int32)
    merged = np.empty(len(z), np.int32)
    for k in range(ROUNDS):
        for n, s in enumerate(shards):
            merged[z == n] = s.transforms[k]
        order = _stable(merged)
        symbol, before = merged[order], block[order]
        z = z[order]
        new = (symbol[1:] != symbol[:-1]) | (before[1:] != before[:-1])
        block = np.concatenate([np.zeros(min(1, len(z)), np.int32), np.cumsum(new, dtype=np.int32)])
    string = np.empty(len(z), np.int64)
    for n, (s, lo) in enumerate(zip(shards, np.cumsum([0, *sizes]))):
        string[z == n] = s.order + lo
    return string, block


def repeated_in(texts: list[bytes], doc: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of strings in different contexts (their bytes, documents and first starts) that another place has earlier."""
    alphabet = Alphabet(texts)
    many = np.array([len(t) for t in texts]) - LENGTH + 1
    first = np.concatenate([[0], np.cumsum(many)])
    inside = np.arange(first[-1]) - np.repeat(first[:-1], many)
    start = inside + np.repeat(alphabet.base[:-1], many)
    half = len(texts) // 2
    parts = [(0, half), (half, len(texts))] if len(texts) <= 4 * SHARD else [(lo, min(len(texts), lo + len(texts) // 4 + 1)) for lo in range(0, len(texts), len(texts) // 4 + 1)]
    string, block = merge_shards([Shard(alphabet, start[first[lo] : first[hi]]) for lo, hi in parts])
    # only blocks of several strings matter
    same = block[1:] == block[:-1]
    several = np.zeros(len(block), bool)
    several[1:] |= same
    several[:-1] |= same
    string, block = string[several], block[several]
    d, s = np.repeat(doc, many)[string], (np.repeat(p, many) + inside)[string]
    order = np.lexsort((s, d, block))
    d, s, block = d[order], s[order], block[order]
    gone = np.zeros(len(block), bool)
    gone[1:] = block[1:] == block[:-1]
    return _merged(d[gone], s[gone], s[gone] + LENGTH)


def _resolved(rows: DataFrame) -> DataFrame:
    """``rows(key, id, p, bytes)``, groups of bounded size, to intervals ``id, s, e``."""

    def resolve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "id", "p"])
        key, texts, doc, p = pdf["key"].to_numpy(np.int64), list(pdf["bytes"]), pdf["id"].to_numpy(np.int64), pdf["p"].to_numpy(np.int64)
        held: dict[bytes, int] = {}
        later = np.array([held.setdefault(b, n) != n for n, b in enumerate(texts)], bool)  # equal bytes have equal keys
        size = np.array([len(b) for b in texts], np.int64)
        found = [_merged(doc[later], p[later], (p + size)[later])]
        first = np.flatnonzero(~later)
        key, texts, doc, p = key[first], [texts[n] for n in first], doc[first], p[first]
        alone = np.ones(len(key), bool)  # nothing to merge with
        alone[1:] &= key[1:] != key[:-1]
        alone[:-1] &= key[1:] != key[:-1]
        rest = np.flatnonzero(~alone)
        key, texts, doc, p = key[rest], [texts[n] for n in rest], doc[rest], p[rest]
        ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))  # where groups end
        lo = 0
        while lo < len(key):  # whole groups, about two shards of them at a time
            hi = int(ends[min(np.searchsorted(ends, lo + 2 * SHARD), len(ends) - 1)])
            found.append(repeated_in(texts[lo:hi], doc[lo:hi], p[lo:hi]))
            lo = hi
        d, s, e = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in found)]) for k in range(3))
        return pd.DataFrame({"id": d, "s": s, "e": e})

    buckets = max(1, rows.count() // TASK)
    return rows.withColumn("b", F.pmod(F.xxhash64("key"), F.lit(buckets))).groupBy("b").applyInPandas(resolve, "id bigint, s bigint, e bigint")


def _packed(docs: DataFrame) -> DataFrame:
    """``id, z``: texts compressed for their way through a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            z = [pack(t.as_buffer()) for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(z, pa.binary())], names=["id", "z"])

    return docs.select("id", "text").mapInArrow(run, "id bigint, z binary")


def _unpack(z) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(z)


def cut_contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``key, id, p, lead, hot, bytes`` of contexts ``wanted(id, key, x, hot)``; those of hot anchors by classes of offsets, keyed by their cores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, z, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                text = _unpack(z.as_buffer())
                found = found.values
                x, hot = found.field("x").to_numpy(), found.field("hot").to_numpy(zero_copy_only=False).astype(bool)
                key, p, many, lead = found.field("key").to_numpy(), x >> 14, x >> 7 & 127, x & 127
                if hot.any():
                    rows = [(key[~hot], p[~hot], many[~hot], lead[~hot], hot[~hot])]
                    key, p, many, lead = key[hot], p[hot], many[hot], lead[hot]
                    for k in range(-(-SPAN // CLASS)):
                        # strings that lie k * CLASS up to less than (k + 1) * CLASS before their anchor
                        lo, hi = np.maximum(0, lead - (k + 1) * CLASS + 1), np.minimum(many - 1, lead - k * CLASS)
                        ok = lo <= hi
                        core = (p + lead - k * CLASS)[ok]
                        raw = np.frombuffer(text, np.uint8)
                        with np.errstate(over="ignore"):
                            h = xxh64(raw, core, core + LENGTH - CLASS + 1) + key[ok].view(U64) * U64(0x9E3779B97F4A7C15) + U64(k)
                        rows.append((_mix(h).view(np.int64), (p + lo)[ok], (hi - lo + 1)[ok], (lead - lo)[ok], np.ones(int(ok.sum()), bool)))
                    key, p, many, lead, hot = (np.concatenate([r[k] for r in rows]) for k in range(5))
                cut = [text[a:b] for a, b in zip(p.tolist(), (p + many - 1 + LENGTH).tolist())]
                for at in range(0, len(cut), 10_000):
                    part = slice(at, at + 10_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key[part]), pa.array(np.full(len(key[part]), i, np.int64)), pa.array(p[part]), pa.array(hot[part]), pa.array(cut[part], pa.binary())], names=["key", "id", "p", "hot", "bytes"]
                    )

    lists = wanted.groupBy("id").agg(F.collect_list(F.struct("key", "x", "hot")).alias("all"))
    return _packed(docs).join(lists, "id").mapInArrow(run, "key bigint, id bigint, p bigint, hot boolean, bytes binary")


def _by_strings(rows: DataFrame) -> DataFrame:
    """Intervals of the strings in ``rows(id, p, bytes)`` that are repeats, by a hash of each string and pre-aggregated minima."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = column_bytes(batch.column(2))
            raw, at = raw[at[0] : at[-1]], at - at[0]
            many = np.diff(at) - LENGTH + 1
            inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            s = inside + np.repeat(at[:-1], many)
            one, two = xxh64(raw, s, s + LENGTH, 1), xxh64(raw, s, s + LENGTH, 2)
            place = np.repeat(batch.column(1).to_numpy(), many) + inside
            yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), many)), pa.array(place)], names=["one", "two", "id", "p"])

    strings = materialize(rows.select("id", "p", "bytes").mapInArrow(run, "one bigint, two bigint, id bigint, p bigint"), "strings")
    least = strings.groupBy("one", "two").agg(F.min(F.struct("id", "p")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = strings.join(least, ["one", "two"]).where("id <> first.id or p <> first.p")
    return later.selectExpr("id", "p as s", f"p + {LENGTH} as e")


def _frequent(docs: DataFrame) -> DataFrame:
    """``anchor``: those that a sample of the documents shows so often that one task shouldn't hold all their rows."""
    sample = docs.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(SAMPLE)) == 0).mapInArrow(first_contexts, FIRST).where("kind = 0")
    counts = sample.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    # at most 5000 anchors can reach this share
    return counts.where(F.col("n") > max(HOT // SAMPLE, total // 5000)).select("anchor")


def repeats(docs: DataFrame) -> DataFrame:
    """``id, s, e``: intervals of ``docs(id, text)``, one row an id, whose strings start earlier too."""
    frequent = materialize(_frequent(docs).withColumn("often", F.lit(True)), "frequent")
    rows = docs.mapInArrow(first_contexts, FIRST).join(F.broadcast(frequent), "anchor", "left")  # a few thousand anchors at most
    rows = rows.withColumn("often", F.coalesce("often", F.lit(False)) & (F.col("kind") == 0))
    # intervals of a batch travel in groups of their own
    rows = rows.withColumn("salt", F.expr(f"case when kind = 1 then 1 + pmod(id, 1000003) when often then -1 - pmod(xxhash64(id, x), {SALTS}) else 0 end"))
    rows = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("anchor", "salt")))
    rows = rows.where("kind = 1 or often or n > 1")
    found = materialize(rows.selectExpr("kind = 1 as whole", "anchor", "x", "id", f"often or n > {HOT} as hot"), "contexts")
    batch = found.where("whole").selectExpr("id", "anchor as s", "x as e")
    wanted = found.where("not whole").selectExpr("id", "anchor as key", "x", "hot")
    cut = materialize(cut_contexts(docs, wanted), "cut")
    parts = [batch, _resolved(cut.where("not hot"))]
    hot, made = cut.where("hot"), [frequent, found, cut]
    if hot.limit(1).count():
        firsts = materialize(hot.groupBy("key", "bytes").agg(F.min(F.struct("id", "p")).alias("first"), F.count(F.lit(1)).alias("n")), "firsts")
        later = hot.join(firsts.where("n > 1").drop("n"), ["key", "bytes"]).where("id <> first.id or p <> first.p")
        sizes = firsts.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        cores = materialize(firsts.join(sizes, "key").selectExpr("key", "first.id as id", "first.p as p", "bytes", "size"), "cores")
        parts += [later.selectExpr("id", "p as s", "p + length(bytes) as e"), _resolved(cores.where(f"size <= {HOT}"))]
        made += [firsts, cores]
        if cores.where(f"size > {HOT}").limit(1).count():
            parts.append(_by_strings(cores.where(f"size > {HOT}")))
    spans = parts[0]
    for part in parts[1:]:
        spans = spans.union(part)
    spans = materialize(spans, "spans")
    for df in made:
        discard(df)
    return spans


def _numbered(docs: DataFrame, text: str, key: str) -> tuple[DataFrame, bool]:
    """``id, doc_id, text``, and whether ids are unique and not null and number the documents themselves."""
    plain = docs.selectExpr(f"cast(`{key}` as bigint) as doc_id", f"coalesce(cast(`{text}` as string), '') as text")
    if not plain.groupBy("doc_id").count().where("doc_id is null or count > 1").limit(1).count():
        return plain.selectExpr("doc_id as id", "doc_id", "text"), True
    plain = plain.withColumn("h", F.xxhash64("text"))
    order = plain.select("doc_id", "h").distinct().orderBy(F.col("doc_id").asc_nulls_first(), "h").withColumn("id", F.monotonically_increasing_id())
    numbers = materialize(order.withColumnRenamed("doc_id", "d").withColumnRenamed("h", "dh"), "numbers")
    return plain.join(numbers, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("dh"))).select("id", "doc_id", "text"), False


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", keep_text: bool = False) -> DataFrame:
    """Per document its length, removed bytes and runs, and the digest of what is left (with ``keep_text`` also that)."""
    every, unique = _numbered(docs, text, key)
    plain = every.select("id", "text") if unique else every.select("id", "text").dropDuplicates(["id"])
    spans = repeats(plain).groupBy("id").agg(F.collect_list("s").alias("s"), F.collect_list("e").alias("e"))
    fields = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_text else [])]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, gone, count, digest, left = [], [], [], [], []
            for z, starts, ends in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                data = _unpack(z.as_buffer())
                n, runs = len(data), 0
                if starts.values is not None:
                    s, e = starts.values.to_numpy(), ends.values.to_numpy()
                    _, s, e = _merged(np.zeros(len(s), np.int64), s, e)
                    data = b"".join(data[a:b] for a, b in zip([0, *e.tolist()], [*s.tolist(), n]))
                    runs = len(s)
                size.append(n)
                gone.append(n - len(data))
                count.append(runs)
                digest.append(hashlib.sha256(data).hexdigest())
                left.append(data)
            cols = [batch.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(left, pa.binary())] if keep_text else []), names=fields)

    schema = "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary" if keep_text else "")
    done = _packed(plain).join(spans, "id", "left").select("id", "z", "s", "e").mapInArrow(cut, schema)
    if unique:
        return done.withColumnRenamed("id", "doc_id")
    return every.select("id", "doc_id").join(done, "id").drop("id")
