"""Language identification by prediction with partial matching.

For every language the training texts give a tree of byte contexts up to
``ORDER`` bytes with symbol counts.  The statistics are then frozen: a byte's
exact code length is that of method C, counted without exclusions: at the
longest known context with T occurrences and D distinct symbols a symbol seen c
times costs -log2 c/(T+D), an unseen one the escape -log2 D/(T+D) and then its
cost one order lower; below order 0 every byte costs 8 bits.  The language with
the least total wins.

The trees of all languages lie in one table per order.  An entry holds, for each
language, the cost of that context and symbol, escapes included, so a byte
costs one look-up at the longest order at which any language knows it.

Training: about ``TRAIN_DOCS`` documents and at most about ``TRAIN_BYTES`` bytes of each
language, taken by a hash of the id among the rows whose ``crc32(id) % 4`` isn't 2; counts
are added up in Spark, and what reaches the driver is bounded by that sample and the
number of languages.

Defined results: null texts and texts without a letter give ``und`` and score 0;
a text of letters gets the best language even if short, with the softmax of the
code lengths as score; ties go to the language first in code-point order; with
no training rows everything is ``und``; rows of a null id don't train and are
predicted like others; repeated rows train as often as they occur and are predicted each;
texts of any length are read whole; an empty table gives an empty table; other columns are
left out by ``identify`` and kept by ``accepted``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesio import U64, KeyTable, column_bytes, segment_sums, steps

#: Longest context in bytes, and training documents and bytes of a language, about (a bounded sample).
ORDER, TRAIN_DOCS, TRAIN_BYTES = 4, 400, 4_000_000
#: Bits a byte from which no learned language explains a text: nearly every byte then is one no training text
#: has, at 8 bits and the escapes down to them (another script).  Unusual words in known letters cost up to about 10.
REJECT_BITS = 14.0
UNKNOWN = "und"


def gram_keys(raw: np.ndarray, at: np.ndarray, order: int) -> list[np.ndarray]:
    """For each order 0..``order``, the context and symbol at every byte as one number; zeros stand before a document."""
    size = np.diff(at)
    pos = np.arange(len(raw)) - np.repeat(at[:-1], size)
    key = raw.astype(U64)
    out = [key.copy()]
    for k in range(1, order + 1):
        before = np.zeros(len(raw), U64)
        before[k:] = raw[:-k] if len(raw) > k else 0
        before[pos < k] = 0
        key |= before << U64(8 * k)
        out.append(key.copy())
    return out


def training_rows(docs: DataFrame, text: str, lang: str, key: str, per_lang: int) -> DataFrame:
    """``lang, text`` of about ``per_lang`` documents of each language, of about ``TRAIN_BYTES`` at most, by a hash of the id."""
    rows = docs.selectExpr(f"cast(`{key}` as bigint) as id", f"cast(`{lang}` as string) as lang", f"cast(`{text}` as string) as text").where(
        "lang is not null and text is not null and id is not null and crc32(cast(cast(id as string) as binary)) % 4 <> 2"
    )
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size"))
    share = F.least(F.lit(1.0), F.lit(float(per_lang)) / F.col("n"), F.lit(float(TRAIN_BYTES)) / F.greatest("size", F.lit(1)))
    return rows.join(F.broadcast(sizes), "lang").where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) < share * (1 << 30)).select("lang", "text")


class LanguageModel:
    """Frozen code lengths of all languages."""

    def __init__(self, langs: list[str], tables: list[tuple[np.ndarray, np.ndarray]], escapes: list[tuple[np.ndarray, np.ndarray]]):
        self.langs, self.order = langs, len(tables) - 1
        self.grams = [(KeyTable(k), v) for k, v in tables]
        self.contexts = [(KeyTable(k), v) for k, v in escapes]

    @classmethod
    def fit(cls, langs: list[str], lang: np.ndarray, order: np.ndarray, key: np.ndarray, count: np.ndarray, top: int = ORDER) -> LanguageModel:
        """From counts of (language number, order, context and symbol)."""
        n, tables, escapes = len(langs), [], []
        for k in range(top + 1):
            m = order == k
            grams, g = np.unique(key[m], return_inverse=True)
            c = np.zeros((len(grams), n), np.float32)
            c[g, lang[m]] = count[m]
            ctxs, x = np.unique(grams >> U64(8), return_inverse=True)
            total, kinds = np.zeros((len(ctxs), n)), np.zeros((len(ctxs), n))
            np.add.at(total, x, c)
            np.add.at(kinds, x, c > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                own = -np.log2(c / (total + kinds)[x])
            if k == 0:
                lower = np.full((len(grams), n), 8.0)
            else:
                short = grams & U64((1 << (8 * k)) - 1)
                lower = cls._cost(short, k - 1, tables, escapes, n)
            cost = np.where(c > 0, own, escape[x] + lower)
            tables.append((grams, cost))
            escapes.append((ctxs, escape))
        return cls(langs, [(k, v.astype(np.float32)) for k, v in tables], [(k, v.astype(np.float32)) for k, v in escapes])

    @staticmethod
    def _cost(keys: np.ndarray, k: int, tables: list, escapes: list, n: int) -> np.ndarray:
        """Cost of keys of order k by the tables so far; keys come from longer ones and so are all known there."""
        return tables[k][1][np.searchsorted(tables[k][0], keys)] if len(tables[k][0]) else np.full((len(keys), n), 8.0)

    def costs(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Bits that each document (row) takes under each language (column)."""
        n = len(self.langs)
        total = np.zeros((len(at) - 1, n))
        if not len(raw):
            return total
        keys = gram_keys(raw, at, self.order)
        doc = None
        table, cost = self.grams[-1]
        found = table.find(keys[-1])
        known = np.flatnonzero(found >= 0)
        safe = np.maximum(found, 0)
        hit = found >= 0
        for j in range(n):
            col = np.where(hit, cost[:, j][safe], np.float32(0)) if len(cost) else np.zeros(len(raw), np.float32)
            total[:, j] = segment_sums(col, at)
        if len(known) < len(raw):
            doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
            left, k = np.flatnonzero(~hit), self.order
            while len(left):
                ctx, escape = self.contexts[k]
                c = ctx.find(keys[k][left] >> U64(8)) if len(escape) else np.full(len(left), -1)
                seen = c >= 0
                for j in range(n):
                    total[:, j] += np.bincount(doc[left[seen]], escape[c[seen], j], len(at) - 1)
                k -= 1
                if k < 0:
                    total += 8.0 * np.bincount(doc[left], minlength=len(at) - 1)[:, None]
                    break
                table, cost = self.grams[k]
                found = table.find(keys[k][left]) if len(cost) else np.full(len(left), -1)
                hit = found >= 0
                for j in range(n):
                    total[:, j] += np.bincount(doc[left[hit]], cost[found[hit], j], len(at) - 1)
                left = left[~hit]
        return total


def train_language_model(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_lang: int = TRAIN_DOCS, order: int = ORDER) -> LanguageModel:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.asarray(batch.column(0).to_pylist(), object)
            raw, at = column_bytes(batch.column(1))
            for i, j, part, offs in steps(raw, at):
                which = np.repeat(np.arange(i, j), np.diff(offs))
                for k, keys in enumerate(gram_keys(part, offs, order)):
                    for name in dict.fromkeys(names[i:j]):
                        u, c = np.unique(keys[(names == name)[which]], return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([name] * len(u), pa.string()), pa.array(np.full(len(u), k, np.int32)), pa.array(u.view(np.int64)), pa.array(c.astype(np.int64))],
                            names=["lang", "k", "gram", "c"],
                        )

    grams = training_rows(docs, text, lang, key, per_lang).mapInArrow(count, "lang string, k int, gram bigint, c bigint")
    got = grams.groupBy("lang", "k", "gram").agg(F.sum("c").alias("c")).toArrow()  # columns, not a Python object a value
    names = got["lang"].combine_chunks().dictionary_encode()
    found = names.dictionary.to_pylist()
    langs = sorted(found)
    number = np.array([langs.index(x) for x in found], np.int64)
    return LanguageModel.fit(langs, number[names.indices.to_numpy()], got["k"].to_numpy().astype(np.int64), got["gram"].to_numpy().view(U64), got["c"].to_numpy().astype(np.float64), order)


def has_letter(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    low = raw | np.uint8(32)
    found = segment_sums(((low >= 97) & (low <= 122)).astype(np.uint8), at, np.int64) > 0
    for i in np.flatnonzero(~found & (at[:-1] < at[1:])):
        found[i] = any(c.isalpha() for c in raw[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, lang_pred, score, bits`` (bits a byte under the winner) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.langs, UNKNOWN], object)
        for batch in batches:
            raw, at = column_bytes(batch.column(1))
            pred, score, bits = [], [], []
            for _, _, part, offs in steps(raw, at):
                rows = len(offs) - 1
                if m.langs:
                    cost = m.costs(part, offs)
                    best = cost.argmin(axis=1)
                    low = cost[np.arange(rows), best]
                    ok = has_letter(part, offs)
                    p = 1 / np.exp2(np.maximum(low[:, None] - cost, -1000.0)).sum(axis=1)
                    pred.append(names[np.where(ok, best, -1)])
                    score.append(np.where(ok, p, 0.0))
                    bits.append(low / np.maximum(1, np.diff(offs)))
                else:
                    pred.append(names[np.full(rows, -1)])
                    score.append(np.zeros(rows))
                    bits.append(np.zeros(rows))
            cat = lambda parts: np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(list(cat(pred)), pa.string()), pa.array(cat(score), pa.float64()), pa.array(cat(bits), pa.float64())],
                names=["doc_id", "lang_pred", "score", "bits"],
            )

    return docs.selectExpr(f"cast(`{key}` as bigint) as doc_id", f"cast(`{text}` as string) as text").mapInArrow(
        run, "doc_id bigint, lang_pred string, score double, bits double"
    )


def held_out(key: str = "doc_id"):
    """Whether ``crc32(id as text) % 4`` is 2."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2


def accepted(docs: DataFrame, model: LanguageModel, text: str = "text", reject_bits: float = REJECT_BITS) -> DataFrame:
    """The rows of ``docs`` that some learned language explains, all their columns unchanged."""
    names = [f"c{i}" for i in range(len(docs.columns))]  # clashing or odd names don't matter inside
    plain, at_text = docs.toDF(*names), docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            raw, at = column_bytes(batch.column(at_text))
            keep = [np.zeros(0, bool)]
            for _, _, part, offs in steps(raw, at):
                if m.langs:
                    low = m.costs(part, offs).min(axis=1)
                    keep.append(has_letter(part, offs) & (low <= reject_bits * np.diff(offs)))
                else:
                    keep.append(np.zeros(len(offs) - 1, bool))
            yield batch.filter(pa.array(np.concatenate(keep)))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
