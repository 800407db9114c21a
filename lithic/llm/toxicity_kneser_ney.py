"""Toxicity by class-conditional Kneser-Ney language models.

One interpolated bigram model of toxic and one of ordinary texts, over words, with
modified Kneser-Ney discounts that are estimated from counts of counts.

* Bigrams: a bigram counts as often as there are distinct words before it, so copies and
  near copies of a text don't raise it.  In a class its discounted count over the
  history's count is interpolated, by the weight that discounting frees for that history,
  with the word's probability.
* Words: discounted continuation counts (the number of distinct words a word follows),
  interpolated with the discounted continuation counts of both classes together, and
  those with one probability for all words.  That back-off and its weight are shared, so
  an expression of which a class has no more than the discount has the same probability
  in both classes and says nothing.  The whole count of a word with one left neighbour,
  and of a bigram with fewer than ``CUT``, goes to the back-off.

Words are counted by their whole 64-bit hashes: every labelled training text counts,
nothing is cut off, and words don't share counts at any size.  The model sent to workers
holds the words of two and the bigrams of ``CUT`` contexts or more in a class, so it grows
with the labelled texts.

The score compares length-normalised log-likelihoods: the mean log ratio a word under the
bigram models over the whole text, and under their word level the largest means over
1, 2 and 4 neighbouring words, so that a short insult isn't thinned out by a long text.
A logistic curve maps them to 0..1.  Folds are ``crc32(id) % 4``: 0 and 1 give the counts,
3 fits the curve (a sample of about ``FIT_DOCS`` labelled rows), 2 is held out.

Defined results: null, empty and word-free texts have ratio 0 and the score the
curve gives it; texts of any length are read whole; repeated rows count once in training
(their contexts are the same) and get a score each; a null id is never a labelled one and
gets a score like others; rows of an id with two labels count for both; without labels of
both classes every score is 0; an empty table gives an empty table; other columns are left
out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .bytesio import U64, KeyTable, column_bytes, lower_ascii, runs, segment_sums, steps, xxh64
from .scratch import discard, materialize

#: Distinct left neighbours from which a bigram has a probability of its own.
CUT = 4
#: Neighbouring words over which the largest mean is taken.
WINDOWS = (1, 2, 4)
#: Tasks that the bigrams of one history are dealt over.
SALTS = 16
#: Labelled rows of the fitting fold that the curve is fitted on, about.
FIT_DOCS = 20_000
#: Labels up to this many rows are broadcast to the texts; more are joined by a shuffle.
BROADCAST_LABELS = 2_000_000
THRESHOLD = 0.3
#: Features of a text.
NAMES = ["mean", *(f"peak{w}" for w in WINDOWS)]


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of lower-cased runs of letters, digits and non-ASCII bytes, and each document's offsets among them."""
    low = lower_ascii(raw)
    inside = ((low >= 97) & (low <= 122)) | ((low >= 48) & (low <= 57)) | (low >= 128)
    start, end = runs(inside, at)
    return xxh64(low, start, end, 0), np.searchsorted(start, at)


def shifted(words: np.ndarray, at: np.ndarray, by: int) -> np.ndarray:
    """The word ``by`` places before each word, 1 before a document's first."""
    out = np.ones(len(words), U64)
    out[by:] = words[:-by]
    for k in range(by):
        head = at[:-1] + k
        out[head[head < at[1:]]] = U64(1)
    return out


#: Bits of a history's hash.
HISTORY = 39


def pair_keys(words: np.ndarray, history: np.ndarray) -> np.ndarray:
    """One number for a word and its history."""
    with np.errstate(over="ignore"):
        x = (words ^ (history * U64(0x9E3779B97F4A7C15))) * U64(0xD6E8FEB86659FD93)
        return x ^ (x >> U64(32))


def discounts(many: list[int]) -> np.ndarray:
    """What counts of 0, 1, 2 and 3 or more lose, from how many counts there are of 1, 2, 3 and 4 (modified Kneser-Ney)."""
    n = [max(1, x) for x in many]
    y = n[0] / (n[0] + 2 * n[1])
    return np.clip([0.0, 1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]], 0.0, [0, 1, 2, 3])


def taken(count: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.minimum(d[np.minimum(count, 3).astype(np.int64)], count)


class ToxicityModel:
    """Log ratios of the two models by word, history and bigram, and the fitted curve."""

    def __init__(self, words: np.ndarray, ratio: np.ndarray, histories: np.ndarray, weight: np.ndarray, pairs: np.ndarray, pair_ratio: np.ndarray, ready: bool = True):
        """Ratios of words by hash (0 for all others), of back-off weights by history (0), and of bigrams by ``pair_keys``."""
        self.ready = ready
        self.words, self.histories, self.pairs = KeyTable(words), KeyTable(histories), KeyTable(pairs)
        self.ratio, self.weight = np.append(ratio, 0).astype(np.float32), np.append(weight, 0).astype(np.float32)
        self.pair_ratio = np.append(pair_ratio, 0).astype(np.float32)
        self.curve = np.zeros(2 + len(WINDOWS))

    def ratios(self, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log ratio of each word under the bigram models and under their word level."""
        word = self.ratio[self.words.find(words)].astype(np.float64)
        history = shifted(words, at, 1) >> U64(64 - HISTORY)
        pair = self.pairs.find(pair_keys(words, history))
        return np.where(pair >= 0, self.pair_ratio[pair], word + self.weight[self.histories.find(history)]), word

    def features(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Mean log ratio of each document, and the word level's largest means over windows."""
        words, offs = word_hashes(raw, at)
        out = np.zeros((len(at) - 1, 1 + len(WINDOWS)))
        if not len(words):
            return out
        both, r = self.ratios(words, offs)
        size = np.diff(offs)
        out[:, 0] = segment_sums(both, offs) / np.maximum(size, 1)
        run = np.zeros(len(r) + 1)
        np.cumsum(r, out=run[1:])
        first = np.repeat(offs[:-1], size)
        here = np.arange(1, len(r) + 1)
        full = size > 0
        for k, window in enumerate(WINDOWS, 1):
            mean = (run[here] - run[np.maximum(here - window, first)]) / window
            out[full, k] = np.maximum.reduceat(mean, offs[:-1][full])
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        if not self.ready:
            return np.zeros(len(features))
        z = np.clip(self.curve[0] + features @ self.curve[1:], -30, 30)
        return 1 / (1 + np.exp(-z))

    def fit_curve(self, features: np.ndarray, label: np.ndarray) -> None:
        """Ridge logistic regression by Newton's method."""
        if not len(features):
            self.curve = np.append(0.0, np.ones(1 + len(WINDOWS)))
            return
        mid, width = features.mean(axis=0), features.std(axis=0) + 1e-9
        x = np.column_stack([np.ones(len(features)), (features - mid) / width])
        w = np.zeros(x.shape[1])
        ridge = np.diag([1e-6, *[0.05] * (len(w) - 1)])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w)), x.T @ (label - p) - ridge @ w)
            w += np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-8:
                break
        self.curve = np.array([w[0] - (w[1:] * mid / width).sum(), *(w[1:] / width)])


def labelled(docs: DataFrame, labels: DataFrame, text: str, key: str) -> DataFrame:
    """``id, text, toxic, fold`` of the labelled rows that aren't held out."""
    fold = F.crc32(F.col("id").cast("string").cast("binary")) % 4
    marks = (
        labels.selectExpr(f"cast(`{key}` as bigint) as id", "cast(toxic as int) as toxic")
        .where("id is not null and toxic in (0, 1)")
        .withColumn("fold", fold)
        .where("fold <> 2")
    )
    rows = docs.selectExpr(f"cast(`{key}` as bigint) as id", f"cast(`{text}` as string) as text")
    small = marks.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    return rows.join(F.broadcast(marks) if small else marks, "id")


def contexts(rows: DataFrame, order: int) -> DataFrame:
    """``word, k`` of ``rows(toxic, text)``, distinct inside some megabytes of text: words with their left neighbour (``order`` 1) or two neighbours (2) and class, in one number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(0).to_numpy()
            raw, at = column_bytes(batch.column(1))
            for i, j, part, offs in steps(raw, at):
                words, w_at = word_hashes(part, offs)
                if not len(words):
                    continue
                k = np.repeat(toxic[i:j], np.diff(w_at)).astype(U64)
                if order == 1:
                    k |= shifted(words, w_at, 1) >> U64(24) << U64(1)
                else:
                    k |= (shifted(words, w_at, 1) >> U64(64 - HISTORY) << U64(25)) | (shifted(words, w_at, 2) >> U64(40) << U64(1))
                order_ = np.lexsort((k, words))
                words, k = words[order_], k[order_]
                new = np.ones(len(k), bool)
                new[1:] = (words[1:] != words[:-1]) | (k[1:] != k[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(words[new].view(np.int64)), pa.array(k[new].view(np.int64))], names=["word", "k"])

    return rows.select("toxic", "text").mapInArrow(count, "word bigint, k bigint")


def fitted(words: dict, sizes: dict, pairs: dict, histories: dict, pair_sizes: dict) -> ToxicityModel:
    """The model from counts.

    ``words``: arrays ``word, n0, n1`` of continuation counts, of the words that have two in a
    class or a bigram in ``pairs``; ``sizes``: ``v, s0, s1`` and ``c0, c1, cs``, numbers of
    words with counts 1 to 4 in a class and in both; ``pairs``: arrays ``prev, word, n0, n1``
    of the bigrams of ``CUT`` or more in a class; ``histories``: arrays ``prev, n0, n1`` of
    their sums over all bigrams; ``pair_sizes``: ``c0, c1`` for bigrams.
    """
    none = np.zeros(0)
    if not min(sizes["s0"], sizes["s1"]):
        return ToxicityModel(none, none, none, none, none, none, ready=False)
    total = sizes["s0"] + sizes["s1"]
    shared = words["n0"] + words["n1"]
    ds = discounts(sizes["cs"])
    freed = (ds[1] * sizes["cs"][0] + ds[2] * sizes["cs"][1] + ds[3] * (sizes["v"] - sizes["cs"][0] - sizes["cs"][1])) / total
    both = (shared - taken(shared, ds)) / total + freed / (sizes["v"] + 1)
    level = []
    for c in "01":
        d = discounts(sizes[f"c{c}"])
        d[1] = 1.0
        n = words[f"n{c}"]
        level.append((n - taken(n, d)) / sizes[f"s{c}"] + freed * both)
    at = np.argsort(words["word"])
    of = at[np.searchsorted(words["word"][at], pairs["word"])] if len(pairs["word"]) else np.zeros(0, np.int64)
    known, h = np.unique(histories["prev"], return_inverse=True)
    sums = {c: np.bincount(h, histories[f"n{c}"], len(known)) if len(known) else none for c in "01"}
    mine = np.searchsorted(known, pairs["prev"])
    probability, weight = [], []
    for c, p in zip("01", level):
        n = pairs[f"n{c}"]
        kept = np.where(n >= CUT, n - taken(n, discounts(pair_sizes[f"c{c}"])), 0.0)
        share = kept / np.maximum(sums[c][mine], 1) if len(n) else none
        left = np.clip(1 - np.bincount(mine, share, len(known)), 1e-6, 1.0) if len(n) else none
        weight.append(left)
        probability.append(share + left[mine] * p[of] if len(n) else none)
    ratio = lambda x: np.log(x[1]) - np.log(x[0])
    return ToxicityModel(words["word"], ratio(level), known.astype(U64), ratio(weight), pair_keys(pairs["word"], pairs["prev"].astype(U64)) if len(of) else none, ratio(probability))


def train_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> ToxicityModel:
    rows = labelled(docs, labels, text, key)
    train = rows.where("fold in (0, 1)")
    sums = lambda c: F.coalesce(F.sum(c), F.lit(0))
    of_counts = lambda c, name: F.array(*(F.count_if(F.col(c) == k) for k in (1, 2, 3, 4))).alias(name)
    classes = [F.count_if(F.expr(f"k & 1 = {c}")).alias(f"n{c}") for c in (0, 1)]
    counts = materialize(contexts(train, 1).distinct().groupBy("word").agg(*classes).withColumn("ns", F.col("n0") + F.col("n1")), "continuations")
    sizes = counts.agg(F.count(F.lit(1)).alias("v"), sums("n0").alias("s0"), sums("n1").alias("s1"), of_counts("n0", "c0"), of_counts("n1", "c1"), of_counts("ns", "cs")).first().asDict()
    # one shuffle: a history's bigrams are dealt over SALTS tasks, which give their sums and those of CUT or more
    grams = contexts(train, 2).selectExpr("shiftrightunsigned(k, 25) as prev", f"pmod(xxhash64(word), {SALTS}) as salt", "word", "k")
    grams = grams.repartition("prev", "salt").dropDuplicates(["prev", "salt", "word", "k"]).groupBy("prev", "salt", "word").agg(*classes)
    seen = Observation("bigrams")
    grams = grams.observe(seen, *(F.count_if(F.col(f"n{c}") == k).alias(f"n{c}_{k}") for c in (0, 1) for k in (1, 2, 3, 4)))
    held = F.collect_list(F.when((F.col("n0") >= CUT) | (F.col("n1") >= CUT), F.struct("word", "n0", "n1"))).alias("held")
    grams = materialize(grams.groupBy("prev", "salt").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), held), "bigrams")
    pair_sizes = {f"c{c}": [seen.get[f"n{c}_{k}"] for k in (1, 2, 3, 4)] for c in (0, 1)}
    kept = grams.select("prev", F.explode("held").alias("h")).select("prev", "h.*")
    told = counts.join(kept.select("word").distinct().withColumn("paired", F.lit(True)), "word", "left").where("n0 > 1 or n1 > 1 or paired")
    history = grams.select("prev", "n0", "n1").join(kept.select("prev").distinct(), "prev", "left_semi")
    arrays = lambda df, *names: {n: v.to_numpy() for n, v in zip(names, df.select(*names).toArrow().columns)}
    words, pairs, histories = arrays(told, "word", "n0", "n1"), arrays(kept, "prev", "word", "n0", "n1"), arrays(history, "prev", "n0", "n1")
    words["word"], pairs["word"] = words["word"].view(U64), pairs["word"].view(U64)
    discard(counts)
    discard(grams)
    model = fitted(words, sizes, pairs, histories, pair_sizes)
    if model.ready:
        fit = rows.where("fold = 3")
        size = fit.count()
        share = min(1.0, FIT_DOCS / max(1, size))
        sample = fit.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30)))
        got = _features(sample, model, "id").join(sample.select(F.col("id"), "toxic"), "id").toPandas() if size else None
        if got is not None and got["toxic"].nunique() == 2:
            model.fit_curve(got[NAMES].to_numpy(), got["toxic"].to_numpy(float))
        else:
            model.fit_curve(np.zeros((0, len(NAMES))), np.zeros(0))
    return model


def _features(rows: DataFrame, model: ToxicityModel, key: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            raw, at = column_bytes(batch.column(1))
            found = [m.features(part, offs) for _, _, part, offs in steps(raw, at)]
            x = np.concatenate(found) if found else np.zeros((0, len(NAMES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(x[:, k])) for k in range(len(NAMES))), pa.array(m.score(x))], names=["id", *NAMES, "score"])

    return rows.select(F.col(key).alias("id"), "text").mapInArrow(run, f"id bigint, {', '.join(f'{n} double' for n in NAMES)}, score double")


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, mean, peak1, peak2, peak4, score`` for every row."""
    rows = docs.selectExpr(f"cast(`{key}` as bigint) as doc_id", f"cast(`{text}` as string) as text")
    return _features(rows, model, "doc_id").withColumnRenamed("id", "doc_id")
