"""The vectorised parts of the operators against plain Python."""

import random
import re

import numpy as np
import pytest
import xxhash

from lithic.llm import suffix_dedup
from lithic.llm.bytesio import KeyTable, runs, xxh64
from lithic.llm.language_ppm import LanguageModel, gram_keys
from lithic.llm.piece_encoding import MARK, PieceModel
from lithic.llm.simhash_vptree import HomePoints, VantagePoints, VantageTree, WideTree, simhash_rows, wide_links
from lithic.llm.topk_bitsliced import BitSlicedIndex


def joined(texts):
    bs = [t.encode() for t in texts]
    return np.frombuffer(b"".join(bs), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in bs])])


def test_xxh64_and_key_table():
    rng = random.Random(1)
    raw = bytes(rng.randrange(256) for _ in range(3000))
    s = np.array([rng.randrange(2900) for _ in range(500)])
    e = np.minimum(s + np.array([rng.randrange(100) for _ in range(500)]), 3000)
    assert [int(h) for h in xxh64(np.frombuffer(raw, np.uint8), s, e)] == [xxhash.xxh64_intdigest(raw[a:b], 42) for a, b in zip(s, e)]
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 62, 5000).astype(np.uint64))
    t = KeyTable(keys)
    assert (t.find(keys) == np.arange(len(keys))).all() and (t.find(keys + np.uint64(1))[~np.isin(keys + np.uint64(1), keys)] == -1).all()
    assert KeyTable(np.zeros(0, np.uint64)).find(keys[:3]).tolist() == [-1, -1, -1]
    assert runs(np.zeros(0, bool), np.array([0]))[0].tolist() == []


def simhash_brute(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in t.encode()))
    sh = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else ([b" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum((2 * sum(h >> b & 1 for h in hs) > len(hs)) << b for b in range(64)) if hs else 0


def test_simhash_rows():
    rng = random.Random(2)
    texts = ["", " ", "a", "Ab  c", "a b c d", "x" * 200 + " y z w v", " a b\tc\nd e é Ü  f ", " a b c"]
    texts += [" ".join(rng.choice(["the", "A", "é" * 20, "\n", "x1", "a\tb"]) for _ in range(rng.randrange(700))) for _ in range(40)]
    assert [int(x) for x in simhash_rows(*joined(texts))] == [simhash_brute(t) for t in texts]


@pytest.mark.parametrize("leaf", [16, 64, 100_000])
def test_vantage_tree_misses_no_link(leaf):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 62, 60).astype(np.uint64)
    flips = lambda k: np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 62, k).astype(np.uint64))
    pts = np.unique(np.array([c ^ flips(int(rng.integers(1, 7))) for c in centres for _ in range(8)], np.uint64))
    tree = VantageTree(pts[::2], len(pts), leaf)
    row, shard, home = tree.route(pts)
    assert home.sum() == len(pts)
    links = []
    for k in range(tree.leaves):
        mine, others = row[(shard == k) & home], row[(shard == k) & ~home]
        held = HomePoints(pts[mine])
        links += [np.stack([mine[x], mine[y]], axis=1) for x, y, _ in held.joined(None)]
        for part in np.array_split(others, 3):  # visitors come in batches
            links += [np.stack([mine[x], part[v] if y is None else mine[y]], axis=1) for x, y, v in held.joined(pts[part])]

    def groups(edges):
        p = list(range(len(pts)))

        def f(i):
            while p[i] != i:
                i = p[i]
            return i

        for a, b in edges:
            a, b = sorted((f(int(a)), f(int(b))))
            p[b] = a
        return [f(i) for i in range(len(pts))]

    brute = [(i, j) for i in range(len(pts)) for j in np.flatnonzero(np.bitwise_count(pts[i] ^ pts) <= 4) if j > i]
    assert groups(np.concatenate(links)) == groups(brute)


def test_wide_links():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 62, (40, 2)).astype(np.uint64)
    pts = np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 62, (40, 2)).astype(np.uint64)) for _ in range(5))])
    for radius in (2, 32, 50):
        near = [(i, j) for i in range(len(pts)) for j in range(i) if np.bitwise_count(pts[i] ^ pts[j]).sum() <= radius]
        got = wide_links(pts, np.arange(len(pts)), radius)
        parent = list(range(len(pts)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        def groups(edges):
            parent[:] = range(len(pts))
            for a, b in edges:
                a, b = sorted((find(int(a)), find(int(b))))
                parent[b] = a
            return [find(i) for i in range(len(pts))]

        assert groups(got) == groups(near) and len(got) == len(pts) - len(set(groups(near)))


@pytest.mark.parametrize("radius", [12, 32])
def test_wide_trees_miss_no_pair(radius):
    rng = np.random.default_rng(9)
    flips = lambda k: np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (k, 2)).astype(np.uint64), axis=0)
    centres = rng.integers(0, 1 << 63, (25, 2)).astype(np.uint64)
    pts = np.unique(np.array([c ^ flips(int(rng.integers(1, 5))) for c in centres for _ in range(40)]), axis=0)
    near = lambda a, b: np.bitwise_count(a[:, None] ^ b[None]).sum(axis=2, dtype=int) <= radius
    # a tree that knows all its points looks up others too, and spares most comparisons
    held = VantagePoints(pts, radius)
    others = np.concatenate([pts[::3] ^ np.uint64(5), rng.integers(0, 1 << 63, (50, 2)).astype(np.uint64)])
    found = np.zeros((len(pts), len(others)), bool)
    for x, y in held.links(others):
        found[x, y] = True
    assert (found == near(pts, others)).all()
    row, leaf, _ = held.tree.route(pts, at_home=False)
    assert sum(len(h) * (leaf == k).sum() for k, h in enumerate(held.held)) < 0.5 * len(pts) ** 2
    # one that knows a sample brings each pair together where one of it is at home
    tree = WideTree(pts[::4], len(pts), 64, radius, deals=True)
    row, leaf, home = tree.route(pts)
    assert np.bincount(row[home], minlength=len(pts)).tolist() == [1] * len(pts) and tree.leaves > 8
    met = np.zeros((len(pts), len(pts)), bool)
    for k in range(tree.leaves):
        met[np.ix_(row[(leaf == k) & home], row[leaf == k])] = True
    assert not (near(pts, pts) & ~(met | met.T)).any()


def test_bit_sliced_index():
    rng = np.random.default_rng(5)
    v = rng.integers(-300, 300, (70, 6))
    v[10:20] = v[0]  # ties
    ids = rng.permutation(70) * 3
    ids[5] = ids[4]
    index = BitSlicedIndex(ids, v)
    for i in range(0, 70, 7):
        s = v @ v[i]
        want = sorted(((-int(s[j]), int(ids[j])) for j in range(70) if ids[j] != ids[i]))[:5]
        assert index.top(v[i].tolist(), int(ids[i]), 5) == [(j, -x) for x, j in want]
    assert BitSlicedIndex(np.array([1, 2]), np.array([[3], [4]])).top([2], 1, 5) == [(2, 8)]


def test_frozen_context_trees():
    """Code lengths against the definition, symbol by symbol."""
    train, order = {"a": b"abracadabra", "b": b"banana band"}, 2
    langs = sorted(train)
    rows = []
    for n, name in enumerate(langs):
        raw = np.frombuffer(train[name], np.uint8)
        for k, keys in enumerate(gram_keys(raw, np.array([0, len(raw)]), order)):
            rows += [(n, k, int(u), c) for u, c in zip(*np.unique(keys, return_counts=True))]
    cols = list(zip(*rows))
    m = LanguageModel.fit(langs, np.array(cols[0]), np.array(cols[1]), np.array(cols[2], np.uint64), np.array(cols[3], float), order)

    def cost(name, text):
        data, total = b"\0" * order + train[name], 0.0
        pad = b"\0" * order + text
        for i in range(order, len(pad)):
            for k in range(order, -1, -1):
                seen = [data[j] for j in range(order, len(data)) if data[j - k : j] == pad[i - k : i]]
                if not seen:
                    continue
                c, t, d = seen.count(pad[i]), len(seen), len(set(seen))
                if c:
                    total -= np.log2(c / (t + d))
                    break
                total -= np.log2(d / (t + d))
            else:
                total += 8
        return total

    texts = [b"abra", b"band", b"xyz", b"bananas", b""]
    got = m.costs(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    assert np.allclose(got, [[cost(n, t) for n in langs] for t in texts], rtol=1e-5)


def test_pieces_as_the_library():
    public = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = public.path("piece_bpe_32k.model")
    m, sp = PieceModel(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(6)
    parts = [" ", "  ", "   ", "a", "th", "he", "\n", "é", "日", MARK, "\x00", "😀", "ing", "aaa", "ß", "0", ".", "...", "  \n", "́", "====", "\r", "\t", "able", "<s>", "</s>"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        ids = sp.encode(t, add_eos=True)
        assert m.encode(t) == ids
        assert m.decode(ids) == sp.decode(ids)
        some = [rng.randrange(32000) for _ in range(rng.randrange(6))] + [rng.randrange(3, 259) for _ in range(rng.randrange(5))]
        assert m.decode(some) == sp.decode(some)


def test_merged_transforms_sort_strings():
    rng = random.Random(7)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(100, 190))) for _ in range(30)] + [b"a" * 140, b"a" * 120, b"\xff" * 101]
    alphabet = suffix_dedup.Alphabet(texts)
    place = np.concatenate([np.arange(b, b + len(t) - 99) for t, b in zip(texts, alphabet.base)])
    where = [(t, p) for t in range(len(texts)) for p in range(len(texts[t]) - 99)]
    string, block = suffix_dedup.merge_shards([suffix_dedup.Shard(alphabet, place[a:b]) for a, b in ((0, 700), (700, 700), (700, 1500), (1500, None))])
    keys = [texts[t][p : p + 100] for t, p in (where[i] for i in string)]
    assert sorted(string) == list(range(len(where))) and keys == sorted(keys)
    assert all((a == b) == (x == y) for a, b, x, y in zip(keys, keys[1:], block, block[1:]))
