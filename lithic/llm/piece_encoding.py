"""Exact SentencePiece merge-type (BPE) encoding by backtracking, and decoding.

Method: an Aho-Corasick automaton over the pieces gives the longest match at a
position, and shorter ones follow.  A match is taken if it is compatible with the token
before it: re-merging the two tokens' joint text must give the same two tokens
(answers are remembered by pair).  When no match at a position fits, its bit in
a bitfield of failed positions is set and the previous choice is undone.  The
first sequence that reaches the end is the one that merging produces.

Texts are cut where no piece can lie across: before a run of word-boundary
marks, and around characters that no piece holds (they become byte pieces).
Runs of two or more marks hold pieces of one equal score, where a pair test says
nothing; such segments are merged literally.  Words are remembered in a bounded table, so
repeated ones cost one look-up.

A step looks at no more characters than the longest piece has and the bitfield is an
array of bytes, so the time for a text without spaces grows with its length.

Decoding puts together what the ids stand for; the ids of a word are decoded when it is
first met, and texts are put together from decoded words.

Defined results: null and empty texts give the end id only; texts of any length
are encoded whole; equal texts give equal ids, repeated rows a result each; null ids stay
null; an empty table gives an empty table; extra columns stay out, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
#: Words remembered by a worker, in two generations: when the younger is full the older goes, so frequent words stay.
MEMORY = 800_000
#: Pairs whose compatibility is remembered.
PAIRS = 200_000
#: Longer words aren't remembered, so the table stays small.
LONG_WORD = 64
SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


class PieceModel:
    """The pieces of an identity-normalised, byte-fallback BPE model."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        self.end = sp.eos_id()
        self.ids = {p: i for i, p in enumerate(pieces) if not special[i]}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.byte = {int(pieces[i][1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.surface = {i: p.replace(MARK, " ").encode() for p, i in self.ids.items()} | {i: bytes([b]) for b, i in self.byte.items()}
        self.surface |= {i: " \u2047 ".encode() for i in range(n) if sp.is_unknown(i)}
        self.spaced = {i for p, i in self.ids.items() if p.startswith(MARK)}
        self.known = {c for p in self.ids for c in p}
        self.foreign = re.compile(f"([^{re.escape(''.join(sorted(self.known)))}])")
        automaton = ahocorasick.Automaton()
        for p in self.ids:
            automaton.add_word(p, len(p))
        automaton.make_automaton()
        self.automaton, self.longest = automaton, max(map(len, self.ids))
        self.pair_ok: dict[tuple[str, str], bool] = {}
        across = [p for p in self.ids if MARK in p.lstrip(MARK)]
        if across:
            raise ValueError(f"pieces with an inner word mark are not supported: {across[:3]}")

    def merge(self, text: str) -> list[str]:
        """Literal merging: best score first, then leftmost."""
        parts, n, score = list(text), len(text), self.score
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, str, int]] = []

        def offer(i: int) -> None:
            j = nxt[i]
            if j < n and (s := score.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-s, i, parts[i] + parts[j], j))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, whole, j = heapq.heappop(heap)
            if not parts[i] or nxt[i] != j or not parts[j] or parts[i] + parts[j] != whole:
                continue
            parts[i], parts[j] = whole, ""
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
            if prev[i] >= 0:
                offer(prev[i])
            offer(i)
        return [p for p in parts if p]

    def compatible(self, left: str, right: str) -> bool:
        """Whether re-merging the joint text gives the two tokens; with no left token, whether merging makes the right one."""
        found = self.pair_ok.get((left, right))
        if found is None:
            if len(self.pair_ok) >= PAIRS:
                self.pair_ok.clear()
            found = self.pair_ok[left, right] = self.merge(left + right) == ([left, right] if left else [right])
        return found

    def backtrack(self, text: str) -> list[int]:
        """Ids of a segment whose characters all occur in pieces and that has no run of marks."""
        ids, pair_ok, reach, most = self.ids, self.pair_ok, self.automaton.longest_prefix, self.longest
        n, pos, left, size = len(text), 0, "", -1
        failed = bytearray(n // 8 + 1)  # bit p is set if nothing from p reaches the end
        taken: list[str] = []
        while pos < n:
            if size < 0:
                size = reach(text[pos : pos + most])
            while size:
                end = pos + size
                piece = text[pos:end]
                if piece in ids and not failed[end >> 3] >> (end & 7) & 1:
                    ok = pair_ok.get((left, piece))
                    if self.compatible(left, piece) if ok is None else ok:
                        break
                size -= 1
            if size:
                taken.append(piece)
                pos, left, size = pos + size, piece, -1
            elif not taken:
                raise ValueError(f"no encoding of {text!r}")
            else:
                failed[pos >> 3] |= 1 << (pos & 7)
                size = len(taken.pop())
                pos -= size
                size -= 1
                left = taken[-1] if taken else ""
        return [ids[p] for p in taken]

    def segment(self, text: str) -> list[int]:
        """Ids of a segment: marks, then characters without a mark."""
        if not self.foreign.search(text):
            return [self.ids[p] for p in self.merge(text)] if text.startswith(MARK * 2) else self.backtrack(text)
        out: list[int] = []
        for part in self.foreign.split(text):
            if len(part) == 1 and part not in self.known:
                out.extend(self.byte[b] for b in part.encode())
            elif part:
                out.extend(self.segment(part))
        return out

    def encode(self, text: str) -> list[int]:
        """All ids of a whole text, the end id last."""
        out: list[int] = []
        if text:
            for seg in re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK)):
                out.extend(self.segment(seg))
        out.append(self.end)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: marks are spaces, one in front goes; bytes that aren't UTF-8 become U+FFFD one by one."""
        raw = b"".join(self.surface.get(i, b"") for i in ids)
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = _lenient(raw)
        first = next((i for i in ids if i in self.surface), None)
        return text[1:] if first in self.spaced else text


def _lenient(raw: bytes) -> str:
    out, i = [], 0
    while i < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + size].decode())
                i += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


class _Words(dict):
    """Word to its ids as text, once these are decoded to it again; a key that starts with a newline follows no mark."""

    def __init__(self, model: PieceModel, memory: int = MEMORY):
        self.model, self.memory, self.older = model, memory, {}

    def __missing__(self, word: str) -> str:
        found = self.older.get(word)
        if found is None:
            m = self.model
            if word[:1] == "\n":  # a newline lies in no piece, so the rest stands by itself
                ids, shown = [m.byte[10]] + (m.segment(word[1:]) if len(word) > 1 else []), word
            else:
                ids, shown = m.segment(MARK + word), " " + word
            if b"".join([m.surface[i] for i in ids]) != shown.encode():
                raise ValueError(f"{word!r} isn't decoded as it was encoded")
            found = " ".join(map(str, ids))
        if len(word) <= LONG_WORD:
            if len(self) >= self.memory // 2:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found


_MODELS: dict[tuple[str, int], tuple[PieceModel, _Words]] = {}


def piece_model(path: str, memory: int = MEMORY) -> tuple[PieceModel, _Words]:
    """The model and the words met so far, kept by a worker from task to task."""
    if (path, memory) not in _MODELS:
        model = PieceModel(path)
        _MODELS[path, memory] = model, _Words(model, memory)
    return _MODELS[path, memory]


def encode_digests(docs: DataFrame, model_path: str, text: str = "text", key: str = "doc_id", memory: int = MEMORY) -> DataFrame:
    """Per document its number of ids and the SHA-256 of the ids and of the decoded text; ``memory`` words are remembered by a worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, words = piece_model(model_path, memory)
        plain = "\n" not in model.known
        tail = str(model.end)
        for batch in batches:
            counts, ids_hex, text_hex = [], [], []
            for t in batch.column(1).to_pylist():
                if not t:
                    ids_text, raw = "", b""
                elif not plain or "  " in t or " \n" in t or MARK in t or t[0] in " \n" or t[-1] == " ":
                    ids = model.encode(t)[:-1]
                    ids_text, raw = " ".join(map(str, ids)), model.decode(ids).encode()
                else:
                    # a mark starts each word, so words are encoded, and their ids decoded, by themselves;
                    # what a word's ids are decoded to is the word, and the space of the first mark goes
                    found = t.replace("\n", " \n").split(" ")
                    ids_text = " ".join([words[w] for w in found])
                    raw = " ".join(found).replace(" \n", "\n").encode()
                counts.append(ids_text.count(" ") + 2 if ids_text else 1)
                ids_hex.append(hashlib.sha256((f"{ids_text} {tail}" if ids_text else tail).encode()).hexdigest())
                text_hex.append(hashlib.sha256(raw).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.selectExpr(f"cast(`{key}` as bigint) as doc_id", f"cast(`{text}` as string) as text").mapInArrow(run, SCHEMA)


def encode_ids(docs: DataFrame, model_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document all its ids, the end id last: ``doc_id, ids array<int>``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, _ = piece_model(model_path)
        for batch in batches:
            ids = [model.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.selectExpr(f"cast(`{key}` as bigint) as doc_id", f"cast(`{text}` as string) as text").mapInArrow(run, "doc_id bigint, ids array<int>")
