"""BPE encoding and decoding with a contiguous array of part boundaries and adjacent ranks for each short word.

A word's parts lie side by side in a row of an array; beside each part stands the rank of its merge with the next one. The
smallest rank of the row is found, its boundary is deleted (the parts behind move up), and the two neighbouring ranks are
looked up anew, until no rank is left. Words of like length are rows of one array, so one scan serves thousands of words.
Words longer than ``SHORT`` bytes go through the same steps one by one, with a heap of ranks in place of the scan, so a
very long word costs n log n.

Defined results. Null text: as empty. Empty text: no tokens, both digests are of nothing. Repeated rows: each is returned.
Empty table: empty result. Special tokens' strings in a text become their ids, as the tokenizers library does.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm._shared import map_arrow, text_slices

#: Bytes of the longest word that takes the scanned array.
SHORT = 64
#: Words in each half of a worker's memory of encoded words: some 20 MB, which a worker keeps between partitions.
REMEMBERED = 60_000
_NONE = np.int32(2**31 - 1)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable Latin-1 as it is, the rest from U+0100 up."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = (b for b in range(256) if b not in shown)
    moved = {b: chr(0x100 + i) for i, b in enumerate(hidden)}
    return [moved.get(b, chr(b)) for b in range(256)]


class RankBpe:
    """A byte-level BPE vocabulary with word ends, read from a ``tokenizers`` JSON file."""

    def __init__(self, spec: str):
        t = json.loads(spec)
        model, self.suffix = t["model"], t["model"]["end_of_word_suffix"] or ""
        vocab = model["vocab"]
        self.special = {a["content"]: a["id"] for a in t["added_tokens"]}
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + self.suffix] for c in letters], np.int32)
        pairs = [m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"]]
        left, right, made = (np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in pairs), strict=True))
        self.base = int(max(vocab.values())) + 1
        # open addressing over a table of some eight times the merges: a pair is found in one or two looks
        self.bits = int(np.ceil(np.log2(len(pairs) * 8)))
        self.keys, self.rank, self.made = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, _NONE, np.int32), np.zeros(1 << self.bits, np.int32)
        for rank, (key, out) in enumerate(zip((left * self.base + right).tolist(), made.tolist(), strict=True)):
            at = self._slot(key)
            while self.keys[at] >= 0 and self.keys[at] != key:
                at = (at + 1) & ((1 << self.bits) - 1)
            if self.keys[at] < 0:
                self.keys[at], self.rank[at], self.made[at] = key, rank, out
        self.probes = 1
        while self._unreached():
            self.probes += 1
        self.token = [b""] * (max([self.base - 1, *self.special.values()]) + 1)
        for token, i in [*vocab.items(), *self.special.items()]:
            self.token[i] = token.encode()
        # fixed values: the word pattern of the vocabulary's file; blanks as Unicode has them
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, tuple[int, bytes, bytes]] = {}
        self.older: dict[str, tuple[int, bytes, bytes]] = {}

    def _slot(self, key: int) -> int:
        return ((key * 0x9E3779B97F4A7C15) & (2**64 - 1)) >> (64 - self.bits)

    def _unreached(self) -> bool:
        full = np.flatnonzero(self.keys >= 0)
        home = (self.keys[full].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
        return bool((((full - home.astype(np.int64)) & ((1 << self.bits) - 1)) >= self.probes).any())

    def _look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slot of the merge of each pair; the rank there is _NONE, or the slot is -1, where the pair has no merge."""
        key = left.astype(np.int64) * self.base + right
        at = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        slot = np.where(self.keys[at] == key, at, -1)
        for k in range(1, self.probes):
            near = (at + k) & ((1 << self.bits) - 1)
            slot = np.where(self.keys[near] == key, near, slot)
        return slot

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        slot = self._look(left, right)
        return np.where(slot >= 0, self.rank[slot], _NONE)

    def merge_rows(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge words of one length (a row each); the merged rows, and how many parts each has left."""
        n, width = parts.shape
        parts = parts.copy()
        size = np.full(n, width)
        if width < 2:
            return parts, size
        ranks = self._ranks(parts[:, :-1], parts[:, 1:])
        live = np.arange(n)
        column = np.arange(width)
        while len(live):
            at = ranks[live].argmin(1)
            found = ranks[live, at] < _NONE
            live, at = live[found], at[found]
            if not len(live):
                break
            row = parts[live]
            row[np.arange(len(live)), at] = self.made[self._look(row[np.arange(len(live)), at], row[np.arange(len(live)), at + 1])]
            # delete the boundary: parts behind it move up by one
            source = np.minimum(column + (column > at[:, None]), width - 1)
            row = np.take_along_axis(row, source, 1)
            parts[live] = row
            size[live] -= 1
            rank = np.take_along_axis(ranks[live], np.minimum(source[:, :-1], width - 2), 1)
            rank[:, -1] = _NONE
            left = np.maximum(at - 1, 0)
            for place, ok in ((at, at + 1 < size[live]), (left, at > 0)):
                mine = np.flatnonzero(ok)
                rank[mine, place[mine]] = self._ranks(row[mine, place[mine]], row[mine, place[mine] + 1])
            rank[np.arange(width - 1) >= (size[live] - 1)[:, None]] = _NONE
            ranks[live] = rank
        return parts, size

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same merges for one long word: boundaries in a linked row, ranks in a heap."""
        n = len(parts)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        arr = np.array(parts, np.int32)
        first = self._ranks(arr[:-1], arr[1:])
        heap = [(int(r), i, parts[i], parts[i + 1]) for i, r in enumerate(first) if r < _NONE]
        heapq.heapify(heap)

        def push(i: int) -> None:
            j = after[i]
            if i >= 0 and j < n and (m := self._pair(parts[i], parts[j])):
                heapq.heappush(heap, (m[0], i, parts[i], parts[j]))

        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], after[i] = self._pair(a, b)[1], False, after[j]
            if after[i] < n:
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return [p for p, ok in zip(parts, alive, strict=True) if ok]

    def _pair(self, a: int, b: int) -> tuple[int, int] | None:
        key, at = a * self.base + b, self._slot(a * self.base + b)
        while self.keys[at] >= 0:
            if self.keys[at] == key:
                return int(self.rank[at]), int(self.made[at])
            at = (at + 1) & ((1 << self.bits) - 1)
        return None

    def learn(self, words: list[str]) -> None:
        """Encode distinct words into the memory: (tokens, ids as little-endian words, decoded bytes)."""
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            by_size.setdefault(len(raw := w.encode()), []).append((w, raw))
        for width, pairs in by_size.items():
            if width > SHORT:
                for w, raw in pairs:
                    b = np.frombuffer(raw, np.uint8)
                    self._keep(w, self.merge_long([*self.inner[b[:-1]].tolist(), int(self.last[b[-1]])]))
                continue
            b = np.frombuffer(b"".join([raw for _, raw in pairs]), np.uint8).reshape(len(pairs), width)
            parts = self.inner[b]
            parts[:, -1] = self.last[b[:, -1]]
            merged, size = self.merge_rows(parts)
            raw, step, token, known = merged.astype("<u4").tobytes(), 4 * width, self.token, self.known
            for i, ((w, _), row, k) in enumerate(zip(pairs, merged.tolist(), size.tolist(), strict=True)):
                known[w] = k, raw[i * step : i * step + 4 * k], b" ".join([token[t] for t in row[:k]])

    def _keep(self, word: str, ids: list[int]) -> None:
        self.known[word] = len(ids), np.array(ids, "<u4").tobytes(), b" ".join([self.token[i] for i in ids])

    def pieces(self, text: str) -> list[str]:
        """Words in order; a special token's string stands with a leading NUL, which no word of the pattern's kinds shares with it."""
        out: list[str] = []
        for k, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                out.append("\0" + part)
            elif part:
                if not part.isascii():
                    if not unicodedata.is_normalized("NFC", part):
                        part = unicodedata.normalize("NFC", part)
                    part = part.replace("Σ", "σ")  # letter by letter: no final sigma
                out += self.words.findall(part.lower())
        return out

    def encode(self, texts: list[str]) -> list[tuple[int, bytes, bytes]]:
        """For each text: tokens, ids as little-endian 32-bit words, decoded bytes (tokens joined by a blank)."""
        split = [self.pieces(t) for t in texts]
        met = set(chain.from_iterable(split))
        if len(self.known) > REMEMBERED:  # words that aren't met now go to the older half, whose own unmet words are forgotten
            self.known, self.older = {}, self.known
        if self.older:
            self.known |= {w: self.older[w] for w in met.intersection(self.older).difference(self.known)}
        for s, i in self.special.items():
            self.known.setdefault("\0" + s, (1, np.array([i], "<u4").tobytes(), s.encode()))
        self.learn(list(met.difference(self.known)))
        out = []
        for words in split:
            if words:
                sizes, ids, decoded = zip(*map(self.known.__getitem__, words), strict=True)
                out.append((sum(sizes), b"".join(ids), b" ".join(decoded)))
            else:
                out.append((0, b"", b""))
        return out

    def decode(self, ids: bytes) -> str:
        """The library's decode without a decoder: the tokens' strings, joined by a blank."""
        return b" ".join([self.token[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode()


@lru_cache(2)
def _loaded(spec: str) -> RankBpe:
    return RankBpe(spec)


def tokenizer_spec(path: str) -> str:
    """The vocabulary file's text, read once on the driver and sent with the tasks (its size doesn't grow with the data)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def bpe_encode(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` (little-endian 32-bit words) and ``decoded`` of every text; one pass, no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches):
        bpe = _loaded(sent.value)
        for rows, texts in text_slices(batches, "_text"):
            got = bpe.encode([(t or b"").decode() for t in texts.to_pylist()])
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.binary()), pa.array([g[2] for g in got], pa.binary()).cast(pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text")), run, "doc_id long, n_tokens long, ids binary, decoded string")


def bpe_digest(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same pass with ids and decoded text as SHA-256 digests, taken in the worker so that they needn't travel."""
    sent = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches):
        bpe = _loaded(sent.value)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for rows, texts in text_slices(batches, "_text"):
            got = bpe.encode([(t or b"").decode() for t in texts.to_pylist()])
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([sha(g[1]) for g in got]), pa.array([sha(g[2]) for g in got])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
