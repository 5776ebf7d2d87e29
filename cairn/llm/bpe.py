"""Encoding a corpus with a public byte-level BPE vocabulary (problem 6).

Method: a rank queue over linked lists. All distinct pre-tokens of an Arrow batch are laid end to end
in one array of symbols, each pre-token being a doubly linked list. One bucket per merge rank holds the
positions at which that merge is possible; a three-level bitmap finds the lowest non-empty rank
(find-first-set). Popping a bucket applies the merge at all its positions at once, skips the entries that
went stale, and files the new neighbour pairs in their buckets. A pre-token's merges are independent of
all others, and a merge only ever creates pairs of higher rank, so the lowest rank of the whole batch is
always a legal next step for each pre-token. Work is linear in merges, also for pre-tokens of megabytes.

Spark distributes the documents; nothing is shuffled.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Where the public vocabularies lie on every machine.
TOKENIZER_DIR = "/opt/tokenizers"
#: Pre-token pattern of the byte-level 50k vocabulary. Fixed value, published with it.
PRETOKEN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Encoded pre-tokens that a Python worker keeps between batches.
CACHE_ENTRIES = 200_000
#: Code points of documents that are encoded together.
SLICE_CHARS = 4_000_000


class RankBitmap:
    """The set of non-empty ranks, as three levels of 64-bit words; the lowest is found in three steps."""

    def __init__(self, size: int):
        self.low = [0] * (size // 64 + 1)
        self.mid = [0] * (size // 4096 + 1)
        self.top = 0

    def add(self, rank: int) -> None:
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def pop(self) -> int:
        """The lowest rank, removed; -1 if the set is empty."""
        if not self.top:
            return -1
        a = (self.top & -self.top).bit_length() - 1
        b = a << 6 | (self.mid[a] & -self.mid[a]).bit_length() - 1
        rank = b << 6 | (self.low[b] & -self.low[b]).bit_length() - 1
        self.low[b] &= self.low[b] - 1
        if not self.low[b]:
            self.mid[a] &= self.mid[a] - 1
            if not self.mid[a]:
                self.top &= self.top - 1
        return rank


class Vocabulary:
    """Merges of a byte-level vocabulary as arrays over token ids."""

    def __init__(self, directory: str, name: str):
        with open(f"{directory}/{name}.tiktoken", "rb") as f:
            words = {int(rank): base64.b64decode(word) for word, rank in map(bytes.split, f)}
        with open(f"{directory}/{name}.json", encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids = model["vocab"]
        self.byte_ids = np.zeros(256, np.int64)
        for i, word in words.items():
            if len(word) == 1:
                self.byte_ids[word[0]] = i
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left = np.array([ids[a] for a, _ in pairs], np.int64)
        self.right = np.array([ids[b] for _, b in pairs], np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        keys = self.left << 20 | self.right
        self._order = np.argsort(keys, kind="stable")
        self._keys = keys[self._order]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge rank of each pair of token ids, -1 where there is no such merge."""
        keys = a << 20 | b
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where(self._keys[at] == keys, self._order[at], -1)


@lru_cache(maxsize=4)
def vocabulary(directory: str, name: str) -> Vocabulary:
    return Vocabulary(directory, name)


def _file(buckets: dict, bits: RankBitmap, ranks: np.ndarray, positions: np.ndarray) -> None:
    keep = ranks >= 0
    ranks, positions = ranks[keep], positions[keep]
    if not len(ranks):
        return
    order = np.argsort(ranks, kind="stable")
    ranks, positions = ranks[order], positions[order]
    cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
    starts = [0, *cuts.tolist()]
    for r, s, e in zip(ranks[starts].tolist(), starts, [*starts[1:], len(ranks)], strict=True):
        if r in buckets:
            buckets[r].append(positions[s:e])
        else:
            buckets[r] = [positions[s:e]]
            bits.add(r)


def encode_pretokens(words: list[bytes], voc: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words end to end, and how many ids each word has."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    sym = voc.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    n = len(sym)
    ends = np.cumsum(sizes)
    nxt = np.arange(1, n + 1)
    nxt[ends[sizes > 0] - 1] = -1
    prv = np.arange(-1, n - 1)
    prv[(ends - sizes)[sizes > 0]] = -1
    alive = np.ones(n, bool)
    seen = np.zeros(n, bool)
    buckets: dict[int, list[np.ndarray]] = {}
    bits = RankBitmap(len(voc.merged))
    at = np.flatnonzero(nxt >= 0)
    _file(buckets, bits, voc.ranks(sym[at], sym[at + 1]), at)
    while (rank := bits.pop()) >= 0:
        filed = buckets.pop(rank)
        p = filed[0] if len(filed) == 1 else np.sort(np.concatenate(filed))
        a, b = voc.left[rank], voc.right[rank]
        q = nxt[p]
        fresh = alive[p] & (q >= 0) & (sym[p] == a) & (sym[q] == b)  # the others went stale
        if not fresh.all():
            p, q = p[fresh], q[fresh]
        if a == b and len(p) > 1:  # in a run of equal symbols every second pair merges, from the left
            p = np.sort(p)
            q = nxt[p]
            head = np.r_[True, q[:-1] != p[1:]]
            run = np.maximum.accumulate(np.where(head, np.arange(len(p)), 0))
            even = (np.arange(len(p)) - run) % 2 == 0
            p, q = p[even], q[even]
        if not len(p):
            continue
        sym[p] = voc.merged[rank]
        alive[q] = False
        after = nxt[q]
        nxt[p] = after
        has = after >= 0
        prv[after[has]] = p[has]
        before = prv[p]
        seen[p] = True
        before = before[(before >= 0) & ~seen[before]]
        seen[p] = False
        new = np.concatenate([p[has], before])
        _file(buckets, bits, voc.ranks(sym[new], sym[nxt[new]]), new)
    owner = np.repeat(np.arange(len(words)), sizes)[alive]
    return sym[alive].astype(np.int32), np.bincount(owner, minlength=len(words))


class Encoder:
    """Encodes lists of texts; keeps the ids of pre-tokens it has met, within a bound."""

    def __init__(self, directory: str = TOKENIZER_DIR, name: str = "byte_bpe_50k"):
        self.voc = vocabulary(directory, name)
        self.split = regex.compile(PRETOKEN_PATTERN).findall
        self.known: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.starts = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)

    def _learn(self, words: list[str]) -> None:
        ids, counts = encode_pretokens([w.encode() for w in words], self.voc)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
        self.ids = np.concatenate([self.ids, ids])
        self.counts = np.concatenate([self.counts, counts])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end and the number of ids of each; null and empty texts have none."""
        if len(self.known) > CACHE_ENTRIES:
            self.known, self.ids, self.starts, self.counts = {}, self.ids[:0], self.starts[:0], self.counts[:0]
        known, sizes, index = self.known, [], []
        old = len(known)
        for text in texts:
            words = self.split(text) if text else ()
            sizes.append(len(words))
            index += [known.setdefault(w, len(known)) for w in words]
        if len(known) > old:
            self._learn(list(known)[old:])
        where = np.array(index, np.int64)
        counts = self.counts[where]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.ids[np.repeat(self.starts[where] - (ends - counts), counts) + np.arange(total)]
        cuts = np.cumsum(np.array(sizes, np.int64))
        upto = np.r_[0, ends][cuts] if len(cuts) else cuts
        return flat, np.diff(np.r_[0, upto])


def _slices(texts: list[str | None]) -> Iterator[list[str | None]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "") + 1
        if size >= SLICE_CHARS:
            yield part
            part, size = [], 0
    yield part


@lru_cache(maxsize=4)
def _encoder(directory: str, name: str) -> Encoder:
    return Encoder(directory, name)


def encode_column(df: DataFrame, key: str, text: str, directory: str = TOKENIZER_DIR, name: str = "byte_bpe_50k") -> DataFrame:
    """``key`` and ``ids`` (array<int>), the token ids of ``text`` without special tokens.

    Strings that look like special tokens are plain text. Null and empty texts have the empty list.
    Rows are mapped one to one: repeated rows stay repeated, no other column is read.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(directory, name)
        for batch in batches:
            keys, done = batch.column(0), 0
            for part in _slices(batch.column(1).to_pylist()):
                ids, counts = enc.encode(part)
                offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([keys.slice(done, len(part)), lists], ["key", "ids"])
                done += len(part)

    out = df.select(df[key], df[text]).mapInArrow(run, f"key {kind}, ids array<int>")
    return out.withColumnRenamed("key", key)


def count_tokens(df: DataFrame, text: str, keep: list[str], directory: str = TOKENIZER_DIR, name: str = "byte_bpe_50k") -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` (bigint), the token count of ``text`` (0 if null or empty)."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(directory, name)
        for batch in batches:
            texts, counts = batch.column(len(keep)).to_pylist(), []
            for part in _slices(texts):
                counts.append(enc.encode(part)[1])
            n = pa.array(np.concatenate(counts).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], n], [*keep, "n_tokens"])

    return df.select(*(df[c] for c in keep), df[text].alias("__text")).mapInArrow(run, f"{kinds}, n_tokens bigint")
