"""Byte-pair merges over many pieces at once by a pair occurrence index.

All pieces of a block lie end to end in one array of symbols. The index maps every
mergeable pair, named by its rank, to all positions where it occurs in the block.
Ranks are applied in ascending order; each application merges all occurrences of one
pair, left to right within a run, and updates the lists of the pairs beside them.

A merge can only make pairs whose rank is higher than its own (the table is checked
for that), so no rank comes up twice and the result equals merging each piece alone.
"""

from __future__ import annotations

import heapq
import json

import numpy as np


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class MergeTable:
    """The vocabulary and merges of a byte-level tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        vocab = data["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in data["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        symbols = byte_symbols()
        self.byte_ids = np.array([vocab[s] for s in symbols], np.int32)
        self.width = len(vocab) + len(self.special) + 1
        left, right, made = (np.array([vocab[t] for t in col], np.int64) for col in ([a for a, _ in merges], [b for _, b in merges], [a + b for a, b in merges]))
        born = np.full(self.width, -1)
        born[made] = np.arange(len(made))
        if len(set(made.tolist())) != len(made) or (np.maximum(born[left], born[right]) >= np.arange(len(made))).any():
            raise ValueError("a merge uses a symbol that only a later merge makes")
        self.made = made.astype(np.int32)
        self.left, self.right = left.astype(np.int32), right.astype(np.int32)
        keys = left * self.width + right
        order = np.argsort(keys)
        self.keys, self.ranks = np.append(keys[order], np.iinfo(np.int64).max), np.append(order, -1).astype(np.int32)
        to_byte = {s: b for b, s in enumerate(symbols)}
        spelled = [b""] * self.width
        for token, i in vocab.items():
            spelled[i] = bytes(to_byte[c] for c in token)
        for token, i in self.special.items():
            spelled[i] = token.encode()
        self.spelled = spelled
        self.spelled_len = np.array([len(s) for s in spelled], np.int64)
        self.spelled_at = np.cumsum(self.spelled_len) - self.spelled_len
        self.spelled_flat = np.frombuffer(b"".join(spelled), np.uint8)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it has none."""
        key = a.astype(np.int64) * self.width + b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids spell, before invalid UTF-8 is replaced."""
        n = self.spelled_len[ids]
        ends = np.cumsum(n)
        if not len(ends):
            return b""
        return self.spelled_flat[np.repeat(self.spelled_at[ids] - (ends - n), n) + np.arange(ends[-1])].tobytes()


def merge_block(table: MergeTable, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all pieces end to end, number of ids of each)."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int32), sizes
    symbol = table.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
    owner = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
    after = np.arange(1, total + 1, dtype=np.int64)
    before = np.arange(-1, total - 1, dtype=np.int64)
    edge = np.flatnonzero(owner[1:] != owner[:-1])
    after[edge], before[edge + 1] = total, -1
    after[total - 1] = total
    alive = np.ones(total, bool)

    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def enlist(at: np.ndarray, ranks: np.ndarray) -> None:
        known = ranks >= 0
        at, ranks = at[known], ranks[known]
        if not len(at):
            return
        order = np.lexsort((at, ranks)) if len(at) > 1 else slice(None)
        at, ranks = at[order], ranks[order]
        cut = np.flatnonzero(np.diff(ranks)) + 1
        for rank, part in zip(ranks[np.append(0, cut)].tolist(), np.split(at, cut) if len(cut) else [at], strict=True):
            if rank in index:
                index[rank].append(part)
            else:
                index[rank] = [part]
                heapq.heappush(active, rank)

    start = np.flatnonzero(after < total)
    enlist(start, table.rank(symbol[start], symbol[after[start]]))
    while active:
        rank = heapq.heappop(active)
        lists = index.pop(rank)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        a, b, made = table.left[rank], table.right[rank], table.made[rank]
        at = at[alive[at] & (symbol[at] == a)]
        nxt = after[at]
        fits = nxt < total
        at, nxt = at[fits], nxt[fits]
        fits = symbol[nxt] == b
        at, nxt = at[fits], nxt[fits]
        if a == b and len(at) > 1:  # of a run of equal symbols every second pair merges
            head = np.append(True, nxt[:-1] != at[1:])
            run = np.arange(len(at)) - np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
            at, nxt = at[run % 2 == 0], nxt[run % 2 == 0]
        if not len(at):
            continue
        symbol[at] = made
        alive[nxt] = False
        beyond = after[nxt]
        after[at] = beyond
        inner = beyond < total
        before[beyond[inner]] = at[inner]
        prior = before[at]
        led = prior >= 0
        changed = np.unique(np.concatenate([prior[led], at[inner]]))  # of two neighbours that both merged, the pair is listed once
        if len(changed):
            enlist(changed, table.rank(symbol[changed], symbol[after[changed]]))
    return symbol[alive], np.bincount(owner[alive], minlength=len(pieces))
