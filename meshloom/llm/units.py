"""Ids of whole texts from the ids of their distinct parts.

Texts are cut at places where the tokenizer's own pre-tokenization always cuts, so that
the ids of a text are those of its units end to end. Each worker keeps a bounded table of
the units it has met; only unseen ones are tokenized. When the table is full, units met only
once are forgotten, which costs time and changes nothing.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import regex

from meshloom.llm.pairs import MergeTable, byte_symbols, merge_block

#: White space as Unicode's White_Space property has it (fixed values).
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The byte-level pre-tokenization pattern (fixed value).
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The word-level pre-tokenization pattern (fixed value).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Below this code point the classes of letters, numbers and spaces are the same in all Unicode versions and texts are in composed form.
STABLE = 0x250
#: Longer texts are cut into segments of about so many characters.
SEGMENT = 1_000_000


class Seen(dict):
    """Dense numbers for keys in the order of first sight; ``new`` holds those not yet tokenized."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list = []

    def __missing__(self, key) -> int:
        i = self[key] = len(self)
        self.new.append(key)
        return i

    def of(self, keys: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), np.int32, len(keys))

    def take_new(self) -> list:
        new, self.new = self.new, []
        return new


class Runs:
    """Runs of ids, one for each number of a ``Seen``, end to end in one growing array."""

    def __init__(self) -> None:
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.size = np.zeros(0, np.int64)
        self.at = np.zeros(0, np.int64)

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        if self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(len(self.flat), 2 * len(flat)), np.int32)])
        self.flat[self.used : self.used + len(flat)] = flat
        ends = np.cumsum(sizes)
        self.at = np.concatenate([self.at, self.used + ends - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.used += len(flat)

    def sizes(self, which: np.ndarray) -> np.ndarray:
        return self.size[which]

    def gather(self, which: np.ndarray) -> np.ndarray:
        n = self.size[which]
        if not len(n):
            return np.zeros(0, np.int32)
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.at[which] - (ends - n), n) + np.arange(ends[-1])]


class Sizes(Runs):
    """How long the runs are, without their ids."""

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.size = np.concatenate([self.size, sizes])

    def gather(self, which: np.ndarray) -> np.ndarray:
        return np.zeros(0, np.int32)


class Table:
    """Keys met so far with their runs of ids. When full, keys met only once are forgotten."""

    def __init__(self, limit: int, runs: type[Runs]) -> None:
        self.limit, self.kind = limit, runs
        self.clear()

    def clear(self) -> None:
        self.seen, self.runs, self.hits = Seen(), self.kind(), np.zeros(0, np.int64)

    def make_room(self) -> None:
        """If full: keep the keys met twice or more, the most frequent ones up to half of the limit."""
        if len(self.seen) <= self.limit:
            return
        keep = np.flatnonzero(self.hits > 1)
        if len(keep) > self.limit // 2:
            keep = np.sort(np.argsort(-self.hits, kind="stable")[: self.limit // 2])
        keys, runs, hits = list(self.seen), self.runs, self.hits
        self.clear()
        self.seen.update((keys[i], k) for k, i in enumerate(keep.tolist()))
        self.runs.add(runs.gather(keep), runs.sizes(keep))
        self.hits = hits[keep] // 2

    def note(self, which: np.ndarray) -> None:
        """Count what was met."""
        met = np.bincount(which, minlength=len(self.seen))
        met[: len(self.hits)] += self.hits
        self.hits = met


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each of the consecutive groups that ``counts`` sizes; 0 for empty ones."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


class Units:
    """Shared part: texts to numbers of units, and units to runs of ids."""

    #: What is kept of a run.
    RUNS: type[Runs] = Runs
    #: Pieces that are merged in one call.
    BLOCK = 20_000

    def __init__(self, limit: int, pieces_limit: int) -> None:
        self.units, self.pieces = Table(limit, self.RUNS), Table(pieces_limit, self.RUNS)

    def cut(self, utf8: bytes) -> list:
        raise NotImplementedError

    def tokenize(self, units: list) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def numbers(self, texts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the units of all texts, how many each text has); every unit then has its run."""
        self.units.make_room()
        found, counts = [], []
        for utf8 in texts:
            n = 0
            for part in segments(utf8):
                found.append(self.units.seen.of(self.cut(part)))
                n += len(found[-1])
            counts.append(n)
        new = self.units.seen.take_new()
        if new:
            self.units.runs.add(*self.tokenize(new))
        which = np.concatenate(found) if found else np.zeros(0, np.int32)
        self.units.note(which)
        return which, np.array(counts, np.int64)

    def of_pieces(self, pieces: list, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of consecutive groups of pieces, of which only unseen ones are merged."""
        self.pieces.make_room()
        which = self.pieces.seen.of(pieces)
        new = self.pieces.seen.take_new()
        for i in range(0, len(new), self.BLOCK):
            self.pieces.runs.add(*self.merge(new[i : i + self.BLOCK]))
        self.pieces.note(which)
        return self.pieces.runs.gather(which), sums(self.pieces.runs.sizes(which), counts)

    def merge(self, pieces: list) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, number of ids of each text)."""
        which, counts = self.numbers(texts)
        return self.units.runs.gather(which), sums(self.units.runs.sizes(which), counts)


def segments(utf8: bytes) -> Iterator[bytes]:
    """A text in parts, cut before a space that follows a character of ASCII other than white space and ``|`` or ``>``."""
    at = 0
    while len(utf8) - at > 2 * SEGMENT:
        end = utf8.find(b" ", at + SEGMENT)
        while end > 0 and not (0x21 <= utf8[end - 1] < 0x7F):
            end = utf8.find(b" ", end + 1)
        if end < 0:
            break
        yield utf8[at:end]
        at = end
    yield utf8[at:] if at else utf8


class ByteUnits(Units):
    """Units of a byte-level vocabulary whose pre-tokenization keeps a space with the word after it.

    No pre-token spans from a character that is not white space to one that is, so every such place is a cut. A ``str``
    unit has a space before it that isn't written; a ``bytes`` unit is exact. Texts with a special string, with white
    space before a space, or with characters whose class may differ between Unicode versions take slower, exact paths.
    """

    BLOCK = 200_000
    EXACT = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
    UNSAFE = re.compile(r"[\s\x85\xa0] ")

    def __init__(self, path: str, limit: int = 300_000, pieces_limit: int = 300_000) -> None:
        from tokenizers import Tokenizer

        self.table = MergeTable(path)
        self.library = Tokenizer.from_file(path)
        self.pattern = regex.compile(BYTE_PATTERN)
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, self.table.special)) + ")")
        self.bytes_of = {s: b for b, s in enumerate(byte_symbols())}
        super().__init__(limit, pieces_limit)

    def cut(self, utf8: bytes) -> list:
        text = utf8.decode()
        if any(s in text for s in self.table.special):
            units: list = []
            for part in self.special_pattern.split(text):
                if part in self.table.special:
                    units.append((part,))
                elif part:
                    units += [u.encode() for u in self.EXACT.findall(part)]
            return units
        if self.UNSAFE.search(text):
            return [u.encode() for u in self.EXACT.findall(text)]
        units = text.split(" ")
        units[0] = units[0].encode()
        return units if units[0] else units[1:]

    def pre_tokens(self, text: str) -> list[bytes]:
        if text.isascii() or ord(max(text)) < STABLE:
            return [p.encode() for p in self.pattern.findall(text)]
        byte = self.bytes_of
        return [bytes(byte[c] for c in p) for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def tokenize(self, units: list) -> tuple[np.ndarray, np.ndarray]:
        flat: list = []
        counts = np.zeros(len(units), np.int64)
        for i, unit in enumerate(units):
            found = [unit] if isinstance(unit, tuple) else self.pre_tokens(" " + unit if isinstance(unit, str) else unit.decode())
            counts[i] = len(found)
            flat += found
        return self.of_pieces(flat, counts)

    def merge(self, pieces: list) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new pieces through the pair occurrence index; a special string is its own id."""
        ids, sizes = merge_block(self.table, [b"" if isinstance(p, tuple) else p for p in pieces])
        special = [i for i, p in enumerate(pieces) if isinstance(p, tuple)]
        if special:
            at = (np.cumsum(sizes) - sizes)[special]
            ids = np.insert(ids, at, [self.table.special[pieces[i][0]] for i in special]).astype(np.int32)
            sizes[special] = 1
        return ids, sizes


class WordUnits(Units):
    """Units of the word-level vocabulary, which drops white space: runs of characters other than ASCII white space, in
    lower case. All ids come from the tokenizers library, called once for each unseen word of a worker.

    Only A-Z is lowered before the library sees a unit, and units with characters outside the stable range go to it as
    they are. A text with ``<|`` in it may hold a special string, which is found before lower-casing: its units keep
    their case.
    """

    def __init__(self, path: str, limit: int = 150_000, pieces_limit: int = 250_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        self.ends = np.zeros(max(own["model"]["vocab"].values()) + 1, bool)
        self.ends[[i for t, i in own["model"]["vocab"].items() if t.endswith(own["model"]["end_of_word_suffix"])]] = True
        # the same model for pieces that are normalized and cut already
        self.model = Tokenizer.from_str(json.dumps(own | {"normalizer": None, "pre_tokenizer": None, "added_tokens": []}))
        self.symbols = {b: s for b, s in enumerate(byte_symbols())}
        self.pattern = regex.compile(WORD_PATTERN)
        super().__init__(limit, pieces_limit)

    def cut(self, utf8: bytes) -> list:
        return utf8.split() if b"<|" in utf8 else utf8.lower().split()

    def tokenize(self, units: list) -> tuple[np.ndarray, np.ndarray]:
        flat: list = []
        counts = np.zeros(len(units), np.int64)
        find = self.pattern.findall
        for i, unit in enumerate(units):
            text = unit.decode()
            if unit.isalpha() and unit.islower():  # ASCII letters alone
                counts[i] = 1
                flat.append(text)
            elif "<|" in text or not text.isascii() and (ord(max(text)) >= STABLE or "İ" in text):
                counts[i] = 1
                flat.append(unit)  # whole: the library normalizes and cuts it
            else:
                found = find(text.lower())
                counts[i] = len(found)
                flat += found
        return self.of_pieces(flat, counts)

    def merge(self, pieces: list) -> tuple[np.ndarray, np.ndarray]:
        """Ids of unseen pieces from the library: words in one call, told apart by their last ids; whole units one by one."""
        sizes = np.zeros(len(pieces), np.int64)
        words = [i for i, p in enumerate(pieces) if isinstance(p, str)]
        spelled = [p if (p := pieces[i]).isascii() and p.isprintable() else "".join([self.symbols[b] for b in p.encode()]) for i in words]  # printable ASCII stands for itself
        ids = np.array(self.model.encode(spelled, is_pretokenized=True, add_special_tokens=False).ids if spelled else [], np.int32)
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words):
            raise ValueError("a piece has no id that ends a word")
        sizes[words] = np.diff(stops, prepend=0)
        whole = [i for i, p in enumerate(pieces) if isinstance(p, bytes)]
        if whole:
            found = [e.ids for e in self.library.encode_batch_fast([pieces[i].decode() for i in whole], add_special_tokens=False)]
            at = np.concatenate([[0], np.cumsum(sizes)])
            ids = np.insert(ids, np.repeat(at[whole], list(map(len, found))), [x for e in found for x in e]).astype(np.int32)
            sizes[whole] = list(map(len, found))
        return ids, sizes


_KEPT: dict = {}


def kept(make: Callable[[str], Units], path: str) -> Units:
    """The worker's own encoder for a file, made once for each process; another one takes its place, so that a worker holds one."""
    key = (make, path)
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make(path)
    return _KEPT[key]


def blocks(batches: Iterable, size: int = 4_000_000) -> Iterator:
    """Slices of Arrow batches with a column ``utf8`` of about ``size`` bytes each, one row at least."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column("utf8")), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(sizes, dtype=np.int64) // size
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)
