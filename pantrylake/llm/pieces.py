"""Exact token ids at speed: split a batch's bytes into pre-token pieces with array operations, encode each
distinct piece once with the tokenizers library, and look repeated pieces up.

Byte-pair merges never cross a pre-token boundary, so the ids of a text are those of its pieces in order. A piece of up
to KEY_BYTES bytes is its own key (its bytes as two words, and its length), a longer one is looked up by its bytes:
nothing rests on a hash. Texts with characters outside ASCII and Latin-1, or with a control string of the vocabulary,
go through the library whole. A long text is worked off in segments that end before a space between two ASCII letters or
digits, where neither a piece nor a control string nor a normalisation can reach across.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core

LETTER, NUMBER, OTHER, SPACE, FOLLOW, FOREIGN = 1, 2, 3, 4, 5, 6
#: Odd multipliers that spread a key over the cache's slots.
SPREAD_A, SPREAD_B = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
KEY_BYTES = 16
#: Bytes worked off at once, and the longest run without a place to cut that arrays are made for.
SEGMENT, UNCUT = 1 << 20, 1 << 23
#: Distinct pieces, their ids and bytes of long pieces kept by a worker before its cache starts anew (memory only).
CACHE_LIMIT, LONG_LIMIT = 1 << 21, 1 << 26


def _class_of(char: str) -> int:
    kind = unicodedata.category(char)
    if kind[0] == "L":
        return LETTER
    if kind[0] == "N":
        return NUMBER
    if char in "\t\n\x0b\x0c\r \x85\xa0":
        return SPACE
    return OTHER


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Classes of single bytes, and of the second byte after 0xC2 and 0xC3."""
    one = np.full(256, FOREIGN, np.uint8)
    for b in range(128):
        one[b] = _class_of(chr(b))
    one[0x80:0xC0] = FOLLOW
    pair = np.full(512, FOREIGN, np.uint8)
    for c in range(0x80, 0x100):
        lead, tail = chr(c).encode()
        pair[(lead - 0xC2) * 256 + tail] = _class_of(chr(c))
    return one, pair


_ONE, _PAIR = _tables()


def _shown() -> np.ndarray:
    """Byte-level vocabularies write a byte as a visible character: itself, or the next one from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    shown = np.arange(256, dtype="<u4")
    hidden = [b for b in range(256) if b not in visible]
    shown[hidden] = 256 + np.arange(len(hidden))
    return shown


_SHOWN = _shown()


#: Masks of the first k bytes of a little-endian word.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_WORDLIKE = np.zeros(256, bool)
_WORDLIKE[[b for b in range(128) if chr(b).isalnum()]] = True


class PieceEncoder:
    """Ids of whole texts under one vocabulary file.

    style "gpt": spaces join the piece after them, contractions are lower case, digits stay together.
    style "word": white space falls away, contractions are in either case, each digit is a piece.
    controls: whether a control string of the vocabulary in a text becomes its id, as the library does unless told
    otherwise; else it is ordinary text.
    """

    def __init__(self, path: str, style: str, controls: bool = True):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not controls
        self.size = self.library.get_vocab_size()
        self.style = style
        own = list(self.library.get_added_tokens_decoder().values()) if controls else []
        self.controls = [t.content.encode() for t in own]
        #: whether a control string acts beyond its own bytes: then every text goes through the library uncut
        self.only_whole = any(t.lstrip or t.rstrip or t.single_word or t.normalized or " " in t.content for t in own)
        self._clear()

    @property
    def width(self) -> int:
        """Bytes of an id: 2 if the vocabulary fits, else 4."""
        return 2 if self.size <= 1 << 16 else 4

    def _clear(self) -> None:
        self._table(17)
        self.n_pieces, self.n_ids, self.long_bytes = 0, 0, 0
        self.first = np.zeros(1 << 14, np.int64)
        self.many = np.zeros(1 << 14, np.int64)
        self.pool = np.zeros(1 << 15, np.uint32)
        self.low = np.zeros(1 << 14, np.uint64)
        self.high = np.zeros(1 << 14, np.uint64)
        self.length = np.zeros(1 << 14, np.int64)
        self.long: dict[bytes, int] = {}

    def _table(self, bits: int) -> None:
        self.bits = bits
        self.slots = np.full(1 << bits, -1, np.int32)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    # -- the cache: open addressing over arrays, and a dictionary of long pieces --------------------------------

    def _slot(self, low: np.ndarray, high: np.ndarray, length: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (low ^ (low >> np.uint64(31)) ^ length.astype(np.uint64)) * np.uint64(SPREAD_A) + high * np.uint64(SPREAD_B)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(SPREAD_B)
            return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def _other(self, at: np.ndarray, low: np.ndarray, high: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether a slot holds a piece, but not this one."""
        k = np.maximum(at, 0)
        return (at >= 0) & ((self.low[k] != low) | (self.high[k] != high) | (self.length[k] != length))

    def _find(self, low: np.ndarray, high: np.ndarray, length: np.ndarray) -> np.ndarray:
        slot, mask = self._slot(low, high, length), (1 << self.bits) - 1
        found = self.slots[slot]
        wrong = np.nonzero(self._other(found, low, high, length))[0]
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & mask
            got = self.slots[slot[wrong]]
            found[wrong] = got
            wrong = wrong[self._other(got, low[wrong], high[wrong], length[wrong])]
        return found

    def _place(self, numbers: np.ndarray) -> None:
        slot, mask = self._slot(self.low[numbers], self.high[numbers], self.length[numbers]), (1 << self.bits) - 1
        while len(numbers):
            free = self.slots[slot] < 0
            taken, which = np.unique(slot[free], return_index=True)
            self.slots[taken] = numbers[free][which]
            left = self.slots[slot] != numbers
            numbers, slot = numbers[left], (slot[left] + 1) & mask

    def _add(self, pieces: list[str]) -> np.ndarray:
        """Numbers of new pieces, whose ids are kept from now on."""
        tokenize = self.library.model.tokenize
        ids = [[t.id for t in tokenize(x)] for x in pieces]
        many = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(many.sum()))
        n, k = self.n_pieces + len(ids), self.n_ids + len(flat)
        for name, need in (("first", n), ("many", n), ("low", n), ("high", n), ("length", n), ("pool", k)):
            old = getattr(self, name)
            if need > len(old):
                setattr(self, name, np.concatenate([old, np.zeros(max(need, 2 * len(old)) - len(old), old.dtype)]))
        new = np.arange(self.n_pieces, n)
        self.first[new] = self.n_ids + np.cumsum(many) - many
        self.many[new] = many
        self.pool[self.n_ids : k] = flat
        self.n_pieces, self.n_ids = n, k
        return new

    def _add_short(self, low: np.ndarray, high: np.ndarray, length: np.ndarray, pieces: list[str]) -> None:
        new = self._add(pieces)
        self.low[new], self.high[new], self.length[new] = low, high, length
        if 2 * self.n_pieces > 1 << self.bits:
            self._table((2 * self.n_pieces).bit_length() + 1)
            every = np.arange(self.n_pieces)
            new = every[self.length[: self.n_pieces] > 0]  # long pieces have no length here
        self._place(new.astype(np.int32))

    # -- splitting --------------------------------------------------------------------------------------------

    def _contractions(self, raw: np.ndarray, quotes: np.ndarray, end_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of quote positions that start a piece: those that are a contraction, and where it ends."""
        padded = np.concatenate([raw, np.zeros(3, np.uint8)])
        one, two = padded[quotes + 1], padded[quotes + 2]
        if self.style == "word":
            one, two = one | 32, two | 32
        last = end_of[quotes]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8)) & (quotes + 2 <= last)
        long = np.zeros(len(quotes), bool)
        for x, y in ("re", "ve", "ll"):
            long |= (one == ord(x)) & (two == ord(y))
        long &= quotes + 3 <= last
        hit = short | long
        return quotes[hit], np.where(short, quotes + 2, quotes + 3)[hit]

    def _split(self, raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end offsets of the pieces of texts that lie at `edges` in `raw` (ASCII and Latin-1 only)."""
        n = len(raw)
        kind = _ONE[raw]
        lead = np.nonzero(kind == FOREIGN)[0]
        if len(lead):
            kind[lead] = kind[lead + 1] = _PAIR[(raw[lead].astype(np.int64) - 0xC2) * 256 + raw[lead + 1]]
        starts = np.empty(n + 1, bool)
        starts[0] = starts[n] = True
        np.not_equal(kind[1:], kind[:-1], out=starts[1:n])
        starts[edges] = True
        follow = np.zeros(n, bool)
        follow[lead + 1] = True
        space = kind == SPACE
        real = edges[:-1][edges[1:] > edges[:-1]]
        first = np.zeros(n + 1, bool)
        first[edges] = True
        # the first byte after a run of spaces in the same text
        after = np.nonzero(starts[1:n] & space[:-1] & ~space[1:] & ~first[1:n])[0] + 1
        if self.style == "gpt":
            tail = after - 1
            tail = np.where(follow[tail], tail - 1, tail)  # the last space may take two bytes
            starts[tail] = True
            starts[after[raw[after - 1] == 32]] = False
        else:
            digits = np.nonzero((kind == NUMBER) & ~follow)[0]
            starts[digits] = True
        quotes = np.nonzero((raw == 39) & starts[:n])[0]
        if len(quotes):
            end_of = np.repeat(edges[1:], np.diff(edges)) if len(real) else edges
            at, end = self._contractions(raw, quotes, end_of)
            for k in (1, 2):
                inside = at + k
                starts[inside[inside < end]] = False
            # what follows in the same run of letters starts anew; a space before a piece stays with that piece
            starts[end] = True
        where = np.nonzero(starts)[0]
        begin, end = where[:-1], where[1:]
        if self.style == "word":
            keep = ~space[begin]
            begin, end = begin[keep], end[keep]
        return begin, end

    def _cuts(self, data: np.ndarray, at: int, end: int) -> list[int]:
        """Places to cut a long text, about SEGMENT apart: a space between two ASCII letters or digits."""
        out, step = [], 1 << 16
        lo = at + SEGMENT
        while lo < end - 1 and not self.only_whole:
            seen = data[lo - 1 : min(end, lo + step + 1)]
            able = _WORDLIKE[seen]
            hit = np.nonzero(able[:-2] & (seen[1:-1] == 32) & able[2:])[0]
            if len(hit):
                out.append(lo + int(hit[0]))
                lo = out[-1] + SEGMENT
            else:
                lo += step
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts data[offsets[i]:offsets[i+1]] (UTF-8), one after another, and how many each has."""
        texts = len(offsets) - 1
        edges, owner = offsets, np.arange(texts)
        long = np.nonzero(np.diff(offsets) > SEGMENT)[0]
        if len(long):
            inside = {int(i): self._cuts(data, int(offsets[i]), int(offsets[i + 1])) for i in long}
            edges = np.array([p for i in range(texts) for p in (int(offsets[i]), *inside.get(i, ()))] + [int(offsets[-1])], np.int64)
            owner = np.repeat(np.arange(texts), [1 + len(inside.get(i, ())) for i in range(texts)])
        counts = np.zeros(len(edges) - 1, np.int64)
        parts: list[np.ndarray] = []
        at = 0
        while at < len(counts):
            to = max(at + 1, int(np.searchsorted(edges, edges[at] + SEGMENT, "right")) - 1)
            ids, n = self._segment(data[edges[at] : edges[to]], edges[at : to + 1] - edges[at])
            parts.append(ids)
            counts[at:to] = n
            at = to
        whole = np.zeros(texts, np.int64)
        np.add.at(whole, owner, counts)
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), whole

    def _for_library(self, raw: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Which texts the library encodes whole."""
        slow = np.zeros(len(edges) - 1, bool)
        odd = np.nonzero(raw >= 0xC4)[0]
        slow[np.searchsorted(edges, odd, "right") - 1] = True
        slow |= np.diff(edges) > UNCUT
        if self.only_whole:
            slow[:] = True
        if self.controls:
            text = raw.tobytes()
            for control in self.controls:
                at = text.find(control)
                while at >= 0:
                    which = int(np.searchsorted(edges, at, "right")) - 1
                    slow[which] = True  # (a find across two texts does no harm)
                    at = text.find(control, max(at + 1, int(edges[which + 1]) - len(control) + 1))
        return slow

    def _segment(self, raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        is_slow = self._for_library(raw, edges)
        slow = np.nonzero(is_slow)[0]
        if len(slow) == 0:
            return self._simple(raw, edges)
        whole = self.whole([raw[edges[i] : edges[i + 1]].tobytes().decode("utf-8", "replace") for i in slow])
        fast = np.nonzero(~is_slow)[0]
        sizes = np.diff(edges)
        counts = np.zeros(len(sizes), np.int64)
        counts[slow] = [len(x) for x in whole]
        if len(fast) == 0:
            return np.concatenate(whole), counts
        ids, n = self._simple(raw[np.repeat(~is_slow, sizes)], np.concatenate([[0], np.cumsum(sizes[fast])]))
        counts[fast] = n
        out = np.empty(int(counts.sum()), np.uint32)
        from_fast = np.repeat(~is_slow, counts)
        out[from_fast] = ids
        out[~from_fast] = np.concatenate(whole)
        return out, counts

    def _shown(self, raw: np.ndarray) -> str:
        """The bytes as the vocabulary writes them, a character for each byte."""
        text = raw.tobytes()
        if self.style == "word":
            text = text.decode("utf-8").lower().encode("utf-8")  # as many bytes: Latin-1 only
        return _SHOWN[np.frombuffer(text, np.uint8)].tobytes().decode("utf-32-le")

    def _numbers(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The cache's number of each piece; new ones are added."""
        size = end - begin
        words = np.ndarray(len(raw) + KEY_BYTES - 7, "<u8", np.concatenate([raw, np.zeros(KEY_BYTES, np.uint8)]), 0, (1,))
        long = np.nonzero(size > KEY_BYTES)[0]
        number = np.empty(len(begin), np.int64)
        short = slice(None) if len(long) == 0 else np.nonzero(size <= KEY_BYTES)[0]
        b, n = begin[short], size[short]
        low, high = words[b] & _MASK[np.minimum(n, 8)], words[b + 8] & _MASK[np.maximum(n - 8, 0)]
        found = self._find(low, high, n)
        missing = np.nonzero(found < 0)[0]
        shown = self._shown(raw) if len(missing) or len(long) else ""
        if len(missing):
            order = missing[np.lexsort((n[missing], high[missing], low[missing]))]
            key = np.stack([low[order], high[order], n[order].astype(np.uint64)])
            new = order[np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)])]
            self._add_short(low[new], high[new], n[new], [shown[i : i + k] for i, k in zip(b[new].tolist(), n[new].tolist())])
            found[missing] = self._find(low[missing], high[missing], n[missing])
        number[short] = found
        if len(long):
            text, fresh = raw.tobytes(), {}
            pieces = [text[i:j] for i, j in zip(begin[long].tolist(), end[long].tolist())]
            for i, j, piece in zip(begin[long].tolist(), end[long].tolist(), pieces):
                if piece not in self.long and piece not in fresh:
                    fresh[piece] = shown[i:j]
            if fresh:
                self.long.update(zip(fresh, self._add(list(fresh.values())).tolist()))
                self.long_bytes += sum(map(len, fresh))
            number[long] = [self.long[piece] for piece in pieces]
        return number

    def _simple(self, raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n_texts = len(edges) - 1
        if len(raw) == 0:
            return np.zeros(0, np.uint32), np.zeros(n_texts, np.int64)
        if self.n_pieces > CACHE_LIMIT or self.n_ids > 4 * CACHE_LIMIT or self.long_bytes > LONG_LIMIT:
            self._clear()
        begin, end = self._split(raw, edges)
        if len(begin) == 0:
            return np.zeros(0, np.uint32), np.zeros(n_texts, np.int64)
        number = self._numbers(raw, begin, end)
        many = self.many[number]
        before = np.cumsum(many) - many
        total = int(many.sum())
        ids = self.pool[np.repeat(self.first[number] - before, many) + np.arange(total)]
        owner = np.searchsorted(begin, edges)  # the first piece of each text
        sums = np.concatenate([before, [total]])
        counts = np.diff(sums[owner])
        return ids, counts


_ENCODERS: dict[tuple[str, str, bool], PieceEncoder] = {}


def encoder(path: str, style: str, controls: bool = True) -> PieceEncoder:
    """This worker's encoder for a vocabulary file: its cache lives as long as the worker."""
    if (path, style, controls) not in _ENCODERS:
        _ENCODERS[path, style, controls] = PieceEncoder(path, style, controls)
    return _ENCODERS[path, style, controls]


def slices(batches: Iterator, column: str = "text", most: int = 4 << 20) -> Iterator:
    """The same rows in record batches of about `most` bytes of text, or one row, so that long texts stay few at once."""
    import pyarrow.compute as pc

    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(ends):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(at, to - at)
            at = to
    give_back()


def give_back() -> None:
    """Return freed memory to the system: an idle worker stays beside the JVM until Spark ends it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and offsets of an Arrow string column (null: empty), without Python strings."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets
