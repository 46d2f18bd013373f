"""MD5 of many texts at once, as arrays: the head that ``money.uniform_hash`` reads, for every pair of a prefix and a text."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np

_ADD = [np.uint32(int(abs(np.sin(i + 1)) * 2**32) & 0xFFFFFFFF) for i in range(64)]
_TURN = [[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]
_SHIFT = [(np.uint32(n), np.uint32(32 - n)) for n in (_TURN[i // 16][i % 4] for i in range(64))]
_WORD = [*range(16), *[(5 * i + 1) % 16 for i in range(16)], *[(3 * i + 5) % 16 for i in range(16)], *[7 * i % 16 for i in range(16)]]
# values of one block of heads: the arrays of a round stay in the processor's cache
BLOCK_ROWS = 1 << 15
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


@functools.lru_cache(maxsize=1)
def _scratch(shape: tuple[int, ...]) -> list[np.ndarray]:
    """Five arrays that begin where cache lines do: passes over others take up to a fifth longer."""
    size, out = int(np.prod(shape)) * 4, []
    for raw in (np.empty(size + 64, dtype=np.uint8) for _ in range(5)):
        at = -raw.ctypes.data % 64
        out.append(raw[at:at + size].view(np.uint32).reshape(shape))
    return out


def _compress(state: Sequence[np.ndarray], words: Sequence[np.ndarray], keep: np.ndarray | None, shape: tuple[int, ...], last: bool) -> list[np.ndarray]:
    """The state after one block of every text; where ``keep`` is false the text has ended before.

    A word that many messages share is one column or row of ``shape``, and so is the state until words of both kinds have entered it. Of the
    ``last`` block only the head is worked out, which its last three steps do not touch.
    """
    a, b, c, d = state
    f = None
    for i in range(61 if last else 64):
        kind, turn = i // 16, _SHIFT[i]
        word = words[_WORD[i]] + _ADD[i]
        if f is None and all(x.shape == shape for x in (a, b, c, d)):
            *own, f = _scratch(shape)
            for x, y in zip(own, (a, b, c, d)):
                x[...] = y
            a, b, c, d = own
        if f is None:
            g = ((c ^ d) & b) ^ d if kind == 0 else ((b ^ c) & d) ^ c if kind == 1 else b ^ c ^ d if kind == 2 else c ^ (b | ~d)
            g = a + g + word
            a, b, c, d = d, ((g << turn[0]) | (g >> turn[1])) + b, b, c
            continue
        if kind == 0:
            np.bitwise_xor(c, d, f); np.bitwise_and(f, b, f); np.bitwise_xor(f, d, f)  # noqa: E702
        elif kind == 1:
            np.bitwise_xor(b, c, f); np.bitwise_and(f, d, f); np.bitwise_xor(f, c, f)  # noqa: E702
        elif kind == 2:
            np.bitwise_xor(b, c, f); np.bitwise_xor(f, d, f)  # noqa: E702
        else:
            np.bitwise_not(d, f); np.bitwise_or(f, b, f); np.bitwise_xor(f, c, f)  # noqa: E702
        np.add(a, f, a)
        np.add(a, word, a)
        np.right_shift(a, turn[1], f)
        np.left_shift(a, turn[0], a)
        np.bitwise_or(a, f, a)
        np.add(a, b, a)
        a, b, c, d = d, a, b, c
    ends = [b] if last else [a, b, c, d]
    return [s + x if keep is None else np.where(keep, s + x, s) for s, x in zip(state, ends)]


def _blocks(texts: Sequence[bytes], lead: int, rows: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Padded messages with ``lead`` empty bytes before each text, as (word, text), and the blocks each text fills."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    used = (sizes + (lead + 8)) // 64 + 1
    width = int(used.max()) * 64
    words = np.empty((width // 4, len(texts)), dtype="<u4")
    for at in range(0, len(texts), rows):
        n, body = sizes[at:at + rows], np.frombuffer(b"".join(texts[at:at + rows]), dtype=np.uint8)
        raw, row = np.zeros(len(n) * width, dtype=np.uint8), np.arange(len(n)) * width
        raw[np.arange(len(body)) + np.repeat(row + lead - (np.cumsum(n) - n), n)] = body
        raw[row + lead + n] = 0x80
        raw.view("<u8")[(row + used[at:at + rows] * 64 - 8) // 8] = (n + lead) * 8
        words[:, at:at + rows] = raw.view("<u4").reshape(len(n), -1).T
    return words, used


class Md5Heads:
    """First 32 bits of the MD5 of prefix + text, for prefixes of one length against a fixed list of texts."""

    def __init__(self, texts: Sequence[bytes], lead: int):
        self.lead = lead
        words, self.used = _blocks(texts, lead)
        # the padding, and often a beginning, is the same in all messages
        self.words = [row[:1] if (row == row[0]).all() else row for row in words]

    def _front(self, prefixes: Sequence[bytes]) -> np.ndarray:
        head = np.zeros((len(prefixes), -(-self.lead // 4) * 4), dtype=np.uint8)
        head[:, :self.lead] = np.frombuffer(b"".join(prefixes), dtype=np.uint8).reshape(len(prefixes), self.lead)
        return head.view("<u4")

    def _run(self, words: Sequence[np.ndarray], used: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
        state, blocks = [np.full((1,) * len(shape), s, dtype=np.uint32) for s in _START], len(words) // 16
        for block in range(blocks):
            state = _compress(state, words[block * 16:block * 16 + 16], None if block == 0 else used > block, shape, block == blocks - 1)
        return np.broadcast_to(state[0].byteswap(), shape)

    def __call__(self, prefixes: Sequence[bytes]) -> np.ndarray:
        """Heads as (prefix, text)."""
        front, alone = self._front(prefixes), self.lead // 4
        # words of the prefixes are a column, those of the texts a row; only a word of both differs from pair to pair
        words = [front[:, w:w + 1] if w < alone else row | front[:, w:w + 1] if w < front.shape[1] else row[None, :] for w, row in enumerate(self.words)]
        return self._run(words, self.used, (len(prefixes), len(self.used)))

    def pairs(self, prefixes: Sequence[bytes], which: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Heads of single pairs (number of the prefix, number of the text)."""
        front = self._front(prefixes)
        some = [row if len(row) == 1 else row[text] for row in self.words]
        words = [row | front[which, w] if w < front.shape[1] else row for w, row in enumerate(some)]
        return self._run(words, self.used[text], which.shape)


class UniformHeads:
    """``money.uniform_hash(prefix, number, text)`` times 2^32 for any number and a fixed list of texts."""

    def __init__(self, prefix: str, texts: Sequence[bytes]):
        self.prefix, self.texts, self.heads = prefix, texts, None

    def _lead(self, number: int) -> bytes:
        return f"{self.prefix}|{number}|".encode()

    def _of(self, size: int) -> Md5Heads:
        # numbers come in order, so those of one length are asked together
        if self.heads is None or self.heads.lead != size:
            self.heads = Md5Heads(self.texts, size)
        return self.heads

    def parts(self, numbers: Sequence[int], rows: int = BLOCK_ROWS) -> Iterator[tuple[int, np.ndarray]]:
        """In blocks of numbers: (place of the first number, heads as (number, text))."""
        step, first = max(1, rows // max(1, len(self.texts))), 0
        while first < len(numbers):
            lead = [self._lead(n) for n in numbers[first:first + step]]
            lead = lead[:next((i for i, p in enumerate(lead) if len(p) != len(lead[0])), len(lead))]
            yield first, self._of(len(lead[0]))(lead)
            first += len(lead)

    def pairs(self, numbers: Sequence[int], which: np.ndarray, text: np.ndarray, rows: int = BLOCK_ROWS) -> np.ndarray:
        """Heads of single pairs (place in ``numbers``, place in the texts)."""
        lead, out = [self._lead(n) for n in numbers], np.empty(len(which), dtype=np.uint32)
        sizes = np.array([len(x) for x in lead])
        for size in np.unique(sizes):
            mine, of_size = np.flatnonzero(sizes[which] == size), np.flatnonzero(sizes == size)
            place = np.searchsorted(of_size, which[mine])
            heads, some = self._of(int(size)), [lead[i] for i in of_size]
            for at in range(0, len(mine), rows):
                part = mine[at:at + rows]
                out[part] = heads.pairs(some, place[at:at + rows], text[part])
        return out


def uniform_parts(prefix: str, numbers: Sequence[int], texts: Sequence[bytes], rows: int = BLOCK_ROWS) -> Iterator[tuple[int, np.ndarray]]:
    """``UniformHeads.parts`` of texts that are asked once."""
    return UniformHeads(prefix, texts).parts(numbers, rows)
