"""hash_number for arrays: the first 32 bits of the md5 of short keys, many at a time."""

from __future__ import annotations

import hashlib
import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

#: Keys hashed at a time: what the working arrays of one step keep within a core's cache.
CHUNK = 1 << 14
#: Hash numbers made at a time of a block of heads and tails.
ROOM = 3 << 14
#: Longest key that is one md5 block.
BLOCK = 55

_SINES = [int(abs(np.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_SINES32 = [np.uint32(x) for x in _SINES]
_BY = [np.array(x, np.uint32) for x in range(33)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_PLACES = [lambda i: i, lambda i: (5 * i + 1) % 16, lambda i: (3 * i + 5) % 16, lambda i: (7 * i) % 16]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def first_bits(words: list, n: int) -> np.ndarray:
    """The number in the first 8 hex digits of the md5 of n blocks. words: the 16 little-endian words of a block, each
    an array (uint32) of n or a number that all share."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    t, u = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(61):  # the last three steps do not reach the first word
        kind, turn = i // 16, _TURNS[i // 16][i % 4]
        if kind == 0:
            np.bitwise_xor(c, d, out=t), np.bitwise_and(t, b, out=t), np.bitwise_xor(t, d, out=t)
        elif kind == 1:
            np.bitwise_xor(b, c, out=t), np.bitwise_and(t, d, out=t), np.bitwise_xor(t, c, out=t)
        elif kind == 2:
            np.bitwise_xor(b, c, out=t), np.bitwise_xor(t, d, out=t)
        else:
            np.invert(d, out=t), np.bitwise_or(t, b, out=t), np.bitwise_xor(t, c, out=t)
        np.add(t, a, out=t)
        word = words[_PLACES[kind](i)]
        if isinstance(word, np.ndarray):
            np.add(t, word, out=t)
            word = 0
        np.add(t, np.uint32((_SINES[i] + word) & 0xFFFFFFFF) if word else _SINES32[i], out=t)
        np.left_shift(t, np.uint32(turn), out=u), np.right_shift(t, np.uint32(32 - turn), out=t), np.bitwise_or(t, u, out=t)
        np.add(t, b, out=t)
        a, b, c, d, t = d, t, b, c, a
    # after 61 steps the first word's sum is in b
    np.add(b, np.uint32(_START[0]), out=b)
    return b.byteswap()


def as_words(keys: list[bytes], shift: int = 0) -> np.ndarray:
    """(words, keys) of keys of one length, as little-endian words, moved by shift bytes from a word's start."""
    size = len(keys[0])
    wide = -(-(shift + size) // 4) * 4
    raw = np.zeros((len(keys), wide), np.uint8)
    raw[:, shift : shift + size] = np.frombuffer(b"".join(keys), np.uint8).reshape(len(keys), size)
    return np.ascontiguousarray(raw.view("<u4").T)


class Joined:
    """Hash numbers of keys head + tail, heads of one length and tails of one length, for pairs of their places."""

    def __init__(self, heads: list[bytes], tails: list[bytes]) -> None:
        self.heads, self.tails, self.size = heads, tails, len(heads[0]) + len(tails[0])
        if self.size <= BLOCK:
            self.head, self.tail = as_words(heads), as_words([t + b"\x80" for t in tails], len(heads[0]) % 4)
            self.at = len(heads[0]) // 4

    def numbers(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        if self.size > BLOCK:
            return np.array([int.from_bytes(hashlib.md5(self.heads[x] + self.tails[y]).digest()[:4]) for x, y in zip(i.tolist(), j.tolist())], np.uint32)
        words: list = [0] * 16
        for k, w in enumerate(self.head):
            words[k] = w.take(i)
        for k, w in enumerate(self.tail, self.at):
            words[k] = words[k] | w.take(j) if isinstance(words[k], np.ndarray) else w.take(j)
        words[14] = 8 * self.size
        return first_bits(words, len(i))


class Crossed:
    """Hash numbers of keys head + tail for blocks of heads, all against a range of tails. Heads have one length, and so
    have tails. Nothing is gathered: what depends on one side only (words with their constants, the first steps) is made
    once for it, and a block's steps take it as a row or a column."""

    def __init__(self, heads: list[bytes], tails: list[bytes]) -> None:
        self.plain, self.size = Joined(heads, tails), len(heads[0]) + len(tails[0])
        if self.size > BLOCK:
            return
        at, head, tail = self.plain.at, self.plain.head, self.plain.tail
        state = [np.full(len(heads), x, np.uint32) for x in _START]
        for i in range(at):  # steps that whole words of the head decide
            a, b, c, d = state
            t = a + (d ^ (b & (c ^ d))) + head[i] + _SINES32[i]
            turn = _TURNS[0][i % 4]
            state = [d, b + (t << np.uint32(turn) | t >> np.uint32(32 - turn)), b, c]
        self.state = state
        self.added = []  # for each later step what is added of the head, and of the tail with the constant
        for i in range(at, 61):
            k = _PLACES[i // 16](i)
            own = head[k] if k < len(head) else None
            other = tail[k - at] if at <= k < at + len(tail) else None
            fixed = np.array((_SINES[i] + (8 * self.size if k == 14 else 0)) & 0xFFFFFFFF, np.uint32)
            self.added.append((own, other + fixed) if other is not None else (None if own is None else own + fixed, None if own is not None else fixed))
        a, b, c, d = state  # the step that meets the tail's first word knows the rest of the head alone
        self.start = a + (d ^ (b & (c ^ d))) + (0 if self.added[0][0] is None else self.added[0][0])

    def numbers(self, first: int, last: int, lo: int, hi: int, room: np.ndarray) -> np.ndarray:
        """Heads first .. last (rows) by tails lo .. hi (columns); room: 6 lines, each with a place for every number.
        What is returned lies in room, not in its last line."""
        add, xor, land, lor, left, right = np.add, np.bitwise_xor, np.bitwise_and, np.bitwise_or, np.left_shift, np.right_shift
        shape = last - first, hi - lo
        if self.size > BLOCK:
            i, j = np.indices(shape).reshape(2, -1)
            return self.plain.numbers(i + first, j + lo).reshape(shape)
        *free, u, v = (line[: shape[0] * shape[1]].reshape(shape) for line in room)
        a, b, c, d = (x[first:last, None] for x in self.state)
        turn, t = _TURNS[0][self.plain.at % 4], free.pop()
        add(self.start[first:last, None], self.added[0][1][lo:hi], t)
        left(t, _BY[turn], u), right(t, _BY[32 - turn], t), lor(t, u, t)
        add(t, b, t)
        a, b, c, d = d, t, b, c
        for i, (own, other) in enumerate(self.added[1:], self.plain.at + 1):
            t = free.pop() if free else a
            kind, turn = i // 16, _TURNS[i // 16][i % 4]
            if kind == 0:
                xor(c, d, u), land(u, b, u), xor(u, d, u)
            elif kind == 1:
                xor(b, c, u), land(u, d, u), xor(u, c, u)
            elif kind == 2 and i % 2 == 0:
                xor(b, c, v), xor(v, d, u)
            elif kind == 2:  # c and d are b and c of the step before
                xor(v, b, u)
            else:
                np.invert(d, u), lor(u, b, u), xor(u, c, u)
            add(a, u, t)
            if own is not None:
                add(t, own[first:last, None], t)
            if other is not None:
                add(t, other[lo:hi] if other.ndim else other, t)
            left(t, _BY[turn], u), right(t, _BY[32 - turn], t), lor(t, u, t)
            add(t, b, t)
            a, b, c, d = d, t, b, c
        add(b, np.uint32(_START[0]), b)
        return b.byteswap(inplace=True)
