"""Word hashes of many texts at once, with numpy over their UTF-8 bytes.

A token's hash is a difference of prefix sums of random byte values times powers of an odd number, so no
Python code runs per word.  Letters are ASCII letters and all multi-byte characters but common punctuation,
symbols and emoji.  Lower-casing leaves the few characters alone whose lower case has another byte length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

U = np.uint64
NONE, LETTER, DIGIT = 0, 1, 2
CHARS = 400_000  # characters lexed at once, unless one text is longer

_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123), 95, *range(128, 256)]] = LETTER
_CLASS[48:58] = DIGIT
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".!?\n"]] = True
_UNEVEN = re.compile("([" + "".join(re.escape(chr(k)) for k in range(128, 0x11000) if not 0xD800 <= k < 0xE000 and len(chr(k).lower().encode()) != len(chr(k).encode())) + "])")
_rng = np.random.default_rng(3)
_VALUE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = U(0x5851F42D4C957F2D)
_UNDO = U(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _UNDO)):
            _powers[k] = np.cumprod(np.concatenate([np.ones(1, U), np.full(max(n, 1 << 20), base, U)]))
    return _powers


def _classes(b: np.ndarray) -> np.ndarray:
    c = _CLASS[b]
    if b.max(initial=0) > 127:
        after = np.append(b[1:], np.uint8(0))
        for lead, test, width in ((0xC2, lambda x: (x != 0xAA) & (x != 0xB5) & (x != 0xBA), 2), (0xC3, lambda x: (x == 0x97) | (x == 0xB7), 2),
                                  (0xE2, lambda x: x < 0xB0, 3), (0xE3, lambda x: x == 0x80, 3), (0xF0, lambda x: x == 0x9F, 4)):
            at = np.flatnonzero(b == lead)
            at = at[test(after[at])]
            for k in range(width):
                c[at + k] = NONE
    return c


class Lexed:
    """Tokens of a few texts: ``hash`` of each lower-case token, and ``first[k]:first[k+1]`` the tokens of text k."""

    def __init__(self, texts: list[str | None], kinds: bool):
        parts = [(t or "").encode("utf-8", "replace") for t in texts]
        blob = b"\n".join(parts)
        raw = np.frombuffer(blob, np.uint8)
        if blob.isascii():
            low = np.frombuffer(blob.lower(), np.uint8)
        else:
            text = blob.decode()
            low = np.frombuffer("".join(p if k % 2 else p.lower() for k, p in enumerate(_UNEVEN.split(text))).encode(), np.uint8)
        c = _classes(low)
        if kinds:
            inner = np.flatnonzero((low == 46) | (low == 44) | (low == 58))
            inner = inner[(inner > 0) & (inner < len(low) - 1)]
            c[inner[(c[inner - 1] == DIGIT) & (_CLASS[low[inner + 1]] == DIGIT)]] = DIGIT
        else:
            c = (c > 0).view(np.uint8)
        edge = np.flatnonzero(np.diff(c, prepend=np.uint8(0), append=np.uint8(0)))
        start, end = edge[:-1], edge[1:]
        keep = c[start] != NONE
        start, end = start[keep], end[keep]
        power, undo = _power(len(low) + 1)
        total = np.concatenate([np.zeros(1, U), np.cumsum(_VALUE[low] * power[:len(low)])])
        self.hash = mix((total[end] - total[start]) * undo[start])
        begins = np.cumsum([0, *(len(p) + 1 for p in parts)])
        self.first = np.searchsorted(start, begins)
        if kinds:
            self.digit = c[start] == DIGIT
            changed = np.concatenate([[0], np.cumsum(raw != low)])
            head = start + np.where(raw[start] >= 0xC0, 2, 1)
            first_up = changed[head] > changed[start]
            #: Whether a token begins with a capital and goes on in small letters.
            self.capital = first_up & (end > head) & (changed[end] == changed[head])
            marks = np.concatenate([[0], np.cumsum(_MARK[low])])
            before = np.concatenate([[0], end[:-1]])
            self.opens = marks[start] > marks[before]
            self.opens[self.first[:-1][self.first[:-1] < len(start)]] = True


def lexed(texts: list[str | None], kinds: bool = False) -> Iterator[tuple[int, Lexed]]:
    """(index of its first text, tokens) of slices of about ``CHARS`` characters."""
    start = size = 0
    for k, text in enumerate(texts):
        size += len(text or "") + 1
        if size >= CHARS:
            yield start, Lexed(texts[start:k + 1], kinds)
            start, size = k + 1, 0
    if start < len(texts):
        yield start, Lexed(texts[start:], kinds)


def words_of(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The word hashes of each text, digits and underscores being letters."""
    for _, x in lexed(texts):
        for a, b in zip(x.first[:-1].tolist(), x.first[1:].tolist(), strict=True):
            yield x.hash[a:b]


def hash_word(word: str) -> int:
    """The hash of one lower-case word."""
    return int(Lexed([word], False).hash[0])
