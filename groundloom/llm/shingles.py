"""Hashes of words and shingles of whole texts, for many texts at once with numpy."""

from __future__ import annotations

import numpy as np

SHINGLE_WORDS = 5
#: Bytes that one step works on; a longer text is cut at white space and its words are put together again.
STEP_BYTES = 1 << 20

_RNG = np.random.Generator(np.random.PCG64(20_240_229))
_BYTE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLACE = _RNG.integers(0, 1 << 64, SHINGLE_WORDS, dtype=np.uint64) | np.uint64(1)
_STEP = int(_RNG.integers(0, 1 << 64, dtype=np.uint64)) & ~7 | 3
_BACK = pow(_STEP, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


#: Filled by the first use in a task.
_POWERS: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashed(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word."""
    if not _POWERS or len(data) > len(_POWERS[0]):
        size = max(len(data), STEP_BYTES)
        _POWERS[:] = [_powers(_STEP, size), _powers(_BACK, size)]
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[data] * _POWERS[0][: len(data)])])
    return mixed((total[end] - total[begin]) * _POWERS[1][begin] + (end - begin).astype(np.uint64)), begin


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """A 64-bit hash for each word of each text. Words are runs of anything but ASCII white space, A-Z in lower case."""
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
    held, size = [], 0

    def flush() -> None:
        hashes, begin = _hashed(np.frombuffer(b"\n".join(texts[i] for i in held), np.uint8))
        ends = np.cumsum([len(texts[i]) + 1 for i in held])
        for i, part in zip(held, np.split(hashes, np.searchsorted(begin, ends[:-1])), strict=True):
            out[i] = part

    for i, text in enumerate(texts):
        if len(text) >= STEP_BYTES:
            out[i] = np.concatenate([_hashed(np.frombuffer(part, np.uint8))[0] for part in _cut(text)])
            continue
        if size + len(text) + 1 > STEP_BYTES:
            flush()
            held, size = [], 0
        held.append(i)
        size += len(text) + 1
    if held:
        flush()
    return out


def _cut(text: bytes):
    begin = 0
    while begin < len(text):
        end = begin + STEP_BYTES // 2
        while end < len(text) and not _SPACE[text[end]]:
            end += 1
        yield text[begin:end]
        begin = end


def shingle_set(words: np.ndarray) -> np.ndarray:
    """The distinct shingle hashes of a text in order; a text of fewer words than a shingle is one shingle, none has none."""
    n = len(words) - SHINGLE_WORDS + 1
    if n > 0:
        total = words[:n] * _PLACE[0]
        for k in range(1, SHINGLE_WORDS):
            total = total + words[k : k + n] * _PLACE[k]
        return np.unique(mixed(total))
    if len(words):
        return mixed(np.array([np.sum(words * _PLACE[: len(words)]) + np.uint64(len(words))], np.uint64))
    return words
