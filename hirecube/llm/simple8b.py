"""Simple-8b: as many equally wide values as fit behind a 4-bit selector in each 64-bit word.

Selector 0 is an escape: the next word is one raw value that needs more than
60 bits. A block codes a known number of values; zeros fill its last word.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
# fixed values: bits of a value for the selectors from 1 on; a word holds 60 // bits of them, or 120 zeros
BITS = [0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60]
COUNTS = [120] + [60 // b for b in BITS[1:]]
LONGEST = max(COUNTS)


def encode(values: np.ndarray) -> np.ndarray:
    """The words of a block of unsigned values."""
    values = np.ascontiguousarray(values, U64)
    n = len(values)
    if not n:
        return np.zeros(0, U64)
    padded = np.r_[values, np.zeros(LONGEST, U64)]
    need = np.zeros(n + LONGEST, np.uint8)  # the narrowest selector that a value fits, counted from 0
    for s, bits in enumerate(BITS):
        wide = (padded >> U64(bits)) != 0
        if not wide.any():
            break
        need += wide
    # the widest need among the next 2 ** i values; any other run is covered by two such
    doubled = [need]
    while 2 ** len(doubled) <= LONGEST:
        half = 2 ** (len(doubled) - 1)
        doubled.append(np.maximum(doubled[-1][:-half], doubled[-1][half:]))
    take, selector = np.ones(n, np.uint8), np.zeros(n, np.uint8)
    for s in range(len(BITS) - 1, -1, -1):  # narrower ones hold more and overrule
        count = COUNTS[s]
        level = count.bit_length() - 1
        rest = count - 2 ** level
        most = np.maximum(doubled[level][:n], doubled[level][rest:rest + n])
        fits = most <= s
        np.copyto(take, np.uint8(count), where=fits)
        np.copyto(selector, np.uint8(s + 1), where=fits)
    steps, at, i = take.tobytes(), [], 0
    while i < n:
        at.append(i)
        i += steps[i]
    at = np.array(at)
    chosen = selector[at]
    place = np.arange(len(at)) + np.r_[0, np.cumsum(chosen == 0)[:-1]]
    words = np.zeros(len(at) + int((chosen == 0).sum()), U64)
    for s in np.unique(chosen).tolist():
        mine = np.flatnonzero(chosen == s)
        if s == 0:
            words[place[mine] + 1] = values[at[mine]]
            continue
        count, bits = COUNTS[s - 1], BITS[s - 1]
        word = np.full(len(mine), s << 60, U64)
        if bits:
            for j in range(count):
                word |= padded[at[mine] + j] << U64(j * bits)
        words[place[mine]] = word
    return words


def decode(words: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values of a block."""
    if not n:
        return np.zeros(0, U64)
    selector = (words >> U64(60)).astype(np.int64)
    if (selector == 0).any():  # words after an escape are raw: walk over the escapes only
        raw = np.zeros(len(words), bool)
        last = -1
        for i in np.flatnonzero(selector == 0).tolist():
            if i != last:
                last = i + 1
                raw[last] = True
        head = np.flatnonzero(~raw)
    else:
        head = np.arange(len(words))
    selector = selector[head]
    size = np.array([1, *COUNTS])[selector]
    begin = np.r_[0, np.cumsum(size)]
    out = np.zeros(int(begin[-1]), U64)
    for s in np.unique(selector).tolist():
        mine = np.flatnonzero(selector == s)
        if s == 0:
            out[begin[mine]] = words[head[mine] + 1]
        elif BITS[s - 1]:
            bits, word = BITS[s - 1], words[head[mine]]
            mask = U64((1 << bits) - 1)
            for j in range(COUNTS[s - 1]):
                out[begin[mine] + j] = (word >> U64(j * bits)) & mask
    return out[:n]
