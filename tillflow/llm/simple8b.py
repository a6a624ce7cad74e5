"""Simple-8b: runs of ids in 64-bit words.

The top four bits of a word select how many ids share its 60 payload bits. A word with the escape selector
announces an id of more than 60 bits, which fills the next word. Every stream starts at a word of its own,
so streams can be packed and unpacked together and each be found by the number of its first word.
"""

from __future__ import annotations

import numpy as np

#: Ids per word for the selectors 1 to 14; an id may use 60 // count bits.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
ESCAPE = 0
PAYLOAD = 60


_SHORT = np.array([max(1, i.bit_length()) for i in range(1 << 16)], dtype=np.uint8)


def bit_lengths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id, at least one."""
    if int(ids.max(initial=0)) < len(_SHORT):
        return _SHORT[ids]
    out = np.ones(len(ids), dtype=np.uint8)
    for bit in range(1, int(ids.max(initial=0)).bit_length()):
        out += ids >> np.uint64(bit) > 0
    return out


def pack(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of consecutive streams of the given lengths, and words per stream."""
    ids = np.asarray(ids, dtype=np.uint64)
    lengths = np.asarray(lengths, dtype=np.int64)
    n = len(ids)
    bits = bit_lengths(ids) if n else np.zeros(0, np.uint8)
    # Streams are short beside the array, so the ids left in each are counted once.
    here = np.arange(n, dtype=np.int32)
    room = np.repeat(np.cumsum(lengths).astype(np.int32), lengths) - here
    choice = np.zeros(n, dtype=np.int8)
    highest = int(bits.max(initial=0))
    for selector, count in reversed(list(enumerate(COUNTS, start=1))):
        width = PAYLOAD // count
        if width >= highest:
            choice[room >= count] = selector
            continue
        fits = bits <= width
        if np.count_nonzero(fits) < count:
            continue
        done = 1  # fits[i] tells of the ids i to i + done - 1
        while done < count and fits.any():
            step = min(done, count - done)
            fits[: n - step] &= fits[step:]
            fits[n - step :] = False
            done += step
        choice[fits & (room >= count)] = selector
    steps = np.array((1, *COUNTS), dtype=np.int64)[choice].tolist()
    heads, at = [], 0
    while at < n:
        heads.append(at)
        at += steps[at]
    heads = np.array(heads, dtype=np.int64)
    picked = choice[heads]
    takes = np.where(picked == ESCAPE, 2, 1)
    place = np.cumsum(takes) - takes
    words = np.zeros(int(takes.sum()), dtype=np.uint64)
    for selector, count in enumerate(COUNTS, start=1):
        own = picked == selector
        if own.any():
            value = np.full(int(own.sum()), selector << PAYLOAD, dtype=np.uint64)
            for k in range(count):
                value |= ids[heads[own] + k] << np.uint64(k * (PAYLOAD // count))
            words[place[own]] = value
    escaped = picked == ESCAPE
    words[place[escaped] + 1] = ids[heads[escaped]]
    stream = np.repeat(np.arange(len(lengths)), lengths)[heads] if n else heads
    return words, np.bincount(stream, weights=takes, minlength=len(lengths)).astype(np.int64)


def unpack(words: np.ndarray) -> np.ndarray:
    """All ids of a run of whole streams."""
    words = np.asarray(words, dtype=np.uint64)
    selectors = (words >> np.uint64(PAYLOAD)).astype(np.int64)
    raw = np.zeros(len(words), dtype=bool)
    if (selectors == ESCAPE).any():
        # A raw word follows an escape and may look like one itself, so they are told apart in order.
        for i in np.flatnonzero(selectors == ESCAPE).tolist():
            if not raw[i]:
                raw[i + 1] = True
    counts = np.array((0, *COUNTS, 0), dtype=np.int64)[selectors]
    counts[raw] = 1
    at = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), dtype=np.uint64)
    for selector, count in enumerate(COUNTS, start=1):
        own = np.flatnonzero((selectors == selector) & ~raw)
        mask = np.uint64((1 << (PAYLOAD // count)) - 1)
        for k in range(count if len(own) else 0):
            out[at[own] + k] = (words[own] >> np.uint64(k * (PAYLOAD // count))) & mask
    out[at[raw]] = words[raw]
    return out
