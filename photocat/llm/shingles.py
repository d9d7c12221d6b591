"""Sets of word shingles as sorted 64-bit numbers, computed with numpy inside tasks.

Words are runs of characters other than white space (U+0020, U+0009 to U+000D) with
A-Z lowered.  A set holds the distinct runs of ``k`` words; a text of fewer words
is one run; a text without words has the empty set.  A run is represented by a
64-bit hash of its words, so two different runs of one text coincide with a
probability of about n^2 / 2^65.
"""

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
SLICE_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * BASE)
BYTE[SPACE] = 0


def _powers(base: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64, for a slice and the word that ends it."""
    out = np.full(1 << 12, np.uint64(base))
    out[0] = 1
    out = np.multiply.accumulate(out)
    step = np.uint64(pow(base, len(out), 1 << 64))
    steps = np.full(SLICE_BYTES // len(out), step)
    steps[0] = 1
    return np.multiply.outer(np.multiply.accumulate(steps), out).ravel()


POWER = _powers(int(BASE))
BACK = _powers(pow(int(BASE), -1, 1 << 64))


def _slices(data: bytes):
    """Runs of whole words of at most SLICE_BYTES; a longer word is a slice of its own."""
    at = 0
    while at < len(data):
        end = at + SLICE_BYTES
        if end < len(data):
            part = SPACE[np.frombuffer(data, np.uint8, SLICE_BYTES, at)]
            ends = np.flatnonzero(part)
            if len(ends):
                end = at + int(ends[-1]) + 1
            else:
                while end < len(data) and not SPACE[data[end]]:
                    end += 1
        yield data[at:end]
        at = end


def word_hashes(text: str) -> np.ndarray:
    """One number per word of ``text``, in order."""
    found = []
    for part in _slices(text.encode().lower()):  # bytes.lower() changes A-Z only
        raw = np.frombuffer(part, np.uint8)
        inside = ~SPACE[raw]
        starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
        if not len(starts):
            continue
        if len(raw) > SLICE_BYTES:  # one word longer than a slice
            value = np.uint64(0)
            for at in range(0, len(raw), SLICE_BYTES):
                piece = raw[at : at + SLICE_BYTES]
                value = mix(value + (BYTE[piece] * POWER[: len(piece)]).sum(dtype=np.uint64, keepdims=True))[0]
            found.append(np.array([value]))
        else:
            sums = np.add.reduceat(BYTE[raw] * POWER[: len(raw)], starts)
            found.append(mix(sums * BACK[starts]))
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct shingles of ``text``."""
    words = word_hashes(text) if text else np.empty(0, np.uint64)
    if not len(words):
        return words
    width = min(k, len(words))
    runs = np.full(len(words) - width + 1, np.uint64(width))
    for i in range(width):
        runs = mix(runs * BASE + words[i : i + len(runs)])
    return np.unique(runs)
