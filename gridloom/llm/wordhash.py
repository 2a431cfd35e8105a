"""64-bit hashes of all words of many texts, without a Python object per word.

Words are what ASCII white space separates, with A-Z as a-z, in UTF-8. A word's hash is a polynomial over fixed
random numbers of its bytes, modulo 2**64, summed for all words of a buffer at once; words of more than LONG
bytes get a library's hash instead. Buffers are cut at white space, so memory doesn't grow with a text's length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash

#: Bytes of a buffer, and of the longest word that is hashed as a polynomial.
BUFFER, LONG = 1 << 20, 4096
SPACE = re.compile(rb"[ \t-\r]")

_numbers = np.random.default_rng(20).integers(1, 1 << 63, 256 + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: A number for each byte, 0 for white space, and powers of an odd number by place within the word.
BYTE = np.where(np.isin(np.arange(256), [9, 10, 11, 12, 13, 32]), np.uint64(0), _numbers[:256])
POWER = np.cumprod(np.r_[np.uint64(1), np.full(LONG - 1, _numbers[256])], dtype=np.uint64)
#: Multipliers of a public 64-bit mixing function.
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def lowered(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower() if text else b""


def pieces(raw: bytes) -> Iterator[tuple[int, int]]:
    """Stretches of about BUFFER bytes that end at white space."""
    at = 0
    while at < len(raw):
        end = at + BUFFER
        if end < len(raw):
            space = SPACE.search(raw, end)
            end = space.start() if space else len(raw)
        yield at, min(end, len(raw))
        at = end


def _hashed(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of a buffer."""
    b = np.frombuffer(raw, np.uint8)
    value = BYTE[b]
    inside = value != 0
    begins = np.flatnonzero(inside & np.r_[True, ~inside[:-1]])
    if not len(begins):
        return np.zeros(0, np.uint64), begins
    sizes = np.diff(np.r_[begins, len(b)])  # with the white space that follows
    place = np.arange(begins[0], len(b)) - np.repeat(begins, sizes)
    hashes = np.add.reduceat(value[begins[0] :] * POWER[np.minimum(place, LONG - 1)], begins - begins[0])
    for k in np.flatnonzero(sizes > LONG).tolist():
        word = raw[begins[k] : begins[k] + sizes[k]].split()[0]
        if len(word) > LONG:
            hashes[k] = xxhash.xxh3_64_intdigest(word)
    return mix(hashes), begins


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after another, and the number of words of each text."""
    out, counts = [np.zeros(0, np.uint64)], np.zeros(len(texts), np.int64)
    held, first, size = [], 0, 0

    def flush() -> None:
        raw = b"\n".join(held)
        hashes, begins = _hashed(raw)
        edges = np.cumsum([0, *(len(h) + 1 for h in held)])
        counts[first : first + len(held)] += np.diff(np.searchsorted(begins, edges))
        out.append(hashes)
        held.clear()

    for k, text in enumerate(texts):
        raw = lowered(text)
        if held and size + len(raw) > BUFFER:
            flush()
            size = 0
        if len(raw) > BUFFER:
            for a, b in pieces(raw):
                hashes, _ = _long_word(raw[a:b]) if b - a > 4 * BUFFER else _hashed(raw[a:b])
                out.append(hashes)
                counts[k] += len(hashes)
            continue
        if not held:
            first = k
        held.append(raw)
        size += len(raw)
    if held:
        flush()
    return np.concatenate(out), counts


def _long_word(raw: bytes) -> tuple[np.ndarray, None]:
    """A stretch with a word that is longer than several buffers: word by word."""
    return np.concatenate([_hashed(w)[0] if len(w) <= LONG else mix(np.array([xxhash.xxh3_64_intdigest(w)], np.uint64)) for w in raw.split()]), None
