"""Word shingles of whole texts as 64-bit hashes, vectorised over batches of documents."""

from __future__ import annotations

import hashlib

import numpy as np

_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # fixed values: the multipliers of the splitmix64 mixer
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, words in each text): words are runs of bytes other than space and \\t to \\r, A-Z lower-cased."""
    data = np.frombuffer((b" ".join(texts) + b" " * 9).translate(_LOWER), np.uint8)
    ends_of_text = np.cumsum([len(t) + 1 for t in texts])
    space = _SPACE[data]
    start = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    end = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
    length = end - start
    counts = np.diff(np.searchsorted(start, ends_of_text), prepend=0)
    h = length.astype(np.uint64)
    todo = np.arange(len(start))
    offset = 0
    while len(todo):  # eight bytes of every word that has them, in each round
        at, left = start[todo] + offset, length[todo] - offset
        lane = np.zeros(len(todo), np.uint64)
        for k in range(8):
            byte = data[np.minimum(at + k, len(data) - 1)].astype(np.uint64)
            lane |= np.where(left > k, byte, 0).astype(np.uint64) << np.uint64(8 * k)
        h[todo] = mix(h[todo] * np.uint64(0x9E3779B97F4A7C15) + lane + np.uint64(offset + 1))
        todo = todo[left > 8]
        offset += 8
    return h, counts


def shingle_sets(texts: list[str | None], width: int = 5) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles; shorter texts have one of all their words, texts without words none."""
    words, counts = word_hashes([(t or "").encode("utf-8", "surrogatepass") for t in texts])
    rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        rolled = mix(rolled * np.uint64(0x9E3779B97F4A7C15) + words[k: len(words) - width + 1 + k] + np.uint64(k))
    out, at = [], 0
    for n in counts:
        if n >= width:
            out.append(np.unique(rolled[at: at + n - width + 1]))
        elif n:
            h = np.zeros(1, np.uint64)
            for w in words[at: at + n]:
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w + np.uint64(100 + n))
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def set_digest(hashes: np.ndarray) -> bytes:
    """128 bits that are equal for equal sets."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
