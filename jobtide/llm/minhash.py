"""Numpy kernel of near-duplicate detection: shingle sets and one-permutation signatures."""

from __future__ import annotations

import numpy as np
import xxhash

from .textkit import Memo, mix, segment_ids

#: Words in a shingle (op7's contract names 4; near-duplicate stages elsewhere take the default of 5).
SHINGLE = 5
#: Bins of the one permutation, bins in a band, and so the number of bands. Two sets of similarity 0.8
#: miss each other in all 32 bands with probability (1 - 0.8^4)^32, about 5e-8.
BINS, ROWS = 128, 4
BANDS = BINS // ROWS

_STEP = np.uint64(0x9E3779B97F4A7C15)


def word_memo() -> Memo:
    """64-bit hash of each word, its A-Z lower-cased."""
    return Memo(lambda w: xxhash.xxh3_64_intdigest(w.lower()))


def shingle_sets(raw: list[bytes], memo: Memo, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): the sorted distinct shingle hashes of each text, one text after the other."""
    words = [x.split() for x in raw]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    total = int(counts.sum())
    flat = np.fromiter((h for ws in words for h in map(memo.__getitem__, ws)), np.uint64, total)
    memo.trim()
    padded = np.concatenate([flat, np.zeros(width, np.uint64)])
    mixed = np.zeros(total, np.uint64)
    for k in range(width):
        mixed = mix(mixed * _STEP + padded[k : k + total] + np.uint64(k))
    begin = np.concatenate([[0], np.cumsum(counts)])
    parts, sizes = [], np.zeros(len(raw), np.int64)
    for i in np.flatnonzero(counts).tolist():
        a, b = int(begin[i]), int(begin[i + 1])
        if b - a >= width:
            own = np.sort(mixed[a : b - width + 1])
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        else:  # the whole sequence as one shingle
            own = np.array([xxhash.xxh3_64_intdigest(flat[a:b].tobytes(), seed=b - a)], np.uint64)
        parts.append(own)
        sizes[i] = len(own)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), sizes


def signatures(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(texts, BINS) one-permutation minima; empty bins are filled by optimal densification.

    The top bits of a hash choose its bin and sorted hashes put each bin's minimum
    first. An empty bin probes bins by a universal hash of (bin, attempt), the same
    for all texts, until it meets one that was not empty (Shrivastava 2017). Texts
    without shingles get a row of zeros, which callers leave out.
    """
    shift = np.uint64(64 - BINS.bit_length() + 1)
    row = segment_ids(sizes)
    bins = (hashes >> shift).astype(np.int64)
    slot = row * BINS + bins
    first = np.ones(len(slot), bool)
    first[1:] = slot[1:] != slot[:-1]
    table = np.zeros(len(sizes) * BINS, np.uint64)
    full = np.zeros(len(sizes) * BINS, bool)
    table[slot[first]] = hashes[first]
    full[slot[first]] = True
    empty = np.flatnonzero(~full & np.repeat(sizes > 0, BINS))
    attempt = 0
    while len(empty):
        attempt += 1
        here = (empty % BINS).astype(np.uint64)
        there = (mix(here * _STEP + np.uint64(attempt)) >> shift).astype(np.int64) + empty // BINS * BINS
        hit = full[there]
        table[empty[hit]] = table[there[hit]]
        empty = empty[~hit]
    return table.reshape(-1, BINS)


def band_keys(table: np.ndarray) -> np.ndarray:
    """(texts, BANDS) bucket keys; the band's number is part of the key."""
    parts = table.reshape(len(table), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP, (len(table), BANDS))
    for k in range(ROWS):
        key = mix(key + parts[:, :, k])
    return key.view(np.int64)
