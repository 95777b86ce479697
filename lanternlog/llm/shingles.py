"""Hashed word shingles, MinHash samples and odd sketches of texts, vectorised over blocks of texts."""

from __future__ import annotations

from functools import lru_cache
from math import comb

import numpy as np

from .bpe import Hash

SHINGLE = 5
BANDS, BAND_ROWS = 48, 5
SAMPLES = BANDS * BAND_ROWS
#: The odd sketch folds one sample for each of so many slices of the hash range into a bitmap of so many bits.
SLICES, SKETCH_BITS = 2048, 4096
#: Hashes of two sets together up to which a pair is refused only beyond a proven bound.
SURE = 2048
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_hash = Hash(21)
_rng = np.random.Generator(np.random.PCG64(22))
_ODD = lambda n: _rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE, _MUL, _ADD, _BAND = _ODD(SHINGLE), _ODD(SAMPLES), _ODD(SAMPLES), _ODD(BAND_ROWS)
_TAG = np.arange(SAMPLES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles: A-Z in lower case, five words; a shorter text is one shingle as
    a whole, one without words has none. The texts of a block share one pass over their bytes."""
    raw = [(t or "").encode() for t in texts]
    data = _LOWER[np.frombuffer(b"\n".join([*raw, b""]), np.uint8)]
    space = np.concatenate([[True], _SPACE[data], [True]])
    begins = np.flatnonzero(space[:-1] & ~space[1:])
    ends = np.flatnonzero(~space[:-1] & space[1:])
    words = _hash.slices(data, begins, ends)
    text_ends = np.cumsum([len(r) + 1 for r in raw])
    counts = np.bincount(np.searchsorted(text_ends, begins, side="right"), minlength=len(texts))
    at = np.concatenate([[0], np.cumsum(counts)])
    n = len(words)
    joined = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        if n > k:
            joined[: n - k] += mix(words[k:] + _PLACE[k])
    joined = mix(joined)
    out = []
    for i, c in enumerate(counts.tolist()):
        if c >= SHINGLE:
            out.append(np.unique(joined[at[i] : at[i + 1] - SHINGLE + 1]))
        elif c:
            out.append(mix((mix(words[at[i] : at[i + 1]] + _PLACE[:c]).sum(keepdims=True, dtype=np.uint64) + np.uint64(c))))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signature(hashes: np.ndarray) -> np.ndarray:
    """MinHash samples of a non-empty set."""
    least = np.full(SAMPLES, 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), 2048):
        part = hashes[i : i + 2048, None] * _MUL + _ADD
        np.minimum(least, (part ^ (part >> np.uint64(32))).min(axis=0), out=least)
    return least


def bands(samples: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of samples; the band's number is part of it."""
    rows = mix(samples + _TAG).reshape(BANDS, BAND_ROWS)
    return mix((rows * _BAND).sum(axis=1)).view(np.int64)


def odd_sketch(hashes: np.ndarray) -> bytes:
    """Parity bitmap of a sorted set's MinHash samples: the least hash of each slice of the range flips the bit it hashes to."""
    slices = hashes >> np.uint64(64 - SLICES.bit_length() + 1)
    first = np.ones(len(hashes), bool)
    first[1:] = slices[1:] != slices[:-1]
    bit = mix(hashes[first]) % np.uint64(SKETCH_BITS)
    return np.packbits(np.bincount(bit.astype(np.int64), minlength=SKETCH_BITS) % 2 == 1).tobytes()


def _filled(n: np.ndarray) -> np.ndarray:
    """Slices that a set of n hashes is expected to fill, which is the number of its samples."""
    return SLICES * -np.expm1(n * np.log1p(-1 / SLICES))


def estimate(differing_bits: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(similarity, its standard error) of sets of known sizes from the population count of the XOR of their odd sketches.

    The count gives how many samples differ, hence how many are equal; the similarity is their share of the union's
    samples, whose number follows from the sizes and the similarity itself, so a few rounds settle both. The error is that
    of the bitmap's collisions and of sampling; it vanishes for sets so small that every hash is a sample."""
    share = np.minimum(2 * differing_bits / SKETCH_BITS, 1 - 1e-9)
    differ = -SKETCH_BITS / 2 * np.log1p(-share)
    total, sizes = _filled(sizes_a) + _filled(sizes_b), sizes_a + sizes_b
    same = np.clip((total - differ) / 2, 0, None)
    found = np.full(np.shape(same), 0.75)
    for _ in range(4):
        union = sizes / (1 + found)
        found = np.clip(same / np.maximum(_filled(union), 1e-9), 0, 1)
    union = sizes / (1 + found)
    flat = np.exp(-4 * differ / SKETCH_BITS)
    bits = np.maximum(SKETCH_BITS / 4 * (1 - flat) - differ * flat, 0) / flat
    collisions = np.sqrt(bits) / 2 * total / np.maximum(total - same, 1e-9) ** 2
    samples = _filled(union)
    sampling = found * (1 - found) / np.maximum(samples, 1) * (1 - samples / np.maximum(union, 1e-9)).clip(0)
    return found, np.sqrt(collisions**2 + sampling)


@lru_cache
def most_differing(percent: int) -> np.ndarray:
    """For each total of two sizes up to SURE, the differing bits that a pair of that similarity exceeds once in 10^8 at most.

    Such sets differ in d <= total x (100 - percent) / (100 + percent) hashes and share s <= total / 2. A differing hash
    makes one sample differ; below the least shared hash of its slice it makes two, and those ranges cover at most s slices. So
    d + Binomial(d, s / SLICES) bits bound the differing ones from above."""
    out = np.zeros(SURE + 1, np.int64)
    for total in range(SURE + 1):
        d = total * (100 - percent) // (100 + percent)
        p, beyond, k = min(total / 2 / SLICES, 1.0), 0.0, d
        while k > 0 and (beyond := beyond + comb(d, k) * p**k * (1 - p) ** (d - k)) <= 1e-8:
            k -= 1
        out[total] = d + k
    return out


def may_reach(differing_bits: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether a similarity of percent lies within five standard errors (and a half percent) of the estimate, or, for sets of
    up to SURE hashes together, within the bits that slice collisions can make differ. The error of so small sets isn't normal."""
    found, error = estimate(differing_bits, sizes_a, sizes_b)
    total = sizes_a + sizes_b
    allowed = most_differing(percent)[np.minimum(total, SURE)]
    return (found + 5 * error + 0.005 >= percent / 100) | (total <= SURE) & (differing_bits <= allowed)


def fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    a, b = mix(hashes), mix(hashes * np.uint64(0xD6E8FEB86659FD93) + np.uint64(len(hashes)))
    return tuple(int(x) for x in np.array([a.sum(dtype=np.uint64), b.sum(dtype=np.uint64)]).view(np.int64))


def similar(a: np.ndarray, b: np.ndarray, percent: int = 75) -> bool:
    """Whether 100 x intersection >= percent x union of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)
