"""Bit-sliced comparison of 64-bit fingerprints.

Bit planes are stored vertically: plane b holds bit b of 64 fingerprints a word.
A plane's XOR is added to the distances of 64 pairs at a time by carry-save
counters, and a block is abandoned once all of its distances exceed the radius.
"""

from __future__ import annotations

import numpy as np

#: Buckets up to this size are compared many at a time by shifting the planes.
SMALL = 64
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def majority(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bits set in more than half of each run of ``values``."""
    if len(starts) == 1 and len(values) > 1 << 20:
        ones = sum(np.unpackbits(values[k : k + (1 << 20)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for k in range(0, len(values), 1 << 20))[None, :]
    else:
        bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > counts[:, None], axis=1, bitorder="little").view("<u8").ravel()


def planes_of(values: np.ndarray) -> np.ndarray:
    """64 bit planes of the values: plane b holds bit b of value i in bit i % 64 of word i // 64."""
    n = -(-len(values) // 64) * 64
    padded = np.zeros(n, "<u8")
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8").astype(np.uint64)


def within(differences, shape, radius: int) -> np.ndarray:
    """Bits of the pairs with at most ``radius`` set bits in the planes of ``differences``.

    Carry-save counters: at each weight up to two planes wait, a third makes a
    sum there and a carry above.  Counts start so high that a pair beyond the
    radius, and no other, carries out of the top weight.
    """
    weights = radius.bit_length()
    start = (1 << weights) - 1 - radius
    waiting = [[np.full(shape, ONES)] if start >> w & 1 else [] for w in range(weights)]
    over = np.zeros(shape, np.uint64)

    def add(w, plane):
        nonlocal over
        if w == weights:
            over |= plane
            return
        waiting[w].append(plane)
        if len(waiting[w]) == 3:
            a, b, c = waiting[w]
            half = a ^ b
            waiting[w] = [half ^ c]
            add(w + 1, (a & b) | (half & c))

    for k, plane in enumerate(differences):
        add(0, plane)
        if k % 8 == 7 and (over == ONES).all():
            return ~over
    for w in range(weights):
        if len(waiting[w]) == 2:
            a, b = waiting[w]
            waiting[w] = [a ^ b]
            add(w + 1, a & b)
    return ~over


def pairs_small(values: np.ndarray, bucket: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within buckets of at most ``SMALL``: the planes against themselves, shifted."""
    sizes = np.bincount(bucket)
    order = np.argsort(-sizes[bucket] * np.int64(len(sizes) + 1) + bucket, kind="stable")
    values, bucket = values[order], bucket[order]
    size = sizes[bucket]
    found_a, found_b = [], []
    for shift in range(1, int(size.max(initial=0))):
        n = int(np.count_nonzero(size > shift))
        same = np.zeros(-(-n // 64) * 64, bool)
        m = n - shift
        if m <= 0:
            break
        same[:m] = bucket[:m] == bucket[shift:n]
        words = np.packbits(same, bitorder="little").view("<u8")
        left, right = planes_of(values[:n]), planes_of(values[shift:n])
        w = right.shape[1]
        near = within((left[b, :w] ^ right[b] | ~words[:w] for b in range(64)), w, radius) & words[:w]
        hit = np.flatnonzero(np.unpackbits(near.astype("<u8").view(np.uint8), bitorder="little"))
        found_a.append(hit)
        found_b.append(hit + shift)
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return order[np.concatenate(found_a)], order[np.concatenate(found_b)]


def block_near(queries: np.ndarray, planes: np.ndarray, radius: int) -> np.ndarray:
    """For each query, the values (as bits, padded to whole words) within the radius."""
    own = [np.where((queries >> np.uint64(b)) & np.uint64(1), ONES, np.uint64(0))[:, None] for b in range(64)]
    return within((planes[b] ^ q for b, q in enumerate(own)), (len(queries), planes.shape[1]), radius)


def unpacked(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(words.astype("<u8").view(np.uint8), axis=1, bitorder="little")


def pairs_large(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within one bucket: blocks of queries against all planes."""
    planes, n = planes_of(values), len(values)
    pad = np.zeros(planes.shape[1], np.uint64)
    if n % 64:
        pad[-1] = ONES << np.uint64(n % 64)
    found_a, found_b = [], []
    for lo in range(0, n, 256):
        w = lo // 64  # pairs below the block were found from the other side
        near = block_near(values[lo : lo + 256], planes[:, w:], radius) & ~pad[w:]
        a, b = np.nonzero(unpacked(near))
        a, b = a + lo, b + 64 * w
        found_a.append(a[a < b])
        found_b.append(b[a < b])
    return np.concatenate(found_a), np.concatenate(found_b)


def least_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of 0..n-1 reaches over the links."""
    label = np.arange(n)
    while len(a):
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def clustered(values: np.ndarray, sizes: np.ndarray, exempt: np.ndarray, radius: int, least: float) -> np.ndarray:
    """Component of each value under links of ``radius`` and sizes within ``least``; never all pairs at once.

    A block of values asks all that have not asked yet.  Those who ask first
    belong to the smallest components, and once all that are left to ask belong
    to one component nothing can change, so that a group of copies takes a few
    blocks, whatever its size.
    """
    n = len(values)
    label, left, ask = np.arange(n), np.arange(n), 1
    while len(left) > 1:
        own, counts = np.unique(label[left], return_counts=True)
        if len(own) < 2:
            break
        left = left[np.argsort(counts[np.searchsorted(own, label[left])], kind="stable")]
        asking, ask = left[:ask], min(256, 2 * ask)
        near = unpacked(block_near(values[asking], planes_of(values[left]), radius))[:, : len(left)].astype(bool)
        near |= exempt[asking, None] | exempt[None, left]
        a, b = sizes[asking, None], sizes[None, left]
        near &= np.minimum(a, b) >= least * np.maximum(a, b) - 1e-9
        which, other = np.nonzero(near)
        # links between the labels met here
        met, at = np.unique(np.concatenate([label[asking[which]], label[left[other]]]), return_inverse=True)
        joined = met[least_labels(at[: len(which)], at[len(which) :], len(met))]
        place = np.minimum(np.searchsorted(met, label), len(met) - 1)
        label = np.where(met[place] == label, joined[place], label)
        left = left[len(asking) :]
    return label
