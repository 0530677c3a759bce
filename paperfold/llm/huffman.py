"""Canonical, length-limited Huffman codes for token ids, on numpy arrays.

Small helpers of `token_files`: build a code from counts, pack ids into bits,
and read them back by table, many checkpoints abreast.
"""

from __future__ import annotations

import numpy as np

# Longest code word. The decoding table has 2 ** MAX_BITS entries; a vocabulary
# of up to 2 ** MAX_BITS ids always fits.
MAX_BITS = 18
# Ids between two bit offsets kept for the reader.
CHECKPOINT = 256


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Code length of each id by the package-merge rule; 0 where the count is 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} different ids need code words of more than {limit} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.float64)
    # Level by level: pair what the level below chose, merge with the leaves.
    # Only how many leaves stand among the first entries of a level is needed.
    levels = []
    packages = np.empty(0)
    for _ in range(limit):
        weights = np.concatenate([leaves, packages])
        order = np.argsort(weights, kind="stable")
        levels.append(order < len(leaves))
        merged = weights[order]
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
    take = 2 * len(leaves) - 2
    for is_leaf in reversed(levels):
        among = int(is_leaf[:take].sum())
        lengths[used[:among]] += 1
        take = 2 * (take - among)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Code words in order of (length, id)."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    code, last = 0, 0
    for symbol in order[np.searchsorted(lengths[order], 1) :]:
        n = int(lengths[symbol])
        code <<= n - last
        codes[symbol] = code
        code, last = code + 1, n
    return codes


def decoding_table(lengths: np.ndarray, limit: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """For each `limit`-bit prefix: the id it begins with, and that word's length."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[np.searchsorted(lengths[order], 1) :]
    spans = 1 << (limit - lengths[order].astype(np.int64))
    ids, bits = np.zeros(1 << limit, np.uint32), np.ones(1 << limit, np.uint8)
    filled = int(spans.sum())
    ids[:filled] = np.repeat(order.astype(np.uint32), spans)
    bits[:filled] = np.repeat(lengths[order], spans)
    return ids, bits


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, every: int = CHECKPOINT):
    """Bits of the ids as big-endian 32-bit words, and the bit offset of each `every`-th id."""
    sizes = lengths[ids].astype(np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    total = int(ends[-1]) if len(ids) else 0
    words = (total + 31) // 32 + 2  # the reader looks 64 bits ahead
    at = starts >> 5
    value = codes[ids] << (64 - (starts & 31) - sizes).astype(np.uint64)
    # Code words don't overlap, so sums of halves below 2 ** 32 are exact in doubles.
    out = np.bincount(at, (value >> np.uint64(32)).astype(np.float64), words)
    out += np.bincount(at + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), words)
    return out.astype(np.uint64).astype(">u4").tobytes(), starts[::every].astype("<u4")


def unpack(bits: bytes, offsets: np.ndarray, count: int, table, every: int = CHECKPOINT, limit: int = MAX_BITS):
    """The ids behind `bits`: all stretches between checkpoints are read abreast."""
    ids, sizes = table
    words = np.frombuffer(bits, ">u4").astype(np.uint64)
    at = offsets.astype(np.int64)
    out = np.zeros((every, len(at)), np.uint32)
    shift, mask = np.uint64(64 - limit), np.uint64((1 << limit) - 1)
    last = count - every * (len(at) - 1)  # ids in the last stretch
    for k in range(every if len(at) > 1 else last):
        lane = at if k < last else at[:-1]
        word = lane >> 5
        ahead = (words[word] << np.uint64(32)) | words[word + 1]
        prefix = (ahead >> (shift - (lane & 31).astype(np.uint64))) & mask
        out[k, : len(lane)] = ids[prefix]
        lane += sizes[prefix]
    return out.T.reshape(-1)[:count] if len(at) else np.zeros(0, np.uint32)
