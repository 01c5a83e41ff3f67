"""A compressed FM-index over words: truncated suffix sort, Huffman-shaped wavelet matrix, backward search."""

from __future__ import annotations

import numpy as np


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths of Huffman codes of symbols that occur so often; a symbol alone gets one bit."""
    if len(counts) == 1:
        return np.ones(1, np.int64)
    leaves = np.argsort(counts, kind="stable")
    weight = counts[leaves].tolist()
    n, made = len(weight), []
    parent = [0] * (2 * n - 1)
    leaf = node = 0
    for k in range(n, 2 * n - 1):  # the two lightest are the next of two rising queues: leaves and made nodes
        total = 0
        for _ in range(2):
            if node >= len(made) or (leaf < n and weight[leaf] <= made[node]):
                parent[leaf] = k
                total += weight[leaf]
                leaf += 1
            else:
                parent[n + node] = k
                total += made[node]
                node += 1
        made.append(total)
    depth = [0] * (2 * n - 1)
    for k in reversed(range(2 * n - 2)):
        depth[k] = depth[parent[k]] + 1
    lengths = np.empty(n, np.int64)
    lengths[leaves] = depth[:n]
    return lengths


class WaveletMatrix:
    """Ranks over a sequence of small numbers, compressed to about its zero-order entropy: bits are those of Huffman
    codes, packed, one row a level, with a 32-bit rank for each 512 bits and a 16-bit one for each 64 between.

    A level holds its nodes' zero children before their one children; codes that end there are given to its last
    nodes, so that what goes on to the next level stays in one piece."""

    def __init__(self, sequence: np.ndarray):
        counts = np.bincount(sequence, minlength=1)
        used = np.flatnonzero(counts)
        lengths = code_lengths(counts[used]) if len(used) else np.empty(0, np.int64)
        self.lengths = np.zeros(len(counts), np.uint8)
        self.lengths[used] = lengths
        self.levels = int(lengths.max(initial=0))
        self.codes = np.zeros(len(counts), np.int64)  # first bit lowest
        nodes = np.zeros(1, np.int64)
        for level in range(self.levels):
            nodes = np.concatenate([nodes, nodes | np.int64(1) << np.int64(level)])
            ending = used[lengths == level + 1]
            keep = len(nodes) - len(ending)
            self.codes[ending], nodes = nodes[keep:], nodes[:keep]
        self.words, self.supers, self.blocks, self.zeros = [], [], [], []
        now = sequence
        for level in range(self.levels):
            bits = (self.codes[now] >> level & 1).astype(bool)
            padded = np.zeros((len(bits) // 512 + 1) * 512, bool)
            padded[: len(bits)] = bits
            words = np.packbits(padded, bitorder="little").view("<u8")
            ones = np.bitwise_count(words).reshape(-1, 8).astype(np.int32)
            self.words.append(words)
            self.supers.append(np.concatenate([[0], np.cumsum(ones.sum(axis=1))])[:-1].astype(np.int32))
            self.blocks.append((np.cumsum(ones, axis=1) - ones).astype(np.uint16).ravel())
            self.zeros.append(int(len(bits) - bits.sum()))
            now = np.concatenate([now[~bits], now[bits]])
            now = now[self.lengths[now] > level + 1]

    def walk(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the prefix of length ``at`` ends in the run of each symbol, on the level where its code ends; ``at``
        may have several rows."""
        lengths = self.lengths[symbols]
        order = np.argsort(lengths, kind="stable")[::-1]  # longest codes first: each level takes a leading part
        codes, at = self.codes[symbols[order]], at[..., order]
        left = len(symbols) - np.cumsum(np.bincount(lengths, minlength=self.levels + 1))
        for level, n in enumerate(left[:-1].tolist()):
            now = at[..., :n]
            word = now >> 6
            below = (np.uint64(1) << (now & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.supers[level][now >> 9] + (self.blocks[level][word] + np.bitwise_count(self.words[level][word] & below)).astype(np.int64)
            at[..., :n] = np.where(codes[:n] >> level & 1, self.zeros[level] + ones, now - ones)
        out = np.empty_like(at)
        out[..., order] = at
        return out

    def nbytes(self) -> int:
        """Bytes of the bit rows, their ranks and the codes."""
        rows = sum(part.nbytes for each in (self.words, self.supers, self.blocks) for part in each)
        return rows + self.codes.nbytes + self.lengths.nbytes


class FmIndex:
    """Over texts of words, given one after the other (``flat``) with their lengths; patterns of up to
    ``depth`` words. A text may stand for several places (``places``, one each if not given): the places of the
    suffixes are summed up beside the index, so that an interval tells how often a pattern occurs in all."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray, depth: int, places: np.ndarray | None = None):
        _, codes = np.unique(flat, return_inverse=True)
        self.starts = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
        self.codes = np.zeros(int(lengths.sum() + len(lengths)), np.int32)  # 0 ends each text
        inside = np.ones(len(self.codes), bool)
        inside[self.starts + lengths] = False
        self.codes[inside] = codes + 1
        self.n = len(self.codes)
        order = self._suffixes(depth)
        self.matrix = WaveletMatrix(self.codes[order - 1])
        each = np.ones(len(lengths), np.int64) if places is None else places
        self.places = np.concatenate([[0], np.cumsum(np.repeat(each, lengths + 1)[order])])
        symbols = np.arange(int(self.codes.max(initial=0)) + 1)
        before = np.concatenate([[0], np.cumsum(np.bincount(self.codes, minlength=len(symbols)))])[:-1]
        self.base = before - self.matrix.walk(symbols, np.zeros(len(symbols), np.int64))

    def _suffixes(self, depth: int) -> np.ndarray:
        """Places of suffixes sorted by their first ``depth`` words or more."""
        rank, span = self.codes.astype(np.int64), 1
        order = np.argsort(rank)
        while span < min(depth, self.n):
            after = np.zeros(self.n, np.int64)
            after[: self.n - span] = rank[span:]
            key = rank * (self.n + 1) + after
            order = np.argsort(key)
            sorted_key = key[order]
            rank = np.empty(self.n, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
            span *= 2
        return order

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the interval of each pattern with ``symbols`` put in front."""
        low, high = self.base[symbols] + self.matrix.walk(symbols, np.stack([low, high]))
        return low, high

    def occurrences(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Places at which the pattern of each interval occurs."""
        return self.places[np.maximum(high, low)] - self.places[low]


def repeated_windows(index: FmIndex, texts: np.ndarray, lengths: np.ndarray, window: int) -> np.ndarray:
    """Per text (numbers into the index) a bit mask of the windows that occur at two places or more.

    From a right end ``e`` backward search runs left while the words still occur twice; where it stops, at
    ``f``, all windows right of ``f`` that end by ``e`` are repeated. Growing runs from ``f`` on then tell how
    far left the next right end must be; all texts of the index take each step together."""
    masks = np.zeros(len(texts), np.int64)
    at = np.flatnonzero(lengths >= window)
    origin, end = index.starts[texts], lengths - 1
    place, stop = end.copy(), np.full(len(texts), -1)
    low, high = np.zeros(len(texts), np.int64), np.full(len(texts), index.n)
    run = np.zeros(len(texts), np.int64)  # length of the run tried from ``stop``; 0 while searching
    for _ in range(2 * int(lengths.max(initial=0))):
        if not len(at):
            return masks
        low[at], high[at] = index.extend(index.codes[origin[at] + place[at]], low[at], high[at])
        twice = index.occurrences(low[at], high[at]) >= 2
        place[at] -= twice
        trying = run[at] > 0
        done = ~twice | (place[at] < np.where(trying, stop[at], 0))
        low_end = at[done & ~trying]
        if len(low_end):  # a search ended: report, then try runs from where it stopped
            failed = (~twice)[done & ~trying]
            first = np.where(failed, place[low_end] + 1, 0)
            last = end[low_end] - window + 1
            hit = first <= last
            masks[low_end[hit]] |= (np.int64(1) << (last[hit] + 1)) - (np.int64(1) << first[hit])
            stop[low_end] = np.where(failed, place[low_end], -1)
            run[low_end] = 1
        tried = at[done & trying]
        if len(tried):
            failed = (~twice)[done & trying]
            longer = ~failed & (stop[tried] + 2 * run[tried] - 1 < end[tried])
            end[tried] = np.where(longer, end[tried], np.where(failed, np.minimum(end[tried] - 1, stop[tried] + run[tried] - 2), end[tried] - 1))
            run[tried] = np.where(longer, 2 * run[tried], 0)
        again = at[done]
        place[again] = np.where(run[again] > 0, stop[again] + run[again] - 1, end[again])
        low[again], high[again] = 0, index.n
        ended = (stop < 0) & (run > 0) | (end < window - 1)
        at = at[~ended[at]]
    # windows that end after ``end`` are decided
    open_windows = end[at] - window + 2
    text = np.repeat(at, open_windows)
    first = np.arange(len(text)) - np.repeat(np.cumsum(open_windows) - open_windows, open_windows)
    low, high = np.zeros(len(text), np.int64), np.full(len(text), index.n)
    for step in reversed(range(window)):
        low, high = index.extend(index.codes[origin[text] + first + step], low, high)
        twice = index.occurrences(low, high) >= 2
        text, first, low, high = text[twice], first[twice], low[twice], high[twice]
    np.bitwise_or.at(masks, text, np.int64(1) << first)
    return masks
