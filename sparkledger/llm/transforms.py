"""Burrows-Wheeler transforms of shards of strings, merged by iterative interleave refinement.

A shard's transform lists, for its suffixes in order, the byte before each. Transforms of several shards
are merged without sorting a suffix again: an interleave says from which shard the next suffix comes.
At first it takes shard after shard; each round extends the order by one byte: every suffix, in the
order known so far, is put behind those that begin with the same byte, since the byte before a suffix
is the first one of the suffix that begins there. After ``depth`` rounds suffixes are in order by
their first ``depth`` bytes. The round in which neighbours first fall into different blocks is their common
prefix, and blocks that no round divides are the repeated intervals.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

END = 0  # stands behind every string, below all bytes; bytes are kept one higher


@dataclass(frozen=True)
class Transform:
    """The byte before each suffix in suffix order (one higher; END before a string's first), and where each suffix begins: place in the shard."""

    before: np.ndarray
    place: np.ndarray


def transform(data: np.ndarray, starts: np.ndarray, depth: int) -> Transform:
    """The transform of strings that lie end to end; suffixes are in order by depth bytes, and by place beyond.

    starts: where each string begins, and the end of all. Every string has its end mark as a last suffix.
    """
    n, m = len(data), len(starts) - 1
    lengths = np.diff(starts)
    marked = np.zeros(n + m, dtype=np.int64)
    inside = np.arange(n) + np.repeat(np.arange(m), lengths)
    marked[inside] = data.astype(np.int64) + 1
    ends = starts[1:] + np.arange(m)
    stop = np.repeat(ends, lengths + 1)
    rank, done = marked.copy(), 1
    at = np.arange(n + m)
    while done < depth:
        step = min(done, depth - done)
        after = np.minimum(at + step, stop)  # the mark follows itself: nothing is behind it
        _, rank = np.unique(rank * (n + m + 258) + rank[after], return_inverse=True)
        done += step
    order = np.argsort(rank, kind="stable")
    first = np.zeros(n + m, dtype=bool)
    first[starts[:-1] + np.arange(m)] = True
    return Transform(np.where(first[order], END, marked[order - 1]).astype(np.uint16), order)


def merge(parts: list[Transform], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shard and index in its transform of each suffix, in merged order, and the common prefix with the one before (depth at most).

    Ends of strings match nothing, each other neither. Each round is two counting sorts of small numbers.
    """
    sizes = [len(p.before) for p in parts]
    total, base = sum(sizes), np.r_[0, np.cumsum(sizes)[:-1]]
    symbols = np.concatenate([p.before for p in parts]) if parts else np.zeros(0, np.uint16)
    m = int((symbols == END).sum())
    kind = np.uint8 if len(parts) < 256 else np.uint16
    firsts = np.concatenate([np.sort(p.before) for p in parts]) if parts else symbols  # the sorted bytes of a transform are its suffixes' first bytes
    order = np.argsort(firsts, kind="stable")
    interleave = np.repeat(np.arange(len(parts)), sizes).astype(kind)[order]
    head = firsts[order]
    prefix = np.full(total, -1, dtype=np.int16)
    prefix[np.flatnonzero(head[1:] != head[:-1]) + 1] = 0
    prefix[:m] = 0  # ends differ
    block = np.cumsum(prefix >= 0, dtype=np.int32)
    nth = np.empty(total, dtype=np.int32)
    numbers = np.arange(total, dtype=np.int32)
    for h in range(1, depth if m < total else 1):
        # the k-th suffix of a shard in this order is the k-th of its transform: order inside a shard never changes
        nth[np.argsort(interleave, kind="stable")] = numbers
        own = symbols[nth]
        moved = np.argsort(own, kind="stable")[m:]  # suffixes that are ends keep their place at the front
        interleave = np.concatenate([interleave[:m], interleave[moved]])
        source, byte = block[moved], own[moved]
        divided = np.flatnonzero(np.r_[True, (source[1:] != source[:-1]) | (byte[1:] != byte[:-1])]) + m
        fresh = divided[prefix[divided] < 0]
        if not len(fresh):
            break
        prefix[fresh] = h
        block = np.cumsum(prefix >= 0, dtype=np.int32)
    prefix[prefix < 0] = depth
    nth[np.argsort(interleave, kind="stable")] = numbers
    return interleave, nth - base[interleave], prefix


def repeated_bytes(strings: list[bytes], shards: int, length: int) -> list[np.ndarray]:
    """For each string, in order of place, which of its bytes a string of that length covers that also starts earlier: shards' transforms, merged."""
    own = [list(range(i, len(strings), shards)) for i in range(min(shards, len(strings)))]
    parts, where = [], []
    for numbers in own:
        sizes = np.array([len(strings[i]) for i in numbers])
        starts = np.r_[0, np.cumsum(sizes)]
        parts.append(transform(np.frombuffer(b"".join(strings[i] for i in numbers), dtype=np.uint8), starts, length))
        begin = starts[:-1] + np.arange(len(numbers))
        string = np.repeat(numbers, sizes + 1)
        at = np.arange(len(string)) - np.repeat(begin, sizes + 1)
        where.append(np.stack([string, at])[:, parts[-1].place])
    gone = [np.zeros(len(s) + 1, dtype=np.int64) for s in strings]
    if not parts:
        return gone
    shard, index, prefix = merge(parts, length)
    first = np.r_[0, np.cumsum([w.shape[1] for w in where])[:-1]]
    string, at = np.concatenate(where, axis=1)[:, first[shard] + index]
    interval = np.cumsum(prefix < length)
    order = np.lexsort((at, string, interval))
    later = order[1:][interval[order[1:]] == interval[order[:-1]]]
    for i, k in zip(string[later].tolist(), at[later].tolist(), strict=True):
        if k + length <= len(strings[i]):
            gone[i][k] += 1
            gone[i][k + length] -= 1
    return [np.cumsum(g)[:-1] > 0 for g in gone]
