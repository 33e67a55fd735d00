"""Deep-shallow sorting of byte strings inside buckets.

The strings of all buckets of a batch are partitioned together by multikey quicksort
on 8-byte words down to a shallow depth. Strings that still tie share a long prefix;
each such group is ordered by a blind trie, whose nodes hold only a depth and the
branching bytes, so that an insertion compares whole strings once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Words of 8 bytes that the quicksort looks at.
SHALLOW_WORDS = 6


def common_prefix(a: bytes, b: bytes) -> int:
    hi = min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    lo = 0  # a[:lo] == b[:lo], a[:hi] != b[:hi]
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class _Node:
    __slots__ = ("depth", "children")

    def __init__(self, depth: int, children: dict):
        self.depth, self.children = depth, children


def blind_trie_order(strings: Sequence[bytes], members: Sequence[int]) -> list[int]:
    """``members`` (indices of ``strings``) in ascending order of their strings; equal
    strings keep the order they came in. A string that ends sorts before its extensions."""
    at = lambda s, d: s[d] if d < len(s) else -1
    root: _Node | list[int] = [members[0]]
    for m in members[1:]:
        s, node = strings[m], root
        while isinstance(node, _Node):  # blindly to some leaf
            node = node.children.get(at(s, node.depth)) or next(iter(node.children.values()))
        old = strings[node[0]]
        k = common_prefix(s, old)
        if k == len(s) == len(old):
            node.append(m)
            continue
        parent, node = None, root
        while isinstance(node, _Node) and node.depth < k:
            parent, node = node, node.children[at(s, node.depth)]
        if isinstance(node, _Node) and node.depth == k:
            node.children[at(s, k)] = [m]
            continue
        made = _Node(k, {at(old, k): node, at(s, k): [m]})
        if parent is None:
            root = made
        else:
            parent.children[at(s, parent.depth)] = made
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, _Node):
            stack += [node.children[c] for c in sorted(node.children, reverse=True)]
        else:
            out += node
    return out


def deep_shallow_sort(strings: Sequence[bytes], bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``order`` of the strings by (bucket, string), and the common prefix length of each
    string with the one before it in that order (0 at the start of a bucket)."""
    n = len(strings)
    lengths = np.fromiter(map(len, strings), np.int64, n)
    width = max(8 * SHALLOW_WORDS, -(-int(lengths.max(initial=1)) // 8) * 8)
    flat = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(n, width)
    words = flat[:, :8 * SHALLOW_WORDS].copy().view(">u8").astype(np.uint64)
    order = np.argsort(bucket, kind="stable")
    new = np.r_[True, bucket[order][1:] != bucket[order][:-1]]
    for d in range(SHALLOW_WORDS):
        group = np.cumsum(new)
        tied = np.bincount(group)[group] > 1
        if not tied.any():
            break
        sub = order[tied]
        order[tied] = sub[np.lexsort((words[sub, d], group[tied]))]
        w = words[order, d]
        new[1:] |= w[1:] != w[:-1]
    group = np.cumsum(new) - 1
    starts = np.nonzero(new)[0]
    for g in np.nonzero(np.bincount(group) > 1)[0]:
        s = starts[g]
        e = starts[g + 1] if g + 1 < len(starts) else n
        order[s:e] = blind_trie_order(strings, order[s:e].tolist())
    lcp = np.zeros(n, np.int64)
    for s in range(1, n, 4096):
        a, b = order[s - 1:min(n, s + 4096) - 1], order[s:s + 4096]
        same = flat[a] == flat[b]
        first = np.where(same.all(1), width, same.argmin(1))
        lcp[s:s + 4096] = np.minimum(first, np.minimum(lengths[a], lengths[b]))
    lcp[1:][bucket[order][1:] != bucket[order][:-1]] = 0
    return order, lcp
