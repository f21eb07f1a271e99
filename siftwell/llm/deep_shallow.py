"""Deep-shallow sorting of strings inside one task, with the common prefixes of neighbours.

The strings of a task are sorted by multikey quicksort, eight bytes to a character, down to a shallow depth:
all classes of strings that are equal so far are divided by a pivot at the same time, and only the middle
part goes on to the next character. Classes that are still together at the shallow depth have long common
prefixes; a blind trie orders each of them, comparing every string with one other only.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 64  # bytes, a multiple of eight


def byte_matrix(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The strings as rows of ``width`` bytes, filled up with zeros, and their lengths."""
    rows = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), dtype=np.uint8).reshape(len(strings), width)
    return rows, np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))


def multikey_order(rows: np.ndarray, classes: np.ndarray, start: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers by class and by the bytes from ``start`` to ``depth``, and the class of each place that is then left."""
    chars = np.ascontiguousarray(rows[:, start:depth]).view(">u8").astype(np.uint64)
    order = np.argsort(classes, kind="stable")
    label = np.cumsum(np.concatenate([[0], (np.diff(classes[order]) != 0).astype(np.int64)])) if len(order) else order
    place = np.zeros(len(order), dtype=np.int64)  # the character that a place is at
    while True:
        size = np.bincount(label, minlength=1)
        open_ = np.flatnonzero((size[label] > 1) & (place < chars.shape[1]))
        if not len(open_):
            return order, label
        first = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]]))
        char = chars[order[open_], place[open_]]
        pivot_place = first[label[open_]] + size[label[open_]] // 2
        pivot = chars[order[pivot_place], place[pivot_place]]
        side = (char > pivot).astype(np.int64) - (char < pivot) + 1
        by = np.argsort(label[open_] * 3 + side, kind="stable")
        order[open_], place[open_] = order[open_][by], (place[open_] + (side == 1))[by]
        part = label * 3
        part[open_] += side[by]
        label = np.cumsum(np.concatenate([[0], (part[1:] != part[:-1]).astype(np.int64)]))


def _common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of two strings that agree up to ``at``."""
    low, high = at, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def blind_trie_order(strings: list[bytes], depth: int) -> list[int]:
    """Numbers of the strings in order; all are known to agree up to ``depth``.

    A node is ``[depth, {byte: child}]`` and a leaf a list of the numbers of equal strings; a string that
    ends at a node's depth hangs under -1.
    """

    def inner(node: list) -> bool:
        return len(node) == 2 and isinstance(node[1], dict)

    root: list | None = None
    for k, s in enumerate(strings):
        if root is None:
            root = [k]
            continue
        node = root
        while inner(node):
            kids = node[1]
            node = kids.get(s[node[0]] if node[0] < len(s) else -1) or next(iter(kids.values()))
        other = strings[node[0]]
        same = _common(s, other, min(depth, len(s), len(other)))
        if same == len(s) == len(other):
            node.append(k)
            continue
        parent, edge, node = None, None, root
        while inner(node) and node[0] < same:
            parent, edge = node, s[node[0]] if node[0] < len(s) else -1
            node = node[1][edge]
        own = s[same] if same < len(s) else -1
        if inner(node) and node[0] == same:
            node[1][own] = [k]
            continue
        branch = [same, {other[same] if same < len(other) else -1: node, own: [k]}]
        if parent is None:
            root = branch
        else:
            parent[1][edge] = branch
    out: list[int] = []
    waiting = [root] if root is not None else []
    while waiting:
        node = waiting.pop()
        if inner(node):
            waiting += [node[1][c] for c in sorted(node[1], reverse=True)]
        else:
            out += node
    return out


def deep_shallow(strings: list[bytes], classes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings within their classes, and the common prefix of each with the one before it.

    The first of a class has -1 there. ``width`` is the longest length there may be, a multiple of eight.
    """
    if not strings:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    rows, lengths = byte_matrix(strings, width)
    order, label = multikey_order(rows, classes, 0, min(SHALLOW, width))
    size = np.bincount(label)
    ends = np.cumsum(size)
    for c in np.flatnonzero(size > 1).tolist():
        members = order[ends[c] - size[c]:ends[c]].copy()
        order[ends[c] - size[c]:ends[c]] = members[blind_trie_order([strings[k] for k in members.tolist()], 0)]
    a, b = order[1:], order[:-1]
    common = np.empty(len(a), dtype=np.int64)
    for at in range(0, len(a), 1 << 16):
        x, y = a[at:at + (1 << 16)], b[at:at + (1 << 16)]
        unequal = rows[x] != rows[y]
        common[at:at + (1 << 16)] = np.where(unequal.any(axis=1), unequal.argmax(axis=1), width)
    common = np.minimum(common, np.minimum(lengths[a], lengths[b]))
    return order, np.concatenate([[-1], np.where(classes[a] == classes[b], common, -1)])
