"""A compressed radix (Patricia) trie over byte strings that spills subtrees to disk."""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterator

NODE_COST = 250  # bytes of Python objects around a node's label


class Node:
    __slots__ = ("label", "children", "owner", "count", "spill")

    def __init__(self, label: bytes):
        self.label, self.children = label, {}
        self.owner, self.count, self.spill = None, 0, None


def common_length(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] equals b[:low]; a[:high] does not
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class PatriciaTrie:
    """Full byte strings with, at each terminal node, their number and the owner that ``better`` prefers.

    ``better(a, b)`` says that owner ``a`` replaces ``b``.  When the labels outgrow ``budget`` bytes,
    the largest child of the root (or of the only path below it) is written to a file of the task's
    temporary folder and later strings of that subtree are appended to it; ``items`` reads each spilled
    subtree back into a trie of its own, whose paths begin deeper, and deletes its file.
    """

    def __init__(self, better, budget: int, folder: str | None = None):
        self.better, self.budget, self.folder = better, budget, folder
        self.root, self.size, self.spills = Node(b""), 0, 0

    def insert(self, key: bytes, owner, count: int = 1) -> None:
        node, at = self.root, 0
        while True:
            if node.spill is not None:
                pickle.dump((key, owner, count), node.spill)
                return
            if at == len(key):
                break
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:])
                self.size += len(child.label) + NODE_COST
                node, at = child, len(key)
                break
            shared = len(child.label) if key.startswith(child.label, at) else common_length(child.label, key[at : at + len(child.label)])
            if shared < len(child.label):
                fork = Node(child.label[:shared])
                child.label = child.label[shared:]
                fork.children[child.label[0]] = child
                node.children[key[at]] = fork
                self.size += NODE_COST
                child = fork
            node, at = child, at + shared
        if not node.count or self.better(owner, node.owner):
            node.owner = owner
        node.count += count
        if self.size > self.budget:
            self._spill()

    def _walk(self, node: Node, prefix: bytes) -> Iterator[tuple[bytes, object, int]]:
        todo = [(node, prefix + node.label)]
        while todo:
            node, path = todo.pop()
            if node.count:
                yield path, node.owner, node.count
            todo.extend((c, path + c.label) for c in node.children.values() if c.spill is None)

    @staticmethod
    def _weight(node: Node) -> int:
        total, todo = 0, [node]
        while todo:
            x = todo.pop()
            total += len(x.label) + NODE_COST
            todo.extend(x.children.values())
        return total

    def _spill(self) -> None:
        """Write the heaviest subtrees out until half the budget is free."""
        parent, prefix = self.root, b""
        live = [c for c in parent.children.values() if c.spill is None]
        while len(live) == 1 and live[0].children:  # a single path below: its branches are the subtrees
            parent = live[0]
            prefix += parent.label
            live = [c for c in parent.children.values() if c.spill is None]
        if len(live) == 1 and not parent.count and not live[0].children:
            return  # one string: nothing to cut off
        for child in sorted(live, key=self._weight, reverse=True):
            if self.size <= self.budget // 2:
                break
            weight = self._weight(child)
            file = tempfile.TemporaryFile(dir=self.folder)
            nested = [child]
            while nested:  # subtrees below that were spilled before move along
                x = nested.pop()
                if x.spill is not None:
                    for item in self._read(x.spill):
                        pickle.dump(item, file)
                nested.extend(x.children.values())
            for item in self._walk(child, prefix):
                pickle.dump(item, file)
            child.children, child.count, child.owner, child.spill = {}, 0, None, file
            child.label = child.label[:1]
            self.size -= weight - NODE_COST
            self.spills += 1

    @staticmethod
    def _read(file) -> Iterator[tuple[bytes, object, int]]:
        file.seek(0)
        while True:
            try:
                yield pickle.load(file)
            except EOFError:
                file.close()
                return

    def items(self) -> Iterator[tuple[bytes, object, int]]:
        """Every string once, with its owner and count; the trie is used up."""
        yield from self._walk(self.root, b"")
        files, todo = [], [self.root]
        while todo:
            x = todo.pop()
            if x.spill is not None:
                files.append(x.spill)
            todo.extend(x.children.values())
        self.root, self.size = Node(b""), 0
        for file in files:
            below = PatriciaTrie(self.better, self.budget, self.folder)  # cuts deeper, whatever the file's size
            for item in self._read(file):
                below.insert(*item)
            yield from below.items()
