"""A treap of (key, item) pairs with smallest-not-below search."""

from __future__ import annotations

import random


class _Node:
    __slots__ = ("entry", "left", "priority", "right")

    def __init__(self, entry, priority):
        self.entry, self.priority = entry, priority
        self.left = self.right = None


class BalancedTree:
    """Ordered set with expected logarithmic insert, remove and ceiling."""

    def __init__(self, seed: int = 7):
        self._root, self._random = None, random.Random(seed)

    def _split(self, node, entry):
        """Nodes below ``entry`` and the others."""
        if node is None:
            return None, None
        if node.entry < entry:
            node.right, right = self._split(node.right, entry)
            return node, right
        left, node.left = self._split(node.left, entry)
        return left, node

    def _merge(self, left, right):
        if left is None or right is None:
            return left or right
        if left.priority > right.priority:
            left.right = self._merge(left.right, right)
            return left
        right.left = self._merge(left, right.left)
        return right

    def add(self, entry) -> None:
        left, right = self._split(self._root, entry)
        self._root = self._merge(self._merge(left, _Node(entry, self._random.random())), right)

    def ceiling(self, entry):
        """The smallest entry not below ``entry``, or None."""
        node, best = self._root, None
        while node is not None:
            if node.entry < entry:
                node = node.right
            else:
                best, node = node.entry, node.left
        return best

    def remove(self, entry) -> None:
        def drop(node):
            if node.entry == entry:
                return self._merge(node.left, node.right)
            if entry < node.entry:
                node.left = drop(node.left)
            else:
                node.right = drop(node.right)
            return node

        self._root = drop(self._root)
