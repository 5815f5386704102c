"""Adaptive radix tree over byte strings: nodes of four layouts, compressed paths, sums of the keys below every node."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

#: The most children of each layout.
SMALL, MIDDLE, LARGE, FULL = 4, 16, 48, 256


class Children:
    """Children by next byte. Up to 16 lie in byte order, up to 48 behind an index of 256 places, more in 256 places."""

    __slots__ = ("layout", "bytes", "index", "places")

    def __init__(self) -> None:
        self.layout, self.bytes, self.index, self.places = SMALL, bytearray(), None, []

    def get(self, byte: int):
        if self.layout <= MIDDLE:
            at = bisect_left(self.bytes, byte)
            return self.places[at] if at < len(self.bytes) and self.bytes[at] == byte else None
        if self.layout == LARGE:
            at = self.index[byte]
            return self.places[at - 1] if at else None
        return self.places[byte]

    def put(self, byte: int, node: Node) -> None:
        """Sets the child of a byte; a full layout gives way to the next larger one."""
        if self.layout <= MIDDLE:
            at = bisect_left(self.bytes, byte)
            if at < len(self.bytes) and self.bytes[at] == byte:
                self.places[at] = node
                return
            if len(self.bytes) < self.layout:
                self.bytes.insert(at, byte)
                self.places.insert(at, node)
                return
        elif self.layout == FULL or self.index[byte]:
            self.places[byte if self.layout == FULL else self.index[byte] - 1] = node
            return
        elif len(self.places) < LARGE:
            self.places.append(node)
            self.index[byte] = len(self.places)
            return
        self._grow()
        self.put(byte, node)

    def _grow(self) -> None:
        if self.layout == SMALL:
            self.layout = MIDDLE
        elif self.layout == MIDDLE:
            self.layout, self.index = LARGE, bytearray(FULL)
            for at, byte in enumerate(self.bytes):
                self.index[byte] = at + 1
            self.bytes = None
        else:
            places = [self.places[at - 1] if at else None for at in self.index]
            self.layout, self.index, self.places = FULL, None, places

    def __iter__(self) -> Iterator[Node]:
        return (node for node in self.places if node is not None)


class Node:
    """A node with the path from its parent compressed to one span; ``key`` is some key below it, ``end`` the node's depth in bytes."""

    __slots__ = ("key", "end", "values", "children")

    def __init__(self, key: bytes, end: int, values: list | None) -> None:
        self.key, self.end, self.values, self.children = key, end, values, None


def _common(a: bytes, b: bytes, start: int, end: int) -> int:
    """Where the two first differ from ``start`` on, at most ``end``."""
    if a[start:end] == b[start:end]:
        return end
    while end - start > 1:
        middle = (start + end) // 2
        if a[start:middle] == b[start:middle]:
            start = middle
        else:
            end = middle
    return start


class Tree:
    """Keys with a row of values each; ``add`` tells how the values of two keys combine."""

    def __init__(self, add: Sequence) -> None:
        self.root, self.add = Node(b"", 0, None), tuple(add)

    def insert(self, key: bytes, values: Sequence) -> None:
        """Adds a key; a key that is there already takes the new values in."""
        node = self.root
        while True:
            if node.end == len(key):
                node.values = list(values) if node.values is None else [f(a, b) for f, a, b in zip(self.add, node.values, values)]
                return
            children = node.children = node.children or Children()
            child = children.get(key[node.end])
            if child is None:
                children.put(key[node.end], Node(key, len(key), list(values)))
                return
            differ = _common(child.key, key, node.end, min(child.end, len(key)))
            if differ < child.end:  # the path splits within the compressed span
                middle = Node(key, differ, None)
                middle.children = Children()
                middle.children.put(child.key[differ], child)
                children.put(key[node.end], middle)
                child = middle
            node = child

    def spans(self) -> Iterator[tuple[bytes, int, int, list]]:
        """``key, start, end, values`` of every node but the root, values combined over all keys through it.

        All byte depths above ``start`` up to ``end`` lie on the node's compressed path and have the same keys below.
        """
        todo = [(child, 0, False) for child in self.root.children or ()]
        below: dict[int, list] = {}
        while todo:
            node, start, done = todo.pop()
            if not done:
                todo.append((node, start, True))
                todo.extend((child, node.end, False) for child in node.children or ())
                continue
            values = node.values
            for child in node.children or ():
                part = below.pop(id(child))
                values = part if values is None else [f(a, b) for f, a, b in zip(self.add, values, part)]
            below[id(node)] = values
            yield node.key, start, node.end, values
