"""Deep-shallow ordering of byte strings with their longest common prefixes."""

from __future__ import annotations

SHALLOW = 32
_SYMBOL = 8


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix: the first bit in which the numbers differ."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return (8 * n - differ.bit_length()) // 8


def shallow_groups(strings: list[bytes], own: list[int], depth: int = 0) -> list[list[int]]:
    """Multikey quicksort: places in order, those alike to ``SHALLOW`` bytes in one group.

    The symbol at a depth is the next eight bytes; strings are split into less, equal and
    greater, and only the equal ones go one symbol deeper.
    """
    out: list[list[int]] = []
    stack = [(own, depth)]
    while stack:
        own, depth = stack.pop()
        if len(own) <= 1 or depth >= SHALLOW:
            if own:
                out.append(own)
            continue
        pivot = strings[own[len(own) // 2]][depth:depth + _SYMBOL]
        less, same, more = [], [], []
        for k in own:
            symbol = strings[k][depth:depth + _SYMBOL]
            (same if symbol == pivot else less if symbol < pivot else more).append(k)
        # strings that end inside this symbol are equal from here on
        stack += [(more, depth), (same, depth + _SYMBOL if len(pivot) == _SYMBOL else SHALLOW), (less, depth)]
    return out


class BlindTrie:
    """Orders strings with a long common prefix by the places where they branch.

    A node is [place, {byte: child}], a leaf a list index; -1 stands for a string's end.
    Going down only looks at branching places; one comparison with the leaf met finds the true
    length in common, and the new branch goes in there.
    """

    def __init__(self, strings: list[bytes], first: int):
        self.strings, self.root = strings, first
        self.equal: dict[int, list[int]] = {first: [first]}

    def _byte(self, k: int, place: int) -> int:
        s = self.strings[k]
        return s[place] if place < len(s) else -1

    def add(self, k: int) -> None:
        node = self.root
        while not isinstance(node, int):
            children = node[1]
            node = children.get(self._byte(k, node[0]))
            if node is None:
                node = next(iter(children.values()))
        a, b = self.strings[k], self.strings[node]
        if a == b:
            self.equal[node].append(k)
            return
        self.equal[k] = [k]
        place = common_prefix(a, b)
        above, node = None, self.root
        while not isinstance(node, int) and node[0] < place:
            above, node = node, node[1][self._byte(k, node[0])]
        if not isinstance(node, int) and node[0] == place:
            node[1][self._byte(k, place)] = k
            return
        fresh = [place, {self._byte(k, place): k, self._byte(any_leaf(node), place): node}]
        if above is None:
            self.root = fresh
        else:
            above[1][self._byte(k, above[0])] = fresh

    def ordered(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, int):
                out += self.equal[node]
            else:
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]
        return out


def any_leaf(node) -> int:
    """Any leaf below a node: all agree before the node's place."""
    while not isinstance(node, int):
        node = next(iter(node[1].values()))
    return node


def order(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Places in the order of the strings, and the common prefix of each with the one before it."""
    placed: list[int] = []
    for group in shallow_groups(strings, list(range(len(strings)))):
        if len(group) == 1:
            placed += group
        else:
            trie = BlindTrie(strings, group[0])
            for k in group[1:]:
                trie.add(k)
            placed += trie.ordered()
    shared = [0] + [common_prefix(strings[a], strings[b]) for a, b in zip(placed, placed[1:])]
    return placed, shared
