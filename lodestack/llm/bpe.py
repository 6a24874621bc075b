"""Pair merging along shared prefixes: the tokens of a prefix tell those of the prefix that is one character longer.

A row of pieces is what merging gives exactly if every two neighbours are, so the last piece of a prefix is the one suffix that
stays apart from the last piece of what remains before it. Words in sorted order walk a trie: the states of the characters that
a word shares with the one before it are kept, the rest is computed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

START = "▁"  # stands before every word


class Pieces:
    def __init__(self, merges: Iterable[tuple[int, str, str]]):
        self.rank = {(a, b): r for r, a, b in sorted(merges, reverse=True)}
        self.pieces = {a + b for a, b in self.rank}
        self.apart: dict[tuple[str, str], bool] = {}
        self.whole = {p for p in self.pieces if self.merged(p) == [p]}
        ends: dict[str, set[int]] = {}
        for p in self.whole:
            ends.setdefault(p[-2:], set()).add(len(p))
        self.sizes = {e: tuple(sorted(x, reverse=True)) for e, x in ends.items()}

    def merged(self, word: str) -> list[str]:
        """The definition: pairs are joined by rank, each from left to right."""
        parts = list(word)
        while len(parts) > 1:
            best = min(zip(parts, parts[1:]), key=lambda x: self.rank.get(x, 1 << 60))
            if best not in self.rank:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == best:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def stay(self, a: str, b: str) -> bool:
        """Whether two pieces stay apart as they are."""
        known = self.apart.get((a, b))
        if known is None:
            if len(self.apart) > 2_000_000:
                self.apart.clear()
            known = self.apart[a, b] = self.merged(a + b) == [a, b]
        return known

    def counts(self, words: Iterable[str]) -> Iterator[int]:
        """Tokens of each word, which come in sorted order; states along the prefix shared with the last word are reused."""
        before, last, n = "", [""], [0]
        sizes, whole, stay = self.sizes, self.whole, self.stay
        for word in words:
            w = START + word
            k, most = 0, min(len(w), len(before))
            while k < most and w[k] == before[k]:
                k += 1
            del last[k + 1 :], n[k + 1 :]
            for i in range(k + 1, len(w) + 1):
                for size in sizes.get(w[max(i - 2, 0) : i], ()):
                    piece = w[i - size : i] if size <= i else ""
                    if piece in whole and (i == size or stay(last[i - size], piece)):
                        last.append(piece)
                        n.append(n[i - size] + 1)
                        break
                else:
                    last.append(w[i - 1])
                    n.append(n[i - 1] + 1)
            before = w
            yield n[-1]
