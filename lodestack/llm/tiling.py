"""Greedy string tiling of two rows of words, with running Karp-Rabin hashes, and what counts as a passage among the tiles."""

from __future__ import annotations

import re

#: A word, with the parts of an identifier as one; punctuation, layout and markup are no words.
WORD = re.compile(r"[぀-ヿ一-鿿]|[^\W_]+(?:[-_'’]+[^\W_]+)*")
JOINTS = re.compile(r"[-_'’]+")
BASE, MODULUS = 1_000_003, (1 << 61) - 1


def words(text: str) -> list[str]:
    """Words in one spelling: case and the joints of identifiers don't count."""
    return [JOINTS.sub("", w).lower() for w in WORD.findall(text)]


def hashes(ids: list[int], n: int) -> list[int]:
    """Karp-Rabin hash of every run of n."""
    if len(ids) < n:
        return []
    top, h, out = pow(BASE, n - 1, MODULUS), 0, []
    for i, x in enumerate(ids):
        if i >= n:
            h = (h - ids[i - n] * top) % MODULUS
        h = (h * BASE + x) % MODULUS
        if i >= n - 1:
            out.append(h)
    return out


def tiles(pattern: list[str], text: list[str], least: int, start: int = 24) -> list[tuple[int, int, int]]:
    """(place in pattern, place in text, length) of matches that don't overlap, the longest marked first, each at least ``least``."""
    ids: dict[str, int] = {}
    a = [ids.setdefault(w, len(ids) + 1) for w in pattern]
    b = [ids.setdefault(w, len(ids) + 1) for w in text]
    used_a, used_b, out = [False] * len(a), [False] * len(b), []
    size = max(least, min(start, len(a)))
    while True:
        table: dict[int, list[int]] = {}
        for i, h in enumerate(hashes(a, size)):
            if not any(used_a[i : i + size]):
                table.setdefault(h, []).append(i)
        found, longest = [], 0
        for j, h in enumerate(hashes(b, size)):
            for i in table.get(h, ()):
                if any(used_b[j : j + size]) or a[i : i + size] != b[j : j + size]:
                    continue
                n = size
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not used_a[i + n] and not used_b[j + n]:
                    n += 1
                found.append((n, i, j))
                longest = max(longest, n)
        if longest > 2 * size:
            size = longest
            continue
        for n, i, j in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
            if not any(used_a[i : i + n]) and not any(used_b[j : j + n]):
                used_a[i : i + n] = [True] * n
                used_b[j : j + n] = [True] * n
                out.append((i, j, n))
        if size == least:
            return sorted(out)
        size = max(least, size // 2 if size > 2 * least else least)


def holds(pattern: list[str], text: list[str], n: int) -> bool:
    """Whether a run of n words of the pattern stands in the text as it is."""
    runs = {tuple(pattern[i : i + n]) for i in range(len(pattern) - n + 1)}
    return any(tuple(text[j : j + n]) in runs for j in range(len(text) - n + 1))


def standing(item: int, marked: list[bool], least: int = 6) -> list[bool]:
    """The words of an item that stand in runs of ``least`` or more words without any of its own: instructions that items share."""
    out, k = [False] * item, 0
    while k < item:
        end = k
        while end < item and not marked[end]:
            end += 1
        if end - k >= least:
            out[k:end] = [True] * (end - k)
        k = max(end, k + 1)
    return out


def passage(found: list[tuple[int, int, int]], own: list[int], item: int, seed: int, slip: int = 2, rare: float = 0.5) -> tuple[int, float]:
    """(words of the longest passage, share of the item's own words that tiles cover).

    ``own``: where in the item's ``item`` words its own seeds, of ``seed`` words, begin. Neighbouring tiles make one passage if no
    more than ``slip`` words were replaced or put in between. A passage counts the item's words from its first to its last, replaced
    ones too, but no standing instruction; and ``rare`` of its words must lie in own seeds that stand whole in tiles, as phrases
    that items share with other texts do not.
    """
    marked, told, starts = [False] * item, [False] * item, set(own)
    for p in own:
        marked[p : p + seed] = [True] * min(seed, item - p)
    for i, _, n in found:
        for p in range(i, i + n - seed + 1):
            if p in starts:
                told[p : p + seed] = [True] * seed
    skip = standing(item, marked)
    told_upto, kept_upto = [0], [0]
    for t, x in zip(told, skip):
        told_upto.append(told_upto[-1] + t)
        kept_upto.append(kept_upto[-1] + (not x))
    total = sum(marked)
    share = sum(told) / total if total else 0.0
    best = 0
    for k, (i, j, n) in enumerate(found):
        end_i, end_j = i + n, j + n
        for x, y, m in found[k + 1 :]:
            if x - end_i > slip:
                break
            if 0 <= y - end_j <= slip and x >= end_i:
                end_i, end_j = x + m, y + m
        length = kept_upto[end_i] - kept_upto[i]
        if told_upto[end_i] - told_upto[i] >= rare * length:
            best = max(best, length)
    return best, share
