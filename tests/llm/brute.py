"""Plain loops that say what the operators must return."""

from __future__ import annotations

import re


def ascii_lower(t: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def shingle_set(t: str | None, k: int = 5) -> set:
    w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(t or ""))
    if not w:
        return set()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} or {tuple(w)}


def jaccard_components(rows: list[tuple[int, str]], share: int = 75) -> dict[int, tuple[int, int]]:
    """doc_id -> (n_shingles, component_id), from all pairs that share a shingle."""
    sets = {i: shingle_set(t) for i, t in rows}
    where: dict = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    done = set()
    for ids in where.values():
        for a in range(len(ids)):
            for b in range(a):
                p = (ids[b], ids[a])
                if p not in done:
                    done.add(p)
                    n = len(sets[p[0]] & sets[p[1]])
                    if 100 * n >= share * len(sets[p[0]] | sets[p[1]]):
                        x, y = sorted((find(p[0]), find(p[1])))
                        top[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}
