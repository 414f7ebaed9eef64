"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import re


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def shingles(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    if not words:
        return frozenset()
    if len(words) < size:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def least_reachable(n, links, names):
    """The least name in each one's component."""
    at = list(range(n))

    def root(i):
        while at[i] != i:
            at[i] = at[at[i]]
            i = at[i]
        return i

    for a, b in links:
        at[root(a)] = root(b)
    least = {}
    for i in range(n):
        least[root(i)] = min(names[i], least.get(root(i), names[i]))
    return [least[root(i)] for i in range(n)]


def jaccard_components(rows, size=3, similarity=90):
    """{doc_id: (n_shingles, component)} by comparing all documents that share a shingle."""
    sets = [shingles(t, size) for _, t in rows]
    places = {}
    links = []
    for i, s in enumerate(sets):
        seen = {}
        for x in s:
            for j in places.setdefault(x, []):
                seen[j] = seen.get(j, 0) + 1
            places[x].append(i)
        links += [(i, j) for j, c in seen.items() if 100 * c >= similarity * (len(s) + len(sets[j]) - c)]
    comp = least_reachable(len(rows), links, [d for d, _ in rows])
    return {d: (len(s), c) for (d, _), s, c in zip(rows, sets, comp)}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def deduped_lines(rows, edits=2, shortest=20):
    """{doc_id: (n_lines, exact, near, text)}; ids are different."""
    first = {}
    for d, t in sorted(rows):
        for no, line in enumerate((t or "").split("\n")):
            if len(line) >= shortest:
                first.setdefault(line, (d, no))
    lines = sorted(first, key=len)
    late = set()
    for i, a in enumerate(lines):
        for b in lines[i + 1 :]:
            if len(b) - len(a) > edits:
                break
            # with this few edits, a third of the line stays in its place up to the edits
            if distance(a, b) <= edits:
                late.add(max(a, b, key=first.get))
    out = {}
    for d, t in rows:
        if t is None:
            out[d] = (0, 0, 0, None)
            continue
        kept, exact, near = [], 0, 0
        for no, line in enumerate(t.split("\n")):
            if line in late:
                near += 1
            elif line in first and first[line] != (d, no):
                exact += 1
            else:
                kept.append(line)
        out[d] = (len(t.split("\n")), exact, near, "\n".join(kept))
    return out
