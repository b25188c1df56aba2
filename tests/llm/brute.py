"""Plain Python versions of the operators, for small inputs."""

import re
import zlib

UP = {c: c + 32 for c in range(65, 91)}


def lower(text):
    return (text or "").translate(UP)


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if len(w) >= n:
        return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}
    return {tuple(w)} if w else set()


def near(rows, percent=85):
    """[(doc_id, n_shingles, component_id)] in the order of rows (doc_id, text)."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    seen = set()
    for i, s in enumerate(sets):
        for j in {j for x in s for j in by[x] if j < i}:
            if (i, j) in seen:
                continue
            seen.add((i, j))
            common = len(s & sets[j])
            if 100 * common >= percent * (len(s) + len(sets[j]) - common):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return [(d, len(sets[i]), least.get(find(i), d)) for i, (d, _) in enumerate(rows)]


def repeats(rows, n=100):
    """{row number: (n_bytes, removed mask)} of rows (doc_id, text): bytes covered by a string of n bytes that also starts earlier."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0], i))
    seen, out = set(), {}
    for i in order:
        b = (rows[i][1] or "").encode()
        mask = bytearray(len(b))
        for s in range(len(b) - n + 1):
            x = b[s:s + n]
            if x in seen:
                mask[s:s + n] = b"\x01" * n
            else:
                seen.add(x)
        out[i] = (b, mask)
    return out


def held_out(doc_id, k, r):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % k == r
