"""Plain single-machine versions of the contracts, for comparison."""

from __future__ import annotations

import hashlib
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def quality(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen: dict = {}
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i:i + 5]), []).append(i)
    rep = {p + j for at in seen.values() if len(at) > 1 for p in at for j in range(5)}
    failed = len(w) < 10 or 100 * len(rep) > 20 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(lines) - len(set(lines)), len(rep), failed)


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def components(docs: dict):
    sets = {i: shingles(t) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(docs)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def substrings(docs: dict, length=50):
    first, out = {}, {}
    for i in sorted(docs):
        b = (docs[i] or "").encode()
        for p in range(len(b) - length + 1):
            first.setdefault(b[p:p + length], i)
    for i in sorted(docs):
        b = (docs[i] or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p:p + length]] < i:
                gone[p:p + length] = b"\1" * length
        spans = sum(1 for j in range(len(gone)) if gone[j] and (j == 0 or not gone[j - 1]))
        kept = bytes(x for x, y in zip(b, gone) if not y)
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(re.sub(r"\D", "", s)) <= 19 and luhn(re.sub(r"\D", "", s))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub(r"\D", "", s)) <= 15),
}


def pii(text):
    spans = {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if ok(m.group())]
             for k, (p, ok) in PII.items()}
    flat = [f"{k}:{a}:{b}" for k in PII for a, b in spans[k]]
    return [len(spans[k]) for k in PII], hashlib.sha256(",".join(flat).encode()).hexdigest(), flat


def tiling(doc, item, least):
    """Greedy string tiling by trying every pair of positions."""
    free_d, free_t, out = [True] * len(doc), [True] * len(item), []
    while True:
        best, found = least, []
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while (i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n]
                       and free_t[i + n] and free_d[j + n]):
                    n += 1
                if n > best:
                    best, found = n, [(i, j)]
                elif n == best:
                    found.append((i, j))
        marked = False
        for i, j in found:
            if all(free_t[i:i + best]) and all(free_d[j:j + best]):
                free_t[i:i + best] = [False] * best
                free_d[j:j + best] = [False] * best
                out.append(best)
                marked = True
        if not marked:
            return sum(out)


def _sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _tree(nodes, i):
    """Root over ``nodes`` and the siblings of node ``i`` with their sides."""
    path = []
    while len(nodes) > 1:
        run = nodes[i // 2 * 2:i // 2 * 2 + 2]
        path.append((i % 2, run[1 - i % 2] if len(run) == 2 else ""))
        nodes, i = [_sha(*nodes[k:k + 2]) for k in range(0, len(nodes), 2)], i // 2
    return nodes[0], path


def merkle(rows):
    """Sorted results for rows (doc_id, source, lang, n_chars, text)."""
    def leaf(row):
        return _sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append(row)
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for v in trees.values():
        v.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    roots = [_tree([leaf(r) for r in trees[k]], 0)[0] for k in langs]
    out = []
    for j, k in enumerate(langs):
        root, upper = _tree(roots, j)
        nodes = [leaf(r) for r in trees[k]]
        for i, r in enumerate(trees[k]):
            path = _tree(nodes, i)[1] + upper
            if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                node = leaf((*r[:3], r[3] + 1, r[4]))
            else:
                node = nodes[i]
            for right, other in path:
                node = _sha(other, node) if right else _sha(node, other)
            out.append((r[0], nodes[i], roots[j], root, _sha(*[x for _, x in path]), node, node == root))
    return sorted(out, key=str)


def collocations(docs, least=10, top=2000):
    """Rows for documents (lang, text), counting every phrase of a list."""
    out = []
    pieces = {}
    for lang, text in docs:
        for piece in re.split("[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            pieces.setdefault("und" if lang is None else lang, []).append(
                [w for w in re.split("[\x20\x09]+", piece) if w])
    for lang, lists in pieces.items():
        f = {}
        for w in lists:
            for size in (1, 2, 3):
                for i in range(len(w) - size + 1):
                    f[tuple(w[i:i + size])] = f.get(tuple(w[i:i + size]), 0) + 1
        n = sum(c for p, c in f.items() if len(p) == 1)
        cands = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in cands.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i:i + len(p)] == p for i in range(len(q)))
                   for q, b in cands.items()):
                continue
            score, _, left, right = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]])
                                        for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -score))
    return sorted(out)
