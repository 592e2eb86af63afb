"""Plain versions of what the operators return, for small inputs."""

import hashlib
import re

LOWER = {k: k + 32 for k in range(65, 91)}
SPACE, ASCII = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def shingles(text, size):
    w = SPACE.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def near_classes(rows, size, percent):
    """rows: (id, text) -> {id: smallest id reachable}."""
    sets = [(i, shingles(t, size)) for i, t in rows if i is not None]
    up = {i: i for i, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return {i: root(i) for i in up}


def removed(rows, size):
    """rows: (id, text) -> list of (id, n_words, n_removed, sha256 of what is kept), in the order of rows."""
    first = {}
    for i, t in rows:
        w = SPACE.findall(t or "")
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            if i is not None and (key not in first or i < first[key]):
                first[key] = i
    out = []
    for i, t in rows:
        w = SPACE.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if i is not None and first[tuple(w[k : k + size])] < i:
                gone[k : k + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def contaminated(rows, items, size, share):
    windows = {}
    for i, t in items:
        w = ASCII.findall((t or "").translate(LOWER))
        if i is not None and w:
            for k in range(max(len(w) - size, 0) + 1):
                windows.setdefault(tuple(w[k : k + size]), set()).add(str(i))
    out = []
    for i, t in rows:
        w = ASCII.findall((t or "").translate(LOWER))
        hit, found = [0] * len(w), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    found |= own
                    hit[k : k + n] = [1] * n
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(w), sum(hit), len(found), digest, sum(hit) > 0 and share * sum(hit) >= len(w)))
    return out


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def pii(text):
    out = []
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def page_rank(edges, seeds, damping, rounds):
    """edges: {(source, target): weight}; seeds: {node: score} -> {node: score} after ``rounds``."""
    score = dict(seeds)
    total = {}
    for (s, _), w in edges.items():
        total[s] = total.get(s, 0) + w
    for _ in range(rounds):
        new = {n: (1 - damping) * v for n, v in seeds.items()}
        for (s, t), w in edges.items():
            if s in score:
                new[t] = new.get(t, 0) + damping * score[s] * w / total[s]
        score = new
    return score
