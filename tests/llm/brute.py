"""Plain versions of the operators' results, row by row or pair by pair."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def ids_bytes(ids) -> bytes:
    return np.array(ids, "<u4").tobytes()


def exact_groups(rows):
    """(doc_id, keep_id, group_size, kept, sha) per row, sorted."""
    groups = defaultdict(list)
    for n, (i, t) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append((i is None, i or 0, n, i))
    out = []
    for text, members in groups.items():
        first = min(members)
        out += [(i, first[3], len(members), n == first[2], sha(text.encode())) for _, _, n, i in members]
    return sorted(out, key=str)


def shingles(text, size=2):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return set()
    return set(zip(*(words[k:] for k in range(size)))) if len(words) >= size else {tuple(words)}


def near_components(rows, size=2, percent=80):
    """doc_id -> (n_shingles, component) for distinct ids."""
    sets = {i: shingles(t, size) for i, t in rows}
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(sets[i]), find(i)) for i in ids}


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_secrets(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    seen = Counter(grams)
    covered = {j for i, g in enumerate(grams) if seen[g] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def pieces(ids, capacity):
    return [(k // capacity, k, len(ids[k:k + capacity]), zlib.crc32(ids_bytes(ids[k:k + capacity]))) for k in range(0, len(ids), capacity)]


def url_verdicts(rows, rules, damping, tolerance, distrust, link):
    """page_id -> (host, path, rule, verdict)."""
    def parse(u):
        if u is None or "://" not in u:
            return "", ""
        m = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1], re.S)
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]

    pages = []
    for i, u, html in rows:
        host, path = parse(u)
        fits = [(len(r), r, v) for v, r in rules for own, _, start in [r.partition("/")]
                if (host == own or host.endswith("." + own)) and path.startswith("/" + start)]
        best = max(fits, key=lambda x: x[0], default=None)
        pages.append((i, host, path, best, html))
    edges, seeds = Counter(), defaultdict(lambda: [0, 0])
    for _, host, _, best, html in pages:
        if host:
            for other in {parse("http:" + u if u.startswith("//") else u)[0] for u in re.findall(link, html or "")}:
                if other and other != host:
                    edges[host, other] += 1
            if best:
                seeds[host][best[2] == "block"] += 1
    parents = set()
    for host in {p[1] for p in pages if p[1]}:
        labels = host.split(".")
        while len(labels) >= 3:
            parents.add((".".join(labels), ".".join(labels[1:])))
            labels = labels[1:]
    for a, b in parents:
        edges[a, b] += 1
        edges[b, a] += 1
    score = []
    for kind in (0, 1):
        turned = {((a, b) if kind == 0 else (b, a)): w for (a, b), w in edges.items()}
        total = Counter()
        for (a, _), w in turned.items():
            total[a] += w
        base = {h: (1 - damping) * n[kind] / sum(n) for h, n in seeds.items()}
        rank = dict(base)
        for _ in range(math.ceil(math.log(tolerance) / math.log(damping))):
            new = defaultdict(float, base)
            for (a, b), w in turned.items():
                new[b] += damping * rank.get(a, 0) * w / total[a]
            rank = new
        score.append(rank)
    out = {}
    for i, host, path, best, _ in pages:
        t, d = score[0].get(host, 0), score[1].get(host, 0)
        method = "block" if not host or (d >= distrust and d > t) else "allow"
        out[i] = (host, path, best and best[1], best[2] if best else method)
    return out
