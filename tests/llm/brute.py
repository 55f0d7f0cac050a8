"""Plain versions of the operators, one row after another, to hold the distributed ones against."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import xxhash


class Union:
    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def drop_lines(rows: list[tuple], ratio: float = 0.1) -> list[tuple]:
    """(key, text, dropped) of (key, host, text) rows."""
    pages = Counter(h for _, h, _ in rows if h is not None)
    seen: Counter = Counter()
    for _, h, t in rows:
        if h is not None and t is not None:
            seen.update({(h, x) for x in t.split("\n") if x.strip(" \t\r")})
    bad = {k for k, n in seen.items() if n > 1 and n > ratio * pages[k[0]]}
    out = []
    for k, h, t in rows:
        lines = None if t is None else t.split("\n")
        kept = None if t is None else [x for x in lines if (h, x) not in bad]
        out.append((k, None if t is None else "\n".join(kept), 0 if t is None else len(lines) - len(kept)))
    return out


def simhash(text: str | None) -> int:
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_duplicates(rows: list[tuple], budget: int = 3) -> set[tuple]:
    """(doc_id, fingerprint, component_id) of (doc_id, text) rows."""
    prints = [(k, simhash(t)) for k, t in rows]
    u = Union()
    for i, (_, a) in enumerate(prints):
        for _, b in prints[: i + 1]:
            if (a ^ b).bit_count() <= budget:
                u.join(a, b)
    first: dict = {}
    for k, f in prints:
        first[u.root(f)] = min(k, first.get(u.root(f), k))
    return {(k, f"{f:016x}", first[u.root(f)]) for k, f in prints}


def removed(rows: list[tuple], size: int = 200) -> list[tuple]:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of (doc_id, text) rows."""
    data = [(k, (t or "").encode()) for k, t in rows]
    count = Counter(b[i : i + size] for _, b in data for i in range(len(b) - size + 1))
    out = []
    for k, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if count[b[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((k, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def word_edits(item: list, words: list) -> int:
    """The least number of word edits between item and any stretch of words."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for w in words:
        new = [0]
        for j, x in enumerate(item):
            new.append(min(row[j] + (x != w), row[j + 1] + 1, new[j] + 1))
        row = new
        best = min(best, row[-1])
    return best


def urls(rows: list[tuple], rules: list[tuple], edges: list[tuple]) -> list[tuple]:
    """(id, host, path, rule, verdict) of (id, url) rows; edges: pairs of URLs."""

    def cut(url):
        if url is None or "://" not in url:
            return "", "", None
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        low = re.sub("[A-Z]+", lambda m: m[0].lower(), host)
        return low, re.match(r"[^?#]*", rest[len(host) :])[0], low + (re.match(r"[^#]*", rest[len(host) :])[0] or "/")

    def judge(host, path):
        fits = []
        for says, rule in rules:
            own, _, tail = rule.partition("/")
            if (host == own or host.endswith("." + own)) and path.startswith("/" + tail):
                fits.append((-len(rule), says != "allow", rule, says))
        return (min(fits)[2], min(fits)[3]) if fits else (None, None)

    u = Union()
    for a, b in edges:
        if cut(a)[2] and cut(b)[2]:
            u.join(cut(a)[2], cut(b)[2])
    said = defaultdict(set)
    for node in list(u.up):
        host, path, _ = cut("x://" + node)
        said[u.root(node)].add(judge(host, path)[1])
    out = []
    for k, url in rows:
        host, path, node = cut(url)
        rule, verdict = judge(host, path)
        if verdict is None:
            others = said[u.root(node)] if node in u.up else set()
            verdict = "block" if "block" in others and "allow" not in others else "allow"
        out.append((k, host, path, rule, verdict))
    return out
