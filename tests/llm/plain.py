"""Brute-force versions of the operators, written for clearness alone."""

import hashlib
import re

import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ANY_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def secrets(text):
    text = text or ""
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("(password|passwd|secret|token|api_?key)", "(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) + q for w, q in (("password", ""), ("passwd", ""), ("secret", ""), ("token", ""))) + "|[aA][pP][iI]_?[kK][eE][yY])"), text):
        if len(m[2]) >= 8:
            found.append((m.start(), 0, "assign", m.end()))
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    found.sort()
    n = [sum(f[1] == k for f in found) for k in range(3)]
    spans = ",".join(f"{kind}:{s}:{e}" for s, _, kind, e in found)
    return *n, sha(spans), spans


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def licences(text):
    words = ALNUM_WORD.findall((text or "").translate(LOWER))
    at = []
    for phrase, label in PHRASES.items():
        own = phrase.split()
        at += [(k, label) for k in range(len(words)) if words[k : k + len(own)] == own]
    where = [k for k, _ in at]
    return len(words), len(at), min(where, default=None), max(where, default=None), ",".join(sorted({x for _, x in at}))


def rules(text):
    text = text or ""
    words = ANY_WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if ANY_WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = {}
    for k in range(len(words) - 4):
        windows.setdefault(tuple(words[k : k + 5]), []).append(k)
    repeated = {k + j for at in windows.values() if len(at) > 1 for k in at for j in range(5)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated), n < 10 or 100 * len(repeated) > 20 * n


def contamination(text, items):
    words = ALNUM_WORD.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item, passage in items:
        own = ALNUM_WORD.findall((passage or "").translate(LOWER))
        size = min(13, len(own))
        windows = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)} if own else set()
        for k in range(len(words) - size + 1):
            if tuple(words[k : k + size]) in windows:
                hit |= set(range(k, k + size))
                if item is not None:  # hits words, but has no name
                    found.add(str(item))
    return len(words), len(hit), len(found), sha(",".join(sorted(found))), len(hit) > 0 and 20 * len(hit) >= len(words)


def fingerprint(text):
    words = ANY_WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints, most=4):
    """{doc_id: smallest reachable} of [(doc_id, fingerprint)]."""
    root = {i: i for i, _ in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, x) in enumerate(prints):
        for j, y in prints[:a]:
            if (x ^ y).bit_count() <= most:
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: find(i) for i, _ in prints}


def repeats(docs, size=50):
    """[(doc_id, n_bytes, n_removed, n_spans, kept_sha256)] of [(doc_id, text)]."""
    texts = [(i, (t or "").encode()) for i, t in docs]
    first = {}
    for i, b in texts:
        for k in range(len(b) - size + 1):
            w = b[k : k + size]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - size + 1):
            if first[b[k : k + size]] < i:
                gone[k : k + size] = b"\1" * size
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((i, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out
