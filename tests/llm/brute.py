"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import defaultdict

import regex

GAPS = " \t\n\x0b\x0c\r"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, n):
    w = words(text)
    k = min(n, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def jaccard_groups(docs, n, num, den):
    """doc -> (set size, smallest linked doc)."""
    sets = {d: shingles(t, n) for d, t in docs}
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets, key=lambda d: len(sets[d]))
    for i, a in enumerate(ids):
        for b in ids[i + 1 :] if sets[a] else ():
            if len(sets[a]) * den < num * len(sets[b]):
                break
            both = len(sets[a] & sets[b])
            if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), top(d)) for d in sets}


def repeats(docs, length):
    """doc -> (bytes, removed bytes, spans, sha256 of the rest)."""
    first, out = {}, {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            first.setdefault(b[i : i + length], d)
    for d, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        spans = len([1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])])
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def common_blocks(docs, min_words=4):
    """doc -> (text left, removed lines): all runs with a telling line that two documents have, over all pairs."""
    unspaced = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")
    telling = lambda x: len(x.split()) >= min_words or len(unspaced.findall(x)) >= 2 * min_words
    split = {d: [x.strip(GAPS) for x in t.split("\n")] for d, t in docs if t is not None}
    places = {d: defaultdict(list) for d in split}
    for d, own in split.items():
        for k, x in enumerate(own):
            if telling(x):
                places[d][x].append(k)
    gone = defaultdict(set)
    for d, own in split.items():
        for e, other in split.items():
            for x in places[d].keys() & places[e].keys() if e < d else ():
                for j in places[d][x]:
                    for i in places[e][x]:
                        lo = hi = 0
                        while lo <= min(i, j) and own[j - lo] == other[i - lo]:
                            lo += 1
                        while j + hi < len(own) and i + hi < len(other) and own[j + hi] == other[i + hi]:
                            hi += 1
                        gone[d].update(range(j - lo + 1, j + hi))
    return {d: (None, 0) if t is None else ("\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d]), len(gone[d])) for d, t in docs}


ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww](?:[Oo][Rr])?[Dd])|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text):
    """(assign, access, hex, digest of the base spans)."""
    t = text or ""
    found = [("assign", m) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    found += [("access", m) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [("hex", m) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    order = ("assign", "access", "hex")
    spans = sorted((m.start(), order.index(k), m.end()) for k, m in found)
    return (*(sum(k == o for k, _ in found) for o in order), hashlib.sha256(",".join(f"{order[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest())


def statistics(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = defaultdict(list)
    for i in range(len(w) - 4):
        seen[tuple(w[i : i + 5])].append(i)
    repeated = {i + k for places in seen.values() if len(places) > 1 for i in places for k in range(5)}
    lines = [x for x in t.split("\n") if x.strip(GAPS)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeated), len(w) < 10 or 100 * len(repeated) > 20 * len(w)
