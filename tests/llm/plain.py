"""Plain Python versions of what the operators compute."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter

import regex
import xxhash

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Groups:
    """Union of nodes; the smallest node names a group."""

    def __init__(self):
        self.up = {}

    def find(self, a):
        self.up.setdefault(a, a)
        while self.up[a] != a:
            a = self.up[a]
        return a

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def majority(hashes):
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash(text, words=4, seed=42):
    found = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not found:
        return 0
    shingles = [" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    return majority([xxhash.xxh64_intdigest(s.encode(), seed) for s in shingles])


def simhash_components(rows, distance=4):
    """Component per row of (id, text) without null ids."""
    fps = [simhash(t) for _, t in rows]
    groups = Groups()
    for i, a in enumerate(fps):
        for j in range(i + 1):
            if (a ^ fps[j]).bit_count() <= distance:
                groups.join(rows[i][0], rows[j][0])
    return [groups.find(i) for i, _ in rows]


def removed(texts, length):
    """Per text of bytes: flags of the bytes covered by a string that starts twice or more."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        flags = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                flags[i : i + length] = [True] * length
        out.append(flags)
    return out


def removal(texts, length):
    """Per text: bytes, removed bytes, spans, digest of the rest."""
    out = []
    for t, flags in zip(texts, removed(texts, length), strict=True):
        spans = sum(f and not (i and flags[i - 1]) for i, f in enumerate(flags))
        rest = bytes(b for b, f in zip(t, flags, strict=True) if not f)
        out.append((len(t), sum(flags), spans, hashlib.sha256(rest).hexdigest()))
    return out


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def personal(text):
    """Spans of the fixed patterns, as they are written."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def quality_counts(text):
    text = text or ""
    found = WORD.findall(text)
    windows = Counter(zip(found, found[1:], found[2:], strict=False))
    again = {i + k for i in range(len(found) - 2) if windows[tuple(found[i : i + 3])] > 1 for k in range(3)}
    seen, lines = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    return (len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(again))


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


#: Lines of white space and separators alone.
BLANK = regex.compile(r"[\s\p{Z}]*")


def normal_words(line):
    return "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in line.lower()).split()


def line_units(line):
    """What copies are equal in, and what near copies are counted in (with its kind), or None."""
    words = normal_words(line)
    joined = " ".join(words)
    if len(words) >= 5:
        return joined, ("words", words)
    return joined if words else line, ("characters", list(joined)) if len(joined) >= 20 else None


def near_copies(x, y, similarity):
    most = int((1 - similarity) * max(len(x), len(y)) + 1e-6)
    # what the longer has beyond the other, order aside, takes an edit each
    if max(len(x), len(y)) - (Counter(x) & Counter(y)).total() > most:
        return False
    return edit_distance(x, y) <= most


def dropped_lines(rows, similarity=0.8):
    """Per (id, text) with distinct ids: places of the dropped lines, by edit similarity of all pairs."""
    lines = sorted((i, k, *line_units(x)) for i, t in rows for k, x in enumerate((t or "").split("\n")) if not BLANK.fullmatch(x))
    groups, first = Groups(), {}
    for a, (_, _, normal, _) in enumerate(lines):
        groups.find(a)
        groups.join(a, first.setdefault(normal, a))
    by_size = sorted((len(lines[a][3][1]), a) for a in first.values() if lines[a][3])
    for n, (size, a) in enumerate(by_size):
        kind, x = lines[a][3]
        for smaller, b in reversed(by_size[:n]):
            if smaller < similarity * size - 1e-6:
                break
            if lines[b][3][0] == kind and groups.find(a) != groups.find(b) and near_copies(x, lines[b][3][1], similarity):
                groups.join(a, b)
    kept = {}
    for a in range(len(lines)):
        kept.setdefault(groups.find(a), a)
    out = {i: set() for i, _ in rows}
    for a, (i, k, *_) in enumerate(lines):
        if kept[groups.find(a)] != a:
            out[i].add(k)
    return out
