"""Plain-Python readings of the operators' definitions, for small inputs."""

import hashlib
import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return (text or "").translate(LOWER)


def fingerprint(text, size=4):
    w = words(lower(text))
    if not w:
        return 0
    grams = [" ".join(w[i:i + size]) for i in range(max(1, len(w) - size + 1))]
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def component_of(fps, radius=4):
    """For a list of fingerprints, the index of the first member of each one's component."""
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(fps))]


def stats(text):
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    count = {}
    for x in windows:
        count[x] = count.get(x, 0) + 1
    covered = {i + k for i, x in enumerate(windows) if count[x] > 1 for k in range(3)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered))


def grams(text, size=5):
    w = ALNUM.findall(lower(text))
    size = min(size, len(w))
    return size, {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if w else set()


def leaks(docs, items, threshold=0.8):
    """(doc id, item id, found, shingles) by exact containment."""
    out = []
    for d, text in docs:
        w = ALNUM.findall(lower(text))
        have = {k: {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} for k in range(1, 6)}
        for i, item in items:
            size, want = grams(item)
            found = len(want & have[size]) if want else 0
            if want and found / len(want) >= threshold:
                out.append((d, i, found, len(want)))
    return out


_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def pii(text):
    text = text or ""
    out = [("email", m.start(), m.end()) for m in _EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text)
            if all(int(x) <= 255 for x in m.group().split("."))]
    for m in _CARD.finditer(text):
        d = re.sub("[ -]", "", m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


_ASSIGN = re.compile(
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"""
    r"""|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text):
    text = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text)
            if len(m.group()) >= 18]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 16]
    return [(k, a, z) for a, _, k, z in sorted(out)]


def joined(spans):
    return ",".join(f"{k}:{a}:{z}" for k, a, z in spans)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def licenses(text):
    w = ALNUM.findall(lower(text))
    found = []
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"),
                          ("general public license", "gpl")):
        p = phrase.split()
        found += [(i, label) for i in range(len(w)) if w[i:i + len(p)] == p]
    places = [i for i, _ in found]
    return (len(w), len(found), min(places, default=None), max(places, default=None),
            ",".join(sorted({x for _, x in found})))
