"""The contracts again, in plain Python over a few rows."""

import collections
import hashlib
import math
import re
import zlib

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def low_words(text, pattern=WORD):
    return pattern.findall((text or "").translate(LOWER))


def fingerprint(text):
    words = low_words(text)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)]
    hashed = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def components(points, radius=2):
    """For (id, fingerprint) rows: the smallest id that each reaches."""
    least = [i for i, _ in points]
    changed = True
    while changed:
        changed = False
        for a in range(len(points)):
            for b in range(len(points)):
                if (points[a][1] ^ points[b][1]).bit_count() <= radius and least[b] < least[a]:
                    least[a], changed = least[b], True
    return least


def base_scores(rows):
    """(held out, tokens, known, N, base) of (id, text) rows."""
    out, counts = [], collections.Counter()
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    texts = [[*low_words(t), None] for _, t in rows]
    for h, words in zip(held, texts):
        counts.update([] if h else words)
    n, v = sum(counts.values()), len(counts)
    for h, words in zip(held, texts):
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        out.append((h, len(words), sum(counts[w] > 0 for w in words), n, base))
    return out


def secrets(text):
    """The base spans (start, kind, end)."""
    text = text or ""
    found = [(m.start(), 1, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 2, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 3, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def contamination(text, items, window=10):
    """(words, hit words, ids of items) of one text."""
    words, hit, found = low_words(text, BENCH), set(), set()
    for item, body in items:
        own = low_words(body, BENCH)
        size = min(window, len(own))
        wanted = {tuple(own[i:i + size]) for i in range(len(own) - size + 1)} if size else set()
        for i in range(len(words) - size + 1 if size else 0):
            if tuple(words[i:i + size]) in wanted:
                hit.update(range(i, i + size))
                found.add("null" if item is None else str(item))
    return len(words), len(hit), sorted(found)


def without_repeats(texts, window=35):
    """(words, removed, kept) of every text."""
    split = [WORD.findall(t or "") for t in texts]
    count = collections.Counter(tuple(w[i:i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = {j for i in range(len(w) - window + 1) if count[tuple(w[i:i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def quality(text):
    """(words, characters, symbols, repeated lines, words in repeated windows)."""
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    count = collections.Counter(windows)
    covered = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def best_segmentation(text, scores, lead):
    """(pieces, score) of a marked pre-token, by trying every way."""
    best = {0: (0.0, 0)}
    for end in range(1, len(text) + 1):
        ways = [(best[end - 1][0] + lead, -(-best[end - 1][1] + len(text[end - 1].encode())))]
        ways += [(best[s][0] + scores[text[s:end]], best[s][1] - 1) for s in range(end) if text[s:end] in scores]
        best[end] = max(ways)
    return -best[len(text)][1], best[len(text)][0]
