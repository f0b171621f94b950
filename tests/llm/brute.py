"""Plain, slow versions of the operators, to hold results against."""

import hashlib
import math
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {i: i + 32 for i in range(65, 91)}


class Union:
    def __init__(self, items):
        self.up = {x: x for x in items}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def edits(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def within(a, b, most):
    """Whether at most so many edits lead from a to b, a row of the table at a time."""
    y, steps = np.array([ord(c) for c in b]), np.arange(len(b) + 1)
    row = steps
    for i, c in enumerate(map(ord, a), 1):
        now = np.concatenate([[i], np.minimum(row[1:] + 1, row[:-1] + (y != c))])
        row = np.minimum.accumulate(now - steps) + steps
        if row.min() > most:
            return False
    return bool(row[-1] <= most)


def line_dedup(docs, similarity=0.8):
    """(id, text) rows to {id: (lines, removed, kept text)}, by edit similarity alone."""
    places = defaultdict(list)
    for d, t in docs:
        for i, line in enumerate((t or "").split("\n") if t is not None else []):
            norm = " ".join(line.lower().translate({9: " ", 11: " ", 12: " ", 13: " "} | dict.fromkeys(map(ord, string.punctuation))).split(" "))
            norm = " ".join(x for x in norm.split(" ") if x)
            if norm:
                places[norm].append((d, i))
    norms = sorted(places)
    u = Union(norms)
    long = [n for n in norms if len(n.split(" ")) >= 5]
    for i, a in enumerate(long):
        for b in long[i + 1 :]:
            most = max(len(a), len(b)) * round((1 - similarity) * 1000) // 1000
            if abs(len(a) - len(b)) <= most and within(a, b, most):
                u.join(a, b)
    groups = defaultdict(list)
    for n in norms:
        groups[u.find(n)] += places[n]
    gone = {p for g in groups.values() for p in g} - {min(g) for g in groups.values()}
    out = {}
    for d, t in docs:
        lines = t.split("\n") if t is not None else []
        kept = [x for i, x in enumerate(lines) if (d, i) not in gone]
        out[d] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def quality(docs, most_texts=20, share=0.05):
    """(id, source, text) rows to {id: (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, removed, base_failed, depleted)}."""
    norm = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x.lower()).strip(" ")
    texts, holders = defaultdict(set), defaultdict(set)
    for _, s, t in docs:
        texts[s].add(t or "")
        for line in (t or "").split("\n"):
            if norm(line):
                holders[s, norm(line)].add(t or "")
    over = {k for k, v in holders.items() if len(v) > most_texts and len(v) > share * len(texts[k[0]])}
    out = {}
    for d, s, t in docs:
        t = t or ""
        w = WORD.findall(t)
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        c = Counter(windows)
        hit = {i + k for i, x in enumerate(windows) if c[x] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        removed = sum(len(WORD.findall(x)) for x in lines if (s, norm(x)) in over)
        failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        out[d] = (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(hit), removed, failed, removed > 0.5 * len(w))
    return out


def shingles(t, size=3):
    w = WORD.findall((t or "").translate(LOW))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def jaccard(docs, percent=90, size=3):
    """(id, text) rows to {id: (size, component)}."""
    sets = {d: shingles(t, size) for d, t in docs}
    u = Union(sets)
    ids = sorted((d for d in sets if sets[d]), key=lambda d: len(sets[d]))
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if len(sets[b]) * percent > len(sets[a]) * 100:
                break
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                u.join(a, b)
    return {d: (len(s), u.find(d)) for d, s in sets.items()}


def repeats(docs, length):
    """(id, text) rows to {id: (bytes, removed, spans, kept bytes)}."""
    data = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(b[i : i + length] for _, b in data for i in range(len(b) - length + 1))
    out = {}
    for d, b in data:
        gone, end = bytearray(len(b)), 0
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[max(i, end) : i + length] = b"\1" * (i + length - max(i, end))
                end = i + length
        spans = sum(1 for i, x in enumerate(gone) if x and (not i or not gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    starts, labels = [], set()
    for phrase, label in ((["mit", "license"], "mit"), (["apache", "license"], "apache"), (["general", "public", "license"], "gpl")):
        for i in range(len(words)):
            if words[i : i + len(phrase)] == phrase:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def viterbi(text, pieces, byte_score):
    """Best score of a marked text over pieces {piece: score}; characters that are no piece may cost byte_score."""
    best = [0.0] + [float("-inf")] * len(text)
    for end in range(1, len(text) + 1):
        if text[end - 1] not in pieces:
            best[end] = best[end - 1] + byte_score
        for start in range(max(0, end - 48), end):
            s = pieces.get(text[start:end])
            if s is not None:
                best[end] = max(best[end], best[start] + s)
    return best[-1]


def template_pattern(markup):
    """A template as one regular expression over a text's words, each followed by a space."""
    out = ""
    for m in re.finditer(r"\[\[|\]\]|\{\{(\d+)\}\}|[^\s\[\]{}]+", markup):
        if m[0] == "[[":
            out += "(?:"
        elif m[0] == "]]":
            out += ")?"
        elif m[1]:
            out += f"(?:[^ ]+ ){{0,{m[1]}}}"
        else:
            out += "".join(re.escape(w) + " " for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", m[0].translate(LOW)))
    return re.compile("(?:^|(?<= ))" + out)


def template_labels(text, templates):
    """Labels of the (label, pattern) templates whose wording a text has."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    line = "".join(w + " " for w in words)
    return {label for label, p in templates if p.search(line)}


def png_samples(data):
    """Samples of an 8-bit greyscale PNG with filters None, Sub and Up, byte by byte."""
    at, body, width = 8, b"", 0
    while at < len(data):
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + size]
        assert zlib.crc32(kind + part) == int.from_bytes(data[at + 8 + size : at + 12 + size], "big")
        width = int.from_bytes(part[:4], "big") if kind == b"IHDR" else width
        body += part if kind == b"IDAT" else b""
        at += 12 + size
    flat, out, above = zlib.decompress(body), bytearray(), bytes(width)
    for y in range(0, len(flat), width + 1):
        kind, line = flat[y], bytearray(flat[y + 1 : y + 1 + width])
        for x in range(width):
            guess = 0 if kind == 0 else (line[x - 1] if x else 0) if kind == 1 else above[x]
            line[x] = (line[x] + guess) & 255
        out += line
        above = bytes(line)
    return bytes(out)


def cosine_feature(payload):
    """The 8 x 8 lowest cosine sums over the picture's 32 x 32 means (rows of 64 samples), as bits above their median."""
    n = len(payload) // 64
    rows = [range(y * n // 32, max(y * n // 32 + 1, (y + 1) * n // 32)) for y in range(32)]
    cell = [[sum(payload[r * 64 + 2 * x] + payload[r * 64 + 2 * x + 1] for r in rr) / (2 * len(rr)) for x in range(32)] for rr in rows]
    wave = [[math.cos(math.pi * u * (2 * k + 1) / 64) for k in range(32)] for u in range(8)]
    half = [[sum(wave[u][y] * cell[y][x] for y in range(32)) for x in range(32)] for u in range(8)]
    low = [round(sum(half[u][x] * wave[v][x] for x in range(32)), 6) for u in range(8) for v in range(8)]
    middle = sorted(low[1:])[31]
    return f"{int(''.join('1' if i and v > middle else '0' for i, v in enumerate(low)), 2):016x}"


def runs(words, least=12):
    """(start, length, period) of the maximal stretches of length max(least, 2 period) or more, by start, then period."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def phrases(rows, least, percent, top):
    """(lang, rank, phrase, a, l, r, n, score) of the best phrases of rows of (lang, text)."""
    counts, total = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            counts.update((lang or "und", tuple(words[i : i + k])) for k in range(1, 5) for i in range(len(words) - k + 1))
    candidates = {x: a for x, a in counts.items() if len(x[1]) >= 2 and a >= least}
    longest = {}
    for (lang, words), a in candidates.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                longest[lang, words[i : i + k]] = max(longest.get((lang, words[i : i + k]), 0), a)
    by = {}
    for (lang, words), a in candidates.items():
        if 100 * longest.get((lang, words), -1) < percent * a:
            cuts = [(counts[lang, words[:k]], counts[lang, words[k:]], k) for k in range(1, len(words))]
            score, _, l, r = min((2_000_000 * a // (l + r), k, l, r) for l, r, k in cuts)
            by.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for lang, rows in by.items() for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top]))
