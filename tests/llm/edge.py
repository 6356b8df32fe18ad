"""A small awkward table and brute-force versions of the operators."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = re.compile(r"[\x20\x09-\x0D]")
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    # Names that the operators use inside.
    "_id string, _h string, size string, bucket string, kept string, w string, budget string, length string, score string"
)


def documents(spark, seed: int = 3):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage, long_text = text(120), text(40), text(30_000)
    rows = [
        (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (None, "no id here"), (None, None), (None, base), (-5, base),
        (7, base), (7, base), (8, base.replace(" ", "\n\t ")), (9, base.upper()), (10, base + " one more"),
        (11, long_text), (12, long_text), (13, long_text + " end"), (14, long_text[:-1] + "Z"), (15, "a"), (16, "A"), (17, "a b c"),
        (18, "\u00a0a\u2003b"), (19, "x" * 70), (20, "x" * 64), (21, "x" * 65), (22, "x" * 512), (23, "x" * 513), (24, "é" * 300),
        (25, text(20) + " " + passage + " " + text(20)), (26, passage + "\n" + text(5)), (27, " ".join(["a"] * 60)), (28, " ".join(["a"] * 40)),
        (29, "<|startoftext|> tricky's TEXT 12 ,.!? <|endoftext|>"), (30, "\U0001f600 e\u0301 \u00e9 \u00df \u0130"), (40, "tie"), (40, "tie two"),
    ]
    # Words that any polynomial hash modulo a power of two takes for each other.
    thue = ["".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(1024)) for flip in (0, 1)]
    rows += [(50 + flip, " ".join(f"{thue[flip]}{i}" for i in range(16))) for flip in (0, 1)]
    for i in range(60, 80):
        words = base.split()
        for _ in range(rng.randint(0, 12)):
            words[rng.randrange(len(words))] = f"w{rng.random()}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, text(rng.randint(1, 60))) for i in range(40)]
    rng.shuffle(rows)
    langs, sources = ["en", "de", None, "fr"], ["src1", "src2", None, "other", "src11"]
    full = [(i, t, rng.choice(langs), rng.choice(sources), len(t or ""), *(["z"] * 9)) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(5), [(r[0], r[1] or "") for r in full]


def rank(i):
    return (i is None, i or 0)


def exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[SPACE.sub("", t)].append((i, t))
    out = []
    for norm, own in groups.items():
        keep = min(own, key=lambda r: (-len(r[1]), rank(r[0])))[0]
        out += [(i, keep, len(own), hashlib.sha256(norm.encode()).hexdigest()) for i, _ in own]
    return out, len(groups)


def substrings(rows, k=13):
    least = {}
    for i, t in rows:
        w = WORD.findall(t)
        for p in range(len(w) - k + 1):
            key = tuple(w[p : p + k])
            least[key] = min(least.get(key, (True, 1 << 62)), rank(i))
    out = []
    for i, t in rows:
        w = WORD.findall(t)
        gone = set()
        for p in range(len(w) - k + 1):
            if least[tuple(w[p : p + k])] < rank(i):
                gone |= set(range(p, p + k))
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(t, k=4):
    w = WORD.findall(t.translate(_LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def jaccard(rows, percent=85, k=4):
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                inter = len(sets[a] & sets[b])
                if 100 * inter >= percent * (len(sets[a]) + len(sets[b]) - inter):
                    parent[find(a)] = find(b)
    least = {}
    for x, (i, _) in enumerate(rows):
        r = find(x)
        least[r] = min(least.get(r, (True, 1 << 62)), rank(i))
    return [(i, len(sets[x]), None if least[find(x)][0] else least[find(x)][1]) for x, (i, _) in enumerate(rows)]


def runs(words, least=24, times=3):
    """By comparing the words with themselves at every distance."""
    known = {}
    codes = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
    found = {}
    for q in range(1, len(words) // times + 1):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (codes[q:] == codes[:-q]).astype(np.int8), [0]])))
        for i, j in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def phrase_counts(rows, longest=4):
    """Counts of (lang, phrase) by length, and of all words by language."""
    counts, totals = defaultdict(int), defaultdict(int)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(_LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    counts[lang or "und", tuple(w[i : i + k])] += 1
    return counts, totals


def collocations(rows, longest=4, least=30, top=2000, covered=80):
    counts, totals = phrase_counts(rows, longest)
    often = {p: a for p, a in counts.items() if len(p[1]) > 1 and a >= least}
    gone = set()
    for (lang, w), f in often.items():
        for i in range(len(w)):
            for j in range(i + 2, len(w) + 1):
                if j - i < len(w) and 100 * f >= covered * often[lang, w[i:j]]:
                    gone.add((lang, w[i:j]))
    per = defaultdict(list)
    for (lang, w), a in often.items():
        if (lang, w) not in gone:
            cuts = [(2000000 * a // (counts[lang, w[:k]] + counts[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            per[lang].append((-score, -a, " ".join(w).encode(), counts[lang, w[:k]], counts[lang, w[k:]]))
    return [
        (lang, i + 1, p.decode(), -a, l, r, totals[lang], -s)
        for lang, own in per.items() for i, (s, a, p, l, r) in enumerate(sorted(own)[:top])
    ]


def crc(ids):
    return zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))
