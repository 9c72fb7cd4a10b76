"""Plain Python versions of the corpus operators, for small inputs, and inputs to try them on."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\W\d_]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def passages(seed: int, n: int = 60) -> list[str | None]:
    """Texts with shared passages, copies, periods, odd blanks, several scripts and all lengths from none."""
    rng = random.Random(seed)
    vocabulary = ["ab", "the", "été", "x" * 30, "日本語", "a\u00a0b", "zero\u200bwidth", "|", "#*", "end."] + [f"w{k}" for k in range(300)]
    shared = [" ".join(rng.choices(vocabulary, k=rng.randint(15, 90))) for _ in range(6)]
    out: list[str | None] = [None, "", " \t\n\r\x0b\x0c", "one", "a" * 350, "a b " * 80, "\n".join(["same line here"] * 30)]
    while len(out) < n:
        parts = []
        for _ in range(rng.randint(0, 5)):
            parts.append(rng.choice(shared) if rng.random() < 0.5 else " ".join(rng.choices(vocabulary, k=rng.randint(1, 60))))
        if rng.random() < 0.2:
            parts.append(parts[0] if parts else "")
        text = rng.choice([" ", "  ", "\n", "\t"]).join(parts)
        if out and rng.random() < 0.25:
            text = rng.choice(out) or ""
            if text and rng.random() < 0.6:
                at = rng.randrange(len(text))
                text = text[:at] + rng.choice(["", "Q", " new "]) + text[at + 1 :]
        out.append(text)
    return out


def byte_repeats(docs: list[tuple[int, str | None]], n: int) -> dict[int, tuple]:
    first: dict[bytes, tuple] = {}
    raw = {i: (t or "").encode() for i, t in docs}
    for i in sorted(raw):
        for k in range(len(raw[i]) - n + 1):
            first.setdefault(raw[i][k : k + n], (i, k))
    out = {}
    for i, b in raw.items():
        gone = [False] * len(b)
        for k in range(len(b) - n + 1):
            if first[b[k : k + n]] < (i, k):
                gone[k : k + n] = [True] * n
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, sha(bytes(c for c, g in zip(b, gone) if not g)))
    return out


def word_repeats(docs: list[tuple[int, str | None]], n: int) -> dict[int, tuple]:
    words = {i: WORD.findall(t or "") for i, t in docs}
    count = Counter(tuple(w[k : k + n]) for w in words.values() for k in range(len(w) - n + 1))
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if count[tuple(w[k : k + n])] > 1:
                gone[k : k + n] = [True] * n
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), sha(kept.encode()))
    return out


def shingles(text: str | None, n: int) -> frozenset:
    w = WORD.findall((text or "").translate(UPPER))
    return frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[k : k + n]) for k in range(len(w) - n + 1)])


def near_duplicates(docs: list[tuple[int, str | None]], n: int, percent: int) -> dict[int, tuple]:
    sets = {i: shingles(t, n) for i, t in docs}
    root = {i: i for i in sets}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            inter = len(sets[a] & sets[b]) if a < b else 0
            if inter and 100 * inter >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def decontaminated(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], n: int) -> dict[int, tuple]:
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall((t or "").translate(UPPER))
    wanted: dict[tuple, set] = defaultdict(set)
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            wanted[tuple(w[k : k + n])].add("" if item is None else str(item))
    out = {}
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(x) for x in wanted}:
            for k in range(len(w) - size + 1):
                got = wanted.get(tuple(w[k : k + size]))
                if got:
                    hit |= set(range(k, k + size))
                    found |= got
        out[i] = (len(w), len(hit), len(found), sha(",".join(sorted(found)).encode()), bool(hit) and 20 * len(hit) >= len(w))
    return out


def host_and_path(url: str | None) -> tuple[str, str]:
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return host.translate(UPPER), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


def url_verdict(url: str | None, rules: list[tuple[str, str]], default: str) -> tuple:
    host, path = host_and_path(url)
    best = None
    for action, rule in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (action, rule)
    return host, path, best and best[1], best[0] if best else default


def uniform(*parts: str) -> float:
    return (int(hashlib.md5("|".join(parts).encode()).hexdigest()[:13], 16) + 0.5) / 2.0**52


def copies(rate: float, seed: int, key: str, step: float = 16.0) -> int:
    """Poisson counts by inversion, one for each equal part of the rate."""
    parts = max(1, math.ceil(rate / step))
    total = 0
    for k in range(parts):
        u, p, x = uniform(str(seed), key, str(k)), math.exp(-rate / parts), 0
        c = p
        while c < u and x < 200:
            x += 1
            p *= rate / parts / x
            c += p
        total += x
    return total


def mixed(docs: list[tuple[int, str | None]], weights: dict, seed: int, texts: list[str | None] | None = None) -> Counter:
    """(id, source) -> copies for (id, source) rows; a row without an id draws by its text."""
    n = Counter(s for _, s in docs)
    w = {s: weights.get(s, 1.0) for s in n}
    rate = {s: len(docs) * w[s] / sum(w.values()) / n[s] for s in n}
    keys = [f"text:{hashlib.md5((t or '').encode()).hexdigest()}" if d[0] is None else str(d[0]) for d, t in zip(docs, texts or [None] * len(docs))]
    return Counter({d: copies(rate[d[1]], seed, key) for d, key in zip(docs, keys)})


def quality(text: str | None, sizes: list[int], window: int) -> tuple:
    """The counts, with the characters inside n-grams seen before for each size."""
    text = text or ""
    words = WORD.findall(text)
    lines = Counter()
    dup = dup_chars = n_lines = 0
    for line in text.split("\n"):
        if WORD.search(line):
            n_lines += 1
            if lines[line]:
                dup += 1
                dup_chars += sum(map(len, WORD.findall(line)))
            lines[line] += 1

    def inside(n: int, all_places: bool) -> list[bool]:
        grams = [tuple(words[k : k + n]) for k in range(len(words) - n + 1)]
        count, seen, mask = Counter(grams), set(), [False] * len(words)
        for k, g in enumerate(grams):
            if count[g] > 1 and (all_places or g in seen):
                mask[k : k + n] = [True] * n
            seen.add(g)
        return mask

    chars = [sum(len(w) for w, m in zip(words, inside(n, False)) if m) for n in sizes]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, sum(inside(window, True)), n_lines, dup_chars, *chars


def held_out(i: int) -> bool:
    return zlib.crc32(str(i).encode()) % 5 == 0
