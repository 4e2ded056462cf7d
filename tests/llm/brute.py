"""Plain versions of what the operators are to give."""

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall(text or "")


def shingles(text, k):
    ws = words((text or "").translate(UPPER))
    if len(ws) < k:
        return {tuple(ws)} if ws else set()
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)}


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def components(rows, k, percent):
    """{doc_id: (set size, component)} of (doc_id, text) with distinct ids."""
    sets = {i: shingles(t, k) for i, t in rows}
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    common = Counter()
    for ids in where.values():
        for n, a in enumerate(ids):
            for b in ids[n + 1 :]:
                common[a, b] += 1
    u = Union()
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            u.join(a, b)
    return {i: (len(s), u.find(i)) for i, s in sets.items()}


def targets(sizes, weights=(5, 2, 1), most=3):
    """{source: target} of {source: size}, by refilling until none is above its cap."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), set(order), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] > most * sizes[s]}
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        if not full:
            out |= {s: share * weight[s] for s in open_}
            break
        open_ -= full
    return out


def removed(texts, length):
    """For each text (bytes): a mask of its bytes covered by a string that starts anywhere else."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    masks = []
    for t in texts:
        mask = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                mask[i : i + length] = b"\1" * length
        masks.append(mask)
    return masks


def digest(text, mask):
    kept = bytes(b for b, m in zip(text, mask) if not m)
    spans = sum(1 for i, m in enumerate(mask) if m and (i == 0 or not mask[i - 1]))
    return len(text), sum(mask), spans, hashlib.sha256(kept).hexdigest()


KINDS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?(?-i:([A-Za-z0-9+/_.=-]+))""", re.I | re.A), 2, 8),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile("[0-9a-f]+"), 0, 32),
)


def secrets(text):
    found = [(m.start(), n, m.end(), kind) for n, (kind, p, g, least) in enumerate(KINDS) for m in p.finditer(text or "") if len(m[g]) >= least]
    return sorted(found)


def word_hash(word):
    import xxhash

    return xxhash.xxh64_intdigest(word.encode(), 42)


def winnow(text, k, w, wide=None):
    """(grams, [(hash, position)]): the rightmost least of each window, of `wide` grams or as many as the rule says."""
    ws = words(text)
    if not ws:
        return 0, []
    n = max(1, len(ws) - k + 1)
    turn = lambda x, r: (x << r % 64 | x >> -r % 64) & (1 << 64) - 1 if r % 64 else x
    grams = []
    for i in range(n):
        g = 0
        for j, word in enumerate(ws[i : i + k]):
            g ^= turn(word_hash(word), min(k, len(ws)) - 1 - j)
        grams.append(g)
    if wide is None:
        wide = max(x for x in (1, 2, 4, 8, 16) if x == 1 or x <= w and n >= 16 * x)
    low = [g & 0xFFFFFFFF for g in grams]
    out = []
    for i in range(max(1, n - wide + 1)):
        window = range(i, min(n, i + wide))
        at = min(window, key=lambda j: (low[j], -j))
        if at not in out:
            out.append(at)
    return n, [(grams[i], i) for i in out]


def token_pieces(text, tokenizer, size=2048, end=1):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end]
    return [(i, len(p := ids[i : i + size]), zlib.crc32(struct.pack(f"<{len(p)}I", *p)), len(ids)) for i in range(0, len(ids), size)]


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(UPPER), re.match(r"[^?#]*", rest[len(host) :])[0]


def url_rule(host, path, rules):
    best = None
    for verdict, h, p in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = h + p, verdict
    return best


def kneser_ney(trained, order):
    """A function: log-probability of each byte of a text, under an interpolated modified Kneser-Ney model of bytes."""
    import math

    pad = b"\n" * (order - 1)
    tables = {order: Counter(x for t in trained for x in ((pad + t)[i : i + order] for i in range(len(t))))}
    for k in range(order - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    rules = {}
    for k, t in tables.items():
        n = [sum(1 for v in t.values() if v == i) for i in range(5)]
        if n[1] and n[2]:
            y = n[1] / (n[1] + 2 * n[2])
            d = [min(max(i - (i + 1) * y * n[i + 1] / n[i] if n[i] else i * 0.5, 0.05), i - 0.05) for i in (1, 2, 3)]
        else:
            d = [0.5] * 3
        context = defaultdict(lambda: [0, 0.0])
        for g, v in t.items():
            context[g[:-1]][0] += v
            context[g[:-1]][1] += d[min(v, 3) - 1]
        rules[k] = t, d, context

    def score(text):
        out = []
        for i in range(len(text)):
            gram, p = (pad + text)[i : i + order], 1 / 256
            for k in range(1, order + 1):
                t, d, context = rules[k]
                g = gram[order - k :]
                if g[:-1] in context:
                    total, free = context[g[:-1]]
                    v = t.get(g, 0)
                    p = (max(0, v - d[min(v, 3) - 1]) if v else 0) / total + free / total * p
            out.append(math.log(p))
        return out

    return score


def runs(words, least):
    """(start, length, period) of the maximal runs of `least` words and two periods or more."""
    out = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def kmeans(rows, k, rounds):
    """{id: (cluster, distance)}, inertia and centroids of (id, vector) with distinct ids."""
    order = sorted(rows, key=lambda r: hashlib.sha256(f"2:{r[0]}".encode()).hexdigest())
    centres = [list(v) for _, v in order[:k]]

    def assigned():
        return {i: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres)) for i, v in rows}

    for _ in range(rounds):
        now = assigned()
        for n in range(len(centres)):
            own = [v for i, v in rows if now[i][1] == n]
            if own:
                centres[n] = [sum(x) // len(own) for x in zip(*own)]
    now = assigned()
    return {i: (n, d) for i, (d, n) in now.items()}, sum(d for d, _ in now.values()), centres
