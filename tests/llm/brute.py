"""Plain Python forms of the operators' contracts, for small tables. Rows are (doc_id, text)."""

import base64
import hashlib
import math
import re
import zlib
from collections import defaultdict

import xxhash

BLANK = "\x20\t\n\x0b\x0c\r"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(f"[^{BLANK}]+", text or "")


def sha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def simhash(rows):
    fps = []
    for _, text in rows:
        w = words((text or "").translate(FOLD))
        shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    parent = list(range(len(fps)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        ids[find(i)].append(doc_id)
    low = {k: min((v for v in vs if v is not None), default=None) for k, vs in ids.items()}
    return [(doc_id, f"{fps[i]:016x}", low[find(i)]) for i, (doc_id, _) in enumerate(rows)]


def exact(rows):
    norm = [re.sub(f"[{BLANK}]+", " ", t or "") for _, t in rows]
    groups = defaultdict(list)
    for (doc_id, _), n in zip(rows, norm):
        groups[n].append(doc_id)
    return [(doc_id, min((v for v in groups[n] if v is not None), default=None), len(groups[n]), sha(n)) for (doc_id, _), n in zip(rows, norm)]


def targets(sizes):
    """sizes: {source: size} to {source: target}."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, capped = float(sum(sizes.values())), set()
    while True:
        free = [s for s in order if s not in capped]
        level = (total - sum(3.0 * sizes[s] for s in capped)) / sum(weight[s] for s in free) if free else 0.0
        over = {s for s in free if weight[s] * level > 3.0 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in capped else weight[s] * level for s in order}
        capped |= over


def repeats(rows, n=50):
    order = {v: k for k, v in enumerate(sorted({i for i, _ in rows if i is not None}))}  # null ids last
    data = [(order.get(i, len(order)), (t or "").encode()) for i, t in rows]
    least = {}
    for i, t in data:
        for j in range(len(t) - n + 1):
            least[t[j : j + n]] = min(i, least.get(t[j : j + n], i))
    out = []
    for (i, t), (doc_id, _) in zip(data, rows):
        gone = bytearray(len(t))
        for j in range(len(t) - n + 1):
            if least[t[j : j + n]] < i:
                gone[j : j + n] = b"\1" * n
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((doc_id, len(t), sum(gone), spans, sha(bytes(b for b, g in zip(t, gone) if not g))))
    return out


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def contamination(rows, items, n=13):
    found = defaultdict(set)
    for item_id, text in items:
        w = tokens(text)
        for i in range(max(1, len(w) - n + 1) if w else 0):
            found[tuple(w[i : i + n])].add("" if item_id is None else str(item_id))
    sizes, out = {len(g) for g in found}, []
    for doc_id, text in rows:
        w = tokens(text)
        hit, ids = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (g := tuple(w[i : i + size])) in found:
                    hit |= set(range(i, i + size))
                    ids |= found[g]
        out.append((doc_id, len(w), len(hit), len(ids), sha(",".join(sorted(ids))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def near(rows, items, n=13, share=0.8, run=26):
    windows = set()
    for item_id, text in items:
        w = tokens(text)
        windows |= {(item_id, tuple(w[i : i + n])) for i in range(max(1, len(w) - n + 1) if w else 0)}
    out = []
    for doc_id, text in rows:
        w = tokens(text)
        runs = [set(w[i : i + run]) for i in range(max(1, len(w) - run + 1))]
        out.append((doc_id, len({i for i, g in windows if any(len(set(g) & r) >= math.ceil(share * len(set(g))) for r in runs)})))
    return out


def warc(pages):
    groups = defaultdict(list)
    for page_id, _, html in pages:
        groups[html or ""].append(page_id)
    out = []
    for page_id, _, html in pages:
        raw = (html or "").encode()
        keep = max((v for v in groups[html or ""] if v is not None), default=None)
        revisit = keep is not None and page_id != keep
        out.append((page_id, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", keep if revisit else None))
    return out


RULES = (
    ("assign", re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 1, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)


def secrets(rows):
    out = []
    for doc_id, text in rows:
        found = [(m.start(), k, kind, m.end()) for k, (kind, rx, group, least) in enumerate(RULES) for m in rx.finditer(text or "") if len(m[group]) >= least]
        n = [sum(f[2] == kind for f in found) for kind, *_ in RULES]
        out.append((doc_id, *n, sha(",".join(f"{kind}:{s}:{e}" for s, _, kind, e in sorted(found)))))
    return out


def remainder(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n
