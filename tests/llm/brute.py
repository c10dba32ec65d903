"""Plain versions of the training-data operators, for comparing on small inputs."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, n):
    w = words(lower(text))
    return [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []


def simhash(text, n=3, seed=42):
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed) for s in shingles(text, n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {x: find(x) for x in nodes}


def targets(sizes, weights=(5, 2, 1), repeat=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = float(sum(sizes.values())), set(order), {}
    while free:
        share = left / sum(w[s] for s in free)
        over = [s for s in free if w[s] * share > repeat * sizes[s]]
        if not over:
            return out | {s: w[s] * share for s in free}
        for s in over:
            out[s] = float(repeat * sizes[s])
            left -= out[s]
            free.discard(s)
    return out


def mix(rows, budget, repeat=3):
    """rows of (id, row_key, source, size, source_size, target) -> how often each (id, row_key) is taken: sources one after the
    other in the order of row_key, all copies by the middle of their virtual time, until the budget is used up."""
    stream, upto = [], Counter()
    for k, r in enumerate(sorted(rows, key=lambda r: (r["row_key"], r["id"] is not None, r["id"] or 0))):
        upto[r["source"]] += r["size"]
        for e in range(repeat):
            words = r["source_size"] * e + upto[r["source"]] - r["size"] / 2
            stream.append((words / r["target"] if r["target"] > 0 else 0.0, r["row_key"], e, k, r["id"], r["size"]))
    out, total = Counter({(r["id"], r["row_key"]): 0 for r in rows}), 0
    for _, key, _, _, i, size in sorted(stream, key=lambda x: x[:4]):
        total += size
        out[i, key] += total - size / 2 <= budget
    return out


def base_quality(text):
    w = words(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    repeated = {k for i, x in enumerate(windows) if n[x] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated), failed


def katz(docs, k=5):
    """docs: (id, text) -> {position: (held out, tokens, known, N, base, score)}"""
    tokens = [[*words(lower(t)), "\n"] for _, t in docs]
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0 for i, _ in docs]
    uni, bi, hist = Counter(), Counter(), Counter()
    for t, h in zip(tokens, held, strict=True):
        if not h:
            before = ["<s>", *t[:-1]]
            uni.update(t)
            bi.update(zip(before, t, strict=True))
            hist.update(before)
    total = sum(uni.values())

    def rule(counts):
        n = Counter(counts.values())
        points = [(math.log(r), math.log(n[r])) for r in range(1, k + 2) if n[r]]
        b = -2.0
        if len(points) > 1:
            mx, my = (sum(p[i] for p in points) / len(points) for i in (0, 1))
            b = min(sum((x - mx) * (y - my) for x, y in points) / sum((x - mx) ** 2 for x, _ in points), -1.05)
        smooth = lambda r: r**b
        c = (k + 1) * smooth(k + 1) / smooth(1)
        d = [1.0] + [((r + 1) * smooth(r + 1) / smooth(r) / r - c) / (1 - c) for r in range(1, k + 1)]
        return lambda x: x * d[x] if x <= k else x - k * (1 - d[k])

    d1, d2 = rule(uni), rule(bi)
    p1 = {w: d1(c) / total for w, c in uni.items()}
    unknown = 1 - sum(p1.values()) if total else 1.0
    beta, mass = defaultdict(float), defaultdict(float)
    for (v, w), c in bi.items():
        beta[v] += p1[w]
        mass[v] += d2(c)

    def p(v, w):
        if (v, w) in bi:
            return d2(bi[v, w]) / hist[v]
        alpha = (1 - mass[v] / hist[v]) / (1 - beta[v]) if v in hist else 1.0
        return alpha * p1.get(w, unknown)

    out = []
    for t, h in zip(tokens, held, strict=True):
        base = sum(math.log10((uni[w] + 0.1) / (total + 0.1 * (len(uni) + 1))) for w in t)
        out.append((h, len(t), sum(w in uni for w in t), total, base, sum(math.log10(p(v, w)) for v, w in zip(["<s>", *t[:-1]], t, strict=True))))
    return out


def kneser_ney(texts):
    """Interpolated modified Kneser-Ney trigrams -> (perplexity of a text, probability of a word after two others)."""
    tokens = [[*words(t), "\n"] for t in texts]
    seen = Counter(w for t in tokens for w in t)
    vocab = {w for w, n in seen.items() if n > 1} | ({"\n"} if tokens else set())
    n_oov = len(seen) - len(vocab)
    known = lambda w: w if w in vocab or w == "<s>" else "<unk>"
    grams = lambda t: list(zip(["<s>", "<s>", *t], ["<s>", *t], t, strict=False))
    c3 = Counter(tuple(map(known, g)) for t in tokens for g in grams(t))
    c2 = Counter()
    for (_, v, w), n in c3.items():
        c2[v, w] += n if v == "<s>" else 1
    c1 = Counter(w for _, w in c2)

    def rule(counts):
        n = Counter(c for c in counts.values() if c <= 4)
        b = -2.0
        if len(n) > 1:
            xs, ys = [math.log(r) for r in n], [math.log(k) for k in n.values()]
            mx, my = sum(xs) / len(xs), sum(ys) / len(ys)
            b = min(sum((x - mx) * (y - my) for x, y in zip(xs, ys, strict=True)) / sum((x - mx) ** 2 for x in xs), 0.0)
        y = 1 / (1 + 2 * 2**b)
        d = [0, *[r - (r + 1) * y * ((r + 1) / r) ** b for r in (1, 2, 3)]]
        return lambda c: d[min(c, 3)]

    d1, d2, d3 = rule(c1), rule(c2), rule(c3)
    total = sum(c1.values())
    uniform = sum(d1(c) for c in c1.values()) / total / (len(vocab) + 1)
    after2, after3 = defaultdict(list), defaultdict(list)
    for (v, w), c in c2.items():
        after2[v].append(c)
    for (u, v, w), c in c3.items():
        after3[u, v].append(c)

    def p1(w):
        return (c1[w] - d1(c1[w])) / total + uniform if c1[w] else uniform

    def p2(v, w):
        if not after2[v]:
            return p1(w)
        n = sum(after2[v])
        own = (c2[v, w] - d2(c2[v, w])) / n if c2[v, w] else 0.0
        return own + sum(map(d2, after2[v])) / n * p1(w)

    def p3(u, v, w):
        if not after3[u, v]:
            return p2(v, w)
        n = sum(after3[u, v])
        own = (c3[u, v, w] - d3(c3[u, v, w])) / n if c3[u, v, w] else 0.0
        return own + sum(map(d3, after3[u, v])) / n * p2(v, w)

    def perplexity(text):
        t = [known(w) for w in [*words(text), "\n"]]
        logs = [math.log(p3(u, v, w) / (n_oov + 1 if w == "<unk>" else 1)) for u, v, w in grams(t)]
        return math.exp(-sum(logs) / len(logs))

    return perplexity, p3, [*vocab, "<unk>"], list(after3)


def without_repeats(docs, run=3, least=25, window=50):
    """docs [(id, text)], distinct -> {(id, text): what is left}: spans of sentences first, then windows of words."""
    order = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0, xxhash.xxh64_intdigest((d[1] or "").encode(), 42)))
    cut = re.compile("[^.!?\\n]+[.!?\\n]*[ \\t\\x0b\\f\\r\\n]*|[.!?\\n]+[ \\t\\x0b\\f\\r\\n]*")
    bare = lambda s: re.sub("[\\s.!?,;:]+", "", s.lower())
    first, left = {}, {}
    spans = {}
    for d in order:
        pieces = cut.findall(d[1] or "")
        real = [k for k, s in enumerate(pieces) if bare(s)]
        spans[d] = []
        for at in range(max(1, len(real) - run + 1) if real else 0):
            taken, n = [], 0
            for k in real[at:]:
                if len(taken) >= run and n >= least:
                    break
                taken.append(k)
                n += len(pieces[k].split())
            if n >= least:
                key = tuple(bare(pieces[k]) for k in taken)
                spans[d].append((key, taken[0], taken[-1]))
                first.setdefault(key, (d, taken[0]))
    for d in order:
        pieces = cut.findall(d[1] or "")
        gone = {k for key, a, b in spans[d] if first[key] != (d, a) for k in range(a, b + 1)}
        left[d] = "".join(s for k, s in enumerate(pieces) if k not in gone) if d[1] is not None else None
    first = {}
    found = {}
    for d in order:
        text = left[d] or ""
        ws = [(m.group().lower().translate(str.maketrans("", "", ".!?,;:")), m.start()) for m in WORD.finditer(text)]
        ws = [w for w in ws if w[0]]
        ends = [*(p for _, p in ws[1:]), len(text)] if ws else []
        found[d] = [(tuple(w for w, _ in ws[k : k + window]), k, ws[k][1], ends[k + window - 1]) for k in range(len(ws) - window + 1)]
        for key, k, _, _ in found[d]:
            first.setdefault(key, (d, k))
    for d in order:
        text, gone = left[d], set()
        for key, k, a, b in found[d]:
            if first[key][0] != d or k >= first[key][1] + window:
                gone |= set(range(a, b))
        if gone:
            left[d] = "".join(c for k, c in enumerate(text) if k not in gone)
    return left


def audit_masks(rows):
    """rows (id, part, text) -> the filters A to E that each fails, as a set."""
    found = []
    for i, _, text in rows:
        text = text or ""
        w = words(text)
        fails = {"A"} if len(w) < 50 else set()
        if 100 * len(set(w)) < 65 * len(w):
            fails.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text):
            fails.add("C")
        if any(c in "#$%&*|" for c in text):
            fails.add("D")
        smaller = lambda j, i=i: j is not None and (i is None or j < i)
        if any((t or "") == text and smaller(j) for j, _, t in rows):
            fails.add("E")
        found.append(fails)
    return found


def audit(rows, good, toxic):
    """Applies the filters in every order, one after another, to the documents that are still there."""
    import itertools

    masks = audit_masks(rows)
    parts = sorted({p or "" for _, p, _ in rows})
    out, shapley = {}, Counter()
    for part in parts:
        docs = [(i, m) for (i, p, _), m in zip(rows, masks, strict=True) if (p or "") == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [(i, m) for i, m in left if f in m]
                left = [(i, m) for i, m in left if f not in m]
                failing = sum(f in m for _, m in docs)
                out[part, order, step] = (len(left), len(gone), failing - len(gone), sum(m == {f} for _, m in docs), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone))
                shapley[part, f] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def fill_in_middle(i, text):
    import hashlib

    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, end = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(pre), len(mid), f"<S>{end}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{end}<M>{mid}"


def exact_groups(rows):
    """rows (id, text) -> a list of (id, keep_id, group_size, whether it may be the one that stays)."""
    groups = defaultdict(list)
    for i, text in rows:
        groups["".join(words(text))].append((-len(text or ""), i is None, i or 0, i))
    return [(i, min(groups[k])[3], len(groups[k]), (-len(t or ""), i is None, i or 0, i) == min(groups[k])) for i, t in rows for k in ["".join(words(t))]]
