"""Plain single-machine forms of the operators' contracts, for small tables."""

import collections
import hashlib
import re
import zlib

import numpy as np

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def stats(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = words(text)
    count = collections.Counter(tuple(w[j:j + 8]) for j in range(len(w) - 7))
    cover = {k for j in range(len(w) - 7) if count[tuple(w[j:j + 8])] > 1 for k in range(j, j + 8)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if words(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, len(cover)


def shingles(text, size=5):
    w = words((text or "").translate(LOW))
    if len(w) >= size:
        return {tuple(w[j:j + size]) for j in range(len(w) - size + 1)}
    return {tuple(w)} if w else set()


def components(rows, size=5):
    """[(doc_id, set size, smallest linked id)] of (doc_id, text) rows."""
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    ids = collections.defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        ids[root(i)].append(doc)
    low = {r: min((d for d in v if d is not None), default=None) for r, v in ids.items()}
    return [(doc, len(sets[i]), low[root(i)]) for i, (doc, _) in enumerate(rows)]


def contamination(docs, items, window=10):
    """[(doc_id, n_words, n_hit, n_items, sha, contaminated)]."""
    def split(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))

    patterns = collections.defaultdict(set)
    for item, text in items:
        w = split(text)
        m = min(window, len(w))
        for j in range(len(w) - m + 1 if m else 0):
            patterns[tuple(w[j:j + m])].add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, found = split(text), set(), set()
        for m in {len(p) for p in patterns}:
            for j in range(len(w) - m + 1):
                if tuple(w[j:j + m]) in patterns:
                    hit.update(range(j, j + m))
                    found |= patterns[tuple(w[j:j + m])]
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), sha, bool(hit)))
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text):
    out, text = [], text or ""
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def without_repeats(rows, length=400):
    """[(doc_id, n_bytes, n_removed, n_spans, sha)]."""
    rows = [(i, (t or "").encode()) for i, t in rows]
    count = collections.Counter(b[j:j + length] for _, b in rows for j in range(len(b) - length + 1))
    out = []
    for doc, data in rows:
        gone = np.zeros(len(data) + 1, dtype=int)
        for j in range(len(data) - length + 1):
            if count[data[j:j + length]] > 1:
                gone[j] += 1
                gone[j + length] -= 1
        flags = np.cumsum(gone[:-1]) > 0
        spans = int((np.diff(np.concatenate([[0], flags.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(data, np.uint8)[~flags])
        out.append((doc, len(data), int(flags.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def crc(ids):
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())


def merkle(rows):
    """[(doc_id, leaf, subroot, root, proof digest, folded root, verified)] of (doc_id, source, lang, n_chars, text) rows."""
    def h(*parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def leaf(row):
        return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][i:i + 16]) for i in range(0, len(levels[-1]), 16)])
        return levels

    def path(levels, i):
        out = []
        for level in levels[:-1]:
            run = level[i // 16 * 16:i // 16 * 16 + 16]
            out.append((run[:i % 16], run[i % 16 + 1:]))
            i //= 16
        return out

    groups = collections.defaultdict(list)
    for row in rows:
        groups[row[1]].append((row[0] is not None, row[0] or 0, leaf(row), row))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (_, _, own, row) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            proof = path(trees[s], i) + path(top, k)
            at = own
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0:
                at = leaf((*row[:4], row[4] and row[4].translate(LOW)))
            for left, right in proof:
                at = h(*left, at, *right)
            out.append((row[0], own, trees[s][-1][0], top[-1][0], h(*("".join(a + b) for a, b in proof)), at, at == top[-1][0]))
    return out


def collocations(rows, least=10, top=2000, share=50):
    """[(lang, rank, phrase, a, l, r, n, score)] of (text, lang) rows."""
    count = collections.defaultdict(collections.Counter)
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                count["und" if lang is None else lang].update(tuple(w[j:j + k]) for j in range(len(w) - k + 1))
    out = []
    for lang, f in count.items():
        n = sum(v for k, v in f.items() if len(k) == 1)
        wide = [k for k in f if len(k) in (2, 3) and f[k] >= least]
        longer = collections.defaultdict(int)
        for k in wide:
            if len(k) == 3:
                for part in (k[:2], k[1:]):
                    longer[part] = max(longer[part], f[k])
        scored = []
        for k in wide:
            if len(k) == 2 and k in longer and 100 * longer[k] >= share * f[k]:
                continue
            score, _, left, right = min((10 ** 6 * f[k] ** 2 // (f[k[:c]] * f[k[c:]]), c, f[k[:c]], f[k[c:]])
                                        for c in range(1, len(k)))
            scored.append((-score, -f[k], " ".join(k).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return out


def text_counts(text):
    """All counts that the quality operators use, character by character."""
    text = text or ""
    n_words, word_chars, n_symbols, n_dup, n_repeat = stats(text)
    lines = [x for x in text.split("\n") if words(x)]
    ascii_upper = sum("A" <= c <= "Z" for c in text)
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup, "n_repeat_words": n_repeat,
            "n_upper": ascii_upper, "n_letters": sum("A" <= c <= "Z" or "a" <= c <= "z" or ord(c) > 127 for c in text),
            "n_digits": sum("0" <= c <= "9" for c in text), "n_marks": sum(c in "!?.,;:" for c in text),
            "n_shouts": sum(c in "!?" for c in text), "n_lines": len(lines), "n_distinct": len(set(words(text)))}


def gam_score(model, ratios, text):
    """Score of one text by walking the bins of every table."""
    c = text_counts(text)
    x = [c[a] / c[b] if c[b] else 0.0 for a, b in ratios] + [float(np.log1p(c["n_words"]))]
    bins = []
    for value, cuts in zip(x, model.cuts):
        k = 0
        while k < len(cuts) and value > cuts[k]:
            k += 1
        bins.append(k)
    total = model.bias + sum(t[b] for t, b in zip(model.tables, bins)) + sum(t[bins[f], bins[g]] for f, g, t in model.pairs)
    return 1 / (1 + np.exp(-min(max(total, -40), 40)))


def rule_of(rules, ratios, text):
    """Number of the first learned rule that covers a text, else None."""
    c = text_counts(text)
    x = {k: c[a] / c[b] if c[b] else 0.0 for k, (a, b) in ratios.items()} | {"words": float(c["n_words"])}
    for i, rule in enumerate(rules):
        if all((x[t.feature] > t.threshold) == t.above for t in rule):
            return i
    return None


def byte_grams(text):
    """4-byte strings of a text, letters in lower case and other ASCII as one gap, which may only be first or last."""
    data = bytes(b if 97 <= b <= 122 or b > 127 else b + 32 if 65 <= b <= 90 else 32 for b in (text or "").encode())
    return [data[i:i + 4] for i in range(len(data) - 3) if 32 not in data[i + 1:i + 3]]


def language(filters, text):
    """(language, score) by counting a text's grams in Python, through the same filter rows."""
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    hits, total = collections.Counter(), 0
    rows = len(filters.table) - 1
    for gram in byte_grams(text):
        total += 1
        h = int.from_bytes(gram, "big")
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> shift)) * factor % (1 << 64)
        h ^= h >> 31
        mask = -1
        for i in range(3):
            mask &= sum(int(w) << (64 * k) for k, w in enumerate(filters.table[(h >> (20 * i)) & rows]))
        for k in range(len(filters.languages)):
            hits[k] += mask >> k & 1
    votes = [max(hits[k] - total * f, 0) / (1 - f) for k, f in enumerate(map(float, filters.false))]
    if not sum(votes):
        return filters.languages[int(filters.share.argmax())], 0.0
    best = max(range(len(votes)), key=lambda k: (votes[k], -k))
    return filters.languages[best], votes[best] / sum(votes)
