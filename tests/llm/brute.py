"""Plain versions of the operators: one text or one table at a time, as simple as they can be."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def crc(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode())


def words(text) -> list[str]:
    return WORD.findall(text or "")


def chats(rows):
    """conv_id -> (n_turns, turns_sha256, loss_chars, loss_sha256)"""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for *_, r, t in turns)), len(loss), sha(loss))
    return out


def _listed(found, kinds):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted((a, kinds.index(k), b, k) for k, a, b in found))


def secrets(text) -> list[tuple[str, int, int]]:
    text = text or ""
    found = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII):
        if len(m[2]) >= 8:
            found.append(("assign", m.start(), m.end()))
    found += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return found + [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]


def luhn(d: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def personal(text) -> list[tuple[str, int, int]]:
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p[-9:]) <= 255 and not p[:-9].strip("0") for p in m[0].split("."))]
    found += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return found + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m)) <= 15]


def listed(found, kinds) -> str:
    return _listed(found, kinds)


def repeats(docs, size: int = 50):
    """docs: (doc_id, text) -> list of (doc_id, n_words, n_removed, kept_sha256)"""
    first: dict[tuple, int] = {}
    split = [(i, words(t)) for i, t in docs]
    for i, w in split:
        for p in range(len(w) - size + 1):
            key = tuple(w[p : p + size])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for p in range(len(w) - size + 1):
            if i is not None and first[tuple(w[p : p + size])] < i:
                gone[p : p + size] = [True] * size
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


def jaccard(docs, size: int = 5, threshold: float = 0.8):
    """docs: (doc_id, text) -> list of (doc_id, class_id, n_links)"""
    sets = []
    for i, t in docs:
        w = words(t)
        n = min(size, len(w))
        sets.append({tuple(w[p : p + n]) for p in range(len(w) - n + 1)} if w and i is not None else set())
    index = defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            index[g].append(k)
    label, links = list(range(len(docs))), [0] * len(docs)

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for k, s in enumerate(sets):
        shared = Counter(o for g in s for o in index[g] if o > k)
        for o, n in shared.items():
            if n / (len(s) + len(sets[o]) - n) >= threshold - 1e-12:
                links[k] += 1
                links[o] += 1
                label[max(root(k), root(o))] = min(root(k), root(o))
    least = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return [(i, least[root(k)] if i is not None else None, links[k]) for k, (i, _) in enumerate(docs)]


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept"""
    from ledgermatch.llm.quality import MOST_LINE_CHARS, MOST_REPEATED

    text = text or ""
    w = words(text)
    chars = sum(map(len, w))
    seen, dup, dup_chars = set(), 0, 0
    for line in text.split("\n"):
        if words(line):
            if line in seen:
                dup += 1
                dup_chars += sum(map(len, words(line)))
            seen.add(line)

    def covered(n, first=False):
        grams = [tuple(w[p : p + n]) for p in range(len(w) - n + 1)]
        count, before = Counter(grams), set()
        mark = [False] * len(w)
        for p, g in enumerate(grams):
            if g in before or (first and count[g] > 1):
                mark[p : p + n] = [True] * n
            before.add(g)
        return mark

    repeated = sum(covered(3, True))
    failed = len(w) < 50 or 100 * repeated > 50 * len(w)
    shares = {n: sum(len(x) for x, m in zip(w, covered(n), strict=True) if m) / max(chars, 1) for n in MOST_REPEATED}
    fine = dup_chars / max(chars, 1) <= MOST_LINE_CHARS and all(shares[n] <= most for n, most in MOST_REPEATED.items())
    return len(w), chars, sum(c in "#*$%&|<>" for c in text), dup, repeated, failed, not failed and fine


def leaks(docs, items, stretch: int = 13, wrong: int = 2, least: int = 8):
    """Every item at every shift of every text. (doc_id, sorted [(item_id, words)])"""
    plain = lambda t: re.sub(r"[!-/:-@\[-`{-~\x00-\x08\x0e-\x1f\x7f]", "", (t or "").lower()).split()
    number: dict[str, int] = {}
    code = lambda t: np.array([number.setdefault(x, len(number)) for x in plain(t)], np.int64)
    coded = [(i, code(t)) for i, t in items if i is not None and t is not None]
    out = []
    for d, t in docs:
        text, found = code(t), []
        for i, item in coded:
            if len(item) < least:
                continue
            size, allowed = (stretch, wrong) if len(item) >= stretch else (len(item), 0)
            padded = np.concatenate((np.full(len(item), -1), text, np.full(len(item), -1)))
            windows = np.lib.stride_tricks.sliding_window_view(padded, len(item))
            best = 0
            for same in windows == item:
                if same.sum() < size - allowed:
                    continue
                good = np.convolve(same, np.ones(size, int), "valid") >= size - allowed
                cover = np.zeros(len(item), bool)
                for p in np.flatnonzero(good):
                    cover[p : p + size] = True
                best = max(best, int((same & cover).sum()))
            if best:
                found.append((i, best))
        out.append((d, sorted(found)))
    return out


def repaired(rows):
    """rows of one conversation after damage: (turn, role, text) -> the eight results, by trying all edits from the end."""
    import functools

    rows = sorted(((t is not None, t or 0, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows))
    turns = [t for known, t, *_ in rows if known]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    faults, seen = [], set()
    for _, _, r, x in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", x)
        faults.append("blank" if not solid else "duplicate" if (r, x) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((r, x))
    follow = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    full = {"u": "user", "a": "assistant"}

    @functools.cache
    def best(i, last, inserts):
        """Least (cost, audit, lines) from row i on; ``last`` is the initial said last."""
        ways = [(0, "", ())] if i == len(rows) and last in ("", "a") else []

        def way(cost, letter, line, rest):
            if rest is not None:
                ways.append((cost + rest[0], letter + rest[1], line + rest[2]))

        for to, name in full.items():
            if inserts < 3 and (last, to) in follow:
                way(3, "I", (f"{name}:",), best(i, to, inserts + 1))
        if i < len(rows):
            _, _, r, x = rows[i]
            way(4, "D", (), best(i + 1, last, 0))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                if (last, r[:1]) in follow:
                    way(more, "K", (f"{r}:{x}",), best(i + 1, r[:1], 0))
                for to, name in full.items():
                    if (last, to) in follow:
                        way(3 + more, "R", (f"{name}:{x}",), best(i + 1, to, 0))
        return min(ways, default=None)

    cost, audit, lines = best(0, "", 0)
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    count = Counter(faults)
    return gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, sha("\n".join(lines))


def deduped_lines(docs, least_chars=20, least_docs=3):
    """docs: (doc_id, text) -> list of (doc_id, n_lines, n_dropped, kept text)"""
    key = lambda line: "".join(c.lower() if c.isascii() else c for c in line.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if i is not None:
                held[key(line)].add(i)
    gone = {k: max(v) for k, v in held.items() if len(k) >= least_chars and len(v) >= least_docs}
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or gone.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def resampled(docs, target, longest=1, buckets=10_000, seed=2024, least=20, percent=10):
    """docs: (doc_id, text) -> list of (doc_id, n_features, weight, score, rank)"""
    import math

    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        return len(w), [crc(" ".join(w[p : p + n])) % buckets for n in range(1, longest + 1) for p in range(len(w) - n + 1)]

    s, t = (Counter(b for x in texts for b in features(x)[1]) for texts in ([x for _, x in docs], target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    scored = []
    for i, x in docs:
        n, f = features(x)
        h = int(sha(f"{seed}:{'' if i is None else i}")[:8], 16)
        weight = sum(map(gain, f)) // len(f) if f else 0
        scored.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in scored if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in scored]
