"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

import regex

SPACES = r"[^\x20\x09-\x0D]+"


def words(text: str | None) -> list[str]:
    return re.findall(SPACES, text or "")


def quality(text: str | None) -> dict:
    text = text or ""
    w = words(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(windows)
    covered = {i + j for i, g in enumerate(windows) if often[g] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if words(x)]
    out = {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }
    out["base_failed"] = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    out["kept"] = not (
        out["base_failed"]
        or out["n_symbols"] > len(w)
        or 100 * out["n_dup_lines"] > 30 * len(lines)
        or out["word_chars"] < 2 * len(w)
        or out["word_chars"] > 40 * len(w)
    )
    return out


def shingles(text: str | None, n: int = 5) -> set[tuple[str, ...]]:
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = words(lower)
    if not w:
        return set()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def joined(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    """(id, set size, component) of each row."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * len(a | sets[j]):
                up[root(i)] = root(j)
    groups = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        groups[root(i)].append(key)
    least = {r: min((k for k in ids if k is not None), default=None) for r, ids in groups.items()}
    return [(key, len(s), least[root(i)]) for i, ((key, _), s) in enumerate(zip(rows, sets, strict=True))]


def allocate(tree: dict, budget: int, weights: list[dict], epochs: int, depth: int = 0) -> dict:
    """Quota by path; a tree's leaves are token counts. Shares are exact; rounding as documented."""

    def capacity(node) -> int:
        return epochs * node if isinstance(node, int) else sum(map(capacity, node.values()))

    weight = {c: weights[depth].get(c, 1) for c in tree}
    quota = {c: 0 for c in tree}
    open_ = sorted(c for c in tree if weight[c] > 0)
    left = budget
    while open_:
        total = sum(weight[c] for c in open_)
        full = [c for c in open_ if Fraction(left * weight[c], total) >= capacity(tree[c])]
        if not full:
            up = 0
            for c in open_:
                quota[c] = (up + weight[c]) * left // total - up * left // total
                up += weight[c]
            break
        for c in full:
            quota[c] = capacity(tree[c])
            left -= quota[c]
        open_ = [c for c in open_ if c not in full]
    out = {}
    for c, node in ((c, n) for c, n in tree.items() if weight[c] > 0):
        if isinstance(node, int):
            out[(c,)] = quota[c]
        else:
            deeper = allocate(node, quota[c], weights, epochs, depth + 1)
            out |= {(c, *path): q for path, q in deeper.items()}
    return out


def mixture(rows: list[tuple], weights: list[dict], percent: int, epochs: int, seed: int) -> Counter:
    """Copies by (id, levels, tokens) of rows (id, (domain, language, source), tokens)."""
    tree: dict = {}
    for _, (a, b, c), tokens in rows:
        leaf = tree.setdefault(a, {}).setdefault(b, {})
        leaf[c] = leaf.get(c, 0) + tokens
    quotas = allocate(tree, sum(r[2] for r in rows) * percent // 100, weights, epochs) if rows else {}
    copies: Counter = Counter()
    for path, quota in quotas.items():
        mine = [r for r in rows if r[1] == path]
        total = sum(r[2] for r in mine)
        full, rest = divmod(quota, total) if total else (1, 0)
        digest = {r: hashlib.md5(f"{seed}|{full}|{'' if r[0] is None else r[0]}".encode()).hexdigest() for r in mine}
        up = 0
        for d in sorted(set(digest.values())):
            peers = [r for r in mine if digest[r] == d]
            up += sum(r[2] for r in peers)
            for r in peers:
                copies[r] += full + (0 < rest and up <= rest)
    return +copies


def best_fit(lengths: list[int], capacities: tuple[int, ...], cost) -> tuple[list[tuple[int, int]], list[int]]:
    bins: list[list[int]] = []  # room, used, stamp of the last change
    places, clock, left = [], 0, sum(lengths)
    for length in lengths:
        clock += 1
        fitting = [i for i, b in enumerate(bins) if b[0] >= length]
        if fitting:
            i = min(fitting, key=lambda i: (bins[i][0], bins[i][2]))
        else:
            c = min((c for c in sorted(capacities) if c >= length), key=lambda c: (Fraction(cost(c), min(c, left)), c))
            bins.append([c, 0, 0])
            i = len(bins) - 1
        places.append((i, bins[i][1]))
        bins[i] = [bins[i][0] - length, bins[i][1] + length, clock]
        left -= length
    return places, [min(c for c in capacities if c >= b[1]) for b in bins]


PERSONAL = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits: str) -> bool:
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def personal(text: str | None) -> list[tuple[int, int, int, str]]:
    """(start, rank, end, kind) of the pattern spans."""
    out = []
    for rank, (kind, pattern) in enumerate(PERSONAL.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")),
                "card": 12 <= len(digits) <= 19 and _luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def span_list(spans: list[tuple[int, int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)


SECRETS = {
    "assign": r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}


def secrets(text: str | None) -> list[tuple[int, int, int, str]]:
    """(start, rank, end, kind) of the pattern spans."""
    out = []
    for rank, (kind, pattern) in enumerate(SECRETS.items()):
        pattern = pattern.replace("(?ai:", "(?i:")
        for m in re.finditer(pattern, text or "", re.ASCII):
            size = len(m.group(1)) if kind == "assign" else len(m.group())
            if size >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def disclosed(texts: list[str], z: float, generalise: float, remove: float) -> dict[int, set]:
    """(kind, start, stop) of the terms that give personal data away, by document.

    Every pair of an entity and a term is judged; equal texts are different documents.
    """
    entities, words = {}, {}
    for i, text in enumerate(texts):
        spans = personal(text)
        entities[i] = {(kind, text[start:stop].lower()) for start, _, stop, kind in spans}
        found = [(m.start(), m.end(), m.group().lower()) for m in regex.finditer(r"[\p{L}\p{M}\p{N}]++", text)]
        words[i] = [w for w in found if not any(s[0] < w[1] and w[0] < s[2] for s in spans)]
    total = len(texts)
    having = {}
    for i in words:
        for _, _, term in words[i]:
            having.setdefault(term, set()).add(i)
    held = {}
    for i, found in entities.items():
        for entity in found:
            held.setdefault(entity, set()).add(i)

    def strength(entity, term):
        hits, n = len(held[entity] & having[term]), len(having[term])
        p = hits / n
        low = (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
        share = len(held[entity]) / total
        return math.log2(low / share) / -math.log2(share) if hits and low > 0 else -math.inf

    judged = {(e, t): strength(e, t) for e in held for t in having if held[e] & having[t]}
    out = {i: set() for i in words}
    for i in words:
        for start, stop, term in words[i]:
            own = [judged[e, term] for e in entities[i]]
            # What is removed for an entity goes wherever it stands.
            wide = [v for (e, t), v in judged.items() if t == term and v >= remove]
            best = max([*own, *wide], default=-math.inf)
            if best >= generalise:
                out[i].add(("remove" if best >= remove else "generalise", start, stop))
    return out
