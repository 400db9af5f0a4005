"""Plain versions of the contracts, to test against."""

from __future__ import annotations

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
KINDS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in KINDS.items():
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def quality_base(text):
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    at: dict[tuple, list[int]] = {}
    for i in range(n - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + 8)}
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def shingles(text, size=5):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def near_components(rows, percent=85):
    """rows: (id, text) -> {row number: smallest id reachable}."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    groups: dict[int, list] = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return [min(groups[find(i)]) for i in range(len(rows))]


LATIN = str.maketrans({chr(c): chr(c + 32) for c in [*range(65, 91), *(c for c in range(0xC0, 0xDF) if c != 0xD7)]})
CAPITAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZ") | {chr(c) for c in range(0xC0, 0xDF) if c != 0xD7}


def canonical(text, units, name_words=3):
    """(words lower-cased, tokens as (literal or kind, value)) of a text, word by word."""
    found = list(re.finditer(r"[0-9A-Za-z\x80-\U0010FFFF]+", text or ""))
    words = [m[0].translate(LATIN) for m in found]
    upper = [m[0][0] in CAPITAL for m in found]
    kinds = []
    for i, m in enumerate(found):
        if re.fullmatch("[0-9]+", m[0]):
            kinds.append("<num>")
        elif i and kinds[i - 1] == "<num>" and words[i] in units:
            kinds.append("<unit>")
        else:
            a, b = i, i + 1
            while upper[i] and a and upper[a - 1]:
                a -= 1
            while upper[i] and b < len(found) and upper[b]:
                b += 1
            inside = i > 0 and not re.search(r'[.!?:;\n\r"]', text[found[i - 1].end() : m.start()])
            kinds.append("<name>" if upper[i] and b - a <= name_words and inside else None)
    tokens, start = [], 0
    for i, m in enumerate(found):
        if tokens and kinds[i] in ("<num>", "<name>") and kinds[i] == kinds[i - 1]:
            tokens[-1] = (kinds[i], text[start : m.end()].translate(LATIN))
            continue
        start = m.start()
        tokens.append((kinds[i], m[0].translate(LATIN)))
    return words, tokens


def template_hits(text, item, window=8, least=5, literal=4):
    """(diagonal, place, slots as (place, the item's value, the text's)) of equal windows of tokens."""
    size = min(window, len(item))
    plain = lambda ts: [t[0] or t[1] for t in ts]
    out = []
    for p in range(len(item) - size + 1 if len(item) >= least else 0):
        mine = item[p : p + size]
        if sum(t[0] is None for t in mine) < min(literal, size):
            continue
        for a in range(len(text) - size + 1):
            theirs = text[a : a + size]
            if plain(mine) == plain(theirs):
                out.append((a - p, p, [(p + k, x[1], y[1]) for k, (x, y) in enumerate(zip(mine, theirs, strict=True)) if x[0]]))
    return out


def literal_hits(text, item, window=8):
    size = min(window, len(item))
    return [(a - p, p, []) for p in range(len(item) - size + 1 if item else 0) for a in range(len(text) - size + 1) if text[a : a + size] == item[p : p + size]]


def windows_of(n, size=8):
    return max(0, n - min(size, n) + 1) if n else 0


def leak(text, item, units, ascending, runs, coverage=0.4, drift=4):
    """The best share of an item's windows that a text holds, or None. ascending, runs: how hits of several diagonals are joined."""
    (tw, tt), (iw, it) = canonical(text, units), canonical(item, units)
    some = sum(1 for p in range(windows_of(len(it))) if sum(t[0] is None for t in it[p : p + min(8, len(it))]) >= min(4, len(it)))

    def consistent(hits):
        forth, back = {}, {}
        return all(forth.setdefault(x, y) == y and back.setdefault(y, x) == x for h in hits for _, x, y in h[2])

    def share(hits, total):
        if not consistent(hits):
            hits = [h for h in hits if all(x == y for _, x, y in h[2])]
        return len({p for _, p, _ in hits}) / total if hits else 0

    best = 0
    every = [(sorted(template_hits(tt, it), key=lambda h: h[0]), some), (sorted(literal_hits(tw, iw), key=lambda h: h[0]), windows_of(len(iw)))]
    for hits, total in every:
        group = []
        for h, after in zip(hits, [*hits[1:], None], strict=False):
            group.append(h)
            if after is None or after[0] - h[0] > drift:
                best, group = max(best, share(group, total)), []
    if best >= coverage:
        return best
    joined = [share(ascending(hits), total) for hits, total in every if hits]
    if max(joined, default=0) >= coverage:
        return max(joined)
    return max((share(run, total) for hits, total in every for run in runs(hits)), default=None)
