"""Byte-pair merging for SentencePiece BPE models, with heaps and linked lists, for many short segments at once.

A text (with its dummy prefix and spaces as U+2581) falls into segments: no piece of the vocabulary holds the two
characters at a segment's edge side by side, so merges never cross it. Equal segments of a slice are worked once.

Counting takes each segment through a binary heap and a linked list, and keeps the counts of up to STORE segments. Encoding
keeps the symbols of short segments in linked lists of one common array; each turn pops the lowest-ranked adjacent pair
(leftmost of equals) of every segment that still has one. Its long segments go through a heap as well.

A keyed hash can skip merges: each candidate (key of the segment's occurrence, place of its first character, resulting piece)
is skipped or not by a hash of just these, however the candidates are visited. An occurrence's key comes from its text's key
and its place in the text. Equal segments share their work only where none of the candidates is skipped.
"""

from __future__ import annotations

import heapq

import numpy as np

from tidewater.llm import kernel

U = np.uint64
NONE = np.int64(1) << np.int64(62)
LONG = 48
#: Symbols that are merged at once under keys.
PART = 1 << 18
#: Segments whose counts a worker process keeps.
STORE = 500_000
UNDER = "▁"
_C1, _C2, _C3 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
_M = (1 << 64) - 1


class Model:
    """Pieces, ranks, pair table and byte pieces of a .model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("a BPE model with byte fallback and without normalisation is needed")
        self.prefix = bool(proto.normalizer_spec.add_dummy_prefix)
        self.pieces = [p.piece for p in proto.pieces]
        normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (1, 4)}
        score = {i: proto.pieces[i].score for i in normal.values()}
        by_score = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.byte_ids = np.zeros(256, np.int64)
        for i, p in enumerate(proto.pieces):
            if p.type == 6:
                self.byte_ids[int(p.piece[3:5], 16)] = i
        chars = sorted({c for p in normal for c in p})
        # symbols: piece numbers; characters of pieces that are no pieces get numbers above; 0 is any other character
        self.of_char = np.zeros(0x110000, np.int32)
        extra = len(self.pieces)
        symbol = dict(normal)
        for c in chars:
            if c not in symbol:
                symbol[c], extra = extra, extra + 1
            self.of_char[ord(c)] = symbol[c]
        self.spell = {v: k for k, v in symbol.items()}
        self.n_symbols = extra
        self.is_piece = np.zeros(extra, bool)
        self.is_piece[list(normal.values())] = True
        pairs = {}
        bigrams = set()
        for p, i in normal.items():
            for k in range(1, len(p)):
                bigrams.add((p[k - 1], p[k]))
                if p[:k] in symbol and p[k:] in symbol:
                    pairs[symbol[p[:k]] * extra + symbol[p[k:]]] = (by_score[score[i]], i)
        # character classes of the bigram table
        self.char_class = np.zeros(0x110000, np.int32)
        self.char_class[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.classes = len(chars) + 1
        bits = np.zeros(self.classes * self.classes, bool)
        a = self.char_class[[ord(x) for x, _ in bigrams]].astype(np.int64)
        b = self.char_class[[ord(y) for _, y in bigrams]].astype(np.int64)
        bits[a * self.classes + b] = True
        self.bigrams = np.packbits(bits, bitorder="little")
        # open addressing: pair -> rank and piece
        self.bits = max(10, (4 * len(pairs)).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.values = np.zeros((size, 2), np.int32)
        for k, (rank, piece) in pairs.items():
            at = self._slot(k)
            while self.keys[at] >= 0:
                at = (at + 1) & (size - 1)
            self.keys[at], self.values[at] = k, (rank, piece)
        self.pairs = pairs
        self.counted: dict[int, int] = {}
        spelled = [b"" if p.type in (2, 3) else bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.replace(UNDER, " ").encode() for p in proto.pieces]
        self.piece_len = np.array([len(x) for x in spelled], np.int64)
        self.piece_at = np.concatenate([[0], np.cumsum(self.piece_len)[:-1]])
        self.piece_bytes = np.frombuffer(b"".join(spelled), np.uint8)

    def _slot(self, key: int) -> int:
        return ((key * _C1) & _M) >> (64 - self.bits)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank or -1, piece) of pairs of symbols."""
        key = left.astype(np.int64) * self.n_symbols + right
        at = ((key.view(U) * U(_C1)) >> U(64 - self.bits)).astype(np.int64)
        found = self.keys[at]
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            found[open_] = self.keys[at[open_]]
            open_ = open_[(found[open_] != key[open_]) & (found[open_] >= 0)]
        hit = found == key
        value = self.values[at]
        return np.where(hit, value[:, 0], -1).astype(np.int64), value[:, 1]


def skip_hash(key, place, piece):
    """32 bits for one candidate merge; key, place, piece: integers or equally long arrays of uint64."""
    if isinstance(key, int):
        x = (key ^ (place * _C2 & _M) ^ (piece * _C3 & _M)) & _M
        x = ((x ^ (x >> 29)) * _C1) & _M
        return ((x ^ (x >> 32)) * _C3 & _M) >> 32
    x = key ^ (place * U(_C2)) ^ (piece * U(_C3))
    x = (x ^ (x >> U(29))) * U(_C1)
    return ((x ^ (x >> U(32))) * U(_C3)) >> U(32)


def merge_one(model: Model, symbols: list[int], key: int = 0, below: int = 0) -> tuple[list[int], list[int], int]:
    """One segment by a heap and a linked list. (symbols left, their first characters, number of merges)."""
    n, sym = len(symbols), list(symbols)
    prev, nxt = list(range(-1, n - 1)), [*range(1, n), -1]
    heap, pairs, wide, merges = [], model.pairs, model.n_symbols, 0

    def push(i, j):
        found = pairs.get(sym[i] * wide + sym[j])
        if found:
            heapq.heappush(heap, (found[0], i, j, sym[i], sym[j], found[1]))

    for i in range(n - 1):
        push(i, i + 1)
    while heap:
        _, i, j, a, b, piece = heapq.heappop(heap)
        if sym[i] != a or sym[j] != b or nxt[i] != j:
            continue
        if below and skip_hash(key, i, piece) < below:
            continue
        sym[i], sym[j], merges = piece, -1, merges + 1
        nxt[i] = nxt[j]
        if nxt[j] >= 0:
            prev[nxt[j]] = i
            push(i, nxt[j])
        if prev[i] >= 0:
            push(prev[i], i)
    left = [i for i in range(n) if sym[i] >= 0]
    return [sym[i] for i in left], left, merges


def merge_many(model: Model, symbols: np.ndarray, starts: np.ndarray, keys: np.ndarray | None = None, below: int = 0, met: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Segments one after another, `starts` with one offset more than segments. Returns (symbols with -1 where merged away, merges by segment).

    keys and below: the key of each segment, and the bound under which a candidate's hash skips it. met gets (segment, place, piece) of the short segments' candidates."""
    sym = symbols.astype(np.int64)
    count = np.zeros(len(starts) - 1, np.int64)
    length = np.diff(starts)
    for s in np.flatnonzero(length > LONG).tolist():
        a, b = int(starts[s]), int(starts[s + 1])
        left, at, count[s] = merge_one(model, sym[a:b].tolist(), int(keys[s]) if keys is not None else 0, below)
        sym[a:b] = -1
        sym[a + np.array(at)] = left
    live = np.flatnonzero((length > 1) & (length <= LONG))
    if not len(live):
        return sym, count
    # the short segments in arrays of their own; one slot of each segment's list ends it
    size = length[live]
    first = np.concatenate([[0], np.cumsum(size)])
    total = int(first[-1])
    seg = np.repeat(np.arange(len(live)), size)
    place = np.arange(total) - first[seg]
    source = starts[live][seg] + place
    cur = sym[source]
    nxt = np.arange(1, total + 1)
    nxt[first[1:] - 1] = -1
    prev = np.arange(-1, total - 1)
    prev[first[:-1]] = -1
    own = keys[live].astype(U) if keys is not None else None

    def rate(i: np.ndarray) -> np.ndarray:
        """Rank and place of the pair that begins at each slot, NONE if there is none to merge."""
        out = np.full(len(i), NONE)
        j = nxt[i]
        has = np.flatnonzero(j >= 0)
        rank, piece = model.lookup(cur[i[has]], cur[j[has]])
        ok = rank >= 0
        if met is not None:
            met.append((live[seg[i[has[ok]]]], place[i[has[ok]]], piece[ok]))
        if below:
            ok[ok] = skip_hash(own[seg[i[has[ok]]]], place[i[has[ok]]].astype(U), piece[ok].astype(U)) >= U(below)
        at = has[ok]
        out[at] = rank[ok] * (LONG + 1) + place[i[at]]
        return out

    best = rate(np.arange(total))
    heads, width, where = first[:-1].copy(), size.copy(), live
    slots = np.arange(total)
    while True:
        low = np.minimum.reduceat(best[slots], np.concatenate([[0], np.cumsum(width)[:-1]]))
        act = low < NONE
        if not act.all():
            keep = np.repeat(act, width)
            slots, heads, width, where, low = slots[keep], heads[act], width[act], where[act], low[act]
            if not len(heads):
                break
        i = heads + low % (LONG + 1)
        j = nxt[i]
        _, piece = model.lookup(cur[i], cur[j])
        cur[i] = piece
        cur[j] = -1
        best[j] = NONE
        after = nxt[j]
        nxt[i] = after
        has = after >= 0
        prev[after[has]] = i[has]
        best[i] = rate(i)
        p = prev[i]
        p = p[p >= 0]
        best[p] = rate(p)
        count[where] += 1
    sym[source] = cur
    return sym, count


class Cut:
    """Segments of texts. symbols, starts: segments one after another; row: the text of each; code points as uint32."""

    def __init__(self, model: Model, texts: list[str], literal: bool = False):
        """literal: U+2581 of a text stays itself (spelled in bytes) instead of standing for a space as the library has it."""
        prefix = UNDER if model.prefix else ""
        joined = [prefix + t.replace(" ", UNDER) if t else "" for t in texts]
        lens = np.array([len(t) for t in joined], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(lens)])
        self.points = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = model.of_char[self.points]
        kind = model.char_class[self.points].astype(np.int64)
        for k in [k for k, t in enumerate(texts) if UNDER in t] if literal else []:
            at = int(self.offsets[k]) + len(prefix) + np.array([i for i, c in enumerate(texts[k]) if c == UNDER])
            symbols[at], kind[at] = 0, 0
        n = len(symbols)
        cut = np.ones(n + 1, bool)
        if n > 1:
            pair = kind[:-1] * model.classes + kind[1:]
            cut[1:-1] = (model.bigrams[pair >> 3] >> (pair & 7).astype(np.uint8)) & 1 == 0
        cut[self.offsets] = True
        self.symbols = symbols
        self.starts = np.flatnonzero(cut)
        if not n:
            self.starts = np.zeros(1, np.int64)
        self.row = np.searchsorted(self.offsets, self.starts[:-1], side="right") - 1
        sums = np.zeros(n + 1, U)
        np.cumsum((self.points.astype(U) + U(7) + (symbols == 0)) * kernel.powers(kernel._P, n)[:n], out=sums[1:])
        a, b = self.starts[:-1], self.starts[1:]
        self.hash = kernel.mix((sums[b] - sums[a]) * kernel.powers(kernel._P_INV, n)[a] + (b - a).astype(U) * kernel._Q)

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """(a segment of each kind, the kind of each segment)."""
        _, some, kind = np.unique(self.hash, return_index=True, return_inverse=True)
        return some, kind

    def gather(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, starts) of chosen segments put one after another, and their symbols."""
        a, size = self.starts[:-1][some], np.diff(self.starts)[some]
        starts = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(int(starts[-1])) - np.repeat(starts[:-1], size) + np.repeat(a, size)
        return at, starts, self.symbols[at]


def byte_lengths(points: np.ndarray) -> np.ndarray:
    return 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)


_models: dict[str, Model] = {}


def load(path: str) -> Model:
    """The model of a path, read once a process."""
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def count_segment(model: Model, symbols: np.ndarray, points: np.ndarray) -> int:
    """Tokens of one segment: symbols less merges, where a character that stays outside all pieces counts its UTF-8 bytes."""
    left, at, merges = merge_one(model, symbols.tolist())
    left = np.array(left)
    alone = np.array(at)[~model.is_piece[left] | (left == 0)]
    return len(symbols) - merges + int((byte_lengths(points[alone]) - 1).sum())


def count_tokens(model: Model, texts: list[str]) -> np.ndarray:
    """Tokens of each text. No identifiers are made."""
    cut = Cut(model, texts)
    if len(cut.starts) < 2:
        return np.zeros(len(texts), np.int64)
    some, kind = cut.distinct()
    known, each = model.counted, np.empty(len(some), np.int64)
    for k, (h, s) in enumerate(zip(cut.hash[some].tolist(), some.tolist(), strict=True)):
        n = known.get(h)
        if n is None:
            a, b = cut.starts[s], cut.starts[s + 1]
            n = count_segment(model, cut.symbols[a:b], cut.points[a:b])
            if len(known) >= STORE:
                known.clear()
            known[h] = n
        each[k] = n
    return np.bincount(cut.row, weights=each[kind], minlength=len(texts)).astype(np.int64)


def skips(kind: np.ndarray, n_kinds: int, met: list, keys: np.ndarray, below: int) -> np.ndarray:
    """Which occurrences have a skipped candidate among those of their kind (segment, place, piece)."""
    of_kind, place, piece = (np.concatenate(x) for x in zip(*met, strict=True)) if met else (np.zeros(0, np.int64),) * 3
    order = np.argsort(of_kind, kind="stable")
    place, piece = place[order].astype(U), piece[order].astype(U)
    first = np.searchsorted(of_kind[order], np.arange(n_kinds + 1))
    n = np.diff(first)[kind]
    out = np.zeros(len(kind), bool)
    ends = np.cumsum(n)
    for lo, hi in parts(n):
        own = np.repeat(np.arange(lo, hi), n[lo:hi])
        c = np.arange(len(own)) - (ends[own] - n[own] - (ends[lo] - n[lo])) + first[kind[own]]
        out[own[skip_hash(keys[own], place[c], piece[c]) < U(below)]] = True
    return out


def parts(sizes: np.ndarray):
    """Bounds of runs of items whose sizes add up to PART at most, one item at least."""
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PART, side="right")))
        yield lo, hi
        lo = hi


def encode(model: Model, texts: list[str], keys: np.ndarray | None = None, below: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(token ids of all texts, offsets of texts). keys: uint64 of each text; below: of 2**32, the bound under which merges are skipped.

    The key of a segment's occurrence comes from its text's key and its place among the segments. A kind of segment is worked
    once a slice for the occurrences without a skipped candidate, whose merges are then those without keys; each other
    occurrence is worked by itself."""
    cut = Cut(model, texts, literal=True)
    if len(cut.starts) < 2:
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    some, kind = cut.distinct()
    at, starts, symbols = cut.gather(some)
    met: list | None = [] if below else None
    left, _ = merge_many(model, symbols, starts, met=met)
    if below:
        ordinal = np.arange(len(cut.row)) - np.searchsorted(cut.row, cut.row)
        seg_keys = kernel.mix(keys[cut.row] + ordinal.astype(U) * U(_C3))
        length = np.diff(cut.starts)
        own = np.flatnonzero((length > LONG) | skips(kind, len(some), met, seg_keys, below))
        kind[own] = len(some) + np.arange(len(own))
        ats, lefts, lens = [at], [left], [np.diff(starts)]
        for lo, hi in parts(length[own]):
            at, starts, symbols = cut.gather(own[lo:hi])
            ats.append(at)
            lefts.append(merge_many(model, symbols, starts, seg_keys[own[lo:hi]], below)[0])
            lens.append(np.diff(starts))
        at, left = np.concatenate(ats), np.concatenate(lefts)
        starts = np.concatenate([[0], np.cumsum(np.concatenate(lens))])
    # the ids of each kind
    keep = np.flatnonzero(left >= 0)
    ids, points = left[keep], cut.points[at[keep]]
    alone = ~model.is_piece[ids] | (ids == 0)
    size = np.where(alone, byte_lengths(points), 1)
    out = np.repeat(ids, size)
    to = np.concatenate([[0], np.cumsum(size)])
    spots = np.flatnonzero(alone)
    if len(spots):
        raw = np.frombuffer("".join(map(chr, points[spots].tolist())).encode("utf-8", "surrogatepass"), np.uint8)
        n = size[spots]
        where = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(to[:-1][spots], n)
        out[where] = model.byte_ids[raw]
    kind_at = to[np.searchsorted(keep, starts)]
    kind_len = np.diff(kind_at)
    # the ids of each occurrence
    n = kind_len[kind]
    ends = np.cumsum(n)
    place = np.arange(int(ends[-1])) - np.repeat(ends - n, n) + np.repeat(kind_at[:-1][kind], n)
    of = np.concatenate([[0], ends])[np.searchsorted(cut.row, np.arange(len(texts) + 1))]
    return out[place], of


def decode(model: Model, ids: np.ndarray, of: np.ndarray) -> list[bytes]:
    """UTF-8 bytes of each text, without the dummy prefix."""
    n = model.piece_len[ids]
    ends = np.cumsum(n)
    place = np.arange(int(ends[-1]) if len(n) else 0) - np.repeat(ends - n, n) + np.repeat(model.piece_at[ids], n)
    data = model.piece_bytes[place].tobytes()
    at = np.concatenate([[0], ends])[of].tolist()
    cut = 1 if model.prefix else 0
    return [data[a + cut : b] if b > a else b"" for a, b in zip(at[:-1], at[1:], strict=True)]
