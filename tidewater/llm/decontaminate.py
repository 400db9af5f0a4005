"""Benchmark decontamination by template canonicalisation.

Texts become canonical tokens: words (Latin letters lower-cased, punctuation dropped), with typed placeholders for numbers (<num>),
units after a number (<unit>) and names (<name>: runs of up to NAME_WORDS capitalised words inside a sentence); neighbouring numbers, and
neighbouring names, are one slot. Windows of WINDOW tokens with LITERAL words at least are hash-joined with those of the
benchmark items. Hits of a text and an item that lie on one diagonal (within DRIFT tokens) are a match if they cover
`coverage` of the item's windows and the slots are consistent: equal values of the item have equal values in the text, and
different ones different. So a question with other numbers, names or units is caught, and a text that only shares its
template is not. Where slots are not consistent, the windows whose slots are unchanged must reach the coverage alone: a copy
stays one if a word after its end runs into its last slot.

Besides, every item is held word for word: its windows of WINDOW words, or all its words if they are fewer, without slots and
without a least number of literal words. Hits of these are grouped and covered likewise; nothing in them can have changed.

Hits of several diagonals count together where their places ascend in the text and in the item alike: a copy with insertions
or deletions. RUN windows at consecutive places of one diagonal are a match whatever they cover of the item.

Items that differ in the values of their slots only (re-parameterised copies of one question, or equal items) are one class:
its windows without slots, and its template windows, are held once, and a document has one row a class, for the item of the
class that it matches best. classes() gives the class of each item.

The benchmark is the query set: it is worked in blocks of at most BLOCK windows, each of which one pass over the texts
takes along, whatever its size.

Defined results: null texts are empty and match nothing; items shorter than WINDOW tokens are one window of their own length,
those under MIN_TOKENS word for word only; items without a word, and items with a null id, match nothing. Rows with equal ids are judged each and give a row each where they
match. Empty tables give an empty result.
"""

from __future__ import annotations

import bisect

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import kernel
from tidewater.llm.common import fresh, lean, materialise, within
from tidewater.session import ready

WINDOW, MIN_TOKENS, LITERAL, DRIFT, NAME_WORDS = 8, 5, 4, 4, 3
#: Windows at consecutive places of an item that are a match whatever the item's length.
RUN = 13
#: Windows of a block of the benchmark.
BLOCK = 500_000
#: Unit names.
UNITS = (
    "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams ounce ounces oz pound pounds lb lbs ton tons "
    "ml l liter liters litre litres gallon gallons second seconds sec minute minutes min hour hours day days week weeks month "
    "months year years percent dollar dollars usd euro euros eur cent cents degree degrees celsius fahrenheit mph kmh watt watts "
    "kw joule joules volt volts hz khz mhz ghz byte bytes kb mb gb tb"
)

_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[65:91] = _INSIDE[97:123] = _INSIDE[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = kernel.table(b".!?:;\n\r\"")
_MARK = {1: np.uint64(0xA5A5_0001), 2: np.uint64(0xA5A5_0002), 3: np.uint64(0xA5A5_0003)}
NUM, UNIT, NAME = 1, 2, 3


def _unit_hashes() -> np.ndarray:
    words = UNITS.split()
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    return np.sort(kernel.Hasher(data)(np.concatenate([[0], ends[:-1] + 1]), ends))


_UNIT_SET = _unit_hashes()


class Canon:
    """Canonical tokens of a string column. hash, kind (0: word), row, start, end by token; of: offsets of rows."""

    def __init__(self, column):
        raw, offsets = kernel.column_bytes(column)
        low = kernel.LOWER[raw]
        if len(raw) > 1:  # capitals of Latin-1, whose bytes differ in the second one
            low[1:][(raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)] += 0x20
        words = kernel.Runs(raw, offsets, _INSIDE[raw])
        self.raw = raw
        value = kernel.Hasher(low)(words.start, words.end)
        n = len(value)
        kind = np.zeros(n, np.int8)
        count = lambda mask: np.concatenate([[0], np.cumsum(mask)])
        digits, stops = count(_DIGIT[raw]), count(_STOP[raw])
        kind[digits[words.end] - digits[words.start] == words.end - words.start] = NUM
        if n:
            first = np.ones(n, bool)
            first[1:] = words.row[1:] != words.row[:-1]
            after_number = np.zeros(n, bool)
            after_number[1:] = kind[:-1] == NUM
            at = np.minimum(np.searchsorted(_UNIT_SET, value), len(_UNIT_SET) - 1)
            kind[after_number & ~first & (_UNIT_SET[at] == value)] = UNIT
            opens = np.ones(n, bool)
            opens[1:] = stops[words.start[1:]] - stops[words.end[:-1]] > 0
            lead = raw[words.start]
            second = raw[np.minimum(words.start + 1, len(raw) - 1)]
            upper = ((lead >= 65) & (lead <= 90)) | ((lead == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97))
            # in longer runs capitals are a style (headings, shouting), whatever the sentence
            edge = np.flatnonzero(np.concatenate([[True], (upper[1:] != upper[:-1]) | first[1:]]))
            run = np.repeat(np.diff(np.append(edge, n)), np.diff(np.append(edge, n)))
            kind[upper & (run <= NAME_WORDS) & ~opens & ~first & (kind == 0)] = NAME
            drop = np.zeros(n, bool)
            drop[1:] = (kind[1:] == kind[:-1]) & ((kind[1:] == NUM) | (kind[1:] == NAME)) & ~first[1:]
        else:
            drop = np.zeros(0, bool)
        keep = np.flatnonzero(~drop)
        self.kind, self.row, self.start = kind[keep], words.row[keep], words.start[keep]
        self.first, self.word, self.word_row, self.word_of = keep, value, words.row, words.of
        # a slot of several words ends where its last one does
        self.end = words.end[np.append(keep[1:], n) - 1] if n else words.end
        self.hash = np.where(self.kind == 0, value[keep], np.array([0, *_MARK.values()], np.uint64)[self.kind])
        self.of = np.searchsorted(self.row, np.arange(len(offsets)))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first token of each window with enough words of its own."""
        h, at = kernel.windows(self.hash, self.of, size)
        words = np.concatenate([[0], np.cumsum(self.kind == 0)])
        ok = words[at + size] - words[at] >= min(LITERAL, size)
        return h[ok], at[ok]

    def literal(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first word of each window of words as they stand."""
        return kernel.windows(self.word, self.word_of, size)

    def value_of(self, t: int) -> str:
        return self.raw[self.start[t] : self.end[t]].tobytes().decode("utf-8", "replace").lower()

    def slots(self, at: int, size: int) -> list[tuple[int, str]]:
        return [(t - at, self.value_of(t)) for t in range(at, at + size) if self.kind[t]]


class Table:
    """Windows by size and hash."""

    def __init__(self):
        self.entries: dict[int, dict[int, list]] = {}

    def add(self, size: int, key: int, entry: tuple):
        self.entries.setdefault(size, {}).setdefault(key, []).append(entry)

    def close(self) -> Table:
        self.keys = {s: np.array(sorted(by), np.uint64) for s, by in self.entries.items()}
        self.near = {}
        for s, keys in self.keys.items():
            self.near[s] = np.zeros(1 << 22, bool)
            self.near[s][(keys >> np.uint64(42)).astype(np.int64)] = True
        return self

    def hits(self, size: int, h: np.ndarray, at: np.ndarray):
        """(entries, place) of the windows that the table has."""
        keys = self.keys[size]
        maybe = self.near[size][(h >> np.uint64(42)).astype(np.int64)]
        h, at = h[maybe], at[maybe]
        hit = keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h
        for key, a in zip(h[hit].tolist(), at[hit].tolist(), strict=True):
            yield self.entries[size][key], a


def ascending(hits: list) -> list:
    """The most hits whose places ascend in the text and in the item alike, however far apart they are in the text."""
    ends, last, before = [], [], {}
    order = sorted(hits, key=lambda h: (h[0] + h[1], -h[1]))
    for i, (_, place, _) in enumerate(order):
        k = bisect.bisect_left(ends, place)
        before[i] = last[k - 1] if k else -1
        ends[k : k + 1], last[k : k + 1] = [place], [i]
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(order[i])
        i = before[i]
    return out[::-1]


def runs(hits: list):
    """Runs of RUN hits at consecutive places of one diagonal whose slots are consistent, each as long as that holds."""
    lines: dict[int, dict[int, tuple]] = {}
    for h in hits:
        lines.setdefault(h[0], {})[h[1]] = h
    for line in lines.values():
        run: list = []
        for place in sorted(line):
            if run and place != run[-1][1] + 1:
                if len(run) >= RUN:
                    yield run
                run = []
            run.append(line[place])
            if line[place][2] and not one_to_one(run):
                if len(run) > RUN:
                    yield run[:-1]
                while not one_to_one(run):
                    run = run[1:]
        if len(run) >= RUN:
            yield run


def one_to_one(group: list) -> bool:
    forth, back = {}, {}
    return all(forth.setdefault(mine, theirs) == theirs and back.setdefault(theirs, mine) == mine for _, _, pairs in group for _, mine, theirs in pairs)


def slots_of(canon: Canon, items: int) -> tuple[np.ndarray, list[list[int]], list[dict[int, str]]]:
    """(which words slots take, the places of these by item, slots' values by item and token)."""
    words: list[list[int]] = [[] for _ in range(items)]
    values: list[dict[int, str]] = [{} for _ in range(items)]
    inside = np.zeros(len(canon.word) + 1, bool)
    ends = np.append(canon.first[1:], len(canon.word))
    for t in np.flatnonzero(canon.kind).tolist():
        r = int(canon.row[t])
        a, b = int(canon.first[t]), int(min(ends[t], canon.word_of[r + 1]))
        inside[a:b] = True
        words[r].append(a - int(canon.word_of[r]))
        values[r][t - int(canon.of[r])] = canon.value_of(t)
    return inside, words, values


def class_key(canon: Canon, inside: np.ndarray, r: int, values: dict[int, str]) -> tuple:
    """What items of one class have in common: words outside slots, slots at the same words, and equal slots at the same places."""
    a, b = int(canon.word_of[r]), int(canon.word_of[r + 1])
    order: dict[str, int] = {}
    pattern = tuple((place, order.setdefault(v, len(order))) for place, v in sorted(values.items()))
    kinds = canon.kind[int(canon.of[r]) : int(canon.of[r + 1])].tobytes()
    return np.where(inside[a:b], np.uint64(0), canon.word[a:b]).tobytes(), kinds, pattern


def _class_codes(batches):
    """item_id, text and a hash of the item's class."""
    import hashlib

    import pyarrow as pa

    for batch in batches:
        canon = Canon(pa.array([t or "" for t in batch.column(1).to_pylist()], pa.string()))
        inside, _, values = slots_of(canon, batch.num_rows)
        codes = [hashlib.sha256(repr(class_key(canon, inside, r, values[r])).encode()).hexdigest() for r in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.string())], names=["item_id", "text", "code"])


class Index:
    """Windows of some benchmark items by hash: what a pass over the texts takes along."""

    def __init__(self, items: list[tuple[int, str]]):
        import pyarrow as pa

        canon = Canon(pa.array([t or "" for _, t in items], pa.string()))
        lens, words = np.diff(canon.of), np.diff(canon.word_of)
        self.ids = [i for i, _ in items]
        #: words that slots take, by item, and slots' values by item and token
        inside, self.slot_words, self.values = slots_of(canon, len(items))
        self.same = self._classes(canon, inside)
        self.size = np.bincount(self.same, minlength=len(items))
        self.total: dict[int, int] = {}
        self.templates, self.literals = Table(), Table()
        first = lambda r: self.same[r] == r
        for size in sorted({int(min(x, WINDOW)) for x in lens.tolist() if x >= MIN_TOKENS}):
            h, at = canon.windows(size)
            for key, a in zip(h.tolist(), at.tolist(), strict=True):
                r = int(canon.row[a])
                if first(r) and min(int(lens[r]), WINDOW) == size:
                    self.total[r] = self.total.get(r, 0) + 1
                    self.templates.add(size, key, (r, a - int(canon.of[r])))
        slots = np.concatenate([[0], np.cumsum(inside)])
        for size in sorted({int(min(x, WINDOW)) for x in words.tolist() if x}):
            h, at = canon.literal(size)
            for key, a in zip(h.tolist(), at.tolist(), strict=True):
                r = int(canon.word_row[a])
                shared = slots[a + size] == slots[a]  # all items of the class have it
                if (first(r) or not shared) and min(int(words[r]), WINDOW) == size:
                    self.literals.add(size, key, (r, a - int(canon.word_of[r]), bool(shared)))
        self.words = words.tolist()
        self.templates.close()
        self.literals.close()

    def _classes(self, canon: Canon, inside: np.ndarray) -> np.ndarray:
        """The first item of each item's class."""
        known: dict[tuple, int] = {}
        return np.array([known.setdefault(class_key(canon, inside, r, self.values[r]), r) for r in range(len(self.ids))], np.int64)

    def matches(self, column, coverage: float):
        """(row, item, class, items of the class, windows found, coverage, slots, changed slots) of one string column: one a row and class."""
        canon = Canon(column)
        found: dict[tuple[int, int], tuple[list, list, dict]] = {}
        of = lambda row, item: found.setdefault((row, int(self.same[item])), ([], [], {}))
        for size in self.templates.entries:
            for entries, a in self.templates.hits(size, *canon.windows(size)):
                row, mine = int(canon.row[a]), canon.slots(a, size)
                for item, place in entries:
                    of(row, item)[0].append((a - int(canon.of[row]) - place, place, mine))
        for size in self.literals.entries:
            for entries, a in self.literals.hits(size, *canon.literal(size)):
                row = int(canon.word_row[a])
                for item, place, shared in entries:
                    got = of(row, item)
                    own = got[1] if shared else got[2].setdefault(item, [])
                    own.append((a - int(canon.word_of[row]) - place, place, []))
        for (row, first), (templates, shared, own) in sorted(found.items()):
            best = None
            for item in sorted({first, *own}):
                values = self.values[item]
                hits = [(d, place, [(place + k, values[place + k], theirs) for k, theirs in mine]) for d, place, mine in templates]
                got = self._best(item, hits, shared + own.get(item, []), coverage)
                if got and (best is None or (got[1], -got[3]) > (best[2], -best[4])):
                    best = (item, *got)
            if best:
                yield row, self.ids[best[0]], self.ids[first], int(self.size[first]), *best[1:]

    def _best(self, item: int, templates: list, literals: list, coverage: float):
        """The measures of the best group of hits of one text and one item."""
        judges = list(zip((templates, literals), (self._judge, self._literal), strict=True))
        best = None
        for hits, judge in judges:
            hits.sort(key=lambda x: x[0])
            group = []
            for i, h in enumerate(hits):
                group.append(h)
                if i + 1 == len(hits) or hits[i + 1][0] - h[0] > DRIFT:
                    got = judge(item, group)
                    if got and got[1] >= coverage and (best is None or (got[1], -got[3]) > (best[1], -best[3])):
                        best = got
                    group = []
        if not best:
            joined = [got for hits, judge in judges if (got := judge(item, ascending(hits))) and got[1] >= coverage]
            joined = joined or [got for hits, judge in judges for run in runs(hits) if (got := judge(item, run))]
            best = max(joined, key=lambda x: (x[1], -x[3]), default=None)
        return best

    def _literal(self, item: int, group: list):
        """The measures of windows that stand word for word."""
        places = {p for _, p, _ in group}
        size = min(self.words[item], WINDOW)
        slots = sum(any(w - k in places for k in range(size)) for w in self.slot_words[item])
        return len(places), len(places) / (self.words[item] - size + 1), slots, 0

    def _judge(self, item: int, group: list):
        """The group's measures if its slots are consistent; else those of its windows whose slots are all unchanged, which always are."""
        same = lambda h: all(mine == theirs for _, mine, theirs in h[2])
        return self._consistent(item, group) or self._consistent(item, [h for h in group if same(h)])

    def _consistent(self, item: int, group: list):
        places = {p for _, p, _ in group}
        forth, back, slots, changed = {}, {}, set(), set()
        for _, _, pairs in group:
            for at, mine, theirs in pairs:
                slots.add(at)
                if forth.setdefault(mine, theirs) != theirs or back.setdefault(theirs, mine) != mine:
                    return None
                if mine != theirs:
                    changed.add(at)
        if not places:
            return None
        return len(places), len(places) / self.total[int(self.same[item])], len(slots), len(changed)


_LEAK = {"item_id": "long", "class_id": "long", "n_items": "long", "n_windows": "long", "coverage": "double", "n_slots": "long", "n_changed": "long"}


def _scan(index, coverage: float):
    """index: broadcast of an Index."""

    def run(batches):
        import pyarrow as pa

        kinds = [pa.float64() if t == "double" else pa.int64() for t in _LEAK.values()]
        for whole in batches:
            for batch in within(whole):
                rows = list(index.value.matches(batch.column(1), coverage))
                take = pa.array([r[0] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds, 1))], names=["doc_id", *_LEAK])

    return run


def _blocks(benchmark: DataFrame, id: str, text: str):
    """Lists of (item id, text), each of about BLOCK tokens. All items of a class are in one block, so that results do not depend on the blocks."""
    items = benchmark.select(F.col(id).cast("long").alias("item_id"), F.col(text).alias("text")).where("item_id is not null").distinct()
    n = items.agg(F.sum(F.length(F.coalesce("text", F.lit(""))))).first()[0] or 0
    parts = max(1, -(-n // (BLOCK * 4)))
    if parts > 1:
        items = materialise(ready(items).mapInArrow(_class_codes, "item_id long, text string, code string"), "benchmark-classes")
        items = items.withColumn("part", F.pmod(F.xxhash64("code"), F.lit(parts)))
    for p in range(parts):
        own = items if parts == 1 else items.where(F.col("part") == p).select("item_id", "text")
        yield [tuple(r) for r in own.sort("item_id", "text").collect()]


def leaks(
    docs: DataFrame, benchmark: DataFrame, coverage: float = 0.4, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """doc_id, item_id, class_id, n_items, n_windows, coverage, n_slots, n_changed: a row for each document and class of items that it holds.

    item_id is the item of the class that fits best (the smallest of equals), class_id its smallest, n_items their number."""
    pick = ready(docs).select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    kind = pick.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{k} {t}" for k, t in _LEAK.items())
    out = None
    for items in _blocks(benchmark, item_id, item_text):
        index = docs.sparkSession.sparkContext.broadcast(Index(items))
        part = pick.mapInArrow(lean(_scan(index, coverage)), schema)
        out = part if out is None else out.unionAll(part)
    return out


def classes(benchmark: DataFrame, id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, class_id: the class of each item with a non-null id, as leaks() has them."""
    rows = []
    for items in _blocks(benchmark, id, text):
        index = Index(items)
        rows += [(i, index.ids[c]) for i, c in zip(index.ids, index.same.tolist(), strict=True)]
    return benchmark.sparkSession.createDataFrame(rows, "item_id long, class_id long")


def _filter(index, coverage: float):
    """Whole rows whose text, the last column, holds no item of the block."""

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            at = whole.num_columns - 1
            for batch in within(whole, 1 << 19, column=at):
                bad = {r[0] for r in index.value.matches(batch.column(at), coverage)}
                keep = pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_())
                yield batch.filter(keep).select(range(at))

    return run


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.4, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text holds no item."""
    out = ready(docs)
    (whole,) = fresh(docs.columns, "whole_text")
    for items in _blocks(benchmark, item_id, item_text):
        index = docs.sparkSession.sparkContext.broadcast(Index(items))
        out = out.select("*", F.col(text).alias(whole)).mapInArrow(lean(_filter(index, coverage)), docs.schema)
    return out
