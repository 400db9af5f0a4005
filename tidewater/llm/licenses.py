"""License scans: phrases, and an exact set-similarity join of text blocks with a table of license templates.

A template of n words is looked for in blocks of twice SIZE words, one each SIZE words, where SIZE is the least of 20, 40, 80,
... that n does not exceed; so every run of n words lies whole in a block. Blocks are cut from the whole text, whatever its
lines (notices that are wrapped), and from each line (those that only a window from a line's start holds). A template is
found in a block when the block's words contain at least `percent` of the template's distinct words. Notices of fewer than
SHORT words differ from one another in a word or two, so no share of them decides: for these the block is twice their own
length, must hold all their words, and must hold them in the template's order.

The join orders template words by their frequency in all documents (rarest first), looks only for blocks that hold a word of a
template's prefix, and drops pairs by length and position bounds before counting; it finds every pair that meets the threshold.
Templates are a table (label, text) of any size: they go to the tasks in parts of at most PART words, one after another for
each slice of texts, so that what a task holds of them is bounded.

Defined results: a null text is an empty text (no words, no labels, score 0); repeated rows are judged each; an empty table
gives an empty result. Templates without words, and those with a null label, give no label; repeated templates count once.
"""

from __future__ import annotations

import pickle
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import kernel
from tidewater.llm.common import filesystem, within, work_dir, write_committed
from tidewater.session import ready

#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices and the labels that they give.
TEMPLATES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under the apache license version 2 0": "apache",
    "this work is licensed under the gnu general public license version 3": "gpl",
    "this program is free software you can redistribute it and or modify it": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under a creative commons attribution license": "cc-by",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl",
}
#: Wording of whole licenses and of the headers that they ask for, with the labels that they give.
TEXTS = (
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE "
        "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
        "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS "
        "IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
        "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, "
        "OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
        "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL "
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
        "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
        "SOFTWARE.",
    ),
    (
        "zlib",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be "
        "misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the "
        "product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be "
        "misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may "
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or "
        "implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with "
        "this program. If not, see https://www.gnu.org/licenses/.",
    ),
    (
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
        "means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the "
        "software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and "
        "successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software "
        "under copyright law.",
    ),
)
#: Words of the smallest blocks' steps.
SIZE = 20
#: Template words that a task holds at once.
PART = 2_000_000

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def _hash_words(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return kernel.Hasher(data)(starts.astype(np.int64), ends.astype(np.int64))


def words_of(text: str | None) -> list[str]:
    """The words of a text, A-Z lower-cased."""
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_LOWER))


def defaults() -> list[tuple[str, str]]:
    """(label, words joined by spaces) of the templates that come with the operator."""
    return sorted({(label, " ".join(words_of(t))) for label, t in [*((label, t) for t, label in TEMPLATES.items()), *TEXTS]})


#: Words under which a template must be there as a whole and in order.
SHORT = 10


def size_of(n: int) -> int:
    """Half the block size of a template of n words."""
    if n < SHORT:
        return max(n, 1)
    size = SIZE
    while size < n:
        size *= 2
    return size


def vocabulary(templates: list[tuple[str, str]]) -> list[str]:
    return sorted({w for _, t in templates for w in t.split()})


def _words(batch):
    data, offsets = kernel.column_bytes(batch.column(batch.num_columns - 1))
    data = kernel.LOWER[data]
    words = kernel.Runs(data, offsets, _WORD[data])
    return data, words, kernel.Hasher(data)(words.start, words.end)


def _ids(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The index of each hash in the known ones, or -1."""
    order = np.argsort(known)
    at = np.minimum(np.searchsorted(known[order], hashes), len(known) - 1)
    return np.where(known[order][at] == hashes, order[at], -1)


def _count(names: list[str]):
    known = _hash_words(names)

    def run(batches):
        import pyarrow as pa

        total = np.zeros(len(known), np.int64)
        for whole in batches:
            for batch in within(whole, column=0):
                ids = _ids(_words(batch)[2], known)
                total += np.bincount(ids[ids >= 0], minlength=len(known))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(known)), pa.int32()), pa.array(total)], names=["word", "n"])

    return run


def frequencies(texts: DataFrame, templates: list[tuple[str, str]]) -> dict[str, int]:
    """How often each template word stands in all texts: as many numbers as the templates have words."""
    names = vocabulary(templates)
    rows = texts.mapInArrow(_count(names), "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect() if names else []
    return {w: 0 for w in names} | {names[r.word]: r.n for r in rows}


def prepare(counts: dict[str, int], templates: list[tuple[str, str]], percent: int):
    """The rank of each word (rarest first); by half block size, templates (words' ranks, label, needed overlap) and the index of their prefixes."""
    rank = {w: i for i, w in enumerate(sorted(counts, key=lambda w: (counts[w], w)))}
    kinds: dict[int, tuple[list, dict]] = {}
    for label, t in templates:
        ready, index = kinds.setdefault(size_of(len(t.split())), ([], {}))
        tokens = sorted(rank[w] for w in set(t.split()))
        short = len(t.split()) < SHORT
        need = len(tokens) if short else -(-percent * len(tokens) // 100)
        for p, w in enumerate(tokens[: len(tokens) - need + 1]):
            index.setdefault(w, []).append((len(ready), p))
        ready.append((frozenset(tokens), label, need, [rank[w] for w in t.split()] if short else None))
    return rank, kinds


def block_matches(tokens: list[int], ready, index) -> dict[int, int]:
    """template -> overlap of one block, given the ranks of its template words, ascending and distinct."""
    seen: dict[int, bool] = {}
    out = {}
    own = set(tokens)
    for pos, w in enumerate(tokens):
        for t, p in index.get(w, ()):
            if t in seen:
                continue
            words, _, need, _ = ready[t]
            if len(tokens) < need:  # length
                continue
            if 1 + min(len(words) - p - 1, len(tokens) - pos - 1) < need:  # position
                continue
            seen[t] = True
            if (n := len(words & own)) >= need:
                out[t] = n
    return out


def in_order(words: list[int], block: list[int]) -> bool:
    """Whether words stand in a block in their order, with any words between them."""
    rest = iter(block)
    return all(w in rest for w in words)


class Part:
    """Some templates, ready for the join."""

    def __init__(self, templates: list[tuple[str, str]], counts: dict[str, int], percent: int):
        rank, self.kinds = prepare(counts, templates, percent)
        names = sorted(counts)
        self.known = _hash_words(names)
        self.to_rank = np.array([rank[w] for w in names])
        self.starters = {}
        for size, (_, index) in self.kinds.items():
            self.starters[size] = np.zeros(len(names) + 1, bool)  # the last is for words of no template, whose rank is -1
            self.starters[size][list(index)] = True

    def found(self, hashes: np.ndarray, edges: list[np.ndarray]):
        """(first word of a block, label, share of the template's words) of each pair of block and template that meets the threshold.

        edges: where whole texts, and where lines, begin, with the number of words at the end."""
        ids = _ids(hashes, self.known)
        ranks = np.where(ids >= 0, self.to_rank[ids], -1)
        for size, (ready, index) in self.kinds.items():
            start = np.flatnonzero(self.starters[size][ranks])
            if not len(start):
                continue
            blocks = []
            for opens in edges:
                of = np.searchsorted(opens, start, side="right") - 1
                a, b, k = opens[of], opens[of + 1], (start - opens[of]) // size
                for back in (1, 0):
                    at = a + (k - back) * size
                    blocks.append(np.stack([at, np.minimum(b, at + 2 * size)], axis=1)[k >= back])
            for a, b in np.unique(np.concatenate(blocks), axis=0).tolist():
                inside = np.unique(ranks[a:b])
                for t, n in block_matches(inside[inside >= 0].tolist(), ready, index).items():
                    if ready[t][3] is None or in_order(ready[t][3], ranks[a:b].tolist()):
                        yield a, ready[t][1], n / len(ready[t][0])


def _phrase_hits(hashes: np.ndarray, row: np.ndarray, phrases: list[tuple[np.ndarray, str]]):
    """(first word, label) of each place of a phrase, whose words stand in one text."""
    for ps, label in phrases:
        m = len(hashes) - len(ps) + 1
        if m < 1:
            continue
        hit = row[:m] == row[len(ps) - 1 :]
        for k, h in enumerate(ps):
            hit &= hashes[k : k + m] == h
        for i in np.flatnonzero(hit).tolist():
            yield i, label


def _scan(parts):
    """parts: function that gives the parts of the templates one after another."""

    def run(batches):
        import pyarrow as pa

        phrases = [(_hash_words(p.split()), label) for p, label in PHRASES.items()]
        for whole in batches:
            for batch in within(whole):
                data, words, hashes = _words(batch)
                rows, of = batch.num_rows, words.of
                n_base, labels, score = np.zeros(rows, np.int64), [set() for _ in range(rows)], np.zeros(rows)
                first, last = np.full(rows, -1), np.full(rows, -1)
                for i, label in _phrase_hits(hashes, words.row, phrases):
                    r = words.row[i]
                    place = i - of[r]
                    n_base[r] += 1
                    labels[r].add(label)
                    score[r] = 1.0
                    first[r] = place if first[r] < 0 else min(first[r], place)
                    last[r] = max(last[r], place)
                base = [",".join(sorted(x)) for x in labels]
                line = np.searchsorted(np.flatnonzero(data == 10), words.start) + words.row  # changes with each line and each row
                begins = lambda key: np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
                for part in parts() if len(hashes) else ():
                    for a, label, share in part.found(hashes, [begins(words.row), begins(line)]):
                        labels[words.row[a]].add(label)
                        score[words.row[a]] = max(score[words.row[a]], share)
                none = n_base == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), pa.array(np.diff(of).astype(np.int64)), pa.array(n_base), pa.array(first.astype(np.int64), mask=none),
                        pa.array(last.astype(np.int64), mask=none), pa.array(base), pa.array([",".join(sorted(x)) for x in labels]), pa.array(score),
                    ],
                    names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
                )

    return run


def _parts(spark, templates: DataFrame | None):
    """Lists of (label, words), each of at most about PART words (one template at least)."""
    if templates is None:
        yield defaults()
        return
    table = templates.select("label", "text").where("label is not null and text is not null").distinct()
    n = table.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, -(-n // (4 * PART)))
    for p in range(count):
        rows = table.where(F.pmod(F.xxhash64("label", "text"), F.lit(count)) == p).collect()
        yield sorted({(r.label, " ".join(words_of(r.text))) for r in rows if words_of(r.text)})


def _stored(paths: list[str]):
    """The parts that these files hold, one in memory at a time unless there is only one."""
    kept: list = []

    def parts():
        for path in paths:
            if kept:
                yield kept[0]
                continue
            system, at = filesystem(path)
            with system.open_input_stream(at, compression=None) as f:
                part = pickle.loads(f.read())
            if len(paths) == 1:
                kept.append(part)
            yield part

    return parts


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = 80, templates: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: a row a document. templates: label and text; None: defaults()."""
    pick = ready(docs).select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    kind = pick.schema["doc_id"].dataType.simpleString()
    folder, paths = work_dir(docs.sparkSession, "license-templates"), []
    for k, own in enumerate(_parts(docs.sparkSession, templates)):
        if own:
            paths.append(f"{folder}/part-{k:05d}")
            write_committed(paths[-1], "0", [pickle.dumps(Part(own, frequencies(pick.select("text"), own), percent))])
    out = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return pick.mapInArrow(_scan(_stored(paths)), out)
