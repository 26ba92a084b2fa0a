"""Licence scan: candidate blocks ranked by conditional compression, winners confirmed by their wording."""

import bisect
import difflib
import heapq
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

# The customary notices of public licences, and the opening of longer texts.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "BSD": (
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "Proprietary": ("All rights reserved.", "Copyright. All rights reserved. No part of this work may be reproduced without permission."),
}
#: Bytes that the shortest match costs in a compressed block: a single differing digit may not show in the sizes.
NEAR = 4
_TOKEN = re.compile(r"[^\W_]+(?:\.[0-9]+)*")


def tokens(text: str) -> list[str]:
    return [w.lower() for w in _TOKEN.findall(text)]


class Template:
    """The words of a template; ``least`` of them make a notice, which spans ``reach`` words at most."""

    def __init__(self, name: str, text: str, share: float):
        self.name, self.text, self.words = name, text, tokens(text)
        n = len(self.words)
        self.least, self.reach, self.full = max(1, math.ceil(share * n - 1e-9)), n + max(10, n), (1 << n) - 1
        self.need = Counter(self.words)
        self.bits = {w: sum(1 << i for i, x in enumerate(self.words) if x == w) for w in self.need}

    def notices(self, at: dict[str, list[int]]):
        """(score, words in order, first, last word) of the stretches of a text that have ``least``
        words in order; ``at`` has the places of its words. A stretch begins with a word of the
        template and ends where one more is in order; a word put in or left out costs one point."""
        if sum(min(len(at.get(w, ())), k) for w, k in self.need.items()) < self.least:
            return
        hits = sorted((p, w) for w in self.need for p in at.get(w, ()))
        # Words in any order bound the words in order, and slide along the text.
        have, bound, end = Counter(), 0, 0
        for k, (first, word) in enumerate(hits):
            while end < len(hits) and hits[end][0] < first + self.reach:
                w = hits[end][1]
                have[w] += 1
                bound += have[w] <= self.need[w]
                end += 1
            if bound >= self.least:
                rest, best = self.full, self.least - 1
                for p, w in hits[k:end]:
                    x = rest & self.bits[w]  # longest common subsequence, a bit for each word of the template
                    rest = ((rest + x) | (rest - x)) & self.full
                    same = len(self.words) - rest.bit_count()
                    if same > best:
                        best = same
                        yield 3 * same - (p - first + 1) - len(self.words), same, first, p
            bound -= have[word] <= self.need[word]
            have[word] -= 1


    def best(self, words: list[str], lo: int, hi: int):
        """The notice with the highest score within words[lo:hi], the earlier of equals: (score, words in order, first, last word)."""
        at: dict[str, list[int]] = {}
        for p in range(lo, hi):
            if words[p] in self.need:
                at.setdefault(words[p], []).append(p)
        return max(self.notices(at), key=lambda x: (x[0], x[1], -x[2]), default=None)


class Scanner:
    """Finds notices in blocks of words around the rare words of the templates.

    Every block is compressed plainly and with each template as raw dictionary (words lower-cased,
    one space between them). Block and template are asked in the order of the bytes saved, and the
    first pair whose wording confirms the template tells where a notice stands. That stretch alone is
    ranked once more, so that what stands around it has no say between like templates; between those
    whose savings differ by less than a match costs the exact wording decides. What is left of blocks
    beside it is ranked again, until nothing is confirmed.
    """

    def __init__(self, templates, share: float = 0.9, level: int = 15):
        import zstandard
        self.items = [t for name, ts in templates.items() for x in ts if (t := Template(name, x, share)).words]
        make = lambda d=None: zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False)
        self.plain = make()
        # ".": the shortest raw dictionaries zstandard takes have 8 bytes.
        self.given = [make(zstandard.ZstdCompressionDict(" ".join(t.words).encode().ljust(8, b"."), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for t in self.items]
        self.known: dict[str, list] = {}
        self.anchors = self._anchors()

    def _anchors(self) -> dict[str, set[int]]:
        """Words of which every notice has one, with the numbers of words that such notices may span: of each
        template those that the fewest templates have, at more places than a notice may leave out."""
        within = Counter(w for t in self.items for w in t.need)
        out: dict[str, set[int]] = {}
        for t in self.items:
            places = len(t.words) - t.least + 1
            for w in sorted(t.need, key=lambda w: (within[w], -len(w), w)):
                if places <= 0:
                    break
                places -= t.need[w]
                out.setdefault(w, set()).add(t.reach)
        return out

    def blocks(self, words: list[str]) -> set[tuple[int, int]]:
        """Stretches [lo, hi) of words, each notice whole in one of them. One is at most three times as
        long as a notice around its anchors may be, so their number grows with the text, not their length."""
        around: dict[int, list[list[int]]] = {}
        for p, w in enumerate(words):
            for reach in self.anchors.get(w, ()):
                runs = around.setdefault(reach, [])
                lo, hi = max(0, p - reach + 1), min(len(words), p + reach)
                if runs and lo <= runs[-1][1]:
                    runs[-1][1] = hi
                else:
                    runs.append([lo, hi])
        out = set()
        for reach, runs in around.items():
            for lo, hi in runs:
                while hi - lo > 3 * reach:
                    out.add((lo, lo + 2 * reach))
                    lo += reach
                out.add((lo, hi))
        return out

    def rank(self, words: list[str]):
        """(reduction, plain bytes, bytes given the template, template) of the templates that save bytes, most first."""
        text = " ".join(words)
        if text not in self.known:
            if len(self.known) > 5_000:
                self.known.clear()
            data = text.encode("utf-8", "replace")
            plain = len(self.plain.compress(data))
            sizes = ((len(z.compress(data)), i) for i, z in enumerate(self.given))
            self.known[text] = sorted(((plain - n, plain, n, i) for n, i in sizes if n < plain), key=lambda x: (-x[0], -len(self.items[x[3]].words), x[3]))
        return self.known[text]

    def _winner(self, words: list[str], lo: int, hi: int):
        """The confirmed template that saves most; of those within NEAR bytes of it, the one whose wording differs least."""
        top, near = None, []
        for saved, plain, given, i in self.rank(words[lo:hi]):
            if top is not None and saved < top - NEAR:
                break
            found = self.items[i].best(words, lo, hi)
            if found:
                top = saved if top is None else top
                near.append((found, (i, plain, given, *found[1:])))
        return max(near, key=lambda x: x[0][:2])[1] if near else None

    def found(self, words: list[str]):
        """(first, last word, template, words in order, plain bytes, bytes given the template) of the notices, in order."""
        taken, heap, known = [], [], set()

        def add(lo, hi):
            if (lo, hi) not in known and any(words[p] in self.anchors for p in range(lo, hi)):
                known.add((lo, hi))
                heap.extend((-saved, -len(self.items[i].words), i, lo, hi) for saved, _, _, i in self.rank(words[lo:hi]))

        for block in self.blocks(words):
            add(*block)
        heapq.heapify(heap)
        while heap:
            _, _, i, lo, hi = heapq.heappop(heap)
            k = bisect.bisect(taken, (lo, len(words)))
            if k and taken[k - 1][1] >= lo:
                k -= 1
            if k < len(taken) and taken[k][0] < hi:  # what is left of the block goes back once
                first, last = taken[k][:2]
            else:
                found = self.items[i].best(words, lo, hi)
                if not found:
                    continue
                _, same, first, last = found
                slack = len(self.items[i].words) - same + 1
                a = max(first - slack, taken[k - 1][1] + 1 if k else 0)
                b = min(last + 1 + slack, taken[k][0] if k < len(taken) else len(words))
                won = self._winner(words, a, b)
                if won is None:
                    continue
                i, plain, given, same, first, last = won
                bisect.insort(taken, (first, last, i, same, plain, given))
            size = len(heap)
            add(lo, max(lo, first))
            add(min(hi, last + 1), hi)
            if len(heap) > size:
                heapq.heapify(heap)
        return taken

    def scan(self, text: str):
        """(line, licence, template, plain size, size given the template, wording share, differences)
        of every notice in the text."""
        words = tokens(text)
        found = self.found(words)
        if not found:
            return
        place = [m.start() for m in _TOKEN.finditer(text)]
        line, seen = 0, 0
        for first, last, i, same, plain, given in found:
            line, seen = line + text.count("\n", seen, place[first]), place[first]
            t = self.items[i]
            yield line, t.name, t.text, plain, given, same / len(t.words), self._differences(words[first:last + 1], i)

    def _differences(self, have: list[str], i: int) -> str:
        want = self.items[i].words
        if have == want:
            return ""
        ops = difflib.SequenceMatcher(None, want, have, autojunk=False).get_opcodes()
        return "; ".join(f"{' '.join(want[a:b])} -> {' '.join(have[c:d])}" for op, a, b, c, d in ops if op != "equal")


def scan_licenses(docs: DataFrame, templates=TEMPLATES, share: float = 0.9) -> DataFrame:
    """One row for each notice in ``docs`` (doc_id, text) whose wording confirms a licence:
    (doc_id, line, license, template, plain_bytes, given_bytes, reduction, wording, differences).

    A notice is a stretch of words, on one line or many, that has ``share`` of a template's words or
    more in order, and no more words put in than the template has, or ten. Blocks of words around
    the templates' rare words are compressed with each template as raw dictionary, and templates are
    confirmed in the order of the bytes they save; a template that saves none is not asked. Notices
    do not overlap. ``line`` is where a notice's first word stands. ``plain_bytes`` and
    ``given_bytes`` are the sizes, without and with the template, by which the winner was ranked,
    ``reduction`` is their difference; ``wording`` the share of the template's words found in order;
    ``differences`` what was replaced, left out or put in. Null and empty texts give no row; texts of
    any length are scanned whole; repeated rows give repeated rows, and equal texts the same rows.
    Other columns of ``docs`` are not read, so their names cannot clash. Each row stands alone, so
    nothing is shuffled.
    """
    def run(batches):
        scanner = Scanner(templates, share)
        for b in batches:
            ids, texts, rows, at = b.column("doc_id"), b.column("text").to_pylist(), [], []
            for i, t in enumerate(texts):
                for x in scanner.scan(t):
                    at.append(i)
                    rows.append((*x[:5], x[3] - x[4], *x[5:]))
            if rows:
                types = (pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.string())
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at))] + [pa.array(c, k) for c, k in zip(zip(*rows), types)], [
                    "doc_id", "line", "license", "template", "plain_bytes", "given_bytes", "reduction", "wording", "differences"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").filter("text is not null").mapInArrow(run, f"doc_id {kind}, line int, license string, template string, "
        "plain_bytes int, given_bytes int, reduction int, wording double, differences string")
