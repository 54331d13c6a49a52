"""License notices in texts: fingerprints find candidates, alignment measures them.

Templates are winnowed: of every `WINDOW` neighbouring word trigrams the least hash is kept, so a
stretch of WINDOW + 2 words that a text shares with a template also shares a fingerprint. The
index maps a fingerprint to its places in the templates. A text is winnowed the same way; each
hit gives a template and a diagonal, and hits on near diagonals are one candidate. A banded
alignment of the whole template against the text around the diagonal then reports how many of
the template's words are matched, in order, and where. Of overlapping matches the best score
stays, so a notice that contains a shorter one is reported once.

Words are letters and digits, compared in lower case; spans count code points, the end exclusive.
Defined results: a null or empty text has no matches; repeated rows are scanned each; of equal
scores the longer span, then the template named first, wins. A text costs time in proportion to
its length plus its candidates.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waybill.llm.words import WordHashes, bounded_batches, gram_hashes

GRAM, WINDOW = 3, 3
#: Shares of the template's words matched, and of the span's words that match, from which a notice counts.
COVERAGE, IDENTITY = 0.85, 0.8
_WORD = re.compile(r"[^\W_]+")

# Usual wordings of license notices.
NOTICES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    ),
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction',
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    # The opening alone doesn't tell which.
    (
        "BSD-2-Clause OR BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted",
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
)


_GNU_FIRST = (
    "This {what} is free software; you can redistribute it and/or modify it under the terms of the {law} as published by "
    "the Free Software Foundation; either version {version} of the License, or (at your option) any later version."
)
_GNU_REST = (
    " This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
    "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {law} for more details. You should have "
    "received a copy of the {law} along with this {what}"
)
_GNU_ENDS = (
    ". If not, see <https://www.gnu.org/licenses/>.",
    "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
)
_GNU = (
    ("GPL-2.0", "program", "GNU General Public License", "2"),
    ("GPL-3.0", "program", "GNU General Public License", "3"),
    ("LGPL-2.0", "library", "GNU Library General Public License", "2"),
    ("LGPL-2.1", "library", "GNU Lesser General Public License", "2.1"),
    ("LGPL-3.0", "library", "GNU Lesser General Public License", "3"),
    ("AGPL-3.0", "program", "GNU Affero General Public License", "3"),
)
NOTICES += tuple(
    (name, text.format(what=what, law=law, version=version))
    for name, what, law, version in _GNU
    for text in (_GNU_FIRST, *[_GNU_FIRST + _GNU_REST + end for end in _GNU_ENDS])
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution. "
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission. "
)
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
NOTICES += (
    ("BSD-2-Clause", _BSD + _BSD_WARRANTY),
    ("BSD-3-Clause", _BSD + _BSD_THIRD + _BSD_WARRANTY),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
        "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE "
        'IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER "
        "IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
)
#: Words that tell licenses and versions apart: where a template has them, a match must have them in a row.
TELLING = re.compile(
    r"gnu (?:lesser |library |affero )?general public license|(?:version|v) \d+(?: \d+)?|cc by(?: [a-z]{2})* \d+ \d+"
    r"|creative commons [a-z ]+ \d+ \d+|to endorse or promote products"
)
#: What a match may not have.
EXCLUDED = {"BSD-2-Clause": "to endorse or promote products"}


class TokenHashes(WordHashes):
    """Hashes of words in lower case."""

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.lower().encode("utf-8", "surrogatepass"))
        return value


def winnowed(grams: np.ndarray) -> np.ndarray:
    """Positions that hold the least hash of some window; equal hashes all count."""
    count = len(grams)
    if count == 0:
        return np.empty(0, np.int64)
    width = min(WINDOW, count)
    least = grams[: count - width + 1].copy()
    for i in range(1, width):
        least = np.minimum(least, grams[i : count - width + 1 + i])
    kept = np.zeros(count, bool)
    for i in range(width):
        kept[i : count - width + 1 + i] |= grams[i : count - width + 1 + i] == least
    return np.flatnonzero(kept)


@dataclass(frozen=True)
class Match:
    license: str
    start: int
    end: int
    coverage: float
    matched: int
    score: int


class Scanner:
    """Inverted index of the templates' fingerprints, and the scan of one text."""

    def __init__(self, notices: tuple[tuple[str, str], ...] = NOTICES):
        self.hashes = TokenHashes()
        self.names = [name for name, _ in notices]
        self.templates = [self.hashes.of(_WORD.findall(text)) for _, text in notices]
        plain = [" ".join(_WORD.findall(text.lower())) for _, text in notices]
        self.telling = [[self.hashes.of(found.split()) for found in sorted(set(TELLING.findall(text)))] for text in plain]
        self.excluded = [self.hashes.of(EXCLUDED[n].split()) if n in EXCLUDED else None for n in self.names]
        places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, words in enumerate(self.templates):
            grams = gram_hashes(words, GRAM)
            for at in winnowed(grams).tolist():
                places[int(grams[at])].append((t, at))
        self.places = dict(places)
        self.keys = np.array(sorted(places), np.uint64)

    def _candidates(self, words: np.ndarray) -> dict[int, list[int]]:
        """Template -> diagonals (place in the text less place in the template)."""
        grams = gram_hashes(words, GRAM)
        if not len(grams) or not len(self.keys):
            return {}
        at = np.minimum(np.searchsorted(self.keys, grams), len(self.keys) - 1)
        hits = np.flatnonzero(self.keys[at] == grams)
        if not len(hits):
            return {}
        hits = hits[np.isin(hits, winnowed(grams))]
        diagonals: dict[int, set[int]] = defaultdict(set)
        for hit in hits.tolist():
            for template, place in self.places[int(grams[hit])]:
                diagonals[template].add(hit - place)
        return {t: sorted(d) for t, d in diagonals.items()}

    def _told(self, template: int, span: np.ndarray) -> bool:
        """Whether a span has the words in a row that tell its license from others."""
        excluded = self.excluded[template]
        if excluded is not None and _has(span, excluded):
            return False
        return all(_has(span, phrase) for phrase in self.telling[template])

    def scan(self, text: str | None) -> list[Match]:
        if not text:
            return []
        words = self.hashes.of(_WORD.findall(text))
        found: list[tuple[int, int, int, int, int]] = []
        for template, diagonals in self._candidates(words).items():
            body = self.templates[template]
            band = max(2, len(body) // 8)
            first = last = diagonals[0]
            groups = []
            for d in diagonals[1:]:
                # A chain of hits that drifts on is cut, so that a band stays narrow.
                if d - last > band or d - first > 4 * band:
                    groups.append((first, last))
                    first = d
                last = d
            for low, high in [*groups, (first, last)]:
                # No more of the template can match than has its word there at all.
                window = words[max(0, low - band) : max(0, len(body) + high + band)]
                if np.isin(body, window).sum() < COVERAGE * len(body) or not all(_has(window, x) for x in self.telling[template]):
                    continue
                best = aligned(body, words, low - band, high + band)
                if best is not None:
                    matched, start, end, score = best
                    close = matched >= COVERAGE * len(body) and matched >= IDENTITY * (end - start)
                    if close and self._told(template, words[start:end]):
                        found.append((score, end - start, -template, start, end))
        return self._without_overlaps(text, found, words)

    def _without_overlaps(self, text: str, found: list[tuple[int, int, int, int, int]], words: np.ndarray) -> list[Match]:
        if not found:
            return []
        spans = [m.span() for m in _WORD.finditer(text)]
        taken = np.zeros(len(words), bool)
        out = []
        for score, _, template, start, end in sorted(set(found), key=lambda x: (-x[0], -x[1], -x[2], x[3])):
            if taken[start:end].any():
                continue
            taken[start:end] = True
            body = self.templates[-template]
            matched = (score + (end - start) + len(body)) // 4
            out.append(
                Match(self.names[-template], spans[start][0], spans[end - 1][1], matched / len(body), matched, score)
            )
        return sorted(out, key=lambda m: m.start)


def _has(words: np.ndarray, phrase: np.ndarray) -> bool:
    at = len(words) - len(phrase) + 1
    return at > 0 and bool(np.logical_and.reduce([words[i : at + i] == p for i, p in enumerate(phrase)]).any())


def aligned(body: np.ndarray, words: np.ndarray, low: int, high: int) -> tuple[int, int, int, int] | None:
    """Best alignment of all of `body` within diagonals low..high of `words`.

    (matched words, start, end, score): the score is twice the matches less the words of either
    side that aren't matched. Words of the text before the start and after the end are free.
    """
    width = high - low + 1
    lowest = -(1 << 30)
    text = words[max(0, low) : max(0, min(len(words), len(body) + high))].tolist()
    shift = max(0, low)
    template = body.tolist()

    # Row i: template words used; cell d: text words up to i + low + d. Value: (score, -start, matched).
    def inside(place: int) -> bool:
        return shift <= place <= shift + len(text)

    row = [(0, -(low + d), 0) if inside(low + d) else (lowest, 0, 0) for d in range(width)]
    for i, word in enumerate(template, 1):
        after = []
        for d in range(width):
            place = i + low + d
            best = (lowest, 0, 0)
            if inside(place):
                if inside(place - 1) and row[d][0] > lowest and text[place - 1 - shift] == word:
                    s, b, m = row[d]
                    best = (s + 2, b, m + 1)
                if d + 1 < width and row[d + 1][0] > lowest:  # the template's word is missing
                    s, b, m = row[d + 1]
                    best = max(best, (s - 1, b, m))
                if d and after[d - 1][0] > lowest and after[d - 1][2]:  # the text has a word more
                    s, b, m = after[d - 1]
                    best = max(best, (s - 1, b, m))
                if inside(place - 1) and row[d][0] > lowest and row[d][2]:  # one word for another
                    s, b, m = row[d]
                    best = max(best, (s - 2, b, m))
            if best[0] > lowest and best[2] == 0:
                best = (best[0], -place, 0)  # nothing matched yet: the span starts here
            after.append(best)
        row = after
    ends = [(value, -(len(template) + low + d)) for d, value in enumerate(row) if value[2]]
    if not ends:
        return None
    (score, start, matched), end = max(ends)
    return matched, -start, -end, score


MATCHES = T.ArrayType(
    T.StructType(
        [
            T.StructField("license", T.StringType()),
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
            T.StructField("coverage", T.DoubleType()),
            T.StructField("matched", T.LongType()),
        ]
    )
)


def license_matches(text: Column, notices: tuple[tuple[str, str], ...] = NOTICES) -> Column:
    """The notices of a text with spans and the share of the template that is matched."""

    @F.pandas_udf(MATCHES)
    def scanning(texts: pd.Series) -> pd.Series:
        scanner = Scanner(notices)
        fields = ("license", "start", "end", "coverage", "matched")
        return pd.Series([[{f: getattr(m, f) for f in fields} for m in scanner.scan(t)] for t in texts], dtype=object)

    return scanning(text)


def op3(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = bounded_batches(docs).select("doc_id", license_matches(F.col("text")).alias("found"))
    parts = F.transform(
        "found",
        lambda m: F.concat_ws(
            ":", m["license"], m["start"].cast("string"), m["end"].cast("string"), F.format_number(m["coverage"], 3)
        ),
    )
    return found.select(
        "doc_id",
        F.size("found").cast("long").alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda m: m["license"]))), ",").alias("licenses"),
        F.array_join(parts, ",").alias("spans"),
    )
