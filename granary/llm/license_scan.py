"""Licence scans: normalised text against licence templates by Dice coefficient over word bigrams.

*Units* of a text are each line, the whole text if it has more than one line, and, for a template of ``LONG`` bigrams or
more, each run of as many words as the template has that begins with a line: a notice inside a longer text, however
it is wrapped. Normalising: lower case, every run of other characters than letters and digits becomes one
space. Two bigram sets A and B have Dice 2|A n B| / (|A| + |B|); a Dice of ``t`` needs
t/(2-t) |B| <= |A| <= (2-t)/t |B|, so a template is compared only with units whose number of distinct
bigrams lies in these bounds, and units outside every template's bounds are never compared.
All of it is built-in functions without a shuffle or join: the templates are literals.

Nothing is normalised that cannot match: a unit that reaches the threshold misses less than m + 1 of a template's
bigrams (m follows from the threshold), so it holds one of any m + 1 of them and hence one of a word chosen from each. A
text or unit without any of these words, for all templates together, is out (``needed_words``). A run of words is compared
only if t/(2-t) |B| of its places hold some bigram of a long template.

Result: a row per document with its best template (highest Dice; ties: the larger one, then the first name) at or over the
threshold, that Dice, and the number of units that matched some template (runs count once for each line they begin
with); documents without a match have nulls and 0. Defined cases: null, empty and one-word texts match nothing; repeated
rows give a row each; other columns are not read; without templates nothing matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

THRESHOLD, LONG = 0.8, 30
#: What separates words.
_GAP = r"[^\p{L}\p{N}]+"

#: Public licence notices: fixed values.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header-full": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "BSD-2-Clause-full": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause-name": "Released under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header-full": 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.',
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.',
    "ISC-full": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "MIT": "Released under the MIT License.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MIT-full": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def _template_words(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def _template_bigrams(text: str) -> list[str]:
    words = _template_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def size_bounds(size: int, threshold: float) -> tuple[int, int]:
    """Smallest and largest number of bigrams that can reach the threshold with ``size`` of them."""
    low, high = threshold / (2 - threshold) * size, (2 - threshold) / threshold * size
    return -int(-(low - 1e-9) // 1), int(high + 1e-9)


def needed_words(sets: dict[str, list[str]], threshold: float) -> list[str]:
    """Words of which each unit that reaches the threshold holds at least one; long words and words in use first."""
    chosen: set[str] = set()
    common_letters = "etaoinshrdlcumwfgypbvkjxqz"  # by frequency: a long word of rare letters is seldom in other texts
    frequent = "a all and at be by except following for in including is may not of or that the this to under use with you".split()
    rare = lambda w: 0.0 if w in frequent else sum(2 + common_letters.find(c) / 4 if c in common_letters else 6.0 for c in w)
    for bigrams in sets.values():
        misses = len(bigrams) - size_bounds(len(bigrams), threshold)[0]
        best = lambda b: max(b.split(" "), key=lambda w: (w in chosen, rare(w), w))
        for b in sorted(bigrams, key=lambda b: (best(b) not in chosen, -rare(best(b)), b))[: misses + 1]:
            chosen.add(best(b))
    return sorted(chosen)


def _words(unit: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(unit), _GAP, " ")), " ")


def _pairs(words: Column) -> Column:
    n = F.size(words)
    joined = F.zip_with(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(joined)


def _with(value: Column, f) -> Column:
    """``f`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _hit(bigrams: Column, name: str, template: list[str]) -> Column:
    dice = -2.0 * F.size(F.array_intersect(bigrams, F.array(*map(F.lit, template)))) / (F.size(bigrams) + len(template))
    return F.struct(dice.alias("minus"), F.lit(-len(template)).alias("less"), F.lit(name).alias("template"))


_HITS = "array<array<struct<minus:double,less:int,template:string>>>"


def _runs(text: Column, sets: dict[str, list[str]], lengths: dict[str, int], threshold: float) -> Column:
    """For each line that some matching run of words begins with: the templates that match (minus Dice, name)."""
    least = {name: size_bounds(len(b), threshold)[0] for name, b in sets.items()}
    some = sorted({b for bigrams in sets.values() for b in bigrams})
    words_of = lambda line: F.filter(_words(line), lambda w: w != "")

    def from_starts(pairs: Column, places: Column, starts: Column) -> Column:
        def at(start: Column) -> Column:
            def one(name: str) -> Column:
                # a run of as many words as the template has, one bigram less
                inside = F.size(F.filter(places, lambda p: (p >= start) & (p < start + lengths[name] - 1))) >= least[name]
                run = F.array_distinct(F.slice(pairs, start + 1, F.lit(lengths[name] - 1)))
                return F.when(inside, _with(run, lambda b: F.when(F.size(b).between(*size_bounds(len(sets[name]), threshold)), _hit(b, name, sets[name]))))

            return F.filter(F.array(*map(one, sets)), lambda x: x.minus <= -threshold)

        return F.filter(F.transform(starts, at), lambda m: F.size(m) > 0)

    def of_pairs(pairs: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(pairs) - 1), lambda i: F.get(pairs, i).isin(some))
        first = F.flatten(F.transform(F.split(text, "\n"), lambda line: F.transform(words_of(line), lambda w, i: i == 0)))
        starts = F.filter(F.transform(first, lambda x, i: F.when(x, i)), lambda i: i.isNotNull())
        found = _with(places, lambda p: F.when(F.size(p) >= min(least.values()), _with(starts, lambda s: from_starts(pairs, p, s))))
        return F.when(F.size(pairs) >= min(least.values()), found)

    return F.coalesce(_with(_pairs(words_of(text)), of_pairs), F.array().cast(_HITS))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``license``, ``dice``, ``n_units`` for each row of ``docs``."""
    sets = {name: b for name, text in sorted(templates.items()) if (b := _template_bigrams(text))}
    bounds = {name: size_bounds(len(b), threshold) for name, b in sets.items()}
    most = max((hi for _, hi in bounds.values()), default=0)
    least = min((lo for lo, _ in bounds.values()), default=1)
    docs = common.ids_and_text(docs, id_col, text_col)
    # A unit with few or very many spaces cannot come within any template's bounds: distinct bigrams are at most
    # words - 1, and words are at most one more than half the characters.

    def hopeful(text: Column, words: list[str]) -> Column:
        """Whether one of the words is in a text; one split and a hash set are cheaper than a search for each."""
        return F.arrays_overlap(F.split(F.lower(text), _GAP), F.array(*map(F.lit, words)))

    words = needed_words(sets, threshold) if sets else []
    lines = F.split(F.when(hopeful(F.col("text"), words), F.col("text")).otherwise(""), "\n")
    units = F.when(F.size(lines) > 1, F.concat(lines, F.array("text"))).otherwise(lines)
    units = F.filter(units, lambda u: (F.length(u) >= 2 * least + 1) & hopeful(u, words))

    def matches(unit: Column) -> Column:
        def compare(b: Column) -> Column:
            n = F.size(b)
            best = F.filter(F.array(*[F.when(n.between(*bounds[name]), _hit(b, name, sets[name])) for name in sets]), lambda x: x.minus <= -threshold)
            return F.when((n >= least) & (n <= most), best)

        return _with(F.array_distinct(_pairs(_words(unit))), compare)

    hits = F.filter(F.transform(units, matches), lambda m: F.size(m) > 0) if sets else F.array().cast(_HITS)
    long = {name: b for name, b in sets.items() if len(b) >= LONG}
    if long:
        runs = _runs(F.col("text"), long, {name: len(_template_words(templates[name])) for name in long}, threshold)
        hits = F.concat(hits, F.when(hopeful(F.col("text"), needed_words(long, threshold)), runs).otherwise(F.array().cast(_HITS)))
    found = docs.select("doc_id", hits.alias("hits"))
    best = F.array_min(F.flatten("hits"))  # highest Dice, then the larger template, then the name
    return found.select("doc_id", best.alias("best"), F.size("hits").cast("long").alias("n_units")).select("doc_id", F.col("best.template").alias("license"), (-F.col("best.minus")).alias("dice"), "n_units")


def query(spark, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents", spread=True))


def _sql() -> str:
    rows = ",\n  ".join(f"('{name}', {len(_template_words(text))}, [{', '.join(repr(b) for b in _template_bigrams(text))}])" for name, text in sorted(TEMPLATES.items()))
    low, high = THRESHOLD / (2 - THRESHOLD) - 1e-9, (2 - THRESHOLD) / THRESHOLD + 1e-9
    return rf"""
WITH t(name, n_words, b) AS (VALUES
  {rows}
), l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines, text FROM documents),
u AS (
  SELECT doc_id, pos, unit FROM (
    SELECT doc_id, unnest(CASE WHEN len(lines) > 1 THEN list_append(lines, text) ELSE lines END) AS unit,
           unnest(range(len(lines) + CASE WHEN len(lines) > 1 THEN 1 ELSE 0 END)) AS pos FROM l)
), w AS (
  SELECT doc_id, pos, string_split(trim(regexp_replace(lower(unit), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS ws FROM u
), g AS (
  SELECT doc_id, pos, list_distinct([ws[i] || ' ' || ws[i + 1] for i in range(1, len(ws))]) AS b FROM w
), m AS (
  SELECT doc_id, pos, name, 2.0::DOUBLE * len(list_intersect(g.b, t.b)) / (len(g.b) + len(t.b)) AS dice
  FROM g JOIN t ON len(g.b) BETWEEN len(t.b) * {low} AND len(t.b) * {high}
), whole AS (
  SELECT doc_id, text, [ws[i] || ' ' || ws[i + 1] for i in range(1, len(ws))] AS ps
  FROM (SELECT doc_id, text, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS ws FROM documents)
), near AS (
  SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(ps) AS p FROM whole)
  WHERE p IN (SELECT unnest(b) FROM t WHERE len(b) >= {LONG}) GROUP BY doc_id
), lines AS (
  SELECT doc_id, pos, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, n
  FROM (SELECT doc_id, pos, len(list_filter(ws, lambda x: x <> '')) AS n FROM w JOIN l USING (doc_id) WHERE pos < len(l.lines))
), r AS (
  SELECT lines.doc_id, -1 - lines.pos AS pos, t.name, t.b, list_distinct(ps[start + 1:start + t.n_words - 1]) AS run
  FROM lines JOIN near USING (doc_id) JOIN whole USING (doc_id) JOIN t ON len(t.b) >= {LONG} AND near.n >= len(t.b) * {low}
  WHERE lines.n > 0
), h AS (
  SELECT doc_id, pos, name, dice FROM m WHERE dice >= {THRESHOLD} UNION ALL
  SELECT doc_id, pos, name, 2.0::DOUBLE * len(list_intersect(run, b)) / (len(run) + len(b)) AS dice FROM r
  WHERE len(run) BETWEEN len(b) * {low} AND len(b) * {high} AND 2.0::DOUBLE * len(list_intersect(run, b)) / (len(run) + len(b)) >= {THRESHOLD}
)
SELECT d.doc_id, first(h.name ORDER BY h.dice DESC, h.size DESC, h.name) AS license, max(h.dice) AS dice, count(DISTINCT h.pos) AS n_units
FROM documents d LEFT JOIN (SELECT h.*, len(t.b) AS size FROM h JOIN t USING (name)) h USING (doc_id) GROUP BY d.doc_id
"""


SQL = _sql()
