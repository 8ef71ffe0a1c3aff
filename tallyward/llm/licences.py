"""Licence scans: TF-IDF similarity of headers and licence files to templates, and inheritance by directory.

A line with licence vocabulary is compared with every template as a sparse TF-IDF vector: terms of line and template meet
in a join on the term, products add up to the cosine. Headers and licence texts run over many lines or stand inside a long
one: windows of words as long as a template, laid so that a word of the licence vocabulary lies where the template has it, are compared
with that template in the same way. A document that is a licence text nearly as a whole, or whose file
name says so, and on demand one whose licence lines make up a good part of it, is a licence file and speaks for its directory; a document without a licence of its own takes
that of the nearest directory above it, found by joining the directories of its path with those that have one.
Documents without licence vocabulary cost one regular expression and are never shuffled with their text.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from math import floor, log, sqrt

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.llm.storage import map_arrow, ship, steps, written

SIMILARITY = 0.6
# Share of a document's characters in licence lines from which it may be taken for a licence file (``file_share``).
FILE_SHARE = 0.3
# Longer lines are compared by pieces of this many characters.
PIECE = 2000

# Wording of common licence headers and files.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0",
                   "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License",
                   "SPDX-License-Identifier: Apache-2.0", "Apache License Version 2.0, January 2004"],
    "MIT": ["Released under the MIT License", "Licensed under the MIT License", "The MIT License (MIT)", "SPDX-License-Identifier: MIT",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3",
                "GNU General Public License Version 3, 29 June 2007", "SPDX-License-Identifier: GPL-3.0-or-later",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                "published by the Free Software Foundation, either version 3 of the License, or any later version"],
    "GPL-2.0": ["Licensed under the GNU General Public License, version 2", "GNU General Public License Version 2, June 1991",
                "SPDX-License-Identifier: GPL-2.0-only"],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3", "SPDX-License-Identifier: LGPL-3.0-only"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause",
                     "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "Proprietary": ["All rights reserved", "Copyright, all rights reserved", "Proprietary and confidential, all rights reserved"],
}
_GNU_HEADER = ("This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published by "
               "the Free Software Foundation; either version {version} of the License, or (at your option) any later version. "
               "This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
               "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.")
_AS_IS = ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
          "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE "
          "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
          "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.")
# Whole headers and licence texts, which passages are compared with besides TEMPLATES.
HEADERS = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
                   "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
                   "in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
                   "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
                   "License: Apache 2.0", "Apache License Version 2.0"],
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
            "Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
            "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
            "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
            "of the Software. " + _AS_IS, "License: MIT", "MIT License"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
            "above copyright notice and this permission notice appear in all copies.", "License: ISC", "SPDX-License-Identifier: ISC"],
    "GPL-3.0": [_GNU_HEADER.format(what="program", name="General Public License", version="3"),
                "GNU General Public License, version 3", "License: GPLv3", "GPLv3", "GPL-3.0", "GPL v3"],
    "GPL-2.0": [_GNU_HEADER.format(what="program", name="General Public License", version="2"),
                "GNU General Public License, version 2", "License: GPLv2", "GPLv2", "GPL-2.0", "GPL v2"],
    "LGPL-3.0": [_GNU_HEADER.format(what="library", name="Lesser General Public License", version="3"),
                 "GNU Lesser General Public License, version 3", "License: LGPLv3", "LGPLv3", "LGPL-3.0"],
    "LGPL-2.1": [_GNU_HEADER.format(what="library", name="Lesser General Public License", version="2.1"),
                 "GNU Lesser General Public License, version 2.1", "SPDX-License-Identifier: LGPL-2.1-only", "License: LGPLv2.1", "LGPLv2.1", "LGPL-2.1"],
    "AGPL-3.0": [_GNU_HEADER.format(what="program", name="Affero General Public License", version="3"),
                 "GNU Affero General Public License, version 3", "SPDX-License-Identifier: AGPL-3.0-only", "License: AGPLv3", "AGPLv3", "AGPL-3.0"],
    "BSD-3-Clause": [_BSD + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
                     "derived from this software without specific prior written permission.", "License: BSD-3-Clause"],
    "BSD-2-Clause": [_BSD, "SPDX-License-Identifier: BSD-2-Clause", "Licensed under the BSD 2-Clause License", "License: BSD-2-Clause"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
                "file, You can obtain one at https://mozilla.org/MPL/2.0/.", "Mozilla Public License Version 2.0", "License: MPL-2.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
                  "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
                  "non-commercial, and by any means.", "SPDX-License-Identifier: Unlicense", "License: Unlicense"],
    "CC0-1.0": ["To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the "
                "public domain worldwide. This software is distributed without any warranty.", "SPDX-License-Identifier: CC0-1.0", "License: CC0 1.0"],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
                "SPDX-License-Identifier: EPL-2.0", "License: EPL-2.0"],
    "Artistic-2.0": ["Licensed under the Artistic License 2.0", "SPDX-License-Identifier: Artistic-2.0", "License: Artistic-2.0"],
    "CC-BY-4.0": ["CC BY 4.0"], "CC-BY-SA-4.0": ["CC BY-SA 4.0"], "CC-BY-NC-4.0": ["CC BY-NC 4.0"],
}
# Shorter templates are compared with whole lines only: in running text such a mark is a mention.
SHORTEST_WINDOW = 4
# Lines of at most this many words are passages themselves.
SHORT_LINE = 10
# A document of which such a share lies in one match with a template of at least so many words is a licence text.
WHOLE_TEXT, WHOLE_TEXT_WORDS = 0.8, 60
# Scores of passages that one Python worker keeps.
KEPT_SCORES = 200_000
_ANCHORS = {"unencumbered", "license", "licence", "licensed", "licenced", "copyright", "reserved", "permission", "redistribution", "creative", "spdx", "gnu", "mozilla",
            "apache", "proprietary", "cc", "mpl", *(a + v for a in ("gpl", "lgpl", "agpl") for v in ("", "v2", "v2.1", "v3"))}
_VOCABULARY = (r"(?i)licen[sc]e|all rights reserved|copyright|creative commons|free software|permission is hereby|"
               r"redistribution and use|proprietary and confidential")
_HINT = _VOCABULARY + r"|\b[al]?gpl|\bcc[ -]by\b|mozilla public|permission to use|free software foundation|unencumbered software"
# A run of letters and digits, with decimals as in version numbers.
_WORD = r"[\p{L}\p{N}]+(?:\.[0-9]+)*"
_FILE_NAME = r"(?i)(^|/)(licen[sc]e|copying|unlicense|notice)([.-][^/]*)?$"


def _templates(spark: SparkSession) -> DataFrame:
    rows = [(f"{name}#{i}", name, text) for name, texts in TEMPLATES.items() for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, "template string, licence string, line string")


def _counts(lines: DataFrame, key: list[str]) -> DataFrame:
    """(key, term, tf): words and word pairs of ``line``, lower-cased, with their counts."""
    words = F.regexp_extract_all(F.lower("line"), F.lit(_WORD), F.lit(0))
    # Pairs tell apart what differs in a short mark only, as CC BY and CC BY-NC do.
    pairs = F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda i: F.concat_ws(" ", F.get("words", i - 1), F.get("words", i)))
    terms = F.concat("words", F.when(F.size("words") > 1, pairs).otherwise(F.array().cast("array<string>")))
    return (lines.select(*key, words.alias("words")).select(*key, F.explode(terms).alias("term"))
            .groupBy(*key, "term").agg(F.count("*").alias("tf")))


def licence_lines(docs: DataFrame) -> DataFrame:
    """(line): the different lines, or pieces of longer ones, that hold licence vocabulary."""
    with_words = docs.where(F.col("text").rlike(_VOCABULARY)).select(F.explode(_candidate_lines()).alias("line"))
    return with_words.distinct()


def _candidate_lines() -> Column:
    lines = F.flatten(F.transform(F.split("text", r"\r\n|\n|\r"), lambda line: F.transform(
        F.sequence(F.lit(0), F.floor((F.greatest(F.length(line), F.lit(1)) - 1) / PIECE)),
        lambda i: F.substr(line, (i * PIECE + 1).cast("int"), F.lit(PIECE)))))
    return F.filter(lines, lambda line: line.rlike(_VOCABULARY))


def line_licences(lines: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(line, licence, score): the most similar template of each different line, if it is similar enough.

    Inverse document frequencies are counted over all templates and lines; of equal scores the first name wins.
    """
    templates = _templates(lines.sparkSession)
    of_lines, of_templates = written(_counts(lines, ["line"]), "terms"), _counts(templates, ["template", "licence"])
    both = of_lines.select("term", F.lit(1).alias("n")).unionAll(of_templates.select("term", F.lit(1)))
    total = lines.select(F.lit(1)).unionAll(templates.select(F.lit(1))).count()
    idf = both.groupBy("term").agg(F.log((F.lit(1.0) + total) / (1.0 + F.count("*"))).alias("idf")).withColumn("idf", F.col("idf") + 1.0)
    weight = (F.col("tf") * F.col("idf")).alias("w")
    line_weights = written(of_lines.join(idf, "term").select("line", "term", weight), "weights")
    template_weights = of_templates.join(idf, "term").select("template", "licence", "term", weight)
    norms = line_weights.groupBy("line").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("line_norm"))
    template_norms = template_weights.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("template_norm"))
    dots = (line_weights.join(template_weights.withColumnRenamed("w", "v"), "term")
            .groupBy("line", "template", "licence").agg(F.sum(F.col("w") * F.col("v")).alias("dot")))
    cosine = F.round(F.col("dot") / (F.col("line_norm") * F.col("template_norm")), 9)
    scored = dots.join(norms, "line").join(template_norms, "template").select("line", "licence", cosine.alias("score")).where(F.col("score") >= similarity)
    best = scored.groupBy("line").agg(F.min(F.struct((-F.col("score")).alias("least"), "licence")).alias("best"))
    return best.select("line", "best.licence", (-F.col("best.least")).alias("score"))


def _split(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", text.lower())


_WORDS = regex.compile(_WORD)
_HINTED = re.compile(_HINT)
_LINES = re.compile("\r\n|\n|\r")


class PassageTemplates:
    """All templates as weighted terms, found by the licence words in them."""

    def __init__(self, similarity: float):
        self.similarity = similarity
        texts = [(name, _split(text)) for held in (TEMPLATES, HEADERS) for name, all_ in held.items() for text in all_]
        counts = [self._terms(words) for _, words in texts]
        frequency = Counter(term for count in counts for term in count)
        self.idf = {term: log((1.0 + len(texts)) / (1.0 + n)) + 1.0 for term, n in frequency.items()}
        self.rare = log(1.0 + len(texts)) + 1.0
        self.names = [name for name, _ in texts]
        self.sizes = [len(words) for _, words in texts]
        self.weights = [{term: n * self.idf[term] for term, n in count.items()} for count in counts]
        self.totals = [sum(v * v for v in weights.values()) for weights in self.weights]
        # The squared weights of a word and of the pairs it begins.
        self.mass: list[dict[str, float]] = []
        self.anchored: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for number, (_, words) in enumerate(texts):
            mass: dict[str, float] = defaultdict(float)
            for term, weight in self.weights[number].items():
                mass[term.split(" ")[0]] += weight * weight
            self.mass.append(dict(mass))
            for at, word in enumerate(words):
                if word in _ANCHORS:
                    self.anchored[word].append((number, at))
        self.known: dict[tuple[int, tuple[str, ...]], float] = {}

    @staticmethod
    def _terms(words: list[str] | tuple[str, ...]) -> Counter:
        return Counter([*words, *map(" ".join, zip(words, words[1:]))])

    def passages(self, text: str, words: list[str]) -> set[tuple[int, tuple[str, ...]]]:
        """(template, words) of the windows that a template's licence words lay on the text, and of its short lines."""
        found = set()
        for i, word in enumerate(words):
            for number, at in self.anchored.get(word, ()):
                if self.sizes[number] >= SHORTEST_WINDOW:
                    found.add((number, tuple(words[max(i - at, 0):i - at + self.sizes[number]])))
        for line in set(_LINES.split(text)):
            if _HINTED.search(line):
                own = _WORDS.findall(line.lower())
                if len(own) <= SHORT_LINE:
                    found |= {(number, tuple(own)) for word in set(own) for number, _ in self.anchored.get(word, ())}
        return found

    def score(self, number: int, passage: tuple[str, ...]) -> float:
        """Cosine of passage and template, rounded; 0 where it cannot be similar enough.

        By the Cauchy-Schwarz inequality a cosine is at most the root of the share that the common words have in the squared
        weights of the template, so nothing that is similar enough is left out.
        """
        key = (number, passage)
        if key not in self.known:
            if len(self.known) >= KEPT_SCORES:
                self.known.clear()
            mass, total = self.mass[number], self.totals[number]
            score = 0.0
            if sum(mass.get(word, 0.0) for word in set(passage)) >= (self.similarity ** 2 - 1e-9) * total:
                weights = self.weights[number]
                own = {term: n * self.idf.get(term, self.rare) for term, n in self._terms(passage).items()}
                dot = sum(v * weights.get(term, 0.0) for term, v in own.items())
                score = floor(dot / sqrt(sum(v * v for v in own.values()) * total) * 1e9 + 0.5) / 1e9
            self.known[key] = score
        return self.known[key]

    def best(self, text: str) -> tuple[str, float, bool] | None:
        """(licence, score, whole) of the template that explains most of a passage of the text.

        Of the templates that are similar enough the one with the largest product of cosine and length of its vector wins, so a
        header outweighs a shorter notice inside it; a licence outweighs a reservation of rights. ``whole``: the passage is
        nearly the whole text and a licence text.
        """
        words = _WORDS.findall(text.lower())
        ranked = []
        for number, passage in self.passages(text, words):
            score = self.score(number, passage)
            if score >= self.similarity:
                whole = self.sizes[number] >= WHOLE_TEXT_WORDS and len(passage) >= WHOLE_TEXT * len(words)
                ranked.append((self.names[number] == "Proprietary", -round(score * sqrt(self.totals[number]), 6), self.names[number], -score, not whole))
        if not ranked:
            return None
        _, _, name, unlike, part = min(ranked)
        return name, -unlike, not part


def _best_passages(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    templates = PassageTemplates(similarity)
    for batch, values in steps(batches, "text"):
        found = [(key, *best) for key, value in zip(batch.column("text_key").to_pylist(), values)
                 if (best := templates.best(value.decode("utf-8", "replace")))]
        columns = list(zip(*found)) if found else [[], [], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.string(), pa.float64(), pa.bool_()))],
            ["text_key", "passage_licence", "passage_score", "whole"])


def passage_licences(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(text_key, passage_licence, passage_score, whole) for each different text that has one (``PassageTemplates.best``).

    ``docs`` has text and text_key. Texts are read where they lie; one short row for each that has a licence is shuffled.
    """
    ship(docs.sparkSession)
    found = map_arrow(docs.select("text_key", "text"), lambda batches: _best_passages(batches, similarity),
                      "text_key STRING, passage_licence STRING, passage_score DOUBLE, whole BOOLEAN")
    return found.distinct()


_DIRECTORY = "/?[^/]*$"


def _above(directory: str) -> Column:
    """The directory and those above it, nearest first; the empty one is the top."""
    names = F.filter(F.split(directory, "/"), lambda name: name != "")
    return F.transform(F.sequence(F.size(names), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(names, F.lit(1), n), "/"))


def scan_licences(docs: DataFrame, path: Column, similarity: float = SIMILARITY, file_share: float | None = None) -> DataFrame:
    """One row per document: doc_id, path, licence, score, how (own, inherited or none), from_directory.

    ``licence`` is that of the document's own passage that explains most, else of its most similar line, else the one its nearest ancestor directory has from
    its licence files (the most frequent one there, then the first by name). Null and empty texts have no licence of their own, a
    null path is the empty one, at the top; a null doc_id stays null; repeated rows give repeated results; an empty table gives an empty result.
    With ``file_share`` a document with at least that share of its characters in different licence lines counts as a licence file too.
    """
    placed = docs.select("doc_id", "text", F.coalesce(path.cast("string"), F.lit("")).alias("path"))
    # The one pass that looks for vocabulary; what follows reads these texts only.
    hinted = written(placed.where(F.col("text").rlike(_HINT)).select("path", "text", F.sha2("text", 256).alias("text_key")), "hinted")
    known = written(line_licences(licence_lines(hinted), similarity), "lines")
    named_file = F.col("path").rlike(_FILE_NAME)
    # Rows are found again by (path, text): equal ones get equal answers.
    suspects = hinted.where(F.col("text").rlike(_VOCABULARY)).select(
        "path", "text_key", F.length("text").alias("size"), F.explode(F.array_distinct(_candidate_lines())).alias("line"))
    once = suspects.join(known, "line").groupBy("path", "text_key", "line").agg(
        F.min("licence").alias("licence"), F.min("score").alias("score"), F.min("size").alias("size"))
    own = once.groupBy("path", "text_key").agg(
        F.min(F.struct((-F.col("score")).alias("least"), "licence")).alias("best"), (F.sum(F.length("line")) / F.min("size")).alias("share"))
    of_lines = own.select("path", "text_key", F.col("best.licence").alias("line_own"), (-F.col("best.least")).alias("line_score"), "share")
    passages = passage_licences(hinted, similarity)
    # Where both agree, the better score counts.
    alike = F.col("passage_licence").isNull() | F.coalesce(F.col("passage_licence") == F.col("line_own"), F.lit(False))
    own = written(hinted.select("path", "text_key").distinct().join(of_lines, ["path", "text_key"], "left").join(passages, "text_key", "left").select(
        "path", "text_key", F.coalesce("passage_licence", "line_own").alias("own"),
        F.when(alike, F.greatest("line_score", "passage_score")).otherwise(F.col("passage_score")).alias("own_score"),
        F.coalesce("share", F.lit(0.0)).alias("share"), F.coalesce("whole", F.lit(False)).alias("whole")).where("own is not null"), "own")
    mostly = F.lit(False) if file_share is None else F.col("share") >= file_share
    speaking = own.where(named_file | F.col("whole") | mostly).withColumn(
        "directory", F.regexp_replace("path", _DIRECTORY, ""))
    votes = speaking.groupBy("directory", "own").agg(F.count("*").alias("n"), F.min("own_score").alias("score"))
    declared = votes.groupBy("directory").agg(F.min(F.struct((-F.col("n")).alias("rarity"), "own", "score")).alias("most")).select(
        "directory", F.col("most.own").alias("given"), F.col("most.score").alias("given_score"))
    directories = placed.select(F.regexp_replace("path", _DIRECTORY, "").alias("at")).distinct()
    ancestors = directories.select("at", F.posexplode(_above("at")).alias("up", "directory"))
    nearest = ancestors.join(declared, "directory").groupBy("at").agg(
        F.min(F.struct("up", "directory", "given", "given_score")).alias("near")).select("at", "near.*")
    rows = placed.select("doc_id", "path", F.sha2("text", 256).alias("text_key"), F.regexp_replace("path", _DIRECTORY, "").alias("at"))
    answered = rows.join(own.drop("share", "whole"), ["path", "text_key"], "left").join(nearest.drop("up"), "at", "left")
    mine = F.col("own").isNotNull()
    return answered.select(
        "doc_id", "path", F.coalesce("own", "given").alias("licence"), F.coalesce("own_score", "given_score").alias("score"),
        F.when(mine, "own").when(F.col("given").isNotNull(), "inherited").otherwise("none").alias("how"),
        F.when(~mine, F.col("directory")).alias("from_directory"))
