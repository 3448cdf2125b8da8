"""Licence scan: sparse TF-IDF cosine to templates and inheritance from directories (operator 8).

DataFrame functions only. The vectors of a file are its blocks (runs of lines without a blank line or a tag
between), the lines of each block, and, of a file named like a licence file, the whole text. A vector has
all words, weighed by their inverse frequency over all files; templates are notices, heads of licences and
whole short licences. By the Cauchy-Schwarz inequality a vector without any of the key words of a template,
those whose rest has a norm below the threshold, cannot reach it; so vectors are filtered by one set lookup
before their words are joined with their frequencies. A licence file licenses its directory; a file without
a licence of its own takes that of its nearest ancestor directory, found by an equality join of the file's
ancestors with the licensed directories.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.saved import saved

# The words by which these licences are given, and the short ones whole.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""
_MIT_REST = """The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"""
_BSD_1_2 = """Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_REST = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
_ISC_REST = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_4 = """All advertising materials mentioning features or use of this software must display the following acknowledgement:"""
_MIT_0 = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so."""
_ISC_0 = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."""
_GNU = "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version."
_SHORT = "This {0} is licensed under the GNU {1}, version {2}"
_GPL, _LGPL, _AGPL = "General Public License", "Lesser General Public License", "Affero General Public License"
TEMPLATES = {
    "0bsd": [_ISC_0, "BSD Zero Clause License", "Zero-Clause BSD", f"{_ISC_0} {_ISC_REST}"],
    "agpl-3.0": [_SHORT.format("program", _AGPL, 3), "GNU Affero General Public License Version 3, 19 November 2007", _GNU.format("program", _AGPL, 3)],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'],
    "bsd": [_BSD],
    "bsd-2-clause": [f"BSD 2-Clause License {_BSD} {_BSD_1_2} {_BSD_REST}"],
    "bsd-3-clause": [f"BSD 3-Clause License {_BSD} {_BSD_1_2} {_BSD_3} {_BSD_REST}", _BSD_3],
    "bsd-4-clause": [f"BSD 4-Clause License {_BSD} {_BSD_1_2} {_BSD_4} {_BSD_3} {_BSD_REST}", _BSD_4],
    "cc-by-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-nc-nd-4.0": ["Licensed under CC BY-NC-ND 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
    "cc-by-nc-sa-4.0": ["Licensed under CC BY-NC-SA 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "cc-by-nd-4.0": ["Licensed under CC BY-ND 4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc0-1.0": ["Dedicated to the public domain under CC0 1.0", "CC0 1.0 Universal"],
    "epl-2.0": ["This program is made available under the terms of the Eclipse Public License 2.0", "Eclipse Public License - v 2.0"],
    "gpl-2.0": ["This work is licensed under the GNU General Public License, version 2", _SHORT.format("program", _GPL, 2), "GNU General Public License Version 2, June 1991", _GNU.format("program", _GPL, 2)],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3", _SHORT.format("program", _GPL, 3), "GNU General Public License Version 3, 29 June 2007", _GNU.format("program", _GPL, 3)],
    "isc": [_ISC, f"ISC License {_ISC} {_ISC_REST}"],
    "lgpl-2.0": [_SHORT.format("library", "Library General Public License", 2), "GNU Library General Public License Version 2, June 1991", _GNU.format("library", "Library General Public License", 2)],
    "lgpl-2.1": [_SHORT.format("library", _LGPL, 2.1), "GNU Lesser General Public License Version 2.1, February 1999", _GNU.format("library", _LGPL, 2.1)],
    "lgpl-3.0": [_SHORT.format("library", _LGPL, 3), "GNU Lesser General Public License Version 3, 29 June 2007", _GNU.format("library", _LGPL, 3)],
    "mit": ["Released under the MIT License", _MIT, f"MIT License {_MIT} {_MIT_REST}"],
    "mit-0": ["Released under the MIT-0 License", "MIT No Attribution", _MIT_0, f"MIT No Attribution {_MIT_0} {_MIT_REST.split('. ', 1)[1]}"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/", "Mozilla Public License Version 2.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
}
# Signs are patterns over a unit's words, joined by one space, that tell licences with much the same words apart.
SIGNS = {
    "negated": r"(?:not|no longer|never|nor|cannot|[a-z]+n t)(?: [^ ]+){0,3} (?:released|licensed|dedicated|available|covered|subject|under)",
    "version 2": r"v?2(?:\.0)?",
    "version 2.1": r"v?2\.1",
    "version 3": r"v?3(?:\.0)?",
    "version 4": r"v?4(?:\.0)?",
    "affero": r"affero|agpl",
    "lesser": r"lesser|lgpl",
    "library": r"library general public",
    "mit": r"mit|subject to the following conditions",
    "conditions": r"subject to the following conditions",
    "no attribution": r"mit-0|mit no attribution",
    "appear": r"appear in all copies",
    "advertising": r"advertising materials",
    "endorse": r"endorse or promote",
    "noncommercial": r"[a-z-]*non-?commercial[a-z-]*|nc|by-nc[a-z-]*",
    "noderivatives": r"[a-z-]*noderiv[a-z-]*|nd|by-(?:nc-)?nd",
    "sharealike": r"[a-z-]*share-?alike[a-z-]*|sa|by-(?:nc-)?sa",
}
#: Signs that a unit must show to be of a licence, and signs that it must not show unless the template does.
NEEDS = {
    "agpl-3.0": ["version 3", "affero"],
    "apache-2.0": ["version 2"],
    "bsd-3-clause": ["endorse"],
    "bsd-4-clause": ["advertising"],
    "cc-by-4.0": ["version 4"],
    "cc-by-nc-4.0": ["version 4", "noncommercial"],
    "cc-by-nc-nd-4.0": ["version 4", "noncommercial", "noderivatives"],
    "cc-by-nc-sa-4.0": ["version 4", "noncommercial", "sharealike"],
    "cc-by-nd-4.0": ["version 4", "noderivatives"],
    "cc-by-sa-4.0": ["version 4", "sharealike"],
    "epl-2.0": ["version 2"],
    "gpl-2.0": ["version 2"],
    "gpl-3.0": ["version 3"],
    "isc": ["appear"],
    "lgpl-2.0": ["version 2", "library"],
    "lgpl-2.1": ["version 2.1", "lesser"],
    "lgpl-3.0": ["version 3", "lesser"],
    "mit": ["mit"],
    "mpl-2.0": ["version 2"],
}
BARS = {
    "0bsd": ["appear"],
    "agpl-3.0": ["lesser"],
    "bsd-2-clause": ["endorse", "advertising"],
    "bsd-3-clause": ["advertising"],
    "cc-by-4.0": ["noncommercial", "noderivatives", "sharealike"],
    "cc-by-nc-4.0": ["noderivatives", "sharealike"],
    "cc-by-nd-4.0": ["noncommercial", "sharealike"],
    "cc-by-sa-4.0": ["noncommercial", "noderivatives"],
    "gpl-2.0": ["affero", "lesser", "library"],
    "gpl-3.0": ["affero", "lesser", "library"],
    "mit": ["no attribution"],
    "mit-0": ["conditions"],
}
#: Licences whose words are part of another's: where a file holds both, only the second counts.
PART_OF = [("0bsd", "isc"), ("bsd", "bsd-2-clause"), ("bsd", "bsd-3-clause"), ("bsd", "bsd-4-clause"), ("bsd-2-clause", "bsd-3-clause"), ("bsd-2-clause", "bsd-4-clause"), ("bsd-3-clause", "bsd-4-clause"), ("mit-0", "mit")]
TAG = "<[^>]*>"
#: Between blocks: a tag, or a line without a word.
BLOCK_END = r"<[^>]*>|\n[^\p{L}\p{N}\n]*\n"
WORD = r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*"
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)[^/]*$"
THRESHOLD = 0.8


def words_in(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", text.lower())


def template_counts(templates: dict[str, list[str]] = TEMPLATES) -> dict[tuple[str, int], dict[str, int]]:
    """Words of each template, by licence and number."""
    return {(name, k): dict(Counter(words_in(text))) for name, texts in templates.items() for k, text in enumerate(texts)}


def sign(name: str) -> str:
    return f"(?:^| )(?:{SIGNS[name]})(?: |$)"


def rules(templates: dict[str, list[str]] = TEMPLATES) -> dict[tuple[str, int], tuple[int, int]]:
    """The signs that each template needs and bars, as bits in the order of SIGNS."""
    bits = lambda names: sum(1 << list(SIGNS).index(n) for n in set(names))
    out = {}
    for name, texts in templates.items():
        for k, text in enumerate(texts):
            own = [n for n in SIGNS if re.search(sign(n), " ".join(words_in(text)))]
            out[name, k] = bits(NEEDS.get(name, [])), bits({"negated", *BARS.get(name, [])} - set(own))
    return out


def weights(idf: dict[str, float], counted: dict[tuple[str, int], dict[str, int]]) -> dict[tuple[str, int], dict[str, float]]:
    """Unit TF-IDF vector of each template."""
    out = {}
    for name, counts in counted.items():
        norm = math.sqrt(sum((n * idf[w]) ** 2 for w, n in counts.items()))
        out[name] = {w: n * idf[w] / norm for w, n in counts.items()}
    return out


def key_words(vectors: dict[tuple[str, int], dict[str, float]], df: dict[str, int], threshold: float) -> set[str]:
    """Words of which a vector needs at least one to reach the threshold with any template: of each, the rarest that leave a rest below it."""
    keys = set()
    for vector in vectors.values():
        left = 1.0
        for word, w in sorted(vector.items(), key=lambda x: (df.get(x[0], 0), x[0])):
            if math.sqrt(max(0.0, left)) < threshold - 1e-9:
                break
            keys.add(word)
            left -= w * w
    return keys


def license_scan(files: DataFrame, threshold: float = THRESHOLD, texts: dict[str, list[str]] | None = None) -> DataFrame:
    """Licences of files(file_id, path, text); texts adds whole licences to the templates, by name, for licence files.

    Returns a row for each file: file_id, path, own_license and own_similarity (of its best line, block or
    whole licence file, rounded to 6 places; null where none reaches the threshold), other_licenses (all further
    ones that the file holds, sorted, joined by commas, or null), licensed_by (the nearest ancestor directory
    with a licence file, for files without their own) and license. Ties go to the licence that sorts first. A
    unit counts for a licence only with its version number and the other signs of NEEDS, without those of BARS,
    and not where it says that the licence does not hold. A null text or path has no lines or no directories; rows may repeat, and each gives a
    row. A table without words gives rows without licences. Further columns are ignored.
    """
    spark = files.sparkSession
    files = files.select(F.col("file_id").cast("long").alias("file_id"), F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    files = files.withColumn("row", F.sha2(F.to_json(F.struct("file_id", "path", "text")), 256))
    words_of = lambda text: F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    plain = F.regexp_replace(F.lower("text"), TAG, " ")
    each = F.concat(F.array(F.lit("")), F.array_distinct(words_of(plain)))
    seen = files.where("text IS NOT NULL").select(F.explode(each).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    seen = saved(seen)
    templates = {name: [*TEMPLATES.get(name, []), *(texts or {}).get(name, [])] for name in sorted({*TEMPLATES, *(texts or {})})}
    template_words, needed = template_counts(templates), rules(templates)
    vocabulary = sorted({w for counts in template_words.values() for w in counts})
    df = {r.word: r.n for r in seen.where(F.col("word").isin(["", *vocabulary])).collect()}  # a row for each word of the templates, and "" for the files
    n_files = df.get("", 0)
    vectors = weights({w: math.log((n_files + 1) / (df.get(w, 0) + 1)) + 1 for w in vocabulary}, template_words)
    keys = sorted(key_words(vectors, df, threshold))

    blocks = F.split(F.lower("text"), BLOCK_END, -1)
    units = F.flatten(F.transform(blocks, lambda b: F.when(F.contains(b, F.lit("\n")), F.concat(F.array(b), F.split(b, "\n", -1))).otherwise(F.array(b))))
    units = F.when(F.col("path").rlike(LICENCE_FILE), F.concat(units, F.array(plain))).otherwise(units)
    units = files.select("row", F.explode(units).alias("unit")).select("row", words_of(F.col("unit")).alias("words"))
    hits = units.where(F.exists("words", lambda w: w.isin(keys))).distinct().withColumn("unit_text", F.array_join("words", " "))
    signs = sum((F.when(F.col("unit_text").rlike(sign(name)), 1 << i).otherwise(0) for i, name in enumerate(SIGNS)), F.lit(0))
    hits = saved(hits.select("row", "words", F.sha2("unit_text", 256).alias("unit"), signs.alias("signs")))
    counted = hits.select("row", "unit", "signs", F.explode("words").alias("word")).groupBy("row", "unit", "signs", "word").agg(F.count("*").alias("tf"))
    priced = counted.join(seen, "word").select("row", "unit", "signs", "word", (F.col("tf") * (F.log((F.lit(n_files) + 1) / (F.col("n") + 1)) + 1)).alias("x"))
    norm = priced.groupBy("row", "unit").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    terms = spark.createDataFrame([(name, k, *needed[name, k], w, x) for (name, k), v in vectors.items() for w, x in v.items()], "template string, part int, needs int, bars int, word string, weight double")
    fits = (F.col("signs").bitwiseAND(F.col("needs")) == F.col("needs")) & (F.col("signs").bitwiseAND(F.col("bars")) == 0)
    dot = priced.join(F.broadcast(terms), "word").where(fits).groupBy("row", "unit", "template", "part").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))  # terms: a row for each word of a template
    near = dot.join(norm, ["row", "unit"]).select("row", "template", F.round(F.col("dot") / F.col("norm"), 6).alias("similarity")).where(F.col("similarity") >= threshold)
    found = near.groupBy("row", "template").agg(F.max("similarity").alias("similarity"))
    found = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct((-F.col("similarity")).alias("less"), "template"))).alias("found"), F.collect_set("template").alias("names"))  # an entry for each licence at most
    covered = lambda s: reduce(or_, ((s["template"] == part) & F.array_contains("names", whole) for part, whole in PART_OF))
    best = found.select("row", F.filter("found", lambda s: ~covered(s)).alias("found"))
    others = F.array_join(F.array_sort(F.transform(F.slice("found", 2, len(templates)), lambda s: s["template"])), ",")
    best = saved(best.select("row", F.col("found")[0]["template"].alias("own_license"), (-F.col("found")[0]["less"]).alias("own_similarity"), F.nullif(others, F.lit("")).alias("other_licenses")))

    out = files.drop("text").join(best, "row", "left")
    parts = F.split(F.regexp_replace("path", "/[^/]*$", ""), "/")
    has_folder = F.col("path").contains("/")
    granted = out.where(F.col("own_license").isNotNull() & F.col("path").rlike(LICENCE_FILE)).select(F.when(has_folder, F.regexp_replace("path", "/[^/]*$", "")).otherwise("").alias("folder"), "own_license")
    granted = granted.groupBy("folder").agg(F.min("own_license").alias("granted"))
    bare = out.where("own_license IS NULL AND path IS NOT NULL").select("row", parts.alias("parts"), has_folder.alias("deep")).distinct()
    depths = F.when(F.col("deep"), F.sequence(F.lit(0), F.size("parts"))).otherwise(F.array(F.lit(0)))
    above = bare.select("row", "parts", F.explode(depths).alias("depth")).select("row", "depth", F.when(F.col("depth") == 0, "").otherwise(F.array_join(F.slice("parts", 1, F.col("depth")), "/")).alias("folder"))
    taken = above.join(granted, "folder").groupBy("row").agg(F.max_by("folder", "depth").alias("licensed_by"), F.max_by("granted", "depth").alias("granted"))
    return out.join(taken, "row", "left").select("file_id", "path", "own_license", "own_similarity", "other_licenses", "licensed_by", F.coalesce("own_license", "granted").alias("license"))


def sql(threshold: float = THRESHOLD) -> str:
    """The same over the table pages, whose addresses are paths, for DuckDB."""
    needed = rules()
    rows = ", ".join(f"('{t}', {k}, {needed[t, k][0]}, {needed[t, k][1]}, '{w}', {n})" for (t, k), counts in template_counts().items() for w, n in counts.items())
    signs = " + ".join(f"CASE WHEN regexp_matches(array_to_string(words, ' '), '{sign(name)}') THEN {1 << i} ELSE 0 END" for i, name in enumerate(SIGNS))
    pairs = ", ".join(f"('{part}', '{whole}')" for part, whole in PART_OF)
    return rf"""
WITH files AS (SELECT page_id AS file_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path, lower(html) AS text FROM pages),
blocks AS (SELECT file_id, unnest(regexp_split_to_array(text, '{BLOCK_END}')) AS block FROM files),
parts AS (SELECT file_id, block AS part FROM blocks UNION SELECT file_id, unnest(string_split(block, chr(10))) FROM blocks UNION SELECT file_id, regexp_replace(text, '{TAG}', ' ', 'g') FROM files WHERE regexp_matches(path, '{LICENCE_FILE}')),
units AS (SELECT file_id, unit, words, {signs} AS signs FROM (SELECT file_id, row_number() OVER () AS unit, regexp_extract_all(part, '{WORD}') AS words FROM parts) WHERE len(words) > 0),
df AS (SELECT word, count(*) AS df FROM (SELECT DISTINCT file_id, unnest(regexp_extract_all(regexp_replace(text, '{TAG}', ' ', 'g'), '{WORD}')) AS word FROM files) GROUP BY word),
idf AS (SELECT word, ln(((SELECT count(text) FROM files) + 1) / (df + 1)) + 1 AS idf FROM df),
t(template, part, needs, bars, word, n) AS (VALUES {rows}),
t_idf AS (SELECT t.*, coalesce(idf, ln((SELECT count(text) FROM files) + 1) + 1) AS idf FROM t LEFT JOIN idf USING (word)),
unit AS (SELECT template, part, needs, bars, word, n * idf / sqrt(sum(pow(n * idf, 2)) OVER (PARTITION BY template, part)) AS w FROM t_idf),
counted AS (SELECT file_id, unit, signs, word, count(*) AS tf FROM (SELECT file_id, unit, signs, unnest(words) AS word FROM units) GROUP BY ALL),
priced AS (SELECT file_id, unit, signs, word, tf * idf AS x FROM counted JOIN idf USING (word)),
norms AS (SELECT unit, sqrt(sum(x * x)) AS norm FROM priced GROUP BY unit),
dots AS (SELECT file_id, priced.unit, template, part, sum(x * w) AS dot FROM priced JOIN unit USING (word) WHERE (signs & needs) = needs AND (signs & bars) = 0 GROUP BY ALL),
near AS (SELECT file_id, template, round(dot / norm, 6) AS s FROM dots JOIN norms USING (unit) WHERE round(dot / norm, 6) >= {threshold}),
found AS (SELECT file_id, template, max(s) AS s FROM near GROUP BY ALL),
part_of(part, whole) AS (VALUES {pairs}),
uncovered AS (SELECT * FROM found WHERE NOT EXISTS (SELECT 1 FROM part_of JOIN found AS other ON other.template = whole WHERE part = found.template AND other.file_id = found.file_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY s DESC, template) AS place FROM uncovered),
best AS (SELECT file_id, max(template) FILTER (place = 1) AS template, max(s) AS s, string_agg(template, ',' ORDER BY template) FILTER (place > 1) AS others FROM ranked GROUP BY file_id),
own AS (SELECT files.file_id, path, template AS own_license, s, others FROM files LEFT JOIN best USING (file_id)),
granted AS (SELECT CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS folder, min(own_license) AS granted FROM own WHERE own_license IS NOT NULL AND regexp_matches(path, '{LICENCE_FILE}') GROUP BY 1),
taken AS (SELECT file_id, folder, granted FROM own JOIN granted ON folder = '' OR starts_with(path, folder || '/') WHERE own_license IS NULL QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY length(folder) DESC) = 1)
SELECT file_id, path, own_license, s AS own_similarity, others AS other_licenses, folder AS licensed_by, coalesce(own_license, granted) AS license FROM own LEFT JOIN taken USING (file_id)
"""
