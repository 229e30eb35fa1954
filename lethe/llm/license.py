"""Licence scans with DataFrame functions only: TF-IDF cosine to templates, then inheritance by path.

Templates are notices, standard headers, SPDX identifiers, whole short licences and the openings of
long ones.  Where a line of a file speaks of rights, that line and the 2, 4, 8, 16 and 32 lines that
begin with it are sparse TF-IDF vectors, so that a header wrapped over lines counts as a whole; so is
the whole text of a licence file (LICENSE, LICENCE, COPYING or NOTICE by name).  Inverse document
frequencies come from the templates, a fixed and small set; words that no template has count in full
for the length of a vector.  A file's own licence is that of the template of highest cosine, at least
``THRESHOLD``; the first by name of equal ones.  Templates of ``WEAK`` licences, such as "All rights
reserved.", which stands in other licences too, count only where no other reaches the threshold.
Vectors are computed in the row, so no text is shuffled.

A file without one inherits from the nearest directory above it, its own first, with a licence file.
Ancestors are exploded from the distinct directories and joined to the directories with a licence.

Null and empty texts have no licence of their own; a null path inherits nothing; repeated rows give
repeated rows.  Of several licence files in a directory the highest score counts, then the first
licence and path by name.  An empty table gives no rows.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lethe.plans import scratch

# Words of well-known licences and notices; what follows a blank in a name tells templates of one licence apart.
TEMPLATES = {
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0 opening": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0 opening": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "BSD-2-Clause notice": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License. Redistribution and use in source and binary forms, with or without modification, are permitted.",
    "BSD-3-Clause text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0 header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-2.0 opening": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0 opening": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS.",
    "LGPL-2.1 header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-3.0 opening": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "MIT": "Released under the MIT License.",
    "MIT text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Proprietary": "All rights reserved.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
_IDS = sorted({name.partition(" ")[0] for name in TEMPLATES} - {"Proprietary"})
TEMPLATES |= {f"{x} spdx{end}": f"SPDX-License-Identifier: {x}{end}" for x in _IDS for end in (("", "-only", "-or-later") if "GPL" in x else ("",))}
WEAK = frozenset({"Proprietary"})
WIDTHS = (1, 2, 4, 8, 16, 32)
THRESHOLD = 0.6
TOKEN = "[a-z0-9]+(?:[.+-][a-z0-9]+)*"
LINE = "licen[sc]|copyright|spdx|public domain|rights reserved|redistribut|permission"
FILE = "^(?i:licen[sc]e|copying|notice)([.-].*)?$"


def licence_of(template: str) -> str:
    return template.partition(" ")[0]


def tokens(line: str) -> list[str]:
    return re.findall(TOKEN, line.lower())


def idf(templates: dict[str, str]) -> tuple[dict[str, float], float]:
    """Inverse document frequency by word, and of words in no template."""
    n, df = len(templates), {}
    for text in templates.values():
        for w in set(tokens(text)):
            df[w] = df.get(w, 0) + 1
    return {w: math.log((1 + n) / (1 + k)) + 1 for w, k in sorted(df.items())}, math.log(1 + n) + 1


def weights(templates: dict[str, str]) -> dict[str, dict[str, float]]:
    """By template: word to the part that one occurrence in a line adds to the dot product."""
    known, _ = idf(templates)
    out = {}
    for name, text in sorted(templates.items()):
        tf: dict[str, int] = {}
        for w in tokens(text):
            tf[w] = tf.get(w, 0) + 1
        length = math.sqrt(sum((k * known[w]) ** 2 for w, k in tf.items()))
        out[name] = {w: k * known[w] ** 2 / length for w, k in sorted(tf.items())}
    return out


def _map(values: dict[str, float]) -> str:
    return "map(" + ", ".join(f"'{w}', {v!r}D" for w, v in values.items()) + ")"


def _best(units: str, templates: dict[str, str], threshold: float) -> str:
    """SQL for the best (weak, negative score, licence) of an array of texts; null where none reaches the threshold."""
    known, other = idf(templates)
    words = f"regexp_extract_all(lower(l), '{TOKEN}', 0)"
    weight = f"coalesce(element_at({_map(known)}, x), {other!r}D)"
    square = f"aggregate(array_sort(w), named_struct('p', '', 'r', 0D, 't', 0D), (s, x) -> named_struct('p', x, 'r', if(x = s.p, s.r, 0D) + {weight}, 't', s.t + pow(if(x = s.p, s.r, 0D) + {weight}, 2D) - pow(if(x = s.p, s.r, 0D), 2D)), s -> s.t)"
    dot = "-round(aggregate(v.w, 0D, (a, x) -> a + coalesce(element_at({m}, x), 0D)) / sqrt(v.n), 9)"
    dots = ", ".join(f"named_struct('weak', {str(licence_of(name) in WEAK).lower()}, 'minus', {dot.format(m=_map(m))}, 'license', '{licence_of(name)}')" for name, m in weights(templates).items())
    vectors = f"transform(transform(array_distinct({units}), l -> {words}), w -> named_struct('w', w, 'n', {square}))"
    return f"array_min(filter(flatten(transform(filter({vectors}, v -> v.n > 0D), v -> array({dots}))), d -> d.minus <= {-threshold!r}D))"


def scan(df: DataFrame, *, path: str = "path", text: str = "text", keys: tuple[str, ...] = (), templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``keys``, path, license, score, origin (own, inherited or none) and license_path for every file."""
    templates = templates or TEMPLATES
    rows = df.select(*(F.col(k) for k in keys), F.col(path).alias("path"), F.col(text).alias("__text"))
    rows = rows.withColumn("__base", F.regexp_extract("path", "[^/]*$", 0)).withColumn("__is_file", F.coalesce(F.col("__base").rlike(FILE), F.lit(False)))
    rows = rows.withColumn("__speaks", F.coalesce(F.col("__text").rlike(f"(?i){LINE}"), F.lit(False)))
    rows = rows.withColumn("__split", F.when(F.col("__speaks"), F.split("__text", "\n")))
    starts = f"filter(sequence(1, size(__split)), i -> lower(element_at(__split, i)) rlike '{LINE}')"
    units = f"flatten(transform({starts}, i -> transform(array({', '.join(map(str, WIDTHS))}), n -> array_join(slice(__split, i, n), ' '))))"
    rows = rows.withColumn("__units", F.when(F.col("__speaks"), F.concat(F.expr(units), F.when(F.col("__is_file"), F.array("__text")).otherwise(F.array().cast("array<string>")))))
    rows = rows.withColumn("__own", F.expr(_best("__units", templates, threshold)))
    directory = F.regexp_replace("path", "/?[^/]*$", "")
    files = scratch.table(rows.select(*keys, "path", directory.alias("__dir"), "__is_file", F.col("__own.license").alias("__license"), F.round(-F.col("__own.minus"), 6).alias("__score")), "license-files")
    held = files.where("__is_file and __license is not null").groupBy("__dir").agg(F.min(F.struct((-F.col("__score")).alias("minus"), F.col("__license").alias("license"), F.col("path").alias("path"))).alias("held"))
    parts = F.when(F.col("__dir") == "", F.array().cast("array<string>")).otherwise(F.split("__dir", "/"))
    above = files.select("__dir").where("__dir is not null").distinct().withColumn("__parts", parts)
    above = above.select("__dir", F.explode(F.expr("transform(sequence(0, size(__parts)), i -> named_struct('depth', i, 'above', array_join(slice(__parts, 1, i), '/')))")).alias("a"))
    nearest = above.select(F.col("__dir").alias("__of"), "a.depth", F.col("a.above").alias("__dir")).join(held, "__dir").groupBy(F.col("__of").alias("__dir")).agg(F.max_by("held", "depth").alias("held"))
    found = files.join(nearest, "__dir", "left")
    own = F.col("__license").isNotNull()
    inherits = ~own & F.col("held").isNotNull()
    return found.select(
        *keys, "path", F.coalesce("__license", "held.license").alias("license"), F.coalesce("__score", -F.col("held.minus")).alias("score"),
        F.when(own, "own").when(inherits, "inherited").otherwise("none").alias("origin"), F.when(own, F.col("path")).otherwise(F.col("held.path")).alias("license_path"),
    )


def oracle(source: str, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for ``scan`` over a query with doc_id, path and text."""
    templates = templates or TEMPLATES
    known, other = idf(templates)
    values = lambda rows: ", ".join("(" + ", ".join(repr(x) for x in r) + ")" for r in rows)
    weighted = [(name, w, v) for name, m in weights(templates).items() for w, v in m.items()]
    token = TOKEN.replace("(?:", "(")
    return f"""
        with files as (select doc_id, path, text, case when path like '%/%' then regexp_replace(path, '/[^/]*$', '') else '' end as dir,
                   regexp_matches(regexp_extract(path, '[^/]*$'), '^(?i:licen[sc]e|copying|notice)([.-].*)?$') as is_file from ({source})),
             lined as (select doc_id, string_split(text, chr(10)) as parts from files where regexp_matches(lower(text), '{LINE}')),
             starts as (select doc_id, parts, unnest(list_filter(range(1, len(parts) + 1), lambda i: regexp_matches(lower(parts[i]), '{LINE}'))) as i from lined),
             units as (select doc_id, array_to_string(parts[i:i + n - 1], ' ') as line from starts cross join (values {", ".join(f"({n})" for n in WIDTHS)}) as w(n)
                   union all select doc_id, text from files where is_file and regexp_matches(lower(text), '{LINE}')),
             numbered as (select doc_id, row_number() over () as unit, line from units),
             words as (select doc_id, unit, unnest(regexp_extract_all(lower(line), '{token}')) as w from numbered),
             counts as (select doc_id, unit, w, count(*) as tf from words group by all),
             idf(w, idf) as (values {values(known.items())}), weight(template, w, v) as (values {values(weighted)}),
             norms as (select doc_id, unit, sqrt(sum(power(tf * coalesce(idf, {other!r}), 2))) as n from counts left join idf using (w) group by all),
             dots as (select doc_id, unit, template, sum(tf * v) as dot from counts join weight using (w) group by all),
             scored as (select doc_id, round(dot / n, 9) as score, string_split(template, ' ')[1] as license from dots join norms using (doc_id, unit)),
             best as (select *, row_number() over (partition by doc_id order by license in ({", ".join(f"'{x}'" for x in sorted(WEAK))}), score desc, license) as k from scored where score >= {threshold!r}),
             own as (select doc_id, license, round(score, 6) as score from best where k = 1),
             tagged as (select f.doc_id, path, dir, is_file, license, score from files f left join own using (doc_id)),
             held as (select dir, license, score, path from (select *, row_number() over (partition by dir order by score desc, license, path) as k from tagged where is_file and license is not null) where k = 1),
             near as (select t.doc_id, h.license, h.score, h.path, row_number() over (partition by t.doc_id order by length(h.dir) desc) as k
                   from tagged t join held h on t.license is null and (t.dir = h.dir or h.dir = '' or starts_with(t.dir, h.dir || '/')))
        select t.doc_id, t.path, coalesce(t.license, n.license) as license, coalesce(t.score, n.score) as score,
               case when t.license is not null then 'own' when n.license is not null then 'inherited' else 'none' end as origin,
               case when t.license is not null then t.path else n.path end as license_path
        from tagged t left join near n on t.doc_id = n.doc_id and n.k = 1"""
