"""License texts in documents, by MinHash bands over text windows."""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._core import Tokens, mix, shingles, strings, table_of, tidy, tokens_of

# Notices as their authors publish them (public texts).
_MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TWO = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_GNU_PROGRAM = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        _MIT_GRANT,
        _MIT_GRANT + " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        _GNU_PROGRAM.format("General Public License", "3"),
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": (_GNU_PROGRAM.format("Lesser General Public License", "3"),),
    "LGPL-2.1": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",),
    "AGPL-3.0": (_GNU_PROGRAM.format("Affero General Public License", "3"),),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "BSD": (_BSD_HEAD,),
    "BSD-2-Clause": (_BSD_HEAD + " " + _BSD_TWO + ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"',),
    "BSD-3-Clause": (
        _BSD_HEAD + " " + _BSD_TWO + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",),
    "CC0-1.0": ("To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
}

#: Words of a shingle; templates of fewer words are not looked for.
SHINGLE = 2
#: Bands of one row each.  A template fills over half of its windows' length, of
#: which the nearest window misses less than a quarter: it shares at least a
#: quarter of its length, over a fifth of the union.  So a window retrieves an exact template
#: with a probability of at least 1 - 0.8 ** 48 > 0.9999.
BANDS = 48


class Templates:
    """Shingles and bands of all templates, by the length of the windows that hold them."""

    def __init__(self, texts: Mapping[str, tuple[str, ...]], shingle: int = SHINGLE, bands: int = BANDS):
        self.names = [n for n, ts in texts.items() for _ in ts]
        t = Tokens(*strings(pa.array([x for ts in texts.values() for x in ts], pa.large_string())))
        s, _, first = shingles(t.hashes(), t.first, shingle)
        self.shingle = shingle
        self.sets = [np.unique(s[a:b]) for a, b in zip(first[:-1], first[1:])]
        self.salts = mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.by: dict[int, list[int]] = {}
        for i, x in enumerate(self.sets):
            if len(x):
                width = 4
                while width < first[i + 1] - first[i]:
                    width *= 2
                self.by.setdefault(width, []).append(i)
        # per window length: values of the bands, sorted, and the templates that have them
        self.bands = {}
        for width, own in self.by.items():
            v = np.array([[mix(self.sets[i] ^ salt).min() for i in own] for salt in self.salts])
            self.bands[width] = [(np.sort(row), np.array(own)[np.argsort(row, kind="stable")]) for row in v]
        self.any = np.zeros(1 << 20, bool)
        for x in self.sets:
            self.any[(x & np.uint64((1 << 20) - 1)).astype(np.int64)] = True


def find_licenses(docs: DataFrame, templates: Mapping[str, tuple[str, ...]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", containment: float = 0.8) -> DataFrame:
    """``doc_id``, ``license``, ``containment``, ``start``, ``stop`` (words): the matches of each license in each text.

    Windows of each length that the templates need, a power of two, begin every
    quarter of their length over the whole text.  A window is held against the
    templates with which it shares a band; a match contains at least
    ``containment`` of the template's shingles within the window and as many
    words after it.  Matches of a license that overlap are one row, that of the
    one that contains most, then of the first and the shortest; a notice that
    comes again elsewhere in the text has a row of its own.

    Words are lower-cased (A-Z) and end at white space.  Null and empty texts
    match nothing; rows with null or repeated ids are scanned like any other, an
    empty table gives no rows, and further columns, whatever their names, are not
    looked at.  A very long text is scanned whole, by one worker.
    """
    known = Templates(templates)
    sent = docs.sparkSession.sparkContext.broadcast(known)
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("containment", pa.float64()), ("start", pa.int32()), ("stop", pa.int32())])

    def work(batches: Iterator[pa.RecordBatch]):
        k = sent.value
        for batch, t in tokens_of(batches, "text"):
            s, at, first = shingles(t.hashes(), t.first, k.shingle)
            if not len(s):
                continue
            doc = t.doc[at]
            end = first[doc + 1]
            known = k.any[(s & np.uint64((1 << 20) - 1)).astype(np.int64)]
            spots = np.append(0, np.cumsum(known))
            matches: dict[tuple[int, str], list[tuple[float, int, int]]] = {}
            for width, bands in k.bands.items():
                step = max(1, width // 4)
                begin = np.flatnonzero((np.arange(len(s)) - first[doc]) % step == 0)
                # windows without any shingle of a template share no band with one, and those with too few of them hold no match
                fewest = containment * min(len(k.sets[x]) for x in k.by[width]) - 1e-9
                some = (spots[np.minimum(begin + width, end[begin])] > spots[begin]) & (spots[np.minimum(begin + 2 * width, end[begin])] - spots[begin] >= fewest)
                begin = begin[some]
                if not len(begin):
                    continue
                # only the shingles of these windows are hashed for the bands
                stop = np.minimum(begin + width, end[begin])
                size = stop - begin
                flat = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
                cut = np.cumsum(size) - size
                pairs = []
                for salt, (values, own) in zip(k.salts, bands):
                    low = np.minimum.reduceat(mix(s[flat] ^ salt), cut)
                    a, b = np.searchsorted(values, low, "left"), np.searchsorted(values, low, "right")
                    for w in np.flatnonzero(b > a).tolist():
                        pairs += [(w, int(x)) for x in own[a[w] : b[w]]]
                for w, x in sorted(set(pairs)):
                    lo, hi = int(begin[w]), int(min(begin[w] + 2 * width, end[begin[w]]))
                    hit = np.flatnonzero(np.isin(s[lo:hi], k.sets[x]))
                    share = len(np.unique(s[lo:hi][hit])) / len(k.sets[x])
                    if share >= containment - 1e-9:
                        key = (int(doc[lo]), k.names[x])
                        base = int(first[doc[lo]])
                        matches.setdefault(key, []).append((-share, lo + int(hit[0]) - base, lo + int(hit[-1]) - base + k.shingle))
            rows = []
            for (d, name), found in sorted(matches.items()):
                taken: list[tuple[int, int]] = []
                for v, a, b in sorted(set(found), key=lambda x: (x[0], x[1], x[2])):
                    i = bisect.bisect(taken, (a, b))
                    if (not i or taken[i - 1][1] <= a) and (i == len(taken) or b <= taken[i][0]):
                        taken.insert(i, (a, b))
                        rows.append((batch.column("doc_id")[d].as_py(), name, -v, a, b))
            if rows:
                yield table_of(schema, **dict(zip(schema.names, map(list, zip(*rows)))))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(work), "doc_id long, license string, containment double, start int, stop int")
