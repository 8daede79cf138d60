"""Licence recognition by sentence rules.

A text is cut into sentences; a sentence is normalised (lower case, letters and digits only, one
space between words) and mapped to the identifier of a known licence sentence.  Runs of
identifiers of adjacent sentences are then matched against ordered rules: a rule is a sequence
of identifiers that stands for a licence.  At each place the longest matching rule wins (the
earlier rule on ties), matches do not overlap, and a later rule cannot take an identifier that
an earlier match used.

Sentences end at a line break or at ``.``, ``!``, ``?``, ``;`` or ``:`` followed by white space.
A known sentence may also be wrapped: lines of one paragraph are joined as long as they go on
with it.  Known texts are cut in the same way, so one with an end inside (``software: you``,
``v. 2.0``) stands for several sentences in a row.  Lines without letters or digits and the marks
of list items (``1.``) are no sentences and may stand between those of a rule.

Known sentences are looked for in whole texts; a text without any of the trigger words that
every known sentence has one of is passed over unsplit, which changes nothing.

Defined cases: null text is empty text and matches nothing; null or repeated doc_id rows are
scanned each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.llm.common import arrow_batch, parts, table

#: Known licence sentences by identifier (fixed values: phrases of public licence notices).
SENTENCES = {
    "mit-released": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND',
    "apache2-licensed": "Licensed under the Apache License, Version 2.0",
    "apache2-comply": "you may not use this file except in compliance with the License",
    "apache2-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3",
    "gpl3-licensed": "Licensed under the GNU General Public License, version 3",
    "gpl2-licensed": "Licensed under the GNU General Public License, version 2",
    "gpl-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl-later": "either version 3 of the License, or (at your option) any later version",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice",
    "mpl2-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0",
    "cc-by-4": "Licensed under CC BY 4.0",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0",
    "cc0": "Licensed under CC0 1.0",
    "all-rights": "All rights reserved",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "isc-as-is": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS',
    "unlicense-free": "This is free and unencumbered software released into the public domain",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-event": "In no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "boost-distributed": "Distributed under the Boost Software License, Version 1.0",
    "boost-see": "(See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    "lgpl21-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "lgpl3-notice": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl3-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "epl2-terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "cc-by-4-work": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-4-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nd-4-work": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    "cc-by-nc-4-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc-by-nc-sa-4-work": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "cc-by-nc-nd-4-work": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License",
    "mit-project": "This project is licensed under the MIT License",
    "apache2-project": "This project is licensed under the Apache License 2.0",
    "isc-licensed": "Licensed under the ISC License",
    "bsd2-licensed": "Licensed under the BSD 2-Clause License",
    "bsd3-licensed": "Licensed under the BSD 3-Clause License",
    "lgpl21-licensed": "Licensed under the GNU Lesser General Public License, version 2.1",
    "agpl3-licensed": "Licensed under the GNU Affero General Public License, version 3",
    "mpl2-licensed": "Licensed under the Mozilla Public License, version 2.0",
    "epl2-licensed": "Licensed under the Eclipse Public License, version 2.0",
    "spdx": "SPDX-License-Identifier",
}
#: Licence identifiers that may follow "SPDX-License-Identifier:" (fixed values).
SPDX = "0BSD AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC0-1.0 EPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MPL-2.0 Unlicense Zlib".split()
SENTENCES |= {f"spdx-{x.lower()}": x for x in SPDX}
#: Further wordings of known sentences, and further sentences, as the licences publish them.
WORDINGS = {
    "mit-grant": ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',),
    "mit-notice": ("The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software",),
    "as-is": ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',),
    "apache2-licensed": ('Licensed under the Apache License, Version 2.0 (the "License")',),
    "apache2-copy": (
        "You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0",
        "You may obtain a copy of the License at\n\nhttps://www.apache.org/licenses/LICENSE-2.0",
        "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0",
    ),
    "apache2-warranty": ('Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',),
    "apache2-see": ("See the License for the specific language governing permissions and limitations under the License",),
    "gpl3-notice": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",),
    "gpl2-notice": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",),
    "bsd-source": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",),
    "bsd-binary": ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",),
    "bsd-advertising": ("All advertising materials mentioning features or use of this software must display the following acknowledgement",),
    "bsd-product": ("This product includes software developed by",),
    "bsd-endorse": ("Neither the name of", "The name of the author may not be used to endorse or promote products"),
    "mpl2-copy": (
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    ),
}
#: These go on with a name that differs from notice to notice: their beginning is enough.
OPEN = ("bsd-product", "bsd-endorse")
#: Ordered rules: licence, sequence of sentence identifiers.
RULES = [
    ("MIT", ("mit-grant", "mit-notice", "as-is")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-grant",)),
    ("MIT", ("mit-released",)),
    ("MIT", ("mit-licensed",)),
    ("Apache-2.0", ("apache2-licensed", "apache2-comply", "apache2-copy")),
    ("Apache-2.0", ("apache2-licensed", "apache2-comply")),
    ("Apache-2.0", ("apache2-licensed",)),
    ("GPL-3.0-or-later", ("gpl-redistribute", "gpl-later")),
    ("GPL-3.0", ("gpl3-work",)),
    ("GPL-3.0", ("gpl3-licensed",)),
    ("GPL-2.0", ("gpl2-licensed",)),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source")),
    ("MPL-2.0", ("mpl2-form",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC0-1.0", ("cc0",)),
    ("all-rights-reserved", ("all-rights",)),
]
#: Rules over WORDINGS, after RULES in order.
MORE_RULES = [
    ("Apache-2.0", ("apache2-licensed", "apache2-comply", "apache2-copy", "apache2-warranty", "apache2-see")),
    ("GPL-3.0-or-later", ("gpl3-notice",)),
    ("GPL-2.0-or-later", ("gpl2-notice",)),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-4-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-product", "bsd-endorse")),
    ("MPL-2.0", ("mpl2-form", "mpl2-copy")),
    ("ISC", ("isc-grant", "isc-as-is")),
    ("ISC", ("isc-grant",)),
    ("0BSD", ("0bsd-grant", "isc-as-is")),
    ("0BSD", ("0bsd-grant",)),
    ("Unlicense", ("unlicense-free", "unlicense-anyone")),
    ("Unlicense", ("unlicense-free",)),
    ("Zlib", ("zlib-as-is", "zlib-event", "zlib-grant")),
    ("Zlib", ("zlib-grant",)),
    ("BSL-1.0", ("boost-distributed", "boost-see")),
    ("BSL-1.0", ("boost-distributed",)),
    ("LGPL-2.1-or-later", ("lgpl21-notice",)),
    ("LGPL-3.0-or-later", ("lgpl3-notice",)),
    ("AGPL-3.0-or-later", ("agpl3-notice",)),
    ("GPL-3.0-or-later", ("gpl3-notice", "gpl-hope")),
    ("GPL-2.0-or-later", ("gpl2-notice", "gpl-hope")),
    ("AGPL-3.0-or-later", ("agpl3-notice", "gpl-hope")),
    ("EPL-2.0", ("epl2-terms",)),
    ("CC-BY-4.0", ("cc-by-4-work",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4-work",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-4-work",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4-work",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-4-work",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd-4-work",)),
    ("MIT", ("mit-project",)),
    ("Apache-2.0", ("apache2-project",)),
    ("ISC", ("isc-licensed",)),
    ("BSD-2-Clause", ("bsd2-licensed",)),
    ("BSD-3-Clause", ("bsd3-licensed",)),
    ("LGPL-2.1", ("lgpl21-licensed",)),
    ("AGPL-3.0", ("agpl3-licensed",)),
    ("MPL-2.0", ("mpl2-licensed",)),
    ("EPL-2.0", ("epl2-licensed",)),
]
MORE_RULES += [(x, ("spdx", f"spdx-{x.lower()}")) for x in SPDX]
#: Single words: as they hold no separator, normalising cannot make one that the raw text lacks.
TRIGGERS = ("licen", "permission", "notice", "warrant", "redistribut", "version", "reserved", "unencumbered")
_END = re.compile(r"[\n\r]+|[.!?;:]+(?=\s)|[.!?;:]+\Z")
_LINE = re.compile(r"\r\n|\n|\r")
_MARK = re.compile(r"[0-9]{1,2}|[a-z]")
_OTHER = re.compile(r"[^0-9a-z]+")


def normalise(sentence: str) -> str:
    return _OTHER.sub(" ", sentence.lower()).strip()


def pieces(text: str) -> list[list]:
    """[number, start, end, normalised text, whether the next piece is the next line of the same paragraph]."""
    out, start, ended, lines = [], 0, True, 1
    for m in [*_END.finditer(text), None]:
        end = m.start() if m else len(text)
        raw = text[start:end]
        norm = normalise(raw)
        if norm or any(c.isalnum() for c in raw):
            sign = m is None or m.group()[0] not in "\n\r"
            if m and sign and lines and _MARK.fullmatch(norm):
                ended = True
            else:
                if out:
                    out[-1][4] = bool(not ended and lines == 1 and norm and out[-1][3])
                out.append([len(out), start + len(raw) - len(raw.lstrip()), end, norm, False])
                ended = sign
            lines = 0
        if m:
            lines += len(_LINE.findall(m.group()))
            start = m.end()
    return out


def known_parts(text: str) -> tuple[str, ...]:
    """Normalised sentences of a known text."""
    out, goes_on = [], False
    for *_, norm, more in pieces(text):
        if goes_on:
            out[-1] += f" {norm}"
        else:
            out.append(norm)
        goes_on = more
    return tuple(out)


class Recogniser:
    def __init__(self, sentences: dict[str, str] = SENTENCES, rules=None, wordings: dict[str, tuple[str, ...]] | None = None):
        if rules is None:
            rules = RULES + MORE_RULES if sentences is SENTENCES else RULES
        if wordings is None:
            wordings = WORDINGS if sentences is SENTENCES else {}
        forms: dict[str, list[tuple[str, ...]]] = {}
        for name in {**sentences, **wordings}:
            texts = [sentences[name]] if name in sentences else []
            forms[name] = [known_parts(x) for x in (*texts, *wordings.get(name, ()))]
        self.open = tuple(x[0] for name in OPEN if name in wordings for x in forms[name])
        self.known = {part for found in forms.values() for form in found for part in form}
        self.beginnings = {" ".join(words[:n]) for words in map(str.split, self.known) for n in range(1, len(words) + 1)}
        self.by_first: dict[str, list[tuple[str, tuple[str, ...]]]] = {}
        for licence, names in rules:
            for chosen in itertools.product(*(forms[x] for x in names)):
                sequence = tuple(part for form in chosen for part in form)
                self.by_first.setdefault(sequence[0], []).append((licence, sequence))
        every = [r for found in self.by_first.values() for r in found]
        self.triggers = TRIGGERS if all(any(t in part for t in TRIGGERS for part in sequence) for _, sequence in every) else ()
        for found in self.by_first.values():
            found.sort(key=lambda r: -len(r[1]))  # stable: the earlier rule first among equals

    def sentences(self, text: str) -> list[tuple[int, int, int, int, str]]:
        """(first number, last number, start, end, known sentence) of known sentences, the longest at each place."""
        out, found, i = [], pieces(text), 0
        while i < len(found):
            joined, j, best = found[i][3], i, None
            while True:
                if joined in self.known:
                    best = (j, joined)
                if joined.startswith(self.open):
                    while found[j][4]:
                        j += 1
                    best = (j, next(h for h in self.open if joined.startswith(h)))
                    break
                if joined not in self.beginnings or not found[j][4]:
                    break
                j += 1
                joined = f"{joined} {found[j][3]}"
            if best:
                out.append((found[i][0], found[best[0]][0], found[i][1], found[best[0]][2], best[1]))
            i = best[0] + 1 if best else i + 1
        return out

    def matches(self, text: str) -> list[tuple[str, int, int]]:
        """(licence, start, end) in text order."""
        low = text.lower()
        if self.triggers and not any(t in low for t in self.triggers):
            return []
        found, out, i = self.sentences(text), [], 0
        while i < len(found):
            for licence, sequence in self.by_first.get(found[i][4], ()):
                run = found[i : i + len(sequence)]
                if tuple(x[4] for x in run) == sequence and all(b[0] == a[1] + 1 for a, b in itertools.pairwise(run)):
                    out.append((licence, run[0][2], run[-1][3]))
                    i += len(sequence)
                    break
            else:
                i += 1
        return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", recogniser: Recogniser | None = None) -> DataFrame:
    """(doc_id, n_matches, licences, spans): sorted distinct licences joined by commas; spans as code points."""
    id_type = docs.schema[id_col].dataType.simpleString()
    one = recogniser or Recogniser()
    span = pa.list_(pa.struct([("licence", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches):
        for batch, texts in parts(batches, "text"):
            found = [one.matches(t) for t in texts]
            out = pa.schema([batch.schema.field(0), ("n_matches", pa.int64()), ("licences", pa.string()), ("spans", span)])
            spans = pa.array([[{"licence": x, "start": a, "stop": b} for x, a, b in m] for m in found], span)
            yield arrow_batch(out, [batch.column(0), [len(m) for m in found], [",".join(sorted({x for x, _, _ in m})) for m in found], spans])

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, f"doc_id {id_type}, n_matches long, licences string, spans array<struct<licence:string,start:int,stop:int>>")


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).select("doc_id", "n_matches", "licences")


def _sql() -> str:
    """The ordered rules in SQL, for texts in which no known sentence is wrapped over lines or numbered as a list item (none is in the given tables).

    Sentences of a text are numbered; a rule hits where all its steps stand in a row; the longest hit
    at each place counts, and from the first on each next one starts after the one before.
    """
    one = Recogniser()
    # by_first holds, for each first sentence, its rules from the strongest on.
    hits = [(licence, sequence) for found in one.by_first.values() for licence, sequence in found if not set(sequence) & set(one.open)]
    rows = ", ".join(f"({rule}, '{licence}', {len(sequence)}, {step}, '{part}')" for rule, (licence, sequence) in enumerate(hits) for step, part in enumerate(sequence))
    return rf"""
WITH RECURSIVE rules(rule, licence, size, step, sentence) AS (VALUES {rows}),
cut AS (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '[\n\r]+|[.!?;:]+(\s|$)') AS pieces FROM documents),
raw AS (SELECT doc_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i FROM cut),
norm AS (SELECT doc_id, i, piece, trim(regexp_replace(lower(piece), '[^0-9a-z]+', ' ', 'g')) AS sentence FROM raw),
said AS (SELECT doc_id, sentence, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM norm WHERE sentence <> '' OR regexp_matches(piece, '[^\x00-\x7f]')),
hits AS (SELECT doc_id, k - step AS start, rule, licence, size FROM said JOIN rules USING (sentence) GROUP BY ALL HAVING count(*) = size),
best AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id, start ORDER BY rule) = 1),
after AS (SELECT a.doc_id, a.start, min(b.start) AS next FROM best a JOIN best b ON a.doc_id = b.doc_id AND b.start >= a.start + a.size GROUP BY ALL),
taken(doc_id, start) AS (SELECT doc_id, min(start) FROM best GROUP BY doc_id UNION ALL SELECT t.doc_id, a.next FROM taken t JOIN after a ON a.doc_id = t.doc_id AND a.start = t.start),
m AS (SELECT doc_id, licence FROM taken JOIN best USING (doc_id, start))
SELECT d.doc_id, count(m.licence) AS n_matches, coalesce(string_agg(DISTINCT m.licence, ',' ORDER BY m.licence), '') AS licences
FROM documents d LEFT JOIN m ON d.doc_id = m.doc_id GROUP BY d.doc_id
"""


OP8_SQL = _sql()
