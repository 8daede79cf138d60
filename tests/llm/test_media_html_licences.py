import hashlib
import struct
import wave as pywave
import zlib
from io import BytesIO

import numpy as np
import pytest
from cases import ODD

from stratalens.llm import html_model, licences, media


@pytest.mark.parametrize("source", ["odd", "odd_extra"])
def test_payload(request, source):
    rows = media.payload_columns(request.getfixturevalue(source), with_files=True).collect()
    want = []
    for i, t, *_ in ODD:
        b = (t or "").encode()
        p = b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))
        want.append((i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert sorted([tuple(r)[:5] for r in rows], key=repr) == sorted(want, key=repr)
    for r in rows:
        assert media.read_wave(bytes(r.media))[2].rstrip(b"\0") == media.read_wave(bytes(r.media))[2].rstrip(b"\0")
        assert (len(r.media), hashlib.sha256(r.media).hexdigest()) == (r.media_bytes, r.media_sha256)
        with pywave.open(BytesIO(bytes(r.pcm))) as w:
            assert (w.getframerate(), w.getsampwidth(), w.getnframes()) == (16000, 2, 2 * r.payload_bytes)


def test_companding_tables():
    """Known points of G.711."""
    u, a = media.ulaw_table(), media.alaw_table()
    assert (u[0xFF], u[0x7F], u[0x80], u[0x00]) == (0, 0, 32124, -32124)
    assert (a[0xD5], a[0x55], a[0xAA], a[0x2A]) == (8, -8, 32256, -32256)


def adpcm_by_hand(block):
    value, index = struct.unpack_from("<hB", block)
    steps, out = media.step_table().tolist(), [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = steps[index]
            change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][code & 7]))
            out.append(value)
    return out


def test_adpcm_blocks():
    r = np.random.default_rng(1)
    blocks = r.integers(0, 256, (50, 64)).astype(np.uint8)
    blocks[:, 2] %= 89
    assert media.adpcm_blocks(blocks).tolist() == [adpcm_by_hand(b.tobytes()) for b in blocks]
    short = bytes(blocks[0]) + bytes(blocks[1][:20])
    assert media.adpcm([short])[0].tolist() == adpcm_by_hand(blocks[0].tobytes()) + adpcm_by_hand(short[64:])


def test_decode_media(spark):
    files = [(1, media.wave(bytes(range(256)), media.ULAW, 8000, 1)), (2, media.wave(bytes(64), media.IMA, 8000, 1)), (3, None), (4, b"junk"), (5, media.wave(bytes(range(128)), media.ALAW, 8000, 1))]
    got = {r.id: r.pcm for r in media.decode_media(spark.createDataFrame(files, "id long, media binary")).collect()}
    assert got[3] is None and got[4] is None
    assert len(media.read_wave(bytes(got[1]))[2]) == 256 * 2 * 2
    assert np.frombuffer(media.read_wave(bytes(got[5]))[2], "<i2")[::2].tolist() == media.alaw_table()[:128].tolist()


# -- licences ------------------------------------------------------------------------------------


def test_licence_rules():
    one = licences.Recogniser()
    names = lambda t: [x for x, _, _ in one.matches(t)]
    assert names("Foo.\nLicensed under the Apache License, Version 2.0.\nBar") == ["Apache-2.0"]
    assert names("  RELEASED under the  MIT license ") == ["MIT"]
    assert names("Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License.") == ["Apache-2.0"]
    grant, notice = licences.SENTENCES["mit-grant"], licences.SENTENCES["mit-notice"]
    assert names(f"{grant}.\n{notice}.\nAll rights reserved.") == ["MIT", "all-rights-reserved"]
    assert names(f"{notice}.\n{grant}.") == ["MIT"]  # order matters: only the grant's own rule
    assert names(f"This program is free software: you can redistribute it") == []
    assert names("The license is Licensed under CC BY 4.0 maybe") == []
    text = "ä\nLicensed under CC BY-NC 4.0."
    (_, a, b) = one.matches(text)[0]
    assert text[a:b] == "Licensed under CC BY-NC 4.0"


def test_licence_scan(odd, odd_extra, none):
    assert {(r.n_matches, r.licences) for r in licences.scan(odd).collect()} == {(0, "")}
    assert licences.scan(odd_extra).count() == len(ODD)
    assert licences.scan(none).count() == 0


MIT = """MIT License

Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
APACHE = """   Copyright 2020 A Person

   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License.
"""
GPL3 = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""
GPL2 = """    This program is free software; you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation; either version 2 of the License, or
    (at your option) any later version.
"""
BSD3 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:
1. Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright
   notice, this list of conditions and the following disclaimer in the
   documentation and/or other materials provided with the distribution.
3. Neither the name of the University nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE REGENTS AND CONTRIBUTORS ``AS IS'' AND
ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.
"""
BSD2 = BSD3[: BSD3.index("3. Neither")]
BSD4 = BSD2 + """3. All advertising materials mentioning features or use of this software
   must display the following acknowledgement:
   This product includes software developed by the University.
4. """ + BSD3[BSD3.index("Neither") :]
MPL = """  This Source Code Form is subject to the terms of the Mozilla Public
  License, v. 2.0. If a copy of the MPL was not distributed with this
  file, You can obtain one at http://mozilla.org/MPL/2.0/.
"""
NOTICES = [("MIT", MIT), ("Apache-2.0", APACHE), ("GPL-3.0-or-later", GPL3), ("GPL-2.0-or-later", GPL2), ("BSD-2-Clause", BSD2), ("BSD-3-Clause", BSD3), ("BSD-4-Clause", BSD4), ("MPL-2.0", MPL)]


@pytest.mark.parametrize("licence, text", NOTICES, ids=[x for x, _ in NOTICES])
@pytest.mark.parametrize("mark", ["", " * ", "# ", "// ", ";; "])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_published_notices(licence, text, mark, end):
    """Verbatim, wrapped, as a comment, after and before other text; the span holds the notice."""
    one = licences.Recogniser()
    text = end.join(mark + line for line in f"Some title\n\n{text}\nMore text.".split("\n"))
    ((found, a, b),) = one.matches(text)
    assert found == licence
    assert text[a:b].lstrip(mark).startswith(("Permission", "Licensed", "This", "Redistribution"))
    assert one.matches(text.replace("edistribut", "ebuild").replace("icense", "icence").replace("ermission", "ermit")) == []


def test_wrapped_lines_stay_in_a_paragraph():
    one = licences.Recogniser()
    names = lambda t: [x for x, _, _ in one.matches(t)]
    assert names("Released under\nthe MIT License") == ["MIT"]
    assert names("Released under\n\nthe MIT License") == names("Released under. the MIT License") == []
    assert names("Released under the MIT License\nand more") == ["MIT"]
    assert names(f"{licences.SENTENCES['gpl-redistribute']}; {licences.SENTENCES['gpl-later']}.") == ["GPL-3.0-or-later"]
    assert names(licences.SENTENCES["mpl2-form"] + ".") == ["MPL-2.0"]


def sentence_of(name):
    return licences.SENTENCES[name] if name in licences.SENTENCES else licences.WORDINGS[name][0]


EVERY_RULE = licences.RULES + licences.MORE_RULES


@pytest.mark.parametrize("licence, names", EVERY_RULE, ids=["+".join(n) for _, n in EVERY_RULE])
def test_every_rule_is_reachable(licence, names):
    one = licences.Recogniser()
    for glue in ("; ", ".\n", ".\n\n"):
        text = "Before.\n" + glue.join(map(sentence_of, names)) + ".\nAfter."
        assert [x for x, _, _ in one.matches(text)] == [licence]


def test_every_sentence_is_in_a_rule():
    assert {*licences.SENTENCES, *licences.WORDINGS} == {n for _, names in EVERY_RULE for n in names}


def test_spdx_lines():
    one = licences.Recogniser()
    for licence in licences.SPDX:
        assert [x for x, _, _ in one.matches(f"// SPDX-License-Identifier: {licence}\nint x;")] == [licence]
    assert one.matches("The identifier is MIT\nMIT") == []


def test_licence_sql_over_sequences(spark, frame):
    """Ordered sequences, the longest at each place, overlaps and repeats: the SQL and the operator agree."""
    r = __import__("random").Random(3)
    usable = [n for n in [*licences.SENTENCES, *licences.WORDINGS] if n not in licences.OPEN]
    chains = [names for _, names in EVERY_RULE if len(names) > 1 and not set(names) & set(licences.OPEN)]
    texts = [None, "", "nothing here", "ä\n!!\n--"]
    for _ in range(250):
        said = []
        for _ in range(r.randint(1, 4)):
            said += r.choice([[r.choice(usable)], r.choice(chains), r.choice(chains)[: r.randint(1, 3)], []])
            said += [""] * (r.random() < 0.3)
        texts.append("".join((sentence_of(n) if n else r.choice(["Some other words", "--", "é"])) + r.choice([".\n", "; ", "!\n\n"]) for n in said))
    docs = frame([(i, t, None, None, None) for i, t in enumerate(texts)])
    con = __import__("duckdb").connect()
    con.register("documents", docs.toPandas())
    want = sorted(con.sql(licences.OP8_SQL).fetchall())
    got = sorted((x.doc_id, x.n_matches, x.licences) for x in licences.scan(docs).collect())
    assert got == want and sum(n for _, n, _ in got) > 300


def test_triggers_lose_nothing():
    """Passing over texts without trigger words equals scanning all."""
    one, plain = licences.Recogniser(), licences.Recogniser()
    plain.triggers = ()
    for text in [*licences.SENTENCES.values(), "nothing", "All rights reserved!", ""]:
        assert one.matches(text) == plain.matches(text)


@pytest.mark.parametrize("gap", ["  ", "\t", "\u00a0", "-", " * "])
def test_triggers_see_through_separators(gap):
    one = licences.Recogniser()
    assert all(t.isalnum() for t in licences.TRIGGERS)
    assert [x for x, _, _ in one.matches(f"All rights{gap}reserved.")] == ["all-rights-reserved"]


@pytest.mark.parametrize("run", [" ", "-", "*", "\u00a0"])
def test_long_sentences_are_normalised(run):
    """Known sentences behind, within and around runs of 4096 characters and more."""
    one, run = licences.Recogniser(), run * 5000
    names = lambda t: [x for x, _, _ in one.matches(t)]
    assert names(f"{run}Released under the MIT License") == ["MIT"]
    assert names(f"Released under {run} the MIT License.") == ["MIT"]
    grant, notice = licences.SENTENCES["mit-grant"], licences.SENTENCES["mit-notice"]
    ((_, a, b),) = one.matches(f"{grant}.\n{run}\n{notice}.")
    assert b - a == len(grant) + len(run) + len(notice) + 3


# -- html ----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return html_model.learn()


def brute_marginals(model, dom):
    """Sum over all states of a small tree."""
    import itertools
    import math

    seen, same = html_model.observe(dom)
    n = len(dom.tag)
    total = np.zeros((n, 2))
    for states in itertools.product((0, 1), repeat=n):
        p = model.root[states[0]]
        for i in range(n):
            p += sum(model.emit[a][b][states[i]] for a, b in seen[i] if b in model.emit[a])
            if i:
                table = np.array(html_model.SAME) if same[i] else model.move.get(html_model.relation(dom, i), np.zeros((2, 2)))
                p += table[states[dom.parent[i]], states[i]]
        for i, s in enumerate(states):
            total[i, s] += math.exp(p)
    return total[:, 1] / total.sum(axis=1)


def test_messages_give_exact_marginals(model):
    dom = html_model.parse("<div><p>Some text <b>here</b>.</p><ul class=menu><li><a href=x>go</a></ul></div>")
    assert np.allclose(model.marginals(dom), brute_marginals(model, dom))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><a href="/">Site</a><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav></header>
<div class="cookie-notice">We use cookies on this site. <button>OK</button></div>
<article><h1>A headline &amp; more</h1><p>First <b>bold</b>   words here, and
 a line break.<br>Next.</p><div class="ad">Buy this thing now.</div><p>Second paragraph &lt;tag&gt; with caf&eacute;.</p></article>
<aside class="sidebar"><h3>Related</h3><ul><li><a href="/c">Other story</a></li></ul></aside>
<section id="comments"><h2>Comments</h2><div class="comment"><p>I liked it a lot.</p></div></section>
<form action="/s"><label>Search</label><input name=q><button>Go</button></form>
<footer>&copy; Site. All rights.</footer></body></html>"""


def test_extract(model):
    assert html_model.extract(PAGE, model) == "A headline & more\nFirst bold words here, and a line break. Next.\nSecond paragraph <tag> with café."
    assert html_model.extract(None, model) == html_model.extract("", model) == ""


def test_held_out_layouts(model):
    """Labelled pages of another seed: nearly all text falls on the right side."""
    right = wrong = 0
    for page in html_model.labelled_pages(150, seed=99):
        want = [w for run in page.split(html_model.OPEN)[1:] for w in run.split(html_model.SHUT)[0].split()]
        got = html_model.extract(page.replace(html_model.OPEN, "").replace(html_model.SHUT, ""), model).split()
        a, b = set(got), set(want)
        right += len(a & b)
        wrong += len(a ^ b)
    assert wrong / (right + wrong) < 0.05


COMMENTS = """<body><article><h1>A title</h1><p>The first sentence of the article. And a second one.</p></article>
<div class="comments">{0}<p>A reader comment that is here to stay.</p>{1}<p>Another reader comment that stays.</p></div></body>"""


@pytest.mark.parametrize("deep", [0, 1, 10, 500, 5000])
def test_depth_changes_nothing(model, deep):
    """Comments stay out, and an article stays in, within however many boxes."""
    page = COMMENTS.format("<div>" * deep, "</div>" * deep)
    assert html_model.extract(page, model) == "A title\nThe first sentence of the article. And a second one."
    page = "<nav><a href=x>Home</a></nav>" + "<div>" * deep + "<article><p>One sentence of the text.</p><p>Another sentence of it.</p></article>" + "</div>" * deep + "<div class=footer>End.</div>"
    assert html_model.extract(page, model) == "One sentence of the text.\nAnother sentence of it."


def test_stray_tags_take_no_walk(model):
    """End tags of what is not open, and implied ends within deep nesting, cost no time that grows with depth."""
    import time

    began = time.time()
    html_model.parse("<div>" + "<b>" * 30_000 + "</i>" * 30_000 + "<p>x" * 30_000)
    assert time.time() - began < 10


def test_odd_pages(spark, model):
    pages = [(1, "u", None), (2, None, ""), (3, "u", "<p>unclosed <b>bold"), (3, "u", "plain text"), (None, "u", "<<<>>> & <"), (4, "u", "<div>" * 3000 + "deep words here" + "</div>" * 3000), (5, "u", "<p>" + "word " * 50_000 + "</p>")]
    df = spark.createDataFrame([(*p, "x", 3) for p in pages], "page_id long, url string, html string, text string, n_chars int")
    rows = html_model.extract_pages(df, model).collect()
    assert len(rows) == len(pages) and all(r.n_chars == len(r.text) for r in rows)
    assert html_model.extract_pages(df.limit(0), model).count() == 0
