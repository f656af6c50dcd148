"""The built-in catalog finds wordings that are not in the given tables."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

import loomstone.llm.license_scan as L

ISC = (
    "/* Permission to use, copy, modify, and/or distribute this software for any\n * purpose with or without fee is hereby granted, "
    "provided that the above\n * copyright notice and this permission notice appear in all copies.\n *\n * THE SOFTWARE IS PROVIDED "
    '"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH\n * REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY\n * AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,\n * INDIRECT, OR CONSEQUENTIAL "
    "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS\n * OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE "
    "OR OTHER\n * TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF\n * THIS SOFTWARE. */ int main;"
)
MPL = "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy of the MPL was not distributed with this\n// file, You can obtain one at https://mozilla.org/MPL/2.0/."
BY_SA = "Text: this work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License (see below)."
AGPL = "foo is free software. This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."


def test_other_licenses_are_found():
    known = L.Templates(L.TEMPLATES)
    found = {}
    for t, owner, _, _ in L.find_templates(pa.array([ISC, MPL, BY_SA, AGPL, L.TEMPLATES["GPL-2.0-text"]]), known):
        found.setdefault(t, set()).add(known.names[owner])
    assert all(name in found.get(t, ()) for t, name in enumerate(("ISC", "MPL-2.0-notice", "CC-BY-SA-4.0-notice", "AGPL-3.0-notice", "GPL-2.0-text")))


def plain_licenses(text, templates):
    """(name, containment) by the words alone: windows of two classes, one every class, with half a class on either side."""
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    shingles = lambda w: [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    own, out = shingles(words(text)), []
    for name, template in templates.items():
        wanted = shingles(words(template))
        c = 1
        while c < len(wanted):
            c *= 2
        best = 0.0
        for k in range(0, len(own), c):
            inside = set(own[max(0, k - c // 2) : k + 2 * c + c // 2])
            best = max(best, len(inside & set(wanted)) / len(set(wanted)))
        if best >= 0.8:
            out.append((name, best))
    return out


@pytest.mark.parametrize("most", [7, 10_000])
def test_findings_are_those_of_a_plain_search(spark, monkeypatch, most):
    monkeypatch.setattr(L, "MOST_TEMPLATES", most)
    rng = random.Random(9)
    noise = lambda n: " ".join("".join(rng.choices("abcdefghé", k=5)) for _ in range(n))
    texts = ["", None, "four words are short", noise(3000)]
    templates = {n: t for n, t in L.TEMPLATES.items() if len(t) < 4000}
    for t in templates.values():
        w = t.split()
        cut = len(w) * rng.choice([7, 8, 9, 10]) // 10
        texts += [f"{noise(rng.randrange(0, 90))} {t.upper()}\n{noise(40)}", " ".join(w[:cut]), noise(200) + " " + " ".join(w) + " " + noise(700)]
    texts.append(noise(60_000) + " " + L.TEMPLATES["GPL-3.0-notice"])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {r.doc_id: [(x.name, x.containment) for x in r.licenses] for r in L.scan_licenses(docs, templates).collect()}
    assert found == {k: plain_licenses(t, templates) for k, t in enumerate(texts)}


def test_equal_hashes_of_other_words_are_no_finding(monkeypatch):
    template = {"t": " ".join(f"word{k}" for k in range(20))}
    monkeypatch.setattr(L, "combine", lambda h, w: np.arange(max(0, len(h) - w + 1), dtype=np.uint64) + np.uint64(7))
    known = L.Templates(template)
    assert L.find_templates(pa.array([" ".join(f"other{k}" for k in range(20))]), known) == []
    assert [f[2] for f in L.find_templates(pa.array([template["t"]]), known)] == [1.0]
