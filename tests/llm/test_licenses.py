import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from shadowset.llm import licence_texts, licenses


def split_words(text):
    """Runs of letters, digits, dots and pluses that begin and end with a letter or digit, in lower case."""
    out, now = [], ""
    for c in text + " ":
        if c.isascii() and c.isalnum() or now and c in ".+":
            now += c
            continue
        while now and now[-1] in ".+":
            now = now[:-1]
        if now:
            out.append(now.lower())
        now = ""
    return out


def features(text):
    w = split_words(text)
    return set(w) | {w[i] + " " + w[i + 1] for i in range(len(w) - 1)}


def chances(text):
    """Probabilities by class: the sum of the learned weights of all n-grams, through softmax."""
    weights, bias = licenses.model()
    z = np.array(bias) + sum((np.array(weights[g]) for g in features(text) if g in weights), np.zeros(len(bias)))
    e = np.exp(z - z.max())
    return dict(zip(licenses.CLASSES, e / e.sum(), strict=True))


def plain(text, least=0.5, alike=0.6):
    """All findings of a family, over every sentence of every line, with nothing left out beforehand."""
    out, joined = [], []
    for line in (text or "").replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        bare = re.sub(r"^[ \t]*([#*/;%>-]+[ \t]+)?", "", line)
        if joined and joined[-1][1] and bare and not bare[0].isspace():
            joined[-1] = (joined[-1][0] + " " + bare, len(bare) >= 40 and bare[-1] not in ".!?:;")
        else:
            joined.append((line, len(line) >= 40 and line[-1] not in ".!?:;"))
    for line, _ in joined:
        for sentence in re.split(r"(?<=[.!?])\s+", line):
            p = chances(sentence)
            family = max(sorted(p), key=p.get)
            if family == "unknown":
                continue
            own = features(sentence)
            texts = [*licence_texts.PARAGRAPHS[family], *(f.replace("{}", n) for n in licence_texts.NAMES.get(family, ()) for f in licence_texts.FRAMES)]
            texts = [t for t in texts if t not in licence_texts.NAMES.get(family, ())]
            denied = {g for g in own if re.search(licenses.DENIED, g)}
            alikes = [len(own & features(t)) / max(5, min(len(own), len(features(t)))) if denied <= features(t) else 0 for t in texts]
            out.append((family, round(p[family], 6), bool(p[family] >= least and max(alikes) >= alike)))
    return out


def texts():
    rnd = random.Random(3)
    filler = lambda n: " ".join(rnd.choices("the and attion to thanedble anea Eriner of".split(), k=n))
    out = [None, "", filler(50), "\n\n", "license " * 3000, filler(30) + "\nAll rights reserved.\n" + filler(9) + "\nReleased under the MIT License.\nReleased under the MIT License."]
    for family in licence_texts.PARAGRAPHS.values():
        for t in family:
            out += [filler(20) + "\n" + t, t, filler(200) + ". " + t + " " + filler(200), t.upper(), t + " " + filler(4)]
    known = sorted(licenses.model()[0])
    out += [" ".join(rnd.choices(known, k=rnd.randint(1, 6))) for _ in range(300)]
    return out + list(licence_texts.OTHERS) + [t for _, t in licence_texts.HELD] + ["É license é", "a\r\nLicensed under CC BY-NC 4.0.\r\nb", "Mit dem Zug.", "Mit.", "MIT!!", "GNU GPL v2", "x" * 100_000 + " GPL v2"]


def test_same_as_plain_version(spark):
    rows = list(enumerate(texts()))
    d = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, findings int")
    got = {r.doc_id: [(f.family, round(f.probability, 6), f.confirmed) for f in r.findings if f.family != "unknown"] for r in licenses.scan_licenses(d).collect()}
    for i, t in rows:
        want = plain(t)
        assert len(got[i]) == len(want) and all(a[0] == b[0] and math.isclose(a[1], b[1], abs_tol=2e-6) and a[2] == b[2] for a, b in zip(got[i], want, strict=True)), t


def wrapped(text, mark="", width=68):
    import textwrap

    return "\n".join(mark + line for line in textwrap.wrap(text, width))


@pytest.mark.parametrize("mark", ["", " * ", "# ", "// "])
def test_wrapped_notices_are_found_whole(spark, mark):
    texts = [(k, t) for k, v in licence_texts.PARAGRAPHS.items() for t in v]
    rows = [(i, f"int x;\n\n{wrapped(t, mark)}\n\nint y;") for i, (_, t) in enumerate(texts)]
    got = {r.doc_id: r for r in licenses.license_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    one = {r.doc_id: r for r in licenses.license_report(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")).collect()}
    for i, (k, _) in enumerate(texts):
        assert (got[i].families, got[i].n_confirmed) == (one[i].families, one[i].n_confirmed) and k in got[i].families.split(","), texts[i]


OTHER_TEXTS = [
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
]


@pytest.mark.parametrize("text", ["The MIT campus is near the river.", "The GPL does not apply here.", "This is not licensed under the MIT License.", "It is no longer available under the GPL.", *OTHER_TEXTS[2:], *map(wrapped, OTHER_TEXTS)])
def test_what_grants_nothing_of_a_family_is_not_confirmed(spark, text):
    (r,) = licenses.license_report(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert r.families == "", r


def test_long_lines_and_many_lines_take_their_length(spark):
    import time

    docs = spark.createDataFrame([(1, "license " + "a" * 2_000_000), (2, ("the license of a line that is longer than forty characters\n") * 20_000), (3, "license\n" + " " * 1_000_000 + "x")], "doc_id long, text string")
    start = time.time()
    assert licenses.license_report(docs).count() == 3 and len(licenses.license_report(docs).collect()) == 3
    assert time.time() - start < 120


def test_paragraphs_without_a_key_are_unknown_for_certain():
    weights, bias = licenses.model()
    for k in range(len(bias) - 1):
        assert bias[k] < bias[-1]
        assert all(v[k] <= v[-1] + 1e-4 for g, v in weights.items() if not re.search(licenses.GATE, g))


@pytest.mark.parametrize("length", [10, 590, 600, 601, 5000])
def test_length_changes_nothing(spark, length):
    text = "a" * length + ". Released under the MIT License. " + "b" * length
    (r,) = licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(f.family, f.confirmed, f.paragraph) for f in r.findings] == [("mit", True, "Released under the MIT License.")]


def test_families_and_unknown(spark):
    rows, want = [], {}
    for family in licence_texts.NAMES:
        for name in licence_texts.NAMES[family]:
            want[len(rows)] = family
            rows.append((len(rows), f"Some text before.\nThis work is licensed under the {name}."))
    for t in (*licence_texts.OTHERS, *(f"Released under the {n}." for n in licence_texts.OTHER_NAMES)):
        want[len(rows)] = "unknown"
        rows.append((len(rows), t))
    got = {r.doc_id: r.family for r in licenses.license_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i] != want[i] for i in want) <= 0.03 * len(want), {rows[i][1]: got[i] for i in want if got[i] != want[i]}


#: Seen neither in training nor in the setting of the temperature.
UNSEEN = [
    ("unknown", "Licensed under the zlib license."), ("unknown", "Licensed under the Artistic License 2.0."), ("unknown", "All rights reserved to the king."), ("unknown", "ISC License"), ("unknown", "Distributed under the Boost Software License, Version 1.0."),
    ("unknown", "SPDX-License-Identifier: Zlib"), ("unknown", "SPDX-License-Identifier: BSL-1.0"), ("unknown", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("unknown", "This software is provided 'as-is', without any express or implied warranty."), ("unknown", "a marriage license was issued"), ("unknown", "he copied the apache without permission"), ("unknown", "the licence fee went up"),
    ("gpl", "GNU GPL version 3 or later"), ("gpl", "Distributed under the GPL v2."), ("apache", "Available under Apache-2.0"), ("apache", "Code licensed under Apache License 2.0"), ("bsd", "Released under BSD-3-Clause"), ("mit", "Released under the MIT license by the authors"),
    ("cc-by-nc", "Pictures: CC BY-NC 4.0"), ("cc-by-sa", "Content is available under CC BY-SA 3.0"), ("cc-by", "shared as CC BY 4.0"), ("mpl", "This file is under the Mozilla Public License 2.0"), ("proprietary", "Copyright 2011 Big Corp. All rights reserved."),
    ("public-domain", "CC0 1.0"), ("public-domain", "free and unencumbered software in the public domain"), ("lgpl", "GNU Lesser General Public License, version 3"), ("agpl", "You can redistribute it under the AGPLv3"), ("gpl", "it comes with the GNU General Public License"),
]


def test_unseen_wordings_and_licences(spark):
    rows = [(i, t) for i, (_, t) in enumerate(UNSEEN)]
    got = {r.doc_id: r.family for r in licenses.license_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {t: got[i] for i, (k, t) in enumerate(UNSEEN) if k == "unknown" and got[i] != k} == {}
    assert sum(got[i] == k for i, (k, _) in enumerate(UNSEEN)) >= 0.9 * len(UNSEEN)


def test_calibration_on_unseen_texts():
    """Expected calibration error of the most probable class, in four bins."""
    sure = [max(chances(t).items(), key=lambda c: c[1]) for _, t in UNSEEN]
    error = 0.0
    for lo in (0, 0.25, 0.5, 0.75):
        some = [(p, k == want) for (k, p), (want, _) in zip(sure, UNSEEN, strict=True) if lo < p <= lo + 0.25]
        error += abs(sum(p for p, _ in some) - sum(good for _, good in some)) / len(sure)
    assert error < 0.12


def test_rows_and_empty(spark):
    d = spark.createDataFrame([(None, "All rights reserved."), (1, None), (1, None)], "doc_id long, text string")
    for name in ("paragraph", "grams", "z", "family"):
        d = d.withColumn(name, F.lit("x"))
    rows = sorted(map(tuple, licenses.license_report(d).collect()), key=str)
    assert len(rows) == 3 and rows[2][4] == "proprietary" and rows[0] == (1, 0, 0, "", "unknown", None)
    assert licenses.license_report(d.limit(0)).count() == 0
