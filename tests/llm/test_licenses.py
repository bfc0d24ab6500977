import random
import re
import time
from collections import Counter

import numpy as np

from tessera.llm.decontamination import word_hashes
from tessera.llm.licenses import TEMPLATES, THRESHOLD, Templates, normalised, scan_licenses
from tessera.llm.text import windows


def grams(text):
    w = re.findall(r"[^\W_]+", normalised(text).lower())
    return [tuple(w[i : i + 2]) for i in range(len(w) - 1)]


def brute(text, templates, threshold):
    """All passages against all templates, without bounds."""
    g, found = grams(text), []
    for k, (_, body) in enumerate(templates.values()):
        t = Counter(grams(body))
        size = sum(t.values())
        for a in range(len(g)):
            best = None
            if g[a] in t:
                for b in range(a, min(len(g), a + 3 * size)):
                    if g[b] in t:
                        dice = 2 * sum((Counter(g[a : b + 1]) & t).values()) / (b - a + 1 + size)
                        if dice >= threshold - 1e-12 and (best is None or dice > best[0]):
                            best = (dice, b - a + 1)
            if best:
                found.append((k, a, best[1], best[0]))
    found.sort(key=lambda x: (-x[3], -x[2], x[1], x[0]))
    kept = []
    for x in found:
        if all(x[1] + x[2] < y[1] or y[1] + y[2] < x[1] for y in kept):
            kept.append(x)
    names = list(templates)
    return [(names[k], a, m + 1, round(d, 9)) for k, a, m, d in kept]


def test_against_brute_force(spark):
    rng = random.Random(3)
    short = {n: t for n, t in TEMPLATES.items() if len(t[1]) < 200}
    filler = [f"zz{i}" for i in range(30)] + ["licensed", "under", "the", "license", "version"]
    docs = []
    for i in range(95):
        words = [rng.choice(filler) for _ in range(rng.randrange(0, 40))]
        for _ in range(rng.randrange(3)):
            body = rng.choice(list(short.values()))[1].split()
            for _ in range(rng.randrange(3)):
                body[rng.randrange(len(body))] = rng.choice(filler)
            at = rng.randrange(len(words) + 1)
            words[at:at] = body
        docs.append((i, " ".join(words)))
    docs += [(100, None), (101, ""), (102, "one"), (103, "x " * 50_000 + "Released under\nthe MIT license!")]
    df = spark.createDataFrame([(*d, "a", 1.0) for d in docs], "doc_id long, text string, license string, dice double")
    got = sorted((r.id, r.template, r.first_word, r.n_words, round(r.dice, 9)) for r in scan_licenses(df, templates=short).collect())
    want = sorted((i, *x) for i, t in docs if i < 103 for x in brute(t, short, THRESHOLD))
    assert [g for g in got if g[0] != 103] == want and len(want) > 30
    assert [g for g in got if g[0] == 103] == [(103, "mit-line", 50_000, 5, 1.0)]


def test_templates_match_themselves_best(spark):
    df = spark.createDataFrame([(k, f"words before it. {t[1]} words behind it") for k, t in enumerate(TEMPLATES.values())], "doc_id long, text string")
    got = {r.id: r for r in scan_licenses(df).orderBy("dice").collect()}
    for k, (name, (licence, _)) in enumerate(TEMPLATES.items()):
        assert got[k].dice == 1.0 and got[k].license == licence, name
    assert scan_licenses(df.limit(0)).count() == 0
    r = scan_licenses(spark.createDataFrame([(None, "Copyright (c) 1999-2003. All rights reserved.")], "doc_id long, text string")).first()
    assert (r.id, r.license, r.dice) == (None, "Proprietary", 1.0)


GPL3 = TEMPLATES["gpl3-notice"][1]
BSD2 = TEMPLATES["bsd"][1]
CLAUSE = "Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
DISCLAIMER = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.'


def test_near_licences_have_their_own_names(spark):
    cases = [
        (["GPL-3.0"], GPL3),
        (["GPL-2.0"], GPL3.replace(": you", "; you").replace("version 3", "version 2")),
        (["GPL-2.0"], GPL3.replace("This program is free", "Foo is free").replace("either version 3 of the License, or (at your option) any later version", "version 2 of the License")),
        (["LGPL-2.0"], GPL3.replace("program", "library").replace("General", "Library General").replace("version 3", "version 2")),
        (["LGPL-2.1"], GPL3.replace("program", "library").replace("General", "Lesser General").replace("version 3", "version 2.1")),
        (["LGPL-2.1"], GPL3.replace("General", "Lesser General").replace("version 3", "version 2.1")),
        (["LGPL-3.0"], GPL3.replace("program", "library").replace("General", "Lesser General")),
        (["LGPL-3.0"], GPL3.replace("General", "Lesser General")),
        (["AGPL-3.0"], GPL3.replace("General", "Affero General")),
        (["LGPL-3.0"], "This work is licensed under the GNU Lesser General Public License, version 3."),
        (["AGPL-3.0"], "This work is licensed under the GNU Affero General Public License, version 3."),
        (["CC-BY-3.0"], "This work is licensed under a Creative Commons Attribution 3.0 Unported License."),
        (["CC-BY-NC-SA-4.0"], "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
        (["CC-BY-ND-4.0"], "Licensed under CC BY-ND 4.0."),
        (["BSD-2-Clause"], f"{BSD2} {DISCLAIMER}"),
        (["BSD-3-Clause"], f"{BSD2} 3. {CLAUSE.format('the copyright holder')} {DISCLAIMER}"),
        (["BSD-3-Clause"], f"{BSD2} * {CLAUSE.format('Google Inc.')} {DISCLAIMER}"),
        (["BSD-3-Clause"], f"{BSD2} 3. The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission. {DISCLAIMER}"),
        (["BSD-4-Clause"], f"{BSD2} 3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the Foo Project. 4. {CLAUSE.format('the Foo Project')} {DISCLAIMER}"),
        (["BSD-2-Clause", "BSD-3-Clause"], f"{BSD2} {BSD2} 3. {CLAUSE.format('Google Inc.')}"),
    ]
    df = spark.createDataFrame([(k, f"words before it. {t} words behind it") for k, (_, t) in enumerate(cases)], "doc_id long, text string")
    got = {}
    for r in scan_licenses(df).orderBy("id", "first_word").collect():
        got.setdefault(r.id, []).append(r.license)
    assert [got.get(k) for k in range(len(cases))] == [want for want, _ in cases]


def test_many_notices_in_one_text_are_cheap():
    templates = Templates(TEMPLATES, THRESHOLD)
    for name, times in (("mit-line", 20_000), ("apache-notice", 2_000), ("bsd", 500)):
        words, _ = word_hashes([normalised(TEMPLATES[name][1] + " and then something else ") * times])
        grams = windows(words, 2)
        code = np.minimum(np.searchsorted(templates.codes, grams), len(templates.codes) - 1)
        code = np.where(templates.codes[code] == grams, code, len(templates.codes))
        began = time.time()
        found = templates.passages(code)
        took = time.time() - began
        assert len([x for x in found if templates.names[x[0]] == name]) == times and took < 4, (name, took)
