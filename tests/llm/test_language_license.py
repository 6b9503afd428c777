import random

from pyspark.sql import functions as F

from skyloom.llm import language_id, license_scan
from skyloom.llm.license_texts import TEMPLATES

SYLLABLES = {"en": "th he in er an re ing ed", "de": "sch ung ein ich der ver keit ü", "fr": "eau ou aix que é tion le ent", "es": "ción ado os ar que ñ la ll", "xx": "zq kv wj yy qx vv"}


def sample(spark, n=120):
    rng = random.Random(2)
    word = lambda lang: "".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randint(1, 4)))
    rows = [(i, " ".join(word(lang) for _ in range(rng.randint(12, 60))), lang) for i in range(n) for lang in SYLLABLES]
    return spark.createDataFrame([(k, t, lang) for k, (_, t, lang) in enumerate(rows)], "doc_id long, text string, lang string").repartition(3)


def test_held_out_accuracy(spark):
    docs = sample(spark).withColumn("key", F.col("doc_id").cast("string"))
    model = language_id.train(docs.filter("doc_id % 4 != 2").select("text", "lang", "key"))
    got = language_id.identified(docs.filter("doc_id % 4 = 2"), model, carry=("doc_id", "lang")).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_every_language_is_learned(spark, monkeypatch):
    """Many languages get fewer rows each, none is left out; the weights are broadcast once."""
    monkeypatch.setattr(language_id, "ALL", 150)
    docs = sample(spark).withColumn("key", F.col("doc_id").cast("string"))
    model = language_id.train(docs.select("text", "lang", "key"))
    assert model.langs == sorted(SYLLABLES) and not hasattr(model.families, "weights")
    got = language_id.identified(docs, model, carry=("lang",)).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)


def test_odd_languages(spark, odd, empty):
    docs = odd.withColumn("key", F.lit("k"))
    model = language_id.train(docs.select("text", "lang", "key"))
    got = language_id.identified(odd, model, carry=("doc_id", "text")).collect()
    assert len(got) == odd.count()
    for r in got:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")), r.text and r.text[:30]
    none = language_id.train(docs.limit(0).select("text", "lang", "key"))
    assert {r.lang_pred for r in language_id.identified(odd, none).collect()} == {"und"}
    one = language_id.train(docs.filter("lang = 'en'").select("text", "lang", "key"))
    assert {r.lang_pred for r in language_id.identified(odd, one).collect()} == {"und", "en"}
    assert language_id.identified(empty, model).count() == 0


def test_licenses(spark, odd, empty):
    rng = random.Random(6)
    filler = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(n))
    cases = [
        ("Released under the MIT License.", {"MIT"}), ("Licensed under CC BY-NC 4.0.", {"CC-BY-NC-4.0"}), ("licensed under the GNU General Public License, version 2", {"GPL-2.0"}),
        ("This is my driving licence", set()), ("All rights reserved.", {"LicenseRef-reserved"}), (TEMPLATES[2][2], {"BSD-3-Clause"}), (TEMPLATES[1][2], {"BSD-2-Clause"}),
        (TEMPLATES[0][2].replace("furnished", "given"), {"MIT"}), (TEMPLATES[0][2].replace(" the ", " some ").replace(" to ", " for "), set()),
        ("Released under the MIT License.\n" + filler(300) + "\nAll rights reserved.", {"MIT", "LicenseRef-reserved"}), (filler(40_000) + " " + TEMPLATES[3][2] + " " + filler(40_000), {"ISC"}),
    ]
    docs = spark.createDataFrame([(i, f"{filler(30)}\n{t}\n{filler(20)}") for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: {m.license for m in r.matches} for r in license_scan.scanned(docs).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}
    assert license_scan.scanned(odd).count() == odd.count() and license_scan.scanned(empty).count() == 0


def licenses(text):
    return {m[0] for m in license_scan.Templates().scan(text, license_scan.re.compile(license_scan.CUES, license_scan.re.IGNORECASE))[1]}


def test_many_licenses_in_one_block():
    gnu, by = "licensed under the GNU General Public License, version 3.", "licensed under CC BY 4.0."
    assert licenses(f"{gnu}\nThe photographs are {by}") == {"GPL-3.0", "CC-BY-4.0"}
    named = {spdx: text for spdx, kind, text in TEMPLATES if kind == "notice"}
    eight = ("MIT", "Apache-2.0", "CC-BY-4.0", "GPL-3.0", "MPL-2.0", "ISC", "CC-BY-SA-4.0", "CC0-1.0")
    for separator in ("\n", ". "):
        assert licenses(separator.join(f"Part {i} is licensed {named[x]}" for i, x in enumerate(eight))) == set(eight)
    assert licenses("word " * 900 + separator.join(f"licensed {named[x]}" for x in eight) + " word" * 900) == set(eight)


def test_a_wording_is_its_own_license():
    for spdx, kind, text in TEMPLATES:
        assert licenses(text) == {spdx}, (spdx, kind)


def test_words_that_also_stand_elsewhere():
    text = next(t for spdx, kind, t in TEMPLATES if (spdx, kind) == ("MIT", "text"))
    assert licenses(text.replace("furnished", "given") + "\nThe license was furnished. " + "x " * 200 + "license") == {"MIT"}


def test_wrapped_and_named_licenses():
    filler = "alpha beta gamma delta\n" * 200
    unlicense = (
        "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\n"
        "distribute this software, either in source code form or as a compiled\nbinary, for any purpose, commercial or non-commercial, and by any\nmeans.\n\n"
        "In jurisdictions that recognize copyright laws, the author dedicates it."
    )
    gnu = (
        "{0} is free software{3} you can redistribute it and/or modify\nit under the terms of the GNU {1} as published by\n"
        "the Free Software Foundation{3} either version {2} of the License, or\n(at your option) any later version."
    )
    cases = {
        unlicense: {"Unlicense"}, gnu.format("This program", "General Public License", "3", ";"): {"GPL-3.0"}, gnu.format("This library", "Lesser General Public License", "2.1", ";"): {"LGPL-2.1"},
        "This file is under the terms of the MIT License.": {"MIT"}, "Distributed under the MIT licence": {"MIT"}, "# SPDX-License-Identifier: MIT": {"MIT"}, "SPDX-License-Identifier: (GPL-2.0-or-later WITH Classpath-exception-2.0) OR Zlib": {"GPL-2.0", "Zlib"},
        "Text CC BY 4.0": {"CC-BY-4.0"}, "Creative Commons Attribution 4.0 International": {"CC-BY-4.0"}, "Creative Commons Attribution-ShareAlike 3.0 Unported License": {"CC-BY-SA-3.0"},
        "under the GNU General Public License as published by the Free Software Foundation, version 2.": {"GPL-2.0"}, "under the Apache License, Version 2.0 or the MIT License": {"Apache-2.0", "MIT"},
    }
    for text, want in cases.items():
        assert licenses(filler + text) == want, text
        assert licenses(text + "\n" + filler) == want, text


def test_the_ranking_decides_contested_wordings():
    """GPL and LGPL headers are within a word in ten of each other; what compresses the place best is the license."""
    t = license_scan.Templates()
    at = {(spdx, kind): k for k, (spdx, kind, _) in enumerate(t.templates)}
    for spdx, kind, text in TEMPLATES:
        block = license_scan.words(text)[0]
        saved = t.reductions(" ".join(block).encode())
        best = max(range(len(saved)), key=saved.__getitem__)
        same = [k for k, (_, _, own) in enumerate(t.templates) if " ".join(own) in " ".join(block)]
        assert len(text) < 40 or t.templates[best][0] == spdx or best in same, (spdx, kind)  # of a few letters any dictionary saves the same
    gpl, lgpl = (next(x for s, k, x in TEMPLATES if (s, k) == (name, "header")) for name in ("GPL-3.0", "LGPL-3.0"))
    assert list(t.compare(license_scan.words(lgpl)[0], at["GPL-3.0", "header"]))  # confirmed by its words, and yet not the winner
    assert licenses(lgpl) == {"LGPL-3.0"} and licenses(gpl) == {"GPL-3.0"}
    assert licenses(f"{gpl}\n\nThe library part:\n{lgpl}") == {"GPL-3.0", "LGPL-3.0"}


def planted(seed):
    """Texts with one wording of a template, words changed, wrapped anew, in filler; and the licenses that stand there."""
    rng = random.Random(seed)
    filler = lambda n: " ".join(rng.choice("alpha beta gamma delta river stone copyright software".split()) for _ in range(n))
    for spdx, kind, text in TEMPLATES:
        w = text.replace("<...>", "" if kind != "text" else "the authors").split()
        if len(w) >= 40:  # one word in twenty is another one, or gone; none with a digit
            for i in rng.sample([i for i, x in enumerate(w) if x.isalpha() and len(x) > 3], len(w) // 20):
                w[i] = rng.choice(["", "thing"])
        lines, line = [], []
        for x in filter(None, w):
            line.append(x)
            if len(line) == rng.randint(7, 12):
                lines, line = [*lines, " ".join(line)], []
        wrapped = "\n".join([*lines, " ".join(line)])
        yield spdx, f"{filler(rng.randint(0, 400))}\n{wrapped if kind != 'notice' else wrapped.replace(chr(10), ' ')}\n{filler(rng.randint(0, 400))}"


def test_recall_on_planted_wordings_and_brute_force_over_all_templates():
    t = license_scan.Templates()
    cue = license_scan.re.compile(license_scan.CUES, license_scan.re.IGNORECASE)
    right = total = 0
    for seed in range(5):
        for spdx, text in planted(seed):
            found = {m[0] for m in t.scan(text, cue)[1]}
            right, total = right + (found == {spdx}), total + 1
            # brute force: every template against the whole text; the scan loses none but those that a better one holds
            block, starts = license_scan.words(text)
            every = {t.templates[k][0]: [(starts[a], starts[b] + len(block[b])) for a, b, _, _ in t.compare(block, k)] for k in range(len(t.templates))}
            spans = [(m[6], m[7]) for m in t.scan(text, cue)[1]]
            for name, places in every.items():
                assert name in found or all(any(a <= x and y <= b or x <= a and b <= y for a, b in spans) for x, y in places), (name, spdx)
    assert right / total >= 0.95, right / total


def test_clean_texts_have_no_license():
    rng = random.Random(3)
    some = "the license of a driver is a public document and software under the general terms of version two is free to copy for any person".split()
    for _ in range(200):
        assert licenses(" ".join(rng.choice(some) for _ in range(120))) == set()
