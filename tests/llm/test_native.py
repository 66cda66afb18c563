from __future__ import annotations

import random
import re
from collections import defaultdict

from evidence_engine.llm import chat_format, license_scan, line_dedup, quality_rules
from pyspark.sql import functions as F

from .helpers import edge_rows, frame, prose

WHITE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_dedup(rows, min_chars=10):
    key = lambda x: x.strip(WHITE).translate(LOWER)
    held = defaultdict(set)
    for i, t in rows:
        if i is not None:
            for x in (t or "").split("\n"):
                if len(key(x)) >= min_chars:
                    held[key(x)].add(i)
    out = []
    for i, t in rows:
        ls = (t or "").split("\n")
        left = [x for x in ls if i is None or len(held.get(key(x), ())) < 2 or i == min(held[key(x)])]
        out.append((i, len(ls), len(ls) - len(left), "\n".join(left)))
    return sorted(out, key=repr)


def test_line_dedup_against_brute_force(spark):
    shared = "This line stands in many documents"
    rows = edge_rows() + [(i, f"{prose(12, i)}\n{shared if i % 2 else shared.upper()}\nshort\n  {shared}\t\nÉcole {i % 3} où là\n") for i in range(20, 60)]
    rows += [(61, f"{shared}\n{shared}"), (62, "own line twice\nown line twice"), (20, f"{shared}\nother text of the same id")]
    got = line_dedup.line_dedup(frame(spark, rows).repartition(5))
    assert "key" in got.columns and "old" not in [r[0] for r in got.select("kept_text").collect()]
    out = [(r["doc_id"], r["kept_lines"], r["kept_dropped"], r["kept_text"]) for r in got.collect()]
    assert sorted(out, key=repr) == brute_dedup(rows)


def test_line_dedup_bitmaps_hold_runs(spark):
    docs = frame(spark, [(1, "a line of text\nb line of text"), (2, "keep one here\na line of text\nb line of text\nkeep two here")])
    (r,) = line_dedup.keep_bitmaps(docs).collect()
    assert (r["doc"], r["n_lines"], r["n_dropped"]) == (2, 4, 2)
    assert [tuple(x) for x in r["kept_runs"]] == [(0, 1), (3, 1)]


def test_line_dedup_empty(spark):
    assert line_dedup.line_dedup(frame(spark, [])).count() == 0


def brute_quality(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    wins = defaultdict(list)
    for i in range(len(w) - 4):
        wins[tuple(w[i : i + 5])].append(i)
    covered = {i + k for s in wins.values() if len(s) > 1 for i in s for k in range(5)}
    ls = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(ls) - len(set(ls)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def test_quality_rules_against_brute_force(spark):
    again = prose(9, 5)
    rows = edge_rows() + [(20, " ".join([again] * 3)), (21, prose(30, 6) + "\n" + again + "\n" + again), (22, "a " * 40), (23, prose(6, 7) + " " + prose(6, 7)), (24, "one two three four five"), (25, "# * $ % & | < > x y z")]
    out = quality_rules.quality_rules(frame(spark, rows))
    got = sorted(((r["row"]["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in out.collect()), key=repr)
    assert got == sorted(((i, *brute_quality(t)) for i, t in rows), key=repr)


def test_quality_cascade_keeps_prose_and_drops_junk(spark):
    good = [(i, ". ".join(prose(20, 100 + 10 * i + k) for k in range(4))) for i in range(5)]
    bad = [(10, " ".join(x + "***" for x in prose(60, 1).split())), (11, prose(80, 2).upper()), (12, " ".join(x + "!!" for x in prose(60, 3).split())), (13, " ".join(str(10**6 + 7 * k) for k in range(90)))]
    out = {r["row"]["doc_id"]: r for r in quality_rules.quality_rules(frame(spark, good + bad)).collect()}
    assert all(out[i]["kept"] for i, _ in good)
    assert not any(out[i]["kept"] or out[i]["base_failed"] for i, _ in bad)
    assert {out[i]["rejected_by"] for i in (11, 12)} == {"shouting", "exclamations"}


def test_quality_order_is_by_rejection_per_cost(spark):
    docs = frame(spark, [(i, prose(60, i).replace(" ", "* " if i % 2 else " ")) for i in range(40)])
    one = lambda: F.lit(1)
    never = ("never", lambda: F.col("n_words") < 0, one)
    some = ("some", lambda: F.col("n_symbols") > 0, one)
    order = quality_rules.ordered_rules(quality_rules.with_base_measures(docs), [never, some])
    assert [x[0][0] for x in order] == ["some", "never"] and order[1][1] == 0
    # half of the documents at a cost of 1, or all at the cost of their characters; what follows sees only what is left
    all_of = ("all", lambda: F.col("n_words") > 0, lambda: F.length("text"))
    order = quality_rules.ordered_rules(quality_rules.with_base_measures(docs), [all_of, some, never])
    assert [(x[0][0], x[1]) for x in order] == [("some", 0.5), ("all", 1.0), ("never", 0.0)] and order[1][2] > 100


def test_quality_order_is_the_same_on_each_run(spark):
    docs = frame(spark, [(i, prose(60, i) + ("!" * 40 if i % 3 == 0 else "") + ("***" * 30 if i % 7 == 0 else "")) for i in range(200)])
    runs = {tuple(x[0][0] for x in quality_rules.ordered_rules(quality_rules.with_base_measures(quality_rules.sampled(d, sample_rows=50)))) for d in (docs, docs.repartition(7), docs.orderBy(F.desc("doc_id")))}
    assert len(runs) == 1 and quality_rules.sampled(docs, sample_rows=50).count() == 50
    assert quality_rules.quality_rules(frame(spark, [])).count() == 0


def chats(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments string, turns int")


def read(spark, rows):
    out = chat_format.format_chats(chats(spark, [(*r, "x", 1) for r in rows]))
    out = out.withColumn("formatted", chat_format.formatted_text(F.col("segments"))).withColumn("loss", chat_format.loss_text(F.col("segments")))
    return {r["conv_id"]: r for r in out.withColumn("read", chat_format.read_turns(F.col("formatted"))).collect()}


def test_chat_round_trip(spark):
    nasty = ["\\### Assistant: </turn> ok", "</turn>", "<\\/turn>", "#### x: y", "\\", "\\\\</turn>\\", "", None, "### user: a</turn>### ", "a\nb: c", "$1 \\$0", "é中\U0001f600"]
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(nasty)] + [(2, 0, "odd: ### </turn> \\role", "x"), (None, 0, None, "n"), (3, 0, "user", "x" * 100_000), (3, 1, "assistant", "y" * 100_000)]
    got = read(spark, rows)
    for conv in (1, 2, 3, None):
        want = [(r[2] or "", r[3] or "") for r in rows if r[0] == conv]
        assert [tuple(x) for x in got[conv]["read"]] == want
        assert got[conv]["loss"] == "".join(t for role, t in want if role == "assistant")
    assert got[1]["formatted"].count("</turn>") == len(nasty)


def test_chat_machine(spark):
    roles = {1: "system user assistant", 2: "user assistant user", 3: "assistant user", 4: "user user", 5: "system", 6: "user robot", 7: "system assistant"}
    got = read(spark, [(c, k, r, "t") for c, rs in roles.items() for k, r in enumerate(rs.split())])
    assert {c: r["valid"] for c, r in got.items()} == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False, 7: False}
    assert got[4]["state"] == chat_format.FAILED


def test_chat_rows_without_a_conversation_stand_alone(spark):
    out = chat_format.format_chats(chats(spark, [(None, 0, "user", "a", "x", 1), (None, 1, "user", "b", "x", 1), (None, 1, "user", "b", "x", 1), (1, 0, "user", "c", "x", 1)]))
    told = [(r["conv_id"], [x["text"] for x in r["segments"]][1]) for r in out.collect()]
    assert sorted(told, key=str) == [(1, "c"), (None, "a"), (None, "b"), (None, "b")]


def test_chat_ties_repeats_and_empty(spark):
    got = read(spark, [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "system", "s")])
    assert [x["text"] for x in got[1]["read"]] == ["s", "a", "a", "b"]
    assert chat_format.format_chats(chats(spark, [])).count() == 0


def test_license_scan(spark):
    known = [t for ts in license_scan.TEMPLATES.values() for t in ts]
    rows = edge_rows() + [(100 + k, f"{prose(20, k)}\n{t}\n{prose(20, k + 50)}") for k, t in enumerate(known)]
    rows += [(200 + k, f"{prose(20, k)}\n{t}") for k, t in enumerate(license_scan.GENERIC)] + [(300 + i, prose(60, 900 + i) + "\n" + prose(30, 800 + i)) for i in range(40)]
    rows += [(400, f"{known[0]}\n{known[0].lower()}"), (400, f"{known[0]}\n{known[0].lower()}")]
    got = [(r["doc_id"], r["paragraph"], r["family"]) for r in license_scan.license_paragraphs(frame(spark, rows)).collect()]
    want = [(100 + k, 1, f) for k, f in enumerate(f for f, ts in license_scan.TEMPLATES.items() for _ in ts)]
    assert sorted(x for x in got if 100 <= x[0] < 200) == want
    assert not [x for x in got if x[0] is None or x[0] < 100 or 200 <= x[0] < 400]
    assert sorted(x for x in got if x[0] == 400) == [(400, 0, "apache")] * 2 + [(400, 1, "apache")] * 2


def test_license_scan_wrapped_and_reworded(spark):
    texts = [
        ("MIT License", "mit", 1),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files", "mit", 1),
        ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met", "bsd", 1),
        ("# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation", "gpl", 1),
        (" * released under the terms of the GNU General\n * Public License", "gpl", 1),
        ("SPDX-License-Identifier: GPL-2.0-only", "gpl", 1),
        ("Licensed under CC BY 3.0.", "cc_by", 1),
        ("licensed under a Creative Commons\nAttribution-ShareAlike 3.0 license", "cc_by_sa", 1),
        ("This Source Code Form is subject to the terms of the Mozilla\nPublic License, v. 2.0.", "mpl", 1),
    ]
    rows = [(i, f"{prose(20, i)}\n{t}\n{prose(20, i + 50)}") for i, (t, _, _) in enumerate(texts)]
    rows += [(100, "released under the GNU General\n\nPublic License")] + [(300 + i, prose(60, 900 + i) + "\n" + prose(30, 800 + i)) for i in range(40)]
    got = sorted((r["doc_id"], r["paragraph"], r["family"]) for r in license_scan.license_paragraphs(frame(spark, rows)).collect())
    assert got == [(i, at, f) for i, (_, f, at) in enumerate(texts)]


#: Wordings that neither train nor stand among the templates, wrapped as published or reworded.
HELD_OUT = {
    "agpl": ["This file is part of a program under the\nGNU Affero General Public License, either version 3", "Distributed under the GNU AGPL v3."],
    "apache": ["Distributed under the Apache License 2.0.", "   Licensed to you under the Apache License, Version 2.0\n   (the \"License\")"],
    "bsd": ["Use of this source code is governed by a BSD 3-Clause license.", "This project is under the BSD license found in the root directory."],
    "bsl": ["Licensor grants the rights of the Business Source License 1.1 only.", "// SPDX-License-Identifier: BUSL-1.1"],
    "cc_by": ["Text available under CC BY 3.0 unless noted.", "published with a Creative Commons\nAttribution 2.5 licence"],
    "cc_by_nc": ["Images: CC BY-NC 2.0", "Creative Commons Attribution-NonCommercial 3.0 Unported"],
    "cc_by_nc_nd": ["Shared as CC BY-NC-ND 3.0", "Creative Commons Attribution-NonCommercial-NoDerivatives licence"],
    "cc_by_nc_sa": ["Shared as CC BY-NC-SA 3.0", "Creative Commons Attribution-NonCommercial-ShareAlike licence"],
    "cc_by_nd": ["Shared as CC BY-ND 3.0", "Creative Commons Attribution-NoDerivatives licence"],
    "cc_by_sa": ["Content is CC BY-SA 3.0 like its source", "Creative Commons Attribution-ShareAlike\n3.0 Unported"],
    "gpl": ["Released under the terms of the GNU General\nPublic License v2", "GNU GPL version 2 or any later version"],
    "isc": ["ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose"],
    "lgpl": ["linked under the GNU Lesser General\nPublic License, version 2.1", "GNU LGPL 3 applies to this library"],
    "mit": ["The MIT License (MIT)", "Permission is hereby granted, free of charge, to anyone\nobtaining copies of the files"],
    "mpl": ["under the Mozilla Public License 1.1", "Mozilla Public License Version 2.0 applies"],
    "public_domain": ["The author puts this text into the public domain.", "This file is dedicated to the public domain."],
}
OTHERS = [
    "This is not licensed under the Apache License.", "The code isn't released under the MIT License.", "A general public license fee is due in spring.", "The public was granted permission to copy the map.",
    "His driving license was from the common domain of the crown.", "The work is subject to terms of the software company.", "All rights reserved by the creative team, by attribution.",
]


def test_license_precision_and_recall_on_held_out_wordings(spark):
    known = [(f, t) for f, ts in HELD_OUT.items() for t in ts]
    assert not {t for _, t in known} & {t for ts in license_scan.TEMPLATES.values() for t in ts}
    rows = [(i, f"{prose(20, i)}\n\n{t}\n\n{prose(20, i + 50)}") for i, (_, t) in enumerate(known)] + [(500 + i, f"{prose(20, i)}\n\n{t}") for i, t in enumerate(OTHERS)]
    rows += [(700 + i, prose(60, 900 + i)) for i in range(60)]
    got = {(r["doc_id"], r["family"]) for r in license_scan.license_paragraphs(frame(spark, rows)).collect()}
    assert not [x for x in got if x[0] >= 500]
    for family in HELD_OUT:
        wanted = {(i, f) for i, (f, _) in enumerate(known) if f == family}
        found = {x for x in got if x[1] == family}
        assert found <= wanted and len(found & wanted) >= len(wanted) - 1, (family, found, wanted)
    assert len(got) >= 0.9 * len(known)


#: Short names, expressions and denials that neither train nor stand among the texts.
SHORT = {
    "This software is MIT licensed.": "mit", "License: MIT": "mit", "Licensed under GPLv3": "gpl", "Licensed under Apache-2.0 OR MIT": "apache", "CC0 1.0 Universal": "public_domain", "Creative Commons Zero": "public_domain",
    "Unlicense: this is free and unencumbered software": "public_domain", "MIT-licensed code": "mit", "LGPLv2.1+": "lgpl", "(GPL-2.0-or-later)": "gpl", "Dual use of the BSD-2-Clause licence": "bsd",
    "this project does not use the Apache License": None, "We considered the GNU General Public License but rejected it": None, "They did not publish it under the GNU AGPL": None, "the MIT License was rejected": None, "A talk about the Mozilla Public License": None,
}


def test_license_short_names_expressions_and_denials(spark):
    trained = {g.format(n) for ns in license_scan.NAMES.values() for n in ns for g in (*license_scan.GRANTS, *license_scan.DENIALS)}
    assert sum(t in trained for t in SHORT) <= 2  # two names are sentences of their own
    rows = [(i, f"{prose(20, i)}\n{t}\n{prose(20, i + 50)}") for i, t in enumerate(SHORT)] + [(700 + i, prose(60, 900 + i)) for i in range(60)]
    found = {r["doc_id"]: r["family"] for r in license_scan.license_paragraphs(frame(spark, rows)).collect()}
    assert not [i for i in found if i >= 700]
    wanted = {i: f for i, f in enumerate(SHORT.values()) if f}
    assert all(wanted.get(i) == f for i, f in found.items()), found  # precision
    assert len(found) >= 0.9 * len(wanted), (found, wanted)  # recall


def test_license_wording_over_many_lines(spark):
    text = "This Source\nCode Form is\nsubject to\nthe terms of the\nMozilla Public\nLicense, v. 2.0."
    rows = [(1, f"{prose(20, 1)}\n\n{text}\n\n{prose(20, 2)}")] + [(700 + i, prose(60, 900 + i)) for i in range(40)]
    assert [(r["doc_id"], r["family"]) for r in license_scan.license_paragraphs(frame(spark, rows)).collect()] == [(1, "mpl")]


def test_license_features_and_similarity_against_plain_python(spark):
    texts = ["Licensed under CC BY 4.0.", "", "a", "Permission is hereby granted, free, to a person", "GNU  General\nPublic License", "not licensed under the MIT License v2", "the terms of the software foundation", "GPLv3 or LGPL-2.1", "unlicensed Apache2"]
    d = spark.createDataFrame([(t, f + 1) for t in texts for f in range(len(license_scan.TEXTS))], "text string, f int")
    tokens = license_scan._tokens(F.col("text"))
    for r in d.select("text", "f", tokens.alias("w"), license_scan.grams(tokens).alias("g"), license_scan.similarity(tokens, F.col("f")).alias("s")).collect():
        w = license_scan._token_list(r["text"])
        assert r["w"] == w and r["g"] == w + [f"{a} {b}" for a, b in zip(w, w[1:])]
        texts_of = list(license_scan.TEXTS.values())[r["f"] - 1]
        best = max(sum(license_scan.WEIGHTS[x] for x in t if x in w) / sum(license_scan.WEIGHTS[x] for x in t) for t in texts_of)
        assert abs(r["s"] - best) < 1e-9, (r["text"], r["f"])
    assert license_scan._token_list("Licence GPLv3, LGPL-2.1 v2 Apache2 unlicensed") == ["license", "gpl", "lgpl", "apache", "unlicense"]


def test_license_limit_is_calibrated_on_hard_negatives(spark):
    rows = [(i, f"{prose(20, i)}\nthe public {prose(3, 700 + i)} has a general license for software {prose(2, 800 + i)}\n{prose(20, i + 50)}") for i in range(80)]
    rows += [(500 + i, f"{prose(10, i)}\nReleased under the MIT License.\n{prose(10, 90 + i)}") for i in range(10)]
    scanners = [license_scan.Scanner(spark, frame(spark, r)) for r in (rows, rows[::-1])]
    assert scanners[0].limit == scanners[1].limit  # whatever the order of rows
    found = license_scan.Scanner.unknowns(frame(spark, rows), id_col="doc_id", text_col="text", sample=1000).collect()
    hard = [r for r in found if r["hard"] and "general license" in r["text"]]
    assert len(hard) >= 80 and {r["fits"] for r in hard} == {True, False} and not [r for r in found if "MIT License" in r["text"]]
    got = {(r["doc_id"], r["paragraph"], r["family"]) for r in scanners[0].scan(frame(spark, rows)).collect()}
    assert got == {(500 + i, 1, "mit") for i in range(10)}


def test_license_model_and_limit_take_the_whole_corpus(spark):
    hard = [f"the public {prose(3, 700 + i)} has a general license for software {prose(2, 3000 + i)}" for i in range(1300)]
    docs = frame(spark, [(i, f"{t}\n\n{prose(4, i % 50)}\n{prose(4, i % 50)}") for i, t in enumerate(hard)] + [(None, None), (9000, "")])
    found = license_scan.Scanner.unknowns(docs, id_col="doc_id", text_col="text")
    paragraphs = found.where("hard").collect()
    assert sorted(r["text"] for r in paragraphs) == sorted(set(hard)) and {r["fits"] for r in paragraphs} == {True, False}  # more than any sample held
    plain = found.where("NOT hard AND fits")
    assert sorted(r["text"] for r in plain.collect()) == sorted(prose(4, i % 50) for i in range(1300) for _ in range(2))

    scanner = license_scan.Scanner.__new__(license_scan.Scanner)  # its features alone
    scanner.hashing = license_scan.HashingTF(inputCol="grams", outputCol="features", numFeatures=license_scan.FEATURES, binary=True)
    plain = spark.createDataFrame([(prose(1 + i % 9, i % 50),) for i in range(700)] + [("Licence, v2; a",), ("--",)], "text string")
    tokens = license_scan._tokens(F.col("text"))
    brute = scanner.hashing.transform(plain.withColumn("n", F.size(tokens)).withColumn("grams", license_scan.grams(tokens))).select("n", "features").collect()
    classes = {}
    for r in brute:
        classes.setdefault((r["n"] + 1).bit_length(), []).append(r["features"].toArray())
    want = sorted((len(rows) * min(1.0, license_scan.UNKNOWN_WEIGHT / len(brute)), [sum(x) / len(rows) for x in zip(*rows)]) for rows in classes.values())
    got = sorted((r["weight"], list(r["features"].toArray())) for r in scanner.means(plain).collect())
    assert len(got) == len(want) == 4
    for (w, shares), (weight, features) in zip(want, got):
        assert abs(w - weight) < 1e-9 and max(abs(a - b) for a, b in zip(shares, features)) < 1e-12


def test_license_limit_is_the_exact_quantile(spark):
    rng = random.Random(5)
    cases = [[], [0.9], [0.1], [0.2, 0.9], [0.0] * 150 + [0.8], [0.0] * 90 + [0.7, 0.95], [0.0] * 500 + [0.9] * 40, [rng.random() for _ in range(2500)], [0.0] * 9 + [rng.random() ** 0.1 for _ in range(800)]]
    for values in cases:
        rows = spark.createDataFrame([(x,) for x in values], "top double")
        want = rows.agg(F.percentile("top", F.lit(0.99))).first()[0]
        assert abs(license_scan.quantile_above(rows, 0.7, 0.99) - max(0.7, want or 0.0)) < 1e-12, values[:5]


def test_license_scan_empty(spark):
    assert license_scan.license_paragraphs(frame(spark, [])).count() == 0
