import math
import re
import textwrap

from lexispark.llm.common import documents
from lexispark.llm.licenses import NONE, PROSE, TEMPLATES, LicenseParams, fit, gate_words, grams, scan, template_words, tokens
from lexispark.llm.queries import op9_license_scan

D = "/root/testdata/sf0.01"
PLANTED = {"Licensed under the Apache License, Version 2.0.": "apache-2.0", "Released under the MIT License.": "mit", "GNU General Public License, version 3": "gpl", "CC BY-NC 4.0": "cc-by-nc", "All rights reserved.": "proprietary"}


def predict(line, m):
    """The most likely class of a paragraph and its probability, in plain Python."""
    z = list(m.bias)
    for g in grams(tokens(line)):
        if g in m.weights:
            z = [a + b for a, b in zip(z, m.weights[g], strict=True)]
    e = [math.exp(v - max(z)) for v in z]
    return m.classes[e.index(max(e))], max(e) / sum(e)


def classify(line, m=None, left_out=()):
    m = m or fit(LicenseParams())
    name, probability = predict(line, m)
    if name == NONE or probability < m.threshold:
        return None
    own = set(tokens(line))
    parts = [[v for w, v in template_words(t) if w in own] + [0] for t in TEMPLATES[name] if t not in left_out]
    sizes = [len(template_words(t)) for t in TEMPLATES[name] if t not in left_out]
    fits = max((min(sum(x), (len(x) - 1) / n) for x, n in zip(parts, sizes, strict=True)), default=0)
    return name if fits >= LicenseParams().containment - 1e-6 else None


def brute(text):
    """(line, last, family) of all notices: every line and every window of a block is scored, without a gate."""
    p, lines = LicenseParams(), (text or "").lower().split("\n")
    out = [(i, i + 1, c) for i, s in enumerate(lines) if (c := classify(s))]
    gaps = [i for i, s in enumerate(lines) if not s.strip(" \t\n\x0b\x0c\r")]
    for a, z in zip([0, *(g + 1 for g in gaps)], [*gaps, len(lines)], strict=True):
        at = a
        while z - a > 1:
            end = min(z, at + p.window)
            if (c := classify(" ".join(lines[at:end]))) and not any(x < end and at < y and f == c for x, y, f in out):
                out.append((at, end, c))
            if end == z:
                break
            at += p.window // 2
    return sorted(out)


def test_query_equals_brute_force(spark):
    got = {r["doc_id"]: r for r in op9_license_scan(spark, D).collect()}
    for r in documents(spark, D).select("doc_id", "text").collect():
        want = brute(r["text"])
        assert [(n["line"], n["last"], n["family"]) for n in got[r["doc_id"]]["notices"]] == want, r["text"]
        assert {f for _, _, f in want} == {f for k, f in PLANTED.items() if k in r["text"]}


def test_left_out_templates():
    right = wrong = 0
    for k in range(3):
        left_out = tuple(ts[k] for ts in TEMPLATES.values() if len(ts) > 3 and k < len(ts))
        m = fit(LicenseParams(steps=150), left_out)
        for f, ts in TEMPLATES.items():
            for t in set(ts) & set(left_out):
                found = classify(t, m, left_out)
                right += found == f
                wrong += found not in (f, None)
    assert wrong == 0 and right >= 1


def test_templates_and_prose():
    assert all(classify(t) == f for f, ts in TEMPLATES.items() for t in ts)
    assert all(classify(t) is None for t in PROSE)
    assert classify("This license plate is reserved for rights of way and redistribution of sand") is None


def test_edge_cases(spark, docs):
    rows = [(1, None), (2, ""), (3, "x\nRELEASED under the mit license\n\nAll rights reserved."), (3, "x\nRELEASED under the mit license\n\nAll rights reserved."), (None, "a mozilla street"), (4, "word " * 200_000 + "mozilla")]
    got = [(r["doc_id"], r["n_paragraphs"], r["n_candidates"], r["n_unknown"], r["families"], [n["line"] for n in r["notices"]]) for r in scan(docs(*rows)).collect()]
    two = (3, 3, 2, 0, ["mit", "proprietary"], [1, 3])
    assert sorted(got, key=str) == sorted([(1, 0, 0, 0, [], []), (2, 0, 0, 0, [], []), two, two, (None, 1, 1, 1, [], []), (4, 1, 1, 1, [], [])], key=str)
    assert scan(docs(*rows).filter("false")).count() == 0
    assert re.split(r"\s", "a b") == ["a", "b"]


def test_the_gate_loses_nothing(spark, docs):
    lines = ["Available under CC BY 4.0.", "Released under the GPL, version 2 or later.", *PROSE, *(t for ts in TEMPLATES.values() for t in ts)]
    lines += [" ".join(w for i, w in enumerate(tokens(t)) if i % 4 != k) for ts in TEMPLATES.values() for t in ts for k in range(4)]
    got = {r["doc_id"]: r["families"] for r in scan(docs(*enumerate(lines))).collect()}
    assert got == {i: [c] if (c := classify(s)) else [] for i, s in enumerate(lines)}
    gate = set(gate_words(LicenseParams()))
    for ts in TEMPLATES.values():
        for t in ts:
            assert sum(v for w, v in template_words(t) if w not in gate) < LicenseParams().containment


WRAPPED = {
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.',
    "isc": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "epl": "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "cc0": "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.",
    "apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "zlib": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
}
SPDX = {"MIT": "mit", "ISC": "isc", "Apache-2.0": "apache-2.0", "GPL-3.0-or-later": "gpl", "LGPL-2.1-or-later": "lgpl", "MPL-2.0": "mpl", "EPL-2.0": "epl", "CC0-1.0": "cc0", "BSD-3-Clause": "bsd"}


def test_wrapped_notices(spark, docs):
    rows = []
    for mark in ("", "# ", " * "):
        for f, t in WRAPPED.items():
            lines = textwrap.wrap(t, 72 - len(mark))
            rows.append((f, "def f():\n\n" + "\n".join(mark + s for s in lines) + "\n \nThe end.\nOf the file."))
    rows += [(f, f"// SPDX-License-Identifier: {x}\n\nint main;") for x, f in SPDX.items()]
    got = {r["doc_id"]: r["families"] for r in scan(docs(*((i, t) for i, (_, t) in enumerate(rows)))).collect()}
    wrong = [(f, got[i]) for i, (f, _) in enumerate(rows) if not set(got[i]) <= {f, "proprietary" if f == "epl" else f}]
    missed = [f for i, (f, _) in enumerate(rows) if f not in got[i]]
    assert wrong == [] and missed == []
