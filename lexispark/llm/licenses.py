"""License scans by a trained paragraph classifier (DataFrame functions only).

A multinomial logistic regression over sparse word 1- and 2-grams (present or
not) tells licence families from ordinary prose.  It is fitted on the driver on
the built-in notices below, cut and thinned at random from a fixed seed, and on
plain sentences that use the same words.  The unknown class is calibrated on what
no fit has seen: sentences and notices are dealt to folds, and the threshold lets
at most ``false_alarms`` of the sentences left out pass as a family.

A prediction above it must be confirmed by a template of its family: enough of the
template's words in the paragraph, both by number and with a word counting by how few
families use it, so that neither what all licences say nor one rare word confirms anything.

Scoring is one projection over the texts, without a shuffle.  Only paragraphs with
a gate word are scored; a paragraph that a template can confirm has one, as what the
template has without its gate words is too little.  The gate is one pattern.

A paragraph is a line, or a block of lines between blank ones, as notices stand
wrapped in files; a block of more than ``window`` lines is read in overlapping
windows of so many lines.  A block or window is left out if a line of it, or a window
before it, is confirmed as the same family.  Edge cases: null and empty texts have no
paragraphs and no families; ties between families go to the one that sorts first;
repeated rows give repeated results; a line of any length is scored as one paragraph.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import lru_cache
from math import log

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind

#: Public notices of each family (fixed texts).
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "This project is licensed under the terms of the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "This software is distributed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    "bsd": (
        "Released under the BSD 3-Clause License.",
        "This code is licensed under the 2-clause BSD license.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GPL license, version 2 or later.",
        "Licensed under the GPLv3.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "SPDX-License-Identifier: GPL-2.0",
        "SPDX-License-Identifier: GPL-2.0-or-later",
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "Released under the LGPL license.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "agpl": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "Released under the AGPL license.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "epl": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "Licensed under the Eclipse Public License.",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ),
    "zlib": (
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
        "Released under the zlib License.",
        "SPDX-License-Identifier: Zlib",
    ),
    "boost": (
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
        "SPDX-License-Identifier: BSL-1.0",
    ),
    "cc0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal.",
        "Released under Creative Commons Zero, CC0 1.0.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "cc-by-sa": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "cc-by-nc": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "public-domain": (
        "This work is dedicated to the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
        "SPDX-License-Identifier: Unlicense",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright by the author, all rights reserved.",
        "No part of this publication may be reproduced without written permission of the publisher, all rights reserved.",
    ),
}

#: Prose with the same words that licenses nothing.
PROSE = (
    "He renewed his driving license at the office in town.",
    "The apache people lived in the south west.",
    "Students at MIT published a new version of their work.",
    "The public was asked to use the source of the river with care.",
    "All of the seats were reserved by the time we came.",
    "Civil rights were reserved for a few and denied to the rest.",
    "She asked for permission to copy the file and it was granted.",
    "The fishing license is valid for all public waters.",
    "Licensed drivers may use the lane under the bridge, version or no version.",
    "The domain of the function is public knowledge in this work.",
    "A liquor license was granted under the general terms of the city.",
    "This program of music is free and open to the public.",
    "Creative people use the commons for work and play.",
    "Their license to operate was withdrawn in the year 2004.",
    "The restaurant was licensed under a new owner.",
    "Under the terms of the contract the work ends in May.",
    "No part of the road may be used without written permission.",
    "The foundation published a free general guide.",
    "The library in the old town is open to the public until eight.",
    "An eclipse of the sun was seen by all in this version of the story.",
    "The boost to the general economy was distributed with care.",
    "In law the author has rights to the work and may waive them.",
    "He was free to redistribute the charge among the other persons.",
    "Mozilla and the foundation released a new file format this year.",
    "The software was made available to any person for a fee.",
    "Subject to the following conditions, the source of the river may be altered.",
    "the of and to in is that it for on was with as at by",
    "this are be from or an not have has had were which their",
    "der die und den von zu das ist nicht ein mit auf",
    "de la le et les des que un du une dans pour",
    "el los y las del se por con una su para al",
)

#: Words that any text has: they weigh little, whoever uses them.
COMMON = frozenset(
    "a above all an and any anyone are as at be by can code copy copies each either except file files find for form forms found free from fee general has have"
    " https if in including into is it later law legal library list made materials may must new no not of on one option or other part permission person possible"
    " project provided public purpose related rights see software source subject that the their this to under use used v version was which who with without work"
    " you your 1 2 3".split()
)

WORD = r"[^a-z0-9.+-]+"
NONE = "none"


@dataclass(frozen=True)
class LicenseParams:
    copies: int = 10
    steps: int = 250
    folds: int = 4
    #: calibration: share of held-out prose that may pass as a family
    false_alarms: float = 0.01
    least_probability: float = 0.5
    #: share of a template's words, by number and by weight, that confirms a family
    containment: float = 0.6
    #: lines of a window of a long block
    window: int = 16
    seed: int = 5


@dataclass(frozen=True)
class LicenseModel:
    classes: tuple[str, ...]
    weights: dict[str, list[float]]
    bias: list[float]
    threshold: float


def tokens(text: str) -> list[str]:
    """Words of a paragraph, as the Column form in ``paragraph_words``."""
    return [w for w in (x.strip(".+-") for x in re.split(WORD, text.lower())) if w]


def grams(ws: list[str]) -> set[str]:
    return {*ws, *(f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False))}


@lru_cache(maxsize=4)
def fit(p: LicenseParams, left_out: tuple[str, ...] = ()) -> LicenseModel:
    """Fit on the built-in notices (but those left out) and calibrate; the same on every machine."""
    rng = np.random.default_rng(p.seed)
    classes = (*sorted(TEMPLATES), NONE)
    none, plain = classes.index(NONE), [w for t in PROSE for w in tokens(t)]

    def variants(text: str, n: int) -> list[set[str]]:
        ws, out = tokens(text), [grams(tokens(text))]
        for _ in range(n):
            keep = rng.random(len(ws)) > rng.uniform(0, 0.3)
            out.append(grams([w for w, k in zip(ws, keep, strict=True) if k]))
        return out

    sources = [(t, classes.index(c)) for c in classes[:-1] for t in TEMPLATES[c] if t not in left_out]
    sources += [(t, none) for t in PROSE]
    data = [(v, c, k % p.folds) for k, (t, c) in enumerate(sources) for v in variants(t, p.copies)]
    data += [(grams(list(rng.choice(plain, int(rng.integers(3, 60))))), none, k % p.folds) for k in range(300)]
    seen: dict[str, int] = {}
    for v, _, _ in data:
        for g in v:
            seen[g] = seen.get(g, 0) + 1
    names = sorted(g for g, n in seen.items() if n >= 3)
    at = {g: i for i, g in enumerate(names)}
    x = np.zeros((len(data), len(names)), np.float32)
    for i, (v, _, _) in enumerate(data):
        x[i, [at[g] for g in v if g in at]] = 1
    label, fold = np.array([c for _, c, _ in data]), np.array([f for _, _, f in data])
    y = np.eye(len(classes), dtype=np.float32)[label]

    def soft(rows: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
        z = rows @ w + b
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def trained(own: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
        share = (1 / y[own].sum(0).clip(1))[label[own]][:, None]
        share /= share.sum()
        w, b = np.zeros((len(names), len(classes)), np.float32), np.zeros(len(classes), np.float32)
        sw, sb = np.full_like(w, 1e-8), np.full_like(b, 1e-8)
        rows, target = x[own], y[own]
        for _ in range(steps):
            d = (soft(rows, w, b) - target) * share
            gw, gb = rows.T @ d + 3e-5 * w, d.sum(0)
            sw += gw**2
            sb += gb**2
            w -= 0.2 * gw / np.sqrt(sw)
            b -= 0.2 * gb / np.sqrt(sb)
        return w, b

    alarms = []
    for f in range(p.folds):
        held = (fold == f) & (label == none)
        alarms.append(soft(x[held], *trained(fold != f, p.steps // 2))[:, :none].max(1))
    threshold = max(p.least_probability, float(np.quantile(np.concatenate(alarms), 1 - p.false_alarms)))
    w, b = trained(fold >= 0, p.steps)
    weights = {g: [round(float(v), 4) for v in w[i]] for g, i in at.items() if np.abs(w[i]).max() > 0.02}
    return LicenseModel(classes, weights, [round(float(v), 4) for v in b], round(threshold, 4))


@lru_cache(maxsize=1)
def word_weights() -> dict[str, float]:
    """Weight of each template word: the fewer families (prose is one) use it, the more; common words count a tenth."""
    users: dict[str, set[str]] = {}
    for family, texts in (*TEMPLATES.items(), (NONE, PROSE)):
        for t in texts:
            for w in tokens(t):
                users.setdefault(w, set()).add(family)
    return {w: round(log((len(TEMPLATES) + 2) / len(f)) * (0.1 if w in COMMON else 1), 4) for w, f in users.items()}


def template_words(text: str) -> list[tuple[str, float]]:
    """Distinct words of a template with their shares of its weight."""
    ws, known = [*dict.fromkeys(tokens(text))], word_weights()
    total = sum(known[w] for w in ws)
    return [(w, known[w] / total) for w in ws]


def gate_words(p: LicenseParams) -> list[str]:
    """Words of which every paragraph that a template can confirm has one: the heaviest of each
    template, until the others together are too light.
    """
    out: set[str] = set()
    for texts in TEMPLATES.values():
        for ws in map(template_words, texts):
            rest = 1.0
            for w, share in sorted(ws, key=lambda x: (-x[1], x[0])):
                if rest < p.containment - 1e-9:
                    break
                out.add(w)
                rest -= share
    return sorted(out)


def one_of(ws: list[str]) -> str:
    """A pattern for any of these words as a whole, as a trie, so that a place is looked at once."""

    def node(rest: list[str]) -> str:
        by: dict[str, list[str]] = {}
        for w in rest:
            if w:
                by.setdefault(w[0], []).append(w[1:])
        if not by:
            return ""
        inner = "|".join(re.escape(c) + node(own) for c, own in sorted(by.items()))
        return f"(?:{inner})" + ("?" if "" in rest else "")

    return r"(?<![a-z0-9])" + node(ws) + r"(?![a-z0-9])"


def paragraph_words(line: Column) -> Column:
    return F.filter(F.transform(F.split(F.lower(line), WORD), lambda w: F.regexp_replace(w, r"^[.+-]+|[.+-]+$", "")), lambda w: w != "")


def scan(docs: DataFrame, params: LicenseParams | None = None, model: LicenseModel | None = None) -> DataFrame:
    """Licence notices of each row of ``docs`` (doc_id, text).

    Returns doc_id, n_paragraphs (lines with a word), n_candidates (lines with a gate
    word), n_unknown (candidates that no notice covers), notices (array of struct line
    and last, the first line and the one after, family, probability, containment), families
    (distinct, sorted).
    """
    p = params or LicenseParams()
    m = model or fit(p)
    table = F.from_json(F.lit(json.dumps(m.weights)), "map<string,array<double>>")
    shapes = [{"f": i, "w": [{"w": w, "v": round(v, 6)} for w, v in template_words(t)]} for i, f in enumerate(m.classes[:-1]) for t in TEMPLATES[f]]
    templates = F.from_json(F.lit(json.dumps(shapes)), "array<struct<f:int,w:array<struct<w:string,v:double>>>>")
    known = sorted(m.weights)
    n_families = len(m.classes) - 1

    def judge(x: Column) -> Column:
        """x: struct s (text), i (first line), z (the line after)."""

        def scored(ws: Column, all_: Column) -> Column:
            pairs = F.transform(F.slice(all_, 1, F.greatest(F.size(all_) - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", w, F.get(all_, i + 1)))
            z = F.aggregate(
                F.filter(F.array_distinct(F.concat(all_, pairs)), lambda g: g.isin(*known)),
                F.array(*[F.lit(v) for v in m.bias]),
                lambda a, g: F.zip_with(a, F.element_at(table, g), lambda s, v: s + v),
            )
            soft = bind(z, lambda s: bind(F.transform(s, lambda v: F.exp(v - F.array_max(s))), lambda e: bind(F.aggregate(e, F.lit(0.0), lambda a, t: a + t), lambda n: F.transform(e, lambda v: v / n))))

            def confirmed(pr: Column, best: Column) -> Column:
                share = lambda t, own: F.least(F.aggregate(own, F.lit(0.0), lambda a, w: a + w["v"]), F.size(own) / F.size(t["w"]))
                held = lambda t: bind(F.filter(t["w"], lambda w: F.array_contains(ws, w["w"])), lambda own: share(t, own))
                most = F.coalesce(F.array_max(F.transform(F.filter(templates, lambda t: t["f"] == best), held)), F.lit(0.0))
                return bind(
                    F.when((best < n_families) & (F.array_max(pr) >= m.threshold), most).otherwise(F.lit(0.0)),
                    lambda c: F.struct(
                        x["i"].cast("int").alias("line"), x["z"].cast("int").alias("last"),
                        F.when(c >= p.containment - 1e-6, F.element_at(F.array(*[F.lit(f) for f in m.classes]), best + 1)).alias("family"),
                        F.round(F.array_max(pr), 4).alias("probability"), F.round(c, 4).alias("containment"),
                    ),
                )

            return bind(soft, lambda pr: bind((F.array_position(pr, F.array_max(pr)) - 1).cast("int"), lambda best: confirmed(pr, best)))

        return bind(paragraph_words(x["s"]), lambda all_: bind(F.array_distinct(all_), lambda ws: scored(ws, all_)))

    gate = one_of(gate_words(p))
    blank = ~F.col("_t").rlike(gate)
    kind = "array<struct<line:int,last:int,family:string,probability:double,containment:double>>"
    none = F.array().cast(kind)

    def blocks(ls: Column) -> Column:
        """struct s, i, z of the windows of blocks of several lines."""

        def between(gaps: Column) -> Column:
            starts = F.concat(F.array(F.lit(0)), F.transform(gaps, lambda i: i + 1))
            runs = F.filter(F.zip_with(starts, F.concat(gaps, F.array(F.size(ls))), lambda a, z: F.struct(a.alias("i"), z.alias("z"))), lambda r: r["z"] - r["i"] > 1)
            step = max(1, p.window // 2)
            parts = F.flatten(F.transform(runs, lambda r: F.transform(
                F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((r["z"] - r["i"] - p.window) / step)).cast("int")),
                lambda k: F.struct((r["i"] + k * step).cast("int").alias("i"), F.least(r["z"], r["i"] + k * step + p.window).cast("int").alias("z")),
            )))
            return F.transform(parts, lambda r: F.struct(F.concat_ws(" ", F.slice(ls, r["i"] + 1, r["z"] - r["i"])).alias("s"), r["i"].alias("i"), r["z"].alias("z")))

        return bind(F.filter(F.transform(ls, lambda s, i: F.when(~s.rlike(r"[^\x20\x09-\x0D]"), i)), lambda i: i.isNotNull()), between)

    def found(ls: Column) -> Column:
        singles = F.filter(F.transform(ls, lambda s, i: F.struct(s.alias("s"), i.alias("i"), (i + 1).alias("z"))), lambda x: x["s"].rlike(gate))
        judged = lambda xs: F.filter(F.transform(xs, judge), lambda n: n["family"].isNotNull())
        covered = lambda own, n: F.exists(own, lambda y: (y["line"] < n["last"]) & (n["line"] < y["last"]) & (y["family"] == n["family"]))

        def with_blocks(own: Column) -> Column:
            wide = judged(F.filter(blocks(ls), lambda x: x["s"].rlike(gate)))
            return F.aggregate(wide, own, lambda acc, n: F.when(covered(acc, n), acc).otherwise(F.concat(acc, F.array(n))))

        return bind(singles, lambda xs: bind(judged(xs), lambda own: F.struct(with_blocks(own).alias("n"), F.transform(xs, lambda x: x["i"]).alias("c"))))

    df = docs.select("doc_id", F.lower(F.coalesce(F.col("text"), F.lit(""))).alias("_t"))
    lines = F.split("_t", "\n")
    df = df.select(
        "doc_id", F.size(F.filter(lines, lambda s: s.rlike(r"[^\x20\x09-\x0D]"))).cast("long").alias("n_paragraphs"),
        F.when(blank, F.struct(none.alias("n"), F.array().cast("array<int>").alias("c"))).otherwise(bind(lines, found)).alias("_f"),
    )
    notices = F.array_sort(F.col("_f.n"))
    return df.select(
        "doc_id",
        "n_paragraphs",
        F.size("_f.c").cast("long").alias("n_candidates"),
        F.size(F.filter("_f.c", lambda i: ~F.exists("_f.n", lambda n: (n["line"] <= i) & (i < n["last"])))).cast("long").alias("n_unknown"),
        notices.alias("notices"),
        F.array_sort(F.array_distinct(F.transform(notices, lambda x: x["family"]))).alias("families"),
    )
