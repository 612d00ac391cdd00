"""Licence scans: a trained paragraph classifier, confirmed against templates, as SQL expressions inside the row.

A multinomial logistic regression over the set of a paragraph's word n-grams (one and two words) tells licence
families, "unknown" (notices of other licences) and "none" apart. Its weights are sparse. A temperature, fitted on
held-out paragraphs, calibrates its probabilities, and a threshold, chosen there for a wanted precision, turns a less
sure family into "unknown"; the held-out paragraphs hold notices of licences that training never saw. A prediction
counts as confirmed if the paragraph holds a large share of some template of its family, in word triples.

Where the bias favours "none", as it does for the trained model, only paragraphs with an anchor are scored: the n-grams
that favour a licence and are no anchors do not outweigh the bias even all together, so nothing is lost.

The training paragraphs are written from the templates below and from neutral sentences by a seeded generator; the fit
runs on the driver over that bounded set. A null or empty text has no paragraphs and licence "none"; a paragraph is a
line, of any length; of equally sure ones the first counts; repeated rows give repeated results; extra columns pass
through, and those named like the new ones are replaced.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentweave.llm.common import unused

#: Usual notices of licence families, as their publishers word them.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "cc": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under the Creative Commons Attribution-ShareAlike License, CC BY-SA 4.0.",
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-NC 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "gpl": (
        "This program is free software under the GNU General Public License, version 3.",
        "This work is licensed under the GNU General Public License, version 2.",
        "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "lgpl": (
        "This library is distributed under the GNU Lesser General Public License, version 2.1.",
        "You can redistribute this library under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Distributed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
}
#: Notices of licences of no family above. The last HELD_OTHERS are for calibration alone.
OTHERS = (
    "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice appear in all copies.",
    "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Licensed under the European Union Public Licence, version 1.2.",
    "This package is free software under the terms of the Artistic License 2.0.",
    "This is free and unencumbered software released into the public domain.",
    "Copyright the authors. All rights reserved.",
    "All rights reserved. No part of this work may be reproduced without written permission of the publisher.",
    "The code is governed by a license that can be found in the LICENSE file.",
    "SPDX-License-Identifier: ISC",
    "SPDX-License-Identifier: Zlib",
    "Distributed under the Boost Software License, Version 1.0.",
    "This program is made available under the terms of the Eclipse Public License 2.0.",
    "SPDX-License-Identifier: EUPL-1.2",
    "Released under the Open Software License.",
)
HELD_OTHERS = 4
#: Notices under made-up names {n} and versions {v}: the usual phrases alone tell no family.
NAMELESS = (
    "Released under the {n} License.",
    "Licensed under the {n} License, Version {v}.",
    "This work is licensed under the {n} License, version {v}.",
    "Distributed under the {n} Public License, version {v}.",
    "This program is made available under the terms of the {n} Public License {v}.",
    "SPDX-License-Identifier: {n}-{v}",
)
NEUTRAL = (
    "The driver showed his license at the gate and the guard let him in",
    "You need a fishing licence from the public office before the season",
    "Version two of the report was released under pressure from the public",
    "The software is free for students of the general course",
    "Permission to enter was granted by the person in charge",
    "Copies of the documentation are in the library of the foundation",
    "The following conditions were met with or without the help of others",
    "Her work is known at many places and she was given a prize",
    "We use this file to note the terms of the contract",
    "The apache people lived in the south west",
    "MIT is a university with a large campus",
    "The GNU project and the Mozilla browser are known to many",
    "Er kam mit dem Zug und ging mit ihr nach Hause",
    "Mit der Zeit wurde das Haus mit Holz und Stein gebaut",
    "Ein Brief mit Bildern liegt mit dem Buch im Schrank",
    "Elle est venue par le train de la ville et non en voiture",
    "No se puede entrar por la puerta de la casa",
)
#: Words that tell nothing, which fill the written paragraphs of all kinds alike.
FILLERS = "the and of to in a is that with for it as on be this are by or not from any may you use can at an was all we mit".split()
FAMILIES = ("none", *sorted(TEMPLATES), "unknown")
#: Paragraphs written, the generator's seed, wanted precision, and the share of a template that confirms.
MADE, SEED, PRECISION, CONFIRM = 4000, 7, 0.99, 0.5
_WORD = r"[a-z0-9][a-z0-9.+-]*"


def grams_of(text: str) -> list[str]:
    w = [x.rstrip(".-") for x in re.findall(_WORD, text.lower())]
    return sorted({*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))} - {""})


@dataclass(frozen=True)
class Classifier:
    weights: tuple[tuple[str, tuple[float, ...]], ...]  # by n-gram, of each family
    bias: tuple[float, ...]
    threshold: float


def _paragraphs(n: int, seed: int) -> list[tuple[str, int, bool]]:
    """(paragraph, family's number, held out) from a seeded generator. A quarter is held out, and with it all notices of
    licences that training never sees."""
    rng = random.Random(seed)
    syllables = ("the", "and", "an", "re", "th", "ion", "mo", "la", "vi", "of", "sto", "el", "dun", "to")
    word = lambda: rng.choice(FILLERS) if rng.random() < 0.6 else "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    filler = lambda k: [word() for _ in range(rng.randint(0, k))]
    out = []
    last = len(FAMILIES) - 1
    for i in range(n):
        y, held = i % (2 * len(FAMILIES)), i % 4 == 3
        if 0 < y <= last:
            own = TEMPLATES[FAMILIES[y]] if y < last else OTHERS[-HELD_OTHERS:] if held and rng.random() < 0.5 else OTHERS[:-HELD_OTHERS]
            text = own[i // (2 * len(FAMILIES)) % len(own)]
            if y == last and rng.random() < 0.5:
                name = " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))).capitalize() for _ in range(rng.randint(1, 3)))
                text = rng.choice(NAMELESS).format(n=name, v=f"{rng.randint(1, 4)}.{rng.randint(0, 1)}")
            words = text.split()
            # Some are cut short, most lose a word here and there.
            if len(words) > 12 and rng.random() < 0.3:
                start = rng.randint(0, len(words) - 10)
                words = words[start : start + rng.randint(10, len(words))]
            loss = rng.choice((0, 0.05, 0.1))
            words = [w for w in words if len(words) < 3 or rng.random() > loss]
            out.append((" ".join(filler(6) + words + filler(6)), y, held))
        else:
            words = rng.choice(NEUTRAL).split() if rng.random() < 0.6 else []
            words = [w for w in words if rng.random() > 0.1]
            out.append((" ".join(filler(20) + words + filler(20)), 0, held))
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@lru_cache(maxsize=2)
def train(made: int = MADE, seed: int = SEED, penalty: float = 2e-4) -> Classifier:
    """Proximal gradient with momentum on the multinomial likelihood with an L1 penalty, then a temperature and a
    threshold from the held-out paragraphs."""
    rows = _paragraphs(made, seed)
    held = np.array([h for *_, h in rows])
    number: dict[str, int] = {}
    for text, _, h in rows:
        for g in grams_of(text) if not h else ():
            number.setdefault(g, len(number))
    x = np.zeros((len(rows), len(number)), np.float32)
    for i, (text, *_) in enumerate(rows):
        x[i, [number[g] for g in grams_of(text) if g in number]] = 1
    keep = (x[~held] > 0).sum(0) >= 5
    names = [g for g, k in zip(number, keep, strict=True) if k]
    x = x[:, keep]
    y = np.eye(len(FAMILIES), dtype=np.float32)[[k for _, k, _ in rows]]
    w, b, v = np.zeros((x.shape[1], len(FAMILIES)), np.float32), np.zeros(len(FAMILIES), np.float32), 0
    own, truth, step = x[~held], y[~held], 0.5
    for _ in range(400):
        miss = _softmax(own @ w + b) - truth
        v = 0.9 * v - step * (own.T @ miss) / len(own)
        w = w + v
        w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)
        b = b - step * miss.mean(0)
    # The temperature under which held-out labels are likeliest.
    z, labels = (x[held] @ w + b).astype(float), y[held].argmax(1)
    heat = min(np.linspace(0.3, 4, 75), key=lambda t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(z)), labels], 1e-12)).mean())
    w, b = w / heat, b / heat
    p = _softmax(z / heat)
    best, sure = p.argmax(1), p.max(1)
    named = (best > 0) & (best < len(FAMILIES) - 1)
    threshold = 0.5
    for c in sorted(set(sure[named].tolist()), reverse=True):
        chosen = named & (sure >= c)
        if (best == labels)[chosen].mean() < PRECISION:
            threshold = max(threshold, float(np.nextafter(c, 1)))
            break
    some = np.flatnonzero((np.abs(w) > 1e-3).any(1))
    weights = tuple((names[i], tuple(round(float(z), 5) for z in w[i])) for i in sorted(some, key=lambda i: names[i]))
    return Classifier(weights, tuple(round(float(z), 5) for z in b), float(threshold))


@lru_cache(maxsize=2)
def anchors(model: Classifier) -> list[str]:
    """N-grams of which a paragraph needs one to be taken for a licence, where the bias favours "none".

    All others that favour a licence are light: even together they do not outweigh the bias, whichever the family. Those
    that are frequent in written neutral paragraphs for their weight are light first, so that few paragraphs have an
    anchor. A paragraph's n-grams count once each, so this loses nothing.
    """
    plain: dict[str, int] = {}
    for text, y, _ in _paragraphs(MADE, SEED):
        for g in grams_of(text) if not y else ():
            plain[g] = plain.get(g, 0) + 1
    margins = {g: np.maximum(np.array(z[1:]) - z[0], 0) for g, z in model.weights}
    gap, light = np.array(model.bias[0]) - np.array(model.bias[1:]) - 1e-4, np.zeros(len(model.bias) - 1)
    out = []
    for g in sorted((g for g, m in margins.items() if m.max() > 0), key=lambda g: (margins[g].max() / (1 + plain.get(g, 0)), g)):
        if (light + margins[g] <= gap).all():
            light += margins[g]
        else:
            out.append(g)
    return sorted(out)


def _gate(model: Classifier) -> str:
    """A pattern that every lower-cased paragraph that can be a licence matches."""
    if max(model.bias[1:]) > model.bias[0]:
        return ""
    tree: dict = {}
    for g in anchors(model):
        at = tree
        for c in g:
            at = at.setdefault(c, {})
        at[""] = {}

    def of(at: dict) -> str:
        own = [{" ": "[^a-z0-9]+", ".": "[.]", "+": "[+]"}.get(c, c) + of(below) for c, below in at.items() if c]
        return ("(?:" + "|".join(own) + ")" + ("?" if "" in at else "")) if own else ""

    return f"(?<![a-z0-9]){of(tree)}(?![a-z0-9])" if tree else "(?!)"


def scan(df: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """df with `licenses`: (paragraph, family, probability, overlap, confirmed) of each paragraph that is predicted to
    be a licence or unknown, in order, and `license`: the family of the surest confirmed one, else "unknown" if a
    paragraph is suspected, else "none"."""
    gate, p = _gate(model), unused(df, "_p")
    n = len(FAMILIES)
    table = "map(" + ", ".join(f"'{g}', array({', '.join(f'{z!r}D' for z in zs)})" for g, zs in model.weights) + ")" if model.weights else "cast(map() as map<string, array<double>>)"
    # A template of two words is its pair, which is among a paragraph's n-grams.
    shingles = lambda s: sorted({" ".join(w[i : i + 3]) for w in [[x.rstrip(".-") for x in re.findall(_WORD, s.lower())]] for i in range(max(1, len(w) - 2))})
    templates = "array(" + ", ".join(f"named_struct('family', '{f}', 'parts', array({', '.join(repr(x) for x in shingles(t))}))" for f, ts in sorted(TEMPLATES.items()) for t in ts) + ")"
    body = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn(p, F.when(F.lower(body).rlike(gate), F.expr(f"filter(transform(split({text}, '\\n'), (x, i) -> struct(i as paragraph, x as body)), s -> lower(s.body) rlike {_literal(gate)})")).otherwise(F.expr("cast(array() as array<struct<paragraph:int,body:string>>)")))
    words = f"transform(regexp_extract_all(lower(s.body), '{_WORD}', 0), w -> regexp_replace(w, '[.-]+$', ''))"
    df = df.withColumn(p, F.expr(f"transform({p}, s -> struct(s.paragraph as paragraph, {words} as w))"))
    pairs = "if(size(s.w) > 1, transform(sequence(0, size(s.w) - 2), i -> concat_ws(' ', s.w[i], s.w[i + 1])), cast(array() as array<string>))"
    triples = "if(size(s.w) > 2, array_distinct(transform(sequence(0, size(s.w) - 3), i -> concat_ws(' ', s.w[i], s.w[i + 1], s.w[i + 2]))), cast(array() as array<string>))"
    df = df.withColumn(p, F.expr(f"transform({p}, s -> struct(s.paragraph as paragraph, array_distinct(concat(s.w, {pairs})) as grams, concat({pairs}, {triples}) as triples))"))
    start = "array(" + ", ".join(f"{z!r}D" for z in model.bias) + ")"
    known = ", ".join(f"'{g}'" for g, _ in model.weights) or "null"
    # Most n-grams have no weight; the test by hash spares them the search in the map.
    margins = f"aggregate(filter(s.grams, g -> g in ({known})), {start}, (a, g) -> coalesce(zip_with(a, try_element_at({table}, g), (x, y) -> x + y), a))"
    # The weights and templates are constants inside the expressions, not columns that every row would carry.
    df = df.withColumn(p, F.expr(f"transform({p}, s -> struct(s.paragraph as paragraph, s.triples as triples, {margins} as z))"))
    families = "array(" + ", ".join(f"'{f}'" for f in FAMILIES) + ")"
    total = " + ".join(f"exp(s.z[{i}] - array_max(s.z))" for i in range(n))
    df = df.withColumn(p, F.expr(f"transform({p}, s -> struct(s.paragraph as paragraph, s.triples as triples, {families}[array_position(s.z, array_max(s.z)) - 1] as family, 1D / ({total}) as probability))"))
    share = f"coalesce(array_max(transform(filter({templates}, t -> t.family = s.family), t -> size(array_intersect(t.parts, s.triples)) / size(t.parts))), 0D)"
    df = df.withColumn(p, F.expr(f"transform(filter({p}, s -> s.family <> 'none'), s -> struct(s.paragraph as paragraph, s.family as family, s.probability as probability, {share} as overlap))"))
    sure = f"(s.family <> 'unknown' and s.probability >= {model.threshold!r}D)"
    df = df.withColumn("licenses", F.expr(f"transform({p}, s -> struct(s.paragraph as paragraph, if({sure}, s.family, 'unknown') as family, round(s.probability, 6) as probability, round(s.overlap, 6) as overlap, {sure} and s.overlap >= {CONFIRM}D as confirmed))"))
    best = "array_sort(transform(filter(licenses, s -> s.confirmed), s -> struct(-s.probability as p, s.paragraph as paragraph, s.family as family)))"
    return df.withColumn("license", F.expr(f"coalesce(get({best}, 0).family, if(size(licenses) > 0, 'unknown', 'none'))")).drop(p)


def _literal(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"
