"""Licence scans: a logistic regression over sparse word n-grams of a paragraph says whether it holds a licence notice and of which
families; what it predicts must be confirmed by the family's templates. Notices of no known family are a class of their own, calibrated
on families that were left out."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.functions.hashing import finalise
from tallyflow.llm.common import text_chunks

# How licences are called, and what their own texts open with.
NAMES: dict[str, tuple[str, ...]] = {
    "MIT": ("MIT License", "MIT Licence", "License: MIT", "License-Identifier: MIT", "under MIT", "MIT terms"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache 2.0 License", "Apache Software License 2.0"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3", "GNU GPL version 3", "GPL-3.0", "GPL v3", "GPLv3"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2", "GNU GPL version 2", "GPL-2.0", "GPL v2", "GPLv2"),
    "LGPL": ("GNU Lesser General Public License", "GNU Library General Public License", "GNU LGPL", "LGPL-2.1", "LGPL-3.0", "LGPLv3"),
    "AGPL-3.0": ("GNU Affero General Public License", "Affero General Public License, version 3", "GNU AGPL", "AGPL-3.0", "AGPLv3"),
    "BSD": ("BSD 3-Clause License", "BSD 2-Clause License", "BSD-style license", "BSD License", "BSD-3-Clause", "BSD-2-Clause"),
    "MPL-2.0": ("Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "Mozilla Public License, Version 2.0", "MPL-2.0", "MPL 2.0"),
    "CC-BY": ("CC BY 4.0", "CC BY 3.0", "CC-BY", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 3.0", "Creative Commons Attribution License"),
    "CC-BY-SA": ("CC BY-SA 4.0", "CC BY-SA 3.0", "CC-BY-SA", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike 3.0", "Creative Commons Attribution-Share Alike License"),
    "CC-BY-NC": ("CC BY-NC 4.0", "CC BY-NC 3.0", "CC-BY-NC", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial 3.0", "Creative Commons Attribution-Non Commercial License"),
    "CC0": ("CC0 1.0", "CC0-1.0", "CC0", "Creative Commons Zero", "CC0 1.0 Universal Public Domain Dedication"),
    "ISC": ("ISC License", "ISC Licence", "License-Identifier: ISC", "under ISC", "Internet Systems Consortium License"),
    "Unlicense": ("The Unlicense", "Unlicense", "License-Identifier: Unlicense", "the Unlicense terms"),
    "Proprietary": ("All rights reserved", "Proprietary and confidential", "proprietary license agreement", "without the prior written permission of the publisher"),
}
BODIES: dict[str, tuple[str, ...]] = {
    "MIT": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    "Apache-2.0": ("you may not use this file except in compliance with the License. You may obtain a copy of the License at", "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    "GPL-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version",),
    "GPL-2.0": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version",),
    "LGPL": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",),
    "AGPL-3.0": ("under the terms of the GNU Affero General Public License as published by the Free Software Foundation",),
    "BSD": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License. If a copy of the MPL was not distributed with this file, You can obtain one at",),
    "CC0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",),
    "Unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",),
    "Proprietary": ("No part of this publication may be reproduced, distributed, or transmitted in any form without the prior written permission of the publisher", "Unauthorized copying of this file, via any medium, is strictly prohibited"),
}
#: What stands around a name.
FRAMES = (
    "Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.", "This work is licensed under a {}.", "{}", "License: {}", "SPDX-License-Identifier: {}", "Distributed under the terms of the {}.",
    "This project is covered by the {}.", "Available under {}.", "The code is published under the {}; see LICENSE.", "Licensed to you under the {} (the \"License\").", "Made available under the terms of {}.", "This software is provided under {}.",
    "Copyright 2019 the authors, {}.", "All files here are under the {}.", "{}, see the file LICENSE for details.", "Subject to the terms of the {}.",
)
#: Words that names of made-up licences are put together from, beside made-up words.
MIDDLE = ("Community", "Source", "Public", "Software", "Open", "Free", "Data", "Shared", "Permissive", "Artistic", "Software Development", "Source Available")
#: Sentences with the same words that are no notices; {} is a made-up word.
NOTHING = (
    "She renewed her driving license in May and drove under the bridge.", "She is licensed for driving buses.", "He is licensed to practise medicine in two states.", "A licensed electrician must check the {}.", "The pub lost its license after the fire.",
    "The license fee for the {} rose last year.", "The version was released in spring; the work is about public health.", "General questions are answered by the foundation, which is free to the public.", "The prisoner was released under strict terms.",
    "The apache helicopter flew over the GNU herd.", "MIT opened a new building for its students this year.", "The copy of the book was modified and reproduced by hand.", "In this section the following conditions are met by the source.", "A fishing license is required under the {} act.",
    "The of and to in a is that it for on was be with at by from.", "He was granted permission to use the hall and distribute leaflets.", "The public domain of the map is the set of its arguments.", "No part of the bridge may be closed without notice.", "The film was released in {} and covered by the press.",
    "Attribution of the poem to the school is doubtful; the rights were sold in 1900.", "A free person may use and modify any form that the law permits.", "The software of the {} is version 2.0 and was published in June.", "All files here are under the desk.", "The project is covered by the local paper.",
    "Poetic license allows the {} to rhyme.", "They work under the terms of the treaty.", "The right to vote is reserved for members.", "Creative people share common goals.", "The course on general public speaking has version 3 of its notes.", "Available under the counter at the {} shop.",
    "Terms of trade got worse under the {} government.", "This work is about the {} and its source.", "The copyright office moved to {}.", "Licensed trade in {} grew by 3 percent.", "The dog license and the marriage license are issued here.",
    "Repairs are covered by the warranty of the {}.", "The terms of the contract are set by law.", "The costs were covered by the insurance.", "By the terms of the truce both sides withdrew.", "The {} is subject to local rules and terms.", "The floor was covered by the {}.",
    "The album was released under another label.", "The {} was released under guard.", "A later version of the play was sold under the title {}.", "The song was sung under a false flag.",
    "The terms of the peace were read aloud by the {}.", "The terms of the sale are known to the buyers.", "The works are distributed over four rooms.", "The food is distributed among the {}.", "Tickets are made available to all {}.", "Copies of the letter were sent to the {}.", "The file of the case is available to the judge.",
    "The commons of the village is a meadow.", "Creative writing is taught in the {} school.", "The work is hard and the pay is low.", "The work of the {} is shown in the hall.", "A copy of the key was made for the {}.",
    "Food was made available under a tent.", "Papers were distributed under the {} of the school.", "The rooms are provided under contract.", "The list is published under the heading of the {}.", "Long-term terms are agreed by the {} and the court.",
)
UNKNOWN = "unknown"
NOISE = "alpha river stone with and the of was said green over light paper ever more than walk tree sound line free public use work software version source terms".split()
COMMON = "the of and to in a is that it for on was be with at by from as are or an not this you all when he she they which their has have its but were one can been may any if than then so these under here there".split()

#: Words of a window, moved on by half; a paragraph is seen through windows of all these widths, whole however long.
WIDTHS = (6, 12, 24, 48)
#: Made-up examples of each thing that is said; epochs; groups of families left out in turn.
COPIES, EPOCHS, RATE, GROUPS = 4, 80, 0.2, 3
#: How much more an example of no notice counts, as most text is none.
PLAIN = 8
#: Examples that must hold an n-gram for it to be a feature.
LEAST = 4
#: Share of text of no family that may be named one, share of plain text that may be called a notice.
FALSE_FAMILY, FALSE_NOTICE = 0.01, 0.004
#: The least calibrated probability of a notice of no known family.
SURE = 0.75
#: Share of plain text that may be looked at for the templates of known families.
LOOK = 0.02
#: Share of a body's word triples that must stand in the text.
CONFIRM = 0.4

_PLAIN_WORDS = {w.encode() for w in COMMON}
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 else 10 if c == 10 else 32 for c in range(256))
_STEP = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_TABLE = 20


def word_list(text: str) -> list[bytes]:
    return text.encode().translate(_LETTERS).split()


def _hash(tokens: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(t) for t in tokens], np.uint64)


def grams(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the one, two and three words from each word on, beyond the end too (there they mean nothing); 0 for what was so one or two
    words before, as runs of a word say no more than the word."""
    with np.errstate(over="ignore"):
        second = finalise(h * _STEP[0] + np.r_[h[1:], h[:1]])
        out = h.copy(), second, finalise(second * _STEP[1] + np.r_[h[2:], h[:2]])
    for g in out:
        again = np.zeros(len(g), bool)
        again[1:] = g[1:] == g[:-1]
        again[2:] |= g[2:] == g[:-2]
        g[again] = 0
    return out


def all_grams(h: np.ndarray) -> np.ndarray:
    one, two, three = grams(h)
    return np.concatenate([one, two[: max(0, len(h) - 1)], three[: max(0, len(h) - 2)]])


@dataclass(frozen=True)
class Classifier:
    """weights: a row for each known n-gram, a column for each family and one for any notice. limits: of families, of notices
    of no known family, and of what may hold a notice of a known one, for which its templates speak too.
    curve: slope and shift that make a notice's logit a calibrated one."""

    keys: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    limits: tuple[float, float, float] = (0.5, 0.5, 0.5)
    curve: tuple[float, float] = (1.0, 0.0)

    @functools.cached_property
    def table(self) -> np.ndarray:
        out = np.zeros(1 << _TABLE, bool)
        out[(self.keys >> np.uint64(64 - _TABLE)).astype(np.int64)] = True
        return out

    def rows(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions of known n-grams, their rows)."""
        at = np.flatnonzero(self.table[(g >> np.uint64(64 - _TABLE)).astype(np.int64)])
        row = np.minimum(np.searchsorted(self.keys, g[at]), len(self.keys) - 1)
        known = self.keys[row] == g[at]
        return at[known], row[known]

    def logits(self, h: np.ndarray) -> np.ndarray:
        g = all_grams(h)
        return self.weights[self.rows(g)[1]].sum(axis=0) / np.sqrt(max(1, len(g))) + self.bias

    def notice(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] * z + self.curve[1], -50, 50)))


def _made_up(rng: np.random.Generator) -> str:
    return "".join(str(x) for x in rng.choice("ba co di fu ge ho ki lo mu ne pi qua ro su ta ve wi xo yz zar frob bol ler".split(), rng.integers(2, 4))).capitalize()


def _unknown_name(rng: np.random.Generator) -> str:
    words = [_made_up(rng) for _ in range(rng.integers(1, 3))] + [str(x) for x in rng.choice(MIDDLE, rng.integers(0, 3), replace=False)]
    tail = ["License", "Licence", "License Agreement", "Public License"][rng.integers(0, 4)]
    return " ".join([*words, tail]) + ["", f", version {rng.integers(1, 9)}", f" v{rng.integers(1, 4)}.{rng.integers(0, 3)}", f" - Version {rng.integers(1, 4)}.0"][rng.integers(0, 4)]


def _examples(rng: np.random.Generator, families: tuple[str, ...], frames: tuple[str, ...], copies: int) -> list[tuple[list[bytes], frozenset]]:
    """(words, labels) of made-up windows: notices with words dropped and others before and after, and what is no notice."""
    said: list[tuple[str, frozenset]] = []
    for f in families:
        said += [(frame.format(n), frozenset({f, ""})) for n in NAMES[f] for frame in frames] + [(b, frozenset({f, ""})) for b in BODIES.get(f, ()) for _ in range(copies)]
    for _ in range(len(families) * 20):
        a, b = rng.choice(families, 2, replace=False)
        one, two = rng.choice(NAMES[str(a)]), rng.choice(NAMES[str(b)])
        said.append((frames[rng.integers(0, len(frames))].format(f"{one} or the {two}"), frozenset({str(a), str(b), ""})))
    said += [(frames[rng.integers(0, len(frames))].format(_unknown_name(rng)), frozenset({""})) for _ in range(60 * copies)]
    said += [(x.format(_made_up(rng)), frozenset()) for x in NOTHING for _ in range(2 * copies)]
    said += [(" ".join(rng.choice(NOISE, rng.integers(1, 48))), frozenset()) for _ in range(100 * copies)]
    said += [(" ".join(_made_up(rng) if rng.random() < 0.5 else str(rng.choice(COMMON)) for _ in range(rng.integers(1, 48))), frozenset()) for _ in range(100 * copies)]
    said += [(" ".join(rng.choice([*NOISE, "license", _made_up(rng)], 2).tolist() * int(rng.integers(3, 12))), frozenset()) for _ in range(5 * copies)]
    out = []
    for text, labels in said:
        words = [w for w in word_list(text) if rng.random() > 0.02]
        width = int(rng.choice(WIDTHS))
        if len(words) > width > 12:
            a = int(rng.integers(0, len(words) - width + 1))
            words = words[a : a + width]
        extra = max(0, width - len(words))
        more = [_made_up(rng).lower().encode() if rng.random() < 0.4 else str(rng.choice(NOISE)).encode() for _ in range(int(rng.integers(0, extra + 1)))]
        cut = int(rng.integers(0, len(more) + 1))
        out.append(([*more[:cut], *words, *more[cut:]] or [b"of"], labels))
    return out


def _fit(rows: list[tuple[list[bytes], frozenset]], families: tuple[str, ...], epochs: int = EPOCHS) -> Classifier:
    """Full-batch descent with a step of its own for each weight (Adam); each column is a logistic regression. What few examples hold, as
    made-up words, is no feature, so that words never seen weigh as much here as later; nor is an n-gram of common words alone."""
    names = {w: (x, w in _PLAIN_WORDS) for w in {w for tokens, _ in rows for w in tokens} for x in [xxhash.xxh3_64_intdigest(w)]}
    grams_of, plain = [], []
    for tokens, _ in rows:
        h = np.array([names[w][0] for w in tokens], np.uint64)
        c = np.array([names[w][1] for w in tokens])
        grams_of.append(all_grams(h))
        plain.append(np.concatenate([c, c[:-1] & c[1:], c[:-2] & c[1:-1] & c[2:]]))
    many = np.array([len(g) for g in grams_of])
    unit = (1 / np.sqrt(many)).astype(np.float32)[:, None]
    every, column = np.unique(np.concatenate([np.where(c, np.uint64(0), g) for g, c in zip(grams_of, plain, strict=True)]), return_inverse=True)
    owner = np.repeat(np.arange(len(rows)), many)
    kept = (np.bincount(np.unique(column * len(rows) + owner) // len(rows)) >= LEAST) & (every > 0)
    owner, column = np.r_[np.arange(len(rows)), owner[kept[column]]], np.r_[np.zeros(len(rows), np.int64), (np.cumsum(kept))[column[kept[column]]]]
    order = np.argsort(owner, kind="stable")  # each example begins with feature 0, which weighs nothing
    owner, column, keys = owner[order], column[order], np.r_[np.uint64(0), every[kept]]
    sizes = np.bincount(owner, minlength=len(rows))
    y = np.array([[f in labels for f in (*families, "")] for _, labels in rows], np.float32)
    weight = np.ones_like(y)
    weight[y[:, -1] == 0, -1] = PLAIN
    w, b = np.zeros((len(keys), y.shape[1]), np.float32), np.full(y.shape[1], -3, np.float32)
    order = np.argsort(column, kind="stable")
    first = np.searchsorted(column[order], np.arange(len(keys)))
    start = np.cumsum(sizes) - sizes
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    for t in range(1, epochs + 1):
        z = np.add.reduceat(w[column], start, axis=0) * unit + b
        g = (1 / (1 + np.exp(-z)) - y) * weight
        gw = np.add.reduceat((g * unit)[owner[order]], first, axis=0) + 2e-3 * w
        for x, grad, m, v in ((w, gw, moments[0], moments[1]), (b, g.sum(axis=0), moments[2], moments[3])):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            x -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        w[0] = 0
    return Classifier(keys, w, b)


@functools.lru_cache(4)
def train(frames: tuple[str, ...] = FRAMES, copies: int = COPIES) -> Classifier:
    """Fits the regression on made-up windows. Limits come from models that never saw a third of the families: their notices are of no
    family, so few of them may be named one, and they should be called notices where plain text is not."""
    rng = np.random.default_rng(5)
    families = (*NAMES,)
    whole = _fit(_examples(rng, families, frames, copies), families)
    named, notices, plain = [], [], []
    for k in range(GROUPS):
        left, out = tuple(f for i, f in enumerate(families) if i % GROUPS != k), tuple(f for i, f in enumerate(families) if i % GROUPS == k)
        part = _fit(_examples(rng, left, frames, max(1, copies // 2)), left)
        for tokens, labels in _examples(rng, out, frames[:: len(frames) // 6 or 1], 3):
            z = part.logits(_hash(tokens))
            found = confirmed(tokens)
            named.append(max((float(z[i]) for i, f in enumerate(left) if f in found), default=-50.0))
            (notices if labels else plain).append(float(z[-1]))
    z, y = np.array([*notices, *plain]), np.r_[np.ones(len(notices)), np.zeros(len(plain))]
    best = (np.inf, 1.0, 0.0)
    for a in np.geomspace(0.1, 2, 12):
        for b in np.linspace(-5, 5, 41):
            v = a * z + b
            best = min(best, (float(np.logaddexp(0, np.where(y == 1, -v, v)).mean()), float(a), float(b)))
    curve = best[1:]
    p = Classifier(whole.keys, whole.weights, whole.bias, curve=curve)
    family = min(0.9, max(0.3, float(1 / (1 + np.exp(-np.quantile(named, 1 - FALSE_FAMILY))))))
    plain, notices = p.notice(np.array(plain)), p.notice(np.array(notices))
    sure, may = float(np.quantile(plain, 1 - FALSE_NOTICE)), float(max(np.quantile(notices, FALSE_NOTICE), np.quantile(plain, 1 - LOOK)))
    return Classifier(whole.keys, whole.weights, whole.bias, (family, max(SURE, sure), min(may, sure)), curve)


@functools.lru_cache(1)
def _templates() -> tuple[list[tuple[str, tuple[bytes, ...]]], list[tuple[str, frozenset]]]:
    names = [(f, tuple(word_list(n))) for f, ns in NAMES.items() for n in ns]
    bodies = [(f, frozenset(zip(w, w[1:], w[2:], strict=False))) for f, bs in BODIES.items() for b in bs for w in [word_list(b)]]
    return names, bodies


def confirmed(tokens: list[bytes]) -> dict[str, int]:
    """Families of which a name stands in the text, or a body's words do to a large part, and where the first such begins. A name within
    a longer one of another family is none, and of bodies that are alike the best counts."""
    names, bodies = _templates()
    found = []
    for f, name in names:
        if name[0] in tokens:
            found += [(i, i + len(name), f) for i, t in enumerate(tokens) if t == name[0] and tuple(tokens[i : i + len(name)]) == name]
    out: dict[str, int] = {}
    for a, b, f in found:
        if not any(c <= a and b <= d and d - c > b - a and g != f for c, d, g in found):
            out[f] = min(a, out.get(f, a))
    triples = {t: i for i, t in reversed(list(enumerate(zip(tokens, tokens[1:], tokens[2:], strict=False))))}
    shared = [(len(both) / len(body), min(triples[t] for t in both), f) for f, body in bodies if len(both := body & triples.keys()) >= CONFIRM * len(body)]
    for share, at, f in shared:
        if all(share >= s for s, a, g in shared if g != f and abs(a - at) < 48):
            out.setdefault(f, at)
    return out


def _tokens(data: bytes, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """(words, text, line, paragraph) of a chunk's texts, one after the other: a line without words parts paragraphs."""
    plain = data.translate(_LETTERS)
    raw = np.frombuffer(plain, np.uint8)
    inside = raw > 32
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < len(raw))]
    begins[cuts] = inside[cuts]
    at = np.flatnonzero(begins)
    text = np.searchsorted(offsets, at, "right") - 1
    lines = np.cumsum(raw == 10)
    line = lines[at] if len(at) else np.zeros(0, np.int64)
    new = np.r_[True, (text[1:] != text[:-1]) | (line[1:] - line[:-1] > 1)][: len(at)]
    before = np.r_[0, lines][offsets[:-1]]
    words = plain.split()
    if len(words) != len(at):  # two texts meet without a blank between
        ends = np.r_[at[1:], len(raw)]
        words = [plain[a:b].split()[0] for a, b in zip(at, ends, strict=True)]
    return words, text, line - before[text], np.cumsum(new) - 1


def windows(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(from, to) of all windows over paragraphs [start, end)."""
    out = []
    for n, width in enumerate(WIDTHS):
        some = np.ones(len(starts), bool) if n == 0 else ends - starts > WIDTHS[n - 1]
        a, b = starts[some], ends[some]
        many = np.maximum(1, -(-(b - a - width) // (width // 2)) + 1)
        owner = np.repeat(np.arange(len(a)), many)
        begin = a[owner] + (np.arange(len(owner)) - (np.cumsum(many) - many)[owner]) * (width // 2)
        out.append((begin, np.minimum(begin + width, b[owner])))
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def scan_chunk(data: bytes, offsets: np.ndarray, model: Classifier) -> list[list[tuple[int, str, float]]]:
    """For each text (line, family, probability) of each licence notice, once a line and family."""
    out: list[dict] = [{} for _ in offsets[1:]]
    words, text, line, paragraph = _tokens(data, offsets)
    if not words:
        return [[] for _ in out]
    coded = pa.array(words, pa.binary()).dictionary_encode()
    h = _hash(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
    sums = []
    for g in grams(h):
        at, row = model.rows(g)
        each = np.zeros(len(h) + 1)
        each[at + 1] = model.weights[row, -1]
        sums.append(np.cumsum(each))
    starts = np.flatnonzero(np.r_[True, paragraph[1:] != paragraph[:-1]])
    bounds = np.r_[starts, len(words)]
    a, b = windows(starts, bounds[1:])
    n = b - a
    total = sum(s[np.maximum(a, b - k)] - s[a] for k, s in enumerate(sums))
    p = model.notice(total / np.sqrt(np.maximum(1, n + np.maximum(0, n - 1) + np.maximum(0, n - 2))) + model.bias[-1])
    hits = np.flatnonzero(p >= min(model.limits[1:]))
    runs: list[list] = []  # windows that overlap, in order: [from, to, probability of a notice, family logits]
    for i in hits[np.argsort(a[hits], kind="stable")]:
        z = model.logits(h[a[i] : b[i]])[:-1]
        if runs and a[i] < runs[-1][1] and paragraph[a[i]] == paragraph[runs[-1][0]]:
            last = runs[-1]
            last[1], last[2], last[3] = max(last[1], b[i]), max(last[2], p[i]), np.maximum(last[3], z)
        else:
            runs.append([int(a[i]), int(b[i]), float(p[i]), z])
    names = (*NAMES,)
    for start, stop, notice, z in runs:
        lo, hi = max(bounds[paragraph[start]], start - 6), min(bounds[paragraph[start] + 1], stop + 6)
        here, known = out[text[start]], confirmed(words[lo:hi])
        predicted = {f: float(1 / (1 + np.exp(-x))) for f, x in zip(names, z, strict=True)}
        some = False
        for f, at in known.items():
            if predicted[f] >= model.limits[0]:
                spot, some = (int(line[lo + at]), f), True
                here[spot] = max(predicted[f], here.get(spot, 0.0))
        if not some and notice >= model.limits[1]:
            spot = (int(line[start]), UNKNOWN)
            here[spot] = max(float(notice), here.get(spot, 0.0))
    return [[(i, f, x) for (i, f), x in sorted(found.items())] for found in out]


def license_scan(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, license (the family of the most probable notice, then the first; "unknown" if there are only
    notices of no known family; null without notice), families (sorted, joined by commas), n_notices, probability, lines (where).

    Null and empty texts have no notice. Each text is read by itself and whole: repeated rows, ties and empty tables need no rule, and
    null doc_ids are kept. The model is fitted once, by the driver, and goes to the tasks; it has some ten thousand n-grams.
    """
    model = train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text"):
            if not batch.num_rows:
                continue
            texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
            scanned = scan_chunk(b"".join(texts), np.r_[0, np.cumsum([len(x) for x in texts])], model)
            out = [[], [], [], [], []]
            for found in scanned:
                best = max(found, key=lambda x: (x[1] != UNKNOWN, x[2], -x[0]), default=(0, None, None))
                for x, v in zip(out, (best[1], ",".join(sorted({f for _, f, _ in found})), len(found), best[2], [i for i, _, _ in found]), strict=True):
                    x.append(v)
            kinds = [pa.string(), pa.string(), pa.int64(), pa.float64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, out, kinds)], ["doc_id", "license", "families", "n_notices", "probability", "lines"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, license string, families string, n_notices long, probability double, lines array<int>")
