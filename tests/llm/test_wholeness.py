"""What must cover all data or every length, however the work is divided."""

import random
import textwrap

import numpy as np

from helpers import prose, table
from tallyspark.llm import decontaminate, language, licences


def test_long_items_at_the_limit(spark):
    """Items of 200 to 1,000 words are found with as many edits as are allowed, evenly spread or mixed."""
    draw = random.Random(9)
    items = [(n + k, prose(n + k, n, 100_000)) for n in (200, 400, 800, 1000) for k in range(3)]
    rows = []
    for i, t in items:
        even, mixed = t.split(), t.split()
        for e in range(decontaminate.budget(len(even))):
            even[5 * e + 2] = f"new{e}"
            how, at = draw.randrange(3), draw.randrange(len(mixed))
            mixed[at : at + (how != 2)] = [] if how == 0 else [f"other{e}"]
        rows += [(2 * i, prose(i, 50) + " " + " ".join(even) + " " + prose(i + 1, 50)), (2 * i + 1, " ".join(mixed) + " " + prose(i + 2, 50))]
    found = decontaminate.leaks(table(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(2 * i + k, i) for i, _ in items for k in range(2)}
    assert all(r.distance <= decontaminate.budget(r.item_id // 100 * 100) for r in found)


MIT = [
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE.',
]
BSD = [
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
]
GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
LGPL = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0'
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."


ZLIB = ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"]
AGPL = GPL.replace("GNU General", "GNU Affero General").format(3) + "\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
UNLICENSE = ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."]


def test_long_text(spark):
    """A text of more than a megabyte is searched to its end."""
    text = "some words of no licence. " * 50_000 + "\n\n" + textwrap.fill(AGPL, 72)
    (row,) = licences.scan(table(spark, [(1, text)])).collect()
    assert row.licences == "AGPL-3.0-or-later" and row.n_sentences > 50_000


def test_reserved_rights_beside_a_licence(spark):
    """All rights reserved is no licence of its own where another is granted."""
    reserved = "Copyright 2020 A. All rights reserved."
    rows = [(1, reserved), (2, reserved + "\n\n" + " ".join(BSD)), (3, MPL + "\n\n" + reserved), (4, reserved + "\n\nLicensed under CC BY 4.0.")]
    found = {r.doc_id: (r.licences, r.licence) for r in licences.scan(table(spark, rows)).collect()}
    assert found == {1: ("proprietary", "proprietary"), 2: ("BSD-3-Clause", "BSD-3-Clause"), 3: ("MPL-2.0", "MPL-2.0"), 4: ("CC-BY-4.0", "CC-BY-4.0")}


def test_wrapped_licences(spark):
    """Licences as they are usually written: wrapped at 72 columns, bare and as comments, and short references."""
    whole = [("MIT", MIT), ("BSD-3-Clause", BSD), ("BSD-2-Clause", BSD[:3]), ("GPL-3.0-or-later", [GPL.format(3)]), ("GPL-2.0-or-later", [GPL.format(2)]), ("LGPL-2.1-or-later", [LGPL]), ("MPL-2.0", [MPL]), ("ISC", [ISC]), ("Apache-2.0", APACHE.split("\n\n")), ("Zlib", ZLIB), ("AGPL-3.0-or-later", AGPL.split("\n\n")), ("Unlicense", UNLICENSE)]
    rows, want = [], {}
    for name, parts in whole:
        text = "\n\n".join(textwrap.fill(p, 72) for p in parts)
        for mark in ("", "# ", " * ", "// "):
            want[len(rows)] = name
            rows.append((len(rows), "Copyright (c) 2020 Some One\n" + "\n".join(mark + line for line in text.split("\n")) + "\n"))
    for name, text in [("MIT", "This project is licensed under the MIT License"), ("Apache-2.0", "Distributed under the Apache License, Version 2.0"), ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."), ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0"), ("BSD-3-Clause", "Some words. Released under the\n3-clause BSD license."), (None, "They spoke of the MIT License at length."), (None, "Licensed under the\n\nMIT License")]:
        want[len(rows)] = name
        rows.append((len(rows), text))
    got = {r.doc_id: r.licences for r in licences.scan(table(spark, rows)).collect()}
    assert got == {i: name or "" for i, name in want.items()}


def test_samples_alone_reach_their_recall():
    """Items of all lengths with all the edits they may have, found by equal samples of walks before any exact check."""
    draw = random.Random(5)
    found = asked = 0
    for n in (20, 60, 100, 200, 400):
        items = [[f"v{draw.randrange(3000)}" for _ in range(n)] for _ in range(12)]
        index = decontaminate.Index([(k, " ".join(x)) for k, x in enumerate(items)])
        for k, item in enumerate(items):
            text = list(item)
            for e in range(decontaminate.budget(n)):
                at = draw.randrange(len(text))
                text[at : at + draw.randrange(2)] = [f"edit{e}"] * draw.randrange(2)
            raw = " ".join(["before"] * 9 + text + ["after"] * 9).encode()
            symbols, cuts = decontaminate.hashed_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            found += any(hit == k for _, hit, _ in index.sampled(symbols, cuts, *index.windows(symbols, cuts)))
            asked += 1
    assert found >= 0.95 * asked


def test_items_without_an_id_or_with_a_shared_one(spark):
    one, two, three = (prose(seed, 30) for seed in (51, 52, 53))
    items = spark.createDataFrame([(None, one), (7, two), (7, three), (7, three), (8, None)], "item_id long, text string")
    found = decontaminate.leaks(table(spark, [(1, one), (2, two + " and " + three), (3, None)]), items).collect()
    assert sorted((r.doc_id, r.item_id or -1, r.distance) for r in found) == [(1, -1, 0), (2, 7, 0), (2, 7, 0)]


def test_calibration_asks_texts_held_back(spark):
    """Usual cross-entropies are those of texts that the asked model hasn't seen, not of those it was trained on."""
    rows = [(i, prose(700 + i, 60), "xx" if i % 2 else "yy") for i in range(80)]
    docs = table(spark, [(i, t if g == "xx" else t.translate(str.maketrans("abdeilnorst", "çžqujkvwxyz")), g) for i, t, g in rows])
    model = language.fit(docs)
    sample = language.labelled_sample(docs)
    assert 0 < sample.where("back").count() < 40
    seen = {r["lang"]: [] for r in language._measured(model, sample)}
    for r in language._measured(model, sample):
        seen[r["lang"]].append(r["entropy"][model.languages.index(r["lang"])])
    for k, name in enumerate(model.languages):
        assert model.usual[k] > sum(seen[name]) / len(seen[name])
    assert language.labelled_sample(docs, bytes_per_language=4000).count() < 40
