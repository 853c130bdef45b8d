import math
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

from cellframe.llm import langid, licenses
from cellframe.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text").collect()
    lang = {r.doc_id: r.lang for r in rows}
    got = QUERIES["op2_language_id"](spark, SF).collect()
    assert len(got) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out and lang[r.doc_id]]
    assert len(held) > 100 and sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_awkward_rows(spark):
    rows = [(1, "the cat and the dog", "en", "a"), (3, "le chat et le chien", "fr", "b"), (4, None, "en", "c"), (7, "12 !!", "fr", "d"), (None, "the dog", "en", "e"), (8, "", None, "f"), (8, "", None, "f"), (9, "le chien " * 60_000, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = langid.fit(langid.training_rows(docs))
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert (got[4].lang_pred, got[7].lang_pred, got[8].lang_pred, got[8].score) == ("und", "und", "und", 0.0)
    assert got[9].lang_pred == "fr" and got[None].lang_pred == "en"
    assert langid.predict(docs, model).count() == 8
    kept = langid.identified(docs, model)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == {1, 3, None, 9}
    none = langid.fit(langid.training_rows(docs.limit(0)))
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0


def test_model_without_languages_keeps_texts_with_letters(spark):
    rows = [(1, "the cat and the dog", None), (2, None, None), (3, "", None), (4, "12 !!", None), (5, "é", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(langid.training_rows(docs))
    assert model.languages == []
    assert {r.doc_id for r in langid.identified(docs, model).collect()} == {1, 5}


def grams(texts):
    return sorted(pair for rows, buckets in langid.gram_rows(texts) for pair in zip(rows.tolist(), buckets.tolist(), strict=True))


def test_pieces_hold_every_gram_once(monkeypatch):
    texts = ["Straße und İstanbul, 12 déjà-vu x" * 20, "", None, "a", "..", "b c" * 40]
    whole = grams(texts)
    monkeypatch.setattr(langid, "PIECE", 7)
    assert grams(texts) == whole
    monkeypatch.undo()
    for row, text in enumerate(texts):
        assert [b for r, b in whole if r == row] == [b for _, b in grams([text])]


def bucket(gram):
    """The bucket of a lower-case n-gram without non-letters other than spaces, number by number."""
    h = 0
    for c in gram:
        h = (h * 0x01000193 + ord(c)) % 2**32
    return ((h ^ h >> 15 ^ len(gram) * 0x5BD1) * 0x9E3779B1 % 2**32) >> 17


def naive(text):
    x = "".join(c if c.isalpha() else " " for c in text.lower())
    return Counter(bucket(x[i : i + n]) for n in (1, 2, 3) for i in range(len(x) - n + 1) if x[i : i + n].strip(" "))


def test_against_plain_naive_bayes(spark):
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()]
    train = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.lang is not None and r.text is not None]
    counts, docs = {}, Counter(r.lang for r in train)
    for r in train:
        counts.setdefault(r.lang, Counter()).update(naive(r.text))
    langs = sorted(docs)
    whole = {lang: sum(counts[lang].values()) + 0.5 * langid.BUCKETS for lang in langs}
    want = {}
    for r in rows:
        own = naive(r.text or "")
        logs = [math.log(docs[lang] / len(train)) + sum(n * math.log((counts[lang][b] + 0.5) / whole[lang]) for b, n in own.items()) for lang in langs]
        want[r.doc_id] = (langs[logs.index(max(logs))], 1 / sum(math.exp(x - max(logs)) for x in logs)) if own else ("und", 0.0)
    got = QUERIES["op2_language_id"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.lang_pred == want[r.doc_id][0] and abs(r.score - want[r.doc_id][1]) < 1e-6


def test_training_bound(spark):
    """A language of any size keeps some of its values, and about the stated number of rows."""
    for many in (10, 3000, 3001, 10**7, 10**12, 10**19):
        kept = langid.draws_kept(many, 3000)
        assert 0 < kept <= langid.DRAWS and (many > 10**15 or abs(kept / langid.DRAWS * many - min(many, 3000)) < 1)
    rows = [(k, "the cat" if k % 10 else "le chat", "en" if k % 10 else "fr") for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, per_language=200)
    assert model.languages == ["en", "fr"] and model.predict("the")[0] == "en" and model.predict("chat le")[0] == "fr"
    assert [round(math.exp(p), 6) for p in model.prior] == [0.9, 0.1]
    again = langid.fit(docs.repartition(7), per_language=200)
    assert again.block(0).tolist() == model.block(0).tolist() and again.unseen.tolist() == model.unseen.tolist()


def test_many_languages(spark, monkeypatch):
    """Thousands of labels are languages too, and a worker's memory stays small; blocks agree with one whole matrix."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("lang"), F.col("id") % 2000).alias("lang"), F.concat_ws(" ", F.sha2((F.col("id") % 2000).cast("string"), 256), F.lit("the")).alias("text"))
    model = langid.fit(docs)
    assert len(model.languages) == 2000
    held = {r.doc_id: r for r in langid.predict(docs.filter("doc_id < 300"), model).collect()}
    assert sum(r.lang_pred == f"lang{i % 2000}" for i, r in held.items()) > 290
    texts = [r.text for r in docs.limit(40).collect()] + [None, "12", "the " * 100_000]
    whole = model.predict_all(texts)
    monkeypatch.setattr(langid, "SLICE", 2000)
    model._ready.clear()
    alike = model.predict_all(texts)
    assert whole[0] == alike[0] and np.allclose(whole[1], alike[1])
    monkeypatch.undo()
    rng = np.random.default_rng(1)
    wide = langid.Model([f"l{i:04}" for i in range(2000)], np.log(np.full(2000, 1 / 2000)), np.full(2000, -14.0), [(rng.permutation(langid.BUCKETS)[:3000], rng.normal(-8, 1, 3000)) for _ in range(2000)])
    tracemalloc.start()
    wide.predict_all(["some words of a text " * 2000] * 20)
    assert tracemalloc.get_traced_memory()[1] < 350_000_000
    tracemalloc.stop()


FULL = {
    "Apache-2.0": '/*\n * Licensed under the Apache License, Version 2.0 (the "License");\n * you may not use this file except in compliance with the License.\n * You may obtain a copy of the License at\n *\n *     http://www.apache.org/licenses/LICENSE-2.0\n *\n * Unless required by applicable law or agreed to in writing, software\n * distributed under the License is distributed on an "AS IS" BASIS,\n * WITHOUT WARRANTIES. */',
    "MIT": 'MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software.\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND.',
    "GPL-3.0": "words. This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "and so\nLicensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under a Creative Commons BY 4.0 license.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\nRedistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\nRedistributions in binary form must reproduce the above copyright notice, this list.",
}


def test_rules(spark):
    rows = [(k, text, "x") for k, text in enumerate(FULL.values())] + [(100, None, "x"), (101, "", "x"), (102, "no licence here, copyrighted words", "x"), (103, "Released under the MIT License. Licensed under CC BY-NC 4.0. Licensed under the Foo terms.", "x"), (103, "Released under the MIT License.", "x"), (None, "word " * 50_000 + ". Released under the MIT License.", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, licenses string")
    got = sorted(map(tuple, licenses.recognise(docs).collect()), key=repr)
    found = {r[0]: r[2] for r in got if r[0] is not None and r[0] < 100}
    assert [found[k] for k in range(len(FULL))] == list(FULL)
    assert (103, "MitReleased,CcByNc4,OtherLicensed", "MIT,CC-BY-NC-4.0", 1) in got and (100, "", "", 0) in got
    assert [r[2] for r in got if r[0] is None] == ["MIT"]
    duck = duckdb.connect()
    documents = duck.from_arrow(docs.toArrow())
    documents.create_view("documents")
    assert sorted(duck.sql(licenses.oracle()).fetchall(), key=repr) == got
    assert licenses.recognise(docs.limit(0)).count() == 0
    plan = licenses.recognise(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


GNU = "This {what} is free software{mark} you can redistribute it and/or modify\nit under the terms of the GNU {kind}General Public License as published by\nthe Free Software Foundation{cut} either version {version} of the License, or\n(at your option) any later version.\n\nThis {what} is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\nGNU {kind}General Public License for more details.\n\nYou should have received a copy of the GNU {kind}General Public License\nalong with this {what}; if not, write to the Free Software\nFoundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.\n"
BSD = 'Copyright (c) 2020, Foo Inc.\nAll rights reserved.\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n{a} Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n{b} Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n\n{c} Neither the name of Foo Inc. nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS".'
UNLICENSE = 'This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software, either in source code form or as a compiled\nbinary, for any purpose, commercial or non-commercial, and by any\nmeans.\n'
ZLIB = "Copyright notice\n\nThis software is provided 'as-is', without any express or implied\nwarranty.  In no event will the authors be held liable for any damages\narising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:\n"
BOOST = 'Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any person or organization\nobtaining a copy of the software and accompanying documentation covered by\nthis license (the "Software") to use, reproduce, display, distribute,\nexecute, and transmit the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED.\n'
ZERO = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted.\n"
ISC = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n"
BSD2 = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\nRedistributions in binary form must reproduce the above copyright notice, this list.")
NOTICES = [
    (GNU.format(what="program", mark=";", kind="", cut=";", version="2"), "GPL-2.0-or-later", 0),
    (GNU.format(what="program", mark=":", kind="", cut=",", version="3"), "GPL-3.0-or-later", 0),
    ("/*\n * " + GNU.format(what="program", mark=";", kind="", cut=",", version="2").replace("\n", "\n * ") + "*/", "GPL-2.0-or-later", 0),
    (GNU.format(what="library", mark=";", kind="Lesser ", cut=";", version="2.1"), "LGPL-2.1-or-later", 0),
    (GNU.format(what="library", mark=";", kind="Library ", cut=";", version="2"), "LGPL-2.0-or-later", 0),
    (GNU.format(what="library", mark=":", kind="Lesser ", cut=",", version="3"), "LGPL-3.0-or-later", 0),
    (GNU.format(what="program", mark=":", kind="Affero ", cut=",", version="3"), "AGPL-3.0-or-later", 0),
    ("This library is released under the GNU Lesser General Public License, version 2.1.", "LGPL-2.1", 0),
    ("This library is released under the GNU Lesser General Public License, version 3.", "LGPL-3.0", 0),
    ("Licensed under the GNU Lesser General Public License v2.1 or later.", "LGPL-2.1-or-later", 0),
    ("This is licensed under the GNU General Public License, version 2 or later.", "GPL-2.0-or-later", 0),
    ("This is licensed under the GNU General Public License, version 2.", "GPL-2.0", 0),
    (BSD.format(a="1.", b="2.", c="3."), "BSD-3-Clause", 2),
    (BSD.format(a="1)", b="2)", c="3)"), "BSD-3-Clause", 2),
    ("Licensed under the MIT license, see LICENSE for details.", "MIT", 0),
    ("Released under the MIT License (http://opensource.org/licenses/MIT).", "MIT", 0),
    ("Licensed under the MIT license and the Apache License, Version 2.0.", "", 1),
    ("Licensed under the BSD 3-Clause License (see LICENSE).", "BSD-3-Clause", 0),
    ("// SPDX-License-Identifier: MIT\n// Copyright 2020 Foo\nint main;", "MIT", 0),
    ("/* SPDX-License-Identifier: GPL-2.0+ */\n#include <x.h>\n", "GPL-2.0-or-later", 0),
    ("# SPDX-License-Identifier: GPL-2.0-only\n", "GPL-2.0", 0),
    ("# SPDX-License-Identifier: LGPL-2.1-or-later\n", "LGPL-2.1-or-later", 0),
    ("/* SPDX-License-Identifier: Unlicense */\n", "Unlicense", 0),
    (UNLICENSE, "Unlicense", 0),
    (ZLIB, "Zlib", 0),
    (BOOST, "BSL-1.0", 1),
    (ZERO, "0BSD", 0),
    (ISC, "ISC", 0),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "EPL-2.0", 0),
    (BSD2[0] + "\n\nReleased under the MIT License.\n\n" + BSD2[1], "MIT", 3),
    ("Released under the MIT License.\n\n" + GNU.format(what="program", mark=";", kind="", cut=";", version="2") + "\nLicensed under the Apache License, Version 2.0.", "Apache-2.0,GPL-2.0-or-later,MIT", 0),
    (BSD.format(a="1.", b="2.", c="4.").replace("4. Neither", "3. All advertising materials mentioning features or use of this software\n   must display the following acknowledgement:\n   This product includes software developed by Foo Inc.\n\n4. Neither"), "BSD-4-Clause", 2),
    ("This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, version 3.\n", "GPL-3.0", 0),
    ("You may redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License.", "GPL-2.0", 0),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; version 2.1 of the License.", "LGPL-2.1", 0),
    ("This file is not licensed under the MIT License.", "", 1),
    ("The data are no longer available under the Apache License, Version 2.0.", "", 1),
    ("Nothing here is dedicated to the public domain.", "", 1),
    ("This work is dedicated to the public domain.", "", 1),
    ("This work is under CC0 1.0 Universal.", "CC0-1.0", 0),
    ("Licensed under the Apache License, Version 20.1", "", 1),
    ("Licensed under the Apache License, Version 2.0 (the License).", "Apache-2.0", 0),
    ("Code is released under the Apache 2.0 license.", "Apache-2.0", 0),
    ("Released under GPLv3.", "GPL-3.0", 0),
    ("The sources are available under the GPL v2 or later.", "GPL-2.0-or-later", 0),
    ("Distributed under LGPLv2.1+", "LGPL-2.1-or-later", 0),
    ("This text is licensed under a Creative Commons Attribution 4.0 International License.", "CC-BY-4.0", 0),
    ("Licensed under the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International Public License", "CC-BY-NC-SA-4.0", 0),
    ("Licensed under CC BY 40.", "", 1),
    ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE", "Apache-2.0", 0),
    ("The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License.", "MPL-1.1", 1),
    ("# SPDX-License-Identifier: MIT OR Apache-2.0\n", "", 1),
    ("# SPDX-License-Identifier: Foo-1.0\n", "", 1),
]


def test_standard_notices(spark):
    docs = spark.createDataFrame([(k, text) for k, (text, _, _) in enumerate(NOTICES)], "doc_id long, text string")
    got = sorted(map(tuple, licenses.recognise(docs).collect()))
    assert [(r[2], r[3]) for r in got] == [n[1:] for n in NOTICES]
    duck = duckdb.connect()
    duck.from_arrow(docs.toArrow()).create_view("documents")
    assert sorted(duck.sql(licenses.oracle()).fetchall()) == got


def test_query(spark):
    """The registered oracle is written apart from the operator's tables."""
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = QUERIES["op6_license_scan"](spark, SF).select("doc_id", "sentence_ids", "licenses", "n_left").collect()
    assert sorted(map(tuple, got)) == sorted(duck.sql(ORACLES["op6_license_scan"]).fetchall())
