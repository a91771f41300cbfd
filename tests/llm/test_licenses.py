"""The licence scan: names, denials, tags, layouts against SQL, and texts of any length."""

import time

import duckdb
import pytest

from tests.llm import test_llm
from trailmark.llm import licenses, sql

NAMED = {
    "Apache-2.0": ["SPDX-License-Identifier: Apache-2.0", "// SPDX-License-Identifier: Apache-2.0\nint x = 1;", "This project is licensed under the Apache License, Version 2.0."],
    "MIT": ["This project is available under the MIT license.", "Released under the MIT License.", "# SPDX-License-Identifier: MIT\nimport os"],
    "GPL-2.0-or-later,MIT": ["/* SPDX-License-Identifier: (MIT OR GPL-2.0+) */"],
    "Apache-2.0,BSD-3-Clause,MIT": ["SPDX-License-Identifier: MIT OR Apache-2.0 OR BSD-3-Clause"],
    "GPL-2.0": ["/* SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note */", "Licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.0."],
    "LGPL-2.1-or-later": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ],
    "LGPL-3.0": ["Licensed under the LGPL.\n\nDistributed under the GNU Lesser General Public License v3."],
    "AGPL-3.0-or-later": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "AGPL": ["This service is available under the GNU Affero General Public License."],
    "ISC": [
        "Copyright (c) 2020, A. Person\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE.",
        "ISC License\n\nLicensed under the ISC license.",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    ],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software."],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This dataset is licensed under the Creative Commons Attribution-NonCommercial 4.0 International (CC BY-NC 4.0) license."],
    "CC-BY-NC-ND-3.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivs 3.0 Unported License."],
    "CC-BY": ["Licensed under CC BY."],
    "CC0": ["CC0 1.0 Universal", "The data are released under CC0.", "To the extent possible under law, A. Person has waived all copyright and related or neighboring rights to this work."],
    "Proprietary": ["All rights reserved.", "Copyright (c) 2020 A. Person, all rights reserved.", "© 2020 Person. All rights reserved."],
}
UNNAMED = [
    "We offer no public domain dedication for this dataset.",
    "This program is not distributed under the GNU Affero General Public License.",
    "The hotel states all rights reserved.",
    "The MIT license is popular, and CC0 is a public domain dedication.",
    "If this file is licensed under the MIT License, tell us.",
    "The code was released under the MIT License.",
    "Nothing here is licensed under the Apache License, Version 2.0.",
    "SPDX-License-Identifier: LicenseRef-own",
    "It isn't available under the GNU General Public License, version 3.",
]


def scanned(spark, texts):
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text").orderBy("id").collect()
    return [tuple(r)[1:] for r in rows]


def test_names_and_denials(spark):
    texts = [(name, t) for name, own in NAMED.items() for t in own] + [("UNKNOWN", t) for t in UNNAMED]
    wrong = [(name, got[:2], t) for (name, t), got in zip(texts, scanned(spark, [t for _, t in texts]), strict=True) if got[0] != name]
    assert not wrong


def test_layouts_same_as_sql(spark):
    paragraphs = [t for own in test_llm.FULL.values() for t in own] + [t.split("\n\n") for own in NAMED.values() for t in own] + [[t] for t in UNNAMED]
    texts = [x for p in paragraphs for x in test_llm.laid_out(p)] + [None, "", "\n\n", "licence v. 2. licence v.2 licence!\nlicensed? (c) 2020\r\nx"]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(enumerate(texts)))
    want = {r[0]: r[1:] for r in con.execute(sql.op8()).fetchall()}
    wrong = [(got, want[k], texts[k]) for k, got in enumerate(scanned(spark, texts)) if got != want[k]]
    assert not wrong, (len(wrong), wrong[:2])


LONG = {
    "sentences": ("All rights reserved.\n\n" + "Some licence note here.\n\n" * 100_000, ("Proprietary", 100_001, 100_000)),
    "notices": ("Copyright 2020 A. Person\n" * 100_000, ("NONE", 100_000, 0)),
    "rights": ("All rights reserved. " * 100_000, ("Proprietary", 100_000, 0)),
    "marks": ("# " * 500_000, ("NONE", 0, 0)),
    "marks within": ("licence " + "#" * 1_000_000 + " x", ("UNKNOWN", 1, 1)),
    "blanks": ("licence" + " " * 1_000_000 + "x", ("UNKNOWN", 1, 1)),
    "denials": ("no " * 300_000 + "under the gnu lesser general public license", ("UNKNOWN", 1, 1)),
    "starts of a rule": ("Permission is hereby granted, free of charge, to any person obtaining a copy. " * 50_000, ("NONE", 50_000, 0)),
}


@pytest.mark.parametrize("name", sorted(LONG))
def test_long_texts(spark, name):
    text, want = LONG[name]
    began = time.time()
    (licences, _, n, unknown), = scanned(spark, [text])
    assert (licences, n, unknown) == want and time.time() - began < 120
