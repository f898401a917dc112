"""Verbatim public notices and tags."""

import pytest

pytest.importorskip("corpus_pipeline")
from reviewloom.llm import licenses as L  # noqa: E402

GNU = """    {what} is free software{colon} you can redistribute it and/or modify
    it under the terms of the GNU {kind}General Public License as published by
    the Free Software Foundation{comma} either version {version} of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
APACHE = """Copyright 2020 Somebody

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
CASES = [(GNU.format(what=w, kind=k, version=v, colon=c, comma=m), licence)
         for c, m in ((":", ","), (";", ";"))
         for w, k, v, licence in (("This program", "", "3", "GPL-3.0"), ("This program", "", "2", "GPL-2.0"), ("GNU Bison", "", "3", "GPL-3.0"),
                                  ("This program", "Affero ", "3", "AGPL-3.0"), ("Bison", "Affero ", "3", "AGPL-3.0"),
                                  ("This library", "Lesser ", "2.1", "LGPL"), ("This program", "Lesser ", "3", "LGPL"))]
CASES += [(MPL, "MPL-2.0"), (APACHE, "Apache-2.0"), (BSD, "BSD-2-Clause")]
TAGS = {"MIT": "MIT", "Apache-2.0": "Apache-2.0", "GPL-3.0-or-later": "GPL-3.0", "GPL-2.0": "GPL-2.0", "GPL-2.0+": "GPL-2.0", "LGPL-2.1-only": "LGPL", "AGPL-3.0-only": "AGPL-3.0",
        "MPL-2.0": "MPL-2.0", "BSD-3-Clause": "BSD-3-Clause", "ISC": "ISC", "CC0-1.0": "CC0-1.0", "CC-BY-SA-4.0": "CC-BY-SA-4.0"}
CASES += [(f"// SPDX-License-Identifier: {tag}\n#include <a.h>\n", licence) for tag, licence in TAGS.items()]
NAMED = """3. Neither the name of {holder} nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
CASES += [(BSD + "\n" + NAMED.format(holder=h), "BSD-3-Clause") for h in ("the copyright holder", "Acme Inc.", "the University of Somewhere, Dept. of Things", "Foo & Bar, Ltd.")]
ASF = """Licensed to the Apache Software Foundation (ASF) under one
or more contributor license agreements.  See the NOTICE file
distributed with this work for additional information
regarding copyright ownership.  The ASF licenses this file
to you under the Apache License, Version 2.0 (the
"License"); you may not use this file except in compliance
with the License.  You may obtain a copy of the License at
"""
BOOST = "// Distributed under the Boost Software License, Version 1.0. (See accompanying\n// file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"
CASES += [(ASF, "Apache-2.0"), (BOOST, "BSL-1.0"), ("This is free and unencumbered software released into the public domain.\n\nAnyone is free", "Unlicense")]
CASES += [
    ("SPDX-License-Identifier: MIT OR Apache-2.0", "Apache-2.0 MIT"),
    ("/* SPDX-License-Identifier: (GPL-2.0 OR BSD-3-Clause) */", "GPL-2.0 BSD-3-Clause"),
    ("SPDX-License-Identifier: MIT OR Apache-2.0 OR MPL-2.0 AND ISC", "Apache-2.0 MIT MPL-2.0 ISC"),
    ("SPDX-License-Identifier: EPL-2.0", "EPL"),
]


def test_sql_reads_the_notices_alike(spark, tmp_path):
    import duckdb

    spark.createDataFrame([(k, text) for k, (text, _) in enumerate(CASES)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    found = {r[0]: r[1] for r in con.execute(f"SELECT doc_id, licenses FROM ({L.ORACLES['op10_licenses']})").fetchall()}
    assert [found.get(k) for k in range(len(CASES))] == [licence for _, licence in CASES]


def test_public_notices(spark):
    rows = spark.createDataFrame([(k, text) for k, (text, _) in enumerate(CASES)], "doc_id long, text string")
    found = {r["doc_id"]: r["licenses"] for r in L.scan(rows).collect()}
    assert [found.get(k) for k in range(len(CASES))] == [licence for _, licence in CASES]
