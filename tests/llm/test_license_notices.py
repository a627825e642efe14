"""Licence notices as they stand in files."""

from lectern.llm.license_scan import license_scan

from .conftest import SCHEMA, rows_of


def scanned(spark, texts):
    df = spark.createDataFrame(rows_of([(k, t, "s") for k, t in enumerate(texts)]), SCHEMA)
    return {r.doc_id: r for r in license_scan(df).collect()}


def test_marks_between_words(spark):
    """What normalises to a known sentence is found, whatever stands between its words."""
    texts = ["x\nAll  rights reserved.\ny", "All\trights\treserved.", "All\u00a0rights\u00a0reserved.", "All rights-reserved.", "All <b>rights</b> reserved", "*All* *rights* *reserved*.", "ALL RIGHTS RESERVED"]
    out = scanned(spark, texts)
    assert [out[k].licenses for k in range(len(texts))] == ["proprietary"] * 4 + [""] + ["proprietary"] * 2


MIT = """Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE.
"""
APACHE = """# Copyright 2020 Somebody
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
"""
GPL3 = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
"""
GPL2 = """ * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; either version 2 of the License, or
 * (at your option) any later version.
"""
LGPL = GPL2.replace("program", "library").replace("General", "Lesser General").replace("version 2 of", "version 2.1 of")
BSD3 = """Copyright (c) 2020, Somebody
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at http://mozilla.org/MPL/2.0/. */
"""
NOTICES = {
    "MIT": (MIT, "MIT", "mit-text"),
    "MIT unwrapped": (MIT.replace("\n\n", "\0").replace("\n", " ").replace("\0", "\n"), "MIT", "mit-text"),
    "Apache": (APACHE, "Apache-2.0", "apache2-notice"),
    "Apache, CRLF": (APACHE.replace("\n", "\r\n"), "Apache-2.0", "apache2-notice"),
    "GPL 3": (GPL3, "GPL-3.0", "gpl3-notice"),
    "GPL 2": (GPL2, "GPL-2.0", "gpl2-notice-either"),
    "LGPL": (LGPL, "LGPL-2.1", "lgpl2_1-notice-either"),
    "AGPL": (GPL3.replace("General", "Affero General"), "AGPL-3.0", "agpl3-free"),
    "BSD 3": (BSD3, "BSD-3-Clause", "bsd3-conditions-reserved"),
    "BSD 2": (BSD3[BSD3.index("Redistribution") : BSD3.index("3. Neither")], "BSD-2-Clause", "bsd2-conditions"),
    "ISC": (ISC, "ISC", "isc-grant"),
    "MPL": (MPL, "MPL-2.0", "mpl2-notice"),
    "Unlicense": ("This is free and unencumbered software released into the\npublic domain.\n", "Unlicense", "unlicense-text"),
    "CC": ("This work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0", "cc-by-sa-4.0-work"),
    "SPDX": ("// SPDX-License-Identifier: GPL-2.0-or-later\nint x;", "GPL-2.0", "gpl-2.0-or-later-spdx"),
    "in prose": ("some words without an end\nReleased under the MIT License.\nmore", "MIT", "mit-released"),
}


def test_canonical_notices(spark):
    out = scanned(spark, [t for t, _, _ in NOTICES.values()])
    got = {name: (out[k].licenses, out[k].rules) for k, name in enumerate(NOTICES)}
    assert got == {name: (licence, rule) for name, (_, licence, rule) in NOTICES.items()}
