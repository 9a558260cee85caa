import random
import re

from tessera.llm.license_scan import _known, license_scan

BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
SRC = "* Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
BIN = "* Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."


def scan(spark, *texts):
    docs = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "doc_id long, text string, licenses_found string")
    return [(r.licenses, r.permissive) for r in license_scan(docs).orderBy("doc_id").collect()]


def test_rules_need_their_order(spark):
    assert scan(spark, BSD + SRC + "other.\n" + BIN, SRC + BSD + BIN, BSD + SRC) == [(["BSD-2-Clause"], True), ([], None), ([], None)]


def test_sentences_in_running_text_and_edges(spark):
    got = scan(spark, None, "", "x. Licensed under the Apache License, Version 2.0. y", "Released under the  MIT License.\nLicensed under CC BY-NC 4.0.", "MIT License", "word " * 100000 + "\nAll rights reserved.", "...\n!!\n;")
    assert got == [([], None), ([], None), (["Apache-2.0"], True), (["CC-BY-NC-4.0", "MIT"], False), ([], None), (["proprietary"], False), ([], None)]


def test_empty_table(spark):
    assert license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


MIT = """MIT License

Copyright (c) 2020 Some Body

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
"""
APACHE = """ * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
"""
APACHE_TITLE = "\n                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n"
GPL_TITLE = "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007"
GPL = """# This program is free software{} you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation{} either version {} of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
"""
BSD3 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of Some Body Ltd nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


def test_standard_notices_as_they_are_wrapped(spark):
    texts = [MIT, APACHE, APACHE_TITLE, GPL_TITLE, GPL.format(":", ",", 3), GPL.format(";", ";", 3), GPL.format(";", ";", 2), BSD3, BSD3.split("3. ")[0], BSD3.replace("1.", "1)"), MIT.replace("\n", "\r\n"), "A title\n" + MIT[MIT.index("Perm") :]]
    want = [["MIT"], ["Apache-2.0"], ["Apache-2.0"], ["GPL-3.0"], ["GPL-3.0", "GPL-notice"], ["GPL-3.0", "GPL-notice"], ["GPL-notice"], ["BSD-2-Clause", "BSD-3-Clause"], ["BSD-2-Clause"], ["BSD-2-Clause", "BSD-3-Clause"], ["MIT"], ["MIT"]]
    assert [licenses for licenses, _ in scan(spark, *texts)] == want


def test_a_copyright_line_is_neutral_beside_a_notice(spark):
    line = "Copyright (c) 2020, Some Body\nAll rights reserved.\n\n"
    assert scan(spark, line + BSD3, line + MIT, line, line + "Released under the MIT License.") == [(["BSD-2-Clause", "BSD-3-Clause"], True), (["MIT"], True), (["proprietary"], False), (["MIT", "proprietary"], False)]


def test_runs_end_at_blank_lines_and_stops(spark):
    assert scan(spark, "Released under\n\nthe MIT license", "Released under; the MIT license", "Not\nreleased under the MIT\nlicense", "We are not released under the MIT\nlicense", "Released under the MIT license or not") == [([], None), ([], None), (["MIT"], True), ([], None), ([], None)]


def test_more_notices_and_identifier_lines(spark):
    isc = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n"
    lesser = GPL.format(";", ";", "2.1").replace("General", "Lesser General")
    mpl = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed */"
    cc0 = "To the extent possible under law, Some Body has\nwaived all copyright and related or neighboring rights to\nthis work."
    texts = [isc, lesser, lesser.replace("Lesser", "Affero"), mpl, cc0, "This is free and unencumbered software released into the public domain.", "// SPDX-License-Identifier: MIT\nint x;", "# SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: MITx", "Licensed under CC BY-SA 4.0."]
    assert [licenses for licenses, _ in scan(spark, *texts)] == [["ISC"], ["LGPL"], ["AGPL"], ["MPL-2.0"], ["CC0-1.0"], ["Unlicense"], ["MIT"], ["GPL-3.0"], [], ["CC-BY-SA-4.0"]]


def brute(text):
    """Identifiers by trying every run of lines in plain Python."""
    known = _known()
    text = text.lower().replace("\r\n", "\n").replace("\r", "\n")
    out = []
    for piece in re.split(r";+|(?<=[.!?])\s+", text):
        lines = [" ".join(re.findall(r"[^\W_]+", line)) for line in piece.split("\n")]
        at = 0
        while at < len(lines):
            for n in range(len(lines) - at, 0, -1):
                run = lines[at : at + n]
                joined = " ".join(run)
                tries = [j for j in (re.sub(r"^[0-9]{1,2} ", "", joined), joined) if all(run)]
                name = next((i for j in tries for t, i in known if re.fullmatch(" ".join(w if w != "*" else r"\w+(?: \w+){0,11}?" for w in t.split()), j)), None)
                if name:
                    out.append(name)
                    at += n - 1
                    break
            at += 1
    return out


def test_equal_to_every_run_of_lines(spark):
    rng = random.Random(1)
    pool = [t.replace("*", "some body") for t, _ in _known()] + ["a line of its own", "", "2 0", "this program", "you may"]
    texts = []
    for _ in range(300):
        words = "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 4))).split(" ")
        texts.append("".join(w + rng.choice([" ", " ", " ", "\n", " \n * ", ". ", "; ", "\n\n"] if rng.random() < 0.12 else [" "]) for w in words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.sentence_ids for r in license_scan(docs).collect()}
    want = {i: brute(t) for i, t in enumerate(texts)}
    assert got == want and sum(map(len, want.values())) > 150
