"""Licence scans over headers and texts as they are printed: wrapped, commented, numbered, and near misses."""

import re
import textwrap

import pytest

from recordloom.llm import license_rules as L

APACHE = '''Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.'''
MIT = '''MIT License

Copyright (c) 2020 Somebody

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
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.'''
BSD2 = '''Copyright (c) 2020, Somebody
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
'''
NAME = '''
3. Neither the name of {} nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
'''
AS_IS = '''
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.'''
GPL2 = '''This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.'''
GPL3 = GPL2.replace("software; you", "software: you").replace("Foundation; either version 2", "Foundation, either version 3")
LGPL = GPL2.replace("program", "library").replace("GNU General", "GNU Lesser General").replace("version 2 of", "version 2.1 of")
MPL = '''This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.'''


def commented(x, leader):
    return "\n".join(f"{leader} {line}".rstrip() for line in x.split("\n"))


CASES = {
    "apache": (APACHE, ["Apache-2.0"]), "apache #": (commented(APACHE, "#"), ["Apache-2.0"]), "apache *": ("/*\n" + commented(APACHE, " *") + "\n */", ["Apache-2.0"]),
    "apache narrow": ("\n\n".join(textwrap.fill(p, 40) for p in APACHE.split("\n\n")), ["Apache-2.0"]), "apache crlf": (APACHE.replace("\n", "\r\n"), ["Apache-2.0"]),
    "mit": (MIT, ["MIT"]), "mit //": (commented(MIT, "//"), ["MIT"]), "mit grant alone": (MIT.split("\n\n")[2], ["MIT"]),
    "bsd 2": (BSD2 + AS_IS, ["BSD-2-Clause"]), "bsd 3": (BSD2 + NAME.format("the copyright holder") + AS_IS, ["BSD-3-Clause"]), "bsd 3 named": (BSD2 + NAME.format("Some Company, Inc") + AS_IS, ["BSD-3-Clause"]),
    "gpl 2": (GPL2, ["GPL-2.0-or-later"]), "gpl 3": (GPL3, ["GPL-3.0-or-later"]), "gpl 3 --": (commented(GPL3, "--"), ["GPL-3.0-or-later"]), "lgpl": (LGPL, ["LGPL-2.1-or-later"]),
    "agpl": (GPL3.replace("GNU General", "GNU Affero General"), ["AGPL-3.0-or-later"]), "mpl": (MPL, ["MPL-2.0"]),
    "two": (APACHE + "\n\n" + MIT, ["Apache-2.0", "MIT"]), "spdx": ("// SPDX-License-Identifier: BSD-3-Clause\nint x;", ["BSD-3-Clause"]),
    "cc": ("A text.\nThis work is licensed under a Creative Commons Attribution 4.0 International License.", ["CC-BY-4.0"]), "reserved": ("(c) X. All rights reserved.", ["Proprietary"]),
    "line": ("prose without an end\nReleased under the MIT License.\nmore prose", ["MIT"]), "unlicense": ("This is free and unencumbered software released into the public domain.", ["Unlicense"]),
    "near 1": (MIT.replace("free of charge", "for a fee"), ["MIT"]), "near 2": (APACHE.replace("Apache", "Acme"), []), "near 3": (GPL3.replace("GNU General", "GNU Special"), []),
    "near 4": ("It was not released under the MIT license by us.", []), "near 5": ("Licensed under the Apache License, Version 1.1.", []), "near 6": (GPL2.replace("version 2", "version 9"), []),
    "order": ("You may not use this file except in compliance with the License.\n\nYou may obtain a copy of the License at", []),
}


GPL3_TEXT = "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n                            Preamble\n\n  The GNU General Public License is a free, copyleft license for software.\n"
GPL2_TEXT = GPL3_TEXT.replace("Version 3, 29 June 2007", "Version 2, June 1991")
tag = "SPDX-License-Identifier: {}".format
CASES |= {
    "spdx later": ("// " + tag("GPL-2.0-or-later") + "\nint x;", ["GPL-2.0-or-later"]), "spdx only": ("# " + tag("LGPL-2.1-only"), ["LGPL-2.1-only"]), "spdx expression": (tag("(MIT OR Apache-2.0)"), ["Apache-2.0", "MIT"]),
    "spdx and": ("/* " + tag("GPL-3.0-or-later AND BSD-2-Clause") + " */", ["BSD-2-Clause", "GPL-3.0-or-later"]), "spdx with": (tag("GPL-2.0-only WITH Classpath-exception-2.0"), ["GPL-2.0-only"]), "spdx unknown": (tag("NOT-A-NAME OR Other"), []),
    "spdx in a header": ("/*\n * Copyright 2020 X\n * " + tag("Apache-2.0 OR GPL-2.0-or-later") + "\n */", ["Apache-2.0", "GPL-2.0-or-later"]),
    "gpl 3 text": (GPL3_TEXT, ["GPL-3.0"]), "gpl 2 text": (GPL2_TEXT, ["GPL-2.0"]), "gpl 3 text and appendix": (GPL3_TEXT + "\n  To do so, attach the following notices to the program.\n\n" + textwrap.indent(GPL3, "    "), ["GPL-3.0"]),
    "gpl 2 text and appendix": (GPL2_TEXT + "\n\n" + GPL2, ["GPL-2.0"]), "lgpl 2.1 text": ("GNU LESSER GENERAL PUBLIC LICENSE\n  Version 2.1, February 1999\n\nCopyright", ["LGPL-2.1"]), "agpl text": ("GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007\n\nx", ["AGPL-3.0"]),
    "link": ("## License\nReleased under the [MIT License](LICENSE).", ["MIT"]), "epl title": ("Eclipse Public License - v 2.0\n\n    THE PROGRAM", ["EPL-2.0"]), "near 7": ("It may not be licensed under the MIT license.", []), "near 8": ("MIT-0", []),
}


def test_sql_has_the_same_rows_of_texts_as_printed(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(k, x) for k, (x, _) in CASES.items()])
    got = {r["doc_id"]: (",".join(r["sentence_ids"]), r["first_at"], ",".join(r["licenses"])) for r in L.scan(spark.createDataFrame([(k, x) for k, (x, _) in CASES.items()], "doc_id string, text string")).collect()}
    assert got == {k: tuple(x) for k, *x in con.sql(f"SELECT doc_id, sentence_ids, first_at, licenses FROM ({L.SQL})").fetchall()}


def test_texts_as_printed(spark):
    rows = [(k, x, "k") for k, (x, _) in CASES.items()]
    got = {r["doc_id"]: r["licenses"] for r in L.scan(spark.createDataFrame(rows, "doc_id string, text string, licenses string")).collect()}
    assert got == {k: want for k, (_, want) in CASES.items()}


def test_tables():
    known, rules = L.known_sentences(), L.licence_rules()
    plain = lambda x: re.sub("[^a-z0-9]+", " ", x).strip()
    assert all(plain(s) == s and re.search(L._HINT, s) and not s[0].isdigit() for s in known)
    assert {i for _, ids in rules for i in ids} <= set(known.values()) and len({name for name, _ in rules}) >= 20
    assert [len(ids) for _, ids in rules] == sorted((len(ids) for _, ids in rules), reverse=True)


@pytest.mark.parametrize("size", [3_000_000])
def test_a_very_long_text_is_scanned_whole(spark, size):
    text = "some prose of a sentence. " * (size // 26) + "\n\n" + MIT
    r = L.scan(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert r["licenses"] == ["MIT"] and r["first_at"] >= size // 26
