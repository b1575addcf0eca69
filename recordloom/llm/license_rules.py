"""Licence scans by sentence rules.

A text is cut into sentences: at blank lines (lines without a letter or digit), and behind . ! ? ; before white space. Lines
within a sentence are joined, so that hard wraps and comment leaders don't matter. A sentence is normalised: lower case
A-Z, runs of other characters than letters and digits as one space, a number before it (as of a list) dropped. Known
sentences have identifiers; a sentence that isn't known as a whole is looked up line by line. A licence is a rule, an
ordered sequence of identifiers, which matches where they stand one after another among the text's known sentences
(others between them do no harm). Rules are tried in order, longer ones first, and a rule takes the sentences that it
matches from those behind it; the last ones match only where nothing else has. Rules and sentences are fixed parameters,
so the whole scan is a projection: nothing is shuffled.

Of an SPDX tag each name of its expression is a sentence, parted at OR, AND and WITH; names of exceptions aren't known, and
a + behind a name isn't read. The target of a Markdown link is no part of a sentence. The title of a full text of the GNU
licences names it, and takes the sentences of its appendix, which tell how to grant it and don't grant it.

Cases: a null or empty text has no sentence and no licence; repeated rows have equal results; of rules of one length the
earlier one goes first; an empty table gives an empty one; other columns of the input, whatever their names, are
ignored; very long texts are scanned whole.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text

#: Sentences of licences as their texts have them, normalised, behind their identifiers.
_SENTENCES = """
mit.grant: permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions
mit.keep: the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit.as_is: the software is provided as is without warranty of any kind express or implied
mit.as_is: the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
mit.liability: in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software
isc.grant: permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
isc.grant: permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
isc.as_is: the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness
0bsd.grant: permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
bsd.grant: redistribution and use in source and binary forms with or without modification are permitted
bsd.grant: redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd.source: redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd.binary: redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution
bsd.advertising: all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd.name: neither the name of the copyright holder nor the names of its contributors may be used
bsd.name: neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission
bsd.as_is: this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed
bsd.as_is: this software is provided by the copyright holder and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed
apache2.title: apache license version 2 0 january 2004 http www apache org licenses
apache2.title: apache license version 2 0 january 2004 https www apache org licenses
apache2.notice: licensed under the apache license version 2 0 the license
license.use: you may not use this file except in compliance with the license
license.obtain: you may obtain a copy of the license at
apache2.obtain: you may obtain a copy of the license at http www apache org licenses license 2 0
apache2.obtain: you may obtain a copy of the license at https www apache org licenses license 2 0
apache2.unless: unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied
apache2.see: see the license for the specific language governing permissions and limitations under the license
gnu.free: this program is free software
gnu.free: this file is free software
gnu.free: this library is free software
gpl.terms: you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation
gpl2.terms: you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation
lgpl.terms: you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation
gnu2.later: either version 2 of the license or at your option any later version
gnu21.later: either version 2 1 of the license or at your option any later version
gnu3.later: either version 3 of the license or at your option any later version
gpl3.later: this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl3.only: this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3 of the license
lgpl3.later: this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
agpl3.later: this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
mpl2.notice: this source code form is subject to the terms of the mozilla public license v
mpl2.obtain: if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0
mpl2.obtain: if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0
unlicense.free: this is free and unencumbered software released into the public domain
unlicense.anyone: anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means
cc0.waived: to the extent possible under law the author has waived all copyright and related or neighboring rights to this work
cc0.waived: to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide
zlib.as_is: this software is provided as is without any express or implied warranty
zlib.grant: permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions
zlib.altered: altered source versions must be plainly marked as such and must not be misrepresented as being the original software
boost.grant: permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following
boost.see: see accompanying file license 1 0 txt or copy at http www boost org license 1 0 txt
boost.see: see accompanying file license 1 0 txt or copy at https www boost org license 1 0 txt
epl2.notice: this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0
epl2.notice: this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at http www eclipse org legal epl 2 0
postgresql.grant: permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies
cddl.notice: the contents of this file are subject to the terms of the common development and distribution license the license
mspl.governs: this license governs use of the accompanying software
mspl.accept: if you use the software you accept this license
reserved: all rights reserved
"""
#: Licences by their SPDX identifiers and what notices call them, normalised.
_NAMES = """
MIT: mit license
ISC: isc license
0BSD: zero clause bsd license
BSD-2-Clause: bsd 2 clause license
BSD-3-Clause: bsd 3 clause license
BSD-4-Clause: bsd 4 clause license
Apache-2.0: apache license version 2 0
Apache-2.0: apache license 2 0
Apache-2.0: apache 2 0 license
GPL-2.0: gnu general public license version 2
GPL-3.0: gnu general public license version 3
LGPL-2.1: gnu lesser general public license version 2 1
LGPL-3.0: gnu lesser general public license version 3
AGPL-3.0: gnu affero general public license version 3
MPL-2.0: mozilla public license version 2 0
Unlicense: unlicense
Zlib: zlib license
BSL-1.0: boost software license version 1 0
EPL-2.0: eclipse public license 2 0
EPL-2.0: eclipse public license v 2 0
PostgreSQL: postgresql license
CDDL-1.0: common development and distribution license version 1 0
MS-PL: microsoft public license
Artistic-2.0: artistic license 2 0
EUPL-1.2: european union public licence 1 2
CC0-1.0: cc0 1 0
CC0-1.0: cc0 1 0 universal
CC-BY-4.0: cc by 4 0
CC-BY-4.0: creative commons attribution 4 0 international license
CC-BY-SA-4.0: cc by sa 4 0
CC-BY-SA-4.0: creative commons attribution sharealike 4 0 international license
CC-BY-NC-4.0: cc by nc 4 0
CC-BY-NC-4.0: creative commons attribution noncommercial 4 0 international license
CC-BY-ND-4.0: cc by nd 4 0
CC-BY-ND-4.0: creative commons attribution noderivatives 4 0 international license
CC-BY-NC-SA-4.0: cc by nc sa 4 0
CC-BY-NC-SA-4.0: creative commons attribution noncommercial sharealike 4 0 international license
CC-BY-NC-ND-4.0: cc by nc nd 4 0
CC-BY-NC-ND-4.0: creative commons attribution noncommercial noderivatives 4 0 international license
"""
#: SPDX names beside those above, of the licences that have versions only, or later ones.
_GNU = ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")
_TAGGED = tuple(f"{name}-{kind}" for name in _GNU for kind in ("only", "or-later"))
#: Titles of full texts, normalised, and the identifiers of their appendices.
_TITLES = (
    ("GPL-2.0", "gnu general public license version 2 june 1991", "gnu.free gpl.terms gnu2.later"),
    ("GPL-3.0", "gnu general public license version 3 29 june 2007", "gpl3.later"),
    ("LGPL-2.1", "gnu lesser general public license version 2 1 february 1999", "gnu.free lgpl.terms gnu21.later"),
    ("LGPL-3.0", "gnu lesser general public license version 3 29 june 2007", ""),
    ("AGPL-3.0", "gnu affero general public license version 3 19 november 2007", "agpl3.later"),
)
#: Licences by rules of identifiers in order.
_RULES = """
MIT: mit.grant mit.keep mit.as_is mit.liability
MIT: mit.grant mit.keep mit.as_is
MIT: mit.grant mit.keep
MIT: mit.grant
MIT: MIT.notice mit.as_is
ISC: isc.grant isc.as_is
ISC: isc.grant
0BSD: 0bsd.grant isc.as_is
0BSD: 0bsd.grant
BSD-4-Clause: bsd.grant bsd.source bsd.binary bsd.advertising bsd.name bsd.as_is
BSD-4-Clause: bsd.grant bsd.source bsd.binary bsd.advertising
BSD-3-Clause: bsd.grant bsd.source bsd.binary bsd.name bsd.as_is
BSD-3-Clause: bsd.grant bsd.source bsd.binary bsd.name
BSD-3-Clause: bsd.grant bsd.name
BSD-2-Clause: bsd.grant bsd.source bsd.binary bsd.as_is
BSD-2-Clause: bsd.grant bsd.source bsd.binary
BSD-2-Clause: bsd.grant
Apache-2.0: apache2.notice license.use license.obtain apache2.unless apache2.see
Apache-2.0: apache2.notice license.use apache2.obtain apache2.unless apache2.see
Apache-2.0: Apache-2.0.notice license.use license.obtain
Apache-2.0: Apache-2.0.notice license.use apache2.obtain
Apache-2.0: apache2.notice license.use license.obtain
Apache-2.0: apache2.notice license.use apache2.obtain
Apache-2.0: apache2.notice license.use
Apache-2.0: apache2.notice
Apache-2.0: apache2.title
Apache-2.0: apache2.obtain
GPL-2.0-or-later: gnu.free gpl.terms gnu2.later
GPL-3.0-or-later: gnu.free gpl.terms gnu3.later
GPL-2.0-only: gnu.free gpl2.terms
LGPL-2.1-or-later: gnu.free lgpl.terms gnu21.later
LGPL-3.0-or-later: gnu.free lgpl.terms gnu3.later
GPL-3.0-or-later: gnu.free gnu3.later
GPL-3.0-or-later: gpl3.later
GPL-3.0-only: gpl3.only
LGPL-3.0-or-later: lgpl3.later
AGPL-3.0-or-later: agpl3.later
MPL-2.0: mpl2.notice mpl2.obtain
MPL-2.0: mpl2.obtain
Unlicense: unlicense.free unlicense.anyone
Unlicense: unlicense.free
CC0-1.0: cc0.waived
Zlib: zlib.as_is zlib.grant zlib.altered
Zlib: zlib.grant
BSL-1.0: boost.grant
BSL-1.0: BSL-1.0.notice boost.see
EPL-2.0: epl2.notice
PostgreSQL: postgresql.grant
CDDL-1.0: cddl.notice license.use
CDDL-1.0: cddl.notice
MS-PL: mspl.governs mspl.accept
"""
#: What stands before a licence's name in a notice; rules that match only where no other has; a name that varies.
#: How a normalised SPDX tag begins; what parts its names; words that don't part them, and how they stand in for it.
_SPDX, _BETWEEN, _LATER = "spdx license identifier ", " (?:or|and|with) ", (" or later", " orlater")
_FRAMES = ("", "licensed under ", "released under ", "distributed under ", "available under ", "this work is licensed under ", "this project is licensed under ", "this software is licensed under ", "this file is licensed under ", "this software is released under ", "this program is licensed under ")
_ALONE = (("Proprietary", ("reserved",)),)
_VARIES = ("neither the name of ", "^neither the name of .+ nor the names of (?:its|their) contributors", "neither the name of the copyright holder nor the names of its contributors")


def _pairs(lines: str) -> list[tuple[str, str]]:
    return [(k, v) for k, _, v in (x.partition(": ") for x in lines.strip().split("\n"))]


def known_sentences() -> dict[str, str]:
    """Identifiers by normalised sentences: those of the texts, and notices of all names in all frames, or by SPDX tag."""
    out = {s: i for i, s in _pairs(_SENTENCES)}
    for name, called in _pairs(_NAMES):
        for frame in _FRAMES:
            for article in ("", "a ", "the ") if frame else ("", "the "):
                out.setdefault(f"{frame}{article}{called}", f"{name}.notice")
        out.setdefault(_tag(name), f"{name}.notice")
    out |= {_tag(name): f"{name}.notice" for name in _TAGGED}
    return out | {title: f"{name}.title" for name, title, _ in _TITLES}


def _tag(name: str) -> str:
    return _SPDX + re.sub("[^a-z0-9]+", " ", name.lower()).replace(*_LATER)


def licence_rules() -> tuple[tuple[str, tuple[str, ...]], ...]:
    """Licence and identifiers: the longest first, else in the order given, notices last."""
    own = [(name, tuple(ids.split(" "))) for name, ids in _pairs(_RULES)]
    for name, _, appendix in _TITLES:
        own += [(name, (f"{name}.title", *ids)) for ids in ([appendix.split(" "), ()] if appendix else [()])]
    own += [(name, (f"{name}.notice",)) for name in dict.fromkeys([*(n for n, _ in _pairs(_NAMES)), *_TAGGED])]
    return tuple(sorted(own, key=lambda r: -len(r[1])))


#: A part, within a word, of every known sentence, so that texts without any of them needn't be cut.
_HINT = r"(?i)licen[cs]e|redistribut|rights|permission|liable|advertising|software|either|mpl|cc0|spdx|[^a-z0-9]by[^a-z0-9]"
_CUTS = ((r"\]\([^)\s]*\)", "]"), (r"\r\n?", "\n"), (r"\n(?:[^A-Za-z0-9\n]*\n)+", "\x01"), (r"([.!?;])[\"')\]]*[ \t\n\x01]+", "\\1\x01"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sentences(text: Column) -> Column:
    """The sentences of a text as they stand in it, in order."""
    for pattern, by in _CUTS:
        text = F.regexp_replace(text, pattern, by.replace("\\1", "$1"))
    return F.split(text, "\x01")


def normalised(sentences: Column) -> Column:
    """The sentences of an array, normalised; one expression after another, so that each is evaluated once."""
    plain = F.transform(sentences, lambda s: F.regexp_replace(F.trim(F.regexp_replace(F.translate(s, _UPPER, _LOWER), "[^a-z0-9]+", " ")), "^[0-9]{1,2} ", ""))
    return F.transform(plain, lambda s: F.when(F.startswith(s, F.lit(_VARIES[0])), F.regexp_replace(s, _VARIES[1], _VARIES[2])).otherwise(s))


def _named(sentence: Column) -> Column:
    """A normalised sentence as it is, an SPDX tag as one for each name."""
    names = F.split(F.replace(F.substring(sentence, len(_SPDX) + 1, 1 << 30), *map(F.lit, _LATER)), _BETWEEN)
    return F.when(F.startswith(sentence, F.lit(_SPDX)), F.transform(names, lambda x: F.concat(F.lit(_SPDX), x))).otherwise(F.array(sentence))


def _constant(value, kind: str) -> Column:
    """A constant array or map, made by one expression, which the optimiser folds, in place of one for each value."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def scan(docs: DataFrame, known: dict[str, str] | None = None, rules=None, alone=_ALONE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sentence_ids (known ones in order), first_at (place of the sentence with the first, from 0) and licenses (sorted)."""
    known, rules = known_sentences() if known is None else known, licence_rules() if rules is None else rules
    none = F.array().cast("array<string>")
    quoted = ", ".join("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in known) or "NULL"
    # A look into a hash set; the map is searched for known sentences alone.
    only_known = lambda column: F.expr(f"transform({column}, own -> filter(own, x -> x IN ({quoted})))")

    df = id_and_text(docs, id_col, text_col)
    df = df.select("doc_id", F.when(F.col("text").rlike(_HINT), sentences(F.col("text"))).otherwise(none).alias("own"))
    df = df.select("doc_id", "own", F.transform(normalised(F.col("own")), _named).alias("named"))
    df = df.select("doc_id", "own", only_known("named").alias("whole"))
    by_line = lambda s, i: F.when((F.size(F.get("whole", i)) == 0) & F.contains(s, F.lit("\n")), F.flatten(F.transform(normalised(F.split(s, "\n")), _named))).otherwise(none)
    df = df.select("doc_id", "whole", F.transform("own", by_line).alias("lines"))
    df = df.select("doc_id", F.zip_with("whole", only_known("lines"), lambda a, b: F.concat(a, b)).alias("found"))
    table = _constant(known, "map<string, string>")
    df = df.select("doc_id", F.transform(F.flatten("found"), lambda x: F.element_at(table, x)).alias("sentence_ids"), F.array_position(F.transform("found", lambda x: F.size(x) > 0), F.lit(True)).alias("at"))
    line = F.concat(F.lit(","), F.array_join("sentence_ids", ",,"), F.lit(","))
    steps = _constant([{"ids": _pattern(i), "name": name, "alone": last} for last, own in ((False, rules), (True, alone)) for name, i in own], "array<struct<ids: string, name: string, alone: boolean>>")
    start = F.struct(line.alias("line"), none.alias("licenses"))
    fits = lambda acc, r: F.contains(acc["line"], r["ids"]) & (~r["alone"] | (F.size(acc["licenses"]) == 0))
    taken = lambda acc, r: F.struct(F.replace(acc["line"], r["ids"], F.lit(",.,")).alias("line"), F.array_append(acc["licenses"], r["name"]).alias("licenses"))
    all_rules = F.aggregate(steps, start, lambda acc, r: F.when(fits(acc, r), taken(acc, r)).otherwise(acc))["licenses"]
    licenses = F.when(F.size("sentence_ids") > 0, F.array_sort(F.array_distinct(all_rules))).otherwise(none)
    return df.select("doc_id", "sentence_ids", (F.nullif("at", F.lit(0)) - 1).alias("first_at"), licenses.alias("licenses"))


def _pattern(ids) -> str:
    return "".join(f",{i}," for i in ids)


def _sql() -> str:
    rules = licence_rules()
    values = ", ".join(f"('{k}', '{v}')" for k, v in known_sentences().items())
    norm = lambda x: f"regexp_replace(trim(regexp_replace(translate({x}, '{_UPPER}', '{_LOWER}'), '[^a-z0-9]+', ' ', 'g')), '^[0-9]{{1,2}} ', '')"
    fixed = lambda x: f"CASE WHEN starts_with({x}, '{_VARIES[0]}') THEN regexp_replace({x}, '{_VARIES[1]}', '{_VARIES[2]}') ELSE {x} END"
    named = lambda x: f"CASE WHEN starts_with({x}, '{_SPDX}') THEN list_transform(string_split_regex(replace(substr({x}, {len(_SPDX) + 1}), '{_LATER[0]}', '{_LATER[1]}'), '{_BETWEEN}'), lambda t: '{_SPDX}' || t) ELSE [{x}] END"
    cut = "coalesce(text, '')"
    for pattern, by in _CUTS:
        quoted = pattern.replace("'", "''")
        target = "'\\1' || chr(1)" if "\\1" in by else "chr(1)" if by == "\x01" else "chr(10)" if by == "\n" else f"'{by}'"
        cut = f"regexp_replace({cut}, '{quoted}', {target}, 'g')"
    took = "".join(f", replace(l{k}, '{_pattern(i)}', ',.,') AS l{k + 1}" for k, (_, i) in enumerate(rules))
    names = ", ".join(f"CASE WHEN contains(l{k}, '{_pattern(i)}') THEN '{name}' END" for k, (name, i) in enumerate(rules))
    last = ", ".join(f"CASE WHEN contains(l{len(rules)}, '{_pattern(i)}') THEN '{name}' END" for name, i in _ALONE)
    return rf"""
WITH known(s, id) AS (VALUES {values}),
c AS (SELECT doc_id, string_split({cut}, chr(1)) AS own FROM documents),
e AS (SELECT doc_id, unnest(own) AS raw, generate_subscripts(own, 1) AS p FROM c),
n AS (SELECT doc_id, p, raw, {norm("raw")} AS s FROM e),
w AS (SELECT doc_id, p, raw, {named(fixed("s"))} AS names FROM n),
v AS (SELECT doc_id, p, 0 AS q, r, id FROM (SELECT doc_id, p, unnest(names) AS s, generate_subscripts(names, 1) AS r FROM w) JOIN known USING (s)),
x AS (SELECT doc_id, p, unnest(string_split(raw, chr(10))) AS line, generate_subscripts(string_split(raw, chr(10)), 1) AS q FROM w ANTI JOIN v USING (doc_id, p) WHERE contains(raw, chr(10))),
y AS (SELECT doc_id, p, q, {norm("line")} AS s FROM x),
l AS (SELECT doc_id, p, q, {named(fixed("s"))} AS names FROM y),
z AS (SELECT doc_id, p, q, r, id FROM (SELECT doc_id, p, q, unnest(names) AS s, generate_subscripts(names, 1) AS r FROM l) JOIN known USING (s) UNION ALL SELECT * FROM v),
g AS (SELECT doc_id, list(id ORDER BY p, q, r) AS ids, min(p) - 1 AS first_at FROM z GROUP BY doc_id),
f AS (SELECT *, ',' || array_to_string(ids, ',,') || ',' AS l0{took} FROM g),
r AS (SELECT doc_id, ids, first_at, list_filter([{names}], lambda x: x IS NOT NULL) AS named, list_filter([{last}], lambda x: x IS NOT NULL) AS rest FROM f)
SELECT d.doc_id, coalesce(array_to_string(ids, ','), '') AS sentence_ids, CAST(first_at AS BIGINT) AS first_at,
  coalesce(array_to_string(list_sort(list_distinct(CASE WHEN len(named) > 0 THEN named ELSE rest END)), ','), '') AS licenses
FROM documents d LEFT JOIN r USING (doc_id)
"""


#: The same rows in DuckDB's SQL; lists as text.
SQL = _sql()
