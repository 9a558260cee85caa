"""Licence detection by ordered rules over recognised sentences, with DataFrame functions only.

A text is split into sentences at line ends, semicolons and at full stops, question or exclamation marks before white
space. A sentence is normalised (lower case, everything but letters and digits becomes one space) and looked up among
known licence sentences, which gives a short identifier. A rule is an ordered list of identifiers; it matches if the
identifiers occur in that order in the text's sequence, with other sentences allowed between. Sentences split off a
known one by its own full stop ("version 2.0") are not cut, as no white space follows the stop. "All rights reserved"
alone is proprietary; beside a sentence of a known notice it says nothing.

A known sentence may also be wrapped over lines: a run of lines is what neither a blank line, a semicolon nor a full stop
cuts, and from each of its lines the joined lines are looked up, the longest known sentence first; the search goes on
behind it. Comment and list marks and a list number before a sentence don't count. Few sentences have free words in them
(one to twelve); these have a pattern each, tried on joined lines only. Runs in which no line begins as a known sentence
does are dropped at once. SENTENCES and RULES are what the SQL states; WHOLE_SENTENCES and WHOLE_RULES add the wording of
the standard notices and identifier lines, which the SQL doesn't know, and wrapped sentences are outside it too.
n_sentences counts the unjoined sentences.

Null and empty texts have no sentences and match nothing. The work is per row: no shuffle, no Python, and texts of any
length are read whole. Other columns pass through, those named like a result are replaced, and names that begin with an
underscore are kept for the work.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import others, pin

#: Identifier -> normalised sentences that state it.
SENTENCES = {
    "mit-grant": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"],
    "mit-notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "as-is": ["the software is provided as is without warranty of any kind express or implied"],
    "apache2-name": ["licensed under the apache license version 2 0", "apache license version 2 0 january 2004"],
    "apache2-terms": ["you may not use this file except in compliance with the license", "you may obtain a copy of the license at http www apache org licenses license 2 0"],
    "apache2-warranty": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"],
    "gpl3-name": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "gnu general public license version 3 29 june 2007"],
    "gpl-free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"],
    "gpl-warranty": ["this program is distributed in the hope that it will be useful but without any warranty"],
    "cc-by-nc4": ["licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc-by4": ["licensed under cc by 4 0", "this work is licensed under cc by 4 0"],
    "bsd-redistribute": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd-binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd-endorse": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "all-rights": ["all rights reserved"],
}

#: Licence, ordered identifiers, whether the licence allows use for training.
RULES = [
    ("Apache-2.0", ["apache2-name"], True),
    ("BSD-2-Clause", ["bsd-redistribute", "bsd-source", "bsd-binary"], True),
    ("BSD-3-Clause", ["bsd-redistribute", "bsd-source", "bsd-binary", "bsd-endorse"], True),
    ("CC-BY-4.0", ["cc-by4"], True),
    ("CC-BY-NC-4.0", ["cc-by-nc4"], False),
    ("GPL-3.0", ["gpl3-name"], False),
    ("GPL-notice", ["gpl-free", "gpl-warranty"], False),
    ("MIT", ["mit-grant"], True),
    ("proprietary", ["all-rights"], False),
]

#: Sentences of a notice's own text. Beside one of these a copyright line is part of the notice and no licence.
NOTICES = ("mit-notice", "bsd-redistribute", "apache2-terms", "gpl-free", "gpl3-free")

#: Whole sentences of the standard notices; * stands for one to twelve words.
WHOLE_SENTENCES = {
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit-notice": ["the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software"],
    "as-is": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and non infringement"],
    "apache2-name": ["licensed under the apache license version 2 0 the license", "this project is licensed under the apache license version 2 0"],
    "apache2-terms": ["you may not use this file except in compliance with the license", "you may obtain a copy of the license at", "you may obtain a copy of the license at https www apache org licenses license 2 0"],
    "apache2-warranty": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "gpl3-free": [f"{who} is free software you can redistribute it and or modify it under the terms of the gnu general public license {what}" for who in ("this program", "*") for what in ("as published by the free software foundation either version 3 of the license or at your option any later version", "as published by the free software foundation version 3", "as published by the free software foundation version 3 of the license", "version 3 as published by the free software foundation")],
    "gpl-free": ["* is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "* is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"],
    "gpl3-version": ["either version 3 of the license or at your option any later version"],
    "gpl-warranty": ["* is distributed in the hope that it will be useful but without any warranty", "* is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "cc-by4": ["this work is licensed under a creative commons attribution 4 0 international license", "this work is licensed under the creative commons attribution 4 0 international license"],
    "cc-by-nc4": ["this work is licensed under the creative commons attribution noncommercial 4 0 international license"],
    "bsd-endorse": ["neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "neither the name of * nor the names of * may be used to endorse or promote products derived from this software without specific prior written permission", "the name of * may not be used to endorse or promote products derived from this software without specific prior written permission"],
    "isc-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "mpl2-name": ["mozilla public license version 2 0", "licensed under the mozilla public license version 2 0"],
    "mpl-form": ["this source code form is subject to the terms of the mozilla public license v"],
    "mpl-2-0": ["2 0"],
    "cc0": ["cc0 1 0 universal", "licensed under cc0 1 0", "this work is licensed under cc0 1 0", "to the extent possible under law * has waived all copyright and related or neighboring rights to *"],
    "cc-by-sa4": ["licensed under cc by sa 4 0", "this work is licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "this work is licensed under the creative commons attribution sharealike 4 0 international license"],
    "lgpl-free": ["you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "* is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "* is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version * of the license or at your option any later version"],
    "agpl-free": ["you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "* is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "* is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version * of the license or at your option any later version"],
    "bsd-as-is": ["this software is provided by * as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"],
}

#: Rules over the sentences that only WHOLE_SENTENCES knows, like RULES.
WHOLE_RULES = [
    ("GPL-3.0", ["gpl3-free", "gpl-warranty"], False),
    ("GPL-3.0", ["gpl-free", "gpl3-version", "gpl-warranty"], False),
    ("GPL-notice", ["gpl3-free", "gpl-warranty"], False),
    ("AGPL", ["agpl-free", "gpl-warranty"], False),
    ("CC-BY-SA-4.0", ["cc-by-sa4"], False),
    ("CC0-1.0", ["cc0"], True),
    ("ISC", ["isc-grant"], True),
    ("LGPL", ["lgpl-free", "gpl-warranty"], False),
    ("MPL-2.0", ["mpl2-name"], False),
    ("MPL-2.0", ["mpl-form", "mpl-2-0"], False),
    ("Unlicense", ["unlicense"], True),
]

#: Names of an identifier line, the licence that they mean, whether it allows use.
TAGS = [
    ("MIT", "MIT", True), ("Apache-2.0", "Apache-2.0", True), ("BSD-2-Clause", "BSD-2-Clause", True), ("BSD-3-Clause", "BSD-3-Clause", True), ("ISC", "ISC", True), ("Unlicense", "Unlicense", True), ("CC0-1.0", "CC0-1.0", True),
    ("CC-BY-4.0", "CC-BY-4.0", True), ("CC-BY-SA-4.0", "CC-BY-SA-4.0", False), ("CC-BY-NC-4.0", "CC-BY-NC-4.0", False), ("MPL-2.0", "MPL-2.0", False), ("GPL-3.0-only", "GPL-3.0", False), ("GPL-3.0-or-later", "GPL-3.0", False),
]


def _tag(name: str) -> str:
    return "spdx-" + name.lower()


WHOLE_SENTENCES |= {_tag(name): ["spdx license identifier " + " ".join(re.findall("[a-z0-9]+", name.lower()))] for name, _, _ in TAGS}
WHOLE_RULES += [(licence, [_tag(name)], free) for name, licence, free in TAGS]

_SPLIT = r"[\n\r;]+|(?<=[.!?])\s+"


_STOP = "\x01"
_GAP = r"(?: ?\n ?| )"


def _pattern(sentence: str, gap: str = _GAP) -> str:
    """A regular expression for a known sentence whose words are gap apart."""
    words = [w if w != "*" else rf"[\p{{L}}\p{{N}}]+(?:{gap}[\p{{L}}\p{{N}}]+){{0,11}}?" for w in sentence.split()]
    return gap.join(words)


def _known() -> list[tuple[str, str]]:
    """(sentence, identifier), longer sentences first."""
    pairs = {t: name for part in (WHOLE_SENTENCES, SENTENCES) for name, texts in part.items() for t in texts}
    return sorted(pairs.items(), key=lambda x: (-len(x[0]), x[0]))


def _begins(known: list[tuple[str, str]]) -> str:
    """A pattern of the runs that may hold a known sentence: its first two words at a line, or what follows leading free words."""
    first = sorted({" ".join(t.split()[:2]) for t, _ in known if t[0] != "*"})
    after = sorted({" ".join(t.split()[1:4]) for t, _ in known if t[0] == "*"})
    gapped = lambda words: "|".join(_pattern(w) for w in words)
    return rf"(?:^|\n)(?:\p{{N}}{{1,2}} )?(?:{gapped(first)})(?=[ \n]|$)|[ \n](?:{gapped(after)})[ \n]"


def _sentence_ids(text: Column) -> Column:
    """Identifiers of the recognised sentences, in order; a sentence begins and ends with a line or at a stop."""
    lines = F.replace(F.replace(F.lower(text), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    norm = F.regexp_replace(F.regexp_replace(lines, r";+|(?<=[.!?])\s+", _STOP), rf"[^\p{{L}}\p{{N}}\n{_STOP}]+", " ")
    norm = F.replace(F.replace(norm, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n"))
    known = _known()
    runs = F.filter(F.transform(F.split(norm, rf"{_STOP}|\n\n+"), lambda r: F.trim(r, F.lit(" \n"))), lambda r: r.rlike(_begins(known)))
    plain = F.create_map(*[F.lit(x) for t, i in known if "*" not in t for x in (t, i)])
    # no sentence has more lines than words
    most = max(len(t.split()) + 11 * t.split().count("*") for t, _ in known)

    def name(joined):
        free = [F.when(joined.rlike(f"^{_pattern(t, ' ')}$"), i) for t, i in known if "*" in t]
        return F.coalesce(F.try_element_at(plain, joined), F.coalesce(*free))

    def ids_of(run):
        rows = F.split(run, "\n")

        def longest(line, at):
            """(lines, identifier) of the longest known sentence that begins with a line."""
            def ending(n):
                joined = F.array_join(F.slice(rows, at + 1, n), " ")
                return F.struct(n.alias("n"), F.coalesce(name(F.regexp_replace(joined, r"^\p{N}{1,2} ", "")), name(joined)).alias("id"))

            return F.try_element_at(F.filter(F.transform(F.sequence(F.lit(1), F.least(F.size(rows) - at, F.lit(most)), F.lit(1)), ending), lambda x: x["id"].isNotNull()), F.lit(-1))

        found = F.transform(rows, lambda line, at: F.struct(at.alias("at"), F.when(F.concat(F.lit("\n"), F.array_join(F.slice(rows, at + 1, most), "\n")).rlike(_begins(known)), longest(line, at)).alias("hit")))
        start = F.struct(F.lit(0).alias("next"), F.array().cast("array<string>").alias("ids"))

        def take(state, row):
            fits = row["hit"].isNotNull() & (row["at"] >= state["next"])
            return F.struct(F.when(fits, row["at"] + row["hit"]["n"]).otherwise(state["next"]).alias("next"), F.when(fits, F.concat(state["ids"], F.array(row["hit"]["id"]))).otherwise(state["ids"]).alias("ids"))

        return F.aggregate(found, start, take, lambda state: state["ids"])

    return F.flatten(F.transform(runs, ids_of))


def license_scan(docs: DataFrame, text_col: str = "text", rules=(*RULES, *WHOLE_RULES)) -> DataFrame:
    """docs with n_sentences, sentence_ids (ordered), licenses (sorted names of matching rules) and permissive.

    permissive is null if nothing matches, else whether every matching licence allows use.
    """
    out = pin(docs, _parts=F.filter(F.split(F.coalesce(text_col, F.lit("")), _SPLIT, -1), lambda s: F.trim(s) != ""))
    out = pin(out, _ids=_sentence_ids(F.coalesce(text_col, F.lit(""))), _n=F.size("_parts").cast("long"))
    line = F.concat(F.lit(","), F.array_join("_ids", ",,"), F.lit(","))
    alone = ~line.rlike(f",({'|'.join(NOTICES)}),")
    hits = [F.when(line.rlike(".*?".join(f",{i}," for i in ids)) & (alone if ids == ["all-rights"] else F.lit(True)), F.struct(F.lit(name).alias("name"), F.lit(free).alias("free"))) for name, ids, free in rules]
    out = pin(out.drop("_parts"), _hits=F.filter(F.array(*hits), lambda x: x.isNotNull()))
    return out.select(
        *others(docs, "n_sentences", "sentence_ids", "licenses", "permissive"), F.col("_n").alias("n_sentences"), F.col("_ids").alias("sentence_ids"), F.array_sort(F.array_distinct(F.col("_hits.name"))).alias("licenses"),
        F.when(F.size("_hits") > 0, F.forall("_hits.free", lambda x: x)).alias("permissive"),
    )


def op8_license_scan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = license_scan(docs)
    return out.select("doc_id", "n_sentences", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"), "permissive")


def _sql() -> str:
    known = ",".join(f"('{t}','{name}')" for name, texts in SENTENCES.items() for t in texts)
    alone = lambda ids: f" AND NOT regexp_matches(line, ',({'|'.join(NOTICES)}),')" if ids == ["all-rights"] else ""
    cases = ",".join(f"CASE WHEN regexp_matches(line, '{'.*?'.join(f',{i},' for i in ids)}'){alone(ids)} THEN '{name}' END" for name, ids, _ in RULES)
    bad = ",".join(f"'{name}'" for name, _, free in RULES if not free)
    return f"""
WITH k(s, id) AS (VALUES {known}),
c AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(coalesce(text, ''), '[\\n\\r;]+', chr(1), 'g'), '([.!?])[ \\t\\n\\r\\f\\x0B]+', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM documents),
d AS (SELECT doc_id, list_filter(parts, lambda s: trim(s) <> '') AS parts FROM c),
u AS (SELECT doc_id, unnest(parts) AS s, generate_subscripts(parts, 1) AS i FROM d),
m AS (SELECT doc_id, list(k.id ORDER BY i) AS ids FROM (SELECT doc_id, i, trim(regexp_replace(lower(s), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS s FROM u) JOIN k USING (s) GROUP BY doc_id),
l AS (SELECT doc_id, len(parts) AS n, coalesce(ids, []) AS ids, ',' || array_to_string(coalesce(ids, []), ',,') || ',' AS line FROM d LEFT JOIN m USING (doc_id)),
r AS (SELECT *, list_sort(list_filter([{cases}], lambda x: x IS NOT NULL)) AS found FROM l)
SELECT doc_id, CAST(n AS BIGINT) AS n_sentences, array_to_string(ids, ',') AS sentence_ids, array_to_string(found, ',') AS licenses,
    CASE WHEN len(found) > 0 THEN NOT list_has_any(found, [{bad}]) END AS permissive FROM r
"""  # noqa: S608


SQL = _sql()
