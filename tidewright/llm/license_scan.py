"""Licence scan by sentence rules (built-in functions only).

1. A text becomes one line of lower-case words with its breaks marked: ``|`` where
   a sentence or a paragraph ends, ``/`` where a line or a part of a sentence does. ``2.0`` is one word.
2. One expression finds the known sentences in it, from left to right: titles
   between two breaks; sentences of notices and bodies anywhere, also over line
   ends; notices such as "licensed under the MIT license or Apache License,
   Version 2.0" with every licence they name; and SPDX tags with whole expressions.
   A notice after "not", "never", "formerly", "previously" or "longer" names
   nothing.
3. Found sentences become identifiers by a map, and the sequence of a text's
   identifiers is matched against ordered rules.

The oracle SQL runs the same steps. Texts without any word of a set that every
known sentence draws on are passed over; the set is made from the sentences.
Everything is an expression over one row: no shuffle, and a text of any length is
handled whole.

Defined cases: a null or empty text has no sentences and matches nothing; a
licence named twice counts twice in ``n_sentences`` and once in ``licenses``; in
an SPDX expression ``AND`` and ``OR`` name both sides, ``+`` means "or later" and
what follows ``WITH`` names nothing; repeated rows give equal rows; other columns
of the input are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences that stand alone on a line or between full stops -> identifier.
TITLES = {
    "MIT License": "MIT_TITLE",
    "The MIT License": "MIT_TITLE",
    "The MIT License (MIT)": "MIT_TITLE",
    "Apache License": "APACHE_TITLE",
    "Version 2.0, January 2004": "APACHE2_DATE",
    "GNU General Public License": "GPL_TITLE",
    "GNU Lesser General Public License": "LGPL_TITLE",
    "GNU Affero General Public License": "AGPL_TITLE",
    "Version 3, 29 June 2007": "GPL3_DATE",
    "Version 2, June 1991": "GPL2_DATE",
    "Version 2.1, February 1999": "LGPL21_DATE",
    "Version 3, 19 November 2007": "AGPL3_DATE",
}

# Sentences of notices and bodies, found anywhere -> identifier.
BODIES = {
    "All rights reserved": "RIGHTS",
    "CC0 1.0 Universal": "CC0",
    "GNU General Public License as published by the Free Software Foundation, either version 3 of the License": "GPL3_LATER",
    "GNU General Public License as published by the Free Software Foundation, either version 2 of the License": "GPL2_LATER",
    "GNU General Public License as published by the Free Software Foundation, version 3": "GPL3_ONLY",
    "GNU General Public License as published by the Free Software Foundation, version 2": "GPL2_ONLY",
    "GNU General Public License version 3 as published by the Free Software Foundation": "GPL3_ONLY",
    "GNU General Public License version 2 as published by the Free Software Foundation": "GPL2_ONLY",
    "GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License": "LGPL3_LATER",
    "GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License": "LGPL21_LATER",
    "GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License": "AGPL3_LATER",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0": "MPL2",
    "Mozilla Public License Version 2.0": "MPL2",
    "Eclipse Public License v 2.0": "EPL2",
    "Eclipse Public License version 2.0": "EPL2",
    "Boost Software License - Version 1.0": "BSL1",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files": "MIT_GRANT",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software": "MIT_NOTICE",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer": "BSD_SOURCE",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution": "BSD_BINARY",
    "may be used to endorse or promote products derived from this software without specific prior written permission": "BSD_ENDORSE",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "ISC_GRANT",
    "provided that the above copyright notice and this permission notice appear in all copies": "ISC_NOTICE",
    "This software is provided 'as-is', without any express or implied warranty": "ZLIB_WARRANTY",
    "Altered source versions must be plainly marked as such": "ZLIB_MARKED",
    "This is free and unencumbered software released into the public domain": "UNLICENSE",
}

# Names of licences in notices ("licensed under ...") -> identifier. Longer names are tried first.
NAMES = {
    "Apache License, Version 2.0": "APACHE2",
    "Apache License 2.0": "APACHE2",
    "Apache 2.0 license": "APACHE2",
    "MIT license": "MIT",
    "GNU General Public License, version 3": "GPL3_ONLY",
    "GNU General Public License v3": "GPL3_ONLY",
    "GNU GPL version 3": "GPL3_ONLY",
    "GNU GPLv3": "GPL3_ONLY",
    "GPLv3": "GPL3_ONLY",
    "GPL v3": "GPL3_ONLY",
    "GPL version 3": "GPL3_ONLY",
    "GNU General Public License, version 2": "GPL2_ONLY",
    "GNU General Public License v2": "GPL2_ONLY",
    "GNU GPL version 2": "GPL2_ONLY",
    "GNU GPLv2": "GPL2_ONLY",
    "GPLv2": "GPL2_ONLY",
    "GPL v2": "GPL2_ONLY",
    "GPL version 2": "GPL2_ONLY",
    "GNU Lesser General Public License, version 3": "LGPL3_ONLY",
    "LGPLv3": "LGPL3_ONLY",
    "GNU Lesser General Public License, version 2.1": "LGPL21_ONLY",
    "LGPLv2.1": "LGPL21_ONLY",
    "GNU Affero General Public License, version 3": "AGPL3_ONLY",
    "AGPLv3": "AGPL3_ONLY",
    "CC BY 4.0": "CCBY4",
    "CC BY-NC 4.0": "CCBYNC4",
    "CC BY-SA 4.0": "CCBYSA4",
    "Creative Commons Attribution 4.0 International license": "CCBY4",
    "Creative Commons Attribution-NonCommercial 4.0 International license": "CCBYNC4",
    "Creative Commons Attribution-ShareAlike 4.0 International license": "CCBYSA4",
    "Mozilla Public License 2.0": "MPL2",
    "Mozilla Public License, v. 2.0": "MPL2",
    "Mozilla Public License, version 2.0": "MPL2",
    "BSD 3-Clause license": "BSD3",
    "3-Clause BSD license": "BSD3",
    "BSD 2-Clause license": "BSD2",
    "2-Clause BSD license": "BSD2",
    "ISC license": "ISC",
    "zlib license": "ZLIB",
    "Unlicense": "UNLICENSE",
}

# SPDX short identifiers -> identifier. A version without "only" or "or later" is the older spelling of "only".
SPDX = {
    "0BSD": "0BSD",
    "AGPL-3.0": "AGPL3_ONLY",
    "AGPL-3.0-only": "AGPL3_ONLY",
    "AGPL-3.0-or-later": "AGPL3_LATER",
    "Apache-2.0": "APACHE2",
    "BSD-2-Clause": "BSD2",
    "BSD-3-Clause": "BSD3",
    "BSL-1.0": "BSL1",
    "CC-BY-4.0": "CCBY4",
    "CC-BY-NC-4.0": "CCBYNC4",
    "CC-BY-SA-4.0": "CCBYSA4",
    "CC0-1.0": "CC0",
    "EPL-2.0": "EPL2",
    "GPL-2.0": "GPL2_ONLY",
    "GPL-2.0-only": "GPL2_ONLY",
    "GPL-2.0-or-later": "GPL2_LATER",
    "GPL-3.0": "GPL3_ONLY",
    "GPL-3.0-only": "GPL3_ONLY",
    "GPL-3.0-or-later": "GPL3_LATER",
    "ISC": "ISC",
    "LGPL-2.1": "LGPL21_ONLY",
    "LGPL-2.1-only": "LGPL21_ONLY",
    "LGPL-2.1-or-later": "LGPL21_LATER",
    "LGPL-3.0": "LGPL3_ONLY",
    "LGPL-3.0-only": "LGPL3_ONLY",
    "LGPL-3.0-or-later": "LGPL3_LATER",
    "MIT": "MIT",
    "MPL-2.0": "MPL2",
    "Unlicense": "UNLICENSE",
    "Zlib": "ZLIB",
}

# Licence -> sequences of identifiers; any one of them names the licence.
RULES = {
    "Apache-2.0": [["APACHE2"], ["APACHE_TITLE", "APACHE2_DATE"]],
    "MIT": [["MIT"], ["MIT_TITLE", "MIT_NOTICE"], ["MIT_GRANT", "MIT_NOTICE"]],
    "CC-BY-NC-4.0": [["CCBYNC4"]],
    "CC-BY-4.0": [["CCBY4"]],
    "CC-BY-SA-4.0": [["CCBYSA4"]],
    "CC0-1.0": [["CC0"]],
    "AGPL-3.0": [["AGPL_TITLE", "AGPL3_DATE"]],
    "AGPL-3.0-only": [["AGPL3_ONLY"]],
    "AGPL-3.0-or-later": [["AGPL3_LATER"]],
    "LGPL-3.0": [["LGPL_TITLE", "GPL3_DATE"]],
    "LGPL-3.0-only": [["LGPL3_ONLY"]],
    "LGPL-3.0-or-later": [["LGPL3_LATER"]],
    "LGPL-2.1": [["LGPL_TITLE", "LGPL21_DATE"]],
    "LGPL-2.1-only": [["LGPL21_ONLY"]],
    "LGPL-2.1-or-later": [["LGPL21_LATER"]],
    "GPL-3.0": [["GPL_TITLE", "GPL3_DATE"]],
    "GPL-3.0-only": [["GPL3_ONLY"]],
    "GPL-3.0-or-later": [["GPL3_LATER"]],
    "GPL-2.0": [["GPL_TITLE", "GPL2_DATE"]],
    "GPL-2.0-only": [["GPL2_ONLY"]],
    "GPL-2.0-or-later": [["GPL2_LATER"]],
    "MPL-2.0": [["MPL2"]],
    "EPL-2.0": [["EPL2"]],
    "BSL-1.0": [["BSL1"]],
    "BSD-3-Clause": [["BSD3"], ["BSD_SOURCE", "BSD_BINARY", "BSD_ENDORSE"]],
    "BSD-2-Clause": [["BSD2"], ["BSD_SOURCE", "BSD_BINARY"]],
    "ISC": [["ISC"], ["ISC_GRANT", "ISC_NOTICE"]],
    "0BSD": [["0BSD"], ["ISC_GRANT"]],
    "Zlib": [["ZLIB"], ["ZLIB_WARRANTY", "ZLIB_MARKED"]],
    "Unlicense": [["UNLICENSE"]],
    "all-rights-reserved": [["RIGHTS"]],
}
#: A rule gives way to rules whose sequences hold its own; a licence's text to the notice that says which versions hold.
YIELDS = {"BSD-2-Clause": ["BSD-3-Clause"], "0BSD": ["ISC"]} | {x: [f"{x}-only", f"{x}-or-later"] for x in ("AGPL-3.0", "LGPL-3.0", "LGPL-2.1", "GPL-3.0", "GPL-2.0")}

#: Steps that make a text the line that patterns run over: pattern and replacement, where ``\1`` is the first group.
STEPS = (
    (r"([a-z]-[0-9][0-9.]*)\+", r"\1-or-later"),
    (r"[|/]", " "),
    (r"\r\n?", "\n"),
    (r"\bv\. ?([0-9])", r"v \1"),
    (r"([0-9])\.([0-9])", r"\1p\2"),
    (r"([0-9])\.([0-9])", r"\1p\2"),
    (r"\n(?:[^a-z0-9\n]*\n)+", "|"),
    (r"[!?]", "|"),
    (r"\.(\s)", r"|\1"),
    (r"[;\n]", "/"),
    (r"[^a-z0-9|/]+", " "),
    (r"[ /]*\|[ |/]*", " | | "),
    (r" ?/[ /]*", " / / "),
)
#: Between two words of a sentence, and any one break.
GAP, EDGE = " (?:/ / )?", "[|/]"
NEGATED = "(?:not|never|formerly|previously|longer)"
LEAD = "(?:licensed|released|distributed|available)"
LATER = " or (?:at your option )?(?:any )?later(?: version)?"


def line(text: str) -> str:
    """The line that patterns run over, of one text."""
    text = (text + "\n").lower()
    for pattern, value in STEPS:
        text = re.sub(pattern, value, text)
    return f"/ {text} /"


def normal(sentence: str) -> str:
    """The words of a known sentence as they stand in a line."""
    return line(sentence).strip("/| ")


def _any(sentences: Iterable[str], gap: str = GAP) -> str:
    """Any of the sentences, longer ones first."""
    return "(?:" + "|".join(gap.join(x.split()) for x in sorted(set(sentences), key=lambda x: (-len(x), x))) + ")"


class Known:
    """Titles, bodies and names in the form that lines have, and the patterns made of them."""

    def __init__(self, titles: dict[str, str], bodies: dict[str, str], names: dict[str, str], spdx: dict[str, str]) -> None:
        form = lambda table: {normal(k): v for k, v in table.items()}
        self.whole, self.named = form(titles) | form(bodies), form(names) | form(spdx)
        for x, tag in list(form(names).items()):
            if tag.endswith("_ONLY"):
                self.named |= {f"{x} {tail}": tag.removesuffix("_ONLY") + "_LATER" for tail in ("or later", "or any later version", "or later version", "or at your option any later version", "or any later")}
        parts = []
        if titles:
            parts.append(f"{EDGE} {_any(form(titles), ' ')} {EDGE}")
        if names:
            name = f"(?:the{GAP})?{_any(self.named)}"
            lead = GAP.join([LEAD, "under"]) + f"(?:{GAP}either{GAP}of)?(?:{GAP}(?:the|a|an))?(?:{GAP}terms{GAP}of)?(?:{GAP}(?:the|either))?"
            parts.append(rf"(?:\b{NEGATED}{GAP}(?:dual{GAP})?)?\b{lead}{GAP}{name}\b(?:{GAP}(?:or|and|and or){GAP}{name}\b)*")
        if spdx:
            one = rf"{_any(form(spdx), ' ')}(?: with [a-z0-9]+(?: (?:exception|[0-9]+p?[0-9]*|note|syscall))*)?"
            other = r"licenseref(?: [a-z0-9]+)+?"
            parts.append(rf"\bspdx license identifier (?:{one}|{other})(?: (?:or|and) (?:{one}|{other}))* [a-z|/]")
        if bodies:
            parts.append(rf"\b{_any(form(bodies))}\b")
        self.pattern = "|".join(f"(?:{x})" for x in parts)
        self.name_pattern = rf"\b{_any(self.named, ' ')}\b" if self.named else ""
        self.hints = "|".join(_hints(self.whole)) + ("|spdx|" + LEAD + "[^a-z0-9]+under" if names or spdx else "")


def _hints(sentences: Iterable[str]) -> list[str]:
    """Few words of six letters or more, so that each sentence holds one of them (or else its longest word)."""
    left, out = [{w for w in x.split() if "p" not in w or not w[0].isdigit()} for x in sentences], []
    while left:
        seen = Counter(w for x in left for w in x if len(w) >= 6) or Counter(max(x, key=len) for x in left)
        # Words of few sentences are rare ones in other texts too; a word must still cover many here.
        out.append(max(seen, key=lambda w: (seen[w], len(w), w)))
        rest = [x for x in left if out[-1] not in x]
        if len(rest) == len(left):
            rest = left[1:]
        left = rest
    return out


KNOWN = Known(TITLES, BODIES, NAMES, SPDX)


def _line(text: Column) -> Column:
    text = F.lower(F.concat(text, F.lit("\n")))
    for pattern, value in STEPS:
        text = F.regexp_replace(text, pattern, re.sub(r"\\(\d)", r"$\1", value))
    return F.concat(F.lit("/ "), text, F.lit(" /"))


def scan(docs: DataFrame, sentences: dict[str, str] | None = None, rules: dict[str, list[list[str]]] | None = None) -> DataFrame:
    """doc_id, sentence_ids (in order), n_sentences, licenses (sorted), n_licenses.

    A rule matches when its identifiers occur in its order, other identifiers
    between them allowed, and no earlier rule that it yields to matches. With
    ``sentences``, those are the only ones, each between two breaks.
    """
    known = KNOWN if sentences is None else Known(sentences, {}, {}, {})
    rules = rules or RULES
    table = lambda d: F.create_map(*[F.lit(x) for pair in d.items() for x in pair])
    text = F.coalesce(F.col("text"), F.lit(""))
    found = F.regexp_extract_all(_line(text), F.lit(known.pattern), F.lit(0))
    hint = F.lower(text).rlike(known.hints)
    df = docs.select("doc_id", F.when(hint, found).otherwise(F.array().cast("array<string>")).alias("found"))
    # Without breaks, a found sentence is in the map, or a notice or tag that names licences.
    df = df.select("doc_id", F.transform("found", lambda s: F.trim(F.regexp_replace(s, "[|/ ]+", " "))).alias("found"))

    def ids(s: Column) -> Column:
        whole = F.try_element_at(table(known.whole), s)
        none = F.array().cast("array<string>")
        if not known.named:
            return F.array(whole)
        names = F.transform(F.regexp_extract_all(s, F.lit(known.name_pattern), F.lit(0)), lambda x: F.try_element_at(table(known.named), x))
        return F.when(whole.isNotNull(), F.array(whole)).when(s.rlike(f"^{NEGATED} "), none).otherwise(names)

    df = df.select("doc_id", F.array_compact(F.flatten(F.transform("found", ids))).alias("sentence_ids"))
    sequence = F.concat(F.lit(";"), F.array_join("sentence_ids", ";"), F.lit(";"))
    hits = {}
    for name, sequences in rules.items():
        hits[name] = F.lit(False)
        for steps in sequences:
            hits[name] |= sequence.rlike(";" + ";(?:[^;]+;)*".join(map(re.escape, steps)) + ";")
    named = []
    for name in sorted(hits):
        stronger = [hits[x] for x in YIELDS.get(name, []) if x in hits]
        named.append(F.when(hits[name] & ~reduce(or_, stronger, F.lit(False)), F.lit(name)))
    df = df.select("doc_id", "sentence_ids", F.when(F.size("sentence_ids") > 0, F.array_compact(F.array(*named))).otherwise(F.array().cast("array<string>")).alias("licenses"))
    return df.select(
        "doc_id",
        F.size("sentence_ids").cast("long").alias("n_sentences"),
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.size("licenses").cast("long").alias("n_licenses"),
        F.array_join("licenses", ",").alias("licenses"),
    )
