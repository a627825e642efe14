"""Licence scan by sentence rules, in DataFrame functions alone.

Texts fall into sentences; a sentence that is known, once normalised, becomes its identifier; a rule is an
ordered sequence of identifiers, and a document has a licence where a rule's sequence stands among its known
sentences, nothing known between. Of rules that match, those whose place lies inside a longer match's are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Identifier -> the sentence, as it is after ``normal_sentence``.
SENTENCES: dict[str, str] = {
    "mit.released": "released under the mit license",
    "mit.licensed": "licensed under the mit license",
    "mit.grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mit.as_is": "the software is provided as is without warranty of any kind",
    "apache2.licensed": "licensed under the apache license version 2 0",
    "apache2.may_not": "you may not use this file except in compliance with the license",
    "apache2.obtain": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "gpl3.work": "this work is licensed under the gnu general public license version 3",
    "gpl3.free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 3",
    "gpl.hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "ccbync4.licensed": "licensed under cc by nc 4 0",
    "ccby4.licensed": "licensed under cc by 4 0",
    "bsd.redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "spdx.mit": "spdx license identifier mit",
    "spdx.apache2": "spdx license identifier apache 2 0",
    "any.rights": "all rights reserved",
}

#: In order of preference, rule -> licence and its sequence of sentences.
RULES: list[tuple[str, str, tuple[str, ...]]] = [
    ("mit-full", "MIT", ("mit.grant", "mit.as_is")),
    ("mit-grant", "MIT", ("mit.grant",)),
    ("mit-released", "MIT", ("mit.released",)),
    ("mit-licensed", "MIT", ("mit.licensed",)),
    ("mit-spdx", "MIT", ("spdx.mit",)),
    ("apache2-notice", "Apache-2.0", ("apache2.licensed", "apache2.may_not", "apache2.obtain")),
    ("apache2-short-notice", "Apache-2.0", ("apache2.licensed", "apache2.may_not")),
    ("apache2-line", "Apache-2.0", ("apache2.licensed",)),
    ("apache2-spdx", "Apache-2.0", ("spdx.apache2",)),
    ("gpl3-notice", "GPL-3.0", ("gpl3.free", "gpl.hope")),
    ("gpl3-free", "GPL-3.0", ("gpl3.free",)),
    ("gpl3-work", "GPL-3.0", ("gpl3.work",)),
    ("ccbync4-line", "CC-BY-NC-4.0", ("ccbync4.licensed",)),
    ("ccby4-line", "CC-BY-4.0", ("ccby4.licensed",)),
    ("bsd-conditions", "BSD", ("bsd.redistribution",)),
    ("reserved", "proprietary", ("any.rights",)),
]


_GNU = {"gpl": "gnu general public license", "lgpl": "gnu lesser general public license", "agpl": "gnu affero general public license"}
_GNU_VERSIONS = {("gpl", "2"): "GPL-2.0", ("gpl", "3"): "GPL-3.0", ("lgpl", "2 1"): "LGPL-2.1", ("lgpl", "3"): "LGPL-3.0", ("agpl", "3"): "AGPL-3.0"}
_SPDX = "MIT Apache-2.0 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later BSD-2-Clause BSD-3-Clause 0BSD ISC MPL-2.0 EPL-2.0 BSL-1.0 Zlib Unlicense CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-NC-ND-4.0".split()
_CC = {"": "CC-BY-4.0", " sharealike": "CC-BY-SA-4.0", " noncommercial": "CC-BY-NC-4.0", " noncommercial sharealike": "CC-BY-NC-SA-4.0", " noderivatives": "CC-BY-ND-4.0", " noncommercial noderivatives": "CC-BY-NC-ND-4.0"}


def _words(text: str) -> str:
    """``normal_sentence`` of a plain string."""
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split())


def _spdx_known() -> dict[str, str]:
    """Sentence -> identifier of each SPDX line that ``SENTENCES`` lacks."""
    named = {_words(f"spdx license identifier {x}"): f"spdx.{x.lower()}" for x in _SPDX}
    return {s: i for s, i in named.items() if s not in SENTENCES.values()}


def _notices() -> dict[str, str]:
    """Sentence -> identifier: the sentences of the canonical texts and headers."""
    out = {
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit.grant",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit.notice",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit.as_is",
        "licensed under the apache license version 2 0 the license": "apache2.licensed",
        "you may obtain a copy of the license at": "apache2.obtain",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc.grant",
        "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc.grant",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0bsd.grant",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd.source",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd.binary",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd.name",
        "this source code form is subject to the terms of the mozilla public license v": "mpl2.subject",
        "this is free and unencumbered software released into the public domain": "unlicense.free",
    }
    terms = "you can redistribute it and or modify it under the terms of the "
    for (k, v), _ in _GNU_VERSIONS.items():
        later = f"either version {v} of the license or at your option any later version"
        out[later] = f"gnu.either{v.replace(' ', '_')}"
        ident = f"{k}{v.replace(' ', '_')}.free"
        for lead in ("", "this program is free software ", "this library is free software "):
            by = f"{lead}{terms}{_GNU[k]} as published by the free software foundation"
            out[by] = f"{k}.terms"
            out[f"{by} {later}"] = out[f"{by} version {v} of the license"] = out[f"{lead}{terms}{_GNU[k]} version {v} as published by the free software foundation"] = ident
    for kind, licence in _CC.items():
        for article in ("a ", "the "):
            out[f"this work is licensed under {article}creative commons attribution{kind} 4 0 international license"] = licence.lower() + ".work"
    return out | _spdx_known()


def _notice_rules() -> list[tuple[str, str, tuple[str, ...]]]:
    bsd = [("bsd2-conditions", "BSD-2-Clause", ("bsd.redistribution", "bsd.source", "bsd.binary")), ("bsd3-conditions", "BSD-3-Clause", ("bsd.redistribution", "bsd.source", "bsd.binary", "bsd.name")), ("bsd-conditions", "BSD", ("bsd.redistribution",))]
    out = [("mit-text", "MIT", ("mit.grant", "mit.notice", "mit.as_is")), ("isc-grant", "ISC", ("isc.grant",)), ("0bsd-grant", "0BSD", ("0bsd.grant",)), ("mpl2-notice", "MPL-2.0", ("mpl2.subject",)), ("unlicense-text", "Unlicense", ("unlicense.free",))]
    out += bsd[:2] + [(f"{rule}-reserved", licence, ("any.rights", *s)) for rule, licence, s in bsd]
    for (k, v), licence in _GNU_VERSIONS.items():
        u = v.replace(" ", "_")
        if (k, v) != ("gpl", "3"):
            out.append((f"{k}{u}-free", licence, (f"{k}{u}.free",)))
        out.append((f"{k}{u}-notice-either", licence, (f"{k}.terms", f"gnu.either{u}")))
    out += [(f"{x.lower()}-work", x, (f"{x.lower()}.work",)) for x in _CC.values()]
    return out + [(f"{i[5:]}-spdx", next(x for x in _SPDX if x.lower() == i[5:]).removesuffix("-only").removesuffix("-or-later"), (i,)) for i in _spdx_known().values()]


#: Sentence -> identifier of the canonical texts and headers, and their rules, beside ``SENTENCES`` and ``RULES``, which the SQL holds.
NOTICES: dict[str, str] = _notices()
NOTICE_RULES: list[tuple[str, str, tuple[str, ...]]] = _notice_rules()
#: A line that is nobody's continuation: who holds the rights since when.
HOLDER = r"(?i)^[^a-z0-9]*(?:copyright[^a-z0-9]*(?:c[^a-z0-9]+)?[0-9]{4}|copyright[^a-z0-9]+c[^a-z0-9]|\(c\))"


def normal_sentence(sentence: Column) -> Column:
    """Lower case A-Z, all but letters and digits of ASCII to one space, no space at the ends."""
    lower = F.translate(sentence, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.btrim(F.regexp_replace(lower, "[^a-z0-9]+", " "))


def openings(sentences: list[str]) -> str:
    """A pattern found in every raw text that holds a known sentence: its first two words, parted as ``normal_sentence`` allows."""
    firsts: dict[str, set[str]] = {}
    for s in sentences:
        first, *rest = s.split()[:2]
        firsts.setdefault(first, set()).update(rest)
    return "(?i)(?<![A-Za-z0-9])(?:" + "|".join(f"{a}[^A-Za-z0-9]+(?:{'|'.join(sorted(b))})" for a, b in sorted(firsts.items())) + ")"


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, str, tuple[str, ...]]] = [*RULES, *NOTICE_RULES], notices: dict[str, str] = NOTICES) -> DataFrame:
    """``id, n_known, sentence_ids, licenses, rules`` of every row; narrow, no shuffle.

    A sentence ends at ``.``, ``!``, ``?`` or ``;`` before white space or at a line's end; it is compared whole. A line
    that is known, names a holder, ends with a mark or has no letter or digit stands alone; others go on in the next line. ``licenses`` is sorted and distinct, ``rules`` follows the rules' order. A null or empty text has
    none; null ids and repeated rows stay; columns other than id and text are not read. The
    sentences and rules are constants of the plan, and only texts that hold the first two words of one,
    whatever stands between them, are split.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    told = {s: i for i, s in sentences.items()} | notices
    name_of = F.create_map(*[F.lit(x) for s, i in told.items() for x in (s, i)])
    named = lambda s: F.try_element_at(name_of, normal_sentence(s))
    parts = F.split(text, "\\n|(?<=[.!?;])[\\x20\\x09-\\x0D]+")
    whole = lambda s: ~s.rlike("[A-Za-z0-9]") | s.rlike(r"[.!?;:][\x20\x09-\x0D]*$")
    lines = F.transform(parts, lambda s: F.when(named(s).isNotNull() | s.rlike(HOLDER), F.concat(F.lit("\n"), s, F.lit("\n"))).when(whole(s), F.concat(s, F.lit("\n"))).otherwise(F.concat(s, F.lit(" "))))
    joined = F.when(text.rlike(openings(list(told))), F.split(F.array_join(lines, ""), "\n"))
    known = F.filter(F.transform(joined, named), lambda x: x.isNotNull())
    df = docs.select(F.col(id_col), F.coalesce(known, F.array().cast("array<string>")).alias("sentence_ids"))
    chain = F.concat(F.lit("|"), F.array_join("sentence_ids", "||"), F.lit("|"))
    found = []
    for k, (rule, licence, sequence) in enumerate(rules):
        here = chain.contains("|" + "||".join(sequence) + "|")
        # A longer rule that holds this one's sequence and matches as often leaves nothing to this one.
        longer = [s for _, _, s in rules if len(s) > len(sequence) and any(s[i : i + len(sequence)] == sequence for i in range(len(s)))]
        if longer:
            times = lambda s: F.size(F.split(chain, F.lit("\\Q|" + "||".join(s) + "|\\E"))) - 1
            here = here & (times(sequence) > F.greatest(F.lit(0), *map(times, longer)))
        found.append(F.when(here, F.struct(F.lit(rule).alias("rule"), F.lit(licence).alias("licence"))))
    df = df.withColumn("found", F.array_compact(F.array(*found)))
    return df.select(
        id_col,
        F.size("sentence_ids").cast("long").alias("n_known"),
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda f: f["licence"]))), ",").alias("licenses"),
        F.array_join(F.transform("found", lambda f: f["rule"]), ",").alias("rules"),
    )
