"""Licence scans by sentence rules.

Texts are cut into sentences, normalised, and mapped to identifiers of known
licence sentences; the identifier sequence is then matched against ordered
rules, the first matching rule naming the licence.  A matched run of identifiers is
taken out of the sequence and later rules look at what is left, so that a text may
carry several licences.

The sentence and rule tables are fixed parameters of a few hundred rows, so they are
literals of the plan.

Defined cases: null or empty text has no sentences and licence ``NONE``; licence-like
sentences that no pattern knows, and those that deny, suppose or recall a licence, count as ``n_unknown`` and give
``UNKNOWN`` if no rule matches; texts of any length, with any number of sentences or comment marks, take time in proportion to
it; of rules that could take the same sentence the first does; repeated rows are scanned one by one; an empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import let, lower_ascii

#: An item number that may stand before a clause, and the ways to say "or later".
ITEM = r"(\(?[0-9a-z]{1,2}\) ?)?"
LATER = r"or \(?(at your option,?\)? )?any later version"
#: The head of a sentence that puts something under a licence; nothing but a short subject may stand before it.
TERMS = r"(the |a |an )?(terms (and conditions )?of )?(the |a |an )?"
GRANT = r"((\S+ ){1,6}(is|are) )?((also|hereby|freely|made|dual) )?(released|licensed|distributed|available|published|provided|covered|offered) under " + TERMS
#: A head of up to forty words, as in "you can redistribute it and/or modify it under ..".
PREFIX = r"(\S+ ){0,40}under " + TERMS
#: A sentence of ``GRANTS`` with one of these words denies, supposes or recalls the grant.
DENIAL = r"(^| )(not|no|never|neither|nor|none|nothing|nobody|cannot|isnt|arent|wasnt|werent|cant|wont|doesnt|if|when|whether|unless|unlike|was|were|formerly|previously|except|instead)( |,|$)"

#: GNU families, their names within the sentence, and their versions.
GNU = (("GPL", "general", ("3.0", "2.0", "1.0")), ("LGPL", "(lesser|library) general", ("3.0", "2.1", "2.0")), ("AGPL", "affero general", ("3.0", "1.0")))
#: Creative Commons kinds and how their long names go on after "attribution", the longest first.
COMMONS = (("BY-NC-SA", "-? ?non-?commercial-? ?share-? ?alike"), ("BY-NC-ND", "-? ?non-?commercial-? ?no-? ?deriv(ative)?s"), ("BY-NC", "-? ?non-?commercial"), ("BY-SA", "-? ?share-? ?alike"), ("BY-ND", "-? ?no-? ?deriv(ative)?s"), ("BY", ""))
COMMONS_VERSIONS = ("4.0", "3.0", "2.5", "2.0", "1.0")
#: Identifiers of SPDX tags, and the names they get where these differ.
SPDX = {
    **{x: x for x in ("Apache-2.0", "MIT", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "ISC", "Zlib", "BSL-1.0", "EPL-1.0", "EPL-2.0", "Unlicense", "MPL-2.0")},
    "CC0-1.0": "CC0",
    **{f"CC-{kind}-{v}": f"CC-{kind}-{v}" for kind, _ in COMMONS for v in COMMONS_VERSIONS},
    **{f"{name}-{v}{tail}": f"{name}-{v}{to}" for name, _, versions in GNU for v in versions for tail, to in (("", ""), ("-only", ""), ("-or-later", "-or-later"), ("+", "-or-later"))},
}


def _said(version: str) -> str:
    """A version as it stands in a normalised sentence; ``.0`` may lack."""
    whole, part = version.split(".")
    return f"{whole}( 0)?" if part == "0" else f"{whole} {part}"


def _gnu_sentences() -> list[tuple[str, str]]:
    later, plain, bare = [], [], []
    for name, words, versions in GNU:
        licence, fsf = f"gnu {words} public license,?( \\(\\w+\\))?", "as published by the free software foundation"
        for v in versions:
            n = _said(v)
            later.append((f"{name}-{v}+", f"{PREFIX}{licence} {fsf},? either version {n} of the license,? {LATER}.*"))
            later.append((f"{name}-{v}+", f"{GRANT}{licence}( version| v)? ?{n}(\\+|,? (or later|{LATER}))"))
            plain.append((f"{name}-{v}", f"{PREFIX}{licence} (version {n},? {fsf}|{fsf},? version {n}( of the license)?)"))
            plain.append((f"{name}-{v}", f"{GRANT}{licence}( version| v)? ?{n}( only)?( license)?"))
        bare.append((name, f"{PREFIX}gnu {words} public license( .*)?" if name != "GPL" else f"{GRANT}gnu general public license"))
    return later + plain + bare


def _commons_sentences() -> list[tuple[str, str]]:
    out = []
    for kind, tail in COMMONS:
        named = f"{GRANT}(cc[ -]{kind.lower()}|creative commons attribution{tail})( licen[sc]e)?,?( v| version)? ?"
        rest = r"( (international|unported|generic|\w+ \w+|\w+))?( public)?( licen[sc]e)?( \(?cc .*)?"
        out += [(f"CC-{kind}-{v}", f"{named}{v.replace('.', ' ')}{rest}") for v in COMMONS_VERSIONS]
        out.append((f"CC-{kind}", f"{GRANT}(cc[ -]{kind.lower()}|creative commons attribution{tail})( (public )?licen[sc]e)?"))
    return out


def _tag(name: str) -> str:
    """An SPDX tag as a normalised sentence."""
    return r"spdx-license-identifier \(?" + re.sub(r"\\?\.", " ", re.escape(name.lower()).replace(r"\-", "-")) + r"\)?( with \S+)?"


#: Identifier, and the normalised sentence as a whole-sentence pattern.  SPDX tags:
TAGS: tuple[tuple[str, str], ...] = tuple((f"SPDX:{name}", _tag(tag)) for tag, name in SPDX.items())
#: Sentences that grant; those that ``DENIAL`` finds a word in are unknown.
GRANTS: tuple[tuple[str, str], ...] = (
    ("ApacheV2", GRANT + r"apache license,? version 2( 0)?( \(?the license\)?)?( you may not use this \S+ except in compliance with the license)?"),
    ("MITname", GRANT + r"mit licen[sc]e( \(mit\))?"),
    *_gnu_sentences(),
    ("BSDname", GRANT + r"(new |modified |simplified |3-clause |2-clause )?bsd licen[sc]e"),
    ("ISCname", GRANT + r"isc licen[sc]e"),
    ("ZlibName", GRANT + r"zlib licen[sc]e"),
    ("BoostName", GRANT + r"boost software license,?( version| v)? ?1 0.*"),
    *[(f"EPL{v}", r"((\S+ ){1,12}(is|are) )?(made available|released|licensed|distributed|available) under " + TERMS + r"eclipse public license,?( -)?( version| v)? ?" + f"{v} 0.*") for v in (2, 1)],
    ("MPL2", r"((\S+ ){1,6}is )?subject to the terms of the mozilla public license,? v(ersion)? ?2( 0)?"),
    *_commons_sentences(),
    ("CC0", GRANT + r"(cc0|creative commons zero)( .*)?"),
)
#: What every one of them has.
GRANT_HINT = "under |mozilla"
#: All others.
SENTENCES: tuple[tuple[str, str], ...] = (
    ("ApacheV2", r"licensed under the apache license,? version 2( 0)?( \(?the license\)?)? you may not use this \S+ except in compliance with the license"),
    ("ApacheSee", r"you may obtain a copy of the license at( .*apache org.*)?"),
    ("ApacheURL", r"https? (www )?apache org licenses license-2 0( txt| html)?"),
    ("ApacheUse", r"you may not use this \S+ except in compliance with the license"),
    ("ApacheLaw", r"(https? (www )?apache org licenses license-2 0 )?unless required by applicable law or agreed to in writing,? software distributed under the license is distributed on an as is basis.*"),
    ("ApacheTerms", r"see the license for the specific language governing permissions and limitations( under the license)?"),
    ("MITtitle", r"(the )?mit license( \(mit\))?"),
    ("BoostPerm", r"permission is hereby granted,? free of charge,? to any person or organization obtaining a copy.*"),
    ("MITperm", r"permission is hereby granted,? free of charge,? to any person obtaining a copy.*"),
    ("MITnotice", r"the above copyright notice and this permission notice( \(.*\))? shall be included in all copies.*"),
    ("AsIs", r"the software is provided as is,? without warranty of any kind.*"),
    ("ISCperm", r"permission to use,? copy,? modify,? and (or )?distribute this software for any purpose with or without fee is hereby granted.*"),
    ("ISCdisclaim", r"the software is provided as is and the author disclaims all warranties.*"),
    ("ZlibPerm", r"permission is granted to anyone to use this software for any purpose,? including commercial applications.*"),
    ("Unlicense", r"this is free and unencumbered software released into the public domain.*"),
    ("CC0", r"(creative commons )?cc0 1 0( universal)?.*"),
    ("CC0", r"to the extent possible under law,? .* waived all copyright and related or neighbou?ring rights to .*"),
    ("GPLfree", r"this (program|library) is free software.*"),
    ("GPLhope", r".* is distributed in the hope that it will be useful,? but without any warranty.*"),
    ("GPLsee", r"see the gnu (lesser |library |affero )?general public license for more details"),
    ("GPLcopy", r"you should have received a copy of the gnu (lesser |library |affero )?general public license.*"),
    ("GPLurl", r"if not,? (see .*gnu org licenses.*|write to the free software foundation.*)"),
    ("LaterVersion", r".*either version \d( \d)? of the license,? " + LATER),
    ("BSDredist", r"redistribution and use in source and binary forms.*are permitted.*"),
    ("BSDsource", ITEM + r"redistributions of source code must retain .*copyright notice.*"),
    ("BSDbinary", ITEM + r"redistributions in binary form must reproduce .*copyright notice.*"),
    ("BSDadvert", ITEM + r"all advertising materials mentioning features or use of this software must display.*"),
    ("BSDdisclaim", r"this software is provided (by .* )?as is,? and (without )?any express(ed)? or implied warrant.*"),
    ("Liable", r"in no event shall .* be liable.*"),
    ("BSDendorse", ITEM + r"(neither )?the names? .*(may|must)( not)? be used to endorse.*"),
    ("AllRights", r"((copyright|\(c\)|©)( \S+){0,20} )?all rights (are )?reserved( worldwide)?"),
    ("Copyright", r"(copyright|\(c\)|©).*"),
)

#: The clauses that tell the BSD licences apart, the longest first.
BSD_CLAUSES = (
    ("BSD-4-Clause", ("BSDredist", "BSDadvert", "BSDendorse")),
    ("BSD-3-Clause", ("BSDredist", "BSDendorse")),
    ("BSD-2-Clause", ("BSDredist",)),
)
_GNU_NAMES = [(name, v) for name, _, versions in GNU for v in versions]

#: Ordered rules; a rule is the identifier sequence that it takes out.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    *[(name, (f"SPDX:{name}",)) for name in dict.fromkeys(SPDX.values())],
    ("Apache-2.0", ("ApacheV2", "ApacheUse", "ApacheSee")),
    ("Apache-2.0", ("ApacheV2",)),
    ("MIT", ("AllRights", "MITperm", "MITnotice", "AsIs")),
    ("MIT", ("MITperm", "MITnotice", "AsIs")),
    ("MIT", ("MITname",)),
    *[(name, (*first, perm)) for name, perm in (("ISC", "ISCperm"), ("Zlib", "ZlibPerm"), ("BSL-1.0", "BoostPerm")) for first in (("AllRights",), ())],
    *[(name, (one,)) for name, one in (("ISC", "ISCname"), ("Zlib", "ZlibName"), ("BSL-1.0", "BoostName"), ("EPL-2.0", "EPL2"), ("EPL-1.0", "EPL1"), ("Unlicense", "Unlicense"))],
    *[(f"{n}-{v}-or-later", run) for n, v in _GNU_NAMES for run in ((f"{n}-{v}+",), (f"{n}-{v}", "LaterVersion"))],
    *[(f"{n}-{v}", (f"{n}-{v}",)) for n, v in _GNU_NAMES],
    *[(name, (name,)) for name, _, _ in GNU],
    *[(name, (*first, *clauses, last)) for name, clauses in BSD_CLAUSES for first in (("AllRights",), ()) for last in ("AsIs", "BSDdisclaim")],
    ("BSD", ("BSDname",)),
    ("MPL-2.0", ("MPL2",)),
    *[(name, (name,)) for name, _ in _commons_sentences()],
    ("CC0", ("CC0",)),
    ("Proprietary", ("AllRights",)),
)

#: Identifiers that may stand between those of a rule: unknown sentences, notices, and clauses that all variants have.
BETWEEN = ("?", "Copyright", "AllRights", "BSDsource", "BSDbinary")

#: What normalising drops, turns into one space, and drops at the head.
MARKS = r"[\"'`*#;|<>{}\[\]$%&“”‘’]+"
GAPS = r"[\s./:_]+"
HEAD = r"^[^a-z0-9(©]+"

#: A sentence without any of these can't be a licence sentence.
HINT = r"licen[sc]|copyright|\(c\)|©|permission|warranty|all rights reserved|all rights are reserved|redistribution|free software|public domain|unencumbered|cc0|endorse|any later version|advertising materials|creative commons"

#: Comment marks at a line's head, and at its end, where the line is read backwards.  Repeats are possessive, so that Java neither
#: recurses nor goes back over a line of nothing but marks.
OPENING = r"^\s*+(?:(?://++|/\*++|\*++/?+|#++|--++|;++|%++|<!--++|\"{3}|'{3}|[>|!]|(?i:rem|dnl)(?:\s|$))\s*+)++"
CLOSING_BACKWARDS = r"^\s*+(?:/\*++|>--++|[*#|]++|\"{3}|'{3})\s*+"

#: Words that open a known sentence, so that the line end before them is no wrapping.
OPENERS = (
    r"(this \S+ is )?(released|licensed|distributed) under |you may (not use this|obtain a copy of the license)|unless required by applicable law|see the license for"
    r"|permission is (hereby )?granted|permission to use|the above copyright notice and|(the|this) software is provided|in no event shall|this \S+ is (free software|distributed in the hope)"
    r"|you should have received|redistribution and use in|redistributions (of source|in binary)|all advertising materials|neither the name|this source code form is"
    r"|spdx-license-identifier|this is free and unencumbered|this program and the accompanying materials"
)

#: "Copyright" heads a notice unless the sentence around it goes on.
NO_NOTICE = r"^copyright( *,| (notice|holder|owner|law|and|or|in|to|statement|licen[sc]e|disclaimer)\b)"
NOTICE = r"^(copyright|\(c\) .*\d{4}|©)"


def _either(patterns: list[str], tail: str = "$") -> str:
    return f"^(?:{'|'.join(f'(?:{p})' for p in dict.fromkeys(patterns))}){tail}"


#: Whole-line patterns whose head, or whose end, is that of a sentence.
TAGGED = "spdx-license-identifier .*"
STARTS = _either([p for n, p in GRANTS + SENTENCES if not p.startswith((".*", "(.*", PREFIX)) and n != "Copyright"] + [TAGGED])
ENDS = _either([p for n, p in GRANTS + SENTENCES if not p.endswith((".*", ".*)?"))] + [TAGGED])
#: The first operator of a tag's expression.
OPERATOR = r"(?i)(spdx-license-identifier:)[ \t]*\(?([0-9a-z.+-]+)\)?[ \t]+(?:or|and)[ \t]+"


def notice(line: Column) -> Column:
    """Whether a normalised line is a copyright notice."""
    return line.rlike(NOTICE) & ~line.rlike(NO_NOTICE)


def unwrapped(text: Column) -> Column:
    """The text with its comment marks dropped and its wrapped lines joined.

    A line end stays where a line without a word, or one that begins or ends a known sentence, stands beside it.
    """

    def line(raw: Column) -> Column:
        def placed(bare: Column) -> Column:
            said = normalised(F.regexp_replace(bare, r"[.!?]\s*+$", ""))

            def joined(s: Column) -> Column:
                hinted = bare.rlike(f"(?i){HINT}")
                before = F.when(s.rlike(f"^(?:{OPENERS})") | (hinted & (notice(s) | s.rlike(STARTS))), F.lit("\n")).otherwise(F.lit(""))
                after = F.when(hinted & (notice(s) | s.rlike(ENDS)), F.lit("\n")).otherwise(F.lit(" "))
                return F.concat(before, bare, after)

            return F.when(bare.rlike(r"[\p{L}\p{N}]"), let(said, joined)).otherwise(F.lit("\n"))

        opened = F.regexp_replace(raw, OPENING, "")
        return let(F.reverse(F.regexp_replace(F.reverse(opened), CLOSING_BACKWARDS, "")), placed)

    return F.array_join(F.transform(F.split(text, r"\r\n|\r|\n"), line), "")


def sentences(text: Column) -> Column:
    """Sentences of the unwrapped text: cut at the line ends that stay, at ``. ! ?`` before white space or the end
    (but not in ``v. 2`` or ``A. Person``), where conditions are announced, and at the first three operators of an SPDX tag."""
    cut = F.regexp_replace(unwrapped(text), r"(?<!\b[A-Zv])\.(\s|$)|[!?](\s|$)|(?<=conditions|are met):\s", "\n")
    for _ in range(3):
        cut = F.regexp_replace(cut, OPERATOR, "$1 $2\n$1 ")
    return F.split(cut, r"\n+")


def normalised(sentence: Column) -> Column:
    """Lower-cased A-Z, quotes and comment marks dropped, dots and slashes as spaces, one space between words."""
    bare = F.regexp_replace(lower_ascii(sentence), MARKS, "")
    spaced = F.trim(F.regexp_replace(bare, GAPS, " "))
    return F.regexp_replace(spaced, HEAD, "")


def identifier(sentence: Column) -> Column:
    """The identifier of a normalised sentence: the first pattern that covers it, else ``?``."""

    def first(entries: tuple[tuple[str, str], ...]) -> Column:
        out = F.lit(None).cast("string")
        for name, pattern in reversed(entries):
            out = F.when(sentence.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(out)
        return out

    granted = F.when(sentence.rlike(GRANT_HINT) & ~sentence.rlike(DENIAL), first(GRANTS))
    return F.coalesce(F.when(sentence.contains("spdx-"), first(TAGS)), granted, first(SENTENCES), F.lit("?"))


#: One character an identifier, so that a sequence of them is a string and what may stand between is a class.
CODES = {name: chr(0xE100 + k) for k, name in enumerate(dict.fromkeys(["?", *[n for n, _ in TAGS + GRANTS + SENTENCES]]))}
GAP, TAKEN = "\ue000", "\ue001"


def apply_rules(ids: Column) -> Column:
    """``left, names`` after the ordered rules have taken their runs out of the coded identifiers.

    A row of identifiers of ``BETWEEN`` becomes one character first, ``AllRights`` if it holds that one and ``GAP`` if not, so that a
    rule is a fixed row of characters with at most one between two, and matching is one pass over the string.
    """
    codes = F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])
    rights, others = CODES["AllRights"], "".join(CODES[n] for n in BETWEEN if n != "AllRights")
    joined = F.array_join(F.transform(ids, lambda i: F.element_at(codes, i)), "")
    short = F.regexp_replace(F.regexp_replace(joined, f"[{others}]++", GAP), f"{GAP}?{rights}[{GAP}{rights}]*+", rights)
    state = F.struct(short.alias("left"), F.expr("cast(array() as array<string>)").alias("names"))
    rules = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(f"[{GAP}{rights}]?".join(CODES[i] for i in run)).alias("run")) for n, run in RULES])

    def step(acc: Column, rule: Column) -> Column:
        hit = F.rlike(acc.left, rule.run)
        return F.struct(
            F.when(hit, F.regexp_replace(acc.left, rule.run, F.lit(TAKEN))).otherwise(acc.left).alias("left"),
            F.when(hit, F.concat(acc.names, F.array(rule["name"]))).otherwise(acc.names).alias("names"),
        )

    return F.when(F.size(ids) > 0, F.aggregate(rules, state, step)).otherwise(state)


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row a document: ``id, licences, sentence_ids, n_licence_sentences, n_unknown``.

    Only sentences with a hint word are normalised and matched; a document without one
    costs a single pass of a pattern over its text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    hinted = F.filter(sentences(text), lambda s: s.rlike(f"(?i){HINT}"))
    some = F.when(text.rlike(f"(?i){HINT}"), F.transform(hinted, lambda s: let(normalised(s), identifier)))
    found = docs.select(F.col(id_col).alias("id"), F.coalesce(some, F.expr("cast(array() as array<string>)")).alias("ids"))
    ruled = found.withColumn("ruled", apply_rules(F.col("ids")))
    unknown = F.size(F.filter("ids", lambda i: i == "?"))
    none = F.when(F.size("ids") == 0, F.lit("NONE")).when(unknown > 0, F.lit("UNKNOWN")).otherwise(F.lit("NONE"))
    names = F.array_sort(F.array_distinct("ruled.names"))
    return ruled.select(
        "id",
        F.when(F.size("ruled.names") > 0, F.concat_ws(",", names)).otherwise(none).alias("licences"),
        F.concat_ws(",", "ids").alias("sentence_ids"),
        F.size("ids").cast("long").alias("n_licence_sentences"),
        unknown.cast("long").alias("n_unknown"),
    )
