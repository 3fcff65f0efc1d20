"""The signature rules of the licence scan.

Texts are matched as lower-case words with one space between them (see ``license_scan``), so patterns are
written over words: digits of "2.0" are the words ``2 0``. Each row of ``FAMILIES`` is one licence: label, keyword,
pattern of its name, its public short identifiers as words, and a link's words. Five
signatures come from each row by hand-written frames; ``TEXTS`` adds phrases of the licences' own texts.
Fixed values: public licence names, identifiers and phrases.
"""

from __future__ import annotations

from typing import NamedTuple

_V = "(?:version |v )?"

FAMILIES = [
    ("mit", "mit", "mit(?: x11)?", "mit", "opensource org licenses mit"),
    ("mit-0", "mit 0", "mit 0", "mit 0", "opensource org licenses mit 0"),
    ("apache-1.1", "apache", f"apache(?: software)?(?: license)? {_V}1 1", "apache 1 1", "apache org licenses license 1 1"),
    ("apache-2.0", "apache", f"apache(?: software)?(?: license)? {_V}2(?: 0)?", "apache 2 0", "apache org licenses license 2 0"),
    ("apache", "apache", "apache(?: software)?", "apache", "apache org licenses"),
    ("gpl-1.0", "general public", f"(?:gnu )?general public licen[sc]e {_V}1(?: 0)?", "gpl 1 0(?: only| or later)?", "gnu org licenses gpl 1 0"),
    ("gpl-2.0", "general public", f"(?:gnu )?general public licen[sc]e {_V}2(?: 0)?", "gpl 2 0(?: only| or later)?", "gnu org licenses gpl 2 0"),
    ("gpl-3.0", "general public", f"(?:gnu )?general public licen[sc]e {_V}3(?: 0)?", "gpl 3 0(?: only| or later)?", "gnu org licenses gpl 3 0"),
    ("gpl", "general public", "(?:gnu )?general public licen[sc]e", "gpl", "gnu org licenses gpl"),
    ("lgpl-2.0", "lgpl", f"lgpl {_V}2(?: 0)?", "lgpl 2 0(?: only| or later)?", "gnu org licenses lgpl 2 0"),
    ("lgpl-2.1", "lesser general", f"(?:gnu )?lesser general public licen[sc]e {_V}2 1", "lgpl 2 1(?: only| or later)?", "gnu org licenses lgpl 2 1"),
    ("lgpl-3.0", "lesser general", f"(?:gnu )?lesser general public licen[sc]e {_V}3(?: 0)?", "lgpl 3 0(?: only| or later)?", "gnu org licenses lgpl 3 0"),
    ("lgpl", "lesser general", "(?:gnu )?lesser general public licen[sc]e", "lgpl", "gnu org licenses lgpl"),
    ("agpl-3.0", "affero", f"(?:gnu )?affero general public licen[sc]e {_V}3(?: 0)?", "agpl 3 0(?: only| or later)?", "gnu org licenses agpl 3 0"),
    ("agpl", "affero", "(?:gnu )?affero general public licen[sc]e", "agpl", "gnu org licenses agpl"),
    ("gfdl-1.2", "free documentation", f"(?:gnu )?free documentation licen[sc]e {_V}1 2", "gfdl 1 2", "gnu org licenses fdl 1 2"),
    ("gfdl-1.3", "free documentation", f"(?:gnu )?free documentation licen[sc]e {_V}1 3", "gfdl 1 3", "gnu org licenses fdl 1 3"),
    ("gfdl", "free documentation", "(?:gnu )?free documentation licen[sc]e", "gfdl", "gnu org licenses fdl"),
    ("bsd-2-clause", "bsd", "(?:simplified|freebsd|2 clause|two clause) bsd|bsd (?:2|two) clause", "bsd 2 clause", "opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", "bsd", "(?:new|revised|modified|3 clause|three clause) bsd|bsd (?:3|three) clause", "bsd 3 clause", "opensource org licenses bsd 3 clause"),
    ("bsd-4-clause", "bsd", "(?:original|4 clause|four clause) bsd|bsd (?:4|four) clause", "bsd 4 clause", "spdx org licenses bsd 4 clause"),
    ("0bsd", "bsd", "(?:zero clause|0 clause) bsd|0bsd", "0bsd", "opensource org licenses 0bsd"),
    ("bsd", "bsd", "bsd(?: style)?", "bsd", "opensource org licenses bsd license"),
    ("isc", "isc", "isc", "isc", "opensource org licenses isc"),
    ("mpl-1.1", "mozilla", f"mozilla public licen[sc]e {_V}1 1", "mpl 1 1", "mozilla org mpl 1 1"),
    ("mpl-2.0", "mozilla", f"mozilla public licen[sc]e {_V}2(?: 0)?", "mpl 2 0", "mozilla org mpl 2 0"),
    ("mpl", "mozilla", "mozilla public licen[sc]e", "mpl", "mozilla org mpl"),
    ("epl-1.0", "eclipse", f"eclipse public licen[sc]e {_V}1(?: 0)?", "epl 1 0", "eclipse org legal epl v10"),
    ("epl-2.0", "eclipse", f"eclipse public licen[sc]e {_V}2(?: 0)?", "epl 2 0", "eclipse org legal epl 2 0"),
    ("cddl-1.0", "cddl", f"cddl(?: {_V}1(?: 0)?)?", "cddl 1 0", "opensource org licenses cddl1"),
    ("cpl-1.0", "common public", f"common public licen[sc]e(?: {_V}1(?: 0)?)?", "cpl 1 0", "opensource org licenses cpl1 0"),
    ("eupl-1.1", "european union", f"european union public licen[sc]e {_V}1 1", "eupl 1 1", "joinup ec europa eu eupl 1 1"),
    ("eupl-1.2", "european union", f"european union public licen[sc]e {_V}1 2", "eupl 1 2", "joinup ec europa eu eupl 1 2"),
    ("artistic-1.0", "artistic", f"artistic licen[sc]e {_V}1(?: 0)?", "artistic 1 0", "opensource org licenses artistic license 1 0"),
    ("artistic-2.0", "artistic", f"artistic licen[sc]e {_V}2(?: 0)?", "artistic 2 0", "opensource org licenses artistic license 2 0"),
    ("bsl-1.0", "boost", f"boost software licen[sc]e(?: {_V}1(?: 0)?)?", "bsl 1 0", "boost org license 1 0 txt"),
    ("zlib", "zlib", "zlib(?: libpng)?", "zlib", "opensource org licenses zlib"),
    ("unlicense", "unlicen", "unlicen[sc]e", "unlicense", "unlicense org"),
    ("wtfpl", "wtfpl", "wtfpl", "wtfpl", "wtfpl net"),
    ("cc0-1.0", "cc0", "cc0(?: 1 0)?(?: universal)?", "cc0 1 0", "creativecommons org publicdomain zero 1 0"),
    ("cc-by-sa-4.0", "sharealike", "(?:creative commons )?attribution sharealike 4 0", "cc by sa 4 0", "creativecommons org licenses by sa 4 0"),
    ("cc-by-sa-3.0", "sharealike", "(?:creative commons )?attribution sharealike 3 0", "cc by sa 3 0", "creativecommons org licenses by sa 3 0"),
    ("cc-by-sa", "sharealike", "(?:creative commons )?attribution sharealike", "cc by sa", "creativecommons org licenses by sa"),
    ("cc-by-nc-sa", "noncommercial", "(?:creative commons )?attribution noncommercial sharealike(?: [234] 0)?", "cc by nc sa(?: [234] 0)?", "creativecommons org licenses by nc sa"),
    ("cc-by-nc-nd", "noncommercial", "(?:creative commons )?attribution noncommercial noderivatives(?: [234] 0)?", "cc by nc nd(?: [234] 0)?", "creativecommons org licenses by nc nd"),
    ("cc-by-nc", "noncommercial", "(?:creative commons )?attribution noncommercial(?: [234] 0)?", "cc by nc(?: [234] 0)?", "creativecommons org licenses by nc"),
    ("cc-by-nd", "noderivatives", "(?:creative commons )?attribution noderivatives(?: [234] 0)?", "cc by nd(?: [234] 0)?", "creativecommons org licenses by nd"),
    ("cc-by-4.0", "attribution", "creative commons attribution 4 0", "cc by 4 0", "creativecommons org licenses by 4 0"),
    ("cc-by-3.0", "attribution", "creative commons attribution 3 0", "cc by 3 0", "creativecommons org licenses by 3 0"),
    ("cc-by", "attribution", "creative commons attribution", "cc by", "creativecommons org licenses by"),
    ("odbl-1.0", "open database", "open database licen[sc]e(?: v?1 0)?", "odbl 1 0", "opendatacommons org licenses odbl"),
    ("odc-by-1.0", "open data commons", "open data commons attribution(?: licen[sc]e)?", "odc by 1 0", "opendatacommons org licenses by"),
    ("pddl-1.0", "public domain dedication", "public domain dedication and licen[sc]e", "pddl 1 0", "opendatacommons org licenses pddl"),
    ("ofl-1.1", "open font", f"(?:sil )?open font licen[sc]e(?: {_V}1 1)?", "ofl 1 1", "scripts sil org ofl"),
    ("psf-2.0", "python software", f"python software foundation licen[sc]e(?: {_V}2(?: 0)?)?", "psf 2 0", "docs python org license"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)?", "ncsa", "opensource org licenses ncsa"),
    ("ms-pl", "microsoft public", "microsoft public licen[sc]e", "ms pl", "opensource org licenses ms pl"),
    ("ms-rl", "microsoft reciprocal", "microsoft reciprocal licen[sc]e", "ms rl", "opensource org licenses ms rl"),
    ("osl-3.0", "open software", f"open software licen[sc]e(?: {_V}3(?: 0)?)?", "osl 3 0", "opensource org licenses osl 3 0"),
    ("afl-3.0", "academic free", f"academic free licen[sc]e(?: {_V}3(?: 0)?)?", "afl 3 0", "opensource org licenses afl 3 0"),
    ("busl-1.1", "business source", f"business source licen[sc]e(?: {_V}1 1)?", "busl 1 1", "mariadb com bsl11"),
    ("sspl-1.0", "server side public", f"server side public licen[sc]e(?: {_V}1(?: 0)?)?", "sspl 1 0", "mongodb com licensing server side public license"),
]

#: label, keyword, pattern of a phrase of the licence's own text
TEXTS = [
    ("mit", "hereby granted", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "substantial portions", "shall be included in all copies or substantial portions of the software"),
    ("mit", "provided as is", "the software is provided as is without warranty of any kind express or implied"),
    ("isc", "hereby granted", "permission to use copy modify and or distribute this software for any purpose"),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification"),
    ("bsd-3-clause", "endorse or promote", "may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising materials", "all advertising materials mentioning features or use of this software"),
    ("bsd", "copyright holders", "this software is provided by the copyright holders and contributors as is"),
    ("apache-2.0", "apache license", "you may not use this file except in compliance with the license"),
    ("apache-2.0", "apache license", "apache license version 2 0 january 2004"),
    ("gpl", "free software", "this program is free software you can redistribute it and or modify"),
    ("gpl", "general public", "as published by the free software foundation"),
    ("gpl", "general public", "you should have received a copy of the gnu general public license"),
    ("gpl-3.0", "general public", "gnu general public license version 3 29 june 2007"),
    ("gpl-2.0", "general public", "gnu general public license version 2 june 1991"),
    ("gpl", "general public", "either version [123] of the license or at your option any later version"),
    ("lgpl", "lesser general", "you should have received a copy of the gnu lesser general public license"),
    ("agpl", "affero", "you should have received a copy of the gnu affero general public license"),
    ("gfdl", "free documentation", "permission is granted to copy distribute and or modify this document"),
    ("mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public license"),
    ("epl-2.0", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("bsl-1.0", "boost", "distributed under the boost software license"),
    ("zlib", "altered source", "altered source versions must be plainly marked as such"),
    ("unlicense", "public domain", "this is free and unencumbered software released into the public domain"),
    ("cc0-1.0", "copyright and related", "waived all copyright and related (?:and|or) neighboring rights"),
    ("cc-by", "creative commons", "(?:licensed|released|available|shared) under (?:a |the )?creative commons attribution"),
    ("creative-commons", "creative commons", "(?:a |the )?creative commons licen[sc]e"),
    ("public-domain", "public domain", "(?:this work is |released into |dedicated to |placed in )(?:the )?public domain"),
    ("public-domain", "public domain", "public domain mark(?: 1 0)?"),
    ("wtfpl", "do what", "you just do what the fuck you want to"),
    ("ofl-1.1", "reserved font", "with reserved font name"),
    ("proprietary", "proprietary", "(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "prior written", "without (?:the )?(?:express )?prior written (?:permission|consent)"),
    ("proprietary", "unauthorized", "unauthorized (?:copying|reproduction|distribution|use) (?:of|is)"),
    ("proprietary", "may not be", "may not be (?:copied|reproduced|redistributed|published|broadcast|rewritten)"),
    ("proprietary", "end user", "end user licen[sc]e agreement"),
    ("reserved", "rights reserved", "(?:all|some|no) rights reserved"),
    ("copyright", "copyright", "copyright (?:c )?(?:19|20)[0-9][0-9]"),
    ("copyright", "copyright", "(?:19|20)[0-9][0-9] copyright"),
    ("see-license", "licen", "see (?:the )?(?:accompanying )?(?:file )?licen[sc]e(?: file| txt| md)? for (?:details|the full|more|licensing)"),
]

_GIVEN = "(?:licen[sc]ed|released|available|distributed|published|provided|covered|shared|issued|offered|redistributable)"
_TERMS = "(?:a |an |the )?(?:terms (?:and conditions )?of (?:the )?)?(?:gnu )?"
_LICENCE = "(?: public)?(?: licen[sc]e)?"


class Rule(NamedTuple):
    """``number`` is its place in the order; of equal priorities and lengths, the earlier rule holds."""

    number: int
    label: str
    keyword: str
    pattern: str
    priority: int
    #: One of these stands in every match as well, so a rule of a common keyword runs on few texts.
    also: tuple[str, ...]


def _named(name: str) -> str:
    """A name that says licence stands by itself, one that may say it does so in that form; others are followed by the word."""
    told = name.replace("(?: license)?", " license").replace("(?: licen[sc]e)?", " licen[sc]e")
    if told == name and "licen" in name:
        return name
    return f"(?:{name}) licen[sc]e" if told == name else f"(?:(?:{name}) licen[sc]e|{told})"


def _rules() -> list[Rule]:
    rows = []
    for label, keyword, name, short, link in FAMILIES:
        names = f"(?:{name}|{short})"
        rows += [
            (label, "spdx", f"spdx licen[sc]e identifier {short}", 95, (short.split(" ")[0],)),
            (label, "under", f"{_GIVEN} under {_TERMS}{names}{_LICENCE}(?: {_V}[1234](?: [0-9])?)?", 85, (keyword, short.split(" ")[0])),
            (label, link.split(" ")[0], link, 75, (link,)),
            (label, keyword, _named(name), 65, ("licen",)),
            (label, "licen", f"licen[sc]e {short}", 55, (short.split(" ")[0],)),
        ]
    rows += [(label, keyword, pattern, 90, (keyword,)) for label, keyword, pattern in TEXTS]
    return [Rule(i, *row) for i, row in enumerate(rows)]


RULES = _rules()
#: Starts of words one of which every text with a detection holds: the keywords; for rules of permission, the verb with "under".
PREFILTER = sorted({r.keyword for r in RULES if r.keyword not in ("under", "mit", "isc")} | {"licen"} | {f"{v} under" for v in _GIVEN[3:-1].replace("[sc]", "s").split("|")})


def prefilter() -> str:
    """One pattern that looks only after spaces, and there at the keywords of one first letter."""
    by_letter: dict[str, list[str]] = {}
    for k in PREFILTER:
        by_letter.setdefault(k[0], []).append(k[1:].replace(" ", "  "))
    return " (?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by_letter.items()) + ")"
