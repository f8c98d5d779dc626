"""Signature rules for licenses and notices, over lower-case words joined by one blank.

Hand-written names are combined with the ways in which a text refers to them. The
order of the rules is their priority: a lower number wins.
"""

from __future__ import annotations

from dataclasses import dataclass

V = "(?:version |v )?"

# (label, literal that every match holds, name, SPDX identifier as words or "")
NAMED: tuple[tuple[str, str, str, str], ...] = (
    ("apache-2.0", "apache licen", f"apache licen[sc]e {V}2(?: 0)?", "apache 2 0"),
    ("apache-1.1", "apache", "apache (?:software )?licen[sc]e " + V + "1 1", "apache 1 1"),
    ("apache", "apache", "apache (?:software )?(?:foundation )?licen[sc]e", ""),
    ("mit", "mit licen", "mit licen[sc]e", "mit"),
    ("mit-0", "mit no attribution", "mit no attribution(?: licen[sc]e)?", "mit 0"),
    ("x11", "x11 licen", "x11 licen[sc]e", "x11"),
    ("gpl-3.0", "general public licen", f"(?:gnu )?general public licen[sc]e (?:as published by the free software foundation )?(?:either )?{V}3(?: 0)?", "gpl 3 0(?: only| or later)?"),
    ("gpl-2.0", "general public licen", f"(?:gnu )?general public licen[sc]e (?:as published by the free software foundation )?(?:either )?{V}2(?: 0)?", "gpl 2 0(?: only| or later)?"),
    ("gpl-1.0", "general public licen", f"(?:gnu )?general public licen[sc]e {V}1(?: 0)?", "gpl 1 0(?: only| or later)?"),
    ("gpl", "gnu", "(?:the )?gnu gpl(?: v?[123])?", ""),
    ("lgpl-3.0", "general public licen", f"(?:gnu )?lesser general public licen[sc]e {V}3(?: 0)?", "lgpl 3 0(?: only| or later)?"),
    ("lgpl-2.1", "general public licen", f"(?:gnu )?lesser general public licen[sc]e {V}2 1", "lgpl 2 1(?: only| or later)?"),
    ("lgpl-2.0", "library general public", f"(?:gnu )?library general public licen[sc]e(?: {V}2(?: 0)?)?", "lgpl 2 0(?: only| or later)?"),
    ("lgpl", "lesser general public", "(?:gnu )?lesser general public licen[sc]e", ""),
    ("agpl-3.0", "affero general public", f"(?:gnu )?affero general public licen[sc]e {V}3(?: 0)?", "agpl 3 0(?: only| or later)?"),
    ("agpl", "affero general public", "(?:gnu )?affero general public licen[sc]e", "agpl 1 0"),
    ("gfdl-1.3", "free documentation licen", f"(?:gnu )?free documentation licen[sc]e {V}1 3", "gfdl 1 3(?: only| or later)?"),
    ("gfdl-1.2", "free documentation licen", f"(?:gnu )?free documentation licen[sc]e {V}1 2", "gfdl 1 2(?: only| or later)?"),
    ("gfdl", "free documentation licen", "(?:gnu )?free documentation licen[sc]e", ""),
    ("bsd-2-clause", "bsd", "(?:simplified bsd|bsd 2 clause|2 clause bsd|two clause bsd) licen[sc]e", "bsd 2 clause"),
    ("bsd-2-clause", "freebsd licen", "freebsd licen[sc]e", ""),
    ("bsd-3-clause", "bsd", "(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd) licen[sc]e", "bsd 3 clause"),
    ("bsd-4-clause", "bsd", "(?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd) licen[sc]e", "bsd 4 clause"),
    ("0bsd", "bsd", "(?:zero clause bsd|bsd zero clause)(?: licen[sc]e)?", "0bsd"),
    ("0bsd", "0bsd", "0bsd(?: licen[sc]e)?", ""),
    ("bsd", "bsd", "bsd (?:style )?licen[sc]e", ""),
    ("isc", "isc licen", "isc licen[sc]e", "isc"),
    ("mpl-2.0", "mozilla public", f"mozilla public licen[sc]e {V}2(?: 0)?", "mpl 2 0"),
    ("mpl-1.1", "mozilla public", f"mozilla public licen[sc]e {V}1 1", "mpl 1 1"),
    ("mpl", "mozilla public", "mozilla public licen[sc]e", "mpl 1 0"),
    ("epl-2.0", "eclipse public", f"eclipse public licen[sc]e {V}2(?: 0)?", "epl 2 0"),
    ("epl-1.0", "eclipse public", f"eclipse public licen[sc]e {V}1(?: 0)?", "epl 1 0"),
    ("epl", "eclipse public", "eclipse public licen[sc]e", ""),
    ("edl-1.0", "eclipse distribution", f"eclipse distribution licen[sc]e(?: {V}1(?: 0)?)?", ""),
    ("cddl-1.0", "common development and distribution", f"common development and distribution licen[sc]e(?: {V}1(?: 0)?)?", "cddl 1 0"),
    ("cpl-1.0", "common public licen", f"common public licen[sc]e(?: {V}1(?: 0)?)?", "cpl 1 0"),
    ("eupl-1.2", "european union public", f"european union public licen[sc]e {V}1 2", "eupl 1 2"),
    ("eupl", "european union public", "european union public licen[sc]e", "eupl 1 1"),
    ("cecill", "cecill", "cecill(?: [abc])?(?: free software)?(?: licen[sc]e(?: agreement)?)?", "cecill 2 1"),
    ("artistic-2.0", "artistic licen", f"artistic licen[sc]e {V}2(?: 0)?", "artistic 2 0"),
    ("artistic", "artistic licen", "artistic licen[sc]e", "artistic 1 0"),
    ("zlib", "zlib", "zlib(?: libpng)? licen[sc]e", "zlib"),
    ("bsl-1.0", "boost software", f"boost software licen[sc]e(?: {V}1(?: 0)?)?", "bsl 1 0"),
    ("unlicense", "unlicense", "the unlicense", "unlicense"),
    ("wtfpl", "public licen", "do what the f[a-z]{0,99} you want to public licen[sc]e", "wtfpl"),
    ("cc0-1.0", "cc0", "cc0(?: 1 0)?(?: universal)?", "cc0 1 0"),
    ("psf-2.0", "python software foundation", "python software foundation licen[sc]e", "psf 2 0"),
    ("ruby", "ruby licen", "ruby licen[sc]e", "ruby"),
    ("php-3.01", "php licen", f"php licen[sc]e(?: {V}3 01)?", "php 3 01"),
    ("postgresql", "postgresql licen", "postgresql licen[sc]e", "postgresql"),
    ("openssl", "openssl licen", "openssl licen[sc]e", "openssl"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa open source licen[sc]e", "ncsa"),
    ("ms-pl", "microsoft public", "microsoft public licen[sc]e", "ms pl"),
    ("ms-rl", "microsoft reciprocal", "microsoft reciprocal licen[sc]e", "ms rl"),
    ("afl-3.0", "academic free", f"academic free licen[sc]e(?: {V}3(?: 0)?)?", "afl 3 0"),
    ("osl-3.0", "open software licen", f"open software licen[sc]e(?: {V}3(?: 0)?)?", "osl 3 0"),
    ("qpl-1.0", "q public licen", "q public licen[sc]e", "qpl 1 0"),
    ("sleepycat", "sleepycat", "sleepycat licen[sc]e", "sleepycat"),
    ("vim", "vim licen", "vim licen[sc]e", "vim"),
    ("upl-1.0", "universal permissive", f"universal permissive licen[sc]e(?: {V}1(?: 0)?)?", "upl 1 0"),
    ("ofl-1.1", "open font licen", f"(?:sil )?open font licen[sc]e(?: {V}1 1)?", "ofl 1 1"),
    ("odbl-1.0", "open database licen", f"open database licen[sc]e(?: {V}1(?: 0)?)?", "odbl 1 0"),
    ("odc-by-1.0", "open data commons", "open data commons attribution licen[sc]e", "odc by 1 0"),
    ("pddl-1.0", "public domain dedication", "(?:open data commons )?public domain dedication and licen[sc]e", "pddl 1 0"),
    ("sspl-1.0", "server side public", f"server side public licen[sc]e(?: {V}1)?", "sspl 1 0"),
    ("elastic-2.0", "elastic licen", f"elastic licen[sc]e(?: {V}?2(?: 0)?)?", "elastic 2 0"),
    ("busl-1.1", "business source", f"business source licen[sc]e(?: {V}1 1)?", "busl 1 1"),
    ("ecl-2.0", "educational community", f"educational community licen[sc]e(?: {V}2(?: 0)?)?", "ecl 2 0"),
    ("mulan-2.0", "mulan", f"mulan (?:psl|permissive software licen[sc]e)(?: {V}2)?", "mulanpsl 2 0"),
    ("ogl-3.0", "open government licen", f"open government licen[sc]e(?: {V}3(?: 0)?)?", "ogl uk 3 0"),
    ("w3c", "w3c", "w3c software (?:notice and )?licen[sc]e", "w3c"),
    ("ipl-1.0", "ibm public", "ibm public licen[sc]e", "ipl 1 0"),
    ("npl-1.1", "netscape public", "netscape public licen[sc]e", "npl 1 1"),
    ("apsl-2.0", "apple public source", "apple public source licen[sc]e", "apsl 2 0"),
    ("rpl-1.5", "reciprocal public", "reciprocal public licen[sc]e", "rpl 1 5"),
    ("ppl", "peer production", "peer production licen[sc]e", ""),
    ("hippocratic-2.1", "hippocratic", "hippocratic licen[sc]e", "hippocratic 2 1"),
)

_ELEMENTS = {"by": "attribution", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?(?: works)?", "sa": "share ?alike"}
_COMMONS = (("by",), ("by", "sa"), ("by", "nc"), ("by", "nd"), ("by", "nc", "sa"), ("by", "nc", "nd"))
_VERSIONS = ("4.0", "3.0", "2.5", "2.0", "1.0")

# (label, literal that every match holds, pattern, confidence): sentences of the texts themselves.
NOTICES: tuple[tuple[str, str, str, float], ...] = (
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software", 0.97),
    ("mit", "the above copyright notice", "the above copyright notice and this permission notice shall be included in all copies", 0.9),
    ("isc", "permission to use copy modify", "permission to use copy modify and or distribute this software for any purpose", 0.95),
    ("bsd", "redistribution and use in source", "redistribution and use in source and binary forms with or without modification are permitted", 0.95),
    ("bsd-3-clause", "neither the name of", "neither the name of [^ ]{1,99}(?: [^ ]{1,99}){0,12}? nor the names of its contributors", 0.95),
    ("bsd-4-clause", "all advertising materials", "all advertising materials mentioning features or use of this software", 0.95),
    ("apache-2.0", "apache org licenses", "(?:http |https )?www apache org licenses license 2 0", 0.97),
    ("apache-2.0", "unless required by applicable law", "unless required by applicable law or agreed to in writing software distributed under the license", 0.95),
    ("gpl", "this program is free software", "this program is free software you can redistribute it and or modify", 0.95),
    ("gpl", "gnu org licenses", "(?:www )?gnu org licenses gpl(?: [a-z0-9]{1,99})?", 0.9),
    ("lgpl", "this library is free software", "this library is free software you can redistribute it and or modify", 0.95),
    ("lgpl", "gnu org licenses", "(?:www )?gnu org licenses lgpl(?: [a-z0-9]{1,99})?", 0.92),
    ("agpl", "gnu org licenses", "(?:www )?gnu org licenses agpl(?: [a-z0-9]{1,99})?", 0.92),
    ("gfdl", "permission is granted to copy", "permission is granted to copy distribute and or modify this document", 0.95),
    ("mpl-2.0", "this source code form is subject", "this source code form is subject to the terms of the mozilla public licen[sc]e", 0.97),
    ("zlib", "the origin of this software", "the origin of this software must not be misrepresented", 0.95),
    ("unlicense", "unencumbered software", "this is free and unencumbered software released into the public domain", 0.97),
    ("wtfpl", "you just do what", "you just do what the f[a-z]{0,99} you want to", 0.9),
    ("bsl-1.0", "boost org license", "(?:www )?boost org license 1 0", 0.95),
    ("cc0-1.0", "publicdomain zero", "creativecommons org publicdomain zero(?: 1 0)?", 0.97),
    ("cc0-1.0", "waived all copyright", "waived all copyright and related or neighboring rights", 0.93),
    ("cc", "creativecommons org licenses", "creativecommons org licenses(?: [a-z]{1,99}){1,3}(?: [0-9] [0-9])?", 0.8),
    ("cc", "creative commons", "creative commons(?: licen[sc]e)?", 0.6),
    ("public-domain", "public domain", "(?:released|placed|dedicated|published) (?:in|into|to) the public domain", 0.9),
    ("public-domain", "public domain", "(?:is|are) in the public domain", 0.8),
    ("public-domain", "no copyright", "no copyright(?: reserved)?", 0.5),
    ("copyright", "copyright", "copyright (?:c )?(?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])?", 0.7),
    ("copyright", "copyright", "(?:c|copr) copyright", 0.5),
    ("copyright", "under copyright", "(?:is|are) under copyright", 0.6),
    ("copyright", "protected by copyright", "protected by copyright(?: law)?", 0.7),
    ("reserved", "rights reserved", "(?:some|no other) rights reserved", 0.6),
    ("proprietary", "proprietary and confidential", "proprietary and confidential", 0.8),
    ("proprietary", "unauthorized copying", "unauthorized copying (?:of this file )?", 0.8),
    ("proprietary", "without prior written permission", "(?:reproduced|distributed|copied)(?: [^ ]{1,99}){0,6}? without prior written permission", 0.8),
    ("proprietary", "end user licen", "end user licen[sc]e agreement", 0.7),
    ("proprietary", "may not be reproduced", "may not be reproduced(?: [^ ]{1,99}){0,8}? permission", 0.7),
    ("noncommercial", "commercial use", "(?:for|only) non commercial use(?: only)?", 0.6),
    ("noncommercial", "commercial use", "no commercial use", 0.6),
    ("no-warranty", "without warranty", "without warranty of any kind", 0.5),
    ("no-warranty", "provided as is", "provided as is(?: basis)?", 0.4),
    ("no-warranty", "provided on an as is", "provided on an as is(?: basis)?", 0.4),
    ("license", "see the licen", "see the licen[sc]e (?:file )?for (?:the specific language|details|more information)", 0.5),
    ("license", "agreement", "(?:under|subject to) the (?:terms of the )?licen[sc]e agreement", 0.5),
)

_GRANT = (
    "(?:dual )?(?:re)?(?:licen[sc]ed|released|distributed|published|available|provided|offered|shared|covered|governed)"
    "(?: only)? (?:under|by)(?: the)?(?: terms(?: and conditions)? of)?(?: the)? "
)


@dataclass(frozen=True)
class Rule:
    """``priority``: the smaller wins where detections overlap; ``keyword`` starts a word of every match."""

    priority: int
    label: str
    keyword: str
    pattern: str
    confidence: float


def _commons() -> list[tuple[str, str, str, str]]:
    found = []
    for elements in _COMMONS:
        long = " ".join(_ELEMENTS[e] for e in elements)
        short = " ".join(("cc", *elements))
        for version in (*_VERSIONS, ""):
            spaced = version.replace(".", " ")
            name = f"creative commons {long}(?: licen[sc]e| international| unported| generic){{0,4}}"
            label = "-".join(("cc", *elements, *([version] if version else [])))
            if version:
                name += f" {V}{spaced}(?: international| unported| generic| licen[sc]e){{0,4}}"
            found.append((label, "creative commons attribution", name, f"{short} {spaced}" if version else ""))
            found.append((label, short, f"{short} {spaced}" if version else short, ""))
    return found


def rules() -> list[Rule]:
    """All rules in order of priority: identifiers, grants, sentences of licenses, names."""
    named = [*NAMED, *_commons()]
    found = [
        (label, "spdx license identifier", f"spdx license identifier {spdx}", 0.99) for label, _, _, spdx in named if spdx
    ]
    found += [(label, keyword, _GRANT + name, 0.95) for label, keyword, name, _ in named]
    found += list(NOTICES)
    found += [(label, keyword, name, 0.7) for label, keyword, name, _ in named]
    return [Rule(k, label, keyword, pattern, confidence) for k, (label, keyword, pattern, confidence) in enumerate(found)]
