"""Signatures of licences and rights notices.

A signature is a regular expression over words: lower-case, separated by one
space, signs dropped, so "Apache License, Version 2.0" reads ``apache license
version 2 0``.  Every licence name is looked for in three forms - behind an
identifier tag, in a grant, by itself - and a form that says more comes first.
Sentences of licence texts and rights notices are signatures of their own.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Priorities, the first is the strongest, and what a detection of each is worth.
TAG, GRANT, NAME, HINT = 0, 1, 2, 3
WEIGHT = {TAG: 1.0, GRANT: 0.9, NAME: 0.7, HINT: 0.4}

V = "(?: version| ver| v)?"
GNU = "(?:the )?(?:gnu )?"
#: label: keywords of which a text has one at least, and the name.
NAMES: dict[str, tuple[str, str]] = {
    "afl-2.1": ("academic afl", f"(?:academic free license|afl){V} 2 1"),
    "afl-3.0": ("academic afl", f"(?:academic free license|afl){V} 3 0"),
    "agpl-1.0": ("affero agpl agplv1", f"(?:{GNU}affero general public license{V} 1(?: 0)?|agpl{V} 1(?: 0)?|agplv1)"),
    "agpl-3.0": ("affero agpl agplv3", f"(?:{GNU}affero general public license{V} 3(?: 0)?|agpl{V} 3(?: 0)?|agplv3)(?: or later| only)?"),
    "agpl": ("affero agpl", f"(?:{GNU}affero general public license|agpl)"),
    "apache-1.0": ("apache", f"apache(?: software)?(?: license)?{V} 1 0"),
    "apache-1.1": ("apache", f"apache(?: software)?(?: license)?{V} 1 1"),
    "apache-2.0": ("apache", f"apache(?: software)?(?: license)?{V} 2(?: 0)?"),
    "apache": ("apache", "apache(?: software)? license"),
    "apsl-1.0": ("apsl apple", f"(?:apple public source license|apsl){V} 1(?: 0)?"),
    "apsl-2.0": ("apsl apple", f"(?:apple public source license|apsl){V} 2(?: 0)?"),
    "artistic-1.0": ("artistic", f"artistic license{V} 1(?: 0)?"),
    "artistic-2.0": ("artistic", f"artistic license{V} 2(?: 0)?"),
    "artistic": ("artistic", "(?:perl )?artistic license"),
    "beerware": ("beerware beer", "(?:beerware|beer ware)(?: license)?"),
    "bsd-0-clause": ("bsd 0bsd", "(?:0bsd|(?:bsd )?(?:zero|0) clause bsd|bsd (?:zero|0) clause)(?: license)?"),
    "bsd-1-clause": ("bsd", "(?:bsd (?:one|1) clause|(?:one|1) clause bsd)(?: license)?"),
    "bsd-2-clause": ("bsd freebsd", "(?:bsd (?:two|2) clause|(?:two|2) clause bsd|simplified bsd|freebsd)(?: license)?"),
    "bsd-3-clause": ("bsd", "(?:bsd (?:three|3) clause|(?:three|3) clause bsd|(?:new|revised|modified) bsd)(?: license)?"),
    "bsd-4-clause": ("bsd", "(?:bsd (?:four|4) clause|(?:four|4) clause bsd|original bsd)(?: license)?"),
    "bsd": ("bsd", "(?:berkeley )?bsd (?:style )?license"),
    "bsl-1.0": ("boost bsl", f"(?:boost software license{V}(?: 1 0)?|bsl 1 0)"),
    "busl-1.1": ("busl business", f"(?:business source license{V}(?: 1 1)?|busl 1 1)"),
    "cc0-1.0": ("cc0 zero", f"(?:cc0{V}(?: 1 0)?(?: universal)?|creative commons zero(?: 1 0)?(?: universal)?)"),
    "cc-by-1.0": ("cc creative", f"(?:cc by|creative commons attribution)(?: license)?{V} 1 0"),
    "cc-by-2.0": ("cc creative", f"(?:cc by|creative commons attribution)(?: license)?{V} 2 0"),
    "cc-by-2.5": ("cc creative", f"(?:cc by|creative commons attribution)(?: license)?{V} 2 5"),
    "cc-by-3.0": ("cc creative", f"(?:cc by|creative commons attribution)(?: license)?{V} 3 0"),
    "cc-by-4.0": ("cc creative", f"(?:cc by|creative commons attribution)(?: license)?{V} 4 0"),
    "cc-by-sa-2.0": ("cc creative", f"(?:cc by sa|creative commons attribution share ?alike)(?: license)?{V} 2 0"),
    "cc-by-sa-2.5": ("cc creative", f"(?:cc by sa|creative commons attribution share ?alike)(?: license)?{V} 2 5"),
    "cc-by-sa-3.0": ("cc creative", f"(?:cc by sa|creative commons attribution share ?alike)(?: license)?{V} 3 0"),
    "cc-by-sa-4.0": ("cc creative", f"(?:cc by sa|creative commons attribution share ?alike)(?: license)?{V} 4 0"),
    "cc-by-nc-2.0": ("cc creative", f"(?:cc by nc|creative commons attribution non ?commercial)(?: license)?{V} 2 0"),
    "cc-by-nc-3.0": ("cc creative", f"(?:cc by nc|creative commons attribution non ?commercial)(?: license)?{V} 3 0"),
    "cc-by-nc-4.0": ("cc creative", f"(?:cc by nc|creative commons attribution non ?commercial)(?: license)?{V} 4 0"),
    "cc-by-nd-3.0": ("cc creative", f"(?:cc by nd|creative commons attribution no ?deriv(?:s|atives))(?: license)?{V} 3 0"),
    "cc-by-nd-4.0": ("cc creative", f"(?:cc by nd|creative commons attribution no ?deriv(?:s|atives))(?: license)?{V} 4 0"),
    "cc-by-nc-sa-3.0": ("cc creative", f"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: license)?{V} 3 0"),
    "cc-by-nc-sa-4.0": ("cc creative", f"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: license)?{V} 4 0"),
    "cc-by-nc-nd-3.0": ("cc creative", f"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:s|atives))(?: license)?{V} 3 0"),
    "cc-by-nc-nd-4.0": ("cc creative", f"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:s|atives))(?: license)?{V} 4 0"),
    "cc-by-sa": ("cc creative", "(?:cc by sa|creative commons attribution share ?alike)"),
    "cc-by-nc": ("cc creative", "(?:cc by nc|creative commons attribution non ?commercial)"),
    "cc-by-nd": ("cc creative", "(?:cc by nd|creative commons attribution no ?deriv(?:s|atives))"),
    "creative-commons": ("creative", "creative commons(?: attribution)?(?: license)?"),
    "cddl-1.0": ("cddl distribution", f"(?:common development and distribution license|cddl){V} 1 0"),
    "cddl-1.1": ("cddl distribution", f"(?:common development and distribution license|cddl){V} 1 1"),
    "cecill-2.1": ("cecill", f"cecill(?: license)?{V} 2 1"),
    "cecill-b": ("cecill", "cecill b(?: license)?"),
    "cecill-c": ("cecill", "cecill c(?: license)?"),
    "cpl-1.0": ("cpl common", f"(?:common public license|cpl){V} 1 0"),
    "ecl-2.0": ("educational ecl", f"(?:educational community license|ecl){V} 2 0"),
    "ecos-2.0": ("ecos", f"ecos license{V} 2 0"),
    "efl-2.0": ("eiffel", f"eiffel forum license{V} 2(?: 0)?"),
    "epl-1.0": ("eclipse epl", f"(?:eclipse public license|epl){V} 1(?: 0)?"),
    "epl-2.0": ("eclipse epl", f"(?:eclipse public license|epl){V} 2(?: 0)?"),
    "eupl-1.1": ("european eupl", f"(?:european union public licen[cs]e|eupl){V} 1 1"),
    "eupl-1.2": ("european eupl", f"(?:european union public licen[cs]e|eupl){V} 1 2"),
    "fair": ("fair", "fair license"),
    "gfdl-1.1": ("documentation gfdl fdl", f"(?:{GNU}free documentation license|g?fdl){V} 1 1"),
    "gfdl-1.2": ("documentation gfdl fdl", f"(?:{GNU}free documentation license|g?fdl){V} 1 2"),
    "gfdl-1.3": ("documentation gfdl fdl", f"(?:{GNU}free documentation license|g?fdl){V} 1 3"),
    "gpl-1.0": ("general gpl gplv1", f"(?:{GNU}general public license{V} 1(?: 0)?|(?:gnu )?gpl{V} 1(?: 0)?|gplv1)(?: or later| only)?"),
    "gpl-2.0": ("general gpl gplv2", f"(?:{GNU}general public license{V} 2(?: 0)?|(?:gnu )?gpl{V} 2(?: 0)?|gplv2)(?: or later| only)?"),
    "gpl-3.0": ("general gpl gplv3", f"(?:{GNU}general public license{V} 3(?: 0)?|(?:gnu )?gpl{V} 3(?: 0)?|gplv3)(?: or later| only)?"),
    "hpnd": ("hpnd historical", "(?:historical permission notice and disclaimer|hpnd)"),
    "icu": ("icu", "icu license"),
    "ijg": ("ijg jpeg", "(?:independent jpeg group|ijg) license"),
    "imagemagick": ("imagemagick", "imagemagick license"),
    "intel": ("intel", "intel open source license"),
    "ipl-1.0": ("ibm ipl", f"(?:ibm public license|ipl){V} 1 0"),
    "isc": ("isc", "isc license"),
    "json": ("json", "json license"),
    "lgpl-2.0": ("library lesser lgpl lgplv2", f"(?:{GNU}(?:library|lesser) general public license{V} 2(?: 0)?|lgpl{V} 2(?: 0)?|lgplv2)(?: or later| only)?"),
    "lgpl-2.1": ("lesser lgpl", f"(?:{GNU}lesser general public license|lgpl){V} 2 1(?: or later| only)?"),
    "lgpl-3.0": ("lesser lgpl lgplv3", f"(?:{GNU}lesser general public license{V} 3(?: 0)?|lgpl{V} 3(?: 0)?|lgplv3)(?: or later| only)?"),
    "lgpl": ("lesser library lgpl", f"(?:{GNU}(?:lesser|library) general public license|lgpl)"),
    "libpng": ("libpng", "(?:zlib )?libpng license"),
    "lppl-1.3c": ("latex lppl", f"(?:latex project public license|lppl){V} 1 3c?"),
    "lucent-1.02": ("lucent", f"lucent public license{V} 1 02"),
    "mit-0": ("mit", "mit (?:no attribution|0)(?: license)?"),
    "mit": ("mit expat", "(?:mit|expat|mit x11) license"),
    "mpl-1.0": ("mozilla mpl", f"(?:mozilla public license|mpl){V} 1 0"),
    "mpl-1.1": ("mozilla mpl", f"(?:mozilla public license|mpl){V} 1 1"),
    "mpl-2.0": ("mozilla mpl", f"(?:mozilla public license|mpl){V} 2(?: 0)?"),
    "mpl": ("mozilla", "mozilla public license"),
    "ms-pl": ("microsoft ms", "(?:microsoft public license|ms pl)"),
    "ms-rl": ("microsoft ms", "(?:microsoft reciprocal license|ms rl)"),
    "mulan-2.0": ("mulan", f"mulan (?:psl|permissive software license){V} 2"),
    "ncsa": ("ncsa", "(?:university of illinois )?ncsa(?: open source)? license"),
    "nokia": ("nokia", "nokia open source license"),
    "npl-1.1": ("netscape npl", f"(?:netscape public license|npl){V} 1 1"),
    "odbl-1.0": ("odbl database", f"(?:open (?:data commons open )?database license|odbl){V}(?: 1 0)?"),
    "odc-by-1.0": ("odc commons", f"(?:open data commons attribution license|odc by){V}(?: 1 0)?"),
    "ofl-1.1": ("ofl font", f"(?:sil open font license|ofl){V}(?: 1 1)?"),
    "openssl": ("openssl", "openssl license"),
    "osl-3.0": ("osl open", f"(?:open software license|osl){V} 3 0"),
    "pddl-1.0": ("pddl dedication", f"(?:public domain dedication and license|pddl){V}(?: 1 0)?"),
    "php-3.0": ("php", f"php license{V} 3 0(?: 1)?"),
    "postgresql": ("postgresql", "postgresql licen[cs]e"),
    "psf-2.0": ("python psf", f"(?:python software foundation license|psf license){V}(?: 2(?: 0)?)?"),
    "python-2.0": ("python", f"python license{V} 2 0"),
    "qpl-1.0": ("qpl public", f"(?:q public license|qpl){V} 1 0"),
    "ruby": ("ruby", "ruby license"),
    "sgi-b-2.0": ("sgi", f"sgi free software license b{V} 2 0"),
    "sleepycat": ("sleepycat", "sleepycat license"),
    "sspl-1.0": ("sspl server", f"(?:server side public license|sspl){V} 1(?: 0)?"),
    "unicode": ("unicode", "unicode(?: data files and software)? license"),
    "unlicense": ("unlicense", "unlicense"),
    "upl-1.0": ("upl permissive", f"(?:universal permissive license|upl){V} 1 0"),
    "vim": ("vim", "vim license"),
    "w3c": ("w3c", "w3c software(?: notice and)? license"),
    "wtfpl": ("wtfpl", "wtfpl(?: version 2)?"),
    "x11": ("x11", "x11 license"),
    "zlib": ("zlib", "zlib(?: libpng)? license"),
    "zpl-2.1": ("zope zpl", f"(?:zope public license|zpl){V} 2 1"),
}

GRANTED = "(?:licensed|released|distributed|published|available|provided|covered|redistributed|shared)"
FORMS = [
    (TAG, "spdx license identifier {}"),
    (GRANT, f"{GRANTED} (?:under|by|according to|subject to)(?: the)?(?: terms(?: and conditions)? of)?(?: the| a| an)? {{}}"),
    (NAME, "{}"),
]

#: Sentences of licence texts and rights notices: label, priority, keyword, signature.
SENTENCES: list[tuple[str, int, str, str]] = [
    ("mit-text", GRANT, "hereby", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc-text", GRANT, "hereby", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd-text", GRANT, "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-endorsement", NAME, "endorse", "(?:may|must) (?:not )?be used to endorse or promote products derived from this software(?: without specific prior written permission)?"),
    ("bsd-advertising", NAME, "advertising", "all advertising materials mentioning features or use of this software must display"),
    ("gpl-text", GRANT, "redistribute", "(?:this program|this library|it) is free software you can redistribute it and or modify it under the terms of"),
    ("gpl-text", NAME, "gnu", "you should have received a copy of the gnu (?:lesser |affero |library )?general public license"),
    ("or-later", HINT, "option", "either version [0-9]+(?: [0-9]+)? of the license or at your option any later version"),
    ("apache-text", GRANT, "compliance", "you may not use this file except in compliance with the license"),
    ("apache-text", NAME, "applicable", "unless required by applicable law or agreed to in writing"),
    ("mpl-text", GRANT, "mozilla", "this source code form is subject to the terms of the mozilla public license"),
    ("epl-text", GRANT, "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("zlib-text", GRANT, "altered", "altered source versions must be plainly marked as such and must not be misrepresented"),
    ("zlib-text", NAME, "misrepresented", "the origin of this software must not be misrepresented"),
    ("boost-text", GRANT, "execute", "to use reproduce display distribute execute and transmit the software"),
    ("unlicense-text", GRANT, "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("public-domain", GRANT, "domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", HINT, "domain", "(?:in the )?public domain"),
    ("wtfpl-text", GRANT, "fuck", "do what the fuck you want to"),
    ("warranty-disclaimer", HINT, "warranty warranties", "(?:provided )?as is without(?: express or implied)? warrant(?:y|ies)(?: of any kind)?"),
    ("warranty-disclaimer", HINT, "merchantability", "implied warrant(?:y|ies) of merchantability"),
    ("warranty-disclaimer", HINT, "warranty", "absolutely no warranty"),
    ("liability-disclaimer", HINT, "liable", "in no event shall(?: the)? [^ #]+(?: [^ #]+){0,15} be liable"),
    ("liability-disclaimer", HINT, "damages", "(?:indirect|incidental|special|exemplary|consequential)(?: or)?(?: indirect| incidental| special| exemplary| consequential){0,6} damages"),
    ("copyright", NAME, "copyright", "copyright(?: c)? (?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])?"),
    ("copyright", HINT, "copyright", "copyright (?:by|holders?|notice|owner)"),
    ("copyright", HINT, "copyrighted", "copyrighted (?:work|material|software)"),
    ("proprietary", NAME, "proprietary", "proprietary and confidential"),
    ("proprietary", NAME, "unauthorized", "unauthorized (?:copying|use|reproduction|distribution) of this (?:file|software|document|work)"),
    ("proprietary", HINT, "permission", "without (?:the )?(?:prior |express )*written permission"),
    ("proprietary", HINT, "reproduced", "no part of this [^ #]+ may be reproduced"),
    ("personal-use", NAME, "personal", "for personal(?: and)?(?: or)? non ?commercial use(?: only)?"),
    ("non-commercial", HINT, "commercial noncommercial", "(?:non commercial|noncommercial) (?:use|purposes?)(?: only)?"),
    ("non-commercial", HINT, "commercial", "not for commercial use"),
    ("evaluation", NAME, "evaluation", "for evaluation (?:use|purposes?) only"),
    ("no-ai", NAME, "training", "(?:may not|must not|shall not) be used (?:for|in) (?:the )?training(?: of)?(?: machine learning| ai| language)? models?"),
    ("terms", HINT, "terms", "(?:terms of (?:use|service)|terms and conditions)"),
    ("see-license", HINT, "license licence copying", "see(?: the)? (?:license|licence|copying)(?: file| txt| md)(?: for details| for more information)?"),
    ("license-url", NAME, "apache", "apache org licenses license [12] [01]"),
    ("license-url", NAME, "creativecommons", "creativecommons org (?:licenses [a-z]+(?: [a-z]+){0,3} [0-9] [0-9]|publicdomain zero 1 0)"),
    ("license-url", NAME, "opensource", "opensource org licenses? [^ #]+"),
    ("license-url", NAME, "gnu", "(?:www )?gnu org (?:licenses|copyleft)(?: (?:l|a)?gpl(?: [0-9] [0-9])?)?"),
]

#: Places the caller wants counted and labelled whatever the rules say: phrase and label.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
BASE_KEYWORDS = ["cc", "general", "reserved"]
BASE_WEIGHT = 0.5


@dataclass(frozen=True)
class Rule:
    number: int
    priority: int
    label: str
    keywords: tuple[str, ...]
    signature: str

    @property
    def pattern(self) -> str:
        return over_words(self.signature)


def over_words(signature: str) -> str:
    """A signature as a pattern over ``word#place`` items, a space in front of each: a match tells its places.

    A space that is optional (`` ?``) means one word or two.
    """
    return " " + re.sub(r" (\??)", lambda m: r"(?:#\d+ )?" if m[1] else r"#\d+ ", signature) + r"#\d+"


def rules() -> list[Rule]:
    # "v2" may be one word.
    found = [(priority, label, keywords, form.format(name.replace(f"{V} ", f"{V} v?"))) for priority, form in FORMS for label, (keywords, name) in NAMES.items()]
    found += [(priority, label, keywords, signature) for label, priority, keywords, signature in SENTENCES]
    return [Rule(i, p, label, tuple(keywords.split()), s) for i, (p, label, keywords, s) in enumerate(found)]


def keyword_pattern(words: list[str]) -> str:
    """Alternation of words by shared beginnings, so that a place is left at its first letter that fits none."""

    def below(rest: list[str]) -> str:
        heads: dict[str, list[str]] = {}
        for w in rest:
            if w:
                heads.setdefault(w[0], []).append(w[1:])
        body = "|".join(h + below(t) for h, t in sorted(heads.items()))
        body = f"(?:{body})" if len(heads) > 1 or "" in rest and heads else body
        return body + "?" if "" in rest and heads else body

    return below(sorted(set(words)))
