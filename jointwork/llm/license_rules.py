"""License rules: families of names times kinds of statement.

A rule is a regular expression over the words of a text joined by single
spaces, a keyword that a text must hold before the rule is tried, a label, a
priority and a confidence.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: str
    priority: int
    score: float


# Phrases every scan looks for, with their labels.
BASE = [
    ("mit", "mit", "under the mit license"),
    ("apache-2", "apache", "apache license version 2"),
    ("cc-by-nc", "cc", "cc by nc"),
]

# Label, keywords (every match of the name holds one of them as a word), name as words, SPDX identifier
# as words, address as words.
FAMILIES = [
    ("mit", "mit", "mit", "mit", "opensource org licenses mit"),
    ("mit-0", "mit", "mit no attribution", "mit 0", "opensource org licenses mit 0"),
    ("apache-1.1", "apache", "apache(?: software)? license(?: version)? 1 1", "apache 1 1", "apache org licenses license 1 1"),
    ("apache-2", "apache", "apache(?: software)?(?: license)?(?: version)? 2(?: 0)?", "apache 2 0", "apache org licenses license 2 0"),
    ("bsd-2", "bsd freebsd", "(?:simplified bsd|bsd 2 clause|freebsd)", "bsd 2 clause", "opensource org licenses bsd 2 clause"),
    ("bsd-3", "bsd", "(?:new bsd|modified bsd|revised bsd|bsd 3 clause)", "bsd 3 clause", "opensource org licenses bsd 3 clause"),
    ("bsd-4", "bsd", "(?:original bsd|bsd 4 clause)", "bsd 4 clause", "spdx org licenses bsd 4 clause"),
    ("bsd-0", "zero", "zero clause bsd", "0bsd", "opensource org licenses 0bsd"),
    ("gpl-1", "general", "gnu general public license(?: version)? 1(?: 0)?", "gpl 1 0(?: only| or later)?", "gnu org licenses old licenses gpl 1 0"),
    ("gpl-2", "general", "gnu general public license(?: version)? 2(?: 0)?", "gpl 2 0(?: only| or later)?", "gnu org licenses old licenses gpl 2 0"),
    ("gpl-3", "general", "gnu general public license(?: version)? 3(?: 0)?", "gpl 3 0(?: only| or later)?", "gnu org licenses gpl 3 0"),
    ("gpl-2", "gplv2", "gplv2", "gplv2", "gnu org licenses gplv2"),
    ("gpl-3", "gplv3", "gplv3", "gplv3", "gnu org licenses gplv3"),
    ("lgpl-2", "library", "gnu library general public license(?: version)? 2(?: 0)?", "lgpl 2 0(?: only| or later)?", "gnu org licenses old licenses lgpl 2 0"),
    ("lgpl-2.1", "lesser", "gnu lesser general public license(?: version)? 2 1", "lgpl 2 1(?: only| or later)?", "gnu org licenses old licenses lgpl 2 1"),
    ("lgpl-3", "lesser", "gnu lesser general public license(?: version)? 3(?: 0)?", "lgpl 3 0(?: only| or later)?", "gnu org licenses lgpl 3 0"),
    ("agpl-3", "affero", "gnu affero general public license(?: version)? 3(?: 0)?", "agpl 3 0(?: only| or later)?", "gnu org licenses agpl 3 0"),
    ("gfdl-1.3", "documentation", "gnu free documentation license(?: version)? 1 3", "gfdl 1 3(?: only| or later)?", "gnu org licenses fdl 1 3"),
    ("mpl-1.1", "mozilla", "mozilla public license(?: version)? 1 1", "mpl 1 1", "mozilla org mpl 1 1"),
    ("mpl-2", "mozilla", "mozilla public license(?: version)? 2(?: 0)?", "mpl 2 0", "mozilla org mpl 2 0"),
    ("epl-1", "eclipse", "eclipse public license(?: version)? 1(?: 0)?", "epl 1 0", "eclipse org legal epl v10"),
    ("epl-2", "eclipse", "eclipse public license(?: version)? 2(?: 0)?", "epl 2 0", "eclipse org legal epl 2 0"),
    ("cddl-1", "distribution", "common development and distribution license(?: version)? 1(?: 0)?", "cddl 1 0", "opensource org licenses cddl 1 0"),
    ("eupl-1.2", "european", "european union public licen[cs]e(?: version)? 1 2", "eupl 1 2", "joinup ec europa eu eupl 1 2"),
    ("isc", "isc", "isc", "isc", "opensource org licenses isc"),
    ("zlib", "zlib", "zlib(?: libpng)?", "zlib", "opensource org licenses zlib"),
    ("boost-1", "boost", "boost software license(?: version)? 1(?: 0)?", "bsl 1 0", "boost org license 1 0"),
    ("unlicense", "unlicense", "(?:the )?unlicense", "unlicense", "unlicense org"),
    ("wtfpl", "wtfpl", "wtfpl(?: version 2)?", "wtfpl", "wtfpl net"),
    ("artistic-2", "artistic", "artistic license(?: version)? 2(?: 0)?", "artistic 2 0", "opensource org licenses artistic 2 0"),
    ("python-2", "python", "python software foundation license(?: version 2)?", "psf 2 0", "python org psf license"),
    ("php-3", "php", "php license(?: version)? 3(?: 01)?", "php 3 01", "php net license 3 01"),
    ("postgresql", "postgresql", "postgresql", "postgresql", "postgresql org about licence"),
    ("ofl-1.1", "sil", "sil open font license(?: version)? 1 1", "ofl 1 1", "scripts sil org ofl"),
    ("odbl-1", "database", "open database license(?: version)? 1(?: 0)?", "odbl 1 0", "opendatacommons org licenses odbl"),
    ("odc-by-1", "commons", "open data commons attribution license(?: version)? 1(?: 0)?", "odc by 1 0", "opendatacommons org licenses by"),
    ("pddl-1", "dedication", "public domain dedication and license(?: version)? 1(?: 0)?", "pddl 1 0", "opendatacommons org licenses pddl"),
    ("cc0-1", "cc0", "(?:creative commons )?cc0(?: 1 0)?(?: universal)?", "cc0 1 0", "creativecommons org publicdomain zero 1 0"),
    ("cc-by", "cc commons", "(?:cc by|creative commons attribution)(?: [234] [05])?(?: international)?", "cc by [234] [05]", "creativecommons org licenses by [234] [05]"),
    ("cc-by-sa", "cc commons", "(?:cc by sa|creative commons attribution share ?alike)(?: [234] [05])?", "cc by sa [234] [05]", "creativecommons org licenses by sa [234] [05]"),
    ("cc-by-nd", "cc commons", "(?:cc by nd|creative commons attribution no ?deriv(?:s|atives))(?: [234] [05])?", "cc by nd [234] [05]", "creativecommons org licenses by nd [234] [05]"),
    ("cc-by-nc", "cc commons", "(?:cc by nc|creative commons attribution non ?commercial)(?: [234] [05])?", "cc by nc [234] [05]", "creativecommons org licenses by nc [234] [05]"),
    ("cc-by-nc-sa", "cc commons", "(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: [234] [05])?", "cc by nc sa [234] [05]", "creativecommons org licenses by nc sa [234] [05]"),
    ("cc-by-nc-nd", "cc commons", "(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:s|atives))(?: [234] [05])?", "cc by nc nd [234] [05]", "creativecommons org licenses by nc nd [234] [05]"),
    ("public-domain", "domain", "public domain", "nlod public domain", "creativecommons org publicdomain mark 1 0"),
    ("elastic-2", "elastic", "elastic license(?: version)? 2(?: 0)?", "elastic 2 0", "elastic co licensing elastic license"),
    ("sspl-1", "side", "server side public license(?: version)? 1", "sspl 1 0", "mongodb com licensing server side public license"),
    ("busl-1.1", "business", "business source license(?: version)? 1 1", "busl 1 1", "mariadb com bsl11"),
    ("proprietary", "reserved", "all rights reserved", "licenseref proprietary", "licenseref proprietary terms"),
]

# Kinds of statement around a name (n), an identifier (i), an address (a); priority; confidence.
STATEMENTS = [
    ("(?:spdx license identifier|license identifier) {i}", 5, 0.98),
    ("(?:licensed|released|distributed|published|provided|(?:made )?available|covered|used) under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:an? )?{n}(?: licen[cs]e| public license)?(?: only| or later| or any later version)?", 4, 0.95),
    ("(?:licensed|released|distributed|published|provided|available|dedicated) (?:in|into|to|as) the {n}", 4, 0.9),
    ("(?:https? )?(?:www )?{a}(?: (?:html|txt|php|deed|legalcode))?", 3, 0.9),
    ("(?:see|read|under|accept|subject to|governed by) (?:the )?(?:terms of )?(?:the )?{n}(?: licen[cs]e)?", 3, 0.8),
    ("(?:the )?{n} licen[cs]e(?: agreement| terms| text)?", 2, 0.7),
    ("licen[cs]es? {n}", 2, 0.7),
    ("{n}", 1, 0.4),
]
#: Names that are ordinary words need a statement around them.
ORDINARY = {"mit", "isc", "zlib", "postgresql"}


def rules() -> list[Rule]:
    """In order: an earlier rule wins where two match the same words."""
    out = []
    for statement, priority, score in STATEMENTS:
        for label, keywords, name, identifier, address in FAMILIES:
            if statement == "{n}" and name in ORDINARY:
                continue
            pattern = statement.replace("{n}", f"(?:{name})").replace("{i}", f"(?:{identifier})").replace("{a}", f"(?:{address})")
            keys = keywords.split(" ")
            if "{i}" in statement or "{a}" in statement:  # identifiers and addresses begin with a fixed word
                keys = [(identifier if "{i}" in statement else address).split(" ")[0]]
            out += [Rule(label, key, rf"(?<= ){pattern}(?= )", priority, score) for key in keys]
    return out
