"""License signatures: families written by hand, spelled out as ordered rules.

Patterns run over a text's words in lower case with one blank between them, so
they need no white space classes, and punctuation (2.0, CC-BY) is a blank.
"""

from __future__ import annotations

from typing import NamedTuple

# label, keyword that must occur, how the family is named in words, words of its SPDX id
FAMILIES = [
    ("mit", "mit", "(?:mit|expat)(?: x11)?", "mit"),
    ("mit-0", "mit", "mit (?:no attribution|0)", "mit 0"),
    ("apache-2", "apache", "apache(?: software)?(?: license)?(?: version| v)? ?2(?: 0)?", "apache 2 0"),
    ("apache-1.1", "apache", "apache(?: software)?(?: license)?(?: version| v)? ?1 1", "apache 1 1"),
    ("apache-1.0", "apache", "apache(?: software)?(?: license)?(?: version| v)? ?1 0", "apache 1 0"),
    ("gpl-3", "general public", "gnu general public license(?: version| v)? ?3(?: 0)?", "gpl 3 0(?: only| or later)?"),
    ("gpl-2", "general public", "gnu general public license(?: version| v)? ?2(?: 0)?", "gpl 2 0(?: only| or later)?"),
    ("gpl-1", "general public", "gnu general public license(?: version| v)? ?1(?: 0)?", "gpl 1 0(?: only| or later)?"),
    ("gpl-3", "gpl", "(?:gnu )?gpl ?(?:version |v)?3(?: 0)?", "gpl 3"),
    ("gpl-2", "gpl", "(?:gnu )?gpl ?(?:version |v)?2(?: 0)?", "gpl 2"),
    ("lgpl-3", "lesser general", "gnu lesser general public license(?: version| v)? ?3(?: 0)?", "lgpl 3 0(?: only| or later)?"),
    ("lgpl-2.1", "lesser general", "gnu lesser general public license(?: version| v)? ?2 1", "lgpl 2 1(?: only| or later)?"),
    ("lgpl-2", "library general", "gnu library general public license(?: version| v)? ?2(?: 0)?", "lgpl 2 0(?: only| or later)?"),
    ("lgpl-3", "lgpl", "(?:gnu )?lgpl ?(?:version |v)?3(?: 0)?", "lgpl 3"),
    ("lgpl-2.1", "lgpl", "(?:gnu )?lgpl ?(?:version |v)?2 1", "lgpl 2 1"),
    ("agpl-3", "affero", "gnu affero general public license(?: version| v)? ?3(?: 0)?", "agpl 3 0(?: only| or later)?"),
    ("agpl-3", "agpl", "(?:gnu )?agpl ?(?:version |v)?3(?: 0)?", "agpl 3"),
    ("gfdl-1.3", "free documentation", "gnu free documentation license(?: version| v)? ?1 3", "gfdl 1 3"),
    ("gfdl-1.2", "free documentation", "gnu free documentation license(?: version| v)? ?1 2", "gfdl 1 2"),
    ("bsd-2", "bsd", "(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd)", "bsd 2 clause"),
    ("bsd-3", "bsd", "(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)", "bsd 3 clause"),
    ("bsd-4", "bsd", "(?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd)", "bsd 4 clause"),
    ("bsd-0", "bsd", "(?:zero clause bsd|bsd zero clause|0bsd)", "0bsd"),
    ("isc", "isc", "isc", "isc"),
    ("mpl-2", "mozilla", "mozilla public license(?: version| v)? ?2(?: 0)?", "mpl 2 0"),
    ("mpl-1.1", "mozilla", "mozilla public license(?: version| v)? ?1 1", "mpl 1 1"),
    ("mpl-2", "mpl", "mpl ?(?:version |v)?2(?: 0)?", "mpl 2"),
    ("epl-2", "eclipse", "eclipse public license(?: version| v)? ?2(?: 0)?", "epl 2 0"),
    ("epl-1", "eclipse", "eclipse public license(?: version| v)? ?1(?: 0)?", "epl 1 0"),
    ("cddl-1", "development and distribution", "common development and distribution license(?: version| v)? ?1(?: 0| 1)?", "cddl 1 [01]"),
    ("cpl-1", "common public", "common public license(?: version| v)? ?1(?: 0)?", "cpl 1 0"),
    ("eupl-1.2", "european union", "european union public licen[cs]e(?: version| v)? ?1 2", "eupl 1 2"),
    ("eupl-1.1", "european union", "european union public licen[cs]e(?: version| v)? ?1 1", "eupl 1 1"),
    ("artistic-2", "artistic", "artistic license(?: version| v)? ?2(?: 0)?", "artistic 2 0"),
    ("artistic-1", "artistic", "artistic license(?: version| v)? ?1(?: 0)?", "artistic 1 0"),
    ("bsl-1", "boost", "boost software license(?: version| v)?(?: ?1(?: 0)?)?", "bsl 1 0"),
    ("busl-1.1", "business source", "business source license(?: version| v)?(?: ?1 1)?", "busl 1 1"),
    ("zlib", "zlib", "zlib(?: libpng)?", "zlib"),
    ("unlicense", "unlicense", "(?:the )?unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl", "wtfpl"),
    ("python-2", "python", "python software foundation license(?: version| v)?(?: ?2(?: 0)?)?", "(?:psf|python) 2 0"),
    ("php-3", "php", "php license(?: version| v)?(?: ?3(?: 01?)?)?", "php 3 01?"),
    ("ruby", "ruby", "ruby license", "ruby"),
    ("openssl", "openssl", "openssl license", "openssl"),
    ("ofl-1.1", "open font", "(?:sil )?open font license(?: version| v)?(?: ?1 1)?", "ofl 1 1"),
    ("osl-3", "open software", "open software license(?: version| v)? ?3(?: 0)?", "osl 3 0"),
    ("afl-3", "academic free", "academic free license(?: version| v)? ?3(?: 0)?", "afl 3 0"),
    ("ms-pl", "microsoft", "microsoft public license", "ms pl"),
    ("ms-rl", "microsoft", "microsoft reciprocal license", "ms rl"),
    ("upl-1", "universal permissive", "universal permissive license(?: version| v)?(?: ?1(?: 0)?)?", "upl 1 0"),
    ("sspl-1", "server side", "server side public license(?: version| v)?(?: ?1)?", "sspl 1 0"),
    ("elastic-2", "elastic", "elastic license(?: version| v)? ?2(?: 0)?", "elastic 2 0"),
    ("odbl-1", "open database", "open database license(?: version| v)?(?: ?1(?: 0)?)?", "odbl 1 0"),
    ("pddl-1", "public domain dedication", "public domain dedication and licen[cs]e", "pddl 1 0"),
    ("cc0", "cc0", "cc0(?: ?1(?: 0)?)?(?: universal)?", "cc0 1 0"),
    ("cc-by-nc-nd", "cc", "cc by nc nd(?: [1-4] [05])?", "cc by nc nd [1-4] [05]"),
    ("cc-by-nc-sa", "cc", "cc by nc sa(?: [1-4] [05])?", "cc by nc sa [1-4] [05]"),
    ("cc-by-nc", "cc", "cc by nc(?: [1-4] [05])?", "cc by nc [1-4] [05]"),
    ("cc-by-nd", "cc", "cc by nd(?: [1-4] [05])?", "cc by nd [1-4] [05]"),
    ("cc-by-sa", "cc", "cc by sa(?: [1-4] [05])?", "cc by sa [1-4] [05]"),
    ("cc-by", "cc", "cc by(?: [1-4] [05])?", "cc by [1-4] [05]"),
    ("cc-by-nc-nd", "commons", "creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?", "by nc nd"),
    ("cc-by-nc-sa", "commons", "creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?", "by nc sa"),
    ("cc-by-nc", "commons", "creative commons attribution non ?commercial(?: [1-4] [05])?", "by nc"),
    ("cc-by-nd", "commons", "creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?", "by nd"),
    ("cc-by-sa", "commons", "creative commons attribution share ?alike(?: [1-4] [05])?", "by sa"),
    ("cc-by", "commons", "creative commons attribution(?: [1-4] [05])?", "by"),
    ("public-domain", "public domain", "public domain", "public domain"),
    ("proprietary", "all rights", "all rights reserved", "all rights reserved"),
]

# How a family is met in texts: weight of the evidence in percent, pattern. Earlier
# forms are the surer ones and win over later ones where they overlap.
FORMS = [
    (100, "spdx license identifier {id}"),
    (95, "(?:licensed|released|distributed|published|available|provided|made available|free software) under (?:the )?(?:terms (?:and conditions )?of )?(?:the |an? )?{name}(?: (?:international|unported|public))?(?: licen[cs]e)?"),
    (90, "(?:under|subject to|in accordance with|governed by) (?:the )?(?:terms (?:and conditions )?of )?(?:the |an? )?{name}(?: licen[cs]e)?"),
    (85, "licen[cs]ed?(?: is| as| type| name)? {name}"),
    (80, "{name} licen[cs]e(?:d)?"),
    (60, "(?:see|read|accept|dedicated to) (?:the )?{name}"),
]

# The base phrases and their labels.
BASE = [("under the mit license", "mit", "mit"), ("apache license version 2", "apache-2", "apache"), ("cc by nc", "cc-by-nc", "cc")]


class Rule(NamedTuple):
    priority: int
    label: str
    keyword: str
    pattern: str
    weight: int
    base: bool


def _whole_words(pattern: str) -> str:
    return f"(?<![^ ])(?:{pattern})(?![^ ])"


def rules() -> list[Rule]:
    """All rules by priority: the base phrases, then form by form."""
    out = [Rule(0, label, keyword, _whole_words(phrase), 90, True) for phrase, label, keyword in BASE]
    for weight, form in FORMS:
        for label, keyword, name, identifier in FAMILIES:
            pattern = form.format(name=f"(?:{name})", id=f"(?:{identifier})")
            out.append(Rule(len(out), label, keyword, _whole_words(pattern), weight, False))
    return out
