"""Licence signatures: label | priority | keywords | pattern, one rule a line.

Patterns match whole words of a text's word sequence (lower case, words joined by single spaces, so ``2.0`` reads
``2 0``). A rule is tried only where one of its keywords (parted by
spaces) is one of the words, and every string that its pattern matches holds one of them. Priority: 5 identifiers and
notices that name a version, 4 versioned names and addresses, 3 names, 2 characteristic clauses, 1 hints.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    priority: int
    keywords: str
    pattern: str
    base: bool = False


BASE_RULES = [
    Rule("gpl", 3, "license", "gnu general public license", True),
    Rule("apache", 3, "license", "apache license", True),
    Rule("cc-by", 3, "cc", "cc by", True),
    Rule("mit", 3, "license", "mit license", True),
]

_TABLE = r"""
gpl-1.0|5|spdx|spdx license identifier gpl 1 0(?: only| or later)?
gpl-2.0|5|spdx|spdx license identifier gpl 2 0(?: only| or later)?
gpl-3.0|5|spdx|spdx license identifier gpl 3 0(?: only| or later)?
gpl-1.0|4|gnu|gnu general public licen[cs]e(?: as published by the free software foundation)?(?: either)?(?: version| v) ?1
gpl-2.0|4|gnu|gnu general public licen[cs]e(?: as published by the free software foundation)?(?: either)?(?: version| v) ?2
gpl-3.0|4|gnu|gnu general public licen[cs]e(?: as published by the free software foundation)?(?: either)?(?: version| v) ?3
gpl-2.0|4|gpl gpl2 gplv2 gplversion|(?:gnu )?gpl ?(?:v|version )?2(?: 0)?(?: or later| only)?
gpl-3.0|4|gpl gpl3 gplv3 gplversion|(?:gnu )?gpl ?(?:v|version )?3(?: 0)?(?: or later| only)?
gpl-2.0|4|gplv2|gplv2(?: or later| only)?
gpl-3.0|4|gplv3|gplv3(?: or later| only)?
gpl-2.0|4|licenses|gnu org licenses (?:old licenses )?gpl 2 0
gpl-3.0|4|licenses|gnu org licenses gpl 3 0
gpl|3|gnu|gnu gpl
gpl|3|gnu|gnu public licen[cs]e
gpl|2|licenses|gnu org licenses gpl
gpl|2|gnu|you should have received a copy of the gnu general public license
gpl|2|copyleft|strong copyleft
lgpl-2.0|5|spdx|spdx license identifier lgpl 2 0(?: only| or later)?
lgpl-2.1|5|spdx|spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-3.0|5|spdx|spdx license identifier lgpl 3 0(?: only| or later)?
lgpl-2.0|4|gnu|gnu (?:library|lesser) general public licen[cs]e(?: version| v) ?2(?! 1)
lgpl-2.1|4|gnu|gnu lesser general public licen[cs]e(?: version| v) ?2 1
lgpl-3.0|4|gnu|gnu lesser general public licen[cs]e(?: version| v) ?3
lgpl-2.1|4|lgpl lgpl2 lgplv2 lgplversion|lgpl ?(?:v|version )?2 1(?: or later| only)?
lgpl-3.0|4|lgpl lgpl3 lgplv3 lgplversion|lgpl ?(?:v|version )?3(?: 0)?(?: or later| only)?
lgpl|3|gnu|gnu (?:lesser|library) general public licen[cs]e
lgpl|3|lgpl|(?:gnu )?lgpl
lgpl|2|licenses|gnu org licenses lgpl
agpl-3.0|5|spdx|spdx license identifier agpl 3 0(?: only| or later)?
agpl-3.0|4|affero|gnu affero general public licen[cs]e(?: version| v) ?3
agpl-1.0|4|affero|affero general public licen[cs]e(?: version| v) ?1
agpl-3.0|4|agpl agpl3 agplv3 agplversion|agpl ?(?:v|version )?3(?: 0)?(?: or later| only)?
agpl-3.0|4|agplv3|agplv3
agpl|3|affero|(?:gnu )?affero general public licen[cs]e
agpl|3|agpl|(?:gnu )?agpl
gfdl-1.1|5|spdx|spdx license identifier gfdl 1 1(?: only| or later)?
gfdl-1.2|5|spdx|spdx license identifier gfdl 1 2(?: only| or later)?
gfdl-1.3|5|spdx|spdx license identifier gfdl 1 3(?: only| or later)?
gfdl-1.2|4|documentation|gnu free documentation licen[cs]e(?: version| v) ?1 2
gfdl-1.3|4|documentation|gnu free documentation licen[cs]e(?: version| v) ?1 3
gfdl|3|documentation|gnu free documentation licen[cs]e
gfdl|3|gfdl|(?:gnu )?gfdl
apache-1.0|5|spdx|spdx license identifier apache 1 0
apache-1.1|5|spdx|spdx license identifier apache 1 1
apache-2.0|5|spdx|spdx license identifier apache 2 0
apache-1.1|4|apache|apache (?:software )?licen[cs]e(?: version| v)? ?1 1
apache-1.0|4|apache|apache (?:software )?licen[cs]e(?: version| v)? ?1 0
apache-2.0|5|apache|licensed under (?:the )?apache (?:software )?licen[cs]e(?: version| v)? ?2(?: 0)?
apache-2.0|4|apache|apache (?:software )?licen[cs]e(?: version| v)? ?2(?: 0)?
apache-2.0|4|apache|apache 2 0(?: licen[cs]ed?)?
apache-2.0|4|licenses|apache org licenses license 2 0
apache-2.0|4|asl|asl 2 0
apache|3|apache|apache software licen[cs]e
apache|3|apache|apache licensed
apache|2|apache|apache software foundation
mit|5|spdx|spdx license identifier mit
mit-0|5|spdx|spdx license identifier mit 0
mit|5|license|licensed under (?:the )?mit license
mit|5|license|released under (?:the )?mit license
mit|4|license|the mit license mit
mit-0|4|attribution|mit no attribution
mit|3|expat|expat licen[cs]e
mit|3|x11|(?:mit )?x11 licen[cs]e
mit|3|licensed|mit licensed
mit|2|licenses|opensource org licenses mit
mit|2|obtaining|permission is hereby granted free of charge to any person obtaining a copy
mit|2|sublicense|to use copy modify merge publish distribute sublicense and or sell copies
bsd-0-clause|5|spdx|spdx license identifier 0bsd
bsd-1-clause|5|spdx|spdx license identifier bsd 1 clause
bsd-2-clause|5|spdx|spdx license identifier bsd 2 clause
bsd-3-clause|5|spdx|spdx license identifier bsd 3 clause
bsd-4-clause|5|spdx|spdx license identifier bsd 4 clause
bsd-2-clause|4|bsd|(?:bsd )?(?:2|two) clause bsd(?: licen[cs]e)?
bsd-3-clause|4|bsd|(?:3|three) clause bsd(?: licen[cs]e)?
bsd-4-clause|4|bsd|(?:4|four) clause bsd(?: licen[cs]e)?
bsd-2-clause|4|bsd|bsd (?:2|two) clause(?: licen[cs]e)?
bsd-3-clause|4|bsd|bsd (?:3|three) clause(?: licen[cs]e)?
bsd-4-clause|4|bsd|bsd (?:4|four) clause(?: licen[cs]e)?
bsd-2-clause|3|bsd|simplified bsd licen[cs]e
bsd-2-clause|3|freebsd|freebsd licen[cs]e
bsd-3-clause|3|bsd|(?:new|revised|modified) bsd licen[cs]e
bsd-4-clause|3|bsd|(?:old|original) bsd licen[cs]e
bsd|3|bsd|bsd(?: style)? licen[cs]ed?
bsd|2|redistribution|redistribution and use in source and binary forms
bsd-3-clause|2|endorse|be used to endorse or promote products derived from this software
bsd-4-clause|2|advertising|all advertising materials mentioning features or use of this software
bsd|2|redistributions|redistributions of source code must retain the above copyright notice
bsd|2|redistributions|redistributions in binary form must reproduce the above copyright notice
mpl-1.0|5|spdx|spdx license identifier mpl 1 0
mpl-1.1|5|spdx|spdx license identifier mpl 1 1
mpl-2.0|5|spdx|spdx license identifier mpl 2 0
mpl-1.1|4|mozilla|mozilla public licen[cs]e(?: version| v)? ?1 1
mpl-2.0|4|mozilla|mozilla public licen[cs]e(?: version| v)? ?2(?: 0)?
mpl-1.1|4|mpl|mpl (?:version )?1 1
mpl-2.0|4|mpl|mpl (?:version )?2(?: 0)?
mpl-2.0|4|mozilla|mozilla org mpl 2 0
mpl|3|mozilla|mozilla public licen[cs]e
npl|3|netscape|netscape public licen[cs]e
epl-1.0|5|spdx|spdx license identifier epl 1 0
epl-2.0|5|spdx|spdx license identifier epl 2 0
epl-1.0|4|eclipse|eclipse public licen[cs]e(?: version| v)? ?1(?: 0)?
epl-2.0|4|eclipse|eclipse public licen[cs]e(?: version| v)? ?2(?: 0)?
epl|3|eclipse|eclipse public licen[cs]e
edl-1.0|4|eclipse|eclipse distribution licen[cs]e(?: version| v)? ?1(?: 0)?
edl|3|eclipse|eclipse distribution licen[cs]e
cpl-1.0|4|license licence licence1 license1|common public licen[cs]e(?: version| v)? ?1(?: 0)?
cpl|3|license|common public license
cddl-1.0|5|spdx|spdx license identifier cddl 1 0
cddl-1.1|5|spdx|spdx license identifier cddl 1 1
cddl-1.0|4|cddl|cddl (?:version )?1 0
cddl-1.1|4|cddl|cddl (?:version )?1 1
cddl|3|distribution|common development and distribution licen[cs]e
cddl|3|cddl|cddl
cc0-1.0|5|spdx|spdx license identifier cc0 1 0
cc-by-3.0|5|spdx|spdx license identifier cc by 3 0
cc-by-4.0|5|spdx|spdx license identifier cc by 4 0
cc-by-sa-3.0|5|spdx|spdx license identifier cc by sa 3 0
cc-by-sa-4.0|5|spdx|spdx license identifier cc by sa 4 0
cc-by-nc-4.0|5|spdx|spdx license identifier cc by nc 4 0
cc-by-nd-4.0|5|spdx|spdx license identifier cc by nd 4 0
cc-by-nc-sa-4.0|5|spdx|spdx license identifier cc by nc sa 4 0
cc-by-nc-nd-4.0|5|spdx|spdx license identifier cc by nc nd 4 0
cc-by-1.0|4|cc|cc by 1 0
cc-by-2.0|4|cc|cc by 2 0
cc-by-2.5|4|cc|cc by 2 5
cc-by-3.0|4|cc|cc by 3 0
cc-by-4.0|4|cc|cc by 4 0
cc-by-sa-2.0|4|cc|cc by sa 2 0
cc-by-sa-2.5|4|cc|cc by sa 2 5
cc-by-sa-3.0|4|cc|cc by sa 3 0
cc-by-sa-4.0|4|cc|cc by sa 4 0
cc-by-nc-2.0|4|cc|cc by nc 2 0
cc-by-nc-2.5|4|cc|cc by nc 2 5
cc-by-nc-3.0|4|cc|cc by nc 3 0
cc-by-nc-4.0|4|cc|cc by nc 4 0
cc-by-nd-2.0|4|cc|cc by nd 2 0
cc-by-nd-3.0|4|cc|cc by nd 3 0
cc-by-nd-4.0|4|cc|cc by nd 4 0
cc-by-nc-sa-2.0|4|cc|cc by nc sa 2 0
cc-by-nc-sa-2.5|4|cc|cc by nc sa 2 5
cc-by-nc-sa-3.0|4|cc|cc by nc sa 3 0
cc-by-nc-sa-4.0|4|cc|cc by nc sa 4 0
cc-by-nc-nd-2.0|4|cc|cc by nc nd 2 0
cc-by-nc-nd-2.5|4|cc|cc by nc nd 2 5
cc-by-nc-nd-3.0|4|cc|cc by nc nd 3 0
cc-by-nc-nd-4.0|4|cc|cc by nc nd 4 0
cc-by-sa|3|cc|cc by sa
cc-by-nc|3|cc|cc by nc
cc-by-nd|3|cc|cc by nd
cc-by-nc-sa|3|cc|cc by nc sa
cc-by-nc-nd|3|cc|cc by nc nd
cc0-1.0|4|cc0|cc0 1 0(?: universal)?
cc0-1.0|3|cc0|cc0
cc-by-4.0|4|creativecommons|creativecommons org licenses by 4 0
cc-by-3.0|4|creativecommons|creativecommons org licenses by 3 0
cc-by-2.0|4|creativecommons|creativecommons org licenses by 2 0
cc-by-sa-4.0|4|creativecommons|creativecommons org licenses by sa 4 0
cc-by-sa-3.0|4|creativecommons|creativecommons org licenses by sa 3 0
cc-by-nc-4.0|4|creativecommons|creativecommons org licenses by nc 4 0
cc-by-nc-3.0|4|creativecommons|creativecommons org licenses by nc 3 0
cc-by-nd-4.0|4|creativecommons|creativecommons org licenses by nd 4 0
cc-by-nc-sa-4.0|4|creativecommons|creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0|4|creativecommons|creativecommons org licenses by nc nd 4 0
cc0-1.0|4|creativecommons|creativecommons org publicdomain zero 1 0
cc-pdm-1.0|4|creativecommons|creativecommons org publicdomain mark 1 0
cc-by-4.0|4|creative|creative commons attribution(?: international)? 4 0(?: international)?
cc-by-3.0|4|creative|creative commons attribution 3 0(?: unported)?
cc-by-2.0|4|creative|creative commons attribution 2 0(?: generic)?
cc-by-sa-4.0|4|creative|creative commons attribution share ?alike(?: international)? 4 0(?: international)?
cc-by-sa-3.0|4|creative|creative commons attribution share ?alike 3 0(?: unported)?
cc-by-nc-4.0|4|creative|creative commons attribution non ?commercial(?: international)? 4 0(?: international)?
cc-by-nc-3.0|4|creative|creative commons attribution non ?commercial 3 0(?: unported)?
cc-by-nd-4.0|4|creative|creative commons attribution no ?deriv(?:ative)?s 4 0(?: international)?
cc-by-nc-sa-4.0|4|creative|creative commons attribution non ?commercial share ?alike 4 0(?: international)?
cc-by-nc-nd-4.0|4|creative|creative commons attribution non ?commercial no ?deriv(?:ative)?s 4 0(?: international)?
cc-by|3|creative|creative commons attribution(?: licen[cs]e)?
cc-by-sa|3|creative|creative commons attribution share ?alike(?: licen[cs]e)?
cc-by-nc|3|creative|creative commons attribution non ?commercial(?: licen[cs]e)?
creative-commons|2|creative|creative commons(?: licen[cs]e)?
public-domain|3|domain|(?:released|dedicated|placed)(?: in)?(?: to| into)? the public domain
public-domain|2|domain|public domain dedication
public-domain|1|domain|public domain
unlicense|5|spdx|spdx license identifier unlicense
unlicense|3|unlicense|(?:the )?unlicense
unlicense|2|unencumbered|free and unencumbered software released into the public domain
isc|5|spdx|spdx license identifier isc
isc|3|isc|(?:the )?isc licen[cs]ed?
isc|2|software|permission to use copy modify and or distribute this software for any purpose
zlib|5|spdx|spdx license identifier zlib
zlib|3|zlib|zlib(?: libpng)? licen[cs]e
libpng|3|libpng|libpng licen[cs]e
boost-1.0|5|spdx|spdx license identifier bsl 1 0
boost-1.0|4|boost|boost software licen[cs]e(?: version| v)? ?1 0
boost-1.0|3|boost|boost software licen[cs]e
business-source-1.1|4|source|business source licen[cs]e(?: version| v)? ?1 1
business-source|3|source|business source licen[cs]e
sspl-1.0|5|spdx|spdx license identifier sspl 1 0
sspl-1.0|4|server|server side public licen[cs]e(?: version| v)? ?1
sspl|3|sspl|sspl
elastic-2.0|4|elastic|elastic licen[cs]e 2 0
elastic|3|elastic|elastic licen[cs]e
artistic-1.0|5|spdx|spdx license identifier artistic 1 0
artistic-2.0|5|spdx|spdx license identifier artistic 2 0
artistic-2.0|4|artistic|artistic licen[cs]e(?: version| v)? ?2(?: 0)?
artistic-1.0|4|artistic|artistic licen[cs]e(?: version| v)? ?1(?: 0)?
artistic|3|artistic|artistic licen[cs]e
wtfpl|5|spdx|spdx license identifier wtfpl
wtfpl|3|wtfpl|wtfpl(?: version 2)?
ofl-1.1|5|spdx|spdx license identifier ofl 1 1
ofl-1.1|4|font|sil open font licen[cs]e(?: version| v)? ?1 1
ofl|3|font|(?:sil )?open font licen[cs]e
eupl-1.1|5|spdx|spdx license identifier eupl 1 1
eupl-1.2|5|spdx|spdx license identifier eupl 1 2
eupl-1.1|4|eupl|eupl (?:v|version )?1 1
eupl-1.2|4|eupl|eupl (?:v|version )?1 2
eupl|3|european|european union public licen[cs]e
odbl-1.0|5|spdx|spdx license identifier odbl 1 0
odbl-1.0|3|database|open (?:data commons open )?database licen[cs]e
odc-by-1.0|3|attribution|open data commons attribution licen[cs]e
pddl-1.0|3|dedication|public domain dedication and licen[cs]e
python-2.0|5|spdx|spdx license identifier (?:python|psf) 2 0
python|3|python|python software foundation licen[cs]e
php-3.0|4|php|php licen[cs]e(?: version| v)? ?3(?: 0)?
php|3|php|php licen[cs]e
ruby|3|ruby|ruby licen[cs]e
postgresql|5|spdx|spdx license identifier postgresql
postgresql|3|postgresql|postgresql licen[cs]e
openssl|3|openssl|openssl licen[cs]e
w3c|3|w3c|w3c software (?:notice and )?licen[cs]e
ms-pl|5|spdx|spdx license identifier ms pl
ms-pl|3|microsoft|microsoft public licen[cs]e
ms-rl|3|microsoft|microsoft reciprocal licen[cs]e
afl-3.0|4|academic|academic free licen[cs]e(?: version| v)? ?3(?: 0)?
afl|3|academic|academic free licen[cs]e
osl-3.0|4|license licence licence3 license3|open software licen[cs]e(?: version| v)? ?3(?: 0)?
upl-1.0|4|universal|universal permissive licen[cs]e(?: version| v)? ?1(?: 0)?
ncsa|3|ncsa|(?:university of illinois )?ncsa open source licen[cs]e
beerware|3|beerware|beerware(?: licen[cs]e)?
openrail|3|openrail|(?:creativeml )?openrail m?
llama|3|llama|llama (?:2 |3 )?community licen[cs]e
proprietary|3|proprietary|proprietary and confidential
proprietary|2|reserved|all rights reserved
proprietary|2|reproduced|no part of this (?:work|publication|document) may be reproduced
licensed|1|licensed|licensed under(?: the)?
licensed|1|licence|licen[cs]ed? under(?: the)? licence
copyright|1|copyright|copyright(?: c)?(?: 19[0-9][0-9]| 20[0-9][0-9])
"""

RULES = [*BASE_RULES, *(Rule(x[0], int(x[1]), x[2], x[3]) for x in (line.split("|", 3) for line in _TABLE.strip().splitlines()))]
