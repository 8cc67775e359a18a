"""The signature rules of the license scan.

A line is: priority | label | keyword | regex. Texts are matched as their words
(lower case, split at every other ASCII character) with single spaces between, so a
regex needs no case or punctuation; it starts and ends at word borders. The keyword
is a plain string that any match contains; a regex is only run where it occurs.
Priorities: 4 tags and addresses, 3 license texts and full notices, 2 names with a
version, 1 bare names.
"""

from __future__ import annotations

RULES = r"""
3 | gpl-2.0-only | general public license | gnu general public license version 2 (?:only|as published by the free software foundation)
3 | gpl-2.0-or-later | general public license | (?:gnu )?general public license(?: as published by the free software foundation)? either version 2 of the license or at your option any later version
3 | gpl-2.0-or-later | general public license | gnu general public license version 2 or (?:\(?at your option\)? )?(?:any )?later(?: version)?
3 | gpl-3.0-or-later | general public license | (?:gnu )?general public license(?: as published by the free software foundation)? either version 3 of the license or at your option any later version
3 | gpl-3.0-or-later | general public license | gnu general public license version 3 or (?:at your option )?(?:any )?later(?: version)?
3 | gpl-3.0-only | general public license | gnu general public license version 3 (?:only|as published by the free software foundation)
2 | gpl-2.0 | general public license | gnu general public license v(?:ersion )? ?2(?: 0)?
2 | gpl-3.0 | general public license | gnu general public license v(?:ersion )? ?3(?: 0)?
2 | gpl-1.0 | general public license | gnu general public license v(?:ersion )? ?1(?: 0)?
1 | gpl | general public license | gnu general public license
1 | gpl | general public licence | gnu general public licence
2 | gpl-2.0 | gpl | (?:gnu )?gpl ?v(?:ersion )?2(?: 0)?
2 | gpl-3.0 | gpl | (?:gnu )?gpl ?v(?:ersion )?3(?: 0)?
2 | gpl-2.0 | gplv2 | (?:gnu )?gplv2(?: 0)?
2 | gpl-3.0 | gplv3 | (?:gnu )?gplv3(?: 0)?
2 | gpl-2.0-or-later | gpl | gpl 2 0 or later
2 | gpl-3.0-or-later | gpl | gpl 3 0 or later
2 | gpl-2.0-only | gpl | gpl 2 0 only
2 | gpl-3.0-only | gpl | gpl 3 0 only
2 | gpl-2.0 | gpl | gpl 2 0
2 | gpl-3.0 | gpl | gpl 3 0
4 | gpl-2.0 | licenses gpl 2 0 | (?:www )?gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt)?
4 | gpl-3.0 | licenses gpl 3 0 | (?:www )?gnu org licenses gpl 3 0(?: html| txt)?
4 | gpl | gnu org licenses | (?:www )?gnu org licenses gpl(?: html)?
4 | gpl | gnu org copyleft | (?:www )?gnu org copyleft gpl html
4 | gpl-1.0-or-later | spdx | spdx license identifier gpl 1 0 or later
4 | gpl-2.0-or-later | spdx | spdx license identifier gpl 2 0 or later
4 | gpl-2.0-only | spdx | spdx license identifier gpl 2 0(?: only)?
4 | gpl-3.0-or-later | spdx | spdx license identifier gpl 3 0 or later
4 | gpl-3.0-only | spdx | spdx license identifier gpl 3 0(?: only)?
3 | gpl | general public license | you should have received a copy of the gnu general public license along with this (?:program|library|software|file|package)
3 | gpl | general public license | under the terms of the gnu general public license
3 | gpl | licensed under the gpl | (?:is )?(?:released|licensed|distributed) under the gpl
3 | gpl-2.0 | general public license | this program is free software you can redistribute it and or modify it under the terms of version 2 of the gnu general public license
3 | gpl-3.0 | general public license | gnu general public license version 3 29 june 2007
3 | gpl-2.0 | general public license | gnu general public license version 2 june 1991
3 | gpl-2.0-with-classpath-exception | classpath | (?:gpl|gnu general public license) (?:v(?:ersion )?2 )?with (?:the )?classpath exception
3 | lgpl-2.1-or-later | lesser general public license | (?:gnu )?lesser general public license(?: as published by the free software foundation)? either version 2 1 of the license or at your option any later version
3 | lgpl-3.0-or-later | lesser general public license | (?:gnu )?lesser general public license(?: as published by the free software foundation)? either version 3 of the license or at your option any later version
3 | lgpl-2.1 | lesser general public license | gnu lesser general public license version 2 1 february 1999
3 | lgpl-3.0 | lesser general public license | gnu lesser general public license version 3 29 june 2007
2 | lgpl-2.1 | lesser general public license | gnu lesser general public license v(?:ersion )? ?2 1
2 | lgpl-3.0 | lesser general public license | gnu lesser general public license v(?:ersion )? ?3(?: 0)?
2 | lgpl-2.0 | library general public license | gnu library general public license v(?:ersion )? ?2(?: 0)?
1 | lgpl | lesser general public license | (?:gnu )?lesser general public license
1 | lgpl-2.0 | library general public license | (?:gnu )?library general public license
2 | lgpl-2.1 | lgpl | (?:gnu )?lgpl ?v(?:ersion )?2 1
2 | lgpl-3.0 | lgpl | (?:gnu )?lgpl ?v(?:ersion )?3(?: 0)?
2 | lgpl-2.1 | lgplv2 | (?:gnu )?lgplv2 1
2 | lgpl-3.0 | lgplv3 | (?:gnu )?lgplv3
4 | lgpl-2.1-or-later | spdx | spdx license identifier lgpl 2 1 or later
4 | lgpl-2.1-only | spdx | spdx license identifier lgpl 2 1(?: only)?
4 | lgpl-3.0-or-later | spdx | spdx license identifier lgpl 3 0 or later
4 | lgpl-3.0-only | spdx | spdx license identifier lgpl 3 0(?: only)?
4 | lgpl | gnu org licenses | (?:www )?gnu org licenses lgpl(?: \d \d)?(?: html| txt)?
3 | agpl-3.0-or-later | affero general public license | (?:gnu )?affero general public license(?: as published by the free software foundation)? either version 3 of the license or at your option any later version
3 | agpl-3.0 | affero general public license | gnu affero general public license version 3 19 november 2007
2 | agpl-3.0 | affero general public license | gnu affero general public license v(?:ersion )? ?3(?: 0)?
1 | agpl | affero general public license | (?:gnu )?affero general public license
2 | agpl-3.0 | agpl | (?:gnu )?agpl ?v(?:ersion )?3(?: 0)?
2 | agpl-3.0 | agplv3 | (?:gnu )?agplv3
4 | agpl-3.0-or-later | spdx | spdx license identifier agpl 3 0 or later
4 | agpl-3.0-only | spdx | spdx license identifier agpl 3 0(?: only)?
4 | agpl-3.0 | gnu org licenses | (?:www )?gnu org licenses agpl(?: 3 0)?(?: html)?
2 | gfdl-1.3 | free documentation license | gnu free documentation license v(?:ersion )? ?1 3
2 | gfdl-1.2 | free documentation license | gnu free documentation license v(?:ersion )? ?1 2
1 | gfdl | free documentation license | gnu free documentation license
4 | gfdl | gnu org licenses | (?:www )?gnu org licenses fdl(?: \d \d)?(?: html)?
3 | apache-2.0 | apache license | licensed under the apache license version 2 0(?: the license)?
3 | apache-2.0 | apache license | licensed to the apache software foundation asf under one or more contributor license agreements
3 | apache-2.0 | apache license | apache license version 2 0 january 2004
2 | apache-2.0 | apache license | (?:the )?apache license,? (?:version |v )?2(?: 0)?
2 | apache-2.0 | apache license | apache license v2(?: 0)?
2 | apache-2.0 | apache software license | apache software license (?:version |v )?2(?: 0)?
2 | apache-1.1 | apache software license | (?:the )?apache software license (?:version |v )?1 1
2 | apache-1.1 | apache license | apache license (?:version |v )?1 1
2 | apache-1.0 | apache license | apache license (?:version |v )?1 0
1 | apache | apache license | apache license
1 | apache | apache software license | apache software license
2 | apache-2.0 | apache 2 | apache 2(?: 0)?(?: license(?:d)?)?
4 | apache-2.0 | apache org licenses | (?:www )?apache org licenses license 2 0(?: html| txt)?
4 | apache-2.0 | spdx | spdx license identifier apache 2 0
4 | apache-1.1 | spdx | spdx license identifier apache 1 1
3 | mit | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
3 | mit | the software is provided as is | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
3 | mit | mit license | (?:is )?(?:released|licensed|distributed|available) under the (?:terms of the )?mit license
3 | mit-0 | mit no attribution | mit no attribution(?: license)?
1 | mit | mit license | (?:the )?mit license
1 | mit | mit licence | (?:the )?mit licence
2 | mit | mit licensed | mit licensed
2 | mit | expat license | expat license
4 | mit | licenses mit | (?:www )?opensource org licenses mit(?: license)?(?: php)?
4 | mit | spdx | spdx license identifier mit
4 | mit-0 | spdx | spdx license identifier mit 0
2 | x11 | x11 license | x11 license
3 | isc | permission to use copy modify | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
1 | isc | isc license | isc license
1 | isc | isc licence | isc licence
4 | isc | spdx | spdx license identifier isc
4 | isc | licenses isc | opensource org licenses isc(?: license)?
3 | bsd-3-clause | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met .{0,900}?neither the name
3 | bsd-2-clause | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
3 | bsd-4-clause | advertising materials mentioning | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
2 | bsd-3-clause | bsd | (?:3 clause|three clause|new|modified|revised) bsd(?: license| licence)?
2 | bsd-2-clause | bsd | (?:2 clause|two clause|simplified|freebsd) bsd(?: license| licence)?
2 | bsd-4-clause | bsd | (?:4 clause|four clause|original|old) bsd(?: license| licence)?
2 | bsd-3-clause | bsd 3 | bsd 3 clause(?: license)?
2 | bsd-2-clause | bsd 2 | bsd 2 clause(?: license)?
2 | 0bsd | zero clause bsd | (?:bsd )?zero clause bsd(?: license)?
2 | 0bsd | 0bsd | 0bsd
1 | bsd | bsd license | bsd(?: style)? license
1 | bsd | bsd licence | bsd(?: style)? licence
4 | bsd-3-clause | spdx | spdx license identifier bsd 3 clause
4 | bsd-2-clause | spdx | spdx license identifier bsd 2 clause
4 | 0bsd | spdx | spdx license identifier 0bsd
4 | bsd-3-clause | licenses bsd | opensource org licenses bsd (?:3 clause|license)(?: php)?
4 | bsd-2-clause | licenses bsd | opensource org licenses bsd 2 clause
3 | mpl-2.0 | mozilla public license | this source code form is subject to the terms of the mozilla public license v 2 0
3 | mpl-1.1 | mozilla public license | the contents of this file are subject to the mozilla public license version 1 1
2 | mpl-2.0 | mozilla public license | mozilla public license (?:version |v )?2(?: 0)?
2 | mpl-1.1 | mozilla public license | mozilla public license (?:version |v )?1 1
2 | mpl-1.0 | mozilla public license | mozilla public license (?:version |v )?1 0
1 | mpl | mozilla public license | mozilla public license
2 | mpl-2.0 | mpl | mpl (?:v|version )?2 0
2 | mpl-1.1 | mpl | mpl (?:v|version )?1 1
4 | mpl-2.0 | mozilla org mpl | (?:www )?mozilla org mpl 2 0
4 | mpl | mozilla org mpl | (?:www )?mozilla org mpl
4 | mpl-2.0 | spdx | spdx license identifier mpl 2 0
2 | epl-2.0 | eclipse public license | eclipse public license (?:version |v )?2(?: 0)?
2 | epl-1.0 | eclipse public license | eclipse public license (?:version |v )?1(?: 0)?
1 | epl | eclipse public license | eclipse public license
4 | epl-2.0 | spdx | spdx license identifier epl 2 0
4 | epl-1.0 | spdx | spdx license identifier epl 1 0
4 | epl | eclipse org legal | (?:www )?eclipse org legal epl v\d\d(?: html)?
2 | edl-1.0 | eclipse distribution license | eclipse distribution license (?:version |v )?1 0
2 | cddl-1.1 | common development and distribution license | common development and distribution license (?:version |v )?1 1
2 | cddl-1.0 | common development and distribution license | common development and distribution license(?: cddl)?(?: version| v)? 1 0
1 | cddl | common development and distribution license | common development and distribution license
4 | cddl-1.0 | spdx | spdx license identifier cddl 1 0
2 | cpl-1.0 | common public license | common public license (?:version |v )?1 0
1 | cpl-1.0 | common public license | common public license
2 | ipl-1.0 | ibm public license | ibm public license(?: version| v)? 1 0
2 | artistic-2.0 | artistic license | artistic license (?:version |v )?2(?: 0)?
2 | artistic-1.0 | artistic license | artistic license (?:version |v )?1(?: 0)?
1 | artistic | artistic license | artistic license
2 | artistic-1.0-perl | same terms as perl | (?:under )?the same terms as perl(?: itself)?
4 | artistic-2.0 | spdx | spdx license identifier artistic 2 0
3 | zlib | this software is provided as is | this software is provided as is without any express or implied warranty in no event will the authors be held liable
1 | zlib | zlib license | zlib(?: libpng)? license
4 | zlib | spdx | spdx license identifier zlib
3 | bsl-1.0 | boost software license | distributed under the boost software license version 1 0
2 | bsl-1.0 | boost software license | boost software license (?:version |v )?1(?: 0)?
1 | bsl-1.0 | boost software license | boost software license
4 | bsl-1.0 | boost org license | (?:www )?boost org license 1 0 txt
4 | bsl-1.0 | spdx | spdx license identifier bsl 1 0
2 | busl-1.1 | business source license | business source license(?: version| v)? 1 1
1 | busl | business source license | business source license
4 | busl-1.1 | spdx | spdx license identifier busl 1 1
2 | sspl-1.0 | server side public license | server side public license(?: version| v)? 1(?: 0)?
1 | sspl | server side public license | server side public license
2 | elastic-2.0 | elastic license | elastic license (?:version |v )?2(?: 0)?
1 | elastic | elastic license | elastic license
2 | postgresql | postgresql licen | (?:the )?postgresql licen[cs]e
2 | python-2.0 | python software foundation license | python software foundation license(?: version)?(?: 2)?
2 | python-2.0 | psf license | psf license(?: agreement)?
2 | ruby | ruby license | ruby s? ?license
2 | php-3.01 | php license | php license (?:version |v )?3 01
1 | php | php license | php license
2 | openssl | openssl license | openssl license
2 | ssleay | ssleay license | ssleay license
2 | ofl-1.1 | open font license | (?:sil )?open font license (?:version |v )?1 1
1 | ofl | open font license | (?:sil )?open font license
4 | ofl-1.1 | spdx | spdx license identifier ofl 1 1
4 | ofl | scripts sil org | scripts sil org ofl
2 | eupl-1.2 | european union public licen | european union public licen[cs]e(?: version| v)? ?1 2
2 | eupl-1.1 | european union public licen | european union public licen[cs]e(?: version| v)? ?1 1
1 | eupl | european union public licen | european union public licen[cs]e
4 | eupl-1.2 | spdx | spdx license identifier eupl 1 2
2 | ms-pl | microsoft public license | microsoft public license
2 | ms-rl | microsoft reciprocal license | microsoft reciprocal license
4 | ms-pl | spdx | spdx license identifier ms pl
2 | qpl-1.0 | q public license | q public license(?: version| v)?(?: 1 0)?
2 | osl-3.0 | open software license | open software license (?:version |v )?3(?: 0)?
1 | osl | open software license | open software license
2 | afl-3.0 | academic free license | academic free license (?:version |v )?3(?: 0)?
1 | afl | academic free license | academic free license
2 | ncsa | ncsa open source license | (?:university of illinois )?ncsa open source license
2 | curl | curl license | curl license
2 | vim | vim license | vim license
2 | beerware | beer ware license | (?:the )?beer ware license(?: revision 42)?
2 | wtfpl | public license | do what the f\S* you want to public license
2 | wtfpl | wtfpl | wtfpl
4 | wtfpl | spdx | spdx license identifier wtfpl
3 | unlicense | public domain | this is free and unencumbered software released into the public domain
2 | unlicense | unlicense | (?:the )?unlicense
4 | unlicense | spdx | spdx license identifier unlicense
4 | unlicense | unlicense org | unlicense org
3 | public-domain | public domain | (?:is )?(?:released|placed|dedicated) (?:in|into|to) the public domain
1 | public-domain | public domain | public domain
3 | cc0-1.0 | cc0 | cc0 1 0 universal(?: public domain dedication)?
2 | cc0-1.0 | cc0 | cc0(?: 1 0)?
4 | cc0-1.0 | publicdomain zero | creativecommons org publicdomain zero 1 0
4 | cc0-1.0 | spdx | spdx license identifier cc0 1 0
2 | cc-pdm-1.0 | publicdomain mark | creativecommons org publicdomain mark 1 0
2 | cc-by-nc-nd-4.0 | cc by | cc by nc nd 4 0
2 | cc-by-nc-nd-3.0 | cc by | cc by nc nd 3 0
2 | cc-by-nc-sa-4.0 | cc by | cc by nc sa 4 0
2 | cc-by-nc-sa-3.0 | cc by | cc by nc sa 3 0
2 | cc-by-nc-sa-2.0 | cc by | cc by nc sa 2 0
2 | cc-by-nc-4.0 | cc by | cc by nc 4 0
2 | cc-by-nc-3.0 | cc by | cc by nc 3 0
2 | cc-by-nd-4.0 | cc by | cc by nd 4 0
2 | cc-by-nd-3.0 | cc by | cc by nd 3 0
2 | cc-by-sa-4.0 | cc by | cc by sa 4 0
2 | cc-by-sa-3.0 | cc by | cc by sa 3 0
2 | cc-by-sa-2.5 | cc by | cc by sa 2 5
2 | cc-by-sa-2.0 | cc by | cc by sa 2 0
2 | cc-by-4.0 | cc by | cc by 4 0
2 | cc-by-3.0 | cc by | cc by 3 0
2 | cc-by-2.5 | cc by | cc by 2 5
2 | cc-by-2.0 | cc by | cc by 2 0
1 | cc-by-nc-nd | cc by | cc by nc nd
1 | cc-by-nc-sa | cc by | cc by nc sa
1 | cc-by-nc | cc by | cc by nc
1 | cc-by-nd | cc by | cc by nd
1 | cc-by-sa | cc by | cc by sa
1 | cc-by | cc by | cc by
2 | cc-by-4.0 | creative commons attribution | creative commons attribution 4 0(?: international)?(?: license| licence)?
2 | cc-by-3.0 | creative commons attribution | creative commons attribution 3 0(?: unported)?(?: license| licence)?
2 | cc-by-sa-4.0 | creative commons attribution | creative commons attribution share ?alike 4 0(?: international)?(?: license| licence)?
2 | cc-by-sa-3.0 | creative commons attribution | creative commons attribution share ?alike 3 0(?: unported)?(?: license| licence)?
2 | cc-by-nc-4.0 | creative commons attribution | creative commons attribution non ?commercial 4 0(?: international)?(?: license| licence)?
2 | cc-by-nc-sa-4.0 | creative commons attribution | creative commons attribution non ?commercial share ?alike 4 0(?: international)?(?: license| licence)?
2 | cc-by-nc-nd-4.0 | creative commons attribution | creative commons attribution non ?commercial no ?deriv(?:ative)?s 4 0(?: international)?(?: license| licence)?
2 | cc-by-nd-4.0 | creative commons attribution | creative commons attribution no ?deriv(?:ative)?s 4 0(?: international)?(?: license| licence)?
1 | cc-by-nc-nd | creative commons attribution | creative commons attribution non ?commercial no ?deriv(?:ative)?s
1 | cc-by-nc-sa | creative commons attribution | creative commons attribution non ?commercial share ?alike
1 | cc-by-nc | creative commons attribution | creative commons attribution non ?commercial
1 | cc-by-nd | creative commons attribution | creative commons attribution no ?deriv(?:ative)?s
1 | cc-by-sa | creative commons attribution | creative commons attribution share ?alike
1 | cc-by | creative commons attribution | creative commons attribution
4 | cc-by-4.0 | creativecommons org licenses | creativecommons org licenses by 4 0
4 | cc-by-3.0 | creativecommons org licenses | creativecommons org licenses by 3 0
4 | cc-by-sa-4.0 | creativecommons org licenses | creativecommons org licenses by sa 4 0
4 | cc-by-sa-3.0 | creativecommons org licenses | creativecommons org licenses by sa 3 0
4 | cc-by-nc-4.0 | creativecommons org licenses | creativecommons org licenses by nc 4 0
4 | cc-by-nc-sa-4.0 | creativecommons org licenses | creativecommons org licenses by nc sa 4 0
4 | cc-by-nc-nd-4.0 | creativecommons org licenses | creativecommons org licenses by nc nd 4 0
4 | cc-by-nd-4.0 | creativecommons org licenses | creativecommons org licenses by nd 4 0
4 | cc-by-4.0 | spdx | spdx license identifier cc by 4 0
4 | cc-by-sa-4.0 | spdx | spdx license identifier cc by sa 4 0
4 | cc-by-nc-4.0 | spdx | spdx license identifier cc by nc 4 0
2 | odbl-1.0 | open database license | open (?:data commons open )?database license(?: odbl)?(?: version| v)?(?: 1 0)?
2 | odc-by-1.0 | open data commons attribution | open data commons attribution license(?: version| v)?(?: 1 0)?
2 | pddl-1.0 | public domain dedication and license | (?:open data commons )?public domain dedication and license(?: version| v)?(?: 1 0)?
2 | cdla-permissive-2.0 | community data license agreement | community data license agreement permissive(?: version| v)?(?: 2 0)?
2 | cdla-sharing-1.0 | community data license agreement | community data license agreement sharing(?: version| v)?(?: 1 0)?
2 | openrail-m | rail | (?:creativeml )?open ?rail m(?: license)?
2 | ogl-3.0 | open government licence | open government licence(?: version| v)? ?3 0
1 | ogl | open government licence | open government licence
3 | all-rights-reserved | all rights reserved | all rights reserved
3 | proprietary | proprietary and confidential | proprietary and confidential(?: information)?
2 | proprietary | proprietary license | (?:under a )?proprietary license
2 | commercial | commercial license | commercial license(?: agreement)?
"""

BASE = {  # phrase -> label
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Every keyword holds one of these, so a text without them needs no look at the keywords.
GATES = ("licen", "copyright", "public domain", "publicdomain", "cc0", "cc by", "gpl", "mit no attribution", "permission ", "software is provided", "redistribution and use",
         "advertising materials", "bsd", "creative commons", "apache", "mpl", "wtfpl", "spdx", "mozilla org", "eclipse org", "scripts sil", "gnu org", "same terms as perl",
         "open data commons", "rail", "all rights reserved", "proprietary")


def rules() -> list[tuple[int, int, str, str, str]]:
    """(order, priority, label, keyword, regex with its word borders), in order."""
    out = []
    for line in RULES.strip().splitlines():
        priority, label, keyword, regex = (x.strip() for x in line.split(" | "))
        out.append((len(out), int(priority), label, keyword, f" {regex}(?= )"))
    return out
