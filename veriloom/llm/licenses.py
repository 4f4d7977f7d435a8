"""License scans: ordered signature rules with a keyword gate, priorities and interval containment.

A text becomes its words (ASCII letters lower-cased, digits, any character beyond ASCII) joined by single
spaces.  Each rule is a regular expression over that form, tried only where one of its gate's words occurs.  Of the
detections, one inside a longer one, or of equal extent with one of higher priority or, at that, an earlier rule, is
suppressed; from left to right, of two that still overlap the one of lower priority goes, the later at a tie.  Base
phrases are counted wherever they stand and their labels are never suppressed.

Null texts count as empty and have no words; null ids stay null; an empty table gives no rows; repeated rows repeat
their result; other columns are ignored; texts are scanned whole, in time that grows with their length.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import FOLDED, docs_of, map_slices, table, texts

# Base phrases and their labels.
BASE = {b"gnu general public license": "gpl", b"apache license": "apache", b"cc by": "cc-by", b"mit license": "mit"}

# The rules, by hand: name, label, gate (the text must hold one of these words), priority, certainty, and the pattern over the word form.
RULES = (
    ("gpl-1", "gpl", "general", 60, 0.9, r"gnu general public licen[sc]e (?:version |v ?)?1(?: 0)?"),
    ("gpl-2", "gpl", "general", 60, 0.95, r"gnu general public licen[sc]e (?:version |v ?)?2(?: 0)?"),
    ("gpl-2-later", "gpl", "general", 65, 0.97, r"gnu general public licen[sc]e (?:version |v ?)?2(?: 0)? or (?:at your option )?any later version"),
    ("gpl-3", "gpl", "general", 60, 0.95, r"gnu general public licen[sc]e (?:version |v ?)?3(?: 0)?"),
    ("gpl-3-later", "gpl", "general", 65, 0.97, r"gnu general public licen[sc]e (?:version |v ?)?3(?: 0)? or (?:at your option )?any later version"),
    ("gpl-name", "gpl", "general", 40, 0.8, r"(?:the )?gnu general public licen[sc]e"),
    ("gnu-pl", "gpl", "gnu", 38, 0.7, r"gnu public licen[sc]e"),
    ("gnu-gpl", "gpl", "gpl", 42, 0.8, r"gnu gpl(?: (?:version |v ?)?[123](?: 0)?)?"),
    ("gplv", "gpl", "gplv1 gplv2 gplv3", 45, 0.85, r"(?:gnu )?gplv[123](?: 0)?(?: or later| only)?"),
    ("gpl-num", "gpl", "gpl", 44, 0.8, r"gpl (?:version |v)? ?[123](?: 0)?(?: only| or later)?"),
    ("gpl-plus", "gpl", "gpl2 gpl3", 44, 0.8, r"gpl[23](?: 0)?"),
    ("gpl-compatible", "gpl", "gpl", 30, 0.5, r"gpl compatible(?: licen[sc]e)?"),
    ("gpl-free-software", "gpl", "redistribute", 75, 0.92, r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e"),
    ("gpl-library-free", "gpl", "redistribute", 72, 0.9, r"(?:it|this (?:file|package|library|software)) is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e"),
    ("gpl-published", "gpl", "published", 58, 0.85, r"gnu general public licen[sc]e as published by the free software foundation"),
    ("gpl-see", "gpl", "details", 56, 0.8, r"see the gnu general public licen[sc]e for more details"),
    ("gpl-copy", "gpl", "received", 56, 0.8, r"you should have received a copy of the gnu general public licen[sc]e"),
    ("gpl-notices", "gpl", "notices", 50, 0.8, r"gnu general public licen[sc]e notices?"),
    ("gpl-web", "gpl", "gpl", 50, 0.85, r"www gnu org (?:copyleft|licenses) gpl(?: html| txt)?"),
    ("gpl-classpath", "gpl-classpath", "classpath", 62, 0.9, r"(?:gpl|general public licen[sc]e)(?: (?:version |v)?2)? with (?:the )?(?:gnu )?classpath exception"),
    ("gpl-linking", "gpl-exception", "exception", 62, 0.85, r"as a special exception the copyright holders? (?:of this (?:library|program) )?give you permission to link"),
    ("gpl-autoconf", "gpl-exception", "autoconf", 62, 0.85, r"as a special exception (?:to the gnu general public licen[sc]e )?if you distribute this file as part of a program that contains a configuration script generated by autoconf"),
    ("gpl-runtime", "gpl-exception", "runtime", 60, 0.85, r"gcc runtime library exception(?: version 3 1)?"),
    ("gpl-preamble", "gpl", "copyleft", 70, 0.9, r"the gnu general public licen[sc]e is a free copyleft licen[sc]e for software"),
    ("gpl-preamble-2", "gpl", "intended", 70, 0.9, r"the gnu general public licen[sc]e is intended to guarantee your freedom to share and change"),
    ("spdx-gpl", "gpl", "spdx", 90, 0.99, r"spdx licen[sc]e identifier gpl [123] 0(?: only| or later)?"),
    ("lgpl-2", "lgpl", "library", 60, 0.95, r"gnu library general public licen[sc]e(?: (?:version |v ?)?2(?: 0)?)?"),
    ("lgpl-21", "lgpl", "lesser", 62, 0.95, r"gnu lesser general public licen[sc]e (?:version |v ?)?2 1"),
    ("lgpl-3", "lgpl", "lesser", 60, 0.95, r"gnu lesser general public licen[sc]e (?:version |v ?)?3(?: 0)?"),
    ("lgpl-name", "lgpl", "lesser", 45, 0.85, r"(?:the )?gnu lesser general public licen[sc]e"),
    ("lgpl-lesser-gpl", "lgpl", "lesser", 43, 0.8, r"lesser gpl"),
    ("lgplv", "lgpl", "lgplv2 lgplv3", 46, 0.85, r"(?:gnu )?lgplv[23](?: 1)?(?: or later| only)?"),
    ("lgpl-num", "lgpl", "lgpl", 46, 0.85, r"(?:gnu )?lgpl (?:version |v)? ?[23](?: [01])?(?: only| or later)?"),
    ("lgpl-short", "lgpl", "lgpl", 40, 0.7, r"lgpl"),
    ("lgpl-free-software", "lgpl", "redistribute", 76, 0.92, r"you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[sc]e"),
    ("lgpl-see", "lgpl", "details", 57, 0.8, r"see the gnu (?:lesser|library) general public licen[sc]e for more details"),
    ("lgpl-web", "lgpl", "lgpl", 50, 0.85, r"www gnu org (?:copyleft|licenses) lgpl(?: html)?"),
    ("spdx-lgpl", "lgpl", "spdx", 90, 0.99, r"spdx licen[sc]e identifier lgpl [23] [01](?: only| or later)?"),
    ("agpl-3", "agpl", "affero", 62, 0.95, r"(?:gnu )?affero general public licen[sc]e (?:version |v ?)?3(?: 0)?"),
    ("agpl-1", "agpl", "affero", 62, 0.92, r"affero general public licen[sc]e (?:version |v ?)?1(?: 0)?"),
    ("agpl-name", "agpl", "affero", 45, 0.88, r"(?:the )?(?:gnu )?affero general public licen[sc]e"),
    ("agpl-gpl", "agpl", "affero", 43, 0.85, r"affero gpl"),
    ("agplv", "agpl", "agplv3 agpl3", 46, 0.88, r"(?:gnu )?agplv?3"),
    ("agpl-num", "agpl", "agpl", 46, 0.88, r"agpl (?:v)? ?3(?: 0)?(?: only| or later)?"),
    ("agpl-short", "agpl", "agpl", 40, 0.75, r"agpl"),
    ("agpl-network", "agpl", "interaction", 70, 0.9, r"remote network interaction use with the gnu general public licen[sc]e"),
    ("spdx-agpl", "agpl", "spdx", 90, 0.99, r"spdx licen[sc]e identifier agpl [13] 0(?: only| or later)?"),
    ("gfdl-name", "gfdl", "documentation", 45, 0.88, r"gnu free documentation licen[sc]e(?: (?:version |v ?)?1(?: [0-3])?)?"),
    ("gfdl-short", "gfdl", "gfdl", 40, 0.8, r"gfdl(?: 1 [0-3])?"),
    ("gfdl-permission", "gfdl", "invariant", 72, 0.9, r"with no invariant sections no front cover texts and no back cover texts"),
    ("spdx-gfdl", "gfdl", "spdx", 90, 0.99, r"spdx licen[sc]e identifier gfdl 1 [0-3](?: only| or later)?"),
    ("apache-2", "apache", "apache", 60, 0.95, r"apache licen[sc]e (?:version |v ?)?2(?: 0)?"),
    ("apache-1", "apache", "apache", 60, 0.92, r"apache (?:software )?licen[sc]e (?:version |v ?)?1(?: [01])?"),
    ("apache-name", "apache", "apache", 40, 0.8, r"(?:the )?apache (?:software |public )?licen[sc]e"),
    ("apache-num", "apache", "apache", 44, 0.8, r"apache (?:v)? ?2(?: 0)?"),
    ("apachev2", "apache", "apachev2 apache2", 44, 0.8, r"apachev?2(?: 0)?"),
    ("al2", "apache", "asl", 42, 0.7, r"asl 2(?: 0)?"),
    ("apache-grant", "apache", "apache", 76, 0.95, r"licensed under the apache licen[sc]e(?: (?:version |v ?)?2 0)? the licen[sc]e"),
    ("apache-compliance", "apache", "compliance", 70, 0.85, r"you may not use this file except in compliance with the licen[sc]e"),
    ("apache-asf", "apache", "asf", 74, 0.9, r"licensed to the apache software foundation asf under one or more contributor licen[sc]e agreements"),
    ("apache-as-is", "apache", "conditions", 60, 0.7, r"distributed under the licen[sc]e is distributed on an as is basis without warranties or conditions of any kind"),
    ("apache-web", "apache", "apache", 52, 0.88, r"(?:www )?apache org licenses(?: licen[sc]e 2 0(?: html| txt)?)?"),
    ("apache-llvm", "apache", "llvm", 64, 0.92, r"apache licen[sc]e v2 0 with llvm exceptions?"),
    ("spdx-apache", "apache", "spdx", 90, 0.99, r"spdx licen[sc]e identifier apache [12] [01](?: with llvm exception)?"),
    ("mit-name", "mit", "mit", 40, 0.8, r"(?:the )?mit licen[sc]e"),
    ("mit-x11", "mit", "x11", 45, 0.85, r"(?:mit )?x11 licen[sc]e"),
    ("mit-expat", "mit", "expat", 45, 0.85, r"expat licen[sc]e"),
    ("mit-style", "mit", "mit", 42, 0.7, r"mit style(?: licen[sc]e)?"),
    ("mit-permission", "mit", "permission", 78, 0.96, r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit-permission-any", "mit", "permission", 74, 0.93, r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit-deal", "mit", "restriction", 72, 0.9, r"to deal in the (?:software|materials) without restriction"),
    ("mit-notice", "mit", "substantial", 70, 0.88, r"shall be included in all copies or substantial portions of the (?:software|materials)"),
    ("mit-web", "mit", "mit", 50, 0.88, r"opensource org licenses mit(?: licen[sc]e)?(?: php| html)?"),
    ("mit-lic-short", "mit", "mit", 41, 0.75, r"mit licensed"),
    ("mit-0", "mit-0", "attribution", 62, 0.9, r"mit no attribution(?: licen[sc]e)?"),
    ("mit-0-short", "mit-0", "mit", 46, 0.75, r"mit 0 licen[sc]e"),
    ("mit-cmu", "mit-cmu", "cmu", 55, 0.85, r"(?:mit )?cmu(?: style)? licen[sc]e"),
    ("spdx-mit", "mit", "spdx", 90, 0.99, r"spdx licen[sc]e identifier mit"),
    ("spdx-mit-0", "mit-0", "spdx", 91, 0.99, r"spdx licen[sc]e identifier mit 0"),
    ("bsd-0", "bsd-0", "bsd 0bsd", 60, 0.9, r"(?:0bsd|(?:bsd 0 clause|zero clause bsd)(?: licen[sc]e)?)"),
    ("bsd-1", "bsd-1", "bsd", 58, 0.9, r"bsd 1 clause(?: licen[sc]e)?"),
    ("bsd-2", "bsd-2", "bsd", 60, 0.92, r"(?:bsd 2 clause|2 clause bsd|two clause bsd)(?: licen[sc]e)?"),
    ("bsd-3", "bsd-3", "bsd", 60, 0.92, r"(?:bsd 3 clause|3 clause bsd|three clause bsd)(?: licen[sc]e)?"),
    ("bsd-4", "bsd-4", "bsd", 60, 0.92, r"(?:bsd 4 clause|4 clause bsd|four clause bsd)(?: licen[sc]e)?"),
    ("bsd-new", "bsd-3", "bsd", 58, 0.9, r"(?:new|modified|revised) bsd licen[sc]e"),
    ("bsd-simplified", "bsd-2", "bsd", 58, 0.9, r"(?:simplified|freebsd) bsd licen[sc]e"),
    ("bsd-original", "bsd-4", "bsd", 58, 0.88, r"(?:original|old) bsd licen[sc]e"),
    ("bsd-name", "bsd", "bsd", 40, 0.8, r"(?:the )?bsd licen[sc]e"),
    ("bsd-style", "bsd", "bsd", 42, 0.7, r"bsd (?:style|like) licen[sc]e"),
    ("bsd-patent", "bsd-patent", "patent", 60, 0.88, r"bsd(?: 2 clause)? plus patent(?: licen[sc]e)?"),
    ("bsd-freebsd", "bsd-2", "freebsd", 46, 0.85, r"freebsd licen[sc]e"),
    ("bsd-netbsd", "bsd-2", "netbsd", 46, 0.8, r"netbsd licen[sc]e"),
    ("bsd-redistribution", "bsd", "redistribution", 76, 0.95, r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-retain", "bsd", "redistributions", 70, 0.9, r"redistributions of source code must retain the above copyright notice"),
    ("bsd-reproduce", "bsd", "redistributions", 70, 0.9, r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-endorse", "bsd-3", "endorse", 72, 0.92, r"may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-advertising", "bsd-4", "advertising", 74, 0.92, r"all advertising materials mentioning features or use of this software must display the following acknowledg?e?ment"),
    ("bsd-as-is", "bsd", "provided", 55, 0.7, r"this software is provided by the (?:copyright holders?|author|regents)(?: and contributors)? as is"),
    ("bsd-web", "bsd", "bsd", 50, 0.85, r"opensource org licenses bsd(?: licen[sc]e| [23] clause)(?: php)?"),
    ("spdx-bsd", "bsd", "spdx", 90, 0.99, r"spdx licen[sc]e identifier (?:0bsd|bsd [1-4] clause)"),
    ("isc-name", "isc", "isc", 45, 0.88, r"(?:the )?isc licen[sc]e"),
    ("isc-permission", "isc", "permission", 78, 0.96, r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("openbsd", "isc", "openbsd", 44, 0.8, r"openbsd licen[sc]e"),
    ("spdx-isc", "isc", "spdx", 90, 0.99, r"spdx licen[sc]e identifier isc"),
    ("mpl-20", "mpl", "mozilla", 62, 0.95, r"mozilla public licen[sc]e (?:version |v ?)?2(?: 0)?"),
    ("mpl-11", "mpl", "mozilla", 62, 0.95, r"mozilla public licen[sc]e (?:version |v ?)?1(?: [01])?"),
    ("mpl-name", "mpl", "mozilla", 45, 0.88, r"mozilla public licen[sc]e"),
    ("mpl-num", "mpl", "mpl", 46, 0.85, r"mpl (?:version |v)? ?[12](?: [01])?"),
    ("mplv", "mpl", "mplv2 mpl2", 46, 0.85, r"mplv?2(?: 0)?"),
    ("mpl-source", "mpl", "mozilla", 74, 0.94, r"this source code form is subject to the terms of the mozilla public licen[sc]e"),
    ("mpl-incompatible", "mpl", "incompatible", 60, 0.85, r"incompatible with secondary licenses as defined by the mozilla public licen[sc]e"),
    ("mpl-web", "mpl", "mpl", 52, 0.88, r"mozilla org mpl(?: [12] [01])?"),
    ("spdx-mpl", "mpl", "spdx", 90, 0.99, r"spdx licen[sc]e identifier mpl [12] [01](?: no copyleft exception)?"),
    ("epl-name", "epl", "eclipse", 45, 0.88, r"eclipse public licen[sc]e(?: (?:version |v ?)?[12](?: 0)?)?"),
    ("epl-num", "epl", "epl", 46, 0.82, r"epl (?:version |v)? ?[12](?: 0)?"),
    ("eplv", "epl", "eplv1 eplv2", 46, 0.82, r"eplv[12](?: 0)?"),
    ("epl-web", "epl", "epl", 52, 0.88, r"eclipse org legal epl(?: v)?(?: ?[12]0)?"),
    ("edl", "edl", "eclipse", 46, 0.88, r"eclipse distribution licen[sc]e(?: (?:version |v ?)?1(?: 0)?)?"),
    ("spdx-epl", "epl", "spdx", 90, 0.99, r"spdx licen[sc]e identifier epl [12] 0"),
    ("cddl-name", "cddl", "distribution", 50, 0.9, r"common development and distribution licen[sc]e(?: (?:version |v ?)?1(?: [01])?)?"),
    ("cddl-num", "cddl", "cddl", 46, 0.85, r"cddl(?: (?:version |v)? ?1(?: [01])?)?"),
    ("spdx-cddl", "cddl", "spdx", 90, 0.99, r"spdx licen[sc]e identifier cddl 1 [01]"),
    ("cpl-name", "cpl", "common", 46, 0.85, r"common public licen[sc]e(?: (?:version |v ?)?[01](?: [05])?)?"),
    ("ipl-name", "ipl", "ibm", 46, 0.85, r"ibm public licen[sc]e(?: (?:version |v ?)?1 0)?"),
    ("cpal", "cpal", "attribution", 50, 0.88, r"common public attribution licen[sc]e(?: (?:version |v ?)?1 0)?"),
    ("cc-by-base", "cc-by", "cc", 64, 0.85, r"cc by"),
    ("cc-by-num", "cc-by", "cc", 65, 0.9, r"cc by [1-4] [05]"),
    ("cc-by-sa", "cc-by-sa", "sa", 66, 0.92, r"cc by sa(?: [1-4] [05])?"),
    ("cc-by-nc", "cc-by-nc", "nc", 66, 0.92, r"cc by nc(?: [1-4] [05])?"),
    ("cc-by-nd", "cc-by-nd", "nd", 66, 0.92, r"cc by nd(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "cc-by-nc-sa", "nc", 67, 0.93, r"cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "cc-by-nc-nd", "nc", 67, 0.93, r"cc by nc nd(?: [1-4] [05])?"),
    ("cc-att", "cc-by", "attribution", 64, 0.9, r"creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)?(?: (?:public )?licen[sc]e)?"),
    ("cc-att-sa", "cc-by-sa", "attribution", 66, 0.93, r"creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: (?:public )?licen[sc]e)?"),
    ("cc-att-nc", "cc-by-nc", "attribution", 66, 0.93, r"creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported| generic)?(?: (?:public )?licen[sc]e)?"),
    ("cc-att-nd", "cc-by-nd", "attribution", 66, 0.93, r"creative commons attribution no ?deriv(?:ative)?s?(?: [1-4] [05])?(?: international| unported| generic)?(?: (?:public )?licen[sc]e)?"),
    ("cc-att-nc-sa", "cc-by-nc-sa", "attribution", 68, 0.94, r"creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: (?:public )?licen[sc]e)?"),
    ("cc-att-nc-nd", "cc-by-nc-nd", "attribution", 68, 0.94, r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: [1-4] [05])?(?: international| unported| generic)?(?: (?:public )?licen[sc]e)?"),
    ("cc-web-by", "cc-by", "creativecommons", 60, 0.9, r"creativecommons org licenses by(?: [1-4] [05])?"),
    ("cc-web-by-sa", "cc-by-sa", "creativecommons", 62, 0.92, r"creativecommons org licenses by sa(?: [1-4] [05])?"),
    ("cc-web-by-nc", "cc-by-nc", "creativecommons", 62, 0.92, r"creativecommons org licenses by nc(?: [1-4] [05])?"),
    ("cc-web-by-nd", "cc-by-nd", "creativecommons", 62, 0.92, r"creativecommons org licenses by nd(?: [1-4] [05])?"),
    ("cc-web-by-nc-sa", "cc-by-nc-sa", "creativecommons", 63, 0.93, r"creativecommons org licenses by nc sa(?: [1-4] [05])?"),
    ("cc-web-by-nc-nd", "cc-by-nc-nd", "creativecommons", 63, 0.93, r"creativecommons org licenses by nc nd(?: [1-4] [05])?"),
    ("cc-work", "cc", "creative", 45, 0.75, r"this work is licensed under (?:a|the) creative commons"),
    ("cc-licence", "cc", "creative", 40, 0.7, r"creative commons (?:public )?licen[sc]e"),
    ("cc0-name", "cc0", "cc0", 50, 0.88, r"(?:creative commons )?cc0(?: 1 0)?(?: universal)?"),
    ("cc0-zero", "cc0", "zero", 52, 0.88, r"creative commons zero(?: (?:v ?)?1 0)?"),
    ("cc0-web", "cc0", "creativecommons", 60, 0.92, r"creativecommons org publicdomain zero(?: 1 0)?"),
    ("cc-pdm", "public-domain", "mark", 52, 0.85, r"public domain mark(?: 1 0)?"),
    ("spdx-cc0", "cc0", "spdx", 90, 0.99, r"spdx licen[sc]e identifier cc0 1 0"),
    ("spdx-cc-by", "cc-by", "spdx", 90, 0.99, r"spdx licen[sc]e identifier cc by [1-4] [05]"),
    ("spdx-cc-by-sa", "cc-by-sa", "spdx", 91, 0.99, r"spdx licen[sc]e identifier cc by sa [1-4] [05]"),
    ("artistic-2", "artistic", "artistic", 60, 0.9, r"artistic licen[sc]e (?:version |v ?)?2(?: 0)?"),
    ("artistic-name", "artistic", "artistic", 45, 0.85, r"(?:perl |clarified )?artistic licen[sc]e"),
    ("perl-same", "artistic", "perl", 55, 0.8, r"(?:under the )?same terms as perl(?: itself)?"),
    ("afl-name", "afl", "academic", 48, 0.88, r"academic free licen[sc]e(?: (?:version |v ?)?[123](?: [012])?)?"),
    ("apsl-name", "apsl", "apple", 48, 0.88, r"apple public source licen[sc]e(?: (?:version |v ?)?[12](?: [012])?)?"),
    ("beerware", "beerware", "beer beerware", 48, 0.85, r"(?:the )?beer ?ware licen[sc]e"),
    ("bsl-10", "bsl", "boost", 50, 0.9, r"boost software licen[sc]e(?: (?:version |v ?)?1(?: 0)?)?"),
    ("bsl-web", "bsl", "boost", 52, 0.88, r"www boost org licen[sc]e 1 0(?: txt)?"),
    ("spdx-bsl", "bsl", "spdx", 90, 0.99, r"spdx licen[sc]e identifier bsl 1 0"),
    ("busl-name", "busl", "business", 50, 0.9, r"business source licen[sc]e(?: (?:version |v ?)?1 1)?"),
    ("busl-short", "busl", "busl", 46, 0.85, r"busl(?: 1 1)?"),
    ("bzip2", "bzip2", "bzip2", 46, 0.85, r"bzip2(?: libbzip2)? licen[sc]e"),
    ("cecill-name", "cecill", "cecill", 46, 0.88, r"cecill(?: [abc])?(?: (?:version |v ?)?[12](?: [01])?)?(?: free software)? licen[sc]e"),
    ("cecill-fr", "cecill", "cecill", 46, 0.85, r"licence cecill(?: [abc])?"),
    ("curl", "curl", "curl", 46, 0.8, r"curl licen[sc]e"),
    ("ecl-name", "ecl", "educational", 50, 0.9, r"educational community licen[sc]e(?: (?:version |v ?)?[12](?: 0)?)?"),
    ("efl-name", "efl", "eiffel", 50, 0.9, r"eiffel forum licen[sc]e(?: (?:version |v ?)?[12])?"),
    ("elastic-2", "elastic", "elastic", 50, 0.88, r"elastic licen[sc]e(?: (?:version |v ?)?2(?: 0)?)?"),
    ("eupl-name", "eupl", "european", 50, 0.9, r"european union public licen[sc]e(?: (?:version |v ?)?1(?: [012])?)?"),
    ("eupl-short", "eupl", "eupl", 46, 0.85, r"eupl(?: (?:v ?)?1 [012])?"),
    ("fair", "fair", "fair", 40, 0.6, r"fair licen[sc]e"),
    ("ftl", "ftl", "freetype", 48, 0.88, r"freetype (?:project )?licen[sc]e"),
    ("hpnd", "hpnd", "historical", 50, 0.88, r"historical permission notice and disclaimer"),
    ("icu", "icu", "icu", 46, 0.85, r"icu licen[sc]e"),
    ("ijg", "ijg", "jpeg", 52, 0.85, r"based in part on the work of the independent jpeg group"),
    ("imagemagick", "imagemagick", "imagemagick", 46, 0.85, r"imagemagick licen[sc]e"),
    ("json-good", "json", "evil", 70, 0.92, r"the software shall be used for good not evil"),
    ("json-name", "json", "json", 44, 0.75, r"json licen[sc]e"),
    ("libpng", "libpng", "libpng", 46, 0.85, r"(?:the )?(?:libpng|png reference library) licen[sc]e"),
    ("libtiff", "libtiff", "libtiff", 46, 0.85, r"libtiff licen[sc]e"),
    ("lppl-name", "lppl", "latex", 50, 0.9, r"latex project public licen[sc]e(?: (?:version |v ?)?1(?: [0-3][abc]?)?)?"),
    ("lppl-short", "lppl", "lppl", 46, 0.85, r"lppl(?: (?:version |v)? ?1(?: [0-3][abc]?)?)?"),
    ("ms-pl", "ms-pl", "microsoft", 50, 0.9, r"microsoft public licen[sc]e"),
    ("ms-pl-short", "ms-pl", "ms", 46, 0.8, r"ms pl"),
    ("ms-rl", "ms-rl", "microsoft", 50, 0.9, r"microsoft reciprocal licen[sc]e"),
    ("mulan", "mulan", "mulan", 48, 0.88, r"mulan (?:psl|permissive software licen[sc]e)(?: ?v ?[12])?"),
    ("ncsa", "ncsa", "ncsa", 50, 0.88, r"(?:university of illinois )?ncsa open source licen[sc]e"),
    ("npl", "npl", "netscape", 48, 0.88, r"netscape public licen[sc]e(?: (?:version |v ?)?1(?: [01])?)?"),
    ("odbl-name", "odbl", "database", 52, 0.9, r"open (?:data commons open )?database licen[sc]e(?: (?:v ?)?1(?: 0)?)?"),
    ("odbl-short", "odbl", "odbl", 46, 0.85, r"odbl(?: (?:v ?)?1(?: 0)?)?"),
    ("odc-by", "odc-by", "commons", 52, 0.9, r"open data commons attribution licen[sc]e(?: (?:v ?)?1 0)?"),
    ("pddl", "pddl", "dedication", 54, 0.9, r"(?:open data commons )?public domain dedication and licen[sc]e"),
    ("ogl-uk", "ogl", "government", 52, 0.88, r"open government licen[sc]e(?: (?:version |v ?)?[123](?: 0)?)?"),
    ("ofl-name", "ofl", "font", 50, 0.9, r"(?:sil )?open font licen[sc]e(?: (?:version |v ?)?1(?: [01])?)?"),
    ("ofl-short", "ofl", "ofl", 46, 0.82, r"(?:sil )?ofl(?: (?:v ?)?1 [01])?"),
    ("ofl-reserved", "ofl", "font", 56, 0.8, r"with reserved font names?"),
    ("openssl", "openssl", "openssl", 48, 0.88, r"openssl(?: and original ssleay)? licen[sc]e"),
    ("openssl-toolkit", "openssl", "openssl", 70, 0.92, r"this product includes software developed by the openssl project"),
    ("ssleay", "openssl", "ssleay", 46, 0.85, r"(?:original )?ssleay licen[sc]e"),
    ("oldap", "oldap", "openldap", 48, 0.88, r"openldap public licen[sc]e(?: (?:version |v ?)?[12](?: [0-9])?)?"),
    ("osl-name", "osl", "open", 48, 0.85, r"open software licen[sc]e(?: (?:version |v ?)?[123](?: [01])?)?"),
    ("php-name", "php", "php", 48, 0.85, r"php licen[sc]e(?: (?:version |v ?)?[23](?: 01?)?)?"),
    ("postgresql", "postgresql", "postgresql", 48, 0.88, r"postgresql licen[sc]e"),
    ("psf-name", "psf", "python", 48, 0.88, r"python software foundation licen[sc]e(?: (?:version |v ?)?2)?"),
    ("python-name", "psf", "python", 44, 0.75, r"python licen[sc]e(?: 2 0)?"),
    ("qpl-name", "qpl", "q", 48, 0.85, r"q public licen[sc]e(?: (?:version |v ?)?1 0)?"),
    ("ruby-name", "ruby", "ruby", 44, 0.75, r"ruby licen[sc]e"),
    ("rpl", "rpl", "reciprocal", 50, 0.88, r"reciprocal public licen[sc]e(?: 1 [15])?"),
    ("sissl", "sissl", "sun", 52, 0.88, r"sun industry standards source licen[sc]e"),
    ("sleepycat", "sleepycat", "sleepycat", 48, 0.88, r"sleepycat licen[sc]e"),
    ("sspl-name", "sspl", "server", 52, 0.9, r"server side public licen[sc]e(?: (?:version |v ?)?1)?"),
    ("sspl-short", "sspl", "sspl", 46, 0.85, r"sspl(?: (?:v ?)?1(?: 0)?)?"),
    ("tcl", "tcl", "tcl", 46, 0.8, r"tcl(?: tk)? licen[sc]e"),
    ("unicode", "unicode", "unicode", 48, 0.85, r"unicode (?:terms of use|(?:data files and software )?licen[sc]e)(?: v3)?"),
    ("unlicense-name", "unlicense", "unlicense", 46, 0.85, r"(?:the )?unlicense"),
    ("unlicense-text", "unlicense", "unencumbered", 78, 0.95, r"this is free and unencumbered software released into the public domain"),
    ("unlicense-web", "unlicense", "unlicense", 52, 0.88, r"unlicense org"),
    ("upl-name", "upl", "universal", 50, 0.9, r"universal permissive licen[sc]e(?: (?:version |v ?)?1(?: 0)?)?"),
    ("vim", "vim", "vim", 46, 0.8, r"vim licen[sc]e"),
    ("w3c", "w3c", "w3c", 48, 0.85, r"w3c (?:software )?(?:notice and )?(?:document )?licen[sc]e"),
    ("watcom", "watcom", "watcom", 50, 0.88, r"(?:sybase )?open watcom public licen[sc]e(?: 1 0)?"),
    ("wtfpl-name", "wtfpl", "wtfpl", 46, 0.88, r"wtfpl(?: (?:version |v)? ?2)?"),
    ("wtfpl-text", "wtfpl", "want", 70, 0.92, r"do what the f[a-z]* you want to public licen[sc]e"),
    ("xnet", "xnet", "x", 44, 0.75, r"x net licen[sc]e"),
    ("zlib-name", "zlib", "zlib", 48, 0.88, r"(?:the )?zlib(?: libpng)? licen[sc]e"),
    ("zlib-text", "zlib", "misrepresented", 74, 0.93, r"the origin of this software must not be misrepresented"),
    ("zlib-altered", "zlib", "altered", 72, 0.9, r"altered source versions must be plainly marked as such"),
    ("spdx-zlib", "zlib", "spdx", 90, 0.99, r"spdx licen[sc]e identifier zlib"),
    ("zpl-name", "zpl", "zope", 50, 0.88, r"zope public licen[sc]e(?: (?:version |v ?)?[12](?: [01])?)?"),
    ("public-domain-released", "public-domain", "domain", 48, 0.75, r"(?:dedicated|released|placed|put)(?: in)?(?: ?to)? the public domain"),
    ("public-domain-hereby", "public-domain", "domain", 52, 0.8, r"(?:is|are) (?:hereby )?in the public domain"),
    ("public-domain-law", "public-domain", "domain", 55, 0.8, r"work of the united states government and is (?:therefore )?in the public domain"),
    ("proprietary-confidential", "proprietary", "proprietary", 55, 0.8, r"(?:confidential and proprietary|proprietary and confidential)"),
    ("proprietary-prohibited", "proprietary", "prohibited", 56, 0.8, r"unauthori[sz]ed copying of this file via any medium is strictly prohibited"),
    ("proprietary-eula", "proprietary", "eula", 45, 0.65, r"(?:end user licen[sc]e agreement )?eula"),
    ("proprietary-eula-long", "proprietary", "agreement", 44, 0.65, r"end user licen[sc]e agreement"),
    ("proprietary-trade", "proprietary", "secrets", 52, 0.75, r"contains (?:valuable )?trade secrets"),
    ("proprietary-internal", "proprietary", "internal", 45, 0.6, r"for internal use only"),
    ("proprietary-rights", "proprietary", "reserved", 20, 0.4, r"all rights reserved"),
)


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    gate: tuple[str, ...]
    priority: int
    certainty: float
    pattern: str


def rules() -> list[Rule]:
    """The rules in order."""
    return [Rule(name, label, tuple(gate.split()), priority, certainty, pattern) for name, label, gate, priority, certainty, pattern in RULES]


@cache
def _compiled() -> list[tuple[Rule, re.Pattern]]:
    return [(rule, re.compile(rf" (?:{rule.pattern})(?= )".encode())) for rule in rules()]


@cache
def _gate():
    import ahocorasick

    opened: dict[str, list[int]] = {}
    for i, rule in enumerate(rules()):
        for word in rule.gate:
            opened.setdefault(word, []).append(i)
    auto = ahocorasick.Automaton()
    for word, own in opened.items():
        auto.add_word(f" {word} ", own)
    for phrase in BASE:
        auto.add_word(f" {phrase.decode()} ", phrase)
    auto.make_automaton()
    return auto


def resolve(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """What stays of detections (start, end, priority, rule)."""
    widest, reach = [], -1
    for hit in sorted(found, key=lambda x: (x[0], -x[1], -x[2], x[3])):
        if hit[1] > reach:  # starts are in order, so whatever doesn't reach further lies inside
            widest.append(hit)
            reach = hit[1]
    kept: list[tuple[int, int, int, int]] = []
    for hit in widest:
        while kept and kept[-1][1] > hit[0] and kept[-1][2] < hit[2]:
            kept.pop()
        if not kept or kept[-1][1] <= hit[0]:
            kept.append(hit)
    return kept


def scan(text: bytes) -> dict:
    """Words, base places and kept detections (start word, end word, rule) of one text."""
    words = text.translate(FOLDED).split()
    joined = b" " + b" ".join(words) + b" " if words else b""
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x20)
    base, opened = [], set()
    # the gate's own texts are ASCII, so any one-byte decoding finds them at the byte positions
    for end, what in _gate().iter(joined.decode("latin-1")):
        if isinstance(what, bytes):
            base.append((end - len(what) - 1, BASE[what]))
        else:
            opened.update(what)
    found = []
    for i in sorted(opened):
        rule, pattern = _compiled()[i]
        found += [(m.start(), m.end(), rule.priority, i) for m in pattern.finditer(joined)]
    kept = resolve(found)
    at = np.searchsorted(spaces, [x[0] for x in base] + [x[0] for x in kept] + [x[1] for x in kept]).tolist()
    n, m = len(base), len(kept)
    return {
        "n_words": len(words),
        "base": [(w, label) for w, (_, label) in zip(at[:n], base, strict=True)],
        "kept": [(a, b, _compiled()[hit[3]][0]) for a, b, hit in zip(at[n : n + m], at[n + m :], kept, strict=True)],
    }


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base places and detections for every row of docs (doc_id, text)."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        got = [scan(t) for t in texts(part.column("text"))]
        out = {
            "doc_id": part.column("doc_id"),
            "n_words": [g["n_words"] for g in got],
            "n_base": [len(g["base"]) for g in got],
            "first_word": [min((w for w, _ in g["base"]), default=None) for g in got],
            "last_word": [max((w for w, _ in g["base"]), default=None) for g in got],
            "base_labels": [",".join(sorted({x for _, x in g["base"]})) for g in got],
            "labels": [",".join(sorted({x for _, x in g["base"]} | {r.label for _, _, r in g["kept"]})) for g in got],
            "score": [max([r.certainty for _, _, r in g["kept"]] + [0.7] * bool(g["base"]), default=0.0) for g in got],
            "detections": [[{"start_word": a, "end_word": b, "rule": r.name} for a, b, r in g["kept"]] for g in got],
        }
        return pa.record_batch(out, schema=pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("detections", pa.list_(pa.struct([("start_word", pa.int64()), ("end_word", pa.int64()), ("rule", pa.string())])))]))

    return map_slices(docs, run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<start_word:long,end_word:long,rule:string>>")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(docs_of(table(spark, sf_dir, "documents"))).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
