"""License detection: ordered regex rules behind a keyword gate; DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, pick

#: What separates words; all else is of words (after lower-casing: digits, a-z and all beyond ASCII).
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same for texts with capitals, character by character: Java looks such lists up in a table, but tries ranges one by one.
ANY_CASE_BETWEEN = "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum())
#: A word and all that separates it from its neighbours; possessive, since the classes are disjoint.
ONE_WORD = f"[{ANY_CASE_BETWEEN}]*+[^{ANY_CASE_BETWEEN}]++[{ANY_CASE_BETWEEN}]*+"
#: The phrases of the base count and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Signatures, in order, written for what each license's texts, headers and notices say: label, tier (1 is first), confidence,
#: keyword (any match holds it), regex over single-spaced words.
SIGNATURES = [
    # MIT and its kin
    ("mit", 1, 1.0, "hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this (?:software and associated documentation files|software)(?: the software)?(?: to deal in the software without restriction)?"),
    ("mit", 1, 0.99, "substantial portions of the software", "the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software"),
    ("mit", 1, 1.0, "license identifier mit", "spdx license identifier mit(?: 0)?"),
    ("mit", 1, 0.99, "mit", "(?:dual |multi )?licen[sc]ed under (?:the )?(?:terms of )?(?:the )?mit(?: x11)? licen[sc]e"),
    ("mit", 1, 0.97, "mit licen", "(?:re)?(?:released|distributed|published|available|provided|covered|shipped) under (?:the )?(?:terms of )?(?:the )?mit licen[sc]e"),
    ("mit", 2, 0.85, "mit licen", "(?:see|read) (?:the )?(?:file )?(?:license )?(?:for )?(?:the )?mit licen[sc]e"),
    ("mit", 2, 0.8, "mit licen", "(?:subject to|governed by|terms of|copy of) the mit licen[sc]e"),
    ("mit", 3, 0.6, "mit licen", "mit licen[sc]e"),
    ("mit", 3, 0.6, "mit x11", "mit x11(?: licen[sc]e)?"),
    ("x11", 1, 0.95, "x consortium", "except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("isc", 1, 1.0, "with or without fee is hereby granted", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?: provided that the above copyright notice and this permission notice appear in all copies)?"),
    ("isc", 1, 0.98, "with or without fee is hereby granted", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", 1, 1.0, "license identifier isc", "spdx license identifier isc"),
    ("isc", 2, 0.9, "isc licen", "(?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?isc licen[sc]e"),
    ("isc", 3, 0.6, "isc licen", "isc licen[sc]e"),
    ("0bsd", 1, 1.0, "license identifier 0bsd", "spdx license identifier 0bsd"),
    ("0bsd", 2, 0.9, "zero clause bsd", "(?:bsd )?zero clause bsd(?: licen[sc]e)?"),
    # BSD
    ("bsd", 1, 1.0, "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted(?: provided that the following conditions are met)?"),
    ("bsd", 1, 0.97, "redistributions of source code must retain", "redistributions of source code must retain the above copyright notice(?: this list of conditions and the following disclaimer)?"),
    ("bsd", 1, 0.97, "redistributions in binary form must reproduce", "redistributions in binary form must reproduce the above copyright notice(?: this list of conditions and the following disclaimer in the documentation)?"),
    ("bsd", 1, 0.97, "endorse or promote products derived", "neither the names? of .{1,60}? (?:nor the names of its contributors )?may be used to endorse or promote products derived from this software"),
    ("bsd", 1, 0.97, "all advertising materials mentioning", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd", 1, 1.0, "license identifier bsd", "spdx license identifier bsd [1234] clause(?: patent| clear| modification)?"),
    ("bsd", 1, 0.98, "bsd style licen", "use of this source code is governed by a bsd style licen[sc]e(?: that can be found in the license file)?"),
    ("bsd", 1, 0.97, "bsd", "(?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of )?(?:the |a )?(?:(?:2|3|4|two|three|four|new|modified|simplified|revised|original) (?:clause )?)?bsd (?:style )?licen[sc]e"),
    ("bsd", 2, 0.85, "clause bsd", "(?:2|3|4|two|three|four) clause bsd(?: licen[sc]e)?"),
    ("bsd", 2, 0.85, "bsd", "(?:new|modified|simplified|revised|original) bsd licen[sc]e"),
    ("bsd", 3, 0.6, "bsd", "bsd (?:style )?licen[sc]e|bsd [234] clause"),
    # Apache
    ("apache", 1, 1.0, "licensed under the apache license", "licensed under the apache license version (?:2 0|1 1|1 0)(?: the license you may not use this file except in compliance with the license)?"),
    ("apache", 1, 1.0, "apache org licenses", "you may obtain a copy of the license at(?: https?)? (?:www )?apache org licenses license 2 0"),
    ("apache", 1, 0.99, "grant of copyright license", "grant of copyright license subject to the terms and conditions of this license each contributor hereby grants"),
    ("apache", 1, 0.99, "grant of patent license", "grant of patent license subject to the terms and conditions of this license each contributor hereby grants"),
    ("apache", 1, 1.0, "license identifier apache", "spdx license identifier apache (?:2 0|1 1|1 0)"),
    ("apache", 1, 0.97, "apache software foundation", "this product includes software developed (?:by|at) the apache software foundation"),
    ("apache", 1, 0.98, "apache", "(?:licen[sc]ed|released|distributed|published|available|provided) under (?:the )?(?:terms of )?(?:the )?apache(?: software)? licen[sc]e"),
    ("apache", 2, 0.9, "apache", "apache(?: software)? licen[sc]e (?:version |v)?[12](?: [01])?"),
    ("apache", 2, 0.85, "apache", "(?:see|read|copy of|subject to|terms of|governed by) the apache licen[sc]e"),
    ("apache", 3, 0.6, "apache", "apache(?: software)? licen[sc]e"),
    # GNU
    ("agpl", 1, 1.0, "license identifier agpl", "spdx license identifier agpl 3 0(?: only| or later)?"),
    ("agpl", 1, 1.0, "affero general public", "under the terms of the gnu affero general public licen[sc]e as published by the free software foundation"),
    ("agpl", 1, 0.98, "affero general public", "(?:licen[sc]ed|released|distributed) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?affero general public licen[sc]e"),
    ("agpl", 2, 0.9, "affero general public", "(?:gnu )?affero general public licen[sc]e (?:version |v)?3(?: 0)?(?: or (?:any )?later(?: version)?)?"),
    ("agpl", 2, 0.8, "gnu org licenses agpl", "gnu org licenses agpl(?: 3 0)?(?: html)?"),
    ("agpl", 3, 0.7, "affero", "(?:gnu )?affero general public licen[sc]e|gnu affero gpl"),
    ("lgpl", 1, 1.0, "license identifier lgpl", "spdx license identifier lgpl (?:2 0|2 1|3 0)(?: only| or later)?"),
    ("lgpl", 1, 1.0, "lesser general public", "under the terms of the gnu lesser general public licen[sc]e as published by the free software foundation"),
    ("lgpl", 1, 0.99, "lesser general public", "(?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?lesser general public licen[sc]e(?: version)?(?: [23](?: [01])?)?(?: or (?:any )?later(?: version)?)?"),
    ("lgpl", 1, 0.99, "library general public", "under the terms of the gnu library general public licen[sc]e"),
    ("lgpl", 2, 0.9, "lesser general public", "(?:gnu )?lesser general public licen[sc]e (?:version |v)[23](?: [01])?(?: or (?:any )?later(?: version)?)?"),
    ("lgpl", 2, 0.85, "lesser general public", "you should have received a copy of the gnu lesser general public licen[sc]e"),
    ("lgpl", 2, 0.8, "gnu org licenses", "gnu org licenses (?:old licenses )?lgpl(?: [23] [01])?(?: html)?"),
    ("lgpl", 3, 0.7, "lesser", "(?:gnu )?lesser general public licen[sc]e|gnu lesser gpl"),
    ("lgpl", 3, 0.7, "library general", "(?:gnu )?library general public licen[sc]e"),
    ("lgpl", 3, 0.7, "lgpl", "lgplv[23]|gnu lgpl|lgpl licen[sc]e"),
    ("gpl", 1, 1.0, "license identifier gpl", "spdx license identifier gpl [123] 0(?: only| or later)?(?: with [a-z]+(?: [a-z]+){0,3} exception(?: [23] [01])?)?"),
    ("gpl", 1, 1.0, "gnu general public", "under the terms of the gnu general public licen[sc]e as published by the free software foundation(?: either version [123] of the licen[sc]e or at your option any later version)?"),
    ("gpl", 1, 0.97, "general public", "(?:licen[sc]ed|released|distributed|published|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?general public licen[sc]e"),
    ("gpl", 1, 0.95, "program is free software", "this program is free software you can redistribute it and or modify it"),
    ("gpl", 1, 0.97, "freedom to share and change", "the gnu general public licen[sc]e is intended to guarantee your freedom to share and change"),
    ("gpl", 2, 0.9, "general public", "(?:gnu )?general public licen[sc]e (?:version |v)[123](?: 0)?(?: or (?:any )?later(?: version)?)?"),
    ("gpl", 2, 0.85, "general public", "you should have received a copy of the gnu general public licen[sc]e"),
    ("gpl", 2, 0.85, "general public", "(?:see|read|subject to|copy of) the (?:gnu )?general public licen[sc]e"),
    ("gpl", 2, 0.85, "gpl", "(?:released|licen[sc]ed|distributed) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl(?: (?:version |v)?[23])?"),
    ("gpl", 2, 0.8, "gnu org licenses gpl", "gnu org licenses gpl(?: [23] 0)?(?: html)?"),
    ("gpl", 2, 0.9, "gcc runtime library exception", "gcc runtime library exception"),
    ("gpl", 2, 0.9, "classpath exception", "(?:gnu )?classpath exception"),
    ("gpl", 3, 0.7, "general public", "(?:gnu )?general public licen[sc]e"),
    ("gpl", 3, 0.7, "gpl", "gnu gpl|gplv[23]|gpl (?:version )?[23](?: 0)?"),
    ("gfdl", 1, 0.98, "free documentation", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e"),
    ("gfdl", 1, 1.0, "license identifier gfdl", "spdx license identifier gfdl 1 [123](?: only| or later)?"),
    ("gfdl", 3, 0.7, "free documentation", "(?:gnu )?free documentation licen[sc]e"),
    # Mozilla, Eclipse, CDDL and other weak copyleft
    ("mpl", 1, 1.0, "mozilla public", "this source code form is subject to the terms of the mozilla public licen[sc]e v(?:ersion)? ?2 0"),
    ("mpl", 1, 0.99, "mozilla public", "the contents of this file are subject to the mozilla public licen[sc]e version 1 [01]"),
    ("mpl", 1, 1.0, "license identifier mpl", "spdx license identifier mpl [12] [01](?: no copyleft exception)?"),
    ("mpl", 2, 0.9, "mozilla org mpl", "mozilla org mpl 2 0"),
    ("mpl", 2, 0.9, "mozilla public", "mozilla public licen[sc]e (?:version |v)?[12](?: [01])?"),
    ("mpl", 3, 0.7, "mozilla public", "mozilla public licen[sc]e"),
    ("epl", 1, 1.0, "eclipse public", "this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e"),
    ("epl", 1, 1.0, "license identifier epl", "spdx license identifier epl [12] 0"),
    ("epl", 2, 0.9, "eclipse public", "eclipse public licen[sc]e (?:version |v)?[12](?: 0)?"),
    ("epl", 3, 0.7, "eclipse public", "eclipse public licen[sc]e"),
    ("edl", 2, 0.9, "eclipse distribution", "eclipse distribution licen[sc]e(?: (?:version |v)?1 0)?"),
    ("cpl", 2, 0.85, "common public", "common public licen[sc]e(?: (?:version |v)?[01] [05])?"),
    ("ibm pl", 2, 0.85, "ibm public", "ibm public licen[sc]e(?: (?:version |v)?1 0)?"),
    ("cddl", 1, 1.0, "common development and distribution", "the contents of this file are subject to the terms of the common development and distribution licen[sc]e"),
    ("cddl", 1, 1.0, "license identifier cddl", "spdx license identifier cddl 1 [01]"),
    ("cddl", 2, 0.85, "common development and distribution", "common development and distribution licen[sc]e(?: (?:version |v)?1 [01])?"),
    ("cddl", 3, 0.6, "cddl", "cddl(?: licen[sc]e)?(?: v?1 [01])?"),
    ("eupl", 1, 0.99, "under the eupl", "licen[sc]ed under the eupl(?: version)?(?: 1 [12])?"),
    ("eupl", 1, 0.99, "european union public", "licen[sc]ed under the european union public licen[sc]e"),
    ("eupl", 3, 0.7, "european union public", "european union public licen[sc]e"),
    ("cecill", 1, 0.98, "cecill", "this software is governed by the cecill(?: [bc])? licen[sc]e under french law"),
    ("cecill", 3, 0.6, "cecill", "cecill(?: [bc])?(?: licen[sc]e)?"),
    ("osl", 2, 0.85, "open software licen", "open software licen[sc]e(?: (?:version |v)?3 0)?"),
    ("afl", 2, 0.85, "academic free", "academic free licen[sc]e(?: (?:version |v)?[123] [01])?"),
    ("ms pl", 2, 0.9, "microsoft public", "microsoft public licen[sc]e"),
    ("ms rl", 2, 0.9, "microsoft reciprocal", "microsoft reciprocal licen[sc]e"),
    ("qpl", 2, 0.85, "q public", "q public licen[sc]e(?: (?:version |v)?1 0)?"),
    ("artistic", 1, 0.95, "package may be copied", "the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic", 1, 1.0, "license identifier artistic", "spdx license identifier artistic [12] 0"),
    ("artistic", 2, 0.85, "same terms as perl", "(?:redistribute it and or modify it |is )under the same terms as perl(?: itself)?"),
    ("artistic", 3, 0.6, "artistic licen", "(?:clarified |perl )?artistic licen[sc]e(?: 2 0)?"),
    # Short permissive ones
    ("zlib", 1, 1.0, "origin of this software must not be misrepresented", "the origin of this software must not be misrepresented(?: you must not claim that you wrote the original software)?"),
    ("zlib", 1, 0.95, "altered source versions must be", "altered source versions must be plainly marked as such"),
    ("zlib", 1, 1.0, "license identifier zlib", "spdx license identifier zlib"),
    ("zlib", 3, 0.7, "zlib", "zlib(?: libpng)? licen[sc]e"),
    ("libpng", 2, 0.85, "libpng", "libpng licen[sc]e(?: version 2)?"),
    ("boost", 1, 1.0, "boost software", "distributed under the boost software licen[sc]e version 1 0"),
    ("boost", 1, 1.0, "license identifier bsl", "spdx license identifier bsl 1 0"),
    ("boost", 2, 0.8, "boost org license", "boost org license 1 0(?: txt)?"),
    ("boost", 3, 0.7, "boost software", "boost software licen[sc]e"),
    ("unlicense", 1, 1.0, "unencumbered software released into", "this is free and unencumbered software released into the public domain"),
    ("unlicense", 1, 1.0, "license identifier unlicense", "spdx license identifier unlicense"),
    ("unlicense", 2, 0.7, "unlicense", "(?:the )?unlicense(?: org)?"),
    ("wtfpl", 1, 0.99, "this license document", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed"),
    ("wtfpl", 2, 0.8, "wtfpl", "wtfpl(?: (?:version |v)?2)?"),
    ("beerware", 2, 0.9, "beer", "the beer ?ware licen[sc]e(?: revision 42)?"),
    ("psf", 2, 0.85, "python software foundation", "python software foundation licen[sc]e(?: (?:version |v)?2)?"),
    ("psf", 3, 0.7, "psf licen", "psf licen[sc]e"),
    ("openssl", 1, 0.95, "openssl project", "this product includes software developed by the openssl project"),
    ("openssl", 3, 0.7, "openssl licen", "openssl licen[sc]e"),
    ("ssleay", 1, 0.95, "cryptographic software written by", "this product includes cryptographic software written by eric young"),
    ("php", 1, 0.95, "php software", "this product includes php software freely available from"),
    ("php", 2, 0.8, "php licen", "php licen[sc]e(?: (?:version |v)?3 0?1?)?"),
    ("zend", 2, 0.85, "zend", "zend (?:engine )?licen[sc]e(?: (?:version |v)?2 00)?"),
    ("ruby", 2, 0.8, "ruby", "(?:the )?ruby(?: s)? licen[sc]e"),
    ("tcl", 2, 0.8, "tcl", "tcl(?: tk)? licen[sc]e"),
    ("vim", 2, 0.8, "vim", "vim licen[sc]e"),
    ("curl", 2, 0.8, "curl", "curl licen[sc]e"),
    ("icu", 2, 0.85, "icu licen", "icu licen[sc]e"),
    ("unicode", 2, 0.85, "unicode licen", "unicode licen[sc]e(?: agreement)?(?: v3)?"),
    ("ijg", 1, 0.95, "independent jpeg group", "this software is based in part on the work of the independent jpeg group"),
    ("ftl", 2, 0.85, "freetype", "freetype (?:project )?licen[sc]e"),
    ("w3c", 2, 0.85, "w3c", "w3c software (?:and document )?(?:notice and )?licen[sc]e"),
    ("ncsa", 2, 0.85, "ncsa", "(?:university of illinois )?ncsa(?: open source)? licen[sc]e"),
    ("postgresql", 2, 0.85, "postgresql licen", "postgresql licen[sc]e"),
    ("hpnd", 1, 0.9, "permission to use copy modify and distribute this software and its documentation", "permission to use copy modify and distribute this software and its documentation for any purpose"),
    ("upl", 2, 0.85, "universal permissive", "universal permissive licen[sc]e(?: (?:version |v)?1 0)?"),
    ("mulan", 2, 0.85, "mulan", "mulan permissive software licen[sc]e(?: v2)?"),
    ("blueoak", 2, 0.85, "blue oak", "blue oak model licen[sc]e(?: 1 0 0)?"),
    # Creative Commons, data, fonts, documents
    ("cc by nc", 1, 0.98, "creative commons attribution noncommercial", "licen[sc]ed under (?:the |a )?creative commons attribution noncommercial(?: sharealike| noderiv[a-z]*)?(?: [1234] 0)?"),
    ("cc by nc", 2, 0.9, "cc by nc", "cc by nc(?: sa| nd)?(?: [1234] 0)?"),
    ("cc by nc", 2, 0.9, "noncommercial", "creative commons attribution noncommercial(?: sharealike| noderiv[a-z]*)?(?: [1234] 0)?"),
    ("cc by nc", 2, 0.9, "non commercial", "creative commons attribution non commercial(?: share alike| no deriv[a-z]*)?(?: [1234] 0)?"),
    ("cc by nc", 2, 0.85, "licenses by nc", "creativecommons org licenses by nc(?: sa| nd)?(?: [1234] 0)?"),
    ("cc by sa", 1, 0.98, "creative commons attribution share", "licen[sc]ed under (?:the |a )?creative commons attribution share ?alike(?: [1234] 0)?"),
    ("cc by sa", 2, 0.9, "cc by sa", "cc by sa(?: [1234] 0)?"),
    ("cc by sa", 2, 0.9, "attribution share", "creative commons attribution share ?alike(?: [1234] 0)?"),
    ("cc by sa", 2, 0.85, "licenses by sa", "creativecommons org licenses by sa(?: [1234] 0)?"),
    ("cc by nd", 2, 0.9, "cc by nd", "cc by nd(?: [1234] 0)?"),
    ("cc by nd", 2, 0.9, "attribution no", "creative commons attribution no ?deriv[a-z]*(?: [1234] 0)?"),
    ("cc by", 1, 0.95, "creative commons attribution", "licen[sc]ed under (?:the |a )?creative commons attribution(?: [1234] 0)?(?: international| unported| generic)?"),
    ("cc by", 3, 0.8, "cc by", "cc by(?: [1234] 0)?"),
    ("cc by", 3, 0.8, "creative commons attribution", "creative commons attribution(?: [1234] 0)?(?: international| unported| generic)?"),
    ("cc by", 3, 0.8, "licenses by", "creativecommons org licenses by(?: [1234] 0)?"),
    ("cc0", 1, 0.98, "cc0", "(?:dedicated to the public domain|no rights reserved|to the extent possible under law) (?:under|by|using) cc0|spdx license identifier cc0 1 0"),
    ("cc0", 2, 0.9, "cc0", "cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?"),
    ("cc0", 2, 0.9, "creative commons zero", "creative commons zero(?: v1 0)?"),
    ("cc0", 2, 0.9, "publicdomain zero", "creativecommons org publicdomain zero 1 0"),
    ("ofl", 1, 1.0, "open font", "this font software is licen[sc]ed under the sil open font licen[sc]e(?: version 1 1)?"),
    ("ofl", 2, 0.85, "open font", "(?:sil )?open font licen[sc]e"),
    ("odbl", 2, 0.9, "open database", "open (?:data commons open )?database licen[sc]e"),
    ("odc by", 2, 0.9, "open data commons attribution", "open data commons attribution licen[sc]e"),
    ("pddl", 2, 0.9, "public domain dedication", "open data commons public domain dedication(?: and licen[sc]e)?"),
    ("open government", 2, 0.85, "open government", "open government licen[sc]e(?: (?:version |v)?[123] 0)?"),
    # Source available, and none
    ("sspl", 2, 0.9, "server side public", "server side public licen[sc]e(?: (?:version |v)?1)?"),
    ("busl", 1, 0.98, "business source", "use of this software is governed by the business source licen[sc]e"),
    ("busl", 2, 0.9, "business source", "business source licen[sc]e(?: 1 1)?"),
    ("elastic", 2, 0.9, "elastic licen", "elastic licen[sc]e(?: 2 0)?"),
    ("commons clause", 2, 0.9, "commons clause", "(?:the software is provided to you by the licensor under the license as defined below subject to the following condition )?commons clause"),
    ("polyform", 2, 0.9, "polyform", "polyform (?:noncommercial|small business|shield|perimeter|strict) licen[sc]e"),
    ("json", 1, 0.95, "shall be used for good", "the software shall be used for good not evil"),
    ("public domain", 1, 0.9, "public domain", "(?:is |are |been )?(?:hereby )?(?:dedicated to|released into|placed in(?:to)?) the public domain"),
    ("public domain", 2, 0.7, "public domain", "(?:in )?the public domain"),
    ("proprietary", 1, 0.95, "confidential", "proprietary and confidential|confidential and proprietary"),
    ("proprietary", 1, 0.95, "prior written", "no part of this (?:publication|work|document|software) may be reproduced .{0,120}?without the prior written (?:permission|consent)"),
    ("proprietary", 2, 0.6, "all rights reserved", "all rights reserved"),
]
TIERS = 3
#: Any match of a signature holds one of these, so a text without them has none.
GATE_PHRASES = ["licen", "gpl", "spdx", "hereby granted", "substantial portions", "x consortium", "redistributions", "redistribution and use", "endorse or promote", "advertising materials", "bsd", "gnu", "free software", "freedom to share", "runtime library exception", "classpath exception", "apache", "cddl", "cecill", "cc0", "cc by", "creative commons", "creativecommons", "public domain", "mozilla", "commons clause", "rights reserved", "prior written", "confidential", "be used for good", "misrepresented", "altered source", "unencumbered", "terms as perl", "cryptographic software", "independent jpeg", "wtfpl", "package may be", "php software", "openssl project", "permission to use", "mit x11"]
#: The same as a regex over single-spaced words.
GATE = "|".join(GATE_PHRASES)
#: A text's rows are spread over so many keys where they meet its labels.
SALTS = 16


def rule_rows() -> list[tuple[int, str, int, float, str]]:
    """(rule, label, tier, confidence, regex) of each signature, in order."""
    return [(i, label, tier, sure, f" (?:{pattern})(?= )") for i, (label, tier, sure, _, pattern) in enumerate(SIGNATURES)]


def _words_in(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def _base(norm: Column) -> dict[str, Column]:
    """Of a text of words that each have a space on either side: all places of the phrases, the first and last, and the labels found."""
    n, first, last, labels = [], [], [], []
    total = _words_in(norm) / 2
    for phrase, label in PHRASES.items():
        p = F.lit("".join(f" {w} " for w in phrase.split()))
        has = F.contains(norm, p)
        k = len(phrase.split())
        n.append((F.length(norm) - F.length(F.replace(norm, p, F.lit("")))) / F.length(p))
        first.append(F.when(has, _words_in(F.split_part(norm, p, F.lit(1))) / 2))
        last.append(F.when(has, total - k - _words_in(F.split_part(norm, p, F.lit(-1))) / 2))
        labels.append(F.when(has, F.lit(label)))
    return {"n_base": reduce(Column.__add__, n), "first_word": F.least(*first), "last_word": F.greatest(*last), "base": F.array_compact(F.array(*labels))}


def _spaced(text: Column) -> Column:
    """The words of a text, lower-cased, with one space before, between and behind them."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(ascii_lower(text), BETWEEN, " ")), F.lit(" "))


def _n_words(text: Column) -> Column:
    """Words of a text: each becomes one character, also one put behind the text, so that what separates is never left over."""
    return F.length(F.regexp_replace(F.concat(text, F.lit(" a")), ONE_WORD, ".")) - 1


def _gated(norm: Column) -> Column:
    """norm where it holds a phrase of the gate, else null. An array carries norm, so that it is made once for all phrases, in filters too."""
    return F.get(F.filter(F.array(norm), lambda t: reduce(Column.__or__, [F.contains(t, F.lit(p)) for p in GATE_PHRASES])), F.lit(0))


def detections(texts: DataFrame, spark: SparkSession) -> DataFrame:
    """key, norm -> key, label, tier, sure, first, end: what stays after suppression.

    The keyword gate picks the signatures to try on a text, an equi-join with their fixed table
    gives the regexes. A detection goes if an interval of the same or a better tier holds it
    (of equal intervals of a tier, the first rule's stays). Running maxima over intervals in
    order find that in one sort for each text.
    """
    rules = spark.createDataFrame(rule_rows(), "rule int, label string, tier int, sure double, pattern string")
    gates = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(keyword).alias("keyword")) for i, (_, _, _, keyword, _) in enumerate(SIGNATURES)])
    keyed = texts.select("key", "norm", F.explode(F.filter(gates, lambda g: F.contains(F.col("norm"), g["keyword"]))["rule"]).alias("rule"))
    tried = keyed.join(F.broadcast(rules), "rule").select("key", "rule", "label", "tier", "sure", F.split("norm", F.col("pattern"), -1).alias("gaps"), F.regexp_extract_all("norm", F.col("pattern"), F.lit(0)).alias("hits")).where(F.size("hits") > 0)
    spans = tried.select("key", "rule", "label", "tier", "sure", F.posexplode(F.arrays_zip(F.transform(F.slice("gaps", F.lit(1), F.size("hits")), _words_in).alias("gap"), F.transform("hits", _words_in).alias("hit"))).alias("i", "x"))
    run = Window.partitionBy("key", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = spans.withColumn("end", F.sum(F.col("x.gap") + F.col("x.hit")).over(run)).withColumn("first", F.col("end") - F.col("x.hit"))
    order = Window.partitionBy("key").orderBy("first", F.desc("end"), "tier", "rule").rowsBetween(Window.unboundedPreceding, -1)
    held = reduce(Column.__or__, [(F.col("tier") >= t) & (F.max(F.when(F.col("tier") <= t, F.col("end"))).over(order) >= F.col("end")) for t in range(1, TIERS + 1)])
    return placed.withColumn("held", F.coalesce(held, F.lit(False))).where(~F.col("held")).select("key", "label", "tier", "sure", "first", "end")


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every whole text.

    The base counts the phrases of PHRASES in the words; labels adds those of the rules that
    stay after suppression, score is the surest rule's confidence (0 without any). A null or
    empty text has 0 words and empty labels. Detection runs once for each different text that
    passes the gate, found by its md5, so groups of copies cost one, and their rows are spread
    over SALTS keys where they meet the result; every row of docs comes back, repeated ones and
    those with null ids too. Very long texts count whole; of detections with equal intervals in
    one tier the first signature's stays. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    d = pick(docs, doc_id="doc_id", text="text").withColumn("text", F.coalesce("text", F.lit("")))
    spaced = _spaced(F.col("text"))
    has = F.col("text").rlike("(?i)license")
    norm = F.when(has, F.replace(spaced, F.lit(" "), F.lit("  "))).otherwise(F.lit(""))
    norm = F.when(has, F.substring(norm, F.lit(2), F.length(norm) - 2)).otherwise(F.lit(""))
    rows = d.select("doc_id", F.md5("text").alias("key"), _n_words(F.col("text")).cast("long").alias("n_words"), norm.alias("norm"))
    b = _base(F.col("norm"))
    rows = rows.select("doc_id", "key", "n_words", *[c.alias(k) for k, c in b.items()])
    texts = d.select(F.md5("text").alias("key"), _gated(spaced).alias("norm")).where("norm IS NOT NULL").groupBy("key").agg(F.first("norm").alias("norm"))
    found = detections(texts, spark).groupBy("key").agg(F.collect_set("label").alias("found"), F.max("sure").alias("sure"))
    found = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    labels = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    return rows.join(found, ["key", "salt"], "left").select(
        "doc_id",
        "n_words",
        F.col("n_base").cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.greatest(F.coalesce("sure", F.lit(0.0)), F.when(F.col("n_base") > 0, F.lit(0.6)).otherwise(F.lit(0.0))).alias("score"),
    )
