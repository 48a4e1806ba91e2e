"""The license signatures, written by hand: fixed values, in the order in which they take precedence.

A section is (weight, rules) and a rule (label, pattern over lower-cased text whose white space is single blanks).
Sections stand from the most specific form to the least. Shorthands: ``L`` license or licence, ``V`` what may stand
before a version, ``X`` the end of a version that a minor zero may follow, ``B`` and ``E`` where a word begins and ends,
``P`` the words that may lead to a name.
"""

from __future__ import annotations

L = "licen[cs]e"
V = r"(?:,? ?(?:version|ver\.?|v\.?|-)? ?)"
X = r"(?:\.0)?(?![0-9.]*[0-9])"
B, E = "(?<![a-z0-9])", "(?![a-z0-9])"
S = "spdx-license-identifier: ?"
P = r"(?:(?:licen[cs]ed (?:to you )?under |under |licen[cs]e[\"']? ?[:=] ?[\"']?)(?:the )?(?:(?:terms|conditions) (?:and conditions )?of (?:the )?)?)?"

TAGS: list[tuple[str, str]] = [
    ("gpl-1", rf"{S}gpl-1\.0(?:-only|-or-later|\+)?{E}"),
    ("gpl-2", rf"{S}gpl-2\.0(?:-only|-or-later|\+)?{E}"),
    ("gpl-3", rf"{S}gpl-3\.0(?:-only|-or-later|\+)?{E}"),
    ("lgpl-2", rf"{S}lgpl-2\.0(?:-only|-or-later|\+)?{E}"),
    ("lgpl-2.1", rf"{S}lgpl-2\.1(?:-only|-or-later|\+)?{E}"),
    ("lgpl-3", rf"{S}lgpl-3\.0(?:-only|-or-later|\+)?{E}"),
    ("agpl-3", rf"{S}agpl-3\.0(?:-only|-or-later|\+)?{E}"),
    ("gfdl-1.3", rf"{S}gfdl-1\.3(?:-only|-or-later|\+)?{E}"),
    ("apache-1.1", rf"{S}apache-1\.1{E}"),
    ("apache-2", rf"{S}apache-2\.0{E}"),
    ("mit", rf"{S}mit(?:-0)?{E}"),
    ("bsd-2-clause", rf"{S}bsd-2-clause(?:-patent|-views)?{E}"),
    ("bsd-3-clause", rf"{S}bsd-3-clause(?:-clear|-lbnl)?{E}"),
    ("bsd-4-clause", rf"{S}bsd-4-clause{E}"),
    ("0bsd", rf"{S}0bsd{E}"),
    ("isc", rf"{S}isc{E}"),
    ("mpl-1.1", rf"{S}mpl-1\.1{E}"),
    ("mpl-2", rf"{S}mpl-2\.0(?:-no-copyleft-exception)?{E}"),
    ("epl-1", rf"{S}epl-1\.0{E}"),
    ("epl-2", rf"{S}epl-2\.0{E}"),
    ("eupl-1.2", rf"{S}eupl-1\.2{E}"),
    ("cddl-1", rf"{S}cddl-1\.0{E}"),
    ("afl-3", rf"{S}afl-3\.0{E}"),
    ("osl-3", rf"{S}osl-3\.0{E}"),
    ("artistic-2", rf"{S}artistic-2\.0{E}"),
    ("zlib", rf"{S}zlib{E}"),
    ("boost-1", rf"{S}bsl-1\.0{E}"),
    ("bsl-1.1", rf"{S}busl-1\.1{E}"),
    ("unlicense", rf"{S}unlicense{E}"),
    ("wtfpl", rf"{S}wtfpl{E}"),
    ("python-2", rf"{S}(?:psf-2\.0|python-2\.0){E}"),
    ("ofl-1.1", rf"{S}ofl-1\.1(?:-rfn|-no-rfn)?{E}"),
    ("php-3.01", rf"{S}php-3\.01{E}"),
    ("postgresql", rf"{S}postgresql{E}"),
    ("openssl", rf"{S}openssl{E}"),
    ("zope-2.1", rf"{S}zpl-2\.1{E}"),
    ("w3c", rf"{S}w3c{E}"),
    ("ms-pl", rf"{S}ms-pl{E}"),
    ("ms-rl", rf"{S}ms-rl{E}"),
    ("odbl-1", rf"{S}odbl-1\.0{E}"),
    ("upl-1", rf"{S}upl-1\.0{E}"),
    ("sspl-1", rf"{S}sspl-1\.0{E}"),
    ("elastic-2", rf"{S}elastic-2\.0{E}"),
    ("cc0-1", rf"{S}cc0-1\.0{E}"),
    ("cc-by-3", rf"{S}cc-by-3\.0{E}"),
    ("cc-by-4", rf"{S}cc-by-4\.0{E}"),
    ("cc-by-sa-3", rf"{S}cc-by-sa-3\.0{E}"),
    ("cc-by-sa-4", rf"{S}cc-by-sa-4\.0{E}"),
    ("cc-by-nc-4", rf"{S}cc-by-nc-4\.0{E}"),
    ("cc-by-nd-4", rf"{S}cc-by-nd-4\.0{E}"),
    ("cc-by-nc-sa-4", rf"{S}cc-by-nc-sa-4\.0{E}"),
    ("cc-by-nc-nd-4", rf"{S}cc-by-nc-nd-4\.0{E}"),
]

GRANTS: list[tuple[str, str]] = [
    ("gpl-2-or-later", r"under the terms of the gnu general public license as published by the free software foundation[;,] (?:either )?version 2 of the license, or \(at your option\) any later version"),
    ("gpl-3-or-later", r"under the terms of the gnu general public license as published by the free software foundation[;,] (?:either )?version 3 of the license, or \(at your option\) any later version"),
    ("gpl-2", r"under the terms of the gnu general public license,? version 2,? as published by the free software foundation"),
    ("gpl-3", r"under the terms of the gnu general public license,? version 3,? as published by the free software foundation"),
    ("lgpl-2.1-or-later", r"under the terms of the gnu lesser general public license as published by the free software foundation[;,] (?:either )?version 2\.1 of the license, or"),
    ("lgpl-2-or-later", r"under the terms of the gnu library general public license as published by the free software foundation[;,] (?:either )?version 2 of the license, or"),
    ("lgpl-3-or-later", r"under the terms of the gnu lesser general public license as published by the free software foundation[;,] (?:either )?version 3 of the license, or"),
    ("agpl-3-or-later", r"under the terms of the gnu affero general public license as published by the free software foundation[;,] (?:either )?version 3 of the license, or"),
    ("gfdl-1.3-or-later", r"under the terms of the gnu free documentation license, version 1\.3 or any later version"),
    ("gfdl-1.2-or-later", r"under the terms of the gnu free documentation license, version 1\.2 or any later version"),
    ("apache-2", r"licensed under the apache license, version 2\.0 \(the \"license\"\)"),
    ("apache-2", r"licensed to the apache software foundation \(asf\) under one or more contributor license agreements"),
    ("apache-2", r"the asf licenses this file to you under the apache license, version 2\.0"),
    ("apache-1.1", r"the apache software license, version 1\.1"),
    ("mpl-2", r"this source code form is subject to the terms of the mozilla public license, v\. ?2\.0"),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public license version 1\.1"),
    ("mpl-1", r"the contents of this file are subject to the mozilla public license version 1\.0"),
    ("cddl-1", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("epl-2", r"made available under the terms of the eclipse public license (?:v(?:ersion)? ?)?2\.0"),
    ("epl-1", r"made available under the terms of the eclipse public license (?:v(?:ersion)? ?)?1\.0"),
    ("cpl-1", r"made available under the terms of the common public license (?:v(?:ersion)? ?)?1\.0"),
    ("eupl-1.2", rf"licen[cs]ed under the eupl{V}1\.2"),
    ("eupl-1.1", rf"licen[cs]ed under the eupl{V}1\.1"),
    ("artistic-perl", r"(?:redistribute|use) it (?:and/or modify it )?under the same terms as perl itself"),
    ("ofl-1.1", r"this font software is licensed under the sil open font license, version 1\.1"),
    ("boost-1", r"distributed under the boost software license, version 1\.0"),
    ("zope-2.1", r"subject to the provisions of the zope public license, version 2\.1"),
    ("php-3.01", r"subject to version 3\.01 of the php license"),
    ("php-3", r"subject to version 3\.0 of the php license"),
    ("ms-pl", r"subject to the microsoft public license"),
    ("cc-by-4", r"licen[cs]ed under (?:a|the) creative commons attribution 4\.0 international licen[cs]e"),
    ("cc-by-3", r"licen[cs]ed under (?:a|the) creative commons attribution 3\.0 (?:unported|united states) licen[cs]e"),
    ("cc-by-sa-4", r"licen[cs]ed under (?:a|the) creative commons attribution-sharealike 4\.0 international licen[cs]e"),
    ("cc-by-sa-3", r"licen[cs]ed under (?:a|the) creative commons attribution-sharealike 3\.0 unported licen[cs]e"),
    ("cc-by-nc-4", r"licen[cs]ed under (?:a|the) creative commons attribution-noncommercial 4\.0 international licen[cs]e"),
    ("cc-by-nc-sa-4", r"licen[cs]ed under (?:a|the) creative commons attribution-noncommercial-sharealike 4\.0 international licen[cs]e"),
    ("cc-by-nc-nd-4", r"licen[cs]ed under (?:a|the) creative commons attribution-noncommercial-noderiv(?:ative)?s 4\.0 international licen[cs]e"),
    ("cc-by-nd-4", r"licen[cs]ed under (?:a|the) creative commons attribution-noderiv(?:ative)?s 4\.0 international licen[cs]e"),
    ("cc0-1", r"to the extent possible under law, .{1,120}? has waived all copyright and related or neighbou?ring rights"),
    ("elastic-2", r"licensed under the elastic license 2\.0"),
    ("sspl-1", r"under the terms of the server side public license,? version 1"),
    ("bsl-1.1", r"business source license 1\.1"),
    ("upl-1", r"licensed under the universal permissive license v ?1\.0"),
]

NAMES_WITH_VERSION: list[tuple[str, str]] = [
    ("lgpl-2.1", rf"{P}{B}(?:gnu )?lesser general public {L}{V}2\.1{X}"),
    ("lgpl-3", rf"{P}{B}(?:gnu )?lesser general public {L}{V}3{X}"),
    ("lgpl-2", rf"{P}{B}(?:gnu )?library general public {L}{V}2{X}"),
    ("lgpl-2.1", rf"{P}{B}lgpl{V}2\.1{X}"),
    ("lgpl-2", rf"{P}{B}lgpl{V}2{X}"),
    ("lgpl-3", rf"{P}{B}lgpl{V}3{X}"),
    ("agpl-3", rf"{P}{B}(?:gnu )?affero general public {L}{V}3{X}"),
    ("agpl-1", rf"{P}{B}(?:gnu )?affero general public {L}{V}1{X}"),
    ("agpl-3", rf"{P}{B}agpl{V}3{X}"),
    ("agpl-1", rf"{P}{B}agpl{V}1{X}"),
    ("gpl-1", rf"{P}{B}(?:gnu )?general public {L}{V}1{X}"),
    ("gpl-2", rf"{P}{B}(?:gnu )?general public {L}{V}2{X}"),
    ("gpl-3", rf"{P}{B}(?:gnu )?general public {L}{V}3{X}"),
    ("gpl-1", rf"{P}{B}gpl{V}1{X}"),
    ("gpl-2", rf"{P}{B}gpl{V}2{X}"),
    ("gpl-3", rf"{P}{B}gpl{V}3{X}"),
    ("gfdl-1.1", rf"{P}{B}free documentation {L}{V}1\.1{X}"),
    ("gfdl-1.2", rf"{P}{B}free documentation {L}{V}1\.2{X}"),
    ("gfdl-1.3", rf"{P}{B}free documentation {L}{V}1\.3{X}"),
    ("gfdl-1.2", rf"{P}{B}gfdl{V}1\.2{X}"),
    ("gfdl-1.3", rf"{P}{B}gfdl{V}1\.3{X}"),
    ("apache-1", rf"{P}{B}apache(?: software)?(?: {L})?{V}1{X}"),
    ("apache-1.1", rf"{P}{B}apache(?: software)?(?: {L})?{V}1\.1{X}"),
    ("apache-2", rf"{P}{B}apache(?: software)?(?: {L})?{V}2{X}"),
    ("bsd-2-clause", rf"{P}{B}bsd[- ](?:2|two)[- ]clause{E}"),
    ("bsd-3-clause", rf"{P}{B}bsd[- ](?:3|three)[- ]clause{E}"),
    ("bsd-4-clause", rf"{P}{B}bsd[- ](?:4|four)[- ]clause{E}"),
    ("bsd-2-clause", rf"{P}{B}(?:2|two)[- ]clause bsd{E}"),
    ("bsd-3-clause", rf"{P}{B}(?:3|three)[- ]clause bsd{E}"),
    ("bsd-4-clause", rf"{P}{B}(?:4|four)[- ]clause bsd{E}"),
    ("bsd-2-clause", rf"{P}{B}simplified bsd{E}"),
    ("bsd-2-clause", rf"{P}{B}freebsd {L}{E}"),
    ("bsd-3-clause", rf"{P}{B}(?:modified|revised) bsd{E}"),
    ("bsd-3-clause", rf"{P}{B}new bsd {L}{E}"),
    ("bsd-4-clause", rf"{P}{B}original bsd {L}{E}"),
    ("0bsd", rf"{P}{B}zero[- ]clause bsd{E}"),
    ("mpl-1", rf"{P}{B}mozilla public {L}{V}1{X}"),
    ("mpl-1.1", rf"{P}{B}mozilla public {L}{V}1\.1{X}"),
    ("mpl-2", rf"{P}{B}mozilla public {L}{V}2{X}"),
    ("mpl-1.1", rf"{P}{B}mpl{V}1\.1{X}"),
    ("mpl-2", rf"{P}{B}mpl{V}2{X}"),
    ("epl-1", rf"{P}{B}eclipse public {L}{V}1{X}"),
    ("epl-2", rf"{P}{B}eclipse public {L}{V}2{X}"),
    ("epl-1", rf"{P}{B}epl{V}1{X}"),
    ("epl-2", rf"{P}{B}epl{V}2{X}"),
    ("eupl-1.1", rf"{P}{B}european union public {L}{V}1\.1{X}"),
    ("eupl-1.2", rf"{P}{B}european union public {L}{V}1\.2{X}"),
    ("cddl-1", rf"{P}{B}common development and distribution {L}{V}1{X}"),
    ("cddl-1.1", rf"{P}{B}common development and distribution {L}{V}1\.1{X}"),
    ("cddl-1", rf"{P}{B}cddl{V}1{X}"),
    ("cpl-1", rf"{P}{B}common public {L}{V}1{X}"),
    ("afl-2.1", rf"{P}{B}academic free {L}{V}2\.1{X}"),
    ("afl-3", rf"{P}{B}academic free {L}{V}3{X}"),
    ("osl-2.1", rf"{P}{B}open software {L}{V}2\.1{X}"),
    ("osl-3", rf"{P}{B}open software {L}{V}3{X}"),
    ("artistic-1", rf"{P}{B}artistic {L}{V}1{X}"),
    ("artistic-2", rf"{P}{B}artistic {L}{V}2{X}"),
    ("boost-1", rf"{P}{B}boost software {L}{V}1{X}"),
    ("wtfpl-2", rf"{P}{B}wtfpl{V}2{X}"),
    ("python-2", rf"{P}{B}python software foundation {L}{V}2{X}"),
    ("ofl-1", rf"{P}{B}open font {L}{V}1{X}"),
    ("ofl-1.1", rf"{P}{B}open font {L}{V}1\.1{X}"),
    ("zope-2", rf"{P}{B}zope public {L}{V}2{X}"),
    ("zope-2.1", rf"{P}{B}zope public {L}{V}2\.1{X}"),
    ("odbl-1", rf"{P}{B}open database {L}{V}1{X}"),
    ("odc-by-1", rf"{P}{B}open data commons attribution {L}{V}1{X}"),
    ("pddl-1", rf"{P}{B}public domain dedication and {L}{V}1{X}"),
    ("upl-1", rf"{P}{B}universal permissive {L}{V}1{X}"),
    ("sspl-1", rf"{P}{B}server side public {L}{V}1{X}"),
    ("elastic-1", rf"{P}{B}elastic {L}{V}1{X}"),
    ("elastic-2", rf"{P}{B}elastic {L}{V}2{X}"),
    ("openrail-1", rf"{P}{B}(?:creativeml |bigscience )?open ?rail(?:-m|-s|\+\+)?{V}1{X}"),
    ("cc0-1", rf"{P}{B}cc0{V}1{X}"),
    ("cc0-1", r"creative commons zero v?1\.0 universal"),
    ("cc-by-nc-sa-3", rf"{P}{B}cc[- ]by[- ]nc[- ]sa{V}3{X}"),
    ("cc-by-nc-sa-4", rf"{P}{B}cc[- ]by[- ]nc[- ]sa{V}4{X}"),
    ("cc-by-nc-nd-3", rf"{P}{B}cc[- ]by[- ]nc[- ]nd{V}3{X}"),
    ("cc-by-nc-nd-4", rf"{P}{B}cc[- ]by[- ]nc[- ]nd{V}4{X}"),
    ("cc-by-nc-3", rf"{P}{B}cc[- ]by[- ]nc{V}3{X}"),
    ("cc-by-nc-4", rf"{P}{B}cc[- ]by[- ]nc{V}4{X}"),
    ("cc-by-nd-3", rf"{P}{B}cc[- ]by[- ]nd{V}3{X}"),
    ("cc-by-nd-4", rf"{P}{B}cc[- ]by[- ]nd{V}4{X}"),
    ("cc-by-sa-2.5", rf"{P}{B}cc[- ]by[- ]sa{V}2\.5{X}"),
    ("cc-by-sa-3", rf"{P}{B}cc[- ]by[- ]sa{V}3{X}"),
    ("cc-by-sa-4", rf"{P}{B}cc[- ]by[- ]sa{V}4{X}"),
    ("cc-by-2", rf"{P}{B}cc[- ]by{V}2{X}"),
    ("cc-by-2.5", rf"{P}{B}cc[- ]by{V}2\.5{X}"),
    ("cc-by-3", rf"{P}{B}cc[- ]by{V}3{X}"),
    ("cc-by-4", rf"{P}{B}cc[- ]by{V}4{X}"),
    ("cc-by-3", rf"{P}{B}creative commons attribution{V}3{X}"),
    ("cc-by-4", rf"{P}{B}creative commons attribution{V}4{X}"),
    ("cc-by-sa-3", rf"{P}{B}creative commons attribution[- ]share ?alike{V}3{X}"),
    ("cc-by-sa-4", rf"{P}{B}creative commons attribution[- ]share ?alike{V}4{X}"),
    ("cc-by-nc-4", rf"{P}{B}creative commons attribution[- ]non ?commercial{V}4{X}"),
    ("cc-by-nd-4", rf"{P}{B}creative commons attribution[- ]no ?deriv(?:ative)?s{V}4{X}"),
]

NOTICES: list[tuple[str, str]] = [
    ("mit", r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", r"the software is provided \"as is\", without warranty of any kind, express or implied"),
    ("isc", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose"),
    ("hpnd", r"permission to use, copy, modify,? and distribute this software and its documentation for any purpose"),
    ("bsd", r"redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd", r"redistribution and use in source and binary forms"),
    ("bsd", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", r"this software is provided by the copyright holders and contributors \"as is\""),
    ("bsd-3-clause", r"neither the name of (?:.{1,80}? )?nor the names of (?:its|their) contributors"),
    ("bsd-3-clause", r"the name of the author may not be used to endorse or promote products"),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display"),
    ("apache-2", r"https?://www\.apache\.org/licenses/license-2\.0"),
    ("apache-2", r"unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an \"as is\" basis"),
    ("apache-1.1", r"this product includes software developed by the apache software foundation"),
    ("gpl", r"this program is free software[:;] you can redistribute it"),
    ("gpl", r"this program is distributed in the hope that it will be useful, but without any warranty"),
    ("gpl", r"you should have received a copy of the gnu general public license"),
    ("lgpl", r"this library is free software[:;] you can redistribute it"),
    ("lgpl", r"you should have received a copy of the gnu (?:lesser|library) general public license"),
    ("agpl", r"you should have received a copy of the gnu affero general public license"),
    ("gpl-2", r"https?://www\.gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    ("gpl-3", r"https?://www\.gnu\.org/licenses/gpl-3\.0"),
    ("lgpl", r"https?://www\.gnu\.org/licenses/(?:old-licenses/)?lgpl"),
    ("agpl", r"https?://www\.gnu\.org/licenses/agpl"),
    ("gnu", r"https?://www\.gnu\.org/licenses/"),
    ("mpl-2", r"https?://(?:www\.)?mozilla\.org/mpl/2\.0"),
    ("mpl", r"https?://(?:www\.)?mozilla\.org/mpl/"),
    ("epl-2", r"https?://www\.eclipse\.org/legal/epl-(?:v20|2\.0)"),
    ("epl-1", r"https?://www\.eclipse\.org/legal/epl-v10"),
    ("mit", r"https?://(?:www\.)?opensource\.org/licenses/mit"),
    ("bsd", r"https?://(?:www\.)?opensource\.org/licenses/bsd"),
    ("osi", r"https?://(?:www\.)?opensource\.org/licenses/[a-z0-9.-]+"),
    ("boost-1", r"https?://www\.boost\.org/license_1_0\.txt"),
    ("cc0-1", r"https?://creativecommons\.org/publicdomain/zero/1\.0"),
    ("public-domain", r"https?://creativecommons\.org/publicdomain/mark/1\.0"),
    ("cc-by", r"https?://creativecommons\.org/licenses/by/[0-9.]+"),
    ("cc-by-sa", r"https?://creativecommons\.org/licenses/by-sa/[0-9.]+"),
    ("cc-by-nc", r"https?://creativecommons\.org/licenses/by-nc/[0-9.]+"),
    ("cc-by-nd", r"https?://creativecommons\.org/licenses/by-nd/[0-9.]+"),
    ("cc-by-nc-sa", r"https?://creativecommons\.org/licenses/by-nc-sa/[0-9.]+"),
    ("cc-by-nc-nd", r"https?://creativecommons\.org/licenses/by-nc-nd/[0-9.]+"),
    ("creative-commons", r"https?://creativecommons\.org/(?:licenses|publicdomain)/[a-z-]+"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", r"https?://unlicense\.org"),
    ("wtfpl", r"do what the fuck you want to public licen[cs]e"),
    ("zlib", r"this software is provided 'as-is', without any express or implied warranty"),
    ("zlib", r"altered source versions must be plainly marked as such"),
    ("boost", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("python", r"psf is making python available to licensee on an \"as is\" basis"),
    ("openssl", r"this product includes software developed by the openssl project"),
    ("openssl", r"this product includes cryptographic software written by eric young"),
    ("postgresql", r"in no event shall the university of california be liable to any party for direct, indirect, special"),
    ("ofl", r"the font software may be modified, altered, or added to"),
    ("beerware", r"if we meet some day, and you think this stuff is worth it, you can buy me a beer"),
    ("json", r"the software shall be used for good, not evil"),
    ("sleepycat", r"redistributions in any form must be accompanied by information on how to obtain complete source code"),
    ("ms-pl", r"if you use the software, you accept this license\. if you do not accept the license, do not use the software"),
    ("public-domain", r"(?:dedicated|released|placed|put) (?:in|into|to) the public domain"),
    ("public-domain", r"this (?:work|file|code|software) is in the public domain"),
]

NAMES: list[tuple[str, str]] = [
    ("lgpl", rf"{B}(?:gnu )?(?:lesser|library) general public {L}{E}"),
    ("agpl", rf"{B}(?:gnu )?affero general public {L}{E}"),
    ("gpl", rf"{B}(?:gnu )?general public {L}{E}"),
    ("gpl", rf"under (?:the )?(?:terms|conditions) (?:and conditions )?of (?:the )?(?:gnu )?gpl{E}"),
    ("lgpl", rf"under (?:the )?(?:terms|conditions) (?:and conditions )?of (?:the )?(?:gnu )?lgpl{E}"),
    ("agpl", rf"under (?:the )?(?:terms|conditions) (?:and conditions )?of (?:the )?(?:gnu )?agpl{E}"),
    ("gpl", rf"licen[cs]ed under (?:the )?(?:gnu )?gpl{E}"),
    ("lgpl", rf"licen[cs]ed under (?:the )?(?:gnu )?lgpl{E}"),
    ("agpl", rf"licen[cs]ed under (?:the )?(?:gnu )?agpl{E}"),
    ("gpl", rf"{B}gpl,? {L}{E}"),
    ("lgpl", rf"{B}lgpl,? {L}{E}"),
    ("agpl", rf"{B}agpl,? {L}{E}"),
    ("gfdl", rf"{B}(?:gnu )?free documentation {L}{E}"),
    ("gfdl", rf"{B}gfdl{E}"),
    ("apache", rf"{B}apache(?: software)? {L}{E}"),
    ("apache", rf"under (?:the )?(?:terms|conditions) of (?:the )?apache{E}"),
    ("apache", rf"licen[cs]ed under (?:the )?apache{E}"),
    ("mit", rf"{B}mit {L}{E}"),
    ("mit", rf"licen[cs]ed under (?:the )?(?:terms of (?:the )?)?mit{E}"),
    ("mit", rf"under (?:the )?(?:terms|conditions) of (?:the )?mit{E}"),
    ("mit", rf"{B}expat {L}{E}"),
    ("mit", rf"{L}[\"']? ?[:=] ?[\"']?mit{E}"),
    ("x11", rf"{B}x11 {L}{E}"),
    ("bsd", rf"{B}bsd(?:[- ]style)? {L}{E}"),
    ("bsd", rf"licen[cs]ed under (?:the )?(?:terms of (?:the )?)?bsd{E}"),
    ("bsd", rf"{L}[\"']? ?[:=] ?[\"']?bsd{E}"),
    ("isc", rf"{B}isc {L}{E}"),
    ("mpl", rf"{B}mozilla public {L}{E}"),
    ("mpl", rf"under (?:the )?(?:terms|conditions) of (?:the )?mpl{E}"),
    ("mpl", rf"licen[cs]ed under (?:the )?mpl{E}"),
    ("epl", rf"{B}eclipse public {L}{E}"),
    ("epl", rf"licen[cs]ed under (?:the )?epl{E}"),
    ("eupl", rf"{B}european union public {L}{E}"),
    ("cddl", rf"{B}common development and distribution {L}{E}"),
    ("cddl", rf"{B}cddl{E}"),
    ("cpl", rf"{B}common public {L}{E}"),
    ("ipl", rf"{B}ibm public {L}{E}"),
    ("afl", rf"{B}academic free {L}{E}"),
    ("osl", rf"{B}open software {L}{E}"),
    ("artistic", rf"{B}artistic {L}{E}"),
    ("zlib", rf"{B}zlib(?:/libpng)? {L}{E}"),
    ("boost", rf"{B}boost software {L}{E}"),
    ("unlicense", rf"{B}the unlicense{E}"),
    ("wtfpl", rf"{B}wtfpl{E}"),
    ("python", rf"{B}python(?: software foundation)? {L}{E}"),
    ("python", rf"{B}psf {L}{E}"),
    ("ofl", rf"{B}(?:sil )?open font {L}{E}"),
    ("php", rf"{B}php {L}{E}"),
    ("ruby", rf"{B}ruby {L}{E}"),
    ("postgresql", rf"{B}postgresql {L}{E}"),
    ("openssl", rf"{B}openssl {L}{E}"),
    ("vim", rf"{B}vim {L}{E}"),
    ("curl", rf"{B}curl {L}{E}"),
    ("libpng", rf"{B}libpng {L}{E}"),
    ("latex", rf"{B}latex project public {L}{E}"),
    ("latex", rf"{B}lppl{E}"),
    ("ncsa", rf"{B}university of illinois/ncsa open source {L}{E}"),
    ("zope", rf"{B}zope public {L}{E}"),
    ("w3c", rf"{B}w3c(?: software)?(?: notice and)? {L}{E}"),
    ("ms-pl", rf"{B}microsoft public {L}{E}"),
    ("ms-rl", rf"{B}microsoft reciprocal {L}{E}"),
    ("odbl", rf"{B}open database {L}{E}"),
    ("odc-by", rf"{B}open data commons attribution {L}{E}"),
    ("pddl", rf"{B}public domain dedication and {L}{E}"),
    ("upl", rf"{B}universal permissive {L}{E}"),
    ("bsl", rf"{B}business source {L}{E}"),
    ("sspl", rf"{B}server side public {L}{E}"),
    ("elastic", rf"{B}elastic {L}{E}"),
    ("commons-clause", rf"{B}commons clause {L}{E}"),
    ("openrail", rf"{B}(?:creativeml |bigscience )?open ?rail(?:-m|-s|\+\+)?{E}"),
    ("llama", rf"{B}llama [23](?:\.[0-9])? community {L}{E}"),
    ("cecill", rf"{B}cecill(?:-[abc])?{E}"),
    ("mulan", rf"{B}mulan (?:permissive software|psl) {L}{E}"),
    ("cc-by-nc-sa", rf"{B}cc[- ]by[- ]nc[- ]sa{E}"),
    ("cc-by-nc-nd", rf"{B}cc[- ]by[- ]nc[- ]nd{E}"),
    ("cc-by-nc", rf"{B}cc[- ]by[- ]nc{E}"),
    ("cc-by-nd", rf"{B}cc[- ]by[- ]nd{E}"),
    ("cc-by-sa", rf"{B}cc[- ]by[- ]sa{E}"),
    ("cc0", rf"{B}cc0{E}"),
    ("cc-by-nc-sa", rf"{B}creative commons attribution[- ]non ?commercial[- ]share ?alike{E}"),
    ("cc-by-nc-nd", rf"{B}creative commons attribution[- ]non ?commercial[- ]no ?deriv(?:ative)?s{E}"),
    ("cc-by-nc", rf"{B}creative commons attribution[- ]non ?commercial{E}"),
    ("cc-by-nd", rf"{B}creative commons attribution[- ]no ?deriv(?:ative)?s{E}"),
    ("cc-by-sa", rf"{B}creative commons attribution[- ]share ?alike{E}"),
    ("cc-by", rf"{B}creative commons attribution{E}"),
    ("creative-commons", rf"{B}creative commons {L}{E}"),
]

HINTS: list[tuple[str, str]] = [
    ("proprietary", rf"{B}all rights reserved{E}"),
    ("proprietary", r"proprietary and confidential"),
    ("proprietary", r"unauthorized copying of this file, via any medium,? is strictly prohibited"),
    ("proprietary", rf"{B}end user {L} agreement{E}"),
    ("copyright", rf"{B}copyright (?:\(c\)|©)? ?(?:19|20)[0-9]{{2}}"),
]

SECTIONS: list[tuple[float, list[tuple[str, str]]]] = [(0.95, TAGS), (0.9, GRANTS), (0.85, NAMES_WITH_VERSION), (0.85, NOTICES), (0.6, NAMES), (0.4, HINTS)]
