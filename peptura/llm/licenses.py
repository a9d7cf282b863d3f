"""License scan: ordered signature rules behind a keyword gate.

Rules are regexes over the normalised words of a text (A-Z lower-cased, words joined by one space). They come from a
hand-written table of license families, written out by a few templates, and from full-text signatures. A rule runs only
on texts that hold its keyword, and one pass of an automaton finds the keywords of all rules. Detections are taken in the order of priority, then length, then rule order; one that
lies inside a kept interval is dropped. The base phrases of the contract are found beside them and always stay.

Cases: null and empty texts have no words, no labels and score 0; very long texts are read whole; repeated rows are
judged each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow import over_slices
from .common import alnum_words

#: Fixed phrases of the contract and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: label, names (words), versions, keyword that a text must hold; a name that is without it is its own keyword.
FAMILIES = (
    ("gpl", ("gnu general public license", "gnu gpl", "gpl"), ("1", "2", "3", "1 0", "2 0", "3 0"), "g"),
    ("lgpl", ("gnu lesser general public license", "gnu library general public license", "gnu lgpl", "lgpl"), ("2", "2 1", "3", "3 0"), "l"),
    ("agpl", ("gnu affero general public license", "affero general public license", "agpl"), ("1", "3", "3 0"), "a"),
    ("gfdl", ("gnu free documentation license", "gfdl"), ("1 1", "1 2", "1 3"), "gfdl"),
    ("apache", ("apache software license", "apache license"), ("1 0", "1 1", "2", "2 0"), "apache"),
    ("mpl", ("mozilla public license", "mpl"), ("1 0", "1 1", "2 0"), "m"),
    ("epl", ("eclipse public license", "epl"), ("1 0", "2 0"), "e"),
    ("eupl", ("european union public licence", "european union public license", "eupl"), ("1 0", "1 1", "1 2"), "eu"),
    ("cddl", ("common development and distribution license", "cddl"), ("1 0", "1 1"), "c"),
    ("cpl", ("common public license",), ("0 5", "1 0"), "common public"),
    ("ipl", ("ibm public license",), ("1 0",), "ibm public"),
    ("artistic", ("artistic license", "clarified artistic license"), ("1 0", "2 0"), "artistic"),
    ("afl", ("academic free license",), ("1 1", "1 2", "2 0", "2 1", "3 0"), "academic free"),
    ("osl", ("open software license",), ("1 0", "1 1", "2 0", "2 1", "3 0"), "open software"),
    ("apsl", ("apple public source license",), ("1 0", "1 1", "1 2", "2 0"), "apple public"),
    ("bsl", ("boost software license",), ("1 0",), "boost software"),
    ("busl", ("business source license",), ("1 1",), "business source"),
    ("cecill", ("cecill",), ("1 0", "1 1", "2 0", "2 1"), "cecill"),
    ("lppl", ("latex project public license", "lppl"), ("1 0", "1 1", "1 2", "1 3"), "l"),
    ("ofl", ("sil open font license", "open font license"), ("1 0", "1 1"), "open font"),
    ("ncsa", ("university of illinois ncsa open source license", "ncsa open source license"), (), "ncsa"),
    ("psf", ("python software foundation license", "psf license"), ("2",), "license"),
    ("php", ("php license",), ("3 0", "3 01"), "php license"),
    ("ruby", ("ruby license",), (), "ruby license"),
    ("zlib", ("zlib license", "zlib libpng license"), (), "zlib"),
    ("libpng", ("libpng license",), ("2",), "libpng"),
    ("isc", ("isc license",), (), "isc license"),
    ("mit", ("mit license", "expat license", "x11 license"), (), "license"),
    ("mit-0", ("mit no attribution license", "mit no attribution"), (), "mit no"),
    ("bsd", ("bsd license", "bsd style license", "berkeley software distribution license"), (), "license"),
    ("bsd-2", ("2 clause bsd license", "bsd 2 clause license", "bsd 2 clause", "simplified bsd license", "freebsd license"), (), "bsd"),
    ("bsd-3", ("3 clause bsd license", "bsd 3 clause license", "bsd 3 clause", "new bsd license", "modified bsd license"), (), "bsd"),
    ("bsd-4", ("4 clause bsd license", "bsd 4 clause license", "original bsd license"), (), "bsd"),
    ("0bsd", ("zero clause bsd license", "0bsd"), (), "bsd"),
    ("unlicense", ("the unlicense", "unlicense"), (), "unlicense"),
    ("wtfpl", ("do what the fuck you want to public license", "wtfpl"), ("2",), "w"),
    ("cc0", ("cc0", "creative commons zero", "creative commons cc0"), ("1 0",), "c"),
    ("cc-by", ("cc by", "creative commons attribution"), ("1 0", "2 0", "2 5", "3 0", "4 0"), "c"),
    ("cc-by-sa", ("cc by sa", "creative commons attribution sharealike", "creative commons attribution share alike"), ("1 0", "2 0", "2 5", "3 0", "4 0"), "c"),
    ("cc-by-nc", ("cc by nc", "creative commons attribution noncommercial", "creative commons attribution non commercial"), ("1 0", "2 0", "2 5", "3 0", "4 0"), "c"),
    ("cc-by-nd", ("cc by nd", "creative commons attribution noderivatives", "creative commons attribution noderivs"), ("1 0", "2 0", "2 5", "3 0", "4 0"), "c"),
    ("cc-by-nc-sa", ("cc by nc sa", "creative commons attribution noncommercial sharealike"), ("1 0", "2 0", "2 5", "3 0", "4 0"), "c"),
    ("cc-by-nc-nd", ("cc by nc nd", "creative commons attribution noncommercial noderivatives"), ("1 0", "2 0", "2 5", "3 0", "4 0"), "c"),
    ("odbl", ("open database license", "odbl"), ("1 0",), "o"),
    ("odc-by", ("open data commons attribution license",), ("1 0",), "open data"),
    ("pddl", ("public domain dedication and license",), ("1 0",), "dedication"),
    ("ms-pl", ("microsoft public license",), (), "microsoft"),
    ("ms-rl", ("microsoft reciprocal license",), (), "microsoft"),
    ("upl", ("universal permissive license",), ("1 0",), "universal"),
    ("mulan", ("mulan permissive software license", "mulan psl"), ("1", "2"), "mulan"),
    ("sspl", ("server side public license", "sspl"), ("1",), "s"),
    ("elastic", ("elastic license",), ("2 0",), "elastic"),
    ("qpl", ("q public license",), ("1 0",), "q public"),
    ("sleepycat", ("sleepycat license",), (), "sleepycat"),
    ("openssl", ("openssl license",), (), "openssl"),
    ("w3c", ("w3c software license", "w3c software notice and license"), (), "w3c"),
    ("zpl", ("zope public license",), ("1 1", "2 0", "2 1"), "zope"),
    ("vim", ("vim license",), (), "vim license"),
    ("postgresql", ("postgresql license", "postgresql licence"), (), "postgresql"),
    ("curl", ("curl license",), (), "curl"),
    ("beerware", ("beerware license", "beer ware license"), (), "beer"),
)

#: Signatures of license texts: label, words, keyword.
SIGNATURES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "hereby granted"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use"),
    ("bsd-3", "neither the name of .{1,80} nor the names of its contributors may be used to endorse", "endorse"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee", "permission to use copy"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance", "apache"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "free software"),
    ("lgpl", "modify it under the terms of the gnu (?:lesser|library) general public license", "under the terms"),
    ("agpl", "modify it under the terms of the gnu affero general public license", "under the terms"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "source code form"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", "in no event will"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered"),
    ("public-domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain", "public domain"),
    ("proprietary", "all rights reserved", "all rights"),
    ("proprietary", "(?:unauthorized|unauthorised) (?:copying|reproduction|distribution) .{0,40}prohibited", "prohibited"),
    ("copyright", "copyright (?:c )?(?:19|20)[0-9][0-9]", "copyright"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "permission notice"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense", "sublicense"),
    ("mit-0", "to permit persons to whom the software is furnished to do so the software is provided as is", "furnished to do so"),
    ("x11", "except as contained in this notice the name of .{1,80} shall not be used in advertising", "used in advertising"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions of source"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions", "redistributions in binary"),
    ("bsd-4", "all advertising materials mentioning features or use of this software must display the following acknowledgement", "advertising materials"),
    ("0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided", "with or without fee"),
    ("isc", "provided that the above copyright notice and this permission notice appear in all copies", "appear in all copies"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "applicable law"),
    ("apache-2.0", "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide", "each contributor"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability", "hope that it will be useful"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program", "should have received"),
    ("lgpl", "you should have received a copy of the gnu (?:lesser|library) general public license along with this", "should have received"),
    ("agpl", "you should have received a copy of the gnu affero general public license along with this program", "should have received"),
    ("gpl", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", "verbatim copies"),
    ("gpl-exception", "as a special exception the copyright holders? (?:of .{1,60} )?gives? (?:you )?permission to link", "special exception"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "modify this document"),
    ("gfdl", "with no invariant sections no front cover texts and no back cover texts", "invariant sections"),
    ("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at", "mpl was not distributed"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1", "contents of this file"),
    ("cddl-1.0", "the contents of this file are subject to the terms of the common development and distribution license", "contents of this file"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", "accompanying materials"),
    ("cpl-1.0", "this program and the accompanying materials are made available under the terms of the common public license", "accompanying materials"),
    ("eupl", "licensed under the eupl version 1 [12] or as soon they will be approved by the european commission", "european commission"),
    ("artistic-2.0", "the copyright holder reserves the right to not permit distribution of modified versions", "modified versions"),
    ("artistic-1.0", "the intent of this document is to state the conditions under which a package may be copied", "package may be copied"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", "person or organization"),
    ("busl-1.1", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use", "non production use"),
    ("zlib", "this notice may not be removed or altered from any source distribution", "source distribution"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", "plainly marked"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software", "anyone is free to copy"),
    ("wtfpl", "you just do what the fuck you want to", "what the fuck"),
    ("cc0-1.0", "to the extent possible under law .{1,80} has waived all copyright and related or neighboring rights", "has waived all copyright"),
    ("cc-by", "this work is licensed under a creative commons attribution [0-9] [0-9] (?:international|unported) license", "this work is licensed"),
    ("cc-by", "you must give appropriate credit provide a link to the license and indicate if changes were made", "appropriate credit"),
    ("cc-by-sa", "if you remix transform or build upon the material you must distribute your contributions under the same license as the original", "remix transform"),
    ("cc-by-nc", "you may not use the material for commercial purposes", "commercial purposes"),
    ("cc-by-nd", "if you remix transform or build upon the material you may not distribute the modified material", "remix transform"),
    ("ofl", "this font software is licensed under the sil open font license", "font software"),
    ("odbl-1.0", "this .{1,60} is made available under the open database license", "open database license"),
    ("lppl", "this work may be distributed and or modified under the conditions of the latex project public license", "conditions of the latex"),
    ("beerware", "if we meet some day and you think this stuff is worth it you can buy me a beer", "buy me a beer"),
    ("psf-2", "psf hereby grants licensee a nonexclusive royalty free world wide license", "psf hereby grants"),
    ("openssl", "this product includes software developed by the openssl project", "openssl project"),
    ("apache-1.1", "this product includes software developed by the apache software foundation", "apache software foundation"),
    ("sspl-1", "if you make the functionality of the program or a modified version available to third parties as a service", "third parties as a service"),
    ("elastic-2.0", "you may not provide the software to third parties as a hosted or managed service", "hosted or managed service"),
    ("ncsa", "developed by .{1,120} permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software", "to deal with the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", "warranties of merchantability"),
    ("mit", "in no event shall the authors or copyright holders be liable for any claim damages or other liability", "copyright holders be liable"),
    ("mit", "(?:use of this source code|this (?:project|software|package|library|code)) is (?:governed by|licensed under) (?:an|the) mit(?: style)? license", "mit"),
    ("bsd", "this software is provided by the (?:copyright holders?|regents|author|project) and contributors as is and any express or implied warranties", "and contributors as is"),
    ("bsd", "this software is provided by the author as is and any express or implied warranties", "by the author as is"),
    ("bsd", "use of this source code is governed by a bsd style license", "bsd style license"),
    ("bsd", "in no event shall the copyright (?:holder|owner) or contributors be liable for any direct indirect incidental special exemplary or consequential damages", "exemplary or consequential"),
    ("bsd-3", "may not be used to endorse or promote products derived from this software without (?:specific )?prior written permission", "endorse or promote"),
    ("bsd-4", "this product includes software developed by the university of california berkeley and its contributors", "university of california"),
    ("bsd-2", "the views and conclusions contained in the software and documentation are those of the authors and should not be interpreted as representing official policies", "views and conclusions"),
    ("bsd-3-clear", "no express or implied licenses to any party s patent rights are granted by this license", "patent rights are granted"),
    ("bsd-3-lbnl", "you are under no obligation whatsoever to provide any bug fixes patches or upgrades to the features functionality or performance", "bug fixes patches"),
    ("hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted", "software and its documentation"),
    ("hpnd", "no representations are made about the suitability of this software for any purpose it is provided as is without express or implied warranty", "suitability of this software"),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software", "author disclaims all warranties"),
    ("apache-2.0", "you may obtain a copy of the license at (?:http|https) www apache org licenses license 2 0", "www apache org"),
    ("apache-2.0", "see the license for the specific language governing permissions and limitations under the license", "governing permissions"),
    ("apache-2.0", "licensed to the apache software foundation asf under one or more contributor license agreements", "contributor license agreements"),
    ("apache-2.0", "see the notice file distributed with this work for additional information regarding copyright ownership", "notice file distributed"),
    ("apache-2.0", "no charge royalty free irrevocable copyright license to reproduce prepare derivative works of", "royalty free irrevocable"),
    ("apache-1.0", "this product includes software developed by the apache group for use in the apache http server project", "apache group"),
    ("apache-1.1", "products derived from this software may not be called apache nor may apache appear in their name", "may not be called apache"),
    ("gpl-2.0", "gnu general public license version 2 june 1991", "june 1991"),
    ("gpl-3.0", "gnu general public license version 3 29 june 2007", "29 june 2007"),
    ("lgpl-2.1", "gnu lesser general public license version 2 1 february 1999", "february 1999"),
    ("lgpl-2.0", "gnu library general public license version 2 june 1991", "library general public"),
    ("lgpl-3.0", "gnu lesser general public license version 3 29 june 2007", "29 june 2007"),
    ("agpl-3.0", "gnu affero general public license version 3 19 november 2007", "19 november 2007"),
    ("gfdl-1.3", "gnu free documentation license version 1 3 3 november 2008", "3 november 2008"),
    ("gpl", "the licenses for most software are designed to take away your freedom to share and change it", "freedom to share"),
    ("gpl", "when we speak of free software we are referring to freedom not price", "freedom not price"),
    ("gpl", "the gnu general public license is a free copyleft license for software and other kinds of works", "copyleft license"),
    ("gpl", "activities other than copying distribution and modification are not covered by this license", "copying distribution and modification"),
    ("gpl", "you may copy and distribute verbatim copies of the program s source code as you receive it in any medium", "verbatim copies"),
    ("gpl", "if not write to the free software foundation inc", "write to the free software"),
    ("gpl-2.0", "either version 2 of the license or at your option any later version", "at your option"),
    ("gpl-3.0", "either version 3 of the license or at your option any later version", "at your option"),
    ("gpl-exception", "you may (?:use|distribute) (?:this file|the resulting (?:work|executable)) (?:as part of a free software library )?without (?:restriction|being covered by the gnu)", "without"),
    ("gpl-classpath-exception", "linking this library statically or dynamically with other modules is making a combined work based on this library", "statically or dynamically"),
    ("gpl-font-exception", "if you create a document which uses this font and embed this font or unaltered portions of this font into the document", "uses this font"),
    ("gpl-bison-exception", "you may create a larger work that contains part or all of the bison parser skeleton", "parser skeleton"),
    ("gcc-exception", "gcc runtime library exception", "runtime library exception"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", "this library is free software"),
    ("agpl", "your modified version must prominently offer all users interacting with it remotely through a computer network", "through a computer network"),
    ("mpl-2.0", "this source code form is incompatible with secondary licenses", "secondary licenses"),
    ("mpl-1.0", "the contents of this file are subject to the mozilla public license version 1 0", "mozilla public license version 1 0"),
    ("mpl-1.1", "alternatively the contents of this file may be used under the terms of either the gnu general public license", "alternatively the contents"),
    ("npl-1.1", "the contents of this file are subject to the netscape public license version 1 [01]", "netscape public license"),
    ("cddl", "when distributing covered code include this cddl header in each file", "cddl header"),
    ("cddl-1.1", "common development and distribution license cddl version 1 1", "cddl version 1 1"),
    ("epl-2.0", "which (?:is available|accompanies this distribution and is available) at (?:http|https) www eclipse org legal epl", "www eclipse org"),
    ("epl-1.0", "the accompanying program is provided under the terms of this eclipse public license agreement", "accompanying program is provided"),
    ("edl-1.0", "eclipse distribution license v(?: )?1 0", "eclipse distribution license"),
    ("ipl-1.0", "the accompanying program is provided under the terms of this ibm public license", "ibm public license"),
    ("lpl-1.02", "lucent public license version 1 02", "lucent public license"),
    ("ms-pl", "this license governs use of the accompanying software if you use the software you accept this license", "accompanying software"),
    ("ms-pl", "microsoft public license(?: ms pl)?", "microsoft public license"),
    ("ms-rl", "microsoft reciprocal license(?: ms rl)?", "microsoft reciprocal license"),
    ("osl-3.0", "licensed under the open software license version 3 0", "open software license"),
    ("afl-3.0", "licensed under the academic free license version 3 0", "academic free license"),
    ("apsl-2.0", "subject to the apple public source license version 2 0", "apple public source"),
    ("artistic", "you may freely (?:distribute|give away) verbatim copies of the (?:standard version|source form)", "verbatim copies"),
    ("artistic-perl", "this (?:library|program|module|is free software) (?:is free software )?you can redistribute it and or modify it under the same terms as perl itself", "as perl itself"),
    ("clarified-artistic", "the clarified artistic license", "clarified artistic"),
    ("ruby", "you can redistribute it and or modify it under either the terms of the (?:2 clause )?bsdl", "bsdl"),
    ("php-3.01", "this product includes php software freely available from", "includes php software"),
    ("zpl-2.1", "this software consists of contributions made by zope", "made by zope"),
    ("python-2.0", "beopen grants you a non exclusive royalty free world wide license", "beopen"),
    ("cnri-python", "cnri (?:hereby )?grants licensee a (?:nonexclusive|non exclusive) royalty free", "cnri"),
    ("psf-2", "python software foundation license version 2", "python software foundation"),
    ("w3c", "this (?:work|software or document) includes material copied from or derived from", "material copied from"),
    ("unicode", "unicode inc license agreement data files and software", "data files and software"),
    ("unicode-dfs-2016", "hereby granted free of charge to any person obtaining a copy of the unicode data files", "unicode data files"),
    ("icu", "icu license icu 1 8 1 and later", "icu license"),
    ("ijg", "this software is based in part on the work of the independent jpeg group", "independent jpeg group"),
    ("libpng", "the png reference library is supplied as is", "png reference library"),
    ("libtiff", "the names of sam leffler and silicon graphics may not be used in any advertising", "sam leffler"),
    ("ftl", "portions of this software are copyright .{1,40} the freetype project", "freetype project"),
    ("bzip2", "julian seward bzip2", "julian seward"),
    ("info-zip", "info zip software", "info zip"),
    ("sleepycat", "redistributions in any form must be accompanied by information on how to obtain complete source code", "complete source code"),
    ("openldap", "the openldap public license", "openldap"),
    ("tcl", "the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose", "authors hereby grant permission"),
    ("sqlite-blessing", "may you do good and not evil", "good and not evil"),
    ("json", "the software shall be used for good not evil", "good not evil"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document", "verbatim or modified"),
    ("fsfap", "copying and distribution of this file with or without modification are permitted in any medium without royalty", "without royalty"),
    ("fsful", "this configure script is free software the free software foundation gives unlimited permission", "unlimited permission"),
    ("afmparse", "this file may be freely copied and redistributed as long as", "freely copied and redistributed"),
    ("cc0-1.0", "no copyright the person who associated a work with this deed has dedicated the work to the public domain", "dedicated the work"),
    ("cc-by", "you are free to share copy and redistribute the material in any medium or format", "redistribute the material"),
    ("cc-by", "except where otherwise noted (?:this work|content on this site) is licensed under a creative commons", "except where otherwise noted"),
    ("cc-by-nc", "noncommercial you may not use", "noncommercial you may not"),
    ("cc-by-nd", "no(?: )?derivatives if you remix", "if you remix"),
    ("cc-by-sa", "share(?: )?alike if you (?:remix|alter)", "alike if you"),
    ("odc-by-1.0", "open data commons attribution license", "open data commons"),
    ("pddl-1.0", "(?:public domain dedication and licen[cs]e|open data commons public domain)", "public domain"),
    ("ogl-uk-3.0", "contains public sector information licensed under the open government (?:licence|license)", "public sector information"),
    ("etalab-2.0", "licence ouverte(?: open licence)?", "licence ouverte"),
    ("ofl-1.1", "sil open font license version 1 1 26 february 2007", "26 february 2007"),
    ("bitstream-vera", "bitstream vera is a trademark of bitstream", "bitstream vera"),
    ("ubuntu-font-1.0", "ubuntu font licence version 1 0", "ubuntu font"),
    ("cecill", "ce logiciel est regi par la licence cecill", "licence cecill"),
    ("rpl-1.5", "reciprocal public license (?:version )?1 5", "reciprocal public license"),
    ("hippocratic", "the hippocratic license", "hippocratic"),
    ("openrail", "(?:creativeml |bigscience )?open ?rail(?: m)? license", "rail"),
    ("llama", "llama [0-9](?: [0-9])? community license", "community license"),
    ("polyform", "polyform (?:noncommercial|small business|shield|perimeter|strict|free trial) license", "polyform"),
    ("commons-clause", "commons clause license condition", "commons clause"),
    ("parity", "the parity public license", "parity public"),
    ("blueoak-1.0.0", "blue oak model license", "blue oak"),
    ("mulan", "mulan (?:permissive software license|psl|public license)", "mulan"),
    ("upl-1.0", "universal permissive license", "universal permissive"),
    ("vsl-1.0", "vovida software license", "vovida"),
    ("proprietary", "confidential and proprietary (?:information )?(?:of|to)", "confidential and proprietary"),
    ("proprietary", "(?:may not|must not|cannot) be (?:copied|reproduced|distributed|disclosed) .{0,60}without (?:the )?(?:express |prior )*written (?:permission|consent)", "written"),
    ("proprietary", "no part of this (?:document|publication|book|work) may be reproduced", "may be reproduced"),
    ("non-commercial", "(?:free )?for (?:personal(?: and| or)? )?(?:non commercial|noncommercial) use(?: only)?", "commercial use"),
    ("academic", "for (?:academic|research|educational) (?:and (?:academic|research|educational) )?(?:use|purposes) only", "only"),
    ("public-domain", "(?:is|are) (?:hereby )?(?:in|part of) the public domain", "public domain"),
    ("copyright", "(?:all )?content copyright (?:of|by)", "content copyright"),
)


def build_rules() -> list[tuple[str, re.Pattern, bytes, int]]:
    """(label, regex, keyword, priority), hundreds of them, in order."""
    rules = []

    def add(label: str, words: str, key: str, priority: int) -> None:
        rules.append((label, re.compile(b"(?<= )" + words.encode() + b"(?= )"), key.encode(), priority))

    under = "(?:licensed|released|distributed|available|published) under (?:the terms of )?(?:the |a |an )?"
    for label, words, key in SIGNATURES:
        add(label, words, key, 90)
    for label, names, versions, key in FAMILIES:
        for name in names:
            gate = key if len(key) >= 4 and key in name else name
            for v in versions:
                full = f"{label}-{v.replace(' ', '.')}"
                add(f"{full}-or-later", f"(?:{under})?{name}(?: license)?(?: as published by the free software foundation)?(?: either)? (?:version |v )?v?{v} or (?:any |at your option any )?later(?: version)?", gate, 80)
                add(full, f"(?:{under})?{name}(?: license)?(?: international| unported)? (?:version |v )?v?{v}", gate, 70)
                add(full, f"(?:{under})?{name}(?: license)? v{v.replace(' ', '')}", gate, 70)
            add(label, f"spdx license identifier {name}", gate, 65)
            add(label, f"{under}{name}(?: license)?", gate, 60)
            if " " in name:
                add(label, name, gate, 40)
    return rules


_RULES: list = []
_GATES: dict[int, tuple[list, Gate]] = {}


class Gate:
    """Which rules a text may meet: all keywords are looked for in one pass of an automaton. A rule without a keyword is
    always open."""

    def __init__(self, rules: list[tuple[str, re.Pattern, bytes, int]]):
        self.always = [n for n, r in enumerate(rules) if not r[2]]
        self.of: dict[str, list[int]] = {}
        for n, r in enumerate(rules):
            if r[2]:
                self.of.setdefault(r[2].decode("latin-1"), []).append(n)
        self.automaton = ahocorasick.Automaton()
        for key in self.of:
            self.automaton.add_word(key, key)
        if self.of:
            self.automaton.make_automaton()

    def open_to(self, norm: bytes) -> list[int]:
        keys = {key for _, key in self.automaton.iter(norm.decode("latin-1"))} if self.of else ()
        return sorted([*self.always, *(n for key in keys for n in self.of[key])])


def _gate(rules: list) -> Gate:
    """One gate for each list of rules; the list is kept, so that its id stays its own."""
    if id(rules) not in _GATES:
        _GATES[id(rules)] = (rules, Gate(rules))
    return _GATES[id(rules)][1]


def outermost(hits: list[tuple]) -> list[tuple]:
    """Hits (-priority, -length, rule, start, end, label) in their order, without those inside a hit kept before them. The
    furthest end of the kept hits up to a start is asked of a tree of running maxima, so n hits take n log n steps."""
    if len(hits) < 2:
        return hits
    place = {s: i for i, s in enumerate(sorted({h[3] for h in hits}), 1)}
    furthest, kept = [-1] * (len(place) + 1), []
    for h in sorted(hits):
        i = at = place[h[3]]
        end = -1
        while i:
            end = max(end, furthest[i])
            i &= i - 1
        if end < h[4]:
            kept.append(h)
            while at < len(furthest):
                furthest[at] = max(furthest[at], h[4])
                at += at & -at
    return kept


def scan_text(text: str | None, rules) -> tuple[int, list[tuple[int, int, str, int]], list[int], list[str]]:
    """Words, kept detections (first word, end word, label, priority), base starts and base labels."""
    words = alnum_words(text)
    norm = b" " + b" ".join(words) + b" "
    starts, base = [], []
    for phrase, label in BASE:
        key, at = b" " + phrase.encode() + b" ", -1
        while (at := norm.find(key, at + 1)) >= 0:
            starts.append(at + 1)
            base.append(label)
    hits = []
    for n in _gate(rules).open_to(norm):
        label, rx, _, priority = rules[n]
        hits += [(-priority, m.start() - m.end(), n, m.start(), m.end(), label) for m in rx.finditer(norm)]
    if not starts and not hits:
        return len(words), [], [], []
    kept = outermost(hits)
    # word numbers of byte places: how many spaces stand before them
    spaces = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    index = lambda at: (np.searchsorted(spaces, np.array(at, np.int64)) - 1).tolist()
    first, last = index([h[3] for h in kept]), index([h[4] for h in kept])
    return len(words), [(a, b, h[5], -h[0]) for a, b, h in zip(first, last, kept, strict=True)], index(starts), base


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections (word intervals)."""

    def make():
        if not _RULES:
            _RULES.extend(build_rules())

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            cols = [[] for _ in range(8)]
            for t in part.column(1).to_pylist():
                n, kept, starts, base = scan_text(t, _RULES)
                score = max([0.5 * bool(base), *(p / 100 for *_, p in kept)])
                row = (
                    n, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(set(base))),
                    ",".join(sorted({*base, *(x[2] for x in kept)})), float(score), [f"{a}:{b}:{x}" for a, b, x, _ in sorted(kept)],
                )
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.string())]
            return pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, cols, kinds)], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"])

        return step

    df = docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text_col}` text")
    return df.mapInArrow(
        over_slices(make, 1),
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<string>",
    )
