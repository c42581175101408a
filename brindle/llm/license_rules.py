"""Signature rules of license texts, grants, notices and hints: priority, label, regular expression.

An expression matches whole words, lower-cased and joined by single spaces. Priorities: 0 identifiers,
1 grants with a version, 2 grants and license texts, 3 names and notices, 4 hints. In order: of equal
detections the first rule's stays. Each holds a word that all its matches hold, by which it is looked
up (word_of), and a stem of licenses.STEMS.
"""

from __future__ import annotations

import re

#: Written one by one, from the texts that licenses give as their notices.
HAND_WRITTEN = (
    # permissive texts
    (2, "mit", "permission is hereby granted free of charge to any person obtaining a copy(?: of this software)?"),
    (2, "mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell"),
    (2, "mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    (2, "mit", "this permission notice shall be included in all copies"),
    (2, "mit-0", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software"),
    (2, "x11", "the name of the x consortium shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization(?: from the x consortium)?"),
    (3, "x11", "x consortium licen[sc]e"),
    (2, "isc", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    (2, "isc", "provided that the above copyright notice and this permission notice appear in all copies"),
    (2, "0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    (2, "hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    (2, "hpnd", "that both that copyright notice and this permission notice appear in supporting documentation"),
    (2, "ntp", "permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted"),
    (2, "postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    (2, "python-cnri", "cnri grants licensee a nonexclusive royalty free world ?wide licen[sc]e"),
    (2, "psf", "psf is making python available to licensee on an as is basis"),
    (2, "psf", "python software foundation licen[sc]e agreement"),
    (2, "psf", "beopen python open source licen[sc]e agreement"),
    (2, "tcl", "the authors hereby grant permission to use copy modify distribute and licen[sc]e this software"),
    (2, "curl", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    (2, "smlnj", "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted provided that the above copyright notice appear in all copies"),
    (2, "ijg", "permission is hereby granted to use copy modify and distribute this software or portions thereof for any purpose without fee"),
    (2, "ijg", "this software is based in part on the work of the independent jpeg group"),
    (2, "libtiff", "permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee"),
    (2, "libpng", "this copy of the libpng notices is provided for your convenience"),
    (2, "libpng", "the png reference library is supplied as is the contributing authors and group 42 inc disclaim all warranties"),
    (2, "zlib", "permission is granted to anyone to use this software for any purpose(?: including commercial applications)?"),
    (2, "zlib", "the origin of this software must not be misrepresented"),
    (2, "zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    (2, "bsl", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    (2, "bsl", "distributed under the boost software licen[sc]e"),
    (2, "bsl", "see accompanying file licen[sc]e 1 0 txt"),
    (2, "ncsa", "to deal with the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense"),
    (2, "ncsa", "neither the names of .{1,80} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    (2, "unicode", "permission is hereby granted free of charge to any person obtaining a copy of the unicode data files"),
    (2, "unicode", "unicode inc licen[sc]e agreement(?: data files and software)?"),
    (3, "unicode", "unicode licen[sc]e(?: v3)?"),
    (2, "icu", "icu licen[sc]e icu 1 8 1 and later"),
    (2, "bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    (2, "bsd", "redistributions of source code must retain the above copyright notice"),
    (2, "bsd", "redistributions in binary form must reproduce the above copyright notice"),
    (2, "bsd-3-clause", "neither the name of (?:the )?(?:[^ ]+ ){1,8}nor the names of (?:its|the|his|their) contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    (2, "bsd-3-clause", "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission"),
    (2, "bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment"),
    (2, "bsd-clear", "no express or implied licen[sc]es to any party s patent rights are granted by this licen[sc]e"),
    (2, "bsd-patent", "each copyright holder and contributor hereby grants to those receiving rights under this licen[sc]e a perpetual worldwide non exclusive"),
    (3, "bsd", "berkeley software distribution licen[sc]e"),
    (3, "bsd", "bsd style licen[sc]e"),
    (3, "bsd-2-clause", "simplified bsd licen[sc]e"),
    (3, "bsd-3-clause", "(?:new|revised|modified) bsd licen[sc]e"),
    (3, "bsd-4-clause", "original bsd licen[sc]e"),
    (3, "bsd", "governed by a bsd style licen[sc]e that can be found in the licen[sc]e file"),
    (2, "beerware", "the beer ware licen[sc]e(?: revision 42)?"),
    (2, "wtfpl", "do what the fuck you want to public licen[sc]e"),
    (2, "unlicense", "this is free and unencumbered software released into the public domain"),
    (2, "unlicense", "anyone is free to copy modify publish use compile sell or distribute this software"),
    (2, "json", "the software shall be used for good not evil"),
    (2, "afl", "licensed under the academic free licen[sc]e(?: version [0-9](?: [0-9])?)?"),
    (2, "osl", "licensed under the open software licen[sc]e(?: version [0-9](?: [0-9])?)?"),
    (2, "ecl", "licensed under the educational community licen[sc]e(?: version [0-9](?: [0-9])?)?"),
    (2, "openssl", "this product includes software developed by the openssl project for use in the openssl toolkit(?: https? www openssl org)?"),
    (2, "ssleay", "this product includes cryptographic software written by eric young"),
    (2, "ssleay", "this library is free for commercial and non commercial use as long as the following conditions are aheared to"),
    (2, "php", "this product includes php software freely available from"),
    (2, "php", "this source file is subject to version [0-9] [0-9]+ of the php licen[sc]e"),
    (2, "zend", "this source file is subject to version [0-9] [0-9]+ of the zend licen[sc]e"),
    (2, "ruby", "ruby is copyrighted free software by yukihiro matsumoto"),
    (3, "ruby", "same terms as ruby itself licen[sc]e"),
    (2, "perl", "this (?:library|program|module|package) is free software you can redistribute it and or modify it under the same terms as perl itself"),
    (2, "artistic", "the artistic licen[sc]e preamble"),
    (2, "artistic", "the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains"),
    (2, "artistic", "everyone is permitted to copy and distribute verbatim copies of this licen[sc]e document but changing it is not allowed preamble this licen[sc]e establishes the terms"),
    (2, "w3c", "by obtaining using and or copying this work you the licensee agree that you have read understood and will comply with the following terms"),
    (2, "w3c", "w3c software (?:notice and )?(?:document )?licen[sc]e"),
    (2, "vim", "vim is charityware"),
    (2, "vim", "there are no restrictions on distributing unmodified copies of vim except that they must include this licen[sc]e text"),
    (2, "lppl", "this work may be distributed and or modified under the conditions of the latex project public licen[sc]e"),
    (2, "lppl", "this work has the lppl maintenance status (?:maintained|author maintained|unmaintained)"),
    (2, "blueoak", "this licen[sc]e gives everyone as much permission to work with this software as possible"),
    (2, "upl", "the universal permissive licen[sc]e(?: upl)?(?: version 1 0)?"),
    (2, "mulan", "mulan permissive software licen[sc]e(?: version 2)?"),
    (3, "mulan", "mulan psl v ?[12] licen[sc]e"),
    (2, "fair", "usage of the works is permitted provided that this instrument is retained with the works"),
    (2, "ftl", "the freetype project licen[sc]e"),
    (2, "ftl", "portions of this software are copyright (?:c )?(?:[^ ]+ ){1,4}the freetype project"),
    (2, "bzip2", "bzip2 and libbzip2 .{0,40}redistribution and use"),
    (2, "bitstream-vera", "bitstream vera (?:fonts )?(?:copyright|licen[sc]e)"),
    (2, "info-zip", "this is version [0-9 ]{4,12} of the info zip (?:copyright and )?licen[sc]e"),
    (2, "info-zip", "info zip licen[sc]e"),
    (2, "naumen", "naumen public licen[sc]e"),
    (2, "sleepycat", "redistributions in any form must be accompanied by information on how to obtain complete source code"),
    (2, "sgi-b", "sgi free software licen[sc]e b"),
    (2, "condor", "condor public licen[sc]e"),
    (2, "entessa", "entessa public licen[sc]e"),
    (2, "intel", "intel (?:simplified software|open source|acpi|sample source code) licen[sc]e"),
    (2, "nvidia", "nvidia (?:source code|software|open model) licen[sc]e"),
    (2, "openldap", "openldap public licen[sc]e"),
    (2, "plexus", "plexus classworlds licen[sc]e"),
    (2, "xnet", "x net licen[sc]e"),
    (2, "zed", "may be copied in any form without permission zed"),
    # Apache
    (1, "apache", "licensed under the apache licen[sc]e version 2 0(?: the licen[sc]e)?"),
    (2, "apache", "you may not use this file except in compliance with the licen[sc]e"),
    (2, "apache", "you may obtain a copy of the licen[sc]e at (?:https? )?www apache org licenses licen[sc]e 2 0"),
    (2, "apache", "unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis"),
    (2, "apache", "licensed to the apache software foundation asf under one or more contributor licen[sc]e agreements"),
    (2, "apache", "apache licen[sc]e version 2 0 january 2004"),
    (2, "apache", "this product includes software developed by the apache (?:software foundation|group)"),
    (3, "apache", "the apache software licen[sc]e version 1 [01]"),
    (3, "apache", "apache 2 (?:0 )?licen[sc]e"),
    (3, "apache", "asl 2 0 licen[sc]e"),
    # GNU
    (2, "gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e"),
    (1, "gpl", "gnu general public licen[sc]e as published by the free software foundation either version [0-9](?: [0-9])? of the licen[sc]e or at your option any later version"),
    (1, "gpl", "gnu general public licen[sc]e version [0-9](?: [0-9])?(?: as published by the free software foundation| only| or (?:any )?later)?"),
    (2, "gpl", "you should have received a copy of the gnu general public licen[sc]e along with"),
    (2, "gpl", "see the gnu general public licen[sc]e for more details"),
    (2, "gpl", "the licenses for most software are designed to take away your freedom to share and change it by contrast the gnu general public licen[sc]e"),
    (2, "gpl", "the gnu general public licen[sc]e is a free copyleft licen[sc]e for software and other kinds of works"),
    (2, "gpl", "may be (?:used|distributed|copied) under the terms of the gnu general public licen[sc]e"),
    (2, "gpl", "subject to the terms and conditions of the gnu general public licen[sc]e"),
    (3, "gpl", "gpl v ?[23](?: 0)?(?: or later)? licen[sc]e"),
    (3, "gpl", "gplv[23](?: or later)? licen[sc]e"),
    (3, "gpl", "licensed under (?:the )?(?:gnu )?gpl(?: ?v ?[23])?(?: or later)?"),
    (3, "gpl", "released under (?:the )?(?:gnu )?gpl(?: ?v ?[23])? licen[sc]e"),
    (4, "gpl", "gnu copyleft licen[sc]e"),
    (2, "classpath-exception", "linking this library statically or dynamically with other modules is making a combined work .{0,200}permission to link this library with independent modules"),
    (2, "classpath-exception", "the copyright holders of this library give you permission to link this library with independent modules"),
    (2, "gcc-exception", "gcc runtime library exception .{0,120}additional permissions"),
    (2, "autoconf-exception", "the free software foundation gives unlimited permission to copy distribute and modify(?: the)? (?:it|configure scripts?)"),
    (2, "autoconf-exception", "this file is free software the free software foundation gives unlimited permission to copy and or distribute it"),
    (2, "bison-exception", "as a special exception you may create a larger work that contains part or all of the bison parser skeleton .{0,200}licen[sc]e"),
    (2, "font-exception", "as a special exception if you create a document which uses this font .{0,200}licen[sc]e"),
    (2, "linux-syscall-note", "this copyright does not cover user programs that use kernel services by normal system calls"),
    (2, "lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[sc]e"),
    (2, "lgpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[sc]e"),
    (1, "lgpl", "gnu (?:lesser|library) general public licen[sc]e as published by the free software foundation either version [0-9](?: [0-9])? of the licen[sc]e or at your option any later version"),
    (1, "lgpl", "gnu (?:lesser|library) general public licen[sc]e version [0-9](?: [0-9])?"),
    (2, "lgpl", "you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e along with"),
    (2, "lgpl", "this licen[sc]e the lesser general public licen[sc]e applies to some specially designated software packages"),
    (3, "lgpl", "lgpl v ?[23](?: [01])?(?: or later)? licen[sc]e"),
    (3, "lgpl", "licensed under (?:the )?(?:gnu )?lgpl(?: ?v ?[23](?: [01])?)?"),
    (3, "lgpl", "lesser gpl licen[sc]e"),
    (2, "agpl", "under the terms of the gnu affero general public licen[sc]e"),
    (1, "agpl", "gnu affero general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e or at your option any later version"),
    (1, "agpl", "gnu affero general public licen[sc]e version 3(?: 0)?"),
    (2, "agpl", "you should have received a copy of the gnu affero general public licen[sc]e along with"),
    (2, "agpl", "the gnu affero general public licen[sc]e is a free copyleft licen[sc]e"),
    (3, "agpl", "licensed under (?:the )?(?:gnu )?agpl(?: ?v ?3)?"),
    (2, "fdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e"),
    (1, "fdl", "gnu free documentation licen[sc]e version 1 [0-9](?: or any later version)?"),
    (2, "fdl", "with no invariant sections no front cover texts and no back cover texts .{0,80}licen[sc]e"),
    (2, "fsfap", "copying and distribution of this file with or without modification are permitted in any medium without royalty"),
    (2, "fsful", "this configure script is free software the free software foundation gives unlimited permission"),
    (3, "dual", "dual(?:ly)? licensed under (?:the )?(?:[^ ]+ ){1,6}(?:and|or)"),
    (3, "dual", "dual licen[sc]e mit gpl"),
    # weak copyleft
    (2, "mpl", "subject to the terms of the mozilla public licen[sc]e(?: v(?:ersion)? [0-9] [0-9])?"),
    (2, "mpl", "if a copy of the mpl was not distributed with this file you can obtain one at .{0,40}"),
    (2, "mpl", "the contents of this file are subject to the mozilla public licen[sc]e(?: version [0-9] [0-9])?"),
    (2, "mpl", "the initial developer of the original code is .{1,80}copyright"),
    (2, "mpl", "this source code form is incompatible with secondary licenses as defined by the mozilla public licen[sc]e"),
    (2, "npl", "the contents of this file are subject to the netscape public licen[sc]e"),
    (2, "cddl", "the contents of this file are subject to the terms of the common development and distribution licen[sc]e"),
    (2, "cddl", "when distributing covered code include this cddl header notice in each file"),
    (2, "epl", "this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e(?: v(?:ersion)? ?[12](?: 0)?)?"),
    (2, "epl", "available under the terms of the eclipse public licen[sc]e"),
    (2, "edl", "eclipse distribution licen[sc]e(?: v(?:ersion)? ?1 0)?"),
    (2, "cpl", "the accompanying program is provided under the terms of this common public licen[sc]e"),
    (2, "ipl", "the accompanying program is provided under the terms of this ibm public licen[sc]e"),
    (2, "eupl", "licensed under the eupl(?: version)? 1 [0-9](?: or later)?"),
    (2, "eupl", "european union public licen[sc]e v ?1 [0-9]"),
    (2, "apsl", "this file contains original code and or modifications of original code as defined in and that are subject to the apple public source licen[sc]e"),
    (2, "spl", "sun public licen[sc]e(?: version 1 0)?"),
    (2, "sissl", "sun industry standards source licen[sc]e"),
    (2, "ms-pl", "this licen[sc]e governs use of the accompanying software if you use the software you accept this licen[sc]e"),
    (2, "ms-rl", "reciprocal grants for any file you distribute that contains code from the software .{0,120}licen[sc]e"),
    (2, "qpl", "this software may be distributed under the terms of the q public licen[sc]e"),
    (2, "rpl", "reciprocal public licen[sc]e(?: 1 [15])?"),
    (2, "cecill", "licen[sc]e cecill(?: [bc])?"),
    (2, "cecill", "ce logiciel est regi par la licen[sc]e cecill(?: [bc])?"),
    (2, "cecill", "this software is governed by the cecill (?:[bc] )?licen[sc]e"),
    (2, "erlang", "the contents of this file are subject to the erlang public licen[sc]e"),
    (2, "motosoto", "motosoto open source licen[sc]e"),
    (2, "nokia", "nokia open source licen[sc]e"),
    (2, "oclc", "oclc research public licen[sc]e"),
    (2, "watcom", "sybase open watcom public licen[sc]e"),
    (2, "ricoh", "ricoh source code public licen[sc]e"),
    (2, "vovida", "vovida software licen[sc]e"),
    (2, "cua", "cua office public licen[sc]e"),
    (2, "frameworx", "frameworx open licen[sc]e"),
    (2, "lucent", "lucent public licen[sc]e"),
    (2, "realnetworks", "realnetworks public source licen[sc]e"),
    # content and data
    (2, "cc0", "to the extent possible under law (?:the person who associated cc0 with this work|the authors?|[^ ]+ [^ ]+) (?:has|have) waived all copyright and related or neighboring rights"),
    (2, "cc0", "the person who associated a work with this deed has dedicated the work to the public domain"),
    (2, "cc0", "cc0 public domain dedication"),
    (2, "cc-by", "this work is licensed under a creative commons attribution (?:[1-4] 0 )?(?:international |unported |generic )?licen[sc]e"),
    (2, "cc-by-sa", "this work is licensed under a creative commons attribution share ?alike (?:[1-4] 0 )?(?:international |unported |generic )?licen[sc]e"),
    (2, "cc-by-nc", "this work is licensed under a creative commons attribution non ?commercial (?:[1-4] 0 )?(?:international |unported |generic )?licen[sc]e"),
    (2, "cc-by-nd", "this work is licensed under a creative commons attribution no ?deriv(?:ative)?s (?:[1-4] 0 )?(?:international |unported |generic )?licen[sc]e"),
    (2, "cc-by-nc-sa", "creative commons attribution non ?commercial share ?alike (?:[1-4] 0 )?(?:international |unported |generic )?licen[sc]e"),
    (2, "cc-by-nc-nd", "creative commons attribution non ?commercial no ?deriv(?:ative)?s (?:[1-4] 0 )?(?:international |unported |generic )?licen[sc]e"),
    (1, "cc-by", "licensed under (?:a |the )?cc by [1-4] 0"),
    (1, "cc-by-sa", "licensed under (?:a |the )?cc by sa [1-4] 0"),
    (1, "cc-by-nc", "licensed under (?:a |the )?cc by nc [1-4] 0"),
    (1, "cc-by-nd", "licensed under (?:a |the )?cc by nd [1-4] 0"),
    (1, "cc-by-nc-sa", "licensed under (?:a |the )?cc by nc sa [1-4] 0"),
    (1, "cc-by-nc-nd", "licensed under (?:a |the )?cc by nc nd [1-4] 0"),
    (2, "cc-by", "creativecommons org licenses by [1-4] 0"),
    (2, "cc-by-sa", "creativecommons org licenses by sa [1-4] 0"),
    (2, "cc-by-nc", "creativecommons org licenses by nc [1-4] 0"),
    (2, "cc-by-nd", "creativecommons org licenses by nd [1-4] 0"),
    (2, "cc-by-nc-sa", "creativecommons org licenses by nc sa [1-4] 0"),
    (2, "cc-by-nc-nd", "creativecommons org licenses by nc nd [1-4] 0"),
    (3, "cc", "creative commons licen[sc]e"),
    (3, "cc", "some rights reserved"),
    (2, "odbl", "made available under the open database licen[sc]e"),
    (2, "odc-by", "open data commons attribution licen[sc]e"),
    (2, "pddl", "(?:open data commons )?public domain dedication and licen[sc]e"),
    (2, "ogl", "open government licen[sc]e(?: v(?:ersion)? ?[123](?: 0)?)?"),
    (2, "ofl", "this font software is licensed under the sil open font licen[sc]e(?: version 1 [01])?"),
    (2, "ofl", "the goals of the open font licen[sc]e ofl are to stimulate worldwide development"),
    (2, "cdla", "community data licen[sc]e agreement(?: permissive| sharing)?"),
    (2, "gutenberg", "project gutenberg licen[sc]e"),
    (2, "open-rail", "(?:bigscience|creativeml) (?:open )?rail(?: [sm]){0,2} licen[sc]e"),
    (2, "llama", "llama [23](?: [0-9])? community licen[sc]e agreement"),
    (2, "gemma", "gemma is provided under and subject to the gemma terms of use .{0,60}licen[sc]e"),
    # source available and proprietary
    (2, "busl", "business source licen[sc]e 1 1"),
    (2, "busl", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    (2, "sspl", "server side public licen[sc]e(?: version 1)?"),
    (2, "elastic", "elastic licen[sc]e(?: 2 0| version 2(?: 0)?)?"),
    (2, "confluent", "confluent community licen[sc]e(?: agreement)?"),
    (2, "timescale", "timescale licen[sc]e"),
    (2, "redis", "redis source available licen[sc]e"),
    (2, "commons-clause", "commons clause licen[sc]e condition"),
    (2, "polyform", "polyform (?:noncommercial|small business|shield|strict|perimeter|free trial|internal use) licen[sc]e"),
    (2, "fsl", "functional source licen[sc]e"),
    (2, "jrl", "java research licen[sc]e"),
    (2, "bcl", "binary code licen[sc]e agreement"),
    (2, "proprietary", "end user licen[sc]e agreement"),
    (2, "proprietary", "unauthorized copying of this file via any medium is strictly prohibited"),
    (2, "proprietary", "this software is the confidential and proprietary information of .{1,80}licen[sc]e agreement"),
    (2, "proprietary", "no part of this (?:publication|work|document|file|software) may be reproduced .{0,160}without (?:the )?(?:prior )?(?:express )?written permission"),
    (3, "proprietary", "all rights reserved proprietary and confidential"),
    (4, "proprietary", "proprietary(?: and confidential)? licen[sc]e"),
    (4, "proprietary", "licensed for internal use only"),
    (4, "proprietary", "commercial licen[sc]e"),
    (4, "non-commercial", "licensed for non ?commercial use(?: only)?"),
    # notices and hints
    (2, "public-domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    (2, "public-domain", "this (?:file|code|work|software|program) is (?:hereby )?(?:in the )?public domain"),
    (3, "public-domain", "no copyright is claimed"),
    (3, "public-domain", "public domain"),
    (3, "all-rights-reserved", "all rights reserved"),
    (4, "copyright", "copyright(?: c)?(?: [12][0-9]{3}){1,2}"),
    (4, "copyright", "copyright notice"),
    (4, "copyright", "copyright holders?"),
    (4, "warranty-disclaimer", "without warranty of any kind(?: express or implied)?"),
    (4, "warranty-disclaimer", "without warranties or conditions of any kind(?: either express or implied)?"),
    (4, "warranty-disclaimer", "without any warranty"),
    (4, "warranty-disclaimer", "there is no warranty for the program"),
    (4, "warranty-disclaimer", "comes with absolutely no warranty"),
    (4, "warranty-disclaimer", "(?:any |the )?implied warrant(?:y|ies) of merchantability(?: and| or)? ?(?:fitness for a particular purpose)?"),
    (4, "warranty-disclaimer", "provided as is without (?:any )?(?:express or implied )?warrant(?:y|ies)"),
    (4, "license-reference", "see (?:the )?copying(?: file| txt| md)? for (?:more )?(?:details|information)"),
    (4, "license-reference", "see (?:the )?licen[sc]e(?: file| txt| md)? for (?:more )?(?:details|information)"),
    (4, "license-reference", "for (?:the )?full copyright and licen[sc]e information please (?:view|see) the licen[sc]e file"),
    (4, "license-reference", "can be found in the licen[sc]e file"),
    (4, "license-reference", "see licen[sc]e file in the project root"),
    (4, "license-reference", "third party licenses"),
    (4, "license-reference", "open source licen[sc]e"),
)

#: label, names (a regular expression), tag (as in identifiers, words by spaces)
FAMILIES = (
    ("0bsd", "zero clause bsd|bsd zero clause|0bsd", "0bsd"),
    ("aal", "attribution assurance", "aal"),
    ("afl", "academic free", "afl [0-9](?: [0-9])?"),
    ("agpl", "(?:gnu )?affero general public|gnu agpl", "agpl [0-9](?: [0-9])?(?: only| or later)?"),
    ("apache", "apache(?: software)?", "apache [0-9](?: [0-9])?"),
    ("apsl", "apple public source", "apsl [0-9](?: [0-9])?"),
    ("artistic", "(?:perl )?(?:clarified )?artistic", "artistic [0-9](?: [0-9])?"),
    ("blueoak", "blue oak model", "blueoak 1 0 0"),
    ("bsd", "(?:(?:new|modified|simplified|revised|original|2 clause|3 clause|4 clause|two clause|three clause|four clause) )?(?:free)?bsd", "bsd [0-9] clause(?: patent| clear)?"),
    ("bsl", "boost(?: software)?", "bsl 1 0"),
    ("busl", "business source", "busl 1 [01]"),
    ("cc0", "(?:creative commons )?cc0(?: 1 0)?(?: universal)?", "cc0 1 0"),
    ("cc-by", "creative commons attribution|cc by", "cc by [0-9] [0-9]"),
    ("cc-by-nc", "(?:creative commons|cc)(?: by| attribution)? non ?commercial|cc by nc", "cc by nc [0-9] [0-9]"),
    ("cc-by-nd", "creative commons attribution no ?deriv(?:ative)?s|cc by nd", "cc by nd [0-9] [0-9]"),
    ("cc-by-sa", "creative commons attribution share ?alike|cc by sa", "cc by sa [0-9] [0-9]"),
    ("cddl", "common development and distribution|cddl", "cddl 1 [01]"),
    ("cecill", "cecill(?: b| c)?", "cecill [0-9] [0-9]"),
    ("cpl", "common public", "cpl 1 0"),
    ("ecl", "educational community", "ecl [0-9] [0-9]"),
    ("efl", "eiffel forum", "efl [0-9] [0-9]"),
    ("epl", "eclipse public", "epl [0-9] [0-9]"),
    ("eupl", "european union public", "eupl 1 [0-9]"),
    ("fdl", "(?:gnu )?free documentation|gfdl", "gfdl 1 [0-9](?: only| or later)?"),
    ("gpl", "(?:gnu )?general public|gnu gpl", "gpl [0-9](?: [0-9])?(?: only| or later)?"),
    ("hpnd", "historical permission notice and disclaimer", "hpnd"),
    ("ijg", "independent jpeg group", "ijg"),
    ("ipl", "ibm public", "ipl 1 0"),
    ("isc", "isc|internet (?:systems|software) consortium", "isc"),
    ("lgpl", "(?:gnu )?(?:lesser|library) general public|gnu lgpl", "lgpl [0-9](?: [0-9])?(?: only| or later)?"),
    ("lppl", "latex project public", "lppl 1 [0-9]c?"),
    ("mit", "mit|expat|x11|mit x11", "mit(?: 0)?"),
    ("mpl", "mozilla public|mpl", "mpl [0-9](?: [0-9])?"),
    ("ms-pl", "microsoft public", "ms pl"),
    ("ms-rl", "microsoft reciprocal", "ms rl"),
    ("ncsa", "university of illinois(?: ncsa)?(?: open source)?", "ncsa"),
    ("npl", "netscape public", "npl 1 [01]"),
    ("odbl", "open (?:data commons )?database", "odbl 1 0"),
    ("ofl", "(?:sil )?open font", "ofl 1 [01]"),
    ("openssl", "openssl(?: project)?", "openssl"),
    ("osl", "open software", "osl [0-9] [0-9]"),
    ("php", "php", "php 3 0 ?1?"),
    ("postgresql", "postgresql", "postgresql"),
    ("psf", "python software foundation|psf", "psf 2 0"),
    ("qpl", "q public", "qpl 1 0"),
    ("ruby", "ruby", "ruby"),
    ("sleepycat", "sleepycat", "sleepycat"),
    ("sspl", "server side public", "sspl 1 0"),
    ("unlicense", "the unlicense|unlicense", "unlicense"),
    ("vim", "vim", "vim"),
    ("w3c", "w3c(?: software)?", "w3c"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("zlib", "zlib(?: libpng)?|libpng", "zlib"),
    ("zpl", "zope public", "zpl [0-9] [0-9]"),
)

#: priority and, with {names} and {tag}, the regular expressions that each family gives
TEMPLATES = (
    (0, "spdx license identifier (?:{tag})"),
    (1, "(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?(?:{names}) licen[sc]e v(?:ersion)? ?[0-9]+(?: [0-9]+)*(?: or (?:any )?later(?: version)?| only)?"),
    (2, "(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?(?:{names}) licen[sc]e"),
    (2, "(?:{names}) licen[sc]e v(?:ersion)? ?[0-9]+(?: [0-9]+)*(?: or (?:any )?later(?: version)?| only)?"),
    (3, "(?:{names}) licen[sc]e"),
    (3, "licen[sc]e (?:{names}|{tag})"),
)


def _alternatives(names: str) -> list[str]:
    """The parts of a regular expression between the | outside all groups."""
    out, depth = [""], 0
    for c in names:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def literal(rx: str) -> str:
    """What all matches of rx hold, in order, with "\\0" for anything else; license stands for both spellings."""
    plain = rx.replace("licen[sc]e", "license")

    def gap(group: re.Match) -> str:
        parts = group[1].split("|")
        return " " * all(x.startswith(" ") for x in parts) + "\0" + " " * all(x.endswith(" ") for x in parts)

    while (shorter := re.sub(r"\(\?:([^()]*)\)(?:[?]|\{[0-9,]*\})?", gap, plain)) != plain:
        plain = shorter
    return re.sub(r"\[[^]]*\][?+*]?(?:\{[0-9,]*\})?|.[?]|\.(?:\{[0-9,]*\}|[*+])?", "\0", plain)


def words_of(rx: str) -> tuple[str, ...]:
    """Words of which each match of rx holds one: the longest that all matches hold, or else both spellings of license.

    Of groups, classes and what may be absent nothing counts.
    """
    plain = literal(rx)
    whole = [w for w in plain.split(" ") if re.fullmatch("[a-z0-9]+", w) and w != "license"]
    best = max(whole, key=lambda w: (w not in COMMON, len(w)), default="")
    if best and best not in COMMON:
        return (best,)
    if "license" in plain.split(" "):
        return ("licence", "license")
    raise ValueError(f"no word is in all matches of {rx}")


#: Words that would gate too little.
COMMON = frozenset("a and any are as at be by can for from has have if in is it its no not of on only or the this to under use with you your file work text version free software program public open source code document terms copy all found".split())


def rules() -> list[tuple[int, tuple[str, ...], str, str]]:
    """(priority, words, regular expression, label), in order: hand-written ones, then each template for each family, by name where names decide its word."""
    out = [(p, words_of(rx), rx, label) for p, label, rx in HAND_WRITTEN]
    for p, template in TEMPLATES:
        fixed = ("identifier",) if p == 0 else ("licence", "license") if template.startswith("licen") else None
        for label, names, tag in FAMILIES:
            for n in [names] if fixed else _alternatives(names):
                rx = template.format(names=n, tag=tag)
                out.append((p, fixed or words_of(rx), rx, label))
    return [(p, words, f"(?<= )(?:{rx})(?= )", label) for p, words, rx, label in out]
