"""Hand-written signatures of license texts, file headers, notices and grants: sentences by which a license is known
where its name does not stand. One a line: label, expression over lower-case words with one space between them."""

from __future__ import annotations

TEXT = r"""
mit | permission is hereby granted free of charge to any person obtaining a copy
mit | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
mit | in no event shall the authors or copyright holders be liable for any claim damages or other liability
mit-0 | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software
mit | use of this source code is governed by an mit style licen[cs]e
x11 | except as contained in this notice the name of the x consortium shall not be used in advertising
hpnd | permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted
isc | permission to use copy modify and or distribute this software for any purpose
isc | the software is provided as is and (?:the author|isc) disclaims all warranties with regard to this software
0bsd | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software
bsd | redistribution and use in source and binary forms
bsd | redistributions of source code must retain the above copyright notice
bsd | redistributions in binary form must reproduce the above copyright notice
bsd | this software is provided by the (?:copyright holders and contributors|regents and contributors|authors?) as is
bsd-3-clause | neither the names? of (?:the copyright holders?|the author|the university|the project) nor the names of (?:its|their) contributors may be used to endorse
bsd-4-clause | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd | use of this source code is governed by a bsd style licen[cs]e
bsd-2-clause | the views and conclusions contained in the software and documentation are those of the authors
apache-2.0 | you may not use this file except in compliance with the license you may obtain a copy of the license at
apache-2.0 | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2.0 | licensed to the apache software foundation asf under one or more contributor license agreements
apache-2.0 | the asf licenses this file to you under the apache license
apache-2.0 | see the license for the specific language governing permissions and limitations under the license
apache-2.0 | terms and conditions for use reproduction and distribution
apache-1.1 | this product includes software developed by the apache software foundation
gpl | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl-2.0 | as published by the free software foundation either version 2 of the license or
gpl-3.0 | as published by the free software foundation either version 3 of the license or
gpl-2.0-only | it under the terms of the gnu general public license version 2 as published by the free software foundation
gpl | this program is distributed in the hope that it will be useful but without any warranty
gpl | you should have received a copy of the gnu general public license along with this program
gpl | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
gpl | the licenses for most software are designed to take away your freedom to share and change it
gpl-3.0 | the gnu general public license is a free copyleft license for software and other kinds of works
gpl | this is free software and you are welcome to redistribute it under certain conditions
gpl-linking-exception | linking this library statically or dynamically with other modules is making a combined work based on this library
gpl-classpath-exception | as a special exception the copyright holders of this library give you permission to link this library with independent modules
lgpl | this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
lgpl-2.1 | as published by the free software foundation either version 2 1 of the license or
lgpl | you should have received a copy of the gnu (?:lesser|library) general public license along with this (?:library|program)
lgpl | this library is distributed in the hope that it will be useful but without any warranty
lgpl-3.0 | this version of the gnu lesser general public license incorporates the terms and conditions of version 3
agpl | it under the terms of the gnu affero general public license
agpl-3.0 | you should have received a copy of the gnu affero general public license along with this program
agpl-3.0 | the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software
gfdl | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl | with no invariant sections no front cover texts and no back cover texts
mpl-2.0 | this source code form is subject to the terms of the mozilla public license
mpl-2.0 | if a copy of the mpl was not distributed with this file you can obtain one at
mpl-1.1 | the contents of this file are subject to the mozilla public license version 1 1
mpl-2.0 | this source code form is incompatible with secondary licenses as defined by the mozilla public license
epl | this program and the accompanying materials are made available under the terms of the eclipse public license
epl-1.0 | the accompanying program is provided under the terms of this eclipse public license agreement
edl-1.0 | the eclipse distribution license is available at
cddl | the contents of this file are subject to the terms of the common development and distribution license
cddl | you can obtain a copy of the license at usr src opensolaris license
cpl | the accompanying program is provided under the terms of this common public license agreement
cpal-1.0 | the contents of this file are subject to the common public attribution license
ipl | the accompanying program is provided under the terms of this ibm public license
artistic | the intent of this document is to state the conditions under which a package may be copied
artistic | you can redistribute it and or modify it under the same terms as perl itself
artistic-2.0 | this license establishes the terms under which a given free software package may be copied modified distributed
zlib | this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib | the origin of this software must not be misrepresented
zlib | altered source versions must be plainly marked as such
libpng | the png reference library is supplied as is
boost-1.0 | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
boost-1.0 | distributed under the boost software license version 1 0
unlicense | this is free and unencumbered software released into the public domain
unlicense | anyone is free to copy modify publish use compile sell or distribute this software
unlicense | we make this dedication for the benefit of the public at large
wtfpl | everyone is permitted to copy and distribute verbatim or modified copies of this license document
wtfpl | you just do what the fuck you want to
cc0 | the person who associated a work with this deed has dedicated the work to the public domain
cc0 | to the extent possible under law (?:the author|the authors|i|we) (?:has|have) waived all copyright
cc0 | affirmer hereby overtly fully permanently irrevocably and unconditionally waives
cc-by | you are free to share copy and redistribute the material in any medium or format
cc-by | you must give appropriate credit provide a link to the license and indicate if changes were made
cc-by-sa | you must distribute your contributions under the same license as the original
cc-by-nc | you may not use the material for commercial purposes
cc-by-nd | you may not distribute the modified material
cc | this work is licensed under a creative commons
cc | the work as defined below is provided under the terms of this creative commons public license
odbl-1.0 | any rights in individual contents of the database are licensed under the database contents license
odbl-1.0 | this (?:database|data) is made available under the open database license
odc-by-1.0 | this (?:database|data) is made available under the open data commons attribution license
pddl-1.0 | the public domain dedication and license is a document intended to allow you to freely share
psf-2.0 | this license agreement is between the python software foundation psf and the individual or organization
psf-2.0 | psf is making python available to licensee on an as is basis
php | this product includes php software freely available from
ruby | you may make and give away verbatim copies of the source form of the software without restriction
openssl | this product includes software developed by the openssl project for use in the openssl toolkit
ssleay | this product includes cryptographic software written by eric young
postgresql | in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages
ncsa | developed by (?:llvm team|computing group) university of illinois at urbana champaign
ncsa | to deal with the software without restriction including without limitation the rights
osl-3.0 | this open software license the license applies to any original work of authorship
osl-3.0 | licensed under the open software license version 3 0
afl-3.0 | this academic free license the license applies to any original work of authorship
ofl-1.1 | this font software is licensed under the sil open font license version 1 1
ofl | the goals of the open font license ofl are to stimulate worldwide development of collaborative font projects
ofl | the fonts including any derivative works can be bundled embedded redistributed and or sold with any software
ecl-2.0 | licensed under the educational community license version 2 0
ms-pl | this license governs use of the accompanying software if you use the software you accept this license
upl-1.0 | subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software associated documentation and or data
vim | there are no restrictions on distributing unmodified copies of vim
w3c | by obtaining and or copying this work you the licensee agree that you have read understood and will comply with the following terms
bsl | the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
bsl | use of the licensed work in violation of this license will automatically terminate your rights
sspl-1.0 | if you make the functionality of the program or a modified version available to third parties as a service
elastic-2.0 | you may not provide the software to third parties as a hosted or managed service
elastic-2.0 | you may not move change disable or circumvent the license key functionality in the software
commons-clause | the license does not grant to you the right to sell the software
prosperity | this license lets you use and share this software for free with a trial for commercial use
polyform | any noncommercial purpose is a permitted purpose
eupl | licensed under the eupl
eupl | this european union public licence the eupl applies to the work
cecill | this software is governed by the cecill(?: [bc])? license under french law
beerware | as long as you retain this notice you can do whatever you want with this stuff
beerware | if we meet some day and you think this stuff is worth it you can buy me a beer
json | the software shall be used for good not evil
curl | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
unicode | unicode data files include all data files under the directories
tcl | the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose
ntp | permission to use copy modify and distribute this software and its documentation for any purpose with or without fee
openldap | the openldap public license version 2
sleepycat | redistributions in any form must be accompanied by information on how to obtain complete source code
qpl | this license applies to any software containing a notice placed by the copyright holder saying that it may be distributed under the terms of the q public license
lppl | this work may be distributed and or modified under the conditions of the latex project public license
latex | this work has the lppl maintenance status
gust-font | this work is released under the gust font license
bitstream-vera | permission is hereby granted free of charge to any person obtaining a copy of the fonts accompanying this license
ubuntu-font | this licence allows the licensed fonts to be used studied modified and redistributed freely
rpl | this reciprocal public license version
apsl | this file contains original code and or modifications of original code as defined in and that are subject to the apple public source license
nasa | this open source agreement this agreement defines the rights of use reproduction distribution modification and redistribution
us-government | this (?:software|work) (?:is|was) (?:a work|prepared) (?:of|by) the (?:u s|united states) government
us-government | not subject to copyright protection and is in the public domain
crown | contains public sector information licensed under the open government licen[cs]e
ogl | you may use and re use the information featured (?:on|in) this (?:website|document) free of charge in any format
etalab | licence ouverte open licence
rail | use based restrictions as referenced in paragraph 5 must be included as an enforceable provision
openrail | the creativeml open rail m license
llama | built with (?:meta )?llama
gemma | is provided under and subject to the gemma terms of use
proprietary | unauthorized copying of this file via any medium is strictly prohibited
proprietary | this software is the confidential and proprietary information of
proprietary | you shall not disclose such confidential information
proprietary | by installing copying or otherwise using the software you agree to be bound by the terms
shareware | this is not free software you may evaluate it for
freeware | this software is freeware and may be distributed freely
evaluation | for evaluation purposes only
dual | this (?:software|file|project) is dual licen[cs]ed
dual | licensed under either of
or-later | at your option any later version
third-party | this (?:software|product) (?:contains|includes) third party (?:software|components|code)
attribution | this (?:article|page|text) is available under the creative commons attribution
stackoverflow | user contributions licensed under cc by sa
wikipedia | text is available under the creative commons attribution share ?alike licen[cs]e
press | reprinted (?:by|with) permission
press | this material may not be published broadcast rewritten or redistributed
press | no part of this (?:publication|book|document) may be reproduced
"""


def signatures() -> list[tuple[str, str]]:
    """(label, expression) in the order above."""
    return [tuple(line.split(" | ")) for line in TEXT.strip().splitlines()]
