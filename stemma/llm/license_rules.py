"""Signature rules of the license scan, written by hand, the most particular first.

A line is: label; keyword (a word of every match); weight; words. In words, (a|b c) are alternatives and ? makes what
stands before it optional; ... stands for up to 12 words. Words are lower-cased runs of letters and digits: "GPL-3.0+" is "gpl 3 0".
"""

from __future__ import annotations

RULES = """
mit; hereby; 0.95; permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit; restriction; 0.8; to deal in the software without restriction
mit; noninfringement; 0.7; the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
mit; portions; 0.8; the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
x11; consortium; 0.9; the name of the x consortium shall not be used in advertising
x11; authorization; 0.7; to promote the sale use or other dealings in this software without prior written authorization
isc; permission; 0.95; permission to use copy modify and or? distribute this software for any purpose with or without fee is hereby granted provided that
0bsd; permission; 0.9; permission to use copy modify and or? distribute this software for any purpose with or without fee is hereby granted
isc; disclaims; 0.7; the author disclaims all warranties with regard to this software
hpnd; permission; 0.9; permission to use copy modify (and distribute|distribute and sell) this software and its documentation for any purpose
postgresql; agreement; 0.9; without fee and without a written agreement is hereby granted
ntp; permission; 0.85; permission to use copy modify and distribute this software and its documentation for any purpose with or without fee
bsd; redistribution; 0.8; redistribution and use in source and binary forms with or without modification are permitted
bsd-2-clause; redistributions; 0.75; redistributions in binary form must reproduce the above copyright notice
bsd-3-clause; endorse; 0.9; neither the (name|names) of ... may be used to endorse or promote products derived from this software
bsd-3-clause; endorse; 0.85; may be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause; advertising; 0.9; all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd; consequential; 0.6; in no event shall the copyright (holder|holders|owner) or contributors be liable for any direct indirect incidental special exemplary or consequential damages
apache-2; apache; 0.95; licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2; compliance; 0.8; you may not use this file except in compliance with the license
apache-2; basis; 0.8; distributed on an as is basis without warranties or conditions of any kind either express or implied
apache-2; perpetual; 0.8; each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
apache-2; apache; 0.95; www apache org licenses license 2 0
apache-1.1; apache; 0.9; this product includes software developed by the apache software foundation
gpl-2; gnu; 0.95; under the terms of the gnu general public license as published by the free software foundation either? version 2
gpl-3; gnu; 0.95; under the terms of the gnu general public license as published by the free software foundation either? version 3
gpl-2-only; gnu; 0.95; under the terms of the gnu general public license version 2 only
gpl-3-only; gnu; 0.95; under the terms of the gnu general public license version 3 only
lgpl-2; gnu; 0.95; under the terms of the gnu (library|lesser) general public license as published by the free software foundation either? version 2
lgpl-2.1; gnu; 0.95; under the terms of the gnu lesser general public license as published by the free software foundation either? version 2 1
lgpl-3; gnu; 0.95; under the terms of the gnu lesser general public license as published by the free software foundation either? version 3
agpl-3; affero; 0.95; under the terms of the gnu affero general public license as published by the free software foundation either? version 3
gfdl; documentation; 0.95; under the terms of the gnu free documentation license version? (1 1|1 2|1 3)?
gpl; gnu; 0.85; under the terms of the gnu general public license
lgpl; lesser; 0.85; under the terms of the gnu lesser general public license
agpl; affero; 0.85; under the terms of the gnu affero general public license
gpl; gnu; 0.85; you should have received a copy of the gnu general public license
lgpl; lesser; 0.85; you should have received a copy of the gnu lesser general public license
agpl; affero; 0.85; you should have received a copy of the gnu affero general public license
gpl; merchantability; 0.7; without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license
gpl; copyleft; 0.7; the gnu general public license is a free copyleft license for software and other kinds of works
gpl-3; corresponding; 0.6; you must convey the machine readable corresponding source under the terms of this license
classpath-exception; classpath; 0.85; with classpath exception (2 0)?
gcc-exception; gcc; 0.85; gcc runtime library exception (version? 3 1)?
autoconf-exception; autoconf; 0.85; autoconf configure script exception
bison-exception; bison; 0.85; as a special exception you may create a larger work that contains part or all of the bison parser skeleton
llvm-exception; llvm; 0.9; apache license version? 2 0 with llvm exceptions
llvm-exception; llvm; 0.85; with llvm exception
mpl-2; mozilla; 0.95; this source code form is subject to the terms of the mozilla public license v? (version)? 2 0
mpl-1.1; mozilla; 0.95; the contents of this file are subject to the mozilla public license version 1 1
mpl-1; mozilla; 0.95; the contents of this file are subject to the mozilla public license version 1 0
npl-1.1; netscape; 0.9; the contents of this file are subject to the netscape public license version 1 (0|1)
mpl-2; mozilla; 0.85; mozilla public license (version|v)? 2 0?
mpl-1.1; mozilla; 0.85; mozilla public license (version|v)? 1 1
mpl; mozilla; 0.7; mozilla public license
epl-2; eclipse; 0.95; this program and the accompanying materials are made available under the terms of the eclipse public license (v|version)? 2 0
epl-1; eclipse; 0.95; this program and the accompanying materials are made available under the terms of the eclipse public license (v1 0|v|version)? (1 0)?
epl-2; eclipse; 0.85; eclipse public license (version|v)? 2 0?
epl-1; eclipse; 0.85; eclipse public license (version|v)? 1 0?
epl; eclipse; 0.7; eclipse public license
edl-1; eclipse; 0.85; eclipse distribution license (version|v)? 1 0?
cddl-1; common; 0.9; subject to the terms of the common development and distribution license (the license|cddl)?
cddl-1; common; 0.85; common development and distribution license (version? 1 0)?
cddl-1.1; common; 0.9; common development and distribution license version? 1 1
cpl-1; common; 0.85; common public license (version|v)? 1 0?
cpl; common; 0.7; common public license
cpal-1; attribution; 0.85; common public attribution license (version? 1 0)?
ipl-1; ibm; 0.85; ibm public license (version? 1 0)?
spl-1; sun; 0.8; sun public license (version? 1 0)?
apsl-2; apple; 0.85; apple public source license (version? 2 0)?
rpl-1.5; reciprocal; 0.85; reciprocal public license (version? 1 (1|5))?
osl-3; open; 0.85; open software license (version|v)? 3 0?
afl-3; academic; 0.85; academic free license (version|v)? 3 0?
afl-2.1; academic; 0.85; academic free license (version|v)? 2 (0|1)
afl; academic; 0.7; academic free license
ecl-2; educational; 0.85; educational community license (version|v)? 2 0?
eupl-1.2; european; 0.9; european union public (license|licence) (version|v)? 1 2
eupl-1.1; european; 0.9; european union public (license|licence) (version|v)? 1 1
eupl; european; 0.7; european union public (license|licence)
cecill-2.1; cecill; 0.85; cecill (free software)? license (agreement)? (version)? 2 1
cecill-b; cecill; 0.85; cecill b license
cecill-c; cecill; 0.85; cecill c license
cecill; cecill; 0.7; cecill (license|licence)
liliq-p; quebec; 0.7; licence libre du quebec
zlib; arising; 0.9; in no event will the authors be held liable for any damages arising from the use of this software
zlib; misrepresented; 0.9; the origin of this software must not be misrepresented you must not claim that you wrote the original software
libpng; png; 0.85; png reference library license (version 2)?
libpng; libpng; 0.8; (the)? libpng license
ijg; jpeg; 0.85; this software is based in part on the work of the independent jpeg group
boost-1; boost; 0.95; distributed under the boost software license version 1 0
boost-1; boost; 0.9; boost software license (version|v)? 1 0?
boost-1; boost; 0.7; boost software license
boost-1; accompanying; 0.7; any person or organization obtaining a copy of the software and accompanying documentation covered by this license
unlicense; unencumbered; 0.95; this is free and unencumbered software released into the public domain
unlicense; unlicense; 0.8; (the)? unlicense
public-domain; public; 0.8; (released|placed|dedicated|put) (in|into|to) the public domain
public-domain; public; 0.8; (is|are) in the public domain
public-domain; domain; 0.7; public domain (dedication|software|notice)
json; evil; 0.9; the software shall be used for good not evil
beerware; beerware; 0.8; (the)? beerware license (revision 42)?
wtfpl; fuck; 0.9; do what the fuck you want to public license
wtfpl; wtfpl; 0.8; wtfpl (license|version 2)?
artistic-2; artistic; 0.9; artistic license (version|v)? 2 0?
artistic-1; artistic; 0.85; artistic license (version|v)? 1 0?
artistic; artistic; 0.8; (the|perl) artistic license
artistic; perl; 0.85; under the same terms as perl itself
psf-2; python; 0.9; python software foundation license (agreement)? (version? 2)?
python-2; python; 0.85; python license (version|v)? 2 0?
python-2; python; 0.8; under the (terms of the)? python license
cnri-python; cnri; 0.85; cnri python license
php-3.01; php; 0.9; (the)? php license (version|v)? 3 (01|0)
php-3; php; 0.8; under the (terms of the)? php license
zend-2; zend; 0.85; zend (engine)? license (version? 2 0)?
ruby; ruby; 0.8; (under|to) (the terms of)? the? ruby license
ruby; ruby; 0.85; ruby s license
vim; vim; 0.85; (under|to) (the terms of)? the vim license
openssl; openssl; 0.9; this product includes software developed by the openssl project for use in the openssl toolkit
openssl; openssl; 0.8; openssl license
ssleay; eric; 0.85; this product includes cryptographic software written by eric young
curl; curl; 0.8; curl license
ncsa; illinois; 0.9; university of illinois (ncsa)? open source license
ncsa; ncsa; 0.8; ncsa open source license
w3c; w3c; 0.9; w3c software (notice)? and? (document)? license
unicode; unicode; 0.85; unicode inc? license agreement (data files and software)?
icu; icu; 0.8; icu license
ofl-1.1; font; 0.95; this font software is licensed under the sil open font license version 1 1
ofl-1.1; font; 0.85; sil open font license (version|v)? (1 1|1 0)?
bitstream-vera; vera; 0.85; bitstream vera (fonts)? copyright
lppl-1.3; latex; 0.9; latex project public license (either)? (version|v)? (1 3c|1 3|1 2)?
odbl; database; 0.9; open database license (odbl)? (version|v)? (1 0)?
odc-by; commons; 0.9; open data commons attribution license (v1 0)?
pddl; commons; 0.9; open data commons public domain dedication and? license
ogl-3; government; 0.85; open government licence (version|v)? (v3 0|3 0|2 0|1 0)?
etalab-2; etalab; 0.85; (licence ouverte|open licence) etalab (2 0)?
ms-pl; microsoft; 0.85; microsoft public license
ms-rl; microsoft; 0.85; microsoft reciprocal license
ms-eula; microsoft; 0.7; microsoft software license terms
sspl-1; server; 0.9; server side public license (version|v)? 1?
bsl-1.1; business; 0.9; business source license (version|v)? (1 1|1 0)?
elastic-2; elastic; 0.9; elastic license (version|v)? (2 0)?
commons-clause; clause; 0.9; commons clause license condition (version|v1 0)?
polyform; polyform; 0.85; polyform (noncommercial|shield|perimeter|strict|small business|free trial|internal use) license (1 0 0)?
parity-7; parity; 0.85; parity public license (7 0 0)?
blueoak-1; blue; 0.85; blue oak model license (1 0 0)?
mulan-2; mulan; 0.85; mulan permissive software license (version|v)? (v2|2)?
openrail-m; openrail; 0.85; (creativeml|bigscience|bigcode)? openrail (m)? (license)?
rail; responsible; 0.85; responsible ai license
llama; llama; 0.85; llama (2|3|3 1|3 2|3 3)? community license (agreement)?
cc0; waived; 0.9; to the extent possible under law ... has waived all copyright and related or neighboring rights
cc0; cc0; 0.9; cc0 1 0 universal (public domain dedication)?
cc0; cc0; 0.7; cc0 (license|licence|public domain)?
cc0; creativecommons; 0.95; creativecommons org publicdomain zero 1 0
cc-pdm; creativecommons; 0.95; creativecommons org publicdomain mark 1 0
cc-by-nc-nd; creativecommons; 0.95; creativecommons org licenses by nc nd (4 0|3 0|2 5|2 0|1 0)?
cc-by-nc-sa; creativecommons; 0.95; creativecommons org licenses by nc sa (4 0|3 0|2 5|2 0|1 0)?
cc-by-nc; creativecommons; 0.95; creativecommons org licenses by nc (4 0|3 0|2 5|2 0|1 0)?
cc-by-nd; creativecommons; 0.95; creativecommons org licenses by nd (4 0|3 0|2 5|2 0|1 0)?
cc-by-sa; creativecommons; 0.95; creativecommons org licenses by sa (4 0|3 0|2 5|2 0|1 0)?
cc-by; creativecommons; 0.95; creativecommons org licenses by (4 0|3 0|2 5|2 0|1 0)?
cc-by-nc-nd; creative; 0.9; creative commons attribution noncommercial noderivatives (4 0|3 0)? (international|unported)? (license)?
cc-by-nc-sa; creative; 0.9; creative commons attribution noncommercial sharealike (4 0|3 0)? (international|unported)? (license)?
cc-by-nc-sa; creative; 0.9; creative commons attribution non commercial share alike (4 0|3 0)? (international|unported)? (license)?
cc-by-nc; creative; 0.9; creative commons attribution noncommercial (4 0|3 0)? (international|unported)? (license)?
cc-by-nc; creative; 0.9; creative commons attribution non commercial (4 0|3 0)? (international|unported)? (license)?
cc-by-nd; creative; 0.9; creative commons attribution (noderivatives|noderivs|no derivatives) (4 0|3 0)? (international|unported)? (license)?
cc-by-sa; creative; 0.9; creative commons attribution (sharealike|share alike) (4 0|3 0)? (international|unported)? (license)?
cc-by; creative; 0.85; creative commons attribution (4 0|3 0|2 0)? (international|unported|generic)? (license)?
creative-commons; creative; 0.6; creative commons (license|licence|licensed)
cc-by-nc-nd; cc; 0.8; cc by nc nd (4 0|3 0|2 5|2 0)?
cc-by-nc-sa; cc; 0.8; cc by nc sa (4 0|3 0|2 5|2 0)?
cc-by-nc; cc; 0.8; cc by nc (4 0|3 0|2 5|2 0)
cc-by-nd; cc; 0.8; cc by nd (4 0|3 0|2 5|2 0)?
cc-by-sa; cc; 0.8; cc by sa (4 0|3 0|2 5|2 0)?
cc-by; cc; 0.8; cc by (4 0|3 0|2 5|2 0)
cc-by; cc; 0.7; (under|under a|under the|license|licence) cc by
cc-by; cc; 0.7; cc by (license|licence|licensed)
mit; identifier; 0.95; spdx license identifier mit
apache-2; identifier; 0.95; spdx license identifier apache 2 0
bsd-2-clause; identifier; 0.95; spdx license identifier bsd 2 clause
bsd-3-clause; identifier; 0.95; spdx license identifier bsd 3 clause
isc; identifier; 0.95; spdx license identifier isc
gpl-2; identifier; 0.95; spdx license identifier gpl 2 0 (only|or later)?
gpl-3; identifier; 0.95; spdx license identifier gpl 3 0 (only|or later)?
lgpl-2.1; identifier; 0.95; spdx license identifier lgpl 2 1 (only|or later)?
lgpl-3; identifier; 0.95; spdx license identifier lgpl 3 0 (only|or later)?
agpl-3; identifier; 0.95; spdx license identifier agpl 3 0 (only|or later)?
mpl-2; identifier; 0.95; spdx license identifier mpl 2 0
epl-2; identifier; 0.95; spdx license identifier epl 2 0
cc0; identifier; 0.95; spdx license identifier cc0 1 0
unlicense; identifier; 0.95; spdx license identifier unlicense
zlib; identifier; 0.95; spdx license identifier zlib
boost-1; identifier; 0.95; spdx license identifier bsl 1 0
spdx; identifier; 0.5; spdx license identifier
mit; mit; 0.85; (released|distributed|available|published) under (the|an)? mit (license|licence)
mit; mit; 0.85; (licensed|licenced) under (the|an)? mit (license|licence)?
mit; mit; 0.7; mit (license|licence|licensed|style license)
mit; expat; 0.7; expat license
apache-2; apache; 0.85; (licensed|licenced|released|distributed|available|published) under (the)? apache (software)? license? (version|v|2)? (2|2 0|0)?
apache-2; apache; 0.8; apache (software)? license v? (version)? 2 0?
apache-1.1; apache; 0.8; apache (software)? license (version|v)? 1 1
apache-1; apache; 0.8; apache (software)? license (version|v)? 1 0
apache-2; apache; 0.7; apache 2 0
apache-2; apache2; 0.7; apache2 (license)?
apache; apache; 0.6; apache (software)? license
bsd-3-clause; bsd; 0.8; bsd 3 clause (license|licence)?
bsd-3-clause; bsd; 0.8; (3|three) clause bsd (license|licence)?
bsd-3-clause; bsd; 0.7; (new|modified|revised) bsd (license|licence)
bsd-2-clause; bsd; 0.8; bsd 2 clause (license|licence)?
bsd-2-clause; bsd; 0.8; (2|two) clause bsd (license|licence)?
bsd-2-clause; bsd; 0.7; simplified bsd (license|licence)
bsd-2-clause; freebsd; 0.7; freebsd (license|licence)
bsd-4-clause; bsd; 0.8; bsd 4 clause (license|licence)?
bsd-4-clause; bsd; 0.7; (original|4 clause|four clause) bsd (license|licence)
bsd; bsd; 0.6; bsd (style|type)? (license|licence|licensed)
0bsd; 0bsd; 0.7; 0bsd (license)?
gpl-2; gpl; 0.8; (gnu)? gpl (version|v)? 2 0? (only|or later)?
gpl-3; gpl; 0.8; (gnu)? gpl (version|v)? 3 0? (only|or later)?
gpl-2; gplv2; 0.8; gplv2 (license|only|or later)?
gpl-3; gplv3; 0.8; gplv3 (license|only|or later)?
gpl-2; gnu; 0.85; gnu general public license (version|v) 2
gpl-3; gnu; 0.85; gnu general public license (version|v) 3
gpl; gnu; 0.7; gnu general public license
gpl; gpl; 0.6; (gnu)? gpl (license|licence|licensed)
lgpl-2.1; lgpl; 0.8; (gnu)? lgpl (version|v)? 2 1 (only|or later)?
lgpl-3; lgpl; 0.8; (gnu)? lgpl (version|v)? 3 0? (only|or later)?
lgpl-3; lgplv3; 0.8; lgplv3 (license)?
lgpl-2.1; lesser; 0.85; gnu lesser general public license (version|v) 2 1
lgpl-3; lesser; 0.85; gnu lesser general public license (version|v) 3
lgpl; lesser; 0.7; gnu? lesser general public license
lgpl; library; 0.7; gnu library general public license
lgpl; lgpl; 0.6; lgpl (license|licence|licensed)
agpl-3; agpl; 0.8; (gnu)? agpl (version|v)? 3 0? (only|or later)?
agpl-3; agplv3; 0.8; agplv3 (license)?
agpl-3; affero; 0.85; gnu? affero general public license (version|v) 3
agpl; affero; 0.7; gnu? affero general public license
agpl; agpl; 0.6; agpl (license|licence|licensed)
gfdl; documentation; 0.8; gnu free documentation license
gfdl; gfdl; 0.7; gfdl (license|1 3|1 2)?
mpl-2; mpl; 0.8; mpl (version|v)? 2 0
mpl-1.1; mpl; 0.8; mpl (version|v)? 1 1
epl-2; epl; 0.75; epl (version|v)? 2 0
epl-1; epl; 0.75; epl (version|v)? 1 0
cddl-1; cddl; 0.7; cddl (license|1 0)
eupl-1.2; eupl; 0.75; eupl (version|v)? 1 2
isc; isc; 0.7; isc (license|licence|licensed)
zlib; zlib; 0.7; zlib (libpng)? (license|licence)
x11; x11; 0.7; x11 (license|licence)
postgresql; postgresql; 0.75; postgresql (license|licence)
adobe-2006; adobe; 0.8; adobe (systems)? (incorporated)? source code license (agreement)?
aal; assurance; 0.8; attribution assurance license
apl-1; adaptive; 0.8; adaptive public license (version? 1 0)?
bittorrent; bittorrent; 0.8; bittorrent open source license (version? 1 (0|1))?
bzip2; bzip2; 0.75; bzip2 (and libbzip2)? license
catosl; computer; 0.8; computer associates trusted open source license
clear-bsd; clear; 0.8; clear bsd license
cua-opl; cua; 0.75; cua office public license
dsdp; dsdp; 0.7; dsdp license
ecos-2; ecos; 0.8; ecos license (version? 2 0)?
efl-2; eiffel; 0.85; eiffel forum license (version|v)? (2|1)?
entessa; entessa; 0.8; entessa public license
eudatagrid; datagrid; 0.8; eu datagrid software license
fair; fair; 0.7; the fair license
frameworx; frameworx; 0.8; frameworx open license
ftl; freetype; 0.85; freetype (project)? license
gust; gust; 0.8; gust font (source|nosource)? license
hpnd; historical; 0.85; historical permission notice and disclaimer
info-zip; info; 0.8; info zip license
intel; intel; 0.8; intel open source license
ipa; ipa; 0.8; ipa font license
jasper-2; jasper; 0.8; jasper license (version? 2 0)?
libtiff; libtiff; 0.75; libtiff license
lpl-1.02; lucent; 0.85; lucent public license (version|v)? (1 02|1 0)?
miros; miros; 0.8; (the)? miros (license|licence)
motosoto; motosoto; 0.8; motosoto open source license
multics; multics; 0.75; multics license
naumen; naumen; 0.8; naumen public license
ngpl; nethack; 0.85; nethack general public license
nokia; nokia; 0.8; nokia open source license
nposl-3; profit; 0.85; non profit open software license (version? 3 0)?
oclc-2; oclc; 0.8; oclc research public license (version? 2 0)?
ogtsl; group; 0.8; open group test suite license
oldap-2.8; openldap; 0.85; openldap public license (version? 2 (8|7))?
opl-1; publication; 0.8; open publication license (v1 0|version? 1 0)?
oset; oset; 0.8; oset (foundation)? public license
qpl-1; q; 0.85; q public license (version? 1 0)?
rpsl-1; realnetworks; 0.85; realnetworks public source license (version? 1 0)?
ricoh; ricoh; 0.8; ricoh source code public license
saxpath; saxpath; 0.7; saxpath license
sgi-b-2; sgi; 0.85; sgi free software license b (version? 2 0)?
simpl-2; simple; 0.8; simple public license (version? 2 0)?
sissl; sun; 0.85; sun industry standards source license
sleepycat; sleepycat; 0.85; sleepycat (public)? license
smlnj; jersey; 0.85; standard ml of new jersey license
tcl; tcl; 0.75; tcl tk? license
ucl-1; upstream; 0.8; upstream compatibility license
upl-1; universal; 0.85; universal permissive license (version|v)? (v1 0|1 0)?
vsl-1; vovida; 0.85; vovida software license (version|v)? (1 0)?
watcom-1; watcom; 0.85; sybase open watcom public license (version? 1 0)?
wxwindows; wxwindows; 0.85; wxwindows library (licence|license)
xnet; net; 0.8; x net license
zpl-2.1; zope; 0.85; zope public license (version|v)? (2 1|2 0)?
zed; zed; 0.7; zed license
proprietary; proprietary; 0.7; proprietary (and confidential|license|licence|software license)
proprietary; unauthorized; 0.8; unauthorized copying of this file via any medium is strictly prohibited
license-agreement; agreement; 0.5; end user license agreement
"""
