"""Signature rules of the license scan, written by hand over normalised words.

A line is a label, a priority, a strength in percent and a regular expression.
Normalised words have A-Z lower-cased and single blanks for everything else that
is ASCII and neither letter nor digit. Priorities: 60 for wordings that only one
license has, 50 for wordings of a family, 45 for addresses, 40 for identifiers,
35 for headers that name a version, 30 for other grants, 20 for terms, 10 for
mentions, 5 for notices that say little.
"""

from __future__ import annotations

import re

RULES = r"""
mit 60 100 permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit 50 95 permission is hereby granted free of charge to any person obtaining a copy
mit 50 90 the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit 50 85 to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies
mit 50 80 in no event shall the authors or copyright holders be liable for any claim damages or other liability
mit 45 95 (?:https? )?(?:www )?opensource org licenses? mit(?: license)?(?: php| html)?
mit 40 100 spdx license identifier mit
mit 40 90 license osi approved mit license
mit 35 95 (?:licensed|released|distributed|published) under the terms of the mit license
mit 30 95 (?:is|are) (?:dual )?licensed under (?:the )?mit(?: license)?
mit 30 90 mit licensed
mit 20 85 see (?:the )?(?:license|copying)(?: file)? for the mit license
mit 10 70 (?:the )?mit expat license
mit 10 70 (?:the )?x11 license
mit-0 60 100 permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
mit-0 40 100 spdx license identifier mit 0
mit-0 30 95 mit no attribution(?: license)?
isc 60 100 permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc 50 90 provided that the above copyright notice and this permission notice appear in all copies
isc 45 95 (?:https? )?(?:www )?(?:opensource|isc) org licenses? isc(?: license)?(?: txt)?
isc 40 100 spdx license identifier isc
isc 40 90 license osi approved isc license(?: iscl)?
isc 30 95 licensed under the isc license
0bsd 60 100 permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
0bsd 40 100 spdx license identifier 0bsd
bsd 50 90 redistribution and use in source and binary forms with or without modification are permitted
bsd 50 85 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd 50 85 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd 30 90 use of this source code is governed by a bsd style license
bsd 30 90 (?:released|licensed|distributed) under (?:a|the) bsd(?: style| like)? license
bsd 40 85 license osi approved bsd license
bsd 10 70 bsd style licen[cs]e
bsd-2-clause 40 100 spdx license identifier bsd 2 clause(?: simplified| freebsd)?
bsd-2-clause 45 95 (?:https? )?(?:www )?opensource org licenses? bsd 2 clause
bsd-2-clause 35 95 (?:the )?(?:simplified|2 clause|two clause) bsd license
bsd-2-clause 35 90 (?:the )?freebsd license
bsd-2-clause 60 95 the views and conclusions contained in the software and documentation are those of the authors and should not be interpreted as representing official policies
bsd-3-clause 60 100 neither the name of .{1,120}? nor the names of (?:its|his|her|their) contributors may be used to endorse or promote products
bsd-3-clause 60 95 the name of the (?:author|copyright holder|company|university) may not be used to endorse or promote products
bsd-3-clause 40 100 spdx license identifier bsd 3 clause
bsd-3-clause 45 95 (?:https? )?(?:www )?opensource org licenses? bsd 3 clause
bsd-3-clause 35 95 (?:the )?(?:new|modified|revised|3 clause|three clause) bsd license
bsd-4-clause 60 100 all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment
bsd-4-clause 40 100 spdx license identifier bsd 4 clause
bsd-4-clause 35 95 (?:the )?(?:original|old|4 clause|four clause) bsd license
bsd-1-clause 40 100 spdx license identifier bsd 1 clause
apache-1 40 100 spdx license identifier apache 1 0
apache-1.1 40 100 spdx license identifier apache 1 1
apache-1.1 35 95 apache software license version 1 1
apache-1.1 60 95 this product includes software developed by the apache software foundation
apache-2 60 100 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2 50 95 licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2 50 85 you may not use this file except in compliance with the license you may obtain a copy of the license at
apache-2 50 90 each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
apache-2 45 100 (?:https? )?(?:www )?apache org licenses license 2 0(?: txt| html)?
apache-2 45 95 (?:https? )?(?:www )?opensource org licenses? apache 2 0(?: php)?
apache-2 40 100 spdx license identifier apache 2 0
apache-2 40 90 license osi approved apache software license
apache-2 35 95 licensed to the apache software foundation asf under one or more contributor license agreements
apache-2 35 95 (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?apache(?: software)? license(?: version)? v?2(?: 0)?
apache-2 20 85 apache license v ?2(?: 0)?
apache-2 10 70 apache 2(?: 0)? licensed
gpl-1 40 100 spdx license identifier gpl 1 0(?: only| or later)?
gpl-1 35 95 general public license(?: as published by the free software foundation)? (?:either )?version 1
gpl-2 60 100 gnu general public license version 2 june 1991
gpl-2 35 100 under the terms of the gnu general public license as published by the free software foundation (?:either )?version 2(?: of the license)?
gpl-2 35 95 under the terms of (?:the )?gnu general public license version 2
gpl-2 40 100 spdx license identifier gpl 2 0(?: only| or later)?
gpl-2 45 95 (?:https? )?(?:www )?gnu org licenses(?: old licenses)? gpl 2 0(?: en)?(?: txt| html)?
gpl-2 40 90 gnu general public license v2(?: gplv2)?(?: or later gplv2)?
gpl-2 20 90 (?:the )?(?:gnu )?gpl ?v ?2(?: 0)?(?: or later| only)?
gpl-2 50 85 51 franklin st(?:reet)? fifth floor boston ma 02110 1301
gpl-2 50 80 59 temple place suite 330 boston ma 02111 1307
gpl-3 60 100 gnu general public license version 3 29 june 2007
gpl-3 35 100 under the terms of the gnu general public license as published by the free software foundation (?:either )?version 3(?: of the license)?
gpl-3 35 95 under the terms of (?:the )?gnu general public license version 3
gpl-3 40 100 spdx license identifier gpl 3 0(?: only| or later)?
gpl-3 45 95 (?:https? )?(?:www )?gnu org licenses gpl 3 0(?: en)?(?: txt| html)?
gpl-3 40 90 gnu general public license v3(?: gplv3)?(?: or later gplv3)?
gpl-3 20 90 (?:the )?(?:gnu )?gpl ?v ?3(?: 0)?(?: or later| only)?
gpl 50 85 you should have received a copy of the gnu general public license along with
gpl 50 80 is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl 45 85 (?:https? )?(?:www )?gnu org (?:licenses|copyleft) gpl(?: txt| html)?
gpl 30 85 (?:released|licensed|distributed|available) under the gnu gpl
gpl 30 85 (?:released|licensed|distributed|available) under the (?:gnu )?general public license
gpl 10 70 (?:the )?gnu general public license
lgpl-2 40 100 spdx license identifier lgpl 2 0(?: only| or later)?
lgpl-2 35 95 gnu library general public license as published by the free software foundation (?:either )?version 2
lgpl-2.1 60 100 gnu lesser general public license version 2 1 february 1999
lgpl-2.1 40 100 spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-2.1 35 100 gnu lesser general public license as published by the free software foundation (?:either )?version 2 1
lgpl-2.1 45 95 (?:https? )?(?:www )?gnu org licenses(?: old licenses)? lgpl 2 1(?: en)?(?: txt| html)?
lgpl-2.1 20 90 (?:the )?(?:gnu )?lgpl ?v ?2 1(?: or later| only)?
lgpl-3 60 100 gnu lesser general public license version 3 29 june 2007
lgpl-3 40 100 spdx license identifier lgpl 3 0(?: only| or later)?
lgpl-3 35 100 gnu lesser general public license as published by the free software foundation (?:either )?version 3
lgpl-3 45 95 (?:https? )?(?:www )?gnu org licenses lgpl 3 0(?: en)?(?: txt| html)?
lgpl-3 20 90 (?:the )?(?:gnu )?lgpl ?v ?3(?: 0)?(?: or later| only)?
lgpl 50 85 you should have received a copy of the gnu lesser general public license along with
lgpl 30 85 (?:released|licensed|distributed|available) under the lgpl
lgpl 30 85 (?:released|licensed|distributed|available) under the gnu lgpl
lgpl 30 85 (?:released|licensed|distributed|available) under the (?:gnu )?lesser general public license
lgpl 10 70 (?:the )?gnu lesser general public license
agpl-3 60 100 gnu affero general public license version 3 19 november 2007
agpl-3 40 100 spdx license identifier agpl 3 0(?: only| or later)?
agpl-3 35 100 gnu affero general public license as published by the free software foundation (?:either )?version 3
agpl-3 45 95 (?:https? )?(?:www )?gnu org licenses agpl 3 0(?: en)?(?: txt| html)?
agpl-3 20 90 (?:the )?(?:gnu )?agpl ?v ?3(?: 0)?(?: or later| only)?
agpl 50 85 you should have received a copy of the gnu affero general public license along with
agpl 10 75 (?:the )?gnu affero general public license
mpl-1.1 40 100 spdx license identifier mpl 1 1
mpl-1.1 60 95 the contents of this file are subject to the mozilla public license version 1 1
mpl-1.1 45 95 (?:https? )?(?:www )?mozilla org mpl mpl 1 1(?: txt| html)?
mpl-2 60 100 this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2 45 95 (?:https? )?(?:www )?mozilla org mpl 2 0
mpl-2 40 100 spdx license identifier mpl 2 0
mpl-2 40 90 mozilla public license 2 0 mpl 2 0
mpl 10 70 (?:the )?mozilla public license
epl-1 40 100 spdx license identifier epl 1 0
epl-1 45 95 (?:https? )?(?:www )?eclipse org legal epl v10(?: html)?
epl-1 60 95 made available under the terms of the eclipse public license v1 0
epl-2 40 100 spdx license identifier epl 2 0
epl-2 45 95 (?:https? )?(?:www )?eclipse org legal epl (?:2 0|v20)(?: html)?
epl-2 60 95 made available under the terms of the eclipse public license (?:v )?2 0
edl-1 45 95 (?:https? )?(?:www )?eclipse org org documents edl v10(?: php| html)?
cddl-1 40 100 spdx license identifier cddl 1 [01]
cddl-1 60 95 the contents of this file are subject to the terms of the common development and distribution license
cddl-1 45 95 (?:https? )?(?:www )?opensource org licenses? cddl1?(?: php)?
cpl-1 40 100 spdx license identifier cpl 1 0
cpl-1 60 95 made available under the terms of the common public license v1 0
eupl-1.1 40 100 spdx license identifier eupl 1 1
eupl-1.2 40 100 spdx license identifier eupl 1 2
eupl-1.2 60 95 licensed under the eupl(?: version)? (?:v )?1 2
artistic-1 40 100 spdx license identifier artistic 1 0(?: perl| cl8)?
artistic-1 30 90 under the same terms as perl itself
artistic-2 40 100 spdx license identifier artistic 2 0
artistic-2 45 95 (?:https? )?(?:www )?(?:opensource org licenses?|perlfoundation org) artistic (?:license )?2 0
bsl-1 40 100 spdx license identifier bsl 1 0
bsl-1 60 100 distributed under the boost software license version 1 0
bsl-1 45 95 (?:https? )?(?:www )?boost org license 1 0(?: txt)?
zlib 60 100 this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
zlib 50 90 altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib 40 100 spdx license identifier zlib
libpng 40 100 spdx license identifier libpng(?: 2 0)?
unlicense 60 100 this is free and unencumbered software released into the public domain
unlicense 50 90 anyone is free to copy modify publish use compile sell or distribute this software
unlicense 45 95 (?:https? )?(?:www )?unlicense org
unlicense 40 100 spdx license identifier unlicense
wtfpl 60 100 do what the fuck you want to public license
wtfpl 40 100 spdx license identifier wtfpl
wtfpl 45 95 (?:https? )?(?:www |sam zoy org )wtfpl(?: net)?
ms-pl 40 100 spdx license identifier ms pl
ms-pl 60 95 this license governs use of the accompanying software if you use the software you accept this license
ms-rl 40 100 spdx license identifier ms rl
postgresql 40 100 spdx license identifier postgresql
postgresql 60 95 permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
python-2 40 100 spdx license identifier (?:python|psf) 2 0
python-2 60 95 python software foundation license version 2
php-3 40 100 spdx license identifier php 3 0?1?
php-3 60 95 this source file is subject to version 3 01? of the php license
ofl-1.1 40 100 spdx license identifier ofl 1 1
ofl-1.1 60 100 this font software is licensed under the sil open font license version 1 1
ofl-1.1 45 95 (?:https? )?(?:www )?scripts sil org ofl
odbl-1 40 100 spdx license identifier odbl 1 0
odbl-1 45 95 (?:https? )?(?:www )?opendatacommons org licenses odbl(?: 1 0)?
odc-by-1 45 95 (?:https? )?(?:www )?opendatacommons org licenses by(?: 1 0)?
pddl-1 45 95 (?:https? )?(?:www )?opendatacommons org licenses pddl(?: 1 0)?
fdl-1.2 35 95 gnu free documentation license version 1 2
fdl-1.3 35 95 gnu free documentation license version 1 3
fdl-1.3 60 95 permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
fdl-1.3 40 100 spdx license identifier gfdl 1 3(?: only| or later)?
cc0 45 100 (?:https? )?(?:www )?creativecommons org publicdomain zero 1 0
cc0 40 100 spdx license identifier cc0 1 0
cc0 60 95 to the extent possible under law .{1,120}? has waived all copyright and related or neighboring rights
cc0 30 90 cc0 1 0 universal(?: public domain dedication)?
cc-by 45 100 (?:https? )?(?:www )?creativecommons org licenses by [1-4] [05]
cc-by-sa 45 100 (?:https? )?(?:www )?creativecommons org licenses by sa [1-4] [05]
cc-by-nd 45 100 (?:https? )?(?:www )?creativecommons org licenses by nd [1-4] [05]
cc-by-nc 45 100 (?:https? )?(?:www )?creativecommons org licenses by nc [1-4] [05]
cc-by-nc-sa 45 100 (?:https? )?(?:www )?creativecommons org licenses by nc sa [1-4] [05]
cc-by-nc-nd 45 100 (?:https? )?(?:www )?creativecommons org licenses by nc nd [1-4] [05]
cc-by 40 100 spdx license identifier cc by [1-4] [05]
cc-by-sa 40 100 spdx license identifier cc by sa [1-4] [05]
cc-by-nd 40 100 spdx license identifier cc by nd [1-4] [05]
cc-by-nc 40 100 spdx license identifier cc by nc [1-4] [05]
cc-by-nc-sa 40 100 spdx license identifier cc by nc sa [1-4] [05]
cc-by-nc-nd 40 100 spdx license identifier cc by nc nd [1-4] [05]
cc-by 35 95 creative commons attribution [1-4] [05](?: international| unported| generic)?
cc-by 10 70 cc by [1-4] [05]
cc-by-sa 35 95 creative commons attribution share ?alike [1-4] [05](?: international| unported| generic)?
cc-by-sa 10 70 cc by sa(?: [1-4] [05])?
cc-by-nd 35 95 creative commons attribution no ?deriv(?:ative|ative works|atives|s) [1-4] [05](?: international| unported| generic)?
cc-by-nd 10 70 cc by nd(?: [1-4] [05])?
cc-by-nc 35 95 creative commons attribution non ?commercial [1-4] [05](?: international| unported| generic)?
cc-by-nc 10 70 cc by nc(?: [1-4] [05])?
cc-by-nc-sa 35 95 creative commons attribution non ?commercial share ?alike [1-4] [05](?: international| unported| generic)?
cc-by-nc-sa 10 70 cc by nc sa(?: [1-4] [05])?
cc-by-nc-nd 35 95 creative commons attribution non ?commercial no ?deriv(?:ative|ative works|atives|s) [1-4] [05](?: international| unported| generic)?
cc-by-nc-nd 10 70 cc by nc nd(?: [1-4] [05])?
public-domain 30 85 (?:released|placed|dedicated) (?:in)?to the public domain
public-domain 30 80 (?:is|are) in the public domain
public-domain 30 80 has been placed in the public domain
public-domain 45 90 (?:https? )?(?:www )?creativecommons org (?:publicdomain mark|licenses publicdomain)(?: 1 0)?
public-domain 20 75 no copyright is claimed
blueoak-1 40 100 spdx license identifier blueoak 1 0 0
upl-1 40 100 spdx license identifier upl 1 0
ncsa 40 100 spdx license identifier ncsa
ncsa 30 90 university of illinois ncsa open source license
afl-3 40 100 spdx license identifier afl 3 0
afl-3 35 95 academic free license(?: version)? (?:v )?3 0
osl-3 40 100 spdx license identifier osl 3 0
osl-3 35 95 open software license(?: version)? (?:v )?3 0
cecill-2.1 40 100 spdx license identifier cecill 2 1
cecill 30 90 governed by the cecill(?: [bc])? license
beerware 60 95 you can buy me a beer in return
json 60 95 the software shall be used for good not evil
curl 40 100 spdx license identifier curl
openssl 40 100 spdx license identifier openssl
openssl 60 95 this product includes software developed by the openssl project
w3c 45 95 (?:https? )?(?:www )?w3 org consortium legal(?: [0-9]{4})? copyright software(?: [0-9]{8})?(?: html)?
unicode 45 95 (?:https? )?(?:www )?unicode org (?:copyright html|license txt)
vim 40 100 spdx license identifier vim
ruby 40 100 spdx license identifier ruby
openrail 30 90 (?:creativeml |bigscience )?open rail m(?: license)?
llama-community 30 90 llama [0-9](?: [0-9])? community license(?: agreement)?
source-available 30 95 business source license(?: 1 1)?
source-available 40 100 spdx license identifier (?:busl 1 1|elastic 2 0|sspl 1 0)
source-available 30 95 elastic license(?: 2 0)?
source-available 30 95 server side public license(?: v ?1)?
source-available 20 90 commons clause(?: license)?(?: condition)?
source-available 20 90 polyform (?:noncommercial|small business|shield|strict)(?: license)?
proprietary 5 60 all rights reserved
proprietary 20 90 proprietary and confidential
proprietary 20 90 confidential and proprietary
proprietary 20 90 unpublished proprietary trade secrets?
proprietary 20 85 unauthori[sz]ed copying of this file via any medium is strictly prohibited
proprietary 20 85 no part of this (?:publication|work|book|document) may be reproduced
proprietary 20 85 for internal use only
proprietary 20 80 not for (?:re)?distribution
proprietary 20 80 this (?:software|material|document) is (?:the )?(?:confidential |proprietary )*property of
non-commercial 20 85 for non commercial (?:use|purposes) only
non-commercial 20 85 for noncommercial (?:use|purposes) only
non-commercial 20 80 commercial use (?:is )?(?:strictly )?(?:prohibited|forbidden|not allowed|not permitted)
personal-use 20 80 for personal use only
share-alike 20 75 share alike under the same license
dual 10 70 dual licensed under
warranty 5 50 without any warranty without even the implied warranty of merchantability
warranty 5 50 provided as is without warranty of any kind
reference 5 50 see (?:the )?(?:accompanying )?(?:file )?license(?: txt| md)?(?: file)? for (?:details|more information|the full license(?: text)?)
"""

_group = re.compile(r"\([^()]*\)[?*]?")
_varied = re.compile(r"\[[^]]*\][?*]?|.\?|\.?\{[^}]*\}\??")


def keyword(form: str) -> str:
    """The longest run of plain words that every match of ``form`` holds."""
    while (plain := _group.sub("\0", form)) != form:
        form = plain
    if "|" in form:
        raise ValueError("alternatives belong in a group")
    return max(_varied.sub("\0", form).split("\0"), key=len).strip(" ")


def written() -> list[tuple[str, str, str, int, float]]:
    """(label, keyword, regular expression, priority, strength) of every line above."""
    out = []
    for line in RULES.strip().split("\n"):
        label, priority, strength, form = line.split(" ", 3)
        out.append((label, keyword(form), form, int(priority), int(strength) / 100))
    return out
