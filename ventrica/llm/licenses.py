"""License scan by ordered signature rules.

A rule is a hand-written pattern over the words of a text, with a label, a priority and the
keywords without which it cannot match; only rules whose keywords all occur are run.
Detections are word intervals. Of overlapping ones, an interval inside another is
suppressed if the other has a higher priority, or the same priority and more words.

Words are runs of ASCII digits, letters and signs above ASCII of the text with A-Z
lower-cased, taken on UTF-8 bytes, where all signs above ASCII have bytes above 127.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: The phrases of the base scan and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Signature rules, written by hand from public license texts and notices: priority, label, pattern over words.
#: Groups are not nested; words outside groups must occur and are the rule's keywords. 100 a sentence of the
#: license itself, 90 a machine-readable tag, 80 a grant that names it, 60 its name with a license word, 40 a short name.
SIGNATURES = r"""
100 mit permission is hereby granted free of charge to any person obtaining a copy
100 mit to deal in the software without restriction including without limitation the rights
100 mit the above copyright notice and this permission notice shall be included in all copies or substantial portions
100 mit in no event shall the authors or copyright holders be liable for any claim damages or other liability
100 mit-0 the rights to use copy modify merge publish distribute sublicense and or sell copies of the software without attribution
100 isc permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted
100 0bsd permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is granted
100 isc the software is provided as is and the author disclaims all warranties with regard to this software
100 bsd redistribution and use in source and binary forms with or without modification are permitted
100 bsd redistributions of source code must retain the above copyright notice this list of conditions
100 bsd redistributions in binary form must reproduce the above copyright notice
100 bsd-3 neither the names? of (?:the )?.{1,60}? nor the names of its contributors may be used to endorse
100 bsd-4 all advertising materials mentioning features or use of this software must display
100 bsd-patent the copyright holders and contributors hereby grant .{0,40}?patent license
100 apache licensed to the apache software foundation asf under one or more contributor license agreements
100 apache you may not use this file except in compliance with the license you may obtain a copy of the license at
100 apache unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
100 apache each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
100 apache http www apache org licenses license 2 0
100 gpl this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
100 gpl this program is distributed in the hope that it will be useful but without any warranty
100 gpl you should have received a copy of the gnu general public license along with this (?:program|file|package)
100 gpl everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
100 gpl the gnu general public license is a free copyleft license for software and other kinds of works
100 gpl the licenses for most software are designed to take away your freedom to share and change it
100 gpl-2 either version 2 of the license or at your option any later version
100 gpl-3 either version 3 of the license or at your option any later version
100 gpl-2-only under the terms of the gnu general public license version 2 as published by the free software foundation
100 lgpl this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
100 lgpl you should have received a copy of the gnu (?:lesser|library) general public license
100 lgpl this version of the gnu lesser general public license incorporates the terms and conditions
100 agpl you should have received a copy of the gnu affero general public license
100 agpl your modified version must prominently offer all users interacting with it remotely
100 gfdl permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
100 gfdl with no invariant sections no front cover texts and no back cover texts
100 mpl this source code form is subject to the terms of the mozilla public license v 2 0
100 mpl if a copy of the mpl was not distributed with this file you can obtain one at
100 mpl-1.1 the contents of this file are subject to the mozilla public license version 1 1
100 mpl this source code form is incompatible with secondary licenses
100 epl this program and the accompanying materials are made available under the terms of the eclipse public license
100 cddl the contents of this file are subject to the terms of the common development and distribution license
100 cddl when distributing covered code include this cddl header notice in each file
100 cpl the accompanying program is provided under the terms of this common public license
100 ipl the accompanying program is provided under the terms of this ibm public license
100 unlicense this is free and unencumbered software released into the public domain
100 unlicense anyone is free to copy modify publish use compile sell or distribute this software
100 unlicense in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest
100 zlib this software is provided as is without any express or implied warranty in no event will the authors be held liable
100 zlib the origin of this software must not be misrepresented you must not claim that you wrote the original software
100 zlib altered source versions must be plainly marked as such
100 libpng the png reference library is supplied as is
100 boost permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
100 boost unless such copies or derivative works are solely in the form of machine executable object code
100 cc0 the person who associated a work with this deed has dedicated the work to the public domain
100 cc0 affirmer hereby overtly fully permanently irrevocably and unconditionally waives
100 cc-by this work is licensed under a creative commons attribution (?:[1234] [05] )?(?:international |unported |generic )?license
100 cc-by-sa this work is licensed under a creative commons attribution share ?alike (?:[1234] [05] )?(?:international |unported )?license
100 cc-by-nc this work is licensed under a creative commons attribution non ?commercial (?:[1234] [05] )?(?:international |unported )?license
100 cc-by-nd this work is licensed under a creative commons attribution no ?deriv(?:s|atives)? (?:[1234] [05] )?(?:international |unported )?license
100 cc-by-nc-sa this work is licensed under a creative commons attribution non ?commercial share ?alike
100 cc-by-nc-nd this work is licensed under a creative commons attribution non ?commercial no ?deriv
100 wtfpl everyone is permitted to copy and distribute verbatim or modified copies of this license document
100 wtfpl you just do what the fuck you want to
100 ofl this font software is licensed under the sil open font license version 1 1
100 ofl the fonts including any derivative works can be bundled embedded redistributed
100 artistic the intent of this document is to state the conditions under which a package may be copied
100 artistic this is free software you can redistribute it and or modify it under the same terms as (?:the )?perl
100 perl under the same terms as perl (?:5 )?itself
100 postgresql permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
100 python this license agreement is between the python software foundation psf and the individual or organization
100 python psf hereby grants licensee a nonexclusive royalty free world wide license
100 ruby you may redistribute it and or modify it under either the terms of the (?:2 clause )?bsdl
100 php this product includes php software freely available from
100 php products derived from this software may not be called php
100 openssl this product includes software developed by the openssl project
100 ssleay this product includes cryptographic software written by eric young
100 apache-1.1 this product includes software developed by the apache software foundation
100 x11 permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee
100 x11 except as contained in this notice the name of the .{1,40}? shall not be used in advertising
100 hpnd permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted
100 ncsa permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software
100 eupl licensed under the eupl version 1 [12]
100 osl licensed under the open software license version [123] 0
100 afl licensed under the academic free license version [123] [01]
100 ms-pl this license governs use of the accompanying software if you use the software you accept this license
100 jsontools the software shall be used for good not evil
100 beerware as long as you retain this notice you can do whatever you want with this stuff
100 vim vim is charityware you can use and copy it as much as you like
100 curl permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
100 ijg this software is based in part on the work of the independent jpeg group
100 freetype portions of this software are copyright .{1,30}? the freetype project
100 unicode permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
100 w3c this work is being provided by the copyright holders under the following license
100 w3c permission to copy modify and distribute this work with or without modification for any purpose and without fee or royalty is hereby granted
100 icu icu license icu 1 8 1 and later
100 bzip2 this program bzip2 the associated library libbzip2 and all documentation are copyright
100 sqlite the author disclaims copyright to this source code in place of a legal notice here is a blessing
100 busl the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use
100 elastic you may not provide the software to third parties as a hosted or managed service
100 sspl if you make the functionality of the program or a modified version available to third parties as a service
100 commons-clause the software is provided to you by the licensor under the license as defined below subject to the following condition
100 polyform the licensor grants you a copyright license for the software to do everything you might do
100 proprietary this software is (?:the )?confidential and proprietary information
100 proprietary unauthorized copying of this file via any medium is strictly prohibited
100 proprietary no part of this (?:publication|document|book|work) may be reproduced
90 apache spdx license identifier apache 2 0
90 mit spdx license identifier mit
90 mit-0 spdx license identifier mit 0
90 gpl-2-only spdx license identifier gpl 2 0(?: only)?
90 gpl-2 spdx license identifier gpl 2 0 or later
90 gpl-3-only spdx license identifier gpl 3 0(?: only)?
90 gpl-3 spdx license identifier gpl 3 0 or later
90 lgpl spdx license identifier lgpl [23] [01](?: only| or later)?
90 agpl spdx license identifier agpl 3 0(?: only| or later)?
90 bsd-2 spdx license identifier bsd 2 clause
90 bsd-3 spdx license identifier bsd 3 clause
90 bsd-4 spdx license identifier bsd 4 clause
90 0bsd spdx license identifier 0bsd
90 mpl spdx license identifier mpl [12] [01]
90 epl spdx license identifier epl [12] 0
90 cddl spdx license identifier cddl 1 [01]
90 isc spdx license identifier isc
90 cc0 spdx license identifier cc0 1 0
90 cc-by spdx license identifier cc by [1234] [05]
90 cc-by-sa spdx license identifier cc by sa [1234] [05]
90 unlicense spdx license identifier unlicense
90 zlib spdx license identifier zlib
90 boost spdx license identifier bsl 1 0
90 artistic spdx license identifier artistic [12] 0(?: perl)?
90 eupl spdx license identifier eupl 1 [12]
90 ofl spdx license identifier ofl 1 1
90 wtfpl spdx license identifier wtfpl
90 postgresql spdx license identifier postgresql
90 python spdx license identifier (?:psf|python) 2 0
90 ncsa spdx license identifier ncsa
90 ms-pl spdx license identifier ms pl
90 other spdx license identifier licenseref .{1,30}?(?: |$)
80 apache (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?apache license(?: version)?(?: 2 0)?
80 mit (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?mit license
80 mit (?:licensed|released) under mit
80 gpl (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?(?:gnu )?general public license
80 gpl (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?(?:gnu )?gpl ?v?[123]?
80 lgpl (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?(?:gnu )?lgpl ?v?[23]?
80 agpl (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?(?:gnu )?agpl ?v?3?
80 bsd (?:licensed|released|distributed|available) under (?:the |a )?(?:terms of the )?(?:new |modified |simplified |2 clause |3 clause )?bsd(?: style)? licen[sc]e
80 mpl (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?mozilla public license
80 epl (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?eclipse public license
80 isc (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?isc license
80 cc-by (?:licensed|released|published|available) under (?:the |a )?creative commons attribution(?! share| non| no )
80 cc-by (?:licensed|released|published|available) under (?:the |a )?cc by(?! sa| nc| nd)(?: [1234] [05])?
80 cc-by-sa (?:licensed|released|published|available) under (?:the |a )?cc by sa(?: [1234] [05])?
80 cc0 (?:released|published|available) under (?:the )?cc0
80 public-domain (?:dedicated|released|placed) (?:in|into|to) the public domain
80 dual dual licensed under (?:the )?.{1,40}? and (?:the )?.{1,40}? licen[sc]es?
70 apache subject to the terms (?:and conditions )?of the apache license
70 mit subject to the terms (?:and conditions )?of the mit license
70 gpl subject to the terms (?:and conditions )?of the (?:gnu )?general public license
60 apache apache (?:software )?(?:2 0 )?licen[sc]e(?: version)?(?: 2 0)?
60 mit mit(?: expat)? licen[sc]e
60 mit expat licen[sc]e
60 gpl (?:gnu )?general public licen[sc]e(?: version [123])?
60 lgpl (?:gnu )?(?:lesser|library) general public licen[sc]e(?: version [23])?(?: [01])?
60 agpl (?:gnu )?affero general public licen[sc]e(?: version 3)?
60 gfdl (?:gnu )?free documentation licen[sc]e
60 bsd (?:new |modified |simplified |original )?bsd licen[sc]e
60 bsd-2 bsd 2 clause licen[sc]e
60 bsd-2 2 clause bsd licen[sc]e
60 bsd-3 bsd 3 clause licen[sc]e
60 bsd-3 3 clause bsd licen[sc]e
60 mpl mozilla public licen[sc]e(?: version [12] [01])?
60 epl eclipse public licen[sc]e(?: version)?(?: [12] 0)?
60 cddl common development and distribution licen[sc]e
60 isc isc licen[sc]e
60 artistic (?:clarified )?artistic licen[sc]e(?: [12] 0)?
60 boost boost software licen[sc]e(?: 1 0)?
60 zlib zlib(?: libpng)? licen[sc]e
60 cc-by creative commons attribution(?: [1234] [05])?(?: international| unported)? licen[sc]e
60 cc-by-sa creative commons attribution share ?alike(?: [1234] [05])?
60 cc-by-nc creative commons attribution non ?commercial(?: [1234] [05])?
60 cc-by-nd creative commons attribution no ?deriv(?:s|atives)?(?: [1234] [05])?
60 cc0 cc0(?: 1 0)? (?:universal|public domain dedication)
60 ofl (?:sil )?open font licen[sc]e(?: 1 1)?
60 wtfpl do what the fuck you want to public licen[sc]e
60 postgresql postgresql licen[sc]e
60 python python software foundation licen[sc]e
60 python psf licen[sc]e
60 php php licen[sc]e(?: 3 01)?
60 ruby ruby licen[sc]e
60 openssl openssl licen[sc]e
60 eupl european union public licen[sc]e(?: 1 [12])?
60 osl open software licen[sc]e(?: 3 0)?
60 afl academic free licen[sc]e(?: 3 0)?
60 ms-pl microsoft public licen[sc]e
60 ms-rl microsoft reciprocal licen[sc]e
60 ncsa (?:university of illinois )?ncsa open source licen[sc]e
60 busl business source licen[sc]e(?: 1 1)?
60 sspl server side public licen[sc]e
60 elastic elastic licen[sc]e(?: 2 0)?
60 unlicense the unlicense
40 gpl (?:gnu )?gpl ?v?[123](?: 0)?(?: or later| only)?
40 lgpl (?:gnu )?lgpl ?v?[23](?: [01])?(?: or later| only)?
40 agpl (?:gnu )?agpl ?v?3(?: 0)?(?: or later| only)?
40 mit mit licensed
40 apache apache licensed
40 bsd bsd licensed
40 cc-by cc by [1234] [05]
40 cc-by-sa cc by sa [1234] [05]
40 cc-by-nc cc by nc [1234] [05]
30 all-rights-reserved all rights reserved
"""


class Rule(NamedTuple):
    label: str
    priority: int
    keywords: frozenset[bytes]
    pattern: re.Pattern


def _keywords(pattern: str) -> frozenset[bytes]:
    """Words outside groups that are no pattern themselves: without all of them the rule cannot match."""
    outside = re.sub(r" ?\(\?[:!][^)]*\)\?? ?", " \0 ", pattern)  # words next to a group may be cut by it
    outside = re.sub(r"[a-z0-9]*(?:\[[^\]]*\]|[?.{}\0][^ ]*)[a-z0-9]*", " ", outside)
    return frozenset(w.encode() for w in re.findall(r"[a-z0-9]+", outside))


def _rules() -> list[Rule]:
    made = [line.split(" ", 2) for line in SIGNATURES.strip().splitlines()]
    ordered = sorted(made, key=lambda r: -int(r[0]))
    return [Rule(label, int(priority), _keywords(text), re.compile(rb"(?<![^ ])" + text.encode() + rb"(?![^ ])")) for priority, label, text in ordered]


RULES = _rules()
_BY_KEYWORD: dict[bytes, list[int]] = {}
for _k, _rule in enumerate(RULES):
    _BY_KEYWORD.setdefault(max(sorted(_rule.keywords) or [b""], key=len), []).append(_k)


def detections(words: list[bytes]) -> list[tuple[int, int, int, str]]:
    """(first word, last word, priority, label) of rules that match, after suppression, by place."""
    have = set(words)
    asked = sorted({k for w in (have & _BY_KEYWORD.keys()) | {b""} for k in _BY_KEYWORD.get(w, ()) if RULES[k].keywords <= have})
    if not asked:
        return []
    text, found = b" ".join(words), []
    for k in asked:
        rule, at, place = RULES[k], 0, 0
        for m in rule.pattern.finditer(text):
            place += text.count(b" ", at, m.start())
            at = m.start()
            found.append((place, place + m[0].count(b" "), rule.priority, rule.label))
    return suppress(found)


def suppress(found: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Drop intervals inside one of higher priority, or of the same priority and more words."""
    widest = max((b - a for a, b, _, _ in found), default=0)
    by_start: dict[int, list[tuple[int, int, int, str]]] = {}
    kept = []
    for d in sorted(set(found), key=lambda d: (-d[2], d[0] - d[1], d[0], d[3])):
        near = (k for s in range(d[0] - widest, d[0] + 1) for k in by_start.get(s, ()))
        if not any(d[1] <= k[1] and (k[:2] != d[:2] or k[2] > d[2]) for k in near):
            kept.append(d)
            by_start.setdefault(d[0], []).append(d)
    return sorted(kept)


def scan(text: bytes) -> tuple[int, int, int | None, int | None, str, str, float]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of one text."""
    words = _WORD.findall(text.lower())
    places, base = [], set()
    if b"license" in text.lower():
        for phrase, label in BASE:
            parts = phrase.encode().split()
            at = -1
            while True:
                try:
                    at = words.index(parts[0], at + 1)
                except ValueError:
                    break
                if words[at : at + len(parts)] == parts:
                    places.append(at)
                    base.add(label)
    found = detections(words)
    labels = base | {d[3] for d in found}
    score = max([d[2] for d in found] + [60] * bool(base), default=0) / 100
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def _scan(batches):
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    names = [c.split()[0] for c in _SCHEMA.split(", ")]
    for batch in batches:
        rows = [scan(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(types)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document; see ``_SCHEMA``. No shuffle.

    Null and empty texts have no words and no labels, score 0. Null ids and repeated rows
    are scanned like any other row; texts of any length are scanned whole. Of equal intervals the
    higher priority stays, at equal priority all labels. Other columns are not read. Equal detections of several
    rules count once. Empty input gives no rows.
    """
    return id_and_text(docs, id_col, text_col).mapInArrow(_scan, _SCHEMA)
