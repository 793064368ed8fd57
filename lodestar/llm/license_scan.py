"""License scans: ordered signature rules behind a keyword prefilter.

Every rule is a regular expression over the lower-cased (A-Z) text, with a
label, a priority and a confidence. A rule is tried only where its keyword
occurs, which is a part of whatever the rule matches. Overlapping detections are resolved by priority, then length, then
place: one whose interval lies within an accepted one is suppressed.

Beside that the base scan: all places where the words of three licence names
stand consecutively. Its labels are always part of the labels; suppression
concerns the rules' own. score is the highest confidence of what was found,
0 where nothing was.

A null text is empty: no words, no labels. Repeated rows are scanned each, whatever their
id; of the same place the first label by name stays. Texts of any length are scanned whole, in time
that grows with the text and its finds. An empty table gives an empty one; other columns play
no part, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..runtime import shipped, table
from .scan import slices, text_bytes, word_spans

#: The base phrases.
BASE = ((b"mit", b"license"), (b"apache", b"license"), (b"general", b"public", b"license"))
BASE_LABELS = ("mit", "apache", "gpl")
BASE_CONFIDENCE = 0.7

_BREAK = np.ones(256, bool)
_BREAK[128:] = False
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: bytes
    pattern: re.Pattern[bytes]
    priority: int
    confidence: float


# Hand-written signatures: label: keyword: patterns. A space stands for white space of any length,
# "v" before a number for an optional "version"/"v". Longer texts and explicit grants come with
# higher priority than names, names than links.
_GRANTS = r"(?:licensed|released|distributed|available|provided|published|covered|redistributed)(?: and made available)? (?:under|by|subject to)(?: the)?(?: terms of)?(?: the)?"

_NAMES = r"""
mit | mit | mit licen[cs]e ; mit/x11 license ; mit-style license ; the mit licen[cs]e \(mit\) ; x11 license ; expat license
mit-0 | mit | mit no attribution ; mit-0 license
apache-2.0 | apache | apache(?: software)? license,? v2(?:\.0)? ; apache-2\.0 ; asl 2\.0
apache-1.1 | apache | apache(?: software)? license,? v1\.1 ; apache-1\.1
apache-1.0 | apache | apache(?: software)? license,? v1\.0
apache | apache | apache(?: software)? license
gpl-3.0 | general public | gnu general public license,? v3(?:\.0)? ; general public license \(gpl\),? v3 ; version 3 of the gnu general public license
gpl-3.0 | gpl | gplv3 ; gpl-3\.0(?:-only|-or-later)? ; gnu gpl,? v3
gpl-2.0 | general public | gnu general public license,? v2(?:\.0)? ; version 2 of the gnu general public license
gpl-2.0 | gpl | gplv2 ; gpl-2\.0(?:-only|-or-later)? ; gnu gpl,? v2
gpl-1.0 | general public | gnu general public license,? v1
gpl | general public | (?:gnu )?general public license
gpl | gpl | gnu gpl ; \bgpl license
lgpl-3.0 | lesser | gnu lesser general public license,? v3(?:\.0)? ; lgplv3 ; lgpl-3\.0
lgpl-2.1 | lesser | gnu lesser general public license,? v2\.1 ; lgplv2\.1 ; lgpl-2\.1
lgpl-2.0 | library general | gnu library general public license,? v2
lgpl | lesser | (?:gnu )?lesser general public license
lgpl | lgpl | \blgpl\b ; lgplv3 ; lgpl-3\.0 ; lgplv2\.1 ; lgpl-2\.1
agpl-3.0 | affero | gnu affero general public license,? v3(?:\.0)? ; agplv3 ; agpl-3\.0
agpl-3.0 | agpl | agplv3 ; agpl-3\.0(?:-only|-or-later)?
agpl | affero | (?:gnu )?affero general public license
bsd-2-clause | bsd | bsd 2-clause(?: license)? ; 2-clause bsd(?: license)? ; simplified bsd license ; freebsd license ; bsd-2-clause
bsd-3-clause | bsd | bsd 3-clause(?: license)? ; 3-clause bsd(?: license)? ; new bsd license ; modified bsd license ; revised bsd license ; bsd-3-clause
bsd-4-clause | bsd | bsd 4-clause(?: license)? ; 4-clause bsd(?: license)? ; original bsd license
0bsd | bsd | zero-clause bsd(?: license)? ; bsd zero clause(?: license)? ; \b0bsd\b
bsd | bsd | bsd-style license ; \bbsd license
isc | isc | \bisc license ; internet systems consortium license
mpl-2.0 | mozilla | mozilla public license,? v2(?:\.0)? ; mpl-2\.0
mpl-1.1 | mozilla | mozilla public license,? v1\.1 ; mpl-1\.1
mpl-1.0 | mozilla | mozilla public license,? v1\.0
mpl | mozilla | mozilla public license
mpl-2.0 | mpl | \bmpl-2\.0 ; \bmpl 2\.0
epl-2.0 | eclipse | eclipse public license,? v2(?:\.0)? ; epl-2\.0
epl-1.0 | eclipse | eclipse public license,? v1(?:\.0)? ; epl-1\.0
epl | eclipse | eclipse public license
edl-1.0 | eclipse | eclipse distribution license
cddl-1.1 | common development | common development and distribution license(?: \(cddl\))?,? v1\.1
cddl-1.0 | common development | common development and distribution license(?: \(cddl\))?,? v1\.0
cddl | common development | common development and distribution license
cpl-1.0 | common public | common public license,? v1\.0 ; common public license
ipl-1.0 | ibm public | ibm public license
eupl-1.2 | european union public | european union public licen[cs]e,? v1\.2
eupl | european union public | european union public licen[cs]e
artistic-2.0 | artistic | artistic license,? v2(?:\.0)?
artistic-1.0 | artistic | artistic license,? v1(?:\.0)?
artistic | artistic | artistic license ; clarified artistic license
bsl-1.0 | boost | boost software license(?:,? v1\.0)?
busl-1.1 | business source | business source license(?: 1\.1)?
sspl-1.0 | server side | server side public license
elastic-2.0 | elastic | elastic license(?: 2\.0)?
unlicense | unlicense | the unlicense ; \bunlicense\b
wtfpl | do what the | do what the f\*?[a-z]*\*? you want to public license
zlib | zlib | zlib license ; zlib/libpng license
libpng | libpng | libpng license
openssl | openssl | openssl license
python-2.0 | python | python software foundation license(?:,? v2)? ; psf license
ruby | ruby | ruby license
php-3.01 | php | php license,? v3\.01 ; php license
postgresql | postgresql | postgresql licen[cs]e
ncsa | ncsa | university of illinois/ncsa open source license ; ncsa license
osl-3.0 | open software | open software license,? v3\.0 ; open software license
afl-3.0 | academic free | academic free license(?:,? v3\.0)?
ms-pl | microsoft public | microsoft public license
ms-rl | microsoft reciprocal | microsoft reciprocal license
ofl-1.1 | open font | sil open font license(?:,? v1\.1)? ; open font license
gfdl-1.3 | free documentation | gnu free documentation license,? v1\.3
gfdl | free documentation | gnu free documentation license ; \bgfdl\b
odbl-1.0 | open database | open database license(?: v1\.0)? ; odbl
odc-by | open data commons | open data commons attribution license
pddl | open data commons | open data commons public domain dedication and license
cc0-1.0 | cc0 | cc0(?: 1\.0)?(?: universal)?
cc0-1.0 | creative commons | creative commons zero(?: v?1\.0)?
cc-by-nc-nd | cc | \bcc[ -]by-nc-nd(?: ?[1-4]\.[05])?
cc-by-nc-sa | cc | \bcc[ -]by-nc-sa(?: ?[1-4]\.[05])?
cc-by-nc | cc | \bcc[ -]by-nc(?: ?[1-4]\.[05])?
cc-by-nd | cc | \bcc[ -]by-nd(?: ?[1-4]\.[05])?
cc-by-sa | cc | \bcc[ -]by-sa(?: ?[1-4]\.[05])?
cc-by | cc | \bcc[ -]by(?: ?[1-4]\.[05])?
cc-by-nc-nd | creative commons | creative commons attribution[ -]non-?commercial[ -]no-?deriv(?:ative)?s
cc-by-nc-sa | creative commons | creative commons attribution[ -]non-?commercial[ -]share-?alike
cc-by-nc | creative commons | creative commons attribution[ -]non-?commercial
cc-by-nd | creative commons | creative commons attribution[ -]no-?deriv(?:ative)?s
cc-by-sa | creative commons | creative commons attribution[ -]share-?alike
cc-by | creative commons | creative commons attribution
cc | creative commons | creative commons licen[cs]e
public-domain | public domain | (?:released|placed|dedicated) (?:in)?to the public domain ; in the public domain
proprietary | all rights | all rights reserved
proprietary | confidential | proprietary and confidential ; confidential and proprietary
proprietary | commercial | commercial license ; not for commercial use
llama | llama | llama [234](?:\.[0-9])? community license
openrail | openrail | (?:creativeml |bigscience )?open ?rail(?:[ +-]?[msda])* licen[cs]e ; openrail
gemma | gemma | gemma terms of use
"""

_TEXTS = r"""
mit | permission is hereby | permission is hereby granted, free of charge, to any person obtaining a copy
mit | the above copyright | the above copyright notice and this permission notice shall be included
isc | permission to use | permission to use, copy, modify, and/?(?:or)? distribute this software for any purpose with or without fee is hereby granted
bsd | redistribution and use | redistribution and use in source and binary forms, with or without modification, are permitted
bsd-3-clause | neither the name | neither the name of .{1,80}? nor the names of (?:its|their) contributors
bsd-4-clause | advertising materials | all advertising materials mentioning features or use of this software
bsd-2-clause | redistributions in binary | redistributions in binary form must reproduce the above copyright notice
apache-2.0 | you may not use | you may not use this file except in compliance with the license
apache-2.0 | unless required by | unless required by applicable law or agreed to in writing, software
apache-2.0 | terms and conditions for | terms and conditions for use, reproduction, and distribution
gpl | this program is free | this program is free software[;:,] you can redistribute it and/or modify
gpl-3.0 | either version 3 | either version 3 of the license, or \(at your option\) any later version
gpl-2.0 | either version 2 | either version 2 of the license, or \(at your option\) any later version
lgpl-2.1 | either version 2.1 | either version 2\.1 of the license, or \(at your option\) any later version
gpl | everyone is permitted | everyone is permitted to copy and distribute verbatim copies
gpl | without any warranty | without even the implied warranty of merchantability or fitness for a particular purpose
gpl | you should have received | you should have received a copy of the gnu general public license
lgpl | you should have received | you should have received a copy of the gnu lesser general public license
agpl | you should have received | you should have received a copy of the gnu affero general public license
agpl-3.0 | remote network | remote network interaction; use with the gnu general public license
lgpl | this library is free | this library is free software[;:,] you can redistribute it and/or modify
mpl-2.0 | subject to the terms | this source code form is subject to the terms of the mozilla public license, v\. 2\.0
mpl-1.1 | contents of this file | the contents of this file are subject to the mozilla public license
cddl | contents of this file | the contents of this file are subject to the terms of the common development
epl | accompanying materials | this program and the accompanying materials are made available under the terms of the eclipse
bsl-1.0 | permission is hereby | permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software
zlib | as-is | this software is provided 'as-is', without any express or implied warranty
zlib | altered source | altered source versions must be plainly marked as such
unlicense | unencumbered | this is free and unencumbered software released into the public domain
wtfpl | you just do | you just do what the f
artistic | the intent of this | the intent of this document is to state the conditions under which a package may be copied
ofl-1.1 | reserved font | reserved font name
python-2.0 | beopen | beopen python open source license agreement
openssl | openssl toolkit | software developed by the openssl project for use in the openssl toolkit
php-3.01 | php software | this product includes php software
postgresql | portions copyright | portions copyright \(c\) .{1,60}? regents of the university of california
cc0-1.0 | statement of purpose | the laws of most jurisdictions throughout the world automatically confer exclusive copyright
cc-by | you are free to | you are free to:? share
public-domain | no copyright | no copyright is asserted ; the author disclaims copyright to this source code
proprietary | unauthorized copying | unauthorized copying of this file, via any medium,? is strictly prohibited
proprietary | without the prior | without the prior written (?:permission|consent) of
busl-1.1 | change date | change date: .{1,40}? change license
sspl-1.0 | making the functionality | making the functionality of the program or a modified version available to third parties as a service
"""

_LINKS = r"""
mit | opensource.org | opensource\.org/licenses?/mit
apache-2.0 | apache.org | apache\.org/licenses/license-2\.0
apache-2.0 | opensource.org | opensource\.org/licenses?/apache-2\.0
gpl-3.0 | gnu.org | gnu\.org/licenses/gpl-3\.0
gpl-2.0 | gnu.org | gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0
gpl | gnu.org | gnu\.org/(?:licenses|copyleft)/gpl
lgpl | gnu.org | gnu\.org/(?:licenses|copyleft)/lgpl
agpl-3.0 | gnu.org | gnu\.org/licenses/agpl
gfdl | gnu.org | gnu\.org/(?:licenses|copyleft)/fdl
gpl | gnu.org | gnu\.org/licenses/?
bsd-3-clause | opensource.org | opensource\.org/licenses?/bsd-3-clause
bsd-2-clause | opensource.org | opensource\.org/licenses?/bsd-2-clause
isc | opensource.org | opensource\.org/licenses?/isc
mpl-2.0 | mozilla.org | mozilla\.org/mpl/2\.0
mpl | mozilla.org | mozilla\.org/mpl
epl-2.0 | eclipse.org | eclipse\.org/legal/epl-2\.0 ; eclipse\.org/legal/epl-v20
epl-1.0 | eclipse.org | eclipse\.org/legal/epl-v10
bsl-1.0 | boost.org | boost\.org/license_1_0
unlicense | unlicense.org | unlicense\.org
wtfpl | wtfpl.net | wtfpl\.net
ofl-1.1 | scripts.sil.org | scripts\.sil\.org/ofl
cc0-1.0 | creativecommons.org | creativecommons\.org/publicdomain/zero
public-domain | creativecommons.org | creativecommons\.org/publicdomain/mark
cc-by-nc-nd | creativecommons.org | creativecommons\.org/licenses/by-nc-nd
cc-by-nc-sa | creativecommons.org | creativecommons\.org/licenses/by-nc-sa
cc-by-nc | creativecommons.org | creativecommons\.org/licenses/by-nc
cc-by-nd | creativecommons.org | creativecommons\.org/licenses/by-nd
cc-by-sa | creativecommons.org | creativecommons\.org/licenses/by-sa
cc-by | creativecommons.org | creativecommons\.org/licenses/by
cc | creativecommons.org | creativecommons\.org/licenses
odbl-1.0 | opendatacommons.org | opendatacommons\.org/licenses/odbl
odc-by | opendatacommons.org | opendatacommons\.org/licenses/by
"""


def _lines(block: str) -> Iterator[tuple[str, str, list[str]]]:
    for line in block.strip().splitlines():
        label, keyword, patterns = line.split(" | ", 2)
        # white space may be of any length, so the filter looks for the longest word only
        yield label, max(keyword.split(), key=len), patterns.split(" ; ")


def _compiled(pattern: str) -> re.Pattern[bytes]:
    p = re.sub(r",\? v(?=\d)", r",?(?: version| v\\.?)? ?", pattern)
    p = re.sub(r"(?<=\w) v(?=\d)", r"(?: version| v\\.?)? ?", p)
    return re.compile(re.sub(r" (?!\?)", r"\\s+", p.replace(" ?", r"\s*")).encode(), re.DOTALL)


#: Words too frequent to filter by, unless a pattern has no other.
_FREQUENT = {b"license", b"licen", b"general", b"public", b"software", b"version", b"the", b"of"}


def _literals(parsed) -> Iterator[bytes]:
    """The runs of bytes that every match of a parsed pattern has."""
    run = b""
    for op, arg in parsed:
        if op is _parser.LITERAL:
            run += bytes([arg])
            continue
        yield run
        run = b""
        if op is _parser.SUBPATTERN:
            yield from _literals(arg[-1])
        elif op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT) and arg[0]:
            yield from _literals(arg[2])
    yield run


def _keyword(keyword: str, pattern: re.Pattern[bytes]) -> bytes:
    """keyword, if every match of pattern has it, otherwise the longest run that every match has."""
    own = list(_literals(_parser.parse(pattern.pattern, pattern.flags)))
    if any(keyword.encode() in x for x in own):
        return keyword.encode()
    return max(own, key=lambda x: (x not in _FREQUENT, len(x)) if x else (False, 0))


def _rule(label: str, keyword: str, pattern: str, priority: int, confidence: float) -> Rule:
    p = _compiled(pattern)
    return Rule(label, _keyword(keyword, p), p, priority, confidence)


def rules() -> list[Rule]:
    """Priority 5: an identifier tag, 4: licence text, 3: an explicit grant by name, 2: a name, 1: a link."""
    out = []
    for label, keyword, patterns in _lines(_TEXTS):
        out += [_rule(label, keyword, p, 4, 0.95) for p in patterns]
    labels = []
    for label, keyword, patterns in _lines(_NAMES):
        labels.append(label)
        for p in patterns:
            out.append(_rule(label, keyword, f"{_GRANTS} {p}", 3, 0.9))
            out.append(_rule(label, keyword, p, 2, 0.6))
    for label, keyword, patterns in _lines(_LINKS):
        out += [_rule(label, keyword, p, 1, 0.8) for p in patterns]
    for label in dict.fromkeys(labels):
        tag = rf"spdx-license-identifier: ?\(?{re.escape(label)}(?:-only|-or-later|\+)?(?![\w.-])"
        out.append(_rule(label, "spdx-license", tag, 5, 1.0))
    return out


class Scanner:
    """Rules grouped by keyword; all methods take the lower-cased bytes of a text."""

    def __init__(self, own: list[Rule] | None = None):
        self.by_keyword: dict[bytes, list[Rule]] = {}
        for r in rules() if own is None else own:
            self.by_keyword.setdefault(r.keyword, []).append(r)

    def detections(self, low: bytes) -> list[tuple[int, int, Rule]]:
        """Accepted (start, end, rule), in order of place."""
        found = []
        for keyword, own in self.by_keyword.items():
            if keyword in low:
                found += [(m.start(), m.end(), r) for r in own for m in r.pattern.finditer(low)]
        # whatever holds a find comes before it; of the same place the first by priority and label
        found.sort(key=lambda x: (x[0], -x[1], -x[2].priority, x[2].label))
        kept: list[tuple[int, int, Rule]] = []
        ends = [-1] * (1 + max((r.priority for *_, r in found), default=0))
        for x in found:
            # a find within one of no lesser priority goes; so does what lies in a find that went
            if max(ends[x[2].priority :]) < x[1]:
                kept.append(x)
            ends[x[2].priority] = max(ends[x[2].priority], x[1])
        return sorted(kept, key=lambda x: x[:2])

    def scan(self, low: bytes) -> tuple[list[tuple[int, int]], list[tuple[int, int, Rule]]]:
        """((word, base phrase) of all base places, detections)."""
        places = []
        if b"license" in low:
            words = _WORDS.findall(low)
            for i in [i for i, w in enumerate(words) if w == b"license"]:
                for k, p in enumerate(BASE):
                    if i + 1 >= len(p) and tuple(words[i + 1 - len(p) : i + 1]) == p:
                        places.append((i + 1 - len(p), k))
        return places, self.detections(low)


_KINDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<start:int,end:int,label:string,confidence:double>>"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, the base scan, labels, score, and the detections with their byte ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            for part in slices(batch, "text"):
                data, off = text_bytes(part.column("text"))
                n = np.diff(word_spans(data, off, _BREAK)[2])
                low = data.tobytes().lower()
                rows = []
                for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                    places, found = scanner.scan(low[a:b])
                    at = [x for x, _ in places]
                    base = {BASE_LABELS[k] for _, k in places}
                    labels = base | {r.label for *_, r in found}
                    score = max([BASE_CONFIDENCE] * bool(base) + [r.confidence for *_, r in found], default=0.0)
                    rows.append((len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, [{"start": s, "end": e, "label": r.label, "confidence": r.confidence} for s, e, r in found]))
                cols = list(zip(*rows, strict=True))
                hits = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("confidence", pa.float64())]))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), hits)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]],
                    names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"],
                )

    return shipped(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id long, {_KINDS}")


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("detections")
