"""Operator 4, license scans by sentence rules.

A text is cut into sentences at line ends and after . ! ? or ; before white space; lines that
follow each other without such an end between them are also joined, as wrapped sentences
are, and what begins at a line's start is the longest known sentence there. Up to six words may lead a known sentence, as a label or a subject
does ("License:", "This file is"), unless one of them denies it ("not"); of these places the first that begins a known sentence counts. Markup
tags are line ends, comment leaders (#, *, //, ;) no words. A sentence is normalised (A-Z as a-z; quotes and brackets dropped, other runs of characters
than letters, digits and + as one space, but for dots between digits, which stay)
and looked up among the known licence sentences, which gives the document's sequence of
sentence identifiers; other sentences between them don't break a sequence, as licence
texts are wrapped and interleaved freely. The rules are tried in their order, longer
sequences of a licence before its shorter ones; each takes every place where its
sequence stands in what earlier rules have left, and identifiers that no rule takes are
reported as left over, "All rights reserved." among them, which is no licence and stands in most licence files.

Edge cases: null text has no sentences; a text of any length is scanned in one piece, in time in proportion to it; a licence that stands several times is reported
once in `licenses` and counted in `n_matches`; rows repeat as they are; an empty table
gives an empty result; other columns are ignored. One pass, no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import table, text_bytes

#: Known sentences, as they are written.
SENTENCES = {
    "mit-short": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software."],
    "mit-warranty": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."],
    "mit-liability": ["IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "apache2-short": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\");", "Released under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "apache2-use": ["you may not use this file except in compliance with the License."],
    "apache2-copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"],
    "apache2-basis": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "apache2-see": ["See the License for the specific language governing permissions and limitations under the License."],
    "apache2-grant": ["Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."],
    "apache2-redistribution": ["You may reproduce and distribute copies of the Work or Derivative Works thereof in any medium, with or without modifications, and in Source or Object form, provided that You meet the following conditions:"],
    "gpl2-short": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"],
    "gpl3-short": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"],
    "gpl-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gnu-program": ["This program is free software;"],
    "gnu-library": ["This library is free software;"],
    "gpl-terms": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;"],
    "lgpl-terms": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;"],
    "gnu-version-2": ["either version 2 of the License, or (at your option) any later version."],
    "gnu-version-2.1": ["either version 2.1 of the License, or (at your option) any later version."],
    "gpl-warranty": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"],
    "gpl-fitness": ["without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "gpl-see": ["See the GNU General Public License for more details."],
    "lgpl-see": ["See the GNU Lesser General Public License for more details."],
    "gnu-verbatim": ["Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."],
    "gpl3-title": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "gpl3-preamble": ["The GNU General Public License is a free, copyleft license for software and other kinds of works."],
    "gpl2-title": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "gpl2-preamble": ["The licenses for most software are designed to take away your freedom to share and change it."],
    "lgpl3-title": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "lgpl3-short": ["This work is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only"],
    "bsd-redistribute": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd-endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "bsd-warranty": ["THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."],
    "bsd-short": ["Licensed under the BSD License.", "Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "mpl2-short": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, Version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "mpl2-copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "mpl2-title": ["Mozilla Public License Version 2.0"],
    "mpl2-grant": ["Each Contributor hereby grants You a world-wide, royalty-free, non-exclusive license:"],
    "cc-by-short": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc-short": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa-short": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc0-short": ["Released under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "isc-warranty": ["THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."],
    "unlicense-short": ["This is free and unencumbered software released into the public domain."],
    "unlicense-grant": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "gnu-only-2": ["version 2 of the License."],
    "gpl2-only-terms": ["you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", "you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2, as published by the Free Software Foundation."],
    "agpl-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "agpl-see": ["See the GNU Affero General Public License for more details."],
    "agpl3-title": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "agpl3-preamble": ["The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."],
    "agpl3-short": ["Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"],
    "lgpl21-title": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "lgpl21-short": ["Licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-only"],
    "epl-notice": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License v."],
    "epl2-where": ["2.0 which is available at https://www.eclipse.org/legal/epl-2.0.", "2.0 which is available at http://www.eclipse.org/legal/epl-2.0."],
    "epl2-short": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "Licensed under the Eclipse Public License 2.0.", "SPDX-License-Identifier: EPL-2.0"],
    "epl2-title": ["Eclipse Public License - v 2.0"],
    "zlib-as-is": ["This software is provided 'as-is', without any express or implied warranty."],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "bsl1-title": ["Boost Software License - Version 1.0 - August 17th, 2003"],
    "bsl1-grant": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"],
    "bsl1-short": ["Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"],
    "artistic2-title": ["The Artistic License 2.0"],
    "artistic2-purpose": ["This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed."],
    "cddl1-title": ["COMMON DEVELOPMENT AND DISTRIBUTION LICENSE (CDDL) Version 1.0"],
    "cddl-notice": ["The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\")."],
    "ofl-short": ["This Font Software is licensed under the SIL Open Font License, Version 1.1.", "SPDX-License-Identifier: OFL-1.1"],
    "ofl-title": ["SIL OPEN FONT LICENSE Version 1.1 - 26 February 2007"],
    "ofl-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of the Font Software, to use, study, copy, merge, embed, modify, redistribute, and sell modified and unmodified copies of the Font Software, subject to the following conditions:"],
    "reserved": ["All rights reserved."],
}

#: Licence, and the sequence of sentences that tells it.
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("MIT", ["mit-grant"]),
    ("MIT", ["mit-short"]),
    ("Apache-2.0", ["apache2-short", "apache2-use", "apache2-copy", "apache2-basis", "apache2-see"]),
    ("Apache-2.0", ["apache2-short", "apache2-use", "apache2-copy", "apache2-basis"]),
    ("Apache-2.0", ["apache2-short", "apache2-use", "apache2-copy"]),
    ("Apache-2.0", ["apache2-short", "apache2-use"]),
    ("Apache-2.0", ["apache2-grant", "apache2-redistribution"]),
    ("Apache-2.0", ["apache2-short"]),
    ("GPL-3.0", ["gpl3-title", "gnu-verbatim", "gpl3-preamble"]),
    ("GPL-2.0", ["gpl2-title", "gnu-verbatim", "gpl2-preamble"]),
    ("LGPL-3.0", ["lgpl3-title", "gnu-verbatim"]),
    ("LGPL-2.1", ["lgpl21-title", "gnu-verbatim", "gpl2-preamble"]),
    ("LGPL-2.1", ["lgpl21-title", "gnu-verbatim"]),
    ("AGPL-3.0", ["agpl3-title", "gnu-verbatim", "agpl3-preamble"]),
    ("AGPL-3.0", ["agpl3-title", "gnu-verbatim"]),
    ("AGPL-3.0-or-later", ["agpl-free", "gpl-warranty", "gpl-fitness", "agpl-see"]),
    ("AGPL-3.0-or-later", ["agpl-free", "gpl-warranty"]),
    ("AGPL-3.0-or-later", ["agpl-free"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-warranty", "gpl-fitness", "gpl-see"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-warranty"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("GPL-2.0-or-later", ["gnu-program", "gpl-terms", "gnu-version-2", "gpl-warranty", "gpl-fitness", "gpl-see"]),
    ("GPL-2.0-or-later", ["gnu-program", "gpl-terms", "gnu-version-2"]),
    ("GPL-2.0-only", ["gnu-program", "gpl-terms", "gnu-only-2", "gpl-warranty", "gpl-fitness", "gpl-see"]),
    ("GPL-2.0-only", ["gnu-program", "gpl-terms", "gnu-only-2"]),
    ("GPL-2.0-only", ["gnu-program", "gpl2-only-terms", "gpl-warranty", "gpl-fitness", "gpl-see"]),
    ("GPL-2.0-only", ["gnu-program", "gpl2-only-terms"]),
    ("LGPL-2.1-or-later", ["gnu-library", "lgpl-terms", "gnu-version-2.1", "gpl-warranty", "gpl-fitness", "lgpl-see"]),
    ("LGPL-2.1-or-later", ["gnu-library", "lgpl-terms", "gnu-version-2.1"]),
    ("GPL-3.0", ["gpl3-short"]),
    ("GPL-2.0", ["gpl2-short"]),
    ("LGPL-3.0", ["lgpl3-short"]),
    ("LGPL-2.1", ["lgpl21-short"]),
    ("AGPL-3.0", ["agpl3-short"]),
    ("BSD-3-Clause", ["bsd-redistribute", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty"]),
    ("BSD-3-Clause", ["bsd-redistribute", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-redistribute", "bsd-source", "bsd-binary", "bsd-warranty"]),
    ("BSD-2-Clause", ["bsd-redistribute", "bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", ["bsd-redistribute", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-redistribute"]),
    ("BSD-3-Clause", ["bsd-short"]),
    ("MPL-2.0", ["mpl2-short", "mpl2-copy"]),
    ("MPL-2.0", ["mpl2-title", "mpl2-grant"]),
    ("MPL-2.0", ["mpl2-short"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-short"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-short"]),
    ("CC-BY-4.0", ["cc-by-short"]),
    ("CC0-1.0", ["cc0-short"]),
    ("ISC", ["isc-grant", "isc-warranty"]),
    ("ISC", ["isc-grant"]),
    ("Unlicense", ["unlicense-short", "unlicense-grant"]),
    ("Unlicense", ["unlicense-short"]),
    ("EPL-2.0", ["epl-notice", "epl2-where"]),
    ("EPL-2.0", ["epl2-short"]),
    ("EPL-2.0", ["epl2-title"]),
    ("Zlib", ["zlib-as-is", "zlib-grant"]),
    ("Zlib", ["zlib-grant"]),
    ("BSL-1.0", ["bsl1-title", "bsl1-grant"]),
    ("BSL-1.0", ["bsl1-grant"]),
    ("BSL-1.0", ["bsl1-short"]),
    ("Artistic-2.0", ["artistic2-title", "gnu-verbatim", "artistic2-purpose"]),
    ("Artistic-2.0", ["artistic2-purpose"]),
    ("CDDL-1.0", ["cddl1-title"]),
    ("CDDL", ["cddl-notice"]),
    ("OFL-1.1", ["ofl-short", "ofl-title", "ofl-grant"]),
    ("OFL-1.1", ["ofl-title", "ofl-grant"]),
    ("OFL-1.1", ["ofl-short"]),
    ("OFL-1.1", ["ofl-grant"]),
]

_PARTS = re.compile(rb"([\n\r]+)|(?<=[.!?;])[\x20\t\x0b\x0c]+")  # group 1: a line end
_CUT = re.compile(rb"[\n\r]+|(?<=[.!?;])[\x20\t\x0b\x0c]+")
_TAG = re.compile(rb"</?[a-zA-Z][^<>]{0,500}>")
LEADER = 6  # words that may come before a sentence: a label ("License:"), a subject ("This file is"), a number
_DENIED = {b"not", b"never", b"no", b"isnt", b"cannot", b"without"}
_DROP = b"\"'()[]"
_LOWER = bytes(range(256)).lower()
_REST = re.compile(rb"(?:(?!(?<=[0-9])\.(?=[0-9]))[^a-z0-9+])+")


def normalise(sentence: bytes) -> bytes:
    return _REST.sub(b" ", sentence.translate(_LOWER, _DROP)).strip()


class Scanner:
    def __init__(self, sentences: dict[str, list[str]], rules: list[tuple[str, list[str]]]):
        self.known: dict[bytes, str] = {}
        for name, texts in sentences.items():
            for text in texts:
                for key in {normalise(text.encode()), *(normalise(x) for x in _CUT.split(text.encode())[:1])}:
                    self.known.setdefault(key, name)
        self.begun = {b" ".join(words[:n]) for words in map(bytes.split, self.known) for n in range(1, len(words))}
        self.rules = rules
        # a cheap test that loses nothing: the first word of each known sentence, followed by its second, in the text
        # as it is before runs of other characters become spaces
        starts = {b" ".join(k.split()[:2]) for k in self.known}
        self.starts = starts
        self.start = re.compile(b"|".join(rb"[^a-z0-9+]+".join(map(re.escape, s.split())) for s in sorted(starts)))

    def begins(self, part: bytes) -> Iterator[bytes]:
        """The part itself, then what is left of it after up to LEADER words, as far as these don't deny it."""
        yield part
        rest = part
        for _ in range(LEADER):
            word, _, rest = rest.partition(b" ")
            if not rest or word in _DENIED:
                return
            two = rest.split(b" ", 2)[:2]
            if (two[0] in self.begun) if len(two) == 1 else b" ".join(two) in self.starts:
                yield rest

    def identifiers(self, text: bytes) -> list[str]:
        if b"<" in text:
            text = _TAG.sub(b"\n", text)
        if not self.start.search(text.translate(_LOWER, _DROP)):
            return []
        out = []
        cut = _PARTS.split(text)
        parts, at_line_end = [], []  # normalised; whether a part ends where its line does, not its sentence
        for sentence, line_end in zip(cut[::2], [*cut[1::2], None], strict=True):
            words = normalise(sentence)
            if words:  # a comment leader alone is none
                parts.append(words)
                at_line_end.append(line_end is not None)
        at = 0
        while at < len(parts):
            after = at + 1
            for begin in self.begins(parts[at]):
                joined, end, name = begin, at + 1, self.known.get(begin)
                while joined in self.begun and at_line_end[end - 1] and end < len(parts):
                    joined = joined + b" " + parts[end]
                    end += 1
                    if joined in self.known:
                        name, after = self.known[joined], end
                if name is not None:
                    out.append(name)
                    break
            at = after
        return out

    def match(self, names: list[str]) -> tuple[list[str], int, list[str]]:
        """Licences in order of first place, number of matches, identifiers left over."""
        found: dict[int, str] = {}
        left: list[str | None] = list(names)
        for licence, sequence in self.rules:
            at = 0
            while at + len(sequence) <= len(left):
                if left[at : at + len(sequence)] == sequence:
                    left[at : at + len(sequence)] = [None] * len(sequence)
                    found[at] = licence
                    at += len(sequence)
                else:
                    at += 1
        return list(dict.fromkeys(found[k] for k in sorted(found))), len(found), [x for x in left if x is not None]


_scanner: list[Scanner] = []


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if not _scanner:
        _scanner.append(Scanner(SENTENCES, RULES))
    tool = _scanner[0]
    for batch in batches:
        names = [tool.identifiers(x) for x in batch.column("text").to_pylist()]
        got = [tool.match(x) for x in names]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([",".join(x) for x, _, _ in got], pa.string()),
                pa.array([n for _, n, _ in got], pa.int64()),
                pa.array([",".join(x) for x in names], pa.string()),
                pa.array([",".join(x) for _, _, x in got], pa.string()),
            ],
            ["doc_id", "licenses", "n_matches", "sentences", "left_over"],
        )


def scan(docs: DataFrame) -> DataFrame:
    """For each row of docs: doc_id, licenses, n_matches, sentences (identifiers in order), left_over."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return rows.mapInArrow(_scan, "doc_id long, licenses string, n_matches long, sentences string, left_over string")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
