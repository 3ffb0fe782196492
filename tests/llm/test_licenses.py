import random
import re
import textwrap

import pytest

from corpusloom.llm import licenses
from tests.llm import data

TOOL = licenses.Scanner(licenses.SENTENCES, licenses.RULES)


def found(text):
    return TOOL.match(TOOL.identifiers(text.encode()))


def test_every_known_sentence_is_recognised():
    for name, texts in licenses.SENTENCES.items():
        for t in texts:
            for form in (t, t.upper(), f"Before it. {t}{chr(10) * (t[-1] not in '.;')} After it.", f"x\n{t.replace(' ', '  ')}\ny"):
                assert name in TOOL.identifiers(form.encode()), (name, form)


def test_sequences():
    s = {k: v[0] for k, v in licenses.SENTENCES.items()}
    mit = "\n".join((s["mit-grant"], "filler words", s["mit-notice"], s["mit-warranty"]))
    assert found(mit) == (["MIT"], 1, [])
    assert found(s["mit-warranty"]) == ([], 0, ["mit-warranty"])
    assert found("\n".join((s["bsd-redistribute"], s["bsd-endorse"]))) == (["BSD-3-Clause"], 1, [])
    assert found(s["bsd-redistribute"]) == (["BSD-2-Clause"], 1, [])
    assert found(f"{s['mit-short']} {s['gpl3-short']} {s['mit-short']}") == (["MIT", "GPL-3.0"], 3, [])


@pytest.mark.parametrize("leader", ["", "# ", " * ", "// ", ";; ", "\t"])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("width", [30, 60, 76])
def test_wrapped_sentences(leader, end, width):
    for name, texts in licenses.SENTENCES.items():
        for t in texts:
            lines = ["Copyright (c) 2020 Somebody", "", *textwrap.wrap(t, width, break_long_words=False, break_on_hyphens=False), "", "other words"]
            assert name in TOOL.identifiers(end.join(leader + x for x in lines).encode()), (name, t)


def test_wrapped_licences():
    s = {k: textwrap.fill(v[0], 70) for k, v in licenses.SENTENCES.items()}
    assert found(f"MIT License\n\n{s['mit-grant']}\n\n{s['mit-notice']}\n\n{s['mit-warranty']} IN NO EVENT\nSHALL") == (["MIT"], 1, [])
    bsd = f"{s['bsd-redistribute']}\n\n1. Redistributions of source code must retain the above notice.\n\n3. {s['bsd-endorse']}\n"
    assert found(bsd) == (["BSD-3-Clause"], 1, [])
    assert found(f"/*\n{textwrap.indent(s['gpl-free'], ' * ')}\n *\n{textwrap.indent(s['gpl-warranty'], ' * ')} without even the\n * implied warranty") == (["GPL-3.0-or-later"], 1, [])
    assert found(f"{s['isc-grant']}") == (["ISC"], 1, [])


def test_lines_between_are_no_part_of_a_sentence():
    for t in ("Released under\nno terms but\nthe MIT License.", "Released under. the MIT License.", "not Released under\nthe MIT License."):
        assert found(t) == ([], 0, [])
    assert found("Licensed under\nReleased under the MIT License.\nAll rights\nreserved.") == (["MIT"], 1, ["reserved"])


def brute(text):
    """The longest known sentence that starts at each part, by trying every one on the words that follow."""
    known = {}
    for name, forms in licenses.SENTENCES.items():
        for form in forms:
            for key in (form, re.split(r"(?<=[.!?;])[ \t]+", form)[0]):
                known.setdefault(tuple(_words(key)), name)
    parts = []  # words, and whether the part ends with its line
    for line in re.split(r"[\r\n]+", text):
        cut = re.split(r"(?<=[.!?;])[ \t\x0b\x0c]+", line)
        parts += [(_words(x), k == len(cut) - 1) for k, x in enumerate(cut)]
    parts = [(w, e) for w, e in parts if w]
    out, at = [], 0
    while at < len(parts):
        best, own = None, parts[at][0]
        for k in range(min(len(own), 7)):  # words before the sentence
            if k and own[k - 1] in ("not", "never", "no", "isnt", "cannot", "without"):
                break
            for end in range(at + 1, len(parts) + 1):
                if end > at + 1 and not parts[end - 2][1]:
                    break
                words = tuple(own[k:] + [w for p, _ in parts[at + 1 : end] for w in p])
                if words in known:
                    best = (end, known[words])
            if best:
                break
        out += [best[1]] if best else []
        at = best[0] if best else at + 1
    return out


def _words(text):
    bare = "".join(c for c in text.lower() if c not in "\"'()[]")
    bare = re.sub(r"(?<=[0-9])\.(?=[0-9])", "\0", bare)
    return [w.replace("\0", ".") for w in re.split(r"[^a-z0-9+\0]+", bare) if w]


@pytest.mark.parametrize("seed", range(40))
def test_against_brute_force(seed):
    r = random.Random(seed)
    flat = [t for texts in licenses.SENTENCES.values() for t in texts]
    lines = []
    for _ in range(12):
        t = r.choice(flat) if r.random() < 0.7 else "Some other words of " + r.choice(flat)
        if r.random() < 0.3:
            words = t.split()
            words[r.randrange(len(words))] = r.choice(["", "x", "(the)", "right's", "2.0", "License."])
            t = " ".join(words)
        if r.random() < 0.6:
            t = textwrap.fill(t, r.randrange(20, 90), initial_indent=(lead := r.choice(["", "# ", " * ", "// "])), subsequent_indent=lead, break_on_hyphens=False)
        lines.append(r.choice([str, str.upper, str.lower])(t))
    text = "".join(x + r.choice(["\n", " ", "\r\n\n", "\n\n"]) for x in lines)
    assert TOOL.identifiers(text.encode()) == brute(text)


def test_the_pre_test_drops_what_normalisation_drops():
    assert found("All right's reserved.") == ([], 0, ["reserved"])
    assert found("(All) rights\n\n'reserved'.") == ([], 0, ["reserved"])


def whole(*names, lead=(), between="\n\n"):
    return between.join([*lead, *(licenses.SENTENCES[n][0] for n in names)])


FULL = {
    "MIT": whole("mit-grant", "mit-notice", lead=["MIT License", "Copyright (c) 2020 Some One"]) + "\n\n" + whole("mit-warranty", "mit-liability", between=" "),
    "Apache-2.0": '   Licensed under the Apache License, Version 2.0 (the "License");\n   you may not use this file except in compliance with the License.\n   You may obtain a copy of the License at\n\n       http://www.apache.org/licenses/LICENSE-2.0\n\n   '
    + whole("apache2-basis", between=" ") + "\n   " + whole("apache2-see"),
    "GPL-3.0-or-later": whole("gpl-free") + "\n\n" + whole("gpl-warranty", "gpl-fitness", between=" ") + "  See the GNU General Public License for more details.\n\nYou should have received a copy",
    "GPL-2.0-or-later": whole("gnu-program", "gpl-terms", "gnu-version-2", between=" ") + "\n\n" + whole("gpl-warranty", "gpl-fitness", "gpl-see", between=" "),
    "LGPL-2.1-or-later": whole("gnu-library", "lgpl-terms", "gnu-version-2.1", between=" "),
    "GPL-3.0": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n" + whole("gnu-verbatim") + "\n\n  Preamble\n\n  " + whole("gpl3-preamble"),
    "BSD-3-Clause": whole("bsd-redistribute", lead=["Copyright (c) 2020, Some One", "All rights held."]) + "\n\n1. " + whole("bsd-source") + "\n\n2. " + whole("bsd-binary") + "\n\n3. " + whole("bsd-endorse") + "\n\n" + whole("bsd-warranty"),
    "BSD-2-Clause": whole("bsd-redistribute") + "\n\n  * " + whole("bsd-source") + "\n  * " + whole("bsd-binary") + "\n\n" + whole("bsd-warranty") + " IN NO EVENT SHALL",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "ISC": "Copyright (c) 2020 Some One\n\n" + whole("isc-grant", "isc-warranty"),
    "Unlicense": whole("unlicense-short", "unlicense-grant"),
    "GPL-2.0-only": whole("gnu-program", "gpl-terms", "gnu-only-2", between=" ") + "\n\n" + whole("gpl-warranty", "gpl-fitness", "gpl-see", between=" "),
    "AGPL-3.0-or-later": whole("agpl-free") + "\n\n" + whole("gpl-warranty", "gpl-fitness", "agpl-see", between=" "),
    "AGPL-3.0": "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007\n\nCopyright (C) 2007 Free Software Foundation, Inc.\n" + whole("gnu-verbatim") + "\n\nPreamble\n\n" + whole("agpl3-preamble"),
    "LGPL-2.1": "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999\n\nCopyright (C) 1991, 1999 Free Software Foundation, Inc.\n" + whole("gnu-verbatim") + "\n\nPreamble\n\n" + whole("gpl2-preamble"),
    "EPL-2.0": "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License v. 2.0\nwhich is available at https://www.eclipse.org/legal/epl-2.0.",
    "Zlib": whole("zlib-as-is") + " In no event will the authors be held liable.\n\n" + whole("zlib-grant"),
    "BSL-1.0": whole("bsl1-title", "bsl1-grant"),
    "Artistic-2.0": "The Artistic License 2.0\n\nCopyright (c) 2000-2006, The Perl Foundation.\n\n" + whole("gnu-verbatim") + "\n\nPreamble\n\n" + whole("artistic2-purpose"),
    "CDDL-1.0": "COMMON DEVELOPMENT AND DISTRIBUTION LICENSE (CDDL) Version 1.0\n\n1. Definitions.",
    "OFL-1.1": "Copyright 2010 Some One\n\nThis Font Software is licensed under the SIL Open Font License, Version 1.1.\nThis license is copied below.\n\n" + whole("ofl-title", "ofl-grant"),
}


@pytest.mark.parametrize("name", FULL)
def test_reserved_rights_are_no_second_licence(name):
    assert found("Copyright (c) 2020, Some One. All rights reserved.\n\n" + FULL[name]) == ([name], 1, ["reserved"])


@pytest.mark.parametrize("text", [
    "License: Licensed under the MIT License.", "This file is released under the MIT License.", "<p>All rights reserved. <b>Released under the <a href='x'>MIT License</a>.</b></p>", "3) Code: released under the MIT License.",
    "// License: released under\n// the MIT License.", "<li>This project is licensed under the MIT License.</li>",
])
def test_labels_subjects_and_tags(text):
    assert found(text)[0] == ["MIT"]


def test_denied_and_distant():
    for t in ("This file is not released under the MIT License.", "one two three four five six seven released under the MIT License.", "It was never licensed under the MIT License."):
        assert found(t) == ([], 0, [])


@pytest.mark.parametrize("name", FULL)
@pytest.mark.parametrize("width", [None, 40, 60, 79])
@pytest.mark.parametrize("leader", ["", " * ", "# ", "// "])
def test_whole_licences(name, width, leader):
    text = FULL[name]
    if width:
        text = "\n".join(leader + line for part in text.split("\n") for line in (textwrap.wrap(part.strip(), width, break_on_hyphens=False, break_long_words=False) or [""]))
    got = found(text)
    assert got == ([name], 1, []), got


def test_near_misses():
    for t in ("Licensed under the Apache License, Version 3.0.", "the MIT License", "Not licensed under CC BY 4.0 at all", "Licensed under CC BY-NC 40."):
        assert found(t) == ([], 0, [])


def test_rows(spark):
    rows = [*data.texts(), (50, "Prose. Released under the MIT License. More.", "en", "a"), (50, "Released under the MIT License.", "en", "a")]
    out = licenses.scan(data.docs(spark, rows)).collect()
    assert len(out) == len(rows) and sorted(r.licenses for r in out)[-2:] == ["MIT", "MIT"] and sum(r.n_matches for r in out) == 2
    assert licenses.scan(data.empty(spark)).count() == 0
