"""License notices as they are met: whole texts, wrapped lines, SPDX, versions, and prose that names none."""

import textwrap

import pytest

from corvana.llm import license_texts, licenses

PROSE = "The river runs past the town and the people there have built a bridge of stone over it. " * 3
WHOLE = {
    "MIT": f"MIT License\n\nCopyright (c) 2021 A. Person\n\n{license_texts.MIT}",
    "ISC": f"Copyright (c) 2020, Some One\n\n{license_texts.ISC}",
    "BSD": f"Copyright (c) 2019, Some One. All rights reserved.\n\n{license_texts.BSD_HEAD}\n\n{license_texts.BSD_TAIL}",
    "Unlicense": license_texts.UNLICENSE,
    "Zlib": license_texts.ZLIB,
    "Apache-2.0": license_texts.APACHE,
    "GPL-3.0": "This program " + license_texts.GPL.format("General Public License", 3),
    "LGPL": "This library " + license_texts.GPL.format("Lesser General Public License", "2.1"),
    "AGPL-3.0": "This program " + license_texts.GPL.format("Affero General Public License", 3),
}
SHORT = {
    "SPDX-License-Identifier: MIT": "MIT",
    "SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
    "SPDX-License-Identifier: MIT OR Apache-2.0": "Apache-2.0,MIT",
    "The text is available under the Creative Commons Attribution-ShareAlike License.": "CC-BY-SA",
    "Licensed under CC BY-NC-SA 4.0.": "CC-BY-NC-SA-4.0",
    "This photo is licensed under a Creative Commons Attribution 3.0 License": "CC-BY-3.0",
    "Copyright 2020. All rights reserved. No part of this work may be reproduced.": "Proprietary",
    "The book is now in the public domain in most countries, and no copyright is left.": "",
    "Wir fahren mit der Lizenz zum Angeln, mit license plates und mit Freunden.": "",
    "his driving license was taken by the police": "",
    "there is no warranty on the old car, and BSD is a system": "",
}


@pytest.fixture(scope="module")
def scan():
    return licenses.Scanner().scan


@pytest.mark.parametrize("name", WHOLE)
def test_whole_texts(scan, name):
    text = WHOLE[name]
    for form in (text, " ".join(text.split()), "\n".join(textwrap.wrap(text, 60)), f"{PROSE}\n{text}\n{PROSE}", PROSE + " ".join(text.split()) + PROSE):
        assert scan(form)["licenses"] == name


@pytest.mark.parametrize("text", SHORT)
def test_short_notices(scan, text):
    for form in (text, f"{PROSE}{text} {PROSE}", f"{PROSE}\n{text}\n{PROSE}"):
        assert scan(form)["licenses"] == SHORT[text]


def test_frames(spark):
    """Nulls, repeats, an empty table, long texts, and columns that have the results' names."""
    notice = "Released under the MIT License."
    rows = [(1, notice, "old", 5), (1, notice, "old", 5), (2, None, None, None), (3, "", "x", 1), (4, (PROSE + notice + " ") * 300, "y", 2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, licenses string, n_blocks long")
    got = sorted((r["doc_id"], r["licenses"]) for r in licenses.scan(frame).collect())
    assert got == [(1, "MIT"), (1, "MIT"), (2, ""), (3, ""), (4, "MIT")]
    assert licenses.scan(frame.where("false")).count() == 0
