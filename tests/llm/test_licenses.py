import textwrap

from stratakv.llm import licenses
from tests.helpers import SMALL, rows

TEXTS = {
    1: "some words\nReleased under the MIT License.\nmore",
    2: "This work is licensed under the GNU General Public License, version 2.",
    3: "This work is licensed under the GNU General Public License, version 3.",
    4: "This work is licensed under the GNU Affero General Public License, version 3.",
    5: licenses.TEMPLATES["Apache-2.0"][1],
    6: licenses.TEMPLATES["MIT"][1].replace("sublicense", "sub-license"),
    7: "A license to drive is not a licence to speed.",
    8: "Licensed under CC BY-SA 4.0.\n\n\n\n\n\n\nLicensed under CC BY-NC 4.0.",
    9: None, 10: "", 11: "nothing here",
    12: "x" * 200_000 + "\nReleased under the BSD 3-Clause License.",
}


def test_licenses_are_told_apart(spark):
    found = rows(licenses.scan(spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")), "doc_id", "license")
    assert sorted(found, key=str) == sorted(
        [(1, "MIT"), (2, "GPL-2.0"), (3, "GPL-3.0"), (4, "AGPL-3.0"), (5, "Apache-2.0"), (6, "MIT"), (7, None), (8, "CC-BY-SA-4.0"), (8, "CC-BY-NC-4.0"), (12, "BSD-3-Clause")], key=str
    )


def test_every_notice_is_confirmed_as_itself(spark):
    cases = [(i, name, t) for i, (name, t) in enumerate((n, t) for n, ts in licenses.TEMPLATES.items() for t in ts)]
    found = dict(rows(licenses.scan(spark.createDataFrame([(i, t) for i, _, t in cases], "doc_id long, text string")), "doc_id", "license"))
    assert found == {i: name for i, name, _ in cases}


def test_small_table_agrees_with_exact_search(spark):
    """Documents that hold a notice word for word are found, and blocks without any notice are not named."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    found = {}
    for r in licenses.scan(docs).collect():
        found.setdefault(r["doc_id"], set()).add(r["license"])
    every = [(w, name) for name, wordings in licenses.TEMPLATES.items() for w in wordings]
    for doc, text in rows(docs):
        here = [(w, name) for w, name in every if w in (text or "")]
        for w, name in here:
            if not any(w != x and w in x for x, _ in here):
                assert name in found.get(doc, set()), (doc, name)


GPL3 = licenses.TEMPLATES["GPL-3.0"][1]
BSD3 = licenses.TEMPLATES["BSD-3-Clause"][1]


def names(text):
    return [x[2] for x in licenses.Scanner(licenses.TEMPLATES).scan(text)]


def test_words_that_name_a_license_agree():
    assert names(GPL3.replace("software:", "software;").replace("version 3", "version 2")) == ["GPL-2.0"]
    assert names(GPL3.replace("GNU", "GNU Lesser")) == ["LGPL-3.0"]
    assert names(GPL3.replace("GNU", "GNU Affero")) == ["AGPL-3.0"]
    assert names(GPL3.replace("version 3", "version 4")) == [None]
    assert names(BSD3) == ["BSD-3-Clause"]
    assert names(BSD3[: BSD3.index("Neither")] + licenses.AS_IS) == ["BSD-2-Clause"]
    assert names(licenses.BSD) == ["BSD"]


def test_notices_inside_prose_and_wrapped_or_two():
    prose = " ".join(f"w{i * 7919 % 1000}ord" for i in range(200))
    assert names(f"{prose} Released under the MIT License. {prose}") == ["MIT"]
    for text, name in ((GPL3, "GPL-3.0"), (licenses.TEMPLATES["MIT"][1], "MIT")):
        for width in (40, 70):
            assert names("\n".join(textwrap.wrap(text, width))) == [name]
    assert names("Released under the MIT License.\nLicensed under the Apache License, Version 2.0.") == ["MIT", "Apache-2.0"]
    assert names("// SPDX-License-Identifier: GPL-2.0-or-later OR MIT") == ["GPL-2.0", "MIT"]


def test_a_notice_in_a_very_long_line_and_dual_licenses():
    prose = " ".join(f"w{i * 7919 % 1000}ord" for i in range(10_000))
    mit, gpl = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["GPL-3.0"]
    assert names(f"{prose} {mit[0]} {prose}") == ["MIT"]
    assert names(f"{prose} {mit[-1]} {prose}") == ["MIT"]
    assert names("Released under the MIT License.\nReleased under the BSD 2-Clause License.") == ["MIT", "BSD-2-Clause"]
    assert names("Released under the MIT License.\n\nReleased under the BSD 2-Clause License.") == ["MIT", "BSD-2-Clause"]
    assert names(f"{mit[-1]}\n\n{gpl[-1]}") == ["MIT", "GPL-3.0"]
    assert sorted(names(f"{prose} {mit[0]} {prose} {gpl[1]} {prose}")) == ["GPL-3.0", "MIT"]
    assert names("SPDX-License-Identifier: MIT") == ["MIT"] and names("SPDX-License-Identifier: Apache-2.0") == ["Apache-2.0"]


def test_a_license_without_its_last_paragraph_is_still_that_license():
    for name in ("MIT", "BSD-3-Clause", "GPL-2.0", "AGPL-3.0", "LGPL-2.1", "ISC", "MPL-2.0", "Unlicense"):
        whole = licenses.TEMPLATES[name][-1]
        assert names(whole) == [name] and names(f"Copyright 2020 A. Person\n\n{whole}\n\nimport os\n") == [name]
        assert names(" ".join(whole.split()[: len(licenses.TEMPLATES[name][-2].split())])) == [name]
