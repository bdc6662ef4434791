"""Licence digests, also against SQL."""

from __future__ import annotations

import os

import pytest

from doctopics.llm import licenses
from doctopics.llm.q_text import op7_license_scan
from tests.harness import difference, duck


def test_query_matches_sql(spark, sf_dir):
    got = op7_license_scan(spark, sf_dir).toPandas()
    assert (got["n_notice_lines"] > 0).any()
    assert difference(got, duck(sf_dir).sql(licenses.ORACLE).df()) is None


def test_whole_texts_and_notices(spark, docs_of):
    mit = licenses.MIT.replace("\n", " ")
    rows = [
        (1, "Copyright (c) 2020 A. Person\n\n" + mit.upper()),
        (2, "(c) 1999 Somebody; All Rights Reserved\n" + licenses.MIT.replace("sublicense", "sub-licence").replace('"', "“") + "\n\n"),
        (3, mit + " and more"),
        (4, "Some text.\n  ** released under the MIT licence **\nMore.\nLicensed under CC BY-NC 4.0\n"),
        (5, None), (6, ""), (7, "copyright 2020 x"), (None, licenses.BSD_3), (8, licenses.BSD_2), (8, licenses.BSD_2), (9, "a" * 200_000),
        (10, licenses.ZERO_BSD), (11, "Released under the MIT License."), (12, licenses.APACHE_NOTICE), (13, "/* " + licenses.UNLICENSE + " */"),
    ]
    df = docs_of(rows, license_id=("int", [1] * len(rows)), _d=("int", [1] * len(rows)))
    out = licenses.scan_licenses(df, licenses.known_licenses(spark)).collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: r for r in out}
    want = {1: "MIT", 2: "MIT", 3: None, 4: None, 5: None, 6: None, 7: None, None: "BSD-3-Clause", 8: "BSD-2-Clause", 9: None, 10: "0BSD", 11: "notice:MIT", 12: "notice:Apache-2.0", 13: "Unlicense"}
    assert {k: r["license_id"] for k, r in by.items()} == want
    assert by[4]["notice_ids"] == "notice:CC-BY-NC-4.0,notice:MIT" and by[4]["n_notice_lines"] == 2
    assert by[5]["text_digest"] is None and by[6]["text_digest"] == by[7]["text_digest"]
    assert licenses.scan_licenses(docs_of([]), licenses.known_licenses(spark)).count() == 0


COPYRIGHTS = ["Copyright (c) 2020 A. Person", "Copyright Jane Doe", "Copyright The X Authors", "\u00a9 2021 Someone <a@b.org>", "(c) 1999 Somebody", "Copyright \u00a9 2001-2005 by X"]
COPYRIGHTS += ["Portions Copyright (C) Y\nAll rights reserved.", "COPYRIGHT 2020 Z, All Rights Reserved", "copyright", ""]


def test_whole_files_with_title_and_copyright(spark, docs_of):
    """Titled files of every built-in licence, whatever their copyright lines and line breaks."""
    rows, want = [], {}
    for name, bodies in licenses.BODIES.items():
        for body in bodies:
            for title in ["", *licenses.TITLES[name]]:
                copyright_lines = COPYRIGHTS[len(rows) % len(COPYRIGHTS)]
                wrapped = body if len(rows) % 2 else body.replace("\n\n", "\0").replace("\n", " ").replace("\0", "\n\n")
                want[len(rows)] = name
                rows.append((len(rows), f"{title.upper() if len(rows) % 3 else title}\n\n{copyright_lines}\n\n{wrapped}\n"))
    out = {r["doc_id"]: r["license_id"] for r in licenses.scan_licenses(docs_of(rows), licenses.known_licenses(spark)).collect()}
    # one canonical text can have two names: the smaller id is given
    shared = {"BSD License": "BSD-2-Clause"}
    assert all(out[k] == want[k] or want[k] in shared.values() for k in out) and set(out.values()) == set(want.values())


def test_lines_of_a_licence_stay(spark, docs_of):
    """A wrapped line that starts with the word copyright is no copyright line."""
    rows = [(k, licenses.MIT.replace("\n", " ").replace(x, "\n" + x)) for k, x in enumerate(["COPYRIGHT HOLDERS", "copyright notice", "The above"])]
    rows += [(7, licenses.MIT.replace("COPYRIGHT HOLDERS", "\nCopyright Jane")), (8, "copyright notice\ncopyright Notary")]
    out = {r["doc_id"]: r for r in licenses.scan_licenses(docs_of(rows), licenses.known_licenses(spark)).collect()}
    assert [out[k]["license_id"] for k in (0, 1, 2, 7)] == ["MIT", "MIT", "MIT", None]


FILES = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}


@pytest.mark.parametrize("name", FILES)
def test_long_licences(spark, docs_of, name):
    path = f"/usr/share/common-licenses/{name}"
    if not os.path.exists(path):
        pytest.skip("the system has no copy of this licence")
    with open(path, encoding="utf-8", errors="replace") as f:
        text = f.read()
    rows = [(1, text), (2, text.upper().replace("\n\n", "\n \n")), (3, text[:-40])]
    out = {r["doc_id"]: r["license_id"] for r in licenses.scan_licenses(docs_of(rows), licenses.known_licenses(spark)).collect()}
    assert out == {1: FILES[name], 2: FILES[name], 3: None}
