from platewright.llm import licenses as li

DOCS = "doc_id long, text string, license string, lines string"


def test_canonical_form():
    same = [
        "Released under the MIT License.",
        "released under  the MIT licence",
        "Copyright (c) 2020 Someone\n\n* RELEASED under the mit-License! \n(c) Other",
        "Released\nunder the\nMIT License",
    ]
    assert len({li.digest(t) for t in same}) == 1
    assert li.digest("Released under the BSD License.") != li.digest(same[0])
    assert li.digest(" \n.. ") == "" and li.digest("Copyright 2020 X") == ""
    assert li.plain_lines("Copyrighted work\n© me\nCopyright holders agree") == ["copyrighted work"]


def _docs(spark):
    holder = li.MIT.replace("<year> <holder>", "2021 A. Person").upper()
    rows = [
        (1, holder), (2, "\n".join(li.MIT.split("\n")[1:])), (3, li.MIT + "\nmore"), (4, None), (5, ""), (6, "..."),
        (7, "Licensed under CC BY-NC 4.0.\ntext\nreleased under the mit licence\nAll rights reserved"), (None, li.ISC),
        (7, "All rights reserved."), (8, ("some words\n" * 100_000) + "Licensed under the Apache License, Version 2.0."),
        (9, "text Licensed under CC BY-NC 4.0."), (10, li.ISC.replace("AUTHOR", "author").replace(",", " ;")),
    ]
    return spark.createDataFrame([(*r, "mine", "mine") for r in rows], DOCS), rows


def test_matches_plain_version(spark):
    docs, rows = _docs(spark)
    known = {li.digest(t): name for name, t in li.KNOWN}
    want = []
    for i, t, *_ in rows:
        lines = [known[d] for x in (t or "").split("\n") if (d := li.digest(x)) in known]
        want.append((i, known.get(li.digest(t or "")), len(lines), sorted(set(lines))))
    got = [tuple(r) for r in li.find_licenses(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    by_id = {r[0]: r for r in got}
    assert by_id[1][1] == by_id[2][1] == "MIT" and by_id[3][1] is None and by_id[10][1] == by_id[None][1] == "ISC"
    assert by_id[8][2:] == (1, ["Apache-2.0"]) and by_id[9][2] == 0


def test_empty_tables(spark):
    docs, rows = _docs(spark)
    assert li.find_licenses(docs.limit(0)).count() == 0
    nothing = li.known_licenses(spark).limit(0)
    got = li.find_licenses(docs, nothing).collect()
    assert len(got) == len(rows) and not any(r.license or r.licenses for r in got)


def test_layouts_that_are_not_in_the_table(spark):
    """Other line breaks, marks, spellings and holders than the table has."""
    from platewright.llm import license_texts as texts

    bsd = f"{texts.BSD_HEAD}\n{texts.BSD_THIRD}\n{texts.BSD_TAIL}"
    wrapped = " * " + bsd.replace("<year>, <holder>", "1999 The Project").replace("1. ", "(1) ").replace("\n", "\n * ")
    bullets = bsd.replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ").replace("All rights reserved.\n", "")
    rows = [
        (1, wrapped, "BSD-3-Clause"), (2, bullets, "BSD-3-Clause"), (3, texts.UNLICENSE.replace(", ", ",\n"), "Unlicense"),
        (4, texts.ZLIB.replace("acknowledgment", "acknowledgement").title(), "Zlib"), (5, "// " + texts.APACHE_NOTICE.replace("\n", "\n// "), "Apache-2.0"),
        (6, texts.BOOST.replace("organization", "organisation").replace("license", "licence"), "BSL-1.0"),
        (7, texts.GNU_NOTICE.format(thing="program", name="General Public License", version="3"), "GPL-3.0-or-later"),
        (8, "# SPDX-License-Identifier: MPL-2.0\nint main;", None), (9, bsd.replace("retain", "keep"), None), (10, "/* spdx-license-identifier: 0bsd */", "0BSD"),
        (11, "Licensed under the BSD 3-Clause Licence\nmore", None), (12, "This work is licensed under the GNU LGPL v2.1.", "LGPL-2.1"),
    ]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r.doc_id: r for r in li.find_licenses(docs).collect()}
    assert {i: got[i].license for i, *_ in rows} == {i: want for i, _, want in rows}
    assert got[8].licenses == ["MPL-2.0"] and got[11].licenses == ["BSD-3-Clause"] and got[9].n_license_lines == 1


def test_no_digest_stands_for_two_licences():
    owners = {}
    for name, text in li.KNOWN:
        owners.setdefault(li.digest(text), set()).add(name)
    assert all(len(o) == 1 for o in owners.values()), [o for o in owners.values() if len(o) > 1]
    assert len({n for n, _ in li.KNOWN}) > 30 and "" not in owners
