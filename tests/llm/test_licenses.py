import pathlib

import pytest

from sparkloom.llm import licenses as L

from .helpers import docs

MIT = next(t for n, t in L.KNOWN if n == "MIT" and len(t) > 200)


def test_whole_texts_and_lines(spark):
    rows = [
        (1, "Copyright (c) 2020 Somebody\n\n" + MIT.replace("  ", " ").replace(" ", "\n  ").upper()), (2, MIT.replace("copyright holders", "copyright owners").replace(",", " ,")), (3, MIT + " And more."),
        (4, "prose here\nReleased under the MIT licence\nmore"), (5, None), (6, ""), (7, "Copyright 2021 me"), (None, "Licensed under CC BY-NC 4.0."), (8, "x y " * 50_000 + "\nLicensed under the Apache License, Version 2.0."), (8, "a"), (8, "a"),
    ]
    out = L.scan(docs(spark, rows)).collect()
    got = sorted((str(r.doc_id), r.license, r.notices) for r in out)
    assert got == sorted([("1", "MIT", "MIT"), ("2", "MIT", "MIT"), ("3", "", ""), ("4", "", "MIT"), ("5", "", ""), ("6", "", ""), ("7", "", ""), ("None", "CC-BY-NC-4.0", "CC-BY-NC-4.0"), ("8", "", "Apache-2.0"), ("8", "", ""), ("8", "", "")])
    assert {r.text_digest for r in out if r.doc_id in (5, 6, 7)} == {None}


def test_own_licences_and_nothing(spark):
    own = spark.createDataFrame([("A", "Do  what you WANT."), ("B", "do what you want"), ("C", None)], "license string, text string")
    assert L.scan(docs(spark, [(1, "Do what you want!")]), own).first().license == "A,B"
    assert L.scan(docs(spark, [])).count() == 0


def test_usual_templates(spark):
    by = {n: t for n, t in reversed(L.KNOWN) if len(t) > 400}
    head = next(t for n, t in L.KNOWN if n == "GPL-3.0-or-later")
    wrap = lambda t, mark, n: "\n".join(mark + " ".join(t.split()[i : i + n]) for i in range(0, len(t.split()), n))
    rows = [
        (1, "The MIT License (MIT)\n\nCopyright (c) 2020 X\n\n" + wrap(by["MIT"], "", 12)), (2, "BSD 3-Clause License\n\nCopyright (c) 2020, X\nAll rights reserved.\n\n" + by["BSD-3-Clause"]),
        (3, "/*\n * Copyright 2020 X\n *\n" + wrap(by["ISC"], " * ", 9) + "\n */"), (4, "# ISC License\n#\n# Copyright (c) 2020 X\n#\n" + wrap(by["ISC"], "# ", 9)),
        (5, "x = 1\n\n# Copyright 2020 X\n#\n" + wrap(head, "# ", 11) + "\n#\n# and more\n\ny = 2"), (6, 'BSD 2-Clause "Simplified" License\n\n' + by["BSD-2-Clause"]), (7, wrap(by["Unlicense"], "", 13)), (8, "MIT License"),
    ]
    got = {r.doc_id: (r.license, r.notices) for r in L.scan(docs(spark, rows)).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "MIT", 2: "BSD-3-Clause", 3: "ISC", 4: "ISC", 5: "", 6: "BSD-2-Clause", 7: "Unlicense", 8: ""}
    assert got[5][1] == "GPL-3.0-or-later" and got[8][1] == ""


def test_long_licences_by_their_texts(spark):
    folder = pathlib.Path("/usr/share/common-licenses")
    found = [(p.name, p.read_text(errors="replace")) for p in sorted(folder.glob("*")) if not p.is_symlink()] if folder.exists() else []
    if not found:
        pytest.skip("no licence texts on this machine")
    rows = [(i, t) for i, (_, t) in enumerate(found)]
    out = {r.doc_id: r.license for r in L.scan(docs(spark, rows)).collect()}
    known = {n.split("-or")[0] for n, _ in L.DIGESTS}
    assert all(out[i] for i, (name, _) in enumerate(found) if any(k.startswith(name) for k in known))
    assert out[[n for n, _ in found].index("GPL-3")] == "GPL-3.0" and out[[n for n, _ in found].index("Apache-2.0")] == "Apache-2.0"
