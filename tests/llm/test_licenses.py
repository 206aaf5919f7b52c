from pathlib import Path

import pytest

from dittograph.llm import licenses as L
from dittograph.llm.license_texts import KNOWN

from .conftest import prose

MIT = next(t for n, t in KNOWN if n == "MIT")


def found(docs, **k):
    return {(r.doc_id, r.line, r.license) for r in L.scan(docs, **k).collect()}


def test_variants_of_a_text(make):
    other = MIT.upper().replace("COPYRIGHT (C) <YEAR> <HOLDERS>", "Copyright 2020 Someone Else\nCopyright 2021 Others").replace('"', "'").replace("MIT LICENSE", "MIT Licence").replace("SUBLICENSE", "sub-license")
    docs = make([(1, MIT), (2, other), (3, MIT + " and more"), (4, "prose\nReleased under the MIT Licence!\nprose"), (4, "prose\nReleased under the MIT Licence!\nprose"), (5, "licensed under the apache license version 2.0"), (None, MIT), (6, prose(1, 30_000) + "\n" + "Licensed under CC BY 4.0."), (7, "Licensed under the Apache License, v2.0")])
    rows = [(r.doc_id, r.line, r.license) for r in L.scan(docs).collect()]
    whole = {(i, n) for i, line, n in rows if line == 0}
    assert whole == {(1, "MIT"), (2, "MIT"), (None, "MIT"), (5, "Apache-2.0-notice"), (7, "Apache-2.0-notice")}
    assert rows.count((4, 2, "MIT-notice")) == 2
    assert [n for i, line, n in rows if i == 6 and line] == ["CC-BY-4.0-notice"]
    assert not [r for r in rows if r[0] == 3]


def test_ties_nulls_and_empty_tables(spark, odd, nothing):
    known = spark.createDataFrame([("B", "Do as you like."), ("A", "do as YOU like"), (None, "x"), ("C", None), ("D", "...")], "license string, text string")
    docs = spark.createDataFrame([(1, "Do, as you like!"), (2, None), (3, "!!")], "doc_id long, text string")
    assert found(docs, known=known) == {(1, 0, "A")}
    assert found(docs, known=known, broadcast_rows=0) == {(1, 0, "A")}
    assert found(docs, known=known.limit(0)) == set()
    assert found(odd) == set() and found(nothing) == set()


COMMON = Path("/usr/share/common-licenses")


def test_whole_texts(make):
    """Entire texts as the system ships them, and as projects file them, by the default table."""
    if not COMMON.is_dir():
        pytest.skip("no licence texts on this system")
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "BSD": "BSD-3-Clause"}
    texts = [(COMMON / n).read_text() for n in names]
    texts.append("BSD 2-Clause License\n\nCopyright (c) 2020, Someone\nAll rights reserved.\n\n" + next(t for n, t in KNOWN if n == "BSD-2-Clause"))
    texts.append(texts[0].partition("APPENDIX")[0])
    texts += [next(t for n, t in KNOWN if n == want).upper() for want in ("Unlicense", "CC-BY-4.0")]
    got = {(i, n) for i, line, n in found(make(list(enumerate(texts)))) if line == 0}
    assert got == set(enumerate([*names.values(), "BSD-2-Clause", "Apache-2.0", "Unlicense", "CC-BY-4.0"]))
    assert "Neither the name" not in texts[len(names)]
