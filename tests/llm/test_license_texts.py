import textwrap
from pathlib import Path

import duckdb

from meshlight.llm import license_scan

SHARED = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}


def test_texts_in_published_wrapping(spark):
    isc = "ISC License\n\nCopyright (c) 2020 A. N. Other\n\n" + "\n".join(textwrap.fill(p, 76) for p in license_scan.TEXTS["ISC"].split("\n"))
    assert "\ncopyright notice and this permission notice" in isc
    mit = "The MIT License (MIT)\n\nCopyright 2020 A. N. Other\n\n" + "\n".join(textwrap.fill(p, 70) for p in license_scan.TEXTS["MIT"].split("\n"))
    want = [("ISC", isc), ("MIT", mit)]
    for spdx, name in SHARED.items():
        path = Path("/usr/share/common-licenses", name)
        if path.exists():
            want.append((spdx, path.read_text()))
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(want)], "doc_id long, text string")
    found = {r.doc_id: r for r in license_scan.scan_licenses(docs).collect()}
    assert {k: (found[k].licenses, found[k].whole_text) for k in found} == {k: (spdx, True) for k, (spdx, _) in enumerate(want)}


def test_whole_texts_like_their_sql(spark, tmp_path):
    wrapped = {spdx: "\n".join(textwrap.fill(p, 76) for p in t.split("\n")) for spdx, t in license_scan.TEXTS.items()}
    owners = ["Copyright (c) 2020 A. N. Other", "  \tcopyright 2019, them", "(C) Somebody", "(c) 2018", "\u00a9 Somebody", "All rights reserved.", "Copyright"]
    others = ["copyright law says so", "(c) You must", "Copyright holders", "copyrighted words"]
    texts = [f"{line}\n{t}" for line in [*owners, *others] for t in wrapped.values()]
    texts += [f"The MIT License (MIT)\n\n{wrapped['MIT']}", f"The 3-Clause BSD License\n{wrapped['BSD-3-Clause']}", wrapped["ISC"]]
    texts += [path.read_text() for name in SHARED.values() if (path := Path("/usr/share/common-licenses", name)).exists()]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = sorted(con.sql(license_scan.oracle()).fetchall())
    assert sorted((r.doc_id, r.licenses, r.n_lines, r.whole_text) for r in license_scan.scan_licenses(frame).collect()) == want
    whole = {i for i, _, _, w in want if w}
    n = len(wrapped)
    assert {*range(n * len(owners)), *range(n * (len(owners) + len(others)), len(texts))} == whole
