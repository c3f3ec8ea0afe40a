import hashlib
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from treeloom.llm import license_scan as L

MIT = L.FULL["MIT"][0]


@pytest.mark.parametrize("text,unit,license_id", [
    (MIT, "text", "MIT"),
    ("The MIT License (MIT)\n\nCopyright (c) 2019 Jane Doe\nCopyright 2020-2021 Others\n\n" + MIT.upper().replace(",", " ,"), "text", "MIT"),
    ("MIT Licence\n\n© 2020 X. All rights reserved.\n\n" + MIT, "text", "MIT"),
    ("prose before\n\n" + L.FULL["BSD-3-Clause"][0].replace("\n\n", "\n").replace("\n", " ") + "\n\nprose after", "block", "BSD-3-Clause"),
    (L.FULL["Zlib"][0].replace("acknowledgment", "acknowledgement"), "text", "Zlib"),
    ("some words\nReleased under the MIT License.\nmore words", "line", "MIT"),
    ("Licensed under the Apache License, Version 2.0.", "text", "Apache-2.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "text", "GPL-3.0"),
    ("licensed under CC BY-NC 4.0", "text", "CC-BY-NC-4.0"),
    ("// SPDX-License-Identifier: GPL-2.0", "text", "GPL-2.0"),
    ("# Licenced under GPL v3", "text", "GPL-3.0"),
])
def test_known(spark, text, unit, license_id):
    got = {(r.unit, r.license_id) for r in L.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()}
    assert (unit, license_id) in got


def test_not_known(spark):
    rows = [(1, "the license of this text is MIT"), (2, MIT + " And more."), (3, MIT.replace("free of charge", "for a charge")), (4, "MIT"), (5, "...")]
    assert L.scan(spark.createDataFrame(rows, "doc_id long, text string")).where("unit = 'text'").count() == 0


def test_forms_agree(spark, small):
    """Spark, DuckDB and Python normalise alike."""
    c = duckdb.connect()
    for f in os.listdir(small):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{small}/{f}'")
    texts = [*(t for v in L.FULL.values() for t in v), "© 2020 A\n(c) 1999 B\nCopyright <year> C\nvV2 ver3 our colour organised WHILST wilful fulfil fulfilled https://x é", "All rights\n  reserved. Non-\ncommercial, version\n2, v 3 \x01\x02 x\n \t\n\n\ny"]
    mine = [r.c for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").repartition(1).orderBy("i").select(L.flat(L.normal(F.col("t"))).alias("c")).collect()]
    assert mine == [L.canonical_text(t) for t in texts]
    c.execute("create table x(i int, t varchar)")
    c.executemany("insert into x values (?, ?)", list(enumerate(texts)))
    assert [r[0] for r in c.execute(f"select {L.flat_sql(L.normal_sql('t'))} from x order by i").fetchall()] == mine
    got = sorted(map(tuple, L.query(spark, small).collect()))
    assert got and got == sorted(c.execute(f"select doc_id, unit, unit_no, license_id, digest from ({L.oracle()})").fetchall())


def test_odd_rows(spark, odd, empty):
    assert L.scan(odd).count() == 0 and L.scan(empty).count() == 0
    long = "x\n" * 100_000 + "Released under the MIT License.\n"
    df = spark.createDataFrame([(1, long, "u"), (1, long, "u"), (None, long, "u"), (2, None, "u")], "doc_id long, text string, unit string")
    assert sorted((str(r.doc_id), r.unit, r.unit_no) for r in L.scan(df).collect()) == [("1", "line", 100000)] * 2 + [("None", "line", 100000)]
    own = spark.createDataFrame([(hashlib.sha256(b"my terms").hexdigest(), "Mine"), (hashlib.sha256(b"my terms").hexdigest(), "Mine")], "digest string, license_id string")
    assert [r.license_id for r in L.scan(spark.createDataFrame([(1, "My   TERMS!")], "doc_id long, text string"), own).collect()] == ["Mine"]


def units_by_hand(text):
    """Units of a text, each with the normal form of the whole cut at its lines."""
    raw = text.split("\n")
    own = L.normal_text(text).split("\n")
    assert len(own) == len(raw)
    flat = lambda x: " ".join(x.replace(L.BLANK, " ").split())
    out, blocks, at = [("text", 0, flat(" ".join(own)))], [[]], 0
    while at < len(own):  # a blank line between two lines parts blocks; the line after it can't part again
        if 0 < at < len(own) - 1 and not raw[at].strip(" \t\r") and blocks[-1]:
            blocks.append([])
            blocks[-1].append(own[at + 1])
            at += 2
            continue
        blocks[-1].append(own[at])
        at += 1
    if len(blocks) > 1:
        out += [("block", k, flat(" ".join(b))) for k, b in enumerate(blocks)]
    if len(own) > 1:
        out += [("line", k, flat(x)) for k, x in enumerate(own)]
    return out


def test_units_against_brute_force(spark):
    """Every unit of every text is found if its digest is known, and nothing else."""
    r = random.Random(3)
    pool = ["Released under the MIT License.", "Copyright 2020 A", "All rights", "reserved.", "", " \t", "---", "some words", "Non-", "commercial use, version", "2.0", "© x 1999"]
    texts = ["\n".join(r.choice(pool) for _ in range(r.randrange(0, 12))) for _ in range(300)]
    want = {(i, u, k, hashlib.sha256(c.encode()).hexdigest()) for i, t in enumerate(texts) for u, k, c in units_by_hand(t)}
    table = spark.createDataFrame([(d, "x") for d in {x[3] for x in want}], "digest string, license_id string")
    got = [(x.doc_id, x.unit, x.unit_no, x.digest) for x in L.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), table).collect()]
    assert len(got) == len(want) and set(got) == want


def test_digest_of_two_licences(spark):
    d = hashlib.sha256(b"my terms").hexdigest()
    for own in ([(d, "B"), (d, "A"), (d, "B")], spark.createDataFrame([(d, "B"), (d, "A")], "digest string, license_id string")):
        assert [r.license_id for r in L.scan(spark.createDataFrame([(1, "My terms")], "doc_id long, text string"), own).collect()] == ["A"]


FILES = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no licence texts on this machine")
def test_full_texts(spark):
    texts = [(i, open(f"/usr/share/common-licenses/{f}").read()) for i, f in enumerate(FILES)]
    got = {r.doc_id: r.license_id for r in L.scan(spark.createDataFrame(texts, "doc_id long, text string")).where("unit = 'text'").collect()}
    assert [got.get(i) for i, _ in texts] == list(FILES.values())
