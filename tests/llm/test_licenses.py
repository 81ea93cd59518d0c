"""Licence scans against brute force."""

import re

import pytest

from tallyforge.llm import queries
from tallyforge.llm.licenses import TEMPLATES, find_passages, needed, scan_licenses, template_bigrams


def brute(text, templates=TEMPLATES, threshold=0.8):
    lines = (text or "").split("\n")
    out = []
    for i, unit in ([(0, text)] if len(lines) > 1 else []) + list(enumerate(lines, 1)):
        words = re.findall("[a-z0-9]+", "".join(c.lower() if c.isascii() else c for c in unit))
        grams = set(zip(words, words[1:], strict=False))
        best = min(((-2 * len(g & grams) / (len(g) + len(grams)), name) for name, t in templates for g in [{tuple(x.split()) for x in template_bigrams(t)}] if g or grams), default=(0, ""))
        if grams and -best[0] >= threshold - 1e-12:
            out.append((i, best[1], round(-best[0], 9)))
    return out


def test_scan(spark):
    mit = TEMPLATES[9][1]
    texts = [
        None, "", "\n\n", "x", "All rights reserved.", "words\nLicensed under CC BY-NC 4.0.\nmore", "CC BY-NC 4.0", "cc by nc 4 0", "licensed under cc by 4.0", "This work is licensed under the GNU General Public License, version 2!", mit, mit.replace(". ", ".\n").replace("sell", "sale"),
        mit[: len(mit) // 2], "released under the mit license " * 3, "ALL RIGHTS\tRESERVED\r\nAll Rights Reserved", "Licensed under the Apache License, Version 2.0. See it.", "Lıcensed under the Apache License, Version 2.0", "no licence here " * 2000,
    ]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)] + [(None, texts[4], None, None)] * 2, "doc_id long, text string, line string, license string")
    got = scan_licenses(docs).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        assert [(m.line, m.license, round(m.dice, 9)) for m in r.licenses] == brute(r.text), r.text
    assert scan_licenses(docs.limit(0)).count() == 0 and scan_licenses(docs, []).where("size(licenses) > 0").count() == 0


def test_every_match_holds_a_needed_word():
    words, pairs = needed(TEMPLATES, 0.8)
    for _, t in TEMPLATES:
        ws = re.findall("[a-z0-9]+", t.lower())
        for a in range(len(ws)):
            for b in range(a + 2, len(ws) + 1):
                part = " ".join(ws[a:b])
                own, grams = set(zip(ws, ws[1:], strict=False)), set(zip(ws[a:b], ws[a + 1 : b], strict=False))
                if 2 * len(own & grams) >= 0.8 * (len(own) + len(grams)):
                    assert any(w in part for w in words) or any(p in part for p in pairs)


def brute_passages(text, templates=TEMPLATES, threshold=0.8):
    """All windows of all templates, of every size in reach."""
    words = re.findall("[a-z0-9]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    grams = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    known = [(name, set(template_bigrams(t))) for name, t in templates]
    dice = lambda part, g: 2 * len(part & g) / (len(part) + len(g))
    found = []
    for name, g in known:
        most = int(len(g) * (2 - threshold) / threshold + 1e-9)
        ends = {}
        for i in range(len(grams)):
            d, size = min(((-dice(set(grams[i:j]), g), j - i) for j in range(i + 1, min(i + most, len(grams)) + 1)))
            if -d >= threshold - 1e-12:
                ends[i + size] = min(ends.get(i + size, (d, i, size)), (d, i, size))
        for d, i, size in ends.values():
            part = set(grams[i : i + size])
            if min((-dice(part, o), n) for n, o in known)[1] == name:
                found.append((d, name, i, size))
    kept = []
    for d, name, i, n in sorted(found):
        if all(i >= k + m or k >= i + n for _, _, k, m in kept):
            kept.append((d, name, i, n))
    return sorted((i, i + n + 1, name, round(-d, 9)) for d, name, i, n in kept)


def test_passages(spark):
    mit = TEMPLATES[9][1]
    wrapped = re.sub("((?:[^ ]+ ){9})", r"\1\n", mit)
    filler = "some words about the use of a tool and the people of a town " * 12
    texts = [
        None, "", "x", f"{filler}\n\n{wrapped}\n\n{filler}", "Copyright 2024 Acme Corp. All rights reserved.", "This software is licensed under the MIT License. See LICENSE for details. It was released under the MIT license in May.",
        "A tool. This work is licensed under the GNU General Public License,\nversion 3. The data: licensed under CC BY-NC 4.0. Enjoy.", "See it, licensed under the Apache\nLicense, Version 2.0, and all\nrights reserved otherwise",
        f"{filler} {mit.replace('sell', 'very much sale').replace('Software', 'work', 2)} {filler}", "under cc by 4.0, under cc by", "work is licensed under the gnu general public license, version. " * 2 + "This work is licensed under the GNU General Public License, version 2",
        "all rights reserved " * 9, f"Released under the MIT License. {filler}{filler} Released under the MIT License. {filler} released under THE MIT license", f"{mit} {filler} {wrapped}", mit[: len(mit) // 2] + filler, filler * 3,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in find_passages(docs, TEMPLATES[:11]).collect()}
    for i, t in enumerate(texts):
        assert [(m.start, m.end, m.license, round(m.dice, 9)) for m in got[i].passages] == brute_passages(t, TEMPLATES[:11]), t
    assert [m.license for m in got[3].passages] == ["MIT"] and got[3].passages[0].dice == 1.0
    assert len(got[11].passages) == 9 and [m.license for m in got[12].passages] == ["MIT"] * 3 and [(m.license, m.dice) for m in got[13].passages] == [("MIT", 1.0)] * 2
    assert [m.license for m in got[4].passages] == ["all-rights-reserved"] and [m.license for m in got[6].passages] == ["GPL-3.0", "CC-BY-NC-4.0"]
    assert find_passages(docs, []).where("size(passages) > 0").count() == 0


def test_whole_licences(spark):
    """Each template is found as what it is: as a wrapped comment in a long file, and with a few words changed."""
    code = "def use(x): return x + 1  # some code that does something\n" * 30
    texts = []
    for _, t in TEMPLATES:
        words = t.split(" ")
        header = "\n".join("# " + " ".join(words[i : i + 9]) for i in range(0, len(words), 9))
        changed = [w if i % 31 else "changed" for i, w in enumerate(words, 1)]
        texts += [f"{header}\n{code}", f"{code} {' '.join(changed)} {code}"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, passages int")
    got = find_passages(docs)
    assert got.columns == ["doc_id", "text", "passages"]
    for r in got.collect():
        name, t = TEMPLATES[r.doc_id // 2]
        found = [(m.license, m.dice) for m in r.passages]
        assert [n for n, _ in found] == [name] and (r.doc_id % 2 or found[0][1] == 1.0), (name, found)


@pytest.mark.parametrize("query", ["op2_license_scan", "license_lines"])
def test_queries_equal_their_sql(spark, tmp_path, query):
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    mit = TEMPLATES[9][1]
    filler = "some words about the use of a tool and the people of a town " * 12
    texts = [
        None, "", "Under CC BY 4.0.", f"x\n{re.sub('((?:[^ ]+ ){9})', chr(92) + '1' + chr(10), mit)}\n{filler}", "Licensed under the Apache License,\nVersion 2.0.", "A tool. Released under the MIT License. " + filler + " released under the MIT license, all rights reserved, all rights reserved", "all rights reserved\nAll rights reserved\nx",
        "licensed under cc by nc 4.0 and all rights reserved, released under the mit license", "work is licensed under the gnu general public license, version 2, licensed under the gnu general public license, version 3", *(t for _, t in TEMPLATES), filler,
    ]
    pq.write_table(pa.table({"doc_id": range(len(texts)), "text": texts}), tmp_path / "documents.parquet")
    got = sorted(map(tuple, queries.queries()[query](spark, str(tmp_path)).collect()))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    told = sorted(db.execute(queries.oracle_sql()[query]).fetchall())
    assert got == told
    assert [n for _, n, *_ in got[:3]] == [0, 0, 1] and (query == "license_lines" or [r[3] for r in got[3:6]] == ["MIT", "Apache-2.0", "MIT"])
