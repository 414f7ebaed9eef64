import re

from longspark.llm import licenses


def test_rules(spark):
    mit = (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated\n"
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the\n'
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to\n"
        "permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    )
    rows = [
        (1, "Text.\nReleased under the MIT License.\nMore."),
        (2, "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0. All rights reserved."),
        (3, mit),
        (4, "the licence of the sea"),
        (5, None),
        (6, ""),
        (7, "Released under the MIT License.\nReleased under the MIT License."),
    ]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, licenses string")
    got = {r.doc_id: (r.sentence_ids, r.licenses) for r in licenses.scan(docs).collect()}
    assert got == {
        1: ("e", "MIT"),
        2: ("mau", "Apache-2.0,CC-BY-NC-4.0,Proprietary"),
        3: ("gh", "MIT"),
        4: ("", ""),
        5: ("", ""),
        6: ("", ""),
        7: ("ee", "MIT"),
    }
    assert licenses.scan(docs.limit(0)).count() == 0


def test_longer_rules_come_first(spark):
    text = "\n".join(licenses.SENTENCES[i] for i in "qrst")
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert licenses.scan(docs).first().licenses == "BSD-3-Clause"


GPL3 = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version."""
GPL2 = """ * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; either version 2 of the License, or
 * (at your option) any later version.
 *"""


def test_notices_as_they_are_written(spark):
    as_is = licenses.SENTENCES["i"].upper().replace("AS IS", '"AS IS",\n')
    rows = [
        (1, "Header\n\n" + GPL3 + "\n\nMore.", "k", "GPL-3.0-or-later"),
        (2, GPL2, "l", "GPL-2.0-or-later"),
        (3, GPL2.replace("\n", "\r\n"), "l", "GPL-2.0-or-later"),
        (4, "This program is free software. You can redistribute it.", "", ""),
        (5, "All rights\nreserved.", "u", "Proprietary"),
        (6, "ALL-RIGHTS-RESERVED", "u", "Proprietary"),
        (7, "All  rights\treserved", "u", "Proprietary"),
        (8, licenses.SENTENCES["h"], "h", ""),
        (9, as_is, "i", ""),
        (10, licenses.SENTENCES["t"], "t", ""),
        # a line of its own with no stop before and after it, and a wrapped one, in one text
        (11, "A title\nLicensed under CC BY 4.0\nnext line\n\nThis work is licensed under the GNU General\nPublic License, version 3.", "nj", "GPL-3.0,CC-BY-4.0"),
        (12, "a title\nReleased under the\nMIT License\nnext line", "e", "MIT"),
        (13, "not all rights reserved, all rights reserved by", "", ""),
    ]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r.doc_id: (r.sentence_ids, r.licenses) for r in licenses.scan(docs).collect()}
    assert got == {r[0]: r[2:] for r in rows}


def test_every_sentence_has_a_hint():
    assert all(re.search(licenses._HINT, s) for s in licenses.SENTENCES.values())
