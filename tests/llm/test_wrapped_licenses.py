"""License texts as published: wrapped over lines, and within comments."""

import pytest

from llm import licenses

MIT = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND."""
BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = BSD2 + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
GPL2 = GPL3.replace("software: you", "software; you").replace("Foundation, either version 3", "Foundation; either version 2")
APACHE = """                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/"""
GPL_TITLE = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007
"""


def commented(text, mark):
    return "\n".join(mark + line for line in text.split("\n"))


@pytest.fixture(scope="module")
def scan(spark):
    def run(texts):
        table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        out = {}
        for r in licenses.license_matches(table).collect():
            out.setdefault(r["doc_id"], []).append((r["license"], r["rule"], r["first_sentence"], r["last_sentence"]))
        return [sorted(out.get(i, [])) for i in range(len(texts))]

    return run


def test_published_texts(scan):
    texts = [MIT, BSD2, BSD3, GPL3, GPL2, APACHE, GPL_TITLE]
    names = [("MIT", 0), ("BSD-2-Clause", 15), ("BSD-3-Clause", 14), ("GPL-3.0", 7), ("GPL-2.0", 8), ("Apache-2.0", 6), ("GPL-3.0", 10)]
    got = scan(texts + [commented(t, m) for m in ("# ", " * ", "// ") for t in texts] + [t.replace("\n", "\r\n") for t in texts])
    assert [[x[:2] for x in g] for g in got] == [[n] for n in names] * 5
    assert got[0] == [("MIT", 0, 0, 12)] and got[5] == [("Apache-2.0", 6, 0, 1)] and got[3] == [("GPL-3.0", 7, 0, 4)]


def test_where_a_sentence_may_not_go_on(scan):
    one = "This work is licensed under\nthe GNU General Public License version 3"
    got = scan([one, one.replace("\n", "\n\n"), one.replace("\n", ".\n"), "The\nMIT\nLicense", "released\nunder the MIT License\nand more", "the MIT\nLicence", "this project is\nlicensed under the MIT license", "the\n", None, "\n\n"])
    assert got == [[("GPL-3.0", 9, 0, 1)], [], [], [], [("MIT", 3, 0, 1)], [], [("MIT", 3, 0, 1)], [], [], []]  # a title alone is no rule's
