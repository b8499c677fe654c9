"""License scans: known sentences become identifiers, and ordered identifier sequences are matched against rules.

A text is cut into pieces at line feeds and at `.`, `!`, `?`, `;` or `:` followed by white space; a piece is
normalised to lower-case letters and digits with single spaces, so comment marks vanish. Known sentences form a fixed table.
A known sentence may be wrapped: it is looked up in a piece and in that piece with those after it, over single line feeds
and semicolons, but not over other sentence ends or empty lines. The longest wins, and sentences found don't overlap. A rule
is an ordered list of sentence identifiers: it matches where its identifiers follow one another among the known sentences of
a document, up to `GAP` other sentences between them; lines that go on with a sentence, empty lines and bare numbers don't
count. Where several rules match at one place, the longest wins.

The SQL beside the query knows no wrapped sentences: it gives the same rows where every known sentence stands on one line.

Only built-in functions are used. Sentences that aren't known are dropped before anything is shuffled, and a document's
hits are grouped by document, so a hot source or sentence makes no hot group.

Edge cases: comment marks made of letters (`rem`, `dnl`) aren't told from words; null and empty texts have no hits; repeated rows (equal ids and texts) are scanned once each; a license named
twice gives two rows; columns other than id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences that name or open well-known licenses, normalised, with their identifiers.
SENTENCES = {
    "released under the mit license": "mit-released",
    "licensed under the mit license": "mit-released",
    "this project is licensed under the mit license": "mit-released",
    "the mit license": "mit-title",
    "mit license": "mit-title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "licensed under the apache license version 2 0": "apache2-licensed",
    "licensed under the apache license version 2 0 the license": "apache2-licensed",
    "you may not use this file except in compliance with the license": "apache2-comply",
    "you may obtain a copy of the license at": "apache2-copy",
    "apache license version 2 0 january 2004": "apache2-title",
    "this work is licensed under the gnu general public license version 3": "gpl3-licensed",
    "licensed under the gnu general public license version 3": "gpl3-licensed",
    "gnu general public license version 3 29 june 2007": "gpl3-title",
    "this program is free software": "gpl-free",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-terms",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-terms",
    "licensed under cc by nc 4 0": "cc-by-nc4",
    "licensed under cc by 4 0": "cc-by4",
    "licensed under cc by sa 4 0": "cc-by-sa4",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by4",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc4",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "this is free and unencumbered software released into the public domain": "unlicense-open",
}

#: Rules as ordered identifiers, and what they detect.
RULES = [
    ("MIT", ["mit-title", "mit-grant", "mit-notice"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("MIT", ["mit-grant"]),
    ("MIT", ["mit-released"]),
    ("Apache-2.0", ["apache2-licensed", "apache2-comply", "apache2-copy"]),
    ("Apache-2.0", ["apache2-licensed"]),
    ("Apache-2.0", ["apache2-title"]),
    ("GPL-3.0", ["gpl-free", "gpl3-terms"]),
    ("GPL-2.0", ["gpl-free", "gpl2-terms"]),
    ("GPL-3.0", ["gpl3-licensed"]),
    ("GPL-3.0", ["gpl3-title"]),
    ("CC-BY-NC-4.0", ["cc-by-nc4"]),
    ("CC-BY-4.0", ["cc-by4"]),
    ("CC-BY-SA-4.0", ["cc-by-sa4"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant"]),
    ("Unlicense", ["unlicense-open"]),
]

GAP = 4
#: Where a text is cut: at a sentence end with white space after it, or at a line feed.
CUT = r"[.!?;:]*\n|[.!?;:]+[\x20\x09\x0B-\x0D]+"
NOT_WORD = r"[^A-Za-z0-9]+"


def sentences(text: Column) -> Column:
    """The sentences of a text, as written; normalise() maps one to the form of the table."""
    return F.split(text, CUT)


def normalise(sentence: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(sentence, NOT_WORD, " ")))


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _known(piece: Column, cut: Column, at: Column, table: dict[str, str]) -> Column:
    """place, last, sid: the longest known sentence that begins with the piece at a place; sid is null if there is none.

    cut[k] is what stands between pieces k and k + 1. Pieces are joined as long as some known sentence goes on after them.
    """
    most = max(len(s.split(" ")) for s in table)
    names = F.array(*[F.lit(s) for s in table])
    state = "struct<text:string,n:int,last:int,sid:string,open:boolean>"

    def step(a: Column, p: Column) -> Column:
        before = F.get(cut, at + a["n"] - 1)

        def joined(w: Column) -> Column:
            text = F.when(a["n"] == 0, w).when(w == "", a["text"]).otherwise(F.concat(a["text"], F.lit(" "), w))
            ends = (a["n"] > 0) & (before.rlike("[.!?:]") | ((w == "") & before.contains("\n")))
            go = lambda t: _let(F.element_at(_lookup(table), t), lambda sid: F.struct(
                t.alias("text"), (a["n"] + 1).alias("n"), F.when(sid.isNotNull() & (w != ""), at + a["n"]).otherwise(a["last"]).alias("last"),
                F.coalesce(sid, a["sid"]).alias("sid"), F.exists(names, lambda s: s.startswith(F.concat(t, F.lit(" ")))).alias("open"),
            ).cast(state))
            stop = F.struct(a["text"].alias("text"), a["n"].alias("n"), a["last"].alias("last"), a["sid"].alias("sid"), F.lit(False).alias("open")).cast(state)
            return F.when(ends, stop).otherwise(_let(text, go))

        return F.when(a["open"], _let(normalise(p), joined)).otherwise(a)

    none = F.struct(F.lit("").alias("text"), F.lit(0).alias("n"), F.lit(-1).alias("last"), F.lit(None).cast("string").alias("sid"), F.lit(True).alias("open")).cast(state)
    return F.aggregate(F.slice(piece, at + 1, 2 * most), none, step, lambda a: F.struct(at.alias("place"), a["last"].alias("last"), a["sid"].alias("sid")))


def _hits(piece: Column, cut: Column, table: dict[str, str]) -> Column:
    """The known sentences of a text in order: place, last, sid, and the number of sentences begun before place and up to last."""
    opening = "|".join(sorted({s.split(" ")[0] for s in table}))
    likely = F.filter(
        F.transform(piece, lambda s, i: F.struct(i.alias("place"), s.alias("raw"))),
        lambda x: x["raw"].rlike(rf"(?i)^[^a-z0-9]*(?:{opening})(?:[^a-z0-9]|$)"),
    )
    named = F.filter(F.transform(likely, lambda x: _known(piece, cut, x["place"], table)), lambda h: h["sid"].isNotNull())
    apart = F.aggregate(
        named, F.array().cast("array<struct<place:int,last:int,sid:string>>"),
        lambda a, h: F.when(h["place"] > F.coalesce(F.get(a, F.size(a) - 1)["last"], F.lit(-1)), F.concat(a, F.array(h))).otherwise(a),
    )
    begins = lambda s, i: s.rlike(r"\p{L}") & ((i == 0) | F.get(cut, i - 1).rlike("[.!?;:]") | ~F.get(piece, i - 1).rlike("[A-Za-z0-9]"))

    def counted(found: Column) -> Column:
        def row(h: Column, begun: Column) -> Column:
            n = lambda k: F.size(F.filter(F.slice(begun, 1, k), lambda b: b))
            return F.struct(h["place"].alias("place"), h["last"].alias("last"), h["sid"].alias("sid"), n(h["place"]).alias("before"), n(h["last"] + 1).alias("upto"))

        # A single hit has nothing to be counted from.
        begun = F.when(F.size(found) > 1, F.transform(piece, begins)).otherwise(F.array().cast("array<boolean>"))
        return _let(begun, lambda b: F.transform(found, lambda h: row(h, b)))

    return _let(apart, counted)


def license_matches(docs: DataFrame, *, id_col="doc_id", text_col="text", table=None, rules=None, gap: int = GAP) -> DataFrame:
    """One row per match: id, license, rule (its place in `rules`), first_sentence, last_sentence (places of the first and
    the last piece).

    A rule matches at the place of its first identifier if each next identifier is the next known sentence and at most gap
    other sentences stand between. Of the rules that match at one place the one with most identifiers wins, then the
    earliest; a match that lies within a longer one that began earlier is dropped.
    """
    table, rules = table or SENTENCES, rules or RULES
    text = F.col(text_col)
    cuts = F.struct(sentences(text).alias("piece"), F.regexp_extract_all(text, F.lit(CUT), F.lit(0)).alias("cut"))
    # The text itself goes no further than this projection; the hits of a document are a short array.
    hits = docs.filter(text.isNotNull()).select(F.col(id_col).alias("id"), _let(cuts, lambda v: _hits(v["piece"], v["cut"], table)).alias("hits"))

    def match(hits: Column, at: Column) -> Column:
        found = F.lit(None).cast("struct<license:string,rule:int,n:int,at:int,first_sentence:int,last_sentence:int>")
        for k, (name, ids) in sorted(enumerate(rules), key=lambda r: (len(r[1][1]), -r[0])):
            whole = F.size(hits) - at >= len(ids)
            for j, sid in enumerate(ids):
                whole = whole & (F.get(hits, at + j)["sid"] == sid)
                if j:
                    whole = whole & (F.get(hits, at + j)["before"] - F.get(hits, at + j - 1)["upto"] <= gap)
            row = [("license", F.lit(name)), ("rule", F.lit(k)), ("n", F.lit(len(ids))), ("at", at.cast("int")), ("first_sentence", F.get(hits, at)["place"].cast("int")), ("last_sentence", F.get(hits, at + len(ids) - 1)["last"].cast("int"))]
            found = F.when(whole, F.struct(*[c.alias(n) for n, c in row])).otherwise(found)
        return found

    every = _let(F.col("hits"), lambda h: F.filter(F.transform(h, lambda _, at: match(h, at)), lambda m: m.isNotNull()))
    inner = lambda a, m: F.exists(a, lambda o: (o["at"] < m["at"]) & (o["at"] + o["n"] >= m["at"] + m["n"]))
    kept = hits.select("id", F.explode(_let(every, lambda a: F.filter(a, lambda m: ~inner(a, m)))).alias("m"))
    return kept.select(F.col("id").alias(id_col), "m.license", "m.rule", "m.first_sentence", "m.last_sentence")
