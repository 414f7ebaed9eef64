"""License scans: known licence sentences, and rules over their order.

A text is cut into sentences, each is normalised and looked up in a table of known licence sentences. What
a document has of them, in order, is a sequence of sentence identifiers; ordered rules match identifiers in
that sequence, the first rule that matches takes them, and what is left is matched by later rules. All of
it is DataFrame functions; only documents with a word of a known sentence are cut into sentences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence texts and notices, normalised (letters and digits in lower case,
# everything else one space), with an identifier of one character each.
SENTENCES = {
    "a": "licensed under the apache license version 2 0",
    "b": "licensed under the apache license version 2 0 the license",
    "c": "you may not use this file except in compliance with the license",
    "d": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "e": "released under the mit license",
    "f": "licensed under the mit license",
    "g": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "h": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "i": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "j": "this work is licensed under the gnu general public license version 3",
    "k": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "l": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "m": "licensed under cc by nc 4 0",
    "n": "licensed under cc by 4 0",
    "o": "licensed under cc by sa 4 0",
    "p": "this work is licensed under a creative commons attribution 4 0 international license",
    "q": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "r": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "s": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "t": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "u": "all rights reserved",
}

# Rules in order, (licence, pattern over identifiers).
RULES = (
    ("BSD-3-Clause", "qrst"),
    ("BSD-2-Clause", "qrs"),
    ("MIT", "ghi"),
    ("MIT", "gh|[ef]"),
    ("Apache-2.0", "bcd?"),
    ("Apache-2.0", "[ab]"),
    ("GPL-3.0-or-later", "k"),
    ("GPL-2.0-or-later", "l"),
    ("GPL-3.0", "j"),
    ("CC-BY-NC-4.0", "m"),
    ("CC-BY-SA-4.0", "o"),
    ("CC-BY-4.0", "[np]"),
    ("Proprietary", "u"),
)

#: Sentences that notices write with a semicolon or colon inside, at which the cut falls: the words before it.
PIECES = {"k": ("free software", "software foundation"), "l": ("free software", "software foundation")}

#: A word of every sentence, in lower case.
_HINT = "licens|redistribut|permission|copyright|warranty|neither|reserved"


def _cut(text: Column) -> Column:
    """The text normalised, with letters that it has no more for its cuts: P after ; : and S after . ! ? before white
    space, S for other than single line ends, L for single ones."""
    text = F.regexp_replace(F.lower(text), r"(?<=[;:])\s+", "P")
    text = F.regexp_replace(text, r"(?<=[.!?])\s+|(?<![\n\r])(?!\r?\n(?![\n\r]))[\n\r]+", "S")
    text = F.regexp_replace(text, r"\r?\n", "L")
    return F.regexp_replace(text, "[^a-z0-9PSL]+", " ")


def _pattern(name: str) -> str:
    """A known sentence from cut to cut; its lines may be wrapped, and its pieces cut apart."""
    sentence = SENTENCES[name].replace(" ", "[ L]+")
    for words in PIECES.get(name, ()):
        words = words.replace(" ", "[ L]+")
        sentence = sentence.replace(f"{words}[ L]+", f"{words}[ LP]+", 1)
    return sentence


def identifiers(text: Column) -> Column:
    """The identifiers of a text's known sentences, in their order, as one string."""
    longest_first = sorted(SENTENCES, key=lambda name: -len(SENTENCES[name]))
    known = "|".join(map(_pattern, longest_first))
    pattern = rf"(?<=^ ?|[PSL] ?)(?:{known})(?= ?(?:[PSL]|\z))"
    names = F.create_map(*[F.lit(x) for name, sentence in SENTENCES.items() for x in (sentence, name)])
    found = F.regexp_extract_all(_cut(text), F.lit(pattern), F.lit(0))
    return F.array_join(F.transform(found, lambda s: names[F.regexp_replace(s, "[ PL]+", " ")]), "")


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Each document row with ``sentence_ids`` and ``licenses``: the names of the rules that match, in the order
    of the rules, joined by commas; both empty where nothing is known.

    A sentence ends at a line end or goes on over single ones, each sentence for itself. Null texts have no
    licence. Equal rows and other columns stay; columns of the given names are replaced.
    """
    docs = docs.drop("sentence_ids", "licenses")
    body = F.coalesce(F.col(text), F.lit(""))
    hint = F.lower(body).rlike(_HINT)
    out = docs.withColumn("sentence_ids", F.when(hint, identifiers(body)).otherwise(F.lit("")))
    # each rule takes what it matches, and leaves a mark that nothing matches across
    state = F.struct(F.col("sentence_ids").alias("left"), F.array().cast("array<string>").alias("names"))
    rules = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("pattern")) for n, p in RULES])
    taken = F.aggregate(
        rules,
        state,
        lambda acc, r: F.struct(
            F.regexp_replace(acc["left"], r["pattern"], ".").alias("left"),
            F.when(F.regexp_like(acc["left"], r["pattern"]), F.array_append(acc["names"], r["name"])).otherwise(acc["names"]).alias("names"),
        ),
        lambda acc: F.array_join(F.array_distinct(acc["names"]), ","),
    )
    out = out.withColumn("licenses", F.when(F.col("sentence_ids") == "", F.lit("")).otherwise(taken))
    return out.select(*docs.columns, "sentence_ids", "licenses")
