"""License scans: sentences to known identifiers, identifier sequences to ordered rules; DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: identifier -> normalised sentence. The sentences by which public licences, their headers and their titles are known.
SENTENCES = {
    "apache-2": "licensed under the apache license version 2 0",
    "apache-2-the": "licensed under the apache license version 2 0 the license",
    "apache-asf": "the asf licenses this file to you under the apache license version 2 0 the license",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-title": "apache license version 2 0 january 2004",
    "arr": "all rights reserved",
    "mit-name": "released under the mit license",
    "mit-short": "this project is licensed under the mit license",
    "mit-head": "the mit license mit",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "gpl-3": "this work is licensed under the gnu general public license version 3",
    "gpl-3-title": "gnu general public license version 3 29 june 2007",
    "gpl-2-title": "gnu general public license version 2 june 1991",
    "gpl-redist": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-2-redist": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-2-only": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "gpl-2-only-of": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2 of the license",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl-21-title": "gnu lesser general public license version 2 1 february 1999",
    "lgpl-3-title": "gnu lesser general public license version 3 29 june 2007",
    "lgpl-21-redist": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl-3-redist": "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-warranty": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "agpl-title": "gnu affero general public license version 3 19 november 2007",
    "agpl-redist": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "mpl-form": "this source code form is subject to the terms of the mozilla public license v",
    "mpl-obtain": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "mpl-obtain-s": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "mpl-title": "mozilla public license version 2 0",
    "epl-2": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "epl-2-title": "eclipse public license v 2 0",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-grant-and": "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "postgresql-grant": "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "cc0": "cc0 1 0 universal",
    "wtfpl": "do what the fuck you want to public license",
    "bsl-header": "distributed under the boost software license version 1 0",
    "bsl-title": "boost software license version 1 0 august 17th 2003",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-altered": "altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
    "artistic-2": "the artistic license 2 0",
    "psf-2": "python software foundation license version 2",
    "ms-pl": "microsoft public license ms pl",
    "ofl-11": "this font software is licensed under the sil open font license version 1 1",
    "cddl-10": "common development and distribution license cddl version 1 0",
    "cc-by-nc-4": "licensed under cc by nc 4 0",
    "cc-by-4": "licensed under cc by 4 0",
    "cc-by-sa-4": "licensed under cc by sa 4 0",
    "bsd-head": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-advertise": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
}
#: The clause on names with any holder's, and with the words that SENTENCES has.
HOLDER = ("^neither the name of [a-z0-9 ]+ nor the names of (its|any|other) contributors", "neither the name of the copyright holder nor the names of its contributors")
#: (license, identifiers that follow one another in this order, others between them or not)
LICENSE_RULES = (
    ("apache-2.0", ("apache-2",)),
    ("apache-2.0", ("apache-2-the", "apache-comply")),
    ("apache-2.0", ("apache-2-the", "apache-copy")),
    ("apache-2.0", ("apache-asf", "apache-comply")),
    ("apache-2.0", ("apache-title",)),
    ("mit", ("mit-name",)),
    ("mit", ("mit-short",)),
    ("mit", ("mit-head", "mit-notice")),
    ("mit", ("mit-grant", "mit-notice")),
    ("gpl-3.0", ("gpl-3",)),
    ("gpl-3.0", ("gpl-3-title",)),
    ("gpl-3.0", ("gpl-3-title", "gpl-redist", "gpl-warranty")),
    ("gpl-3.0-or-later", ("gpl-redist", "gpl-warranty")),
    ("gpl-2.0", ("gpl-2-title",)),
    ("gpl-2.0", ("gpl-2-title", "gpl-2-redist", "gpl-warranty")),
    ("gpl-2.0-or-later", ("gpl-2-redist", "gpl-warranty")),
    ("gpl-2.0-only", ("gpl-2-only", "gpl-warranty")),
    ("gpl-2.0-only", ("gpl-2-only-of", "gpl-warranty")),
    ("lgpl-2.1", ("lgpl-21-title",)),
    ("lgpl-2.1", ("lgpl-21-title", "lgpl-21-redist", "lgpl-warranty")),
    ("lgpl-2.1-or-later", ("lgpl-21-redist", "lgpl-warranty")),
    ("lgpl-3.0", ("lgpl-3-title",)),
    ("lgpl-3.0-or-later", ("lgpl-3-redist", "gpl-warranty")),
    ("agpl-3.0", ("agpl-title",)),
    ("agpl-3.0", ("agpl-title", "agpl-redist", "gpl-warranty")),
    ("agpl-3.0-or-later", ("agpl-redist", "gpl-warranty")),
    ("mpl-2.0", ("mpl-form", "mpl-obtain")),
    ("mpl-2.0", ("mpl-form", "mpl-obtain-s")),
    ("mpl-2.0", ("mpl-title",)),
    ("epl-2.0", ("epl-2",)),
    ("epl-2.0", ("epl-2-title",)),
    ("isc", ("isc-grant",)),
    ("isc", ("isc-grant-and",)),
    ("0bsd", ("0bsd-grant",)),
    ("postgresql", ("postgresql-grant",)),
    ("unlicense", ("unlicense",)),
    ("cc0-1.0", ("cc0",)),
    ("wtfpl", ("wtfpl",)),
    ("bsl-1.0", ("bsl-header",)),
    ("bsl-1.0", ("bsl-title",)),
    ("zlib", ("zlib-as-is", "zlib-altered")),
    ("artistic-2.0", ("artistic-2",)),
    ("psf-2.0", ("psf-2",)),
    ("ms-pl", ("ms-pl",)),
    ("ofl-1.1", ("ofl-11",)),
    ("cddl-1.0", ("cddl-10",)),
    ("cc-by-nc-4.0", ("cc-by-nc-4",)),
    ("cc-by-4.0", ("cc-by-4",)),
    ("cc-by-sa-4.0", ("cc-by-sa-4",)),
    ("bsd-2-clause", ("bsd-head", "bsd-source", "bsd-binary")),
    ("bsd-3-clause", ("bsd-head", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("bsd-4-clause", ("bsd-head", "bsd-source", "bsd-binary", "bsd-advertise", "bsd-endorse")),
    ("all-rights-reserved", ("arr",)),
)
#: Licences that an SPDX tag names; each tag is a sentence and a rule of its own.
SPDX = (
    "mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "gpl-2.0", "gpl-2.0-only", "gpl-2.0-or-later", "gpl-3.0", "gpl-3.0-only", "gpl-3.0-or-later", "lgpl-2.1", "lgpl-2.1-only", "lgpl-2.1-or-later",
    "lgpl-3.0-only", "lgpl-3.0-or-later", "agpl-3.0-only", "agpl-3.0-or-later", "mpl-2.0", "epl-2.0", "isc", "0bsd", "unlicense", "cc0-1.0", "cc-by-4.0", "cc-by-sa-4.0", "zlib", "bsl-1.0",
)
SENTENCES |= {f"spdx-{x}": "spdx license identifier " + x.replace("-", " ").replace(".", " ") for x in SPDX}
LICENSE_RULES += tuple((x, (f"spdx-{x}",)) for x in SPDX)


def _within(a: tuple, b: tuple) -> bool:
    rest = iter(b)
    return all(x in rest for x in a)


#: For each rule the longer ones whose identifiers hold its own in its order: where one of those fits, the shorter rule says nothing.
LONGER = {seq: [other for _, other in LICENSE_RULES if len(other) > len(seq) and _within(seq, other)] for _, seq in LICENSE_RULES}


def _normal(s: Column) -> Column:
    """A sentence in lower case, all but a-z and 0-9 one space; in the clause on names any holder is `the copyright holder`."""
    t = F.trim(F.regexp_replace(ascii_lower(s), "[^a-z0-9]+", " "))
    return F.regexp_replace(t, *HOLDER)


def _let(value: Column, f) -> Column:
    """f of a value that is computed once: what a lambda's argument stands for is, what an expression inside a lambda says is not."""
    return F.element_at(F.transform(F.array(value), f), 1)


def sentences(text: Column) -> Column:
    """Known normalised sentences in order, A-Z lower-cased, all but a-z and 0-9 one space, so that comment marks go. Two readings: whole lines, cut at
    . ! or ? before white space; and sentences over lines, which end at . ! ? : or ; before white space, at lines without letters and
    digits and before list numbers, which are left out. What both give counts once; a sentence may also hold a : or ; inside. Every line is
    normalised a bounded number of times, however long its block is.
    """
    number = r"(?:[0-9]{1,2}|[A-Za-z])[.)][ \t]+"
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"[.!?][ \t\r]+", "\n\n")
    t = F.regexp_replace(t, r"[.!?][\"')\]]*\n", "\n\n")
    t = F.regexp_replace(t, rf"\n(?=[^\p{{L}}\p{{N}}\n]{{0,20}}{number})", "\n\n")
    known = lambda a: F.filter(a, lambda s: s.isin(*SENTENCES.values()))
    whole = lambda s: known(F.array(_normal(F.regexp_replace(s, rf"^[^\p{{L}}\p{{N}}]*{number}", ""))))
    lines = lambda s: known(F.transform(F.split(s, "\n"), _normal))
    # the first's that the second lacks, then the second's; and the other way round
    before = lambda a, b: _let(F.struct(a.alias("a"), b.alias("b")), lambda r: F.concat(F.filter(r.a, lambda x: ~F.array_contains(r.b, x)), r.b))
    after = lambda a, b: _let(F.struct(a.alias("a"), b.alias("b")), lambda r: F.concat(r.a, F.filter(r.b, lambda x: ~F.array_contains(r.a, x))))
    both = lambda s: before(whole(s), lines(s))

    def read(s: Column) -> Column:
        pieces = F.flatten(F.transform(F.split(s, r"[:;][\"')\]]*\s+"), both))
        return F.when(s.rlike(r"[:;][\"')\]]*\s"), after(pieces, both(s))).otherwise(both(s))

    return F.flatten(F.transform(F.split(t, r"\n[^\p{L}\p{N}]*\n"), read))


def licenses(docs: DataFrame) -> DataFrame:
    """For every row of docs (doc_id, text): doc_id, sentence_ids (of all known sentences, in order) and licenses (sorted), arrays.

    A rule fits when its identifiers occur in its order, with any others between; of rules that fit, one whose identifiers are part of
    a longer one's says nothing, so a text of four clauses is no text of three. Null and empty texts have none; repeated
    rows are each scanned; an empty table gives an empty one; other columns of docs are not looked at.
    """
    known = F.create_map(*[F.lit(x) for i, s in SENTENCES.items() for x in (s, i)])
    ids = F.transform(sentences(F.col("text")), lambda s: known[s])
    marked = docs.select("doc_id", ids.alias("sentence_ids")).withColumn("_seq", F.concat_ws("", F.transform("sentence_ids", lambda i: F.concat(F.lit("|"), i, F.lit("|")))))
    fits = lambda seq: F.col("_seq").like("%" + "%".join(f"|{i}|" for i in seq) + "%")
    names = [F.when(reduce(lambda a, b: a & ~fits(b), LONGER[seq], fits(seq)), name) for name, seq in LICENSE_RULES]
    # most texts have no known sentence, and then no rule is tried
    found = F.when(F.size("sentence_ids") > 0, F.array_sort(F.array_distinct(F.array_compact(F.array(*names))))).otherwise(F.array().cast("array<string>"))
    return marked.select("doc_id", "sentence_ids", found.alias("licenses"))
