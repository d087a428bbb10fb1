"""Licence recognition: sentences to identifiers, sequences of identifiers to licences, all in built-in expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence texts and notices, normalised (lower case, letters, digits and dots inside
# numbers only), each with its identifier. A year, a holder and a version are written *.
SENTENCES: dict[str, str] = {
    "licensed under the apache license version *": "apache-notice",
    "licensed under the apache license version * the license": "apache-notice",
    "you may not use this file except in compliance with the license": "apache-compliance",
    "you may obtain a copy of the license at http www.apache.org licenses license *": "apache-copy",
    "you may obtain a copy of the license at": "apache-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-warranty",
    "see the license for the specific language governing permissions and limitations under the license": "apache-see",
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "this project is licensed under the mit license": "mit-notice",
    "the mit license": "mit-title",
    "mit license": "mit-title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice-kept",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-liability",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd-advert",
    "this work is licensed under the gnu general public license version *": "gpl-notice",
    "licensed under the gnu general public license version *": "gpl-notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version * of the license or at your option any later version": "gpl-grant-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version * of the license": "gpl-grant-only",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version * of the license or at your option any later version": "lgpl-grant-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version * of the license or at your option any later version": "agpl-grant-later",
    "licensed under the gnu lesser general public license version *": "lgpl-notice",
    "licensed under the gnu affero general public license version *": "agpl-notice",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "see the gnu general public license for more details": "gpl-see",
    "this source code form is subject to the terms of the mozilla public license v. *": "mpl-notice",
    "this source code form is subject to the terms of the mozilla public license v *": "mpl-notice",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl *": "mpl-copy",
    "licensed under cc by nc *": "cc-by-nc-notice",
    "licensed under cc by *": "cc-by-notice",
    "licensed under cc by sa *": "cc-by-sa-notice",
    "licensed under cc by nd *": "cc-by-nd-notice",
    "licensed under cc by nc sa *": "cc-by-nc-sa-notice",
    "licensed under cc by nc nd *": "cc-by-nc-nd-notice",
    "this work is licensed under a creative commons attribution * international license": "cc-by-notice",
    "this work is licensed under a creative commons attribution sharealike * international license": "cc-by-sa-notice",
    "this work is licensed under a creative commons attribution noncommercial * international license": "cc-by-nc-notice",
    "this work is dedicated to the public domain": "public-domain",
    "this is free and unencumbered software released into the public domain": "unlicense-grant",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense-free",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "this program is free software": "gnu-free",
    "this library is free software": "gnu-free",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-grant",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl-grant",
    "you can redistribute it and or modify it under the terms of the gnu library general public license as published by the free software foundation": "lgpl-grant",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation": "agpl-grant",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version * of the license or at your option any later version": "gpl-grant-later",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version * of the license or at your option any later version": "lgpl-grant-later",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version * of the license or at your option any later version": "agpl-grant-later",
    "you can redistribute it and or modify it under the terms of the gnu general public license version * as published by the free software foundation": "gpl-grant-only",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version * of the license": "gpl-grant-only",
    "either version * of the license or at your option any later version": "gnu-later",
    "version * of the license": "gnu-only",
    "this program is distributed in the hope that it will be useful but without any warranty": "gnu-hope",
    "this library is distributed in the hope that it will be useful but without any warranty": "gnu-hope",
    "without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "this source code form is subject to the terms of the mozilla public license v.*": "mpl-notice",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl *": "mpl-copy",
    "this work is licensed under the creative commons attribution * international license": "cc-by-notice",
    "this work is licensed under the creative commons attribution sharealike * international license": "cc-by-sa-notice",
    "this work is licensed under the creative commons attribution noncommercial * international license": "cc-by-nc-notice",
    "this work is licensed under a creative commons attribution noncommercial sharealike * international license": "cc-by-nc-sa-notice",
    "this work is licensed under the creative commons attribution noncommercial sharealike * international license": "cc-by-nc-sa-notice",
    "this work is licensed under a creative commons attribution noderivatives * international license": "cc-by-nd-notice",
    "this work is licensed under the creative commons attribution noderivatives * international license": "cc-by-nd-notice",
    "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "cc0-grant",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v*": "epl-notice",
    "this program and the accompanying materials are made available under the terms of the eclipse public license * which is available at https www.eclipse.org legal epl *": "epl-notice",
    "this program and the accompanying materials are made available under the terms of the eclipse public license * which is available at http www.eclipse.org legal epl *": "epl-notice",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v. * which is available at https www.eclipse.org legal epl v20.html": "epl-notice",
    "all rights reserved": "reserved",
}

# Identifiers that may follow SPDX-License-Identifier.
SPDX = (
    "0BSD", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0",
    "CC0-1.0", "EPL-2.0", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "ISC", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "MIT", "MPL-2.0",
    "Unlicense", "Zlib",
)
NUMBERS = r"\b[0-9]+(?:\.[0-9]+)*\b"


def spdx_id(name: str) -> str:
    return "spdx-" + re.sub("[^a-z0-9]+", "-", re.sub(NUMBERS, "n", name).lower())


SENTENCES |= {"spdx license identifier " + re.sub("[^a-z0-9.*]+", " ", re.sub(NUMBERS, "*", x).lower()): spdx_id(x) for x in SPDX}

# Licences and the sentence identifiers that state them, in order. Earlier rules win over those whose
# identifiers they contain.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-endorse")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("MIT", ("mit-grant", "mit-notice-kept", "mit-warranty")),
    ("MIT", ("mit-grant", "mit-notice-kept")),
    ("MIT", ("mit-notice",)),
    ("Apache-*", ("apache-notice",)),
    ("Apache-*", ("apache-compliance", "apache-copy")),
    ("GPL-*-or-later", ("gpl-grant-later",)),
    ("GPL-*-only", ("gpl-grant-only",)),
    ("GPL-*-or-later", ("gpl-grant", "gnu-later")),
    ("GPL-*-only", ("gpl-grant", "gnu-only")),
    ("LGPL-*-or-later", ("lgpl-grant", "gnu-later")),
    ("LGPL-*-only", ("lgpl-grant", "gnu-only")),
    ("AGPL-*-or-later", ("agpl-grant", "gnu-later")),
    ("AGPL-*-only", ("agpl-grant", "gnu-only")),
    ("CC0-1.0", ("cc0-grant",)),
    ("EPL-*", ("epl-notice",)),
    ("GPL-*", ("gpl-notice",)),
    ("LGPL-*-or-later", ("lgpl-grant-later",)),
    ("LGPL-*", ("lgpl-notice",)),
    ("AGPL-*-or-later", ("agpl-grant-later",)),
    ("AGPL-*", ("agpl-notice",)),
    ("MPL-*", ("mpl-notice",)),
    ("CC-BY-NC-SA-*", ("cc-by-nc-sa-notice",)),
    ("CC-BY-NC-ND-*", ("cc-by-nc-nd-notice",)),
    ("CC-BY-NC-*", ("cc-by-nc-notice",)),
    ("CC-BY-SA-*", ("cc-by-sa-notice",)),
    ("CC-BY-ND-*", ("cc-by-nd-notice",)),
    ("CC-BY-*", ("cc-by-notice",)),
    ("Unlicense", ("unlicense-grant",)),
    ("ISC", ("isc-grant",)),
    *sorted({(re.sub(NUMBERS, "*", x), (spdx_id(x),)) for x in SPDX}),
)

#: Every sentence of the table holds one of these; texts without any are passed over.
HINTS = (
    "licens", "permission", "redistribut", "warrant", "public domain", "rights reserved", "free software", "source code form",
    "anyone is free", "in no event", "advertising materials", "the name of the copyright", "copy of the mpl",
)


def normalised(sentence: Column) -> Column:
    """Lower case, letters and digits only, dots inside names and numbers kept, versions and years written ``*``."""
    plain = F.regexp_replace(F.lower(sentence), "[^a-z0-9.]+", " ")
    plain = F.regexp_replace(F.regexp_replace(plain, r"\.+( |$)", "$1"), r"(^| )\.+", "$1")
    return F.trim(plain)


def version_free(sentence: Column) -> Column:
    return F.regexp_replace(sentence, r"\b[0-9]+(\.[0-9]+)*\b", "*")


def sentences(text: Column) -> Column:
    """A sentence ends after . ! ? ; or : before white space, and at a line break; but not in "v. 2" nor before what an SPDX mark names."""
    whole = F.regexp_replace(F.regexp_replace(text, r"\b([vV])\.[ \t]+([0-9])", "$1.$2"), r"(License-Identifier):[ \t]*", "$1-")
    return F.split(F.regexp_replace(whole, r"([.!?;:])[ \t\n\r\f]+", "$1\n"), "\n")


#: Line breaks of running text, with the comment signs that a line may begin with, and empty lines, which end a sentence.
EMPTY_LINE = r"\n[ \t\r\f]*(?:[*#]+|//+)?[ \t\r\f]*\n"
LINE_BREAK = r"[ \t\r\f]*\n[ \t]*(?:[*#]+|//+)?[ \t]*"


def running_text(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, EMPTY_LINE, ".\n"), LINE_BREAK, " ")


def version_place(ids: tuple[str, ...]) -> str:
    """A pattern whose group is the version a rule states: in its first sentence, or in the one right behind where the first has none."""
    if len(ids) > 1 and not any("*" in s for s, i in SENTENCES.items() if i == ids[0]):
        return f";{ids[0]}@[^;]*;{ids[1]}@([0-9.]*)"
    return f";{ids[0]}@([0-9.]*)"


def identifiers(text: Column) -> Column:
    """Known sentences of a text in order, as ``;id@version;id@version;``; the version is the first number in the sentence."""
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    marks = F.transform(
        F.transform(sentences(text), normalised),
        lambda s: F.concat(F.try_element_at(known, version_free(s)), F.lit("@"), F.regexp_extract(s, r"\b([0-9]+(\.[0-9]+)*)\b", 1)),
    )
    return F.concat(F.lit(";"), F.array_join(marks, ";"), F.lit(";"))


def with_version(name: str):
    """``name`` with its ``*`` replaced, and without the hyphen before it where no version is known."""
    before, after = name.split("*")
    return lambda v: F.concat(F.rtrim(F.concat(F.lit(before), v), F.lit("-")), F.lit(after))


def stated(sequence: Column) -> Column:
    """Licences whose rule the sequence holds in order, each with its version, sorted. A rule does not speak where an earlier one
    with all its sentences did."""
    holds = lambda ids: sequence.rlike("(?:[^;]*;)*?".join(f"{';' if i == 0 else ''}{x}@[^;]*;" for i, x in enumerate(ids)))
    found = []
    for i, (name, ids) in enumerate(RULES):
        said = holds(ids)
        for _, wider in RULES[:i]:
            if set(ids) <= set(wider):
                said = said & ~holds(wider)
        versions = F.regexp_extract_all(sequence, F.lit(version_place(ids)), 1)
        named = F.transform(versions, with_version(name)) if "*" in name else F.array(F.lit(name))
        found.append(F.when(said, named).otherwise(F.array().cast("array<string>")))
    return F.array_sort(F.array_distinct(F.flatten(F.array(*found))))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, licences, sentences, n_sentences)`` for every row of ``docs``.

    ``licences`` is the sorted, comma-joined list of licences found, ``sentences`` the identifiers in order. A text is read
    twice, once with line breaks ending a sentence and once as running text, so that notices wrapped over lines count; the
    licences of both readings are joined, and ``sentences`` is the reading that knows more. All is a projection of one row:
    nothing is shuffled, and long texts cost their own length. NULL and empty texts have empty results; repeated rows repeat.
    """
    # Tested as sentences are read, so a hint wrapped over a line break or with signs between its words is found.
    # The longest word of each hint, which no wrapping breaks, tells first which texts are worth that.
    lower, worth = F.lower(text), F.lit(False)
    for word in sorted({max(hint.split(), key=len) for hint in HINTS}):
        worth = worth | lower.contains(word)
    hinted = worth & normalised(F.col(text)).rlike("|".join(HINTS))
    running = running_text(F.col(text))
    lines = docs.select(
        F.col(key),
        F.when(hinted, identifiers(F.col(text))).otherwise(";").alias("_lines"),
        F.when(hinted, identifiers(running)).otherwise(";").alias("_running"),
    )
    count = lambda c: F.length(F.regexp_replace(c, "[^@]", ""))
    read = lines.withColumn("_all", F.when(count(F.col("_running")) > count(F.col("_lines")), F.col("_running")).otherwise(F.col("_lines")))
    none = F.array().cast("array<string>")
    both = F.array_sort(F.array_union(*[F.when(F.col(c).contains("@"), stated(F.col(c))).otherwise(none) for c in ("_lines", "_running")]))
    # A licence without its version says nothing beside the same one with it.
    versioned = lambda x, y: y.startswith(F.concat(x, F.lit("-"))) & F.substr(y, F.length(x) + 2, F.lit(1)).between("0", "9")
    both = F.filter(both, lambda x: ~F.exists(both, lambda y: versioned(x, y)))
    return read.select(
        key,
        F.array_join(both, ",").alias("licences"),
        F.trim(F.regexp_replace("_all", "@[^;]*;|;", " ")).alias("sentences"),
        count(F.col("_all")).cast("long").alias("n_sentences"),
    )
