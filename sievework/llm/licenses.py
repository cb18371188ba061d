"""Licence scans by sentence rules: normalised sentences become known identifiers, whose sequences are matched against ordered rules.

Only Spark expressions are used, and no row meets another, so there is no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known sentences, normalised (lower case, everything but letters and digits as one space), and their identifiers. Fixed values.
SENTENCES = {
    "licensed under the apache license version 2 0": "APACHE-NOTICE",
    "licensed under the apache license version 2 0 the license": "APACHE-NOTICE",
    "apache license version 2 0 january 2004": "APACHE-TITLE",
    "you may not use this file except in compliance with the license": "APACHE-USE",
    "you may obtain a copy of the license at": "APACHE-COPY",
    "spdx license identifier apache 2 0": "APACHE-SPDX",
    "released under the mit license": "MIT-NOTICE",
    "licensed under the mit license": "MIT-NOTICE",
    "this project is licensed under the mit license": "MIT-NOTICE",
    "the mit license mit": "MIT-TITLE",
    "mit license": "MIT-TITLE",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "MIT-GRANT",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MIT-KEEP",
    "spdx license identifier mit": "MIT-SPDX",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BSD-GRANT",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSD-SOURCE",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BSD-BINARY",
    "licensed under the bsd license": "BSD-NOTICE",
    "spdx license identifier bsd 3 clause": "BSD-SPDX",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISC-GRANT",
    "this work is licensed under the gnu general public license version 3": "GPL3-NOTICE",
    "licensed under the gnu general public license version 3": "GPL3-NOTICE",
    "gnu general public license version 3 29 june 2007": "GPL3-TITLE",
    "spdx license identifier gpl 3 0 or later": "GPL3-SPDX",
    "licensed under the gnu general public license version 2": "GPL2-NOTICE",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "GPL3-GRANT",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "GPL2-GRANT",
    "licensed under the mozilla public license version 2 0": "MPL2-NOTICE",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "MPL2-NOTICE",
    "licensed under cc by 4 0": "CCBY-NOTICE",
    "licensed under cc by sa 4 0": "CCBYSA-NOTICE",
    "licensed under cc by nc 4 0": "CCBYNC-NOTICE",
    "licensed under cc0 1 0": "CC0-NOTICE",
    "this work is licensed under a creative commons attribution 4 0 international license": "CCBY-NOTICE",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "CCBYNC-NOTICE",
}
#: Rules in order: name, class, and the identifiers that follow one another among a text's known sentences. The first rule that fits names the text.
RULES = (
    ("gpl-3.0", "copyleft", "GPL3-GRANT"),
    ("gpl-3.0", "copyleft", "GPL3-TITLE"),
    ("gpl-3.0", "copyleft", "GPL3-NOTICE"),
    ("gpl-3.0", "copyleft", "GPL3-SPDX"),
    ("gpl-2.0", "copyleft", "GPL2-GRANT"),
    ("gpl-2.0", "copyleft", "GPL2-NOTICE"),
    ("mpl-2.0", "copyleft", "MPL2-NOTICE"),
    ("cc-by-nc-4.0", "noncommercial", "CCBYNC-NOTICE"),
    ("cc-by-sa-4.0", "copyleft", "CCBYSA-NOTICE"),
    ("apache-2.0", "permissive", "APACHE-NOTICE APACHE-USE APACHE-COPY"),
    ("apache-2.0", "permissive", "APACHE-TITLE"),
    ("apache-2.0", "permissive", "APACHE-NOTICE"),
    ("apache-2.0", "permissive", "APACHE-SPDX"),
    ("mit", "permissive", "MIT-TITLE MIT-GRANT MIT-KEEP"),
    ("mit", "permissive", "MIT-GRANT MIT-KEEP"),
    ("mit", "permissive", "MIT-NOTICE"),
    ("mit", "permissive", "MIT-SPDX"),
    ("bsd", "permissive", "BSD-GRANT BSD-SOURCE BSD-BINARY"),
    ("bsd", "permissive", "BSD-NOTICE"),
    ("bsd", "permissive", "BSD-SPDX"),
    ("isc", "permissive", "ISC-GRANT"),
    ("cc-by-4.0", "permissive", "CCBY-NOTICE"),
    ("cc0-1.0", "permissive", "CC0-NOTICE"),
)
#: Sentences and rules of standard texts, whole as their licences have them; SENTENCES and RULES are those that the SQL knows too.
_MIT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"
_GPL = "{} is free software you can redistribute it and or modify it under the terms of the gnu {} as published by the free software foundation either version {} of the license or at your option any later version"
_ISC = "permission to use copy modify and {}distribute this software for any purpose with or without fee is hereby granted{}"
_ISC_KEEP = " provided that the above copyright notice and this permission notice appear in all copies"
_APACHE = "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"
_PUBLIC = {"GPL2": ("general public license", "2"), "GPL3": ("general public license", "3"), "LGPL2": ("library general public license", "2"), "LGPL21": ("lesser general public license", "2 1"), "LGPL3": ("lesser general public license", "3"), "AGPL3": ("affero general public license", "3")}
_DATES = {"GPL2": "june 1991", "GPL3": "29 june 2007", "LGPL2": "june 1991", "LGPL21": "february 1999", "LGPL3": "29 june 2007", "AGPL3": "19 november 2007"}
_SPDX = {
    "APACHE": ["Apache-2.0"], "MIT": ["MIT"], "BSD": ["BSD-2-Clause", "BSD-3-Clause"], "ISC": ["ISC"], "0BSD": ["0BSD"], "UNLICENSE": ["Unlicense"], "ZLIB": ["Zlib"], "BSL": ["BSL-1.0"],
    "MPL2": ["MPL-2.0"], "EPL2": ["EPL-2.0"], "CC0": ["CC0-1.0"], "CCBY": ["CC-BY-4.0"], "CCBYSA": ["CC-BY-SA-4.0"], "CCBYNC": ["CC-BY-NC-4.0"],
    **{k: [f"{n}-{v}{end}" for end in ("", "+", "-only", "-or-later")] for k, n, v in (("GPL2", "GPL", "2.0"), ("GPL3", "GPL", "3.0"), ("LGPL2", "LGPL", "2.0"), ("LGPL21", "LGPL", "2.1"), ("LGPL3", "LGPL", "3.0"), ("AGPL3", "AGPL", "3.0"))},
}
WHOLE_SENTENCES = {
    _MIT + " subject to the following conditions": "MIT-GRANT",
    "the mit license": "MIT-TITLE",
    _APACHE: "APACHE-GRANT",
    "licensed to the apache software foundation asf under one or more contributor license agreements": "APACHE-ASF",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BSD-BINARY",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "MPL2-NOTICE",
    "mozilla public license version 2 0": "MPL2-TITLE",
    "eclipse public license v 2 0": "EPL2-TITLE",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "EPL2-NOTICE",
    "boost software license version 1 0 august 17th 2003": "BSL-TITLE",
    "this is free and unencumbered software released into the public domain": "UNLICENSE-GRANT",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "ZLIB-GRANT",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "CCBYSA-NOTICE",
    **{_ISC.format(x, _ISC_KEEP): "ISC-GRANT" for x in ("", "or ")},
    **{_ISC.format(x, ""): "0BSD-GRANT" for x in ("", "or ")},
    **{f"gnu {name} version {v} {_DATES[k]}": f"{k}-TITLE" for k, (name, v) in _PUBLIC.items()},
    **{_GPL.format(it, name, v): f"{k}-GRANT" for k, (name, v) in _PUBLIC.items() for it in ("this program", "this software", "this library", "this file", "it")},
    **{_GPL.format("this program", name, v).replace("either version", "version").partition(" or at your option")[0]: f"{k}-GRANT" for k, (name, v) in _PUBLIC.items()},
    **{_GPL.format("this program", f"{name} version {v}", v).partition(" either version")[0]: f"{k}-GRANT" for k, (name, v) in _PUBLIC.items()},
    **{"spdx license identifier " + " ".join(x.lower().replace("+", " ").replace("-", " ").replace(".", " ").split()): f"{k}-SPDX" for k, ids in _SPDX.items() for x in ids},
}
WHOLE_SENTENCES = {s: i for s, i in WHOLE_SENTENCES.items() if s not in SENTENCES}
WHOLE_RULES = (
    *((name, "copyleft", f"{k}-{kind}") for k, name in (("GPL3", "gpl-3.0"), ("GPL2", "gpl-2.0"), ("AGPL3", "agpl-3.0"), ("LGPL3", "lgpl-3.0"), ("LGPL21", "lgpl-2.1"), ("LGPL2", "lgpl-2.0")) for kind in ("GRANT", "TITLE", "SPDX")),
    ("mpl-2.0", "copyleft", "MPL2-TITLE"), ("mpl-2.0", "copyleft", "MPL2-SPDX"), ("epl-2.0", "copyleft", "EPL2-TITLE"), ("epl-2.0", "copyleft", "EPL2-NOTICE"), ("epl-2.0", "copyleft", "EPL2-SPDX"),
    ("cc-by-nc-4.0", "noncommercial", "CCBYNC-SPDX"), ("cc-by-sa-4.0", "copyleft", "CCBYSA-SPDX"),
    ("apache-2.0", "permissive", "APACHE-GRANT"), ("apache-2.0", "permissive", "APACHE-USE APACHE-COPY"),
    ("mit", "permissive", "MIT-GRANT"), ("mit", "permissive", "MIT-TITLE"),
    ("bsd", "permissive", "BSD-GRANT"), ("isc", "permissive", "ISC-SPDX"), ("0bsd", "permissive", "0BSD-GRANT"), ("0bsd", "permissive", "0BSD-SPDX"),
    ("unlicense", "permissive", "UNLICENSE-GRANT"), ("unlicense", "permissive", "UNLICENSE-SPDX"), ("zlib", "permissive", "ZLIB-GRANT"), ("zlib", "permissive", "ZLIB-SPDX"), ("bsl-1.0", "permissive", "BSL-TITLE"), ("bsl-1.0", "permissive", "BSL-SPDX"),
    ("cc-by-4.0", "permissive", "CCBY-SPDX"), ("cc0-1.0", "permissive", "CC0-SPDX"),
)
_names = list(dict.fromkeys(name for name, _, _ in sorted((*RULES, *WHOLE_RULES), key=lambda r: r[1] == "permissive")))
#: Rules of a name stand together, permissive ones last.
ALL_RULES = tuple(dict.fromkeys(sorted((*RULES, *WHOLE_RULES), key=lambda r: _names.index(r[0]))))
ALL_SENTENCES = {**SENTENCES, **WHOLE_SENTENCES}
#: Every known sentence holds one of these; a text without any has no known sentence.
STEMS = ("licen", "permi", "redistribut", "apache", "copyright", "mozilla", "unencumbered")
assert all(any(x in s for x in STEMS) for s in ALL_SENTENCES)

#: A piece ends at a line's end or at white space after one of these marks; a sentence is one piece or several in a row.
_END = r"([.!?:])[\x20\x09-\x0D]+"
#: Known sentences from the start of a piece to the end of one: those of one piece that the SQL knows, else the longest one.
_KNOWN = "\n(" + "|".join([*SENTENCES, *(s.replace(" ", "[ \n]") for s in sorted(ALL_SENTENCES, key=lambda s: (-len(s), s)))]) + ")(?=\n)"


def _pieces(text: Column) -> Column:
    """The text's normalised pieces (lower case, everything but letters and digits as one space) that are not empty, with a line end before and after each."""
    lines = F.regexp_replace(F.lower(F.regexp_replace(text, _END, "$1\n")), "[^a-z0-9\n\r]+", " ")
    return F.regexp_replace(F.concat(F.lit("\n"), lines, F.lit("\n")), " ?[\n\r][ \n\r]*", "\n")


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with sentence_ids array (the known sentences in order, whole text), licenses (names of all rules that fit, in
    order of the rules), license and license_class (of the first rule that fits, else null).

    Sentences may go over any number of lines; comment marks count as white space. Null and empty texts, and texts without
    a known sentence, have empty arrays and null names. Columns of docs named like an output are replaced. Every row stands
    by itself."""
    docs = docs.drop("sentence_ids", "licenses", "license", "license_class")
    known = F.create_map(*(F.lit(x) for pair in ALL_SENTENCES.items() for x in pair))
    t = F.col(text)
    some = F.lower(t).rlike("|".join(STEMS))
    found = F.regexp_extract_all(_pieces(t), F.lit(_KNOWN), F.lit(1))
    ids = F.array_compact(F.transform(found, lambda s: F.element_at(known, F.translate(s, "\n", " "))))
    none = F.lit(None).cast("array<string>")
    docs = docs.withColumn("sentence_ids", F.coalesce(F.when(some, ids).otherwise(none), F.array().cast("array<string>")))
    docs = docs.withColumn("_line", F.concat(F.lit(" "), F.array_join("sentence_ids", "  "), F.lit(" ")))
    fits = [(name, kind, F.col("_line").contains("  ".join(["", *rule.split(), ""])[1:-1])) for name, kind, rule in ALL_RULES]
    names = F.array_distinct(F.array_compact(F.array(*(F.when(fit, name) for name, _, fit in fits))))
    kind = F.coalesce(*(F.when(fit, kind) for _, kind, fit in fits))
    return docs.withColumns({"licenses": names, "license": F.try_element_at(names, F.lit(1)), "license_class": kind}).drop("_line")
