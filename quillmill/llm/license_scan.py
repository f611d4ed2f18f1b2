"""Licence recognition by sentences and ordered rules, by built-in functions alone.

A text is normalised as a whole first: lower case, British spellings, comment marks at
the beginnings of lines, and line breaks inside a paragraph become spaces, so that a
wrapped notice reads as one line; a line that is a whole grant sentence stays one.  It is
then cut into sentences: at paragraphs, and after a full stop, a semicolon or a colon
before white space, but not inside a version number ("v. 2.0").  The table's own sentences are
cut by the same rule, so a table sentence that holds a semicolon is two that follow one
another.  Each sentence is normalised (marks, definitions in brackets such as (the
"License"), copyright lines) and those that the table knows become sentence identifiers.

A rule is an ordered list of identifiers.  It matches where they follow one another in
that order; unknown sentences between them don't matter, and neither do known ones that
no rule begins with.  Longer rules are tried first, and the sentences that one has used
are taken.

Only texts with a word that every known sentence needs are cut at all.  Nothing is
shuffled: the table is bounded and written into the plan.

Null and empty texts have no licences.  Rows are independent; repeated rows repeat their
result; further columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Licence identifiers with the names by which sentences call them (normalised).
NAMES: dict[str, tuple[str, ...]] = {
    "MIT": ("mit license", "mit", "expat license"),
    "Apache-2.0": ("apache license version 2.0", "apache license 2.0", "apache 2.0 license", "apache-2.0", "apache-2.0 license"),
    "GPL-3.0": ("gnu general public license version 3", "gnu general public license version 3.0", "gnu general public license v3.0", "gnu gpl version 3", "gnu gpl v3", "gplv3"),
    "GPL-2.0": ("gnu general public license version 2", "gnu general public license version 2.0", "gnu general public license v2.0", "gnu gpl version 2", "gnu gpl v2", "gplv2"),
    "LGPL-3.0": ("gnu lesser general public license version 3", "gnu lgpl version 3", "lgplv3"),
    "LGPL-2.1": ("gnu lesser general public license version 2.1", "gnu lgpl version 2.1", "lgplv2.1"),
    "AGPL-3.0": ("gnu affero general public license version 3", "gnu agpl version 3", "agplv3"),
    "BSD-3-Clause": ("bsd 3-clause license", "3-clause bsd license", "new bsd license", "bsd-3-clause license"),
    "BSD-2-Clause": ("bsd 2-clause license", "2-clause bsd license", "simplified bsd license", "bsd-2-clause license"),
    "MPL-2.0": ("mozilla public license version 2.0", "mozilla public license v. 2.0", "mozilla public license 2.0"),
    "ISC": ("isc license",),
    "CC0-1.0": ("cc0 1.0", "creative commons zero v1.0 universal", "cc0 1.0 universal"),
    "CC-BY-4.0": ("cc by 4.0", "cc-by-4.0", "creative commons attribution 4.0 international license", "creative commons attribution 4.0 international"),
    "CC-BY-SA-4.0": ("cc by-sa 4.0", "cc-by-sa-4.0", "creative commons attribution-sharealike 4.0 international license", "creative commons attribution-sharealike 4.0 international"),
    "CC-BY-NC-4.0": ("cc by-nc 4.0", "cc-by-nc-4.0", "creative commons attribution-noncommercial 4.0 international license"),
    "CC-BY-ND-4.0": ("cc by-nd 4.0", "cc-by-nd-4.0", "creative commons attribution-noderivatives 4.0 international license"),
}
#: How a grant sentence begins, up to the licence's name.
GRANT = (
    r"(?:(?:this|the|it|all|our)(?:\x20[a-z0-9-]+){0,3}\x20(?:is|are)\x20|dual\x20)?"
    r"(?:licensed\x20under|released\x20under|distributed\x20under|published\x20under|(?:made\x20)?available\x20under|provided\x20under|covered\x20by)\x20"
    r"(?:the\x20terms\x20of\x20)?(?:the\x20|an?\x20)?"
)
#: Short identifiers of a machine-readable licence line, with the licence that each names.
SPDX: dict[str, str] = {
    "mit": "MIT", "apache-2.0": "Apache-2.0", "gpl-3.0": "GPL-3.0", "gpl-3.0-only": "GPL-3.0", "gpl-3.0-or-later": "GPL-3.0-or-later", "gpl-2.0": "GPL-2.0", "gpl-2.0-only": "GPL-2.0",
    "gpl-2.0-or-later": "GPL-2.0-or-later", "lgpl-2.1": "LGPL-2.1", "lgpl-2.1-only": "LGPL-2.1", "lgpl-2.1-or-later": "LGPL-2.1-or-later", "lgpl-3.0": "LGPL-3.0", "lgpl-3.0-only": "LGPL-3.0",
    "lgpl-3.0-or-later": "LGPL-3.0-or-later", "agpl-3.0": "AGPL-3.0", "agpl-3.0-only": "AGPL-3.0", "agpl-3.0-or-later": "AGPL-3.0-or-later", "bsd-2-clause": "BSD-2-Clause",
    "bsd-3-clause": "BSD-3-Clause", "isc": "ISC", "mpl-2.0": "MPL-2.0", "cc0-1.0": "CC0-1.0", "cc-by-4.0": "CC-BY-4.0", "cc-by-sa-4.0": "CC-BY-SA-4.0", "unlicense": "Unlicense",
}
#: Sentences of licence texts and notices, by identifier.  Those that hold a full stop, colon or semicolon
#: before a space are cut there, and the parts are numbered.
SENTENCES: dict[str, str] = {
    "rights": "all rights reserved",
    "apache-compliance": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at http://www.apache.org/licenses/license-2.0",
    "apache-copy-s": "you may obtain a copy of the license at https://www.apache.org/licenses/license-2.0",
    "apache-as-is": "unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an as is basis, without warranties or conditions of any kind, either express or implied",
    "apache-language": "see the license for the specific language governing permissions and limitations under the license",
    "gpl3-grant": "this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version",
    "gpl2-grant": "this program is free software; you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation; either version 2 of the license, or (at your option) any later version",
    "gpl2-only": "this program is free software; you can redistribute it and/or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "lgpl3-grant": "this program is free software: you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version",
    "lgpl21-grant": "this library is free software; you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation; either version 2.1 of the license, or (at your option) any later version",
    "agpl3-grant": "this program is free software: you can redistribute it and/or modify it under the terms of the gnu affero general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-copy": "you should have received a copy of the gnu general public license along with this program",
    "mit-grant": "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the software), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions:",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement",
    "isc-grant": "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-grant-2": "permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-grant": "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "mpl-grant": "this source code form is subject to the terms of the mozilla public license, v. 2.0",
    "mpl-copy": "if a copy of the mpl was not distributed with this file, you can obtain one at http://mozilla.org/mpl/2.0/",
    "mpl-copy-s": "if a copy of the mpl was not distributed with this file, you can obtain one at https://mozilla.org/mpl/2.0/",
    "cc-by-title": "creative commons attribution 4.0 international public license",
    "cc-by-sa-title": "creative commons attribution-sharealike 4.0 international public license",
    "cc-by-nc-title": "creative commons attribution-noncommercial 4.0 international public license",
    "cc-by-nd-title": "creative commons attribution-noderivatives 4.0 international public license",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
#: Ordered rules besides the one-sentence rule of each grant: identifiers of SENTENCES in order, and the licence.
RULES: list[tuple[tuple[str, ...], str]] = [
    (("grant:Apache-2.0", "apache-compliance", "apache-copy", "apache-as-is", "apache-language"), "Apache-2.0 (notice)"),
    (("grant:Apache-2.0", "apache-compliance", "apache-copy-s", "apache-as-is", "apache-language"), "Apache-2.0 (notice)"),
    (("grant:Apache-2.0", "apache-compliance", "apache-copy"), "Apache-2.0 (notice)"),
    (("grant:Apache-2.0", "apache-compliance", "apache-copy-s"), "Apache-2.0 (notice)"),
    (("grant:Apache-2.0", "apache-compliance"), "Apache-2.0 (notice)"),
    (("gpl3-grant", "gpl-hope", "gpl-copy"), "GPL-3.0-or-later"),
    (("gpl2-grant", "gpl-hope", "gpl-copy"), "GPL-2.0-or-later"),
    (("mit-grant", "mit-notice", "mit-as-is"), "MIT"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"), "BSD-3-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary"), "BSD-2-Clause"),
    (("bsd-grant", "bsd-endorse"), "BSD-3-Clause"),
    (("mpl-grant", "mpl-copy"), "MPL-2.0"),
    (("mpl-grant", "mpl-copy-s"), "MPL-2.0"),
    (("gpl3-grant", "gpl-copy"), "GPL-3.0-or-later"),
    (("gpl2-grant", "gpl-copy"), "GPL-2.0-or-later"),
    (("gpl3-grant",), "GPL-3.0-or-later"),
    (("gpl2-grant",), "GPL-2.0-or-later"),
    (("gpl2-only",), "GPL-2.0"),
    (("lgpl3-grant",), "LGPL-3.0-or-later"),
    (("lgpl21-grant",), "LGPL-2.1-or-later"),
    (("agpl3-grant",), "AGPL-3.0-or-later"),
    (("mit-grant",), "MIT"),
    (("mit-notice",), "MIT"),
    (("isc-grant",), "ISC"),
    (("isc-grant-2",), "ISC"),
    (("bsd-grant",), "BSD-2-Clause"),
    (("mpl-grant",), "MPL-2.0"),
    (("cc-by-title",), "CC-BY-4.0"),
    (("cc-by-sa-title",), "CC-BY-SA-4.0"),
    (("cc-by-nc-title",), "CC-BY-NC-4.0"),
    (("cc-by-nd-title",), "CC-BY-ND-4.0"),
    (("unlicense",), "Unlicense"),
    (("rights",), "All-Rights-Reserved"),
]
#: Every known sentence has one of these (lower case).
NEEDED = ("license", "licence", "under", "permission", "permitted", "reserved", "public domain", "covered by", "redistribution", "software")


def _in_lines(name: str) -> str:
    return re.escape(name).replace(r"\ ", r"[\x20,]+")


ALONE = "|".join(_in_lines(n) for n in sorted({n for names in NAMES.values() for n in names}, key=len, reverse=True))
#: Patterns of the normal form, for Java's, Python's and DuckDB's engines alike; each is followed by its replacement.
WHOLE: tuple[tuple[str, str], ...] = (
    ("licence", "license"),
    (r"\r\n?", "\n"),
    (r"\n[\x20\t]*(?:[*#;%/]+|--+|<!--)[\x20\t]*", "\n"),  # comment marks
    (r"spdx-license-identifier:[\x20\t]*([a-z0-9.+-]+)", "\fspdx-license-identifier=" + r"\1" + "\f"),
    (rf"\n[\x20\t]*((?:{GRANT}(?:{ALONE})|all\x20rights\x20reserved)[.]?[\x20\t]*\n)", "\f" + r"\1" + "\f"),  # sentences that are a line
    (r"\bat\n[\x20\t\n]*http", "at http"),
    (r"\n[\x20\t]*\n[\x20\t\n]*", "\f"),  # paragraphs
    (r"\n[\x20\t]*(copyright\x20[^a-z]|[0-9]+\.\x20|-\x20)", "\f" + r"\1"),  # lines of their own
    (r"[\x20\t\n]+", " "),
    (r"\b(v|no)\.\x20([0-9])", r"\1.\2"),  # abbreviations
    (r"([.!?;:])\x20", r"\1" + "\f"),  # where sentences end
)
ONE: tuple[tuple[str, str], ...] = (
    (r"\(the [^()]{0,40}\)", " "),  # definitions
    (r"[^a-z0-9.+-]+", " "),
    (r"^[ .-]+|[ .-]+$", ""),
    (f"^{GRANT}", "grant: "),
)


def whole_form(text: str) -> str:
    s = f"\n{text.lower()}\n"
    for pattern, to in WHOLE:
        s = re.sub(pattern, to, s)
    return s


def parts_of(sentence: str) -> list[str]:
    """A sentence's parts in their normal form, as ``sentences`` has them for a column."""
    out = []
    for part in whole_form(sentence).split("\f"):
        for pattern, to in ONE:
            part = re.sub(pattern, to, part)
        if part:
            out.append(part)
    return out


def sentence_table() -> dict[str, str]:
    """Identifier of each known (part of a) sentence."""
    table: dict[str, str] = {}
    for licence, names in NAMES.items():
        for name in names:
            table.setdefault(parts_of(f"licensed under {name}")[-1], f"grant:{licence}")
    for key, sentence in SENTENCES.items():
        for k, part in enumerate(parts_of(sentence)):
            table.setdefault(part, f"{key}.{k}")  # a part that several sentences share has the identifier of the first
    for name, licence in SPDX.items():
        table.setdefault(f"spdx-license-identifier {name}", f"spdx:{licence}")
    return table


def rule_list() -> list[tuple[tuple[str, ...], str]]:
    """All rules over identifiers of parts, longest first; each grant sentence and short identifier is a rule of its own."""
    table = sentence_table()
    of = lambda s: [s] if s.startswith("grant:") else [table[p] for p in parts_of(SENTENCES[s])]
    rules = [(tuple(i for s in sequence for i in of(s)), name) for sequence, name in RULES]
    rules += [((f"grant:{k}",), k) for k in NAMES] + [((f"spdx:{k}",), k) for k in dict.fromkeys(SPDX.values())]
    return sorted(dict.fromkeys(rules), key=lambda r: -len(r[0]))


def rule_pattern(sequence: tuple[str, ...]) -> str:
    """Identifiers in order, with others between them that no rule begins with."""
    known = [seq for seq, _ in rule_list()]
    between = sorted({k for seq in known for k in seq} - {seq[0] for seq in known})
    gap = "(?:" + "|".join(_literal(k) for k in between) + ")*?"
    return gap.join(_literal(k) for k in sequence)


def _literal(identifier: str) -> str:
    return " " + re.sub(r"([.+])", r"\\\1", identifier) + " "


def sentences(text: Column) -> Column:
    """The text's sentences, in their normal form."""
    s = F.concat(F.lit("\n"), F.lower(text), F.lit("\n"))
    for pattern, to in WHOLE:
        s = F.regexp_replace(s, pattern, re.sub(r"\\([12])", r"$\1", to))

    def one(x: Column) -> Column:
        for pattern, to in ONE:
            x = F.regexp_replace(x, pattern, to)
        return x

    return F.transform(F.split(s, "\f"), one)


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences, in order."""
    table = sentence_table()
    by_id: dict[str, list[str]] = {}
    for s, k in table.items():
        by_id.setdefault(k, []).append(s)

    def named(s: Column) -> Column:
        chain = F
        for k, group in by_id.items():
            chain = chain.when(s.isin(group), F.lit(k))
        return chain

    return F.transform(F.filter(sentences(text), lambda s: s.isin(list(table))), named)


def matched(ids: Column) -> Column:
    """Licences of an identifier sequence, in rule order: each rule takes the sentences that it matches."""
    start = F.struct(F.concat(F.lit(" "), F.array_join(ids, "  "), F.lit(" ")).alias("left"), F.array().cast("array<string>").alias("found"))
    rules = F.array(*[F.struct(F.lit(rule_pattern(seq)).alias("p"), F.lit(name).alias("name")) for seq, name in rule_list()])

    def step(done: Column, rule: Column) -> Column:
        left = F.regexp_replace(done["left"], rule["p"], " ")
        return F.struct(left.alias("left"), F.when(left != done["left"], F.concat(done["found"], F.array(rule["name"]))).otherwise(done["found"]).alias("found"))

    return F.aggregate(rules, start, step, lambda d: F.array_sort(F.array_distinct(d["found"])))


def licences(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences (known ones), sentence_ids and licences (comma-joined) of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    needed = F.lower(text).rlike("|".join(NEEDED))
    ids = F.when(needed, sentence_ids(text)).otherwise(F.array().cast("array<string>"))
    found = docs.select("doc_id", ids.alias("ids"))
    none = F.array().cast("array<string>")
    named = F.when(F.size("ids") > 0, matched(F.col("ids"))).otherwise(none)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"), F.array_join(named, ",").alias("licences"))
