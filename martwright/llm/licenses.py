r"""License scan: ordered signature rules behind a keyword gate.

A text is looked at only if it holds what any rule's match holds: a word of a phrasing, or a name that
stands for itself. The rules of the keywords it holds are matched, each giving intervals of the text. A rule of higher priority
suppresses every interval of a lower one that lies inside its own; what is left names the
licenses. Rules are made from a table of licenses and a table of phrasings, in this
order of priority: text of a license or its notice, identifier tag, full title with version, grant
sentence, web address, plain name.

Beside them stand the base phrases, found word by word: places where the words of a phrase
stand consecutively. Words are runs of digits, ASCII letters and characters beyond ASCII.

Defined results: null and empty texts have no words and no labels; a text without any finding has
null ``first_word`` and ``last_word``, empty labels and score 0. Repeated rows give repeated rows.
Everything is computed inside the row, without a shuffle, on the whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martwright.llm.common import let

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# Phrase and label of the base scan.
BASE = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)

# Versions of the Creative Commons licenses, and what makes another license of their names.
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
CC_LONG, CC_SHORT = "non-?commercial|share-?alike|no-?deriv", "nc|sa|nd"

# License, keyword of its rules, pattern of its name, versions, and what names it without
# the word license: nothing (0), the name with a version (1), the name alone (2).
LICENSES = (
    ("apache", "apache", r"apache(?: software)?", ("1.0", "1.1", "2.0"), 0),
    ("mit", "mit", r"(?:mit|expat|x11)", (), 0),
    ("mit", "expat", r"expat", (), 0),
    ("mit", "x11", r"x11", (), 0),
    ("gpl", "general public", r"(?:gnu )?(?<!lesser )(?<!affero )general public", ("1.0", "2.0", "3.0"), 0),
    ("gpl", "gpl", r"(?:gnu )?gpl", ("1.0", "2.0", "3.0"), 2),
    ("lgpl", "lesser general", r"(?:gnu )?lesser general public", ("2.0", "2.1", "3.0"), 0),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl", ("2.0", "2.1", "3.0"), 2),
    ("agpl", "affero", r"(?:gnu )?affero general public", ("1.0", "3.0"), 0),
    ("agpl", "agpl", r"(?:gnu )?agpl", ("1.0", "3.0"), 2),
    ("bsd", "bsd", r"(?:new |simplified |modified )?bsd", ("2-clause", "3-clause", "4-clause"), 1),
    ("mpl", "mozilla", r"mozilla public", ("1.0", "1.1", "2.0"), 0),
    ("mpl", "mpl", r"mpl", ("1.0", "1.1", "2.0"), 1),
    ("epl", "eclipse", r"eclipse public", ("1.0", "2.0"), 0),
    ("epl", "epl", r"epl", ("1.0", "2.0"), 1),
    ("cddl", "common development", r"common development and distribution", ("1.0", "1.1"), 0),
    ("cddl", "cddl", r"cddl", ("1.0", "1.1"), 2),
    ("cc-by", "attribution", rf"creative commons attribution(?![ -](?:{CC_LONG}))", CC_VERSIONS, 2),
    ("cc-by", "cc", rf"cc[ -]by(?![ -](?:{CC_SHORT}))", CC_VERSIONS, 2),
    ("cc-by-sa", "attribution", r"creative commons attribution.share-?alike", CC_VERSIONS, 2),
    ("cc-by-sa", "cc", r"cc[ -]by[ -]sa", CC_VERSIONS, 2),
    ("cc-by-nd", "attribution", r"creative commons attribution.no-?deriv\w*", CC_VERSIONS, 2),
    ("cc-by-nd", "cc", r"cc[ -]by[ -]nd", CC_VERSIONS, 2),
    ("cc-by-nc", "attribution", rf"creative commons attribution.non-?commercial(?![ -](?:{CC_LONG}))", CC_VERSIONS, 2),
    ("cc-by-nc", "cc", rf"cc[ -]by[ -]nc(?![ -](?:{CC_SHORT}))", CC_VERSIONS, 2),
    ("cc-by-nc-sa", "attribution", r"creative commons attribution.non-?commercial.share-?alike", CC_VERSIONS, 2),
    ("cc-by-nc-sa", "cc", r"cc[ -]by[ -]nc[ -]sa", CC_VERSIONS, 2),
    ("cc-by-nc-nd", "attribution", r"creative commons attribution.non-?commercial.no-?deriv\w*", CC_VERSIONS, 2),
    ("cc-by-nc-nd", "cc", r"cc[ -]by[ -]nc[ -]nd", CC_VERSIONS, 2),
    ("cc0", "cc0", r"(?:creative commons )?cc0", ("1.0",), 2),
    ("artistic", "artistic", r"(?:perl )?artistic", ("1.0", "2.0"), 0),
    ("isc", "isc", r"isc", (), 0),
    ("zlib", "zlib", r"zlib(?:/libpng)?", (), 0),
    ("boost", "boost", r"boost software", ("1.0",), 0),
    ("boost", "bsl", r"bsl", ("1.0",), 1),
    ("eupl", "european union", r"european union public", ("1.1", "1.2"), 0),
    ("eupl", "eupl", r"eupl", ("1.1", "1.2"), 2),
    ("ofl", "open font", r"(?:sil )?open font", ("1.0", "1.1"), 0),
    ("ofl", "ofl", r"(?:sil )?ofl", ("1.0", "1.1"), 1),
    ("wtfpl", "wtfpl", r"wtfpl", ("2",), 2),
    ("unlicense", "unlicense", r"unlicense", (), 2),
    ("postgresql", "postgresql", r"postgresql", (), 0),
    ("python", "python software", r"python software foundation", ("2.0",), 0),
    ("python", "psf", r"psf", ("2.0",), 1),
    ("ms-pl", "microsoft public", r"microsoft public", (), 0),
    ("ms-pl", "ms-pl", r"ms-pl", (), 2),
)

# Phrasing, priority, confidence. N is the name, V the version; the last column is the
# least value of the license's last column.
UNDER = (
    r"(?:licen[sc]ed|released|distributed|available)\s+under\s+(?:the\s+)?(?:terms\s+of\s+)?"
    r"(?:the\s+)?"
)
VERSIONED = (
    (r"spdx-license-identifier:\s*N[\w.-]*(?<![\d.])V", 60, 0.99, 0),
    (r"licen[sc]ed\s+under\s+(?:the\s+)?N\s+licen[sc]e[^.]{0,40}?V", 50, 0.97, 0),
    (UNDER + r"N(?:\s+licen[sc]e)?[\s,-]*(?:version|v\.?)?\s*V", 45, 0.96, 0),
    (r"N\s+licen[sc]e,?\s*(?:version|v\.?)?\s*V", 40, 0.95, 0),
    (r"N[\s,-]*(?:version|v\.?)?\s*V\s+licen[sc]e", 40, 0.95, 0),
    (r"N[\s,-]*(?:version|v\.?)?\s*V", 35, 0.9, 1),
)
GENERIC = (
    (r"spdx-license-identifier:\s*N(?![a-z0-9])", 55, 0.95, 0),
    (UNDER + r"N(?:\s+licen[sc]e)?(?:v?\d[\d.]*)?(?![a-z0-9])", 30, 0.9, 0),
    (r"https?://[^\s]{0,80}N(?:-?licen[sc]e|v?\d[\d.]*)?(?![a-z0-9])[^\s]{0,40}", 20, 0.7, 0),
    (r"N\s+licen[sc]e\b", 10, 0.8, 0),
    (r"N(?![a-z0-9])", 5, 0.7, 2),
)


# Opening words of the license texts and notices, with the label, a word that opens the
# rule, and the confidence. Any run of other characters may stand between the words.
BODIES = (
    ("mit", "hereby", 0.95, "permission is hereby granted free of charge to any person obtaining a copy of this"
     " software and associated documentation files"),
    ("boost-1.0", "hereby", 0.95, "permission is hereby granted free of charge to any person or organization"
     " obtaining a copy of the software and accompanying documentation"),
    ("isc", "hereby", 0.9, "permission to use copy modify and( or)? distribute this software for any purpose with or"
     " without fee is hereby granted"),
    ("bsd", "redistribution", 0.9, "redistribution and use in source and binary forms with or without modification are"
     " permitted"),
    ("bsd-3-clause", "endorse", 0.95, "may be used to endorse or promote products derived from this software without"),
    ("apache-2.0", "compliance", 0.9, "you may not use this file except in compliance with the license"),
    ("gpl", "redistribute", 0.9, "is free software you can redistribute it and or modify it under the terms of the gnu"
     " general public license"),
    ("lgpl", "redistribute", 0.9, "is free software you can redistribute it and or modify it under the terms of the gnu"
     " lesser general public license"),
    ("agpl", "redistribute", 0.9, "is free software you can redistribute it and or modify it under the terms of the gnu"
     " affero general public license"),
    ("mpl-2.0", "mozilla", 0.95, "this source code form is subject to the terms of the mozilla public license v 2( 0)?"),
    ("zlib", "as-is", 0.8, "this software is provided as is without any express or implied warranty"),
    ("unlicense", "unencumbered", 0.95, "this is free and unencumbered software released into the public domain"),
    ("cc0-1.0", "waived", 0.9, "has waived all copyright and related or neighboring rights"),
    ("cc0-1.0", "dedicated", 0.9, "has dedicated the work to the public domain"),
)
BODY_PRIORITY = 70


def bodies() -> list[tuple[str, str, str, int, float]]:
    """Rules of the license texts, as ``rules`` gives them."""
    return [
        (keyword, r"(?<![a-z0-9])" + words.replace("( ", r"(?:\W+").replace(" ", r"\W+"), label, BODY_PRIORITY, sure)
        for label, keyword, sure, words in BODIES
    ]


def rules() -> list[tuple[str, str, str, int, float]]:
    """(keyword, pattern, label, priority, confidence), most specific first."""
    out = []
    for label, keyword, name, versions, bare in LICENSES:
        name = rf"(?<![a-z0-9])(?:{name})"
        for phrasing, priority, confidence, least in VERSIONED:
            for version in versions if bare >= least else ():
                number = version.replace(".", r"\.").replace(r"\.0", r"(?:\.0)?")
                pattern = phrasing.replace("N", name).replace("V", rf"{number}(?!\w|\.\d)")
                out.append((keyword, pattern, f"{label}-{version}", priority, confidence))
        for phrasing, priority, confidence, least in GENERIC:
            if bare >= least:
                out.append((keyword, phrasing.replace("N", name), label, priority, confidence))
    return sorted([*out, *bodies()], key=lambda r: (-r[3], r[0], r[1]))


def gate() -> str:
    """What every match of a rule holds: a word of its phrasing, or the name where that is enough."""
    names = "|".join(dict.fromkeys(name for _, _, name, _, bare in LICENSES if bare))
    texts = "|".join(dict.fromkeys(keyword for _, keyword, _, _ in BODIES if keyword != "mozilla"))
    return (
        r"(?i)licen[sc]e|(?:released|distributed|available)\s+under|https?://"
        rf"|(?<![a-z0-9])(?:{names}|{texts})"
    )


GATE = gate()


def _spans(text: Column, rule: Column) -> Column:
    """All intervals of a rule's pattern: pieces between the hits give their places."""
    hits = F.regexp_extract_all(text, rule["pattern"], F.lit(0))
    pieces = F.split(text, rule["pattern"], F.lit(-1))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))

    def places(found: Column, between: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.size(found)),
            zero,
            lambda acc, i: F.struct(
                (
                    acc["at"]
                    + F.length(F.element_at(between, i))
                    + F.length(F.element_at(found, i))
                ).alias("at"),
                F.concat(
                    acc["out"],
                    F.array(
                        F.struct(
                            (acc["at"] + F.length(F.element_at(between, i))).alias("s"),
                            (
                                acc["at"]
                                + F.length(F.element_at(between, i))
                                + F.length(F.element_at(found, i))
                            ).alias("e"),
                        )
                    ),
                ).alias("out"),
            ),
            lambda acc: acc["out"],
        )

    spans = let(
        hits,
        lambda found: F.when(
            F.size(found) > 0, let(pieces, lambda between: places(found, between))
        ).otherwise(zero["out"]),
    )
    return F.transform(
        spans,
        lambda x: F.struct(
            x["s"].alias("s"),
            x["e"].alias("e"),
            rule["priority"].alias("priority"),
            rule["label"].alias("label"),
            rule["confidence"].alias("confidence"),
        ),
    )


def _detections(text: Column) -> Column:
    by_keyword = {}
    for keyword, *rule in rules():
        by_keyword.setdefault(keyword, []).append(rule)
    table = F.array(
        *(
            F.struct(
                F.lit(keyword).alias("keyword"),
                F.array(
                    *(
                        F.struct(
                            F.lit(p).alias("pattern"),
                            F.lit(x).alias("label"),
                            F.lit(n).alias("priority"),
                            F.lit(c).alias("confidence"),
                        )
                        for p, x, n, c in own
                    )
                ).alias("rules"),
            )
            for keyword, own in by_keyword.items()
        )
    )
    # A keyword begins a word: "limit" does not open the rules of "mit".
    begins = lambda r: F.regexp_like(text, F.concat(F.lit("(?<![a-z0-9])"), r["keyword"]))
    open_rules = F.flatten(
        F.filter(table, lambda r: F.contains(text, r["keyword"]) & begins(r))["rules"]
    )
    every = F.flatten(F.transform(open_rules, lambda r: _spans(text, r)))
    return let(
        every,
        lambda found: F.filter(
            found,
            lambda x: ~F.exists(
                found,
                lambda y: (y["priority"] > x["priority"])
                & (y["s"] <= x["s"])
                & (y["e"] >= x["e"]),
            ),
        ),
    )


def _places_of(words: Column, parts: list[str], label: str) -> Column:
    last = F.size(words) - len(parts) + 1
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(
        F.array().cast("array<int>")
    )

    def stands(i: Column) -> Column:
        test = F.element_at(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            test = test & (F.element_at(words, i + k) == part)
        return test

    return F.transform(
        F.filter(starts, stands),
        lambda i: F.struct((i - 1).cast("long").alias("word"), F.lit(label).alias("label")),
    )


def _base_places(words: Column) -> Column:
    """(word, label) of every place of every base phrase."""
    return F.concat(*(_places_of(words, phrase.split(), label) for phrase, label in BASE))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, n_words, base findings, ``detections`` and the labels of both."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    text = F.coalesce(F.col(text_col), F.lit(""))
    low = F.translate(text, upper, lower)
    found = F.when(
        F.regexp_like(text, F.lit(GATE)),
        let(
            low,
            lambda t: F.struct(
                let(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), _base_places).alias("base"),
                _detections(t).alias("detections"),
            ),
        ),
    )
    rows = docs.select(
        F.col(id_col).alias(id_col),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"),
        found.alias("found"),
    )
    base, kept = F.col("found.base"), F.col("found.detections")
    base_labels = F.coalesce(F.array_distinct(base["label"]), F.array().cast("array<string>"))
    own_labels = F.coalesce(F.array_distinct(kept["label"]), F.array().cast("array<string>"))
    best = F.coalesce(F.array_max(kept["confidence"]), F.lit(0.0))
    return rows.select(
        id_col,
        "n_words",
        F.coalesce(F.size(base).cast("long"), F.lit(0)).alias("n_base"),
        F.array_min(base["word"]).alias("first_word"),
        F.array_max(base["word"]).alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, own_labels)), ",").alias("labels"),
        F.greatest(best, F.when(F.size(base) > 0, F.lit(0.5)).otherwise(F.lit(0.0))).alias(
            "score"
        ),
        kept.alias("detections"),
    )
