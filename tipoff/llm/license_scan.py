"""Licence scans with ordered signature rules, in DataFrame functions only.

A rule is a regular expression over a text's words (lower-cased, joined by single blanks) with two keywords that
every match holds, a label, a rank (1: identifier, 2: grant, 3: title with version, 4: bare title) and a
confidence. Texts without any of the gate words are never tokenised; a rule runs on a text only if both its
keywords are in it. Of overlapping detections one lying inside another of the same or a better rank is dropped, the
longer one, then the better rank, then the earlier rule coming first.

All of it happens within a row: no shuffle, no Python. The sweep over a text's sorted detections keeps one
running end for each rank, so its work is linear in their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# phrases that count as base places, and their labels
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# label; titles, each as a regular expression over words and a keyword it holds; versions
LICENSES = (
    ("mit", (("(?:the )?mit", "mit "), ("(?:the )?expat", "expat")), ()),
    ("x11", (("(?:the )?x11", "x11"),), ()),
    ("isc", (("(?:the )?isc", "isc "),), ()),
    ("apache", (("(?:the )?apache(?: software foundation| software)?", "apache"),), ("1 0", "1 1", "2 0")),
    ("gpl", (("(?:the )?(?:gnu )?general public", "general public"), ("(?:the )?(?:gnu )?gpl", "gpl")), ("1", "2", "3")),
    ("lgpl", (("(?:the )?(?:gnu )?(?:lesser|library) general public", "general public"), ("(?:the )?(?:gnu )?lgpl", "lgpl")), ("2", "2 1", "3")),
    ("agpl", (("(?:the )?(?:gnu )?affero general public", "affero"), ("(?:the )?(?:gnu )?agpl", "agpl")), ("1", "3")),
    ("fdl", (("(?:the )?(?:gnu )?free documentation", "free documentation"),), ("1 1", "1 2", "1 3")),
    ("mpl", (("(?:the )?mozilla public", "mozilla"), ("(?:the )?mpl", "mpl")), ("1 0", "1 1", "2 0")),
    ("epl", (("(?:the )?eclipse public", "eclipse"), ("(?:the )?epl", "epl")), ("1 0", "2 0")),
    ("cddl", (("(?:the )?common development and distribution", "common development"), ("(?:the )?cddl", "cddl")), ("1 0", "1 1")),
    ("cpl", (("(?:the )?common public", "common public"),), ("1 0",)),
    ("eupl", (("(?:the )?european union public", "european union"), ("(?:the )?eupl", "eupl")), ("1 0", "1 1", "1 2")),
    ("bsd-2-clause", (("(?:the )?(?:2 clause bsd|bsd 2 clause|simplified bsd)", "bsd"),), ()),
    ("bsd-3-clause", (("(?:the )?(?:3 clause bsd|bsd 3 clause|new bsd|revised bsd|modified bsd)", "bsd"),), ()),
    ("bsd-4-clause", (("(?:the )?(?:4 clause bsd|bsd 4 clause|original bsd)", "bsd"),), ()),
    ("bsd", (("(?:the )?bsd", "bsd"),), ()),
    ("artistic", (("(?:the )?(?:perl )?artistic", "artistic"),), ("1 0", "2 0")),
    ("boost", (("(?:the )?boost(?: software)?", "boost"),), ("1 0",)),
    ("zlib", (("(?:the )?zlib(?: libpng)?", "zlib"),), ()),
    ("libpng", (("(?:the )?libpng", "libpng"),), ("2 0",)),
    ("python", (("(?:the )?(?:python software foundation|python)", "python"), ("(?:the )?psf", "psf")), ("2 0",)),
    ("php", (("(?:the )?php", "php"),), ("3 0", "3 01")),
    ("ruby", (("(?:the )?ruby", "ruby"),), ()),
    ("openssl", (("(?:the )?openssl", "openssl"),), ()),
    ("postgresql", (("(?:the )?postgresql", "postgresql"),), ()),
    ("curl", (("(?:the )?curl", "curl"),), ()),
    ("ofl", (("(?:the )?(?:sil )?open font", "open font"),), ("1 0", "1 1")),
    ("osl", (("(?:the )?open software", "open software"),), ("1 0", "2 0", "3 0")),
    ("afl", (("(?:the )?academic free", "academic free"),), ("2 0", "2 1", "3 0")),
    ("ms-pl", (("(?:the )?microsoft public", "microsoft public"),), ()),
    ("ms-rl", (("(?:the )?microsoft reciprocal", "microsoft reciprocal"),), ()),
    ("unlicense", (("(?:the )?unlicense", "unlicense"),), ()),
    ("wtfpl", (("(?:the )?wtfpl", "wtfpl"), ("(?:the )?do what the fuck you want to public", "you want to public")), ("2",)),
    ("odbl", (("(?:the )?open database", "open database"),), ("1 0",)),
    ("odc-by", (("(?:the )?open data commons attribution", "open data commons"),), ("1 0",)),
    ("cc0", (("(?:the )?(?:creative commons zero|creative commons cc0)", "creative commons"), ("(?:the )?cc0", "cc0")), ("1 0",)),
    ("cc-by", (("(?:the |a )?creative commons attribution", "creative commons"), ("(?:the |a )?cc by", "cc by")), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", (("(?:the |a )?creative commons attribution share ?alike", "creative commons"), ("(?:the |a )?cc by sa", "cc by sa")), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", (("(?:the |a )?creative commons attribution no ?derivatives", "creative commons"), ("(?:the |a )?cc by nd", "cc by nd")), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", (("(?:the |a )?creative commons attribution non ?commercial", "creative commons"), ("(?:the |a )?cc by nc", "cc by nc")), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-sa", (("(?:the |a )?creative commons attribution non ?commercial share ?alike", "creative commons"), ("(?:the |a )?cc by nc sa", "cc by nc sa")), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-nd", (("(?:the |a )?creative commons attribution non ?commercial no ?derivatives", "creative commons"), ("(?:the |a )?cc by nc nd", "cc by nc nd")), ("1 0", "2 0", "2 5", "3 0", "4 0")),
)

# openings of a grant: regular expression, what must follow the title, second keyword, confidence
GRANTS = (
    ("licen[sc]ed under(?: the terms of| either| both)?", "(?: licen[sc]e)?", "ed under", 0.95),
    ("(?:released|published|distributed|available|provided|offered) under(?: the terms of)?", " licen[sc]e", "under", 0.9),
    ("(?:subject to|governed by|covered by|in accordance with)(?: the terms of)?", " licen[sc]e", "licen", 0.85),
)
# rules that name no licence by its title: label, regular expression, keyword, second keyword, rank, confidence
PLAIN = (
    ("public-domain", "(?:released|placed|dedicated|is) (?:in|into|to) the public domain", "public domain", "the public", 2, 0.9),
    ("public-domain", "public domain", "public domain", "domain", 4, 0.4),
    ("all-rights-reserved", "all rights reserved", "all rights reserved", "reserved", 2, 0.8),
    ("copyleft", "copyleft", "copyleft", "copyleft", 4, 0.4),
    ("proprietary", "proprietary(?: software)? licen[sc]e", "proprietary", "licen", 2, 0.8),
    ("commercial", "commercial licen[sc]e", "commercial", "licen", 3, 0.6),
    ("unknown", "licen[sc]ed under", "ed under", "licen", 4, 0.3),
    ("unknown", "licen[sc]e agreement", "e agreement", "licen", 4, 0.3),
)
# wording of licences' own texts and notices, written by hand: label, regular expression, keyword, second keyword, rank, confidence
BODIES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "free of charge to any person obtaining", "hereby", 2, 0.95),
    ("mit", "this permission notice shall be included in all copies or substantial portions of the software", "this permission notice shall be", "portions", 2, 0.9),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", "without warranty of any kind", "the software is provided as is", 2, 0.8),
    ("boost-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software", "any person or organization obtaining", "hereby", 2, 0.95),
    ("isc", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted", "with or without fee", "hereby", 2, 0.95),
    ("isc", "the author disclaims all warranties with regard to this software", "author disclaims all warranties", "warranties", 2, 0.85),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", "without a written agreement", "hereby", 2, 0.95),
    ("hpnd", "permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee", "distribute and sell this software", "hereby", 2, 0.95),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms", "redistribution", 2, 0.95),
    ("bsd", "redistributions of source code must retain the above copyright notice", "redistributions of source code", "retain", 2, 0.9),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice", "redistributions in binary form", "reproduce", 2, 0.9),
    ("bsd", "this software is provided by the (?:copyright holders?|regents|authors?)(?: and contributors)? as is and any express or implied warranties", "this software is provided by the", "warranties", 2, 0.85),
    ("bsd-3-clause", "may be used to endorse or promote products derived from this software without specific prior written permission", "endorse or promote products", "prior written permission", 2, 0.9),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", "all advertising materials", "acknowledg", 2, 0.95),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", "including commercial applications", "redistribute", 2, 0.95),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented", "altered source versions", "misrepresented", 2, 0.9),
    ("apache-2.0", "you may not use this file except in compliance with the license", "except in compliance with the license", "this file", 2, 0.9),
    ("apache-2.0", "software distributed under the license is distributed on an as is basis", "is distributed on an as is basis", "license", 2, 0.9),
    ("apache-2.0", "a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent|except as stated in this section patent) license", "no charge royalty free irrevocable", "license", 2, 0.9),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation", "as published by the free software", "gnu general public", 2, 0.9),
    ("lgpl", "under the terms of the gnu (?:lesser|library) general public license as published by the free software foundation", "as published by the free software", "general public", 2, 0.95),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", "as published by the free software", "affero", 2, 0.95),
    ("copyleft", "everyone is permitted to copy and distribute verbatim copies of this license document", "distribute verbatim copies", "license", 2, 0.8),
    ("gpl-2", "the licenses for most software are designed to take away your freedom to share and change it", "designed to take away your freedom", "licenses", 2, 0.9),
    ("gpl-3", "the gnu general public license is a free copyleft license for software and other kinds of works", "is a free copyleft license", "gnu general public", 2, 0.95),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "source code form is subject", "mozilla", 2, 0.95),
    ("epl", "made available under the terms of the eclipse public license", "made available under", "eclipse", 2, 0.9),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered", "public domain", 2, 0.95),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document", "verbatim or modified copies", "license", 2, 0.95),
    ("ofl", "to stimulate worldwide development of collaborative font projects", "collaborative font projects", "font", 2, 0.9),
    ("cc0", "has dedicated the work to the public domain", "dedicated the work", "public domain", 2, 0.9),
    ("python", "this license agreement is between the python software foundation", "license agreement is between", "python", 2, 0.9),
)
# every rule's match holds one of these, in words that no separator cuts
GATE = "(?i)licen[sc]|domain|reserved|copyleft|hereby|redistribut|warrant|portions|endorse|acknowledg|misrepresent|collaborative"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAKS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
ANY_CASE_WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def rules() -> list[tuple]:
    """All rules in order: (label, regular expression, keyword, second keyword, rank, confidence)."""
    out = []
    for label, titles, versions in LICENSES:
        plain = label.replace("-", " ")
        out.append((label, f"spdx license identifier {plain}", plain, "spdx", 1, 0.98))
        out += [(f"{label}-{v.replace(' ', '.')}", f"spdx license identifier {plain} {v}(?: only| or later)?", plain, "spdx", 1, 0.99) for v in versions]
        for title, key in titles:
            for opening, ending, word, sure in GRANTS:
                out.append((label, f"{opening} {title}{ending}", key, word, 2, sure - 0.05))
                for v in versions:
                    out.append((f"{label}-{v.replace(' ', '.')}", f"{opening} {title}{ending}(?: version)? v?{v}", key, word, 2, sure))
            for v in versions:
                out.append((f"{label}-{v.replace(' ', '.')}", f"{title} licen[sc]e(?: version)? v?{v}", key, "licen", 3, 0.8))
            out.append((label, f"{title} licen[sc]e", key, "licen", 4, 0.6))
    return [*out, *PLAIN, *BODIES]


def _rule_table() -> str:
    """The rules as a constant: one entry for each keyword, with the rules that need it."""
    by_key: dict[str, list[str]] = {}
    for k, (label, pattern, key, word, rank, sure) in enumerate(rules()):
        by_key.setdefault(key, []).append(
            f"named_struct('label', '{label}', 'rx', r'\\b(?:{pattern})\\b', 'word', '{word}', 'rank', {rank}, 'k', {k}, 'sure', {sure}D)"
        )
    return "array(" + ", ".join(f"named_struct('key', '{key}', 'rules', array({', '.join(found)}))" for key, found in by_key.items()) + ")"


FOUND = "array<struct<start:int,back:int,rank:int,k:int,stop:int,label:string,sure:double>>"


def _detections() -> Column:
    """All matches of all rules whose keywords are in ``_hay``, as characters of it, sorted for the sweep."""
    matches = """
      aggregate(
        filter(zip_with(split(_norm, r.rx, -1), regexp_extract_all(_norm, r.rx, 0),
                        (gap, hit) -> named_struct('gap', length(gap), 'len', length(hit))), x -> x.len is not null),
        named_struct('at', 0, 'found', cast(array() as {t})),
        (acc, x) -> named_struct('at', acc.at + x.gap + x.len, 'found', concat(acc.found, cast(array(named_struct(
            'start', acc.at + x.gap, 'back', -(acc.at + x.gap + x.len), 'rank', r.rank, 'k', r.k,
            'stop', acc.at + x.gap + x.len, 'label', r.label, 'sure', r.sure)) as {t}))),
        acc -> acc.found)""".format(t=FOUND)
    return F.expr(f"""
      array_sort(flatten(transform(
        filter(flatten(transform(filter(_rules, e -> contains(_hay, e.key)), e -> e.rules)), r -> contains(_hay, r.word)),
        r -> {matches})))""")


def _kept() -> Column:
    """Detections that lie in no earlier one of the same or a better rank."""
    return F.expr(f"""
      aggregate(_hits,
        named_struct('e1', -1, 'e2', -1, 'e3', -1, 'e4', -1, 'kept', cast(array() as {FOUND})),
        (acc, d) -> named_struct(
          'e1', if(d.rank <= 1, greatest(acc.e1, d.stop), acc.e1), 'e2', if(d.rank <= 2, greatest(acc.e2, d.stop), acc.e2),
          'e3', if(d.rank <= 3, greatest(acc.e3, d.stop), acc.e3), 'e4', greatest(acc.e4, d.stop),
          'kept', if(d.stop <= case d.rank when 1 then acc.e1 when 2 then acc.e2 when 3 then acc.e3 else acc.e4 end,
                     acc.kept, concat(acc.kept, cast(array(d) as {FOUND})))),
        acc -> acc.kept)""")


def _base_places() -> dict[str, Column]:
    """Starting words of each base phrase in ``_words``, looked up around the places of its last word."""
    out = {}
    for phrase, label in BASE:
        words = phrase.split()
        back = len(words) - 1
        same = " and ".join(f"get(_words, i - {back - j}) = '{w}'" for j, w in enumerate(words[:-1]))
        out[label] = F.expr(
            f"transform(filter(filter(transform(_words, (w, i) -> if(w = '{words[-1]}', i, null)), i -> i is not null), i -> {same}), i -> i - {back})"
        )
    return out


def scan(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with n_words, base_places (phrase label to starting words), n_base, first_word, last_word,
    base_labels, labels (array), detections (label, rank, confidence and span in the normalised words) and score.

    A null text counts as empty: no words, no labels, score 0. Only A-Z are lower-cased; words are runs of
    digits, a-z and characters beyond ASCII. Repeated places all count. Score is the best confidence among the
    detections kept, and 0.6 at least where a base phrase stands. Columns of the input with one of these names are replaced.
    """
    new = "n_words base_places n_base first_word last_word base_labels labels detections score".split()
    whole = F.coalesce(F.col(text), F.lit(""))
    work = documents.drop(*new).select(F.struct("*").alias("_row"), whole.alias("_text"))
    lowered = F.translate("_text", UPPER, LOWER)
    # texts past the gate are the only ones whose words are looked at
    work = work.withColumn("_gated", F.col("_text").rlike(GATE))
    work = work.withColumn("_norm", F.when(F.col("_gated"), F.trim(F.regexp_replace(lowered, BREAKS, " "))).otherwise(F.lit("")))
    # keywords may end in a blank
    work = work.withColumns({"_words": F.split("_norm", " "), "_hay": F.concat("_norm", F.lit(" "))})
    places = _base_places()
    work = work.withColumns({f"_p_{label}": F.when(F.col("_gated"), p).otherwise(F.expr("cast(array() as array<int>)")) for label, p in places.items()})
    work = work.withColumn("_rules", F.expr(_rule_table()))
    work = work.withColumn("_hits", F.when(F.col("_gated"), _detections()).otherwise(F.expr(f"cast(array() as {FOUND})")))
    work = work.withColumn("_kept", _kept()).drop("_rules")
    every = F.concat(*[F.col(f"_p_{label}") for label in places])
    base = F.array_compact(F.array(*[F.when(F.array_size(f"_p_{label}") > 0, F.lit(label)) for label in places]))
    return work.select(
        *[F.col("_row")[c].alias(c) for c in documents.drop(*new).columns],
        F.regexp_count("_text", F.lit(ANY_CASE_WORD)).cast("bigint").alias("n_words"),
        F.struct(*[F.col(f"_p_{label}").alias(label) for label in places]).alias("base_places"),
        F.array_size(every).cast("bigint").alias("n_base"),
        F.array_min(every).cast("bigint").alias("first_word"),
        F.array_max(every).cast("bigint").alias("last_word"),
        F.array_sort(base).alias("base_labels"),
        F.array_sort(F.array_union(base, F.transform("_kept", lambda d: d["label"]))).alias("labels"),
        F.transform(
            "_kept",
            lambda d: F.struct(d["label"].alias("label"), d["rank"].alias("rank"), d["sure"].alias("confidence"), d["start"].alias("start"), d["stop"].alias("stop")),
        ).alias("detections"),
        F.greatest(
            F.coalesce(F.array_max(F.transform("_kept", lambda d: d["sure"])), F.lit(0.0)),
            F.when(F.array_size(every) > 0, F.lit(0.6)).otherwise(F.lit(0.0)),
        ).alias("score"),
    )
