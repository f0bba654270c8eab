"""License scans: ordered signature rules with keyword gates, priorities and interval containment.

Rules are regular expressions over the lower-cased text, made from a catalogue of licences by rule (identifier
tags, grants, names, addresses), and by hand from the words of licences themselves (grants, conditions,
disclaimers): about 350. A text is searched only if it has the words of an entry of the gate; in it, a rule runs only
if the rule's keyword occurs. Both follow from the rules: no match is without them. Of the detections, one that lies
within another's interval gives way if the other has a higher priority, or the same and a longer interval; of equal
intervals and priorities the first label stays.
The detections of a text are summed and compared in runs, so a text of very many matches never costs their square.

All is one narrow projection of SQL functions: no shuffle, no Python. Positions come from splitting a text at a
rule's matches.

Defined cases: a null or empty text has no words, places or labels and score 0; very long texts are searched whole;
of equal detections one stays; repeated rows give equal rows; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import ALNUM_WORD, ascii_lower, table

#: Fixed values: (label, SPDX identifier, name pattern, keyword, address pattern). The keyword is in every match of the
#: name and has no white space, as names may be wrapped. A label's further names have neither identifier nor address.
CATALOGUE = (
    ("mit", "mit", r"(?:the )?mit(?: license)?", "mit", r"opensource\.org/licenses/mit"),
    ("mit", None, r"(?:the )?expat(?: license)?", "expat", None),
    ("apache-2.0", "apache-2.0", r"(?:the )?apache(?: software)? license,? (?:version |v\.? ?)?2(?:\.0)?", "apache", r"apache\.org/licenses/license-2\.0"),
    ("apache-1.1", "apache-1.1", r"(?:the )?apache(?: software)? license,? (?:version |v\.? ?)?1\.1", "apache", r"apache\.org/licenses/license-1\.1"),
    ("apache", "apache", r"(?:the )?apache(?: software)? license", "apache", r"apache\.org/licenses"),
    ("gpl-3.0", r"gpl-3\.0(?:-only|-or-later)?", r"(?:the )?gnu general public license,? (?:version |v\.? ?)?3(?:\.0)?", "general", r"gnu\.org/licenses/gpl-3\.0"),
    ("gpl-2.0", r"gpl-2\.0(?:-only|-or-later)?", r"(?:the )?gnu general public license,? (?:version |v\.? ?)?2(?:\.0)?", "general", r"gnu\.org/licenses/gpl-2\.0"),
    ("gpl", "gpl", r"(?:the )?(?:gnu )?general public license", "general", r"gnu\.org/licenses/gpl"),
    ("lgpl-3.0", r"lgpl-3\.0(?:-only|-or-later)?", r"(?:the )?gnu lesser general public license,? (?:version |v\.? ?)?3(?:\.0)?", "lesser", r"gnu\.org/licenses/lgpl-3\.0"),
    ("lgpl-2.1", r"lgpl-2\.1(?:-only|-or-later)?", r"(?:the )?gnu lesser general public license,? (?:version |v\.? ?)?2\.1", "lesser", r"gnu\.org/licenses/lgpl-2\.1"),
    ("lgpl", "lgpl", r"(?:the )?(?:gnu )?(?:lesser|library) general public license", "general", r"gnu\.org/licenses/lgpl"),
    ("agpl-3.0", r"agpl-3\.0(?:-only|-or-later)?", r"(?:the )?(?:gnu )?affero general public license(?:,? (?:version |v\.? ?)?3(?:\.0)?)?", "affero", r"gnu\.org/licenses/agpl"),
    ("bsd-3-clause", "bsd-3-clause", r"(?:the )?(?:new|revised|modified|3-clause|three-clause) bsd license|bsd (?:3-clause|three-clause)(?: license)?", "bsd", r"opensource\.org/licenses/bsd-3-clause"),
    ("bsd-2-clause", "bsd-2-clause", r"(?:the )?(?:simplified|freebsd|2-clause|two-clause) bsd license|bsd (?:2-clause|two-clause)(?: license)?", "bsd", r"opensource\.org/licenses/bsd-2-clause"),
    ("bsd", "bsd", r"(?:the )?bsd(?:-style)? license", "bsd", r"opensource\.org/licenses/bsd"),
    ("0bsd", "0bsd", r"(?:the )?(?:zero-clause|0-clause) bsd(?: license)?", "bsd", r"opensource\.org/licenses/0bsd"),
    ("mpl-2.0", "mpl-2.0", r"(?:the )?mozilla public license,? (?:version |v\.? ?)?2(?:\.0)?", "mozilla", r"mozilla\.org/mpl/2\.0"),
    ("mpl-1.1", "mpl-1.1", r"(?:the )?mozilla public license,? (?:version |v\.? ?)?1\.1", "mozilla", r"mozilla\.org/mpl/1\.1"),
    ("mpl", "mpl", r"(?:the )?mozilla public license", "mozilla", r"mozilla\.org/mpl"),
    ("epl-2.0", "epl-2.0", r"(?:the )?eclipse public license,? (?:version |v\.? ?)?2(?:\.0)?", "eclipse", r"eclipse\.org/legal/epl-2\.0"),
    ("epl-1.0", "epl-1.0", r"(?:the )?eclipse public license,? (?:version |v\.? ?)?1(?:\.0)?", "eclipse", r"eclipse\.org/legal/epl-v10"),
    ("epl", "epl", r"(?:the )?eclipse public license", "eclipse", r"eclipse\.org/legal/epl"),
    ("eupl-1.2", "eupl-1.2", r"(?:the )?european union public licen[cs]e(?:,? (?:version |v\.? ?)?1\.2)?", "european", r"joinup\.ec\.europa\.eu/\S*eupl"),
    ("cddl-1.0", "cddl-1.0", r"(?:the )?common development and distribution license", "development", r"opensource\.org/licenses/cddl"),
    ("cpl-1.0", "cpl-1.0", r"(?:the )?common public license", "common", r"opensource\.org/licenses/cpl1\.0"),
    ("isc", "isc", r"(?:the )?isc license", "isc", r"opensource\.org/licenses/isc"),
    ("zlib", "zlib", r"(?:the )?zlib(?:/libpng)? license", "zlib", r"zlib\.net/zlib_license"),
    ("unlicense", "unlicense", r"the unlicense", "unlicense", r"unlicense\.org"),
    ("wtfpl", "wtfpl", r"do what the fuck you want to public license", "fuck", r"wtfpl\.net"),
    ("artistic-2.0", "artistic-2.0", r"(?:the )?artistic license,? (?:version |v\.? ?)?2(?:\.0)?", "artistic", r"opensource\.org/licenses/artistic-license-2\.0"),
    ("artistic", "artistic-1.0", r"(?:the )?(?:perl )?artistic license", "artistic", r"opensource\.org/licenses/artistic"),
    ("bsl-1.0", "bsl-1.0", r"(?:the )?boost software license(?:,? (?:version |v\.? ?)?1\.0)?", "boost", r"boost\.org/license_1_0"),
    ("busl-1.1", "busl-1.1", r"(?:the )?business source license(?: 1\.1)?", "business", r"mariadb\.com/bsl11"),
    ("sspl-1.0", "sspl-1.0", r"(?:the )?server side public license", "server", r"mongodb\.com/licensing/server-side"),
    ("elastic-2.0", "elastic-2.0", r"(?:the )?elastic license(?: 2\.0)?", "elastic", r"elastic\.co/licensing"),
    ("python-2.0", "(?:python-2.0|psf-2.0)", r"(?:the )?(?:python software foundation|psf) license", "license", r"docs\.python\.org/\S*license"),
    ("php-3.01", "php-3.01", r"(?:the )?php license", "php", r"php\.net/license"),
    ("ruby", "ruby", r"(?:the )?ruby license", "ruby", r"ruby-lang\.org/\S*license"),
    ("ofl-1.1", "ofl-1.1", r"(?:the )?sil open font license", "font", r"scripts\.sil\.org/ofl"),
    ("postgresql", "postgresql", r"(?:the )?postgresql license", "postgresql", r"postgresql\.org/about/licen[cs]e"),
    ("ncsa", "ncsa", r"(?:the )?university of illinois/?ncsa open source license|ncsa license", "ncsa", r"otm\.illinois\.edu/\S*ncsa"),
    ("ms-pl", "ms-pl", r"(?:the )?microsoft public license", "microsoft", r"opensource\.org/licenses/ms-pl"),
    ("odbl-1.0", "odbl-1.0", r"(?:the )?open database license", "database", r"opendatacommons\.org/licenses/odbl"),
    ("odbl-1.0", None, r"odbl", "odbl", None),
    ("odc-by-1.0", "odc-by-1.0", r"(?:the )?open data commons attribution license", "commons", r"opendatacommons\.org/licenses/by"),
    ("gfdl-1.3", r"gfdl-1\.3(?:-only|-or-later)?", r"(?:the )?gnu free documentation license", "documentation", r"gnu\.org/licenses/fdl"),
    *((f"cc-{k}-{v}", rf"cc-{k}-{re.escape(v)}", rf"(?:the )?creative commons {n}(?: international| unported| generic)? (?:{re.escape(v)}|license,? (?:version )?{re.escape(v)})|cc[ -]{k}[ -]{re.escape(v)}", v, rf"creativecommons\.org/licenses/{k}/{re.escape(v)}")
      for v in ("4.0", "3.0") for k, n in (("by", "attribution"), ("by-sa", "attribution-sharealike"), ("by-nc", "attribution-noncommercial"), ("by-nd", "attribution-noderivatives"), ("by-nc-sa", "attribution-noncommercial-sharealike"))),
    ("cc0-1.0", "cc0-1.0", r"cc0(?: 1\.0)?(?: universal)?", "cc0", r"creativecommons\.org/publicdomain/zero"),
    ("public-domain", "public-domain", r"(?:in|into|to) the public domain", "domain", r"creativecommons\.org/publicdomain/mark"),
    ("proprietary", "licenseref-proprietary", r"all rights reserved", "reserved", r"license\.txt for terms"),
    ("proprietary", None, r"proprietary and confidential", "confidential", None),
)
GAP = r"""[\s,;:.()/*#>|"`'\u201c\u201d\u2018\u2019-]+"""
_ARR = r"(?:all rights reserved )?"
_FREE = _ARR + r"permission is hereby granted free of charge"
_ISC = _ARR + r"permission to use copy modify (?:and(?: or)? )?distribute this software for any purpose with or without fee is hereby granted"
_FREE_SOFTWARE = r"(?:this (?:program|library) )?is free software you can redistribute it and or modify it under the terms"
_GNU = _FREE_SOFTWARE + r" of the gnu"
_FSF = r"(?: as published by the free software foundation)?(?: either)?"
_HOPE = r"this WORK is distributed in the hope that it will be useful but without any warranty"
_FIT = r" without even the implied warranty of merchantability or fitness for a particular purpose see the gnu"
#: (label, wording) of grants, conditions and disclaimers in the licences' own words. A blank stands for any
#: white space and comment marks; punctuation is left open. A wording that others begin with stands for the family.
BODIES = (
    ("mit", _FREE + r"(?: to any person obtaining a copy(?: of this software and associated documentation files(?: the software)?(?: to deal in the software without restriction)?)?)?"),
    ("mit", r"in no event shall the authors or copyright holders be liable for any claim"),
    ("ncsa", _FREE + r" to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction"),
    ("bsl-1.0", _FREE + r" to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("ofl-1.1", _FREE + r" to any person obtaining a copy of the font software"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("isc", _ISC + r" provided that the above copyright notice and this permission notice appear in all copies"),
    ("0bsd", _ISC + r" the software is provided as is"),
    ("postgresql", _ARR + r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("bsd", _ARR + r"redistribution and use in source and binary forms(?: with or without modification are permitted)?"),
    ("bsd", r"this software is provided by the (?:copyright holders|regents|author)(?: and contributors)? as is and any express or implied warranties"),
    ("bsd-3-clause", r"neither the name of [^.]{1,120} may be used to endorse or promote products derived from this software"),
    ("bsd-2-clause", r"documentation and or other materials provided with the distribution this software is provided by"),
    ("apache-1.1", r"this product includes software developed by the apache software foundation"),
    ("apache-2.0", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", r"terms and conditions for use reproduction and distribution 1 definitions"),
    ("eupl-1.2", r"unless required by applicable law or agreed to in writing software distributed under the licence is distributed on an as is basis"),
    ("gpl", r"this program is free software"),
    ("gpl", _GNU + r" general public license"),
    ("gpl-2.0", _GNU + r" general public license" + _FSF + r" version 2"),
    ("gpl-2.0", _FREE_SOFTWARE + r" of version 2 of the gnu general public license"),
    ("gpl-3.0", _GNU + r" general public license" + _FSF + r" version 3"),
    ("gpl-3.0", _FREE_SOFTWARE + r" of version 3 of the gnu general public license"),
    ("gpl", _HOPE.replace("WORK", "program")),
    ("gpl", _HOPE.replace("WORK", "(?:program|library)") + _FIT + r" general public license"),
    ("lgpl", _HOPE.replace("WORK", "(?:program|library)") + _FIT + r" (?:lesser|library) general public license"),
    ("agpl-3.0", _HOPE.replace("WORK", "(?:program|library)") + _FIT + r" affero general public license"),
    ("gpl-2.0", r"this license applies to any program or other work which contains a notice placed by the copyright holder"),
    ("gpl-3.0", r"the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("agpl-3.0", r"the gnu affero general public license is a free copyleft license for software and other kinds of works"),
    ("lgpl", r"this library is free software"),
    ("lgpl", _GNU + r" (?:lesser|library) general public license"),
    ("lgpl-2.1", _GNU + r" lesser general public license" + _FSF + r" version 2\.1"),
    ("lgpl-3.0", _GNU + r" lesser general public license" + _FSF + r" version 3"),
    ("lgpl", _HOPE.replace("WORK", "library")),
    ("lgpl-2.1", r"this license agreement applies to any software library or other program which contains a notice"),
    ("agpl-3.0", _GNU + r" affero general public license" + _FSF + r"(?: version 3)?"),
    ("gfdl-1.3", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-2.0", r"if a copy of the mpl was not distributed with this file"),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public license version 1\.1"),
    ("cddl-1.0", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("epl", r"the accompanying program is provided under the terms of this eclipse public license"),
    ("cpl-1.0", r"the accompanying program is provided under the terms of this common public license"),
    ("zlib", r"the origin of this software must not be misrepresented"),
    ("zlib", r"in no event will the authors be held liable for any damages arising from the use of this software"),
    ("wtfpl", r"you just do what the fuck you want to"),
    ("artistic", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2.0", r"this license establishes the terms under which a given free software package may be copied"),
    ("python-2.0", r"psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("php-3.01", r"this product includes php software"),
    ("ruby", r"you may make and give away verbatim copies of the source form of the software without restriction"),
    ("busl-1.1", r"make non-production use of the licensed work"),
    ("sspl-1.0", r"if you make the functionality of the program or a modified version available to third parties as a service"),
    ("elastic-2.0", r"you may not provide the software to third parties as a hosted or managed service"),
    ("ms-pl", r"if you distribute any portion of the software in source code form you may do so only under this license"),
    ("cc0-1.0", r"the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc0-1.0", r"affirmer hereby overtly fully permanently irrevocably and unconditionally waives"),
    ("odbl-1.0", r"licensor grants to you a worldwide royalty free non exclusive terminable but only under section 9 license to use the database"),
    ("proprietary", r"unauthorized (?:copying|reproduction|distribution)(?: or distribution)? of this (?:file|software|document)(?: via any medium)? is strictly prohibited"),
)
VERBS = ("released", "distributed", "available", "provided", "published")
TEMPLATES = (  # (priority, confidence, pattern)
    (100, 1.0, r"spdx-license-identifier:\s*\(?{spdx}(?![a-z0-9.-])"),
    (90, 0.95, r"https?://(?:www\.)?{address}"),
    (80, 0.9, rf"(?:licen[cs]ed|{'|'.join(VERBS)})(?: to you)?\s+under\s+(?:the\s+terms\s+of\s+)?(?:{{name}})"),
    (70, 0.8, r"licen[cs]e:\s*(?:{name})"),
    (50, 0.6, r"(?<![a-z0-9])(?:{name})(?![a-z0-9])"),
)


def _fixed(pattern: str) -> str:
    """The pattern without its optional groups and its groups of alternatives."""
    while (less := re.sub(r"\(\?:[^()]*\)\?|\(\?:[^()]*\|[^()]*\)", "", pattern)) != pattern:
        pattern = less
    return pattern


def _always(word: str, pattern: str) -> bool:
    """True only if every match of the pattern has the word in what is fixed."""
    return all(word in x for x in _fixed(pattern).split("|"))


def _rules() -> tuple[list[tuple], tuple[tuple[str, ...], ...]]:
    """(label, priority, confidence, keyword, pattern), ordered by priority and then by the catalogue; and the gate:
    every match of every rule has all the words of one of its entries."""
    out, gate = [], {("licen",)}
    for label, spdx, name, keyword, address in CATALOGUE:
        spaced = name.replace("[ -]", r"(?:[+-]|\s+)").replace(" ?", r"\s*").replace(" ", r"\s+")
        for priority, confidence, template in TEMPLATES:
            if spdx is None and priority > 80:
                continue
            plain = priority == 50 and label == "mit"  # a bare short name must be followed by its kind
            own = rf"(?:the\s+)?{keyword}\s+license" if plain else spaced
            site = re.match(r"(?:[a-z0-9_/-]|\\\.)+", address or "-")[0].replace("\\", "")  # what is fixed of the address
            needs = {100: "spdx-license-identifier", 90: site}.get(priority, keyword)
            pattern = template.replace("{spdx}", spdx or "").replace("{address}", address or "").replace("{name}", own)
            out.append((label, priority, confidence, needs, pattern))
            if "licen" not in needs and priority != 70 and not _always("licen", address if priority == 90 else own):
                gate |= {("under", v, needs) for v in VERBS} if priority == 80 else {(needs,)}
    for label, wording in BODIES:
        words = sorted(re.findall(r"(?<![^ ])[a-z]{4,}(?![^ ])", _fixed(wording)), key=len, reverse=True)[:3]
        out.append((label, 85, 0.85, words[0], wording.replace(" ", GAP)))
        gate.add(("licen",) if _always("licen", wording) else tuple(words))
    least = {g for g in gate if not any(o != g and all(any(w in x for x in g) for w in o) for o in gate)}
    return sorted(out, key=lambda r: -r[1]), tuple(sorted(least))


RULES, GATE = _rules()
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # between words, before lower-casing
BASE = (("mit", ("mit", "license")), ("apache", ("apache", "license")), ("gpl", ("general", "public", "license")))


def _keywords(low: Column) -> Column:
    return F.filter(F.array(*[F.lit(k) for k in sorted({r[3] for r in RULES})]), lambda k: F.contains(low, k))


def _matches(low: Column, keywords: Column) -> Column:
    """array<struct<label, priority, confidence, found, gaps>> of the rules that match, among those whose keyword
    occurs: their matches and what lies between them."""
    rules = F.array(*[F.struct(F.lit(x).alias("label"), F.lit(p).alias("priority"), F.lit(c).alias("confidence"), F.lit(k).alias("keyword"), F.lit(r).alias("pattern")) for x, p, c, k, r in RULES])
    run = F.filter(F.filter(rules, lambda r: F.array_contains(keywords, r["keyword"])), lambda r: F.regexp_like(low, r["pattern"]))
    return F.transform(run, lambda r: F.struct(r["label"].alias("label"), r["priority"].alias("priority"), r["confidence"].alias("confidence"), F.regexp_extract_all(low, r["pattern"], F.lit(0)).alias("found"), F.split(low, r["pattern"], -1).alias("gaps")))


RUN = 64  # elements whose sums or maxima are taken together, so that long arrays never cost their square


def _let(value: Column, body) -> Column:
    """body of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _runs(xs: Column, f) -> Column:
    """f of each run of RUN elements."""
    return F.transform(F.sequence(F.lit(0), (F.size(xs) / RUN).cast("int")), lambda j: f(F.slice(xs, j * RUN + 1, F.lit(RUN))))


def _own_run(xs: Column, i: Column) -> Column:
    """What stands before element i in its run."""
    j = (i / RUN).cast("int") * RUN
    return F.slice(xs, j + 1, i - j)


def _detections(matches: Column) -> Column:
    """array<struct<a, b, priority, label, confidence>> of all matches."""
    total = lambda xs, first=F.lit(0): F.aggregate(xs, first, lambda a, x: a + x)

    def places(r: Column) -> Column:
        gaps = F.slice(r["gaps"], F.lit(1), F.size(r["found"]))
        pieces = F.zip_with(gaps, r["found"], lambda g, x: F.struct(F.char_length(g).alias("g"), F.char_length(x).alias("n")))

        def placed(s: Column) -> Column:
            lengths = s["lengths"]

            def start(i: Column, before: Column) -> Column:
                return total(_own_run(lengths, i), F.get(before, (i / RUN).cast("int"))) + F.get(s["pieces"], i)["g"]

            def at(before: Column) -> Column:
                found = F.transform(s["pieces"], lambda x, i: F.struct(start(i, before).alias("a"), x["n"].alias("n")))
                return F.transform(found, lambda x: F.struct(x["a"].alias("a"), (x["a"] + x["n"]).alias("b"), r["priority"].alias("priority"), r["label"].alias("label"), r["confidence"].alias("confidence")))

            return _let(_let(_runs(lengths, total), lambda sums: F.transform(sums, lambda _, j: total(F.slice(sums, F.lit(1), j)))), at)

        own = _let(pieces, lambda p: F.struct(p.alias("pieces"), F.transform(p, lambda x: x["g"] + x["n"]).alias("lengths")))
        return _let(own, placed)

    return F.flatten(F.transform(matches, places))


def _surviving(d: Column) -> Column:
    """Without those that lie within one that beats them. In the order used, whatever may beat a detection stands before
    it: it is beaten if one of no lower priority before it ends where it does or behind."""
    levels = sorted({r[1] for r in RULES}, reverse=True)
    order = F.array_sort(F.transform(d, lambda x: F.struct(x["a"].alias("a"), (-x["b"]).alias("_b"), (-x["priority"]).alias("_p"), x["label"].alias("label"), x["b"].alias("b"), x["priority"].alias("priority"), x["confidence"].alias("confidence"))))

    def reach(xs: Column, least: Column, first: Column) -> Column:
        return F.aggregate(xs, first, lambda e, x: F.greatest(e, F.when(x["priority"] >= least, x["b"]).otherwise(F.lit(-1))))

    def swept(xs: Column) -> Column:
        ends = _runs(xs, lambda own: F.array(*[reach(own, F.lit(p), F.lit(-1)) for p in levels]))
        before = _let(ends, lambda e: F.transform(e, lambda _, j: F.aggregate(F.slice(e, F.lit(1), j), F.array(*[F.lit(-1)] * len(levels)), lambda m, x: F.zip_with(m, x, lambda y, z: F.greatest(y, z)))))

        def kept(before: Column) -> Column:
            farthest = lambda i, x: reach(_own_run(xs, i), x["priority"], F.element_at(F.get(before, (i / RUN).cast("int")), F.array_position(F.array(*map(F.lit, levels)), x["priority"]).cast("int")))
            return F.filter(xs, lambda x, i: farthest(i, x) < x["b"])

        return _let(before, kept)

    return F.transform(_let(order, swept), lambda x: F.struct(*[x[c].alias(c) for c in ("a", "b", "priority", "label", "confidence")]))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_labels, labels, score, and detections: array<struct<a, b, priority, label, confidence>>,
    positions in characters."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select("doc_id", text.alias("_text")).withColumn("_any", F.lower("_text"))
    own = own.withColumns({"_gated": _or(_all(F.contains(F.col("_any"), F.lit(k)) for k in g) for g in GATE), "_split": F.split("_text", GAPS)}).drop("_any")
    # what splits at gaps are words, but for an empty piece before a leading and after a trailing gap
    outer = [F.when(F.element_at("_split", i) == "", 1).otherwise(0) for i in (1, -1)]
    own = own.withColumns({
        "n_words": F.greatest(F.size("_split") - outer[0] - outer[1], F.lit(0)).cast("long"),
        "_low": F.when(F.col("_gated"), ascii_lower(F.col("_text"))),
    }).drop("_text", "_split")
    own = own.withColumn("_words", F.when(F.col("_gated"), F.regexp_extract_all("_low", F.lit(ALNUM_WORD), F.lit(0))))
    own = own.withColumn("_at", F.filter(F.transform("_words", lambda w, i: F.when(w == "license", i).otherwise(F.lit(-1))), lambda i: i >= 0))
    word = lambda i: F.when(i >= 0, F.get(F.col("_words"), i))

    def places(phrase: tuple[str, ...]) -> Column:
        k = len(phrase) - 1
        fits = lambda i: F.coalesce(_all(word(i - k + j) == w for j, w in enumerate(phrase[:-1])), F.lit(False))
        return F.transform(F.filter("_at", fits), lambda i: i - k)

    none = F.array().cast("array<int>")
    own = own.withColumns({f"_p_{label}": F.coalesce(places(p), none) for label, p in BASE})
    every = F.concat(*[F.col(f"_p_{label}") for label, _ in BASE])
    base = F.filter(F.array(*[F.when(F.size(f"_p_{label}") > 0, F.lit(label)) for label, _ in BASE]), lambda x: x.isNotNull())
    empty = F.array().cast("array<struct<a:int,b:int,priority:int,label:string,confidence:double>>")
    own = own.withColumns({"_every": every, "_base": base, "_keys": F.when(F.col("_gated"), _keywords(F.col("_low")))})
    own = own.withColumn("_matches", F.when(F.size("_keys") > 0, _matches(F.col("_low"), F.col("_keys"))))
    own = own.withColumn("_found", F.coalesce(_detections(F.col("_matches")), empty))
    own = own.withColumn("detections", _surviving(F.col("_found")))
    labels = F.array_sort(F.array_distinct(F.concat("_base", F.transform("detections", lambda x: x["label"]))))
    best = F.coalesce(F.array_max(F.transform("detections", lambda x: x["confidence"])), F.lit(0.0))
    return own.select(
        "doc_id", "n_words", F.size("_every").cast("long").alias("n_base"), F.array_min("_every").cast("long").alias("first_word"), F.array_max("_every").cast("long").alias("last_word"),
        F.array_join(F.array_sort("_base"), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.greatest(best, F.when(F.size("_base") > 0, F.lit(0.5)).otherwise(F.lit(0.0))).alias("score"), "detections",
    )


def _all(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _or(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("detections")
