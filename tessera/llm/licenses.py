"""Licence scans by ordered signature rules, in SQL functions only.

A text becomes its lower-cased words with a space on either side of each, so that a signature is
a regular expression over whole words.  Every rule belongs to a keyword; a text meets only the
rules of the keywords it has.  Each place a rule matches is a detection, an interval of words.
A detection that lies inside another of the same or a better priority is suppressed (of equal
intervals the better priority stays, then the earlier rule).  Where detections overlap in part,
both stay.

Rules are a constant of a few hundred entries, and the scan is one pass without a shuffle: rules,
places and suppression are array expressions over one row.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Priorities: whole sentences and texts, then tags, then bare mentions.
SENTENCE, TAG, MENTION = 0, 1, 2
_WEIGHTS = (0.95, 0.9, 0.6)


@dataclass(frozen=True)
class Rule:
    """`pattern`: words as regular expressions, space-separated, with groups of words in (?: ...) as in `(?:the )?mit`.
    `keyword` is a word that every match has; a `licensed` rule's matches have `license` or `licence` as well."""

    label: str
    keyword: str
    pattern: str
    priority: int
    base: bool = False
    licensed: bool = False

    @property
    def regex(self) -> str:
        """Over text in which each word has a space of its own on either side; ` ?` joins words or leaves them apart."""
        return " " + "(?:  )?".join(x.replace(" ", "  ") for x in self.pattern.split(" ?")) + " "


# Licence families as (label, name in words, versions, words of its own that gate it).
# In names, `\d+` and groups are regular expressions over whole words.
FAMILIES: tuple[tuple[str, str, tuple[str, ...], str], ...] = (
    ("apache", "apache(?: software)?", ("1 0", "1 1", "2 0"), "apache"),
    ("gpl", "(?:gnu )?general public", ("1", "2", "3"), "general"),
    ("lgpl", "(?:gnu )?(?:lesser|library) general public", ("2", "2 1", "3"), "general"),
    ("agpl", "(?:gnu )?affero general public", ("1", "3"), "affero"),
    ("gfdl", "(?:gnu )?free documentation", ("1 1", "1 2", "1 3"), "documentation"),
    ("mpl", "mozilla public", ("1 0", "1 1", "2 0"), "mozilla"),
    ("epl", "eclipse public", ("1 0", "2 0"), "eclipse"),
    ("cddl", "common development and distribution", ("1 0", "1 1"), "distribution"),
    ("cpl", "common public", ("1 0",), "common"),
    ("eupl", "european union public", ("1 0", "1 1", "1 2"), "european"),
    ("osl", "open software", ("1 0", "2 0", "2 1", "3 0"), "open"),
    ("afl", "academic free", ("1 1", "1 2", "2 0", "2 1", "3 0"), "academic"),
    ("artistic", "artistic", ("1 0", "2 0"), "artistic"),
    ("bsl", "boost software", ("1 0",), "boost"),
    ("lppl", "latex project public", ("1 0", "1 1", "1 2", "1 3a", "1 3c"), "latex"),
    ("ofl", "(?:sil )?open font", ("1 0", "1 1"), "font"),
    ("php", "php", ("3 0", "3 01"), "php"),
    ("python", "python(?: software foundation)?", ("2 0",), "python"),
    ("zpl", "zope public", ("1 1", "2 0", "2 1"), "zope"),
    ("apsl", "apple public source", ("1 0", "1 1", "1 2", "2 0"), "apple"),
    ("qpl", "q public", ("1 0",), "q"),
    ("ipl", "ibm public", ("1 0",), "ibm"),
    ("npl", "netscape public", ("1 0", "1 1"), "netscape"),
    ("spl", "sun public", ("1 0",), "sun"),
    ("rpl", "reciprocal public", ("1 1", "1 5"), "reciprocal"),
    ("cecill", "cecill", ("1 0", "1 1", "2 0", "2 1"), "cecill"),
    ("ecl", "educational community", ("1 0", "2 0"), "educational"),
    ("odbl", "open(?: data commons)? (?:open )?database", ("1 0",), "database"),
    ("odc-by", "open data commons attribution", ("1 0",), "attribution"),
    ("upl", "universal permissive", ("1 0",), "universal"),
    ("mulan", "mulan permissive(?: software)?", ("1", "2"), "mulan"),
    ("polyform", "polyform (?:noncommercial|strict|small business)", ("1 0 0",), "polyform"),
    ("mit", "mit", (), "mit"),
    ("isc", "isc", (), "isc"),
    ("zlib", "zlib(?: libpng)?", (), "zlib"),
    ("ncsa", "university of illinois(?: ncsa)?(?: open source)?", (), "illinois"),
    ("wtfpl", "do what the fuck you want to public", (), "fuck"),
    ("beerware", "beerware", (), "beerware"),
    ("postgresql", "postgresql", (), "postgresql"),
    ("openssl", "openssl", (), "openssl"),
    ("curl", "curl", (), "curl"),
    ("ruby", "ruby", (), "ruby"),
    ("vim", "vim", (), "vim"),
    ("ms-pl", "microsoft public", (), "microsoft"),
    ("ms-rl", "microsoft reciprocal", (), "microsoft"),
    ("bsd-2", "(?:simplified|2 clause|two clause|freebsd) bsd", (), "bsd"),
    ("bsd-3", "(?:modified|new|revised|3 clause|three clause) bsd", (), "bsd"),
    ("bsd-4", "(?:original|4 clause|four clause) bsd", (), "bsd"),
    ("bsd", "bsd", (), "bsd"),
)

# Creative Commons licences as (label, long name in words, short name in words) and their versions.
COMMONS = (
    ("cc-by-nc-nd", "attribution non ?commercial no ?deriv(?:ative)?s", "by nc nd"), ("cc-by-nc-sa", "attribution non ?commercial share ?alike", "by nc sa"), ("cc-by-nc", "attribution non ?commercial", "by nc"),
    ("cc-by-nd", "attribution no ?deriv(?:ative)?s", "by nd"), ("cc-by-sa", "attribution share ?alike", "by sa"), ("cc-by", "attribution", "by"),
)
COMMONS_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")

# Sentences of the licences themselves and of their notices, as (label, keyword, words), by hand.
SIGNATURES = (
    # MIT, X11, ISC and other short permissive texts
    ("mit", "granted", "permission is hereby granted free of charge to any person obtaining a copy"), ("mit", "sublicense", "publish distribute sublicense and or sell copies"), ("mit", "deal", "to deal in the software without restriction"),
    ("mit", "substantial", "shall be included in all copies or substantial portions of the software"), ("mit", "fitness", "fitness for a particular purpose and non ?infringement"), ("mit", "dealings", "the use or other dealings in the software"),
    ("x11", "consortium", "the name of the x consortium shall not be used in advertising"), ("x11", "advertising", "shall not be used in advertising or otherwise to promote the sale use or other dealings"), ("mit-0", "furnished", "to permit persons to whom the software is furnished to do so"),
    ("isc", "purpose", "permission to use copy modify and or distribute this software for any purpose"), ("isc", "disclaims", "the author disclaims all warranties with regard to this software"), ("isc", "tortious", "negligence or other tortious action arising out of"), ("0bsd", "hereby", "for any purpose with or without fee is hereby granted"),
    ("hpnd", "appears", "provided that the above copyright notice appears? in all copies and that both"), ("ntp", "suitability", "makes no representations about the suitability (?:of )?this software for any purpose"), ("smlnj", "universities", "the names? of (?:the )?universities"),
    ("zlib", "altered", "altered source versions must be plainly marked as such"), ("zlib", "misrepresented", "the origin of this software must not be misrepresented"), ("zlib", "documentation", "an acknowledge?ment in the product documentation would be appreciated"), ("libpng", "contributing", "contributing authors and group 42 inc disclaim all warranties"),
    ("wtfpl", "fuck", "you just do what the fuck you want to"), ("beerware", "beer", "buy me a beer in return"), ("beerware", "stuff", "as long as you retain this notice you can do whatever you want with this stuff"), ("fsfap", "copying", "copying and distribution of this file with or without modification are permitted"),
    ("fsful", "configure", "this configure script is free software"), ("fsf-unlimited", "unlimited", "gives unlimited permission to copy and or distribute it"), ("curl", "granted", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"),
    # BSD
    ("bsd", "redistribution", "redistribution and use in source and binary forms"), ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice"), ("bsd", "binary", "redistributions in binary form must reproduce the above copyright notice"), ("bsd", "disclaimer", "this list of conditions and the following disclaimer"),
    ("bsd-3", "endorse", "may be used to endorse or promote products"), ("bsd-3", "contributors", "neither the name of (?:the )?(?:copyright holders?|author|organization|university|company) nor the names of (?:its|the|any) contributors"), ("bsd-3", "regents", "the regents of the university of california"),
    ("bsd-4", "advertising", "all advertising materials mentioning features or use of this software"), ("bsd-4", "display", "must display the following acknowledge?ment"), ("bsd", "consequential", "direct indirect incidental special exemplary or consequential damages"), ("bsd", "procurement", "procurement of substitute goods or services"),
    ("bsd-2-patent", "grants", "subject to the terms and conditions of this license each copyright holder and contributor hereby grants"), ("bsd-3-clear", "patent", "no express or implied licenses to any party s patent rights"), ("bsd-3-nuclear", "nuclear", "not designed licensed or intended for use in the design construction operation or maintenance of any nuclear facility"),
    # Apache
    ("apache-2.0", "www", "www apache org licenses license 2 0"), ("apache-2.0", "compliance", "you may not use this file except in compliance with the license"), ("apache-2.0", "writing", "unless required by applicable law or agreed to in writing"), ("apache-2.0", "permissions", "see the license for the specific language governing permissions and limitations"),
    ("apache-2.0", "basis", "distributed on an as is basis without warranties or conditions of any kind"), ("apache-2.0", "perpetual", "a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"), ("apache-2.0", "modified", "you must cause any modified files to carry prominent notices"),
    ("apache-2.0", "intentionally", "intentionally submitted to licensor for inclusion in the work"), ("apache", "foundation", "this product includes software developed (?:by|at) the apache software foundation"), ("apache-1.1", "apache", "the names apache and apache software foundation must not be used"), ("apache", "contributor", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    # the GNU family
    ("gpl", "redistribute", "you can redistribute it and or modify it under the terms"), ("gpl", "hope", "distributed in the hope that it will be useful"), ("gpl", "received", "you should have received a copy of the gnu general public license"), ("lgpl", "received", "you should have received a copy of the gnu (?:lesser|library) general public license"),
    ("agpl", "affero", "you should have received a copy of the gnu affero general public license"), ("gpl", "published", "as published by the free software foundation"), ("gpl", "later", "either version \\d+(?: \\d+)? of the license or at your option any later version"), ("gpl", "temple", "59 temple place(?: suite 330)? boston"), ("gpl", "franklin", "51 franklin st(?:reet)?(?: fifth floor)? boston"),
    ("gpl", "copyleft", "copyleft licenses? for software"), ("gpl", "freedom", "guarantee your freedom to share and change"), ("gpl", "designed", "the licenses for most software are designed to take away your freedom"), ("gpl", "preferred", "the source code for a work means the preferred form of the work for making modifications"), ("gpl-3", "circumvention", "protecting users legal rights from anti circumvention law"),
    ("gpl-3", "conveying", "conveying modified source versions"), ("gpl-3", "installation", "installation information for a user product means"), ("gpl-2", "program", "you may copy and distribute verbatim copies of the program s source code"), ("gpl-2", "gplv2", "gplv2"), ("gpl-2", "v2", "gpl v2"), ("gpl-3", "gplv3", "gplv3"), ("gpl-3", "v3", "gpl v3"), ("lgpl", "library", "a work that uses the library"), ("lgpl-2.1", "library", "this library is free software you can redistribute it"),
    ("lgpl-3", "combined", "a combined work is a work produced by combining or linking an application with the library"), ("agpl-3", "interacting", "all users interacting with it remotely through a computer network"), ("gpl-exception", "exception", "as a special exception"), ("gpl-classpath", "classpath", "classpath exception"), ("gpl-linking", "linking", "linking this library statically or dynamically with other modules"),
    ("gpl-bison", "bison", "as a special exception you may create a larger work that contains part or all of the bison parser skeleton"), ("gfdl", "invariant", "with no invariant sections"), ("gfdl", "cover", "no front cover texts and no back cover texts"), ("gfdl", "document", "permission is granted to copy distribute and or modify this document"),
    # weak copyleft
    ("mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public license"), ("mpl-2.0", "obtain", "you can obtain one at (?:http |https )?mozilla org mpl 2 0"), ("mpl-1.1", "mozilla", "the contents of this file are subject to the mozilla public license version 1 1"), ("mpl-2.0", "incompatible", "incompatible with secondary licenses"), ("npl", "netscape", "the contents of this file are subject to the netscape public license"),
    ("mpl", "covered", "distribution of covered software in source code form"), ("epl", "accompanying", "this program and the accompanying materials are made available under the terms of the eclipse"), ("epl", "eclipse", "www eclipse org legal epl"), ("cpl", "common", "the accompanying program is provided under the terms of this common public license"), ("ipl", "agreement", "any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement"),
    ("cddl", "distribution", "common development and distribution license the license"), ("cddl", "opensolaris", "usr src opensolaris license"), ("eupl", "eupl", "licensed under the eupl"), ("osl", "open", "licensed under the open software license version"), ("afl", "academic", "licensed under the academic free license version"), ("cpal", "attribution", "common public attribution license"),
    ("ms-pl", "accept", "if you use the software you accept this license if you do not accept the license do not use the software"), ("ms-rl", "contains", "for any file you distribute that contains code from the software"), ("artistic", "artistic", "the clarified artistic license"), ("artistic", "standard", "standard version refers to"), ("artistic", "perl", "same terms as perl itself"), ("lppl", "latex", "may be distributed and or modified under the conditions of the latex project public license"),
    ("lppl", "maintenance", "this work has the lppl maintenance status"), ("qpl", "trolltech", "trolltech as"), ("sleepycat", "sleepycat", "sleepycat software"), ("apsl", "apple", "this file contains original code and or modifications of original code as defined in and that are subject to the apple public source license"), ("cecill", "cecill", "ce logiciel est regi par la licence cecill"), ("rpl", "acquired", "unless explicitly acquired and licensed from licensor under another license"),
    # languages, databases, tools
    ("python", "psf", "psf license agreement"), ("python", "beopen", "beopen python open source license agreement"), ("python", "cnri", "cnri open source license agreement"), ("php", "php", "products derived from this software may not be called php"), ("php", "zend", "this product includes the zend engine"), ("ruby", "matsumoto", "yukihiro matsumoto"), ("vim", "vim", "there are no restrictions on distributing unmodified copies of vim"),
    ("openssl", "openssl", "developed by the openssl project for use in the openssl toolkit"), ("openssl", "eric", "this product includes cryptographic software written by eric young"), ("postgresql", "paragraphs", "provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies"), ("sqlite", "disclaims", "the author disclaims copyright to this source code"), ("tcl", "grant", "the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose"),
    ("icu", "icu", "icu license"), ("unicode", "unicode", "unicode data files and software"), ("ijg", "jpeg", "this software is based in part on the work of the independent jpeg group"), ("freetype", "freetype", "portions of this software are copyright \\d{4} the freetype project"), ("imagemagick", "imagemagick", "imagemagick studio llc"), ("info-zip", "zip", "info zip"), ("bzip2", "seward", "julian seward"), ("boost", "machine", "machine executable object code generated by a source language processor"),
    ("bsl-1.0", "boost", "www boost org license 1 0"), ("ncsa", "illinois", "neither the names of (?:the )?llvm team university of illinois"), ("llvm-exception", "llvm", "llvm exceptions? to the apache 2 0 license"), ("ofl", "reserved", "with reserved font name"), ("ofl", "font", "the fonts? (?:are|is) licensed under the sil open font license"), ("bitstream-vera", "bitstream", "bitstream vera is a trademark of bitstream"),
    # content and data
    ("cc0", "cc0", "cc0(?: 1 0)?(?: universal)?"), ("cc0", "waived", "has waived all copyright"), ("cc0", "extent", "to the extent possible under law"), ("cc0", "affirmer", "affirmer hereby overtly fully permanently irrevocably and unconditionally waives"), ("cc-by", "credit", "you must give appropriate credit provide a link to the license"), ("cc-by-sa", "remix", "if you remix transform or build upon the material you must distribute your contributions under the same license"),
    ("cc-by-nc", "commercial", "you may not use the material for commercial purposes"), ("cc-by-nd", "material", "you may not distribute the modified material"), ("cc", "commons", "creative commons corporation is not a law firm"), ("cc", "commons", "some rights reserved under creative commons"), ("public-domain", "domain", "(?:placed|released|dedicated) (?:in|into|to) the public domain"), ("public-domain", "domain", "public domain"), ("pddl", "dedication", "public domain dedication and license"),
    ("unlicense", "unencumbered", "free and unencumbered software"), ("unlicense", "unlicense", "(?:the )?unlicense"), ("unlicense", "relinquishment", "intend this dedication to be an overt act of relinquishment in perpetuity"), ("odbl", "openstreetmap", "openstreetmap contributors"), ("odbl", "odbl", "open database license odbl"), ("cdla", "community", "community data license agreement"), ("ogl", "sector", "contains public sector information licensed under the open government licen[cs]e"), ("wikipedia", "available", "text is available under the creative commons attribution share ?alike license"),
    # models and source-available
    ("openrail", "openrail", "(?:creativeml )?openrail(?: m| s)?"), ("openrail", "rail", "open rail(?: m| s)? license"), ("llama", "llama", "llama \\d+(?: \\d+)? community license"), ("bsl-1.1", "change", "change date the change license"), ("bsl-1.1", "business", "business source license"), ("sspl", "sspl", "server side public license sspl"), ("sspl", "server", "server side public license"), ("elastic", "elastic", "elastic license(?: 2 0)?"), ("commons-clause", "clause", "commons clause license condition"), ("polyform", "noncommercial", "polyform noncommercial"),
    # notices, warranties and reservations
    ("warranty", "warranty", "without warranty of any kind"), ("warranty", "warranty", "without any warranty"), ("warranty", "warranties", "express or implied warranties"), ("warranty", "merchantability", "implied warranty of merchantability"), ("warranty", "liable", "in no event (?:shall|will) the (?:authors?|copyright holders?|contributors) be liable"), ("warranty", "provided", "this software is provided as is"),
    ("copyright", "copyright", "copyright (?:c )?\\d{4}"), ("copyright", "copyright", "copyright notice"), ("copyright", "portions", "portions copyright"), ("reserved", "rights", "some rights reserved"), ("reserved", "reserved", "all other rights reserved"), ("trademark", "trademarks", "are (?:registered )?trademarks of their respective owners"), ("export", "export", "export administration regulations"), ("government", "dfars", "dfars 252 227 7013"), ("government", "restricted", "restricted rights legend"),
    ("proprietary", "proprietary", "proprietary and confidential"), ("proprietary", "unauthorized", "unauthorized copying of this file"), ("proprietary", "commercial", "not for commercial use"), ("proprietary", "consent", "without (?:the )?prior written consent"), ("proprietary", "permission", "without (?:the )?(?:prior )?written permission"), ("proprietary", "secrets", "contains trade secrets"), ("proprietary", "reproduced", "no part of this (?:publication|document|work|book) may be reproduced"), ("proprietary", "user", "end user license agreement"),
    ("proprietary", "evaluation", "for evaluation purposes only"), ("proprietary", "agreement", "non ?disclosure agreement"), ("proprietary", "decompile", "reverse engineer decompile or disassemble"), ("proprietary", "internal", "for internal use only"),
)

#: The phrases and labels of the base scan.
BASE = (("cc-by", "cc", "cc by"), ("gpl", "public", "general public license"), ("reserved", "reserved", "all rights reserved"))


def build_rules() -> tuple[Rule, ...]:
    """Base phrases first, then each family's sentences, tags and mentions, with a version and without."""
    rules = [Rule(label, key, words, MENTION, True) for label, key, words in BASE]
    license_ = "(?:public )?licen[cs]e"
    for label, name, versions, key in FAMILIES:
        for v in (*versions, ""):
            full = f"{label}-{v.replace(' ', '.')}" if v else label
            tail = f" (?:version |v )?v?{v}" if v else ""
            rules.append(Rule(full, key, f"(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?{name} {license_}{tail}", SENTENCE, licensed=True))
            rules.append(Rule(full, key, f"{name} {license_}{tail}", MENTION if not v else TAG, licensed=True))
        for v in versions:
            rules.append(Rule(f"{label}-{v.replace(' ', '.')}", "spdx", f"spdx license identifier {label.replace('-', ' ')} {v}(?: only| or later)?", TAG))
        rules.append(Rule(label, "spdx", f"spdx license identifier {label.replace('-', ' ')}", TAG))
    for label, long, short in COMMONS:
        for v in (*COMMONS_VERSIONS, ""):
            full, tail = (f"{label}-{v.replace(' ', '.')}", f" {v}") if v else (label, "")
            rules.append(Rule(full, "cc", f"(?:licensed|released|distributed|available|published) under (?:the )?(?:a )?cc {short}{tail}(?: licen[cs]e)?", SENTENCE))
            rules.append(Rule(full, "cc", f"cc {short}{tail}", TAG if v else MENTION))
            rules.append(Rule(full, "creative", f"creative commons {long}{tail}(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?", SENTENCE if v else TAG))
            if v:
                rules.append(Rule(full, "creativecommons", f"creativecommons org licenses {short}{tail}", TAG))
    rules += [Rule(label, key, words, TAG) for label, key, words in SIGNATURES]
    return tuple(rules)


RULES = build_rules()

#: What separates words; in both engines' dialects of regular expressions.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


_RULES = "array<struct<rule:int,label:string,regex:string,marked:string,priority:int,base:boolean,weight:double>>"
_FOUND = "array<struct<first:int,minus_last:int,priority:int,rule:int,label:string,base:boolean,weight:double>>"


#: What stands before and after a match where matches are marked; no word has either.
_BEGIN, _END = "\x01", "\x02"
#: Detections that are gone through together: one whole number has their verdicts, as arrays in an aggregate are copied at each step.
_CHUNK = 60


def _book(rules: tuple[Rule, ...], licensed: bool) -> Column:
    """Rules by keyword, a constant."""
    by_key: dict[str, list[dict]] = {}
    for i, r in enumerate(rules):
        if r.licensed == licensed:
            by_key.setdefault(r.keyword, []).append({"rule": i, "label": r.label, "regex": r.regex, "marked": f" ({r.regex[1:-1]}) ", "priority": r.priority, "base": r.base, "weight": _WEIGHTS[r.priority]})
    return F.from_json(F.lit(json.dumps(by_key)), f"map<string,{_RULES}>")


def prepared(docs: DataFrame, keywords: list[str], id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_words, `line` (the words, each with a space on either side) and `keys` (the keywords among them)."""
    lower = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), _UPPER, _LOWER)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.trim(F.regexp_replace(lower, SEPARATORS, " ")).alias("line"))
    rows = rows.select("doc_id", "line", F.split("line", " ").alias("words"))
    n_words = F.when(F.col("line") == "", 0).otherwise(F.size("words")).cast("long")
    keys = F.array_intersect("words", F.array(*map(F.lit, keywords)))
    return rows.select("doc_id", n_words.alias("n_words"), F.concat(F.lit(" "), F.replace("line", F.lit(" "), F.lit("  ")), F.lit(" ")).alias("line"), keys.alias("keys"))


def _places(line: Column, r: Column) -> Column:
    """Every place where a rule matches, as words from `first` to before -`minus_last`: matches get marks around them, and the
    words with marks say where these stand, in one pass over the words."""
    words = F.split(F.trim(F.regexp_replace(line, r["marked"], F.lit(f" {_BEGIN}$1{_END} "))), "  ")
    numbers = lambda ws, test: F.filter(F.transform(ws, lambda w, i: F.when(test(w), i)), lambda i: i.isNotNull())

    def one(first: Column, last: Column) -> Column:
        return F.struct(first.cast("int").alias("first"), (-last - 1).cast("int").alias("minus_last"), *[r[k].alias(k) for k in ("priority", "rule", "label", "base", "weight")])

    found = F.transform(F.array(words), lambda ws: F.zip_with(numbers(ws, lambda w: F.startswith(w, F.lit(_BEGIN))), numbers(ws, lambda w: F.endswith(w, F.lit(_END))), one))
    return F.when(F.regexp_like(line, r["regex"]), F.get(found, F.lit(0)).cast(_FOUND)).otherwise(F.array().cast(_FOUND))


def _unsuppressed(rows: DataFrame) -> DataFrame:
    """`rows` with `detections`: those of `found` without one before them, in order of first word, longest, priority and rule, that reaches as far and has no
    worse priority.  They are gone through in chunks that know how far those before them reach (r0, r1, r2: of each priority or better)."""
    reach = lambda s, x, q: F.when(x["priority"] <= q, F.greatest(s[f"r{q}"], -x["minus_last"])).otherwise(s[f"r{q}"]).alias(f"r{q}")
    zero = [F.lit(0).alias(f"r{q}") for q in (0, 1, 2)]

    def verdict(s: Column, x: Column) -> Column:
        p = x["priority"]
        inside = F.when(p == SENTENCE, s["r0"]).when(p == TAG, s["r1"]).otherwise(s["r2"]) >= -x["minus_last"]
        stays = F.when(inside, s["stays"]).otherwise(s["stays"] + s["bit"])
        return F.struct(*[reach(s, x, q) for q in (0, 1, 2)], (s["bit"] * 2).alias("bit"), stays.alias("stays"))

    def stay(chunk: Column, i: Column) -> Column:
        before = F.slice("reach", F.lit(1), i)
        far = [F.coalesce(F.array_max(before[f"r{q}"]), F.lit(0)).alias(f"r{q}") for q in (0, 1, 2)]
        start = F.struct(*far, F.lit(1).cast("long").alias("bit"), F.lit(0).cast("long").alias("stays"))
        mask = F.array(F.aggregate(chunk, start, verdict, lambda s: s["stays"]))
        return F.get(F.transform(mask, lambda m: F.filter(chunk, lambda x, j: F.call_function("shiftright", m, j).bitwiseAND(F.lit(1).cast("long")) == 1)), F.lit(0))

    n = F.size("found")
    cut = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / _CHUNK).cast("int")), lambda c: F.slice("found", c * _CHUNK + 1, F.lit(_CHUNK)))
    rows = rows.withColumn("found", F.sort_array("found")).withColumn("chunks", F.when(n > 0, cut).otherwise(F.array().cast(f"array<{_FOUND}>")))
    rows = rows.withColumn("reach", F.transform("chunks", lambda ch: F.aggregate(ch, F.struct(*zero), lambda s, x: F.struct(*[reach(s, x, q) for q in (0, 1, 2)]))))
    return rows.withColumn("detections", F.flatten(F.transform("chunks", stay))).drop("chunks", "reach")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_base, first_word, last_word (long), base_labels, labels
    (string), score (double), and `detections`, the array of structs of detections that stay (first word, minus
    the word after the last, priority, rule, label, base, weight).

    A-Z are lower-cased; words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`.  Base rules count at every place;
    n_base, first_word, last_word and base_labels are theirs, whatever suppresses them.  labels are the
    base ones and those of the detections that stay, distinct, sorted and comma-joined; score is the largest
    weight of a detection that stays, 0 without.  Null and empty texts have no words and no labels.  Null
    ids and repeated rows each get their row; other columns are not read.  An empty table gives an empty result.
    """
    texts = prepared(docs, sorted({r.keyword for r in rules} | {"license", "licence"}), id_col, text_col)
    some = lambda licensed: F.flatten(F.transform("keys", lambda k: F.coalesce(F.element_at(_book(rules, licensed), k), F.array().cast(_RULES))))
    met = F.concat(some(False), F.when(F.arrays_overlap("keys", F.array(F.lit("license"), F.lit("licence"))), some(True)).otherwise(F.array().cast(_RULES)))
    places = F.flatten(F.transform(met, lambda r: _places(F.col("line"), r)))
    none = F.array().cast(_FOUND)
    found = texts.select("doc_id", "n_words", F.when(F.size("keys") > 0, places).otherwise(none).alias("found"))
    found = _unsuppressed(found).withColumn("base", F.filter("found", lambda x: x["base"]))
    starts, labels = F.transform("base", lambda x: x["first"]), F.transform("base", lambda x: x["label"])
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"), joined(labels).alias("base_labels"),
        joined(F.concat(labels, F.transform("detections", lambda x: x["label"]))).alias("labels"), F.coalesce(F.array_max(F.transform("detections", lambda x: x["weight"])), F.lit(0.0)).alias("score"), "detections",
    )


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB: what scan() returns without `detections`."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ",\n".join(f"({i}, {q(r.label)}, {q(r.keyword)}, {r.licensed}, {q(r.regex)}, {r.priority}, {r.base}, CAST({_WEIGHTS[r.priority]} AS DOUBLE))" for i, r in enumerate(rules))
    return f"""
WITH rules(rule, label, keyword, licensed, regex, priority, base, weight) AS (VALUES {rows}),
t AS (SELECT row_number() OVER () AS r, doc_id, trim(regexp_replace(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{SEPARATORS}', ' ', 'g')) AS t FROM documents),
l AS (SELECT r, doc_id, ' ' || replace(t, ' ', '  ') || ' ' AS line, CAST(CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS BIGINT) AS n_words FROM t),
hit AS (SELECT r, rule, label, priority, base, weight, regexp_extract_all(line, regex) AS ms, string_split_regex(line, regex) AS gs
        FROM l JOIN rules ON contains(line, ' ' || keyword || ' ') AND (NOT licensed OR contains(line, ' license ') OR contains(line, ' licence ')) WHERE regexp_matches(line, regex)),
p AS (SELECT r, rule, label, priority, base, weight, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g FROM hit),
c AS (SELECT *, (length(m) - length(replace(m, ' ', ''))) // 2 AS n, (length(g) - length(replace(g, ' ', ''))) // 2 AS b FROM p),
d AS (SELECT *, CAST(sum(b + n) OVER (PARTITION BY r, rule ORDER BY i) AS BIGINT) AS last, last - n AS first FROM c),
k AS (SELECT * FROM d AS x WHERE NOT EXISTS (SELECT 1 FROM d AS y WHERE y.r = x.r AND y.first <= x.first AND y.last >= x.last AND y.priority <= x.priority
        AND (y.first < x.first OR y.last > x.last OR y.priority < x.priority OR y.rule < x.rule))),
a AS (SELECT r, label FROM d WHERE base UNION SELECT r, label FROM k),
ls AS (SELECT r, string_agg(label, ',' ORDER BY label) AS labels FROM a GROUP BY r),
ks AS (SELECT r, max(weight) AS score FROM k GROUP BY r),
bs AS (SELECT r, count(*) AS n_base, min(first) AS first_word, max(first) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM d WHERE base GROUP BY r)
SELECT doc_id, n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM l LEFT JOIN bs USING (r) LEFT JOIN ls USING (r) LEFT JOIN ks USING (r)
"""
