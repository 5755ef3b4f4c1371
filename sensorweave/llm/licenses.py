"""License scans by ordered signature rules, in DataFrame operations only.

A text is taken as its words, lower-cased, one space apart.  Rules are regular expressions over that
string, each with a label, a keyword, a priority and a weight.  Only texts that hold a rule's keyword
among their words meet its expression.  Of overlapping detections, one that lies within another of
higher priority (or of equal priority and more words) is suppressed; base rules always count.

The rules come from lists of license families, versions and ways of naming them.  A scan is one pass
without a shuffle: rules are applied inside a row, whatever the number of its detections.

Defined results: a null, empty or wordless text has no detection (null first_word and last_word, empty
labels, score 0); texts of any length are scanned whole; repeated rows are scanned each; of like
detections (equal label, place, priority and weight) one is kept; other columns, whatever their names,
are left out by ``scan``, while ``detections`` keeps them but for ``n_words`` and ``found``, which it sets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorweave.llm.decontaminate import words


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: str
    priority: int
    weight: float
    base: bool = False


#: The phrases that every scan reports, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
_BASE_KEYWORDS = {"mit": "license", "apache-2": "apache", "cc-by-nc": "cc"}

_LATER = {"": "", " or later": "-or-later", " or any later version": "-or-later", " only": "-only"}

#: Tails of short names: "gpl 2 or later".
_TAILS = {"-or-later": "or (?:any )?(?:later|newer|greater|above)(?: versions?)?", "-only": "only"}

#: Words by which a line or sentence says that what follows is a license.
_FIELD = "(?:licen[cs]ed?|licen[cs]es|licen[cs]ing) (?:(?:is|type|name|under|by|the|a|terms|of) ){0,4}"
#: A name that no version follows.
_UNVERSIONED = "(?! (?:version |v ?)?[0-9])"
_RELEASED = "(?:released|distributed|available|published|provided|licen[cs]ed) under (?:the )?(?:terms of )?(?:the )?"

#: Addresses at which licenses are published: label, keyword, pattern.
ADDRESSES = [
    ("mit", "opensource", "opensource org licenses? (?:alphabetical )?mit"),
    ("isc", "opensource", "opensource org licenses? isc"),
    ("zlib", "opensource", "opensource org licenses? zlib"),
    ("bsd-2-clause", "opensource", "opensource org licenses? bsd 2 clause"),
    ("bsd-3-clause", "opensource", "opensource org licenses? bsd 3 clause"),
    ("bsd", "opensource", "opensource org licenses? bsd"),
    ("0bsd", "opensource", "opensource org licenses? 0bsd"),
    ("apache-2", "opensource", "opensource org licenses? apache 2 0"),
    ("gpl-2", "opensource", "opensource org licenses? gpl 2 0"),
    ("gpl-3", "opensource", "opensource org licenses? gpl 3 0"),
    ("lgpl-2-1", "opensource", "opensource org licenses? lgpl 2 1"),
    ("lgpl-3", "opensource", "opensource org licenses? lgpl 3 0"),
    ("agpl-3", "opensource", "opensource org licenses? agpl 3 0"),
    ("mpl-2", "opensource", "opensource org licenses? mpl 2 0"),
    ("epl-1", "opensource", "opensource org licenses? epl 1 0"),
    ("epl-2", "opensource", "opensource org licenses? epl 2 0"),
    ("cddl-1", "opensource", "opensource org licenses? cddl 1 0"),
    ("artistic-2", "opensource", "opensource org licenses? artistic 2 0"),
    ("ms-pl", "opensource", "opensource org licenses? ms pl"),
    ("unlicense", "opensource", "opensource org licenses? unlicense"),
    ("postgresql", "opensource", "opensource org licenses? postgresql"),
    ("ncsa", "opensource", "opensource org licenses? ncsa"),
    ("apache-2", "apache", "apache org licenses license 2 0"),
    ("apache-1-1", "apache", "apache org licenses license 1 1"),
    ("apache-1", "apache", "apache org licenses license 1 0"),
    ("mpl-2", "mozilla", "mozilla org (?:en us )?mpl 2 0"),
    ("mpl-1-1", "mozilla", "mozilla org mpl mpl 1 1"),
    ("epl-1", "eclipse", "eclipse org legal epl v10"),
    ("epl-2", "eclipse", "eclipse org legal epl (?:2 0|v20)"),
    ("unlicense", "unlicense", "unlicense org"),
    ("bsl-1", "boost", "boost org license 1 0"),
    ("wtfpl", "wtfpl", "wtfpl net"),
    ("ofl", "sil", "scripts sil org ofl"),
    ("odbl-1", "opendatacommons", "opendatacommons org licenses odbl(?: 1 0)?"),
    ("cc0-1-0", "creativecommons", "creativecommons org publicdomain zero 1 0"),
    ("cc-pddc", "creativecommons", "creativecommons org (?:publicdomain mark 1 0|licenses publicdomain)"),
    ("gpl", "gnu", "gnu org (?:copyleft|licenses) gpl"),
    ("lgpl", "gnu", "gnu org (?:copyleft|licenses) (?:lgpl|lesser)"),
    ("agpl", "gnu", "gnu org licenses agpl"),
    ("gfdl", "gnu", "gnu org (?:copyleft|licenses) fdl"),
]

#: Short forms in use: label, keyword, pattern.
SHORT = [
    ("apache-2", "apache", "apache (?:licen[cs]e )?2 0(?! (?:server|httpd|web|module|handler|config))"),
    ("apache-2", "apache", "apache (?:licen[cs]e )?(?:version |v ?)2(?: 0)?(?! (?:server|httpd|web|module|handler|config))"),
    ("apache-2", "apache", "(?:under|licen[cs]ed?) (?:the )?apache 2(?: 0)?"),
    ("apache-2", "apache", "apache 2 licen[cs]ed?"),
    ("apache-2", "apachev2", "apachev2"),
    ("apache-2", "apache2", "(?:under|licen[cs]ed?) (?:the )?apache2"),
    ("apache-2", "asl", "asl 2 0"),
    ("mit", "mit", "mit licen[cs]ed"),
    ("mit", "mit", "mit or apache"),
    ("mit", "mit", "apache 2 0 or mit"),
    ("mit", "mit", "mit x11 licen[cs]e"),
    ("mit", "expat", "licen[cs]e expat"),
    ("isc", "isc", "isc licen[cs]ed"),
    ("bsd", "bsd", "bsd licen[cs]ed"),
    ("bsd", "bsd", "bsd style licen[cs]e"),
    ("bsd-3-clause", "bsd", "(?:new|modified|revised) bsd licen[cs]e"),
    ("bsd-2-clause", "bsd", "simplified bsd licen[cs]e"),
    ("bsd-4-clause", "bsd", "(?:original|old) bsd licen[cs]e"),
    ("gpl", "gpl", "gpl licen[cs]ed?"),
    ("lgpl", "lgpl", "lgpl licen[cs]ed?"),
    ("agpl", "agpl", "agpl licen[cs]ed?"),
    ("gpl", "copyleft", "gnu copyleft"),
    ("unlicense", "unlicense", "licen[cs]ed? (?:under )?(?:the )?unlicense"),
    ("cc0-1-0", "cc0", "cc0 1 0 universal"),
    ("cc0", "creative", "creative commons zero"),
    ("cc-pddc", "domain", "(?:placed|released) (?:in|into) the public domain"),
    ("proprietary", "proprietary", "licen[cs]e proprietary"),
    ("proprietary", "unlicensed", "licen[cs]e unlicensed"),
]

#: Sentences by which the texts and notices of licenses are known: label, keyword, pattern.
TEXTS = [
    ("mit", "hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("isc", "hereby", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("0bsd", "hereby", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("bsd-3-clause", "endorse", "neither the names? of (?:[^ ]+ ){1,12}?may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice"),
    ("apache-2", "compliance", "you may not use this file except in compliance with the license"),
    ("apache-2", "apache", "apache license version 2 0 january 2004"),
    ("apache-1-1", "apache", "this product includes software developed by the apache software foundation"),
    ("gpl", "redistribute", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "redistribute", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("gpl", "verbatim", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("agpl", "prominently", "your modified version must prominently offer all users interacting with it remotely through a computer network"),
    ("gfdl", "gnu", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-2", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1-1", "mozilla", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cddl", "license", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("zlib", "warranty", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("bsl-1", "hereby", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("ofl", "sil", "this font software is licensed under the sil open font license"),
    ("postgresql", "hereby", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("ncsa", "sublicense", "to deal with the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense"),
    ("cc0", "waived", "waived all copyright and related or neighboring rights"),
    ("cc0", "dedicated", "this work has been marked as dedicated to the public domain"),
    ("x11", "advertising", "shall not be used in advertising or otherwise to promote the sale use or other dealings in this software"),
    ("python-2", "python", "psf is making python available to licensee on an as is basis"),
    ("openssl", "openssl", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("proprietary", "unauthorized", "unauthorized copying of this file via any medium is strictly prohibited"),
    ("all-rights-reserved", "reproduced", "no part of this (?:publication|document|work) may be reproduced"),
]


def _versioned(names: dict[str, list[str]], versions: list[str], forms: list[str]) -> list[tuple[str, str]]:
    """(label, pattern) for each name, version and form."""
    out = []
    for family, spoken in names.items():
        for name in spoken:
            for version in versions:
                said = version.replace(".", " ") if not version.endswith(".0") else f"{version[:-2]}(?: 0)?"
                for form in forms:
                    out.append((f"{family}-{version.removesuffix('.0').replace('.', '-')}", form.format(n=name, v=said)))
    return out


def _short(name: str, version: str) -> str:
    """Short forms of a name and version.  A whole number alone is a version only where words about licenses stand by it."""
    if not version.endswith(".0"):
        return f"{name} (?:version |v ?)?{version.replace('.', ' ')}"
    n = version[:-2]
    return f"(?:{name} (?:version |v ?){n}(?: 0)?|{name} {n} 0|(?:under|licen[cs]ed?|gnu) (?:the )?(?:gnu )?{name} {n}|{name} {n} (?:licen[cs]ed?|compatible))"


def _notices(label: str, spoken: str, version: str) -> list[Rule]:
    """The notice by which the free licenses are put on a program, with and without later versions."""
    said = version.replace(".", " ") if not version.endswith(".0") else f"{version[:-2]}(?: 0)?"
    program = "(?:this (?:[^ ]+ ){1,3}?is free software you can redistribute it and or modify it )?"
    named = f"{program}under the terms of (?:version {said} of the {spoken}|the {spoken}(?: as published by the free software foundation)? (?:either )?version {said})(?: as published by the free software foundation)?(?: either)?(?: of the licen[cs]e)?"
    return [Rule(f"{label}-or-later", "gnu", f"{named} or (?:at your option )?(?:any )?later(?: version)?", 50, 1.0), Rule(label, "gnu", named, 45, 1.0), Rule(f"{label}-only", "gnu", f"{named} only", 50, 1.0)]


def _identifier(label: str) -> str:
    """The words of a label as an identifier says them: a lone whole version may have a zero after it."""
    said = label.split("-")
    numbers = [x for x in said if x.isdigit()]
    return " ".join(f"{x}(?: 0)?" if x.isdigit() and len(numbers) == 1 else x for x in said)


def build_rules() -> list[Rule]:
    """All rules, the most specific ones first."""
    found: list[Rule] = [Rule(label, _BASE_KEYWORDS[label], phrase, 0, 0.9, True) for phrase, label in BASE.items()]
    gnu = {"gpl": ["gnu general public license", "gnu gpl"], "lgpl": ["gnu lesser general public license", "gnu library general public license", "gnu lgpl"], "agpl": ["gnu affero general public license", "gnu agpl"], "gfdl": ["gnu free documentation license"]}
    gnu_versions = {"gpl": ["1.0", "2.0", "3.0"], "lgpl": ["2.0", "2.1", "3.0"], "agpl": ["1.0", "3.0"], "gfdl": ["1.1", "1.2", "1.3"]}
    for family, names in gnu.items():
        for label, pattern in _versioned({family: names}, gnu_versions[family], ["{n}(?: as published by the free software foundation)? (?:either )?version {v}", "{n} v ?{v}"]):
            for suffix, tail in _LATER.items():
                found.append(Rule(label + tail, "gnu", pattern + suffix, 40 if tail else 30, 1.0))
        for name in names:
            found.append(Rule(family, "gnu", name, 10, 0.8))
        for version in gnu_versions[family]:
            label, joined = f"{family}-{version.removesuffix('.0').replace('.', '-')}", f"{family}v{version.split('.')[0]}"
            rest = "(?: 0)?" if version.endswith(".0") else f" {version.split('.')[1]}"
            whole = f"{family} (?:version |v ?)?{version.split('.')[0]}{rest}"
            found += [Rule(label, joined, f"{joined}{rest}", 30, 0.9), Rule(label, family, _short(family, version), 30, 0.9)]
            found += [Rule(label + tail, keyword, f"{pattern} {said}", 40, 1.0) for tail, said in _TAILS.items() for keyword, pattern in ((joined, f"{joined}{rest}"), (family, whole))]
            found.append(Rule(label, "gnu", f"gnu org licenses (?:old licenses )?{'fdl' if family == 'gfdl' else family} {version.replace('.', ' ')}", 30, 0.9))
            if family != "gfdl":
                found += [rule for name in names if name.endswith("license") for rule in _notices(label, name, version)]
    parts = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?"}
    for kind in (["by"], ["by", "sa"], ["by", "nc"], ["by", "nd"], ["by", "nc", "sa"], ["by", "nc", "nd"]):
        label, long = "cc-" + "-".join(kind), " ".join(parts[k] for k in kind)
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            said = version.replace(".", " ")
            found.append(Rule(f"{label}-{version.replace('.', '-')}", "cc", f"cc {' '.join(kind)} {said}", 30 + len(kind), 1.0))
            found.append(Rule(f"{label}-{version.replace('.', '-')}", "creative", f"creative commons {long} (?:(?:international|generic|unported|licen[cs]e) )?{said}", 30 + len(kind), 1.0))
            found.append(Rule(f"{label}-{version.replace('.', '-')}", "creativecommons", f"creativecommons org licenses? {' '.join(kind)} {said}", 30 + len(kind), 1.0))
        found += [Rule(label, "cc", f"cc {' '.join(kind)}", 10 + len(kind), 0.8), Rule(label, "creative", f"creative commons {long}", 10 + len(kind), 0.8)]
    found += [Rule("cc0-1-0", "cc0", "cc0(?: 1 0)?", 20, 0.9), Rule("cc-pddc", "public", "dedicated to the public domain", 20, 0.7)]
    plain = {"apache": (["apache software license", "apache license"], ["1.0", "1.1", "2.0"]), "mpl": (["mozilla public license"], ["1.0", "1.1", "2.0"]), "epl": (["eclipse public license"], ["1.0", "2.0"]), "cddl": (["common development and distribution license"], ["1.0", "1.1"]),
             "eupl": (["european union public licen[cs]e"], ["1.0", "1.1", "1.2"]), "artistic": (["artistic license"], ["1.0", "2.0"]), "osl": (["open software license"], ["1.0", "2.0", "2.1", "3.0"]), "afl": (["academic free license"], ["1.1", "1.2", "2.0", "2.1", "3.0"]),
             "cpl": (["common public license"], ["1.0"]), "zpl": (["zope public license"], ["1.1", "2.0", "2.1"]), "php": (["php license"], ["3.0", "3.01"]), "lppl": (["latex project public license"], ["1.0", "1.1", "1.2"]), "odbl": (["open database license"], ["1.0"]), "ofl": (["sil open font license"], ["1.0", "1.1"]), "bsl": (["boost software license"], ["1.0"]), "cecill": (["cecill"], ["1.0", "2.0", "2.1"])}
    for family, (names, versions) in plain.items():
        for name in names:
            keyword = name.split()[0]
            for label, pattern in _versioned({family: [name]}, versions, ["{n},? version {v}", "{n} v ?{v}", "{n} {v}"]):
                found.append(Rule(label, keyword, pattern, 30, 1.0))
            found.append(Rule(family, keyword, name, 10, 0.8))
    for family in ("mpl", "epl", "cddl", "eupl", "osl", "afl", "cpl", "lppl", "odbl", "ofl"):  # acronyms in use
        for version in plain[family][1]:
            found.append(Rule(f"{family}-{version.removesuffix('.0').replace('.', '-')}", family, _short(family, version), 30, 0.9))
        found += [Rule(family, family, f"(?:under|by) (?:the )?(?:terms of the )?{family}{_UNVERSIONED}", 10, 0.8), Rule(family, family, f"{family} licen[cs]ed?", 10, 0.8)]
    found += [Rule(label, keyword, pattern, 40, 0.9) for label, keyword, pattern in TEXTS]
    found += [Rule(label, keyword, pattern, 15 if label.isalpha() else 30, 0.9) for label, keyword, pattern in ADDRESSES + SHORT]
    for family in ("mit", "isc", "bsd", "zlib", "apache", "gpl", "lgpl", "agpl", "gfdl", "mpl", "epl", "cddl", "eupl", "wtfpl", "unlicense", "ncsa", "x11", "cc0"):
        found += [Rule(family, family, f"{said}{family}{_UNVERSIONED}", 10, 0.7) for said in (_FIELD, _RELEASED)]
    for count, word in (("0", "zero"), ("1", "one"), ("2", "two"), ("3", "three"), ("4", "four")):
        found += [Rule(f"bsd-{count}-clause", "bsd", f"bsd {count} clause", 30, 1.0), Rule(f"bsd-{count}-clause", "bsd", f"{count} clause bsd(?: licen[cs]e)?", 30, 1.0), Rule(f"bsd-{count}-clause", "bsd", f"{word} clause bsd(?: licen[cs]e)?", 30, 1.0)]
    found += [Rule("bsd", "bsd", "bsd licen[cs]e", 10, 0.8), Rule("bsd-2-clause", "freebsd", "freebsd licen[cs]e", 30, 0.9), Rule("bsd-3-clause", "redistribution", "redistribution and use in source and binary forms", 10, 0.7)]
    single = {"mit": ["mit licen[cs]e", "licen[cs]ed under mit", "expat licen[cs]e"], "isc": ["isc licen[cs]e"], "zlib": ["zlib licen[cs]e"], "unlicense": ["the unlicense"], "wtfpl": ["wtfpl"], "x11": ["x11 licen[cs]e"], "postgresql": ["postgresql licen[cs]e"], "python-2": ["python software foundation licen[cs]e"], "ms-pl": ["microsoft public licen[cs]e"], "ms-rl": ["microsoft reciprocal licen[cs]e"], "vim": ["vim licen[cs]e"], "ncsa": ["ncsa open source licen[cs]e"], "beerware": ["beerware licen[cs]e"], "openssl": ["openssl licen[cs]e"], "curl": ["curl licen[cs]e"], "ruby": ["ruby licen[cs]e"]}
    for label, patterns in single.items():
        for pattern in patterns:
            if "licen[cs]e" in pattern and label in ("mit",):
                keywords = ["licensed", "licenced"] if "ed under" in pattern else ["license", "licence"]
            else:
                keywords = [pattern.split()[-1] if label in ("unlicense", "wtfpl") else pattern.split()[0]]
            found += [Rule(label, k, pattern, 10, 0.8) for k in keywords]
    for label, spoken in (("all-rights-reserved", "all rights reserved"), ("proprietary", "proprietary and confidential")):
        found.append(Rule(label, spoken.split()[-1], spoken, 5, 0.5))
    spdx = sorted({r.label for r in found if not r.base})
    found += [Rule(label, "spdx", f"spdx licen[cs]e identifier {_identifier(label)}", 60, 1.0) for label in spdx]
    return sorted(dict.fromkeys(found), key=lambda r: (-r.priority, r.label, r.pattern, r.keyword))


def _by_keyword(rules: list[Rule]) -> Column:
    """The rules as a constant map from a keyword to its rules."""

    def quoted(r: Rule) -> str:
        return f"named_struct('label','{r.label}','keyword','{r.keyword}','pattern','(?<= )(?:{r.pattern})(?= )','priority',{r.priority},'weight',{r.weight}D,'base',{str(r.base).lower()})"

    groups: dict[str, list[Rule]] = {}
    for r in rules:
        groups.setdefault(r.keyword, []).append(r)
    return F.expr("map(" + ",".join(f"'{k}',array({','.join(map(quoted, held))})" for k, held in groups.items()) + ")")


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _places(rule: Column, joined: Column) -> Column:
    """The detections of one rule: label, first word, word after the last, priority, weight, base."""
    parts = F.split(joined, rule["pattern"], -1)
    # every match follows a part; words before it are the spaces before it, less the leading one
    matches = F.regexp_extract_all(joined, rule["pattern"], F.lit(0))
    start = F.struct(F.lit(-1).alias("spaces"), F.array().cast("array<struct<a:int,b:int>>").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        before = acc["spaces"] + _spaces(x["part"])
        size = _spaces(x["match"])
        return F.struct((before + size).alias("spaces"), F.concat(acc["found"], F.array(F.struct(before.alias("a"), (before + size + 1).alias("b")))).alias("found"))

    pairs = F.zip_with(F.slice(parts, 1, F.size(matches)), matches, lambda p, m: F.struct(p.alias("part"), m.alias("match")))
    found = F.aggregate(pairs, start, step)["found"]
    return F.transform(found, lambda x: F.struct(rule["label"].alias("label"), x["a"].alias("a"), x["b"].alias("b"), rule["priority"].alias("priority"), rule["weight"].alias("weight"), rule["base"].alias("base")))


def detections(df: DataFrame, text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """Adds ``n_words`` and ``found``: the array of detections (label, a, b, priority, weight, base), suppressed ones left out."""
    rules = build_rules() if rules is None else rules
    keywords = F.array(*[F.lit(k) for k in sorted({r.keyword for r in rules})])
    none = F.array().cast("array<struct<label:string,a:int,b:int,priority:int,weight:double,base:boolean>>")
    df = df.withColumn("_words", words(text)).withColumn("_keys", F.array_intersect("_words", keywords))
    df = df.withColumn("_joined", F.when(F.size("_keys") > 0, F.concat(F.lit(" "), F.array_join("_words", " "), F.lit(" "))))
    due = F.flatten(F.transform("_keys", lambda k: F.element_at(_by_keyword(rules), k)))
    df = df.withColumn("_all", F.when(F.size("_keys") > 0, F.array_distinct(F.flatten(F.transform(due, lambda r: _places(r, F.col("_joined")))))).otherwise(none))

    def suppressed(x: Column) -> Column:
        return F.exists("_all", lambda y: (y["a"] <= x["a"]) & (y["b"] >= x["b"]) & ((y["priority"] > x["priority"]) | ((y["priority"] == x["priority"]) & (y["b"] - y["a"] > x["b"] - x["a"]))))

    found = F.when(F.size("_all") == 0, none).otherwise(F.filter("_all", lambda x: x["base"] | ~suppressed(x)))
    return df.withColumn("n_words", F.size("_words").cast("long")).withColumn("found", found).drop("_words", "_keys", "_joined", "_all")


def scan(documents: DataFrame, key: str = "doc_id", text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """Per row: n_words, n_base, first_word, last_word, base_labels, labels, score, n_found."""
    df = detections(documents.select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_text", rules)
    base = F.filter("found", lambda x: x["base"])
    starts = F.transform(base, lambda x: x["a"].cast("long"))

    def labels(rows: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(rows, lambda x: x["label"]))), ",")

    return df.select(
        F.col("_key").alias(key), "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("found")).alias("labels"), F.coalesce(F.array_max(F.transform("found", lambda x: x["weight"])), F.lit(0.0)).alias("score"), F.size("found").cast("long").alias("n_found"),
    )
