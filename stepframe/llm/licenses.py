"""License scans by sentence rules, with built-in column functions only.

A text is normalised (lower case, letters and digits only) with a mark wherever a sentence may end. Known licence
sentences are found from mark to mark and mapped to identifiers; marks inside a longer one do not matter, as a colon, an
empty line or a line wrap in its midst sets one, too. The sequence of identifiers of a document is then matched against ordered rules: a
rule is a sequence of identifiers; the first rule of the list that matches takes its identifiers, and the rest is
offered to the next rules. Identifiers that no rule takes are reported as open.

Every known sentence holds one of ``CUES``; a text without a cue is not looked at further. Work is per row, without a
shuffle.

Nulls: a null text has no sentences. Empty and very long texts are scanned like others; a licence that stands
several times is reported once with its count. Repeated rows give repeated results, an empty table an empty one.
Result columns replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import aside, back, let

# fixed values: what a notice may call the work; licence families by the name in their notices, and their versions
_WORKS = ["program", "library", "software", "file"]
_FAMILIES = {"GPL": ("gnu general public license", ["2", "3"]), "LGPL": ("gnu lesser general public license", ["2.1", "3"]), "LibraryGPL": ("gnu library general public license", ["2"]), "AGPL": ("gnu affero general public license", ["3"])}


def _versions() -> dict[str, list[str]]:
    """Sentences that make a work free software, by family, version, and whether later versions may be chosen."""
    out = {}
    for family, (name, versions) in _FAMILIES.items():
        for v in versions:
            number = v.replace(".", " ")
            begin = [f"this {x} is free software you can redistribute it and or modify it under the terms of the {name}" for x in _WORKS]
            by = "as published by the free software foundation"
            out[f"{family}{v}Later"] = [f"{x} {by} either version {number} of the license or at your option any later version" for x in begin]
            only = [f"{by} version {number} of the license", f"{by} version {number}", f"version {number} {by}", f"version {number} only {by}", f"{by} version {number} only"]
            out[f"{family}{v}Only"] = [f"{x} {rest}" for x in begin for rest in only]
    return out


# fixed values: known licence sentences, normalised, by identifier
SENTENCES = {
    **_versions(),
    "ApacheLine": ["licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license"],
    "ApacheCompliance": ["you may not use this file except in compliance with the license"],
    "ApacheCopy": [f"you may obtain a copy of the license at {scheme} www apache org licenses license 2 0" for scheme in ("http", "https")],
    "ApacheBasis": [
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"
    ],
    "ApacheLimits": ["see the license for the specific language governing permissions and limitations under the license"],
    "MITLine": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "mit license", "the mit license"],
    "MITGrant": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
    ],
    "MITNotice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "MITAsIs": [
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
    ],
    "BSDLine": ["licensed under the bsd license", "released under the bsd license", "licensed under the 3 clause bsd license"],
    "BSDGrant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "GPL3Line": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3"],
    "GPLHope": [f"this {x} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose" for x in _WORKS],
    "GPLDetails": ["see the gnu general public license for more details"],
    "LGPLDetails": [f"see the gnu {x} general public license for more details" for x in ("lesser", "library")],
    "AGPLDetails": ["see the gnu affero general public license for more details"],
    "MPL2Subject": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "MPL2Copy": [f"if a copy of the mpl was not distributed with this file you can obtain one at {scheme} mozilla org mpl 2 0" for scheme in ("http", "https")],
    "ISCGrant": [
        f"permission to use copy modify {x} distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"
        for x in ("and", "and or")
    ],
    "ISCAsIs": [
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"
    ],
    "ISCDamages": [
        "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
    ],
    "BSDSource": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "BSDBinary": [
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
    ],
    "BSDEndorse": [
        f"neither the name of the {x} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
        for x in ("copyright holder", "copyright holders", "organization", "university")
    ],
    "CCBYNC4Line": ["licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0"],
    "CCBY4Line": ["licensed under cc by 4 0", "this work is licensed under cc by 4 0"],
    "CCBYSA4Line": ["licensed under cc by sa 4 0", "this work is licensed under cc by sa 4 0"],
    "CC0Line": ["this work is dedicated to the public domain", "released into the public domain", "this is free and unencumbered software released into the public domain"],
    "AllRights": ["all rights reserved"],
}
# fixed values: sentence openings whose rest varies
OPENINGS = {"Copyright": r"^copyright (c )?[0-9]{4}\b", "SpdxLine": r"^spdx license identifier [a-z0-9]"}
# fixed values: licences of the GNU family, their sentence without the scope, and the pointer to details
_GNU = [
    ("GPL-2.0", "GPL2", "GPLDetails"),
    ("GPL-3.0", "GPL3", "GPLDetails"),
    ("LGPL-2.0", "LibraryGPL2", "LGPLDetails"),
    ("LGPL-2.1", "LGPL2.1", "LGPLDetails"),
    ("LGPL-3.0", "LGPL3", "LGPLDetails"),
    ("AGPL-3.0", "AGPL3", "AGPLDetails"),
]
# fixed values: rules in order, longer ones first; licence, kind, identifiers
RULES = [
    ("Apache-2.0", "permissive", ["ApacheLine", "ApacheCompliance", "ApacheCopy", "ApacheBasis", "ApacheLimits"]),
    ("MIT", "permissive", ["MITLine", "Copyright", "MITGrant", "MITNotice", "MITAsIs"]),
    ("MIT", "permissive", ["MITGrant", "MITNotice", "MITAsIs"]),
    ("ISC", "permissive", ["ISCGrant", "ISCAsIs", "ISCDamages"]),
    ("ISC", "permissive", ["ISCGrant"]),
    ("MPL-2.0", "copyleft", ["MPL2Subject", "MPL2Copy"]),
    ("MPL-2.0", "copyleft", ["MPL2Subject"]),
    *[
        (f"{spdx}-{scope}", "copyleft", [f"{free}{kind}", *rest])
        for spdx, free, details in _GNU
        for scope, kind in (("or-later", "Later"), ("only", "Only"))
        for rest in (["GPLHope", details], [])
    ],
    ("BSD-3-Clause", "permissive", ["BSDLine", "BSDGrant", "BSDSource", "BSDBinary", "BSDEndorse"]),
    ("BSD-3-Clause", "permissive", ["BSDGrant", "BSDSource", "BSDBinary", "BSDEndorse"]),
    ("BSD-2-Clause", "permissive", ["BSDGrant", "BSDSource", "BSDBinary"]),
    ("BSD-3-Clause", "permissive", ["BSDLine", "BSDGrant"]),
    ("BSD", "permissive", ["BSDGrant"]),
    ("BSD", "permissive", ["BSDLine"]),
    ("Apache-2.0", "permissive", ["ApacheLine"]),
    ("MIT", "permissive", ["MITLine"]),
    ("GPL-3.0-only", "copyleft", ["GPL3Line"]),
    ("CC-BY-NC-4.0", "noncommercial", ["CCBYNC4Line"]),
    ("CC-BY-SA-4.0", "copyleft", ["CCBYSA4Line"]),
    ("CC-BY-4.0", "permissive", ["CCBY4Line"]),
    ("CC0-1.0", "permissive", ["CC0Line"]),
    ("SPDX", "named", ["SpdxLine"]),
    ("Proprietary", "restricted", ["Copyright", "AllRights"]),
]
# fixed values: every known sentence or opening holds one of these
CUES = ["licen", "copyright", "permission", "redistribut", r"public\W+domain", "warrant", r"free\W+software", r"rights\W+reserved", "mozilla", "liable"]
#: sentences may end after these marks before white space, at empty lines, and before lines that open a known sentence
_ENDS = r"(?<=[.!?:;])[\s\p{Z}]+|\n[ \t]*\r?\n|\n(?=[ \t#*/;-]*(?i:licensed|released|this|permission|copyright|spdx|redistribution|the|you|unless|see|mit|all)\b)"


#: known sentences of fewer words hold no mark
_LONG = 5


def _found_pattern() -> str:
    """Known sentences and openings, longest first, in a text as ``_marked`` gives it."""
    inside = r"(?: \|)? "
    texts = sorted((t for texts in SENTENCES.values() for t in texts), key=len, reverse=True)
    known = [inside.join(t.split()) if t.count(" ") + 1 >= _LONG else t for t in texts]
    opened = [p.removeprefix("^").replace(" ", inside).replace(f"c{inside})?", "c )?") + "[^|]*" for p in OPENINGS.values()]
    return r"\| (?:" + "|".join([*known, *opened]) + r")(?= \|)"


def _marked(text: Column) -> Column:
    """Words in lower case, with ``|`` wherever a sentence may begin or end."""
    ends = F.regexp_replace(F.translate(text, "|", ","), _ENDS, "|")
    words = F.regexp_replace(F.lower(ends), "[^a-z0-9|]+", " ")
    return F.regexp_replace(F.concat(F.lit("|"), words, F.lit("|")), r" ?\|[ |]*", " | ")


def sentence_id(sentence: Column) -> Column:
    """Identifier of a sentence, or null."""
    known = F.create_map(*[F.lit(x) for name, texts in SENTENCES.items() for t in texts for x in (t, name)])

    def of(s: Column) -> Column:
        out = F.try_element_at(known, s)
        for name, pattern in OPENINGS.items():
            out = F.coalesce(out, F.when(s.rlike(pattern), F.lit(name)))
        return out

    return let(F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " ")), of)


def _has_cue(text: Column) -> Column:
    return F.lower(text).rlike("|".join(CUES))


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text in order."""
    found = F.filter(F.transform(F.regexp_extract_all(_marked(text), F.lit(_found_pattern()), F.lit(0)), sentence_id), lambda x: x.isNotNull())
    return F.when(_has_cue(text), found).otherwise(F.array().cast("array<string>"))


def match_rules(ids: Column) -> Column:
    """``struct(licenses array<struct<license, kind, times>>, open array<string>)`` of a sequence of identifiers.

    The sequence is written as ``,A,,B,``; a rule takes its stretch and leaves ``,,`` so that what stood before and
    after it does not become neighbours.
    """
    line = F.array_join(F.transform(ids, lambda x: F.concat(F.lit(","), x, F.lit(","))), "")
    begin = F.struct(line.alias("line"), F.array().cast("array<struct<license:string,kind:string,times:int>>").alias("licenses"))
    rules = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(kind).alias("kind"), F.lit("".join(f",{x}," for x in seq)).alias("seq")) for name, kind, seq in RULES])

    def step(now: Column, rule: Column) -> Column:
        after = F.replace(now["line"], rule["seq"], F.lit(",,"))
        times = ((F.length(now["line"]) - F.length(after)) / (F.length(rule["seq"]) - 2)).cast("int")
        hit = F.struct(rule["license"].alias("license"), rule["kind"].alias("kind"), times.alias("times"))
        return F.struct(after.alias("line"), F.when(times > 0, F.concat(now["licenses"], F.array(hit))).otherwise(now["licenses"]).alias("licenses"))

    done = F.aggregate(rules, begin, step)
    return let(done, lambda d: F.struct(d["licenses"].alias("licenses"), F.filter(F.split(d["line"], ","), lambda x: x != "").alias("open")))


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``sentence_ids``, ``licenses`` (in the order of the rules) and ``open_ids``."""
    own, to = aside(docs, "scan")
    found = own.withColumn("sentence_ids", sentence_ids(F.coalesce(F.col(text), F.lit(""))))
    scanned = found.withColumn("scan", F.when(F.size("sentence_ids") > 0, match_rules(F.col("sentence_ids"))))
    licenses = F.coalesce("scan.licenses", F.array().cast("array<struct<license:string,kind:string,times:int>>"))
    scanned = scanned.withColumns({"licenses": licenses, "open_ids": F.coalesce("scan.open", F.array().cast("array<string>"))})
    results = ["sentence_ids", "licenses", "open_ids"]
    return back(scanned, [*[c for c in docs.columns if c.lower() not in results], *results], to)
