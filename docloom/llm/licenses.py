r"""Licence recognition by sentence rules.  DataFrame functions only.

A text is lowered; comment leaders are stripped from its lines, the lines of a paragraph joined (a joint is
kept as ~), sentences cut at blank lines and at white space after . ! ? unless a digit follows, and each one normalised
to words of a-z and 0-9.  Known licence sentences have identifiers: a sentence of a grant is known by the words that every published
form of it has, as a whole or within a longer one; headings only as whole sentences or lines.

A sentence that names licences ("this file is licensed under either of A or B at your option", "the code is A licensed") is brought to a
form of its own: spellings of a name become one, what stands after the verb is cut at "or" and "and", and each part is looked up, longest
first, in a table of normalised names, NAMES.  All that are found count, each as the identifier ref:name.  A "not" before the verb
shuts the clause out.  Names that are common words count only beside the word licence.  SPDX-License-Identifier lines are read as expressions.

A document's identifiers, in order, are matched against the rules in order: a rule names a licence and the
sentences that must follow each other for it, others between them not counting; a ref names its licence by itself.  A licence is given
once, in the order of the rules, then of NAMES; a rule is shut out by the licences that it names as more specific, "all
rights reserved" by any other sentence.

Null and empty texts have no sentences.  Texts of any length are read whole; texts without any of the stems that every known sentence has (HINTS, taken from the
patterns themselves) need no cutting.  Repeated rows give repeated rows, an
empty table none.  Other columns stay as they are; those named like a result (n_license_sentences, sentence_ids, licenses) are replaced.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from docloom.functions import text

# Wording of public licences, normalised, as patterns; an identifier's pattern comes before those that it extends.
_GPL, _LGPL, _AGPL = r"gnu (?:general public licen[cs]e|gpl)", r"gnu (?:lesser|library) (?:general public licen[cs]e|gpl)", r"gnu affero (?:general public licen[cs]e|gpl)"
_FSF = " as published by the free software foundation either version {} of the license or at your option any later version"
SENTENCES = {
    "mit-grant": r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mit-notice": r"the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software",
    "as-is": r"(?:the|this) software is provided as is (?:and the author disclaims all warranties|without warranty of any kind)",
    "mit-title": r"\| (?:the )?(?:mit|expat) licen[cs]e(?: mit)? \|",
    "apache-title": r"apache license version 2 0 january 2004",
    "apache-head": r"\| (?:the )?apache(?: software)? licen[cs]e(?: version| v)? ?2(?: 0)? \|",
    "apache-may": r"you may not use this (?:file|work|software) except in compliance with the license",
    "apache-basis": r"distributed under the license is distributed on an as is basis",
    "agpl3-free": _AGPL + _FSF.format("3"),
    "agpl3-title": r"\| " + _AGPL + r" version 3 19 november 2007",
    "lgpl3-free": _LGPL + _FSF.format("3"),
    "lgpl21-free": _LGPL + _FSF.format("2 1"),
    "lgpl2-free": _LGPL + _FSF.format("2"),
    "lgpl3-title": r"\| " + _LGPL + r" version 3 29 june 2007",
    "lgpl21-title": r"\| " + _LGPL + r" version 2 1 february 1999",
    "gpl3-free": _GPL + _FSF.format("3"),
    "gpl2-free": _GPL + _FSF.format("2"),
    "gpl3-title": r"\| " + _GPL + r" version 3 29 june 2007",
    "gpl2-title": r"\| " + _GPL + r" version 2 june 1991",
    "gpl3-head": r"\| " + _GPL + r" (?:version |v)?3(?: 0)? \|",
    "gpl2-head": r"\| " + _GPL + r" (?:version |v)?2(?: 0)? \|",
    "gpl-hope": r"is distributed in the hope that it will be useful but without any warranty",
    "bsd-grant": r"redistribution and use in source and binary forms with or without modification are permitted",
    "bsd-source": r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer",
    "bsd-name": r"(?:neither the names? of|the names? of)(?: [a-z0-9]+){1,16}? may (?:not )?be used to endorse or promote products derived from this software",
    "bsd3-head": r"\| (?:the )?(?:3 clause bsd|bsd 3 clause|new bsd|modified bsd|revised bsd) licen[cs]e \|",
    "bsd2-head": r"\| (?:the )?(?:2 clause bsd|bsd 2 clause|simplified bsd|freebsd) licen[cs]e \|",
    "isc-grant": r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted",
    "isc-notice": r"provided that the above copyright notice and this permission notice appear in all copies",
    "zlib-grant": r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
    "zlib-origin": r"the origin of this software must not be misrepresented",
    "boost-grant": r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation",
    "unlicense-free": r"this is free and unencumbered software released into the public domain",
    "epl2-title": r"\| eclipse public license v(?:ersion)? ?2 0 \|",
    "mpl-form": r"this source code form is subject to the terms of the mozilla public license v ?2 0",
    "mpl-title": r"\| mozilla public license version 2 0 \|",
    "cc0-title": r"\| (?:creative commons )?cc0 1 0 universal",
    "gpl3-as": r"version 3 of the " + _GPL + r" as published by the free software foundation",
    "gpl2-as": r"version 2 of the " + _GPL + r" as published by the free software foundation",
    "reserved": r"all rights reserved",
    "spdx": r"spdx license identifier",
}
#: (licence, sentences in order, licences before it that shut it out; * is any)
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "as-is"], []),
    ("MIT", ["mit-title"], []),
    ("Apache-2.0", ["apache-title"], []),
    ("Apache-2.0", ["apache-head"], []),
    ("AGPL-3.0-only", ["agpl3-title"], []),
    ("AGPL-3.0-or-later", ["agpl3-free"], ["AGPL-3.0-only"]),
    ("LGPL-3.0-only", ["lgpl3-title"], []),
    ("LGPL-2.1-only", ["lgpl21-title"], []),
    ("LGPL-3.0-or-later", ["lgpl3-free"], ["LGPL-3.0-only"]),
    ("LGPL-2.1-or-later", ["lgpl21-free"], ["LGPL-2.1-only"]),
    ("LGPL-2.0-or-later", ["lgpl2-free"], []),
    ("GPL-3.0-only", ["gpl3-title"], []),
    ("GPL-2.0-only", ["gpl2-title"], []),
    ("GPL-3.0-or-later", ["gpl3-free", "gpl-hope"], ["GPL-3.0-only"]),
    ("GPL-3.0-or-later", ["gpl3-free"], ["GPL-3.0-only"]),
    ("GPL-2.0-or-later", ["gpl2-free"], ["GPL-2.0-only"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-name"], []),
    ("BSD-3-Clause", ["bsd3-head"], []),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"], ["BSD-3-Clause"]),
    ("BSD-2-Clause", ["bsd2-head"], []),
    ("ISC", ["isc-grant", "isc-notice"], []),
    ("0BSD", ["isc-grant"], ["ISC"]),
    ("Zlib", ["zlib-grant", "zlib-origin"], []),
    ("BSL-1.0", ["boost-grant"], []),
    ("Unlicense", ["unlicense-free"], []),
    ("EPL-2.0", ["epl2-title"], []),
    ("MPL-2.0", ["mpl-title"], []),
    ("MPL-2.0", ["mpl-form"], []),
    ("CC0-1.0", ["cc0-title"], []),
    ("GPL-3.0-only", ["gpl3-as"], ["GPL-3.0-or-later"]),
    ("GPL-2.0-only", ["gpl2-as"], ["GPL-2.0-or-later"]),
    ("Proprietary", ["reserved"], ["*"]),
]
#: names in SPDX expressions besides the licences' own: those that older files have
SPDX = {"GPL-2.0-only": ["GPL-2.0"], "GPL-2.0-or-later": ["GPL-2.0+"], "GPL-3.0-only": ["GPL-3.0"], "GPL-3.0-or-later": ["GPL-3.0+"], "LGPL-2.1-only": ["LGPL-2.1"], "LGPL-2.1-or-later": ["LGPL-2.1+"], "LGPL-3.0-only": ["LGPL-3.0"], "LGPL-3.0-or-later": ["LGPL-3.0+"], "AGPL-3.0-only": ["AGPL-3.0"], "AGPL-3.0-or-later": ["AGPL-3.0+"]}
#: licences with an "only" and an "or later", by the name's canonical form; then single ones.  A name in brackets counts only beside the word licence.
FAMILIES = {"gpl 1": "GPL-1.0", "gpl 2": "GPL-2.0", "gpl 3": "GPL-3.0", "lgpl 2": "LGPL-2.0", "lgpl 2 1": "LGPL-2.1", "lgpl 3": "LGPL-3.0", "agpl 1": "AGPL-1.0", "agpl 3": "AGPL-3.0", "gfdl 1 1": "GFDL-1.1", "gfdl 1 2": "GFDL-1.2", "gfdl 1 3": "GFDL-1.3"}
SINGLE = {
    "MIT": "mit, expat, mit expat", "MIT-0": "mit 0, mit no attribution", "X11": "[x11], mit x11", "Apache-1.0": "apache 1", "Apache-1.1": "apache 1 1", "Apache-2.0": "apache 2, asl 2", "0BSD": "0bsd, zero clause bsd, bsd zero clause, bsd 0 clause",
    "BSD-1-Clause": "bsd 1 clause, 1 clause bsd", "BSD-2-Clause": "bsd 2 clause, 2 clause bsd, simplified bsd, freebsd, two clause bsd, bsd 2", "BSD-3-Clause": "bsd 3 clause, 3 clause bsd, new bsd, modified bsd, revised bsd, three clause bsd, bsd 3", "BSD-4-Clause": "bsd 4 clause, 4 clause bsd, original bsd, four clause bsd",
    "ISC": "isc", "Zlib": "zlib, zlib libpng", "libpng-2.0": "libpng 2", "BSL-1.0": "boost 1, boost", "Unlicense": "un, unlicense", "WTFPL": "wtfpl, wtfpl 2, do what fuck you want to public", "CC0-1.0": "cc0, cc0 1, cc0 1 universal, cc zero",
    "MPL-1.0": "mpl 1", "MPL-1.1": "mpl 1 1", "MPL-2.0": "mpl 2", "EPL-1.0": "epl 1", "EPL-2.0": "epl 2", "EUPL-1.1": "eupl 1 1", "EUPL-1.2": "eupl 1 2", "CDDL-1.0": "cddl 1", "CDDL-1.1": "cddl 1 1", "CPL-1.0": "cpl 1", "IPL-1.0": "ibm public 1", "SPL-1.0": "sun public 1",
    "Artistic-1.0": "artistic 1", "Artistic-2.0": "artistic 2", "AFL-2.1": "afl 2 1, academic free 2 1", "AFL-3.0": "afl 3, academic free 3", "OSL-2.1": "osl 2 1, open software 2 1", "OSL-3.0": "osl 3, open software 3", "OFL-1.0": "ofl 1", "OFL-1.1": "ofl 1 1, sil ofl 1 1, ofl",
    "Python-2.0": "python 2, [python]", "PSF-2.0": "psf 2, [psf], [python software foundation]", "PHP-3.0": "php 3", "PHP-3.01": "php 3 01", "Ruby": "[ruby]", "Vim": "[vim]", "W3C": "[w3c], [w3c software]", "NTP": "[ntp]", "PostgreSQL": "[postgresql]", "OpenSSL": "[openssl]",
    "NCSA": "ncsa, [university of illinois ncsa open source]", "MS-PL": "ms pl, microsoft public", "MS-RL": "ms rl, microsoft reciprocal", "LPPL-1.2": "lppl 1 2, latex project public 1 2", "LPPL-1.3c": "lppl 1 3c, lppl 1 3, latex project public 1 3c, latex project public 1 3", "QPL-1.0": "qpl 1, q public 1",
    "Sleepycat": "[sleepycat]", "ZPL-2.0": "zpl 2, zope public 2", "ZPL-2.1": "zpl 2 1, zope public 2 1", "CECILL-2.0": "cecill 2", "CECILL-2.1": "cecill 2 1", "CECILL-B": "cecill b", "CECILL-C": "cecill c", "MulanPSL-1.0": "mulanpsl 1, mulan psl 1", "MulanPSL-2.0": "mulanpsl 2, mulan psl 2, mulan permissive software 2",
    "ODbL-1.0": "odbl 1, odbl, open database 1", "PDDL-1.0": "pddl 1, pddl", "ODC-By-1.0": "odc by 1, odc by", "Beerware": "[beerware], beer ware", "curl": "[curl]", "Fair": "[fair]", "HPND": "hpnd", "ICU": "[icu]", "IJG": "ijg", "Intel": "[intel open source]", "JSON": "[json]", "libtiff": "[libtiff]",
    "BUSL-1.1": "busl 1 1, business source 1 1", "SSPL-1.0": "sspl 1, sspl, server side public 1, server side public", "Elastic-2.0": "elastic 2, elv2", "CPAL-1.0": "cpal 1, common public attribution 1", "RPL-1.5": "rpl 1 5, reciprocal public 1 5", "APSL-2.0": "apsl 2, apple public source 2", "NASA-1.3": "nasa open source agreement 1 3",
    "SISSL": "sissl", "TCL": "[tcl], [tcl tk]", "UPL-1.0": "upl 1, universal permissive 1", "VSL-1.0": "vovida software 1", "Zend-2.0": "zend 2", "BlueOak-1.0.0": "blue oak model 1 0, blue oak model 1, blue oak model", "ECL-1.0": "ecl 1, educational community 1", "ECL-2.0": "ecl 2, educational community 2",
    "EFL-2.0": "efl 2, eiffel forum 2", "Frameworx-1.0": "frameworx open 1, frameworx 1", "LPL-1.02": "lucent public 1 02", "Motosoto": "[motosoto]", "NGPL": "ngpl, nethack general public", "OCLC-2.0": "oclc 2, oclc research public 2", "Watcom-1.0": "sybase open watcom public 1, watcom 1", "wxWindows": "[wxwindows], wxwindows library",
    "Parity-7.0.0": "parity 7, parity public 7", "PolyForm-Noncommercial-1.0.0": "polyform nc 1", "Hippocratic-2.1": "hippocratic 2 1", "SMLNJ": "[standard ml of new jersey]", "Spencer-94": "[spencer]", "TU-Berlin-2.0": "technische universitaet berlin 2", "Info-ZIP": "info zip", "bzip2-1.0.6": "bzip2 1 0 6, bzip2 1 6", "Xnet": "[x net]", "YPL-1.1": "yahoo public 1 1",
}


def _names() -> dict[str, str]:
    """Canonical name to identifier; ? marks names that need the word licence beside them, * those with an "only" and an "or later"."""
    out = {k: f"*{v}" for k, v in FAMILIES.items()}
    for kinds in ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd"):
        for v in ("2", "2 5", "3", "4"):
            out[f"cc {kinds} {v}"] = f"CC-{kinds.upper().replace(' ', '-')}-{v.replace(' ', '.') if ' ' in v else v + '.0'}"
        out[f"cc {kinds}"] = out[f"cc {kinds} 4"]
    for name, spoken in SINGLE.items():
        for x in spoken.split(", "):
            out[x.strip("[]")] = "?" * x.startswith("[") + name
    return out


NAMES = _names()
#: words of the longest name
LONGEST = max(len(x.split()) for x in NAMES)
#: verbs of sentences that name a licence, by the words that follow them
VERBS = {"under": "licen[cs]ed released distributed redistributed available provided published offered issued", "by": "covered governed", "to": "subject"}
_VERB = "|".join(rf"(?:{'|'.join(v.split())})(?: [a-z0-9]+){{0,3}}? {word}" for word, v in VERBS.items())
#: replacements that bring a sentence between blanks to the form in which names are looked up, in order
CANONICAL = [
    (r" ~ ", " "),
    (r" (?:either |both )?(?:terms and conditions|terms or conditions|terms) of ", " "),
    (r"([a-z])v([0-9])", r"\1 \2"), (r" (?:version|ver|v) ?([0-9])", r" \1"), (r" the ", " "), (r" the ", " "),
    (r"(?: only)?(?: of licen[cs]e)?(?: and| or)?(?: at your option)?(?: any)? (?:later|newer|greater|higher)(?: versions?)?", " orlater"),
    (r" gnu affero (?:general public|gpl)", " agpl"), (r" (?:gnu )?(?:lesser|library) (?:general public|gpl)", " lgpl"), (r" gnu general public", " gpl"), (r" gnu free documentation", " gfdl"), (r" gnu ", " "), (r" affero (?:general public|gpl)", " agpl"),
    (r" mozilla public", " mpl"), (r" eclipse public", " epl"), (r" european union public", " eupl"), (r" common development and distribution", " cddl"), (r" common public ", " cpl "), (r" (?:sil )?open font", " ofl"), (r" creative commons", " cc"), (r" attribution", " by"),
    (r" (?:sharealike|share alike)", " sa"), (r" (?:noncommercial|non commercial)", " nc"), (r" (?:noderivatives|noderivs|no derivatives|no derivs)", " nd"), (r" (?:international|unported|generic)", ""),
    (r" apache software", " apache"), (r" boost software", " boost"), (r"^ +under ", " @ "),
    (r" licen[cs]es? ", " lic "), (r" licen[cs]es? ", " lic "), (r" lic ([0-9](?: [0-9])*) ", r" \1 lic "), (r"([0-9]) 0 ", r"\1 "), 
    *[(f" {x} lic {x} ", f" {x} ") for x in ("gpl", "lgpl", "agpl", "mpl", "epl", "cddl", "ofl", "eupl", "osl", "afl")],
    (r" (?:is|are|was|were|be|being) ((?:[a-z0-9]+ ){1,5}?)licen[cs]ed ([^u]|u[^n]|$)", r" @ \1lic @@ \2"),
    (rf" (?:{_VERB}) ", " @ "),
]
NEGATION = r" (?:not|never|cannot|no longer|isn t|aren t|nor)(?: [a-z]+){0,2} $"
CUT = r" (?:and or|or|and|as well as|plus|with|but|which|that|see) "
LEAD = r"^(?: (?:either|both|one|any|of|following|your choice|your option|at|choice|permissive|open source|free software|dual|a|an|same|popular|well known))* "

#: replacements that normalise a text of lower case, in order; \1 stands for the first group
STEPS = [
    (r"\r\n?", "\n"),
    (r"\n[\x20\x09]*(?:/\*+|\*+/?|//+|#+|--+|;+|%+|>+|dnl )?[\x20\x09]*", "\n"),
    (r"\n\n+", " | "),
    (r"([.!?])[\"')\]]*[\x20\x09-\x0D]+([^0-9\x20\x09-\x0D])", r"\1 | \2"),
    (r"\n", " ~ "),
    (r"[^a-z0-9|~]+", " "),
    (r"[ ~]*\|[ |~]*", " || "),
]
EXPRESSION = r"spdx-license-identifier:[\x20\x09]*([a-z0-9.+() -]+)"


def known() -> dict[str, str]:
    """The patterns over normalised texts, in which ~ may stand where a line ends; headings may begin and end with it."""
    return {k: p.replace(" \\|", r" [|~]").replace("\\| ", r"[|~] ").replace(" ", "(?: ~)? ").replace(r"(?: ~)? [|~]", r" [|~]") for k, p in SENTENCES.items()}


def hints() -> str:
    """Stems of which every known sentence has one: the longest word that a pattern can't do without, and the verbs."""
    stems = set()
    for pattern in SENTENCES.values():
        bare = pattern
        while (inner := re.sub(r"\([^()]*\)\??|\[[^\]]*\]|\{[^}]*\}|\\.", " ", bare)) != bare:
            bare = inner
        stems.add(max(re.findall(r"[a-z]+", re.sub(r"[a-z]\?", " ", bare)), key=len)[:8])
    return "(?i)" + "|".join(sorted(stems | {v.replace("[cs]", "")[:5] for words in VERBS.values() for v in words.split()} | {"licen"}))


HINT = hints()
#: sentences that may name a licence
SAYS = "licen[cs]|" + "|".join(rf"{v}.* {word} " for word, words in VERBS.items() for v in words.split())
#: all licences, in the order in which they are given
ORDER = list(dict.fromkeys([r[0] for r in RULES] + [n for v in NAMES.values() for n in ([v[1:] + "-only", v[1:] + "-or-later"] if v[0] == "*" else [v.lstrip("?")])]))


def expression_name(name: str) -> str:
    return r"(?:^|[ (])(?:" + "|".join(x.lower().replace(".", "[.]").replace("+", "[+]") for x in [name, *SPDX.get(name, [])]) + r")(?:$|[ )])"


def sequence(parts: list[str]) -> str:
    """The pattern of a rule over a document's identifiers, each between blanks."""
    return " " + " (?:.* )?".join(parts) + " "


def normalised(text: Column) -> Column:
    t = F.concat(F.lit("\n"), F.lower(text))
    for pattern, by in STEPS:
        t = F.regexp_replace(t, pattern, by.replace("\\1", "$1").replace("\\2", "$2"))
    return F.concat(F.lit("|"), F.regexp_replace(t, r"^[ |~]*|[ |~]*$", " "), F.lit("|"))


def _java(by: str) -> str:
    return by.replace("\\1", "$1").replace("\\2", "$2")


def canonical(sentence: Column) -> Column:
    for pattern, by in CANONICAL:
        sentence = F.regexp_replace(sentence, pattern, _java(by))
    return sentence


def named_in(sentence: Column) -> Column:
    """The identifiers that a sentence, between blanks, names; in order."""
    table = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])

    def identifier(part: Column) -> Column:
        """ref:identifier of a part of a clause, null for none."""
        bare = F.regexp_replace(F.regexp_replace(F.concat(F.lit(" "), F.trim(part), F.lit(" ")), LEAD, " "), " lic ", " ")
        words = F.split(F.trim(bare), " +")

        def of(found: Column) -> Column:
            name = F.regexp_replace(found, r"^[?*]", "")
            said = F.when(found.startswith("*"), F.concat(name, F.when(F.contains(part, F.lit("orlater")), "-or-later").otherwise("-only")))
            return F.when(said.isNotNull(), said).when(~found.startswith("?") | F.contains(F.concat(part, F.lit(" ")), F.lit("lic ")), name)

        longest = F.coalesce(*[F.when(F.size(words) >= n, F.try_element_at(table, F.array_join(F.slice(words, 1, n), " "))) for n in range(LONGEST, 0, -1)])
        return text.let(longest, of)

    def clauses(parts: Column) -> Column:
        numbered = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.when(~F.rlike(F.concat(F.lit(" "), F.element_at(parts, i)), F.lit(NEGATION)), F.element_at(parts, i + 1)))
        return F.flatten(F.transform(F.array_compact(numbered), lambda c: F.array_compact(F.transform(F.split(c, CUT), identifier))))

    return text.let(F.split(canonical(sentence), "@"), lambda parts: F.when(F.size(parts) > 1, F.transform(F.array_distinct(clauses(parts)), lambda x: F.concat(F.lit("ref:"), x))).otherwise(F.array().cast("array<string>")))


def recognise(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_license_sentences, sentence_ids (space-joined, in order) and licenses (comma-joined)."""
    patterns = known()
    body = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    none = F.array().cast("array<string>")

    def identifier(s: Column) -> Column:
        case = None
        for k, p in patterns.items():
            case = (F if case is None else case).when(s.rlike(f"^(?:{p})$"), F.lit(k))
        return case

    rest = [c for c in docs.columns if c not in ("n_license_sentences", "sentence_ids", "licenses")]
    hinted = body.rlike(HINT)
    x = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.when(hinted, normalised(body)).alias("norm"), F.when(hinted, F.regexp_extract_all(F.lower(body), F.lit(EXPRESSION), F.lit(1))).otherwise(none).alias("named"))
    sentences = F.filter(F.split("norm", r"\|\|"), lambda s: s.rlike(SAYS))
    refs = F.flatten(F.transform(sentences, lambda s: named_in(F.concat(F.regexp_replace(s, r"\|", " "), F.lit(" ")))))
    ids = F.concat(F.transform(F.regexp_extract_all("norm", F.lit("|".join(patterns.values())), F.lit(0)), identifier), refs)
    out = x.select("row", "named", F.coalesce(ids, none).alias("ids"))
    out = out.withColumn("seq", F.concat(F.lit(" "), F.array_join("ids", " "), F.lit(" ")))
    hits = []
    for i, (name, parts, _) in enumerate(RULES):
        hits.append(F.when(F.col("seq").rlike(sequence(parts)), F.lit(i)))
    hit = F.array_compact(F.array(*hits))
    spdx = F.array_compact(F.array(*[F.when(F.array_join("named", " ").rlike(expression_name(n)), n) for n in ORDER]))
    own = F.array_union(F.transform(F.filter("ids", lambda x: x.startswith("ref:")), lambda x: F.substring(x, 5, 1000)), F.when(F.size("ids") > 0, spdx).otherwise(none))
    out = out.select("row", "ids", hit.alias("hit"), own.alias("own"))
    names, shut = F.array(*[F.lit(r[0]) for r in RULES]), F.array(*[F.array(*[F.lit(x) for x in r[2]]).cast("array<string>") for r in RULES])

    def step(got: Column, i: Column) -> Column:
        barred = F.arrays_overlap(got, shut[i]) | (F.array_contains(shut[i], "*") & (F.size(F.array_distinct("ids")) > 1))
        return F.when(barred, got).otherwise(F.array_union(got, F.array(names[i])))

    out = out.withColumn("got", F.aggregate("hit", F.col("own"), step))
    # "only" gives way to an "or later" of the same licence
    out = out.withColumn("got", F.filter(F.array(*[F.lit(n) for n in ORDER]), lambda n: F.array_contains("got", n) & ~(n.endswith("-only") & F.array_contains("own", F.regexp_replace(n, "-only$", "-or-later")) & ~F.array_contains("own", n))))
    return out.select(F.inline(F.array(F.struct("row", F.size("ids").cast("long").alias("n"), F.array_join("ids", " ").alias("ids"), F.array_join("got", ",").alias("got"))))).select(
        *[F.col(f"row.`{c}`").alias(c) for c in rest], F.col("n").alias("n_license_sentences"), F.col("ids").alias("sentence_ids"), F.col("got").alias("licenses")
    )
