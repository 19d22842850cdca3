"""Operator 6: licence scans by ordered signature rules.

Texts become words (A-Z lower-cased, cut at every ASCII character that is not a
letter or digit).  Hundreds of regexes are written over the words joined by
single spaces.  A rule runs only if its keyword occurs in the text (``rules``
refuses a keyword that some match of its rule does not hold); keywords are grouped, so most texts are dismissed by a few substring searches.  Each
match is a detection: label, first and last word, priority.  In order of
priority, then length, a detection is kept unless its interval lies inside the
interval of one already kept: a full grant suppresses the name inside it, and
"lesser general public license" suppresses "general public license".

The base phrases of the contract are found on their own and stay, whatever is
suppressed.  The score is the largest kept priority over 100.

Defined cases: null or wordless text has no words, empty labels and score 0;
repeated rows come back each; scanning is linear in the text but for the rules'
own bounded gaps.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import documents, query

#: Fixed values of the contract: phrase, label.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: label | priority | keyword | regex over words joined by spaces.  {v}: version digits as words.
RULES_TEXT = r"""
mit|95|permission is hereby granted|permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit|90|provided as is|the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
mit|85|mit license|(?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?mit license
mit|70|mit licen|(?:the )?mit licen[cs]ed?
mit|75|opensource org|opensource org licenses mit
mit|80|identifier mit|spdx license identifier mit
mit-0|86|mit no attribution|mit no attribution
mit-0|85|identifier mit 0|spdx license identifier mit 0
x11|85|x consortium|except as contained in this notice the name of the x consortium
x11|70|x11 license|x11 license
expat|75|expat license|expat license
isc|95|with or without fee|permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
isc|70|isc license|isc license
isc|80|identifier isc|spdx license identifier isc
0bsd|95|with or without fee|permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
0bsd|80|0bsd|(?:spdx license identifier )?0bsd
0bsd|78|zero clause|(?:bsd )?zero clause bsd(?: license)?
bsd-2-clause|92|redistribution|redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-3-clause|94|neither the name|neither the name of (?:\S+ ){1,12}nor the names of (?:its|their|the) contributors may be used to endorse or promote products
bsd-4-clause|95|advertising materials|all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment
bsd-2-clause|80|bsd|(?:simplified|freebsd|2 clause|two clause) bsd(?: license)?
bsd-2-clause|80|bsd 2 clause|bsd 2 clause(?: license)?
bsd-3-clause|80|bsd|(?:new|revised|modified|3 clause|three clause) bsd(?: license)?
bsd-3-clause|80|bsd 3 clause|bsd 3 clause(?: license)?
bsd-3-clause-clear|82|clear bsd|(?:the )?clear bsd license
bsd-4-clause|80|bsd|(?:original|old|4 clause|four clause) bsd(?: license)?
bsd-4-clause|80|bsd 4 clause|bsd 4 clause(?: license)?
bsd|65|bsd|bsd(?: style)? license
apache-2.0|95|apache license|licensed under the apache license version 2 0(?: the license)?
apache-2.0|90|apache org|(?:https? )?(?:www )?apache org licenses license 2 0
apache-2.0|80|apache|apache (?:software )?license (?:version |v)?2(?: 0)?
apache-2.0|80|apache 2|apache 2 0(?: license)?
apache-2.0|85|identifier apache|spdx license identifier apache 2 0
apache-1.1|80|apache|apache (?:software )?license (?:version |v)?1 1
apache-1.0|80|apache|apache (?:software )?license (?:version |v)?1 0
apache|60|apache license|apache license
gpl|60|gnu gpl|gnu gpl
gpl|60|gplv|gplv[123]
gpl|62|gnu general public license|(?:the )?gnu general public license
gpl|60|general public license|see the gnu general public license for more details
lgpl|62|lesser general public license|(?:gnu )?lesser general public license
lgpl|62|library general public license|(?:gnu )?library general public license
lgpl|60|lgpl|(?:gnu )?lgpl
agpl|62|affero|(?:gnu )?affero general public license
agpl|60|agpl|(?:gnu )?agpl
gpl|90|under the terms of the gnu|redistribute it and or modify it under the terms of the gnu general public license
lgpl|91|under the terms of the gnu|redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
agpl|91|under the terms of the gnu|redistribute it and or modify it under the terms of the gnu affero general public license
gfdl|75|free documentation license|(?:gnu )?free documentation license(?: version \d( \d)?)?
gfdl|90|free documentation license|permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
mpl-2.0|95|mozilla public|this source code form is subject to the terms of the mozilla public license v 2 0
mpl|60|mozilla public|mozilla public license
npl|70|netscape public|netscape public license
epl|60|eclipse public|eclipse public license
edl|75|eclipse distribution|eclipse distribution license(?: v?1 0)?
cpl-1.0|75|common public license|common public license(?: version| v)?(?: 1 0)?
ipl-1.0|75|ibm public license|ibm public license(?: version| v)?(?: 1 0)?
cddl|60|common development and distribution|common development and distribution license
eupl|60|european union public|european union public licen[cs]e
osl|60|open software license|open software license
afl|60|academic free license|academic free license
artistic|60|artistic license|(?:the )?artistic license
artistic-2.0|80|artistic license|artistic license (?:version )?2 0
artistic-1.0|80|artistic license|artistic license (?:version )?1 0
clarified-artistic|82|clarified artistic|clarified artistic license
perl|78|same terms as perl|(?:under|on) the same terms as perl(?: itself)?
python-2.0|78|python software foundation|python software foundation license(?: version 2)?
python-2.0|80|psf license|psf license agreement
zlib|95|in no event|this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib|75|zlib|zlib(?: libpng)? license
libpng|78|libpng license|libpng license
boost-1.0|80|boost software license|boost software license(?: version)?(?: 1 0)?
boost-1.0|80|bsl 1 0|spdx license identifier bsl 1 0
unlicense|95|unencumbered|this is free and unencumbered software released into the public domain
unlicense|75|unlicense|(?:the )?unlicense
wtfpl|80|wtfpl|wtfpl
wtfpl|85|what the fuck|do what the fuck you want to public license
beerware|78|beer ware|beer ware license
beerware|90|buy me a beer|you can buy me a beer in return
cc0-1.0|85|cc0|cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?
cc0-1.0|88|creative commons zero|creative commons zero(?: v?1 0)?(?: universal)?
cc-pdm|80|public domain mark|public domain mark(?: 1 0)?
public-domain|70|public domain|(?:is|are|placed|released|dedicated) (?:in|into|to) the public domain
public-domain|55|public domain|public domain
creative-commons|55|creative commons|creative commons(?: license)?
odbl|78|open database|open (?:data commons open )?database license(?: v?1 0)?
odc-by|80|open data commons|open data commons attribution license(?: v?1 0)?
pddl|80|open data commons|open data commons public domain dedication and license(?: v?1 0)?
ogl|78|open government|open government licen[cs]e(?: v\d(?: \d)?)?
cdla-permissive|80|community data|community data license agreement permissive(?: version)?(?: \d 0)?
cdla-sharing|80|community data|community data license agreement sharing(?: version)?(?: 1 0)?
etalab|78|etalab|(?:licence ouverte )?etalab(?: 2 0)?
ofl-1.1|85|open font|(?:sil )?open font license(?: version)?(?: 1 1)?
ubuntu-font|80|ubuntu font|ubuntu font licen[cs]e(?: version)?(?: 1 0)?
bitstream-vera|80|bitstream vera|bitstream vera(?: fonts)? copyright
lppl|78|latex project|latex project public license(?: version)?(?: 1 3c?)?
openssl|80|openssl|openssl license
openssl|90|openssl toolkit|this product includes software developed by the openssl project for use in the openssl toolkit
ssleay|80|ssleay|ssleay license
php|78|php license|php license(?: version)?(?: 3 0(?:1)?)?
ruby|78|ruby|ruby s? ?license
tcl|78|tcl tk license|tcl tk license
vim|78|vim license|vim license
curl|78|curl license|curl license
postgresql|80|postgresql|postgresql licen[cs]e
ncsa|80|ncsa|(?:university of illinois )?ncsa open source license
w3c|80|w3c|w3c software (?:notice and )?(?:document )?license
icu|78|icu license|icu license
unicode|80|unicode|unicode (?:inc )?license agreement
hpnd|90|historical permission|historical permission notice and disclaimer
sleepycat|80|sleepycat|sleepycat license
intel|75|intel|intel (?:open source|simplified software) license
nvidia|75|nvidia|nvidia (?:software|source code) license(?: agreement)?
ms-pl|80|microsoft public|microsoft public license
ms-rl|80|microsoft reciprocal|microsoft reciprocal license
apsl|78|apple public|apple public source license(?: version)?(?: 2 0)?
sun-bcl|75|sun|sun binary code license agreement
sissl|78|sun industry|sun industry standards source license
rpl|78|reciprocal public|reciprocal public license(?: 1 5)?
qpl|78|q public license|q public license(?: version)?(?: 1 0)?
cecill|78|cecill|cecill(?: free software)?(?: license)?(?: agreement)?(?: v?2 [01])?
mulan|80|mulan|mulan permissive software license(?: v ?2)?
busl-1.1|82|business source|business source license(?: 1 1)?
sspl-1.0|82|server side public|server side public license(?: v?(?:ersion)? ?1)?
elastic|80|elastic license|elastic license(?: 2 0)?
commons-clause|80|commons clause|commons clause(?: license)?
polyform|80|polyform|polyform (?:noncommercial|small business|shield|perimeter|strict|free trial)(?: license)?(?: 1 0 0)?
confluent|78|confluent community|confluent community license(?: agreement)?
timescale|78|timescale|timescale license(?: agreement)?
parity|78|parity public|parity public license(?: 7 0 0)?
hippocratic|80|hippocratic|hippocratic license
json|85|good not evil|the software shall be used for good not evil
blueoak|80|blue oak|blue oak model license(?: 1 0 0)?
upl-1.0|80|universal permissive|universal permissive license(?: v?1 0)?
ecl-2.0|80|educational community|educational community license(?: version)?(?: 2 0)?
naist|75|nara institute|nara institute of science and technology
open-rail|80|rail|(?:creativeml )?open ?rail(?: \+\+)?(?: m)?(?: license)?
llama|78|llama|llama (?:2|3|3 1) community license(?: agreement)?
gemma|75|gemma terms|gemma terms of use
bigscience-rail|82|bigscience|bigscience (?:bloom )?rail license(?: 1 0)?
reserved|50|rights reserved|(?:all|some) rights reserved
reserved|52|no part of this|no part of this (?:publication|book|work|document) may be reproduced
reserved|52|tous droits|tous droits r\S{1,4}serv\S{1,4}s
reserved|52|alle rechte|alle rechte vorbehalten
reserved|52|derechos reservados|todos los derechos reservados
copyright|40|copyright|copyright(?: c)?(?: \d{4}(?: \d{4})*)?(?: by)?
proprietary|60|proprietary|(?:proprietary and confidential|confidential and proprietary)
proprietary|58|unauthorized|unauthorized (?:copying|use|distribution|reproduction) (?:of this file )?(?:via any medium )?is (?:strictly )?prohibited
proprietary|58|distribute|do not (?:copy or )?distribute(?: without (?:prior )?(?:written )?permission)?
trade-secret|60|trade secret|trade secrets? of
noncommercial|55|non commercial|(?:for )?non commercial (?:use|purposes)(?: only)?
noncommercial|55|noncommercial|(?:for )?noncommercial (?:use|purposes)(?: only)?
academic-only|56|academic use|(?:for )?academic use only
research-only|56|research purposes|(?:for )?research purposes only
evaluation-only|56|evaluation|(?:for )?evaluation (?:use|purposes) only
no-derivatives|50|no derivative|no derivative works
shareware|55|shareware|shareware
freeware|55|freeware|freeware
eula|60|end user licen|end user licen[cs]e agreement
terms-of-use|45|terms of|terms of (?:use|service)
patent-grant|60|patent|additional grant of patent rights
royalty-free|50|royalty free|royalty free(?: license)?
"""


def _families() -> list[str]:
    """Versioned families: the same wording for each version, with "only" and "or later" forms."""
    out = []
    said = {1: "one", 2: "two", 3: "three"}
    gnu = (("gpl", r"(?:gnu )?general public license", "general public license", ("1", "2", "3")),
           ("lgpl", r"(?:gnu )?(?:lesser|library) general public license", "general public license", ("2", "2 1", "3")),
           ("agpl", r"(?:gnu )?affero general public license", "affero", ("1", "3")))
    for label, name, key, versions in gnu:
        for v in versions:
            tag = f"{label}-{v.replace(' ', '.') if ' ' in v else v + '.0'}"
            ver = rf"(?:as published by the free software foundation )?(?:either )?(?:version |v ?){v}(?: 0)?"
            if len(v) == 1:
                ver = rf"(?:{ver}|version {said[int(v)]})"
            out += [f"{tag}|80|{key}|{name} {ver}", f"{tag}-or-later|84|{key}|{name} {ver} (?:of the license )?or (?:\\(?at your option\\)? )?(?:any )?later(?: version)?",
                    f"{tag}-or-later|84|{key}|{name} {ver} of the license or at your option any later version",
                    f"{tag}-only|83|{key}|{name} {ver} only", f"{tag}|78|{label}|{label} ?v?{v}(?: 0)?",
                    f"{tag}-or-later|84|{label}|spdx license identifier {label} {v}(?: 0)? or later",
                    f"{tag}-or-later|82|{label}|{label} ?v?{v}(?: 0)? or (?:any )?later", f"{tag}-only|82|{label}|{label} ?v?{v}(?: 0)? only",
                    f"{tag}-only|84|{label}|spdx license identifier {label} {v}(?: 0)? only",
                    f"{tag}|76|gnu org|gnu org licenses (?:old licenses )?{label} {v}(?: 0)?"]
    kinds = (("by", "attribution"), ("by-sa", "attribution share ?alike"), ("by-nd", "attribution no ?deriv(?:ative)?s"),
             ("by-nc", "attribution non ?commercial"), ("by-nc-sa", "attribution non ?commercial share ?alike"),
             ("by-nc-nd", "attribution non ?commercial no ?deriv(?:ative)?s"))
    for short, words in kinds:
        sp = short.replace("-", " ")
        out += [f"cc-{short}|70|cc by|cc {sp}", f"cc-{short}|72|creative commons|creative commons {words}",
                f"cc-{short}|74|creativecommons|creativecommons org licenses {sp}"]
        for v in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            tag = f"cc-{short}-{v.replace(' ', '.')}"
            out += [f"{tag}|{78 + short.count('-')}|cc by|cc {sp}(?: license)? (?:version |v)?{v}",
                    f"{tag}|{80 + short.count('-')}|creative commons|creative commons {words}(?: license)? {v}(?: international| unported| generic)?",
                    f"{tag}|{82 + short.count('-')}|creativecommons|creativecommons org licenses {sp} {v}"]
    for label, name, versions in (("mpl", "mozilla public license", ("1 0", "1 1", "2 0")), ("epl", "eclipse public license", ("1 0", "2 0")),
                                  ("cddl", "common development and distribution license", ("1 0", "1 1")),
                                  ("eupl", "european union public licen[cs]e", ("1 1", "1 2")),
                                  ("osl", "open software license", ("1 0", "2 0", "2 1", "3 0")),
                                  ("afl", "academic free license", ("1 2", "2 0", "2 1", "3 0"))):
        for v in versions:
            tag = f"{label}-{v.replace(' ', '.')}"
            key = name.split(" licen")[0]
            out += [f"{tag}|80|{key}|{name}(?: version| v)? {v}", f"{tag}|76|{label}|{label} ?v? ?{v}"]
    return out


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    keyword: bytes
    regex: re.Pattern[bytes]


def wordings(body: str) -> list[str]:
    """Forms such that every match of the regex is one of them, with other text where they hold a NUL: optional parts
    with and without, each alternative, each letter of a small set."""
    def joined(items) -> list[str]:
        out = [""]
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                more = [chr(arg)]
            elif name == "SUBPATTERN":
                more = joined(arg[-1])
            elif name == "BRANCH":
                more = [x for branch in arg[1] for x in joined(branch)]
            elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
                more = [chr(c) for _, c in arg]
            elif name == "MAX_REPEAT":
                low, high, inner = arg
                more = [x if high == 1 else x + "\0" for x in joined(inner)] + ([""] if low == 0 else [])
            else:
                more = ["\0"]
            out = [a + b for a in out for b in more]
        return out
    return joined(re._parser.parse(body))


@lru_cache(maxsize=4)
def rules(extra: str = "") -> list[Rule]:
    """All rules in order of priority; ``extra``: further lines of the same form."""
    out = []
    for line in [*RULES_TEXT.strip().splitlines(), *_families(), *extra.strip().splitlines()]:
        label, priority, keyword, body = line.split("|", 3)
        if lost := [w for w in wordings(f" (?:{body.strip()}) ") if keyword not in w]:
            raise ValueError(f"keyword {keyword!r} of {label} is not in {lost[0]!r}")
        out.append(Rule(label, int(priority), keyword.encode(), re.compile(f" (?:{body.strip()})(?= )".encode())))
    return sorted(out, key=lambda r: (-r.priority, r.label, r.regex.pattern))


_PLUS = re.compile(rb"(?<=[0-9])\+(?![0-9+])")  # "2.1+" reads "2.1 or later", to the method's rules alone
_TO_SPACE = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256))


class Scanner:
    def __init__(self, extra: str = ""):
        self.by_keyword: dict[bytes, list[Rule]] = {}
        for r in rules(extra):
            self.by_keyword.setdefault(r.keyword, []).append(r)
        # a keyword is searched only if its rarest short part occurs at all
        self.parts: dict[bytes, list[bytes]] = {}
        for k in self.by_keyword:
            self.parts.setdefault(max(k.split(), key=len)[:4], []).append(k)
        self.base = [(re.compile(f"(?= {p} )".encode()), label) for p, label in BASE]
        self.base_keys = [max(p.encode().split(), key=len) for p, _ in BASE]

    @staticmethod
    def words(text: str | None) -> list[bytes]:
        return (text or "").encode("utf-8", "replace").lower().translate(_TO_SPACE).split()

    def rule_line(self, text: str | None, line: bytes) -> bytes:
        """The joined words as the rules read them."""
        if not text or "+" not in text:
            return line
        later = _PLUS.sub(b" or later ", text.encode("utf-8", "replace"))
        return b" " + b" ".join(later.lower().translate(_TO_SPACE).split()) + b" "

    def detections(self, line: bytes) -> list[tuple[int, int, str, int]]:
        """Kept detections (start, end, label, priority) as byte places in the joined words."""
        found = []
        for part, keys in self.parts.items():
            if part in line:
                for k in keys:
                    if k in line:
                        for r in self.by_keyword[k]:
                            found += [(m.start(), m.end(), r.label, r.priority) for m in r.regex.finditer(line)]
        found.sort(key=lambda d: (-d[3], d[0] - d[1], d[0], d[2]))
        kept: list[tuple[int, int, str, int]] = []
        ends: list[tuple[int, int]] = []  # outermost kept intervals: starts and ends both ascend
        from bisect import bisect_right
        for d in found:
            i = bisect_right(ends, (d[0], len(line) + 1)) - 1
            if i >= 0 and ends[i][1] >= d[1]:
                continue
            kept.append(d)
            j = i + 1
            while j < len(ends) and ends[j][1] <= d[1]:
                j += 1
            ends[i + 1:j] = [d[:2]]
        return sorted(kept)

    def scan(self, text: str | None) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score."""
        words = self.words(text)
        line = b" " + b" ".join(words) + b" "
        places, base_labels = [], set()
        for (regex, label), key in zip(self.base, self.base_keys):
            if key in line:
                at = [m.start() for m in regex.finditer(line)]
                if at:
                    places += at
                    base_labels.add(label)
        kept = self.detections(self.rule_line(text, line))
        labels = base_labels | {d[2] for d in kept}
        first, last = (line.count(b" ", 0, f(places)) if places else None for f in (min, max))
        score = max([50 if base_labels else 0, *(d[3] for d in kept)]) / 100
        return (len(words), len(places), first, last, ",".join(sorted(base_labels)), ",".join(sorted(labels)), score)


SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
          "labels string, score double")


def scan_licenses(docs: DataFrame, extra: str = "") -> DataFrame:
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(extra)
        for batch in batches:
            rows = [(None if pd.isna(d) else int(d), *scanner.scan(None if pd.isna(t) else t))
                    for d, t in zip(batch["doc_id"].array, batch["text"].array)]
            yield pd.DataFrame(rows, columns=names).astype(
                {"doc_id": "Int64", "first_word": "Int64", "last_word": "Int64"})
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, SCHEMA)


@query("op6_license_scan")
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))
