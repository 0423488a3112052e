"""License scans: ordered signature rules behind a keyword prefilter, overlaps resolved by priority.

A text is lower-cased (A to Z), one automaton finds all keywords at once, and
only rules with a keyword present run. Rules come in order: their priority is
their kind's, then their place. A detection that lies inside one of higher
priority is dropped, so the name "mit" inside a full grant text, or "gpl-2.0"
inside "agpl-2.0 or later", does not count again. Spans that merely overlap
both stay, as neither text explains the other.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .common import kept_in_process, text_rows

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Base phrases and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

KINDS = ("tag", "grant", "notice", "name", "address")  # from the surest to the weakest, also their order
SURE = {"tag": 1.0, "grant": 1.0, "notice": 0.9, "name": 0.6, "address": 0.8, "base": 0.7}


@dataclass(frozen=True)
class Rule:
    label: str
    kind: str
    keyword: str
    pattern: str


# Label; the name as a pattern on lower-cased text; the keyword without which the name cannot occur.
NAMES = [
    ("agpl-3.0", r"(?:gnu )?(?:affero general public licen[sc]e|agpl)[ ,-]*(?:version |v)?3(?:\.0)?", "a"),
    ("agpl", r"(?:gnu )?affero general public licen[sc]e", "affero"),
    ("lgpl-2.1", r"(?:(?:gnu )?(?:lesser|library) general public licen[sc]e|lgpl)[ ,-]*(?:version |v)?2\.1", "l"),
    ("lgpl-3.0", r"(?:(?:gnu )?lesser general public licen[sc]e|lgpl)[ ,-]*(?:version |v)?3(?:\.0)?", "l"),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public licen[sc]e", "general"),
    ("gpl-2.0", r"(?:(?:gnu )?general public licen[sc]e|\bgpl)[ ,-]*(?:version |v)?2(?:\.0)?", "g"),
    ("gpl-3.0", r"(?:(?:gnu )?general public licen[sc]e|\bgpl)[ ,-]*(?:version |v)?3(?:\.0)?", "g"),
    ("gpl", r"gnu general public licen[sc]e", "gnu"),
    ("gfdl", r"(?:gnu )?free documentation licen[sc]e", "documentation"),
    ("apache-2.0", r"apache(?: software)?(?: licen[sc]e)?[ ,-]*(?:version |v)?2(?:\.0)?\b", "apache"),
    ("apache-1.1", r"apache(?: software)? licen[sc]e[ ,-]*(?:version |v)?1\.1", "apache"),
    ("apache", r"apache software licen[sc]e", "apache"),
    ("mit", r"(?:the )?(?:mit|expat)(?:/x11)? licen[sc]e", "licen"),
    ("mit-0", r"mit no attribution", "attribution"),
    ("x11", r"x11 licen[sc]e", "x11"),
    ("isc", r"isc licen[sc]e", "isc"),
    ("bsd-2-clause", r"(?:simplified bsd|bsd[ -]2[ -]clause|2[ -]clause bsd|freebsd)(?: licen[sc]e)?", "bsd"),
    ("bsd-3-clause", r"(?:new bsd|modified bsd|revised bsd|bsd[ -]3[ -]clause|3[ -]clause bsd)(?: licen[sc]e)?", "bsd"),
    ("bsd-4-clause", r"(?:original bsd|bsd[ -]4[ -]clause|4[ -]clause bsd)(?: licen[sc]e)?", "bsd"),
    ("0bsd", r"(?:zero[ -]clause bsd|0bsd)(?: licen[sc]e)?", "bsd"),
    ("bsd", r"bsd(?:-style)? licen[sc]e", "bsd"),
    ("mpl-1.1", r"mozilla public licen[sc]e[ ,-]*(?:version |v)?1\.1", "mozilla"),
    ("mpl-2.0", r"(?:mozilla public licen[sc]e|\bmpl)[ ,-]*(?:version |v)?2(?:\.0)?", "m"),
    ("mpl", r"mozilla public licen[sc]e", "mozilla"),
    ("epl-1.0", r"(?:eclipse public licen[sc]e|\bepl)[ ,-]*(?:version |v)?1(?:\.0)?", "e"),
    ("epl-2.0", r"(?:eclipse public licen[sc]e|\bepl)[ ,-]*(?:version |v)?2(?:\.0)?", "e"),
    ("epl", r"eclipse public licen[sc]e", "eclipse"),
    ("cddl-1.0", r"common development and distribution licen[sc]e", "distribution"),
    ("cpl-1.0", r"common public licen[sc]e", "common"),
    ("eupl-1.2", r"european union public licen[sc]e", "european"),
    ("unlicense", r"(?:the )?unlicense\b", "unlicense"),
    ("wtfpl", r"wtfpl|do what the f\w+ you want to public licen[sc]e", "w"),
    ("zlib", r"zlib(?:/libpng)? licen[sc]e", "zlib"),
    ("libpng", r"libpng licen[sc]e", "libpng"),
    ("bsl-1.0", r"boost software licen[sc]e", "boost"),
    ("artistic-2.0", r"artistic licen[sc]e[ ,-]*(?:version |v)?2(?:\.0)?", "artistic"),
    ("artistic", r"artistic licen[sc]e", "artistic"),
    ("psf-2.0", r"python software foundation licen[sc]e", "python"),
    ("ruby", r"ruby(?:'s)? licen[sc]e", "ruby"),
    ("php-3.0", r"php licen[sc]e", "php"),
    ("openssl", r"openssl licen[sc]e", "openssl"),
    ("postgresql", r"postgresql licen[sc]e", "postgresql"),
    ("ofl-1.1", r"sil open font licen[sc]e", "font"),
    ("ms-pl", r"microsoft public licen[sc]e", "microsoft"),
    ("ms-rl", r"microsoft reciprocal licen[sc]e", "reciprocal"),
    ("afl-3.0", r"academic free licen[sc]e", "academic"),
    ("osl-3.0", r"open software licen[sc]e", "open software"),
    ("upl-1.0", r"universal permissive licen[sc]e", "universal"),
    ("ncsa", r"(?:university of illinois/)?ncsa open source licen[sc]e", "ncsa"),
    ("odbl-1.0", r"open database licen[sc]e|odbl", "od|database"),
    ("odc-by-1.0", r"open data commons attribution licen[sc]e|odc-by", "odc|commons"),
    ("pddl-1.0", r"public domain dedication and licen[sc]e|pddl", "pddl|dedication"),
    ("openrail", r"(?:creativeml |bigscience )?open ?rail(?:\+\+)?(?:-m)?", "rail"),
    ("cc0-1.0", r"(?:cc0|creative commons zero)(?:[ -]1\.0)?(?: universal)?", "cc0|zero"),
    ("public-domain", r"(?:released|dedicated|placed) (?:in)?to the public domain|(?:is|are) in the public domain",
     "public domain"),
    ("proprietary", r"all rights reserved", "rights reserved"),
]
# Creative Commons deeds: elements, versions and spellings make one name each.
ELEMENTS = {"by": "attribution", "by-sa": "attribution[ -]share[ -]?alike", "by-nd": "attribution[ -]no[ -]?deriv(?:ative)?s?",
            "by-nc": "attribution[ -]non[ -]?commercial", "by-nc-sa": "attribution[ -]non[ -]?commercial[ -]share[ -]?alike",
            "by-nc-nd": "attribution[ -]non[ -]?commercial[ -]no[ -]?deriv(?:ative)?s?"}
for _deed, _long in ELEMENTS.items():
    for _version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
        _v = re.escape(_version)
        NAMES.append((f"cc-{_deed}-{_version}", rf"\bcc[ -]{_deed.replace('-', '[ -]')}[ -]{_v}", "cc by|cc-by"))
        NAMES.append((f"cc-{_deed}-{_version}", rf"creative commons {_long}(?: licen[sc]e)?[ ,-]*{_v}", "creative commons"))
    NAMES.append((f"cc-{_deed}", rf"\bcc[ -]{_deed.replace('-', '[ -]')}\b(?![ -](?:nc|nd|sa)\b)", "cc by|cc-by"))

# Sentences of the license texts themselves.
GRANTS = [
    ("mit", r"permission is hereby granted, free of charge, to any person obtaining a copy", "permission is hereby granted"),
    ("isc", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose", "permission to use"),
    ("bsd", r"redistribution and use in source and binary forms, with or without modification", "redistribution and use"),
    ("bsd-3-clause", r"neither the name of .{1,120}? nor the names of its contributors", "neither the name"),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software", "advertising materials"),
    ("apache-2.0", r"licensed under the apache license, version 2\.0 \(the \"license\"\)", "apache license"),
    ("gpl", r"this program is free software[;:] you can redistribute it and/or modify", "free software"),
    ("lgpl", r"this library is free software[;:] you can redistribute it and/or modify", "free software"),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public license", "source code form"),
    ("zlib", r"this software is provided 'as-is', without any express or implied warranty", "as-is"),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered"),
    ("bsl-1.0", r"permission is hereby granted, free of charge, to any person or organization", "organization"),
    ("ofl-1.1", r"this font software is licensed under the sil open font license", "font software"),
    ("wtfpl", r"everyone is permitted to copy and distribute verbatim or modified copies", "everyone is permitted"),
    ("psf-2.0", r"psf is making python available to licensee on an \"as is\" basis", "making python"),
    ("epl", r"the accompanying program is provided under the terms of this eclipse public license", "accompanying program"),
    ("cddl-1.0", r"the contents of this file are subject to the terms of the common development", "common development"),
]
ADDRESSES = [
    ("gpl-2.0", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0", "gnu.org"), ("gpl-3.0", r"gnu\.org/licenses/gpl-3\.0", "gnu.org"),
    ("lgpl", r"gnu\.org/licenses/lgpl", "gnu.org"), ("agpl", r"gnu\.org/licenses/agpl", "gnu.org"),
    ("gpl", r"gnu\.org/licenses/?(?![\w/])", "gnu.org"), ("apache-2.0", r"apache\.org/licenses/license-2\.0", "apache.org"),
    ("mpl-2.0", r"mozilla\.org/(?:en-us/)?mpl/2\.0", "mozilla.org"), ("mit", r"opensource\.org/licen[sc]es?/mit", "opensource.org"),
    ("bsd-3-clause", r"opensource\.org/licen[sc]es?/bsd-3-clause", "opensource.org"),
    ("bsd-2-clause", r"opensource\.org/licen[sc]es?/bsd-2-clause", "opensource.org"),
    ("epl-2.0", r"eclipse\.org/legal/epl-2\.0", "eclipse.org"), ("cc0-1.0", r"creativecommons\.org/publicdomain/zero", "creativecommons.org"),
    *[(f"cc-{d}", rf"creativecommons\.org/licenses/{d}(?:/|\b(?!-))", "creativecommons.org") for d in ELEMENTS],
]
UNDER = r"(?:licen[sc]ed|released|distributed|published|available|shared|provided|covered) under (?:the )?(?:terms of (?:the )?)?"


def rules() -> list[Rule]:
    """All rules in order. Every named license has three: identifier tag, notice sentence, bare name."""
    ids = list(dict.fromkeys(label for label, _, _ in NAMES))
    out = [Rule(i, "tag", "spdx-license-identifier", rf"spdx-license-identifier:\s*{re.escape(i)}(?:-only|-or-later|\+)?(?![\w.-])")
           for i in ids]
    out += [Rule(a, "grant", k, p) for a, p, k in GRANTS]
    out += [Rule(a, "notice", k, UNDER + f"(?:{p})") for a, p, k in NAMES]
    out += [Rule(a, "address", k, p) for a, p, k in ADDRESSES]
    out += [Rule(a, "name", k, p) for a, p, k in NAMES]
    return out


def _loose(pattern: str) -> str:
    """Any run of white space stands where the rule has one blank outside a character class."""
    return re.sub(r"(\[[^\]]*\])| ", lambda m: m.group(1) or r"\s+", pattern)


def _machine():
    import ahocorasick
    table = [(r, re.compile(_loose(r.pattern)), "under" if r.kind == "notice" else "") for r in rules()]
    words = ahocorasick.Automaton()
    gates: dict[str, list[int]] = {}
    for i, (rule, _, _) in enumerate(table):
        for key in rule.keyword.split("|"):
            # Rules gated by a bare letter need a licence word or abbreviation anyway.
            for gate in ((key,) if len(key) > 1 else ("licen", "gpl", "mpl", "epl", "wtfpl")):
                gates.setdefault(gate, []).append(i)
    for gate, members in gates.items():
        words.add_word(gate, members)
    words.make_automaton()
    base = [(re.compile(rf"(?<!{WORD}){GAP.join(p.split())}(?!{WORD})"), label) for p, label in BASE]
    return table, words, base


def _count_words(text: str) -> int:
    """Runs of word characters; in UTF-8 every byte from 128 belongs to one."""
    return len(text.encode("utf-8", "surrogatepass").translate(_BLANKED).split())


_BLANKED = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def _ascii_lower(text: str) -> str:
    return text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}


def scan(text: str) -> tuple:
    """Counts, places, labels, detections and score of one text."""
    table, automaton, base = kept_in_process("license-rules", _machine)
    low = text.lower() if text.isascii() else _ascii_lower(text)
    n_words = _count_words(low)
    places = [(m.start(), label) for pattern, label in base for m in pattern.finditer(low)] \
        if "license" in low or "cc" in low else []
    possible = sorted({i for _, members in automaton.iter(low) for i in members})
    found = []
    for i in possible:
        rule, pattern, also = table[i]
        if also not in low:
            continue
        rank = (KINDS.index(rule.kind), i)
        found += [(rank, m.start(), m.end(), rule) for m in pattern.finditer(low) if m.end() > m.start()]
    kept: list[tuple] = []
    for hit in sorted(found, key=lambda h: (h[0][0], h[1] - h[2], h[0][1], h[1])):
        if not any(k[1] <= hit[1] and hit[2] <= k[2] for k in kept):
            kept.append(hit)
    kept.sort(key=lambda h: (h[1], h[2], h[0]))
    first = last = None
    if places:
        starts = sorted(p for p, _ in places)
        first, last = (_count_words(low[:p]) for p in (starts[0], starts[-1]))
    base_labels = {label for _, label in places}
    labels = base_labels | {h[3].label for h in kept}
    score = max([SURE[h[3].kind] for h in kept] + [SURE["base"]] * bool(places), default=0.0)
    spans = [(h[1], h[2], h[3].label, h[3].kind) for h in kept]
    return (n_words, len(places), first, last, ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, spans)


SCHEMA = ("doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string,"
          " labels string, score double, detections array<struct<start:int,end:int,label:string,kind:string>>")


def license_scan(docs: DataFrame) -> DataFrame:
    """License phrases and rule detections of every row, from its whole text.

    ``n_base`` counts all places of the base phrases, ``first_word`` and
    ``last_word`` are the smallest and largest word they start at (null
    without any). ``detections`` are the rule spans left by the suppression, in code
    points of the text. Null and empty texts give a row without labels and score
    0; repeated rows repeat; equal detections of one span keep the surest, then
    the first rule. An empty table gives no rows.
    """
    def run(batches):
        for batch in batches:
            rows = [(d, *scan(t)) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield _to_arrow(rows)

    return text_rows(docs).mapInArrow(run, SCHEMA)


def _to_arrow(rows):
    import pyarrow as pa
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("kind", pa.string())])
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.list_(span)]
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
    columns = list(zip(*rows)) if rows else [()] * len(names)
    arrays = []
    for name, kind, column in zip(names, kinds, columns):
        if name == "detections":
            column = [[dict(zip(("start", "end", "label", "kind"), x)) for x in row] for row in column]
        arrays.append(pa.array(column, kind))
    return pa.RecordBatch.from_arrays(arrays, names=names)
