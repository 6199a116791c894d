"""License notices by conditional compression.

Every template has anchors, words of which a confirmed copy holds at least one: a name that
must agree, or else one word more than may be missing. Each place of an anchor in a text gives
a small window: the words that a copy of the template would cover there, and as many more on
either side as may be added. A window's wording (folded words, one blank between) is
compressed alone and with the template's wording as a raw dictionary, and one that saves no
bytes is no copy. A template is confirmed or not by its exact wording: its words are aligned
with the window's, and the words missing and added are counted. The bytes that the template
saves on the aligned words rank the confirmed spans. Names, versions and negations must agree one by one, and no negation may
come just before; spans that fail only in this are near misses and name no license. Of
confirmed spans that overlap the first stays.

Cases: a null or empty text has no notice. Distances are counted in words: a notice may run
over line breaks, blanks and the marks before a line, and a text may hold any number. Windows
that lack too many of a template's words are not compressed, as no alignment could confirm
them. Of templates that save equally many bytes the one with fewer changes wins, then the
first by name. Repeated rows are each answered. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbflow.llm.common import map_rows

# fixed values: public notices and license texts
TEXTS = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at"
    ),
    "boost-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met"
    ),
    "bsd-licensed": "Licensed under the BSD License.",
    "cc0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "epl-2.0": "made available under the terms of the Eclipse Public License 2.0",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "mit": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software"
    ),
    "mpl-1.1": "The contents of this file are subject to the Mozilla Public License Version 1.1",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "public-domain": "This work is in the public domain.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "zlib": (
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, "
        "and to alter it and redistribute it freely"
    ),
}

# fixed values: families of licenses, their versions, and the wording that names them
GNU = {
    "gpl": ("General Public License", ("2", "3")),
    "lgpl": ("Lesser General Public License", ("2.1", "3")),
    "agpl": ("Affero General Public License", ("3",)),
}
GNU_NOTICE = (
    "is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by "
    "the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
)
CREATIVE_COMMONS = {
    "by": "Attribution",
    "by-nc": "Attribution-NonCommercial",
    "by-nc-nd": "Attribution-NonCommercial-NoDerivatives",
    "by-nc-sa": "Attribution-NonCommercial-ShareAlike",
    "by-nd": "Attribution-NoDerivatives",
    "by-sa": "Attribution-ShareAlike",
}
CREATIVE_COMMONS_VERSIONS = ("2.0", "2.5", "3.0", "4.0")
SPDX = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0",
    "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0", "GPL-2.0+", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0",
    "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only",
    "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib",
)


def templates() -> dict[str, str]:
    """All wordings by name: the single ones, and those of the families by version."""
    out = dict(TEXTS)
    for key, (name, versions) in GNU.items():
        for version in versions:
            own = f"{key}-{version if '.' in version else version + '.0'}"
            out[f"{own}-name"] = f"GNU {name}, version {version}"
            out[f"{own}-or-later"] = f"GNU {name}, version {version} or later"
            thing = "library" if version == "2.1" else "program"
            notice = "gpl-notice" if own == "gpl-3.0" else f"{own}-notice"
            out[notice] = f"This {thing} {GNU_NOTICE.format(name=name, version=version)}"
    for key, name in CREATIVE_COMMONS.items():
        for version in CREATIVE_COMMONS_VERSIONS:
            out[f"cc-{key}-{version}"] = f"Licensed under CC {key.upper()} {version}."
            out[f"cc-{key}-{version}-name"] = f"licensed under a Creative Commons {name} {version} International License"
    return out | {f"spdx:{i}": f"SPDX-License-Identifier: {i}" for i in SPDX}


TEMPLATES = templates()

_WORD = re.compile(r"[^\W_]+(?:\.[^\W_]+)*\+?")
_VERSION = re.compile(r"v?(\d+(?:\.\d+)*?)(?:\.0)?(\+?)")
_COMMON = {"public", "domain", "later", "only"}  # names that are everyday words, the last to be anchors
_SENTENCE = re.compile(r"[.!?;:]|\n\s*\n")

NEGATIONS = frozenset("not no never neither nor cannot without except isn aren wasn weren don doesn didn non".split())
# words that tell licenses apart; the ones with a digit come on top
NAMES = frozenset(
    "apache mit bsd isc gnu gpl lgpl agpl mpl epl bsl lesser affero mozilla eclipse boost zlib cc nc sa nd creative "
    "commons noncommercial sharealike noderivatives noderivs public domain unlicense later only clause".split()
)


@dataclass(frozen=True)
class Rules:
    max_changes: float = 0.2  # words missing or added, per word of the template
    before: int = 3  # words before a span, within its sentence, that may not negate it
    level: int = 19


def _fold(word: str) -> str:
    """One form for a word's spellings: case, licence and license, v2.0 and 2."""
    word = word.casefold().replace("licenc", "licens")
    number = _VERSION.fullmatch(word)
    return "".join(number.groups()) if number else "version" if word == "v" else word


def _folded(text: str) -> list[str]:
    return [_fold(w) for w in _WORD.findall(text)]


def binding(words: list[str]) -> Counter:
    """The words that must agree: names, versions and negations."""
    return Counter(w for w in words if w in NAMES or w in NEGATIONS or any(c.isdigit() for c in w))


def wording(template: list[str], block: list[str]) -> tuple[int, int, int, int]:
    """Template words missing, other words in between, and the block's words covered."""
    matches = [m for m in SequenceMatcher(None, template, block, autojunk=False).get_matching_blocks() if m.size]
    # a stray word far from the rest costs more than it brings
    while len(matches) > 1 and matches[0].size < matches[1].b - matches[0].b - matches[0].size:
        matches = matches[1:]
    while len(matches) > 1 and matches[-1].size < matches[-1].b - matches[-2].b - matches[-2].size:
        matches = matches[:-1]
    if not matches:
        return len(template), 0, 0, 0
    first, last = matches[0].b, matches[-1].b + matches[-1].size
    same = sum(m.size for m in matches)
    return len(template) - same, last - first - same, first, last


def anchors(words: list[str], spare: int) -> list[str]:
    """Words of which every copy that lacks at most ``spare`` words holds one."""
    names = [w for w in set(words) if w in NAMES or (any(map(str.isdigit, w)) and any(map(str.isalpha, w)))]
    if names:
        return [min(names, key=lambda w: (w in _COMMON, not w.isalpha(), -len(w), w))]
    once = [w for w, n in Counter(words).items() if n == 1]
    return sorted(once, key=lambda w: (-len(w), w))[: spare + 1]


class Compressors:
    def __init__(self, rules: Rules):
        self.alone = zstandard.ZstdCompressor(level=rules.level, write_content_size=False)
        self.names = sorted(TEMPLATES)
        self.words = {n: _folded(TEMPLATES[n]) for n in self.names}
        self.given = {
            n: zstandard.ZstdCompressor(
                level=rules.level,
                write_content_size=False,
                dict_data=zstandard.ZstdCompressionDict(" ".join(w).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT),
            )
            for n, w in self.words.items()
        }
        self.bags = {n: Counter(w) for n, w in self.words.items()}
        self.binding = {n: binding(w) for n, w in self.words.items()}
        self.spare = {n: int(rules.max_changes * len(w)) for n, w in self.words.items()}
        self.anchors: dict[str, list[tuple[str, int]]] = {}
        for n, words in self.words.items():
            own = set(anchors(words, self.spare[n]))
            for i, w in enumerate(words):
                if w in own:
                    self.anchors.setdefault(w, []).append((n, i))
        hints = sorted(re.escape(w).replace("licens", "licen[cs]") for w in self.anchors)
        self.hint = re.compile("|".join(hints))

    def sizes(self, window: list[str], name: str) -> tuple[int, int]:
        """Bytes of the window's wording compressed alone and given the template."""
        raw = " ".join(window).encode("utf-8", "surrogatepass")
        return len(self.alone.compress(raw)), len(self.given[name].compress(raw))


def _proposed(words: list[str], tools: Compressors) -> Iterator[tuple[str, int, int]]:
    """Templates and the windows of words (from, to) that may hold a copy."""
    places = {(n, i - own) for i, w in enumerate(words) if w in tools.anchors for n, own in tools.anchors[w]}
    for name, at in sorted(places):
        size, spare = len(tools.words[name]), tools.spare[name]
        low, high = max(0, at - spare), min(len(words), at + size + spare)
        if (tools.bags[name] & Counter(words[low:high])).total() >= size - spare:
            yield name, low, high


def _negated(text: str, words: list[str], spans: list[tuple[int, int]], first: int, rules: Rules) -> bool:
    """Whether one of the words before word ``first`` negates it within its sentence."""
    for i in range(first - 1, max(-1, first - 1 - rules.before), -1):
        if _SENTENCE.search(text[spans[i][1] : spans[i + 1][0]]):
            return False
        if words[i] in NEGATIONS:
            return True
    return False


def search(text: str, tools: Compressors, rules: Rules = Rules()) -> tuple[list[tuple], list[tuple]]:
    """Confirmed spans and near misses, each
    (license, start, end, size alone, size given the template, missing, added)."""
    if not tools.hint.search(text.casefold()):
        return [], []
    spans = [m.span() for m in _WORD.finditer(text)]
    words = [_fold(text[a:b]) for a, b in spans]
    return judged(text, words, spans, _proposed(words, tools), tools, rules)


def judged(
    text: str,
    words: list[str],
    spans: list[tuple[int, int]],
    proposed: Iterable[tuple[str, int, int]],
    tools: Compressors,
    rules: Rules,
) -> tuple[list[tuple], list[tuple]]:
    """As ``search``, of given windows."""
    agreed, near = set(), set()
    for name, low, high in proposed:
        alone, given = tools.sizes(words[low:high], name)
        if given >= alone:
            continue
        # what the words around the copy cost is left out of its rank
        missing, added, first, last = wording(tools.words[name], words[low:high])
        if missing + added > tools.spare[name]:
            continue
        first, last = low + first, low + last
        same = binding(words[first:last]) == tools.binding[name] and not _negated(text, words, spans, first, rules)
        place = spans[first][0], spans[last - 1][1]
        alone, given = tools.sizes(words[first:last], name)
        (agreed if same else near).add((given - alone, missing + added, name, *place, alone, given, missing, added))
    kept = _ranked(agreed, tools)
    missed = [c for c in _ranked(near, tools) if all(c[4] <= k[3] or k[4] <= c[3] for k in kept)]
    return [c[2:] for c in kept], [c[2:] for c in missed]


def _ranked(found: set[tuple], tools: Compressors) -> list[tuple]:
    """Of a template's own windows over one place the best worded, then by bytes saved."""
    own = {n: _apart(sorted((c for c in found if c[2] == n), key=lambda c: (c[1], c))) for n in tools.names}
    return sorted(_apart(sorted(c for kept in own.values() for c in kept)), key=lambda c: c[3])


def find(text: str, tools: Compressors, rules: Rules = Rules()) -> list[tuple]:
    """(license, start, end, size alone, size given the template, missing, added)."""
    return search(text, tools, rules)[0]


def _apart(ranked: list[tuple]) -> list[tuple]:
    """Those that do not overlap one before them; ``ranked`` has start and end at 3 and 4."""
    out: list[tuple] = []
    starts: list[int] = []
    for c in ranked:
        at = bisect_right(starts, c[3])
        if (at == 0 or out[at - 1][4] <= c[3]) and (at == len(out) or c[4] <= starts[at]):
            out.insert(at, c)
            starts.insert(at, c[3])
    return out


_ROW = "license:string,start:int,end:int,size_alone:int,size_given:int,words_missing:int,words_added:int"


def notices(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``doc_id``, ``found``, the confirmed spans of every row, and ``near``, the near misses."""
    names = [c.split(":")[0] for c in _ROW.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        tools = Compressors(rules)
        for b in batches:
            both = [search(t, tools, rules) if t else ([], []) for t in b.column(1).to_pylist()]
            found, near = ([[dict(zip(names, f)) for f in pair[i]] for pair in both] for i in (0, 1))
            yield {"doc_id": b.column(0), "found": found, "near": near}

    schema = f"doc_id bigint, found array<struct<{_ROW}>>, near array<struct<{_ROW}>>"
    return map_rows(docs.select("doc_id", "text"), run, schema, batch=1000)


def scan(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per document: its licenses, how many spans have the exact wording, and the
    spans that differ from a license in a name, a version or a negation."""
    found = notices(docs, rules)
    exact = F.filter("found", lambda f: (f["words_missing"] == 0) & (f["words_added"] == 0))

    def labels(column: str) -> Column:
        label = F.transform(
            column, lambda f: F.concat_ws(":", f["license"], f["start"].cast("string"), f["end"].cast("string"))
        )
        return F.array_join(label, ",")

    return found.select(
        "doc_id",
        F.size("found").cast("long").alias("n_notices"),
        F.size(exact).cast("long").alias("n_exact"),
        F.array_join(F.array_sort(F.array_distinct(F.col("found.license"))), ",").alias("licenses"),
        labels("found").alias("blocks"),
        labels("near").alias("near_misses"),
        F.aggregate("found", F.lit(0).cast("long"), lambda n, f: n + f["size_alone"] - f["size_given"]).alias("bytes_saved"),
    )
