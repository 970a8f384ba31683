"""License scans: notices that stand around cues word by word, ranked by compression with each template as a zstandard dictionary."""
import bisect
import difflib
import math
import re
from collections import Counter

import zstandard
from pyspark.sql import functions as F

from .common import bound_batches, read_table
from .registry import query

#: Fixed wordings by license, as their stewards publish them (headers and notices that texts carry).
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.",
                   'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
                   "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
                     "Use of this source code is governed by a BSD-style license."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
                "Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "MIT": ("Released under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
}
#: Words that announce a notice. Those of one cue may stand on two lines, with a comment mark in front of the second.
CUE = re.compile(r"licen[sc]e|permission\W+(?:\w{1,3}\W+)?is\W+(?:\w{1,3}\W+)?hereby|redistribution\W+(?:\w{1,3}\W+)?and\W+(?:\w{1,3}\W+)?use|"
                 r"free\W+(?:\w{1,3}\W+)?software", re.IGNORECASE)
#: A block is what lies within so many characters of a cue, across line breaks.
REACH = 400
#: A template is confirmed when at least this share of its words stands in the block, in order, with few others between, or anyhow in a cue's own line.
WORDING = 0.85
LEVEL = 3

_tokens = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
_cased = re.compile(r"[A-Za-z0-9]+(?:[.-][A-Za-z0-9]+)*")


def tokens(text):
    return _tokens.findall(text.lower())


def blocks(text):
    """Candidate blocks ``(start, end)`` in code points: the surroundings of every cue, joined where they overlap."""
    found = []
    for cue in CUE.finditer(text):
        start, end = max(0, cue.start() - REACH), min(len(text), cue.end() + REACH)
        if found and start <= found[-1][1]:
            found[-1] = (found[-1][0], end)
        else:
            found.append((start, end))
    return found


def lines(text, block):
    """``(start, end)`` of the part of its own line that lies within ``REACH`` of each cue of a block."""
    found = []
    for cue in CUE.finditer(text, *block):
        end = text.find("\n", cue.end())
        found.append((max(text.rfind("\n", 0, cue.start()) + 1, cue.start() - REACH), min(len(text) if end < 0 else end, cue.end() + REACH)))
    return found


def windows(want, have):
    """``(first, last, same)`` for the places in ``have`` that hold at least ``WORDING`` of the words ``want`` in order; they do not overlap.

    A place has at most half as many other words (or four) as ``want`` has. For each word of ``want`` and number of words dropped before it, the
    latest possible first word is carried along, so a block of any length is passed over once.
    """
    m = len(want)
    drops, longest = m - math.ceil(WORDING * m), m + max(4, m // 2)
    places, first, found = {}, [[-1] * (drops + 1) for _ in range(m)], []
    for i, word in enumerate(want):
        places.setdefault(word, []).insert(0, i)
    for j, word in enumerate(have):
        for i in places.get(word, ()):
            if i <= drops:
                first[i][i] = j
            for skip in range(min(drops, i - 1) + 1 if i else 0):
                for d in range(drops - skip + 1):
                    first[i][d + skip] = max(first[i][d + skip], first[i - 1 - skip][d])
            for d in range(drops - (m - 1 - i) + 1):
                if first[i][d] >= 0 and j - first[i][d] < longest and Judge._names(want, have[first[i][d]:j + 1]):
                    found.append((first[i][d], j, i + 1 - d))
    kept, taken = [], set()
    for window in sorted(found, key=lambda w: (-w[2], w[1] - w[0], w[0])):
        if taken.isdisjoint(held := range(window[0], window[1] + 1)):
            taken.update(held)
            kept.append(window)
    return kept


class Judge:
    """The templates as raw dictionaries, and their words."""

    def __init__(self, templates=TEMPLATES):
        self.forms = [(name, i, form, tokens(form)) for name in sorted(templates) for i, form in enumerate(templates[name])]
        self.words = [Counter(want) for *_, want in self.forms]
        self.alone = zstandard.ZstdCompressor(level=LEVEL)
        self.with_form = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(
            form.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for _, _, form, _ in self.forms]
        self.seen = {}

    def gain(self, block, i):
        """Bytes by which template ``i`` as dictionary shortens the compressed block."""
        data = block.lower().encode("utf-8", "surrogatepass")
        return len(self.alone.compress(data)) - len(self.with_form[i].compress(data))

    def ranked(self, block):
        """Templates by how much they shorten the compressed block, largest reduction first; ties in the order of names."""
        return sorted(((self.gain(block, i), i) for i in range(len(self.forms))), key=lambda x: (-x[0], x[1]))

    def best(self, block):
        """``(license, reduction, words kept, words of the template)`` of the first template in rank that the wording confirms, or None."""
        if block not in self.seen:
            if len(self.seen) > 10_000:
                self.seen.clear()
            self.seen[block] = self._best(block)
        return self.seen[block]

    def _best(self, block):
        have = tokens(block)
        held = Counter(have)
        if not any((self.words[i] & held).total() >= WORDING * len(want) for i, (*_, want) in enumerate(self.forms)):
            return None
        for gain, i in self.ranked(block):
            if gain <= 0:
                break
            name, _, _, want = self.forms[i]
            same = sum(m.size for m in difflib.SequenceMatcher(None, want, have, autojunk=False).get_matching_blocks())
            if same >= WORDING * len(want) and self._names(want, have):
                return name, gain, same, len(want)
        return None

    def findings(self, text, block):
        """``(start, stop, license, reduction, same, of)`` of every notice in a block. Where templates overlap, the one with the largest reduction stays.

        A line in which a cue stands is also judged as a whole; that counts when its license is not found in it otherwise.
        """
        start, end = block
        spots = [(m.start() + start, m.end() + start, m[0].lower()) for m in _cased.finditer(text[start:end])]
        have = [word for *_, word in spots]
        held, found = Counter(have), []
        for i, (name, _, _, want) in enumerate(self.forms):
            if (self.words[i] & held).total() >= WORDING * len(want):
                for first, last, same in windows(want, have):
                    a, b = spots[first][0], spots[last][1]
                    if (gain := self.gain(text[a:b], i)) > 0:
                        found.append((a, b, name, gain, same, len(want), range(first, last + 1)))
        kept, taken, ends = [], set(), {}
        for *hit, words in sorted(found, key=lambda h: (-h[3], h[0])):
            if taken.isdisjoint(words):
                taken.update(words)
                kept.append(tuple(hit))
        for a, b, name, *_ in sorted(kept):
            ends.setdefault(name, []).append((a, b))
        for a, b in dict.fromkeys(lines(text, block)):
            hit = self.best(text[a:b])
            near = ends.setdefault(hit[0], []) if hit else []
            place = bisect.bisect_left(near, (b,))
            if hit and not (place and near[place - 1][1] > a):
                near.insert(place, (a, b))
                kept.append((a, b, *hit))
        return sorted(kept)

    @staticmethod
    def _names(want, have):
        """Words with a digit or hyphen (versions, variants) tell licenses apart and must all stand in the block."""
        return set(w for w in want if re.search(r"[0-9-]", w)) <= set(have)


SCHEMA = "doc_id long, n_blocks long, license string, findings array<struct<start:int,stop:int,license:string,reduction:int,same:int,of:int>>"


def scan(docs, templates=None):
    """One row per row of ``docs``: ``doc_id, n_blocks, license, findings``. ``license`` is the confirmed one with the largest reduction, else null.

    Whole texts are read; null and empty ones have no blocks. Rows are judged one by one, so nothing is shuffled and equal rows give equal results.
    """
    bound_batches(docs.sparkSession)
    templates = templates or TEMPLATES

    def run(batches):
        import pandas as pd
        judge = Judge(templates)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                cut = blocks(text) if text else []
                hits = [hit for block in cut for hit in judge.findings(text, block)]
                top = min(hits, key=lambda h: (-h[3], h[0]), default=None)
                out.append((doc_id, len(cut), top and top[2], [dict(zip(("start", "stop", "license", "reduction", "same", "of"), h, strict=True)) for h in hits]))
            yield pd.DataFrame(out, columns=["doc_id", "n_blocks", "license", "findings"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, SCHEMA)


@query("op8_license_scans")
def op8(spark, sf_dir):
    return scan(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_blocks", "license", "findings")
