"""License notices in documents by conditional compression.

The templates give the cues: so many words of each that a block that lacks all of them lacks more words than a
match may. A sentence with a cue is the core of a candidate block, which is widened by neighbouring sentences for
templates of several. Each block is compressed on its own and once with every template as
zstandard raw dictionary. The templates are ranked by how much smaller the block gets; the best ones are
confirmed by the exact differences in wording.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Of a template's words, at most this share may be missing from the block.
MISSING_SHARE = 0.1
# Templates that save at least this share of what the best one saves go to the word comparison.
CONTENDER_SHARE = 0.5

# Wording of common notices.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-full": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software"
    ),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met"
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0.",
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
}

_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")


def wording(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def cue_words(templates: dict[str, str]) -> list[str]:
    """Words of which every block that matches a template has one.

    A match may lack MISSING_SHARE of a template's words, so each template gives one distinct word more than that,
    or all that it has. Long words, and those that serve several templates, come first.
    """
    held = {name: set(wording(text)) for name, text in templates.items()}
    needed = {name: min(len(words), int(MISSING_SHARE * len(wording(templates[name]))) + 1) for name, words in held.items()}
    chosen: list[str] = []
    while open_ := [name for name in held if needed[name] > 0]:
        gains: dict[str, int] = {}
        for name in open_:
            for word in held[name] - set(chosen):
                gains[word] = gains.get(word, 0) + max(len(word) - 3, 0)
        word = max(gains, key=lambda w: (gains[w], len(w), w))
        chosen.append(word)
        for name in open_:
            needed[name] -= word in held[name]
    return sorted(chosen)


def cue_pattern(templates: dict[str, str]) -> str:
    """A pattern that finds any cue, in any case; without templates it finds nothing."""
    words = sorted(cue_words(templates), key=lambda w: (-len(w), w))
    return "(?i)" + ("|".join(map(re.escape, words)) or "(?!)")


class Scanner:
    def __init__(self, templates: dict[str, str]):
        self.cue = re.compile(cue_pattern(templates))
        self.plain = zstandard.ZstdCompressor(level=19)
        self.names = sorted(templates)
        self.words = {n: wording(templates[n]) for n in self.names}
        self.primed = {}
        for name in self.names:
            # Both sides are compared in the same normal form.
            raw = " ".join(self.words[name]).encode()
            held = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.primed[name] = zstandard.ZstdCompressor(level=19, dict_data=held)
        self.longest = max(map(len, self.words.values()), default=0)

    def rank(self, words: list[str]) -> list[tuple[int, str]]:
        """(bytes saved, template) of all templates, best first."""
        block = " ".join(words).encode()
        alone = len(self.plain.compress(block))
        saved = [(alone - len(self.primed[n].compress(block)), n) for n in self.names]
        return sorted(saved, key=lambda s: (-s[0], s[1]))

    def differences(self, name: str, words: list[str]) -> tuple[list[str], list[str], int, int]:
        """Words of the template missing from the block, words of the block put between them, and the words of the block covered."""
        template = self.words[name]
        matcher = SequenceMatcher(None, template, words, autojunk=False)
        blocks = [m for m in matcher.get_matching_blocks() if m.size]
        if not blocks:
            return template, [], 0, 0
        first, last = blocks[0].b, blocks[-1].b + blocks[-1].size
        matched_a = {i for m in blocks for i in range(m.a, m.a + m.size)}
        matched_b = {i for m in blocks for i in range(m.b, m.b + m.size)}
        missing = [w for i, w in enumerate(template) if i not in matched_a]
        added = [words[i] for i in range(first, last) if i not in matched_b]
        return missing, added, first, last

    def confirm(self, words: list[str]) -> tuple | None:
        """(template, bytes saved, missing, added) of the winner, or None.

        The winner is the contender with the fewest differences, then the longest, then the largest saving.
        """
        ranked = self.rank(words)
        if not ranked or ranked[0][0] <= 0:
            return None
        best = None
        for saved, name in ranked:
            if saved < CONTENDER_SHARE * ranked[0][0]:
                break
            missing, added, _, _ = self.differences(name, words)
            size = len(self.words[name])
            if not size or len(missing) + len(added) > MISSING_SHARE * size:
                continue
            if any(c.isdigit() for word in missing for c in word):
                continue  # another version is another license
            key = (len(missing) + len(added), -size, -saved, name)
            if best is None or key < best[0]:
                best = (key, (name, saved, missing, added))
        return best and best[1]


_SENTENCE = re.compile(r"(?<=[.;:!?])\s+|\n+")


def candidates(text: str, longest: int, cue: re.Pattern) -> Iterator[tuple[int, int]]:
    """Candidate blocks (start, end): each sentence with a cue, and the run of sentences around it up to the longest template."""
    edges = [0]
    for gap in _SENTENCE.finditer(text):
        edges += [gap.start(), gap.end()]
    edges.append(len(text))
    sentences = [(a, b) for a, b in zip(edges[::2], edges[1::2], strict=True) if b > a]
    for i, (start, end) in enumerate(sentences):
        if not cue.search(text, start, end):
            continue
        yield start, end
        low, high = i, i
        while low > 0 and len(wording(text[sentences[low - 1][0] : end])) <= longest:
            low -= 1
        while high + 1 < len(sentences) and len(wording(text[start : sentences[high + 1][1]])) <= longest:
            high += 1
        for a in range(low, i + 1):
            for b in range(i, high + 1):
                if (a, b) != (i, i) and len(wording(text[sentences[a][0] : sentences[b][1]])) <= longest:
                    yield sentences[a][0], sentences[b][1]


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row per notice: doc_id, license, start, end (code points), saved_bytes, missing, added (words), exact.

    Every candidate block of the whole text is judged; of overlapping notices the one with fewer differing
    words, then the longer template, stays. Null, empty and cue-less texts have no rows; rows that repeat are
    each scanned; a null doc_id is passed on; other columns are not read. `templates` (name to wording) is
    held by every task, so it must be a list of notices, not a table of documents.
    """
    chosen = dict(TEMPLATES if templates is None else templates)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, known = Scanner(chosen), {}
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hits = []
                for start, end in candidates(text, scanner.longest, scanner.cue):
                    words = wording(text[start:end])
                    key = " ".join(words)
                    if key not in known:
                        if len(known) > 50_000:
                            known.clear()
                        known[key] = scanner.confirm(words)
                    if known[key]:
                        name, saved, missing, added = known[key]
                        hits.append((len(missing) + len(added), -len(scanner.words[name]), end - start, start, end, name, saved, missing, added))
                taken: list[tuple[int, int]] = []
                for _, _, _, start, end, name, saved, missing, added in sorted(hits, key=lambda h: h[:6]):
                    if all(end <= a or start >= b for a, b in taken):
                        taken.append((start, end))
                        rows.append((doc_id, name, start, end, saved, missing, added, not missing and not added))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names
                )

    words = pa.list_(pa.string())
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), words, words, pa.bool_()]
    names = ["doc_id", "license", "start", "end", "saved_bytes", "missing", "added", "exact"]
    schema = (
        "doc_id bigint, license string, start bigint, end bigint, saved_bytes bigint, "
        "missing array<string>, added array<string>, exact boolean"
    )
    return docs.select("doc_id", "text").filter(F.col("text").rlike(cue_pattern(chosen))).mapInArrow(scan, schema)
