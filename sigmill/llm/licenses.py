"""Licence scans by sentence rules.

Known licence sentences form a tree of normalised words; numbers are kept aside as the version. Wherever a
text, line or sentence begins, the tree is walked as far as the words lead, across line breaks and comment
signs, and the longest known sentence that ends where a sentence or line ends gives its identifier. The
identifiers of a document, in order, are then matched against ordered rules, of which the first that fits
wins and uses up its sentences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from sigmill.llm.common import arrow_map, blank, steps

#: Identifier and wording of known sentences; ``<n>`` stands for a version. Fixed values, from the public licence texts.
SENTENCES = (
    ("apache-line", "Licensed under the Apache License, Version <n>"),
    ("apache-head", 'Licensed under the Apache License, Version <n> (the "License"); you may not use this file except in compliance with the License'),
    ("apache-copy", "You may obtain a copy of the License at"),
    ("apache-asis", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied'),
    ("mit-line", "Released under the MIT License"),
    ("mit-line", "Licensed under the MIT License"),
    ("mit-line", "This project is licensed under the MIT License"),
    ("mit-grant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions'),
    ("mit-notice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit-asis", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT'),
    ("bsd-line", "Released under the BSD License"),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd-names", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("gpl-line", "This work is licensed under the GNU General Public License, version <n>"),
    ("gpl-line", "Licensed under the GNU General Public License, version <n>"),
    ("gpl-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version <n> of the License, or (at your option) any later version"),
    ("gpl-only", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version <n> as published by the Free Software Foundation"),
    ("lgpl-line", "Licensed under the GNU Lesser General Public License, version <n>"),
    ("mpl-head", "This Source Code Form is subject to the terms of the Mozilla Public License, v. <n>"),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense-head", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "Licensed under CC BY <n>"),
    ("cc-by-sa", "Licensed under CC BY-SA <n>"),
    ("cc-by-nc", "Licensed under CC BY-NC <n>"),
    ("cc-by-nd", "Licensed under CC BY-ND <n>"),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA <n>"),
    ("cc-by-nc-nd", "Licensed under CC BY-NC-ND <n>"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution <n> International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike <n> International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial <n> International License"),
)

#: Ordered rules: name and sentence identifiers in sequence. ``{}`` takes the version. Longer ones come first.
RULES = (
    ("Apache-{}", ("apache-head", "apache-copy", "apache-asis")),
    ("Apache-{}", ("apache-head", "apache-copy")),
    ("Apache-{}", ("apache-head",)),
    ("Apache-{}", ("apache-line",)),
    ("MIT", ("mit-line", "mit-grant", "mit-notice", "mit-asis")),
    ("MIT", ("mit-grant", "mit-notice", "mit-asis")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-line",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD", ("bsd-line",)),
    ("GPL-{}-or-later", ("gpl-later",)),
    ("GPL-{}-only", ("gpl-only",)),
    ("GPL-{}", ("gpl-line",)),
    ("LGPL-{}", ("lgpl-line",)),
    ("MPL-{}", ("mpl-head",)),
    ("ISC", ("isc-grant",)),
    ("Unlicense", ("unlicense-head",)),
    ("CC-BY-NC-SA-{}", ("cc-by-nc-sa",)),
    ("CC-BY-NC-ND-{}", ("cc-by-nc-nd",)),
    ("CC-BY-NC-{}", ("cc-by-nc",)),
    ("CC-BY-SA-{}", ("cc-by-sa",)),
    ("CC-BY-ND-{}", ("cc-by-nd",)),
    ("CC-BY-{}", ("cc-by",)),
    # A sentence whose neighbours are missing still tells the licence it comes from.
    ("Apache-{}", ("apache-copy", "apache-asis")),
    ("Apache-{}", ("apache-copy",)),
    ("Apache-{}", ("apache-asis",)),
    ("MIT", ("mit-grant",)),
    ("MIT", ("mit-notice", "mit-asis")),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-asis",)),
    ("BSD", ("bsd-grant",)),
    ("BSD", ("bsd-source", "bsd-binary")),
    ("BSD", ("bsd-source",)),
    ("BSD", ("bsd-binary",)),
    ("BSD-3-Clause", ("bsd-names",)),
    ("{}", ("spdx",)),
)

_WORD = re.compile(r"<n>|[0-9]+(?:\.[0-9]+)*|[A-Za-z]+(?:[-'’][A-Za-z]+)*")
_NUMBER = re.compile(r"[0-9]")
#: A licence tag; its expression is the licence.
_SPDX = re.compile(r"\bSPDX-License-Identifier:[ \t]*(\(?[A-Za-z0-9][A-Za-z0-9.+-]*(?:[ \t]+(?:AND|OR|WITH)[ \t]+[A-Za-z0-9][A-Za-z0-9.+-]*)*)")
#: What must follow a sentence: a closing sign, or the end of the line or text.
_END = re.compile(r"[\"')\]]*(?:[.;:!?,](?:\s|$)|[ \t\r]*(?:\n|$))")


def words(text: str, at: int = 0) -> Iterator[tuple[str, str, int, int]]:
    """Normalised words from a position on: the word (``<n>`` for a number), as it stands, start and end."""
    for m in _WORD.finditer(text, at):
        w = m.group()
        yield ("<n>" if w == "<n>" or _NUMBER.match(w) else w.lower()), w, m.start(), m.end()


def _grown() -> dict:
    root: dict = {}
    for name, sentence in SENTENCES:
        node = root
        for w, *_ in words(sentence):
            node = node.setdefault(w, {})
        node[""] = name
    return root


TREE = _grown()
#: Places where a known sentence may begin: after a sign or line break, and any comment signs.
_START = re.compile(r"(?:^|[.;:!?\n])[\s#*/;%>\"'(-]*\b(" + "|".join(sorted(TREE)) + r")\b", re.IGNORECASE)


def sentences(text: str) -> list[tuple[str, str | None, int, int]]:
    """Known sentences of a text in order: identifier, version, start and end. None overlap."""
    found, done, at = [], 0, 0
    while (m := _START.search(text, at)) is not None:
        start, node, version, best = m.start(1), TREE, None, None
        at = m.end(1) - 1
        if start < done:
            continue
        for w, raw, _, end in words(text, start):
            node = node.get(w)
            if node is None:
                break
            version = raw if w == "<n>" else version
            if "" in node and _END.match(text, end):
                best = (node[""], version, start, end)
        if best:
            found.append(best)
            done = best[3]
            at = max(at, done - 1)
    tags = [("spdx", m.group(1).strip("()"), m.start(), m.end()) for m in _SPDX.finditer(text)]
    return sorted(found + tags, key=lambda s: s[2]) if tags else found


def matches(known: list[tuple[str, str | None, int, int]]) -> list[tuple[str, str, int, int, int]]:
    """Licence, rule, number of sentences, start and end, by the first rule that fits at each sentence."""
    out, i = [], 0
    while i < len(known):
        for licence, rule in RULES:
            own = known[i : i + len(rule)]
            if tuple(s[0] for s in own) == rule:
                version = next((s[1] for s in own if s[1]), None)
                out.append((licence.replace("{}", version or "unknown"), "+".join(rule), len(rule), own[0][2], own[-1][3]))
                i += len(rule)
                break
        else:
            i += 1
    return out


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, match, license, rule, n_sentences, start, end``, a row per licence found, over whole texts.

    Positions are in code points. A null or empty text has no rows. Rows that repeat a ``doc_id`` are
    scanned each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            ids, rows = [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for k, m in enumerate(matches(sentences(text))):
                    ids.append(doc)
                    rows.append((k, *m))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            types = (pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field("doc_id").type), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]],
                ["doc_id", "match", "license", "rule", "n_sentences", "start", "end"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, match int, license string, rule string, n_sentences int, start bigint, end bigint"
    return arrow_map(docs.select("doc_id", blank().alias("text")), run, schema)
