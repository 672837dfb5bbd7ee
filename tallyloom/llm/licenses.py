"""License scans by MinHash bands over text windows (operator 9).

Templates of licenses and notices are cut into five-word shingles (A-Z
lower-cased, punctuation around words dropped) and sorted into classes by size.
For each class a document's shingles are cut into overlapping windows of twice the
class's largest size u, starting every u shingles, so any passage of that size
lies within a window. Windows and templates have 32 minimum hashes, each a
band of its own. A window that holds 80 % of a template of n shingles, u/2 < n <= u,
has a Jaccard similarity of 0.8 n / (2 u + 0.2 n) or more, which is at least 0.19,
and meets the template in a band with a probability over 0.998 (over
1 - 1e-6 where n = u). Candidates are verified by exact containment of shingles, for each
occurrence of its own: a run of the template's shingles with gaps of at most n.

Everything happens where the document lies: nothing is shuffled or collected.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .base import mix, pieces, prepare, shingles, text_buffer, words

WIDTH = 5
PERCENT = 80
BANDS = 32
#: Templates that a table may hold: each task has them all.
MOST_TEMPLATES = 10_000

#: License notices by identifier.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "Proprietary": ("All rights reserved.", "Unauthorized copying of this file, via any medium, is strictly prohibited."),
}

_EDGE = np.zeros(256, dtype=bool)
_EDGE[[ord(c) for c in "\"'()[]{}<>.,;:!?*#/\\-_=|&%$"]] = True


def _shingles(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of words without surrounding punctuation, their row, and their first word's start and last word's end."""
    clean = buf.copy()
    space = (buf == 32) | (buf >= 9) & (buf <= 13)
    punct = _EDGE[buf]
    # Punctuation next to white space, to other such punctuation or to a text's edge becomes a blank.
    for ahead in (False, True):
        run = ~punct
        index = np.arange(len(buf))
        if ahead:
            nearest = np.minimum.accumulate(np.where(run, index, len(buf))[::-1])[::-1]
            at_space = np.where(nearest < len(buf), space[np.minimum(nearest, len(buf) - 1)], True)
            limit = offsets[np.minimum(np.searchsorted(offsets, index, side="right"), len(offsets) - 1)]
            at_space |= nearest >= limit
        else:
            nearest = np.maximum.accumulate(np.where(run, index, -1))
            at_space = np.where(nearest >= 0, space[np.maximum(nearest, 0)], True)
            limit = offsets[np.searchsorted(offsets, index, side="right") - 1]
            at_space |= nearest < limit
        clean[punct & at_space] = 32
    h, row, start, end = words(clean, offsets)
    n_rows = len(offsets) - 1
    s, at = shingles(h, row, n_rows, WIDTH)
    count = np.bincount(row, minlength=n_rows)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    made = np.maximum(0, count - WIDTH + 1) + ((count > 0) & (count < WIDTH))
    nth = np.arange(len(s)) - np.repeat(np.cumsum(made) - made, made)
    begin = first[at] + nth
    last = np.minimum(begin + WIDTH, first[at] + count[at]) - 1
    return s, at, start[begin] if len(s) else begin, end[last] if len(s) else begin


def _listed(templates: Mapping[str, Sequence[str]] | DataFrame | None) -> tuple[tuple[str, str], ...]:
    """(license, notice) of all templates."""
    if templates is None:
        templates = TEMPLATES
    if isinstance(templates, DataFrame):
        rows = templates.where("license is not null and text is not null").select("license", "text").distinct().limit(MOST_TEMPLATES + 1).collect()
        if len(rows) > MOST_TEMPLATES:
            raise ValueError(f"more than {MOST_TEMPLATES} templates")
        return tuple(sorted((r["license"], r["text"]) for r in rows))
    return tuple((name, notice) for name, notices in templates.items() for notice in notices)


@lru_cache(maxsize=1)
def index(templates: tuple[tuple[str, str], ...]) -> tuple[list[tuple[int, str, np.ndarray]], dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Templates (their number, license and shingles), and by class (largest size) their bands."""
    kept, classes = [], {}
    for number, (name, notice) in enumerate(templates):
        if len(notice.split()) >= WIDTH:
            raw = np.frombuffer(notice.encode(), np.uint8)
            kept.append((number, name, np.unique(_shingles(raw, np.array([0, len(raw)]))[0])))
    salts = _salts()
    for i, (_, _, s) in enumerate(kept):
        largest = 1 << int(len(s) - 1).bit_length()
        mins = np.array([mix(s ^ salt).min() for salt in salts])
        classes.setdefault(largest, []).append((i, mins))
    by_class = {k: (np.array([i for i, _ in v]), np.stack([m for _, m in v])) for k, v in classes.items()}
    return kept, by_class


def _salts() -> np.ndarray:
    return mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def retrieve(s: np.ndarray, at: np.ndarray, n_rows: int, by_class: dict[int, tuple[np.ndarray, np.ndarray]]) -> set[tuple[int, int]]:
    """Candidates (row, template) whose windows meet a template in a band."""
    found: set[tuple[int, int]] = set()
    if not len(s):
        return found
    first = np.searchsorted(at, np.arange(n_rows + 1))
    begins, owners = {}, {}
    for largest in by_class:
        n = np.diff(first)
        windows = np.where(n > 0, np.maximum(1, -(-(n - largest) // largest)), 0)
        owner = np.repeat(np.arange(n_rows), windows)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        begins[largest], owners[largest] = first[owner] + nth * largest, owner
    for k, salt in enumerate(_salts()):
        h = mix(s ^ salt)
        for largest, (ids, mins) in by_class.items():
            begin, owner = begins[largest], owners[largest]
            half = np.minimum.reduceat(h, begin)  # up to the next window's begin
            follow = np.concatenate([half[1:], half[-1:]])
            same = np.concatenate([owner[1:] == owner[:-1], [False]])
            least = np.where(same, np.minimum(half, follow), half)
            for j in range(len(ids)):
                hit = np.flatnonzero(least == mins[j, k])
                found.update((int(r), int(ids[j])) for r in owner[hit])
    return found


def occurrences(s: np.ndarray, want: np.ndarray) -> list[tuple[int, int, int]]:
    """(first, last, distinct) matching shingles of each run of ``s`` that holds enough of the template ``want``.

    A run ends where the next match is more than the template's size away, or where it
    holds enough and a shingle of it comes again.
    """
    out: list[tuple[int, int, int]] = []
    hits = np.flatnonzero(np.isin(s, want))
    n, seen = len(want), set()
    begin = before = -1

    def close() -> None:
        if len(seen) * 100 >= n * PERCENT:
            out.append((begin, before, len(seen)))

    for i, x in zip(hits.tolist(), s[hits].tolist(), strict=True):
        if not seen or i - before > n or x in seen and len(seen) * 100 >= n * PERCENT:
            close()
            begin, seen = i, set()
        seen.add(x)
        before = i
    close()
    return out


def _verified(buf: np.ndarray, offsets: np.ndarray, templates: tuple[tuple[str, str], ...]) -> list[list[dict]]:
    n_rows = len(offsets) - 1
    out: list[list[dict]] = [[] for _ in range(n_rows)]
    if not len(buf):
        return out
    s, at, start, end = _shingles(buf, offsets)
    kept, by_class = index(templates)
    first = np.searchsorted(at, np.arange(n_rows + 1))
    for row, i in sorted(retrieve(s, at, n_rows, by_class)):
        number, name, want = kept[i]
        base = first[row]
        for a, b, shared in occurrences(s[base : first[row + 1]], want):
            place = {"start": int(start[base + a] - offsets[row]), "end": int(end[base + b] - offsets[row])}
            out[row].append({"license": name, "template": number, "containment": shared / len(want), **place})
    return out


MATCHES = "array<struct<license:string,template:int,containment:double,start:int,end:int>>"
_TYPE = pa.list_(pa.struct([("license", pa.string()), ("template", pa.int32()), ("containment", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))


def find_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Mapping[str, Sequence[str]] | DataFrame | None = None) -> DataFrame:
    """``doc_id`` and ``licenses``: every occurrence of a template of which 80 % or more stand together in a whole text.

    ``templates`` gives notices by license, as a mapping or as a table of ``license`` and ``text``;
    those of this module by default. ``template`` is a notice's number in that list (in a table's, by license and text), and
    ``start`` and ``end`` (bytes of the UTF-8 text) span an occurrence. A
    null or empty text has none. Notices of fewer than five words have no shingle of
    their own and match where they are a whole line, or end one that has a copyright mark before them. Repeated
    rows stay repeated; an empty table gives an empty result; other columns are not read.
    """
    listed = _listed(templates)
    prepare(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = text_buffer(batch.column(1))
            found: list[list[dict]] = []
            for a, b in pieces(off):
                part = buf[off[a] : off[b]]
                rows = _verified(part, off[a : b + 1] - off[a], listed)
                _add_lines(part, off[a : b + 1] - off[a], rows, listed)
                found += rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _TYPE)], names=["doc_id", "licenses"])

    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInArrow(work, f"doc_id long, licenses {MATCHES}")


_MARKS = (b"copyright", b"(c)", "©".encode())


def _add_lines(buf: np.ndarray, offsets: np.ndarray, rows: list[list[dict]], templates: tuple[tuple[str, str], ...]) -> None:
    """Notices of fewer than five words, where they are a whole line or end one with a copyright mark."""
    low = buf.tobytes().lower()
    for number, (name, notice) in enumerate(templates):
        key = notice.lower().rstrip(".").encode()
        if len(notice.split()) >= WIDTH or not key:
            continue
        at = low.find(key)
        while at >= 0:
            row = int(np.searchsorted(offsets, at, side="right")) - 1
            a, b = int(offsets[row]), int(offsets[row + 1])
            stop = at + len(key)
            before = low[max(a, low.rfind(b"\n", a, at) + 1) : at]
            line_end = low.find(b"\n", stop, b)
            after = low[stop : line_end if line_end >= 0 else b]
            marked = before[-1:].isspace() and any(m in before for m in _MARKS)
            if stop <= b and (marked or not before.strip()) and after.strip(b" .\t\r") == b"":
                rows[row].append({"license": name, "template": number, "containment": 1.0, "start": at - a, "end": stop - a})
            at = low.find(key, stop)
