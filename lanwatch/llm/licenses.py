"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.

Templates fall into size classes. A class of c words reads windows of 2c words every c words, so any stretch of
c words lies whole inside one window. A window that holds SHARE of a template's shingles has a Jaccard
similarity of at least SHARE * c/2 / (2c + (1 - SHARE) * c/2), about 0.19 with SHARE 0.8; BANDS bands of one row
then retrieve the template with probability 1 - (1 - 0.19) ** 32, over 0.998, and more for templates near their
class size. Windows without any template shingle cannot collide in a band of one row and are skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import read, text_slices

SHINGLE = 3            # words; notices are often one short line
SHARE = 0.8            # of a template's shingles that a window must hold
BANDS = 32             # of one row each
TEMPLATE_ROWS = 20_000 # templates are a parameter, not corpus data; more are refused
SLICE_BYTES = 8 << 20
WORD_CACHE = 400_000

#: Lower case for A-Z, a space for every other ASCII character that is neither letter nor digit.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

# Wordings of well-known public license notices.
NOTICES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0",
                   "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
                   "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                   "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    "MIT": ("Released under the MIT License",
            "Licensed under the MIT License",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2",
                "under the terms of the GNU General Public License as published by the Free Software Foundation; either "
                "version 2 of the License"),
    "LGPL": ("under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",),
    "AGPL-3.0": ("under the terms of the GNU Affero General Public License as published by the Free Software Foundation",),
    "BSD": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met",
            "Use of this source code is governed by a BSD-style license"),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0",),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0",),
    "CC0-1.0": ("dedicated to the public domain under CC0 1.0 Universal",),
    "Unlicense": ("This is free and unencumbered software released into the public domain",),
}


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def shingle_hashes(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """64-bit hashes of the shingles (fewer words: of all of them together; none: nothing)."""
    if not words:
        return np.empty(0, np.uint64)
    for w in [w for w in set(words) if w not in known]:
        known[w] = xxhash.xxh64_intdigest(w)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    k = min(SHINGLE, len(h))
    out = h[:len(h) - k + 1].copy()
    for i in range(1, k):
        out = _mix(out) + h[i:len(h) - k + 1 + i]
    return _mix(out + np.uint64(k))


def _mix(h: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of the shingles under each of BANDS hash functions."""
    seeds = _mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    return _mix(shingles[:, None] ^ seeds).min(axis=0)


class Index:
    """Templates by band and size class."""

    def __init__(self, templates: list[tuple[str, str]]):
        known: dict[bytes, int] = {}
        self.sets: list[tuple[str, np.ndarray]] = []
        self.buckets: dict[tuple[int, int, int], list[int]] = {}
        self.classes: set[int] = set()
        for name, text in sorted(set(templates)):
            words = words_of(text)
            shingles = np.unique(shingle_hashes(words, known))
            if not len(shingles):
                continue
            size = max(SHINGLE, 1 << (len(words) - 1).bit_length())
            self.classes.add(size)
            for band, value in enumerate(signature(shingles).tolist()):
                self.buckets.setdefault((size, band, value), []).append(len(self.sets))
            self.sets.append((name, shingles))
        self.all = np.unique(np.concatenate([s for _, s in self.sets])) if self.sets else np.empty(0, np.uint64)

    def _alike(self, t: int, u: int) -> bool:
        """Whether half of template t is in template u, of another license."""
        (name, a), (other, b) = self.sets[t], self.sets[u]
        return name != other and 2 * len(np.intersect1d(a, b, assume_unique=True)) >= len(a)

    def matches(self, words: list[bytes], known: dict[bytes, int]) -> list[tuple[str, float, int]]:
        """(license, containment, first word of the window): the best window of each license, by name.

        In one window, a notice gives way to a variant of it, of another license, that is held more fully."""
        shingles = shingle_hashes(words, known)
        if not len(shingles) or not len(self.all):
            return []
        at = np.searchsorted(self.all, shingles)
        hits = np.flatnonzero(self.all[np.minimum(at, len(self.all) - 1)] == shingles)
        best: dict[str, tuple[float, int]] = {}
        for size in sorted(self.classes) if len(hits) else ():
            reach = 2 * size - SHINGLE + 1  # shingles of a window
            starts = np.unique(np.concatenate((hits // size, np.maximum(hits // size - 1, 0)))) * size
            for start in starts.tolist():
                window = np.unique(shingles[start:start + reach])
                if not len(window):
                    continue
                found = {t for band, value in enumerate(signature(window).tolist()) for t in self.buckets.get((size, band, value), ())}
                shares = {t: len(np.intersect1d(self.sets[t][1], window, assume_unique=True)) / len(self.sets[t][1]) for t in found}
                held = [t for t, share in shares.items() if share >= SHARE]
                for t in held:
                    name, share = self.sets[t][0], shares[t]
                    if any(shares[u] > share and self._alike(t, u) for u in held):
                        continue  # a variant of the notice that is really there
                    if name not in best or (share, -start) > (best[name][0], -best[name][1]):
                        best[name] = (share, start)
        return sorted((name, share, start) for name, (share, start) in best.items())


def scan(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """(doc_id, matches array of (license, containment, word)) of every row of `docs`, over the whole text.

    `templates` has license and text; a license may have several texts, of which the best counts. Null and
    empty texts, and templates without words, match nothing. Repeated rows get equal answers. One pass, no
    shuffle: templates travel to the tasks, documents stay where they are.
    """
    rows = templates.select("license", "text").where("license is not null and text is not null").limit(TEMPLATE_ROWS + 1).collect()
    if len(rows) > TEMPLATE_ROWS:
        raise ValueError(f"more than {TEMPLATE_ROWS} templates")
    texts = [(r.license, r.text) for r in rows]
    kind = pa.list_(pa.struct([("license", pa.string()), ("containment", pa.float64()), ("word", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, known = Index(texts), {}
        for part in text_slices(batches, SLICE_BYTES):
            if len(known) > WORD_CACHE:
                known = {}
            found = [[{"license": n, "containment": c, "word": w} for n, c, w in index.matches(words_of(t), known)]
                     for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(found, kind)], ["doc_id", "matches"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, matches array<struct<license:string,containment:double,word:long>>")


def notices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(name, text) for name, texts in NOTICES.items() for text in texts], "license string, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents"), notices(spark))
    return found.select("doc_id", F.size("matches").cast("long").alias("n_licenses"),
                        F.array_join(F.transform("matches", lambda m: m.license), ",").alias("licenses"),
                        F.coalesce(F.array_max(F.transform("matches", lambda m: m.containment)), F.lit(0.0)).alias("containment"),
                        F.array_join(F.transform("matches", lambda m: m.word.cast("string")), ",").alias("words"))
