"""License scans by diagonal voting.

All rolling hashes of ``GRAM`` words of the documents are joined with the places of the same hashes
in license templates. A match votes for its diagonal, the difference of the two places. Votes are
summed for each text, template and diagonal; neighbouring diagonals of one template, as small
edits make them, are merged; and spans with enough votes are verified on the words themselves.
Short phrases are templates that must match word for word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graincart.llm.common import broadcast_if_small, materialize, small_batches, text_key
from graincart.llm.hashing import plain_words, rolling, word_hashes

GRAM = 3


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    exact: bool = False


#: Phrases that count wherever their words stand, the base of the scan.
PHRASES = (
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
)
#: Well-known openings of license texts and notices.
NOTICES = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    Template("mit", "Released under the MIT License."),
    Template("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    Template("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    Template("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    Template("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    Template("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    Template("gpl-2", "This work is licensed under the GNU General Public License, version 2."),
    Template("lgpl-3", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    Template("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    Template("agpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    Template("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    Template("bsl-1", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software"),
    Template("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    Template("epl-2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    Template("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    Template("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    Template("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0."),
)
#: The share of a template's words that a verified span repeats in order, and how far merged diagonals may lie apart.
LEAST, APART = 0.8, 4


def _grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"key": batch["key"], "grams": [rolling(word_hashes(plain_words(t)), GRAM).view(np.int64) for t in batch["text"]]})


def _verified(batches: Iterator[pd.DataFrame], templates: tuple[Template, ...], words: list[list[bytes]]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for key, text, spans in zip(batch["key"], batch["text"], batch["spans"], strict=True):
            have, notices = plain_words(text), []
            for span in spans:
                want, t = words[span["template"]], span["template"]
                if templates[t].exact:
                    start, end, score = span["low"], span["low"] + len(want), 1.0
                    if start < 0 or have[start:end] != want:
                        continue
                else:
                    start, end = max(0, span["low"]), min(len(have), span["high"] + len(want))
                    same = [m for m in SequenceMatcher(None, have[start:end], want, autojunk=False).get_matching_blocks() if m.size]
                    score = sum(m.size for m in same) / len(want)
                    if score < LEAST:
                        continue
                    notices.append((-score, start + same[0].a, start + same[-1].a + same[-1].size, t))
                    continue
                out.append((key, t, start, end, score))
            # of notices that overlap, as versions of one license do, the best one stands
            kept = []
            for score, start, end, t in sorted(notices):
                if all(end <= a or start >= b or templates[t].label == label for a, b, label in kept):
                    kept.append((start, end, templates[t].label))
                    out.append((key, t, start, end, -score))
        yield pd.DataFrame(out, columns=["key", "template", "start", "end", "score"])


def license_spans(docs: DataFrame, templates: tuple[Template, ...] = PHRASES + NOTICES) -> DataFrame:
    """(key, template, start, end, score): verified spans of words of each text; key is the text's md5.

    Null texts have no spans, and equal texts share theirs. Any number of spans of one text is kept,
    and texts of any length are read whole. Of notices of different labels that overlap the one with
    the best score stands; of equal scores the one that starts first. Other columns are ignored.
    """
    spark = docs.sparkSession
    words = [plain_words(t.text) for t in templates]
    places = [(i, p, int(h)) for i, w in enumerate(words) for p, h in enumerate(rolling(word_hashes(w), GRAM).view(np.int64))]
    # the table of template places is fixed by the list of templates: some hundred rows
    places = F.broadcast(spark.createDataFrame(places, "template int, place int, gram long"))
    texts = docs.where("text is not null").select(F.md5("text").alias("key"), "text")
    small_batches(spark)
    grams = texts.mapInPandas(_grams, "key string, grams array<long>").select("key", F.posexplode("grams").alias("at", "gram"))
    votes = grams.join(places, "gram").select("key", "template", (F.col("at") - F.col("place")).alias("diagonal"), "place")
    votes = votes.groupBy("key", "template", "diagonal").agg(F.count_distinct("place").alias("votes"))

    sizes = F.element_at(F.array(*[F.lit(len(w)) for w in words]), F.col("template") + 1)
    exact = F.element_at(F.array(*[F.lit(t.exact) for t in templates]), F.col("template") + 1)
    order = Window.partitionBy("key", "template").orderBy("diagonal")
    votes = votes.withColumn("size", sizes).withColumn("exact", exact)
    step = F.col("diagonal") - F.lag("diagonal").over(order)
    votes = votes.withColumn("new", F.coalesce((step > APART) | F.col("exact"), F.lit(True)).cast("long"))
    votes = votes.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = votes.groupBy("key", "template", "run", "size", "exact").agg(F.min("diagonal").alias("low"), F.max("diagonal").alias("high"), F.sum("votes").alias("votes"))
    # a word that differs costs up to GRAM votes
    least = F.when(F.col("exact"), F.col("size") - GRAM + 1).otherwise(F.greatest(F.ceil((F.col("size") - GRAM + 1) * (1 - GRAM * (1 - LEAST))), F.lit(1)))
    runs = runs.where(F.col("votes") >= least)
    runs = materialize(runs.groupBy("key").agg(F.collect_list(F.struct("template", "low", "high")).alias("spans")))
    near = texts.join(broadcast_if_small(runs), "key").dropDuplicates(["key"])
    return near.mapInPandas(lambda batches: _verified(batches, templates, words), "key string, template int, start int, end int, score double")


def license_digests(docs: DataFrame, templates: tuple[Template, ...] = PHRASES + NOTICES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of each row of ``docs``.

    A null text counts as empty: no words, no labels, score 0. Repeated rows have equal results.
    An empty table gives an empty result. The score is that of the best verified span, as the
    share of its template's words that it repeats. Only doc_id and text are read.
    """
    found = license_spans(docs, templates)
    label = F.element_at(F.array(*[F.lit(t.label) for t in templates]), F.col("template") + 1)
    base = F.element_at(F.array(*[F.lit(t.exact) for t in templates]), F.col("template") + 1)
    found = found.withColumn("label", label).withColumn("base", base).groupBy("key").agg(
        F.count(F.when(F.col("base"), 1)).alias("n_base"),
        F.min(F.when(F.col("base"), F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).cast("long").alias("last_word"),
        F.collect_set(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
        F.collect_set("label").alias("labels"),
        F.max("score").alias("score"),
    )
    found = broadcast_if_small(materialize(found))
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")
    rows = docs.select("doc_id", words.alias("n_words"), text_key(F.col("doc_id"), F.col("text")).alias("key")).join(found, "key", "left")
    joined = lambda c: F.coalesce(F.array_join(F.array_sort(c), ","), F.lit("")).alias(c)
    n_base = F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base")
    score = F.least(F.coalesce("score", F.lit(0.0)), F.lit(1.0)).alias("score")
    return rows.select("doc_id", "n_words", n_base, "first_word", "last_word", joined("base_labels"), joined("labels"), score)
