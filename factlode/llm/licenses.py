"""License scans by diagonal voting.

All rolling word 4-gram hashes of the texts are joined to the positions of the templates' 4-grams. Each meeting votes for
a diagonal, its place in the text less its place in the template. Neighbouring diagonals (words put in or
left out) are merged into spans, and a span is verified by the share of the template's words that its votes cover,
each word by equal hashes of four words. Short phrases that name a license are found beside it in the same words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _words

GRAM = 4
#: Votes this many words apart in diagonal belong together; a span needs this share of the template's words.
DRIFT = 8
COVERAGE = 0.6

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Notices of public licenses, by label.
TEMPLATES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
    "apache": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License.""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list
of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "mpl": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "cc-by": """This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of
this license, visit http://creativecommons.org/licenses/by/4.0/""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means.""",
}


def _split(texts: list[bytes]) -> _words.Words:
    return _words.words([t.lower() for t in texts], _words.PLAIN)


def template_grams(templates: dict[str, str]) -> list[tuple[int, str, int, int]]:
    """(hash, label, position, words of the template) of every gram of every template."""
    out = []
    for label, text in templates.items():
        w = _split([text.encode()])
        hashes = _words.grams(w.hash, GRAM).view(np.int64)
        out += [(int(h), label, i, len(w.hash)) for i, h in enumerate(hashes)]
    return out


def _rolling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rolling gram hashes of a text, by position. In: doc_id, th, text. Out: doc_id, th, grams."""
    for rows, texts in _words.sliced(batches, "text"):
        out: list[np.ndarray] = []
        for _, some in _words.groups(texts):
            w = _split(some)
            hashes = _words.grams(w.hash, GRAM).view(np.int64)
            out += [hashes[a : max(a, b - GRAM + 1)] for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([rows["doc_id"], rows["th"], pa.array(out, pa.list_(pa.int64()))], ["doc_id", "th", "grams"])


def phrase_places(w: _words.Words, phrases: dict[str, str]) -> dict[str, np.ndarray]:
    """Word positions within the group at which each phrase stands within one text; a shared hash is compared by bytes."""
    out = {}
    end = w.first[1:][w.owner] if len(w.hash) else np.zeros(0, int)
    for phrase in phrases:
        parts = [p.encode() for p in phrase.split()]
        want = _words.words(parts, _words.PLAIN).hash
        n = len(w.hash) - len(parts) + 1
        if n <= 0:
            out[phrase] = np.zeros(0, np.int64)
            continue
        at = np.flatnonzero(w.hash[:n] == want[0])
        for j in range(1, len(parts)):
            at = at[w.hash[at + j] == want[j]]
        at = at[at + len(parts) <= end[at]]
        same = [all(w.raw[w.start[a + j] : w.end[a + j]].tobytes() == p for j, p in enumerate(parts)) for a in at]
        out[phrase] = at[np.array(same, bool)] if len(at) else at
    return out


def _base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of words, places of PHRASES with the least and largest start, and their distinct sorted labels. In: doc_id, th, text."""
    for rows, texts in _words.sliced(batches, "text"):
        out: list[tuple] = []
        for _, some in _words.groups(texts):
            w = _split(some)
            found: dict[int, list[tuple[int, str]]] = {}
            for phrase, places in phrase_places(w, PHRASES).items():
                for text, at in zip(np.searchsorted(w.first, places, "right") - 1, places, strict=True):
                    found.setdefault(int(text), []).append((int(at - w.first[text]), PHRASES[phrase]))
            for i, n in enumerate(np.diff(w.first).tolist()):
                starts = [a for a, _ in found.get(i, [])]
                out.append((n, len(starts), min(starts, default=None), max(starts, default=None), sorted({label for _, label in found.get(i, [])})))
        kinds = [pa.int64()] * 4 + [pa.list_(pa.string())]
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([rows["doc_id"], rows["th"], *columns], ["doc_id", "th", "n_words", "n_base", "first_word", "last_word", "base"])


def votes(texts: DataFrame, templates: dict[str, str]) -> DataFrame:
    """(doc_id, th, label, size, diagonal, places): distinct template positions that vote for a diagonal.

    texts: (doc_id, th, text). The templates' grams are constants of this module or a caller's few texts, some hundred rows,
    so that side is broadcast.
    """
    grams = template_grams(templates)
    if not grams:
        grams = [(0, "", -1, 0)]
    table = texts.sparkSession.createDataFrame(grams, "gram long, label string, place int, size int").filter("place >= 0")
    kind = texts.schema["doc_id"].dataType.simpleString()
    rolled = texts.select("doc_id", "th", "text").mapInArrow(_rolling, f"doc_id {kind}, th long, grams array<long>")
    spread = rolled.select("doc_id", "th", F.posexplode("grams").alias("at", "gram"))
    met = spread.join(F.broadcast(table), "gram")
    return met.groupBy("doc_id", "th", "label", "size", (F.col("at") - F.col("place")).alias("diagonal")).agg(F.collect_set("place").alias("places"))


def merge_diagonals(diagonals: list[int], places: list[np.ndarray], size: int) -> Iterator[tuple[int, int, float]]:
    """(first word, end word, share of the template covered) of each run of neighbouring diagonals."""
    order = np.argsort(diagonals, kind="stable")
    run: list[int] = []
    for i in [*order.tolist(), None]:
        if run and (i is None or diagonals[i] - diagonals[run[-1]] > DRIFT):
            covered = np.zeros(size, bool)
            starts = [(diagonals[j] + int(p)) for j in run for p in places[j]]
            for j in run:
                for p in places[j]:
                    covered[p : p + GRAM] = True
            yield min(starts), max(starts) + GRAM, float(covered.mean())
            run = []
        if i is not None:
            run.append(i)


_SPANS = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("coverage", T.DoubleType())]))


@F.pandas_udf(_SPANS)
def _merged(diagonals: pd.Series, sizes: pd.Series) -> pd.Series:
    out = []
    for group, size in zip(diagonals, sizes, strict=True):
        spans = merge_diagonals([g["diagonal"] for g in group], [np.asarray(g["places"]) for g in group], int(size))
        out.append([{"first": a, "end": b, "coverage": c} for a, b, c in spans])
    return pd.Series(out)


def license_spans(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """Candidate spans of templates in texts: (doc_id, th, label, first, end, coverage), words from 0, end exclusive."""
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), F.coalesce("text", F.lit("")).alias("text"))
    voted = votes(texts, TEMPLATES if templates is None else templates)
    grouped = voted.groupBy("doc_id", "th", "label", "size").agg(F.collect_list(F.struct("diagonal", "places")).alias("group"))  # within a text
    return grouped.select("doc_id", "th", "label", F.explode(_merged("group", "size")).alias("s")).select("doc_id", "th", "label", "s.*")


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """Per row of docs (doc_id, text): n_words, n_base, first_word, last_word, base and labels (sorted arrays), score.

    score is 1 where a phrase stands, else the best coverage of any template (0 if none of it is there). Null text
    counts as empty.
    """
    spans = license_spans(docs, templates)
    best = spans.groupBy(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).agg(
        F.max("coverage").alias("best"),
        F.collect_set(F.when(F.col("coverage") >= coverage, F.col("label"))).alias("own"),
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    base = texts.mapInArrow(_base, f"doc_id {kind}, th long, n_words long, n_base long, first_word long, last_word long, base array<string>")
    joined = base.join(best, base["doc_id"].eqNullSafe(best["__id"]) & (base["th"] == best["__th"]), "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("own", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base", labels.alias("labels"), score.alias("score"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan every whole text of documents for licenses."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def _oracle_sql() -> str:
    """DuckDB SQL for op9_licenses: grams as strings, islands of diagonals, covered words."""
    quote = lambda text: "'" + text.replace("'", "''") + "'"
    words = lambda c: f"regexp_extract_all(translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    phrases = ", ".join(f"({quote(p)}, {quote(label)}, {len(p.split())})" for p, label in PHRASES.items())
    templates = ", ".join(f"({quote(label)}, {quote(text)})" for label, text in TEMPLATES.items())
    return f"""
WITH d AS (SELECT doc_id, {words('text')} AS w FROM documents),
ph(phrase, label, n) AS (VALUES {phrases}),
lens AS (SELECT DISTINCT n FROM ph),
here AS (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM d, lens WHERE len(w) >= n),
hit AS (SELECT doc_id, s, ph.label FROM here JOIN ph ON ph.n = here.n AND array_to_string(here.w[s + 1 : s + here.n], ' ') = phrase),
base AS (SELECT doc_id, count(*) AS n_base, min(s) AS first_word, max(s) AS last_word, list(DISTINCT label) AS labels FROM hit GROUP BY 1),
t(label, text) AS (VALUES {templates}),
tw AS (SELECT label, {words('text')} AS w FROM t),
tg AS (SELECT label, len(w) AS size, place, array_to_string(w[place + 1 : place + {GRAM}], ' ') AS gram FROM (SELECT label, w, unnest(range(0, len(w) - {GRAM - 1})) AS place FROM tw)),
dg AS (SELECT doc_id, s, array_to_string(w[s + 1 : s + {GRAM}], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(0, len(w) - {GRAM - 1})) AS s FROM d WHERE len(w) >= {GRAM})),
votes AS (SELECT DISTINCT doc_id, label, size, s - place AS diagonal, place FROM dg JOIN tg USING (gram)),
diagonals AS (SELECT DISTINCT doc_id, label, diagonal FROM votes),
opened AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER o > {DRIFT} THEN 1 ELSE 0 END AS opens FROM diagonals WINDOW o AS (PARTITION BY doc_id, label ORDER BY diagonal)),
islands AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, label ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS island FROM opened),
covered AS (SELECT DISTINCT doc_id, label, size, island, unnest(range(place, place + {GRAM})) AS word FROM votes JOIN islands USING (doc_id, label, diagonal)),
spans AS (SELECT doc_id, label, count(*) / CAST(any_value(size) AS DOUBLE) AS coverage FROM covered GROUP BY doc_id, label, island),
own AS (SELECT doc_id, max(coverage) AS best, list(DISTINCT label) FILTER (coverage >= {COVERAGE}) AS labels FROM spans GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(own.labels, [])))), ',') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN own USING (doc_id)
"""


ORACLE_SQL = _oracle_sql()
