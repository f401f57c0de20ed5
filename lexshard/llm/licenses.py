"""License scans by diagonal voting.

All rolling hashes of three words of all texts are joined by Spark to the positions where license templates have them. A
hit at word p of a text and word t of a template votes for the diagonal p - t. Votes are summed by (document, template,
diagonal), neighbouring diagonals (words put in or left out) merged, and a merged span counts if its votes cover enough of
the template's words and it is about as long as the template. A phrase counts where one diagonal holds all its words.

Templates are a fixed list of this module or of the caller; their table has a row for each three words of them, so it is
broadcast if that is small, as here, and the texts' hashes don't leave the task that reads the text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import alnum_words, batch_hashes, grams, hashes, tidy

#: Fixed values of the query's contract: phrases and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: Sentences that public licenses ask to be put into files, and their labels.
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
K = 3
#: Share of a template's words that a span must cover.
COVER = 0.75
#: Diagonals so near one another are merged.
NEAR = 3
_HERE = np.uint64(0)  # a hash that each text has once, so that texts without hits stay
#: The templates' table is broadcast up to so many rows (20 bytes each), and joined by a shuffle beyond.
BROADCAST_ROWS = 100_000


def _template_table(phrases: Sequence[tuple[str, str]], templates: Sequence[tuple[str, str]]) -> list[tuple[int, int, int]]:
    rows = [(int(_HERE), -1, 0)]
    for i, (text, _) in enumerate([*phrases, *templates]):
        split = alnum_words(text.encode())
        if len(split) < K:
            raise ValueError(f"a template has {K} words at least: {text!r}")
        rows += [(int(g.astype(np.int64)), i, t) for t, g in enumerate(grams(hashes(split), K))]
    return rows


def _rolling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h, ends = batch_hashes(batch.column("text"), alnum_words)
        parts, n = [], np.diff(ends)
        for a, b in zip(ends, ends[1:], strict=False):
            parts += [np.array([_HERE]), grams(h[a:b], K)]
        offsets = np.zeros(len(n) + 1, np.int32)
        np.cumsum(1 + np.maximum(n - K + 1, 0), out=offsets[1:])
        values = np.concatenate(parts).astype(np.int64) if parts else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), pa.array(n), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["row", "id", "n_words", "grams"])
    tidy()


def _spans(votes: list[tuple[int, list[int]]], size: int) -> Iterator[tuple[int, int, float]]:
    """(first word, words, covered share) of merged diagonals. votes: a template's diagonals in order, with the template
    positions that voted for them."""
    runs: list[list[tuple[int, list[int]]]] = []
    for diagonal, at in votes:
        if runs and diagonal - runs[-1][-1][0] <= NEAR:
            runs[-1].append((diagonal, at))
        else:
            runs.append([(diagonal, at)])
    for run in runs:
        covered = {t + i for _, at in run for t in at for i in range(K)}
        places = [d + t for d, at in run for t in at]
        first, last = min(places), max(places) + K
        if len(covered) >= COVER * size and last - first <= size / COVER:
            yield first, last - first, len(covered) / size


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """For each row of docs: id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Words are lower-cased (A-Z) runs of ASCII letters and digits and of characters beyond ASCII. n_base counts the places
    of phrases, first_word and last_word are their smallest and largest starts; spans lists all verified spans with label,
    first word, words and covered share; score is the best share, 1 where a phrase stands, 0 without a span.

    Null text is empty, and gives 0 words and places, null words, empty labels and score 0, as does text without words. A
    null id stays null. Repeated rows and ids give a row each. An empty table gives an empty one. Other columns of docs
    take no part, so their names can't clash.
    """
    spark = docs.sparkSession
    table, known = _template_table(phrases, templates), [(label, len(alnum_words(t.encode()))) for t, label in [*phrases, *templates]]
    n_phrases = len(phrases)
    index = spark.createDataFrame(table, "hash long, template int, t int")
    if len(table) <= BROADCAST_ROWS:
        index = F.broadcast(index)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    rolled = rows.mapInArrow(_rolling, f"row long, id {kind}, n_words long, grams array<long>")
    hits = rolled.select("row", "id", "n_words", F.posexplode("grams").alias("p", "hash")).join(index, "hash")
    by_diagonal = hits.groupBy("row", "id", "n_words", "template", (F.col("p") - 1 - F.col("t")).alias("diagonal")).agg(F.sort_array(F.collect_list("t")).alias("at"))
    by_doc = by_diagonal.groupBy("row", "id", "n_words").agg(F.sort_array(F.collect_list(F.struct("template", "diagonal", "at"))).alias("votes"))

    def verified(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for votes in frame["votes"]:
                by: dict[int, list[tuple[int, list[int]]]] = {}
                for v in votes:
                    by.setdefault(int(v["template"]), []).append((int(v["diagonal"]), [int(t) for t in v["at"]]))
                starts, base, labels, spans = [], set(), set(), []
                for k, on in by.items():
                    if k < 0:
                        continue
                    label, size = known[k]
                    if k < n_phrases:
                        found = [(d, size, 1.0) for d, at in on if len(set(at)) == size - K + 1]
                        starts += [d for d, _, _ in found]
                        base |= {label} if found else set()
                    else:
                        found = list(_spans(on, size))
                    labels |= {label} if found else set()
                    spans += [(label, *x) for x in found]
                out.append((len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), max((s[3] for s in spans), default=0.0), [dict(zip(("label", "first", "words", "cover"), s, strict=True)) for s in sorted(spans, key=lambda s: (s[1], s[0]))]))
            got = pd.DataFrame(out, columns=["n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])
            got["first_word"], got["last_word"] = got["first_word"].astype("Int64"), got["last_word"].astype("Int64")
            got.insert(0, "id", frame["id"].values)
            got.insert(1, "n_words", frame["n_words"].values)
            yield got

    schema = f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,words:long,cover:double>>"
    return by_doc.select("id", "n_words", "votes").mapInPandas(verified, schema).withColumnRenamed("id", id_col)
