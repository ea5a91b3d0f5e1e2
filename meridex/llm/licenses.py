"""License scan (operator 11): an exact set-similarity join of text blocks with license templates.

Words are runs of a-z, 0-9 and bytes from 0x80, A-Z lower-cased. A template is a set of words. A template of m words is
compared with blocks of 2 * l words that start at every l-th word, l being m rounded up to a power of two, 8 at least: so
m words in a row always lie in one block, wherever they start and however lines are broken. A block meets a template if
it holds at least `CONTAINMENT` of its distinct words.

1. One pass counts in how many texts each word of a template occurs; words are ordered by that number, rarest first. It
   gathers as many rows as the templates have words.
2. A block that shares r of t words holds one of the first t - r + 1 words of the template in that order (prefix), has
   at least r words that any template has (length), and has enough words left on both sides after the first one shared
   (position). What passes these is compared word by word. Words of no template can't be shared and aren't kept.

There is no shuffle of texts, and memory of a task follows its longest text. Templates are a parameter of at most
`TEMPLATE_BYTES` in all, the bound for what is sent to the tasks; more are refused.

Defined results: null and empty texts have no words, places or labels, null first and last words, and a score of 0;
repeated rows get repeated results; of blocks that contain equally much the first is reported; all columns of the
input stay, but for one named like the result, which is replaced; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .textops import chunks, text_buffers, word_strings

CONTAINMENT = 0.85
LEAST_BLOCK = 8
TEMPLATE_BYTES = 4 << 20

#: Phrases whose places are counted, with their labels.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

#: Short notices and opening paragraphs of well-known licenses, with labels.
TEMPLATES = [
    ("agpl", "GNU Affero General Public License"),
    ("apache", "the Apache License, Version 2"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("bsd", "under the BSD license"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("cc-by", "Creative Commons Attribution"),
    ("cc-by-nc", "CC BY-NC"),
    ("cc-by-nc", "Creative Commons Attribution NonCommercial"),
    ("cc-by-nd", "CC BY-ND"),
    ("cc-by-sa", "CC BY-SA"),
    ("cc-by-sa", "Creative Commons Attribution ShareAlike"),
    ("cc0", "CC0 public domain dedication"),
    ("gpl", "the GNU General Public License"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("lgpl", "GNU Lesser General Public License"),
    ("mit", "under the MIT license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."),
    ("mpl", "subject to the terms of the Mozilla Public License"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]

_RESULT = "struct<n_words: bigint, n_base: bigint, first_word: bigint, last_word: bigint, base_labels: array<string>, matches: array<struct<label: string, containment: double, start_word: bigint, n_words: bigint>>>"
_MATCH = pa.struct([("label", pa.string()), ("containment", pa.float64()), ("start_word", pa.int64()), ("n_words", pa.int64())])
_ARROW = pa.struct([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.list_(pa.string())), ("matches", pa.list_(_MATCH))])


def split_words(text: str) -> list[str]:
    """The words of one text."""
    return word_strings(*text_buffers(pa.array([text])))[0].to_pylist()


def block_step(n_words: int) -> int:
    """Words from one block to the next, for templates of so many words."""
    return max(LEAST_BLOCK, 1 << (n_words - 1).bit_length())


@dataclass
class Template:
    label: str
    words: np.ndarray  # distinct, rarest first
    needed: int  # of them in a block

    @property
    def prefix(self) -> np.ndarray:
        return self.words[: len(self.words) - self.needed + 1]


class TemplateIndex:
    """Templates by step of their blocks, with the words of their prefixes, in the order of `rank`."""

    def __init__(self, vocabulary: list[str], counts: dict[str, int], templates: Sequence[tuple[str, str]], phrases: Sequence[tuple[str, str]], containment: float):
        self.vocabulary = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
        rank = {w: k for k, w in enumerate(self.vocabulary)}
        self.phrases = [(np.array([rank[w] for w in split_words(p)]), label) for p, label in phrases]
        self.steps: dict[int, list[Template]] = {}
        used = set()
        for label, text in templates:
            found = split_words(text)
            own = np.array(sorted({rank[w] for w in found}))
            used.update(own.tolist())
            self.steps.setdefault(block_step(len(found)), []).append(Template(label, own, math.ceil(round(containment * len(own), 9))))
        self.used = np.isin(np.arange(len(self.vocabulary)), sorted(used))
        self.holders: dict[int, dict[int, list[int]]] = {step: {} for step in self.steps}  # templates by a word of their prefix
        for step, own in self.steps.items():
            for k, t in enumerate(own):
                for word in t.prefix.tolist():
                    self.holders[step].setdefault(word, []).append(k)
        self.prefix = {step: np.array(sorted(held), np.int64) for step, held in self.holders.items()}

    def places(self, codes: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, str]]:
        """Where each phrase starts, the words of a place being of one text."""
        for phrase, label in self.phrases:
            last = len(codes) - len(phrase) + 1
            if last <= 0:
                continue
            at = np.flatnonzero(codes[:last] == phrase[0])
            for k in range(1, len(phrase)):
                at = at[codes[at + k] == phrase[k]]
            yield at[owner[at] == owner[at + len(phrase) - 1]], label

    def matches(self, codes: np.ndarray) -> list[tuple]:
        """(label, containment, first word, words) of the best block for each template that one text meets."""
        best: dict[tuple, tuple] = {}
        for step, templates in self.steps.items():
            spots = np.flatnonzero(np.isin(codes, self.prefix[step]))
            number = np.concatenate([spots // step, spots // step - 1])
            met = np.unique(np.stack([number, np.tile(codes[spots], 2)], 1)[number >= 0], axis=0)
            at = -1
            for number, word in met.tolist():
                if number != at:
                    at = number
                    block = np.unique(codes[at * step : at * step + 2 * step])
                    block = block[np.searchsorted(block, 0) :]
                    block = block[self.used[block]]
                for k in self.holders[step][word]:
                    got = overlap(templates[k], block)
                    if got and ((step, k) not in best or got > best[step, k][0]):
                        best[step, k] = (got, at * step)
        return [
            (self.steps[step][k].label, got / len(self.steps[step][k].words), start, min(2 * step, len(codes) - start))
            for (step, k), (got, start) in sorted(best.items())
        ]


def overlap(t: Template, block: np.ndarray) -> int:
    """How many words of a template a block holds, or 0 if these are fewer than needed; both rarest first."""
    if len(block) < t.needed:
        return 0
    shared = np.isin(t.prefix, block)
    if not shared.any():
        return 0
    i = int(np.argmax(shared))
    j = int(np.searchsorted(block, t.words[i]))
    if 1 + min(len(t.words) - i - 1, len(block) - j - 1) < t.needed:
        return 0
    got = int(np.isin(t.words[i:], block[j:], assume_unique=True).sum())
    return got if got >= t.needed else 0


def word_counts(df: DataFrame, vocabulary: list[str], text: str = "text") -> dict[str, int]:
    """In how many texts each word of `vocabulary` occurs; one row for each word comes to the driver."""
    values = pa.array(vocabulary, pa.large_string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for whole in batches:
            for batch in chunks(whole, text):
                found, before = word_strings(*text_buffers(batch.column(text)))
                codes = pc.fill_null(pc.index_in(found, values), -1).to_numpy()
                at = np.flatnonzero(codes >= 0)
                owner = np.searchsorted(before, at, "right") - 1
                once = np.unique(owner * len(vocabulary) + codes[at])
                total += np.bincount(once % len(vocabulary), minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(vocabulary), pa.array(total)], names=["word", "n"])

    counted = df.select(text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r.word: r.n for r in counted.collect()}


def scan(
    df: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, containment: float = CONTAINMENT, text: str = "text", column: str = "license"
) -> DataFrame:
    """Adds to all columns of `df` one with the number of words, places and labels of phrases, and matches of templates."""
    if sum(len(t.encode()) for _, t in [*templates, *((label, p) for p, label in phrases)]) > TEMPLATE_BYTES:
        raise ValueError(f"templates of more than {TEMPLATE_BYTES} bytes")
    phrases = [(p, label) for p, label in phrases if split_words(p)]
    templates = [(label, t) for label, t in templates if split_words(t)]
    vocabulary = sorted({w for t in [*(t for _, t in templates), *(p for p, _ in phrases)] for w in split_words(t)})
    df = df.drop(column)
    schema = StructType([*df.schema.fields, StructField(column, df.sparkSession.createDataFrame([], f"c {_RESULT}").schema["c"].dataType)])
    index = df.sparkSession.sparkContext.broadcast(TemplateIndex(vocabulary, word_counts(df, vocabulary, text), templates, phrases, containment))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: TemplateIndex = index.value
        values = pa.array(known.vocabulary, pa.large_string())
        first = np.unique(np.concatenate([np.zeros(0, np.int64), *known.prefix.values()]))
        for whole in batches:
            for batch in chunks(whole, text):
                found, before = word_strings(*text_buffers(batch.column(text)))
                codes = pc.fill_null(pc.index_in(found, values), -1).to_numpy()
                owner = np.repeat(np.arange(batch.num_rows), np.diff(before))
                rows = [{"n_words": n, "n_base": 0, "first_word": None, "last_word": None, "base_labels": set(), "matches": []} for n in np.diff(before).tolist()]
                for at, label in known.places(codes, owner):
                    for row, start in zip(owner[at].tolist(), (at - before[owner[at]]).tolist(), strict=True):
                        r = rows[row]
                        r["n_base"] += 1
                        r["first_word"] = start if r["first_word"] is None else min(r["first_word"], start)
                        r["last_word"] = start if r["last_word"] is None else max(r["last_word"], start)
                        r["base_labels"].add(label)
                for row in np.unique(owner[np.isin(codes, first)]).tolist():
                    got = known.matches(codes[before[row] : before[row + 1]])
                    rows[row]["matches"] = [dict(zip(("label", "containment", "start_word", "n_words"), g, strict=True)) for g in got]
                for r in rows:
                    r["base_labels"] = sorted(r["base_labels"])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, _ARROW)], names=[*batch.schema.names, column])

    return df.mapInArrow(run, schema)


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of every text: of phrases that stand in it, and of templates that one of its blocks contains."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "license.*")
    return found.select(
        "doc_id", F.col("n_words"), "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_labels", F.array_distinct("matches.label"))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.array_max("matches.containment"), F.lit(0.0))).alias("score"),
    )


def _op11_sql() -> str:
    """The same by comparing every block with every template, the words of both being joined."""
    quoted = lambda t: t.replace("'", "''")
    words = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    phrases = ", ".join(f"('{p}', '{label}')" for p, label in PHRASES)
    templates = ", ".join(f"({k}, '{label}', '{quoted(t)}')" for k, (label, t) in enumerate(TEMPLATES))
    return f"""
with d as (select row_number() over () as r, doc_id, {words.format("coalesce(text, '')")} as w from documents),
p as (select string_split(phrase, ' ') as pw, label from (values {phrases}) v(phrase, label)),
t0 as (select k, label, {words.format("t")} as tw from (values {templates}) v(k, label, t)),
t as (select k, label, len(list_distinct(tw)) as size, ceil(round({CONTAINMENT} * len(list_distinct(tw)), 9)) as needed,
    greatest({LEAST_BLOCK}, cast(pow(2, ceil(log2(len(tw)))) as bigint)) as step, unnest(list_distinct(tw)) as word from t0),
o as (select r, unnest(w) as word, generate_subscripts(w, 1) - 1 as pos, w from d),
places as (select r, pos, label from o, p where word = pw[1] and w[pos + 1 : pos + len(pw)] = pw),
base as (select r, count(*) as n_base, min(pos) as first_word, max(pos) as last_word, list_sort(list(distinct label)) as labels from places group by r),
shared as (select r, k, label, size, needed, unnest(case when pos < step then [0] else [pos // step, pos // step - 1] end) as block, word from o join t using (word)),
met as (select r, k, label, block, count(distinct word) / size as containment from shared group by r, k, label, block, size, needed having count(distinct word) >= needed),
own as (select r, max(containment) as score, list(distinct label) as labels from met group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
    coalesce(array_to_string(base.labels, ','), '') as base_labels,
    coalesce(array_to_string(list_sort(list_distinct(list_concat(base.labels, own.labels))), ','), '') as labels,
    case when n_base > 0 then 1.0 else coalesce(score, 0.0) end as score
from d left join base using (r) left join own using (r)"""


OP11_SQL = _op11_sql()
