"""Licence scans with a positional rare-token index (operator 8).

Base: places where the words of a fixed phrase stand consecutively. Method: the templates' words
are counted over all documents; each template is looked up by the rarest word (highest IDF) of its mandatory phrases,
without which it can't stand. Each place where that phrase stands votes for the relative positions of file and template that
the slack allows, and all of them are verified: the template's mandatory phrases must stand in the file at that position (a few words of
slack), and enough of the template's words must line up.

The index holds the templates' few hundred words, so what is broadcast has a fixed bound.

Defined results: null or empty texts have no words, places or labels and score 0; repeated rows are
scanned alike; extra columns are ignored; an empty table gives an empty result. labels is empty (not null) without a label.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laddersmith.llm import words as W
from laddersmith.llm.common import read

U = np.uint64

# The base phrases and their labels.
BASE = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

# Notices of public licences (label, notice, mandatory phrases).
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted free of charge", "without restriction"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify", "with or without fee is hereby granted"]),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ["may not use this file except in compliance with the license"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["under the terms of the gnu general public license"]),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ["gnu affero general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms", "following conditions are met"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", ["eclipse public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all rights to the work", ["dedicated the work to the public domain by waiving"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("cc-by", "licensed under cc by 4 0", ["under cc by 4 0"]),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["under cc by sa"]),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["under cc by nc"]),
    ("cc-by-nd", "licensed under cc by nd 4 0", ["under cc by nd"]),
]

#: Share of a template that must line up, slack of its phrases.
LEAST_SHARE, SLACK = 0.6, 3


def _hash(words: list[str]) -> np.ndarray:
    return W.word_hashes(*_buf(" ".join(words)), W.NOT_ALNUM)[0]


def _buf(s: str) -> tuple[np.ndarray, np.ndarray]:
    b = np.frombuffer(s.encode(), np.uint8)
    return b, np.array([0, len(b)])


class Index:
    def __init__(self, idf: dict[str, float] | None = None):
        vocab = sorted({w for _, t, ms in TEMPLATES for x in (t, *ms) for w in x.split()} | {w for p, _ in BASE for w in p.split()})
        h = _hash(vocab)
        o = np.argsort(h)
        self.words = [vocab[i] for i in o]
        self.hash = h[o]
        number = {w: i for i, w in enumerate(self.words)}
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.hash & U(0xFFFF)).astype(np.int64)] = True
        self.base = [([number[w] for w in p.split()], label) for p, label in BASE]
        self.templates = [(label, [number[w] for w in t.split()], [[number[w] for w in m.split()] for m in ms]) for label, t, ms in TEMPLATES]
        self.at = [[next(i for i in range(len(t) - len(m) + 1) if t[i : i + len(m)] == m) for m in ms] for _, t, ms in self.templates]
        self.idf = np.array([(idf or {}).get(w, 0.0) for w in self.words])
        # the rarest word of each template's mandatory phrases: (template, phrase, the word's place in it, the phrase's in the template)
        self.where: dict[int, list[tuple[int, list[int], int, int]]] = defaultdict(list)
        for n, (_, _, ms) in enumerate(self.templates):
            w, i = max(((w, i) for i, m in enumerate(ms) for w in m), key=lambda y: self.idf[y[0]])
            self.where[w].append((n, ms[i], ms[i].index(w), self.at[n][i]))
        self.rarest = sorted(self.where)

    def numbers(self, wh: np.ndarray) -> np.ndarray:
        """The licence word that each word is, or -1."""
        out = np.full(len(wh), -1, np.int64)
        i = np.flatnonzero(self.maybe[(wh & U(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hash, wh[i]), len(self.hash) - 1)
        ok = self.hash[at] == wh[i]
        out[i[ok]] = at[ok]
        return out

    def scan(self, x: np.ndarray) -> tuple[set[str], float]:
        """Labels that the templates give a file (its licence words by place), and the best share that lines up."""
        votes: set[tuple[int, int]] = set()
        for p in np.flatnonzero(np.isin(x, self.rarest)).tolist():
            for n, m, k, q in self.where[int(x[p])]:
                s = p - k
                if s >= 0 and x[s : s + len(m)].tolist() == m:
                    votes |= {(n, s - q + d) for d in range(-SLACK, SLACK + 1)}
        labels, best = set(), 0.0
        for n, off in sorted(votes):
            label, t, ms = self.templates[n]
            ok = True
            for m, q in zip(ms, self.at[n], strict=True):
                lo = max(0, off + q - SLACK)
                win = x[lo : off + q + SLACK + len(m)].tolist()
                if not any(win[i : i + len(m)] == m for i in range(len(win) - len(m) + 1)):
                    ok = False
                    break
            if ok:
                lined = sum(0 <= off + i < len(x) and x[off + i] == w for i, w in enumerate(t)) / len(t)
                if lined >= LEAST_SHARE:
                    labels.add(label)
                    best = max(best, lined)
        return labels, best


def document_frequencies(docs: DataFrame) -> tuple[dict[str, int], int]:
    """In how many documents each licence word stands, over all documents; and how many there are."""
    index = Index()

    def run(batches):
        total, n = np.zeros(len(index.words), np.int64), 0
        for b in batches:
            n += b.num_rows
            for i, j, raw, offs in W.chunks(b.column(0)):
                wh, _, _, first = W.word_hashes(W.LOWER[raw], offs, W.NOT_ALNUM)
                x = index.numbers(wh)
                p = np.flatnonzero(x >= 0)
                row = np.searchsorted(first, p, "right") - 1
                total += np.bincount(np.unique(row * len(index.words) + x[p]) % len(index.words), minlength=len(index.words))
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(total))]), pa.array([n, *total.tolist()])], names=["w", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    got = {r.w: r.n for r in rows}
    return {w: got.get(i, 0) for i, w in enumerate(index.words)}, got.get(-1, 0)


def license_scan(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) to the columns of op8."""
    df, n_docs = document_frequencies(docs)
    index = Index({w: math.log((n_docs + 1) / (c + 1)) for w, c in df.items()})
    needed = np.zeros(len(index.words), bool)
    needed[index.rarest] = True  # a template's mandatory phrases can't stand without their rarest word

    def run(batches):
        for b in batches:
            for i, j, raw, offs in W.chunks(b.column(1)):
                wh, _, _, first = W.word_hashes(W.LOWER[raw], offs, W.NOT_ALNUM)
                x = index.numbers(wh)
                n = j - i
                row_of = lambda p, first=first: np.searchsorted(first, p, "right") - 1
                count = np.zeros(n, np.int64)
                lo, hi = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                labels: list[set[str]] = [set() for _ in range(n)]
                for phrase, label in index.base:
                    p = np.flatnonzero(x == phrase[0])
                    for k, w in enumerate(phrase[1:], 1):
                        p = p[p + k < len(x)]
                        p = p[x[p + k] == w]
                    r = row_of(p)
                    ok = p + len(phrase) <= first[r + 1]
                    p, r = p[ok], r[ok]
                    np.add.at(count, r, 1)
                    np.minimum.at(lo, r, p - first[r])
                    np.maximum.at(hi, r, p - first[r])
                    for y in np.unique(r).tolist():
                        labels[y].add(label)
                score = np.where(count > 0, 0.5, 0.0)
                both = [set(y) for y in labels]
                p = np.flatnonzero((x >= 0) & needed[x])
                for r in np.unique(row_of(p)).tolist():
                    more, share = index.scan(x[first[r] : first[r + 1]])
                    if more:
                        both[r] |= more
                        score[r] = max(score[r], 0.5 + 0.5 * share)
                none = count == 0
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, n).cast(pa.int64()), pa.array(np.diff(first)), pa.array(count), pa.array(lo, mask=none), pa.array(hi, mask=none), pa.array([",".join(sorted(y)) for y in labels], pa.string()), pa.array([",".join(sorted(y)) for y in both], pa.string()), pa.array(score)],
                    names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
                )

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of whole ``documents``."""
    return license_scan(read(spark, sf_dir, "documents", "doc_id", "text"))
