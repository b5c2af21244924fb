"""Licence scans: sparse TF-IDF cosine of lines, headers and whole files to templates, then inheritance by directory.

Each line of a text, each run of neighbouring blocks of lines (a header with or without its copyright line, say) and
the whole text is a bag of words, compared with the statements, notices and whole texts of the licences. Every word
weighs by the number of documents that hold it, counted over all of them. The best unit of at least ``LEAST`` decides, and
``line`` is its first. An SPDX tag names its licence itself, with score 1; an unknown name says nothing.

Units are screened in numpy by a bound that no qualifying unit misses: a word weighs at least as much as its hashed cell of
document counts allows. The few that pass are scored term by term; the document counts of their words outside the templates come
by a join on word hashes.

A file without a statement of its own takes the licence of the nearest directory above it that has a licence file.
That is decided for each directory, not for each file, and then joined to the files by their own directory.

Defined results: null and empty texts, and null paths, have no licence of their own; a null path inherits
none. Between licence files of one directory the higher score wins, then the smaller path, then the name. Ties between templates go
to the name that sorts first, between units to the first line, then to the shorter unit. Repeated rows get equal results. Empty
tables give no rows. Input columns named like an output are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslane.llm.license_texts import NOTICES, whole_texts
from corpuslane.llm.shared import bit_filter, held, ready, row_of, stored
from corpuslane.llm.words import ALNUM, Words, mix, pieces, signed, split

LEAST = 0.6
SALTS = 16
#: Neighbouring blocks that make one unit at most; the longest notice or short licence text has fewer.
RUN = 10
#: Hashed cells of document counts, a bound for each word from above.
CELLS = 1 << 20
#: Distinct words that a task counts before it sends them on.
HELD = 1 << 20
BLANK, MARKS = np.zeros(256, bool), np.zeros(256, bool)
BLANK[[*b" \t\r\"'"]] = True
MARKS[[*b"/*#;%-!<"]] = True
#: A tag names its licence itself.
TAG = re.compile(r"SPDX-License-Identifier:[ \t]*([^\r\n]*)")
UNITS_DDL = "array<struct<license string, dot double, near double, line int, span int, digest long, terms array<long>, counts array<long>>>"
UNITS = pa.list_(
    pa.struct(
        {"license": pa.string(), "dot": pa.float64(), "near": pa.float64(), "line": pa.int32(), "span": pa.int32(), "digest": pa.int64(), "terms": pa.list_(pa.int64()), "counts": pa.list_(pa.int64())}
    )
)

#: Statements by which each licence is declared, by SPDX name.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "Apache License Version 2.0, January 2004"],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License", "BSD 2-Clause Simplified License"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License", "BSD 3-Clause New or Revised License"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["Released under CC0 1.0", "CC0 1.0 Universal Public Domain Dedication"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2", "GNU General Public License Version 2, June 1991"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3", "GNU General Public License Version 3, 29 June 2007"],
    "ISC": ["Released under the ISC License", "ISC License"],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3", "GNU Lesser General Public License Version 3, 29 June 2007"],
    "MIT": ["Released under the MIT License", "Licensed under the MIT License", "The MIT License (MIT)"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Mozilla Public License Version 2.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
}
FILE_NAMES = r"(?i)^(licen[sc]e|copying|notice|unlicense)([.-][^/]*)?$"


@dataclass(frozen=True)
class Scale:
    """Template terms as sorted word hashes with their weights, the number of documents, and the
    unit vectors of the templates, by name, as columns over the terms. ``least`` is, by hashed cell, what
    a word weighs at least: a cell's count is the sum over its words."""

    terms: np.ndarray
    weights: np.ndarray
    least: np.ndarray
    rows: int
    names: tuple[str, ...]
    units: np.ndarray


@dataclass(frozen=True)
class Weighed:
    """A scale, and the documents that it was counted over."""

    scale: Scale
    docs: DataFrame
    text: Column


def all_templates() -> dict[str, list[str]]:
    """Statements, notices and whole texts of each licence."""
    whole = {name: [text] for name, text in whole_texts().items()}
    return {name: [t for kind in (TEMPLATES, NOTICES, whole) for t in kind.get(name, [])] for name in TEMPLATES.keys() | NOTICES.keys() | whole.keys()}


def template_terms() -> tuple[np.ndarray, list[tuple[str, Counter]]]:
    """All term hashes, sorted, and each template's term counts by position in them."""
    templates = all_templates()
    named = [(name, text) for name in sorted(templates) for text in templates[name]]
    words = split(pa.array([t for _, t in named]), ALNUM, fold=True)
    terms, place = np.unique(words.hash, return_inverse=True)
    return terms, [(name, Counter(place[words.text == i].tolist())) for i, (name, _) in enumerate(named)]


def term_of(terms: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Position of each hash in ``terms``, or -1."""
    at = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
    return np.where(terms[at] == hashes, at, -1)


def weight(rows, n):
    """Weight of a term that ``n`` of ``rows`` documents hold."""
    return np.log((1 + rows) / (1 + n)) + 1


def cell_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(CELLS - 1)).astype(np.int64)


def weigh(docs: DataFrame, text: Column) -> Weighed:
    """Document counts of every template term and of every cell of words over all rows; the driver receives one row a term
    and a cell."""
    terms, templates = template_terms()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, cells, rows = np.zeros(len(terms), np.int64), np.zeros(CELLS, np.int64), 0
        for batch in batches:
            for piece in pieces(batch, "text"):
                words = split(piece.column("text"), ALNUM, fold=True)
                at = term_of(terms, words.hash)
                inside = at >= 0
                pairs = np.unique(words.text[inside] * len(terms) + at[inside])
                total += np.bincount(pairs % len(terms), minlength=len(terms))
                pairs = np.unique(words.text * CELLS + cell_of(words.hash))
                cells += np.bincount(pairs % CELLS, minlength=CELLS)
                rows += piece.num_rows
        sums = np.concatenate([total, [rows], cells])
        at = np.flatnonzero(sums)
        yield pa.record_batch([pa.array(at), pa.array(sums[at])], ["term", "n"])

    ready(docs.sparkSession)
    sums = docs.select(text.alias("text")).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    found = np.zeros(len(terms) + 1 + CELLS)
    found[sums.column("term").to_numpy()] = sums.column("n").to_numpy()
    cells, found = found[len(terms) + 1 :], found[: len(terms) + 1]
    weights = weight(found[-1], found[:-1])
    # a document with several words of a cell counts once, so a count never exceeds the number of documents
    least = weight(found[-1], cells).astype(np.float32) * (1 - 1e-6)
    units = np.zeros((len(terms), len(templates)))
    for k, (_, counts) in enumerate(templates):
        at = np.array(sorted(counts))
        units[at, k] = np.array([counts[t] for t in sorted(counts)]) * weights[at]
    return Weighed(Scale(terms, weights, least.astype(np.float32), int(found[-1]), tuple(n for n, _ in templates), units / np.linalg.norm(units, axis=0)), docs, text)


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    terms, at = np.unique(np.concatenate([t for t, _ in parts]), return_inverse=True)
    return terms, np.bincount(at, np.concatenate([n for _, n in parts]), len(terms)).astype(np.int64)


def document_counts(docs: DataFrame, text: Column, kept: Broadcast) -> DataFrame:
    """``term`` and ``n``, the number of rows that hold it, of every word that passes the bit filter, over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, size = [], 0
        for batch in batches:
            for piece in pieces(batch, "text"):
                words = split(piece.column("text"), ALNUM, fold=True)
                inside = held(kept.value, words.hash)
                texts, hashes = words.text[inside], words.hash[inside]
                order = np.lexsort((texts, hashes))
                texts, hashes = texts[order], hashes[order]
                first = np.r_[True, (hashes[1:] != hashes[:-1]) | (texts[1:] != texts[:-1])][: len(hashes)]
                own.append(np.unique(hashes[first], return_counts=True))
                size += len(own[-1][0])
                if size > HELD:
                    own = [summed(own)]
                    size = len(own[0][0])
                if size > HELD // 2 and len(own) == 1:
                    yield counted(own)
                    own, size = [], 0
        if own:
            yield counted(own)

    def counted(own: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        terms, n = summed(own)
        return pa.record_batch([pa.array(signed(terms)), pa.array(n)], ["term", "n"])

    return docs.select(text.alias("text")).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def marked(words: Words, heads: np.ndarray) -> np.ndarray:
    """Whether the line of each head word begins like a comment: its first byte but for blanks and quotes is a comment's mark."""
    newline = np.concatenate([[-1], np.flatnonzero(words.data == 10)])
    begin = np.maximum(newline[np.searchsorted(newline, words.start[heads]) - 1] + 1, words.begin[words.text[heads]])
    seen = np.flatnonzero(~BLANK[words.data])
    return MARKS[words.data[seen[np.searchsorted(seen, begin)]]]


def units_of(words: Words, line: np.ndarray, place: np.ndarray, scale: Scale, least: float) -> Iterator[tuple[int, int]]:
    """First and end word of every unit that may score ``least``: each line, each run of up to ``RUN`` neighbouring
    blocks, and each whole text.

    A block is a run of lines with words that are all comments or all not. A unit's product with a template is the sum over its
    words, and its length is no less than if no word repeated and all other words weighed as little as their cells allow.
    """
    heads = np.flatnonzero(np.r_[True, (line[1:] != line[:-1]) | (words.text[1:] != words.text[:-1])])
    ends = np.r_[heads[1:], len(line)]
    inside = np.flatnonzero(place >= 0)
    term, of = place[inside], np.repeat(np.arange(len(heads)), ends - heads)[inside]
    length = np.add.reduceat(np.where(place >= 0, scale.weights[place], scale.least[cell_of(words.hash)]).astype(np.float64) ** 2, heads)
    dots = np.stack([np.bincount(of, weights=(scale.weights * unit)[term], minlength=len(heads)) for unit in scale.units.T])
    for i in np.flatnonzero(dots.max(axis=0) ** 2 >= least**2 * length * (1 - 1e-9)):
        yield int(heads[i]), int(ends[i])
    mark, text = marked(words, heads), words.text[heads]
    top = np.flatnonzero(np.r_[True, (np.diff(line[heads]) != 1) | (text[1:] != text[:-1]) | (mark[1:] != mark[:-1])])
    # sums before each block, so that those of a run are differences
    length = np.r_[0.0, np.cumsum(np.add.reduceat(length, top))]
    dots = np.concatenate([np.zeros((len(dots), 1)), np.cumsum(np.add.reduceat(dots, top, axis=1), axis=1)], axis=1)
    lines, text = np.diff(np.r_[top, len(heads)]), text[top]
    first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    size = np.diff(np.r_[first, len(text)])

    def runs(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int]]:
        product = (dots[:, b] - dots[:, a]).max(axis=0, initial=0.0)
        for i in np.flatnonzero(product**2 >= least**2 * (length[b] - length[a]) * (1 - 1e-9)):
            yield int(heads[top[a[i]]]), int(ends[top[b[i]] - 1] if b[i] < len(top) else ends[-1])

    for n in range(1, RUN + 1):
        a = np.arange(len(top) - n + 1)
        a = a[(text[a] == text[a + n - 1]) & ((lines[a] > 1) | (n > 1))]
        yield from runs(a, a + n)
    yield from runs(first[size > RUN], (first + size)[size > RUN])


def score_unit(hashes: np.ndarray, place: np.ndarray, scale: Scale) -> tuple[str, float, float, np.ndarray, np.ndarray]:
    """The template nearest to a unit, their product, the squared length in template terms, and the other words with their counts."""
    terms, counts = np.unique(place[place >= 0], return_counts=True)
    others, n = np.unique(hashes[place < 0], return_counts=True)
    own = counts * scale.weights[terms]
    dots = np.round(own @ scale.units[terms], 12)
    k = int(np.argmax(dots))
    return scale.names[k], float(dots[k]), float(own @ own), others, n


def tagged(text: str, names: tuple[str, ...]) -> list[dict]:
    """A unit of score 1 for each tag with a known name; of an expression, for its first known name."""
    known, out = {n.lower(): n for n in names}, []
    for tag in TAG.finditer(text):
        named = (known.get(re.sub(r"(-only|-or-later|\+)$", "", w.lower())) for w in re.findall(r"[A-Za-z0-9.+-]+", tag[1]))
        name = next((n for n in named if n), None)
        if name:
            line = text.count("\n", 0, tag.start())
            out.append({"license": name, "dot": 1.0, "near": 1.0, "line": line, "span": 0, "digest": None, "terms": [], "counts": [], "most": 1.0, "low": 1.0})
    return out


def candidates(texts: pa.Array, scale: Scale, least: float) -> pa.Array:
    """Of each text the units that may be its best: those whose words all belong to templates have a digest of null."""
    words = split(texts, ALNUM, fold=True)
    out: list[list[dict]] = [[] for _ in range(len(texts))]
    if len(words.hash):
        breaks = np.concatenate([[0], np.cumsum(words.data == 10)])
        line = breaks[words.start] - breaks[words.begin[words.text]]
        place = term_of(scale.terms, words.hash)
        rarest = weight(scale.rows, 0)
        for a, b in units_of(words, line, place, scale, least):
            name, dot, near, others, n = score_unit(words.hash[a:b], place[a:b], scale)
            # other words weigh from what their cells allow to that of a word that the counted documents lack
            rest = float(((n * scale.least[cell_of(others)]) ** 2).sum())
            most, low = dot / np.sqrt(near + rest), dot / np.sqrt(near + float(n @ n) * rarest**2)
            if most >= least * (1 - 1e-9):
                with np.errstate(over="ignore"):
                    digest = int(signed(mix(mix(others + n.astype(np.uint64)).sum(keepdims=True)))[0]) if len(others) else None
                out[words.text[a]].append({"license": name, "dot": dot, "near": near, "line": int(line[a]), "span": b - a, "digest": digest, "terms": signed(others).tolist(), "counts": n.tolist(), "most": most, "low": low})
    for t in np.flatnonzero(np.asarray(pc.fill_null(pc.match_substring(texts, "SPDX-License-Identifier:"), False))):
        out[t] += tagged(texts[int(t)].as_py(), scale.names)
    for t, units in enumerate(out):
        sure = max((u["low"] for u in units), default=0.0)
        out[t] = [u for u in units if u["most"] >= sure * (1 - 1e-9)]
    return pa.array(out, UNITS)


def statements(docs: DataFrame, weighed: Weighed, text: str = "text", least: float = LEAST, texts: bool = True) -> DataFrame:
    """``docs`` with ``license``, ``score`` and ``line`` of the best statement, or nulls; without its text if ``texts`` is false.

    The scan leaves what may be a text's best unit. Where that has words of no template, their document counts
    are joined to it.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(weighed.scale)
    rows = weighed.scale.rows

    def run(column: pa.Array) -> pa.Array:
        parts = [candidates(p.column(0), shared.value, least) for p in pieces(pa.record_batch([column], ["t"]), "t")]
        return pa.concat_arrays(parts) if parts else candidates(column, shared.value, least)

    ready(spark)
    units = F.arrow_udf(run, returnType=UNITS_DDL)(F.col(text)).alias("_units")
    outputs = ("license", "score", "line") + (() if texts else (text,))
    found = stored(docs.select(row_of(docs, *outputs), F.monotonically_increasing_id().alias("_at"), units), "units")
    open_units = found.select("_at", F.explode("_units").alias("u")).where("u.digest IS NOT NULL").select("_at", "u.*")
    bags = open_units.select("digest", "terms", "counts").dropDuplicates(["digest"])
    bags = stored(bags.select("digest", F.explode(F.arrays_zip("terms", "counts")).alias("w")).select("digest", F.col("w.terms").alias("term"), F.col("w.counts").alias("count")), "bags")
    counts = document_counts(weighed.docs, weighed.text, bit_filter(bags, "term"))
    # a word of many units and a bag of many texts are met at salted goals
    salt, salts = F.pmod(F.xxhash64("digest"), F.lit(SALTS)), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    counts = counts.select("term", "n", salts.alias("_salt"))
    heavy = F.col("count") * (F.log((1 + F.lit(rows)) / (1 + F.coalesce("n", F.lit(0)))) + 1)
    rest = bags.withColumn("_salt", salt).join(counts, ["term", "_salt"], "left").groupBy("digest").agg(F.sum(heavy * heavy).alias("rest"))
    rest = rest.select("digest", "rest", salts.alias("_salt"))
    scored = open_units.withColumn("_salt", F.pmod(F.xxhash64("_at"), F.lit(SALTS))).join(rest, ["digest", "_salt"])

    def choice(u, other: Column) -> Column:
        """Orders by score, then first line, then length, then name."""
        score = F.least(F.lit(1.0), u["dot"] / F.sqrt(u["near"] + other))
        return F.struct((-F.round(score, 12)).alias("less"), u["line"].alias("line"), u["span"].alias("span"), u["license"].alias("license"))

    scored = scored.select("_at", choice({c: F.col(c) for c in ("dot", "near", "line", "span", "license")}, F.col("rest")).alias("c"))
    scored = scored.groupBy("_at").agg(F.min("c").alias("_open"))
    closed = F.array_min(F.transform(F.filter("_units", lambda u: u["digest"].isNull()), lambda u: choice(u, F.lit(0.0))))
    best = found.select("_row", "_at", closed.alias("_closed")).join(scored, "_at", "left").select("_row", F.least("_closed", "_open").alias("b"))
    best = best.select("_row", F.when(-F.col("b.less") >= least, F.col("b")).alias("b"))
    return best.select("_row.*", F.col("b.license").alias("license"), (-F.col("b.less")).alias("score"), F.col("b.line").alias("line"))


def directory(path: Column) -> Column:
    """All of a path before its last part; of a path without a slash, the empty root."""
    return F.regexp_replace(F.regexp_replace(path, r"[^/]*$", ""), "/+$", "")


def file_named(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1).rlike(FILE_NAMES)


def inherited(found: DataFrame, path: str = "path", speaks: Column | None = None) -> DataFrame:
    """``found`` with ``origin`` (own, inherited or none), ``from_dir``, and inherited licences filled in.

    ``speaks`` tells which rows with a licence are licence files; by default their file name does.
    """
    speaks = file_named(F.col(path)) if speaks is None else speaks
    row = row_of(found, "license", "score", "origin", "from_dir")
    base = found.select(row, "license", "score", F.col(path).alias("_path"), directory(F.col(path)).alias("_dir"), speaks.alias("_speaks"))
    base = stored(base, "statements")
    files = base.where("license IS NOT NULL AND _dir IS NOT NULL AND _speaks")
    best = F.min(F.struct((-F.col("score")).alias("less"), "_path", "license"))
    given = files.groupBy("_dir").agg(best.alias("b")).select(F.col("_dir").alias("_from"), F.col("b")["license"].alias("_license"), (-F.col("b")["less"]).alias("_score"))
    # the directories are few beside the files; each looks at all those above it
    dirs = base.select("_dir").where("_dir IS NOT NULL").distinct()
    parts = F.split("_dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.when(F.col("_dir") == "", 0).otherwise(F.size(parts))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    upward = dirs.select("_dir", F.posexplode(above).alias("depth", "up"))
    nearest = upward.join(given, F.col("up") == F.col("_from")).groupBy("_dir").agg(F.max(F.struct("depth", "_from", "_license", "_score")).alias("n"))
    nearest = nearest.select(F.col("_dir").alias("_d"), "n._from", "n._license", "n._score")
    out = base.join(nearest, F.col("_dir") == F.col("_d"), "left")
    own = F.col("license").isNotNull()
    origin = F.when(own, "own").when(F.col("_license").isNotNull(), "inherited").otherwise("none")
    filled = (F.coalesce("license", "_license").alias("license"), F.coalesce("score", "_score").alias("score"))
    return out.select("_row.*", *filled, origin.alias("origin"), F.when(~own, F.col("_from")).alias("from_dir"))
