"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest licensed ancestor folder.

DataFrame functions only. Every line of every file that has one of the templates' marker words is a candidate
header, and so is each run of neighbouring candidate lines, so that notices over several lines count as one text.
Notices that are wrapped or stand inside a longer line are found in windows: at each of a notice's anchor words in
a text of which a line has a marker, the window of the notice's size is a candidate, over line ends too. Whole texts of
at most ``WHOLE`` words are candidates for whole licences. SPDX tags are read, not scored: a tag's identifiers count
as cosine 1 for their own file, and identifiers that no template has count as none.
Candidates and templates are sparse vectors over the templates' words (a vocabulary bounded by the templates);
words weigh by the inverse share of candidate lines and runs that have them, counted over all files. The product of vectors is a
join on the word with the templates' few rows, summed by candidate and template. A file's own licence is its best
candidate's best template, if the cosine is at least ``LEAST``.

A file is a licence file if its name says so, or if candidate lines that match hold at least half of its words. A
licence file gives its licence to its folder; a file without a licence of its own takes that of its nearest
ancestor folder that has one: all ancestors of the distinct folders, whatever their depth, are joined to the licensed
folders by path.

A folder with a third of all files is one row on the folders' side: it is broadcast while the counted folders are
within ``BROADCAST_ROWS``, and salted beyond that. Candidates are few; hot lines meet only the small templates.

Defined results: null and empty texts have no licence of their own; a null path is the root folder's file; very long
texts are searched whole; ties between templates go to the smaller name, between licences of one folder to the better
cosine, then the smaller name; repeated rows are each reported, alike, and equal ones count once in the shares of words;
extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltgate.llm.common import scratch, stored

#: Short notices that name a licence, by SPDX identifier. Public licence notices and headers.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version.",
    ),
    "LGPL-3.0": (
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or any later version.",
    ),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License."),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
#: First lines of whole licences; they are looked for in windows as notices are.
HEADINGS: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("Apache License Version 2.0, January 2004",),
    "GPL-3.0": ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",),
    "GPL-2.0": ("GNU GENERAL PUBLIC LICENSE Version 2, June 1991",),
    "LGPL-3.0": ("GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",),
    "MPL-2.0": ("Mozilla Public License Version 2.0",),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0 International Public License",),
    "CC-BY-NC-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International Public License",),
    "CC-BY-SA-4.0": ("Creative Commons Attribution-ShareAlike 4.0 International Public License",),
}
#: Names that stand on a line of their own, which prose may mention: no windows are made for them.
NAMES: dict[str, tuple[str, ...]] = {"MIT": ("MIT License", "The MIT License (MIT)"), "ISC": ("ISC License",), "BSD-3-Clause": ("BSD 3-Clause License",)}
#: Whole licences, for whole texts.
FULL: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
        "to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT "
        "OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear "
        "in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT "
        "SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the "
        "above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR "
        "IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
        "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, "
        "OR TORT ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as "
        "a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all "
        "copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors.",
    ),
}
#: Words of the longest text that is compared with whole licences.
WHOLE = 600
#: Words that place a notice's windows, and SPDX tags with their expressions.
ANCHORS = r"^(licen|redistribut|permission|granted$|domain$)"
TAG = r"(?i)SPDX-License-Identifier:[ \t]*(\(?[A-Za-z0-9.+-]+\)?(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(?[A-Za-z0-9.+-]+\)?)*)"
#: A line without any of these is no part of a notice.
MARKERS = ("licen", "spdx", "permission", "redistribut", "public domain", "free software", "subject to the terms", "hereby granted")
MARKED = "(?i)" + "|".join(map(re.escape, MARKERS))
LEAST = 0.75
#: Words of a text whose windows are made in one row.
PIECE = 4096
#: The number of a whole text among its candidates; windows have smaller ones, lines and runs larger ones.
WHOLE_RUN = -5
BROADCAST_ROWS = 100_000
SALT = 64
#: Writes a table to the shared folder and reads it back.
Put = Callable[[DataFrame, str], DataFrame]
FILE_NAMES = r"(?i)^(licen[cs]e|copying|notice|unlicense)([._-].*)?$"


def tokens(text: Column) -> Column:
    """Lower-case words; a version such as 2.0 is one word."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}.]+|\.(?!\p{N})|(?<!\p{N})\.", -1), lambda w: w != "")


def _split(notice: str) -> list[str]:
    return re.findall(r"\d+(?:\.\d+)+|[^\W_]+", notice.lower())


def templates() -> list[tuple[str, str, bool]]:
    """(licence, notice, whether it is looked for in windows)."""
    return [(name, notice, windowed) for kind, windowed in ((TEMPLATES, True), (HEADINGS, True), (NAMES, False), (FULL, False)) for name, notices in sorted(kind.items()) for notice in notices]


def vocabulary() -> list[str]:
    return sorted({w for _, notice, _ in templates() for w in _split(notice)})


def windows(marked: DataFrame, shares: list[list[tuple[str, float]]]) -> DataFrame:
    """file, run, t, is_line for texts (file, t): the windows of notices' sizes at their anchor words, and short whole texts.

    ``shares`` are the words of each template with their shares of its squared norm. The shares of the words that a text
    has bound the square of its cosine, so texts whose bound is below LEAST are left out: they could not match.
    """
    places: dict[str, list[tuple[int, int, int]]] = {}
    for k, (_, notice, windowed) in enumerate(templates()):
        words = _split(notice) if windowed else []
        for o, w in enumerate(words):
            if re.match(ANCHORS, w):
                places.setdefault(w, []).append((o, len(words), k))
    table = F.from_json(F.lit(json.dumps({w: [{"o": o, "l": n, "k": k} for o, n, k in p] for w, p in sorted(places.items())})), "map<string,array<struct<o:int,l:int,k:int>>>")
    held = F.from_json(F.lit(json.dumps([[{"w": w, "p": p} for w, p in own] for own in shares])), "array<array<struct<w:string,p:double>>>")
    bound = lambda t, k: F.aggregate(F.get(held, k), F.lit(0.0), lambda s, x: s + F.when(F.array_contains(t, x["w"]), x["p"]).otherwise(0.0))
    could = lambda t, k: bound(t, k) >= LEAST**2 - 1e-6
    none = F.array().cast("array<struct<s:int,l:int,k:int>>")
    # Texts become pieces that overlap by the longest window, so that a row's windows are bounded; a window is its anchor's piece's.
    over = max(n for own in places.values() for _, n, _ in own)
    first = lambda b: F.greatest(b - over, F.lit(0))
    piece = lambda b: F.struct(b.alias("base"), first(b).alias("first"), F.slice("t", first(b) + 1, F.lit(PIECE + 2 * over)).alias("t"))
    pieces = marked.where(F.size("t") > 0).select("file", F.inline(F.transform(F.sequence(F.lit(0), F.size("t") - 1, F.lit(PIECE)), piece)))
    own = lambda i: (i >= F.col("base")) & (i < F.col("base") + PIECE)
    spots = lambda w, i: F.transform(F.try_element_at(table, w), lambda x: F.struct(F.greatest(i - x["o"], F.lit(0)).alias("s"), x["l"].alias("l"), x["k"].alias("k")))
    at = lambda w, i: F.when(own(F.col("first") + i), F.coalesce(spots(w, F.col("first") + i), none)).otherwise(none)
    cut = lambda x: F.struct((-(x["s"].cast("long") * 1024 + x["l"] + 10)).alias("run"), F.slice("t", x["s"] - F.col("first") + 1, x["l"]).alias("t"), x["k"].alias("k"))
    fit = F.filter(F.transform(F.flatten(F.transform("t", at)), cut), lambda x: could(x["t"], x["k"]))
    found = pieces.select("file", F.inline(fit)).select("file", "run", "t", F.lit(False).alias("is_line")).dropDuplicates(["file", "run"])
    full = [k for k, (_, notice, _) in enumerate(templates()) if any(notice in f for f in FULL.values())]
    some = F.lit(False)
    for k in full:
        some = some | could(F.col("t"), F.lit(k))
    whole = marked.where((F.size("t") <= WHOLE) & some)
    return found.unionByName(whole.select("file", F.lit(WHOLE_RUN).cast("long").alias("run"), "t", F.lit(False).alias("is_line")))


def candidates(marked: DataFrame) -> DataFrame:
    """file, run, t (words), is_line: lines with a marker, and the runs of neighbouring ones."""
    some = marked.select("file", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = some.where(F.col("line").rlike(MARKED) & ~F.col("line").rlike(TAG))
    by = Window.partitionBy("file").orderBy("pos")
    # Ranks and sets, so that lines of repeated rows count once.
    runs = lines.withColumn("run", F.col("pos") - F.dense_rank().over(by))
    held = runs.groupBy("file", "run").agg(F.sort_array(F.collect_set(F.struct("pos", "line"))).alias("ls"))
    joined = held.select("file", "run", F.array_join(F.transform("ls", lambda x: x["line"]), " ").alias("text"), F.size("ls").alias("n_lines"))
    single = runs.select("file", F.col("pos").alias("run"), F.col("line").alias("text"), F.lit(True).alias("is_line"))
    lined = single.unionByName(joined.where("n_lines > 1").select("file", "run", "text", F.lit(False).alias("is_line")))
    return lined.select("file", F.col("run").cast("long").alias("run"), tokens(F.col("text")).alias("t"), "is_line")


def marked_texts(files: DataFrame) -> DataFrame:
    """file, text, t (words without SPDX tags), all_words of the texts with a marker. All later steps read these texts only."""
    some = files.where(F.col("text").rlike(MARKED))
    return some.select("file", "text", tokens(F.regexp_replace("text", TAG, "")).alias("t"), F.size(F.split(F.trim("text"), r"\s+", -1)).alias("all_words"))


def _terms(found: DataFrame) -> DataFrame:
    each = found.select("file", "run", "is_line", F.size("t").alias("n_words"), F.explode("t").alias("word"))
    return each.groupBy("file", "run", "is_line", "n_words", "word").agg(F.count("*").alias("tf"))


def scored(spark: SparkSession, marked: DataFrame, put: Put = stored) -> DataFrame:
    """file, run, is_line, n_words, license, cosine: the best template of each candidate that shares a word with one."""
    words = vocabulary()
    lined = put(_terms(candidates(marked)), "licence-terms")
    total = lined.select("file", "run", "is_line").distinct().count()
    share = {r["word"]: r["n"] for r in lined.where(F.col("word").isin(words)).groupBy("word").agg(F.count("*").alias("n")).collect()}
    # The inverse share of candidates, smoothed; words that no template has weigh like the rarest.
    idf = {w: math.log((1 + total) / (1 + share.get(w, 0))) + 1 for w in words}
    other = math.log(1 + total) + 1
    rows = []
    for k, (name, notice, windowed) in enumerate(templates()):
        tf: dict[str, int] = {}
        for w in _split(notice):
            tf[w] = tf.get(w, 0) + 1
        norm = math.sqrt(sum((n * idf[w]) ** 2 for w, n in tf.items()))
        rows += [(w, name, k, n * idf[w] / norm, windowed) for w, n in tf.items()]
    shares: list[list[tuple[str, float]]] = [[] for _ in templates()]
    for w, _, k, v, _ in rows:
        shares[k].append((w, v * v))
    terms = lined.unionByName(put(_terms(windows(marked, shares)), "licence-window-terms"))
    quote = lambda x: "'" + str(x) + "'"
    notices = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({quote(w)}, {quote(n)}, {k}, double({v!r}), {x})" for w, n, k, v, x in rows) + " AS t(word, license, notice, weight, windowed)")
    weights = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({quote(w)}, double({v!r}))" for w, v in idf.items()) + " AS t(word, idf)")
    valued = terms.join(F.broadcast(weights), "word", "left").withColumn("v", F.col("tf") * F.coalesce("idf", F.lit(other)))
    norms = valued.groupBy("file", "run", "is_line", "n_words").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    dots = valued.join(F.broadcast(notices), "word").where(F.col("windowed") | (F.col("run") >= WHOLE_RUN)).groupBy("file", "run", "is_line", "n_words", "license", "notice").agg(F.sum(F.col("v") * F.col("weight")).alias("dot"))
    both = dots.join(norms, ["file", "run", "is_line", "n_words"]).withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 9))
    best = F.min(F.struct((-F.col("cosine")).alias("c"), F.col("license").alias("l"))).alias("b")
    return both.groupBy("file", "run", "is_line", "n_words").agg(best).select("file", "run", "is_line", "n_words", F.col("b.l").alias("license"), (-F.col("b.c")).alias("cosine"))


def tagged(files: DataFrame) -> DataFrame:
    """file, run, is_line, n_words (0: a tag speaks for its own file only), license, cosine of known identifiers in SPDX tags."""
    names = F.from_json(F.lit(json.dumps({n.lower(): n for n in sorted(TEMPLATES)})), "map<string,string>")
    each = files.where(F.col("text").rlike(TAG)).select("file", F.explode(F.regexp_extract_all("text", F.lit(TAG), F.lit(1))).alias("x"))
    ids = each.select("file", F.explode(F.split(F.lower("x"), r"[\s()]+", -1)).alias("id"))
    known = ids.select("file", F.try_element_at(names, F.regexp_replace("id", r"(-only|-or-later|\+)?\.*$", "")).alias("license")).where(F.col("license").isNotNull())
    return known.select("file", F.lit(0).cast("long").alias("run"), F.lit(True).alias("is_line"), F.lit(0).alias("n_words"), "license", F.lit(1.0).alias("cosine"))


def own_licenses(files: DataFrame, put: Put = stored) -> DataFrame:
    """file, own_license, cosine, is_mostly (half of the words match) of the files that have a tag or a candidate at or above LEAST."""
    marked = put(marked_texts(files), "licence-marked")
    good = scored(files.sparkSession, marked, put).where(F.col("cosine") >= LEAST).unionByName(tagged(marked))
    pick = F.min(F.struct((-F.col("cosine")).alias("c"), F.col("license").alias("l"))).alias("b")
    best = good.groupBy("file").agg(pick, F.max(F.when(F.col("is_line"), F.lit(0)).otherwise(F.col("n_words"))).alias("in_run"), F.sum(F.when(F.col("is_line"), F.col("n_words")).otherwise(0)).alias("in_lines"))
    sizes = marked.groupBy("file").agg(F.max("all_words").alias("all_words"))
    mostly = 2 * F.greatest("in_run", "in_lines") >= F.col("all_words")
    return best.join(sizes, "file").select("file", F.col("b.l").alias("own_license"), (-F.col("b.c")).alias("cosine"), mostly.alias("is_mostly"))


def folder(path: Column) -> Column:
    """The folder of a path; the root is empty."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def ancestors(folder_: Column) -> Column:
    """The folder, its parent, and so on to the root, with their depth; the deepest is the nearest."""
    parts = F.when(folder_ == "", F.array().cast("array<string>")).otherwise(F.split(folder_, "/", -1))
    return F.transform(F.sequence(F.size(parts), F.lit(0)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("dir")))


def scan(files: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, path, own_license, cosine, is_license_file, license and license_from for every row of ``files``.

    ``files`` has path, text and the key columns; ``license_from`` is ``own``, the folder that gives it, or null.
    """
    source = files.select(*keys, F.coalesce("path", F.lit("")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    # Rows are told apart by path and text: equal ones have equal results.
    named = source.withColumn("file", F.struct(F.xxhash64("path", "text").alias("a"), F.xxhash64(F.lit(1), "text", "path").alias("b")))
    with scratch(files.sparkSession) as put:
        own = put(own_licenses(named.select("file", "text").where(F.col("text") != ""), put), "licence-own")
        # Texts take no part in the join, which may be a shuffle.
        is_file = F.col("own_license").isNotNull() & (F.element_at(F.split("path", "/", -1), -1).rlike(FILE_NAMES) | F.col("is_mostly"))
        base = named.drop("text").join(own, "file", "left").select(*keys, "path", "own_license", "cosine", F.coalesce(is_file, F.lit(False)).alias("is_license_file"))
        base = stored(base, "licence-files")
        pick = F.min(F.struct((-F.col("cosine")).alias("c"), F.col("own_license").alias("l"))).alias("b")
        given = put(base.where("is_license_file").groupBy(folder(F.col("path")).alias("dir")).agg(pick).select("dir", F.col("b.l").alias("dir_license")), "licence-folders")
        # Folders, not files, look for their ancestors: each distinct folder once.
        dirs = base.select(folder(F.col("path")).alias("of")).distinct()
        above = dirs.select("of", F.inline(ancestors(F.col("of"))))
        nearest = above.join(given, "dir").groupBy("of").agg(F.max(F.struct("depth", "dir", "dir_license")).alias("n")).select("of", F.col("n.dir").alias("from"), F.col("n.dir_license").alias("dir_license"))
        nearest = stored(nearest, "licence-nearest")
    at = base.withColumn("of", folder(F.col("path")))
    if nearest.count() <= BROADCAST_ROWS:
        met = at.join(F.broadcast(nearest), "of", "left")
    else:
        dealt = at.withColumn("salt", F.pmod(F.xxhash64("path", *keys), F.lit(SALT)))
        met = dealt.join(nearest.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long")))), ["of", "salt"], "left")
    has = F.col("own_license").isNotNull()
    return met.select(
        *keys, "path", "own_license", "cosine", "is_license_file",
        F.coalesce("own_license", "dir_license").alias("license"),
        F.when(has, "own").otherwise(F.col("from")).alias("license_from"),
    )


def documents_as_files(docs: DataFrame) -> DataFrame:
    """Documents have no paths: source, language and hundreds of ids stand for folders, the id for the file's name."""
    part = F.floor(F.coalesce(F.col("doc_id"), F.lit(0)) / 100).cast("string")
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), part, F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(".txt")))
    return docs.select("doc_id", path.alias("path"), "text")
