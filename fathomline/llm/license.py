"""License scan by a positional index of rare words, in DataFrame operations only.

Every template is a sequence of words with key phrases that must stand whole.  Over the corpus the
document frequency of the templates' words is counted.  The index holds, for every licence word that
is looked up, its postings: the templates that have it in a key phrase, and the offset there.  Looked up
are the words of highest inverse document frequency, ``rare`` of each template's key phrases, so that no
template is out of reach.  In a text, every position of such a word less the offset of a posting is a possible
start of that posting's template; the starts that the template's rarest word gives are intersected with
those of its next one (a start may lie before the text, whose missing words then only lower the score).
What is left is a candidate (template, start); its key phrases are verified there, and the share of the template's weight (by inverse document frequency) that stands in
its place is the score of the match.  All of this happens inside the row, by expressions whose number
does not depend on the number of templates, and nothing is shuffled but the counts of a fixed list of words.

Defined cases: null and empty texts have no word and no label; overlapping and repeated places all
count; repeated rows are scanned row by row; extra columns are kept, those with the names of the results
(``words``, ``n_words``, ``base_places``, ``base_labels``, ``labels``, ``score``) are replaced; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontam import token_words


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...]

    @property
    def words(self) -> list[str]:
        return self.text.split()

    def key_offsets(self) -> list[tuple[int, list[str]]]:
        out = []
        for key in self.keys:
            k = key.split()
            out.append((next(i for i in range(len(self.words)) if self.words[i : i + len(k)] == k), k))
        return out


def phrase(label: str, text: str) -> Template:
    return Template(label, text, (text,))


#: Phrases whose every place is counted.
BASE = (phrase("cc-by", "cc by"), phrase("gpl", "general public license"), phrase("reserved", "all rights reserved"))

#: Opening words of common licences and what must stand in them.
TEMPLATES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted free of charge",)),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    Template("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("agpl", "licensed under the gnu affero general public license", ("gnu affero general public license",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc0", "released under the creative commons cc0 1 0 universal", ("cc0 1 0",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    Template("mpl-2.0", "subject to the terms of the mozilla public license version 2 0", ("mozilla public license",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose", ("permission to use copy modify and or distribute",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("released into the public domain",)),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("apache org licenses license 2 0",)),
    Template("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("this permission notice shall be included in all copies",)),
    Template("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license as published by the free software foundation",)),
    Template("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ("redistributions of source code must retain the above copyright notice",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
)


def document_frequency(texts: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """texts (words) -> number of rows, and of rows with each word of a fixed list."""
    present = F.array_intersect(F.array_distinct("words"), F.array(*[F.lit(w) for w in vocabulary]))
    rows = texts.select(F.explode_outer(F.concat(present, F.array(F.lit("\n")))).alias("w")).groupBy("w").count().collect()
    found = {r["w"]: r["count"] for r in rows}
    return found.pop("\n", 0), found


#: Candidates are numbers: template * SPAN + start + SHIFT, so that they are intersected as such.
SPAN, SHIFT = 1 << 40, 1 << 20


def _anchors(template: Template, idf: dict[str, float], rare: int) -> list[int]:
    """Offsets of the template's rarest words among those that may not be missing."""
    words = template.words
    inside = {o + i for o, k in template.key_offsets() for i in range(len(k))}
    out: list[int] = []
    for i in sorted(inside, key=lambda i: (-idf[words[i]], i)):
        if len(out) < rare and words[i] not in {words[j] for j in out}:
            out.append(i)
    return out


def _literal(values: list[Column], kind: str) -> Column:
    return F.array(*values).cast(f"array<{kind}>")


def _hits(postings: dict[str, list[tuple[int, int]]]) -> Column:
    """Candidates that the row's rare words give by these postings."""
    words = sorted(postings)
    if not words:
        return F.array().cast("array<bigint>")
    names = F.array(*[F.lit(w) for w in words])
    base = F.array(*[F.array(*[F.lit(t * SPAN + SHIFT - o) for t, o in postings[w]]) for w in words])
    found = F.filter(F.transform("_license_rare", lambda x: F.struct(F.array_position(names, x["w"]).cast("int").alias("k"), x["i"].alias("i"))), lambda x: x["k"] > 0)
    return F.flatten(F.transform(found, lambda x: F.transform(F.get(base, x["k"] - 1), lambda p: p + x["i"])))


def scan_licenses(docs: DataFrame, base: tuple[Template, ...] = BASE, templates: tuple[Template, ...] = TEMPLATES, text: str = "text", rare: int = 2) -> DataFrame:
    """Adds words, n_words, base_places (label, start), base_labels, labels and score to the rows."""
    every = (*base, *templates)
    vocabulary = sorted({w for t in every for w in t.words})
    n, frequency = document_frequency(docs.select(token_words(F.col(text)).alias("words")), vocabulary)
    idf = {w: math.log((n + 1) / (frequency.get(w, 0) + 1)) + 1e-3 for w in vocabulary}
    # the index: postings of the rarest words of the key phrases, and of the next ones
    index: list[dict[str, list[tuple[int, int]]]] = [{} for _ in range(rare)]
    levels = []
    for k, t in enumerate(every):
        anchors = _anchors(t, idf, rare)
        levels.append(len(anchors))
        for level, o in enumerate(anchors):
            # a word may stand at several offsets of one template: the start is that of this offset
            index[level].setdefault(t.words[o], []).append((k, o))
    looked = sorted({w for level in index for w in level})
    df = docs.withColumn("words", token_words(F.col(text)))
    # the text's own positional index: its rare licence words only
    df = df.withColumn("_license_rare", F.filter(F.transform("words", lambda w, i: F.when(w.isin(looked), F.struct(w.alias("w"), i.alias("i")))), lambda x: x.isNotNull()))
    template_of = lambda c: F.floor(c / SPAN).cast("int")
    start_of = lambda c: (F.pmod(c, F.lit(SPAN)) - SHIFT).cast("int")
    found = _hits(index[0])
    for level in range(1, rare):
        # templates of fewer rare words pass this level
        short = F.array(*[F.lit(x <= level) for x in levels])
        both = F.array_intersect(found, _hits(index[level]))
        found = F.concat(F.filter(found, lambda c, short=short: F.get(short, template_of(c))), both) if any(x <= level for x in levels) else both
    keys = F.array(*[_literal([F.struct(F.lit(o).alias("o"), F.array(*[F.lit(w) for w in k]).alias("w")) for o, k in t.key_offsets()], "struct<o:int,w:array<string>>") for t in every])
    parts = F.array(*[_literal([F.struct(F.lit(i).alias("o"), F.lit(w).alias("w"), F.lit(idf[w]).alias("idf")) for i, w in enumerate(t.words)], "struct<o:int,w:string,idf:double>") for t in every])
    whole = F.array(*[F.lit(sum(idf[w] for w in t.words)) for t in every])
    names = F.array(*[F.lit(t.label) for t in every])

    def holds(c: Column) -> Column:
        s = start_of(c)
        return F.forall(F.get(keys, template_of(c)), lambda k: (s + k["o"] >= 0) & (F.slice("words", F.greatest(s + k["o"], F.lit(0)) + 1, F.size(k["w"])) == k["w"]))

    def share(c: Column) -> Column:
        s, t = start_of(c), template_of(c)
        there = F.aggregate(F.get(parts, t), F.lit(0.0), lambda acc, x: acc + F.when(F.get("words", s + x["o"]) == x["w"], x["idf"]).otherwise(0.0))
        return F.least(there / F.get(whole, t), F.lit(1.0))

    none = F.array().cast("array<bigint>")
    df = df.withColumn("_license_found", F.when(F.size("_license_rare") > 0, F.filter(F.array_distinct(found), holds)).otherwise(none))
    places = F.transform(F.filter("_license_found", lambda c: template_of(c) < len(base)), lambda c: F.struct(F.get(names, template_of(c)).alias("label"), start_of(c).alias("start")))
    df = (
        df.withColumn("n_words", F.size("words").cast("long"))
        .withColumn("base_places", places)
        .withColumn("base_labels", F.array_sort(F.array_distinct(F.transform("base_places", lambda x: x["label"]))))
        .withColumn("labels", F.array_sort(F.array_distinct(F.transform("_license_found", lambda c: F.get(names, template_of(c))))))
        .withColumn("score", F.coalesce(F.array_max(F.transform("_license_found", share)), F.lit(0.0)))
    )
    return df.drop("_license_rare", "_license_found")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    starts = F.transform("base_places", lambda x: x["start"].cast("long"))
    return df.select(
        "doc_id", "n_words", F.size("base_places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), F.round("score", 6).alias("score"),
    )
