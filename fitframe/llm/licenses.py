"""License scans: an exact containment join of text blocks with license templates.

A template is a set of words.  A block is a window of as many consecutive
words of the text as the template is long, wherever lines break, so a notice
is found wrapped or not, and words scattered over a long line are none.  A
template of n distinct words is met by a block that holds at least
``ceil(threshold * n)`` of them.  Words of templates are put in one global
order, from the rarest in the corpus to the commonest, and filters find every
such block without comparing all.  First for a whole text, of which every block
is a part:

* prefix: a text with enough words holds one of the template's rarest
  ``n - needed + 1``;
* length: it has at least the needed number of words;
* position: from the first common word on, both sides have enough words left.

Then for the blocks of a text that passes, each starting at a word of the
template: it has at least the needed number of such words.  What passes is
counted exactly.  Only DataFrame functions run, and the only thing gathered is
one number for each template word.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read, renamed, text_or_empty

#: Characters between words, phrases with their labels, and words of public license notices.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = {
    "mit-notice": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and"
                 " associated documentation files the software to deal in the software without restriction",
    "apache-notice": "licensed under the apache license version 2 0",
    "apache-terms": "you may not use this file except in compliance with the license you may obtain a copy of the license",
    "gpl-notice": "this work is licensed under the gnu general public license version",
    "gpl-terms": "this program is free software you can redistribute it and or modify it under the terms of the gnu"
                 " general public license as published by the free software foundation",
    "bsd-terms": "redistribution and use in source and binary forms with or without modification are permitted"
                 " provided that the following conditions are met",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is"
                 " hereby granted",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license",
    "cc-by": "this work is licensed under a creative commons attribution international license",
    "cc-by-nc": "licensed under cc by nc",
}
THRESHOLD = 0.8


def _tokens(text: Column) -> Column:
    return F.array_remove(F.split(text, BETWEEN), "")


def word_order(docs: DataFrame, text_col: str, templates: dict[str, str]) -> list[str]:
    """All words of the templates from the rarest to the commonest in ``docs`` (ties by the word)."""
    vocab = sorted({w for t in templates.values() for w in t.split()})
    found = docs.select(F.explode(F.array_intersect(
        _tokens(F.lower(text_or_empty(text_col))), F.array(*map(F.lit, vocab)))).alias("w"))
    counts = {r["w"]: r["n"] for r in found.groupBy("w").agg(F.count("*").alias("n")).collect()}  # at most len(vocab)
    return sorted(vocab, key=lambda w: (counts.get(w, 0), w))


def _template(name: str, words: str, order: list[str], threshold: float) -> Column:
    """A template as a struct: its words' places in the global order, how many are needed, and its length."""
    places = sorted(order.index(w) for w in set(words.split()))
    need = ceil(threshold * len(places) - 1e-9)
    return F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, places)).alias("all"),
                    F.array(*map(F.lit, places[:len(places) - need + 1])).alias("prefix"), F.lit(need).alias("need"),
                    F.lit(len(words.split())).alias("width"))


def _phrase_places(words: Column) -> Column:
    """Start and label of each phrase; they all end in one word, looked for first."""
    (last,) = {p.split()[-1] for p in PHRASES}
    parts = []
    for phrase, label in PHRASES.items():
        *before, _ = phrase.split()
        parts.append((before, label))

    def at(w: Column, i: Column) -> Column:
        out = F.lit(None)
        for before, label in parts:
            hit = w == last
            for k, v in enumerate(reversed(before), 1):
                hit = hit & F.coalesce(F.get(words, i - k) == v, F.lit(False))
            out = F.when(hit, F.struct((i - len(before)).cast("long").alias("at"), F.lit(label).alias("label"))).otherwise(out)
        return out

    return F.when(F.array_contains(words, last), F.array_compact(F.transform(words, at)))


def scan(docs: DataFrame, text_col: str = "text", templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD,
         carry: list[str] | None = None) -> DataFrame:
    """Phrases and templates found in each row, beside the columns ``carry`` (default: all of df's).

    Added: ``n_words``, ``n_base`` (all places of phrases), ``first_word`` and
    ``last_word`` (least and greatest start, null if none), ``base_labels``,
    ``labels`` (with the names of the templates met; both distinct, sorted,
    joined by commas, empty if none), ``score`` (the greatest containment found,
    1 for a phrase, else 0).  Null and blank texts have no words; repeated rows
    are each scanned; an empty table gives an empty result; columns of ``docs``
    that bear an added column's name give way to it.  For templates, and only
    there, letters beyond A-Z are lower-cased too.
    """
    added = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    own = [F.col(f"`{c}`") for c in (docs.columns if carry is None else carry) if c.lower() not in added]
    x = {k: F.col(f"`{v}`") for k, v in renamed(docs, ["text", "words", "places", "known", "near", "met"]).items()}
    name = renamed(docs, ["text", "words", "places", "known", "near", "met"])
    order = word_order(docs, text_col, templates)
    listed = F.array(*map(F.lit, order))
    known = F.array(*[_template(k, v, order, threshold) for k, v in sorted(templates.items())])
    rare = sorted({w for v in templates.values() for w in sorted(
        set(v.split()), key=order.index)[:len(set(v.split())) - ceil(threshold * len(set(v.split())) - 1e-9) + 1]})
    rare_words = F.array(*map(F.lit, rare))
    d = docs.select(*own, F.lower(text_or_empty(text_col)).alias(name["text"]))
    d = d.select(*own, x["text"], _tokens(x["text"]).alias(name["words"]))
    n_words, phrases = F.size(x["words"]).cast("long").alias("n_words"), _phrase_places(x["words"])

    def may_meet(words: Column) -> Column:
        """The templates that a text of these distinct words may meet in some block."""
        places = F.array_sort(F.transform(F.array_intersect(words, listed),
                                          lambda w: (F.array_position(listed, w) - 1).cast("int")))
        side = F.struct(F.size(words).alias("size"), places.alias("places"))

        def check(b: Column, t: Column) -> Column:
            both = F.array_intersect(b["places"], t["all"])
            first = F.array_min(both)
            left = 1 + F.least(F.size(t["all"]) - F.array_position(t["all"], first),
                               F.size(b["places"]) - F.array_position(b["places"], first))
            return ((b["size"] >= t["need"]) & F.arrays_overlap(b["places"], t["prefix"])
                    & (left >= t["need"]) & (F.size(both) >= t["need"]))

        return F.flatten(F.transform(F.array(side), lambda b: F.filter(known, lambda t: check(b, t))))

    # only for texts that hold a word of some template's prefix
    d = d.select(*own, n_words, phrases.alias(name["places"]), x["words"],
                 F.when(F.arrays_overlap(x["words"], rare_words), may_meet(F.array_distinct(x["words"]))).alias(name["near"]))
    # where the words of templates stand
    hits = F.filter(F.transform(x["words"], lambda w, i: F.struct(i.alias("at"), (F.array_position(listed, w) - 1).cast("int").alias("w"))),
                    lambda v: v["w"] >= 0)
    d = d.select(*own, "n_words", x["places"], x["near"], F.when(F.size(x["near"]) > 0, hits).alias(name["known"]))

    def most(v: Column, t: Column) -> Column:
        """The most of a template's distinct words in one block, of the places ``v`` of its words; null if too few."""
        full = F.filter(F.transform(v, lambda u, i: F.struct(i.alias("i"), u["at"].alias("at"))),
                        lambda s: F.get(v, s["i"] + t["need"] - 1)["at"] < s["at"] + t["width"])
        return F.array_max(F.transform(full, lambda s: F.size(F.array_distinct(F.transform(
            F.filter(F.slice(v, s["i"] + 1, t["width"]), lambda u: u["at"] < s["at"] + t["width"]), lambda u: u["w"])))))

    found = F.flatten(F.transform(x["near"], lambda t: F.transform(
        F.array(F.filter(x["known"], lambda u: F.array_contains(t["all"], u["w"]))),
        lambda v: F.struct(most(v, t).alias("n"), t.alias("t")))))
    met = F.transform(F.filter(found, lambda v: v["n"] >= v["t"]["need"]),
                      lambda v: F.struct((v["n"] / F.size(v["t"]["all"])).alias("share"), v["t"]["name"].alias("name")))
    d = d.select(*own, "n_words", x["places"],
                 F.coalesce(met, F.array().cast("array<struct<share:double,name:string>>")).alias(name["met"]))
    none = F.array().cast("array<string>")
    base = F.coalesce(F.transform(x["places"], lambda p: p["label"]), none)
    return d.select(
        *own, "n_words", F.coalesce(F.size(x["places"]), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(F.transform(x["places"], lambda p: p["at"])).alias("first_word"),
        F.array_max(F.transform(x["places"], lambda p: p["at"])).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, F.transform(x["met"], lambda m: m["name"])))), ",")
        .alias("labels"),
        F.when(F.size(base) > 0, F.lit(1.0)).otherwise(
            F.coalesce(F.array_max(F.transform(x["met"], lambda m: m["share"])), F.lit(0.0))).alias("score"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and templates in every whole text of ``documents``."""
    return scan(read(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
