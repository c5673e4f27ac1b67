"""License scans by an exact set-similarity join, in DataFrame functions only.

A text block and a license template are sets of words. A block is a line, or a passage: as many consecutive words as
the template has, divided by THRESHOLD, over line ends too, so that a header wrapped at any width is met. A block meets
a template if it holds at least THRESHOLD of the template's distinct words. (The SQL of the query compares lines alone;
its labels are among these.) Words are ordered by how many documents hold them, rarest first:
- prefix filter: with `need` common words asked for, a block that meets a template of n words holds one of its
  first n - need + 1 words;
- length filter: the block has `need` distinct words at least;
- positional filter: if the first word they share stands at place p of the template (from 0), at most n - p words can
  be common, and within the block, at place q of its own order, no more than its words from q on;
so only lines that pass all three are compared in full. Passages are compared in documents that hold enough words of the
template at all, and begin at each of its words. No block that meets the threshold is lost.

Templates are a list, so their words are literals of the plan and the frequencies of these words alone come to the driver.
They are taken in batches of TEMPLATE_WORDS words, each with its own order and prefixes; a longer list has more batches. The
text is read twice and never shuffled: one pass counts, with map-side sums; the other splits each text into blocks,
filters and verifies within the row. Stated phrases are found beside that: a phrase's places are the gaps of a split,
counted in words, or, if a phrase can overlap itself, each place where its words stand.

Nulls and edge cases: a null or empty text has no words and no labels, and score 0; a null doc_id passes through;
repeated rows give repeated rows; ties between templates give all labels; an empty table gives an empty result;
further columns pass through license_scan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words after lower-casing, and the same before it.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LETTER = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
THRESHOLD = 0.8
#: Words of a batch of templates, which are literals of the plan.
TEMPLATE_WORDS = 2000
#: Opening sentences of well-known licenses, as their texts have them; fixed values.
TEMPLATES = {
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "apache-2": [
        "Licensed under the Apache License, Version 2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License',
    ],
    "gpl-3": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "gpl": ["This work is licensed under the GNU General Public License"],
    "bsd-3": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "mpl-2": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Released under CC BY-NC 4.0"],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License"],
}


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(lowered_text: Column) -> Column:
    """The words of a lower-cased text, in order."""
    return F.filter(F.split(lowered_text, BREAK + "+"), lambda w: w != "")


def count_words(text: Column) -> Column:
    """regexp_count would build each match; splitting off breaks does not depend on the number of captures."""
    return F.regexp_count(text, F.lit(LETTER + "+")).cast("long")


def phrase_pattern(phrase: str) -> str:
    return f"(?<!{LETTER})(?i:{(BREAK + '+').join(phrase.split())})(?!{LETTER})"


def phrase_gate(phrase: str) -> str:
    """Found wherever the phrase is; begins with a letter, so that most places fail at once."""
    return f"(?i:{(BREAK + '+').join(phrase.split())})"


def overlaps_itself(words: list[str]) -> bool:
    return any(words[:n] == words[-n:] for n in range(1, len(words)))


def places_of(phrase: list[str]):
    """A function of an array of words: the places, from 0, at which the phrase's words stand."""
    return lambda every: F.filter(F.sequence(F.lit(0), F.size(every)), lambda at: F.slice(every, at + 1, len(phrase)) == F.array(*map(F.lit, phrase)))


def with_phrases(docs: DataFrame, text: Column, phrases: dict[str, str], names: dict[str, str]) -> DataFrame:
    """docs, which have n_words, with n_base, first_word, last_word and base_labels (an array), over all phrases.

    A text is split at a phrase only where the phrase's gate finds it: the parts are a column of their own, null
    elsewhere, so that no other expression splits again."""
    counts, firsts, lasts, labels, parts = [], [], [], [], {}
    for i, phrase in enumerate(phrases):
        q = phrase.split()
        if overlaps_itself(q):
            found = F.element_at(F.transform(F.array(words_of(lowered(text))), places_of(q)), 1)
        else:
            found = F.split(text, phrase_pattern(phrase))
        parts[free_name(docs, f"parts{i}")] = F.when(F.rlike(text, F.lit(phrase_gate(phrase))), found)
    out = docs.withColumns(parts)
    for name, (phrase, label) in zip(parts, phrases.items()):
        if overlaps_itself(phrase.split()):
            found = F.col(name).isNotNull() & (F.size(name) > 0)
            counts.append(F.when(found, F.size(name)).otherwise(0))
            firsts.append(F.when(found, F.array_min(name)).cast("long"))
            lasts.append(F.when(found, F.array_max(name)).cast("long"))
            labels.append(F.when(found, F.lit(label)))
            continue
        found = F.col(name).isNotNull() & (F.size(name) > 1)
        counts.append(F.when(found, F.size(name) - 1).otherwise(0))
        firsts.append(F.when(found, count_words(F.element_at(name, 1))))
        lasts.append(F.when(found, F.col(names["n_words"]) - count_words(F.element_at(name, -1)) - len(phrase.split())))
        labels.append(F.when(found, F.lit(label)))
    least, most = (firsts[0], lasts[0]) if len(phrases) == 1 else (F.least(*firsts), F.greatest(*lasts))
    return out.withColumns(
        {
            names["n_base"]: sum(counts[1:], counts[0]).cast("long"),
            names["first_word"]: least,
            names["last_word"]: most,
            names["base_labels"]: F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))),
        }
    ).drop(*parts)


def python_words(text: str) -> list[str]:
    """The words of a template."""
    import re

    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


def word_frequencies(docs: DataFrame, text_col: str, words: list[str]) -> dict[str, int]:
    """In how many documents each of these words stands. Only they leave the tasks, as sums."""
    held = F.array_intersect(F.split(F.lower(F.col(text_col)), BREAK + "+"), F.array(*map(F.lit, words)))
    counted = docs.where(F.col(text_col).isNotNull()).select(F.explode(held).alias("w")).groupBy("w").count()
    return {r["w"]: r["count"] for r in counted.collect()}


def batches_of(lists: list[tuple[str, list[str]]]) -> list[list[tuple[str, list[str]]]]:
    """Templates in batches of up to TEMPLATE_WORDS words; a longer template is a batch of its own."""
    out: list[list[tuple[str, list[str]]]] = []
    size = 0
    for label, words in lists:
        n = len(set(words))
        if not out or size + n > TEMPLATE_WORDS:
            out.append([])
            size = 0
        out[-1].append((label, words))
        size += n
    return out


def template_hits(text: Column, lists: list[tuple[str, list[str]]], often: dict[str, int], threshold: float) -> tuple[Column, list[str]]:
    """array<struct<label, share>> of the blocks that meet a template of one batch, and the words of all prefixes."""
    sets = [(label, sorted(set(words))) for label, words in lists]
    lengths = [math.ceil(len(words) / threshold - 1e-9) for _, words in lists]  # of passages
    known = sorted({w for _, words in sets for w in words})
    order = {w: i for i, w in enumerate(sorted(known, key=lambda w: (often.get(w, 0), w)))}
    ranks = F.create_map(*[F.lit(x) for w in known for x in (w, order[w])])
    ordered = [(label, sorted(words, key=order.get)) for label, words in sets]
    needs = [max(1, math.ceil(threshold * len(words) - 1e-9)) for _, words in ordered]
    prefixes = sorted({w for (_, words), need in zip(ordered, needs) for w in words[: len(words) - need + 1]})
    hit = "(?i)(?:%s)" % "|".join(prefixes)

    blocks = F.filter(F.split(text, "\n"), lambda b: F.rlike(b, F.lit(hit)))  # the prefix filter, a superset
    ranked = F.transform(
        blocks,
        lambda b: F.struct(
            F.size(F.array_distinct(words_of(lowered(b)))).alias("size"),
            F.array_sort(F.transform(F.filter(F.array_distinct(words_of(lowered(b))), lambda w: w.isin(known)), lambda w: ranks[w])).alias("ranks"),
        ),
    )

    def share(block: Column, words: list[str], need: int) -> Column:
        own = F.array(*[F.lit(order[w]) for w in words])
        prefix = F.array(*[F.lit(order[w]) for w in words[: len(words) - need + 1]])
        mine = block["ranks"]
        first = F.array_min(F.array_intersect(mine, prefix))  # the first shared word, in the common order
        after = F.array_position(own, first)  # from 1
        inside = F.array_position(mine, first)
        possible = F.least(F.lit(len(words)) - after + 1, F.size(mine) - inside + 1)
        passes = (block["size"] >= need) & (F.size(mine) >= need) & first.isNotNull() & (possible >= need)
        common = F.size(F.array_intersect(mine, own))
        return F.when(passes & (common >= need), common / F.lit(float(len(words))))

    def verdict(block: Column) -> Column:
        return F.array(*[F.struct(F.lit(label).alias("label"), share(block, words, need).alias("share")) for (label, words), need in zip(ordered, needs)])

    def passage_share(every: Column, words: list[str], need: int, length: int) -> Column:
        """The largest share that `length` consecutive words hold; every: the words of the text."""
        own = F.array(*map(F.lit, words))
        placed = F.filter(F.transform(every, lambda w, i: F.struct(i.alias("at"), w.alias("w"))), lambda p: p["w"].isin(words))

        def held(mine: Column, k: Column) -> Column:
            near = F.filter(F.slice(mine, k, length), lambda p: p["at"] < F.element_at(mine, k)["at"] + length)
            return F.size(F.array_distinct(F.transform(near, lambda p: p["w"])))

        # an array of one binds it, else it would be found again for each k
        most = F.element_at(F.transform(F.array(placed), lambda mine: F.array_max(F.transform(F.sequence(F.lit(1), F.size(mine)), lambda k: held(mine, k)))), 1)
        share = F.when(F.size(F.array_intersect(every, own)) >= need, most) / F.lit(float(len(words)))
        return F.when(share >= need / len(words) - 1e-9, share)

    def passages(every: Column) -> Column:
        return F.array(*[F.struct(F.lit(label).alias("label"), passage_share(every, words, need, length).alias("share")) for (label, words), need, length in zip(ordered, needs, lengths)])

    both = F.concat(F.flatten(F.transform(ranked, verdict)), F.flatten(F.transform(F.array(words_of(lowered(text))), passages)))
    return F.filter(both, lambda h: h["share"].isNotNull()), prefixes

def license_scan(docs: DataFrame, text_col: str = "text", templates: dict[str, list[str]] | None = None, phrases: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels (arrays) and score, the largest share of a
    template's words that a block holds (1 for a stated phrase; 0 without any label)."""
    templates = TEMPLATES if templates is None else templates
    phrases = PHRASES if phrases is None else phrases
    lists = [(label, python_words(t)) for label, texts in templates.items() for t in texts]
    lists = [(label, words) for label, words in lists if words]
    if not lists:
        raise ValueError("no template has a word")
    often = word_frequencies(docs, text_col, sorted({w for _, words in lists for w in words}))
    text = F.coalesce(F.col(text_col), F.lit(""))
    names = {c: free_name(docs, c) for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")}
    batches = [template_hits(text, batch, often, threshold) for batch in batches_of(lists)]
    words = free_name(docs, "words")
    got = [free_name(docs, f"hits{i}") for i in range(len(batches))]
    ends = lambda at: F.element_at(words, at) == ""
    n_words = F.size(words) - ends(1).cast("int") - (ends(-1) & (F.size(words) > 1)).cast("int")
    out = docs.withColumn(words, F.split(F.lower(text), BREAK + "+"))
    out = out.withColumns({names["n_words"]: n_words.cast("long"), **{g: F.arrays_overlap(words, F.array(*map(F.lit, prefixes))) for g, (_, prefixes) in zip(got, batches)}}).drop(words)
    out = with_phrases(out, text, phrases, names).withColumns({g: F.when(F.col(g), hits) for g, (hits, _) in zip(got, batches)})
    none = F.array().cast("array<struct<label:string,share:double>>")
    met = F.concat(*[F.coalesce(F.col(g), none) for g in got])
    return out.withColumns(
        {
            names["labels"]: F.array_sort(F.array_union(F.col(names["base_labels"]), F.transform(met, lambda h: h["label"]))),
            names["score"]: F.when(F.size(names["base_labels"]) > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform(met, lambda h: h["share"])), F.lit(0.0))),
        }
    ).drop(*got)


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    out = license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")
