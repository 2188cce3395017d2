"""License scans with a positional index of rare licence words.

Each licence notice is a template: its words with their positions, and a key phrase that has to be there. The
document frequency of every template word is counted over all documents, and the index has the places of each
template's INDEXED words of highest IDF. In each document, the ANCHORS indexed words of highest IDF that the document
holds are looked up for each template (a rare word that was changed makes room for the next one); places that agree in
document position minus template position line up, and the IDF of what lines up, over the IDF of the template's
ANCHORS rarest words, is the alignment's share. Where it reaches SHARE the key phrase must stand, word by word, where the
alignment says; score and best come from alignments that were verified in this way, and are 0 and null without any.

Everything is row by row in built-in array functions; only the template words' document frequencies (a fixed
vocabulary) reach the driver. Work per document is its words, plus one look at the index for the words that it holds;
only where a template's words that are there could reach the share are their places lined up, sorted and folded with a
state of constant size.

Defined results: a null text has no words; texts of any length are read whole; repeated rows and null ids are rows of
their own; of templates with equal shares the first is `best`; an empty table gives an empty result; other columns pass
through, and the operator's own take the place of columns of the same name.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_name, making_room, whole_text

#: Words, once A-Z is lower-cased; and what parts them.
WORD, GAP = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANCHORS, INDEXED, SHARE = 6, 12, 0.6
#: The phrases whose places are counted, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Sentences of public licence notices (label, notice, key phrase within it).
NOTICES = [
    ("gpl", "licensed under the gnu general public license version", "gnu general public license"),
    ("gpl", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    ("apache", "licensed under the apache license version", "apache license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "any person obtaining a copy of this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("cc-by", "licensed under cc by", "cc by"),
    ("cc-by-nc", "licensed under cc by nc", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa", "cc by sa"),
    ("cc-by-nd", "licensed under cc by nd", "cc by nd"),
    ("cc-by", "licensed under a creative commons attribution", "creative commons attribution"),
    ("cc0", "released under cc0 public domain dedication", "cc0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "use copy modify and or distribute this software for any purpose"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("epl", "made available under the terms of the eclipse public license", "eclipse public license"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", "see the gnu general public license"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program if not see", "copy of the gnu general public license"),
    ("lgpl", "you should have received a copy of the gnu lesser general public license along with this library if not see", "copy of the gnu lesser general public license"),
    ("agpl", "you should have received a copy of the gnu affero general public license along with this program if not see", "copy of the gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache license version 2 0"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "distributed on an as is basis"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "this permission notice shall be included in all copies or substantial portions"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "may be used to endorse or promote products derived from this software"),
    ("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at", "a copy of the mpl was not distributed with this file"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law", "dedicated the work to the public domain"),
    ("bsl", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "any person or organization obtaining a copy of the software and accompanying documentation"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable for any damages"),
]


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    key: tuple[str, ...]
    key_at: int


def templates(notices: list[tuple[str, str, str]] = NOTICES) -> list[Template]:
    out = []
    for label, notice, key in notices:
        w, k = tuple(notice.split()), tuple(key.split())
        out.append(Template(label, w, k, next(i for i in range(len(w)) if w[i : i + len(k)] == k)))
    return out


def words_of(text: Column) -> Column:
    """The words, A-Z in lower case."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.array_remove(F.split(F.translate(text, upper, upper.lower()), GAP), "")


def inverse_frequencies(docs: DataFrame, text_col: str, vocabulary: set[str]) -> dict[str, float]:
    """IDF of each word of the vocabulary over all documents."""
    known = F.array(*map(F.lit, sorted(vocabulary)))
    held = docs.select(F.explode(F.array_union(F.array(F.lit("")), F.array_intersect(words_of(whole_text(text_col)), known))).alias("word"))
    counts = {r[0]: r[1] for r in held.groupBy("word").count().collect()}  # a row for each word of the vocabulary, and one for all
    n = counts.get("", 0)
    return {w: math.log((n + 1) / (counts.get(w, 0) + 0.5)) for w in vocabulary}


def scan(docs: DataFrame, text_col: str = "text", notices: list[tuple[str, str, str]] = NOTICES, base: dict[str, str] = BASE) -> DataFrame:
    """docs without the text, with n_words, n_base, first_word, last_word, base_labels, labels, score and best (the aligned template's label)."""
    known = templates(notices)
    idf = inverse_frequencies(docs, text_col, {w for t in known for w in t.words})
    label_names = sorted({t.label for t in known})
    if len(label_names) > 62:
        raise ValueError("at most 62 different labels fit the fold's state")
    # Of each template: its rare words, rarest first, each with its places in the template and its IDF's share.
    lookups = []
    for k, t in enumerate(known):
        rare = sorted(dict.fromkeys(t.words), key=lambda w: (-idf[w], t.words.index(w)))[:INDEXED]
        whole = sum(idf[w] for w in rare[:ANCHORS]) or 1.0
        lookups.append((k, [(w, [i for i, x in enumerate(t.words) if x == w], idf[w] / whole) for w in rare]))
    phrases = [(p.split(), label) for p, label in base.items()]
    added = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "best"]
    docs = making_room(docs, added, keep=(text_col,))
    kept = [f"`{c}`" for c in docs.columns if c != text_col]
    n = {k: fresh_name(docs, k) for k in ("words", "places", "held", "present", "starts", "lined", "sums")}
    words = F.col(n["words"])
    word = lambda i: F.get(words, i)
    indexed = sorted({w for _, ws in lookups for w, _, _ in ws})
    everywhere = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)))
    places = F.filter(everywhere, lambda i: word(i).isin(sorted({p[0] for p, _ in phrases})))
    stands = lambda phrase, i: F.slice(words, i + 1, len(phrase)) == F.array(*map(F.lit, phrase))

    def places_of(k: int, phrase: list[str]) -> Column:
        found = F.filter(F.col(n["places"]), lambda i: (word(i) == phrase[0]) & stands(phrase, i))
        return F.transform(found, lambda i: F.struct(i.cast("long").alias("at"), F.lit(k).alias("phrase")))

    # Places of the base phrases: (start, number of the phrase).
    starts = F.flatten(F.array(*[places_of(k, p) for k, (p, _) in enumerate(phrases)]))
    held = F.array_intersect(words, F.array(*map(F.lit, indexed)))
    # The index: (template, word, its places in the template, its share), the rarest of each template first.
    entry = "array<struct<t:int,w:string,at:array<int>,s:double>>"
    index = F.from_json(F.lit(json.dumps([{"t": k, "w": w, "at": at, "s": s} for k, ws in lookups for w, at, s in ws])), entry)
    present = F.when(F.size(n["held"]) > 0, F.filter(index, lambda x: F.array_contains(F.col(n["held"]), x["w"]))).otherwise(F.array().cast(entry))
    # Templates of which the document's rarest words could reach the share; few documents have any.
    count = "struct<t:int,n:int,s:double,could:array<int>>"

    def weigh(acc: Column, x: Column) -> Column:
        same = acc["t"] == x["t"]
        taken = F.when(same, acc["n"]).otherwise(0)
        before = F.when(same, acc["s"]).otherwise(0.0)
        total = before + F.when(taken < ANCHORS, x["s"]).otherwise(0.0)
        reached = (total >= SHARE - 1e-9) & (before < SHARE - 1e-9)
        return F.struct(x["t"].alias("t"), (taken + 1).alias("n"), total.alias("s"), F.when(reached, F.concat(acc["could"], F.array(x["t"]))).otherwise(acc["could"]).alias("could")).cast(count)

    none = F.struct(F.lit(-1).alias("t"), F.lit(0).alias("n"), F.lit(0.0).alias("s"), F.array().cast("array<int>").alias("could")).cast(count)
    could = F.aggregate(n["present"], none, weigh)["could"]
    chosen = F.flatten(F.transform(could, lambda t: F.slice(F.filter(F.col(n["present"]), lambda x: x["t"] == t), 1, ANCHORS)))
    # Places of each chosen word in the document, against its places in the template.
    lined = F.array_sort(F.flatten(F.transform(
        chosen,
        lambda x: F.flatten(F.transform(F.filter(everywhere, lambda i: word(i) == x["w"]), lambda i: F.transform(x["at"], lambda p: F.struct(x["t"].alias("t"), (i - p).alias("at"), x["s"].alias("s"))))),
    )))
    state = "struct<t:int,at:int,s:double,ok:boolean,best:double,best_t:int,mask:bigint>"
    start = F.struct(F.lit(-1).alias("t"), F.lit(0).alias("at"), F.lit(0.0).alias("s"), F.lit(False).alias("ok"), F.lit(0.0).alias("best"), F.lit(-1).alias("best_t"), F.lit(0).cast("long").alias("mask")).cast(state)
    keys = F.array(*[F.struct(F.lit(t.key_at).alias("at"), F.array(*map(F.lit, t.key)).alias("key")) for t in known])
    bits = F.array(*[F.lit(1 << label_names.index(t.label)).cast("long") for t in known])

    def verified(t: Column, at: Column) -> Column:
        key = F.get(keys, t)
        first = at + key["at"]
        return (first >= 0) & (F.slice(words, F.greatest(first, F.lit(0)) + 1, F.size(key["key"])) == key["key"])

    def add(acc: Column, h: Column) -> Column:
        same = (acc["t"] == h["t"]) & (acc["at"] == h["at"])
        total = F.when(same, acc["s"]).otherwise(0.0) + h["s"]
        # The key phrase is looked at once, when the alignment's share passes.
        passes = (total >= SHARE - 1e-9) & ~(same & (acc["s"] >= SHARE - 1e-9))
        ok = F.when(passes, verified(h["t"], h["at"])).otherwise(same & acc["ok"])
        better = ok & (total > acc["best"] + 1e-12)
        return F.struct(
            h["t"].alias("t"), h["at"].alias("at"), total.alias("s"), ok.alias("ok"), F.when(better, total).otherwise(acc["best"]).alias("best"), F.when(better, h["t"]).otherwise(acc["best_t"]).alias("best_t"),
            F.when(ok, acc["mask"].bitwiseOR(F.get(bits, h["t"]))).otherwise(acc["mask"]).alias("mask"),
        ).cast(state)

    sums = F.col(n["sums"])
    base_list = F.array_distinct(F.transform(F.col(n["starts"]), lambda s: F.get(F.array(*[F.lit(label) for _, label in phrases]), s["phrase"])))
    numbered = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(1 << k).cast("long").alias("bit")) for k, label in enumerate(label_names)])
    own = F.transform(F.filter(numbered, lambda x: sums["mask"].bitwiseAND(x["bit"]) != 0), lambda x: x["label"])
    out = docs.withColumn(n["words"], words_of(whole_text(text_col))).withColumn(n["places"], places)
    out = out.withColumns({n["starts"]: starts, n["held"]: held}).withColumn(n["present"], present).withColumn(n["lined"], lined).withColumn(n["sums"], F.aggregate(n["lined"], start, add))
    at = F.transform(F.col(n["starts"]), lambda s: s["at"])
    names = F.array(*[F.lit(t.label) for t in known])
    return out.select(
        *kept, F.size(words).cast("long").alias("n_words"), F.size(F.col(n["starts"])).cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        F.array_join(F.array_sort(base_list), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base_list, own)), ",").alias("labels"),
        F.least(F.lit(1.0), F.round(sums["best"], 9)).alias("score"), F.get(names, F.when(sums["best_t"] >= 0, sums["best_t"])).alias("best"),
    )
