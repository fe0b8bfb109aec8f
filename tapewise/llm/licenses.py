"""License scans: a trained paragraph classifier with template confirmation, with DataFrame, SQL and Spark ML only."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, quoted

UNKNOWN = "unknown"
#: Usual wordings of licence notices by family.
TEMPLATES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "This project is released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Released under the BSD 3-Clause License.",
        "Licensed under the new BSD license.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation.",
        "This software is provided by the copyright holders and contributors as is and any express or implied warranties are disclaimed.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products without specific prior written permission. Redistribution and use",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Content available under the CC BY-NC-SA 4.0 license.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Content available under the CC BY-SA 4.0 license.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.",
        "Released under the GNU GPL version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
        "Licensed under the MIT license.",
        "SPDX-License-Identifier: MIT",
        "The software is provided as is, without warranty of any kind, express or implied, including the warranties of merchantability, fitness for a particular purpose and noninfringement.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "Released under the GNU LGPL version 3 or later.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ),
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License.",
        "Licensed under the GNU Affero General Public License, version 3.",
        "Released under the GNU AGPL version 3 or later.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
        "Licensed under the ISC license.",
        "Released under the terms of the ISC License.",
        "SPDX-License-Identifier: ISC",
        "The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties.",
    ),
    "boost": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation.",
        "Distributed under the Boost Software License, Version 1.0.",
        "SPDX-License-Identifier: BSL-1.0",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one; this Source Code Form is under the Mozilla Public License.",
    ),
    "public-domain": (
        "This work has been released into the public domain.",
        "To the extent possible under law, the author has waived all copyright under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
        "This is free and unencumbered software released into the public domain.",
    ),
}
#: What the families are called.
NAMES = {
    "apache": ("Apache License", "Apache License 2.0", "Apache License, Version 2.0", "Apache Software License", "Apache 2.0", "Apache 2", "Apache-2.0"),
    "bsd": ("BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "3-clause BSD license", "2-clause BSD license", "new BSD license", "simplified BSD license", "modified BSD license", "BSD-3-Clause", "BSD-2-Clause"),
    "cc-by-nc": ("CC BY-NC 4.0", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0", "CC-BY-NC-4.0", "CC-BY-NC-SA-4.0", "Creative Commons Attribution-NonCommercial 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0"),
    "cc-by": ("CC BY 4.0", "CC BY 3.0", "CC BY-SA 4.0", "CC BY-SA 3.0", "CC-BY-4.0", "CC-BY-SA-4.0", "Creative Commons Attribution 4.0", "Creative Commons Attribution-ShareAlike 4.0"),
    "gpl": ("GPL", "GPLv2", "GPLv3", "GPL v2", "GPL v3", "GPL version 2", "GPL version 3", "GNU GPL", "GNU GPL v3", "GNU General Public License", "GNU General Public License v3.0", "GPL-2.0", "GPL-3.0", "GPL-2.0-only", "GPL-3.0-only", "GPL-2.0-or-later"),
    "mit": ("MIT License", "MIT/X11 license", "MIT/Expat license", "Expat License"),
    "lgpl": ("LGPL", "LGPLv2.1", "LGPLv3", "LGPL v3", "LGPL version 2.1", "GNU LGPL", "GNU Lesser General Public License", "GNU Library General Public License", "LGPL-2.1-only", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"),
    "agpl": ("AGPL", "AGPLv3", "AGPL v3", "GNU AGPL", "GNU Affero General Public License", "AGPL-3.0", "AGPL-3.0-or-later"),
    "isc": ("ISC License",),
    "boost": ("Boost Software License", "Boost Software License 1.0", "Boost License", "BSL-1.0"),
    "mpl": ("Mozilla Public License", "Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0", "MPLv2"),
    "public-domain": ("public domain", "CC0", "CC0 1.0 Universal", "CC0-1.0", "Unlicense", "Creative Commons Zero"),
}
#: Names that also mean other things; they count only in one of FORMS.
SHORT = {"apache": ("Apache",), "bsd": ("BSD",), "cc-by": ("CC BY", "CC BY-SA"), "cc-by-nc": ("CC BY-NC",), "mit": ("MIT",), "isc": ("ISC",), "boost": ("Boost",), "mpl": ("MPL",)}
FORMS = ("license {}", "licence {}", "licensed {}", "{} licensed", "{} licenced", "{} license", "{} licence", "under {} terms", "under the {}", "or {}", "spdx-license-identifier {}")
#: Licences of other families, and what is no licence's name.
STRANGE_NAMES = (
    "Eclipse Public License 2.0", "EPL-2.0", "CDDL", "Artistic License 2.0", "WTFPL", "commercial license", "proprietary license", "custom license", "Oracle Technology Network License", "Microsoft Public License", "zlib License",
    "Python Software Foundation License", "SIL Open Font License", "Business Source License", "Elastic License 2.0", "SSPL", "end user license agreement", "enterprise license", "European Union Public Licence", "following license", "Academic Free License",
)
#: Sentences around a name; without a licence word of their own and of the name they are left out.
CARRIERS = (
    "{}", "Licensed under the {}.", "Licensed under {}", "Released under the {} or later.", "License: {}", "The code is {} licensed.", "This project is licensed under the terms of the {}.",
    "Distributed under the {}. See LICENSE for more information.", "license = \"{}\"", "SPDX-License-Identifier: {}", "Copyright (c) 2021 Ann Other. Published under {}, see the LICENSE file.",
    "You may use it under either the {} or another license, at your option.", "All files here are covered by the {}.", "Dual-licensed: {} or a commercial license", "licence {}",
)
#: Paragraphs with licence words that belong to no family.
OTHER = (
    "All rights reserved.",
    "Copyright by the author. No part of this publication may be reproduced without permission.",
    "A driving license is required for this position.",
    "The license fee is due at the start of each year.",
    "Use is governed by the commercial license agreement between the parties.",
    "Licensed to the customer under separate terms.",
    "The copyright holder may revoke the license at any time.",
    "Please contact us to obtain a license for this product.",
    "The public domain of the function is the set of real numbers.",
    "Redistribution of income was the topic of the debate.",
    "The warranty of the washing machine ends after two years.",
    "This product comes without any warranty if the seal is broken.",
    "Admission is free of charge for children, and lunch can be had without fee.",
    "Die License mit der Nummer 12 liegt bei, sie gilt nur mit einer Unterschrift.",
    "Eine Licence mit Aufpreis kostet mehr als eine License mit Wartung.",
    "He worked at the MIT and later at Boost, a firm that sells licenses to Apache helicopters.",
    "Copyright 1999 by the author and the illustrator.",
    "The court waived the fine, and the licence of the tavern was given back.",
    "See the license of the package for details, it differs from file to file.",
)
#: Families that share wordings; they are left out of a calibration round together.
KIN = (("gpl", "lgpl", "agpl"), ("mit", "isc", "boost"), ("cc-by", "cc-by-nc"), ("apache",), ("bsd",), ("mpl",), ("public-domain",))
#: The first step of the method: only paragraphs with such a word are classified. All that the model learns as a family has one (tested); names
#: that are common words ("MIT" alone is also German) count only beside one.
CUES = r"(?i)licen[cs](?:e|ing)|copyright|redistribut|public domain|all rights reserved|free of charge|without fee|waive[ds]|warrant(?:y|ies)|unencumbered|mozilla public|creative commons|\b[AL]?GPL(?:v?[0-9]|\b)|\bCC[ -]BY|\bCC0|\b(?:BSD|Apache|MPL|BSL)-[0-9]"
#: The same in a text whose lines are wrapped, maybe behind comment signs; and what at least one word of every cue is like.
WRAPPED_CUES = CUES.replace(" ", "[^A-Za-z0-9]+")
_CUE_WORD = r"licen[cs](e|ing)|copyright|redistribut|waive[ds]|warrant|unencumbered|\b[al]?gpl|\b(domain|reserved|charge|fee|cc|mozilla|commons)\b|\bcc0|\b(bsd|apache|mpl|bsl)-[0-9]"
#: Sizes of the word windows of a paragraph. Windows of one size start every quarter of it, so 24 words in a row (the longest template has 23) lie in a window.
WINDOWS = (4, 8, 16, 32)
N_FEATURES, MAX_GRAM, FOLDS = 8192, 3, 3
#: Share of a wording's word pairs that a window must hold to confirm the family.
CONFIRM = 0.6


@dataclass
class LicenseModel:
    """Fitted classifier, its families by index, and the line that turns a family's log-odds against 'unknown' into calibrated ones."""

    lr: LogisticRegressionModel
    families: list[str]
    slope: float
    offset: float


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-z0-9.+-]+|[.](?=\s|$|\")"), lambda w: w != "")


def _grams(words: str, most: int = MAX_GRAM) -> Column:
    """All runs of 1 to ``most`` words."""
    runs = [f"IF(size({words}) >= {n}, transform(sequence(0, size({words}) - {n}), i -> concat_ws(' ', slice({words}, i + 1, {n}))), array())" for n in range(1, most + 1)]
    return F.expr(f"concat({', '.join(runs)})")


def _features(paragraphs: DataFrame) -> DataFrame:
    grams = paragraphs.withColumn("_words", words_of(F.col("paragraph"))).withColumn("_grams", _grams("_words"))
    return HashingTF(numFeatures=N_FEATURES, binary=True, inputCol="_grams", outputCol="features").transform(grams)


def training_paragraphs(spark: SparkSession) -> DataFrame:
    """(paragraph, family, fold): templates and OTHER as they are, with a word left out, and with words around them; names in all CARRIERS.

    All paragraphs of a template or of a name are in one fold.
    """
    rows = [(f, k % FOLDS, t) for f, ts in TEMPLATES.items() for k, t in enumerate(ts)] + [(UNKNOWN, k % FOLDS, t) for k, t in enumerate(OTHER)]
    given = spark.createDataFrame(rows, "family string, fold int, text string").withColumn("_w", F.split("text", " "))
    less = given.select("family", "fold", F.explode(F.expr(
        "transform(sequence(0, size(_w) - 1), i -> concat_ws(' ', filter(_w, (w, k) -> size(_w) <= 3 OR k <> i)))")).alias("paragraph"))
    around = given.select("family", "fold", F.explode(F.array(
        F.col("text"), F.lower("text"), F.upper("text"), F.concat(F.lit("* "), F.col("text")), F.concat(F.lit("Note: "), F.col("text"), F.lit(" See the file for details.")),
        F.concat(F.lit("Copyright 2020 The Authors. "), F.col("text")))).alias("paragraph"))
    known = [(f, k % FOLDS, n) for f, ns in NAMES.items() for k, n in enumerate([*ns, *SHORT.get(f, ())])]
    known += [(UNKNOWN, k % FOLDS, n) for k, n in enumerate(STRANGE_NAMES)]
    named = [(f, fold, c.format(n)) for f, fold, n in known for c in CARRIERS if f == UNKNOWN or re.search(CUES, c.format(n))]
    return less.unionByName(around).unionByName(spark.createDataFrame(named, "family string, fold int, paragraph string")).distinct()


def _scored(found: DataFrame, families: list[str]) -> DataFrame:
    """Adds ``_odds``: log-odds of each family against 'unknown', in the order of ``families``; they don't compete, so several can hold."""
    at = families.index(UNKNOWN)
    return found.withColumn("_raw", vector_to_array("rawPrediction")).withColumn("_odds", F.expr(f"transform(_raw, (m, i) -> IF(i = {at}, -1e9D, m - _raw[{at}]))"))


def fit_licenses(spark: SparkSession) -> LicenseModel:
    """Multinomial logistic regression on sparse word n-grams of the training paragraphs, and its calibration.

    In each round of the calibration a fold of templates and every third group of KIN are left out of the training and then scored: paragraphs of
    left-out templates and names can be right, those of no family and of the left-out families, for which the model has no name, never are. A second
    logistic regression of 'right' on the likeliest family's log-odds against 'unknown', right and wrong ones weighing the same, gives the calibrated
    probability; a family with less than 0.5 doesn't hold.
    """
    families = sorted([*TEMPLATES, UNKNOWN])
    index = F.array_position(F.array(*map(F.lit, families)), F.col("family")) - 1
    rows = _features(training_paragraphs(spark)).withColumn("label", index.cast("double")).select("features", "label", "family", "fold").coalesce(1).cache()
    lr = LogisticRegression(family="multinomial", regParam=0.002, maxIter=25)
    seen = None
    for fold in range(FOLDS):
        strange = F.col("family").isin([f for kin in KIN[fold::FOLDS] for f in kin])
        left = (F.col("fold") == fold) | strange
        scored = _scored(lr.fit(rows.where(~left)).transform(rows.where(left)), families).withColumn("_best", F.array_max("_odds"))
        right = (F.expr("array_position(_odds, _best)") - 1 == F.col("label")) & ~strange
        part = scored.select(right.cast("double").alias("right"), array_to_vector(F.array("_best")).alias("odds"))
        seen = part if seen is None else seen.unionByName(part)
    seen = seen.cache()
    share = seen.agg(F.avg("right")).first()[0]
    seen_even = seen.withColumn("weight", F.when(F.col("right") == 1, 0.5 / share).otherwise(0.5 / (1 - share)))
    line = LogisticRegression(featuresCol="odds", labelCol="right", weightCol="weight", regParam=0.01).fit(seen_even)
    seen.unpersist()
    model = lr.fit(rows)
    rows.unpersist()
    return LicenseModel(model, families, float(line.coefficients[0]), float(line.intercept))


def _pairs(text: str) -> list[str]:
    """Distinct word pairs of a wording, or its only word; words as in ``words_of``."""
    words = [w for w in re.split(r"[^a-z0-9.+-]+|[.](?=\s|$|\")", text.lower()) if w]
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))) or words


def wordings() -> list[tuple[str, list[str], list[str]]]:
    """(family, pairs, those of them that no other family's wordings have) of every template, name and form of a short name."""
    of = {f: [_pairs(t) for t in (*TEMPLATES[f], *NAMES[f], *(form.format(n) for n in SHORT.get(f, ()) for form in FORMS))] for f in TEMPLATES}
    out = []
    for family, lists in of.items():
        others = {p for f, ls in of.items() if f != family for ps in ls for p in ps}
        out += [(family, ps, [p for p in ps if p not in others]) for ps in lists]
    return [x for x in out if x[2]]


def _confirmed(words: str, candidates: str) -> Column:
    """The families among ``candidates`` of which the words hold a wording: CONFIRM of its pairs, one that no other family has among them.

    So the start of a notice that two families share confirms neither.
    """
    texts = lambda values: F.array(*map(F.lit, values))
    known = F.array(*[F.struct(F.lit(f).alias("family"), texts(ps).alias("pairs"), texts(own).alias("own")) for f, ps, own in wordings()])
    held = F.expr(f"concat({words}, IF(size({words}) < 2, array(), transform(sequence(0, greatest(size({words}) - 2, 0)), i -> concat_ws(' ', slice({words}, i + 1, 2)))))")
    holds = lambda w: F.array_contains(candidates, w["family"]) & F.arrays_overlap(w["own"], held) & (F.size(F.array_intersect(w["pairs"], held)) >= CONFIRM * F.size(w["pairs"]))
    return F.when(F.size(candidates) > 0, F.array_distinct(F.transform(F.filter(known, holds), lambda w: w["family"]))).otherwise(F.array().cast("array<string>"))


def _windows(words: str) -> str:
    """Start * 64 + size of the windows that hold a word like a cue's."""
    sizes = ", ".join(map(str, WINDOWS))
    return f"""
        array_distinct(flatten(transform(
            filter(transform({words}, (w, i) -> IF(w RLIKE r'{_CUE_WORD}', bigint(i), -1L)), i -> i >= 0),
            i -> flatten(transform(array({sizes}), n -> transform(sequence(0, 3), k -> greatest(i div (n div 4) - k, 0L) * (n div 4) * 64 + n))))))
    """


def license_windows(docs: DataFrame, model: LicenseModel, text: str = "text", row: str = "_row") -> DataFrame:
    """(row, place, window, families, probability): what is classified of each paragraph of ``docs`` that has a licence word.

    Paragraphs end at empty lines; ``place`` is a paragraph's number in its row. Classified are the paragraph's word windows, across its
    lines, and its single lines, those of them that have a licence word. ``families`` are those that the classifier is sure of and a
    wording confirms, maybe several; ``probability`` is the likeliest family's. A paragraph whose licence words only the wrapping makes look
    like one has one empty window without families.
    """
    text, row = quoted(text), quoted(row)
    cued = docs.where(F.coalesce(F.col(text).rlike(WRAPPED_CUES), F.lit(False)))
    paragraphs = cued.select(row, F.posexplode(F.split(text, r"\n\s*\n")).alias("place", "_paragraph")).where(F.col("_paragraph").rlike(WRAPPED_CUES))
    joined = F.regexp_replace("_paragraph", r"(?<=[A-Za-z])-[\x20\t\r]*\n[\s*#/>]*", "-")  # a word with a hyphen that is wrapped behind it
    split = paragraphs.withColumn("_all", words_of(joined))
    texts = F.concat(
        F.expr(f"transform({_windows('_all')}, x -> concat_ws(' ', slice(_all, int(x div 64) + 1, int(x % 64))))"),
        F.filter(F.split("_paragraph", "\n"), lambda line: line.rlike(CUES)),
    )
    texts = F.array_distinct(F.filter(texts, lambda t: t.rlike(CUES)))
    windows = split.select(row, "place", F.explode(F.when(F.size(texts) > 0, texts).otherwise(F.array(F.lit("")))).alias("paragraph"))
    scored = _scored(model.lr.transform(_features(windows)), model.families)
    calibrated = 1 / (1 + F.exp(-(model.slope * F.array_max("_odds") + model.offset)))
    names = F.array(*map(F.lit, model.families))
    scored = scored.withColumn("_names", names).withColumn("_sure", F.expr(f"filter(_names, (f, i) -> {model.slope!r}D * _odds[i] + {model.offset!r}D >= 0)"))
    return scored.select(row, "place", F.col("paragraph").alias("window"), _confirmed("_words", "_sure").alias("families"), calibrated.alias("probability"))


def scan_licenses(docs: DataFrame, model: LicenseModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, licenses (families found, sorted and comma-joined), n_confirmed and n_unknown (long).

    Whole texts are scanned paragraph by paragraph. n_confirmed counts each family of each paragraph, n_unknown the paragraphs that have a
    licence word and no family. Null and empty texts have none; repeated rows and null keys are scanned each by itself and get equal results;
    other columns are left out; an empty table gives an empty one.
    """
    cued = F.when(F.col(quoted(text)).rlike(WRAPPED_CUES), F.col(quoted(text)))
    rows = materialise(docs.select(F.col(quoted(key)).alias("_key"), F.monotonically_increasing_id().alias("_row"), cued.alias("_text")), "licenses")
    hits = rows.where("_text is not null")
    found = license_windows(hits.select("_row", "_text"), model, "_text").groupBy("_row", "place").agg(F.array_distinct(F.flatten(F.collect_set("families"))).alias("_families"))
    per_row = found.groupBy("_row").agg(
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_families")))), ",").alias("licenses"),
        F.sum(F.size("_families")).cast("long").alias("n_confirmed"), F.count(F.when(F.size("_families") == 0, 1)).alias("n_unknown"),
    )
    names = ["licenses", "n_confirmed", "n_unknown"]
    empty = [F.lit("").alias("licenses"), F.lit(0).cast("long").alias("n_confirmed"), F.lit(0).cast("long").alias("n_unknown")]
    some = hits.select("_key", "_row").join(per_row, "_row", "left")  # a cue may reach over an empty line, then no paragraph has it
    some = some.select(F.col("_key").alias(key), *[F.coalesce(c, e).alias(c) for c, e in zip(names, empty, strict=True)])
    return some.unionByName(rows.where("_text is null").select(F.col("_key").alias(key), *empty))
