"""Licence scan: a trained paragraph classifier confirmed by template comparison; DataFrame functions only.

A paragraph is a non-empty line; a line of ``WRAPPED`` characters or more without an end mark goes on in the next line, whose comment marks are left out. Every paragraph is classified by multinomial logistic regression on sparse word bigrams and
trigrams of the trained vocabulary, and on the short names in ``TOKENS``, trained on the notices and names below, their sentences
and ordinary sentences. A family is accepted if its probability reaches the threshold that ``train`` fits on held-out halves (the
least at which at most ``WRONG`` of the accepted have another family) and its templates confirm it: either
``CONFIRM`` of the paragraph's bigrams lie in the family's templates, or ``CONFIRM`` of one template's lie in the
paragraph. All else that the classifier does not hold to be ordinary, or that holds one of the ``ANCHORS``, is unknown.

Cases: null and empty texts have no licences; a paragraph of any length is read whole; rows that repeat a doc_id
are counted together; a null doc_id is one document; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, NGram, SQLTransformer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.llm import store

# Common public licence notices by family.
TEMPLATES = {
    "apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "SPDX-License-Identifier: Apache-2.0", "This project is released under the Apache 2.0 license."),
    "mit": ("Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.", "SPDX-License-Identifier: MIT", "This project is available under the MIT license."),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice in the documentation.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", "Released under the BSD license."),
    "gpl": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.", "You should have received a copy of the GNU General Public License along with this program.", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.", "SPDX-License-Identifier: GPL-3.0-or-later", "Licensed under the GNU GPL version 2.", "Released under the GPL v3 license."),
    "lgpl": ("Licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.", "SPDX-License-Identifier: LGPL-2.1-only", "You should have received a copy of the GNU Lesser General Public License along with this library."),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0", "If a copy of the Mozilla Public License was not distributed with this file, you can obtain one at http://mozilla.org/MPL/2.0/."),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Text is available under the Creative Commons Attribution license.", "SPDX-License-Identifier: CC-BY-4.0"),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Available under the Creative Commons Attribution-NonCommercial license.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Licensed under the ISC License.", "SPDX-License-Identifier: ISC", "Released under the ISC license."),
    "epl": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "Licensed under the Eclipse Public License, version 2.0.", "SPDX-License-Identifier: EPL-2.0", "Released under the Eclipse Public License."),
    "public-domain": ("This is free and unencumbered software released into the public domain.", "To the extent possible under law, the author has waived all copyright and related rights under CC0 1.0.", "Dedicated to the public domain.", "SPDX-License-Identifier: CC0-1.0"),
    "proprietary": ("All rights reserved.", "Copyright (c) 2020 Example Inc. All rights reserved.", "No part of this publication may be reproduced without the prior written permission of the copyright holder.", "Proprietary and confidential; unauthorised copying of this file is prohibited, all rights reserved."),
}
# Short names of the families.
NAMES = {
    "apache-2.0": ("Apache-2.0", "Apache 2", "Apache v2", "Apache License 2.0", "Apache License v2.0"),
    "mit": ("MIT License", "MIT licence", "License: MIT", "Code: MIT", "MIT licensed"),
    "bsd": ("BSD-3-Clause", "BSD-2-Clause", "BSD 3", "BSD 2", "BSD license", "BSD licence"),
    "gpl": ("GPLv3", "GPLv2", "GPL 3", "GPL 2", "GPL-3.0", "GPL-2.0", "GNU GPL"),
    "lgpl": ("LGPLv3", "LGPLv2.1", "LGPL 3", "LGPL-3.0", "LGPL-2.1", "GNU LGPL"),
    "mpl": ("MPL 2.0", "MPL 2", "MPL v2", "MPL 1.1", "Mozilla Public License"),
    "cc-by": ("CC BY 4.0", "CC BY 3.0", "CC BY 2.0", "License: CC BY"),
    "cc-by-sa": ("CC BY-SA 4.0", "CC BY-SA 3.0", "CC BY-SA 2.0", "License: CC BY-SA"),
    "cc-by-nc": ("CC BY-NC 4.0", "CC BY-NC 3.0", "CC BY-NC 2.0", "License: CC BY-NC"),
    "isc": ("ISC License", "License: ISC", "ISC licence"),
    "epl": ("EPL 2.0", "EPL-2.0", "EPL 1.0", "Eclipse Public License"),
    "public-domain": ("CC0 1.0", "License: CC0", "under CC0"),
}
TOKENS = ("gpl", "lgpl", "mpl", "bsd", "cc0", "isc", "epl")
# Ordinary sentences with the same words.
ORDINARY = ("She renewed her driving license at the office last week.", "The court discussed copyright law and its history.", "The shop gives a two year warranty on every phone.", "Fishing without a licence is not allowed in the public park.", "He was granted permission to redistribute the grain.", "The royalty was paid for the right to use the song.", "The general public was not admitted to the software fair.", "An export licence is needed for this kind of machine.", "The copyright of the novel passed to his daughter.", "The warranty does not cover water damage.", "The minister of public works opened the new bridge.", "The pilot lost his license after the accident.", "The lecture explains how a license fee is set by the state.", "They released the film in the spring under another title.")
# Ordinary prose with the function words that notices also use; the empty line has no known n-gram at all.
PROSE = ("", "In the morning the two of them walked along the river to the old mill.", "This is one of the best books of the year, and it is not only for children.", "You may also want to look at the map in the first part of the guide.", "It was in the middle of the night when the rest of the crew came back.", "Most of the houses in this part of the city were built with the help of the state.", "The name of the author is not known to the public.", "For the purpose of this study, all of the data were collected at the same time.", "The work is based on the results of the first two years.", "There is no reason to change the terms of the agreement with the other side.", "We do not know if any of these or other causes had an effect.", "A copy of the letter was found in the library of the university.", "The list of conditions was read to the members, either in full or in part.", "He wrote the program for the new computer and gave it to any person who asked.", "The use of the land is limited to the people of the village.", "Version two of the plan was used in the following year.", "Der Hund lief mit dem Kind in den Garten und kam mit einem Ball zurück.", "Mit der Zeit wurde es in der Stadt ruhig.", "Le livre de la jeune fille est sur la table de la cuisine.", "El hombre de la casa fue a la ciudad con su hijo.", "The source of the river lies in the hills above the form of the old castle.", "As a general rule the public is free to enter, with or without a ticket.", "The company sold its products in many countries without any kind of support.", "By the end of the war the apache helicopter was in use in four states.", "The price is 4.0 dollars and version 2.0 of the phone will be released in May.")
ANCHORS = ("licen", "copyright", "rights reserved", "public domain", "warrant", "redistribut", "permission", "creative commons", "spdx", "proprietary", "waived all", "cc by", "cc-by", "cc0", "gpl", "mpl-", "mpl 2", "bsd-", "apache-2")
WRONG = 0.05
WRAPPED = 50
_trained: dict[str, tuple] = {}
CONFIRM = 0.6


def _plain(c: Column) -> Column:
    return F.lower(c)


def has_anchor(c: Column) -> Column:
    out = None
    for a in ANCHORS:
        out = c.contains(a) if out is None else out | c.contains(a)
    return out


def word_list(c: Column) -> Column:
    """Lower-case words: letters and digits, version numbers whole, short licence names apart from their versions; a word of any length needs no deep stack."""
    return F.regexp_extract_all(c, F.lit(r"(?<![\p{L}\p{N}])(?:l?gpl|mpl|bsd|apache)(?=v?[0-9])|v?[0-9]+(?:\.[0-9]+)*+(?![\p{L}\p{N}])|[\p{L}\p{N}]+"), F.lit(0))


def known_templates() -> dict[str, tuple[str, ...]]:
    return {f: (*ts, *NAMES.get(f, ())) for f, ts in TEMPLATES.items()}


def _training(spark: SparkSession) -> DataFrame:
    """family, text's words, the number of the notice (its sentences share it) and weight: notices and ordinary lines weigh the same in all."""
    rows = [(f, n, t) for n, (f, t) in enumerate((f, t) for f, ts in known_templates().items() for t in ts)]
    rows += [(f, n, p.strip() + ".") for f, n, t in list(rows) if len(ps := t.replace(";", ".").split(". ")) > 1 for p in ps if len(p.split()) > 3]
    plain = [("none", n, t) for n, t in enumerate((*ORDINARY, *PROSE))]
    table = F.explode(F.array(*[F.struct(F.lit(f).alias("family"), F.lit(n).alias("notice"), F.lit(t).alias("text"), F.lit(w).alias("weight")) for part, w in ((rows, 1.0), (plain, len(rows) / len(plain))) for f, n, t in part])).alias("r")
    return spark.range(1).select(table).select("r.family", "r.notice", "r.weight", word_list(_plain(F.col("r.text"))).alias("words")).coalesce(1)


def _fitted(data: DataFrame) -> PipelineModel:
    """The classifier; its vocabulary is what the rows hold, without hashing, so words of other texts weigh nothing."""
    tokens = ", ".join(f"'{t}'" for t in TOKENS)
    parts = [NGram(n=2, inputCol="words", outputCol="two"), NGram(n=3, inputCol="words", outputCol="three"), SQLTransformer(statement=f"SELECT *, concat(array_intersect(words, array({tokens})), two, three) AS grams FROM __THIS__")]
    cut = Pipeline(stages=parts).fit(data)
    vocabulary = sorted({g for r in cut.transform(data).select("grams").collect() for g in r.grams})  # of the fixed rows above
    counted = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features", minTF=1.0).setBinary(True)
    steps = [*parts, counted]
    named = Pipeline(stages=[*steps, StringIndexer(inputCol="family", outputCol="label", stringOrderType="alphabetAsc")]).fit(data)
    ready = named.transform(data).select("label", "features", "weight").cache()
    model = LogisticRegression(regParam=0.003, maxIter=60, family="multinomial", labelCol="label", featuresCol="features", weightCol="weight").fit(ready)
    ready.unpersist()
    return PipelineModel(stages=[*named.stages[:-1], model])


def families() -> list[str]:
    return sorted([*TEMPLATES, "none"])


def held_out(data: DataFrame) -> list[tuple[str, str, float, bool]]:
    """(family, likeliest family, its probability, confirmed) of every row, by the classifier and templates of the other half."""
    out = []
    for half in (0, 1):
        seen, new = data.filter(F.col("notice") % 2 != half), data.filter(F.col("notice") % 2 == half)
        learned = [(r.family, set(r.g)) for r in seen.select("family", _grams(F.col("words")).alias("g")).collect()]
        for r in _fitted(seen).transform(new).select("family", _grams(F.col("words")).alias("g"), vector_to_array("probability").alias("p")).collect():
            best, grams = families()[max(range(len(r.p)), key=r.p.__getitem__)], set(r.g)
            own = [g for f, g in learned if f == best and g]
            share = max([len(grams & set().union(*own)) / max(1, len(grams)), *[len(grams & g) / len(g) for g in own]])
            out.append((r.family, best, max(r.p), share >= CONFIRM))
    return out


def threshold(found: list[tuple[str, str, float, bool]], wrong: float = WRONG) -> float:
    """The least probability at and above which at most ``wrong`` of the accepted rows have another family; above all rows if there is none."""
    accepted = sorted(((p, f == best) for f, best, p, sure in found if sure and best != "none"), reverse=True)
    least, bad = 1.0, 0
    for n, (p, right) in enumerate(accepted, 1):
        bad += not right
        if bad <= wrong * n and (n == len(accepted) or accepted[n][0] < p):
            least = p
    return least


def train(spark: SparkSession) -> tuple[PipelineModel, float]:
    """The classifier of all rows, and the threshold from held-out halves; trained once in a Spark application."""
    name = spark.sparkContext.applicationId
    if name not in _trained:
        data = _training(spark)
        _trained.clear()
        _trained[name] = _fitted(data), threshold(held_out(data))
    return _trained[name]


def _grams(words: Column) -> Column:
    two = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.element_at(words, i.cast("int")), F.element_at(words, (i + 1).cast("int"))))
    return F.array_distinct(F.when(F.size(words) > 1, two).otherwise(F.array().cast("array<string>")))


def _template_grams(spark: SparkSession) -> dict[str, list[list[str]]]:
    """Bigrams of every template, from the same expressions that read the documents (a fixed, small table)."""
    rows = [(f, n, t) for f, ts in known_templates().items() for n, t in enumerate(ts)]
    table = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.lit(n).alias("n"), F.lit(t).alias("t")) for f, n, t in rows])).alias("r")
    found = spark.range(1).select(table).select("r.f", "r.n", _grams(word_list(_plain(F.col("r.t")))).alias("g")).orderBy("f", "n").collect()
    return {f: [r.g for r in found if r.f == f] for f in TEMPLATES}


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id and lower-case text of every non-empty line, wrapped lines joined."""
    text = F.regexp_replace(_plain(F.col("text")), rf"\r?\n(?<=[^\r\n]{{{WRAPPED}}}\r?\n)(?<![.!?:]\r?\n)[ \t]*+(?:(?:#+|//+|\*+|--+|;+)[ \t]+)?(?=[^\s#/*;-])", " ")
    return store.texts(docs).select("doc_id", F.explode(F.split(text, r"[\r\n]+")).alias("paragraph")).filter(F.trim("paragraph") != "")


def classified(docs: DataFrame) -> DataFrame:
    """Every paragraph: doc_id, paragraph, the likeliest family, its probability, overlap and verdict."""
    spark = docs.sparkSession
    (model, least), known = train(spark), _template_grams(spark)
    scored = model.transform(paragraphs(docs).withColumn("words", word_list(F.col("paragraph"))))
    scored = scored.select("doc_id", "paragraph", "words", vector_to_array("probability").alias("p"))
    best = F.array_max("p")
    named = F.element_at(F.array(*map(F.lit, families())), F.array_position("p", best).cast("int"))
    scored = scored.select("doc_id", "paragraph", F.when(named != "none", _grams(F.col("words"))).alias("grams"), best.alias("probability"), named.alias("family"))

    def lits(values: list[str]) -> Column:
        return F.array(*map(F.lit, values))

    overlap = F.lit(0.0)
    for family, templates in known.items():
        every = sorted({g for t in templates for g in t})
        inside = F.size(F.array_intersect("grams", lits(every))) / F.greatest(F.size("grams"), F.lit(1))
        held = [F.size(F.array_intersect("grams", lits(t))) / len(t) for t in templates if t]
        overlap = F.when(F.col("family") == family, F.greatest(inside, *held)).otherwise(overlap)
    scored = scored.withColumn("overlap", overlap)
    sure = (F.col("family") != "none") & (F.col("probability") >= least) & (F.col("overlap") >= CONFIRM)
    verdict = F.when(sure, F.col("family")).when((F.col("family") != "none") | has_anchor(F.col("paragraph")), "unknown").otherwise("none")
    return scored.select("doc_id", "paragraph", "family", "probability", "overlap", verdict.alias("verdict"))


def licence_scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: confirmed licence paragraphs, unknown ones and the distinct families in order."""
    hits = classified(docs).groupBy(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key")).agg(
        F.count_if(~F.col("verdict").isin("unknown", "none")).alias("n_licence"),
        F.count_if(F.col("verdict") == "unknown").alias("n_unknown"),
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("verdict").isin("unknown", "none"), F.col("verdict")))), ",").alias("families"),
    )
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).withColumn("key", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    zero = F.lit(0).cast("bigint")
    return ids.join(hits, "key", "left").select("doc_id", F.coalesce("n_licence", zero).alias("n_licence"), F.coalesce("n_unknown", zero).alias("n_unknown"), F.coalesce("families", F.lit("")).alias("families"))
