"""License scans: a trained paragraph classifier in DataFrame operations.

A paragraph is a run of lines up to a line without letters or digits, whatever comment marks the lines begin with; its
words (ASCII letters and digits, lower case) are read across line ends. Windows of `WINDOW` words, `STRIDE` apart, cover
it, so that a notice inside a longer paragraph is judged by itself.

The features are the words and pairs of neighbouring words of the notices in `NOTICES`; what is in none of them
carries no weight. Softmax regression over the licence families and an unknown class starts from scaled log odds of the
features' rates in the classes, and is trained by proximal gradient steps, each of them one DataFrame aggregation:
every step takes `SPARSE` off the size of a weight, down to 0, which strips what does not tell classes apart. Labelled rows are the windows of the notices, and those of
`SAMPLE` documents (of the lowest hashed ids; the bound is a parameter) with `OTHER`, sentences that speak of licences
without giving one, stand for the unknown class; sampled paragraphs that a notice confirms are left out.

Held out from training are the last notice of each family, a wording of its own, and every fifth sampled document and
sentence. On them a logistic curve (Platt's, both classes of the same weight) turns the lead of the best family over
the unknown class into the probability that there is a licence. A window predicts the families whose own lead gives
`LEAST` or more (a window may hold the notices of two). A prediction holds if a notice of the family confirms it: the paragraph has `CONFIRM` of the notice's word
triples, and of those that no other family has, too. Windows and triples of all paragraphs are found in one pass.

Defined results: null and empty texts have no paragraphs and no licence; repeated rows are judged alike, each a row; a
document with several families gets all; equal probabilities go to the family that comes first by name; long texts are
one more row for each hit, never an array of them; an empty table gives no rows; other columns than doc_id and text
are not read, whatever their names.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage, unstage

WINDOW, STRIDE, SAMPLE, LEAST, CONFIRM = 24, 12, 200, 0.5, 0.6
#: Sums of weights: steps to a whole, and bits to a sum. A window's at most 2 * WINDOW features weigh up to 20 each.
UNIT, FIELD = 1024, 21
#: Of the training: gradient steps, their rate, what each takes off a weight, and the sampled frames put around notices.
STEPS, RATE, SPARSE, FRAMES = 20, 4.0, 0.002, 5
#: Notices of public licences, by family. The last of each family is held out from training.
NOTICES = {
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-or-later", "SPDX-License-Identifier: AGPL-3.0-only",
        "This project is available under the terms of the GNU Affero General Public License v3 (AGPL-3.0).",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed under the Apache License, Version 2.0.", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION", "SPDX-License-Identifier: Apache-2.0",
        "This software is released under the terms of the Apache License 2.0.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "Released under the BSD 3-Clause License.", "Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "CC-BY-4.0": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0", "To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/",
        "The text is available under the Creative Commons Attribution 4.0 International License (CC BY 4.0).",
    ],
    "CC-BY-NC-4.0": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0", "To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/",
        "The text is available under the Creative Commons Attribution-NonCommercial 4.0 International License (CC BY-NC 4.0).",
    ],
    "CC-BY-SA-4.0": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0.", "SPDX-License-Identifier: CC-BY-SA-4.0", "To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/",
        "The text is available under the Creative Commons Attribution-ShareAlike 4.0 International License (CC BY-SA 4.0).",
    ],
    "CC0-1.0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Dedicated to the public domain under CC0 1.0.", "CC0 1.0 Universal Public Domain Dedication", "SPDX-License-Identifier: CC0-1.0",
        "This data set is dedicated to the public domain by the Creative Commons CC0 1.0 Universal waiver.",
    ],
    "GPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-2.0-or-later", "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-2.0-only",
        "This project is available under the terms of the GNU General Public License v3 (GPL-3.0).",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES",
        "Released under the ISC License.", "SPDX-License-Identifier: ISC",
        "This package is distributed under the terms of the ISC License.",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, see <https://www.gnu.org/licenses/>.",
        "Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-or-later", "SPDX-License-Identifier: LGPL-2.1-or-later", "SPDX-License-Identifier: LGPL-3.0-only",
        "This project is available under the terms of the GNU Lesser General Public License v3 (LGPL-3.0).",
    ],
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY",
        "Released under the MIT License.", "SPDX-License-Identifier: MIT", "Licensed under the MIT license.",
        "This package is distributed under the terms of the MIT License.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0",
        "This software is released under the terms of the Mozilla Public License, version 2.0.",
    ],
}
#: Sentences that speak of licences, copyright and the like without giving a licence.
OTHER = [
    "All rights reserved.", "Copyright 2020 the authors.", "You need a driving license for this.", "The license of the shop was revoked by the city.", "Terms of the contract apply to the public.", "Permission was not granted to visit.",
    "Read the conditions of use and the privacy notice.", "Free of charge for members.", "Version 2.0 of the programme was shown in January.", "The software was modified by the library.", "See the license for details.", "He was licensed to practise in 2004 under the old terms.",
    "This work was published under a pen name and distributed without permission.", "You may not use this file.", "The general public was admitted without restriction to the source of the river.", "No part of this book may be reproduced without written permission of the publisher.",
    "The above notice is provided by the city as is.", "A copy of the report can be found in the file.", "Creative writing is common in the public domain of letters.", "The mit in the kitchen is red.", "An Apache helicopter was shown to persons with a license.", "By using this site you agree to the terms and conditions.",
]
CLASSES = [*sorted(NOTICES), "unknown"]
WORD = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: Between two paragraphs: lines without ASCII letters and digits.
BLANK = r"\n(?:[^A-Za-z0-9\n]*\n)+"


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def notice_table(spark: SparkSession) -> DataFrame:
    """(t, notice, y, n, own): the triples of all notices, hashed; how many the notice has, and has to itself."""
    rows, families = [], {}
    each = [(y, n, _triples(n)) for y, c in enumerate(CLASSES[:-1]) for n in NOTICES[c]]
    for y, _, ts in each:
        for t in ts:
            families.setdefault(t, set()).add(y)
    for k, (y, _, ts) in enumerate(each):
        rows += [(" ".join(t), k, y, len(ts), len(families[t]) == 1, sum(len(families[x]) == 1 for x in ts)) for t in ts]
    values = ", ".join(f"('{t}', {k}, {y}, {n}, {str(o).lower()}, {m})" for t, k, y, n, o, m in rows)
    return spark.sql(f"SELECT xxhash64(t) t, notice, y, n, own, n_own FROM VALUES {values} AS v(t, notice, y, n, own, n_own)")


def _triples(text: str) -> list[tuple[str, ...]]:
    """The distinct triples of words; all words at once, if there are fewer."""
    w = words_of(text)
    return list(dict.fromkeys(tuple(w[i : i + 3]) for i in range(max(len(w) - 2, 1))))


def grams(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n_paragraphs, par, at, one, two, three) from docs (row, doc_id, text): for each word of a
    paragraph its hash and those of the pair and the triple that it begins, null beyond the end; a paragraph of one or two words has them as its
    triple, too. And for each row one of paragraph 0 with the count of its paragraphs."""
    own = F.filter(F.split(F.coalesce("text", F.lit("")), BLANK), lambda x: x.rlike("[A-Za-z0-9]"))
    x = docs.select("row", "doc_id", own.alias("own")).select("row", "doc_id", F.size("own").alias("n_paragraphs"), F.posexplode(F.concat(F.array(F.lit("")), "own")).alias("par", "line"))
    w = F.when(F.col("par") == 0, F.array(F.lit(""))).otherwise(F.expr(f"regexp_extract_all(lower(line), '{WORD}', 0)"))
    x = x.select("row", "doc_id", "n_paragraphs", "par", w.alias("w"))
    size = F.size("w")
    x = x.select("row", "doc_id", "n_paragraphs", "par", size.alias("n"), F.posexplode(F.arrays_zip("w", F.slice("w", F.lit(2), size).alias("v"), F.slice("w", F.lit(3), size).alias("u"))).alias("at", "z"))
    x = x.select("row", "doc_id", "n_paragraphs", "par", "at", "n", F.col("z.w").alias("w"), F.col("z.v").alias("v"), F.col("z.u").alias("u"))
    three = F.when(F.col("u").isNotNull(), F.xxhash64(F.concat_ws(" ", "w", "v", "u"))).when((F.col("at") == 0) & (F.col("n") < 3), F.xxhash64(F.concat_ws(" ", "w", "v")))
    return x.select("row", "doc_id", "n_paragraphs", "par", "at", F.xxhash64("w").alias("one"), F.when(F.col("v").isNotNull(), F.xxhash64("w", "v")).alias("two"), three.alias("three"))


def hits(docs: DataFrame, features: DataFrame, notices: DataFrame) -> DataFrame:
    """The rows of grams() of paragraph 0, and those with a feature (g, f) or a notice's triple; staged. Both tables are
    as large as NOTICES makes them, and so are broadcast."""
    known = features.select("g", "f")
    triples = notices.select(F.col("t").alias("three"), F.lit(True).alias("told")).distinct()
    x = grams(docs)
    for c in ("one", "two"):
        x = x.join(F.broadcast(known.select(F.col("g").alias(c), F.col("f").alias("f_" + c))), c, "left")
    x = x.join(F.broadcast(triples), "three", "left")
    any_ = (F.col("par") == 0) | F.col("f_one").isNotNull() | F.col("f_two").isNotNull() | F.col("told")
    first = F.col("par") == 0
    return stage(x.filter(any_).select("row", F.when(first, F.col("doc_id")).alias("doc_id"), F.when(first, F.col("n_paragraphs")).alias("n_paragraphs"), "par", "at", "f_one", "f_two", F.when(F.col("told"), F.col("three")).alias("three")), "licence-hits")


def windows(hit: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, win, f): the features of each window, as often as they are in it."""
    k = F.floor(F.col("at") / STRIDE).cast("int")
    x = hit.filter("par > 0").select(*keys, k.alias("k"), F.explode(F.array_compact(F.array("f_one", "f_two"))).alias("f"))
    return x.select(*keys, F.explode(F.sequence(F.greatest(F.col("k") - (WINDOW // STRIDE - 1), F.lit(0)), "k")).alias("win"), "f")


def confirmed(hit: DataFrame, notices: DataFrame) -> DataFrame:
    """(row, par, y, share): families of which the paragraph has CONFIRM of a notice."""
    x = hit.filter("three is not null").select("row", "par", F.col("three").alias("t")).distinct().join(F.broadcast(notices), "t")
    x = x.groupBy("row", "par", "notice", "y", "n", "n_own").agg(F.count(F.lit(1)).alias("all"), F.count(F.when(F.col("own"), 1)).alias("some"))
    share = F.least(F.col("all") / F.col("n"), F.coalesce(F.col("some") / F.nullif(F.col("n_own"), F.lit(0)), F.lit(1.0)))
    return x.groupBy("row", "par", "y").agg(F.max(share).alias("share")).filter(F.col("share") >= CONFIRM)


def with_scores(x: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """keys, the logits z (the classes', the last that of the unknown class) and the features, from (keys, f) rows;
    feature -1, which every row has, is the bias. The weights (f, w) are as many as the features."""
    sums = [F.sum(F.col("w")[k]).alias(f"s{k}") for k in range(len(CLASSES))]
    return x.join(F.broadcast(weights), "f").groupBy(*keys).agg(*sums, F.collect_list("f").alias("fs")).select(*keys, F.array(*[f"s{k}" for k in range(len(CLASSES))]).alias("z"), "fs")


def _softmax(x: DataFrame) -> DataFrame:
    x = x.withColumn("e", F.transform("z", lambda v: F.exp(v - F.array_max("z"))))
    return x.withColumn("p", F.transform("e", lambda v: v / F.aggregate("e", F.lit(0.0), lambda a, y: a + y))).drop("e")


class Classifier:
    """weights (f, w), features (g, f), and the curve (slope, shift) of the lead's probability; accuracy: the share of
    held-out windows of notices, and of the unknown class, that are put right."""

    def __init__(self, docs: DataFrame, notices: DataFrame, sample: int = SAMPLE):
        spark, c = docs.sparkSession, len(CLASSES)
        texts = [(t, y, k == len(NOTICES[name]) - 1) for y, name in enumerate(CLASSES[:-1]) for k, t in enumerate(NOTICES[name])]
        texts += [(t, c - 1, k % 5 == 4) for k, t in enumerate(OTHER)]
        rows = ", ".join("({}, '{}', {}, {}, {})".format(-1 - k, t.replace("'", "''"), y, str(h).lower(), len(words_of(t))) for k, (t, y, h) in enumerate(texts))
        own = spark.sql(f"SELECT CAST(row AS BIGINT) row, CAST(NULL AS BIGINT) doc_id, text, y, held, n FROM VALUES {rows} AS t(row, text, y, held, n)")
        few = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(sample)
        few = stage(few.withColumn("row", F.row_number().over(_whole("doc_id")).cast("long")), "licence-sample")  # `sample` rows
        around = few.filter(F.length("text") > 200).orderBy("row").limit(FRAMES).select(F.row_number().over(_whole("row")).alias("k"), F.slice(F.split("text", r"\s+"), 1, STRIDE).alias("a"))
        short = own.filter(f"y < {c - 1} and size(split(text, ' ')) <= {STRIDE}").select("*", F.explode(F.sequence(F.lit(1), F.lit(FRAMES))).alias("k")).join(F.broadcast(around), "k")
        half = STRIDE // 2
        framed = F.concat_ws(" ", F.array_join(F.slice("a", 1, half), " "), "text", F.array_join(F.slice("a", half + 1, half), " "))
        own = stage(own.unionByName(short.select((F.col("row") - 1000 * F.col("k")).alias("row"), "doc_id", framed.alias("text"), "y", "held", F.lit(0).alias("n"))), "licence-notices")
        label = own.select("row", "y", "held", "n")
        g = grams(own.filter("row > -1000")).filter("par > 0").join(F.broadcast(label), "row").filter(f"y < {c - 1} and not held")
        seen = g.select(F.explode(F.array_compact(F.array("one", "two"))).alias("g")).distinct()
        self.features = stage(seen.select("g", (F.row_number().over(_whole("g")) - 1).alias("f")), "licence-features")  # as many as NOTICES has
        mine = hits(own.select("row", "doc_id", "text"), self.features, notices)
        theirs = hits(few.select("row", "doc_id", "text"), self.features, notices)
        theirs = theirs.join(confirmed(theirs, notices).select("row", "par").distinct(), ["row", "par"], "left_anti")
        held = F.pmod(F.xxhash64("row", F.lit(3)), F.lit(5)) == 4
        keys = ["row", "par", "win"]
        known = windows(mine, ["row", "par"]).join(F.broadcast(label), "row").filter(f"win = 0 or (win + 1) * {STRIDE} <= n")  # those that are notice
        unknown = windows(theirs, ["row", "par"]).select("row", "par", "win", "f", F.lit(c - 1).alias("y"), held.alias("held"))
        each = known.select("row", "par", "win", "f", "y", "held").unionByName(unknown)
        bias = each.select("row", "par", "win", "y", "held").distinct().withColumn("f", F.lit(-1))
        each = stage(each.unionByName(bias.select(*each.columns)).coalesce(2), "licence-training")
        fit, keys = each.filter("not held"), [*keys, "y"]
        count = dict(fit.filter("f = -1").groupBy("y").count().collect())  # a row for each class
        part = {y: 0.5 / n if y == c - 1 else 0.5 / (c - 1) / n for y, n in count.items()}  # the unknown class weighs as much as all families
        share = F.element_at(F.create_map(*[F.lit(v) for y, x in part.items() for v in (y, x)]), F.col("y")) if part else F.lit(0.0)
        weights = stage(self.features.select("f").unionByName(spark.sql("SELECT -1 f")).select("f", F.array_repeat(F.lit(0.0), c).alias("w"), F.array_repeat(F.lit(0.0), c).alias("was")), "licence-weights")
        for step in range(STEPS):
            ahead = weights.select("f", F.zip_with("w", "was", lambda w, x: w + step / (step + 3.0) * (w - x)).alias("w"))  # noqa: B023
            p = _softmax(with_scores(fit, ahead, keys)).withColumn("share", share)
            errors = p.select(F.transform("p", lambda v, k: F.col("share") * ((F.col("y") == k).cast("double") - v)).alias("error"), F.explode("fs").alias("f"))
            turn = errors.groupBy("f").agg(F.array(*[F.sum(F.col("error")[k]) for k in range(c)]).alias("g"))
            moved = F.zip_with("at", F.coalesce("g", F.array_repeat(F.lit(0.0), c)), lambda w, g: w + RATE * g)
            shrunk = F.when(F.col("f") == -1, moved).otherwise(F.transform(moved, lambda v: F.signum(v) * F.greatest(F.abs(v) - SPARSE, F.lit(0.0))))
            both = weights.join(F.broadcast(ahead.withColumnRenamed("w", "at")), "f").join(F.broadcast(turn), "f", "left")
            old, weights = weights, stage(both.select("f", shrunk.alias("w"), F.col("w").alias("was")).coalesce(1), f"licence-weights-{step}")
            unstage(old)
        weights = weights.select("f", "w")
        self.weights = weights
        used = weights.filter("f >= 0").filter(F.exists("w", lambda v: v != 0))
        self.features = stage(self.features.join(F.broadcast(used.select("f")), "f", "left_semi").select("g", "f"), "licence-kept")
        tested = with_scores(each.filter("held"), weights, keys)
        tested = tested.select("y", (F.array_max(F.slice("z", 1, c - 1)) - F.col("z")[c - 1]).alias("lead"), (F.array_position("z", F.array_max("z")) - 1).alias("best"))
        found = tested.groupBy((F.col("y") < c - 1).alias("is"), F.round(F.greatest(F.least(F.col("lead"), F.lit(50.0)), F.lit(-50.0)) * 10).alias("lead")).count().collect()  # 2,000 rows at most
        self.slope, self.shift = calibrate([(r["is"], r["lead"] / 10, r["count"]) for r in found])
        ok = {r["is"]: r["ok"] for r in tested.groupBy((F.col("y") < c - 1).alias("is")).agg(F.avg((F.col("best") == F.col("y")).cast("double")).alias("ok")).collect()}
        self.accuracy = ok.get(True), ok.get(False)

    def judge(self, hit: DataFrame) -> DataFrame:
        """(row, par, y, probability): the families that windows predict, with the highest probability of each."""
        keys, c = ["row", "par", "win"], len(CLASSES)
        bias = self.weights.filter("f = -1").first()["w"]
        w = self.weights.filter("f >= 0").filter(F.exists("w", lambda v: v != 0))
        # three leads over the unknown class to a long, in steps of 1 / UNIT: their sums are exact, in any order
        over = [F.round(F.greatest(F.least(F.col("w")[k] - F.col("w")[c - 1], F.lit(20.0)), F.lit(-20.0)) * UNIT).cast("long") for k in range(c - 1)]
        packs = [sum((x * (1 << FIELD * i) for i, x in enumerate(over[j : j + 3])), F.lit(0).cast("long")).alias(f"q{j}") for j in range(0, c - 1, 3)]
        x = windows(hit, ["row", "par"]).join(F.broadcast(w.select("f", *packs)), "f").groupBy(*keys).agg(*[F.sum(f"q{j}").alias(f"q{j}") for j in range(0, c - 1, 3)])
        half, lead = 1 << (FIELD - 1), []
        for j in range(0, c - 1, 3):
            rest = F.col(f"q{j}")
            for k in range(j, min(j + 3, c - 1)):
                own = (rest + half).bitwiseAND((1 << FIELD) - 1) - half
                rest = F.shiftright(rest - own, FIELD)
                lead.append(F.struct(F.lit(k).alias("y"), (own / float(UNIT) + (bias[k] - bias[c - 1])).alias("lead")))
        p = F.transform(F.array(*lead), lambda v: F.struct(v["y"].alias("y"), (1 / (1 + F.exp(-(self.slope * v["lead"] + self.shift)))).alias("p")))
        x = x.select("row", "par", F.explode(F.filter(p, lambda v: v["p"] >= LEAST)).alias("v"))
        return x.groupBy("row", "par", F.col("v.y").alias("y")).agg(F.max("v.p").alias("probability"))


def _whole(order: str):
    """For tables of a fixed size."""
    return Window.orderBy(order)


def calibrate(found: list[tuple[bool, float, int]]) -> tuple[float, float]:
    """Slope and shift of the logistic curve of greatest likelihood over (licence or not, lead, count), both classes of
    the same weight, with Platt's targets, by Newton's steps; (1, 0) unless both classes are there."""
    n = {k: sum(c for is_, _, c in found if is_ == k) for k in (True, False)}
    if not all(n.values()):
        return 1.0, 0.0
    target = {True: (n[True] + 1) / (n[True] + 2), False: 1 / (n[False] + 2)}
    a, b = 0.1, 0.0
    for _ in range(50):
        g1 = g2 = 0.0
        h11 = h22 = 1e-9
        h12 = 0.0
        for is_, m, c in found:
            w = c / n[is_]
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, a * m + b))))
            d, v = w * (p - target[is_]), w * max(p * (1 - p), 1e-9)
            g1, g2, h11, h12, h22 = g1 + d * m, g2 + d, h11 + v * m * m, h12 + v * m, h22 + v
        det = h11 * h22 - h12 * h12
        if det <= 0:
            break
        da, db = (h22 * g1 - h12 * g2) / det, (h11 * g2 - h12 * g1) / det
        size = max(1.0, abs(da) / 2.0, abs(db) / 5.0)
        a, b = max(a - da / size, 1e-3), b - db / size
        if abs(da) + abs(db) < 1e-9:
            break
    return a, b


def scan(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, n_paragraphs, n_predicted (paragraphs in which a window predicts a family), families (predicted and
    confirmed, sorted), unconfirmed (of paragraphs in which no prediction is confirmed), licence (the confirmed one of the highest probability) and its
    probability, for every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    notices = stage(notice_table(docs.sparkSession), "licence-notices")
    model = Classifier(docs, notices, sample)
    hit = hits(docs.withColumn("row", F.monotonically_increasing_id()), model.features, notices)
    found = model.judge(hit).join(confirmed(hit, notices), ["row", "par", "y"], "left").withColumn("ok", F.col("share").isNotNull())
    name = F.element_at(F.array(*map(F.lit, CLASSES)), F.col("y") + 1)
    one = found.withColumn("name", name).groupBy("row", "par").agg(
        F.collect_set(F.when(F.col("ok"), F.col("name"))).alias("yes"), F.collect_set("name").alias("all"), F.max(F.when(F.col("ok"), F.struct("probability", F.negative("y").alias("neg"), "name"))).alias("top"))
    one = one.withColumn("no", F.when(F.size("yes") == 0, F.col("all")).otherwise(F.array()))
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), ",")
    found = one.groupBy("row").agg(F.count(F.lit(1)).alias("n_predicted"), names("yes").alias("families"), names("no").alias("unconfirmed"), F.max("top").alias("top"))
    found = found.select("row", "n_predicted", "families", "unconfirmed", F.col("top.name").alias("licence"), F.round("top.probability", 4).alias("probability"))
    base = hit.filter("par = 0").select("row", "doc_id", F.col("n_paragraphs").cast("long").alias("n_paragraphs"))
    empty = F.lit("")
    return base.join(found, "row", "left").select("doc_id", "n_paragraphs", F.coalesce("n_predicted", F.lit(0)).cast("long").alias("n_predicted"), F.coalesce("families", empty).alias("families"), F.coalesce("unconfirmed", empty).alias("unconfirmed"), "licence", "probability")
