"""Quality rules with adaptive thresholds from mergeable quantile sketches per language and source.

Each document gets integer metrics: shares in permille and the mean length of a word. A sketch of a group is a table of
(bin, count) rows: values below 32 have a bin of their own, larger ones eight bins to each power of two, so that a
bin's bounds lie within 12.5 % of one another. Sketches merge by adding counts, in any order, and a group's hold at
most a few hundred rows. A metric's threshold in a group is its upper quartile plus `SPREAD` times the distance between
the quartiles; where the quartiles are closer than what one finding is in a document of the group's median size (by the
sketches of sizes: a symbol, a repeated line, a repeated window's 10 words), that takes the place of the distance. No
cutoff is fixed. A document goes if it fails a base rule or if a metric is above its group's threshold.

Groups of fewer than `LEAST` documents take the thresholds of their language, and those of such a language the
thresholds of the whole table. Null languages and sources are groups of their own. Defined results: null, empty and
wordless texts have zero metrics and fail the base rule of n_words; ties share bins; repeated rows and rows with a null
doc_id count and are judged as rows; an empty table gives no rows; other columns go along whatever their names; a text
is measured whole, in memory linear in the longest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import Hashes, Powers, covered, stage, texts

SYMBOLS = b"#*$%&|<>"
#: metric: what one finding is a share of (the size), and how many of these it is, times 1000. None: no share.
FINDINGS = {"symbol_permille": ("word_chars", 1000), "dup_line_permille": ("n_lines", 1000), "repeat_permille": ("n_words", 10000), "word_len_percent": None}
SIZES = ("word_chars", "n_lines", "n_words")
LEAST, SPREAD = 100, 4
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def measure(text: bytes, hashes: Hashes, powers: Powers) -> tuple[int, ...]:
    """The COUNTS of one whole text."""
    words = text.split()
    n = len(words)
    chars = sum(map(len, words)) - _continuation(text)
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    repeated = 0
    if n > 5:
        w = powers.windows(hashes.of(words), 5)
        order = np.argsort(w, kind="stable")
        same = w[order][1:] == w[order][:-1]
        if same.any():
            twice = np.zeros(len(w), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            repeated = int(covered(np.flatnonzero(twice), 5, n).sum())
    return n, chars, symbols, len(lines), len(lines) - len(set(lines)), repeated


def _continuation(text: bytes) -> int:
    """Bytes that aren't the first of a code point."""
    return 0 if text.isascii() else int(((np.frombuffer(text, np.uint8) & 0xC0) == 0x80).sum())


def with_counts(docs: DataFrame, text: str = "text", prefix: str = "q_") -> DataFrame:
    """docs and the COUNTS of each text, named with the prefix."""
    names = [prefix + c for c in COUNTS]

    def run(it):
        hashes, powers = Hashes(), Powers(0x9E3779B97F4A7C15)
        for batch in it:
            rows = [measure(t, hashes, powers) for t in texts(batch, text)]
            more = [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *[StructField(n, LongType()) for n in names]]))


def metrics(prefix: str = "") -> dict[str, F.Column]:
    c = {n: F.col(prefix + n) for n in COUNTS}
    one = F.lit(1).cast("long")
    share = lambda a, b, k: F.floor((F.lit(k) * a) / F.greatest(b, one)).cast("long")
    return {
        "symbol_permille": share(c["n_symbols"], c["word_chars"], 1000),
        "dup_line_permille": share(c["n_dup_lines"], c["n_lines"], 1000),
        "repeat_permille": share(c["n_repeat_words"], c["n_words"], 1000),
        "word_len_percent": share(c["word_chars"], c["n_words"], 100),
    }


def base_failed(prefix: str = "") -> F.Column:
    n, r = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    return (n < 10) | (100 * r > 20 * n)


def sketch(counted: DataFrame, prefix: str = "") -> DataFrame:
    """(lang, source, metric, bin, n): documents that pass the base rules, counted by bin."""
    e = F.length(F.bin("x")) - 1  # of the highest set bit
    top = F.pow(F.lit(2.0), e)
    own = F.when(F.col("x") < 32, F.col("x")).otherwise(32 + (e - 5) * 8 + F.floor((F.col("x") - top) * 8 / top))
    each = metrics(prefix) | {c: F.col(prefix + c) for c in SIZES}
    rows = counted.filter(~base_failed(prefix)).select("lang", "source", F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("x")) for k, v in each.items()])).alias("m")).select("lang", "source", "m.*")
    return rows.select("lang", "source", "metric", own.cast("long").alias("bin")).groupBy("lang", "source", "metric", "bin").agg(F.count(F.lit(1)).alias("n"))


def _value(b: F.Column) -> F.Column:
    """The largest value of a bin."""
    base = F.pow(F.lit(2.0), F.floor((b - 32) / 8) + 5)
    return F.when(b < 32, b).otherwise(F.ceil(base + base / 8 * (F.pmod(b - 32, F.lit(8)) + 1)) - 1).cast("long")


def _fences(rows: DataFrame, keys: list[str], spread: int) -> DataFrame:
    """keys, size, and a column for each metric with its threshold."""
    part = Window.partitionBy(*keys, "metric")
    upto = part.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    r = rows.groupBy(*keys, "metric", "bin").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(upto)).withColumn("size", F.sum("n").over(part))
    q = lambda k: F.min(F.when(F.col("upto") * 4 >= F.col("size") * k, _value(F.col("bin"))))
    g = r.groupBy(*keys, "metric").agg(F.max("size").alias("size"), F.struct(q(1).alias("q1"), q(2).alias("q2"), q(3).alias("q3")).alias("q"))
    g = g.groupBy(*keys).agg(F.max("size").alias("size"), *[F.max(F.when(F.col("metric") == m, F.col("q"))).alias("q_" + m) for m in (*FINDINGS, *SIZES)])
    one = lambda of, k: F.ceil(F.lit(k) / F.greatest(F.col(f"q_{of}.q2"), F.lit(1)))
    fence = lambda m, f: F.col(f"q_{m}.q3") + spread * F.greatest(F.col(f"q_{m}.q3") - F.col(f"q_{m}.q1"), one(*f) if f else F.lit(1))
    return g.select(*keys, "size", *[fence(m, f).cast("long").alias(m) for m, f in FINDINGS.items()])


def thresholds(counted: DataFrame, prefix: str = "", least: int = LEAST, spread: int = SPREAD) -> DataFrame:
    """(lang, source, and a threshold for each metric), for every language and source of the table; staged."""
    sk = stage(sketch(counted, prefix), "quality-sketch")
    groups = stage(counted.select("lang", "source").distinct(), "quality-groups")
    own, lang, whole = (_fences(sk, k, spread) for k in (["lang", "source"], ["lang"], []))
    named = lambda d, p: d.select(*[F.col(c).alias(p + c) for c in d.columns])
    own, lang, whole = named(own, "s_"), named(lang, "l_"), named(whole, "w_")
    j = groups.join(own, F.col("lang").eqNullSafe(F.col("s_lang")) & F.col("source").eqNullSafe(F.col("s_source")), "left")
    j = j.join(lang, F.col("lang").eqNullSafe(F.col("l_lang")), "left").join(F.broadcast(whole), F.lit(True), "left")  # one row
    out = [F.when(F.col("s_size") >= least, F.col("s_" + m)).when(F.col("l_size") >= least, F.col("l_" + m)).otherwise(F.col("w_" + m)).alias("t_" + m) for m in FINDINGS]
    return stage(j.select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), *out), "quality-thresholds")


def judge(counted: DataFrame, limits: DataFrame, prefix: str = "") -> DataFrame:
    """counted with base_failed and kept. The limits are a staged table, a row for each group: Spark broadcasts it if
    its measured size is below spark.sql.autoBroadcastJoinThreshold, and else joins by (lang, source) with AQE
    splitting the hot groups."""
    on = F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source"))
    fine = F.lit(True)
    for m, v in metrics(prefix).items():
        fine = fine & (v <= F.col("t_" + m))
    j = counted.join(limits, on, "left").withColumn("base_failed", base_failed(prefix))
    return j.withColumn("kept", ~F.col("base_failed") & F.coalesce(fine, F.lit(True)))


def rules(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the COUNTS, base_failed and kept, for all documents."""
    counted = stage(with_counts(docs.select("doc_id", "lang", "source", "text"), prefix="").drop("text"), "quality-counts")
    return judge(counted, thresholds(counted))


def keep(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their columns; texts are read twice and cross no shuffle while the table of
    thresholds is small enough to be broadcast. The columns go along as one struct, so that no name can clash."""
    needed = ["lang", "source", "text"]
    limits = thresholds(stage(with_counts(docs.select(*needed), prefix="q_").drop("text"), "quality-counts"), "q_")
    packed = docs.select(*needed, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    return judge(with_counts(packed, prefix="q_"), limits, "q_").filter("kept").select("doc.*")
