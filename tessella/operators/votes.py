"""Labels of points from masks of one view after another: votes carried from frame to frame, with eviction.

views (scene, frame, local, point, pixel, overlap, inner, fresh): a point falls on a pixel of mask `local` in a frame;
the flags say whether it counts for the overlap with known labels, for votes, and for a new label. The state (scene,
point, votes, has) has one row for a point: the weight of each of its labels with the ordinal of the frame that first
gave it, and the label that leads. Every frame first settles the labels that are there, then judges its masks by the
labels of their pixels, and adds votes. Scenes go side by side, a scene's frames one after another. Views and state lie
in the same buckets of their points, so a frame joins and groups them where they are; only counts of masks, pixels and
labels are shuffled. What has to be held in one place is a scene's list of labels.

In the state a label keeps its number while it is there; its place among those that are left is what the log has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.staging import reread, stage, stage_by, unstage

#: Ordinals and labels are negative, so that the greatest vote is the leading one: of equals the first, then the lowest.
STATE = "scene long, point long, votes array<struct<weight: double, since: long, label: long>>, has long"
LOG = ["scene", "frame", "local", "decision", "label", "n_points"]
POINT = ["scene", "point"]
FIRST, AGAIN, MIXED = 1.25, 1.0, 0.75


def leading(votes: Column, accuracy: float) -> Column:
    """The label with the most weight, of equals the one that came first; 0 if its share is under the accuracy, null
    without votes."""
    top = F.array_max(votes)
    share = top["weight"] / F.aggregate(votes, F.lit(0.0), lambda all_, v: all_ + v["weight"])
    return F.when(top.isNotNull(), F.when(share >= accuracy, -top["label"]).otherwise(0))


def leaders(state: DataFrame, least: int) -> DataFrame:
    """(scene, label, named): the labels that lead at `least` points or more, numbered from 1 in their order."""
    sizes = state.filter("has > 0").groupBy("scene", F.col("has").alias("label")).count().filter(F.col("count") >= least)
    return sizes.select("scene", "label", F.row_number().over(Window.partitionBy("scene").orderBy("label")).cast("long").alias("named"))


def listed(labels: DataFrame) -> DataFrame:
    return labels.groupBy("scene").agg(F.collect_list("label").alias("gone"))


def without(state: DataFrame, gone: DataFrame, accuracy: float) -> DataFrame:
    """The state without the votes for labels in gone (scene, gone)."""
    x, stays = state.join(gone, "scene", "left"), F.col("gone").isNull()
    x = x.withColumn("votes", F.when(stays, F.col("votes")).otherwise(F.filter("votes", lambda v: ~F.array_contains(F.col("gone"), -v["label"]))))
    return x.withColumn("has", F.when(stays, F.col("has")).otherwise(leading(F.col("votes"), accuracy))).drop("gone")


def judged(x: DataFrame, names: DataFrame) -> DataFrame:
    """The masks of a frame of each scene (LOG, and `to`, the label's number in the state), from its views beside `has`.
    Pixels have the label of their first point that has one. A mask without labels gets the next number; of the masks
    that show one label alone the last one votes for it; a mask of several votes, by less, for the one with the most
    pixels, of equals the lowest."""
    pixels = x.filter("overlap and has > 0").groupBy("scene", "local", "pixel").agg(F.min_by("has", "point").alias("label"))
    counts = pixels.groupBy("scene", "local", "label").count()
    known = counts.groupBy("scene", "local").agg(F.count("*").alias("labels"), (-F.max(F.struct("count", (-F.col("label")).alias("l")))["l"]).alias("major"))
    masks = x.groupBy("scene", "frame", "local").agg(F.count(F.when(F.col("fresh"), 1)).alias("n_fresh"), F.count(F.when(F.col("inner"), 1)).alias("n_inner"))
    masks = stage(masks.join(known, ["scene", "local"], "left"), "masks")
    last = names.groupBy("scene").agg(F.max("label").alias("last"), F.max("named").alias("n"))
    made = masks.filter("labels is null and n_fresh > 0").select("scene", "local", F.row_number().over(Window.partitionBy("scene").orderBy("local")).alias("nth"))
    made = made.join(last, "scene", "left").select("scene", "local", *[(F.coalesce(c, F.lit(0)) + F.col("nth")).cast("long").alias(n) for c, n in (("last", "new"), ("n", "new_named"))])
    final = masks.filter("labels = 1").groupBy("scene", "major").agg(F.max("local").alias("final"))
    m = masks.join(made, ["scene", "local"], "left").join(final, ["scene", "major"], "left").join(names.withColumnRenamed("label", "major"), ["scene", "major"], "left")
    decision = F.when(F.col("labels").isNull() & F.col("new").isNull(), "empty_new").when(F.col("labels").isNull(), "new_label").when(F.col("labels") == 1, "single_overlap").otherwise("multi_overlap")
    votes_for = F.when(F.col("labels").isNull(), F.col("n_fresh")).when((F.col("labels") > 1) | (F.col("local") == F.col("final")), F.col("n_inner")).otherwise(0)
    label, to = F.coalesce("new_named", "named", F.lit(0)).cast("long"), F.coalesce("new", "major", F.lit(0)).cast("long")
    m = stage(m.select("scene", "frame", "local", decision.alias("decision"), label.alias("label"), votes_for.cast("long").alias("n_points"), to.alias("to")), "judged")
    unstage(masks)
    return m


def voted(state: DataFrame, x: DataFrame, m: DataFrame, nth: int, accuracy: float) -> DataFrame:
    """The state with the votes of a frame's masks."""
    zone = F.when(F.col("decision") == "new_label", F.col("fresh")).otherwise(F.col("inner"))
    weight = F.when(F.col("decision") == "multi_overlap", MIXED).when(F.col("has").isNull(), FIRST).otherwise(AGAIN)
    added = x.join(m.filter("to > 0 and n_points > 0").select("scene", "local", "decision", "to"), ["scene", "local"]).filter(zone)
    added = added.groupBy(*POINT, "to").agg(F.sum(weight).alias("weight"))
    vote = F.struct("weight", F.lit(-nth).cast("long").alias("since"), (-F.col("to")).alias("label"))
    both = state.join(added.groupBy(*POINT).agg(F.collect_list(vote).alias("added")), POINT, "full")
    more = lambda v: F.coalesce(F.get(F.filter("added", lambda a: a["label"] == v["label"]), F.lit(0))["weight"], F.lit(0.0))
    old = F.transform("votes", lambda v: F.struct((v["weight"] + more(v)).alias("weight"), v["since"].alias("since"), v["label"].alias("label")))
    new = F.filter("added", lambda a: ~F.exists("votes", lambda v: v["label"] == a["label"]))
    votes = F.when(F.col("added").isNull(), F.col("votes")).when(F.col("votes").isNull(), F.col("added")).otherwise(F.concat(old, new))
    return both.select(*POINT, votes.alias("votes")).filter(F.size("votes") > 0).withColumn("has", leading(F.col("votes"), accuracy))


def propagate(views: DataFrame, accuracy: float, least: int) -> tuple[DataFrame, DataFrame]:
    """The log (LOG) of all frames in their order, and (scene, point, label) of the points that have a label after them."""
    spark = views.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    frames = views.groupBy("scene", "frame").agg(F.max(F.col("local") > 0).alias("masks"))
    frames = stage(frames.withColumn("nth", (F.row_number().over(Window.partitionBy("scene").orderBy("frame")) - 1).cast("long")), "frames").filter("masks")
    own = views.select("scene", "frame", "local", "point", "pixel", "overlap", "inner", "fresh").filter("local > 0").join(frames.drop("masks"), ["scene", "frame"])
    all_ = stage_by(own.repartition(n, *POINT), POINT, n, "views", order="nth")
    state, labels, logs = stage_by(spark.createDataFrame([], STATE), POINT, n, "state"), stage(spark.createDataFrame([], "scene long, label long"), "labels"), []
    for k in range((frames.agg(F.max("nth")).first()[0] or 0) + 1):
        # a scene is settled when its next frame comes
        now = frames.filter(F.col("nth") == k).select("scene")
        names = stage(leaders(state.join(now, "scene", "left_semi"), least), "names")
        gone = stage(listed(labels.join(now, "scene", "left_semi").join(names, ["scene", "label"], "left_anti")), "gone")
        settled = without(state, gone, accuracy)
        x = stage_by(all_.filter(F.col("nth") == k).join(settled.select(*POINT, "has"), POINT, "left"), POINT, n, "seen")
        m = judged(x, names)
        logs.append(m)
        new = m.filter("decision = 'new_label'").select("scene", F.col("to").alias("label"))
        old, labels = [labels, state], stage(labels.join(now, "scene", "left_anti").union(names.select("scene", "label")).union(new), "labels")
        state = stage_by(voted(settled, x, m, k, accuracy), POINT, n, "state")
        unstage(*old, names, gone, x)
    unstage(all_)
    names = leaders(state, least)
    left = without(state, listed(labels.join(names, ["scene", "label"], "left_anti")), accuracy).filter("has > 0")
    return reread(logs).select(*LOG), left.withColumnRenamed("has", "label").join(names, ["scene", "label"]).select(*POINT, F.col("named").alias("label"))
