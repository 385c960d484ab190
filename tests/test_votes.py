"""Vote propagation: the fold over frames against a scan with dictionaries, and the stream against the fold."""

import random

import pytest

from tessella.operators import votes
from tessella.streaming import votes as streamed

SCHEMA = "scene long, frame long, local long, point long, pixel long, overlap boolean, inner boolean, fresh boolean"


def views(seed, frames=7, points=60):
    """Points of a few objects; masks of a frame cut them anew, sometimes two objects in one or one in two."""
    rnd = random.Random(seed)
    rows = []
    for scene in range(2):
        kind = {p: rnd.randrange(5) for p in range(points)}
        for f in range(frames - scene):
            ids = {k: rnd.randint(1, 6) for k in range(5)}
            for p in rnd.sample(range(points), points * 2 // 3):
                local = ids[kind[p]] if rnd.random() < 0.9 else rnd.randint(0, 7)
                pixel = local * 100 + rnd.randrange(9)
                rows.append((scene, 10 * f + 3, local, p, pixel, pixel % 10 < 6, rnd.random() < 0.7, rnd.random() < 0.8))
    return rows


def scan(rows, accuracy, least):
    log, labels_of = [], []

    def lead(v):
        if not v:
            return 0
        label = max(v, key=v.get)  # of equals the first
        return label if v[label] / sum(v.values()) >= accuracy else 0

    def settle(state):
        size = {}
        for v in state.values():
            size[lead(v)] = size.get(lead(v), 0) + 1
        number = {v: k + 1 for k, v in enumerate(sorted(v for v, n in size.items() if v and n >= least))}
        return {p: {number[x]: w for x, w in v.items() if x in number} for p, v in state.items()}

    for scene in sorted({r[0] for r in rows}):
        state = {}
        for frame in sorted({r[1] for r in rows if r[0] == scene}):
            state = settle(state)
            own = [r for r in rows if r[:2] == (scene, frame) and r[2] > 0]
            had, top = {p: bool(v) for p, v in state.items()}, max((x for v in state.values() for x in v), default=0)
            led, single = {p: lead(v) for p, v in state.items()}, {}
            add = lambda p, x, w: state.setdefault(p, {}).__setitem__(x, state[p].get(x, 0) + w) if p in state else state.update({p: {x: w}})
            for local in sorted({r[2] for r in own}):
                mask = sorted((r for r in own if r[2] == local), key=lambda r: r[3])
                pixel = {}
                for r in mask:
                    if r[5] and led.get(r[3], 0):
                        pixel.setdefault(r[4], led[r[3]])
                seen = list(pixel.values())
                inner, fresh = [r[3] for r in mask if r[6]], [r[3] for r in mask if r[7]]
                if not seen and not fresh:
                    log.append((scene, frame, local, "empty_new", 0, 0))
                elif not seen:
                    top += 1
                    log.append((scene, frame, local, "new_label", top, len(fresh)))
                    for p in fresh:
                        add(p, top, 1.0 if had.get(p) else 1.25)
                elif len(set(seen)) == 1:
                    single[seen[0]] = (len(log), inner)
                    log.append((scene, frame, local, "single_overlap", seen[0], 0))
                else:
                    major = min(set(seen), key=lambda x: (-seen.count(x), x))
                    log.append((scene, frame, local, "multi_overlap", major, len(inner)))
                    for p in inner:
                        add(p, major, 0.75)
            for x, (at, inner) in single.items():
                log[at] = (*log[at][:5], len(inner))
                for p in inner:
                    add(p, x, 1.0 if had.get(p) else 1.25)
        labels_of += [(scene, p, lead(v)) for p, v in settle(state).items() if lead(v)]
    return sorted(log), sorted(labels_of)


@pytest.mark.parametrize("seed, accuracy, least", [(1, 0.55, 5), (2, 0.7, 2)])
def test_fold_equals_a_scan(spark, seed, accuracy, least):
    rows = views(seed)
    log, labels = scan(rows, accuracy, least)
    got_log, got_labels = votes.propagate(spark.createDataFrame(rows, SCHEMA), accuracy, least)
    assert sorted(map(tuple, got_log.collect())) == log
    assert sorted(map(tuple, got_labels.collect())) == labels
    assert {r[3] for r in log} >= {"new_label", "single_overlap", "multi_overlap"} and labels


def test_no_views(spark):
    log, labels = votes.propagate(spark.createDataFrame([], SCHEMA), 0.5, 1)
    assert log.collect() == [] and labels.collect() == []


def test_stream_equals_the_fold(spark, tmp_path):
    rows = views(3, frames=6, points=40)
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k, f in enumerate(sorted({r[1] for r in rows})):
            spark.createDataFrame([r for r in rows if r[1] == f], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        q = streamed.propagate(source, 0.55, 4).writeStream.format("memory").queryName("vote_log").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination(300)
        assert sorted(map(tuple, spark.table("vote_log").collect())) == scan(rows, 0.55, 4)[0]
    finally:
        if old is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
