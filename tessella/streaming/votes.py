"""operators.votes on a stream of frames: the votes of a scene's points are keyed state, of which a frame reads and
writes its own points only. Rows of the log come out as frames come in; frames not later than one that was seen before
are late and left out. Needs the RocksDB state store."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessella.operators.votes import AGAIN, FIRST, LOG, MIXED

LOG_SCHEMA = "scene long, frame long, local long, decision string, label long, n_points long"


class Votes(StatefulProcessor):
    """State by scene: of each point its labels, weights and ordinals, in the order they came; how many points each
    label leads at; the labels that are there. Labels keep a number of their own here; their place among those that are
    left is the number they go by."""

    def __init__(self, accuracy: float, least: int):
        self.accuracy, self.least = accuracy, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.votes = handle.getMapState("votes", "point long", "labels array<long>, weights array<double>")
        self.leads = handle.getMapState("leads", "label long", "n long")
        self.scene = handle.getValueState("scene", "labels array<long>, made long, frame long")

    def leading(self, votes: tuple[list[int], list[float]]) -> int:
        labels, weights = votes
        k = max(range(len(weights)), key=weights.__getitem__, default=None)  # of equals the first
        return labels[k] if k is not None and weights[k] / sum(weights) >= self.accuracy else 0

    def get(self, point: int) -> tuple[list[int], list[float]]:
        got = self.votes.getValue((point,))
        return ([], []) if got is None else (list(got[0]), list(got[1]))

    def put(self, point: int, was: int, votes: tuple[list[int], list[float]], moved: Counter) -> None:
        self.votes.updateValue((point,), votes)
        now = self.leading(votes)
        if now != was:
            moved[was] -= 1
            moved[now] += 1

    def count(self, moved: Counter) -> None:
        for label, n in moved.items():
            if label and n:
                old = self.leads.getValue((label,))
                self.leads.updateValue((label,), ((old[0] if old else 0) + n,))

    def settle(self, labels: list[int]) -> list[int]:
        size = {v: (self.leads.getValue((v,)) or (0,))[0] for v in labels}
        gone = {v for v in labels if size[v] < self.least}
        if gone:
            moved: Counter = Counter()
            for (point,), (own, weights) in list(self.votes.iterator()):
                if not gone.isdisjoint(own):
                    kept = [(v, w) for v, w in zip(own, weights, strict=True) if v not in gone]
                    self.put(point, self.leading((list(own), list(weights))), ([v for v, _ in kept], [w for _, w in kept]), moved)
            self.count(moved)
            for v in gone:
                self.leads.removeKey((v,))
        return [v for v in labels if v not in gone]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        got = pd.concat(list(rows))
        labels, made, last = self.scene.get() if self.scene.exists() else ([], 0, None)
        labels, out = list(labels), []
        for frame, views in sorted(got[got["local"] > 0].groupby("frame")):
            if last is not None and frame <= last:
                continue
            labels, last = self.settle(labels), int(frame)
            made = self.one(int(frame), views, labels, made, out)
        self.scene.update((labels, made, last))
        yield pd.DataFrame([(key[0], *r) for r in out], columns=LOG)

    def one(self, frame: int, views: pd.DataFrame, labels: list[int], made: int, out: list[tuple]) -> int:
        number = {v: k + 1 for k, v in enumerate(labels)}
        held = {int(p): self.get(int(p)) for p in views["point"].unique()}
        led = {p: self.leading(v) for p, v in held.items()}
        masks = {int(m): r.sort_values("point") for m, r in views.groupby("local")}
        shown = {}
        for m, r in sorted(masks.items()):
            first: dict[int, int] = {}
            for p, pixel in zip(r["point"][r["overlap"]], r["pixel"][r["overlap"]], strict=True):
                if led[p]:
                    first.setdefault(pixel, led[p])
            shown[m] = Counter(first.values())
        final = {next(iter(c)): m for m, c in shown.items() if len(c) == 1}
        adds: dict[int, list[tuple[int, float | None]]] = defaultdict(list)
        for m, r in sorted(masks.items()):
            c, inner, fresh = shown[m], r["point"][r["inner"]].tolist(), r["point"][r["fresh"]].tolist()
            if not c and not fresh:
                out.append((frame, m, "empty_new", 0, 0))
            elif not c:
                made += 1
                labels.append(made)
                number[made] = len(labels)
                out.append((frame, m, "new_label", number[made], len(fresh)))
                for p in fresh:
                    adds[p].append((made, None))
            elif len(c) == 1:
                (v,) = c
                out.append((frame, m, "single_overlap", number[v], len(inner) if final[v] == m else 0))
                for p in inner if final[v] == m else ():
                    adds[p].append((v, None))
            else:
                v = min(c, key=lambda v: (-c[v], number[v]))
                out.append((frame, m, "multi_overlap", number[v], len(inner)))
                for p in inner:
                    adds[p].append((v, MIXED))
        moved: Counter = Counter()
        for p, more in adds.items():
            own, weights = held[p]
            plain = AGAIN if own else FIRST
            for v, w in more:
                if v not in own:
                    own.append(v)
                    weights.append(0.0)
                weights[own.index(v)] += plain if w is None else w
            self.put(p, led[p], (own, weights), moved)
        self.count(moved)
        return made

    def close(self) -> None:
        pass


def propagate(views: DataFrame, accuracy: float, least: int) -> DataFrame:
    """operators.votes.propagate's log of a stream of views; append mode. A frame must come whole in one micro-batch."""
    return views.groupBy("scene").transformWithStateInPandas(Votes(accuracy, least), LOG_SCHEMA, "Append", "None")
