"""Facts arriving one by one, each tested against those in force: the sequential form of temporal conflicts.

Groups of one subject and predicate are independent, so a group streams through one task in order of fact_id; only facts still in force are held.
Those with vectors lie in cells: unit vectors near a centre, with the largest angle to it.  By the triangle inequality on the sphere a cell whose
angle to an arriving vector, less its radius, is beyond the threshold's angle holds no candidate and is not compared.
"""

from __future__ import annotations

import heapq
import math
from collections import OrderedDict
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Arrivals that are compared with the cells at once, cells of a group at most (later vectors join the nearest), angle up to which a vector joins a cell.
ARRIVALS, CELLS, JOIN = 64, 512, 0.45
CONFLICT = "struct<conflicting_fact_id:long,similarity:double,superseded:long,kept:long>"


class Lowest:
    """Ids in order of arrival by object; finds the lowest ids of other objects without walking over those of the same."""

    def __init__(self):
        self.ids: dict[str, OrderedDict] = {}
        self.heads: list[tuple[int, str]] = []

    def add(self, fact: int, o: str) -> None:
        if o not in self.ids:
            self.ids[o] = OrderedDict()
            heapq.heappush(self.heads, (fact, o))
        self.ids[o][fact] = None

    def remove(self, fact: int, o: str) -> None:
        if o in self.ids:
            self.ids[o].pop(fact, None)

    def others(self, o: str, most: int) -> list[int]:
        """The ``most`` lowest ids of objects other than ``o``: they belong to the ``most`` objects of lowest first ids."""
        back, found = [], []
        while self.heads and len(found) < most:
            head, x = heapq.heappop(self.heads)
            first = next(iter(self.ids[x]), None)
            if first is None:
                del self.ids[x]
            elif first != head:
                heapq.heappush(self.heads, (first, x))
            else:
                back.append((head, x))
                if x != o:
                    found.append(x)
        for pair in back:
            heapq.heappush(self.heads, pair)
        return sorted(i for x in found for i in islice(self.ids[x], most))[:most]


class Cells:
    """Unit vectors of one length by cell; ``compared`` counts vectors met, ``held`` those there were."""

    def __init__(self, dim: int):
        self.centres = np.zeros((0, dim))
        self.radius = np.zeros(0)
        self.members: list[list] = []  # of each cell: vectors, ids, objects
        self.compared = self.held = self.size = 0

    def near(self, units: np.ndarray, objects: np.ndarray, least: float, live, most: int) -> list[list[tuple[float, int]]]:
        """For each arrival (similarity, fact) of members of another object from ``least`` on: the best that it can need, best first.

        While a block of arrivals is worked off each can end ``most`` members, so more than ``most`` of them are kept of each.
        """
        keep, out = most * (len(units) + 1), [[] for _ in units]
        self.held += self.size * len(units)
        if not len(self.centres):
            return out
        angle = np.arccos(np.clip(units @ self.centres.T, -1, 1))
        reach = angle - self.radius <= math.acos(max(-1.0, min(1.0, least))) + 1e-7
        for c in np.flatnonzero(reach.any(axis=0)).tolist():
            vectors, ids, kinds = self.members[c]
            alive = np.fromiter((i in live for i in ids.tolist()), bool, len(ids))
            if not alive.all():
                self.size -= len(ids) - int(alive.sum())
                vectors, ids, kinds = self.members[c] = [x[alive] for x in self.members[c]]
            at = np.flatnonzero(reach[:, c])
            self.compared += len(at) * len(ids)
            similar = units[at] @ vectors.T
            hits = (similar >= least) & (objects[at][:, None] != kinds)
            for row in np.flatnonzero(hits.any(axis=1)).tolist():
                found = np.flatnonzero(hits[row])
                if len(found) > keep:
                    found = found[np.lexsort((ids[found], -similar[row, found]))[:keep]]
                out[at[row]] += zip(similar[row, found].tolist(), ids[found].tolist(), strict=True)
        return [sorted(x, key=lambda p: (-p[0], p[1]))[:keep] for x in out]

    def add(self, units: np.ndarray, ids: np.ndarray, objects: np.ndarray) -> None:
        for k in range(len(ids)):
            cosines = self.centres @ units[k]
            best = int(cosines.argmax()) if len(cosines) else -1
            angle = math.acos(max(-1.0, min(1.0, cosines[best]))) if best >= 0 else math.inf
            if angle > JOIN and len(self.members) < CELLS:
                self.centres = np.concatenate([self.centres, units[k:k + 1]])
                self.radius = np.append(self.radius, 0.0)
                self.members.append([units[k:k + 1], ids[k:k + 1], objects[k:k + 1]])
            else:
                self.radius[best] = max(self.radius[best], angle)
                self.members[best] = [np.concatenate([a, b[k:k + 1]]) for a, b in zip(self.members[best], (units, ids, objects), strict=True)]
        self.size += len(ids)


class Group:
    """The facts of one subject and predicate that are in force."""

    def __init__(self, most: int, threshold: float | None, known: bool):
        self.most, self.threshold, self.known = most, threshold, known
        self.live: dict[int, dict] = {}
        self.lowest, self.cells, self.objects = Lowest(), {}, {}

    def arrive(self, facts: list[dict]) -> list[dict]:
        """Work off a block of arrivals; the facts that are no longer in force."""
        near = self._near(facts) if self.threshold is not None and self.known else {}
        ended = []
        for k, new in enumerate(facts):
            for old, similarity in self._candidates(k, new, near):
                newer, older = (new, old) if new["t"] is not None and old["t"] is not None and new["t"] >= old["t"] else (old, new)
                older |= {"by": newer["id"], "status": "inactive", "valid_to": newer["t"] if older["valid_to"] is None else older["valid_to"]}
                new["conflicts"].append({"conflicting_fact_id": old["id"], "similarity": similarity, "superseded": older["id"], "kept": newer["id"]})
                if older is old:
                    ended.append(self.live.pop(old["id"]))
                    self.lowest.remove(old["id"], old["o"])
            if new["by"] is None:
                self.live[new["id"]] = new
                if new["o"] is not None and self.known:
                    self.lowest.add(new["id"], new["o"])
            else:
                ended.append(new)
        for dim, (at, units, objects) in near.get("units", {}).items():
            still = [i for i, k in enumerate(at) if facts[k]["id"] in self.live]
            self.cells[dim].add(units[still], np.array([facts[at[i]]["id"] for i in still], np.int64), objects[still])
        return ended

    def _candidates(self, k: int, new: dict, near: dict) -> list[tuple[dict, float | None]]:
        if not self.known or new["o"] is None:
            return []
        if self.threshold is None or new["v"] is None:
            return [(self.live[i], None) for i in self.lowest.others(new["o"], self.most)]
        found = [(self.live[i], round_half_up(s)) for s, i in near.get(k, ()) if i in self.live][:self.most]
        return [(x, s) for x, s in found if s >= self.threshold]

    def _near(self, facts: list[dict]) -> dict:
        """{position: candidates} of the arrivals with vectors, earlier ones of the block included, and the unit vectors by length."""
        out: dict = {"units": {}}
        usable = [k for k, f in enumerate(facts) if f["v"] is not None and f["o"] is not None and any(f["v"]) and all(x is not None and math.isfinite(x) for x in f["v"])]
        least = self.threshold - 6e-5  # what may still round up to it
        for dim in {len(facts[k]["v"]) for k in usable}:
            at = [k for k in usable if len(facts[k]["v"]) == dim]
            units = np.array([facts[k]["v"] for k in at], np.float64)
            units /= np.linalg.norm(units, axis=1, keepdims=True)
            objects = np.array([self.objects.setdefault(facts[k]["o"], len(self.objects)) for k in at])
            cells = self.cells.setdefault(dim, Cells(dim))
            among = units @ units.T
            for i, (k, found) in enumerate(zip(at, cells.near(units, objects, least, self.live, self.most), strict=True)):
                mates = [(float(among[i, j]), facts[at[j]]["id"]) for j in range(i) if among[i, j] >= least and objects[i] != objects[j]]
                out[k] = sorted(found + mates, key=lambda p: (-p[0], p[1]))
            out["units"][dim] = (at, units, objects)
        return out


def round_half_up(x: float) -> float:
    return math.floor(x * 1e4 + 0.5) / 1e4


def replayed(facts: DataFrame, threshold: float | None = None, most: int = 10) -> DataFrame:
    """(fact_id, superseded_by, valid_to, status, conflicts): facts in order of fact_id, each tested against those before it that are in force.

    Candidates have the fact's subject and predicate and another object, whatever their case.  With a threshold a fact that has a vector meets the ``most`` nearest by cosine among those with
    vectors, as far as their similarity, rounded to 4 digits, reaches it; at equal similarity lower ids come first.  Without one, or without a vector, it meets the ``most`` lowest ids.  Of
    two in conflict the later in time supersedes the other, at equal times the one that arrives; the other becomes inactive and ends when the later begins, unless it has an end.
    ``conflicts`` are those found when the fact arrived.  Facts without subject, predicate or object meet none; zero vectors and those with null or non-finite
    components are similar to none.  fact_id is unique and not null.
    """
    vector = F.col("embedding").cast("array<double>") if threshold is not None else F.lit(None).cast("array<double>")
    micros = lambda c: F.unix_micros(c)
    rows = facts.select(F.lower("subject").alias("s"), F.lower("predicate").alias("p"), F.col("fact_id").cast("long").alias("id"), F.lower("object_value").alias("o"), micros(F.coalesce("valid_from", "observed_at")).alias("t"),
                        micros("valid_to").alias("valid_to"), "status", F.col("superseded_by").cast("long").alias("by"), vector.alias("v"))
    names = ("s", "p", "id", "o", "t", "valid_to", "status", "by", "v")

    def facts_of(batches):
        for batch in batches:
            yield from (dict(zip(names, row, strict=True), conflicts=[]) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))

    def made(states: list[dict]) -> pa.RecordBatch:
        kinds = {"id": pa.int64(), "by": pa.int64(), "valid_to": pa.int64(), "status": pa.string(), "conflicts": pa.list_(pa.struct([("conflicting_fact_id", pa.int64()), ("similarity", pa.float64()), ("superseded", pa.int64()), ("kept", pa.int64())]))}
        return pa.RecordBatch.from_arrays([pa.array([s[c] for s in states], t) for c, t in kinds.items()], ["fact_id", "superseded_by", "ends", "status", "conflicts"])

    def run(batches):
        done: list[dict] = []
        for (s, p), arrivals in groupby(facts_of(batches), key=lambda f: (f["s"], f["p"])):
            group = Group(most, threshold, s is not None and p is not None)
            while block := list(islice(arrivals, ARRIVALS)):
                done += group.arrive(block)
                if len(done) > 5000:
                    yield made(done)
                    done = []
            done += group.live.values()
            if len(done) > 5000:
                yield made(done)
                done = []
        yield made(done)

    ordered = rows.repartition("s", "p").sortWithinPartitions("s", "p", "id")
    out = ordered.mapInArrow(run, f"fact_id long, superseded_by long, ends long, status string, conflicts array<{CONFLICT}>")
    return out.select("fact_id", "superseded_by", F.timestamp_micros("ends").alias("valid_to"), "status", "conflicts")


def replay(facts: DataFrame, most: int = 10, threshold: float | None = None) -> DataFrame:
    """The states of ``replayed``."""
    return replayed(facts, threshold, most).drop("conflicts")


def conflict_log(states: DataFrame) -> DataFrame:
    """(fact_id, conflicting_fact_id, conflict_type, similarity, superseded, kept, detected_via): a row for each conflict that an arrival found."""
    rows = states.select("fact_id", F.explode("conflicts").alias("c")).select("fact_id", "c.*")
    via = F.when(F.col("similarity").isNull(), "lexical").otherwise("embedding")
    return rows.select("fact_id", "conflicting_fact_id", F.lit("temporal").alias("conflict_type"), "similarity", "superseded", "kept", via.alias("detected_via"))
