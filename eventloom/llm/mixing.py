"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that they belong to). A flow network takes each pattern's
words to the quotas of its sources; the k-th use of a pattern's words costs k - 1 a word, so repetition is convex and spread.
What the flow takes of a pattern beyond whole repetitions goes to documents in a seeded order: a two-level sum (hash buckets,
then the one bucket that holds the cut) finds the order key up to which they are taken, without bringing a source together.

The driver holds one row per pattern, at most most_patterns of them; everything else is partial sums and comparisons.
"""

from __future__ import annotations

import heapq
from collections import deque
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import with_columns, written

BUCKET_BITS = 12


def n_words(text) -> F.Column:
    """Maximal runs without ASCII white space; null: 0."""
    plain = F.trim(F.translate(text, "\t\n\x0b\x0c\r", "     "))
    return F.when(F.coalesce(plain, F.lit("")) == "", 0).otherwise(F.size(F.split(plain, " +"))).cast("long")


def targets(sizes: dict, weights: dict, total: float, most_repeats: int) -> dict:
    """Shares of total by weight; a share stops at most_repeats times its source's size and the excess is reshared by weight."""
    caps = {s: float(most_repeats * n) for s, n in sizes.items()}
    out, left = {}, float(total)
    open_ = set(sizes)
    while open_:
        weight = sum(weights[s] for s in open_)
        full = {s for s in open_ if left * weights[s] / weight > caps[s]}
        if not full:
            return out | {s: left * weights[s] / weight for s in open_}
        out |= {s: caps[s] for s in full}
        left -= sum(caps[s] for s in full)
        open_ -= full
    return out


class Flow:
    """Min-cost flow."""

    def __init__(self):
        self.out: list[list[int]] = []
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def node(self) -> int:
        self.out.append([])
        return len(self.out) - 1

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def run(self, source: int, sink: int) -> None:
        """Primal-dual: after each search for least costs, as much flow as arcs of no reduced cost carry. There are as many
        searches as paths have different costs, which are few."""
        potential = [0] * len(self.out)
        while True:
            far, heap, tie = {source: 0}, [(0, 0, source)], count(1)
            while heap:
                d, _, a = heapq.heappop(heap)
                if d > far[a]:
                    continue
                for k in self.out[a]:
                    if self.room[k] > 0:
                        e = d + self.cost[k] + potential[a] - potential[b := self.to[k]]
                        if e < far.get(b, e + 1):
                            far[b] = e
                            heapq.heappush(heap, (e, next(tie), b))
            if sink not in far:
                return
            for a in range(len(potential)):
                potential[a] += min(far.get(a, far[sink]), far[sink])
            while (level := self._levels(source, potential)).get(sink):
                self._push(source, sink, potential, level)

    def _free(self, a: int, k: int, potential: list[int]) -> bool:
        return self.room[k] > 0 and self.cost[k] + potential[a] == potential[self.to[k]]

    def _levels(self, source: int, potential: list[int]) -> dict[int, int]:
        level, line = {source: 0}, deque([source])
        while line:
            a = line.popleft()
            for k in self.out[a]:
                if self.to[k] not in level and self._free(a, k, potential):
                    level[self.to[k]] = level[a] + 1
                    line.append(self.to[k])
        return level

    def _push(self, source: int, sink: int, potential: list[int], level: dict[int, int]) -> None:
        """A blocking flow along the levels, without recursion."""
        at = dict.fromkeys(level, 0)
        path: list[int] = []
        while True:
            a = self.to[path[-1]] if path else source
            if a == sink:
                step = min(self.room[k] for k in path)
                for k in path:
                    self.room[k] -= step
                    self.room[k ^ 1] += step
                del path[next(i for i, k in enumerate(path) if not self.room[k]) :]
                continue
            while at[a] < len(self.out[a]):
                k = self.out[a][at[a]]
                if level.get(self.to[k]) == level[a] + 1 and self._free(a, k, potential):
                    break
                at[a] += 1
            if at[a] < len(self.out[a]):
                path.append(self.out[a][at[a]])
            elif path:
                at[self.to[path.pop() ^ 1]] += 1
            else:
                return


def routed(patterns: dict[tuple, int], quotas: dict, most_repeats: int) -> dict[tuple, int]:
    """patterns: sources of a pattern -> its words; quotas: source -> words wanted. -> words taken of each pattern."""
    flow = Flow()
    begin, end = flow.node(), flow.node()
    into = {s: flow.node() for s in quotas}
    for s, n in quotas.items():
        flow.arc(into[s], end, n, 0)
    uses = {}
    for p, n in patterns.items():
        at = flow.node()
        uses[p] = [flow.arc(begin, at, n, k) for k in range(most_repeats)]
        for s in p:
            flow.arc(at, into[s], n * most_repeats, 0)
    flow.run(begin, end)
    return {p: sum(flow.room[k ^ 1] for k in arcs) for p, arcs in uses.items()}


def _order(docs: DataFrame, text: str, doc_id: str, seed: int) -> F.Column:
    """The seeded order of documents: the first field decides but for ties."""
    return F.struct(F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(doc_id).cast("string")), 1).alias("u"), F.coalesce(F.xxhash64(F.col(text).cast("string")), F.lit(0)).alias("t"))


def mix(docs: DataFrame, sources: F.Column, weight_of, *, text: str = "text", doc_id: str = "doc_id", most_repeats: int = 3, seed: int = 17, most_patterns: int = 100_000) -> DataFrame:
    """docs with size (words), source_size and target (of the first of its sources by code point, null last), and taken (words
    that the mix takes of the row, repeats counted).

    sources: an array column of the sources that a row belongs to. weight_of(sorted list of all sources, null last) -> weights
    in that order. All weights share the words of all rows; a target stops at most_repeats times its source's words.

    Defined cases: a null array is the null source alone; null and blank texts have size 0 and nothing is taken of them; a null
    doc_id orders like any other; equal rows (doc_id and text) are taken alike; an empty table gives an empty result; columns of
    docs named as the new ones give way, all others pass through. Reruns give the same rows whatever the partitioning.
    """
    spark = docs.sparkSession
    own = F.array_sort(F.array_distinct(F.coalesce(sources, F.array(F.lit(None).cast("string")))))
    own = F.when(F.size(own) == 0, F.array(F.lit(None).cast("string"))).otherwise(own)
    small = written(docs.select(own.alias("p"), n_words(F.col(text).cast("string")).alias("size"), _order(docs, text, doc_id, seed).alias("o")).select(F.to_json("p", {"ignoreNullFields": "false"}).alias("key"), "p", "size", "o"), "sizes")
    found = small.groupBy("key").agg(F.first("p").alias("p"), F.sum("size").alias("n")).limit(most_patterns + 1).collect()
    if len(found) > most_patterns:
        raise ValueError(f"over {most_patterns} membership patterns")
    patterns = {tuple(r.p): r.n for r in sorted(found, key=lambda r: r.key)}
    names = sorted({s for p in patterns for s in p}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(n for p, n in patterns.items() if s in p) for s in names}
    weights = dict(zip(names, weight_of(names), strict=True))
    wanted = targets(sizes, weights, sum(patterns.values()), most_repeats)
    taken = routed(patterns, {s: int(round(t)) for s, t in wanted.items()}, most_repeats)

    plan = []
    for r in found:
        p, first = tuple(r.p), min(r.p, key=lambda s: (s is None, s or ""))
        times, rest = divmod(taken[p], r.n) if r.n else (0, 0)
        plan.append((r.key, int(sizes[first]), float(wanted[first]), int(times), int(rest)))
    plan = spark.createDataFrame(plan, "key string, source_size long, target double, times long, rest long")  # a row per pattern

    bucket = F.shiftright(F.col("o.u"), 63 - BUCKET_BITS)
    sums = small.groupBy("key", bucket.alias("b")).agg(F.sum("size").alias("n")).join(F.broadcast(plan), "key")
    before = sums.withColumn("before", F.sum("n").over(Window.partitionBy("key").orderBy("b")) - F.col("n"))
    edge = before.where("before <= rest").groupBy("key").agg(F.max_by(F.struct("b", "before"), "b").alias("e")).select("key", "e.b", "e.before")
    near = small.withColumn("b", bucket).join(F.broadcast(edge), ["key", "b"]).join(F.broadcast(plan.select("key", "rest")), "key")
    upto = near.withColumn("end", F.col("before") + F.sum("size").over(Window.partitionBy("key").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)))
    cut = upto.where(F.col("end") - F.col("size") / 2 <= F.col("rest")).groupBy("key").agg(F.max("o").alias("last"))
    whole = edge.join(cut, "key", "left").select("key", F.col("b").alias("edge"), "last")
    full = plan.join(whole, "key", "left").collect()
    full = spark.createDataFrame([(r.key, r.source_size, r.target, r.times, r.edge, r["last"]) for r in full], "key string, source_size long, target double, times long, edge long, last struct<u: long, t: long>")

    base = with_columns(docs, size=F.lit(0), source_size=F.lit(0), target=F.lit(0), taken=F.lit(0)).drop("size", "source_size", "target", "taken")
    columns = [f"c{k}" for k in range(len(base.columns))]
    rows = base.select(*[base[f"`{c}`"].alias(n) for c, n in zip(base.columns, columns, strict=True)], n_words(F.col(text).cast("string")).alias("size"), F.to_json(own, {"ignoreNullFields": "false"}).alias("key"), _order(docs, text, doc_id, seed).alias("o"))
    extra = (F.shiftright(F.col("o.u"), 63 - BUCKET_BITS) < F.col("edge")) | (F.col("last").isNotNull() & (F.col("o") <= F.col("last")))
    out = rows.join(F.broadcast(full), "key")
    return out.select(*[F.col(n).alias(c) for c, n in zip(base.columns, columns, strict=True)], "size", "source_size", "target", (F.col("size") * F.least(F.lit(most_repeats), F.col("times") + F.when(F.coalesce(extra, F.lit(False)), 1).otherwise(0))).cast("long").alias("taken"))
