"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources a document
belongs to).  Each pattern offers its words once free of cost, once more at a
cost of one a word, and so on, a convex cost of repetition, up to
``MAX_REPEATS`` times; each source asks for its target.  The min-cost flow over
patterns and sources says how many words of each pattern go to each source.
Then documents are selected by a seeded hash: each of a pattern's documents is
taken as often as the flow uses the pattern in full, and the first in hash
order once more for the rest.

Sources, their sizes and targets are a table, however many there are.  A source
whose documents belong to it alone needs no search: the flow gives it its own
words up to its target.  Only patterns of several sources, and those that share
a source with them, are searched, on the driver; their number (not that of
sources or documents) is checked against ``MAX_PATTERNS``.  The selection never sorts a pattern as a whole: hash slices are
summed, the slice in which the cut falls is found, then cut into finer slices,
and only the documents of one fine slice are put in order.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, numbered, text_or_empty

MAX_REPEATS = 3
MAX_PATTERNS = 20_000
SLICES = 4096
SEED = 17


def cycle_weight(rank: Column) -> Column:
    """Weights 1, 2, 3, repeating, of the sources in order (``rank`` counts from 0)."""
    return rank % 3 + 1


def targets(sizes: list[int], weights: list[float], total: int, most: float = MAX_REPEATS) -> list[float]:
    """Shares of ``total`` by weight; none above ``most`` times its size, the excess reshared by weight: ``shared_targets`` in plain words."""
    out = [0.0] * len(sizes)
    open_, left = [i for i, n in enumerate(sizes) if n > 0], float(total)
    while open_:
        weight = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / weight > most * sizes[i]]
        for i in full or open_:
            out[i] = float(most * sizes[i]) if full else left * weights[i] / weight
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in full] if full else []
    return out


def shared_targets(sources: DataFrame, total: int, most: int = MAX_REPEATS) -> DataFrame:
    """``sources`` (source_size, weight, a written table) with ``target``: shares of ``total`` by weight; none above ``most``
    times its size, the excess reshared by weight.

    A round is one aggregate: sources that the share of the round before
    overfills are full, and what is left is shared by the weight of the others.
    """
    size, weight, full = F.col("source_size"), F.col("weight").cast("double"), F.col("source_size") * most
    left, over, held = float(total), 0.0, -1
    while True:
        brim = (F.lit(left) * weight / F.lit(over) > full) if over else F.lit(False)
        figures = sources.where(size > 0).agg(F.count_if(brim).alias("n"), F.sum(F.when(brim, full)).alias("full"), F.sum(F.when(~brim, weight)).alias("open")).first()
        if figures.n == held or figures.open is None:
            break
        held, left, over = figures.n, float(total - (figures.full or 0)), figures.open
    share = F.lit(left) * weight / F.lit(over or 1.0)
    return sources.withColumn("target", F.when(size <= 0, 0.0).otherwise(F.least(full.cast("double"), share)))


def min_cost_flow(capacity: list[int], member_of: list[list[int]], quota: list[int], repeats: int = MAX_REPEATS) -> list[dict[int, int]]:
    """Words of each pattern that go to each source, at the least total cost of repetition.

    Pattern p offers ``capacity[p]`` words at cost 0, as many at cost 1, and so
    on, ``repeats`` times.  Raising the number of uses level by level and
    finding augmenting paths within each level is the successive-shortest-path
    method for these costs: a path that uses level k costs k, whatever it reroutes.
    """
    n, m = len(capacity), len(quota)
    flow: list[dict[int, int]] = [{} for _ in range(n)]
    users: list[set[int]] = [set() for _ in range(m)]  # patterns that feed a source
    short = list(quota)
    for _ in range(repeats):
        spare = list(capacity)
        while True:
            # breadth first from patterns with words to spare, over sources, back over flows that can be rerouted
            seen_p = {p: None for p in range(n) if spare[p] > 0}
            queue, seen_s, end = deque(seen_p), {}, None
            while queue and end is None:
                p = queue.popleft()
                for s in member_of[p]:
                    if s in seen_s:
                        continue
                    seen_s[s] = p
                    if short[s] > 0:
                        end = s
                        break
                    for other in users[s]:
                        if other not in seen_p:
                            seen_p[other] = s
                            queue.append(other)
            if end is None:
                break
            path, s = [], end
            while s is not None:
                p = seen_s[s]
                path.append((p, s))
                s = seen_p[p]
            amount = min(short[end], spare[path[-1][0]], *(flow[p][t] for (p, _), (_, t) in zip(path, path[1:])))
            for p, s in path:
                flow[p][s] = flow[p].get(s, 0) + amount
                users[s].add(p)
            for (p, _), (_, t) in zip(path, path[1:]):  # p now feeds its source in place of t
                flow[p][t] -= amount
                if not flow[p][t]:
                    del flow[p][t]
                    users[t].discard(p)
            short[end] -= amount
            spare[path[-1][0]] -= amount
    return flow


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


class Mix(NamedTuple):
    rows: DataFrame     # a row per input row: the id, kept columns, size, pattern, taken
    sources: DataFrame  # a row per source: source, source_size, target, routed


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sources: Column | None = None,
        keep: list[str] | None = None, weight: Callable[[Column], Column] = cycle_weight, repeats: int = MAX_REPEATS,
        seed: int = SEED) -> Mix:
    """How many words of each document the mix takes.

    ``rows`` has the id, the columns in ``keep``, ``size`` (words; null text:
    0), ``pattern`` (the document's sources, sorted) and ``taken``: the words
    taken, repeats counted, at most ``repeats * size``.  ``sources`` has each
    source's size, target and the words routed to it.  The argument
    ``sources`` is an array of source names (default: the one in column
    ``source``); repeated names count once, null is a source of its own, and
    an empty or null array is the null source.  Sources in code point order,
    null last, weigh ``weight(rank)``, a column of their rank from 0; together they share all
    sizes, none over ``repeats`` times its own.  Of each pattern, documents in
    hash order are taken whole; the one at the cut gives the words still
    missing, so the words taken are the words routed (rows that repeat one id
    at the cut share them evenly, less a remainder below their number).  Empty
    documents give nothing.  Partitions and reruns do not change the result.
    An empty table gives empty rows and sources.
    """
    none = F.array(F.lit(None).cast("string"))
    names = F.array_distinct(F.coalesce((F.array("source") if sources is None else sources).cast("array<string>"), none))
    keep = [c for c in keep or [] if c != id_col]
    rows = docs.select(F.col(id_col).alias("mix_id"), F.struct(F.col(id_col), *keep).alias("row"),
                       word_count(text_or_empty(text_col)).alias("size"),
                       F.array_sort(F.when(F.size(names) == 0, none).otherwise(names)).alias("pattern"))
    rows = rows.withColumn("u", F.xxhash64(F.lit(seed), "mix_id", "size"))
    slim = materialize(rows.select("mix_id", "size", "pattern", "u"), "mix-sizes")
    if not keep:
        rows = slim.withColumn("row", F.struct(F.col("mix_id").alias(id_col)))

    found = materialize(slim.groupBy("pattern").agg(F.sum("size").alias("size")), "mix-patterns")
    per = found.select(F.explode("pattern").alias("source"), "size").groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = numbered(materialize(per, "mix-source-sizes"), [F.col("source").asc_nulls_last()], "mix-sources")
    total = found.agg(F.sum("size")).first()[0] or 0
    about = materialize(shared_targets(materialize(ranked.withColumn("weight", weight(F.col("rank"))), "mix-weights"), total, repeats), "mix-targets")
    about = about.withColumn("goal", F.bround("target").cast("bigint"))

    # sources that share documents are searched; the others get their own words
    shared = found.where(F.size("pattern") > 1)
    if shared.isEmpty():
        tangled, knots, flows = about.limit(0).select("source"), [], []
    else:
        tangled = materialize(shared.select(F.explode("pattern").alias("source")).distinct(), "mix-shared-sources")
        named = found.withColumn("own", F.explode("pattern")).alias("p").join(tangled.alias("t"), F.col("p.own").eqNullSafe(F.col("t.source")), "left_semi")
        knots = named.select("pattern", "size").distinct().limit(MAX_PATTERNS + 1).collect()
        if len(knots) > MAX_PATTERNS:
            raise ValueError(f"over {MAX_PATTERNS} patterns of sources that share documents; mix fewer of these at a time")
        ends = about.alias("a").join(tangled.alias("t"), F.col("a.source").eqNullSafe(F.col("t.source")), "left_semi").orderBy("rank").collect()
        index = {r.source: i for i, r in enumerate(ends)}
        knots.sort(key=lambda r: [index[s] for s in r.pattern])
        flows = min_cost_flow([r.size for r in knots], [[index[s] for s in r.pattern] for r in knots], [r.goal for r in ends], repeats)

    spark = docs.sparkSession
    routes = spark.createDataFrame([(r.pattern, sum(f.values()) // r.size, sum(f.values()) % r.size) for r, f in zip(knots, flows) if r.size],
                                   "pattern array<string>, whole long, rest long")
    given: dict[int, int] = {}
    for f in flows:
        for s, n in f.items():
            given[s] = given.get(s, 0) + n
    reached = spark.createDataFrame([(i, r.source, given.get(i, 0)) for i, r in enumerate(ends)] if knots else [], "at int, source string, got long")
    own = about.alias("a").join(tangled.alias("t"), F.col("a.source").eqNullSafe(F.col("t.source")), "left_anti")
    quota = own.where("source_size > 0").select(F.array("source").alias("pattern"), F.expr("goal div source_size").alias("whole"), (F.col("goal") % F.col("source_size")).alias("rest"))
    quota = materialize(quota.unionByName(routes), "mix-quota")
    whole = own.select("rank", "source", "source_size", "target", F.col("goal").alias("routed"))
    if knots:
        part = about.alias("a").join(reached.alias("r"), F.col("a.source").eqNullSafe(F.col("r.source")))
        whole = whole.unionByName(part.select("rank", "a.source", "source_size", "target", F.col("got").alias("routed")))
    return Mix(_select(rows, slim, quota), materialize(whole, "mix-result").orderBy("rank").drop("rank"))


def _select(rows: DataFrame, slim: DataFrame, quota: DataFrame) -> DataFrame:
    """Each pattern's whole uses, and one more for its first documents in hash order up to the rest."""
    bits = SLICES.bit_length() - 1
    slices = {"coarse": F.shiftrightunsigned("u", 64 - bits), "fine": F.shiftrightunsigned("u", 64 - 2 * bits)}

    def cut(df: DataFrame, at: list[str], name: str) -> DataFrame:
        """Per pattern the first group by ``at`` whose running sum goes over the rest: its key, rows, words and the sum before it."""
        per = df.groupBy("pattern", "rest", "before", *at).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        upto = F.col("before") + F.sum("words").over(Window.partitionBy("pattern").orderBy(*at))
        over = per.withColumn("upto", upto).where(F.col("upto") > F.col("rest"))
        key = F.struct(*at)
        best = over.groupBy("pattern", "rest").agg(F.min(F.struct(key.alias("key"), (F.col("upto") - F.col("words")).alias("before"), "n")).alias("x"))
        return materialize(best.select("pattern", "rest", "x.before", "x.n", "x.key.*"), name)

    marked = slim.where("size > 0").join(quota, "pattern").withColumn("before", F.lit(0).cast("bigint"))
    for at, of in slices.items():
        found = cut(marked.withColumn(at, of), [at], f"mix-{at}")
        marked = marked.drop("before", "rest").withColumn(at, of).join(found.drop("n"), ["pattern", at])
    edge = cut(marked, ["fine", "u", "mix_id", "size"], "mix-edge")
    edge = edge.select("pattern", F.struct("u", "mix_id", "size").alias("edge"), "fine",
                       F.floor((F.col("rest") - F.col("before")) / F.col("n")).alias("part"))

    out = rows.join(quota, "pattern", "left").join(materialize(edge, "mix-edges"), "pattern", "left")
    own = F.struct("u", "mix_id", "size")
    more = (F.when(F.col("fine").isNull(), 0)
            .when(slices["fine"] != F.col("fine"), F.when(slices["fine"] < F.col("fine"), F.col("size")).otherwise(0))
            .when(own == F.col("edge"), F.col("part")).when(own < F.col("edge"), F.col("size")).otherwise(0))
    taken = F.when(F.col("size") > 0, F.coalesce(F.col("whole"), F.lit(0)) * F.col("size") + more).otherwise(0)
    return out.select("row.*", "size", "pattern", taken.cast("bigint").alias("taken"))
