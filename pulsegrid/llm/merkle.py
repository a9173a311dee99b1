"""Merkle manifest of a dataset, and its proofs by content-addressed DAG descent.

Every row is a leaf; the leaves of a group (source) make a tree, and the
groups' roots make the tree above.  A tree's nodes are runs of ``ARITY``
consecutive digests.  All inner nodes are kept as records digest -> children.

*Building.*  Rows are numbered within their group by a range sort, so a large
group is many tasks.  One grouping of ``ARITY ** SPAN`` consecutive digests
makes ``SPAN`` levels.

*Proving.*  Requests descend from the root.  The digits of a leaf's rank (base
``ARITY``) name the child to go to at each record; the children that aren't
chosen are the proof's next part, and the parts are reversed at the leaf.
Requests that share the first digits are one state until their paths part, so
the root's record is read by one row, not by all requests.  A level of states
meets the records of its height only, by digest; states and records are
written tables, so AQE splits a digest that many equal subtrees share.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_first, load_order, materialize, numbered

ARITY = 3
SPAN = 4          # levels of one grouping: at most ARITY ** SPAN digests in a row
STEP = "array<struct<l:string,r:string>>"


class Manifest(NamedTuple):
    """``leaves``: one row an input row (group number, rank, n, its columns); ``subroots``: group, name, n, digest, depth;
    ``records`` and ``top_records``: height, digest, children; ``root`` (None without rows) and its ``depth``."""
    leaves: DataFrame
    subroots: DataFrame
    records: DataFrame
    top_records: DataFrame
    root: str | None
    depth: int


def field(value: Column) -> Column:
    """A value as a leaf hashes it: ``-`` if null, else its UTF-8 byte count, a colon, the value."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def row_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _depth(n: Column, arity: int) -> Column:
    """Levels above ``n`` leaves: the least d with arity ** d >= n."""
    powers = [arity ** e for e in range(63) if arity ** e < 2 ** 63]
    return F.size(F.filter(F.array(*[F.lit(p).cast("bigint") for p in powers]), lambda p: p < n))


def build(nodes: DataFrame, arity: int = ARITY, span: int = SPAN, name: str = "tree") -> tuple[DataFrame, DataFrame]:
    """(roots, records) of the trees over ``nodes`` (g, i, n, digest): i counts from 0 within g, n is the group's size.

    roots: g, digest.  records: height (from 1 above the leaves), digest, children, each digest once.
    """
    done, found, level, height = [], [], nodes, 0
    while True:
        done.append(level.where("n = 1").select("g", "digest"))
        open_ = level.where("n > 1")
        if open_.isEmpty():
            break
        block = arity ** span
        kids = F.array_sort(F.collect_list(F.struct("i", "digest")))
        runs = open_.groupBy("g", F.floor(F.col("i") / block).alias("at"), "n").agg(kids.alias("kids"))
        runs = runs.withColumn("digests", F.transform("kids", lambda k: k["digest"])).drop("kids")
        for step in range(span):  # a level at a time, while more than one node of the group remains
            more = F.col("n") > 1
            starts = F.sequence(F.lit(0), F.floor((F.size("digests") - 1) / arity).cast("int"))
            made = F.transform(starts, lambda j: F.slice("digests", j * arity + 1, F.lit(arity)))
            record = F.transform(made, lambda c: F.struct(F.lit(height + step + 1).alias("height"), F.sha2(F.array_join(c, ""), 256).alias("digest"), c.alias("children")))
            runs = runs.withColumn(f"r{step}", F.when(more, record).otherwise(F.array().cast("array<struct<height:int,digest:string,children:array<string>>>")))
            runs = runs.withColumns({"digests": F.when(more, F.transform(f"r{step}", lambda r: r["digest"])).otherwise(F.col("digests")),
                                     "n": F.ceil(F.col("n") / arity)})
        runs = materialize(runs.select("g", F.col("at").alias("i"), "n", F.col("digests")[0].alias("digest"),
                                       F.concat(*[F.col(f"r{s}") for s in range(span)]).alias("records")), f"{name}-nodes")
        found.append(runs.select(F.inline("records")))
        level, height = runs.drop("records"), height + span
    if not found:
        return done[0], nodes.sparkSession.createDataFrame([], "height int, digest string, children array<string>")
    records = reduce(DataFrame.unionByName, found).dropDuplicates(["height", "digest"])
    return reduce(DataFrame.unionByName, done), materialize(records, f"{name}-records", "height")


def manifest(docs: DataFrame, leaf: Column, group: str, order: str, keep: dict[str, Column] | None = None,
             arity: int = ARITY, span: int = SPAN) -> Manifest:
    """The manifest of ``docs``: ``leaf`` is a row's digest, ``group`` and ``order`` are columns, ``keep`` more columns of the leaves.

    Groups are ordered by name, null first, bytewise.  Within a group rows are
    ordered by ``order`` (null last), then by digest; rows equal in both have
    equal digests, so their order changes no digest.
    """
    base = materialize(docs.select(F.col(group).alias("name"), F.col(order).alias("id"), leaf.alias("leaf"),
                                   *[c.alias(n) for n, c in (keep or {}).items()]), "leaves")
    ranged = load_order(base, ["name"], [id_first("id"), F.col("leaf")])
    placed = materialize(ranged, "ordered-leaves")
    # a group's pieces: one a task that holds rows of it
    pieces = placed.groupBy("name", F.shiftright("_at", 33).alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    pieces = materialize(pieces, "pieces")
    sizes = materialize(pieces.groupBy("name").agg(F.sum("_rows").alias("n")), "group-sizes")
    groups = materialize(numbered(sizes, [F.col("name")], "groups").withColumnRenamed("rank", "g"), "numbered-groups")
    ahead = F.coalesce(F.sum("_rows").over(Window.partitionBy("name").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = pieces.select(F.col("name").alias("_name"), F.col("_part").alias("_p"), (ahead - F.col("_first")).alias("_offset"))
    offsets = offsets.join(groups.withColumnRenamed("name", "_own"), F.col("_name").eqNullSafe(F.col("_own")))
    leaves = placed.join(offsets, F.col("name").eqNullSafe(F.col("_name")) & (F.shiftright("_at", 33) == F.col("_p")))
    leaves = materialize(leaves.select("g", (F.col("_at") + F.col("_offset")).alias("i"), "n", "name", "id", "leaf", *(keep or {})), "numbered-leaves")

    roots, records = build(leaves.select("g", "i", "n", F.col("leaf").alias("digest")), arity, span, "group")
    subroots = materialize(roots.join(groups, "g").withColumn("depth", _depth(F.col("n"), arity)), "subroots")
    count = groups.count()
    top, top_records = build(subroots.select(F.lit(0).alias("g"), F.col("g").alias("i"), F.lit(count).cast("bigint").alias("n"), "digest"),
                             arity, span, "top")
    root = top.first()
    depth = next(d for d in range(64) if arity ** d >= count)
    return Manifest(leaves, subroots, records, top_records, root.digest if root else None, depth)


def _sides(children: Column, digit: Column) -> Column:
    """The children left and right of the chosen one, each side's digests joined."""
    return F.struct(F.array_join(F.slice(children, F.lit(1), digit), "").alias("l"),
                    F.array_join(F.slice(children, digit + 2, F.lit(1 << 20)), "").alias("r"))


def descend(states: DataFrame, records: DataFrame, until: int, arity: int = ARITY, wanted: DataFrame | None = None, name: str = "descent") -> DataFrame:
    """Go down from ``states`` (g, i, h, digest, path) to height ``until``: one state a node there.

    ``h`` is the state's height, ``i`` its place among the nodes of that height.
    ``wanted`` (g, rank) are the leaves that are asked for (default: all).
    States that start at ``until`` or below stay as they are.
    """
    done, high = [states.where(F.col("h") <= until)], states.agg(F.max("h")).first()[0]
    here = None  # what came down to height ``high``
    while high is not None and high > until:
        start = states.where(F.col("h") == high)
        here = start if here is None else here.unionByName(start)
        at = records.where(F.col("height") == high).select(F.col("digest").alias("_d"), "children")
        down = here.join(at, F.col("digest") == F.col("_d")).select("*", F.posexplode("children").alias("digit", "child"))
        down = down.select("g", (F.col("i") * arity + F.col("digit")).alias("i"), (F.col("h") - 1).alias("h"), F.col("child").alias("digest"),
                           F.array_append("path", _sides(F.col("children"), F.col("digit"))).alias("path"))
        if wanted is not None:
            asked = wanted.select("g", F.floor(F.col("rank") / arity ** (high - 1)).alias("i")).distinct()
            down = down.join(asked, ["g", "i"], "left_semi").select(*states.columns)
        here, high = materialize(down, name), high - 1
    return reduce(DataFrame.unionByName, [*done, here] if here is not None else done)


def prove(m: Manifest, requests: DataFrame | None = None, arity: int = ARITY) -> DataFrame:
    """Each requested leaf (g, i and the leaf's columns; default all) with subroot, root and ``path``: its proof from the leaf up.

    A step of the path holds the digests left and right of the way, so the next
    digest is H(l, own, r).
    """
    spark, every = m.leaves.sparkSession, requests is None
    requests = m.leaves if every else requests
    wanted = None if every else materialize(requests.select("g", F.col("i").alias("rank")).distinct(), "wanted")
    groups = None if every else wanted.select(F.lit(0).alias("g"), F.col("g").cast("bigint").alias("rank")).distinct()
    start = spark.createDataFrame([(0, 0, m.depth, m.root)] if m.root else [], "g int, i bigint, h int, digest string")
    start = start.withColumn("path", F.array().cast(STEP))
    tops = descend(start, m.top_records, 0, arity, groups, "top-descent")
    # a group's tree goes on where the tree above it ends
    below = tops.select(F.col("i").alias("g"), F.col("digest").alias("subroot"), "path").join(m.subroots.select("g", "depth"), "g")
    below = materialize(below.select("g", F.lit(0).cast("bigint").alias("i"), F.col("depth").alias("h"), F.col("subroot").alias("digest"), "path"), "group-tops")
    runs = descend(below, m.records, 1, arity, wanted, "group-descent")
    # the last step: a run's children meet the requests for them
    first = m.records.where("height = 1").select(F.col("digest").alias("_d"), "children")
    runs = runs.join(first, (F.col("digest") == F.col("_d")) & (F.col("h") == 1), "left")
    runs = runs.select(F.col("g").alias("_g"), F.col("i").alias("_i"), F.col("path").alias("_path"), "children")
    met = requests.join(runs, (F.col("g") == F.col("_g")) & (F.floor(F.col("i") / arity) == F.col("_i")))
    step = _sides(F.col("children"), (F.col("i") % arity).cast("int"))
    full = F.when(F.col("children").isNull(), F.col("_path")).otherwise(F.array_append("_path", step))
    met = met.join(below.select(F.col("g").alias("_s"), F.col("digest").alias("subroot")), F.col("g") == F.col("_s"))
    return met.select(*requests.columns, "subroot", F.lit(m.root).cast("string").alias("root"), F.reverse(full).alias("path"))


def proof_text(path: Column) -> Column:
    """The digests of a proof, joined from the leaf up."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), "")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(path, leaf, lambda own, s: F.sha2(F.concat(s["l"], own, s["r"]), 256))


def document_manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row per input row.

    A leaf holds doc_id, source, lang, n_chars and text; groups are sources.
    Rows whose id has an even CRC32 are checked against a copy of the row that
    has lost the line feeds of its text (null ids and null texts stay as they
    are).  Rows repeated in full are leaves of their own with equal digests.
    An empty table gives an empty result.
    """
    names = ("doc_id", "source", "lang", "n_chars")
    leaf = row_digest(*[F.col(c) for c in names], F.col("text"))
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False)) & F.coalesce(F.contains("text", F.lit("\n")), F.lit(False))
    changed = F.when(hit, row_digest(*[F.col(c) for c in names], F.replace("text", F.lit("\n"), F.lit(""))))
    proofs = prove(manifest(docs, leaf, "source", "doc_id", keep={"changed": changed}))
    out = proofs.withColumns({"proof_sha256": F.sha2(proof_text(F.col("path")), 256),
                              "folded_root": fold(F.coalesce("changed", "leaf"), F.col("path"))})
    return out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root",
                      (F.col("folded_root") == F.col("root")).alias("verified"))
