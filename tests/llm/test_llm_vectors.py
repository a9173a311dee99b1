"""Vector codes, the prefix forest and the Merkle manifest against plain versions, odd rows included."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import merkle, prefix_forest, queries, vector_codes
from pulsegrid.llm.common import load
from test_llm_operators import corpus, frame, result, sha

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<double>, label int, id long, v long, width int, h long, code string, error long, qid long"


def vectors(seed=5, n=160, width=16, hot=60):
    """Vectors in clusters, a hot one in many copies, nulls, zeros, non-finite and repeated rows, other lengths."""
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(6, width))
    rows = [(i, (centers[i % 6] + rng.normal(size=width) * 0.3).tolist(), i % 4) for i in range(n)]
    rows += [(10_000 + i, rows[3][1], None) for i in range(hot)]
    rows += [(20000, None, 1), (20001, [], 1), (20002, [0.0] * width, 2), (20003, [NAN] + [1.0] * (width - 1), 2), (20004, [INF] * width, 2),
             (20005, [None] + [1.0] * (width - 1), 2), (20006, [1.0, 2.0, 3.0], 7), (20007, [1.0, 2.0, 3.0], 7), (20008, [3.0, 2.0, 1.0], None),
             rows[0], rows[1], (5, [9.0] * width, 3), (None, [1.0] * width, 3), (None, [2.0] * width, None)]
    random.Random(seed).shuffle(rows)
    return rows


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(*r, *([None] * 7)) for r in rows], schema).repartition(3)


# -- vector codes ---------------------------------------------------------------
def brute_codes(rows, scale=4096, parts=8, entries=16, rounds=6):
    kept = [(i, label, [math.floor(scale * x) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, label, v + [0] * (-len(v) % parts)) for i, label, v in kept]
    out = []
    for width in sorted({len(v) for _, _, v in kept}):
        own, size = [r for r in kept if len(r[2]) == width], width // parts
        first = {}
        for i, _, v in own:
            first[i] = min(first.get(i, v), v)
        cut = lambda v: [v[p * size:(p + 1) * size] for p in range(parts)]  # noqa: E731, B023
        start = [first[i] for i in sorted(first, key=lambda i: (i is None, i or 0))[:entries]]
        books = [[cut(v)[p] for v in start] for p in range(parts)]
        best = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
        for _ in range(rounds):
            got = [{} for _ in range(parts)]
            for _, _, v in own:
                for p, x in enumerate(cut(v)):
                    got[p].setdefault(best(x, books[p])[1], []).append(x)
            for p in range(parts):
                for k, xs in got[p].items():
                    books[p][k] = [sum(c) // len(xs) for c in zip(*xs)]
        digest = sha(",".join(str(c) for b in books for e in b for c in e))
        for i, label, v in own:
            near = [best(x, books[p]) for p, x in enumerate(cut(v))]
            out.append((i, label, "".join("%02x" % k for _, k in near), sum(d for d, _ in near), digest))
    totals = {}
    for _, label, _, error, _ in out:
        totals[label] = totals.get(label, 0) + error
    fit = lambda e: e if e < 1 << 63 else None
    return [(i, c, fit(e), fit(totals[label]), s) for i, label, c, e, s in out]


def by_nulls(rows):
    return sorted(rows, key=lambda r: [(x is None, x) for x in r])


CODE_COLUMNS = ("vec_id", "code", "error", "label_error", "codebooks_sha256")


@pytest.mark.parametrize("cell", [512, 64, 1 << 14])
def test_vector_codes(spark, cell):
    rows = vectors()
    got, _ = vector_codes.compress(table(spark, rows), cell=cell)
    assert result(got, *CODE_COLUMNS) == by_nulls(brute_codes(rows))


@pytest.mark.parametrize("size", [1e5, 1e16, 1e30])
def test_vector_codes_of_large_components(spark, size):
    """Sums and squares beyond doubles are still exact; errors beyond a long are null."""
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-size, size) for _ in range(16)], i % 3) for i in range(60)]
    got, _ = vector_codes.compress(table(spark, rows))
    want = by_nulls(brute_codes(rows))
    assert result(got, *CODE_COLUMNS) == want
    assert any(r[2] is None for r in want) == (size > 1e9)


def test_vector_codes_of_few_and_no_rows(spark):
    rows = vectors()[:0] + [(7, [0.5] * 16, None), (None, [1.5] * 16, None), (7, [0.25] * 16, 1)]
    assert result(vector_codes.compress(table(spark, rows))[0], *CODE_COLUMNS) == by_nulls(brute_codes(rows))
    assert vector_codes.compress(table(spark, rows).limit(0))[0].collect() == []


def test_memo_never_leaves_out_the_nearest_entry():
    rng = np.random.default_rng(1)
    entries = rng.integers(-900, 900, (16, 6)).tolist()
    book = vector_codes.Books([entries], 256)
    for _ in range(3):  # the memo of one call serves the next
        x = rng.integers(-1000, 1000, (400, 6)).astype(float)
        mask = book.candidates(0, x)
        d = ((x[:, None] - np.array(entries)[None]) ** 2).sum(axis=2)
        assert mask[np.arange(400), d.argmin(axis=1)].all() and mask.mean() < 0.9
    assert len(book.memo[0][0]) > 100


def test_memo_tells_cells_of_one_hash_apart():
    book = vector_codes.Books([[[0, 0], [1000, 1000]]], 100)
    x = np.array([[10.0, 10.0], [990.0, 990.0]])
    assert book.candidates(0, x).sum() == 2
    hashes, cells, masks = book.memo[0]
    book.memo[0] = (hashes, cells[::-1].copy(), masks[::-1].copy())  # as if the hashes had met
    assert book.candidates(0, x).all() and book.assign(x)[0].ravel().tolist() == [0, 1]


# -- prefix forest ----------------------------------------------------------------
def brute_near(rows, k, step):
    one = {}
    for i, v, _ in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            one[i] = min(one.get(i, v), v)
    score = lambda a, b: reduce(lambda s, xy: s + xy[0] * xy[1], zip(a, b), 0.0)  # noqa: E731  (sum() corrects its rounding)
    return {q: sorted(((-score(one[q], v), i) for i, v in one.items() if i != q and len(v) == len(one[q])))[:k] for q in one if q % step == 0}


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((-r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


def test_forest_that_ascends_to_the_root_is_exact(spark):
    rows = vectors()
    got = prefix_forest.search(table(spark, rows), F.col("vec_id") % 2 == 0, k=10, trees=3, top=5, block=32, chunk=8, need={16: 10 ** 6, 3: 10 ** 6})
    want = brute_near(rows, 10, 2)
    assert found(got) == {q: w for q, w in want.items() if w}


@pytest.mark.parametrize("top, block", [(12, 4096), (2, 24)])
def test_forest_recall(spark, top, block):
    """Also where all prefixes are full at level ``top`` and queries count on in the sorted arrays."""
    rows = vectors(n=1500, hot=300)
    got, want = found(prefix_forest.search(table(spark, rows), F.col("vec_id") % 4 == 0, k=10, trees=8, top=top, block=block, chunk=16)), brute_near(rows, 10, 4)
    assert set(got) == {q for q, w in want.items() if w}
    assert all(len(got[q]) == len(w) for q, w in want.items() if w)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in w}) for q, w in want.items() if w)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_forest_scores_and_few_rows(spark):
    rows = [(0, [1e200, 1.0], 0), (1, [1e200, -1.0], 0), (2, [0.1, 0.2], 0), (20, [0.3, 0.4], 0), (40, [1.0, 1.0, 1.0], 0)]
    got = found(prefix_forest.search(table(spark, rows), F.col("vec_id") % 20 == 0))
    assert got == {q: w for q, w in brute_near(rows, 20, 20).items() if w} and 40 not in got
    assert prefix_forest.search(table(spark, rows).limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_forest_recall_on_the_given_vectors(spark):
    rows = [(r.vec_id, r.embedding, 0) for r in load(spark, SF, "embeddings").collect()]
    got, want = found(queries.op13_prefix_forest(spark, SF)), brute_near(rows, 20, 20)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in w}) for q, w in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))
    exact = {(q, i): s for q, w in brute_near(rows, len(rows), 20).items() for s, i in w}
    assert all(exact[q, i] == s for q, w in got.items() for s, i in w)


# -- Merkle manifest ----------------------------------------------------------------
def brute_manifest(rows, arity=3):
    own = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha("".join(own(v) for v in (*r[:4], text)))

    def levels(digests):
        out = [digests]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][j:j + arity])) for j in range(0, len(out[-1]), arity)])
        return out

    def path(tree, i):
        for row in tree[:-1]:
            j = i // arity * arity
            yield row[j:i], row[i + 1:j + arity]
            i //= arity

    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda n: (n is not None, (n or "").encode()))
    ordered = {n: sorted(groups[n], key=lambda r: (r[0] is None, r[0] or 0, leaf(r, r[4]))) for n in names}
    trees = {n: levels([leaf(r, r[4]) for r in ordered[n]]) for n in names}
    top = levels([trees[n][-1][0] for n in names]) if names else [[None]]
    out = []
    for g, n in enumerate(names):
        for i, r in enumerate(ordered[n]):
            way, text = [*path(trees[n], i), *path(top, g)], r[4]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded = leaf(r, text)
            for left, right in way:
                folded = sha("".join([*left, folded, *right]))
            out.append((r[0], trees[n][0][i], trees[n][-1][0], top[-1][0], sha("".join(d for a, b in way for d in a + b)), folded, folded == top[-1][0]))
    return out


MERKLE_COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def documents(df):
    return [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in df.collect()]


def test_manifest(spark):
    docs = frame(spark, corpus())
    got = merkle.document_manifest(docs)
    want = brute_manifest(documents(docs))
    assert result(got, *MERKLE_COLUMNS) == by_nulls(want)
    assert {r[-1] for r in want} == {True, False}
    assert merkle.document_manifest(docs.limit(0)).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 4, 27, 28, 83, 250])
def test_manifest_of_n_rows(spark, n):
    """One hot source of many levels, rows repeated in full, and small sources."""
    docs = spark.range(n).select((F.col("id") % 200).alias("doc_id"), F.lit("t\n").alias("text"), F.lit(None).cast("string").alias("lang"),
                                 F.when(F.col("id") % 50 == 49, F.col("id").cast("string")).otherwise("hot").alias("source"), F.lit(2).alias("n_chars"))
    assert result(merkle.document_manifest(docs), *MERKLE_COLUMNS) == by_nulls(brute_manifest(documents(docs)))


@pytest.mark.parametrize("arity, span", [(2, 3), (3, 1), (5, 2)])
def test_requests_for_some_leaves(spark, arity, span):
    docs = spark.range(90).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 4 > 0, F.col("id") % 4).cast("string").alias("source"))
    m = merkle.manifest(docs, merkle.row_digest(F.col("doc_id"), F.col("text")), "source", "doc_id", arity=arity, span=span)
    every = {r.id: r for r in merkle.prove(m, arity=arity).collect()}
    some = merkle.prove(m, m.leaves.where("id % 7 = 0"), arity=arity).collect()
    assert sorted(r.id for r in some) == list(range(0, 90, 7))
    assert all(r.path == every[r.id].path and r.subroot == every[r.id].subroot for r in some)
    for r in some:
        own = r.leaf
        for step in r.path:
            own = hashlib.sha256((step.l + own + step.r).encode()).hexdigest()
        assert own == r.root == m.root
    # records hold every inner node once, and only digests that are some record's child or root
    records = m.records.unionByName(m.top_records).collect()
    assert len({r.digest for r in records}) == len(records) and all(sha("".join(r.children)) == r.digest for r in records)
