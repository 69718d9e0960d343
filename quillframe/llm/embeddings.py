"""Embedding near-duplicates: learned binary codes, multi-index Hamming tables, exact reranking.

A rotation of the principal axes is learned by iterative quantisation on a
bounded sample of ``SAMPLE`` vectors; every vector then gets a 64-bit code, the
signs of its rotated components.  The code is cut into ``TABLES`` substrings;
each is a key of its table, and so is every substring one bit away, so codes up
to two bits apart in any substring share a key (up to 11 of 64 bits apart, some
substring is).  Rows under one key are compared by differing bits, a pair only
under the first key that both share, and pairs within ``MAX_BITS`` are reranked
by the cosine of the original vectors in double precision.

Equal vectors are one node.  Crowded directions of the sample become balls:
what lies within half the linking angle of a ball's centre is linked to all of
its other members (triangle inequality), so its links are counted and not
listed; whatever lies within one and a half angles of a centre is compared with
the ball's members in blocks, and only sums leave the tasks.  So a group of
copies that holds a large share of all rows costs no pairs.  Which directions
are crowded, like the rotation, decides what the run costs, not which pairs
count as links.

Rows whose vector is null, zero, or holds null or non-finite components link
with nothing, nor do vectors of different lengths.  Repeated rows are linked to
each other.  Ids may be null or repeat: a component is named by its least id
that is not null (null if it has none), ``kept`` compares ids null-safely, so a
kept id's repeated rows are all kept.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import sized, written
from quillframe.llm.components import connected
from quillframe.llm.negatives import _by_length
from quillframe.session import ship_package

MIN_COSINE = 0.95
BITS = 64
#: Substrings of 16 bits; 3 of 21 bits suit more than some 50 million vectors.
TABLES = 4
#: 64 * angle / pi at the least cosine is 6.5 bits; 11 is nearly two deviations more.
MAX_BITS = 11
SAMPLE = 4096
ROUNDS = 30
#: Vectors of the sample around one direction that make it a ball.
CROWD = 16
#: Rows of one key that a task compares, and members of a ball that it holds.
BUCKET = 8192
BLOCK = 4096

_SLACK = 1e-9


def learned(sample: np.ndarray, seed: int = 7) -> np.ndarray:
    """Projection to ``BITS`` columns: principal axes of unit vectors, rotated towards the corners of the cube.

    The axes go through the origin, not the sample's mean: only then do two
    vectors' differing bits follow their angle, whatever cone the data fill.
    Columns beyond the vectors' length are random directions.
    """
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    size = min(dim, BITS)
    _, axes = np.linalg.eigh(sample.T @ sample if len(sample) else np.eye(dim))
    axes = axes[:, ::-1][:, :size]
    v = sample @ axes
    rotation = np.linalg.qr(rng.normal(size=(size, size)))[0]
    for _ in range(ROUNDS if len(sample) else 0):
        u, _, w = np.linalg.svd(np.where(v @ rotation >= 0, 1.0, -1.0).T @ v)
        rotation = (u @ w).T
    return np.concatenate([axes @ rotation, rng.normal(size=(dim, BITS - size))], axis=1)


def crowded(sample: np.ndarray, min_cosine: float, crowd: int) -> np.ndarray:
    """Centres of the sample's crowded directions, the most crowded first; rows are unit vectors."""
    half = math.sqrt((1 + min_cosine) / 2)
    near = np.concatenate([sample[i : i + 512] @ sample.T >= min_cosine for i in range(0, len(sample), 512)]) if len(sample) else np.zeros((0, 0), bool)
    open_, tried, centres = np.ones(len(sample), bool), np.zeros(len(sample), bool), []
    while len(sample):
        count = np.where(tried, 0, near[:, open_].sum(axis=1))
        at = int(count.argmax())
        if count[at] < crowd:
            break
        centre = sample[near[at] & open_].mean(axis=0)
        for _ in range(2):
            centre /= np.linalg.norm(centre)
            inside = (sample @ centre >= half) & open_
            if inside.sum() < crowd:
                break
            centre = sample[inside].mean(axis=0)
        tried[at] = True
        if inside.sum() >= crowd:
            centres.append(centre / np.linalg.norm(centre))
            open_ &= ~inside
    return np.array(centres).reshape(len(centres), sample.shape[1])


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows scaled to length one, which rows take part), for doubles of any size."""
    with np.errstate(all="ignore"):
        most = np.abs(x).max(axis=1, initial=0)
        fit = np.isfinite(x).all(axis=1) & (most > 0)
        x = x / np.where(fit, most, 1)[:, None]
        return x / np.sqrt((x * x).sum(axis=1))[:, None], fit


def codes(unit: np.ndarray, projection: np.ndarray) -> np.ndarray:
    signs = unit @ projection >= 0
    return np.packbits(signs, axis=1, bitorder="little").view("<u8").ravel().view(np.int64)


def _models(rows: DataFrame, sample: int, min_cosine: float, crowd: int) -> dict[int, tuple]:
    """Per vector length of a sample by hash: projection, centres."""
    taken = rows.where("x IS NOT NULL").orderBy(F.xxhash64("x", "vec_id")).limit(sample).select("x").toArrow().combine_chunks()
    found = {}
    for b in taken.to_batches():
        for _, x in _by_length(b.column(0)):
            unit, fit = _unit(x)
            if fit.any():
                found[x.shape[1]] = (learned(unit[fit]), crowded(unit[fit], min_cosine, crowd))
    return found


_CODED = "vec_id long, name long, check long, code long, ball int, near array<int>, x binary"


def _coded(rows: DataFrame, models: dict[int, tuple], min_cosine: float) -> DataFrame:
    """Written rows with node name, code, ball (-1: none) and the balls whose members may be linked to it.

    ``name`` and ``check`` are two 64-bit hashes of the vector; null names take no part.
    Balls of all lengths share one numbering.
    """
    angle = math.acos(min_cosine)
    half, reach = math.cos(angle / 2) + _SLACK, math.cos(min(1.5 * angle, math.pi)) - _SLACK
    first, base = {}, 0
    for dim, model in models.items():
        first[dim], base = base, base + len(model[1])
    shared = rows.sparkSession.sparkContext.broadcast((models, first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, start = shared.value
        for b in batches:
            n = b.num_rows
            name, check, code = (np.zeros(n, np.int64) for _ in range(3))
            ball, near, raw, valid = np.full(n, -1, np.int32), [[]] * n, [None] * n, np.zeros(n, bool)
            for at, x in _by_length(b.column(1)):
                unit, fit = _unit(x)
                at, x, unit = at[fit], np.ascontiguousarray(x[fit] + 0.0, dtype="<f8"), unit[fit]
                dim = x.shape[1]
                if not len(at):
                    continue
                if dim not in known:
                    known[dim], start[dim] = (learned(np.zeros((0, dim))), np.zeros((0, dim))), 0
                projection, centres = known[dim]
                valid[at], code[at] = True, codes(unit, projection)
                bytes_ = [r.tobytes() for r in x]
                name[at] = np.array([xxhash.xxh3_64_intdigest(r, 1) for r in bytes_], np.uint64).view(np.int64)
                check[at] = np.array([xxhash.xxh3_64_intdigest(r, 2) for r in bytes_], np.uint64).view(np.int64)
                for i, r in zip(at.tolist(), bytes_, strict=True):
                    raw[i] = r
                if len(centres):
                    cosine = unit @ centres.T
                    best = cosine.argmax(axis=1)
                    inside = cosine[np.arange(len(at)), best] >= half
                    ball[at[inside]] = start[dim] + best[inside]
                    own = np.where(inside, best, len(centres))
                    touched = (cosine >= reach) & (np.arange(len(centres))[None, :] < own[:, None])
                    for i in np.flatnonzero(touched.any(axis=1)):
                        near[at[i]] = (start[dim] + np.flatnonzero(touched[i])).tolist()
            cells = [b.column(0)] + [pa.array(v, mask=~valid) for v in (name, check, code)]
            cells += [pa.array(ball), pa.array(near, pa.list_(pa.int32())), pa.array(raw, pa.binary())]
            yield pa.RecordBatch.from_arrays(cells, ["vec_id", "name", "check", "code", "ball", "near", "x"])

    return written(rows.mapInArrow(run, _CODED), "embedding-codes")


# ------------------------------------------------------- multi-index tables


def _cut(tables: int) -> list[tuple[int, int]]:
    """(first bit, number of bits) of each substring."""
    edge = np.linspace(0, BITS, tables + 1).astype(int)
    return [(int(a), int(b - a)) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def table_keys(code: np.ndarray, tables: int = TABLES) -> tuple[np.ndarray, np.ndarray]:
    """(keys, row numbers): each substring of each uint64 code and its one-bit neighbours."""
    keys, owners = [], []
    for t, (at, n) in enumerate(_cut(tables)):
        sub = (code >> np.uint64(at)) & np.uint64((1 << n) - 1)
        flips = np.concatenate(([0], 1 << np.arange(n))).astype(np.uint64)
        keys.append(((np.uint64(t) << np.uint64(56)) | (sub[:, None] ^ flips)).ravel().view(np.int64))
        owners.append(np.repeat(np.arange(len(code)), n + 1))
    return np.concatenate(keys), np.concatenate(owners)


def first_key(a: np.ndarray, b: np.ndarray, tables: int = TABLES) -> np.ndarray:
    """The one key under which a pair of codes counts: the least they share in the first table where they meet; -1 if in none."""
    out = np.full(len(a), -1, np.int64)
    for t, (at, n) in reversed(list(enumerate(_cut(tables)))):
        mask = np.uint64((1 << n) - 1)
        x, y = (a >> np.uint64(at)) & mask, (b >> np.uint64(at)) & mask
        apart = x ^ y
        low = apart & (~apart + np.uint64(1))
        shared = np.where(np.bitwise_count(apart) == 2, np.minimum(x ^ low, y ^ low), np.minimum(x, y))
        key = ((np.uint64(t) << np.uint64(56)) | shared).view(np.int64)
        out = np.where(np.bitwise_count(apart) <= 2, key, out)
    return out


def _met(max_bits: int, tables: int, most: int | None):
    """Stream of rows sorted by ``deal`` -> pairs (a, b), or the rows of deals beyond ``most`` (key, code, name)."""
    names = ["a", "b", "code", "hot"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 6
        hot = None

        def rows(c: list, n: slice) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c[k][n]) for k in (1, 3, 2)] + [pa.array(np.full(len(c[0][n]), True))], names)

        def pairs(deal, key, code, name, own, diagonal) -> pa.RecordBatch:
            code = code.view(np.uint64)
            found, at, d = [], np.arange(len(deal)), 1
            while len(at := at[at + d < len(deal)]) and len(at := at[deal[at + d] == deal[at]]):
                to = at + d
                ok = (np.bitwise_count(code[at] ^ code[to]) <= max_bits) & (key[at] == key[to]) & ((diagonal[at] == 1) | (own[at] != own[to]))
                i, j = at[ok], to[ok]
                meant = first_key(code[i], code[j], tables) == key[i]
                found.append((name[i[meant]], name[j[meant]]))
                d += 1
            a, b = (np.concatenate([f[k] for f in found] or [name[:0]]) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.zeros(len(a), np.int64)), pa.array(np.full(len(a), False))], names)

        for batch in batches:
            held = [np.concatenate([h, batch.column(k).to_numpy(zero_copy_only=False)]) for k, h in enumerate(held)]
            if hot is not None:
                n = int(np.searchsorted(held[0], hot, "right"))
                yield rows(held, slice(0, n))
                held = [h[n:] for h in held]
            if not len(held[0]):
                continue
            hot = None
            n = int(np.searchsorted(held[0], held[0][-1], "left"))  # the last deal's rows may go on
            yield pairs(*(h[:n] for h in held))
            held = [h[n:] for h in held]
            if most and len(held[0]) > most:
                hot = held[0][-1]
                yield rows(held, slice(None))
                held = [h[:0] for h in held]
        yield pairs(*held)

    return run


def candidates(nodes: DataFrame, max_bits: int = MAX_BITS, tables: int = TABLES, bucket: int = BUCKET) -> DataFrame:
    """Written pairs (a, b) of ``nodes`` (name, code) that share a key and differ in at most ``max_bits`` bits, each once.

    Keys with more than ``bucket`` rows are cut into blocks by hash; a second
    pass compares every pair of blocks in a task of its own.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            name, code = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for at in range(0, len(name), 4096):
                key, owner = table_keys(code[at : at + 4096].view(np.uint64), tables)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(code[at + owner]), pa.array(name[at + owner])], ["key", "code", "name"])

    def met(rows: DataFrame, most: int | None) -> DataFrame:
        dealt = rows.select("deal", "key", "code", "name", "own", "diagonal").repartition("deal").sortWithinPartitions("deal")
        return dealt.mapInArrow(_met(max_bits, tables, most), "a long, b long, code long, hot boolean")

    keys = nodes.select("name", "code").mapInArrow(emit, "key long, code long, name long")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    first = written(met(keys.select(F.col("key").alias("deal"), "*", zero.alias("own"), one.alias("diagonal")), bucket), "embedding-pairs")
    hot = first.where("hot").select(F.col("a").alias("key"), "code", F.col("b").alias("name"))
    blocks = F.ceil(F.col("n") / bucket)
    cut = hot.join(hot.groupBy("key").agg(F.count("*").alias("n")), "key").withColumn("own", F.pmod(F.xxhash64("name"), blocks))
    cut = cut.withColumn("other", F.explode(F.sequence(zero, blocks - 1)))
    deal = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    second = met(cut.select(deal.alias("deal"), "key", "code", "name", "own", (F.col("own") == F.col("other")).cast("long").alias("diagonal")), None)
    return written(first.where("NOT hot").select("a", "b").unionByName(second.select("a", "b")), "embedding-candidates")


def _cosines(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Cosines of pairs of vectors in doubles, -2 where lengths differ."""
    out = np.full(len(a), -2.0)
    size = np.array([len(x) if len(x) == len(y) else -1 for x, y in zip(a, b, strict=True)])
    for n in np.unique(size[size > 0]):
        at = np.flatnonzero(size == n)
        u, v = (_unit(np.frombuffer(b"".join(s[i] for i in at), "<f8").reshape(len(at), -1))[0] for s in (a, b))
        out[at] = np.einsum("ij,ij->i", u, v)
    return out


def _reranked(pairs: DataFrame, vectors: DataFrame, min_cosine: float) -> DataFrame:
    """Written pairs (a, b) whose vectors reach the cosine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                fit = _cosines(part.column(2).to_pylist(), part.column(3).to_pylist()) >= min_cosine
                yield part.select([0, 1]).filter(pa.array(fit))

    one = vectors.select(F.col("name").alias("a"), F.col("x").alias("xa"))
    two = vectors.select(F.col("name").alias("b"), F.col("x").alias("xb"))
    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "xa", "xb")
    return written(joined.mapInArrow(run, "a long, b long"), "embedding-links")


# ---------------------------------------------------------------------- balls


def _around(members: DataFrame, fringe: DataFrame, min_cosine: float, block: int) -> DataFrame:
    """Written (name, links, ball, outside): what ball members and the vectors around a ball link with each other.

    Both sides (name, n, ball, x) are cut into blocks; a task compares one
    block of members with one block of what lies around, and returns sums.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side, n = (table.column(k).to_numpy() for k in ("outside", "n"))
        unit = _unit(np.frombuffer(b"".join(table.column("x").to_pylist()), "<f8").reshape(len(n), -1))[0]
        out, own = np.flatnonzero(side), np.flatnonzero(~side)
        hit = unit[out] @ unit[own].T >= min_cosine
        links = np.zeros(len(n), np.int64)
        links[out], links[own] = hit @ n[own], hit.T @ n[out]
        keep = links > 0
        return pa.table({"name": table.column("name").filter(pa.array(keep)), "links": pa.array(links[keep]), "ball": table.column("ball").filter(pa.array(keep)), "outside": pa.array(side[keep])})

    def number(side: DataFrame, label: str) -> DataFrame:
        return side.groupBy("ball").agg(F.ceil(F.count("*") / F.lit(float(block))).alias(label))

    blocks = F.broadcast(number(members, "j_n").join(number(fringe, "k_n"), "ball"))  # a row a ball
    zero = F.lit(0).cast("long")
    of = lambda col, n: F.pmod(F.xxhash64(col), F.col(n))
    every = lambda n: F.explode(F.sequence(zero, F.col(n) - 1))
    left = members.join(blocks, "ball").withColumn("j", of("name", "j_n")).withColumn("k", every("k_n")).withColumn("outside", F.lit(False))
    right = fringe.join(blocks, "ball").withColumn("k", of("name", "k_n")).withColumn("j", every("j_n")).withColumn("outside", F.lit(True))
    columns = ["ball", "j", "k", "name", "n", "x", "outside"]
    met = left.select(*columns).unionByName(right.select(*columns)).groupBy("ball", "j", "k")
    return written(met.applyInArrow(run, "name long, links long, ball int, outside boolean"), "embedding-around")


def deduplicated(
    vectors: DataFrame,
    id: str = "vec_id",
    vector: str = "embedding",
    min_cosine: float = MIN_COSINE,
    max_bits: int = MAX_BITS,
    tables: int = TABLES,
    sample: int = SAMPLE,
    crowd: int = CROWD,
    bucket: int = BUCKET,
    block: int = BLOCK,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per input row."""
    ship_package(vectors.sparkSession)
    rows = vectors.select(F.col(f"`{id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("x"))
    coded = _coded(rows, _models(rows, sample, min_cosine, crowd), min_cosine)
    live = coded.where("name IS NOT NULL")
    nodes = written(
        live.groupBy("name").agg(
            F.count("*").alias("n"), F.min("vec_id").alias("least"), F.min("code").alias("code"), F.min("ball").alias("ball"), F.min("check").alias("_lo"), F.max("check").alias("_hi")
        ),
        "embedding-nodes",
    )
    if not nodes.where("_lo <> _hi").isEmpty():
        raise RuntimeError("two different vectors have the same 64-bit name")

    pairs = candidates(nodes.where("ball < 0"), max_bits, tables, bucket)
    wanted = pairs.select(F.col("a").alias("name")).unionByName(pairs.select(F.col("b").alias("name"))).distinct()
    ends = written(live.select("name", "x").join(wanted, "name", "left_semi").dropDuplicates(["name"]), "embedding-ends")
    links = _reranked(pairs, ends, min_cosine)
    size = nodes.select("name", "n")
    degree = links.join(size.withColumnRenamed("name", "b"), "b").select(F.col("a").alias("name"), "n")
    degree = degree.unionByName(links.join(size.withColumnRenamed("name", "a"), "a").select(F.col("b").alias("name"), "n"))
    edges = links.select("a", "b")

    balls = written(nodes.where("ball >= 0").groupBy("ball").agg(F.sum("n").alias("all"), F.min("name").alias("hub")), "embedding-balls")
    if not balls.isEmpty():
        inside = nodes.where("ball >= 0").select("name", "n", "ball")
        starred = inside.join(F.broadcast(balls), "ball")  # a row a centre of the sample
        edges = edges.unionByName(starred.select(F.col("name").alias("a"), F.col("hub").alias("b")))
        degree = degree.unionByName(starred.select("name", (F.col("all") - F.col("n")).alias("n")))
        beside = live.where(F.size("near") > 0).dropDuplicates(["name"]).select("name", "x", F.explode("near").alias("ball")).join(size, "name")
        beside = written(beside.join(F.broadcast(balls.select("ball")), "ball", "left_semi"), "embedding-fringe")
        if not beside.isEmpty():
            body = live.where("ball >= 0").join(F.broadcast(beside.select("ball").distinct()), "ball", "left_semi").dropDuplicates(["name"])
            met = _around(body.select("name", "ball", "x").join(size, "name"), beside, min_cosine, block)
            degree = degree.unionByName(met.select("name", F.col("links").alias("n")))
            edges = edges.unionByName(met.where("outside").join(F.broadcast(balls), "ball").select(F.col("name").alias("a"), F.col("hub").alias("b")))

    roots = written(connected(edges), "embedding-roots")
    least = roots.join(nodes, roots["node"] == nodes["name"]).groupBy("root").agg(F.min("least").alias("component_id"))
    part = roots.join(least, "root").select(F.col("node").alias("name"), "component_id")
    linked = degree.groupBy("name").agg(F.sum("n").alias("others"))
    # only nodes that have links, or more rows than one
    some = nodes.join(linked, "name", "left").where("n > 1 OR others IS NOT NULL").join(part, "name", "left")
    some = written(some.select("name", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.when(F.col("component_id").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"), F.lit(True).alias("found")), "embedding-linked")
    out = coded.select("vec_id", "name").join(sized(some), "name", "left")
    component = F.when(F.col("found"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op13_embedding_dedup(vectors: DataFrame) -> DataFrame:
    return deduplicated(vectors)


#: Brute force over all pairs: what the codes must find (they miss a pair at the very threshold now and then).
OP13_SQL = """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.95),
r AS (SELECT a AS node, b AS other FROM l UNION SELECT r.node, l.b FROM r JOIN l ON r.other = l.a),
c AS (SELECT node, least(node, min(other)) AS component_id FROM r GROUP BY node),
n AS (SELECT a AS node, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON vec_id = n.node LEFT JOIN c ON vec_id = c.node
"""
