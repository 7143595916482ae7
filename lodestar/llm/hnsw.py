"""Approximate nearest neighbours: a navigable small-world graph per shard, shard results merged."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Vectors of a shard; the graph of a shard is built and searched in one task.
SHARD = 8192
#: Links of a node on the upper levels (twice as many on the lowest), and candidates for them.
LINKS, CANDIDATES = 16, 64
#: Width of the beam on the lowest level, and nodes expanded at once.
BEAM, STEP = 160, 8
#: Queries of a block, and blocks that one task searches a shard for.
BLOCK, BLOCKS = 256, 64


@dataclass
class Graph:
    """A graph in flat arrays; nodes are the distinct vectors of a shard.

    ids holds the row ids of all nodes, node after node and ascending within each; those of
    node i are ids[firsts[i]:firsts[i + 1]]. links[level] has one row of node numbers for
    each node of members[level], padded with -1.
    """

    vectors: np.ndarray
    ids: np.ndarray
    firsts: np.ndarray
    members: list[np.ndarray]
    links: list[np.ndarray]


def unit(vectors: np.ndarray) -> np.ndarray:
    # Scaled by the largest component first: squares of tiny or huge components would be lost.
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _candidates(units: np.ndarray, width: int) -> np.ndarray:
    """For each row the `width` nearest other rows, nearest first, from blocked products."""
    out = np.empty((len(units), width), dtype=np.int32)
    for at in range(0, len(units), 1024):
        near = units[at : at + 1024] @ units.T
        rows = np.arange(len(near))
        near[rows, at + rows] = -np.inf
        top = np.argpartition(-near, width - 1, axis=1)[:, :width]
        order = np.argsort(-np.take_along_axis(near, top, axis=1), axis=1, kind="stable")
        out[at : at + 1024] = np.take_along_axis(top, order, axis=1)
    return out


def _diverse(units: np.ndarray, found: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates those nearer to it than to any chosen before, then the nearest others; -1 pads."""
    n, width = found.shape
    out = np.full((n, most), -1, dtype=np.int32)
    for at in range(0, n, 256):
        near = found[at : at + 256]
        points = units[near]
        to_row = np.einsum("ncd,nd->nc", points, units[at : at + 256])
        between = points @ points.transpose(0, 2, 1)
        chosen = np.zeros(near.shape, dtype=bool)
        for c in range(width):
            closest = np.where(chosen, between[:, c], -np.inf).max(axis=1)
            chosen[:, c] = (to_row[:, c] > closest) & (chosen.sum(axis=1) < most)
        # Chosen ones first, each part in order of nearness.
        order = np.argsort(~chosen, axis=1, kind="stable")[:, :most]
        out[at : at + 256, : order.shape[1]] = np.take_along_axis(near, order, axis=1)
    return out


def _both_ways(links: np.ndarray, units: np.ndarray, most: int) -> np.ndarray:
    """links and their reverse, at most `most` of each row: its own first, then the nearest that link to it."""
    n = len(links)
    rows, columns = np.nonzero(links >= 0)
    a, b = links[rows, columns].astype(np.int64), rows
    nearness = np.einsum("ed,ed->e", units[a], units[b])
    order = np.lexsort((-nearness, a))
    a, b = a[order], b[order]
    rank = np.arange(len(a)) - np.searchsorted(a, a)
    out = np.full((n, most), -1, dtype=np.int32)
    half = min(links.shape[1], most)
    out[:, :half] = links[:, :half]
    fits = rank < most - half
    out[a[fits], half + rank[fits]] = b[fits]
    return out


def build(vectors: np.ndarray, ids: np.ndarray, seed: int = 0) -> Graph:
    """The graph of one shard; equal vectors share a node, equal (id, vector) pairs count once.

    Levels are drawn as usual: each holds about 1/LINKS of the one below. As a shard is
    bounded, the candidates for a node's links on a level are its exact nearest members of
    that level, from blocked products; links are then chosen for diversity and made to run
    both ways.
    """
    order = np.lexsort((ids, *vectors.T[::-1]))
    vectors, ids = vectors[order], ids[order]
    new = np.ones(len(ids), dtype=bool)
    new[1:] = (vectors[1:] != vectors[:-1]).any(axis=1)
    again = ~new
    again[1:] &= ids[1:] == ids[:-1]
    vectors, ids, new = vectors[~again], ids[~again], new[~again]
    firsts = np.append(np.nonzero(new)[0], len(ids))
    nodes = vectors[new]
    units = unit(nodes).astype(np.float32)
    drawn = -np.log(1 - np.random.default_rng(seed).random(len(nodes))) / log(LINKS)
    members, links = [], []
    for level in range(int(drawn.max(initial=0)) + 1):
        inside = np.nonzero(drawn >= level)[0].astype(np.int32)
        if level and len(inside) < 2:
            break
        own, most = units[inside], LINKS * (1 if level else 2)
        width = min(CANDIDATES, len(inside) - 1)
        if width < 1:
            table = np.full((len(inside), 1), -1, dtype=np.int32)
        else:
            table = _both_ways(_diverse(own, _candidates(own, width), min(LINKS, width)), own, most)
        members.append(inside)
        links.append(np.where(table >= 0, inside[table], -1).astype(np.int32))
    return Graph(nodes, ids, firsts, members, links)


def search(graph: Graph, queries: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """For each query (unit rows) the nodes of its final beam, nearest first; -1 pads."""
    units = unit(graph.vectors).astype(np.float32)
    queries = queries.astype(np.float32)
    n, rows = len(queries), np.arange(len(queries))
    # The top level is small: the nearest of its members is the entry.
    at = graph.members[-1][np.argmax(queries @ units[graph.members[-1]].T, axis=1)]
    for level in range(len(graph.links) - 2, 0, -1):
        place = np.full(len(units), -1, dtype=np.int32)
        place[graph.members[level]] = np.arange(len(graph.members[level]))
        near = np.einsum("nd,nd->n", queries, units[at])
        while True:
            around = graph.links[level][place[at]]
            nearness = np.where(around >= 0, np.einsum("nd,nld->nl", queries, units[around]), -np.inf)
            best = nearness.argmax(axis=1)
            better = nearness[rows, best] > near
            if not better.any():
                break
            at = np.where(better, around[rows, best], at)
            near = np.where(better, nearness[rows, best], near)
    width = min(beam, len(units))
    nodes = np.full((n, width), -1, dtype=np.int32)
    near = np.full((n, width), -np.inf, dtype=np.float32)
    open_ = np.zeros((n, width), dtype=bool)
    seen = np.zeros((n, len(units) + 1), dtype=bool)
    seen[:, -1] = True  # the padding of links
    nodes[:, 0], near[:, 0], open_[:, 0] = at, np.einsum("nd,nd->n", queries, units[at]), True
    seen[rows, at] = True
    while open_.any():
        pick = np.argsort(~open_, axis=1, kind="stable")[:, :STEP]  # beams are sorted: the nearest open nodes
        live = np.take_along_axis(open_, pick, axis=1)
        np.put_along_axis(open_, pick, False, axis=1)
        around = np.where(live[:, :, None], graph.links[0][np.take_along_axis(nodes, pick, axis=1)], -1).reshape(n, -1)
        around = np.sort(around, axis=1)
        fresh = ~seen[rows[:, None], around]
        fresh[:, 1:] &= around[:, 1:] != around[:, :-1]
        seen[rows[:, None], around] = True
        i, j = np.nonzero(fresh)
        nearness = np.full(around.shape, -np.inf, dtype=np.float32)
        nearness[i, j] = np.einsum("ed,ed->e", queries[i], units[around[i, j]])
        both, every = np.concatenate([near, nearness], axis=1), np.concatenate([nodes, around], axis=1)
        opened = np.concatenate([open_, fresh], axis=1)
        order = np.argsort(-both, axis=1, kind="stable")[:, :width]
        near, nodes, open_ = (np.take_along_axis(x, order, axis=1) for x in (both, every, opened))
    return np.where(np.isfinite(near), nodes, -1)


def nearest(graph: Graph, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vec_id, score) of the k nearest rows of a shard to each query, the query's own id left out.

    Scores are cosines in double precision on the original vectors; ties go to smaller ids.
    """
    q = unit(queries)
    found = search(graph, q)
    units = unit(graph.vectors)
    out_rows, out_ids, out_scores = [], [], []
    for i, nodes in enumerate(found):
        nodes = nodes[nodes >= 0]
        scores = units[nodes] @ q[i]
        ids, all_scores = [], []
        for node, score in zip(nodes.tolist(), scores.tolist()):
            own = graph.ids[graph.firsts[node] : graph.firsts[node + 1]][: k + 1]  # ascending: later ones come too late
            own = own[own != query_ids[i]]
            ids.append(own)
            all_scores.append(np.full(len(own), score))
        ids, all_scores = np.concatenate(ids), np.concatenate(all_scores)
        best = np.lexsort((ids, -all_scores))[:k]
        out_rows.append(np.full(len(best), i))
        out_ids.append(ids[best])
        out_scores.append(all_scores[best])
    if not out_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(out_rows), np.concatenate(out_ids), np.concatenate(out_scores)


_INDEX = "shard int, dim int, vectors binary, ids binary, firsts binary, levels array<struct<members: binary, links: binary>>"


def _pack(shard: int, g: Graph) -> pa.Table:
    levels = [{"members": m.astype("<i4").tobytes(), "links": x.astype("<i4").tobytes()} for m, x in zip(g.members, g.links)]
    level = pa.list_(pa.struct([("members", pa.binary()), ("links", pa.binary())]))
    return pa.table(
        {
            "shard": pa.array([shard], pa.int32()),
            "dim": pa.array([g.vectors.shape[1]], pa.int32()),
            "vectors": pa.array([g.vectors.astype("<f8").tobytes()], pa.binary()),
            "ids": pa.array([g.ids.astype("<i8").tobytes()], pa.binary()),
            "firsts": pa.array([g.firsts.astype("<i8").tobytes()], pa.binary()),
            "levels": pa.array([levels], level),
        }
    )


def _unpack(row: dict) -> Graph:
    members = [np.frombuffer(x["members"], dtype="<i4") for x in row["levels"]]
    links = [np.frombuffer(x["links"], dtype="<i4").reshape(len(m), -1) for x, m in zip(row["levels"], members)]
    vectors = np.frombuffer(row["vectors"], dtype="<f8").reshape(-1, row["dim"])
    return Graph(vectors, np.frombuffer(row["ids"], dtype="<i8"), np.frombuffer(row["firsts"], dtype="<i8"), members, links)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of the rows that take part.

    Vectors that are null, empty or zero, that hold a null or a non-finite component, or
    whose length is not the most frequent one (ties: the larger) are left out, as are rows
    without an id.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    v = v.filter(F.col("vec_id").isNotNull() & F.forall("embedding", fine) & F.exists("embedding", lambda x: x != 0))
    lengths = v.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    return v.filter(F.size("embedding") == (lengths[0]["dim"] if lengths else 0))


def build_index(vectors: DataFrame, shards: int) -> DataFrame:
    """One row of flat arrays for each shard of usable vectors."""

    def of_shard(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        return _pack(shard, build(_matrix(table["embedding"]), table["vec_id"].to_numpy(), shard))

    placed = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    return placed.groupBy("shard").applyInArrow(of_shard, _INDEX)


def search_index(index: DataFrame, shards: int, queries: DataFrame, n_queries: int, k: int) -> DataFrame:
    """(query_id, mark, vec_id, score): the k nearest of every shard to every query; mark is a hash of its vector.

    Queries go to all shards in blocks; a shard meets its blocks in groups of BLOCKS, so
    neither side of a task grows with the input.
    """
    n_blocks = max(1, ceil(n_queries / BLOCK))
    groups = ceil(n_blocks / BLOCKS)
    marked = queries.select("vec_id", "embedding", F.xxhash64("embedding").alias("mark")).distinct()
    blocks = marked.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).alias("block")).agg(
        F.collect_list(F.struct("vec_id", "mark", "embedding")).alias("queries")
    )
    blocks = blocks.withColumn("part", (F.col("block") % groups).cast("int"))
    sent = blocks.select("part", "queries", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    parts = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = {"query_id": pa.int64(), "mark": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}
        if not len(left) or not len(right):
            return pa.table({c: pa.array([], t) for c, t in empty.items()})
        graph, out = _unpack(left.to_pylist()[0]), {c: [] for c in empty}
        for row in right["queries"].combine_chunks():
            block = row.values
            ids, marks = block.field("vec_id").to_numpy(), block.field("mark").to_numpy()
            vectors = _matrix(pa.chunked_array([block.field("embedding")]))
            rows, found, scores = nearest(graph, ids, vectors, k)
            for c, values in zip(empty, (ids[rows], marks[rows], found, scores)):
                out[c].append(values)
        return pa.table({c: pa.array(np.concatenate(out[c]), t) for c, t in empty.items()})

    joined = parts.groupBy("shard", "part").cogroup(sent.groupBy("shard", "part"))
    return joined.applyInArrow(met, "query_id long, mark long, vec_id long, score double")


def neighbours(vectors: DataFrame, is_query: Column, k: int = 5, shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query by cosine, nearest first.

    Queries are the usable rows for which `is_query` (over vec_id) holds; candidates are all
    usable rows but those with the query's id (see usable()). Equal rows count once. Ties
    go to the smaller vec_id. With fewer candidates than k all are returned; an empty table
    gives no rows. Extra columns are ignored. Every row is indexed.
    """
    v = checkpointed(usable(vectors))
    n = v.count()
    queries = v.filter(is_query)
    shards = max(1, ceil(n / shard))
    found = search_index(build_index(v, shards), shards, queries, queries.count(), k)
    best = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
