"""Contigs put in order and turned by the read pairs between them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.sources.shared import spread, written


def signed_edges(pairs: DataFrame, ends: DataFrame, near: int) -> DataFrame:
    """Edges both ways between contigs with read pairs near their ends: contig_id, mate_id, n, side.

    ``side`` is -1, the mate lies left, if more of the contig's reads are complemented than are not, else 1. Reads count
    within ``near`` columns of an end of their contig.
    """
    e = ends.select("contig_id", "first_base", "last_base")
    both = pairs.filter("contig_id1 <> contig_id2")
    for n in (1, 2):
        own = e.select(F.col("contig_id").alias(f"contig_id{n}"), F.col("first_base").alias("f"), F.col("last_base").alias("l"))
        both = both.join(own, f"contig_id{n}").filter((F.col(f"start{n}") - F.col("f") <= near) | (F.col("l") - F.col(f"end{n}") <= near)).drop("f", "l")
    way = lambda a, b: F.struct(F.col(f"contig_id{a}").alias("contig_id"), F.col(f"contig_id{b}").alias("mate_id"), F.col(f"comp{a}").alias("comp"))
    rows = both.select(F.explode(F.array(way(1, 2), way(2, 1))).alias("x")).select("x.*")
    return rows.groupBy("contig_id", "mate_id").agg(F.count("*").alias("n"), F.when(F.count_if("comp") > F.count_if(~F.col("comp")), -1).otherwise(1).alias("side"))


def components(edges: DataFrame) -> DataFrame:
    """Connected parts of a graph given by edges both ways: contig_id, component (its smallest contig).

    Stars are made in turns: each node's larger neighbours go to its smallest one, then its smaller ones do,
    until nothing changes; rounds grow with the logarithm of the longest path, and no node's neighbours come together in a task.
    """
    now, seen = edges.select(F.col("contig_id").alias("u"), F.col("mate_id").alias("v")).filter("u > v").distinct(), None
    while True:
        ways = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = ways.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = written(small.filter("u > v").distinct(), "contig-stars")
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            roots = now.select(F.col("v").alias("contig_id"), F.col("v").alias("component")).distinct()
            return now.select(F.col("u").alias("contig_id"), F.col("v").alias("component")).unionByName(roots)
        seen = state


def ordered_paths(mates: dict) -> list[list[tuple]]:
    """Paths of (contig, direction) through one component; ``mates`` has for each contig (mate, pairs, side), by rising mate.

    From the smallest contig not yet placed, breadth first to the last one reached, and from there again: the way
    back is the path. Each other contig with mates on it gets the mean of their places, weighted by pairs, and is set between
    the two whose places enclose it; equal means by rising contig. What lies level with the path's start has no place
    between two contigs of it and waits for a later path. A contig whose right neighbour lies to its left is turned (-1).
    """
    rows = [(c, *x) for c in sorted(mates) for x in mates[c]]
    return paths_of(*(np.array(x) for x in zip(*rows, strict=True))) if rows else []


def paths_of(contig: np.ndarray, mate: np.ndarray, n: np.ndarray, side: np.ndarray) -> list[list[tuple]]:
    """``ordered_paths`` of edges both ways, sorted by contig and mate. The walks go on by a whole level at a time, as arrays."""
    ids = np.unique(contig)
    end, at = np.searchsorted(ids, mate), np.concatenate([np.searchsorted(contig, ids), [len(contig)]])
    seen, parent, mark = np.zeros(len(ids), np.int64), np.empty(len(ids), np.int64), np.empty(len(ids), np.int64)
    gone, walk, paths = np.iinfo(np.int64).max, 0, []  # ``seen`` has the last walk that came by, ``gone`` for placed contigs

    def edges_of(level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the edges of contigs, in their order, and of the contigs they come from."""
        size = at[level + 1] - at[level]
        return np.arange(size.sum()) + np.repeat(at[level] - np.cumsum(size) + size, size), np.repeat(level, size)

    def farthest(start: int) -> int:
        """The last one reached breadth first over contigs not yet placed; ``parent`` leads back."""
        level = np.array([start])
        seen[start], parent[start] = walk, -1
        while True:
            edges, source = edges_of(level)
            to = end[edges]
            new = seen[to] < walk
            to, source = to[new], source[new]
            if not len(to):
                return int(level[-1])
            count = np.arange(len(to))
            mark[to[::-1]] = count[::-1]  # the first that comes to a contig stays
            first = mark[to] == count
            level = to[first]
            parent[level], seen[level] = source[first], walk

    least = 0
    while least < len(ids):
        if seen[least] == gone:
            least += 1
            continue
        walk += 1
        far = farthest(least)
        walk += 1
        chain = [farthest(far)]  # from the right end to the left one, places 1, 2, ..
        while parent[chain[-1]] >= 0:
            chain.append(int(parent[chain[-1]]))
        place = {c: i for i, c in enumerate(chain, 1)}
        between: list = [[] for _ in chain]
        beside = np.unique(end[edges_of(np.array(chain))[0]])
        for c in beside[seen[beside] != gone].tolist():
            own = slice(at[c], at[c + 1])
            on_path = [(place[m], k) for m, k in zip(end[own].tolist(), n[own].tolist(), strict=True) if m in place]
            if c not in place and on_path:
                mean = sum(p * k for p, k in on_path) / sum(k for _, k in on_path)
                if int(mean) + 1 < len(chain):  # the first place over the mean isn't the left end's
                    between[int(mean)].append((mean, c))
        order = [chain[0]]
        for i in range(1, len(chain)):
            order += [c for _, c in sorted(between[i])] + [chain[i]]
        order.reverse()

        def side_of(a: int, b: int) -> int:
            """The side of b for a; 0 without an edge."""
            k = at[a] + np.searchsorted(end[at[a] : at[a + 1]], b)
            return int(side[k]) if k < at[a + 1] and end[k] == b else 0

        turned = [-1 if side_of(a, b) == -1 else 1 for a, b in zip(order, order[1:])]
        turned.append(-1 if len(order) > 1 and side_of(order[-1], order[-2]) == 1 else 1)
        paths.append(list(zip(ids[order].tolist(), turned)))
        seen[order] = gone
    return paths


def contig_order(edges: DataFrame) -> DataFrame:
    """Order and direction of contigs: component, path, place (both from 1), contig_id, direction (-1: complement it).

    ``edges`` as ``signed_edges`` gives them; contigs without an edge are in no path. A component's edges meet in one
    task: contigs and the contigs next to them, not reads. 24 bytes an edge, so a million edges take some 200 MB there.
    """
    parts = components(edges)
    kind = parts.schema["contig_id"].dataType.simpleString()

    def placed(rows: pd.DataFrame) -> pd.DataFrame:
        ranked = rows.sort_values(["contig_id", "mate_id"])
        found = [(p, i, c, d) for p, path in enumerate(paths_of(*(ranked[x].to_numpy() for x in ("contig_id", "mate_id", "n", "side"))), 1) for i, (c, d) in enumerate(path, 1)]
        return pd.DataFrame(found, columns=["path", "place", "contig_id", "direction"]).assign(component=rows["component"].iloc[0])

    dealt = spread(edges.join(parts, "contig_id").select("component", "contig_id", "mate_id", "n", "side"), "component")
    return dealt.groupBy("component").applyInPandas(placed, f"component {kind}, path int, place int, contig_id {kind}, direction int")
