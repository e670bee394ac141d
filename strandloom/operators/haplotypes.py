"""Haplotypes: sites at which templates differ, the base of each template there, and templates put into sets."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.sources.shared import spread, written

#: Edge scores are whole numbers of this unit, so sums of them don't depend on the order of addition.
UNIT = 1e-6
COUNTS = [f"c{code}" for code in range(5)]


def spaced_sites(sites: DataFrame) -> DataFrame:
    """Scores of candidate sites divided by what stands near them: each site weighs 3, 2, 1 at distance 0, 1, 2.

    ``sites`` has contig_id, pos and score; score / (weights / 3) comes back with it, so a site alone keeps its score.
    """
    weights = F.explode(F.array(*[F.struct(F.lit(off).alias("off"), F.lit(3 - abs(off)).alias("w")) for off in (-2, -1, 0, 1, 2)])).alias("near")
    cost = sites.select("contig_id", "pos", weights).groupBy("contig_id", (F.col("pos") + F.col("near.off")).alias("pos")).agg(F.sum("near.w").alias("cost"))
    return sites.join(cost, ["contig_id", "pos"]).withColumn("score", F.col("score") / (F.col("cost") / 3.0)).drop("cost")


def template_bases(bases: DataFrame, sites: DataFrame, least_quality: int) -> DataFrame:
    """One base of each template at each site: contig_id, pos, template, code, conf.

    Bases under ``least_quality`` and unknown ones don't count. The qualities of a template's reads are added up
    by base; the base that outweighs all others together stays, with what it has more than they, if that is ``least_quality``.
    """
    near = bases.filter((F.col("qual") >= least_quality) & (F.col("code") < 5)).join(sites.select("contig_id", "pos"), ["contig_id", "pos"])
    by_code = near.groupBy("contig_id", "pos", "template", "code").agg(F.sum("qual").alias("conf"))
    best = by_code.groupBy("contig_id", "pos", "template").agg(F.max_by("code", F.struct("conf", -F.col("code"))).alias("code"), (2 * F.max("conf") - F.sum("conf")).alias("conf"))
    return best.filter((F.col("conf") > 0) & (F.col("conf") >= least_quality))


class Graph:
    """Templates of one group as nodes, with an edge where two have a site in common.

    An edge scores 100 * (correlation of base counts - offset) * site score, summed over the shared sites. Its
    link adds, for edges not below 0, what the two nodes agree on about each common neighbour, and is
    multiplied by both nodes' weights.
    """

    def __init__(self, node, site, counts, scores, offset: float):
        self.size, self.offset, self.scores = int(node.max()) + 1, offset, scores
        self.rows = [dict() for _ in range(self.size)]
        for n, s, c in zip(node.tolist(), site.tolist(), counts.astype(float)):
            self.rows[n][s] = c
        self.edge = np.zeros((self.size, self.size), np.int64)
        self.joined = np.zeros((self.size, self.size), bool)
        self.leads = np.triu(np.ones((self.size, self.size), bool))
        signed, total = np.zeros(self.edge.shape), np.zeros(self.edge.shape)
        order = np.argsort(site, kind="stable")
        for of_site in np.split(order, np.flatnonzero(np.diff(site[order])) + 1):
            at, score, seen = np.ix_(node[of_site], node[of_site]), scores[site[of_site[0]]], counts[of_site] > 0
            gain, known = self._gains(counts[of_site].astype(float), counts[of_site].astype(float), score)
            self.edge[at] += gain
            self.joined[at] |= known
            same = (seen[:, None, :] & seen[None, :, :]).sum(2)
            pairs = seen.sum(1)[:, None] * seen.sum(1)[None, :]
            signed[at] += (2 * same - pairs) * score
            total[at] += pairs * score
        np.fill_diagonal(self.joined, False)
        self.edge[~self.joined] = 0
        purity = np.where(self.joined, ((np.abs(signed) + 500) / (total + 500)) ** 2, 1.0)
        degree = self.joined.sum(1)
        #: least edge purity of a node, times the mean over its edges and five more of 1
        self.purity = purity.min(1) * (np.where(self.joined, purity, 0).sum(1) + 5) / (degree + 5)

    def _gains(self, a, b, score):
        """Edge scores of rows of counts at one site, and where both rows say anything."""
        a, b = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True)
        norm = np.sqrt((a * a).sum(1)[:, None] * (b * b).sum(1)[None, :])
        known = norm > 0
        return np.where(known, np.rint(100 * (a @ b.T / np.where(known, norm, 1) - self.offset) * score / UNIT), 0).astype(np.int64), known

    def _edges_of(self, a: int, near: np.ndarray) -> np.ndarray:
        """Edge scores of one node with others; all the sites that it shares with any of them at once."""
        mine, of, sites, one, two = self.rows[a], [], [], [], []
        for i, x in enumerate(near.tolist()):
            other = self.rows[x]
            for s in mine.keys() & other.keys():
                of.append(i)
                sites.append(s)
                one.append(mine[s])
                two.append(other[s])
        total = np.zeros(len(near), np.int64)
        if of:
            p, q = (x - x.mean(1, keepdims=True) for x in (np.array(one), np.array(two)))
            norm = np.sqrt((p * p).sum(1) * (q * q).sum(1))
            known = norm > 0
            gain = np.rint(100 * ((p * q).sum(1) / np.where(known, norm, 1) - self.offset) * self.scores[sites] / UNIT)
            np.add.at(total, of, np.where(known, gain, 0).astype(np.int64))
        return total

    @staticmethod
    def _agreement(p, q):
        """|p + q| - |p - q|"""
        return np.abs(p[:, None] + q[None, :]) - np.abs(p[:, None] - q[None, :])

    def merge(self, weight, least: float, complete: bool = False, most_sets: int = 0):
        """Merges the best edge until none has a link over ``least`` (or, with ``most_sets``, until no more sets are left).

        Equal links (to 1e-6): the smaller numbers first. ``complete`` joins all nodes by edges of score 0 first. Returns
        for each node the one it went into; links are kept up to date only where a merge can change them.
        """
        into, live = np.arange(self.size), np.ones(self.size, bool)
        passes = [(least, False)] + ([(least, True)] if complete else []) + ([(-1e6, True)] if most_sets else [])
        for bound, filled in passes:
            if filled:
                fresh = live[:, None] & live[None, :] & ~self.joined
                np.fill_diagonal(fresh, False)
                self.leads = np.where(fresh, np.triu(np.ones_like(self.leads)), self.leads)
                self.joined |= fresh
            shared = np.zeros(self.edge.shape, np.int64)
            for x in np.flatnonzero(live):
                near = np.flatnonzero(self.joined[x])
                shared[np.ix_(near, near)] += self._agreement(self.edge[x, near], self.edge[x, near])
            link = self._links(shared, weight, slice(None))
            best = link.max(1)
            while live.sum() > (most_sets if bound == -1e6 else 1):
                a = int(best.argmax())
                if not best[a] > bound:
                    break
                b = int(link[a].argmax())
                if not self.leads[a, b]:
                    a, b = b, a
                self._merge_pair(a, b, shared)
                into[into == b], live[b] = a, False
                touched = np.flatnonzero(self.joined[a])
                touched = np.append(touched, a)
                link[b, :] = link[:, b] = -np.inf
                best[b] = -np.inf
                link[touched] = self._links(shared, weight, touched)
                best[touched] = link[touched].max(1)
        return into

    def _links(self, shared, weight, rows):
        edge, joined = self.edge[rows], self.joined[rows]
        score = edge * UNIT + np.where(edge >= 0, shared[rows], 0) * (UNIT / 100)
        return np.where(joined, np.round(score * (weight[rows, None] * weight[None, :]), 6), -np.inf)

    def _merge_pair(self, a: int, b: int, shared) -> None:
        near = np.flatnonzero(self.joined[a] | self.joined[b])
        for x in (a, b):
            of = np.flatnonzero(self.joined[x])
            shared[np.ix_(of, of)] -= self._agreement(self.edge[x, of], self.edge[x, of])
        for site, counts in self.rows[b].items():
            self.rows[a][site] = self.rows[a][site] + counts if site in self.rows[a] else counts
        only = np.flatnonzero(self.joined[b] & ~self.joined[a])
        self.leads[a, only], self.leads[only, a] = self.leads[b, only], self.leads[only, b]
        self.joined[a, near] = self.joined[near, a] = True
        self.joined[b, :] = self.joined[:, b] = False
        self.joined[a, a] = False
        self.edge[b, :] = self.edge[:, b] = 0
        near = near[(near != a) & (near != b)]
        self.edge[a, near] = self.edge[near, a] = self._edges_of(a, near)
        shared[np.ix_(near, near)] += self._agreement(self.edge[a, near], self.edge[a, near])
        # what a has in common with each neighbour, over all common neighbours
        shared[a, :] = shared[:, a] = 0
        p, q = self.edge[a, near], self.edge[np.ix_(near, near)]
        both = np.where(self.joined[np.ix_(near, near)], np.abs(p + q) - np.abs(p - q), 0).sum(1)
        shared[a, near] = shared[near, a] = both


def _graph(rows: pd.DataFrame, offset: float):
    nodes, node = np.unique(rows["node"].to_numpy(), return_inverse=True)
    places, site = np.unique(rows["pos"].to_numpy(), return_inverse=True)
    scores = np.zeros(len(places))
    scores[site] = rows["score"].to_numpy(float)
    return nodes, node, Graph(node, site, rows[COUNTS].to_numpy(), scores, offset)


def _cells(sites: DataFrame, template_bases: DataFrame, weights: DataFrame | None) -> DataFrame:
    """Counts of bases by node and site, with the site's score and the node's weight."""
    counts = [F.count(F.when(F.col("code") == code, 1)).alias(name) for code, name in enumerate(COUNTS)]
    cells = template_bases.join(sites.select("contig_id", "pos", F.col("score").cast("double").alias("score")), ["contig_id", "pos"]).groupBy("contig_id", F.col("template").alias("node"), "pos", "score").agg(*counts)
    if weights is None:
        return cells.withColumn("weight", F.lit(1.0))
    return cells.join(weights.select("contig_id", F.col("template").alias("node"), "weight"), ["contig_id", "node"], "left").fillna(1.0, ["weight"])


def _grouped(cells: DataFrame, width: int, most_nodes: int, turn: int) -> DataFrame:
    """Each node's ``tile`` and ``part``: all nodes of a contig in one group if they are ``most_nodes`` at most (``whole``).

    Else by the tile of ``width`` positions, moved by half in every second turn, that holds the first site; tiles with more nodes are dealt out.
    """
    nodes = cells.groupBy("contig_id", "node").agg(F.min("pos").alias("at"))
    tiled = nodes.withColumn("tile", F.floor((F.col("at") + (width // 2 if turn % 2 else 0)) / width))
    counts = tiled.groupBy("contig_id", "tile").agg(F.count("*").alias("n"))
    whole = counts.groupBy("contig_id").agg((F.sum("n") <= most_nodes).alias("whole"), F.max_by("tile", "tile").alias("last"))
    parts = counts.join(whole, "contig_id").select("contig_id", "tile", "whole", F.ceil(F.col("n") / most_nodes).alias("parts"))
    dealt = tiled.join(parts, ["contig_id", "tile"])
    return dealt.select(
        "contig_id", "node", "whole", F.when(F.col("whole"), 0).otherwise(F.col("tile")).alias("tile"),
        F.when(F.col("whole"), 0).otherwise(F.pmod(F.xxhash64("node", F.lit(turn)), F.col("parts"))).alias("part"),
    )


def chimera_scores(sites: DataFrame, template_bases: DataFrame) -> DataFrame:
    """How well each template's edges agree in themselves: contig_id, template, edges, chimera.

    An edge has ((|sum of signed site scores| + 500) / (sum + 500)) ** 2, a template the least of its edges times
    (their sum + 5) / (their number + 5). Pairs of templates meet at the sites they share; a template without any has 1.
    """
    cells = template_bases.join(sites.select("contig_id", "pos", "score"), ["contig_id", "pos"])
    left = cells.select("contig_id", "pos", "score", "template", "code")
    right = cells.select("contig_id", "pos", F.col("template").alias("other"), F.col("code").alias("other_code"))
    met = left.join(right, ["contig_id", "pos"]).filter("template <> other")
    edges = met.groupBy("contig_id", "template", "other").agg(F.sum(F.when(F.col("code") == F.col("other_code"), F.col("score")).otherwise(-F.col("score"))).alias("signed"), F.sum("score").alias("total"))
    purity = F.pow((F.abs("signed") + 500) / (F.col("total") + 500), F.lit(2.0))
    found = edges.groupBy("contig_id", "template").agg(F.count("*").alias("edges"), F.min(purity).alias("least"), F.sum(purity).alias("sum"))
    every = cells.select("contig_id", "template").distinct().join(found, ["contig_id", "template"], "left")
    return every.select("contig_id", "template", F.coalesce("edges", F.lit(0)).alias("edges"), F.coalesce(F.col("least") * (F.col("sum") + 5) / (F.col("edges") + 5), F.lit(1.0)).alias("chimera"))


def haplotype_sets(
    sites: DataFrame, template_bases: DataFrame, weights: DataFrame | None = None, least: float = 0.0, offset: float = 0.0,
    two_pass: bool = False, most_sets: int = 0, most_nodes: int = 1500, width: int = 4096,
) -> DataFrame:
    """Templates put into sets by repeated merging of the best edge: contig_id, template, set_id (the smallest template of the set).

    ``sites`` has contig_id, pos, score; ``template_bases`` contig_id, pos, template, code (0 to 4); ``weights``
    contig_id, template, weight (1 where missing). A task merges ``most_nodes`` nodes at most, so its matrices stay
    under 100 MB. A contig with more goes in rounds: tiles of its nodes are merged on their own, sets become
    nodes with summed counts, and tiles that no longer change get wider, until the contig fits one task or nothing
    merges at any width; its sets are then what the rounds give, not what one search over all would.
    ``two_pass`` and ``most_sets`` act in the last merge of contigs that fit one task.
    Templates without a base at any site are in no set; empty tables give none.
    """

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        nodes, node, graph = _graph(rows, offset)
        purity = graph.purity.copy()
        weight = np.ones(len(nodes))
        weight[node] = rows["weight"].to_numpy(float)
        if "purity" in rows:
            purity[node] = rows["purity"].to_numpy(float)
        whole = bool(rows["whole"].iloc[0])
        into = graph.merge(weight * purity, least, two_pass and whole, most_sets if whole else 0)
        return pd.DataFrame({"contig_id": rows["contig_id"].iloc[0], "node": nodes, "into": nodes[into], "purity": purity, "whole": whole})

    cells = written(_cells(sites, template_bases, weights), "haplotype-cells")
    members = cells.select("contig_id", F.col("node").alias("template"), "node").distinct()
    finished, turn, quiet = [], 0, 0
    shape = cells.select("contig_id", "node").schema
    schema = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in shape) + f", into {shape['node'].dataType.simpleString()}, purity double, whole boolean"
    while True:
        dealt = cells.join(_grouped(cells, width, most_nodes, turn), ["contig_id", "node"])
        moves = written(spread(dealt, "contig_id", "tile", "part").groupBy("contig_id", "tile", "part").applyInPandas(merged, schema), "haplotype-moves")
        placed = members.join(moves.select("contig_id", "node", "into", "whole"), ["contig_id", "node"])
        finished.append(placed.filter("whole").select("contig_id", "template", F.col("into").alias("node")))
        state = moves.filter("not whole").agg(F.count("*").alias("n"), F.count(F.when(F.col("node") != F.col("into"), 1)).alias("merged")).first()
        if state["n"] == 0:
            break
        members = written(placed.filter("not whole").select("contig_id", "template", F.col("into").alias("node")), "haplotype-members")
        # a round can also move nothing because of how nodes were dealt: both positions of the tiles count, then wider ones
        quiet = 0 if state["merged"] else quiet + 1
        if quiet and quiet % 2 == 0:
            width *= 4
        extent = cells.agg(F.max("pos")).first()[0]
        if quiet >= 2 and width > 4 * (extent + 1):
            finished.append(members)
            break
        kept = moves.filter("not whole")
        own = kept.filter("node = into").select("contig_id", F.col("node").alias("into"), "purity")
        weight_of = cells.select("contig_id", F.col("node").alias("into"), "weight").distinct()
        summed = cells.drop("weight", "purity").join(kept.select("contig_id", "node", "into"), ["contig_id", "node"]).groupBy("contig_id", "into", "pos", "score").agg(*[F.sum(c).alias(c) for c in COUNTS])
        cells = written(summed.join(weight_of, ["contig_id", "into"]).join(own, ["contig_id", "into"]).withColumnRenamed("into", "node"), "haplotype-cells")
        turn += 1
    sets = reduce(DataFrame.unionByName, finished)
    names = sets.groupBy("contig_id", "node").agg(F.min("template").alias("set_id"))
    return sets.join(names, ["contig_id", "node"]).select("contig_id", "template", "set_id")
