"""Similar spans: all windows of two sequences that agree in enough places, tile by tile."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.sources.shared import spread

from .kmers import met

#: Rows and columns of a tile; a task holds one comparison of a tile's bases at a time, 4 million cells of two bytes.
TILE = 2048
#: Probes that a stretch meets in one task, and letters of all probes up to which they are broadcast.
PROBES, MOST_BROADCAST = 64, 1 << 25


def _tiles(seqs: DataFrame, n: int, window: int, tile: int) -> DataFrame:
    """A sequence's stretches of ``tile`` window starts; both ends are padded by half a window, as windows may stand over them."""
    padded = F.concat(F.repeat(F.lit("-"), F.lit(window // 2)), F.upper("seq"), F.repeat(F.lit("-"), F.lit(window // 2)))
    last = F.floor((F.length("seq") - 1) / tile)
    part = F.explode(F.sequence(F.lit(0).cast("long"), last)).alias(f"tile{n}")
    cut = seqs.filter(F.length("seq") >= window).select(F.col("id").alias(f"id{n}"), padded.alias("padded"), part)
    return cut.select(f"id{n}", f"tile{n}", F.substring("padded", (F.col(f"tile{n}") * tile + 1).cast("int"), F.lit(tile + window - 1)).alias(f"text{n}"))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("ascii", "replace"), np.uint8)


def diagonal_sums(same: np.ndarray, window: int) -> np.ndarray:
    """Sums of ``window`` cells down each diagonal, from every cell that has so many below; powers of two are added up."""
    rows, columns = (n - window + 1 for n in same.shape)
    total, done, power, size = np.zeros((rows, columns), np.uint16), 0, same.astype(np.uint16), 1
    while True:
        if window & size:
            total += power[done : done + rows, done : done + columns]
            done += size
        if 2 * size > window:
            return total
        power = power[:-size, :-size] + power[size:, size:]
        size *= 2


def similar_spans(seqs: DataFrame, probes: DataFrame, pairs: DataFrame, window: int, least: int, skip_main: bool = False, tile: int = TILE) -> DataFrame:
    """Places of the pairs' sequences whose windows of ``window`` letters (odd) agree in ``least`` or more: id1, id2, pos1, pos2, score.

    ``seqs`` and ``probes`` have id and seq, ``pairs`` id1 and id2; every window of one meets every window of the
    other, in tiles of bounded size that are dealt out, so two long sequences are as many tasks as they have tiles.
    Places are 1-based starts of windows; a window may stand over an end by half its length (starts from 1 - window // 2),
    where nothing agrees. Letters other than A, C, G, T agree with none. Sequences shorter than a window and null
    ones have no spans. ``skip_main`` leaves the main diagonal out, for a sequence with itself.
    """
    if window % 2 == 0 or not 1 <= least <= window:
        raise ValueError("the window is odd, and the least score lies between 1 and its length")
    half = window // 2

    def compared(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                a, b = _codes(row.text1), _codes(row.text2)
                same = (a[:, None] == b[None, :]) & np.isin(a, _codes("ACGT"))[:, None]
                score = diagonal_sums(same, window)
                at = np.nonzero(score >= least)
                found = pd.DataFrame({"id1": row.id1, "id2": row.id2, "pos1": at[0] + row.tile1 * tile + 1 - half, "pos2": at[1] + row.tile2 * tile + 1 - half, "score": score[at].astype(np.int64)})
                if len(found):
                    yield found[found.pos1 != found.pos2] if skip_main else found

    # a stretch of a sequence goes to a task once for some probes; few enough probes are broadcast and meet it there
    own, found = _tiles(seqs, 1, window, tile), pairs.select("id1", "id2").distinct()
    other = _tiles(probes, 2, window, tile)
    if (other.agg(F.sum(F.length("text2"))).first()[0] or 0) <= MOST_BROADCAST:
        lists = found.groupBy("id1").agg(F.sort_array(F.collect_list("id2")).alias("all"))
        some = F.transform(F.sequence(F.lit(0), F.floor((F.size("all") - 1) / PROBES).cast("int")), lambda i: F.slice("all", i * PROBES + 1, F.lit(PROBES)))
        left = lists.select("id1", F.posexplode(some).alias("part", "ids")).join(own, "id1")
        both = spread(left, "id1", "tile1", "part").select("id1", "tile1", "text1", F.explode("ids").alias("id2")).join(F.broadcast(other), "id2")
    else:
        both = spread(found.join(own, "id1").join(other, "id2"), "id1", "id2", "tile1", "tile2")
    both = both.select("id1", "id2", "tile1", "tile2", "text1", "text2")
    schema = f"id1 {both.schema['id1'].dataType.simpleString()}, id2 {both.schema['id2'].dataType.simpleString()}, pos1 long, pos2 long, score long"
    return both.mapInPandas(compared, schema)


def sharing_pairs(words: DataFrame, other: DataFrame) -> DataFrame:
    """Pairs of sequences that share a word: id1, id2. Few enough words of the other side are broadcast, so those of ``words`` need no shuffle."""
    once = lambda df, n: df.select(F.col("id").alias(f"id{n}"), "word").distinct()
    return met(words.select(F.col("id").alias("id1"), "word"), once(other, 2)).select("id1", "id2").distinct()
