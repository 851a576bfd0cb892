"""Connected components by contraction, and links inside hash buckets without all pairs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visloom.llm.common import Scratch

STAR_ROUNDS = 6
CELL_BYTES = 8 << 20  # sets one side of a cell holds on average


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b): the smallest node reachable.

    Each round every node moves to its smallest neighbour (or stays, if it is smaller than
    all), and the edges move with it; loops and repeats fall away. A component's nodes
    other than local minima leave in each round, so at least half go, and the number of rounds is
    logarithmic. Neighbour minima combine before the shuffle, so a hub costs no
    single task. Labels and edges are written once per round; no list reaches the driver.
    """
    edges = scratch.put(edges.where("a <> b").select("a", "b"), f"{name}-edges0")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = scratch.put(nodes.select("node", F.col("node").alias("component")), f"{name}-labels0")
    step = 0
    while not edges.isEmpty():
        step += 1
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        moves = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
        moves = scratch.put(moves.select("node", F.least("node", "low").alias("to")), f"{name}-moves{step}")
        labels_now = labels.join(moves.select(F.col("node").alias("component"), "to"), "component", "left")
        new_labels = scratch.put(
            labels_now.select("node", F.coalesce("to", "component").alias("component")), f"{name}-labels{step}"
        )
        moved = (
            edges.join(moves.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a")
            .join(moves.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
            .where("ta <> tb")
            .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
            .distinct()
        )
        new_edges = scratch.put(moved, f"{name}-edges{step}")
        scratch.drop(f"{name}-moves{step}", f"{name}-labels{step - 1}", f"{name}-edges{step - 1}")
        labels, edges = new_labels, new_edges
    return labels


def confirmer(sets: DataFrame, percent: int, scratch: Scratch) -> Callable[[DataFrame, str], DataFrame]:
    """A function that writes those of its pairs (a, b) with 100 · |A ∩ B| ≥ percent · |A ∪ B| under a name.

    A and B are the full sets (node, shingles). Pairs are dealt into a grid of cells by hashes of a and b, and a set goes once into each
    cell that asks for it, not once per pair: a crowd of pairs among the same documents costs
    little more than its documents. Cells hold about 2 · CELL_BYTES of sets.
    Pairs with a ``key``, the bucket they meet in, are dealt by that instead: a set goes once to each of its buckets' cells, however many cells there are.
    """
    size = sets.agg(F.sum(8 * F.size("shingles"))).first()[0] or 0
    grid = max(1, -(-size // CELL_BYTES))

    def compare(asked: pa.Table, given: pa.Table) -> pa.Table:
        held: dict[int, list[np.ndarray]] = {}
        for node, shingles in zip(given.column("node").to_pylist(), given.column("shingles"), strict=True):
            held.setdefault(node, []).append(shingles.values.to_numpy())
        good = []
        for a, b in zip(asked.column("a").to_pylist(), asked.column("b").to_pylist(), strict=True):
            for x in held.get(a, []):  # rows that share an id are one document
                for y in held.get(b, []):
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * shared >= percent * (len(x) + len(y) - shared):
                        good.append((a, b))
        good = sorted(set(good))
        return pa.table({"a": pa.array([a for a, _ in good], pa.int64()), "b": pa.array([b for _, b in good], pa.int64())})

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        place = lambda c: F.pmod(F.xxhash64(c), F.lit(grid))
        one, other = (place("key"), F.lit(0).cast("bigint")) if "key" in pairs.columns else (place("a"), place("b"))
        celled = pairs.select(one.alias("ca"), other.alias("cb"), "a", "b")
        cell = [F.col("ca").alias("da"), F.col("cb").alias("db")]
        needs = celled.select(*cell, F.col("a").alias("node")).distinct()
        needs = needs.union(celled.select(*cell, F.col("b").alias("node")).distinct()).distinct()
        dealt = needs.join(sets.select("node", "shingles"), "node")
        cells = celled.groupBy("ca", "cb").cogroup(dealt.groupBy("da", "db"))
        return scratch.put(cells.applyInArrow(compare, "a long, b long"), name)

    return confirmed


def bucket_links(
    members: DataFrame,
    traits: DataFrame,
    plausible: Column,
    confirm: Callable[[DataFrame, str], DataFrame],
    scratch: Scratch,
    rounds: int = STAR_ROUNDS,
) -> DataFrame:
    """Confirmed links (a, b) that connect whatever pairs sharing a bucket can be connected.

    ``members`` (key, band, node) holds the buckets; ``traits`` one row per node, with ``bands``
    naming its bucket in each band. ``plausible`` is a cheap necessary condition on a pair's traits
    (suffixes _a and _b), ``confirm`` writes the pairs (a, b) that are truly linked under a name.

    A bucket of near copies would emit the square of its size. Instead, in each round
    every node is held against one head of its buckets, the one it meets most often, heads changing from round to
    round; linked nodes become one component, and a bucket inside one component needs nothing
    more. After ``rounds`` rounds, or one that links nothing, the nodes of different components that still share a bucket are
    compared in pairs, in the first band they share, so that no connection is lost.
    """
    columns = [c for c in traits.columns if c != "node"]
    as_a = traits.select(F.col("node").alias("a"), *[F.col(c).alias(f"{c}_a") for c in columns])
    as_b = traits.select(F.col("node").alias("b"), *[F.col(c).alias(f"{c}_b") for c in columns])
    links = None
    placed = traits.select("node", F.col("node").alias("comp"))
    last = False
    for turn in range(1, rounds + 2):
        last = last or turn > rounds
        here = members.join(placed, "node")
        heads = here.groupBy("key").agg(
            F.min_by(F.struct("node", "comp"), F.struct(F.xxhash64(F.lit(turn), "node"), F.col("node"))).alias("head"),
            F.min("comp").alias("low"),
            F.max("comp").alias("high"),
        )
        heads = scratch.put(heads.where("low < high").select("key", "head"), f"heads{turn}")
        if heads.isEmpty():
            break
        divided = here.join(heads, "key")
        if not last:
            asked = divided.where(F.col("comp") != F.col("head.comp"))
            # The head of most of a node's buckets is the likeliest to be linked; unrelated ones share a bucket or two.
            often = asked.groupBy(F.col("node").alias("a"), F.col("head.node").alias("head")).count()
            pairs = often.groupBy("a").agg(
                F.max_by("head", F.struct(F.col("count"), F.xxhash64(F.lit(turn), "head"))).alias("b")
            )
            pairs = pairs.join(as_a, "a").join(as_b, "b").where(plausible).select("a", "b")
        else:
            rest = divided.select("key", "band", "comp", F.col("node").alias("a")).join(as_a, "a")
            rest = scratch.put(rest, "rest")
            other = rest.select(
                F.col("key").alias("key_b"),
                F.col("comp").alias("comp_b"),
                F.col("a").alias("b"),
                *[F.col(f"{c}_a").alias(f"{c}_b") for c in columns],
            )
            shared = F.array_position(F.zip_with("bands_a", "bands_b", lambda x, y: x == y), F.lit(True))
            first = shared == F.col("band") + 1
            met = rest.join(other, (F.col("key") == F.col("key_b")) & (F.col("comp") < F.col("comp_b")) & plausible & first)
            pairs = met.select("a", "b").distinct()
        found = confirm(scratch.put(pairs, f"pairs{turn}"), f"found{turn}")
        scratch.drop(f"heads{turn}", f"pairs{turn}", *["rest"] * last)
        links = found if links is None else links.union(found)
        if last:
            break
        last = found.isEmpty()
        if not last:
            labels = components(links, scratch, f"turn{turn}")
            joined = traits.select("node").join(labels.withColumnRenamed("node", "known"), F.col("node") == F.col("known"), "left")
            placed = scratch.put(joined.select("node", F.coalesce("component", "node").alias("comp")), f"placed{turn}")
            scratch.drop(f"placed{turn - 1}")
    if links is None:
        return traits.select(F.col("node").alias("a"), F.col("node").alias("b")).where("false")
    return links
