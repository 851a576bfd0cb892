"""Predicted boxes against true boxes: matching, rewards, precision and recall."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visloom.functions.boxes import iou
from visloom.operators.positions import random_positions, rerank
from visloom.session import materialized

GROUP = ["image_id", "label"]
COORDS = ["x1", "y1", "x2", "y2"]
PAIR = [*GROUP, "truth_id", "truth_n", "pred_id", "pred_n"]
RATIO = 4.0  # largest over smallest side of one level of the grid


def _distinct_boxes(boxes: DataFrame, name: str) -> DataFrame:
    """Equal boxes as one row: smallest id and number of copies. Copies have the same overlaps."""
    return boxes.groupBy(*GROUP, *COORDS).agg(
        F.min("box_id").alias(f"{name}_id"), F.count(F.lit(1)).alias(f"{name}_n")
    )


def _with_grid(truth: DataFrame, pred: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Give both sides grid keys such that every pair with IoU ≥ threshold shares exactly one.

    Along an axis, boxes with IoU ≥ t overlap by at least t times the longer side. So one side is at
    least t times the other, and the centres are at most half the sum of the sides less that
    overlap apart. Each axis has cells on levels of side lengths a factor RATIO apart. Along x a truth
    takes the one cell of its own centre and level, and a prediction all those a partner's can be;
    along y it is the other way round. So each side has about as many rows as one axis has
    choices (8 at most from threshold 0.5 on), not the product of both.
    """
    t = threshold
    share = max(1 - t, (1 - t) / (2 * t), 1e-3)  # farthest centre of a partner, in sides of the level's longest
    # A little slack for rounding; extra cells cost time, never results.
    slack = 1e-6
    wide, high = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    real = (wide > 0) & (high > 0)

    def level(side: Column) -> Column:
        return F.floor(F.log(side) / math.log(RATIO))

    def cell(at: Column, size: Column) -> Column:
        return F.floor(at / (F.pow(F.lit(RATIO), size + 1) * share))

    def reach(side: Column, at: Column) -> Column:
        """How far the centre of a partner on level ``at`` can be from one's own."""
        longest = F.pow(F.lit(RATIO), at + 1)
        # The partner's side that lets the centres be farthest apart.
        other = F.least(longest, side / t)
        if t >= 0.5:
            other = F.least(other, F.greatest(side, longest / RATIO, side * t))
        return (side + other) / 2 - F.greatest(side, other) * t + side * slack

    def own(boxes: DataFrame, centre: Column, side: Column, at: str, place: str) -> DataFrame:
        return boxes.withColumn(at, level(side)).withColumn(place, cell(centre, F.col(at)))

    def partners(boxes: DataFrame, centre: Column, side: Column, at: str, place: str) -> DataFrame:
        levels = F.sequence(level(side * t * (1 - slack)), level(side / t * (1 + slack)))
        placed = boxes.withColumn(at, F.explode(levels)).withColumn("__reach", reach(side, F.col(at)))
        first, last = (cell(edge, F.col(at)) for edge in (centre - F.col("__reach"), centre + F.col("__reach")))
        return placed.withColumn(place, F.explode(F.sequence(first, last))).drop("__reach")

    x = ((F.col("x1") + F.col("x2")) / 2, wide, "lw", "cx")
    y = ((F.col("y1") + F.col("y2")) / 2, high, "lh", "cy")
    return partners(own(truth.where(real), *x), *y), partners(own(pred.where(real), *y), *x)


def _overlaps(truth: DataFrame, pred: DataFrame, threshold: float) -> DataFrame:
    """(image_id, label, truth_id, truth_n, pred_id, pred_n, iou) of distinct boxes with enough overlap."""
    keyed_truth, keyed_pred = _with_grid(truth, pred, threshold)
    grid = [*GROUP, "lw", "lh", "cx", "cy"]

    def side(keyed: DataFrame, at: str, *columns: str) -> DataFrame:
        # One hash of the key is what is shuffled and sorted by; equal hashes are checked.
        return keyed.select(
            F.xxhash64(*grid).alias("__key"), F.struct(*grid).alias(f"__{at}_at"), *columns, F.struct(*COORDS).alias(at)
        )

    left = side(keyed_truth, "t", "truth_id", "truth_n")
    right = side(keyed_pred, "p", "pred_id", "pred_n")
    overlap = iou(F.col("t"), F.col("p"))
    met = left.join(right, "__key").where((overlap >= threshold) & (F.col("__t_at") == F.col("__p_at")))
    return met.select(*[F.col(f"__t_at.{c}").alias(c) for c in GROUP], *PAIR[len(GROUP) :], overlap.alias("iou"))


def _best(pairs: DataFrame, of: str, other: str) -> DataFrame:
    """For each ``of`` its pair with the largest IoU, then the smallest ``other``."""
    rest = [c for c in pairs.columns if c not in (*GROUP, of, other, "iou")]
    top = F.max(F.struct("iou", (-F.col(other)).alias("neg"), *rest)).alias("best")
    chosen = pairs.groupBy(*GROUP, of).agg(top)
    return chosen.select(*GROUP, of, (-F.col("best.neg")).alias(other), "best.iou", *[f"best.{c}" for c in rest])


def match_boxes(pred: DataFrame, true: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One-to-one matches (image_id, label, truth_id, pred_id, iou) of equal label.

    Every truth proposes to its best prediction, a prediction keeps its best truth, and a truth that is
    turned down proposes to its next one, until none can. Best is the largest IoU, then the box whose first
    copy has the smallest id, then the smallest id. Inputs hold box_id (an integer), image_id, label, x1, y1, x2, y2.
    """
    truths, preds = _prepared(pred, true, threshold)
    matches = settled_matches(materialized(_overlaps(truths, preds, threshold), "box-pairs"))
    single = (F.col("truth_n") == 1) & (F.col("pred_n") == 1)
    units = matches.where(~single).withColumn("__k", F.explode(F.sequence(F.lit(0), F.col("amount").cast("int") - 1)))
    copies = _copies({"truth": true, "pred": pred})
    for side in ("truth", "pred"):
        mine = copies.where(F.col("side") == side).select(
            F.col("first").alias(f"{side}_id"), F.col("number").alias("__number"), F.col("box_id").alias("__own")
        )
        units = units.withColumn("__number", F.col(f"{side}_from") + F.col("__k"))
        units = units.join(mine, [f"{side}_id", "__number"], "left").withColumn(
            f"{side}_id", F.coalesce("__own", f"{side}_id")
        )
        units = units.drop("__own", "__number")
    columns = [*GROUP, "truth_id", "pred_id", "iou"]
    return matches.where(single).select(*columns).unionByName(units.select(*columns))


def _copies(sides: dict[str, DataFrame]) -> DataFrame:
    """(side, first, box_id, number) of all boxes with copies: the first copy's id and the place among them."""
    box = ["side", *GROUP, *COORDS]
    boxes = None
    for side, rows in sides.items():
        rows = rows.select(F.lit(side).alias("side"), *GROUP, *COORDS, "box_id")
        boxes = rows if boxes is None else boxes.unionByName(rows)
    firsts = boxes.groupBy(*box).agg(F.min("box_id").alias("first"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    copies = materialized(boxes.join(firsts.drop("__n"), box).select("side", "first", "box_id"), "box-copies")
    return rerank(copies, "box_id", "number", partition=["side", "first"])


def settled_matches(pairs: DataFrame) -> DataFrame:
    """The matches of deferred acceptance among ``pairs`` of distinct boxes with copies.

    Returns the pairs with ``amount``, the number of copies matched, and ``truth_from`` and ``pred_from``, the
    numbers of the first ones (copies are used up in order of their ids).

    A truth and a prediction that are each other's best must be matched, whatever the others do, and so must
    their copies until one side has none left; that side then leaves with all its pairs. Both sides rank by
    the same IoU, so among the largest that remain those of smallest id are each other's best:
    every round settles something in each cluster of boxes, and the outcome is the only one in
    which no two boxes would rather have each other. Later rounds see only pairs with free copies.
    """
    pairs = pairs.withColumns({"truth_left": F.col("truth_n"), "pred_left": F.col("pred_n")})
    left = [*PAIR, "iou", "truth_left", "pred_left"]
    found, turn = None, 0
    while True:
        by_truth, by_pred = _best(pairs, "truth_id", "pred_id"), _best(pairs, "pred_id", "truth_id")
        mutual = by_truth.join(by_pred.select(*GROUP, "truth_id", "pred_id"), [*GROUP, "truth_id", "pred_id"])
        amount = F.least("truth_left", "pred_left")
        truths = mutual.select(*GROUP, "truth_id", F.col("pred_id").alias("__partner"), amount.alias("__truths"))
        preds = mutual.select(*GROUP, "pred_id", amount.alias("__preds"))
        state = pairs.join(truths, [*GROUP, "truth_id"], "left").join(preds, [*GROUP, "pred_id"], "left")
        truths_used, preds_used = (F.coalesce(c, F.lit(0)) for c in ("__truths", "__preds"))
        matched = F.coalesce(F.col("__partner") == F.col("pred_id"), F.lit(False))
        open_ = (F.col("truth_left") > truths_used) & (F.col("pred_left") > preds_used)
        state = state.select(
            *PAIR,
            "iou",
            (F.col("truth_n") - F.col("truth_left")).alias("truth_from"),
            (F.col("pred_n") - F.col("pred_left")).alias("pred_from"),
            F.when(matched, F.col("__truths")).alias("amount"),
            (F.col("truth_left") - truths_used).alias("truth_left"),
            (F.col("pred_left") - preds_used).alias("pred_left"),
            open_.alias("open"),
        )
        state = materialized(state.where(F.col("amount").isNotNull() | F.col("open")), f"box-matches{turn}")
        settled = state.where("amount IS NOT NULL").select(*PAIR, "iou", "truth_from", "pred_from", "amount")
        found = settled if found is None else found.union(settled)
        pairs = state.where("open").select(*left)
        if pairs.isEmpty():
            return found
        turn += 1


def _prepared(pred: DataFrame, true: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    return _distinct_boxes(true, "truth"), _distinct_boxes(pred, "pred")


def image_scores(
    pred: DataFrame,
    true: DataFrame,
    threshold: float = 0.5,
    duplicate_penalty: float = 0.5,
    wrong_penalty: float = 0.5,
    call_cost: float = 0.0,
) -> DataFrame:
    """Per image: truths, predictions, matches, duplicates, wrong boxes and the reward.

    +1 for each match; a further prediction that overlaps a truth of its label is a
    duplicate, any other is wrong. Copies are counted, never multiplied out. The
    overlapping pairs serve two aggregations and are written once.
    """
    truths, preds = (materialized(side, "boxes") for side in _prepared(pred, true, threshold))
    touched = materialized(_overlaps(truths, preds, threshold), "box-pairs")
    matches = settled_matches(touched)
    touching = touched.select("pred_id").distinct().withColumn("touches", F.lit(True))
    matched = matches.groupBy("image_id").agg(F.sum("amount").alias("matched"))
    per_image = (
        preds.join(touching, "pred_id", "left")
        .groupBy("image_id")
        .agg(
            F.sum("pred_n").alias("predicted"),
            F.coalesce(F.sum(F.when(F.col("touches"), F.col("pred_n"))), F.lit(0)).alias("touching"),
        )
    )
    expected = truths.groupBy("image_id").agg(F.sum("truth_n").alias("expected"))
    counts = (
        expected.join(per_image, "image_id", "full")
        .join(matched, "image_id", "left")
        .fillna(0, ["expected", "predicted", "touching", "matched"])
    )
    duplicates = F.col("touching") - F.col("matched")
    wrong = F.col("predicted") - F.col("touching")
    reward = (
        F.col("matched") - duplicates * duplicate_penalty - wrong * wrong_penalty - F.col("predicted") * call_cost
    )
    return counts.select(
        "image_id",
        "expected",
        "predicted",
        "matched",
        duplicates.alias("duplicates"),
        wrong.alias("wrong"),
        reward.cast("double").alias("reward"),
    )


def precision_recall(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Box precision and recall over image scores."""
    return scores.groupBy(*by).agg(
        F.sum("matched").alias("matched"),
        F.sum("predicted").alias("predicted"),
        F.sum("expected").alias("expected"),
    ).withColumns(
        {
            "precision": F.coalesce(F.try_divide(F.col("matched"), F.col("predicted")), F.lit(0.0)),
            "recall": F.coalesce(F.try_divide(F.col("matched"), F.col("expected")), F.lit(0.0)),
        }
    )


def episode_metrics(episodes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Average reward, tool calls and tokens per episode, and the share of objects labelled."""
    return episodes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("episodes"),
        F.avg("reward").alias("avg_reward"),
        F.avg("tool_calls").alias("avg_tool_calls"),
        F.avg("total_tokens").alias("avg_tokens"),
        F.coalesce(F.try_divide(F.sum("matched"), F.sum("expected")), F.lit(0.0)).alias("share_correct"),
    )


def box_transcripts(boxes: DataFrame) -> DataFrame:
    """Tool-call text naming the boxes of each image in order of their ids, one row per image.

    (image_id, transcript, n_boxes); the last line asks for the labelled image. A
    transcript is one training sequence, so an image's lines meet in its row.
    """
    line = F.format_string("<label_tool>%s %.4f %.4f %.4f %.4f</label_tool>", "label", *COORDS)
    ordered = F.array_sort(F.collect_list(F.struct("box_id", "line")))
    return boxes.select("image_id", "box_id", line.alias("line")).groupBy("image_id").agg(
        F.concat(
            F.array_join(F.transform(ordered, lambda e: e["line"]), "\n"), F.lit("\n<labeled_image>")
        ).alias("transcript"),
        F.count(F.lit(1)).alias("n_boxes"),
    )


def curriculum(boxes: DataFrame, few: int = 1, some: int = 3) -> DataFrame:
    """Images from few objects to many, with a level and a place in the order."""
    counted = boxes.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_objects"))
    level = F.when(F.col("n_objects") <= few, "simple").when(F.col("n_objects") <= some, "medium").otherwise("cluttered")
    return random_positions(counted.withColumn("level", level), "image_id", lead=["n_objects"])
