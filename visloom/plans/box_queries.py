"""Queries over boxes, clicks and episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visloom.functions import boxes as bx
from visloom.functions.answers import action_args, action_name, action_number, blocks
from visloom.operators import detection, evaluation
from visloom.plans import fixtures as fx
from visloom.plans.registry import query
from visloom.plans.surprisal_queries import rounded
from visloom.sources.gui import normalize_grounding

MATCH = fx.MATCH_CTES


def _grounding(spark, sf) -> DataFrame:
    return normalize_grounding(fx.grounding_raw(spark, sf), keep=("sample_id",))


SQL_ORIGIN = "CASE event_id % 4 WHEN 0 THEN 'windows' WHEN 1 THEN 'mac' WHEN 2 THEN 'web' ELSE '' END"
SQL_TYPE = "CASE WHEN event_id % 2 = 0 THEN 'icon' ELSE 'text' END"


@query(
    "load_grounding",
    fx.with_ctes(
        fx.SQL_BOXES_TRUE,
        select=f"""SELECT event_id AS sample_id, x1, y1, x2, y2, concat(event_type, ' ', user_id) AS instruction,
  {SQL_ORIGIN} AS source, {SQL_TYPE} AS data_type FROM truth""",
    ),
)
def load_grounding(spark, sf):
    return _grounding(spark, sf).select("sample_id", "bbox_norm.*", "instruction", "source", "data_type")


@query(
    "bbox_pixels",
    fx.with_ctes(
        fx.SQL_BOXES_TRUE,
        select="""SELECT event_id AS sample_id, trunc(x1 * 960)::INT AS x1, trunc(y1 * 540)::INT AS y1,
  trunc(x2 * 960)::INT AS x2, trunc(y2 * 540)::INT AS y2 FROM truth""",
    ),
)
def bbox_pixels(spark, sf):
    pixels = bx.to_pixels(F.col("bbox_norm"), F.col("image.width"), F.col("image.height"))
    return _grounding(spark, sf).select("sample_id", pixels.alias("px")).select("sample_id", "px.*")


@query(
    "crop_rect",
    fx.with_ctes(
        fx.SQL_BOXES_TRUE,
        select="""SELECT event_id AS sample_id,
  greatest(0, floor((x1 - 0.05::DOUBLE) * 960))::INT AS "left", greatest(0, floor((y1 - 0.05::DOUBLE) * 540))::INT AS top,
  least(960, ceil((x2 + 0.05::DOUBLE) * 960))::INT AS "right", least(540, ceil((y2 + 0.05::DOUBLE) * 540))::INT AS bottom FROM truth""",
    ),
)
def crop_rect(spark, sf):
    rect = bx.crop_rect(F.col("bbox_norm"), F.col("image.width"), F.col("image.height"), 0.05)
    return _grounding(spark, sf).select("sample_id", rect.alias("r")).select("sample_id", "r.*")


@query(
    "coord_bins",
    fx.with_ctes(
        fx.SQL_BOXES_TRUE,
        select="""SELECT event_id AS sample_id, least(floor(x1 * 32), 31)::INT AS bx1, least(floor(y1 * 32), 31)::INT AS by1,
  least(floor(x2 * 32), 31)::INT AS bx2, least(floor(y2 * 32), 31)::INT AS by2 FROM truth""",
    ),
)
def coord_bins(spark, sf):
    box = F.col("bbox_norm")
    return _grounding(spark, sf).select(
        "sample_id", *[bx.coord_bin(box[c], 32).alias(f"b{c}") for c in ("x1", "y1", "x2", "y2")]
    )


@query(
    "action_parse",
    fx.with_ctes(
        fx.SQL_ACTIONS,
        select="""SELECT sample_id, CASE WHEN sample_id % 17 = 0 THEN '' ELSE 'click' END AS name,
  round(coalesce(x, -1), 6) AS x, round(coalesce(y, -1), 6) AS y, CASE WHEN x IS NULL THEN 0 ELSE 2 END AS n_args FROM actions""",
    ),
)
def action_parse(spark, sf):
    call = F.col("action")
    parsed = fx.actions(spark, sf).select(
        "sample_id", action_name(call).alias("name"), action_args(call).alias("args")
    )
    return parsed.select(
        "sample_id",
        F.coalesce("name", F.lit("")).alias("name"),
        F.round(F.coalesce(F.col("args")["x"], F.lit(-1.0)), 6).alias("x"),
        F.round(F.coalesce(F.col("args")["y"], F.lit(-1.0)), 6).alias("y"),
        F.size("args").alias("n_args"),
    )


@query(
    "tag_blocks",
    """SELECT conv_id AS key, turn, 'think' AS tag, idx::INT AS idx, block FROM (
  SELECT conv_id, turn, unnest(bs) AS block, unnest(range(len(bs))) AS idx FROM (
    SELECT conv_id, turn, regexp_extract_all(concat('<think>', text, '</think><code>click(x=0.5, y=0.25)</code><think>', role, '</think>'),
      '(?s)<think>(.*?)</think>', 1) AS bs FROM conversations WHERE role = 'assistant'))
UNION ALL
SELECT page_id, 0, 'title', idx::INT, block FROM (
  SELECT page_id, unnest(bs) AS block, unnest(range(len(bs))) AS idx FROM (
    SELECT page_id, regexp_extract_all(html, '(?s)<title>(.*?)</title>', 1) AS bs FROM pages))""",
)
def tag_blocks(spark, sf):
    turns = fx.table(spark, sf, "conversations").where(F.col("role") == "assistant")
    tagged = F.concat(
        F.lit("<think>"),
        F.col("text"),
        F.lit("</think><code>click(x=0.5, y=0.25)</code><think>"),
        F.col("role"),
        F.lit("</think>"),
    )
    thoughts = turns.select(
        F.col("conv_id").alias("key"),
        "turn",
        F.lit("think").alias("tag"),
        F.posexplode(blocks(tagged, "think")).alias("idx", "block"),
    )
    titles = fx.table(spark, sf, "pages").select(
        F.col("page_id").alias("key"),
        F.lit(0).cast("bigint").alias("turn"),
        F.lit("title").alias("tag"),
        F.posexplode(blocks(F.col("html"), "title")).alias("idx", "block"),
    )
    return thoughts.unionByName(titles)


@query(
    "click_hit_rate",
    fx.with_ctes(
        fx.SQL_BOXES_TRUE,
        fx.SQL_ACTIONS,
        select=f"""SELECT data_type, source, count(*) AS n, count(*) FILTER (WHERE hit) AS n_hit,
  round(avg(hit::INT::DOUBLE), 6) AS hit_rate FROM (
  SELECT {SQL_TYPE} AS data_type, {SQL_ORIGIN} AS source,
    coalesce(a.x BETWEEN t.x1 AND t.x2 AND a.y BETWEEN t.y1 AND t.y2, false) AS hit
  FROM truth t LEFT JOIN actions a ON a.sample_id = t.event_id) GROUP BY data_type, source""",
    ),
)
def click_hit_rate(spark, sf):
    call = F.col("action")
    clicks = fx.actions(spark, sf).select(
        "sample_id", action_number(call, "x").alias("x"), action_number(call, "y").alias("y")
    )
    return rounded(evaluation.hit_rate(evaluation.click_hits(clicks, _grounding(spark, sf)), ["data_type", "source"]))


@query(
    "box_iou",
    fx.with_ctes(
        fx.SQL_BOXES_TRUE,
        fx.SQL_BOXES_PRED,
        select=f"""SELECT p.box_id AS pred_id, t.box_id AS truth_id, round({fx.sql_iou('t', 'p')}, 6) AS iou
FROM pred p JOIN truth t ON t.box_id = p.event_id""",
    ),
)
def box_iou(spark, sf):
    """Overlap of every predicted box with the true box it was made from."""
    coords = ("x1", "y1", "x2", "y2")
    truth = fx.boxes_true(spark, sf).select(F.col("box_id").alias("truth_id"), F.struct(*coords).alias("t"))
    pred = fx.boxes_pred(spark, sf).select(
        F.col("box_id").alias("pred_id"), F.floor(F.col("box_id") / 2).alias("truth_id"), F.struct(*coords).alias("p")
    )
    return pred.join(truth, "truth_id").select(
        "pred_id", "truth_id", F.round(bx.iou(F.col("t"), F.col("p")), 6).alias("iou")
    )


@query(
    "box_match",
    fx.with_ctes(
        *MATCH, recursive=True, select="SELECT image_id, label, truth_id, pred_id, round(iou, 6) AS iou FROM matches"
    ),
)
def box_match(spark, sf):
    return rounded(detection.match_boxes(fx.boxes_pred(spark, sf), fx.boxes_true(spark, sf)))


def _scores(spark, sf) -> DataFrame:
    return detection.image_scores(fx.boxes_pred(spark, sf), fx.boxes_true(spark, sf), call_cost=0.05)


SQL_REWARD = "round(matched - duplicates * 0.5::DOUBLE - wrong * 0.5::DOUBLE - predicted * 0.05::DOUBLE, 6)"


@query(
    "episode_reward",
    fx.with_ctes(
        *MATCH,
        fx.SQL_SCORES,
        recursive=True,
        select=f"SELECT image_id, expected, predicted, matched, duplicates, wrong, {SQL_REWARD} AS reward FROM scores",
    ),
)
def episode_reward(spark, sf):
    return rounded(_scores(spark, sf))


@query(
    "box_precision_recall",
    fx.with_ctes(
        *MATCH,
        fx.SQL_SCORES,
        recursive=True,
        select="""SELECT sum(matched)::BIGINT AS matched, sum(predicted)::BIGINT AS predicted, sum(expected)::BIGINT AS expected,
  round(sum(matched) / sum(predicted)::DOUBLE, 6) AS precision, round(sum(matched) / sum(expected)::DOUBLE, 6) AS recall FROM scores""",
    ),
)
def box_precision_recall(spark, sf):
    return rounded(detection.precision_recall(_scores(spark, sf)))


@query(
    "episode_metrics",
    fx.with_ctes(
        *MATCH,
        fx.SQL_SCORES,
        recursive=True,
        select=f"""SELECT variant, count(*) AS episodes, round(avg({SQL_REWARD}), 6) AS avg_reward,
  round(avg(predicted), 6) AS avg_tool_calls, round(avg(predicted * 7 + 12), 6) AS avg_tokens,
  round(sum(matched) / sum(expected)::DOUBLE, 6) AS share_correct
FROM (SELECT *, CASE WHEN split_part(image_id, '-', 1)::INT % 2 = 0 THEN 'tools' ELSE 'baseline' END AS variant FROM scores)
GROUP BY variant""",
    ),
)
def episode_metrics(spark, sf):
    user = F.split("image_id", "-")[0].cast("int")
    episodes = _scores(spark, sf).select(
        "*",
        F.when(user % 2 == 0, "tools").otherwise("baseline").alias("variant"),
        F.col("predicted").alias("tool_calls"),
        (F.col("predicted") * 7 + 12).alias("total_tokens"),
    )
    return rounded(detection.episode_metrics(episodes, ["variant"]))


@query(
    "box_transcripts",
    fx.with_ctes(
        fx.SQL_BOXES_TRUE,
        select="""SELECT image_id, concat(string_agg(printf('<label_tool>%s %.4f %.4f %.4f %.4f</label_tool>', label, x1, y1, x2, y2),
  chr(10) ORDER BY box_id), chr(10), '<labeled_image>') AS transcript, count(*) AS n_boxes
FROM truth GROUP BY image_id""",
    ),
)
def box_transcripts(spark, sf):
    return detection.box_transcripts(fx.boxes_true(spark, sf))


@query(
    "curriculum",
    fx.with_ctes(
        fx.SQL_BOXES_TRUE,
        select="""SELECT image_id, n_objects,
  CASE WHEN n_objects <= 1 THEN 'simple' WHEN n_objects <= 3 THEN 'medium' ELSE 'cluttered' END AS level,
  row_number() OVER (ORDER BY n_objects, md5(concat('42:', image_id)), image_id) - 1 AS position
FROM (SELECT image_id, count(*) AS n_objects FROM truth GROUP BY image_id)""",
    ),
)
def curriculum(spark, sf):
    return detection.curriculum(fx.boxes_true(spark, sf))
