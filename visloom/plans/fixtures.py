"""Views of the given tables in the record shapes the operators expect.

Each view is a whole-table DataFrame expression; the SQL constant next to it is the
same view as common table expressions for the result check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from visloom.functions import chat
from visloom.functions.text import example_uid, fallback_uid, make_sample_id
from visloom.operators.positions import rerank
from visloom.operators.sft import with_rendering
from visloom.schemas import IMAGE
from visloom.sources.scan import scan_with_index

SPLIT = "dev"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def indexed(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    return scan_with_index(spark, f"{sf}/{name}.parquet", columns or None)


SQL_SPACE = r"[\s\x{0B}\p{Z}\x{1C}-\x{1F}\x{85}]"


def sql_strip(text: str) -> str:
    return f"regexp_replace({text}, '^{SQL_SPACE}+|{SQL_SPACE}+\\z', '', 'g')"


def sql_tokens(text: str) -> str:
    return (
        f"list_filter(regexp_split_to_array(coalesce({text}, ''), '[ \\t\\n\\r\\f\\x{{0B}}]+'), lambda t: t <> '')"
    )


def with_ctes(*ctes: str, select: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n" + select


# --- image pairs ------------------------------------------------------------


def _image(k: int) -> Column:
    doc = F.col("doc_id")
    name = F.concat(doc.cast("string"), F.lit(f"-{k}.png"))
    return F.struct(
        F.concat(F.lit("img/"), name).alias("path"),
        (640 + (doc * 37 + k * 101) % 640).cast("int").alias("width"),
        (360 + (doc * 53 + k * 29) % 360).cast("int").alias("height"),
        F.when(doc % 3 != 0, F.concat(F.lit("photo-"), name)).alias("filename"),
    ).cast(IMAGE)


def _pair_identity() -> list[Column]:
    """The raw uid, identifier, id and sentence, none of which needs the labels."""
    doc = F.col("doc_id")
    key = doc.cast("string")
    return [
        F.when(doc % 5 == 1, "").when(doc % 5 != 0, F.concat(F.lit("dev-"), key, F.lit("-0-0"))).alias("uid"),
        F.when(doc % 5 == 1, F.concat(F.lit("doc-"), key)).alias("identifier"),
        F.when(doc % 10 == 5, F.concat(F.lit("id-"), key)).alias("id"),
        F.concat(F.lit("  "), F.col("text"), F.lit("\n")).alias("sentence"),
    ]


def pairs_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as raw pair records; one in thirteen lacks an image, some labels are bad."""
    docs = indexed(spark, sf, "documents", "doc_id", "text")
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    doc = F.col("doc_id")
    label = (
        F.when(F.col("quality") == 1, " TRUE ")
        .when(F.col("quality") == 0, "False")
        .when(doc % 10 == 3, "maybe")
        .when(doc % 10 != 7, "false")
    )
    return pair_records(docs.join(labels, "doc_id", "left"), label, "index")


def pair_records(docs: DataFrame, label: Column, *keep: str) -> DataFrame:
    doc = F.col("doc_id")
    second = F.when(doc % 13 != 0, _image(1))
    return docs.select(
        "doc_id",
        *keep,
        *_pair_identity(),
        label.alias("label"),
        F.when(doc % 2 == 0, F.struct(_image(0).alias("left"), second.alias("right"))).alias("image"),
        F.when(doc % 2 != 0, _image(0)).alias("image0"),
        F.when(doc % 2 != 0, second).alias("image1"),
    )


def pair_keys(spark: SparkSession, sf: str) -> DataFrame:
    """(index, uid) of every raw pair record."""
    uid = F.coalesce(
        example_uid(F.col("uid"), F.col("identifier"), F.col("id")), fallback_uid(F.lit(SPLIT), F.col("sentence"))
    )
    docs = indexed(spark, sf, "documents", "doc_id", "text").select("index", *_pair_identity())
    return docs.select("index", uid.alias("uid"))


_W0, _H0 = "(640 + (d.doc_id * 37) % 640)::INT", "(360 + (d.doc_id * 53) % 360)::INT"
_W1, _H1 = "(640 + (d.doc_id * 37 + 101) % 640)::INT", "(360 + (d.doc_id * 53 + 29) % 360)::INT"

SQL_RAW = f"""raw AS (
  SELECT d.doc_id, row_number() OVER (ORDER BY d.doc_id) - 1 AS idx,
    CASE WHEN d.doc_id % 5 = 1 THEN '' WHEN d.doc_id % 5 <> 0 THEN concat('dev-', d.doc_id, '-0-0') END AS raw_uid,
    CASE WHEN d.doc_id % 5 = 1 THEN concat('doc-', d.doc_id) END AS identifier,
    CASE WHEN d.doc_id % 10 = 5 THEN concat('id-', d.doc_id) END AS id,
    concat('  ', d.text, chr(10)) AS sentence,
    CASE WHEN l.quality = 1 THEN ' TRUE ' WHEN l.quality = 0 THEN 'False'
         WHEN d.doc_id % 10 = 3 THEN 'maybe' WHEN d.doc_id % 10 <> 7 THEN 'false' END AS label,
    d.doc_id % 2 = 0 AS two_part, d.doc_id % 13 = 0 AS missing,
    {_W0} AS w0, {_H0} AS h0, {_W1} AS w1, {_H1} AS h1,
    CASE WHEN d.doc_id % 3 <> 0 THEN concat('photo-', d.doc_id, '-0.png') END AS f0,
    CASE WHEN d.doc_id % 3 <> 0 THEN concat('photo-', d.doc_id, '-1.png') END AS f1
  FROM documents d LEFT JOIN labels l USING (doc_id))"""

SQL_KEYED = """keyed AS (
  SELECT *, coalesce(nullif(raw_uid, ''), nullif(identifier, ''), id,
                     concat('dev-', substr(md5(sentence), 1, 8))) AS uid,
    CASE WHEN missing THEN 'missing image' WHEN label IS NULL THEN 'unsupported label type'
         WHEN lower(trim(label)) NOT IN ('true', 'false') THEN 'unexpected label' END AS reason
  FROM raw)"""

SQL_PAIRS = f"""pairs AS (
  SELECT *, {sql_strip('sentence')} AS clean,
    CASE lower(trim(label)) WHEN 'true' THEN 'True' ELSE 'False' END AS label_text,
    CASE WHEN two_part THEN 'left' ELSE 'image0' END AS slot0,
    CASE WHEN two_part THEN 'right' ELSE 'image1' END AS slot1
  FROM keyed WHERE reason IS NULL)"""

PAIRS_CTES = (SQL_RAW, SQL_KEYED, SQL_PAIRS)

# --- GUI actions ------------------------------------------------------------


# Turns of one conversation that one task looks at together; their texts are not among them.
TURN_CHUNK = 1024


def _exchanges(spark: SparkSession, sf: str) -> DataFrame:
    """One row per assistant turn with the latest earlier user turn and its conversation's system text.

    Which user turn belongs to an answer is worked out on (conv_id, turn, role) in chunks of
    turns; one row per chunk carries what earlier chunks and the system turn have to say.
    Texts meet on (conv_id, turn), so a conversation of any length is spread over tasks.
    """
    turns = table(spark, sf, "conversations")
    asked = F.when(F.col("role") == "user", F.col("turn"))
    keyed = turns.select("conv_id", "turn", "role", F.floor(F.col("turn") / TURN_CHUNK).alias("chunk"))
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = keyed.groupBy("conv_id", "chunk").agg(F.max(asked).alias("last"))
    chunks = chunks.select("conv_id", "chunk", F.max("last").over(earlier).alias("before"))
    system = turns.where(F.col("role") == "system").groupBy("conv_id").agg(F.min_by("text", "turn").alias("system"))
    inside = Window.partitionBy("conv_id", "chunk").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        keyed.withColumn("here", F.max(asked).over(inside))
        .where(F.col("role") == "assistant")
        .join(chunks.join(system, "conv_id", "left"), ["conv_id", "chunk"])
        .select("conv_id", "turn", F.coalesce("here", "before").alias("user_turn"), "system")
    )

    def said(role: str, turn: str) -> DataFrame:
        rows = turns.where(F.col("role") == role)
        return rows.groupBy("conv_id", F.col("turn").alias(turn)).agg(F.max("text").alias(role))

    answered = placed.join(said("assistant", "turn"), ["conv_id", "turn"])
    return answered.join(said("user", "user_turn"), ["conv_id", "user_turn"], "left").drop("user_turn")


def _coordinates() -> list[Column]:
    conv = F.col("conv_id")
    config = (
        F.when(conv % 5 == 0, "webui350k")
        .when(conv % 5 == 1, "seeclick")
        .when(conv % 5 == 2, "mind2web-l1")
        .when(conv % 5 == 3, "coat")
        .otherwise("aitw-l2")
    )
    return [
        F.when(conv % 5 < 2, "stage1").otherwise("stage2").alias("dataset"),
        config.alias("config"),
        F.when(conv % 4 == 0, "validation").otherwise("train").alias("split"),
    ]


def gui_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as raw GUI records."""
    conv = F.col("conv_id")
    image = F.struct(
        F.concat(F.lit("shot/"), conv.cast("string"), F.lit(".png")).alias("path"),
        (1280 + (conv * 37) % 640).cast("int").alias("width"),
        (720 + (conv * 53) % 360).cast("int").alias("height"),
        F.lit(None).cast("string").alias("filename"),
    ).cast(IMAGE)
    return _exchanges(spark, sf).select(
        "conv_id",
        "turn",
        F.array(image).alias("images"),
        F.array(F.struct("system", "user", "assistant")).alias("texts"),
        F.when(conv % 3 != 0, F.concat(F.lit("web"), (conv % 7).cast("string"))).alias("source"),
        *_coordinates(),
    )


def gui(spark: SparkSession, sf: str) -> DataFrame:
    """Normalised GUI records of both stages with coordinates, position and sample id.

    Positions are worked out on three narrow columns and joined on (conv_id, turn), the
    keys the texts are already partitioned by, so the texts are shuffled only once.
    """
    raw = gui_raw(spark, sf)
    first = F.get("texts", 0)
    records = raw.select(
        "conv_id",
        "turn",
        "dataset",
        "config",
        "split",
        F.coalesce("source", "config").alias("source"),
        F.get("images", 0).alias("image"),
        F.when(F.col("dataset") == "stage2", F.coalesce(first["system"], F.lit(""))).alias("system"),
        F.coalesce(first["user"], F.lit("")).alias("user"),
        F.coalesce(first["assistant"], F.lit("")).alias("assistant"),
    )
    turns = indexed(spark, sf, "conversations", "conv_id", "turn", "role").where(F.col("role") == "assistant")
    placed = turns.select("conv_id", "turn", F.col("index").alias("place"), *_coordinates())
    places = rerank(placed, "place", partition=("dataset", "config", "split")).select("conv_id", "turn", "index")
    ranked = records.join(places, ["conv_id", "turn"])
    sid = make_sample_id(F.col("dataset"), F.col("config"), F.col("split"), F.col("index"))
    return ranked.withColumn("sample_id", sid)


def gui_messages(spark: SparkSession, sf: str) -> DataFrame:
    parts = [F.col(c) for c in ("dataset", "image", "system", "user", "assistant")]
    return gui(spark, sf).withColumn("messages", chat.gui_messages(*parts))


def gui_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """GUI records with rendered tokens and the place where the response starts."""
    return with_rendering(gui_messages(spark, sf)).drop("messages")


SQL_GUI = """gui AS (
  SELECT *, row_number() OVER (PARTITION BY dataset, config, split ORDER BY conv_id, turn) - 1 AS idx
  FROM (
    SELECT a.conv_id, a.turn, a.text AS assistant, coalesce(u.text, '') AS usr,
      CASE WHEN a.conv_id % 5 < 2 THEN 'stage1' ELSE 'stage2' END AS dataset,
      CASE a.conv_id % 5 WHEN 0 THEN 'webui350k' WHEN 1 THEN 'seeclick' WHEN 2 THEN 'mind2web-l1'
                         WHEN 3 THEN 'coat' ELSE 'aitw-l2' END AS config,
      CASE WHEN a.conv_id % 4 = 0 THEN 'validation' ELSE 'train' END AS split,
      CASE WHEN a.conv_id % 5 >= 2 THEN coalesce(s.text, '') END AS sys,
      CASE WHEN a.conv_id % 3 <> 0 THEN concat('web', a.conv_id % 7) END AS raw_source,
      (1280 + (a.conv_id * 37) % 640)::INT AS width, (720 + (a.conv_id * 53) % 360)::INT AS height
    FROM (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS user_turn FROM conversations) a
    LEFT JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.user_turn
    LEFT JOIN (SELECT conv_id, arg_min(text, turn) AS text FROM conversations WHERE role = 'system' GROUP BY conv_id) s
      ON s.conv_id = a.conv_id
    WHERE a.role = 'assistant'))"""

SQL_GUI_ID = """gui_id AS (
  SELECT *, coalesce(raw_source, config) AS source,
    concat(dataset, ':', config, ':', split, ':', printf('%08d', idx)) AS sample_id
  FROM gui)"""

SQL_TOKENS = f"""gui_tok AS (
  SELECT *, list_concat(prefix, {sql_tokens('assistant')}, ['<|end|>']) AS toks, len(prefix) AS start
  FROM (
    SELECT *, list_concat(
      CASE WHEN coalesce(sys, '') <> '' THEN list_concat(['<|system|>'], {sql_tokens('sys')}, ['<|end|>'])
           ELSE []::VARCHAR[] END,
      ['<|user|>', '<image>'], {sql_tokens('usr')}, ['<|end|>', '<|assistant|>']) AS prefix
    FROM gui_id))"""

GUI_CTES = (SQL_GUI, SQL_GUI_ID)
TOKEN_CTES = (*GUI_CTES, SQL_TOKENS)

# --- scores -----------------------------------------------------------------


def logits(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings read as logits: sixteen consecutive vectors make one sample."""
    vec = F.col("vec_id")
    return table(spark, sf, "embeddings").select(
        "vec_id",
        F.concat(F.lit("seq-"), F.floor(vec / 16).cast("string")).alias("sample_id"),
        (vec % 16).cast("int").alias("pos"),
        F.col("label").cast("bigint").alias("token_id"),
        F.col("embedding").cast("array<double>").alias("logits"),
    )


SQL_LOGITS = """logits AS (
  SELECT vec_id, concat('seq-', vec_id // 16) AS sample_id, (vec_id % 16)::INT AS pos,
    label::BIGINT AS token_id, embedding::DOUBLE[] AS z,
    list_max(embedding::DOUBLE[])
      + ln(list_sum(list_transform(embedding::DOUBLE[], lambda x: exp(x - list_max(embedding::DOUBLE[]))))) AS norm
  FROM embeddings)"""

SQL_SHIFTED = """shifted AS (
  SELECT t.sample_id, t.pos, t.token_id, c.z[t.token_id + 1] - c.norm AS logprob
  FROM logits t JOIN logits c ON c.sample_id = t.sample_id AND c.pos + 1 = t.pos)"""

# --- boxes ------------------------------------------------------------------


def _event_box(shift: Column | None = None) -> list[Column]:
    event = F.col("event_id")
    x1 = ((event * 37) % 80).cast("double") / 100.0
    y1 = ((event * 53) % 80).cast("double") / 100.0
    if shift is not None:
        x1 = x1 + shift
    return [x1.alias("x1"), y1.alias("y1"), (x1 + 0.1).alias("x2"), (y1 + 0.1).alias("y2")]


def _image_id() -> Column:
    return F.concat(F.col("user_id").cast("string"), F.lit("-"), F.to_date("ts").cast("string"))


def boxes_true(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_id").alias("box_id"), _image_id().alias("image_id"), F.col("event_type").alias("label"), *_event_box()
    )


def boxes_pred(spark: SparkSession, sf: str) -> DataFrame:
    """The true boxes moved sideways, some mislabelled, some lost, some given twice."""
    event = F.col("event_id")
    shift = ((event * 13) % 11 - 5).cast("double") / 100.0
    copies = F.when(event % 9 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (
        table(spark, sf, "events")
        .where(event % 7 != 0)
        .select(
            "event_id",
            F.explode(copies).alias("copy"),
            _image_id().alias("image_id"),
            F.when(event % 5 == 0, "other").otherwise(F.col("event_type")).alias("label"),
            *_event_box(shift),
        )
        .select((event * 2 + F.col("copy")).alias("box_id"), "image_id", "label", "x1", "y1", "x2", "y2")
    )


def grounding_raw(spark: SparkSession, sf: str) -> DataFrame:
    event = F.col("event_id")
    image = F.struct(
        F.concat(F.lit("screen/"), event.cast("string"), F.lit(".png")).alias("path"),
        F.lit(960).alias("width"),
        F.lit(540).alias("height"),
        F.lit(None).cast("string").alias("filename"),
    ).cast(IMAGE)
    origin = F.when(event % 4 == 0, "windows").when(event % 4 == 1, "mac").when(event % 4 == 2, "web")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("sample_id"),
        image.alias("image"),
        F.array(*_event_box()).alias("bbox"),
        F.concat("event_type", F.lit(" "), F.col("user_id").cast("string")).alias("instruction"),
        F.when(event % 2 == 0, "icon").otherwise("text").alias("data_type"),
        origin.alias("data_source"),
    )


def actions(spark: SparkSession, sf: str) -> DataFrame:
    """Click calls in two notations; one in seventeen is not a call."""
    event = F.col("event_id")
    a, b = (event * 37) % 80 + event % 13, (event * 53) % 80 + event % 7
    exponent = F.concat(F.lit("click(x="), a.cast("string"), F.lit("e-2, y="), b.cast("string"), F.lit("e-2)"))
    plain = F.format_string("click(x=0.%02d, y=0.%02d)", a, b)
    return table(spark, sf, "events").select(
        F.col("event_id").alias("sample_id"),
        F.when(event % 17 == 0, "cannot find it").when(event % 2 == 0, exponent).otherwise(plain).alias("action"),
    )


SQL_BOXES_TRUE = """truth AS (
  SELECT event_id AS box_id, concat(user_id, '-', cast(cast(ts AS DATE) AS VARCHAR)) AS image_id, event_type AS label,
    x AS x1, y AS y1, x + 0.1::DOUBLE AS x2, y + 0.1::DOUBLE AS y2, event_id, user_id, event_type
  FROM (SELECT *, ((event_id * 37) % 80)::DOUBLE / 100.0::DOUBLE AS x, ((event_id * 53) % 80)::DOUBLE / 100.0::DOUBLE AS y FROM events))"""

SQL_BOXES_PRED = """pred AS (
  SELECT event_id * 2 + c AS box_id, concat(user_id, '-', cast(cast(ts AS DATE) AS VARCHAR)) AS image_id,
    CASE WHEN event_id % 5 = 0 THEN 'other' ELSE event_type END AS label,
    x AS x1, y AS y1, x + 0.1::DOUBLE AS x2, y + 0.1::DOUBLE AS y2, event_id
  FROM (SELECT *, ((event_id * 37) % 80)::DOUBLE / 100.0::DOUBLE + ((event_id * 13) % 11 - 5)::DOUBLE / 100.0::DOUBLE AS x,
               ((event_id * 53) % 80)::DOUBLE / 100.0::DOUBLE AS y FROM events)
  CROSS JOIN (VALUES (0), (1)) AS v(c)
  WHERE event_id % 7 <> 0 AND (c = 0 OR event_id % 9 = 0))"""


def sql_iou(a: str, b: str) -> str:
    wide = f"greatest(0.0::DOUBLE, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1))"
    high = f"greatest(0.0::DOUBLE, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))"
    union = (
        f"(({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1) + ({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1) - ({wide}) * ({high}))"
    )
    return f"CASE WHEN {union} > 0 THEN ({wide}) * ({high}) / {union} ELSE 0.0::DOUBLE END"


SQL_FIRST = "min(box_id) OVER (PARTITION BY image_id, label, x1, y1, x2, y2) AS first_copy"

SQL_MATCHES = f"""touching_pairs AS (
  SELECT t.image_id, t.label, t.box_id AS truth_id, p.box_id AS pred_id, t.first_copy AS truth_first, p.first_copy AS pred_first,
    {sql_iou('t', 'p')} AS iou
  FROM (SELECT *, {SQL_FIRST} FROM truth) t JOIN (SELECT *, {SQL_FIRST} FROM pred) p ON p.image_id = t.image_id AND p.label = t.label AND {sql_iou('t', 'p')} >= 0.5),
rounds AS (
  SELECT *, false AS settled FROM touching_pairs
  UNION ALL
  SELECT image_id, label, truth_id, pred_id, truth_first, pred_first, iou, mutual FROM (
    SELECT *, bool_or(mutual) OVER (PARTITION BY truth_id) AS truth_taken, bool_or(mutual) OVER (PARTITION BY pred_id) AS pred_taken
    FROM (
      SELECT *, row_number() OVER (PARTITION BY truth_id ORDER BY iou DESC, pred_first, pred_id) = 1
        AND row_number() OVER (PARTITION BY pred_id ORDER BY iou DESC, truth_first, truth_id) = 1 AS mutual
      FROM rounds WHERE NOT settled))
  WHERE mutual OR NOT (truth_taken OR pred_taken)),
matches AS (SELECT image_id, label, truth_id, pred_id, iou FROM rounds WHERE settled)"""

SQL_SCORES = """scores AS (
  SELECT image_id, expected, predicted, matched, touching - matched AS duplicates, predicted - touching AS wrong
  FROM (
    SELECT coalesce(e.image_id, q.image_id) AS image_id, coalesce(e.n, 0) AS expected, coalesce(q.n, 0) AS predicted,
      coalesce(q.touching, 0) AS touching, coalesce(m.n, 0) AS matched
    FROM (SELECT image_id, count(*) AS n FROM truth GROUP BY image_id) e
    FULL JOIN (
      SELECT image_id, count(*) AS n,
        count(*) FILTER (WHERE box_id IN (SELECT pred_id FROM touching_pairs)) AS touching
      FROM pred GROUP BY image_id) q ON q.image_id = e.image_id
    LEFT JOIN (SELECT image_id, count(*) AS n FROM matches GROUP BY image_id) m
      ON m.image_id = coalesce(e.image_id, q.image_id)))"""

MATCH_CTES = (SQL_BOXES_TRUE, SQL_BOXES_PRED, SQL_MATCHES)

SQL_ACTIONS = """actions AS (
  SELECT event_id AS sample_id,
    CASE WHEN event_id % 17 = 0 THEN 'cannot find it'
         WHEN event_id % 2 = 0 THEN concat('click(x=', a, 'e-2, y=', b, 'e-2)')
         ELSE printf('click(x=0.%02d, y=0.%02d)', a, b) END AS action,
    CASE WHEN event_id % 17 <> 0 THEN a / 100.0::DOUBLE END AS x,
    CASE WHEN event_id % 17 <> 0 THEN b / 100.0::DOUBLE END AS y
  FROM (SELECT event_id, (event_id * 37) % 80 + event_id % 13 AS a, (event_id * 53) % 80 + event_id % 7 AS b FROM events))"""

# --- predictions ------------------------------------------------------------


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Responses of a baseline and a tool run for every labelled document."""
    doc = F.col("doc_id")
    base = F.when(doc % 11 == 0, "unsure").when(F.col("toxic") == 1, "false").otherwise("The answer is True.")
    tools = F.when(doc % 7 == 0, "FALSE!").when(F.col("quality") == 1, "true").otherwise("I think: False")
    runs = F.array(
        F.struct(F.lit("baseline").alias("run"), base.alias("response")),
        F.struct(F.lit("tools").alias("run"), tools.alias("response")),
    )
    domain = F.when(doc % 3 == 0, "counting").when(doc % 3 == 1, "attributes").otherwise("other")
    return table(spark, sf, "labels").select(
        F.concat(F.lit("dev-"), doc.cast("string"), F.lit("-0-0")).alias("uid"),
        "doc_id",
        domain.alias("domain"),
        F.inline(runs),
    )


def gold(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").select(
        F.concat(F.lit("dev-"), F.col("doc_id").cast("string"), F.lit("-0-0")).alias("uid"),
        F.when(F.col("quality") == 1, "True").otherwise("False").alias("label"),
    )


SQL_JUDGED = """judged AS (
  SELECT *, coalesce(pred = label, false) AS correct
  FROM (
    SELECT *, CASE lower(regexp_extract(response, '(?i)\\b(true|false)\\b', 1))
                WHEN 'true' THEN 'True' WHEN 'false' THEN 'False' END AS pred
    FROM (
      SELECT concat('dev-', doc_id, '-0-0') AS uid, doc_id, run,
        CASE doc_id % 3 WHEN 0 THEN 'counting' WHEN 1 THEN 'attributes' ELSE 'other' END AS domain,
        CASE WHEN quality = 1 THEN 'True' ELSE 'False' END AS label,
        CASE WHEN run = 'baseline' THEN
               CASE WHEN doc_id % 11 = 0 THEN 'unsure' WHEN toxic = 1 THEN 'false' ELSE 'The answer is True.' END
             ELSE CASE WHEN doc_id % 7 = 0 THEN 'FALSE!' WHEN quality = 1 THEN 'true' ELSE 'I think: False' END
        END AS response
      FROM labels CROSS JOIN (VALUES ('baseline'), ('tools')) AS r(run))))"""


# --- adapter modules, uid caches --------------------------------------------


def modules(spark: SparkSession, sf: str) -> DataFrame:
    """One module per event: mostly linear, in a text or a vision tower."""
    event, user = F.col("event_id"), F.col("user_id")
    tower = F.when(event % 4 == 3, "model.vision_model").otherwise("model.text_model")
    part = F.get(
        F.array(*[F.lit(p) for p in ("q_proj", "k_proj", "v_proj", "o_proj", "gate_proj", "norm")]),
        (event % 6).cast("int"),
    )
    return table(spark, sf, "events").select(
        F.concat(tower, F.lit(".layers."), user.cast("string"), F.lit(".self_attn."), part).alias("name"),
        F.when(event % 7 == 0, "Conv2d").otherwise("Linear").alias("kind"),
        (64 + (event % 32) * 8).alias("in_features"),
        (64 + (user % 16) * 8).alias("out_features"),
    )


SQL_WIDTH = """width AS (
  SELECT coalesce(sum(64 + (event_id % 32) * 8 + 64 + (user_id % 16) * 8), 0)::BIGINT AS width FROM events
  WHERE event_id % 7 <> 0 AND event_id % 4 <> 3 AND event_id % 6 < 4)"""


def uid_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Uids of the labelled documents in scan order."""
    return indexed(spark, sf, "labels", "doc_id").select(
        F.col("index").alias("position"), F.concat(F.lit("dev-"), F.col("doc_id").cast("string"), F.lit("-0-0")).alias("uid")
    )


def uid_arrivals(spark: SparkSession, sf: str) -> DataFrame:
    """Uids in order of arrival: one per turn, so each conversation repeats its own."""
    return indexed(spark, sf, "conversations", "conv_id").select(
        F.col("index").alias("pos"), F.concat(F.lit("dev-"), (F.col("conv_id") * 3).cast("string"), F.lit("-0-0")).alias("uid")
    )


SQL_CACHE = """cache AS (
  SELECT row_number() OVER (ORDER BY doc_id) - 1 AS position, concat('dev-', doc_id, '-0-0') AS uid FROM labels)"""
SQL_ARRIVALS = """arrivals AS (
  SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS pos, concat('dev-', conv_id * 3, '-0-0') AS uid
  FROM conversations)"""
