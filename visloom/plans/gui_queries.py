"""Queries over GUI records: scans, ids, messages, training arrays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visloom.functions import chat
from visloom.functions import text as tx
from visloom.operators import lookup, sampling, sft
from visloom.operators.positions import random_positions
from visloom.plans import fixtures as fx
from visloom.plans.flows import training_run, training_table
from visloom.plans.pair_queries import SQL_PROMPT, flat_messages, flat_parts
from visloom.plans.registry import query
from visloom.schemas import STAGE1_CONFIGS, STAGE2_CONFIGS
from visloom.session import scratch_path
from visloom.sources import gui as source
from visloom.sources.pairs import COLUMNS
from visloom.sources.scan import unknown_configs

GUI, TOKENS = fx.GUI_CTES, fx.TOKEN_CTES


def _load_written(spark, sf, stage: str, configs: list[str]) -> DataFrame:
    """Write the raw records partitioned by their coordinates and read configs back."""
    folder = scratch_path(spark, "gui")
    raw = fx.gui_raw(spark, sf).drop("conv_id", "turn")
    raw.write.partitionBy("dataset", "config", "split").parquet(folder)
    loads = [
        source.load_gui(spark, folder, stage, config, split, keep=("config", "split"))
        for config in configs
        for split in ("train", "validation")
    ]
    return reduce(DataFrame.unionByName, loads)


@query(
    "load_stage1",
    fx.with_ctes(
        *GUI,
        select="""SELECT config, split, usr AS user, assistant, source, width FROM gui_id WHERE dataset = 'stage1'""",
    ),
)
def load_stage1(spark, sf):
    out = _load_written(spark, sf, "stage1", ["webui350k", "seeclick"])
    return out.select("config", "split", "user", "assistant", "source", F.col("image.width").alias("width"))


@query(
    "load_stage2",
    fx.with_ctes(
        *GUI,
        select="""SELECT config, split, sys AS system, usr AS user, assistant, source FROM gui_id
WHERE dataset = 'stage2'""",
    ),
)
def load_stage2(spark, sf):
    return _load_written(spark, sf, "stage2", ["mind2web-l1", "coat", "aitw-l2"]).drop("image")


SQL_CHOICES = ", ".join(f"'{c}'" for c in STAGE1_CONFIGS), ", ".join(f"'{c}'" for c in STAGE2_CONFIGS)


@query(
    "config_check",
    f"""SELECT dataset, config, count(*) AS n FROM (
  SELECT CASE WHEN conv_id % 2 = 0 THEN 'stage1' ELSE 'stage2' END AS dataset,
    CASE conv_id % 3 WHEN 0 THEN 'guienv' WHEN 1 THEN 'coat' ELSE 'webui351k' END AS config FROM conversations)
WHERE NOT ((dataset = 'stage1' AND config IN ({SQL_CHOICES[0]}))
        OR (dataset = 'stage2' AND config IN ({SQL_CHOICES[1]})))
GROUP BY dataset, config""",
)
def config_check(spark, sf):
    conv = F.col("conv_id")
    named = fx.table(spark, sf, "conversations").select(
        F.when(conv % 2 == 0, "stage1").otherwise("stage2").alias("dataset"),
        F.when(conv % 3 == 0, "guienv").when(conv % 3 == 1, "coat").otherwise("webui351k").alias("config"),
    )
    return unknown_configs(named).groupBy("dataset", "config").agg(F.count(F.lit(1)).alias("n"))


@query(
    "text_lengths",
    fx.with_ctes(
        *GUI,
        select="""SELECT sample_id, length(assistant)::INT AS assistant_len, length(coalesce(sys, ''))::INT AS system_len
FROM gui_id""",
    ),
)
def text_lengths(spark, sf):
    return fx.gui(spark, sf).select(
        "sample_id",
        F.char_length(F.coalesce("assistant", F.lit(""))).alias("assistant_len"),
        F.char_length(F.coalesce("system", F.lit(""))).alias("system_len"),
    )


@query(
    "sample_view",
    fx.with_ctes(
        *GUI,
        select="""SELECT sample_id, coalesce(sys, '') AS system, usr AS user, assistant, source,
  concat(width, 'x', height) AS image_size FROM gui_id""",
    ),
)
def sample_view(spark, sf):
    view = source.sample_view(fx.gui(spark, sf))
    size = F.concat(
        F.col("image_size.width").cast("string"), F.lit("x"), F.col("image_size.height").cast("string")
    )
    return view.withColumn("system", F.coalesce("system", F.lit(""))).withColumn("image_size", size)


# --- ids, skip and limit ----------------------------------------------------


@query("sample_id_make", fx.with_ctes(*GUI, select="SELECT conv_id, turn, sample_id FROM gui_id"))
def sample_id_make(spark, sf):
    return fx.gui(spark, sf).select("conv_id", "turn", "sample_id")


SQL_ASKED = """asked AS (
  SELECT conv_id, turn, CASE turn % 4
      WHEN 0 THEN concat('stage1:coat:train:', printf('%08d', turn))
      WHEN 1 THEN concat('stage2:coat:train:', printf('%08d', turn // 2))
      WHEN 2 THEN concat('stage2:coat:', turn) ELSE concat('stage2:coat:train:x', turn) END AS sample_id
  FROM conversations)"""


def _asked(spark, sf) -> DataFrame:
    turn = F.col("turn")
    number = turn.cast("string")
    sid = (
        F.when(turn % 4 == 0, F.format_string("stage1:coat:train:%08d", turn))
        .when(turn % 4 == 1, F.format_string("stage2:coat:train:%08d", F.floor(turn / 2)))
        .when(turn % 4 == 2, F.concat(F.lit("stage2:coat:"), number))
        .otherwise(F.concat(F.lit("stage2:coat:train:x"), number))
    )
    return fx.table(spark, sf, "conversations").select("conv_id", "turn", sid.alias("sample_id"))


@query(
    "sample_id_parse",
    fx.with_ctes(
        SQL_ASKED,
        select="""SELECT conv_id, turn, sample_id, turn % 4 < 2 AS valid,
  CASE turn % 4 WHEN 0 THEN 'stage1' WHEN 1 THEN 'stage2' ELSE '' END AS dataset,
  CASE turn % 4 WHEN 0 THEN turn WHEN 1 THEN turn // 2 ELSE -1 END AS index FROM asked""",
    ),
)
def sample_id_parse(spark, sf):
    return lookup.parsed_ids(_asked(spark, sf), strict=False).select(
        "conv_id",
        "turn",
        "sample_id",
        F.col("index").isNotNull().alias("valid"),
        F.coalesce("dataset", F.lit("")).alias("dataset"),
        F.coalesce("index", F.lit(-1)).alias("index"),
    )


@query(
    "sample_id_lookup",
    fx.with_ctes(
        *GUI,
        SQL_ASKED,
        select="""SELECT q.conv_id AS asked_by, q.turn AS asked_turn, g.sample_id, g.assistant
FROM asked q JOIN gui_id g ON g.sample_id = q.sample_id WHERE q.turn % 4 < 2""",
    ),
)
def sample_id_lookup(spark, sf):
    asked = _asked(spark, sf).withColumnsRenamed({"conv_id": "asked_by", "turn": "asked_turn"})
    records = fx.gui(spark, sf).select("dataset", "config", "split", "index", "assistant")
    return lookup.lookup_sample_ids(records, asked, strict=False).select(
        "asked_by", "asked_turn", "sample_id", "assistant"
    )


@query("skip_n", fx.with_ctes(*GUI, select="SELECT sample_id, idx AS index FROM gui_id WHERE idx >= 5"))
def skip_n(spark, sf):
    return sampling.skip_limit(fx.gui(spark, sf), skip=5).select("sample_id", "index")


@query(
    "skip_limit", fx.with_ctes(*GUI, select="SELECT sample_id, idx AS index FROM gui_id WHERE idx >= 3 AND idx < 13")
)
def skip_limit(spark, sf):
    return sampling.skip_limit(fx.gui(spark, sf), skip=3, limit=10).select("sample_id", "index")


# --- messages ---------------------------------------------------------------

SHOT = "'shot/', conv_id, '.png'"


@query(
    "chat_user_content",
    fx.with_ctes(
        *GUI,
        select=f"""SELECT sample_id, concat('user|image|', {SHOT}, '|', chr(30), 'user|text||', usr) AS content FROM gui_id""",
    ),
)
def chat_user_content(spark, sf):
    content = chat.user_content(F.array("image"), F.col("user"))
    return fx.gui(spark, sf).select(
        "sample_id", F.array_join(flat_parts(content, F.lit("user")), "\x1e").alias("content")
    )


SQL_LEAD = "CASE WHEN coalesce(sys, '') <> '' THEN concat('system|text||', sys, chr(30)) ELSE '' END"


@query(
    "chat_conversation",
    fx.with_ctes(
        *GUI,
        select=f"""SELECT sample_id, concat({SQL_LEAD}, 'user|image|', {SHOT}, '|', chr(30), 'user|text||', usr) AS messages
FROM gui_id""",
    ),
)
def chat_conversation(spark, sf):
    messages = chat.conversation(F.array("image"), F.col("user"), F.col("system"))
    return fx.gui(spark, sf).select("sample_id", flat_messages(messages).alias("messages"))


@query(
    "chat_attach",
    fx.with_ctes(
        *GUI,
        select=f"""SELECT sample_id, 2 AS n_before, 3 AS n_after,
  concat('assistant|text||', assistant) AS last_turn FROM gui_id WHERE coalesce(sys, '') <> ''
UNION ALL SELECT sample_id, 1, 2, concat('assistant|text||', assistant) FROM gui_id WHERE coalesce(sys, '') = ''""",
    ),
)
def chat_attach(spark, sf):
    before = chat.conversation(F.array("image"), F.col("user"), F.col("system"))
    both = fx.gui(spark, sf).withColumn("before", before)
    both = both.withColumn("after", chat.attach_response(F.col("before"), F.col("assistant")))
    return both.select(
        "sample_id",
        F.size("before").alias("n_before"),
        F.size("after").alias("n_after"),
        flat_messages(F.slice("after", -1, 1)).alias("last_turn"),
    )


@query(
    "chat_messages",
    fx.with_ctes(
        *GUI,
        select=f"""SELECT sample_id, concat({SQL_LEAD}, 'user|image|', {SHOT}, '|', chr(30), 'user|text||', usr, chr(30),
  'assistant|text||', assistant) AS messages FROM gui_id""",
    ),
)
def chat_messages(spark, sf):
    return fx.gui_messages(spark, sf).select("sample_id", flat_messages(F.col("messages")).alias("messages"))


# --- rendering and training arrays ------------------------------------------


@query(
    "prompt_response_split",
    fx.with_ctes(
        *TOKENS,
        select="""SELECT sample_id, len(toks)::INT AS n_tokens, start::INT AS response_start,
  array_to_string(toks, ' ') AS rendered FROM gui_tok""",
    ),
)
def prompt_response_split(spark, sf):
    return fx.gui_tokens(spark, sf).select(
        "sample_id",
        F.size("tokens").alias("n_tokens"),
        "response_start",
        F.array_join("tokens", " ").alias("rendered"),
    )


SQL_IDS = """ids AS (
  SELECT *, list_transform(toks, lambda t: greatest((('0x' || substr(md5(t), 1, 16))::UBIGINT // 2)::BIGINT, 1)) AS ids FROM gui_tok)"""


def _joined(column: str):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")


@query(
    "sft_labels",
    fx.with_ctes(
        *TOKENS,
        SQL_IDS,
        select="""SELECT sample_id, array_to_string(ids, ',') AS input_ids,
  array_to_string(list_concat(list_transform(ids[1:start], lambda x: -100), ids[start + 1:]), ',') AS labels FROM ids""",
    ),
)
def sft_labels(spark, sf):
    examples = sft.sft_examples(fx.gui_tokens(spark, sf), max_length=None)
    return examples.select("sample_id", _joined("input_ids").alias("input_ids"), _joined("labels").alias("labels"))


@query(
    "score_mask",
    fx.with_ctes(
        *TOKENS,
        SQL_IDS,
        select="""SELECT sample_id, ids[2] AS pad_id, len(list_filter(list_transform(ids, lambda x, i:
    CASE WHEN i <= start OR i = 1 OR x = ids[start + 1] THEN -100 ELSE x END), lambda y: y <> -100))::INT AS n_scored
FROM ids""",
    ),
)
def score_mask(spark, sf):
    """Scored positions when the first response token happens to be the padding id."""
    ids = fx.gui_tokens(spark, sf).withColumn("ids", chat.token_ids(F.col("tokens")))
    pad = F.get("ids", F.col("response_start"))
    labels = chat.scoring_labels(F.col("ids"), F.col("response_start"), pad)
    return ids.select(
        "sample_id",
        F.get("ids", 1).alias("pad_id"),
        F.size(F.filter(labels, lambda x: x != chat.IGNORE)).alias("n_scored"),
    )


@query(
    "sft_pad_batch",
    fx.with_ctes(
        *TOKENS,
        """batched AS (
  SELECT *, idx // 4 AS batch, max(len(toks)) OVER (PARTITION BY dataset, config, split, idx // 4) AS longest FROM gui_tok)""",
        select="""SELECT sample_id, batch, (((longest + 7) // 8) * 8)::INT AS padded_length, len(toks)::INT AS n_real,
  (((longest + 7) // 8) * 8)::INT AS n_labels, (len(toks) - start)::INT AS n_scored FROM batched""",
    ),
)
def sft_pad_batch(spark, sf):
    examples = sft.sft_examples(fx.gui_tokens(spark, sf), max_length=None)
    padded = sft.pad_batches(examples, 4, partition=("dataset", "config", "split"))
    total = F.aggregate("attention_mask", F.lit(0), lambda acc, x: acc + x)
    return padded.select(
        "sample_id",
        "batch",
        F.size("input_ids").alias("padded_length"),
        total.alias("n_real"),
        F.size("labels").alias("n_labels"),
        F.size(F.filter("labels", lambda x: x != chat.IGNORE)).alias("n_scored"),
    )


@query(
    "seq_length_cap",
    fx.with_ctes(
        *TOKENS,
        select="""SELECT sample_id, len(toks)::INT AS n_tokens, least(len(toks), 128)::INT AS kept,
  len(toks) > 128 AS over FROM gui_tok""",
    ),
)
def seq_length_cap(spark, sf):
    examples = sft.sft_examples(fx.gui_tokens(spark, sf), max_length=128)
    return examples.select(
        "sample_id",
        "n_tokens",
        F.size("input_ids").alias("kept"),
        (F.col("n_tokens") > 128).alias("over"),
    )


# --- vocabulary -------------------------------------------------------------

SQL_VOCAB = """vocab AS (
  SELECT token, row_number() OVER (ORDER BY md5(concat('0:', token)), token) - 1 AS token_id
  FROM (SELECT DISTINCT unnest(toks) AS token FROM gui_tok))"""


def vocabulary(rendered: DataFrame) -> DataFrame:
    """Every distinct rendered token with a dense id."""
    # The outer form, as the plain one would render every record twice to test for emptiness.
    words = rendered.select(F.explode_outer("tokens").alias("token")).where(F.col("token").isNotNull()).distinct()
    return random_positions(words, "token", seed=0, out="token_id")


@query(
    "special_token_ids",
    fx.with_ctes(
        *TOKENS,
        SQL_VOCAB,
        select="""SELECT DISTINCT token_id FROM vocab
WHERE token IN ('<image>', '<fake_token_around_image>', '<global-img>')""",
    ),
)
def special_token_ids(spark, sf):
    return lookup.image_token_ids(vocabulary(fx.gui_tokens(spark, sf)), chat.IMAGE_TOKENS)


SQL_SHUFFLED = f"""shuffled AS (
  SELECT *, row_number() OVER (ORDER BY block, h, idx) - 1 AS position
  FROM (SELECT *, idx // 64 AS block, md5(concat('42:', idx)) AS h FROM keyed) WHERE reason IS NULL),
rendered AS (
  SELECT *, list_concat(['<|user|>', '<image>', '<image>'],
    {fx.sql_tokens(f"replace('{SQL_PROMPT}', '{{statement}}', {fx.sql_strip('sentence')})")}, ['<|end|>', '<|assistant|>']) AS prefix
  FROM shuffled),
sized AS (
  SELECT *, least(len(prefix) + 2, 2048) AS kept, position // 8 AS batch FROM rendered)"""


SFT_TABLE = fx.with_ctes(
        fx.SQL_RAW,
        fx.SQL_KEYED,
        SQL_SHUFFLED,
        select="""SELECT uid, position, batch, (len(prefix) + 2)::INT AS n_tokens, len(prefix)::INT AS response_start,
  (((max(kept) OVER (PARTITION BY batch) + 7) // 8) * 8)::INT AS padded_length,
  greatest(0, kept - len(prefix))::INT AS n_scored FROM sized""",
    )


def _table_view(table: DataFrame) -> DataFrame:
    return table.select(
        "uid",
        "position",
        "batch",
        "n_tokens",
        "response_start",
        "padded_length",
        F.size(F.filter("labels", lambda x: x != chat.IGNORE)).alias("n_scored"),
    )


@query("sft_table", SFT_TABLE)
def sft_table(spark, sf):
    """Shuffle, normalise, render, mask, cut and pad all pair records."""
    table = training_table(fx.pairs_raw(spark, sf), split=fx.SPLIT, buffer=64, batch_size=8, strict=False)
    return _table_view(table)


@query("training_flow", SFT_TABLE)
def training_flow(spark, sf):
    """The same from stored pair files, the first source being absent."""
    folder = scratch_path(spark, "pairs")
    raw = fx.pairs_raw(spark, sf)
    raw.repartitionByRange("index").sortWithinPartitions("index").select(*COLUMNS).write.parquet(
        f"{folder}/mirror/split={fx.SPLIT}"
    )
    sources = [f"{folder}/absent", f"{folder}/mirror"]
    return _table_view(training_run(spark, sources, fx.SPLIT, buffer=64, batch_size=8, strict=False))
