"""Queries over token scores: bits per token, sample, run and source; adapter capacity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visloom.functions import chat
from visloom.functions.scoring import LN2, log_softmax, target_logprob
from visloom.operators import counts, surprisal
from visloom.operators.joins import spread_join
from visloom.plans import fixtures as fx
from visloom.plans.flows import count_scores
from visloom.plans.gui_queries import SQL_VOCAB, vocabulary
from visloom.plans.registry import query
from visloom.session import materialized, scratch_path
from visloom.sinks import files

TIMESTAMP, MODEL = "20240101_000000", "counts"
SUFFIXES, FRAGMENTS, RANKS = ["q_proj", "k_proj", "v_proj", "o_proj"], ["model.text_model"], [8, 16, 32, 64]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every double column rounded, so that results compare as values."""
    return df.select(
        *[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


def sql_rounded(select: str, *columns: str) -> str:
    """The same in SQL, for the named columns."""
    return f"SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in columns)}) FROM ({select})"


# --- from logits ------------------------------------------------------------


@query(
    "log_softmax",
    fx.with_ctes(
        fx.SQL_LOGITS,
        select="""SELECT vec_id, token_id, round(logp, 6) AS logp FROM (
  SELECT vec_id, unnest(range(len(z))) AS token_id, unnest(list_transform(z, lambda x: x - norm)) AS logp FROM logits)""",
    ),
)
def log_softmax_query(spark, sf):
    probs = fx.logits(spark, sf).select("vec_id", F.posexplode(log_softmax(F.col("logits"))).alias("token_id", "logp"))
    return probs.select(
        "vec_id", F.col("token_id").cast("bigint").alias("token_id"), F.round("logp", 6).alias("logp")
    )


@query(
    "gather_logprob",
    fx.with_ctes(
        fx.SQL_LOGITS,
        fx.SQL_SHIFTED,
        select="SELECT sample_id, pos, token_id, round(logprob, 6) AS logprob FROM shifted",
    ),
)
def gather_logprob(spark, sf):
    return rounded(surprisal.causal_logprobs(fx.logits(spark, sf)))


@query(
    "token_surprisal",
    fx.with_ctes(
        fx.SQL_LOGITS,
        select=f"""SELECT vec_id, token_id, round(norm - z[token_id + 1], 6) AS surprisal_nats,
  round((norm - z[token_id + 1]) / {LN2!r}::DOUBLE, 6) AS surprisal_bits FROM logits""",
    ),
)
def token_surprisal(spark, sf):
    scored = fx.logits(spark, sf).withColumn("logprob", target_logprob(F.col("logits"), F.col("token_id")))
    bits = surprisal.token_surprisal(scored)
    return rounded(bits.select("vec_id", "token_id", "surprisal_nats", "surprisal_bits"))


SQL_SAMPLE_BITS = f"""bits AS (
  SELECT sample_id, count(*) AS num_tokens, count(*) FILTER (WHERE token_id IN (0, 1)) AS num_image_tokens,
    coalesce(sum(b) FILTER (WHERE token_id IN (0, 1)), 0)::DOUBLE AS image_bits,
    coalesce(sum(b) FILTER (WHERE token_id NOT IN (0, 1)), 0)::DOUBLE AS text_bits
  FROM (SELECT *, (-logprob / {LN2!r}::DOUBLE)::DECIMAL(38, 15) AS b FROM shifted) GROUP BY sample_id),
stats AS (
  SELECT s.sample_id, s.label, coalesce(num_tokens, 0) AS num_tokens, coalesce(num_image_tokens, 0) AS num_image_tokens,
    coalesce(image_bits, 0) AS image_bits, coalesce(text_bits, 0) AS text_bits
  FROM (SELECT sample_id, min(token_id) FILTER (WHERE pos = 0) AS label FROM logits GROUP BY sample_id) s
  LEFT JOIN bits b USING (sample_id))"""


def _scored_sequences(spark, sf) -> DataFrame:
    scores = fx.logits(spark, sf)
    tokens = surprisal.token_surprisal(surprisal.causal_logprobs(scores))
    samples = scores.where(F.col("pos") == 0).select("sample_id", F.col("token_id").alias("label"))
    return surprisal.sample_surprisal(tokens, samples, F.col("token_id").isin(0, 1))


@query(
    "sample_surprisal",
    fx.with_ctes(
        fx.SQL_LOGITS,
        fx.SQL_SHIFTED,
        SQL_SAMPLE_BITS,
        select=f"""SELECT sample_id, num_tokens, num_image_tokens, num_tokens - num_image_tokens AS num_text_tokens,
  round(image_bits + text_bits, 6) AS total_surprisal_bits, round((image_bits + text_bits) * {LN2!r}::DOUBLE, 6) AS total_surprisal_nats,
  round(coalesce((image_bits + text_bits) / nullif(num_tokens, 0), 0), 6) AS avg_surprisal_bits,
  round(coalesce((image_bits + text_bits) / nullif(num_tokens, 0), 0) * {LN2!r}::DOUBLE, 6) AS avg_surprisal_nats,
  round(image_bits, 6) AS image_surprisal_bits, round(text_bits, 6) AS text_surprisal_bits FROM stats""",
    ),
)
def sample_surprisal(spark, sf):
    return rounded(_scored_sequences(spark, sf).drop("label"))


TOTAL = "sum((image_bits + text_bits)::DECIMAL(38, 15))::DOUBLE"
SQL_SUMMARY_FIELDS = f"""count(*) AS samples, coalesce(sum(num_tokens), 0)::BIGINT AS total_tokens,
  {TOTAL} AS total_surprisal_bits, sum((image_bits)::DECIMAL(38, 15))::DOUBLE AS image_bits_total,
  sum((text_bits)::DECIMAL(38, 15))::DOUBLE AS text_bits_total, {TOTAL} * {LN2!r}::DOUBLE AS total_surprisal_nats,
  coalesce({TOTAL} / nullif(sum(num_tokens), 0)::DOUBLE, 0) AS mean_bits_per_token,
  coalesce({TOTAL} / nullif(count(*), 0)::DOUBLE, 0) AS mean_bits_per_sample"""


TOTAL_NAMES = ("total_surprisal_bits", "image_bits_total", "text_bits_total")
SUMMARY_NAMES = (*TOTAL_NAMES, "total_surprisal_nats", "mean_bits_per_token", "mean_bits_per_sample")


@query(
    "surprisal_summary",
    fx.with_ctes(
        fx.SQL_LOGITS, fx.SQL_SHIFTED, SQL_SAMPLE_BITS,
        select=sql_rounded(f"SELECT {SQL_SUMMARY_FIELDS} FROM stats", *SUMMARY_NAMES),
    ),
)
def surprisal_summary(spark, sf):
    return rounded(surprisal.run_summary(_scored_sequences(spark, sf)))


def summary_by_label(spark, sf) -> DataFrame:
    return rounded(surprisal.run_summary(_scored_sequences(spark, sf), ["label"]))


# --- from counts over rendered records --------------------------------------

SQL_PAIR_ROWS = """pair_rows AS (
  SELECT sample_id, dataset, config, split, idx, source, start, i - 1 AS pos, toks[i - 1] AS prev, toks[i] AS token
  FROM (SELECT *, unnest(range(start + 1, len(toks) + 1)) AS i FROM gui_tok)),
pair_counts AS (
  SELECT prev, token, count(*) AS n FROM (
    SELECT toks[i - 1] AS prev, toks[i] AS token
    FROM (SELECT toks, unnest(range(2, len(toks) + 1)) AS i FROM gui_tok WHERE split = 'train'))
  GROUP BY prev, token),
pair_bits AS (
  SELECT w.prev, w.token, -log2((coalesce(c.n, 0) + 1.0::DOUBLE) / (coalesce(u.n, 0) + 1.0::DOUBLE * v.v)) AS b
  FROM (SELECT DISTINCT prev, token FROM pair_rows) w
  LEFT JOIN pair_counts c ON c.prev = w.prev AND c.token = w.token
  LEFT JOIN (SELECT prev, sum(n)::BIGINT AS n FROM pair_counts GROUP BY prev) u ON u.prev = w.prev
  CROSS JOIN (SELECT count(DISTINCT token) + 1 AS v FROM pair_counts) v),
scored AS (SELECT r.*, b.b FROM pair_rows r JOIN pair_bits b ON b.prev = r.prev AND b.token = r.token)"""

COUNT_CTES = (*fx.TOKEN_CTES, SQL_PAIR_ROWS)


def token_table(spark, sf) -> DataFrame:
    """Rendered records, written once: counting, scoring and the records all read them."""
    needed = ["sample_id", "dataset", "config", "split", "index", "source", "system", "assistant"]
    return materialized(fx.gui_tokens(spark, sf).select(*needed, "response_start", "tokens"), "tokens")


def pair_table(tokens: DataFrame) -> DataFrame:
    """Adjacent pairs: counts over the train split, and how often responses ask for each."""
    pairs = counts.explode_pairs(tokens, "split", "response_start")
    return counts.pair_table(pairs, F.col("split") == "train", F.col("pos") >= F.col("response_start"))


def scored_tokens(tokens: DataFrame) -> DataFrame:
    """Response tokens of every record with their bits under counts of the train split."""
    return count_scores(tokens, F.col("split") == "train")


def records(spark, sf) -> DataFrame:
    tokens = token_table(spark, sf)
    is_image = F.col("token").isin(chat.IMAGE_TOKENS)
    samples = tokens.withColumnRenamed("response_start", "prompt_tokens")
    return surprisal.surprisal_records(samples, scored_tokens(tokens), is_image)


@query("ngram_counts", fx.with_ctes(*COUNT_CTES, select="SELECT prev, token, n FROM pair_counts"))
def ngram_counts(spark, sf):
    return counts.pair_counts(pair_table(fx.gui_tokens(spark, sf)))


@query(
    "ngram_surprisal",
    fx.with_ctes(*COUNT_CTES, select="SELECT sample_id, pos::INT AS pos, prev, token, round(b, 6) AS surprisal_bits FROM scored"),
)
def ngram_surprisal(spark, sf):
    return rounded(scored_tokens(token_table(spark, sf)).select("sample_id", "pos", "prev", "token", "surprisal_bits"))


@query(
    "token_details",
    fx.with_ctes(
        *COUNT_CTES,
        SQL_VOCAB,
        select="""SELECT sample_id, count(*) AS n, string_agg(concat(v.token_id, '=', s.token), ' ' ORDER BY s.pos) AS details,
  round(sum(b::DECIMAL(38, 15))::DOUBLE, 6) AS bits FROM scored s JOIN vocab v ON v.token = s.token GROUP BY sample_id""",
    ),
)
def token_details(spark, sf):
    tokens = token_table(spark, sf)
    scored = scored_tokens(tokens)
    with_ids = spread_join(scored, vocabulary(tokens), ["token"], "inner", spread=["sample_id", "pos"])
    details = surprisal.token_details(with_ids)
    shown = F.transform("token_details", lambda t: F.concat(t["token_id"].cast("string"), F.lit("="), t["token"]))
    bits = F.aggregate(
        "token_details",
        F.lit(0).cast("decimal(38,15)"),
        lambda acc, t: (acc + t["surprisal_bits"].cast("decimal(38,15)")).cast("decimal(38,15)"),
    )
    return details.select(
        "sample_id",
        F.size("token_details").cast("bigint").alias("n"),
        F.array_join(shown, " ").alias("details"),
        F.round(bits.cast("double"), 6).alias("bits"),
    )


SQL_RECORDS = f"""stats AS (
  SELECT g.sample_id, g.dataset, g.config, g.split, g.idx, g.source, g.start, length(g.assistant)::INT AS assistant_len,
    CASE WHEN g.dataset = 'stage2' THEN length(g.sys)::INT END AS system_len,
    coalesce(n, 0) AS num_tokens, coalesce(n_img, 0) AS num_image_tokens,
    coalesce(img, 0)::DOUBLE AS image_bits, coalesce(txt, 0)::DOUBLE AS text_bits
  FROM gui_tok g LEFT JOIN (
    SELECT sample_id, count(*) AS n,
      count(*) FILTER (WHERE token IN ('<image>', '<fake_token_around_image>', '<global-img>')) AS n_img,
      sum(b::DECIMAL(38, 15)) FILTER (WHERE token IN ('<image>', '<fake_token_around_image>', '<global-img>')) AS img,
      sum(b::DECIMAL(38, 15)) FILTER (WHERE token NOT IN ('<image>', '<fake_token_around_image>', '<global-img>')) AS txt
    FROM scored GROUP BY sample_id) s USING (sample_id)),
recs AS (
  SELECT sample_id, dataset, config, split, idx AS index, source, start::INT AS prompt_tokens, num_tokens AS response_tokens,
    image_bits + text_bits AS total_surprisal_bits, (image_bits + text_bits) * {LN2!r}::DOUBLE AS total_surprisal_nats,
    coalesce((image_bits + text_bits) / nullif(num_tokens, 0), 0) AS avg_surprisal_bits,
    coalesce((image_bits + text_bits) / nullif(num_tokens, 0), 0) * {LN2!r}::DOUBLE AS avg_surprisal_nats,
    num_tokens, num_image_tokens, num_tokens - num_image_tokens AS num_text_tokens,
    image_bits AS image_surprisal_bits, text_bits AS text_surprisal_bits, assistant_len, coalesce(system_len, -1) AS system_len
  FROM stats)"""
RECORD_CTES = (*COUNT_CTES, SQL_RECORDS)
RECORD_NAMES = [
    f"{part}_surprisal_{unit}" for part, unit in (("total", "bits"), ("total", "nats"), ("avg", "bits"), ("avg", "nats"), ("image", "bits"), ("text", "bits"))
]
SQL_ALL_RECORDS = sql_rounded("SELECT * FROM recs", *RECORD_NAMES)


@query("surprisal_records", fx.with_ctes(*RECORD_CTES, select=SQL_ALL_RECORDS))
def surprisal_records(spark, sf):
    return rounded(records(spark, sf)).withColumn("system_len", F.coalesce("system_len", F.lit(-1)))


@query(
    "surprisal_totals",
    fx.with_ctes(
        *RECORD_CTES,
        select=sql_rounded("""SELECT count(*) AS samples, sum(num_tokens)::BIGINT AS total_tokens,
  sum((image_bits + text_bits)::DECIMAL(38, 15))::DOUBLE AS total_surprisal_bits, sum(image_bits::DECIMAL(38, 15))::DOUBLE AS image_bits_total,
  sum(text_bits::DECIMAL(38, 15))::DOUBLE AS text_bits_total FROM stats""", *TOTAL_NAMES),
    ),
)
def surprisal_totals(spark, sf):
    return rounded(surprisal.run_totals(records(spark, sf)))


@query(
    "surprisal_by_source",
    fx.with_ctes(*RECORD_CTES, select=sql_rounded(f"SELECT source, {SQL_SUMMARY_FIELDS} FROM stats GROUP BY source", *SUMMARY_NAMES)),
)
def surprisal_by_source(spark, sf):
    return rounded(surprisal.run_summary(records(spark, sf), ["source"]))


@query("sink_jsonl", fx.with_ctes(*RECORD_CTES, select=SQL_ALL_RECORDS))
def sink_jsonl(spark, sf):
    """Write the records as JSON lines, nulls kept, and read them back."""
    out = records(spark, sf)
    folder = scratch_path(spark, "records")
    files.write_jsonl(out, folder)
    back = rounded(spark.read.schema(out.schema).json(folder))
    return back.withColumn("system_len", F.coalesce("system_len", F.lit(-1)))


# --- adapters ---------------------------------------------------------------


@query(
    "adapter_params",
    fx.with_ctes(
        fx.SQL_WIDTH,
        select="""SELECT width, rank, (width * rank)::BIGINT AS params
FROM width CROSS JOIN (VALUES (8), (16), (32), (64)) AS r(rank)""",
    ),
)
def adapter_params(spark, sf):
    return surprisal.adapter_params(fx.modules(spark, sf), SUFFIXES, FRAGMENTS, RANKS)


@query(
    "adapter_capacity",
    fx.with_ctes(
        *RECORD_CTES,
        fx.SQL_WIDTH,
        select="""SELECT rank, (width * rank)::BIGINT AS params, round(bits, 6) AS total_bits, (width * rank * 2)::DOUBLE AS capacity_bits,
  round(bits / (width * rank * 2), 9) AS load, ceil(bits / (width * 2))::BIGINT AS min_rank
FROM width CROSS JOIN (SELECT sum((image_bits + text_bits)::DECIMAL(38, 15))::DOUBLE AS bits FROM stats)
CROSS JOIN (VALUES (8), (16), (32), (64)) AS r(rank)""",
    ),
)
def adapter_capacity(spark, sf):
    params = surprisal.adapter_params(fx.modules(spark, sf), SUFFIXES, FRAGMENTS, RANKS)
    bits = surprisal.run_totals(records(spark, sf)).select("total_surprisal_bits").scalar()
    out = surprisal.adapter_capacity(params, bits)
    return out.select(
        "rank",
        "params",
        F.round("total_bits", 6).alias("total_bits"),
        "capacity_bits",
        F.round("load", 9).alias("load"),
        "min_rank",
    )


@query(
    "sink_run_meta",
    fx.with_ctes(
        *RECORD_CTES,
        fx.SQL_WIDTH,
        select=f"""SELECT dataset, config, split, samples, total_tokens, round(total_surprisal_bits, 6) AS total_surprisal_bits, round(mean_bits_per_token, 6) AS mean_bits_per_token, '{TIMESTAMP}' AS timestamp, '{MODEL}' AS model, 0::BIGINT AS skip,
  concat(dataset, '_', config, '_', split, '_{TIMESTAMP}.jsonl') AS output_file, width * 16 AS params_16
FROM (SELECT dataset, config, split, {SQL_SUMMARY_FIELDS} FROM stats GROUP BY dataset, config, split) CROSS JOIN width""",
    ),
)
def sink_run_meta(spark, sf):
    """Write run metadata, one object per run, and read it back."""
    summary = surprisal.run_summary(records(spark, sf), ["dataset", "config", "split"])
    params = surprisal.params_map(surprisal.adapter_params(fx.modules(spark, sf), SUFFIXES, FRAGMENTS, RANKS))
    meta = surprisal.run_metadata(summary, TIMESTAMP, MODEL, params=params.scalar())
    folder = scratch_path(spark, "run-meta")
    files.write_jsonl(meta, folder)
    back = rounded(spark.read.schema(meta.schema).json(folder))
    return back.select(
        "dataset",
        "config",
        "split",
        "samples",
        "total_tokens",
        "total_surprisal_bits",
        "mean_bits_per_token",
        "timestamp",
        "model",
        "skip",
        "output_file",
        F.col("lora_param_counts")["16"].alias("params_16"),
    )
