"""Queries over predictions, logs, embeddings and uid caches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visloom.functions.answers import true_false
from visloom.functions.text import PAIR_PROMPT
from visloom.operators import evaluation, uid_cache, vector_search
from visloom.operators.terms import runs, term_slices
from visloom.plans import fixtures as fx
from visloom.plans.registry import query
from visloom.plans.surprisal_queries import rounded
from visloom.session import scratch_path
from visloom.sinks import files
from visloom.sinks.versioned import StoredCache

TERMS = ["the", "that", "und", "les"]


def _judged(spark, sf) -> DataFrame:
    return evaluation.with_verdict(
        evaluation.join_predictions(fx.predictions(spark, sf), fx.gold(spark, sf))
    )


@query("predictions_join", fx.with_ctes(fx.SQL_JUDGED, select="SELECT uid, run, response, label FROM judged"))
def predictions_join(spark, sf):
    joined = evaluation.join_predictions(fx.predictions(spark, sf), fx.gold(spark, sf))
    return joined.select("uid", "run", "response", "label")


@query(
    "answer_parse",
    fx.with_ctes(fx.SQL_JUDGED, select="SELECT uid, run, response, coalesce(pred, '(none)') AS pred FROM judged"),
)
def answer_parse(spark, sf):
    return fx.predictions(spark, sf).select(
        "uid", "run", "response", F.coalesce(true_false(F.col("response")), F.lit("(none)")).alias("pred")
    )


@query(
    "accuracy",
    fx.with_ctes(
        fx.SQL_JUDGED,
        select="""SELECT run, domain, count(*) AS n, count(*) FILTER (WHERE correct) AS n_correct,
  count(*) FILTER (WHERE pred IS NULL) AS unparsed,
  count(*) FILTER (WHERE label = 'True' AND pred = 'True') AS tp, count(*) FILTER (WHERE label = 'False' AND pred = 'True') AS fp,
  count(*) FILTER (WHERE label = 'False' AND pred = 'False') AS tn, count(*) FILTER (WHERE label = 'True' AND pred = 'False') AS fn,
  round(avg(correct::INT::DOUBLE), 6) AS accuracy FROM judged GROUP BY run, domain""",
    ),
)
def accuracy(spark, sf):
    return rounded(evaluation.accuracy(_judged(spark, sf), ["run", "domain"]))


@query(
    "ablation_delta",
    fx.with_ctes(
        fx.SQL_JUDGED,
        select="""SELECT count(*) AS n, round(avg(b::DOUBLE), 6) AS base_accuracy, round(avg(v::DOUBLE), 6) AS variant_accuracy,
  count(*) FILTER (WHERE v > b) AS wins, count(*) FILTER (WHERE v < b) AS losses,
  round(avg(v::DOUBLE) - avg(b::DOUBLE), 6) AS delta
FROM (SELECT x.correct::INT AS b, y.correct::INT AS v FROM judged x JOIN judged y ON x.uid = y.uid
      WHERE x.run = 'baseline' AND y.run = 'tools')""",
    ),
)
def ablation_delta(spark, sf):
    return rounded(evaluation.ablation(_judged(spark, sf), "baseline", "tools"))


@query(
    "hard_subset",
    fx.with_ctes(
        fx.SQL_JUDGED,
        select="""SELECT uid, count(*) AS attempts, round(avg(correct::INT::DOUBLE), 6) AS pass_rate FROM judged
GROUP BY uid HAVING avg(correct::INT::DOUBLE) <= 0.5""",
    ),
)
def hard_subset(spark, sf):
    return rounded(evaluation.hard_subset(_judged(spark, sf)))


SQL_TERMS = ", ".join(f"('{t}')" for t in TERMS)


@query(
    "term_slice",
    rf"""SELECT 'documents' AS kind, doc_id AS id, term FROM documents CROSS JOIN (VALUES {SQL_TERMS}) AS t(term)
WHERE regexp_matches(text, concat('(?i)(^|[^\pL\pN_])', term, '($|[^\pL\pN_])'))
UNION ALL
SELECT 'benchmark', item_id, term FROM benchmark CROSS JOIN (VALUES {SQL_TERMS}) AS t(term)
WHERE regexp_matches(text, concat('(?i)(^|[^\pL\pN_])', term, '($|[^\pL\pN_])'))""",
)
def term_slice(spark, sf):
    docs = fx.table(spark, sf, "documents").select(
        F.lit("documents").alias("kind"), F.col("doc_id").alias("id"), "text"
    )
    items = fx.table(spark, sf, "benchmark").select(
        F.lit("benchmark").alias("kind"), F.col("item_id").alias("id"), "text"
    )
    return term_slices(docs.unionByName(items), "text", TERMS).select("kind", "id", "term")


def _sql_runs(name: str, table: str, key: str) -> str:
    """The runs of one to four words in each text, with what stands between the words."""
    word = lambda at: f"regexp_matches(tok[{at}], '^[\\pL\\pN_]')"
    sizes = " UNION ALL ".join(
        f"""SELECT id, unnest([array_to_string(tok[i:i + {n - 1}], '') FOR i IN range(1, len(tok) - {n - 2})
    IF {word('i')} AND {word(f'i + {n - 1}')}]) AS term FROM {name}_tokens"""
        for n in (1, 3, 5, 7)
    )
    return f"""{name}_tokens AS (
  SELECT {key} AS id, regexp_extract_all(lower(text), '[\\pL\\pN_]+|[^\\pL\\pN_]') AS tok FROM {table}),
{name} AS (SELECT DISTINCT id, term FROM ({sizes}))"""


@query(
    "term_table",
    fx.with_ctes(
        _sql_runs("asked", "benchmark", "item_id"),
        _sql_runs("said", "documents", "doc_id"),
        select="""SELECT term, count(*) AS documents FROM said WHERE term IN (SELECT term FROM asked) GROUP BY term""",
    ),
)
def term_table(spark, sf):
    """Documents per term, for all runs of one to four words of the benchmark as terms."""
    words = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(True).alias("head"), F.lit(True).alias("tail")) for n in (1, 3, 5, 7)])
    terms = fx.table(spark, sf, "benchmark").select(F.explode(runs(F.col("text"), words)).alias("term")).distinct()
    met = term_slices(fx.table(spark, sf, "documents").select("doc_id", "text"), "text", terms)
    return met.groupBy("term").agg(F.count(F.lit(1)).alias("documents"))


@query(
    "apply_corrections",
    fx.with_ctes(
        fx.SQL_JUDGED,
        select="""SELECT uid, run, coalesce(pred, '(none)') AS pred,
  CASE WHEN doc_id % 10 = 0 THEN 'True' ELSE coalesce(pred, '(none)') END AS final, doc_id % 10 = 0 AS was_corrected FROM judged""",
    ),
)
def apply_corrections(spark, sf):
    """Two revisions for every tenth document; the second one counts."""
    revisions = F.array(
        F.struct(F.lit(1).alias("revision"), F.lit("False").alias("corrected")),
        F.struct(F.lit(2).alias("revision"), F.lit("True").alias("corrected")),
    )
    predictions = fx.predictions(spark, sf)
    corrections = predictions.where(F.col("doc_id") % 10 == 0).select("uid", "run", F.inline(revisions))
    judged = predictions.withColumn("pred", true_false(F.col("response"))).select("uid", "run", "pred")
    out = evaluation.apply_corrections(judged, corrections, ["uid", "run"])
    missing = F.lit("(none)")
    return out.select(
        "uid",
        "run",
        F.coalesce("pred", missing).alias("pred"),
        F.coalesce("final", missing).alias("final"),
        "was_corrected",
    )


# --- logs -------------------------------------------------------------------

QUESTION = PAIR_PROMPT.split("\n")[0]


def _log(spark, sf) -> DataFrame:
    from_dataset = F.col("doc_id") % 4 != 0
    generated = fx.predictions(spark, sf).select(
        F.lit(QUESTION).alias("question"),
        F.lit(None).cast("string").alias("system"),
        F.lit(0.0).alias("temperature"),
        F.lit(1.0).alias("top_p"),
        F.lit(64).alias("max_new_tokens"),
        "response",
        F.to_json(F.struct("domain", "run")).alias("metadata"),
        F.when(from_dataset, F.col("uid")).alias("uid"),
        F.when(from_dataset, F.col("doc_id")).alias("index"),
        F.lit("validation").alias("split"),
        F.when(~from_dataset, F.array(F.concat("doc_id", F.lit(".png")))).alias("images"),
    )
    return evaluation.generation_log(generated)


SQL_LOG = f"""log AS (
  SELECT '{QUESTION}' AS question, 0.0::DOUBLE AS temperature, 1.0::DOUBLE AS top_p, 64 AS max_new_tokens, response,
    concat('{{"domain":"', domain, '","run":"', run, '"}}') AS metadata,
    CASE WHEN doc_id % 4 <> 0 THEN uid ELSE '' END AS uid, CASE WHEN doc_id % 4 <> 0 THEN doc_id ELSE -1 END AS index,
    CASE WHEN doc_id % 4 <> 0 THEN 'validation' ELSE '' END AS split,
    CASE WHEN doc_id % 4 = 0 THEN concat(doc_id, '.png') ELSE '' END AS images FROM judged)"""


def _flat_log(log: DataFrame) -> DataFrame:
    empty = F.lit("")
    return log.select(
        "question",
        "temperature",
        "top_p",
        "max_new_tokens",
        "response",
        "metadata",
        F.coalesce("uid", empty).alias("uid"),
        F.coalesce("index", F.lit(-1)).alias("index"),
        F.coalesce("split", empty).alias("split"),
        F.coalesce(F.array_join("images", ","), empty).alias("images"),
    )


@query("generation_log", fx.with_ctes(fx.SQL_JUDGED, SQL_LOG, select="SELECT * FROM log"))
def generation_log(spark, sf):
    return _flat_log(_log(spark, sf))


@query(
    "sink_append_log",
    fx.with_ctes(fx.SQL_JUDGED, SQL_LOG, select="SELECT * FROM log UNION ALL SELECT * FROM log"),
)
def sink_append_log(spark, sf):
    """Append the log twice and read all of it back."""
    log = _log(spark, sf)
    folder = scratch_path(spark, "log")
    files.append_log(log, folder)
    files.append_log(log, folder)
    return _flat_log(spark.read.schema(log.schema).json(folder))


# --- embeddings -------------------------------------------------------------


@query(
    "embedding_topk",
    """WITH dims AS (
  SELECT vec_id, label, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS d FROM embeddings),
texts AS (
  SELECT label AS text_id, list(m ORDER BY d) AS v FROM (SELECT label, d, round(avg(x), 6) AS m FROM dims GROUP BY label, d) GROUP BY label),
scored AS (
  SELECT text_id, vec_id AS image_id, list_sum(list_transform(range(1, len(v) + 1), lambda i: v[i] * embedding[i]::DOUBLE)) AS score
  FROM embeddings CROSS JOIN texts)
SELECT text_id, image_id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY score DESC, image_id)::INT AS rank FROM scored) WHERE rank <= 5""",
)
def embedding_topk(spark, sf):
    """The five images nearest to each class, a class being described by its mean vector."""
    vectors = fx.table(spark, sf, "embeddings")
    means = (
        vectors.select("label", F.posexplode("embedding").alias("d", "x"))
        .groupBy("label", "d")
        .agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("m"))
        .groupBy("label")
        .agg(F.array_sort(F.collect_list(F.struct("d", "m"))).alias("dims"))
        .select(F.col("label").alias("text_id"), F.transform("dims", lambda e: e["m"]).alias("vector"))
    )
    images = vectors.select(F.col("vec_id").alias("image_id"), F.col("embedding").cast("array<double>").alias("vector"))
    return rounded(vector_search.embedding_topk(images, means, 5))


# --- uid caches -------------------------------------------------------------

SQL_TEXTS = """texts AS (
  SELECT conv_id, turn, CASE turn % 5
      WHEN 0 THEN concat('["dev-', conv_id, '", "dev-', turn, '", "dev-', conv_id, '"]')
      WHEN 1 THEN '{}' WHEN 2 THEN 'not json' WHEN 3 THEN concat('[', conv_id, ', ', turn, ', "x", null]') ELSE '' END AS text
  FROM conversations)"""


@query(
    "uid_cache_load",
    fx.with_ctes(
        SQL_TEXTS,
        """items AS (
  SELECT conv_id, turn, i, uid FROM (
    SELECT conv_id, turn, unnest(u) AS uid, unnest(range(len(u))) AS i FROM (
      SELECT conv_id, turn, CASE WHEN turn % 5 IN (0, 3) THEN from_json(text, '["VARCHAR"]') ELSE []::VARCHAR[] END AS u FROM texts))
  WHERE uid IS NOT NULL)""",
        select="""SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1)::INT AS position, uid
FROM items""",
    ),
)
def uid_cache_load(spark, sf):
    """One stored cache per turn: lists with repeats and numbers, objects, garbage, empty text."""
    turn = F.col("turn")
    conv, number = F.col("conv_id").cast("string"), turn.cast("string")
    text = (
        F.when(turn % 5 == 0, F.format_string('["dev-%s", "dev-%s", "dev-%s"]', conv, number, conv))
        .when(turn % 5 == 1, "{}")
        .when(turn % 5 == 2, "not json")
        .when(turn % 5 == 3, F.format_string('[%s, %s, "x", null]', conv, number))
        .otherwise("")
    )
    stored = fx.table(spark, sf, "conversations").select("conv_id", "turn", text.alias("text"))
    return uid_cache.cache_from_text(stored)


SQL_EXTENDED = """extended AS (
  SELECT position, uid FROM cache
  UNION ALL
  SELECT (SELECT count(*) FROM cache) + row_number() OVER (ORDER BY p) - 1, uid
  FROM (SELECT uid, min(pos) AS p FROM arrivals WHERE uid NOT IN (SELECT uid FROM cache) GROUP BY uid))"""


@query("cache_extend", fx.with_ctes(fx.SQL_CACHE, fx.SQL_ARRIVALS, SQL_EXTENDED, select="SELECT position, uid FROM extended"))
def cache_extend(spark, sf):
    return uid_cache.cache_extend(fx.uid_cache(spark, sf), fx.uid_arrivals(spark, sf))


@query(
    "uid_cache_save",
    fx.with_ctes(fx.SQL_CACHE, fx.SQL_ARRIVALS, SQL_EXTENDED, select="SELECT position, uid FROM extended"),
)
def uid_cache_save(spark, sf):
    """The cache as a versioned table: the arrivals are written as a change of their own."""
    cache = StoredCache(spark, scratch_path(spark, "uid-cache"))
    cache.load(fx.uid_cache(spark, sf))
    cache.extend(fx.uid_arrivals(spark, sf))
    return cache.read()


@query(
    "uid_cache_versions",
    fx.with_ctes(
        fx.SQL_CACHE,
        fx.SQL_ARRIVALS,
        SQL_EXTENDED,
        select="""SELECT 'extended' AS state, position, uid FROM extended
UNION ALL
SELECT 'removed', row_number() OVER (ORDER BY position) - 1, uid FROM extended
WHERE uid NOT IN (SELECT concat('dev-', doc_id, '-0-0') FROM labels WHERE toxic = 1)""",
    ),
)
def uid_cache_versions(spark, sf):
    """An older version read beside the newest, after removals and a merge of the changes."""
    cache = StoredCache(spark, scratch_path(spark, "uid-cache"))
    cache.load(fx.uid_cache(spark, sf))
    extended = cache.extend(fx.uid_arrivals(spark, sf))
    cache.remove(_toxic_uids(spark, sf))
    cache.table.compact()
    state = lambda name: F.lit(name).alias("state")
    return cache.read(extended).select(state("extended"), "position", "uid").unionByName(
        cache.read().select(state("removed"), "position", "uid")
    )


def _toxic_uids(spark, sf) -> DataFrame:
    toxic = fx.table(spark, sf, "labels").where(F.col("toxic") == 1)
    return toxic.select(F.concat(F.lit("dev-"), F.col("doc_id").cast("string"), F.lit("-0-0")).alias("uid"))


@query(
    "cache_remove",
    """SELECT row_number() OVER (ORDER BY doc_id) - 1 AS position, concat('dev-', doc_id, '-0-0') AS uid
FROM labels WHERE toxic = 0""",
)
def cache_remove(spark, sf):
    """Take the toxic documents out of the cache."""
    return uid_cache.cache_remove(fx.uid_cache(spark, sf), _toxic_uids(spark, sf))


@query(
    "cache_members",
    fx.with_ctes(
        fx.SQL_CACHE, fx.SQL_ARRIVALS,
        select="SELECT pos, uid, uid IN (SELECT uid FROM cache) AS cached FROM arrivals",
    ),
)
def cache_members(spark, sf):
    cache, arrivals = fx.uid_cache(spark, sf), fx.uid_arrivals(spark, sf)
    inside = uid_cache.members(arrivals, cache).withColumn("cached", F.lit(True))
    outside = uid_cache.non_members(arrivals, cache).withColumn("cached", F.lit(False))
    return inside.unionByName(outside).select("pos", "uid", "cached")


@query(
    "cache_get",
    fx.with_ctes(
        fx.SQL_CACHE,
        select="""SELECT r.event_id, r.index, c.uid FROM (SELECT event_id, event_id * 3 - 5000 AS index FROM events) r
JOIN cache c ON c.position = ((r.index % n.n) + n.n) % n.n""".replace(
            "JOIN cache c", "CROSS JOIN (SELECT count(*) AS n FROM cache) n JOIN cache c"
        ),
    ),
)
def cache_get(spark, sf):
    asked = fx.table(spark, sf, "events").select("event_id", (F.col("event_id") * 3 - 5000).alias("index"))
    return uid_cache.cache_get_many(fx.uid_cache(spark, sf), asked).select("event_id", "index", "uid")


@query("cache_list", fx.with_ctes(fx.SQL_CACHE, select="SELECT position, uid FROM cache"))
def cache_list(spark, sf):
    return uid_cache.cache_list(fx.uid_cache(spark, sf))


@query(
    "cache_cycle",
    fx.with_ctes(
        fx.SQL_CACHE,
        select="""SELECT s.step, c.uid FROM (SELECT unnest(range(2 * n + 3)) AS step, n FROM (SELECT count(*) AS n FROM cache)) s
JOIN cache c ON c.position = ((SELECT position + 1 FROM cache WHERE uid = 'dev-1-0-0') + s.step) % s.n""",
    ),
)
def cache_cycle(spark, sf):
    """A little more than two rounds, starting after one uid."""
    cache = fx.uid_cache(spark, sf)
    steps = cache.agg(F.count(F.lit(1)) * 2 + 3).scalar()
    return uid_cache.cache_cycle(cache, steps, start="dev-1-0-0")
