"""Queries over image pairs: normalising, sampling, lookups, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visloom.functions import chat
from visloom.functions import text as tx
from visloom.functions.images import image_size, png_header, png_size
from visloom.operators import lookup, pairs, sampling
from visloom.plans import fixtures as fx
from visloom.plans.flows import evaluation_run
from visloom.plans.registry import query
from visloom.session import scratch_path
from visloom.sinks import files
from visloom.sources import stored_index
from visloom.sources.scan import first_available, image_files

PAIRS = fx.PAIRS_CTES


def normalized(spark, sf, **options) -> DataFrame:
    return pairs.normalize_pairs(fx.pairs_raw(spark, sf), split=fx.SPLIT, strict=False, **options)


@query(
    "source_fallback",
    "SELECT doc_id, lang, source, n_chars FROM documents",
)
def source_fallback(spark, sf):
    candidates = [f"{sf}/absent.parquet", f"{sf}/labels.parquet", f"{sf}/documents.parquet"]
    return first_available(spark, candidates, ["doc_id", "lang", "source", "n_chars"])


@query(
    "split_union",
    fx.with_ctes(
        fx.SQL_RAW,
        select=f"""SELECT split, count(*) AS n, count(DISTINCT uid) AS n_uids FROM (
  SELECT CASE WHEN doc_id % 4 = 0 THEN 'validation' ELSE 'train' END AS split,
    coalesce(nullif(raw_uid, ''), nullif(identifier, ''), id,
      concat(CASE WHEN doc_id % 4 = 0 THEN 'validation' ELSE 'train' END, '-', substr(md5(sentence), 1, 8))) AS uid
  FROM raw WHERE NOT missing AND lower(trim(label)) IN ('true', 'false')) GROUP BY split""",
    ),
)
def split_union(spark, sf):
    raw = fx.pairs_raw(spark, sf)
    validation = F.col("doc_id") % 4 == 0
    splits = pairs.pair_splits(
        ("train", raw.where(~validation)), ("validation", raw.where(validation)), strict=False
    )
    merged = pairs.split_union(splits)
    return merged.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("uid").alias("n_uids")
    )


@query(
    "image_layout",
    fx.with_ctes(
        fx.SQL_RAW,
        select="""SELECT doc_id, 2 AS n_images, concat('img/', doc_id, '-0.png') AS first_path,
  CASE WHEN NOT missing THEN concat('img/', doc_id, '-1.png') ELSE '' END AS second_path FROM raw""",
    ),
)
def image_layout(spark, sf):
    images = fx.pairs_raw(spark, sf).select("doc_id", pairs.pair_images().alias("images"))
    return images.select(
        "doc_id",
        F.size("images").alias("n_images"),
        F.get("images", 0)["path"].alias("first_path"),
        F.coalesce(F.get("images", 1)["path"], F.lit("")).alias("second_path"),
    )


@query(
    "reject_missing_image",
    fx.with_ctes(fx.SQL_RAW, fx.SQL_KEYED, select="SELECT doc_id, reason FROM keyed WHERE reason IS NOT NULL"),
)
def reject_missing_image(spark, sf):
    return pairs.rejected_pairs(fx.pairs_raw(spark, sf)).select("doc_id", "reason")


@query(
    "uid_coalesce",
    fx.with_ctes(
        fx.SQL_RAW,
        select="""SELECT doc_id, coalesce(nullif(raw_uid, ''), nullif(identifier, ''), id, '(none)') AS uid FROM raw""",
    ),
)
def uid_coalesce(spark, sf):
    uid = tx.example_uid(F.col("uid"), F.col("identifier"), F.col("id"))
    return fx.pairs_raw(spark, sf).select("doc_id", F.coalesce(uid, F.lit("(none)")).alias("uid"))


@query(
    "uid_fallback",
    fx.with_ctes(
        fx.SQL_RAW, select="SELECT doc_id, concat('dev-', substr(md5(sentence), 1, 8)) AS fallback FROM raw"
    ),
)
def uid_fallback(spark, sf):
    fallback = tx.fallback_uid(F.lit(fx.SPLIT), F.col("sentence"))
    return fx.pairs_raw(spark, sf).select("doc_id", fallback.alias("fallback"))


@query(
    "label_normalize",
    fx.with_ctes(
        fx.SQL_RAW,
        select="""SELECT doc_id, CASE lower(trim(label)) WHEN 'true' THEN 'True' WHEN 'false' THEN 'False'
  ELSE '(rejected)' END AS label FROM raw""",
    ),
)
def label_normalize(spark, sf):
    label = F.coalesce(tx.clean_label(F.col("label")), F.lit("(rejected)"))
    return fx.pairs_raw(spark, sf).select("doc_id", label.alias("label"))


@query(
    "sentence_strip",
    fx.with_ctes(fx.SQL_RAW, select=f"SELECT doc_id, {fx.sql_strip('sentence')} AS sentence FROM raw"),
)
def sentence_strip(spark, sf):
    return fx.pairs_raw(spark, sf).select("doc_id", tx.strip(F.col("sentence")).alias("sentence"))


SQL_PROMPT = tx.PAIR_PROMPT.replace("\n", "' || chr(10) || '")


@query(
    "prompt_format",
    fx.with_ctes(
        fx.SQL_RAW,
        select=f"SELECT doc_id, replace('{SQL_PROMPT}', '{{statement}}', {fx.sql_strip('sentence')}) AS prompt FROM raw",
    ),
)
def prompt_format(spark, sf):
    return fx.pairs_raw(spark, sf).select("doc_id", tx.pair_prompt(F.col("sentence")).alias("prompt"))


SQL_PLACES = """placed AS (
  SELECT *, md5(concat('42:', uid, ':1')) < md5(concat('42:', uid, ':0')) AS swapped FROM pairs)"""


@query(
    "image_order",
    fx.with_ctes(
        *PAIRS,
        SQL_PLACES,
        select="""SELECT doc_id, uid, concat('img/', doc_id, CASE WHEN swapped THEN '-1.png' ELSE '-0.png' END) AS first_path,
  slot0 AS first_slot, CASE WHEN swapped THEN slot1 ELSE slot0 END AS first_origin FROM placed""",
    ),
)
def image_order(spark, sf):
    info = F.get("metadata.images", 0)
    return normalized(spark, sf, randomize_order=True).select(
        "doc_id",
        "uid",
        F.get("images", 0)["path"].alias("first_path"),
        info["slot"].alias("first_slot"),
        info["origin_slot"].alias("first_origin"),
    )


SQL_INFO = """SELECT doc_id, uid, i AS idx, CASE i WHEN 0 THEN slot0 ELSE slot1 END AS slot,
  CASE i WHEN 0 THEN w0 ELSE w1 END AS width, CASE i WHEN 0 THEN h0 ELSE h1 END AS height,
  coalesce(CASE i WHEN 0 THEN f0 ELSE f1 END, '') AS filename
FROM pairs CROSS JOIN (VALUES (0), (1)) AS v(i)"""


@query("image_info", fx.with_ctes(*PAIRS, select=SQL_INFO))
def image_info(spark, sf):
    info = normalized(spark, sf).select("doc_id", "uid", F.posexplode("metadata.images").alias("idx", "image"))
    return info.select(
        "doc_id",
        "uid",
        "idx",
        "image.slot",
        "image.width",
        "image.height",
        F.coalesce("image.filename", F.lit("")).alias("filename"),
    )


@query(
    "pair_metadata",
    fx.with_ctes(
        *PAIRS,
        select="""SELECT doc_id, uid, coalesce(identifier, '') AS identifier, 'dev' AS split, sentence,
  label AS label_raw, 2 AS n_images FROM pairs""",
    ),
)
def pair_metadata(spark, sf):
    return normalized(spark, sf).select(
        "doc_id",
        "metadata.uid",
        F.coalesce("metadata.identifier", F.lit("")).alias("identifier"),
        "metadata.split",
        "metadata.sentence",
        "metadata.label_raw",
        F.size("metadata.images").alias("n_images"),
    )


@query(
    "pair_normalize",
    fx.with_ctes(
        *PAIRS,
        select=f"""SELECT doc_id, uid, clean AS sentence, label_text AS label,
  replace('{SQL_PROMPT}', '{{statement}}', clean) AS prompt,
  concat('img/', doc_id, '-0.png,img/', doc_id, '-1.png') AS paths,
  concat(slot0, ':', w0, 'x', h0, ',', slot1, ':', w1, 'x', h1) AS info FROM pairs""",
    ),
)
def pair_normalize(spark, sf):
    sizes = F.transform(
        "metadata.images",
        lambda m: F.concat(
            m["slot"], F.lit(":"), m["width"].cast("string"), F.lit("x"), m["height"].cast("string")
        ),
    )
    return normalized(spark, sf).select(
        "doc_id",
        "uid",
        "sentence",
        "label",
        "prompt",
        F.array_join(F.transform("images", lambda i: i["path"]), ",").alias("paths"),
        F.array_join(sizes, ",").alias("info"),
    )


@query(
    "sample_summary",
    fx.with_ctes(
        *PAIRS,
        select="""SELECT uid, label_text AS label, clean AS sentence, 2 AS n_images, w0 AS first_width,
  NULL::VARCHAR AS left_url, NULL::VARCHAR AS right_url FROM pairs""",
    ),
)
def sample_summary(spark, sf):
    return pairs.sample_summary(normalized(spark, sf)).select(
        "uid",
        "label",
        "sentence",
        F.size("image_info").alias("n_images"),
        F.get("image_info", 0)["width"].alias("first_width"),
        "left_url",
        "right_url",
    )


@query(
    "gallery_summary",
    fx.with_ctes(
        *PAIRS, select="SELECT uid, label_text AS label, clean AS sentence, label AS label_raw FROM pairs"
    ),
)
def gallery_summary(spark, sf):
    return pairs.gallery_summary(normalized(spark, sf)).select("uid", "label", "sentence", "metadata.label_raw")


# --- positions, shuffles, samples -------------------------------------------


@query("global_index", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS index FROM documents")
def global_index(spark, sf):
    return fx.indexed(spark, sf, "documents", "doc_id")


@query(
    "shuffle_full",
    fx.with_ctes(
        fx.SQL_RAW,
        fx.SQL_KEYED,
        select="SELECT idx AS index, uid, row_number() OVER (ORDER BY md5(concat('42:', idx)), idx) - 1 AS position FROM keyed",
    ),
)
def shuffle_full(spark, sf):
    return sampling.shuffle(fx.pair_keys(spark, sf)).select("index", "uid", "position")


@query(
    "evaluation_flow",
    fx.with_ctes(
        *PAIRS,
        """answers AS (
  SELECT label_text AS label, CASE WHEN idx % 11 = 0 THEN NULL WHEN idx % 3 = 0 THEN 'False' ELSE 'True' END AS pred
  FROM pairs WHERE idx IN (SELECT idx FROM keyed ORDER BY md5(concat('42:', idx)), idx LIMIT 512))""",
        select="""SELECT count(*) AS n, count(*) FILTER (WHERE pred = label) AS n_correct, count(*) FILTER (WHERE pred IS NULL) AS unparsed,
  count(*) FILTER (WHERE label = 'True' AND pred = 'True') AS tp, count(*) FILTER (WHERE label = 'False' AND pred = 'True') AS fp,
  count(*) FILTER (WHERE label = 'False' AND pred = 'False') AS tn, count(*) FILTER (WHERE label = 'True' AND pred = 'False') AS fn,
  round(avg(coalesce(pred = label, false)::INT::DOUBLE), 6) AS accuracy FROM answers""",
    ),
)
def evaluation_flow(spark, sf):
    """A shuffled slice answered by a stand-in, judged, written and read back."""
    index = F.col("index")
    answer = F.when(index % 11 == 0, "unsure").when(index % 3 == 0, "I say FALSE.").otherwise("true")
    _, accuracy = evaluation_run(
        fx.pairs_raw(spark, sf),
        lambda pairs: pairs.select("position", answer.alias("response")),
        scratch_path(spark, "evaluation"),
        split=fx.SPLIT,
    )
    return accuracy.withColumn("accuracy", F.round("accuracy", 6))


BUFFER = 256
SQL_BUFFERED = f"""buffered AS (
  SELECT *, (idx // {BUFFER}) * {BUFFER}
    + row_number() OVER (PARTITION BY idx // {BUFFER} ORDER BY md5(concat('42:', idx)), idx) - 1 AS position FROM keyed)"""


@query(
    "shuffle_buffered",
    fx.with_ctes(fx.SQL_RAW, fx.SQL_KEYED, SQL_BUFFERED, select="SELECT idx AS index, uid, position FROM buffered"),
)
def shuffle_buffered(spark, sf):
    return sampling.shuffle(fx.pair_keys(spark, sf), buffer=BUFFER).select("index", "uid", "position")


@query(
    "take_n",
    fx.with_ctes(
        fx.SQL_RAW,
        fx.SQL_KEYED,
        SQL_BUFFERED,
        select=f"""SELECT position, uid, {fx.sql_strip('sentence')} AS sentence FROM buffered
WHERE position < 256 AND reason IS NULL""",
    ),
)
def take_n(spark, sf):
    """Shuffle, take, then normalise: the cheap steps see every row, the costly one 256."""
    raw = fx.pairs_raw(spark, sf)
    order = sampling.take(sampling.shuffle(raw.select("index"), buffer=BUFFER), 256)
    taken = pairs.normalize_pairs(raw.join(order, "index"), split=fx.SPLIT, strict=False)
    return taken.select("position", "uid", "sentence")


@query(
    "materialize",
    fx.with_ctes(fx.SQL_RAW, fx.SQL_KEYED, select="SELECT idx AS index, uid FROM keyed WHERE idx < 256"),
)
def materialize(spark, sf):
    return sampling.materialize(fx.pair_keys(spark, sf), 256, lazy=True).select("index", "uid")


@query(
    "sample_n",
    fx.with_ctes(
        fx.SQL_RAW,
        fx.SQL_KEYED,
        select="SELECT idx AS index, uid FROM keyed ORDER BY md5(concat('42:', idx)), idx LIMIT 64",
    ),
)
def sample_n(spark, sf):
    return sampling.sample_n(fx.pair_keys(spark, sf), 64).select("index", "uid")


# --- lookups ----------------------------------------------------------------


@query(
    "uid_index",
    fx.with_ctes(fx.SQL_RAW, fx.SQL_KEYED, select="SELECT uid, max(idx) AS index FROM keyed GROUP BY uid"),
)
def uid_index(spark, sf):
    return lookup.uid_index(fx.pair_keys(spark, sf))


@query(
    "uid_lookup",
    fx.with_ctes(
        fx.SQL_RAW,
        fx.SQL_KEYED,
        select="SELECT idx AS index, uid, sentence FROM keyed WHERE uid = 'dev-2-0-0' ORDER BY idx LIMIT 1",
    ),
)
def uid_lookup(spark, sf):
    uid = F.coalesce(
        tx.example_uid(F.col("uid"), F.col("identifier"), F.col("id")),
        tx.fallback_uid(F.lit(fx.SPLIT), F.col("sentence")),
    )
    keyed = fx.pairs_raw(spark, sf).select("index", uid.alias("uid"), "sentence")
    return lookup.find_by_uid(keyed, "dev-2-0-0")


@query(
    "uid_list_lookup",
    fx.with_ctes(
        fx.SQL_RAW,
        fx.SQL_KEYED,
        fx.SQL_ARRIVALS,
        select="""SELECT pos, uid, coalesce(first_index, -1) AS index, first_index IS NOT NULL AS found
FROM arrivals LEFT JOIN (SELECT uid, min(idx) AS first_index FROM keyed GROUP BY uid) USING (uid)""",
    ),
)
def uid_list_lookup(spark, sf):
    out = lookup.lookup_uids(fx.pair_keys(spark, sf), fx.uid_arrivals(spark, sf), strict=False)
    return out.select("pos", "uid", F.coalesce("index", F.lit(-1)).alias("index"), "found")


@query(
    "index_lookup",
    fx.with_ctes(
        fx.SQL_RAW,
        fx.SQL_KEYED,
        select="""SELECT r.event_id, r.index, coalesce(k.uid, '') AS uid, k.uid IS NOT NULL AS in_bounds
FROM (SELECT event_id, (event_id * 7) // 20 AS index FROM events) r LEFT JOIN keyed k ON k.idx = r.index""",
    ),
)
def index_lookup(spark, sf):
    asked = fx.table(spark, sf, "events").select(
        "event_id", F.floor(F.col("event_id") * 7 / 20).alias("index")
    )
    out = lookup.lookup_indices(fx.pair_keys(spark, sf), asked)
    return out.select("event_id", "index", F.coalesce("uid", F.lit("")).alias("uid"), "in_bounds")


# --- messages for a pair, exports -------------------------------------------


@query(
    "chat_pair",
    fx.with_ctes(
        *PAIRS,
        select=f"""SELECT doc_id, concat('system|text||Be brief.', chr(30), 'user|image|img/', doc_id, '-0.png|', chr(30),
  'user|image|img/', doc_id, '-1.png|', chr(30), 'user|text||',
  replace('{SQL_PROMPT}', '{{statement}}', clean)) AS messages FROM pairs""",
    ),
)
def chat_pair(spark, sf):
    messages = chat.conversation(F.col("images"), F.col("prompt"), F.lit("Be brief."))
    return normalized(spark, sf).select("doc_id", flat_messages(messages).alias("messages"))


def flat_messages(messages):
    """Messages as one line of ``role|type|path|text`` parts, to compare them as text."""
    parts = F.flatten(F.transform(messages, lambda m: flat_parts(m["content"], m["role"])))
    return F.array_join(parts, "\x1e")


def flat_parts(content, role):
    return F.transform(
        content,
        lambda c: F.concat_ws(
            "|", role, c["type"], F.coalesce(c["image"]["path"], F.lit("")), F.coalesce(c["text"], F.lit(""))
        ),
    )


SQL_MANIFEST = """SELECT uid, i AS idx, CASE i WHEN 0 THEN slot0 ELSE slot1 END AS slot,
  coalesce(CASE i WHEN 0 THEN f0 ELSE f1 END,
           concat(uid, '_', CASE i WHEN 0 THEN slot0 ELSE slot1 END, '.png')) AS out_name
FROM pairs CROSS JOIN (VALUES (0), (1)) AS v(i)"""


@query("image_manifest", fx.with_ctes(*PAIRS, select=SQL_MANIFEST))
def image_manifest(spark, sf):
    return files.image_manifest(normalized(spark, sf)).drop("path")


@query(
    "image_dims",
    fx.with_ctes(
        *PAIRS,
        select="""SELECT doc_id, i AS idx, CASE i WHEN 0 THEN w0 ELSE w1 END AS width,
  CASE i WHEN 0 THEN h0 ELSE h1 END AS height FROM pairs CROSS JOIN (VALUES (0), (1)) AS v(i)""",
    ),
)
def image_dims(spark, sf):
    """Sizes read back from file headers built for every image."""
    shown = normalized(spark, sf).select("doc_id", F.posexplode("images").alias("idx", "image"))
    header = shown.withColumn("content", png_header(F.col("image.width"), F.col("image.height")))
    return header.withColumn("size", png_size(F.col("content"))).select("doc_id", "idx", "size.width", "size.height")


def _headers(width, height, kind):
    """Headers of seven formats by ``kind``; the last one is broken."""

    def digits(value, n, little=False):
        text = F.lpad(F.hex(value), 2 * n, "0")
        return F.concat(*[F.substring(text, 2 * k + 1, 2) for k in (reversed(range(n)) if little else range(n))])

    frame = F.concat(F.lit("FFC2001108"), digits(height, 2), digits(width, 2), F.lit("03"))
    jpeg = F.concat(F.lit("FFD8FFE000104A46494600010100000100010000FFFFFE0006616263FF"), frame)
    riff = F.lit("52494646100000005745425056")
    lossless = (width - 1) + F.shiftleft((height - 1).cast("bigint"), 14)
    small = [digits(width, 2, True), digits(height, 2, True)]
    return (
        F.when(kind == 0, png_header(width, height))
        .when(kind == 1, F.unhex(F.concat(F.lit("474946383961"), *small)))
        .when(kind == 2, F.unhex(jpeg))
        .when(kind == 3, F.unhex(F.concat(riff, F.lit("5038580A00000000000000"), digits(width - 1, 3, True), digits(height - 1, 3, True))))
        .when(kind == 4, F.unhex(F.concat(riff, F.lit("50384C0A0000002F"), digits(lossless, 4, True))))
        .when(kind == 5, F.unhex(F.concat(riff, F.lit("5038200A0000000000009D012A"), *small)))
        .otherwise(F.unhex(F.lit("FFD8FFE000104A46494600010100000100010000FFC200")))
    )


@query(
    "image_formats",
    fx.with_ctes(
        *PAIRS,
        select="""SELECT doc_id, i AS idx, CASE WHEN (doc_id + i) % 7 = 6 THEN -1 WHEN i = 0 THEN w0 ELSE w1 END AS width,
  CASE WHEN (doc_id + i) % 7 = 6 THEN -1 WHEN i = 0 THEN h0 ELSE h1 END AS height
FROM pairs CROSS JOIN (VALUES (0), (1)) AS v(i)""",
    ),
)
def image_formats(spark, sf):
    """Sizes from headers of all formats; a broken one gives none."""
    shown = normalized(spark, sf).select("doc_id", F.posexplode("images").alias("idx", "image"))
    kind = (F.col("doc_id") + F.col("idx")) % 7
    sized = shown.withColumn("size", image_size(_headers(F.col("image.width"), F.col("image.height"), kind)))
    return sized.select(
        "doc_id", "idx", *[F.coalesce(f"size.{c}", F.lit(-1)).alias(c) for c in ("width", "height")]
    )


@query(
    "image_export",
    fx.with_ctes(
        *PAIRS,
        select="""SELECT uid, i AS idx, 24::BIGINT AS length, CASE i WHEN 0 THEN w0 ELSE w1 END AS width,
  CASE i WHEN 0 THEN h0 ELSE h1 END AS height FROM pairs CROSS JOIN (VALUES (0), (1)) AS v(i)""",
    ),
)
def image_export(spark, sf):
    """Save all images of all samples, then read what the list names."""
    samples = normalized(spark, sf)
    shown = samples.select(F.explode("images").alias("image")).select("image.path", "image.width", "image.height").distinct()
    images = shown.select("path", png_header(F.col("width"), F.col("height")).alias("content"))
    folder = scratch_path(spark, "export")
    files.export_samples(files.image_manifest(samples), images, folder)
    sized = files.exported(spark, folder).withColumn("size", image_size(F.col("content")))
    return sized.select("uid", "idx", "length", "size.width", "size.height")


@query(
    "image_files",
    fx.with_ctes(
        *PAIRS,
        select="""SELECT concat(doc_id, '-0.png') AS filename, 24::BIGINT AS length, w0 AS width, h0 AS height FROM pairs""",
    ),
)
def image_files_query(spark, sf):
    """Export the first image of every sample, then scan the folder."""
    first = normalized(spark, sf).select("doc_id", F.get("images", 0).alias("image"))
    folder = scratch_path(spark, "images")
    named = first.select(
        F.concat(F.col("doc_id").cast("string"), F.lit("-0.png")).alias("out_name"),
        png_header(F.col("image.width"), F.col("image.height")).alias("content"),
    )
    files.export_images(named, folder)
    found = image_files(spark, folder).withColumn("size", png_size(F.col("content")))
    return found.select("filename", "length", "size.width", "size.height")


@query(
    "sample_dump",
    fx.with_ctes(
        *PAIRS,
        select="""SELECT uid, label_text AS label, clean AS sentence, 2 AS n_images, label AS label_raw FROM pairs""",
    ),
)
def sample_dump(spark, sf):
    """Write samples as JSON lines and read the fields back."""
    samples = normalized(spark, sf).drop("doc_id", "index")
    folder = scratch_path(spark, "samples")
    files.dump_samples(samples, folder)
    back = spark.read.text(folder).select(F.from_json("value", samples.schema).alias("s"))
    return back.select(
        "s.uid", "s.label", "s.sentence", F.size("s.images").alias("n_images"), "s.metadata.label_raw"
    )


# --- stored indexes ---------------------------------------------------------


def _folder(spark, sf) -> str:
    """The pair keys as a folder of several files in the order of their positions."""
    path = scratch_path(spark, "pair-folder")
    keys = fx.pair_keys(spark, sf).repartitionByRange(16, "index").sortWithinPartitions("index")
    keys.select("uid", F.col("index").alias("written")).write.parquet(path)
    return path


@query(
    "stored_slice",
    fx.with_ctes(
        fx.SQL_RAW, fx.SQL_KEYED, select="SELECT idx AS index, uid FROM keyed WHERE idx >= (SELECT count(*) * 3 // 4 FROM keyed)"
    ),
)
def stored_slice(spark, sf):
    """A run taken up again after three quarters, through a stored index of row ranges."""
    index = stored_index.PositionIndex(spark, _folder(spark, sf), scratch_path(spark, "ranges")).refresh()
    total = index.ranges().agg(F.sum("rows")).first()[0]
    return index.slice(total * 3 // 4, columns=["uid"]).select("index", "uid")


@query(
    "stored_uid_lookup",
    fx.with_ctes(
        fx.SQL_RAW,
        fx.SQL_KEYED,
        select="""SELECT min(idx) AS index, uid FROM keyed
WHERE uid IN (SELECT concat('dev-', doc_id, '-0-0') FROM labels UNION ALL SELECT concat('doc-', doc_id) FROM labels) GROUP BY uid""",
    ),
)
def stored_uid_lookup(spark, sf):
    """The records of all labelled documents whose uid follows from the document, through a stored uid index."""
    doc = F.col("doc_id").cast("string")
    names = F.array(F.concat(F.lit("dev-"), doc, F.lit("-0-0")), F.concat(F.lit("doc-"), doc))
    wanted = fx.table(spark, sf, "labels").select(F.explode(names).alias("uid"))
    index = stored_index.UidIndex(spark, _folder(spark, sf), scratch_path(spark, "uids")).refresh()
    return index.lookup_table(wanted).select(F.col("written").alias("index"), "uid")
