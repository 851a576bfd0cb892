"""Language identification in two levels: the family first, then the language within it.

Texts become hashed counts of letter sequences (one to three characters, word edges included).
Between any two families, and between any two languages of a family, a linear support vector
machine decides; the side that wins most of these duels goes on. A language is thus only ever told
apart from its close relatives, by a machine that saw nothing else.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visloom.llm.common import Scratch, ship

SAMPLE_ROWS = 1000  # labelled rows of a language the machines learn from, at most
DIMENSIONS = 4096
FOLDS, HELD_OUT = 4, 2
COST = 10.0
EPOCHS = 40
BLOCK_ROWS = 512  # texts whose vectors are held at once
PIECE = 1 << 20  # characters counted at once: bounds the memory of a very long text
UNKNOWN = "und"

# Language codes of families.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ast ca co es fr gl it la oc pt rm ro sc scn",
    "slavic": "be bg bs cs hr mk pl ru sh sk sl sr uk",
    "celtic": "br cy ga gd kw gv",
    "baltic": "lt lv",
    "uralic": "et fi hu se",
    "turkic": "az ba kk ky tk tr tt ug uz",
    "indic": "as bn gu hi mr ne or pa sa sd si ur",
    "iranian": "ckb fa ku ps tg",
    "dravidian": "kn ml ta te",
    "semitic": "am ar he mt",
    "austronesian": "id jv mg ms su tl",
    "east asian": "ja ko yue zh",
}
OTHER = "other"  # the family of all codes not listed


def family_of(lang: str) -> str:
    code = lang.lower().replace("_", "-").split("-")[0]
    return next((name for name, codes in FAMILIES.items() if code in codes.split()), OTHER)


_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point whether it is a letter; built once per process."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def counts_of(text: str) -> np.ndarray | None:
    """Hashed counts of the whole text's letter sequences; None without a letter."""
    total = np.zeros(DIMENSIONS, np.int64)
    found = False
    before = np.zeros(1, np.uint32)  # the last two places, letters or the edge of a word
    for start in range(0, len(text), PIECE):
        codes = np.frombuffer(text[start : start + PIECE].lower().encode("utf-32-le"), np.uint32)
        is_letter = letters()[codes]
        found = found or bool(is_letter.any())
        # Whatever stands between two words is one edge, however long.
        kept = is_letter.copy()
        kept[1:] |= is_letter[:-1]
        kept[0] |= before[-1] != 0
        codes = np.concatenate([before, np.where(is_letter, codes, 0)[kept]]).astype(np.uint32)
        for size in (1, 2, 3):
            first = max(0, len(before) - size + 1)
            n = len(codes) - first - size + 1
            if n > 0:
                grams = np.full(n, size, np.uint32)
                for k in range(first, first + size):
                    grams = grams * np.uint32(0x9E3779B1) + codes[k : k + n]
                grams ^= grams >> np.uint32(15)
                total += np.bincount((grams * np.uint32(0xC2B2AE35)) >> np.uint32(20), minlength=DIMENSIONS)
        before = codes[-2:]
    return total if found else None


def vector_of(text: str | None) -> np.ndarray | None:
    """Square roots of the shares: a vector of length one."""
    counts = counts_of(text) if text else None
    return None if counts is None else np.sqrt(counts / counts.sum()).astype(np.float32)


def separate(x: np.ndarray, y: np.ndarray, cost: float = COST, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """A linear support vector machine with squared hinge loss, by dual coordinate descent.

    ``y`` is +1 or -1; both sides get the same total cost. Returns weights and the bias.
    """
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    sides = np.where(y > 0, (y > 0).sum(), (y < 0).sum())
    damping = sides / (cost * len(y))
    scale = np.einsum("ij,ij->i", x, x) + damping
    weights, alpha = np.zeros(x.shape[1], np.float32), np.zeros(len(x))
    order = np.random.default_rng(7)
    for _ in range(epochs):
        largest = 0.0
        for i in order.permutation(len(x)):
            slope = y[i] * float(weights @ x[i]) - 1 + damping[i] * alpha[i]
            if alpha[i] > 0 or slope < 0:
                largest = max(largest, abs(slope))
                new = max(alpha[i] - slope / scale[i], 0.0)
                weights += np.float32((new - alpha[i]) * y[i]) * x[i]
                alpha[i] = new
        if largest < 0.01:
            break
    return weights[:-1], float(weights[-1])


def calibrated(margins: np.ndarray, y: np.ndarray) -> float:
    """The slope s for which 1 / (1 + exp(-s * margin)) fits the sides best (within 1 to 20)."""
    slopes = np.linspace(1, 20, 39)
    likely = [np.logaddexp(0, -s * margins * y).sum() for s in slopes]
    return float(slopes[int(np.argmin(likely))])


def _sample(documents: DataFrame, rows: int, scratch: Scratch) -> DataFrame:
    """(lang, place, vector): at most ``rows`` labelled training rows of each language, by hash."""
    checksum = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    train = documents.where(F.col("lang").isNotNull() & (checksum % FOLDS != HELD_OUT))
    spread = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 32))
    # One row per language of the labels: narrow, so that the texts are only read for rows that can be drawn.
    shares = train.groupBy("lang").agg((F.lit(1.5 * rows) / F.count(F.lit(1))).alias("share"))
    drawn = train.withColumn("spread", spread).join(F.broadcast(shares), "lang").where(F.col("spread") < F.col("share") * (1 << 32))

    def vectors(batches):
        for batch in batches:
            found = [vector_of(t) for t in batch.column(2).to_pylist()]
            kept = [k for k, v in enumerate(found) if v is not None]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(kept, pa.int64())),
                    batch.column(1).take(pa.array(kept, pa.int64())),
                    pa.array([found[k].astype(np.float16).tobytes() for k in kept], pa.binary()),
                ],
                ["lang", "spread", "vector"],
            )

    drawn = drawn.select("lang", "spread", "text").where(F.col("text").isNotNull())
    drawn = drawn.mapInArrow(vectors, "lang string, spread long, vector binary")
    drawn = scratch.put(drawn, "drawn")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("spread", "vector"))
    return drawn.withColumn("place", place).where(F.col("place") <= rows)


MACHINE = "level string, a string, b string, weights binary, bias double, slope double"


def machines(documents: DataFrame, rows: int = SAMPLE_ROWS) -> list[tuple]:
    """The fitted duels (level, a, b, weights, bias, slope); above 0 is ``a``.

    A row without duel (b null) names the only language of a family or the only family. Every duel is
    fitted in a task of its own, from at most 2 * ``rows`` vectors.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "language-id")
    sample = scratch.put(_sample(documents, rows, scratch), "sample")
    langs = sorted(r[0] for r in sample.select("lang").distinct().collect())
    families: dict[str, list[str]] = {}
    for lang in langs:
        families.setdefault(family_of(lang), []).append(lang)
    alone = [(name, lang, None, None, None, None) for name, (lang, *more) in families.items() if not more]
    if len(families) == 1:
        alone.append(("", *families, None, None, None, None))
    duels = []  # (level, a, b, language, side, rows of the language)
    for a, b in combinations(sorted(families), 2):
        for side, name in ((1, a), (-1, b)):
            duels += [("", a, b, lang, side, -(-rows // len(families[name]))) for lang in families[name]]
    for name, members in families.items():
        for a, b in combinations(members, 2):
            duels += [(name, a, b, a, 1, rows), (name, a, b, b, -1, rows)]
    if not duels:
        return alone
    plan = spark.createDataFrame(duels, "level string, a string, b string, lang string, side int, most int")
    dealt = sample.join(F.broadcast(plan), "lang").where("place <= most")

    def fit(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        part = part.sort_by([("lang", "ascending"), ("place", "ascending")])
        x = np.frombuffer(b"".join(part.column("vector").to_pylist()), np.float16).reshape(len(part), -1).astype(np.float32)
        y = part.column("side").to_numpy()
        weights, bias = separate(x, y)
        slope = calibrated(x @ weights + bias, y)
        row = [[key[k].as_py()] for k in range(3)] + [[weights.tobytes()], [bias], [slope]]
        kinds = [pa.string()] * 3 + [pa.binary(), pa.float64(), pa.float64()]
        return pa.table([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], [c.split()[0] for c in MACHINE.split(", ")])

    columns = ["level", "a", "b", "lang", "place", "side", "vector"]
    fitted = dealt.select(*columns).groupBy("level", "a", "b").applyInArrow(fit, MACHINE)
    return alone + [tuple(r) for r in scratch.put(fitted, "machines").orderBy("level", "a", "b").collect()]


class Tournament:
    """The duels of one level: which of its names wins, and how sure it is."""

    def __init__(self, duels: list[tuple]):
        self.names = sorted({n for _, a, b, *_ in duels for n in (a, b) if n is not None})
        self.place = {n: k for k, n in enumerate(self.names)}
        self.duels = [d for d in duels if d[2] is not None]
        if self.duels:
            self.weights = np.stack([np.frombuffer(d[3], np.float32) for d in self.duels], axis=1)
            self.bias = np.array([d[4] for d in self.duels], np.float32)
            self.slope = np.array([d[5] for d in self.duels])

    def winners(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the winners and the least certainty among each one's duels."""
        n = len(vectors)
        if not self.duels:
            return np.zeros(n, np.int64), np.ones(n)
        sure = 1 / (1 + np.exp(-self.slope * (vectors @ self.weights + self.bias)))
        # Most duels won, then the largest sum of certainties, then the first name.
        points, least = np.zeros((n, len(self.names))), np.ones((n, len(self.names)))
        for k, (_, a, b, *_) in enumerate(self.duels):
            for name, p in ((a, sure[:, k]), (b, 1 - sure[:, k])):
                at = self.place[name]
                points[:, at] += (p > 0.5) + p / (2 * len(self.names))
                least[:, at] = np.minimum(least[:, at], p)
        best = points.argmax(axis=1)
        return best, least[np.arange(n), best]


class Identifier:
    def __init__(self, fitted: list[tuple]):
        levels: dict[str, list[tuple]] = {}
        for duel in fitted:
            levels.setdefault(duel[0], []).append(duel)
        self.families = Tournament(levels.pop("", []))
        self.languages = {name: Tournament(duels) for name, duels in levels.items()}

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        vectors = [vector_of(t) for t in texts] if self.languages else []
        known = [k for k, v in enumerate(vectors) if v is not None]
        if known:
            stacked = np.stack([vectors[k] for k in known])
            families, sure = self.families.winners(stacked)
            for at, family in enumerate(self.families.names):
                rows = np.flatnonzero(families == at)
                if len(rows):
                    level = self.languages[family]
                    best, certain = level.winners(stacked[rows])
                    for r, b, c in zip(rows, best, certain, strict=True):
                        names[known[r]], scores[known[r]] = level.names[b], float(min(1.0, sure[r] * c))
        return names, scores


def predicted_languages(documents: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per row of ``documents`` (doc_id, text, lang): doc_id, held_out, lang_pred, score.

    held_out marks rows whose crc32(doc_id) mod FOLDS is HELD_OUT; they are never learned from, and neither are
    rows without text, letters or label. Of the others at most ``rows`` per language, those of
    the smallest hashes, teach the machines; predictions see the whole text and nothing else. lang_pred is
    ``und`` with score 0 if the text is null or has no letter, or if nothing could be learned. The
    score is the certainty of the closest duels of both levels.

    Labels are a set of languages, so duels are few and pass through the driver; no text does. A null doc_id
    counts as the empty text in checksums; repeated rows are predicted alike, ties go to the first name.
    An empty table gives an empty result. Extra columns are ignored.
    """
    documents = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), F.col("lang").cast("string"))
    ship(documents.sparkSession)
    fitted = machines(documents, rows)

    def predict(batches):
        model = Identifier(fitted)
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                names, scores = model.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"]
                )

    predicted = documents.select("doc_id", "text").mapInArrow(predict, "doc_id long, lang_pred string, score double")
    checksum = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return predicted.select("doc_id", (checksum % FOLDS == HELD_OUT).alias("held_out"), "lang_pred", "score")
