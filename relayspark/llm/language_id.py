"""Language identification by a string kernel.

The kernel of two texts compares which character n-grams (all lengths of ``GRAMS``: the blended spectrum) are
present in both: for each length the cosine of the presence vectors, averaged. Nyström landmarks, a few texts
of each language, stand for the training set; one-versus-rest kernel ridge regression on the kernel values
against them gives a weight for each landmark and language. A batch of texts is scored by two matrix
products: presence against landmarks (both sparse), and kernel values against weights.

Those scores only say which language is nearest. Whether a text is in it at all is told by the share of its
n-grams that the language's landmarks know; how large that must be is set by labelled texts against landmarks
other than themselves.

The model is fitted on the driver from a bounded sample: at most ``SAMPLE_PER_LANGUAGE`` texts of each
language (those of the smallest hash of doc_id; texts of over ``SAMPLE_CHARS`` characters only where there are
too few others), of which ``LANDMARKS`` in all are landmarks, so its size follows the number of languages, not
the corpus.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relayspark.llm.common import python_ready

GRAMS = (1, 2, 3)
SAMPLE_PER_LANGUAGE = 200
LANDMARKS_PER_LANGUAGE = 32
#: Landmarks in all: with more languages than a part of this each has fewer, one at least.
LANDMARKS = 2048
#: Longer texts are learned from only where a language has too few others.
SAMPLE_CHARS = 20_000
#: Most numbers (features by landmarks) that a worker holds as a dense matrix: 64 MB.
DENSE = 1 << 24
RIDGE = 1e-3
UNKNOWN = "und"
#: A text that no language claims by this score is rejected by ``accepted``.
LEAST_SCORE = 0.3
#: A text is in a language if its landmarks know this share of the text's n-grams of letters. A language whose own
#: labelled texts are known less has a lower limit: a part of the share that all but a tenth of them reach.
LEAST_KNOWN = 0.5
KNOWN_PART = 0.6
KNOWN_QUANTILE = 0.1
#: So many of a text's n-grams need not be known.
FORGIVEN = 4
#: Characters of text whose n-grams are found at once; a longer text is read on its own.
CHUNK_CHARS = 1 << 18
_BITS = 20

_LETTER = re.compile(r"[^\W\d_]")


def is_held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text, modulo 4, is 2. A null id is neither learned from nor held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@cache
def _letters() -> np.ndarray:
    """By code point: whether it is a letter or a mark."""
    return np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)), dtype=bool, count=0x110000)


def _hashed(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length of n-gram: (its number, row of each n-gram, its hash of ``_BITS`` bits, whether it is of
    letters and blanks, not of blanks alone)."""
    joined = "\x00".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    gap = codes == 0
    row = np.cumsum(gap, dtype=np.int64)
    letter = _letters()[codes]
    plain = letter | (codes == 32)
    for k, n in enumerate(GRAMS):
        size = len(codes) - n + 1
        if size <= 0:
            continue
        mixed, whole = codes[:size].copy(), ~gap[:size]
        pure, some = plain[:size].copy(), letter[:size].copy()
        for i in range(1, n):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + codes[i : size + i]
            whole &= ~gap[i : size + i]
            pure &= plain[i : size + i]
            some |= letter[i : size + i]
        hashed = (mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - _BITS)
        yield k, row[:size][whole], hashed[whole].astype(np.int64), (pure & some)[whole]


def _clean(text: str | None) -> str:
    return (text or "").replace("\x00", " ").lower()


@dataclass
class Model:
    """Features are hashes of n-grams, by length, that some landmark has. The landmarks' presence of them is sparse:
    feature f is held by the landmarks ``held[bounds[f]:bounds[f + 1]]``, each of which has ``sizes[k]`` features of
    the k-th length. ``weights`` are by landmark and language, ``owner`` has each landmark's language, and ``least``
    the share of a text's n-grams that a language has to know. All of it grows with the landmarks, not with languages
    times features."""

    languages: list[str]
    features: list[np.ndarray]
    bounds: np.ndarray
    held: np.ndarray
    sizes: np.ndarray
    owner: np.ndarray
    weights: np.ndarray
    least: np.ndarray

    def __post_init__(self):
        # How many landmarks of a language hold a feature, for the pairs where any does.
        feature = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
        self.pairs, self.holders = np.unique(feature * len(self.languages) + self.owner[self.held], return_counts=True)
        self.whole = None
        if (len(self.bounds) - 1) * len(self.languages) <= DENSE:
            self.whole = np.zeros((len(self.bounds) - 1) * len(self.languages), dtype=np.uint8)
            self.whole[self.pairs] = np.minimum(self.holders, 255)

    def _holders(self, feature: np.ndarray, language: np.ndarray) -> np.ndarray:
        """How many of a language's landmarks hold a feature (-1 is none): from the pairs, or from a table of all where
        that is small."""
        pair = feature * len(self.languages) + language
        if self.whole is not None:
            return np.where(feature >= 0, self.whole[pair], 0)
        spot = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[spot] == pair, self.holders[spot], 0)

    def tables(self) -> list[np.ndarray]:
        out, at = [], 0
        for found in self.features:
            table = np.full(1 << _BITS, -1, dtype=np.int32)
            table[found] = np.arange(at, at + len(found))
            at += len(found)
            out.append(table)
        return out

    def dense(self) -> list[np.ndarray] | None:
        """The landmarks' presence by length of n-gram, features by landmarks, scaled; None if it has more than
        ``DENSE`` numbers."""
        marks = len(self.owner)
        if (len(self.bounds) - 1) * marks > DENSE:
            return None
        out, at = [], 0
        for k, found in enumerate(self.features):
            part = np.zeros((len(found), marks), dtype=np.float32)
            ends = self.bounds[at : at + len(found) + 1]
            part[np.repeat(np.arange(len(found)), np.diff(ends)), self.held[ends[0] : ends[-1]]] = 1
            out.append(part / np.sqrt(np.maximum(self.sizes[k], 1)).astype(np.float32))
            at += len(found)
        return out

    def kernel(self, grams: list[tuple], n: int, tables: list[np.ndarray], dense: list[np.ndarray] | None = None) -> np.ndarray:
        """``n`` texts by landmarks: for each length of n-gram the cosine of the presence vectors over the features,
        averaged. A matrix product, made a batch at a time: of dense parts if there are any, else of sparse ones,
        which many landmarks need. ``grams`` are the texts' n-grams."""
        marks = len(self.owner)
        out = np.zeros((n, marks))
        before = np.cumsum([0, *map(len, self.features)])
        for k, row, hashed, _ in grams:
            place = tables[k][hashed]
            row, place = row[place >= 0], place[place >= 0]
            if dense is not None:
                part = np.zeros((n, len(self.features[k])), dtype=np.float32)
                part[row, place - before[k]] = 1
                size = np.maximum(part.sum(axis=1, keepdims=True), 1)
                out += (part @ dense[k]) / (np.sqrt(size) * len(GRAMS))
                continue
            both = np.unique(row << 32 | place)  # each n-gram once a text
            row, place = both >> 32, both & 0xFFFFFFFF
            size = np.bincount(row, minlength=n)
            many = self.bounds[place + 1] - self.bounds[place]
            ends = np.cumsum(many)
            spot = np.repeat(self.bounds[place] - (ends - many), many) + np.arange(int(ends[-1]) if len(ends) else 0)
            shared = np.bincount(np.repeat(row * marks, many) + self.held[spot], minlength=n * marks).reshape(n, marks)
            out += shared / np.sqrt(np.maximum(size[:, None] * self.sizes[k][None, :], 1)) / len(GRAMS)
        return out

    def known(self, grams: list[tuple], n: int, tables: list[np.ndarray], language: np.ndarray, holders: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What at least ``holders`` landmarks of each text's ``language`` know of its n-grams of letters: the share
        of the longest n-grams that it has, the number of those, and the mean share over all lengths."""
        share, number, total = (np.zeros(n) for _ in range(3))
        for k, row, hashed, pure in grams:
            row, place = row[pure], tables[k][hashed[pure]]
            hit = (place >= 0) & (self._holders(place.astype(np.int64), language[row]) >= holders)
            size = np.bincount(row, minlength=n)
            part = np.bincount(row[hit], minlength=n) / np.maximum(size, 1)
            share, number, total = np.where(size > 0, part, share), np.where(size > 0, size, number), total + part
        return share, number, total / len(GRAMS)

    def predict(self, texts: list[str], tables: list[np.ndarray], dense: list[np.ndarray] | None = None) -> tuple[np.ndarray, ...]:
        """For each text its nearest language, that language's score, whether the text is in it, and its mean known
        share. A short unknown word is forgiven, but a text of which nothing is known is in no language."""
        grams = list(_hashed(texts))
        scores = self.kernel(grams, len(texts), tables, dense) @ self.weights
        best = scores.argmax(axis=1)
        share, number, mean = self.known(grams, len(texts), tables, best)
        inside = (share + FORGIVEN / np.maximum(number, 1) >= self.least[best]) & (mean > 0)
        return best, scores[np.arange(len(texts)), best], inside, mean


def fit(labelled: list[tuple[str, str]], landmarks: int = LANDMARKS) -> Model | None:
    """A model from (text, language) pairs; None without any."""
    labelled = [(_clean(text), lang) for text, lang in labelled if text and _LETTER.search(text)]
    languages = sorted({lang for _, lang in labelled})
    if not languages:
        return None
    number = {lang: k for k, lang in enumerate(languages)}
    own = np.asarray([number[lang] for _, lang in labelled])
    each = max(1, min(LANDMARKS_PER_LANGUAGE, landmarks // len(languages)))
    order = np.argsort(own, kind="stable")
    nth = np.arange(len(own)) - np.searchsorted(own[order], own[order])
    chosen = order[nth < each]
    # The chosen texts' features, and which of the texts hold each.
    features, holds = [], []
    sizes = np.zeros((len(GRAMS), len(chosen)))
    for k in range(len(GRAMS)):
        sets = [next((np.unique(h) for at, _, h, _ in _hashed([labelled[i][0]]) if at == k), np.zeros(0, dtype=np.int64)) for i in chosen.tolist()]
        sizes[k] = [len(x) for x in sets]
        found, place = np.unique(np.concatenate(sets), return_inverse=True)
        before = sum(map(len, features))
        features.append(found)
        holds.append((place + before, np.repeat(np.arange(len(chosen)), sizes[k].astype(np.int64))))
    feature, mark = (np.concatenate(x) for x in zip(*holds, strict=True))
    held = mark[np.argsort(feature, kind="stable")]
    bounds = np.concatenate([[0], np.cumsum(np.bincount(feature, minlength=sum(map(len, features))))])
    least = np.full(len(languages), LEAST_KNOWN)
    model = Model(languages, features, bounds, held, sizes, own[chosen], np.zeros((len(chosen), len(languages))), least)
    tables = model.tables()
    grams = (list(_hashed([text])) for text, _ in labelled)
    dense = model.dense()
    kernel = np.concatenate([model.kernel(g, 1, tables, dense) for g in grams])
    target = np.where(own[:, None] == np.arange(len(languages)), 1.0, -1.0)
    # Each language counts alike, however many rows it has.
    share = 1.0 / np.bincount(own)[own]
    left = kernel.T @ (kernel * share[:, None]) + RIDGE * kernel[chosen] + 1e-9 * np.eye(len(chosen))
    model.weights = np.linalg.solve(left, kernel.T @ (target * share[:, None]))
    # A landmark knows its own n-grams; so for landmarks another one has to know them, too.
    marked = set(chosen.tolist())
    shares: list[list[float]] = [[] for _ in languages]
    for i, (text, _) in enumerate(labelled):
        shares[own[i]].append(float(model.known(list(_hashed([text])), 1, tables, own[i : i + 1], 2 if i in marked else 1)[0][0]))
    model.least = np.asarray([min(LEAST_KNOWN, KNOWN_PART * float(np.quantile(x, KNOWN_QUANTILE))) for x in shares])
    return model


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, sample_chars: int = SAMPLE_CHARS) -> Model | None:
    """Fit on a bounded sample of the rows of ``docs`` (doc_id, text, lang) that are labelled and not held out.

    Every language is learned. Texts of over ``sample_chars`` characters come after all others of their language.
    """
    usable = F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~is_held_out(F.col("doc_id"))
    rows = docs.where(usable).select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("long", F.length("text") > sample_chars)
    counts = rows.groupBy("lang").agg(F.count_if(~F.col("long")).alias("short"), F.count_if("long").alias("long")).orderBy("lang").collect()
    if not counts:
        return None
    # First a share of each language by hash, about twice what is used; then the smallest hashes of those.
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    enough = lambda wanted, n: (2.0 * wanted + 40.0) / n if wanted > 0 and n else -1.0
    short = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], enough(per_language, r["short"]))])
    long = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], enough(per_language - r["short"], r["long"]))])
    some = rows.withColumn("u", unit).where(F.col("u") <= F.when(F.col("long"), long[F.col("lang")]).otherwise(short[F.col("lang")]))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("long", "u", "text"))
    sample = some.withColumn("rank", rank).where(F.col("rank") <= per_language).select("lang", "rank", "text").collect()
    return fit([(r["text"], r["lang"]) for r in sorted(sample, key=lambda r: (r["lang"], r["rank"]))])


def _predict(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, dense = (model.tables(), model.dense()) if model else ([], None)
        for batch in batches:
            raw = batch.column("text").to_pylist()
            names, values = [UNKNOWN] * len(raw), np.zeros(len(raw))
            todo = [i for i, x in enumerate(raw) if model and x and _LETTER.search(x)]
            at = 0
            while at < len(todo):
                size, some = 0, []
                while at < len(todo) and len(some) < 256 and (size < CHUNK_CHARS or not some):
                    some.append(todo[at])
                    size += len(raw[todo[at]])
                    at += 1
                texts = [_clean(raw[i]) for i in some]
                for i, k, s, own, part in zip(some, *(x.tolist() for x in model.predict(texts, tables, dense)), strict=True):
                    value = min(1.0, max(0.0, (1 + s) / 2))
                    names[i], values[i] = (model.languages[k], value) if own else (UNKNOWN, value * part)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(values, pa.float64())],
                [*batch.schema.names, "lang_pred", "score"],
            )

    return run


def classify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1; columns of those names are replaced).

    Only ``text`` is read. A text that is null or has no letter is ``und`` with score 0, and so is every text
    if there was nothing to learn from. A text of which the nearest language knows too little is ``und``, too: its
    score is that language's times the share that is known, 0 for a script that was not learned. Equal texts get equal results; an empty table stays empty.
    """
    python_ready(docs.sparkSession)
    rows = docs.drop("lang_pred", "score").withColumn("text", F.col("text").cast("string"))
    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_predict(model), schema)


def accepted(classified: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows with a language: not ``und``, and claimed by one with at least ``least``."""
    return classified.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
