"""Benchmark decontamination with a broadcast set of normalised test n-grams.

The windows of the benchmark (``window`` consecutive words of an item, or a shorter item as a whole) are few
and known; documents are many. Every occurrence of a full window covers an aligned gram: the ``gram`` words
at a document position that is a multiple of ``stride``, where stride + gram - 1 = window. So the scan of
all documents hashes one gram for each ``stride`` words and probes the broadcast grams of the benchmark.
Documents with a hit, and only they, have all their windows taken and compared, word for word, with the
benchmark's. Windows shorter than ``window`` are probed at every position, for the lengths that occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relayspark.llm.common import ascii_lower, fits_broadcast, let, small_side, spare, written

WINDOW = 10
STRIDE = 5
#: Fixed value: what a word is not made of.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same, of texts that are not lower-cased.
NEITHER = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD_OR_UPPER = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-cased words; none for null."""
    split = F.split(ascii_lower(text), NOT_WORD)
    return F.coalesce(F.array_remove(split, ""), F.array().cast("array<string>"))


def _hash_of(words: Column, start: Column, length: int) -> Column:
    """The hash of ``length`` words from ``start`` (from 1), as of their array, without making that array."""
    return F.xxhash64(*[F.get(words, start + (k - 1)) for k in range(length)])


def _windows(items: DataFrame, window: int) -> DataFrame:
    """(item_id, words, n) for each window of each item with words."""
    words = items.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text").cast("string")).alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.size("w") - window, F.lit(0))
    at = words.select("item_id", "w", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    return at.select("item_id", F.slice("w", F.col("at") + 1, window).alias("words")).withColumn("n", F.size("words"))


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, stride: int = STRIDE) -> DataFrame:
    """(doc_id, same, n_hit, positions, items) of the contaminated texts: ``positions`` are the 0-based
    numbers of the hit words in order, ``items`` the distinct ids, sorted as strings. ``same`` is a digest
    of the text, so rows of one ``doc_id`` keep apart unless their texts are equal."""
    text = F.col("text").cast("string")
    found = _windows(items, window)
    grams = found.groupBy("words", "n").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    lengths = sorted(r["n"] for r in grams.select("n").distinct().collect())  # at most ``window`` numbers
    gram = window - stride + 1

    # The probe: (length, hash) of the benchmark's grams that documents are scanned for.
    aligned = found.where(F.col("n") == window).select(
        F.explode(F.transform(F.sequence(F.lit(1), F.lit(stride)), lambda k: F.xxhash64(F.slice("words", k, gram)))).alias("h")
    )
    probe = aligned.unionAll(found.where(F.col("n") < window).select(F.xxhash64("words").alias("h"))).distinct()

    keyed = docs.select(F.col("doc_id"), text.alias("text")).where("text is not null")
    words = keyed.select("doc_id", "text", words_of(F.col("text")).alias("w"))

    def scan(length: int, step: int) -> Column:
        """Hashes of the ``length`` words at each multiple of ``step``."""
        starts = F.sequence(F.lit(1), F.size("w") - (length - 1), F.lit(step))
        return F.when(F.size("w") >= length, F.transform(starts, lambda i: _hash_of(F.col("w"), i, length))).otherwise(F.array().cast("array<bigint>"))

    scans = [scan(gram, stride)] if window in lengths else []
    scans += [scan(n, 1) for n in lengths if n < window]
    if not scans:  # no benchmark words at all
        return keyed.where("false").select("doc_id", F.md5("text").alias("same"), F.lit(0).alias("n_hit"), F.array().cast("array<int>").alias("positions"), F.array().cast("array<string>").alias("items"))
    seen = words.select("doc_id", F.md5(F.col("text").cast("binary")).alias("same"), F.explode(F.concat(*scans)).alias("h"))
    # Written, as their number is asked for before they are used: the scan of all documents runs once.
    suspects = written(seen.join(small_side(written(probe, "probe"), 16), "h", "left_semi").select("doc_id", "same").distinct(), "suspects")

    # All windows of the suspects, verified word for word. Only their texts are split once more.
    side = small_side(suspects, 64)
    close = keyed.withColumn("same", F.md5(F.col("text").cast("binary"))).join(
        side.select(F.col("doc_id").alias("d"), F.col("same").alias("s")), F.expr("doc_id <=> d and same = s"), "left_semi"
    ).dropDuplicates(["doc_id", "same"]).select("doc_id", "same", words_of(F.col("text")).alias("w"))

    def spans(length: int) -> Column:
        """Each ``length`` consecutive words with their position."""
        starts = F.sequence(F.lit(1), F.size("w") - (length - 1))
        each = F.transform(starts, lambda i: F.struct((i - 1).alias("at"), F.slice("w", i, length).alias("words")))
        return F.when(F.size("w") >= length, each).otherwise(F.array().cast("array<struct<at:int,words:array<string>>>"))

    key = F.expr("doc_id <=> d and same = s")
    if fits_broadcast(grams, 512):
        taken = close.select("doc_id", "same", F.explode(F.flatten(F.array(*map(spans, lengths)))).alias("x"))
        hit = taken.select("doc_id", "same", "x.at", "x.words").join(F.broadcast(grams), "words").select("doc_id", "same", "at", "n", "ids")
    else:
        # Windows go to a large benchmark by their hashes; the words of those that meet are then compared.
        def hashes(length: int) -> Column:
            each = F.transform(spans(length), lambda x: F.struct(x["at"].alias("at"), F.lit(length).alias("n"), F.xxhash64(x["words"]).alias("h")))
            return each.cast("array<struct<at:int,n:int,h:bigint>>")

        taken = close.select("doc_id", "same", F.explode(F.flatten(F.array(*map(hashes, lengths)))).alias("x")).select("doc_id", "same", "x.at", "x.n", "x.h")
        named = grams.select(F.xxhash64("words").alias("h"), "words", "n", "ids")
        met = written(taken.join(named, ["h", "n"]), "met")
        spots = met.groupBy(F.col("doc_id").alias("d"), F.col("same").alias("s")).agg(F.collect_list(F.struct("at", "n", "words", "ids")).alias("m"))
        sure = F.filter("m", lambda m: F.slice("w", m["at"] + 1, m["n"]) == m["words"])
        hit = close.join(spots, key).select("doc_id", "same", F.explode(sure).alias("m")).select("doc_id", "same", "m.at", "m.n", "m.ids")
    by_text = hit.groupBy("doc_id", "same").agg(
        F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)))).alias("p"),
        F.array_distinct(F.flatten(F.collect_set("ids"))).alias("i"),
    )
    out = by_text.select("doc_id", "same", F.size("p").alias("n_hit"), F.array_sort("p").alias("positions"), F.array_sort("i").alias("items"))
    return written(out, "hits")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items (sorted ids), contaminated, positions.

    ``docs`` needs ``doc_id`` and ``text``, ``items`` needs ``item_id`` and ``text``; other columns are
    ignored. Null and wordless texts have no words and no hits; items without words have no windows; items
    of one id count once. An empty benchmark hits nothing; an empty table of documents gives no rows.
    """
    found = hits(docs, items, window).withColumnsRenamed({"doc_id": "d", "same": "s"})
    text = F.col("text").cast("string")
    number = F.coalesce(F.size(F.array_remove(F.split(text, NEITHER), "")), F.lit(0))
    rows = docs.select("doc_id", number.cast("long").alias("n_words"), F.md5(text.cast("binary")).alias("same"))
    out = rows.join(small_side(found, 4096), F.expr("doc_id <=> d and same = s"), "left")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        F.coalesce("positions", F.array().cast("array<int>")).alias("positions"),
    )


def _rebuilt(x: Column) -> Column:
    """A text without its hit words: from its words ``w``, the gaps around them ``g`` and the numbers of the hit words
    in order ``p``. A gap goes if the words on both its sides are hit."""
    # Each gap with the word behind it, and the runs of hit words: the first of each, and the last.
    glued = F.zip_with(x["g"], x["w"], lambda g, w: F.concat(g, F.coalesce(w, F.lit(""))))
    heads = F.filter(x["p"], lambda n, i: (i == 0) | (F.get(x["p"], i - 1) != n - 1))
    tails = F.filter(x["p"], lambda n, i: (i == F.size(x["p"]) - 1) | (F.get(x["p"], i + 1) != n + 1))

    def joined(y: Column) -> Column:
        # What stays lies behind one run and before the next, with the gap before that.
        after = F.concat(F.array(F.lit(-1)), y["tails"])
        upto = F.concat(y["heads"], F.array(F.size(y["glued"]) - 1))
        stays = F.zip_with(after, upto, lambda a, b: F.concat(F.array_join(F.slice(y["glued"], a + 2, b - a - 1), ""), F.get(x["g"], b)))
        return F.array_join(stays, "")

    return let(F.struct(glued.alias("glued"), heads.alias("heads"), tails.alias("tails")), joined)


def without_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, most: float = 0.5) -> DataFrame:
    """``docs`` without benchmark passages: hit words and the gaps between them go from the text, and a
    document of which more than ``most`` of the words are hit goes as a whole.

    Clean rows stay as they are, null, empty and wordless texts among them; rows of one ``doc_id`` are judged each by
    its own text, and repeated rows alike. ``n_chars``, if there, is set anew for rows that change. All columns and
    their order are kept. An empty benchmark changes nothing; an empty table stays empty."""
    doc, same, places, new = spare(docs, "__doc", "__same", "__places", "__new")
    found = hits(docs, items, window).select(F.col("doc_id").alias(doc), F.col("same").alias(same), F.col("positions").alias(places))
    text = F.col("text").cast("string")
    joined = docs.join(small_side(found, 4096), (F.col("doc_id").eqNullSafe(F.col(doc))) & (F.md5(text.cast("binary")) == F.col(same)), "left")
    hit = F.col(places).isNotNull()
    split = F.struct(
        F.regexp_extract_all(text, F.lit(WORD_OR_UPPER), F.lit(0)).alias("w"),
        F.split(text, WORD_OR_UPPER, -1).alias("g"),
        F.col(places).alias("p"),
    )
    too_many = lambda x: F.size(x["p"]) > most * F.size(x["w"])
    made = let(split, lambda x: F.when(too_many(x), F.lit(None)).otherwise(_rebuilt(x)))
    # Null stands for a document that goes; clean rows keep their text, null or not.
    cleaned = joined.withColumn(new, F.when(hit, made)).where(~hit | F.col(new).isNotNull())
    cleaned = cleaned.withColumn("text", F.when(hit, F.col(new)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.when(hit, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return cleaned.select(*docs.columns)
