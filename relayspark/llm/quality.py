"""Line-first quality rules: judge each line, remove those that fail, reject documents that lose too much.

All of it is one projection over the documents: no shuffle, no Python.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relayspark.llm.common import let

#: White space between words, and the symbols that are counted.
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
NOT_SYMBOL = r"[^#*$%&|<>]+"

#: A line must end with one of these, and may hold symbols up to this share of its characters.
LINE_END = r"[.!?:;,…。！？\"'”’»)\]][\x20\x09-\x0D]*$"
ENDS, BLANKS = ".!?:;,…。！？\"'”’»)]", " \t\n\x0b\x0c\r"
SYMBOL_SHARE = 0.1
#: Navigation: parts of a menu joined by separators, in lines of few words.
MENU = r"(\||»|›|•|·|>).*(\||»|›|•|·|>)"
SEPARATOR = "[|»›•·>]"
MENU_WORDS = 12
#: Boilerplate phrases, matched in any case.
BOILERPLATE = (
    r"(?i)(all rights reserved|licensed under|released under the|this (file|work|program|software) is licensed"
    r"|\bcopyright\b|cookie policy|accept cookies|we use cookies|privacy policy|terms of (use|service)"
    r"|enable javascript|javascript is disabled|lorem ipsum|click here|subscribe to our|sign up for our newsletter)"
)
#: Each phrase holds one of these, in small letters; a text with none is not searched for phrases.
HINTS = (
    "all rights reserved", "licensed", "released under", "copyright", "cookie", "privacy policy", "terms of", "javascript", "lorem ipsum",
    "click here", "subscribe to", "newsletter",
)
#: A document is rejected if more than this share of its word characters was in removed lines.
MOST_LOST = 0.5
#: Base rule: the fewest words, and the most words (in percent) in repeated windows of this many words.
LEAST_WORDS = 10
MOST_REPEATED = 20
WINDOW = 5


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def line_passes(line: Column, symbols: Column, menus: Column, phrases: Column) -> Column:
    """Whether a line with words passes the punctuation, navigation and boilerplate rules. The other columns say
    whether its text holds symbols, separators of menus and hints of phrases at all."""
    ended = F.instr(F.lit(ENDS), F.right(F.rtrim(line, F.lit(BLANKS)), F.lit(1))) > 0  # LINE_END, but faster
    marked = F.length(F.regexp_replace(line, NOT_SYMBOL, "")) > SYMBOL_SHARE * F.length(line)
    menu = line.rlike(MENU) & (F.size(F.split(F.trim(line), SPACE)) <= MENU_WORDS)
    return ended & ~(symbols & marked) & ~(menus & menu) & ~(phrases & line.rlike(BOILERPLATE))


def _repeated(words: Column) -> Column:
    """Words in windows that a text has twice or more. Windows meet by hash; only texts with an equal pair go on to
    find where they lie."""
    each = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))

    def spots(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        meets = lambda s: F.zip_with(
            F.slice(s, F.lit(1), F.size(s) - 1),
            F.slice(s, F.lit(2), F.size(s) - 1),
            lambda a, b: F.when(a["h"] == b["h"], F.array(a["at"], b["at"])),
        )
        return F.sort_array(F.array_distinct(F.flatten(F.filter(let(pairs, meets), lambda m: m.isNotNull()))))

    def covered(at: Column) -> Column:
        # A window counts up to where the next one starts.
        ends = F.concat(F.slice(at, F.lit(2), F.size(at)), F.array(F.element_at(at, -1) + WINDOW))
        return F.aggregate(F.zip_with(at, ends, lambda a, b: F.least(b - a, F.lit(WINDOW))), F.lit(0), lambda sum_, x: sum_ + x)

    found = lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), let(spots(h), covered)).otherwise(0)
    return F.when(F.size(words) > WINDOW, let(each, found)).otherwise(0)


def judge(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``; others ignored): counts, verdicts and the clean text.

    Null and empty texts have no words, fail the base rule and give an empty clean text. Lines without words
    are neither judged nor kept. Equal rows get equal verdicts; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    inner, low = F.btrim(text, F.lit(BLANKS)), F.lower(text)
    phrases = let(low, lambda t: reduce(or_, [t.contains(hint) for hint in HINTS]))
    parts = F.struct(
        F.when(inner == "", _empty("string")).otherwise(F.split(inner, SPACE)).alias("w"),
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(NOT_SPACE)).alias("lines"),
        F.length(F.regexp_replace(text, NOT_SYMBOL, "")).alias("symbols"),
        text.rlike(SEPARATOR).alias("menus"),
        phrases.alias("phrases"),
    )

    def counted(x: Column) -> Column:
        good = F.filter(x["lines"], lambda line: line_passes(line, x["symbols"] > 0, x["menus"], x["phrases"]))
        return let(good, lambda g: F.struct(
            F.size(x["w"]).cast("long").alias("n_words"),
            F.length(F.array_join(x["w"], "")).cast("long").alias("word_chars"),
            x["symbols"].cast("long").alias("n_symbols"),
            (F.size(x["lines"]) - F.size(F.array_distinct(x["lines"]))).cast("long").alias("n_dup_lines"),
            let(x["w"], _repeated).cast("long").alias("n_repeat_words"),
            (F.size(x["lines"]) - F.size(g)).cast("long").alias("n_lines_removed"),
            F.array_join(g, "\n").alias("clean_text"),
        ))

    rows = docs.select("doc_id", let(parts, counted).alias("x")).select("doc_id", "x.*")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    left = F.length(F.regexp_replace("clean_text", SPACE, "")).cast("long")
    passed = left >= (1 - MOST_LOST) * F.col("word_chars")
    return rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & passed)
