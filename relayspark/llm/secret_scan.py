"""Secrets in texts: known patterns, and strings of high entropy.

A candidate string (a long run of token characters) is walked with a window whose character counts change by
the one that enters and the one that leaves; from them the sum of c * log2(c), and so the window's Shannon
entropy, follows step by step. A hex string and a mixed string have thresholds of their own. An allow-list
suppresses candidates that are no secrets although they look random. No shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relayspark.llm.common import between, let, pieces_of, running, spare

#: Patterns, with the least length of the match (of its second group, for ``assign``).
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "entropy")

#: Candidates of the entropy scan, the window, and the bits a window must reach in each class of characters.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
HEX_BITS = 3.0
MIXED_BITS = 3.7
#: Never secrets: strings of letters alone or digits alone, UUIDs, and slugs or paths of plain words (possessive, so
#: that a very long slug costs no stack); and the parts of a string that hold one of the sample words.
ALLOWED = (
    r"^[A-Za-z_/=+-]*$|^[0-9_/=+-]*$"
    r"|^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
    r"|^(?:[A-Za-z]++|[0-9]{1,4}+)(?:[-_/](?:[A-Za-z]++|[0-9]{1,4}+))++[-_/]?$"
)
SAMPLE = r"(?i)(example|sample|dummy|placeholder|changeme|xxxxx|00000)"
MASK = "[SECRET]"

_SPAN = "array<struct<start:int,rank:int,end:int,value:int>>"


def _spans(text: Column, pattern: str, rank: int, keep, value=None) -> Column:
    """Matches of ``pattern``, leftmost and without overlap, that ``keep``: start, end and where the value
    starts, in code points. What lies between the matches gives their places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value)) if value else found
    gaps = F.split(text, pattern, -1)
    steps = F.zip_with(F.arrays_zip(found.alias("m"), values.alias("v")), F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.struct(
        F.length(g).alias("gap"), F.length(m["m"]).alias("size"), m["v"].alias("v")))

    def span(x: Column, before: Column) -> Column:
        begin = before + x["gap"]
        end = begin + x["size"]
        return F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), (end - F.length(x["v"])).alias("value"), keep(x["v"]).alias("ok"))

    def placed(x: Column) -> Column:
        return F.filter(F.zip_with(x, running(F.transform(x, lambda s: s["gap"] + s["size"])), span), lambda s: s["ok"])

    plain = F.transform(let(steps, placed), lambda s: F.struct(*[s[c].alias(c) for c in ("start", "rank", "end", "value")]))
    return F.when(text.rlike(pattern), plain.cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def _weight(count: Column) -> Column:
    return F.when(count > 1, count * F.log2(count.cast("double"))).otherwise(F.lit(0.0))


def top_entropy(value: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy (bits a character) of any ``window`` consecutive characters.

    The counts are a string of one character for each of ``ALPHABET``, of which a step sets two: the count of
    the character that enters and of the one that leaves."""
    places = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    steps = F.transform(places, lambda c, i: F.struct(c.alias("into"), F.lit(0).alias("out"), i.alias("i")))
    late = F.concat(F.array_repeat(F.lit(0), window), places)
    steps = F.zip_with(steps, F.slice(late, F.lit(1), F.size(places)), lambda s, o: F.struct(s["into"].alias("into"), o.alias("out"), s["i"].alias("i")))
    begin = F.struct(F.lit("0" * len(ALPHABET)).alias("n"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("top"))

    def count(held: Column, place: Column) -> Column:
        return F.ascii(F.substring(held, place, F.lit(1))) - ord("0")

    def put(held: Column, number: Column, place: Column) -> Column:
        return F.overlay(held, F.chr(number + ord("0")), place, F.lit(1))

    def step(acc: Column, x: Column) -> Column:
        # Count of the character that enters, and of the one that leaves once the other is in.
        entering = count(acc["n"], x["into"])
        leaving = count(acc["n"], x["out"]) + (x["out"] == x["into"]).cast("int")
        total = acc["sum"] + _weight(entering + 1) - _weight(entering)
        total = total + F.when(x["out"] > 0, _weight(leaving - 1) - _weight(leaving)).otherwise(0.0)
        held = put(acc["n"], entering + 1, x["into"])
        held = F.when(x["out"] > 0, put(held, leaving - 1, x["out"])).otherwise(held)
        bits = F.when(x["i"] >= window - 1, F.log2(F.lit(float(window))) - total / window).otherwise(0.0)
        return F.struct(held.alias("n"), total.alias("sum"), F.greatest(acc["top"], bits).alias("top"))

    return F.aggregate(steps, begin, step, lambda a: a["top"])


def _random(value: Column) -> Column:
    """Whether a window of a candidate string reaches the bits of its class. Of a string with sample words, the parts
    (between slashes or equals signs) that hold them are left out."""
    bits = F.when(value.rlike(r"^[0-9a-fA-F]+$"), F.lit(HEX_BITS)).otherwise(F.lit(MIXED_BITS))
    rest = F.when(value.rlike(SAMPLE), F.array_join(F.filter(F.split(value, "[/=]"), lambda p: ~p.rlike(SAMPLE)), "/")).otherwise(value)
    return F.when(value.rlike(ALLOWED), F.lit(False)).otherwise(let(rest, lambda r: ~r.rlike(ALLOWED) & (top_entropy(r) >= bits)))


def scan(docs: DataFrame, into: str = "found") -> DataFrame:
    """``docs`` (all columns; one named ``into`` is replaced) with ``into``: an array of spans (start, rank, end,
    value) by start, then kind. ``rank`` is an index of KINDS, ``value`` the start of the secret itself, all in
    code points.

    Spans of known patterns are all there. An ``entropy`` span is there unless one of those covers all of it. Null
    and empty texts have none; equal texts have equal spans; an empty table stays empty.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = F.concat(
        _spans(text, ASSIGN, 0, lambda v: F.length(v) >= ASSIGN_LEAST, 2),
        _spans(text, ACCESS, 1, lambda v: F.length(v) >= ACCESS_LEAST),
        # Shorter runs would be dropped anyway, and a run of hex digits never overlaps another.
        _spans(text, f"{HEX[:-1]}{{{HEX_LEAST},}}", 2, lambda v: F.length(v) >= HEX_LEAST),
    )
    more = _spans(text, CANDIDATE, 3, _random)

    def uncovered(every: Column) -> Column:
        # Spans in order: how far the known ones before each reach.
        reach = running(F.transform(every, lambda s: F.when(s["rank"] < 3, s["end"]).otherwise(0)), F.greatest)
        marked = F.zip_with(every, reach, lambda s, r: F.struct(s.alias("s"), ((s["rank"] == 3) & (r >= s["end"])).alias("covered")))
        return F.transform(F.filter(marked, lambda m: ~m["covered"]), lambda m: m["s"])

    def joined(found: Column) -> Column:
        every = F.sort_array(F.concat(found["base"], found["more"]))
        return F.when((F.size(found["base"]) > 0) & (F.size(found["more"]) > 0), let(every, uncovered)).otherwise(every)

    return docs.withColumn(into, let(F.struct(base.alias("base"), more.alias("more")), joined))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"], s["end"])), ",")


def redact(docs: DataFrame, mask: str = MASK) -> DataFrame:
    """``docs`` with each secret in ``text`` replaced by ``mask`` (of an assignment, only the value).

    Overlapping secrets become one mask. ``n_chars``, if there, is set anew for rows that change. All columns
    stay; rows without a secret, null and empty texts too, stay as they are. An empty table stays empty."""
    [found] = spare(docs, "__found")
    rows = scan(docs, found)
    text = F.col("text").cast("string")
    ordered = F.sort_array(F.transform(found, lambda s: F.struct(s["value"].alias("value"), s["end"].alias("end"))))

    def masked(x: Column) -> Column:
        ends = F.transform(x["spans"], lambda s: s["end"])
        part = lambda s, to: F.when(s["value"] >= to, F.concat(between(x["pieces"], to, s["value"]), F.lit(mask))).otherwise("")
        return F.concat(F.array_join(F.zip_with(x["spans"], running(ends, F.greatest), part), ""), between(x["pieces"], F.array_max(ends), F.length(text)))

    clean = let(F.struct(ordered.alias("spans"), pieces_of(text).alias("pieces")), masked)
    hit = F.size(found) > 0
    rows = rows.withColumn("text", F.when(hit, clean).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(hit, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)
