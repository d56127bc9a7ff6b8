"""Each operator against brute force, an exact round trip or held-out accuracy, and its edge cases."""

import collections
import contextlib
import hashlib
import html
import os
import random
import re
import time
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from relayspark.llm import (
    chat_format,
    common,
    components,
    decontaminate,
    html_extract,
    language_id,
    minhash,
    packing,
    quality,
    queries,
    secret_scan,
    sharding,
    token_files,
)
from relayspark.llm.encoding import encoder

SF_DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD, SPACED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def table(name):
    return pq.read_table(f"{SF_DIR}/{name}.parquet").to_pylist()


def frame(spark, texts, extra=False):
    """Rows of (doc_id, text); with columns whose names clash if ``extra``."""
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], DOCS)
    for name in ("found", "slot", "shard", "score", "lang_pred", "class", "h", "w", "cluster", "grp", "ids", "at", "items") if extra else ():
        df = df.withColumn(name, F.lit("clash"))
    return df


@contextlib.contextmanager
def timed(limit):
    """Fails if what it is around takes longer than ``limit`` seconds: far less than a square of its size would."""
    began = time.monotonic()
    yield
    assert time.monotonic() - began < limit


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "..."), (6, "word " * 30_000), (None, "no id at all"), (7, "é" * 50), (8, "one")]


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD, extra=True)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def duck_rows(sql):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con.execute(sql).df()


@pytest.mark.parametrize("name", sorted(queries.oracles()))
def test_query_matches_sql(spark, name):
    want, got = duck_rows(queries.oracles()[name]), queries.QUERIES[name](spark, SF_DIR).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    rows = lambda x: sorted(map(repr, x[sorted(x.columns)].astype(object).values.tolist()))
    assert rows(want) == rows(got)


# -- 1 sharding


def test_table_is_filled_by_turns():
    names, slots = [f"s{i}" for i in range(7)], 101
    walks = [[(o + k * s) % slots for k in range(slots)] for o, s in (sharding.preference(n, slots) for n in names)]
    owner, turn = {}, 0
    while len(owner) < slots:
        owner[next(x for x in walks[turn % 7] if x not in owner)] = turn % 7
        turn += 1
    made = sharding.lookup_table(names, slots)
    assert made == [owner[i] for i in range(slots)]
    count = collections.Counter(made)
    assert max(count.values()) - min(count.values()) <= 1
    fewer = sharding.lookup_table(names[:-1], slots)
    assert sum(a != b for a, b in zip(made, fewer, strict=True) if a != 6) < slots // 4


def test_weights_and_bad_tables():
    made = collections.Counter(sharding.lookup_table(["a", "b"], 1009, {"a": 3}))
    assert abs(made[0] / made[1] - 3) < 0.05
    for bad in (lambda: sharding.lookup_table(["a"], 100), lambda: sharding.lookup_table(["a", "a"]), lambda: sharding.lookup_table([])):
        with pytest.raises(ValueError):
            bad()


def test_sharding_edges(spark, odd, none, tmp_path):
    rows = sharding.assign(odd, "doc_id", ["a", "b", "c"]).select("doc_id", "shard", "slot", "found").collect()
    assert len(rows) == len(ODD) and len({r.shard for r in rows if r.doc_id == 4}) == 1
    assert next(r for r in rows if r.doc_id is None).slot == 0
    assert sharding.assign(none, "doc_id", ["a"]).count() == 0
    sharding.write_shards(odd.drop("slot", "shard"), str(tmp_path / "out"), "doc_id", ["a", "b"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(ODD)


def test_the_key_may_be_a_column_that_is_replaced(spark):
    rows = spark.createDataFrame([(f"k{i % 5}", i) for i in range(20)], "shard string, slot long")
    want = {r.k: (r.slot, r.shard) for r in sharding.assign(rows.select(F.col("shard").alias("k")), "k", ["a", "b", "c"]).collect()}
    assert {(r.slot, r.shard) for r in sharding.assign(rows, "shard", ["a", "b", "c"]).collect()} == set(want.values())
    assert sharding.assign(rows, "slot", ["a", "b", "c"]).count() == 20


# -- 2 decontamination


def brute_hits(docs, items, window=10):
    known = {}
    for item, text in items:
        words = WORD.findall(lower(text))
        for k in range(max(1, len(words) - window + 1) if words else 0):
            known.setdefault(tuple(words[k : k + window]), set()).add(str(item))
    out = []
    for doc, text in docs:
        words, hit, ids = WORD.findall(lower(text)), set(), set()
        for n in {len(k) for k in known}:
            for k in range(len(words) - n + 1):
                if found := known.get(tuple(words[k : k + n])):
                    hit |= set(range(k, k + n))
                    ids |= found
        out.append((doc, len(words), len(hit), len(ids), sorted(ids)))
    return out


def test_hits_equal_brute_force(spark):
    rng = random.Random(2)
    words = ["Alpha", "beta", "gam-ma", "DELTA", "éta", "zÉta", "9", "iota"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(1, text(14)), (2, text(10)), (3, "only three words"), (4, "solo"), (5, ""), (6, None), (2, text(12)), (7, text(10))]
    docs = [(i, text(rng.randint(0, 30))) for i in range(40)] + ODD
    docs += [(100, f"x {items[0][1]} y"), (101, items[1][1].upper()), (102, "only, three words!"), (103, f"{text(5)} solo"), (104, f"{items[0][1]} {items[7][1]}")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit("clash"))
    got = decontaminate.decontaminate(frame(spark, docs, extra=True), bench).collect()
    key = lambda r: (r[0] is not None, r)
    assert sorted([(r.doc_id, r.n_words, r.n_hit, r.n_items, list(r["items"])) for r in got], key=key) == sorted(brute_hits(docs, items), key=key)


def test_passages_are_removed(spark, none):
    passage = " ".join(f"w{i}" for i in range(12))
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    clean = " ".join(f"c{i}" for i in range(40))
    docs = frame(spark, [(1, f"{clean}. {passage.upper()}! The end."), (2, clean), (3, passage), (4, None)], extra=True)
    got = {r.doc_id: r for r in decontaminate.without_hits(docs, bench).collect()}
    assert got[1].text == f"{clean}. ! The end." and got[1].n_chars == len(got[1].text)
    assert set(got) == {1, 2, 4} and got[2].text == clean and got[4].text is None
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(docs, empty).where("contaminated").count() == 0
    assert decontaminate.decontaminate(none, bench).count() == 0 and decontaminate.without_hits(docs, empty).count() == 4


# -- 3 language


def test_language_of_held_out_rows(spark):
    truth = {r["doc_id"]: r["lang"] for r in table("documents")}
    got = queries.op3_language_id(spark, SF_DIR).collect()
    assert {r.doc_id for r in got} == set(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.97 * len(held)


def test_kernel_is_the_mean_cosine_of_presence():
    model = language_id.fit([("abc abd", "x"), ("zzz zz", "y"), ("abe", "x")])
    grams = lambda t, n: {t[i : i + n] for i in range(len(t) - n + 1)}
    known = [set().union(*(grams(t, n) for t in ("abc abd", "abe", "zzz zz"))) for n in language_id.GRAMS]
    value = sum(len((a := grams("abx", n) & known[n - 1]) & (b := grams("abe", n))) / max(1e-9, (len(a) * len(b)) ** 0.5) for n in language_id.GRAMS) / 3
    assert model.languages == ["x", "y"] and model.owner.tolist() == [0, 0, 1]
    grams = list(language_id._hashed(["q", "abx"]))
    for dense in (None, model.dense()):
        assert model.kernel(grams, 2, model.tables(), dense)[1, 1] == pytest.approx(value, abs=1e-6)


def test_predictions_equal_brute_force():
    rng = random.Random(3)
    letters = {"x": "abcde", "y": "cdefg", "z": "xyzab"}
    text = lambda lang: " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(4, 12)))
    labelled = [(text(lang), lang) for lang in "xyz" for _ in range(40)]
    model = language_id.fit(labelled)
    grams = lambda t, n: {t[i : i + n] for i in range(len(t) - n + 1)}
    marks = [t for lang in "xyz" for t in [t for t, own in labelled if own == lang][: language_id.LANDMARKS_PER_LANGUAGE]]
    every = {n: set().union(*(grams(t, n) for t in marks)) for n in language_id.GRAMS}

    def kernel(a, b):
        return sum(len(grams(a, n) & grams(b, n)) / max(1, len(grams(a, n) & every[n]) * len(grams(b, n))) ** 0.5 for n in language_id.GRAMS) / len(language_id.GRAMS)

    rows = np.asarray([[kernel(t, m) for m in marks] for t, _ in labelled])
    among = np.asarray([[kernel(t, m) for m in marks] for t in marks])
    target = np.asarray([[1.0 if own == lang else -1.0 for lang in "xyz"] for _, own in labelled]) / 40
    weights = np.linalg.solve(rows.T @ rows / 40 + language_id.RIDGE * among + 1e-9 * np.eye(len(marks)), rows.T @ target)
    asked = [text(lang) for lang in "xyz" for _ in range(30)]
    want = np.asarray([[kernel(t, m) for m in marks] for t in asked]) @ weights
    grams = list(language_id._hashed(asked))
    for dense in (None, model.dense()):
        got = model.kernel(grams, len(asked), model.tables(), dense) @ model.weights
        assert np.allclose(got, want, atol=1e-3)
        assert (model.predict(asked, model.tables(), dense)[0] == want.argmax(axis=1)).all()


def test_many_languages_stay_small():
    rng = random.Random(31)
    chars = [chr(c) for c in range(0x4E00, 0x4E00 + 6000)]
    labelled = [("".join(rng.choice(chars[20 * k : 20 * k + 60]) for _ in range(400)), f"l{k:03d}") for k in range(150) for _ in range(10)]
    model = language_id.fit(labelled, landmarks=300)
    assert len(model.owner) == 300 and len(model.languages) == 150
    asked = ["".join(rng.choice(chars[20 * k : 20 * k + 60]) for _ in range(200)) for k in range(150)]
    asked_grams = list(language_id._hashed(asked))
    known = model.known(asked_grams, 150, model.tables(), np.arange(150))
    model.whole = None  # the same from the pairs alone
    assert all((a == b).all() for a, b in zip(known, model.known(asked_grams, 150, model.tables(), np.arange(150)), strict=True))
    assert (model.predict(asked, model.tables())[0] == np.arange(150)).mean() > 0.95
    assert sum(x.nbytes for x in (model.bounds, model.held, model.pairs, model.holders, model.weights)) < 64 << 20


def test_language_edges(spark, odd, none):
    model = language_id.train(spark.read.parquet(f"{SF_DIR}/documents.parquet"))
    got = [(r.doc_id, r.lang_pred, r.score) for r in language_id.classify(odd, model).collect()]
    assert len(got) == len(ODD) and all(0 <= s <= 1 for _, _, s in got)
    assert {i for i, lang, s in got if lang == "und" and s == 0} == {1, 2, 3, 5}
    assert language_id.train(none) is None
    assert {r.lang_pred for r in language_id.classify(odd, None).collect()} == {"und"}
    assert language_id.classify(none, model).count() == 0 and language_id.accepted(language_id.classify(odd, model)).count() >= 1


#: Texts in no language of the tables, most of them in letters that those use.
UNLEARNED = {
    "th": "ภาษาไทยเป็นภาษาที่มีระดับเสียงของคำแน่นอน เมื่อวานเราไปตลาดและซื้อผลไม้มากมาย",
    "ja": "日本語は主に日本で使われている言語です。昨日は友達と一緒に海へ行き、夕食に魚を食べました。",
    "ru": "Русский язык относится к восточнославянской группе. Вчера мы гуляли по лесу, собирали грибы и ягоды.",
    "ar": "اللغة العربية هي أكثر اللغات السامية تحدثا. ذهبنا أمس إلى السوق واشترينا الفاكهة والخبز.",
    "el": "Η ελληνική γλώσσα μιλιέται στην Ελλάδα και στην Κύπρο. Χθες πήγαμε στη θάλασσα και μετά φάγαμε ψάρι.",
    "fi": "Suomen kieli kuuluu uralilaisten kielten ryhmään, ja sitä puhutaan pääosin Suomessa. Talvella lumi peittää metsät ja järvet, ja ihmiset hiihtävät tai viettävät aikaa saunassa ystävien kanssa.",
    "pl": "Język polski należy do grupy języków zachodniosłowiańskich. Wczoraj poszliśmy na spacer do lasu, gdzie zbieraliśmy grzyby i jagody, a potem wróciliśmy zmęczeni do domu na obiad.",
    "base64": "q9Xv2LmR7tYk4WzB8nHs3pDfVGhpcyBpcyBub3Qgc28gZWFzeSB0byByZWFkQUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVphYmNkZWZnaGlqa2xtbm9wcXJzdHV2",
}


def test_texts_in_unlearned_languages_are_rejected(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    model = language_id.train(docs)
    got = language_id.classify(frame(spark, list(enumerate(UNLEARNED.values()))), model).collect()
    assert {r.lang_pred for r in got} == {"und"} and all(r.score < 0.05 for r in got if r.doc_id < 5)
    clean = docs.where(language_id.is_held_out(F.col("doc_id")) & (F.length("text") > 200))
    assert language_id.accepted(language_id.classify(clean, model)).count() == clean.count() > 20


def test_every_labelled_language_is_learned(spark):
    rows = [(i, f"{chr(0x4E00 + i % 120)} only {i}", f"l{i % 120:03d}", "s", 1) for i in range(960)]
    rows += [(i, "lange Texte allein " * 1_200, "long", "s", 1) for i in range(1_000, 1_008)]
    model = language_id.train(spark.createDataFrame(rows, DOCS))
    assert model.languages == [f"l{i:03d}" for i in range(120)] + ["long"]


# -- 4 chat


def fold(events):
    out = []
    for kind, role, text in events:
        if kind == "message" or not out:
            out.append([role or "", "" if kind == "regenerate" else text or ""])
        elif kind == "delta":
            out[-1][1] += text or ""
        else:
            out[-1][1] = "" if kind == "regenerate" else text or ""
    return out


def test_events_fold_in_sequence(spark):
    rng = random.Random(4)
    log = {(c, t): [(rng.choice(["message", "delta", "edit", "regenerate"]), rng.choice(["user", "assistant", None]), rng.choice(["a", "<|", None, "b\\"])) for _ in range(rng.randint(1, 6))] for c in range(5) for t in range(4)}
    rows = [(c, t, s, *e) for (c, t), es in log.items() for s, e in enumerate(es)]
    rng.shuffle(rows)
    turns = chat_format.reconstruct(spark.createDataFrame(rows, "conv_id long, turn long, seq long, event string, role string, text string"))
    assert {(r.conv_id, r.turn): [list(m) for m in r.messages] for r in turns.collect()} == {k: fold(v) for k, v in log.items()}


def test_template_round_trip(spark):
    texts = ["", None, "<|im_end|>", "<\\|x", "<\\\\|", "<", "|", "\\", "a\nb", "<|im_start|>system\nhi<|im_end|>\n", "é🙂<|", "<\\"]
    roles = ["user", "assistant", "a\nb", "\\n", "x\\", "<|im_start|>", None]
    rows = [(c, t, t, "message", roles[((c or 0) + t) % len(roles)], x) for c in (1, None) for t, x in enumerate(texts * 30)]
    parts = chat_format.render(chat_format.reconstruct(spark.createDataFrame(rows, "conv_id long, turn long, seq long, event string, role string, text string")), 50)
    whole = parts.collect()
    for p in whole:
        turns = len(p.formatted.split("<|im_start|>")) - 1
        assert turns and p.formatted.count("<|im_end|>\n") == turns and p.formatted.count("<|") == 2 * turns
        assert [p.formatted[s.start - 10 : s.start] for s in p["mask"]] == ["assistant\n"] * len(p["mask"])
    back = sorted(chat_format.read_back(parts).collect(), key=lambda r: (r.conv_id is not None, r.part))
    for c in (1, None):
        want = [(r or "", x or "") for k, _, _, _, r, x in rows if k == c]
        assert [tuple(m) for p in back if p.conv_id == c for m in p.messages] == want
        assert [x for p in back if p.conv_id == c for x in p.scored] == [x for r, x in want if r == "assistant"]


def test_chat_query(spark):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in table("conversations")]
    rows += [(-1, 0, "user", queries.INJECTION), (-1, 1, "assistant", queries.INJECTION)]
    want = {}
    for c in {r[0] for r in rows}:
        own = sorted(r[1:] for r in rows if r[0] == c)
        loss = "".join(t or "" for _, r, t in own if r == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[c] = (len(own), digest("".join(f"{r}\n{t or ''}\n" for _, r, t in own)), len(loss), digest(loss))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in queries.op4_chat_formatting(spark, SF_DIR).collect()}
    assert got == want


def test_chat_edges(spark):
    schema = "conv_id long, turn long, seq long, event string, role string, text string, part string, t string"
    made = chat_format.render(chat_format.reconstruct(spark.createDataFrame([(1, None, None, None, None, None, "x", "x"), (1, 1, 1, "message", "user", "a", "x", "x"), (1, 1, 1, "message", "user", "a", "x", "x")], schema)))
    row = chat_format.digests(chat_format.read_back(made)).first()
    assert row.n_turns == 3 and row.loss_chars == 0
    assert chat_format.digests(chat_format.read_back(chat_format.render(chat_format.reconstruct(spark.createDataFrame([], schema))))).count() == 0


# -- 5 packing and 7 files


def ids_of(name, end, rows):
    tokenizer = Tokenizer.from_file(queries.vocabulary(name))
    return {i: np.asarray([*tokenizer.encode(t or "", add_special_tokens=False).ids, end], dtype="<u4") for i, t in rows}


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_give_the_ids_of_whole_texts(name):
    rng = random.Random(1)
    parts = [*" \n\t\r\x1caB'!1<", "  ", "é", "é", "Σ", "٣", " ", "　", "​", "🙂", "<|endoftext|>", "<|endoftext|> ", "it's", "  x"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)] + ["", None]
    plain = [p for p in parts if "<" not in p] + ["Word", "é", "ȳ", "ab", "9", "#", "can't", "-", "_", "|>", "<", "ſ", "K", "İ"]
    texts += ["".join(rng.choice(plain) for _ in range(rng.randint(0, 25))) for _ in range(6000)]
    odd = [*plain, "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u202f", "\u205f", "\u200b", "”", "’", "…", "é", "ŉ", "×", "ÿ", "Ab1", "'S", "'ll", "\x00", "\x7f", "'", "’s", " \u0301", "\u0338"]
    texts += ["".join(rng.choice(odd) for _ in range(rng.randint(0, 25))) for _ in range(9000)]
    enc = encoder(queries.vocabulary(name))
    assert enc.cuts
    want = [np.asarray(x.ids, dtype="<u4").tobytes() for x in enc.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert enc.encode_all(texts) == want and enc.encode_all(texts[::-1]) == want[::-1]


def test_an_unknown_pre_tokeniser_gets_whole_texts(tmp_path):
    made = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    made.pre_tokenizer = pre_tokenizers.Metaspace()
    made.save(str(tmp_path / "own.json"))
    enc = encoder(str(tmp_path / "own.json"))
    texts = ["a b, c", None, "", "it's  two"]
    assert enc.cuts is None and enc.encode_all(texts) == [np.asarray(made.encode(t or "").ids, dtype="<u4").tobytes() for t in texts]


def test_tree_places_as_a_scan_does():
    rng = random.Random(5)
    sizes = [rng.randint(1, 100) for _ in range(400)]
    bins, want = [], [None] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        spot = next((b for b, used in enumerate(bins) if used + sizes[i] <= 100), len(bins))
        if spot == len(bins):
            bins.append(0)
        want[i] = (spot, bins[spot])
        bins[spot] += sizes[i]
    assert packing.first_fit_decreasing(sizes, 100) == want


def check_pieces(rows, ids, capacity=2048):
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        assert np.frombuffer(r.ids, dtype="<u4").tolist() == ids[r.doc_id][r.start : r.start + r.length].tolist() and r.doc_tokens == len(ids[r.doc_id])
        by_doc[r.doc_id].append((r.start, r.length))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts, total in [*((v, len(ids[k])) for k, v in by_doc.items()), *((v, None) for v in by_sequence.values())]:
        at = 0
        for start, length in sorted(parts):
            assert start == at and length > 0
            at += length
        assert at == total if total else at <= capacity
    assert set(by_doc) == set(ids)
    return sum(map(len, ids.values())) / (capacity * len(by_sequence))


def test_packing_covers_every_id(spark):
    rows = [(r["doc_id"], r["text"]) for r in table("documents")]
    path = queries.vocabulary("word_bpe_49k.json")
    got = packing.pack(spark.read.parquet(f"{SF_DIR}/documents.parquet"), path).collect()
    assert check_pieces(got, ids_of("word_bpe_49k.json", 1, rows)) > 0.98


def test_packing_edges(spark, odd, none):
    path = queries.vocabulary("word_bpe_49k.json")
    got = packing.pack(odd, path, group_ids=300)
    assert got.select("doc_id").distinct().count() == 9 and got.where("start = 0").count() == len(ODD)
    assert packing.pack(none, path).count() == 0
    whole = packing.sequences(got).collect()
    assert all(r.tokens <= 2048 and len(r.ids) == 4 * r.tokens for r in whole)
    assert sum(r.tokens for r in whole) == got.agg(F.sum("length")).first()[0]


def test_hot_ids_and_long_texts_are_spread(spark):
    rows = [(None if i % 3 else 7, f"text {i} " * (i % 9)) for i in range(3000)] + [(None, None)] * 50 + [(8, "long text, really " * 40_000)]
    docs = frame(spark, rows).repartition(6)
    pieces = packing.pack(docs, queries.vocabulary("word_bpe_49k.json"), group_ids=50_000).collect()
    bins = collections.defaultdict(list)
    for r in pieces:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in pieces)
    assert total > 0.97 * 2048 * len(bins) and sum(r.start == 0 for r in pieces) == len(rows)
    assert total == sum(r.doc_tokens for r in pieces if r.start == 0)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    folder, manifest = token_files.write_files(docs, queries.vocabulary("byte_bpe_50k.json"), file_ids=5000)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = manifest.collect()
    assert len({f.part for f in files}) > 1 and max(f.n_docs for f in files) < len(rows) / 2
    back = sorted(token_files.read_files(folder, manifest).collect(), key=lambda r: r.start)
    assert len(back) == len(rows) and all(a.start + a.n_tokens == b.start for a, b in zip(back, back[1:], strict=False))
    key = lambda x: (x is not None, x)
    assert [r.doc_id for r in back] == sorted((i for i, _ in rows), key=key)


def test_elias_fano_selects():
    rng = random.Random(7)
    for n, top in ((1, 0), (1, 9), (1000, 10), (1000, 10**6), (700, 0), (5000, 10**9)):
        values = np.sort(np.asarray([rng.randint(0, top) for _ in range(n)]))
        ef = token_files.EliasFano.encode(values)
        assert ef.select_run(0, n).tolist() == values.tolist()
        assert [ef.select(i) for i in range(n)] == values.tolist()
        for _ in range(50):
            i = rng.randrange(n)
            many = rng.randint(1, n - i)
            assert ef.select_run(i, many).tolist() == values[i : i + many].tolist()
        assert len(ef.low) + len(ef.high) <= n * (2 + max(1, (top // n).bit_length())) / 8 + 16


def test_file_gives_documents_back():
    for kind in ("<u2", "<u4"):
        ids = np.arange(70, dtype=kind)
        got = token_files.TokenFile(token_files.file_bytes([None, 3, 5], [10, 0, 60], ids))
        assert got.doc_ids.to_pylist() == [None, 3, 5] and [got.document(i).tolist() for i in range(3)] == [ids[:10].tolist(), [], ids[10:].tolist()]
    with pytest.raises(ValueError):
        token_files.TokenFile(b"x" * 100)


def test_files_hold_every_id_in_order(spark):
    rows = sorted((r["doc_id"], r["text"]) for r in table("documents"))
    ids, start, want = ids_of("byte_bpe_50k.json", 2, rows), 0, []
    for i, _ in rows:
        want.append((i, start, len(ids[i]), zlib.crc32(ids[i].tobytes())))
        start += len(ids[i])
    assert sorted(map(tuple, queries.op7_token_files(spark, SF_DIR).collect())) == want


def test_file_edges(spark, odd, none):
    path = queries.vocabulary("byte_bpe_50k.json")
    got = token_files.read_files(*token_files.write_files(odd, path, file_ids=50)).collect()
    assert len(got) == len(ODD) and got and sum(r.n_tokens == 1 for r in got) == 2
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == [None, 1, 2, 3, 4, 4, 5, 6, 7, 8]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(ordered, ordered[1:], strict=False))
    assert token_files.read_files(*token_files.write_files(none, path)).count() == 0


# -- 6 quality


def test_quality_edges(spark, odd, none):
    got = quality.judge(odd).collect()
    assert len(got) == len(ODD) and {r.n_words for r in got if r.doc_id in (1, 2, 3)} == {0}
    long = next(r for r in got if r.doc_id == 6)
    assert long.n_words == long.n_repeat_words == 30_000 and long.base_failed and not long.kept
    assert quality.judge(none).count() == 0


def test_lines_are_judged_first(spark):
    good = "This is a sentence of quite a few plain words, as prose has them.\nAnd here comes another one that differs from the first line.\n"
    bad = "Home | About | Contact | Help\nAll rights reserved.\n*** ### $$$ %%% bad line here.\nno end to this line\n"
    got = {r.doc_id: r for r in quality.judge(frame(spark, [(1, good + bad), (2, bad * 3 + "Only this one sentence is any good at all."), (3, good)])).collect()}
    assert got[1].kept and got[1].n_lines_removed == 4 and got[1].clean_text == good.strip()
    assert not got[2].kept and got[2].n_lines_removed == 12
    assert got[3].kept and got[3].n_lines_removed == 0


def test_repeated_windows_equal_brute_force(spark):
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))) for i in range(60)]
    got = {r.doc_id: r.n_repeat_words for r in quality.judge(frame(spark, docs)).collect()}
    for i, text in docs:
        words = SPACED.findall(text)
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        count = collections.Counter(windows)
        assert got[i] == len({p for k, x in enumerate(windows) if count[x] > 1 for p in range(k, k + 5)})


# -- 8 html


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="home">
<header><p>Site name, slogan.</p></header><nav><ul><li><a href="#">Menu</a></ul></nav><div class="cookie-notice">We use cookies, fine?</div>
<div id="sidebar"><p>Side text, long enough, really.</p></div><%s><h1>Title &amp; more</h1><p>First <b>bold</b> text,\n  with &lt;marks&gt;.<p>Second one. Yes.
<div class="ad">Buy now, cheap!</div><form><p>Your mail, please.</p></form><ul><li>Point one.<li>Point two.</ul></%s>
<section class="comments"><p>I like it, really, so much, it is great.</p></section><footer>&copy; us.</footer></body>"""


@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_main_text_without_the_rest(tag):
    assert html_extract.extract(PAGE % (tag, tag)) == "Title & more\nFirst bold text, with <marks>.\nSecond one. Yes.\nPoint one.\nPoint two."


LONG = "A sentence of the text, which is long enough to count. Another one follows it, as in any text. And then a third."


@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_ratios_choose_inside_the_main_element(tag):
    text = f"<h1>Title</h1><p>{LONG}</p><div class='zq'>Buy now, cheap!</div><ul><li>First point of it.<li>Second point.</ul><p>{LONG}</p>"
    rest = "<h2>More of this</h2><ul class='x7'>" + "<li><a href='/a'>Another page, which is elsewhere</a>" * 5 + "</ul>"
    page = f"<body><{tag}>{text}{rest}</{tag}></body>"
    assert html_extract.extract(page) == f"Title\n{LONG}\nFirst point of it.\nSecond point.\n{LONG}"


def test_text_beside_an_article_counts():
    page = f"<body><div><article><p>{LONG}</p></article><div class='k2'><p>{LONG}</p><p>{LONG}</p></div><div class='k3'>Short.</div></div>"
    assert html_extract.extract(page) == "\n".join([LONG] * 3)


@pytest.mark.parametrize("name", ["layout has-sidebar", "content no-sidebar", "page with-header", "elementor-widget-container", "post comments-open", "sidebar", "search-results"])
def test_names_do_not_hide_the_text(name):
    article = f"<article><p>{LONG}</p><p>{LONG}</p></article>"
    comments = f"<div class='comments'><article class='comment'><p>{LONG} Mine.</p></article></div>"
    assert html_extract.extract(f"<body><p>Site name</p><div class='{name}'>{article}{comments}</div></body>") == f"{LONG}\n{LONG}"
    text = f"<div><p>{LONG}</p><p>{LONG}</p></div>"
    assert html_extract.extract(f"<body><p>Site name</p><div class='{name}'>{text}</div><div class='sidebar-left'>{LONG}</div></body>") == f"{LONG}\n{LONG}"


def test_odd_markup_is_no_text():
    text = f"<article><p>{LONG}</p><p>{LONG}</p>%s</article>"
    both = f"{LONG}\n{LONG}"
    assert html_extract.extract(text.replace("%s</article>", "<!-- open <p>tail, which is long. And so on, and on.</p>")) == both
    assert html_extract.extract(text % f"<div class='commentary'><p>{LONG}</p></div>") == f"{both}\n{LONG}"
    for name in ("comment", "comments", "comment-body", "comment_list", "commentlist"):
        assert html_extract.extract(text % f"<div class='{name}'><p>{LONG}</p></div>") == both
    assert html_extract.extract("<body><p>Foot, a.</p>" + (text % "").join(["<div class='layout with-sidebar'>", "</div>"])) == both
    assert html_extract.extract(f"<p>{LONG}</p><p>{LONG} <b class='x") == f"{LONG}\n{LONG}"
    assert html_extract.extract(f"<p>{LONG}<i>a</b></i> b</p>") == f"{LONG}a b"


def test_tags_that_nothing_closes_take_linear_time():
    with timed(20):
        for page in ("<b><p>x, y.</p>" * 40_000, "<b><p>" + "<i>" * 40_000 + "x, y.</b>" * 40_000, "<div>" * 30_000 + "x, y." + "</span>" * 30_000, "<li><p>x, y." * 40_000, "<!-- " * 50_000, "<" * 50_000 + "p>x"):
            html_extract.extract(page)


def test_pages(spark):
    got = {r.page_id: r for r in queries.op8_html_extraction(spark, SF_DIR).collect()}
    for r in table("pages"):
        body = re.search("<article>(.*)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", body)]
        assert got[r["page_id"]].text == "\n".join(x for x in blocks if x) and got[r["page_id"]].n_chars == len(got[r["page_id"]].text)


def test_html_edges(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>"), (4, "u", "plain, text"), (4, "u", "plain, text"), (None, "u", "<p>a<br>b"), (5, "u", "<div class='sidebar'>all, noise.</div>"), (6, "u", "<p>" * 3000 + "deep" + "<b>" * 3000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = sorted((r.page_id or 0, r.text) for r in html_extract.main_text(df).collect())
    assert got == [(0, "a b"), (1, ""), (2, ""), (3, ""), (4, "plain, text"), (4, "plain, text"), (5, "all, noise."), (6, "deep")]
    assert html_extract.main_text(df.where("false")).count() == 0
    deep = "".join(f"<div class=c{i}>text {i}, here." for i in range(5000)) + "</section>" * 5000
    assert html_extract.extract(deep).count("\n") > 1000


# -- 9 near duplicates


def brute_components(docs, width, percent=80):
    sets = {}
    for i, text in docs:
        words = SPACED.findall(lower(text))
        sets[i] = {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * (n := len(sets[a] & sets[b])) >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in sets)


def copies(rng, n, words=90, edits=6):
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(words)]
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(words)] = f"x{rng.randint(0, 10**6)}"
        yield " ".join(own)


@pytest.mark.parametrize("block", [256, 7])
def test_components_equal_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_CLASSES", block)  # small blocks: the large-cluster path
    rng = random.Random(9)
    texts = [t for n in (70, 9, 2, 2) for t in copies(rng, n)] + ["a b", "a B", "a b c", "", None, " ", "z"] + [f"lone {k} text of its own {k}" for k in range(20)]
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    got = minhash.near_duplicates(frame(spark, docs, extra=True), width=4).collect()
    assert sorted(map(tuple, got)) == brute_components(docs, 4)


def test_query_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in table("documents")]
    assert sorted(map(tuple, queries.op9_minhash(spark, SF_DIR).collect())) == brute_components(docs, 4)


def test_bands_miss_no_similar_pair():
    rng = random.Random(90)
    sets = []
    for _ in range(400):
        n = rng.choice([5, 9, 40, 200])
        base = [rng.getrandbits(64) for _ in range(n)]
        # As different as a link allows: 4 of 5 of the union are shared.
        other = base[: n - n // 9] + [rng.getrandbits(64) for _ in range(n // 9)]
        sets += [np.unique(np.asarray(x, dtype=np.uint64)) for x in (base, other)]
    keys = minhash.band_keys(minhash.signatures(sets, minhash.BANDS * minhash.ROWS), minhash.BANDS, minhash.ROWS)
    met = (keys[::2] == keys[1::2]).any(axis=1)
    assert met.all()


def test_nodes_sort_by_id(spark):
    ids = [None, 0, 1, -1, 9, 255, 256, 2**63 - 1, -(2**63), 10**12]
    rows = spark.createDataFrame([(i, bytearray(b"c" * 16)) for i in ids], "doc_id long, name binary")
    got = rows.select("doc_id", minhash.node_of(F.col("doc_id"), F.col("name")).alias("node")).withColumn("back", minhash.doc_of(F.col("node"))).orderBy("node").collect()
    assert [r.doc_id for r in got] == sorted(i for i in ids if i is not None) + [None] == [r.back for r in got]


def test_shift_gives_every_coordinate():
    values = np.asarray([1, 5, 77], dtype=np.uint64)
    made = minhash.signatures([values, values[:1]], 8)
    x = minhash._first(values)
    for k in range(8):
        moved = x - np.uint32(k)
        assert made[0, k] == minhash._second(moved, np.empty_like(moved), np.empty_like(moved)).min()


def test_near_duplicate_edges(spark, odd, none):
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(odd, width=4).collect()), key=lambda r: (r[0] is not None, r))
    assert got == [(None, None, True), *[(i, i, True) for i in (1, 2, 3, 4, 4, 5, 6, 7)], (8, 4, False)]
    assert minhash.near_duplicates(none).count() == 0 and minhash.deduplicated(none).count() == 0
    left = minhash.deduplicated(odd).collect()
    assert sorted((r.doc_id or 0) for r in left) == [0, 1, 2, 3, 4, 5, 6, 7] and left[0].found == "clash"


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 30)] + [(5, 5), (2, 1)]
    as_node = lambda c: F.encode(F.lpad(F.col(c).cast("string"), 5, "0"), "UTF-8").alias(c)
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long").select(as_node("a"), as_node("b")))
    assert {int(r.node): int(r.component) for r in got.collect()} == {i: 0 for i in range(41)} | {1000 + i: 1000 for i in range(30)}
    assert components.connected_components(spark.createDataFrame([], "a binary, b binary")).count() == 0


# -- 10 secrets

KINDS = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 6, 2), ("access", re.compile("AKIA[A-Z0-9]+"), 20, 0), ("hex", re.compile("[0-9a-f]+"), 24, 0)]


def test_spans_equal_brute_force(spark):
    rng = random.Random(10)
    bits = ["token = ", "'", '"', "password:", "API_KEY=", " ", "\n", "AKIA", "0123456789abcdef" * 2, "deadbeef", "é", "🙂", "aB3", "Zx9Q", "x" * 5, "ſecret=abcdefgh", "...", "\t"]
    docs = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))) for i in range(200)] + ODD
    got = collections.Counter((r.doc_id, r.text) for r in secret_scan.scan(frame(spark, docs, extra=True)).select("doc_id", secret_scan.spans_text(F.filter("found", lambda s: s["rank"] < 3)).alias("text")).collect())
    want = collections.Counter()
    for i, text in docs:
        spans = sorted((m.start(), r, f"{k}:{m.start()}:{m.end()}") for r, (k, p, n, g) in enumerate(KINDS) for m in p.finditer(text or "") if len(m[g]) >= n)
        want[i, ",".join(s for _, _, s in spans)] += 1
    assert got == want


def test_entropy_is_that_of_the_best_window(spark):
    rng = random.Random(11)
    values = ["".join(rng.choice(secret_scan.ALPHABET[: rng.choice([3, 16, 66])]) for _ in range(rng.randint(20, 60))) for _ in range(40)]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", secret_scan.top_entropy(F.col("v")).alias("bits")).collect()
    for r in rows:
        windows = [collections.Counter(r.v[k : k + 20]) for k in range(len(r.v) - 19)]
        assert r.bits == pytest.approx(max(-sum(c / 20 * np.log2(c / 20) for c in w.values()) for w in windows), abs=1e-9)


def test_allow_list_and_masks(spark, none):
    secret = "q9Xv2LmR7tYk4WzB8nHs3pDf"
    texts = [(1, f"key {secret} end"), (2, "internationalizationofeverything and 12345678901234567890123"), (3, "some-long-slug-of-plain-words-in-a-path/2024/01/02"), (4, 'token = "abcdef123" AKIA' + "A1B2C3D4E5F6G7H8"), (5, None), (6, "123e4567-e89b-12d3-a456-426614174000"), (7, "ab-12/" * 60_000)]
    got = {r.doc_id: [s["rank"] for s in r.found] for r in secret_scan.scan(frame(spark, texts)).collect()}
    assert got == {1: [3], 2: [], 3: [], 4: [0, 1], 5: [], 6: [], 7: []}
    clean = {r.doc_id: r for r in secret_scan.redact(frame(spark, texts, extra=True)).collect()}
    assert clean[1].text == "key [SECRET] end" and clean[1].n_chars == 16
    assert clean[4].text == 'token = "[SECRET]" [SECRET]' and clean[5].text is None and clean[2].text == texts[1][1]
    assert secret_scan.scan(none).count() == 0


def brute_entropy(text, base):
    """Spans of random strings, by windows counted one by one."""
    out = []
    for m in re.finditer(secret_scan.CANDIDATE, text or ""):
        value = m[0]
        if re.search(secret_scan.ALLOWED, value):
            continue
        bits = secret_scan.HEX_BITS if re.fullmatch("[0-9a-fA-F]+", value) else secret_scan.MIXED_BITS
        if re.search(secret_scan.SAMPLE, value):
            value = "/".join(p for p in re.split("[/=]", value) if not re.search(secret_scan.SAMPLE, p))
            if re.search(secret_scan.ALLOWED, value):
                continue
        best = 0.0
        for k in range(len(value) - secret_scan.WINDOW + 1):
            count = collections.Counter(value[k : k + secret_scan.WINDOW])
            best = max(best, -sum(c / secret_scan.WINDOW * np.log2(c / secret_scan.WINDOW) for c in count.values()))
        if best >= bits - 1e-9 and not any(a <= m.start() and m.end() <= b for a, b in base):
            out.append((m.start(), 3, f"entropy:{m.start()}:{m.end()}"))
    return out


def test_all_spans_and_masks_equal_brute_force(spark):
    rng = random.Random(12)
    made = lambda n, among=secret_scan.ALPHABET: "".join(rng.choice(among) for _ in range(n))
    bits = [lambda: "token=" + made(24), lambda: made(30), lambda: made(26, "0123456789abcdef"), lambda: "AKIA" + made(20, "ABCXYZ0189"), lambda: "/sample/" + made(25, "aB3xZ9qL"), lambda: "plain-words-of-a-slug-here", lambda: " ", lambda: "é🙂 ", lambda: "sk-" + made(8) + made(24, "0123456789abcdef") + "-" + made(9), lambda: "example" + made(20)]
    docs = [(i, "".join(rng.choice(bits)() + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(0, 12)))) for i in range(150)]
    docs += [(1000, "🙂" * 5000 + " token=abcdef1 " * 900), (1001, "x" * 1024 + "password: hunter2" + "y" * 1007 + " secret=abcdefg")]
    rows = frame(spark, docs)
    got = {r.doc_id: r.text for r in secret_scan.scan(rows).select("doc_id", secret_scan.spans_text(F.col("found")).alias("text")).collect()}
    clean = {r.doc_id: r.text for r in secret_scan.redact(rows).collect()}
    for i, text in docs:
        base = [(m.start(), r, f"{k}:{m.start()}:{m.end()}", m.start(g) if g else m.start(), m.end()) for r, (k, p, n, g) in enumerate(KINDS) for m in p.finditer(text) if len(m[g]) >= n]
        more = brute_entropy(text, [(s[0], s[4]) for s in base])
        assert got[i] == ",".join(s[2] for s in sorted([b[:3] for b in base] + more))
        out, at = [], 0
        for start, end in sorted([(b[3], b[4]) for b in base] + [(m[0], int(m[2].split(":")[2])) for m in more]):
            if start >= at:
                out += [text[at:start], "[SECRET]"]
            at = max(at, end)
        assert clean[i] == "".join(out) + text[at:]


def test_forty_thousand_secrets_in_one_text(spark):
    docs = frame(spark, [(1, "token=abcdef1 " * 40_000), (2, "q9Xv2LmR7tYk4WzB8nHs3pDf, " * 8_000), (3, "q9Xv2LmR7tYk4WzB8nHs3pDf" * 2_000)])
    with timed(60):
        got = {r.doc_id: r.n for r in secret_scan.scan(docs).select("doc_id", F.size("found").alias("n")).collect()}
        assert got == {1: 40_000, 2: 8_000, 3: 1}
        clean = {r.doc_id: r.text for r in secret_scan.redact(docs).collect()}
        assert clean == {1: "token=[SECRET] " * 40_000, 2: "[SECRET], " * 8_000, 3: "[SECRET]"}


def test_long_texts_lose_passages_in_linear_time(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    long = " ".join(f"c{i}" for i in range(200_000))
    docs = frame(spark, [(1, f"{long} {passage}"), (2, f"{passage}, {long}! {passage} " * 2 + "end"), (3, (passage + " x y z a b c d e f g h i j k l. ") * 10_000)])
    with timed(60):
        got = {r.doc_id: r.text for r in decontaminate.without_hits(docs, bench).collect()}
    assert got == {1: f"{long} ", 2: f", {long}! , {long}!  end", 3: " x y z a b c d e f g h i j k l. " * 10_000}


def test_large_benchmarks_meet_by_hash(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "fits_broadcast", lambda *_: False)
    test_hits_equal_brute_force(spark)


EVENTS = "conv_id long, turn long, seq long, event string, role string, text string"


def test_roles_of_any_characters_come_back(spark):
    roles = ["a\x00b", "\x00", "\\", "\\\\n", "\\\n", "\n\\n", "a\\\x00\n", "<|im_end|>\n", "<\\|", "\r\t", "🙂￾", *[chr(c) for c in range(1, 300)]]
    rows = [(1, t, t, "message", r, "x") for t, r in enumerate(roles)]
    back = sorted(chat_format.read_back(chat_format.render(chat_format.reconstruct(spark.createDataFrame(rows, EVENTS)))).collect(), key=lambda r: r.part)
    assert [m.role for p in back for m in p.messages] == roles


def test_long_turns_fold_in_linear_time(spark):
    rows = [(1, 1, s, "message" if s % 2 == 0 else "delta", "assistant", f"text {s} ") for s in range(60_000)]
    rows += [(2, 1, s, "message" if s == 0 else "edit" if s == 50_000 else "delta", "assistant", f"{s} ") for s in range(60_000)]
    with timed(60):
        back = {r.conv_id: r for r in chat_format.read_back(chat_format.render(chat_format.reconstruct(spark.createDataFrame(rows, EVENTS)))).collect()}
    assert [m.text for m in back[1].messages] == back[1].scored == [f"text {s} text {s + 1} " for s in range(0, 60_000, 2)]
    assert back[2].scored == ["".join(f"{s} " for s in range(50_000, 60_000))]


def test_very_long_texts_are_judged_in_linear_time(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    docs = frame(spark, [(1, long + "."), (2, "a b c d e f. " * 40_000), (3, ("x" * 300_000 + " ") * 3), (4, "line, of words.\n" * 60_000)])
    with timed(60):
        got = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert (got[1].n_words, got[1].n_repeat_words, got[1].kept) == (200_000, 0, True)
    assert got[2].n_repeat_words == 240_000 and got[4].n_dup_lines == 59_999 and got[3].n_words == 3


def test_intermediate_tables_are_removed(spark):
    made = common.written(spark.range(3), "kept")
    paths = list(common._MADE[spark.sparkContext.applicationId])
    assert made.count() == 3 and any(os.path.exists(p) for p in paths)
    common.clean(spark)
    assert not any(os.path.exists(p) for p in paths)
