import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.oracle import connection, differs
from txframe.llm import chat, decontaminate, jaccard, language, mixing, pii, quality, queries, sharding, tokens, warc
from txframe.llm.common import prefix_sums

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base = words(1, 80)
    near = base.split()
    near[40] = "zzz"
    item = words(2, 30)
    rows = [
        (1, base, "en", "a", 0), (2, " ".join(near), "en", "a", 0), (3, base, "en", "b", 0), (3, base, "en", "b", 0), (4, None, None, None, None), (5, "", "en", "b", 0), (6, "one two", "en", None, 0),
        (7, "one two", None, "a", 0), (None, words(3, 60), "en", "a", 0), (8, words(4, 20) + " " + item.upper() + " " + words(5, 20), "en", "c", 0), (9, "a | b # $ " * 30, "en", "c", 0),
        (10, (words(6, 12) + "\n") * 5, "fr", "c", 0), (11, words(7, 20_000), "fr", "c", 0), (12, "É è\x0bü\t x " * 10, "fr", "c", 0),
    ]
    return spark.createDataFrame(rows, DOCS).withColumn("key", F.lit(1)).withColumn("token", F.lit("x")).withColumn("size", F.lit(2)).repartition(3).cache()


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, words(2, 30)), (2, words(2, 12)), (3, "one two"), (4, None), (5, "..."), (None, "one"), (6, words(4, 9))], "item_id long, text string")


def empty(spark):
    return spark.createDataFrame([], DOCS)


def pairs(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_oracles(spark):
    con = connection(SF)
    for name, sql in queries.oracle_sql().items():
        assert differs(queries.queries()[name](spark, SF), con, sql) == "", name


def test_prefix_sums(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", None, "b"]), i, rng.randint(0, 9)) for i in range(500)]
    got = {(r.g, r.o): (r.before_v, r.before_rows) for r in prefix_sums(spark.createDataFrame(rows, "g string, o long, v long"), ["g"], [F.col("o").asc()], {"v": "v"}).collect()}
    sums = defaultdict(int)
    n = Counter()
    for g, o, v in rows:
        assert got[g, o] == (sums[g], n[g])
        sums[g] += v
        n[g] += 1


def test_quality_stats(spark, docs):
    got = {(r[0], r[1]): tuple(r)[2:] for r in quality.judge(docs, []).select("doc_id", "text", *[quality.OWN + c for c in (*quality.BASE, "base_failed")]).collect()}
    for (_, text), have in got.items():
        assert have == brute.stats(text)


def test_quality_learns(spark):
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    bad = (x[:, 1] > 0.9) | ((x[:, 0] < 0.2) & (x[:, 2] > 0.7))
    rules = quality.learn(x, bad, ["a", "b", "c"])
    hit = np.zeros(2000, bool)
    for r in rules:
        m = np.ones(2000, bool)
        for c in r.conditions:
            v = x[:, "abc".index(c.feature)]
            m &= v > c.threshold if c.above else v <= c.threshold
        hit |= m
    assert (hit == bad).mean() > 0.97
    assert quality.learn(x, np.zeros(2000, bool), ["a", "b", "c"]) == []
    assert quality.learn(x[:0], bad[:0], ["a", "b", "c"]) == []


def test_jaccard(spark, docs):
    rows = pairs(docs, "doc_id", "text")
    count, least = brute.links(rows)
    got = sorted(pairs(jaccard.ngram_jaccard(docs), "doc_id", "n_links", "class_id"), key=str)
    assert got == sorted(((d, c, k) for (d, _), c, k in zip(rows, count, least)), key=str)


def test_jaccard_many_blocks(spark):
    base = words(9, 60).split()
    rows = []
    for i in range(150):
        w = list(base)
        for j in random.Random(i).sample(range(60), i % 3):
            w[j] = f"x{i}y{j}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    count, least = brute.links(rows)
    assert sorted(pairs(jaccard.ngram_jaccard(df, block=16), "doc_id", "n_links", "class_id")) == [(i, c, k) for i, (c, k) in enumerate(zip(count, least))]


def test_decontaminate(spark, docs, items):
    got = set(pairs(decontaminate.decontaminate(docs, items), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"))
    want = brute.decontaminate(pairs(docs, "doc_id", "text"), pairs(items, "item_id", "text"))
    assert got == want
    assert any(r[-1] for r in want)
    shuffled = set(pairs(decontaminate.decontaminate(docs, items, broadcast_windows=0), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"))
    assert shuffled == want


def test_targets(spark):
    for sizes in ({"a": 100, "b": 1000, "c": 10, None: 50}, {f"s{i}": 100 + i for i in range(20)}, {"a": 0, "b": 5}, {"x": 7}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        want = brute.targets(sizes)
        assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes), (got, want)


def test_mix(spark, docs):
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == docs.count()
    for s in {r.source for r in got}:
        of = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in of) - of[0].target) <= max(r.size for r in of)
        assert all(0 <= r.taken <= 2 * r.size for r in of)
    staged = mixing.mixing_stage(spark, docs, SF)
    assert staged.columns == docs.columns and staged.count() == sum(r.copies for r in got)


def test_sharding(spark, docs):
    got = sharding.assign(docs).collect()
    assert len(got) == docs.count()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) <= 1
    whole = sharding.sharded(docs, 4)
    n = Counter(r.shard for r in whole.collect())
    assert whole.count() == docs.count() and max(n.values()) - min(n.values()) <= 1
    text = {r.doc_id: (r.text or "") for r in docs.collect()}
    assert all(r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.size == len(text[r.doc_id].encode()) + 8 for r in got)


def test_curve_is_hilbert(spark):
    df = spark.range(512).select((F.col("id") % 8).cast("int").alias("x"), (F.floor(F.col("id") / 8) % 8).cast("int").alias("y"), F.floor(F.col("id") / 64).cast("int").alias("z"))
    got = sorted((r[3], r[:3]) for r in df.select("x", "y", "z", sharding.curve_index([F.col("x"), F.col("y"), F.col("z")], 3)).collect())
    assert [i for i, _ in got] == list(range(512))
    assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for (_, p), (_, q) in zip(got, got[1:]))


def test_warc(spark, tmp_path):
    big = "é" * 600
    pages = spark.createDataFrame([(1, "http://a\r\nb", big), (5, None, big), (3, "u", big), (None, "n", big), (2, "u", "small"), (4, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u", "x" * 3_000_000)], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.round_trip(spark, pages).collect()}
    assert len(got) == 9
    assert (got[5].record_type, got[1].refers_to, got[3].record_type, got[None].refers_to) == ("response", 5, "revisit", 5)
    assert got[1].payload_bytes == 1200 and got[1].payload_digest == hashlib.sha1(big.encode()).hexdigest()
    assert got[2].record_type == got[4].record_type == "response" and got[6].payload_bytes == 0 and got[8].payload_bytes == 3_000_000
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_warc_hot_payload(spark, tmp_path):
    """One payload in half of the rows, repeats of the largest page_id, clashing columns; by broadcast and by shuffle."""
    hot, other = "h" * 2000, "o" * 1500
    rows = [(i, f"u{i}", hot if i % 2 else f"{i} " * 400) for i in range(3000)] + [(2999, "again", hot), (None, "none", hot), (7000, "a", other), (7001, "b", other)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("first", F.lit(2)).repartition(5)
    for k, most in enumerate((10, 0)):
        folder = f"file://{tmp_path}/{k}"
        (tmp_path / str(k)).mkdir()
        got = warc.read_archives(warc.write_archives(pages, folder, most=most)).collect()
        assert len(got) == len(rows)
        for r in got:
            want = {hot: 2999, other: 7001}.get(next(h for i, u, h in rows if u == r.url))
            assert (r.record_type, r.refers_to) == (("response", None) if want in (None, r.page_id) else ("revisit", want))


def test_warc_framing():
    import io

    raw = b"".join(warc.encode_record(i, "u", b"p" * i * 999, None) for i in range(4))
    assert [r.payload for r in warc.read_archive(io.BytesIO(raw), True)] == [b"p" * i * 999 for i in range(4)]
    with pytest.raises(warc.WarcError):
        list(warc.read_archive(io.BytesIO(raw[:-9])))


def test_base_spans():
    import re

    text = "a@b.c@d.e x..y@h-1.co.uk, 1.2.3.4 256.1.1.1 1.2.3.4.5, 4111 1111-1111 1111, 4111111111111112, +1 (244) 555-4688 + +49)) é@x.y @b.c a@b"
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    got = pii.base_spans(text)
    assert [(s, e) for s, e, k in got if k == "email"] == [m.span() for m in email.finditer(text)]
    kinds = Counter(k for _, _, k in got)
    assert (kinds["ip"], kinds["card"], kinds["phone"]) == (2, 1, 1)
    rng = random.Random(5)
    for _ in range(3000):
        t = "".join(rng.choice("ab@@..-é ") for _ in range(25))
        assert [(s, e) for s, e, _ in pii.base_spans(t)] == [m.span() for m in email.finditer(t)]


def corpus(sf="sf0.1"):
    return connection(f"/root/testdata/{sf}").sql("SELECT doc_id, text FROM documents WHERE length(text) > 0").fetchall()


@pytest.fixture(scope="module")
def learned():
    """A model of four fifths of the documents, and the labelled pieces of the rest."""
    rows = corpus()
    pieces = [x for i, t in rows if i % 5 for x in pii.labelled_pieces(t)]
    named = [x for x in pieces if x[2]]
    return pii.trained(named[:2000] + [x for x in pieces if not x[2]][:2000]), [x for i, t in rows if i % 5 == 0 for x in pii.labelled_pieces(t) if x[2]]


def test_base_counts_match_plain_expressions(spark):
    """All four kinds, their order and their digest, against expressions written out from the contract."""
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def fits(kind, s):
        d = [int(c) for c in s if c in "0123456789"]
        doubled = [x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9) for i, x in enumerate(reversed(d))]
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in s.split(".")), "card": 12 <= len(d) <= 19 and sum(doubled) % 10 == 0, "phone": 9 <= len(d) <= 15}[kind]

    got = {r.doc_id: r for r in pii.find_personal_data(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    seen = Counter()
    for i, text in corpus("sf0.01"):
        spans = sorted(((m.start(), list(plain).index(k), m.end()) for k, x in plain.items() for m in re.finditer(x, text) if fits(k, m[0])))
        names = list(plain)
        seen.update(names[k] for _, k, _ in spans)
        assert [got[i][f"n_{k}"] for k in names] == [sum(names[x[1]] == k for x in spans) for k in names]
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{names[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()
        assert {f"{names[k]}:{s}:{e}" for s, k, e in spans} <= set(got[i].spans.split(","))
    assert all(seen[k] > 5 for k in plain)


def test_model_finds_held_out_spans(learned):
    """Precision and recall of the network alone on documents it was not trained on, as written and disguised."""
    model, held = learned
    rng = np.random.default_rng(3)
    for write in (lambda k, p: p, lambda k, p: pii.disguised(rng, k, p)):
        texts, want = [], []
        for before, piece, kind, after in held:
            made = write(kind, piece)
            texts.append(before + made + after)
            want.append((len(before), len(before) + len(made), kind))
        got = pii.model_spans(model, texts)
        right = sum(w in g for w, g in zip(want, got))
        assert right / len(want) > 0.8 and right / sum(map(len, got)) > 0.75


def test_model_finds_ways_it_was_not_taught(learned):
    model, held = learned
    texts = [b + p.replace("@", "<at>").replace(".", "{dot}") + a for b, p, k, a in held if k == "email"] + [b + p.replace(".", "{.}") + a for b, p, k, a in held if k == "ip"]
    assert np.mean([bool(g) for g in pii.model_spans(model, texts)]) > 0.5


def test_added_spans_and_redaction(spark, docs, learned):
    model, _ = learned
    text = "The way an old thane went on. Then (244) 555-4688 and so the rest was as it was before"
    rows = spark.createDataFrame([(1, text), (2, None), (3, "x"), (1, text)], "doc_id long, text string").withColumn("spans", F.lit("mine"))
    got = pii.find_personal_data(rows, model).collect()
    assert [r.n_added for r in got if r.doc_id == 1] == [1, 1] and [r.n_phone for r in got if r.doc_id == 1] == [0, 0]
    assert [(r.kind, text[r.start : r.end]) for r in pii.document_spans(rows, model).collect()] == [("phone", "(244) 555-4688")] * 2
    red = {r.doc_id: r.text for r in pii.redacted(rows, model).collect()}
    assert red[1] == text.replace("(244) 555-4688", "<phone>") and red[2] is None and red[3] == "x"
    assert pii.find_personal_data(docs).count() == docs.count()


def test_language(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(d).join(d.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.9
    odd = language.identify(spark.createDataFrame([(1, None, "en"), (2, "123", "en"), (3, "abc", None), (None, "abd", "en")], "doc_id long, text string, lang string")).collect()
    assert {r.doc_id: r.lang_pred for r in odd if r.doc_id in (1, 2)} == {1: "und", 2: "und"} and all(0 <= r.score <= 1 for r in odd)
    assert language.identify(empty(spark)).count() == 0


def test_language_against_brute_force(spark):
    """Profiles built one trigram at a time; ties, repeats, long texts, late scripts, clashing columns."""
    late = [chr(0x30001 + i) for i in range(6)]
    texts = [(1, "abc abd", "en"), (2, "zyx zyw", "de"), (3, "".join(late[:3]) * 4, "zz"), (5, "abd abc", "en"), (7, "zyx", "de"), (7, "zyx", "de"), (8, "abc" * 40_000, None), (9, "".join(late[:2]), None), (10, "...", None), (11, "", "en"), (12, "ÀB c", None)]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string").withColumn("held_out", F.lit("x")).withColumn("score", F.lit(3))
    got = language.identify(df).collect()
    out = lambda i: zlib.crc32(str(i).encode()) % 4 == 2

    def vector(text):
        spaced = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
        spaced = re.sub(" +", " ", spaced)
        total = np.zeros(language.DIMS)
        for gram, n in Counter(spaced[i : i + 3] for i in range(len(spaced) - 2)).items():
            parts = [language.letter_vectors(np.array([0 if c == " " else ord(c)]), language.DIMS, language.SEED)[0] for c in gram]
            total += n * np.roll(parts[0], 2) * np.roll(parts[1], 1) * parts[2]
        return total

    unit = lambda v: v / np.linalg.norm(v)
    names = sorted({g for i, t, g in texts if g and not out(i) and any(c.isalpha() for c in t)})
    proto = {g: unit(sum(unit(vector(t)) for i, t, x in texts if x == g and not out(i) and any(c.isalpha() for c in t))) for g in names}
    assert len(names) > 1 and len(got) == len(texts)
    want = []
    for i, t, _ in texts:
        told = any(c.isalpha() for c in t)
        cos = [float(unit(vector(t)) @ proto[g]) for g in names] if told else []
        want.append((i, out(i), names[int(np.argmax(cos))] if told else "und", round(max(0.0, max(cos)), 4) if told else 0.0))
    assert sorted((r.doc_id, r.held_out, r.lang_pred, round(r.score, 4)) for r in got) == sorted(want)


def test_tokens(spark, docs):
    encode = tokens.encoder(tokens.TOKENIZER)
    want = sorted(((d, len(encode.encode_ordinary(t or ""))) for d, t in pairs(docs, "doc_id", "text")), key=str)
    assert sorted(pairs(tokens.token_counts(spark, docs), "doc_id", "n_tokens"), key=str) == want
    order = tokens.write_tokens(docs, tokens.shared_dir(spark))
    tiny = order.join(tokens.count_tokens(order, block_bytes=64), ["file", "ordinal"])
    assert sorted(pairs(tiny, "doc_id", "n_tokens"), key=str) == want


def test_chat(spark):
    rows = [
        (1, 0, "user", "Hello there.\nHow are you?"), (1, 1, "assistant", "> how  ARE you?\nFine."), (1, 2, "user", "Other topic"), (1, 3, "user", "On Monday bob wrote:\n> Fine.\n>> How are you?\nGood"),
        (1, 4, "assistant", "> never said\nHm"), (2, 0, "user", None), (2, None, "user", "x"), (None, 1, "user", "> Fine.\ny"), (1, 3, "user", "> Fine.\nagain"),
    ]
    got = chat.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    first = {(r.turn, r.text): r for r in got if r.conv_id == 1}
    assert first[1, "Fine."].parent_turn == 0 and first[3, "Good"].parent_turn == 1 and first[3, "Good"].thread == 0 and first[3, "Good"].depth == 2
    assert first[4, "Hm"].parent_turn is None and len(got) == 9
    assert [r.turn for r in sorted((r for r in got if r.conv_id == 1), key=lambda r: r.position)] == [0, 1, 3, 3, 2, 4]
    long = [(7, i, "user", f"message {i}" + (f"\n> message {i - 1}" if i else "")) for i in range(40)]
    deep = chat.reply_ordered(spark.createDataFrame(long, "conv_id long, turn long, role string, text string")).collect()
    assert all(r.thread == 0 and r.depth == r.turn == r.position for r in deep)
    # part of a paragraph, wrapped anew
    para = "The first thing that was said is here. Another thing that was said came after it. And a last."
    part = [(1, 0, "user", para), (1, 1, "user", "x"), (1, 2, "user", "> another thing that was\n> said came after it.\nYes")]
    got = {r.turn: r for r in chat.reply_ordered(spark.createDataFrame(part, "conv_id long, turn long, role string, text string")).collect()}
    assert got[2].parent_turn == 0 and got[1].parent_turn is None and got[2].text == "Yes"


def test_chat_against_brute_force(spark, monkeypatch):
    """Random quoting in conversations of many messages, with repeats, long texts and clashing columns."""
    from txframe.operators import skew

    r, rows = random.Random(3), []
    for c in range(6):
        texts = []
        for t in range(150 if c == 0 else 12):
            own = f"{r.choice(['yes', 'no', 'so'])} {c} {t if r.random() < 0.9 else 0}" + (" w" * 60_000 if (c, t) == (1, 3) else "")
            quoted = texts[r.randrange(len(texts))] if texts and r.random() < 0.7 else None
            rows.append((c, t, r.choice(["user", None]), (f"> {quoted}\n\n" if quoted else "") + own))
            texts.append(own)
    rows += rows[:5]
    plain = {}
    for c, t, _, text in rows:
        quoted, _, own = text.rpartition("\n\n")
        plain[c, t] = (quoted.removeprefix("> "), own)
    want = {}
    for (c, t), (quoted, own) in plain.items():
        firsts = [u for (d, u), (_, o) in plain.items() if d == c and o == quoted]
        want[c, t] = min(firsts) if quoted and firsts and min(firsts) < t else None
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("thread", F.lit(9)).withColumn("position", F.lit("z")).withColumn("hash", F.lit(1))
    monkeypatch.setattr(skew, "HOT_ROWS", 2)
    got = chat.reply_ordered(df).collect()
    assert len(got) == len(rows) and all(x.parent_turn == want[x.conv_id, x.turn] and x.text == plain[x.conv_id, x.turn][1] for x in got)

    def root(c, t):
        return t if want[c, t] is None else root(c, want[c, t])

    for c in range(6):
        mine = sorted((x for x in got if x.conv_id == c), key=lambda x: x.position)
        assert [x.position for x in mine] == list(range(len(mine))) and all(x.thread == root(c, x.turn) for x in mine)
        assert [(x.thread, x.turn) for x in mine] == sorted((x.thread, x.turn) for x in mine)
    pieces = chat.assembled(chat.reply_ordered(df), 10).collect()
    assert sum(p.n_messages for p in pieces) == len(rows) and max(p.n_messages for p in pieces) == 10
    first = next(p for p in pieces if (p.conv_id, p.piece) == (2, 0))
    mine = sorted((x for x in got if x.conv_id == 2), key=lambda x: x.position)[:10]
    assert first.text == "\n\n".join(f"{x.role or 'unknown'}: {x.text}" for x in mine)


def test_empty_tables(spark, items):
    e = empty(spark)
    assert jaccard.ngram_jaccard(e).count() == 0 and decontaminate.decontaminate(e, items).count() == 0 and decontaminate.decontaminate(e, items.limit(0)).count() == 0
    assert mixing.mix(e).count() == 0 and sharding.assign(e).count() == 0 and tokens.token_counts(spark, e).count() == 0 and pii.find_personal_data(e).count() == 0
    assert quality.judge(e, []).count() == 0
    assert chat.reply_ordered(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = d.collect()
    for name, stage in corpus_pipeline.STAGES:
        before, after = rows, stage(spark, spark.createDataFrame(rows, d.schema), SF).collect()
        if name == "quality rules":
            assert {r.doc_id for r in after} <= {r.doc_id for r in before if not brute.stats(r.text)[-1]} and len(after) > len(before) / 2
        elif name == "n-gram Jaccard join":
            _, least = brute.links([(r.doc_id, r.text) for r in before])
            assert sorted(r.doc_id for r in after) == sorted(set(least))
        elif name == "benchmark decontamination":
            bad = {x[0] for x in brute.decontaminate([(r.doc_id, r.text) for r in before], pairs(spark.read.parquet(f"{SF}/benchmark.parquet"), "item_id", "text")) if x[2] > 0}
            assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if r.doc_id not in bad)
        elif name == "mixing sources to target weights":
            assert max(Counter(r.doc_id for r in after).values()) <= 2
        else:
            n = Counter(r.shard for r in after)
            assert len(after) == len(before) and max(n.values()) - min(n.values()) <= 1
        rows = after


def test_decontaminate_ranks_by_all_documents(spark):
    items = spark.createDataFrame([(1, "often common rare seldom often common other often")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "often Common OFTEN other"), (2, "seldom seldom rare often common other"), (3, None)], "doc_id long, text string")
    words = decontaminate.window_words(decontaminate.item_windows(items))
    df = decontaminate.occurrences(docs, words)
    assert {r.token: r.df for r in df.collect()} == {r.t: n for w, n in (("often", 3), ("common", 2), ("other", 2), ("seldom", 2), ("rare", 1)) for r in spark.range(1).select(decontaminate.token(F.lit(w)).alias("t")).collect()}
    assert [r.offset for r in decontaminate.prefixes(words, df).collect()] == [2]
    assert [r.offset for r in decontaminate.prefixes(words, decontaminate.occurrences(empty(spark), words)).collect()] == [3]


def plain_path(e, trans):
    """Viterbi character by character, between two outside characters."""
    step, back = np.where(pii._allowed(), trans, -1e4), []
    score = step[0] + e[0]
    for row in e[1:]:
        m = score[:, None] + step
        back.append(m.argmax(0))
        score = m.max(0) + row
    path = [int((score + step[:, 0]).argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return np.array(path[::-1])


def plain_spans(model, text):
    """Windows read one by one with the training form of the network, and one search over the whole text."""
    n = 1 + max(0, -(-(len(text) - pii.WINDOW) // pii.STRIDE))
    e, weight = np.zeros((n * pii.STRIDE + pii.OVERLAP, pii.TAGS)), np.zeros(n * pii.STRIDE + pii.OVERLAP)
    for k in range(n):
        s = pii.symbols((text + " " * pii.WINDOW)[k * pii.STRIDE :][: pii.WINDOW])
        x = model.p["E"][s[:, None]]
        both = np.concatenate([model._pass(x, d, False)[0] for d in "fb"], axis=2)
        at = slice(k * pii.STRIDE, k * pii.STRIDE + pii.WINDOW)
        e[at] += (both @ model.p["V"] + model.p["c"])[:, 0] * pii._CENTRE[:, None]
        weight[at] += pii._CENTRE
    path, out = plain_path((e / weight[:, None])[: len(text)], model.p["T"]), []
    for t in np.flatnonzero(path % 2 == 1):
        end = t + 1
        while end < len(path) and path[end] == path[t] + 1:
            end += 1
        kind = pii.LEARNED[path[t] // 2]
        out += [(t, end, kind)] if pii.holds(kind, text[t:end]) else []
    return out


def test_pii_reads_whole_texts_exactly(monkeypatch, learned):
    (model, held), rng = learned, np.random.default_rng(9)
    plain = words(21, 300)
    mixed = " ".join("".join(x[:2]) + x[3] for x in (held[int(i)] for i in rng.integers(0, len(held), 150)))
    texts = ["", "7", "a" * 128, "b" * 129 + "1", plain, f"{plain} 555-867-5309 {plain} jo [at] host [dot] org {plain}", f"10[.]0[.]0[.]1 {plain}", f"{plain} 10.0.0.1", mixed, "9" * 700, "\u00e9\n" * 200]
    want = [plain_spans(model, t) if t else [] for t in texts]
    assert len(want[8]) > 30
    for chars, windows in ((1 << 20, 256), (1, 3), (3000, 1)):
        monkeypatch.setattr(pii, "CHARS_AT_ONCE", chars)
        monkeypatch.setattr(pii, "WINDOWS_AT_ONCE", windows)
        assert pii.model_spans(model, texts) == want


def test_path_in_pieces_is_the_whole_path(monkeypatch):
    for seed in range(40):
        r = np.random.default_rng(seed)
        monkeypatch.setattr(pii, "PIECE", int(r.integers(1, 40)))
        monkeypatch.setattr(pii, "AROUND", int(r.integers(1, pii.PIECE + 1)))
        trans = r.normal(0, 6, (pii.TAGS, pii.TAGS)).astype(np.float32)
        e = r.normal(0, 0.3 + 3 * (seed % 3), (int(r.integers(1, 300)), pii.TAGS)).astype(np.float32)
        assert (pii.viterbi(e, trans) == plain_path(e, trans)).all()


def test_path_is_searched_only_where_it_may_leave_outside(monkeypatch, learned):
    """What is ruled out is outside on the path of a full search, at any scale; of given documents most is."""
    inside = ruled = 0
    for seed in range(200):
        r = np.random.default_rng(seed)
        trans = r.normal(0, (0.5, 2, 6)[seed % 3], (pii.TAGS, pii.TAGS)).astype(np.float32)
        e = r.normal(0, 3, (300, pii.TAGS)).astype(np.float32)
        e[:, 0] += r.uniform(0, 18) - 12 * (r.random(300) < 0.05)
        path, doubt = plain_path(e, trans), pii.doubtful(pii.gains(e, trans), trans)
        assert not path[~doubt].any()
        inside, ruled = inside + (path > 0).sum(), ruled + (~doubt).sum()
    assert inside > 1000 and ruled > 1000
    model, searched, whole = learned[0], [], pii.viterbi
    monkeypatch.setattr(pii, "viterbi", lambda e, trans: searched.append(len(e)) or whole(e, trans))
    texts = [t for _, t in corpus("sf0.01")[:100]]
    assert any(pii.model_spans(model, texts)) and 0 < sum(searched) < sum(map(len, texts)) / 4


def test_addresses_match_the_plain_pattern():
    plain, rng = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), random.Random(8)
    for _ in range(3000):
        t = "".join(rng.choice("12..a ") for _ in range(40))
        assert [m.span() for m in pii.IP.finditer(t)] == [m.span() for m in plain.finditer(t)]
    assert pii.base_spans("9" * 300_000) == []


def test_decontamination_stage_drops_documents_with_one_item(spark, tmp_path):
    item, other = words(31, 30), words(32, 30)
    spark.createDataFrame([(1, item), (2, other)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    cut = " ".join(item.split()[5:13])
    rows = [
        (1, f"{words(33, 20)} {item.upper()} {words(34, 20)}"), (2, f"{words(35, 20)} {cut}"), (3, " ".join(item.split()[5:12])), (4, words(36, 40)), (4, words(36, 40)),
        (5, f"{item} {other}"), (None, cut), (None, words(37, 9)), (6, None), (4, other),
    ]
    got = decontaminate.decontamination_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path))
    assert sorted(pairs(got, "doc_id", "text"), key=str) == sorted([rows[2], rows[3], rows[4], rows[7], rows[8]], key=str)


def test_jaccard_stage_keeps_one_row_of_each_class(spark):
    a, b, c, d, e, f = (words(i, 60) for i in range(41, 47))
    near = lambda t: " ".join([*t.split()[:-1], "zzz"])
    stay = [(None, a), (None, b), (3, c), (3, d), (5, e), (None, None), (None, " \n"), (None, None), (7, ""), (7, " "), (8, None)]
    goes = [(None, a), (4, near(c)), (9, d), (None, near(e)), (None, e), (3, c), (7, "")]
    sides = [(2, f), (None, near(f)), (6, near(f))]
    rows = spark.createDataFrame(stay + goes + sides, "doc_id long, text string").withColumn("n", F.lit(1)).repartition(3)
    got = jaccard.jaccard_stage(spark, rows, SF)
    assert got.columns == ["doc_id", "text", "n"]
    assert sorted(pairs(got, "doc_id", "text"), key=str) == sorted(stay + sides[:1], key=str)
    assert jaccard.jaccard_stage(spark, rows.limit(0), SF).count() == 0


def test_language_learns_rare_languages(spark):
    """Two documents among 20,000, whose hashes a thinning to 8192 left out."""
    common = F.concat(F.lit("the water under the bridge is cold number "), F.col("id").cast("string"))
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), common.alias("text"), F.lit("en").alias("lang"))
    kept = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < int(0.6 * (1 << 30))
    ids = [r.doc_id for r in spark.range(20_000, 20_100).select(F.col("id").alias("doc_id")).filter(~language.held_out(F.col("doc_id")) & ~kept).limit(2).collect()]
    few = spark.createDataFrame([(i, "zyq wvx kjq xzz qqk", "xx") for i in ids], "doc_id long, text string, lang string")
    got = language.identify(many.unionByName(few)).filter(F.col("doc_id").isin(ids)).collect()
    assert [r.lang_pred for r in got] == ["xx", "xx"]
