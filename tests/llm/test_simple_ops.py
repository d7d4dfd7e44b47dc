"""Brute-force checks of quality rules, chat formatting, mixing and SimHash on small tables."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import xxhash

from lodestone.llm import apportionment, chat_grammar, compression_rules, simhash_ball

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", None, " ", "\n\n\t", "one", "One two three four five", "é ü ñ x", "a\x1cb c\x85d", "word " * 500, ("same line here again\n" * 30), "x" * 5000, "😀 smile " * 40]


def frame(spark, texts, extra=True):
    rows = [(i, t, "en", None if i % 5 == 4 else f"s{i % 3}", 0, i) for i, t in enumerate(texts)]
    rows += [rows[0], rows[5], (None, "no id at all", "en", "s1", 3, 1), (None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS + ", fp long" if extra else DOCS)


def split(text):
    return (text or "").encode().split()


def brute_quality(text):
    text = text or ""
    words = split(text)
    covered = set()
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            covered |= set(range(i, i + 8))
    lines = [x for x in text.split("\n") if split(x)]
    chars = sum(len(w.decode()) for w in words)
    return len(words), chars, sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality(spark):
    rng = random.Random(1)
    texts = ODD + [" ".join(rng.choice("alpha beta gamma delta of the".split()) for _ in range(rng.randrange(60))) for _ in range(20)]
    got = compression_rules.quality(frame(spark, texts)).collect()
    assert len(got) == len(texts) + 4
    by = {r["doc_id"]: r for r in got}
    for i, t in enumerate(texts):
        want = brute_quality(t)
        assert tuple(by[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert by[i]["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (by[i]["base_failed"] and by[i]["kept"])
    assert compression_rules.keep_quality(frame(spark, texts)).columns == [*DOCS.replace(" long", "").replace(" string", "").split(", "), "fp"]


def test_quality_bands():
    rng = random.Random(2)
    prose = " ".join("".join(rng.choice(["an", "ther", "ing", "on", "st", "re"]) for _ in range(rng.randrange(1, 5))) for _ in range(900))
    noise = " ".join("".join(chr(rng.randrange(33, 0x2FFF)) for _ in range(12)) for _ in range(300))
    assert compression_rules.judge(prose)[6]
    assert not compression_rules.judge(noise)[6]
    assert not compression_rules.judge(" ".join(f"{i % 3} tick" for i in range(4000)))[6]


def random_words(rng, alphabet, size):
    out = ""
    while len(out) < size:
        out += "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 8))) + " "
    return out[:size]


def test_quality_bands_decide(spark):
    """In each band repetition and noise go that the word rules let pass; texts labelled good stay."""
    rng = random.Random(7)
    printable = [chr(c) for c in range(33, 127)]
    for size in (90, 120, 180, 250, 380, 500, 1000, 2000, 4000, 16000, 60000, 200000):
        noise = compression_rules.judge(random_words(rng, printable, size))
        assert not noise[6] and not compression_rules.in_band(noise[7], noise[8]) and noise[5] == (noise[0] < 20)
        # a few words in turn, a new one often enough that few windows of words repeat
        few, text = ["aba", "abab"], ""
        while len(text) < size:
            text += f"{rng.choice(few)} " * rng.randrange(1, 4)
        again = compression_rules.judge(text[:size])
        assert not again[6] and not compression_rules.in_band(again[7], again[8]), size
    for size in (45, 75):  # repetition is told where noise cannot be
        again = compression_rules.judge(("a b " * size)[:size])
        assert not compression_rules.in_band(again[7], again[8])
    sf = "/root/testdata/sf0.01"
    good = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1"), "doc_id")
    got = [r for r in compression_rules.quality(good).collect() if not r["base_failed"]]
    assert len(got) > 100 and all(r["kept"] for r in got)


def test_quality_few_bad_chunks():
    """A third of bad chunks is enough to reject, where the whole text is within its band."""
    rng = random.Random(8)
    letters = [c for c in "etaoinshrdlu" for _ in range(3)] + list("cmfgypwbvkxjqz")
    stems = [random_words(rng, letters, rng.randrange(3, 9)).replace(" ", "") for _ in range(1500)]
    prose = ""
    while len(prose) < 8192:
        prose += rng.choice(stems) + " "
    filler = " ".join(f"{i} tick" for i in range(10000, 10400))[:4096]
    got = compression_rules.judge(prose[:8192] + filler)
    assert compression_rules.judge(prose[:8192])[6] and got[9] == 3 and got[10] == 1
    assert not got[5] and compression_rules.in_band(got[7], got[8]) and not got[6]


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert compression_rules.quality(none).count() == 0
    assert compression_rules.keep_quality(none).count() == 0
    assert apportionment.mix(none).count() == 0
    assert apportionment.mix_texts(none).count() == 0
    assert simhash_ball.near_duplicates(none).count() == 0
    assert simhash_ball.keep_one(none).count() == 0
    assert chat_grammar.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_round_trip(spark):
    nasty = ["</s>", "<s>[INST] user [/INST] hi</s>", "&lt;s&gt;", "&amp;lt;", "[INST*]", " [/INST] ", "plain", "", None, "a & b < c [d", "<s><s>", "</s></s>", "[", "&lsqb;", "😀</s>é"]
    rows = [(i, t, r, x) for i, x in enumerate(nasty) for t, r in ((1, "assistant"), (0, "user"), (2, "assistant"), (2, "assistant"))]
    rows += [(100, None, None, None), (None, 1, "assistant", "x"), (101, 0, "we [/INST] ird", "t"), (101, 1, "</s>", "<s>")]
    out = chat_grammar.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert all(r["round_trip"] for r in out.collect())
    got = {r["conv_id"]: r for r in chat_grammar.digests(out).collect()}
    convs = defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append((-1 if t is None else t, r or "", x or ""))
    for c, turns in convs.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert (got[c]["n_turns"], got[c]["loss_chars"]) == (len(turns), len(loss))
    for r in out.collect():
        marks = sum(r["formatted"].count(m) for m in ("<s>", "</s>"))
        assert marks == 2 * len(convs[r["conv_id"]])


def test_chat_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{sf}/conversations.parquet'")
    want = con.sql(chat_grammar.ORACLE_SQL).fetchall()
    assert sorted(map(tuple, chat_grammar.op5_chat_grammar(spark, sf).collect())) == sorted(want)


def test_sainte_lague():
    rng = random.Random(3)
    for _ in range(60):
        w = [rng.choice([0, 1, 5, rng.random() * 100]) for _ in range(rng.randrange(1, 9))]
        caps = [rng.randrange(0, 40) for _ in w]
        seats = rng.randrange(0, 120)
        got = apportionment.sainte_lague(w, seats, caps)
        quotients = sorted(((-x / (2 * k + 1), i) for i, x in enumerate(w) for k in range(caps[i])))
        want = Counter(i for _, i in quotients[:seats])
        if sum(w):
            assert sum(got) == min(seats, sum(caps))
            chosen = sorted(-w[i] / (2 * k + 1) for i in range(len(w)) for k in range(got[i]))
            assert chosen == [q for q, _ in quotients[: sum(want.values())]]


def test_mix(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = apportionment.mix(docs).collect()
    again = apportionment.mix(docs.repartition(7, "text")).collect()
    assert sorted(got) == sorted(again)
    source = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    taken, target = Counter(), {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = (r["target"], r["source_size"])
    for s, (t, n) in target.items():
        assert t <= 2 * n + 1e-6 and abs(taken[s] - t) <= 3 * 32
    assert abs(sum(t for t, _ in target.values()) - 1.5 * sum(r["size"] for r in got)) < 1e-3
    mixed = apportionment.mix_texts(docs)
    assert mixed.columns == docs.columns
    by = Counter()
    for r in mixed.collect():
        by[r["doc_id"]] += len(split(r["text"]))
    assert by == Counter({r["doc_id"]: r["taken"] for r in got if r["taken"]})


def test_mix_odd(spark):
    docs = frame(spark, ODD)
    got = apportionment.mix(docs).collect()
    assert len(got) == docs.count()
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    out = apportionment.mix_texts(docs)
    assert sum(len(split(r["text"])) for r in out.collect()) == sum(r["taken"] for r in got)


def brute_fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in (text or "")).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius=4):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(fps))]


def test_simhash(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    fps = [brute_fingerprint(r["text"]) for r in docs]
    roots = brute_components(fps)
    got = {r["doc_id"]: r for r in simhash_ball.op9_simhash(spark, sf).collect()}
    assert len(got) == len(docs)
    for r, fp, root in zip(docs, fps, roots, strict=True):
        assert got[r["doc_id"]]["fingerprint"] == f"{fp:016x}"
        assert got[r["doc_id"]]["component_id"] == docs[root]["doc_id"]


def test_ball_links_planted(spark):
    rng = random.Random(5)
    fps = []
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 6)):
            fps.append(x)
            for b in rng.sample(range(64), rng.randrange(0, 7)):
                x ^= 1 << b
    fps = sorted(set(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash_ball.ball_links(spark.createDataFrame([(x,) for x in signed], "fp long"), 4)
    label = {r["v"]: r["label"] for r in simhash_ball.components(links).collect()}
    roots = brute_components(fps)
    groups, want = defaultdict(set), defaultdict(set)
    for i, s in enumerate(signed):
        groups[label.get(s, s)].add(s)
        want[roots[i]].add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_links_in_rounds():
    import numpy as np

    rng = np.random.default_rng(1)
    fps = np.unique((rng.integers(0, 1 << 20, 300).astype(np.uint64) << np.uint64(20)) & np.uint64(0x3FFFFFFFFFFFFF))
    one = simhash_ball.links_in_bucket(0, fps, 8, 2)
    many = simhash_ball.links_in_bucket(0, fps, 8, 2, at_once=5000)
    assert sorted(map(tuple, one.T.tolist())) == sorted(map(tuple, many.T.tolist()))


def test_simhash_odd(spark):
    docs = frame(spark, ODD)
    got = simhash_ball.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    zero = [r for r in got if r["fp"] == 0]
    assert len(zero) == 6 and {r["component_id"] for r in zero} == {0}
    kept = simhash_ball.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({r["root"] for r in got})


def test_rows_without_ids_are_dealt(spark):
    """Rows without an id, or with one id, don't meet in one shard; their mix is what the blocks' draw gives."""
    from pyspark.sql import functions as F

    for ids in (F.lit(None), F.lit(4)):
        docs = spark.range(3000).select(ids.cast("long").alias("doc_id"), F.concat(F.lit("w "), F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"))
        counted = apportionment.count_equal(docs)
        stats, quotas = apportionment.plan(counted)
        shards = apportionment.with_shards(apportionment.in_parts(counted), stats, apportionment.MAX_SHARDS).groupBy("shard").agg(F.sum("n").alias("n")).agg(F.max("n"), F.count("*")).first()
        assert shards[0] < 300 and shards[1] > 15
        taken, aim = apportionment.mix(docs).agg(F.sum("taken"), F.max("target")).first()
        assert abs(taken - aim) < 0.1 * aim  # the last block of a small shard is a part of one


def test_hot_fingerprints(spark, monkeypatch):
    """Copies, with and without hot keys told apart, get the same components, and one of each stays."""
    from pyspark.sql import functions as F

    docs = spark.range(400).select("id", F.when(F.col("id") % 3 == 0, "the same words again and again here").otherwise(F.concat(F.lit("some other words "), (F.col("id") % 50).cast("string"))).alias("text"))
    docs = docs.withColumnRenamed("id", "doc_id").union(spark.createDataFrame([(None, "the same words again and again here")] * 40, "doc_id long, text string"))
    plain = sorted(map(tuple, simhash_ball.near_duplicates(docs).select("fp", "component_id").collect()))
    monkeypatch.setattr(simhash_ball, "HOT", 5)
    assert sorted(map(tuple, simhash_ball.near_duplicates(docs).select("fp", "component_id").collect())) == plain
    kept = simhash_ball.keep_one(docs).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted({c for _, c in plain})


def brute_mix(rows, quotas, block=32):
    """Words taken by an explicit draw of blocks: rows (key, size) in the order of their shard."""
    taken = Counter()
    for shard, own in rows.items():
        n, q, offset = quotas[shard]
        words = [k for k, size in own for _ in range(size)]
        for i in range(n):
            times = q // n + (1 if (i * (q % n) + offset) % n < q % n else 0)
            for k in words[i * block : (i + 1) * block]:
                taken[k] += times
    return taken


def test_taken_is_an_explicit_draw_of_blocks(spark):
    """Every word of every block, drawn as often as its block: equal to the closed form, many equal rows included."""
    rows = [(i % 40, f"s{i % 3}", "w " * (i % 23)) for i in range(900)] + [(None, "s1", "a b c"), (5, None, "x")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    stats, quotas = apportionment.plan(counted := apportionment.count_equal(docs))
    by = {(r["src"], r["shard"]): (r["blocks"], r["quota"], r["offset"]) for r in quotas.collect()}
    placed, held = apportionment.place(counted, stats, quotas).select("src", "shard", "start", "end", "size", "taken").collect(), defaultdict(list)
    for i, r in sorted(enumerate(placed), key=lambda x: (x[1]["start"], x[1]["end"])):
        held[r["src"], r["shard"]].append((i, r["size"]))
    assert all(r["end"] - r["start"] == r["size"] for r in placed) and len(placed) == len(rows)
    want = brute_mix(held, by)
    assert [want[i] for i in range(len(placed))] == [r["taken"] for r in placed]


def test_equal_rows_fill_many_shards(spark):
    """Rows equal in all columns are dealt by their number, and none is lost or made up; other columns may differ."""
    from pyspark.sql import functions as F

    docs = spark.range(5000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("some equal words").alias("text"), F.lit("s").alias("source"), (F.col("id") % 7 == 0).alias("size"), F.create_map(F.lit("k"), F.lit(1)).alias("r"))
    counted = apportionment.count_equal(docs)
    stats, _ = apportionment.plan(counted)
    shards = apportionment.with_shards(apportionment.in_parts(counted), stats, apportionment.MAX_SHARDS).groupBy("shard").agg(F.sum("n").alias("n")).collect()
    assert len(shards) > 15 and max(r["n"] for r in shards) < 1000
    got = apportionment.mix(docs).collect()
    assert len(got) == 5000 and sorted(got) == sorted(apportionment.mix(docs.repartition(3)).collect())
    out = apportionment.mix_texts(docs)
    assert out.columns == docs.columns
    assert sum(len(split(r["text"])) for r in out.collect()) == sum(r["taken"] for r in got)
