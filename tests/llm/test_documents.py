"""Every operator against a brute-force version, on generated and odd texts."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlake.llm import op1_near_duplicates as op1
from ledgerlake.llm import op2_decontamination as op2
from ledgerlake.llm import op4_token_counts as op4
from ledgerlake.llm import op5_packing as op5
from ledgerlake.llm import op6_sharding as op6
from ledgerlake.llm import op7_quality_rules as op7
from ledgerlake.llm import op9_line_dedup as op9
from ledgerlake.llm import op10_substring_dedup as op10
from ledgerlake.llm.scratch import Scratch

BLANKS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(words):
    return hashlib.sha256(" ".join(words).encode()).hexdigest()


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_near_duplicates(docs, texts):
    sets = {}
    for i, t in texts:
        w = BLANKS.findall(lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    at = {i: i for i in sets}

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    order = sorted(sets)
    for n, a in enumerate(order):
        for b in order[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                low, high = sorted((root(a), root(b)))
                at[high] = low
    want = sorted(((i, len(sets[i]), root(i), root(i) == i) for i, _ in texts), key=repr)
    assert rows(op1.near_duplicates(docs), "doc_id", "n_shingles", "component_id", "kept") == want


def _words5(text):
    w = BLANKS.findall(lower(text))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_near_duplicates_of_a_corpus(spark):
    """All links of sf0.01 by counting shared shingles, those barely over the threshold among them; components must agree."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r["doc_id"]: _words5(r["text"]) for r in docs.select("doc_id", "text").collect()}
    holders = defaultdict(list)
    for i in sorted(sets):
        for x in sets[i]:
            holders[x].append(i)
    shared = Counter((a, b) for held in holders.values() for n, a in enumerate(held) for b in held[n + 1 :])
    at = {i: i for i in sets}

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    barely = 0
    for (a, b), n in shared.items():
        union = len(sets[a]) + len(sets[b]) - n
        if 100 * n >= 75 * union:
            barely += 100 * n < 80 * union
            low, high = sorted((root(a), root(b)))
            at[high] = low
    assert barely > 0
    assert {r["doc_id"]: r["component_id"] for r in op1.near_duplicates(docs).collect()} == {i: root(i) for i in sets}


def test_near_duplicates_with_clashing_and_missing_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows_in = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, c), (None, c + " more"), (None, "quite another text of seven words"), (5, None), (5, "solitary words of five here"), (None, None)]
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in rows_in], "doc_id long, text string, mark int, component_id string")
    assert rows(op1.near_duplicates(docs), "doc_id", "n_shingles", "component_id", "kept") == sorted(
        [(1, 56, 1, True), (1, 56, 1, True), (2, 57, 1, False), (3, 57, 1, False), (4, 56, 4, True), (None, 57, 4, False), (None, 2, None, False), (5, 0, 5, True), (5, 1, 5, True), (None, 0, None, False)], key=repr
    )


def test_families_that_are_no_near_copies_stay_apart(spark):
    """300 texts on one template, 2/3 alike, in buckets without a link; and among them some real pairs."""
    import random

    r = random.Random(3)
    template = [f"t{i}" for i in range(120)]
    texts = [(i, " ".join([*template, *(f"u{i}.{k}" for k in range(40))])) for i in range(300)]
    texts += [(1000 + i, texts[i][1] + f" x{r.random()}") for i in range(0, 300, 10)]
    out = {r["doc_id"]: r["component_id"] for r in op1.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert out == {i: i - 1000 if i >= 1000 else i for i, _ in texts}


def test_a_chain_of_near_copies_is_one_component(spark):
    words = [f"w{i}" for i in range(80)]
    chain = [(i, " ".join(words[i : i + 60])) for i in range(0, 20)]
    out = op1.near_duplicates(spark.createDataFrame(chain, "doc_id long, text string"))
    assert {r["component_id"] for r in out.collect()} == {0}


def test_signature_keys_cover_the_threshold(spark):
    import random

    r = random.Random(2)
    for _ in range(200):
        a = [r.randrange(1 << op1.SYMBOL_BITS) for _ in range(op1.SYMBOLS)]
        b = list(a)
        for i in r.sample(range(op1.SYMBOLS), op1.MOST_DIFFERENT):
            b[i] = (b[i] + 1) % (1 << op1.SYMBOL_BITS)
        chunks = [sum(a[j] != b[j] for j in range(c, c + op1.CHUNK)) for c in range(0, op1.SYMBOLS, op1.CHUNK)]
        assert min(chunks) <= 1
        pack = lambda s: [sum(s[c + k] << (op1.LANE * k) for k in range(op1.CHUNK)) for c in range(0, op1.SYMBOLS, op1.CHUNK)]
        if _ < 3:
            both = spark.createDataFrame([(*pack(a), *pack(b))], [x + c for x in "ab" for c in op1.SIGNATURE])
            assert both.select(op1.symbols_apart("a", "b")).first()[0] == op1.MOST_DIFFERENT
            alone = spark.createDataFrame([pack(a), pack(b)], op1.SIGNATURE).select(op1.keys().alias("keys")).collect()
            assert set(alone[0]["keys"]) & set(alone[1]["keys"])


def test_decontamination(docs, texts, items):
    windows = defaultdict(set)
    for r in items.collect():
        w = ALNUM.findall(lower(r["text"]))
        k = min(13, len(w))
        for s in range(len(w) - k + 1 if w else 0):
            windows[tuple(w[s : s + k])].add(str(r["item_id"]))
    sizes = {len(w) for w in windows}
    want = []
    for i, t in texts:
        w, hit, found = ALNUM.findall(lower(t)), set(), set()
        for k in sizes:
            for s in range(len(w) - k + 1):
                if got := windows.get(tuple(w[s : s + k])):
                    hit.update(range(s, s + k))
                    found |= got
        want.append((i, len(w), len(hit), len(found), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    assert rows(op2.contamination(docs, items), "doc_id", "n_words", "n_hit", "n_items", "item_ids", "contaminated") == sorted(want, key=repr)
    assert any(x[3] for x in want)


def test_proximity(spark):
    """Windows whose words all stand in a span of one text, by brute force; some texts are shuffled or stretched items."""
    import random

    r = random.Random(8)
    pool = [f"w{i}" for i in range(30)]
    items = [(str(i), " ".join(r.choice(pool) for _ in range(r.choice((1, 3, 13, 16))))) for i in range(12)]
    texts = [(i, " ".join(r.choice(pool) for _ in range(r.randrange(60)))) for i in range(40)]
    for i, (_, t) in enumerate(items):
        w = t.split()
        r.shuffle(w)
        texts += [(100 + i, "x y " + " ".join(w)), (200 + i, " and ".join(w))]
    want = []
    for i, t in texts:
        w, near = t.split(), set()
        for name, item in items:
            q = item.split()
            sets = [set(q[s : s + 13]) for s in range(max(len(q) - 12, 1))]
            if any(x <= set(w[s : s + 26]) for x in sets for s in range(max(len(w) - 25, 1))):
                near.add(name)
        want.append((i, sorted(near)))
    found = op2.contamination(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"))
    assert rows(found, "doc_id", "near_ids") == sorted(want, key=repr)
    assert sum(len(x) for _, x in want) > 20


def test_items_in_many_blocks_and_repetitive_ones(spark, monkeypatch):
    """Long items cut into blocks, and an item and a text of one word: few candidates at a time, and the same result."""
    monkeypatch.setattr(op2, "BLOCK_WORDS", 50)
    monkeypatch.setattr(op2, "SLICE", 1000)
    monkeypatch.setattr(op2.item_blocks, "__defaults__", (op2.WIDTH, 50))
    long = [f"v{i % 97}" for i in range(300)]
    items = spark.createDataFrame([("a", " ".join(long)), ("b", "same " * 600), ("c", "v1 v2"), ("d", " ".join(long[40:70]))], "item_id string, text string")
    texts = spark.createDataFrame([(1, "same " * 20_000), (2, " ".join(long[45:75])), (3, " ".join(long[90:110]) + " z " + " ".join(long[10:20])), (4, "same"), (5, None)], "doc_id long, text string")
    assert rows(op2.contamination(texts, items), "doc_id", "n_words", "n_hit", "item_ids") == [(1, 20_000, 20_000, ["b"]), (2, 30, 30, ["a", "d"]), (3, 31, 20, ["a", "c"]), (4, 1, 0, []), (5, 0, 0, [])]


def test_token_counts_and_cache(spark, docs, texts, tmp_path):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted(((i, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in texts), key=repr)
    cache = op4.TokenCountCache(spark, f"{tmp_path}/cache", public_tokenizers.path("word_bpe_49k.json"))
    assert rows(cache.count(docs), "doc_id", "n_bytes", "n_tokens") == want
    stored = cache.stored().count()
    assert stored == len({re.sub("[ \\t\\n\\x0B\\f\\r]+", " ", t or "").strip(" ") for _, t in texts})
    assert rows(cache.count(docs), "doc_id", "n_bytes", "n_tokens") == want
    assert cache.stored().count() == stored  # nothing was missing


def test_packing(docs, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, t in texts:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want.append((i, piece, at, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))))
    out = op5.pack(docs).collect()
    assert sorted((tuple(r[:5]) for r in out), key=repr) == sorted(want, key=repr)
    places = defaultdict(list)
    for r in out:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= -(-sum(x[3] for x in want) // 2048) * 1.02 + 1


def _held(made, capacity):
    held = Counter()
    for p in made.patterns:
        assert p.times > 0 and sum(n * c for n, c in zip(p.lengths, p.copies, strict=True)) <= capacity
        for n, c in zip(p.lengths, p.copies, strict=True):
            held[n] += c * p.times
    return held


def test_packing_plan():
    import random

    r = random.Random(4)
    for histogram in ({700: 10, 300: 11, 2048: 2}, {700: 1000}, {5: 3}, {1: 5, 2048: 1}, {1025: 7, 1023: 6}):
        made = op5.plan(histogram, 2048)
        assert _held(made, 2048) == histogram and made.bound <= made.sequences <= -(-sum(histogram.values()) // 2) + 2
    assert op5.plan({}, 2048) == op5.Plan([], 0, 0)
    # A corpus of 20,000 pieces, a third of them of one length: nearly all sequences come from the LP, nearly none has room left.
    lengths = Counter(min(2048, int(r.lognormvariate(5.6, 1)) + 1) for _ in range(14_000))
    lengths[811] += 6_000
    made = op5.plan(dict(lengths), 2048)
    assert _held(made, 2048) == lengths
    assert made.sequences <= made.bound * 1.01 + 1
    full = lengths[2048]
    assert made.from_lp - full >= 0.9 * (made.sequences - full)


def test_token_ids_of_any_text():
    """Units against whole texts by the library, over composing letters, all scripts, signs, blanks and special strings."""
    import random

    import pyarrow as pa

    from ledgerlake.llm.wordtokens import vocabulary_path, word_tokens

    r = random.Random(6)
    near = "abtTjJhHwWyY  \t\n0159.,'!<|>\u00e9\u00c9\u030c\u0331\u030a\u0130\u00df\u03c3\u03a3\u03c2\u00d7\u00f7\u00ff\u4e2d \u0085\u00a0 \x1c\x00\U0001f600\u0301\u1100\u1161\u01c5\ufb01\u00b2\u00bd\u0663'sdtrevml"
    blocks = [(32, 127), (0xA0, 0x250), (0x300, 0x370), (0x370, 0x530), (0x900, 0xA00), (0x1E00, 0x2100), (0x3040, 0x3100), (0xAC00, 0xAC80), (0x1F600, 0x1F650)]
    texts = [
        "J\u030c T\u0308 H\u0331 W\u030a Y\u030a j\u030c", "<|endoftext|>", "<|EndOfText|> a", "x<|startoftext|>y", "don't DON'T 'S '' s", "a" * 100 + " " + "a" * 100 + "! B" * 3, "\u00c9cole! \u00dcbung, na\u00efve.", "", " ",
        *("".join(r.choice(near) for _ in range(r.randrange(30))) for _ in range(20_000)),
        *("".join(chr(r.randrange(*r.choice(blocks))) for _ in range(r.randrange(1, 20))) for _ in range(20_000)),
    ]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    tokens = word_tokens(vocabulary_path())
    found = [ids[a : b - 1].tolist() for ids, off in tokens.encoded(pa.array(texts), 0) for a, b in zip(off[:-1], off[1:], strict=True)]
    assert [t for t, a, b in zip(texts, found, want, strict=True) if a != b] == []
    assert tokens.counts(pa.array(texts)).tolist() == [len(x) for x in want]


def test_sharding(docs, texts):
    out = op6.shards(docs, op6.TREE, op6.GROWN).collect()
    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts), key=repr)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in out), key=repr) == want
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 8) and 0 <= r["shard"] < 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_moves_within_changed_subtrees(spark):
    keys = spark.range(20_000).select(F.col("id").alias("doc_id"))

    def moved(to):
        rows = keys.select(op6.shard_of(F.col("doc_id"), op6.TREE).alias("a"), op6.shard_of(F.col("doc_id"), to).alias("b")).groupBy("a", "b").count().collect()
        return {(r["a"], r["b"]): r["count"] for r in rows}

    still = moved(op6.TREE)
    assert all(a == b and abs(n / 20_000 - 1 / 8) < 0.012 for (a, b), n in still.items()) and len(still) == 8
    grown = moved(op6.GROWN)
    assert all(b in (a, 8) for a, b in grown) and abs(sum(n for (_, b), n in grown.items() if b == 8) / 20_000 - 1 / 9) < 0.012
    # A heavier shard makes its rack and region heavier: rows come there from elsewhere and go nowhere else.
    heavier = moved(tuple(op6.Leaf(x.region, x.rack, x.shard, 2.0 if x.shard == 3 else 1.0) for x in op6.TREE))
    assert all(a == b or b in (0, 1, 2, 3) and (a > 3 or b in (2, 3)) and (a not in (2, 3) or b == 3) for a, b in heavier)
    assert abs(sum(n for (_, b), n in heavier.items() if b == 3) / 20_000 - 2 / 9) < 0.015


def test_sharding_by_hand(spark):
    """The descent recomputed level by level from the same hashes."""
    import math

    paths = {f"region{s // 4}": 4.0 for s in range(8)} | {f"region{s // 4}/rack{s // 2}": 2.0 for s in range(8)} | {f"region{s // 4}/rack{s // 2}/{s}": 1.0 for s in range(8)}
    keys = spark.range(300).select(F.col("id").alias("doc_id"))
    out = keys.select("doc_id", op6.place(F.col("doc_id"), op6.TREE).alias("at"), *(F.xxhash64("doc_id", F.lit(x)).alias(x) for x in paths)).collect()
    for r in out:
        draw = lambda x: -math.log(((r[x] % (1 << 64) >> 11) + 0.5) / (1 << 53)) / paths[x]  # noqa: B023, E731
        at = ""
        for level in range(3):
            at = min((x for x in paths if x.count("/") == level and x.startswith(at)), key=draw)
        assert at == f"{r['at']['region']}/{r['at']['rack']}/{r['at']['shard']}"


def test_quality_rules(docs, texts):
    want = []
    for i, t in texts:
        w = BLANKS.findall(t or "")
        lines = [x for x in (t or "").split("\n") if BLANKS.search(x)]
        c = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        repeated = {p for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
        failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(repeated), failed))
    out = op7.judge(docs)
    assert rows(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(want, key=repr)
    assert not out.where("base_failed and kept").count()


def test_fertility_measures_and_verdicts(docs, texts):
    """The measures against the library, text by text; and junk that only they tell from clean text of its language and length."""
    import math

    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(op7.PIECES))
    out = {(r["doc_id"], r["n_words"]): r for r in op7.judge(docs).collect()}
    for i, t in texts:
        words = BLANKS.findall(t or "")
        ids = [x for w in words for x in model.encode(w)]
        counts = Counter(ids)
        r, n = out[i, len(words)], len(ids)
        assert r["n_tokens"] == n
        if n:
            assert r["chars_per_token"] == pytest.approx(sum(map(len, words)) / n) and r["byte_share"] == pytest.approx(sum(model.is_byte(x) for x in ids) / n)
            assert r["entropy"] == pytest.approx(-sum(c / n * math.log2(c / n) for c in counts.values()), abs=1e-6)
    clean = [(i, "en", " ".join(f"{a} {b} {c}" for a, b, c in zip("the of and to in was".split() * 12, "house river garden window market number".split() * 12, f"word{i} some other thing".split() * 18, strict=True))) for i in range(60)]
    junk = [(100, "en", " ".join(f"Q{i}#X%Z&{i * 7}|K" for i in range(80))), (101, "en", " ".join("\u1234\u2345\u3456" + chr(0x1200 + i) for i in range(80))), (102, "en", None)]
    judged = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in op7.judge(docs.sparkSession.createDataFrame(clean + junk, "doc_id long, lang string, text string")).collect()}
    assert judged[100] == judged[101] == (False, False) and judged[102] == (True, False)
    assert all(judged[i] == (False, True) for i, _, _ in clean if not judged[i][0])


def test_small_languages_have_their_own_bands(spark):
    """Texts of a small language far off those of a large one, with 20, 99, 100 and 101 rows: the same verdicts."""
    names = ("doc_id", "lang", "n_words", "n_tokens", *op7.MEASURES)
    large = [(i, "en", 100, 130 + i % 50, 4.5 + i % 10 / 100, 0.0, 6.0 + i % 10 / 100) for i in range(400)]
    for n in (20, 99, 100, 101):
        small = [(1000 + i, "xx", 100, 300 + i % 50, 1.5 + i % 10 / 100, 0.3 + i % 10 / 1000, 5.0 + i % 10 / 100) for i in range(n)]
        junk = [(2000, "xx", 100, 320, 0.2, 0.3, 1.0)]
        out = op7.with_bands(spark.createDataFrame(large + small + junk, "doc_id long, lang string, n_words long, n_tokens long, chars_per_token double, byte_share double, entropy double").select(*names))
        assert [r["doc_id"] for r in out.where("not fits").collect()] == [2000]


def _without_repeats(texts, run, words):
    """By brute force: (doc_id, text left, lines removed, runs) of (doc_id, text)."""
    first, gone = {}, {}
    for i, t in sorted({(i, t or "") for i, t in texts}, key=lambda x: (x[0] is not None, x)):
        worded = [(n, x) for n, x in enumerate(t.split("\n")) if BLANKS.search(x)]
        found, runs, end = set(), 0, -1
        for k in range(len(worded)):
            n = next((n for n in range(1, run + 1) if k + n <= len(worded) and (n == run or sum(len(BLANKS.findall(x)) for _, x in worded[k : k + n]) >= words)), None)
            if n and first.setdefault(tuple(x for _, x in worded[k : k + n]), (i, k)) != (i, k):
                found |= {at for at, _ in worded[k : k + n]}
                runs, end = runs + (k > end), max(end, k + n)
        gone[i, t] = found, runs
    return sorted(((i, t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i, t][0]), len(gone[i, t or ""][0]), gone[i, t or ""][1]) for i, t in texts), key=repr)


def test_line_dedup(docs, texts):
    out = op9.dedup_lines(docs.withColumns({"gone": F.lit(1), "runs": F.lit("mine"), "n_runs": F.lit("replaced")}))
    assert rows(out, "doc_id", "text", "n_removed", "n_runs") == _without_repeats(texts, 3, 10)
    assert out.where("gone = 1 and runs = 'mine'").count() == len(texts)


@pytest.mark.parametrize(("run", "words"), [(3, 10), (1, 10), (4, 7)])
def test_line_dedup_of_few_lines_in_any_order(spark, run, words):
    """Lines that first occur alone, then in runs whose first place is another: the fingerprint's first place is not the run's."""
    import random

    r = random.Random(run)
    pool = ["a", "b c", "one two three", "d e f g h", "one long line of ten words or more stands alone here", "", "  "]
    made = [(i if i % 9 else None, "\n".join(r.choice(pool) for _ in range(r.randrange(12)))) for i in range(150)]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    made = [(i, t) for i, t in made if i is not None] + [(None, t) for i, t in made if i is None]
    # Rows without a doc_id are ordered by a hash of their texts, which brute force doesn't know; they come first in both.
    known = [x for x in made if x[0] is not None]
    assert rows(op9.dedup_lines(docs.where("doc_id is not null"), run, words), "doc_id", "text", "n_removed", "n_runs") == _without_repeats(known, run, words)
    assert op9.dedup_lines(docs, run, words).count() == len(made)


def test_substring_dedup(docs, texts):
    words = [(i, BLANKS.findall(t or "")) for i, t in texts]
    c = Counter(tuple(w[s : s + 35]) for _, w in words for s in range(len(w) - 34))
    want = []
    for i, w in words:
        gone = set()
        for s in range(len(w) - 34):
            if c[tuple(w[s : s + 35])] > 1:
                gone.update(range(s, s + 35))
        want.append((i, len(w), len(gone), sha(x for n, x in enumerate(w) if n not in gone)))
    assert rows(op10.remove_repeats(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=repr)


@pytest.mark.parametrize("call", [op1.near_duplicates, op5.pack, op6.shards, op7.judge, op9.dedup_lines, op10.remove_repeats], ids=lambda f: f.__name__)
def test_empty_table(nothing, call):
    assert call(nothing).isEmpty()


def test_empty_tables_for_searches(spark, nothing, docs, items, tmp_path):
    assert op2.contamination(nothing, items).isEmpty()
    assert not op2.contamination(docs, items.limit(0)).where("n_hit > 0").count()
    assert op4.TokenCountCache(spark, f"{tmp_path}/cache", public_tokenizers.path("word_bpe_49k.json")).count(nothing).isEmpty()
