"""What is learned: held-out accuracy, restored words, label models; and the pipeline's stages."""

from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlake.llm import op3_toxicity as op3
from ledgerlake.llm import op8_quality_classifier as op8
from tests.llm.test_documents import ALNUM, BLANKS, _words5, lower

SF, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def test_label_model_finds_accuracies():
    r = np.random.default_rng(1)
    truth = r.random(20_000) < 0.8
    rates = [(0.3, 0.01), (0.25, 0.02), (0.4, 0.001)]
    votes = np.stack([np.where(r.random(20_000) < np.where(truth, b, a), -1, 0) for a, b in rates], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    posterior, chances = op8.fit_label_model(patterns, counts.astype(float))
    assert (posterior[(patterns < 0).any(axis=1)] < 0.5).all() and posterior[(patterns == 0).all(axis=1)] > 0.5
    assert chances[0, 0, 0] > 10 * chances[1, 0, 0]


def test_classifier_keeps_clean_texts(spark, docs, nothing):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    judged = op8.classify(rows).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    n = {(r["quality"], r["kept"]): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    assert n[1, True] >= 0.98 * (n[1, True] + n.get((1, False), 0)) and n[0, False] >= 0.9 * (n[0, False] + n.get((0, True), 0))
    odd = op8.classify(docs.withColumn("score", F.lit("mine")))
    assert odd.count() == docs.count() and odd.where("score is null").isEmpty()
    assert op8.classify(nothing).isEmpty()


def test_toxicity_on_held_out_rows(spark):
    out = op3.query(spark, LARGER).join(spark.read.parquet(f"{LARGER}/labels.parquet"), "doc_id")
    clean = out.where("held_out and toxic = 0")
    assert clean.where("predicted = 1").count() <= 0.02 * clean.count()
    pairs = [(r["score"], r["toxic"]) for r in out.where("held_out").collect()]
    bad, good = [s for s, t in pairs if t], [s for s, t in pairs if not t]
    assert sum(b > g for b in bad for g in good) >= 0.95 * len(bad) * len(good)
    assert sum(b >= 0.5 for b in bad) >= 0.75 * len(bad)


def test_restored_words(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    model = op3.CharacterModel.of(rows)
    for seen, meant in (("l0ser", "loser"), ("i d i o t", "idiot"), ("i.d.i.o.t", "idiot"), ("idiooot", "idiot"), ("$tup1d", "stupid"), ("m0r0n", "moron"), ("tr4sh", "trash"), ("the", "the")):
        assert op3.restore(seen, model) == meant
    # However long, whole, and over all states: no reading of a short lattice is cheaper.
    assert op3.restore(" ".join("idiot" * 60), model).replace(" ", "") == "idiot" * 60
    assert op3.restore("s" + "o" * 500 + "n", model) in ("son", "soon")
    for word in ("1d10t", "l0s3r", "a55"):
        readings = [""]
        for c in word:
            readings = [made + x for made in readings for x in ([c] if c.isalpha() else [*op3.SIGNS[c], c])]
        price = lambda made: sum(op3.KEEP if c.isalpha() else op3.STAY if x == c else op3.SWAP for c, x in zip(word, made, strict=True)) + cost(made)  # noqa: B023, E731

        def cost(made):
            classes = [0, 0, *(int(op3.CLASS[b]) for b in made.encode()), 0]
            return float(sum(model.cost[tuple(classes[k : k + 3])] for k in range(len(classes) - 2)))

        found = op3.restore(word, model)
        assert len(found) < len(word) or price(found) <= min(map(price, readings)) + 1e-4
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scorer = op3.ToxicityScorer(rows, labels)
    texts = ["You are an 1di0t and l0ser", "you are an i d i o t", "you are an apple", None, ""]
    score = {r["doc_id"]: r["score"] for r in scorer.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert min(score[0], score[1]) > 0.5 > max(score[2], score[3], score[4])
    assert scorer.score(rows.limit(0)).isEmpty()
    assert op3.ToxicityScorer(rows, labels.limit(0)).score(rows).where("score <> 0").isEmpty()


def _kept_lines(rows):
    """Rows (all columns) after the deletion of repeated runs, without those that lose all their lines."""
    left, out = _without_repeats([(r["doc_id"], r["text"]) for r in rows]), []
    for r in rows:
        text, n = left[r["doc_id"], r["text"]]
        if not n or BLANKS.search(text or ""):
            out.append((r["doc_id"], text, r["lang"], r["source"], None if text is None else len(text)))
    return out


def _without_repeats(texts):
    """{(doc_id, text): (text left, lines removed)}, by brute force."""
    first, out = {}, {}
    for i, t in sorted({(i, t or "") for i, t in texts}):
        worded = [(n, x) for n, x in enumerate(t.split("\n")) if BLANKS.search(x)]
        gone = set()
        for k in range(len(worded)):
            n = next((n for n in (1, 2, 3) if k + n <= len(worded) and (n == 3 or sum(len(BLANKS.findall(x)) for _, x in worded[k : k + n]) >= 10)), None)
            if n and first.setdefault(tuple(x for _, x in worded[k : k + n]), (i, k)) != (i, k):
                gone |= {at for at, _ in worded[k : k + n]}
        out[i, t] = "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone), len(gone)
    return {(i, t): out[i, t or ""] if t is not None else (None, 0) for i, t in texts}


def _representatives(rows):
    """doc_ids that stay: the least of each group, by counting shared shingles."""
    sets = {r["doc_id"]: _words5(r["text"]) for r in rows}
    holders, shared = defaultdict(list), Counter()
    for i in sorted(sets):
        for x in sets[i]:
            holders[x].append(i)
    for held in holders.values():
        shared.update((a, b) for n, a in enumerate(held) for b in held[n + 1 :])
    at = {i: i for i in sets}

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            low, high = sorted((root(a), root(b)))
            at[high] = low
    return {i for i in sets if root(i) == i}


def _clean(rows, items):
    """Rows without a window of 13 words of an item, and with items on less than a twentieth of their words."""
    windows = {tuple(w[s : s + min(13, len(w))]) for t in items for w in [ALNUM.findall(lower(t))] if w for s in range(max(len(w) - 12, 1))}
    sizes, out = {len(x) for x in windows}, []
    for r in rows:
        w, hit, whole = ALNUM.findall(lower(r["text"])), set(), False
        for k in sizes:
            for s in range(len(w) - k + 1):
                if tuple(w[s : s + k]) in windows:
                    hit.update(range(s, s + k))
                    whole |= k == 13
        if not whole and not (hit and 20 * len(hit) >= len(w)):
            out.append(r)
    return out


def test_pipeline(spark, tmp_path):
    """Each stage on what its predecessor kept: the classifier against labels, the others against brute force."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = found[name] = sorted(map(tuple, docs.collect()), key=repr)
        if name != "packing":
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS and 0 < len(after) <= len(before)
        if name == "quality":
            stayed = {r[0] for r in after}
            good, bad = [i for i, q in labels.items() if q == 1], [i for i, q in labels.items() if q == 0]
            assert sum(i in stayed for i in good) >= 0.98 * len(good) and sum(i not in stayed for i in bad) >= 0.9 * len(bad)
        elif name == "lines":
            assert after == sorted(_kept_lines(before), key=repr) and len(after) < len(before)
        elif name == "near_duplicates":
            stay = _representatives(before)
            assert after == sorted((tuple(r) for r in before if r["doc_id"] in stay), key=repr) and len(after) < len(before)
        elif name == "decontamination":
            assert after == sorted(map(tuple, _clean(before, items)), key=repr) and len(after) < len(before)
        else:
            lengths = Counter()
            for r in docs.collect():
                lengths[r["sequence_id"]] += r["length"]
            assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in before}
            assert max(lengths.values()) <= 2048 and len(lengths) <= -(-sum(lengths.values()) // 2048) + 2


def test_pipeline_judges_rows_not_ids(spark, nothing):
    """Rows that share a doc_id or have none, repeated rows, nulls in all columns, and empty tables."""
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    make = lambda rows: spark.createDataFrame([(i, t, None, None, None) for i, t in rows], shape)
    texts = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, a), (1, b), (2, a), (None, a), (3, b + " end"), (3, b + " end"), (4, "c d e f g h i"), (4, "c d e f g h i"), (5, None), (None, None), (None, "x y z x y z"), (None, "x y z x y z")]
    left = texts(corpus_pipeline.near_duplicates(spark, make(rows), SF))
    assert [x for x in left if x[0] in (2, 3)] == [] and left.count((4, "c d e f g h i")) == 1 and left.count((None, "x y z x y z")) == 1
    assert sum(x in ((1, a), (1, b)) for x in left) == 1 and (5, None) in left and (None, None) in left and len(left) == 5
    item = next(r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(ALNUM.findall(r["text"] or "")) > 15)
    held = " ".join(f"w{i}" for i in range(900)) + " " + item
    rows = [(1, held), (1, "clean words only"), (None, held), (None, "clean words only"), (2, None)]
    assert texts(corpus_pipeline.decontamination(spark, make(rows), SF)) == sorted([(1, "clean words only"), (None, "clean words only"), (2, None)], key=repr)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, SF).isEmpty()


def test_pipeline_finds_repeated_lines(spark):
    passage = " ".join(f"word{i}" for i in range(60))
    rows = [(1, passage), (2, f"own start\n{passage}"), (3, "short text"), (4, "short text"), (5, "a b\n\nc d"), (6, passage)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.lines(spark, docs, SF).collect()}
    assert out == {1: (passage, len(passage)), 2: ("own start", 9), 3: ("short text", 10), 4: ("short text", 10), 5: ("a b\n\nc d", 8)}
