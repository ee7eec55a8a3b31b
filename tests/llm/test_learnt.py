"""Learnt operators: held-out accuracy, planted cases and edge rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessella.llm import compression, decontaminate, toxicity
from tessella.llm.fitting import fold
from tests.llm.corpus import documents

BAD = ["fozzle", "grunkit", "blarpish", "snordle"]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)
    vocab = ["".join(rng.choice(["an", "the", "or", "in", "re", "sh", "ti", "on"]) for _ in range(rng.randint(1, 4))) for _ in range(500)]
    docs, labels = [], []
    for i in range(900):
        w = [rng.choice(vocab) for _ in range(60)]
        toxic, bad = i % 6 == 0, i % 4 == 0
        if toxic:
            for _ in range(3):
                w[rng.randrange(60)] = rng.choice(BAD)
        text = " ".join(f"{x}###" if bad else x for x in w)
        docs.append((i, text))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string").cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache()


def test_quality_on_held_out_rows(labelled):
    docs, labels = labelled
    held = fold(F.col("doc_id"), 3) == 1
    scored = compression.score_quality(docs, compression.fit(docs, labels, "quality", ~held)).join(labels, "doc_id").where(held)
    right = scored.where((F.col("score") >= 0.5) == (F.col("quality") == 1)).count()
    assert right >= 0.95 * scored.count()


def test_quality_edges(spark, labelled):
    docs, labels = labelled
    model = compression.fit(docs, labels.limit(0), "quality", F.lit(True))
    rows = compression.score_quality(documents(spark), model).collect()
    assert {r.score for r in rows} == {0.5} and len(rows) == documents(spark).count()
    assert compression.score_quality(docs.limit(0), model).count() == 0


def test_quality_against_plain_compression(spark, labelled):
    """Scores are those of compressing every 2,048 bytes under each dictionary, one text at a time."""
    import math

    import zstandard

    docs, labels = labelled
    good, bad, w = model = compression.fit(docs, labels, "quality", F.lit(True))

    def size(data, dictionary):
        c = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_dict_id=False)
        return sum(len(c.compress(data[i : i + 2048])) for i in range(0, len(data), 2048))

    long = spark.createDataFrame([(-1, "very long text ### " * 20_000), (-2, None), (-3, "")], "doc_id long, text string")
    both = docs.limit(60).unionByName(long)
    texts = {r.doc_id: (r.text or "").encode() for r in both.collect()}
    for r in compression.score_quality(both, model).collect():
        data = texts[r.doc_id]
        g, b = size(data, good), size(data, bad)
        ncd, rate = ((b - g) / (b + g), g / len(data)) if data else (0.0, 1.0)
        z = sum(x * y for x, y in zip((100 * ncd, 10 * rate, 10 * rate * rate, 100 * ncd * rate, 1.0), w))
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-9


def test_quality_dictionaries_of_whole_texts(spark, labelled, monkeypatch):
    """Dictionaries are those of the blocks with the smallest hashes, from every part of every learnt text."""
    import xxhash

    docs, labels = labelled
    some = docs.where("doc_id < 90").withColumn("text", F.repeat(F.concat("text", F.lit(" "), F.col("doc_id")), 12))
    for most in (10**6, 25):
        monkeypatch.setattr(compression, "SAMPLE_BLOCKS", most)
        good, bad, _ = compression.fit(some, labels, "quality", F.lit(True))
        sample = compression.labelled_sample(some, labels, "quality", F.lit(True), {0: 3000, 1: 3000}).where("part < 2").collect()
        for label, found in ((1, good), (0, bad)):
            cut = [d[i : i + 2048] for r in sample if r.label == label for d in [r.text.encode()] for i in range(0, len(d), 2048)]
            signed = lambda b: (xxhash.xxh64_intdigest(b, seed=42) + 2**63) % 2**64
            assert found == compression.dictionary(sorted(cut, key=lambda b: (signed(b), b))[:most]) and len(found) > 1000


def test_dictionary_of_little_text():
    """A dictionary fits its samples; alike or few blocks are used as they are."""
    few = [b"%d good words of a text " % i * 9 for i in range(6)]
    assert compression.dictionary([]) and compression.dictionary(few) == b"".join(few)
    assert compression.dictionary([b"x" * 2048] * 50)
    many = [bytes([i % 256, j % 251]) * 300 + b"common end of all" for i in range(40) for j in range(9)]
    assert 64 < len(compression.dictionary(many)) <= sum(map(len, many)) // compression.SAMPLES


def test_toxicity_on_held_out_rows(labelled):
    docs, labels = labelled
    held = fold(F.col("doc_id"), 5) == 0
    scored = toxicity.score_toxicity(docs, toxicity.fit(docs, labels, "toxic", ~held)).join(labels, "doc_id").where(held)
    right = scored.where((F.col("score") >= 0.5) == (F.col("toxic") == 1)).count()
    assert right >= 0.97 * scored.count()


def test_disguised_words_are_restored(spark, labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels, "toxic", F.lit(True))
    tail = " an the or in re shti onre"
    texts = ["f0zzle" + tail, "you f o z z l e" + tail, "g-r-u-n-k-i-t" + tail, "blaaaarpish" + tail, "$nordle!!" + tail, "GRUNKIT" + tail, tail, "$$$ 0 !!", "12345 67", None, ""]
    rows = toxicity.score_toxicity(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r.score >= 0.5 for r in rows] == [True] * 6 + [False] * 5
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def test_long_spelled_out_runs_are_read_whole(spark, labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels, "toxic", F.lit(True))
    row, word = "a " * 80, "f o z z l e "
    texts = [word + row, row + word, row + word + row, "i n " * 40 + word + "o r " * 300, row + row, "i n o r " * 40]
    rows = toxicity.score_toxicity(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r.score >= 0.5 for r in rows] == [True] * 4 + [False] * 2


def test_rules_doubled_letters_and_pieces(spark, labelled):
    """Long rows of one mark end in no time, and take no word with them; repeats of two and pieces of words are read."""
    docs, labels = labelled
    model = toxicity.fit(docs, labels, "toxic", F.lit(True))
    tail = " an the or in re shti onre"
    rule = "-" * 10_000
    texts = [rule + "ab" + tail, rule + " fozzle", "a" + "." * 10_000 + "b", "- " * 5000 + "x", "_" * 10_000 + tail, "f o z z l e " + "- " * 3000]
    texts += ["blarpiish" + tail, "grrunkit" + tail, "fo zz le" + tail, "s-n-o-r-d-l-e, x", "f.o z.z l.e" + tail, "an the fo.zz.le" + tail, "x y z " * 200 + "s n o r d l e " + "q p " * 500]
    rows = toxicity.score_toxicity(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r.score >= 0.5 for r in rows] == [False, True, False, False, False, True] + [True] * 7


def test_decoder_against_all_sources():
    """Viterbi finds the best of all sources, counted one by one."""
    from collections import Counter
    from itertools import groupby, product

    rng = random.Random(3)
    pairs, floor = toxicity.Channel.learn(Counter({"fozzle": 9, "grunkit": 4, "an": 30, "off": 7, "the": 20, "zoo": 5}))
    channel = toxicity.Channel(pairs, floor)

    def value(source):
        return sum(channel.step(f"^^{w}$"[i - 2 : i], f"^^{w}$"[i]) for w in source.split(" ") for i in range(2, len(w) + 3))

    for _ in range(200):
        text = "".join(rng.choice("fozleang0@- ") * rng.choice((1, 1, 2, 3)) for _ in range(rng.randint(1, 7)))
        lists = [channel.sources(c, len(list(g))) for c, g in groupby(text)]
        best = max(sum(c for _, c in x) + value("".join(y for y, _ in x)) for x in product(*lists))
        got = channel.decode(text)
        costs = [sum(c for _, c in x) for x in product(*lists) if "".join(y for y, _ in x) == got]
        assert abs(max(costs) + value(got) - best) < 1e-9


def test_long_texts_teach_and_are_scored(spark):
    """Labelled texts of over 60,000 bytes are learnt from like others."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeilnorst") for _ in range(rng.randint(5, 9)))
    docs = [(i, " ".join([word() for _ in range(300)] * 40 + ["fozzle"] * (i % 2) * 3)) for i in range(80)]
    assert min(len(t) for _, t in docs) > 60_000
    labels = [(i, 1, i % 2) for i in range(80)]
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels, "toxic", F.lit(True))
    assert "fozzle" in model[3]
    assert {(r.doc_id % 2 == 1) == (r.score >= 0.5) for r in toxicity.score_toxicity(docs, model).collect()} == {True}


def test_every_labelled_row_teaches(spark, monkeypatch):
    """The lexicon's weights and the known words are counts over all labelled texts, without near copies."""
    import math

    monkeypatch.setattr(toxicity, "SAMPLE_ROWS", {0: 40, 1: 20}, raising=False)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeilnorst") for _ in range(rng.randint(5, 9)))
    rows = [(i, int(i % 5 == 0), " ".join([word() for _ in range(40)] + ["fozzle"] * (i % 5 == 0) + ["grunkit"] * (i % 25 == 0) + ["kettle"] * (i in (1, 2, 3, 4)))) for i in range(600)]
    rows += [(600 + i, 1, "blarpish " + rows[0][2]) for i in range(60)]  # near copies of one toxic text
    docs, labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, y, _ in rows], "doc_id long, toxic int")
    known, lexicon = toxicity.fit(docs, labels, "toxic", F.lit(True))[2:4]
    part = F.pmod(F.xxhash64(F.lit("part"), "text"), F.lit(4))
    taught = {r.doc_id for r in docs.where(part > 0).collect()}
    own = [(y, t.split()) for i, y, t in rows[:600] if i in taught]
    group = int(any(i in taught and (i == 0 or i >= 600) for i, _, _ in rows)) - int(0 in taught)  # one of the copies, if not the first itself
    n_toxic, n_clean = sum(y for y, _ in own) + group, sum(1 - y for y, _ in own)
    for w, more in (("fozzle", group), ("grunkit", group)):
        t = sum(w in x for y, x in own if y) + more
        assert abs(lexicon[w] - (math.log((t + 0.5) / (n_toxic + 1)) - math.log(0.5 / (n_clean + 1)))) < 1e-9
    assert "blarpish" not in lexicon and ("kettle" in known) == (len(taught & {1, 2, 3, 4}) > 1)


def test_near_copies_by_tables(spark, monkeypatch):
    """Rounds over tables leave what one text after another does, and the first of an id's rows."""
    rng = random.Random(6)
    base = [["w" + "".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(30)] for _ in range(12)]
    texts = []
    for i in range(300):
        words = list(base[rng.randrange(12)])
        for _ in range(rng.randrange(14)):
            words[rng.randrange(30)] = "".join(rng.choice("abcdefgh") for _ in range(6))
        texts.append((i // 2 if i < 40 else i, i % 2, " ".join(words)))
    texts += [(400, 0, "1 2 3"), (401, 1, "1 2 3"), (402, 0, ""), (403, 0, "")]
    rows = toxicity.word_rows(spark.createDataFrame(texts, "doc_id long, label int, text string"))
    seen, ids, want = set(), set(), []
    for r in sorted(rows.collect(), key=lambda r: (r.doc_id, r.same, r.n)):
        if r.doc_id not in ids and not ids.add(r.doc_id) and not seen.intersection(r["keys"]):
            seen.update(r["keys"])
            want.append(r.n)
    assert 20 < len(want) < 280 and {r.n for r in toxicity.without_copies(rows).collect()} == set(want)
    monkeypatch.setattr(toxicity, "ON_DRIVER", 0)
    assert {r.n for r in toxicity.without_copies(rows).collect()} == set(want)


def test_drop_toxic_keeps_columns(spark, labelled):
    docs, labels = labelled
    wide = docs.withColumn("score", F.lit(9)).withColumn("row", F.lit(1))
    kept = toxicity.drop_toxic(wide, labels, F.lit(True))
    assert kept.columns == wide.columns
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & {i for i in range(900) if i % 6 == 0} and len(ids) >= 0.97 * 750


@pytest.fixture(scope="module")
def leaks(spark):
    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(3, 8))) for _ in range(3000)]
    prose = lambda k: [rng.choice(vocab) for _ in range(k)]
    items = [prose(rng.randint(15, 60)) for _ in range(25)]
    docs, want = [], set()
    for i in range(200):
        w = prose(rng.randint(50, 300))
        if i % 5 == 0:
            k = (i // 5) % 25
            piece = list(items[k])
            if i % 10 == 0:  # a paraphrase: every sixth word is another
                piece = [rng.choice(vocab) if j % 6 == 5 else x for j, x in enumerate(piece)]
            at = rng.randrange(len(w))
            w[at:at] = [x.capitalize() + ("," if j % 7 == 0 else "") for j, x in enumerate(piece)]
            want.add((i, k))
        docs.append((i, " ".join(w)))
    docs += [(300, None), (301, ""), (302, " ".join(items[3][:5]))]
    return spark.createDataFrame(docs, "doc_id long, text string").cache(), spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(90, None), (91, "!!")], "item_id long, text string").cache(), want


def test_leaks_are_found(leaks, monkeypatch):
    docs, benchmark, want = leaks
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, benchmark).collect()}
    assert got == want
    monkeypatch.setattr(decontaminate, "QUERIES", 30)
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, benchmark).collect()} == want


def test_items_share_one_space(leaks, monkeypatch):
    """A cosine doesn't depend on the block that an item is searched for in."""
    docs, benchmark, _ = leaks
    whole = {(r.doc_id, r.item_id): r.cosine for r in decontaminate.find_leaks(docs, benchmark).collect()}
    monkeypatch.setattr(decontaminate, "QUERIES", 16)
    parts = {(r.doc_id, r.item_id): r.cosine for r in decontaminate.find_leaks(docs, benchmark).collect()}
    assert whole.keys() == parts.keys() and all(abs(whole[k] - parts[k]) < 1e-5 for k in whole)


@pytest.fixture(scope="module")
def paraphrases(spark):
    """Items of 15 to 150 words in documents of common and rare words: whole, with every sixth word replaced, with the
    rarest third replaced, or only a third of them (no leak)."""
    rng = random.Random(12)
    vocab = ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(3, 8))) for _ in range(4000)]
    weights = [1 / (i + 3) for i in range(4000)]
    rank = {w: i for i, w in enumerate(vocab)}
    prose = lambda k: rng.choices(vocab, weights, k=k)
    items = [prose(rng.choice((15, 25, 40, 60, 150))) for _ in range(30)]
    docs, want = [], {"whole": set(), "sixth": set(), "rare": set(), "third": set()}
    for i in range(360):
        w = prose(rng.randint(40, 300))
        kind, k = ["whole", "sixth", "rare", "third", None, None][i % 6], rng.randrange(30)
        if kind:
            piece = list(items[k])
            if kind == "sixth":
                piece[5::6] = prose(len(piece[5::6]))
            elif kind == "rare":
                for j in sorted(range(len(piece)), key=lambda j: -rank[piece[j]])[: len(piece) // 3]:
                    piece[j] = prose(1)[0]
            elif kind == "third":
                piece = piece[: len(piece) // 3]
            at = rng.randrange(len(w))
            w[at:at] = piece
            want[kind].add((i, k))
        docs.append((i, " ".join(w)))
    return spark.createDataFrame(docs, "doc_id long, text string").cache(), spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string").cache(), want


def test_paraphrases_and_thirds(paraphrases):
    """Nine tenths of every kind that the checks confirm, against the checks of every passage and item."""
    docs, benchmark, want = paraphrases
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, benchmark).collect()}
    every = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, benchmark, cosine=-2.0).collect()}
    assert got <= every
    for kind, least in (("whole", 0.95), ("sixth", 0.95), ("rare", 0.9)):
        assert len(every & want[kind]) == len(want[kind]) and len(got & want[kind]) >= least * len(want[kind]), kind
    assert not got - want["whole"] - want["sixth"] - want["rare"]


def test_words_without_a_fitted_place_count(paraphrases, monkeypatch):
    """With a space of few words, the others' shared directions still lead to the leaks."""
    docs, benchmark, want = paraphrases
    monkeypatch.setattr(decontaminate, "TERMS", 40)
    monkeypatch.setattr(decontaminate, "SHARED", 512)
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, benchmark).collect()}
    for kind in ("whole", "sixth"):
        assert len(got & want[kind]) >= 0.9 * len(want[kind]), kind
    assert not got - want["whole"] - want["sixth"] - want["rare"]


def test_space_is_fitted_on_every_passage(leaks, monkeypatch):
    """Its directions hold as much of the passages of all documents and items as any do, however many there are."""
    import numpy as np

    docs, benchmark, _ = leaks
    monkeypatch.setattr(decontaminate, "FIT_DOCS", 5, raising=False)
    space = decontaminate.build_space(docs, benchmark, rank=4)
    place = {int(h): i for i, h in enumerate(space.terms)}
    coded = lambda text: [place.get(int(h), -1) for h in decontaminate.item_words([text])[0]]
    passages = lambda words: [words[i : i + 32] for i in range(0, len(words), 32)]
    texts, items = ([r.text for r in t.collect()] for t in (docs, benchmark))
    own = [c for t in items if (c := coded(t))]
    gram = np.zeros((len(place), len(place)))
    for times, rows in ((1, [p for t in texts for p in passages(coded(t))]), (len(texts) / len(own), own)):
        for some in rows:
            v = np.bincount([x for x in some if x >= 0], minlength=len(place)) * space.idf
            gram += times * np.outer(v, v) / max(v @ v, 1e-12)
    basis = space.vectors[space.row[:-1]] / space.idf[:, None]
    assert np.allclose(basis.T @ basis, np.eye(4), atol=1e-4)
    one = np.random.default_rng(3)
    q, _ = np.linalg.qr(gram @ one.standard_normal((len(place), 20)))
    reach = np.sort(np.linalg.eigvalsh(q.T @ gram @ q))[-4:].sum()
    assert np.trace(basis.T @ gram @ basis) >= 0.93 * reach


def test_latent_search_against_brute_force(spark):
    """Items of the benchmark table in its documents, whole, with every sixth word replaced, or without their rarest third
    (words of other items stand for them): the cosine search finds nine tenths of what the checks confirm when they look
    at every passage and item, and nine tenths of what was put in."""
    d = "/root/testdata/sf0.01"
    docs, benchmark = spark.read.parquet(f"{d}/documents.parquet").where("text is not null"), spark.read.parquet(f"{d}/benchmark.parquet")
    space = decontaminate.build_space(docs, benchmark)
    weight = dict(zip(space.terms.tolist(), space.idf.tolist()))
    rng = random.Random(2)
    items = [(r.item_id, r.text.split()) for r in benchmark.collect()]
    hosts = [r.text.split() for r in docs.where("n_chars between 500 and 4000").orderBy("doc_id").limit(150).collect()]
    words = [w for _, t in items for w in t]
    rows, want = [], []
    for i in range(150):
        k, t = items[rng.randrange(len(items))]
        t = list(t)
        if i % 3 == 1:
            t[5::6] = rng.choices(words, k=len(t[5::6]))
        elif i % 3 == 2:
            rank = {j: weight[int(h)] for j, w in enumerate(t) for h in decontaminate.item_words([w])[0][:1]}
            for j in sorted(rank, key=lambda j: -rank[j])[: len(t) // 3]:
                t[j] = rng.choice(words)
        at = rng.randrange(len(hosts[i]))
        rows.append((i, " ".join(hosts[i][:at] + t + hosts[i][at:])))
        want.append((i, k))
    planted = spark.createDataFrame(rows, "doc_id long, text string")
    both = docs.select((F.col("doc_id") + 1000).alias("doc_id"), "text").unionByName(planted)
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(both, benchmark).collect()}
    every = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(both, benchmark, cosine=-2.0).collect()}
    assert found <= every and len(found) >= 0.9 * len(every)
    for kind in range(3):
        mine = {w for w in want if w[0] % 3 == kind}
        assert len(found & mine) >= 0.9 * len(mine), kind


def test_drop_leaks(leaks):
    docs, benchmark, want = leaks
    wide = docs.withColumn("row", F.lit(1)).withColumn("item_id", F.lit(2))
    kept = decontaminate.drop_leaks(wide, benchmark)
    assert kept.columns == wide.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in want}
    assert decontaminate.drop_leaks(docs, benchmark.limit(0)).count() == docs.count()
    assert decontaminate.find_leaks(docs.limit(0), benchmark).count() == 0


def test_common_subsequence():
    import numpy as np

    rng = random.Random(1)
    for _ in range(50):
        a, b = [rng.randrange(5) for _ in range(rng.randint(1, 12))], [rng.randrange(5) for _ in range(rng.randint(0, 12))]
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert decontaminate.common_subsequence(np.array(a, dtype=np.uint64), b) == best[-1][-1]


def test_pieces_and_moves_are_worked_out_once():
    """A token's letters and a place's moves are remembered: a text of one repeated row of pieces costs each only once."""
    from tessella.llm.toxicity import Channel

    channel = Channel(*Channel.learn(Counter({"fozzle": 9, "lamp": 5})))
    assert "fozzle" in channel.spelled_out(["f", "o", "z", "z", "l", "e", "lantern"] * 50)
    assert channel.piece.cache_info().misses == 6 and channel.hidden("lamp") == set()
    first = channel.next.cache_info().misses
    channel.decode("fozzle")
    channel.decode("fozzle")
    assert channel.next.cache_info().misses <= first + 40 and channel.next.cache_info().hits > 0
