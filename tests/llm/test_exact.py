"""Operators with exact results against brute force on the small corpus."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessella.llm import katz, licenses, mixing, near_dedup, quality_rules, shuffle, suffixes
from tessella.llm.components import components
from tests.llm.corpus import collect, documents, words


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


@pytest.mark.parametrize("order", [2, 3, 4])
def test_katz_matches_plain_python(docs, monkeypatch, order):
    """A recursive model over dictionaries; every context's probabilities add up to one."""
    monkeypatch.setattr(katz, "CHUNK_TOKENS", 500)
    monkeypatch.setattr(katz, "PART_TOKENS", 500)
    held = F.coalesce(F.col("doc_id") % 5 == 1, F.lit(False))
    got = defaultdict(list)
    for r in katz.katz_scores(docs, held, order).collect():
        got[r.doc_id].append(r)
    low = lambda t: ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words(t)] + [0]
    rows = [(d, low(t)) for d, t in collect(docs)]
    train = [w for d, w in rows if d is None or d % 5 != 1]
    grams = lambda w, k: [tuple([1, *w][i - k + 1 : i + 1]) for i in range(1, len(w) + 1) if i - k + 1 >= 0]
    counts = {k: Counter((x,) if k == 1 else g for w in train for x, g in (zip(w, w) if k == 1 else ((None, g) for g in grams(w, k)))) for k in range(1, order + 1)}
    size, after = Counter(), defaultdict(dict)
    for k in range(2, order + 1):
        for g, c in counts[k].items():
            size[g[:-1]] += c
            after[g[:-1]][g[-1]] = c
    total, v = sum(counts[1].values()), len(counts[1])

    def kept(c):
        n = Counter(c.values())
        d = katz.discounts([n[r] for r in range(katz.K + 2)])
        return lambda c: d[c] * c if c <= katz.K else c - katz.SPARE

    keep = {k: kept(counts[k]) for k in counts}
    p1 = {g[0]: keep[1](c) / total for g, c in counts[1].items()}
    unknown = 1 - sum(p1.values())
    weights = {}

    def p(h, w):
        if not h:
            return p1.get(w, unknown)
        if h not in after:
            return p(h[1:], w)
        c = after[h].get(w)
        return keep[len(h) + 1](c) / size[h] if c else weight(h) * p(h[1:], w)

    def weight(h):
        if h not in weights:
            left = sum(c - keep[len(h) + 1](c) for c in after[h].values()) / size[h]
            weights[h] = left / (1 - sum(p(h[1:], w) for w in after[h]))
        return weights[h]

    for h in list(after)[:: 40 if order > 2 else 3]:  # exactly normalised
        assert math.isclose(sum(p(h, w) for w in p1) + p(h, "not a word"), 1, rel_tol=1e-9)
    for d, w in rows:
        s = sum(math.log10(p(tuple([1, *w][max(0, i - order + 1) : i]), w[i - 1])) for i in range(1, len(w) + 1))
        base = sum(math.log10((counts[1][x,] + 0.5) / (total + 0.5 * (v + 1))) for x in w)
        r = got[d][0]
        assert math.isclose(r.score, s, rel_tol=1e-9, abs_tol=1e-9) and math.isclose(r.base_score, base, rel_tol=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum((x,) in counts[1] for x in w), total)


def test_katz_without_rows(spark, docs):
    assert katz.katz_scores(docs.limit(0), F.lit(False)).count() == 0
    rows = katz.katz_scores(docs.where("doc_id < 3"), F.lit(True)).collect()
    assert all(r.score == 0 and r.train_tokens == 0 for r in rows)


def test_repeats_match_brute_force(docs, monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(suffixes, "PART_BYTES", 4000)
    monkeypatch.setattr(suffixes, "SCAN_BYTES", 1000)
    some = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r.doc_id: r for r in suffixes.remove_repeats(some).collect()}
    seen = set()
    for d, t in sorted(collect(some)):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - suffixes.SPAN + 1):
            s = data[p : p + suffixes.SPAN]
            if s in seen:
                gone[p : p + suffixes.SPAN] = b"\1" * suffixes.SPAN
            seen.add(s)
        left = bytes(b for b, g in zip(data, gone) if not g)
        r = got[d]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(data), sum(gone), len(re.findall(b"\1+", bytes(gone)))), d
        assert r.kept_sha256 == hashlib.sha256(left).hexdigest() and bytes(r.text) == left


def test_repeats_of_repeated_rows(docs):
    rows = suffixes.remove_repeats(docs.where("doc_id = 3 or doc_id is null")).collect()
    whole = sorted((r.n_removed, r.n_bytes) for r in rows if r.doc_id == 3)
    assert len(rows) == 3 and whole[0][0] == 0 and whole[1][0] == whole[1][1]
    assert suffixes.remove_repeats(docs.limit(0)).count() == 0


def test_blind_trie_sorts():
    import random

    rng = random.Random(3)
    strings = list({bytes(rng.choice(b"ab") for _ in range(12)) for _ in range(300)})
    trie = suffixes.BlindTrie(strings[0])
    for s in strings[1:]:
        trie.insert(s)
    assert trie.sorted() == sorted(strings)


def test_near_duplicates_match_brute_force(docs, monkeypatch):
    monkeypatch.setattr(near_dedup, "PIECE", 2)
    monkeypatch.setattr(near_dedup, "GROUP_ROWS", 4)
    some = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    low = lambda t: ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words(t)]
    sets = {}
    for d, t in collect(some):
        w = low(t)
        sets[d] = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} or ({tuple(w)} if w else set())
    label = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if a != b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(some, width=4).collect()}
    assert got == {d: (len(s), label[d], label[d] == d) for d, s in sets.items()}
    assert got[5][1] == got[6][1] == 1 and got[15][1] == 14 and got[13] == (0, 13, True)


def test_repeated_ids_go_by_their_texts(spark):
    """Rows of one id with unlike texts keep their own links; no row is lost."""
    prose = lambda x, *more: " ".join([f"{x}{i}" for i in range(40)] + list(more))
    rows = [(1, prose("a")), (2, prose("a", "one")), (2, prose("x")), (3, prose("x", "two")), (7, prose("u")), (7, prose("a", "three")), (9, None), (9, prose("x", "four")), (None, prose("a"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept or False, r.n_shingles) for r in near_dedup.near_duplicates(docs, width=4).collect())
    assert got == sorted([(1, 1, True, 37), (2, 1, False, 38), (2, 2, True, 37), (3, 2, False, 38), (7, 7, True, 37), (7, 1, False, 38), (9, 9, True, 0), (9, 2, False, 38), (0, 0, False, 37)])
    kept = {(r.doc_id, r.text) for r in near_dedup.keep_one(docs.unionByName(docs.where("doc_id = 1")), width=4).collect()}
    assert kept == {rows[0], rows[2], rows[4], rows[6], rows[8]}
    assert near_dedup.keep_one(docs.unionByName(docs.where("doc_id = 1")), width=4).count() == 5


def test_popular_hubs_are_spread(spark, monkeypatch):
    """Many near copies and exact copies of one text, texts without words, all with small spreads."""
    monkeypatch.setattr(near_dedup, "SPREAD", 3)
    monkeypatch.setattr(near_dedup, "PIECE", 4)
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(i, text if i % 3 else f"{text} n{i}") for i in range(60)] + [(100 + i, [None, "", " "][i % 3]) for i in range(30)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 90 and all(r.component_id == (0 if r.doc_id < 60 else r.doc_id) for r in got)


def test_keep_one(docs):
    rows = near_dedup.keep_one(docs, width=4).collect()
    ids = [r.doc_id for r in rows]
    assert len(ids) == len(set(ids)) and None in ids and {1, 11, 12, 13, 14} <= set(ids) and not {5, 6, 15} & set(ids)
    assert rows[0].__fields__ == docs.columns
    assert near_dedup.keep_one(docs.limit(0)).count() == 0


def test_sketch_fills_small_sets():
    import numpy as np

    for n in (1, 2, 50):
        assert near_dedup.sketch(np.arange(n, dtype=np.uint64)).max() < np.iinfo(np.uint64).max


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert components(edges.limit(0)).count() == 0


def test_quality_measures(docs):
    got = {}
    for r in quality_rules.measures(docs).collect():
        got[r.doc_id] = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
    for d, t in collect(docs):
        w = words(t)
        n = Counter(zip(w, w[1:], w[2:]))
        cover = {i + k for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        assert got[d] == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover)), d


def test_repeated_words_are_exact_whatever_the_hash(spark, docs, monkeypatch):
    """Windows whose hash bits collide, as in texts of millions of words, are told apart by their words."""
    want = {r.doc_id: r.n_repeat_words for r in quality_rules.measures(docs).collect()}
    monkeypatch.setattr(quality_rules, "_window", lambda words, i: F.pmod(F.xxhash64(F.get(words, i)), F.lit(3)) * F.lit(1 << 61))
    assert {r.doc_id: r.n_repeat_words for r in quality_rules.measures(docs).collect()} == want


def test_verdicts_match_brute_force(spark):
    """Ladders, gains, exact bounds, fixed sequences and the choice of cutoffs, one by one in Python."""
    import random

    rng = random.Random(4)
    rows = []
    for i in range(8000):
        good = rng.random() < 0.8
        w = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(45, 90))]
        w = [x + ("#" if rng.random() < (0.01 if good else 0.3) else "") + ("!" if rng.random() < (0.02 if good else 0.2) else "") for x in w]
        w = [x.upper() if rng.random() < (0.02 if good else 0.1) else x for x in w]
        rows.append((i, " ".join(w), rng.choice(["en", "en", "en", "de"]), int(good)))
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows if r[0] % 10], "doc_id long, quality int")
    measured = quality_rules.materialize(quality_rules.measures(docs))
    names = list(quality_rules.rules())
    data = {r.doc_id: r for r in measured.select("doc_id", "lang", quality_rules.base_failed().alias("failed"), *[v.alias(n) for n, v in quality_rules.rules().items()]).collect()}
    quality = {r[0]: r[3] for r in rows if r[0] % 10}
    use = [(d, data[d]) for d in sorted(quality) if not data[d].failed]
    held = {d: zlib.crc32(str(d).encode()) % 2 == 1 for d, _ in use}
    strata = {r.lang for _, r in use}
    a, delta = quality_rules.MAX_FALSE_REJECTION / len(names), quality_rules.CONFIDENCE_ERROR / (len(names) * len(strata))
    cdf = lambda k, n: sum(math.comb(n, j) * a**j * (1 - a) ** (n - j) for j in range(k + 1)) if k <= n * a else 1.0
    cuts = {}
    for name in names:
        def quantiles(label, at):
            v = sorted(r[name] for d, r in use if not held[d] and quality[d] == label)
            return [v[max(0, math.ceil(q * len(v)) - 1)] for q in at]

        ladder = sorted({*quantiles(0, quality_rules.LADDER), *quantiles(1, quality_rules.GOOD_LADDER)})
        for lang in strata:
            values = lambda h, y: [r[name] for d, r in use if r.lang == lang and held[d] == h and quality[d] == y]
            hg, lg, lb = values(True, 1), values(False, 1), values(False, 0)
            passed = []
            for c in reversed(ladder):
                k = sum(v > c for v in hg)
                if cdf(k, len(hg)) > delta:
                    break
                gain = sum(v > c for v in lb) / len(lb) - quality_rules.GOOD_COST * sum(v > c for v in lg) / len(lg)
                if gain > 0:
                    passed.append((c, gain))
            if passed:
                top = max(g for _, g in passed)
                cuts[lang, name] = max(c for c, g in passed if g >= top - quality_rules.SLACK)
    chosen = {(r.stratum, r.rule): r.cutoff for r in quality_rules.cutoffs(measured, labels).collect()}
    assert chosen == cuts and len(cuts) >= 3
    verdict = {r.doc_id: r.kept for r in quality_rules.judge(measured, quality_rules.cutoffs(measured, labels)).collect()}
    assert verdict == {d: not r.failed and not any(r[n] > cuts.get((r.lang, n), math.inf) for n in names) for d, r in data.items()}
    assert 0 < sum(verdict.values()) < 8000 - sum(r.failed for r in data.values())


def test_binomial_and_certified_cutoffs(spark):
    cdf = lambda k, n, p: sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))
    rows = spark.createDataFrame([(0, 300), (3, 900), (20, 3000)], "k long, n long").select("k", "n", quality_rules.binomial_cdf(F.col("k"), F.col("n"), 0.01).alias("p")).collect()
    assert all(math.isclose(r.p, cdf(r.k, r.n, 0.01) if r.k <= r.n * 0.01 else 1.0, rel_tol=1e-6) for r in rows)
    # 6,000 good documents without symbols, 600 bad ones with many; one stratum with too few labels
    d = spark.range(6600).withColumnRenamed("id", "doc_id").withColumn("lang", F.when(F.col("doc_id") < 6500, "en"))
    d = d.withColumn("text", F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(F.lit("w"), F.when(F.col("doc_id") % 11 == 0, "#").otherwise("x"), i, F.lit("x"), F.col("doc_id")))))
    labels = d.select("doc_id", F.when(F.col("doc_id") % 11 == 0, 0).otherwise(1).alias("quality"))
    measured = quality_rules.materialize(quality_rules.measures(d))
    chosen = quality_rules.cutoffs(measured, labels)
    kept = {(r.lang, r.bad): (r.kept, r.n) for r in quality_rules.judge(measured, chosen).groupBy("lang", (F.col("doc_id") % 11 == 0).alias("bad")).agg(F.count_if("kept").alias("kept"), F.count("*").alias("n")).collect()}
    assert kept["en", True][0] == 0 and kept["en", False][0] == kept["en", False][1]
    assert kept[None, True][0] == kept[None, True][1]
    empty = quality_rules.cutoffs(measured.limit(0), labels.limit(0))
    assert empty.count() == 0 and quality_rules.judge(measured, empty).where("kept").count() == 6600


def test_shards(docs):
    rows = shuffle.shard_documents(docs, ["doc_id"], 8).collect()
    assert len(rows) == docs.count()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    place = lambda rs: sorted((r.doc_id is None, r.doc_id or 0, r.text or "", r.shard, r.slot) for r in rs)
    again = place(shuffle.shard_documents(docs.repartition(7).withColumn("SHARD", F.lit(1)).drop("SHARD"), ["doc_id"], 8).collect())
    assert place(rows) == again
    assert shuffle.shard_documents(docs.limit(0), ["doc_id"]).count() == 0
    assert [(r.shard, r.slot) for r in shuffle.shard_documents(docs.limit(1), ["doc_id"]).collect()] == [(0, 0)]


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_feistel_is_a_permutation(spark, n):
    got = [r.p for r in spark.range(n).select(shuffle.feistel(F.col("id"), F.lit(n).cast("long"), 1).alias("p")).collect()]
    assert sorted(got) == list(range(n)) and (n < 10 or got != list(range(n)))


def test_mix(docs):
    narrow, plan = mixing.mix_plan(docs)
    rows = plan.collect()
    total = sum(r.source_size for r in rows)
    assert math.isclose(sum(r.target for r in rows), total, rel_tol=1e-6) and all(0 <= r.target <= 3 * r.source_size for r in rows)
    sizes = defaultdict(list)
    for r in narrow.collect():
        sizes[r.source].append(r.size)
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    taken = Counter()
    for r in mixed.select("source", "text").collect():
        taken[r.source] += len(words(r.text))
    for r in rows:
        assert abs(taken[r.source] - r.target) <= max(sizes[r.source]), r
    assert mixing.mix_documents(docs.limit(0)).count() == 0


def test_mix_reshares_above_the_cap(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 5)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    # weights 5 2 1 5: a and the null source are capped at 3 times their size, the rest is shared 2 to 1
    assert got["a"] == 30 and got[None] == 15 and math.isclose(got["b"], (2015 - 45) * 2 / 3, rel_tol=1e-6) and math.isclose(got["c"], (2015 - 45) / 3, rel_tol=1e-6)


def test_licenses(spark):
    rows = [(1, "Some prose here.\nReleased under the MIT License.\nMore."), (2, "released UNDER the mit license!!"), (3, None), (4, ""), (5, "License"), (6, "the the the the the the the"), (7, "Redistribution and use in source and binary\nforms, with or without modification, are permitted\nprovided that the following conditions are met:\n\nEnd.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.license): (r.n_units, r.n_windows, r.dice) for r in licenses.scan_licenses(df.withColumns({"w": F.lit(1), "license": F.lit("x"), "key": F.lit(None).cast("int")})).collect()}
    assert got == {(1, "MIT"): (1, 1, 1.0), (2, "MIT"): (1, 1, 1.0), (7, "BSD-2-Clause"): (1, 1, 1.0)}
    assert licenses.scan_licenses(df.limit(0)).count() == 0
    twice = licenses.scan_licenses(df.unionByName(df)).collect()
    assert {(r.doc_id, r.license): (r.n_units, r.n_windows, r.dice) for r in twice} == {k: (2 * u, v, d) for k, (u, v, d) in got.items()} or all(r.n_windows == 1 for r in twice)


def test_licenses_within_and_across_lines(spark):
    """A notice inside a line, one wrapped between lines of code, two after one another, one with a word put in, in a long text."""
    mit, cc = "Released under the MIT License.", "This work is licensed under a Creative Commons Attribution 4.0 International License."
    prose = "words of no licence at all " * 4000
    rows = [(1, f"Copyright 2020 X. {mit}"), (2, "int a = first + second;\nfor x in all of them: print(x)\n# This work is licensed under a Creative\n# Commons Attribution 4.0 International License.\nint b;"), (3, f"{mit} {mit}"), (4, prose + cc.replace("licensed", "hereby licensed") + prose), (5, "mit license and creative commons")]
    got = {(r.doc_id, r.license): (r.n_units, r.n_windows) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "MIT"): (0, 1), (2, "CC-BY-4.0"): (0, 1), (3, "MIT"): (1, 2), (4, "CC-BY-4.0"): (0, 1)}


def test_licenses_cut_only_texts_with_a_key(spark):
    """Units are cut from the stored rows with a key alone; breaks of any kind part words, so a unit's bigrams are the text's."""
    mit = "Released under the MIT License."
    rows = [(1, "no notice here\nnone here either"), (2, f"\u0130\u03a3\n{mit}\n \t\n\u00e9"), (3, None), (4, ""), (5, f"x\r\n\n{mit}"), (6, "released\nunder\nthe MIT\n\nlicense"), (7, "mit")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = licenses.keyed_texts(df)
    assert {r.doc_id for r in kept.collect()} == {2, 5, 6} and set(kept.columns) == {"doc_id", "text", "w", "own_keys"}
    assert {(r.doc_id, r.n_units, r.n_windows) for r in licenses.scan_licenses(df).collect()} == {(2, 2, 1), (5, 1, 1), (6, 1, 1)}


def test_license_keys_cover_every_match():
    for _, _, grams, keys in licenses.template_rows():
        must = math.ceil(round(0.8 / 1.2 * len(grams), 9))
        assert len(grams) - len(keys) < must


def test_folds():
    assert zlib.crc32(b"12") % 5 == zlib.crc32(str(12).encode()) % 5
