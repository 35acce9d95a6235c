"""Document operators against brute force, on a fixture of nulls, empty and long texts, ties, copies and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from groundswell.llm import queries as Q
from groundswell.llm.bpe import encode_documents
from groundswell.llm.exact_dedup import exact_dedup
from groundswell.llm.license_scan import license_scan, samples_needed
from groundswell.llm.mixing import mix_sources
from groundswell.llm.near_dedup import _across, _prefixes, components, most_flipped, near_dedup
from groundswell.llm.perplexity import perplexity_filter
from groundswell.llm.quality_rules import accuracies, posterior, quality_rules
from groundswell.llm.sharding import Tree, shard_documents
from groundswell.llm.substring_dedup import ladder, substring_dedup
from groundswell.llm.toxicity import toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, _key string, kept boolean"
WORD = rb"[^\x20\x09-\x0D]+"


def texts():
    rng = np.random.default_rng(11)
    vocabulary = ["".join(rng.choice(list("aeioulmnrst"), rng.integers(1, 9))) for _ in range(400)]
    make = lambda n: " ".join(rng.choice(vocabulary, n))
    passage = make(60)
    out = [None, "", "  \t\n", "one", "One", "one two", "é ü x\u0085y <|endoftext|> z", passage, passage]
    base = make(120)
    for k in range(8):
        w = base.split()
        for _ in range(k):
            w[int(rng.integers(0, len(w)))] = "edit%d" % rng.integers(0, 99)
        out.append(" ".join(w))
    out += [make(40) + "\n" + passage + "\n" + make(30) for _ in range(4)]
    out += ["same line\nsame line\n" + make(60), "loop it " * 80, make(5000), "x" * 30000, make(60).upper()]
    return [*out, *[make(int(n)) for n in rng.integers(1, 200, 30)]]


def rows():
    out = [(i, t, ["en", "de", None][i % 3], ["b", "a", None, "a"][i % 4], 0, 7, "clash", False) for i, t in enumerate(texts())]
    return [*out, (3, "one", "en", "b", 0, 7, "clash", False), (None, "no id", None, None, None, None, None, None), (None, "no id", None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(WORD, (t or "").encode())


def test_exact_dedup(docs, none):
    groups = defaultdict(list)
    for r in rows():
        groups[r[1] or ""].append(r[0])
    want = Counter()
    for ids in groups.values():
        keep = max([i for i in ids if i is not None], default=None)
        want.update((i, keep if len(ids) > 1 else i, len(ids), i == keep or len(ids) == 1) for i in ids)
    for limit in (500_000, 0):
        got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(docs, broadcast_keys=limit).collect())
        assert got == want
    assert exact_dedup(none).count() == 0


@pytest.mark.parametrize("length,levels", [(35, 2), (12, 3)])
def test_substring_dedup(docs, none, length, levels):
    seen = Counter()
    for r in rows():
        w = words(r[1])
        seen.update(tuple(w[i : i + length]) for i in range(len(w) - length + 1))
    want = Counter()
    for r in rows():
        w = words(r[1])
        gone = set()
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone.update(range(i, i + length))
        want[r[0], len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()] += 1
    got = Counter((r.doc_id, r.n_words, r.n_removed, bytes(r.kept_sha256).hex()) for r in substring_dedup(docs, length=length, levels=levels).collect())
    assert got == want and ladder(35, 2) == (18, 35)
    assert substring_dedup(none).count() == 0


@pytest.mark.parametrize("key", [None, 7])
def test_substring_dedup_of_many_texts_under_one_key(spark, key):
    rng = np.random.default_rng(2)
    passage = " ".join(f"p{i}" for i in range(12))
    texts = [" ".join([*[f"a{n}"] * int(n % 5), passage, *[f"w{n}x{i}" for i in range(int(rng.integers(0, 30)))]]) for n in range(3000)]
    want = Counter((len(t.split()), 12, hashlib.sha256(" ".join(x for x in t.split() if x[0] != "p").encode()).hexdigest()) for t in texts)
    docs = spark.createDataFrame([(key, t) for t in texts], "doc_id long, text string")
    copies = [n for t, n in Counter(texts).items() if n > 1]
    got = substring_dedup(docs, length=12).collect()
    alone = Counter((r.n_words, r.n_removed, bytes(r.kept_sha256).hex()) for r in got if r.copies == 1)
    assert len(got) == len(texts) and sum(alone.values()) == len(texts) - sum(copies)
    assert not alone - want and all(r.n_removed == r.n_words for r in got if r.copies > 1)


@pytest.mark.parametrize("k", [2, 5])
def test_near_dedup(docs, none, k):
    sets = {}
    for r in rows():
        if r[0] is not None:
            w = words(r[1])
            w = [x.lower() for x in w]
            sets[r[0]] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    got = near_dedup(docs, words=k).collect()
    assert len(got) == len(rows())
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), top(r.doc_id), top(r.doc_id) == r.doc_id)
    assert near_dedup(none).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r.id: r.component for r in components(edges).collect()} == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert most_flipped(600, 0.8) < most_flipped(600, 0.6)


def test_bpe_is_the_librarys(docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(Q.vocabulary())
    t.no_truncation()
    t.no_padding()
    got = encode_documents(docs, Q.vocabulary(), keep=("doc_id", "text")).collect()
    assert len(got) == len(rows())
    for r in got:
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.token_ids) == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert encode_documents(none, Q.vocabulary()).count() == 0


def test_sharding(docs, none):
    got = shard_documents(docs).collect()
    slots = defaultdict(list)
    text = {r[0]: r[1] or "" for r in rows()}
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 24) and 0 <= r.shard < 24
        assert (r.size, r.text_crc32) == (len(text[r.doc_id].encode()) + 8, zlib.crc32(text[r.doc_id].encode()))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(got) == len(rows())
    assert shard_documents(none).count() == 0 and Tree.of(25, founded=24).regions[:2] == Tree.of(24).regions


@pytest.mark.parametrize("shards,founded", [(10, None), (1, None), (13, 4)])
def test_one_more_shard_takes_rows_only_into_itself(spark, shards, founded):
    ids = spark.range(4000).selectExpr("IF(id % 3 = 0, NULL, id) AS doc_id", "CAST(id % 50 AS STRING) AS text")
    got = shard_documents(ids, shards=shards, founded=founded).collect()
    assert all(r.grown_shard in (r.shard, shards) for r in got) and any(r.grown_shard == shards for r in got)
    grown = {r.doc_id: r.shard for r in shard_documents(ids, shards=shards + 1, founded=founded or shards).collect()}
    assert all(grown[r.doc_id] == r.grown_shard for r in got)
    nulls = [r for r in got if r.doc_id is None]
    assert len({r.shard for r in nulls}) == 1 and len({r.bucket for r in nulls}) > 40
    for shard in range(shards):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))


def test_sharding_follows_weights(spark):
    from pyspark.sql import functions as F

    from groundswell.llm.sharding import place

    tree = Tree((((1.0, 1.0), (2.0,)), ((4.0,),)))
    n = Counter(r[0] for r in spark.range(8000).select(place(F.col("id").cast("string"), tree)).collect())
    assert all(abs(n[s] / 1000 - w) < 0.2 for s, w in enumerate((1, 1, 2, 4)))


def test_mixing(docs, none):
    size = defaultdict(int)
    for r in rows():
        size[r[3]] += len(words(r[1]))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, fixed, left = {}, set(), sum(size.values())
    while True:
        rest = [s for s in names if s not in fixed]
        share = {s: left * weight[s] / sum(weight[z] for z in rest) for s in rest}
        over = [s for s in rest if share[s] > 3 * size[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s], left = 3 * size[s], left - 3 * size[s]
            fixed.add(s)
    got, taken = mix_sources(docs).collect(), defaultdict(int)
    assert len(got) == len(rows())
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == size[r.source]
        rate = target[r.source] / size[r.source]
        assert abs(r.copies - rate) < 1 and r.taken == r.copies * r.size <= 3 * r.size
        taken[r.source] += r.taken
    longest = max(len(words(r[1])) for r in rows())
    assert all(abs(taken[s] - target[s]) <= 1.01 * longest for s in names)
    assert sorted(map(str, got)) == sorted(map(str, mix_sources(docs.repartition(7)).collect())) and mix_sources(none).count() == 0


def test_mixing_of_rows_without_ids_is_the_same_again(spark):
    rows = [(None, " ".join([f"w{i}"] * 7), "a") for i in range(300)] + [(5, f"x{i} y", "a") for i in range(50)] + [(i, "z " * 9, "b") for i in range(100, 140)]
    a, b = (Counter((r.doc_id, r.t, r.copies) for r in mix_sources(spark.createDataFrame(rows[::step], "doc_id long, text string, source string").repartition(n).selectExpr("*", "text AS t"), carry=("t",)).collect()) for step, n in ((1, 2), (-1, 5)))
    assert a == b and sum(a.values()) == len(rows)


def test_quality_rules(docs, none):
    got = quality_rules(docs).collect()
    text = {r[0]: r[1] or "" for r in rows()}
    for r in got:
        t = text[r.doc_id]
        w = [x.decode() for x in words(t)]
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n, found = Counter(tri), set()
        for i, x in enumerate(tri):
            if n[x] > 1:
                found.update((i, i + 1, i + 2))
        lines = [x for x in t.split("\n") if re.search(WORD, x.encode())]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(found))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", t)) and r.base_failed == (len(w) < 50 or 100 * len(found) > 50 * len(w))
        assert not (r.kept and r.base_failed)
    assert len(got) == len(rows()) and quality_rules(none).count() == 0


def test_em_finds_the_accuracy_of_planted_rules():
    rng = np.random.default_rng(4)
    n, kind = 40_000, rng.choice(4, 40_000, p=[0.955, 0.015, 0.015, 0.015])  # 0 good, then junk that rules 0 to 2 are against
    bad = rng.random((n, 4)) < np.array([0.01, 0.002, 0.001, 0.2])  # on good texts; rule 3 is noise
    for j in range(3):
        bad[:, j] |= (kind == j + 1) & (rng.random(n) < 0.95)
    bad[:, 1] |= (kind == 1) & (rng.random(n) < 0.7)  # confirms rule 0
    votes = np.where(rng.random((n, 4)) < 0.05, 0, np.where(bad, -1, 1))
    shares, found = accuracies(sorted(Counter(map(tuple, votes.tolist())).items()))
    assert abs(found[0][3] - 0.2) < 0.02 and all(found[0][j] < 0.02 for j in range(3)) and abs(shares[0] - 0.955) < 0.02
    assert posterior((1, 1, 1, -1), shares, found) > 0.9 and posterior((-1, -1, 1, 1), shares, found) < 0.05
    verdict = np.array([posterior(tuple(v), shares, found) >= 0.5 for v in votes[:3000].tolist()])
    assert (verdict == (kind[:3000] == 0)).mean() > 0.95


def test_em_is_expectation_maximisation():
    """Against sums over texts, one at a time."""
    patterns = [((1, 1), 60), ((-1, 0), 5), ((-1, -1), 9), ((1, -1), 12), ((0, 0), 3)]
    shares, bad = accuracies(patterns, rounds=3, settled_at=0)
    pi, q = [1 - 2 * 0.0125, 0.0125, 0.0125], [[0.01, 0.01], [0.9, 0.1], [0.1, 0.9]]
    first, start, n = list(pi), [list(x) for x in q], sum(k for _, k in patterns)
    for _ in range(3):
        texts = []
        for votes, k in patterns:
            p = [pi[c] * math.prod(q[c][j] if v < 0 else 1 - q[c][j] if v > 0 else 1 for j, v in enumerate(votes)) for c in range(3)]
            texts += [(votes, [x / sum(p) for x in p])] * k
        pi = [(sum(p[c] for _, p in texts) + 0.5 * n * first[c]) / (1.5 * n) for c in range(3)]
        q = [[(sum(p[c] for v, p in texts if v[j] < 0) + 10 * start[c][j]) / (sum(p[c] for v, p in texts if v[j]) + 10) for j in range(2)] for c in range(3)]
    assert np.allclose(shares, pi) and np.allclose(bad, q) and accuracies([])[0] == [1.0]


def test_toxicity_learns_from_positives(spark, docs, none):
    rng = np.random.default_rng(3)
    plain = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    made = [(i, " ".join([*rng.choice(plain, 30), *(["vilewordish"] * (i % 4 == 0))]), "en", "s", 0, 0, "", False) for i in range(600)]
    labels = spark.createDataFrame([(i, i % 2, int(i % 4 == 0)) for i in range(0, 600)], "doc_id long, quality int, toxic int")
    got = toxicity(spark.createDataFrame(made, SCHEMA), labels).collect()
    unseen = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in unseen]) > 0.97
    assert toxicity(docs, labels.limit(0)).count() == len(rows()) and toxicity(none, labels).count() == 0
    assert all(0 <= r.score <= 1 for r in toxicity(docs, labels).collect())


def test_toxicity_reads_a_bounded_sample_of_rows(spark):
    from groundswell.llm.toxicity import train

    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2][:2]
    docs = spark.createDataFrame([(ids[k % 2], f"word{k % 7} other text") for k in range(3000)] + [(None, "no id")], "doc_id long, text string")
    labels = spark.createDataFrame([(ids[0], 0, 1), (ids[0], 0, 1), (ids[1], 1, 0)], "doc_id long, quality int, toxic int")
    assert len(train(docs, labels).chosen) == 0 and toxicity(docs, labels).count() == 3001


def test_license_scan(spark, none):
    notice = "Licensed under the Apache License, Version 2.0."
    body = " ".join(f"w{i}" for i in range(997))
    found = license_scan(spark.createDataFrame([(1, f"{body} {notice} {body}"), (2, body), (3, None), (None, "released under THE MIT licence. Released under the MIT License")], "doc_id long, text string")).collect()
    assert {r.doc_id: list(r.licenses) for r in found} == {1: ["Apache-2.0"], 2: [], 3: [], None: ["MIT"]}
    assert (1 - 0.3) ** samples_needed(0.3, 1e-4) <= 1e-4 and license_scan(none).count() == 0


def test_license_scan_finds_short_notices(spark):
    notices = ["All rights reserved.", "x\nALL RIGHTS RESERVED", "", "all rights", "reserved. All", "rights reserved", "(c) all, rights; reserved! MIT", "all rights are reserved"]
    found = license_scan(spark.createDataFrame(list(enumerate(notices)), "doc_id long, text string").coalesce(1)).collect()
    assert {r.doc_id for r in found if list(r.licenses) == ["All rights reserved"] and r.best == 1} == {0, 1, 6}
    assert all(not r.licenses for r in found if r.doc_id not in (0, 1, 6))
    one = license_scan(spark.createDataFrame([(1, "mit"), (2, "smith")], "doc_id long, text string"), {"one": "MIT"}).collect()
    assert {r.doc_id: list(r.licenses) for r in one} == {1: ["one"], 2: []}


def test_license_scan_against_brute_force(spark):
    from groundswell.llm.license_scan import TEMPLATES, _words

    rng = np.random.default_rng(8)
    filler = [f"w{i}" for i in range(300)]
    texts = []
    for text in TEMPLATES.values():
        w = text.split()
        for drop in (0.0, 0.02, 0.5):
            kept = [x for x in w if rng.random() >= drop]
            texts.append(" ".join([*rng.choice(filler, int(rng.integers(0, 400))), *kept, *rng.choice(filler, int(rng.integers(0, 400)))]))
    grams = lambda t: [tuple(x) for x in np.lib.stride_tricks.sliding_window_view(_words(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0], 5).tolist()] if len(t.split()) >= 5 else []
    docs = spark.createDataFrame([*enumerate(texts), (7, texts[7])], "doc_id long, text string").selectExpr("*", "'clash' AS licenses", "1 AS best")
    got = license_scan(docs).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        held = set(grams(texts[r.doc_id]))
        for name, text in TEMPLATES.items():
            of = set(grams(text))
            if of:  # the filler lies outside, so a template's shingles in the text are those of one window
                share = len(of & held) / len(of)
                assert (name in r.licenses) == (share >= 0.8), (name, share, r.licenses)


def test_words_that_polynomials_confuse(spark):
    """Two words of 1,024 letters, each the other's complement, have one hash under any polynomial modulo 2**64."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    one, two = ("".join("ab"[b ^ k] for b in bits) for k in (0, 1))
    rest = [f"r{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, " ".join([one, *rest[:20]])), (2, " ".join([two, *rest[:20]])), (3, " ".join([one] * 16 + rest)), (4, " ".join([two] * 16 + rest)), (5, one), (6, two)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup(docs).collect()} == {1: 0, 2: 0, 3: 40, 4: 40, 5: 0, 6: 0}
    assert all(r.component_id == r.doc_id for r in near_dedup(docs.where("doc_id > 4"), words=2).collect())
    order = lambda k: " ".join("ab"[b ^ k] for b in bits[:32]) + " " + " ".join(rest[:3])
    lines = spark.createDataFrame([(1, order(0)), (2, order(1))], "doc_id long, text string")
    assert {r.n_removed for r in substring_dedup(lines).collect()} == {0}


def _kneser_ney(texts, order):
    """The probability of a byte after a context, evaluated top down from the definition."""
    line = lambda t: (10, *b" ".join(words(t)), 32) if words(t) else ()
    counts = [None, *[Counter() for _ in range(order)]]
    for t in map(line, texts):
        for e in range(1, len(t)):
            k = min(e + 1, order)
            counts[k][t[e - k + 1 : e + 1]] += 1
    for k in range(order - 1, 0, -1):
        counts[k].update(Counter(g[1:] for g in counts[k + 1]))
    cuts, total, freed = [None], Counter(), Counter()
    for k in range(1, order + 1):
        of = Counter(counts[k].values())
        n = [max(1, of[i]) for i in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1])
        cuts.append([min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.05), i - 0.05) for i in (1, 2, 3)])
        for g, c in counts[k].items():
            total[g[:-1]] += c
            freed[g[:-1]] += cuts[k][min(c, 3) - 1]

    def p(g):
        below = p(g[1:]) if len(g) > 1 else 1 / 256
        if not total[g[:-1]]:
            return below
        c = counts[len(g)][g]
        return ((c - cuts[len(g)][min(c, 3) - 1]) if c else 0) / total[g[:-1]] + freed[g[:-1]] / total[g[:-1]] * below

    def log_p(t):
        s = line(t)
        return sum(math.log(p(s[max(0, e - order + 1) : e + 1])) for e in range(1, len(s)))

    return p, log_p


@pytest.fixture(scope="module")
def prose():
    rng = np.random.default_rng(5)
    stem = "the old man saw a small boat on the calm sea and then went home to his quiet house near the long river".split()
    good = [" ".join(stem[int(i) :] + stem[: int(i)]) for i in rng.integers(0, len(stem), 90)]
    odd = [" ".join(reversed(stem)), "boat boat boat sea sea sea", "", "né boat", good[0], None, "zzz qqq " * 40]
    return [(i, t, "en") for i, t in enumerate(good)], [(100 + i, t, ["en", None][i % 2]) for i, t in enumerate(odd)]


@pytest.mark.parametrize("shard_rows", [4_000_000, 300])
def test_perplexity_is_kneser_neys(spark, prose, none, shard_rows):
    good, odd = prose
    data = [*good, *odd, odd[0], (None, odd[0][1], "en"), (None, odd[0][1], "en")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string").selectExpr("*", "1 AS n_bytes", "2 AS fold", "3 AS key")
    trusted = docs.where("doc_id < 100").select("doc_id")
    got = perplexity_filter(docs, trusted, order=4, shard_rows=shard_rows).collect()
    fold = {r[0]: r[1] for r in trusted.selectExpr("doc_id", "pmod(xxhash64(doc_id, 'fold'), 10) = 0").collect()}
    assert any(fold.values()) and not all(fold.values())
    p, log_p = _kneser_ney([t for i, t, _ in good if not fold[i]], 4)
    for context in [b"", b"t", b"th", b"the", b"\nthe"[:3], b"q", b"zq"]:
        assert math.isclose(sum(p((*context, b)) for b in range(256)), 1)
    want = Counter((i, lang, sum(map(len, words(t))) + len(words(t))) for i, t, lang in data)
    assert want == Counter((r.doc_id, r.lang, r.n_bytes) for r in got)
    text = {i: t for i, t, _ in data}
    score = lambda t: math.exp(-log_p(t) / sum(len(x) + 1 for x in words(t)))
    limit = 1.1 * max(score(t) for i, t, _ in good if fold[i])  # the quantile 0.99 of few is their greatest
    for r in got:
        t = text[r.doc_id]
        assert r.perplexity is None if not words(t) else math.isclose(r.perplexity, score(t), rel_tol=1e-9)
        assert math.isclose(r.threshold, limit, rel_tol=1e-9) and r.kept == bool(words(t) and score(t) <= limit)
    kept = {r.doc_id: r.kept for r in got}
    assert kept[104] and not kept[106] and score(odd[0][1]) > 1.01 * score(good[0][1])
    if shard_rows == 300:
        assert perplexity_filter(none, trusted).count() == 0
        alone = perplexity_filter(docs, trusted.limit(0)).collect()
        assert all(r.kept == bool(words(text[r.doc_id])) for r in alone) and math.isclose(max(r.perplexity or 0 for r in alone), 256)


def test_pipeline_is_its_stages_by_brute_force(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    bad = "idiot loser moron"
    made = [*rows(), *[(1000 + i, f"{texts()[20 + i % 5]} {bad} {i} {bad}", "en", "tox", 0, 7, "clash", False) for i in range(40)]]
    made += [(2000, "twice and again the very same row", "en", "a", 5, 1, "", True)] * 3
    labels = [(i, 1, 0) for i in range(60)] + [(1000 + i, 1, 1) for i in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    source = spark.createDataFrame(made, SCHEMA).repartition(3)
    names, stages = zip(*corpus_pipeline.STAGES, strict=True)
    kept = [source]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept[-1], str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        kept.append(spark.read.parquet(str(tmp_path / name)))
    assert names == ("toxicity", "exact dedup", "near dedup", "mixing", "tokens")
    plain = [Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in x.collect()) for x in kept[:5]]
    assert all(tuple(x.columns) == corpus_pipeline.COLUMNS for x in kept[1:5])
    scores = {(r.doc_id, r.text): r.predicted for r in toxicity(source, spark.read.parquet(str(tmp_path / "labels.parquet")), keep=("doc_id", "text")).collect()}
    assert plain[1] == Counter({k: n for k, n in plain[0].items() if not scores[k[:2]]}) and sum(k[3] == "tox" for k in plain[1]) <= 2
    best = {}
    for k in plain[1]:
        t = k[1] or ""
        best[t] = max(best.get(t, -1), -1 if k[0] is None else k[0])
    want = {((k[0]), k[1] or "") for k in plain[1] if (-1 if k[0] is None else k[0]) == best[k[1] or ""]}
    assert {(k[0], k[1] or "") for k in plain[2]} == want and max(plain[2].values()) == 1 and (2000, "twice and again the very same row") in want
    sets = {}
    for k in plain[2]:
        w = [x.lower() for x in words(k[1])]
        sets[k[0]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up = {i: i for i in sets}
    moved = True
    while moved:
        moved = False
        for a in sets:
            for b in sets:
                if a is not None and b is not None and a < b and up[a] != up[b] and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    low = min(up[a], up[b])
                    up[a] = up[b] = low
                    moved = True
    assert plain[3] == Counter({k: n for k, n in plain[2].items() if k[0] is None or up[k[0]] == k[0]}) and len(plain[3]) < len(plain[2])
    copies = {(r.doc_id, r.text): r.copies for r in mix_sources(kept[3].withColumn("text_", kept[3]["text"]).withColumnRenamed("text_", "t"), carry=("t",)).selectExpr("doc_id", "t AS text", "copies").collect()}
    assert plain[4] == Counter({k: copies[k[:2]] for k in plain[3] if copies[k[:2]]})
    t = Tokenizer.from_file(Q.vocabulary())
    t.no_truncation()
    t.no_padding()
    ids = Counter((k[0], tuple(t.encode(k[1] or "", add_special_tokens=False).ids)) for k, n in plain[4].items() for _ in range(n))
    assert ids == Counter((r.doc_id, tuple(r.token_ids)) for r in kept[5].collect())
    now = none
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        assert now.count() == 0


def _all_pairs(sets, percent):
    return {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}


@pytest.mark.parametrize("percent", [60, 80])
def test_rarest_shingles_lose_no_link(spark, percent):
    """Sets around shared cores, just above and below the similarity, of sizes from one up: each linked pair across components is met."""
    draw, sets = np.random.default_rng(5), {}
    for core in range(6):
        base = [core * 1000 + i for i in range(int(draw.integers(1, 60)))]
        for _ in range(25):
            kept = [x for x in base if draw.random() > 0.08]
            sets[len(sets)] = set(kept) | {10**6 + int(x) for x in draw.integers(0, 10**6, int(draw.integers(0, 7)))} | ({7} if draw.random() < 0.5 else set())
    component = {i: int(draw.integers(0, 9)) for i in sets}
    rows = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()] * 2, "id long, shingles array<long>")
    parts = spark.createDataFrame([*component.items()], "id long, component long")
    met = {tuple(r) for r in _across(_prefixes(rows, percent).join(parts, "id"), percent).collect()}
    linked = {(a, b) for a, b in _all_pairs(sets, percent) if component[a] != component[b]}
    assert linked and linked <= met
    assert all(component[a] != component[b] for a, b in met)


def test_near_dedup_in_crowded_buckets(spark):
    """A crowd whose texts stand just below the similarity to one another, with linked pairs among them."""
    draw = np.random.default_rng(6)
    common = [f"c{i}" for i in range(90)]
    texts = []
    for i in range(120):
        own = common.copy()
        for k in draw.choice(90, int(draw.integers(4, 8)), replace=False):
            own[k] = f"o{i}x{k}"
        texts.append(own)
        if i % 4 == 0:
            near = own.copy()
            near[int(draw.integers(0, 90))] = f"n{i}"
            texts.append(near)
    sets = {i: set(zip(t, t[1:], strict=False)) for i, t in enumerate(texts)}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in _all_pairs(sets, 80):
        x, y = sorted((top(a), top(b)))
        up[y] = x
    got = near_dedup(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"), words=2)
    found = {r.doc_id: r.component_id for r in got.collect()}
    assert found == {i: top(i) for i in sets}
    assert 1 < len(set(found.values())) < len(texts) - 20
