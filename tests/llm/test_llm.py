"""Edge cases, brute-force checks and oracles of the training-data operators."""

import collections
import glob
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from grovegrid.llm import chat_format, components, decontamination, license_scan, lm_scoring, nearest_neighbours, ngram_jaccard, packing, quality_classifier, registry, substring_dedup, subwords, textkernel, url_filter

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(20_000))
EDGE = [(1, None), (2, ""), (3, "one"), (3, "one"), (None, "a b c d e f"), (4, LONG), (5, LONG + " more"), (6, " \t\n"), (7, "A b C d e F"), (8, "a B c d e f")]
SCHEMA = "doc_id long, text string, n string, cls string, key string, keys string, ids string, score string, n_chars long"


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, t, "x", None, "y", "z", "i", "s", None if t is None else len(t)) for i, t in EDGE], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(same, name):
    same(name)


def test_words_and_shingles():
    column = pa.array([t for _, t in EDGE] + ["\x0b\x0cq r", "é Éx", "İ"])
    for _, _, w in textkernel.texts(column):
        for i, t in enumerate(column.to_pylist()):
            got = [textkernel.LOWER[w.data[w.start[j] : w.end[j]]].tobytes().decode() for j in range(w.off[i], w.off[i + 1])]
            assert got == words(t)
        h, off = textkernel.shingle_hashes(w, 3)
        sets = [set(h[off[i] : off[i + 1]].tolist()) for i in range(len(column))]
        for i, t in enumerate(column.to_pylist()):
            x = words(t)
            assert len(sets[i]) == len({tuple(x[j : j + 3]) for j in range(max(1, len(x) - 2))} if x else ())
        assert sets[8] == sets[9] == sets[4]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7), (200, 300), (300, 250)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges + [(None, 1)], "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 200: 200, 250: 200, 300: 200}


def test_jaccard_edges(spark, edge, none):
    rows = collections.Counter(map(tuple, ngram_jaccard.ngram_jaccard(edge, 3, 90, sizes=True).collect()))
    assert rows[(1, 0, 1, 1)] == rows[(2, 0, 2, 1)] == rows[(6, 0, 6, 1)] == 1
    assert rows[(3, 1, 3, 2)] == 2
    assert rows[(None, 4, 7, 3)] == 1 and rows[(7, 4, 7, 3)] == 1 and rows[(8, 4, 7, 3)] == 1
    assert {r[2] for r in rows if r[0] in (4, 5)} == {4}
    assert ngram_jaccard.ngram_jaccard(none).count() == 0


@pytest.mark.parametrize("k,percent", [(5, 80), (3, 90), (2, 60)])
def test_jaccard_brute_force(spark, k, percent):
    rng = np.random.default_rng(k)
    docs = []
    for g in range(12):
        base = [f"t{v}" for v in rng.integers(0, 400, int(rng.integers(6, 120)))]
        for _ in range(int(rng.integers(1, 9))):
            x = list(base)
            for _ in range(int(rng.integers(0, 5))):
                x[int(rng.integers(0, len(x)))] = f"z{rng.integers(0, 9)}"
            docs.append(" ".join(x))
    sets = [{tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} for w in map(words, docs)]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = ngram_jaccard.ngram_jaccard(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), k, percent).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: find(i) for i in range(len(docs))}


def test_sketch_distance_is_a_lower_bound():
    rng = np.random.default_rng(1)
    for n, m in ((10, 3), (600, 80), (3000, 900)):
        a = textkernel.mix(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.concatenate((a[m:], textkernel.mix(rng.integers(0, 2**63, m // 2, dtype=np.uint64))))
        d = len(np.setxor1d(a, b))
        x, y = (ngram_jaccard.fold(np.unique(s)) for s in (a, b))
        rows = [np.frombuffer(s, np.uint8) for s in (x, y)]
        width = min(map(len, rows))
        folded = [np.bitwise_xor.reduce(r.reshape(-1, width), axis=0) for r in rows]
        assert np.bitwise_count(folded[0] ^ folded[1]).sum() <= d


def test_pack_round_trip(spark, edge, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    docs = edge.where("doc_id in (1, 2, 4, 5, 6, 7)").repartition(3)
    rows = packing.pack(docs, TOKENIZER, window=64, open_windows=3).collect()
    texts, got, seqs = dict(EDGE), collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.start, r.ids))
        seqs[r.sequence_id].append((r.offset, r.length))
    for doc, parts in got.items():
        ids, at = [], 0
        for start, raw in sorted(parts):
            assert start == at
            ids += np.frombuffer(raw, "<u4").tolist()
            at = len(ids)
        assert ids == [*tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids, 2]
    for parts in seqs.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 64
    assert sum(1 for p in seqs.values() if sum(n for _, n in p) < 64) <= 1
    assert packing.pack(none, TOKENIZER).count() == 0


def test_fast_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    texts = ["it's WE'LL don't 12,5 %%% a_b", "a<|endoftext|>b <|startoftext|>", "Σας İ e\u0301 x\u00a0y ½²", "Straße ÇA où ÿ×÷", "日本語 テスト \u2028z", "", None, "<| |>", "\x00\x01"]
    for _, hi, ids, off in subwords.text_ids(pa.array(texts), TOKENIZER, 2):
        for i in range(hi):
            assert ids[off[i] : off[i + 1]].tolist() == [*tokenizer.encode(texts[i] or "", add_special_tokens=False).ids, 2]


def test_decontamination_edges(spark, edge, none):
    items = spark.createDataFrame([(1, "A b c D e f"), (2, None), (3, ""), (4, "one"), (5, LONG[:300]), (5, "zz")], "item_id long, text string")
    hits = sorted(map(tuple, decontamination.contained(edge, items).collect()), key=str)
    assert collections.Counter(h[:2] for h in hits) == collections.Counter([(None, 1), (7, 1), (8, 1), (3, 4), (3, 4), (4, 5), (5, 5)])
    assert {h for h in hits if h[1] != 5} == {(None, 1, 2, 2), (7, 1, 2, 2), (8, 1, 2, 2), (3, 4, 1, 1)}
    left = decontamination.decontaminate(edge, items)
    assert left.columns == edge.columns and sorted(r.doc_id for r in left.collect()) == [1, 2, 6]
    assert decontamination.contained(none, items).count() == 0 and decontamination.contained(edge, items.limit(0)).count() == 0


def test_repeated_passages(spark, edge, none):
    rng = np.random.default_rng(3)
    fresh = lambda n: " ".join(f"u{v}" for v in rng.integers(0, 10**9, n))
    shared = fresh(70)
    fuzzy = shared.split()
    fuzzy[30], fuzzy[45] = "changed", "words here"
    docs = [(10, fresh(40) + " " + shared + " " + fresh(30)), (11, fresh(90) + " " + shared.upper()), (12, fresh(20) + "\n" + " ".join(fuzzy) + " " + fresh(9)), (13, fresh(200)), (14, fresh(10) + " " + " ".join(shared.split()[:30]))]
    table = spark.createDataFrame([(i, t, len(t), "k") for i, t in docs], "doc_id long, text string, n_chars long, home_id string")
    got = {r.doc_id: r for r in substring_dedup.repeated_passages(table).collect()}
    assert set(got) == {11, 12} and {r.home_id for r in got.values()} == {10}
    assert (got[11].start_word, got[11].end_word, got[11].n_matched) == (90, 160, 70)
    assert (got[12].start_word, got[12].end_word) == (20, 91) and got[12].n_matched >= 68
    left = {r.doc_id: r for r in substring_dedup.drop_repeats(table).collect()}
    assert set(left) == {10, 11, 12, 13, 14} and left[10].text == docs[0][1] and left[13].text == docs[3][1]
    assert words(left[11].text) == words(docs[1][1])[:90] and left[11].n_chars == len(left[11].text)
    kept = substring_dedup.drop_repeats(edge)
    assert kept.columns == edge.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 3, 3, None, 4, 5, 6, 7, 8], key=str)
    assert substring_dedup.drop_repeats(none).count() == 0


def some_words(seed, n):
    return [f"v{x}" for x in np.random.default_rng(seed).integers(0, 10**9, n)]


@pytest.mark.parametrize("apart", [35, 40])
@pytest.mark.parametrize("which", ["both", "home", "mine"])
def test_two_passages_near_each_other(spark, apart, which):
    p, q = some_words(1, 55), some_words(2, 55)
    home = some_words(3, 30) + p + some_words(4, apart if which != "mine" else 0) + q + some_words(5, 30)
    mine = some_words(6, 20) + p + some_words(7, apart if which != "home" else 0) + q + some_words(8, 20)
    table = spark.createDataFrame([(1, " ".join(home)), (2, " ".join(mine))], "doc_id long, text string")
    got = sorted((r.start_word, r.end_word, r.n_matched) for r in substring_dedup.repeated_passages(table).collect())
    second = 20 + 55 + (apart if which != "home" else 0)
    assert got == [(20, 75, 55), (second, second + 55, 55)]


def test_chains_beat_all_subsets():
    rng = np.random.default_rng(4)
    for _ in range(40):
        runs = np.unique(np.stack((rng.integers(0, 60, 7), rng.integers(0, 60, 7), rng.integers(3, 9, 7)), axis=1), axis=0)

        def score(c):
            total = sum(n for *_, n in c)
            for (x, y, n), (p, q, _) in zip(c, c[1:], strict=False):
                if p < x + n or q < y + n:
                    return -1
                total -= substring_dedup.GAP * (p - x - n + q - y - n)
            return total

        rows = sorted(map(tuple, runs.tolist()))
        best = max(score([r for j, r in enumerate(rows) if i >> j & 1]) for i in range(1, 1 << len(rows)))
        assert abs(score(substring_dedup.chains(runs.tolist())[0]) - best) < 1e-9


def test_chain_after_a_long_run():
    fuzzy = [(400 + 12 * i, 400 + 12 * i, 10) for i in range(6)]
    found = substring_dedup.chains([(0, 0, 300), *fuzzy])
    assert found == [[(0, 0, 300)], fuzzy]
    rng = np.random.default_rng(5)
    for _ in range(40):
        runs = np.unique(np.stack((rng.integers(0, 300, 40), rng.integers(0, 300, 40), rng.integers(3, 60, 40)), axis=1), axis=0)
        rows = sorted(map(tuple, runs.tolist()))
        best = []
        for i, (x, y, n) in enumerate(rows):
            before = [(x - p - m, y - q - m, b) for (p, q, m), b in zip(rows[:i], best, strict=True)]
            best.append(n + max([0, *(b - substring_dedup.GAP * (u + v) for u, v, b in before if 0 <= u <= substring_dedup.WIDEST and 0 <= v <= substring_dedup.WIDEST)]))
        chain = substring_dedup.chains(runs.tolist())[0]
        got = sum(n for *_, n in chain) - sum(substring_dedup.GAP * (p - x - n + q - y - n) for (x, y, n), (p, q, _) in zip(chain, chain[1:], strict=False))
        assert abs(got - max(best)) < 1e-9


def test_passage_whose_halves_stand_in_lower_documents(spark):
    for seed in range(20, 60, 10):
        p, q = some_words(seed, 40), some_words(seed + 1, 40)
        docs = {5: p, 6: q, 10: p + q, 20: p + q}
        table = spark.createDataFrame([(i, " ".join(some_words(seed + i, 30) + w + some_words(seed * i, 30))) for i, w in docs.items()], "doc_id long, text string").coalesce(1)
        assert [(r.doc_id, r.home_id, r.start_word, r.end_word, r.n_matched) for r in substring_dedup.repeated_passages(table).collect()] == [(20, 10, 30, 110, 80)]


def found_by_seeds(mine, home, k=6, window=5):
    """The passages of two texts, without Spark."""
    sides = []
    for text in (mine, home):
        [(_, _, w)] = textkernel.texts(pa.array([" ".join(text)]))
        h = textkernel.shingle_hashes(w, k)[0]
        sides.append((w.hash.tolist(), {h[i]: i for i in substring_dedup.minimizers(h, window)}))
    (a, x), (b, y) = sides
    m = np.array([(x[h], y[h]) for h in x if h in y]).reshape(-1, 2)
    one = np.zeros(len(m), np.int64)
    m = m[substring_dedup.promising(m[:, 0], one, one, k, 50)] if len(m) else m
    found = substring_dedup.document_chains([(0, substring_dedup.runs_of(m[:, 0], m[:, 1], k)[:, 1:].tolist())], 50, 80) if len(m) else []
    return [r for _, cs in found for c in cs for r in substring_dedup.aligned(a, b, c, 50, 80)]


@pytest.mark.parametrize(("n", "percent", "least"), [(52, 90, 0.93), (60, 95, 0.99), (60, 90, 0.99), (60, 85, 0.98), (80, 85, 0.98), (60, 80, 0.92), (80, 80, 0.97)])
def test_recall_of_changed_passages(n, percent, least):
    rng, got = np.random.default_rng(6), []
    for _ in range(100):
        base, around = rng.integers(0, 10**9, n), rng.integers(0, 10**9, (2, 2, 60))
        mine, odd = base.copy(), rng.choice(n, n * (100 - percent) // 100, replace=False)
        mine[odd] = rng.integers(0, 10**9, len(odd))
        same = np.setdiff1d(np.arange(n), odd)
        span = same[-1] - same[0] + 1
        if span >= 50 and 100 * len(same) >= 80 * span:
            got.append(bool(found_by_seeds(*(list(map(str, (*s[0], *w, *s[1]))) for s, w in zip(around, (mine, base), strict=True)))))
    assert len(got) > 50 and np.mean(got) >= least


def passages_of(spark, docs, parts=3):
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    return sorted((r.doc_id, r.home_id, r.start_word, r.end_word, r.n_matched) for r in substring_dedup.repeated_passages(table).collect())


def test_passage_beside_a_lower_piece_of_it(spark):
    p = some_words(70, 60)
    docs = {10: p, 20: p, 1: p[:40]}
    rows = [(i, " ".join(some_words(71 + i, 30) + w + some_words(171 + i, 30))) for i, w in docs.items()]
    assert passages_of(spark, rows) == [(20, 10, 30, 90, 60)]
    # overlapping pieces in lower documents cover all its seeds
    docs = {1: p[:40], 2: p[20:], 10: p, 20: p}
    rows = [(i, " ".join(some_words(81 + i, 30) + w + some_words(181 + i, 30))) for i, w in docs.items()]
    assert passages_of(spark, rows) == [(20, 10, 30, 90, 60)]


def test_fuzzy_passage_after_a_long_run(spark):
    long, fuzzy = some_words(90, 500), some_words(91, 68)
    changed = list(fuzzy)
    for i in range(4, 68, 9):
        changed[i] = f"odd{i}"
    between = some_words(92, 60), some_words(93, 60)
    got = passages_of(spark, [(1, " ".join(long + between[0] + fuzzy)), (2, " ".join(long + between[1] + changed))])
    assert [(a, b, x, y) for a, b, x, y, _ in got][0] == (2, 1, 0, 500) and got[1][2] >= 555 and got[1][3] - got[1][2] >= 58


def test_cuts_of_texts_under_one_id(spark):
    p, other = " ".join(some_words(95, 60)), " ".join(some_words(96, 150))
    table = spark.createDataFrame([(10, p), (20, "x " + p + " y"), (20, other)], "doc_id long, text string")
    assert sorted(r.text for r in substring_dedup.drop_repeats(table).collect()) == sorted([p, "x  y", other])


def test_frequent_passages_and_copies(spark):
    """A passage that most documents hold, many copies of one document, and batches that cut seeds apart."""
    p, copy = some_words(97, 55), some_words(98, 120)
    rows = [(i, " ".join(some_words(1000 + i, 15) + p + some_words(3000 + i, 15))) for i in range(0, 400, 2)] + [(i, " ".join(copy)) for i in range(1, 400, 2)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        got = passages_of(spark, rows, 2)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    spans = {d: (x, y) for d, h, x, y, _ in got if h < d}
    assert spans == {i: (15, 70) if i % 2 == 0 else (0, 120) for i in range(2, 400)}


def test_passages_against_all_pairs(spark):
    """Planted exact and fuzzy repeats in 200 documents, against the alignment of all pairs through every shared 4-word run."""
    rng, docs, planted = np.random.default_rng(12), [], set()
    pool = [some_words(500 + i, int(rng.integers(50, 90))) for i in range(25)]
    common = some_words(499, 20)
    for i in range(200):
        words_ = some_words(2000 + i, int(rng.integers(20, 60)))
        for j in rng.choice(25, int(rng.integers(0, 3)), replace=False):
            part = list(pool[j])
            for c in rng.choice(len(part), int(rng.integers(0, len(part) // 9)), replace=False):
                part[c] = f"odd{rng.integers(10**9)}"
            words_ += part + some_words(9000 + 40 * i + int(j), int(rng.integers(10, 50)))
        docs.append(words_ + (common if i % 3 else []))
    hashes = [[hash(w) for w in d] for d in docs]
    want = set()
    for i, mine in enumerate(hashes):
        at = {}
        for x in range(len(mine) - 3):
            at.setdefault(tuple(mine[x : x + 4]), x)
        for j in range(i):
            m = [(at[g], y) for y in range(len(hashes[j]) - 3) if (g := tuple(hashes[j][y : y + 4])) in at]
            if m:
                m = np.array(m)
                for c in substring_dedup.chains(substring_dedup.runs_of(m[:, 0], m[:, 1], 4)[:, 1:].tolist()):
                    want |= {(i, (x0 + x1) // 2) for x0, x1, *_ in substring_dedup.aligned(mine, hashes[j], c, 50, 80)}
    got = collections.defaultdict(list)
    for d, _, x, y, n in passages_of(spark, [(i, " ".join(d)) for i, d in enumerate(docs)]):
        assert y - x >= 50 and 100 * n >= 80 * (y - x)
        got[d].append((x, y))
    hit = sum(any(x <= mid < y for x, y in got[d]) for d, mid in want)
    assert len(want) > 100 and hit >= 0.97 * len(want), (hit, len(want))


def test_quality(spark, edge, none, data):
    docs, labels = spark.read.parquet(data.replace("sf0.001", "sf0.01") + "/documents.parquet"), spark.read.parquet(data.replace("sf0.001", "sf0.01") + "/labels.parquet")
    rows = quality_classifier.score_quality(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (rows.predicted == rows.quality).mean() > 0.93 and rows.score.between(0, 1).all()
    few = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, 1), (3, 0), (4, None)], "doc_id long, quality int")
    assert quality_classifier.score_quality(edge, few).count() == len(EDGE)
    assert quality_classifier.keep_quality(edge, few.limit(0)).count() == len(EDGE)
    assert quality_classifier.score_quality(none, few).count() == 0


def test_language_model(spark, edge, none):
    rng = np.random.default_rng(0)
    docs = [(i, " ".join(rng.choice(["the cat", "sat on", "a mat.", "Then", "it's gone"], int(rng.integers(0, 60))))) for i in range(60)] + [(60, None)]
    got = lm_scoring.score_documents(spark.createDataFrame(docs, "doc_id long, text string"), TOKENIZER, most_words=3).toPandas().set_index("doc_id")
    count = collections.Counter()
    for i, t in docs:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            count.update([*words(t), None])
    n, v = sum(count.values()), len(count)
    for i, t in docs:
        w = [*words(t), None]
        assert got.base_score[i] == pytest.approx(sum(np.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        assert (got.n_tokens[i], got.n_known[i], got.train_tokens[i]) == (len(w), sum(count[x] > 0 for x in w), n)
    assert (got.score < 0).all()
    assert lm_scoring.score_documents(edge, TOKENIZER).count() == len(EDGE)
    assert lm_scoring.score_documents(none, TOKENIZER).count() == 0


def test_language_model_sums_to_one_and_windows():
    sample = np.random.default_rng(2).integers(0, 50, (40, lm_scoring.WINDOW + 1))
    model = lm_scoring.AttentionModel(np.bincount(sample.ravel(), minlength=60), np.arange(60) % 2)
    pairs = np.zeros((lm_scoring.KEPT + 2, lm_scoring.KEPT + 1), np.int64)
    np.add.at(pairs, (model.slot[sample[:, :-1]].ravel(), model.slot[sample[:, 1:]].ravel()), 1)
    model.set_counts(np.bincount(sample.ravel(), minlength=60), pairs)
    model.fit(sample, epochs=1)
    head = sample[0, :9]
    texts = [np.append(head, i) for i in range(60)]
    whole = model.log10(np.concatenate(texts), np.arange(61) * 10)
    assert (10 ** (whole - model.log10(head, np.array([0, 9])))).sum() == pytest.approx(1, abs=1e-3)
    for n in (1, 31, 32, 33, 56, 57, 200):
        places = [a + p for a, first in lm_scoring.windows(n) for p in range(first, lm_scoring.WINDOW) if a + p < n]
        assert places == list(range(n))


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((900, 10)).astype(np.float32)
    x[5] = x[7] = x[3]
    rows = [(i, [float(v) for v in r], "a", 1.0) for i, r in enumerate(x)]
    bad = [(1000, None, "", 0.0), (1001, [0.0] * 10, "", 0.0), (1002, [float("nan")] + [1.0] * 9, "", 0.0), (1003, [None] + [1.0] * 9, "", 0.0), (1004, [1.0], "", 0.0), (1005, [float("inf")] * 10, "", 0.0), (None, [9.0] * 10, "", 0.0), rows[8]]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, v string, score double")
    got = nearest_neighbours.nearest(table, table.where("vec_id % 20 = 0"), top=20).toPandas()
    found = 0
    for q in range(0, 900, 20):
        s = x.astype(np.float64) @ x[q].astype(np.float64)
        s[q] = -np.inf
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21))
        assert np.allclose(mine.score, s[mine.vec_id])
        assert mine.sort_values(["score", "vec_id"], ascending=[False, True]).vec_id.tolist() == mine.vec_id.tolist()
        found += len(set(np.lexsort((np.arange(900), -s))[:20]) & set(mine.vec_id))
    assert found >= 0.9 * 45 * 20


@pytest.mark.parametrize("block", [4096, 500])
def test_recall_with_a_twentieth_ranked_exactly(spark, data, monkeypatch, block):
    """On all of sf0.1 (2,000 vectors), in one block and in several; at most 5 % of a block's rows, or 2 * top, are ranked exactly."""
    monkeypatch.setattr(nearest_neighbours, "BLOCK", block)
    monkeypatch.setattr(nearest_neighbours, "GROUP", 2)
    table = spark.read.parquet(data.replace("sf0.001", "sf0.1") + "/embeddings.parquet")
    rows = table.toPandas()
    x, ids = np.stack(rows.embedding).astype(np.float64), rows.vec_id.to_numpy()
    got = nearest_neighbours.nearest(table, table.where("vec_id % 20 = 0")).toPandas().groupby("query_id").vec_id.agg(set)
    found = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        found += len(set(ids[np.lexsort((ids, -s))[:20]]) & got[ids[q]])
    assert len(got) == (ids % 20 == 0).sum() and found >= 0.95 * 20 * len(got)


def test_neighbours_hold_one_group_of_blocks(spark, monkeypatch):
    """Queries are repeated for each group: they are never broadcast, and what is found for a chunk is merged over a group's blocks."""
    N, seen = nearest_neighbours, {}

    def spy(df, name, *a, write=N.materialize, **b):
        seen[name] = (df._jdf.queryExecution().executedPlan().toString(), out := write(df, name, *a, **b))
        if name == "index":
            seen["files"] = [pq.ParquetFile(p) for p in glob.glob(f"{out._grovegrid_path.removeprefix('file://')}/*.parquet")]
        return out

    monkeypatch.setattr(N, "materialize", spy)
    for name, value in (("BLOCK", 50), ("CHUNK", 4), ("GROUP", 18), ("GROUPS", 1), ("ROW_GROUP", 8192)):
        monkeypatch.setattr(N, name, value, raising=False)
    x = np.random.default_rng(5).standard_normal((900, 10))
    table = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>").coalesce(1)
    got = N.nearest(table, table.where("vec_id % 20 = 0"), top=20)
    assert got.count() == 45 * 20
    plan, found = seen["found"]
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    # 12 chunks and 18 blocks in one group; chunks of which more than 8 are held are given out, and one of them may go on
    assert found.count() <= 45 * 20 * 1.5
    assert [f.metadata.num_row_groups > 3 for f in seen["files"]] == [True]


def test_neighbour_edges(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((900, 10)).astype(np.float32)
    x[5] = x[7] = x[3]
    rows = [(i, [float(v) for v in r], "a", 1.0) for i, r in enumerate(x)]
    table = spark.createDataFrame([*rows, (1000, None, "", 0.0)], "vec_id long, embedding array<float>, v string, score double")
    wide = spark.createDataFrame([(1, [1.0 + 2**-40, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.0]), (3, [2.0, 0.0])], "vec_id long, embedding array<double>")
    got = [(r.query_id, r.vec_id, r.score) for r in nearest_neighbours.nearest(wide, wide.where("vec_id = 2")).orderBy("rank").collect()]
    assert got == [(2, 3, 2.0), (2, 1, 1.0 + 2**-40), (2, 3, 0.5)]
    assert nearest_neighbours.nearest(table.limit(0), table).count() == 0
    few = table.where("vec_id < 4")
    assert nearest_neighbours.nearest(few, few.where("vec_id = 0")).count() == 3


def test_urls(spark):
    urls = [None, "", "no scheme", "http://COM/x", "http://a.b.com", "http://a.example.com/en/x?y", "http://www.Example.com/en/", "x://net/es/#f", "http://b.net/fr/1", "http://c.net/en/", "http://spam-farm.example.org/a", "http://notspam-farm.example.org/a", "http://x.spam-farm.example.org?q=/", "http://evilcom/", "a\n://m.net/fr/"]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)] + [(1, "", "h", "r")], "page_id long, url string, host string, rule string")
    listed = spark.createDataFrame([(x,) for x in url_filter.LISTED] + [(None,)], "host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(pages, url_filter.RULES, listed).collect()}
    a, b = "allow", "block"
    assert [got[i] for i in range(len(urls))] == [
        ("", "", None, a), ("", "", None, a), ("", "", None, a), ("com", "/x", "com/", a), ("a.b.com", "", None, a), ("a.example.com", "/en/x", "example.com/en/", b), ("www.example.com", "/en/", "www.example.com/en/", a),
        ("net", "/es/", "net/es/", b), ("b.net", "/fr/1", "net/fr/", b), ("c.net", "/en/", None, a), ("spam-farm.example.org", "/a", None, b), ("notspam-farm.example.org", "/a", None, a), ("x.spam-farm.example.org", "", None, b),
        ("evilcom", "/", None, a), ("m.net", "/fr/", "net/fr/", b)]
    assert url_filter.url_filter(pages.limit(0), url_filter.RULES, listed).count() == 0
    assert {r.verdict for r in url_filter.url_filter(pages, [], listed.limit(0)).collect()} == {a}


def test_cascade_is_exact(spark):
    universe = spark.range(3000).selectExpr("concat('k', id) AS key")
    listed = spark.range(0, 3000, 7).selectExpr("concat('k', id) AS key")
    cascade = url_filter.Cascade(listed, universe, 3000)
    got = universe.withColumn("in", cascade.has(F.col("key"))).where("in").select("key")
    assert len(cascade.levels) > 1 and sorted(got.collect()) == sorted(listed.collect())


def test_chat_edges(spark):
    log = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (3, 5, "user", "a"), (3, 6, "assistant", "b"), (3, 7, "user", None), (4, 0, "user", "ab"), (None, 0, "user", "z"), (5, None, None, None), (6, 0, "user", "a"), (6, 1, "assistant", "b"), (6, 2, "user", "")]
    table = spark.createDataFrame([(*r, "x") for r in log], "conv_id long, turn long, role string, text string, pos string")
    got = {r.conv_id: (r.n_turns, r.n_copies) for r in chat_format.maximal_conversations(table).collect()}
    assert got == {3: (3, 2), 4: (1, 1), 5: (1, 1)}
    text = {r.conv_id: r.text for r in chat_format.render(table, chat_format.maximal_conversations(table)).collect()}
    assert text[3] == "<|user|>\na\n<|end|>\n<|assistant|>\nb\n<|end|>\n<|user|>\n\n<|end|>\n"
    assert chat_format.maximal_conversations(table.limit(0)).count() == 0


def test_wrapped_licenses(spark):
    mit = "/*\n * Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and associated documentation files (the \"Software\"), to deal\n * in the Software without restriction, including without limitation the rights\n */\nint x;"
    mpl = "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy of the MPL was not distributed with this\n// file, You can obtain one.\n"
    gpl = "# This program is free software; you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation; either version 2 of the License, or\n# (at your option) any later version.\n"
    apache = "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n"
    gpl2 = "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n Copyright (C) 1989, 1991 Free Software Foundation, Inc.\n"
    files = [(1, "a/mit.c", mit), (2, "a/mpl.js", mpl), (3, "a/gpl.py", gpl), (4, "b/LICENSE", apache), (5, "b/c/x.c", "nothing"), (6, "d/COPYING", gpl2), (7, "d/e/y.c", "nothing"), (8, "f/prose.txt", "the driver lost a license\nwhile walking to the public\nlibrary under the bridge")]
    files += [(100 + i, f"z/{i}.txt", f"plain words number {i} of the version with a public text") for i in range(200)]
    table = spark.createDataFrame(files, "id long, path string, text string").coalesce(1)
    got = {r.id: (r.license, r.origin) for r in license_scan.scan_licenses(table).collect()}
    want = ["MIT", "MPL-2.0", "GPL-2.0", "Apache-2.0", "Apache-2.0", "GPL-2.0", "GPL-2.0", None]
    assert [got[i][0] for i in range(1, 9)] == want and got[5][1] == got[7][1] == "inherited"


def test_best_stretches_are_the_best_of_all():
    """The bounds leave out nothing: every line and stretch of every text against every template, one by one."""
    rng = np.random.default_rng(2)
    t = license_scan.Templates()
    t.weigh(1000, rng.integers(0, 900, len(t.known)))
    rows = []
    for n in (1, 4, 30, 120, 400, 7, 60):
        terms = np.where(rng.random(n) < 0.5, rng.choice(t.known, n), rng.integers(1, 2**63, n).astype(np.uint64))
        some = t.terms[int(rng.integers(len(t.terms)))][: n // 2 + 1]
        terms[: len(some)] = some
        rows.append((terms, np.cumsum(rng.random(n) < 0.1)))
    text = np.repeat(np.arange(len(rows)), [len(x) for x, _ in rows])
    got = t.best(np.concatenate([x for x, _ in rows]), text, np.concatenate([y for _, y in rows]), len(rows), 0.3)
    for (terms, line), (c, k) in zip(rows, got, strict=True):
        every = []
        for j, mine in enumerate(t.terms):
            m = min(len(mine), len(terms))
            every += [t.cosine(j, terms[i : i + m]) for i in range(len(terms) - m + 1)] + [t.cosine(j, terms[line == x]) for x in np.unique(line)]
        assert abs(c - (max(every) if max(every) >= 0.3 else 0.0)) < 1e-9 and (k >= 0) == (max(every) >= 0.3)


def plain_licenses(files, least=0.7):
    """Licences of (id, path, text), worked out file by file with dictionaries."""
    import math

    def terms(text):
        found = ("".join(c for c in w if not (33 <= ord(c) < 127 and not c.isalnum())) for w in words(text))
        return [w for w in found if w]

    templates = [(n, collections.Counter(terms(x)), len(terms(x))) for n, x in license_scan.TEMPLATES]
    known = {w for _, x, _ in templates for w in x}
    held = collections.Counter(w for _, _, x in files for w in set(terms(x)) & known)
    weight = lambda w: math.log((len(files) + 1) / (held[w] + 0.5))
    length = lambda c: math.sqrt(sum((n * weight(w)) ** 2 for w, n in c.items()))
    own = {}
    for i, _, text in files:
        whole, best = terms(text), (0.0, None)
        lines = [terms(x) for x in (text or "").split("\n")]
        for name, t, n in templates:
            m = min(n, len(whole))
            for part in [*lines, *(whole[j : j + m] for j in range(len(whole) - m + 1))]:
                c = collections.Counter(part)
                if c and (cosine := sum(x * weight(w) ** 2 * t[w] for w, x in c.items()) / length(c) / length(t)) > best[0] + 1e-12:
                    best = (cosine, name)
        own[i] = best if best[0] >= least else (None, None)
    given = {}
    for i, path, _ in files:
        if path and own[i][1] and re.match(license_scan.FILE_NAME, path.split("/")[-1]):
            folder = path.rpartition("/")[0]
            given[folder] = min(given.get(folder, (9, "", "")), (-own[i][0], path, own[i][1]))
    out = {}
    for i, path, _ in files:
        name, folder = own[i][1], (path or "").rpartition("/")[0]
        while name is None and path and folder not in given and folder:
            folder = folder.rpartition("/")[0]
        out[i] = name or (given[folder][2] if path and folder in given else None)
    return out, own


def test_licenses_against_plain_python(spark, data):
    import textwrap

    wrap = lambda x, lead="": "\n".join(lead + y for y in textwrap.wrap(x, 72))
    mit = [x for n, x in license_scan.TEMPLATES if n == "MIT"][-1]
    bsd = [x for n, x in license_scan.TEMPLATES if n == "BSD-3-Clause"][-1]
    apache = [x for n, x in license_scan.TEMPLATES if n == "Apache-2.0"]
    gpl = [x for n, x in license_scan.TEMPLATES if n == "GPL-3.0"][-1]
    copyright_ = "Copyright (c) 2021 Some Body and others"
    files = [(1, "mit/LICENSE", f"MIT License\n\n{copyright_}\n\n" + wrap(mit.removeprefix("MIT License "))), (2, "mit/src/a.c", "int main;"), (3, "bsd/COPYING", copyright_ + "\nAll rights reserved.\n\n" + wrap(bsd)), (4, "bsd/x/y/z.py", None),
             (5, "apache/LICENSE.txt", wrap(apache[-1], "   ") + "\n\n" + wrap(" ".join(some_words(3, 900)))), (6, "apache/a.go", "// " + copyright_ + "\n" + wrap(apache[-2], "// ") + "\n\npackage a"), (7, "gpl/COPYING", wrap(gpl, "    ") + "\n" + wrap(" ".join(some_words(4, 3000)))),
             (8, "gpl/deep/down/b.rs", "fn"), (9, "", "x"), (10, None, wrap(mit)), (11, "gpl/COPYING", "nothing here"), (12, "two/LICENSE", wrap(mit)), (13, "two/COPYING", wrap(mit)), (14, "two/c", "")]
    docs = spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").select("doc_id", "text").toPandas()
    files += [(100 + i, f"docs/{i % 7}/{i}.txt", x) for i, x in zip(docs.doc_id.tolist(), docs.text.tolist(), strict=True) if len(x or "") < 3000]
    got = {r.id: r for r in license_scan.scan_licenses(spark.createDataFrame(files, "id long, path string, text string").repartition(3)).collect()}
    want, own = plain_licenses(files)
    assert {i: r.license for i, r in got.items()} == want
    assert all((r.similarity is None) == (own[i][1] is None) and (r.similarity is None or abs(r.similarity - own[i][0]) < 1e-6) for i, r in got.items())
    assert [want[i] for i in range(1, 11)] == ["MIT", "MIT", "BSD-3-Clause", "BSD-3-Clause", "Apache-2.0", "Apache-2.0", "GPL-3.0", "GPL-3.0", None, "MIT"]
    assert got[14].license_path == "two/COPYING"


def test_licenses(spark):
    files = [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x.c", "nothing"), (3, "a/b/c/LICENSE.txt", "x\nLicensed under CC BY-NC 4.0.\ny"), (4, "a/b/c/d/y.c", None), (5, "z/y.c", ""), (6, None, "This work is licensed under the GNU General Public License, version 3."), (7, "a/b/c/d/e.c", "intro text\n# Licensed under the Apache License, Version 2.0."), (8, "z/prose.txt", "the driver lost a license while walking with many other words around it in a long line"), (2, "a/b/x.c", "nothing")]
    table = spark.createDataFrame([(*f, "q") for f in files], "id long, path string, text string, license string")
    got = {r.id: (r.license, r.origin, r.license_path) for r in license_scan.scan_licenses(table).collect()}
    assert got == {1: ("MIT", "own", "a/LICENSE"), 2: ("MIT", "inherited", "a/LICENSE"), 3: ("CC-BY-NC-4.0", "own", "a/b/c/LICENSE.txt"), 4: ("CC-BY-NC-4.0", "inherited", "a/b/c/LICENSE.txt"), 5: (None, None, None), 6: ("GPL-3.0", "own", None), 7: ("Apache-2.0", "own", "a/b/c/d/e.c"), 8: (None, None, None)}
    assert license_scan.scan_licenses(table.limit(0)).count() == 0


def test_pipeline(spark, data, edge):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "passages", "contamination", "packing"]
    first = corpus_pipeline.STAGES[0][1](spark, docs, data)
    assert first.columns == docs.columns and 0 < first.count() <= docs.count()
    near = corpus_pipeline.STAGES[1][1](spark, edge, data)
    # one row of equal rows under an id, and none of a null id beside its equals
    assert sorted(r.doc_id for r in near.collect()) == [1, 2, 3, 4, 6, 7]
    odd = spark.createDataFrame([(5, "a b c d e f g"), (5, "q r s t u v w"), (2, "Q r s t u v w"), (None, "n n n"), (None, "n n n"), (9, None), (9, "")], "doc_id long, text string")
    left = sorted(((r.doc_id, r.text) for r in corpus_pipeline.STAGES[1][1](spark, odd, data).collect()), key=str)
    assert left == sorted([(5, "a b c d e f g"), (2, "Q r s t u v w"), (None, "n n n"), (9, None), (9, "")], key=str)
    assert corpus_pipeline.run(spark, data).count() > 0


def test_jaccard_keys_are_linear_and_lose_no_link():
    from grovegrid.llm import ngram_jaccard as J

    rng = np.random.default_rng(11)
    draw = lambda n: rng.integers(0, 2**64 - 1, n, dtype=np.uint64)
    for percent in (80, 90):
        for n in (1000, 20_000):
            assert len(J.block_keys(np.unique(draw(n)), percent)) < n
        for _ in range(300):
            n = int(rng.integers(1, 300))
            gone, more = int(rng.integers(0, n // 5 + 1)), int(rng.integers(0, n // 8 + 1))
            a = draw(n)
            b = np.concatenate((a[gone:], draw(more)))
            if 100 * (n - gone) >= percent * (n + more):
                assert len(np.intersect1d(J.block_keys(np.unique(a), percent), J.block_keys(np.unique(b), percent)))


def test_near_pairs_of_a_large_group_are_emitted_in_parts():
    from grovegrid.llm import ngram_jaccard as J

    rng = np.random.default_rng(12)
    base = np.unique(rng.integers(0, 2**64 - 1, 300, dtype=np.uint64))
    sets = [np.unique(np.append(base, rng.integers(0, 2**64 - 1, 2, dtype=np.uint64))) for _ in range(700)]
    cols = [["g"] * 700, list(range(700)), [len(s) for s in sets], [i // 2 for i in range(700)], [J.fold(s) for s in sets]]
    table = pa.table(dict(zip(("grp", "cid", "n", "root", "sketch"), cols, strict=True)))
    # all are near; pairs of one root are left out
    out = list(J._candidates(80, True)(iter(table.to_batches(max_chunksize=97))))
    got = pa.Table.from_batches(out).to_pydict()
    assert sorted(zip(got["a"], got["b"], strict=True)) == [(i, j) for i in range(700) for j in range(i + 1, 700) if i // 2 != j // 2] and set(got["grp"]) == {"g"}
    assert max(b.num_rows for b in out) < 1.1 * 2**16
    tree = pa.Table.from_batches(list(J._candidates(80, False)(iter(table.to_batches(max_chunksize=97)))))
    assert tree.num_rows == 349


def test_language_model_scores_equal_the_forward_pass():
    rng = np.random.default_rng(8)
    sample = rng.integers(0, 90, (64, lm_scoring.WINDOW + 1))
    model = lm_scoring.AttentionModel(np.bincount(sample.ravel(), minlength=100), np.arange(100) % 2)
    pairs = np.zeros((lm_scoring.KEPT + 2, lm_scoring.KEPT + 1), np.int64)
    np.add.at(pairs, (model.slot[sample[:, :-1]].ravel(), model.slot[sample[:, 1:]].ravel()), 1)
    model.set_counts(np.bincount(sample.ravel(), minlength=100), pairs)
    model.fit(sample, epochs=2)
    off = np.array([0, 1, 32, 65, 200])
    ids = rng.integers(0, 100, 200)
    got = model.log10(ids, off)
    for i in range(4):
        mine, total = ids[off[i] : off[i + 1]], 0.0
        seq = np.concatenate(([-2], mine, np.full(lm_scoring.WINDOW, -1)))
        for a, first in lm_scoring.windows(len(mine)):
            inputs, before = model._shifted(seq[None, a : a + lm_scoring.WINDOW])
            z = model._forward(inputs, before)[-1][0]
            for p in range(first, min(lm_scoring.WINDOW, len(mine) - a)):
                t, b = mine[a + p], before[0, p]
                total += np.log(z[p, model.to_class[t]]) + model.inner[b, model.slot[t]] + model.single[t] - model.prior[b, model.to_class[t]]
        assert got[i] == pytest.approx(total / np.log(10), rel=1e-4)


def test_language_model_gradient_is_that_of_the_forward_pass():
    rng = np.random.default_rng(9)
    sample = np.minimum(rng.zipf(1.2, (50, lm_scoring.WINDOW + 1)), 400) - 1
    sample[::3, 0], sample[::4, 20:], sample[5, 1:] = -2, -1, -1
    model = lm_scoring.AttentionModel(np.bincount(sample[sample >= 0], minlength=400), np.arange(400) % 2)
    before, after = sample[:, :-1], sample[:, 1:]
    pairs = np.zeros((lm_scoring.KEPT + 2, lm_scoring.KEPT + 1), np.int64)
    known = after >= 0
    np.add.at(pairs, (np.where(before == -2, model.begin, model.slot[before])[known], model.slot[after[known]]), 1)
    model.set_counts(np.bincount(sample[sample >= 0], minlength=400), pairs)
    inputs, slots = model._shifted(before)
    wanted = np.where(known, model.to_class[np.maximum(after, 0)], -1)

    def loss(p):
        model.p = p
        z = model._forward(inputs, slots)[-1]
        return -np.log(np.take_along_axis(z, np.maximum(wanted, 0)[..., None], 2)[..., 0][known]).mean()

    small = model.fit(sample).p
    # With large weights neither softmax can go without its maximum taken off.
    for p in (small, {n: w * np.float32({"g": 100, "o": 100, "q": 60}.get(n, 1)) for n, w in small.items()}):
        g = {n: np.full_like(w, 7) for n, w in p.items()}
        model.p = p
        assert model._far() == (p is not small)
        model.gradient(inputs.astype(np.uint16), wanted.astype(np.int16), model._shares(), g)
        wide = {n: w.astype(float) for n, w in p.items()}
        for n, w in wide.items():
            along = rng.standard_normal(w.shape)
            slope = (loss(wide | {n: w + 1e-5 * along}) - loss(wide | {n: w - 1e-5 * along})) / 2e-5
            assert abs(slope - (g[n] * along).sum()) < 5e-3 * np.linalg.norm(g[n]) + 1e-5, n
    model.p = small
    model.gradient(inputs[5:6].astype(np.uint16), wanted[5:6].astype(np.int16), model._shares(), g)
    assert not any(x.any() for x in g.values())


def test_language_model_scores_what_hardly_ever_follows():
    model = lm_scoring.AttentionModel(np.arange(400), np.arange(400) % 2)
    pairs = np.ones((lm_scoring.KEPT + 2, lm_scoring.KEPT + 1), np.int64)
    pairs[0] = 0
    pairs[0, 1] = 10**13  # one id has a single successor, very often
    model.set_counts(np.arange(400) * 10**9, pairs)
    model.p["g"][:] = 0
    model.p["o"] = np.full_like(model.p["o"], -2.4)
    model.p["h"][:], model.p["b"][:] = 0, 9  # all vectors are one, so that logits are -57.6
    assert not model._far()
    first, other = (int(np.flatnonzero(model.slot == i)[0]) for i in (0, 7))
    got = model.log10(np.array([first, other]), np.array([0, 2])) - model.log10(np.array([first]), np.array([0, 1]))
    want = (model.inner[0, 7] + model.single[other]) / np.log(10)
    assert got[0] == pytest.approx(want, abs=1e-3)
    ids = np.full((2, lm_scoring.WINDOW + 1), -1)
    ids[:, 0], ids[:, 1] = first, other
    assert all(np.isfinite(w).all() for w in model.fit(ids).p.values())


def test_language_model_learns_from_windows_in_proportion(spark):
    kind, rng = np.dtype("<u2"), np.random.default_rng(4)
    texts = [rng.integers(0, 200, int(n)).astype(kind) for n in (1, 31, 32, 33, 64, 65, 700, 9000)]
    rows = spark.createDataFrame([(i, t.tobytes()) for i, t in enumerate(texts)], "h long, ids binary")
    form = "shard long, key long, ids binary"
    every = [np.frombuffer(r.ids, np.int32) for r in rows.mapInArrow(lm_scoring._windows_to_learn(5, 1, kind), form).collect()]
    want = []
    for t in texts:
        seq = np.concatenate(([-2], t.astype(np.int32), np.full(lm_scoring.WINDOW, -1, np.int32)))
        want += [seq[j : j + lm_scoring.WINDOW + 1] for j in range(0, len(t), lm_scoring.WINDOW)]
    assert sorted(map(tuple, every)) == sorted(map(tuple, want))
    some = rows.mapInArrow(lm_scoring._windows_to_learn(5, 4, kind), form)
    assert len(want) / 6 < some.count() < len(want) / 3
    assert {r.shard for r in some.collect()} <= set(range(5))


def test_language_model_learns_from_each_window_once(spark, monkeypatch):
    rng, seen = np.random.default_rng(3), []
    docs = [(i, " ".join(rng.choice(["the cat", "sat on", "a mat.", "Then", "it's gone"], int(rng.integers(0, 200))))) for i in range(60)]

    def spy(df, name, *a, write=lm_scoring.materialize, **b):
        out = write(df, name, *a, **b)
        if name == "fitted":
            seen.append(out.agg(F.sum("n"), F.count("n")).first())
        return out

    monkeypatch.setattr(lm_scoring, "materialize", spy)
    monkeypatch.setattr(lm_scoring, "SHARD", 50)
    lm_scoring.score_documents(spark.createDataFrame(docs, "doc_id long, text string"), TOKENIZER)
    training = pa.array([t for i, t in docs if zlib.crc32(str(i).encode()) % 5 != 1])
    windows = sum(int((-(-np.diff(off) // lm_scoring.WINDOW)).sum()) for _, _, _, off in subwords.text_ids(training, TOKENIZER, subwords.WordIds.of(TOKENIZER).apart))
    assert len(seen) == lm_scoring.ROUNDS and sum(n for n, _ in seen) == windows and all(m > 1 for _, m in seen)
    # in 16 bits the windows are the same
    ids = np.append(rng.integers(0, 49_000, 40), 65_533).astype("<u2")
    rows = [pa.RecordBatch.from_pydict({"h": pa.array([7]), "ids": pa.array([ids.tobytes()], pa.binary())})]
    short, wide = (lm_scoring._window_ids(next(lm_scoring._windows_to_learn(2, 1, np.dtype("<u2"), *form)(rows)).column("ids").to_pylist()) for form in ((np.uint16,), ()))
    assert (short == wide).all() and wide.min() == -2 and wide.max() == 65_533


def test_language_model_takes_the_mean_of_shards_in_steps(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "FAN", 2)
    rng = np.random.default_rng(6)
    model = lm_scoring.AttentionModel(np.arange(60), np.arange(60) % 2)
    model.set_counts(np.arange(60), np.ones((lm_scoring.KEPT + 2, lm_scoring.KEPT + 1), np.int64))
    rows = [(s, k, rng.integers(0, 60, lm_scoring.WINDOW + 1).astype(np.int32).tobytes()) for s in range(5) for k in range(s + 1)]
    total = 0.0
    for s in range(5):
        alone = lm_scoring.AttentionModel(np.arange(60), np.arange(60) % 2)
        alone.prior = model.prior
        alone.fit(np.array([np.frombuffer(i, np.int32) for t, _, i in rows if t == s], np.int64))
        total = total + (s + 1) * np.frombuffer(alone.weights(), np.float32).astype(float)
    got = lm_scoring.learn(model, spark.createDataFrame(rows, "shard long, key long, ids binary"), 5, rounds=1)
    assert np.allclose(np.frombuffer(got.weights(), np.float32), total / 15, atol=1e-4)


def test_key_index_finds_every_key():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 1000, 5000):
        keys = np.unique(np.concatenate((rng.integers(0, 2**64, n, np.uint64), np.array([0, 2**64 - 1] if n > 2 else [], np.uint64))))
        asked = np.concatenate((keys, rng.integers(0, 2**64, 500, np.uint64), np.array([0, 1, 2**63, 2**64 - 1], np.uint64)))
        at, hit = lm_scoring.KeyIndex(keys).find(asked)
        assert hit.tolist() == np.isin(asked, keys).tolist()
        assert (keys[at[hit]] == asked[hit]).all()


def test_items_of_all_sizes_against_plain_sets(spark):
    rng = np.random.default_rng(12)
    vocabulary = [f"w{i}" for i in range(60)]
    made = lambda n: [str(x) for x in rng.choice(vocabulary, int(n))]
    items = [made(n) for n in (1, 2, 4, 5, 6, 7, 9, 12, 20, 40, 90, 200, 400) for _ in range(3)]
    docs = []
    for item in items:
        for share in (0.0, 0.04, 0.1):
            body = [w if rng.random() >= share else "changed" for w in item]
            docs.append(made(rng.integers(0, 300)) + body + made(rng.integers(0, 40)))
    docs += [item[: int(len(item) * 0.82) + 4] for item in items] + [item[: len(item) // 2] for item in items]
    shingles = lambda ws: {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()
    want = set()
    for i, a in enumerate(map(shingles, docs)):
        for j, b in enumerate(map(shingles, items)):
            if 100 * len(a & b) >= 80 * len(b):
                want.add((i, j, len(b), len(a & b)))
    table = lambda rows, name: spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(rows)], f"{name} long, text string")
    got = decontamination.contained(table(docs, "doc_id"), table(items, "item_id")).collect()
    assert len(want) > 80 and set(map(tuple, got)) == want and len(got) == len(want)


def test_thousands_of_listed_hosts(spark):
    rng = np.random.default_rng(3)
    hosts = [f"h{i}.{'abc'[i % 3]}.example.net" for i in range(0, 9000, 3)] + [f"s{i}.org" for i in range(1000)]
    asked = [f"{p}{h}" for p in ("", "x.", "x") for h in (f"h{int(i)}.{'abc'[int(i) % 3]}.example.net" for i in rng.integers(0, 9000, 1500))] + [f"y.s{i}.org" for i in range(0, 2000, 7)]
    pages = spark.createDataFrame([(i, f"http://{h}/p") for i, h in enumerate(asked)], "page_id long, url string")
    listed = set(hosts)
    got = url_filter.url_filter(pages, url_filter.RULES, spark.createDataFrame([(h,) for h in hosts], "host string")).collect()
    parents = lambda h: {".".join(h.split(".")[i:]) for i in range(h.count(".") + 1)}
    assert {r.page_id: r.verdict for r in got} == {i: "block" if parents(h) & listed else "allow" for i, h in enumerate(asked)}
