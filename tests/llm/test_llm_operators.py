"""The operators against brute force, an exact library or held-out rows."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cohort_spark.llm import chat, language_model, lines, mixing, neighbours, queries, sharding, worker
from cohort_spark.llm.components import components
from cohort_spark.llm.lattice import Lattice, Weights
from cohort_spark.llm.jaccard_join import jaccard_join, one_of_each, parity_sketch, with_components
from cohort_spark.llm.ranks import ranked
from cohort_spark.llm.tables import table
from cohort_spark.llm.token_counts import Lengths, count_tokens, pre_tokens

SF = "/root/testdata/sf0.001"


def run(spark, name):
    return queries.QUERIES[name](spark, SF).toPandas()


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet")


def words(text):
    return (text or "").encode().lower().split()


def grams(text, k):
    w = words(text)
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def classes_by_hand(texts, k, percent):
    """Smallest id of each component over all pairs of (id, text)."""
    sets, root = {i: grams(t, k) for i, t in texts}, {i: i for i, _ in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            both, a, b = len(sets[i] & sets[j]), len(sets[i]), len(sets[j])
            if a and b and 100 * both >= percent * (a + b - both):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def test_op1(spark, docs):
    got = run(spark, "op1_ngram_jaccard_join").set_index("doc_id")
    want, sizes = classes_by_hand(list(zip(docs.doc_id, docs.text)), 3, 90)
    assert dict(got.component_id) == want and dict(got.n_shingles) == sizes


def test_jaccard_join_chains_and_groups(spark, documents):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(400)]
    base = list(rng.choice(vocabulary, 60))
    rows, text = [], base[:]
    for i in range(120):  # a chain of small edits, all within one group of near copies
        text = text[:]
        text[int(rng.integers(60))] = vocabulary[int(rng.integers(400))]
        rows.append((i, " ".join(text)))
        if i % 9 == 0:
            text = base[:]
    rows += [(200 + i, " ".join(base + [f"x{i}"])) for i in range(60)]
    rows += [(300 + i, " ".join(rng.choice(vocabulary, int(n)))) for i, n in enumerate(rng.integers(1, 12, 60))]
    rows += [(400 + i, " ".join([f"u{j}" for j in range(9 + i % 3)])) for i in range(6)]
    for percent, k in ((90, 3), (80, 5), (80, 1)):
        got = with_components(jaccard_join(documents(rows), percent=percent, k=k)[0]).toPandas()
        want, _ = classes_by_hand(rows, k, percent)
        assert dict(zip(got.doc_id, got.component_id)) == want


def test_one_of_each(hard):
    kept = sorted((str(r.doc_id) for r in one_of_each(hard, percent=80, k=5).collect()))
    assert kept == sorted(map(str, [1, None, None, 2, 3, 4, 5, 6, 7, 9]))


def test_near_duplicates_sends_workers_few_texts_at_once(spark, documents, monkeypatch):
    given, seen, written = spark.conf.get(worker.BATCH_ROWS), {}, jaccard_join.__globals__["stage"]

    def noted(df, name):
        seen[name] = int(spark.conf.get(worker.BATCH_ROWS))
        return written(df, name)

    monkeypatch.setitem(jaccard_join.__globals__, "stage", noted)
    one = " ".join(f"w{i}" for i in range(60))
    assert one_of_each(documents([(1, one), (2, f"{one} x"), (3, "another text")])).count() == 2
    assert {seen[name] for name in ("rows", "texts", "links")} == {worker.TEXT_ROWS}
    assert spark.conf.get(worker.BATCH_ROWS) == given and seen["kept"] == int(given)
    for own, most in (("7", 7), ("0", worker.TEXT_ROWS), ("20000", worker.TEXT_ROWS)):
        spark.conf.set(worker.BATCH_ROWS, own)
        try:
            with worker.few_texts(spark):
                sizes = spark.range(0, 1500, 1, 1).mapInArrow(
                    lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()
            assert max(r.n for r in sizes) == most and spark.conf.get(worker.BATCH_ROWS) == own
        finally:
            spark.conf.unset(worker.BATCH_ROWS)


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (103, 101), (7, 3), (200, 200)]
    found = {r.v: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, 103: 100}


def test_op3_keeps_first_of_large_id(documents):
    key = "a line that is long enough"
    rows = [(1, f"{key}\nx"), (2, f" {key.upper()} "), (5, f"{key}\n{key}"), (3, "é" * 19), (4, "é" * 19), (6, "é" * 19),
            (7, "ü" * 20), (8, "ü" * 20), (9, "ü" * 20)]
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in lines.dedup_lines(documents(rows)).collect()}
    assert got == {1: ("x", 2, 1), 2: ("", 1, 1), 5: (f"{key}\n{key}", 2, 0), 3: ("é" * 19, 1, 0), 4: ("é" * 19, 1, 0),
                   6: ("é" * 19, 1, 0), 7: ("", 1, 1), 8: ("", 1, 1), 9: ("ü" * 20, 1, 0)}


def test_op4_is_the_library(spark, docs, pieces):
    model = sentencepiece.SentencePieceProcessor(model_file=pieces)
    got = run(spark, "op4_token_counts").set_index("doc_id")
    want = {i: len(model.encode(t or "")) for i, t in zip(docs.doc_id, docs.text)}
    assert dict(got.n_tokens) == want
    assert dict(got.over_limit) == {i: n > 4096 for i, n in want.items()}
    assert dict(got.n_bytes) == {i: len((t or "").encode()) for i, t in zip(docs.doc_id, docs.text)}


def test_token_counts_of_odd_texts(pieces, documents):
    model = sentencepiece.SentencePieceProcessor(model_file=pieces)
    texts = ["a  b", " a", "a ", "", " ", "   ", " \n", "a\n b", "▁", "a▁b ▁", "\t", "<s> x </s>", "é́", "　x", "a\x00b",
             "🙂🙂  🙂", "the " * 50, "x" * 5000, "  lead and trail  "]
    lengths = Lengths(pieces, {}, kept=3)  # a tiny cache is cleared all the time
    assert [lengths.of(t) for t in texts] == [len(model.encode(t)) for t in texts]
    got = {r.doc_id: r.n_tokens for r in count_tokens(documents(list(enumerate(texts))), pieces, entries=4, kept=2).collect()}
    assert got == {i: len(model.encode(t)) for i, t in enumerate(texts)}
    assert pre_tokens("a b") == ["a", "b"]


def test_op5_recall(spark):
    rows = pd.read_parquet(f"{SF}/embeddings.parquet")
    vectors, ids = np.stack(rows.embedding).astype(float), rows.vec_id.to_numpy()
    got, hits, n = run(spark, "op5_nearest_neighbours"), 0, 0
    assert set(got.query_id) == {i for i in ids if i % 20 == 0}
    for query, part in got.groupby("query_id"):
        score = vectors @ vectors[ids == query][0]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != query][:20]
        part = part.sort_values("rank")
        assert list(part["rank"]) == list(range(1, 21))
        held = dict(zip(ids, score))
        assert np.allclose(part.score, [held[v] for v in part.vec_id], rtol=0, atol=1e-15)
        hits, n = hits + len(set(ids[order]) & set(part.vec_id)), n + 20
    assert hits / n >= 0.9


def test_neighbours_over_many_parts(spark, monkeypatch):
    """Parts and blocks, and the share ranked again as at large sizes, on clustered vectors."""
    monkeypatch.setattr(neighbours, "PART", 500)
    monkeypatch.setattr(neighbours, "BLOCK", 40)
    monkeypatch.setattr(neighbours, "LEAST_AGAIN", 1)
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(2400, 32)) + 2 * rng.normal(size=(12, 32))[rng.integers(12, size=2400)]
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got, hits, n = neighbours.neighbours(frame).toPandas(), 0, 0
    for query, part in got.groupby("query_id"):
        score = vectors @ vectors[query]
        score[query] = -np.inf
        hits, n = hits + len(set(np.argsort(-score)[:20]) & set(part.vec_id)), n + 20
    assert n == 120 * 20 and hits / n >= 0.9


def test_neighbours_of_other_lengths_and_without_structure(spark, monkeypatch):
    """Nothing is missed where directions tell little: lengths that differ, unstructured and sparse vectors."""
    monkeypatch.setattr(neighbours, "PART", 500)
    monkeypatch.setattr(neighbours, "LEAST_AGAIN", 1)
    rng = np.random.default_rng(8)
    plain = rng.normal(size=(1500, 48))
    sparse = np.where(rng.random((1500, 48)) < 0.06, rng.integers(1, 4, (1500, 48)), 0.0)
    sparse[:, 0] += sparse.sum(axis=1) == 0
    for vectors in (plain * np.exp(1.5 * rng.normal(size=(1500, 1))), sparse):
        frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
        got = neighbours.neighbours(frame).toPandas()
        for query, part in got.groupby("query_id"):
            score = vectors @ vectors[query]
            score[query] = -np.inf
            assert np.allclose(part.sort_values("rank").score, np.sort(score)[::-1][:20], rtol=1e-12, atol=1e-12)
        assert len(got) == 75 * 20


def test_op6(spark, docs):
    got = run(spark, "op6_mixing")
    sizes = {i: len(words(t)) for i, t in zip(docs.doc_id, docs.text)}
    assert dict(zip(got.doc_id, got["size"])) == sizes
    assert (got.taken <= 3 * got["size"]).all() and (got.taken % got["size"].clip(lower=1) == 0).all()
    per = got.groupby("source").agg(size=("size", "sum"), held=("source_size", "first"), target=("target", "first"),
                                    taken=("taken", "sum")).sort_index()
    assert (per["size"] == per.held).all()
    weights = [(5, 2, 1)[i % 3] for i in range(len(per))]
    assert np.allclose(per.target, mixing.fair_shares(list(per["size"]), weights))
    assert math.isclose(per.target.sum(), per["size"].sum())
    assert (abs(per.taken - per.target) <= 0.02 * per.target + 3).all()
    again = run(spark, "op6_mixing")
    assert dict(zip(got.doc_id, got.taken)) == dict(zip(again.doc_id, again.taken))


def test_fair_shares_stop_at_three_times():
    assert mixing.fair_shares([10, 1000, 990], [5, 2, 1]) == pytest.approx([30, 1313.3333, 656.6667], abs=1e-3)
    assert mixing.fair_shares([0, 10], [5, 2]) == [0, 10]


def boxed(sizes, target):
    """The tilt by halving alone."""
    mean = sum(n * size for size, n in sizes) / sum(n for _, n in sizes)
    words = lambda b: sum(n * size * min(3.0, math.exp(min(b * size / mean, 2))) for size, n in sizes)
    low, high = -1e6, 1e6
    for _ in range(200):
        low, high = ((low + high) / 2, high) if words((low + high) / 2) < target else (low, (low + high) / 2)
    return mean, low


def test_balance_tilts_by_size(spark):
    """Rates fall or rise with size, stop at the bound, and are those of an independent solver."""
    cells = {"a": [(10, 100), (40, 50), (100, 10)], "b": [(1, 1000), (5000, 3), (70, 8)], None: [(7, 9)], "c": [(3, 5), (900, 2)]}
    goals = {"a": 6000.0, "b": 900.0, None: 63.0, "c": 3 * 1815.0}
    sizes = spark.createDataFrame([(s, x, n) for s, rows in cells.items() for x, n in rows], "source string, size long, n long")
    targets = spark.createDataFrame([(s, sum(x * n for x, n in rows), sum(n for _, n in rows), goals[s]) for s, rows in cells.items()],
                                    "source string, source_size long, n_docs long, target double")
    got = {r.source: r for r in mixing.balance(sizes, targets).collect()}
    for source, rows in cells.items():
        rate = lambda x: min(3.0, math.exp(min(got[source].b * x / got[source].mean, 2)))
        assert sum(n * x * rate(x) for x, n in rows) == pytest.approx(goals[source], rel=1e-8)
        mean, b = boxed(rows, goals[source])
        assert got[source].mean == pytest.approx(mean)
        if source != "c":  # there every rate is at the bound, for any larger tilt as well
            assert got[source].b == pytest.approx(b, rel=1e-6, abs=1e-9)
    assert got["b"].b < 0 < got["a"].b and got[None].b == 0


def test_mix_takes_fewer_long_documents_of_a_source_that_gives_less(documents):
    rows = [(i, "w " * (5 if i % 2 else 200), "en", "a" if i < 100 else "b") for i in range(600)]
    rates = lambda *w: mixing.mix(documents(rows), weights=w).toPandas().groupby(["source", "size"])["copies"].mean()
    less = rates(1.0, 1.0)
    assert less["b", 5] > 0.85 and less["b", 200] < 0.65 and less["a", 5] == less["a", 200] == 3
    more = rates(1.0, 4.0)
    assert more["a", 200] > 1.15


def test_op7(spark, docs):
    got = run(spark, "op7_sharding").set_index("doc_id")
    assert dict(got["size"]) == {i: len((t or "").encode()) + 8 for i, t in zip(docs.doc_id, docs.text)}
    assert dict(got.text_crc32) == {i: zlib.crc32((t or "").encode()) for i, t in zip(docs.doc_id, docs.text)}
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    assert set(got["shard"]) <= set(range(24)) and got.grown_shard.isna().all()


def test_sharding_is_even_and_splits_hot_groups(spark, documents):
    rows = [(i, "one text that a third of all documents have", "en", "s0") for i in range(900)]
    rows += [(1000 + i, f"text {i} " + "x" * (i % 97), ("en", "fr", "de")[i % 3], f"s{i % 5}") for i in range(1800)]
    got = sharding.shard(documents(rows), 24).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 24 and sizes.max() / sizes.mean() < 1.06 and sizes.min() / sizes.mean() > 0.94
    again = sharding.shard(documents(rows).repartition(7), 24).toPandas()
    assert got.sort_values("doc_id")[["doc_id", "shard", "slot"]].values.tolist() == \
        again.sort_values("doc_id")[["doc_id", "shard", "slot"]].values.tolist()


def test_equal_texts_stay_together(documents):
    rows = [(i, f"pair {i // 2} " + "y" * 40, "en", f"s{i % 3}") for i in range(2000)]
    got = sharding.shard(documents(rows), 6).toPandas()
    assert (got.groupby("text_crc32")["shard"].nunique() == 1).all()


def test_ranks(spark):
    rows = [(i % 3 if i % 7 else None, i) for i in range(500)] + [(1, 5000)] * 4
    got = ranked(spark.createDataFrame(rows, "g long, i long"), ["g"], ["i"], "r", buckets=8).toPandas()
    for _, part in got.groupby("g", dropna=False):
        assert sorted(part.r) == list(range(len(part)))


def test_op8_accuracy(spark, docs):
    got = run(spark, "op8_language_id").merge(docs[["doc_id", "lang", "text"]], on="doc_id")
    assert dict(zip(got.doc_id, got.held_out)) == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in docs.doc_id}
    held = got[got.held_out & got.lang.notna()]
    assert (held.lang == held.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def by_hand(lattice, logp, word):
    """Sum over all segmentations, one by one."""
    text, ids = "▁" + word, {}

    def walk(node, piece):
        for letter, child in node[0].items():
            if child[1]:
                ids[piece + letter] = child[1]
            walk(child, piece + letter)

    walk(lattice.root, "")

    def total(rest):
        if not rest:
            return 1.0
        out = sum(math.exp(logp[ids[rest[:e]]]) * total(rest[e:]) for e in range(1, len(rest) + 1) if rest[:e] in ids)
        if rest[0] not in ids:
            out += math.exp(logp[0]) * 256.0 ** -len(rest[0].encode()) * total(rest[1:])
        return out

    return math.log(total(text))


def test_lattice_sums_all_segmentations(pieces):
    small = Lattice(["<unk>", "▁", "▁a", "a", "ab", "b", "bab", "ba"], np.array([1, 3, 5, 2, 4, 1, 2, 2.0]))
    logp = np.log(small.prior)
    model = Weights(logp)
    for word in ("a", "ab", "abab", "babab", "aczb", "é", "🙂a", "abababababab"):
        assert small.score(word, [model])[0] == pytest.approx(by_hand(small, logp, word), rel=1e-12)
    uses = [0.0] * len(small)
    small.expect("ab", 2.0, model, uses)
    # ▁|a|b, ▁a|b, ▁|ab, ▁a.. by hand
    p = small.prior
    ways = {("▁", "a", "b"): p[1] * p[3] * p[5], ("▁a", "b"): p[2] * p[5], ("▁", "ab"): p[1] * p[4]}
    names = ["<unk>", "▁", "▁a", "a", "ab", "b", "bab", "ba"]
    for i, name in enumerate(names):
        want = 2.0 * sum(w * way.count(name) for way, w in ways.items()) / sum(ways.values())
        assert uses[i] == pytest.approx(want)
    full = Lattice.of_model(pieces)
    model = Weights(np.log(full.prior))
    long = "thing" * 12  # in log space; splitting nothing, against the short way without its bound
    import cohort_spark.llm.lattice as module
    logs = full.score(long, [model])[0]
    before, module.SHORT = module.SHORT, 1000
    try:
        assert full.score(long, [model])[0] == pytest.approx(logs, rel=1e-12)
    finally:
        module.SHORT = before


def test_op10(spark, docs, pieces):
    got = run(spark, "op10_lm_scoring").set_index("doc_id")
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in docs.doc_id}
    counts, ends = Counter(), 0
    for i, t in zip(docs.doc_id, docs.text):
        if not held[i]:
            counts.update(words(t))
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    base = lambda c: math.log10((c + 0.1) / (n + 0.1 * (v + 1)))
    model = language_model.learn(table(spark, SF, "documents").where(~F.col("doc_id").isin([i for i in held if held[i]])), pieces)
    lattice, weights = Lattice.of_model(pieces, lower=True), [Weights(model.logp)]
    end = (ends + 1) / (n + 2)
    word = lambda w: lattice.score(w.decode(), weights)[0] / math.log(10) + math.log10(1 - end)
    for i, t in zip(docs.doc_id, docs.text):
        w, row = words(t), got.loc[i]
        assert row.held_out == held[i] and row.n_tokens == len(w) + 1 and row.train_tokens == n
        assert row.n_known == 1 + sum(counts[x] > 0 for x in w)
        assert row.base_score == pytest.approx(sum(base(counts[x]) for x in w) + base(ends), rel=1e-9)
        if i % 10 == 0:
            assert row.score == pytest.approx(sum(word(x) for x in w) + math.log10(end), rel=1e-9)


def test_lm_words_beyond_the_table(spark, docs, pieces, monkeypatch):
    """The counts that come by the join are those of the table."""
    frame = table(spark, SF, "documents").select("doc_id", "text")
    whole = language_model.score(frame, language_model.learn(frame, pieces)).toPandas().set_index("doc_id")
    monkeypatch.setattr(language_model, "FREQUENT", 10)
    few = language_model.score(frame, language_model.learn(frame, pieces)).toPandas().set_index("doc_id")
    assert (whole.n_known == few.n_known.loc[whole.index]).all()
    assert np.allclose(whole.base_score, few.base_score.loc[whole.index]) and np.allclose(whole.score, few.score.loc[whole.index])


def test_lm_words_beyond_the_table_are_worked_out_once(spark, documents, pieces, monkeypatch):
    scored = spark.sparkContext.accumulator(0)

    class Counted(Lattice):
        def score(self, word, models):
            scored.add(1)
            return Lattice.score(self, word, models)

    words = [f"rare{'abcdefghij'[i % 10]}{'klm'[i // 10]}" for i in range(30)]
    frame = documents([(i, " ".join(words[i % 7:] + words[:i % 7])) for i in range(40)]).repartition(4)
    for name, value in (("Lattice", Counted), ("FREQUENT", 10), ("CACHED", 5)):
        monkeypatch.setattr(language_model, name, value)
    assert len(language_model.score(frame, language_model.learn(frame, pieces)).collect()) == 40
    assert 30 <= scored.value <= 60


def test_op9_blocks_and_hidden_roles(spark):
    turns = table(spark, SF, "conversations")
    model = chat.learn(turns)
    given = chat.parse(turns, model).toPandas()
    assert (given.speaker == given.role).mean() == 1.0
    hidden = turns.withColumnRenamed("role", "truth")
    one = chat.parse(hidden, model, speaker=None).toPandas().sort_values(["conv_id", "turn", "part"])
    cut = chat.parse(hidden, model, speaker=None, block=2).toPandas().sort_values(["conv_id", "turn", "part"])
    columns = ["conv_id", "turn", "part", "role", "begins", "content"]
    assert one[columns].values.tolist() == cut[columns].values.tolist()
    truth = turns.toPandas().merge(one[one.part == 0], on=["conv_id", "turn"])
    assert (truth.role_x == truth.role_y).mean() > 0.8


def test_op9_recovers_hidden_roles_of_held_out_conversations(spark):
    got = queries.QUERIES["op9_chat_formatting"](spark, "/root/testdata/sf0.01").toPandas()
    assert dict(zip(got.conv_id, got.held_out)) == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in got.conv_id}
    found = got[(got.part == 0) & got.held_out]
    by_turn = ["assistant" if t % 2 else "user" for t in found.turn]
    right = (found.role == found.given_role).mean()
    assert len(found) > 100 and right > 0.9 and right > (by_turn == found.given_role).mean() + 0.1


def test_viterbi_is_the_best_path(spark):
    turns = table(spark, SF, "conversations")
    model = chat.learn(turns)
    rows = [(0, "hi\nUser: so?", 0, None), (1, "x" * 300, 0, None), (2, "yes", 3, None)]
    lines_, scores = chat._emissions(model, rows)
    best, states = -np.inf, None
    from itertools import product
    for path in product(range(6), repeat=len(scores)):
        total, at = 0.0, 6
        for s, emit in zip(path, scores):
            total, at = total + model.move[at, s] + emit[s], s
        if total > best:
            best, states = total, list(path)
    ends = chat._matrix(model, rows)[6]
    assert ends.max() == pytest.approx(best)
    assert chat._path(model, rows, 6, int(ends.argmax()))[1] == states


@pytest.mark.parametrize("line, role, rest", [
    ("User: hello", 1, "hello"), ("### Assistant:", 2, ""), ("<|system|>be kind", 0, "be kind"), ("**Human:** x", 1, "x"),
    ("[bot] y", 2, "y"), ("answering: no", None, "answering: no"), ("plain", None, "plain")])
def test_markers(line, role, rest):
    number, left = chat.marker(line)
    assert (number - 1 if number else None, left) == (role, rest)


def test_all_ten_and_the_pipeline_are_registered():
    names = entry.queries()
    assert all(sum(name.startswith(f"op{n}_") for name in names) == 1 for n in range(1, 11)) and "pipeline" in names


def test_kept_text_hash(spark, docs):
    got = run(spark, "op3_line_dedup").set_index("doc_id")
    held = defaultdict(set)
    strip = lambda line: line.encode().strip(b" \t\n\x0b\x0c\r").lower()
    for i, t in zip(docs.doc_id, docs.text):
        for line in (t or "").split("\n"):
            if len(strip(line).decode()) >= 20:
                held[strip(line)].add(i)
    for i, t in zip(docs.doc_id, docs.text):
        stay = [x for x in (t or "").split("\n") if len(held[strip(x)]) < 3 or max(held[strip(x)]) == i]
        assert got.loc[i].kept_sha256 == hashlib.sha256("\n".join(stay).encode()).hexdigest()


def test_parity_sketches_never_differ_in_more_bits_than_tokens():
    rng = np.random.default_rng(5)
    for n in (0, 1, 30, 300, 3000):
        a = np.unique(rng.integers(-2**63, 2**63 - 1, n))
        b = np.union1d(a[n // 5:], rng.integers(-2**63, 2**63 - 1, n // 7))
        differ = np.bitwise_xor(parity_sketch(a), parity_sketch(b)).view(np.uint64)
        assert sum(int(x).bit_count() for x in differ) <= len(np.setxor1d(a, b))
