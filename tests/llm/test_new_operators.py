"""Phrases, conversation repair, fingerprints and components against brute force, and on hard rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cohort_spark.llm import phrases, queries, repair, simhash
from cohort_spark.llm.components import components
from cohort_spark.llm.jaccard_join import jaccard_join, with_components
from cohort_spark.llm.tables import table

SF = "/root/testdata/sf0.001"


# --- components ------------------------------------------------------------------
@pytest.mark.parametrize("n", [200, 5000])
def test_components_of_shuffled_paths(spark, monkeypatch, n):
    import cohort_spark.llm.components as module
    turns, picks = [], module._picks
    monkeypatch.setattr(module, "_picks", lambda *a: turns.append(1) or picks(*a))
    ids = list(range(n))
    random.Random(n).shuffle(ids)
    edges = list(zip(ids, ids[1:])) + [(10 * n + i, 10 * n) for i in range(1, n)] + [(30 * n, 30 * n), (None, 5)]
    found = {r.v: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(n)}, **{10 * n + i: 10 * n for i in range(n)}, 30 * n: 30 * n}
    assert len(turns) <= 2 * np.log2(n) + 10


def test_components_against_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    root = {}

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    found = {r.v: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {v: find(v) for e in edges for v in e}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_jaccard_join_of_a_long_chain(documents):
    """Each document one word from the next, ids in random order."""
    rng = random.Random(9)
    words, rows = [f"w{i}" for i in range(80)], []
    ids = list(range(100))
    rng.shuffle(ids)
    for i in ids:
        rows.append((i, " ".join(words)))
        words = words[:]
        words[rng.randrange(80)] = f"x{i}"
    got = with_components(jaccard_join(documents(rows), percent=80, k=1)[0]).toPandas()
    assert set(got.component_id) == {0}


# --- op11 ------------------------------------------------------------------------
def phrases_by_hand(rows, support, listed):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(lower)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i:i + k])] += 1
    f = {key: c for key, c in f.items() if c >= support}
    longer = defaultdict(int)
    for (lang, p), a in f.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                longer[lang, p[i:i + k]] = max(longer[lang, p[i:i + k]], a)
    out = defaultdict(list)
    for (lang, p), a in f.items():
        if len(p) < 2 or 100 * longer[lang, p] >= 80 * a:
            continue
        score, k = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, rank, p.decode(), -a, left, right, n[lang], -score)
            for lang, rows in out.items() for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:listed], 1)}


@pytest.mark.parametrize("most", [500_000, 700, 60])
def test_phrases_by_hand(spark, monkeypatch, most):
    rng = random.Random(3)
    vocabulary = ["New", "york", "the", "é", "ÉA", "漢字", "a", "\x00", "ab c", "x" * 50]
    seps = [" ", " ", " ", "\t", "  ", ", ", ".", "\n", "; ", " \r"]
    rows = [("".join(rng.choice(vocabulary) + rng.choice(seps) for _ in range(rng.randrange(60))),
             rng.choice(["en", "fr", None])) for _ in range(300)]
    rows += [(None, "en"), ("", None), (" \t\n", "de"), ("lone", "es"), ("new york city " * 3000, "en")]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    got = {tuple(r) for r in phrases.collocations(docs, listed=40, shard_words=most).collect()}
    assert got == phrases_by_hand(rows, 30, 40)


def test_phrase_cases(spark, hard, documents):
    assert phrases.collocations(documents([])).collect() == []
    assert phrases.collocations(documents([(1, None), (2, "")])).collect() == []
    rows = [(r.text, r.lang) for r in hard.collect()]
    docs = hard.withColumn("k", F.lit("x")).withColumn("n", F.lit(1)).withColumn("phrase", F.lit("y")).withColumn("code", F.lit("z"))
    assert {tuple(r) for r in phrases.collocations(docs).collect()} == phrases_by_hand(rows, 30, 2000)


def test_a_wrong_slack_is_found_out(spark):
    """Should shards turn out other than foreseen, mining runs again and loses nothing."""
    rows = [("alpha beta gamma", "en")] * 45 + [(f"w{i} v{i}", "en") for i in range(200)]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    wanted = {(r.phrase, r.f) for r in phrases.frequent_phrases(docs, shard_words=50)[0].collect()}
    langs, short = {"en": (0, 535)}, {0: 0}
    found = {(r.phrase, r.f) for r in phrases._round(docs, langs, 50, short, (1, 2), None).collect()}
    assert found == {(p, f) for p, f in wanted if len(p.split()) < 3} and short[0] > 0


# --- op12 ------------------------------------------------------------------------
def repaired_by_hand(rows):
    """The cheapest audits of (role, text) rows in order, over all edit scripts of bounded length."""
    seen, kinds = set(), []
    for role, text in rows:
        blank, again = not text.strip(" \t\n\x0b\x0c\r"), (role, text) in seen
        seen.add((role, text))
        cut = not blank and text.rstrip(" \t\n\x0b\x0c\r")[-1] not in ".!?"
        kinds.append((role, blank or again, cut))
    best = None
    for inserts in product(range(3), repeat=len(rows) + 1):
        if sum(inserts) > 3:
            continue
        for letters in product("KRD", repeat=len(rows)):
            if any(gone and letter != "D" for letter, (_, gone, _) in zip(letters, kinds)):
                continue
            cost = 3 * sum(inserts) + sum({"K": 0, "R": 3, "D": 4}[x] + (3 if x != "D" and cut else 0)
                                          for x, (_, _, cut) in zip(letters, kinds))
            choices = []
            for i, x in enumerate([*letters, None]):
                choices += ["ua"] * inserts[i]
                if x == "K":
                    choices.append(kinds[i][0][:1])
                elif x == "R":
                    choices.append("ua")
            if any(c == "" for c in choices):
                continue
            if not any(re.fullmatch("(s?(ua)+)?", "".join(s)) for s in product(*choices)):
                continue
            audit = "".join("I" * inserts[i] + (x or "") for i, x in enumerate([*letters, None]))
            best = min(best or (cost, audit), (cost, audit))
    return best


def as_rows(pairs):
    seen, out = set(), []
    for role, text in pairs:
        blank = not text.strip()
        out.append(repair.Row(None, role, text, 1, blank, (role, text) in seen, not blank and text.rstrip()[-1] not in ".!?"))
        seen.add((role, text))
    return out


def test_lightest_derivation_is_the_cheapest_script():
    rng = random.Random(7)
    for _ in range(150):
        pairs = [(rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(["a.", "b", " ", "c!"]))
                 for _ in range(rng.randrange(5))]
        rows = as_rows(pairs)
        ends = {q: (0, "") for q in repair.ENDS}
        assert repair.lightest(rows, ends, goal=0)[0] == repaired_by_hand(pairs), pairs
        audit = repair.lightest(rows, ends, goal=0)[0][1]
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for _, _, r, _ in repair.edits(rows, audit) if r is not None))


@pytest.mark.parametrize("long", [2000, 2])
def test_repair_cases(spark, long):
    kind = "conv_id long, turn long, role string, text string, cid string, place string"
    rows = [(1, 0, "user", "Hi.", None, None), (1, 1, "assistant", "Yes.", None, None), (1, 1, "assistant", "Yes.", "x", "y"),
            (1, 4, "assistant", "Cut", None, None), (2, None, None, None, None, None), (2, None, "user", "Same turn.", None, None),
            (2, None, "assistant", "Same turn too.", None, None), (None, 3, "user", "No conversation?", None, None),
            (3, 5, "", "Empty role.", None, None)]
    turns = spark.createDataFrame(rows, kind)
    summary, lines = repair.repair(turns, long)
    found = {r.conv_id: tuple(r)[1:] for r in summary.collect()}
    assert found == {1: (2, 0, 1, 1, 2, 8, "KKDD"), 2: (0, 1, 0, 0, 1, 10, "DIKKI"), None: (0, 0, 0, 0, 0, 3, "KI"),
                     3: (0, 0, 0, 0, 0, 4, "D")}
    kept = [(r.role, r.text) for r in lines.where("conv_id is null").orderBy("place").collect()]
    assert kept == [("user", "No conversation?"), ("assistant", "")]
    empty = spark.createDataFrame([], kind)
    assert repair.repair(empty, long)[0].collect() == [] and repair.damaged_and_repaired(empty, long).collect() == []


def test_hot_conversation_in_blocks_is_that_in_one_piece(spark):
    rng = random.Random(11)
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.choice([None, *range(60)]), rng.choice(["user", "assistant", "system", "tool"]),
             rng.choice(["Yes.", "no", "", "What?", f"Say {rng.randrange(40)}."])) for _ in range(700)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole, cut = (sorted(map(str, repair.damaged_and_repaired(turns, n).collect())) for n in (5000, 9))
    assert whole == cut
    many = spark.createDataFrame([(5, 1, "user", "Same.")] * 3000 + [(5, 2, "assistant", "Fine.")],
                                 "conv_id long, turn long, role string, text string")
    row = repair.repair(many, 10)[0].first()
    assert (row.duplicate, row.illegal, row.cost, row.audit) == (2999, 2999, 4 * 2999, "K" + "D" * 2999 + "K")


# --- op13 ------------------------------------------------------------------------
def fingerprint_by_hand(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_by_hand(fps):
    values = np.array(sorted(set(fps)), dtype=np.uint64)
    near, label = np.bitwise_count(values[:, None] ^ values[None, :]) <= 4, np.arange(len(values))
    while True:
        now = np.where(near, label, len(values)).min(axis=1)
        if (now == label).all():
            return dict(zip(values.tolist(), label.tolist()))
        label = now


def test_op13(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    got = queries.QUERIES["op13_simhash_near_dedup"](spark, SF).toPandas().set_index("doc_id")
    fps = {i: fingerprint_by_hand(t) for i, t in zip(docs.doc_id, docs.text)}
    assert dict(got.fingerprint) == {i: f"{fp:016x}" for i, fp in fps.items()}
    label = groups_by_hand(fps.values())
    least = {}
    for i in sorted(fps):
        least.setdefault(label[fps[i]], i)
    assert dict(got.component_id) == {i: least[label[fp]] for i, fp in fps.items()}


@pytest.mark.parametrize("code", [simhash.GOLAY, simhash.HAMMING])
@pytest.mark.parametrize("homes", [8192, 5])
def test_no_near_pair_of_fingerprints_is_lost(spark, code, homes):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    fps = {0, 2**64 - 1, *base.tolist()}
    for fp in base[:30].tolist():  # chains of copies, each four bits from the one before
        for _ in range(8):
            for bit in rng.choice(64, 4, replace=False):
                fp ^= 1 << int(bit)
            fps.add(fp)
    hot = int(base[40])  # one anchor with many at home
    fps |= {hot ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(i)}
    rows = spark.createDataFrame([(int(np.uint64(fp).view(np.int64)),) for fp in fps], "fp long")
    found = {r.v: r.label for r in components(simhash.near_links(rows, code, homes)).collect()}
    label = groups_by_hand(fps)
    signed = lambda fp: int(np.uint64(fp).view(np.int64))
    by_label = defaultdict(list)
    for fp, name in label.items():
        by_label[name].append(signed(fp))
    for members in by_label.values():
        assert {found.get(v, v) for v in members} == {min(members)}


def test_codes_cover():
    """Every value has a home within the radius, and all anchors in reach are listed."""
    for code in (simhash.GOLAY, simhash.HAMMING):
        first, patterns, weight = code.errors()
        assert (weight[first[:-1]] <= code.radius).all() and len(first) - 1 == 1 << (code.radius == 3 and 11 or 5)
        value = np.array([0x15A5A5 & ((1 << code.shape()[0]) - 1)])
        s = int(code.syndrome(value)[0])
        reached = value[0] ^ patterns[first[s]:first[s + 1]]
        assert (code.syndrome(reached) == 0).all() and len(set(reached.tolist())) == len(reached)


def test_simhash_cases(hard, documents):
    groups, _ = simhash.simhash_groups(hard.withColumn("fp", F.lit("x")).withColumn("label", F.lit(1)))
    rows = groups.collect()
    assert len(rows) == hard.count()
    assert {r.component_id for r in rows if r.fp == 0} == {1}  # missing, empty and blank texts are linked
    assert {r.component_id for r in rows if r.doc_id in (7, 8)} == {7}
    assert simhash.simhash_groups(documents([]))[0].collect() == []
    alone, _ = simhash.simhash_groups(documents([(None, "a text of its own here")]))
    assert [r.component_id for r in alone.collect()] == [None]


def test_runs_of_a_very_long_text(monkeypatch):
    text = " ".join(f"w{i % 701}" for i in range(3000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "RUN", 64)
    assert simhash.fingerprint(text) == whole


def test_three_new_operators_are_registered():
    names = entry.queries()
    assert all(sum(name.startswith(f"op{n}_") for name in names) == 1 for n in (11, 12, 13))
    assert {"op11_phrase_collocations", "op12_conversation_repair"} <= set(entry.oracle_sql())
