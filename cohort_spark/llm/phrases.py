"""Phrase collocations, mined by partitions (SON) and counted exactly.

A phrase found ``support`` times in all is found at least ``support`` times the
share of the words in one shard at least, whatever the shards are.  So every
shard (a task's run of documents of bounded size) is mined on its own at that
lowered support, level by level: a phrase is counted only if its shorter parts
stand.  The union of what the shards report is a superset of all frequent
phrases; a second reading counts just these, over all documents.

Shards report counts, not names.  A shard that stays silent on a phrase holds at
most its local support less one of it, so a reported phrase whose counts plus
that slack of all silent shards stay below the support is no candidate.  The
slack is found in a first, cheap reading that cuts the same shards, and checked
against what the mining itself reports; should the cuts ever differ, mining runs
again with the larger slack.

Words and pairs go first; their exact counts then prune the triples and fours in
every shard.  Candidates reach the second reading as a filter of hash bits of
bounded size, which lets a few others through; these are counted exactly, too,
and fall at the support.  Counts there are by the words themselves, not by hash.

The support is a fixed number, so beyond ``SUPPORT`` shards of a language the
lowered support is a single occurrence: a shard then reports whatever it holds
and only the union prunes.  That is the method's limit, not a switch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohort_spark.llm.tables import tasks_for
from cohort_spark.sources.stages import stage

#: Occurrences a candidate has; words of the longest; percent at which a longer one absorbs it; phrases listed a language.
SUPPORT, LONGEST, ABSORB, LISTED = 30, 4, 80, 2000
#: Rows of a batch that a task sends; candidates of a length that it counts before it sends them.
SENT, TALLIED = 1 << 16, 300_000
#: Words of a shard; bytes worked at a time; bits of the candidates' filter (16 MB) and bits for each of them.
SHARD_WORDS, RUN_BYTES, MOST_BITS, BITS_EACH = 500_000, 1 << 20, 1 << 27, 16

_U = np.uint64
_BASE, _MIX = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9)
_BREAKS, _BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By byte: whether it parts words, whether it parts pieces, and a random number (one for both cases of A-Z)."""
    gap, cut = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
    gap[list(_BREAKS + _BLANKS)] = True
    cut[list(_BREAKS)] = True
    number = np.array([xxhash.xxh64_intdigest(bytes([b]).lower(), 7) for b in range(256)], dtype=np.uint64)
    return gap, cut, number


_GAP, _CUT, _NUMBER = _tables()
_LOWER = np.array([bytes([b]).lower()[0] for b in range(256)], dtype=np.uint8)


class _Words:
    """Words of a batch of texts: where they lie, their hashes, their pieces and documents."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string())
        bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        self.data = np.frombuffer(raw, dtype=np.uint8)[bounds[0]:bounds[-1]] if raw is not None and len(texts) else np.zeros(0, np.uint8)
        bounds = bounds - bounds[0] if len(bounds) else bounds
        inside = np.ones(len(self.data) + 2, dtype=bool)
        inside[[0, -1]] = False
        inside[1:-1] = ~_GAP[self.data]
        step = np.diff(inside.view(np.int8))
        begins, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        # a text's end parts words, too
        inner = bounds[1:-1]
        inner = np.unique(inner[(inner > 0) & (inner < len(self.data))])
        inner = inner[inside[inner] & inside[inner + 1]]
        if len(inner):
            begins, ends = np.sort(np.concatenate([begins, inner])), np.sort(np.concatenate([ends, inner]))
        self.begins, self.ends = begins, ends
        self.doc = np.searchsorted(bounds[1:], begins, side="right")
        self.piece = np.searchsorted(np.flatnonzero(_CUT[self.data]), begins) + self.doc

    def joined(self, words: np.ndarray) -> pa.Array:
        """Rows of word numbers as texts with a blank between words, A-Z lowered."""
        flat = words.ravel()
        sizes = self.ends[flat] - self.begins[flat]
        # each word is followed by a blank, which the text after a row's last word leaves out
        place = np.cumsum(sizes + 1) - sizes - 1
        out = np.full(int(sizes.sum()) + len(flat), 32, dtype=np.uint8)
        shift = np.repeat(np.arange(len(flat)), sizes)
        at = np.arange(len(shift)) + shift
        out[at] = _LOWER[self.data[at + np.repeat(self.begins[flat] - place, sizes)]]
        bounds = np.concatenate([place[::words.shape[1]], [len(out)]]).astype(np.int64)
        whole = pa.LargeStringArray.from_buffers(len(words), pa.py_buffer(bounds), pa.py_buffer(out))
        return pc.utf8_slice_codeunits(whole, 0, -1).cast(pa.string())

    def hashes(self) -> np.ndarray:
        """A polynomial of each word's bytes modulo 2^64, finally mixed."""
        out = np.zeros(len(self.begins), dtype=np.uint64)
        at = 0
        while at < len(out):
            start = self.begins[at]
            end = max(at + 1, np.searchsorted(self.ends, start + RUN_BYTES, side="right"))
            powers = np.multiply.accumulate(np.concatenate([[_U(1)], np.full(self.ends[end - 1] - start, _BASE)]))
            sums = np.concatenate([[_U(0)], np.cumsum(_NUMBER[self.data[start:self.ends[end - 1]]] * powers[:-1], dtype=np.uint64)])
            b, e = self.begins[at:end] - start, self.ends[at:end] - start
            # the same word further right has a larger power; bring all to one
            back = _U(pow(pow(int(_BASE), -1, 1 << 64), len(powers) - 1, 1 << 64))
            out[at:end] = (sums[e] - sums[b]) * powers[len(powers) - 1 - b] * back
            at = end
        return _mixed(out)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _MIX
    return h ^ (h >> _U(27))


class _Shard:
    """Words of one shard, and its phrases of each length by hash."""

    def __init__(self, langs: dict[str, tuple[int, int]]):
        self.langs, self.runs, self.parts, self.starts, self.last = langs, [], [], [0], 0

    @property
    def size(self) -> int:
        return self.starts[-1]

    def add(self, words: _Words, codes: np.ndarray) -> None:
        """Words after those held; their pieces are others."""
        code = codes[words.doc]
        if len(code):
            pieces = words.piece + self.last
            self.runs.append((_mixed(words.hashes() ^ (code.astype(np.uint64) * _BASE)), pieces, code))
            self.last = pieces[-1] + 1
            self.parts.append(words)
            self.starts.append(self.size + len(code))
            del words.piece, words.doc

    def close(self) -> None:
        self.h, self.piece, self.code = map(np.concatenate, zip(*self.runs))
        self.runs = None
        self.gram = {1: self.h}
        held = np.bincount(self.code, minlength=len(self.langs))
        totals = np.ones(len(self.langs), dtype=np.int64)
        for code, n in self.langs.values():
            totals[code] = max(1, n)
        self.support = local_support(held, totals)

    def grams(self, k: int) -> np.ndarray:
        if k not in self.gram:
            before = self.grams(k - 1)
            self.gram[k] = _mixed((before[:-1] * _BASE) ^ self.h[k - 1:])
        return self.gram[k]

    def whole(self, k: int) -> np.ndarray:
        """Which k words in a row lie in one piece."""
        return self.piece[:max(0, self.size - k + 1)] == self.piece[k - 1:]

    def frequent(self, k: int, allowed: np.ndarray):
        """Keys of length k among ``allowed`` places that reach the local support, their counts, codes and places."""
        at = np.flatnonzero(allowed)
        keys, first, inverse, n = np.unique(self.grams(k)[at], return_index=True, return_inverse=True, return_counts=True)
        often = n >= self.support[self.code[at[first]]]
        stands = np.zeros(len(allowed), dtype=bool)
        stands[at] = often[inverse]
        return keys[often], n[often], self.code[at[first]][often], stands

    def phrases(self, places: np.ndarray, k: int) -> pa.Array:
        """The words at some places, single blanks between them, A-Z lowered."""
        order = np.argsort(places, kind="stable")
        cuts = np.searchsorted(places[order], self.starts)
        found = [pa.array([], pa.string())]
        for part, start, begin, end in zip(self.parts, self.starts, cuts, cuts[1:]):
            if begin < end:
                found.append(part.joined((places[order[begin:end]] - start)[:, None] + np.arange(k)))
        back = np.empty(len(order), dtype=np.int64)
        back[order] = np.arange(len(order))
        return pa.concat_arrays(found).take(pa.array(back))


def local_support(held: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """The support, lowered to a shard's share of the words of each language; 1 at least."""
    return np.array([max(1, -(-SUPPORT * int(h) // int(t))) for h, t in zip(held, totals)], dtype=np.int64)


def _shards(batches: Iterator[pa.RecordBatch], langs: dict[str, tuple[int, int]], most: int) -> Iterator[_Shard]:
    """Runs of documents of some megabytes, closed once they have ``most`` words."""
    shard = _Shard(langs)
    for batch in batches:
        codes = np.array([langs.get(lang, (0, 0))[0] for lang in batch.column(1).to_pylist()], dtype=np.int32)
        sizes = pc.binary_length(batch.column(0)).to_numpy(zero_copy_only=False).cumsum()
        at = 0
        while at < len(codes):  # some megabytes of text at a time
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + 4 * RUN_BYTES, side="right")))
            shard.add(_Words(batch.column(0).slice(at, end - at)), codes[at:end])
            if shard.size >= most:
                shard.close()
                yield shard
                shard = _Shard(langs)
            at = end
    if shard.size:
        shard.close()
        yield shard


class _Filter:
    """Hash bits; a key that was put in is always found."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, _U(64 * len(bits) - 1)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), dtype=bool)
        for turn in (0, 32):
            at = (keys >> _U(turn)) & self.mask if turn == 0 else (_mixed(keys * _BASE)) & self.mask
            out &= (self.bits[(at >> _U(6)).astype(np.int64)] >> (at & _U(63))) & _U(1) == 1
        return out


def _filter_of(keys: DataFrame) -> np.ndarray:
    """The bits of a filter that holds the longs ``key``, set in tasks and brought together by words of 64."""
    n = keys.count()
    bits = 1 << max(16, min(MOST_BITS, BITS_EACH * max(1, n)).bit_length() - 1)
    mask = _U(bits - 1)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            at = np.concatenate([held & mask, _mixed(held * _BASE) & mask])
            yield pa.RecordBatch.from_pydict({"word": (at >> _U(6)).view(np.int64),
                                              "bit": (_U(1) << (at & _U(63))).view(np.int64)})

    words = (keys.select("key").mapInArrow(task, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits"))).toArrow()
    table = np.zeros(bits // 64, dtype=np.uint64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return table


def _allowed(shard: _Shard, k: int, stands: dict[int, np.ndarray], pairs: _Filter | None) -> np.ndarray:
    """Places where a phrase of k words may be frequent, by its parts."""
    ok = shard.whole(k)
    if k == 3 and pairs is not None and len(ok):
        stands[2] = shard.whole(2)
        stands[2][stands[2]] = pairs.holds(shard.grams(2)[stands[2]])
    if k - 1 in stands and len(ok):
        ok = ok & stands[k - 1][:-1] & stands[k - 1][1:]
    return ok


_MINED = "k int, code int, key long, n long"


def _mine(langs, most: int, lengths: tuple[int, ...], sent):
    """Locally frequent phrases of each shard, with their count above what a silent shard may hide; the slack as k = 0."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = _Filter(sent.value) if sent is not None else None
        for shard in _shards(batches, langs, most):
            yield from _mined(np.zeros(len(shard.support), np.int64), np.arange(len(shard.support)), shard.support - 1, 0)
            stands: dict[int, np.ndarray] = {}
            for k in lengths:
                keys, n, code, stands[k] = shard.frequent(k, _allowed(shard, k, stands, pairs))
                shard.gram.pop(k - 2, None)
                yield from _mined(keys.view(np.int64), code, n - shard.support[code] + 1, k)
    return task


def _mined(keys, code, n, k) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(keys), SENT):
        part = slice(at, at + SENT)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(keys[part]), k, np.int32)), pa.array(code[part].astype(np.int32)),
             pa.array(keys[part], pa.int64()), pa.array(n[part].astype(np.int64))], names=["k", "code", "key", "n"])


class _Tally:
    """Counts of candidates over the shards of a task, each with its words once."""

    def __init__(self, k: int):
        self.k = k
        self.clear()

    def clear(self) -> None:
        self.keys, self.counts, self.codes = (np.zeros(0, dtype=t) for t in (np.uint64, np.int64, np.int32))
        self.texts = pa.array([], pa.string())

    def add(self, shard: _Shard, keys: np.ndarray, n: np.ndarray, places: np.ndarray) -> None:
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), dtype=bool)
        self.counts[at[known]] += n[known]
        new = ~known
        if new.any():
            keys_ = np.concatenate([self.keys, keys[new]])
            order = np.argsort(keys_, kind="stable")
            self.keys, self.counts = keys_[order], np.concatenate([self.counts, n[new]])[order]
            self.codes = np.concatenate([self.codes, shard.code[places[new]]])[order].astype(np.int32)
            self.texts = pa.concat_arrays([self.texts, shard.phrases(places[new], self.k)]).take(pa.array(order))

    def rows(self) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.keys), SENT):
            part = slice(at, at + SENT)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(self.keys[part]), self.k, np.int32)), pa.array(self.codes[part]), self.texts[part],
                 pa.array(self.keys[part].view(np.int64)), pa.array(self.counts[part])], names=["k", "code", "phrase", "key", "n"])
        self.clear()


def _count(langs, most: int, lengths: tuple[int, ...], sent):
    """Occurrences of the candidates in each task, by their words."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = _Filter(sent.value)
        tallies = {k: _Tally(k) for k in lengths}
        for shard in _shards(batches, langs, most):
            for k, tally in tallies.items():
                at = np.flatnonzero(shard.whole(k))
                at = at[wanted.holds(shard.grams(k)[at])]
                keys, first, n = np.unique(shard.grams(k)[at], return_index=True, return_counts=True)
                tally.add(shard, keys, n, at[first])
                if len(tally.keys) > TALLIED:
                    yield from tally.rows()
        for tally in tallies.values():
            yield from tally.rows()
    return task


def _sizes(most: int):
    """Words of each shard by language."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[int, int]] = {}

        def named(batches):
            for batch in batches:
                for lang in batch.column(1).unique().to_pylist():
                    held.setdefault(lang, (len(held), 0))
                yield batch

        for number, shard in enumerate(_shards(named(batches), held, most)):
            n = np.bincount(shard.code, minlength=len(held)).tolist()
            yield pa.RecordBatch.from_pydict({"lang": pa.array(list(held), pa.string()),
                                              "words": pa.array([n[code] for code, _ in held.values()], pa.int64())})
    return task


def _round(docs: DataFrame, langs, most: int, slack: dict[int, int], lengths: tuple[int, ...], pairs) -> DataFrame:
    """Exact counts of all phrases of these lengths that reach the support: mine, unite, count."""
    spark = docs.sparkSession
    while True:
        hidden = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for item in slack.items() for v in item]), F.col("code")), F.lit(0))
        # a shard reports each phrase once, so there is nothing to combine before the shuffle
        reports = docs.mapInArrow(_mine(langs, most, lengths, pairs), _MINED).repartition(tasks_for(spark), "key")
        mined = stage(reports.groupBy("k", "code", "key").agg(F.sum("n").alias("n"))
                      .where((F.col("k") == 0) | (F.col("n") + hidden >= SUPPORT)), "mined")
        found = {r.code: r.n for r in mined.where("k = 0").groupBy("code").agg(F.sum("n").alias("n")).collect()}
        if all(n <= slack.get(code, 0) for code, n in found.items()):
            break
        slack.update({code: max(n, slack.get(code, 0)) for code, n in found.items()})
    wanted = spark.sparkContext.broadcast(_filter_of(mined.where("k > 0")))
    return stage(docs.mapInArrow(_count(langs, most, lengths, wanted), "k int, code int, phrase string, key long, n long")
                 .groupBy("k", "code", "phrase", "key").agg(F.sum("n").alias("f")).where(F.col("f") >= SUPPORT), "frequent")


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang",
                     shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame]:
    """(lang, k, phrase, f) of every phrase of 1 to ``LONGEST`` words with ``SUPPORT`` occurrences, and (lang, n) words.

    Missing texts are empty, a missing language is ``und``; a table without
    words gives none.  Rows count as often as they are there.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(lang), F.lit("und")).alias("lang"))
    sizes = stage(docs.mapInArrow(_sizes(shard_words), "lang string, words long"), "sizes")
    totals = sizes.groupBy("lang").agg(F.sum("words").alias("n"))
    share = F.greatest(F.lit(1), F.ceil(F.lit(SUPPORT) * F.col("words").cast("decimal(20,0)") / F.greatest("n", F.lit(1)))) - 1
    # one row a language comes to the driver, as the codes that tasks use
    rows = (sizes.join(totals, "lang").groupBy("lang").agg(F.first("n").alias("n"), F.sum(share).cast("long").alias("slack"))
            .orderBy("lang").collect())
    langs = {r.lang: (code, r.n) for code, r in enumerate(rows)}
    slack = {code: r.slack for code, r in enumerate(rows)} or {0: 0}
    short = _round(docs, langs, shard_words, dict(slack), (1, 2), None)
    pairs = spark.sparkContext.broadcast(_filter_of(short.where("k = 2")))
    long = _round(docs, langs, shard_words, dict(slack), tuple(range(3, LONGEST + 1)), pairs)
    names = spark.createDataFrame([(code, name) for name, (code, _) in langs.items()], "code int, lang string")
    return (short.union(long).join(names, "code").select("lang", "k", "phrase", "f"), totals.where("n > 0"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", listed: int = LISTED,
                 shard_words: int = SHARD_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language.

    The score of a phrase is that of its lowest cut, ``2000000 a / (l + r)``
    rounded down.  A phrase within a longer one that is nearly as frequent goes.
    Ties go by frequency, then by the bytes of the phrase.
    """
    frequent, totals = frequent_phrases(docs, text, lang, shard_words)
    f = stage(frequent, "phrases")
    words = F.split("phrase", " ")
    several = f.where("k > 1").select("lang", "k", "phrase", F.col("f").alias("a"), words.alias("words"))
    joined = lambda begin, n: F.array_join(F.slice("words", begin, n), " ")
    cuts = (several.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
            .select("lang", "phrase", "a", "cut", joined(F.lit(1), F.col("cut")).alias("left"),
                    joined(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right")))
    part = lambda name, count: f.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    scored = (cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
              # as decimals: the product may pass 64 bits, the quotient is two million at most
              .withColumn("score", F.expr("cast(a as decimal(25,0)) * cast(2000000 as decimal(7,0)) div cast(l + r as decimal(20,0))")))
    best = scored.groupBy("lang", "phrase").agg(F.min_by(F.struct("a", "l", "r", "score"), F.struct("score", "cut")).alias("best"))
    within = (several.where("k > 2").select("lang", "words", "a", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("size"), "k")
              .select("lang", "words", "a", "size", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)).alias("begin"))
              .select("lang", joined(F.col("begin"), F.col("size")).alias("phrase"), "a")
              .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    kept = (best.join(within, ["lang", "phrase"], "left").select("lang", "phrase", "best.*", "longer")
            .where(F.expr(f"longer is null or 100 * cast(longer as decimal(20,0)) < {ABSORB} * cast(a as decimal(20,0))")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return (kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= listed)
            .join(totals, "lang")
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score")))


COLLOCATIONS_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
worded as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') as w from pieces),
totals as (select lang, sum(len(w)) as n from worded group by lang),
grams as (
  select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase
  from worded, (select unnest([1, 2, 3, 4]) as k) where len(w) >= k),
f as (select lang, k, phrase, count(*) as f from grams group by all having count(*) >= 30),
cand as (select lang, k, phrase, f as a, string_split(phrase, ' ') as w from f where k > 1),
cuts as (select lang, phrase, a, w, k, unnest(range(1, k)) as cut from cand),
scored as (
  select c.lang, c.phrase, c.a, c.cut, x.f as l, y.f as r, (2000000::hugeint * c.a) // (x.f + y.f) as score
  from cuts c
  join f x on x.lang = c.lang and x.phrase = array_to_string(c.w[1:c.cut], ' ')
  join f y on y.lang = c.lang and y.phrase = array_to_string(c.w[c.cut + 1:], ' ')),
best as (select *, row_number() over (partition by lang, phrase order by score, cut) as place from scored),
sizes as (select lang, w, a, k, unnest(range(2, k)) as size from cand where k > 2),
within as (
  select lang, phrase, max(a) as longer from (
    select lang, a, unnest(list_transform(range(1, k - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) as phrase from sizes)
  group by all),
kept as (
  select b.* from best b left join within w on w.lang = b.lang and w.phrase = b.phrase
  where place = 1 and (w.longer is null or 100::hugeint * w.longer < 80::hugeint * b.a)),
placed as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select p.lang, p.rank, p.phrase, p.a, p.l, p.r, t.n::bigint as n, p.score::bigint as score
from placed p join totals t on t.lang = p.lang where p.rank <= 2000
"""
