"""Chat formatting: roles of transcript lines by a hidden Markov model.

The text of a conversation is a sequence of lines.  A state is a role together
with whether the line begins a turn or goes on with it.  A line is seen through
its features: a speaker marker at its start (or the row's speaker, where a
column gives one), whether it is the first line of its row, its length and
whether it ends in a question mark.  Emissions and transitions are counted over
labelled rows; Viterbi finds the likeliest states, and every turn is rendered
as ``<|role|>``, its text and a line feed.

A conversation of any length is worked in blocks of ``BLOCK`` turn numbers, and
the result is that of one Viterbi pass: a block first yields the best score
from each state before it to each state at its end, those small matrices are
joined along a conversation, which fixes the states at the blocks' ends, and
then each block finds its own lines.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohort_spark.llm.tables import tasks_for
from cohort_spark.sources.stages import stage

#: Roles and the names that speakers go by.
ROLES = ("system", "user", "assistant")
NAMES = {"system": "system", "instructions": "system", "context": "system",
         "user": "user", "human": "user", "customer": "user", "question": "user", "q": "user", "prompter": "user",
         "assistant": "assistant", "ai": "assistant", "bot": "assistant", "model": "assistant", "gpt": "assistant",
         "answer": "assistant", "a": "assistant", "agent": "assistant"}
#: A marker's role is right so often; a row's first line begins a turn so often, another line so seldom.
MARKER_TRUST, FIRST_BEGINS, LATER_BEGINS = 0.98, 0.995, 0.02
#: Turn numbers of a block; bounds of the length classes.
BLOCK, LENGTHS = 1024, (1, 40, 160, 640)
_MARKER = re.compile(r"^\s*(?:#{1,4}\s*|<\|(?:im_start\|>)?|\[|\*\*)?\s*(" + "|".join(sorted(NAMES, key=len, reverse=True))
                     + r")\s*(?:\|>|\]|\*\*)?\s*(?::(?:\*\*)?\s?|(?<=[>\]])\s*|$)", re.IGNORECASE)


def marker(line: str) -> tuple[int, str]:
    """Number of the role that the line's marker names, 0 without one, and the line without it."""
    found = _MARKER.match(line)
    if not found:
        return 0, line
    return 1 + ROLES.index(NAMES[found[1].lower()]), line[found.end():]


def length_class(n: Column | int):
    if isinstance(n, int):
        return sum(n >= bound for bound in LENGTHS)
    return sum(((n >= bound).cast("int") for bound in LENGTHS), F.lit(0))


def _role_of(col: str) -> Column:
    """Number of the role that a speaker column names, 0 if unknown or missing."""
    out = F.lit(0)
    name = F.lower(F.trim(F.col(col)))
    for i, role in enumerate(ROLES, 1):
        out = F.when(name.isin([n for n, r in NAMES.items() if r == role]), F.lit(i)).otherwise(out)
    return out


class Model:
    """Log scores.  State 2 r begins a turn of role r, state 2 r + 1 goes on with it; the last is the start."""

    def __init__(self, lengths: np.ndarray, questions: np.ndarray, follows: np.ndarray, starts: np.ndarray):
        roles = len(ROLES)
        share = lambda x: np.log((x + 1.0) / (x + 1.0).sum(axis=-1, keepdims=True))
        self.length, self.question = share(lengths), share(questions)
        nxt, first = share(follows), share(starts)
        self.move = np.full((2 * roles + 1, 2 * roles), -np.inf)
        for r in range(roles):
            for into in range(roles):
                for s in (2 * r, 2 * r + 1):
                    self.move[s, 2 * into] = nxt[r, into]
            for s in (2 * r, 2 * r + 1):
                self.move[s, 2 * r + 1] = 0.0  # going on is weighed by the line's place in its row
            self.move[2 * roles, 2 * r] = first[r]
        wrong = (1 - MARKER_TRUST) / (roles - 1)
        self.named = np.log(np.where(np.eye(roles, dtype=bool), MARKER_TRUST, wrong))

    def emit(self, named: int, is_first: bool, length: int, question: int) -> np.ndarray:
        begins = FIRST_BEGINS if is_first or named else LATER_BEGINS
        out = np.empty(2 * len(ROLES))
        for r in range(len(ROLES)):
            x = self.length[r, length] + self.question[r, question] + (self.named[named - 1, r] if named else 0.0)
            out[2 * r], out[2 * r + 1] = x + np.log(begins), x + np.log(1 - begins)
        return out


def learn(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text", role: str = "role") -> Model:
    """Counts lengths and questions by role over lines, and which role follows which over turn numbers."""
    known = turns.select(F.col(conv).alias("c"), F.col(turn).alias("t"), F.col(text).alias("text"),
                         _role_of(role).alias("r")).where("r > 0")
    lines = known.select("r", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    seen = (lines.groupBy("r", length_class(F.length("line")).alias("length"), F.trim("line").endswith("?").alias("q"))
            .count().collect())
    lengths, questions = np.zeros((len(ROLES), len(LENGTHS) + 1)), np.zeros((len(ROLES), 2))
    for row in seen:
        lengths[row.r - 1, row.length] += row["count"]
        questions[row.r - 1, int(row.q)] += row["count"]
    ahead = known.select(F.col("c").alias("c0"), (F.col("t") + 1).alias("t0"), F.col("r").alias("before")).distinct()
    pairs = (known.select("c", "t", "r").distinct()
             .join(ahead, F.col("c").eqNullSafe(F.col("c0")) & (F.col("t") == F.col("t0")), "left")
             .groupBy("before", "r").count().collect())
    follows, starts = np.zeros((len(ROLES), len(ROLES))), np.zeros(len(ROLES))
    for row in pairs:
        if row.before is None:
            starts[row.r - 1] += row["count"]
        else:
            follows[row.before - 1, row.r - 1] += row["count"]
    return Model(lengths, questions, follows, starts)


def _lines(text: str, named: int) -> list[tuple[int, bool, str]]:
    out = []
    for i, line in enumerate(text.split("\n")):
        found, rest = marker(line)
        out.append((named if i == 0 and named else found, i == 0, rest))
    return out


def _emissions(model: Model, rows: list[tuple]) -> tuple[list[tuple[int, str]], list[np.ndarray]]:
    lines, scores = [], []
    for i, (_, text, named, _) in enumerate(rows):
        for mark, is_first, rest in _lines(text, named):
            lines.append((i, rest))
            scores.append(model.emit(mark, is_first, length_class(len(rest)), int(rest.strip().endswith("?"))))
    return lines, scores


def _blocks(work: Callable, names: list[str]):
    """A task over rows sorted by conversation and block, calling ``work`` once a block."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        out: list[list] = [[] for _ in names]

        def close() -> None:
            for values in work(now, held):
                for column, value in zip(out, values):
                    column.append(value)

        for batch in batches:
            for conv, block, *rest in zip(*[c.to_pylist() for c in batch.columns]):
                if (conv, block) != now:
                    if held:
                        close()
                    now, held = (conv, block), []
                held.append(tuple(rest))
            if len(out[0]) > 5000:
                yield batch_of(out)
                out = [[] for _ in names]
        if held:
            close()
        yield batch_of(out)

    kinds = {"conv": pa.int64(), "block": pa.int64(), "scores": pa.list_(pa.float64()), "turn": pa.int64(), "part": pa.int32(),
             "role": pa.string(), "begins": pa.bool_(), "n_lines": pa.int64(), "content": pa.string(), "speaker": pa.string(),
             "before": pa.int32(), "at_end": pa.int32(), "copies": pa.int64()}

    def batch_of(columns: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[n]) for c, n in zip(columns, names)], names=names)

    return task


def _matrix(model: Model, rows: list[tuple]) -> np.ndarray:
    """Best score from each state before the rows (the start last) to each state of their last line."""
    best = None
    for score in _emissions(model, rows)[1]:
        best = model.move + score if best is None else (best[:, :, None] + model.move[None, :-1, :]).max(axis=1) + score
    return best


def _path(model: Model, rows: list[tuple], before: int, at_end: int) -> tuple[list[tuple[int, str]], list[int]]:
    lines, scores = _emissions(model, rows)
    best, back = model.move[before] + scores[0], []
    for score in scores[1:]:
        ways = best[:, None] + model.move[:-1]
        back.append(ways.argmax(axis=0))
        best = ways.max(axis=0) + score
    states = [at_end]
    for step in reversed(back):
        states.append(int(step[states[-1]]))
    return lines, states[::-1]


def parse(turns: DataFrame, model: Model, conv: str = "conv_id", turn: str = "turn", text: str = "text",
          speaker: str | None = "role", block: int = BLOCK) -> DataFrame:
    """Recovered turns: (conv_id, turn, part, speaker, role, begins, n_lines, content, rendered, copies).

    Rows of a conversation are read in the order of turn number and text; a
    missing number comes first, a missing text is one empty line, and a missing
    conversation id is a conversation.  ``part`` counts the turns found in one
    row; ``begins`` is false where a row goes on with the turn before.  Joined
    in order, ``rendered`` is the canonical transcript.  Rows that agree in
    conversation, number, speaker and text are one row with its number of
    ``copies``.  ``speaker=None`` uses the markers in the text only.  An empty
    table gives an empty result; other columns play no part.
    """
    named = F.col(speaker) if speaker else F.lit(None).cast("string")
    rows = (turns.select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"),
                         F.coalesce(F.col(text), F.lit("")).alias("text"), named.alias("speaker"))
            .groupBy("conv", "turn", "text", "speaker").agg(F.count("*").alias("copies"))
            .withColumn("block", F.floor(F.coalesce("turn", F.lit(-1)) / block).cast("long"))
            .withColumn("named", _role_of("speaker")))
    n = tasks_for(turns.sparkSession)
    order = ["conv", "block", "turn", "text", "speaker"]
    dealt = rows.repartition(n, "conv", "block")
    sent = turns.sparkSession.sparkContext.broadcast(model)
    states = 2 * len(ROLES)

    def summary(at, held):
        yield *at, _matrix(sent.value, held).ravel().tolist()

    per_block = stage(dealt.sortWithinPartitions(*order).select("conv", "block", "turn", "text", "named", "speaker")
                      .mapInArrow(_blocks(summary, ["conv", "block", "scores"]), "conv long, block long, scores array<double>"),
                      "block_scores")

    def join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(conv, held):
            best = held[0][1][states]
            ways = []
            for _, m in held[1:]:
                step = best[:, None] + m[:states]
                ways.append(step.argmax(axis=0))
                best = step.max(axis=0)
            ends = [int(best.argmax())]
            for way in reversed(ways):
                ends.append(int(way[ends[-1]]))
            ends.reverse()
            return [(conv, b, before, end) for (b, _), before, end in zip(held, [states, *ends], ends)]

        now, held = (), []
        for batch in batches:
            out = []
            for conv, b, scores in zip(*[c.to_pylist() for c in batch.columns]):
                if (conv,) != now:
                    if held:
                        out += close(now[0], held)
                    now, held = (conv,), []
                held.append((b, np.array(scores).reshape(states + 1, states)))
            yield rows_of(out)
        if held:
            yield rows_of(close(now[0], held))

    def rows_of(out):
        conv, b, before, end = zip(*out) if out else ([], [], [], [])
        return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(b, pa.int64()), pa.array(before, pa.int32()),
                                           pa.array(end, pa.int32())], names=["conv", "block", "before", "at_end"])

    fixed = stage(per_block.repartition(n, "conv").sortWithinPartitions("conv", "block")
                  .mapInArrow(join_blocks, "conv long, block long, before int, at_end int"), "block_ends")
    fixed = fixed.withColumnsRenamed({"conv": "_c", "block": "_b"})

    def lines(at, held):
        model, before, at_end = sent.value, held[0][4], held[0][5]
        found, path = _path(model, [row[:4] for row in held], before, at_end)
        at_line = 0
        for i, row in enumerate(held):
            parts: list[list] = []
            while at_line < len(found) and found[at_line][0] == i:
                state, line = path[at_line], found[at_line][1]
                if not parts or state % 2 == 0:
                    parts.append([ROLES[state // 2], state % 2 == 0, []])
                parts[-1][2].append(line)
                at_line += 1
            for k, (role, begins, content) in enumerate(parts):
                yield at[0], row[0], k, row[3], role, begins, len(content), "\n".join(content), row[6]

    ready = (rows.join(fixed, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b")))
             .repartition(n, "conv", "block").sortWithinPartitions(*order)
             .select("conv", "block", "turn", "text", "named", "speaker", "before", "at_end", "copies"))
    done = ready.mapInArrow(
        _blocks(lines, ["conv", "turn", "part", "speaker", "role", "begins", "n_lines", "content", "copies"]),
        "conv long, turn long, part int, speaker string, role string, begins boolean, n_lines long, content string, copies long")
    head = F.when(F.col("begins"), F.concat(F.lit("<|"), "role", F.lit("|>\n"))).otherwise(F.lit(""))
    return done.select(F.col("conv").alias("conv_id"), "turn", "part", "speaker", "role", "begins", "n_lines", "content",
                       F.concat(head, "content", F.lit("\n")).alias("rendered"), "copies")
