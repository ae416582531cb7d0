"""Chat formatting: transcripts to canonical turns by a hidden Markov model.

A transcript is a run of lines. The hidden state of a line is its role and whether it begins a turn,
goes on with one or is blank; what is seen of it is its speaker marker and a few coarse features.
Markers may be missing or name the wrong speaker. Viterbi recovers the states, begun lines open
turns, and turns are rendered in one canonical form.

A conversation of any length is cut into segments of ``SEGMENT`` positions. Each gives a max-plus
matrix (best path from any state before it to any state at its end); their products along the
conversation fix the states at the cuts, after which segments are decoded on their own. The result
equals Viterbi over the whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .common import ensure_workers, materialise

ROLES = ("system", "user", "assistant")
BEGIN, INNER, BLANK = range(3)
STATES = tuple((r, k) for r in range(len(ROLES)) for k in (BEGIN, INNER, BLANK))
N = len(STATES)
# Names that mark a speaker, by role.
NAMES = {"system": ("system", "instructions"), "user": ("user", "human", "question", "prompter", "q"), "assistant": ("assistant", "ai", "bot", "answer", "gpt", "a")}
_ROLE_OF = {n: ROLES.index(r) for r, ns in NAMES.items() for n in ns}
_MARKER = re.compile(r"\s*(?:#{1,3}\s*|\*\*|<\|(?:im_start\|>)?|\[)?(" + "|".join(sorted(_ROLE_OF, key=len, reverse=True)) + r")(?:\*\*:|:\*\*|\|>|\]:?|:)(?:\s|$)\s*", re.IGNORECASE)
SEGMENT = 512
#: Share of turns without a marker and with a wrong one where nothing is known of it, and of inner
#: lines that look like a marker.
UNMARKED, WRONG, FALSE_MARK = 0.1, 0.02, 0.002
FEATURES = 24


def marker(line: str) -> tuple[int, str]:
    """(role or -1, the line without its marker)."""
    m = _MARKER.match(line)
    return (_ROLE_OF[m[1].lower()], line[m.end() :]) if m else (-1, line)


def feature(line: str) -> int:
    """A coarse look at a line: length class, question, list or code, blank."""
    s = line.strip()
    if not s:
        return 0
    shape = 1 if s.endswith("?") else 2 if s[:2] in ("- ", "* ") or s[:1].isdigit() or s.startswith("```") else 0
    return 1 + shape * 5 + min(len(s).bit_length() // 2, 4)


class Model:
    """Log probabilities: start, transition between line states, features of a line by state."""

    def __init__(self, start: np.ndarray, move: np.ndarray, look: np.ndarray, unmarked: float = UNMARKED, wrong: float = WRONG):
        norm = lambda x: np.log(x / x.sum(-1, keepdims=True))
        self.start, self.move, self.look = norm(start), norm(move), norm(look)
        n = len(ROLES)
        mark = np.empty((N, n + 1))  # column n: no marker
        for s, (r, kind) in enumerate(STATES):
            miss = (1 - unmarked) * wrong / (n - 1) if kind == BEGIN else FALSE_MARK / n
            mark[s] = [*[miss] * n, unmarked if kind == BEGIN else 1 - FALSE_MARK]
            if kind == BEGIN:
                mark[s, r] = (1 - unmarked) * (1 - wrong)
        self.mark = np.log(mark)

    def emit(self, lines: list[str]) -> np.ndarray:
        seen = [(marker(x), x) for x in lines]
        return self.mark[:, [m for (m, _), _ in seen]].T + self.look[:, [feature(rest) for (_, rest), _ in seen]].T

    def matrix(self, e: np.ndarray, opening: bool) -> np.ndarray:
        """Best log score from a state before the lines (a row; any, for an opening) to one at their end."""
        best = np.full((N, N), -np.inf)
        if opening:
            best[:] = (self.start + e[0])[None, :]
        else:
            best = self.move + e[0][None, :]
        for x in e[1:]:
            best = (best[:, :, None] + self.move[None, :, :]).max(1) + x[None, :]
        return best

    def decode(self, e: np.ndarray, before: int | None, after: int | None) -> list[int]:
        """Viterbi with the state before the lines and the one at their end given, where known."""
        score = (self.start if before is None else self.move[before]) + e[0]
        back = []
        for x in e[1:]:
            way = score[:, None] + self.move
            back.append(way.argmax(0))
            score = way.max(0) + x
        s = int(score.argmax()) if after is None else after
        path = [s]
        for b in reversed(back):
            s = int(b[s])
            path.append(s)
        return path[::-1]


def state_of(role: int, i: int, line: str) -> int:
    """The state of a turn's line number ``i``."""
    return STATES.index((role, BEGIN if i == 0 else INNER if line.strip() else BLANK))


def default_model() -> Model:
    start = np.full(N, 0.01)
    start[[0, 3, 6]] = 3.0, 6.0, 1.0
    move, look = np.full((N, N), 0.02), np.full((N, FEATURES), 0.01)
    for s, (r, kind) in enumerate(STATES):
        look[s, 0 if kind == BLANK else slice(None)] = 1.0
        move[s, [r * 3 + INNER, r * 3 + BLANK]] = 3.0, 1.0
        for o in range(1, 3):
            if o != r:
                move[s, o * 3 + BEGIN] = 1.0
    return Model(start, move, look)


def fit(turns: DataFrame, unmarked: float | None = None, wrong: float = WRONG, blank: bool = False) -> Model:
    """Count starts, changes of role, line features and steps from line to line over all role-marked
    turns; what comes back is a fixed number of cells. A turn follows the one numbered one less; null
    turns only give lines. ``unmarked`` and ``wrong``: shares of turns whose marker is missing (the
    share without a role by default) or another's; ``blank``: a blank line ends a turn."""
    ensure_workers(turns.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[tuple[str, int, int], int] = {}
        for b in batches:
            for role, text in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("role", "text")), strict=True):
                lines = [*(text or "").split("\n"), *([""] if blank else [])]
                path = [state_of(ROLES.index(role), i, x) for i, x in enumerate(lines)]
                found = [("look", s, feature(x)) for s, x in zip(path, lines, strict=True)]
                found += [("step", s, o) for s, o in zip(path, path[1:], strict=False)]
                for k in [*found, ("end", path[-1], 0)]:
                    cells[k] = cells.get(k, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in cells], pa.string()), pa.array([k[1] for k in cells], pa.int32()), pa.array([k[2] for k in cells], pa.int32()), pa.array(list(cells.values()), pa.int64())], names=["what", "i", "j", "n"])

    known = turns.where(F.col("role").isin(*ROLES))
    cells = known.select("role", "text").mapInArrow(tk.lean(run), "what string, i int, j int, n bigint").groupBy("what", "i", "j").agg(F.sum("n").alias("n")).collect()
    seat = known.where("conv_id is not null and turn is not null").select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role").distinct()
    after = seat.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("prev"))
    moves = seat.join(after, ["conv_id", "turn"], "left").groupBy("prev", "role").count().collect()
    if not cells:
        return default_model()
    if unmarked is None:
        n, bare = turns.agg(F.count("*"), F.count_if(F.col("role").isNull())).first()
        unmarked = (bare + 1) / (n + 2)
    start, look, turn = np.full(N, 0.01), np.full((N, FEATURES), 0.5), np.full((3, 3), 0.5)
    step, end = np.full((N, N), 1e-6), np.full(N, 0.01)
    for s, (r, kind) in enumerate(STATES):
        start[s] = 0.05 if kind == BEGIN else 0.01
        step[s, [r * 3 + INNER, r * 3 + BLANK]] = 0.01  # a turn may go on
        if kind == BLANK:
            look[s], look[s, 0] = 1e-3, 1.0
    for c in cells:
        if c.what == "end":
            end[c.i] += c.n
        else:
            (look if c.what == "look" else step)[c.i, c.j] += c.n
    for c in moves:
        if c.prev is None:
            start[ROLES.index(c.role) * 3] += c["count"]
        else:
            turn[ROLES.index(c.prev), ROLES.index(c.role)] += c["count"]
    for s, (r, _) in enumerate(STATES):
        for o in range(3):
            step[s, o * 3 + BEGIN] += end[s] * turn[r, o] / turn[r].sum()
    return Model(start, step, look, unmarked, wrong)


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], cols: tuple[str, ...]):
    """Consecutive rows of equal keys, across batches."""
    held, last = [], None
    for b in batches:
        for row in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in (*keys, *cols)), strict=True):
            k = row[: len(keys)]
            if held and k != last:
                yield last, held
                held = []
            last = k
            held.append(row[len(keys) :])
    if held:
        yield last, held


def parse(chunks: DataFrame, model: Model, segment: int = SEGMENT) -> DataFrame:
    """``chunks(conv_id, turn, text)`` are the pieces of transcripts in order; where one turn of the
    talk ends and the next begins is read from the lines alone. Returns one row per recovered turn:
    ``conv_id, turn_no`` (from 0)``, role, content``.

    Pieces of a conversation are ordered by turn (nulls first), then text; equal pieces of one turn
    number count once, those without a number each; a null text is an empty line; a null conv_id is a
    conversation of its own. Empty input, empty result.

    Pieces are numbered through in that order over all conversations, and a segment is ``segment``
    numbers, whatever their turns are.
    """
    ensure_workers(chunks.sparkSession)
    own = F.when(F.col("turn").isNull(), F.monotonically_increasing_id()).alias("own")
    rows = chunks.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("text", F.lit("")).alias("text"), own).distinct()
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "text", "own")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "text", F.monotonically_increasing_id().alias("pos"))
    rows = materialise(rows, "pieces").withColumn("seg", F.floor(F.col("pos") / F.lit(segment)).cast("bigint"))
    whole = rows.groupBy(F.col("conv_id").alias("whole_id")).agg(F.min("seg").alias("first"), F.max("seg").alias("last"))
    cut = rows.join(whole.where("first <> last"), F.col("conv_id").eqNullSafe(F.col("whole_id"))).select("conv_id", "seg", "pos", "text", (F.col("seg") == F.col("first")).alias("opening"))

    def matrices(batches):
        for (conv, seg), rs in _runs(batches, ("conv_id", "seg"), ("text", "opening")):
            m = model.matrix(model.emit([x for t, _ in rs for x in t.split("\n")]), rs[0][1])
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([seg], pa.int64()), pa.array([m.tobytes()], pa.binary())], names=["conv_id", "seg", "m"])

    def ends(batches):
        for (conv,), rs in _runs(batches, ("conv_id",), ("seg", "m")):
            ms = [np.frombuffer(m, np.float64).reshape(N, N) for _, m in rs]
            score, back = ms[0][0], []
            for m in ms[1:]:
                way = score[:, None] + m
                back.append(way.argmax(0))
                score = way.max(0)
            at = [int(score.argmax())]
            for b in reversed(back):
                at.append(int(b[at[-1]]))
            at = at[::-1]
            yield pa.RecordBatch.from_arrays([pa.array([conv] * len(rs), pa.int64()), pa.array([r[0] for r in rs], pa.int64()), pa.array([None, *at[:-1]], pa.int32()), pa.array(at, pa.int32())], names=["conv_id", "seg", "before", "after"])

    m = cut.repartition("conv_id", "seg").sortWithinPartitions("conv_id", "seg", "pos").mapInArrow(tk.lean(matrices), "conv_id bigint, seg bigint, m binary")
    fixed = m.repartition("conv_id").sortWithinPartitions("conv_id", "seg").mapInArrow(tk.lean(ends), "conv_id bigint, seg bigint, before int, after int")
    fixed = fixed.withColumnsRenamed({"conv_id": "fixed_id", "seg": "fixed_seg"})
    joined = rows.join(fixed, F.col("conv_id").eqNullSafe(F.col("fixed_id")) & (F.col("seg") == F.col("fixed_seg")), "left").select("conv_id", "seg", "pos", "text", "before", "after")

    def decode(batches):
        for (conv, seg), rs in _runs(batches, ("conv_id", "seg"), ("text", "before", "after")):
            lines = [x for t, _, _ in rs for x in t.split("\n")]
            path = model.decode(model.emit(lines), rs[0][1], rs[0][2])
            roles: list[int] = []
            begun: list[int] = []  # turns begun up to each piece
            parts: list[list[str]] = []
            for i, (s, line) in enumerate(zip(path, lines, strict=True)):
                role, kind = STATES[s]
                opens = kind == BEGIN or (i == 0 and rs[0][1] is None)
                if opens or not parts:
                    roles.append(role)
                    begun.append((begun[-1] if begun else 0) + opens)
                    parts.append([])
                named, rest = marker(line)
                parts[-1].append(rest if kind == BEGIN and named >= 0 else line)  # a wrong marker goes too
            n = len(parts)
            yield pa.RecordBatch.from_arrays([pa.array([conv] * n, pa.int64()), pa.array([seg] * n, pa.int64()), pa.array(begun, pa.int64()), pa.array([ROLES[r] for r in roles], pa.string()), pa.array(["\n".join(p) for p in parts], pa.string())], names=["conv_id", "seg", "begun", "role", "piece"])

    pieces = joined.repartition("conv_id", "seg").sortWithinPartitions("conv_id", "seg", "pos").mapInArrow(tk.lean(decode), "conv_id bigint, seg bigint, begun bigint, role string, piece string")
    pieces = materialise(pieces, "turns")
    # turns begun in earlier segments of the conversation: a row per segment
    ahead = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    before = pieces.groupBy("conv_id", "seg").agg(F.max("begun").alias("n")).select(F.col("conv_id").alias("c"), F.col("seg").alias("s"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("n0"))
    numbered = pieces.join(before, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("seg") == F.col("s"))).select("conv_id", "seg", "role", "piece", (F.col("n0") + F.col("begun") - 1).alias("turn_no"))
    # a turn's pieces are one per segment that it reaches into
    turns = numbered.groupBy("conv_id", "turn_no").agg(F.min_by("role", "seg").alias("role"), F.sort_array(F.collect_list(F.struct("seg", "piece"))).alias("p"))
    return turns.select("conv_id", "turn_no", "role", F.array_join("p.piece", "\n").alias("content"))


def trimmed():
    return F.btrim(F.col("content"), F.lit(" \t\r\n"))


def rendered():
    """The canonical form of a turn."""
    return F.concat(F.lit("<|im_start|>"), F.col("role"), F.lit("\n"), trimmed(), F.lit("<|im_end|>\n"))


#: Of the query's transcripts: one turn in eight has no marker, nearly one in sixteen another's.
CYCLE, MISSING, MISNAMED = 8, 0, 4
# The speaker that a misnamed turn is given to.
MISNAMES = {"user": "Assistant", "assistant": "System", "system": "Assistant"}


def transcripts(turns: DataFrame, noisy: bool = False) -> DataFrame:
    """A stored conversation as plain text: a turn with a role has a marker, one without has none.

    ``noisy``: as transcripts are found. A blank line ends each turn; by a hash of the conversation,
    every ``CYCLE``-th turn lost its marker, and in half of the conversations another of them, four
    turns on, bears the name of somebody else (a user's turn only from the third turn on)."""
    text = F.coalesce("text", F.lit(""))
    if not noisy:
        return turns.select("conv_id", "turn", F.when(F.col("role").isNull(), text).otherwise(F.concat(F.initcap("role"), F.lit(": "), text)).alias("text"))
    h = F.xxhash64(F.lit(17), "conv_id")
    at = F.pmod(F.coalesce(F.col("turn").cast("bigint"), F.lit(0)) + F.pmod(h, F.lit(CYCLE)), F.lit(CYCLE))
    misnamed = (at == MISNAMED) & (F.pmod(F.shiftright(h, 8), F.lit(2)) == 0) & ((F.col("role") != "user") | (F.col("turn") >= 2))
    name = F.when(misnamed, F.coalesce(F.create_map(*[F.lit(x) for kv in MISNAMES.items() for x in kv])[F.col("role")], F.initcap("role"))).otherwise(F.initcap("role"))
    marked = F.when(F.col("role").isNull() | (at == MISSING), text).otherwise(F.concat(name, F.lit(": "), text))
    return turns.select("conv_id", "turn", F.concat(marked, F.lit("\n")).alias("text"))


def report(turns: DataFrame) -> DataFrame:
    """One row per recovered turn of every conversation: role, size and digest of its rendering. The
    transcripts parsed are the noisy ones."""
    found = parse(transcripts(turns, noisy=True), fit(turns, unmarked=1 / CYCLE, wrong=0.5 / CYCLE, blank=True))
    return found.select("conv_id", "turn_no", "role", F.length(trimmed()).cast("bigint").alias("n_chars"), F.sha2(rendered(), 256).alias("rendered_sha256"))
