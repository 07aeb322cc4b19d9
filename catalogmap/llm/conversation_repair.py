"""Cheapest repair of a conversation's structure, by a run-length min-plus DP.

A repaired conversation has the role initials ``(s?(ua)+)?``. Every row is kept (cost 0), given the role user or
assistant (2) or deleted (3); empty turns of user or assistant may be inserted anywhere (2 each). Blank and duplicate rows
must go; a truncated row that stays adds 1. Of the cheapest repairs the one with the ASCII-least string of edit
initials (D, I, K, R) is taken.

Four states suffice: nothing written yet, last a system turn, last a user turn, last an assistant turn. A row is one
of nine symbols, which is a 4 × 4 matrix of costs, and rows in a sequence are the min-plus product of their matrices. Equal
consecutive symbols are a run; a run is advanced through cached powers T^(2^k) of its matrix.

Spark sorts the rows of all conversations into ranges, so one conversation may lie over many pieces:

1. each piece is reduced to its runs and one matrix;
2. per conversation the matrices are scanned from the end: the cost still to come after each piece;
3. each piece unrolls its choices, once for each state it may be entered in;
4. per conversation those exits are followed from the start, which picks one of the four;
5. each piece writes its rows with their edits.

Steps 2 and 4 see one short row per piece. No step holds the rows of a conversation.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogmap.llm.rows import map_rows
from catalogmap.session import cut, fresh

NOTHING, SYSTEM, USER, ASSISTANT = STATES = range(4)
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
FAR = 1 << 48
Vector = tuple[int, int, int, int]
Matrix = tuple[Vector, Vector, Vector, Vector]

#: Symbol 0 must be deleted; the others are 1 + 2 · kind + truncated, with the kinds system, user, assistant, other.
INITIALS = ("s", "u", "a")
#: Cost to come after the last row: an open exchange is closed by inserted turns.
ENDED: Vector = (0, 2 * INSERT, INSERT, 0)

_SPACE, _INK = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"


def following(state: int) -> int:
    """The state after the user or assistant turn that may come next."""
    return ASSISTANT if state == USER else USER


def _ways(symbol: int, state: int) -> Iterator[tuple[str, int, int]]:
    """(edit, cost, next state) of the row itself, in ASCII order of the edits; insertions come before the row."""
    yield "D", DELETE, state
    if symbol == 0:
        return
    kind, cut_off = divmod(symbol - 1, 2)
    keeps = {0: SYSTEM if state == NOTHING else None, 1: USER if state != USER else None, 2: ASSISTANT if state == USER else None, 3: None}[kind]
    if keeps is not None:
        yield "K", TRUNCATED * cut_off, keeps
    yield "R", REROLE + TRUNCATED * cut_off, following(state)


def product(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(FAR, *(a[i][k] + b[k][j] for k in STATES)) for j in STATES) for i in STATES)


def applied(a: Matrix, v: Vector) -> Vector:
    return tuple(min(FAR, *(a[i][k] + v[k] for k in STATES)) for i in STATES)


IDENTITY: Matrix = tuple(tuple(0 if i == j else FAR for j in STATES) for i in STATES)


@cache
def _insertions() -> Matrix:
    one = [[0 if i == j else FAR for j in STATES] for i in STATES]
    for state in STATES:
        one[state][following(state)] = INSERT
    step = tuple(map(tuple, one))
    twice = product(step, step)
    return product(twice, step)  # more than three insertions lead back to a state


@cache
def power(symbol: int, k: int) -> Matrix:
    """The matrix of a run of 2^k rows, insertions before each row included."""
    if k:
        return product(power(symbol, k - 1), power(symbol, k - 1))
    rows = [[FAR] * 4 for _ in STATES]
    for state in STATES:
        for _, cost, to in _ways(symbol, state):
            rows[state][to] = min(rows[state][to], cost)
    return product(_insertions(), tuple(map(tuple, rows)))


@lru_cache(1 << 16)
def run_matrix(symbol: int, length: int) -> Matrix:
    out = IDENTITY
    for k in range(length.bit_length()):
        if length >> k & 1:
            out = product(out, power(symbol, k))
    return out


@lru_cache(1 << 16)
def _before(symbol: int, k: int, after: Vector) -> Vector:
    return applied(power(symbol, k), after)


def before_run(symbol: int, length: int, after: Vector) -> Vector:
    """Costs to come ahead of a run, from those behind it."""
    low = min(after)
    v = tuple(c - low for c in after)  # few different vectors are left, so the cache answers
    for k in range(length.bit_length()):
        if length >> k & 1:
            v = _before(symbol, k, v)
            least = min(v)
            v, low = tuple(c - least for c in v), low + least
    return tuple(min(FAR, c + low) for c in v)


@lru_cache(1 << 16)
def _row(symbol: int, state: int, after: Vector) -> tuple[str, int]:
    """The edits of one row (insertions, then its own) and the state behind it."""
    here = applied(power(symbol, 0), after)
    edits = ""
    while True:
        options = {edit: (cost + after[to], to) for edit, cost, to in _ways(symbol, state)}
        options["I"] = (INSERT + here[following(state)], following(state))
        edit = min(e for e, (cost, _) in options.items() if cost == here[state])
        edits, state = edits + edit, options[edit][1]
        if edit != "I":
            return edits, state


def _unrolled(symbol: int, k: int, state: int, after: Vector, edits: list[str]) -> int:
    """Appends the edits of a run of 2^k rows; the state behind it."""
    if k == 0:
        low = min(after)
        text, state = _row(symbol, state, tuple(c - low for c in after))
        edits.append(text)
        return state
    middle = before_run(symbol, 1 << (k - 1), after)
    state = _unrolled(symbol, k - 1, state, middle, edits)
    return _unrolled(symbol, k - 1, state, after, edits)


def unroll(symbols: bytes, lengths: list[int], state: int, after: Vector, last: bool) -> tuple[str, int]:
    """The edits of a piece that is entered in ``state``, and the state it leaves."""
    ahead = [after]
    for symbol, length in zip(reversed(symbols), reversed(lengths), strict=True):
        ahead.append(before_run(symbol, length, ahead[-1]))
    edits: list[str] = []
    for number, (symbol, length) in enumerate(zip(symbols, lengths, strict=True)):
        behind = ahead[len(symbols) - 1 - number]
        while length:
            k = length.bit_length() - 1
            length -= 1 << k
            state = _unrolled(symbol, k, state, before_run(symbol, length, behind), edits)
    if last:
        while ENDED[state]:
            edits.append("I")
            state = following(state)
    return "".join(edits), state


# ---------------------------------------------------------------------------------------------- rows to symbols


def _cells(rows: DataFrame) -> DataFrame:
    """Equal rows of a conversation as one with a count, and how often it counts as what.

    (conv_id, turn, role, text, tie, copies, blank, seen, cut_off): seen tells that role and text stand at an
    earlier turn; the second and later copies are duplicates in any case.
    """
    given = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    cells = cut(given.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies")))
    at = F.struct(F.col("turn").isNotNull().alias("set"), F.coalesce("turn", F.lit(0)).alias("turn"))
    again = cells.groupBy("conv_id", "role", "text").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first")).where("n > 1")
    again = again.select(*[F.col(c).alias(f"_{c}") for c in ("conv_id", "role", "text")], "first")
    same = cells["conv_id"].eqNullSafe(again["_conv_id"]) & (cells["role"] == again["_role"]) & (cells["text"] == again["_text"])
    return cells.join(again, same, "left").select(
        "conv_id", "turn", "role", "text", F.md5(F.concat_ws("\n", "role", "text").cast("binary")).alias("tie"), "copies",
        (~F.col("text").rlike(_INK)).alias("blank"), F.coalesce(F.col("first") < at, F.lit(False)).alias("seen"),
        (~F.col("text").rlike(rf"[.!?]{_SPACE}*\z")).alias("cut_off"),
    )


def _symbol() -> Column:
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return F.when(F.col("blank") | F.col("seen"), 0).otherwise(1 + 2 * kind + F.col("cut_off").cast("int")).cast("int")


def _placed(cells: DataFrame) -> DataFrame:
    """``cells`` with symbol, piece and place, in the order of conversations and turns (nulls first, ties by digest)."""
    order = ["conv_id", "turn", "tie"]
    ranged = cells.withColumn("symbol", _symbol()).repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(ranged.withColumn("place", F.monotonically_increasing_id()).withColumn("piece", F.spark_partition_id()))


PIECE = "conv_id long, piece int, head long, symbols binary, lengths array<long>, matrix array<long>, illegal long, first string, last string"


def _pieces(placed: DataFrame) -> DataFrame:
    """One row per conversation and piece: its runs, its matrix and its illegal neighbours."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for (conv_id, piece), group in groupby(rows, key=lambda r: (r[0], r[1])):
            symbols, lengths = bytearray(), []
            head, illegal, first, last = None, 0, None, None

            def add(symbol: int, n: int, symbols=symbols, lengths=lengths) -> None:
                if n and symbols and symbols[-1] == symbol:
                    lengths[-1] += n
                elif n:
                    symbols.append(symbol)
                    lengths.append(n)

            for _, _, place, symbol, copies, initial in group:
                head = place if head is None else head
                illegal += copies - 1 + (last is not None and f"{last}{initial}" not in ("su", "ua", "au"))
                first, last = initial if first is None else first, initial
                add(symbol, 1)
                add(0, copies - 1)  # copies are duplicates
            matrix = IDENTITY
            for symbol, length in zip(symbols, lengths, strict=True):
                matrix = product(matrix, run_matrix(symbol, length))
            yield conv_id, piece, head, bytes(symbols), lengths, [c for row in matrix for c in row], illegal, first, last

    picked = placed.select("conv_id", "piece", "place", "symbol", "copies", F.substring("role", 1, 1).alias("initial"))
    ordered = picked.repartition("conv_id", "piece").sortWithinPartitions("conv_id", "piece", "place")
    return cut(map_rows(ordered, run, PIECE))


def _ends(pieces: DataFrame) -> DataFrame:
    """(head, after, final): the costs to come behind each piece, and whether it is its conversation's last."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for _, group in groupby(rows, key=lambda r: r[0]):
            after: Vector = ENDED
            for number, (_, _, head, matrix) in enumerate(group):
                yield head, list(after), number == 0
                after = applied(tuple(tuple(matrix[4 * i : 4 * i + 4]) for i in STATES), after)

    ordered = pieces.select("conv_id", "piece", "head", "matrix").repartition("conv_id").sortWithinPartitions("conv_id", F.col("piece").desc())
    return map_rows(ordered, run, "head long, after array<long>, final boolean")


def _choices(pieces: DataFrame) -> DataFrame:
    """(conv_id, piece, head, edits, exits, illegal, first, last): edits and exit of each piece per state of entry."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv_id, piece, head, symbols, lengths, illegal, first, last, after, final in rows:
            ways = [unroll(symbols, lengths, state, tuple(after), final) for state in STATES]
            yield conv_id, piece, head, [w[0] for w in ways], [w[1] for w in ways], illegal, first, last

    both = pieces.drop("matrix").join(cut(_ends(pieces)), "head")
    both = both.select("conv_id", "piece", "head", "symbols", "lengths", "illegal", "first", "last", "after", "final")
    return cut(map_rows(both, run, "conv_id long, piece int, head long, edits array<string>, exits array<int>, illegal long, first string, last string"))


def _entries(choices: DataFrame) -> DataFrame:
    """(conv_id, head, state, illegal): the state each piece is entered in, and illegal neighbours with its border."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv_id, group in groupby(rows, key=lambda r: r[0]):
            state, before = NOTHING, None
            for _, _, head, exits, illegal, first, last in group:
                yield conv_id, head, state, illegal + (before is not None and f"{before}{first}" not in ("su", "ua", "au"))
                state, before = exits[state], last

    picked = choices.select("conv_id", "piece", "head", "exits", "illegal", "first", "last")
    ordered = picked.repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return cut(map_rows(ordered, run, "conv_id long, head long, state int, illegal long"))


def _steps(placed: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row per edit; ``chosen`` is (conv_id, piece, state, edits)."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        state, edits, at, closing = NOTHING, "", 0, 0
        for conv_id, _, place, role, text, copies, cut_off, entry, given in rows:
            if given is not None:
                state, edits, at, closing = entry, given, 0, len(given.rstrip("I"))
                continue
            step, left = 0, copies
            while at < len(edits) and (left or at >= closing):  # insertions ahead of a row are that row's
                edit = edits[at]
                at += 1
                if edit == "D":
                    yield conv_id, place, step, edit, None, None, DELETE
                elif edit == "K":
                    state = {"s": SYSTEM, "u": USER}.get(role[0], ASSISTANT)
                    yield conv_id, place, step, edit, role, text, TRUNCATED * cut_off
                else:
                    state = following(state)
                    name = "user" if state == USER else "assistant"
                    yield conv_id, place, step, edit, name, text if edit == "R" else "", INSERT if edit == "I" else REROLE + TRUNCATED * cut_off
                left -= edit != "I"
                step += 1

    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("role", "string"), ("text", "string"), ("copies", "long"), ("cut_off", "boolean"))]
    heads = chosen.select("conv_id", "piece", F.lit(-1).cast("long").alias("place"), *nothing, F.col("state").alias("entry"), "edits")
    body = placed.select("conv_id", "piece", "place", "role", "text", "copies", "cut_off", F.lit(None).cast("int").alias("entry"), F.lit(None).cast("string").alias("edits"))
    ordered = heads.unionByName(body).repartition("conv_id", "piece").sortWithinPartitions("conv_id", "piece", "place")
    return map_rows(ordered, run, "conv_id long, place long, step long, edit string, role string, text string, cost long")


@dataclass
class Repair:
    """steps: (conv_id, place, step, edit, role, text, cost), in the order of place and step within a conversation; role and
    text are those of the repaired turn, null where the row is deleted. faults: one row per conversation with
    gaps, blank, duplicate, truncated and illegal."""

    steps: DataFrame
    faults: DataFrame


def repair(rows: DataFrame) -> Repair:
    """Cheapest edits of every conversation of ``rows`` (columns conv_id, turn, role, text), and the faults found.

    Rows come by turn (nulls first), ties by a digest of role and text. A null role or text is read as one space. Rows
    without conv_id form one conversation. A row's first fault counts: blank (nothing but white space), duplicate (role and
    text stand earlier in the conversation; further copies of a repeated row), truncated (the last character that is not
    white space is none of ``.!?``). gaps counts the missing turn numbers between the least and the greatest (0 if all are null);
    illegal the neighbouring rows whose role initials are not su, ua or au. An empty table gives empty results.
    Other columns are not looked at.
    """
    cells = cut(_cells(rows.withColumn("conv_id", F.col("conv_id").cast("long"))))
    placed = _placed(cells)
    pieces = _pieces(placed)
    choices = _choices(pieces)
    entries = _entries(choices)
    chosen = choices.select("head", "conv_id", "piece", "edits").join(entries.select("head", "state"), "head")
    chosen = chosen.select("conv_id", "piece", "state", F.element_at("edits", F.col("state") + 1).alias("edits"))
    steps = cut(_steps(placed, chosen))

    other = F.when(F.col("seen"), F.col("copies")).otherwise(F.col("copies") - 1)
    counted = cells.groupBy("conv_id", "turn").agg(
        F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).otherwise(other)).alias("duplicate"),
        F.sum((~F.col("blank") & ~F.col("seen") & F.col("cut_off")).cast("long")).alias("truncated"),
    )
    gaps = F.max("turn") - F.min("turn") + 1 - F.count("turn")  # one row per turn here
    sums = counted.groupBy("conv_id").agg(F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    illegal = fresh(entries).groupBy("conv_id").agg(F.sum("illegal").alias("illegal")).withColumnRenamed("conv_id", "_conv")
    return Repair(steps, sums.join(illegal, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv"))
