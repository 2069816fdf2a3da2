"""Repair of conversations: the cheapest edits that give turns in order, and among those the least audit.

A conversation's rows are walked through the states "nothing yet", "system", "user" and "assistant".  Every row is kept,
given another role or deleted, and turns are inserted between rows; the cheapest way through is a shortest path.

Conversations are cut into blocks of a fixed number of rows.  A block is a 4 x 4 matrix of costs from each state before it
to each state behind it; matrices of ever more blocks (one, two, four, ...) are multiplied by joins, so a conversation of any
length is spread over tasks.  With the costs behind each block known, its nodes (place and state) are ranked: first by the
least letter among the arcs of cheapest paths, then by two letters, four, eight, through pointers that double.  A state
and a letter name one arc, so a pointer is one node, and the least path of an audit is read off through the doubled pointers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowtide.llm.common import SPACES, importable
from flowtide.plans.lookup import join_lookup
from flowtide.plans.materialise import materialise
from flowtide.plans.ranking import numbered

#: Cost of each edit, of a truncated row that stays, and states.
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = ("", "s", "u", "a")
#: The state after a turn of the role that a state asks for, and after a row kept with each initial; -1: not allowed.
ASKED = np.array([USER, USER, ASSISTANT, USER])
KEPT = np.array([[-1, -1, -1, -1], [SYSTEM, -1, -1, -1], [USER, USER, -1, USER], [-1, -1, ASSISTANT, -1]])
ROLES = {"u": "user", "a": "assistant"}
FAULTS = ("", "blank", "duplicate", "truncated")
LETTERS = np.frombuffer(b"-DIKR", np.uint8)
#: No way from here to there; far above any cost.
NEVER = 1 << 40
BLOCK_ROWS = 10_000
PORTION_ROWS = 200_000
#: Cost of ending in each state: what is still to be inserted.
END_COSTS = (0, 2 * INSERT, INSERT, 0)


def _row_costs() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code (initial * 4 + fault) and state: cost of keeping, the state then, cost of another role."""
    keep, then, rerole = np.full((16, 4), NEVER), np.zeros((16, 4), dtype=np.int64), np.full((16, 4), NEVER)
    for code in range(16):
        initial, fault = divmod(code, 4)
        if fault in (0, 3):
            extra = TRUNCATED if fault == 3 else 0
            keep[code] = np.where(KEPT[initial] >= 0, extra, NEVER)
            then[code] = np.maximum(KEPT[initial], 0)
            rerole[code] = REROLE + extra
    return keep, then, rerole


KEEP_COST, KEEP_STATE, REROLE_COST = _row_costs()


class _Blocks:
    """Rows of several blocks one after the other, as codes; all blocks are worked on at once, place by place."""

    def __init__(self, codes: list[np.ndarray]) -> None:
        order = sorted(range(len(codes)), key=lambda i: -len(codes[i]))
        self.order = np.array(order, dtype=np.int64)
        self.sizes = np.array([len(codes[i]) for i in order], dtype=np.int64)
        self.codes = np.concatenate([codes[i] for i in order]) if order else np.zeros(0, np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes

    def _places(self) -> Iterator[tuple[int, int]]:
        """Places from the last to the first, and how many blocks (the longest ones) have them."""
        for place in range(int(self.sizes.max(initial=0)) - 1, -1, -1):
            yield place, int(np.searchsorted(-self.sizes, -place, side="left"))

    def _before(self, cost: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Costs before a row from those behind it, for the last axis (states); insertions come before the row."""
        at = codes.reshape(-1, *[1] * (cost.ndim - 1))
        keep = np.take_along_axis(cost, np.broadcast_to(KEEP_STATE[at[..., 0]], cost.shape), -1) + KEEP_COST[at[..., 0]]
        row = np.minimum(np.minimum(cost + DELETE, keep), cost[..., ASKED] + REROLE_COST[at[..., 0]])
        out = row.copy()
        out[..., USER] = np.minimum(row[..., USER], row[..., ASSISTANT] + INSERT)
        out[..., ASSISTANT] = np.minimum(row[..., ASSISTANT], row[..., USER] + INSERT)
        for q in (START, SYSTEM):
            out[..., q] = np.minimum(row[..., q], out[..., USER] + INSERT)
        return out

    def matrices(self) -> np.ndarray:
        """Per block, in the order given: cost from each state before it (rows) to each behind it (columns)."""
        cost = np.where(np.eye(4, dtype=bool), 0, NEVER)[None].repeat(len(self.sizes), axis=0)
        for place, n in self._places():
            cost[:n] = np.minimum(self._before(cost[:n], self.codes[self.first[:n] + place]), NEVER)
        out = np.empty_like(cost)
        out[self.order] = cost.transpose(0, 2, 1)
        return out

    def paths(self, behind: np.ndarray) -> "_Paths":
        """Least cheapest paths, given the costs of each state behind each block."""
        nodes = 4 * (self.sizes + 1)
        first = np.cumsum(nodes) - nodes
        cost = np.zeros(int(nodes.sum()), dtype=np.int64)
        states = np.arange(4)
        now = behind[self.order].copy()
        cost[(first + 4 * self.sizes)[:, None] + states] = now
        for place, n in self._places():
            now[:n] = self._before(now[:n], self.codes[self.first[:n] + place])
            cost[(first[:n] + 4 * place)[:, None] + states] = now[:n]
        place = np.concatenate([np.repeat(np.arange(k + 1), 4) for k in self.sizes]) if len(self.sizes) else np.zeros(0, np.int64)
        ends = np.repeat(place[np.cumsum(nodes) - 1], nodes) == place
        state = np.tile(states, len(place) // 4)
        code = np.zeros(len(place), dtype=np.int64)
        code[~ends] = np.repeat(self.codes, 4)
        node = np.arange(len(place))
        here = node - state
        behind_row = np.minimum(here + 4, max(0, len(place) - 4))
        # In the order of the letters: delete, insert, keep, another role.
        targets = np.stack([behind_row + state, here + ASKED[state], behind_row + KEEP_STATE[code, state], behind_row + ASKED[state]])
        prices = np.stack([np.full(len(place), DELETE), np.full(len(place), INSERT), KEEP_COST[code, state], REROLE_COST[code, state]])
        optimal = (cost[targets] + prices == cost) & ~ends
        letter = np.where(ends, 0, 1 + optimal.argmax(axis=0))
        following = np.where(ends, node, targets[np.maximum(letter - 1, 0), node])
        return _Paths(self, first, nodes, place, state, letter, following)


@dataclass
class _Paths:
    """Nodes of blocks with the least letter of a cheapest way on, and the node it leads to."""

    blocks: _Blocks
    first: np.ndarray
    nodes: np.ndarray
    place: np.ndarray
    state: np.ndarray
    letter: np.ndarray
    following: np.ndarray

    def ranked(self) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Pointers over 1, 2, 4, ... letters, ranks of all nodes by their whole audits, and lengths of these."""
        pointers, rank, length = [self.following], self.letter.astype(np.int64), (self.letter > 0).astype(np.int64)
        while self.letter[pointers[-1]].any():
            jump = pointers[-1]
            _, rank = np.unique(rank * (rank.max() + 1) + rank[jump], return_inverse=True)
            length = length + length[jump]
            pointers.append(jump[jump])
        _, rank = np.unique(rank * (rank.max(initial=0) + 1) + rank[pointers[-1]], return_inverse=True)
        return pointers, rank, length + length[pointers[-1]]

    def rows(self, entries: list[list[int]]) -> Iterator[tuple[int, int, int, str, str, list[int]]]:
        """Block, state before, state behind, letters, roles given and places of the least path from each entry."""
        pointers, _, length = self.ranked()
        where = np.empty(len(self.first), dtype=np.int64)
        where[self.blocks.order] = np.arange(len(self.first))
        starts = [(i, q) for i, states in enumerate(entries) for q in states]
        entry = np.array([self.first[where[i]] + q for i, q in starts], dtype=np.int64)
        steps = length[entry]
        ends = np.cumsum(steps)
        node, step = np.repeat(entry, steps), np.arange(int(steps.sum())) - np.repeat(ends - steps, steps)
        last = entry.copy()
        for k, jump in enumerate(pointers):
            node = np.where(step >> k & 1, jump[node], node)
            last = np.where(steps >> k & 1, jump[last], last)
        letter = self.letter[node]
        text = LETTERS[letter].tobytes().decode()
        given = np.where((letter == 2) | (letter == 4), np.where(ASKED[self.state[node]] == USER, ord("u"), ord("a")), ord("-"))
        roles = given.astype(np.uint8).tobytes().decode()
        place = np.where(letter == 2, -1, self.place[node])
        for (i, q), a, b, at in zip(starts, ends - steps, ends, last):
            yield i, q, int(self.state[at]), text[a:b], roles[a:b], place[a:b].tolist()


def _portions(sizes: list[int]) -> Iterator[slice]:
    first = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > PORTION_ROWS:
            yield slice(first, i)
            first, held = i, 0
        held += n + 1
    if first < len(sizes):
        yield slice(first, len(sizes))


def _block_codes(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Codes of each block's own rows, without the row after it."""
    codes = batch.column("codes")
    flat = codes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = codes.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return [flat[a : a + n] for a, n in zip(np.cumsum(sizes) - sizes, batch.column("n_rows").to_pylist())]


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = _block_codes(batch)
        for some in _portions([len(c) for c in codes]):
            costs = _Blocks(codes[some]).matrices().reshape(-1, 16)
            part = batch.slice(some.start, some.stop - some.start)
            yield pa.record_batch({"conv": part.column("conv"), "block": part.column("block"), "costs": pa.array(costs.tolist(), pa.list_(pa.int64()))})


def _least_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.int32())]
    names = ["conv", "block", "entry", "exit", "letters", "roles", "places"]
    for batch in batches:
        codes, conv, block = _block_codes(batch), batch.column("conv").to_pylist(), batch.column("block").to_pylist()
        behind = np.array(batch.column("behind").to_pylist(), dtype=np.int64).reshape(-1, 4)
        for some in _portions([len(c) for c in codes]):
            entries = [[START] if b == 0 else list(range(4)) for b in block[some]]
            paths = _Blocks(codes[some]).paths(behind[some])
            rows = [(conv[some.start + i], block[some.start + i], *rest) for i, *rest in paths.rows(entries)]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def damaged(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turn, role, text, copy`` after damage by the checksum of conversation and turn; nulls of role and text are a space."""
    named = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat_ws(":", named(conv), named(turn)).cast("binary")), F.lit(20))
    rows = conversations.select(F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").cast("bigint").alias("turn"), named(role).alias("role"), named(text).alias("text"), kind.alias("kind"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where("kind <> 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(copies).alias("copy"),
    )


def _key(conv_id: str = "conv_id") -> Column:
    """A conversation's key, also of the rows without an id."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{conv_id}`").cast("string")), F.lit(""))


@dataclass
class Repair:
    """``rows`` (``conv, pos, turn, role, text, fault``), ``blocks`` (``conv, block, illegal``), ``paths`` of blocks and ``costs`` of conversations."""

    rows: DataFrame
    blocks: DataFrame
    paths: DataFrame
    costs: DataFrame
    block_rows: int

    def edits(self) -> DataFrame:
        """One row per edit in order: ``conv, block, step, edit, pos, turn, role, text`` (role and text as repaired; a deleted row's own)."""
        each = F.transform(F.col("places"), lambda p, i: F.struct(i.alias("step"), F.substring("letters", i + 1, F.lit(1)).alias("edit"), F.substring("roles", i + 1, F.lit(1)).alias("given"), p.alias("place")))
        steps = self.paths.select("conv", "block", F.inline(each))
        given = F.when(F.col("given") == "u", F.lit(ROLES["u"])).when(F.col("given") == "a", F.lit(ROLES["a"]))
        inserted = steps.where("edit = 'I'").select("conv", "block", "step", "edit", F.lit(None).cast("bigint").alias("pos"), F.lit(None).cast("bigint").alias("turn"), given.alias("role"), F.lit("").alias("text"))
        placed = steps.where("edit <> 'I'").withColumn("pos", F.col("block") * self.block_rows + F.col("place"))
        # One row on either side: a hot conversation is spread by its positions.
        with_rows = placed.join(self.rows.select("conv", "pos", "turn", "role", "text"), ["conv", "pos"])
        return with_rows.select("conv", "block", "step", "edit", "pos", "turn", F.coalesce(given, "role").alias("role"), "text").unionByName(inserted)


def _ordered(rows: DataFrame, block_rows: int) -> DataFrame:
    order = [F.asc_nulls_first("turn"), F.col("role"), F.col("text"), F.col("copy")]
    return numbered(materialise(rows.withColumn("conv", _key()).drop("conv_id"), "turns"), ["conv"], order, "pos", hot_rows=block_rows)


def _with_faults(rows: DataFrame) -> DataFrame:
    """``fault`` of each row (0 none, 1 blank, 2 duplicate, 3 truncated) and ``initial`` of its role (place in INITIALS)."""
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    rows = materialise(rows.withColumn("same", same), "ordered_turns")
    firsts = rows.groupBy("conv", "same").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    marked = join_lookup(rows, materialise(firsts, "repeated_turns"), ["conv", "same"], ["pos"], "left")
    shown = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(shown == "", 1).when(F.col("pos") > F.col("first"), 2).when(~F.right(shown, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    initial = F.greatest(F.array_position(F.array(*[F.lit(i) for i in INITIALS[1:]]), F.substring("role", 1, 1)), F.lit(0))
    return marked.select("conv", "pos", "turn", "role", "text", fault.alias("fault"), initial.cast("int").alias("initial"))


def _doubled(table: DataFrame, value: str, product, rounds: int, back: bool) -> DataFrame:
    """Products over 1, 2, 4, ... blocks: of each block with those behind it (``back``: before it)."""
    for k in range(rounds):
        step = (1 << k) * (-1 if back else 1)
        other = table.select("conv", (F.col("block") - step).alias("block"), F.col(value).alias("other"))
        both = product("other", value) if back else product(value, "other")
        table = materialise(
            table.join(other, ["conv", "block"], "left").select("conv", "block", F.when(F.col("other").isNull(), F.col(value)).otherwise(both).alias(value)), "doubled"
        )
    return table


def _cost_product(x: str, y: str) -> Column:
    cell = lambda i, j: F.least(*[F.col(x)[4 * i + k] + F.col(y)[4 * k + j] for k in range(4)], F.lit(NEVER))
    return F.array(*[cell(i, j) for i in range(4) for j in range(4)])


def _map_product(x: str, y: str) -> Column:
    return F.transform(F.col(x), lambda q: F.element_at(F.col(y), q + 1))


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> Repair:
    """Faults, cheapest edits and least audits of the conversations in ``rows`` (``conv_id, turn, role, text, copy``).

    Rows go by turn, null first; rows of one turn by role, text and copy.  A row's first fault counts: blank (nothing
    but ASCII white space), duplicate (role and text of an earlier row), truncated (no ``.``, ``!`` or ``?`` at the end).
    Rows without ``conv_id`` are one conversation.  ``block_rows`` bounds what a task holds of a conversation.  An empty table gives empty
    tables; a very long text is one value of one row, never joined to others; extra columns are not carried.
    """
    importable(rows.sparkSession)
    turns = materialise(_with_faults(_ordered(rows, block_rows)), "faults")
    home = F.floor(F.col("pos") / block_rows).cast("bigint")
    # The first row of a block is also the last one's of the block before it, for the pair of both.
    blocks = F.explode(F.when((F.col("pos") > 0) & (F.col("pos") % block_rows == 0), F.array(home, home - 1)).otherwise(F.array(home)))
    code = (F.col("initial") * 4 + F.col("fault")).cast("int")
    packed = (
        turns.select("conv", blocks.alias("block"), "pos", code.alias("code"), home.alias("home"))
        .groupBy("conv", "block")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("listed"), F.count(F.when(F.col("home") == F.col("block"), 1)).alias("n_rows"))
        .withColumn("codes", F.transform("listed", lambda x: x["code"]))
    )
    letters = F.transform("codes", lambda c: F.element_at(F.array(*[F.lit(i or "?") for i in INITIALS]), F.floor(c / 4).cast("int") + 1))
    pairs = F.zip_with(F.slice(letters, 1, F.size("codes") - 1), F.slice(letters, 2, F.size("codes") - 1), lambda x, y: F.concat(x, y))
    illegal = F.size(F.filter(F.when(F.size("codes") > 1, pairs).otherwise(F.array().cast("array<string>")), lambda p: ~p.isin("su", "ua", "au")))
    packed = materialise(packed.select("conv", "block", "codes", "n_rows", illegal.cast("bigint").alias("illegal")), "turn_blocks")
    most = packed.agg(F.max("block")).first()[0] or 0
    rounds = int(most).bit_length()
    single = materialise(packed.mapInArrow(_matrices, "conv string, block bigint, costs array<bigint>"), "block_costs")
    behind = _doubled(single, "costs", _cost_product, rounds, back=False)
    ending = F.array(*[F.least(*[F.col("costs")[4 * i + k] + END_COSTS[k] for k in range(4)]) for i in range(4)])
    to_end = materialise(behind.select("conv", "block", ending.alias("ending")), "costs_to_end")
    costs = to_end.where("block = 0").select("conv", F.col("ending")[START].alias("cost"))
    after = to_end.where("block > 0").select("conv", (F.col("block") - 1).alias("block"), F.col("ending").alias("next"))
    last = F.array(*[F.lit(c).cast("bigint") for c in END_COSTS])
    known = packed.join(after, ["conv", "block"], "left").select("conv", "block", "codes", "n_rows", F.coalesce("next", last).alias("behind"))
    schema = "conv string, block bigint, entry int, exit int, letters string, roles string, places array<int>"
    paths = materialise(known.mapInArrow(_least_paths, schema), "least_paths")
    moves = paths.groupBy("conv", "block").agg(F.map_from_entries(F.collect_list(F.struct("entry", "exit"))).alias("moves"))
    # The state behind each block, for the state at the start of the conversation; a first block has that entry alone.
    maps = moves.select("conv", "block", F.array(*[F.coalesce(F.try_element_at("moves", F.lit(q)), F.lit(START)) for q in range(4)]).alias("exits"))
    through = _doubled(materialise(maps, "block_moves"), "exits", _map_product, rounds, back=True)
    entered = through.select("conv", (F.col("block") + 1).alias("block"), F.col("exits")[START].alias("entry"))
    first = packed.where("block = 0").select("conv", "block", F.lit(START).alias("entry"))
    chosen = paths.join(entered.unionByName(first), ["conv", "block", "entry"])
    return Repair(turns, packed.select("conv", "block", "illegal"), materialise(chosen, "chosen_paths"), costs, block_rows)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's lines, which come sorted; only the running digest is held."""
    import hashlib

    now, digest = None, None
    for batch in batches:
        done = []
        for conv, line in zip(batch.column("conv").to_pylist(), batch.column("line").to_pylist()):
            if conv != now:
                if digest:
                    done.append((now, digest.hexdigest()))
                now, digest = conv, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(line.encode())
        yield _digest_rows(done)
    if digest:
        yield _digest_rows([(now, digest.hexdigest())])


def _digest_rows(done: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.record_batch({"conv": pa.array([c for c, _ in done], pa.string()), "repaired_sha256": pa.array([d for _, d in done], pa.string())})


def audits(conversations: DataFrame, block_rows: int = BLOCK_ROWS, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per original conversation, after damage: ``conv_id, gaps``, rows by fault, ``illegal, cost, audit, repaired_sha256``.

    A conversation without rows after damage has zeros, an empty audit and the digest of an empty text.  Rows without an id are one
    conversation; rows without a turn come first and don't count for gaps; repeated rows are rows (and duplicates of the first); an
    empty table gives no rows; other columns are ignored.  A digest runs over a whole conversation in order, so one task reads a
    conversation's repaired lines, one after the other and without holding them; everything else is spread by blocks.
    """
    done = repair(damaged(conversations, conv, turn, role, text), block_rows)
    per_turn = done.rows.groupBy("conv", "turn").agg(*[F.count(F.when(F.col("fault") == i, 1)).alias(f) for i, f in enumerate(FAULTS) if f])
    span = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    counts = per_turn.groupBy("conv").agg(F.coalesce(span, F.lit(0)).alias("gaps"), *[F.sum(f).alias(f) for f in FAULTS if f])
    illegal = done.blocks.groupBy("conv").agg(F.sum("illegal").alias("illegal"))
    in_order = F.array_sort(F.collect_list(F.struct("block", "letters")))
    audit = done.paths.groupBy("conv").agg(F.array_join(F.transform(in_order, lambda x: x["letters"]), "").alias("audit"))
    lines = done.edits().where("edit <> 'D'").select("conv", "block", "step", F.concat("role", F.lit(":"), "text").alias("line"))
    digests = lines.repartition("conv").sortWithinPartitions("conv", "block", "step").select("conv", "line").mapInArrow(_digests, "conv string, repaired_sha256 string")
    every = conversations.select(F.col(f"`{conv}`").alias("conv_id")).distinct().withColumn("conv", _key())
    out = every
    for part in (counts, illegal, done.costs, audit, digests):
        out = out.join(part, "conv", "left")
    numbers = ["gaps", *[f for f in FAULTS if f], "illegal", "cost"]
    return out.select(
        "conv_id", *[F.coalesce(F.col(c).cast("bigint"), F.lit(0).cast("bigint")).alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
