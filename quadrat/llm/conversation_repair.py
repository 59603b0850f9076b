"""Cheapest repair of conversations into ``(s?(ua)+)?``: an optional system turn, then user and assistant in turns.

A turn has a role, of which the initial counts, and at most one fault: blank, duplicate or truncated. Keeping a turn costs 0, giving it the role of
user or assistant 3, deleting it 4 (blank turns and duplicates must go), a turn that stays truncated 3 more, and an inserted empty turn 3. Of equally cheap repairs the
one with the least edit initials (D, I, K, R) is taken.

Four states say what may follow: nothing yet, after a system turn, after a user turn, after an assistant turn. What a run of turns can do is a 4 x 4 min-plus matrix, and
the matrix of two runs is the product of theirs. The sequences of (role, fault) symbols of a chunk are compressed by Re-Pair, which replaces the most frequent
adjacent pair by a rule until none occurs twice; each rule's matrix is the product of its two parts', worked out once, from the bottom up, for all conversations
that hold it. A matrix entry keeps, beside its cost, the state between its two parts: that is the rope of its audit, read only for the entries that are used. Entries
of one start state are also numbered by their audits' order. Audits of one run never start with one another (inserted turns stand before a turn, so each ends with its last
turn's letter), hence the order of two joined audits follows from the order of their parts, and ties are broken without writing any audit.

Turns are sorted over all conversations and cut into chunks of even size. A conversation within a chunk is finished there; the first and the last of a chunk
may go on in another, so they give all entries of their matrices, and a second step multiplies these along the chunks. So a conversation of any
length is spread over many tasks. Texts take part only in the sort and when the kept turns are fetched.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.operators.ranking import range_chunks
from quadrat.operators.staging import stage

ROLES = {"s": "system", "u": "user", "a": "assistant"}
#: From each state, the state after a turn with this initial: 0 nothing yet, 1 after s, 2 after u, 3 after a.
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: Roles of the turns to be inserted at the end of a conversation, by state.
CLOSING = ("", "ua", "a", "")
KINDS = "sua"
#: Symbols: twice the role's place in KINDS (3 for any other), one more for a truncated turn; then the turn that must go.
MUST_GO = 8
_STATES = 4
_NEVER = 1 << 40
_WHITE = " \\t\\n\\u000b\\u000c\\r"
_OPEN_END = -1
_LAST_CHUNK = (1 << 31) - 1


@dataclass
class Terminal:
    cost: int
    audit: str
    roles: str


def terminals() -> dict[tuple[int, int, int], Terminal]:
    """(symbol, state before, state after) to the cheapest edits of one turn, with turns inserted before it; D has the role ``-``."""
    best: dict[tuple[int, int, int], Terminal] = {}
    for symbol in range(MUST_GO + 1):
        for start in range(_STATES):
            paths = [(start, Terminal(0, "", ""))]
            for state, done in paths:
                edits = [(state, 4, "D", "-")]
                if symbol < MUST_GO:
                    kind, truncated = "sua?"[symbol // 2], 3 * (symbol % 2)
                    edits += [(after, truncated, "K", kind) for role, after in STEPS[state].items() if role == kind]
                    edits += [(after, 3 + truncated, "R", role) for role, after in STEPS[state].items() if role in "ua"]
                for after, cost, letter, role in edits:
                    new = Terminal(done.cost + cost, done.audit + letter, done.roles + role)
                    old = best.get((symbol, start, after))
                    if old is None or (new.cost, new.audit) < (old.cost, old.audit):
                        best[symbol, start, after] = new
                if len(done.audit) < _STATES - 1:  # more would only come back to a state
                    for role, after in STEPS[state].items():
                        if role in "ua":
                            paths.append((after, Terminal(done.cost + 3, done.audit + "I", done.roles + role)))
    return best


def pair_up(sequences: list[bytes]) -> tuple[list[tuple[int, int]], list[int]]:
    """Re-Pair over all sequences: the two parts of each rule, and the symbol that stands for each sequence.

    Rules are numbered from ``MUST_GO + 1`` on, after their parts. What is left when no pair occurs twice is halved again and again by rules of its own.
    """
    symbols, owner = [], []
    for k, sequence in enumerate(sequences):
        symbols += sequence
        owner += [k] * len(sequence)
    n = len(symbols)
    after = [k + 1 if k + 1 < n and owner[k] == owner[k + 1] else -1 for k in range(n)]
    before = [k - 1 if k and owner[k] == owner[k - 1] else -1 for k in range(n)]
    places: dict[tuple[int, int], set[int]] = defaultdict(set)
    for k in range(n):
        if after[k] >= 0:
            places[symbols[k], symbols[after[k]]].add(k)
    heap = [(-len(found), pair) for pair, found in places.items()]
    heapify(heap)
    rules: list[tuple[int, int]] = []
    while heap:
        count, pair = heappop(heap)
        found = places[pair]
        if len(found) != -count:
            if len(found) > 1:
                heappush(heap, (-len(found), pair))
            continue
        if len(found) < 2:
            continue
        new = MUST_GO + 1 + len(rules)
        rules.append(pair)
        touched = set()
        for k in sorted(found):
            second = after[k]
            if symbols[k] != pair[0] or second < 0 or symbols[second] != pair[1]:
                continue  # in a run of one symbol the place before has taken it
            ahead, beyond = before[k], after[second]
            if ahead >= 0:
                places[symbols[ahead], symbols[k]].discard(ahead)
                places[symbols[ahead], new].add(ahead)
                touched.add((symbols[ahead], new))
            if beyond >= 0:
                places[symbols[second], symbols[beyond]].discard(second)
                places[new, symbols[beyond]].add(k)
                touched.add((new, symbols[beyond]))
                before[beyond] = k
            symbols[k], symbols[second] = new, -1
            after[k] = beyond
        places[pair] = set()
        for other in touched:
            heappush(heap, (-len(places[other]), other))
    left: list[list[int]] = [[] for _ in sequences]
    for k in range(n):
        if symbols[k] >= 0:
            left[owner[k]].append(symbols[k])
    numbers = {pair: MUST_GO + 1 + k for k, pair in enumerate(rules)}
    tops = []
    for row in left:
        while len(row) > 1:
            halved = []
            for k in range(0, len(row) - 1, 2):
                pair = row[k], row[k + 1]
                if pair not in numbers:
                    numbers[pair] = MUST_GO + 1 + len(rules)
                    rules.append(pair)
                halved.append(numbers[pair])
            row = halved + row[len(row) - len(row) % 2 :]
        tops.append(row[0])
    return rules, tops


def _numbered(keys: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Order of the entries of each start state; those that cannot be come last."""
    keys = np.where(cost < _NEVER, keys, _STATES * _STATES)
    return np.argsort(np.argsort(keys, axis=-1, kind="stable"), axis=-1, kind="stable")


class Grammar:
    """Matrices of all symbols and rules: ``cost``, ``order`` of the audits by start state, and ``via``, the state between the two parts."""

    def __init__(self, rules: list[tuple[int, int]]):
        self.rules, self.ends = rules, terminals()
        n = MUST_GO + 1 + len(rules)
        shape = (n, _STATES, _STATES)
        self.cost, self.order, self.via = np.full(shape, _NEVER), np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        for (symbol, p, q), end in self.ends.items():
            self.cost[symbol, p, q] = end.cost
        for symbol in range(MUST_GO + 1):
            for p in range(_STATES):
                audits = [(self.ends[symbol, p, q].audit if (symbol, p, q) in self.ends else "~", q) for q in range(_STATES)]
                for place, (_, q) in enumerate(sorted(audits)):
                    self.order[symbol, p, q] = place
        level = [0] * (MUST_GO + 1)
        for a, b in rules:
            level.append(1 + max(level[a], level[b]))
        levels = np.array(level)
        parts = np.array(rules, dtype=np.int64).reshape(-1, 2)
        for depth in range(1, max(level) + 1):
            mine = np.flatnonzero(levels == depth)
            self._multiply(mine, *parts[mine - MUST_GO - 1].T)

    def _multiply(self, mine: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
        joined = self.cost[left][:, :, :, None] + self.cost[right][:, None, :, :]  # rule, from, between, to
        joined = np.minimum(joined, _NEVER)
        via = np.argmin(joined * _STATES + self.order[left][:, :, :, None], axis=2)
        cost = np.take_along_axis(joined, via[:, :, None, :], axis=2)[:, :, 0, :]
        first = np.take_along_axis(self.order[left], via, axis=2)
        second = self.order[right][np.arange(len(mine))[:, None, None], via, np.arange(_STATES)]
        self.cost[mine], self.via[mine] = cost, via
        self.order[mine] = _numbered(first * _STATES + second, cost)

    def read(self, symbol: int, p: int, q: int) -> tuple[str, str]:
        """Audit of an entry and the roles it gives, letter by letter."""
        audit, roles, rope = [], [], [(symbol, p, q)]
        while rope:
            symbol, p, q = rope.pop()
            if symbol <= MUST_GO:
                end = self.ends[symbol, p, q]
                audit.append(end.audit)
                roles.append(end.roles)
            else:
                left, right = self.rules[symbol - MUST_GO - 1]
                between = int(self.via[symbol, p, q])
                rope += [(right, between, q), (left, p, between)]
        return "".join(audit), "".join(roles)


def best_end(cost: list[int], order: list[int]) -> int:
    """State in which a whole conversation ends best, closing turns included; of equal ones that with the least audit."""
    return min(range(_STATES), key=lambda q: (cost[q] + 3 * len(CLOSING[q]), order[q]))


# --- turns as symbols ---------------------------------------------------------------------------------


def prepare(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """All turns in order, with ``_chunk``, ``_pos`` and the faults that show in the turn itself."""
    rows = turns.select(
        F.col(conv).alias("conv"),
        F.col(turn).alias("turn"),
        F.coalesce(role, F.lit(" ")).alias("role"),
        F.coalesce(text, F.lit(" ")).alias("text"),
    )
    stripped = F.expr(f"trim(TRAILING '{_WHITE}' FROM text)")
    rows = rows.withColumns(
        {
            "digest": F.sha2("text", 256),
            "blank": stripped == "",
            "truncated": ~F.substring(F.right(stripped, F.lit(1)), 1, 1).isin(".", "!", "?"),
        }
    )
    return range_chunks(rows, [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")])


def mark_faults(rows: DataFrame) -> DataFrame:
    """(_chunk, _pos, conv, turn, kind, blank, duplicate, truncated): the first fault of each turn, without texts."""
    place = F.struct("_chunk", "_pos")
    firsts = rows.where(~F.col("blank")).groupBy("conv", "role", "digest").agg(F.min(place).alias("at"))
    firsts = firsts.select(F.col("at._chunk").alias("_chunk"), F.col("at._pos").alias("_pos"), F.lit(True).alias("first"))
    kind = F.coalesce(F.nullif(F.instr(F.lit(KINDS), F.substring("role", 1, 1)), F.lit(0)), F.lit(4)) - 1
    kind = F.when(F.col("role") == "", 3).otherwise(kind)
    light = rows.select("_chunk", "_pos", "conv", "turn", kind.alias("kind"), "blank", "truncated")
    duplicate = ~F.col("blank") & F.col("first").isNull()
    return light.join(firsts, ["_chunk", "_pos"], "left").select(
        "_chunk",
        "_pos",
        "conv",
        "turn",
        "kind",
        "blank",
        duplicate.alias("duplicate"),
        (~F.col("blank") & ~duplicate & F.col("truncated")).alias("truncated"),
    )


def _illegal(kinds: np.ndarray) -> int:
    """Neighbours whose initials are not su, ua or au."""
    a, b = kinds[:-1], kinds[1:]
    return int((~((b == 1) & ((a == 0) | (a == 2)) | (b == 2) & (a == 1))).sum())


def solve_chunks(faults: DataFrame) -> DataFrame:
    """Rows of (conv, _chunk, first, start, stop, cost, place, audit, roles, illegal, head, tail).

    A conversation inside a chunk has one row with ``stop`` -1, closing turns included. The first and the last of a chunk have one row for each entry of their
    matrix instead, ``place`` being its order; ``head`` and ``tail`` are the kinds of the outer turns and ``first`` the position of the first turn.
    """
    kind = faults.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, _chunk int, first long, start int, stop int, cost long, place int, audit string, roles string, illegal long, head int, tail int"

    def solve(table: pa.Table) -> pa.Table:
        table = table.sort_by("_pos").combine_chunks()
        codes, kinds, chunk = table.column("code").to_numpy(), table.column("kind").to_numpy(), table.column("_chunk")[0].as_py()
        position = table.column("_pos").to_numpy()
        ids = pc.dictionary_encode(table.column("conv").combine_chunks(), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(ids, prepend=-1, append=-1))
        data = codes.astype(np.uint8).tobytes()
        numbers: dict[bytes, int] = {}
        which = [numbers.setdefault(data[a:b], len(numbers)) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        rules, tops = pair_up(list(numbers))
        grammar = Grammar(rules)
        rows, finished = [], {}
        for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
            top, whole = tops[which[k]], 0 < k < len(which) - 1
            fixed = a, chunk, int(position[a]), _illegal(kinds[a:b]), int(kinds[a]), int(kinds[b - 1])
            if whole:
                if top not in finished:
                    q = best_end(grammar.cost[top, 0].tolist(), grammar.order[top, 0].tolist())
                    audit, roles = grammar.read(top, 0, q)
                    cost = int(grammar.cost[top, 0, q]) + 3 * len(CLOSING[q])
                    finished[top] = 0, _OPEN_END, cost, 0, audit + "I" * len(CLOSING[q]), roles + CLOSING[q]
                rows.append((fixed, finished[top]))
                continue
            for p in range(_STATES):
                for q in range(_STATES):
                    if grammar.cost[top, p, q] < _NEVER:
                        entry = p, q, int(grammar.cost[top, p, q]), int(grammar.order[top, p, q]), *grammar.read(top, p, q)
                        rows.append((fixed, entry))
        conv = table.column("conv").take(pa.array([f[0] for f, _ in rows]))
        columns = [conv]
        names = [("_chunk", pa.int32()), ("first", pa.int64())]
        columns += [pa.array([f[k + 1] for f, _ in rows], t) for k, (_, t) in enumerate(names)]
        entries = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.string()]
        columns += [pa.array([e[k] for _, e in rows], t) for k, t in enumerate(entries)]
        columns += [pa.array([f[k] for f, _ in rows], t) for k, t in ((3, pa.int64()), (4, pa.int32()), (5, pa.int32()))]
        return pa.Table.from_arrays(columns, names=[part.split()[0] for part in schema.split(", ")])

    must_go = F.col("blank") | F.col("duplicate")
    code = F.when(must_go, MUST_GO).otherwise(2 * F.col("kind") + F.col("truncated").cast("int"))
    symbols = faults.select("_chunk", "_pos", "conv", F.col("kind").cast("int").alias("kind"), code.cast("int").alias("code"))
    return symbols.groupBy("_chunk").applyInArrow(solve, schema)


def join_chunks(solved: DataFrame) -> DataFrame:
    """For conversations that touch a chunk's border: the entry taken in each chunk, and a last row (``_chunk`` NULL) with the end state, cost and illegal neighbours.

    A conversation brings at most sixteen numbers for each chunk it touches.
    """
    kind = solved.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, _chunk int, start int, stop int, cost long, illegal long"

    def follow(table: pa.Table) -> pa.Table:
        table = table.sort_by("_chunk")
        chunks, kind_of = defaultdict(dict), {}
        for row in table.drop_columns(["conv"]).to_pylist():
            chunks[row["_chunk"]][row["start"], row["stop"]] = row["cost"], row["place"]
            kind_of[row["_chunk"]] = row["illegal"], row["head"], row["tail"]
        cost, order = [0, _NEVER, _NEVER, _NEVER], [0, 1, 2, 3]
        steps = []
        for entries in chunks.values():
            best = {}
            for (p, q), (more, place) in entries.items():
                option = cost[p] + more, order[p], place, p
                if cost[p] < _NEVER and (q not in best or option < best[q]):
                    best[q] = option
            ranks = sorted(best, key=lambda q: best[q][1:3])
            steps.append({q: best[q][3] for q in best})
            cost = [best[q][0] if q in best else _NEVER for q in range(_STATES)]
            order = [ranks.index(q) if q in best else _STATES for q in range(_STATES)]
        state = end = best_end(cost, order)
        taken = []
        for before in reversed(steps):
            taken.append((before[state], state))
            state = before[state]
        illegal, kinds = 0, list(kind_of.values())
        for k, (inside, head, _) in enumerate(kinds):
            illegal += inside + (_illegal(np.array([kinds[k - 1][2], head])) if k else 0)
        names = [*chunks, None]
        taken = [*reversed(taken), (end, _OPEN_END)]
        total = [None] * len(chunks) + [cost[end] + 3 * len(CLOSING[end])]
        conv = table.column("conv").take(pa.array([0] * len(names)))
        data = [names, [p for p, _ in taken], [q for _, q in taken], total, [None] * len(chunks) + [illegal]]
        types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        return pa.Table.from_arrays([conv, *[pa.array(d, t) for d, t in zip(data, types)]], names=[p.split()[0] for p in schema.split(", ")])

    open_ended = solved.where(F.col("stop") != _OPEN_END)
    return open_ended.select("conv", "_chunk", "start", "stop", "cost", "place", "illegal", "head", "tail").groupBy("conv").applyInArrow(follow, schema)


def choose_pieces(solved: DataFrame) -> DataFrame:
    """(conv, _chunk, first, audit, roles, cost, illegal): the pieces of every conversation's audit; cost and illegal neighbours are on one of them."""
    chosen = stage(join_chunks(solved), "joined")
    inside = solved.where(F.col("stop") == _OPEN_END).select("conv", "_chunk", "first", "audit", "roles", "cost", "illegal")
    entries = solved.where(F.col("stop") != _OPEN_END)
    picked = chosen.where(F.col("_chunk").isNotNull()).select(F.col("conv").alias("c"), F.col("_chunk").alias("k"), F.col("start").alias("p"), F.col("stop").alias("q"))
    on = F.col("conv").eqNullSafe(F.col("c")) & (F.col("_chunk") == F.col("k")) & (F.col("start") == F.col("p")) & (F.col("stop") == F.col("q"))
    none = F.lit(None).cast("long")
    cut = entries.join(picked, on).select("conv", "_chunk", "first", "audit", "roles", none.alias("cost"), none.alias("illegal"))
    closing = F.element_at(F.array(*[F.lit(c) for c in CLOSING]), F.col("start") + 1)
    ends = chosen.where(F.col("_chunk").isNull()).select(
        "conv", F.lit(_LAST_CHUNK).alias("_chunk"), none.alias("first"), F.repeat(F.lit("I"), F.length(closing)).alias("audit"), closing.alias("roles"), "cost", "illegal"
    )
    return inside.unionByName(cut).unionByName(ends)


# --- repaired conversations ---------------------------------------------------------------------------


def _edits(pieces: DataFrame) -> DataFrame:
    """(conv, _chunk, _order, _pos, edit, role) for each turn that is in the result; ``_pos`` is NULL for an inserted one."""
    kind = pieces.schema["conv"].dataType.simpleString()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                letters = np.frombuffer(batch.column("audit")[k].as_py().encode(), np.uint8)
                roles = np.frombuffer(batch.column("roles")[k].as_py().encode(), np.uint8)
                inserted = letters == ord("I")
                position = np.cumsum(~inserted) - 1 + (batch.column("first")[k].as_py() or 0)
                stay = np.flatnonzero(letters != ord("D"))
                if len(stay):
                    same = pa.array(np.full(len(stay), k))
                    text = [pa.array(a[stay].view("S1").astype(str)) for a in (letters, roles)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("conv").take(same),
                            batch.column("_chunk").take(same),
                            pa.array(stay.astype(np.int64)),
                            pa.array(position[stay].astype(np.int64), mask=inserted[stay]),
                            *text,
                        ],
                        ["conv", "_chunk", "_order", "_pos", "edit", "role"],
                    )

    schema = f"conv {kind}, _chunk int, _order long, _pos long, edit string, role string"
    return pieces.select("conv", "_chunk", "first", "audit", "roles").mapInArrow(spread, schema)


def _full_role(initial: Column) -> Column:
    return F.when(initial == "u", ROLES["u"]).otherwise(ROLES["a"])


@dataclass
class Repaired:
    """``turns`` (conv, chunk, place, role, text, edit) are the repaired conversations; ``pieces`` have their audits and ``faults`` what was found."""

    turns: DataFrame
    pieces: DataFrame
    faults: DataFrame


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repaired:
    """Repair all conversations.

    Turns are taken by ``turn``, NULLs first, those of one number by role and the text's SHA-256. A NULL role or text is one space. Turns with a NULL ``conv`` are one
    conversation. A turn is a duplicate if an earlier one has the same role and text, so repeated rows are. Other columns are left out. An empty table gives empty ones.
    In the result a conversation's turns are ordered by (chunk, place).
    """
    rows = prepare(turns, conv, turn, role, text)
    faults = stage(mark_faults(rows), "faults")
    pieces = stage(choose_pieces(stage(solve_chunks(faults), "solved")), "pieces")
    edits = _edits(pieces)
    kept = edits.where(F.col("_pos").isNotNull()).join(rows.select("_chunk", "_pos", F.col("role").alias("own"), "text"), ["_chunk", "_pos"])
    given = F.when(F.col("edit") == "K", F.col("own")).otherwise(_full_role(F.col("role")))
    kept = kept.select("conv", F.col("_chunk").alias("chunk"), F.col("_order").alias("place"), given.alias("role"), "text", "edit")
    made = edits.where(F.col("_pos").isNull()).select(
        "conv", F.col("_chunk").alias("chunk"), F.col("_order").alias("place"), _full_role(F.col("role")).alias("role"), F.lit("").alias("text"), "edit"
    )
    return Repaired(kept.unionByName(made), pieces, faults)


def hash_turns(turns: DataFrame) -> DataFrame:
    """(conv, sha256) of each conversation's ``role:text``, joined by line breaks.

    A hash needs its bytes in order, so a conversation's turns pass one task; they are hashed as they come and none is kept.
    """
    kind = turns.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest = None, None  # the conversation as an array of one, which also holds a NULL
        for batch in batches:
            conv, made, found = batch.column("conv"), [], []
            ids = pc.dictionary_encode(conv, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            role, text = (batch.column(c).cast(pa.binary()) for c in ("role", "text"))
            for k in range(batch.num_rows):
                if k == 0 or ids[k] != ids[k - 1]:
                    own = conv.slice(k, 1)
                    if current is None or not own.equals(current):
                        if current is not None:
                            made.append(current)
                            found.append(digest.hexdigest())
                        current, digest = pa.array(own.to_pylist(), own.type), None
                line = role[k].as_py() + b":" + text[k].as_py()
                if digest is None:
                    digest = hashlib.sha256(line)
                else:
                    digest.update(b"\n" + line)
            if made:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(made), pa.array(found)], ["conv", "sha256"])
        if current is not None:
            yield pa.RecordBatch.from_arrays([current, pa.array([digest.hexdigest()])], ["conv", "sha256"])

    ordered = turns.repartition("conv").sortWithinPartitions("conv", "chunk", "place")
    return ordered.select("conv", "role", "text").mapInArrow(run, f"conv {kind}, sha256 string")


def report(original: DataFrame, repaired: Repaired, conv: str = "conv_id") -> DataFrame:
    """One row for each ``conv`` of ``original``: (conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256).

    ``gaps`` are the turn numbers missing between the least and the greatest. A conversation of which no turn is left has zeros and the hash of nothing.
    """
    turn, span = F.col("turn"), F.max("turn") - F.min("turn") + 1
    counts = repaired.faults.groupBy("conv").agg(
        F.coalesce(span - F.count_distinct(turn), F.lit(0)).cast("long").alias("gaps"),
        *[F.count_if(c).alias(c) for c in ("blank", "duplicate", "truncated")],
    )
    pieces = F.array_sort(F.collect_list(F.struct("_chunk", "audit")))
    audits = repaired.pieces.groupBy("conv").agg(
        F.max("illegal").alias("illegal"), F.max("cost").alias("cost"), F.array_join(F.transform(pieces, lambda p: p["audit"]), "").alias("audit")
    )
    hashes = hash_turns(repaired.turns).withColumnRenamed("sha256", "repaired_sha256")
    every = original.select(F.col(conv).alias("conv")).distinct()
    parts = every.unionByName(counts, True).unionByName(audits, True).unionByName(hashes, True)
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return parts.groupBy(F.col("conv").alias(conv)).agg(
        *[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in numbers],
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
