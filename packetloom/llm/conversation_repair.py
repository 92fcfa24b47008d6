"""Conversation structure repair by error-correcting Earley parsing.

Roles must follow `(system? (user assistant)+)?`, by their first letters.  The grammar is left-recursive, so a chart set
stays small however long the conversation is:

    root  -> empty | reply              opened -> empty keep(s)
    asked -> empty user | opened user | reply user      reply -> asked assistant
    user, assistant -> keep | rerole | insert           every state -> itself delete

Its error productions have weights, and each chart item retains the smallest (cost, audit) of what it has derived; the
audit is the edits' letters in order.  At one cost, of two audits for the same rows none is the beginning of the other
(more letters would be insertions, which cost), so the smallest part always makes the smallest whole.

Rows are dealt by ranges of (conv_id, turn, role, beginning of text), so a conversation of any length is spread over many
tasks.  A conversation inside one task is parsed at once.  Others are cut into segments of at most SEGMENT_ROWS rows; each
is parsed from all four states, and the segments' (cost, audit) tables are joined in order.

Defined results: nulls in role and text are one space; rows of a null conv_id form one conversation; a null turn comes
first; equal turns are ordered by role, then text; repeated rows stay, as duplicates; a conversation whose rows are all
dropped, or have zero copies, has no turns and costs nothing; an empty table gives no rows; columns other than those named
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ._common import materialize

#: Costs of edits, and what an undeleted truncated row costs besides.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SPACE = " \t\n\x0b\f\r"
#: A segment's rows and characters, at most (or one row).
SEGMENT_ROWS, SEGMENT_CHARS = 256, 4_000_000

STATES = EMPTY, OPENED, ASKED, REPLY = "empty", "opened", "asked", "reply"
#: Rows as the parser sees them: the role's first letter (x: another), a capital if truncated, d if it must go.
_RULES = [
    (OPENED, (EMPTY, "keep s")), (ASKED, (EMPTY, "user")), (ASKED, (OPENED, "user")), (ASKED, (REPLY, "user")), (REPLY, (ASKED, "assistant")),
    *[(state, (state, "delete")) for state in STATES],
    ("user", ("keep u",)), ("user", ("rerole",)), ("user", ("insert",)), ("assistant", ("keep a",)), ("assistant", ("rerole",)), ("assistant", ("insert",)),
]
_EDITS = {"keep s", "keep u", "keep a", "rerole", "delete"}


def _scan(edit: str, row: str) -> tuple[int, str] | None:
    """Cost and letter of an edit of a row, None where the row can't have it."""
    if edit == "delete":
        return DELETE, "D"
    more = TRUNCATED if row.isupper() else 0
    if row == "d" or (edit != "rerole" and row.lower() != edit[-1]):
        return None
    return (REROLE + more, "R") if edit == "rerole" else (more, "K")


@lru_cache(maxsize=50_000)
def parse(rows: str, entry: str = EMPTY) -> dict[str, tuple[int, str]]:
    """The smallest (cost, audit) with which rows lead from a state to each state, by Earley's algorithm.

    An item is (rule, dot, origin).  States begin at 0, users and assistants at the row that they edit; so a chart set
    needs the first set and the one before it."""
    by_head: dict[str, list[int]] = {}
    for i, (head, _) in enumerate(_RULES):
        by_head.setdefault(head, []).append(i)
    charts: list[dict] = []
    scanned: list = [((entry, 0, True), (0, ""))]  # the axiom: the entry state has been reached with nothing
    scanned += [((i, 0, 0), (0, "")) for state in STATES for i in by_head[state]]
    for j in range(len(rows) + 1):
        chart: dict = {}
        waiting: dict[str, list] = {}  # items of this set by the symbol after their dot
        agenda, scanned_next = [], {}
        charts.append({"items": chart, "waiting": waiting})

        def put(item, value, chart=chart, agenda=agenda):
            if item not in chart or value < chart[item]:
                chart[item] = value
                heappush(agenda, (value, repr(item), item))

        for item, value in scanned:
            put(item, value)
        while agenda:
            value, _, item = heappop(agenda)
            if chart[item] != value:
                continue  # a smaller one has come since
            if item[2] is True:  # complete: head, origin, True
                head, origin, _ = item
                for rule, dot, begin in charts[origin]["waiting"].get(head, ()):
                    before = charts[origin]["items"][rule, dot, begin]
                    _advance(put, rule, dot, begin, before, value)
                continue
            rule, dot, begin = item
            symbol = _RULES[rule][1][dot]
            queue = waiting.setdefault(symbol, [])
            if item not in queue:
                queue.append(item)
            if symbol == "insert":  # derives nothing, at a price
                _advance(put, rule, dot, begin, value, (INSERT, "I"))
            elif symbol in _EDITS:
                if j < len(rows) and (cost := _scan(symbol, rows[j])):
                    _advance(lambda new, v: scanned_next.__setitem__(new, min(v, scanned_next.get(new, v))), rule, dot, begin, value, cost)
            else:
                for i in by_head[symbol] if symbol not in STATES else ():
                    put((i, 0, j), (0, ""))
                done = chart.get((symbol, j if symbol not in STATES else 0, True))
                if done is not None and (symbol not in STATES or j == 0):
                    _advance(put, rule, dot, begin, value, done)
        scanned = list(scanned_next.items())
        if j > 1:
            charts[j - 1] = None  # type: ignore[call-overload]
    return {state: chart[state, 0, True] for state in STATES if (state, 0, True) in chart}


def _advance(put, rule: int, dot: int, begin: int, a: tuple[int, str], b: tuple[int, str]) -> None:
    head, body = _RULES[rule]
    put((head, begin, True) if dot + 1 == len(body) else (rule, dot + 1, begin), (a[0] + b[0], a[1] + b[1]))


def best(found: dict[str, tuple[int, str]]) -> tuple[tuple[int, str], str]:
    """The root's (cost, audit), and the state in which it ends."""
    return min((found[state], state) for state in (EMPTY, REPLY) if state in found)


def _after(role: str) -> str:
    return {"s": OPENED, "u": ASKED, "a": REPLY}[role[:1]]


def repaired(rows: list[tuple[str, str]], audit: str, state: str = EMPTY) -> list[tuple[str, str]]:
    """Role and text of the turns that an audit makes of rows, from a state on."""
    out, left = [], iter(rows)
    for edit in audit:
        role, text = next(left) if edit != "I" else ("", "")
        if edit == "D":
            continue
        role = role if edit == "K" else "assistant" if state == ASKED else "user"
        out.append((role, text))
        state = _after(role)
    return out


def symbols(rows: list[tuple[str, str]], seen: set) -> tuple[str, list[int]]:
    """What the parser sees of rows, and how many are blank, duplicate and truncated.  seen: rows before them."""
    out, faults = [], [0, 0, 0]
    for role, text in rows:
        plain = text.strip(SPACE)
        letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
        if not plain or (role, text) in seen:
            faults[0 if not plain else 1] += 1
            letter = "d"
        elif plain[-1] not in ".!?":
            faults[2] += 1
            letter = letter.upper()
        seen.add((role, text))
        out.append(letter)
    return "".join(out), faults


def gaps(turns: list[int | None], last: int | None) -> tuple[int, int | None]:
    """Turn numbers left out among sorted turns that follow the last one, and the new last one."""
    found = sorted({t for t in turns if t is not None and t != last})
    if not found:
        return 0, last
    return found[-1] - (found[0] - 1 if last is None else last) - len(found), found[-1]


def illegal(roles: list[str], last: str | None) -> tuple[int, str | None]:
    """Adjacent first letters that can't follow each other, and the new last one (None: no row yet)."""
    letters = [*([] if last is None else [last]), *(r[:1] for r in roles)]
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:])), letters[-1] if letters else None


def _key(role: str, text: str) -> bytes:
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


_L, _S = pa.int64(), pa.string()
_TURNS = pa.list_(pa.struct([("role", _S), ("text", _S)]))
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_WAYS = pa.list_(pa.struct([("entry", _S), ("exit", _S), ("cost", _L), ("audit", _S)]))
PARTS = pa.schema([("conv_id", _L), ("part", _L), *[(c, _L) for c in _COUNTS], ("audit", _S), ("turns", _TURNS)])
_SEGMENTS = pa.schema([("conv_id", _L), ("segment", _L), ("whole", pa.bool_()), ("numbers", pa.list_(_L)), ("turns", _TURNS), ("keys", pa.list_(pa.binary()))])
_TABLES = pa.schema([("conv_id", _L), ("segment", _L), ("numbers", pa.list_(_L)), ("letters", pa.list_(_S)), ("ways", _WAYS)])
_PATHS = pa.schema([("at", _L), ("entry", _S), ("last_turn", _L), ("last_letter", _S), ("cost", _L), ("audit", _S)])
_DIGESTS = pa.schema([("conv_id", _L), *[(c, _L) for c in _COUNTS], ("audit", _S), ("repaired_sha256", _S)])


def _typed(schema: pa.Schema, out: list[tuple]) -> pa.RecordBatch:
    columns = zip(*out, strict=True) if out else ([] for _ in schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _map(rows: DataFrame, function, schema: pa.Schema) -> DataFrame:
    return rows.mapInArrow(function, from_arrow_schema(schema))


def _turns(rows: list[tuple[str, str]]) -> list[dict]:
    return [{"role": r, "text": t} for r, t in rows]


def _part(conv, part, rows, numbers, faults, cost, audit, state=EMPTY, last_turn=None, last_letter=None) -> tuple:
    return (conv, part, gaps(numbers, last_turn)[0], *faults, illegal([r for r, _ in rows], last_letter)[0], cost, audit, _turns(repaired(rows, audit, state)))


def segments(rows: DataFrame) -> DataFrame:
    """Sorted rows in segments; whole ones are all of their conversation.  A segment's rows keep their copies apart."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    copies = F.coalesce(F.col("copies").cast("int"), F.lit(1)) if "copies" in rows.columns else F.lit(1)
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), empty("role"), empty("text"), copies.alias("copies"))
    rows = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_of_task = TaskContext.get().partitionId() << 33
        made, begun, chars = 0, 0, 0
        held: list[tuple] = []  # rows of the open segment
        conv, known, split = None, False, True  # split: an earlier task may have rows of this conversation

        def close(whole: bool) -> tuple:
            nonlocal made, held, chars
            rows = [(r, t) for _, r, t in held]
            keys = [] if whole else [_key(*x) for x in rows]
            row = (conv, first_of_task + made, whole, [n for n, _, _ in held], _turns(rows), keys)
            made, held, chars = made + 1, [], 0
            return row

        for batch in batches:
            out = []
            for new, turn, role, text, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not known or new != conv:
                    if known:
                        out.append(close(whole=not split))
                        begun += 1
                    conv, known, split = new, True, begun == 0
                for _ in range(n):
                    if held and (len(held) >= SEGMENT_ROWS or chars + len(text) > SEGMENT_CHARS):
                        split = True
                        out.append(close(whole=False))
                    held.append((turn, role, text))
                    chars += len(text)
            yield _typed(_SEGMENTS, out)
        if known:
            yield _typed(_SEGMENTS, [close(whole=False)])  # a later task may have more of it

    return _map(rows, run, _SEGMENTS)


def _known_before(split: DataFrame) -> DataFrame:
    """at, known: keys of a segment that an earlier segment of its conversation has.  A segment names a key once, so no key
    has more rows here than the conversation has segments."""
    keys = split.select("conv_id", "segment", F.explode(F.array_distinct("keys")).alias("key"))
    first = keys.groupBy(F.col("conv_id").alias("of"), F.col("key").alias("first_key")).agg(F.min("segment").alias("first"))
    later = keys.join(first, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("first_key")) & (F.col("segment") > F.col("first")))
    return later.groupBy(F.col("segment").alias("at")).agg(F.collect_list("key").alias("known"))


def _rows_of(x: dict) -> list[tuple[str, str]]:
    return [(t["role"], t["text"]) for t in x["turns"]]


def _symbols_of(x: dict) -> tuple[str, list[int]]:
    """As symbols(), with what earlier segments have."""
    before = set(x["known"] or ())
    rows = _rows_of(x)
    return symbols(rows, {row for row, key in zip(rows, x["keys"], strict=True) if key in before} if before else set())


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in (y for i in range(batch.num_rows) for y in batch.slice(i, 1).to_pylist()):
            rows, _ = _symbols_of(x)
            ways = [{"entry": a, "exit": b, "cost": c, "audit": audit} for a in STATES for b, (c, audit) in parse(rows, a).items()]
            roles = [t["role"] for t in x["turns"]]
            numbers = [n for n in x["numbers"] if n is not None]
            yield _typed(_TABLES, [(x["conv_id"], x["segment"], numbers[-1:], [r[:1] for r in roles[-1:]], ways)])


class _Way:
    """A segment's audit on a way through a conversation, and the way before it."""

    __slots__ = ("audit", "before", "cost", "own", "entry")

    def __init__(self, before: _Way | None, entry: str, cost: int, audit: str):
        self.before, self.entry, self.own, self.audit = before, entry, cost, audit
        self.cost = cost + (before.cost if before else 0)

    def __lt__(self, other: _Way) -> bool:
        if self.cost != other.cost:
            return self.cost < other.cost
        a, b, x, y = [], [], self, other
        while x is not y:  # as far as the two differ
            a.append(x.audit)
            b.append(y.audit)
            x, y = x.before, y.before
        return "".join(reversed(a)) < "".join(reversed(b))


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cheapest way through each conversation's segments, which come in order."""
    conv, ways, passed = None, None, []

    def finish() -> pa.RecordBatch:
        chosen = ways[EMPTY] if EMPTY in ways and (REPLY not in ways or ways[EMPTY] < ways[REPLY]) else ways[REPLY]
        links = []
        while chosen.before is not None:
            links.append(chosen)
            chosen = chosen.before
        out, turn, letter = [], None, None
        for link, (segment, numbers, letters) in zip(reversed(links), passed, strict=True):
            out.append((segment, link.entry, turn, letter, link.own, link.audit))
            turn, letter = (numbers or [turn])[0], (letters or [letter])[0]
        return _typed(_PATHS, out)

    for batch in batches:
        for x in (y for i in range(batch.num_rows) for y in batch.slice(i, 1).to_pylist()):
            if ways is not None and x["conv_id"] != conv:
                yield finish()
                ways = None
            if ways is None:
                conv, ways, passed = x["conv_id"], {EMPTY: _Way(None, EMPTY, 0, "")}, []
            passed.append((x["segment"], x["numbers"], x["letters"]))
            new: dict[str, _Way] = {}
            for way in x["ways"]:
                if way["entry"] in ways:
                    found = _Way(ways[way["entry"]], way["entry"], way["cost"], way["audit"])
                    if way["exit"] not in new or found < new[way["exit"]]:
                        new[way["exit"]] = found
            ways = new
    if ways is not None:
        yield finish()


def _whole_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
            out = []
            for x in some.to_pylist():
                rows = _rows_of(x)
                read, faults = symbols(rows, set())
                (cost, audit), _ = best(parse(read))
                out.append(_part(x["conv_id"], x["segment"], rows, x["numbers"], faults, cost, audit))
            yield _typed(PARTS, out)


def _split_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in (y for i in range(batch.num_rows) for y in batch.slice(i, 1).to_pylist()):
            _, faults = _symbols_of(x)
            yield _typed(PARTS, [_part(x["conv_id"], x["segment"], _rows_of(x), x["numbers"], faults, x["cost"], x["audit"], x["entry"], x["last_turn"], x["last_letter"])])


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repaired conversations as PARTS: those of one part, and parts of the others, in the order of their numbers.  Counts
    and costs of parts add up, their audits and turns follow each other.

    rows: conv_id, turn, role, text, and copies (how often a row stands there; 1 unless given)."""
    found = materialize(segments(rows), "segments")
    whole = _map(found.where("whole"), _whole_parts, PARTS)
    split = found.where("not whole")
    split = materialize(split.join(_known_before(split), F.col("segment") == F.col("at"), "left").drop("at"), "split")
    tables = materialize(_map(split, _tables, _TABLES), "tables")
    paths = _map(tables.repartition("conv_id").sortWithinPartitions("conv_id", "segment"), _paths, _PATHS)
    parts = _map(split.join(paths, F.col("segment") == F.col("at")).drop("at"), _split_parts, PARTS)
    return whole, parts


def digests(whole: DataFrame, parts: DataFrame) -> DataFrame:
    """conv_id, the counts, cost, audit and repaired_sha256 (of `role:text` lines) of each conversation.  A digest needs a
    conversation's texts in order: parts pass through one task for each conversation, a part at a time."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    alone = whole.select("conv_id", *_COUNTS, "audit", F.sha2(lines.cast("binary"), 256).alias("repaired_sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sums, audit, digest, begun = None, None, [], None, False

        def row() -> pa.RecordBatch:
            return _typed(_DIGESTS, [(conv, *sums, "".join(audit), digest.hexdigest())])

        for batch in batches:
            for x in (y for i in range(batch.num_rows) for y in batch.slice(i, 1).to_pylist()):
                if sums is not None and x["conv_id"] != conv:
                    yield row()
                    sums = None
                if sums is None:
                    conv, sums, audit, digest, begun = x["conv_id"], [0] * len(_COUNTS), [], hashlib.sha256(), False
                sums = [a + x[c] for a, c in zip(sums, _COUNTS, strict=True)]
                audit.append(x["audit"])
                for turn in x["turns"]:
                    digest.update(f"{chr(10) if begun else ''}{turn['role']}:{turn['text']}".encode())
                    begun = True
        if sums is not None:
            yield row()

    return alone.unionByName(_map(parts.repartition("conv_id").sortWithinPartitions("conv_id", "part"), run, _DIGESTS))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows as a checksum of `conv_id:turn` (nulls: one space) spoils them: 1 in 20 each is dropped, emptied, loses its sentence
    ends, is repeated, or becomes the user's."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(kind <= 1, "").when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    role = F.when(kind == 4, "user").otherwise(space("role"))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))
