"""Repair of conversation structure by an auction shortest-path algorithm.

A conversation's rows have to become a sequence of roles ``(s?(ua)+)?`` by the cheapest edits: Keep (0), Rerole to
user or assistant (3), Delete (4), Insert an empty user or assistant turn (3); a truncated row that isn't deleted costs
3 more; blank and duplicate rows have to be deleted. The edits are the arcs of a lattice whose nodes are (row, state): what
is left to read, and what the repaired conversation ends with (nothing, s, u or a).

The auction algorithm holds a price for each node, at most the cost of any arc plus the price at its end, and a path
from the origin. At the path's last node it either raises the price to the least such sum and contracts the path, or, where
the price has reached it, extends the path by that arc, until the path ends at the destination. Then the origin's price
is the least cost, and an arc is tight if its cost is the difference of its ends' prices; the cheapest repairs are the
tight paths, and the one of least edit initials is found by following tight arcs in that order and leaving dead ends.

Rows are taken in blocks of BLOCK from the end, and the prices of one block's first nodes are what the block before
it pays at its last ones. So prices rise by little, and the work is linear in the rows. A conversation of up to LONG_ROWS
rows and LONG_BYTES of text is repaired within one task, which holds one conversation at a time. Longer ones are
split: ranks by range partitions, duplicates by grouping, pieces of PIECE rows with costs from each first to each last
state (auctions in parallel), a chain over pieces, which holds 16 numbers for PIECE rows, and edits piece by piece. Only the audit
is one value for each conversation, a letter for each edit, and the digest, which reads the repaired rows in order as a stream.

Null ids are a conversation of their own, null turns come first, null roles and texts are one space. Rows of one turn are
ordered by role and text. Repeated rows are duplicates. A conversation without rows has zeros, an empty audit and the
empty text's digest. Columns other than the four are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from .common import discard, ranked, slices, written

# Costs of edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: nothing yet, system, user, assistant; what may follow each by keeping a row of an initial; and where an inserted or reroled turn leads.
START, SYSTEM, USER, ASSISTANT = range(4)
KEEP = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
TURN = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Costs and edits from each state when no row is left.
AT_END, END_EDITS = (0, 6, 3, 0), ("", "II", "I", "")
LEGAL = ("su", "ua", "au")
BLOCK = 48
LONG_ROWS, LONG_BYTES, PIECE = 20_000, 32 << 20, 4096
#: Ids of long conversations are broadcast up to this many.
BROADCAST_LONG = 100_000
FAR = 1 << 60
SPACE = " \t\n\v\f\r"


def _arcs(symbol: str) -> tuple[list[tuple[str, int, int]], ...]:
    """From each state: (edit, cost, state after) that use up a row of the symbol, in order of the edits' initials."""
    out = []
    for state in range(4):
        arcs = [("D", DELETE, state)]
        if symbol != "x":
            extra = TRUNCATED if symbol in "UAS!" else 0
            to = KEEP[state].get(symbol.lower())
            if to is not None:
                arcs.append(("K", extra, to))
            arcs.append(("R", REROLE + extra, TURN[state]))
        out.append(arcs)
    return tuple(out)


#: Symbols of rows: initials u, a, s and ? (others), capital (and !) if truncated, x if blank or duplicate.
ARCS = {c: _arcs(c) for c in "uas?UAS!x"}


class Block:
    """The lattice of some rows' symbols; exits: the prices after the last row, by state."""

    def __init__(self, symbols: str, exits: tuple[int, ...]):
        self.symbols, self.exits, self.m = symbols, exits, len(symbols)
        self.end = 4 * (self.m + 1)
        self.price = [min(exits)] * self.end + [0]
        system = any(c in "sS" for c in symbols)
        near = ((START, SYSTEM, USER, ASSISTANT) if system else (START, USER, ASSISTANT), (SYSTEM, USER, ASSISTANT), (USER, ASSISTANT), (USER, ASSISTANT))
        self.entries = tuple(self._auction(s) if min(exits[f] for f in near[s]) < FAR else FAR for s in range(4))

    def arcs(self, node: int) -> list[tuple[str, int, int]]:
        """(edit, cost, node after), in order of the edits' initials; the destination is reached without an edit."""
        i, state = divmod(node, 4)
        if i == self.m:
            return [("", self.exits[state], self.end)] if self.exits[state] < FAR else []
        used = [(e, c, node + 4 - state + to) for e, c, to in ARCS[self.symbols[i]][state]]
        return [used[0], ("I", INSERT, node - state + TURN[state]), *used[1:]]

    def _auction(self, origin: int) -> int:
        price, path = self.price, [origin]
        while path[-1] != self.end:
            node = path[-1]
            best, to = min(((c + price[j], j) for _, c, j in self.arcs(node)), default=(FAR, -1))
            if price[node] < best:
                price[node] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)
        return price[origin]

    def trace(self, state: int) -> tuple[str, int]:
        """The least edits from a first state along tight arcs, and the state after the last row."""
        price, dead = self.price, set()
        nodes, edits = [state], []
        ways = [iter(self.arcs(state))]
        while nodes[-1] != self.end:
            node = nodes[-1]
            for edit, cost, to in ways[-1]:
                if price[node] == cost + price[to] and to not in dead:
                    nodes.append(to)
                    edits.append(edit)
                    ways.append(iter(self.arcs(to)) if to != self.end else iter(()))
                    break
            else:
                dead.add(nodes.pop())
                edits.pop()
                ways.pop()
        return "".join(edits), nodes[-2] % 4


class Repair:
    """The blocks of a sequence of symbols; exits: prices by state after the last of them."""

    def __init__(self, symbols: str, exits: tuple[int, ...] = AT_END):
        self.blocks: list[Block] = []
        for at in range((len(symbols) - 1) // BLOCK * BLOCK, -1, -BLOCK):
            self.blocks.append(Block(symbols[at : at + BLOCK], exits))
            exits = self.blocks[-1].entries
        self.blocks.reverse()
        self.entries = exits

    def edits(self, state: int = START) -> tuple[str, int]:
        """The least edits from a state, and the state after them."""
        out = []
        for b in self.blocks:
            some, state = b.trace(state)
            out.append(some)
        return "".join(out), state


def symbol(role: str, fault: str) -> str:
    if fault in ("blank", "duplicate"):
        return "x"
    c = role[:1] if role[:1] in ("u", "a", "s") else "?"
    return c if not fault else "!" if c == "?" else c.upper()


def faults(rows: list[tuple[str, str]]) -> list[str]:
    """The first fault of each row (role, text), or "" if it has none."""
    seen, out = set(), []
    for row in rows:
        shown = row[1].rstrip(SPACE)
        out.append("blank" if not shown else "duplicate" if row in seen else "" if shown[-1] in ".!?" else "truncated")
        seen.add(row)
    return out


def illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))


def repaired(rows: Iterator[tuple[str, str]], edits: str, state: int = START) -> Iterator[str]:
    """``role:text`` of each turn after the edits."""
    for edit in edits:
        role, text = next(rows) if edit != "I" else ("", "")
        if edit == "D":
            continue
        state = KEEP[state][role[:1]] if edit == "K" else TURN[state]
        yield f"{role if edit == 'K' else ROLE[state]}:{text}"


RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def _repaired_one(rows: list[tuple]) -> tuple:
    """The result of one conversation's rows (turn, role, text) in order."""
    turns = [r[0] for r in rows if r[0] is not None]
    two = [r[1:] for r in rows]
    bad = faults(two)
    solved = Repair("".join(symbol(r[0], f) for r, f in zip(two, bad, strict=True)))
    edits, state = solved.edits()
    edits += END_EDITS[state]
    text = hashlib.sha256("\n".join(repaired(iter(two), edits)).encode("utf-8", "surrogatepass")).hexdigest()
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, bad.count("blank"), bad.count("duplicate"), bad.count("truncated"), illegal([r[0][:1] for r in two]), solved.entries[START], edits, text


def damaged(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text after the damage that a checksum of id and turn picks; rows that it drops stay, with ``gone``."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = F.crc32(F.concat(word(conv), F.lit(":"), word(turn)).cast("binary")) % 20
    body = F.when(d == 1, "").when(d == 2, F.regexp_replace(word(text), "[.!?]", "")).otherwise(word(text))
    rows = df.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.when(d == 4, "user").otherwise(word(role)).alias("role"), body.alias("text"), (d == 0).alias("gone"), F.explode(F.sequence(F.lit(1), F.when(d == 3, 2).otherwise(1))).alias("copy_"))
    return rows.drop("copy_")


def repair(rows: DataFrame) -> DataFrame:
    """conv and RESULT of conversations (conv, turn, role, text, gone); rows that are ``gone`` only name their conversation."""
    sizes = rows.where("not gone").groupBy("conv").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    long = written(sizes.where((F.col("n") > LONG_ROWS) | (F.col("bytes") > LONG_BYTES)).select(F.col("conv").alias("long_")), "long")
    number = long.count()
    if not number:
        discard(long)
        return _short(rows)
    side = F.broadcast(long) if number <= BROADCAST_LONG else long
    is_long = rows["conv"].eqNullSafe(side["long_"])
    return _short(rows.join(side, is_long, "left_anti")).unionByName(_long(rows.where("not gone").join(side, is_long, "left_semi")))


def _short(rows: DataFrame) -> DataFrame:
    """Conversations that fit into a task's memory one by one."""
    kind = rows.schema["conv"].dataType
    target = to_arrow_type(kind)
    by = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "text")]
    names = ["conv", *[c.split()[0] for c in RESULT.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def every():
            for batch in batches:
                for part in slices(batch, 3, 2 << 20):
                    yield from zip(*[c.to_pylist() for c in part.columns], strict=True)

        def table(done):
            types = (target, *[pa.int64()] * 6, pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)

        done, held = [], 0
        for conv, own in groupby(every(), key=itemgetter(0)):
            done.append((conv, *_repaired_one([r[1:4] for r in own if not r[4]])))
            held += len(done[-1][7]) + 200
            if held > 1 << 20:
                yield table(done)
                done, held = [], 0
        if done:
            yield table(done)

    ordered = rows.select("conv", "turn", "role", "text", "gone").repartition("conv").sortWithinPartitions(*by)
    return ordered.mapInArrow(run, f"conv {kind.simpleString()}, {RESULT}")


# Long conversations, piece by piece.


def _mapped(df: DataFrame, keep: list[str], schema: str, fn) -> DataFrame:
    """Each row (a dict) to rows of ``schema`` (tuples) after its kept columns."""
    out_schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                made = [(*[row[c] for c in keep], *r) for r in fn(row)]
                if made:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in made], schema=target)

    shape = df.sparkSession.createDataFrame([], out_schema).schema
    target, names = to_arrow_schema(shape), shape.names
    return df.mapInArrow(run, out_schema)


def _piece_costs(row: dict) -> list[tuple]:
    """From each first to each last state, FAR where no edits lead."""
    costs = [Repair(row["symbols"], tuple(0 if g == f else FAR for g in range(4))).entries for f in range(4)]
    return [([costs[f][s] for s in range(4) for f in range(4)],)]


def _piece_exits(row: dict) -> list[tuple]:
    """The prices after each piece, from the last to the first; and before it."""
    exits, out = list(AT_END), []
    for p in sorted(row["pieces"], key=lambda p: -p["piece"]):
        before = [min(p["costs"][4 * s + f] + exits[f] for f in range(4)) for s in range(4)]
        out.append((p["piece"], exits, before[START]))
        exits = before
    return out


def _piece_edits(row: dict) -> list[tuple]:
    """Edits of a piece and the state after it, from each first state from which an end can be reached."""
    solved = Repair(row["symbols"], tuple(row["exits"]))
    both = [solved.edits(s) for s in range(4)]
    return [([e for e, _ in both], [s for _, s in both])]


def _piece_entries(row: dict) -> list[tuple]:
    """The state before each piece, and the edits after the last one."""
    state, out = START, []
    pieces = sorted(row["pieces"], key=lambda p: p["piece"])
    for i, p in enumerate(pieces):
        entry, state = state, p["after"][state]
        out.append((p["piece"], entry, END_EDITS[state] if i == len(pieces) - 1 else ""))
    return out


def _row_edits(row: dict) -> list[tuple]:
    """For each row of a piece: its rank, the turns inserted before it, and what becomes of its role (null: deleted, "": kept); turns
    after the last row have a rank of their own."""
    state, rank, before, out = row["entry"], row["begin"], [], []
    for edit, c in _with_symbols(row["edits"], row["symbols"]):
        if edit == "I":
            state = TURN[state]
            before.append(f"{ROLE[state]}:")
            continue
        if edit == "K":
            state = KEEP[state][c.lower()]
        elif edit == "R":
            state = TURN[state]
        out.append((rank, before, None if edit == "D" else "" if edit == "K" else ROLE[state]))
        rank, before = rank + 1, []
    return out + ([(rank, before, None)] if before else [])


def _with_symbols(edits: str, symbols: str) -> Iterator[tuple[str, str]]:
    rest = iter(symbols)
    for e in edits:
        yield e, "" if e == "I" else next(rest)


def _long(rows: DataFrame) -> DataFrame:
    """Conversations of any length: nothing but slim values of a conversation's pieces meets in one task."""
    conv_of = "grp", "conv"
    rows = rows.select(F.coalesce(F.concat(F.lit("c"), F.col("conv").cast("string")), F.lit("")).alias("grp"), "conv", "turn", "role", "text")
    rows = written(ranked(rows, "grp", ["turn", "role", "text"]), "rows")
    firsts = rows.groupBy("grp", "role", F.sha2(F.col("text").cast("binary"), 256)).agg(F.min("rank").alias("rank")).select("grp", "rank", F.lit(True).alias("first"))
    blank, init = ~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.substring("role", 1, 1)
    cut = F.col("text").rlike(r"[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*\z")
    known = F.when(init.isin("u", "a", "s"), init).otherwise("?")
    slim = rows.join(firsts, ["grp", "rank"], "left").select(*conv_of, "rank", "turn", init.alias("init"), blank.alias("blank"), (~blank & F.col("first").isNull()).alias("duplicate"), (~blank & F.col("first").isNotNull() & cut).alias("truncated"), known.alias("known"))
    letter = F.when(F.col("blank") | F.col("duplicate"), "x").when(F.col("truncated"), F.when(F.col("known") == "?", "!").otherwise(F.upper("known"))).otherwise(F.col("known"))
    slim = written(slim.withColumn("symbol", letter).drop("known"), "slim")
    counts = slim.groupBy(*conv_of).agg(*[F.count_if(c).alias(c) for c in ("blank", "duplicate", "truncated")], (F.max("turn") - F.min("turn") + 1).alias("span"))
    turns = slim.where("turn is not null").select("grp", "turn").distinct().groupBy("grp").agg(F.count("*").alias("turns"))

    piece = F.floor(F.col("rank") / PIECE).cast("long").alias("piece")
    pieces = slim.groupBy("grp", piece).agg(F.array_sort(F.collect_list(F.struct("rank", "symbol", "init"))).alias("own"))  # at most PIECE rows each
    pieces = pieces.select("grp", "piece", F.array_join("own.symbol", "").alias("symbols"), F.col("own.init").alias("inits"))
    with_last = F.concat(F.coalesce(F.array(F.lag(F.element_at("inits", -1)).over(Window.partitionBy("grp").orderBy("piece"))), F.array()), F.col("inits"))
    pairs = F.size(F.filter(F.arrays_zip(F.slice("near", 1, F.size("near") - 1).alias("a"), F.slice("near", 2, F.size("near")).alias("b")), lambda p: ~F.concat(p["a"], p["b"]).isin(*LEGAL)))
    near = pieces.withColumn("near", F.filter(with_last, lambda x: x.isNotNull()))
    pieces = written(near.withColumn("illegal", F.when(F.size("near") > 1, pairs).otherwise(0)).drop("near", "inits"), "pieces")

    costs = written(_mapped(pieces, ["grp", "piece"], "costs array<bigint>", _piece_costs), "costs")
    exits = _mapped(costs.groupBy("grp").agg(F.collect_list(F.struct("piece", "costs")).alias("pieces")), ["grp"], "piece bigint, exits array<bigint>, cost bigint", _piece_exits)
    exits = written(exits, "exits")
    edits = written(_mapped(pieces.join(exits, ["grp", "piece"]).select("grp", "piece", "symbols", "exits"), ["grp", "piece", "symbols"], "edits array<string>, after array<int>", _piece_edits), "edits")
    entries = _mapped(edits.groupBy("grp").agg(F.collect_list(F.struct("piece", "after")).alias("pieces")), ["grp"], "piece bigint, entry int, tail string", _piece_entries)
    audits = written(edits.join(entries, ["grp", "piece"]).select("grp", "piece", (F.col("piece") * PIECE).alias("begin"), "symbols", "entry", F.concat(F.col("edits")[F.col("entry")], "tail").alias("edits")), "audits")

    own = _mapped(audits, ["grp"], "rank bigint, before array<string>, new string", _row_edits)
    role = F.when(F.col("new") == "", F.col("role")).otherwise(F.col("new"))
    lines = F.concat("before", F.when(F.col("new").isNotNull(), F.array(F.concat(role, F.lit(":"), F.col("text")))).otherwise(F.array().cast("array<string>")))
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def every():
            for batch in batches:
                for part in slices(batch, 1, 2 << 20):
                    yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)

        for grp, some in groupby(every(), key=itemgetter(0)):
            sha, sep = hashlib.sha256(), b""
            for _, line in some:
                sha.update(sep + line.encode("utf-8", "surrogatepass"))
                sep = b"\n"
            yield pa.RecordBatch.from_arrays([pa.array([grp]), pa.array([sha.hexdigest()])], names=["grp", "sha"])

    # lines of one row keep their order: a line's place among them is part of the sort
    lined = own.join(rows.select("grp", "rank", "role", "text"), ["grp", "rank"], "left").select("grp", "rank", F.posexplode(lines).alias("k", "line"))
    digests = lined.repartition("grp").sortWithinPartitions("grp", "rank", "k").select("grp", "line").mapInArrow(hashed, "grp string, sha string")
    whole = audits.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("piece", "edits"))).alias("own")).select("grp", F.array_join("own.edits", "").alias("audit"))
    total = exits.where("piece = 0").select("grp", "cost")
    wrong = pieces.groupBy("grp").agg(F.sum("illegal").alias("illegal"))
    out = counts.join(turns, "grp", "left").join(total, "grp").join(wrong, "grp").join(whole, "grp").join(digests, "grp", "left")
    return out.select("conv", F.coalesce(F.col("span") - F.col("turns"), F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op13_auction_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))).withColumnRenamed("conv", "conv_id")


QUERIES = {"op13_auction_repair": op13_auction_repair}


def _sql() -> str:
    # DuckDB has no crc32: the key's bytes are taken one by one, and the eight bits of each are shifted through
    step = "list_reduce(list_prepend(xor(c, ascii(substr(k, i + 1, 1))::bigint), range(0, 8)), lambda a, b: case when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end)"
    space = "[^\\x20\\x09-\\x0D]"
    # the least (cost, edits, repaired turns) of each state: 0 nothing, 1 system, 2 user, 3 assistant
    state = lambda c, e, t: f"{{'c': {c}, 'e': {e}, 't': {t}}}"
    none = state("1000000000::bigint", "''", "[]::varchar[]")
    least = lambda *xs: f"list_sort([{', '.join(xs)}])[1]"
    more = lambda s, c, e, t: state(f"{s}.c + {c}", f"{s}.e || '{e}'", f"list_append({s}.t, {t})" if t else f"{s}.t")
    put = lambda s, r: more(s, INSERT, "I", f"'{r}:'")
    user1 = least("s2", put("s0", "user"), put("s1", "user"), put("s3", "user"))
    grown = f"select g, p, s0, s1, u as s2, {least('s3', put('u', 'assistant'))} as s3 from (select *, {user1} as u from {{table}})"
    # an assistant turn put in may be followed by a user turn put in
    closed = f"select g, p, s0, s1, {least('s2', put('s3', 'user'))} as s2, s3 from ({grown})"
    body = "r.role || ':' || r.body"
    may = lambda ok, x: f"case when {ok} and not bad then {x} else {none} end"
    kept = lambda s, i: may(f"init = '{i}'", more(s, "extra", "K", body))
    turn = lambda s, to: may("true", more(s, f"{REROLE} + extra", "R", f"'{to}:' || r.body"))
    gone = lambda s: more(s, DELETE, "D", "")
    nexts = [
        gone("s0"), least(gone("s1"), kept("s0", "s")),
        least(gone("s2"), kept("s0", "u"), kept("s1", "u"), kept("s3", "u"), turn("s0", "user"), turn("s1", "user"), turn("s3", "user")),
        least(gone("s3"), kept("s2", "a"), turn("s2", "assistant")),
    ]
    stepped = ", ".join(f"{x} as s{i}" for i, x in enumerate(nexts))
    return f"""
with recursive crc(k, i, c) as (select distinct coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), 0, 4294967295::bigint from conversations union all select k, i + 1, {step} from crc where i < length(k)),
dealt as (select k, xor(c, 4294967295) % 20 as d from crc where i = length(k)),
rows_ as (select coalesce(conv_id::varchar, '') as g, turn, case when d = 4 then 'user' else coalesce(role, ' ') end as role,
    case d when 1 then '' when 2 then regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') else coalesce(text, ' ') end as body, unnest(range(0, case d when 0 then 0 when 3 then 2 else 1 end))
  from conversations join dealt on k = coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')),
placed as materialized (select *, row_number() over (partition by g order by turn nulls first, role, body) as p from rows_),
marked as (select *, left(role, 1) as init, not regexp_matches(body, '{space}') as blank, row_number() over (partition by g, role, body order by p) > 1 as again, not regexp_matches(body, '[.!?][\\x20\\x09-\\x0D]*$') as cut,
    lag(left(role, 1)) over (partition by g order by p) as before from placed),
faulty as materialized (select *, blank or again as bad, case when cut then {TRUNCATED} else 0 end as extra from marked),
best(g, p, s0, s1, s2, s3) as (
  {closed.replace("{table}", f"(select distinct coalesce(conv_id::varchar, '') as g, 0::bigint as p, {state('0::bigint', "''", '[]::varchar[]')} as s0, {none} as s1, {none} as s2, {none} as s3 from conversations)")}
  union all
  {closed.replace("{table}", f"(select r.g, r.p, {stepped} from best b join faulty r on r.g = b.g and r.p = b.p + 1)")}),
ends as (select g, least_.c as cost, least_.e as audit, array_to_string(least_.t, chr(10)) as text from (select g, {least('s0', 's3')} as least_ from best qualify row_number() over (partition by g order by p desc) = 1)),
counts as (select g, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank, count(*) filter (again and not blank) as duplicate, count(*) filter (cut and not bad) as truncated,
    count(*) filter (before is not null and before || init not in ({", ".join(f"'{x}'" for x in LEGAL)})) as illegal from faulty group by g)
select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, cost, audit, sha256(text) as repaired_sha256
from (select distinct conv_id from conversations) c join ends e on e.g = coalesce(c.conv_id::varchar, '') left join counts n on n.g = e.g
"""


SQL: dict[str, str] = {"op13_auction_repair": _sql()}
