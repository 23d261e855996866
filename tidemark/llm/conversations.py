"""Repair of the structure of conversations, and the damage that tests it.

A conversation's rows, in order of turn (nulls first; rows of one turn by a hash of role and text), each have at most one
fault: blank (no character but white space), duplicate (role and text seen earlier) or truncated (the last character that is
no white space is none of `.!?`). The cheapest edits that give role initials `(s?(ua)+)?` are found by a dynamic program over
four states. Its paths are a persistent structure (`Prefixes`): edit strings share their prefixes as linked nodes, each with
its ancestors at distances of powers of two and a rolling hash. Of two paths of one cost the ASCII-least stays; the place where
they part is searched by hashes of ancestors, and the common prefix that the hashes promise is checked letter by letter
down to the node that both share, so a collision never decides.

How it scales: rows are dealt by ranges of (conversation, turn, hash), so a conversation of any length is spread over tasks. A
conversation that lies within one task and has at most `long` rows is repaired there, in a stream. Others are cut into
blocks of at most `long` rows: each block gives its cheapest edits from each state to each other, those few are folded in
order, and the blocks then write their repaired rows. What one task does for a whole conversation is what its row holds: the
audit, and SHA-256, which reads the repaired rows one after another in constant memory.

Odd rows: a null role or text is one space (so a null text is blank), a null id or turn is one space in the key of the damage.
Null ids make one conversation. Rows equal in all columns are a row and its duplicates. A conversation without
rows after the damage has zeros, an empty audit and the hash of the empty string. An empty table gives none. Further columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored

SPACE = " \t\n\x0b\f\r"
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
#: State after the roles so far: 0 none, 1 "s", 2 "...u", 3 "...a". The role that may come next, and the state it leads to.
NEXT = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}
ENDS = (0, 3)
ROLE = {"u": "user", "a": "assistant"}
MODULUS, BASE = (1 << 61) - 1, 1_000_003


class Prefixes:
    """Edit strings as a tree of nodes: node 0 is the empty string, every other one is its parent and a letter."""

    def __init__(self):
        self.letter, self.depth, self.hash, self.up = [""], [0], [0], [[]]

    def add(self, parent: int, letter: str) -> int:
        up, depth = [parent], self.depth[parent] + 1
        while 2 << (len(up) - 1) <= depth:
            up.append(self.up[up[-1]][len(up) - 1])
        self.letter.append(letter)
        self.depth.append(depth)
        self.hash.append((self.hash[parent] * BASE + ord(letter)) % MODULUS)
        self.up.append(up)
        return len(self.letter) - 1

    def ancestor(self, node: int, depth: int) -> int:
        while (far := self.depth[node] - depth) > 0:
            node = self.up[node][far.bit_length() - 1]
        return node

    def spell(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def same(self, a: int, b: int) -> bool:
        """Whether two nodes of one depth spell the same, by their letters down to a node that both share."""
        while a != b:
            if self.letter[a] != self.letter[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether string a comes before string b, by a search for their longest common prefix."""
        if a == b:
            return False
        depth = min(self.depth[a], self.depth[b])
        x, y = self.ancestor(a, depth), self.ancestor(b, depth)
        if self.hash[x] == self.hash[y]:
            if self.same(x, y):
                return self.depth[a] < self.depth[b]
            return self.spell(a) < self.spell(b)
        for k in reversed(range(depth.bit_length())):
            if k < len(self.up[x]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                x, y = self.up[x][k], self.up[y][k]
        if not self.same(self.up[x][0], self.up[y][0]):
            return self.spell(a) < self.spell(b)
        return self.letter[x] < self.letter[y]


def cheaper(paths: Prefixes, best: dict, state: int, cost: int, node: int, letter: str) -> None:
    """Puts the path (node, letter) into `best` where it costs less than the one there, or as much and comes first."""
    old = best.get(state)
    if old is None or cost < old[0]:
        best[state] = (cost, paths.add(node, letter))
    elif cost == old[0]:
        new = paths.add(node, letter)
        if paths.less(new, old[1]):
            best[state] = (cost, new)


def inserted(paths: Prefixes, at: dict) -> dict:
    """The states reached with any number of inserted rows."""
    at = dict(at)
    for _ in range(3):
        before = dict(at)
        for state, (cost, node) in before.items():
            cheaper(paths, at, NEXT[state][1], cost + INSERT, node, "I")
        if at == before:
            break
    return at


def edits(rows: list[tuple], start: int) -> dict[int, tuple[int, str]]:
    """From state `start` over rows of (initial, must be deleted, truncated): state -> (least cost, its ASCII-least edits)."""
    paths = Prefixes()
    at = {start: (0, 0)}
    for initial, gone, cut in rows:
        best: dict = {}
        for state, (cost, node) in inserted(paths, at).items():
            cheaper(paths, best, state, cost + DELETE, node, "D")
            if gone:
                continue
            role, target = NEXT[state]
            more = CUT if cut else 0
            if initial == role:
                cheaper(paths, best, target, cost + KEEP + more, node, "K")
            elif initial == "s" and state == 0:
                cheaper(paths, best, 1, cost + KEEP + more, node, "K")
            cheaper(paths, best, target, cost + REROLE + more, node, "R")
        at = best
    return {state: (cost, paths.spell(node)) for state, (cost, node) in at.items()}


def joined(left: dict, rights: dict[int, dict]) -> dict[int, tuple]:
    """Edits of two runs of rows, one after the other: state -> (cost, edits, states where the runs begin)."""
    best: dict = {}
    for middle, (cost, text, states) in left.items():
        for state, (more, further) in rights[middle].items():
            new = (cost + more, text + further, [*states, middle])
            if state not in best or new[:2] < best[state][:2]:
                best[state] = new
    return best


def finished(at: dict) -> tuple:
    """The end: rows inserted after the last one, and a state in which a conversation may end."""
    best: dict = {}
    for state, (cost, text, states) in at.items():
        for n in range(3):
            if state in ENDS and (not best or (cost, text) < best[0][:2]):
                best[0] = (cost, text, states)
            state, cost, text = NEXT[state][1], cost + INSERT, text + "I"
    return best[0]


def repaired(rows: list[tuple], audit: str, state: int = 0) -> Iterator[str]:
    """The lines `role:text` that the edits of `audit` make of rows of (role, text), beginning in `state`."""
    at = iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(at)
        if edit == "D":
            continue
        if edit == "K":
            state = 1 if role[:1] == "s" else NEXT[state][1]
        else:
            role, state = ROLE[NEXT[state][0]], NEXT[state][1]
        yield f"{role}:{text}"


def damaged(df: DataFrame) -> DataFrame:
    """Rows of conversations after the damage: (conv, turn, role, text, gone, initial, blank, truncated, mix).

    `conv` is the id as text, empty if null; dropped rows stay as rows with `gone`, so that no conversation is lost.
    """
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20
    rows = df.select(
        F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string"))).alias("conv"), F.col("turn").cast("long").alias("turn"),
        kind.alias("kind"), F.when(kind == 4, "user").otherwise(word("role")).alias("role"),
        F.when(kind == 0, None).when(kind == 1, "").when(kind == 2, F.translate(word("text"), ".!?", "")).otherwise(word("text")).alias("text"),
    )
    rows = rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    end = F.rtrim("text", F.lit(SPACE))
    return rows.select(
        "conv", "turn", F.when(F.col("kind") == 0, "").otherwise(F.col("role")).alias("role"), "text", (F.col("kind") == 0).alias("gone"), F.substring("role", 1, 1).alias("initial"),
        (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("truncated"), F.xxhash64("role", "text").alias("mix"),
    )


RESULT = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
OPEN = "part int, pos long, turn long, role string, text string, gone boolean, initial string, faulty string"
FAULTS = ("blank", "duplicate", "truncated")
_PLACE = {"conv": pa.string(), "part": pa.int32(), "block": pa.int64()}
_TOTALS = {n: pa.int64() for n in (*FAULTS, "illegal")}
_EDITS = pa.list_(pa.list_(pa.struct({"state": pa.int64(), "cost": pa.int64(), "edits": pa.string()})))
BLOCK = pa.schema(_PLACE | _TOTALS | {"low": pa.int64(), "high": pa.int64(), "distinct": pa.int64(), "first": pa.string(), "last": pa.string(), "maps": _EDITS})
WHOLE = pa.schema({"conv": pa.string(), "gaps": pa.int64(), **_TOTALS, "cost": pa.int64(), "audit": pa.string(), "cuts": pa.list_(pa.struct({"part": pa.int32(), "block": pa.int64(), "state": pa.int64(), "edits": pa.string()}))})
LINES = pa.schema(_PLACE | {"n": pa.int64(), "line": pa.string()})


def counts(rows: list[tuple]) -> dict:
    """What a run of rows (turn, initial, fault) adds up to, with what its ends tell the runs beside it."""
    turns = [t for t, _, _ in rows if t is not None]
    distinct = sum(1 for i, t in enumerate(turns) if i == 0 or t != turns[i - 1])
    initials = [i for _, i, _ in rows]
    out = {f: sum(1 for r in rows if r[2] == f) for f in FAULTS}
    out["illegal"] = sum(1 for a, b in zip(initials, initials[1:]) if a + b not in ("su", "ua", "au"))
    return out | {"low": turns[0] if turns else None, "high": turns[-1] if turns else None, "distinct": distinct, "first": initials[0] if rows else None, "last": initials[-1] if rows else None}


def gaps(low: int | None, high: int | None, distinct: int) -> int:
    return 0 if low is None else min(high - low + 1 - distinct, (1 << 63) - 1)


def rows_of(column, **types) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column.get(n, []), t) for n, t in types.items()], list(types))


def repair(rows: DataFrame, long: int = 8192, long_bytes: int = 1 << 25) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation of `damaged` rows."""
    kinds = {"conv": pa.string(), "gaps": pa.int64(), **{f: pa.int64() for f in FAULTS}, "illegal": pa.int64(), "cost": pa.int64(), "audit": pa.string(), "repaired_sha256": pa.string()}
    types = kinds | {"part": pa.int32(), "pos": pa.int64(), "turn": pa.int64(), "role": pa.string(), "text": pa.string(), "gone": pa.bool_(), "initial": pa.string(), "faulty": pa.string()}

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        done, held, seen = {n: [] for n in types}, [], set()
        conv, opened, size, pos = None, True, 0, 0  # the first conversation may have begun in the task before

        def put(**values):
            for n in types:
                done[n].append(values.get(n))

        def let_go(last: bool):
            nonlocal held, size
            if opened or last:
                for p, turn, role, text, gone, initial, fault in held:
                    put(conv=conv, part=part, pos=p, turn=turn, role=role, text=text, gone=gone, initial=initial, faulty=fault)
            else:
                put(conv=conv, **closed([r for r in held if not r[4]]))
            held, size = [], 0

        for batch in batches:
            for c, turn, role, text, gone, initial, blank, cut, _ in zip(*(col.to_pylist() for col in batch.columns)):
                if c != conv:
                    if conv is not None:
                        let_go(False)
                        opened = False
                    conv, seen = c, set()
                pos += 1
                fault = None if gone else "blank" if blank else "truncated" if cut else ""
                if not gone and not blank and not opened:
                    key = hashlib.sha256(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass")).digest()
                    if key in seen:
                        fault = "duplicate"
                    seen.add(key)
                held.append((pos, turn, role, text, gone, initial, fault))
                size += len(text or "")
                if len(held) > long or size > long_bytes:
                    opened = True
                    seen = set()
                if opened and len(held) >= 1024 or size > long_bytes:
                    let_go(False)
            if len(done["conv"]) >= 4096:
                yield rows_of(done, **types)
                done.update({n: [] for n in types})
        if conv is not None:
            let_go(True)
        yield rows_of(done, **types)

    dealt = rows.repartitionByRange("conv", F.col("turn").asc_nulls_first(), "mix").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "mix", "role", "text")
    found = stored(dealt.mapInArrow(streamed, f"{RESULT}, {OPEN}"), "conversations")
    names = [c.split()[0] for c in RESULT.split(", ")]
    return found.where("part is null").select(*names).unionByName(across_tasks(found.where("part is not null").drop(*names[1:]), long))


def closed(rows: list[tuple]) -> dict:
    """The result of a conversation whose rows (pos, turn, role, text, gone, initial, fault) are all here."""
    found = counts([(r[1], r[5], r[6]) for r in rows])
    cost, audit, _ = finished({s: (c, text, []) for s, (c, text) in edits([(r[5], r[6] in ("blank", "duplicate"), r[6] == "truncated") for r in rows], 0).items()})
    out = "\n".join(repaired([(r[2], r[3]) for r in rows], audit))
    return {n: found[n] for n in (*FAULTS, "illegal")} | {"gaps": gaps(found["low"], found["high"], found["distinct"]), "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(out.encode()).hexdigest()}


def across_tasks(rows: DataFrame, long: int) -> DataFrame:
    """The same for conversations whose rows lie in several tasks, or are many: blocks, their fold, and the repaired rows in order."""
    at = F.struct("part", "pos")
    keyed = rows.withColumns({"key": F.when(~F.col("gone") & (F.col("faulty") != "blank"), F.sha2("text", 256)), "at": at, "block": F.floor(F.col("pos") / long)})
    first = keyed.where("key is not null").groupBy("conv", "role", "key").agg(F.min("at").alias("first"))
    faults = keyed.join(first, ["conv", "role", "key"], "left").withColumn("faulty", F.when(F.col("at") > F.col("first"), "duplicate").otherwise(F.col("faulty")))
    faults = stored(faults.select("conv", "part", "block", "pos", "turn", "role", "text", "gone", "initial", "faulty"), "conversation_rows")

    def of_block(key: tuple, table: pa.Table) -> pa.Table:
        kept = [(r["turn"], r["initial"], r["faulty"]) for r in sorted(table.to_pylist(), key=lambda r: r["pos"]) if not r["gone"]]
        tested = [(i, f in ("blank", "duplicate"), f == "truncated") for _, i, f in kept]
        maps = [[{"state": s, "cost": c, "edits": text} for s, (c, text) in edits(tested, start).items()] for start in NEXT]
        names = dict(zip(("conv", "part", "block"), (k.as_py() for k in key)))
        return pa.Table.from_pylist([names | counts(kept) | {"maps": maps}], BLOCK)

    fields = "conv string, part int, block long, blank long, duplicate long, truncated long, illegal long, low long, high long, distinct long, first string, last string, maps array<array<struct<state:long,cost:long,edits:string>>>"
    blocks = stored(faults.drop("role", "text").groupBy("conv", "part", "block").applyInArrow(of_block, fields), "conversation_blocks")

    def folded(key: tuple, table: pa.Table) -> pa.Table:
        at, pieces = {0: (0, "", [])}, sorted(table.to_pylist(), key=lambda b: (b["part"], b["block"]))
        total, low, high, distinct, last = dict.fromkeys((*FAULTS, "illegal"), 0), None, None, 0, None
        for b in pieces:
            at = joined(at, {start: {x["state"]: (x["cost"], x["edits"]) for x in m} for start, m in enumerate(b["maps"])})
            for n in total:
                total[n] += b[n]
            if b["low"] is not None:
                distinct += b["distinct"] - (b["low"] == high)
                low, high = b["low"] if low is None else low, b["high"]
            if b["first"] is not None:
                total["illegal"] += last is not None and last + b["first"] not in ("su", "ua", "au")
                last = b["last"]
        cost, audit, states = finished(at)
        begin, cuts = 0, []
        for b, state, following in zip(pieces, states, [*states[1:], None]):
            own = {x["state"]: x["edits"] for x in b["maps"][state]}
            end = len(audit) if following is None else begin + len(own[following])
            cuts.append({"part": b["part"], "block": b["block"], "state": state, "edits": audit[begin:end]})
            begin = end
        return pa.Table.from_pylist([{"conv": key[0].as_py(), "gaps": gaps(low, high, distinct), **total, "cost": cost, "audit": audit, "cuts": cuts}], WHOLE)

    fields = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, cuts array<struct<part:int,block:long,state:long,edits:string>>"
    whole = stored(blocks.groupBy("conv").applyInArrow(folded, fields), "conversation_edits")
    cuts = whole.select("conv", F.explode("cuts").alias("c")).select("conv", "c.*")

    def written(key: tuple, table: pa.Table, cut: pa.Table) -> pa.Table:
        rows = [(r["role"], r["text"]) for r in sorted(table.to_pylist(), key=lambda r: r["pos"]) if not r["gone"]]
        at = cut.to_pylist()[0]
        conv, part, block = (k.as_py() for k in key)
        return pa.Table.from_pylist([{"conv": conv, "part": part, "block": block, "n": n, "line": line} for n, line in enumerate(repaired(rows, at["edits"], at["state"]))], LINES)

    lines = faults.groupBy("conv", "part", "block").cogroup(cuts.groupBy("conv", "part", "block")).applyInArrow(written, "conv string, part int, block long, n long, line string")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, out = None, None, {"conv": [], "repaired_sha256": []}

        def end():
            if conv is not None:
                out["conv"].append(conv)
                out["repaired_sha256"].append(digest.hexdigest())

        for batch in batches:
            for c, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if c != conv:
                    end()
                    conv, digest = c, hashlib.sha256(line.encode())
                else:
                    digest.update(b"\n" + line.encode())
        end()
        yield rows_of(out, conv=pa.string(), repaired_sha256=pa.string())

    hashes = lines.repartition("conv").sortWithinPartitions("conv", "part", "block", "n").select("conv", "line").mapInArrow(hashed, "conv string, repaired_sha256 string")
    return whole.drop("cuts").join(hashes, "conv", "left").withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())))


def repair_damaged(df: DataFrame, long: int = 8192) -> DataFrame:
    """One row for each conversation id of `df` (conv_id, turn, role, text): its faults, the cheapest edits and the hash of the repaired rows."""
    kind = df.schema["conv_id"].dataType
    out = repair(damaged(df.select("conv_id", "turn", "role", "text")), long)
    return out.select(F.when(F.col("conv") != "", F.expr("substring(conv, 2)").cast(kind)).alias("conv_id"), *out.columns[1:])
