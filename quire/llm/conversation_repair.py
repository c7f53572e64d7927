"""Repair of the structure of conversations: the cheapest edits that give
them the role initials ``(s?(ua)+)?``, by a Viterbi search whose chunks run in
parallel and converge in rank.

States: nothing written yet, after s, after u, after a.  Going back over the
rows, a vector holds for each state the least cost of all that is left.
Edits: Delete 4 (the only one for blank rows and repeated ones), Insert an
empty text 3, Keep 0 (where the grammar has the row's initial next), Rerole
to the role that the grammar has next 3; a truncated row that is not deleted
costs 3 more.

1. Rows are range-partitioned by conversation, turn, role and a hash of the
   text, without the texts, so a conversation of any length is spread over
   tasks; each task cuts what it holds into chunks of CHUNK rows, one
   character a row.
2. Every chunk goes back from a speculative vector (all zero) to its start.
   Fix-up passes put the next chunk's vector in its place and go back again
   beside the old vector, but only until the two differ by a constant: from
   there on all does.  Passes run until no chunk has a vector that differs
   from its neighbour's by more than a constant.  In practice one or two do.
3. Differences of these stitched vectors say at every row which edits are on
   a cheapest way; the chunks take the ASCII-least one.  The state in which a
   chunk begins is speculative at first, too, and fixed up in passes.
4. The texts move once, by conversation, together with the chunks' audits, and
   stream through the edits.  One hash over all texts of a conversation has to
   read them one after the other; nothing is held but the running hash.

Nulls: a null text or role is one space; a null turn comes first and a null
conversation is one.  Rows equal in turn are ordered by role, then by the MD5
of their text.  Blank is what holds no character but x20 and x09 to x0D.  An
empty table gives an empty table; other columns are left out, whatever their
names; texts and conversations may have any length.
"""

from __future__ import annotations

import hashlib
from collections import deque

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from quire.llm.common import arrow_map, ship, stored, with_fields

#: Rows in a chunk.
CHUNK = 4096
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
START, S, U, A = range(4)
#: The state after an inserted or reroled row, and after a kept one.
NEXT = (U, U, A, U)
KEPT = {"s": {START: S}, "u": {START: U, S: U, A: U}, "a": {U: A}}
#: Cost from each state where no row is left: inserts up to an end.
END = [0, 6, 3, 0]
ROLE = {U: "user", A: "assistant"}
KEY = ["conv_id", "turn", "role", "h"]


# ------------------------------------------------------------------ one chunk

def before(code: str, v: list[int]) -> tuple[list[int], list[int]]:
    """Least costs before a row (with inserts first, without), from those
    behind it.  Codes: the role's initial, or o; upper case: truncated;
    -: must go."""
    plain = []
    for s in range(4):
        cost = DELETE + v[s]
        if code != "-":
            more = TRUNCATED if code.isupper() else 0
            cost = min(cost, REROLE + more + v[NEXT[s]])
            to = KEPT.get(code.lower(), {}).get(s)
            if to is not None:
                cost = min(cost, more + v[to])
        plain.append(cost)
    return [min(plain[s], INSERT + plain[NEXT[s]], 2 * INSERT + plain[NEXT[NEXT[s]]]) for s in range(4)], plain


def parallel(a: list[int], b: list[int]) -> bool:
    """Whether two vectors differ by a constant."""
    return len({x - y for x, y in zip(a, b)}) == 1


def backward(codes: str, v: list[int], old: list[int] | None = None) -> list[int] | None:
    """The vector before the chunk, less its least entry, from the one behind
    it.  With ``old``, the vector that was used before: None as soon as both
    differ by a constant, for then the result stands."""
    for code in reversed(codes):
        if old is not None:
            if parallel(v, old):
                return None
            old = before(code, old)[0]
        v = before(code, v)[0]
    if old is not None and parallel(v, old):
        return None
    return [x - min(v) for x in v]


def trace(codes: str, v: list[int], state: int, last: bool) -> tuple[int, int, str]:
    """(state behind the chunk, cost, the ASCII-least of the cheapest edits),
    from a state before it and the vector behind it."""
    rows = []
    for code in reversed(codes):
        whole, plain = before(code, v)
        rows.append((code, whole, plain, v))
        v = whole
    audit, total = [], 0
    for code, whole, plain, after in reversed(rows):
        while True:
            left = whole[state]
            if plain[state] == left and DELETE + after[state] == left:
                audit.append("D")
                total += DELETE
                break
            # Inserts may come one after the other: each leaves ``whole`` less
            # by its cost, as it holds for the gap before the row.
            if INSERT + whole[NEXT[state]] == left:
                audit.append("I")
                total += INSERT
                state = NEXT[state]
                continue
            more = TRUNCATED if code.isupper() else 0
            to = KEPT.get(code.lower(), {}).get(state)
            if to is not None and more + after[to] == left:
                audit.append("K")
            else:
                to, more = NEXT[state], more + REROLE
                audit.append("R")
            total += more
            state = to
            break
    while last and END[state]:
        audit.append("I")
        total += INSERT
        state = NEXT[state]
    return state, total, "".join(audit)


# ------------------------------------------------------------------ rows and chunks

def _schemas(ddl: str):
    schema = _parse_datatype_string(ddl)
    return schema, to_arrow_schema(schema)


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage that crc32 of
    ``conv_id:turn`` modulo 20 stands for: 0 drops the row, 1 empties its
    text, 2 takes out . ! ?, 3 repeats it, 4 makes it the user's.  In the
    hashed text, too, a null is one space."""
    space = F.lit(" ")
    kind = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space),
                               F.coalesce(F.col("turn").cast("string"), space))) % 20
    t = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"),
                     F.coalesce("text", space).alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = (F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", ""))
            .otherwise(F.col("text")))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return t.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                    text.alias("text"), times.alias("time")).drop("time")


def keyed(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and the text's hash; nulls as one space."""
    return (rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                        F.coalesce("text", F.lit(" ")).alias("text"))
            .withColumn("h", F.unhex(F.md5("text"))))


def chunks(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row for each chunk: its place (part, seq), the codes of its rows,
    its first row's key and what its rows count."""
    solid = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    narrow = rows.select(*KEY, F.when(solid == "", "-").when(F.substring(solid, -1, 1).isin(".", "!", "?"), ".")
                         .otherwise("~").alias("end"))
    # Only what repeats is joined back: where it stands first.
    first = stored(narrow.groupBy("conv_id", "role", "h")
                   .agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("n")).filter("n > 1")
                   .select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("h").alias("x"), "first"),
                   "first-turns")
    later = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    marked = (narrow.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r"))
                          & (F.col("h") == F.col("x")), "left")
              .select(*KEY, "end", later.alias("later")))

    def run(batches):
        part = TaskContext.get().partitionId()
        key = piece = None
        seq = 0
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                conv, turn, role, h, end, later = row
                new_conv = key is None or key[0] != conv
                if new_conv or piece["n"] == chunk:
                    if piece:
                        out.append(piece)
                    seq = 0 if new_conv else seq + 1
                    piece = {"conv_id": conv, "part": part, "seq": seq, "n": 0, "codes": [], "turn": turn,
                             "role": role, "h": h, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0,
                             "turns": 0, "low": None, "head": turn, "tail": None, "first": None, "last": None}
                initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
                if end == "-":
                    piece["blank"] += 1
                    code = "-"
                elif later or row[:4] == key:
                    piece["duplicate"] += 1
                    code = "-"
                elif end == "~":
                    piece["truncated"] += 1
                    code = initial.upper()
                else:
                    code = initial
                if piece["n"] == 0:
                    piece["first"] = initial
                elif piece["last"] + initial not in ("su", "ua", "au"):
                    piece["illegal"] += 1
                if turn is not None and (piece["n"] == 0 or turn != piece["tail"]):
                    piece["turns"] += 1
                    piece["low"] = turn if piece["low"] is None else piece["low"]
                piece["codes"].append(code)
                piece["n"] += 1
                piece["last"], piece["tail"], key = initial, turn, row[:4]
            if out:
                yield rows_of(out)
        if piece:
            yield rows_of([piece])

    turn_type = rows.schema["turn"].dataType.simpleString()
    schema = (f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, part int, seq int, n long, codes string, "
              f"turn {turn_type}, role string, h binary, blank long, duplicate long, truncated long, illegal long, "
              f"turns long, low {turn_type}, head {turn_type}, tail {turn_type}, first string, last string")
    schema, arrow = _schemas(schema)

    def rows_of(pieces):
        return pa.RecordBatch.from_pylist([p | {"codes": "".join(p["codes"])} for p in pieces], arrow)

    ship(rows.sparkSession)
    ranged = marked.repartitionByRange(*KEY).sortWithinPartitions(*KEY)
    return ranged.mapInArrow(run, schema)


# ------------------------------------------------------------------ passes

def _conv(df: DataFrame):
    return Window.partitionBy("conv_id").orderBy("part", "seq")


def stitched_vectors(pieces: DataFrame) -> DataFrame:
    """pieces and ``behind``, the vector behind each chunk, right but for a
    constant.  Windows are over chunks, CHUNK rows each, not rows."""
    def first(batch, _):
        return [*batch.columns, [backward(c, v) for c, v in zip(batch.column(names["codes"]).to_pylist(),
                                                                batch.column(names["behind"]).to_pylist())]]

    def again(batch, _):
        out, used = [], []
        cols = [batch.column(fixed[c]).to_pylist() for c in ("codes", "behind", "ahead", "want")]
        for codes, v, found, want in zip(*cols):
            if want != v:
                new = backward(codes, want, v)
                found, v = found if new is None else new, want
            out.append(found), used.append(v)
        keep = [batch.column(i) for c, i in names.items() if c != "behind"]
        return [*keep, pa.array(used, pa.list_(pa.int64())), out]

    last = F.lead("seq").over(_conv(pieces)).isNull()
    guess = F.when(F.col("is_last"), F.array(*map(F.lit, END))).otherwise(F.array(*[F.lit(0)] * 4))
    start = pieces.withColumn("is_last", last).withColumn("behind", guess.cast("array<long>"))
    names = {c: i for i, c in enumerate(start.columns)}
    schema = with_fields(start.schema, "ahead array<long>")
    fixed = {c: i for i, c in enumerate([*start.columns, "ahead", "want"])}
    found = stored(arrow_map(start, first, schema), "vectors")
    while True:
        # A last chunk keeps its own vector, any other takes its neighbour's.
        want = found.withColumn("want", F.coalesce(F.lead("ahead").over(_conv(found)), F.col("behind")))
        if want.filter("want <> behind").isEmpty():
            return found.drop("ahead")
        found = stored(arrow_map(want, again, schema), "vectors")


def traced(pieces: DataFrame) -> DataFrame:
    """pieces with ``state`` before and ``out`` behind each chunk, its ``cost``
    and ``audit``."""
    def run(batch, _):
        out = []
        cols = [batch.column(names[c]).to_pylist() for c in ("codes", "behind", "want", "is_last")]
        for codes, v, state, last in zip(*cols):
            out.append(trace(codes, v, state, last))
        keep = [batch.column(i) for c, i in names.items() if c != "want"]
        return [*keep, batch.column(names["want"]), *([o[i] for o in out] for i in range(3))]

    def again(pieces):
        return stored(arrow_map(pieces, run, schema), "traces")

    start = pieces.withColumn("want", F.when(F.lag("seq").over(_conv(pieces)).isNull(), START).otherwise(A))
    names = {c: i for i, c in enumerate(start.columns)}
    schema = with_fields(pieces.schema, "state int, out int, cost long, audit string")
    found = again(start)
    while True:
        want = found.withColumn("want", F.coalesce(F.lag("out").over(_conv(found)), F.lit(START)))
        if want.filter("want <> state").isEmpty():
            return found
        found = again(want.select(*pieces.columns, "want"))


# ------------------------------------------------------------------ operators

def audits(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunks of ``keyed`` rows with their counts, cost and audit."""
    return traced(stitched_vectors(stored(chunks(rows, chunk), "chunks")))


def _mended(batches):
    """(conv_id, role, text) of repaired rows, and (conv_id, None, None) behind
    each conversation, from rows and audits in order."""
    conv, queue, state, open_ = None, deque(), START, False

    def inserts():
        nonlocal state
        while queue and queue[0] == "I":
            queue.popleft()
            state = NEXT[state]
            yield conv, ROLE[state], ""

    for batch in batches:
        for new, kind, role, text, audit in zip(*(c.to_pylist() for c in batch.columns)):
            if not open_ or new != conv:
                if open_:
                    yield from inserts()
                    yield conv, None, None
                conv, queue, state, open_ = new, deque(), START, True
            if kind == 0:
                queue.extend(audit)
                continue
            yield from inserts()
            edit = queue.popleft()
            if edit == "K":
                state = KEPT[role[0]][state]
                yield conv, role, text
            elif edit == "R":
                state = NEXT[state]
                yield conv, ROLE[state], text
    if open_:
        yield from inserts()
        yield conv, None, None


def _in_order(rows: DataFrame, found: DataFrame) -> DataFrame:
    cols = [*KEY, "kind", "part", "seq", "text", "audit"]
    none = F.lit(None)
    both = (rows.select(*KEY, F.lit(1).alias("kind"), none.cast("int").alias("part"), none.cast("int").alias("seq"),
                        "text", none.cast("string").alias("audit"))
            .unionByName(found.select(*KEY, F.lit(0).alias("kind"), "part", "seq",
                                      none.cast("string").alias("text"), "audit")))
    return (both.select(cols).repartition("conv_id").sortWithinPartitions(*KEY, "kind", "part", "seq")
            .select("conv_id", "kind", "role", "text", "audit"))


def repaired(rows: DataFrame, found: DataFrame, batch_rows: int = 4096) -> DataFrame:
    """(conv_id, place, role, text): the rows of every repaired conversation,
    from ``keyed`` rows and their ``audits``."""
    id_type = rows.schema["conv_id"].dataType.simpleString()

    def run(batches):
        out, place = [], 0
        for conv, role, text in _mended(batches):
            if role is None:
                place = 0
                continue
            out.append({"conv_id": conv, "place": place, "role": role, "text": text})
            place += 1
            if len(out) == batch_rows:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    schema, arrow = _schemas(f"conv_id {id_type}, place long, role string, text string")
    return _in_order(rows, found).mapInArrow(run, schema)


def hashes(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): the hash of a repaired conversation's
    ``role:text`` lines, as they stream by."""
    schema, arrow = _schemas(f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string")

    def run(batches):
        out, sha, mark = [], hashlib.sha256(), b""
        for conv, role, text in _mended(batches):
            if role is not None:
                sha.update(mark + f"{role}:{text}".encode("utf-8", "surrogatepass"))
                mark = b"\n"
                continue
            out.append({"conv_id": conv, "repaired_sha256": sha.hexdigest()})
            sha, mark = hashlib.sha256(), b""
            if len(out) == 4096:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    return _in_order(rows, found).mapInArrow(run, schema)


def repair(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Counts, cost, audit and hash of every conversation in ``ids``; one that
    has no rows: zeros, an empty audit, the hash of nothing."""
    rows = keyed(rows)
    found = audits(rows)
    w = _conv(found)
    same = F.coalesce(F.col("head") == F.lag("tail").over(w), F.lit(False))
    pair = F.concat(F.lag("last").over(w), F.col("first"))
    steps = found.select(
        "*", (F.col("turns") - same.cast("long")).alias("distinct"),
        F.when(pair.isNotNull() & ~pair.isin("su", "ua", "au"), 1).otherwise(0).alias("between"))
    total = (steps.groupBy("conv_id").agg(
        F.min("low").alias("low"), F.max("tail").alias("high"), F.sum("distinct").alias("distinct"),
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "cost")),
        (F.sum("illegal") + F.sum("between")).alias("illegal"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "seq", "audit"))),
                                 lambda s: s["audit"]), "").alias("audit"))
        .withColumn("gaps", F.when(F.col("high").isNull(), 0)
                    .otherwise(F.col("high") - F.col("low") + 1 - F.col("distinct"))))
    every = ids.select("conv_id").distinct()
    for side in (total.drop("low", "high", "distinct"), hashes(rows, found)):
        every = (every.join(side.withColumnRenamed("conv_id", "side_id"),
                            F.col("conv_id").eqNullSafe(F.col("side_id")), "left").drop("side_id"))
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return every.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts),
                        F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
