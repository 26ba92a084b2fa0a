"""Minimum-cost repair of the roles of a conversation, and its rendering."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridspark.functions.sizing import stored

ROLES = ("system", "user", "assistant")
START = len(ROLES)
#: Legal turns: which role may follow a role; the last row is the start.
NEXT = {"system": ("user",), "user": ("assistant",), "assistant": ("user",), None: ("system", "user")}
FINAL = ("user", "assistant")
COSTS = {"relabel": 3.0, "name": 1.0, "merge": 2.0, "merge_other": 4.0, "insert": 2.5}
OPEN, CLOSE = "<|im_start|>{role}\n", "<|im_end|>\n"
_LEGAL = np.array([[ROLES[r] in NEXT[ROLES[s] if s < START else None] for r in range(START)] for s in range(START + 1)])


def steps(role: str | None):
    """Ways to treat a turn of this role: (state before, state after, cost, op, inserted role).

    The state is the role of the last rendered turn. A turn is kept, relabelled (cheaper where its
    role is no known one), merged into the turn before, or put behind one empty turn."""
    own = ROLES.index(role) if role in ROLES else None
    out = []
    for s in range(START + 1):
        if s < START:
            out.append((s, s, COSTS["merge" if own == s else "merge_other"] if own is not None else COSTS["merge"], "merge", None))
        for r in range(START):
            cost = 0.0 if own == r else COSTS["name" if own is None else "relabel"]
            op = "keep" if own == r else "relabel"
            if _LEGAL[s, r]:
                out.append((s, r, cost, op, None))
            out += [(s, r, cost + COSTS["insert"], op, q) for q in range(START) if _LEGAL[s, q] and _LEGAL[q, r]]
    return out


class Repair:
    """Cheapest way between any two states for each role, ties to the first in the order of :func:`steps`."""

    def __init__(self):
        self.cost, self.way = {}, {}
        for role in (*ROLES, None):
            c = np.full((START + 1, START + 1), np.inf)
            way = {}
            for s, r, cost, op, q in steps(role):
                if cost < c[s, r]:
                    c[s, r] = cost
                    way[s, r] = (op, q)
            self.cost[role], self.way[role] = c, way

    @staticmethod
    def known(role):
        return role if role in ROLES else None

    def matrix(self, roles) -> np.ndarray:
        """Least cost from each state before the turns to each state after."""
        total = np.where(np.eye(START + 1) > 0, 0.0, np.inf)
        for role in roles:
            total = (total[:, :, None] + self.cost[self.known(role)][None]).min(1)
        return total

    def path(self, roles, entry: int, leave: int):
        """(states after each turn, ops, inserted roles) of the cheapest way from entry to leave."""
        best = np.full(START + 1, np.inf)
        best[entry] = 0
        back = []
        for role in roles:
            c = best[:, None] + self.cost[self.known(role)]
            back.append(c.argmin(0))
            best = c.min(0)
        after, ops, put, state = [], [], [], leave
        for role, b in zip(reversed(roles), reversed(back)):
            before = int(b[state])
            op, q = self.way[self.known(role)][before, state]
            after.append(state)
            ops.append(op)
            put.append(q)
            state = before
        return after[::-1], ops[::-1], put[::-1]


def _last(cost_row: np.ndarray) -> int:
    """The cheapest state in which a conversation may end."""
    ends = [ROLES.index(r) for r in FINAL]
    return min(ends, key=lambda r: (cost_row[r], r))


def _pieces(batches):
    """Consecutive rows with equal (conv, part), also across batches, as tables."""
    held, key = [], None
    for b in batches:
        if not b.num_rows:
            continue
        conv, part = b.column("conv").to_numpy(), b.column("part").to_numpy()
        cuts = np.flatnonzero((conv[1:] != conv[:-1]) | (part[1:] != part[:-1])) + 1
        for a, z in zip([0, *cuts], [*cuts, b.num_rows]):
            if key is not None and key != (conv[a], part[a]):
                yield key, pa.Table.from_batches(held)
                held = []
            key = (conv[a], part[a])
            held.append(b.slice(a, z - a))
    if held:
        yield key, pa.Table.from_batches(held)


def repair(turns: DataFrame) -> DataFrame:
    """One row for each turn: (conv_id, turn, role, role_out, op, inserted, piece).

    Turns of a conversation go in the order of turn, role, text, nulls first. ``role_out`` is the
    role under which the text is rendered, ``inserted`` the role of an empty turn before it (null:
    none), and ``piece`` what the turn adds to the rendered conversation: the pieces in that order,
    put together, are the whole of it. The sum of costs is the least possible; the result is
    legal: an optional system turn, then user and assistant by turns, ending with either. A null
    or unknown role counts as an unnamed one. Null and empty texts render as empty. Repeated turns
    are turns of their own; null ids are one conversation. No rows give no rows.

    Rows are range-partitioned by conversation and turn and stored, so that a conversation with a
    third of all turns lies in many parts. Each part gives the least costs between its first and
    last states (a 4 x 4 min-plus matrix); the matrices of a conversation are chained, at most one
    for each partition, which fixes the states at its parts' ends, and every part then finds its
    own way between them.
    """
    spark = turns.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = ["conv_id", "turn", "role", "text"]
    conv = F.coalesce(F.xxhash64(F.col("conv_id").cast("string")), F.lit(0)).alias("conv")
    rows = turns.select(*key, conv).repartitionByRange(n, "conv", *key)
    rows = stored(rows.withColumn("part", F.spark_partition_id()), "chat-turns")
    dealt = rows.repartition(n, "conv", "part").sortWithinPartitions("conv", "part", *key)

    def measure(batches):
        r = Repair()
        keys, out = [], []
        for k, t in _pieces(batches):
            keys.append(k)
            out.append(r.matrix(t.column("role").to_pylist()).ravel())
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int32()),
                                              pa.array([list(x) for x in out], pa.list_(pa.float64()))], ["conv", "part", "cost"])

    def chain(batches):
        for b in batches:
            if not b.num_rows:
                continue
            convs, sizes, ends = b.column("conv"), [], []
            for parts in b.column("parts").to_pylist():
                costs = [np.array(p["cost"]).reshape(START + 1, START + 1) for p in sorted(parts, key=lambda p: p["part"])]
                best, back = np.full(START + 1, np.inf), []
                best[START] = 0
                for c in costs:
                    all_ways = best[:, None] + c
                    back.append(all_ways.argmin(0))
                    best = all_ways.min(0)
                leave, found = _last(best), []
                for p, choice in zip(sorted((p["part"] for p in parts), reverse=True), reversed(back)):
                    entry = int(choice[leave])
                    found.append({"part": p, "entry": entry, "leave": leave, "last": not found})
                    leave = entry
                ends.append(found)
            yield pa.RecordBatch.from_arrays([convs, pa.array(ends, pa.list_(pa.struct([
                ("part", pa.int32()), ("entry", pa.int32()), ("leave", pa.int32()), ("last", pa.bool_())])))], ["conv", "ends"])

    def render(batches):
        r = Repair()
        names = ["conv_id", "turn", "role"]
        for _, t in _pieces(batches):
            roles, texts = t.column("role").to_pylist(), t.column("text").to_pylist()
            first = t.slice(0, 1).to_pylist()[0]
            after, ops, put = r.path(roles, first["entry"], first["leave"])
            out, before = [], first["entry"]
            for k, (state, op, q, text) in enumerate(zip(after, ops, put, texts)):
                piece = ""
                if op == "merge":
                    piece = "\n" + (text or "")
                else:
                    if before < START:
                        piece += CLOSE
                    if q is not None:
                        piece += OPEN.format(role=ROLES[q]) + CLOSE
                    piece += OPEN.format(role=ROLES[state]) + (text or "")
                if first["last"] and k == len(after) - 1:
                    piece += CLOSE
                out.append(piece)
                before = state
            t = t.select(names).combine_chunks()
            yield from t.append_column("role_out", pa.array([ROLES[s] for s in after], pa.string())).append_column(
                "op", pa.array(ops, pa.string())).append_column("inserted", pa.array([None if q is None else ROLES[q] for q in put], pa.string())
            ).append_column("piece", pa.array(out, pa.string())).to_batches()

    costs = dealt.select("conv", "part", "role").mapInArrow(measure, "conv long, part int, cost array<double>")
    costs = costs.groupBy("conv").agg(F.collect_list(F.struct("part", "cost")).alias("parts"))  # at most a matrix for each partition
    ends = costs.mapInArrow(chain, "conv long, ends array<struct<part:int,entry:int,leave:int,last:boolean>>")
    ends = ends.select("conv", F.explode("ends").alias("e")).select(F.col("conv").alias("c"), F.col("e.part").alias("p"), "e.entry", "e.leave", "e.last")
    rows = rows.join(ends, (F.col("conv") == F.col("c")) & (F.col("part") == F.col("p"))).drop("c", "p")
    rows = rows.repartition(n, "conv", "part").sortWithinPartitions("conv", "part", *key)
    kinds = [f"{c} {turns.schema[c].dataType.simpleString()}" for c in ("conv_id", "turn", "role")]
    return rows.mapInArrow(render, ", ".join(kinds) + ", role_out string, op string, inserted string, piece string")
