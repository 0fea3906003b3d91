"""Network state, change propagation, violations with their repairs, and runs in order of priority.

State is a set of immutable DataFrames; every step gives a new state. Comparisons with null neither hold nor fail: such rows
violate nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from condnet.common import children, materialize, parts
from condnet.operators.graph import path_entries, path_triples, shortest_paths

_CF = "fid bigint, pid bigint, sid bigint, nid bigint"
_META = "clock int, seq int, tables array<string>"


@dataclass(frozen=True)
class State:
    tp: DataFrame
    rm: DataFrame  # fid, src, dst, vol, fw, lb
    cf: DataFrame  # fid, pid, sid, nid
    delta: DataFrame  # seq, fid, src, dst, vol, isadd: changes of rm not yet applied
    acl: DataFrame  # end1, end2, allow
    users: DataFrame  # uid
    rates: DataFrame | None = None  # fid, rate
    chains: DataFrame | None = None  # gid1, gid2, mb
    groups: DataFrame | None = None  # gid, sid_array
    policies: DataFrame | None = None  # a conditional table
    events: DataFrame | None = None  # seq, kind, fid, src, dst, old_src, old_dst: what routing states are folded from; kept while set
    clock: int = 0
    seq: int = 0

    @staticmethod
    def start(spark, tp: DataFrame, **more) -> State:
        new = spark.createDataFrame
        blank = dict(
            rm=new([], "fid bigint, src bigint, dst bigint, vol int, fw int, lb int"), cf=new([], _CF), delta=new([], "seq bigint, fid bigint, src bigint, dst bigint, vol int, isadd int"),
            acl=new([], "end1 bigint, end2 bigint, allow int"), users=new([], "uid bigint"),
        )
        return State(tp=tp, **(blank | more))

    def written(self, since: State | None = None) -> State:
        """The same with every table, or those that differ from an earlier state's, written to the shared folder."""
        return replace(self, **{k: materialize(v, k) for k, v in self.__dict__.items() if isinstance(v, DataFrame) and (since is None or v is not getattr(since, k))})

    def save(self, folder: str) -> State:
        """The same, read from a folder that it is written to; the clock, written last, tells that all of it is there."""
        tables = {k: v for k, v in self.__dict__.items() if isinstance(v, DataFrame)}
        for k, v in tables.items():
            v.write.mode("overwrite").parquet(f"{folder}/{k}")
        spark = self.tp.sparkSession
        spark.createDataFrame([(self.clock, self.seq, sorted(tables))], _META).coalesce(1).write.mode("overwrite").parquet(f"{folder}/meta")
        return replace(self, **{k: spark.read.schema(v.schema).parquet(f"{folder}/{k}") for k, v in tables.items()})

    @staticmethod
    def load(spark, folder: str) -> State | None:
        """What save() has written; None where it isn't complete."""
        if "_SUCCESS" not in children(spark, f"{folder}/meta"):
            return None
        m = spark.read.schema(_META).parquet(f"{folder}/meta").first()
        return State(**{k: spark.read.parquet(f"{folder}/{k}") for k in m["tables"]}, clock=m["clock"], seq=m["seq"])


def reinit(s: State) -> State:
    """Everything emptied but the topology; the clock starts again."""
    return State.start(s.tp.sparkSession, s.tp)


# changes of the reachability matrix


def _delta(s: State, rows: DataFrame, isadd: int) -> DataFrame:
    return rows.select(F.lit(s.seq).cast("long").alias("seq"), *(F.col(c).cast("long") for c in ("fid", "src", "dst")), F.col("vol").cast("int").alias("vol"), F.lit(isadd).alias("isadd"))


def insert_flows(s: State, rows: DataFrame) -> State:
    """Add flows (fid, src, dst, vol, fw, lb): they wait as additions, and the firewall learns the way back of allowed sources."""
    acl = learn(s.acl, s.users, rows)
    return replace(s, rm=s.rm.unionByName(rows), delta=s.delta.unionByName(_delta(s, rows, 1)), acl=acl, events=_told(s, "ri", rows), seq=s.seq + 1)


def delete_flows(s: State, fids: DataFrame) -> State:
    """Remove flows by id: a deletion cancels waiting additions of its flow, and the firewall forgets what was the last flow of its pair."""
    gone = s.rm.join(fids.select("fid").distinct(), "fid", "left_semi")
    acl = forget(s.acl, s.users, s.rm, gone)
    waiting = s.delta.join(gone.select("fid", F.lit(1).alias("isadd")), ["fid", "isadd"], "left_anti").select(*s.delta.columns)
    return replace(s, rm=s.rm.join(gone.select("fid"), "fid", "left_anti"), delta=waiting.unionByName(_delta(s, gone, 0)), acl=acl, events=_told(s, "rd", gone), seq=s.seq + 1)


def move_flows(s: State, rows: DataFrame) -> State:
    """Other ends (fid, src, dst) for flows; each flow once. Nothing waits for it, but routing states see it."""
    new = rows.select("fid", F.col("src").alias("__src"), F.col("dst").alias("__dst"))
    moved = s.rm.join(new, "fid")
    rm = s.rm.join(new, "fid", "left").select(*(F.when(F.col("__dst").isNotNull() | F.col("__src").isNotNull(), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in ("src", "dst") else F.col(c) for c in s.rm.columns))
    told = moved.select("fid", F.col("__src").alias("src"), F.col("__dst").alias("dst"), F.col("src").alias("old_src"), F.col("dst").alias("old_dst"))
    return replace(s, rm=rm, events=_told(s, "ru", told), seq=s.seq + 1)


def _told(s: State, kind: str, rows: DataFrame) -> DataFrame | None:
    if s.events is None:
        return None
    col = lambda c: (F.col(c) if c in rows.columns else F.lit(None)).cast("long").alias(c)
    return s.events.unionByName(rows.select(F.lit(s.seq).cast("long").alias("seq"), F.lit(kind).alias("kind"), *map(col, ("fid", "src", "dst", "old_src", "old_dst"))))


def load_states(s: State) -> State:
    """From here on changes are kept for routing states."""
    return replace(s, events=s.rm.sparkSession.createDataFrame([], "seq bigint, kind string, fid bigint, src bigint, dst bigint, old_src bigint, old_dst bigint"))


def unload_states(s: State) -> State:
    return replace(s, events=None)


def handshake(s: State, ins: DataFrame, dele: DataFrame) -> State:
    """Forwarding rows to delete go, those to install come, and the clock ticks."""
    return replace(s, cf=apply_diff(s.cf, ins, dele), clock=s.clock + 1)


def change_flows(s: State, changes: DataFrame) -> State:
    """Insertions and deletions (seq, op I | D, fid, src, dst, vol, fw, lb) as if one came after the other: what a later deletion takes comes first, then all deletions, then what stays."""
    last = changes.where("op = 'D'").groupBy("fid").agg(F.max("seq").alias("__last"))
    new = changes.where("op = 'I'").join(last, "fid", "left")
    rows = lambda df: df.select("fid", "src", "dst", "vol", "fw", "lb")
    s = insert_flows(s, rows(new.where("seq < __last")))
    s = delete_flows(s, last.select("fid"))
    return insert_flows(s, rows(new.where("__last is null or seq > __last")))


def net_change(log: DataFrame) -> DataFrame:
    """(fid, deleted, added and the row's src, dst): what a log of additions and deletions (seq, fid, src, dst, isadd) leaves to do per flow.

    A deletion cancels additions before it; an addition after the last deletion stands.
    """
    last = F.max(F.when(F.col("isadd") == 0, F.col("seq")))
    per = log.groupBy("fid").agg(last.alias("last_del"), F.max_by(F.struct("src", "dst", "isadd"), "seq").alias("x"))
    return per.select("fid", F.col("last_del").isNotNull().alias("deleted"), (F.col("x.isadd") == 1).alias("added"), F.when(F.col("x.isadd") == 1, F.col("x.src")).alias("src"), F.when(F.col("x.isadd") == 1, F.col("x.dst")).alias("dst"))


def apply_changes(s: State) -> State:
    """Waiting changes of rm into forwarding rows: rows of deleted flows go, paths of added flows come, in that order."""
    net = net_change(s.delta)
    cf = s.cf.join(net.where("deleted").select("fid"), "fid", "left_anti").select("fid", "pid", "sid", "nid")
    new = path_triples(shortest_paths(s.tp, net.where("added").select("fid", "src", "dst")))
    return replace(s, cf=cf.unionByName(new), delta=s.delta.limit(0))


def apply_urm(rm: DataFrame, changes: DataFrame) -> DataFrame:
    """rm after the last change (seq, op I | D | U, fid, host1, host2) of each user flow: inserted and updated flows have vol 1 and nothing else set."""
    last = changes.groupBy("fid").agg(F.max_by(F.struct("op", "host1", "host2"), "seq").alias("x")).select("fid", "x.*")
    new = last.where("op <> 'D'").select("fid", F.col("host1").alias("src"), F.col("host2").alias("dst"), F.lit(1).alias("vol"))
    kinds = dict(rm.dtypes)
    return rm.join(last.select("fid"), "fid", "left_anti").select(*rm.columns).unionByName(new.select(*((F.col(c) if c in new.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in rm.columns)))


def apply_diff(cf: DataFrame, ins: DataFrame, dele: DataFrame) -> DataFrame:
    """Forwarding rows without those to delete, with those to install."""
    cols = ["fid", "pid", "sid", "nid"]
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in cols]
    return cf.select(*cols).alias("a").join(dele.select(*cols).alias("b"), same, "left_anti").union(ins.select(*cols))


def refuse_updates(before: DataFrame, after: DataFrame) -> DataFrame:
    """Forwarding rows may come and go, not change in place: after, or an error if a row that stays (by fid, pid, sid) leads elsewhere."""
    key = ["fid", "pid", "sid"]
    b, a = (x.groupBy(*key).agg(F.sort_array(F.collect_set("nid")).alias(n)) for x, n in ((before, "b"), (after, "a")))
    if not b.join(a, key).where((F.size("a") == F.size("b")) & (F.col("a") != F.col("b"))).isEmpty():
        raise ValueError("forwarding rows can't be updated; delete and insert them")
    return after


# firewall


def fw_violation(rm: DataFrame, acl: DataFrame) -> DataFrame:
    """(fid): flows with fw = 1 whose pair isn't allowed. Null-aware as a row NOT IN: a pair that a null leaves open is no violation."""
    f = rm.where("fw = 1").select("fid", "src", "dst")
    a = acl.select("end1", "end2")

    def unless(df: DataFrame, rows: DataFrame) -> DataFrame:
        """df, or nothing of it if there is any row."""
        return df.join(F.broadcast(rows.select(F.lit(1).alias("__n")).limit(1)), F.col("__n") == 1, "left_anti")

    def without(df: DataFrame, c: str, rows: DataFrame, e: str) -> DataFrame:
        """df without what has its end c among the ends e of rows."""
        return df.join(rows.select(F.col(e).alias("__e")).where("__e is not null"), F.col(c) == F.col("__e"), "left_anti")

    sure = f.where("src is not null and dst is not null").join(a.where("end1 is not null and end2 is not null"), (F.col("src") == F.col("end1")) & (F.col("dst") == F.col("end2")), "left_anti")
    # a null end allows whatever the other end doesn't rule out
    sure = without(without(sure, "dst", a.where("end1 is null"), "end2"), "src", a.where("end2 is null"), "end1")
    sure = unless(sure, a.where("end1 is null and end2 is null"))
    # a flow with a null end violates only where no allowed pair could be its own
    s1 = unless(without(f.where("src is null and dst is not null"), "dst", a, "end2"), a.where("end2 is null"))
    s2 = unless(without(f.where("dst is null and src is not null"), "src", a, "end1"), a.where("end1 is null"))
    s3 = unless(f.where("src is null and dst is null"), a)
    return sure.select("fid").unionByName(s1.select("fid")).unionByName(s2.select("fid")).unionByName(s3.select("fid"))


def learn(acl: DataFrame, users: DataFrame, new: DataFrame) -> DataFrame:
    """acl with (dst, src) of new flows from listed users, unless the pair is there the other way round."""
    mine = new.join(users.select(F.col("uid").alias("src")).distinct(), "src", "left_semi").select(F.col("src").cast("long"), F.col("dst").cast("long")).distinct()
    mine = mine.join(acl.select(F.col("end2").alias("src"), F.col("end1").alias("dst")), ["src", "dst"], "left_anti")
    return acl.unionByName(mine.select(F.col("dst").alias("end1"), F.col("src").alias("end2"), F.lit(1).alias("allow")))


def forget(acl: DataFrame, users: DataFrame, rm: DataFrame, gone: DataFrame) -> DataFrame:
    """acl without (dst, src) of removed flows from listed users that were the last of their pair."""
    left = rm.groupBy("src", "dst").agg(F.count("*").alias("n"))
    going = gone.groupBy("src", "dst").agg(F.count("*").alias("g")).join(users.select(F.col("uid").alias("src")).distinct(), "src", "left_semi")
    last = going.join(left, ["src", "dst"]).where("n = g").select(F.col("dst").alias("end1"), F.col("src").alias("end2"))
    return acl.join(last, ["end1", "end2"], "left_anti").select(*acl.columns)


# bandwidth


def rate_violation(rm: DataFrame, rates: DataFrame) -> DataFrame:
    """(fid, req, asgn): flows that have less than their rate."""
    return rm.join(rates, "fid").where("rate > vol").select("fid", F.col("rate").alias("req"), F.col("vol").alias("asgn"))


def rate_repair(rm: DataFrame, rates: DataFrame) -> DataFrame:
    """rm with the rate given to each violating flow."""
    v = rate_violation(rm, rates).groupBy("fid").agg(F.max("req").alias("__r"))
    return rm.join(v, "fid", "left").select(*(F.coalesce("__r", "vol").cast(dict(rm.dtypes)["vol"]).alias("vol") if c == "vol" else F.col(c) for c in rm.columns))


# service chains


def chain_pairs(chains: DataFrame, groups: DataFrame) -> DataFrame:
    """(sid1, sid2, mb): the members' pairs that each group policy concerns."""
    g = groups.select("gid", F.explode("sid_array").alias("sid"))
    a, b = g.select(F.col("gid").alias("gid1"), F.col("sid").alias("sid1")), g.select(F.col("gid").alias("gid2"), F.col("sid").alias("sid2"))
    return chains.join(a, "gid1").join(b, "gid2").select("sid1", "sid2", "mb")


def chain_violation(rm: DataFrame, chains: DataFrame, groups: DataFrame) -> DataFrame:
    """(fid, mb): flows that a chain sends through a middlebox they don't pass. Flows meet their groups first, so pairs are never listed."""
    m = groups.select("gid", F.explode("sid_array").alias("sid"))
    f = rm.where("fw = 0 or lb = 0").select("fid", "src", "dst", "fw", "lb")
    f = f.join(m.select(F.col("gid").alias("gid1"), F.col("sid").alias("src")), "src").join(m.select(F.col("gid").alias("gid2"), F.col("sid").alias("dst")), "dst")
    return f.join(chains, ["gid1", "gid2"]).where("(mb = 'FW' and fw = 0) or (mb = 'LB' and lb = 0)").select("fid", "mb")


def chain_repair(rm: DataFrame, chains: DataFrame, groups: DataFrame) -> DataFrame:
    v = chain_violation(rm, chains, groups).groupBy("fid").agg(F.max(F.when(F.col("mb") == "FW", 1)).alias("__fw"), F.max(F.when(F.col("mb") == "LB", 1)).alias("__lb"))
    return rm.join(v, "fid", "left").select(*(F.coalesce(f"__{c}", c).cast(dict(rm.dtypes)[c]).alias(c) if c in ("fw", "lb") else F.col(c) for c in rm.columns))


# one switch


def switch_violation(cf: DataFrame, sid: int = 1) -> DataFrame:
    return cf.where(F.col("sid") == sid)


def switch_repair(cf: DataFrame, sid: int = 1) -> DataFrame:
    """Forwarding rows without the flows that pass the switch."""
    return cf.join(switch_violation(cf, sid).select("fid").distinct(), "fid", "left_anti")


# routing repair with states


def routing_violations(log: DataFrame) -> DataFrame:
    """(fid, src, dst, status): what a log of changes leaves to repair.

    log: (seq, kind, fid, src, dst, old_src, old_dst), kind ri | rd | ru for a request inserted, deleted, updated and cd for a
    forwarding row deleted. Status 1: path missing, 2: path to go, 3: path broken, -1: cancelled out. Each flow's events
    are folded in order as they stream by, sorted; none are held. Events without a flow are left out.
    """

    kinds = ["seq", "kind", "fid", "src", "dst", "old_src", "old_dst"]
    out = T.StructType([T.StructField(c, T.LongType()) for c in ("fid", "src", "dst")] + [T.StructField("status", T.IntegerType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flow, v = None, {}  # the flow that is being folded, status to ends
        for b in chain(batches, [None]):
            done: list[tuple] = []
            for kind, fid, *ends in zip(*(b.column(c).to_pylist() for c in kinds[1:])) if b is not None else [(None, None)]:
                if fid != flow:
                    done += [(flow, *v[k], k) for k in sorted(v)]
                    flow, v = fid, {}
                if kind is not None:
                    _step(v, kind, tuple(ends[:2]), tuple(ends[2:]))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.int64(), pa.int64(), pa.int64(), pa.int32()))], names=out.names)

    rows = log.where("fid is not null").select("seq", "kind", *(F.col(c).cast("long") for c in kinds[2:]))
    return rows.repartition(parts(log.sparkSession), "fid").sortWithinPartitions("fid", "seq").mapInArrow(fold, out)


def _step(v: dict[int, tuple], kind: str, ends: tuple, old: tuple) -> None:
    """One event into what a flow has to be repaired: status to ends."""

    def cancel(st: int) -> None:
        v[-1] = v.pop(st)

    if kind == "ru":
        if ends == old:
            return
        if 1 not in v:
            v[2] = old
        v[1] = ends
    elif kind == "ri":
        if v.get(2) == ends:
            cancel(2)
        else:
            v[1] = ends
    elif kind == "rd":
        if 1 in v:
            cancel(1)
        else:
            v[2] = ends
    elif kind == "cd" and 2 not in v and 3 not in v:
        v[3] = (None, None)


def by_status(violations: DataFrame) -> DataFrame:
    """Violations in the order in which they are repaired: the highest status first."""
    return violations.orderBy(F.desc("status"), "fid")


def routing_repair(tp: DataFrame, rm: DataFrame, cf: DataFrame, violations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rm, cf) after the repairs: broken flows leave rm, paths to go leave cf, missing paths come (unreachable flows leave rm), cancelled ones are discarded."""
    v = materialize(violations, "violations")
    rm = rm.join(v.where("status = 3").select("fid"), "fid", "left_anti")
    cf = cf.join(v.where("status = 2").select("fid"), "fid", "left_anti").select("fid", "pid", "sid", "nid")
    paths = materialize(shortest_paths(tp, v.where("status = 1").select("fid", "src", "dst")), "paths")
    rm = rm.join(paths.where(F.size("pv") == 0).select("fid"), "fid", "left_anti")
    return rm, cf.unionByName(path_entries(paths.select("fid", "src", "dst", F.col("pv"))))


# applications and runs


def _same(s: State) -> State:
    return s


@dataclass(frozen=True)
class App:
    """A name, what violates it, the state after repair, and what loading and unloading do to a state."""

    name: str
    violations: list[Callable[[State], DataFrame]]
    repair: Callable[[State], State]
    on_load: Callable[[State], State] = _same
    on_unload: Callable[[State], State] = _same


def together(name: str, *apps: App) -> App:
    """One application with the violations of several, repaired in this order."""

    def repair(s: State) -> State:
        for a in apps:
            s = a.repair(s)
        return s

    return App(name, [v for a in apps for v in a.violations], repair)


def _repair_states(s: State) -> State:
    rm, cf = routing_repair(s.tp, s.rm, s.cf, routing_violations(s.events))
    return replace(load_states(s), rm=rm, cf=cf)


FIREWALL = App("fw", [lambda s: fw_violation(s.rm, s.acl)], lambda s: delete_flows(s, materialize(fw_violation(s.rm, s.acl), "violations")))
BANDWIDTH = App("rate", [lambda s: rate_violation(s.rm, s.rates)], lambda s: replace(s, rm=rate_repair(s.rm, s.rates)))
CHAIN = App("chain", [lambda s: chain_violation(s.rm, s.chains, s.groups)], lambda s: replace(s, rm=chain_repair(s.rm, s.chains, s.groups)))
SWITCH = App("switch", [lambda s: switch_violation(s.cf)], lambda s: replace(s, cf=switch_repair(s.cf)))
ROUTING = App("rt", [lambda s: s.delta], apply_changes)
STATES = App("states", [lambda s: by_status(routing_violations(s.events))], _repair_states, load_states, unload_states)
#: Shows all policies as its violations and repairs nothing.
POLICIES = App("policies", [lambda s: s.policies], _same)


@dataclass
class Orchestrator:
    """Loaded applications by priority; one run passes each once, the highest first, and ticks the clock."""

    known: dict[str, App] = field(default_factory=lambda: {a.name: a for a in (FIREWALL, BANDWIDTH, CHAIN, SWITCH, ROUTING, STATES, POLICIES)})
    loaded: list[str] = field(default_factory=list)
    auto: bool = False

    def discover(self, *places) -> list[str]:
        """The names of the applications found in modules or other objects, which are known from then on."""
        found = [a for p in places for a in vars(p).values() if isinstance(a, App)]
        self.known |= {a.name: a for a in found}
        return sorted(a.name for a in found)

    def load(self, *names: str) -> None:
        """From the lowest to the highest priority."""
        for n in names:
            if n not in self.known:
                raise ValueError(f"unknown application {n!r}")
        self.loaded = list(names)

    def loading(self, s: State, *names: str) -> State:
        """Load, and the state that loading makes of s."""
        self.load(*names)
        for n in names:
            s = self.known[n].on_load(s)
        return s

    def unload(self, *names: str) -> None:
        self.loaded = [n for n in self.loaded if n not in names]

    def unloading(self, s: State, *names: str) -> State:
        for n in names:
            s = self.known[n].on_unload(s) if n in self.loaded else s
        self.unload(*names)
        return s

    def violations(self, s: State) -> dict[str, list[DataFrame]]:
        """What violates each loaded application, the highest first."""
        return {n: [v(s) for v in self.known[n].violations] for n in self.order()}

    def reset(self) -> None:
        self.loaded = []

    def order(self) -> list[str]:
        return self.loaded[::-1]

    def run(self, s: State) -> State:
        for n in self.order():
            s = self.known[n].repair(s).written(since=s)
        return replace(s, clock=s.clock + 1)

    def after(self, s: State) -> State:
        """What follows each command: a run, if automatic runs are on."""
        return self.run(s) if self.auto else s


# administration


def add_flow(s: State, src: int, dst: int, fw: int = 1) -> State:
    """A new flow with the next id; its volume and lb are unknown."""
    fid = (s.rm.agg(F.max("fid")).first()[0] or 0) + 1
    return insert_flows(s, s.rm.sparkSession.createDataFrame([(fid, src, dst, None, fw, None)], "fid bigint, src bigint, dst bigint, vol int, fw int, lb int"))


def del_flow(s: State, fid: int | None = None, src: int | None = None, dst: int | None = None) -> State:
    """Remove a flow by id, or all flows of a pair."""
    return delete_flows(s, s.rm.where(F.col("fid") == fid) if fid is not None else s.rm.where((F.col("src") == src) & (F.col("dst") == dst)))


def allow_user(s: State, uid: int) -> State:
    return replace(s, users=s.users.unionByName(s.users.sparkSession.createDataFrame([(uid,)], "uid bigint")))


def forbid_user(s: State, uid: int) -> State:
    return replace(s, users=s.users.where(F.col("uid") != uid))


def allow_pair(s: State, end1: int, end2: int) -> State:
    return replace(s, acl=s.acl.unionByName(s.acl.sparkSession.createDataFrame([(end1, end2, 1)], "end1 bigint, end2 bigint, allow int")))


def forbid_pair(s: State, end1: int, end2: int) -> State:
    return replace(s, acl=s.acl.where((F.col("end1") != end1) | (F.col("end2") != end2)))


# flow messages

# fixed values of the protocol: add, strict delete, flood port, type of IP and of ARP
ADD, DELETE_STRICT, FLOOD, IP, ARP = 0, 4, 65531, 0x0800, 0x0806


def flow_details(cf: DataFrame, ports: DataFrame, rm: DataFrame, switches: DataFrame, hosts: DataFrame) -> DataFrame:
    """Forwarding rows with ports and addresses; what isn't known is null. For deletions, give the deleted flows as rm."""
    p = ports.select("sid", F.col("nid").alias("__n"), "port")
    host = lambda c: hosts.select(F.col("hid").alias(c), F.col("ip").alias(f"{c}_ip"), F.col("mac").alias(f"{c}_mac"))
    out = cf.select("fid", "pid", "sid", "nid")
    out = out.join(p.select("sid", F.col("__n").alias("nid"), F.col("port").alias("outport")), ["sid", "nid"], "left")
    out = out.join(p.select("sid", F.col("__n").alias("pid"), F.col("port").alias("revport")), ["sid", "pid"], "left")
    out = out.join(rm.select("fid", "src", "dst"), "fid", "left").join(switches.select("sid", F.col("name").alias("switch"), "dpid"), "sid", "left")
    return out.join(host("src"), "src", "left").join(host("dst"), "dst", "left").select("fid", "pid", "sid", "nid", "switch", "dpid", "src_ip", "src_mac", "dst_ip", "dst_mac", "outport", "revport")


def flow_messages(details: DataFrame, command: int = ADD) -> DataFrame:
    """Five messages a forwarding row: IP forward and back, ARP of both ends (flooded), and a barrier."""
    no_s, no_i = F.lit(None).cast("string"), F.lit(None).cast("int")

    def msg(n: int, kind: str, priority, nw_src, nw_dst, dl_src, dl_type, out):
        return F.struct(
            F.lit(n).alias("n"), F.lit(kind).alias("kind"), (F.lit(command) if kind == "flow" else no_i).alias("command"), priority.alias("priority"), nw_src.alias("nw_src"), nw_dst.alias("nw_dst"),
            dl_src.alias("dl_src"), dl_type.alias("dl_type"), out.cast("int").alias("out"),
        )

    c = F.col
    msgs = F.array(
        msg(1, "flow", F.lit(10), c("src_ip"), c("dst_ip"), no_s, F.lit(IP), c("outport")), msg(2, "flow", F.lit(10), c("dst_ip"), c("src_ip"), no_s, F.lit(IP), c("revport")),
        msg(3, "flow", F.lit(1), no_s, no_s, c("src_mac"), F.lit(ARP), F.lit(FLOOD)), msg(4, "flow", F.lit(1), no_s, no_s, c("dst_mac"), F.lit(ARP), F.lit(FLOOD)),
        msg(5, "barrier", no_i, no_s, no_s, no_s, no_i, no_i),
    )
    return details.select("fid", "sid", "switch", "dpid", F.explode(msgs).alias("m")).select("fid", "sid", "switch", "dpid", "m.*")


def command_text(messages: DataFrame) -> DataFrame:
    """Flow messages as switch commands: (fid, sid, n, text)."""
    m = messages.where("kind = 'flow'")
    given = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), F.col(c).cast("string")))
    action = F.when(F.col("command") == ADD, F.concat(F.lit("action=output:"), F.when(F.col("out") == FLOOD, "flood").otherwise(F.col("out").cast("string"))))
    params = F.concat_ws(",", given("nw_src"), given("nw_dst"), given("dl_src"), given("dl_type"), given("priority"), action)
    verb = F.when(F.col("command") == ADD, "add-flow").otherwise("--strict del-flows")
    return m.select("fid", "sid", "n", F.concat_ws(" ", F.lit("ovs-ofctl"), verb, "switch", params).alias("text"))


def topology_messages(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """What happened to a table's rows: (op add | del | change, key, and the new row's other columns)."""
    rest = [c for c in after.columns if c not in key]
    b = before.select(*(F.col(c).alias(f"__{c}") for c in before.columns))
    j = after.join(b, [F.col(c) == F.col(f"__{c}") for c in key], "full")
    there, was = F.col(key[0]).isNotNull(), F.col(f"__{key[0]}").isNotNull()
    changed = ~F.struct(*rest).eqNullSafe(F.struct(*(F.col(f"__{c}").alias(c) for c in rest))) if rest else F.lit(False)
    op = F.when(there & ~was, "add").when(~there & was, "del").when(there & changed, "change")
    return j.select(op.alias("op"), *(F.coalesce(c, f"__{c}").alias(c) for c in key), *rest).where("op is not null")


def profile_summary(counters: DataFrame) -> DataFrame:
    """(name, n, total) per counter (name, ms), and over all with a null name."""
    return counters.rollup("name").agg(F.count("*").alias("n"), F.sum("ms").alias("total"))


def ms_us(micros: Column) -> Column:
    """A time in microseconds as milliseconds of its second, a dot, and microseconds of its second."""
    return F.concat(F.lpad((F.floor(micros / 1000) % 1000).cast("string"), 3, "0"), F.lit("."), F.lpad((micros % 1_000_000).cast("string"), 6, "0"))


def latest(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
