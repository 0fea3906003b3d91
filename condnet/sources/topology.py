"""Topologies: generators, numbering, link and port tables, addresses."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from condnet.sources.text import read_isp


@dataclass
class Topology:
    """Named switches and hosts, links between them in the order made, and optional fixed ports."""

    switches: list[str] = field(default_factory=list)
    hosts: list[str] = field(default_factory=list)
    links: list[tuple[str, str, int | None, int | None]] = field(default_factory=list)

    def link(self, a: str, b: str, port_a: int | None = None, port_b: int | None = None) -> None:
        self.links.append((a, b, port_a, port_b))


def empty() -> Topology:
    return Topology()


def single(k: int = 2) -> Topology:
    t = Topology(["s1"], [f"h{i}" for i in range(1, k + 1)])
    for h in t.hosts:
        t.link(h, "s1")
    return t


def reversed_single(k: int = 2) -> Topology:
    """As single, but the first host on the last port."""
    t = Topology(["s1"], [f"h{i}" for i in range(1, k + 1)])
    for i, h in enumerate(t.hosts):
        t.link(h, "s1", 0, k - i)
    return t


def minimal() -> Topology:
    return single(2)


def linear(k: int = 2, n: int = 1) -> Topology:
    """k switches in a chain, n hosts on each."""
    t = Topology()
    for i in range(1, k + 1):
        t.switches.append(f"s{i}")
        for j in range(1, n + 1):
            t.hosts.append(f"h{i}" if n == 1 else f"h{j}s{i}")
            t.link(t.hosts[-1], f"s{i}")
        if i > 1:
            t.link(f"s{i}", f"s{i - 1}")
    return t


def tree(depth: int = 1, fanout: int = 2) -> Topology:
    """A complete tree, numbered depth first."""
    t = Topology()

    def grow(d: int) -> str:
        if d == 0:
            t.hosts.append(f"h{len(t.hosts) + 1}")
            return t.hosts[-1]
        t.switches.append(me := f"s{len(t.switches) + 1}")
        for _ in range(fanout):
            t.link(me, grow(d - 1))
        return me

    grow(depth)
    return t


def fattree(k: int = 4) -> Topology:
    """k pods over (k/2)^2 core switches; numbers run over cores, aggregation, edge switches and hosts."""
    if k <= 0 or k % 2:
        raise ValueError("the number of pods must be a positive even number")
    h = k // 2
    core, agg = h * h, h * k
    edge0, host0 = core + agg, core + 2 * agg
    t = Topology([f"s{i}" for i in range(host0)], [f"h{host0 + i}" for i in range(h * h * k)])
    for pod in range(k):
        aggs = [f"s{core + pod * h + i}" for i in range(h)]
        edges = [f"s{edge0 + pod * h + i}" for i in range(h)]
        for i, a in enumerate(aggs):
            for c in range(i * h, i * h + h):
                t.link(a, f"s{c}")
            for e in edges:
                t.link(a, e)
        for i, e in enumerate(edges):
            for j in range(h):
                t.link(e, f"h{host0 + (pod * h + i) * h + j}")
    return t


def diamond() -> Topology:
    t = Topology(["s1", "s2", "s3", "s4"], ["h1", "h2"])
    # fixed values: the links of the diamond
    for a, b in (("h1", "s1"), ("h2", "s4"), ("s1", "s2"), ("s1", "s3"), ("s2", "s4"), ("s3", "s4")):
        t.link(a, b)
    return t


_MADE = {"empty": empty, "single": single, "reversed": reversed_single, "minimal": minimal, "linear": linear, "tree": tree, "fattree": fattree, "diamond": diamond}


def isp(spark: SparkSession, folder: str, number: int | str) -> Topology:
    """The switches s<node> and links of an ISP topology's files, collected as every generated topology is made by the driver (thousands of nodes)."""
    nodes, links = read_isp(spark, folder, number)
    t = Topology([f"s{r.node}" for r in nodes.collect()])
    known = set(t.switches)
    for a, b in sorted((f"s{r.a}", f"s{r.b}") for r in links.collect()):
        if not {a, b} <= known:
            raise ValueError(f"a link ends at an unknown node: {a} {b}")
        t.link(a, b)
    return t


def topology(spec: str, spark: SparkSession | None = None, folder: str | None = None) -> Topology:
    """From text such as 'linear,4' or 'tree,depth=2,fanout=3'; 'isp,<number>' reads the files of a folder."""
    name, *args = [x.strip() for x in spec.split(",") if x.strip()]
    if name == "isp":
        if spark is None or folder is None or len(args) != 1:
            raise ValueError("isp takes a number, and needs the folder of its files")
        return isp(spark, folder, args[0])
    if name not in _MADE:
        raise ValueError(f"unknown topology {name!r}")
    plain = [int(a) for a in args if "=" not in a]
    named = {k.strip(): int(v) for k, v in (a.split("=", 1) for a in args if "=" in a)}
    return _MADE[name](*plain, **named)


def _order(names: list[str]) -> list[str]:
    return sorted(names)


def tables(spark: SparkSession, t: Topology) -> dict[str, DataFrame]:
    """switches, hosts, tp and ports. Switches are numbered first, then hosts, each sorted by name; links and ports stand in both directions.

    A link without fixed ports takes each node's next one; a switch counts from 1, a host from 0.
    """
    names = [*_order(t.switches), *_order(t.hosts)]
    number = {n: i for i, n in enumerate(names, 1)}
    used: dict[str, int] = {}
    tp, ports = [], []
    for a, b, pa, pb in t.links:
        got = []
        for n, p in ((a, pa), (b, pb)):
            base = 1 if n in t.switches else 0
            got.append(p if p is not None else used.get(n, 0) + base)
            used[n] = used.get(n, 0) + 1
        host = int(a in t.hosts or b in t.hosts)
        for x, y, p in ((a, b, got[0]), (b, a, got[1])):
            tp.append((number[x], number[y], host, 1, None))
            ports.append((number[x], number[y], p))
    sw = spark.createDataFrame([(number[n], n) for n in _order(t.switches)], "sid int, name string")
    ho = spark.createDataFrame([(number[n], n) for n in _order(t.hosts)], "hid int, name string")
    at = F.col("hid") - F.lit(len(t.switches))
    return {
        "switches": sw.select("sid", default_dpid("name").alias("dpid"), F.lit("127.0.0.1").alias("ip"), mac(F.col("sid")).alias("mac"), "name"),
        "hosts": ho.select("hid", host_ip(at).alias("ip"), mac(at).alias("mac"), "name"),
        "tp": spark.createDataFrame(tp, "sid int, nid int, ishost int, isactive int, bw int"),
        "ports": spark.createDataFrame(ports, "sid int, nid int, port int"),
    }


def default_dpid(name: Column | str) -> Column:
    """The digits of a name in hex, twelve digits wide."""
    c = F.col(name) if isinstance(name, str) else name
    return F.lpad(F.lower(F.hex(F.regexp_extract(c, r"\d+", 0).cast("bigint"))), 12, "0")


def host_ip(i: Column) -> Column:
    """The i-th address of 10.0.0.0/8."""
    part = lambda k: F.pmod(F.floor(i / (256**k)), F.lit(256)).cast("string")
    return F.concat_ws(".", F.lit("10"), part(2), part(1), part(0))


def mac(i: Column) -> Column:
    """The number as six hex bytes."""
    h = F.lpad(F.lower(F.hex(i.cast("bigint"))), 12, "0")
    return F.concat_ws(":", *(F.substring(h, k, 2) for k in range(1, 12, 2)))


def both_ways(links: DataFrame, a: str = "sid", b: str = "nid") -> DataFrame:
    """Each link and its reverse, each once."""
    back = links.select(*(F.col(b).alias(a) if c == a else F.col(a).alias(b) if c == b else F.col(c) for c in links.columns))
    return links.unionByName(back).distinct()


def next_ports(links: DataFrame, is_switch: Column, order: str) -> DataFrame:
    """(sid, nid, port): ports of directed links (sid, nid) numbered per node in the given order; from 1 where is_switch, else from 0."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("sid").orderBy(order, "nid"))
    return links.select("sid", "nid", (n - F.when(is_switch, 0).otherwise(1)).cast("int").alias("port"))


