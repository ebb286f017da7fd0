"""python -m edgeloom.cli {register,refresh,status,info,khop-count} ... --root DIR"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from edgeloom.engine import GraphEngine


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="edgeloom", description=__doc__)
    p.add_argument("--root", required=True)
    p.add_argument("--echo_only", action="store_true", help="print what would run")
    sub = p.add_subparsers(dest="cmd", required=True)
    reg = sub.add_parser("register")
    for a in ("graph", "edge_table", "src", "dst"):
        reg.add_argument(a)
    for a in ("--op", "--weight", "--ver"):
        reg.add_argument(a)
    reg.add_argument("--margin", type=int)
    reg.add_argument("--undirected", action="store_true")
    for name in ("refresh", "status", "load", "unregister"):
        sub.add_parser(name).add_argument("graph")
    sub.add_parser("info")
    kc = sub.add_parser("khop-count")
    kc.add_argument("graph")
    kc.add_argument("start", type=int)
    kc.add_argument("depth", type=int)
    a = p.parse_args(argv)
    if a.echo_only:
        print({k: v for k, v in vars(a).items() if v is not None})
        return 0
    engine = GraphEngine(SparkSession.builder.appName("edgeloom").getOrCreate(), a.root)
    if a.cmd == "register":
        engine.register_graph(a.graph, a.edge_table, a.src, a.dst, a.op, a.weight, not a.undirected, a.ver, a.margin)
    elif a.cmd == "refresh":
        print(engine.refresh_graph(a.graph))
    elif a.cmd == "unregister":
        engine.unregister_graph(a.graph)
    else:
        {"status": lambda: engine.status(a.graph), "load": lambda: engine.load_all(a.graph), "info": engine.info, "khop-count": lambda: engine.khop_count(a.graph, a.start, a.depth).orderBy("start", "hops")}[a.cmd]().show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
