"""python -m lodestone.cli list | run NAME DIR | search DIR QUESTION [--k N] | obs alerts DIR AS_OF | obs cleanup DIR AS_OF | eval retrieval DIR"""

from __future__ import annotations

import argparse

from .operators import ops, retrieval
from .plans.registry import QUERIES, Tables
from .session import session, ship


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list")
    run = sub.add_parser("run")
    run.add_argument("name", choices=sorted(QUERIES))
    run.add_argument("dir")
    search = sub.add_parser("search")
    search.add_argument("dir")
    search.add_argument("question")
    search.add_argument("--k", type=int, default=8)
    obs = sub.add_parser("obs")
    obs.add_argument("what", choices=["alerts", "cleanup"])
    obs.add_argument("dir")
    obs.add_argument("as_of")
    ev = sub.add_parser("eval")
    ev.add_argument("what", choices=["retrieval"])
    ev.add_argument("dir")
    a = p.parse_args(argv)
    if a.command == "list":
        print("\n".join(sorted(QUERIES)))
        return
    spark = ship(session())
    if a.command == "run":
        QUERIES[a.name][0](spark, a.dir).show(50, False)
    elif a.command == "search":
        retrieval.websearch_topn(Tables(spark, a.dir).chunks(), a.question, a.k).orderBy("rank").show(a.k, False)
    elif a.command == "obs":
        t = Tables(spark, a.dir)
        (ops.alerts(t.log(), t.auth(), a.as_of) if a.what == "alerts" else ops.retention_counts(t.log(), t.auth(), a.as_of)).show(50, False)
    else:
        QUERIES["retrieval_hit_mrr"][0](spark, a.dir).show(50, False)


if __name__ == "__main__":
    main()
