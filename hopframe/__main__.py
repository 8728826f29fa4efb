"""python -m hopframe preprocess | validate | split | evaluate | hopqa: the command line."""

from __future__ import annotations

import argparse
import json

from hopframe import preprocess
from hopframe.session import session


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="hopframe")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("preprocess", help="raw graph and questions to tables")
    c.add_argument("--graph", required=True)
    c.add_argument("--data")
    c.add_argument("--out", required=True)
    c.add_argument("--domain", required=True)
    c.add_argument("--dim", type=int, default=16)
    c.add_argument("--builder", default="graph")
    c.add_argument("--force", action="store_true")
    c = sub.add_parser("validate", help="whether a folder of tables is complete")
    c.add_argument("--out", required=True)
    c = sub.add_parser("split", help="answer-stratified split files of a folder's samples")
    c.add_argument("--out", required=True)
    c.add_argument("--counts", type=int, nargs=3, required=True, metavar=("TRAIN", "VAL", "TEST"))
    c.add_argument("--seed", type=int, default=0)
    c = sub.add_parser("evaluate", help="scores of a prediction file, overall and by task")
    c.add_argument("--predictions", required=True)
    c.add_argument("--report", help="where the report is also written, as .json and .txt")
    c = sub.add_parser("hopqa", help="balanced hop-count pairs of a folder of tables, with their account")
    c.add_argument("--out", required=True)
    c.add_argument("--samples", type=int, required=True)
    c.add_argument("--hops", type=int, nargs=2, default=(1, 4), metavar=("MIN", "MAX"))
    c.add_argument("--max-attempts", type=int, default=20_000)
    c.add_argument("--max-visited", type=int, default=200_000)
    c.add_argument("--seed", type=int, default=0)
    return p


def main(argv: list[str] | None = None) -> None:
    a = _parser().parse_args(argv)
    spark = session()
    if a.command == "preprocess":
        out = preprocess.builder(a.builder)(spark, a.graph, a.data, a.out, a.domain, a.dim, not a.force)
    elif a.command == "validate":
        out = {"complete": preprocess.complete(spark, a.out)}
    elif a.command == "split":
        from hopframe.operators.splits import stratified_split
        from hopframe.sources.files import write_splits

        got = stratified_split(spark.read.parquet(f"{a.out}/samples"), "raw_index", "answer", tuple(a.counts), a.seed)
        write_splits(got.withColumnRenamed("raw_index", "idx"), f"{a.out}/split")
        out = dict(zip(("train", "val", "test"), a.counts, strict=True)) | {"seed": a.seed, "stratify_by": "answer"}
    elif a.command == "hopqa":
        from hopframe.operators.hopqa import balanced
        from hopframe.sources.checkpoint import save
        from hopframe.sources.testgraph import undirected

        tables, _ = preprocess.load(spark, a.out)
        nodes, edges = tables["nodes"], tables["edges"]
        pairs, account = balanced(nodes, edges, undirected(edges), a.samples, *a.hops, a.seed, max_attempts=a.max_attempts, max_visited=a.max_visited)
        out = account | {"samples": a.samples, "folder": save(spark, f"{a.out}/hopqa", "pairs", {"pairs": pairs}, account)["folder"]}
    else:
        from hopframe.operators.evaluate import dump, read_predictions, report

        out = report(read_predictions(spark, a.predictions))
        if a.report:
            dump(spark, out, a.report)
    print(json.dumps(out))


if __name__ == "__main__":
    main()
