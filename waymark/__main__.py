"""python -m waymark build DUMP INDEX [--languages de,en] [--cache DIR] | search INDEX QUERY [--limit N] [--at LAT,LON] [--language TAG] | evaluate INDEX QUERIES [--ranks OUT] [--failures N]"""

from __future__ import annotations

import argparse


def grouped(n: int) -> str:
    """Digits in groups of three."""
    return f"{n:,}".replace(",", " ")


def main(argv: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    from waymark.operators import evaluate
    from waymark.operators.index import GeoIndex, build_dump

    parser = argparse.ArgumentParser(prog="waymark", description=__doc__)
    sub = parser.add_subparsers(dest="what", required=True)
    build = sub.add_parser("build")
    build.add_argument("dump")
    build.add_argument("index")
    build.add_argument("--languages", default="de")
    build.add_argument("--cache")
    find = sub.add_parser("search")
    find.add_argument("index")
    find.add_argument("query")
    find.add_argument("--limit", type=int, default=10, choices=range(1, 65), metavar="1..64")
    find.add_argument("--at")
    find.add_argument("--language")
    test = sub.add_parser("evaluate")
    test.add_argument("index")
    test.add_argument("queries")
    test.add_argument("--ranks")
    test.add_argument("--failures", type=int, default=50)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("waymark").getOrCreate()
    if args.what == "build":
        for name, value in build_dump(spark, args.dump, args.index, args.languages, args.cache).info().items():
            print(f"{name}: {grouped(value) if isinstance(value, int) else ', '.join(value)}")
    elif args.what == "search":
        at = tuple(map(float, args.at.split(","))) if args.at else None
        # A query that ends in a blank, comma or semicolon is finished; its last word isn't read as a beginning.
        unfinished = not args.query.endswith((" ", ",", ";"))
        print(GeoIndex.open(spark, args.index).search_json(args.query, prefix_last=unfinished, limit=args.limit, position=at, language=args.language))
    else:
        ranked, report, missed = evaluate.evaluate(GeoIndex.open(spark, args.index), evaluate.read_queries(spark, args.queries))
        report.orderBy("level", "label").show(1000, truncate=False)
        for r in missed.orderBy("category", "query").limit(args.failures).toLocalIterator():
            print(f"{'absent' if r.absent else 'missed'}: {r.category}\t{r.query}\n    expected {r.expected}", *r.answers, sep="\n      ")
        if args.ranks:
            ranked.select("category", "query", "rank", "absent").write.csv(args.ranks, sep="\t", header=True)


if __name__ == "__main__":
    main()
