"""python -m facetline build DIR INDEX | query INDEX IMAGE [-k N] | status INDEX | generate DIR OUT [-n N] [--seed S]"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .api import Engine
from .sources import generator, images


def main() -> None:
    p = argparse.ArgumentParser(prog="facetline")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build")
    b.add_argument("folder")
    b.add_argument("index")
    q = sub.add_parser("query")
    q.add_argument("index")
    q.add_argument("image")
    q.add_argument("-k", type=int, default=5)
    q.add_argument("--weights")
    s = sub.add_parser("status")
    s.add_argument("index")
    g = sub.add_parser("generate")
    g.add_argument("folder")
    g.add_argument("out")
    g.add_argument("-n", type=int, default=120)
    g.add_argument("--seed", type=int, default=1)
    a = p.parse_args()
    spark = SparkSession.builder.appName("facetline").getOrCreate()
    if a.command == "build":
        print(Engine(spark, a.index).build(a.folder))
    elif a.command == "query":
        for i, hit in enumerate(Engine(spark, a.index, a.weights).search_path(a.image, a.k), 1):
            print(i, f"{hit['score']:.4f}", hit["imageId"], sep="\t")
    elif a.command == "status":
        print(json.dumps(Engine(spark, a.index).status()))
    else:
        library = images.contents(spark, images.files(spark, a.folder), a.folder)
        made = generator.generated(spark, library, a.n, a.seed)
        made.write.mode("overwrite").parquet(f"{a.out}/queries")
        generator.write_manifest(spark.read.parquet(f"{a.out}/queries"), f"{a.out}/manifest")


if __name__ == "__main__":
    main()
