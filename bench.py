"""Times the headline queries over `BENCH_SF_DIR` (default sf0.1) on `local[BENCH_CPUS]` and prints one JSON line.

With --npy FILE or --synthetic ROWS DIM it times searches over that corpus instead: an index is built once, and exact,
full, staged and re-ranked searches run over it; --breakdown gives the share of each stage, --recall the recall curve.
A run is `--warmup` runs that don't count and `--timing-runs` that do; the median of an even number is the upper one.
"""

from __future__ import annotations

import argparse
import json
import os
import statistics
import tempfile
import time

HEADLINE = ["exact_topk", "landmark_search", "flat_search", "staged_search", "float_rescore", "recall_curve", "build_index", "calibration_fit"]


def flags() -> argparse.Namespace:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--sf-dir", default=os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"))
    p.add_argument("--cpus", default=os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8)))
    p.add_argument("--queries", nargs="*", default=HEADLINE, help="registered queries to time")
    p.add_argument("--timing-runs", type=int, default=int(os.environ.get("BENCH_RUNS", "5")))
    p.add_argument("--warmup", type=int, default=int(os.environ.get("BENCH_WARMUP", "1")))
    p.add_argument("--npy", help="an NPY file as corpus")
    p.add_argument("--synthetic", nargs=2, type=int, metavar=("ROWS", "DIM"), help="a seeded random corpus of this size")
    p.add_argument("--limit", type=int, default=0, help="rows of the corpus, 0: all")
    p.add_argument("--query-limit", type=int, default=1000)
    p.add_argument("--bits", type=int, default=4)
    p.add_argument("--rerank-bits", type=int, default=0)
    p.add_argument("--landmarks", type=int, default=1024)
    p.add_argument("--k", type=int, default=10)
    p.add_argument("--shortlist", type=int, default=0, help="0: by k and bits")
    p.add_argument("--recall", action="store_true")
    p.add_argument("--float-rescore", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--breakdown", action="store_true")
    p.add_argument("--report", help="also write the result as key=value lines to this file")
    return p.parse_args()


def timed(make, o: argparse.Namespace) -> list[float]:
    took = []
    for k in range(o.warmup + o.timing_runs):
        began = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        if k >= o.warmup:
            took.append(time.perf_counter() - began)
    return took


def figures(took: list[float]) -> dict[str, float]:
    return {"mean": round(statistics.mean(took), 4), "median": round(sorted(took)[len(took) // 2], 4), "std": round(statistics.stdev(took), 4) if len(took) > 1 else None}


def session(o: argparse.Namespace):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{o.cpus}]")
        .config("spark.sql.shuffle.partitions", o.cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def registered(spark, o: argparse.Namespace) -> dict:
    from quiverlake.plans import registry

    runs = {name: timed(lambda f=registry.queries()[name]: f(spark, o.sf_dir), o) for name in o.queries}
    seconds = {k: round(statistics.mean(v), 4) for k, v in runs.items()}
    per_vector = {k: round(seconds[k] * 1000 / registry.NQ, 3) for k in ("exact_topk", "landmark_search", "staged_search") if k in seconds}
    return {"metric": "headline queries, mean seconds after a warm-up", "value": round(sum(seconds.values()), 4), "unit": "sec", "queries": seconds, "sf": o.sf_dir, "runs": o.timing_runs, "median": {k: figures(v)["median"] for k, v in runs.items()}, "ms_per_query_vector": per_vector}


def corpus_run(spark, o: argparse.Namespace) -> dict:
    from quiverlake.operators import metrics
    from quiverlake.operators import model as M
    from quiverlake.operators import search as S
    from quiverlake.sources import datasets, npy

    folder = tempfile.mkdtemp(prefix="bench-")
    if o.synthetic:
        import numpy as np
        import pyarrow as pa

        rows, dim = o.synthetic

        def make(batches):
            for b in batches:
                for i in b.column(0).to_pylist():
                    x = np.random.default_rng([1, i]).standard_normal((1000, dim)).astype("f4")[: rows - 1000 * i]
                    yield pa.RecordBatch.from_arrays([pa.array(range(1000 * i, 1000 * i + len(x)), pa.int64()), pa.array(list(x), pa.list_(pa.float32()))], ["id", "vec"])

        spark.range(0, -(-rows // 1000), 1, int(o.cpus)).mapInArrow(make, "id bigint, vec array<float>").write.parquet(f"{folder}/corpus")
        vectors = spark.read.parquet(f"{folder}/corpus")
    else:
        vectors = npy.read_npy(spark, o.npy)
    corpus, asked = datasets.holdout(vectors, o.query_limit, o.limit)
    dim = datasets.meta(corpus).first()["dim_max"]
    model = M.Model(dim, o.bits, min(o.landmarks, dim), rerank_bits=o.rerank_bits)
    began = time.perf_counter()
    M.save(M.build(corpus, model), model, f"{folder}/index")
    built = time.perf_counter() - began
    index = M.load(spark, f"{folder}/index")[0]
    short = o.shortlist or S.shortlist_size(o.k, o.bits)
    makes = {
        "exact": lambda: S.exact_topk(corpus, asked, dim, o.k),
        "scan": lambda: S.landmark_search(index, asked, model, o.k),
        "signs": lambda: S.sign_search(index, asked, model, short),
        "staged": lambda: S.staged_search(index, asked, model, o.k, short, staged=True),
    }
    if o.float_rescore:
        makes["staged and exact"] = lambda: S.float_rescore(S.staged_search(index, asked, model, o.k, short, staged=True), corpus, asked, dim, o.k)
    n = asked.count()
    runs = {k: figures(timed(f, o)) for k, f in makes.items()}
    out = {"metric": "searches over a corpus", "value": runs["staged"]["median"], "unit": "sec", "queries": {k: v["median"] for k, v in runs.items()}, "runs": runs, "build": round(built, 3), "rows": corpus.count(), "dim": dim, "n_queries": n, "ms_per_query_vector": {k: round(v["median"] * 1000 / n, 4) for k, v in runs.items()}}
    if o.breakdown:
        total = runs["staged and exact" if o.float_rescore else "staged"]["median"]
        parts = {"sign stage": runs["signs"]["median"], "landmark scores": max(0.0, runs["staged"]["median"] - runs["signs"]["median"]), "exact scores": max(0.0, total - runs["staged"]["median"])}
        out["breakdown"] = {k: {"ms_per_query_vector": round(1000 * v / n, 4), "percent": round(100 * v / total, 1)} for k, v in parts.items()}
    if o.recall:
        last = makes.get("staged and exact", makes["staged"])()
        out["recall"] = {r["t"]: round(r["recall"], 4) for r in metrics.recall_curve(last, makes["exact"](), o.k).collect()}
    return out


def main() -> None:
    o = flags()
    spark = session(o)
    result = corpus_run(spark, o) if o.npy or o.synthetic else registered(spark, o)
    print(json.dumps(result))
    if o.report:
        from quiverlake.sources import reports

        with open(o.report, "w", encoding="utf-8") as f:
            f.write("\n".join(reports.lines(result)) + "\n")
    spark.stop()


if __name__ == "__main__":
    main()
