import numpy as np
import pytest

from quiverlake.operators import calibration, metrics
from quiverlake.operators import model as M
from quiverlake.operators import search as S
from quiverlake.sources import datasets, npy


def frame(spark, x, key="id"):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], f"{key} bigint, vec array<float>")


def data(n, dim, seed):
    return np.random.default_rng(seed).standard_normal((n, dim))


def test_ids_and_order(spark):
    x, m = data(256, 64, 42), M.Model(64, 4, 48)
    got = S.landmark_search(M.build(frame(spark, x), m), frame(spark, x[:4], "qid"), m, 5).orderBy("qid", "rank").collect()
    assert len(got) == 20 and all(0 <= r["id"] < 256 for r in got)
    assert all(a["score"] >= b["score"] for a, b in zip(got, got[1:]) if a["qid"] == b["qid"])


def test_self_query_and_rescore(spark):
    x, m = data(64, 128, 7), M.Model(128, 4, 96)
    q = frame(spark, x[:1], "qid")
    found = S.landmark_search(M.build(frame(spark, x), m), q, m, 16)
    top = found.where("rank = 1").first()
    assert top["id"] == 0 and top["score"] > 0.7
    exact = S.float_rescore(found, frame(spark, x), q, 128, 16).orderBy("rank").collect()
    assert exact[0]["id"] == 0 and abs(exact[0]["score"] - 1) < 1e-6


def test_many_queries_as_one_at_a_time(spark):
    x, m = data(512, 64, 123), M.Model(64, 4, 48)
    index, q = M.build(frame(spark, x), m).cache(), frame(spark, data(8, 64, 5), "qid")
    many = {(r["qid"], r["rank"]): (r["id"], r["score"]) for r in S.landmark_search(index, q, m, 8).collect()}
    for i in range(2):
        for r in S.landmark_search(index, q.where(f"qid = {i}"), m, 8).collect():
            assert many[i, r["rank"]][0] == r["id"] and abs(many[i, r["rank"]][1] - r["score"]) < 1e-6


def test_staged_is_full_with_long_shortlist(spark):
    x, m = data(300, 64, 2026), M.Model(64, 4, 64)
    index, q = M.build(frame(spark, x), m).cache(), frame(spark, x[:3], "qid")
    full = S.landmark_search(index, q, m, 10).orderBy("qid", "rank").collect()
    staged = S.staged_search(index, q, m, 10, shortlist=300, staged=True).orderBy("qid", "rank").collect()
    assert [(r["qid"], r["id"]) for r in full] == [(r["qid"], r["id"]) for r in staged]
    assert S.shortlist_size(10, 4) == 256 and S.shortlist_size(64, 4) == 384


def test_auto_cuts_only_on_request(spark):
    """Two stages only from the number of rows that the caller names, for 4 bits."""
    x = data(300, 64, 11)
    for bits in (4, 3):
        m = M.Model(64, bits, 48)
        index, q = M.build(frame(spark, x), m).cache(), frame(spark, data(5, 64, 12), "qid")
        full = pairs_of(S.landmark_search(index, q, m, 10))
        cut = pairs_of(S.staged_search(index, q, m, 10, shortlist=12, staged=True))
        assert cut.keys() != full.keys()
        assert pairs_of(S.staged_search(index, q, m, 10, shortlist=12)) == full
        assert pairs_of(S.staged_search(index, q, m, 10, shortlist=12, staged_min_rows=301)) == full
        assert pairs_of(S.staged_search(index, q, m, 10, shortlist=12, staged_min_rows=300)) == (cut if bits == 4 else full)
        index.unpersist()


def test_partitions_and_query_blocks_do_not_matter(spark, monkeypatch):
    x, m = data(200, 64, 1), M.Model(64, 4, 48)
    q = frame(spark, data(9, 64, 2), "qid")
    one = S.landmark_search(M.build(frame(spark, x).coalesce(1), m), q, m, 5).orderBy("qid", "rank").collect()
    blocks = S.query_blocks
    monkeypatch.setattr(S, "query_blocks", lambda queries, dim: blocks(queries, dim, 8 * dim * 4))  # three blocks
    other = S.landmark_search(M.build(frame(spark, x).repartition(7), m), q, m, 5).orderBy("qid", "rank").collect()
    assert [r[:3] for r in one] == [r[:3] for r in other] and np.allclose([r["score"] for r in one], [r["score"] for r in other])


def test_edges(spark):
    x = np.vstack([np.zeros((1, 64)), np.ones((3, 64)), data(4, 64, 3)])
    m = M.Model(64, 4, 48)
    index = M.build(frame(spark, x), m)
    got = S.landmark_search(index, frame(spark, np.vstack([np.ones((1, 64)), np.zeros((1, 64))]), "qid"), m, 50).orderBy("qid", "rank").collect()
    assert len(got) == 16  # k beyond the rows
    assert [r["id"] for r in got[:3]] == [1, 2, 3]  # ties by id
    assert [(r["id"], r["score"]) for r in got[8:]] == [(i, 0.0) for i in range(8)]  # zero query
    with pytest.raises(Exception, match="components"):
        M.build(spark.createDataFrame([(0, [1.0] * 63), (1, [1.0] * 65)], "id bigint, vec array<float>"), m).collect()
    with pytest.raises(Exception, match="components"):
        M.build(spark.createDataFrame([(0, None)], "id bigint, vec array<float>"), m).collect()
    empty = spark.createDataFrame([], "id bigint, vec array<float>")
    assert S.exact_topk(empty, frame(spark, x[1:2], "qid"), 64, 3).count() == 0
    assert S.exact_topk(frame(spark, x), empty.withColumnRenamed("id", "qid"), 64, 3).count() == 0


def test_save_append_load(spark, tmp_path):
    x, m = data(40, 64, 9), M.Model(64, 4, 48, rerank_bits=2)
    df, path = frame(spark, x), f"file://{tmp_path}/index"
    M.save(M.build(df.where("id < 25"), m), m, path)
    M.save(M.build(df.where("id >= 25"), m), m, path, append=True)
    index, model = M.load(spark, path)
    got, want = index.orderBy("id").collect(), M.build(df, m).orderBy("id").collect()
    assert model == m and [r[:2] for r in got] == [r[:2] for r in want] and np.allclose([r[2:] for r in got], [r[2:] for r in want])
    with pytest.raises(ValueError):
        M.save(M.build(df, m), M.Model(64, 3, 48), path, append=True)


def test_stream_append(spark, tmp_path):
    """A saved index, rows of a stream and a later append are all there when it is loaded."""
    from quiverlake.streaming import append

    x, m = data(40, 64, 4), M.Model(64, 4, 48)
    df, path = frame(spark, x), f"{tmp_path}/index"
    df.where("id >= 10 AND id < 30").write.parquet(f"{tmp_path}/in")
    M.save(M.build(df.where("id < 10"), m), m, path)
    stream = spark.readStream.schema("id bigint, vec array<float>").parquet(f"{tmp_path}/in")
    append.follow(stream, m, path, f"{tmp_path}/state").awaitTermination(120)
    M.save(M.build(df.where("id >= 30"), m), m, path, append=True)
    index, _ = M.load(spark, path)
    got, want = index.orderBy("id").collect(), M.build(df, m).orderBy("id").collect()
    assert index.columns == ["id", "codes", "alpha", "resid"]
    assert [(r["id"], r["codes"]) for r in got] == [(r["id"], r["codes"]) for r in want]
    with pytest.raises(ValueError):
        append.follow(stream, M.Model(64, 3, 48), path, f"{tmp_path}/other")
    M.save(M.build(df.where("id < 3"), m), m, path)  # replaces all of it
    assert M.load(spark, path)[0].count() == 3
    M.save(M.build(df.limit(0), m), m, path)
    assert M.load(spark, path)[0].count() == 0


def plain_scores(x, q):
    return M.normalise(q) @ M.normalise(x).T


def pairs_of(df):
    return {(r["qid"], r["id"]): r["score"] for r in df.collect()}


@pytest.mark.parametrize("share", [1, 40])
def test_masks_offsets_and_thresholds(spark, share):
    """Against plain arithmetic, with masks that name most pairs and few of them."""
    rng = np.random.default_rng(share)
    x, q = data(300, 64, 1), data(7, 64, 2)
    let = rng.random((7, 300)) < 1 / share
    let[3] = False
    mask = spark.createDataFrame([(int(a), int(b)) for a, b in zip(*np.nonzero(let))] + [(99, 1), (1, 999)], "qid bigint, id bigint")
    corpus, asked = frame(spark, x), frame(spark, q, "qid").selectExpr("*", "CASE WHEN qid = 2 THEN NULL ELSE qid * 0.5 END AS offset")
    score = plain_scores(x, q) + np.array([0, 0.5, 0, 1.5, 2, 2.5, 3])[:, None]
    for m, admitted in ((mask, let), (None, np.ones_like(let))):
        want = {}
        for a in range(7):
            best = sorted((-score[a, b], b) for b in np.flatnonzero(admitted[a]))[:5]
            want |= {(a, b): -s for s, b in best}
        got = pairs_of(S.exact_topk(corpus, asked, 64, 5, mask=m))
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
        counts = {r["qid"]: r["n"] for r in S.exact_count(corpus, asked, 64, 0.6, mask=m).collect()}
        n = ((score >= 0.6) & admitted).sum(axis=1)
        assert counts == {a: c for a, c in enumerate(n.tolist()) if c}
        every = pairs_of(S.exact_scores(corpus, asked, 64, mask=m))
        assert every.keys() == {(a, b) for a, b in zip(*(v.tolist() for v in np.nonzero(admitted)))} and all(abs(v - score[k]) < 1e-6 for k, v in every.items())


@pytest.mark.parametrize("bits", [2, 3, 4])
@pytest.mark.parametrize("mode", ["lut", "int8", "q4"])
def test_approximate_modes(spark, bits, mode):
    """Close to the float scores; over a mask of few pairs exactly as over all."""
    x, q, m = data(200, 64, 5), data(4, 64, 6), M.Model(64, bits, 48)
    index, asked = M.build(frame(spark, x), m).cache(), frame(spark, q, "qid")
    exact = pairs_of(S.landmark_search(index, asked, m, 200))
    near = pairs_of(S.landmark_search(index, asked, m, 200, mode))
    assert near.keys() == exact.keys() and max(abs(near[k] - exact[k]) for k in exact) < (0.08 if mode == "q4" else 0.03)
    some = list(near)[::37]
    over = pairs_of(S.landmark_search(index, asked, m, 200, mode, mask=spark.createDataFrame(some, "qid bigint, id bigint")))
    assert over.keys() == set(some) and all(abs(over[k] - near[k]) < 1e-9 for k in some)
    index.unpersist()


def test_equal_rows_encode_and_score_equally(spark):
    """To the last bit, at any place of batches of any size; in a worker, which has one thread for products."""
    x, q, m = data(7, 64, 1), data(50, 64, 2), M.Model(64, 4, 48)

    def unequal(_):
        codes, alpha, resid = m.encode(x)
        bad = 0
        for n in (1, 9, 13, 300, 1001):
            at = np.resize(np.arange(7), n)
            c, a, r = m.encode(x[at])
            bad += not ((c == codes[at]).all() and (a == alpha[at]).all() and (r == resid[at]).all())
            for k in (1, 3, 50):
                s = S.product(q[:k], x[at], None)
                bad += not ((s == S.product(q[:k], x, None)[:, at]).all() and np.allclose(s, q[:k] @ x[at].T))
        return bad

    assert spark.sparkContext.parallelize([0], 1).map(unequal).first() == 0


def test_lookup_tables_of_a_zero_query():
    values, scale, bias = S.lookup_tables(np.zeros((1, 48)), M.Model(64, 4, 48))
    assert not values.any() and scale[0] == 1 and bias[0] == 0


def test_npy_round_trip(spark, tmp_path):
    x = data(50, 16, 1).astype(np.float32)
    npy.write_npy(frame(spark, x).repartition(3), f"{tmp_path}/x.npy")
    assert (np.load(f"{tmp_path}/x.npy") == x).all()
    back = npy.read_npy(spark, f"{tmp_path}/x.npy", 20).orderBy("id").collect()
    assert np.allclose([r["vec"] for r in back], x)
    npy.write_npy(frame(spark, x).repartition(3), f"{tmp_path}/y.npy", part_bytes=16 * 4 * 7)
    assert (np.load(f"{tmp_path}/y.npy") == x).all()
    npy.write_npy(frame(spark, x[:0]), f"{tmp_path}/z.npy")
    assert np.load(f"{tmp_path}/z.npy").shape == (0, 0)
    with pytest.raises(ValueError):
        npy.write_npy(spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "id bigint, vec array<float>"), f"{tmp_path}/r.npy")
    with pytest.raises(ValueError):
        npy.write_npy(frame(spark, x), "hdfs://host/x.npy")
    np.save(f"{tmp_path}/f.npy", np.asfortranarray(x))
    with open(f"{tmp_path}/f.npy", "rb") as f, pytest.raises(ValueError):
        npy.header(f)


def test_metrics_and_tuning(spark):
    exact = spark.createDataFrame([(0, 1, 5), (0, 2, 6), (1, 1, 7), (1, 2, 8)], "qid bigint, rank bigint, id bigint")
    found = spark.createDataFrame([(0, 1, 6), (0, 2, 5), (1, 1, 7), (1, 2, 9)], "qid bigint, rank bigint, id bigint")
    curve = {r["t"]: (r["recall1"], r["recall"]) for r in metrics.recall_curve(found, exact, 2).collect()}
    assert curve == {1: (0.5, 0.5), 2: (1.0, 0.75)}
    assert metrics.cuts(10) == [1, 2, 4, 8, 10]
    assert metrics.tune(lambda m: m / 64, list(range(8, 65, 8)), 0.6)[0] == 40
    assert metrics.tune(lambda m: 0.1, [8, 16, 24], 0.6)[0] is None


def test_holdout_and_calibration(spark):
    df = frame(spark, data(30, 64, 1))
    c, q = datasets.holdout(df, 10, 15)
    assert (c.count(), q.count(), q.selectExpr("min(qid)").first()[0]) == (15, 10, 15)
    c, q = datasets.holdout(df, 40)
    assert c.count() == q.count() == 30
    assert calibration.fit(df, 64).count() == 64
    with pytest.raises(ValueError):
        calibration.fit(df.where("id = 0"), 64)
    with pytest.raises(ValueError):
        datasets.resolve("openai-1536", "d", "test")


def test_calibration_selects_the_order_statistics(spark):
    """As a sort of each coordinate does; with equal rows, few bins and a constant coordinate, too."""
    from quiverlake.functions import constants as C

    x = np.vstack([data(300, 64, 8), np.repeat(data(1, 64, 9), 60, axis=0)])
    y = np.sort(C.rotate(M.normalise(x.astype(np.float32).astype(float))), axis=0)
    outer, p_lo, p_hi = calibration.tails(64, 4)
    lo = int(len(x) * p_lo)
    hi = max(min(int(len(x) * p_hi), len(x) - 1), lo + 1)
    for bins in (1024, 3):
        for r in calibration.fit(frame(spark, x), 64, bins=bins).collect():
            a, b = y[lo, r["d"]], y[hi, r["d"]]
            assert abs(r["scale"] - 2 * outer / (b - a)) < 1e-9 and abs(r["shift"] - (-(b - a) / 2 - a)) < 1e-9
    same = calibration.fit(frame(spark, np.repeat(x[:1], 5, axis=0)), 64).collect()
    assert len(same) == 64 and all((r["shift"], r["scale"]) == (0, 1) for r in same)


def test_front_pick_and_summary(spark):
    df = spark.createDataFrame([(1, 9, "a"), (1, 9, "b"), (2, 9, "c"), (2, 4, "d"), (3, 5, "e"), (4, 1, "f")], "x int, y int, z string")
    assert [tuple(r) for r in metrics.pareto_front(df, "x", "y").orderBy("x").collect()] == [(1, 9, "a"), (2, 4, "d"), (4, 1, "f")]
    assert tuple(metrics.least_product(df, "x", "y").first()) == (4, 1, "f")
    assert metrics.pareto_front(df.limit(0), "x", "y").count() == 0
    runs = spark.createDataFrame([("p", 4.0), ("p", 1.0), ("p", 2.0), ("p", 8.0), ("q", 5.0)], "c string, v double")
    assert [tuple(r) for r in metrics.summary(runs, ["c"], "v").orderBy("c").collect()] == [("p", 4, 3.75, 4.0, 3.0957), ("q", 1, 5.0, 5.0, None)]


def test_cache_misses_changed_data(spark, tmp_path):
    df, made = frame(spark, data(20, 64, 1)), []

    def result(d):
        return datasets.cached(spark, f"file://{tmp_path}/cache", {"k": 1, **datasets.fingerprint(d)}, lambda: made.append(1) or d.select("id")).count()

    assert [result(df), result(df.repartition(5)), result(df.where("id < 19")), result(df.withColumn("id", df["id"] + 1))] == [20, 20, 19, 20]
    assert len(made) == 3


def test_convert_and_validate(spark, tmp_path):
    df, target = frame(spark, data(9, 64, 1)), f"file://{tmp_path}/x"
    assert datasets.convert(spark, df, target, 64).count() == 9
    assert datasets.convert(spark, df.limit(2), target, 64).count() == 9  # a valid copy is there
    assert datasets.convert(spark, df.limit(2), target, 64, force=True).count() == 2
    with pytest.raises(ValueError):
        datasets.convert(spark, df, f"file://{tmp_path}/y", 32)
    with pytest.raises(ValueError):
        datasets.validate(df, 64, rows=10)


def test_named_datasets(spark, tmp_path, monkeypatch):
    """An NPY dataset with rows held out; an HDF5 one with its own test split, by a stand-in for the optional h5py."""
    import sys

    x = data(60, 16, 1).astype(np.float32)
    np.save(f"{tmp_path}/openai-1536.npy", x)
    corpus, asked = datasets.open_dataset(spark, "openai-1536", str(tmp_path), query_limit=10)
    assert corpus.count() == 50 and sorted(r["qid"] for r in asked.collect()) == list(range(50, 60))

    for name in ("train", "test"):
        np.save(f"{tmp_path}/{name}.npy", x if name == "train" else x[:12])
    module = tmp_path / "h5py.py"
    module.write_text(f"""import numpy as np
class File(dict):
    def __init__(self, path, mode):
        assert path.endswith('.hdf5')
        super().__init__({{k: np.load('{tmp_path}/' + k + '.npy') for k in ('train', 'test')}})
    def __enter__(self):
        return self
    def __exit__(self, *a):
        pass
""")
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(module))
    corpus, asked = datasets.open_dataset(spark, "sift", str(tmp_path), query_limit=5, limit=40)
    assert corpus.count() == 40 and asked.count() == 5
    assert np.allclose([r["vec"] for r in corpus.orderBy("id").collect()], x[:40])
    sys.modules.pop("h5py", None)


def test_prepare_checks_and_converts(spark, tmp_path):
    from quiverlake.sources import prepare

    x = data(40, 16, 3).astype(np.float32)
    np.save(f"{tmp_path}/openai-1536.npy", x)
    with pytest.raises(ValueError, match="shape"):
        prepare.prepare(spark, "openai-1536", str(tmp_path))
    with pytest.raises(ValueError, match="small"):
        (tmp_path / "glove-200-angular.hdf5").write_bytes(b"x" * 50)
        prepare.prepare(spark, "glove", str(tmp_path))
    with pytest.raises(ValueError, match="no HDF5"):
        prepare.prepare(spark, "glove", str(tmp_path), least=10)
    column = prepare.COLUMN.format(dim=1536)
    wide = [[float(i)] * 1536 for i in range(12)]
    for k in range(3):
        spark.createDataFrame([(v, "t") for v in wide[4 * k : 4 * k + 4]], f"`{column}` array<double>, text string").coalesce(1).write.parquet(f"{tmp_path}/part{k}")
        (tmp_path / "shards" / "openai-1536").mkdir(parents=True, exist_ok=True)
        next((tmp_path / f"part{k}").glob("*.parquet")).rename(tmp_path / "shards" / "openai-1536" / f"train-{k}.parquet")
    got = prepare.prepare(spark, "openai-1536", str(tmp_path), rows=12)["train"].orderBy("id").collect()
    assert [(r["id"], r["vec"][0], len(r["vec"])) for r in got] == [(i, float(i), 1536) for i in range(12)]
    with pytest.raises(ValueError):
        prepare.prepare(spark, "openai-1536", str(tmp_path), rows=13)


def test_reports(spark, tmp_path):
    from quiverlake.sources import reports

    for k, ms in enumerate((4.0, 1.0, 2.0, 8.0)):
        (tmp_path / f"run{k}.txt").write_text("\n".join(["# a run", *reports.lines({"dataset": "x", "ms": {"scan": ms}})]) + "\n")
    rows = reports.read(spark, f"file://{tmp_path}")
    assert rows.count() == 8 and {r["text"] for r in rows.where("key = 'dataset'").collect()} == {"x"}
    assert [tuple(r) for r in metrics.summary(rows.where("value IS NOT NULL"), ["key"], "value").collect()] == [("ms.scan", 4, 3.75, 4.0, 3.0957)]


def test_vector_columns(spark):
    from quiverlake.functions import constants as C
    from quiverlake.functions import vector as V

    x = M.normalise(data(5, 8, 2))
    bounds, _ = C.codebook(4, 8)
    got = frame(spark, x).select("id", V.vec_codes("vec", bounds).alias("c"), V.vec_codes("vec", bounds, above=True).alias("a"), V.vec_rotate("vec", C.rotation_matrix(8)).alias("y")).orderBy("id").collect()
    assert [r["c"] for r in got] == np.searchsorted(bounds, x, side="right").tolist() == [r["a"] for r in got]
    assert np.allclose([r["y"] for r in got], C.rotate(x))


def test_merge_keeps_better_score(spark):
    a = spark.createDataFrame([(0, 1, 4, 0.5), (0, 2, 5, 0.4)], "qid bigint, rank bigint, id bigint, score double")
    b = spark.createDataFrame([(0, 1, 5, 0.9), (0, 2, 6, float("nan"))], "qid bigint, rank bigint, id bigint, score double")
    assert [(r["id"], r["score"]) for r in S.merge_results(a, b, 5).orderBy("rank").collect()] == [(5, 0.9), (4, 0.5)]
