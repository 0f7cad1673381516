"""The pipeline's stages, one by one and together, on whole small tables."""

import math
import random

import corpus_pipeline
import numpy as np
import pytest
import xxhash

from gridloom.llm import mixing, quality, registry, shared, simhash

from .test_operators import brute_hits, brute_lines, lower, slow_features


@pytest.fixture(scope="module")
def results(spark, small):
    docs = shared.table(spark, small, "documents")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(shared.materialize(stage(spark, out[-1], small), "stage"))
    return out


def test_stages_in_order(results):
    counts = [r.count() for r in results]
    assert counts == sorted(counts, reverse=True) and counts[2] == counts[1] and counts[-1] == counts[-2] > 100
    for r in results[1:-1]:
        assert r.columns == results[0].columns
    assert {"doc_id", "n_tokens", "rate"} <= set(results[-1].columns)


def test_run_gives_the_stages_rows(spark, small, results):
    run = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, small).collect()}
    assert run == {r["doc_id"]: r["n_tokens"] for r in results[-1].collect()}


def test_clean_documents_stay(spark, small, results):
    """Documents labelled good are kept by the classifier."""
    good = shared.table(spark, small, "labels").where("quality = 1").select("doc_id")
    lost = results[0].join(good, "doc_id").join(results[1], "doc_id", "left_anti").count()
    assert lost <= 0.03 * good.count()


def test_line_counts_follow(results):
    assert all(r["n_chars"] == len(r["text"]) for r in results[2].collect())


def test_extra_columns_pass_through(spark, small):
    docs = shared.table(spark, small, "documents").selectExpr("*", "1 AS rate", "'x' AS key", "'y' AS hash", "'z' AS id").limit(60)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = shared.materialize(stage(spark, docs, small), "extra")
        assert docs.columns[-4:] == ["rate", "key", "hash", "id"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count() == docs.count()


def test_no_rows_in_every_stage(spark, small):
    docs = shared.table(spark, small, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, small).count() == 0


def test_one_query_for_each_operator():
    names = list(registry.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names


def invented(seed=12):
    """Documents with every edge case, their labels and a benchmark."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, prose(rng.randint(60, 150))) for i in range(40)]
    rows += [(100 + i, " ".join(rng.choice(words) + "%%%" for _ in range(60))) for i in range(25)]  # bad
    rows = [(i, f"{t}\nShared footer  " if i < 14 else t) for i, t in rows]
    for i in range(6):  # near copies, of which the larger ids go
        near = rows[20 + i][1].split(" ")
        near[10] = "changed"
        rows.append((200 + i, " ".join(near)))
    rows += [(210, rows[30][1]), (211, rows[30][1])]
    items = [(k, prose(30)) for k in range(4)]
    rows += [(300 + k, f"{prose(40)} {items[k][1].upper()} {prose(20)}") for k in range(4)]  # contaminated
    rows += [(310, items[0][1] + " " + prose(900))]  # a benchmark passage, but less than a twentieth of it
    rows += [(400, None), (401, ""), (402, " \n "), (None, prose(70)), (None, prose(70)), (403, "one"), (404, prose(9000)), (39, rows[39][1]), (405, rows[39][1] + " tail")]
    labels = [(i, 1, int(i % 9 == 0)) for i in range(36)] + [(100 + i, 0, 0) for i in range(20)] + [(None, 1, 0), (36, None, None), (9999, 1, 0), (3, 1, 0)]
    return rows, labels, items


@pytest.fixture(scope="module")
def edge(spark, tmp_path_factory):
    rows, labels, items = invented()
    folder = str(tmp_path_factory.mktemp("edge"))
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def brute_model(rows, labels):
    """Scores by a fit in plain Python, over features taken byte by byte."""
    known = {i: t for i, t in rows if i is not None}
    held = lambda i: __import__("zlib").crc32(str(i).encode()) % 5 == 0
    sample = sorted((i, y, (known[i] or "").encode()) for i, y, _ in labels if i is not None and y is not None and i in known and not held(i))
    docs = []
    for _, _, t in sample:
        found = slow_features(t)
        at, n = np.unique(found, return_counts=True)
        docs.append((at.astype(int), n / n.sum()))
    draw = np.random.default_rng(7)
    vectors = ((draw.random((1 << quality.BITS, 8)) - 0.5) / 8).astype(np.float32).astype(np.float64)
    layer, bias, step = np.zeros((2, 8)), np.zeros(2), 0
    for _ in range(8):
        for i in draw.permutation(len(docs)):
            at, share = docs[i]
            rate = 0.5 * (1 - step / (8 * len(docs)))
            step += 1
            v = share @ vectors[at]
            p = np.exp(layer @ v + bias)
            p /= p.sum()
            p[sample[i][1]] -= 1
            back = p @ layer
            layer -= rate * np.outer(p, v)
            bias -= rate * p
            vectors[at] -= rate * np.minimum(share * len(at), 16)[:, None] * back

    def score(text):
        found = slow_features((text or "").encode())
        z = layer @ (vectors[found].mean(axis=0) if found else np.zeros(8)) + bias
        return 1 / (1 + math.exp(z[0] - z[1]))

    return score


def brute_run(rows, labels, items):
    """(rows after each stage, scores of the first) by loops over all pairs, lines and words."""
    score = brute_model(rows, labels)
    scores = [score(t) for _, t in rows]
    good = [r for r, s in zip(rows, scores, strict=True) if s >= 0.3]
    count = {}
    key = lambda x: lower(x).strip(b" \t\n\x0b\x0c\r")
    for _, t in good:
        for k in {key(x) for x in (t or "").split("\n")}:
            count[k] = count.get(k, 0) + 1
    lined = [(i, "\n".join(x for x in (t or "").split("\n") if not key(x) or count[key(x)] < 10)) for i, t in good]
    assert brute_lines(good, 1, 10)  # the same rule as the operator's own test
    sets = [frozenset(simhash.shingle_hashes(t.encode(), 5).tolist()) for _, t in lined]
    root = list(range(len(lined)))
    for a in range(len(lined)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                ra, rb = root[a], root[b]
                root = [ra if r == rb else r for r in root]
    least = {}
    for k, (i, _) in enumerate(lined):
        if i is not None:
            least[root[k]] = min(i, least.get(root[k], i))
    near = [r for k, r in enumerate(lined) if r[0] == least.get(root[k])]
    hits = dict.fromkeys(brute_hits(near, items))
    bad = {eval(h)[0] for h in hits if eval(h)[2] and 20 * eval(h)[2] >= eval(h)[1]}
    clean = [r for r in near if r[0] not in bad]
    return [good, lined, near, clean], scores


def as_rows(df):
    return sorted(str((r["doc_id"], r["text"])) for r in df.select("doc_id", "text").collect())


def test_run_equals_a_brute_force_version(spark, edge):
    rows, labels, items = invented()
    want, scores = brute_run(rows, labels, items)
    assert min(abs(s - 0.3) for s in scores) > 1e-3  # no score hangs on rounding
    docs = shared.table(spark, edge, "documents")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = shared.materialize(stage(spark, docs, edge), "stage")
        assert as_rows(docs) == sorted(str(r) for r in want[k]), corpus_pipeline.STAGES[k][0]
    clean = want[-1]
    assert {i for i, _ in rows if i is not None and 300 <= i < 304} & {i for i, _ in clean} == set() and 310 in {i for i, _ in clean}
    got = corpus_pipeline.run(spark, edge).toPandas()
    assert sorted(map(str, got.doc_id.tolist())) == sorted(str(float("nan") if i is None else got.doc_id.dtype.type(i)) for i, _ in clean)
    # Posteriors by hand: hashed words of the labelled documents that are left.
    domain = {}
    for i, q, t in labels:
        if i is not None and (t == 1 or q == 1):
            domain.setdefault(i, []).append("toxic" if t == 1 else "high")
    bucket = lambda w: xxhash.xxh64_intdigest(w.encode(), 42) % mixing.BUCKETS
    names = ["high", "toxic"]
    seen = {d: {} for d in names}
    for i, text in clean:
        for d in domain.get(i, []):
            for w in (text or "").split():
                seen[d][bucket(w)] = seen[d].get(bucket(w), 0) + 1
    total = {d: sum(seen[d].values()) for d in names}
    prior = {d: sum(x.count(d) for x in domain.values()) for d in names}
    soft = {}
    for i, text in clean:
        words = (text or "").split()
        z = [math.log((prior[d] + 1) / (sum(prior.values()) + 2)) + (12 * sum(math.log((seen[d].get(bucket(w), 0) + 1) / (total[d] + mixing.BUCKETS)) for w in words) / len(words) if words else 0) for d in names]
        e = [math.exp(x - max(z)) for x in z]
        soft[i] = (len(words), *(x / sum(e) for x in e))
    for r in got.itertuples():
        n, high, toxic = soft[None if r.doc_id != r.doc_id else int(r.doc_id)]
        assert r.n_tokens == n and r.p_high == pytest.approx(high, abs=2e-6) and r.p_toxic == pytest.approx(toxic, abs=2e-6) and r.rate >= 0
    # The fit by its optimality: totals at the target, or no move of any rate brings them nearer in the norm of the inverse Gram matrix.
    p, n, rate = got[["p_high", "p_toxic"]].to_numpy(), got.n_tokens.to_numpy().astype(float), got.rate.to_numpy()
    miss = (rate * n) @ p - np.array([0.97, 0.03]) * n.sum()
    pull = p @ np.linalg.solve((p * n[:, None]).T @ p + 1e-9 * n.sum() * np.eye(2), miss)
    met = np.abs(miss).max() <= 1.1e-3 * n.sum()
    assert met or (pull[n > 0] >= -2e-3).all() and (np.abs(pull[(rate > 1e-3) & (n > 0)]) < 0.05).all()


def test_edge_cases_pass_every_stage(spark, edge):
    """Columns of clashing names and odd types, with nulls, ties and repeated rows."""
    docs = shared.table(spark, edge, "documents").selectExpr("*", "'x' AS _id", "1 AS hash", "map('k', 1) AS tags", "'y' AS key", "2.5D AS rate", "'z' AS maybe", "array(1) AS w", "'q' AS `n_hit`", "cast(null as string) AS `a.b`")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = shared.materialize(stage(spark, docs, edge), "odd")
        assert docs.columns == columns and docs.where("tags['k'] = 1").count() == docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, edge).count() == docs.count()


def test_near_dedup_loses_no_pair(spark):
    """All pairs of the sf0.01 documents by their shingle sets: recall of what the stage removes."""
    docs = shared.table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
    sets = [np.unique(simhash.shingle_hashes(t.encode(), 5)) for _, t in rows]
    owner, root = {}, list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, s in enumerate(sets):
        for h in s.tolist():
            owner.setdefault(h, []).append(k)
    shared_by = {}
    for group in owner.values():
        for a in range(len(group)):
            for b in range(a):
                shared_by[group[b], group[a]] = shared_by.get((group[b], group[a]), 0) + 1
    pairs = [(a, b) for (a, b), n in shared_by.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    empty = [k for k, s in enumerate(sets) if not len(s)]
    for a, b in [*pairs, *zip(empty, empty[1:], strict=False)]:
        root[max(find(a), find(b))] = min(find(a), find(b))
    keep = {}
    for k, (i, _) in enumerate(rows):
        keep[find(k)] = min(i, keep.get(find(k), i))
    kept = {r["doc_id"] for r in simhash.drop_near_copies(docs).select("doc_id").collect()}
    assert len(pairs) > 50 and kept == set(keep.values())
