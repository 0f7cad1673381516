"""Each operator against a brute-force version, on small tables with nulls, empty and long texts, ties, repeated rows, clashing names and no rows."""

import hashlib
import math
import random
import warnings
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridloom.llm import components, decontaminate, exact_dedup, line_dedup, mixing, quality, prefilter, shared, simhash, substring_dedup, token_counts, url_filter, warc

CLASH = "doc_id long, text string, keep_id string, kept string, n_words string, rate string, key string, hash string, id string, sha string, __x string"


def docs_of(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, *["x"] * 9) for i, t in rows], CLASH)


def lower(text):
    return (text or "").encode().translate(shared.ASCII_LOWER)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8))) for _ in range(60)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(30)]
    out = [(i, t) for i, t in enumerate(base)]
    out += [(100 + i, base[i].upper() if i % 2 else base[i]) for i in range(10)]
    out += [(200 + i, base[i] + " tail\n" + base[i + 1]) for i in range(10)]
    out += [(300, None), (301, ""), (302, "  \n\t"), (None, base[0]), (None, None), (303, "x"), (304, "Ber " * 40), (305, "aé" * 3000), (306, "word " * 30000), (306, "word " * 30000), (307, "a\n\nb\n" * 50)]
    return out


# 1


def test_token_counts_equal_the_library(spark, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    odd = [(400, "it's <|endoftext|> a b՘c <|endoftext|>"), (401, "  lead\n\n trail  "), (402, "\U0001f600 你好 1٢½ x́"), (403, "".join(map(chr, range(0x530, 0x600)))), (404, "".join(map(chr, range(128))) * 2), (405, "<|endoftext|>")]
    got = token_counts.count_tokens(docs_of(spark, rows + odd), path, part_bytes=500, group_bytes=5000).collect()
    want = sorted(((i is None, i or 0), len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in rows + odd)
    assert sorted(((r[0] is None, r[0] or 0), r[1], r[2]) for r in got) == want


def test_token_counts_cut_long_texts_safely():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = token_counts.PreTokens(path)
    for text in ("some words 12 and   more\n it's " * 9000, "some wörds 12 and   more\n it's " * 9000):
        freq, added = t.frequencies(text)
        assert sum(n * t.pieces(p) for p, n in freq.items()) + added == len(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids)


def test_pieces_are_counted_once_for_each_pre_token(spark, monkeypatch):
    """The groups together are one table of distinct pre-tokens: every part's pre-tokens are in it, none twice."""
    import public_tokenizers

    seen = []
    real = token_counts.materialize
    monkeypatch.setattr(token_counts, "materialize", lambda df, name: (seen.append(out.toPandas()) if name == "pieces" else None) or out if (out := real(df, name)) is not None else None)
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = token_counts.count_tokens(docs_of(spark, [(i, f"the cat {i % 3}") for i in range(40)]), path, part_bytes=30, group_bytes=100)
    assert {r["n_tokens"] for r in got.collect()} == {3}
    pieces = seen[0]
    assert pieces.part.nunique() > 10 and pieces.groupby("g")["distinct"].first().sum() == 5  # the, cat, 0, 1, 2
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("parts_")]


def test_token_counts_refuse_other_kinds(tmp_path):
    import json

    import public_tokenizers

    with pytest.raises(ValueError, match="byte-level"):
        token_counts.PreTokens(public_tokenizers.path("word_bpe_49k.json"))
    told = json.load(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8"))
    for change, problem in ((lambda t: t["pre_tokenizer"].update(add_prefix_space=True), "prefix space"), (lambda t: t["added_tokens"][0].update(lstrip=True), "lstrip")):
        other = json.loads(json.dumps(told))
        change(other)
        path = tmp_path / "other.json"
        path.write_text(json.dumps(other), encoding="utf-8")
        with pytest.raises(ValueError, match=problem):
            token_counts.PreTokens(str(path))


# 2


@pytest.mark.parametrize("most", [16 << 20, 8192])
def test_exact_dedup(spark, rows, most, monkeypatch):
    if most < 1 << 20:
        monkeypatch.setattr(exact_dedup, "CELLS_PER_ROW", 2048)  # several slices
    groups = {}
    for i, t in rows:
        groups.setdefault(hashlib.sha256(lower(t)).hexdigest(), []).append(i)
    want = sorted(str((i, max((x for x in g if x is not None), default=None), len(g), i == max((x for x in g if x is not None), default=None), h)) for h, g in groups.items() for i in g)
    got = exact_dedup.exact_dedup(docs_of(spark, rows), max_filter_bytes=most).collect()
    assert sorted(str(tuple(r)) for r in got) == want


def test_repeated_hashes_are_never_missed(spark):
    sha = [hashlib.sha256(str(i % 700).encode()).digest() for i in range(1000)]
    df = spark.createDataFrame([(i, bytearray(s)) for i, s in enumerate(sha)], "id long, sha binary").repartition(7)
    maybe = {r["id"] for r in exact_dedup.possibly_repeated(df).where("maybe").collect()}
    twice = {i for i in range(1000) if i % 700 < 300}
    assert twice <= maybe and len(maybe - twice) < 40


# 3


def brute_spans(rows, length):
    first = {}
    for i, t in sorted((math.inf if i is None else i, (t or "").encode()) for i, t in rows):
        for k in range(len(t) - length + 1):
            first.setdefault(t[k : k + length], i)
    out = []
    for i, t in rows:
        b, rank = (t or "").encode(), math.inf if i is None else i
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < rank:
                gone[k : k + length] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append(str((i, len(b), int(gone.sum()), int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(b) else 0, hashlib.sha256(kept).hexdigest())))
    return sorted(out)


@pytest.mark.parametrize("chunk", [3000, 4 << 20])
def test_substring_dedup(spark, rows, chunk):
    some = [(i, t) for i, t in rows if i != 306] + [(306, "word " * 3000), (306, "word " * 3000)]
    got = substring_dedup.remove_repeats(docs_of(spark, some), length=50, chunk_bytes=chunk).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_spans(some, 50)


def test_a_passage_in_many_surroundings_is_dealt_out(spark):
    """One passage of 67 bytes in 5,000 documents that have nothing else in common: as many different segments of one minimizer."""
    rng = random.Random(11)
    noise = lambda: "".join(rng.choice("abcdefghijklmnop ") for _ in range(60))
    passage = "The passage that stands in thousands of documents, each time anew. "
    rows = [(i, f"{noise()}{passage}{noise()}") for i in range(5000)]
    want = {i: (0 if i == 0 else 1) for i, _ in rows}
    for hot in (20_000, 1 << 30):
        got = substring_dedup.remove_repeats(docs_of(spark, rows), chunk_bytes=100_000, group_bytes=50_000, slice_bytes=20_000, hot_bytes=hot).collect()
        assert {r["doc_id"]: r["n_spans"] for r in got} == want and all(r["n_removed"] >= 67 for r in got if r["doc_id"])
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("chunks_")]


def test_substring_pieces_of_a_split_minimizer_stay_small():
    """The answer to values deals a value with many segments into parts by its size."""
    import pyarrow as pa

    rows = pa.table({"chunk": [1, 2], "bucket": [0, 0], "values": [substring_dedup._zip(np.array([7, 3], np.uint64), np.array([2, 2 * 400 + 1], np.uint16)), substring_dedup._zip(np.array([7, 3], np.uint64), np.array([2, 2 * 100], np.uint16))]})
    told = substring_dedup._answer_values(50, 20_000)(rows)
    parts = [substring_dedup._unzip(x.as_py(), "<u4")[0].tolist() for x in told["told"]]
    assert parts[0] == parts[1] and parts[0][0] == 1 and parts[0][1] >= 500 * 18 * 50 / 20_000


def test_long_texts_sort_like_short_ones(monkeypatch):
    rng = np.random.default_rng(5)
    text = rng.integers(1, 3, 4000).astype(np.uint8)
    text[rng.integers(0, 4000, 40)] = 0
    text[-1] = 0
    both = []
    for places in (substring_dedup.PLACES, 10):
        monkeypatch.setattr(substring_dedup, "PLACES", places)
        order, values, known = substring_dedup.suffix_order(text, 50)
        groups = substring_dedup.shared_prefix_groups(text, order, values, known, 50)
        of = np.empty(len(text), np.int64)
        of[order] = groups
        both.append(of)
    assert (both[0] == both[1]).all()


def test_few_ties_in_a_long_text(monkeypatch):
    """Ties that are few enough to be sorted with their places stand beyond the largest place that fits (a slice of over 2 MB, at 21 bits)."""
    monkeypatch.setattr(substring_dedup, "PLACE_BITS", 10)
    monkeypatch.setattr(substring_dedup, "PLACES", (1 << 10) - 1)
    rng = np.random.default_rng(7)
    pieces = [rng.integers(97, 122, 90).astype(np.uint8).tobytes() for _ in range(60)]
    pieces += [bytes(rng.integers(97, 122, 10).astype(np.uint8)) + p[20:80] for p in pieces[-5:]]
    docs = np.arange(len(pieces))[::-1].copy()
    best = {}
    for p, d in zip(pieces, docs.tolist(), strict=True):
        for i in range(len(p) - 49):
            best[p[i : i + 50]] = min(d, best.get(p[i : i + 50], 99))
    got, _ = substring_dedup.least_holders(pieces, docs, 50)
    assert got.tolist() == [best[p[i : i + 50]] for p in pieces for i in range(len(p) - 49)]


def test_slices_of_a_group_are_cut_by_bytes():
    """However unevenly keys lie, a slice holds its share of bytes and what one key has at most."""
    rng = np.random.default_rng(9)
    keys = [np.sort(rng.choice(np.concatenate([np.arange(300), np.array([1 << 31])]), n).astype(np.uint64)) for n in (500, 700)]
    sizes = [rng.integers(50, 114, len(k)) for k in keys]
    begins = substring_dedup._slices(keys, sizes, 4000)
    key, size = np.concatenate(keys), np.concatenate(sizes)
    held = np.bincount(np.searchsorted(begins, key, side="right") - 1, size)
    assert begins[0] == key.min() and (np.diff(begins.astype(np.int64)) > 0).all()
    assert len(held) == len(begins) >= size.sum() / 4000 and held.max() <= 4000 + max(size[key == k].sum() for k in np.unique(key))


def test_substring_dedup_text(spark):
    a = "The quick brown fox jumps over the lazy dog while it rains in spring."
    got = {r["doc_id"]: bytes(r["kept"]).decode() for r in substring_dedup.remove_repeats(docs_of(spark, [(2, f"new {a} end"), (1, a)]), with_text=True).collect()}
    assert got == {1: a, 2: "new  end"}


def test_suffix_groups_against_brute_force():
    rng = random.Random(3)
    for _ in range(20):
        length = rng.choice([10, 24, 50])
        base = ["".join(rng.choice("ab ") for _ in range(rng.randint(60, 200))).encode() for _ in range(4)]
        pieces = set()
        for _ in range(30):
            b = rng.choice(base)
            s = rng.randint(0, len(b) - length)
            pieces.add(b[s : rng.randint(s + length, min(len(b), s + length + 63))])
        pieces, docs = sorted(pieces), np.array([rng.randint(0, 30) for _ in pieces])
        best = {}
        for p, d in zip(pieces, docs, strict=True):
            for i in range(len(p) - length + 1):
                best[p[i : i + length]] = min(d, best.get(p[i : i + length], 99))
        got, _ = substring_dedup.least_holders(pieces, docs, length)
        assert got.tolist() == [best[p[i : i + length]] for p in pieces for i in range(len(p) - length + 1)]


# 4


def test_quality(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(80)]
    good = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(150)]
    bad = [" ".join(rng.choice(words) + "%%%" for _ in range(40)) if k % 2 else " ".join([rng.choice(words)] * 30) for k in range(150)]
    rows = list(enumerate(good + bad))
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i, _ in rows] + [(None, 1, 0), (7, None, 0), (99999, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    docs = docs_of(spark, [*rows, (500, None), (501, ""), (None, good[0]), (502, "a" * 3_000_000)])
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    for i, t in rows:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert got[i]["predicted"] == (got[i]["score"] >= 0.3) and 0 <= got[i]["score"] <= 1
    held = [i for i, _ in rows if got[i]["held_out"]]
    right = lambda ids: np.mean([got[i]["predicted"] == (i < 150) for i in ids])
    # One word over and over is bad only as far as training has shown that pair of words: nothing but learned n-grams decides.
    assert right([i for i in held if i < 150 or i % 2]) > 0.95 and right(held) > 0.85
    assert got[None]["held_out"] is None and got[500]["score"] == got[501]["score"]
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id < 150").count() > 140


def test_quality_scores_do_not_depend_on_the_batch():
    rng = np.random.default_rng(0)
    model = quality.QualityModel(rng.normal(size=1 << quality.BITS).astype(np.float32), 0.1)
    texts = [b"", b" ", b"one", b"b b b c", "é à ü".encode(), b"tab\tand\nline " * 50]
    alone = np.concatenate([model.scores([t]) for t in texts])
    assert np.allclose(model.scores(texts), alone, atol=1e-12) and alone[0] == alone[1]


def slow_features(text):
    """Buckets of a text's features, with repeats, in plain Python: byte by byte, word by word."""
    at = lambda h: (h * 0xD6E8FEB86659FD93 % 2**64) >> (64 - quality.BITS)
    blanks = b" \t\n\x0b\x0c\r"
    padded = bytes(32 if b in blanks else b for b in b" " + text + b" ")
    out = [at(int.from_bytes(padded[i : i + n], "little") + (n << 56)) for n in quality.GRAMS for i in range(len(padded) - n + 1) if b"  " not in padded[i : i + n]]
    words = [sum(b * pow(quality._P, k, 2**64) for k, b in enumerate(w[: quality.REACH])) % 2**64 for w in padded.split()]
    out += [at(w) for w in words]
    return out + [at((a * 0xC2B2AE3D27D4EB4F % 2**64) ^ ((b + (b >> 7)) % 2**64)) for a, b in zip(words, words[1:], strict=False)]


def test_quality_features_equal_plain_ones(monkeypatch):
    texts = [b"", b" ", b"one", b"b b b c", "é à  ü\n".encode(), b"tab\tand\n\nline " * 50, b"x" * 300 + b" tail", b"ends at a border " * 20, b"   lead"]
    for size in (1 << 17, 64, 100):
        monkeypatch.setattr(quality, "BLOCK_BYTES", size)
        got = [[] for _ in texts]
        for buckets, owner in quality.features(texts):
            for b, t in zip(buckets.tolist(), owner.tolist(), strict=True):
                got[t].append(b)
        assert [sorted(g) for g in got] == [sorted(slow_features(t)) for t in texts]


def test_quality_fit_equals_a_plain_one():
    """Training and scoring against loops over single features in double precision."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab c") for _ in range(rng.randint(0, 60))).encode() for _ in range(30)]
    labels = [rng.randint(0, 1) for _ in texts]
    model = quality.fit(texts, labels, epochs=3)
    draw = np.random.default_rng(7)
    vectors = ((draw.random((1 << quality.BITS, 8)) - 0.5) / 8).tolist()
    layer, bias, step = [[0.0] * 8, [0.0] * 8], [0.0, 0.0], 0
    for _ in range(3):
        for i in draw.permutation(len(texts)):
            found = slow_features(texts[i])
            share = {b: found.count(b) / len(found) for b in set(found)}
            rate = 0.5 * (1 - step / (3 * len(texts)))
            step += 1
            v = [sum(s * vectors[b][d] for b, s in share.items()) for d in range(8)]
            z = [sum(x * y for x, y in zip(layer[c], v, strict=True)) + bias[c] for c in (0, 1)]
            p = [math.exp(x) / (math.exp(z[0]) + math.exp(z[1])) for x in z]
            p[labels[i]] -= 1
            back = [p[0] * layer[0][d] + p[1] * layer[1][d] for d in range(8)]
            layer = [[layer[c][d] - rate * p[c] * v[d] for d in range(8)] for c in (0, 1)]
            bias = [bias[c] - rate * p[c] for c in (0, 1)]
            for b, s in share.items():
                vectors[b] = [x - rate * min(s * len(share), 16) * y for x, y in zip(vectors[b], back, strict=True)]
    for text, score in zip(texts, model.scores(texts), strict=True):
        found = slow_features(text)
        v = [sum(vectors[b][d] for b in found) / max(1, len(found)) for d in range(8)]
        z = [sum(x * y for x, y in zip(layer[c], v, strict=True)) + bias[c] for c in (0, 1)]
        assert score == pytest.approx(1 / (1 + math.exp(z[0] - z[1])), abs=1e-4)


def test_quality_training_holds_features_packed():
    """What waits for its turn in training takes 3 bytes a feature at most, and comes back as it was."""
    import tracemalloc

    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefghij é") for _ in range(4000)).encode() for _ in range(60)] + [b"", b"word " * 70000]
    tracemalloc.start()
    docs = quality.counted(texts)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    want = [np.unique(slow_features(t), return_counts=True) for t in (texts[0], texts[-2], texts[-1])]
    assert held < 3 * 60 * len(want[0][0])
    for (bucket, count), doc in zip(want, (docs[0], docs[-2], docs[-1]), strict=True):
        got, share = quality._unpack(doc)
        assert got.tolist() == bucket.tolist() and np.array_equal(share, (count / max(1, count.sum())).astype(np.float32))


def test_quality_sample_is_bounded_by_bytes(spark):
    rows = [(i, f"{i} " * (1 + i % 50)) for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    whole = {t for t, _ in quality.training_sample(docs_of(spark, rows), labels, 4000, 1 << 30, "doc_id", "text", "quality")}
    kept = [{t for t, _ in quality.training_sample(docs_of(spark, rows).repartition(n), labels, 4000, 3000, "doc_id", "text", "quality")} for n in (1, 5)]
    assert kept[0] == kept[1] < whole and 2000 < sum(map(len, kept[0])) <= 3000
    assert len(quality.training_sample(docs_of(spark, rows), labels, 17, 1 << 30, "doc_id", "text", "quality")) == 17


def test_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.classify(docs_of(spark, [(1, "text")]), none).collect()
    assert got[0]["score"] == pytest.approx(0.5, abs=0.3) and quality.classify(docs_of(spark, []), none).count() == 0


# 5


def brute_fingerprint(text, width=3):
    words = lower(text).split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + width] if len(words) > width else words), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash(spark, rows):
    near = [(600 + k, " ".join(["lorem"] * 200 + ["ipsum"] * k)) for k in range(8)]
    all_rows = rows + near
    prints = [brute_fingerprint(t) for _, t in all_rows]
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    low = {}
    for k, (i, _) in enumerate(all_rows):
        if i is not None:
            low[find(k)] = min(i, low.get(find(k), i))
    want = sorted(str((i, f"{p:016x}", low.get(find(k)))) for k, ((i, _), p) in enumerate(zip(all_rows, prints, strict=True)))
    got = simhash.near_duplicates(docs_of(spark, all_rows)).collect()
    assert sorted(str(tuple(r)) for r in got) == want


def test_close_pairs():
    rng = np.random.default_rng(1)
    for radius in (1, 2, 3, 7, 12, 20):
        p = rng.integers(0, 2**63, 400).astype(np.uint64)
        for k in range(200):
            x = int(p[k % 15])
            for b in rng.choice(64, rng.integers(0, radius + 3), replace=False):
                x ^= 1 << int(b)
            p[200 + k] = x
        starts = np.array([0, 1, 3, 100, 165, 200, 201])
        got = set()
        for a, b in simhash.close_pairs(p, starts, radius):
            got |= set(zip(a.tolist(), b.tolist(), strict=True))
        ends = [*starts[1:].tolist(), 400]
        want = {(i, j) for s, e in zip(starts.tolist(), ends, strict=True) for i in range(s, e) for j in range(i + 1, e) if int(p[i] ^ p[j]).bit_count() <= radius}
        assert got == want


def test_big_blocks_are_dealt_out_without_losing_links(spark):
    rng = np.random.default_rng(2)
    p = rng.integers(0, 2**63, 40)
    near = [int(x) ^ (1 << int(b)) for x in p for b in rng.choice(60, 2, replace=False)]
    every = [int(x) for x in p] + near
    df = spark.createDataFrame([(1, x, x) for x in every], "key long, node long, fp long")
    roots = [components.components(simhash.candidate_links(df, 2, tile=t)).collect() for t in (2048, 16)]
    sets = [sorted(sorted(r["node"] for r in rs if r["root"] == root) for root in {r["root"] for r in rs}) for rs in roots]
    assert sets[0] == sets[1] and len(sets[0]) == 40


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 50), (100, 60), (70, 100), (5, 5), (200, 201), (200, 201)]
    got = {(r["node"], r["root"]) for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(41)} | {(i, 50) for i in (50, 60, 70, 100)} | {(200, 200), (201, 200)}


def test_near_copies(spark, monkeypatch):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    base = [[rng.choice(words) for _ in range(150)] for _ in range(20)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    for i in range(10):  # one changed word leaves 5 of 146 shingles different, similarity 0.93
        near = list(base[i])
        near[70] = "changed"
        rows.append((100 + i, " ".join(near)))
        rows.append((200 + i, " ".join(base[i])))
    half = [(300 + i, " ".join(base[i][:75] + [rng.choice(words) for _ in range(75)])) for i in range(10, 20)]  # similarity about a third: stays
    odd = [(400, None), (401, ""), (402, "  "), (403, "one two"), (404, "one two"), (None, " ".join(base[0]))]
    docs = docs_of(spark, rows + half + odd)
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    want = set(range(20)) | {i for i, _ in half} | {400, 403}
    assert {r["doc_id"] for r in kept.collect()} == want
    assert {r["doc_id"] for r in simhash.drop_near_copies(docs, tile=4).collect()} == want
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", 0)
    assert {r["doc_id"] for r in simhash.drop_near_copies(docs).collect()} == want


def test_near_copies_that_repeat_differently(spark):
    """Copies of which one repeats a passage have nearly the same set of shingles, or the same, however often it stands there."""
    rng = random.Random(8)
    rows = []
    for k in range(12):
        words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        footer = words[100:140]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words + footer * 60))]
    loop = ["a", "b", "c", "d", "e", "f", "g"]
    rows += [(100, " ".join(loop * 2)), (101, " ".join(loop * 90 + loop[:4]))]
    far = [np.bitwise_count(np.uint64(simhash.fingerprint(simhash.shingle_hashes(a.encode(), 5)) ^ simhash.fingerprint(simhash.shingle_hashes(b.encode(), 5)))) > 20 for (_, a), (_, b) in zip(rows[0:24:2], rows[1:24:2], strict=True)]
    assert any(far)  # with repeats counted, the radius would not hold them
    got = sorted((r["id"], r["keeper"]) for r in simhash.near_copies(docs_of(spark, rows)).collect())
    assert got == [*((2 * k + 1, 2 * k) for k in range(12)), (101, 100)]


def test_near_copies_do_not_chain_texts_that_share_a_passage(spark, monkeypatch):
    """Texts that share a sixth of their shingles are no candidates; a chain of them would send each text once for each tile of it."""
    rng = random.Random(9)
    passage = [f"w{rng.randrange(10**6)}" for _ in range(64)]
    rows = [(i, " ".join(passage + [f"w{rng.randrange(10**6)}" for _ in range(136)])) for i in range(300)]
    rows += [(1000 + i, f"{rows[i][1]} more") for i in range(5)]
    sizes = []

    def seen(edges):
        out = components.components(edges)
        sizes.append(max((r["count"] for r in out.groupBy("root").count().collect()), default=0))
        return out

    monkeypatch.setattr(simhash, "components", seen)
    got = sorted((r["id"], r["keeper"]) for r in simhash.near_copies(docs_of(spark, rows)).collect())
    assert got == [(1000 + i, i) for i in range(5)]
    assert sizes[0] <= 20


def test_sketches_lose_hardly_any_pair():
    rng = np.random.default_rng(2)
    far = []
    for n in (9, 90, 900):
        for _ in range(400):
            pool = rng.integers(0, 1 << 63, n + n // 9, dtype=np.uint64) * np.uint64(2)
            a, b = simhash.sketch(pool[:n]), simhash.sketch(pool[n // 9 :])  # a similarity of 0.8
            far.append(int(np.bitwise_count(a ^ b).sum()))
    assert max(far) <= simhash.sketch_radius(0.8) and 11.5 < np.mean(far) < 14 and simhash.sketch(np.zeros(0, np.uint64)).shape == (2,)


@pytest.mark.parametrize("most", [1 << 18, 64])
def test_prefilter_never_rules_out_a_key(spark, most):
    keys = spark.range(0, 60000, 3).select((F.xxhash64("id")).alias("k"))
    rows = spark.range(60000).withColumn("k", F.xxhash64("id")).withColumn("t", F.lit("x"))
    marked = prefilter.Filter(keys, most).mark(rows, F.col("k"), "maybe")
    assert marked.columns == ["id", "k", "t", "maybe"]
    maybe = {r["id"] for r in marked.where("maybe").collect()}
    held = set(range(0, 60000, 3))
    assert held <= maybe and (len(maybe - held) < 400 or most < 1 << 18)
    assert prefilter.Filter(keys.limit(0)).mark(rows, F.col("k"), "maybe").where("maybe").count() == 0
    assert prefilter.Filter(keys).mark(rows.withColumn("k", F.lit(None).cast("long")), F.col("k"), "maybe").where("not maybe").count() == 60000


def test_without_keeps_columns_of_any_name(spark):
    names = "doc_id long, text string, __id string, __hash string, __maybe string, __gone string, __GONEh string, `a.b` string, m map<string,int>"
    rows = [(1, "a", *["x"] * 6, {"k": 1}), (1, "b", *["x"] * 6, None), (None, "a", *["x"] * 6, None), (2, None, *["x"] * 6, None), (2, None, *["x"] * 6, None)]
    docs = spark.createDataFrame(rows, names)
    gone = docs.where("(doc_id = 1 and text = 'a') or doc_id is null or text is null").select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash")).distinct()
    left = prefilter.without(docs, gone, "doc_id", F.xxhash64("text"))
    assert left.columns == docs.columns and [(r["doc_id"], r["text"]) for r in left.collect()] == [(1, "b")]
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and sorted(str((r["doc_id"], r["text"])) for r in kept.collect()) == ["(1, 'a')", "(1, 'b')", "(2, None)", "(2, None)"]


# 6


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["apple", "pear", "plum"] if i % 3 else ["bolt", "nut", "gear"]) for _ in range(rng.randint(5, 50)))) for i in range(200)]
    labelled = spark.createDataFrame([(i, "fruit" if i % 3 else "metal") for i in range(0, 200, 2)] + [(None, "fruit"), (1, None), (3, "other")], "id long, domain string")
    docs = docs_of(spark, [*rows, (500, None), (501, ""), (None, "apple"), (502, "gear"), (502, "gear")])
    got = mixing.mix(docs, labelled, {"fruit": 0.5, "metal": 0.5}).toPandas()
    assert len(got) == 205 and (got.rate >= 0).all()
    assert np.allclose(got.p_fruit + got.p_metal, 1, atol=1e-5)
    used = got.rate * got.n_tokens
    assert abs((used * got.p_fruit).sum() / used.sum() - 0.5) < 2e-3 and abs(used.sum() / got.n_tokens.sum() - 1) < 2e-3
    by = got.set_index("doc_id")
    assert by.p_fruit[1] > 0.9 and by.p_metal[3] > 0.9
    assert dict(zip(got.doc_id, got.n_tokens, strict=True))[502] == 1 and (by.n_tokens[[500, 501]] == 0).all()


def test_rates_equal_a_numpy_fit(spark):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.5] * 3, 50).round(6)
    n = rng.integers(1, 99, 50)
    soft = spark.createDataFrame([(i, int(t), *map(float, q)) for i, (t, q) in enumerate(zip(n, p, strict=True))], "i int, n_tokens long, p_0 double, p_1 double, p_2 double")
    got = np.array([r["rate"] for r in mixing.fit_rates(soft, [0.7, 0.2, 0.1], max_steps=40).orderBy("i").collect()])
    rate, first, gram = np.ones(50), n @ p, (p * n[:, None]).T @ p
    target = np.array([0.7, 0.2, 0.1]) * first.sum()
    last = np.inf
    for _ in range(40):
        have = (rate * n) @ p
        gap = abs(have - target).max()
        if not 1e-3 * first.sum() < gap < 0.98 * last:
            break
        last = gap
        rate = np.maximum(0, rate - p @ np.linalg.solve(gram, have - target))
    assert np.allclose(got, rate, atol=1e-6)


@pytest.mark.parametrize("seed", range(2))
def test_rates_reach_targets_that_can_be_met(spark, seed):
    """Targets are the totals of invented rates, many of them 0, so that they can be met; most plain steps shrink the gap by less than 2 %."""
    rng = np.random.default_rng(seed)
    p = rng.dirichlet([6.0, 2.0, 1.0], 200).round(6)
    n = rng.integers(1, 99, 200)
    goal = (np.where(p[:, 0] > np.quantile(p[:, 0], 0.9), 1.0, 0.0) * n) @ p
    soft = spark.createDataFrame([(i, int(t), *map(float, q)) for i, (t, q) in enumerate(zip(n, p, strict=True))], "i int, n_tokens long, p_0 double, p_1 double, p_2 double")
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        rate = np.array([r["rate"] for r in mixing.fit_rates(soft, goal.tolist()).orderBy("i").collect()])
    assert (rate >= 0).all() and abs((rate * n) @ p / n.sum() - goal / goal.sum()).max() <= 1e-3 + 1e-6


def test_rates_report_targets_that_cannot_be_met(spark):
    """No document has more than 0.6 of domain 0: the nearest totals use the documents at 0.6 only."""
    soft = spark.createDataFrame([(i, 10, x / 100, 1 - x / 100) for i, x in enumerate(range(20, 61))], "i int, n_tokens long, p_0 double, p_1 double")
    with pytest.warns(UserWarning, match="from the target of a domain"):
        got = mixing.fit_rates(soft, [0.9, 0.1]).orderBy("i").toPandas()
    assert (got.rate[got.p_0 < 0.55] < 0.05).all() and got.rate.iloc[-1] > 1
    # By hand: along (0.6, 0.4) alone the nearest total in the norm of the inverse Gram matrix.
    p = got[["p_0", "p_1"]].to_numpy()
    inverse = np.linalg.inv(10 * p.T @ p)
    t, a = np.array([0.9, 0.1]) * 410, np.array([0.6, 0.4])
    assert np.allclose((10 * got.rate.to_numpy()) @ p, a * (a @ inverse @ t) / (a @ inverse @ a), atol=2e-3 * 410)
    with pytest.warns(UserWarning, match="from the target of a domain"):
        mixing.fit_rates(soft, [0.59, 0.41], max_steps=1)


def test_mixing_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "id long, domain string")
    got = mixing.mix(docs_of(spark, [(1, "a b"), (2, None)]), none, {"x": 0.5, "y": 0.5}).collect()
    assert [(r["p_x"], r["p_y"], r["rate"]) for r in got] == [(0.5, 0.5, 1.0)] * 2
    assert mixing.mix(docs_of(spark, []), none, {"x": 0.5, "y": 0.5}).count() == 0


# 7


def test_warc_round_trip(spark):
    pages = [(i, f"http://a/{i}", f"<p>{i % 40} {'x' * (i % 7)}</p>" * 5) for i in range(120)] + [(500, None, None), (501, "http://\nb", ""), (None, "u", "<p>null id</p>"), (None, "u", "<p>null id</p>"), (502, "u", "é\r\n\r\n" * 40000), (7, "u", "<p>7 </p>")]
    df = spark.createDataFrame([(*p, "x", "y") for p in pages], "page_id long, url string, html string, sha string, first string")
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))

    def want(least):
        out = []
        for i, _, h in pages:
            b = (h or "").encode()
            top = first.get(h or "")
            again = len(b) >= least and top is not None and i != top
            out.append(str((None if i is None else str(i), len(b), warc.payload_digest(b), "revisit" if again else "response", str(top) if again else None)))
        return sorted(out)

    for least in (0, 30):
        archives = shared.materialize(warc.write_archives(df, min_revisit_bytes=least, archive_bytes=4000), "t")
        got = warc.read_archives(archives, with_payload=True).collect()
        assert sorted(str((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in got) == want(least)
        texts = {str(i): (h or "").encode() for i, _, h in pages[8:] if i is not None}
        assert all(bytes(r["payload"]) == texts[r["page_id"]] for r in got if r["record_type"] == "response" and r["page_id"] in texts and r["page_id"] != "7")


def test_warc_format(tmp_path, spark):
    records = [warc.record(i, "u", b"<html>" + bytes([65 + i % 20]) * 300, "D") for i in range(200)]
    blob = warc.pack(records)
    assert int.from_bytes(blob[:4], "little") == 0x184D2A5D and int.from_bytes(blob[4:8], "little") > 0
    assert list(warc.unpack(blob)) == records
    assert list(warc.unpack(warc.pack([]))) == [] and list(warc.unpack(warc.pack(records[:1]))) == records[:1]
    with pytest.raises(ValueError, match="dictionary frame"):
        list(warc.unpack(b"\0" * 20))
    rows = spark.createDataFrame([("a.warc.zst", 200, bytearray(blob))], "name string, records long, content binary")
    paths = warc.export_archives(rows, str(tmp_path / "out")).collect()
    assert open(paths[0]["path"], "rb").read() == blob


@pytest.mark.parametrize("size", [70_000, 100_000, 300_000])
def test_warc_dictionary_for_records_of_any_size(size):
    rng = random.Random(size)
    menu = " ".join(f"<a href='/part/{rng.randrange(10**9)}'>{rng.randrange(10**9)}</a>" for _ in range(250))
    records = [warc.record(i, "u", (f"<html>{menu}" + "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(size // 3)) + menu).encode(), "D") for i in range(max(8, 2_000_000 // size))]
    blob = warc.pack(records)
    words = int.from_bytes(blob[4:8], "little")
    plain = sum(len(warc.zstandard.ZstdCompressor(level=3).compress(r)) for r in records)
    assert words > 0 and list(warc.unpack(blob)) == records and len(blob) - words < plain


def test_warc_dictionary_of_few_records():
    for n, size in ((1, 10), (1, 500_000), (3, 100), (20, 5)):
        records = [warc.record(i, None, b"x" * size, "D") for i in range(n)]
        blob = warc.pack(records)
        assert int.from_bytes(blob[4:8], "little") > 0 and list(warc.unpack(blob)) == records


def test_warc_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(none)).count() == 0


# 8


def test_url_filter(spark):
    log = """
host  bad.org  add     2024-01-10 00:00:00
host  bad.org  remove  2024-01-20 00:00:00
host  bad.org  add     2024-02-01 00:00:00
path  /ads     add     2024-01-01 00:00:00
param utm      add     2024-01-05 00:00:00
host  both.org add     2024-01-05 00:00:00
host  both.org remove  2024-01-05 00:00:00
"""
    entries = url_filter.list_entries(spark, log).unionByName(spark.createDataFrame([("host", None, "add", None), ("host", "x", "other", None)], "kind string, value string, action string, at timestamp_ntz"))
    cases = [(1, "http://u:p@A.Bad.org:80/x", "2024-01-10 00:00:00", ["host:bad.org"]), (2, "http://bad.org/", "2024-01-20 00:00:00", []), (3, "https://bad.org", "2024-03-01 00:00:00", ["host:bad.org"]), (4, "http://notbad.org/ads/1?utm=2&utm=3#f", "2024-01-06 00:00:00", ["param:utm", "path:/ads"]), (5, "http://x.org/adsx?a", "2024-01-06 00:00:00", []), (6, None, "2024-01-06 00:00:00", []), (7, "http://bad.org", None, []), (8, "not a url", "2024-01-15 00:00:00", []), (9, "http://both.org", "2024-01-06 00:00:00", []), (1, "http://u:p@A.Bad.org:80/x", "2024-01-10 00:00:00", ["host:bad.org"]), (None, "http://bad.org", "2024-01-15 00:00:00", ["host:bad.org"]), (10, "http://bad.org/" + "p/" * 3000, "2024-01-15 00:00:00", ["host:bad.org"])]
    df = spark.createDataFrame([(i, u, t, "x", "y") for i, u, t, _ in cases], "page_id long, url string, t string, rules string, kind string").withColumn("fetched_at", F.col("t").cast("timestamp_ntz"))
    got = sorted((str(r["page_id"]), r["rules"], r["blocked"]) for r in url_filter.judge(df, entries).collect())
    assert got == sorted((str(i), w, bool(w)) for i, _, _, w in cases)
    never = url_filter.judge(df, entries.limit(0))
    assert never.count() == len(cases) and never.where("blocked").count() == 0 and url_filter.judge(df.limit(0), entries).count() == 0


def test_url_filter_of_a_long_list(spark):
    """Thousands of entries over years, some keys with hundreds of turns, against a scan of the whole log for each capture; urls of any length."""
    rng = random.Random(6)
    stamp = lambda m: str(np.datetime64("2022-01-01T00:00:00") + np.timedelta64(m, "m")).replace("T", " ")
    span = 3 * 366 * 1440
    hosts, paths = [f"h{k}.org" for k in range(30)], [f"/a/{k}" for k in range(300)]
    log = [("host", "h0.org", rng.choice(["add", "remove"]), rng.randrange(span)) for _ in range(600)]
    log += [("host", rng.choice(hosts), rng.choice(["add", "remove"]), rng.randrange(span)) for _ in range(400)] + [("path", rng.choice(paths), rng.choice(["add", "add", "remove"]), rng.randrange(span)) for _ in range(3000)]
    entries = spark.createDataFrame([(k, v, a, stamp(m)) for k, v, a, m in log], "kind string, value string, action string, at string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    cases = []
    for i in range(400):
        host, path, m = rng.choice(["h0.org", *hosts]), rng.choice(paths), rng.randrange(span + 90 * 1440)
        asked = [("host", host), ("path", path)]
        rules = []
        for kind, value in asked:
            turns = sorted((at, a == "remove") for k, v, a, at in log if (k, v) == (kind, value) and at <= m)
            if turns and not turns[-1][1]:
                rules.append(f"{kind}:{value}")
        tail = "/x" * 20_000 if i % 100 == 0 else "/deep/er"
        cases.append((i, f"https://www.{host}{path}{tail}?q=1", m, sorted(rules)))
    df = spark.createDataFrame([(i, u, stamp(m)) for i, u, m, _ in cases], "page_id long, url string, t string").withColumn("fetched_at", F.col("t").cast("timestamp_ntz"))
    got = {r["page_id"]: r["rules"] for r in url_filter.judge(df, entries).collect()}
    assert got == {i: r for i, _, _, r in cases}


# 9


def brute_hits(docs, items):
    def words(t):
        out, run = [], bytearray()
        for b in lower(t) + b" ":
            if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122:
                run.append(b)
            elif run:
                out.append(bytes(run))
                run = bytearray()
        return out

    windows = {}
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for k in range(len(w)):
            for n in range(1, 14):
                if tuple(w[k : k + n]) in windows and k + n <= len(w):
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out.append(str((i, len(w), len(hit), len(found), sorted(found))))
    return sorted(out)


def test_decontamination(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdé0") for _ in range(3)) for _ in range(40)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 3, 5, 13, 14, 40]))) for i in range(25)] + [(90, None), (91, ""), (92, "?!"), (None, text(20)), (3, text(15))]
    docs = [(i, text(30) + ", " + (items[i % 25][1] or "").upper().replace(" ", "-") + "\n" + text(rng.randint(0, 60))) for i in range(40)] + [(500, None), (501, ""), (502, "..."), (None, items[4][1]), (40, items[6][1] * 2), (40, items[6][1] * 2), (503, (items[5][1] + " ") * 800)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (1 << 18, 1):  # the smallest filter, far below the data, passes nearly all
        got = decontaminate.contamination(docs_of(spark, docs), bench, max_words=most).collect()
        assert sorted(str((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items"])) for r in got) == brute_hits(docs, items)
    clean = decontaminate.drop_contaminated(docs_of(spark, docs), bench)
    assert clean.columns == docs_of(spark, []).columns and 503 not in {r["doc_id"] for r in clean.collect()}


def test_decontamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.contamination(docs_of(spark, [(1, "a b")]), none).collect()
    assert [(r["n_words"], r["n_hit"], r["n_items"], r["items"]) for r in got] == [(2, 0, 0, [])]
    assert decontaminate.contamination(docs_of(spark, []), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


# 10


def brute_lines(rows, least, min_docs, spare=()):
    count = {}
    keys = lambda t: [line_dedup.line_key(x) for x in (t or "").encode().split(b"\n")]
    for _, t in rows:
        for k in set(keys(t)):
            count[k] = count.get(k, 0) + 1
    out = []
    for i, t in rows:
        lines = (t or "").encode().split(b"\n")
        gone = [len(k.decode()) >= least and count[k] >= min_docs for k in keys(t)]
        kept = b"\n".join(x for x, g in zip(lines, gone, strict=True) if not g)
        out.append(str((i, len(lines), sum(gone), kept.decode())))
    return sorted(out)


@pytest.fixture(scope="module")
def lined():
    rng = random.Random(2)
    lines = ["".join(rng.choice("abé ") for _ in range(rng.randint(0, 9))) for _ in range(40)]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 12)))) for i in range(60)]
    return [*rows, (500, None), (501, ""), (502, "\n\n"), (None, " AB \n\tx"), (503, lines[0] + "\n" + lines[0]), (504, "\r\n".join(lines)), (505, "z\n" * 20000), (7, rows[7][1])]


@pytest.mark.parametrize("least", [1, 3])
def test_line_dedup(spark, lined, least):
    docs = docs_of(spark, lined)
    got = line_dedup.dedup_lines(docs, min_docs=10, min_chars=least)
    assert got.columns == [*docs.columns, "__n_lines", "__n_dropped"]
    assert sorted(str((r["doc_id"], r["__n_lines"], r["__n_dropped"], r["text"])) for r in got.collect()) == brute_lines(lined, least, 10)


def test_line_dedup_many_rounds_and_shards(spark, lined):
    docs = docs_of(spark, lined)
    index = line_dedup.LineIndex.build(docs, min_docs=5, keys_per_shard=4)
    small = line_dedup.LineIndex(index.refs, index.filters, index.n_shards, 5, 1, max_filter_bytes=80)
    got = small.apply(docs).collect()
    assert index.n_shards > 5 and sorted(str((r["doc_id"], r["__n_lines"], r["__n_dropped"], r["text"])) for r in got) == brute_lines(lined, 1, 5)


def test_line_dedup_false_alarms_are_put_right(spark, lined, monkeypatch):
    real = line_dedup.Probe.hits
    monkeypatch.setattr(line_dedup.Probe, "hits", lambda self, keys: real(self, keys) | np.array([k[0] % 3 == 0 for k in keys], bool))
    got = line_dedup.dedup_lines(docs_of(spark, lined), min_docs=10).collect()
    assert sorted(str((r["doc_id"], r["__n_lines"], r["__n_dropped"], r["text"])) for r in got) == brute_lines(lined, 1, 10)


def test_line_dedup_passes_columns_of_any_type(spark, lined):
    docs = spark.createDataFrame([(i, t, {"a": 1}, [1.5]) for i, t in lined], "doc_id long, text string, tags map<string,int>, v array<double>")
    got = line_dedup.dedup_lines(docs, min_docs=10)
    assert sorted(str((r["doc_id"], r["__n_lines"], r["__n_dropped"], r["text"])) for r in got.collect()) == brute_lines(lined, 1, 10)
    assert all(r["tags"] == {"a": 1} for r in got.collect())


def test_line_index_is_reversible(spark, lined):
    a, b = docs_of(spark, lined[:40]), docs_of(spark, lined[40:])
    first = line_dedup.LineIndex.build(a, min_docs=5, keys_per_shard=10)
    both = first.insert(b)
    assert sorted(map(str, both.refs.collect())) == sorted(map(str, line_dedup.LineIndex.build(a.unionByName(b), min_docs=5).refs.collect()))
    got = both.apply(docs_of(spark, lined)).collect()
    assert sorted(str((r["doc_id"], r["__n_lines"], r["__n_dropped"], r["text"])) for r in got) == brute_lines(lined, 1, 5)
    back = both.delete(b)
    assert sorted(map(str, back.refs.collect())) == sorted(map(str, first.refs.collect()))
    texts = lambda index: sorted(str((r["doc_id"], r["text"])) for r in index.apply(a).collect())
    assert texts(back) == texts(first)


def test_shards_split_as_an_index_grows(spark, lined):
    index = line_dedup.LineIndex.build(docs_of(spark, lined[:3]), min_docs=5, keys_per_shard=8)
    grown = index.insert(docs_of(spark, lined[3:]))
    assert grown.n_shards > 2 * index.n_shards and grown.n_shards * 8 >= grown.refs.count()
    got = grown.apply(docs_of(spark, lined)).collect()
    assert sorted(str((r["doc_id"], r["__n_lines"], r["__n_dropped"], r["text"])) for r in got) == brute_lines(lined, 1, 5)


def test_cuckoo_filter():
    rng = np.random.default_rng(0)
    keys = [rng.bytes(16) for _ in range(5000)]
    f = line_dedup.CuckooFilter.loads(line_dedup._filled(keys, 1))
    _, seeds, prints = line_dedup._parts(line_dedup._as_words(keys), 1)
    probe = line_dedup.Probe({0: f.dumps()}, 1)
    assert probe.hits(keys).all() and probe.hits([rng.bytes(16) for _ in range(20000)]).mean() < 0.001
    for s, p in zip(seeds[:2500].tolist(), prints[:2500].tolist(), strict=True):
        assert f.delete(s, p)
    after = line_dedup.Probe({0: f.dumps()}, 1)
    assert after.hits(keys[2500:]).all() and after.hits(keys[:2500]).mean() < 0.01


def test_shard_column_agrees(spark):
    keys = [hashlib.md5(str(i).encode()).digest() for i in range(200)]
    df = spark.createDataFrame([(bytearray(k),) for k in keys], "key binary").select("key", line_dedup._shard(7).alias("s"))
    want, _, _ = line_dedup._parts(line_dedup._as_words(keys), 7)
    got = {bytes(r["key"]): r["s"] for r in df.collect()}
    assert [got[k] for k in keys] == want.tolist()


# all


def test_no_rows(spark):
    import public_tokenizers

    none = docs_of(spark, [])
    assert token_counts.count_tokens(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert exact_dedup.exact_dedup(none).count() == 0
    assert substring_dedup.remove_repeats(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0 and simhash.drop_near_copies(none).count() == 0
    assert line_dedup.dedup_lines(none).count() == 0
