"""Whitening, source mixing and periodic runs against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
import xxhash

from wellspan.llm import mixing, queries, runs, whitening, winnow
from compare import compare

SF_DIR = "/root/testdata/sf0.001"


# --- runs ----------------------------------------------------------------------------------

def plain_runs(w):
    found = set()
    for p in range(1, len(w) // 4 + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i - s + p >= max(6, 4 * p):
                found.add((s, i - s + p, p))
    best = {}
    for s, n, p in found:
        best[s, n] = min(p, best.get((s, n), p))
    return sorted(((s, n, p) for (s, n), p in best.items()), key=lambda r: (r[0], r[2]))


def plain_document(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    top = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    dropped = {i for s, n, p in found for i in range(s + p, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
            sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_cover_reaches_every_difference():
    differences = {(a - b) % runs.V for a in runs.COVER for b in runs.COVER}
    assert differences == set(range(runs.V)) and (runs._SHIFT < runs.V).all()


def test_runs_equal_brute_force():
    rng = random.Random(5)
    for _ in range(150):
        batch = []
        for _ in range(rng.randrange(1, 8)):
            letters = rng.randrange(1, 4)
            words = [rng.randrange(1, letters + 1) for _ in range(rng.randrange(0, 120))]
            if rng.random() < 0.5:
                words += (words[-rng.randrange(1, 12):] or [1]) * rng.randrange(1, 20)
            batch.append(words)
        batch += batch[:rng.randrange(0, 3)]  # copies in one batch
        got = runs.find_runs([np.array(w, np.int64) for w in batch])
        assert [[tuple(r) for r in g.tolist()] for g in got] == [plain_runs(w) for w in batch]


def test_extensions_of_any_two_positions():
    rng = np.random.default_rng(2)
    words = np.concatenate([[90], np.tile(rng.integers(1, 3, 40), 6), [91], rng.integers(1, 3, 150), [92]])
    lengths = runs.Extensions(words)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(words)), np.arange(len(words))))
    i, j = i[i != j], j[i != j]
    got = lengths(i, j)
    for a, b, n in list(zip(i, j, got))[::7]:
        k = 0
        while words[a + k] == words[b + k]:
            k += 1
        assert k == n


def test_many_different_words_need_shorter_keys():
    words = np.concatenate([np.arange(1, 9), [1 << 22] * 9, np.arange(9, 20)])
    assert runs.find_runs([words])[0].tolist() == [[8, 9, 1]]


def test_long_text_in_one_run(spark):
    text = "ab cd ef " * 60_000
    row = runs.with_runs(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert [tuple(r) for r in row["runs"]] == [(0, 180_000, 3)] and row["collapsed"] == "ab cd ef"


def test_run_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    want = sorted(plain_document(r["doc_id"], r["text"]) for r in rows if len(r["text"]) < 30_000)
    got = sorted(tuple(r) for r in runs.op13_periodic_runs(spark, SF_DIR).collect())
    keep = {w[0] for w in want}
    assert [g for g in got if g[0] in keep] == want and len(got) == len(rows)


def test_runs_of_awkward_rows(spark):
    rows = [(None, "a a a a a a a"), (1, None), (2, ""), (3, " \t\n"), (4, "a a a a a"), (5, "x a\ta\na a a a y"), (5, "x a\ta\na a a a y")]
    df = spark.createDataFrame([(*r, 0, "") for r in rows], "doc_id int, text string, runs int, collapsed string")
    got = sorted((str(r["doc_id"]), len(r["runs"]), r["collapsed"]) for r in runs.with_runs(df).collect())
    assert got == sorted([("None", 1, "a"), ("1", 0, ""), ("2", 0, ""), ("3", 0, ""), ("4", 0, "a a a a a"), ("5", 1, "x a y"), ("5", 1, "x a y")])
    assert runs.with_runs(df.limit(0)).count() == 0


# --- mixing --------------------------------------------------------------------------------

def plain_targets(sizes, max_epochs=3):
    """Exact targets by repeated clamping; sources in code point order, None last."""
    names = sorted((n for n in sizes if n is not None)) + [n for n in sizes if n is None]
    weights = {n: 1 + i % 3 for i, n in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        free = [n for n in names if n not in full]
        left = total - sum(max_epochs * sizes[n] for n in full)
        share = {n: Fraction(left * weights[n], sum(weights[m] for m in free)) for n in free}
        over = {n for n in free if share[n] >= max_epochs * sizes[n]}
        if not over:
            return {n: share.get(n, Fraction(max_epochs * sizes[n])) for n in names}
        full |= over


def mix_fixture(spark):
    rng = random.Random(9)
    rows, key = [], 0
    for name, n in [("b", 200), ("a", 3), ("ä", 40), (None, 25), ("", 2), ("Z", 1), ("empty", 3), ("\U0001f600", 30), ("￮", 30)]:
        for _ in range(n):
            words = 0 if name == "empty" else rng.randrange(0, 60)
            rows.append((key, " \t".join(["w"] * words) if words else rng.choice([None, "", "\n"]), name, "clash", -1))
            key += 1
    rows += rows[:20]
    return spark.createDataFrame(rows, "doc_id int, text string, source string, target string, size int")


def test_targets_and_words_taken(spark):
    docs = mix_fixture(spark).withColumn("n", mixing.n_words("text"))
    plain = docs.drop("target")
    found = mixing.taken(plain, "doc_id", "source", "n", [1, 2, 3]).collect()
    sizes, got = defaultdict(int), defaultdict(int)
    for r in found:
        sizes[r["source"]] += r["n"]
        got[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["n"]
        assert r["taken"] == r["copies"] * r["n"] + r["part"]
    want = plain_targets(sizes)
    assert any(want[n] == 3 * sizes[n] for n in sizes if sizes[n]) and any(want[n] < 3 * sizes[n] for n in sizes)
    for r in found:
        assert math.isclose(r["target"], float(want[r["source"]]), rel_tol=1e-12) and r["source_size"] == sizes[r["source"]]
    assert {n: got[n] for n in sizes} == {n: math.floor(want[n] + Fraction(1, 2)) for n in sizes}
    again = mixing.taken(plain.repartition(7), "doc_id", "source", "n", [1, 2, 3]).collect()
    key = lambda r: (r["doc_id"], r["taken"])
    assert sorted(map(key, found)) == sorted(map(key, again))
    other = mixing.taken(plain, "doc_id", "source", "n", [1, 2, 3], seed=8).collect()
    assert sorted(map(key, found)) != sorted(map(key, other))


def test_mix_sql_with_clamped_sources(spark, tmp_path):
    docs = mix_fixture(spark).dropDuplicates(["doc_id"]).select("doc_id", "text", "source")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert compare(mixing.op12_source_mix(spark, str(tmp_path)), con, mixing.OP12_SQL) == []


def test_mixed_corpus_has_the_words_taken(spark):
    docs = mix_fixture(spark)
    out = mixing.mix(docs)
    assert out.columns == [*docs.columns, "copy"]
    count = out.withColumn("n", mixing.n_words("text")).groupBy("source").sum("n").collect()
    sizes = {r["source"]: r["s"] for r in docs.withColumn("n", mixing.n_words("text")).groupBy("source").agg({"n": "sum"}).withColumnRenamed("sum(n)", "s").collect()}
    want = {n: math.floor(t + Fraction(1, 2)) for n, t in plain_targets(sizes).items()}
    assert {r["source"]: r["sum(n)"] for r in count} == {n: t for n, t in want.items() if t}


def test_mix_of_nothing(spark):
    docs = mix_fixture(spark)
    assert mixing.mix(docs.limit(0)).count() == 0
    blank = docs.where("source = 'empty'").withColumn("n", mixing.n_words("text"))
    rows = mixing.taken(blank.drop("target"), "doc_id", "source", "n", [1, 2, 3]).collect()
    assert rows and all(r["target"] == 0 and r["taken"] == 0 for r in rows)


def test_mix_stays_in_the_jvm(spark):
    plan = mixing.op12_source_mix(spark, SF_DIR)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|MapInArrow|ExistingRDD", plan)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_mix_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf{sf}/documents.parquet')")
    assert compare(mixing.op12_source_mix(spark, f"/root/testdata/sf{sf}"), con, mixing.OP12_SQL) == []


def test_numbers_over_ranges(spark):
    names = spark.range(1000).selectExpr("cast(id * 7919 % 1009 as string) AS s")
    got = {r["s"]: r["at"] for r in mixing.numbered(names, ["s"], "at").collect()}
    assert got == {s: i for i, s in enumerate(sorted(got))}


# --- whitening -----------------------------------------------------------------------------

def scatter(x):
    away = x - x.mean(axis=0)
    return away.T @ away


SAMPLES = {
    "plain": lambda g: np.floor(g.normal(size=(400, 24)) * 100) + 1e5,
    "few": lambda g: np.floor(g.normal(size=(9, 24)) * 100),
    "copies": lambda g: np.repeat(np.floor(g.normal(size=(12, 10)) * 100), 30, axis=0),
    "one": lambda g: np.ones((50, 6)),
    "dependent": lambda g: (lambda x: np.column_stack([x, x[:, :3], np.zeros(len(x))]))(np.floor(g.normal(size=(200, 9)) * 100)),
    "graded": lambda g: np.floor(g.normal(size=(300, 16)) * np.logspace(0, 6, 16)),
    "binary": lambda g: (g.random((300, 8)) < 0.5) * 1.0,
    "corners": lambda g: np.vstack([np.eye(8) * 100] * 6),
}


@pytest.mark.parametrize("name", SAMPLES)
def test_rank_one_updates_and_merging(name):
    x = SAMPLES[name](np.random.default_rng(4))
    want = scatter(x)
    parts = []
    for rows in (x, x[: len(x) // 3], x[len(x) // 3:]):
        s = whitening.Spectrum(1, rows[0])
        for row in rows[1:]:
            s.add(row)
        parts.append(s)
    parts[1].merge(parts[2])
    scale = max(np.abs(want).max(), 1e-300)
    for s in parts[:2]:
        assert s.n == len(x) and np.allclose(s.mean, x.mean(axis=0), rtol=1e-12)
        assert np.abs(s.u @ np.diag(s.d) @ s.u.T - want).max() <= 1e-10 * scale
        assert np.abs(s.u.T @ s.u - np.eye(s.u.shape[1])).max(initial=0) < 1e-10
        b = s.basis()
        assert np.abs(b.T @ b - np.eye(len(b))).max() < 1e-12


def test_secular_roots_lie_between_their_poles():
    g = np.random.default_rng(6)
    d = np.sort(g.random(30)) * 100
    z = g.normal(size=30) * np.logspace(-6, 1, 30)
    pole, x = whitening._secular_roots(d, z * z, 3.0)
    want = np.linalg.eigvalsh(np.diag(d) + 3.0 * np.outer(z, z))
    assert np.allclose(d[pole] + x, want, rtol=1e-12)
    assert (d[pole] + x >= d).all() and (d[pole][:-1] + x[:-1] <= d[1:]).all()


def check_whitened(rows, vectors):
    """Against one dense eigendecomposition; components whose eigenvalues stand apart."""
    x = np.floor(np.array([v for _, v in vectors], float) * 1024).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    y = x - s / n
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1], u[:, ::-1]
    by_key = {key: i for i, (key, _) in enumerate(vectors)}
    k = min(8, x.shape[1])
    assert len(rows) == n * k
    got = np.zeros((n, k))
    for r in rows:
        i = by_key[r["vec_id"]]
        assert r["n"] == n and r["deviation"] == sum((n * int(v) - int(t)) ** 2 for v, t in zip(x[i], s))
        assert math.isclose(r["explained"], e[r["component"] - 1] / e.sum(), rel_tol=1e-9) and r["identity_error"] < 1e-9
        got[i, r["component"] - 1] = r["whitened"]
    want = y @ u[:, :k] / np.sqrt(e[:k])
    apart = [c for c in range(k) if min(abs(e[c] - e[d]) for d in range(len(e)) if d != c) > 1e-3 * e[c]]
    assert len(apart) > k // 2
    for c in apart:
        sign = np.sign(want[np.abs(want[:, c]).argmax(), c] * got[np.abs(want[:, c]).argmax(), c])
        assert np.allclose(got[:, c] * sign, want[:, c], atol=1e-8)


def test_whitening_of_the_table(spark):
    table = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()
    check_whitened(whitening.op11_whitening(spark, SF_DIR).collect(), [(r["vec_id"], r["embedding"]) for r in table])


def test_whitening_over_many_partitions_and_awkward_rows(spark):
    g = np.random.default_rng(8)
    good = [(i, [float(np.float32(v)) for v in g.normal(size=10) * np.arange(1, 11)]) for i in range(700)]
    good[300:320] = [(i, good[299][1]) for i in range(300, 320)]
    bad = [(-1, None), (-2, [1.0] * 9 + [None]), (-3, [float("nan")] * 10), (-4, [float("inf")] + [0.0] * 9), (-5, []), (-6, [1.0, 2.0]), (-7, [1e300] * 10)]
    df = spark.createDataFrame([(k, v, "x", 0) for k, v in good + bad], "vec_id bigint, embedding array<double>, whitened string, n int")
    check_whitened(whitening.whitened(df.repartition(37)).collect(), good)


def test_whitening_without_variance_or_rows(spark):
    df = spark.createDataFrame([(i, [0.5, 0.25, float(i % 2)]) for i in range(6)], "vec_id bigint, embedding array<float>")
    rows = whitening.whitened(df).collect()
    assert len(rows) == 18 and {r["whitened"] for r in rows if r["component"] > 1} == {None}
    assert sorted({round(r["whitened"], 9) for r in rows if r["component"] == 1}) == [-1.0, 1.0] and rows[0]["identity_error"] < 1e-9
    single = whitening.whitened(df.limit(1)).collect()
    assert len(single) == 3 and all(r["whitened"] is None and r["deviation"] == 0 and r["explained"] is None for r in single)
    none = whitening.whitened(df.limit(0))
    assert none.count() == 0 and none.columns == whitening.whitened(df).columns
    assert whitening.whitened(df.selectExpr("vec_id", "cast(array() as array<float>) AS embedding")).count() == 0


def test_deviation_beyond_a_long():
    x = np.array([[1 << 39, 0], [0, 0]])
    assert whitening._deviations(x, 2, [1 << 39, 0]) == [None, None]
    assert whitening._deviations(np.array([[3, 1], [1, 1]]), 2, [4, 2]) == [4, 4]


def test_registered():
    assert {"op11_whitening", "op12_source_mix", "op13_periodic_runs"} <= set(queries.QUERIES) and "op12_source_mix" in queries.SQL


# --- fingerprints of edited texts ----------------------------------------------------------

def plain_fingerprint(text):
    """(hash, position) of the chosen grams, from the definition."""
    bare = [c for c in text if c not in winnow.BLANKS]
    h = [_char_hash(c) for c in bare]
    if len(h) < winnow.K:
        grams = [_char_hash(" ".join(bare))] if h else []
    else:
        grams = [sum(v * pow(winnow.BASE, winnow.K - 1 - j, winnow.PRIME) for j, v in enumerate(h[i:i + winnow.K])) % winnow.PRIME for i in range(len(h) - winnow.K + 1)]
    out, w = [], min(winnow.WINDOW, len(grams))
    for i in range(len(grams) - w + 1 if grams else 0):
        at = max(range(i, i + w), key=lambda j: (-grams[j], j))
        if not out or out[-1][1] != at:
            out.append((grams[at], at))
    return out


def _char_hash(text):
    value = xxhash.xxh64_intdigest(text.encode(), seed=42)
    return (value - (1 << 64) if value >> 63 else value) % winnow.PRIME


def test_fingerprint_query_equals_the_plain_version(spark, tmp_path):
    """Seams anywhere: blanks, texts shorter than a gram or a window, empty and null ones, equal neighbours."""
    r = random.Random(3)
    sizes = [0, 1, 5, 11, 12, 13, 20, 33, 34, 35, 36, 40, 60, 68, 69, 70, 71, 90, 150, 260]
    texts = ["".join(r.choice("ab c\n\t😀é") for _ in range(r.choice(sizes))) for _ in range(250)]
    texts[9:12] = ["ab" * 80] * 3
    texts[20] = None
    keys = r.sample(range(-500, 5000), len(texts))
    spark.createDataFrame(list(zip(keys, texts)), "doc_id bigint, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {x["doc_id"]: x for x in winnow.op4_winnow(spark, str(tmp_path)).collect()}
    rows = sorted((k, t or "") for k, t in zip(keys, texts))
    written = lambda found: ",".join(f"{h:x}:{p}" for h, p in found)
    distinct = lambda found: {h for h, _ in found}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    assert len(got) == len(rows)
    for (key, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        own, changed, after = map(plain_fingerprint, (text, edited, following))
        x = got[key]
        assert (x["n_chars"], x["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (x["fingerprint"], x["edited_fingerprint"]) == (written(own), written(changed))
        assert (x["near_edited"], x["near_next"]) == (like(distinct(own), distinct(changed)), like(distinct(own), distinct(after)))


def test_fingerprints_of_other_sizes_equal_the_plain_version(spark, monkeypatch):
    r = random.Random(8)
    rows = [(i, "".join(r.choice("ab c\n\t😀é") for _ in range(r.choice([0, 1, 2, 3, 7, 8, 12, 13, 20, 90])))) for i in range(120)] + [(-1, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    sizes = [(1, 1), (1, 5), (2, 3), (3, 1), (5, 4), (7, 9), (8, 24)]
    got = df.select("text", *[winnow.fingerprint("text", 1, k, w).alias(f"f{k}_{w}") for k, w in sizes]).collect()
    for k, w in sizes:
        monkeypatch.setattr(winnow, "K", k)
        monkeypatch.setattr(winnow, "WINDOW", w)
        for x in got:
            assert [(c >> 32, winnow.LOW - (c & winnow.LOW)) for c in x[f"f{k}_{w}"]] == plain_fingerprint(x["text"] or "")


def test_fingerprint_passes_are_not_copied_by_element(spark):
    """A slice of an array costs as much as a pass, ``translate`` a string for every character."""
    df = spark.createDataFrame([("x",)], "text string").select(winnow.fingerprint("text").alias("f"))
    written = df._jdf.queryExecution().analyzed().expressions().mkString()
    assert written.count("slice(") == 1 and "translate(" not in written and written.count("zip_with(") == 9


def test_next_row_beside_columns_of_the_same_names(spark):
    df = spark.createDataFrame([(i, f"text {i}", "x", "y") for i in range(9)], "doc_id bigint, text string, _range string, _guest string")
    out = winnow.with_next(df, "doc_id", "text", lambda d, next_of: d.withColumn("after", next_of("doc_id")).select("doc_id", "_range", "_guest", "after", *d.columns[-2:]))
    assert {r.doc_id: r.after for r in out.collect()} == {i: (i + 1) % 9 for i in range(9)} and out.columns == ["doc_id", "_range", "_guest", "after"]
    assert {(r._range, r._guest) for r in out.collect()} == {("x", "y")}
