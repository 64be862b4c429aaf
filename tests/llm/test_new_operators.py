"""SimHash, filter audit and spelling variants against brute force, and on odd rows."""

import os
import re
import time
from collections import Counter, defaultdict
from itertools import permutations
from zlib import crc32

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from marketlens.llm import audit, bitmaps, lines, queries, simhash, store, variants

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {k: k + 32 for k in range(65, 91)}
KIND = "doc_id long, text string, lang string, source string, print long, word string, n long, flags int, `a.b` string, `my col` map<string,int>"


def made(spark, rows):
    """Documents (doc_id, text, source) with columns whose names clash, hold dots and spaces, or are maps."""
    return spark.createDataFrame([(i, t, "en", s, 1, "w", 2, 3, "x", {"k": 1}) for i, t, s in rows], KIND)


def sentence(seed, n, size=400):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{k}" for k in rng.integers(0, size, n))


@pytest.fixture(scope="module")
def rows(spark, data):
    return [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def odd():
    base = sentence(2, 90)
    texts = [None, "", " \t\n", "one", "One  two", "one two\nthree", sentence(1, 30_000, 9000), base, base, base + " x", "Ünïcode ÀÿÏ " * 30, "AB#", "\x1f \x85   a b"]
    found = [(i, t, "s" if i % 2 else None) for i, t in enumerate(texts)]
    return [*found, (7, base, "s"), (7, "other text", "t"), (None, base, "t"), (None, "no such text here", "s"), (50, "no such text here", "s")]


def slow_print(text):
    words = [w.translate(LOWER) for w in WORD.findall(text or "")]
    runs = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(prints):
    """The least member of each print's component, by all pairs."""
    some = np.array(sorted(prints), np.uint64)
    of = {int(p): int(p) for p in some}

    def top(x):
        while of[x] != x:
            x = of[x]
        return x

    for p in some:
        for q in some[np.bitwise_count(some ^ p) <= 2]:
            a, b = top(int(p)), top(int(q))
            of[max(a, b)] = min(a, b)
    return {p: top(p) for p in of}


def check_simhash(spark, rows, got):
    prints = [slow_print(t) for _, t, _ in rows]
    group = slow_groups(set(prints))
    least = defaultdict(list)
    for (i, _, _), p in zip(rows, prints, strict=True):
        if i is not None:
            least[group[p]].append(i)
    want = Counter((i, f"{p:016x}", min(least[group[p]], default=None)) for (i, _, _), p in zip(rows, prints, strict=True))
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got.collect()) == want


def test_simhash(spark, data, rows):
    check_simhash(spark, rows, queries.op11_simhash_multi_index(spark, data))


def test_simhash_odd(spark, odd):
    check_simhash(spark, odd, simhash.near_duplicates(made(spark, odd)))
    assert simhash.near_duplicates(made(spark, odd).limit(0)).count() == 0
    long = [sentence(5, 200_000, 90_000), None, "a b", sentence(6, 70_000)]
    assert simhash.fingerprints(pa.array(long)).tolist() == [slow_print(t) for t in long]


@pytest.mark.parametrize("crowd", [0, 4, simhash.CROWD, 10**9])
def test_simhash_links(spark, crowd, monkeypatch):
    """Every way in which two or fewer bits fall on the segments, also within a crowd; components equal those of all pairs."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = np.random.default_rng(3)
    prints = {int(p) for p in rng.integers(0, 1 << 64, 60, dtype=np.uint64)} | {0, (1 << 64) - 1}
    for p in list(prints)[:30]:
        for _ in range(12):
            # up to three bits away: some link, some only through others
            prints.add(p ^ sum({1 << int(b) for b in rng.integers(0, 64, int(rng.integers(1, 4)))}))
    frame = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "print long")
    of = {p: p for p in prints}

    def top(x):
        while of[x] != x:
            x = of[x]
        return x

    for r in simhash.links(frame).collect():
        a, b = (int(np.int64(x).astype(np.uint64)) for x in r)
        assert a != b and (a ^ b).bit_count() <= 2
        x, y = top(a), top(b)
        of[max(x, y)] = min(x, y)
    assert {p: top(p) for p in prints} == slow_groups(prints)


def slow_audit(rows, labels):
    lesser = defaultdict(list)
    for i, t, _ in rows:
        if i is not None:
            lesser[t or ""].append(i)
    by_part = defaultdict(list)
    for i, t, s in rows:
        text = t or ""
        words = WORD.findall(text)
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": i is not None and any(o < i for o in lesser[text]),
        }
        told = [x for x in labels if x[0] == i and i is not None]
        by_part[s or ""].append(({k for k, v in fails.items() if v}, any(q == 1 for _, q, _ in told), any(x == 1 for _, _, x in told)))
    out = {}
    for part, docs in by_part.items():
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                before = len([d for d in docs if f in d[0]]) - len(gone)
                left = [d for d in left if f not in d[0]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), before, sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(shapley[order[step - 1]])
    return out


def as_dict(frame):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    found = frame.collect()
    out = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in names] for r in found}
    assert len(out) == len(found)
    return out


def test_audit(spark, data, rows):
    labels = [tuple(r) for r in spark.read.parquet(f"{data}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    got = queries.op12_filter_audit(spark, data)
    assert as_dict(got) == slow_audit(rows, labels)
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    assert sorted(con.sql(audit.AUDIT_SQL).select(*got.columns).fetchall()) == sorted(map(tuple, got.collect()))


def test_audit_odd(spark, odd):
    labels = [(0, 1, 1), (7, 1, 0), (7, 0, 1), (None, 1, 1), (9, None, 1), (99, 1, 1)]
    told = spark.createDataFrame([(*x, "p") for x in labels], "doc_id long, quality int, toxic int, part string")
    assert as_dict(audit.audited(made(spark, odd), told)) == slow_audit(odd, labels)
    assert as_dict(audit.audited(made(spark, odd), told.limit(0))) == slow_audit(odd, [])
    assert audit.audited(made(spark, odd).limit(0), told).count() == 0
    many = [(i, f"text {i % 40}", f"p{i % 300}") for i in range(1500)]
    assert as_dict(audit.audited(made(spark, many), told.limit(0))) == slow_audit(many, [])


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow_variants(rows):
    counts = Counter()
    for i, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    by_size = defaultdict(list)
    for w in words:
        by_size[len(w)].append(w)
    form, out = {}, {}
    for w, n in words.items():
        some = [v for k in (-1, 0, 1) for v in by_size[len(w) + k] if near(w, v)]
        best = min(some, key=lambda v: (-words[v], v), default=None)
        if best and words[best] >= 2 * n:
            form[w] = best
        out[w] = [form.get(w), None, n, len(some), words[form[w]] if w in form else None]
    for w in out:
        root = w
        while root in form:
            root = form[root]
        out[w][1] = root
    return out


def check_variants(rows, got):
    found = got.collect()
    out = {r["word"]: [r[c] for c in ("form", "root", "n", "n_near", "form_n")] for r in found}
    assert len(out) == len(found) and out == slow_variants(rows)


def test_variants(spark, data, rows):
    few = [(i, t, s) for i, t, s in rows if i % 3 == 0]
    frame = spark.read.parquet(f"{data}/documents.parquet")
    check_variants(few, variants.variants(frame.where("doc_id % 3 = 0")))
    assert queries.op13_spelling_variants(spark, data).count() > 0


def test_variants_odd(spark, odd):
    one = "letter leter lettter lettr aabbc abbbc abbc aabbcc zzzzz zzzz zzzzzz Straße strasse Çedilla çedilla éclair"
    words = [(100 + k, " ".join([one] * (k + 1) + ["letter"] * 40 + ["lettel"] * 15), "s") for k in range(3)]
    chain = [(200 + k, " ".join(w for j in range(6) for w in ["chain" + "abcdef"[: j + 1]] * 3 * 2**j), None) for k in range(2)]
    rows = [*odd, *words, *words[:1], *chain, (None, one, "s"), (None, one, "s"), (300, "word" + "y" * 300 + " x" * 5, "s"), (301, "ñ" * 2000 + "÷×", "t")]
    check_variants(rows, variants.variants(made(spark, rows)))
    assert variants.variants(made(spark, odd).limit(0)).count() == 0


def test_variants_collisions(monkeypatch):
    """Words whose keys all collide are told apart by their texts."""
    rows = [("abcde", 9, 0, 0), ("xabcde", 4, 1, 0), ("abcdf", 5, 2, 4), ("abcde", 9, 2, 4), ("zzzzz", 7, 2, 4), ("qabcd", 3, 1, 1)]
    assert sorted(variants._met(rows)) == [("abcde", 1, 4, "xabcde"), ("abcde", 1, 5, "abcdf"), ("abcdf", 1, 9, "abcde"), ("xabcde", 1, 9, "abcde")]


def _shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f.getName() for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(blocks.getAllFiles()) if f.getName().startswith("shuffle_")}


def test_written_leaves_no_shuffle(spark):
    """A table's shuffle files go once it is written, and the session's settings stay as they were."""
    frame = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    before, held = _shuffle_files(spark), spark.conf.get(store.CLEANUP, None)
    got = store.written(frame)
    for _ in range(50):
        if not (left := _shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(store.CLEANUP, None) == held
    assert {r["k"]: r["n"] for r in got.collect()} == {k: len(range(k, 1000, 7)) for k in range(7)}


def test_pipeline_keeps_one_table(spark, monkeypatch, tmp_path):
    """Documents of earlier stages go when the next stage's are written; the input stays."""
    import corpus_pipeline

    spark.createDataFrame([(k, "x") for k in range(9)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(str(k), lambda _, docs, __: docs) for k in range(4)])
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    before = set(os.listdir(folder))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 9
    assert len(set(os.listdir(folder)) - before) == 1 and spark.read.parquet(f"{tmp_path}/documents.parquet").count() == 9


def test_bitmaps(spark):
    """Every key passes, absent rows are the others, and unlike residues don't pass."""
    keys = [*range(0, 70), 1 << 15, (1 << 15) - 1, -1, -64, (1 << 62) + 5, bitmaps.BITS * 9 + 4095]
    maps = bitmaps.bitmaps(spark.createDataFrame([(k,) for k in keys], "key long"), "key")
    asked = spark.createDataFrame([(k + d,) for k in keys for d in (0, 1, 8, 64, 100_000)], "key long").distinct()
    want = {k % bitmaps.BITS for k in keys}
    there, away = ({r["key"] for r in bitmaps.likely(asked, "key", maps, absent).collect()} for absent in (False, True))
    assert there == {r["key"] for r in asked.collect() if r["key"] % bitmaps.BITS in want} and there.isdisjoint(away) and there | away == {r["key"] for r in asked.collect()}


def test_line_sets_worked_out_once(spark):
    """A line's set is worked out by one step, and its members are dealt by another, which is compiled."""
    rows = spark.createDataFrame([(1, "abcdefghabcdefgh"), (2, "ab")], "node long, line string").select("node", lines._wide("line").alias("wide"))
    members = lines.members_of(rows)
    plan = members._jdf.queryExecution().executedPlan().toString()
    assert plan.count("array_distinct") == 1 and "explode(set" in plan
    assert {r["node"]: r["n"] for r in members.groupBy("node").agg(F.count("*").alias("n")).collect()} == {1: 8, 2: 1}
