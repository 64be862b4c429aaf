"""The operators against brute force, and on nulls, empty and long texts, repeated rows and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marketlens.llm import bpe, hmm, lines, mainhtml, minhash, mixing, partitions, phrases, preference, quality, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KIND = "doc_id long, text string, lang string, source string, n_chars long, row string, node long, line string, size int"


def made(spark, texts):
    """Documents with a clashing column for each name that the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "r", 1, "l", 2) for i, t in texts], KIND)


def sentence(seed, n, size=400):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{k}" for k in rng.integers(0, size, n))


@pytest.fixture(scope="module")
def odd(spark):
    long = sentence(1, 30_000, 9000)
    return made(spark, [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, long), (6, sentence(2, 90)), (6, sentence(2, 90)), (None, sentence(3, 80)), (8, "a\n\nb\na\nA é ß\n")])


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def test_quality_counts(docs, rows):
    got = {r["doc_id"]: r for r in quality.quality_rules(docs).select("row.doc_id", "*").collect()}
    for i, text in rows:
        words = WORD.findall(text or "")
        seen, dup = set(), 0
        for line in (text or "").split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        grams = Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {k + j for k, g in enumerate(zip(words, words[1:], words[2:], strict=False)) if grams[g] > 1 for j in range(3)}
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), dup, len(covered))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in text or "")
        assert r["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert not (r["base_failed"] and r["kept"])


def test_quality_limits(docs):
    """kept, by brute force: quantiles of the sketch's bins by group, drawn towards the language's and the table's."""
    got = quality.quality_rules(docs, ["doc_id", "lang", "source"]).select("row.*", "*").collect()
    low_end = lambda v: v if v < 1 << quality.BIN_BITS else v >> (s := v.bit_length() - quality.BIN_BITS) << s
    rate = lambda r, a, b, k, off: k * max(r[a] - off, 0) // r[b] if r[b] else 0
    groups = defaultdict(list)
    for r in got:
        for name, made_of in quality.RATES.items():
            assert r[name] == rate(r, *made_of)
            for key in ((r["lang"], r["source"]), (r["lang"],), ()):
                groups[key, name].append(low_end(r[name]))
    cut = lambda values, share: sorted(values)[max(0, -(-len(values) * share // 100) - 1)]
    for r in got:
        inside = True
        for name in quality.RATES:
            at = {}
            for share in (10, 50, 90):
                value = cut(groups[(), name], share)
                for key in ((r["lang"],), (r["lang"], r["source"])):
                    n = len(groups[key, name])
                    value = (cut(groups[key, name], share) * n + quality.PRIOR * value) / (n + quality.PRIOR)
                at[share] = value
            inside &= r[name] <= math.floor(at[90] + quality.REACH * max(at[90] - at[50], 1))
            if name in quality.TWO_SIDED:
                inside &= r[name] >= math.ceil(at[10] - quality.REACH * max(at[50] - at[10], 1))
        assert r["kept"] == (inside and not r["base_failed"])


def test_quality_odd(odd, docs):
    got = quality.quality_rules(odd)
    assert got.count() == odd.count() and got.select("row.*").columns == odd.columns
    assert quality.quality_rules(docs.limit(0)).count() == 0


def test_hmm_base(spark, docs, rows):
    got = {r["doc_id"]: r for r in hmm.scored(spark, docs).collect()}
    lower = lambda t: [w.translate({k: k + 32 for k in range(65, 91)}) for w in WORD.findall(t or "")]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    train = [lower(t) + [None] for i, t in rows if not held(i)]
    counts = Counter(w for t in train for w in t)
    n, v = sum(counts.values()), len(counts)
    for i, text in rows:
        words, r = lower(text) + [None], got[i]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"], r["n_known"]) == (held(i), len(words), n, sum(counts[w] > 0 for w in words))
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), rel_tol=1e-9)
    out = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_hmm_forward_is_exact():
    rng = np.random.default_rng(0)
    model = hmm.Model(np.array([0.2, 0.5, 0.3]), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(7), 3).T)
    texts = [rng.integers(0, 7, n).astype(np.int32) for n in (1, 5, 64, 65, 300)]
    first = np.cumsum([0, *map(len, texts)])
    stretches = hmm.Stretches(np.concatenate(texts), first)
    _, log = stretches.forward(model, *stretches.transfer(model))
    start, moves, by = stretches.expected(model, 7)
    for t, got in zip(texts, log, strict=True):
        now, total = model.start, 0.0
        for x in t:
            now = now @ model.move * model.emit[x]
            total += math.log(now.sum())
            now = now / now.sum()
        assert math.isclose(total, got, rel_tol=1e-9)
    assert np.allclose([start.sum(), moves.sum(), by.sum()], [len(texts), first[-1], first[-1]])
    better = hmm.Model(start / start.sum(), moves / moves.sum(1)[:, None], by / by.sum(0))
    assert stretches.forward(better, *stretches.transfer(better))[1].sum() >= log.sum()


def test_hmm_score(spark, docs, rows):
    """Scores worked out text by text and word by word from the trained model."""
    import pyarrow as pa

    from marketlens.llm.store import written
    from marketlens.llm.words import Words

    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    frame = docs.select("doc_id", held_out.alias("held_out"), "text")
    train = frame.where("not held_out")
    counts = written(hmm.word_counts(train))
    lex, _ = hmm.lexicon(counts, train.count())
    model = hmm.trained(hmm._read(frame.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text"), lex).where("not held_out"), lex)
    count = {r["word"] & (1 << 64) - 1: r["c"] for r in counts.collect()}
    symbol = dict(zip(lex.hashes.tolist(), lex.symbols.tolist(), strict=True))
    got = {r["doc_id"]: r["score"] for r in hmm.scored(spark, docs).collect()}
    for i, text in rows[:60]:
        now, total = model.start, 0.0
        words = WORD.findall(text or "")
        found = Words.of(pa.array(words, pa.large_string())) if words else None
        hashes, endings = (found.hashes(lower=True).tolist(), hmm._endings(found).tolist()) if words else ([], [])
        for h, e in [*zip(hashes, endings, strict=True), (None, None)]:
            s, share = (lex.own, 1.0) if h is None else (symbol.get(h, lex.own + 1 + e), 1.0)
            if h is not None and s > lex.own:
                share = (count[h] + 1 if h in count else lex.unseen[e]) / 10 ** lex.log_share[e]
            now = now @ model.move * model.emit[s] * share
            total += math.log10(now.sum())
            now = now / now.sum()
        assert math.isclose(total, got[i], rel_tol=1e-6), i


def test_hmm_odd(spark, odd):
    assert hmm.scored(spark, odd).count() == odd.count()
    assert hmm.scored(spark, odd.limit(0)).count() == 0


def united(items, linked):
    parent = {x: x for x in items}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return {x: top(x) for x in items}


def test_minhash(docs, rows):
    lower = lambda t: [w.translate({k: k + 32 for k in range(65, 91)}) for w in WORD.findall(t or "")]
    sets = {}
    for i, t in rows:
        w = lower(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    where, linked = defaultdict(list), []
    for i, s in sets.items():
        both = Counter(o for x in s for o in where[x])
        linked += [(i, o) for o, k in both.items() if 100 * k >= 85 * (len(s) + len(sets[o]) - k)]
        for x in s:
            where[x].append(i)
    want = united(sets, linked)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()} == {i: (len(s), want[i], want[i] == i) for i, s in sets.items()}


def test_minhash_blocks(spark, monkeypatch):
    """Long lists in blocks: the same links, and only texts that may have one are dealt."""
    texts = [f"{sentence(7, 60)} {sentence(100 + k // 4, 40)} {sentence(500 + k, 1 + 7 * (k % 2))}" for k in range(120)]
    docs = made(spark, list(enumerate(texts)))
    found = lambda: {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()}
    want = found()
    assert 1 < len(set(want.values())) < 120
    monkeypatch.setattr(minhash, "SMALL_LIST", 1)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    assert found() == want
    sign = np.arange(5 * 64).reshape(5, 64).astype(np.int8)
    sign[3:, :] = sign[0]
    sign[4, :] = sign[1]
    columns = {"list": [1] * 5, "i": [0] * 5, "j": [0] * 5, "left": [True] * 5, "node": range(5), "component": [0, 1, 2, 3, 1], "size": [9] * 5}
    rows = pa.table({**{k: pa.array(v) for k, v in columns.items()}, "sign": pa.array(list(sign), pa.list_(pa.int8()))})
    dealt = [x for b in minhash._apart(iter(rows.to_batches())) for x in b.column("node").to_pylist()]
    assert dealt == [0, 3]  # 1 and 4 are of one component, 2 is like none


def test_minhash_sign_blocks(spark, monkeypatch):
    """Rows without texts are in few blocks, as each is dealt once for every block of its list; however they are cut, links are the same."""
    rows = spark.range(5000).select(F.lit(7).cast("long").alias("list"), F.col("id").alias("node"), F.lit(1).cast("long").alias("bytes"))
    assert minhash._dealt(rows, f"count(*) div {minhash.SIGN_BLOCK}", 4).count() == 5000
    assert minhash._dealt(rows, "count(*) div 1000", 4).count() == 30000
    docs = made(spark, [(k, f"{sentence(7, 60)} {sentence(100 + k // 4, 40)} {sentence(500 + k, 1 + 7 * (k % 2))}") for k in range(60)])
    found = lambda: {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()}
    want = found()
    for name, n in (("SMALL_LIST", 1), ("SIGN_BLOCK", 16), ("PAIRS", 128)):
        monkeypatch.setattr(minhash, name, n)
    assert found() == want and 1 < len(set(want.values())) < 60


def test_minhash_first_list():
    """Of a long list only rows are dealt with their texts that meet a row of another component there for the first time."""
    sign = np.arange(4 * 64).reshape(4, 64).astype(np.int32)
    sign[1, :50] = sign[0, :50]  # agree from coordinate 0 on
    sign[3, 2:50] = sign[2, 2:50]  # agree from coordinate 2 on
    for members, k, want in (([0, 1], 0, [0, 1]), ([0, 1], 1, []), ([2, 3], 2, [2, 3]), ([2, 3], 3, [])):
        rows = pa.table({"list": [k << 32 | 7] * 2, "i": [0] * 2, "j": [0] * 2, "left": [True] * 2, "node": members, "component": members, "size": [9] * 2, "sign": pa.array(list(sign[members]), pa.list_(pa.int32()))})
        assert [x for b in minhash._apart(iter(rows.to_batches())) for x in b.column("node").to_pylist()] == want, k


def test_minhash_odd(odd):
    got = [tuple(r) for r in minhash.near_duplicates(odd).select("doc_id", "component_id", "kept").collect()]
    assert len(got) == odd.count() and {(1, 1, True), (2, 2, True), (6, 6, True), (None, None, True)} <= set(got)
    assert minhash.near_duplicates(odd.limit(0)).count() == 0


def test_minhash_repeated_ids(spark):
    a, b = sentence(21, 60), sentence(22, 60)
    got = minhash.near_duplicates(made(spark, [(6, a), (6, b), (7, b), (8, b + " more"), (9, a.upper())])).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got) == [(6, 6, True), (6, 6, True), (7, 6, False), (8, 6, False), (9, 6, False)]


def test_bpe(odd, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_padding()
    library.no_truncation()
    for frame in (docs, odd.withColumn("text", F.concat("text", F.lit(" It's 12 ÀÉ ΣΑΣ 漢字 <|endoftext|> x́ 🙂")))):
        for r in bpe.encoded(frame.withColumn("whole", F.col("text")), "word_bpe_49k.json", ["whole"]).collect():
            want = library.encode(r["row"]["whole"] or "", add_special_tokens=False).ids
            assert r["ids"] == want and r["decoded"] == library.decode(want, skip_special_tokens=False)
    assert bpe.encoded(odd.limit(0), "word_bpe_49k.json", ["doc_id"]).count() == 0


def brute_nearest(ids, vectors, i, k):
    far = np.sqrt(((vectors - vectors[i]) ** 2).sum(1))
    far[i] = np.inf
    order = np.lexsort((ids, far))[:k]
    return [(int(ids[j]), far[j]) for j in order if np.isfinite(far[j])]


@pytest.mark.parametrize("small", [64, 1 << 40])
def test_nearest(spark, data, small, monkeypatch):
    monkeypatch.setattr(partitions, "SMALL", small)
    frame = spark.read.parquet(f"{data}/embeddings.parquet")
    all_rows = frame.collect()
    ids, vectors = np.array([r["vec_id"] for r in all_rows]), np.array([r["embedding"] for r in all_rows], float)
    got = defaultdict(list)
    for r in partitions.nearest(frame, frame.where("vec_id % 10 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hit = total = 0
    for i in np.flatnonzero(ids % 10 == 0):
        want = brute_nearest(ids, vectors, i, 10)
        found = got[int(ids[i])]
        hit, total = hit + len({x for x, _ in want} & {x for x, _ in found}), total + len(want)
        assert len(found) == 10 and (small == 64 or found == want)
    assert hit >= 0.9 * total


def test_nearest_odd(spark):
    nan = float("nan")
    frame = spark.createDataFrame([(100, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (4, [0.0, 1.0]), (4, [0.0, 1.0]), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, None), (8, [None, 1.0]), (None, [1.0, 1.0]), (9, [1.0])], "vec_id long, embedding array<float>")
    got = [(r["rank"], r["vec_id"]) for r in partitions.nearest(frame, frame.where("vec_id = 100")).orderBy("rank").collect()]
    assert got == [(1, 2), (2, 3), (3, 4)]
    assert partitions.nearest(frame.limit(0), frame).count() == 0


def test_mix(docs, rows, odd):
    got = mixing.taken(*mixing.mix_sources(docs)).collect()
    assert len(got) == len(rows)
    total = sum(r["size"] for r in got)
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    targets = {source[r["doc_id"]]: r["target"] for r in got}
    assert math.isclose(sum(targets.values()), total, rel_tol=1e-9)
    for name, target in targets.items():
        took = sum(r["taken"] for r in got if source[r["doc_id"]] == name)
        assert abs(took - target) <= 2 + 0.02 * target
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.taken(*mixing.mix_sources(docs)).collect()))
    assert mixing.taken(*mixing.mix_sources(odd)).count() == odd.count()
    words = sum(len(WORD.findall(r["text"])) for r in mixing.mixed_documents(docs).collect())
    assert words == sum(r["taken"] for r in got)


def test_mix_targets(docs):
    """Targets by filling up from the level: each source's weight times a level, three times its size at most."""
    got = mixing.taken(*mixing.mix_sources(docs.unionByName(docs.limit(3).withColumn("source", F.lit(None).cast("string"))))).collect()
    names = {}
    for r in docs.unionByName(docs.limit(3).withColumn("source", F.lit(None).cast("string"))).collect():
        names[r["source"]] = names.get(r["source"], 0) + len(WORD.findall(r["text"] or ""))
    order = sorted(names, key=lambda n: (n is None, (n or "").encode("utf-32-be")))
    weight, total = {n: 1 + i % 3 for i, n in enumerate(order)}, sum(names.values())
    target, open_ = dict.fromkeys(order, 0.0), set(order)
    while open_:
        level = (total - sum(target[n] for n in order if n not in open_)) / sum(weight[n] for n in open_)
        full = {n for n in open_ if weight[n] * level > 3 * names[n]}
        target |= {n: 3.0 * names[n] if n in full else weight[n] * level for n in open_}
        if not full:
            break
        open_ -= full
    want = sorted((names[n], round(target[n], 6)) for n in order)
    assert sorted({(r["source_size"], round(r["target"], 6)) for r in got}) == sorted(set(want))


def test_mix_repeated_rows(spark):
    text = sentence(31, 40)
    rows = [(1, text, "en", "a"), (1, text, "de", "b"), (1, text, "de", "b"), (None, text, "en", "a"), (None, None, "en", "a"), (2, "", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = [tuple(r) for r in mixing.mixed_documents(docs).collect()]
    words = sum(len(WORD.findall(r[1])) for r in out)
    assert words == sum(r["taken"] for r in mixing.taken(*mixing.mix_sources(docs)).collect()) and {r[2:] for r in out} <= {("en", "a"), ("de", "b")}
    assert sorted(out, key=str) == sorted((tuple(r) for r in mixing.mixed_documents(docs).collect()), key=str)
    assert mixing.mixed_documents(docs.limit(0)).count() == 0


def brute_repeats(rows, width=35):
    where = defaultdict(list)
    words = {k: WORD.findall(t or "") for k, (_, t) in enumerate(rows)}
    for k, w in words.items():
        for j in range(len(w) - width + 1):
            where[hash(tuple(w[j : j + width]))].append((k, j))
    gone = defaultdict(set)
    for places in where.values():
        if len(places) > 1:
            for k, j in places:
                gone[k].update(range(j, j + width))
    return [(rows[k][0], len(w), len(gone[k]), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone[k]).encode()).hexdigest()) for k, w in words.items()]


def test_phrases(docs, rows, odd):
    order = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(map(tuple, phrases.without_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())) == sorted(brute_repeats(rows))
    some = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sorted(map(tuple, phrases.without_repeats(odd).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=order) == sorted(brute_repeats(some), key=order)


def kept_lines(texts):
    """The texts without repeated lines, by brute force: sets of the runs of 8 characters from every place."""
    all_lines = [(i, k, x) for i, t in texts for k, x in enumerate((t or "").split("\n")) if WORD.search(x)]
    sets = {x: {x[k : k + 8] for k in range(max(1, len(x) - 7))} for _, _, x in all_lines}
    where, linked = defaultdict(list), []
    for x, s in sets.items():
        both = Counter(o for p in s for o in where[p])
        linked += [(x, o) for o, k in both.items() if 100 * k >= 80 * (len(s) + len(sets[o]) - k)]
        for p in s:
            where[p].append(x)
    group, first = united(sets, linked), {}
    for i, k, x in all_lines:
        first[group[x]] = min(first.get(group[x], (i, k)), (i, k))
    gone = {(i, k) for i, k, x in all_lines if first[group[x]] != (i, k)}
    return {i: t and "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in texts}


def test_lines_every_place(spark, docs, rows):
    path = "https://example.org/archive/of/the/very/long/reports/in/one/place/" + "segment-" * 12
    asian = "".join(chr(0x4E00 + int(k)) for k in np.random.default_rng(4).integers(0, 3000, 120))
    texts = [(1, "https://example.org/a/report-of-one\nhttps://other.example.net/b/quite-different"), (2, f"{asian[:60]}\n{asian[:8]}{asian[60:]}"), (3, f"{path}2024\n{path}2025"), (4, f"x{asian}\nThatshat ndti.\nThatshat$$$ ndti."), (5, f"short\nshort\n\U0001f600{asian}")]
    got = {r["doc_id"]: r["text"] for r in lines.without_repeated_lines(made(spark, texts)).select("row.*").collect()}
    assert got == kept_lines(texts)
    assert got[1] == texts[0][1] and got[2] == texts[1][1] and got[3] == f"{path}2024" and got[5] == "short"
    assert {r["doc_id"]: r["text"] for r in lines.without_repeated_lines(docs).select("row.*").collect()} == kept_lines(rows)


def test_lines_at_threshold(spark):
    rng = np.random.default_rng(6)
    letters = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    pairs = [(x := letters(400), x[:357] + letters(43)) for _ in range(1500)]
    size = lambda x: {x[k : k + 8] for k in range(393)}
    assert all(0.8 <= len(size(x) & size(y)) / len(size(x) | size(y)) < 0.82 for x, y in pairs)
    got = lines.without_repeated_lines(made(spark, [(k, "\n".join(p)) for k, p in enumerate(pairs)]))
    assert [r["n_removed"] for r in got.select("n_removed").collect()] == [1] * len(pairs)


def test_lines_bounded(spark):
    """The bound by parities loses no similar pair and lets few unlike ones through."""
    rng = np.random.default_rng(8)
    letters = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    pairs = [(k, "ab"[i], y) for k in range(300) for x in [letters(300)] for i, y in enumerate((x, x[: 300 - k // 3] + letters(k // 3)))]
    rows = spark.createDataFrame(pairs, "k int, side string, line string").select("k", "side", F.explode(F.array_distinct(lines.shingles(lines._wide("line")))).alias("h"))
    sets = rows.groupBy("k", "side").agg(F.count("*").alias("n"), *lines.parities(lines._PARITIES))
    side = lambda x: sets.where(f"side = '{x}'").select("k", F.col("n").alias(f"n_{x}"), *[F.col(p).alias(f"{x}{p}") for p in lines._PARITIES])
    got = {r["k"]: r["fits"] for r in side("a").join(side("b"), "k").select("k", lines._bounded("a", "b").alias("fits")).collect()}
    size = lambda x: {x[j : j + 8] for j in range(293)}
    like = {k: len(size(x) & size(y)) / len(size(x) | size(y)) for (k, _, x), (_, _, y) in zip(pairs[::2], pairs[1::2], strict=True)}
    assert all(got[k] for k in like if like[k] >= 0.8) and not any(got[k] for k in like if like[k] < 0.7)


def test_lines_hubs(spark):
    """Buckets of the same nodes get hubs of their own, so that a large group is not compared with one hub only."""
    open_ = spark.createDataFrame([(band, node, node // 100) for band in range(20) for node in range(150)], "band long, node long, component long")
    hubs = lines._largest_hubs(open_, 1).collect()
    assert {r["hub"] // 100 for r in hubs} == {0} and len({r["hub"] for r in hubs}) > 20 and len(hubs) == 40


def test_lines_odd(odd):
    got = lines.without_repeated_lines(odd)
    assert got.select("row.*").columns == odd.columns and got.count() == odd.count()
    text = {r["doc_id"]: r["text"] for r in got.select("row.*").collect()}
    assert text[1] is None and text[2] == "" and text[8] == "a\n\nb\nA é ß\n"
    assert lines.without_repeated_lines(odd.limit(0)).count() == 0


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=/x>Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<article><header><h1>Head &amp; line</h1></header><p>First   paragraph\nwith <b>bold</b> words.<div class="ad">Buy now</div><p>Short.</p><aside>Side</aside><p>Last&nbsp;one with enough words.</p><footer>Shared 3 times</footer></article>
<section id="comments"><article><p>A reader's comment of some length, longer than it should be.</p></article></section><form><p>Subscribe here</p></form><footer>Copyright</footer><script>var x = "</p>";</script>"""


def test_html(spark):
    assert mainhtml.main_text(PAGE) == "Head & line\nFirst paragraph with bold words.\nShort.\nLast one with enough words."
    plain = "<body><ul><li><a href=1>Home</a><li><a href=2>News</a></ul>" + "".join(f"<p>Paragraph {k} has a good many words in it, more than a menu has.</p>" for k in range(9)) + "<div><ul><li><a href=3>More</a></ul></div>"
    assert mainhtml.main_text(plain).count("\n") == 8
    assert [mainhtml.main_text(x) for x in (None, "", "<p>", "<article>a < b</article>")] == ["", "", "", "a < b"]
    frame = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x")], "page_id long, url string, html string, text string")
    assert [len(r["text"]) for r in mainhtml.extracted(frame, ["page_id", "text"]).orderBy("row.page_id").collect()] == [len(mainhtml.main_text(PAGE)), 0]


def test_html_distribution(spark, data):
    text = [f"Paragraph {k} has a good many words in it, more than any menu line would have, and so it goes on for a while." for k in range(6)]
    page = "<p>Home</p><p>News</p><p>Sport</p><h1>Title</h1>" + "".join(f"<p>{x}</p>" for x in text) + "<p>Short.</p><p>Contact</p><p>About</p><p>Imprint</p>"
    assert mainhtml.main_text(page) == "\n".join(["Title", *text, "Short."])
    long = [c * 600 for c in "xyz"]
    tail = "last " * 59 + "one"
    page = f"<body class='content has-sidebar'>{''.join(f'<p>{x}</p>' for x in long)}<div class=ad>Buy</div><p>{tail}</p><div>Some Street 5</div><div class=comments><p>{'comment ' * 90}</p></div>"
    assert mainhtml.main_text(page) == "\n".join([*long, tail])
    huge = "<article>" + "".join(f"<p>{k} {text[0]}</p>" for k in range(40_000)) + "</article>"
    assert mainhtml.main_text(huge).count("\n") == 39_999
    # where pages lose their article tags, the distribution alone finds nearly all of the same texts
    pages = [r["html"] or "" for r in spark.read.parquet(f"{data}/pages.parquet").collect()]
    plain = [re.sub(r"(</?)(?:article|main)\b", r"\1div", x) for x in pages]
    assert sum(mainhtml.main_text(x) == mainhtml.main_text(y) for x, y in zip(pages, plain, strict=True)) >= 0.9 * len(pages)
    frame = spark.createDataFrame([(1, "u", page, "x"), (1, "u", page, "x")], "page_id long, url string, html string, text string")
    assert [r["text"] for r in mainhtml.extracted(frame, ["page_id", "url", "html", "text"]).collect()] == [mainhtml.main_text(page)] * 2
    assert mainhtml.extracted(frame.limit(0), ["page_id"]).count() == 0


def test_preference(spark, data):
    turns = lambda rows: spark.createDataFrame(rows, "pair long, turn long, role string, text string")
    one = turns([(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", None), (3, 0, "user", "only"), (None, 0, "user", "x")])
    two = turns([(1, 0, "user", "hi"), (1, 1, "assistant", "no"), (2, 0, "user", None)])
    got = {r["pair"]: r for r in preference.preference_examples(one, two).collect()}
    assert got[1]["prompt"] == "<|user|>\nhi\n" and got[1]["chosen"] == "<|assistant|>\nyes\n" and got[1]["rejected"] == "<|assistant|>\nno\n"
    assert got[1]["chosen"][slice(*map(int, got[1]["chosen_mask"].split("-")))] == "yes"
    assert (got[2]["n_common"], got[2]["chosen"], got[2]["rejected"]) == (1, "", "") and got[3]["rejected"] == "" and len(got) == 3
    assert preference.preference_examples(one.limit(0), two.limit(0)).count() == 0
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{data}/conversations.parquet'")
    mine = queries.op10_preference(spark, data)
    theirs = con.sql(preference.PREFERENCE_SQL).select(*mine.columns).fetchall()
    assert sorted(map(tuple, mine.collect())) == sorted(theirs)


def test_pipeline_near_dedup(spark):
    import corpus_pipeline

    words = sentence(11, 300).split()
    near = " ".join([*words[:-1], "other"])
    texts = [(1, " ".join(words)), (2, near), (2, sentence(12, 90)), (3, sentence(13, 90)), (3, sentence(13, 90)), (4, ""), (None, near), (5, None), (0, sentence(14, 60)), (9, sentence(14, 60))]
    docs = made(spark, texts)
    got = corpus_pipeline.near_dedup(spark, docs, "")
    order = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    # the near copy and the repeated rows go, and nothing else of their doc_id
    want = [x for k, x in enumerate(texts) if k not in (1, 4, 9)]
    assert got.columns == docs.columns and sorted((tuple(r)[:2] for r in got.collect()), key=order) == sorted(want, key=order)


def test_pipeline(spark, data):
    """run()'s rows, with the first three stages and the encoding by brute force, and the mix by its words taken."""
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    kept = {r["doc_id"] for r in quality.quality_rules(docs, ["doc_id"]).where("kept").select("row.doc_id").collect()}
    texts = [(i, rows[i]["text"]) for i in sorted(kept)]
    full = lambda t: [x for x in t.split("\n") if WORD.search(x)]
    left = {i: t for i, t in kept_lines(texts).items() if full(t) or not full(rows[i]["text"])}
    lower = lambda t: [w.translate({k: k + 32 for k in range(65, 91)}) for w in WORD.findall(t or "")]
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()) for i, w in ((i, lower(t)) for i, t in left.items())}
    where, linked = defaultdict(list), []
    for i, s in sets.items():
        both = Counter(o for x in s for o in where[x])
        linked += [(i, o) for o, k in both.items() if 100 * k >= 85 * (len(s) + len(sets[o]) - k)]
        for x in s:
            where[x].append(i)
    group = united(sets, linked)
    left = {i: t for i, t in left.items() if group[i] == i}

    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "line dedup", "near dedup", "source mix", "encoding"]
    frame = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        frame = corpus_pipeline.written(stage(spark, frame, data))
        assert frame.columns == docs.columns, name
    assert {r["doc_id"]: r["text"] for r in frame.collect()} == left and all(r["n_chars"] == len(left[r["doc_id"]]) for r in frame.collect() if left[r["doc_id"]] != rows[r["doc_id"]]["text"])

    mixed = corpus_pipeline.written(corpus_pipeline.source_mix(spark, frame, data))
    assert mixed.columns == docs.columns
    took = defaultdict(int)
    for r in mixed.collect():
        words = WORD.findall(r["text"])
        assert words == WORD.findall(left[r["doc_id"]])[: len(words)]
        took[r["doc_id"]] += len(words)
    assert took == {r["doc_id"]: r["taken"] for r in mixing.taken(*mixing.mix_sources(frame)).collect() if r["taken"]}

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_padding()
    library.no_truncation()
    want = Counter()
    for r in mixed.collect():
        ids = library.encode(r["text"], add_special_tokens=False).ids
        want[r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, data).collect()) == want


def test_pipeline_odd(spark, odd):
    import corpus_pipeline

    for rows in (odd, odd.limit(0)):
        frame = rows
        for name, stage in corpus_pipeline.STAGES[:-1]:
            frame = corpus_pipeline.written(stage(spark, frame, ""))
            assert frame.columns == odd.columns, name
        assert corpus_pipeline.encoding(spark, frame, "").count() == frame.count()
