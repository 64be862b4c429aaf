"""Fuzzy line dedup by MinHash, with DataFrame operations alone.

A line's set holds all its runs of ``CHARS`` characters, one from every place (a shorter line is a run itself). Two
lines are linked if the Jaccard similarity of their sets is ``PERCENT`` percent or more. Of each connected component of
lines, over the whole table, the first is kept: the least doc_id, then the place in the text. Others are cut out.

* Equal lines are one node, named by a 64-bit hash: among 3e11 distinct lines some 2,400 pairs would share a name.
* Signatures. A run's hash puts it into one of ``GROUPS`` groups, and each group has ``PER_GROUP`` minima, so a run
  takes part in 9 minima and not in 36. Every minimum agrees with the chance of the similarity, as always. Three minima
  are a band, and nodes that agree on a band meet in a bucket. A pair at the threshold meets in none of the 12 with a
  chance of 0.488 ** 12 = 0.02 %, at 90 % with 0.271 ** 12 = 2e-7; unlike lines hardly ever meet.
* Every bucket that holds several components is compared with a hub, one of its nodes, in ``ROUNDS`` rounds with
  another hub each, from the second round on with two nodes of its largest component as well; a bucket of two or three nodes is decided by that. Then the nodes outside a bucket's largest component are compared with all of other components, in
  blocks. Comparisons test ``AGREE`` minima first and then the exact sets, and emit nothing but links between components.

Lookups of keys are cut down by a broadcast bitmap (8 MB at any size, see ``bitmaps``), before the join that decides.

Lines without a word are kept as they are. A null text stays null. Rows with equal doc_id and text count as one document
and are cut alike; a null doc_id comes first. Of equal places in tied lines there are none, as a place is unique. Lines
and texts of any length are read whole. Empty tables give an empty result. Other columns pass through untouched,
whatever their names; ``n_chars`` follows the text if it is there.
"""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.bitmaps import bitmaps as _bitmaps
from marketlens.llm.bitmaps import likely as _likely
from marketlens.llm.components import components
from marketlens.llm.store import dropped, written

PERCENT = 80
CHARS = 8
GROUPS = 4
PER_GROUP = 9
AGREE = 18
PARITY = 16
ROUNDS = 3
BLOCK = 512
WORD = r"[^\x20\x09-\x0D]"


def _masks() -> list[int]:
    """For each minimum of a group: the pattern that hashes are compared with; patterns differ in their first four bits."""
    dice = random.Random(20)
    return [(top << 60 | dice.getrandbits(60)) - (1 << 63) for top in dice.sample(range(16), PER_GROUP)]


MASKS = _masks()


def _wide(line: str) -> Column:
    """A line with four bytes for each character, so that a run is found without reading the line up to it."""
    return F.encode(line, "utf-32")


def _starts(wide: Column) -> Column:
    """Where the runs of a wide line start; a shorter line is one run."""
    return F.sequence(F.lit(1), F.greatest(F.lit(1), F.octet_length(wide) - (4 * CHARS - 1)), F.lit(4))


def _run(wide: Column, at: Column) -> Column:
    return F.xxhash64(F.substring(wide, at, F.lit(4 * CHARS)))


def shingles(wide: str | Column) -> Column:
    """The 64-bit hashes of a wide line's runs; two runs share one with a chance of 5e-20."""
    # in an array of one, as a column's bytes would be copied for every run
    return F.transform(F.array(wide), lambda w: F.transform(_starts(w), lambda at: _run(w, at)))[0]


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, doc (a row's key), pos (from 0), line, node: a row for each line with a word."""
    read = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("doc"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return read.where(F.col("line").rlike(WORD)).withColumn("node", F.xxhash64("line"))


def signatures(docs: DataFrame) -> DataFrame:
    """For each node and group: node, n (its lines), b0, b1, b2 (hashes of its bands), packed (7 bits of each minimum)."""
    # each node's line comes to one place first, so that a frequent line is read once
    lines = _lines(docs).groupBy("node").agg(F.min("line").alias("line"), F.count("*").alias("n"))
    wide = lines.select("node", "n", _wide("line").alias("wide"))
    hashed = wide.select("node", "n", "wide", F.explode(_starts(F.col("wide"))).alias("at")).select("node", "n", _run(F.col("wide"), F.col("at")).alias("h"))
    minima = [F.min(F.col("h").bitwiseXOR(F.lit(m))).alias(f"m{i}") for i, m in enumerate(MASKS)]
    signed = hashed.groupBy("node", F.col("h").bitwiseAND(GROUPS - 1).alias("group")).agg(F.max("n").alias("n"), *minima)
    bands = [F.xxhash64("group", F.lit(k), *[f"m{3 * k + j}" for j in range(3)]).alias(f"b{k}") for k in range(PER_GROUP // 3)]
    packed = reduce(lambda x, y: x.bitwiseOR(y), [F.shiftleft(F.shiftright(f"m{i}", 20).bitwiseAND(127), 7 * i) for i in range(PER_GROUP)])
    return signed.select("node", "n", "group", *bands, packed.alias("packed"))


def _agree(a: str, b: str) -> Column:
    """How many minima agree, of the packed columns of both; a group that both lack agrees."""
    low, high = (sum(bits << 7 * i for i in range(PER_GROUP)) for bits in (63, 64))
    differ = []
    for g in range(GROUPS):
        other = F.col(f"{a}{g}").bitwiseXOR(F.col(f"{b}{g}"))
        # the seventh bit of each minimum that has any bit set; sums stay within their seven bits
        differ.append(F.bit_count((other.bitwiseAND(low) + F.lit(low)).bitwiseOR(other).bitwiseAND(high)))
    return F.lit(GROUPS * PER_GROUP) - reduce(lambda x, y: x + y, differ)


def _similar(a: str, b: str) -> Column:
    """Of lines wide_a and wide_b, whose sets have n_a and n_b members; the sizes are tested first."""
    n_a, n_b, both = F.col(f"n_{a}"), F.col(f"n_{b}"), F.size(F.array_intersect(shingles(f"wide_{a}"), shingles(f"wide_{b}")))
    return (100 * F.least(n_a, n_b) >= PERCENT * F.greatest(n_a, n_b)) & ((100 + PERCENT) * both >= PERCENT * (n_a + n_b))


def members_of(lines: DataFrame) -> DataFrame:
    """lines (node, wide) -> (node, h): a row for each distinct hash of a line's runs."""
    # two steps, as functions with lambdas are not compiled and would take the explosion with them; no set is empty, and
    # a plain explode would have Spark test that below, where every set is worked out once more
    return lines.select("node", F.array_distinct(shingles("wide")).alias("set")).select("node", F.explode_outer("set").alias("h"))


def parities(words: list[str]) -> list[Column]:
    """Aggregates over the distinct hashes h of a set: for each of PARITY * 64 bits, whether an odd number of them falls there."""
    word, bit = F.shiftrightunsigned("h", 40).bitwiseAND(PARITY - 1), F.expr("shiftleft(1L, cast(shiftrightunsigned(h, 32) & 63 as int))")
    return [F.bit_xor(F.when(word == k, bit).otherwise(F.lit(0).cast("long"))).alias(w) for k, w in enumerate(words)]


def _bounded(a: str, b: str) -> Column:
    """Whether the sets may reach the similarity by their parities: a member that one of them lacks turns one bit, so no
    more bits differ than members do. No similar pair is lost."""
    differ = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}{w}").bitwiseXOR(F.col(f"{b}{w}"))) for w in _PARITIES])
    return (100 + PERCENT) * differ <= (100 - PERCENT) * (F.col(f"n_{a}") + F.col(f"n_{b}"))


_PARITIES = [f"p{k}" for k in range(PARITY)]
_SIGNS = [f"s{g}" for g in range(GROUPS)]
_BANDS = [f"t{k}" for k in range(GROUPS * PER_GROUP // 3)]


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b and other columns) whose exact sets reach the similarity. texts: (node, wide, size, s0, ...)."""
    for x in "ab":
        pairs = pairs.join(texts.select(F.col("node").alias(x), F.col("size").alias(f"n_{x}"), *[F.col(s).alias(f"{x}{g}") for g, s in enumerate(_SIGNS)], *[F.col(p).alias(f"{x}{p}") for p in _PARITIES]), x)
    near = (100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")) & (_agree("a", "b") >= AGREE) & _bounded("a", "b")
    pairs = pairs.where(near).drop(*[f"{x}{y}" for x in "ab" for y in [*range(GROUPS), *_PARITIES]])
    for x in "ab":
        pairs = pairs.join(texts.select(F.col("node").alias(x), F.col("wide").alias(f"wide_{x}")), x)
    return pairs.where(_similar("a", "b")).drop("wide_a", "wide_b", "n_a", "n_b")


def _joined(links: DataFrame) -> DataFrame:
    """(component, now): for each component that the links (of_a, of_b) join to others, the one that all of them become."""
    return written(components(links.select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))).select(F.col("node").alias("component"), F.col("component").alias("now")))


def _renamed(placed: DataFrame, now: DataFrame) -> DataFrame:
    return placed.join(now, "component", "left").withColumn("component", F.coalesce("now", "component")).drop("now")


def _mixed(placed: DataFrame, over: int) -> DataFrame:
    """The rows (band, node, component) of buckets that hold several components and more than ``over`` nodes."""
    open_ = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where(f"low < high and n > {over}").select("band")
    return placed.join(open_, "band").select("band", "node", "component")


def _largest_hubs(open_: DataFrame, k: int) -> DataFrame:
    """(band, hub): nodes of each bucket's largest component, others in each bucket and round, as alike buckets share their least node."""
    dice = F.xxhash64("node", "band", F.lit(k))
    ends = open_.groupBy("band", "component").agg(F.count("*").alias("n"), F.min(F.struct(dice, "node"))["node"].alias("x"), F.max(F.struct(dice, "node"))["node"].alias("y"))
    best = ends.groupBy("band").agg(F.max(F.struct("n", "component", "x", "y")).alias("best"))
    return best.select("band", F.explode(F.array("best.x", "best.y")).alias("hub"))


def _across(open_: DataFrame, texts: DataFrame) -> DataFrame:
    """(of_a, of_b): links between components of a bucket, of all its pairs of nodes of different components."""
    sizes = open_.groupBy("band", "component").agg(F.count("*").alias("n"))
    # the largest component's nodes are compared with the others', and these with all
    most = written(sizes.groupBy("band").agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("n")).select("band", "n", F.col("most.component").alias("largest"), (F.col("n") - F.col("most.n")).alias("others")))
    rows = written(open_.join(most, "band").join(texts, "node"))
    at = lambda count: F.expr(f"pmod(xxhash64(node), 1 + {count} div {BLOCK})")
    all_of = lambda count: F.explode(F.expr(f"sequence(0L, {count} div {BLOCK})"))
    side = lambda x: [F.col("node").alias(x), F.col("component").alias(f"of_{x}"), F.col("wide").alias(f"wide_{x}"), F.col("size").alias(f"n_{x}"), *[F.col(s).alias(f"{x}{g}") for g, s in enumerate(_SIGNS)], *[F.col(t).alias(f"{x}{t}") for t in [*_BANDS, *_PARITIES]]]
    left = rows.where("component <> largest").select("band", at("others").alias("i"), all_of("n").alias("j"), *side("a"))
    right = rows.select("band", all_of("others").alias("i"), at("n").alias("j"), *side("b"), (F.col("component") == F.col("largest")).alias("main"))
    # a pair counts in the first of its bands only; if that bucket is open no more, the pair is decided
    first = F.col("band") == F.coalesce(*[F.when(F.col(f"a{t}") == F.col(f"b{t}"), F.col(f"a{t}")) for t in _BANDS])
    near = (F.col("of_a") != F.col("of_b")) & (F.col("main") | (F.col("a") < F.col("b"))) & (_agree("a", "b") >= AGREE) & _bounded("a", "b") & first & _similar("a", "b")
    links = written(left.join(right, ["band", "i", "j"]).where(near).select("of_a", "of_b").distinct())
    dropped(most, rows)
    return links


def line_components(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> (node, component): each line that occurs again or is like another, and its component."""
    signed = written(signatures(docs))
    posted = signed.select("node", F.explode(F.array("b0", "b1", "b2")).alias("band"))
    met = written(posted.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band"))
    members = written(_likely(posted, "band", _bitmaps(met, "band")).join(met, "band").select("band", "node"))

    needed = written(members.select("node").distinct())
    maps = _bitmaps(needed, "node")
    of = lambda g, c: F.max(F.when(F.col("group") == g, F.col(c)))
    bands = [of(k // 3, f"b{k % 3}").alias(t) for k, t in enumerate(_BANDS)]
    packed = _likely(signed, "node", maps).groupBy("node").agg(*[F.coalesce(of(g, "packed"), F.lit(-1)).alias(s) for g, s in enumerate(_SIGNS)], *bands)
    # a line that occurs often is cut down to one a task before the shuffle
    lines = _likely(_lines(docs).select("node", "line"), "node", maps).groupBy("node").agg(F.min("line").alias("line")).join(needed, "node", "left_semi")
    # lines and not their sets are dealt, which are several times as large
    lines = written(lines.select("node", _wide("line").alias("wide")))
    sets = members_of(lines).groupBy("node").agg(F.count("*").cast("int").alias("size"), *parities(_PARITIES))
    texts = written(lines.join(sets, "node").join(packed, "node"))
    again = written(signed.where("n > 1").select("node").distinct())
    dropped(lines, signed, met)

    named = needed.withColumn("component", F.col("node"))
    open_ = members.withColumn("component", F.col("node"))
    for k in range(ROUNDS):
        # the least node, the greatest (then buckets of three are done), and what is least under another mask
        mask = (0, -1, MASKS[2])[k]
        hubs = open_.groupBy("band").agg(F.min(F.col("node").bitwiseXOR(F.lit(mask))).alias("hub")).select("band", F.col("hub").bitwiseXOR(F.lit(mask)).alias("hub"))
        if k:
            hubs = hubs.unionByName(_largest_hubs(open_, k)).distinct()
        pairs = open_.join(hubs, "band").where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"), F.col("component").alias("of_b")).distinct()
        pairs = pairs.join(named.select(F.col("node").alias("a"), F.col("component").alias("of_a")), "a").where("of_a <> of_b")
        now = _joined(verified(pairs, texts))
        named = written(_renamed(named, now))
        open_ = written(_mixed(_renamed(open_, now), min(k + 2, 3)))
        if open_.isEmpty():
            break
    else:
        named = written(_renamed(named, _joined(_across(open_, texts))))
    several = named.groupBy("component").agg(F.count("*").alias("of")).where("of > 1").select("component")
    linked = named.join(several, "component").select("node", "component")
    found = written(again.join(linked, "node", "full").select("node", F.coalesce("component", "node").alias("component")))
    dropped(members, needed, texts, again, named)
    return found


def repeated_lines(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> (doc, cut): for each document that loses lines, their places. doc is xxhash64(doc_id, text)."""
    found = line_components(docs)
    place = ["doc_id", "doc", "pos"]
    seen = _likely(_lines(docs).select(*place, "node"), "node", _bitmaps(found, "node"))
    named = written(seen.join(found, "node").select(*place, "component"))
    first = named.groupBy("component").agg(F.min(F.struct(*place)).alias("first"))
    gone = named.join(first, "component").where("doc <> first.doc or pos <> first.pos")
    return gone.groupBy("doc").agg(F.array_sort(F.collect_set("pos")).alias("cut"))


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs with all their columns, the repeated lines cut out of text, in a struct ``row``; with n_lines (lines with a
    word, before) and n_removed."""
    cut = written(repeated_lines(docs))
    maps = _bitmaps(cut, "doc")
    lines = F.split("row.text", "\n")
    count = F.coalesce(F.size(F.filter(lines, lambda x: x.rlike(WORD))), F.lit(0)).cast("long")
    read = docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id", "text").alias("key"))
    likely = _likely(read, "key", maps).join(cut, F.col("key") == F.col("doc"), "left")
    rest = _likely(read, "key", maps, absent=True).withColumn("cut", F.lit(None).cast("array<int>"))
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col("cut"), i)), "\n")
    text = F.when(F.col("cut").isNull(), F.col("row.text")).otherwise(kept)
    both = likely.select("row", "cut").unionByName(rest.select("row", "cut"))
    both = both.select("row", text.alias("text"), F.when(F.col("row.text").isNull(), F.lit(0).cast("long")).otherwise(count).alias("n_lines"), F.coalesce(F.size("cut"), F.lit(0)).cast("long").alias("n_removed"))
    row = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars")))
    return both.select(row.alias("row"), "n_lines", F.when(F.col("n_removed") > 0, F.col("n_removed")).otherwise(F.lit(0).cast("long")).alias("n_removed"))
