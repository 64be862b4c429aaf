"""Which companies join the watchlist: names found in headlines and screened peers, tested one after another.

The order of the queue decides, as every company that joins changes what the next one is measured against. But only
``cap`` companies may join in a run, and between two of them nothing changes. So each round asks one question of all
candidates at once, the first in the queue that the present list would take, which is a top-1 by partition; after the
last round every candidate is judged, in one join, by the list as it stood at its place in the queue. The driver holds
the rows of those who joined, ``cap`` at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from marketlens.session import with_checkpoints

# fixed values: how many may join in a run, how many a sector holds, and the growth that is asked for
CAP = 3
ROOM = 5
LEAST_QOQ = 15.0
ASSUMED_TARGET = 1.25
# fixed values: patterns of names, and words that are in no company's name
WITH_SUFFIX = r"\b([A-Z][a-zA-Z0-9]+(?:\s+[A-Z][a-zA-Z0-9]+)*)\s+(?:Ltd|Limited|Corp|Corporation|Technologies|Enterprises|Solutions|Infrastructure)\b"
WITH_VERB = r"\b([A-Z][A-Za-z0-9&]+(?:\s+[A-Z][A-Za-z0-9&]+){0,2})\s+(?:[Ww]ins|[Bb]ags|[Ss]ecures|[Ll]aunches|[Uu]nveils|[Aa]cquires|[Pp]artners|[Cc]ommissions|[Ee]xpands)\b"
NO_NAMES = (
    "india", "delhi", "mumbai", "pib", "union", "minister", "cabinet", "government", "ministry", "national", "state", "budget", "digital", "system", "centre", "center", "sebi", "rbi", "nse", "bse",
    "parliament", "supreme", "court", "railways", "shri", "smt", "sri", "dr", "pm", "cm",
)


def known_names(companies: DataFrame) -> DataFrame:
    """companies (ticker, name) -> known: tickers, names, and the words of names that are longer than three letters, in lower case."""
    name = F.coalesce("name", F.lit(""))
    parts = F.filter(F.split(name, r"\s+"), lambda x: F.char_length(x) > 3)
    return companies.select(F.explode(F.concat(F.array("ticker", name), parts)).alias("known")).select(F.lower("known").alias("known")).where("known <> ''").distinct()


def emerging(titles: DataFrame, companies: DataFrame) -> DataFrame:
    """titles (sector, id, title) -> sector, name, id: companies that headlines tell of and nobody follows, with their first headline.

    A name stands before a company's suffix, which belongs to it, or before a verb of business. Each counts once a sector.
    """
    def found(pattern: str, whole: int) -> Column:
        part = lambda k: F.regexp_extract_all("title", F.lit(pattern), F.lit(k))
        return F.transform(F.arrays_zip(part(1).alias("word"), part(whole).alias("name")), lambda x: F.struct(x["word"].alias("word"), x["name"].alias("name")))

    rows = titles.select("sector", "id", F.posexplode(F.concat(found(WITH_SUFFIX, 0), found(WITH_VERB, 1))).alias("k", "x")).select("sector", "id", "k", F.lower("x.word").alias("known"), "x.name")
    fine = (F.char_length("known") >= 3) & ~F.arrays_overlap(F.split("known", r"\s+"), F.array(*[F.lit(w) for w in NO_NAMES]))
    new = rows.where(fine).join(known_names(companies), "known", "left_anti")
    return new.groupBy("sector", "name").agg(F.min(F.struct("id", "k")).alias("first")).select("sector", "name", "first.id", F.col("first.k").alias("k"))


def queue(names: DataFrame, screened: DataFrame, symbols: DataFrame, quotes: DataFrame, isins: DataFrame, holdings: DataFrame) -> DataFrame:
    """All candidates with their place in the queue and what is known of them.

    names: emerging(). screened: (sector, name, ticker, growth_pct, ord). symbols: (name, ticker). quotes: (ticker, price,
    target_mean, revenue_growth, qoq). isins: (ticker, isin). holdings: (sector, ord, ticker, isin, potential).

    Names from headlines come first, by sector and headline; then peers, the fastest first, then by sector and their own
    order. A peer whose name a headline of its sector told is not tested again. Sectors that hold nothing have no queue.
    """
    place = lambda kind, growth, ord_, k: F.struct(F.lit(kind).alias("kind"), growth.cast("double").alias("behind"), F.col("sector"), ord_.cast("long").alias("ord"), k.cast("int").alias("k"), F.col("name"))
    told = names.join(symbols.select(F.col("name"), F.col("ticker")), "name", "left").select("sector", "name", "ticker", place(0, F.lit(0.0), F.col("id"), F.col("k")).alias("place"))
    asked = names.select("sector", F.lower("name").alias("low")).distinct()
    name = F.coalesce("name", F.lit(""))
    peers = screened.withColumns({"name": name, "low": F.lower(name)}).join(asked, ["sector", "low"], "left_anti")
    peers = peers.select("sector", "name", "ticker", place(1, -F.coalesce("growth_pct", F.lit(0.0)), F.col("ord"), F.lit(0)).alias("place"))
    rows = told.unionByName(peers).withColumn("ticker", F.nullif("ticker", F.lit(""))).join(holdings.select("sector").distinct(), "sector", "left_semi")
    target = F.when(F.col("target_mean") > 0, F.col("target_mean")).otherwise(F.col("price") * ASSUMED_TARGET)
    priced = quotes.where("price > 0").select("ticker", ((target - F.col("price")) / F.col("price") * 100).alias("growth"), "revenue_growth", F.coalesce("qoq", F.lit(0.0)).alias("qoq"))
    same = holdings.where("isin is not null").groupBy("isin").agg(F.min_by(F.struct(F.col("ticker").alias("ticker"), F.col("sector").alias("sector")), F.struct("sector", "ord")).alias("twin"))
    held = holdings.select("ticker").distinct().withColumn("held", F.lit(True))
    both = rows.join(priced, "ticker", "left").join(isins, "ticker", "left").join(same, "isin", "left").join(held, "ticker", "left")
    fine = (F.col("growth") > 0) & ~F.coalesce(F.col("revenue_growth") < 0, F.lit(False)) & (F.col("qoq") >= LEAST_QOQ)
    twin = F.when(F.col("twin.ticker") != F.col("ticker"), F.col("twin"))
    return both.withColumns({"held": F.coalesce("held", F.lit(False)), "twin": twin, "eligible": F.coalesce(fine, F.lit(False))})


def _holdings_after(holdings: DataFrame, joined: list[Row]) -> DataFrame:
    """The list after some have joined, the last at the end; whom they replaced is gone from the sector."""
    rows = holdings.select("sector", F.col("ord").cast("long").alias("ord"), "ticker", F.coalesce(F.col("potential").cast("double"), F.lit(0.0)).alias("potential"))
    for i, x in enumerate(joined):
        if x["weakest"] is not None:
            rows = rows.where((F.col("sector") != x["sector"]) | (F.col("ticker") != x["weakest"]))
        new = [(x["sector"], (1 << 62) + i, x["ticker"], float(f"{x['growth']:.1f}"))]
        rows = rows.unionByName(rows.sparkSession.createDataFrame(new, "sector string, ord long, ticker string, potential double"))
    return rows


def _state(holdings: DataFrame, joined: list[Row]) -> DataFrame:
    """sector, n, weakest, least: how many it holds, and which of them promises least, the first of equals."""
    least = F.min_by(F.struct("ticker", "potential"), F.struct("potential", "ord"))
    return _holdings_after(holdings, joined).groupBy("sector").agg(F.count("*").alias("n"), least.alias("w")).select("sector", "n", F.col("w.ticker").alias("weakest"), F.col("w.potential").alias("least"))


def _held(joined: list[Row]) -> Column:
    """Whether the ticker is followed after some have joined."""
    found = F.col("held")
    for x in joined:
        found = F.when(F.col("ticker") == x["ticker"], True).when(F.lit(x["weakest"]).isNotNull() & (F.col("ticker") == x["weakest"]), False).otherwise(found)
    return found


def _at(place: Row) -> Column:
    kinds = {"kind": "int", "behind": "double", "sector": "string", "ord": "long", "k": "int", "name": "string"}
    return F.struct(*[F.lit(place[c]).cast(kind).alias(c) for c, kind in kinds.items()])


def curated(candidates: DataFrame, holdings: DataFrame, cap: int = CAP, room: int = ROOM) -> DataFrame:
    """queue() -> sector, name, ticker, status, reason, qoq_growth, action, replaced, place for every candidate.

    A sector with less than ``room`` holdings takes an eligible candidate; a full one lets it replace the holding of the
    least potential, if the candidate's is greater. When ``cap`` have joined, the rest is deferred. action: added,
    rotated_in or null.
    """
    fits = (F.col("n") < room) | (F.col("growth") > F.col("least"))
    # read by every round, so worked out once
    with_checkpoints(candidates.sparkSession)
    candidates = candidates.checkpoint()
    joined: list[Row] = []
    while len(joined) < cap:
        able = candidates.where(F.col("eligible") & F.col("twin").isNull() & ~_held(joined))
        if joined:
            able = able.where(F.col("place") > _at(joined[-1]["place"]))
        able = able.join(_state(holdings, joined), "sector").where(fits).withColumn("weakest", F.when(F.col("n") >= room, F.col("weakest")))
        first = able.select("place", "sector", "ticker", "growth", "weakest").orderBy("place").limit(1).collect()
        if not first:
            break
        joined += first

    turn = sum((F.when(F.col("place") > _at(x["place"]), 1).otherwise(0) for x in joined), F.lit(0))
    states = [_state(holdings, joined[:i]).withColumn("turn", F.lit(i)) for i in range(len(joined) + 1)]
    state, held = states[0], _held([])
    for i in range(1, len(joined) + 1):
        state = state.unionByName(states[i])
        held = F.when(F.col("turn") >= i, _held(joined[:i])).otherwise(held)
    rows = candidates.withColumn("turn", turn).join(state, ["sector", "turn"], "left").withColumn("now", held)
    # fixed values: names and texts of the verdicts
    text = lambda pattern, *of: F.format_string(pattern, *[F.col(c) if isinstance(c, str) else c for c in of])
    failed = (
        F.when(F.col("growth") <= 0, "Negative target potential")
        .when(F.col("revenue_growth") < 0, text("Failed growth criteria (YoY revenue %.1f%%)", F.col("revenue_growth") * 100))
        .otherwise(text("Failed QoQ growth threshold (%.1f%% < 15%%)", "qoq"))
    )
    verdict = lambda status, reason, action=None: F.struct(F.lit(status).alias("status"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"), F.lit(action).cast("string").alias("action"))
    told = (
        F.when(F.col("turn") >= cap, verdict("Deferred", f"Run intake cap reached ({cap} watchlist changes); will be reconsidered next run."))
        .when(F.col("ticker").isNull(), verdict("Unresolved", "Could not map company name to a BSE/NSE ticker."))
        .when(F.col("now"), verdict("Watchlisted", text("Already present in the %s watchlist.", "sector")))
        .when(F.col("growth").isNull(), verdict("Unresolved", "BSE/NSE ticker resolved, but no market trading history found."))
        .when(F.col("twin").isNotNull(), verdict("Watchlisted", text("Already tracked as %s in %s (same ISIN %s).", "twin.ticker", "twin.sector", "isin")))
        .when(~F.col("eligible"), verdict("Growth Divergence", failed))
        .when(F.col("n") < room, verdict("Watchlisted", "Added to watchlist (new high-growth pick).", "added"))
        .when(F.col("growth") > F.col("least"), verdict("Watchlisted", text("Rotated into watchlist replacing %s.", "weakest"), "rotated_in"))
        .otherwise(verdict("Pipeline", text("Pipeline candidate (Upside %.1f%% vs weakest watchlisted %.1f%%).", "growth", "least")))
    )
    found = rows.withColumn("v", told)
    slot = F.col("v.action").isNotNull() | (F.col("v.status") == "Pipeline")
    return found.select("sector", "name", "ticker", "v.status", "v.reason", F.when(slot, F.round("qoq", 1)).alias("qoq_growth"), "v.action", F.when(F.col("v.action") == "rotated_in", F.col("weakest")).alias("replaced"), "place")
