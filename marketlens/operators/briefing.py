"""What a day's briefing shows: a block for each sector that moved, the day in one row, and the cut that fits its size.

Lists within a block are short and in order: rows are cut to the first few of a sector before they are brought together,
so no sector's news or warnings are ever collected as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.coerce import severity_rank
from marketlens.operators.attribution import containing
from marketlens.operators.sets import top_of
from marketlens.session import apart

# fixed values: caps of a block's lists, words of the kinds of news in the order of the list, and what is said of nothing
NEWS, FOCUS, THREATS = 4, 3, 2
NEWS_KINDS = (
    ("order_win", ("order", "contract")),
    ("policy", ("policy", "pli", "scheme", "cabinet", "government")),
    ("tie_up", ("tie-up", "tie up", "partnership", "mou", "agreement")),
)
CHANGED = ("new", "escalated")
NO_SIGNAL = "No signal this cycle"
# fixed values: of each tier how many sectors, companies and headlines it shows, and the size that has to be kept
LADDER = (("full", 6, 3, 3), ("compact", 3, 2, 1), ("minimal", 2, 1, 1))
BUDGET_BYTES = 95_000
# fixed values: the day's caps, and the shares of holdings with prices and with figures under which a run is degraded
HOT_SECTORS = 3
PRICED, FIGURES = 0.6, 0.5


def _weight() -> Column:
    return F.greatest(4 - severity_rank(F.col("severity")), F.lit(1))


def _listed(rows: DataFrame, order: list[Column], k: int, name: str, *columns: str) -> DataFrame:
    """sector and an array of the first k rows' columns, in order."""
    first = top_of(rows, ["sector"], order, k, "_at").groupBy("sector").agg(F.array_sort(F.collect_list(F.struct("_at", *columns))).alias(name))
    return first.withColumn(name, F.transform(name, lambda x: F.struct(*[x[c].alias(c) for c in columns])))


def news_of_sectors(news: DataFrame, warnings: DataFrame, k: int = NEWS) -> DataFrame:
    """news (sector, id, title, day) -> sector, news: the first k by kind and day. What names a company with a critical warning comes first."""
    grave = warnings.where("severity = 'Critical'").select(F.col("ticker").alias("term")).distinct()
    linked = containing(news, grave).select("id").distinct().withColumn("linked", F.lit(True))
    low = F.lower("title")
    kind = F.when(F.col("linked"), "linked_to_critical")
    rank = F.when(F.col("linked"), 0)
    for i, (name, words) in enumerate(NEWS_KINDS, 1):
        told = low.rlike("|".join(words))
        kind, rank = kind.when(told, name), rank.when(told, i)
    rows = news.where("title <> ''").hint("merge").join(linked, "id", "left").withColumns({"kind": kind.otherwise("other"), "rank": rank.otherwise(len(NEWS_KINDS) + 1), "date": F.coalesce(F.col("day").cast("string"), F.lit(""))})
    return _listed(rows, [F.col("rank"), F.col("date"), F.col("id")], k, "news", "id", "date", "title", "kind")


def focus_of_sectors(companies: DataFrame, warnings: DataFrame, coverage: DataFrame, k: int = FOCUS) -> DataFrame:
    """companies (sector, ticker), coverage (ticker, counted) -> sector, focus: by the gravest warning, coverage and ticker."""
    side = F.when(F.col("direction") == "risk", 0).when(F.col("direction") == "opportunity", 1).otherwise(9)
    told = warnings.groupBy("sector", "ticker").agg(F.max(_weight()).alias("weight"), F.min(F.struct(side.alias("side"), severity_rank(F.col("severity")).alias("rank"), "category")).alias("first"))
    rows = companies.select("sector", "ticker").join(told, ["sector", "ticker"], "left").join(coverage.select("ticker", "counted"), "ticker", "left")
    rows = rows.withColumns({"weight": F.coalesce("weight", F.lit(0)), "counted": F.coalesce("counted", F.lit(0)), "signal": F.coalesce("first.category", F.lit(NO_SIGNAL))})
    return _listed(rows, [F.desc("weight"), F.desc("counted"), F.col("ticker")], k, "focus", "ticker", "weight", "signal", "counted")


def threats_of_sectors(entrants: DataFrame, peers: DataFrame, k: int = THREATS) -> DataFrame:
    """entrants (sector, challenger, id), peers (sector, name, ticker, sales_var, place) -> sector, threats: entrants first, then peers."""
    new = entrants.select("sector", F.coalesce("challenger", F.lit("Unnamed")).alias("name"), F.lit("new entrant").alias("detail"), F.lit(0).alias("arm"), F.col("id").cast("long").alias("place"))
    grown = F.when(F.col("sales_var").isNotNull(), F.format_string("%+.1f%% revenue growth", "sales_var")).otherwise("unlisted entrant")
    known = peers.select("sector", F.coalesce(F.nullif("name", F.lit("")), "ticker", F.lit("Unnamed")).alias("name"), grown.alias("detail"), F.lit(1).alias("arm"), F.col("place").cast("long").alias("place"))
    return _listed(new.unionByName(known), [F.col("arm"), F.col("place"), F.col("name")], k, "threats", "name", "detail")


def sector_blocks(warnings: DataFrame, news: DataFrame, companies: DataFrame, coverage: DataFrame, entrants: DataFrame, peers: DataFrame) -> DataFrame:
    """A row for each sector in which something changed or that has news: sector, delta, n_new, n_escalated, stance, and its lists.

    warnings: (ticker, sector, category, direction, severity, status). companies: (sector, ticker, method). See in_block_order.
    """
    changed = F.col("status").isin(*CHANGED)
    moved = warnings.groupBy("sector").agg(F.sum(F.when(changed, _weight()).otherwise(0)).alias("delta"), F.count_if(F.col("status") == "new").alias("n_new"), F.count_if(F.col("status") == "escalated").alias("n_escalated"))
    silent = companies.where("method = 'No Estimate'").groupBy("sector").agg(F.array_sort(F.collect_set("ticker")).alias("suppressed"))
    rows = companies.select("sector").distinct()
    # a row for each sector
    for part in (moved, news_of_sectors(news, warnings), focus_of_sectors(companies, warnings, coverage), threats_of_sectors(entrants, peers), silent):
        rows = rows.join(apart(part), "sector", "left")
    none = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    rows = rows.where("delta > 0 or news is not null").select("sector", none("delta"), none("n_new"), none("n_escalated"), "news", "focus", "threats", "suppressed")
    stance = F.when(F.col("n_new") + F.col("n_escalated") > 0, F.format_string("%d new, %d escalated", "n_new", "n_escalated")).otherwise("No change this cycle; carrying news only")
    return rows.withColumn("stance", stance)


def in_block_order(blocks: DataFrame) -> DataFrame:
    """The most changed first, then by news, then by name."""
    return blocks.orderBy(F.desc("delta"), F.desc(F.coalesce(F.size("news"), F.lit(0))), "sector")


def fitted(blocks: DataFrame, budget: int = BUDGET_BYTES, ladder: tuple[tuple[str, int, int, int], ...] = LADDER) -> DataFrame:
    """The blocks that a message shows, cut by the first tier of the ladder whose text keeps to the budget, or by the last.

    place, tier, block (JSON). Only as many blocks as the widest tier shows are ever ordered in one place.
    """
    widest = max(n for _, n, _, _ in ladder)
    few = in_block_order(blocks).limit(widest)
    few = few.withColumn("place", F.row_number().over(Window.orderBy(F.desc("delta"), F.desc(F.coalesce(F.size("news"), F.lit(0))), "sector")))
    fields = [c for c in blocks.columns if c not in ("news", "focus")]

    def cut(tier: tuple[str, int, int, int]) -> Column:
        _, sectors, stocks, news = tier
        return F.when(F.col("place") <= sectors, F.to_json(F.struct(*fields, F.slice("focus", 1, stocks).alias("focus"), F.slice("news", 1, news).alias("news"))))

    texts = few.select("place", *[cut(t).alias(t[0]) for t in ladder])
    sizes = texts.agg(*[F.coalesce(F.sum(F.octet_length(t[0])), F.lit(0)).alias(t[0]) for t in ladder])
    tier = F.coalesce(*[F.when(F.col(t[0]) <= budget, t[0]) for t in ladder], F.lit(ladder[-1][0]))
    chosen = sizes.select(tier).scalar()
    block = F.coalesce(*[F.when(F.col("tier") == t[0], F.col(t[0])) for t in ladder])
    return texts.withColumn("tier", chosen).select("place", "tier", block.alias("block")).where("block is not null")


def daily_summary(warnings: DataFrame, companies: DataFrame, theses: DataFrame) -> DataFrame:
    """The day in one row: what changed, how far the run can be trusted, and the sectors that moved most.

    warnings: (ticker, sector, category, severity, direction, status); companies: (ticker, price, has_figures, ttm,
    method); theses: (ticker, health). Only what is new or escalated counts; standing warnings are a total.
    """
    changed, new = F.col("status").isin(*CHANGED), F.col("status") == "new"
    counts = warnings.agg(
        F.count_if(changed & (F.col("severity") == "Critical") & (F.col("direction") == "risk")).alias("critical_total"), F.count_if(F.col("status") == "escalated").alias("escalated_total"),
        F.count_if(changed & (F.col("direction") == "opportunity")).alias("opportunities_total"), F.count_if(new).alias("new_total"), F.count_if(F.coalesce("status", F.lit("ongoing")) == "ongoing").alias("ongoing_total"),
        F.count_distinct(F.when(F.col("status") == "ongoing", F.struct("category", "severity"))).alias("ongoing_groups"),
    )
    held = companies.agg(
        F.count("*").alias("total"), F.count_if(F.col("price") != 0).alias("priced"), F.count_if("has_figures").alias("figures"), F.count_if(F.col("ttm").isNotNull()).alias("growth"), F.count_if(F.col("method") == "No Estimate").alias("suppressed"),
    )
    broken = theses.agg(F.count_if(F.col("health") == "Broken").alias("broken"))
    hot = warnings.where(changed).groupBy(F.coalesce("sector", F.lit("unknown")).alias("sector")).agg(F.count("*").alias("n"))
    hot = hot.orderBy(F.desc("n"), "sector").limit(HOT_SECTORS).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "sector"))).alias("x")).select(F.array_join(F.transform("x", lambda x: F.concat(x["sector"], F.lit(" "), (-x["n"]).cast("string"))), "; ").alias("hot"))
    # four rows of one each
    row = counts.withColumns({"held": held.select(F.struct("*")).scalar(), "broken_theses": broken.scalar(), "hot_sectors": hot.scalar()})
    all_ = F.greatest(F.col("held.total"), F.lit(1))
    degraded = (F.col("held.priced") / all_ < PRICED) | (F.col("held.figures") / all_ < FIGURES)
    complete = F.when(F.col("held.total") > 0, F.bround((F.col("held.priced") + F.col("held.figures") + F.col("held.growth")) / (3 * all_) * 100, 0)).otherwise(0).cast("int")
    day = F.when(degraded, "degraded").when((F.col("new_total") == 0) & (F.col("escalated_total") == 0), "quiet").otherwise("normal")
    return row.select(day.alias("day_type"), complete.alias("completeness"), "critical_total", "escalated_total", "opportunities_total", "new_total", "ongoing_total", "ongoing_groups", "broken_theses", F.col("held.suppressed").alias("suppressed"), "hot_sectors")
