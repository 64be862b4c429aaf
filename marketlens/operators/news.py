"""What was collected, what of it counts for whom and why the rest does not, how it reads, and what a run could not see.

Items of all feeds are rows of one frame: feed, place (an item's number within its feed), sector (of a sector's feed),
title, subject (a launch's product, a filing's text), day, link, source, type and actors (of an event). Missing columns
are nulls.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.coerce import dedup_key
from marketlens.operators.attribution import named

# fixed values: feeds in the order in which they are read, what their items are called, and how sure it is whom they tell of
FEEDS = (("sector", "Sector news", "M"), ("agreements", "Agreement", "M"), ("launches", "Launch", "M"), ("filings", "Filing", "M"), ("global", "Global", "L"), ("events", "Event", "H"))
SUBJECTS = ("launches", "filings")
WINDOW_DAYS = 120
QUOTED = 60
# fixed values: the least score of a positive text, and words that decide where a score does not
TONE = 0.2
GOOD = ("hike", "scheme approved", "approved", "subsidy", "record profit", "expansion", "secures order", "order of", "invests", "joint venture", "launch", "semiconductor fab", "pli benefit")
BAD = ("delay", "investigation", "fine", "loss", "tariff hike negative", "penalty", "tax increase", "curb")
TONE_SCALE = 15.0
# fixed values: shares of refreshed prices that are good and fair, and how many unpriced inputs a note names
FRESH = ((95, "good"), (80, "fair"))
NAMED = 4

ITEM = {"feed": "string", "place": "long", "sector": "string", "title": "string", "subject": "string", "day": "date", "link": "string", "source": "string", "type": "string", "actors": "array<string>"}


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _by_feed(values: list) -> Column:
    """The value of a row's feed; null for a feed that is not known."""
    return F.coalesce(*[F.when(F.col("feed") == name, F.lit(v)) for (name, _, _), v in zip(FEEDS, values)])


def items(rows: DataFrame) -> DataFrame:
    """The columns of ITEM, in their types, with ``rank``, the place of the feed; rows of unknown feeds go."""
    have = [F.col(c).cast(t).alias(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in ITEM.items()]
    return rows.select(*have).withColumn("rank", _by_feed(list(range(len(FEEDS))))).where("rank is not null")


def collected(rows: DataFrame) -> DataFrame:
    """Every headline once, whichever feed carried it: headline, feed, place of the first; events are no feed of headlines.

    Headlines are equal if they are in lower case and without the white space around them. Of launches and filings the
    subject counts, and what has none is left out. An aggregate, so that each task hands on one row of a headline.
    """
    own = items(rows).where("feed <> 'events'").withColumn("headline", _trimmed(F.when(F.col("feed").isin(*SUBJECTS), F.col("subject")).otherwise(F.col("title"))))
    first = own.where("headline <> ''").groupBy(F.lower("headline").alias("_key")).agg(F.min(F.struct("rank", "place", "headline", "feed")).alias("r"))
    return first.select("r.headline", "r.feed", "r.place")


def attributed(rows: DataFrame, companies: DataFrame) -> DataFrame:
    """Items with the ticker of each company that they tell of. companies: (ticker, name, sector), one row a ticker.

    A sector's feed tells of that sector's companies only, as it was asked for them; the others tell of any that their
    headline names; an event of its actors that are companies, in any case.
    """
    own = items(rows).withColumn("headline", F.when(F.col("feed").isin(*SUBJECTS), F.coalesce(F.nullif("subject", F.lit("")), "title")).otherwise(F.col("title"))).where("headline <> ''")
    known = companies.select(F.upper("ticker").alias("ticker"), "name", F.col("sector").alias("home"))
    told = own.where("feed <> 'events'").withColumn("id", F.struct("rank", "place", "sector"))
    by_name = told.join(named(told.select("id", F.col("headline").alias("title")), known), "id").join(known.select("ticker", "home"), "ticker").where("feed <> 'sector' or sector = home")
    acted = own.where("feed = 'events'").withColumn("ticker", F.explode(F.array_distinct(F.transform("actors", lambda x: F.upper(x)))))
    columns = ["ticker", "rank", *ITEM, "headline"]
    return by_name.select(*columns).unionByName(acted.join(known.select("ticker"), "ticker").select(*columns))


def audit(rows: DataFrame, companies: DataFrame, today: Column, window: int = WINDOW_DAYS) -> DataFrame:
    """Every item that tells of a company, counted or not, with the reason.

    ticker, feed, place, day, headline, link, source, tags, confidence, status, reason. Items are equal if their letters,
    digits and spaces are, in lower case; items without any go. In the order of feeds and places the first one that is not
    too old counts, later ones are merged with it; earlier ones are excluded by their age. Without a day an item isn't old.
    The first of equal items is found by an aggregate and joined back: a headline that all repeat is a skewed join, which
    is split at run time, and not one window.
    """
    found = attributed(rows, companies).withColumn("key", dedup_key(F.col("headline"))).where("key <> ''")
    age = F.date_diff(today, F.col("day"))
    found = found.withColumns({"age": age, "at": F.struct("rank", "place"), "old": F.coalesce(age > window, F.lit(False))})
    first = found.where("not old").groupBy("ticker", "key").agg(F.min(F.struct("at", F.substring("headline", 1, QUOTED).alias("said"))).alias("first"))
    both = found.join(first, ["ticker", "key"], "left")
    status = F.when(F.col("at") > F.col("first.at"), "merged").when(F.col("old"), "excluded").otherwise("counted")
    reason = F.when(F.col("at") > F.col("first.at"), F.concat(F.lit("merged: duplicate phrasing of “"), "first.said", F.lit("”"))).when(F.col("old"), F.format_string(f"aged >{window}d (%d days old)", "age"))
    tags = F.filter(F.array("type", _by_feed([kind for _, kind, _ in FEEDS])), lambda x: x != "")
    return both.select("ticker", "feed", "place", "day", "headline", "link", "source", tags.alias("tags"), _by_feed([sure for _, _, sure in FEEDS]).alias("confidence"), status.alias("status"), reason.alias("reason"))


def tone(text: Column, score: Column | None = None) -> Column:
    """Positive, Negative or Neutral: by the score where it is strong enough, else by words, of which the good ones come first."""
    low = F.lower(text)
    holds = lambda words: F.coalesce(low.rlike("|".join(words)), F.lit(False))
    by_words = F.when(holds(GOOD), "Positive").when(holds(BAD), "Negative").otherwise("Neutral")
    return by_words if score is None else F.when(score >= TONE, "Positive").when(score <= -TONE, "Negative").otherwise(by_words)


def scores(texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """texts (id, text), lexicon (word, valence) -> (id, score): the sum s of the valences of all words, as s / sqrt(s² + 15).

    Words are runs of letters, apostrophes and hyphens in lower case, and repeats count. Texts are cut to counts of their
    distinct words before the join. Rules for negation, degree and capitals are not applied. Texts without a word of the
    lexicon have no row; a word that the lexicon lists twice counts once, with its least valence.
    """
    words = texts.select("id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}'-]+"), F.lit(0))).alias("word")).groupBy("id", "word").agg(F.count("*").alias("n"))
    one = lexicon.groupBy(F.lower("word").alias("word")).agg(F.min("valence").cast("decimal(9,3)").alias("valence"))
    total = words.join(one, "word").groupBy("id").agg(F.sum(F.col("n") * F.col("valence")).cast("double").alias("s"))
    return total.select("id", (F.col("s") / F.sqrt(F.col("s") * F.col("s") + TONE_SCALE)).alias("score"))


def toned(rows: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(id, title, summary) -> id, score, impact. A null title or summary is empty; ids tell rows apart."""
    texts = rows.select("id", F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("summary", F.lit(""))).alias("text"))
    scored = texts.join(scores(texts, lexicon), "id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return scored.select("id", "score", tone(F.col("text"), F.col("score")).alias("impact"))


def data_quality(companies: DataFrame, counts: DataFrame, inputs: DataFrame, sectors: DataFrame, warnings: DataFrame) -> DataFrame:
    """What the run could not see: place, topic, level, note; only topics of which there is something to say, but for prices.

    companies: (ticker, refreshed, method, pledged). counts: (ticker, counted), of the companies that news was looked up
    for. inputs: (place, label, priced). sectors: (sector, band) by the move of their inputs. warnings: (materiality_pct).
    All are aggregated where they lie; one row of each is brought together.
    """
    count = lambda of, name: F.count_if(F.coalesce(of, F.lit(False))).alias(name)
    held = companies.agg(F.count("*").alias("held"), count(F.col("refreshed"), "updated"), count(F.col("method") == "No Estimate", "blind"), count(F.col("pledged").isNotNull(), "pledges"))
    news = counts.agg(F.count("*").alias("asked"), count(F.col("counted") > 0, "covered"))
    priced = inputs.agg(count(F.col("priced"), "priced"), count(~F.coalesce("priced", F.lit(False)), "unpriced"))
    # only as many as the note names are ever brought together
    labels = inputs.where("not coalesce(priced, false)").orderBy("place", "label").limit(NAMED).agg(F.array_sort(F.collect_list(F.struct("place", "label"))).alias("missing"))
    moved = sectors.agg(count(F.col("band").isin("material", "severe"), "shocked"))
    sized = warnings.agg(count(F.col("materiality_pct").isNotNull(), "sized"))
    row = reduce(lambda a, b: a.crossJoin(b), (news, priced, labels, moved, sized), held)  # one row each
    c = F.col
    share = c("updated") / c("held") * 100
    level = reduce(lambda x, f: x.when(share >= f[0], f[1]), FRESH[1:], F.when(share >= FRESH[0][0], FRESH[0][1])).otherwise("poor")
    more = F.when(c("unpriced") > NAMED, F.format_string(", and %d more", c("unpriced") - NAMED)).otherwise("")
    say = lambda topic, level, when, text, *values: F.when(when, F.struct(F.lit(topic).alias("topic"), (F.lit(level) if isinstance(level, str) else level).alias("level"), F.format_string(text, *values).alias("note")))
    notes = F.array(
        F.coalesce(
            say("Live prices", level, c("held") > 0, "%d/%d holdings refreshed (%s%%).", c("updated"), c("held"), F.bround(share, 0).cast("int").cast("string")),
            say("Live prices", "unknown", F.lit(True), "refresh status not recorded this run."),
        ),
        say("News coverage", "info", c("asked") > 0, "%d of %d holdings had attributable items.", c("covered"), c("asked")),
        say("Estimates suppressed", "fair", c("blind") > 0, "%d of %d holdings carry no target, because neither analyst coverage nor a usable fundamental base was available.", c("blind"), c("held")),
        say("Promoter pledging", "info", c("held") > 0, "%d of %d holdings disclosed a pledge figure; the rest are unread, not confirmed unpledged.", c("pledges"), c("held")),
        say("Input costs", "info", c("priced") > 0, "%d input(s) priced; %d sector(s) carrying a material move.", c("priced"), c("shocked")),
        say("Inputs not priced", "poor", c("unpriced") > 0, "%s%s — treated as unmeasured, not as unchanged.", F.array_join(F.transform("missing", lambda x: x["label"]), ", "), more),
        say("Order sizing", "info", c("sized") > 0, "%d alert(s) measured against trailing revenue; the rest carried no attributable figure.", c("sized")),
    )
    return row.select(F.posexplode(F.filter(notes, lambda x: x.isNotNull())).alias("place", "n")).select("place", "n.*")
