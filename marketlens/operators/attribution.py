"""Which company a headline names, which subjects it touches, and what follows from it.

Headlines meet names through a phrase index: a headline is cut into runs of words, of the lengths that names have, and a
run is looked up as a whole by one equi-join. Terms that may stand anywhere in the text, within words too, are looked up
by their first three letters, and the whole term is compared at once. Names and terms are dimensions, headlines may be
many; nothing is compared pair by pair, and a word that many names begin with brings none of them.

The optimiser takes a headline's runs for as few bytes as the headline, and an index made by joins for the product of
their sides, so it would broadcast the runs. Hints forbid that; vocabularies of sectors are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions import headlines as H
from marketlens.functions.coerce import clauses, dedup_key
from marketlens.operators.sets import crossed, top_of


def phrases(companies: DataFrame) -> DataFrame:
    """(ticker, words, own) for each phrase that names a company: name, names in brackets, ticker."""
    name = F.coalesce("name", F.lit(""))
    aliases = F.regexp_extract_all(name, F.lit(r"\(([^)]+)\)"), F.lit(1))
    core = F.element_at(F.split(name, r"\("), 1)
    found = F.concat(F.array(H.cleaned(H.tokens(core))), F.transform(aliases, lambda x: H.cleaned(H.tokens(x))), F.array(F.array(F.lower("ticker"))))
    rows = companies.select("ticker", H.cleaned(H.tokens(name)).alias("own"), F.explode(found).alias("words"))
    return rows.where("size(words) > 0 and words[0] <> ''").distinct()


def _runs(items: Column, size: Column, lengths: Column, cut: Column) -> Column:
    """The runs of each length within ``size`` items; ``cut`` gives one from its start and length."""
    fits = F.filter(lengths, lambda n: n <= size)
    return F.flatten(F.transform(fits, lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda at: cut(at, n))))


def named(titles: DataFrame, companies: DataFrame) -> DataFrame:
    """titles (id, title), companies (ticker, name) -> (id, ticker): which headlines name which companies.

    A single word names no company where it is part of a person's or another company's name: after a title, or before a
    capitalised word that is none of the company's own.
    """
    index = phrases(companies).select("ticker", "own", F.concat_ws(" ", "words").alias("run"), F.size("words").alias("n"))
    read = titles.select("id", H.tokens(F.col("title")).alias("tokens"), F.split("title", H.TOKEN).alias("gaps"))
    read = read.withColumns({"clean": H.cleaned(F.col("tokens")), "lengths": index.agg(F.collect_set("n")).scalar()})

    def beside(at: Column) -> Column:
        after, told = F.try_element_at("clean", at + 1), F.try_element_at("tokens", at + 1)
        plain = after.isin(*H.CORPORATE, *H.HEADLINE_VERBS, *H.FUNCTION_WORDS) | after.rlike(H.PERIOD)
        longer = told.rlike("^[A-Z]") & (F.trim(F.try_element_at("gaps", at + 1)) == "") & ~plain
        titled = (at > 1) & F.try_element_at("clean", at - 1).isin(*H.PERSON_TITLES)
        return F.when(titled, F.lit("")).when(longer, after)

    # what keeps each word from being a name by itself: "" or a word that the company's name would have to hold
    read = read.withColumn("beside", F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("clean"))), beside))
    run = lambda at, n: F.struct(F.concat_ws(" ", F.slice("clean", at, n)).alias("run"), n.alias("n"), F.when(n == 1, F.element_at("beside", at)).alias("after"))
    runs = read.select("id", F.explode(_runs(F.col("clean"), F.size("clean"), F.col("lengths"), run)).alias("r")).select("id", "r.*")
    fine = F.col("after").isNull() | F.array_contains("own", F.col("after"))
    return runs.hint("merge").join(index, ["run", "n"]).where(fine).select("id", "ticker").distinct()


def containing(titles: DataFrame, terms: DataFrame) -> DataFrame:
    """titles (id, title), terms (term, ...) -> (id, ...): the terms' other columns where the title contains the term, in any case.

    Terms are met by their first three letters; shorter ones by all of theirs. An empty or null term is in no title.
    """
    index = terms.withColumn("term", F.lower("term")).where("term <> ''").withColumn("gram", F.substring("term", 1, 3)).withColumn("n", F.char_length("gram"))
    read = titles.select("id", F.lower("title").alias("low")).withColumn("lengths", index.agg(F.collect_set("n")).scalar())
    grams = _runs(F.col("low"), F.char_length("low"), F.col("lengths"), lambda at, n: F.substring(F.col("low"), at, n))
    met = read.select("id", "low", F.explode(F.array_distinct(grams)).alias("gram")).hint("merge").join(index, "gram")
    return met.where(F.col("low").contains(F.col("term"))).drop("low", "gram", "n", "term").distinct()


def with_event(titles: DataFrame) -> DataFrame:
    """titles with type, phrase, certainty, clause and direction of the first clause that tells of an event; null if none does."""
    told = F.transform(clauses(F.col("title")), lambda c: F.struct(c.alias("clause"), H.event(c).alias("event")))
    first = F.try_element_at(F.filter(told, lambda x: x["event"].isNotNull()), F.lit(1))
    rows = titles.withColumn("e", first).withColumns({"type": F.col("e.event.type"), "phrase": F.col("e.event.phrase"), "clause": F.col("e.clause")}).drop("e")
    direction = F.when(F.col("type").isin(*H.RISKS), "risk").when(F.col("type").isNotNull(), "opportunity")
    return rows.withColumns({"certainty": F.when(F.col("type").isNotNull(), H.certainty(F.col("clause"))), "direction": direction})


def events(titles: DataFrame) -> DataFrame:
    """The titles that tell of an event, with their own columns and with_event()'s."""
    return with_event(titles).where("type is not null")


def domains(titles: DataFrame, terms: DataFrame) -> DataFrame:
    """titles (id, title), terms (sector, term) -> (id, domains): the sectors whose vocabulary a title touches, in order."""
    return containing(titles, F.broadcast(terms)).groupBy("id").agg(F.array_sort(F.collect_set("sector")).alias("domains"))


def market_events(titles: DataFrame, terms: DataFrame, companies: DataFrame) -> DataFrame:
    """Events with the sectors that the headline touches (domains) and the companies that the event's own clause names (actors).

    What touches neither is left out. titles: (id, title, day).
    """
    found = events(titles)
    actors = named(found.select("id", F.col("clause").alias("title")), companies).groupBy("id").agg(F.array_sort(F.collect_set("ticker")).alias("actors"))
    both = found.join(domains(found, terms), "id", "left").join(actors, "id", "left").where("domains is not null or actors is not null")
    none = F.array().cast("array<string>")
    return both.withColumns({"domains": F.coalesce("domains", none), "actors": F.coalesce("actors", none)})


def refreshed(corpus: DataFrame, companies: DataFrame, today: Column, days: int = 45) -> DataFrame:
    """The events of earlier runs by the rules and companies of now.

    corpus: market_events()'s rows. Rows older than ``days`` go. Actors are read again from the clause that holds the
    event's phrase, or else from the whole headline. An event left without actors and domains goes. A certainty that is
    missing is filled in from that clause; others stay.
    """
    held = F.filter(clauses(F.col("title")), lambda c: F.lower(c).contains(F.col("phrase")))
    rows = corpus.where(F.col("day") >= F.date_sub(today, days)).withColumn("clause", F.when(F.col("phrase") != "", F.coalesce(F.try_element_at(held, F.lit(1)), F.col("title"))).otherwise(F.col("title")))
    actors = named(rows.select("id", F.col("clause").alias("title")), companies).groupBy("id").agg(F.array_sort(F.collect_set("ticker")).alias("now"))
    both = rows.drop("actors").join(actors, "id", "left").where("now is not null or size(domains) > 0")
    certainty = F.coalesce(F.nullif("certainty", F.lit("")), H.certainty(F.col("clause")))
    both = both.withColumns({"actors": F.coalesce("now", F.array().cast("array<string>")), "certainty": certainty})
    return both.select(*corpus.columns)


def supply_chain(found: DataFrame, companies: DataFrame, k: int = 3) -> DataFrame:
    """Warnings for all companies of a sector from its first k risk events. found: market_events(); companies: (ticker, sector)."""
    touched = found.where("direction = 'risk'").select("id", F.explode("domains").alias("sector"))
    first = top_of(touched, ["sector"], [F.col("id")], k).drop("rank")
    return first.join(companies.select("ticker", "sector"), "sector").select("id", "ticker", "sector", F.lit("Medium").alias("severity"), F.lit("risk").alias("direction"), F.lit("Supply Chain").alias("category"))


def coverage(titles: DataFrame, matches: DataFrame, today: DataFrame, window: int = 120) -> DataFrame:
    """(id, title, day) and (id, ticker) -> ticker, id, status: counted, merged with an earlier equal one, or excluded by age.

    An item that is too old does not stand for later equal ones. today: one row.
    """
    rows = titles.hint("merge").join(matches, "id").withColumn("key", dedup_key(F.col("title"))).where("key <> ''")
    rows = rows.withColumn("old", F.coalesce(F.date_diff(today.scalar(), "day") > window, F.lit(False)))
    first = F.min(F.when(~F.col("old"), F.col("id"))).over(Window.partitionBy("ticker", "key"))
    status = F.when(F.col("id") > F.col("first"), "merged").when(F.col("old"), "excluded").otherwise("counted")
    return rows.withColumn("first", first).select("ticker", "id", status.alias("status"))


def topics(titles: DataFrame, matches: DataFrame, k: int = 8) -> DataFrame:
    """The first k headlines of each ticker, equal ones once: ticker, id, place."""
    rows = titles.join(matches, "id").withColumn("key", F.lower(F.trim("title"))).where("key <> ''").groupBy("ticker", "key").agg(F.min("id").alias("id"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("ticker").orderBy("id"))).where(F.col("place") <= k).select("ticker", "id", "place")


def materiality(titles: DataFrame, revenue: DataFrame) -> DataFrame:
    """(id, ticker, type, title) and (ticker, revenue in crores) -> id, ticker, amount_cr, pct_of_revenue, band, weight."""
    rows = titles.join(revenue, "ticker", "left").withColumn("sized", H.sized(F.col("type"), F.col("title")))
    rows = rows.withColumn("amount_cr", F.when(F.col("sized"), H.amount(F.col("title")))).withColumn("pct", F.when(F.col("revenue") > 0, F.col("amount_cr") / F.col("revenue") * 100))
    band = F.when(F.col("sized"), H.band(F.col("pct"))).otherwise("unknown")
    return rows.withColumn("band", band).select("id", "ticker", "amount_cr", F.round("pct", 2).alias("pct_of_revenue"), "band", F.when(F.col("pct").isNotNull(), H.weight(F.col("band"))).otherwise(1.0).alias("weight"))


def sized_warnings(found: DataFrame, keys: list[str], revenue: DataFrame) -> DataFrame:
    """Warnings with materiality_pct, _band and _basis: of their own headlines (sources: kind, title) the one that is largest against revenue.

    keys tell warnings apart, ticker among them. Each headline is measured by itself; one without an amount, or whose
    amount is not the company's, is passed over. A warning without any has nulls.
    """
    told = found.select(*keys, F.posexplode("sources").alias("id", "s")).select(*keys, "id", F.col("s.kind").alias("type"), F.col("s.title").alias("title")).where("title <> ''")
    rows = told.withColumn("id", F.struct(*keys, "id"))
    one = materiality(rows.select("id", "ticker", "type", "title"), revenue).where("pct_of_revenue is not null").withColumn("place", F.col("id.id"))
    titled = one.join(rows.select("id", "title"), "id")
    best = titled.groupBy(*[F.col(f"id.{k}").alias(k) for k in keys]).agg(F.max_by(F.struct("pct_of_revenue", "band", "title"), F.struct("pct_of_revenue", -F.col("place"))).alias("b"))
    return found.join(best, keys, "left").withColumns({"materiality_pct": F.col("b.pct_of_revenue"), "materiality_band": F.col("b.band"), "materiality_basis": F.col("b.title")}).drop("b")


def partner_edges(titles: DataFrame, matches: DataFrame) -> DataFrame:
    """Undirected edges (src, dst, evidence) between companies that one tie-up headline names; each pair once, the first headline."""
    tied = titles.where(F.lower("title").rlike(H.any_of(H.EVENTS["tie_up"]))).select("id")
    one = matches.join(tied, "id")
    # a headline names a handful of companies: its pairs are few
    pairs = one.select("id", F.col("ticker").alias("src")).join(one.select("id", F.col("ticker").alias("dst")), "id").where("src < dst")
    return pairs.groupBy("src", "dst").agg(F.min("id").alias("evidence"))


def along_edges(found: DataFrame, titles: DataFrame, edges: DataFrame, companies: DataFrame, k: int = 3) -> DataFrame:
    """Warnings for what the edges of a named source lead to: a company, or the first k companies of a sector.

    Edges of input costs are not followed here. companies: (ticker, sector, ord).
    """
    anchors = edges.where("type <> 'input_cost'")
    hits = named(titles.join(found.select("id"), "id", "left_semi"), anchors.select(F.col("src").alias("ticker"), F.col("src").alias("name")).distinct())
    routed = found.select("id", "direction").join(hits.withColumnRenamed("ticker", "src"), "id").join(anchors.select("src", "dst"), "src").select("id", "direction", "src", "dst").distinct()
    own = companies.select(F.col("ticker").alias("dst"), F.col("ticker"))
    first = companies.withColumn("n", F.row_number().over(Window.partitionBy("sector").orderBy("ord"))).where(F.col("n") <= k).select(F.col("sector").alias("dst"), "ticker")
    # a name that is a company is no sector
    both = own.unionByName(first.join(own.select("dst"), "dst", "left_anti"))
    return routed.join(both, "dst").select("id", "src", "ticker", "direction", F.lit("Low").alias("severity"), F.lit("Ecosystem Signal").alias("category"))


def sector_stress(found: DataFrame, inputs: DataFrame, today: Column, days: int = 14, least: int = 2) -> DataFrame:
    """sector, n, warns: how many settled risk events of the last days touch each sector, by its vocabulary or by an input that the title names.

    found: market_events(); inputs: (src, dst). A reported event is no event yet. Each event counts once a sector.
    """
    recent = found.where((F.col("direction") == "risk") & (F.col("certainty") != "reported") & (F.col("day") >= F.date_sub(today, days)))
    through = containing(recent, F.broadcast(inputs.select(F.col("src").alias("term"), F.col("dst").alias("sector"))))
    touched = recent.select("id", F.explode("domains").alias("sector")).unionByName(through).distinct()
    return touched.groupBy("sector").agg(F.count("*").alias("n")).withColumn("warns", F.col("n") >= least)


def stress_warnings(stress: DataFrame, companies: DataFrame) -> DataFrame:
    """A warning for every company of a sector under stress."""
    return stress.where("warns").join(companies.select("ticker", "sector"), "sector").select("ticker", "sector", F.lit("Medium").alias("severity"), F.lit("risk").alias("direction"), F.lit("Supply Stress (Forward)").alias("category"), "n")


def new_entrants(titles: DataFrame, turf: DataFrame, companies: DataFrame, peers: DataFrame) -> DataFrame:
    """(sector, challenger, id): who makes an entry move on a sector's turf without one of its holdings being named, once each.

    titles: (id, title). turf: (sector, term). companies: (ticker, name, sector); peers: (ticker, name, place).
    """
    moves = titles.where(F.lower("title").rlike(H.any_of(H.ENTRY_MOVES)))
    held = companies.select("sector").distinct()
    on = moves.hint("merge").join(containing(moves, F.broadcast(turf.join(held, "sector").select("sector", "term"))), "id").select("id", "title", "sector")
    inside = named(moves, companies).join(companies.select("ticker", "sector"), "ticker").select("id", "sector").distinct()
    on = on.hint("merge").join(inside, ["id", "sector"], "left_anti")
    known = named(moves, peers).join(peers, "ticker").groupBy("id").agg(F.min_by("name", "place").alias("peer"))
    told = on.hint("merge").join(known, "id", "left").withColumn("challenger", F.coalesce("peer", H.challenger(F.col("title")))).where("challenger is not null")
    return told.groupBy("sector", F.lower("challenger").alias("key")).agg(F.min_by("challenger", "id").alias("challenger"), F.min("id").alias("id")).select("sector", "challenger", "id")


def entrant_warnings(entrants: DataFrame, companies: DataFrame) -> DataFrame:
    """A warning for every holding of a sector that somebody enters. Both grow with the market, and warnings with their product."""
    return crossed(entrants.select("sector", "challenger"), companies.select("ticker", "sector"), "sector").select("ticker", "sector", "challenger", F.lit("High").alias("severity"), F.lit("risk").alias("direction"), F.lit("New Entrant").alias("category"))
