"""Names in headlines and the choice of those who join, against a plain loop over the queue."""

import random

import pytest
from pyspark.sql import functions as F

from marketlens.operators import rotation

# fixed values: headlines and the names that are found in them
NAMES = [
    ("Syrma Technologies wins order", ["Syrma Technologies"]), ("Dixon wins order", []), ("Amber Enterprises and Kaynes Limited meet", ["Amber Enterprises", "Kaynes Limited"]), ("Shri Amit Shah launches plan", []),
    ("Union Cabinet Solutions", []), ("Avalon bags order, Syrma acquires unit", ["Avalon", "Syrma"]), ("AB expands", []), ("nothing wins", []), ("Larsen Infrastructure Ltd", ["Larsen Infrastructure Ltd"]), (None, []), ("", []),
]


def test_emerging(spark):
    companies = spark.createDataFrame([("DIXON", "Dixon Electronics Co"), ("X", None)], "ticker string, name string")
    titles = spark.createDataFrame([("s", i, t) for i, (t, _) in enumerate(NAMES)] + [("s", 99, NAMES[0][0]), ("u", 5, NAMES[0][0])], "sector string, id int, title string")
    got = [(r["sector"], r["name"]) for r in rotation.emerging(titles, companies).orderBy("sector", "id", "k").collect()]
    assert got == [("s", n) for _, names in NAMES for n in names] + [("u", "Syrma Technologies")]
    assert rotation.emerging(titles.limit(0), companies).count() == 0


def slow(queue, holdings, cap, room):
    """The loop: queue rows (sector, name, ticker, growth, revenue, qoq, isin), holdings {sector: [[ticker, isin, potential]]}."""
    followed = {x[0] for rows in holdings.values() for x in rows}
    twins = {}
    for s in sorted(holdings):
        for t, isin, _ in holdings[s]:
            if isin:
                twins.setdefault(isin, (t, s))
    lists = {s: [list(x) for x in rows] for s, rows in holdings.items()}
    out, n = [], 0
    for sector, name, ticker, growth, revenue, qoq, isin in queue:
        say = lambda status, action=None, replaced=None: out.append((sector, name, ticker, status, action, replaced))  # noqa: E731, B023
        if n >= cap:
            say("Deferred")
        elif not ticker:
            say("Unresolved")
        elif ticker in followed:
            say("Watchlisted")
        elif growth is None:
            say("Unresolved")
        elif isin in twins and twins[isin][0] != ticker:
            say("Watchlisted")
        elif growth <= 0 or (revenue is not None and revenue < 0) or (qoq or 0) < 15:
            say("Growth Divergence")
        elif len(lists[sector]) < room:
            lists[sector].append([ticker, isin, float(f"{growth:.1f}")])
            followed.add(ticker)
            n += 1
            say("Watchlisted", "added")
        else:
            weakest = min(lists[sector], key=lambda x: x[2] or 0.0)
            if growth > (weakest[2] or 0.0):
                lists[sector] = [x for x in lists[sector] if x[0] != weakest[0]] + [[ticker, isin, float(f"{growth:.1f}")]]
                followed.discard(weakest[0])
                followed.add(ticker)
                n += 1
                say("Watchlisted", "rotated_in", weakest[0])
            else:
                say("Pipeline")
    return out


@pytest.mark.parametrize(("seed", "cap"), [(0, 3), (1, 3), (2, 1), (3, 6), (4, 0)])
def test_curated(spark, seed, cap):
    """Random queues with tickers that come twice, come back after they were replaced, or are followed under another symbol."""
    dice = random.Random(seed)
    sectors = ["a", "b", "c"]
    holdings = {s: [[f"T{dice.randrange(30)}", dice.choice([None, f"I{dice.randrange(40)}"]), dice.choice([None, -3.0, 4.0, 4.0, 20.0])] for _ in range(k)] for s, k in zip(sectors, (5, 2, 7), strict=True)}
    quotes = {f"T{i}": (100.0, dice.choice([None, 90.0, 104.0, 110.0, 140.0]), dice.choice([None, -0.1, 0.2, 0.3]), dice.choice([None, 14.9, 15.0, 40.0, 50.0])) for i in range(30) if i % 7}
    isins = {f"T{i}": f"I{i}" for i in range(30)}
    symbols = {f"Name {i}": f"T{i}" for i in range(30) if i % 5}
    names = [(s, f"Name {dice.randrange(30)}", i, 0) for i, s in enumerate(dice.choices(sectors, k=6))]
    names = list({(s, n): (s, n, i, k) for s, n, i, k in reversed(names)}.values())
    screened = [(s, dice.choice([f"Name {i}", f"Peer {i}", f"name {i}"]), f"T{i}", dice.choice([None, 10.0, 30.0]), k) for k, (s, i) in enumerate(zip(dice.choices([*sectors, "none"], k=30), dice.choices(range(30), k=30), strict=True))]

    def row(s, n, t):
        price = quotes.get(t)
        growth = None if price is None else ((price[1] if price[1] else price[0] * 1.25) - price[0]) / price[0] * 100
        return (s, n, t, growth, price[2] if price else None, price[3] if price else None, isins.get(t))

    asked = {(s, n.lower()) for s, n, _, _ in names}
    told = [row(s, n, symbols.get(n)) for s, n, i, k in sorted(names, key=lambda x: (x[0], x[2]))]
    peers = sorted((x for x in screened if x[0] in holdings and (x[0], x[1].lower()) not in asked), key=lambda x: (-(x[3] or 0.0), x[0], x[4]))
    want = slow(told + [row(s, n, t) for s, n, t, _, _ in peers], holdings, cap, 5)

    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    held = frame([(s, i, *x) for s, rows in holdings.items() for i, x in enumerate(rows)], "sector string, ord int, ticker string, isin string, potential double")
    queue = rotation.queue(
        frame(names, "sector string, name string, id int, k int"), frame(screened, "sector string, name string, ticker string, growth_pct double, ord int"), frame(list(symbols.items()), "name string, ticker string"),
        frame([(t, *q) for t, q in quotes.items()], "ticker string, price double, target_mean double, revenue_growth double, qoq double"), frame(list(isins.items()), "ticker string, isin string"), held,
    )
    got = rotation.curated(queue, held, cap).orderBy("place").collect()
    assert [(r["sector"], r["name"], r["ticker"], r["status"], r["action"], r["replaced"]) for r in got] == want
    assert sum(r["action"] is not None for r in got) <= cap


def test_curated_reasons(spark):
    held = spark.createDataFrame([("s", i, f"H{i}", f"I{i}", 10.0 + i) for i in range(5)], "sector string, ord int, ticker string, isin string, potential double")
    rows = [("A", 1, 111.0, None, 20.0, None), ("B", 2, 100.0, None, 20.0, None), ("C", 3, 120.0, -0.05, 20.0, None), ("D", 4, 120.0, None, 14.0, None), ("E", 5, 120.0, None, 20.0, "I3"), ("F", 6, None, None, 20.0, None), ("H1", 7, 1.0, None, 0.0, None), ("G", 8, 105.0, None, 20.0, None)]
    quotes = spark.createDataFrame([(t, 100.0, target, revenue, qoq) for t, _, target, revenue, qoq, _ in rows if target], "ticker string, price double, target_mean double, revenue_growth double, qoq double")
    none = spark.createDataFrame([], "sector string, name string, id int, k int")
    screened = spark.createDataFrame([("s", t, t, 50.0, i) for t, i, *_ in rows], "sector string, name string, ticker string, growth_pct double, ord int")
    isins = spark.createDataFrame([(t, isin) for t, *_, isin in rows], "ticker string, isin string")
    got = rotation.curated(rotation.queue(none, screened, spark.createDataFrame([], "name string, ticker string"), quotes, isins, held), held).orderBy("place").collect()
    assert [r["reason"] for r in got] == [
        "Rotated into watchlist replacing H0.", "Negative target potential", "Failed growth criteria (YoY revenue -5.0%)", "Failed QoQ growth threshold (14.0% < 15%)", "Already tracked as H3 in s (same ISIN I3).",
        "BSE/NSE ticker resolved, but no market trading history found.", "Already present in the s watchlist.", "Pipeline candidate (Upside 5.0% vs weakest watchlisted 11.0%).",
    ]
    empty = rotation.curated(rotation.queue(none, screened.limit(0), spark.createDataFrame([], "name string, ticker string"), quotes, isins, held), held)
    assert empty.count() == 0
