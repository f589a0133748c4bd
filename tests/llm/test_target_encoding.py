"""Target encoding against a brute-force version, with small slices, gaps, hot instants and odd rows."""

import random
import zlib
from datetime import datetime, timedelta

import pytest

from gridmill.llm.target_encoding import Smoothing, sale_line_rates, time_ordered_rates

START = datetime(2024, 1, 1)


def brute(lines, sales, items, vendors, clients, how):
    """The rows of the contract by comparing all pairs of lines."""
    joined = []
    for sale, _, item, vendor, flag, *_ in lines:
        for sale2, client, sold in sales:
            if sale is not None and sale == sale2 and sold is not None:
                seconds = int((sold - START) / timedelta(microseconds=1))
                joined.append((sale, -1 if item is None else item, vendor, -1 if client is None else client, seconds, zlib.crc32(str(sale).encode()) % how.folds, flag == "returned"))
    kind = [dict(t) for t in (items, vendors, clients)]
    value = [[j[k] for j in joined] for k in (1, 2, 3)]
    parent = [[kind[k].get(v) for v in value[k]] for k in range(3)]

    def rate(history, prior):
        n, s = len(history), sum(joined[h][6] for h in history)
        return prior if n < 1 else (1_000_000 * s + how.weight * prior) // (n + how.weight)

    out = set()
    for a, (sale, item, vendor, _client, at, fold, _) in enumerate(joined):
        past = [b for b in range(len(joined)) if joined[b][5] != fold and joined[b][4] + how.gap < at]
        base = rate(past, how.prior)
        found = []
        for k in range(3):
            up = rate([b for b in past if parent[k][b] == parent[k][a]], base)
            own = [b for b in past if value[k][b] == value[k][a]]
            found += [len(own), rate(own, up)]
        same = [j for j in joined if j[:5] == joined[a][:5]]
        out.add((sale, item, vendor, len(same), sum(j[6] for j in same), *found))
    return out


def shop(seed, n_sales=60, n_lines=250):
    r = random.Random(seed)
    pick = lambda *xs: r.choice(xs)
    sales = [(k, pick(1, 1, 2, 3, 9, None), None if r.random() < 0.05 else START + timedelta(seconds=pick(0, 5, 5, r.randrange(40)))) for k in range(n_sales)]
    sales.append((-3, 1, START + timedelta(seconds=7, microseconds=5)))
    sales.append((None, 1, START))
    lines = [(pick(7, r.randrange(n_sales + 4), -3, None), k, pick(0, 0, 1, 2, 77, None), pick(0, 1, 5, None), pick("returned", "kept", None)) for k in range(n_lines)]
    items = [(0, "a"), (1, "b"), (2, None), (-1, "b")]
    return lines + lines[:20], sales, items, [(0, "3"), (1, "4")], [(1, "x"), (2, "x"), (3, None)]


@pytest.mark.parametrize(("seed", "gap", "slice_rows"), [(1, 0, 7), (2, 3_000_000, 7), (3, 60_000_000, 11), (4, 0, 100_000)])
def test_equals_brute_force(spark, seed, gap, slice_rows):
    lines, sales, items, vendors, clients = shop(seed)
    how = Smoothing(gap=gap)
    found = sale_line_rates(
        spark.createDataFrame(lines, "sale_id long, line_no int, item_id long, vendor_id long, flag string").repartition(3),
        spark.createDataFrame(sales, "sale_id long, client_id long, sold_at timestamp_ntz").repartition(2),
        spark.createDataFrame(items, "item_id long, kind string"),
        spark.createDataFrame([(k, int(v)) for k, v in vendors], "vendor_id long, nation_id int"),
        spark.createDataFrame(clients, "client_id long, segment string"),
        how,
        slice_rows,
    )
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == brute(lines, sales, items, vendors, clients, how)


def test_empty_tables_and_clashing_names(spark):
    lines = spark.createDataFrame([], "sale_id long, item_id long, vendor_id long, flag string, at string, slice int, part int")
    sales = spark.createDataFrame([(1, 1, START, 3)], "sale_id long, client_id long, sold_at timestamp, n int")
    items, vendors, clients = (spark.createDataFrame([], s) for s in ("item_id long, kind string", "vendor_id long, nation_id int", "client_id long, segment string"))
    assert sale_line_rates(lines, sales, items, vendors, clients).collect() == []
    one = spark.createDataFrame([(1, 5, 6, "returned", "x", 1, 1)], lines.schema)
    assert [tuple(r) for r in sale_line_rates(one, sales, items, vendors, clients).collect()] == [(1, 5, 6, 1, 1, 0, 500_000, 0, 500_000, 0, 500_000)]
    assert sale_line_rates(one, sales.limit(0), items, vendors, clients).collect() == []


def test_smallest_of_several_parents_and_missing_times(spark):
    rows = spark.createDataFrame(
        [(0, 0, 4, 4, 1, "p"), (10, 1, 1, 0, 2, "q"), (None, 1, 1, 1, 2, "r"), (10, 0, 1, 0, 1, "s")], "at long, fold int, n long, s long, k long, name string"
    )
    parents = spark.createDataFrame([(1, "b"), (1, "a"), (2, "a"), (None, "c")], "key long, parent string")
    found = {r["name"]: (r["k_n"], r["k_rate"]) for r in time_ordered_rates(rows, ["k"], [parents], ["name"]).collect()}
    base = (4_000_000 + 50 * 500_000) // 54
    up = (4_000_000 + 50 * base) // 54
    assert found == {"p": (0, 500_000), "q": (0, up), "s": (0, 500_000)}
