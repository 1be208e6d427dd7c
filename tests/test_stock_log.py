"""Mixed stock logs against a sequential fold: in one batch, in a stream over several micro-batches, and after a crash."""

import random

import pytest

from blockyard import constants as K
from blockyard.operators import stock_log as L
from blockyard.streaming.runtime import fresh_path, read_log_stream, write_ordered_log
from blockyard.streaming.stock import StockTable, reserve_stream

REQUESTS = "seq long, kind string, order_id string, count int, color_raw string"


def _stock(rng, n):
    rows = []
    for k in range(n):
        filled = rng.random() > 0.2
        order = f"h{rng.randrange(6)}" if rng.random() < 0.2 else None
        rows.append((k // 4, k % 4, K.ORDER_COLOURS[k % 4], filled, order if filled else None, None if filled else order))
    return rows


def _log(rng, n, restores=0.15):
    rows = []
    for i in range(n):
        order = rng.choice([f"o{rng.randrange(n // 3)}", f"h{rng.randrange(6)}"] if rng.random() < 0.3 else [f"o{rng.randrange(n // 3)}"])
        x = rng.random()
        if x < restores:
            rows.append((i * 5, "restore", order if rng.random() > 0.03 else None, None, None))
        elif x < restores + 0.2:
            rows.append((i * 5, "fetch", order if rng.random() > 0.03 else None, None, None))
        elif x > 0.995:
            rows.append((i * 5, "restore_all", None, None, None))
        else:
            rows.append((i * 5, "reserve", order if rng.random() > 0.02 else None, rng.choice([1, 2, 2, 3, 3, None] if rng.random() < 0.2 else [1, 2, 3]),
                         rng.choice(["Red", "green", "BLUE", "yellow", "yellow", "pink", None] if rng.random() < 0.2 else ["red", "blue"])))
    return rows


def _fold(stock, log):
    """(replies by seq: (status, cells moved or asked, message), stock)."""
    grid = {(x, y): [c, f, o, g] for x, y, c, f, o, g in stock}
    out = {}
    for seq, kind, order, count, raw in sorted(log, key=lambda r: r[0]):
        mine = sorted(p for p, (c, f, o, g) in grid.items() if f and o is not None and o == order)
        logged = [p for p, (c, f, o, g) in grid.items() if not f and g is not None and g == order]
        if kind == "reserve":
            colour = (raw or "").upper()
            free = sorted(p for p, (c, f, o, g) in grid.items() if f and o is None and c == colour)
            if order is None or count is None:
                out[seq] = (422, count, "Input should be a valid integer")
            elif colour not in K.ORDER_COLOURS:
                out[seq] = (400, count, f"Unknown color: {raw or ''}. Valid colors: ['RED', 'GREEN', 'BLUE', 'YELLOW']")
            elif mine or logged:
                out[seq] = (409, count, f"Order '{order}' already has reserved blocks")
            elif len(free) < count:
                out[seq] = (409, count, f"Not enough {colour} blocks. Requested: {count}, available: {len(free)}")
            else:
                for p in free[:count]:
                    grid[p][2] = order
                out[seq] = (200, count, None)
        elif kind == "fetch":
            for p in mine:
                grid[p][1:] = [False, None, order]
            out[seq] = (200, len(mine), None) if mine else (422, 0, "Field required") if order is None else \
                (404, 0, f"No reserved blocks found for order '{order}'")
        elif kind == "restore_all" or order is None:
            grid = {(x, y): [K.ORDER_COLOURS[y], True, None, None] for x, y in grid}
            out[seq] = (200, 0, "Inventory restored to default state")
        else:
            for p in mine + logged:
                grid[p][1:] = [True, None, None]
            n = len(mine + logged)
            out[seq] = (200, n, f"Restored {n} block(s) for order '{order}'") if n else (404, 0, f"No blocks found for order '{order}'")
    return out, sorted((x, y, *v) for (x, y), v in grid.items())


def _replies(df):
    rows = df.collect()
    got = {r["seq"]: (r["status"], r["count"], r["message"]) for r in rows}
    assert len(got) == len(rows)
    return got


def _cells(df):
    return sorted(tuple(r) for r in df.select("x", "y", "color", "filled", "order_id", "logged_by").collect())


@pytest.mark.parametrize("seed,restores", [(1, 0.0), (3, 0.15)])
def test_batch_equals_fold(spark, seed, restores):
    rng = random.Random(seed)
    stock, log = _stock(rng, 80), _log(rng, 150 if restores < 0.1 else 40, restores)
    replies, after = L.apply_stock_log(spark.createDataFrame(stock, L.STOCK), spark.createDataFrame(log, REQUESTS), chunk_width=64)
    want, grid = _fold(stock, log)
    assert _replies(replies) == want and _cells(after) == grid


def test_changed_colours(spark):
    """Orders that ask for one colour after another, with stock that runs out at different times."""
    rng = random.Random(8)
    stock = [(k, y, K.ORDER_COLOURS[y], True, None, None) for k in range(12) for y in range(4)]
    log = [(i, "reserve", f"o{rng.randrange(45)}", rng.choice([1, 2, 3]), rng.choice(["red", "red", "red", "green", "blue"])) for i in range(260)]
    replies, after = L.apply_stock_log(spark.createDataFrame(stock, L.STOCK), spark.createDataFrame(log, REQUESTS), chunk_width=32)
    want, grid = _fold(stock, log)
    assert _replies(replies) == want and _cells(after) == grid


@pytest.mark.parametrize("seed", [5, 6])
def test_empty_stock(spark, seed):
    """Little or nothing is free: held, fetched, unknown and zero requests are told apart without rounds."""
    rng = random.Random(seed)
    stock = [(k // 4, k % 4, K.ORDER_COLOURS[k % 4], k % 3 > 0, f"h{k % 6}" if k % 3 else None, None if k % 3 else f"h{k % 5}") for k in range(24)]
    if seed == 6:
        stock[4] = (1, 0, K.ORDER_COLOURS[0], True, None, None)  # one free cell, of which every request asks too many
    log = [(s, k, o, (3 if n else n) if seed == 6 else n, c) for s, k, o, n, c in _log(rng, 60, 0.0)] + [(999, "reserve", "z", 0, "red")]
    replies, after = L.apply_stock_log(spark.createDataFrame(stock, L.STOCK), spark.createDataFrame(log, REQUESTS), chunk_width=64)
    want, grid = _fold(stock, log)
    assert _replies(replies) == want and _cells(after) == grid


def test_refused_requests_are_not_passed_on(spark, monkeypatch):
    """Without free cells and restores there are no rounds, epochs or running counts over the requests."""
    from blockyard.operators import stock as S
    stock = spark.createDataFrame([(0, 0, "RED", True, "h", None)], L.STOCK)
    log = spark.createDataFrame([(1, "reserve", "a", 1, "red"), (2, "reserve", "h", 1, "red"), (3, "fetch", "h", None, None)], REQUESTS)

    def passes(*a, **k):
        raise AssertionError("a pass over all requests")

    monkeypatch.setattr(S, "running", passes)
    monkeypatch.setattr(L, "running_many", passes)
    replies, after = L.apply_stock_log(stock, log)
    assert {k: v[0] for k, v in _replies(replies).items()} == {1: 409, 2: 409, 3: 200}
    assert _cells(after) == [(0, 0, "RED", False, None, "h")]


def test_empty_log(spark):
    stock = spark.createDataFrame([(0, 0, "RED", True, None, None)], L.STOCK)
    replies, after = L.apply_stock_log(stock, spark.createDataFrame([], REQUESTS))
    assert replies.count() == 0 and after.count() == 1


def test_stream_survives_a_crash(spark):
    rng = random.Random(4)
    stock, log = _stock(rng, 60), _log(rng, 60, 0.02)
    path, replies, ckpt = (fresh_path(spark, n) for n in ("log", "replies", "ckpt"))
    write_ordered_log(spark.createDataFrame(log, REQUESTS), path, n_files=3)
    table = StockTable(spark, fresh_path(spark, "stock")).load(spark.createDataFrame(stock, L.STOCK))
    stream = read_log_stream(spark, path, REQUESTS)

    class Crashing(StockTable):
        def write(self, version, after):
            super().write(version, after)
            if version == 2:  # replies and stock are written, the batch is not committed
                raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        reserve_stream(stream, Crashing(spark, table.path), replies, ckpt).awaitTermination()
    reserve_stream(stream, table, replies, ckpt).awaitTermination()
    want, grid = _fold(stock, log)
    assert _replies(spark.read.parquet(replies)) == want and _cells(table.read(3)) == grid
