"""Sets of pairs that belong to wallets: their highest correlation, trades of one pair that another pair's are near to, common wallets of pairs."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlspike.functions.cells import micros

#: Pairs in a block of the correlation matrix.
BLOCK = 2048
#: Microseconds in a slot, slots in a part.
SLOT, PART = 600_000_000, 144
#: Cells of a table of trades and near pairs held at once.
_CELLS = 1 << 20
#: Pairs in a block of the matrix of common wallets, and its lines in a row that goes back to Spark.
SIDE, _ROWS = 2048, 64


def _apart(codes: np.ndarray) -> dict[int, np.ndarray]:
    """Places of each code."""
    order = np.argsort(codes, kind="stable")
    found, at = np.unique(codes[order], return_index=True)
    return dict(zip(found.tolist(), np.split(order, at[1:])))


def _best(table: pa.Table) -> pa.Table:
    block, n, s = (table[c].to_numpy() for c in ("block", "n", "s"))
    low, high, every = (table[c][0].as_py() for c in ("low", "high", "all"))
    days, place = np.unique(pc.list_flatten(table["days"]).to_numpy(), return_inverse=True)
    ranks = np.zeros((len(n), len(days)))
    ranks[np.repeat(np.arange(len(n)), pc.list_value_length(table["days"]).to_numpy()), place] = pc.list_flatten(table["ranks"]).to_numpy()
    a, b = np.flatnonzero(block == low), np.flatnonzero(block == high)
    r = ranks[a] @ ranks[b].T - every * np.outer(n[a], n[b]) / 4
    with np.errstate(divide="ignore", invalid="ignore"):
        r /= np.sqrt(np.outer(s[a], s[b]))
    r[s[a] <= 0], r[:, s[b] <= 0] = -np.inf, -np.inf
    if low == high:
        np.fill_diagonal(r, -np.inf)
    wallets = pc.list_flatten(table["wallets"]).combine_chunks().dictionary_encode()
    code, owner = wallets.indices.to_numpy(), np.repeat(np.arange(len(n)), pc.list_value_length(table["wallets"]).to_numpy())
    local = np.empty(len(n), int)
    local[a], local[b] = np.arange(len(a)), np.arange(len(b))
    inside = [(_apart(code[k]), local[owner[k]]) for k in (np.isin(owner, a), np.isin(owner, b))]
    (left, rows), (right, columns) = inside
    found = [(w, r[np.ix_(rows[k], columns[right[w]])].max()) for w, k in left.items() if w in right]
    found = [(w, x) for w, x in found if x > -np.inf]
    return pa.table({"wallet": wallets.dictionary.take(pa.array([w for w, _ in found], pa.int64())), "r": pa.array([x for _, x in found], pa.float64())})


def best_rank_correlation(members: DataFrame, ranks: DataFrame, per: DataFrame) -> DataFrame:
    """(wallet, r): the highest rank correlation of two pairs of a wallet's set (``members``: wallet, pair_key).

    ``ranks`` and ``per`` are those of ``daily_ranks``; all sums are exact, so r
    is the same number as by joins. Pairs are cut into blocks; each two blocks
    meet in one Arrow group as a product of matrices, of which only the highest
    value per wallet comes out: no pair of pairs is a row. A wallet without two
    pairs of varying ranks doesn't come out.
    """
    days = ranks.groupBy("pair_key").agg(F.collect_list(F.struct(F.unix_date("day").alias("day"), "e")).alias("x"))
    sets = members.groupBy("pair_key").agg(F.collect_list("wallet").alias("wallets"))
    blocks = max(1, math.ceil(members.select("pair_key").distinct().count() / BLOCK))
    block = F.pmod(F.xxhash64("pair_key"), F.lit(blocks)).cast("long")
    rows = sets.join(days, "pair_key").join(per, "pair_key").select(
        block.alias("block"), "n", "all", F.col("s").cast("double").alias("s"), F.col("x.day").alias("days"), F.col("x.e").alias("ranks"), "wallets", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("far")
    )
    cells = rows.withColumns({"low": F.least("block", "far"), "high": F.greatest("block", "far")}).drop("far")
    return cells.groupBy("low", "high").applyInArrow(_best, "wallet string, r double").groupBy("wallet").agg(F.max("r").alias("r"))


def _near(table: pa.Table) -> pa.Table:
    kind = table["kind"].to_numpy()
    t, hi = table["t"].to_numpy(), table["hi"].to_numpy()
    pair = table["pair_key"].combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
    names = table["wallet"].combine_chunks().dictionary_encode()
    wallet = names.indices.fill_null(-1).to_numpy().astype(np.int64)
    own, spans, sets = (np.flatnonzero(kind == k) for k in (0, 1, 2))
    width = pair.max() + 1
    keys = np.unique(wallet[sets] * width + pair[sets])
    slot = t // SLOT
    by = _apart(slot[spans])
    none = np.empty(0, int)
    hit = np.zeros(len(t), bool)
    for at, k in (_apart(slot[own]) if len(keys) else {}).items():
        mine = own[k]
        near = spans[np.concatenate([by.get(at + d, none) for d in (-1, 0, 1)])]
        step = max(1, _CELLS // max(1, len(mine)))
        for start in range(0, len(near), step):
            q = near[start : start + step]
            w, which = np.unique(wallet[mine], return_inverse=True)
            p, column = np.unique(pair[q], return_inverse=True)
            wanted = (w[:, None] * width + p).ravel()
            has = (keys[np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)] == wanted).reshape(len(w), len(p))
            close = (slot[q] == at) | ((t[mine][:, None] - hi[q] <= SLOT) & (t[q] - t[mine][:, None] <= SLOT))
            hit[mine] |= (close & has[which][:, column] & (pair[mine][:, None] != pair[q])).any(axis=1)
    w, which = np.unique(wallet[own], return_inverse=True)
    return pa.table({
        "wallet": names.dictionary.take(pa.array(w)).cast(pa.string()), "n": pa.array(np.bincount(which, minlength=len(w)), pa.int64()),
        "b": pa.array(np.bincount(which, weights=hit[own], minlength=len(w)).astype(np.int64), pa.int64()),
    })


def near_other_pairs(mine: DataFrame, members: DataFrame, trades: DataFrame) -> DataFrame:
    """(wallet, n, b): trades of a wallet in the pairs of its set, and those of them with anybody's trade in another pair of the set within ten minutes.

    ``mine``: wallet, pair_key, ts; ``members``: wallet, pair_key; ``trades``:
    pair_key, ts. Of a pair's trades in a slot of ten minutes only the first and
    the last count. A part is a day of slots with the slot before and after it,
    and has the sets' pairs that trade there; a set's pairs and a wallet's trades
    meet slot by slot, so none is joined with all the others.
    """
    t = micros("ts")
    part = lambda x: F.floor(F.floor(x / F.lit(SLOT)) / F.lit(PART)).cast("long")
    spans = trades.groupBy("pair_key", F.floor(t / F.lit(SLOT)).alias("slot")).agg(F.min(t).alias("t"), F.max(t).alias("hi"))
    spans = spans.join(members.select("pair_key").distinct(), "pair_key", "left_semi")
    parts = F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor((F.col("slot") + k) / F.lit(PART)).cast("long")))
    spans = spans.select(F.explode(parts).alias("part"), "pair_key", "t", "hi")
    own = mine.select(part(t).alias("part"), "wallet", "pair_key", t.alias("t"))
    sets = members.join(spans.select("pair_key", "part").distinct(), "pair_key").join(own.select("wallet", "part").distinct(), ["wallet", "part"], "left_semi")
    zero, nobody = F.lit(0).cast("long"), F.lit(None).cast("string")
    rows = own.select("part", F.lit(0).alias("kind"), "wallet", "pair_key", "t", F.col("t").alias("hi"))
    rows = rows.unionByName(spans.select("part", F.lit(1).alias("kind"), nobody.alias("wallet"), "pair_key", "t", "hi"))
    rows = rows.unionByName(sets.select("part", F.lit(2).alias("kind"), "wallet", "pair_key", zero.alias("t"), zero.alias("hi")))
    found = rows.groupBy("part").applyInArrow(_near, "wallet string, n long, b long")
    return found.groupBy("wallet").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))


def _common(table: pa.Table) -> pa.Table:
    table = table.sort_by("number").combine_chunks()
    low, high = table["low"][0].as_py(), table["high"][0].as_py()
    block, offsets = table["number"].to_numpy() // SIDE, np.concatenate([[0], np.cumsum(pc.list_value_length(table["wallets"]).to_numpy())])
    codes, names, sides = pc.list_flatten(table["wallets"]).to_numpy(), table["pair_key"].combine_chunks(), []
    for k in (low, high):
        first, last = np.searchsorted(block, [k, k + 1])
        code, row = codes[offsets[first] : offsets[last]], np.repeat(np.arange(last - first), np.diff(offsets[first : last + 1]))
        order = np.argsort(code, kind="stable")
        sides.append((names.slice(first, last - first), row[order], *np.unique(code[order], return_index=True, return_counts=True)))
    (left, rows, wallets_a, at_a, k_a), (right, columns, wallets_b, at_b, k_b) = sides
    _, i, j = np.intersect1d(wallets_a, wallets_b, assume_unique=True, return_indices=True)
    at_a, k_a, at_b, k_b = at_a[i], k_a[i], at_b[j], k_b[j]
    work = k_a * k_b
    counts = np.zeros((len(left), len(right)), np.int32)
    # wallets of many pairs as a product of matrices, in which counts up to 2^24 are exact
    many = np.flatnonzero(work * 32 > counts.size)
    for start in range(0, len(many), 256):
        some = many[start : start + 256]
        x, y = np.zeros((len(left), len(some)), np.float32), np.zeros((len(right), len(some)), np.float32)
        for c, w in enumerate(some):
            x[rows[at_a[w] : at_a[w] + k_a[w]], c] = 1
            y[columns[at_b[w] : at_b[w] + k_b[w]], c] = 1
        counts += (x @ y.T).astype(np.int32)
    few = np.flatnonzero(work * 32 <= counts.size)
    for some in np.split(few, np.flatnonzero(np.diff(np.cumsum(work[few]) // _CELLS)) + 1):
        which = np.repeat(some, work[some])
        within = np.arange(len(which)) - np.repeat(np.cumsum(work[some]) - work[some], work[some])
        r, c = rows[at_a[which] + within // k_b[which]], columns[at_b[which] + within % k_b[which]]
        np.add.at(counts.reshape(-1), r * len(right) + c, np.int32(1))
    if low == high:
        counts = np.triu(counts, 1)
    edges = np.append(np.arange(0, len(left), _ROWS), len(left)).astype(np.int32)
    steps = np.arange(len(edges), dtype=np.int32)
    others = right.take(pa.array(np.tile(np.arange(len(right)), len(edges) - 1)))
    return pa.table({
        "names": pa.ListArray.from_arrays(pa.array(edges), left), "others": pa.ListArray.from_arrays(pa.array(steps * len(right)), others),
        "counts": pa.ListArray.from_arrays(pa.array(edges * len(right)), pa.array(counts.reshape(-1))),
    })


def common_wallets(pairs: DataFrame, wallets: DataFrame, members: DataFrame) -> DataFrame:
    """(pair_key, other, wallets): for each two pairs with common wallets, in order of name, how many.

    ``members``: distinct wallet, pair_key; ``pairs`` and ``wallets``: their
    names as numbered from 0, pairs in order. Pairs are cut into blocks of
    2,048; each two blocks meet in one Arrow group as a matrix of counts, which
    is laid out as rows where it isn't zero. What a wallet of k pairs adds, k^2 / 2
    combinations, is so summed where it arises and never shuffled; each (wallet,
    pair) is sent once to every block.
    """
    ids = members.join(wallets.select("wallet", F.col("number").cast("int").alias("w")), "wallet").groupBy("pair_key").agg(F.collect_list("w").alias("wallets"))
    rows = ids.join(pairs.select("pair_key", "number"), "pair_key")
    blocks = max(1, math.ceil(pairs.count() / SIDE))
    far = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("far")
    block = F.floor(F.col("number") / F.lit(SIDE)).cast("long")
    cells = rows.select("pair_key", "number", "wallets", far).select("pair_key", "number", "wallets", F.least(block, "far").alias("low"), F.greatest(block, "far").alias("high"))
    cells = cells.repartition(min(200, blocks * (blocks + 1) // 2), "low", "high")
    found = cells.groupBy("low", "high").applyInArrow(_common, "names array<string>, others array<string>, counts array<int>")
    laid = found.select("names", "others", F.posexplode("counts").alias("at", "k")).filter("k > 0")
    width = F.size("others")
    return laid.select(
        F.get("names", F.expr("CAST(at div size(others) AS INT)")).alias("pair_key"), F.get("others", F.col("at") % width).alias("other"), F.col("k").cast("long").alias("wallets")
    )
