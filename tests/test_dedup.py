import datetime as dt
import random

from pyspark.sql import functions as F

from marlspike.operators.dedup import MessageStore, copies_removed, first_copies
from marlspike.session import shared_dir
from tests.conftest import rows

SCHEMA = "row long, at timestamp_ntz, token string, id string, o0 string, kept string"


def t(n):
    return None if n is None else dt.datetime(2026, 1, 1) + dt.timedelta(hours=n)


def one_id_per_token(data):
    """The data, where a token that stands under several ids stands under the least."""
    least = {}
    for _, _, tok, i, *_ in data:
        tok, i = (tok or "").strip(), (i or "").strip()
        if tok and i:
            least[tok] = min(least.get(tok, i), i)
    return [(r, a, tok, least.get((tok or "").strip(), i), *rest) for r, a, tok, i, *rest in data]


def brute(data):
    """Rows left out, straight from the definition by connected components."""
    clean = [(r, a, (tok or "").strip() or None, (i or "").strip() or None) for r, a, tok, i, *_ in data]
    group = {r[0]: r[0] for r in clean}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for x in clean:
        for y in clean:
            same = (x[2] and x[2] == y[2]) or (x[3] and x[3] == y[3] and (x[2] is None or y[2] is None))
            if same:
                group[find(x[0])] = find(y[0])
    best = {}
    for r in clean:
        key = (r[1] is not None, r[1] or dt.datetime.min, r[0])
        best[find(r[0])] = min(best.get(find(r[0]), key), key)
    return sorted(r[0] for r in clean if r[0] != best[find(r[0])][2])


def keep_first(df, ident="id"):
    return first_copies(df, F.col("token"), F.col(ident) if ident else None, [F.col("at"), F.col("row")], [F.col("row")])


def test_copies_against_definition(spark):
    rng = random.Random(4)
    data = []
    for r in range(400):
        op = rng.randrange(60)
        token = rng.choice([f"{op}-0", f" {op}-0 ", f"{op}-0\n", None, "", "  "])
        data.append((r, t(rng.choice([None, *range(30)])), token, str(op), "clash", "clash"))
    data += [(1000 + r, t(1), f"op-{r % 3}", "several", None, None) for r in range(9)]
    data += [(2000 + r, t(r), None, None, None, None) for r in range(3)]
    df = spark.createDataFrame(data, SCHEMA)
    got = sorted(r[0] for r in copies_removed(df.withColumnRenamed("row", "row"), keep_first(df), "row").collect())
    assert got == brute(data)


def test_empty_and_long(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert keep_first(empty).count() == 0
    long = spark.createDataFrame([(1, t(0), "x" * 100_000, "a", None, None), (2, t(1), "x" * 100_000 + " ", "a", None, None)], SCHEMA)
    assert rows(keep_first(long)) == [(1,)]


def test_keys_without_ident(spark):
    df = spark.createDataFrame([(1, t(2), "k", None, None, None), (2, t(1), " k", None, None, None), (3, t(0), None, None, None, None), (4, t(0), None, None, None, None)], SCHEMA)
    assert rows(keep_first(df, None)) == [(2,), (3,), (4,)]


def test_store_merges_only_touched_partitions(spark):
    rng = random.Random(1)
    data = [(r, t(rng.randrange(24 * 6)), f"{r % 150}-0" if r % 7 else None, str(r % 150), None, "x/y=z") for r in range(600)]
    df = spark.createDataFrame(data, SCHEMA)
    store = MessageStore(spark, shared_dir(spark, "store"))
    day = F.date_format("at", "yyyy-MM-dd")
    assert store.merge(df.filter("row < 300"), "token", "id", ["at", "row"], day)["read"] == []
    before = store.manifest()["parts"]
    late = spark.createDataFrame([(9001, t(200), "150-9", "new", None, None)], SCHEMA)
    done = store.merge(late, "token", "id", ["at", "row"], day)
    assert done["read"] == [] and len(done["written"]) == 1
    assert {k: v for k, v in store.manifest()["parts"].items() if k in before} == before
    store.merge(df.filter("row >= 300"), "token", "id", ["at", "row"], day)
    left_out = sorted(r[0] for r in copies_removed(df, store.read(), "row").collect())
    assert left_out == brute(data)
    store.merge(df.filter("row >= 300"), "token", "id", ["at", "row"], day)  # delivered again: nothing changes
    assert sorted(r[0] for r in copies_removed(df, store.read(), "row").collect()) == left_out
    store.merge(df.limit(0), "token", "id", ["at", "row"], day)
    assert store.read().count() == 600 - len(left_out) + 1


def test_blank_id_beside_a_token(spark):
    data = [(1, t(2), "A", "op", None, None), (2, t(1), "A", " ", None, None), (3, t(3), None, "op", None, None), (4, t(0), "B", None, None, None)]
    df = spark.createDataFrame(data, SCHEMA)
    assert rows(keep_first(df)) == [(2,), (4,)]


def merged(spark, batches, ident="id"):
    store = MessageStore(spark, shared_dir(spark, "store"))
    day = F.date_format("at", "yyyy-MM-dd")
    for b in batches:
        store.merge(b, "token", ident, ["at", "row"], day)
    return store


def test_open_id_is_remembered(spark):
    one = spark.createDataFrame([(1, t(0), "A", "op", None, None), (2, t(50), None, "op", None, None)], SCHEMA)
    two = spark.createDataFrame([(3, t(99), "D", "op", None, None)], SCHEMA)
    blank = spark.createDataFrame([(4, t(199), "D", " ", None, None)], SCHEMA)
    store = merged(spark, [one, two, blank])
    assert sorted(r[0] for r in store.read().collect()) == [1]
    # the group's first copy arrives last, on another day: the old winner goes
    store.merge(spark.createDataFrame([(0, t(-50), "D", None, None, None)], SCHEMA), "token", "id", ["at", "row"], F.date_format("at", "yyyy-MM-dd"))
    assert sorted(r[0] for r in store.read().collect()) == [0]


def test_any_steps_give_the_same(spark):
    rng = random.Random(7)
    for trial in range(4):
        data = []
        for r in range(120):
            op = rng.randrange(25)
            token = rng.choice([f"{op}-{rng.randrange(3)}", f" {op}-0 ", None, "", "  "])
            data.append((r, t(rng.choice([None, *range(100)])), token, rng.choice([str(op)] * 5 + [None, " "]), None, None))
        df = spark.createDataFrame(data, SCHEMA)
        want = rows(keep_first(df))
        left = set(brute(one_id_per_token(data)))
        assert [r[0] for r in want] == sorted((r[0] for r in data if r[0] not in left), key=lambda x: repr((x,)))
        rng.shuffle(data)
        cuts = sorted(rng.sample(range(1, 120), trial + 1))
        parts = [data[i:j] for i, j in zip([0, *cuts], [*cuts, 120])]
        frames = [spark.createDataFrame(p, SCHEMA) for p in parts]
        store = merged(spark, frames)
        assert rows(store.read().select("row")) == want
        state = rows(store._entries(store.manifest(), list(store.manifest()["parts"])))
        for f in frames[:2]:
            store.merge(f, "token", "id", ["at", "row"], F.date_format("at", "yyyy-MM-dd"))
        assert rows(store.read().select("row")) == want  # merged again: the same state
        assert rows(store._entries(store.manifest(), list(store.manifest()["parts"]))) == state
        # one entry per key: the index holds nothing of earlier versions
        assert len(state) == len({e[0] for e in state})


def test_partition_of_many_folders_is_rewritten(spark):
    batches = [spark.createDataFrame([(r, t(1), f"k{r}", None, None, None)], SCHEMA) for r in range(10)]
    store = merged(spark, batches)
    assert max(map(len, store.manifest()["parts"].values())) < 8
    assert store.read().count() == 10
    assert store.vacuum() > 0 and store.read().count() == 10
