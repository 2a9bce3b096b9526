import json
import random

from pyspark.sql import functions as F

from marlspike.operators.drift_schema import appearing_kinds, field_names, field_rows, schema_changes, tagged_union, unified_records
from tests.conftest import rows


def frame(spark, data):
    df = spark.createDataFrame(data, "feed string, seq int, payload string, path string, value string")
    return df.withColumn("rid", F.get_json_object("payload", "$.id"))


def kind(v):
    return None if v is None else "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else "object" if isinstance(v, dict) else "array"


def brute(data):
    files = {}
    for feed, seq, payload, *_ in data:
        try:
            rec = json.loads(payload)
        except (TypeError, ValueError):
            continue
        if isinstance(rec, dict) and feed is not None and seq is not None:
            files.setdefault((feed, seq), []).append(rec)
    out = []
    for feed in {f for f, _ in files}:
        seqs = sorted(s for f, s in files if f == feed)
        for a, b in zip(seqs, seqs[1:]):
            old, new = files[feed, a], files[feed, b]
            names = lambda recs: {k for r in recs for k in r}
            gone, fresh = sorted(names(old) - names(new)), sorted(names(new) - names(old))
            by_id = lambda recs: {r["id"]: r for r in recs if r.get("id") is not None}
            o, n = by_id(old), by_id(new)
            both = o.keys() & n.keys()
            taken, renamed = set(), set()
            for g in gone:
                for f in fresh:
                    pairs = [(o[i].get(g), n[i].get(f)) for i in both]
                    if f not in taken and any(x is not None for x, _ in pairs) and all(x == y and kind(x) == kind(y) for x, y in pairs):
                        out.append((feed, b, "renamed", g, f))
                        taken.add(f)
                        renamed.add(g)
                        break
            out += [(feed, b, "removed", g, "") for g in gone if g not in renamed]
            out += [(feed, b, "added", f, "") for f in fresh if f not in taken]
            for f in names(old) & names(new):
                k = [{kind(r.get(f)) for r in recs} - {None} for recs in (old, new)]
                if k[0] and k[1] and k[0] != k[1]:
                    out.append((feed, b, "retyped", f, ""))
    return sorted(out, key=repr)


def changes(spark, data):
    fields = field_rows(frame(spark, data), "payload", ["feed", "seq", "rid"])
    return rows(schema_changes(fields, "feed", "seq", "rid"))


def test_changes_against_brute_force(spark):
    rng = random.Random(5)
    data = []
    for feed in ("a", "b", "c"):
        names = {"id": "id", "x": "x", "y": "y", "z": "z"}
        records, number = {}, 0
        for seq in (1, 2, 4, 5, 9):
            what = rng.choice(list(names.values())[1:])
            for k, v in list(names.items()):
                if v == what and k != "id":
                    action = rng.choice(["rename", "drop", "type", "keep"])
                    if action == "rename":
                        names[k] = v + "_n"
                    elif action == "drop":
                        names.pop(k)
            if rng.random() < 0.5:
                names[f"w{seq}"] = f"w{seq}"
            for i in range(max(0, number - 3), number + 6):
                base = records.setdefault(i, {k: rng.choice([rng.randrange(99), f"s{rng.randrange(9)}", None, True, {"q": 1}]) for k in [*"xyz", *(f"w{s}" for s in range(10))]})
                rec = {names[k]: (f"{feed}{i}" if k == "id" else base[k]) for k in names if k == "id" or rng.random() > 0.2}
                data.append((feed, seq, json.dumps(rec), "clash", None))
            number += 6
            data.append((feed, seq, '{"id": "broken', None, None))
    data += [(None, 1, '{"id":"n"}', None, None), ("a", None, "{}", None, None), ("a", 3, None, None, None), ("a", 3, "[1]", None, None), ("a", 3, "", None, None)]
    assert changes(spark, data) == brute(data)


def test_empty_and_first_file(spark):
    assert changes(spark, []) == []
    assert changes(spark, [("a", 1, '{"id":"1","x":1}', None, None)]) == []


def test_union_and_appearing(spark):
    data = [("a", 1, '{"id":"1","x":1}', None, None), ("a", 2, '{"id":"2","x":"s"}', None, None), ("b", 1, '{"id":"3","x":null}', None, None)]
    fields = field_rows(frame(spark, data), "payload", ["feed", "seq"])
    assert ("x", ["number", "string"], 3, 2) in rows(tagged_union(fields, []))
    assert ("a", "x", "string", 2, 1) in rows(appearing_kinds(fields, "feed", "seq"))


def test_unified(spark):
    data = [
        ("a", 1, '{"id":"1","x":1,"o":{"b":2},"f":true}', None, None), ("a", 2, '{"id":"1","xx":1}', None, None),
        ("a", 2, '{"id":"2","xx":"5","extra":[1]}', None, None), ("a", 3, '{"id":"2","xxx":"5"}', None, None), ("a", 3, '{"id":null}', None, None),
        # another feed begins with the later name and has it beside a foreign one
        ("b", 1, '{"id":"9","xxx":7,"y":1}', None, None), ("b", 2, '{"id":"9","xxx":7,"z":1}', None, None), ("b", 3, '{"id":"9","y":null,"z":"t"}', None, None),
    ]
    fields = field_rows(frame(spark, data), "payload", ["feed", "seq", "rid"])
    names = field_names(fields, schema_changes(fields, "feed", "seq", "rid"), ["feed", "seq"])
    # x, xx and xxx are one field; y and z stand together in a file, so they aren't
    assert names["x"] == names["xx"] == names["xxx"] == "xxx" and names["y"] == "y" and names["z"] == "z"
    u = unified_records(fields, names, ["feed", "seq", "rid"])
    got = {(r["feed"], r["seq"], r["rid"]): r for r in u.collect()}
    one, two = got["a", 1, "1"], got["a", 2, "2"]
    assert (one["xxx"], one["xxx__kind"], one["xxx__number"], one["xxx__string"]) == ("1", "number", 1.0, None)
    assert (one["o__object"], one["f__boolean"], one["extra"]) == ('{"b":2}', True, None)
    assert (two["xxx"], two["xxx__kind"], two["xxx__number"], two["xxx__string"], two["extra__array"]) == ("5", "string", 5.0, "5", "[1]")
    assert got["b", 1, "9"]["xxx__number"] == 7.0 and got["a", 3, None]["id"] is None
    assert len(got) == 8 and "xx" not in u.columns


def test_unified_empty(spark):
    fields = field_rows(frame(spark, []), "payload", ["feed", "seq", "rid"])
    assert field_names(fields, schema_changes(fields, "feed", "seq", "rid"), ["feed", "seq"]) == {}
    assert unified_records(fields, {}, ["feed", "seq", "rid"]).count() == 0
