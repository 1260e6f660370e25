from __future__ import annotations

import json
from collections import Counter, defaultdict

from cairn.operators import schema_drift as S
from cairn.runtime import table

COLS = "line_id long, feed string, file_name string, written_on timestamp, line_no int, line string, loaded_at timestamp"


def lines(spark, files):
    """files: {name: [objects or raw strings]} of one feed, in order of time."""
    rows, k = [], 0
    for n, (name, items) in enumerate(files.items()):
        for i, x in enumerate(items):
            k += 1
            rows.append((k, "f", name, f"2024-01-{n + 1:02d} 00:00:00", i + 1, x if x is None or isinstance(x, str) else json.dumps(x), "2024-02-01 00:00:00"))
    return spark.createDataFrame(rows, "line_id long, feed string, file_name string, w string, line_no int, line string, l string").selectExpr("line_id", "feed", "file_name", "cast(w as timestamp) written_on", "line_no", "line", "cast(l as timestamp) loaded_at")


def got(df):
    return sorted(tuple(r) for r in S.found(df).collect())


def kind(v):
    return {str: "string", bool: "boolean", int: "number", float: "number", list: "array", dict: "object"}[type(v)]


def brute(rows):
    """The rules as stated, over plain Python objects."""
    files, when = defaultdict(dict), {}
    for r in rows:
        when.setdefault(r.feed, {})[r.file_name] = r.written_on
        line = (r.line or "").lstrip("\ufeff").strip()
        try:
            x = json.loads(line)
        except ValueError:
            continue
        if isinstance(x, dict):
            files[r.file_name].setdefault(r.line_no, x)
    out = []
    for names in when.values():
        order = sorted(names, key=lambda n: names[n])
        for before, after in zip(order, order[1:]):
            facts = []
            for f in (before, after):
                values, kinds = defaultdict(dict), defaultdict(Counter)
                for no, x in files[f].items():
                    for a, v in x.items():
                        if a == "id" or v is None:
                            continue
                        values[a][x.get("id"), no] = v
                        kinds[a][kind(v)] += 1
                        for b in v if isinstance(v, dict) else ():
                            if v[b] is not None:
                                values[f"{a}.{b}"][x.get("id"), no] = v[b]
                                kinds[f"{a}.{b}"][kind(v[b])] += 1
                        inner = defaultdict(list)
                        for e in v if isinstance(v, list) else ():
                            for b in e if isinstance(e, dict) else ():
                                if e[b] is not None:
                                    inner[b].append(e[b])
                        for b, vs in inner.items():
                            values[f"{a}[].{b}"][x.get("id"), no] = vs
                            kinds[f"{a}[].{b}"][kind(vs[0])] += 1
                has = {p: kinds[p].most_common(1)[0][0] for p in values if len(values[p]) * 10 >= len(files[f])}
                facts.append((values, has))
            (v0, h0), (v1, h1) = facts
            gone, new = [p for p in h0 if p not in h1], [p for p in h1 if p not in h0]
            retyped = [p for p in h0 if p in h1 and h0[p] != h1[p]]
            top = {p for p in gone + new + retyped if "." not in p}
            parent = lambda p: p.split("[].")[0] if "[]." in p else p.split(".")[0]
            below = lambda p: "." in p and parent(p) in top
            gone, new, retyped = ([p for p in x if not below(p)] for x in (gone, new, retyped))
            for p in gone:
                a = {k[0]: v for k, v in v0[p].items()}
                best = None
                for q in new:
                    b = {k[0]: v for k, v in v1[q].items()}
                    both = [i for i in a if i is not None and i in b]
                    same = sum(a[i] == b[i] for i in both)
                    if both and same * 2 > len(both):
                        best = q
                if best:
                    new.remove(best)
                    out.append((after, p, "renamed", best))
                else:
                    out.append((after, p, "removed", ""))
            out += [(after, p, "added", "") for p in new] + [(after, p, "retyped", h1[p]) for p in retyped]
    return sorted(out)


def test_against_brute_force(spark, sf):
    df = table(spark, sf, "distill_lines")
    assert got(df) == brute(df.orderBy("loaded_at", "line_id").collect())


def test_each_change(spark):
    df = lines(spark, {
        "b": [{"id": i, "q": f"x{i}", "n": i, "o": {"a": 1, "b": "t"}, "l": [{"from": "u", "v": str(i)}], "gone": "z"} for i in range(10)],
        "a": [{"id": i, "query": f"x{i}", "n": str(i), "o": {"a": 1, "c": True}, "l": [{"who": "u", "v": str(i)}], "more": i} for i in range(5, 15)],
    })
    assert got(df) == [
        ("a", "gone", "removed", ""), ("a", "l[].from", "renamed", "l[].who"), ("a", "more", "added", ""), ("a", "n", "retyped", "string"), ("a", "o.b", "removed", ""), ("a", "o.c", "added", ""), ("a", "q", "renamed", "query"),
    ]


def test_nothing_below_a_changed_field(spark):
    df = lines(spark, {"a": [{"id": i, "o": {"x": i}, "p": {"y": 1}} for i in range(4)], "b": [{"id": i, "o": [{"z": 1}], "r": {"w": 1}} for i in range(4)]})
    assert got(df) == [("b", "o", "retyped", "array"), ("b", "p", "removed", ""), ("b", "r", "added", "")]


def test_dirt(spark):
    a = [{"id": 1, "t": "x"}, "\ufeff" + json.dumps({"id": 2, "t": "y"}), "// end", '{"id": 3, "t"', None, "", "7", '"s"', "[1]", json.dumps({"id": 4, "t": "z"}) + " x"]
    b = [{"id": k, "t": str(k), **({"stray": 1} if k == 0 else {})} for k in range(11)]
    df = lines(spark, {"a": a, "b": b})
    assert got(df.unionByName(df)) == []  # a stray field is under a tenth, repeated loads count once
    assert S.records(df).where("file_name = 'a'").count() == 2


def test_empty_and_clashing_columns(spark):
    df = lines(spark, {"a": [{"id": 1, "t": 1}], "b": [{"id": 1, "u": 1}]})
    assert got(df.where("false")) == []
    from pyspark.sql import functions as F

    assert got(df.withColumn("version", F.lit(1)).withColumn("path", F.lit("x")).withColumn("n", F.lit(2))) == [("b", "t", "renamed", "u")]


def test_file_without_records(spark):
    df = lines(spark, {"a": [{"id": 1, "t": 1}], "b": ["nothing"], "c": [{"id": 1, "t": 1}]})
    assert got(df) == [("b", "t", "removed", ""), ("c", "t", "added", "")]


def test_merged_table(spark):
    df = lines(spark, {
        "a": [{"id": f"r{i}", "instruction": f"do {i}", "conversations": [{"from": "human", "value": "h"}]} for i in range(5)],
        "b": [{"id": f"r{i}", "query": [f"do {i}"], "turns": [{"from": "human", "value": "h"}]} for i in range(5)] ,
        "c": [{"id": f"r{i}", "query": [f"do {i}"], "turns": [{"speaker": "human", "value": "h"}]} for i in range(5)],
        "d": [{"id": f"r{i}", "query": {"text": f"do {i}"}, "turns": {"items": [{"speaker": "human", "value": "h"}]}} for i in range(5)],
    })
    # renamed and retyped at once is removed and added, so the first step keeps the type
    first = lines(spark, {"a": [{"id": f"r{i}", "instruction": f"do {i}"} for i in range(5)], "b": [{"id": f"r{i}", "query": f"do {i}"} for i in range(5)], "c": [{"id": f"r{i}", "query": {"text": f"do {i}"}} for i in range(5)]})
    assert {r.instruction for r in S.merged(first).collect()} == {f"do {i}" for i in range(5)}
    m = S.merged(df).collect()
    assert len(m) == 20 and all(json.loads(r.conversations) == [{"from": "human", "value": "h"}] for r in m)


def test_long_chains_of_renames(spark):
    """Eleven versions, a new name in each; fields that come, go and come again; values no rule can cast."""
    import datetime as dt
    import json

    rows, n = [], 0
    for v in range(11):
        for k in range(12):
            n += 1
            rec = {"id": k, f"text{v}" if v else "source_text": f"say {k}", "instruction": f"do {k}", f"turns{v // 4}" if v >= 4 else "messages": [{f"who{v // 3}" if v >= 3 else "role": "user", "content": f"c{k}"}]}
            if v % 4 != 3:
                rec["note"] = k + 0.5
            if v == 10 and k == 3:
                rec[f"turns{v // 4}"] = "not turns"
            if k == 0 and v == 2:
                rec["stray"] = {"a": 1}
            rows.append((n, "f", f"f-{(v * 7) % 11}.jsonl", dt.datetime(2024, 1, 1 + v), k, json.dumps(rec), dt.datetime(2024, 2, 1)))
    df = spark.createDataFrame(rows, "line_id long, feed string, file_name string, written_on timestamp, line_no int, line string, loaded_at timestamp")
    got = S.merged(df).collect()
    assert len(got) == 132 and all(r.source_text == f"say {r.id}" and r.instruction == f"do {r.id}" for r in got)
    bad = [r for r in got if r.lost]
    assert [(r.version, r.id, [tuple(x) for x in r.lost]) for r in bad] == [(10, "3", [("messages", "not turns")])]
    assert all([tuple(m) for m in r.messages] == [("user", f"c{r.id}")] for r in got if not r.lost)
    others = {(r.version, r.id): [tuple(x) for x in r.others] for r in got}
    assert others[2, "0"] == [("note", "note", "0.5"), ("stray", "stray", '{"a":1}')] and others[3, "5"] == [] and others[10, "7"] == [("note", "note", "7.5")]
    prints = {r.version: r for r in S.schema_versions(df).collect()}
    assert len({r.fingerprint for r in prints.values()}) == 11 and all(r.first_version == v for v, r in prints.items())


def test_versions_reuse_fingerprints(spark):
    import datetime as dt
    import json

    shapes = [{"id": 1, "a": "x"}, {"id": 1, "a": "x", "b": 2}, {"id": 1, "a": "y"}]
    rows = [(k, "f", f"{k}.jsonl", dt.datetime(2024, 1, 1 + k), 0, json.dumps(r), dt.datetime(2024, 2, 1)) for k, r in enumerate(shapes)] + [(9, "f", "9.jsonl", dt.datetime(2024, 1, 9), 0, "no json", dt.datetime(2024, 2, 1))]
    df = spark.createDataFrame(rows, "line_id long, feed string, file_name string, written_on timestamp, line_no int, line string, loaded_at timestamp")
    got = {r.version: (r.first_version, r.fields, r.records) for r in S.schema_versions(df).collect()}
    assert got == {0: (0, 1, 1), 1: (1, 2, 1), 2: (0, 1, 1), 3: (None, 0, 0)}


def test_merged_and_versions_of_nothing(spark):
    df = spark.createDataFrame([], "line_id long, feed string, file_name string, written_on timestamp, line_no int, line string, loaded_at timestamp, m string, rule string, names string")
    assert S.merged(df).count() == 0 and S.schema_versions(df).count() == 0
