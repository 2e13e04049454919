"""Components and chains, the search index, appended changes and schemas, against plain versions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from jobweave.functions.schema import problems
from jobweave.operators import batching, dedupe, state
from jobweave.operators.changelog import ChangeLog
from jobweave.operators.components import components
from jobweave.operators.search_index import SearchIndex, listed
from jobweave.plans.structured import BATCH_SCORES, structured


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1300)] + [(2000, 2000), (-5, 7), (3000, 3001), (3000, 3001)]
    low = {}

    def find(x):
        while low.setdefault(x, x) != x:
            x = low[x]
        return x

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        low[q] = p
    want = {x: find(x) for e in edges for x in e if any(x in f and f[0] != f[1] for f in edges)}
    assert {r.id: r.component for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()} == want
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def greedy(rows):
    taken, out = set(), []
    for order, *keys in sorted(rows):
        own = {(k, v) for k, v in enumerate(keys) if v is not None}
        if not own & taken:
            taken |= own
            out.append(order)
    return out


@pytest.mark.parametrize("rounds, most", [(1, 10**6), (2, 5), (6, 10**6)])
def test_first_wins_by_components_and_rounds(spark, rounds, most):
    rng = random.Random(rounds)
    rows = [(k, rng.choice([None, f"a{rng.randrange(60)}"]), f"b{rng.randrange(90)}") for k in range(250)]
    rows += [(1000 + k, f"x{k // 2}", f"y{(k + 1) // 2}") for k in range(41)]
    df = spark.createDataFrame(rows, "o long, a string, b string")
    assert sorted(r.o for r in dedupe.first_wins(df, ["a", "b"], "o", rounds=rounds, most=most).collect()) == greedy(rows)


def test_a_chain_of_ten_thousand_ends_in_a_few_rounds(spark, monkeypatch):
    n, cuts = 10_000, []
    cut = dedupe.cut_lineage
    monkeypatch.setattr(dedupe, "cut_lineage", lambda df: cuts.append(1) or cut(df))
    chain = spark.createDataFrame([(k, f"a{k // 2}", f"b{(k + 1) // 2}") for k in range(n)], "o long, a string, b string")
    assert sorted(r.o for r in dedupe.first_wins(chain, ["a", "b"], "o", rounds=2).collect()) == list(range(0, n, 2))
    assert len(cuts) < 12  # of some 10,000


def test_search_equals_a_scan(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abAé%_ ") for _ in range(rng.randrange(9)))
    rows = [(k, word(), word() if k % 5 else None) for k in range(300)] + [(999, "aaaaaaa", "")]
    index = SearchIndex(spark, f"{tmp_path}/index", cells=8)
    assert index.search("a") is None
    df = spark.createDataFrame(rows, "id long, title string, company string")
    assert index.add(df.where("id < 150"), "1", ["title", "company"]) and index.add(df.where("id >= 150"), "2", ["title", "company"]) and not index.add(df, "2", ["title", "company"])
    for term in ("a", "ab", "aba", "aaaa", "é%", "_", "b a", "abé_", "%%%", "zz", "AB", " ab "):
        t = term.strip().lower()
        want = {}
        for i, *texts in rows:
            texts = [(x or "").lower() for x in texts]
            if any(t in x for x in texts):
                want[i] = 0 if t in texts else 1 if any(x.startswith(t) for x in texts) else 2
        assert {r.id: r.rank for r in index.search(term).collect()} == want, term
    top = listed(df, index, "ab", [F.asc("id")], 5).collect()
    assert len(top) == 5 and [r.rank for r in top] == sorted(r.rank for r in top) and listed(df, index, "a", [F.asc("id")]).count() == 0


def test_a_search_opens_its_own_cells(spark, tmp_path):
    index = SearchIndex(spark, f"{tmp_path}/index", cells=64)
    index.add(spark.createDataFrame([(1, "abcdefghijklmnopqrstuvwxyz0123456789")], "id long, t string"), "1", ["t"])
    plan = index.postings("klm")._jdf.queryExecution().executedPlan().toString()
    assert "cell" in plan.split("PartitionFilters: [")[1].split("]")[0] and "gram" in plan.split("PushedFilters: [")[1].split("]")[0]
    assert index.postings("klm").count() == 1


@pytest.mark.parametrize("patches", [False, True])
def test_changes_equal_a_full_join(spark, tmp_path, patches):
    rng, log, want = random.Random(patches), ChangeLog(spark, f"{tmp_path}/t", ["k"], patches), {}
    assert log.read() is None and not log.compact()
    for turn in range(9):
        wide = turn >= 5  # a column is added
        schema = "k long, x string, y long" + (", z string" if wide else "")
        gone = turn % 4 == 3
        rows = [(k, rng.choice([None, f"x{turn}"]), rng.choice([None, turn]), *([rng.choice([None, f"z{turn}"])] if wide else [])) for k in rng.sample(range(20), 8)]
        assert log.change(spark.createDataFrame(rows, schema), str(turn), gone=gone) and not log.change(spark.createDataFrame(rows, schema), str(turn), gone=gone)
        for k, x, y, *z in rows:
            new = {"x": x, "y": y, "z": z[0] if z else None}
            if gone:
                want.pop(k, None)
            elif patches and k in want:
                want[k] = {c: want[k][c] if v is None else v for c, v in new.items()}
            else:
                want[k] = new
        got = lambda: {r.k: {c: getattr(r, c, None) for c in "xyz"} for r in log.read().collect()}
        assert got() == want
        if turn in (2, 6):
            assert log.compact() and not log.compact() and got() == want


def plain_problems(value, schema, at="$"):
    kinds = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
    is_a = lambda k: (k == "integer" and isinstance(value, int) or k == "number" and isinstance(value, (int, float))) and not isinstance(value, bool) or isinstance(value, kinds.get(k, ()))
    types = schema.get("type")
    if types and not any(is_a(t) for t in ([types] if isinstance(types, str) else types)):
        yield at
    for word, test in (("minimum", lambda b: value < b), ("maximum", lambda b: value > b)):
        if word in schema and is_a("number") and test(schema[word]):
            yield at
    if isinstance(value, dict):
        for n in schema.get("required", []):
            if n not in value:
                yield f"{at}.{n}"
        for n, own in schema.get("properties", {}).items():
            if n in value:
                yield from plain_problems(value[n], own, f"{at}.{n}")
        more = schema.get("additionalProperties")
        for n in value if isinstance(more, dict) else []:
            if n not in schema.get("properties", {}):
                yield from plain_problems(value[n], more, f"{at}.{n}")
    if isinstance(value, list) and "items" in schema:
        for k, x in enumerate(value):
            yield from plain_problems(x, schema["items"], f"{at}[{k}]")


def test_schemas_against_a_plain_reading(spark):
    rng = random.Random(8)
    leaf = lambda: rng.choice([None, True, 3, -1, 300, 2.5, "x", [], {}])

    def result():
        out = {k: leaf() for k in ("id", "score", "error", "reasoning") if rng.random() < 0.7}
        if rng.random() < 0.6:
            out["rubric"] = {c: {"points": leaf(), "note": leaf()} if rng.random() < 0.7 else leaf() for c in "ab"} if rng.random() < 0.8 else leaf()
        return out if rng.random() < 0.9 else leaf()

    values = [{"results": [result() for _ in range(rng.randrange(4))]} if rng.random() < 0.9 else leaf() for _ in range(150)] + [{"results": leaf()} for _ in range(9)]
    got = {r.t: r.p for r in spark.createDataFrame([(json.dumps(v),) for v in values], "t string").select("t", problems(F.col("t"), BATCH_SCORES).alias("p")).collect()}
    for v in values:
        assert sorted(p.partition(": ")[0] for p in got[json.dumps(v)]) == sorted(plain_problems(v, BATCH_SCORES)), v


def test_each_keyword_names_its_path(spark):
    schema = {
        "type": "object",
        "additionalProperties": False,
        "properties": {"s": {"type": "string", "minLength": 2, "maxLength": 3}, "l": {"type": "array", "minItems": 1, "maxItems": 2, "items": {"enum": ["a", 1, None]}}, "n": {"type": "number", "minimum": 0.5}},
    }
    texts = {
        '{"s": "ab", "l": ["a", null], "n": 0.5}': [],
        '{"s": "a"}': ["$.s: is shorter than 2"],
        '{"s": "abcd"}': ["$.s: is longer than 3"],
        '{"l": []}': ["$.l: has fewer items than 1"],
        '{"l": [1, 1, "b"]}': ["$.l: has more items than 2", '$.l[2]: is none of "a", 1, null'],
        '{"n": 0}': ["$.n: is under 0.5"],
        '{"x": 1}': ["$.x: is not known"],
        "{": ["$: is not JSON"],
        "": ["$: is not JSON"],
    }
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", problems(F.col("t"), schema).alias("p")).collect()
    assert {r.t: r.p for r in rows} == texts
    assert spark.range(1).select(problems(F.lit(None).cast("string"), schema).alias("p")).first().p == ["$: is not JSON"]
    with pytest.raises(ValueError, match="pattern"):
        problems(F.lit("{}"), {"pattern": "x"})


def test_structured_answers_ask_once_more(spark, tmp_path):
    calls = f"{tmp_path}/calls"

    def model(prompt):
        with open(calls, "a") as f:
            f.write(prompt.replace("\n", "|") + "\n")
        if prompt.startswith("late"):
            return '{"results": []}' if "IMPORTANT" in prompt else "no"
        return '{"results": 1}'

    rows = structured(spark.createDataFrame([(1, "late"), (2, "never")], "id long, prompt string"), model, BATCH_SCORES)
    got = {r.id: (r.answer, r.error, r.attempts) for r in rows.collect()}
    assert got == {1: ('{"results": []}', None, 2), 2: (None, "invalid JSON after retry: $.results: is bigint, not array", 2)}
    said = open(calls).read().splitlines()
    assert len(said) == 4 and any(s.startswith("never||IMPORTANT") and s.endswith("$.results: is bigint, not array") for s in said)
    assert structured(spark.createDataFrame([], "id long, prompt string"), model, BATCH_SCORES).count() == 0


def test_followups_move_by_the_last_action(spark):
    import datetime as dt

    now = dt.datetime(2026, 3, 1, 12)
    day = lambda n: now + dt.timedelta(days=n)
    apps = spark.createDataFrame([(k, None, day(-3), None) for k in range(1, 7)], "job_id long, last_contact_at timestamp, next_followup_at timestamp, updated_at timestamp")
    actions = spark.createDataFrame(
        [(1, "snooze", 3, 1), (2, "snooze", None, 1), (3, "snooze", 0, 1), (4, "contacted", 30, 1), (5, "contacted", None, 1), (5, "snooze", 2, 2), (6, "opened", 9, 1), (99, "snooze", 1, 1), (None, "snooze", 1, 1)],
        "job_id long, action string, days int, at int",
    )
    got = {r.job_id: (r.last_contact_at, r.next_followup_at, r.updated_at) for r in state.followed_up(apps, actions, F.lit(now)).collect()}
    assert got == {1: (None, day(3), now), 2: (None, day(7), now), 3: (None, day(7), now), 4: (now, day(7), now), 5: (now, day(2), now), 6: (None, day(-3), None)}


def test_items_once_in_order_and_islands_of_one_key(spark):
    rows = spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (1, 2, "c"), (1, 4, "x"), (1, 5, "a"), (2, 1, "x"), (None, 1, "b"), (1, 6, None)], "k int, o int, i string")
    known = spark.createDataFrame([("a",), ("b",), ("c",), ("c",), (None,)], "i string")
    assert {r.k: r["items"] for r in batching.asked_once(rows, "k", ["o"], "i", known).collect()} == {1: ["a", "c"], None: ["b"]}
    failed = [k % 7 in (2, 3, 6) for k in range(500)]
    rows = spark.createDataFrame([(7, k, f) for k, f in enumerate(failed)] + [(None, 0, True), (8, 0, False)], "k int, o int, f boolean").repartition(5)
    want, run = set(), []
    for k, f in enumerate([*failed, False]):
        if f:
            run.append(k)
        elif run:
            want.add((7, failed[:k].count(False), len(run), run[0], run[-1]))
            run = []
    assert {tuple(r) for r in batching.error_islands(rows, "k", "o", F.col("f")).collect()} == want | {(None, 0, 1, 0, 0)}


def test_a_chain_longer_than_a_task_may_hold_goes_by_stretches(spark, monkeypatch):
    n, cuts = 900, []
    cut = dedupe.cut_lineage
    monkeypatch.setattr(dedupe, "cut_lineage", lambda df: cuts.append(1) or cut(df))
    chain = [(k, f"a{k // 2}", f"b{(k + 1) // 2}") for k in range(n)] + [(n + k, None, "b0") for k in range(3)]
    df = spark.createDataFrame(chain, "o long, a string, b string")
    assert sorted(r.o for r in dedupe.first_wins(df, ["a", "b"], "o", rounds=1, most=200).collect()) == greedy(chain)
    assert len(cuts) < 8  # by rounds some 900
