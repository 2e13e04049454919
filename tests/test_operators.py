"""Operators on small cases of their own, and order-dependent ones against sequential models."""

import datetime as dt
import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from jobweave.functions import dates, hashes, payloads, text
from jobweave.operators import batching, boards, dedupe, listing, rules, state
from jobweave.plans import scoring
from jobweave.plans.ingest import fingerprint_backfill, ingested, stats
from jobweave.sources import normalise, readers, sinks
from jobweave.streaming import streams

POSTING = {"title": "Senior Software Engineer", "description": "React, Node.js and TypeScript.", "tags": [], "location": "Remote, US", "remote": True}
SCHEMA = "title string, description string, tags array<string>, location string, remote boolean"


def value(spark, column, **columns):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()]) if columns else spark.range(1)
    return frame.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "changes, status, reason",
    [
        ({}, "passed", None),
        ({"remote": False}, "dropped", rules.NOT_REMOTE),
        ({"title": "Senior Engineer (Hybrid)"}, "dropped", rules.IS_ONSITE),
        ({"location": "London"}, "dropped", rules.IS_ELSEWHERE),
        ({"location": "Lviv, Somewhere"}, "dropped", rules.IS_ELSEWHERE),
        ({"location": "Austin, TX"}, "passed", None),
        ({"description": "React. We are currently hiring in Texas and Ohio."}, "dropped", rules.EXCLUDES_STATE.format("Missouri")),
        ({"description": "React. We are currently hiring in Texas and MO."}, "passed", None),
        ({"description": "React. We are currently hiring in Texas, in fact nationwide."}, "passed", None),
        ({"description": "React. Hiring in Texas." + " x" * 500 + " must reside in Ohio or Missouri"}, "dropped", rules.EXCLUDES_STATE.format("Missouri")),
        ({"title": "Software Engineer"}, "dropped", rules.NOT_SENIOR),
        ({"title": "Senior Sales Engineer"}, "dropped", rules.IS_SALES),
        ({"title": "Head of Global Partnerships"}, "dropped", rules.IS_SALES),
        ({"description": "React on-chain"}, "dropped", rules.IS_CRYPTO),
        ({"title": "Senior Angular Engineer"}, "dropped", rules.EXCLUDED_TITLE),
        ({"tags": ["Angular", "typescript"]}, "dropped", rules.EXCLUDED_STACK),
        ({"tags": ["Angular", "React"]}, "passed", None),
        ({"description": "Python only"}, "dropped", rules.NOT_REQUIRED),
        ({"description": "some JS"}, "manual", rules.ONLY_SHORT),
        ({"description": "Angular", "tags": ["react"]}, "manual", rules.EXCLUDED_MENTION),
        ({"title": None}, "dropped", rules.NOT_SENIOR),
    ],
)
def test_rules(spark, changes, status, reason):
    row = spark.createDataFrame([POSTING | changes], SCHEMA)
    got = rules.classified(row, rules.FilterConfig(state="Missouri")).first()
    assert (got.filter_status, got.filter_reason) == (status, reason)


def test_config():
    assert rules.home_state(" mo ") == "Missouri" and rules.home_state("") is None and rules.home_state("x", strict=False) == "x"
    with pytest.raises(ValueError):
        rules.home_state("Atlantis")
    kept = rules.FilterConfig.active({"home_state": "tx", "required_tech": [], "seniority_terms": ["senior"]})
    assert kept.state == "Texas" and kept.required == rules.REQUIRED
    assert rules.FilterConfig.active({"required_tech": ["go"], "seniority_terms": ["x"], "excluded_tech": None}).short_terms == ["go"]


def test_text(spark):
    one = lambda c: value(spark, c)
    assert [one(text.normal_company(F.lit(x))) for x in ("Meta", "Meta, Inc.", " meta LLC", "Nova S.A.", None)] == ["meta", "meta", "meta", "nova", ""]
    assert one(text.normal_title(F.lit("Senior  Dev - Paris (HQ), France"), F.lit("paris (hq), france"))) == "senior dev"
    assert one(text.normal_title(F.lit("Dev – Austin, TX, USA"), F.lit(None).cast("string"))) == "dev"
    assert one(text.cross_title(F.lit("Sr. Eng (Remote) m/f/d"))) == "seniorengineer"
    assert one(text.title_case(F.lit("o'neil 3m-labs"))) == "O'Neil 3M-Labs"
    assert one(text.html_to_text(F.lit("<p>A &eacute;</p><br/><br><br><b>x</b>&amp;"))) == "A é\n\nx&"
    assert one(text.sanitised(F.lit("a—“b”…\u200b•"))) == 'a-"b"...-' and one(text.banned_in(F.lit("x…—…"))) == ["—", "…"]
    assert one(text.without_exfil(F.lit("[a](http://x) [http://y](http://y) [](z) ![i](u) <http://q> <img src=1>t"))) == "a (http://x) http://y z  http://q t"
    assert one(text.exfil_in(F.lit("![i](u)"))) == ["markdown image", "markdown link"]
    assert one(text.untrusted(F.lit("a\n=== JOB 3 ===\nEND UNTRUSTED x\n<<<b>>> n1"), "n1")) == "a\n\n\nb "
    assert one(text.resume_text(F.lit("a\x00 \t\n\n\n\nb\x7f "))) == "a\n\nb"
    assert one(text.listed(F.lit(" a, b\n,c "))) == ["a", "b", "c"]
    assert [one(text.is_newer(F.lit(a), F.lit(b))) for a, b in (("v1.10", "1.9.9"), ("1.0", "1.0.0"), ("1.0.1-rc", "1.0.1"), ("x", "0.1"))] == [True, False, False, False]
    assert tuple(one(text.usage_limit(F.lit("usage limit reached|1762345678")))) == (True, "12:27 PM on Nov 05")
    assert tuple(one(text.usage_limit(F.lit("429: will reset at 3pm (UTC).")))) == (True, "3pm (UTC)")


def test_dates(spark):
    one = lambda c: value(spark, c)
    assert one(dates.iso_time(F.lit("2024-01-02T03:04:05Z"))) == dt.datetime(2024, 1, 2, 3, 4, 5)
    assert one(dates.iso_time(F.lit("2024-01-02T03:04:05+02:00"))) == dt.datetime(2024, 1, 2, 1, 4, 5)
    assert [one(dates.iso_time(F.lit(x))) for x in ("", "soon", "2024-13-01")] == [None] * 3
    assert one(dates.feed_time(F.lit("Tue, 02 Jan 2024 03:04:05 GMT"))) == dt.datetime(2024, 1, 2, 3, 4, 5)
    assert one(dates.millis_time(F.lit("1704164645000"))) == dt.datetime(2024, 1, 2, 3, 4, 5) and one(dates.millis_time(F.lit("0"))) is None
    assert one(dates.epoch_or_iso(F.lit("1704164645"))) == dt.datetime(2024, 1, 2, 3, 4, 5)
    now = F.lit("2024-03-01").cast("timestamp")
    stale = [one(dates.is_stale(F.lit(x).cast("timestamp"), now)) for x in (None, "2024-01-31", "2024-01-30 23:59:59")]
    assert stale == [False, False, True]
    assert [one(dates.relative_label(F.lit(d))) for d in (0, 1, 29, 30, 61)] == ["today", "1 day ago", "29 days ago", "1 month ago", "2 months ago"]


def plain_simhash(description):
    words = re.findall("[a-z0-9]+", re.sub("<[^>]+>", " ", description or "").lower())
    if len(re.sub("<[^>]+>", " ", description or "")) < 200 or len(words) < 3:
        return None
    votes = [0] * 64
    for k in range(len(words) - 2):
        h = int.from_bytes(hashlib.blake2b(" ".join(words[k : k + 3]).encode(), digest_size=8).digest(), "big")
        for i in range(64):
            votes[i] += 1 if h >> i & 1 else -1
    return f"{sum(1 << i for i, v in enumerate(votes) if v > 0):016x}"


def test_simhash_and_distance(spark):
    rng = random.Random(1)
    texts = [" ".join(f"w{rng.randrange(50)}" for _ in range(n)) for n in (3, 80, 200)] + ["<b>" + "word " * 60 + "</b>", "", None, "! " * 150]
    got = spark.createDataFrame(enumerate(texts), "id int, t string").select("id", hashes.simhash("t").alias("p")).collect()
    assert [r.p for r in sorted(got)] == [plain_simhash(t) for t in texts]
    a, b = "ffffffff00000000", "0000000000000001"
    assert value(spark, hashes.hamming(F.lit(a), F.lit(b))) == 33


def sequential(rows, keys):
    seen, out = {k: set() for k in keys}, []
    for r in rows:
        if any(r[k] is not None and r[k] in seen[k] for k in keys):
            continue
        for k in keys:
            seen[k].add(r[k])
        out.append(r["ord"])
    return out


def test_first_wins_equals_a_sequential_pass(spark):
    rng = random.Random(4)
    rows = [{"ord": k, "h": rng.choice([None, *range(60)]), "g": rng.choice([None, *range(60)])} for k in range(300)]
    df = spark.createDataFrame(rows, "ord long, h int, g int")
    assert sorted(r.ord for r in dedupe.first_wins(df, ["h", "g"], "ord").collect()) == sequential(rows, ["h", "g"])
    known = spark.createDataFrame([(3,)], "h int")
    assert all(r.h != 3 for r in dedupe.first_wins(df, ["h", "g"], "ord", {"h": known}).collect())
    assert dedupe.first_wins(df.limit(0), ["h", "g"], "ord").count() == 0


def test_near_links_and_roots(spark):
    base = int("12568d0fc8a28d69", 16)
    prints = {1: base, 2: base ^ 0b101, 3: base ^ 0b111, 4: base ^ (1 << 63), 5: ~base & (2**64 - 1), 6: base, 7: None}
    days = {1: 0, 2: 1, 3: 40, 4: 2, 5: 3, 6: 90, 7: 1}
    rows = spark.createDataFrame([(i, None if p is None else f"{p:016x}", dt.datetime(2024, 1, 1) + dt.timedelta(days=days[i])) for i, p in prints.items()], "id long, print string, at timestamp")
    assert {r.id: r.parent for r in dedupe.near_links(rows).collect()} == {2: 1, 4: 1}
    links = dedupe.near_links(rows, days=None)
    assert {r.id: r.parent for r in links.collect()} == {2: 1, 3: 1, 4: 1, 6: 1}
    chain = spark.createDataFrame([(k, k - 1) for k in range(1, 20)], "id long, parent long")
    assert {r.root for r in dedupe.canonical(chain).collect()} == {0}


def test_ingest_outcomes(spark):
    body = "React and node. " + "We build things for people. " * 12
    make = lambda k, **c: {"ord": k, "source": "a", "source_id": str(k), "url": "", "company_name": "Acme", "title": f"Senior Engineer {k}", "description": body + str(k) * 30, "location": "Remote", "remote": True, "tags": [], "posted_at": None} | c
    old = dt.datetime(2020, 1, 1)
    records = [
        make(0),
        make(1, source_id="0"),
        make(2, title="Senior  engineer 0"),
        make(3, source="b", title="Sr. Engineer 0 (Remote)"),
        make(4, posted_at=old),
        make(5, title="Junior"),
        make(6, company_name="Evil, Inc."),
        make(7, company_name="Shut"),
        make(8, source_id="0", posted_at=old),
        make(9, description=body + "0" * 30 + " end"),
        make(10, source_id="known"),
        make(11, source_id="5", title="Senior Engineer 11", description="totally different react words " * 20),
    ]
    schema = "ord long, source string, source_id string, url string, company_name string, title string, description string, location string, remote boolean, tags array<string>, posted_at timestamp"
    kept = hashlib.sha256(b"a|known").hexdigest()
    stored = spark.createDataFrame([(1, kept, "t", None, None, dt.datetime(2024, 1, 1), None)], "id long, dedupe_hash string, title_key string, cross_source_hash string, jd_fingerprint string, ingested_at timestamp, duplicate_of long")
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "key string")
    done = ingested(spark.createDataFrame(records, schema), stored, F.lit("2024-01-05").cast("timestamp"), None, names("evil"), names("shut"))
    got = {r.ord: r.outcome for r in done.rows.collect()}
    assert got == {0: "inserted", 1: "skipped_duplicate", 2: "skipped_duplicate", 3: "skipped_cross_source", 4: "stale", 5: "dropped_filter", 6: "dropped_blacklist", 7: "dropped_filter", 8: "skipped_duplicate", 9: "inserted", 10: "skipped_duplicate", 11: "inserted"}
    new = {r.ord: (r.duplicate_of, r.duplicate_of_ord) for r in done.new.collect()}
    assert new == {0: (None, None), 9: (None, 0), 11: (None, None)}
    total = stats(done).first()
    assert (total.fetched, total.inserted, total.flagged_jd_similar, total.passed_filter) == (12, 3, 1, 3)
    again = spark.createDataFrame([(k, None, body + str(k % 2), dt.datetime(2024, 1, 1 + k), None) for k in range(4)], "id long, jd_fingerprint string, description string, ingested_at timestamp, duplicate_of long")
    filled = {r.id: r.duplicate_of for r in fingerprint_backfill(again).collect()}
    assert filled[0] is None and filled[1] in (None, 0) and filled[2] == 0


def test_batching(spark):
    rng = random.Random(2)
    rows = [(k % 3, k, rng.choice([10, 9000, 30000])) for k in range(200)]
    want, state_ = {}, {}
    for key, k, size in rows:
        b, n, s = state_.get(key, (0, 0, 0))
        if n and (n >= 8 or s + size > 24000):
            b, n, s = b + 1, 0, 0
        state_[key] = (b, n + 1, s + size)
        want[k] = b
    df = spark.createDataFrame(rows, "key int, ord int, size long")
    assert {r.ord: r.batch for r in batching.packed(df, "key", "ord", "size").collect()} == want
    assert {r.key: r.batches for r in batching.packed_counts(df, "key", "ord", "size").collect()} == {k: v[0] + 1 for k, v in state_.items()}
    score = lambda s, *p: value(spark, batching.reconciled(F.lit(s), [F.lit(x).cast("int") for x in p]))
    assert [score(50, 30, 25, 0, 0, 0), score(50, 30, 26, 0, 0, 0), score(50, None, 26, 0, 0, 0), score(1, 90, 90, 0, 0, 0)] == [50, 56, 50, 100]


def test_state(spark):
    now = F.lit("2024-05-01").cast("timestamp")
    rows = spark.createDataFrame([(1, "new", None, None), (2, "applied", dt.datetime(2024, 1, 1), None), (3, "new", None, dt.datetime(2024, 6, 1))], "id long, status string, applied_at timestamp, next_followup_at timestamp")
    rows = rows.withColumns({"last_contact_at": F.lit(None).cast("timestamp"), "outcome": F.lit(None).cast("string"), "updated_at": F.lit(None).cast("timestamp")})
    got = {r.id: (r.applied_at, r.next_followup_at) for r in state.moved(rows, F.lit("applied"), now).collect()}
    assert got == {1: (dt.datetime(2024, 5, 1), dt.datetime(2024, 5, 8)), 2: (dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 8)), 3: (dt.datetime(2024, 5, 1), dt.datetime(2024, 6, 1))}
    with pytest.raises(ValueError):
        state.checked(spark.createDataFrame([(9,)], "id long"), rows, "id")
    marked = state.unemployment_marked(spark.createDataFrame([(1, "new", False, None)], "job_id long, status string, used_for_unemployment boolean, used_for_unemployment_at timestamp"), spark.createDataFrame([(2,)], "job_id long"), True, now)
    assert {r.job_id: r.used_for_unemployment for r in marked.collect()} == {1: False, 2: True}
    blacklist = spark.createDataFrame([("Acme", "acme")], "name string, key string")
    added = state.listed_names(blacklist, spark.createDataFrame([("ACME Inc",), ("Q",), ("New Co",)], "name string"), text.normal_company(F.col("name")))
    assert sorted(r.key for r in added.collect()) == ["acme", "new"]
    posts = spark.createDataFrame([(1, "text", "{}", None), (2, "", "", "00")], "id long, description string, raw string, jd_fingerprint string")
    out = {r.id: (r.description, r.jd_fingerprint, r.bytes_freed) for r in state.pruned(posts, F.lit(True), F.lit("ff")).collect()}
    assert out == {1: ("", "ff", 6), 2: ("", "00", 0)}
    assert state.migrated(posts, {"kind": F.lit("x"), "jd_fingerprint": F.lit("y")}).first()["jd_fingerprint"] == "y"
    assert state.setting(spark.createDataFrame([("a", "1")], "key string, value string"), "a", "2").collect() == [("a", "2")]


def test_payloads(spark):
    one = lambda t: value(spark, payloads.object_in(F.lit(t)))
    assert one('x {"a": "}"} y') == '{"a": "}"}' and one('```json\n{"b": 1}\n``` {"c": 2}') == '{"b": 1}' and one("{ no") is None and one("[1]") is None
    page = '<script type="application/ld+json">[{"@type": "Org"}, {"@graph": [{"@type": ["X", "JobPosting"], "title": "T"}]}]</script>'
    assert json.loads(value(spark, payloads.job_posting_ld(F.lit(page))))["title"] == "T"
    assert value(spark, payloads.job_posting_ld(F.lit('<script type="application/ld+json">{bad</script>'))) is None


def items(spark, *objects, slug="acme-co", **columns):
    rows = spark.createDataFrame([(slug, o if isinstance(o, str) else json.dumps(o)) for o in objects], "slug string, item string")
    return rows.withColumns({k: F.lit(v) for k, v in columns.items()})


def test_normalisers(spark):
    bad = ["[]", '"x"', "7", "null", "{", {}]
    g = normalise.greenhouse(items(spark, *bad, {"id": 7, "title": " Dev ", "location": {"name": "NYC"}, "offices": [{"name": "Anywhere"}], "departments": [{"name": "Eng"}], "metadata": [{"name": "Level", "value": "L5"}], "content": "&lt;p&gt;x", "updated_at": "2024-01-02T00:00:00Z"})).collect()
    assert len(g) == 1 and (g[0].source_id, g[0].title, g[0].company_name, g[0].remote, g[0].location) == ("acme-co:7", "Dev", "Acme Co", True, "NYC")
    assert g[0].description == "<p>x\n\nEng\n\nLevel: L5\n\nAnywhere" and g[0].tags == ["Eng", "Level", "L5"]
    v = normalise.lever(items(spark, *bad, {"id": "q", "text": "Dev", "categories": {"allLocations": ["Remote - US"], "commitment": "Full"}, "lists": [{"text": "T", "content": "c"}], "createdAt": 1704164645000})).first()
    assert (v.location, v.remote, v.employment_type, v.description) == ("Remote - US", True, "Full", "## T\nc")
    a = normalise.ashby(items(spark, *bad, {"id": "1", "title": "D", "isListed": False}, {"id": "2", "title": "D", "workplaceType": "Remote", "secondaryLocations": [{"location": "X"}]})).collect()
    assert [(r.source_id, r.remote, r.location, r.tags) for r in a] == [("acme-co:2", True, "X", ["Remote"])]
    w = normalise.workday(items(spark, {"externalPath": "/job/1", "title": "D"}, slug="t|wd1|s", detail='{"jobPostingInfo": {"jobDescription": "b", "remoteType": "Fully Remote"}}')).first()
    assert (w.source_id, w.url, w.company_name, w.remote) == ("t:/job/1", "https://t.wd1.myworkdayjobs.com/s/job/1", "T", True)
    k = normalise.workable(items(spark, *bad, {"shortcode": "s", "title": "D", "location": {"city": "A", "country": "B"}, "department": "Eng", "workplace": "remote"})).first()
    assert (k.location, k.tags, k.url) == ("A, B", ["Eng", "remote"], "https://apply.workable.com/acme-co/j/s/")
    s = normalise.smartrecruiters(items(spark, *bad, {"id": "1", "name": "D", "location": {"fullLocation": "Remote, X", "hybrid": True}, "industry": {"label": "I"}})).first()
    assert (s.remote, s.tags) == (False, ["I", "hybrid"])
    j = normalise.jibe(items(spark, *bad, {"req_id": "9", "title": "D", "location_name": "US Remote", "categories": [{"name": "c"}], "tags3": ["t"]})).first()
    assert (j.source_id, j.tags) == ("acme-co:9", ["c", "t", "remote"])
    o = normalise.oracle(items(spark, {"Id": "5", "Title": "D", "secondaryLocations": [{"Name": "United States"}]}, slug="eeho.fa.us2.oraclecloud.com|CX|https://x/", detail='{"items": [{"ExternalDescriptionStr": "<p>a</p>"}]}')).first()
    assert (o.source_id, o.url, o.remote, o.description) == ("eeho.fa.us2.oraclecloud.com:5", "https://x/job/5", True, "<p>a</p>")
    r = normalise.remoteok(items(spark, {"legal": "x"}, {"id": 1, "position": "A &amp; B", "epoch": "1704164645"})).collect()
    assert [(x.title, x.company_name, x.location) for x in r] == [("A & B", "Unknown", "Remote")]
    h = normalise.hackernews(items(spark, {"id": 1, "text": ""}, {"id": 2, "text": "Acme | Senior Dev | NYC | REMOTE<p>see https://a.b/c"}).withColumn("thread_created", F.lit("2024-01-01").cast("timestamp"))).collect()
    assert [(x.company_name, x.title, x.location, x.remote, x.url) for x in h] == [("Acme", "Acme (HN — see description)", "Senior Dev", True, "https://a.b/c")]
    page = '<script type="application/ld+json">{"@type": "JobPosting", "description": "remote remote", "jobLocation": {"address": {"addressLocality": "SF"}}}</script>'
    y = normalise.ycombinator(items(spark, {"url": "https://www.ycombinator.com/companies/acme/jobs/x1", "title": "Acme (YC S21) is hiring a Dev"}, {"url": "http://other", "title": "t"}, page=page)).collect()
    assert [(x.title, x.company_name, x.location, x.remote, x.tags) for x in y] == [("Dev", "Acme", "SF", True, ["yc", "acme"])]


def test_boards(spark):
    keys = value(spark, boards.company_keys(F.lit("Acme Corp")))
    assert keys == ["acmecorp", "acme"] and value(spark, boards.slug_spellings(F.lit("Blue Sky Inc"))) == ["blueskyinc", "blue-sky-inc", "bluesky"]
    assert [value(spark, boards.is_valid_slug(F.lit(s), F.lit(g))) for s, g in (("workday", "a|b|c"), ("workday", "a|b"), ("oracle", "a|b|c|d"), ("oracle", "a| |c"), ("lever", "x"))] == [True, False, True, False, True]
    names = spark.createDataFrame([("Acme Corp",), ("Nobody",)], "name string")
    stored = spark.createDataFrame([(2, "lever", "acme-corp"), (1, "ashby", "Acme")], "id long, source string, slug string")
    assert boards.by_name(names, stored).collect() == [("Acme Corp", 1, "ashby", "Acme")]
    verified = spark.createDataFrame([("lever", "acme-corp", True, 0), ("workable", "acme", True, 0), ("ashby", "AcmeCorp", True, 3)], "source string, slug string, ok boolean, job_count int")
    assert [tuple(r) for r in boards.probes(names, verified).collect()] == [("Acme Corp", "lever", "acme-corp", 0), ("Acme Corp", "ashby", "AcmeCorp", 3)]
    seeds = spark.createDataFrame([("workday", "bad"), ("jibe", "x"), ("lever", "y")], "source string, slug string")
    assert [r.slug for r in boards.seeded(stored, seeds).collect()] == ["x"]


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    jobs = [{"shortcode": str(k), "title": "Senior Dev" if k % 2 else "Intern"} for k in range(300)]
    lines = [{"slug": "a", "payload": json.dumps({"results": jobs})}, {"slug": "b", "payload": "[1"}, {"slug": "c", "payload": json.dumps({"results": 5})}]
    (tmp_path / "in" / "x.json").write_text("\n".join(map(json.dumps, lines)))
    rows = readers.items(readers.landed(spark, f"{tmp_path}/in"), "workable")
    assert rows.count() == 200
    details = spark.createDataFrame([("a", str(k), "{}") for k in range(300)], "slug string, key string, detail string")
    assert readers.with_details(rows, details, "$.title", "$.shortcode").count() == 100
    (tmp_path / "feed.xml").write_text('<rss><channel><item><title>Acme: Dev</title><link>l1</link><description>&lt;a href="https://jobs.lever.co/x"&gt;</description></item><item><title>n</title><link>l2</link></item></channel></rss>')
    feed = normalise.weworkremotely(readers.feed(spark, f"{tmp_path}/feed.xml")).collect()
    assert [(r.company_name, r.title, r.url) for r in feed] == [("Acme", "Dev", "https://jobs.lever.co/x")]
    root = f"{tmp_path}/table"
    sinks.snapshot(spark.range(3), root)
    sinks.snapshot(spark.range(5), root)
    assert sinks.current(spark, root).count() == 5
    drafts = spark.createDataFrame([(1, "resume", "# A\n- x — y\n[l](http://u)")], "job_id long, kind string, markdown string")
    assert "x - y" in sinks.drafts(drafts).first().markdown and "<h1>A</h1>" in sinks.print_html(drafts).first().html
    assert json.loads(sinks.stats_json(spark.range(1)).first().json) == {"id": 0}


def test_stream_ingest_is_idempotent(spark, tmp_path):
    for k, ids in enumerate(([1, 2], [2, 3])):
        spark.createDataFrame([(i,) for i in ids], "id long").coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    run = lambda: streams.ingest(streams.files(spark, f"{tmp_path}/in", "id long", 1), lambda b, _: b.dropDuplicates(["id"]), f"{tmp_path}/out", "id", f"{tmp_path}/state").awaitTermination()
    run()
    run()
    assert sorted(r.id for r in sinks.current(spark, f"{tmp_path}/out").collect()) == [1, 2, 3]


def test_scoring_survives_a_failing_scorer(spark):
    rows = spark.createDataFrame([(k, "react node" if k % 2 else "java") for k in range(40)], "id long, description string")
    out = {r.id: (r.score, r.archive) for r in scoring.results(rows, scoring.scored(rows, scoring.keyword_scorer(["react", "node"]))).collect()}
    assert out == {k: (100, False) if k % 2 else (0, True) for k in range(40)}

    def failing(batch):
        raise RuntimeError("limit")

    failed = scoring.scored(rows, failing).collect()
    assert len(failed) == 40 and {r.error for r in failed} == {"limit"}


def test_listing_edges(spark):
    rows = spark.createDataFrame([(1, "Bolt 100%", "x"), (2, "a bolt", "y"), (3, "b", "BOLT")], "id long, title string, company string")
    found = [r.id for r in listing.searched(rows, "bolt", ["title", "company"], [F.asc("id")]).collect()]
    assert found == [3, 1, 2] and listing.searched(rows, "b", ["title"], [F.asc("id")]).count() == 0
    assert [r.id for r in listing.searched(rows, "0%", ["title"], [F.asc("id")]).collect()] == [1]
    text_ = [r.line for r in listing.report(spark.createDataFrame([("s", 1, 2, 3)], "source string, passed long, manual long, dropped long"), spark.createDataFrame([("r", 3)], "reason string, n long")).collect()]
    assert text_ == ["s: passed 1, manual 2, dropped 3", "     3  r"]


def test_adapter_and_verification(spark):
    from jobweave.sources import adapter

    got = adapter.answers(spark, "tests.fetchers:two_pages", ["x", "gone", "y"])
    assert got.rdd.getNumPartitions() == 3
    assert sorted((r.slug, r.page) for r in got.collect()) == [("x", 0), ("x", 1), ("y", 0), ("y", 1)]
    assert sorted(r.source_id for r in normalise.greenhouse(readers.items(got, "greenhouse")).collect()) == ["x:x0", "x:x1", "y:y0", "y:y1"]
    assert [r.slug for r in adapter.answers(spark, "tests.fetchers:refused", ["a", "b", "c"], limited=True, wait=0).collect()] == ["a"]

    def check(source, slug):
        if slug == "bad":
            raise RuntimeError("no")
        return True, len(slug), None

    rows = spark.createDataFrame([("lever", "abc"), ("lever", "bad")], "source string, slug string")
    assert sorted((r.slug, r.ok, r.job_count, r.error) for r in adapter.verified(rows, check).collect()) == [("abc", True, 3, None), ("bad", False, None, "no")]


def test_scoring_falls_back_and_stops(spark):
    rows = spark.createDataFrame([(k, "bad" if k in (3, 10, 11, 12) else "react") for k in range(20)], "id long, description string")
    plain = scoring.keyword_scorer(["react"])

    def touchy(batch):
        if batch["description"].eq("bad").any():
            raise RuntimeError("refused")
        return plain(batch)

    for lanes in (1, 3):
        got = {r.id: (r.score, r.error) for r in scoring.scored(rows, touchy, lanes=lanes).collect()}
        # Jobs go one by one where their batch failed; what is wrong with some jobs costs no other.
        assert got == {k: (None, "refused") if k in (3, 10, 11, 12) else (100, None) for k in range(20)}

    def forgetful(batch):
        return plain(batch)[lambda a: a["id"] % 2 == (0 if len(batch) > 1 else a["id"].iloc[0] % 2)]

    assert all(r.score == 100 for r in scoring.scored(rows.where("description = 'react'"), forgetful, lanes=1).collect())

    def limited(batch):
        if batch["id"].ge(8).any():
            raise RuntimeError("usage limit reached, resets at 5pm")
        return plain(batch)

    got = {r.id: (r.score, r.error) for r in scoring.scored(rows, limited, lanes=1).collect()}
    assert all(got[k] == (0 if k == 3 else 100, None) for k in range(8))
    assert all(got[k][0] is None and "usage limit" in got[k][1] for k in range(8, 20))
    assert scoring.scored(rows.limit(0), plain).count() == 0


def provider(calls, fails):
    """A scorer that notes its calls and fails by the provider's fault where `fails` says so of its ids."""
    plain = scoring.keyword_scorer(["react"])

    def call(batch):
        with open(calls, "a") as f:
            f.write(f"{len(batch)}\n")
        error = fails(batch["id"].tolist())
        if error:
            raise error
        return plain(batch)

    return call


@pytest.mark.parametrize("lanes", [1, 64])
def test_a_failing_provider_ends_the_run_at_once(spark, tmp_path, lanes):
    rows = spark.createDataFrame([(k, "react") for k in range(300)], "id long, description string")
    out = scoring.scored(rows, provider(f"{tmp_path}/calls", lambda ids: scoring.ProviderError("unknown model")), lanes=lanes).collect()
    assert len(out) == 300 == len({r.id for r in out}) and all(r.score is None for r in out)
    refused = [r for r in out if r.error == "unknown model"]
    assert len(refused) == 3 and all("in a row" in r.error for r in out if r not in refused)
    calls = open(f"{tmp_path}/calls").read().split()
    # A batch before its jobs does not count, as in a run of batches of one.
    assert calls.count("1") == 3 and len(calls) <= 4


@pytest.mark.parametrize("lanes", [1, 5])
def test_a_healthy_run_loses_no_job(spark, tmp_path, lanes):
    rows = spark.createDataFrame([(k, "react") for k in range(200)], "id long, description string")
    # The first two jobs of the run and all from 100 to 139 fail by the provider's fault, others by their own.
    bad = lambda ids: scoring.ProviderError("timeout") if any(i in (0, lanes) or 100 <= i < 140 for i in ids) else ValueError("odd") if any(i % 17 == 16 for i in ids) else None
    got = {r.id: (r.score, r.error) for r in scoring.scored(rows, provider(f"{tmp_path}/calls", bad), lanes=lanes).collect()}
    assert got == {i: (None, "timeout") if i in (0, lanes) or 100 <= i < 140 else (None, "odd") if i % 17 == 16 else (100, None) for i in range(200)}


def test_other_failures_break_a_streak(spark, tmp_path):
    rows = spark.createDataFrame([(k, "react") for k in range(40)], "id long, description string")
    never = lambda ids: ValueError("odd") if len(ids) > 1 or ids[0] % 3 == 2 else scoring.ProviderError("timeout")
    out = scoring.scored(rows, provider(f"{tmp_path}/calls", never), lanes=1).collect()
    assert len(out) == 40 and {r.error for r in out} == {"odd", "timeout"}  # two in a row at most: all are tried
    late = lambda ids: ValueError("odd") if ids[0] < 20 else scoring.ProviderError("timeout")
    out = {r.id: r.error for r in scoring.scored(rows, provider(f"{tmp_path}/calls", late), lanes=1).collect()}
    assert all(out[i] == "odd" for i in range(20)) and [out[i] for i in (20, 21, 22)] == ["timeout"] * 3 and all("in a row" in out[i] for i in range(23, 40))


def test_calls_for_single_jobs_make_no_tables(monkeypatch):
    """A job that is called for alone costs little more than its scorer: what comes back is plain rows, handed on together."""
    import pandas as pd

    def refused(*_, **__):
        raise AssertionError("a table for each job")

    plain, jobs = scoring.keyword_scorer(["react"]), pd.DataFrame({"id": range(24), "description": ["react", None, "bad"] * 8})

    def touchy(batch):
        if any(t == "bad" for t in batch["description"].tolist()):
            raise RuntimeError("refused")
        return plain(batch)

    monkeypatch.setattr(pd, "concat", refused)
    monkeypatch.setattr(pd.DataFrame, "groupby", refused)
    got = scoring.Caller(touchy, 2, 3, True)(jobs["id"].tolist(), jobs)
    assert [(r[0], r[1], r[4]) for r in got] == [(k, (100, 0, None)[k % 3], "refused" if k % 3 == 2 else None) for k in range(24)]
    odd = pd.DataFrame({"id": [1, 2, 3, 9], "score": [50.0, None, 101, 7], "rubric": None, "reasoning": "", "error": [None, None, None, None], "position": range(4)})
    assert scoring.usable(odd, [1, 2, 3]) == [(1, 50, None, "", None, 0)]


def test_answers_of_many_epochs_are_few_partitions(spark):
    rows = spark.createDataFrame([(k, "react") for k in range(900)], "id long, description string")
    out = scoring.scored(rows, scoring.keyword_scorer(["react"]), lanes=4)
    assert out.rdd.getNumPartitions() <= 4 and out.where("score = 100").count() == 900


def test_lanes_are_laid_once(spark, monkeypatch):
    """Epochs read the stored lanes as they lie, and the one stretch of the first epoch is looked for by all tasks; each epoch had dealt and sorted its lanes anew, and one task had read all rows."""
    rows = spark.createDataFrame([(k, "react" if k % 3 else "none") for k in range(900)], "id long, description string").repartition(6)
    plans, stored = [], scoring.cut_lineage

    def noted(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return stored(df)

    monkeypatch.setattr(scoring, "cut_lineage", noted)
    got = {r.id: r.score for r in scoring.scored(rows, scoring.keyword_scorer(["react"]), lanes=4).collect()}
    assert got == {k: 100 if k % 3 else 0 for k in range(900)}
    first, *others = [p for p in plans if "MapInPandas" in p.split("\n")[0]]
    assert "Repartition 1, true" in first and len(others) > 3
    assert not any(word in p for p in others for word in ("Repartition", "Sort"))


def test_streaks_join(spark):
    rng = random.Random(3)
    for _ in range(300):
        marks = [rng.random() < 0.7 for _ in range(rng.randrange(12))]
        cut = rng.randrange(len(marks) + 1)
        whole, a, b = scoring.Streak(), scoring.Streak(), scoring.Streak()
        for k, m in enumerate(marks):
            whole.add(m)
            (a if k < cut else b).add(m)
        assert a.then(b) == whole


@pytest.mark.parametrize("days", [None, 5])
def test_near_links_against_all_pairs(spark, days):
    rng = random.Random(9)
    bases = [rng.getrandbits(64) for _ in range(12)]
    rows = []
    for k in range(300):
        value = rng.choice(bases)
        for _ in range(rng.randrange(0, 5)):
            value ^= 1 << rng.randrange(64)
        rows.append((k, f"{value:016x}" if k % 37 else None, dt.datetime(2024, 1, 1 + rng.randrange(28), rng.randrange(3))))
    rows += [(1000 + k, f"{bases[0]:016x}", dt.datetime(2024, 1, 1 + k % 28)) for k in range(200)]
    apart = lambda a, b: bin(int(a, 16) ^ int(b, 16)).count("1")
    want = {}
    for i, p, at in rows:
        before = [(b, j) for j, q, b in rows if p and q and (b, j) < (at, i) and apart(p, q) <= 3 and (days is None or b >= at - dt.timedelta(days=days))]
        if before:
            want[i] = min(before)[1]
    got = {r.id: r.parent for r in dedupe.near_links(spark.createDataFrame(rows, "id long, print string, at timestamp"), 3, days).collect()}
    assert got == want


@pytest.mark.parametrize("blocks", [4, 5, 6, 7, 8])
def test_near_pairs_with_every_number_of_blocks(spark, blocks, monkeypatch):
    rng = random.Random(blocks)
    monkeypatch.setattr(dedupe, "blocks_for", lambda n, distance: blocks)
    values = {rng.getrandbits(64) for _ in range(40)}
    for v in list(values):
        for _ in range(4):
            w = v
            for _ in range(rng.randrange(1, 5)):
                w ^= 1 << rng.randrange(64)
            values.add(w)
    values |= {0, 2**64 - 1, 2**63}
    prints = sorted(f"{v:016x}" for v in values)
    want = {(a, b) for a in prints for b in prints if a < b and bin(int(a, 16) ^ int(b, 16)).count("1") <= 3}
    got = {(r.print_a, r.print_b) for r in dedupe.near_pairs(spark.createDataFrame([(p,) for p in prints], "print string")).collect()}
    assert got == want


def test_keys_grow_with_the_data():
    assert [dedupe.blocks_for(n) for n in (0, 1000, 10**6, 10**9, 10**12)] == [4, 4, 5, 6, 8]


def test_lists_of_a_megabyte_and_pages(spark):
    text = "".join(f"- item {k}\n" for k in range(100_000)) + "end"
    page = sinks.print_html(spark.createDataFrame([(1, "resume", text)], "job_id long, kind string, markdown string")).first().html
    assert page.count("<ul>") == 1 and page.count("<li>") == 100_000
