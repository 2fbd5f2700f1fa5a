"""Nested records, mixed times and hot keys against plain Python."""

import json
import re
from datetime import UTC, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pyarrow.parquet as pq
import pytest

from lockstep.operators.hotkeys import object_activity, rounds_for
from lockstep.operators.nested import plan_inlining, relation, schema_graph, shred_json, shred_typed
from lockstep.operators.timestamps import normalise_times, split_times
from lockstep.plans import record_queries as rq


def listed(x):
    return [] if x is None else x if isinstance(x, list) else [x]


def tags_by_hand(refs, path=()):
    for i, ref in enumerate(listed(refs)):
        if isinstance(ref, dict):
            at = (*path, i)
            for j, tag in enumerate(listed(ref.get("hashtags"))):
                if isinstance(tag, dict):
                    tag = next((str(tag[k]) for k in ("tag", "text", "name") if tag.get(k) not in (None, "")), None)
                if tag not in (None, "") and not isinstance(tag, bool):
                    yield ".".join(map(str, at)), j, str(tag)
            yield from tags_by_hand(ref.get("referenced_tweets"), at)


def test_p1_found_against_python(spark, sf):
    want = []
    for row in pq.read_table(f"{sf}/twitter_raw.parquet").to_pylist():
        try:
            post = json.loads(row["payload"])
        except (TypeError, ValueError):
            continue
        if not isinstance(post, dict):
            continue
        post = post if "author_id" in post else next((v for v in post.values() if isinstance(v, dict) and "author_id" in v), {})
        want += [("twitter_raw", row["row_id"], *t) for t in tags_by_hand(post.get("referenced_tweets"))]
    for row in pq.read_table(f"{sf}/twitter_posts.parquet").to_pylist():
        want += [("twitter_posts", row["row_id"], *t) for t in tags_by_hand(row["referenced_tweets"])]
    got = [tuple(r) for r in rq.p1_found(spark, sf).collect()]
    assert sorted(got) == sorted(want) and len(want) > 100


def shredded(spark, texts, **kw):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "k int, payload string, id string")
    plan = plan_inlining(schema_graph(df, "payload", "post"), "post", **kw)
    return shred_json(df, "k", "payload", plan), plan


def test_inlining_plan_and_links(spark):
    texts = [
        '{"user": {"name": "a", "geo": {"lat": 1.50}}, "refs": [{"id": 1, "refs": {"id": 2}}, null, 7]}',
        '{"entities": {"urls": [["u", null, "v"], "w"]}, "poll": {"by": {"n": true}}, "quote": {"by": {"n": "q"}}}',
    ]
    cells, plan = shredded(spark, texts)
    assert plan.tables == {"post", "refs", "urls", "by"}
    posts = {r.record: r for r in relation(cells, plan, "post").collect()}
    assert posts[0].a_user_name == "a" and posts[0].a_user_geo_lat == "1.50" and posts[1].a_user_name is None
    refs = {r.id: r for r in relation(cells, plan, "refs").collect()}
    inner = next(r for r in refs.values() if r.a_id == "2")
    assert refs[inner.parent_id].a_id == "1" and inner.parent_path == "0" and inner.pos == 0
    assert {(r.pos, r.a_value) for r in refs.values() if r.a_value} == {(2, "7")}
    urls = [(r.parent_id, r.pos, r.a_value, r.lineage) for r in relation(cells, plan, "urls").collect()]
    assert sorted(urls) == [("1", 0, "u", "entities/urls"), ("1", 1, "w", "entities/urls"), ("1", 2, "v", "entities/urls")]
    assert sorted(r.a_n for r in relation(cells, plan, "by").collect()) == ["q", "true"]


def test_untidy_json_gives_nothing(spark):
    bad = [None, "", "null", "[]", '{"a": 1} x', '{"a": 1}{"a": 2}', '{"a": NaN}', '{"a": ', "[" * 100_000, '{"a":' * 5000 + "1" + "}" * 5000]
    cells, plan = shredded(spark, bad[:-1])
    assert relation(cells, plan, "post").count() == 0
    cells, plan = shredded(spark, ['{"a": "\\ud83d", "a": "z\\udc00", "id": "own"}', "{}"])
    rows = relation(cells, plan, "post").orderBy("record").collect()
    assert [r.a_a for r in rows] == ["z?", None] and [r.record for r in rows] == [0, 1]
    long = json.dumps({"a": "x" * 3_000_000})
    cells, plan = shredded(spark, [long])
    assert len(relation(cells, plan, "post").first().a_a) == 3_000_000
    empty, plan = shredded(spark, [])
    assert relation(empty, plan, "post").count() == 0


def test_typed_shred_edges(spark):
    df = spark.createDataFrame(
        [(1, [(None, None), ("a", ["x", None, ""])]), (2, None), (3, []), (4, [None])], "row int, refs array<struct<pos:string,tags:array<string>>>"
    )
    t, plan = shred_typed(df, "row", ["refs"])
    assert plan.tables == {"record", "refs", "tags"} and t["record"].count() == 4
    assert [(r.record, r.parent_path, r.pos, r.a_pos) for r in t["refs"].orderBy("pos").collect()] == [(1, "", 0, None), (1, "", 1, "a")]
    assert [(r.record, r.parent_path, r.pos, r.a_value, r.id, r.parent_id) for r in t["tags"].orderBy("pos").collect()] == [
        (1, "1", 0, "x", "1/refs/1/tags/0", "1/refs/1"), (1, "1", 2, "", "1/refs/1/tags/2", "1/refs/1"),
    ]


def test_both_ways_give_the_same_tables(spark):
    records = [
        {"by": {"n": "a", "at": {"x": "1"}}, "refs": [{"id": "p", "tags": ["s", None, "t"]}, None, {"id": None, "tags": None}], "quote": {"by": {"n": "q", "at": None}}, "grid": [["u", None, "v"], None, ["w"]]},
        {"by": None, "refs": [], "quote": None, "grid": None},
    ]
    kind = "by struct<n:string,at:struct<x:string>>"
    df = spark.createDataFrame([("k/1", records[0]), ("~2", records[1])], f"k string, r struct<{kind},refs:array<struct<id:string,tags:array<string>>>,quote:struct<{kind.replace(' ', ':', 1)}>,grid:array<array<string>>>".replace("struct<by struct", "struct<by:struct"))
    typed, plan = shred_typed(df.select("k", "r.*"), "k", ["by", "refs", "quote", "grid"], "post")
    text = spark.createDataFrame([("k/1", json.dumps(records[0])), ("~2", json.dumps(records[1]))], "k string, payload string")
    cells = shred_json(text, "k", "payload", plan)
    assert plan.tables == {"post", "by", "refs", "tags", "grid"} == typed.keys()
    for element in plan.tables:
        want = relation(cells, plan, element)
        assert sorted(map(str, typed[element].select(*want.columns).collect())) == sorted(map(str, want.collect())), element


def test_repeated_values_and_clashing_names_lose_nothing(spark):
    texts = ['{"tags": [{"tag": ["x", "y"], "n": 1}, {"tag": "z"}], "user": {"username": "a", "Name": "b"}, "user_username": "c", "user/username": "d", "user_name": "e"}']
    cells, plan = shredded(spark, texts)
    assert {(r.parent_id, r.pos, r.a_value) for r in relation(cells, plan, "tag").collect()} == {("0/tags/0", 0, "x"), ("0/tags/0", 1, "y"), ("0/tags/1", 0, "z")}
    assert [r.a_tag for r in relation(cells, plan, "tags", ["tag", "n"]).orderBy("pos").collect()] == ["x", "z"]
    post = relation(cells, plan, "post")
    row = post.first().asDict()
    assert sorted(v for k, v in row.items() if k.startswith("a_")) == ["a", "b", "c", "d", "e"] and len({c.lower() for c in post.columns}) == len(post.columns)
    assert plan.columns["post"]["user~1username"] == "user/username" and plan.columns["post"]["user_username"] == "user_username"
    df = spark.createDataFrame([(1, '{"tag": [1, 2]}')], "k int, payload string")
    with pytest.raises(Exception, match="plan of other rows"):
        shred_json(df, "k", "payload", plan_inlining(schema_graph(df.limit(0), "payload", "post"), "post")).collect()


def test_only_wanted_tables_come_out(spark):
    cells, plan = shredded(spark, ['{"refs": [{"tags": ["a"]}, {"urls": [{"u": 1}]}], "other": [[1]]}'])
    df = spark.createDataFrame([(0, '{"refs": [{"tags": ["a"]}, {"urls": [{"u": 1}]}], "other": [[1]]}')], "k int, payload string")
    some = shred_json(df, "k", "payload", plan, elements={"tags"})
    assert [r.element for r in some.collect()] == ["tags"] and some.drop("cells").collect() == cells.filter("element = 'tags'").drop("cells").collect()


# ---- times

ZONES = {"EST": -5, "EDT": -4, "PST": -8, "PDT": -7, "CET": 1, "CEST": 2, "GMT": 0, "Z": 0}
FORMATS = [
    "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M", "%d.%m.%Y %H:%M:%S", "%d.%m.%Y, %H:%M", "%m/%d/%Y %I:%M:%S %p",
    "%m/%d/%Y %I:%M %p", "%Y%m%dT%H%M%S", "%a %b %d %H:%M:%S %Y", "%a, %d %b %Y %H:%M:%S",
]


def by_hand(text, host):
    if text is None:
        return None
    text = text.strip().upper()
    if re.fullmatch(r"[\d.]+(E\d+)?", text) and text.count(".") < 2:
        from decimal import Decimal

        x = Decimal(text)
        return int(x * 10**6 if x < 10**11 else x * 1000 if x < 10**14 else x if x < 10**17 else x // 1000)
    offset, frac = None, 0
    if m := re.search(r"\d{2}:\d{2} ?([+-]\d{2}(?::?\d{2})?)( \d{4})?$", text) or re.search(r"\d{2}\.\d+ ?([+-]\d{2}(?::?\d{2})?)()$", text):
        z = m[1].replace(":", "").ljust(5, "0")
        offset = (1 if z[0] == "+" else -1) * timedelta(hours=int(z[1:3]), minutes=int(z[3:5]))
        text = (text[: m.start(1)].strip() + (m[2] or "")).strip()
    elif (m := re.search(r" ?([A-Z]+)$", text)) and m[1] in ZONES:
        offset, text = timedelta(hours=ZONES[m[1]]), text[: m.start()]
    if m := re.search(r"(:\d\d)\.(\d+)", text):
        frac, text = int(m[2][:6].ljust(6, "0")), text.replace(m[0], m[1])
    for f in FORMATS:
        try:
            local = datetime.strptime(text, f)
            break
        except ValueError:
            continue
    else:
        return None
    local = local.replace(microsecond=frac)
    if offset is None:
        if host is None:
            return None
        if m := re.fullmatch(r"([+-])(\d\d):(\d\d)", host):
            offset = (1 if m[1] == "+" else -1) * timedelta(hours=int(m[2]), minutes=int(m[3]))
        else:
            aware = local.replace(tzinfo=ZoneInfo(host), fold=0)
            if aware.astimezone(UTC).astimezone(ZoneInfo(host)).replace(tzinfo=None) != local:
                return None
            offset = aware.utcoffset()
    return (local.replace(tzinfo=timezone(offset)) - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)


@pytest.mark.parametrize("folder", ["sf0.01"])
def test_p3_found_against_python(spark, folder):
    d = f"/root/testdata/{folder}"
    want = set()
    for r in pq.read_table(f"{d}/post_landing.parquet").to_pylist():
        text = next((r[c] for c in ("created_at", "tweet_time", "post_time") if r[c] is not None), None)
        want.add(("post_landing", r["row_id"], by_hand(text, r["capture_zone"])))
    for r in pq.read_table(f"{d}/twitter_posts.parquet").to_pylist():
        want.add(("twitter_posts", r["row_id"], by_hand(r["created_at"], None)))
    got = [tuple(r) for r in rq.p3_found(spark, d).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {w for w in want if w[2] is not None}


def us(*a):
    return int(datetime(*a, tzinfo=UTC).timestamp() * 1_000_000)


CASES = [
    ("2022-03-27T02:30:00", "Europe/Berlin", None),  # skipped
    ("2022-10-30T02:30:00", "Europe/Berlin", us(2022, 10, 30, 0, 30)),  # twice: the earlier
    ("2022-10-30T02:30:00 CET", "Europe/Berlin", us(2022, 10, 30, 1, 30)),
    ("2022-10-30T02:30:00", None, None),
    ("2022-10-30T02:30:00", "Nowhere/Town", None),
    ("2022-10-30T02:30:00", " +05:30 ", us(2022, 10, 29, 21, 0)),
    ("2022-10-30T02:30:00 XYZ", "Europe/Berlin", None),
    ("2022-10-30T02:30:00+99:00", None, None),
    ("2023-02-29 10:00:00Z", None, None),
    ("2024-02-29 10:00:00Z", None, us(2024, 2, 29, 10)),
    ("2022-01-01T24:00:00Z", None, None),
    ("2022-01-01T10:60:00Z", None, None),
    ("01/02/2022 12:00 am", "UTC", us(2022, 1, 2)),
    ("01/02/2022 13:00 pm", "UTC", None),
    ("01.02.2022 13:00", "UTC", us(2022, 2, 1, 13)),
    ("31.04.2022 13:00", "UTC", None),
    ("2022-01-01T00:00:00.1234567899Z", None, us(2022, 1, 1) + 123456),
    ("1641000000", None, 1641000000_000000),
    ("1641000000.5", None, 1641000000_500000),
    ("1641000000123", None, 1641000000_123000),
    ("1641000000123456", None, 1641000000_123456),
    ("1641000000123456789", None, 1641000000_123456),
    ("1.641E12", None, 1641000000_000000),
    ("9" * 25, None, None),
    ("1e99", None, None),
    ("yesterday", "UTC", None),
    ("2022-01-01 00:00", "localtime", None),
    ("2022-01-01 00:00", "Factory", None),
    ("2022-01-01 00:00", "Europe/Berlin", us(2021, 12, 31, 23)),
    ("", "UTC", None),
    (None, "UTC", None),
    ("x" * 1_000_000, "UTC", None),
]


def test_time_cases(spark):
    df = spark.createDataFrame([(i, t, z, "p") for i, (t, z, _) in enumerate(CASES)], "row int, text string, host string, parts string")
    got = {r["row"]: r["utc_us"] for r in normalise_times(df, "text", "host").collect()}
    assert got == {i: c[2] for i, c in enumerate(CASES)}
    good, bad = split_times(df, "text", "host")
    assert good.count() + bad.count() == len(CASES) and bad.columns == df.columns
    assert normalise_times(df.limit(0), "text").count() == 0


# ---- hot keys


def test_rounds():
    assert [rounds_for(n, 16) for n in (0, 1, 16, 17, 256, 257, 800_000)] == [1, 1, 1, 2, 2, 3, 5]
    with pytest.raises(ValueError):
        rounds_for(4, 1)


@pytest.mark.parametrize("fan_in,chunks", [(2, 16), (16, 4)])
def test_object_activity(spark, fan_in, chunks):
    rows = [("hot", f"u{i % 7}" if i % 5 else None, (i * 37) % 50 or None, i, "x") for i in range(2000)]
    rows += [("one", "u", 5, 9000, "x"), ("never", "u", None, 9001, "x"), ("never", "u", None, 9002, "x"), ("tie", "a", 1, 7, "x"), ("tie", "b", 1, 3, "x")]
    df = spark.createDataFrame(rows, "obj string, who string, at long, rid long, n_rows string").repartition(13)
    got = {r.obj: (r.n_rows, r.n_timed, r.n_accounts, r.first_row_id) for r in object_activity(df, ["obj"], "who", "at", "rid", chunks, fan_in).collect()}
    want = {}
    for o in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == o]
        timed = sorted((r[2], r[3]) for r in own if r[2] is not None)
        want[o] = (len(own), len(timed), len({r[1] for r in own} - {None}), timed[0][1] if timed else None)
    assert got == want
    bare = object_activity(df, ["obj"], "who", "at", "rid", chunks, fan_in, accounts=False)
    assert {r.obj: (r.n_rows, r.n_timed, r.first_row_id) for r in bare.collect()} == {k: (v[0], v[1], v[3]) for k, v in got.items()}
    assert object_activity(df.limit(0), ["obj"], "who", "at", "rid", chunks, fan_in).count() == 0
