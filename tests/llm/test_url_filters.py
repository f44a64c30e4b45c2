import datetime
import random

import pytest

from fieldloom.llm import url_filters


def at(hours):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=hours)


def covers(pattern, host, path):
    kind, rest = pattern.split(":", 1)
    if kind == "d":
        return host == rest or host.endswith("." + rest)
    return (host + path).startswith(rest) if kind == "p" else host + path == rest


def brute(url, time, events, host, path):
    state = {}
    for pattern, ts, action, category in sorted(events, key=lambda e: (e[1], e[2] == "add")):
        if ts <= time:
            state[pattern] = (action, category)
    live = sorted(((0 if p[0] == "u" else 1 if p[0] == "p" else 2), -len(p), p) for p, (a, _) in state.items() if a == "add" and covers(p, host, path))
    return (len(live), live[0][2], state[live[0][2]][1]) if live else (0, None, None)


@pytest.mark.parametrize("days", [30, 1])
def test_against_replay(spark, days):
    draw = random.Random(days)
    hosts = ["a.org", "x.a.org", "y.x.a.org", "b.net"]
    paths = ["/", "/p", "/p/", "/p/q", "/p/q/r", "/z"]
    patterns = ["d:a.org", "d:x.a.org", "d:b.net", "p:a.org/", "p:a.org/p/", "p:x.a.org/p/q/", "u:a.org/p", "u:b.net/z", "u:y.x.a.org/p/q/r"]
    events = {}
    for _ in range(300):
        pattern, ts, action = draw.choice(patterns), at(draw.randint(0, 5000)), draw.choice(["add", "remove"])
        events[(pattern, ts)] = (pattern, ts, action, draw.choice(["k1", "k2"]) if action == "add" else None)
    captures, want = [], []
    for i in range(300):
        host, path, time = draw.choice(hosts), draw.choice(paths), draw.choice([at(draw.randint(-50, 6000)), draw.choice(list(events))[1]])
        captures.append((i, f"{draw.choice(['http', 'HTTPS'])}://{draw.choice(['', 'me:pw@'])}{draw.choice([host, host.upper()])}{draw.choice(['', ':8080', '.'])}{path}{draw.choice(['', '?q=/p/', '#f'])}", time, "x"))
        want.append(brute(captures[-1][1], time, events.values(), host, path))
    got = url_filters.judge(spark.createDataFrame(captures, "page_id int, url string, fetched_at timestamp, bucket string"),
                            spark.createDataFrame(list(events.values()), "pattern string, ts timestamp, action string, category string"), days).collect()
    assert [(r.n_active, r.pattern, r.category) for r in sorted(got, key=lambda r: r.page_id)] == want
    assert all(r.blocked == (r.n_active > 0) for r in got)


def test_nulls_ties_repeats_and_empty_tables(spark):
    captures = spark.createDataFrame([(1, None, at(5)), (2, "http://a.org/", None), (3, "no address", at(5)), (4, "http://a.org", at(5)), (4, "http://a.org", at(5)), (None, "http://a.org/x", at(1))], "page_id int, url string, fetched_at timestamp")
    events = spark.createDataFrame([("d:a.org", at(2), "remove", None), ("d:a.org", at(2), "add", "k2"), ("d:a.org", at(2), "add", "k1"), (None, at(1), "add", "k"), ("d:a.org", None, "add", "k"), ("d:a.org", at(4), "maybe", "k")],
                                   "pattern string, ts timestamp, action string, category string")
    got = url_filters.judge(captures, events).collect()
    assert len(got) == 6 and [(r.n_active, r.category) for r in got if r.page_id == 4] == [(1, "k1")] * 2
    assert not any(r.blocked for r in got if r.page_id != 4)
    assert not any(r.blocked for r in url_filters.judge(captures, events.limit(0)).collect()) and url_filters.judge(captures.limit(0), events).count() == 0
    with pytest.raises(ValueError):
        url_filters.judge(captures.withColumnRenamed("page_id", "pattern"), events)
