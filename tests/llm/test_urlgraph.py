from __future__ import annotations

from chargeframe.llm import urlgraph


def test_distrust_reaches_many_and_skewed_linkers(spark):
    """Hosts that link only to a blocked host are blocked, however many or large the other linkers are."""
    bad = '<a href="http://bad.com/de/1">'
    rows = [(0, "http://bad.com/de/1", "")] + [(i, f"http://many{i}.net/", bad) for i in range(1, 61)]
    rows += [(100, "http://worse.com/de/1", ""), (101, "http://small.net/", '<a href="http://worse.com/de/1">')]
    rows += [(200 + i, f"http://hot.net/{i}", '<a href="http://worse.com/de/1">') for i in range(300)]
    rows += [(600, "http://clean.net/", '<a href="http://many1.net/other"><a href="http://fine.net/">'), (601, "http://fine.net/", "")]
    got = {r["page_id"]: r["verdict"] for r in urlgraph.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {got[i] for i in [*range(61), 100, 101, *range(200, 500)]} == {"block"}
    assert got[601] == "allow"
