from pixledger.llm import url_filter as u


def test_parts_rules_and_flow(spark, no_documents):
    urls = [
        "http://A.Example.NET/en/x?y#z", "https://b.net/q", "https://b.net?q", "ftp://example.com/de/1", "http://example.com/en/", "http://org/fr/", "http://x.org/de/",
        "notexample.net/en/", None, "://", "http://notnet/", "http://bad.example.com/de/1", "http://bad.example.com/de/2", "http://bad.example.com/de/3", "http://bad.example.com/en/",
    ]
    rows = [(i, x, None, "extra") for i, x in enumerate(urls)]
    rows.append((99, "http://linker.example.info/", '<p><a class="x" href="https://bad.example.com/de/">x</a> <A HREF=//Bad.example.com>', "extra"))
    found = {r["page_id"]: r for r in u.judged(spark.createDataFrame(rows, "page_id long, url string, html string, says string")).collect()}
    assert (found[0]["host"], found[0]["path"], found[0]["rule"], found[0]["verdict"]) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert found[1]["rule"] == "net/" and found[1]["verdict"] == "block"
    assert found[2]["rule"] is None and found[2]["path"] == ""
    assert found[3]["verdict"] == "block" and found[4]["rule"] is None and found[5]["rule"] == "org/fr/" and found[6]["rule"] is None
    assert all((found[k]["host"], found[k]["path"]) == ("", "") for k in (7, 8, 9)) and found[10]["rule"] is None
    assert found[14]["verdict"] == "block"
    assert found[99]["distrust"] > 0
    assert len(found) == len(rows)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert u.judged(empty).collect() == []


def test_ranks_against_a_plain_computation(spark):
    """A chain of more than ten hops is settled too."""
    edges = [("a", "b", 1.0), ("b", "c", 2.0), ("b", "a", 1.0), ("c", "a", 1.0)] + [(f"h{k:02}", f"h{k + 1:02}", 1.0) for k in range(30)]
    start = {"a": (4.0, 0.0), "b": (0.0, 0.0), "c": (1.0, 3.0), "h00": (50.0, 0.0), "h30": (0.0, 60.0)}
    frame = spark.createDataFrame([(h, *v) for h, v in start.items()], "host string, t double, d double")
    found = {r["host"]: (r["t"], r["d"]) for r in u.propagated(frame, spark.createDataFrame(edges, "a string, b string, weight double")).collect()}
    hosts = {h for e in edges for h in e[:2]}
    start = {h: start.get(h, (0.0, 0.0)) for h in hosts}
    now = dict(start)
    for _ in range(300):
        new = {h: [0.15 * v[0], 0.15 * v[1]] for h, v in start.items()}
        for a, b, w in edges:
            new[b][0] += 0.85 * now[a][0] * w / sum(x[2] for x in edges if x[0] == a)
            new[a][1] += 0.85 * now[b][1] * w / sum(x[2] for x in edges if x[1] == b)
        now = {h: tuple(v) for h, v in new.items()}
    assert all(abs(found[h][k] - now[h][k]) < 20 * u.SETTLED for h in start for k in (0, 1))
    assert found["h25"][0] > 0.1 and found["h05"][1] > 0.1


def test_hosts_that_link_to_blocked_ones(spark):
    """Blocked hosts that were never fetched count, and the number of pages does not make a host safer."""
    link = lambda *hosts: "".join(f'<a href="https://{h}/x">l</a>' for h in hosts)
    spam = link(*(f"s{k}.net" for k in range(10)))
    rows = [(0, "http://one.info/", spam)] + [(k, f"http://farm.info/{k}", link(*(f"f{j}.net" for j in range(20)))) for k in range(1, 401)]
    rows += [(500 + k, f"http://good.info/{k}", link("fine.org/fr", "fine.info")) for k in range(20)] + [(600, "http://mixed.example.com/de/1", None)]
    rows += [(601 + k, f"http://mixed.example.com/en/{k}", "") for k in range(30)] + [(700, "http://quiet.info/", "x" * 300_000), (701, "http://ok.org/fr/", link("friend.info"))]
    rows += [(702, "http://friend.info/", None)] + rows[:1] * 300
    found = {r["page_id"]: r for r in u.judged(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[0]["verdict"] == found[1]["verdict"] == found[400]["verdict"] == "block"
    assert {found[k]["verdict"] for k in (500, 601, 700, 701, 702)} == {"allow"}
    assert found[600]["verdict"] == "block" and found[702]["trust"] > 0
