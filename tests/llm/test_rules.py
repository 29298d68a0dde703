"""Thousands of url rules against brute force."""

import json
import random
import re

from corpusloom.llm import url_filter


def test_ten_thousand_rules(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    hosts = [f"{rng.choice('abcdef')}{rng.randrange(60)}.{rng.choice(['com', 'net', 'io'])}" for _ in range(400)]
    rules = [{"verdict": rng.choice(["allow", "block"]), "host": rng.choice(["", "www."]) + h, "path": rng.choice(["/", "/a/", "/b", "/b.c/d", ""])} for h in rng.choices(hosts, k=8000)]
    rules = list({(r["host"], r["path"]): r for r in rules}.values())
    rules += [{"verdict": rng.choice(["allow", "block"]), "words": [f"w{rng.randrange(900)}" for _ in range(rng.choice([1, 1, 2, 3]))]} for _ in range(9000)]
    rules = list({json.dumps([r.get("words"), r.get("host"), r.get("path")]): r for r in rules}.values())
    path = tmp_path / "rules.json"
    path.write_text("\n".join(map(json.dumps, rules)))
    urls = [f"http://{rng.choice(['', 'www.', 'x.'])}{rng.choice(hosts)}{rng.choice(['', '/', '/a/q', '/b', '/bc', '/b.c/d?x', '/z'])}{rng.choice(['', f'/w{rng.randrange(1200)}', f'?w{rng.randrange(900)}-w{rng.randrange(900)}'])}" for _ in range(400)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string").repartition(3)
    words = [(r["words"], r["verdict"]) for r in rules if "words" in r]

    def want(u):
        rest = re.split("[?#]", u.split("://", 1)[1])[0] if "://" in (u or "") else ""
        host, path = rest.split("/", 1)[0], rest[len(rest.split("/", 1)[0]) :]
        fit = [r for r in rules if "host" in r and (host == r["host"] or host.endswith("." + r["host"])) and (path.startswith(r["path"]) if r["path"] else True)]
        best = max(fit, key=lambda r: (len(r["host"] + r["path"]), r["host"] + r["path"]), default=None)
        if best:
            return best["host"] + best["path"], best["verdict"]
        parts = re.split("[^a-z0-9]", u or "")
        said = [v for w, v in words if any(parts[i : i + len(w)] == w for i in range(len(parts)))]
        return None, "block" if said and "allow" not in said else "allow"

    for most in (50_000, 4000):
        monkeypatch.setattr(url_filter, "BROADCAST_RULES", most)
        got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(df, url_filter.load_rules(spark, str(path))).collect()}
        wrong = [(u, got[i], want(u)) for i, u in enumerate(urls) if got[i] != want(u)]
        assert len(got) == len(urls) and not wrong, wrong[:3]
    assert len({v for v in got.values()}) > 50


def test_pages_are_not_shuffled(spark):
    df = spark.createDataFrame([(1, "http://a.com/")], "page_id int, url string")
    plan = url_filter.judge(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan.split("Join", 1)[0]
