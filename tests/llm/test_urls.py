import math
import re

import numpy as np
import pyarrow as pa

from folioweave.llm import queries, urls
from folioweave.llm.queries import URL_RULES


def slow(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for kind, h, p in URL_RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1])):
            best = kind, h + p
    return host, path, best


def test_rules_and_parts(spark):
    rows = ["http://A.Example.COM/en/7x?q", "https://example.com/en/", "x://com/en/8#f", "http://notcom/en/", None, "", "no scheme/en/", "a://b://c/d", "http://É.net/de/8/", "http://example.net/de/81", "h://s.org/es/?/en/", "h://s.org/es", "h://x.com?/en/", "h://u\n.com/en/\nz", "h://ee.net/de/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(rows + rows[:3])] + [(None, "h://a.com/en/7", "h")], "page_id long, url string, host string")
    got = urls.judge(pages, URL_RULES, None, ("page_id", "url")).collect()
    assert len(got) == len(rows) + 4
    for r in got:
        host, path, best = slow(r.url)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best and best[1], best[0] if best else "allow"), r
    assert urls.train(pages.where("false").withColumn("label", pages.url)) is None


def test_features_of_a_text_do_not_depend_on_its_neighbours():
    hosts, paths = pa.array(["a.com", "", "bé.org"]), pa.array(["/x/y", "", None])
    row, bucket, value = urls.features(hosts, paths)
    alone = urls.features(hosts.slice(2), paths.slice(2))
    assert sorted(bucket[row == 2]) == sorted(alone[1]) and np.isclose(value[row == 2].sum(), alone[2].sum())
    assert len(bucket[row == 1]) > 0


def test_held_out_accuracy(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    labelled = urls.labelled_by_rules(pages, URL_RULES)
    cut = "crc32(url) % 4 = 0"
    weights = urls.train(labelled.where(f"NOT {cut}"))
    held = labelled.where(cut).distinct()
    got = urls.judge(held, [], weights, ("url", "label")).collect()
    assert len(got) > 50 and sum(r.verdict == r.label for r in got) / len(got) > 0.85
    again = urls.judge(pages, URL_RULES, urls.train(labelled)).where("rule IS NULL").groupBy("verdict").count().collect()
    assert len(again) >= 1


def test_very_long_urls_and_no_pages(spark):
    train = spark.createDataFrame([("h://good.org/a", "allow"), ("h://bad.org/b", "block")] * 3, "url string, label string")
    weights = urls.train(train)
    long = "h://bad.org/" + "b" * 1_000_000
    pages = spark.createDataFrame([(1, long), (2, "h://x." * 50_000 + "com/en/" + "?q" * 500_000), (3, long), (4, "h://" + "y." * 100_000 + "com/en/é")], "page_id long, url string")
    got = {r.page_id: r for r in urls.judge(pages, URL_RULES, weights).collect()}
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got.values())
    assert (got[1].path, got[1].score, got[1].verdict) == (long[11:], got[3].score, got[3].verdict)
    assert (got[4].rule, got[4].verdict, got[2].rule) == ("com/en/", "block", None)
    assert urls.judge(pages.where("false"), URL_RULES, weights).collect() == []


def plain_score(host, path, w):
    """The model's probability of block, gram by gram."""
    hits, total = 0.0, 0
    for part, text in enumerate((host, path)):
        marked = [1, *(b + 2 + 32 * (65 <= b <= 90) for b in text.encode()), 1]
        for size in urls.GRAMS:
            for i in range(len(marked) - size + 1):
                code = 7 * part + size
                for x in marked[i : i + size]:
                    code = (code * 0x100000001B3 + x) % 2**64
                hits += w[(code * 0x9E3779B97F4A7C15) % 2**64 >> 49]
                total += 1
    return 1 / (1 + math.exp(-(hits / math.sqrt(max(1, total)) + w[-1])))


def test_whole_query_against_a_plain_recomputation(spark):
    """Every page's row of the registered query; only the fitted weights are taken over."""
    sf_dir = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    w = urls.train(urls.labelled_by_rules(pages, URL_RULES))
    found = {r.page_id: r for r in queries.op4_url_verdicts(spark, sf_dir).collect()}
    rows = pages.collect()
    assert len(found) == len(rows)
    for r in rows:
        host, path, best = slow(r.url)
        score = plain_score(host, path, w)
        got = found[r.page_id]
        assert (got.host, got.path, got.rule) == (host, path, best and best[1]) and abs(got.score - score) < 1e-9
        assert got.verdict == (best[0] if best else "block" if score > 0.5 else "allow")


def test_a_rare_label_is_drawn_as_often_as_a_common_one(spark):
    many = spark.range(60_000).selectExpr("concat('h://good.org/', id) AS url", "'allow' AS label")
    few = spark.range(20).selectExpr("concat('h://worse.net/x', id) AS url", "'block' AS label")
    w = urls.train(many.union(few))
    pages = spark.createDataFrame([(1, "h://worse.net/x99999"), (2, "h://good.org/99999999")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in urls.judge(pages, [], w).collect()} == {1: "block", 2: "allow"}


def test_rules_are_the_contracts(spark):
    """Each rule's word, host and path as the contract lists them, and the verdicts of pages that only they decide."""
    listed = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"
    assert ", ".join(f"{kind} {host}{path}" for kind, host, path in URL_RULES) == listed
    rows = [(1, "h://a.net/de/7"), (2, "h://example.net/de/7"), (3, "h://a.example.net/de/8"), (4, "h://a.com/en/7"), (5, "h://example.com/en/7"), (6, "h://b.org/es/")]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), URL_RULES, None)
    assert {r.page_id: r.verdict for r in got.collect()} == {1: "allow", 2: "allow", 3: "block", 4: "block", 5: "allow", 6: "block"}
