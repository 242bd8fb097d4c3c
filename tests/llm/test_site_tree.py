"""HTML extraction: importance by its definition, and pages with a known template."""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa

from phonoflow.llm import site_tree as T
from phonoflow.session import table

SCHEMA = "page_id long, url string, html string, host string, noise string, text string"


def page(i: int) -> str:
    return (
        "<html><head><title>t</title><style>x{}</style></head><body><div class='nav'><a href='/'>Home</a> <a href='/a'>About</a></div>"
        f"<div class='main'><h1>Title {i}</h1><p>Body of page {i}, unlike <b>others</b>.<p>Second {i * 7}</div><script>var a = '<p>';</script><div id=foot>All rights reserved</div></body></html>"
    )


def test_template_goes_and_content_stays(spark):
    rows = [(i, f"http://site.example/{i}", page(i), None, None, None) for i in range(12)]
    rows += [(100, "http://other.example/", page(3), None, None, None), (101, None, page(4), None, None, None)]
    got = {r["page_id"]: r["text"] for r in T.extracted(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i in range(12):
        assert got[i] == f"Title {i}\nBody of page {i}, unlike others.\nSecond {i * 7}"
    assert got[100].startswith("Home About\nTitle 3")  # a host's only page
    assert got[101].endswith("All rights reserved")


def brute_noise(pages: list[str]) -> set[int]:
    """By the definition, over whole pages, without any aggregation in between."""
    present, styles, texts, kids = Counter(), {}, {}, {}
    for source in pages:
        seen = set()
        for key, node, style, keys in T.walk(T.parse(source)):
            if ("p", key) not in seen:
                present[key] += 1
            seen.add(("p", key))
            if node.text is not None:
                t = T._SPACE.sub(" ", node.text).strip()
                texts.setdefault(key, Counter())
                if (key, t) not in seen and any(c.isalnum() for c in t):
                    texts.setdefault(key, Counter())[t] += 1
                seen.add((key, t))
            elif (key, style, "s") not in seen:
                styles.setdefault(key, Counter())[style] += 1
                kids[key, style] = keys
                seen.add((key, style, "s"))

    def importance(e: int) -> float:
        m = present[e]
        if m < 2:
            return 1.0
        if e in texts and not texts[e]:
            return 0.0
        if e in texts:
            return max(0.0, 1 - sum(math.log(n) for n in texts[e].values()) / len(texts[e]) / math.log(m))
        total = sum(styles[e].values())
        node = min(1.0, -sum(n / total * math.log(n / total) for n in styles[e].values()) / math.log(m))
        inner = [(n, kids[e, s]) for s, n in styles[e].items() if kids[e, s]]
        below = sum(n * sum(map(importance, k)) / len(k) for n, k in inner) / sum(n for n, _ in inner) if inner else 0.0
        g = T.DAMPING ** len(styles[e])
        return (1 - g) * node + g * below

    def noise(e: int) -> bool:
        return importance(e) <= T.THRESHOLD and all(noise(k) for s in styles.get(e, ()) for k in kids[e, s])

    return {e for e in present if present[e] > 1 and noise(e)}


def test_whole_table_against_the_definition(spark, sf):
    pages = table(spark, sf, "pages").toPandas()
    from pyspark.sql import functions as F

    hosts = {r["page_id"]: r["h"] for r in table(spark, sf, "pages").select("page_id", T.host_of(F.col("url")).alias("h")).collect()}
    by: dict[str, list[str]] = {}
    for p in pages.itertuples():
        by.setdefault(hosts[p.page_id], []).append(p.html)
    bad = {h: brute_noise(x) for h, x in by.items()}
    want = {p.page_id: T.clean_text(p.html, bad[hosts[p.page_id]]) for p in pages.itertuples()}
    got = {r["page_id"]: r["text"] for r in T.op9_html_extraction(spark, sf).collect()}
    assert got == want
    assert any(bad.values())


def test_odd_rows(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    rows = [(1, "http://a.example/", None, "h", "n", "t"), (2, "http://a.example/", "", None, None, None), (3, None, None, None, None, None), (None, "http://a.example/x", "<p>x", None, None, None), (4, "http://b.example/", deep, None, None, None), (5, "no url", "</b><p>a < b &amp; c<td>d<!-- e", None, None, None), (6, "http://c.example", "<p>" + "long " * 100_000, None, None, None), (6, "http://c.example", "<p>" + "long " * 100_000, None, None, None)]
    got = [(r["page_id"], r["text"]) for r in T.extracted(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(rows)
    d = dict(got)
    assert (d[1], d[2], d[3], d[4]) == (None, "", None, "deep")
    assert "a < b & c" in d[5]
    assert T.extracted(spark.createDataFrame([], SCHEMA)).count() == 0


def test_statistics_add_up(spark):
    one = pa.RecordBatch.from_arrays([pa.array(["h"] * 3), pa.array([page(1), page(2), page(1)])], ["host", "html"])
    rows = pa.Table.from_batches(list(T._statistics(iter([one])))).to_pylist()
    root = T._hash("#root")
    assert [r["pages"] for r in rows if r["element"] == root and r["kind"] == 0] == [3]


def test_copies_of_pages_count_once(spark):
    """Repeated rows, copies under other URLs and copies that differ in what isn't seen don't make a text a template."""
    own = [(i, f"http://site.example/{i}", page(i), None, None, None) for i in range(12)]
    want = [f"Title {i}\nBody of page {i}, unlike others.\nSecond {i * 7}" for i in range(12)]
    copies = [(100 + i, f"http://site.example/copy/{i}", page(i).replace("var a", f"var a{i}").replace("<body>", f"<!-- {i} --><body data-n='{i}'>"), None, None, None) for i in range(12)]
    for extra in (own, own[:6], own * 3, copies, copies[:6]):
        rows = own + extra
        got = [(r["page_id"], r["text"]) for r in T.extracted(spark.createDataFrame(rows, SCHEMA)).collect()]
        assert sorted(got) == sorted((r[0], want[r[0] % 100]) for r in rows)


def test_styles_of_one_page_are_counted(spark):
    """Pages that each have their own body structure beside a shared foot: no row holds a struct for each page, and the foot goes."""
    from pyspark.sql import functions as F

    pages = [f"<body><div class=c{i}><p>Own text {i}<i>x{i}</i></div><div class=foot><p>The same on all</p></div></body>" for i in range(30)]
    df = spark.createDataFrame([(i, f"http://a.example/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    noise = {int(n) for r in T.site_noise(df).collect() for n in r["noise"]}
    assert noise == brute_noise(pages)
    assert T.extracted(df).where(F.col("text").contains("Own text")).count() == 30
