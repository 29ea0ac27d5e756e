import random

from codeloom.llm import pages

SCHEMA = "page_id long, url string, html string, text string, host string"


def test_markup():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";if(a<b){}</script></head><body><nav><ul><li>Menu</ul></nav>
    <div class="ad">Buy</div><article><header>Site head</header><h1>One &amp; two&copy;</h1><p>A <b>bold</b>\n word<br>next<p>Unclosed &#233; &zzz;<div class="comments"><p>Me too</p></div>
    <form><p>Name</p></form><ul><li>x<li>y</ul><div id="cookie-notice">We use</div><p title="a>b">end</p></article><aside>Side</aside><footer>&copy; F</footer>"""
    assert pages.marked_text(pages.blocks(pages._skip_raw(page))) == "One & two©\nA bold word next\nUnclosed é &zzz;\nx\ny\nend"
    for odd in ("", "<", "<p", "text only", "<article>", "<b>x</article></b>", "<!-- never closed <p>x</p>", "<script>x", "<p>" * 3000):
        pages.blocks(pages._skip_raw(odd))


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_common_lines_is_a_longest_common_subsequence():
    r = random.Random(2)
    for _ in range(2000):
        a, b = ([r.choice("abcd") for _ in range(r.randrange(14))] for _ in range(2))
        found = pages.common_lines(a, b)
        rest = iter(b)
        assert len(found) == lcs(a, b) and all(a[k] in rest for k in found)


def test_differencing_and_odd_rows(spark):
    def plain(k):
        return f"<body><div>Home</div><div>About us</div><p>Own text {k}</p><p>More {k * 7}</p><div>All rights</div></body>"

    rows = [(k, f"http://a.example/x/{k}", plain(k)) for k in range(6)]
    rows += [(10, "http://b.example/1", "<main><p>kept</p></main><p>out</p>"), (11, None, None), (12, "no host", ""), (13, "http://alone.example/", plain(99)), (14, "http://c.example/1", "<article></article>")]
    frame = spark.createDataFrame([(*r, "own", "own") for r in rows], SCHEMA)
    got = pages.main_texts(frame).collect()
    assert sorted(r.page_id for r in got) == sorted(r[0] for r in rows)
    texts = {r.page_id: r.text for r in got}
    assert sum(texts[k] == f"Own text {k}\nMore {k * 7}" for k in range(6)) >= 4  # a page alone in its partition has no pair
    assert texts[10] == "kept" and texts[11] == texts[12] == "" and texts[13].count("\n") == 4
    assert texts[14] == ""


def test_edges_of_ranges_and_marked_pages(spark):
    """More ranges than pages of a host: every page still meets both of its neighbours."""
    plain = lambda k: f"<div>Home</div><p>Own text {k}</p><div>All rights</div>"
    article = lambda k: f"<article><h1>Title {k}</h1><p>Sign our letter</p><p>{'Told twice' if k in (3, 4) else f'Told {k}'}</p><p>End {k}</p></article><p>Around</p>"
    rows = [(k, f"http://a.example/x/{k:02}", plain(k)) for k in range(12)] + [(100 + k, f"http://b.example/{k}", article(k)) for k in range(8)]
    rows += [(200 + k, f"http://c.example/{k}", "<main><p>Copied</p><p>text</p></main>") for k in range(4)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        texts = {r.page_id: r.text for r in pages.main_texts(spark.createDataFrame([(*r, "own", "own") for r in rows], SCHEMA)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(texts) == len(rows)
    assert all(texts[k] == f"Own text {k}" for k in range(12))
    told = lambda k: "Told twice" if k in (3, 4) else f"Told {k}"
    assert all(texts[100 + k] == f"Title {k}\n{told(k)}\nEnd {k}" for k in range(1, 7))
    assert all(texts[100 + k] == f"Title {k}\nSign our letter\n{told(k)}\nEnd {k}" for k in (0, 7))  # one neighbour only
    assert all(texts[200 + k] == "Copied\ntext" for k in range(4))


def test_tables_by_a_walk_over_all_pages(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = []
    for r in frame.collect():
        found = pages.blocks(pages._skip_raw(r.html or ""))
        inside = next((m for m in pages.MAIN if any(w == m for w, _ in found)), None)
        host, path = pages._place(r.url)
        rows.append({"id": r.page_id, "host": host, "path": path, "marked": inside is not None, "lines": [t for _, t in found], "blocks": [t if inside in (None, w) else None for w, t in found]})
    rows.sort(key=lambda r: (r["host"], r["path"], r["id"]))
    want = {}
    for k, r in enumerate(rows):
        beside = [rows[i] for i in (k - 1, k + 1) if 0 <= i < len(rows) and rows[i]["host"] == r["host"]]
        want[r["id"]] = "\n".join(pages.kept_lines(r, beside))
    assert {r.page_id: r.text for r in pages.main_texts(frame).collect()} == want


def test_tables(spark, sf_dir):
    got = pages.main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()
    assert got and all(r.text for r in got)
    assert not any("<" in r.text and "</p>" in r.text for r in got)


def test_empty_table(spark):
    assert pages.main_texts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_copies_keep_their_lines(spark):
    html = "<p>one line of text</p><p>another line</p>"
    rows = [(k, "http://a.example/x", html) for k in range(3)] + [(3, "http://a.example/x", html)]
    got = pages.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {"one line of text\nanother line"} and len(got) == 4
