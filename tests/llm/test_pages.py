"""Operators 1, 7, 8 and 10 against brute-force versions."""
import base64
import hashlib
import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from kitlend.llm import chat, html_text, topk, warc

SF = "/root/testdata/sf0.001"


# --- chat ----------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, n long, part string"


def brute_cost(roles):
    """Least cost over every choice of state and way, by dynamic programming over
    explicit sequences."""
    legal = {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    code = {s: i for i, s in enumerate(chat.STATES)}
    best = {"": 0}
    for role in roles:
        label = chat.LABEL[code.get(role, 0)]
        nxt = {}
        for s, c in best.items():
            for x in ("system", "user", "assistant"):
                ways = [0] if x in legal[s] else []
                ways += [chat.MERGE] if x == s else []
                ways += [chat.INSERT for y in ("user", "assistant") if y in legal[s] and x in legal[y]]
                if ways:
                    nxt[x] = min(nxt.get(x, 1 << 40), c + min(ways) + label[code[x]])
        best = nxt
    return min(best.values())


def rendered(rows):
    return "".join(r.fragment for r in sorted(rows, key=lambda r: r.position))


def legal_text(text):
    roles = [part.split("|>")[0] for part in text.split("<|")[1:] if not part.startswith("end")]
    if roles and roles[0] == "system":
        roles = roles[1:]
    return all(r == ("user", "assistant")[i % 2] for i, r in enumerate(roles))


@pytest.mark.parametrize("piece", [4096, 3])
def test_least_cost_and_legal(spark, piece):
    rnd = random.Random(2)
    convs = {i: [rnd.choice(["user", "assistant", "system", None, "tool", " User "]) for _ in range(rnd.randint(1, 14))]
             for i in range(120)}
    rows = [(i, t, r, f"t{t}", 0, "clash") for i, roles in convs.items() for t, r in enumerate(roles)]
    out = defaultdict(list)
    for r in chat.format_chats(spark.createDataFrame(rows, TURNS), piece).collect():
        out[r.conv_id].append(r)
    for i, roles in convs.items():
        plain = [r.strip().lower() if r else r for r in roles]
        assert sum(r.cost for r in out[i]) == brute_cost(plain)
        text = rendered(out[i])
        assert legal_text(text) and text.endswith("\n<|end|>\n")
        assert [int(x) for x in [r.fragment.split("t")[-1].split("\n")[0] for r in sorted(out[i], key=lambda r: r.position)]] == list(range(len(roles)))


def test_pieces_do_not_change_the_repair(spark):
    rnd = random.Random(7)
    rows = [(1, t, rnd.choice(["user", "assistant", "system", "x"]), str(t), 0, "") for t in range(500)]
    df = spark.createDataFrame(rows, TURNS)
    key = lambda r: (r.position, r.new_role, r.action, r.fragment)
    whole, cut = (sorted(map(key, chat.format_chats(df, n).collect())) for n in (4096, 7))
    assert whole == cut and [k[0] for k in whole] == list(range(500))


def test_chat_edges(spark):
    df = spark.createDataFrame([(None, 1, "user", None, 0, ""), (None, None, None, "", 0, ""), (2, 1, "assistant", "x", 0, ""),
                                (2, 1, "assistant", "x", 0, "")], TURNS)
    got = chat.format_chats(df).collect()
    assert len(got) == 4
    two = rendered([r for r in got if r.conv_id == 2])
    assert two == "<|user|>\n\n<|end|>\n<|assistant|>\nx\nx\n<|end|>\n"
    assert chat.format_chats(spark.createDataFrame([], TURNS)).collect() == []


# --- html ----------------------------------------------------------------------

def page(i, body, host="h.example.com"):
    return (i, f"https://{host}/p{i}?q#f", body)


def test_article_pages(spark):
    import html
    import re
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in html_text.extracted(pages).collect()}
    for r in pages.collect():
        own = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        own = re.sub(r"</?b>", "", own.replace("<br>", " "))
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", own)).split())
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


def test_deduced_template_without_article_elements(spark):
    """The slot between the template's tokens, without its fixed wording."""
    rnd = random.Random(0)
    words = lambda n: " ".join(f"w{rnd.randint(0, 9999)}" for _ in range(n))
    rows, want = [], {}
    for i in range(12):
        body = [words(40), words(30)]
        rows.append(page(i, "<html><body><div class='top'>Our site</div><div><a href=/a>Home</a><a>Shop</a></div>"
                            f"<div class='box'><h1>T{i}</h1><p>{body[0]}<p>{body[1]}</div><div class='sidebar'>{words(90)}</div>"
                            f"<section id=comments><p>{words(50)}</p></section><form>{words(5)}</form>"
                            "<div class='low'>Copyright all rights</div><script>x='<p>'</script></body></html>"))
        want[i] = f"T{i} {body[0]} {body[1]}"
    got = {r.page_id: r.text for r in html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def three_hosts():
    """Pages of a host with article elements, one with containers alone, one whose
    frame some pages lack; and the texts wanted."""
    rnd = random.Random(4)
    words = lambda n: " ".join(f"w{rnd.randint(0, 9999)}" for _ in range(n))
    rows, want = [], {}
    for i in range(9):
        one, two, other = words(40), words(30), words(25)
        rows.append((i, "https://a.example/x", f"<body><div class=top>A</div><article><h1>T{i}</h1><div class=intro><p>{one}</div>"
                     f"<div class=rest><p>{two}</div><nav>n</nav></article><div class=low>{other}</div></body>"))
        want[i] = f"T{i} {one} {two}"
        rows.append((100 + i, "https://b.example/x", f"<body><div class=top>Our site</div><div class=text><h1>T{i}</h1>"
                     f"<p>{one}<p>{two}</div><div class=low>{words(8)}</div></body>"))
        want[100 + i] = f"T{i} {one} {two}"
        frame = "text" if i % 4 else "odd"
        rows.append((200 + i, "https://c.example/x", f"<body><div class=top>Our site</div><div class={frame}><p>{one}</div></body>"))
        want[200 + i] = one
    return rows, want


PAGES = "page_id long, url string, html string"


def test_three_hosts(spark):
    rows, want = three_hosts()
    assert {r.page_id: r.text for r in html_text.extracted(spark.createDataFrame(rows, PAGES)).collect()} == want


def test_an_article_of_equal_pages_is_kept(spark):
    rows = [(i, "https://a.example/", f"<body><{tag}><p>Same words</{tag}></body>") for i in range(5) for tag in ("article", "div")]
    got = Counter(r.text for r in html_text.extracted(spark.createDataFrame(rows, PAGES)).collect())
    assert got == {"Same words": 10}


def test_templates_equal_brute_force(spark):
    """Slot and fixed wording against occurrence vectors that are held in full."""
    rows, _ = three_hosts()
    hosts = defaultdict(list)
    for i, url, text in rows:
        hosts[url.split("/")[2]].append((str(i), html_text.Page(text)))
    df = spark.createDataFrame([(h, i, rows[k][2]) for k, (i, h) in enumerate(
        (str(r[0]), r[1].split("/")[2]) for r in rows)], "host string, page_id string, html string").repartition(5)
    got = {r.host: r for r in html_text.templates(df).collect()}
    for host, pages in hosts.items():
        vectors, about, mass, whole = defaultdict(dict), {}, Counter(), 0
        for i, p in pages:
            weight = p.mass()
            whole += weight[0]
            for t in range(1, len(p.key)):
                vectors[p.key[t]][i] = p.times[t]
                about[p.key[t]] = (p.kind[t], p.depth[t])
                mass[p.key[t]] += weight[t]
            for (t, said), n in Counter((t, said) for t, said, _ in p.blocks).items():
                vectors[p.text_key(t, said)][i] = n
                about[p.text_key(t, said)] = (html_text.TEXT, p.depth[t] + 1)
        classes = Counter(tuple(sorted(v.items())) for v in vectors.values())
        valid = [k for k, v in vectors.items() if classes[tuple(sorted(v.items()))] > 1
                 and len(v) >= max(html_text.MIN_PAGES, html_text.MIN_SHARE * len(pages))]
        frames = [(about[k][1], mass[k], k) for k in valid if mass[k] >= html_text.MAIN_SHARE * whole
                  and (about[k][0] == html_text.ARTICLE
                       or about[k][0] == html_text.CONTAINER and set(vectors[k].values()) == {1})]
        assert got[host].slot == max(frames)[2]
        assert sorted(got[host].fixed) == sorted(k for k in valid if about[k][0] == html_text.TEXT)


@pytest.mark.parametrize("text", [
    "<div>" * 100_000 + "x", "<p>a" + "<svg>" * 100_000 + "x", "<div>" * 50_000 + "</b></foo>" * 50_000 + "x", "<a \"'<a '\"" * 50_000,
    "<div " + "a-" * 100_000 + " =>x", "<!--" * 100_000, "</" * 100_000, "<" * 200_000,
    "".join(f"<div class=c{i}>t{i}" for i in range(50_000))], ids=lambda t: t[:9])
def test_deep_and_broken_markup_takes_linear_time(text):
    import time
    import tracemalloc
    start = time.process_time()
    html_text.main_text(html_text.Page(text), None, None, set())
    assert time.process_time() - start < 5
    short = text[:len(text) // 50]
    tracemalloc.start()
    html_text.Page(short).mass()
    assert tracemalloc.get_traced_memory()[1] < 1000 * len(short) + 1_000_000
    tracemalloc.stop()


def test_html_details(spark):
    rows = [page(1, "<article><header><h1>A &amp; B</h1></header><p>x<b>y</b>z &#233;&nbsp;q<br>r</p><span class='ad'>buy</span>"
                    "<aside>no</aside><!-- c > --><div hidden>no</div>tail<div class='comments'><p>no</p></div></article><footer>f</footer>"),
            (2, None, None), page(3, ""), page(4, "just text <"), page(4, "just text <"),
            page(5, "<main><nav>n</nav><ul><li>one<li>two</ul><div role=alert>no</div></main><p>out</p>", "other"),
            page(6, "<body><p>a < b</p><style>p{}</style><div style='display: none'>no</div>", "third"),
            page(7, "<article>" + "word " * 100_000 + "</article>", "long")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'c' AS host", "'c' AS slot", "1 AS text")
    got = [(r.page_id, r.text) for r in html_text.extracted(df).collect()]
    assert sorted(got) == [(1, "A & B xyz é q r tail"), (2, ""), (3, ""), (4, "just text <"), (4, "just text <"),
                           (5, "one two"), (6, "a < b"), (7, " ".join(["word"] * 100_000))]
    assert html_text.extracted(df.limit(0)).collect() == []


@pytest.mark.parametrize("parts", [1, 8])
def test_turns_that_tie_come_in_text_order(spark, parts):
    rows = [(1, 5, "user", f"{i:02}") for i in range(40)][::-1] + [(1, 5, "user", "17")] * 30
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    texts = [r.fragment.strip().split("\n")[1 if r.action != "merge" else 0].strip() for r in sorted(got, key=lambda r: r.position)]
    assert texts == sorted(r[3] for r in rows)


# --- top-k ---------------------------------------------------------------------

def brute_top(vectors, k, every):
    q = {}
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            q[i] = [int(np.floor(64 * float(np.float32(x)))) for x in v]
    out = set()
    for i in q:
        if i % every == 0:
            s = sorted((-sum(a * b for a, b in zip(q[i], v, strict=False)), j) for j, v in q.items() if j != i)[:k]
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(s)}
    return out


def test_repeated_ids_and_large_components(spark):
    rows = [(20, [1.0]), (20, [-1.0]), (1, [2.0]), (2, [-2.0]), (3, [3.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 2).collect()
    one, two = 64 * 64, 2 * 64 * 64
    assert Counter((r["rank"], r.vec_id, r.score) for r in got) == Counter(
        [(1, 3, 3 * one), (2, 1, two), (1, 2, two), (2, 20, -one)])
    large = [(20, [1e9, 1.0]), (1, [0.5, 0.0]), (2, [-1.0, 1.0])]
    got = topk.top_k(spark.createDataFrame(large, "vec_id long, embedding array<float>"), 2).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [
        (1, 64 * 10**9 * 32), (2, -64 * 64 * 10**9 + 64 * 64)]
    with pytest.raises(Exception, match="(?i)overflow|too large|too big"):
        topk.top_k(spark.createDataFrame([(20, [1e9]), (1, [1e9])], "vec_id long, embedding array<float>"), 2).collect()


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, rng.normal(size=8).round(1).tolist()) for i in range(300)]
    vectors += [(400, None), (401, [1.0, None]), (402, [float("nan")]), (403, [float("inf")]), (None, [1.0]), (420, [2.0, 1.0]),
                (440, []), (460, [1e9] * 8)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").selectExpr("*", "'c' AS q", "2 AS shard")
    for shard_rows, query_rows in ((16384, 512), (37, 4)):
        got = topk.top_k(df, 5, 20, shard_rows, query_rows).collect()
        assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == brute_top(vectors, 5, 20)
    assert topk.top_k(df.limit(0)).collect() == []


def test_blocks_are_pruned():
    rng = np.random.default_rng(0)
    centers = rng.integers(-60, 60, (20, 16))
    rows = np.repeat(centers, 100, 0) + rng.integers(-3, 4, (2000, 16))
    ids = np.arange(2000)
    parts, scored = topk.search_cell(ids, rows, ids[::100], rows[::100], 5, 100)
    s = rows[::100] @ rows.T
    for i, part in enumerate(parts):
        want = sorted((-s[i, j], j) for j in ids if j != i * 100)[:5]
        assert [(-x, j) for _, j, x in part.tolist()] == want
    assert scored < 0.5 * 20 * 20


# --- warc ----------------------------------------------------------------------

def test_archives_round_trip(spark):
    rows = [(1, "http://a/", "same"), (7, "http://b/", "same"), (3, None, "same"), (2, "http://c/\r\nx", "a\r\n\r\nb\r\n\r\n"),
            (4, "u", None), (5, "u", ""), (None, "n", "alone"), (8, "big", "é漢\n" * 50_000), (9, "w", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc"),
            (10, "t", "\r\n\r\n"), (11, "t", "\r\n\r")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'c' AS digest", "'c' AS payload")
    from kitlend.llm.common import new_folder
    path = new_folder(spark, "warc-test")
    got = {r.page_id: r for r in warc.archived_pages(pages, path=path).collect()}
    same = defaultdict(list)
    for i, _, h in rows:
        same[h or ""].append(-1 if i is None else i)
    for i, _, h in rows:
        raw = (h or "").encode()
        top = max(same[h or ""])
        kept = (-1 if i is None else i) == top
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if kept else ("revisit", top))
    back = {r.record_key: r for r in warc.read_archives(spark, path).collect()}
    for i, _, h in rows:
        r = back["null" if i is None else str(i)]
        assert (bytes(r.payload).decode() == (h or "")) if r.record_type == "response" else len(r.payload) == 0
    small = warc.archived_pages(pages, min_bytes=10).collect()
    assert Counter(r.record_type for r in small) == {"response": len(rows)}


def test_warc_repeated_and_empty(spark):
    """One response a payload, also where rows repeat its page and URL; ids of their own."""
    from kitlend.llm.common import new_folder
    rows = [(1, "u", "x")] * 3 + [(0, "u", "x"), (1, "a", "x"), (1, None, "x"), (1, "u", "y"), (None, None, "z"), (None, None, "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = new_folder(spark, "warc-test")
    got = Counter((r.page_id, r.url, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archived_pages(pages, path=path).collect())
    assert got == {(1, "u", 1, "response", None): 2, (1, "u", 1, "revisit", 1): 2, (0, "u", 1, "revisit", 1): 1,
                   (1, "a", 1, "revisit", 1): 1, (1, None, 1, "revisit", 1): 1, (None, None, 1, "response", None): 1,
                   (None, None, 1, "revisit", None): 1}
    back = warc.read_archives(spark, path).collect()
    assert len({r.record_id for r in back}) == len(back) == len(rows)
    assert warc.archived_pages(pages.limit(0)).collect() == []
    small = warc.archived_pages(pages, min_bytes=2).collect()
    assert Counter(r.record_type for r in small) == {"response": len(rows)}


def test_a_payload_of_a_third_of_all_pages(spark):
    rows = [(i, f"u{i}", "same" if i % 3 == 0 else f"p{i}") for i in range(3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.archived_pages(pages).collect()}
    assert got == {i: ("response", None) if i % 3 or i == 2997 else ("revisit", 2997) for i in range(3000)}


def test_blocks_that_end_in_line_breaks(spark):
    """Payloads whose end runs into the separator, each as a file's last record too."""
    ends = ["x" + "\r\n" * n for n in range(6)] + ["\r\n", "\r\n" * 3, "\r\nx\r\n", "x\n", "x\r", "x\r\n\n", "a\r\n\r\n\r\nb\r\n"]
    from kitlend.llm.common import new_folder
    for parts in (1, len(ends)):
        path = new_folder(spark, "warc-ends")
        pages = spark.createDataFrame([(i, "u", h) for i, h in enumerate(ends)], "page_id long, url string, html string")
        warc.write_archives(pages.coalesce(1) if parts == 1 else pages.repartition(parts, "page_id"), path)
        back = {r.record_key: bytes(r.payload).decode() for r in warc.read_archives(spark, path).collect()}
        assert back == {str(i): h for i, h in enumerate(ends)}


def test_a_block_of_another_length_is_refused():
    head = b"WARC/1.1\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: 3"
    for pieces in ([head, b"abcd"], [head, b"ab"], [head]):
        with pytest.raises(ValueError, match="is not 3 bytes long"):
            list(warc._records(iter(pieces)))


def test_walk_is_the_only_least_cost_walk():
    """The walk's cost equals the least over all sequences of options."""
    for roles in itertools.product(range(4), repeat=4):
        total = sum(c for _, _, c in chat.walk(list(roles), [0] * 4, 0))
        best = [(0, 0)]
        for role in roles:
            best = [(c + o, x) for c, s in best for o, x, _ in chat.OPTIONS[role][s]]
        assert total == min(c for c, _ in best)
