from __future__ import annotations

import random
import re
import time
from html import unescape

import duckdb
import pytest
from pyspark.sql import functions as F

from graphkiln.llm import chat, common, html_text, url_filter

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><div id="cookie-notice">We use cookies</div>
<nav><ul><li><a>Home</a></ul></nav><main><article class="post"><header><h2>Title &amp; more</h2></header><p>Some &nbsp; text <b>bold</b> here
<span class="share">Share!</span> end<br>line<div class=ad>Buy</div><p>Second<script>var x="<p>no</p>"</script> part.<form><input><p>Mail</form>
<ul><li>one<li>two</ul><section id="comments"><h3>Comments</h3><p>Nice!</p></section></article></main><aside>Rel</aside><footer>F</footer>"""


def test_blocks():
    assert html_text.blocks(PAGE) == ["Title & more", "Some text bold here end line", "Second part.", "one", "two"]


def unmarked(html):
    """A page whose menu, article and footer are plain elements."""
    return re.sub(r"<(/?)(article|nav|footer|main)\b[^>]*>", r"<\1div>", html or "").replace(' class="ad"', "")


def test_clusters_decide_without_marks(monkeypatch):
    """The labels are the marked articles of the pages; without marks, the clusters find most of them, and little goes without clusters."""
    pages = [h for (h,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet' ORDER BY page_id").fetchall()]
    labels = [html_text.blocks(h) for h in pages]
    share = lambda: sum(html_text.blocks(unmarked(h)) == x for h, x in zip(pages, labels, strict=True)) / len(pages)
    assert share() > 0.7
    monkeypatch.setattr(html_text, "threshold", lambda values: -1.0)
    assert share() < 0.4


def brute_blocks(html):
    """An article's blocks by regular expressions, for pages as those of the tables."""
    body = re.search(r"(?s)<article>(.*?)(?:</article>|<footer>|$)", re.sub(r"(?s)<!--.*?-->|<(script|style)\b.*?</\1>", "", html or ""))
    parts = re.split(r"<(?:/?(?:p|h[1-6]|div|ul|ol|li|blockquote|section|pre|table|tr|article)\b[^>]*|hr[^>]*)>", body[1] if body else "")
    plain = (" ".join(unescape(re.sub(r"<[^>]*>", "", re.sub(r"<(?:br|td|th)\b[^>]*>", " ", x))).split()) for x in parts)
    return [x for x in plain if x]


def test_against_regular_expressions():
    for (html,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall():
        assert html_text.blocks(html) == brute_blocks(html)


def test_deep_pages_in_linear_time():
    start = time.perf_counter()
    for page in ("<div>" * 50_000 + "x", "<div>" * 50_000 + "</p>" * 50_000 + "x", "<blockquote>" * 20_000 + "<li>a" * 20_000, "<div>" * 20_000 + "<li>b" * 20_000, "<article>" * 20_000 + "<p>text" * 1000):
        assert html_text.blocks(page)
    assert time.perf_counter() - start < 30


def test_whole_names():
    words = [f"paragraph {k} of running text that has as many words in it as the others of the page have" for k in range(6)]
    text = "".join(f"<p>{w}</p>" for w in words)
    for name in ("id=related-work", "class=social-history", "class=comment-on-method", "class='promotion-theory'", "class=x2"):
        assert html_text.blocks(f"<article>{text}<div {name}><p>part of it</p></div></article>") == [*words, "part of it"], name
    for name in ("class=related-posts", "class=socialLinks", "id=post-comments", "class='box ad-slot-1'", "id=cookieBanner", "class=newsletter-signup"):
        assert html_text.blocks(f"<article>{text}<div {name}><p>not part of it</p></div></article>") == words, name


def test_without_article():
    page = "<div class=wrap><div class=top><a>x</a><a>y</a></div><div class=text><p>This is a long paragraph of text that has many words in it.<p>Short.<p>And another long paragraph that has many words in it too.</div><div class=bottom><a>imprint</a> <a>contact</a> <a>jobs</a></div></div>"
    assert html_text.blocks(page) == ["This is a long paragraph of text that has many words in it.", "Short.", "And another long paragraph that has many words in it too."]


@pytest.mark.parametrize("page", [None, "", " \n ", "<p>", "<script>x", "<!-- only -->", "<nav>menu</nav>"])
def test_empty(page):
    assert html_text.blocks(page) == []


def test_odd_pages():
    assert html_text.blocks("plain text") == ["plain text"]
    assert html_text.blocks("<article><p>a</article></div></p><p>b") == ["a"]
    deep = "<div>" * 3000 + "<p>deep text" + "</div>" * 10
    assert html_text.blocks(deep) == ["deep text"]
    long = "<article>" + "".join(f"<p>paragraph {k} of a long page" for k in range(5000)) + "</article>"
    assert len(html_text.blocks(long)) == 5000


def test_extract(spark):
    df = spark.createDataFrame([(1, PAGE, "x"), (1, PAGE, "x"), (2, None, "y")], "page_id long, html string, text string")
    out = html_text.extract(df)
    assert out.columns == ["page_id", "html", "text", "n_chars", "n_blocks"]
    rows = out.orderBy("page_id").collect()
    assert [(r.n_chars, r.n_blocks) for r in rows] == [(len(rows[0].text), 5)] * 2 + [(0, 0)] and rows[2].text == ""
    assert html_text.extract(df.limit(0)).count() == 0


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/")]


def test_rules(spark):
    cases = {
        "http://A.Example.COM/en/x?y": ("a.example.com", "/en/x", "example.com/en/", "block"),
        "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "https://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "x://b.net/es/1#f": ("b.net", "/es/1", "net/es/", "block"),
        "http://com": ("com", "", None, "allow"),
        "http://h.org?a/b://c": ("h.org", "", None, "allow"),
        "no scheme/en/": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    df = spark.createDataFrame([(k, u) for k, u in enumerate(cases)], "page_id long, url string").withColumn("host", F.lit("clash"))
    labels = spark.createDataFrame([], "_page long, good int")
    out = url_filter.judge(df, labels, RULES, page=F.col("page_id")).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in out] == list(cases.values())


def brute_templates(rows, good):
    """(host, shape) -> (template, verdict): the tree of each host, walked one segment at a time."""
    shapes = {}
    for k, url in rows:
        host, path = re.match(r"[^:]*://([^/]*)(/?.*)", url).groups()
        parts = tuple(re.sub("[0-9]+", "{n}", re.sub(r"(?<=/)(?=[a-z]*[0-9])[0-9a-f]{12,}(?=[/.]|$)", "{id}", path)).removeprefix("/").split("/"))
        n, g, seen = shapes.setdefault(host, {}).get(parts, (0, 0, 0))
        shapes[host][parts] = (n + 1, g + good.get(k, 0), seen + (k in good))
    total = lambda found: [sum(x) for x in zip(*found, strict=True)] or [0, 0, 0]

    def names(found):
        """First segment (empty at the end of a path) -> what it adds to the template."""
        by = {}
        for parts, x in found.items():
            by.setdefault(parts[:1], {})[parts[1:]] = x
        n, g, seen = total(found.values())
        variable = len(by) >= url_filter.MANY and n < url_filter.RARE * len(by)
        out = {}
        for head, below in by.items():
            _, bg, bs = total(below.values())
            apart = False
            if 0 < bs < seen:
                share = g / seen
                apart = abs(bg / bs - (g - bg) / (seen - bs)) > url_filter.ALIKE * (share * (1 - share) * (1 / bs + 1 / (seen - bs))) ** 0.5
            out[head] = "" if not head else "/*" if variable or not apart else f"/{head[0]}"
        return out

    def grow(nodes):
        """nodes: whole path -> (what is left, figures) of one template."""
        done = {}
        todo = [("", {parts: (parts, x) for parts, x in nodes.items()})]
        while todo:
            template, members = todo.pop()
            left = {}
            for rest, x in members.values():
                m = left.setdefault(rest, [0, 0, 0])
                for i in range(3):
                    m[i] += x[i]
            named, deeper = names(left), {}
            for whole, (rest, x) in members.items():
                if rest:
                    deeper.setdefault(template + named[rest[:1]], {})[whole] = (rest[1:], x)
                else:
                    done[whole] = template
            todo += deeper.items()
        return done

    _, all_good, all_seen = total(x for found in shapes.values() for x in found.values())
    prior = (all_good + 1) / (all_seen + 1) if all_seen else 1.0
    out = {}
    for host, found in shapes.items():
        _, g, seen = total(found.values())
        host_purity = (g + url_filter.STRENGTH * prior) / (seen + url_filter.STRENGTH)
        named = grow(found)
        for template in set(named.values()):
            _, tg, ts = total(found[p] for p in named if named[p] == template)
            purity = (tg + url_filter.STRENGTH * host_purity) / (ts + url_filter.STRENGTH)
            for p in named:
                if named[p] == template:
                    out[host, p] = (template, "block" if purity < url_filter.LEAST_PURITY else "allow")
    return out


@pytest.mark.parametrize("hot", [20, 10_000])
def test_templates_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT", hot)
    choose = random.Random(hot)
    rows, good = [], {}
    for k in range(3000):
        host = choose.choice(["a.org", "a.org", "b.org", "c.net"])
        parts = [choose.choice(["news", "blog", "spam", "x"]) for _ in range(choose.randrange(0, 4))] + ["deep"] * choose.choice([0, 0, 9]) + [choose.choice([str(k), f"slug-{choose.choice('abcdefgh')}", "", "0123456789abcdef"])]
        rows.append((k, f"http://{host}/{'/'.join(parts)}"))
        if choose.random() < 0.7:
            good[k] = int(choose.random() < (0.1 if "spam" in parts else 0.3 if host == "c.net" else 0.9))
    rows += [(5000 + k, f"http://slugs.org/{k * 7919 % 100_003:x}z{'abc'[k % 3]}q/page") for k in range(120)] + [(6000, "http://a.org/" + "deep/" * 3000), (6001, "http://d.org/" + "/".join("abc"[k % 3] for k in range(2000)))]
    df = spark.createDataFrame(rows, "page_id long, url string").repartition(5)
    out = url_filter.judge(df, spark.createDataFrame(list(good.items()), "_page long, good int"), [], page=F.col("page_id")).collect()
    want = brute_templates(rows, good)
    assert len(out) == len(rows) and {r.verdict for r in out} == {"allow", "block"}
    for r in out:
        parts = tuple(re.sub("[0-9]+", "{n}", re.sub(r"(?<=/)(?=[a-z]*[0-9])[0-9a-f]{12,}(?=[/.]|$)", "{id}", r.path)).removeprefix("/").split("/"))
        assert (r.template, r.verdict) == want[r.host, parts], r
    assert url_filter.judge(df.limit(0), spark.createDataFrame([], "_page long, good int"), RULES, page=F.col("page_id")).count() == 0


def test_templates(spark):
    rows = [(k, f"http://mixed.org/{'bad' if k % 2 else 'good'}/{k}") for k in range(400)]
    rows += [(1000 + k, f"http://spam.org/{['x', 'y'][k % 2]}/{k}.html") for k in range(100)] + [(2000 + k, f"http://fine.org/slug-{k * 7919 % 1000}-a") for k in range(100)]
    rows += [(3000, "http://new.org/a/b"), (3000, "http://new.org/a/b")]
    df = spark.createDataFrame(rows, "page_id long, url string").repartition(6)
    marks = [(k, int(k % 2 == 0)) for k in range(0, 400, 2)] + [(k, 0) for k in range(1, 400, 2)] + [(1000 + k, 0) for k in range(0, 100, 2)] + [(2000 + k, 1) for k in range(50)] + [(None, 1), (0, 1)]
    out = url_filter.judge(df, spark.createDataFrame(marks, "_page long, good int"), [], page=F.col("page_id")).collect()
    assert len(out) == len(rows)
    for r in out:
        bad = r.host == "spam.org" or r.path.startswith("/bad/")
        assert r.verdict == ("block" if bad else "allow"), r
    assert {r.template for r in out if r.host == "mixed.org"} == {"/good/*", "/bad/*"}
    assert len({r.template for r in out if r.host in ("spam.org", "fine.org")}) == 2


def brute_chat(rows):
    """turn -> (parent, quoted) and the turns in reply order, of one conversation's (turn, text); one pass, one stack."""
    normal = lambda x: re.sub(r"[\W_]+", " ", x.lower()).strip()
    stop = re.compile(r"[.!?…]+[\"'”’»)\]]*\s+|[。！？]+\s*")

    def pieces(text):
        blocks = [*re.split(r"\n\s*\n", text), *text.split("\n")]
        return {normal(x) for x in [text, *blocks, *(s for x in blocks for s in stop.split(x))]} - {""}

    said, parents, last = {}, {}, None
    for turn, text in sorted(rows):
        runs, own, lines = [], [], []
        for line in (text or "").split("\n"):
            marks = re.match(r"(?:[ \t]*>)*", line)[0]
            lines.append((marks.count(">"), re.sub(r"^(?:[ \t]*>)+ ?", "", line)))
        for k, (level, line) in enumerate(lines):
            if not level:
                if not (re.search(r"(?i)^\s*on\b.*\bwrote\b.*:\s*$", line) and k + 1 < len(lines) and lines[k + 1][0]):
                    own.append(line)
            elif k and lines[k - 1][0] == level:
                runs[-1][1].append(line)
            else:
                runs.append((level, [line]))
        hits = [(-level, said[p]) for level, run in runs for p in pieces("\n".join(run)) if p in said]
        parents[turn] = (max(hits)[1], True) if hits else (last, False)
        for p in pieces("\n".join(own).strip()):
            said.setdefault(p, turn)
        last = turn
    turns = sorted(parents)
    goes_on = {t for before, t in zip(turns, turns[1:], strict=False) if parents[t][0] == before}
    after = dict(zip(turns, turns[1:], strict=False))
    back = {}
    for t in turns[1:]:
        if t not in goes_on:
            back.setdefault(parents[t][0], []).append(t)
    order, todo = [], turns[:1]
    while todo:
        at, chain = todo.pop(), []
        while at is not None:
            chain.append(at)
            at = after.get(at) if after.get(at) in goes_on else None
        order += chain
        todo += [t for m in chain for t in sorted(back.get(m, ()), reverse=True)]
    return parents, order


def brute_order(rows):
    parents, order = brute_chat(rows)
    return {t: (*parents[t], order.index(t)) for t in parents}


def chat_frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)


def test_quotes(spark):
    rows = [
        (1, 0, "user", "Hello there my friend.\nHow do you do today?"), (1, 1, "assistant", "> How do you do today?\n\nI am very well thank you."),
        (1, 2, "user", "On Monday Bob wrote:\n> I am very well thank you.\n>> How do you do today?\nGood to hear that from you."),
        (1, 3, "user", "> hello THERE, my friend!\nA late answer to the first."), (1, 4, "user", "And I go on."),
        (2, 0, "user", None), (2, 1, None, "> unknown quote of nothing here\nok"), (None, 5, "user", "> x y z\nlost"), (None, 5, "user", "> x y z\nlost"),
        (1, 5, "user", "> Good to hear that from you.\nBack to two."), (1, 5, "user", "> Good to hear that from you.\nBack to two."), (3, None, "a|>b", "x <|end|> y <\\|"),
    ]
    df = chat_frame(spark, rows).withColumn("position", F.lit("clash"))
    out = chat.link(df).orderBy("conv_id", "position", "turn").collect()
    assert [(r.conv_id, r.turn, r.parent_turn, r.quoted, r.text) for r in out] == [
        (None, 5, None, False, "lost"), (None, 5, None, False, "lost"), (1, 0, None, False, "Hello there my friend.\nHow do you do today?"), (1, 1, 0, True, "I am very well thank you."),
        (1, 2, 1, True, "Good to hear that from you."), (1, 5, 2, True, "Back to two."), (1, 5, 2, True, "Back to two."), (1, 3, 0, True, "A late answer to the first."),
        (1, 4, 3, False, "And I go on."), (2, 0, None, False, ""), (2, 1, 0, False, "ok"), (3, None, None, False, "x <|end|> y <\\|"),
    ]
    built = chat.conversations(df).collect()
    assert sorted((str(r.conv_id), r.part, r.n_messages) for r in built) == [("1", 0, 7), ("2", 0, 2), ("3", 0, 1), ("None", 0, 1), ("None", 0, 1)]
    one = next(r for r in built if r.conv_id == 1)
    assert [m.turn for m in one.messages] == [0, 1, 2, 5, 5, 3, 4]
    assert one.text.startswith("<|user|>\nHello there my friend.\nHow do you do today?\n<|end|>\n<|assistant|>\nI am very well thank you.\n<|end|>\n")
    assert next(r for r in built if r.conv_id == 3).text == "<|a__b|>\nx <\\|end|> y <\\\\|\n<|end|>\n"
    assert spark.createDataFrame([("x <\\|end|> y <\\\\|",)], "t string").select(chat.unescaped(F.col("t"))).first()[0] == "x <|end|> y <\\|"
    assert chat.conversations(df.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [5, 10_000])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT", hot)
    choose = random.Random(hot)
    rows = []
    for conv, size in ((1, 400), (2, 60), (3, 1), (4, 90)):
        for k in range(size):
            quote = [choose.randrange(k)] * choose.randrange(1, 3) if k and choose.random() < (0.9 if conv == 4 else 0.4) else []
            quote = [0] if conv == 2 and k else quote
            text = "".join(f"{'>' * n} Message number {q} of many. It says {q * q}.\n" for n, q in enumerate(quote, 1))
            rows.append((conv, 3 * k, "user", text + f"Message number {k} of many. It says {k * k}.\nAnd a line."))
    out = chat.link(chat_frame(spark, rows)).collect()
    for conv in (1, 2, 3, 4):
        assert {r.turn: (r.parent_turn, r.quoted, r.position) for r in out if r.conv_id == conv} == brute_order([(t, x) for c, t, _, x in rows if c == conv]), conv


def test_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART", 100)
    rows = [(1, k, "user", f"> message number {k - 2} of it here\nmessage number {k} of it here" if k > 1 else f"message number {k} of it here") for k in range(700)]
    rows += [(1, 650, "user", "> " * 3 + "x\n" * 2)] * 5
    df = chat_frame(spark, rows)
    out = {r.turn: r for r in chat.link(df).filter("text <> 'x'").collect()}
    assert all(r.parent_turn == (t - 2 if t > 1 else t - 1 if t else None) for t, r in out.items())
    parts = sorted((r.part, r.n_messages, [m.turn for m in r.messages]) for r in chat.conversations(df).collect())
    assert [n for _, n, _ in parts] == [100] * 7 + [5]
    seen = set()
    for t in (t for _, _, turns in parts for t in turns):
        assert out[t].parent_turn is None or out[t].parent_turn in seen
        seen.add(t)
    assert len(seen) == 700


def test_very_long_message(spark):
    text = "".join(f"> quoted line {k}\n" if k % 3 else f"own line {k}\n" for k in range(40_000))
    rows = chat.link(chat_frame(spark, [(1, 0, "u", text), (1, 1, "u", "> own line 39999\nyes"), (1, 2, "u", "a" * 1_000_000)])).collect()
    assert {r.turn: (r.parent_turn, r.quoted) for r in rows} == {0: (None, False), 1: (0, True), 2: (1, False)}


def test_link_lists():
    words = "many words of running text that make up a paragraph of some length here"
    page = f"<body><p>{words}</p><p>{words}</p><div><a>one</a> <a>two</a> <a>three</a></div><div><a>four</a> <a>five</a></div><p>Short end.</p><p>{words} <a>link</a></p></body>"
    assert html_text.blocks(page) == [words, words, "Short end.", f"{words} link"]
    assert html_text.blocks(page.replace("body>", "article>")) == [words, words, "Short end.", f"{words} link"]


def test_articles_of_a_part_of_the_page():
    words = [f"paragraph {k} of running text that has as many words in it as the others of the page have" for k in range(12)]
    text = lambda a, b: "".join(f"<p>{w}</p>" for w in words[a:b])
    assert html_text.blocks(f"<body><div class=text>{text(0, 11)}</div><article>{text(11, 12)}</article></body>")[:11] == words[:11]
    assert html_text.blocks(f"<body><article>{text(0, 8)}</article><article>{text(8, 12)}</article></body>") == words
    assert html_text.blocks(f"<body><div>{text(0, 1)}</div><article>{text(1, 12)}</article></body>") == words[1:]


def test_names_do_not_hide_the_text():
    words = [f"paragraph {k} of running text that has as many words in it as the others of the page have" for k in range(6)]
    text = lambda a, b: "".join(f"<p>{w}</p>" for w in words[a:b])
    for around in ("div class='content with-sidebar'", "article class='post comments-open'", "section id='discussion'", "div class='page-sidebar-left'"):
        tag = around.split()[0]
        assert html_text.blocks(f"<body><nav>menu</nav><{around}>{text(0, 6)}<div id=comments><p>Nice!</p></div></{tag}></body>") == words, around
    two = "".join(f"<article class='post comments-open'>{text(k, k + 2)}</article>" for k in (0, 2, 4))
    assert html_text.blocks(f"<body>{two}</body>") == words
    assert html_text.blocks(f"<body><article>{text(0, 2)}</article><div id=comments>{text(2, 6)}</div></body>") == words[:2]
    assert html_text.blocks(f"<body><div>{text(0, 5)}</div><div class=sidebar>{text(5, 6)}</div></body>") == words[:5]


def test_quotes_of_any_size(spark):
    rows = [
        (1, 0, "Sounds good."), (1, 1, "First of all this. The second sentence is here. And a third one."), (1, 2, "A paragraph that is\nset in two lines. It ends.\n\nAnother."), (1, 3, "Filler."),
        (1, 4, "> Sounds good.\nto zero"), (1, 5, "> The second sentence\n> is here.\nto one"), (1, 6, "> A paragraph\n> that is set in\n> two lines. It ends.\nto two"),
        (1, 7, "> The second sentence is here. And a third one.\nto one"), (1, 8, "> ...\nno words"), (1, 9, "> ok\nnever said"),
    ]
    out = {r.turn: r for r in chat.link(spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")).collect()}
    assert [(out[t].parent_turn, out[t].quoted) for t in range(4, 10)] == [(0, True), (1, True), (2, True), (1, True), (7, False), (8, False)]
    assert [out[t].n_quotes for t in (4, 5, 8)] == [1, 3, 1]
