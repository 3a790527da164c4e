import hashlib
import html
import json
import re
import time
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import chat, html_text, queries

TREE = html_text.train(*html_text.labelled_table())
A = "The first paragraph has more than just a few words in it, so it is plainly text."
B = "Another paragraph follows it, and this one is long enough to be told from a menu."


def text(page):
    return html_text.main_text(page, TREE)


def test_tree_learns_its_table():
    rows, labels = html_text.labelled_table()
    assert (TREE.keep(rows) == labels).mean() > 0.95


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("<html><head><title>x</title></head><body></body></html>", ""),
        (f"<nav><ul><li><a href=/>Home</a><li><a href=/b>News</a></ul></nav><article><h1>Title</h1><p>{A}<p>Of.</p></article><footer>&copy; me</footer>", f"Title\n{A}\nOf."),
        (f"<header><a href=/>Logo</a> Tagline</header><main><p>{A}</p><aside>Elsewhere: a very long remark that is not part of this at all, really.</aside><p>{B}</p></main>", f"{A}\n{B}"),
        (f"<div class='cookie-notice'>We use cookies. {A}</div><article><p>{A}</p></article><section id=comments><p>{B}</p></section>", A),
        (f"<article><p>{A}<script>var t='</p>';</script><style>p{{}}</style></p><form><p>Search</p><input></form><div class=ad>{B}</div></article>", A),
        (f"<body><p>{A}</p><p>{B}</p><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></body>", f"{A}\n{B}"),
        (f"<article><p>a &amp; b &lt;c&gt;&nbsp;&#233;\n\t d <b>e</b>f<br>g</p><!-- <p>no</p> --><p>{A}", f"a & b <c> é d ef g\n{A}"),
        (f"<article><p>{A}</p></article><div role=contentinfo><p>{B}</p></div><script>unclosed <p>{B}", A),
        ("<article><p>cut off <b", "cut off"),
        (f"<article><header><h1>Head</h1></header><p>{A}</p></article></div></nav>", f"Head\n{A}"),
    ],
)
def test_main_text(page, want):
    assert text(page) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<head><title>t</title><body><article><p>{A}</p><p>{B}</p></article>", f"{A}\n{B}"),
        (f"<html><head><meta charset=utf-8><title>t</title><style>p{{}}</style><p>{A}</p><p>{B}</p>", f"{A}\n{B}"),
        (f"<head><title>t</title><noscript><p>no</p></noscript>{A}<p>{B}", f"{A}\n{B}"),
        (f"<head><title>t</title><noscript><img src=x></noscript><script>'</head>'</script></head><body><p>{A}</p></body>", A),
        (f"<nav><svg class=i/></nav><article><p>{A}</p></article><p>{B}</p>", f"{A}\n{B}"),
        (f"<nav><svg class=i/></nav><article><p>{A}</p></article><div><svg><text>no</text></svg></div>", A),
        (f"<article><p>{A} <svg><g><svg><text>no</text></svg></g><text>no</text></svg></p><p>{B}</p></article>", f"{A}\n{B}"),
        *[(f"<nav><{tag} class=x></nav><article><p>{A}</p><p>{B}</p></article>", f"{A}\n{B}") for tag in html_text.UNSEEN],
        *[(f"<nav><{tag} class=x></nav><article><p>{A}</p><{tag}>no</{tag}><p>{B}</p></article>", f"{A}\n{B}") for tag in html_text.UNSEEN],
        *[(f"<article><p>{A}</p><{tag} title='a>b'>no <!-- </{tag}><p>{B}</p></article>", f"{A}\n{B}") for tag in html_text.UNSEEN],
        *[(f"<article><{tag}></{tag}><p>{A}</p><{tag} a=b><p>{B}</p></article>", f"{A}\n{B}") for tag in ("svg-icon", "video-js", "button-group", "style-guide", "head-line")],
        (f'<article><p>{A}</p><iframe src="x>no</iframe><p>{B}</p></article>', f"{A}\n{B}"),
        (f"<article><p>{A}</p><script src=x /><p>{B}</p></article>", f"{A}\n{B}"),
        (f"<article><p>{A}</p><style>p {{}} <p>{B}</p></article>", A),
    ],
)
def test_unseen_elements_end_where_they_end(page, want):
    assert text(page) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        *[(f"<nav><a href=/>Home</a></nav><div class='{c}'><article><h1>Title</h1><p>{A}</p></article></div>", f"Title\n{A}") for c in ("layout with-sidebar", "content no-sidebar", "has-ads", "has-left-sidebar", "entry-with-comments", "layout sidebar-right", "page widgets", "social")],
        *[(f"<div class='{c}'><p>{A}</p><p>{B}</p></div>", f"{A}\n{B}") for c in ("content no-sidebar", "entry-with-comments", "content sidebar-right", "story ads")],
        (f"<div class='ads'><div class='widgets'><article><p>{A}</p><div class=comments><article><p>{B}</p></article></div></article></div></div>", A),
        *[(f"<article><h1>Title</h1><p>{A}</p><section {c}><h2>Part</h2><p>{B}</p></section></article>", f"Title\n{A}\nPart\n{B}") for c in ("id=discussion", "class='related-work'")],
        # What is beside the article stays boilerplate, whatever its words.
        (f"<article><p>{A}</p></article><section id=comments><article class=comment><p>{B}</p><p>{B}</p></article></section>", A),
        (f"<div class=content><p>{A}</p></div><div class=related><article><p>{B}</p><p>{B}</p></article></div>", A),
        (f"<article><p>{A}</p></article><div class=comment-content><p>{B}</p><p>{B}</p></div>", A),
        (f"<article><p>{A}</p></article><section id=discussion><p>{B}</p></section>", A),
        (f"<article><p>{A}</p></article><div hidden class='layout sidebar'><article><p>{B}</p></article></div>", A),
        (f"<div hidden><article><p>{B}</p></article></div>", ""),
    ],
)
def test_layout_around_an_article_is_no_boilerplate(page, want):
    assert text(page) == want


def test_long_and_broken_pages_take_linear_time():
    began = time.time()
    assert text("<article>" + f"<p>{A}</p>" * 20_000).count("\n") == 19_999
    text("<" * 50_000)
    text("<div>" * 50_000 + A)
    assert time.time() - began < 20


@pytest.mark.parametrize(
    ("page", "want"),
    [
        *[(f"<article><p>{A}</p><section class='{c}'><h2>Part</h2><p>{B}</p></section></article>", f"{A}\nPart\n{B}") for c in ("related work", "recommended-reading", "tags", "social")],
        *[(f"<div class='{c}'><p>{A}</p><p>{B}</p></div>", f"{A}\n{B}") for c in ("social-policy", "related work", "post tags-none")],
        (f"<article><p>{A}</p><blockquote class='reply'><p>{B}</p></blockquote></article>", f"{A}\n{B}"),
        (f"<article><p>{A} where <math><mi>x</mi></math> holds.</p></article>", f"{A} where x holds."),
        (f'<article><p title="a>{A}</p><p>{B}</p></article>', f"{A}\n{B}"),
        # A few words, or links, of a topic are not part of the article.
        (f"<article><p>{A}</p><div class=share>Share this article</div><div class=tags>Tags: <a href=1>One</a> <a href=2>Two</a></div><div class=related><ul><li><a href=3>The first paragraph has more than a few words</a></li><li><a href=4>It is still a list of links and nothing else</a></li></ul></div></article>", A),
        (f"<article><p>{A}</p></article><div class=related><p>{B}</p></div>", A),
        (f"<article><p>{A}</p><div class=replies><div class=reply><p>{B}</p></div></div></article>", A),
        # A link around blocks.
        *[(f"<{tag}><p>{A}</p></{tag}><a href=/n><div>Read the next article: {B}</div></a>", A) for tag in ("article", "main")],
        (f"<p>{A}</p><p>{B}</p><a><div>Read the next article: {B}</div></a>", f"{A}\n{B}"),
        (f"<article><a name=top><p>{A}</p><p>{B}</p></article>", f"{A}\n{B}"),
        (f"<article><a href=/x><p>{A}</p><p>{B}</p></article>", f"{A}\n{B}"),
    ],
)
def test_topics_quotes_and_links(page, want):
    assert text(page) == want


P = "The first paragraph has more than just a few words in it, so it is plainly text, and it has about twenty-five of them in all."
Q = "Another paragraph follows it, and this one is long enough to be told from a menu by anybody who reads it to its very end."
STORY, TOLD = f"<h1>Title</h1><p>{P}</p><p>{Q}</p>", f"Title\n{P}\n{Q}"
MENU = "<nav><ul><li><a href=/>Home</a><li><a href=/b>News</a></ul></nav>"
FOOT = "<footer>&copy; me, all rights reserved, and a long line of legal text that has very many words indeed.</footer>"
PAGE_FORMS = [
    (f'<body data-sidebar="hidden">{STORY}',TOLD),(f'<div data-hidden="false">{STORY}</div>',TOLD),(f'<div title="the hidden valley">{STORY}</div>',TOLD),
    (f'<article data-state="not hidden">{STORY}</article>',TOLD),(f'<div data-id="menu">{STORY}</div>',TOLD),(f"<div title='class=ad hidden'>{STORY}</div>",TOLD),
    (f'{MENU}<form id="aspnetForm" action=x>{STORY}</form>',TOLD),(f'<form id="aspnetForm">{MENU}<article>{STORY}</article>{FOOT}</form>',TOLD),
    (f'<form id="aspnetForm">{MENU}<div>{STORY}</div><div id=comments><p>{P}</p><p>{P}</p></div>{FOOT}</form>',TOLD),
    (f'{MENU}<section class="cookies">{STORY}</section>{FOOT}',TOLD),(f'<div class="login-guide">{STORY}</div>',TOLD),(f"{MENU}<section class='banner-history'>{STORY}</section>",TOLD),
    ("<p>Closed today.</p>","Closed today."),(f"{MENU}<p>Closed today.</p>{FOOT}","Closed today."),("<body>Gone fishing</body>","Gone fishing"),
    (f"<div><a href=/>Home</a> <a href=/b>News</a></div><div>{STORY}</div><div>Copyright 2024 Acme. All rights reserved.</div>",TOLD),
    (f"<div><a href=/>Home</a></div><div><h1>A title</h1><div>{P}</div><div>{Q}</div></div><div>© 2024 Acme</div>",f"A title\n{P}\n{Q}"),
    (f"<article><p>{P}</p><p style='visibility:hidden'>{Q}</p><p style='color:red; visibility: hidden'>{Q}</p></article>",P),
    (f"<article><p>{P}</p></article><div id=reader-opinions><p>{Q}</p><p>{Q}</p></div>",P),
    (f"<div class=content><p>{P}</p></div><div id=readerComments><p>{Q}</p><p>{Q}</p></div>",P),
    (f"<div><p>{P}</p></div><div id=x><h3>3 Comments</h3><p>{Q}</p><p>{Q}</p><p>{Q}</p><p>{Q}</p></div>",P),
    (f"<article><p>{P}</p><section><h2>Leserkommentare (2)</h2><p>{Q}</p></section><p>{Q}</p></article>",f"{P}\n{Q}"),
    (f"<div class=usercomments><p>{Q}</p></div><p>{P}</p>",P),
    (f"<article class=commentary><h1>On law</h1><p>{P}</p></article>",f"On law\n{P}"),
    (f"<article><p>Closed today.</p></article><section id=comments><p>{P}</p><p>{Q}</p></section>","Closed today."),
    (f"{MENU}<div class=cookie-notice>We use cookies. Please accept.</div>{FOOT}",""),
    (f"{MENU}<div class=cookie-notice>We use cookies to make this page better for you, please accept them now or later.</div>{FOOT}",""),
    (f"<div><p>{P}</p><p>{Q}</p></div><section class=comments>"+f"<p>{P}</p>"*30+"</section>",f"{P}\n{Q}"),
    (f"<div id=menu-page><p>{P}</p><p>{Q}</p><p>{P}</p></div>",f"{P}\n{Q}\n{P}"),
    (f"<nav>{MENU}<main><h1>T</h1><p>{P}</p></main>",f"T\n{P}"),
    (f"<nav><a href=/>Home</a><a href=/b>News</a><div><h1>Title</h1><p>{P}</p><p>{Q}</p></div>",TOLD),
    (f"<aside><p>{P}</p></aside><div><p>{Q}</p></div>",Q),
    (f"<div><h2>Popular</h2><ul><li><a href=1>One thing</a><li><a href=2>Two things</a></ul></div><div><h1>Real title</h1><p>{P}</p></div>",f"Real title\n{P}"),
    (f"<article>{STORY}<p>Copyright law is old.</p></article>",TOLD + "\nCopyright law is old."),
    (f"<div hidden><article>{STORY}</article></div><p>{P}</p>",P),
    (f"<dialog><p>{Q}</p></dialog><div>{STORY}</div>",TOLD),
    (f'<div aria-hidden=true><p>{Q}</p></div><div aria-hidden="false">{STORY}</div>',TOLD),
    (f"<div class='sidebar'><p>{Q}</p></div><div class='main-col'>{STORY}</div><div class='newsletter'><p>{Q}</p></div>",TOLD),
]

@pytest.mark.parametrize(("page", "want"), PAGE_FORMS)
def test_no_mark_is_final(page, want):
    assert text(page) == want


TEMPLATES = [
    lambda title, ps: f"<body data-nav='hidden'><form id=aspnetForm><div class=top><a href=/>Home</a> <a href=/n>News</a></div><div class=col><h1>{title}</h1>{ps}</div><div id=reader-opinions><p>{P}</p><p>{Q}</p></div></form><div>Copyright 2024 Acme. All rights reserved.</div></body>",
    lambda title, ps: f"<div class='layout with-sidebar'><div class='sidebar'><h3>More</h3><p>{P}</p></div><div class='story'><h1>{title}</h1>{ps}<div class=share>Share this</div></div></div><footer><p>{Q}</p></footer>",
    lambda title, ps: f"<header><a href=/>Logo</a></header><main><h1>{title}</h1>{ps}<aside><p>{Q}</p></aside></main><section><h2>4 comments</h2><p>{P}</p><p>{Q}</p><p>{P}</p></section>",
]


def test_pages_query_on_other_templates(spark, sf, tmp_path):
    docs = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").filter("length(text) > 300 AND length(text) < 4000").limit(40).collect()]
    rows, want = [], {}
    for i, doc in enumerate(docs):
        lines = [" ".join(x.split()) for x in doc.split("\n") if len(x.split()) >= 10]
        if lines:
            title = f"Story number {i}"
            rows.append((i, f"u{i}", TEMPLATES[i % 3](title, "".join(f"<p>{html.escape(x)}</p>" for x in lines))))
            want[i] = "\n".join([title, *lines])
    assert len(rows) > 20
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert {r.page_id: r.text for r in queries.op2_html_text(spark, str(tmp_path)).collect()} == want


class Article(HTMLParser):
    """The blocks of a page's article by a parser of the standard library, for pages whose article has no boilerplate."""

    BREAKS = ("p", "h1", "h2", "h3", "ul", "ol", "li", "div", "article", "blockquote", "pre")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.hidden, self.found, self.piece = False, 0, [], ""

    def cut(self):
        if self.piece.split():
            self.found.append(" ".join(self.piece.split()))
        self.piece = ""

    def handle_starttag(self, tag, attrs):
        if tag in self.BREAKS:
            self.cut()
        self.inside |= tag == "article"
        self.piece += " " if tag == "br" else ""
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        if tag in self.BREAKS:
            self.cut()
        self.inside &= tag != "article"
        self.hidden -= tag in ("script", "style")

    def handle_data(self, data):
        if self.inside and not self.hidden:
            self.piece += data


def test_pages_query(spark, sf):
    rows = queries.op2_html_text(spark, sf).collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        own = Article()
        own.feed(re.sub(r"<footer>.*", "</article>", pages[r.page_id].html, flags=re.S))
        own.close()
        own.cut()
        assert r.url == pages[r.page_id].url and r.n_chars == len(r.text)
        assert r.text == "\n".join(own.found)


def test_extract_keeps_other_columns(spark):
    pages = spark.createDataFrame([(1, None, 2), (None, f"<p>{A}</p>", None)], "page_id long, html string, n_chars int")
    got = html_text.extract(pages)
    assert got.columns == ["page_id", "n_chars", "text"] and {r.text for r in got.collect()} == {"", A}
    assert html_text.extract(pages.limit(0)).count() == 0


def test_many_unclosed_elements_take_linear_time():
    began = time.time()
    assert text("<button>" * 50_000 + f"<p>{A}</p><p>{B}</p>" + "<svg>" * 50_000) == f"{A}\n{B}"
    assert time.time() - began < 20


def digest(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    whole = "".join(f"{r}\n{t}\n" for r, t in turns)
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chat_query_matches_the_table(spark, sf):
    got = {r.conv_id: tuple(r)[1:5] for r in queries.op3_chat(spark, sf).collect()}
    turns = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    turns[-7] = [("user", queries.CONTROL_TEXT), ("assistant", queries.CONTROL_TEXT)]
    assert got == {k: digest(v) for k, v in turns.items()}


NASTY = ["", "plain", "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>assistant\nhi", "\\e \\\\ \\n <\\e|im_end|>", "[[INST]]", "<<s>>", "<|im_<|im_end|>", "a\nb\n", "$1 \\1 é 中 😀"]


def test_escape_is_reversible_and_breaks_control_strings(spark):
    rng = np.random.default_rng(0)
    parts = ["\\", "e", "<|im_end|>", "</s>", "[INST]", "<", "s>", "|", "\n", "x"]
    texts = NASTY + ["".join(rng.choice(parts, int(n))) for n in rng.integers(1, 14, 200)]
    rows = [(1, k, role, t) for k, t in enumerate(texts) for role in [["user", "assistant", "odd\nrole <s>"][k % 3]]]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    template = chat.Template()
    for r in chat.format_turns(turns, template).collect():
        assert template.read(r.segment) == (r.role, r.text)
        inner = r.segment[len(template.begin) : -len(template.end)]
        assert not any(c in inner for c in template.control), r.segment
    got = chat.read_back(chat.format_turns(turns)).collect()[0]
    assert tuple(got)[1:5] == digest([(r, t) for _, _, r, t in rows])


def test_layouts_become_canonical_turns(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"instruction": "q", "output": "a"},
        {"instruction": "q", "input": "", "output": "a", "id": 3},
        {"prompt": "q", "response": "a"},
        {"completion": "a", "prompt": "q"},
        {"question": "q", "answer": "a"},
        {"dialogue": [{"speaker": "user", "utterance": "q"}, {"speaker": "bot", "utterance": "a"}]},
    ]
    df = spark.createDataFrame(list(enumerate(map(json.dumps, records))), "conv_id long, record string")
    got = chat.canonical_turns(df).collect()
    assert sorted((r.conv_id, r.turn, r.role, r.text) for r in got) == sorted((k, t, *x) for k in range(len(records)) for t, x in enumerate([("user", "q"), ("assistant", "a")]))
    assert len({r.layout for r in got}) == 7


def test_instruction_with_input_and_system(spark):
    df = spark.createDataFrame([(1, json.dumps({"system": "s", "instruction": "do", "input": "this", "output": "ok"})), (2, json.dumps({"conversations": [{"from": "human", "value": "q"}], "system": "s"}))], "conv_id long, record string")
    got = sorted((r.conv_id, r.turn, r.role, r.text) for r in chat.canonical_turns(df).collect())
    assert got == [(1, 0, "system", "s"), (1, 1, "user", "do\n\nthis"), (1, 2, "assistant", "ok"), (2, 0, "system", "s"), (2, 1, "user", "q")]


def test_chat_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, "{"), (3, "[1]"), (4, '{"messages": []}'), (None, '{"turn": null, "role": null, "text": null}'), (5, '{"other": 1}')], "conv_id long, record string")
    got = chat.canonical_turns(df).collect()
    assert sorted(r.conv_id for r in got if r.layout is None) == [1, 2, 3, 5] and 4 not in {r.conv_id for r in got}
    assert chat.read_back(chat.format_turns(chat.canonical_turns(df))).count() == 5
    assert chat.read_back(chat.format_turns(chat.canonical_turns(df.limit(0)))).count() == 0
    clash = df.withColumn("segment", F.lit(1)).withColumn("id", F.lit(2))
    assert chat.canonical_turns(clash).count() == len(got)


@pytest.mark.parametrize(
    ("record", "layout"),
    [
        ({"messages": [{"role": "user", "content": "q", "name": "bob"}, {"role": "assistant", "content": "a"}]}, "messages"),
        ({"messages": [{"role": "user", "content": [{"type": "text", "text": "q"}]}, {"role": "assistant", "content": ["a"]}], "metadata": {"x": {"y": [1]}}}, "messages"),
        ({"messages": [{"role": "user", "content": "q", "metadata": {"a": 1}}, {"role": "assistant", "content": "a", "timestamp": 3}], "model": "m", "id": 4}, "messages"),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a", "weight": 1}], "source": "web", "tags": []}, "conversations"),
        ({"prompt": "q", "completion": "a", "meta": {"k": None}}, "completion"),
        ({"instruction": "q", "input": "", "output": "a", "category": "open", "score": 1.5}, "instruction"),
        # What is neither known nor a side field may be part of a turn, so the record is kept as it is.
        ({"messages": [{"role": "user", "content": [{"type": "image", "url": "u"}, {"type": "text", "text": "q"}]}]}, None),
        ({"messages": [{"role": "assistant", "content": None, "tool_calls": [{"id": 1}]}]}, None),
    ],
)
def test_families_of_layouts(record, layout):
    found = chat.turns_of(json.dumps(record), chat.registry())
    assert found is None if layout is None else [t[1:] for t in found] == [("user", "q", layout), ("assistant", "a", layout)]


@pytest.mark.parametrize(
    "record",
    [
        '{"messages": ["abc"]}',
        '{"conversations": [5]}',
        '{"messages": [{"role": "user", "content": "q"}, "abc"]}',
        '{"messages": ' + "[" * 100_000 + "]" * 100_000 + "}",
        '{"turn": "x", "role": "user", "text": "q"}',
        '{"turn": 99999999999999999999, "role": "user", "text": "q"}',
        '{"turn": true, "role": "user", "text": "q"}',
        '{"prompt": "\\ud800", "response": "a"}',
        '{"messages[].role": 1, "messages[].content": 2}',
        '{"": {"turn": 1, "role": "user", "text": "q"}}',
        '{"messages": {}}',
        "null",
    ],
)
def test_malformed_records_have_no_layout(record):
    assert chat.turns_of(record, chat.registry()) is None


def test_malformed_and_clashing_rows(spark):
    long = "word " * 200_000
    df = spark.createDataFrame([(1, '{"messages": ["abc"]}'), (2, json.dumps({"turn": 0, "role": "bot", "text": long})), (2, json.dumps({"turn": 0, "role": "bot", "text": long}))], "conv_id long, record string")
    turns = chat.canonical_turns(df).withColumn("segment", F.lit("own")).withColumn("learned", F.lit(1))
    formatted = chat.format_turns(turns)
    assert formatted.columns == [*turns.columns, "_segment", "_learned"] and formatted.filter("segment = 'own' AND learned = 1").count() == 3
    got = {r.conv_id: tuple(r)[1:5] for r in chat.read_back(formatted, segment_column="_segment").collect()}
    # Roles of rows that are turns already stay as they are.
    assert got == {1: digest([("", '{"messages": ["abc"]}')]), 2: digest([("bot", long)] * 2)}
