import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from driftwell.llm import pages as P

PAGE = """<!DOCTYPE html><html><head><title>T | Club</title><style>p{}</style></head><body>
<nav><ul><li>Home<li>About</ul></nav>
<div id=content><div>We use cookies. Accept all</div><h1>A <b>big</b> day</h1><div class="meta">11/09/2024 | A. Name</div>
<p>First&nbsp;&eacute;<!-- c -->tape<br>goes on
<p>Second <a href=/x>one</a>.<p style="display:none">unseen</p>
<div>Share: Facebook | WhatsApp | Copy link</div><ul><li>one<li>two <i>more</i></ul>
<table><tr><td>May<td>12<tr><td>June</td><td>3</table><h2>Later</h2><p>Advertisement</p><h4>Read also: Other things</h4><script>var a="<p>no</p>"</script>
<p>Last.</div><aside><h3>Recent posts</h3><ul><li>Other</ul></aside><footer><p>© 2024 Club</footer></body></html>"""
ARTICLE = ["A big day", "First étape goes on", "Second one.", "one", "two more", "May", "12", "June", "3", "Later", "Last."]
TEXT = "Home\nAbout\nA big day [ref. 1]\n1/2/2024 | A. Name\n  First　line \t\n\n5 comments. Log in to comment.\nSecond.\nRecent posts\nOther\nMay 2024 (3)\n"


def texts(body, text=False, known=()):
    """The article of a page among *known* other pages of its site."""
    seen = [P.read(x) for x in known]
    repeated = {m for m in {P.mask(b.text) for x in seen for b in x.blocks} if sum(any(P.mask(b.text) == m for b in x.blocks) for x in seen) > 2}
    titles = {P.title_mask(t) for x in seen for t in (x.title, *x.links)} - {0}
    return [b.text for b in P.article(P.read(body, text), repeated, titles)]


#: Other pages of the site: what surrounds their articles is what surrounds those of PAGE and TEXT.
SITE = [
    f"""<title>Other things {k} to know | Club</title><nav><ul><li>Home<li>About</ul></nav><div id=content><div>We use cookies. Accept all</div><h1>Other things {k} to know</h1>
<p>Only page {w} says this, at some length, so that it counts as prose.</p><div>Share: Facebook | WhatsApp | Copy link</div><p>Advertisement</p><p>{k} comments. Log in to comment.</p></div>
<aside><h3>Recent posts</h3><ul><li><a href=/1>Other things</a></ul><p>May 2024 (9)</p></aside><footer><p>© {k} Club</footer>"""
    for k, w in enumerate(("one", "two", "three", "four"), 1)
]


def test_article():
    assert texts(PAGE, known=SITE) == ARTICLE
    assert texts(TEXT, True, SITE) == ["A big day [ref. 1]", "First line", "Second."]


def test_flat_page():
    body = '<body><center><div>Home | About</div></center><p>Cookies help us.</p><div class="big"><font size=5>Title</font></div><div class="meta">1/2/2024 | N</div><P>Text<hr><H3>Neue Beiträge</H3><UL><LI><a href=x>x</a><li><a href=y>y</a></UL><P>© 2024</P></body>'
    assert texts("<title>Title | Club</title>" + body.replace("<P>Text", "<P>Text of the page.")) == ["Title", "Text of the page."]


def test_pages_without_byline_or_with_words_that_notices_use():
    assert texts("<article><h1>Belts</h1><p>One goes first. It is long enough.</p><p>Two.</p></article>") == ["Belts", "One goes first. It is long enough.", "Two."]
    dated = "<article><h1>Belts</h1><p>By Ann on March 3, 2021</p><p>One goes first. It is long enough.</p><p>Two.</p></article>"
    assert texts(dated) == ["Belts", "One goes first. It is long enough.", "Two."]
    own = ["Read also the rules before the exam: bring a gi.", "Share the mat on Line 2 with the kids group.", "PR", "Kyoto · Osaka · Nara"]
    kept = "<article><h1>Belts</h1>" + "".join(f"<p>{x}</p>" for x in own) + "<p>Last of all, a sentence.</p></article>"
    assert texts(kept) == ["Belts", *own, "Last of all, a sentence."] == texts(kept, known=SITE)


def test_list_of_other_pages_does_not_end_the_article():
    body = "<article><h1>Belts</h1><p>A first sentence.</p><h3>Recent posts</h3><ul><li><a href=/1>One more</a><li><a href=/2>And more</a></ul><p>The article goes on here.</p></article>"
    assert texts(body) == ["Belts", "A first sentence.", "The article goes on here."]


def test_pointers_need_a_title_of_the_site():
    body = "<article><h1>Belts</h1><p>A first sentence.</p><p>See also: Other things to come</p><p>See also: the other door</p><p>A last sentence.</p></article>"
    assert texts(body, known=SITE) == ["Belts", "A first sentence.", "See also: the other door", "A last sentence."]


def test_rendering():
    out = P.render(P.read(PAGE).blocks)
    assert "- one\n- two more" in out and "May   12\n" in out.replace("\n\n", "\n") and "unseen" not in out and "var a" not in out
    assert P.render([]) == ""


def test_edges(spark):
    long = PAGE.replace("Last.", "word " * 200_000)
    rows = [("a.html", PAGE, "x"), ("b.txt", TEXT, "x"), ("c.html", None, "x"), ("d.html", "", "x"), ("e.html", "<p>no byline", "x"), ("f.html", long, "x"), (None, PAGE, "x"), ("g.html", PAGE.replace("Second <a href=/x>one</a>.", "Last."), "x")]
    rows += [(f"s{k}.html", x, "x") for k, x in enumerate(SITE)]
    df = spark.createDataFrame(rows, "raw_path string, body string, block_md5 string")
    by = {}
    for r in P.article_blocks(df, site=None).orderBy("raw_path", "n").collect():
        assert r.block_md5 == hashlib.md5(r.text.encode()).hexdigest()
        by.setdefault(r.raw_path, []).append(r.text)
    assert by["a.html"] == by[None] and [x for x in by["a.html"] if x not in ARTICLE] in ([], ["Share: Facebook | WhatsApp | Copy link"])
    assert set(by) >= {"a.html", "b.txt", "f.html", "g.html", None} and not {"c.html", "d.html"} & set(by)
    assert by["f.html"][-1] == ("word " * 200_000).strip()
    assert by["g.html"].count("Last.") == 2
    assert P.article_blocks(df.limit(0), site=None).collect() == [] and len(P.rendered(df, site=None).collect()) == len(rows)


@pytest.mark.parametrize("bound", [P.BROADCAST_HASHES, 0])
def test_hot_site_and_recaptures(spark, monkeypatch, bound):
    """Both ways to join the profiles. One site holds most pages, captured again and again: its article is no notice, and what surrounds it is."""
    monkeypatch.setattr(P, "BROADCAST_HASHES", bound)
    rows = [(f"s{k}-{n}.html", "hot", x) for k, x in enumerate(SITE) for n in range(30 if k == 0 else 1)] + [("o.html", None, "<h1>Alone</h1><p>Nothing is known of this site.</p>")]
    got = {}
    for r in P.article_blocks(spark.createDataFrame(rows, "raw_path string, source_id string, body string")).orderBy("raw_path", "n").collect():
        got.setdefault(r.raw_path, []).append(r.text)
    assert got["s0-7.html"] == ["Other things 1 to know", "Only page one says this, at some length, so that it counts as prose."]
    assert got["o.html"] == ["Alone", "Nothing is known of this site."] and len(got) == len(rows)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="<>/pdivtrul =\"'&;a!-", max_size=200))
def test_any_markup(s):
    P.render(P.read(s).blocks)
    P.article(P.read(s))


def test_every_page_has_an_article(spark, data):
    pages = spark.read.parquet(f"{data}/raw_pages.parquet")
    assert P.article_blocks(pages).select("raw_path").distinct().count() == pages.count()
