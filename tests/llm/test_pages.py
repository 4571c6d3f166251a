import random

import numpy as np
import pytest

from tallymap.llm import pages

SCHEMA = "page_id long, url string, html string, host string, part string, text string, bytes string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)


@pytest.mark.parametrize("html,text", [
    ("", ""),
    ("<article><h1>T  &amp; u</h1><p>a<b>b</b>\n c<p>d<br>e</article><footer>x</footer>", "T & u\nab c\nd\ne"),
    ("<body><nav><ul><li>menu</ul></nav><div class='ad'>buy</div><article><p>one</p></article>", "one"),
    ("<main><p>x</p><aside>side</aside><p>y</p><form>f<input value='>'></form></main>", "x\ny"),
    ("<article>a<script>if (a < b) '</p>'</script><style>p{}</style>b<!-- c --> d</article>", "ab d"),
    ("<article><p>t</p><section id='comments'><p>first!</p></section><div class=\"share-bar\">s</div></article>", "t"),
    ("<div role='navigation'>n</div><div role=main><p>m&#233;&nbsp;&lt;x&gt;</p></div>", "mé <x>"),
    ("<article hidden>h</article><article><p>v</p></article>", "v"),
    ("<p>only this", "only this"),
    ("<article><table><tr><td>a</td><td>b</td></tr></table><ul><li>c<li>d</ul></article>", "a\nb\nc\nd"),
    ("<ARTICLE><P CLASS=lead>A</P></ARTICLE", "A"),
    ("<article><p>5 < 6 and a<sub>1</sub></p></article>", "5 < 6 and a1"),
])
def test_structure(html, text):
    assert pages.extract([html]) == [text]


@pytest.mark.parametrize("start", [
    '<article style="overflow:hidden">', '<article data-hidden="false">', '<article class="post has-sidebar comments-open">', '<main class="sidebar">',
    '<div class="category-social"><article>', '<div class="sticky-header" data-role="banner" data-id="menu"><main>', '<div class="sidebar"><article>',
    '<article title="a hidden role=alert class=ad">',
])
def test_an_article_is_not_lost_by_loose_marks(start):
    assert pages.extract([f"<div>open</div>{start}<p>t</p>"]) == ["t"]


def test_chrome_around_or_inside_an_article_stays():
    for html in ("<nav><article>x</article></nav>", "<aside><div><main>x</main></div></aside>", "<article hidden>x</article>", "<main aria-hidden='true'>x</main>",
                 "<div class='widget'>x</div>", "<div class='sidebar'>x<p>y</div>", "<div role=search>x</div>"):
        assert pages.extract([html]) == [""], html
    assert pages.extract(["<article>a<div class='comments'><article>reader</article></div></article>"]) == ["a"]


def plain_repeated(streams, run):
    out = []
    for i, s in enumerate(streams):
        covered = [False] * len(s)
        for a in range(len(s) - run + 1):
            part = s[a : a + run]
            if any(o[b : b + run] == part for j, o in enumerate(streams) if j != i for b in range(len(o) - run + 1)):
                covered[a : a + run] = [True] * run
        out.append(covered)
    return out


def test_repeats_are_those_of_all_substrings():
    draw = random.Random(3)
    for _ in range(150):
        streams = [[draw.randrange(3) for _ in range(draw.randint(0, 25))] for _ in range(draw.randint(1, 5))]
        run = draw.randint(1, 6)
        assert [c.tolist() for c in pages.repeated(streams, run)] == plain_repeated(streams, run)


BOILER = "<div>we use small files to make this site work better for all of you</div>"


def test_boilerplate_of_a_host_goes_and_unique_runs_stay(spark):
    rows = [(i, f"http://h.example/{i}", f"{BOILER}<div>n{i} is unique and stands here</div>") for i in range(6)]
    got = {r["page_id"]: r["text"] for r in pages.main_texts(frame(spark, rows)).collect()}
    assert got == {i: f"n{i} is unique and stands here" for i in range(6)}


def test_copied_articles_are_kept(spark):
    rows = [(i, "http://h.example/", f"{BOILER}<article><p>the same long article on every page of this one host</p></article>") for i in range(4)]
    rows += [(9, "http://h.example/x", f"{BOILER}<article><p>the same long article on every page of this one host</p><p>more</p></article>")]
    texts = sorted(r["text"] for r in pages.main_texts(frame(spark, rows)).collect())
    line = "the same long article on every page of this one host"
    assert texts == [line] * 4 + [line + "\nmore"]


def test_repeats_of_a_host_in_parts_are_those_of_the_whole_host(spark, monkeypatch):
    draw = random.Random(5)

    def some(n):
        return " ".join(f"v{draw.randrange(10**6)}" for _ in range(n))

    shared = [f"{some(7)} <b>notice</b> {some(5)}" for _ in range(12)]  # each on two pages only
    rows = [(i, f"http://h.example/{i}", f"<div>{some(9)}<p>{shared[i % 12] if i < 24 else some(4)}</p><nav>{shared[i % 7]}</nav>{some(20)}</div>") for i in range(60)]
    rows += [(100 + i, f"http://h.example/c{i}", rows[30][2]) for i in range(3)]  # equal pages are one
    rows += [(200, "http://h.example/a", f"<article>{shared[3]}</article>{some(9)}"), (201, "http://other.example/", f"<p>{shared[0]}</p>")]
    expected = {r["page_id"]: r["text"] for r in pages.main_texts(frame(spark, rows)).collect()}
    assert "notice" not in "".join(expected[i] for i in range(24)) and expected[100] == expected[30] != ""
    monkeypatch.setattr(pages, "GROUP_BYTES", 1000)
    assert {r["page_id"]: r["text"] for r in pages.main_texts(frame(spark, rows)).collect()} == expected


NOTE = "<p>all that is written here may be copied by all who name us</p>"


def test_boilerplate_inside_articles_goes_and_copies_stay_whole(spark, monkeypatch):
    def article(i):
        return " ".join(f"n{i}x{k}" for k in range(30))

    rows = [(i, f"http://h.example/{i}", f"<article><p>{article(i)}</p>{NOTE}</article>") for i in range(6)]
    rows += [(10 + i, f"http://h.example/c{i}", f"<main><p>{article(99)}</p>{NOTE}<p>{'again ' * i}</p></main>") for i in range(3)]  # near copies
    rows += [(20, "http://other.example/", f"<article><p>{article(20)}</p>{NOTE}</article>")]
    note = "all that is written here may be copied by all who name us"
    expected = {i: article(i) for i in range(6)} | {10 + i: "\n".join([article(99), note] + [" ".join(["again"] * i)] * (i > 0)) for i in range(3)}
    expected[20] = article(20) + "\n" + note
    assert {r["page_id"]: r["text"] for r in pages.main_texts(frame(spark, rows)).collect()} == expected
    monkeypatch.setattr(pages, "GROUP_BYTES", 300)
    assert {r["page_id"]: r["text"] for r in pages.main_texts(frame(spark, rows)).collect()} == expected


def plain_texts(rows, run):
    """page_id and text by comparing all substrings of all pages of a host."""
    out = {}
    for host in {url.split("/")[2] for _, url, _ in rows}:
        own = [(i, pages.blocks(html)) for i, url, html in rows if url.split("/")[2] == host]
        streams = sorted({tuple(w for _, words in page for w in words) for _, page in own})
        covers = dict(zip(streams, plain_repeated(streams, run), strict=True))
        for i, page in own:
            cover, lines, cut = list(covers[tuple(w for _, words in page for w in words)]), [], []
            for zone, words in page:
                cut.append((zone, words, [cover.pop(0) for _ in words]))
            main = [x for zone, _, gone in cut if zone == pages.MAIN for x in gone]
            for zone, words, gone in cut:
                if zone == pages.MAIN and (sum(main) > len(main) / 2 or not all(gone)):
                    lines.append(" ".join(words))
                if zone == pages.OPEN and not main and not all(gone):
                    lines.append(" ".join(w for w, x in zip(words, gone, strict=True) if not x))
            out[i] = "\n".join(lines)
    return out


def test_texts_are_those_of_all_substrings(spark, monkeypatch):
    draw = random.Random(8)

    def block():
        words = " ".join(draw.choice(["a", "b", "c", "d", "e"]) for _ in range(draw.randint(1, 12)))
        return draw.choice(["<p>{}</p>", "<div>{}</div>", "<nav>{}</nav>"]).format(words)

    rows = []
    for i in range(150):
        inside = "".join(block() for _ in range(draw.randint(0, 4)))
        html = draw.choice(["{}", "<article>{}</article>", "<nav>{}</nav>"]).format(inside) + block() * draw.randint(0, 1)
        rows.append((i, f"http://h{i % 3}.example/{i}", html))
    expected = plain_texts(rows, 5)
    by_markup = {i: pages.extract([html])[0] for i, _, html in rows}
    assert sum(by_markup[i] != expected[i] for i, _, html in rows if "<article>" in html) > 3
    for size in (pages.GROUP_BYTES, 200):
        monkeypatch.setattr(pages, "GROUP_BYTES", size)
        assert {r["page_id"]: r["text"] for r in pages.main_texts(frame(spark, rows), 5).collect()} == expected


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(pages, "GROUP_BYTES", 2000)
    long = "<article>" + "".join(f"<p>w{i} x</p>" for i in range(20_000)) + "</article>"
    rows = [(1, None, "<article>a</article>"), (2, "not a url", None), (None, None, None), (3, "HTTP://A.example:80/x", ""), (2**62 + 1, "http://b.example", "z"), (None, "http://b.example", "z"), (4, "//a.example", long), (4, "//a.example", long)]
    got = pages.page_texts(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by_id = {r["page_id"]: r for r in got}
    assert by_id[2**62 + 1]["text"] == "z"
    assert by_id[1]["text"] == "a" and by_id[2]["text"] == "" and by_id[2]["n_chars"] == 0
    assert by_id[4]["text"] == "\n".join(f"w{i} x" for i in range(20_000))
    assert pages.page_texts(frame(spark, [])).count() == 0


def test_numbers_by_gaps():
    draw = random.Random(2)
    for top in (1, 10, 300, 10**6, 2**64):
        for n in (1, 2, 50):
            given = np.unique(np.array([draw.randrange(top) for _ in range(n)], dtype=np.uint64))
            assert pages._numbers(pages._gaps(given)).tolist() == given.tolist()
