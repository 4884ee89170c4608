import time

import pytest

import odd
from feedloom.llm import html


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("plain &amp; text", "plain & text"),
        ("<p>a<p>b", "a\nb"),
        ("<p> a \n b&nbsp;c<br>d </p><p></p><p>e", "a b c d\ne"),
        ("<body><nav><a href=x>menu</a></nav><article><h1>T</h1><p>Some words here.</p></article><footer>f</footer>", "T\nSome words here."),
        ("<article><p>One paragraph of words.</p><div class='comments'><p>First!</p></div></article>", "One paragraph of words."),
        ("<header>site</header><main><header><h1>Head</h1></header><p>The body of it.</p></main>", "Head\nThe body of it."),
        ('<p>x <b>y</p><script>if (a < b) "</p>"</script><style>p{}</style><p>z</p>', "x y\nz"),
        ("<p>a<!-- hidden <p>no</p> --> b</p><form><p>your name</p></form>", "a b"),
        ("<ul><li>one<li>two</ul><table><tr><td>c<td>d</table>", "one\ntwo\nc\nd"),
        ('<p title="a > b">kept</p><p title=it\'s>too</p>', "kept\ntoo"),
        ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
        ("<p>&#233;&eacute;&copy &am; &unknown;</p>", "éé© &am; &unknown;"),
        ("<script>never closed <p>x</p>", ""),
    ],
)
def test_pages(page, text):
    assert html.main_text(page) == text


def test_link_lists_lose_against_text():
    links = "".join(f"<li><a href=/{i}>link number {i}</a></li>" for i in range(40))
    page = f"<body><div><ul>{links}</ul></div><div><p>{'word ' * 60}</p><p>{'more ' * 50}</p></div></body>"
    assert html.main_text(page) == ("word " * 60).strip() + "\n" + ("more " * 50).strip()


def _p(n: int, size: int) -> list[str]:
    return [(f"paragraph {i} " + "word " * size)[:size].strip() for i in range(n)]


_TEN, _EIGHT, _FOUR, _LEAD, _HEAD = _p(10, 300), _p(8, 300), _p(4, 120), "lead " * 30, "A headline of sixty characters that stands above the article"
_LINKS = "<div><p>More</p>" + "".join(f"<p><a href=/{i}>another story, number {i}</a></p>" for i in range(9)) + "</div>"


@pytest.mark.parametrize(
    "page, blocks",
    [
        ("<body><article><h1>{h}</h1><p>{l}</p><div>{ten}</div>{links}</article></body>", [_HEAD, _LEAD.strip(), *_TEN]),
        ("<body><main><h1><a href=/>{h}</a></h1><article><div>{ten}</div><p>{l}</p></article></main></body>", [_HEAD, *_TEN, _LEAD.strip()]),
        (
            "<body><article><h1>{h}</h1><section><h2>One</h2>{eight}</section><section><h2>Two</h2>{four}</section></article></body>",
            [_HEAD, "One", *_EIGHT, "Two", *_FOUR],
        ),
        ("<body><div>{links}</div><div><h1>{h}</h1><p>{l}</p><div>{ten}</div></div></body>", [_HEAD, _LEAD.strip(), *_TEN]),
        ("<body><h1>{h}</h1><p>{l}</p><div>{ten}</div>{links}</body>", [_HEAD, _LEAD.strip(), *_TEN]),
    ],
)
def test_whole_article(page, blocks):
    parts = {k: "".join(f"<p>{p}</p>" for p in v) for k, v in (("ten", _TEN), ("eight", _EIGHT), ("four", _FOUR))}
    assert html.main_text(page.format(h=_HEAD, l=_LEAD, links=_LINKS, **parts)) == "\n".join(blocks)


_LONG = "<h1>Head</h1>" + "".join(f"<p>{p}</p>" for p in _FOUR)


@pytest.mark.parametrize(
    "page, more",
    [
        ("<div class='content-sidebar-wrap'><article>{}</article></div>", []),
        ("<body class=x><div class='has-sidebar'>{}</div><div class='wide sidebar'><p>beside</p></div>", []),
        ("<div id='page' class='no-comments'><main>{}</main></div>", []),
        ("<div class='search'><article>{}</article></div>", []),
        ("<div class='search'><div>{}</div></div>", []),
        ("<form action=/><div class=menu><p>Menu</p></div><div>{}</div></form>", []),
        ("<form><main>{}</main></form><article><p>a card</p></article>", []),
        ("<article>{}<p class='notice'>Mind this.</p><div class=side><p>And this.</p></div></article>", ["Mind this.", "And this."]),
        ("<article>{}<div class=share><a href=a>one</a> <a href=b>two</a></div></article>", []),
        ("<article>{}</article><div id=comments>" + "<article><p>A long reply. </p></article>" * 99 + "</div>", []),
        ("<article>{}<form><p>your name</p></form></article>", []),
    ],
)
def test_labels_do_not_drop_the_main_text(page, more):
    assert html.main_text(page.format(_LONG)) == "\n".join(["Head", *_FOUR, *more])


@pytest.mark.parametrize("part", ["<h1>", "<div><h1>", "<article><a>x", "<form>x", "<p class=side>x"])
def test_containers_are_linear(part):
    test_linear(part)


@pytest.mark.parametrize("part", ["<div>", "<a \"x", "<script>", "<!--", "</b", "<p title='", "<b><p>", "& <", "<td><p>"])
def test_linear(part):
    def seconds(n):
        start = time.process_time()
        html.main_text(part * n)
        return time.process_time() - start

    seconds(1000)
    assert seconds(40_000) < 8 * seconds(10_000) + 0.2


def test_extract(spark):
    rows = [(odd.BIG, "u", None, "x"), (1, None, "", "x"), (None, "v", "<p>a é</p>", "x"), (None, "v", "<p>a é</p>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars string")
    got = html.extract(pages, keep=("page_id", "url", "n_chars")).collect()
    assert [tuple(r) for r in got] == [(odd.BIG, "u", "", 0), (1, None, "", 0), (None, "v", "a é", 3), (None, "v", "a é", 3)]
    assert html.extract(pages.limit(0)).collect() == []


BODY = "".join(f"<p>Paragraph {i} of the article has words enough to be dense text.</p>" for i in range(6))
ARTICLE = "\n".join(f"Paragraph {i} of the article has words enough to be dense text." for i in range(6))


@pytest.mark.parametrize(
    "label",
    ['class="comment-list"', 'class="comment-body"', 'class="ad-slot"', 'class="related-posts"', 'class="cookie-banner"',
     'id="comments-section"', 'class="siteFooter"', 'class="x user-comments"', 'class="post-comments"', 'role="x" class="newsletter-signup"'],
)
@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_surroundings_by_a_name_of_several_parts(tag, label):
    clutter = f"<div {label}><p>First, says a reader, and goes on for a while about it.</p><p>Second one.</p></div>"
    page = f"<html><body><{tag}>{BODY}{clutter}</{tag}></body></html>"
    assert html.main_text(page) == ARTICLE
    assert html.main_text(f"<html><body><{tag}>{BODY}</{tag}>{clutter}</body></html>") == ARTICLE


@pytest.mark.parametrize(
    "label", ["no-comments", "has-sidebar", "content-sidebar-wrap", "search-result-page", "page-with-comments", "post-footer-content", "sidebar-left-layout", "ad-free"]
)
def test_such_names_around_the_main_text(label):
    for page in (
        f'<html><body class="{label}"><article>{BODY}</article></body></html>',
        f'<html><body><div class="{label}"><article>{BODY}</article></div></body></html>',
        f'<html><body><div class="{label}">{BODY}</div></body></html>',
        f'<html><body><main><div class="{label}">{BODY}</div></main></body></html>',
    ):
        assert html.main_text(page) == ARTICLE


def naive(tree):
    """Composite text density by recursion: (tag, children) with texts as children; the text
    that the densest element, its container and the threshold give."""
    import math

    nodes = []

    def measure(node, in_link, up):
        tag, children = node
        in_link = in_link or tag == "a"
        mine = {"tag": tag, "up": up, "kids": [], "chars": 0, "links": 0, "tags": 0, "link_tags": 0, "own": 0, "text": []}
        nodes.append(mine)
        for child in children:
            if isinstance(child, str):
                size = len(" ".join(child.split()))
                mine["chars"] += size
                mine["own"] += size
                mine["links"] += size * in_link
                mine["text"].append(child)
            else:
                kid = measure(child, in_link, mine)
                mine["kids"].append(kid)
                mine["text"].append(kid)
                mine["chars"] += kid["chars"]
                mine["links"] += kid["links"]
                mine["tags"] += kid["tags"] + 1
                mine["link_tags"] += kid["link_tags"] + (kid["tag"] == "a")
        return mine

    root = measure(tree, False, None)
    if not root["chars"]:
        return ""
    share = max(root["links"], 1) / root["chars"]
    for x in nodes:
        c, t, lc, lt = x["chars"], max(x["tags"], 1), max(x["links"], 1), max(x["link_tags"], 1)
        base = math.log(c / max(c - x["links"], 1) * lc + share * c + math.e) if c else 0
        x["density"] = c / t * math.log(c / lc * t / lt) / math.log(base) if c and base > 1 else 0.0
    for x in nodes:
        x["sum"] = x["own"] + sum(k["density"] for k in x["kids"])

    def best(x):
        return max([x, *map(best, reversed(x["kids"]))], key=lambda y: y["sum"])

    core = best(root)
    path = [core]
    while path[-1]["up"]:
        path.append(path[-1]["up"])
    least = min(x["density"] for x in path if x is core or x["tag"] not in ("#page", "html"))
    keep = set()

    def take(x):
        keep.add(id(x))
        for k in x["kids"]:
            take(k)

    def descend(x):
        if x is root or x["tag"] == "html" or x["density"] >= least:
            take(best(x))
            for k in x["kids"]:
                descend(k)

    descend(root)
    if len(path) > 1 and path[1]["tag"] not in ("#page", "body", "html"):
        def rest(x):
            keep.add(id(x))
            for k in x["kids"]:
                if not (k["tag"] in html.BLOCKS and k["link_tags"] > 1 and 2 * k["links"] > k["chars"]):
                    rest(k)

        rest(path[1])
    blocks, line = [], []

    def write(x):
        block = x["tag"] in html.BLOCKS
        if block:
            flush()
        for part in x["text"]:
            if isinstance(part, str):
                if id(x) in keep:
                    line.append(part)
            else:
                write(part)
        if block:
            flush()

    def flush():
        words = "".join(line).split()
        if words:
            blocks.append(" ".join(words))
        line.clear()

    write(root)
    flush()
    return "\n".join(blocks)


def test_density_against_recursion():
    import random

    rng = random.Random(12)

    def grow(depth):
        out = []
        for _ in range(rng.randint(1, 4)):
            kind = rng.random()
            if kind < 0.35 or depth > 5:
                out.append(" ".join("word" * rng.randint(1, 3) for _ in range(rng.choice([1, 3, 12, 40]))))
            elif kind < 0.5:
                out.append(("a", [f"link {rng.randint(0, 99)}"]))
            else:
                out.append((rng.choice(["div", "section", "span", "b", "ul"]), grow(depth + 1)))
        return out

    def written(node):
        return node if isinstance(node, str) else f"<{node[0]}>{''.join(map(written, node[1]))}</{node[0]}>"

    for _ in range(300):
        body = grow(0)
        tree = ("#page", [("html", [("body", body)])])
        page = f"<html><body>{''.join(map(written, body))}</body></html>"
        assert html.main_text(page) == naive(tree)
