"""Template deduction, filter audit and fill-in-middle against brute force, with odd rows."""

import hashlib
import itertools
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.llm import fill_middle, filter_audit, html_template

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
PAGES = "page_id bigint, url string, html string"


def rows_of(seed=3, n=120):
    """Texts of all kinds under ids with gaps, repeats and nulls."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "Bc", "DEF", "é", "漢字", "😀", "x$", "50%", "plain", "word"]) + rng.choice(["", str(rng.randrange(40))])
    some = [None, "", " \n\t", "ABC", "x <P> y", "<S>", "a<M>b", "a<", "<P", "P>x", "\x85\xa0 b", "é" * 50]
    some += [rng.choice([" ", "\n", "  "]).join(word() for _ in range(rng.choice([1, 5, 99, 100, 101, 300]))) for _ in range(n)]
    some += [rng.choice(some) for _ in range(n)] + ["long " * 20000]
    out = [(rng.randrange(10**6), t, rng.choice(["en", "de", None, ""]), "s", 0) for t in some]
    return out + [(None, some[20], "en", "s", 0), (None, "ABC", "en", "s", 0), (7, "same", "en", "s", 0), (7, "same", "en", "s", 0), (7, "same", "fr", "s", 0), (8, "same", "en", "s", 0)]


@pytest.fixture(scope="module")
def some():
    return rows_of()


@pytest.fixture(scope="module")
def docs(spark, some):
    return spark.createDataFrame(some, DOCS).withColumns({c: F.lit("x") for c in ("part", "mask", "digest", "n", "form", "output", "restored", "good", "first")})


# -- op12 -------------------------------------------------------------------------------------


def fails(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t))]


def audit_brute_force(data, labels):
    least = {}
    for i, t, *_ in data:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    out = Counter()
    for i, t, lang, *_ in data:
        f = dict(zip("ABCDE", [*fails(t), i is not None and i > least[t or ""]], strict=True))
        for order in map("".join, itertools.permutations("ABCDE")):
            gone = False
            for step, x in enumerate(order, 1):
                key = (lang or "", order, step)
                out[key, "kept"] += not gone and not f[x]
                out[key, "removed"] += not gone and f[x]
                out[key, "redundant"] += gone and f[x]
                out[key, "unique_fails"] += f[x] and sum(f.values()) == 1
                out[key, "good_lost"] += not gone and f[x] and i in good
                out[key, "toxic_lost"] += not gone and f[x] and i in toxic
                gone = gone or f[x]
    for (part, order, step), name in [k for k in out if k[1] == "removed"]:
        for other in map("".join, itertools.permutations("ABCDE")):
            out[(part, order, step), "shapley"] += out[(part, other, other.index(order[step - 1]) + 1), "removed"]
    return out


def test_audit(spark, some, docs):
    rng = random.Random(1)
    labels = [(i, rng.randrange(2), rng.choice([0, 1, None])) for i, *_ in some if rng.random() < 0.6] + [(None, 1, 1), (7, None, None), (7, 1, 0), (10**7, 1, 1)]
    got = filter_audit.op12(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("part", F.lit("x"))).collect()
    want = audit_brute_force(some, labels)
    assert len(got) == 600 * len({r.part for r in got}) == 600 * 4
    for r in got:
        for name in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"):
            assert r[name] == want[(r.part, r.filter_order, r.step), name], (r, name)


def test_audit_of_nothing(spark):
    assert filter_audit.op12(spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).count() == 0
    one = filter_audit.op12(spark.createDataFrame([(1, None, None, None, 0)], DOCS), spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    assert {(r.part, r.removed) for r in one.where("substring(filter_order, step, 1) = 'A'").collect()} == {("", 1)}


def test_fields_do_not_overflow():
    big = 2**40 + 12345
    total = sum(big * filter_audit.packed()["kept"][mask] for mask in range(32))
    assert (filter_audit.unpack(total) % big == 0).all() and filter_audit.unpack(total).max() == 16 * big


# -- op13 -------------------------------------------------------------------------------------


def middle_brute_force(i, t):
    t = t or ""
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    a, b, c, d = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or c % 100 >= 90:
        return len(t), "plain", None, None, t
    lo, hi = sorted((a % (len(t) + 1), b % (len(t) + 1)))
    p, m, s = t[:lo], t[lo:hi], t[hi:]
    return (len(t), "spm", lo, hi - lo, f"<S>{s}<P>{p}<M>{m}") if d % 100 < 20 else (len(t), "psm", lo, hi - lo, f"<P>{p}<S>{s}<M>{m}")


def test_fill_middle(some, docs):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = Counter(tuple(r) for r in fill_middle.op13(docs).collect())
    want = Counter((i, *(x := middle_brute_force(i, t))[:4], sha(x[4]), sha(t or "")) for i, t, *_ in some)
    assert got == want and {k[2] for k in got} == {"plain", "psm", "spm"}


def test_fill_middle_round_trip(docs, some):
    made = fill_middle.restore(fill_middle.transform(docs, seed="other", plain_from=100, spm_below=50)).collect()
    assert Counter(r.restored for r in made) == Counter(t or "" for _, t, *_ in some)
    assert all((r.form == "plain") == (not r.restored or any(s in r.restored for s in ("<P>", "<S>", "<M>"))) for r in made)


def test_rotation():
    import numpy as np

    rng = random.Random(2)
    for _ in range(300):
        data = [rng.randrange(256) for _ in range(rng.randrange(30))]
        lo, mid, hi = sorted(rng.randrange(len(data) + 1) for _ in range(3))
        block = np.array(data, np.uint8)
        fill_middle.rotate(block, lo, mid, hi)
        assert block.tolist() == data[:lo] + data[mid:hi] + data[lo:mid] + data[hi:]


def test_fill_middle_of_nothing(spark):
    assert fill_middle.op13(spark.createDataFrame([], DOCS)).count() == 0


# -- op11 -------------------------------------------------------------------------------------


def text(source):
    page = html_template.Page(source)
    return page.text(html_template.main_slot(page.weights(frozenset())), frozenset())


ARTICLE = "<article><h1>Title &amp; more</h1><p>One   <b>two</b>\n three<br>four</p><ul><li>item<li>other</ul></article>"
PLAIN = "Title & more\nOne two three four\nitem\nother"


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("", ""),
        ("just text  &lt;b&gt;", "just text <b>"),
        (ARTICLE, PLAIN),
        (f"<html><head><title>T</title><style>p{{}}</style><script>var a='<article></p>';</script></head><body><nav>x</nav>{ARTICLE}<footer>y</footer></body></html>", PLAIN),
        (f"<header>h</header><aside><article>other story that is quite long, longer than all that the article has</article></aside><main>{ARTICLE}</main><form>f<input></form>", PLAIN),
        (f'<div class="cookie-notice">n</div><div id="sidebar2">s</div>{ARTICLE[:-10]}<section class="comments"><p>c</p></section><div class=ad>a</div></article><!-- x <p>no</p> -->', PLAIN),
        (f"{ARTICLE[:-10]}<header><h2>Sub</h2><p>by</p></header></article>", PLAIN + "\nSub"),
        ('<div class="menu"><a href=1>m</a></div><div class="post"><h2>H</h2><p>aaaa bbbb cccc</p><p>dddd</p></div><div><a href=2>l1</a></div>', "H\naaaa bbbb cccc\ndddd"),
        ("<article><p>cut off <i>here", "cut off here"),
        ("<article><p><b>open.<br><p>next</p></article>", "open.\nnext"),
        ("<article>a<table><tr><td>b<td>c<tr><td>d</table>e</article>", "a\nb\nc\nd\ne"),
        ('<article><p>a < b &nbsp; 3<4 </p><p title="x>y">q</p></article>', "a < b 3<4\nq"),
        ('<body class="has-sidebar"><div class="with-comments"><p>text of it</p></div></body>', "text of it"),
        ("<article><p hidden>no</p><div style='display: none'>no</div><button>no</button>yes<p>&#233;&#x1F600;&amp;amp;</p></article>", "yes\né😀&amp;"),
        ("<script>never closed <article>no</article>", ""),
    ],
)
def test_page(source, want):
    assert text(source) == want


def test_deep_and_long_pages():
    assert text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert len(text("<article>" + "<p>word word</p>" * 50000 + "</article>").split("\n")) == 50000
    assert text("<b><i>" * 20000 + "</u>" * 20000 + "<div>" + "</b>" * 20000 + "x") == "x"
    assert html_template.Page('<p a="' * 5000).blocks == []


def host_pages(rng, n=14):
    """Pages of a host whose tags and classes tell nothing: the frame's texts are on every page, one passage on two thirds."""
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    out, want = [], []
    for i in range(n):
        ps = [" ".join(word() for _ in range(rng.randint(8, 30))) for _ in range(rng.randint(1, 6))] + (["a passage that many share"] if i % 3 else [])
        items = "".join(f"<li><a href=/{word()}>{word()}</a></li>" for _ in range(rng.randint(2, 7)))
        title = word()
        body = "".join(f"<p>{p}</p>" for p in ps)
        out.append(f"<html><body><div class=q1><p>Welcome to this very place, it is the same on every page of it</p></div><div class=q2><ul>{items}</ul></div><div class=q3><h1>{title}</h1><p>Tell your friends</p>{body}</div><div class=q4>All rights with us {i % 2}</div>{'</body></html>' if i % 4 else ''}")
        want.append("\n".join([title, *ps]))
    return out, want


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_template_of_a_host(spark, monkeypatch, broadcast):
    monkeypatch.setattr(html_template, "BROADCAST_TOKENS", broadcast)
    sources, want = host_pages(random.Random(5))
    rows = [(i, f"https://Frame.example.org:80/{i}?q", s) for i, s in enumerate(sources)]
    rows += [(100, None, ARTICLE), (101, "not a url", ARTICLE), (102, "http://few.example/", ARTICLE), (None, "http://few.example/2", None), (0, rows[0][1], sources[0])]
    df = spark.createDataFrame(rows, PAGES).withColumns({c: F.lit(1) for c in ("host", "token", "main", "salt", "text")}).repartition(3)
    got = sorted(((r.page_id if r.page_id is not None else -1, r.url, r.text, r.n_chars) for r in html_template.op11(df).collect()), key=repr)
    texts = dict(enumerate(want)) | {100: PLAIN, 101: PLAIN, 102: PLAIN, None: ""}
    assert got == sorted(((i if i is not None else -1, u, texts[i], len(texts[i])) for i, u, _ in rows), key=repr)


def test_vectors_equal_brute_force(spark):
    sources, _ = host_pages(random.Random(6), 40)
    pages = spark.createDataFrame([(i % 37, "http://a.b/c", s) for i, s in enumerate(sources)], PAGES).withColumn("host", F.lit("a.b")).repartition(5)
    found = html_template.templates(pages).df.collect()
    vectors = {}
    for k, s in enumerate(sources):
        for token, n in Counter(html_template.Page(s).sequence).items():
            vectors.setdefault(token, [0] * len(sources))[k] = n
    vectors = {t: tuple(v) for t, v in vectors.items() if 2 * sum(map(bool, v)) >= len(sources)}
    assert len(found) == 1 and found[0].of == 40 and set(found[0].tokens) == set(vectors)
    classes = dict(zip(found[0].tokens, found[0].classes, strict=True))
    for a, b in itertools.combinations(vectors, 2):
        assert (classes[a] == classes[b]) == (vectors[a] == vectors[b])
    assert {t for t, c in classes.items() if c == 0} == {t for t, v in vectors.items() if set(v) == {1}}


def test_classes_are_ordered_and_nested():
    classes, sizes = {1: 0, 2: 0, 3: 0, 7: 1, 8: 1}, {0: 3, 1: 2}
    check = lambda *s: html_template.broken(list(s), classes, sizes)[0]
    assert check(1, 2, 7, 8, 99, 7, 8, 3) == set()
    assert check(1, 7, 2, 8, 3) == {1}
    assert check(1, 2, 7, 3) == {1}
    assert check(1, 2, 3, 1, 2, 3) == set() and check(1, 2, 3, 1, 3, 2) == {0}


def test_pages_of_nothing(spark):
    assert html_template.op11(spark.createDataFrame([], PAGES)).count() == 0
