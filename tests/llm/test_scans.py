"""HTML extraction, secrets and personal data."""

import base64
import bz2
import gzip
import lzma
import math
import random
import re
import time
import zlib
from collections import Counter
from urllib.parse import quote

import numpy as np
import pytest
import zstandard

from sextant.llm import html_extract, personal_data, secrets

ALWAYS = lambda path: (1.0, 1.0)


def text(page):
    return html_extract.main_text(page, ALWAYS, 0.3)


def test_main_text():
    page = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body><header>site</header><nav><ul><li>menu</ul></nav>
      <div class="cookie-notice">notice</div><article><h1>Head &amp; <i>line</i></h1><p>One<br>two&nbsp;three<p>Four <script>x = "</p>"</script>five
      <form>f</form><div class="comments"><p>reader</p></div><aside>side</aside></article><div id="sidebar">side</div><footer>foot</footer></body></html>"""
    assert text(page) == "Head & line\nOne two three\nFour five"
    assert text("") == "" and text("<p>") == "" and text("a < b") == "a < b"
    assert text("<div>" * 3000 + "deep") == "deep"
    assert text("<p>plain <b>text</b><p>more") == "plain text\nmore"
    assert text('<p hidden>x</p><p style="display:none">y</p><p>z</p>') == "z"


def test_style_tree(table):
    """A branch that all pages of a site repeat goes, without any mark on it; what differs stays."""
    page = lambda i: f"<body><div><span>same words everywhere</span></div><section><p>story {i} of many, told anew</p></section></body>"
    rows = [(i, f"http://a.example/{i}", page(i)) for i in range(30)] + [(99, "http://b.example/", page(1)), (100, None, None), (101, "http://a.example/e", "")]
    pages = table(rows, "page_id long, url string, html string")
    for bound in (100_000, 0):  # sent to the tasks, and joined
        out = {r.page_id: r.text for r in html_extract.extract_main_text(pages, broadcast_rows=bound).collect()}
        assert out[3] == "story 3 of many, told anew"
        assert out[99] == "same words everywhere\nstory 1 of many, told anew"  # one page of a site tells nothing
        assert out[100] == out[101] == "" and len(out) == len(rows)
    assert html_extract.extract_main_text(pages.limit(0)).count() == 0


def gold_page(host, i, rng):
    """(html, main text) of a page without article or main; hosts differ in layout, and most of the noise has no mark."""
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    words = lambda n: " ".join(word() for _ in range(n))
    title, paragraphs = words(4), [words(rng.randrange(15, 60)) for _ in range(rng.randrange(2, 9))]
    menu = "".join(f'<li><a href="/{x}">{x}</a></li>' for x in ("Home", "Shop", "About us", "Jobs", "Press"))
    box = f"<section><b>Our offer {i % 2}</b><p>Buy one, get one.</p></section>"
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    if host == 0:
        page = f"<div class=top><ul>{menu}</ul></div><div class=c1><h1>{title}</h1>{body}{box}</div><div class=c2>All rights reserved by us.</div>"
    elif host == 1:
        page = f"<table><tr><td width=20%><ul>{menu}</ul><td><h2>{title}</h2><div><div>{body}</div></div>{box}<div class='user-comments'><p>{words(30)}</p></div></table>"
    else:
        page = f"<div id=wrap class=no-sidebar><h1>{title}</h1><div class='ad-slot'>{words(8)}</div><div>We use crumbs. Accept all.</div>{body}</div><p class=z>Terms of use</p><nav>{words(5)}</nav>"
    return f"<html><head><title>{title}</title></head><body>{page}</body></html>", "\n".join([title, *paragraphs])


def test_gold_pages(table):
    """Pages without an article mark, by the tree and by marks; without the tree they come out wrong."""
    rng = random.Random(3)
    pages = [(k, f"http://h{k % 3}.example/{k}", *gold_page(k % 3, k, rng)) for k in range(75)]
    docs = table([r[:3] for r in pages] + [pages[4][:3]], "page_id long, url string, html string")
    rows = html_extract.extract_main_text(docs).collect()
    assert len(rows) == 76 and {r.page_id: r.text for r in rows} == {r[0]: r[3] for r in pages}
    blind = {r.page_id: r.text for r in html_extract.extract_main_text(docs, least=10**9).collect()}
    assert all(blind[r[0]] != r[3] for r in pages)


def test_tree_inside_articles(table):
    """What every article of a site repeats goes, in boxes or not; a word in an article's class is no verdict."""
    page = lambda i: f"<article><h1>Title {i}</h1><p>story {i} <b>Note</b></p><ul><li>Follow us</li><li>Tell a friend</li></ul><div class=warning>careful {i}</div><h4>Read on</h4></article>"
    docs = table([(i, f"http://a.example/{i}", page(i)) for i in range(20)], "page_id long, url string, html string")
    out = {r.page_id: r.text for r in html_extract.extract_main_text(docs).collect()}
    assert out == {i: f"Title {i}\nstory {i} Note\ncareful {i}" for i in range(20)}
    long = f"<article><p>{'word ' * 400_000}</p>{'<div>' * 2000}deep</article>"
    assert text(long) == "word " * 399_999 + "word\ndeep"


def test_importance_against_entropy(table):
    """Entropies over one host's pages, counted by hand."""
    pages = [f"<body><div><a>x</a><a>y{i % 3}</a></div><p>new {i}</p>{'<p>more</p>' if i % 2 else ''}</body>" for i in range(12)]
    docs = table([(i, "http://a.example/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    found = {(r.host, r.path): (r.says, r.looks) for r in html_extract.style_importance(docs, "url", "html", 8).collect()}

    def importance(pages):
        """1 less the mean, over all occurrences, of the entropy to the base of the number of pages."""
        own = [[sum(1 / len(on) * -math.log(1 / len(on), len(pages)) for _ in on) for v in p for on in [[q for q in pages if v in q]]] for p in pages]
        return 1 - sum(map(sum, own)) / sum(map(len, own))

    path = {n.style: html_extract.number(n.path) for n in html_extract.walk(html_extract.parse(pages[1]))}
    expected = {
        "a": (importance([["x", f"y{i % 3}"] for i in range(12)]), 1.0),
        "div": (1.0, importance([["a"]] * 12)),
        "p": (importance([[f"new {i}", *(["more"] if i % 2 else [])] for i in range(12)]), 1.0),
        "body": (1.0, 0.0),
    }
    assert {k: found["a.example", path[k]] for k in expected} == {k: pytest.approx(v) for k, v in expected.items()}


def brute_secrets(t):
    found = []
    for kind, pattern, keep in (
        ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ):
        found += [(m.start(), ("assign", "access", "hex").index(kind), m.end()) for m in re.finditer(pattern, t) if keep(m)]
    return sorted(found)


SECRET = 'password = "hunter22x"'


def test_base_secrets(documents):
    texts = [r.text for r in documents.select("text").collect()] + ["", SECRET, "Token: short", "ToKeN:'abcdef' x", "AKIA" + "Q" * 16 + "q", "AKIA" + "Q" * 15, "f" * 23, "f" * 24 + "g" + "0" * 30, "paſſword=abcdefgh", "toKen=abcdefgh"]
    for t in texts:
        assert sorted((s, k, e) for s, kind, e in secrets.base_spans(t) for k in [secrets.KINDS.index(kind)]) == brute_secrets(t)


@pytest.mark.parametrize(
    ("wrapped", "via"),
    [
        (base64.b64encode(SECRET.encode()).decode(), "base64"),
        (base64.urlsafe_b64encode(SECRET.encode()).decode().rstrip("="), "base64"),
        (quote(SECRET), "url"),
        ("".join(f"\\u{ord(c):04x}" for c in SECRET), "unicode"),
        (base64.b64encode(gzip.compress(SECRET.encode())).decode(), "base64>compressed"),
        (quote(base64.b64encode(quote(SECRET).encode()).decode()), "base64>url"),
        (base64.b64encode(base64.b64encode(SECRET.encode())).decode(), "base64>base64"),
    ],
)
def test_decoded_secrets(wrapped, via):
    found = [f for f in secrets.find_secrets(f"é <{wrapped}> end") if f[3]]
    assert any(f[0] == "assign" and f[4].endswith(via) and f[5] == 'password = "hunter22x' for f in found)
    assert all(3 <= f[1] < f[2] <= 3 + len(wrapped) for f in found)


@pytest.mark.parametrize(
    "layer",
    ["mot de passe\u00a0: token=abcdef123".encode(), "Étape: token=abcdef123".encode(), b"\x0c page token=abcdef123", b"\x00\xff\xfe token=abcdef123 \xe9", "\ufefftoken=abcdef123 😀".encode()],
)
def test_unreadable_layers(layer):
    for data in (layer, gzip.compress(layer)):
        assert any(f[3] == 1 and f[5] == "token=abcdef123" for f in secrets.find_secrets(f"a {base64.b64encode(data).decode()} b"))
    text = "".join(f"%{x:02X}" for x in layer)
    (found,) = secrets.find_secrets("http://h/?q=" + text)
    at = 12 + 3 * layer.index(b"token")
    assert found[:3] == ("assign", at, at + 45) and found[5] == "token=abcdef123"
    assert any(f[5] == "token=abcdef123" for f in secrets.find_secrets("http://h/?q=caf%E9&token%3Dabcdef123"))


def test_compressed_layers():
    plain = b"some words first, then token=abcdef123 and more " + b"x" * 40
    half = len(plain) // 3
    for data in (
        gzip.compress(gzip.compress(plain)),
        lzma.compress(bz2.compress(gzip.compress(b"\x00\xff" + plain))),
        gzip.compress(plain[:half]) + gzip.compress(plain[half:]),
        bz2.compress(plain[:half]) + bz2.compress(plain[half:]),
        lzma.compress(plain[:half]) + lzma.compress(plain[half:]),
        zstandard.compress(plain[:half]) + zstandard.compress(plain[half:]),
        lzma.compress(plain, preset=9),
        gzip.compress(plain) + b"rest",
    ):
        found = secrets.find_secrets(f"a {base64.b64encode(data).decode()} b")
        assert any(f[4].endswith("compressed") and f[5] == "token=abcdef123" for f in found)
    assert any(f[5] == "token=abcdef123" for f in secrets.find_secrets("a=" + "".join(f"%{x:02X}" for x in gzip.compress(plain))))


@pytest.mark.parametrize("size", [64, 70, 76])
def test_base64_lines(size):
    for data in (b"y" * 40 + b" token=abcdef123 " + b"z" * 90, gzip.compress(np.random.default_rng(0).bytes(200) + b" token=abcdef123 ")):
        code = base64.b64encode(data).decode()
        for end in ("\n", "\r\n", "\n  ", "\n> "):
            text = "internationalization" + end + end.join(code[i : i + size] for i in range(0, len(code), size)) + "\nend"
            found = [f for f in secrets.find_secrets(text) if f[5] == "token=abcdef123"]
            assert found and all("internationalization" not in text[f[1] : f[2]] for f in found)


def test_alignments_and_signatures():
    """Layers behind letters of a path or a name, compressed without a header, or in UTF-16."""
    plain = b"some words first, then token=abcdef123 and more " + b"x" * 40
    raw = zlib.compressobj(9, wbits=-15)
    deflated = raw.compress(plain) + raw.flush()
    layers = [plain, gzip.compress(plain), zlib.compress(plain, 1), zlib.compress(plain, 9), bz2.compress(plain), lzma.compress(plain), zstandard.compress(plain), deflated]
    layers += [plain.decode().encode(f"utf-16-{order}") for order in ("le", "be")] + [b"\xff" + plain.decode().encode("utf-16-be"), b"\0\0abc" + gzip.compress(plain)]
    for data in layers:
        for encode in (base64.b64encode, base64.urlsafe_b64encode):
            code = encode(data).decode()
            for prefix in ("", "/dl/", "/d/", "blob_", "https://h.example/download/"):
                text = f"a {prefix}{code} b"
                found = [f for f in secrets.find_secrets(text) if f[5] == "token=abcdef123"]
                assert found and all(2 <= f[1] < f[2] <= len(text) - 2 for f in found), (data, prefix)
        assert any(f[5] == "token=abcdef123" for f in secrets.find_secrets("a=x" + "".join(f"%{x:02X}" for x in data)))
    assert all(f[3] == 0 for f in secrets.find_secrets(base64.b64encode(np.random.default_rng(1).bytes(200_000)).decode()))
    start = time.perf_counter()
    many = gzip.compress(b"a b c d e f") * 30_000 + gzip.compress(b" token=abcdef123")
    assert any(f[5] == "token=abcdef123" for f in secrets.find_secrets(base64.b64encode(many).decode()))
    assert time.perf_counter() - start < 60  # each member is read once for each alignment


def test_cycles_and_bombs():
    assert secrets.find_secrets("%25" * 3000) == []
    bomb = base64.b64encode(gzip.compress(b"0" * (secrets.LAYER_BYTES + 10))).decode()
    assert all(f[3] == 0 for f in secrets.find_secrets(bomb))


def test_secret_table(table):
    docs = table([(1, SECRET), (2, None), (3, ""), (None, SECRET), (1, SECRET), (5, "x" * 300_000 + " " + SECRET)])
    rows = secrets.scan_secrets(docs).collect()
    assert sorted(len(r.spans) for r in rows) == [0, 0, 1, 1, 1, 1]
    assert [r.spans[0].start for r in rows if r.doc_id == 5] == [300_001]
    assert secrets.scan_secrets(docs.limit(0)).count() == 0


def luhn_slow(n):
    d = [int(c) for c in n][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def brute_personal(t):
    number = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(number(m)) <= 19 and luhn_slow(number(m))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(number(m)) <= 15]
    return out


def test_base_personal_data(documents):
    rng = np.random.default_rng(3)
    texts = [r.text for r in documents.select("text").collect()]
    texts += ["".join(rng.choice(list("a1.@+- 9"), 60)) for _ in range(400)] + ["", "a@b@c.de", "1.2.3.4.5.6.7.8", "0000001.2.3.4 256.1.1.1", "4111 1111 1111 1111", "+1 (310) 555-4510 x", "+12", "٣.١.٢.٤"]
    for t in texts:
        assert personal_data.base_spans(t) == brute_personal(t), t


def slow_loose(found, base):
    out = []
    for x in found:
        if all(x[2] <= s or e <= x[1] for _, s, e in (*base, *out)):
            out.append(x)
    return out


def test_loose_spans():
    """Candidates overlap neither base spans nor each other, also in very long texts, in linear time."""
    parts = ["jo.k [at] site [dot] com", "a@b.org", "310-555-4510", "(310) 555-4510", "+1 310 555 4510", "378282246310005", "4111 1111 1111 1111", "10[.]1[.]2[.]3", "1.2.3.4", "x dot y", " ", "at", "9"]
    rng = np.random.default_rng(5)
    for _ in range(300):
        t = "".join(rng.choice(parts, 12)) if rng.random() < 0.5 else " ".join(rng.choice(parts, 12))
        base = personal_data.base_spans(t)
        alone = personal_data.loose_spans(t, [])
        found = [("email", *m.span()) for m in personal_data.LOOSE_EMAIL.finditer(t)] + [("ip", *m.span()) for m in personal_data.LOOSE_IP.finditer(t)]
        found += [("card", *m.span()) for m in personal_data.CARD.finditer(t) if 13 <= len(n := personal_data.digits(m[0])) <= 15 and personal_data.luhn(n)]
        found += [("phone", *m.span()) for m in personal_data.LOOSE_PHONE.finditer(t)]
        found = found if "@" in t or "[at]" in t or " dot " in t else [x for x in found if x[0] != "email"]
        assert personal_data.loose_spans(t, base) == slow_loose(found, base) and alone == slow_loose(found, [])
    contacts = "".join(f"jo{i} [at] site [dot] com, 310-555-{i % 10000:04d}; a{i}@b.org\n" for i in range(100_000))
    assert len(contacts) > 5_000_000
    start = time.perf_counter()
    assert len(personal_data.loose_spans(contacts, personal_data.base_spans(contacts))) == 200_000
    assert time.perf_counter() - start < 30


def test_classifier():
    counts = [("email", "++0++", 900), ("email", "0-0--", 300), ("email", "0+0++", 40), ("email", "0--+-", 60)]
    posterior = personal_data.estimate(counts)
    assert posterior["email", "++0++"] > 0.9 and posterior["email", "0-0--"] < 0.1
    w = personal_data.train(counts, posterior)
    p = lambda v: 1 / (1 + np.exp(-personal_data.features("email", v) @ w))
    assert p("++0++") > 0.8 > 0.2 > p("0-0--")
    assert personal_data.estimate([]) == {} and not personal_data.train([], {}).any()


def test_personal_table(table):
    sure = [(i, f"mail user{i}.k@site{i}.com or 98.76.54.{i}") for i in range(40)]
    docs = table([*sure, (50, None), (51, ""), (None, "x@y.de"), (52, "mail jo.smith [at] site [dot] com"), (53, "9" * 100_000 + " a@b.org")])
    rows = {r.doc_id: r.spans for r in personal_data.find_personal_data(docs).collect()}
    assert [s.kind for s in rows[3]] == ["email", "ip"] and all(s.base for s in rows[3])
    assert rows[50] == rows[51] == [] and [s.base for s in rows[None]] == [True]
    assert [s.kind for s in rows[53]] == ["email"]
    assert personal_data.find_personal_data(docs.limit(0)).count() == 0


@pytest.mark.parametrize("part", ["<div></b>", "<a ", "<span>", "</b>", "<!--x", "</script", '<a ">x', "<script>", "<p><li></i>", "<td><b>", "<"])
def test_broken_pages_in_linear_time(part):
    """A megabyte of broken tags, and the same ones in blocks of one kind."""
    start = time.monotonic()
    html_extract.parse(part * (1_000_000 // len(part)))
    for piece in re.findall(r"<[^<]*", part):
        html_extract.parse(piece * 100_000 + "<p></p>" * 50_000)
    assert time.monotonic() - start < 12
